"""What ordered containers are asked for, as plans: greatest and least, floor and ceiling of keys, membership, order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpsample.plans.recipes import asof


def top(df: DataFrame, by: str, ties: list[str], n: int = 1) -> DataFrame:
    """The n greatest rows, in order: a partial top-n in each task, no full sort."""
    return df.orderBy(F.desc(by), *ties).limit(n)


def random_row(df: DataFrame, seed: int, keys: list[str], n: int = 1) -> DataFrame:
    """n seeded random rows, whatever the partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def contained(df: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(held.select(*keys).distinct(), keys, "left_semi")


def insert(df: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """df and those of more whose key neither df nor an earlier row has; equal keys keep one row."""
    fresh = more.join(df.select(key), key, "left_anti")
    first = fresh.groupBy(key).agg(F.min(F.struct(*[c for c in fresh.columns if c != key])).alias("_r"))
    return df.unionByName(first.select(key, "_r.*"))


def extremes(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.min(key).alias("least"), F.max(key).alias("greatest"), F.count("*").alias("n"))


def floor_lookup(queries: DataFrame, held: DataFrame, key: str, value: str) -> DataFrame:
    """queries with ``floor``: value of the greatest held key up to the query's, null if none."""
    return asof(queries, held, key, value, "floor")


def ceil_lookup(queries: DataFrame, held: DataFrame, key: str, value: str) -> DataFrame:
    """queries with ``ceil``: value of the least held key from the query's on, null if none."""
    return asof(queries, held, key, value, "ceil", greatest=False)


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys)
