"""Analysis of samples and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fpsample.plans.recipes import quantiles


def minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to [0, 1]; constants become 0."""
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    one = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(0.0)
    return df.join(F.broadcast(ends)).withColumns({c: one(c) for c in columns}).select(*df.columns)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def pairs(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """All pairs of rows, by ascending key. For small tables: the result itself is quadratic."""
    a = df.select(*[F.col(c).alias(f"a_{c}") for c in {key: 0, **dict.fromkeys(columns)}])
    b = df.select(*[F.col(c).alias(f"b_{c}") for c in {key: 0, **dict.fromkeys(columns)}])
    return a.join(b, F.col(f"a_{key}") < F.col(f"b_{key}"))


def triples(df: DataFrame, key: str, group: str) -> DataFrame:
    """All triples of ascending keys that lie in three different groups."""
    p = pairs(df, key, [group]).filter(F.col(f"a_{group}") != F.col(f"b_{group}"))
    c = df.select(F.col(key).alias(f"c_{key}"), F.col(group).alias(f"c_{group}"))
    return p.join(c, F.col(f"b_{key}") < F.col(f"c_{key}")).filter((F.col(f"c_{group}") != F.col(f"a_{group}")) & (F.col(f"c_{group}") != F.col(f"b_{group}")))


def mean_with_total(df: DataFrame, by: str, value: str, digits: int = 4) -> DataFrame:
    """Mean and count of each group and, as 'Mean', of all: one pass by grouping sets."""
    g = df.rollup(by).agg(F.grouping(by).alias("_g"), F.avg(value).alias("mean"), F.count("*").alias("n"))
    return g.select(F.when(F.col("_g") == 1, F.lit("Mean")).otherwise(F.col(by).cast("string")).alias(by), F.round("mean", digits).alias("mean"), "n")


def label_index(df: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """df with the unit_id of its label."""
    return df.join(labels.select(label, "unit_id"), label)


def rotate(df: DataFrame, x: str, y: str, degrees: float) -> DataFrame:
    a = math.radians(degrees)
    return df.withColumns({x: F.col(x) * math.cos(a) - F.col(y) * math.sin(a), y: F.col(x) * math.sin(a) + F.col(y) * math.cos(a)})


def stack(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def repaired(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list, value: str) -> DataFrame:
    """left in its order beside the values of right in its own: an equi-join on row numbers."""
    from fpsample.plans.recipes import running_sum

    number = lambda d, o: running_sum(d.withColumn("_one", F.lit(1)), o, "_one", "_number").drop("_one")
    return number(left, left_order).join(number(right, right_order).select("_number", value), "_number").drop("_number")


def describe(df: DataFrame, by: str, value: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of each group."""
    moments = df.groupBy(by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = quantiles(df, [by], value, [0.25, 0.5, 0.75])
    return moments.join(q, by, "left").select(by, "count", "mean", "std", "min", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"), "max")


def without_outliers(df: DataFrame, column: str, coefficient: float, by: str) -> DataFrame:
    """Rows within coefficient interquartile ranges of their group's quartiles."""
    q = quantiles(df, [by], column, [0.25, 0.75]).withColumnsRenamed({"q0": "_q1", "q1": "_q3"})
    room = coefficient * (F.col("_q3") - F.col("_q1"))
    return df.join(q, by).filter(F.col(column).between(F.col("_q1") - room, F.col("_q3") + room)).select(*df.columns)


def boxplot(df: DataFrame, by: str, value: str, coefficient: float = 1.5) -> DataFrame:
    """Quartiles, whiskers and number of outliers of each group."""
    q = quantiles(df, [by], value, [0.25, 0.5, 0.75]).withColumnsRenamed({"q0": "q25", "q1": "q50", "q2": "q75"})
    room = coefficient * (F.col("q75") - F.col("q25"))
    inside = F.col(value).between(F.col("q25") - room, F.col("q75") + room)
    return df.join(q, by).groupBy(by, "q25", "q50", "q75").agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.count(F.when(~inside, 1)).alias("outliers"))


def cluster_mass(member: DataFrame, units: DataFrame, pi: str) -> DataFrame:
    """Units and inclusion mass of each cluster."""
    j = member.join(units.select("unit_id", pi), "unit_id")
    return j.groupBy("cluster_id").agg(F.count("*").alias("units"), F.sum(F.col("frac") * F.col(pi)).alias("mass"))


def score_table(samples: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of each method's draws."""
    return samples.select("method", "draw_id").distinct().join(scores, ["method", "draw_id"])


def methods(scores: DataFrame) -> DataFrame:
    return scores.select("method").distinct()


def ranks(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
