"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch between the JVM and Python, whichever comes first.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20
#: The letters A to Z and their lower case, for the contracts that fold these alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points that the contracts call white space: blank and 0x09 to 0x0D.
SPACE = " \t\n\x0b\x0c\r"
_TO_LOWER = str.maketrans(UPPER, LOWER)


def fold_az(text: str) -> str:
    """The text with A to Z, and no other letter, in lower case."""
    return text.lower() if text.isascii() else text.translate(_TO_LOWER)


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package and keeps Arrow batches small."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, by spark.checkpoint.dir; where that is unset (as in tests), one is made and set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="fpsample-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage and outlives any executor."""
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> dict[str, Column]:
    """Columns that tell documents apart where ids are null or repeated: rows alike in id and text are alike in every result."""
    return {"_no_id": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0)).cast("long"), "_text_hash": F.xxhash64("text")}


def spread_join(left: DataFrame, groups: DataFrame, key: str, weight: str, salt: Column, parts: int = 1000) -> DataFrame:
    """Left join with ``groups``, which has one row a key and in ``weight`` the key's number of rows in ``left``.

    Keys with more than one in ``parts`` of all rows are fewer than ``parts`` by their sum, so a list of these keys alone is
    broadcast; their rows are dealt out by ``salt``, and their groups copied, to as many places as it takes that none has
    more than one in ``parts`` (at most twice ``parts`` copies in all). All meet in one shuffled join, whatever the groups'
    width. Rows with a null key match nothing. ``groups`` is read three times: pass a written table.
    """
    total = groups.agg(F.sum(weight)).first()[0] or 0
    names = [c for c in groups.columns if c not in (key, weight)]
    copies = F.ceil(F.col(weight) * F.lit(float(parts)) / F.lit(float(max(total, 1)))).cast("int")
    heavy = groups.filter(copies > 1).select(F.col(key).alias("_heavy_key"), copies.alias("_copies"))
    places = F.coalesce("_copies", F.when(F.col(key).isNull(), F.lit(1 << 20)), F.lit(1))
    dealt = left.join(F.broadcast(heavy), F.col(key) == F.col("_heavy_key"), "left").withColumn("_salt", F.pmod(F.xxhash64(salt), places).cast("int"))
    copied = groups.select(F.col(key).alias("_group_key"), F.struct(*names).alias("_group"), F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1)).alias("_group_salt"))
    out = dealt.join(copied, (F.col(key) == F.col("_group_key")) & (F.col("_salt") == F.col("_group_salt")), "left")
    return out.select(*left.columns, *[F.col("_group")[c].alias(c) for c in names])


def sized_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if a count proves it to have at most ``rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def boxed(docs: DataFrame, replaced: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """docs as columns ``doc_id``, ``text`` and the others under names of our own (``_0``, ``_1``...), so that none clashes; and the original order, without ``replaced``."""
    names = [c for c in docs.columns if c not in replaced]
    own = {c: c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(names)}
    return docs.select(*[F.col(f"`{c}`").alias(own[c]) for c in names]), names


def unboxed(df: DataFrame, names: list[str], added: dict[str, Column] | None = None) -> DataFrame:
    """The columns of docs again, by their own names, then ``added``."""
    own = [F.col(c if c in ("doc_id", "text") else f"_{i}").alias(c) for i, c in enumerate(names)]
    return df.select(*own, *[v.alias(k) for k, v in (added or {}).items()])
