"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop frequent lines, reassemble by position.

All of it is in built-in functions. A line's hash is 128 bits: two xxhash64 of its key, one of them seeded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fpsample.llm.common import LOWER, SPACE, UPPER, boxed, prepare, row_key, spread_join, unboxed, written

#: Keys in at least so many documents lose their lines.
MIN_DOCUMENTS = 10


def line_key(line: Column) -> Column:
    """A line with white space (blank, 0x09 to 0x0D) stripped at both ends and A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def split_lines(text: Column) -> Column:
    """A text's lines; null or empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def without(text: Column, dropped: Column) -> Column:
    """The text without the lines at ``dropped`` (an array of positions, ascending): the runs of lines between them are sliced out and joined, so the cost is the text's length."""
    edges = F.concat(F.array(F.lit(-1)), dropped)

    def kept(lines: Column) -> Column:
        ends = F.concat(dropped, F.array(F.size(lines)))
        runs = F.transform(F.arrays_zip(edges.alias("a"), ends.alias("b")), lambda r: F.slice(lines, r["a"] + 2, r["b"] - r["a"] - 1))
        return F.array_join(F.flatten(runs), "\n")

    return F.transform(F.array(split_lines(text)), kept)[0]


def dedup_lines(spark: SparkSession, docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """docs without the lines whose key (stripped of white space, A-Z in lower case) is in ``min_documents`` documents or more.

    Takes any columns besides ``doc_id`` and ``text`` and returns all of them, ``text`` reassembled, with ``n_lines`` (before)
    and ``n_dropped``; columns of these names in the input are replaced. Null or empty texts are one empty line; empty keys
    are never dropped. A document is a doc_id: rows of one id count once, whether alike or not; rows without an id are told
    apart by their text. An empty table gives an empty result. Documents left without lines have the text ''.
    """
    prepare(spark)
    body, names = boxed(docs, ("n_lines", "n_dropped"))
    key = ["_no_id", "_id", "_text_hash"]
    body = body.withColumns(row_key())
    lines = body.select(*key, F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.select(*key, "pos", line_key(F.col("line")).alias("line")).filter("line <> ''")
    lines = lines.select(*key, "pos", F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b")).alias("line"))
    # Distinct documents per line: a row's own repeats go first, inside its task; then pairs of line and document, which no line gathers.
    document = F.when(F.col("_no_id"), F.col("_text_hash")).otherwise(F.col("_id"))
    pairs = lines.select("line", "_no_id", document.alias("document")).distinct()
    frequent = pairs.groupBy("line").agg(F.count("*").alias("documents")).filter(F.col("documents") >= min_documents)
    frequent = written(spark, frequent.withColumn("hit", F.lit(True)), "frequent-lines")
    hits = spread_join(lines, frequent, "line", "documents", F.struct("_id", "_text_hash", "pos")).filter("hit")
    dropped = hits.groupBy(*key).agg(F.array_sort(F.collect_set("pos")).alias("_dropped"))
    whole = body.join(dropped, key, "left").drop(*key)
    gone = F.col("_dropped").isNotNull()
    made = whole.withColumns({
        "_n_lines": F.size(split_lines(F.col("text"))).cast("long"),
        "_n_dropped": F.when(gone, F.size("_dropped")).otherwise(0).cast("long"),
        "text": F.when(gone, without(F.col("text"), F.col("_dropped"))).otherwise(F.coalesce("text", F.lit(""))),
    })
    return unboxed(made, names, {"n_lines": F.col("_n_lines"), "n_dropped": F.col("_n_dropped")})
