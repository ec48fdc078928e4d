"""The corpus pipeline: language ID, line dedup, near-duplicate removal, source mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; all but the last return the
columns of documents. run() applies them in turn, each stage's result written as Parquet in the shared folder and read again.
Tables without documents pass through. ``n_chars`` follows the text where a stage changes it. Columns besides those of
documents go with the first stage, whatever their names. Ids may be null or repeated: rows are told apart by id and text.
Very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fpsample.llm.common import prepare, row_key, sized_broadcast, written
from fpsample.llm.jaccard import similar_groups
from fpsample.llm.language import identify
from fpsample.llm.line_dedup import dedup_lines
from fpsample.llm.mixing import mix_sources, mixed_rows
from fpsample.llm.sentencepieces import encode_and_decode

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_KEY = ["_no_id", "_id", "_text_hash"]
#: Words of a shingle and similarity in percent for near duplicates.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Keys of rows that are broadcast at most (some 12 MB); beyond these texts meet them by hash.
MOST_BROADCAST = 300_000


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; lang is the language found. Texts null, empty or without letters are rejected, and so are those of no likely language. Rows repeated whole stay, each; so do rows of null ids."""
    prepare(spark)
    keyed = docs.select(*COLUMNS).withColumns(row_key())
    evidence = keyed.select(*_KEY, "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    found = identify(spark, evidence)
    kept = found.filter("accepted").select(*_KEY, F.col("language").alias("_language")).dropDuplicates(_KEY)
    return keyed.join(kept, _KEY).select(*[F.col("_language").alias("lang") if c == "lang" else F.col(c) for c in COLUMNS])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more share. Documents left without any line but empty ones stay, empty, as no line's loss says that a document is unclean. Null texts become empty; rows repeated whole stay, and count as one document."""
    out = dedup_lines(spark, docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): the least id, ties by text. Documents without words are in no group and stay; rows alike in id and text are one document."""
    prepare(spark)
    keyed = docs.select(*COLUMNS).withColumns(row_key())
    groups = similar_groups(spark, docs, NEAR_WORDS, NEAR_PERCENT)
    rows = written(spark, groups.select(F.col("doc_id").isNull().alias("_no_id"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("text_hash").alias("_text_hash"), "n_shingles", "group_id"), "near-groups")
    first = rows.filter("n_shingles > 0").groupBy("group_id").agg(F.min(F.struct(*_KEY)).alias("first")).select("first.*")
    alone = rows.filter("n_shingles = 0").select(*_KEY)
    # Few rows of most corpora go, and fewer are repeated whole: lists of both, counted first, go to the texts, which stay in place.
    gone = written(spark, rows.select(*_KEY).distinct().join(first.union(alone), _KEY, "left_anti"), "near-copies")
    twice = written(spark, rows.groupBy(*_KEY).agg(F.count("*").alias("n")).filter("n > 1").select(*_KEY), "repeated-rows")
    left, twice = keyed.join(sized_broadcast(gone, MOST_BROADCAST), _KEY, "left_anti"), sized_broadcast(twice, MOST_BROADCAST)
    return left.join(twice, _KEY, "left_anti").union(left.join(twice, _KEY, "left_semi").dropDuplicates(_KEY)).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it, a shard's rows together and in the shard's order. Null and empty texts have size 0 and are taken with their block; a null source is one of its own; rows alike are taken in part, by their place; ties in order fall to the text."""
    mixed = mixed_rows(mix_sources(spark, docs.select(*COLUMNS)))
    # by ranges of the mix's order, so that a partition may hold several shards or a part of one, however large a shard is
    return mixed.repartitionByRange("shard", "order_key").sortWithinPartitions("shard", "order_key").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's number of ids, their digest, and the digest of what they decode to. Null texts are empty, without ids; every row gives a row, repeated ones too."""
    out = encode_and_decode(spark, docs.select("doc_id", "text"))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", keep_identified), ("line_dedup", drop_repeated_lines), ("near_duplicates", keep_one_of_near_copies), ("mixing", mix), ("sentencepiece", encode)]

#: Language models, similarity groups and tokens have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES on documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k == len(STAGES) - 1 else written(spark, docs, f"pipeline-{name}")
    return docs
