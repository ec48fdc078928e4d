"""Document fingerprints: a canonical exact digest, verified by bytes inside equal buckets.

Canonical form: Unicode NFKC, case folding, runs of white space as one blank, none at the ends. Its 128-bit xxhash is the
bucket. Buckets of more than one document compare the canonical bytes themselves: the least and the greatest of a bucket
are equal if and only if all are. A bucket that holds different bytes is told apart by SHA-256, so equal fingerprints mean
equal canonical texts.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fpsample.llm.common import boxed, prepare, sized_broadcast, unboxed, written

#: Digests of repeated texts that are broadcast (some 30 MB) at most; beyond these the join shuffles.
MOST_BROADCAST = 300_000
#: Parts by which a bucket's comparison is spread before its extremes meet.
SALTS = 64


def canonical(text: str | None) -> str:
    text = text or ""
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    folded = text.casefold()
    if not unicodedata.is_normalized("NFKC", folded):
        folded = unicodedata.normalize("NFKC", folded)
    return " ".join(folded.split())


def bucket(form: str) -> str:
    return xxhash.xxh3_128_hexdigest(form.encode())


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        forms = [canonical(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([bucket(f) for f in forms], pa.string()), pa.array(forms, pa.string())], ["bucket", "form"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        forms = [canonical(t) for t in b.column("text").to_pylist()]
        own = [pa.array([bucket(f) for f in forms], pa.string()), pa.array([hashlib.sha256(f.encode()).hexdigest() for f in forms], pa.string())]
        yield pa.RecordBatch.from_arrays([*b.columns, *own], [*b.schema.names, "_bucket", "_sha"])


def collisions(spark: SparkSession, docs: DataFrame, repeated: DataFrame, forms=_forms) -> DataFrame:
    """Buckets, out of those in ``repeated``, whose documents differ in canonical bytes. Only documents of these buckets are shuffled, each task's as its extremes."""
    held = prepare(spark) and docs.select("text").mapInArrow(forms, "bucket string, form string")
    held = held.join(sized_broadcast(repeated.select("bucket"), MOST_BROADCAST), "bucket", "left_semi")
    ends = [F.min("form").alias("least"), F.max("form").alias("most")]
    salted = held.groupBy("bucket", F.pmod(F.xxhash64("form"), F.lit(SALTS)).alias("salt")).agg(*ends)
    return salted.groupBy("bucket").agg(F.min("least").alias("least"), F.max("most").alias("most")).filter("least <> most").select("bucket")


def fingerprint_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with ``fingerprint`` (replaced if it is there) and their other columns.

    Null and empty texts share the fingerprint of ''. Equal canonical texts, and only these, have equal fingerprints.
    Repeated rows are kept; an empty table gives an empty result.
    """
    body, names = boxed(docs, ("fingerprint",))
    kinds = [(f.name, f.dataType.simpleString()) for f in body.schema]
    made = prepare(spark) and body.mapInArrow(_digested, ", ".join(f"{n} {k}" for n, k in [*kinds, ("_bucket", "string"), ("_sha", "string")]))
    slim = docs.select("text").mapInArrow(_forms, "bucket string, form string").groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    bad = written(spark, collisions(spark, docs, written(spark, slim, "repeated-buckets")), "collisions").withColumnRenamed("bucket", "_bad")
    out = made.join(sized_broadcast(bad, MOST_BROADCAST), made["_bucket"] == bad["_bad"], "left")
    return unboxed(out, names, {"fingerprint": _name("_bucket", "_sha")})


def _name(bucket: str, sha: str, bad: str = "_bad"):
    return F.when(F.col(bad).isNotNull(), F.concat_ws("-", bucket, sha)).otherwise(F.col(bucket))


def _row(doc_id: int | None, text: str, following: str | None) -> tuple:
    n = len(text)
    half = n // 2
    edited = text[: n - half] + (following or "")[:half]
    form, e_form = canonical(text), canonical(edited)
    sha = lambda x: hashlib.sha256(x.encode()).digest()
    wide = lambda x: xxhash.xxh3_128_digest(x.encode())
    return (doc_id, n, sha(edited), wide(form), sha(form), wide(e_form), sha(e_form), float(form == e_form), float(form == canonical(following)), None, None, None)


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), *((x, pa.binary()) for x in ("edited_sha", "bucket", "sha", "e_bucket", "e_sha")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("end", pa.string()), ("end_key", pa.binary()), ("end_text", pa.string())]


def _order(doc_id: int | None, text: str | None) -> bytes:
    """A key that rises along the order of rows: descending id, nulls last, then ascending digest of the text."""
    return (b"\1" * 9 if doc_id is None else b"\0" + (2**63 - 1 - doc_id).to_bytes(8, "big")) + hashlib.sha256((text or "").encode()).digest()


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each seen with the one that follows; the partition's first and last rows are given out whole, to meet those of other partitions."""
    before: tuple[int | None, str] | None = None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * len(_FIELDS)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, _FIELDS, strict=True)], [n for n, _ in _FIELDS])

    def end(kind: str, row: tuple[int | None, str]) -> tuple:
        return (row[0], *[None] * 8, kind, _order(*row), row[1])

    for b in batches:
        rows = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            here = (doc_id, text or "")
            rows.append(end("first", here) if before is None else _row(*before, here[1]))
            before = here
        yield out(rows)
    if before is not None:
        yield out([end("last", before)])


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [_row(i, t or "", f) for i, t, f in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True)]
        cols = list(zip(*rows, strict=True)) or [[]] * len(_FIELDS)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def compare_neighbours(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness (1 equal, 0 not) to each other and to the next document's.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many of the next
    document's, by descending doc_id, null last, ties by the text's SHA-256; after the last row comes the first. Null texts
    are empty; one row alone follows itself; repeated rows each stand in the order; an empty table gives an empty result.
    Columns besides doc_id and text are not carried. Texts move in one range-partitioned shuffle, ids and then digests; each partition reads its rows in order, and only the partitions' first and
    last rows, two a partition, meet in a window.
    """
    prepare(spark)
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.float64(): "double"}
    schema = ", ".join(f"{n} {kinds[k]}" for n, k in _FIELDS)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.sha2(F.coalesce("text", F.lit("")), 256)]
    ranged = text.repartitionByRange(*order)
    seen = written(spark, ranged.sortWithinPartitions(*order).mapInArrow(_neighbours, schema), "neighbours")

    ends = seen.filter("end is not null").select("doc_id", "end", "end_key", "end_text")
    # Partitions follow each other: after a partition's last row comes the first row that is next in the order, or the very first.
    line = Window.orderBy("end_key", F.col("end") == "last")
    slim = ends.select("end", "end_key", F.lead("end_key").over(line).alias("next_key"), F.first("end_key").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("first_key"))
    pairs = slim.filter(F.col("end") == "last").select(F.col("end_key").alias("last_key"), F.coalesce("next_key", "first_key").alias("first_key"))
    lasts = ends.filter(F.col("end") == "last").select("doc_id", F.col("end_text").alias("text"), F.col("end_key").alias("last_key"))
    firsts = ends.filter(F.col("end") == "first").select(F.col("end_text").alias("following"), F.col("end_key").alias("first_key"))
    closed = lasts.join(pairs, "last_key").join(firsts.dropDuplicates(["first_key"]), "first_key").select("doc_id", "text", "following").mapInArrow(_joined_ends, schema)
    rows = seen.filter("end is null").unionByName(closed).drop("end", "end_key", "end_text")
    hexed = {c: F.lower(F.hex(c)) for c in ("edited_sha", "bucket", "sha", "e_bucket", "e_sha")}
    bad = written(spark, collided(spark, docs, rows), "collisions").select(F.lower(F.hex("bucket")).alias("_bad"))
    own, edited = sized_broadcast(bad, MOST_BROADCAST), sized_broadcast(bad.withColumnRenamed("_bad", "_e_bad"), MOST_BROADCAST)
    rows = rows.withColumns(hexed).join(own, F.col("bucket") == F.col("_bad"), "left").join(edited, F.col("e_bucket") == F.col("_e_bad"), "left")
    return rows.select("doc_id", "n_chars", F.col("edited_sha").alias("edited_sha256"), _name("bucket", "sha").alias("fingerprint"), _name("e_bucket", "e_sha", "_e_bad").alias("edited_fingerprint"), "near_edited", "near_next")


def collided(spark: SparkSession, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Buckets (binary) of rows (bucket, sha, e_bucket, e_sha) that hold different texts: documents' by their bytes, and edited texts', whose bytes are not kept, by their SHA-256."""
    both = rows.select("bucket", "sha", F.lit(1).alias("n")).union(rows.select("e_bucket", "e_sha", F.lit(0)))
    met = both.groupBy("bucket").agg(F.sum("n").alias("n"), F.min("sha").alias("least"), F.max("sha").alias("most")).filter("n > 1 or least <> most")
    met = written(spark, met.select("bucket", "n", (F.col("least") != F.col("most")).alias("differ")), "repeated-buckets")
    by_bytes = collisions(spark, docs, met.filter("n > 1").select(F.lower(F.hex("bucket")).alias("bucket")))
    return by_bytes.select(F.unhex("bucket").alias("bucket")).union(met.filter("differ").select("bucket")).distinct()
