"""Mixing sources to target weights by a multivariate hypergeometric splitting tree.

Each source's documents stand in the order of a seeded hash of id and text, cut into blocks by the hash's leading part. A
source's quota is its number of block draws: every block once for each full pass that its target holds, then the leading
blocks of the order, the last of them in part. A tree over the output shards splits the quotas exactly: a node hands half
of its draws to either side, and which sources these come from is one multivariate hypergeometric draw. So each shard has
disjoint runs of permuted blocks of every source; within a shard rows are ordered by another hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fpsample.llm.common import boxed, unboxed, written

#: Weights by rank of the source, repeating; words of the mix by words of the input; most copies of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Documents a block has about, and most blocks a source has: beyond these, blocks grow with the source.
BLOCK_DOCS, MOST_BLOCKS = 256, 4096
#: Most sources of a mixture: the quotas and the tree are held by the driver.
MOST_SOURCES = 100_000
_WORD = r"[^ \x09-\x0D]+"


@dataclass
class Quota:
    """What the driver knows of a source."""

    source: str | None
    docs: int
    words: int
    blocks: int
    target: float = 0.0
    passes: int = 0
    rest: float = 0.0


def targets(words: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words that each source gives: ``share`` of all, by weight, none above ``most`` times its own, the excess shared anew among the others by weight."""
    out = [0.0] * len(words)
    open_ = [i for i, w in enumerate(words) if w > 0]
    left = share * sum(words)
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        full = [i for i in open_ if left * weights[i % len(weights)] / total > most * words[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i % len(weights)] / total
            break
        for i in full:
            out[i] = float(most * words[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """(sources, shards) draws: each source's row sums to its quota, shards' totals differ by one at most; reruns agree. Quotas of 10**9 draws or more in all raise ValueError."""
    out = np.zeros((len(quotas), shards), np.int64)

    def node(q: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = q
            return
        mid = (lo + hi) // 2
        total = int(q.sum())
        # the left side's shards get their part of the total, one more each for the first shards of a remainder
        even, over = divmod(total, hi - lo)
        n = even * (mid - lo) + min(over, mid - lo)
        rng = np.random.Generator(np.random.Philox(key=[seed, lo * 2**32 + hi]))
        left = rng.multivariate_hypergeometric(q, n, method="marginals")  # good for 10**9 draws; MOST_SOURCES, MOST and MOST_BLOCKS keep below
        node(left, lo, mid)
        node(q - left, mid, hi)

    if shards and len(quotas):
        node(np.asarray(quotas, np.int64), 0, shards)
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, shards: int = 8, seed: int = 17) -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target``, ``copies`` (0, 1 or 2) and ``shards`` (one for each copy), besides all its columns.

    Sources rank by code point, null last as a source of its own. A document is taken whole or not at all in each pass, so a
    source's words miss its target by half a document at most. Null or empty texts have size 0 and are taken with their
    block. Ids may be null or repeated: rows are ordered by id and text, and rows alike in both by their place in the input,
    which has to be read alike twice (as a table is). An empty table gives an empty result. Input columns named like results
    are replaced. Counts cover all rows; the driver holds one row a source (MOST_SOURCES at most, else ValueError) and no row
    of the data is moved to decide on it.
    """
    added = ("size", "source_size", "target", "copies", "shards")
    body, names = boxed(docs, added)
    source = f"_{names.index('source')}"
    u, key = F.xxhash64("doc_id", "text", F.lit(seed)), F.xxhash64("text", F.lit(seed), "doc_id")  # rows alike in id and text are alike in both
    body = body.withColumns({"_place": F.monotonically_increasing_id(), "_size": F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({_WORD})"))).cast("long"), "_u": u, "_key": key})
    slim = written(spark, body.select(F.col(source).alias("source"), "_size", "_u", "_key", "_place"), "mix-sizes")

    per = slim.groupBy("source").agg(F.count("*").alias("docs"), F.sum("_size").alias("words"))
    found = per.orderBy(F.col("source").isNull(), "source").limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    qs = [Quota(r.source, r.docs, r.words, min(MOST_BLOCKS, -(-r.docs // BLOCK_DOCS))) for r in found]
    qs.sort(key=lambda q: (q.source is None, q.source or ""))
    for q, t in zip(qs, targets([q.words for q in qs], weights, share), strict=True):
        q.target = t
        q.passes = min(MOST, int(t // q.words)) if q.words else 0
        q.rest = t - q.passes * q.words if q.passes < MOST else 0.0

    def block(u: Column, blocks: Column) -> Column:  # the hash's leading 31 bits, cut into equal ranges: rises with the hash
        return F.floor((F.shiftrightunsigned(u.bitwiseXOR(F.lit(-(2**63))), 33) * blocks) / F.lit(float(2**31))).cast("int")

    plan = F.broadcast(_frame(spark, [(q.source, q.blocks, q.rest) for q in qs], "source string, blocks int, rest double"))
    dealt = slim.join(plan, slim["source"].eqNullSafe(plan["source"])).select(slim["source"], "_size", "_u", "_key", "_place", "rest", block(F.col("_u"), F.col("blocks")).alias("block"))
    # Two-level running sum: over at most MOST_BLOCKS totals of a source, then over the documents of the one block where the rest ends.
    totals = dealt.groupBy("source", "block", "rest").agg(F.sum("_size").alias("words"))
    run = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumn("upto", F.sum("words").over(run))
    ends = totals.filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest"))).groupBy("source").agg(F.min_by(F.struct("block", (F.col("upto") - F.col("words")).alias("before")), "block").alias("end"))
    ends_at = {r.source: (r.end.block, r.end.before) for r in ends.collect()}
    edge = F.broadcast(_frame(spark, [(s, b, before) for s, (b, before) in ends_at.items()], "source string, block int, before long"))
    last = dealt.join(edge, dealt["source"].eqNullSafe(edge["source"]) & (dealt["block"] == edge["block"]))
    # Rows alike count as one with a number, so that no run of them meets in the window; the one where the rest ends is taken in part.
    last = last.groupBy(dealt["source"], "_u", "_key", "_size", "rest", "before").agg(F.count("*").alias("n"))
    within = Window.partitionBy("source").orderBy("_u", "_key").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("from", F.col("before") + F.sum(F.col("_size") * F.col("n")).over(within) - F.col("_size") * F.col("n"))
    fits = F.when(F.col("_size") == 0, F.when(F.col("from") <= F.col("rest"), F.col("n")).otherwise(0)).otherwise(F.least(F.col("n"), F.floor((F.col("rest") - F.col("from")) / F.col("_size") + 0.5)))
    last = last.withColumn("fits", fits.cast("long")).filter("fits > 0")
    cuts = last.groupBy("source").agg(F.max(F.struct("_u", "_key", "n", "fits")).alias("cut")).select("source", "cut.*").collect()
    cut = {r.source: (r._u, r._key, 2**63 - 1) for r in cuts}
    if parts := [(r.source, r._u, r._key, r.fits) for r in cuts if r.fits < r.n]:
        cut |= {r.source: (r._u, r._key, r.place) for r in _places(slim, F.broadcast(_frame(spark, parts, "of string, cut_u long, cut_key long, fits long"))).collect()}

    quotas = []
    for q in qs:
        end = ends_at.get(q.source, (-1, 0))[0] if q.rest > 0 else -1
        quotas.append(q.passes * q.blocks + end + 1)
    tree = split_quotas(quotas, shards, seed)
    rows = []
    for q, dealt_to in zip(qs, tree, strict=True):
        end = ends_at.get(q.source, (-1, 0))[0] if q.rest > 0 else -1
        cut_u, cut_key, place = cut.get(q.source, (-(2**63), -(2**63), -1))
        rows.append((q.source, q.words, q.target, q.blocks, q.passes, end, cut_u, cut_key, place, [int(x) for x in np.cumsum(dealt_to)]))
    rule = F.broadcast(_frame(spark, rows, "source string, source_size long, target double, blocks int, passes int, end int, cut_u long, cut_key long, cut_place long, edges array<long>"))
    out = body.join(rule, body[source].eqNullSafe(rule["source"]), "left").withColumn("_block", block(F.col("_u"), F.col("blocks")))
    before_cut = F.struct("_u", "_key", "_place") <= F.struct("cut_u", "cut_key", "cut_place")
    extra = (F.col("_block") < F.col("end")) | ((F.col("_block") == F.col("end")) & before_cut)
    out = out.withColumn("_copies", F.col("passes") + extra.cast("int"))
    draw = lambda c: F.size(F.filter("edges", lambda e: e <= c * F.col("blocks") + F.col("_block")))
    shard = F.transform(F.slice(F.array(*[F.lit(i) for i in range(MOST)]), F.lit(1), F.col("_copies")), draw)
    return unboxed(out, names, {"size": F.col("_size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": F.col("_copies"), "shards": shard})


def _places(slim: DataFrame, cuts: DataFrame) -> DataFrame:
    """(source, _u, _key, place) of each cut: the place of the last row taken out of rows alike. A place's high bits number its partition, so partitions are counted first, and only one partition's rows meet in a window."""
    alike = slim.join(cuts, slim["source"].eqNullSafe(F.col("of")) & (F.col("_u") == F.col("cut_u")) & (F.col("_key") == F.col("cut_key")))
    alike = alike.select("source", "_u", "_key", "_place", "fits", F.shiftright("_place", 33).alias("part"))
    run = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    counts = alike.groupBy("source", "fits", "part").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(run))
    ends = counts.filter((F.col("upto") >= F.col("fits")) & (F.col("upto") - F.col("n") < F.col("fits"))).select(F.col("source").alias("of"), F.col("part").alias("end_part"), (F.col("fits") - F.col("upto") + F.col("n")).alias("nth"))
    within = alike.join(F.broadcast(ends), alike["source"].eqNullSafe(F.col("of")) & (F.col("part") == F.col("end_part")))
    ranked = within.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("_place")))
    return ranked.filter(F.col("rank") == F.col("nth")).select("source", "_u", "_key", F.col("_place").alias("place"))


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def mixed_rows(mixed: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: one row a copy with its ``shard`` and ``order_key``, the place within the shard; write it by ``repartitionByRange("shard", "order_key")`` and sort within partitions, or read it in this order."""
    out = mixed.select(*[F.col(f"`{c}`") for c in mixed.columns if c not in ("shards", "copies")], F.posexplode("shards").alias("copy", "shard"))
    return out.withColumn("order_key", F.xxhash64(F.lit(seed), "shard", "doc_id", "text", "copy"))
