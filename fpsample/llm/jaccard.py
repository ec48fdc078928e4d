"""N-gram Jaccard join by vertical partitioning.

The global order of shingles is that of their 64-bit hashes, cut into fragments of equal ranges. Documents whose Jaccard
similarity is high agree on whole fragments: sets that differ in D shingles agree on all but D of the fragments that either
fills. So candidates come from equal fragments, and candidates' overlaps are counted fragment by fragment and summed per pair.

1. Equal sets are one class; only classes are compared.
2. A class signs its fragments, as many as its size band needs. Signatures that no other row has cannot be shared: a class
   with fewer repeated ones than a link needs is linked with nothing, and the others give out a prefix of theirs.
3. A signature shared by several classes makes a group, and the class that shares most is the group's representative. Each
   member is compared with it, not with every other one: partial overlaps by fragment, summed per pair.
4. Two members of which one is not linked to the representative can only be linked if their differences from it coincide.
   Differences that only one member has cannot; what is left gives bounds on the partners a member may have, and members
   with possible partners are joined by prefixes, rare differences first, as those that most of a family have in common tell
   nothing. Parity bits of the differences bound what two members share. Overlaps too are counted by fragment and summed.
   Members that links with representatives connect already do not meet.
5. Components of the links found are exact: a link left out has its ends connected by links with representatives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fpsample.llm.common import prepare, row_key, spread_join, written
from fpsample.llm.shingles import mix, shingle_hashes

#: Keys of repeated texts that are broadcast at most (some 12 MB); beyond these, repeated texts sign as well, with the same result.
MOST_BROADCAST = 300_000
#: Fragments by which overlaps are counted.
VERTICAL = 8
#: Size bands grow by this; fragments besides those the bound needs.
BAND, SPARE = 1.5, 2
#: Tokens that a task gathers before it gives them out, and tokens of one bucket, about.
GATHERED, BUCKET = 1 << 21, 1 << 21
#: Bits of a map of tokens, 32 MB at most, and of one block of it.
MOST_BITS, BLOCK_BITS = 28, 20
#: Bits of the slots of a table of counts, 32 MB at most.
MOST_SLOTS = 25
#: Longs of parity bits of a member's differences.
PARITY = 4


class Shingler:
    """Sorted distinct shingle hashes of one text: A-Z in lower case, words between blanks and 0x09-0x0D, ``width`` words; all of a text's words where it has fewer."""

    def __init__(self, width: int = 3):
        self.width = width

    def __call__(self, text: str | None) -> np.ndarray:
        return shingle_hashes(pa.array([text], pa.string()), self.width)[0]


class Bands:
    """Sizes in bands, and what a similarity of ``percent`` in a hundred allows within them."""

    def __init__(self, percent: int = 90):
        if not 50 < percent < 100:
            raise ValueError("percent must lie between 50 and 100")
        self.percent = percent
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * BAND)))

    def differences(self, size: int) -> int:
        """Most shingles in one but not both of two linked sets the smaller of which has ``size``: union - overlap, with overlap <= size and 100 overlap >= percent union."""
        return size * (100 - self.percent) // self.percent

    def levels(self, size: int) -> list[int]:
        """The bands at which a set of this size signs: its own, and all above where a set may be linked with it."""
        own = int(np.searchsorted(self.edges, size, "right")) - 1
        last = own
        while 100 * size >= self.percent * self.edges[last + 1]:
            last += 1
        return list(range(own, last + 1))

    def fragments(self, level: int) -> int:
        """Fragments at a level: more than any pair there can differ in, and some to spare, so that few sets have to sign empty ones."""
        most = self.differences(self.edges[level + 1] - 1)
        return most + 1 + SPARE + most // 20


def levelled(hashes: np.ndarray, bands: Bands) -> list[tuple[np.ndarray, int]]:
    """For each level of a set its signatures, and how many of them any linked set signs as well.

    There is one signature for each filled fragment, of its level, place and shingles. Of these, linked sets share all but
    D. A set that fills D fragments or fewer may share none; it signs its empty fragments too. Two linked sets agree on
    F - D fragments or more, F > D; if all of these are empty, either set's filled fragments all differ, so both are such sets
    and share an empty one. If only one of them is, the other fills more than D, so they share a filled one.
    """
    n = len(hashes)
    most = bands.differences(n)
    if n == 0 or most == 0:
        return []  # linked with equal sets alone
    out = []
    mixed = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    high = hashes >> np.uint64(32)
    for level in bands.levels(n):
        f = bands.fragments(level)
        place = (high * np.uint64(f)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        at = place[first]
        base = np.uint64(level << 40)
        sigs = mix(np.add.reduceat(mixed, first) + mix(at + base))
        need = len(at) - most
        if need <= 0:
            empty = np.setdiff1d(np.arange(f, dtype=np.uint64), at)
            sigs, need = np.concatenate([sigs, mix(mix(empty + base) ^ np.uint64(0x2545F4914F6CDD1D))]), 1
        out.append((sigs, need))
    return out


def signatures(hashes: np.ndarray, bands: Bands) -> np.ndarray:
    """A set's signatures of all levels."""
    return np.concatenate([np.empty(0, np.uint64), *(s for s, _ in levelled(hashes, bands))])


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _sid(digest: bytes) -> int:
    """The short name of a set, by which candidates are known: 64 bits."""
    return int.from_bytes(digest[:8], "big", signed=True)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shingle_hashes(b.column("text"), width)
            keys = [_digest(h) if len(h) else None for h in found]
            rest = [c for c in b.schema.names if c != "text"]
            made = [pa.array([len(h) for h in found], pa.int64()), pa.array(keys, pa.binary()), pa.array([k and _sid(k) for k in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *made], [*rest, "n", "set", "sid"])

    return run


# -- tokens that occur more than once -------------------------------------------------------------------
Tokens = Callable[[pa.RecordBatch], np.ndarray]


def _pack(tokens: Tokens, buckets: int):
    """A task's tokens as sorted arrays by their leading ``buckets`` bits, of each the next 32 bits: each once, or twice if it is there more often, so that a hot one costs a task eight bytes."""

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        every = np.repeat(found, np.minimum(n, 2))
        bucket = every >> np.uint64(64 - buckets)
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        low = (every >> np.uint64(32 - buckets)).astype(np.uint32)
        parts = [x.tobytes() for x in np.split(low, cut[1:])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int64)), pa.array(parts, pa.binary())], ["bucket", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            held.append(tokens(b))
            size += len(held[-1])
            if size > GATHERED:
                yield out(held)
                held, size = [], 0
        if size:
            yield out(held)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens that are in a bucket's arrays more than once; buckets come one after the other."""

    def out(bucket: int, held: list[bytes]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in held]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found[n > 1].astype(np.int64) | np.int64(bucket << 32))], ["token"])

    now, held = None, []
    for b in batches:
        for bucket, x in zip(b.column("bucket").to_pylist(), b.column("tokens").to_pylist(), strict=True):
            if bucket != now and held:
                yield out(now, held)
                held = []
            now = bucket
            held.append(x)
    if held:
        yield out(now, held)


def _probes(tokens: np.ndarray, bits: int, probes: int) -> list[np.ndarray]:
    """Where a map has a token's marks."""
    return [mix(tokens + np.uint64(i) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits) for i in range(probes)]


def _marks(bits: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = np.concatenate(_probes(b.column("token").to_numpy(zero_copy_only=False).view(np.uint64), bits, probes))
            yield pa.RecordBatch.from_arrays([pa.array((marks >> np.uint64(BLOCK_BITS)).astype(np.int32)), pa.array((marks & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int32))], ["block", "mark"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: dict[int, np.ndarray] = {}
    for b in batches:
        block, mark = (b.column(c).to_numpy(zero_copy_only=False) for c in ("block", "mark"))
        for k in np.unique(block).tolist():
            blocks.setdefault(k, np.zeros(1 << BLOCK_BITS, bool))[mark[block == k]] = True
    packed = [(k, np.packbits(v).tobytes()) for k, v in blocks.items()]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in packed], pa.int32()), pa.array([v for _, v in packed], pa.binary())], ["block", "bits"])


class BitMap:
    """A Bloom filter of tokens in every task: at most 2**MOST_BITS bits, 32 MB, however many tokens there are. It lets through all of them and, by chance, a few others (the more, the fuller it is), which exact steps drop later.

    ``width``: the leading bits of a token that it goes by. ``tokens`` has them as the low bits of ``token``.
    """

    def __init__(self, spark: SparkSession, tokens: DataFrame, width: int = 64):
        n = tokens.count()
        self.width, self.bits = width, min(MOST_BITS, max(BLOCK_BITS, (16 * n).bit_length()))
        self.probes = max(1, min(4, round(0.69 * (1 << self.bits) / max(n, 1))))
        found = tokens.select("token").mapInArrow(_marks(self.bits, self.probes), "block int, mark int").repartition("block").mapInArrow(_blocks, "block int, bits binary").collect()
        table = np.zeros(1 << (self.bits - 3), np.uint8)
        for r in found:
            table[r.block << (BLOCK_BITS - 3) : (r.block + 1) << (BLOCK_BITS - 3)] |= np.frombuffer(r.bits, np.uint8)
        self.sent = spark.sparkContext.broadcast(table)

    def holds(self, tokens: np.ndarray) -> np.ndarray:
        table, out = self.sent.value, np.ones(len(tokens), bool)
        for at in _probes(tokens >> np.uint64(64 - self.width), self.bits, self.probes):
            out &= (table[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1
        return out


def repeated_tokens(spark: SparkSession, df: DataFrame, tokens: Tokens, total: int) -> BitMap:
    """A map of the tokens that ``tokens`` finds in df's batches more than once. ``total``: how many there are, about; each task of the count holds a bucket of some BUCKET tokens at a time."""
    buckets = min(28, max(5, (total // BUCKET).bit_length()))
    packed = df.mapInArrow(_pack(tokens, buckets), "bucket long, tokens binary").repartition("bucket").sortWithinPartitions("bucket")
    return BitMap(spark, written(spark, packed.mapInArrow(_repeated, "token long"), "jaccard-repeated"), buckets + 32)


def _slot_counts(tokens: Tokens, bits: int):
    """How many of a task's tokens fall into each slot: by block, the slots and their counts."""

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        slots, n = np.unique(np.concatenate(held) >> np.uint64(64 - bits), return_counts=True)
        block = slots >> np.uint64(BLOCK_BITS)
        cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        low = (slots & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint32)
        lists = [[x.tobytes() for x in np.split(v, cut[1:])] for v in (low, n.astype(np.uint32))]
        return pa.RecordBatch.from_arrays([pa.array(block[cut].astype(np.int32)), *(pa.array(v, pa.binary()) for v in lists)], ["block", "slots", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            held.append(tokens(b))
            size += len(held[-1])
            if size > GATHERED:
                yield out(held)
                held, size = [], 0
        if size:
            yield out(held)

    return run


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block eight times the logarithms of its slots' counts, a byte each; blocks come one after the other."""

    def out(block: int, counts: np.ndarray) -> pa.RecordBatch:
        ranks = np.minimum(255, np.round(8 * np.log2(1 + counts))).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([ranks.tobytes()], pa.binary())], ["block", "ranks"])

    now, counts = None, np.empty(0, np.int64)
    for b in batches:
        for block, slots, n in zip(*(b.column(c).to_pylist() for c in ("block", "slots", "counts")), strict=True):
            if block != now:
                if now is not None:
                    yield out(now, counts)
                now, counts = block, np.zeros(1 << BLOCK_BITS, np.int64)
            counts[np.frombuffer(slots, np.uint32)] += np.frombuffer(n, np.uint32)
    if now is not None:
        yield out(now, counts)


class Rarity:
    """Ranks of the tokens of df's batches, the rarer the lower, in every task: a table of at most 2**MOST_SLOTS slots, a byte each. Tokens that share a slot are counted together and have one rank: any order that all tasks have in common is right, only less selective. ``total``: how many tokens there are, about."""

    def __init__(self, spark: SparkSession, df: DataFrame, tokens: Tokens, total: int):
        self.bits = min(MOST_SLOTS, max(BLOCK_BITS, (2 * total).bit_length()))
        counted = df.mapInArrow(_slot_counts(tokens, self.bits), "block int, slots binary, counts binary").repartition("block").sortWithinPartitions("block")
        table = np.zeros(1 << self.bits, np.uint8)
        for r in counted.mapInArrow(_ranks, "block int, ranks binary").collect():
            table[r.block << BLOCK_BITS : (r.block + 1) << BLOCK_BITS] = np.frombuffer(r.ranks, np.uint8)
        self.sent = spark.sparkContext.broadcast(table)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        return self.sent.value[(tokens >> np.uint64(64 - self.bits)).astype(np.int64)]


# -- candidates -----------------------------------------------------------------------------------------
def _all_signatures(width: int, bands: Bands) -> Tokens:
    return lambda b: np.concatenate([np.empty(0, np.uint64), *(signatures(h, bands) for h in shingle_hashes(b.column("text"), width))])


def _shared_signatures(width: int, bands: Bands, known: BitMap):
    """(x, sig) rows: of the sets that share enough signatures at a level, the least of those that may be shared, so many that any linked set shares one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, lists = [], [np.empty(0, np.uint64)]
            for h in shingle_hashes(b.column("text"), width):
                for sigs, need in levelled(h, bands):
                    hit = sigs[known.holds(sigs)]
                    if len(hit) >= need:
                        lists.append(np.sort(hit)[: len(hit) - need + 1])
                        names.append(np.full(len(lists[-1]), _sid(_digest(h)), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *names])), pa.array(np.concatenate(lists).view(np.int64))], ["x", "sig"])

    return run


def _star_pairs(spark: SparkSession, signed: DataFrame) -> DataFrame:
    """(x, r) of signed (x, sig): each set with the representatives of the groups it is in."""
    groups = signed.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1").select("sig", "n", F.col("n").alias("others"))
    groups = written(spark, groups, "jaccard-groups")
    held = written(spark, spread_join(signed, groups, "sig", "n", F.col("x")).filter("others is not null"), "jaccard-members")
    weight = held.groupBy("x").agg(F.sum("others").alias("weight"))
    best = held.join(weight, "x").groupBy("sig").agg(F.count("*").alias("n"), F.min_by("x", F.struct(-F.col("weight"), F.col("x"))).alias("r"))
    best = written(spark, best, "jaccard-representatives")
    pairs = spread_join(held.select("x", "sig"), best, "sig", "n", F.col("x")).filter("x <> r").select("x", "r").distinct()
    return written(spark, pairs, "jaccard-pairs")


def fragments(width: int, wanted: BitMap):
    """(sid, fragment, hashes) rows of the texts whose sets are wanted, VERTICAL a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(i << 64) // VERTICAL for i in range(1, VERTICAL)], np.uint64)
        for b in batches:
            found = [h for h in shingle_hashes(b.column("text"), width) if len(h)]
            sids = np.array([_sid(_digest(h)) for h in found], np.int64)
            chosen = np.flatnonzero(wanted.holds(sids.view(np.uint64))).tolist()
            sizes = [np.diff([0, *np.searchsorted(found[i], edges), len(found[i])]) for i in chosen]
            ends = np.concatenate([[0], *sizes]).cumsum()
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *(found[i] for i in chosen)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sids[chosen], VERTICAL)), pa.array(np.tile(np.arange(VERTICAL, dtype=np.int32), len(chosen))), lists], ["sid", "fragment", "hashes"])

    return run


# -- overlaps -------------------------------------------------------------------------------------------
def _overlaps(spark: SparkSession, pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """(x, r, fragment, nx, nr, added, missing) of each pair and fragment: shingles of x that r lacks, and the other way round."""
    place = F.struct("r", "fragment").alias("place")
    own = pairs.join(parts, pairs["x"] == parts["sid"]).select("x", place, F.col("hashes").alias("hx"))
    theirs = pairs.groupBy("r").agg(F.count("*").alias("n")).join(parts, F.col("r") == parts["sid"]).select(place, "n", F.col("hashes").alias("hr"))
    theirs = written(spark, theirs, "jaccard-representative-fragments")
    met = spread_join(own, theirs, "place", "n", F.col("x"))
    sizes = [F.size("hx").alias("nx"), F.size("hr").alias("nr")]
    return met.select("x", "place.r", "place.fragment", *sizes, F.array_except("hx", "hr").alias("added"), F.array_except("hr", "hx").alias("missing"))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values as unsigned numbers, and the row of each."""
    values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return values, np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))


def _difference_tokens(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column of shingles: tokens (one for each shingle and representative), the shingles, and the row of each."""
    values, rows = _flat(b.column(name))
    families = mix(b.column("r").to_numpy(zero_copy_only=False).view(np.uint64))
    return mix(values ^ families[rows]), values, rows


def _both_tokens(b: pa.RecordBatch) -> np.ndarray:
    return np.concatenate([_difference_tokens(b, name)[0] for name in ("added", "missing")])


def _only_repeated(known: BitMap):
    """added and missing without the shingles by which no other member of the family differs from r; n_delta: how many there were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_delta, lists = np.zeros(b.num_rows, np.int64), []
            for name in ("added", "missing"):
                tokens, values, rows = _difference_tokens(b, name)
                kept = known.holds(tokens)
                n_delta += np.bincount(rows, minlength=b.num_rows)
                ends = np.concatenate([[0], np.bincount(rows[kept], minlength=b.num_rows).cumsum()])
                lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[kept].view(np.int64))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("x", "r", "fragment", "nx", "nr")), pa.array(n_delta), *lists], ["x", "r", "fragment", "nx", "nr", "n_delta", "added", "missing"])

    return run


def _own_tokens(b: pa.RecordBatch) -> np.ndarray:
    return _difference_tokens(b, "own")[0]


def _prefixes(rarity: Rarity):
    """The first ``take`` tokens of each pair's ``own`` shingles, the rarest first, and parity bits of all of them: p0, p1... hold, for each of 64 * PARITY classes of tokens, whether their number is odd."""
    fixed = ["x", "r", "home", "d", "b", "e", "seeks", "gives"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, _, rows = _difference_tokens(b, "own")
            parity = np.zeros((b.num_rows, PARITY), np.uint64)
            np.bitwise_xor.at(parity, (rows, ((tokens >> np.uint64(6)) % np.uint64(PARITY)).astype(np.int64)), np.uint64(1) << (tokens & np.uint64(63)))
            order = np.lexsort((tokens, rarity.of(tokens), rows))
            tokens, rows = tokens[order], rows[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(b.num_rows))[rows]
            first = place < b.column("take").to_numpy(zero_copy_only=False)[rows]
            at = pa.array(rows[first])
            bits = [pa.array(parity[rows[first], i].view(np.int64)) for i in range(PARITY)]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in fixed), pa.array(tokens[first].view(np.int64)), pa.array(place[first].astype(np.int64)), *bits], [*fixed, "token", "at", *(f"p{i}" for i in range(PARITY))])

    return run


def _meetings(tokens: DataFrame, p: int) -> DataFrame:
    """Pairs of a seeker (s) and a giver (g) of different homes that meet in a token of a family, as long as what is left of either from there on and the parity bits let them be linked: tokens of an odd class of one alone are not in common, so 2 c <= d_x + d_y - odd."""
    names = ["x", "r", "home", "d", "b", "e", "token", "at", *(f"p{i}" for i in range(PARITY))]
    s, g = (tokens.filter(F.col("at") < F.col(role)).select(*[F.col(c).alias(f"{side}_{c}") for c in names]) for side, role in (("s", "seeks"), ("g", "gives")))
    need = F.col("s_b") + F.col("g_b")
    odd = sum((F.bit_count(F.col(f"s_p{i}").bitwiseXOR(F.col(f"g_p{i}"))) for i in range(PARITY)), F.lit(0))
    may = (F.col("s_b") <= F.col("g_e")) & (F.col("g_b") <= F.col("s_e")) & (2 * p * F.least(F.col("s_d") - F.col("s_at"), F.col("g_d") - F.col("g_at")) >= need) & (p * (F.col("s_d") + F.col("g_d") - odd) >= need)
    return s.join(g, (F.col("s_token") == F.col("g_token")) & (F.col("s_r") == F.col("g_r")) & (F.col("s_home") != F.col("g_home")) & may)


def _member_links(spark: SparkSession, kept: DataFrame, stats: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the homes (components of the links with representatives) of members of one family that have different ones; so at least one member is not linked with the representative.

    x and y differ in u_x + u_y + d_x + d_y - 2c shingles: u differences from r that no other member has, d others, c of
    these in common. They are linked if that is at most (nx + ny) q / p, p = 100 + percent and q = 100 - percent. With
    a = q n - p u, b = p d - a and e = p d + a: if 2 p c >= b_x + b_y, where c is d_x or d_y at most, so b_x <= e_y and
    b_y <= e_x. And x is not linked with r if b_x > q nr; then c has to be 1 at least. Seekers are not linked with r and may
    have a partner by these bounds, givers may be one. Either gives out as many tokens as let it share one with any partner,
    the rarest of those that the searching members have.
    """
    p, q = 100 + percent, 100 - percent
    a = q * F.col("nx") - p * (F.col("n_delta") - F.col("d"))
    stats = stats.select("x", "r", "home", "d", "linked", (p * F.col("d") - a).alias("b"), (p * F.col("d") + a).alias("e"))
    stats = written(spark, stats, "jaccard-differences")
    first = stats.groupBy("r").agg(F.count("*").alias("n"), F.max("e").alias("most"), F.min(F.when(~F.col("linked"), F.col("b"))).alias("least")).filter("n > 1 and least is not null")
    chosen = spread_join(stats, written(spark, first, "jaccard-families"), "r", "n", F.col("x")).filter("least is not null")
    chosen = chosen.withColumns({"seeks": ~F.col("linked") & (F.col("b") <= F.col("most")), "gives": F.col("e") >= F.col("least")}).filter("seeks or gives")
    chosen = written(spark, chosen.drop("most", "least", "linked"), "jaccard-searching")
    bounds = chosen.groupBy("r").agg(F.count("*").alias("n"), F.min(F.when(F.col("seeks"), F.col("b"))).alias("seeking"), F.min(F.when(F.col("gives"), F.col("b"))).alias("giving")).filter("seeking is not null and giving is not null")
    chosen = spread_join(chosen, written(spark, bounds, "jaccard-bounds"), "r", "n", F.col("x")).filter("seeking is not null")
    take = lambda role, other: F.when(F.col(role), F.greatest(F.lit(0), F.col("d") + 1 - F.greatest(F.lit(1), F.ceil((F.col("b") + F.col(other)) / (2 * p))))).otherwise(0).cast("int")
    chosen = chosen.select("x", "r", "home", "d", "b", "e", take("seeks", "giving").alias("seeks"), take("gives", "seeking").alias("gives")).filter("seeks > 0 or gives > 0")
    chosen = chosen.withColumn("take", F.greatest("seeks", "gives"))
    chosen = written(spark, chosen, "jaccard-seekers")
    own = kept.select("x", "r", F.concat("added", "missing").alias("own")).join(chosen, ["x", "r"]).groupBy(*chosen.columns).agg(F.flatten(F.collect_list("own")).alias("own"))
    own = written(spark, own, "jaccard-searched-differences")
    rarity = Rarity(spark, own, _own_tokens, chosen.agg(F.sum("d")).first()[0] or 0)
    bits = "".join(f", p{i} long" for i in range(PARITY))
    tokens = own.mapInArrow(_prefixes(rarity), "x long, r long, home long, d long, b long, e long, seeks int, gives int, token long, at long" + bits)
    met = _meetings(written(spark, tokens, "jaccard-prefixes"), p)
    pairs = met.groupBy(F.least("s_x", "g_x").alias("a"), F.greatest("s_x", "g_x").alias("b")).agg(F.min(F.struct(F.col("s_r").alias("r"), (F.col("s_b") + F.col("g_b")).alias("need"), F.least("s_home", "g_home").alias("one"), F.greatest("s_home", "g_home").alias("other"))).alias("v"))
    pairs = written(spark, pairs.select("a", "b", "v.*"), "jaccard-member-pairs")
    side = lambda s: kept.select("r", "fragment", F.col("x").alias(s), F.col("added").alias(f"added_{s}"), F.col("missing").alias(f"missing_{s}"))
    both = pairs.join(side("a"), ["r", "a"]).join(side("b"), ["r", "b", "fragment"])
    common = F.size(F.array_intersect("added_a", "added_b")) + F.size(F.array_intersect("missing_a", "missing_b"))
    linked = both.groupBy("a", "b", "need", "one", "other").agg(F.sum(common).alias("c")).filter(2 * p * F.col("c") >= F.col("need"))
    return linked.select(F.col("one").alias("a"), F.col("other").alias("b")).distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of edges (a, b): root is the least vertex of its component. Large-star and small-star steps in turn until nothing changes; each step's edges are written to the shared folder, and vertices of many edges are spread."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        way = F.col("a") > F.col("b")
        near = e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        near = near if large else e.select(F.when(way, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(way, F.col("b")).otherwise(F.col("a")).alias("v"))
        least = written(spark, near.groupBy("u").agg(F.count("*").alias("n"), F.least(F.min("v"), F.first("u")).alias("m")), "star-minima")
        joined = spread_join(near, least, "u", "n", F.col("v"))
        if large:
            out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            pairs = F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))
            out = joined.select(F.explode(pairs).alias("e")).select("e.*")
        return written(spark, out.filter("a <> b").distinct(), "star-edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = written(spark, edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star-edges")
    old, new = None, state(e)
    while old != new:
        e = star(star(e, True), False)
        old, new = new, state(e)
    return e.select(F.col("a").alias("v"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b"))).distinct()


def similar_groups(spark: SparkSession, docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, text_hash, n_shingles, class_id, component_id, group_id) of each row of docs (doc_id, text).

    Two documents are linked when 100 * overlap >= percent * union of their sets of ``width``-word shingles; component_id is
    the least doc_id reachable by links, class_id the least doc_id of an equal set. Exact but for collisions of 64-bit
    hashes of shingles inside one pair, and of sets that have candidates. Documents without words have no shingles, are linked
    with nothing and are their own component. Repeated rows and ids are told apart by text; a null id counts for nothing in
    a minimum, and a component of nulls alone has null; group_id names the component itself (null without words). Very long
    texts are read whole, in blocks. Other columns are not carried, whatever their names; an empty table gives an empty result.
    """
    prepare(spark)
    bands = Bands(percent)
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumns(row_key())
    key = ["_no_id", "_id", "_text_hash"]
    rows = body.mapInArrow(_sets(width), "doc_id long, _no_id boolean, _id long, _text_hash long, n long, set binary, sid long")
    rows = written(spark, rows, "jaccard-sets")
    classes = rows.filter("n > 0").groupBy("set").agg(F.count("*").alias("copies"), F.min("doc_id").alias("class_id"), F.min(F.struct(*key)).alias("row"), F.first("sid").alias("sid"), F.first("n").alias("n"))
    classes = written(spark, classes, "jaccard-classes")

    # One row a class signs, the least; rows repeated whole, and beyond MOST_BROADCAST all copies, sign again to no effect.
    found = spread_join(rows.filter("n > 0").select(*key, "set"), classes.filter("copies > 1").select("set", "copies", "row"), "set", "copies", F.struct(*key))
    copies = written(spark, found.filter(F.struct(*key) != F.col("row")).select(*key).distinct(), "jaccard-copies")
    few = copies.count() <= MOST_BROADCAST
    signing = (body.join(F.broadcast(copies), key, "left_anti") if few else body).select("text")
    again = not few or rows.filter("n > 0").join(F.broadcast(copies), key, "left_anti").count() > classes.count()
    total = classes.agg(F.sum("n")).first()[0] or 0
    known = repeated_tokens(spark, signing, _all_signatures(width, bands), total)
    signed = signing.mapInArrow(_shared_signatures(width, bands, known), "x long, sig long")
    pairs = _star_pairs(spark, written(spark, signed.distinct() if again else signed, "jaccard-signatures"))

    # Fragments of the classes in any pair, from one row each; texts are read again but not shuffled.
    involved = written(spark, pairs.select(F.col("x").alias("token")).union(pairs.select("r")).distinct(), "jaccard-involved")
    parts = written(spark, signing.mapInArrow(fragments(width, BitMap(spark, involved)), "sid long, fragment int, hashes array<long>"), "jaccard-fragments")
    parts = parts.dropDuplicates(["sid", "fragment"]) if again else parts
    # Partial overlaps by fragment, then their sums per pair.
    partial = written(spark, _overlaps(spark, pairs, parts), "jaccard-overlaps")
    size = partial.agg(F.sum(F.size("added") + F.size("missing"))).first()[0] or 0
    kept = written(spark, partial.mapInArrow(_only_repeated(repeated_tokens(spark, partial, _both_tokens, size)), "x long, r long, fragment int, nx int, nr int, n_delta long, added array<long>, missing array<long>"), "jaccard-common-differences")
    sums = [F.sum(c).alias(c) for c in ("nx", "nr", "n_delta")]
    stats = kept.groupBy("x", "r").agg(*sums, F.sum(F.size("added") + F.size("missing")).alias("d"))
    stats = written(spark, stats.withColumn("linked", F.col("n_delta") * (100 + percent) <= (F.col("nx") + F.col("nr")) * (100 - percent)), "jaccard-pair-sums")

    # Components of the links with representatives, then of what links these: members of one component need not meet.
    stars = written(spark, components(spark, stats.filter("linked").select(F.col("x").alias("a"), F.col("r").alias("b"))), "jaccard-stars")
    stats = stats.join(stars, F.col("x") == F.col("v"), "left").withColumn("home", F.coalesce("root", "x")).drop("v", "root")
    homes = written(spark, components(spark, _member_links(spark, kept, stats, percent)).select(F.col("v").alias("home"), F.col("root").alias("whole")), "jaccard-homes")
    roots = stars.join(homes, F.col("root") == F.col("home"), "left").select("v", F.coalesce("whole", "root").alias("root"))
    roots = roots.union(homes.join(stars, F.col("home") == F.col("v"), "left_anti").select("home", "whole"))
    root = F.coalesce(F.hex("root"), F.hex("set")).alias("root")
    member = written(spark, classes.select("set", "sid", "copies", "class_id").join(roots, F.col("sid") == F.col("v"), "left").select("set", "copies", "class_id", root), "jaccard-roots")
    smallest = written(spark, member.groupBy("root").agg(F.count("*").alias("n"), F.min("class_id").alias("component_id")), "jaccard-components")
    of_class = written(spark, spread_join(member, smallest, "root", "n", F.col("set")).select("set", "copies", "class_id", "component_id", "root"), "jaccard-class-components")
    out = spread_join(rows.select("doc_id", "_text_hash", "n", "set"), of_class, "set", "copies", F.struct("doc_id", "_text_hash"))
    empty = F.col("n") == 0
    return out.select("doc_id", F.col("_text_hash").alias("text_hash"), F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("root").alias("group_id"))
