"""Media columns: content-defined chunks of stored media, deduplicated by digest, and their reconstruction.

A payload is stored as 8-bit mono PCM in a WAVE file. The file's bytes are cut where a rolling gear hash has its leading
bits zero. Chunks are named by digest; of equal chunks one owner's copy is stored. A medium's row holds the chunks it owns
and the ordered list of all its chunks; what it does not own is joined in, and the whole is verified before use.

Chunks that occur once, nearly all of most corpora, stay in the row of their medium and are never shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fpsample.llm.common import prepare, sized_broadcast, spread_join, written

#: Chunk sizes in bytes: least, most, and the bits that a cut needs to be zero (a cut every 2**BITS bytes).
LEAST, MOST, BITS = 512, 16384, 11
#: Payload bytes that are cut in one go.
BLOCK_BYTES = 4 << 20
#: Rows up to which lists of ids and digests, counted first, are broadcast (some 20 MB); beyond these the joins shuffle.
MOST_BROADCAST = 200_000
_GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8).digest() for b in range(256)), "<u8")


def pad(data: bytes, unit: int = 64) -> bytes:
    """data with zero bytes up to a positive multiple of unit."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def to_wave(payload: bytes, rate: int = 8000) -> bytes:
    """A WAVE file of unsigned 8-bit mono samples: the payload's bytes as they are."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) % 2)


def from_wave(media: bytes) -> bytes:
    """The samples of a WAVE file: its chunks are walked by their declared sizes. Raises ValueError if it isn't 8-bit PCM or is cut short."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, bits = 12, None
    while at + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if at + 8 + n > len(media):
            raise ValueError("a chunk is cut short")
        if name == b"fmt ":
            bits = struct.unpack_from("<H", media, at + 22)[0]
        elif name == b"data":
            if bits != 8:
                raise ValueError(f"{bits} bits a sample")
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, h = 2 h + gear[byte] mod 2**64: the last 64 bytes decide it. By doubling: the hash of 2w bytes is that of the later w plus that of the earlier w moved up by w bits."""
    h = _GEAR[data]
    for w in (1, 2, 4, 8, 16, 32):
        if len(h) > w:
            h = np.concatenate([h[:w], h[w:] + (h[:-w] << np.uint64(w))])
    return h


def cuts(media: bytes) -> list[int]:
    """Ends of the chunks of media: where the hash's leading BITS bits are zero, LEAST bytes after the last cut or later, at MOST bytes at the latest."""
    n = len(media)
    if n <= LEAST:
        return [n] if n else []
    data = np.frombuffer(media, np.uint8)
    parts = []
    for at in range(0, n, BLOCK_BYTES):  # each block is hashed with the 63 bytes before it
        lead = min(at, 63)
        parts.append(np.flatnonzero(gear(data[at - lead : at + BLOCK_BYTES])[lead:] >> np.uint64(64 - BITS) == 0) + at + 1)
    out, last = [], 0
    for c in np.concatenate(parts).tolist():
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST:
            out.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def chunk(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=20).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(i, k, digest(c)) for i, m in zip(b.column("media_id").to_pylist(), _media(b), strict=True) for k, c in enumerate(chunk(m))]
        cols = list(zip(*found, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["media_id", "at", "digest"])


def _media(b: pa.RecordBatch) -> Iterator[bytes]:
    return (to_wave(pad((t or "").encode())) for t in b.column("text").to_pylist())


def _text_bytes(b: pa.RecordBatch) -> pa.Array:
    return pa.array([len((t or "").encode()) for t in b.column("text").to_pylist()], pa.int64())


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the store: a medium's ordered digests, and bytes for the chunks that are not joined in from elsewhere."""
    for b in batches:
        rows = []
        for m, foreign in zip(_media(b), b.column("foreign").to_pylist(), strict=True):
            away = set(foreign or ())
            parts = chunk(m)
            rows.append((hashlib.sha256(m).digest(), len(m), [digest(c) for c in parts], [None if k in away else c for k, c in enumerate(parts)]))
        kinds = [pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary())]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        own = [b.column("media_id"), b.column("doc_id"), _text_bytes(b)]
        yield pa.RecordBatch.from_arrays([*own, *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["media_id", "doc_id", "n_bytes", "media_digest", "media_bytes", "chunk_list", "chunks"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts media together, verifies every joined chunk and the whole, and reads the samples back."""
    for b in batches:
        out: list[tuple] = []
        for want, n, names, chunks, ats, got in zip(*(b.column(c).to_pylist() for c in ("media_digest", "media_bytes", "chunk_list", "chunks", "ats", "joined")), strict=True):
            for at, c in zip(ats or (), got or (), strict=True):
                if digest(c) != names[at]:
                    raise ValueError("a chunk does not have its digest")
                chunks[at] = c
            if None in chunks:
                raise ValueError("a chunk is missing")
            media = b"".join(chunks)
            if len(media) != n or hashlib.sha256(media).digest() != want:
                raise ValueError("a medium does not have its digest")
            payload = from_wave(media)
            out.append((payload, media, features(payload)))
        kinds = [pa.binary(), pa.binary(), pa.string()]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload", "media", "feature"])


def features(payload: bytes) -> str:
    """Loudness features of 8-bit samples about their midpoint: mean, root mean square, peak, crossings of the midpoint a sample."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"mean={x.sum() / len(x):.4f};rms={float(np.sqrt((x * x).sum() / len(x))):.4f};peak={int(np.abs(x).max())};zcr={crossings / len(x):.6f}"


def text_media(docs: DataFrame) -> DataFrame:
    """(media_id, doc_id, text): the media of documents. A medium is named by its id and text, so rows alike in both are one medium stored more than once."""
    return docs.select(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lower(F.hex(F.xxhash64("text"))), F.length("text").cast("string")).alias("media_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def store_media(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Writes the media of documents to the shared folder. Returns the store, a row a medium, and (media_id, at, digest) of the chunks whose bytes are another medium's."""
    media = text_media(docs)
    prepare(spark)
    places = media.select("media_id", "text").mapInArrow(_digests, "media_id string, at int, digest binary")
    owner = F.min(F.struct("media_id", "at")).alias("owner")
    shared = written(spark, places.groupBy("digest").agg(F.count("*").alias("n"), owner).filter("n > 1"), "shared-chunks")
    found = spread_join(places, shared, "digest", "n", F.struct("media_id", "at"))
    foreign = found.filter(F.col("owner").isNotNull() & (F.col("owner") != F.struct("media_id", "at"))).select("media_id", "at", "digest").distinct()
    foreign = written(spark, foreign, "joined-chunks")
    lists = foreign.groupBy("media_id").agg(F.collect_set("at").alias("foreign"))
    rows = media.join(sized_broadcast(lists, MOST_BROADCAST), "media_id", "left").select("media_id", "doc_id", "text", "foreign")
    kinds = "media_id string, doc_id long, n_bytes long, media_digest binary, media_bytes long, chunk_list array<binary>, chunks array<binary>"
    return written(spark, rows.mapInArrow(_stored, kinds), "media-store"), foreign


_WHOLE = "doc_id long, n_bytes long, payload binary, media binary, feature string"
_FACTS = "doc_id long, n_bytes long, feature string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def read_media(spark: SparkSession, store: DataFrame, foreign: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload, media, feature) of every medium of the store, put together from its chunk list and verified; raises where a chunk is missing or altered."""
    return prepare(spark) and _listed(spark, store, foreign).mapInArrow(_whole, _WHOLE)


def _listed(spark: SparkSession, store: DataFrame, foreign: DataFrame) -> DataFrame:
    """The store's rows with the chunks joined in, as _whole takes them."""
    needed = foreign.groupBy("digest").agg(F.count("*").alias("n"))
    held = store.select(F.explode(F.arrays_zip("chunk_list", "chunks")).alias("c")).select(F.col("c.chunk_list").alias("digest"), F.col("c.chunks").alias("bytes")).filter("bytes is not null")
    known = written(spark, held.join(sized_broadcast(needed, MOST_BROADCAST), "digest").dropDuplicates(["digest"]), "shared-chunk-bytes")
    got = spread_join(foreign, known, "digest", "n", F.struct("media_id", "at"))
    lists = got.groupBy("media_id").agg(F.collect_list(F.struct("at", "bytes")).alias("l")).select("media_id", F.col("l.at").alias("ats"), F.col("l.bytes").alias("joined"))
    away = F.exists("chunks", lambda c: c.isNull())
    cols = ["doc_id", "n_bytes", "media_digest", "media_bytes", "chunk_list", "chunks", "ats", "joined"]
    alone = store.filter(~away).withColumns({"ats": F.lit(None).cast("array<int>"), "joined": F.lit(None).cast("array<binary>")}).select(cols)
    joined = store.filter(away).join(lists, "media_id", "left").select(cols)
    return alone.unionByName(joined)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for payload, media in zip(b.column("payload").to_pylist(), b.column("media").to_pylist(), strict=True):
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest()))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), b.column("feature"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "feature", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"])


def media_facts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Stores the media of documents and reads all of them back: sizes, digests and features of what was read.

    Null text is empty and makes 64 zero samples. Equal texts have equal values. Null ids and repeated rows are kept as
    they are; columns besides doc_id and text are not carried; an empty table gives an empty result.
    """
    # one pass of Python: whole media do not go back to the JVM, nor to a second worker
    return prepare(spark) and _listed(spark, *store_media(spark, docs)).mapInArrow(lambda batches: _facts(_whole(batches)), _FACTS)
