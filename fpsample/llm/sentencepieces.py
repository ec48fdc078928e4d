"""SentencePiece encoding by a table of distinct chunks, and decoding.

No piece of the model has a white-space marker behind another character, so no merge crosses from a word into the next
marker: the text is cut there, each distinct marked word is segmented once, and the ids are joined back by position.

The table is held for the block of documents that a task reads, not for the whole corpus: a table for all would have to
meet the documents in a shuffle that moves more bytes than the segmentation of its words costs (figures in the README).
A block's table is bounded; when it is full a new one is begun, which changes no id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fpsample.llm.common import boxed, prepare, unboxed

#: Chunks and bytes of ids at which a table is full.
TABLE_CHUNKS, TABLE_IDS = 400_000, 4_000_000
_MARK = "▁"
_RUNS = re.compile(" *[^ ]+| +")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def pieces_stay_in_chunks(processor) -> bool:
    """Whether chunks may be segmented alone: no piece has a marker behind another character, and normalisation changes nothing but blanks (each kept, as a marker) and puts one marker first."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    probe = " a  b ééﬁ①\t\n "
    return not any(re.search(f"[^{_MARK}]{_MARK}", p) for p in pieces) and processor.normalize(probe) == _MARK + probe.replace(" ", _MARK)


def chunks(text: str) -> list[str]:
    """The text cut before each run of blanks, every chunk without its first blank (the first chunk: without the marker that the library puts first)."""
    if not text:
        return []
    text = text.replace(_MARK, " ")
    if "  " not in text and text[0] != " " != text[-1]:
        return text.split(" ")
    return [x[1:] for x in _RUNS.findall(" " + text)]


class ChunkTable:
    """Distinct chunks with their ids, one after the other in flat arrays."""

    def __init__(self, processor):
        self.processor = processor
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text's ids)."""
        if len(self.code) > TABLE_CHUNKS or len(self.ids) > TABLE_IDS:
            self.clear()
        code = self.code
        cut = [chunks(t) for t in texts]
        new = list({c for cs in cut for c in cs if c not in code})
        if new:
            made = self.processor.encode(new, num_threads=1)
            # an empty chunk stands for the marker alone, which the library gives for no text
            made = [m if c else [self.processor.piece_to_id(_MARK)] for c, m in zip(new, made, strict=True)]
            code.update(zip(new, range(len(code), len(code) + len(new)), strict=True))
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(m) for m in made])])
            self.ids = np.concatenate([self.ids, np.fromiter((i for m in made for i in m), np.int32)])
        codes = np.fromiter((code[c] for cs in cut for c in cs), np.int64)
        starts = self.ends[codes]
        lengths = self.ends[codes + 1] - starts
        out_ends = np.cumsum(lengths)
        total = int(out_ends[-1]) if len(out_ends) else 0
        at = np.arange(total) + np.repeat(starts - (out_ends - lengths), lengths)
        ends = np.concatenate([[0], out_ends])[np.cumsum([len(cs) for cs in cut])] if cut else np.zeros(0, np.int64)
        return self.ids[at], ends


def _encoder(model: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ChunkTable(load(model))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids, ends = held.encode([t or "" for t in part.column("text").to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "_ids"])

    return encode


def _decoder(model: str, column: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = load(model)
        for b in batches:
            texts = [processor.decode(x.tolist()) if len(x := i.values.to_numpy(zero_copy_only=False) if i.is_valid else ()) else "" for i in b.column(column)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "_decoded"])

    return decode


def encode_texts(spark: SparkSession, docs: DataFrame, model: str | None = None) -> DataFrame:
    """docs with ``ids``, the ids that the library's encode gives for the whole text, without begin or end ids and sampling.

    Null texts count as empty and have no ids. Other columns stay as they are, an input column ``ids`` is replaced; repeated
    rows are each encoded; an empty table gives an empty result. Raises ValueError for a model whose pieces cross markers.
    ``model`` is a path that every executor has.
    """
    model = model or default_model()
    if not pieces_stay_in_chunks(load(model)):
        raise ValueError(f"{model}: its pieces or its normalisation cross white-space markers")
    body, names = boxed(docs, ("ids",))
    out = prepare(spark) and body.mapInArrow(_encoder(model), T.StructType([*body.schema, T.StructField("_ids", T.ArrayType(T.IntegerType()))]))
    return unboxed(out, names, {"ids": F.col("_ids")})


def decode_ids(spark: SparkSession, docs: DataFrame, model: str | None = None) -> DataFrame:
    """docs with ``decoded``, the library's decode of ``ids``; null ids decode to ''. An input column ``decoded`` is replaced, others stay."""
    model = model or default_model()
    body, names = boxed(docs, ("decoded",))
    at = names.index("ids")
    out = prepare(spark) and body.mapInArrow(_decoder(model, f"_{at}"), T.StructType([*body.schema, T.StructField("_decoded", T.StringType())]))
    return unboxed(out, names, {"decoded": F.col("_decoded")})


def encode_and_decode(spark: SparkSession, docs: DataFrame, model: str | None = None) -> DataFrame:
    """docs without ``text``, with the ``ids`` of encode_texts and the ``decoded`` of decode_ids, in one pass: a task needs one worker, and ids and texts do not go back to the JVM between the two."""
    model = model or default_model()
    if not pieces_stay_in_chunks(load(model)):
        raise ValueError(f"{model}: its pieces or its normalisation cross white-space markers")
    body, names = boxed(docs, ("ids", "decoded"))
    encode, decode = _encoder(model), _decoder(model, "_ids")

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in decode(encode(batches)):
            yield b.drop_columns(["text"])

    kinds = [*(f for f in body.schema if f.name != "text"), T.StructField("_ids", T.ArrayType(T.IntegerType())), T.StructField("_decoded", T.StringType())]
    out = prepare(spark) and body.mapInArrow(both, T.StructType(kinds))
    own = [F.col("doc_id" if c == "doc_id" else f"_{i}").alias(c) for i, c in enumerate(names) if c != "text"]
    return out.select(*own, F.col("_ids").alias("ids"), F.col("_decoded").alias("decoded"))
