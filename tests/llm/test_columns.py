"""Columns of the input that are named like results, like others' results or like names used inside."""

import pytest
from pyspark.sql import functions as F

from fpsample.llm.fingerprints import compare_neighbours, fingerprint_documents
from fpsample.llm.jaccard import similar_groups
from fpsample.llm.language import identify
from fpsample.llm.license_scan import scan_licenses
from fpsample.llm.line_dedup import dedup_lines
from fpsample.llm.media import media_facts
from fpsample.llm.mixing import mix_sources
from fpsample.llm.pii import find_pii
from fpsample.llm.sentencepieces import decode_ids, encode_texts
from fpsample.llm.warc import pages_through_warc

CLASHES = ["spans", "ids", "decoded", "language", "probability", "accepted", "fingerprint", "size", "target", "copies", "n", "set", "sid", "row", "pos", "line", "hit", "key", "u", "bucket", "sha", "template", "digest", "media_id", "chunks", "_0", "_1", "_id", "_no_id", "_text_hash", "_size", "_u", "_key", "_place", "_spans", "_ids", "_bucket", "_sha", "_dropped", "_salt", "_group", "record_id", "payload"]
RUNS = {
    "pii": (find_pii, ["spans"]),
    "encode": (encode_texts, ["ids"]),
    "decode": (lambda s, d: decode_ids(s, encode_texts(s, d)), ["ids", "decoded"]),
    "lines": (dedup_lines, ["n_lines", "n_dropped"]),
    "language": (lambda s, d: identify(s, d.withColumn("declared", F.col("lang")).withColumn("host", F.col("source"))).drop("lang", "source"), ["language", "probability", "accepted"]),
    "fingerprints": (fingerprint_documents, ["fingerprint"]),
    "neighbours": (compare_neighbours, None),
    "groups": (similar_groups, None),
    "licenses": (scan_licenses, None),
    "mixing": (mix_sources, ["size", "target", "copies"]),
    "media": (media_facts, None),
    "warc": (lambda s, d: pages_through_warc(s, d.withColumnRenamed("doc_id", "page_id").withColumn("url", F.col("source")).withColumnRenamed("text", "html")), None),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_clashing_columns(spark, odd, name):
    run, replaced = RUNS[name]
    plain = odd.select("doc_id", "text", "lang", "source").filter("doc_id is null or doc_id <> 7")
    more = plain.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHES})
    bare, got = run(spark, plain), run(spark, more)
    same = [c for c in bare.columns if c not in ("chunk_list",)]
    assert sorted(map(repr, bare.select(same).collect())) == sorted(map(repr, got.select(same).collect()))
    if replaced is not None:  # all other columns are carried as they are
        for c in set(CLASHES) - set(replaced):
            assert c in got.columns, c
            assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in got.select("doc_id", c).collect())
