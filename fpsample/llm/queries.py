"""The operators' queries, opN_<name>, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fpsample.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fpsample.llm.warc import pages_through_warc

    out = pages_through_warc(spark, table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op1_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to FROM f
"""


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fpsample.llm.pii import find_pii, span_digests

    return span_digests(find_pii(spark, table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fpsample.llm.sentencepieces import encode_and_decode

    out = encode_and_decode(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fpsample.llm.license_scan import scan_licenses

    return scan_licenses(spark, table(spark, sf_dir, "documents")).drop("spans")


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fpsample.llm.line_dedup import dedup_lines

    out = dedup_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL["op8_line_dedup"] = """
WITH l AS (
  SELECT doc_id, p, line, translate(regexp_replace(line, '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents)
), f AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f USING (k) GROUP BY doc_id
"""


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fpsample.llm.mixing import mix_sources

    out = mix_sources(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "shards")


@query
def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fpsample.llm.media import media_facts

    return media_facts(spark, table(spark, sf_dir, "documents"))


@query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fpsample.llm.fingerprints import compare_neighbours

    return compare_neighbours(spark, table(spark, sf_dir, "documents"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fpsample.llm.language import document_evidence, identify

    out = identify(spark, document_evidence(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "language", "probability", "text_language", "accepted")


@query
def op6_language_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fpsample.llm.language import identify, page_evidence

    out = identify(spark, page_evidence(table(spark, sf_dir, "pages")))
    return out.select("page_id", "language", "probability", "text_language", "accepted")


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fpsample.llm.jaccard import similar_groups

    return similar_groups(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL["op4_jaccard_join"] = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS l FROM w),
s AS MATERIALIZED (SELECT doc_id, unnest(l) AS s FROM l),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT x, y FROM p JOIN l a ON a.doc_id = x JOIN l b ON b.doc_id = y WHERE 100 * k >= 90 * (len(a.l) + len(b.l) - k)),
u AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS v, doc_id AS z FROM l UNION SELECT r.v, u.y FROM r JOIN u ON u.x = r.z)
SELECT v AS doc_id, any_value(len(l.l)) AS n_shingles, min(z) AS component_id FROM r JOIN l ON l.doc_id = v GROUP BY v
"""


def _license_sql() -> str:
    from fpsample.llm.license_scan import MAX_SHIFT, MIN_SHARE, PHRASES, TEMPLATES

    rows, listed = [], [(True, label, text) for text, label in PHRASES.items()] + [(False, label, text) for label, text in TEMPLATES.items()]
    for template, (exact, label, text) in enumerate(listed):
        words = text.split()
        rows += [f"({template}, '{label}', {exact}, {len(words) - 1}, {i}, '{words[i]}', '{words[i + 1]}')" for i in range(len(words) - 1)]
    return f"""
WITH t(template, label, exact, pairs, place, ta, tb) AS (VALUES {", ".join(rows)}),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w), g AS (SELECT doc_id, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM i),
v AS (SELECT doc_id, template, label, exact, pairs, pos - place AS diagonal, min(pos) AS lo, max(pos) AS hi, list(DISTINCT place) AS ats FROM g JOIN t ON a = ta AND b = tb GROUP BY ALL),
m AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= {MAX_SHIFT} AND NOT exact AND abs(lo - lag(lo) OVER o) <= pairs THEN 0 ELSE 1 END AS start FROM v WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
b AS (SELECT *, sum(start) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS band FROM m),
s AS (SELECT doc_id, label, exact, pairs, len(list_distinct(flatten(list(ats)))) / pairs::DOUBLE AS share, min(lo) AS lo, max(hi) + 1 AS hi FROM b GROUP BY doc_id, template, label, exact, pairs, band),
k AS (SELECT *, CASE WHEN exact THEN share = 1 ELSE share >= {MIN_SHARE} AND hi - lo <= ceil(pairs * 1.5) END AS ok FROM s)
SELECT w.doc_id, len(w.w) AS n_words, count(k.lo) FILTER (ok AND exact) AS n_base, min(lo) FILTER (ok AND exact) AS first_word, max(lo) FILTER (ok AND exact) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (ok AND exact), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (ok), '') AS labels,
       coalesce(max(share) FILTER (ok), 0.0) AS score
FROM w LEFT JOIN k USING (doc_id) GROUP BY w.doc_id, len(w.w)
"""


ORACLE_SQL["op5_license_scan"] = _license_sql()
