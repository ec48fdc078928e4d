"""Language identification by Bayesian fusion of text, declared markup language, address suffix and host priors.

Text: naive Bayes over hashed character trigrams, trained here on the rows that declare a language: every declared value that
has the form of a language tag and texts with letters is a language. A background model, half the mean of the languages and
half even, stands for none of them and takes texts whose trigrams no one language explains. Declared language and
address suffix: confusion counts of each declared value against what the texts say. Hosts: the share of languages among a
host's rows, smoothed towards its domain, this towards its suffix, this towards all rows, each by grouped aggregation. The
sources are taken as independent given the language, so their log likelihoods add.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fpsample.llm.common import boxed, prepare, spread_join, unboxed, written

#: None of the trained languages (ISO 639's code for undetermined), and the declared values that name no language.
UNKNOWN, NO_LANGUAGE = "und", ("und", "mul", "mis", "zxx")
_TAG = re.compile("[a-z]{2,8}")
#: Hashed trigrams; additive smoothing of their counts; the most of a language's mass that smoothing takes (less than the
#: background's even half, so that a language of few texts is no background itself).
BUCKETS, SMOOTHING, MOST_SMOOTHED, EVEN = 1 << 14, 0.5, 0.25, 0.5
#: Log odds by which a text has to speak for the background before it counts as of no trained language: names, addresses and
#: other short texts fit no model well and are left to the other evidence.
HANDICAP = 14.0
#: Rows that a level's prior counts as; share of a text's trigrams that count as independent, and most of them.
STRENGTH, INDEPENDENT, MOST_TRIGRAMS = 8.0, 0.25, 200.0
#: Least probability of the language at which a document is accepted.
ACCEPT = 0.5
#: Code points hashed in one go.
BLOCK = 1 << 20


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the trigrams of letters, other characters folded into one blank, in blocks that overlap by two."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    letter = ((codes >= 97) & (codes <= 122)) | (codes >= 0xAA)
    codes = np.where(letter, codes, 32)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    for at in range(0, len(codes) - 2, BLOCK):
        c = codes[at : at + BLOCK + 2]
        mixed = (c[:-2] * 0x9E3779B1 + c[1:-1] * 0x85EBCA6B + c[2:] * 0xC2B2AE35) & 0xFFFFFFFF
        yield ((mixed ^ (mixed >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> 18


def host_levels(host: Column) -> list[Column]:
    """host, its last two labels, its last label."""
    return [host, F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for b in batches:
        for text, k in zip(b.column("text").to_pylist(), b.column("declared").to_pylist(), strict=True):
            if text and k and _TAG.fullmatch(k) and k not in NO_LANGUAGE:
                for t in trigrams(text):
                    if k not in held:
                        held[k] = np.zeros(BUCKETS, np.int64)
                    held[k] += np.bincount(t, minlength=BUCKETS)
    for k, n in held.items():
        t = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([k] * len(t), pa.string()), pa.array(t.astype(np.int32)), pa.array(n[t])], ["language", "bucket", "n"])


def train(spark: SparkSession, rows: DataFrame) -> tuple[tuple[str, ...], np.ndarray]:
    """The languages that rows declare, UNKNOWN last, and (BUCKETS, languages) log probabilities. Each task gives at most BUCKETS counts a language; so does the driver get."""
    counted = prepare(spark) and rows.filter("declared is not null").select("text", "declared").mapInArrow(_count, "language string, bucket int, n long")
    found = counted.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages, column = np.unique(np.array(found.column("language").to_pylist(), str), return_inverse=True)
    held = np.zeros((BUCKETS, len(languages)))
    held[found.column("bucket").to_numpy(), column] = found.column("n").to_numpy()
    total = held.sum(axis=0)
    smoothed = np.minimum(SMOOTHING * BUCKETS / (total + SMOOTHING * BUCKETS), MOST_SMOOTHED)
    held = held / total * (1 - smoothed) + smoothed / BUCKETS
    background = EVEN / BUCKETS + (1 - EVEN) * (held.mean(axis=1, keepdims=True) if len(languages) else np.full((BUCKETS, 1), 1 / BUCKETS))
    return (*languages.tolist(), UNKNOWN), np.log(np.hstack([held, background]))


def _score(model: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.astype(np.float32)
        handicap = np.where(np.arange(model.shape[1]) < model.shape[1] - 1, 0.0, HANDICAP)
        for b in batches:
            scores, counts = [], []
            for text in b.column("text").to_pylist():
                total, n = np.zeros(model.shape[1]), 0
                for t in trigrams(text or ""):
                    total += table[t].sum(axis=0, dtype=np.float64)
                    n += len(t)
                # trigrams overlap and repeat: n of them weigh as INDEPENDENT * n, MOST_TRIGRAMS at most
                scores.append((total * (min(INDEPENDENT * n, MOST_TRIGRAMS) / n) - handicap if n > 1 else np.zeros_like(total)).tolist())
                counts.append(n if n > 1 else 0)
            keep = [b.column(c) for c in b.schema.names if c != "text"]
            names = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(scores, pa.list_(pa.float64())), pa.array(counts, pa.int64())], [*names, "log_text", "trigrams"])

    return score


def _normal(logs: Column, k: int) -> Column:
    """Log scores as probabilities."""
    top = F.array_max(logs)
    exps = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(exps, lambda x: x / F.aggregate(exps, F.lit(0.0), lambda a, y: a + y))


def _argmax(probs: Column, languages: tuple[str, ...]) -> Column:
    """The language of the greatest probability, the first of equals."""
    return F.element_at(F.array(*[F.lit(k) for k in languages]), F.array_position(probs, F.array_max(probs)).cast("int"))


def identify(spark: SparkSession, rows: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """rows (any columns; of them text, declared, suffix and host, strings that may be null or missing, are evidence) with
    ``language``, ``probability``, ``text_language``, ``n_trigrams`` and ``accepted``; the evidence columns go, others stay.

    The languages are those that rows declare, and UNKNOWN, which is none of them. A row is accepted if its language is not
    UNKNOWN, its probability is at least ``accept`` and its text has letters. Null, empty or letterless texts have no text
    evidence: ``text_language`` is null, the other evidence still decides ``language``, and the row is not accepted.
    Without any evidence the language is the most common one, UNKNOWN where no row declares any. Repeated rows each count; an empty table gives an
    empty result. Scores of documents stay in a table of the shared folder; texts are never shuffled.
    """
    evidence = ("text", "declared", "suffix", "host")
    others = [c for c in rows.columns if c not in (*evidence, "language", "probability", "text_language", "n_trigrams", "accepted")]
    body = rows.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)], *[(F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c) for c in evidence])
    body = body.withColumns({c: F.lower(F.trim(F.split(c, "[-_]")[0])) for c in ("declared", "suffix")})  # the language of a tag, without its region
    languages, model = train(spark, body)
    k = len(languages)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in body.schema if f.name != "text")
    scored = body.mapInArrow(_score(model), kinds + ", log_text array<double>, trigrams long")
    domain, top = host_levels(F.col("host"))[1:]
    scored = written(spark, scored.withColumns({"domain": domain, "top": top, "text_language": F.when(F.col("trigrams") > 0, _argmax(F.col("log_text"), languages))}), "language-scores")

    shares = [F.sum((F.col("text_language") == x).cast("long")).alias(f"n{i}") for i, x in enumerate(languages)]
    total = scored.agg(*shares, F.count("*").alias("rows")).first()
    rows_in = total.rows
    totals = [total[i] or 0 for i in range(k)]
    overall = [(t + 1) / (sum(totals) + k) for t in totals]

    def smoothed(counts: list[Column], parent: Column | list[float]) -> Column:
        p = parent if isinstance(parent, Column) else F.array(*[F.lit(x) for x in parent])
        n = sum(counts[1:], counts[0])
        return F.array(*[(c + STRENGTH * p[i]) / (n + STRENGTH) for i, c in enumerate(counts)])

    own = [F.col(f"n{i}") for i in range(k)]
    hosts = scored.filter("host is not null").groupBy("host", "domain", "top").agg(F.count("*").alias("rows"), *shares)
    hosts = written(spark, hosts, "host-counts")
    up = [F.sum(f"n{i}").alias(f"n{i}") for i in range(k)]
    tops = hosts.groupBy("top").agg(F.count("*").alias("rows"), *up).withColumn("p_top", smoothed(own, overall)).select("top", "rows", "p_top")
    domains = hosts.groupBy("domain", "top").agg(F.count("*").alias("rows"), *up)
    domains = spread_join(written(spark, domains, "domains"), written(spark, tops.withColumn("rows", F.col("rows")), "tops"), "top", "rows", F.col("domain"))
    domains = written(spark, domains.withColumn("p_domain", smoothed(own, F.col("p_top"))).groupBy("domain").agg(F.sum("rows").alias("rows"), F.first("p_domain").alias("p_domain")), "domain-priors")
    hosts = spread_join(hosts.withColumnRenamed("rows", "host_rows"), domains, "domain", "rows", F.col("host"))
    hosts = written(spark, hosts.withColumn("p_host", smoothed(own, F.col("p_domain"))).select("host", F.col("host_rows").alias("rows"), "p_host"), "host-priors")

    out = spread_join(scored, hosts, "host", "rows", F.col("log_text"))
    logs = F.transform(F.coalesce("p_host", F.array(*[F.lit(x) for x in overall])), lambda x: F.log(x))
    for column in ("declared", "suffix"):
        # P(value | language) from the languages of texts, smoothed towards the value's share of all rows
        out = out.withColumn("_value", F.col(column))
        counts = out.filter("_value is not null").groupBy("_value").agg(*shares, F.count("*").alias("n"))
        known = F.array(*[F.log((F.col(f"n{i}") + STRENGTH * F.col("n") / max(rows_in, 1)) / (t + STRENGTH)) for i, t in enumerate(totals)])
        counts = written(spark, counts.select("_value", "n", known.alias("_known")), f"{column}-counts")
        out = spread_join(out, counts, "_value", "n", F.col("log_text")).withColumn(f"_log_{column}", F.coalesce("_known", F.array(*[F.lit(0.0)] * k))).drop("_value", "_known")
        logs = F.zip_with(logs, F.col(f"_log_{column}"), lambda a, b: a + b)
    out = out.withColumn("_logs", F.zip_with(logs, F.col("log_text"), lambda a, b: a + b)).withColumn("_p", _normal(F.col("_logs"), k))
    best = F.array_max("_p")
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(others)], _argmax(F.col("_p"), languages).alias("language"), best.alias("probability"), "text_language", F.col("trigrams").alias("n_trigrams"), ((best >= accept) & (F.col("trigrams") > 0) & (_argmax(F.col("_p"), languages) != UNKNOWN)).alias("accepted"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents as evidence: lang is the declared language, source the host; documents have no address."""
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages as evidence: the html element's lang, the address's host, and its suffix: a first path part of two letters, else the top-level domain."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), "[?#].*$", "")
    host = F.lower(F.regexp_extract(rest, "^([^/:]+)", 1))
    path = F.lower(F.regexp_extract(rest, "^[^/]*/([a-zA-Z]{2})(?:/|$)", 1))
    plain = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), "<[^>]*>|&[a-z]+;", " ")
    lang = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    null = lambda c: F.when(c != "", c)
    return pages.select("page_id", plain.alias("text"), null(lang).alias("declared"), F.coalesce(null(path), null(F.substring_index(host, ".", -1))).alias("suffix"), null(host).alias("host"))
