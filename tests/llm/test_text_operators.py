import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fpsample.llm import pii
from fpsample.llm.language import document_evidence, identify, page_evidence
from fpsample.llm.license_scan import scan_licenses
from fpsample.llm.line_dedup import dedup_lines
from fpsample.llm.sentencepieces import chunks, decode_ids, default_model, encode_and_decode, encode_texts, load
from tests.llm.conftest import TEXTS


# -- personal data ---------------------------------------------------------------------------------
def brute_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        s = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        if 14 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_plain_spans_as_brute_force(documents):
    texts = [r.text for r in documents.collect()]
    rng = random.Random(1)
    texts += ["".join(rng.choice("a1.@ +-()9 4\n") for _ in range(rng.randrange(80))) for _ in range(4000)]
    texts += ["4539 1488 0343 6467", "4539-1488-0343-64670", "1.2.3.4.5.6.7.8", "001.02.3.0255 256.1.1.1", "a@b.c@d.e", "x@y@z.com", "+1234567890", "+12-(34) 56.78.90 1"]
    assert sum(len(brute_spans(t)) for t in texts) > 50
    for t in texts:
        assert pii.plain_spans(t) == brute_spans(t), t


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail jane [at] example (dot) com now", "email", "jane [at] example (dot) com"),
        ("mail jane.doe at example dot co dot uk now", "email", "jane.doe at example dot co dot uk"),
        ("mail jаne@exаmple.com now", "email", "jаne@exаmple.com"),
        ("call +1 five five five zero one zero nine nine nine nine!", "phone", "+1 five five five zero one zero nine nine nine nine"),
        ("ip １９２.168.0.1 ok", "ip", "１９２.168.0.1"),
        ("card 4539​148803436467.", "card", "4539​148803436467"),
    ],
)
def test_disguises_map_to_the_source(text, kind, found):
    plain = pii.plain_spans(text)
    spans = [s for s in pii.disguised_spans(text, plain)]
    assert [(k, text[a:b]) for k, a, b in spans if k == kind] == [(kind, found)]


def luhn_number(rng, n):
    d = [rng.randrange(10) for _ in range(n - 1)]
    return next("".join(map(str, [*d, c])) for c in range(10) if (lambda x: (sum(x[-1::-2]) + sum(sum(divmod(2 * y, 10)) for y in x[-2::-2])) % 10 == 0)([*d, c]))


def disguised(rng, kind):
    """A made-up identifier of a kind, disguised: at and dots in words, brackets or blanks, digits in words, look-alikes."""
    words = list(pii.SPELLED)
    name = lambda: "".join(rng.choice("abcdefghiklmnoprstuvz") for _ in range(rng.randrange(3, 9)))
    if kind == "email":
        at = rng.choice([" [at] ", "(at)", " {at} ", " (@) ", " @ ", " AT ", " at ", " -at- ", "\uff20"])
        dot = rng.choice([" [dot] ", "(dot)", " DOT ", " dot ", "[.]", "\uff0e"] + [" . "] * ("@" in at))
        return f"{name()}.{name()}{at}{name()}{dot if rng.random() < 0.7 else '.'}{name()}{dot}{rng.choice(['com', 'org', 'pl', 'io', 'co.uk', 'museum'])}"
    if kind == "ip":
        dot = rng.choice([" dot ", "[.]", "(dot)", " [dot] "])
        spelled = rng.random() < 0.5
        return dot.join(" ".join(words[int(c)] for c in str(x)) if spelled else str(x) for x in (rng.randrange(256) for _ in range(4)))
    digits = luhn_number(rng, rng.randrange(14, 20)) if kind == "card" else "".join(str(rng.randrange(10)) for _ in range(rng.randrange(10, 14)))
    style = rng.randrange(3)
    if style == 0:
        body = " ".join(words[int(c)] for c in digits)
    elif style == 1:  # full-width digits
        body = "".join(chr(0xFF10 + int(c)) for c in digits)
    else:  # invisible code points between
        body = "\u200b".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return body if kind == "card" else "+" + digits[0] + " " + body[len(words[int(digits[0])]) + 1 :] if style == 0 else "+" + body


@pytest.mark.parametrize("kind", pii.KINDS)
def test_recall_of_disguises(kind):
    rng = random.Random(kind)
    caught = 0
    for _ in range(600):
        span = disguised(rng, kind)
        text = f"{rng.choice(['write to', 'Contact:', 'é ñ see'])} {span}{rng.choice([' today', '!', ' \nregards'])}"
        at = text.index(span)
        caught += (kind, at, at + len(span)) in pii.disguised_spans(text, pii.plain_spans(text))
    assert caught >= 0.9 * 600, caught


def test_plain_prose_has_no_disguised_spans(documents):
    for t in ("we met at noon at the dot of twelve", "at one or two places, one two three", "a . b @ c", *(r.text for r in documents.collect())):
        assert all(any(c in t for c in "@+0123456789") or s is None for s in pii.disguised_spans(t, pii.plain_spans(t))), t


@pytest.mark.parametrize(
    "address",
    ["jan at firma dot pl", "jan at firma dot cn", "jan at firma dot ru", "jan at firma.com", "jan at mail.firma dot com", "jan at mail dot firma.com", "jan at firma [dot] pl",
     "jan.kowal at a dot b dot museum", "jan@ firma dot pl", "jan@ mail.firma dot ru", "JAN AT FIRMA.PL", "jan at firma dot co.uk"],
)
def test_bare_at_before_any_domain(address):
    for text in (f"mail {address} now", f"mail {address}."):
        assert [(k, text[a:b]) for k, a, b in pii.disguised_spans(text, pii.plain_spans(text))] == [("email", address)]


def test_bare_at_in_prose():
    for t in ("we met at noon at the dot of twelve", "ball at red dot on page", "see us at firma.com", "he left at noon.Then it rained", "shown at www.firma.com", "prices at firma.com/list", "at 5.30 or met at 5.30", "look at this dot over there", "it is available at firma.com."):
        assert pii.disguised_spans(t, pii.plain_spans(t)) == [], t


def test_domains_take_linear_time():
    import time

    n = 100_000
    began = time.time()
    for t in ("x at a." * n, "x at " + "a." * n, "x at " + "a dot " * n, "x at a dot " * n, "a at dot dot at dot " * (n // 20), "x at " + "a-" * n, "@ " + "a." * n, "@ a dot " * n, "x at " + "a [dot] " * n, "x at a [.] " * n, "x at" + " " * n + "a."):
        pii.disguised_spans(t, pii.plain_spans(t))
    assert time.time() - began < 60


def test_long_runs_take_linear_time():
    import time

    n = 200_000
    began = time.time()
    for t in (" " * n, "\n" * n + "x", "a " * n, "(" * n, "( " * n, "1" * n, "1 " * n, "+1" + " " * n, "a@" * n, "one " * n, "x dot " * (n // 10), "a.b-" * n, "1." * n, "@ " * n, "+1(" * n):
        pii.disguised_spans(t + " (at) b", pii.plain_spans(t))
    assert time.time() - began < 60


def test_find_pii_odd_rows(spark, odd, none):
    rows = pii.find_pii(spark, odd).collect()
    assert len(rows) == odd.count() and pii.find_pii(spark, none).count() == 0
    five = next(r for r in rows if r.text and "mailto" in r.text)
    assert [s.kind for s in five.spans] == ["email", "phone", "ip"]
    d = pii.span_digests(pii.find_pii(spark, odd)).filter("n_email = 1").first()
    want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(five.text))
    assert d.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and d.spans == want


# -- sentencepiece -----------------------------------------------------------------------------------
def test_encode_and_decode_as_the_library(spark, documents, odd, none):
    sp = load(default_model())
    for df in (documents, odd):
        for r in decode_ids(spark, encode_texts(spark, df)).collect():
            want = sp.encode(r.text or "")
            assert r.ids == want and r.decoded == sp.decode(want)
    assert encode_texts(spark, none).count() == 0


def test_encode_and_decode_in_one_pass(spark, odd, none):
    df = odd.withColumn("ids", F.lit("clash"))
    want = decode_ids(spark, encode_texts(spark, df)).drop("text")
    got = encode_and_decode(spark, df)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(got.columns) == sorted(want.columns) and sorted(map(repr, got.select([f"`{c}`" for c in want.columns]).collect())) == sorted(map(repr, want.collect()))
    assert encode_and_decode(spark, none).count() == 0


def test_chunks_alone_give_the_ids_of_the_text():
    sp = load(default_model())
    rng = random.Random(2)
    mark = sp.piece_to_id("▁")
    for _ in range(3000):
        t = "".join(rng.choice(" ab▁é日\n.  😀 ") for _ in range(rng.randrange(25)))
        assert [i for c in chunks(t) for i in (sp.encode(c) if c else [mark])] == sp.encode(t), repr(t)


# -- licenses ------------------------------------------------------------------------------------------
def brute_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))


def test_license_base_as_brute_force(spark, documents, odd, none):
    for df in (documents, odd):
        got = scan_licenses(spark, df).collect()
        want = Counter((r.doc_id, *brute_scan(r.text)) for r in df.collect())
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
        for r in got:
            assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert scan_licenses(spark, none).count() == 0


def test_rows_of_one_id_are_scanned_apart(spark):
    rows = [(1, "x general public"), (1, "y z public license"), (2, "cc by one"), (2, "cc by one"), (None, "all rights"), (None, "reserved")]
    got = scan_licenses(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, *brute_scan(t)) for r, t in zip(spark.createDataFrame(rows, "doc_id long, text string").collect(), [t for _, t in rows], strict=True)) == Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got)
    assert sum(r.n_base for r in got) == 2


def test_license_templates_bear_edits(spark):
    rows = [
        (1, "xx Licensed under the Apache License, Version 2.0 yy"),
        (2, "xx Licensed strictly under the Apache Software License, Version 2.0 yy"),
        (3, "the version of the license that the apache flew under was two"),
        (4, "all rights are reserved; all Rights RESERVED (All rights reserved)"),
    ]
    got = {r.doc_id: r for r in scan_licenses(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "apache-2.0" and got[1].score == 1.0 and got[2].labels == "apache-2.0" and got[3].labels == ""
    assert (got[4].n_base, got[4].first_word, got[4].last_word) == (2, 4, 7)


# -- lines ---------------------------------------------------------------------------------------------
def brute_key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute_lines(rows, least):
    docs = [(t or "").split("\n") for _, t in rows]
    held = {}
    for (i, t), d in zip(rows, docs, strict=True):
        for x in d:
            held.setdefault(brute_key(x), set()).add((i, t if i is None else ""))
    n = {k: len(v) if k else 0 for k, v in held.items()}
    return [(len(d), sum(n[brute_key(x)] >= least for x in d), "\n".join(x for x in d if n[brute_key(x)] < least)) for d in docs]


@pytest.mark.parametrize("least", [2, 10])
def test_lines_as_brute_force(spark, documents, odd, none, least):
    for df in (documents, odd):
        rows = df.collect()
        want = Counter((r.doc_id, *x) for r, x in zip(rows, brute_lines([(r.doc_id, r.text) for r in rows], least), strict=True))
        out = dedup_lines(spark, df, least)
        assert out.columns == [*(c for c in df.columns if c != "n_lines"), "n_lines", "n_dropped"]
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()) == want
    assert dedup_lines(spark, none).count() == 0


def test_lines_of_every_shape(spark):
    rng = random.Random(4)
    lines = ["", " ", "\t A \x0b", "a", "B", "b\r", "É", "é", "x" * 5000, "\u00a0", "c  d", "C  D ", "\x1c", "🙂"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(12)))) for i in range(120)] + [(500, "\n".join(rng.choice([*lines, f"own {k}"]) for k in range(20_000)))]
    got = dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 30)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == Counter((r[0], *x) for r, x in zip(rows, brute_lines(rows, 30), strict=True))


def test_documents_are_counted_not_rows(spark):
    rows = [(1, "line\nown")] * 10 + [(2, "line")]
    got = dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.n_dropped, r.text) for r in got.collect()} == {(1, 0, "line\nown"), (2, 0, "line")}


# -- languages ----------------------------------------------------------------------------------------
def test_language_of_documents(spark, documents, odd, none):
    got = identify(spark, document_evidence(documents)).collect()
    lang = {r.doc_id: r.lang for r in documents.collect()}
    assert len(got) == len(lang) and sum(r.language == lang[r.doc_id] for r in got) >= 0.98 * len(got)
    assert sum(r.accepted for r in got) >= 0.98 * len(got)
    rows = identify(spark, document_evidence(odd)).collect()
    assert len(rows) == odd.count() and not any(r.accepted for r in rows if r.doc_id in (2, 3, 4))
    assert identify(spark, document_evidence(none)).count() == 0


def test_held_out_text_alone_decides(spark, documents):
    """Declared languages are hidden from every third document; their text has to tell."""
    from pyspark.sql import functions as F

    e = document_evidence(documents).withColumn("declared", F.when(F.col("doc_id") % 3 != 0, F.col("declared"))).withColumn("host", F.lit(None).cast("string"))
    lang = {r.doc_id: r.lang for r in documents.filter("n_chars > 40").collect()}
    got = [r for r in identify(spark, e).collect() if r.doc_id % 3 == 0 and r.doc_id in lang]
    assert len(got) > 40 and sum(r.language == lang[r.doc_id] for r in got) >= 0.97 * len(got)


def test_pages_give_markup_suffix_and_host(spark):
    rows = [(1, "https://blog.ab.example.com/fr/12?x", '<html lang="fr-CA"><script>var a</script><p>le &amp; la</p>'), (2, None, None), (3, "http://h.example.de", "<p>x")]
    got = {r.page_id: r for r in page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1].declared, got[1].suffix, got[1].host) == ("fr-CA", "fr", "blog.ab.example.com") and "var" not in got[1].text
    assert (got[2].declared, got[2].suffix, got[2].host) == (None, None, None) and got[3].suffix == "de"
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = identify(spark, page_evidence(pages)).collect()
    assert len(out) == pages.count() and all(0 < r.probability <= 1 for r in out)


def brute_trigrams(text):
    folded = []
    for c in f" {text.lower()} ":
        c = ord(c) if "a" <= c <= "z" or ord(c) >= 0xAA else 32
        if not (c == 32 and folded and folded[-1] == 32):
            folded.append(c)
    out = []
    for a, b, c in zip(folded, folded[1:], folded[2:], strict=False):
        h = (a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) % 2**32
        out.append(((h ^ (h >> 15)) * 0x2C1B3C6D) % 2**32 >> 18)
    return out


def brute_posteriors(rows):
    """Of rows (text, declared, suffix, host): (language, probability, text language, accepted), by loops and dicts alone."""
    tag = lambda x: None if x is None else re.split("[-_]", x)[0].strip(" ").lower()
    rows = [(brute_trigrams(t) if t else [], tag(d), tag(s), h) for t, d, s, h in rows]
    counts = {}
    for grams, d, _, _ in rows:
        if d and re.fullmatch("[a-z]{2,8}", d) and d not in ("und", "mul", "mis", "zxx") and grams:
            counts.setdefault(d, Counter()).update(grams)
    known = sorted(counts)
    names, buckets = [*known, "und"], 1 << 14
    models = []
    for k in known:
        n = sum(counts[k].values())
        part = min(0.5 * buckets / (n + 0.5 * buckets), 0.25)
        models.append(lambda g, c=counts[k], n=n, part=part: c[g] / n * (1 - part) + part / buckets)
    models.append(lambda g: 0.5 / buckets + 0.5 * (sum(m(g) for m in models[:-1]) / len(known)))
    logs, told = [], []
    for grams, *_ in rows:
        n = len(grams)
        logs.append([sum(math.log(m(g)) for g in grams) * min(0.25 * n, 200) / n - (14 if m is models[-1] else 0) for m in models] if n > 1 else [0.0] * len(names))
        told.append(names[max(range(len(names)), key=lambda i: logs[-1][i])] if n > 1 else None)
    total = Counter(x for x in told if x)
    overall = [(total[x] + 1) / (sum(total.values()) + len(names)) for x in names]

    def prior(host, level):
        if level == 0:
            return overall
        cut = lambda h: h if level == 3 else ".".join(h.split(".")[-{1: 1, 2: 2}[level] :])
        own = Counter(t for (_, _, _, h), t in zip(rows, told, strict=True) if h is not None and cut(h) == cut(host) and t)
        return [(own[x] + 8 * p) / (sum(own.values()) + 8) for x, p in zip(names, prior(host, level - 1), strict=True)]

    out = []
    for i, (grams, *values, host) in enumerate(rows):
        score = [math.log(p) + x for p, x in zip(overall if host is None else prior(host, 3), logs[i], strict=True)]
        for column, v in enumerate(values, 1):
            if v is not None:
                alike = [t for r, t in zip(rows, told, strict=True) if r[column] == v]
                score = [s + math.log((sum(t == x for t in alike) + 8 * len(alike) / len(rows)) / (total[x] + 8)) for s, x in zip(score, names, strict=True)]
        exps = [math.exp(s - max(score)) for s in score]
        best = max(range(len(names)), key=lambda k: exps[k])
        p = exps[best] / sum(exps)
        out.append((names[best], p, told[i], p >= 0.5 and len(grams) > 1 and names[best] != "und"))
    return out


def test_posteriors_as_brute_force(spark, documents, odd):
    rng = random.Random(11)
    texts = [r for r in documents.limit(60).collect()]
    rows = [(i, r.text[: rng.choice([3, 20, 60, 400])], rng.choice([r.lang, r.lang, r.lang.upper() + "-XX", None, "xx", "mul"]), rng.choice([r.lang, "com", None, "DE"]), rng.choice([f"{r.lang}.example.org", "a.b.example.com", "example.com", None, "", "x"])) for i, r in enumerate(texts)]
    rows += [(100 + i, t, lang, None, source) for i, (_, t, lang, source) in enumerate(TEXTS) if t is None or len(t) < 1000]
    got = identify(spark, spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string").repartition(3)).collect()
    want = {r[0]: w for r, w in zip(rows, brute_posteriors([r[1:] for r in rows]), strict=True)}
    assert len(got) == len(want)
    for r in got:
        language, p, told, accepted = want[r.doc_id]
        assert (r.language, r.text_language, r.accepted) == (language, told, accepted) and abs(r.probability - p) < 1e-3, r.doc_id


FOREIGN = {
    "it": "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, ché la diritta via era smarrita. Ahi quanto a dir qual era è cosa dura esta selva selvaggia e aspra e forte",
    "ru": "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. Все смешалось в доме",
    "junk": "qzx wvkj xqpz jjfw qkxz vbqw zzxk pqjv xwkq jzvb qfxk wjqz kxvq zqpw jxkf vqzw xkjq wpzx qvjk fzxq",
}


def test_texts_of_no_trained_language_are_rejected(spark, documents):
    rows = [(9000 + i, t, None, None, f"src{i}") for i, t in enumerate(FOREIGN.values())] + [(9010, FOREIGN["ru"], "en", None, "src1"), (9011, "ab", "xx", None, "x"), (9012, "1 2 3", "tlh", None, "x")]
    e = document_evidence(documents)
    got = {r.doc_id: r for r in identify(spark, e.union(spark.createDataFrame(rows[:3], e.schema))).collect()}
    assert all((got[r[0]].language, got[r[0]].text_language, got[r[0]].accepted) == ("und", "und", False) for r in rows[:3])
    # a language of a few letters or of none is no refuge for them
    got = {r.doc_id: r for r in identify(spark, e.union(spark.createDataFrame([*rows[:3], *rows[4:]], e.schema))).collect()}
    assert not any(got[r[0]].accepted for r in rows[:3]) and sum(r.accepted for r in got.values()) >= 0.98 * documents.count()


def test_every_declared_language_is_trained(spark, documents):
    e = document_evidence(documents)
    words = FOREIGN["ru"].split()
    rows = [(9000 + i, " ".join(words[i % 7 :] + words[: i % 5]), "ru" if i else None, None, None) for i in range(20)]
    got = {r.doc_id: r for r in identify(spark, e.union(spark.createDataFrame(rows, e.schema))).collect()}
    assert all(got[r[0]].language == "ru" and got[r[0]].accepted for r in rows)


def test_declared_regions_and_cases_are_trained(spark, documents):
    from pyspark.sql import functions as F

    e = document_evidence(documents)
    tagged = e.withColumn("declared", F.when(F.col("doc_id") % 2 == 0, F.concat("declared", F.lit("-XX"))).otherwise(F.concat(F.lit(" "), F.upper("declared"))))
    want = {r.doc_id: r for r in identify(spark, e).collect()}
    assert {r.doc_id: r for r in identify(spark, tagged).collect()} == want and len({r.text_language for r in want.values()}) == 4


def test_pages_query_reads_whole_pages(spark):
    from __spark_entry__ import queries

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = queries()["op6_language_pages"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    told = [r for r in got if (m := re.search(r'<html lang="([a-z]+)', pages[r.page_id])) and r.language == m[1]]
    assert len(told) >= 0.9 * len(got)
