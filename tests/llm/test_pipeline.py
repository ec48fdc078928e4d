from collections import Counter, defaultdict

import corpus_pipeline as P
from fpsample.llm.sentencepieces import default_model, load
from tests.llm.test_table_operators import brute_groups
from tests.llm.test_text_operators import brute_lines


def test_stages_as_brute_force(spark, documents, odd):
    more = odd.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) as n_chars")
    docs = documents.unionByName(documents.filter("doc_id < 30").selectExpr("doc_id + 5000 as doc_id", "text", "lang", "source", "n_chars")).unionByName(more)
    docs = docs.selectExpr("*", "'x' as _id", "'y' as _no_id", "1 as _language", "array(1) as shards", "text as size")
    one = P.keep_identified(spark, docs, "")
    assert one.columns == list(P.COLUMNS)
    kept = one.collect()
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    assert {(r.doc_id, r.text) for r in kept} <= texts and {d for d, _ in texts - {(r.doc_id, r.text) for r in kept}} <= {2, 3, 4}

    two = P.drop_repeated_lines(spark, one, "")
    want = Counter((r.doc_id, x[2], len(x[2])) for r, x in zip(kept, brute_lines([(r.doc_id, r.text) for r in kept], 10), strict=True))
    assert Counter((r.doc_id, r.text, r.n_chars) for r in two.collect()) == want

    three = P.keep_one_of_near_copies(spark, two, "")
    rows = sorted({(r.doc_id, r.text) for r in two.collect()}, key=repr)  # rows repeated whole are one document from here on
    group = {}
    for (d, n, c), _ in brute_groups(rows, P.NEAR_WORDS, P.NEAR_PERCENT).items():
        group.setdefault((d, n), c)
    left = three.collect()
    by = defaultdict(int)
    for r in left:
        by[r.doc_id] += 1
    heads = Counter(c for d, n, c in brute_groups(rows, P.NEAR_WORDS, P.NEAR_PERCENT) if n)
    assert len(left) == len({(r.doc_id, r.text) for r in left})
    assert set(heads) == {r.doc_id for r in left if (r.text or "").split()} and {(r.doc_id, r.text) for r in left} <= set(rows)

    four = P.mix(spark, three, "")
    assert four.columns == list(P.COLUMNS)
    copies = Counter((r.doc_id, r.text) for r in four.collect())
    assert set(copies) <= {(r.doc_id, r.text) for r in left} and max(copies.values()) <= 2
    words = sum(len((r.text or "").split()) for r in left)
    assert abs(sum(len((t or "").split()) * n for (_, t), n in copies.items()) - 1.5 * words) < 0.1 * words

    sp = load(default_model())
    tokens = Counter((r.doc_id, r.n_tokens) for r in P.encode(spark, four, "").collect())
    assert tokens == sum((Counter({(d, len(sp.encode(t or ""))): n}) for (d, t), n in copies.items()), Counter())


def test_empty_table_passes_through(spark, documents):
    docs = documents.filter("false")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_mix_follows_the_tree(spark, documents):
    rows = P.mixed_rows(P.mix_sources(spark, documents)).collect()
    shards = [[r.doc_id for r in sorted((r for r in rows if r.shard == s), key=lambda r: r.order_key)] for s in range(8)]
    assert all(shards)
    got = [r.doc_id for r in P.mix(spark, documents, "").collect()]
    text = lambda ids: "," + ",".join(map(str, ids)) + ","
    assert len(got) == len(rows) and all(text(ids) in text(got) for ids in shards)
