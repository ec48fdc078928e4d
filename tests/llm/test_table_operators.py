import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fpsample.llm import jaccard, media, warc
from fpsample.llm.common import written
from fpsample.llm.fingerprints import _forms, canonical, collided, collisions, compare_neighbours, fingerprint_documents
from fpsample.llm.jaccard import Bands, Shingler, components, signatures, similar_groups
from fpsample.llm.mixing import mix_sources, mixed_rows, split_quotas, targets
from fpsample.llm.shingles import mix


# -- archives ------------------------------------------------------------------------------------------
def test_arc_round_trip_in_both_versions():
    docs = [("http://a/b c", "20240102030405", "text/html", b"HTTP/1.1 200 OK\r\n\r\nab\n\ncd"), ("", "2024", "text/plain", b""), ("http://x", "20240102", "a/b", b"\n\n")]
    for version in (1, 2):
        got = list(warc.read_arc(warc.write_arc(docs, version, "f.arc")))
        assert [r["body"] for r in got] == [d[3] for d in docs] and got[0]["URL"] == "http://a/b%20c"
        assert ("Checksum" in got[0]) == (version == 2)
    with pytest.raises(ValueError, match="declares"):
        list(warc.read_arc(warc.write_arc(docs, 1, "f.arc")[:-2]))
    assert warc.arc_date_to_warc("20240102030405") == "2024-01-02T03:04:05Z" and warc.arc_date_to_warc("x") == "1970-01-01T00:00:00Z"


def test_foreign_arcs(spark):
    page = b"<p>" + b"x" * 200
    http = b"HTTP/1.0 404 NO\r\nX-Page-Id: none\r\n\r\n" + page
    docs = [("http://a/1", "20240102030405", "text/html", http), ("http://a/2", "20240102030405", "text/html", http), ("dns:a", "20240102", "text/dns", b"20240102\na. IN A 1.2.3.4\n" + b"y" * 100)]
    good = warc.write_arc(docs, 2, "f.arc").replace(b" 200 ", b" - ").replace(b"http://a/1 ", b"http://a/1 and more ")
    arcs = spark.createDataFrame([("good", good), ("bad", good[:-40]), ("gone", b"x 1")], "path string, content binary")
    records = warc.arc_to_records(spark, arcs)
    assert Counter(r.record_type for r in records.collect()) == {"warcinfo": 2, "response": 4, "resource": 1}
    assert {(r.path, r.records_before) for r in warc.arc_rejects(spark, arcs).collect()} == {("bad", 3), ("gone", 0)}
    back = warc.read_warc(spark, warc.write_warc(spark, records)).collect()
    by = {(r.url, r.record_type): r for r in back}
    whole, again = (next(r for r in back if r.record_type == kind) for kind in ("response", "revisit"))
    assert whole.payload == page and whole.page_id is None and {whole.url, again.url} == {"http://a/1 and more", "http://a/2"}
    assert (again.payload, again.payload_bytes, again.payload_digest) == (None, len(page), hashlib.sha256(page).hexdigest())
    assert by["dns:a", "resource"].payload.endswith(b"y" * 100) and by[None, "warcinfo"].payload.startswith(b"2 0 archive")


def test_pages_of_any_length(spark):
    rows = [(i, f"http://a/{i}", "é" * (3_000_000 if i == 5 else 70_000 if i < 12 else 300) + str(i // 2)) for i in range(40)]
    got = {r.page_id: r for r in warc.pages_through_warc(spark, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()}
    for i, _, h in rows:
        first = min(j for j, _, x in rows if x == h)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].refers_to) == (len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), None if first == i else first)


def test_pages_through_warc(spark):
    long = "é" * 60
    rows = [(5, "u", long), (3, "v", long), (9, None, long), (1, "w", "short"), (2, "w", "short"), (4, "z", None), (None, "n", long), (7, "q", "a\r\n\r\nb" * 50), (8, "q", "WARC/1.1\r\n\r\n" * 20), (3, "v", long)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string").repartition(3)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.pages_through_warc(spark, df).collect())
    want = Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        first = min((j for j, _, x in rows if x == h and j is not None), default=None)
        again = len(p) >= 100 and i != first
        want[i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert got == want
    assert warc.pages_through_warc(spark, df.filter("false")).count() == 0


# -- media ---------------------------------------------------------------------------------------------
def test_gear_and_cuts():
    rng = random.Random(3)
    data = bytes(rng.randrange(256) for _ in range(5000))
    h, want = 0, []
    for b in data:
        h = (h * 2 + int(media._GEAR[b])) % 2**64
        want.append(h)
    assert media.gear(np.frombuffer(data, np.uint8)).tolist() == want
    parts = media.chunk(data * 20)
    assert b"".join(parts) == data * 20 and all(media.LEAST <= len(p) <= media.MOST for p in parts[:-1]) and len(set(parts)) < len(parts)
    assert media.cuts(b"") == [] and media.cuts(b"a") == [1] and len(media.chunk(bytes(100_000))) == 7
    block = media.BLOCK_BYTES
    media.BLOCK_BYTES = 1000
    assert media.chunk(data * 20) == parts
    media.BLOCK_BYTES = block
    with pytest.raises(ValueError, match="cut short"):
        media.from_wave(media.to_wave(data)[:-1])


def test_media_facts(spark, documents, odd, none):
    again = documents.unionByName(documents.filter("doc_id % 3 = 0").selectExpr("doc_id + 100000 as doc_id", "concat(text, text) as text", "lang", "source", "n_chars"))
    for df in (again, odd):
        rows = df.collect()
        want = Counter()
        for r in rows:
            b = (r.text or "").encode()
            p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
            m = struct.pack("<4sI8sIHHIIHH4sI", b"RIFF", 36 + len(p), b"WAVEfmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(p)) + p
            want[r.doc_id, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), media.features(p)] += 1
        got = media.media_facts(spark, df).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        assert Counter(map(tuple, got.collect())) == want
    store, foreign = media.store_media(spark, again)
    assert foreign.count() > 10 and store.count() == again.count()
    assert media.media_facts(spark, none).count() == 0


# -- fingerprints --------------------------------------------------------------------------------------
def test_neighbours_as_brute_force(spark, documents, odd, none):
    for df in (documents, odd):
        rows = sorted(df.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), hashlib.sha256((r.text or "").encode()).hexdigest()))
        want = Counter()
        for r, s in zip(rows, [*rows[1:], rows[0]], strict=True):
            t, n = r.text or "", s.text or ""
            half = len(t) // 2
            e = t[: len(t) - half] + n[:half]
            want[r.doc_id, len(t), hashlib.sha256(e.encode()).hexdigest(), float(canonical(t) == canonical(e)), float(canonical(t) == canonical(n))] += 1
        got = compare_neighbours(spark, df).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == want
        same = defaultdict(set)
        text = defaultdict(set)
        for r in rows:
            text[r.doc_id].add(canonical(r.text))
        for r in got:
            assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1)
            same[r.fingerprint] |= text[r.doc_id] if len(text[r.doc_id]) == 1 else set()
        assert all(len(x) <= 1 for x in same.values())
    assert compare_neighbours(spark, none).count() == 0


def test_canonical_and_fingerprints(spark, odd):
    assert canonical(" ＡＢ\t ﬁ\nÉ ") == canonical("ab FI é") and canonical(None) == ""
    got = fingerprint_documents(spark, odd)
    assert got.columns == [*odd.columns, "fingerprint"]
    by = defaultdict(set)
    for r in got.collect():
        by[r.fingerprint].add(canonical(r.text))
    assert all(len(x) == 1 for x in by.values())


def test_different_bytes_in_one_bucket_are_found(spark, documents):
    def forged(batches):  # a digest of two values
        import pyarrow as pa

        for b in batches:
            forms = [t[:50] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(["b0" if ord(f[0]) % 2 else "b1" for f in forms]), pa.array(forms)], ["bucket", "form"])

    repeated = spark.createDataFrame([("b0",), ("b1",)], "bucket string")
    assert {r.bucket for r in collisions(spark, documents, repeated, forged).collect()} == {"b0", "b1"}
    assert collisions(spark, documents, documents.select("text").mapInArrow(_forms, "bucket string, form string").select("bucket").distinct()).count() == 0


def test_digests_that_collide_are_found_in_edited_texts_too(spark, documents):
    rows = [(b"b1", b"s1", b"b2", b"s2"), (b"b3", b"s3", b"b2", b"s4"), (b"b5", b"s5", b"b1", b"s1"), (b"b6", b"s6", b"b3", b"s9")]
    got = collided(spark, documents.filter("false"), spark.createDataFrame(rows, "bucket binary, sha binary, e_bucket binary, e_sha binary"))
    assert {bytes(r.bucket) for r in got.collect()} == {b"b2", b"b3"}


# -- similarity ----------------------------------------------------------------------------------------
def brute_groups(rows, width=3, percent=90):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    index = defaultdict(list)
    for i, s in enumerate(sets):
        near = Counter(j for x in s for j in index[x])
        for j, n in near.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for x in s:
            index[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def edited(words, rng, n):
    w = list(words)
    for _ in range(n):
        k = rng.randrange(3)
        i = rng.randrange(len(w))
        if k == 0:
            w[i] = f"new{rng.randrange(30)}"
        elif k == 1 and len(w) > 5:
            del w[i]
        else:
            w.insert(i, f"in{rng.randrange(30)}")
    return w


def families(seed, percent):
    """Bases, copies with few edits, copies of copies, cut texts, and texts that share long passages."""
    rng = random.Random(seed)
    rows = []
    for f in range(12):
        n = rng.choice([4, 9, 12, 20, 40, 80, 150, 300])
        base = [f"w{f}-{rng.randrange(10**6)}" for _ in range(n)]
        held = [base] if f % 3 else []
        for _ in range(60):
            source = rng.choice(held or [base])
            if rng.random() < 0.2:
                cut = rng.randrange(0, 1 + n // 6)
                held.append(source[cut:] if rng.random() < 0.5 else source[: len(source) - cut])
            else:
                held.append(edited(source, rng, rng.randrange(0, 2 + n // 25)))
        rows += held
    passage = [f"p{i}" for i in range(60)]
    rows += [[f"o{j}-{i}" for i in range(rng.randrange(1, 30))] + passage for j in range(40)]
    rows += [["a"], ["a"], ["a", "b"], [], []]
    rng.shuffle(rows)
    return [(i * 7 % 100_003, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 90), (2, 3, 90), (3, 5, 80)])
def test_groups_as_brute_force(spark, seed, width, percent):
    rows = families(seed, percent)
    got = similar_groups(spark, spark.createDataFrame(rows, "doc_id long, text string"), width, percent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_groups(rows, width, percent)


def test_members_meet_in_what_few_have_in_common(spark, monkeypatch):
    """Copies of one text with some edits each, most of them too many for a link: all share what makes their representative differ."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(140)]
    rows = [(i, " ".join(edited(base, rng, rng.randrange(2, 6)))) for i in range(300)]
    made = Counter()

    def counted(spark, df, name):
        out = written(spark, df, name)
        made[name] += out.count() if name == "jaccard-member-pairs" else 0
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    got = similar_groups(spark, spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_groups(rows, 5, 80)
    assert made["jaccard-member-pairs"] <= len(rows)


def test_ranks_follow_counts(spark):
    """Ranks rise with the counts of tokens, wherever their rows are; the parity bits never rule out what two members share."""
    tokens = mix(np.arange(1, 9, dtype=np.uint64))
    rows = [(int(t),) for i, t in enumerate(tokens.view(np.int64)) for _ in range(4**i)]
    df = spark.createDataFrame(rows, "token long").repartition(5)
    read = lambda b: b.column("token").to_numpy(zero_copy_only=False).view(np.uint64)
    ranks = jaccard.Rarity(spark, df, read, len(rows)).of(tokens).tolist()
    assert ranks == [min(255, round(8 * math.log2(1 + 4**i))) for i in range(8)]

    rng = random.Random(3)
    every = list(range(1, 200))
    own = {x: rng.sample(every, rng.randrange(20, 120)) for x in range(6)}
    pairs = spark.createDataFrame([(x, 1, x, len(o), 0, 0, 500, 500, 500, o) for x, o in own.items()], "x long, r long, home long, d long, b long, e long, seeks int, gives int, take int, own array<long>")
    names = "x long, r long, home long, d long, b long, e long, seeks int, gives int, token long, at long, p0 long, p1 long, p2 long, p3 long"
    rarity = jaccard.Rarity(spark, pairs, jaccard._own_tokens, 600)
    found = defaultdict(list)
    bits = {}
    for r in pairs.mapInArrow(jaccard._prefixes(rarity), names).collect():
        found[r.x].append((r.at, r.token))
        bits[r.x] = [r[f"p{i}"] % (1 << 64) for i in range(4)]
    for x, held in found.items():
        assert len({t for _, t in held}) == len(own[x]) and [a for a, _ in sorted(held)] == list(range(len(held)))
        names_of = [t % (1 << 64) for _, t in sorted(held)]
        ranked = list(zip(rarity.of(np.array(names_of, np.uint64)).tolist(), names_of, strict=True))
        assert ranked == sorted(ranked)
    for x in own:
        for y in own:
            odd = sum((a ^ b).bit_count() for a, b in zip(bits[x], bits[y], strict=True))
            assert odd <= len(set(own[x]) ^ set(own[y]))


def test_groups_of_documents_and_odd_rows(spark, documents, odd, none):
    long = " ".join(f"w{i % 7919}-{i % 104729}" for i in range(120_000))
    very = spark.createDataFrame([(700, long), (701, long + " and more"), (702, long[: len(long) // 2])], "doc_id long, text string")
    for df in (documents, odd, odd.select("doc_id", "text").union(very)):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = similar_groups(spark, df)
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_groups(rows)
    assert similar_groups(spark, none).count() == 0


def test_linked_sets_share_a_signature():
    rng = random.Random(5)
    for percent in (80, 90):
        bands = Bands(percent)
        for _ in range(1500):
            a = {rng.getrandbits(64) for _ in range(rng.randrange(1, rng.choice([15, 60, 900])))}
            b = set(a)
            for _ in range(bands.differences(len(a))):
                b ^= {rng.choice(sorted(a))} if rng.random() < 0.6 else {rng.getrandbits(64)}
            if a != b and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = (set(signatures(np.unique(np.array(list(s), np.uint64)), bands).tolist()) for s in (a, b))
                assert x & y


def test_linked_sets_far_apart_in_size_share_a_signature():
    rng = random.Random(6)
    for percent in (51, 55, 60, 66):
        bands = Bands(percent)
        for size in (*range(1, 60), 400):
            a = [rng.getrandbits(64) for _ in range(100 * size // percent)]
            x, y = (set(signatures(np.unique(np.array(s, np.uint64)), bands).tolist()) for s in (a[:size], a))
            assert len(a) == size or x & y, (percent, size)
    for percent in (80, 90):  # the registered queries' levels are at most two, as ever
        assert all(len(Bands(percent).levels(n)) <= 2 for n in range(1, 3000))


@pytest.mark.parametrize("percent", [51, 60])
def test_low_thresholds_as_brute_force(spark, percent):
    rows = families(4, percent)
    got = similar_groups(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3, percent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_groups(rows, 3, percent)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 202), (202, 200)]
    got = components(spark, spark.createDataFrame(edges, "a long, b long"))
    assert {r.v: r.root for r in got.collect()} == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200, 202: 200}


def test_shingles_do_not_depend_on_blocks():
    import pyarrow as pa

    from fpsample.llm import shingles

    rng = random.Random(8)
    texts = [rng.choice([" ", "\t", "\n", "  "]).join(rng.choice(["a", "A", "b", "ab", "Ab", "é", "É", "x" * 30, "c\0"]) for _ in range(rng.choice([0, 1, 2, 3, 5, 10, 50]))) for _ in range(200)] + [None, "", " "]

    def brute(t, width):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()

    block = shingles.BLOCK
    for shingles.BLOCK in (7, 64, block):
        for width in (3, 5):
            got = shingles.shingle_hashes(pa.array(texts), width)
            want = [brute(t, width) for t in texts]
            for _ in range(3000):
                i, j = rng.randrange(len(texts)), rng.randrange(len(texts))
                assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])
    shingles.BLOCK = block


def test_shingles_of_short_texts():
    s = Shingler(3)
    assert len(s("")) == len(s(None)) == len(s(" \t ")) == 0 and len(s("a b")) == 1 and s("A b") == s("a B") and len(s("a b c a b c")) == 3


# -- mixtures ------------------------------------------------------------------------------------------
def test_targets_share_the_excess():
    assert targets([100, 100, 100]) == [200.0, 250 / 3, 500 / 3]
    t = targets([10, 1000, 10, 0, 500])
    assert abs(sum(t) - 1.5 * 1520) < 1e-6 and t[0] == 20 and t[3] == 0 and all(x <= 2 * w + 1e-9 for x, w in zip(t, [10, 1000, 10, 0, 500], strict=True))
    assert targets([]) == [] and targets([0]) == [0.0]


def test_tree_splits_quotas_exactly():
    for q in ([5, 0, 17, 100], [1], [0, 0]):
        tree = split_quotas(q, 7, 3)
        assert tree.sum(axis=1).tolist() == q and np.ptp(tree.sum(axis=0)) <= 1 and (tree >= 0).all() and (tree == split_quotas(q, 7, 3)).all()
    many = np.array([split_quotas([30, 70], 4, s)[0] for s in range(400)])
    assert abs(many.mean() - 7.5) < 0.2 and many.std() > 1


def brute_targets(words, weights=(3, 1, 2)):
    """Shares found one excess at a time: the source furthest above twice its size is filled first."""
    fixed = {i: 0.0 for i, w in enumerate(words) if w == 0}
    while True:
        rest = [i for i in range(len(words)) if i not in fixed]
        left = 1.5 * sum(words) - sum(fixed.values())
        share = {i: left * weights[i % 3] / sum(weights[j % 3] for j in rest) for i in rest}
        over = [i for i in rest if share[i] > 2 * words[i]]
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(words))]
        worst = max(over, key=lambda i: share[i] / words[i])
        fixed[worst] = 2.0 * words[worst]


def test_mix_as_brute_force(spark, documents, odd):
    from pyspark.sql import functions as F

    for df in (documents, odd, documents.union(documents.filter("doc_id < 40").withColumn("source", F.lit(None).cast("string")))):
        df = df.select("doc_id", "text", "source").withColumns({"u": F.xxhash64("doc_id", "text", F.lit(17)), "v": F.xxhash64("text", F.lit(17), "doc_id")})
        out = mix_sources(spark, df, shards=5).collect()
        by = defaultdict(list)
        for r in out:
            by[r.source].append(r)
        names = sorted(by, key=lambda s: (s is None, s or ""))
        goals = brute_targets([sum(r.size for r in by[s]) for s in names])
        drawn = np.zeros((len(names), 5), int)
        for i, (s, goal) in enumerate(zip(names, goals, strict=True)):
            rows = sorted(by[s], key=lambda r: (r.u, r.v))
            words = sum(r.size for r in rows)
            passes = min(2, int(goal // words)) if words else 0
            rest = goal - passes * words if passes < 2 else 0
            upto, want = 0, Counter()
            for r in rows:
                upto += r.size
                want[r.doc_id, r.text, passes + (upto - r.size / 2 <= rest and 0 < rest)] += 1
            assert Counter((r.doc_id, r.text, r.copies) for r in rows) == want or all(not r.size for r in rows), s
            assert all(abs(r.target - goal) < 1e-6 for r in rows)
            # a block of a pass goes to one shard as a whole, and shards have as many blocks as the tree gave them
            blocks = min(4096, -(-len(rows) // 256))
            block = lambda r: ((r.u + 2**63) >> 33) * blocks >> 31  # noqa: B023, E731
            runs = {(c, block(r)): x for r in rows for c, x in enumerate(r.shards)}
            assert all(runs[c, block(r)] == x for r in rows for c, x in enumerate(r.shards))
            order = [runs[k] for k in sorted(runs)]
            assert order == sorted(order)
            for x in runs.values():
                drawn[i, x] += 1
        assert np.ptp(drawn.sum(axis=0)) <= 1 + sum(len(by[s]) < 256 for s in names)


def test_rows_alike_are_taken_in_part(spark):
    for ids in ([None] * 40, [3] * 40, list(range(40))):
        rows = [(i, "one two three", "a") for i in ids] + [(1000 + i, "x y z u v", "b") for i in range(60)] + [(2000, None, None)]
        out = mix_sources(spark, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
        for s in ("a", "b"):
            own = [r for r in out if r.source == s]
            assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 2.5, (ids[0], s)


def test_mix(spark, documents, odd, none):
    import re

    for df in (documents, odd):
        out = mix_sources(spark, df).collect()
        assert len(out) == df.count() and sorted(map(repr, out)) == sorted(map(repr, mix_sources(spark, df.repartition(5)).collect()))
        sizes, source, taken, most = Counter(), {}, Counter(), Counter()
        for r in out:
            n = len(re.findall(r"[^ \t-\r]+", r.text or ""))
            assert r.size == n and r.copies in (0, 1, 2) and len(r.shards) == r.copies and all(0 <= s < 8 for s in r.shards)
            sizes[r.source] += n
            taken[r.source] += n * r.copies
            most[r.source] = max(most[r.source], n)
            source[r.source] = (r.source_size, r.target)
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        for s, t in zip(names, targets([sizes[s] for s in names]), strict=True):
            assert source[s][0] == sizes[s] and abs(source[s][1] - t) < 1e-6 and abs(taken[s] - t) <= most[s] / 2 + 1
    mixed = mix_sources(spark, documents)
    assert mixed_rows(mixed).count() == sum(r.copies for r in mixed.collect())
    assert mix_sources(spark, none).count() == 0
