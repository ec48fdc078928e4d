import itertools
import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fpsample.functions import kernels as K
from fpsample.functions.nano import ONE, validate
from fpsample.operators import clustering as C
from fpsample.operators import containers as H
from fpsample.operators import inclusion as I
from fpsample.operators import measure as M
from fpsample.operators import population as P
from fpsample.operators import sampling as S
from fpsample.operators.criteria import VarNHT
from fpsample.operators.design import Design, switch, systematic
from fpsample.operators.search import AStar, Start, iterate
from fpsample.plans import recipes
from fpsample.sources import tables
from fpsample.sources.generators import check_size, rng


def units(spark, pis):
    return spark.createDataFrame([(i, round(p * ONE)) for i, p in enumerate(pis)], "unit_id long, pi_nano long")


def samples_of(design):
    return {tuple(r.ids): r.prob_nano for r in design.samples.collect()}


# -- designs -------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("pis", "want"),
    [
        ((0.5, 0.5, 0.5, 0.5), {(0, 2): 0.5, (1, 3): 0.5}),
        ((0.6, 0.6, 0.8), {(0, 1): 0.2, (0, 2): 0.4, (1, 2): 0.4}),
        ((1.0, 0.5, 0.5), {(0, 1): 0.5, (0, 2): 0.5}),
        ((0.1, 1.0, 0.9), {(0, 1): 0.1, (1, 2): 0.9}),
    ],
)
def test_systematic_by_hand(spark, pis, want):
    assert samples_of(Design.from_population(units(spark, pis))) == {k: round(v * ONE) for k, v in want.items()}


def test_population_must_be_sound(spark):
    for pis in ((0.5, 0.6), (1.2, 0.8), (-0.1, 1.1)):
        with pytest.raises(ValueError, match="inclusion"):
            validate(units(spark, pis))
    with pytest.raises(ValueError, match="no units"):
        validate(units(spark, (0.5, 0.5)).filter("false"))


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_design_keeps_inclusion_whatever_the_partitions(spark, partitions):
    rows = np.random.default_rng(3).integers(1, 400, 300)
    u = spark.createDataFrame([(i, int(s)) for i, s in enumerate(rows)], "unit_id long, size long").repartition(partitions)
    bars = I.proportional(u, "size", 7)
    d = Design(systematic(bars))
    assert {r.unit_id: r.pi_nano for r in d.inclusion().collect()} == {r.unit_id: r.pi_nano for r in bars.filter("pi_nano > 0").collect()}
    got = d.samples.collect()
    assert sum(r.prob_nano for r in got) == ONE and all(len(set(r.ids)) == 7 for r in got)
    for _ in range(3):
        d = d.iterate(0.7, seed=partitions)
    assert d.changes == 3 and {r.unit_id: r.pi_nano for r in d.inclusion().collect()} == {r.unit_id: r.pi_nano for r in bars.filter("pi_nano > 0").collect()}


def pair(spark, a, b):
    return spark.createDataFrame([(0, a, b)], "design_id long, s1 struct<prob_nano:long,ids:array<long>>, s2 struct<prob_nano:long,ids:array<long>>")


@pytest.mark.parametrize(
    ("coefficient", "want"),
    [(0.5, {(1, 2): 0.25, (0, 2): 0.25, (0, 3): 0.25, (1, 3): 0.25}), (1.0, {(1, 2): 0.5, (0, 3): 0.5})],
)
def test_switch_by_hand(spark, coefficient, want):
    got = switch(pair(spark, (ONE // 2, [0, 2]), (ONE // 2, [1, 3])), coefficient).collect()
    assert {tuple(r.ids): r.prob_nano for r in got} == {k: round(v * ONE) for k, v in want.items()}


def test_switch_merges_equal_and_keeps_nested_samples(spark):
    assert [(r.prob_nano, r.ids) for r in switch(pair(spark, (5, [1, 2]), (7, [2, 1]))).collect()] == [(12, [1, 2])]
    assert sorted((r.prob_nano, r.ids) for r in switch(pair(spark, (5, [1, 2]), (7, [1]))).collect()) == [(5, [1, 2]), (7, [1])]


def test_design_algebra(spark):
    d = Design.from_population(units(spark, (0.5, 0.5, 0.5, 0.5)))
    assert samples_of(d.push(spark.createDataFrame([(0, [9]), (3, [1])], "prob_nano long, ids array<long>"))) == samples_of(d) | {(1,): 3}
    top, rest = d.pull(1)
    assert [tuple(r.ids) for r in top.collect()] == [(0, 2)] and list(samples_of(rest)) == [(1, 3)]
    twice = Design(d.samples.unionByName(d.samples))
    assert samples_of(twice.merge_identical()) == {k: 2 * v for k, v in samples_of(d).items()}
    assert {(r.i, r.j): r.pi_nano for r in d.joint_inclusion().collect()} == {(0, 2): ONE // 2, (1, 3): ONE // 2}
    assert {(r.unit_id, r.y0, r.y1) for r in d.bars().collect()} == {(0, 0, ONE // 2), (2, 0, ONE // 2), (1, ONE // 2, ONE), (3, ONE // 2, ONE)}
    assert d.signature().collect() == Design(d.samples.withColumn("seq", -F.col("seq"))).signature().collect()


def test_variance_by_hand(spark):
    u = units(spark, (0.5, 0.5, 0.5, 0.5)).withColumn("x", F.col("unit_id") + 1.0)
    assert abs(VarNHT(u)(Design.from_population(u)).first().value - 4) < 1e-9


# -- search -----------------------------------------------------------------------------------------------
def test_search_improves_and_keeps_inclusion(spark):
    u = I.proportional(spark.createDataFrame([(i, 10 + i % 7, float(i * i % 13)) for i in range(30)], "unit_id long, size long, x double"), "size", 4)
    s = AStar(Design(systematic(u)), VarNHT(u), switch_coefficient=1.0, seed=2)
    s.run(40, 5, 200)
    best = s.best_design(spark)
    assert s.best_value <= s.initial_value and abs(VarNHT(u)(best).first().value - s.best_value) < 1e-6 * max(1, s.best_value)
    assert {r.unit_id: r.pi_nano for r in best.inclusion().collect()} == {r.unit_id: r.pi_nano for r in u.collect()}
    chains = s.run_chains(spark, 3, 10, 3, 50).collect()
    assert len(chains) == 3 and all(c.value <= s.initial_value and sum(x.prob_nano for x in c.design) == ONE for c in chains)
    assert s.run(5, 2, 10, mode="greedy") <= 5


def test_search_of_a_large_design_holds_its_changes_only(spark):
    u = I.proportional(spark.createDataFrame([(i, 10 + i % 7, float(i * i % 13)) for i in range(8000)], "unit_id long, size long, x double"), "size", 3)
    s = AStar(Design(systematic(u)), VarNHT(u), switch_coefficient=1.0, seed=2)
    tracemalloc.start()
    s.run(6, 5, 100)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20 << 20 and s.best_value < s.initial_value  # the matrix of members alone would take 512 MB
    assert abs(VarNHT(u)(s.best_design(spark)).first().value - s.best_value) < 1e-6 * s.best_value


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.frozensets(st.integers(0, 8), min_size=3, max_size=3), st.integers(1, 50), min_size=1, max_size=8), st.integers(0, 99), st.booleans())
def test_changes_follow_whole_designs(design, seed, random_pull):
    a, b = np.random.default_rng(seed), np.random.default_rng(seed)
    start, changes, whole = Start(design), {}, design
    for _ in range(6):
        changes, whole = start.iterate(changes, a, 0.7, random_pull), iterate(whole, b, 0.7, random_pull)
        assert start.with_changes(changes) == whole
        ranked = sorted(whole, key=lambda s: (-whole[s], sorted(s)))
        assert start.pick(changes, range) == ranked


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.frozensets(st.integers(0, 8), min_size=3, max_size=3), st.integers(1, 1000), min_size=1, max_size=6), st.integers(0, 99), st.floats(0, 1))
def test_iterate_in_memory_keeps_inclusion(design, seed, coefficient):
    def fip(d):
        return Counter({i: sum(p for s, p in d.items() if i in s) for i in range(9)})

    assert fip(iterate(design, np.random.default_rng(seed), coefficient)) == fip(design)


# -- clusters -----------------------------------------------------------------------------------------------
def population(seed, n, k):
    r = np.random.default_rng(seed)
    p = r.random(n)
    return r.random((n, 2)), p / p.sum() * k


@pytest.mark.parametrize("seed", range(5))
def test_soft_clusters_have_mass_one(seed):
    n, k = 100 + 25 * (seed % 3), 3 + seed % 4
    points, p = population(seed, n, k)
    mass = C.SoftBalancedKMeans(k, tolerance=5, seed=seed)._run(points, p[:, None])
    assert np.abs(mass.sum(axis=0) - 1).max() < 1e-5 and abs(mass.sum() - k) < 1e-5 and (mass >= 0).all()


def test_first_moves_are_those_of_all_in_order():
    points, p = population(3, 300, 4)
    points = points.round(1)  # ties
    mass = np.zeros((300, 4))
    mass[np.arange(300), np.arange(300) % 3] = p
    every = K.candidates(points, mass, points[:4], 1e-9)
    for most in (1, 2, 17, 299, 300, 500):
        assert all(np.array_equal(a[:most], b) for a, b in zip(every, K.candidates(points, mass, points[:4], 1e-9, most), strict=True))


def test_soft_clusters_keep_small_units_whole():
    points, p = population(2, 4000, 4)
    mass = C.SoftBalancedKMeans(4, seed=1)._run(points, p[:, None])
    assert np.abs(mass.sum(axis=0) - 1).max() < 1e-9 and np.abs(mass.sum(axis=1) / p - 1).max() < 0.01


def test_soft_needs_mass_k():
    points, p = population(1, 50, 4)
    with pytest.raises(ValueError, match="sum"):
        C.SoftBalancedKMeans(3)._run(points, p[:, None])


@pytest.mark.parametrize("kind", [C.AggregateBalancedKMeans, C.DublyBalancedKMeans, C.OneBoundaryBalancedKMeans])
def test_fits_share_units_whole(spark, kind):
    points, p = population(7, 120, 4)
    u = spark.createDataFrame([(i, float(x), float(y), float(q), i % 2) for i, ((x, y), q) in enumerate(zip(points, p, strict=True))], "unit_id long, x double, y double, pi double, half int")
    one = kind(4, seed=1).fit(u, ["x", "y"], ["pi"]).collect()
    share = Counter()
    for r in one:
        share[r.unit_id] += r.frac
    assert len(share) == 120 and all(abs(v - 1) < 1e-9 for v in share.values())
    total = Counter()
    for r in one:
        total[r.cluster_id] += r.mass
    if kind is not C.OneBoundaryBalancedKMeans:
        assert all(abs(t - 1) < 1.1e-3 for t in total.values()) and len(total) == 4
    both = kind(2, seed=1).fit(u, ["x", "y"], ["pi"], by=["half"])
    assert both.columns == ["half", "unit_id", "cluster_id", "frac", "mass"] and both.select("half").distinct().count() == 2


def test_transfer_rules_by_hand(spark):
    assert abs(K.moved_mass(0.4, 1.3, 0.8, 1.0) - 0.2) < 1e-12 and abs(K.moved_mass(0.4, 1.4, 1.2, 1.0) - 0.1) < 1e-12
    row = spark.range(1).select(C.transfer_fraction(*map(F.lit, (1.0, 0.4, 1.3, 0.8, 1.0))).alias("a"), C.transfer_fraction(*map(F.lit, (1.0, 0.4, 1.4, 1.2, 1.0))).alias("b"), C.transfer_fraction(*map(F.lit, (1.0, 0.0, 1.4, 1.2, 1.0))).alias("c")).first()
    assert (round(row.a, 9), round(row.b, 9), row.c) == (0.5, 0.25, 1.0)


def test_relational_candidates_as_in_the_kernel(spark):
    points, p = population(11, 60, 4)
    labels = np.arange(60) % 4
    mass = np.zeros((60, 4))
    mass[np.arange(60), labels] = p
    centres = K.centroids(points, mass, np.zeros((4, 2)))
    cost, unit, old, new = K.candidates(points, mass, centres, 1e-3)
    u = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "unit_id long, x double, y double")
    m = spark.createDataFrame([(i, int(labels[i]), 1.0, float(p[i])) for i in range(60)], "unit_id long, cluster_id int, frac double, mass double")
    c = spark.createDataFrame([(j, float(x), float(y)) for j, (x, y) in enumerate(centres)], "cluster_id int, x double, y double")
    got = [(r.unit_id, r.old, r.new) for r in C.transfer_candidates(m, u, c, ["x", "y"], 20, 1e-3).collect()]
    assert got == list(zip(unit.tolist(), old.tolist(), new.tolist(), strict=True))[:20]


def test_capacities_are_kept_at_least_cost():
    r = np.random.default_rng(4)
    points, centres = r.random((7, 2)), r.random((3, 2))
    labels = K.capacitated(points, centres, 2, 3)
    d = K.squares(points, centres)
    best = min(sum(d[i, j] for i, j in enumerate(w)) for w in itertools.product(range(3), repeat=7) if all(2 <= w.count(j) <= 3 for j in range(3)))
    assert sorted(np.bincount(labels, minlength=3)) == [2, 2, 3] and abs(d[np.arange(7), labels].sum() - best) < 1e-9


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.integers(0, 10**6))
def test_assignment_is_least(n, seed):
    cost = np.random.default_rng(seed).random((n, n))
    got = K.assignment(cost)
    assert sorted(got) == list(range(n))
    assert abs(cost[np.arange(n), got].sum() - min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))) < 1e-9


def test_hull():
    points = np.array([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0), (2, 1)], float)
    assert K.hull(points).tolist() == [[0, 0], [2, 0], [2, 2], [0, 2]] and len(K.hull(points[:1])) == 1


# -- zones and samples --------------------------------------------------------------------------------------
def test_sweep_by_hand(spark):
    u = spark.createDataFrame([(0, 0.0, 300), (1, 1.0, 400), (2, 2.0, 300)], "unit_id long, x double, m long")
    for group in ([], ["g"]):
        got = {(r.zone, r.unit_id): r.m for r in P.sweep(u.withColumn("g", F.lit(1)), group, ["x", "unit_id"], "m", 2, "zone").collect()}
        assert got == {(0, 0): 300, (0, 1): 200, (1, 1): 200, (1, 2): 300}


@pytest.mark.parametrize(("n", "z"), [(4, 2), (5, 3), (6, 4)])
def test_zones_are_equal(spark, n, z):
    points, p = population(n, 100 + 10 * n, n)
    u = spark.createDataFrame([(i, float(x), float(y), float(q)) for i, ((x, y), q) in enumerate(zip(points, p, strict=True))], "unit_id long, x double, y double, pi double")
    pop = P.Population(u, n_clusters=n, n_zones=z, tolerance=5)
    got = P.zone_totals(pop.zones, ["cluster_id"]).collect()
    total = Counter()
    for r in got:
        total[r.cluster_id] += r.mass
    assert len(got) == n * z * z and all(abs(r.mass - total[r.cluster_id] / z**2) <= 2 for r in got)
    s = S.KMeansSpatialSampling(u, n=n, n_zones=z, population=pop, seed=4)
    draws = s.sample(60).collect()
    assert Counter(r.draw_id for r in draws) == {d: n for d in range(60)}
    exact = Design(s.design()).inclusion().agg(F.sum("pi_nano")).first()[0]
    assert exact == n * ONE
    assert pop.plot().count() > 3 * n and pop.plot_with_samples(s.sample(3), 2).count() == 3 * n


def test_stabiliser_by_hand(spark):
    z = spark.createDataFrame([(0, 0, 0.2), (1, 0, 0.2), (2, 1, 0.0001)], "unit_id long, zone_id int, mass double")
    got = P.stabilised_zones(z, [], (1, 2), 3).collect()
    assert [(r.unit_id, round(r.mass, 9)) for r in got] == [(0, 0.25), (1, 0.25)]


def test_samplers_hold_inclusion_probabilities(spark):
    points, p = population(2, 12, 4)
    p = np.minimum(p, 0.95)
    p = p / p.sum() * 4
    u = spark.createDataFrame([(i, float(x), float(q)) for i, ((x, _), q) in enumerate(zip(points, p, strict=True))], "unit_id long, x double, pi double")
    for draws in (S.local_pivotal(u, ["x"], 3000, seed=1), S.conditional_poisson(u, 3000, seed=1)):
        rows = draws.collect()
        assert Counter(Counter(r.draw_id for r in rows).values()) == {4: 3000}
        seen = Counter(r.unit_id for r in rows)
        assert all(abs(seen[i] / 3000 - p[i]) < 4.5 * math.sqrt(p[i] * (1 - p[i]) / 3000) for i in range(12))
    srs = Counter(r.unit_id for r in S.RandomSampling(u, 4, seed=2).sample(1500).collect())
    assert sum(srs.values()) == 6000 and all(abs(srs[i] - 500) < 120 for i in range(12))


def test_certainty_units(spark):
    sizes = [100, 50, 5, 5, 5, 5, 5, 5]
    got = {r.unit_id: r for r in I.with_certainty(spark.createDataFrame(list(enumerate(sizes)), "unit_id long, size long"), "size", 3).collect()}
    assert [got[i].take_all for i in range(8)] == [True, True] + [False] * 6 and abs(sum(r.pi for r in got.values()) - 3) < 1e-9
    assert all(r.pi <= 1 for r in got.values())


# -- measures ------------------------------------------------------------------------------------------------
def test_density_without_shift_is_zero(spark):
    c = spark.createDataFrame([(0, i, i % 5 + 1, i % 5 + 1) for i in range(20)], "draw_id long, unit_id long, cnt long, cnt_shifted long")
    r = M.density_scores(c, ["draw_id"]).first()
    assert abs(r.spread) < 1e-12 and abs(r.var_scaled) < 1e-9 and abs(r.combined) < 1e-9


def test_density_ranks_spread_samples_first(spark):
    n = 100
    u = spark.createDataFrame([(i, i % 10 / 9, i // 10 / 9, 0.04) for i in range(n)], "unit_id long, x double, y double, pi double")
    s = spark.createDataFrame([(0, k, i) for k, i in enumerate((22, 27, 72, 77))] + [(1, k, i) for k, i in enumerate((0, 1, 10, 11))], "draw_id long, slot int, unit_id long")
    got = {r.draw_id: r for r in M.Density(u, 4).score(s).collect()}
    assert len(got) == 2 and got[0].var_scaled < got[1].var_scaled


def test_tophat_meets_places_not_copies(spark, monkeypatch):
    met = []

    def counted(a, b, *rest, **more):
        met.extend([a.count(), b.count()])
        return recipes.cell_neighbours(a, b, *rest, **more)

    monkeypatch.setattr(M, "cell_neighbours", counted)
    rows = [(i, (i * i) % 6 / 10, (i % 5) / 10) for i in range(900)]
    got = {r.unit_id: r.cnt for r in M.tophat_counts(spark.createDataFrame(rows, "unit_id long, x double, y double"), ["x", "y"], 0.15).collect()}
    assert got == {i: sum((x - u) ** 2 + (y - v) ** 2 < 0.15 * 0.15 for _, u, v in rows) for i, x, y in rows}
    assert max(met) == len({r[1:] for r in rows}) < 30


# -- recipes and containers --------------------------------------------------------------------------------------
@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(recipes, "BUCKET_ROWS", 50)


def test_two_phase_sums_and_lookups(spark, small_buckets):
    r = np.random.default_rng(1)
    rows = [(int(k), int(v)) for k, v in zip(r.permutation(3000)[:700], r.integers(-9, 99, 700), strict=True)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    assert len(recipes.order_bounds(df, "k")) > 5
    order = sorted(rows)
    want = dict(zip([k for k, _ in order], np.cumsum([v for _, v in order]).tolist(), strict=True))
    got = recipes.running_sum(df, ["k"], "v", "s", "t").collect()
    assert {x.k: x.s for x in got} == want and {x.t for x in got} == {sum(v for _, v in rows)}
    halves = recipes.running_sum(df.withColumn("g", F.col("k") % 2), ["k"], "v", "s", "t", on=["g"]).collect()
    assert all(x.s == sum(v for k, v in rows if k % 2 == x.g and k <= x.k) and x.t == sum(v for k, v in rows if k % 2 == x.g) for x in halves) and len(halves) == 700
    nxt = dict(zip([k for k, _ in order], [k for k, _ in order][1:] + [9999], strict=True))
    assert {x.k: x.n for x in recipes.next_value(df.select("k"), "k", "n", F.lit(9999)).collect()} == nxt
    q = spark.createDataFrame([(i, int(k)) for i, k in enumerate(r.integers(-50, 3100, 400))], "id long, k long")
    keys = [k for k, _ in order]
    low = {x.id: x.floor for x in H.floor_lookup(q, df.select("k", F.col("k").alias("v")), "k", "v").collect()}
    high = {x.id: x.ceil for x in H.ceil_lookup(q, df.select("k", F.col("k").alias("v")), "k", "v").collect()}
    for x in q.collect():
        assert low[x.id] == max((k for k in keys if k <= x.k), default=None) and high[x.id] == min((k for k in keys if k >= x.k), default=None)


@pytest.mark.parametrize("lookup", [H.floor_lookup, H.ceil_lookup])
def test_lookups_walk_each_bucket_once(spark, small_buckets, lookup):
    q = spark.createDataFrame([(i, k) for i, k in enumerate([None, *range(-5, 995)])], "id long, k long").repartition(4)
    held = spark.createDataFrame([(None, -1), (0, 0), (500, 500), (990, 990)], "k long, v long")
    got = lookup(q, held, "k", "v")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()  # such a frame is read anew for every row
    floor = lookup is H.floor_lookup
    for r in got.collect():
        near = [k for k in (0, 500, 990) if r.k is not None and (k <= r.k if floor else k >= r.k)]
        assert r[2] == (max if floor else min)(near, default=None)


def test_containers(spark):
    df = spark.createDataFrame([(1, 10), (2, 30), (3, 20)], "k long, v long")
    assert [r.k for r in H.top(df, "v", ["k"], 2).collect()] == [2, 3] and H.extremes(df, "v").first() == (10, 30, 3)
    assert [r.k for r in H.in_order(df, "v").collect()] == [1, 3, 2]
    more = spark.createDataFrame([(3, 99), (4, 5), (4, 4)], "k long, v long")
    assert sorted(map(tuple, H.insert(df, more, "k").collect())) == [(1, 10), (2, 30), (3, 20), (4, 4)]
    assert H.random_row(df, 1, ["k"], 2).collect() == H.random_row(df.repartition(3), 1, ["k"], 2).collect()


def test_loop_with_checkpoints(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    out = recipes.iterate_until(spark.range(3), lambda d: d.select((F.col("id") + 1).alias("id")), lambda d: d.agg(F.min("id")).first()[0] >= 4, 10)
    assert sorted(r.id for r in out.collect()) == [4, 5, 6]


# -- sources -------------------------------------------------------------------------------------------------------
def test_shapes():
    assert check_size(None) == (1, 1, 1) and check_size(5) == (1, 5, 1) and check_size((4, 2)) == (1, 4, 2) and check_size((3, 4, 2)) == (3, 4, 2)
    for bad in (0, -1, (2, 0), (1, 2, 3, 4), (2.5,), "x"):
        with pytest.raises(ValueError):
            check_size(bad)


def test_generators(spark):
    g = rng(spark, 9)
    grid = [r.coords for r in g.grid_coordinates((3, 2)).orderBy("unit_id").collect()]
    assert grid == [[x / 2, y / 2] for y in range(3) for x in range(3)]
    cube = [r.coords for r in g.grid_coordinates((2, 3)).orderBy("unit_id").collect()]
    assert cube == np.array(np.meshgrid(*[np.linspace(0, 1, 2)] * 3)).reshape(3, -1).T.tolist()
    for df, mean, std in ((g.random_coordinates((4000, 2)), 0.5, 12**-0.5), (g.uniform_coordinates(-1, 3, 4000), 1, 4 * 12**-0.5), (g.normal_1D_coordinates(5, 2, 4000), 5, 2)):
        v = np.array([r.coords for r in df.collect()])
        assert np.abs(v.mean(axis=0) - mean).max() < 0.1 and np.abs(v.std(axis=0) / std - 1).max() < 0.05
    v = np.array([r.coords for r in g.normal_mD_coordinates([1, 2], [[2, 1], [1, 3]], (8000, 2)).collect()])
    assert np.abs(np.cov(v.T) - [[2, 1], [1, 3]]).max() < 0.2 and np.abs(v.mean(axis=0) - [1, 2]).max() < 0.1
    c = g.cluster_coordinates(3, [0.01, 0.02, 0.03], (300, 2)).collect()
    by = defaultdict(list)
    for r in c:
        by[r.cluster_id].append(r.coords)
    assert set(by) == {0, 1, 2} and all(np.std(by[j], axis=0).max() < 0.05 for j in by)
    assert g.random_coordinates(9).collect() == g.random_coordinates(9).repartition(4).orderBy("unit_id").collect()
    sums = g.unequal_probabilities(5, (3, 40, 1)).groupBy("batch_id").agg(F.sum("pi").alias("s")).collect()
    assert len(sums) == 3 and all(abs(r.s - 5) < 1e-9 for r in sums)
    with pytest.raises(ValueError):
        g.equal_probabilities(5, 4)


def test_tables(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    tables.write_table(spark.createDataFrame([("a", 1.5, 2.5, 3.5)], "NAME string, AREA double, COORD_Y double, COORD_X double"), path, "csv")
    assert tables.read_csv(spark, path).first() == (3.5, 2.5, 1.5)
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    tables.write_table(df, str(tmp_path / "p"), by=["a"])
    assert tables.read_table(spark, str(tmp_path / "p")).count() == 1 and "1 & 2" in tables.latex(df)


def test_stream_windows_as_the_table(spark, tmp_path):
    from fpsample.streaming.windows import stream_window_samples, table_window_samples

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.orderBy("ts").repartitionByRange(2, "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = stream_window_samples(stream, 3, "6 hours").writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start, r.event_id, r["rank"]) for r in spark.table("windows").collect()}
    want = {(r.start, r.event_id, r["rank"]) for r in table_window_samples(events, 3, "6 hours").collect()}
    assert got and got <= want


def test_no_size_drops_units_from_doubly_balanced_clusters(monkeypatch):
    rng = np.random.default_rng(3)
    points, p = rng.random((400, 2)), rng.uniform(0.8, 1.2, 400)
    p *= 4 / p.sum()
    seen, whole = [], C.K.constrained_kmeans
    monkeypatch.setattr(C.DublyBalancedKMeans, "MOST_COPIES", 200)  # a population larger than the cap
    monkeypatch.setattr(C.K, "constrained_kmeans", lambda x, *a: seen.append(x) or whole(x, *a))
    mass = C.DublyBalancedKMeans(4)._run(points, p[:, None])
    assert set(map(tuple, seen[0])) == set(map(tuple, points)) and np.allclose(mass.sum(axis=0), 1, atol=0.01)
    p[:200] /= 1000  # units far below the split
    C.DublyBalancedKMeans(4)._run(points, p[:, None])
    assert set(map(tuple, seen[1])) == set(map(tuple, points))


def test_running_sums_over_repeated_first_keys(spark, small_buckets):
    from pyspark.sql import functions as F

    rows = [(0 if i % 3 else i % 7, i, i % 11) for i in range(900)]
    df = spark.createDataFrame(rows, "a long, b long, v long").repartition(5)
    buckets = df.withColumn("bucket", recipes.order_buckets(df, ["a", "b"])).groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("a", "b")).alias("lo"), F.max(F.struct("a", "b")).alias("hi")).orderBy("bucket").collect()
    assert len(buckets) > 8 and max(r.n for r in buckets) < 200 and all(x.hi < y.lo for x, y in zip(buckets, buckets[1:], strict=False))
    total, want = 0, {}
    for a, b, v in sorted(rows):
        total += v
        want[b] = total
    got = recipes.running_sum(df, ["a", "b"], "v", "s", "t").collect()
    assert {r.b: r.s for r in got} == want and {r.t for r in got} == {total}
    halves = recipes.running_sum(df.withColumn("g", F.col("b") % 2), ["a", "b"], "v", "s", on=["g"]).collect()
    for g in (0, 1):
        own = sorted((r.a, r.b, r.v, r.s) for r in halves if r.g == g)
        assert [s for *_, s in own] == list(np.cumsum([v for _, _, v, _ in own]))


def test_quantiles_are_exact(spark, small_buckets):
    rng = np.random.default_rng(2)
    rows = [(g, float(x) if rng.random() > 0.1 else None) for g, n in (("a", 700), ("b", 1), ("c", 90)) for x in rng.integers(0, 300 if g == "a" else 9, n)] + [("d", None)]
    got = {r.g: r for r in recipes.quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for g in "abc":
        own = [x for k, x in rows if k == g and x is not None]
        if own:
            assert np.allclose([got[g][f"q{i}"] for i in range(5)], np.quantile(own, [0.0, 0.25, 0.5, 0.9, 1.0]))
    assert "d" not in got


def test_neighbours_do_not_depend_on_the_first_radius(spark):
    from fpsample.operators.balance import inclusion_neighbours

    rng = np.random.default_rng(5)
    units = spark.createDataFrame([(i, float(x), float(y), 0.08) for i, (x, y) in enumerate(rng.random((50, 2)))], "unit_id long, x double, y double, pi double")
    rows = {r: {(e.i, e.j): round(e.w, 9) for e in inclusion_neighbours(units, ["x", "y"], r).collect()} for r in (0.05, 0.3, 3.0)}
    assert rows[0.05] == rows[0.3] == rows[3.0]
    mass = {}
    for (i, _), w in rows[3.0].items():
        mass[i] = mass.get(i, 0) + w
    assert len(mass) == 50 and all(abs(m + 0.08 - 1) < 1e-6 for m in mass.values())


def test_moran_needs_no_pairs_of_units(spark, monkeypatch):
    from fpsample.operators import balance

    # a lattice: copies of places, and ties between places
    units = spark.createDataFrame([(i, (i * 7) % 5 / 4, (i * 3) % 8 // 2 / 4, 0.03 + i % 4 / 50) for i in range(90)], "unit_id long, x double, y double, pi double")
    samples = spark.createDataFrame([(d, s, (13 * s + 5 * d) % 90) for d in range(4) for s in range(6)], "draw_id long, slot int, unit_id long")
    every = balance.inclusion_neighbours(units, ["x", "y"], 0.3)
    ids = {r.unit_id for r in samples.collect()}
    rows, near = balance.sampled_neighbours(units, samples, ["x", "y"])
    want = {(r.i, r.j): round(r.w, 9) for r in every.collect() if r.j in ids and r.w > 1e-9}
    assert {(r.i, r.j): round(r.w, 9) for r in near.collect() if r.w > 1e-9} == want
    assert {r.i: round(r._w, 9) for r in rows.collect()} == {r.i: round(r.w, 9) for r in every.groupBy("i").agg(F.sum("w").alias("w")).collect()}
    slow = {r.draw_id: r.moran for r in balance.moran(units, samples, ["x", "y"], every).collect()}
    monkeypatch.setattr(balance, "cell_neighbours", None)
    fast = {r.draw_id: r.moran for r in balance.moran(units, samples, ["x", "y"]).collect()}
    assert len(fast) == 4 and all(abs(fast[d] - slow[d]) < 1e-9 for d in slow)


def test_signatures_follow_samples_not_their_order(spark):
    units = spark.createDataFrame([(i, 5 + i % 3) for i in range(9)], "unit_id long, sz long")
    from fpsample.operators.design import Design, systematic
    from fpsample.operators.inclusion import proportional

    design = Design(systematic(proportional(units, "sz", 3)))
    again = Design(systematic(proportional(units.repartition(7), "sz", 3)))
    other = Design(systematic(proportional(units.withColumn("sz", units["sz"] + 1), "sz", 3)))
    first, second, third = (d.signature().first().signature for d in (design, again, other))
    assert first == second != third


def test_all_scores_hold_each_measure(spark):
    from fpsample.operators import balance

    rng = np.random.default_rng(6)
    units = spark.createDataFrame([(i, float(x), float(y), 0.1) for i, (x, y) in enumerate(rng.random((60, 2)))], "unit_id long, x double, y double, pi double")
    samples = spark.createDataFrame([(d, s, (7 * s + d) % 60) for d in range(3) for s in range(6)], "draw_id long, slot int, unit_id long")
    got = {r.draw_id: r for r in balance.scores(units, samples, ["x", "y"], 6, 0.1).collect()}
    alone = {r.draw_id: r.voronoi for r in balance.voronoi_balance(units, samples, ["x", "y"]).collect()}
    spread = {r.draw_id: r.local_balance for r in balance.local_balance(units, samples, ["x", "y"]).collect()}
    assert set(got) == {0, 1, 2} and all(abs(got[d].voronoi - alone[d]) < 1e-12 and abs(got[d].local_balance - spread[d]) < 1e-12 for d in got)
    assert all(-1 <= r.moran <= 1 and 0 <= r.density <= 1 for r in got.values())


def test_maximum_entropy_by_enumeration():
    from itertools import combinations

    from fpsample.operators.sampling import _entropy

    pi = np.array([0.9, 0.2, 0.5, 0.35, 0.65, 0.4, 1.0])
    pick = _entropy(500)(pi, np.empty((7, 0)))
    n = 4000
    seen = {}
    for d in range(n):
        s = tuple(pick(np.random.default_rng([1, d])).tolist())
        seen[s] = seen.get(s, 0) + 1
    assert {len(s) for s in seen} == {4} and all(6 in s for s in seen)
    # the design of most entropy has chances that are products of odds: fit these by brute force over all samples
    subsets = list(combinations(range(6), 3))
    w = pi[:6] / (1 - pi[:6])
    for _ in range(3000):
        chance = np.array([np.prod(w[list(s)]) for s in subsets])
        chance /= chance.sum()
        got = np.array([sum(c for s, c in zip(subsets, chance, strict=True) if i in s) for i in range(6)])
        w *= pi[:6] / got * (1 - got) / (1 - pi[:6])
    assert np.abs(got - pi[:6]).max() < 1e-9
    for s, c in zip(subsets, chance, strict=True):
        assert abs(seen.get((*s, 6), 0) / n - c) < 5 * (c * (1 - c) / n) ** 0.5 + 1e-3, s


def test_maximum_entropy_of_many_units():
    from fpsample.operators.sampling import _entropy

    pi = np.random.default_rng(3).random(3000)
    pi *= 400 / pi.sum()
    pick = _entropy(50)(np.minimum(pi, 1), np.empty((3000, 0)))
    assert {len(pick(np.random.default_rng(d))) for d in range(5)} == {400}


@pytest.mark.parametrize("kind", ["pivotal", "entropy"])
def test_samples_within_strata(spark, kind):
    units = spark.createDataFrame([(i, float(i % 5), float(i % 7), 0.25, f"s{i % 3}") for i in range(120)], "unit_id long, x double, y double, pi double, s string")
    draw = (lambda: S.local_pivotal(units, ["x", "y"], 40, by=["s"])) if kind == "pivotal" else (lambda: S.conditional_poisson(units, 40, by=["s"]))
    rows = draw().collect()
    n = {}
    for r in rows:
        assert r.s == f"s{r.unit_id % 3}"
        n[r.s, r.draw_id] = n.get((r.s, r.draw_id), 0) + 1
    assert len(n) == 120 and set(n.values()) == {10} and sorted(map(tuple, rows)) == sorted(map(tuple, draw().collect()))


def test_spatial_samples_within_strata(spark):
    rng = np.random.default_rng(9)
    units = spark.createDataFrame([(i, float(x), float(y), 0.1, f"s{i % 3}") for i, (x, y) in enumerate(rng.random((120, 2)))], "unit_id long, x double, y double, pi double, s string")
    sampler = S.KMeansSpatialSampling(units, n=4, n_zones=(2, 2), seed=1, by=["s"])
    rows = sampler.sample(30).collect()
    assert all(r.s == f"s{r.unit_id % 3}" for r in rows)
    assert Counter((r.draw_id, r.s) for r in rows) == {(d, s): 4 for d in range(30) for s in ("s0", "s1", "s2")}
    assert sampler.population.nested().count() == 3 * 4 * 4
    with pytest.raises(ValueError, match="stratum"):
        sampler.design()
