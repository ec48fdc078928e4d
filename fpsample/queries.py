"""Queries of the sampling operators over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fpsample.functions.nano import ONE
from fpsample.operators import analysis as A
from fpsample.operators import balance as B
from fpsample.operators import clustering as C
from fpsample.operators import containers as H
from fpsample.operators import inclusion as I
from fpsample.operators import measure as M
from fpsample.operators import population as P
from fpsample.operators import sampling as S
from fpsample.operators.criteria import VarNHT
from fpsample.operators.design import Design, switch, systematic
from fpsample.operators.search import AStar, best_of
from fpsample.plans.recipes import cut
from fpsample.sources.generators import rng
from fpsample.sources.plotdata import facets, hulls
from fpsample.streaming.windows import table_window_samples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- populations -----------------------------------------------------------------------------------------
def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as units: size in cents, coordinates (p_size, p_retailprice)."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit_id"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("sz"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), "p_brand", "p_size")


def part_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.proportional(parts(spark, sf_dir), "sz", 20)


def part_design(spark: SparkSession, sf_dir: str) -> Design:
    return Design(systematic(part_bars(spark, sf_dir)))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit_id"), (F.col("s_nationkey").cast("bigint") + 10).alias("sz"), F.col("s_acctbal").alias("x"))


def supplier_design(spark: SparkSession, sf_dir: str) -> Design:
    return Design(systematic(I.proportional(suppliers(spark, sf_dir), "sz", 3)))


def _bars_sql(units: str, n: int) -> str:
    return f"""u AS ({units}), c AS (SELECT *, sum(sz) OVER (ORDER BY unit_id) AS cs, sum(sz) OVER () AS t FROM u),
b AS (SELECT *, CAST((CAST(cs - sz AS HUGEINT) * {n * ONE}) // t AS BIGINT) AS lo, CAST((CAST(cs AS HUGEINT) * {n * ONE}) // t AS BIGINT) AS hi FROM c),
s0 AS (SELECT DISTINCT lo % {ONE} AS s FROM b WHERE hi > lo), iv AS (SELECT s, coalesce(lead(s) OVER (ORDER BY s), {ONE}) AS e FROM s0),
m AS (SELECT s, e, unit_id FROM (SELECT s, e, s + range * CAST({ONE} AS BIGINT) AS p FROM iv, range({n})) q JOIN b ON b.lo <= q.p AND q.p < b.hi),
d AS (SELECT s, e, e - s AS p, list(unit_id ORDER BY unit_id) AS ids FROM m GROUP BY s, e)"""


PART_UNITS = "SELECT p_partkey AS unit_id, CAST(round(p_retailprice * 100) AS BIGINT) AS sz, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, p_brand, p_size FROM part"
SUPPLIER_UNITS = "SELECT s_suppkey AS unit_id, CAST(s_nationkey AS BIGINT) + 10 AS sz, s_acctbal AS x FROM supplier"
PART = "WITH " + _bars_sql(PART_UNITS, 20)
SUPPLIER = "WITH " + _bars_sql(SUPPLIER_UNITS, 3)
ids_text = lambda c="ids": F.array_join(F.col(c).cast("array<string>"), ",")


# -- designs -----------------------------------------------------------------------------------------------
@query(f"{PART} SELECT s AS start_nano, p AS prob_nano, array_to_string(ids, ',') AS ids FROM d")
def systematic_design(spark, sf_dir):
    return systematic(part_bars(spark, sf_dir)).select("start_nano", "prob_nano", ids_text().alias("ids"))


@query(f"{PART} SELECT unit_id, s AS y0, e AS y1 FROM m")
def design_bars(spark, sf_dir):
    return part_design(spark, sf_dir).bars().select("unit_id", "y0", "y1")


@query(f"{PART} SELECT unit_id, CAST(sum(e - s) AS BIGINT) AS pi_nano FROM m GROUP BY unit_id")
def design_fip(spark, sf_dir):
    return part_design(spark, sf_dir).inclusion().select("unit_id", "pi_nano")


@query(f"{SUPPLIER}, x AS (SELECT p // 2 AS p, ids FROM d UNION ALL SELECT p - p // 2, ids FROM d) SELECT CAST(sum(p) AS BIGINT) AS prob_nano, array_to_string(ids, ',') AS ids FROM x GROUP BY ids")
def design_merge(spark, sf_dir):
    s = supplier_design(spark, sf_dir).samples
    half = F.call_function("div", F.col("prob_nano"), F.lit(2))
    both = s.withColumn("prob_nano", half).unionByName(s.withColumn("prob_nano", F.col("prob_nano") - half))
    return Design(both).merge_identical().samples.select("prob_nano", ids_text().alias("ids"))


@query(f"{SUPPLIER} SELECT a.unit_id AS i, b.unit_id AS j, CAST(sum(a.e - a.s) AS BIGINT) AS pi_nano FROM m a JOIN m b ON a.s = b.s AND a.unit_id < b.unit_id GROUP BY 1, 2")
def design_sip(spark, sf_dir):
    return supplier_design(spark, sf_dir).joint_inclusion().select("i", "j", "pi_nano")


@query(f"{SUPPLIER} SELECT a.unit_id AS i, b.unit_id AS j, CAST(sum(a.e - a.s) AS BIGINT) AS pi_nano FROM m a JOIN m b ON a.s = b.s AND a.unit_id < b.unit_id GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20")
def design_sip_top(spark, sf_dir):
    return H.top(supplier_design(spark, sf_dir).joint_inclusion().select("i", "j", "pi_nano"), "pi_nano", ["i", "j"], 20)


@query(f"{PART} SELECT p AS prob_nano, array_to_string(ids, ',') AS ids FROM d ORDER BY p DESC, d.ids LIMIT 2")
def design_pull_top2(spark, sf_dir):
    return part_design(spark, sf_dir).pull(2)[0].select("prob_nano", ids_text().alias("ids"))


@query(f"{SUPPLIER}, x AS (SELECT p, ids FROM d UNION ALL SELECT p // 100000000, ids FROM d) SELECT p AS prob_nano, array_to_string(ids, ',') AS ids FROM x WHERE p >= 1")
def design_prune(spark, sf_dir):
    d = supplier_design(spark, sf_dir)
    tiny = d.samples.withColumn("prob_nano", F.call_function("div", F.col("prob_nano"), F.lit(100_000_000)))
    return d.push(tiny).samples.select("prob_nano", ids_text().alias("ids"))


_SWITCH = """, r AS (SELECT p, ids, row_number() OVER (ORDER BY p DESC, ids) AS k FROM d), q AS (SELECT a.p AS p1, a.ids AS i1, b.p AS p2, b.ids AS i2 FROM r a JOIN r b ON a.k = 1 AND b.k = 2),
n AS (SELECT *, list_min(list_filter(i1, lambda v: NOT list_contains(i2, v))) AS n1, list_min(list_filter(i2, lambda v: NOT list_contains(i1, v))) AS n2, CAST(floor(least(p1, p2) * 0.5) AS BIGINT) AS len FROM q),
f AS (SELECT len AS p, list_sort(list_append(list_filter(i1, lambda v: v <> n1), n2)) AS ids FROM n UNION ALL SELECT p1 - len, i1 FROM n
UNION ALL SELECT len, list_sort(list_append(list_filter(i2, lambda v: v <> n2), n1)) FROM n UNION ALL SELECT p2 - len, i2 FROM n)"""


@query(f"{PART}{_SWITCH} SELECT p AS prob_nano, array_to_string(ids, ',') AS ids FROM f WHERE p >= 1")
def design_switch_step(spark, sf_dir):
    top, _ = part_design(spark, sf_dir).pull(2)
    pair = top.groupBy("design_id").agg(*[F.max(F.when(F.col("rank") == r, F.struct("prob_nano", "ids"))).alias(f"s{r}") for r in (1, 2)])
    return switch(pair).select("prob_nano", ids_text().alias("ids"))


@query(f"{PART}{_SWITCH} SELECT p AS prob_nano, array_to_string(ids, ',') AS ids FROM f WHERE p >= 1 UNION ALL SELECT p, array_to_string(ids, ',') FROM r WHERE k > 2")
def design_iterate(spark, sf_dir):
    return part_design(spark, sf_dir).iterate().samples.select("prob_nano", ids_text().alias("ids"))


@query()
def design_signature(spark, sf_dir):
    return supplier_design(spark, sf_dir).signature()


@query(f"{PART}, t AS (SELECT s, e, sum(p_size / ((hi - lo) / 1e9)) AS t FROM m JOIN b USING (unit_id) GROUP BY s, e), v AS (SELECT sum((e - s) / 1e9 * t * t) - (SELECT sum(p_size) FROM b) ^ 2 AS v FROM t) SELECT round(sqrt(v) / (SELECT sum(p_size) FROM b), 6) AS cv FROM v")
def var_nht(spark, sf_dir):
    bars = part_bars(spark, sf_dir)
    total = bars.agg(F.sum("x")).first()[0]
    return VarNHT(bars)(Design(systematic(bars))).select(F.round(F.sqrt("value") / total, 6).alias("cv"))


# -- inclusion probabilities -----------------------------------------------------------------------------------
@query("""WITH u AS (SELECT doc_id AS unit_id, n_chars AS s FROM documents), o AS (SELECT *, row_number() OVER (ORDER BY s DESC, unit_id) - 1 AS k, sum(s) OVER (ORDER BY s DESC, unit_id ROWS UNBOUNDED PRECEDING) - s AS taken, sum(s) OVER () AS t FROM u),
c AS (SELECT k, taken, t FROM o WHERE (50 - k) * s <= t - taken ORDER BY k LIMIT 1)
SELECT o.unit_id, o.k < c.k AS take_all, round(CASE WHEN o.k < c.k THEN 1 ELSE o.s * CAST(50 - c.k AS DOUBLE) / CAST(c.t - c.taken AS DOUBLE) END, 9) AS pi FROM o, c""")
def pps_takeall(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), "n_chars")
    return I.with_certainty(docs, "n_chars", 50).select("unit_id", "take_all", F.round("pi", 9).alias("pi"))


@query("SELECT o_orderkey AS unit_id, o_orderpriority, round(CAST(10 AS DOUBLE) / count(*) OVER (PARTITION BY o_orderpriority), 9) AS pi FROM orders")
def equal_pi(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id"), "o_orderpriority")
    return I.equal(orders, 10, ["o_orderpriority"]).select("unit_id", "o_orderpriority", F.round("pi", 9).alias("pi"))


@query("WITH p AS (SELECT p_partkey AS unit_id, 20 * p_retailprice / sum(p_retailprice) OVER () AS pi FROM part), w AS (SELECT unit_id, CASE WHEN p_over THEN pi + 2 ELSE pi END AS w FROM (SELECT *, pi * count(*) OVER () > 20.6 AS p_over FROM p)) SELECT unit_id, round(20 * w / sum(w) OVER (), 8) AS pi FROM w")
def conditional_reweight(spark, sf_dir):
    u = parts(spark, sf_dir)
    p = I.normalised(u, F.col("y"), 20)
    return I.reweighted(p, 20.6 / u.count(), 2.0, 20).select("unit_id", F.round("pi", 8).alias("pi"))


@query(f"{PART} SELECT unit_id, lo AS lo_nano, hi AS hi_nano, hi - lo AS pi_nano FROM b")
def proportional_bars(spark, sf_dir):
    return part_bars(spark, sf_dir).select("unit_id", "lo_nano", "hi_nano", "pi_nano")


# -- coordinates -------------------------------------------------------------------------------------------------
@query("SELECT b.range AS batch_id, u.range AS unit_id, round((u.range % 50) / 49.0, 9) AS x, round((u.range // 50) / 49.0, 9) AS y FROM range(2) b, range(2500) u")
def grid_lattice(spark, sf_dir):
    g = rng(spark, 1).grid_coordinates((2, 50, 2))
    return g.select("batch_id", "unit_id", F.round(F.col("coords")[0], 9).alias("x"), F.round(F.col("coords")[1], 9).alias("y"))


@query("SELECT p_partkey AS unit_id, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE, 9) AS x, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 9) AS y FROM part")
def minmax_scale(spark, sf_dir):
    return A.minmax(parts(spark, sf_dir).select("unit_id", "x", "y"), ["x", "y"]).select("unit_id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("SELECT c_custkey AS unit_id, greatest(least(c_acctbal, 20.0), 1.0) AS area FROM customer")
def clip_area(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit_id"), A.clip(F.col("c_acctbal"), 1.0, 20.0).alias("area"))


@query("SELECT p_partkey AS unit_id, round(p_size * cos(radians(120)) - p_retailprice * sin(radians(120)), 6) AS x, round(p_size * sin(radians(120)) + p_retailprice * cos(radians(120)), 6) AS y FROM part")
def rotate_points(spark, sf_dir):
    r = A.rotate(parts(spark, sf_dir).select("unit_id", "x", "y"), "x", "y", 120)
    return r.select("unit_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _generated(df: DataFrame) -> DataFrame:
    return df.select("batch_id", "unit_id", "coords")


@query()
def random_coords(spark, sf_dir):
    return _generated(rng(spark, 1).random_coordinates((3, 1000, 2)))


@query()
def uniform_coords(spark, sf_dir):
    return _generated(rng(spark, 2).uniform_coordinates(-5, 5, (1000, 3)))


@query()
def normal_coords(spark, sf_dir):
    return _generated(rng(spark, 3).normal_1D_coordinates(10, 2, 1000))


@query()
def mvn_coords(spark, sf_dir):
    return _generated(rng(spark, 4).normal_mD_coordinates([0, 1], [[2, 0.5], [0.5, 1]], (1000, 2)))


@query()
def cluster_coords(spark, sf_dir):
    return _generated(rng(spark, 5).cluster_coordinates(4, 0.05, (500, 2)))


@query("SELECT range AS unit_id, 0.02::DOUBLE AS pi FROM range(500)")
def equal_probabilities(spark, sf_dir):
    return rng(spark, 6).equal_probabilities(10, 500).select("unit_id", F.round("pi", 9).alias("pi"))


@query("SELECT range AS batch_id, 10.0::DOUBLE AS total, CAST(500 AS BIGINT) AS n FROM range(3)")
def unequal_pi(spark, sf_dir):
    return rng(spark, 7).unequal_probabilities(10, (3, 500, 1)).groupBy("batch_id").agg(F.round(F.sum("pi"), 6).alias("total"), F.count("*").alias("n"))


# -- zones ---------------------------------------------------------------------------------------------------------
def _sweep_sql(src: str, group: str, order: str, z: int, zone: str, out: str) -> str:
    return f"""{out}a AS (SELECT *, sum(m) OVER (PARTITION BY {group} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS hi_, sum(m) OVER (PARTITION BY {group}) AS t_ FROM {src}),
{out} AS (SELECT * EXCLUDE (m, hi_, t_, range), range AS {zone}, CAST(least(hi_, t_ * (range + 1) // {z}) - greatest(hi_ - m, t_ * range // {z}) AS BIGINT) AS m FROM {out}a, range({z}) WHERE least(hi_, t_ * (range + 1) // {z}) > greatest(hi_ - m, t_ * range // {z}))"""


_ZONES = f"WITH u AS (SELECT unit_id, sz AS m, x, y, p_brand FROM ({PART_UNITS})), " + _sweep_sql("u", "p_brand", "x, unit_id", 2, "zone_x", "zx") + ", " + _sweep_sql("zx", "p_brand, zone_x", "y, unit_id", 3, "zone_y", "zz")


def brand_zones(spark, sf_dir) -> DataFrame:
    return P.zones(parts(spark, sf_dir).select("unit_id", F.col("sz").alias("mass_nano"), "x", "y", "p_brand"), ["p_brand"], (2, 3))


@query(f"WITH u AS (SELECT unit_id, sz AS m, x, y, p_brand FROM ({PART_UNITS})), " + _sweep_sql("u", "p_brand", "x, unit_id", 4, "zone", "zx") + " SELECT p_brand, unit_id, CAST(zone AS INT) AS zone, m FROM zx")
def zone_sweep_1d(spark, sf_dir):
    u = parts(spark, sf_dir).select("unit_id", F.col("sz").alias("m"), "x", "p_brand")
    return P.sweep(u, ["p_brand"], ["x", "unit_id"], "m", 4, "zone").select("p_brand", "unit_id", "zone", "m")


@query(f"WITH u AS (SELECT unit_id, sz AS m, x, y, 1 AS one FROM ({PART_UNITS})), " + _sweep_sql("u", "one", "x, unit_id", 7, "zone", "zx") + " SELECT unit_id, CAST(zone AS INT) AS zone, m FROM zx")
def zone_sweep_global(spark, sf_dir):
    u = parts(spark, sf_dir).select("unit_id", F.col("sz").alias("m"), "x")
    return P.sweep(u, [], ["x", "unit_id"], "m", 7, "zone").select("unit_id", "zone", "m")


@query(f"{_ZONES} SELECT p_brand, unit_id, CAST(zone_x AS INT) AS zone_x, CAST(zone_y AS INT) AS zone_y, m FROM zz")
def zone_sweep_2d(spark, sf_dir):
    return brand_zones(spark, sf_dir).select("p_brand", "unit_id", "zone_x", "zone_y", F.col("mass_nano").alias("m"))


@query(f"{_ZONES} SELECT p_brand, CAST(zone_x * 3 + zone_y AS INT) AS zone_id, count(*) AS units, CAST(sum(m) AS BIGINT) AS mass FROM zz GROUP BY 1, 2")
def zone_totals(spark, sf_dir):
    return P.zone_totals(brand_zones(spark, sf_dir), ["p_brand"])


@query(f"{_ZONES}, r AS (SELECT *, round_even(m / 1e6, 3) AS w FROM zz) SELECT p_brand, unit_id, CAST(zone_x * 3 + zone_y AS INT) AS zone_id, round(w / sum(w) OVER (PARTITION BY p_brand, zone_x, zone_y) / 6, 8) AS mass FROM r WHERE w > 0")
def zone_stabilise(spark, sf_dir):
    z = brand_zones(spark, sf_dir).withColumn("mass", F.col("mass_nano") / 1e6)
    return P.stabilised_zones(z, ["p_brand"], (2, 3), 3).select("p_brand", "unit_id", "zone_id", F.round("mass", 8).alias("mass"))


_CLUSTER_ZONES = f"WITH u AS (SELECT unit_id, sz AS m, x, y, CAST(p_size % 5 AS INT) AS cluster_id FROM ({PART_UNITS})), " + _sweep_sql("u", "cluster_id", "x, unit_id", 2, "zone_x", "zx") + ", " + _sweep_sql("zx", "cluster_id, zone_x", "y, unit_id", 2, "zone_y", "zz") + f""",
w AS (SELECT cluster_id, CAST(zone_x * 2 + zone_y AS BIGINT) AS z, unit_id, m, sum(m) OVER (PARTITION BY cluster_id, zone_x, zone_y ORDER BY unit_id ROWS UNBOUNDED PRECEDING) AS h, sum(m) OVER (PARTITION BY cluster_id, zone_x, zone_y) AS t FROM zz),
b AS (SELECT cluster_id, z, unit_id, CAST(z * {ONE} // 4 + (h - m) * ((z + 1) * {ONE} // 4 - z * {ONE} // 4) // t AS BIGINT) AS lo, CAST(z * {ONE} // 4 + h * ((z + 1) * {ONE} // 4 - z * {ONE} // 4) // t AS BIGINT) AS hi FROM w)"""


def cluster_bounds(spark, sf_dir) -> DataFrame:
    u = parts(spark, sf_dir).select("unit_id", F.col("sz").alias("mass_nano"), "x", "y", (F.col("p_size") % 5).alias("cluster_id"))
    return S.zone_bounds(P.zones(u, ["cluster_id"], (2, 2)), 4)


@query(f"{_CLUSTER_ZONES} SELECT range AS draw_id, cluster_id AS slot, unit_id FROM range(100) d JOIN b ON b.lo <= (d.range * 9999991 + 123457) % {ONE} AND (d.range * 9999991 + 123457) % {ONE} < b.hi")
def zone_sample_fixed_u(spark, sf_dir):
    draws = spark.range(100).select(F.col("id").alias("draw_id"), ((F.col("id") * 9_999_991 + 123_457) % ONE).alias("u_nano"))
    return S.select_zones(draws, cluster_bounds(spark, sf_dir), 4)


@query(f"{_CLUSTER_ZONES}, s0 AS (SELECT DISTINCT lo AS s FROM b WHERE hi > lo), iv AS (SELECT s, coalesce(lead(s) OVER (ORDER BY s), {ONE}) AS e FROM s0) SELECT s AS start_nano, e - s AS prob_nano, string_agg(unit_id::VARCHAR, ',' ORDER BY unit_id) AS ids FROM iv JOIN b ON b.lo <= s AND s < b.hi GROUP BY s, e")
def zone_design_enumerate(spark, sf_dir):
    return S.zone_design(cluster_bounds(spark, sf_dir)).select("start_nano", "prob_nano", ids_text().alias("ids"))


@query(f"{_CLUSTER_ZONES} SELECT unit_id, CAST(sum(hi - lo) AS BIGINT) AS pi_nano FROM b WHERE hi > lo GROUP BY unit_id")
def zone_fip(spark, sf_dir):
    return Design(S.zone_design(cluster_bounds(spark, sf_dir))).inclusion().select("unit_id", "pi_nano")


# -- measures -------------------------------------------------------------------------------------------------------
_UNIT_SQUARE = "SELECT p_partkey AS unit_id, (p_size - 1) / 49.0::DOUBLE AS x, (p_retailprice - 900) / 100.0 AS y FROM part"


def unit_square(spark, sf_dir) -> DataFrame:
    return parts(spark, sf_dir).select("unit_id", ((F.col("x") - 1) / 49.0).alias("x"), ((F.col("y") - 900) / 100.0).alias("y"))


@query(f"WITH u AS ({_UNIT_SQUARE}) SELECT a.unit_id, count(*) AS cnt FROM u a JOIN u b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 0.05 * 0.05 GROUP BY a.unit_id")
def tophat_counts(spark, sf_dir):
    return M.tophat_counts(unit_square(spark, sf_dir), ["x", "y"], 0.05)


@query("""WITH c AS (SELECT p_brand, p_size + 1 AS d, p_partkey % 40 AS s FROM part), f AS (SELECT p_brand, d, s, sqrt(d * d + s * s) AS n FROM c),
a AS (SELECT p_brand, avg(greatest(least((d - s) / n, sin(pi() / 8) / sin(pi() / 4)), -sin(pi() / 8) / sin(pi() / 4)) / (sin(pi() / 8) / sin(pi() / 4))) AS spread, avg(1 - (d + s) / (sqrt(2) * n)) AS v FROM f GROUP BY p_brand),
w AS (SELECT p_brand, spread, least(v, 1 - cos(pi() / 8)) / (1 - cos(pi() / 8)) AS vs FROM a) SELECT p_brand, round(spread, 7) AS spread, round(vs, 7) AS var_scaled, round(spread + (sign(spread) - spread) * vs, 7) AS combined FROM w""")
def density_measure(spark, sf_dir):
    c = read(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("unit_id"), (F.col("p_size") + 1).alias("cnt"), (F.col("p_partkey") % 40).alias("cnt_shifted"))
    return M.density_scores(c, ["p_brand"]).select("p_brand", *[F.round(x, 7).alias(x) for x in ("spread", "var_scaled", "combined")])


@query("SELECT c_custkey AS unit_id, round(greatest(least(c_acctbal / 10000, sin(pi() / 8) / sin(pi() / 4)), -sin(pi() / 8) / sin(pi() / 4)) / (sin(pi() / 8) / sin(pi() / 4)), 8) AS score FROM customer")
def scale_clip(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit_id"), F.round(M.scale(F.col("c_acctbal") / 10000), 8).alias("score"))


_LABELS = "u AS (SELECT p_partkey AS unit_id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, CAST(p_size % 5 AS INT) AS cluster_id, p_retailprice / 1000 AS mass FROM part), m AS (SELECT cluster_id, avg(x) AS x, avg(y) AS y, sum(mass) AS t FROM u GROUP BY cluster_id)"


def labelled(spark, sf_dir) -> DataFrame:
    return parts(spark, sf_dir).select("unit_id", "x", "y", (F.col("p_size") % 5).alias("cluster_id"), (F.col("y") / 1000).alias("mass"))


def centres_of(u: DataFrame) -> DataFrame:
    return u.groupBy("cluster_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


@query(f"WITH {_LABELS} SELECT d.range AS draw_id, u.unit_id, u.cluster_id, round(u.x + s.x - m.x, 6) AS x, round(u.y + s.y - m.y, 6) AS y FROM u JOIN m USING (cluster_id) JOIN range(3) d ON true JOIN u s ON s.unit_id = 1 + u.cluster_id * 7 + d.range")
def shift_clusters(spark, sf_dir):
    u = labelled(spark, sf_dir)
    a = spark.range(15).select((F.col("id") % 3).alias("draw_id"), F.call_function("div", F.col("id"), F.lit(3)).cast("int").alias("cluster_id")).withColumn("unit_id", 1 + F.col("cluster_id") * 7 + F.col("draw_id"))
    return M.shifted(u, centres_of(u), a, ["x", "y"]).select("draw_id", "unit_id", "cluster_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def density_of_samples(spark, sf_dir):
    u = unit_square(spark, sf_dir).withColumn("pi", F.lit(0.01))
    return M.Density(u, 5).score(S.RandomSampling(u, 5, seed=1).sample(4))


# -- clustering steps -----------------------------------------------------------------------------------------------
_EMB = "e AS (SELECT vec_id, embedding, label FROM embeddings), c AS (SELECT CAST(vec_id AS INT) AS cluster_id, embedding AS ce FROM e WHERE vec_id < 8), j AS (SELECT vec_id, cluster_id, list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - ce[i]::DOUBLE) * (embedding[i]::DOUBLE - ce[i]::DOUBLE))) AS d2 FROM e, c), n AS (SELECT vec_id, arg_min(cluster_id, round(d2, 9) * 1000 + cluster_id * 1e-9) AS cluster_id, min(d2) AS d2 FROM j GROUP BY vec_id)"


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame, list[str]]:
    names = [f"e{i}" for i in range(64)]
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return v, v.filter("unit_id < 8").select(F.col("unit_id").cast("int").alias("cluster_id"), *names), names


@query(f"WITH {_EMB} SELECT vec_id AS unit_id, cluster_id, round(d2, 5) AS d2 FROM n")
def nearest_centroid(spark, sf_dir):
    v, c, names = _vectors(spark, sf_dir)
    return C.nearest_centroid(v, c, names).select("unit_id", "cluster_id", F.round("d2", 5).alias("d2"))


@query("WITH u AS (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part), c AS (SELECT CAST(range AS INT) AS cluster_id, 5 + 10.0::DOUBLE * range AS cx, 910 + 20.0::DOUBLE * range AS cy FROM range(5)), n AS (SELECT x, y, (SELECT arg_min(cluster_id, d) FROM (SELECT cluster_id, (x - cx) ^ 2 + (y - cy) ^ 2 AS d FROM c)) AS cluster_id FROM u) SELECT cluster_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS n FROM n GROUP BY cluster_id")
def lloyd_step(spark, sf_dir):
    c = spark.range(5).select(F.col("id").cast("int").alias("cluster_id"), (5 + 10.0 * F.col("id")).alias("x"), (910 + 20.0 * F.col("id")).alias("y"))
    return C.lloyd_step(parts(spark, sf_dir).select("unit_id", "x", "y"), c, ["x", "y"]).select("cluster_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n")


def _member(spark, sf_dir) -> DataFrame:
    """A fractional membership: units of sizes divisible by 4 share with the next cluster."""
    u = labelled(spark, sf_dir)
    split = F.when(F.col("x") % 4 == 0, F.array(F.struct(F.col("cluster_id").alias("c"), F.lit(0.75).alias("f")), F.struct(((F.col("cluster_id") + 1) % 5).alias("c"), F.lit(0.25).alias("f")))).otherwise(F.array(F.struct(F.col("cluster_id").alias("c"), F.lit(1.0).alias("f"))))
    return u.select("unit_id", "mass", F.explode(split).alias("s")).select("unit_id", F.col("s.c").alias("cluster_id"), F.col("s.f").alias("frac"), (F.col("s.f") * F.col("mass")).alias("mass"))


_MEMBER = _LABELS + ", f AS (SELECT unit_id, cluster_id, CASE WHEN x % 4 = 0 THEN 0.75 ELSE 1.0 END::DOUBLE AS frac FROM u UNION ALL SELECT unit_id, (cluster_id + 1) % 5, 0.25 FROM u WHERE x % 4 = 0), g AS (SELECT f.unit_id, f.cluster_id, f.frac, f.frac * u.mass AS mass, u.x, u.y FROM f JOIN u USING (unit_id))"


@query(f"WITH {_MEMBER} SELECT cluster_id, round(sum(frac * x), 4) AS t_x, round(sum(frac * y), 4) AS t_y, round(sum(frac * x) + sum(frac * y), 4) AS t FROM g GROUP BY cluster_id")
def cluster_totals(spark, sf_dir):
    t = C.cluster_totals(_member(spark, sf_dir), labelled(spark, sf_dir), ["x", "y"])
    return t.select("cluster_id", *[F.round(c, 4).alias(c) for c in ("t_x", "t_y", "t")])


@query("SELECT round(sum(p_size) / 5, 4) AS goal_x, round(sum(p_retailprice) / 5, 4) AS goal_y, round(sum(p_size) / 5 + sum(p_retailprice) / 5, 4) AS goal FROM part")
def goal_gap(spark, sf_dir):
    return C.goals(parts(spark, sf_dir), ["x", "y"], 5).select(*[F.round(c, 4).alias(c) for c in ("goal_x", "goal_y", "goal")])


@query(f"WITH {_MEMBER}, t AS (SELECT cluster_id, sum(frac * x) AS tx, sum(frac * y) AS ty FROM g GROUP BY cluster_id), z AS (SELECT sum(x) / 5 AS gx, sum(y) / 5 AS gy FROM u) SELECT round(sum((0.5 * (tx - gx)) ^ 2 + (0.001 * (ty - gy)) ^ 2) / 1e6, 4) AS cost FROM t, z")
def tij_cost(spark, sf_dir):
    u = labelled(spark, sf_dir)
    t = C.cluster_totals(_member(spark, sf_dir), u, ["x", "y"])
    return C.total_cost(t, C.goals(u, ["x", "y"], 5), {"x": 0.5, "y": 0.001}).select(F.round(F.col("cost") / 1e6, 4).alias("cost"))


@query(f"WITH {_MEMBER}, t AS (SELECT cluster_id, sum(mass) AS t FROM g GROUP BY cluster_id), k AS (SELECT m.cluster_id, m.x, m.y, t.t FROM m JOIN t USING (cluster_id)), a AS (SELECT g.unit_id, o.cluster_id AS old, n.cluster_id AS new, ((g.x - n.x) ^ 2 + (g.y - n.y) ^ 2 - (g.x - o.x) ^ 2 - (g.y - o.y) ^ 2) / (o.t - n.t + 1e-9) AS cost FROM g JOIN k o ON o.cluster_id = g.cluster_id JOIN k n ON o.t - n.t > 0.001), r AS (SELECT unit_id, old, arg_min(new, cost) AS new, min(cost) AS cost FROM a GROUP BY unit_id, old) SELECT unit_id, old, new, round(cost, 4) AS cost FROM r ORDER BY r.cost, unit_id, old LIMIT 50")
def transfer_candidates(spark, sf_dir):
    u = labelled(spark, sf_dir)
    return C.transfer_candidates(_member(spark, sf_dir), u, centres_of(u), ["x", "y"], 50, 1e-3).select("unit_id", "old", "new", F.round("cost", 4).alias("cost"))


@query(f"WITH {_MEMBER}, t AS (SELECT cluster_id, sum(mass) AS t FROM g GROUP BY cluster_id) SELECT greatest(1, CAST(floor((max(t) - min(t)) / (2 * (SELECT avg(mass) FROM g WHERE mass > 0))) AS BIGINT)) AS transfers FROM t")
def expected_transfers(spark, sf_dir):
    return C.expected_transfers(_member(spark, sf_dir))


@query("""WITH q AS (SELECT c_custkey AS unit_id, 1.0 AS f, 0.2 + (c_custkey % 7) / 10.0 AS x, 1 + (c_custkey % 11) / 20.0 AS a, 0.5 + (c_custkey % 13) / 20.0 AS b FROM customer)
SELECT unit_id, round(CASE WHEN (a >= 1 AND b >= 1) OR (a <= 1 AND b <= 1) THEN least(f, (a - b) / (2 * x)) ELSE least(f, (a - 1) / x, (1 - b) / x) END::DOUBLE, 8) AS fraction FROM q""")
def transfer_fraction(spark, sf_dir):
    k = F.col("c_custkey")
    f = C.transfer_fraction(F.lit(1.0), 0.2 + (k % 7) / 10.0, 1 + (k % 11) / 20.0, 0.5 + (k % 13) / 20.0, F.lit(1.0))
    return read(spark, sf_dir, "customer").select(k.alias("unit_id"), F.round(f, 8).alias("fraction"))


@query(f"WITH {_LABELS}, d AS (SELECT unit_id, sqrt((x - 25) ^ 2 + (y - 950) ^ 2) AS dist, sz FROM u JOIN (SELECT p_partkey AS unit_id, CAST(round(p_retailprice * 100) AS BIGINT) AS sz FROM part) USING (unit_id)), r AS (SELECT *, sum(sz) OVER (ORDER BY dist, unit_id ROWS UNBOUNDED PRECEDING) AS upto FROM d) SELECT unit_id, round(dist, 6) AS dist, CAST(least(sz, 1234567 - (upto - sz)) AS BIGINT) AS taken FROM r WHERE upto - sz < 1234567")
def deficit_fill(spark, sf_dir):
    f = C.deficit_fill(parts(spark, sf_dir), {"x": 25.0, "y": 950.0}, ["x", "y"], "sz", 1_234_567)
    return f.select("unit_id", F.round("dist", 6).alias("dist"), F.col("taken").cast("bigint").alias("taken"))


@query(f"WITH {_MEMBER}, q AS (SELECT unit_id, 0.5 AS gain FROM u WHERE unit_id % 3 = 0), h AS (SELECT unit_id, sum(CASE WHEN cluster_id = 2 THEN frac ELSE 0 END) AS own, sum(CASE WHEN cluster_id <> 2 THEN frac ELSE 0 END) AS rest FROM g GROUP BY unit_id), k AS (SELECT h.unit_id, own, rest, gain, CASE WHEN rest = 0 THEN 1.0 ELSE least(own + coalesce(gain, 0), 1.0) END AS mine FROM h LEFT JOIN q USING (unit_id)), o AS (SELECT unit_id, 2 AS cluster_id, mine AS frac FROM k WHERE own > 0 OR gain IS NOT NULL UNION ALL SELECT g.unit_id, g.cluster_id, g.frac / k.rest * (1 - k.mine) FROM g JOIN k USING (unit_id) WHERE g.cluster_id <> 2 AND k.rest > 0) SELECT unit_id, CAST(cluster_id AS INT) AS cluster_id, round(frac::DOUBLE, 8) AS frac FROM o WHERE frac > 0")
def proportional_shrink(spark, sf_dir):
    gains = parts(spark, sf_dir).filter("unit_id % 3 = 0").select("unit_id", F.lit(0.5).alias("gain"))
    return C.proportional_shrink(_member(spark, sf_dir), gains, 2).select("unit_id", "cluster_id", F.round("frac", 8).alias("frac"))


@query(f"WITH {_MEMBER} SELECT cluster_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM g GROUP BY cluster_id")
def update_centroids(spark, sf_dir):
    c = C.update_centroids(_member(spark, sf_dir), parts(spark, sf_dir), ["x", "y"])
    return c.select("cluster_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"WITH {_MEMBER}, r AS (SELECT unit_id, cluster_id, round_even(mass, 3) AS w FROM g) SELECT unit_id, cluster_id, round(w / sum(w) OVER (PARTITION BY cluster_id), 9) AS mass FROM r")
def stabilised_masses(spark, sf_dir):
    return C.stabilised(_member(spark, sf_dir), 3).select("unit_id", "cluster_id", F.round("mass", 9).alias("mass"))


@query(f"{PART} SELECT unit_id, CAST(round_even(CAST(hi - lo AS DOUBLE) / 1000000, 0) AS BIGINT) AS copies FROM b WHERE round_even(CAST(hi - lo AS DOUBLE) / 1000000, 0) > 0")
def expand_units(spark, sf_dir):
    return C.expanded(part_bars(spark, sf_dir), 1_000_000).select("unit_id", "copies")


@query("WITH n AS (SELECT l_partkey AS unit_id, l_linenumber AS cluster_id, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY n DESC, cluster_id) AS k FROM n) SELECT unit_id, cluster_id FROM r WHERE k = 1")
def majority_label(spark, sf_dir):
    return C.majority(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("unit_id"), F.col("l_linenumber").alias("cluster_id")))


@query(f"WITH {_MEMBER} SELECT unit_id, count(*) AS clusters FROM g WHERE frac > 0 GROUP BY unit_id HAVING count(*) > 1")
def border_units(spark, sf_dir):
    return C.border_units(_member(spark, sf_dir))


@query(f"WITH {_MEMBER} SELECT cluster_id, unit_id, x, y, round(mass, 8) AS mass FROM g WHERE mass <> 0")
def cluster_units(spark, sf_dir):
    return C.clusters(_member(spark, sf_dir), parts(spark, sf_dir), ["x", "y"]).withColumn("mass", F.round("mass", 8))


@query(f"WITH {_MEMBER} SELECT cluster_id, count(*) AS units, round(sum(frac * y), 4) AS mass FROM g GROUP BY cluster_id")
def cluster_mass(spark, sf_dir):
    return A.cluster_mass(_member(spark, sf_dir), parts(spark, sf_dir), "y").withColumn("mass", F.round("mass", 4))


# -- whole fits: a population for each brand ----------------------------------------------------------------------------
def brand_units(spark, sf_dir, n: int = 4) -> DataFrame:
    u = parts(spark, sf_dir).select("unit_id", ((F.col("x") - 1) / 49.0).alias("x"), ((F.col("y") - 900) / 100.0).alias("y"), "sz", "p_brand", "p_size")
    return I.normalised(u, F.col("sz"), n, ["p_brand"])


def _report(member: DataFrame, units: DataFrame, closer: float | None = 0.75) -> DataFrame:
    """By brand, what SQL knows of any good fit: the units in it, their mass, units whose parts do not add up (none), clusters off their goal (none), and whether squares about the clusters' centres come to less than ``closer`` of those about the brand's own."""
    j = member.join(units.select("p_brand", "unit_id", "x", "y", "pi"), ["p_brand", "unit_id"])
    whole = j.groupBy("p_brand", "unit_id").agg(F.sum("frac").alias("f"), F.sum("mass").alias("m"))
    out = whole.groupBy("p_brand").agg(F.count("*").alias("units"), F.round(F.sum("m"), 2).alias("mass"), F.count(F.when(F.abs(F.col("f") - 1) > 0.02, 1)).alias("lost"))
    w = F.col("mass")
    squares = F.sum(w * (F.col("x") * F.col("x") + F.col("y") * F.col("y"))) - (F.pow(F.sum(w * F.col("x")), 2) + F.pow(F.sum(w * F.col("y")), 2)) / F.sum(w)
    inside = j.groupBy("p_brand", "cluster_id").agg(squares.alias("s"), F.sum(w).alias("m")).groupBy("p_brand").agg(F.sum("s").alias("s"), F.count(F.when(F.abs(F.col("m") - 1) > 0.01, 1)).alias("uneven"))
    near = F.lit(True) if closer is None else F.col("s") <= closer * F.col("s0")
    return out.join(inside, "p_brand").join(j.groupBy("p_brand").agg(squares.alias("s0")), "p_brand").select("p_brand", "units", "mass", "lost", "uneven", near.alias("closer"))


_FITTED = "SELECT p_brand, count(*) AS units, 4.0::DOUBLE AS mass, 0::BIGINT AS lost, 0::BIGINT AS uneven, true AS closer FROM part GROUP BY p_brand"


@query(_FITTED)
def soft_balanced(spark, sf_dir):
    u = brand_units(spark, sf_dir)
    return _report(cut(C.SoftBalancedKMeans(4, seed=1).fit(u, ["x", "y"], ["pi"], ["p_brand"])), u)


@query(_FITTED)
def aggregate_balanced(spark, sf_dir):
    u = brand_units(spark, sf_dir)
    return _report(cut(C.AggregateBalancedKMeans(4, seed=1).fit(u, ["x", "y"], ["pi"], ["p_brand"])), u)


@query(_FITTED)
def doubly_balanced(spark, sf_dir):
    u = brand_units(spark, sf_dir)
    return _report(cut(C.DublyBalancedKMeans(4, seed=1).fit(u, ["x", "y"], ["pi"], ["p_brand"])), u)


@query(_FITTED)
def continuous_balancing(spark, sf_dir):
    u = brand_units(spark, sf_dir).withColumn("label", F.col("unit_id") % 4)
    return _report(cut(C.ContinuesBalancing(4).fit(u, ["x", "y"], ["pi"], ["p_brand"])), u, None)


@query("SELECT p_brand, count(*) AS units, 4.0::DOUBLE AS mass, 0::BIGINT AS lost, 4::BIGINT AS clusters FROM part GROUP BY p_brand")
def one_boundary(spark, sf_dir):
    """Units, mass, units whose parts do not add up and clusters: it evens clusters out as far as its rounds go, so their masses are not known."""
    u = brand_units(spark, sf_dir)
    member = cut(C.OneBoundaryBalancedKMeans(4, seed=1).fit(u, ["x", "y"], ["pi"], ["p_brand"]))
    whole = _report(member, u, None).select("p_brand", "units", "mass", "lost")
    return whole.join(member.groupBy("p_brand").agg(F.countDistinct("cluster_id").alias("clusters")), "p_brand")


@query("SELECT p_brand, count(*) AS units, CAST(count(*) // 4 AS BIGINT) AS least, CAST(count(*) // 4 + (CASE WHEN count(*) % 4 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS most, true AS dearer FROM part GROUP BY p_brand")
def kmeans_comparison(spark, sf_dir):
    """Sizes of the even clusters, and whether evenness costs squares beside plain k-means (which may stop a little above its best)."""
    c = C.compared(brand_units(spark, sf_dir), ["x", "y"], 4, ["p_brand"], seed=1)
    even, plain = (F.col("method") == m for m in ("even", "plain"))
    cost = lambda m: F.sum(F.when(m, F.col("squares")))
    return c.groupBy("p_brand").agg(F.sum(F.when(even, F.col("units"))).alias("units"), F.min(F.when(even, F.col("units"))).alias("least"), F.max(F.when(even, F.col("units"))).alias("most"), (cost(even) >= 0.9 * cost(plain)).alias("dearer"))


@query(f"WITH u AS ({_UNIT_SQUARE}) SELECT count(*) AS units, 5::BIGINT AS clusters, true AS closer FROM u")
def kmeans_large(spark, sf_dir):
    """Units and clusters, and whether each unit's cluster brings squares well below those about the whole's centre."""
    u = unit_square(spark, sf_dir)
    j = C.kmeans_large(u, 5, ["x", "y"], seed=1).select("unit_id", "cluster_id").join(u, "unit_id")
    of = lambda: F.var_pop("x") * F.count("*") + F.var_pop("y") * F.count("*")
    inside = j.groupBy("cluster_id").agg(of().alias("s"), F.count("*").alias("n")).agg(F.sum("s").alias("s"), F.sum("n").alias("units"), F.count("*").alias("clusters"))
    return inside.join(j.agg(of().alias("s0"))).select("units", "clusters", (F.col("s") < 0.5 * F.col("s0")).alias("closer"))


# -- samplers -------------------------------------------------------------------------------------------------------------
@query("SELECT range AS draw_id, CAST(20 AS BIGINT) AS n FROM range(50)")
def spatial_sample(spark, sf_dir):
    u = I.normalised(unit_square(spark, sf_dir), F.lit(1.0), 20)
    return S.KMeansSpatialSampling(u, n=20, n_zones=(2, 2), seed=1).sample(50).groupBy("draw_id").agg(F.count("*").alias("n"))


@query(f"WITH u AS ({_UNIT_SQUARE}) SELECT unit_id, round(20.0::DOUBLE / (SELECT count(*) FROM u), 4) AS pi FROM u")
def spatial_inclusion(spark, sf_dir):
    """Each unit's frequency over the exact design of all draws is its probability."""
    u = I.normalised(unit_square(spark, sf_dir), F.lit(1.0), 20)
    design = S.KMeansSpatialSampling(u, n=20, n_zones=(2, 2), seed=1).design()
    return design.select("prob_nano", F.explode("ids").alias("unit_id")).groupBy("unit_id").agg(F.round(F.sum("prob_nano") / F.lit(float(ONE)), 4).alias("pi"))


@query("SELECT CAST(c.range AS INT) AS cluster_id, CAST(z.range AS INT) AS zone_id, 0.25::DOUBLE AS mass FROM range(10) c, range(4) z")
def spatial_zones(spark, sf_dir):
    u = I.normalised(unit_square(spark, sf_dir), F.lit(1.0), 10)
    cells = P.Population(u, n_clusters=10, n_zones=(2, 2)).nested()
    return cells.select("cluster_id", F.col("zone_id").cast("int").alias("zone_id"), F.round(F.aggregate("units", F.lit(0.0), lambda a, c: a + c["mass_nano"]) / F.lit(float(ONE)), 3).alias("mass"))


@query("SELECT p_brand, d.range AS draw_id, 4::BIGINT AS n FROM (SELECT DISTINCT p_brand FROM part), range(20) d")
def spatial_strata(spark, sf_dir):
    return S.KMeansSpatialSampling(brand_units(spark, sf_dir), n=4, n_zones=(2, 2), seed=1, by=["p_brand"]).sample(20).groupBy("p_brand", "draw_id").agg(F.count("*").alias("n"))


@query("SELECT range AS draw_id, CAST(10 AS BIGINT) AS n FROM range(200)")
def srs_wr(spark, sf_dir):
    return S.RandomSampling(parts(spark, sf_dir), 10, seed=3).sample(200).groupBy("draw_id").agg(F.count("*").alias("n"))


@query("SELECT range AS draw_id, CAST(10 AS BIGINT) AS n, true AS different FROM range(16)")
def local_pivotal(spark, sf_dir):
    u = I.normalised(suppliers(spark, sf_dir).withColumn("y", F.col("sz").cast("double")), F.col("sz"), 10)
    return S.local_pivotal(u, ["x", "y"], 16, seed=1).groupBy("draw_id").agg(F.count("*").alias("n"), (F.countDistinct("unit_id") == 10).alias("different"))


@query("SELECT range AS draw_id, CAST(10 AS BIGINT) AS n, true AS different FROM range(16)")
def max_entropy(spark, sf_dir):
    u = I.normalised(suppliers(spark, sf_dir), F.col("sz"), 10)
    return S.conditional_poisson(u, 16, seed=1).groupBy("draw_id").agg(F.count("*").alias("n"), (F.countDistinct("unit_id") == 10).alias("different"))


@query()
def method_samples(spark, sf_dir):
    u = I.normalised(suppliers(spark, sf_dir).withColumn("y", F.col("sz").cast("double")), F.col("sz"), 5)
    return S.find_samples({"lpm": S.local_pivotal(u, ["x", "y"], 8), "maxent": S.conditional_poisson(u, 8), "random": S.RandomSampling(u, 5).sample(8)})


@query()
def window_samples(spark, sf_dir):
    return table_window_samples(read(spark, sf_dir, "events"), 5, "6 hours")


# -- search -----------------------------------------------------------------------------------------------------------------
def _search(spark, sf_dir) -> AStar:
    u = I.proportional(suppliers(spark, sf_dir), "sz", 3)
    return AStar(Design(systematic(u)), VarNHT(u), switch_coefficient=1.0, seed=5)


@query("SELECT CAST(1000000000 AS BIGINT) AS mass, CAST(3 AS INT) AS n, true AS improved")
def design_search(spark, sf_dir):
    s = _search(spark, sf_dir)
    s.run(30, 5, 1000)
    better = s.best_value <= s.initial_value
    return s.best_design(spark).samples.agg(F.sum("prob_nano").alias("mass"), F.max(F.size("ids")).alias("n"), F.lit(better).alias("improved"))


@query(f"{SUPPLIER} SELECT unit_id, hi - lo AS pi_nano FROM b WHERE hi > lo")
def design_search_fip(spark, sf_dir):
    s = _search(spark, sf_dir)
    return best_of(s.run_chains(spark, 4, 10, 3, 100)).inclusion().select("unit_id", "pi_nano")


# -- containers and analysis --------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey, (SELECT max(e.event_id) FROM events e WHERE e.event_id <= o_orderkey // 3) AS floor FROM orders")
def floor_lookup(spark, sf_dir):
    q = read(spark, sf_dir, "orders").select("o_orderkey", F.call_function("div", F.col("o_orderkey"), F.lit(3)).alias("k"))
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.col("event_id").alias("v"))
    return H.floor_lookup(q, e, "k", "v").select("o_orderkey", "floor")


@query("SELECT c_custkey, (SELECT min(s_suppkey * 7) FROM supplier WHERE s_suppkey * 7 >= c_custkey) AS ceil FROM customer")
def ceil_lookup(spark, sf_dir):
    q = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("k"))
    s = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 7).alias("k"), (F.col("s_suppkey") * 7).alias("v"))
    return H.ceil_lookup(q, s, "k", "v").select("c_custkey", "ceil")


@query("SELECT min(c_custkey) AS least, max(c_custkey) AS greatest, count(*) AS n FROM customer")
def tree_extremes(spark, sf_dir):
    return H.extremes(read(spark, sf_dir, "customer"), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_members(spark, sf_dir):
    return H.without(read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_members(spark, sf_dir):
    return H.contained(read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


@query("SELECT s_suppkey AS k, CAST(s_nationkey AS BIGINT) AS v FROM supplier UNION ALL SELECT c_custkey, min(CAST(c_nationkey AS BIGINT)) FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY c_custkey")
def frontier_insert(spark, sf_dir):
    held = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("bigint").alias("v"))
    return H.insert(held, read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("bigint").alias("v")), "k")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def heap_top(spark, sf_dir):
    return H.top(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 10)


@query("SELECT count(*) - 7 AS left_over, 7::BIGINT AS popped, sum(c_custkey)::BIGINT AS keys FROM customer")
def heap_random(spark, sf_dir):
    held = read(spark, sf_dir, "customer").select("c_custkey")
    popped = H.random_row(held, 4, ["c_custkey"], 7)
    both = H.without(held, popped, ["c_custkey"]).withColumn("out", F.lit(0)).union(popped.withColumn("out", F.lit(1)))
    return both.agg(F.sum(1 - F.col("out")).alias("left_over"), F.sum("out").alias("popped"), F.sum("c_custkey").alias("keys"))


@query("WITH q AS (SELECT a.n_regionkey AS r, abs(a.n_nationkey - b.n_nationkey) AS s FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey) SELECT CAST(r AS VARCHAR) AS ident, round(avg(s), 4) AS mean, count(*) AS n FROM q GROUP BY r UNION ALL SELECT 'Mean', round(avg(s), 4), count(*) FROM q")
def pair_scores_rollup(spark, sf_dir):
    p = A.pairs(read(spark, sf_dir, "nation"), "n_nationkey", ["n_regionkey"])
    s = p.select(F.col("a_n_regionkey").alias("ident"), F.abs(F.col("a_n_nationkey") - F.col("b_n_nationkey")).alias("s"))
    return A.mean_with_total(s, "ident", "s")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, c.n_nationkey AS c FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey JOIN nation c ON b.n_nationkey < c.n_nationkey WHERE a.n_regionkey <> b.n_regionkey AND a.n_regionkey <> c.n_regionkey AND b.n_regionkey <> c.n_regionkey")
def triple_filter(spark, sf_dir):
    t = A.triples(read(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey")
    return t.select(F.col("a_n_nationkey").alias("a"), F.col("b_n_nationkey").alias("b"), F.col("c_n_nationkey").alias("c"))


@query("SELECT c_custkey, c_mktsegment AS n_name, CAST(length(c_mktsegment) AS BIGINT) AS unit_id FROM customer")
def label_lookup(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("n_name"))
    return A.label_index(c, c.select("n_name").distinct().withColumn("unit_id", F.length("n_name").cast("bigint")), "n_name").select("c_custkey", "n_name", "unit_id")


@query("SELECT g.range AS grid, u.range AS unit_id, round((u.range % 3) / 2.0 + (g.range % 2) * 5, 6) AS x, round((u.range // 3) / 2.0 + (g.range // 2) * 5, 6) AS y FROM range(4) g, range(9) u")
def stacked_grids(spark, sf_dir):
    g = rng(spark).grid_coordinates((3, 2)).select("unit_id", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"))
    return A.stack([g.select(F.lit(i).cast("bigint").alias("grid"), "unit_id", F.round(F.col("x") + i % 2 * 5, 6).alias("x"), F.round(F.col("y") + i // 2 * 5, 6).alias("y")) for i in range(4)])


@query("WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_retailprice, p_partkey) AS k FROM part), b AS (SELECT CAST(round(p_retailprice * 100) AS BIGINT) AS sz, row_number() OVER (ORDER BY -CAST(round(p_retailprice * 100) AS BIGINT), p_partkey) AS k FROM part) SELECT p_partkey AS unit_id, sz FROM a JOIN b USING (k)")
def sorted_repair(spark, sf_dir):
    u = parts(spark, sf_dir)
    right = u.select((-F.col("sz")).alias("down"), "unit_id", "sz")
    return A.repaired(u.select("unit_id", "x", "y"), ["x", "y", "unit_id"], right, ["down", "unit_id"], "sz").select("unit_id", "sz")


@query("SELECT event_type, count(value) AS count, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max FROM events GROUP BY event_type")
def describe_by_group(spark, sf_dir):
    d = A.describe(read(spark, sf_dir, "events"), "event_type", "value")
    return d.select("event_type", "count", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "min", *[F.round(q, 6).alias(q) for q in ("q25", "q50", "q75")], "max")


@query("WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY event_type) SELECT event_id, event_type, value FROM events JOIN q USING (event_type) WHERE value BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)")
def iqr_outlier_filter(spark, sf_dir):
    return A.without_outliers(read(spark, sf_dir, "events").select("event_id", "event_type", "value"), "value", 0.5, "event_type")


@query("WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY event_type) SELECT event_type, min(CASE WHEN value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) THEN value END) AS low, max(CASE WHEN value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) THEN value END) AS high, count(CASE WHEN NOT value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) THEN 1 END) AS outliers FROM events JOIN q USING (event_type) GROUP BY event_type")
def boxplot_summary(spark, sf_dir):
    return A.boxplot(read(spark, sf_dir, "events"), "event_type", "value").select("event_type", "low", "high", "outliers")


@query("SELECT DISTINCT event_type AS method FROM events")
def distinct_methods(spark, sf_dir):
    return A.methods(read(spark, sf_dir, "events").select(F.col("event_type").alias("method")))


def fixed_draws(spark, draws: int = 4, n: int = 10) -> DataFrame:
    """Draw d takes units 1 + 17 slot + 3 d."""
    return spark.range(draws * n).select(F.call_function("div", F.col("id"), F.lit(n)).alias("draw_id"), (F.col("id") % n).cast("int").alias("slot")).withColumn("unit_id", 1 + F.col("slot").cast("bigint") * 17 + F.col("draw_id") * 3)


_DRAWS = "s AS (SELECT d.range AS draw_id, 1 + k.range * 17 + d.range * 3 AS unit_id FROM range(4) d, range(10) k)"
_VORONOI = f"u AS ({_UNIT_SQUARE}), {_DRAWS}, n AS (SELECT count(*) AS n FROM u), j AS (SELECT s.draw_id, u.unit_id AS i, p.unit_id AS near, (u.x - p.x) ^ 2 + (u.y - p.y) ^ 2 AS d2 FROM u, s JOIN u p ON p.unit_id = s.unit_id), w AS (SELECT *, min(d2) OVER (PARTITION BY draw_id, i) AS m FROM j), c AS (SELECT draw_id, i, near, 10.0::DOUBLE / n.n / count(*) OVER (PARTITION BY draw_id, i) AS share FROM w, n WHERE d2 <= m + 1e-12), v AS (SELECT draw_id, near AS unit_id, sum(share) AS v FROM c GROUP BY draw_id, near)"


def _with_pi(spark, sf_dir) -> DataFrame:
    return I.equal(unit_square(spark, sf_dir), 10)


@query(f"WITH {_VORONOI} SELECT draw_id, unit_id, round(v, 6) AS v FROM v")
def voronoi_mass(spark, sf_dir):
    return B.voronoi(_with_pi(spark, sf_dir), fixed_draws(spark), ["x", "y"]).withColumn("v", F.round("v", 6))


@query(f"WITH {_VORONOI} SELECT draw_id, round(avg((v - 1) ^ 2), 6) AS voronoi FROM v GROUP BY draw_id")
def voronoi_balance(spark, sf_dir):
    return B.voronoi_balance(_with_pi(spark, sf_dir), fixed_draws(spark), ["x", "y"]).withColumn("voronoi", F.round("voronoi", 6))


_MORAN = """z AS (SELECT unit_id, (x - (SELECT avg(x) FROM u)) / (SELECT stddev_pop(x) FROM u) AS zx, (y - (SELECT avg(y) FROM u)) / (SELECT stddev_pop(y) FROM u) AS zy FROM u),
lb AS (SELECT draw_id, near, sum(share) AS one, sum(share * zx) AS tx, sum(share * zy) AS ty FROM c JOIN z ON z.unit_id = i GROUP BY 1, 2),
l AS (SELECT draw_id, sqrt(avg(((one - 1) ^ 2 + (tx - zx) ^ 2 + (ty - zy) ^ 2) / 3)) AS local_balance FROM lb JOIN z ON z.unit_id = near GROUP BY draw_id),
nb AS (SELECT a.unit_id AS i, b.unit_id AS j, 10.0::DOUBLE / n.n AS p, sum(10.0::DOUBLE / n.n) OVER (PARTITION BY a.unit_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.unit_id ROWS UNBOUNDED PRECEDING) AS upto FROM u a JOIN u b ON a.unit_id <> b.unit_id, n),
wt AS (SELECT i, j, least(p, 1 - p - (upto - p)) AS w FROM nb WHERE least(p, 1 - p - (upto - p)) > 0), tw AS (SELECT i, sum(w) AS w FROM wt GROUP BY i),
e AS (SELECT d.draw_id, tw.i, tw.w, CASE WHEN s.unit_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS x FROM (SELECT DISTINCT draw_id FROM s) d JOIN tw ON true LEFT JOIN s ON s.draw_id = d.draw_id AND s.unit_id = tw.i),
g AS (SELECT s.draw_id, wt.i, sum(wt.w) AS l FROM wt JOIN s ON s.unit_id = wt.j GROUP BY 1, 2),
q AS (SELECT draw_id, w, x, coalesce(l, 0) / w AS lag FROM e LEFT JOIN g USING (draw_id, i)),
m AS (SELECT draw_id, sum(w) AS t, sum(w * x) / sum(w) AS mx, sum(w * lag) / sum(w) AS ml, sum(w * x * lag) AS xy, sum(w * x * x) AS xx, sum(w * lag * lag) AS ll FROM q GROUP BY draw_id)"""


@query(f"WITH {_VORONOI}, {_MORAN} SELECT draw_id, round(local_balance, 6) AS local_balance, round((xy / t - mx * ml) / sqrt((xx / t - mx * mx) * (ll / t - ml * ml)), 6) AS moran FROM m JOIN l USING (draw_id)")
def balance_scores(spark, sf_dir):
    u = _with_pi(spark, sf_dir)
    out = B.local_balance(u, fixed_draws(spark), ["x", "y"]).join(B.moran(u, fixed_draws(spark), ["x", "y"]), "draw_id")
    return out.select("draw_id", F.round("local_balance", 6).alias("local_balance"), F.round("moran", 6).alias("moran"))


@query()
def all_scores(spark, sf_dir):
    return B.scores(_with_pi(spark, sf_dir), fixed_draws(spark), ["x", "y"], 10, 0.2)


@query("SELECT CAST(event_id % 4 AS VARCHAR) AS method, event_id % 10 AS draw_id, round(sum(value), 3) AS score FROM events GROUP BY 1, 2")
def score_table(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.col("event_id") % 4).cast("string").alias("method"), (F.col("event_id") % 10).alias("draw_id"), "value")
    return A.score_table(e, e.groupBy("method", "draw_id").agg(F.round(F.sum("value"), 3).alias("score")))


@query()
def zone_hulls(spark, sf_dir):
    z = P.zones(parts(spark, sf_dir).select("unit_id", F.col("sz").alias("mass_nano"), "x", "y", (F.col("p_size") % 5).alias("cluster_id")), ["cluster_id"], (2, 2))
    return hulls(z)


@query("SELECT d.range AS draw_id, CAST(k.range AS INT) AS slot, p_partkey AS unit_id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, CAST(d.range // 3 AS INT) AS facet_row, CAST(d.range % 3 AS INT) AS facet_col FROM range(4) d, range(10) k JOIN part ON p_partkey = 1 + k.range * 17 + d.range * 3")
def sample_facets(spark, sf_dir):
    return facets(fixed_draws(spark), parts(spark, sf_dir), 3).select("draw_id", "slot", "unit_id", "x", "y", "facet_row", F.col("facet_col").cast("int").alias("facet_col"))
