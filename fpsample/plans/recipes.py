"""Plan recipes: running sums without a single-task window, next values, interval joins by cells, running as-of lookups, loops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one bucket of a global order, and most buckets: beyond these, buckets grow with the data.
BUCKET_ROWS, MOST_BUCKETS = 200_000, 2000


def _cuts(df: DataFrame, key: str, rows: int) -> list:
    """Values of ``key`` (numeric) at every BUCKET_ROWS rows of ``rows``, about; a frequent value may stand more than once."""
    parts = min(MOST_BUCKETS, rows // BUCKET_ROWS)
    return df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []


def order_bounds(df: DataFrame, key: str) -> list:
    """Bounds that cut df's order of ``key`` (numeric) into buckets of about BUCKET_ROWS rows: MOST_BUCKETS at most reach the driver."""
    return sorted(set(_cuts(df, key, df.count())))


def order_buckets(df: DataFrame, order: list[str]) -> Column | None:
    """A bucket of each row that rises along ``order`` (the first two keys numeric), of about BUCKET_ROWS rows; None if df has no more than that.

    A value of the first key that fills buckets of its own is cut further by the second key.
    """
    cuts = _cuts(df, order[0], df.count())
    if not cuts:
        return None
    bounds = sorted(set(cuts))
    inner = F.lit(0)
    for value in (v for v in bounds if cuts.count(v) > 1 and len(order) > 1):
        own = df.filter(F.col(order[0]) == value)
        within = order_bounds(own, order[1])
        if within:  # the greater values of its bucket come after it
            inner = F.when(F.col(order[0]) == value, bucket_of(order[1], within)).when(bucket_of(order[0], bounds) == bounds.index(value) + 1, F.lit(len(within) + 1)).otherwise(inner)
    return F.struct(bucket_of(order[0], bounds).alias("outer"), inner.alias("inner"))


def bucket_of(key: str | Column, bounds: list) -> Column:
    """Number of bounds up to the key: buckets follow the order, equal keys share one."""
    key = F.col(key) if isinstance(key, str) else key
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= key))


def running_sum(df: DataFrame, order: list[str], value: str, out: str, total: str | None = None, on: list[str] | None = None) -> DataFrame:
    """df with the sum of ``value`` up to and including each row in the order of ``order`` (first two keys numeric, all together unique), within equal ``on``.

    Two phases: sums per bucket of the order (and ``on``), their running sum, at most MOST_BUCKETS rows a group; then
    windows inside buckets. So neither all rows nor a hot group's rows meet in one task. Small tables take one window.
    ``total`` names a column for the sum of all.
    """
    on = on or []
    bucket = order_buckets(df, order)
    if on and bucket is None:
        whole = Window.partitionBy(*on)
        got = df.withColumn(out, F.sum(value).over(whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        return got.withColumn(total, F.sum(value).over(whole)) if total else got
    inside = Window.partitionBy(*on, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_b", F.lit(0) if bucket is None else bucket)
    sums = df.groupBy(*on, "_b").agg(F.sum(value).alias("_v"))
    steps = Window.partitionBy(*on).orderBy("_b") if on else Window.orderBy("_b")
    before = F.sum("_v").over(steps.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_v")
    every = F.sum("_v").over(steps.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sums = sums.select(*on, "_b", before.alias("_before"), every.alias("_total"))
    got = df.join(sums if on else F.broadcast(sums), [*on, "_b"]).withColumn(out, F.sum(value).over(inside) + F.col("_before"))
    return (got.withColumn(total, F.col("_total")) if total else got).drop("_b", "_before", "_total")


def quantiles(df: DataFrame, by: list[str], value: str, at: list[float]) -> DataFrame:
    """(by, q0, q1, ...): exact quantiles of each group, between neighbouring values in proportion, nulls left out.

    Values are counted, the counts' running sum (in two phases) ranks them, and the values at the ranks wanted are picked by
    aggregation. So a group may hold any number of distinct values: none gathers them.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = running_sum(counts, [value], "_n", "_upto", "_of", by)
    place = [F.lit(p) * (F.col("_of") - 1) for p in at]
    held = lambda rank: F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank), F.col(value)))
    ends = [held(end(p)).alias(f"_{name}{i}") for i, p in enumerate(place) for name, end in (("lo", F.floor), ("hi", F.ceil))]
    got = ranked.groupBy(*by, "_of").agg(*ends)
    between = lambda i, p: F.when(F.ceil(p) == F.floor(p), F.col(f"_lo{i}").cast("double")).otherwise((F.ceil(p) - p) * F.col(f"_lo{i}") + (p - F.floor(p)) * F.col(f"_hi{i}"))
    return got.select(*by, *[between(i, p).alias(f"q{i}") for i, p in enumerate(place)])


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if a count proves it to have at most ``rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def next_value(df: DataFrame, key: str, out: str, last: Column) -> DataFrame:
    """df (``key`` numeric and unique) with the next greater key, ``last`` after the greatest."""
    bounds = order_bounds(df, key)
    df = df.withColumn("_b", bucket_of(key, bounds))
    heads = df.groupBy("_b").agg(F.min(key).alias("_head"))
    heads = heads.select("_b", F.lead("_head").over(Window.orderBy("_b")).alias("_next"))
    inside = F.lead(key).over(Window.partitionBy("_b").orderBy(key))
    return df.join(F.broadcast(heads), "_b").withColumn(out, F.coalesce(inside, F.col("_next"), last)).drop("_b", "_next")


def points_in_intervals(points: DataFrame, point: str, intervals: DataFrame, lo: str, hi: str, cell: int, on: list[str] | None = None) -> DataFrame:
    """Joins each point to the half-open intervals [lo, hi) that hold it (and agree in ``on``): an equi-join on cells of width ``cell``, then the exact predicate. An interval stands in each cell that it touches."""
    on = on or []
    p = points.withColumn("_cell", F.floor(F.col(point) / cell))
    i = intervals.filter(F.col(hi) > F.col(lo)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(hi) - 1) / cell))))
    return p.join(i, ["_cell", *on]).filter((F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi))).drop("_cell")


def overlaps(a: DataFrame, alo: str, ahi: str, b: DataFrame, blo: str, bhi: str, on: list[str]) -> DataFrame:
    """Joins intervals of a and b that overlap within equal ``on``, with ``lo`` and ``hi`` of the common part."""
    j = a.join(b, on).filter((F.col(alo) < F.col(bhi)) & (F.col(blo) < F.col(ahi)))
    return j.withColumns({"lo": F.greatest(alo, blo), "hi": F.least(ahi, bhi)})


def asof(left: DataFrame, right: DataFrame, key: str, value: str, out: str, greatest: bool = True, on: list[str] | None = None) -> DataFrame:
    """left with the ``value`` of right's greatest key up to (or least key from) each left key: one union, one running window per bucket of both sides' keys, and the last value of the buckets before. Keys are walked downwards for the least one, as a window that looks ahead starts anew at every row."""
    on = on or []
    side = F.min_by if greatest else F.max_by
    r = right.filter(F.col(key).isNotNull()).select(*on, F.col(key).alias("_k"), F.col(value).alias("_v"))
    r = r.groupBy(*on, "_k").agg(side("_v", "_v").alias("_v")).withColumns({"_side": F.lit(0), "_row": F.lit(None).cast("struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in left.schema) + ">")})
    m = left.select(*on, F.col(key).alias("_k"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.struct(*left.columns).alias("_row"))
    both = r.unionByName(m)
    both = both.withColumn("_b", bucket_of("_k", order_bounds(both.select("_k"), "_k")))
    ends = both.filter("_row is null").groupBy(*on, "_b").agg((F.max_by if greatest else F.min_by)("_v", "_k").alias("_end"))
    slots = both.select(*on, "_b").distinct().join(ends, [*on, "_b"], "left")
    along = F.asc if greatest else F.desc
    step = Window.partitionBy(*(on or [F.lit(0)])).orderBy(along("_b")).rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(*on, "_b", F.last("_end", True).over(step).alias("_carry"))
    inside = Window.partitionBy(*on, "_b").orderBy(along("_k"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("_near", F.last("_v", True).over(inside)).filter("_row is not null").join(slots, [*on, "_b"], "left")
    return got.select("_row.*", F.when(F.col("_k").isNotNull(), F.coalesce("_near", "_carry")).alias(out))


def shuffled(df: DataFrame) -> DataFrame:
    """df marked for a shuffled join: a plan's estimate may take what an explode or a join makes for small, and broadcast it through the driver."""
    return df.hint("merge")


def cell_neighbours(a: DataFrame, b: DataFrame, coords: list[str], radius: float, on: list[str] | None = None, rows: int = 0) -> DataFrame:
    """Pairs of rows of a and b (columns prefixed a_ and b_) nearer than ``radius``: b stands in the 3**d cells around its own, an equi-join on cells, then the exact distance. For few dimensions. b is broadcast only if a count proves it to have ``rows`` rows at most."""
    on = on or []
    cells = lambda p: [F.floor(F.col(f"{p}{c}") / radius).alias(f"_c{i}") for i, c in enumerate(coords)]
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns if c not in on], *on)
    left = left.select("*", *cells("a_"))
    few = rows and b.limit(rows + 1).count() <= rows
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns if c not in on], *on)
    right = right.select("*", *cells("b_"))
    for i in range(len(coords)):
        right = right.withColumn(f"_c{i}", F.explode(F.array(*[F.col(f"_c{i}") + s for s in (-1, 0, 1)])))
    d2 = sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in coords), F.lit(0.0))
    keys = [*on, *(f"_c{i}" for i in range(len(coords)))]
    return left.join(F.broadcast(right) if few else shuffled(right), keys).withColumn("d2", d2).filter(F.col("d2") < radius * radius).drop(*(f"_c{i}" for i in range(len(coords))))


def cut(df: DataFrame) -> DataFrame:
    """df computed once, for plans that read it again and again: checkpointed where a checkpoint folder is set, which cuts the lineage, else persisted."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def iterate_until(df: DataFrame, step: Callable[[DataFrame], DataFrame], done: Callable[[DataFrame], bool], most: int = 1000) -> DataFrame:
    """Applies step until done, ``most`` times at most; each state is cut, so lineage stays short and lost executors cost one step."""
    for _ in range(most):
        df = cut(df)
        if done(df):
            break
        df = step(df)
    return df
