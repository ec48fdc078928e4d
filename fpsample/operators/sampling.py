"""Samplers. A draw gives (draw_id, slot, unit_id) rows; every random pick is a hash of a seed and a key, so it does not depend on partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fpsample.functions.nano import ONE
from fpsample.operators.population import Population
from fpsample.plans.recipes import points_in_intervals, running_sum


def uniform(seed: int, *keys: Column | str) -> Column:
    """U[0, 1) by hash of seed and keys, 53 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(k) if isinstance(k, str) else k for k in keys]), 11) / F.lit(float(1 << 53))


def zone_bounds(cells: DataFrame, zones: int, by: list[str] | None = None) -> DataFrame:
    """Cumulative nano bounds of each zone's units in the order of unit_id, scaled so that every zone of every cluster spans [zone, zone + 1) * ONE / zones exactly."""
    c = running_sum(cells, ["unit_id"], "mass_nano", "_hi", "_t", [*(by or []), "cluster_id", "zone_id"])
    start = F.call_function("div", F.col("zone_id").cast("bigint") * ONE, F.lit(zones)).cast("bigint")
    width = F.call_function("div", (F.col("zone_id").cast("bigint") + 1) * ONE, F.lit(zones)).cast("bigint") - start
    at = lambda v: start + F.call_function("div", v * width, F.col("_t")).cast("bigint")
    return c.select(*(by or []), "cluster_id", "zone_id", "unit_id", at(F.col("_hi") - F.col("mass_nano")).alias("lo_nano"), at(F.col("_hi")).alias("hi_nano")).filter("hi_nano > lo_nano")


def select_zones(draws: DataFrame, bounds: DataFrame, zones: int, by: list[str] | None = None) -> DataFrame:
    """draws (draw_id, u_nano in [0, ONE)): one u picks the same zone in every cluster and, in it, the unit whose interval holds u. Draws meet the intervals in the cells of u's range, 64 a zone."""
    # the greatest zone whose start, zone * ONE div zones, is not above u
    zone = F.call_function("div", F.col("u_nano") * zones + (zones - 1), F.lit(ONE)).cast("int")
    d = draws.withColumn("zone_id", F.least(zone, F.lit(zones - 1)))
    hit = points_in_intervals(d, "u_nano", bounds, "lo_nano", "hi_nano", max(1, ONE // (64 * zones)), ["zone_id"])
    return hit.select("draw_id", *(by or []), F.col("cluster_id").alias("slot"), "unit_id")


def zone_design(bounds: DataFrame) -> DataFrame:
    """The exact design of select_zones: (start_nano, prob_nano, ids) for every run of u that picks the same units."""
    from fpsample.operators.design import systematic

    bars = bounds.select("unit_id", (F.col("lo_nano") + F.col("cluster_id").cast("bigint") * ONE).alias("lo_nano"), (F.col("hi_nano") + F.col("cluster_id").cast("bigint") * ONE).alias("hi_nano"))
    return systematic(bars)


class KMeansSpatialSampling:
    """n balanced clusters with z0 * z1 zones each; draws are coordinated across clusters. Units across clusters may be drawn twice in one sample. With ``by``, n clusters in each stratum, drawn by the same number."""

    def __init__(self, units: DataFrame, *, n: int, n_zones: tuple[int, int] | int = (2, 2), tolerance: int = 3, seed: int = 0, population: Population | None = None, by: list[str] | None = None):
        self.population = population or Population(units, n_clusters=n, n_zones=n_zones, tolerance=tolerance, seed=seed, by=by)
        z = self.population.n_zones
        self.zones, self.seed = z[0] * z[1], seed
        self.bounds = zone_bounds(self.population.zones, self.zones, self.population.by)

    def sample(self, n_samples: int, spark: SparkSession | None = None) -> DataFrame:
        spark = spark or SparkSession.active()
        draws = spark.range(n_samples).select(F.col("id").alias("draw_id"), F.floor(uniform(self.seed, "id") * ONE).cast("bigint").alias("u_nano"))
        return select_zones(draws, self.bounds, self.zones, self.population.by)

    def design(self) -> DataFrame:
        if self.population.by:
            raise ValueError("each stratum has a design of its own: filter bounds first")
        return zone_design(self.bounds)


class RandomSampling:
    """n units with replacement and equal chances; pi is not used."""

    def __init__(self, units: DataFrame, n: int, seed: int = 0):
        self.n, self.seed = n, seed
        self.numbered = running_sum(units.select("unit_id").withColumn("_one", F.lit(1)), ["unit_id"], "_one", "_number").select("unit_id", (F.col("_number") - 1).cast("bigint").alias("number"))
        self.size = units.count()

    def sample(self, n_samples: int, spark: SparkSession | None = None) -> DataFrame:
        spark = spark or SparkSession.active()
        slots = spark.range(n_samples * self.n).select(F.call_function("div", F.col("id"), F.lit(self.n)).alias("draw_id"), (F.col("id") % self.n).cast("int").alias("slot"))
        picks = slots.withColumn("number", F.floor(uniform(self.seed, "draw_id", "slot") * self.size).cast("bigint"))
        return picks.join(self.numbered, "number").select("draw_id", "slot", "unit_id")


# -- per-draw algorithms, one population or stratum in memory each -------------------------------------
#: Units that a population, or each stratum of it, may have for the samplers below, and numbers in a table of chances: a task holds these.
MOST_UNITS, MOST_CHANCES = 200_000, 100_000_000


def _draws(units: DataFrame, coords: list[str], n_samples: int, seed: int, by: list[str] | None, prepared) -> DataFrame:
    """Draws of ``prepared(pi, points)``, a function of a random generator that picks row numbers: each draw is a row of work, or each stratum of ``by`` is with all its draws."""
    columns = ["unit_id", "pi", *coords]

    def rows(frame: pd.DataFrame, draws: list[int], extra: list) -> pd.DataFrame:
        pick = prepared(frame["pi"].to_numpy(float), frame[coords].to_numpy(float))
        ids = frame["unit_id"].to_numpy()
        found = [ids[pick(np.random.default_rng([seed, *extra, d]))] for d in draws]
        number = np.repeat(draws, [len(x) for x in found]) if draws else np.empty(0, int)
        slots = np.concatenate([np.arange(len(x)) for x in found]) if found else np.empty(0, int)
        return pd.DataFrame({"draw_id": number.astype("int64"), "slot": slots.astype("int32"), "unit_id": np.concatenate(found) if found else ids[:0]})

    if by:
        kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in units.select(*by).schema)

        def stratum(frame: pd.DataFrame) -> pd.DataFrame:
            if len(frame) > MOST_UNITS:
                raise ValueError(f"a stratum has more than {MOST_UNITS} units: cut it further")
            frame = frame.sort_values("unit_id", kind="stable")
            own = rows(frame, list(range(n_samples)), [int(frame["unit_id"].iloc[0]) & 0x7FFFFFFF])
            return own.assign(**{c: frame[c].iloc[0] for c in by})[[*by, "draw_id", "slot", "unit_id"]]

        return units.select(*by, *columns).groupBy(*by).applyInPandas(stratum, kinds + "draw_id long, slot int, unit_id long")

    held = units.select(*columns).orderBy("unit_id").limit(MOST_UNITS + 1).toPandas()
    if len(held) > MOST_UNITS:
        raise ValueError(f"more than {MOST_UNITS} units: sample within strata, by ...")

    def run(batches):
        for b in batches:
            yield rows(held, [int(d) for d in b["draw_id"]], [])

    return units.sparkSession.range(n_samples).withColumnRenamed("id", "draw_id").mapInPandas(run, "draw_id long, slot int, unit_id long")


def _duels(pi: np.ndarray, points: np.ndarray):
    def pick(rng: np.random.Generator) -> np.ndarray:
        p = pi.copy()
        open_ = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
        while len(open_) > 1:
            i = open_[rng.integers(len(open_))]
            d = ((points[open_] - points[i]) ** 2).sum(axis=1)
            d[open_ == i] = np.inf
            near = open_[d == d.min()]
            j = near[rng.integers(len(near))]
            s = p[i] + p[j]
            if s <= 1:
                win, lose = (i, j) if rng.random() < p[i] / s else (j, i)
                p[win], p[lose] = s, 0.0
            else:
                win, lose = (i, j) if rng.random() < (1 - p[j]) / (2 - s) else (j, i)
                p[win], p[lose] = 1.0, s - 1
            done = [x for x in (i, j) if not 1e-9 < p[x] < 1 - 1e-9]
            open_ = open_[~np.isin(open_, done)]
        if len(open_) == 1:
            p[open_[0]] = float(rng.random() < p[open_[0]])
        return np.flatnonzero(p > 0.5)

    return pick


def local_pivotal(units: DataFrame, coords: list[str], n_samples: int, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """Local pivotal method: a random undecided unit and its nearest undecided neighbour duel until all are decided; inclusion probabilities hold and samples spread out. By the published method. With ``by``, each stratum by itself."""
    return _draws(units, coords, n_samples, seed, by, _duels)


def _sums(p: np.ndarray, size: int) -> np.ndarray:
    """r[i, k]: the chance that k of the independent trials p[i:] succeed."""
    r = np.zeros((len(p) + 1, size + 1))
    r[len(p), 0] = 1.0
    for i in range(len(p) - 1, -1, -1):
        r[i] = r[i + 1] * (1 - p[i])
        r[i, 1:] += p[i] * r[i + 1, :-1]
    return r


def _centred(odds: np.ndarray, size: int) -> np.ndarray:
    """Chances of odds times the one factor by which they sum to size: conditional chances do not depend on it, and sums near size stay of ordinary magnitude."""
    lo, hi = -60.0, 60.0
    for _ in range(100):
        mid = (lo + hi) / 2
        w = odds * np.exp(mid)
        lo, hi = (mid, hi) if (w / (1 + w)).sum() < size else (lo, mid)
    w = odds * np.exp(lo)
    return w / (1 + w)


def _entropy(rounds: int):
    def prepared(pi: np.ndarray, points: np.ndarray):
        sure = np.flatnonzero(pi > 1 - 1e-9)
        live = np.flatnonzero((pi <= 1 - 1e-9) & (pi > 1e-12))
        target, size = pi[live], int(round(pi.sum())) - len(sure)
        if len(live) * (size + 1) > MOST_CHANCES:
            raise ValueError("too many units and draws for one table of chances: sample within strata, by ...")
        p = target.copy()
        r = _sums(p, size)
        for _ in range(rounds if 0 < size < len(live) else 0):
            # a unit's conditional chance: it succeeds, k of those before it do and size - 1 - k of those after it
            before = _sums(p[::-1], size)[::-1]
            got = p * (before[:-1, :size] * r[1:, :size][:, ::-1]).sum(axis=1) / r[0, size]
            if np.abs(got - target).max() < 1e-9:
                break
            p = _centred(p / (1 - p) * (target / (1 - target)) * ((1 - got) / got), size)
            r = _sums(p, size)

        def pick(rng: np.random.Generator) -> np.ndarray:
            left, taken = min(size, len(live)), []
            for i in range(len(p)):
                if left and rng.random() * r[i, left] < p[i] * r[i + 1, left - 1]:
                    taken.append(live[i])
                    left -= 1
            return np.sort(np.concatenate([sure, np.array(taken, int)]))

        return pick

    return prepared


def conditional_poisson(units: DataFrame, n_samples: int, seed: int = 0, rounds: int = 200, by: list[str] | None = None) -> DataFrame:
    """Maximum-entropy sampling of fixed size: working chances are fitted so that the conditional inclusion probabilities are pi, then units are taken one by one from the exact conditional chances. By the published method. With ``by``, each stratum by itself, of the size that its pi sum to."""
    return _draws(units, [], n_samples, seed, by, _entropy(rounds))


def find_samples(methods: dict[str, DataFrame]) -> DataFrame:
    """The draws of several methods under their names."""
    out = None
    for name, draws in methods.items():
        d = draws.select(F.lit(name).alias("method"), "draw_id", "slot", "unit_id")
        out = d if out is None else out.unionByName(d)
    return out
