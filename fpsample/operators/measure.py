"""Density measure of a sample's spread.

Kernel densities at one bandwidth, over one number of units, enter only as ratios of degree 0, so neighbour counts stand
for them: the measure is exact in whole numbers up to its last formula.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fpsample.functions import kernels as K
from fpsample.operators.clustering import AggregateBalancedKMeans
from fpsample.plans.recipes import cell_neighbours, cut, shuffled, small

#: Score of a shift by an eighth turn, and variation at the same (fixed values).
LIMIT, VARIATION = math.sin(math.pi / 8) / math.sin(math.pi / 4), 1 - math.cos(math.pi / 8)


def scott(n: int, d: int) -> float:
    """Scott's bandwidth."""
    return n ** (-1.0 / (d + 4))


def tophat_counts(units: DataFrame, coords: list[str], radius: float, at: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """Number of units nearer than radius to each row of ``at`` (the units themselves by default), itself included: (on, unit_id, cnt).

    Units of one place are counted first and places alone meet, so copies do not multiply pairs; pairs are shuffled, as they
    stand in nine cells each, unless a count proves the places to be few.
    """
    on = on or []
    at = units if at is None else at
    held = units.groupBy(*on, *coords).agg(F.count("*").alias("n"))
    places = at.select(*on, *coords).distinct()
    pairs = cell_neighbours(places, held, coords, radius, on, rows=20_000)
    counts = pairs.groupBy(*on, *[F.col(f"a_{c}").alias(c) for c in coords]).agg(F.sum("b_n").alias("cnt"))
    return at.select(*on, "unit_id", *coords).join(shuffled(counts), [*on, *coords]).select(*on, "unit_id", "cnt")


def scale(score: Column) -> Column:
    return F.greatest(F.least(score, F.lit(LIMIT)), F.lit(-LIMIT)) / LIMIT


def density_scores(counts: DataFrame, by: list[str]) -> DataFrame:
    """counts: by, unit_id, cnt, cnt_shifted -> spread, var_scaled, combined."""
    d, s = F.col("cnt").cast("double"), F.col("cnt_shifted").cast("double")
    norm = F.sqrt(d * d + s * s)
    agg = counts.groupBy(*by).agg(F.avg(scale((d - s) / norm)).alias("spread"), F.avg(1 - (d + s) / (F.lit(math.sqrt(2)) * norm)).alias("_v"))
    var = F.least(F.col("_v"), F.lit(VARIATION)) / VARIATION
    return agg.select(*by, "spread", var.alias("var_scaled"), (F.col("spread") + (F.signum("spread") - F.col("spread")) * var).alias("combined"))


def shifted(units: DataFrame, centres: DataFrame, assigned: DataFrame, coords: list[str]) -> DataFrame:
    """Each cluster of units moved by (its sample point - its centroid), for every draw: assigned has draw_id, cluster_id, unit_id."""
    point = units.select("unit_id", *[F.col(c).alias(f"p_{c}") for c in coords])
    centre = centres.select("cluster_id", *[F.col(c).alias(f"m_{c}") for c in coords])
    moves = assigned.join(point, "unit_id").join(F.broadcast(centre), "cluster_id").select("draw_id", "cluster_id", *[(F.col(f"p_{c}") - F.col(f"m_{c}")).alias(f"d_{c}") for c in coords])
    return units.join(small(moves), "cluster_id").select("draw_id", "unit_id", "cluster_id", *[(F.col(c) + F.col(f"d_{c}")).alias(c) for c in coords])


def assign_to_centroids(samples: DataFrame, units: DataFrame, centres: DataFrame, coords: list[str]) -> DataFrame:
    """Least total distance between each draw's points and the centroids (k rows, held by each task): (draw_id, cluster_id, unit_id)."""
    held = centres.orderBy("cluster_id").toPandas()
    c, names = held[coords].to_numpy(float), held["cluster_id"].to_numpy()

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["slot", "unit_id"])
        cost = np.sqrt(K.squares(frame[coords].to_numpy(float), c))
        return pd.DataFrame({"draw_id": frame["draw_id"].to_numpy(), "cluster_id": names[K.assignment(cost)], "unit_id": frame["unit_id"].to_numpy()})

    points = samples.join(units.select("unit_id", *coords), "unit_id")
    return points.groupBy("draw_id").applyInPandas(one, "draw_id long, cluster_id int, unit_id long")


class Density:
    """Measure of the spread of samples of k units: the units' clusters are moved onto the sample's points and densities before and after are compared."""

    def __init__(self, units: DataFrame, k: int, coords: list[str] | None = None, seed: int = 0, tolerance: int = 5):
        self.coords = coords or ["x", "y"]
        self.k = k
        member = AggregateBalancedKMeans(k, tolerance=tolerance, seed=seed).fit(units, self.coords, ["pi"])
        label = member.groupBy("unit_id").agg(F.max_by("cluster_id", F.struct("frac", -F.col("cluster_id"))).alias("cluster_id"))
        self.units = cut(units.join(label, "unit_id").select("unit_id", "cluster_id", *self.coords))
        self.centres = self.units.groupBy("cluster_id").agg(*[F.avg(c).alias(c) for c in self.coords])
        self.radius = scott(self.units.count(), len(self.coords))
        self.original = tophat_counts(self.units, self.coords, self.radius)

    def counts(self, samples: DataFrame) -> DataFrame:
        """draw_id, unit_id, cnt, cnt_shifted."""
        moved = shifted(self.units, self.centres, assign_to_centroids(samples, self.units, self.centres, self.coords), self.coords)
        # densities of the moved units at the places of the original ones; a unit with none near counts 0
        places = moved.select("draw_id").distinct().join(self.units.select("unit_id", *self.coords))
        near = tophat_counts(moved, self.coords, self.radius, places, ["draw_id"]).withColumnRenamed("cnt", "cnt_shifted")
        return places.select("draw_id", "unit_id").join(self.original, "unit_id").join(near, ["draw_id", "unit_id"], "left").fillna(0, ["cnt_shifted"])

    def score(self, samples: DataFrame) -> DataFrame:
        return density_scores(self.counts(samples), ["draw_id"])
