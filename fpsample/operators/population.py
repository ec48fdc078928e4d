"""Populations cut into clusters and zones.

A cluster's units, sorted by x, are cut into strips of equal mass, each strip, sorted by y, into cells of equal mass; a
unit across a border is shared. All masses are whole nanos, so zones sum exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpsample.functions.nano import ONE
from fpsample.operators.clustering import DublyBalancedKMeans
from fpsample.plans.recipes import cut, running_sum


def sweep(units: DataFrame, group: list[str], order: list[str], mass: str, parts: int, zone: str) -> DataFrame:
    """Cuts each group's ordered units into ``parts`` zones of equal mass (BIGINT; zone i ends at total * (i + 1) div parts): (units' columns, zone, with ``mass`` the part inside).

    Each unit's cumulative interval meets the zones that it overlaps by arithmetic on zone numbers, so no join is needed;
    half-open intervals give a border to the later zone. The running sum is the two-phase one, so a group may be of any size.
    """
    c = running_sum(units, order, mass, "_hi", "_t", group)
    c = c.filter(F.col(mass) > 0).withColumn("_lo", F.col("_hi") - F.col(mass))
    bound = lambda i: F.call_function("div", i * F.col("_t"), F.lit(parts)).cast("bigint")
    # the zone of position p is the greatest i with i * total div parts <= p
    zone_of = lambda p: F.least(F.call_function("div", p * parts + (parts - 1), F.col("_t")).cast("int"), F.lit(parts - 1))
    c = c.withColumn(zone, F.explode(F.sequence(F.greatest(zone_of(F.col("_lo")) - 1, F.lit(0)), zone_of(F.col("_hi") - 1))))
    part = F.least(F.col("_hi"), bound(F.col(zone) + 1)) - F.greatest(F.col("_lo"), bound(F.col(zone)))
    return c.withColumn("_part", part).filter("_part > 0").withColumn(mass, F.col("_part")).drop("_hi", "_lo", "_t", "_part")


def zones(units: DataFrame, group: list[str], n_zones: tuple[int, int], mass: str = "mass_nano", x: str = "x", y: str = "y") -> DataFrame:
    """units cut into strips along x and cells along y: with zone_x, zone_y, zone_id."""
    strips = sweep(units, group, [x, "unit_id"], mass, n_zones[0], "zone_x")
    cells = sweep(strips, [*group, "zone_x"], [y, "unit_id"], mass, n_zones[1], "zone_y")
    return cells.withColumn("zone_id", F.col("zone_x") * n_zones[1] + F.col("zone_y"))


def stabilised_zones(cells: DataFrame, group: list[str], n_zones: tuple[int, int], digits: int, mass: str = "mass") -> DataFrame:
    """Masses rounded (ties to even), slivers left out, each zone rescaled to 1 / number of zones."""
    r = cells.withColumn("_m", F.bround(mass, digits)).filter("_m > 0")
    total = r.groupBy(*group, "zone_id").agg(F.sum("_m").alias("_t"))
    return r.join(total, [*group, "zone_id"]).withColumn(mass, F.col("_m") / F.col("_t") / (n_zones[0] * n_zones[1])).select(*cells.columns)


def zone_totals(cells: DataFrame, group: list[str], mass: str = "mass_nano") -> DataFrame:
    """Units and mass of each zone."""
    return cells.groupBy(*group, "zone_id").agg(F.count("*").alias("units"), F.sum(mass).alias("mass"))


class Population:
    """units: unit_id, x, y, pi (summing to n_clusters). Builds ``membership``, and ``zones`` with mass_nano.

    A fit holds its population in one task. ``by`` names columns that cut larger ones into strata, each with n_clusters
    clusters of its own (its pi sum to that) and fitted in a task of its own; results then have these columns as well.
    """

    def __init__(self, units: DataFrame, *, n_clusters: int, n_zones: tuple[int, int] | int = (2, 2), tolerance: int = 3, seed: int = 0, membership: DataFrame | None = None, by: list[str] | None = None):
        self.by = by = by or []
        self.units = units
        self.n_clusters = n_clusters
        self.n_zones = (n_zones, n_zones) if isinstance(n_zones, int) else tuple(n_zones)
        self.tolerance = tolerance
        fitted = DublyBalancedKMeans(n_clusters, seed=seed).fit(units, ["x", "y"], ["pi"], by) if membership is None else membership
        self.membership = fitted = cut(fitted)  # the fit runs once
        parts = fitted.join(units.select(*by, "unit_id", "x", "y"), [*by, "unit_id"]).withColumn("mass_nano", F.bround(F.col("mass") * ONE, 0).cast("bigint"))
        self.clusters = parts.select(*by, "cluster_id", "unit_id", "x", "y", "mass", "mass_nano")
        self.zones = zones(self.clusters.drop("mass"), [*by, "cluster_id"], self.n_zones)

    def nested(self) -> DataFrame:
        """One row per cluster and zone with its units as an array."""
        return self.zones.groupBy(*self.by, "cluster_id", "zone_id").agg(F.array_sort(F.collect_list(F.struct("unit_id", "x", "y", "mass_nano"))).alias("units"))

    def plot(self) -> DataFrame:
        from fpsample.sources.plotdata import hulls

        return hulls(self.zones)

    def plot_with_samples(self, samples: DataFrame, max_cols: int = 4) -> DataFrame:
        from fpsample.sources.plotdata import facets

        return facets(samples, self.units, max_cols)
