"""First-order inclusion probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fpsample.functions.nano import ONE, whole_div
from fpsample.plans.recipes import running_sum


def proportional(units: DataFrame, size: str, n: int) -> DataFrame:
    """units (``unit_id`` unique, ``size`` a positive BIGINT) with lo_nano, hi_nano, pi_nano: bars of height n * size / total, end to end in the order of unit_id.

    Cumulative sizes are scaled, not single ones, so the last bar ends at n exactly. No size may exceed total / n.
    """
    c = running_sum(units.withColumn("_s", F.col(size).cast("bigint")), ["unit_id"], "_s", "_cs", "_t")
    wide = lambda v: whole_div(v.cast("decimal(20,0)") * F.lit(n * ONE).cast("decimal(18,0)"), F.col("_t"))
    c = c.withColumns({"lo_nano": wide(F.col("_cs") - F.col("_s")), "hi_nano": wide(F.col("_cs"))})
    return c.withColumn("pi_nano", F.col("hi_nano") - F.col("lo_nano")).drop("_s", "_cs", "_t")


def equal(units: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """units with pi = n / N, N counted over all rows or over each ``by``."""
    by = by or []
    counts = units.groupBy(*by).agg(F.count("*").alias("_n"))
    out = units.join(counts, by) if by else units.withColumn("_n", F.lit(units.count()))
    return out.withColumn("pi", F.lit(float(n)) / F.col("_n")).drop("_n")


def normalised(units: DataFrame, weight: Column, n: int, by: list[str] | None = None) -> DataFrame:
    """units with pi = n * weight / sum of weights; unlike probabilities with certainty units it may exceed 1."""
    by = by or []
    units = units.withColumn("_w", weight)
    sums = units.groupBy(*by).agg(F.sum("_w").alias("_t"))
    out = units.join(sums, by) if by else units.withColumn("_t", F.lit(sums.first()[0]))
    return out.withColumn("pi", F.lit(float(n)) * F.col("_w") / F.col("_t")).drop("_w", "_t")


def reweighted(units: DataFrame, above: float, add: float, n: int) -> DataFrame:
    """pi raised by ``add`` where it exceeds ``above``, then all rescaled to sum to n."""
    return normalised(units, F.when(F.col("pi") > above, F.col("pi") + add).otherwise(F.col("pi")), n)


def with_certainty(units: DataFrame, size: str, n: int) -> DataFrame:
    """units with pi proportional to size, 1 for units that would exceed 1, the rest rescaled, and take_all.

    One pass: with sizes in descending order (ties by unit_id), the first k are taken for certain for the least k at which
    (n - k) * next size <= the rest's total. At most n units are certain, so the cut is sought among the n largest only.
    """
    total = units.agg(F.sum(F.col(size).cast("bigint"))).first()[0] or 0
    largest = units.select("unit_id", F.col(size).cast("bigint").alias("s")).orderBy(F.desc("s"), "unit_id").limit(n)
    order = Window.orderBy(F.desc("s"), "unit_id")  # over n rows at most
    ranked = largest.select("unit_id", "s", (F.row_number().over(order) - 1).alias("k"), (F.sum("s").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("taken"))
    cut = ranked.filter((F.lit(n) - F.col("k")) * F.col("s") <= F.lit(total) - F.col("taken")).agg(F.min_by(F.struct("k", "taken"), "k").alias("c")).first().c
    k, taken = (cut.k, cut.taken) if cut else (n, ranked.agg(F.sum("s")).first()[0] or 0)
    certain = ranked.filter(F.col("k") < k).select("unit_id", F.lit(True).alias("_all"))
    out = units.join(F.broadcast(certain), "unit_id", "left")
    rest = F.col(size).cast("double") * (n - k) / max(total - taken, 1)
    return out.withColumns({"take_all": F.coalesce("_all", F.lit(False))}).withColumn("pi", F.when(F.col("take_all"), 1.0).otherwise(rest)).drop("_all")
