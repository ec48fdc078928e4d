"""Sampling designs as DataFrames: one row a sample, ``design_id, seq, prob_nano, ids`` with ids sorted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fpsample.functions.nano import ONE, validate
from fpsample.plans.recipes import cut, next_value, points_in_intervals, running_sum

COLUMNS = ("design_id", "seq", "prob_nano", "ids")


def systematic(bars: DataFrame) -> DataFrame:
    """The systematic design of bars (unit_id, lo_nano, hi_nano) that stand end to end: (start_nano, prob_nano, ids).

    Bars wrap at one. Every breakpoint starts an interval of heights; the sample of an interval is all bars across it. Bars
    are cut at whole numbers and joined to breakpoints by cells of heights, so no task sees more than a few cells.
    """
    bars = bars.filter("hi_nano > lo_nano")
    starts = bars.select(F.pmod("lo_nano", F.lit(ONE)).alias("start_nano")).distinct()
    spans = next_value(starts, "start_nano", "end_nano", F.lit(ONE))
    whole = F.explode(F.sequence(F.floor(F.col("lo_nano") / ONE), F.floor((F.col("hi_nano") - 1) / ONE))).alias("row")
    pieces = bars.select("unit_id", "lo_nano", "hi_nano", whole)
    pieces = pieces.select("unit_id", F.greatest(F.col("lo_nano") - F.col("row") * ONE, F.lit(0)).alias("a"), F.least(F.col("hi_nano") - F.col("row") * ONE, F.lit(ONE)).alias("b"))
    cells = max(1, min(1 << 20, bars.count() // 64))
    hits = points_in_intervals(spans, "start_nano", pieces, "a", "b", ONE // cells + 1)
    return hits.groupBy("start_nano", "end_nano").agg(F.array_sort(F.collect_list("unit_id")).alias("ids")).select("start_nano", (F.col("end_nano") - F.col("start_nano")).alias("prob_nano"), "ids")


class Design:
    """An immutable design over a DataFrame of samples; operations give new designs.

    ``prob_nano`` is the sample's probability in billionths; samples under one billionth are dropped, as they are almost
    zero. Samples are ordered by probability, ties by ids.
    """

    def __init__(self, samples: DataFrame, changes: int = 0):
        if "design_id" not in samples.columns:
            samples = samples.withColumn("design_id", F.lit(0).cast("bigint"))
        if "seq" not in samples.columns:
            samples = samples.withColumn("seq", F.col("start_nano") if "start_nano" in samples.columns else F.xxhash64("ids", "prob_nano"))
        self.samples = samples.select(F.col("design_id").cast("bigint").alias("design_id"), F.col("seq").cast("bigint").alias("seq"), F.col("prob_nano").cast("bigint").alias("prob_nano"), F.array_sort("ids").alias("ids"))
        self.changes = changes

    @classmethod
    def from_population(cls, units: DataFrame, check: bool = True) -> Design:
        """The initial, systematic design of units (unit_id, pi_nano, and lo_nano, hi_nano if they stand already)."""
        if check:
            validate(units)
        if "hi_nano" not in units.columns:
            units = running_sum(units, ["unit_id"], "pi_nano", "hi_nano").withColumn("lo_nano", F.col("hi_nano") - F.col("pi_nano"))
        return cls(systematic(units))

    def copy(self) -> Design:
        return Design(self.samples, self.changes)

    def long(self) -> DataFrame:
        """One row per sample and unit."""
        return self.samples.select("design_id", "seq", "prob_nano", F.explode("ids").alias("unit_id"))

    def push(self, more: DataFrame) -> Design:
        """With more samples; those of probability under a billionth are dropped."""
        return Design(self.samples.unionByName(Design(more).samples).filter("prob_nano >= 1"), self.changes)

    def pull(self, count: int = 1, random: bool = False, seed: int = 0) -> tuple[DataFrame, Design]:
        """(the ``count`` most probable samples of each design, or seeded random ones; the rest)."""
        by = [F.xxhash64(F.lit(seed), "seq", "ids")] if random else [F.desc("prob_nano"), F.col("ids")]
        ranked = self.samples.withColumn("rank", F.row_number().over(Window.partitionBy("design_id").orderBy(*by, "seq")))
        top = ranked.filter(F.col("rank") <= count)  # each task keeps its own first rows before they meet
        return top, Design(self.samples.exceptAll(top.drop("rank")), self.changes)

    def merge_identical(self) -> Design:
        """One sample for each set of ids, probabilities summed."""
        merged = self.samples.groupBy("design_id", "ids").agg(F.sum("prob_nano").alias("prob_nano"), F.min("seq").alias("seq"))
        return Design(merged, self.changes)

    def iterate(self, coefficient: float = 0.5, random_pull: bool = False, seed: int | None = None) -> Design:
        """One change: the two pulled samples are merged if they are equal, else switched. Designs of fewer than two samples stay as they are."""
        top, rest = Design(cut(self.samples), self.changes).pull(2, random_pull, seed or 0)
        pair = top.groupBy("design_id").agg(*[F.max(F.when(F.col("rank") == r, F.struct("prob_nano", "ids"))).alias(f"s{r}") for r in (1, 2)])
        kept = pair.filter("s2 is null").select("design_id", "s1.prob_nano", "s1.ids")
        changed = switch(pair.filter("s2 is not null"), coefficient, seed)
        same = rest.samples.select("design_id", "seq", "prob_nano", "ids")
        new = kept.unionByName(changed).withColumn("seq", F.xxhash64("ids", "prob_nano"))
        return Design(same.unionByName(new.select(*COLUMNS)).filter("prob_nano >= 1"), self.changes + 1)

    def inclusion(self) -> DataFrame:
        """First-order inclusion probabilities of the design."""
        return self.long().groupBy("design_id", "unit_id").agg(F.sum("prob_nano").alias("pi_nano"))

    def joint_inclusion(self) -> DataFrame:
        """Second-order inclusion probabilities: pairs i < j that share a sample. Pairs are made inside a sample, n (n - 1) / 2 each, as the result asks."""
        first = self.samples.select("design_id", "prob_nano", "ids", F.posexplode("ids").alias("p", "i"))
        pairs = first.select("design_id", "prob_nano", "i", F.explode(F.slice("ids", F.col("p") + 2, F.size("ids"))).alias("j"))
        return pairs.groupBy("design_id", "i", "j").agg(F.sum("prob_nano").alias("pi_nano"))

    def bars(self) -> DataFrame:
        """Plot data: each unit's segment [y0, y1) for each sample, samples stacked in order."""
        stacked = running_sum(self.samples, ["seq"], "prob_nano", "y1", on=["design_id"]).withColumn("y0", F.col("y1") - F.col("prob_nano"))
        return stacked.select("design_id", F.explode("ids").alias("unit_id"), "y0", "y1")

    def signature(self) -> DataFrame:
        """A hash by which designs are equal whatever the order of their samples: sums of two hashes of the samples, and their number, so no design gathers anywhere."""
        parts = [F.sum(F.xxhash64(F.lit(seed), "ids", "prob_nano").cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
        return self.samples.groupBy("design_id").agg(F.sha2(F.concat_ws(":", *parts, F.count("*").cast("string")), 256).alias("signature"))


def switch(pairs: DataFrame, coefficient: float = 0.5, seed: int | None = None) -> DataFrame:
    """Exchanges one unit between two samples, keeping every inclusion probability.

    pairs: design_id, s1, s2 (structs prob_nano, ids). A unit of s1 alone and one of s2 alone change places in a part of
    probability coefficient * the smaller one's; the least such units without a seed, seeded picks with one. Equal samples
    are merged; samples of which one holds the other stay as they are; parts under a billionth go.
    """
    only = {1: F.array_sort(F.array_except("s1.ids", "s2.ids")), 2: F.array_sort(F.array_except("s2.ids", "s1.ids"))}

    def pick(a, k: int):
        at = F.lit(1) if seed is None else (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), a), F.size(a)) + 1).cast("int")
        return F.when(F.size(a) > 0, F.element_at(a, F.when(F.size(a) > 0, at).otherwise(1)))

    d = pairs.select("design_id", "s1", "s2", pick(only[1], 1).alias("n1"), pick(only[2], 2).alias("n2"))
    d = d.withColumn("len", F.floor(F.least("s1.prob_nano", "s2.prob_nano") * F.lit(coefficient)).cast("bigint"))
    sample = lambda p, ids: F.struct(p.cast("bigint").alias("prob_nano"), F.array_sort(ids).alias("ids"))
    change = lambda s, out, new: F.array_union(F.array_except(f"{s}.ids", F.array(out)), F.array(new))
    four = F.array(
        sample(F.col("len"), change("s1", "n1", "n2")), sample(F.col("s1.prob_nano") - F.col("len"), F.col("s1.ids")),
        sample(F.col("len"), change("s2", "n2", "n1")), sample(F.col("s2.prob_nano") - F.col("len"), F.col("s2.ids")),
    )
    merged = F.array(sample(F.col("s1.prob_nano") + F.col("s2.prob_nano"), F.col("s1.ids")))
    stay = F.array(sample(F.col("s1.prob_nano"), F.col("s1.ids")), sample(F.col("s2.prob_nano"), F.col("s2.ids")))
    both = F.when(F.array_sort("s1.ids") == F.array_sort("s2.ids"), merged).when(F.col("n1").isNull() | F.col("n2").isNull(), stay).otherwise(four)
    return d.select("design_id", F.explode(both).alias("s")).select("design_id", "s.prob_nano", "s.ids").filter("prob_nano >= 1")
