"""Criteria score designs. Subclass Criteria for others."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpsample.functions.nano import ONE
from fpsample.operators.design import Design


class Criteria(ABC):
    """units has unit_id, the auxiliary variable ``x`` and ``pi_nano``."""

    def __init__(self, units: DataFrame, x: str = "x"):
        self.units = units.select("unit_id", F.col(x).cast("double").alias("x"), "pi_nano")

    @abstractmethod
    def __call__(self, design: Design) -> DataFrame:
        """(design_id, value)."""

    @abstractmethod
    def of_array(self, prob: np.ndarray, members: np.ndarray, x: np.ndarray, pi: np.ndarray) -> float:
        """The same of one small design in memory: members[s, i] tells whether sample s has unit i."""

    def terms(self, samples: list[list[int]], x: np.ndarray, pi: np.ndarray) -> np.ndarray | None:
        """For criteria that are a sum over samples, less a constant: what each sample (places of its units) adds for each unit of probability. None: a search scores designs by ``of_array``, and holds the matrix of members."""
        return None

    def constant(self, x: np.ndarray) -> float:
        return 0.0


class VarNHT(Criteria):
    """Variance of the Narain-Horvitz-Thompson estimator of the total of x: sum of p(s) * (sum of x / pi in s)**2, less the total squared."""

    def __call__(self, design: Design) -> DataFrame:
        ratio = self.units.select("unit_id", (F.col("x") * ONE / F.col("pi_nano")).alias("ratio"))
        totals = design.long().join(ratio, "unit_id").groupBy("design_id", "seq", "prob_nano").agg(F.sum("ratio").alias("t"))
        square = totals.groupBy("design_id").agg((F.sum(F.col("prob_nano") * F.col("t") * F.col("t")) / ONE).alias("square"))
        total = self.units.agg(F.sum("x")).first()[0] or 0.0
        return square.select("design_id", (F.col("square") - total * total).alias("value"))

    def of_array(self, prob: np.ndarray, members: np.ndarray, x: np.ndarray, pi: np.ndarray) -> float:
        t = members @ (x / pi)
        return float((prob * t * t).sum() - x.sum() ** 2)

    def terms(self, samples: list[list[int]], x: np.ndarray, pi: np.ndarray) -> np.ndarray:
        at = np.fromiter((i for s in samples for i in s), int)
        t = np.bincount(np.repeat(np.arange(len(samples)), [len(s) for s in samples]), (x / pi)[at], len(samples))
        return t * t

    def constant(self, x: np.ndarray) -> float:
        return float(x.sum() ** 2)
