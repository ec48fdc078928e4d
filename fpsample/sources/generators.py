"""Seeded generators of populations. Values are hashes of seed, batch, unit and dimension: they do not depend on partitions.

Shapes: None or an int N, (N,), (N, D), (B, N) is not told from (N, D), so batches are given as (B, N, D).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fpsample.operators.sampling import uniform


def check_size(size, fixed_dim: int | None = None) -> tuple[int, int, int]:
    """(batches, units, dimensions); ValueError for anything but positive whole numbers, or dimensions other than fixed_dim."""
    shape = (1,) if size is None else (size,) if isinstance(size, int) else tuple(size)
    if not 1 <= len(shape) <= 3 or any(not isinstance(s, (int, np.integer)) or isinstance(s, bool) or s < 1 for s in shape):
        raise ValueError(f"size {size!r} is no shape of one to three positive whole numbers")
    d = fixed_dim or 1
    batches, n, dims = {1: (1, *shape, d), 2: (1, *shape), 3: shape}[len(shape)]
    if fixed_dim and dims != fixed_dim:
        raise ValueError(f"size {size!r} must have {fixed_dim} dimensions")
    return batches, n, dims


class Generator:
    def __init__(self, spark: SparkSession, seed: int | None = None):
        self.spark, self.seed = spark, 0 if seed is None else seed

    def _rows(self, batches: int, n: int) -> DataFrame:
        div = F.call_function("div", F.col("id"), F.lit(n))
        return self.spark.range(batches * n).select(div.alias("batch_id"), (F.col("id") % n).alias("unit_id"))

    def _u(self, dim: int, kind: int = 0) -> Column:
        return uniform(self.seed, "batch_id", "unit_id", F.lit(dim), F.lit(kind))

    def _normal(self, dim: int) -> Column:
        """Box and Muller's normal deviate of two uniform ones."""
        return F.sqrt(-2 * F.log(1 - self._u(dim, 1))) * F.cos(2 * math.pi * self._u(dim, 2))

    def _coords(self, batches: int, n: int, values: list[Column]) -> DataFrame:
        return self._rows(batches, n).select("batch_id", "unit_id", F.array(*values).alias("coords"))

    def grid_coordinates(self, size) -> DataFrame:
        """Lattices of N**D points on [0, 1]**D, the first two axes with the first fastest, further ones in order."""
        batches, n, d = check_size(size)
        order = [1, 0, *range(2, d)] if d >= 2 else [0]
        step = lambda a: F.call_function("div", F.col("unit_id"), F.lit(n ** (d - 1 - order[a]))) % n / float(max(n - 1, 1))
        return self._coords(batches, n**d, [step(a) for a in range(d)])

    def random_coordinates(self, size) -> DataFrame:
        batches, n, d = check_size(size)
        return self._coords(batches, n, [self._u(i) for i in range(d)])

    def uniform_coordinates(self, low: float, high: float, size) -> DataFrame:
        batches, n, d = check_size(size)
        return self._coords(batches, n, [low + (high - low) * self._u(i) for i in range(d)])

    def normal_1D_coordinates(self, mean: float, std: float, size) -> DataFrame:
        batches, n, _ = check_size(size, 1)
        return self._coords(batches, n, [mean + std * self._normal(0)])

    def normal_mD_coordinates(self, mean: list[float], cov: list[list[float]], size) -> DataFrame:
        batches, n, d = check_size(size, len(mean))
        root = np.linalg.cholesky(np.asarray(cov, float))
        deviates = [self._normal(i) for i in range(d)]
        return self._coords(batches, n, [sum((float(root[i, j]) * deviates[j] for j in range(i + 1)), F.lit(float(mean[i]))) for i in range(d)])

    def cluster_coordinates(self, n_clusters: int, cluster_std: float | list[float], size) -> DataFrame:
        """Points about uniform centres, with their ``cluster_id``; centres are computed in place, so nothing is joined."""
        batches, n, d = check_size(size)
        stds = [float(cluster_std)] * n_clusters if isinstance(cluster_std, (int, float)) else [float(s) for s in cluster_std]
        if n_clusters < 1 or len(stds) != n_clusters:
            raise ValueError("cluster_std is one number or one for each cluster")
        c = F.floor(self._u(0, 3) * n_clusters).cast("int")
        rows = self._rows(batches, n).withColumn("cluster_id", c)
        std = F.element_at(F.array(*map(F.lit, stds)), F.col("cluster_id") + 1)
        centre = lambda i: uniform(self.seed, "batch_id", "cluster_id", F.lit(i), F.lit(4))
        return rows.select("batch_id", "unit_id", "cluster_id", F.array(*[centre(i) + std * self._normal(i) for i in range(d)]).alias("coords"))

    def equal_probabilities(self, n: int, size) -> DataFrame:
        batches, units, _ = check_size(size)
        self._check(n, units)
        return self._rows(batches, units).withColumn("pi", F.lit(n / units))

    def unequal_probabilities(self, n: int, size) -> DataFrame:
        """Uniform deviates scaled to sum to n in each batch; not clipped at 1."""
        batches, units, _ = check_size(size)
        self._check(n, units)
        u = self._rows(batches, units).withColumn("_u", self._u(0, 5))
        sums = u.groupBy("batch_id").agg(F.sum("_u").alias("_t"))
        return u.join(F.broadcast(sums) if batches <= 100_000 else sums, "batch_id").select("batch_id", "unit_id", (F.col("_u") * n / F.col("_t")).alias("pi"))

    @staticmethod
    def _check(n: int, units: int) -> None:
        if not 1 <= n <= units:
            raise ValueError(f"n must lie between 1 and {units}")


def rng(spark: SparkSession, seed: int | None = None) -> Generator:
    return Generator(spark, seed)
