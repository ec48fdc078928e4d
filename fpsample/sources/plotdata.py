"""Plot data: what plots show, as DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fpsample.functions import kernels as K


def hulls(cells: DataFrame) -> DataFrame:
    """Convex hulls of clusters (zone_id null) and of zones: vertices in order and the mean of the vertices. Fewer than three points make no hull. Only points on a rim of their column can be vertices, so these alone are gathered."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        v = K.hull(frame[["x", "y"]].to_numpy(float))
        if len(v) < 3:
            return pd.DataFrame(columns=["cluster_id", "zone_id", "vertex", "x", "y", "mid_x", "mid_y"])
        zone = frame["zone_id"].iloc[0]
        return pd.DataFrame({"cluster_id": frame["cluster_id"].iloc[0], "zone_id": None if pd.isna(zone) else int(zone), "vertex": range(len(v)), "x": v[:, 0], "y": v[:, 1], "mid_x": v[:, 0].mean(), "mid_y": v[:, 1].mean()})

    both = cells.select("cluster_id", "zone_id", "x", "y").unionByName(cells.select("cluster_id", F.lit(None).cast("int").alias("zone_id"), "x", "y"))
    rim = both.groupBy("cluster_id", "zone_id", "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    rim = rim.select("cluster_id", "zone_id", "x", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("y"))
    return rim.groupBy("cluster_id", "zone_id").applyInPandas(one, "cluster_id int, zone_id int, vertex int, x double, y double, mid_x double, mid_y double")


def facets(samples: DataFrame, units: DataFrame, max_cols: int = 4) -> DataFrame:
    """Sampled units with coordinates and the facet (row, column) of their draw."""
    drawn = samples.select("draw_id").distinct().withColumn("_n", F.row_number().over(Window.orderBy("draw_id")) - 1)
    grid = drawn.select("draw_id", F.floor(F.col("_n") / max_cols).cast("int").alias("facet_row"), (F.col("_n") % max_cols).alias("facet_col"))
    return samples.join(units.select("unit_id", "x", "y"), "unit_id").join(grid, "draw_id")
