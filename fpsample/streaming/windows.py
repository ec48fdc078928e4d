"""Fixed-size samples of event streams, one for each time window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def table_window_samples(events: DataFrame, n: int, width: str = "1 hour", seed: int = 0) -> DataFrame:
    """n events (event_id, ts) of each window with equal chances: those of the least seeded hashes. (start, event_id, rank)."""
    keyed = events.select("event_id", F.window(F.col("ts").cast("timestamp"), width)["start"].alias("start"), F.xxhash64(F.lit(seed), "event_id").alias("_h"))
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("start").orderBy("_h", "event_id")))
    return ranked.filter(F.col("rank") <= n).select("start", "event_id", "rank")


def stream_window_samples(events: DataFrame, n: int, width: str = "1 hour", late: str = "10 minutes", seed: int = 0) -> DataFrame:
    """The same of a stream: (start, event_id, rank, n_events) of a window once the watermark has passed its end; later events are dropped. A window's state is n hashes and ids and a count."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        hashes, ids, count = state.get if state.exists else ([], [], 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"start": [key[0]] * len(ids), "event_id": ids, "rank": range(1, len(ids) + 1), "n_events": count})
            return
        held = list(zip(hashes, ids, strict=True))
        end = None
        for f in frames:
            held = sorted(held + list(zip(f["_h"].tolist(), f["event_id"].tolist(), strict=True)))[:n]
            count += len(f)
            end = int(f["end"].iloc[0])
        state.update(([h for h, _ in held], [i for _, i in held], count))
        if end is not None:
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    window = F.window("ts", width)
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_id").withWatermark("ts", late)
    keyed = timed.select("ts", "event_id", window["start"].alias("start"), F.unix_millis(window["end"]).alias("end"), F.xxhash64(F.lit(seed), "event_id").alias("_h"))
    out = "start timestamp, event_id long, rank int, n_events long"
    return keyed.groupBy("start").applyInPandasWithState(step, out, "h array<long>, ids array<long>, n long", "append", "EventTimeTimeout")
