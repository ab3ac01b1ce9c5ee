"""Signal operators over streams of samples (session, ts, x): causal, with bounded state for each session.

Streams have no lag or lead; a centred filter gives a value once the places
after it are there. State is the last few samples of a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.stencils import stencil_1d


def timed(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """ts as a zoned timestamp with a watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def window_stats(stream: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Count, mean and standard deviation of x by session and time window."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    stats = stream.groupBy(w, "session").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return stats.select(F.col("window.start").alias("start"), "session", "n", "mean", "std")


def savgol_stream(stream: DataFrame, window: int, order: int, derivative: int = 0, rate: float = 1.0) -> DataFrame:
    """Savitzky-Golay values of the places with half a window on both sides: session, ts, y.

    Late samples within a batch are sorted; a sample older than the state's
    newest is put where it belongs only inside its batch.
    """
    weights = stencil_1d(window, order, derivative, rate)
    h = window // 2

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept_ts, kept_x = state.get if state.exists else ([], [])
        new = pd.concat(list(parts)).sort_values(["ts", "x"], kind="stable")
        ts = [*kept_ts, *new["ts"].astype("int64").tolist()]
        x = [*kept_x, *new["x"].astype(float).tolist()]
        out_ts = ts[h : len(x) - h]
        out_y = np.correlate(x, weights, "valid") if len(x) >= window else []
        state.update((ts[-2 * h :], x[-2 * h :]))
        yield pd.DataFrame({"session": [key[0]] * len(out_ts), "ts": out_ts, "y": out_y})

    return stream.select("session", "ts", "x").groupBy("session").applyInPandasWithState(
        step, "session bigint, ts bigint, y double", "ts array<bigint>, x array<double>", "append", GroupStateTimeout.NoTimeout
    )
