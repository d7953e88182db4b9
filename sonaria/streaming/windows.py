"""Streaming forms of the batch operators, for events (file, ts, value) that arrive late or out of order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """(file, start, end, n, value): events joined while each follows the one before within the gap, the form of
    merging over gaps; a session ends one gap after its last event."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    g = df.groupBy("file", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select("file", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def tumbling_rms(events: DataFrame, size: str, late: str = "10 minutes") -> DataFrame:
    """(file, start, rms) of values in windows of one size."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    g = df.groupBy("file", F.window("ts", size).alias("w")).agg(F.sqrt(F.avg(F.col("value") * F.col("value")) + 1e-12).alias("rms"))
    return g.select("file", F.col("w.start").alias("start"), "rms")


def sliding_std(events: DataFrame, size: str, step: str, late: str = "10 minutes") -> DataFrame:
    """(file, start, n, std) of values in windows that slide, the time-based form of the rolling deviation."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    g = df.groupBy("file", F.window("ts", size, step).alias("w")).agg(F.count("value").alias("n"), F.stddev_pop("value").alias("std"))
    return g.select("file", F.col("w.start").alias("start"), "n", F.when(F.col("n") > 2, F.col("std")).otherwise(F.lit(0.0)).alias("std"))


GROUPS = "file string, group_start double, group_end double, group_size long"
STATE = "group_start double, group_end double, group_size long, starts array<double>, ends array<double>"


def overlap_groups(intervals: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(file, group_start, group_end, group_size) of intervals (file, ts, start_s, end_s) that overlap transitively.
    start_s and end_s are seconds of the clock that ts is of; rows may come in any order within the watermark's delay.

    Intervals wait until the watermark has passed their start, as no row that starts before can come then, and join
    the open group in order of start. A group is told when an interval starts at or after its end, or when the
    watermark has passed its end. The state of a file is one open group and the intervals that wait."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        begin, end, n, starts, ends = state.get if state.exists else (0.0, 0.0, 0, [], [])
        waiting = list(zip(starts, ends, strict=True))
        if not state.hasTimedOut:
            for rows in batches:
                waiting += zip(rows["start_s"].astype(float).tolist(), rows["end_s"].astype(float).tolist(), strict=True)
        waiting.sort()
        passed = state.getCurrentWatermarkMs() / 1000
        out, k = [], 0
        while k < len(waiting) and waiting[k][0] <= passed:
            s, e = waiting[k]
            if n and s < end:
                end, n = max(end, e), n + 1
            else:
                if n > 1:
                    out.append((key[0], begin, end, n))
                begin, end, n = s, e, 1
            k += 1
        del waiting[:k]
        if n and end <= passed:
            if n > 1:
                out.append((key[0], begin, end, n))
            n = 0
        if n or waiting:
            state.update((float(begin), float(end), int(n), [s for s, _ in waiting], [e for _, e in waiting]))
            due = min([end] * (n > 0) + [s for s, _ in waiting[:1]])
            state.setTimeoutTimestamp(int(max(math.ceil(due * 1000), state.getCurrentWatermarkMs()) + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["file", "group_start", "group_end", "group_size"])

    return intervals.withWatermark("ts", late).groupBy("file").applyInPandasWithState(step, GROUPS, STATE, "append", "EventTimeTimeout")


def register_uploads(stream: DataFrame, handle, checkpoint: str):
    """Hand each batch of newly landed files to handle(df, epoch); a batch that is run again has the same epoch."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
