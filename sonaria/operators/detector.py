"""Detection of calls: an Arrow kernel makes frame rows of a recording, windows and aggregates do the rest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaria.functions import kernels
from sonaria.operators import frames as fr
from sonaria.sources.annotations import selection_table


@dataclass(frozen=True)
class Settings:
    """The detector's constants."""

    n_fft: int = 8192
    hop: int = 256
    rate: int = 4000
    low_hz: float = 8.0
    high_hz: float = 50.0
    voicing: float = 0.2
    ratio: float = 1.3
    least_std: float = 0.2
    most_std: float = 6.0
    window_s: float = 1.0
    close_s: float = 1.0
    open_s: float = 0.4
    gap_s: float = 2.0
    shortest_s: float = 1.0
    longest_s: float = 12.0
    confidence: float = 0.1

    @property
    def dt(self) -> float:
        return self.hop / self.rate

    def frames(self, seconds: float) -> int:
        return max(1, round(seconds / self.dt))


FRAME_ROWS = "file string, frame int, vprob double, f0 double, contrast boolean, best_f0 double"


def frame_rows(audio: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per frame: voicing probability, fundamental (null if unvoiced), whether low candidates beat high ones, and the
    best low candidate. A recording without samples has no frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not x.is_valid or not len(x.values):
                    continue
                y = x.values.to_numpy(zero_copy_only=False).astype(float)
                gate, best = kernels.contrast(np.abs(kernels.stft(y, s.n_fft, s.hop)), s.rate / s.n_fft, s.high_hz, s.ratio)
                f0, prob = kernels.pyin(y, s.rate, s.low_hz, s.high_hz, 2048, s.hop)
                n = min(len(gate), len(f0))
                f0 = f0[:n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n, pa.string()), pa.array(np.arange(n), pa.int32()), pa.array(prob[:n]), pa.array(f0, mask=~np.isfinite(f0)), pa.array(gate[:n]), pa.array(best[:n])],
                    ["file", "frame", "vprob", "f0", "contrast", "best_f0"],
                )

    return audio.select("file", "samples").mapInArrow(run, FRAME_ROWS)


def fused(frames: DataFrame, s: Settings = Settings()) -> DataFrame:
    """frames with mask: voiced, and either low candidates win or the fundamental moves like a call's."""
    std = fr.rolling_std("f0", s.frames(s.window_s))
    return frames.withColumn("mask", (F.col("vprob") > s.voicing) & (F.col("contrast") | fr.stable(std, s.least_std, s.most_std)))


def segments(frames: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(file, start_s, end_s, call_type, confidence, median_f0_hz) from frames with mask, vprob and best_f0: closed,
    opened, joined over short gaps, not too short, cut if too long, and sure enough."""
    tidy = fr.opening(fr.closing(frames.select("file", "frame", "mask"), "mask", s.frames(s.close_s)), "mask", s.frames(s.open_s))
    last = frames.groupBy("file").agg(F.max("frame").alias("last"))
    found = fr.merge_runs(fr.runs(tidy, "mask").join(last, "file"), s.gap_s, s.dt, F.col("last"))
    long_enough = found.filter(F.col("end_s") - F.col("start_s") >= s.shortest_s).join(last, "file").select("file", "first", "end", "last")
    cut = fr.split_at_valleys(long_enough, frames, "vprob", s.longest_s, s.dt)
    inside = cut.join(frames.select("file", "frame", "vprob", "best_f0"), "file").filter("frame >= first and frame < end")
    scored = inside.groupBy("file", "first", "end", "last").agg(F.avg("vprob").alias("confidence"), F.coalesce(F.median(F.when(F.col("best_f0") > 0, F.col("best_f0"))), F.lit(0.0)).alias("median_f0_hz"))
    sure = scored.filter(F.col("confidence") >= s.confidence)
    return sure.select("file", (F.col("first") * s.dt).alias("start_s"), (F.least("end", "last") * s.dt).alias("end_s"), F.lit("rumble").alias("call_type"), "confidence", "median_f0_hz")


def detect(audio: DataFrame, s: Settings = Settings()) -> DataFrame:
    """A numbered selection table of the calls in audio rows (file, sr, samples at the settings' rate)."""
    return selection_table(segments(fused(frame_rows(audio, s), s), s))
