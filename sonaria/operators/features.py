"""Acoustic features of clips and what they suggest, as expressions and as an Arrow kernel over whole clips."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonaria.functions import kernels
from sonaria.functions.scalars import one_decimal

# The texts of the rules.
ONSETS = ("explosive onset, decaying", "gradual buildup, strong finish", "steady sustained", "gradual onset, gradual offset")
CALLERS = (
    "an adult bull (very low F0 suggests large body size, possibly in musth)",
    "an adult female or sub-adult male",
    "a sub-adult or juvenile",
    "a juvenile or calf (elevated F0 correlates with smaller body size)",
)
SOCIAL = (
    "This extended duration is characteristic of contact calls used to coordinate group movement over long distances.",
    "The moderate duration is consistent with greeting rumbles or social bonding calls within family groups.",
    "This short rumble may be a response call or an acknowledgment within an ongoing vocal exchange.",
    "This brief vocalization could be a fragment of a longer call or a short-range social signal.",
)
HARMONICS = (
    "Rich harmonic structure (%d harmonics) indicates the elephant was relatively close to the microphone and the call was produced at moderate to high intensity.",
    "Moderate harmonic content (%d harmonics) suggests a typical mid-range recording distance.",
    "Limited harmonics (%d) suggest either a distant recording or a low-intensity vocalization.",
)
MODULATED, UNMODULATED, UNSURE, SILENT = "modulated (%s Hz range)", "stable", "insufficient data", "silent"
SENTENCE = ("This ", " (", "s, F0=%s Hz) is consistent with ", ". ", " ", " Temporal envelope: ", ". Frequency modulation: ", ".")


def onset_profile(onset: str, sustain: str, offset: str, loudest: str) -> Column:
    a, b, c = F.col(onset), F.col(sustain), F.col(offset)
    return (
        F.when(F.col(loudest) <= 0, F.lit(SILENT))
        .when(a > b * 1.3, F.lit(ONSETS[0]))
        .when(c > b * 1.3, F.lit(ONSETS[1]))
        .when(F.abs(a - c) < b * 0.2, F.lit(ONSETS[2]))
        .otherwise(F.lit(ONSETS[3]))
    )


def modulation(voiced: str, median: str, spread: str) -> Column:
    text = F.format_string(MODULATED, one_decimal(spread))
    return F.when(F.col(voiced) <= 5, F.lit(UNSURE)).when(F.col(spread) > F.col(median) * 0.15, text).otherwise(F.lit(UNMODULATED))


def caller_class(f0: str) -> Column:
    """An f0 of 0, which stands for none, falls into the second class."""
    f = F.col(f0)
    return F.when((f > 0) & (f < 12), F.lit(CALLERS[0])).when(f < 18, F.lit(CALLERS[1])).when(f < 25, F.lit(CALLERS[2])).otherwise(F.lit(CALLERS[3]))


def social_class(duration: str) -> Column:
    d = F.col(duration)
    return F.when(d > 4, F.lit(SOCIAL[0])).when(d > 2, F.lit(SOCIAL[1])).when(d > 1, F.lit(SOCIAL[2])).otherwise(F.lit(SOCIAL[3]))


def harmonic_note(count: str) -> Column:
    n = F.col(count)
    return F.when(n > 20, F.format_string(HARMONICS[0], n)).when(n > 5, F.format_string(HARMONICS[1], n)).otherwise(F.format_string(HARMONICS[2], n))


def description(kind: str = "clip_type") -> Column:
    """A clip's features in words. An invalid clip says so."""
    pitch = F.format_string(SENTENCE[2], one_decimal("fundamental_hz"))
    parts = [F.col(kind), F.col("duration_s").cast("string"), caller_class("fundamental_hz"), social_class("duration_s"), harmonic_note("harmonic_count"), F.col("onset_profile"), F.col("frequency_modulation")]
    between = [F.lit(SENTENCE[1]), pitch, *map(F.lit, SENTENCE[3:])]
    text = F.concat(F.lit(SENTENCE[0]), *(x for pair in zip(parts, between, strict=True) for x in pair))
    return F.when(F.col("is_valid"), text).otherwise(F.lit("The clip is too short or too quiet to analyse."))


def prompt(kind: str = "clip_type") -> Column:
    """The measurements as a question for a text model."""
    shown = (
        ("Duration (s)", "duration_s"), ("Fundamental (Hz)", "fundamental_hz"), ("Fundamental's deviation (Hz)", "f0_stability_hz"), ("Fundamental's range (Hz)", "f0_range_hz"),
        ("Frequency modulation", "frequency_modulation"), ("Harmonics", "harmonic_count"), ("Highest harmonic (Hz)", "highest_harmonic_hz"), ("Spectral centroid (Hz)", "spectral_centroid_hz"),
        ("Spectral bandwidth (Hz)", "spectral_bandwidth_hz"), ("Level (dB)", "rms_db"), ("Peak level (dB)", "peak_rms_db"), ("Envelope", "onset_profile"),
    )
    lines = [F.concat(F.lit(f"\n{name}: "), F.coalesce(F.col(c).cast("string"), F.lit("unknown"))) for name, c in shown]
    return F.concat(F.lit("These are measurements of one isolated animal call of type "), F.col(kind), F.lit("."), *lines, F.lit("\nSay in three or four sentences what kind of call it may be, in which social setting, by what kind of caller, and what is notable about it."))


def describe(features: DataFrame, ask=None, kind: str = "clip_type") -> DataFrame:
    """features with analysis, by rules; `ask`, a pandas Series to Series function of prompts, may answer instead,
    and where it returns null or fails the rules stand. Nothing is asked unless it is given."""
    rules = features.withColumn("analysis", description(kind))
    if ask is None:
        return rules
    names = rules.columns

    def run(batches):
        for pdf in batches:
            try:
                said = ask(pdf["_prompt"])
                pdf["analysis"] = said.where(said.notna() & pdf["is_valid"], pdf["analysis"])
            except Exception:  # noqa: BLE001  the rules are the answer to any failure of a remote service
                pass
            yield pdf[names]

    return rules.withColumn("_prompt", prompt(kind)).mapInPandas(run, rules.schema)


def f0_stats(frames: DataFrame, key: str = "file") -> DataFrame:
    """Median, population deviation, range and number of the present fundamentals; 0 where there are none."""
    f = F.col("f0")
    return frames.groupBy(key).agg(F.count(f).alias("voiced"), F.coalesce(F.median(f), F.lit(0.0)).alias("f0_median"), F.coalesce(F.stddev_pop(f), F.lit(0.0)).alias("f0_std"), F.coalesce(F.max(f) - F.min(f), F.lit(0.0)).alias("f0_range"))


def thirds(frames: DataFrame, value: str, key: str = "file") -> DataFrame:
    """Mean of a frame value in the first, middle and last third, its mean and its maximum. A third has n // 3
    frames, at least one; the last takes the rest."""
    w = Window.partitionBy(key)
    d = frames.withColumn("_k", F.row_number().over(w.orderBy("frame")) - 1).withColumn("_t", F.greatest(F.lit(1), F.floor(F.count("*").over(w) / 3)))
    third = F.least(F.floor(F.col("_k") / F.col("_t")), F.lit(2))
    parts = [F.avg(F.when(third == i, F.col(value))).alias(n) for i, n in enumerate(("onset", "sustain", "offset"))]
    return d.groupBy(key).agg(*parts, F.avg(value).alias("mean"), F.max(value).alias("loudest"))


def level_db(c: str) -> Column:
    return 20 * F.log10(F.col(c) + 1e-12)


def centroid(spec: DataFrame, *keys: str, freq: str = "freq") -> DataFrame:
    """Magnitude-weighted mean frequency and deviation of each spectrum; null where it is silent."""
    m, f = F.col("mag"), F.col(freq)
    s = spec.groupBy(*keys).agg(F.sum(m).alias("s0"), F.sum(m * f).alias("s1"), F.sum(m * f * f).alias("s2"))
    c = F.col("s1") / F.col("s0")
    var = F.greatest(F.col("s2") / F.col("s0") - c * c, F.lit(0.0))
    return s.select(*keys, F.when(F.col("s0") > 0, c).alias("centroid"), F.when(F.col("s0") > 0, F.sqrt(var)).alias("bandwidth"))


def harmonic_count(spec: DataFrame, key: str, share: float = 0.1) -> DataFrame:
    """(key, harmonic_count, highest_bin): rises over the share of the maximum from one bin to the next, and the
    last bin above it (null without a rise)."""
    w = Window.partitionBy(key)
    d = spec.withColumn("_on", F.col("mag") > share * F.max("mag").over(w))
    d = d.withColumn("_up", F.col("_on") & ~F.lag("_on", 1, True).over(w.orderBy("bin")))
    t = d.groupBy(key).agg(F.count_if("_up").alias("harmonic_count"), F.max(F.when(F.col("_on"), F.col("bin"))).alias("highest_bin"))
    return t.withColumn("highest_bin", F.when(F.col("harmonic_count") > 0, F.col("highest_bin")))


FEATURES = "duration_s double, fundamental_hz double, f0_stability_hz double, f0_range_hz double, harmonic_count int, highest_harmonic_hz double, spectral_centroid_hz double, spectral_bandwidth_hz double, rms_db double, peak_rms_db double, onset_profile string, frequency_modulation string, is_valid boolean"


def measure(y: np.ndarray, sr: int) -> dict:
    """All features of a clip; a clip under 0.1 s or without sound is invalid and has the few that make sense."""
    length = len(y) / sr
    if length < 0.1 or not np.abs(y).max() >= 1e-6:
        return {"duration_s": length, "fundamental_hz": 0.0, "harmonic_count": 0, "spectral_centroid_hz": 0.0, "spectral_bandwidth_hz": 0.0, "rms_db": -80.0, "onset_profile": "silent", "frequency_modulation": "none", "is_valid": False}
    f0, _ = kernels.pyin(y, sr, 10, 300)
    f0 = f0[np.isfinite(f0)]
    med, std, spread = (float(np.median(f0)), float(f0.std()), float(np.ptp(f0))) if len(f0) else (0.0, 0.0, 0.0)
    mean = np.abs(kernels.stft(y, 4096, 1024)).mean(0)
    on = mean > 0.1 * mean.max()
    rises = int((on[1:] & ~on[:-1]).sum())
    mag = np.abs(kernels.stft(y, 2048, 512))
    freq = np.arange(mag.shape[1]) * sr / 2048
    total = np.maximum(mag.sum(1), 1e-12)
    middle = (mag @ freq) / total
    width = np.sqrt((mag * (freq[None] - middle[:, None]) ** 2).sum(1) / total)
    rms = np.sqrt((kernels.frames_of(np.asarray(y, float), 1024, 256) ** 2).mean(1))
    n = max(1, len(rms) // 3)
    a, b, c = rms[:n].mean(), rms[n : 2 * n].mean() if len(rms) > n else 0.0, rms[2 * n :].mean() if len(rms) > 2 * n else 0.0
    shape = ONSETS[0] if a > 1.3 * b else ONSETS[1] if c > 1.3 * b else ONSETS[2] if abs(a - c) < 0.2 * b else ONSETS[3]
    fm = "insufficient data" if len(f0) <= 5 else f"modulated ({spread:.1f} Hz range)" if spread > 0.15 * med else "stable"
    highest = float(np.flatnonzero(on)[-1] * sr / 4096) if rises else 0.0
    return {
        "duration_s": round(length, 2), "fundamental_hz": round(med, 1), "f0_stability_hz": round(std, 2), "f0_range_hz": round(spread, 1), "harmonic_count": rises, "highest_harmonic_hz": round(highest, 1),
        "spectral_centroid_hz": round(float(middle.mean()), 1), "spectral_bandwidth_hz": round(float(width.mean()), 1), "rms_db": round(float(20 * np.log10(rms.mean() + 1e-12)), 1),
        "peak_rms_db": round(float(20 * np.log10(rms.max() + 1e-12)), 1), "onset_profile": shape, "frequency_modulation": fm, "is_valid": True,
    }


def extract(audio: DataFrame) -> DataFrame:
    """(file, features...) of clips (file, sr, samples); a clip without samples is invalid."""
    names = [f.split()[0] for f in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"double": pa.float64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
        schema = pa.schema([("file", pa.string()), *((f.split()[0], kinds[f.split()[1]]) for f in FEATURES.split(", "))])
        for b in batches:
            rows = []
            for file, sr, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                y = s.values.to_numpy(zero_copy_only=False) if s.is_valid else np.zeros(0)
                m = measure(y, sr or 4000)
                rows.append({"file": file, **{n: m.get(n) for n in names}})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return audio.select("file", "sr", "samples").mapInArrow(run, f"file string, {FEATURES}")
