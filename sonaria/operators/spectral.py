"""Spectral algebra. Long form: file, frame, bin, mag (and re, im). Packed form: file, samples as arrays.

The long forms are joins and aggregates; the packed ones run array kernels on Arrow batches, a row at a time, so a
recording is cut into rows of bounded length before it gets here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonaria.functions import kernels
from sonaria.operators.frames import stretch


def dft(df: DataFrame, key: str, array: str, n: int) -> DataFrame:
    """(key, bin, re, im, mag) of short vectors of n values, without a window: the twiddle table of n * (n / 2 + 1)
    rows is joined by position."""
    table = df.sparkSession.range(n).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n // 2))).alias("bin"))
    turn = F.lit(2 * np.pi) * F.pmod(F.col("i") * F.col("bin"), F.lit(n)) / n
    table = table.select("i", "bin", F.cos(turn).alias("c"), F.sin(turn).alias("s"))
    x = df.select(key, F.posexplode(array).alias("i", "v"))
    out = x.join(F.broadcast(table), "i").groupBy(key, "bin").agg(F.sum(F.col("v") * F.col("c")).alias("re"), F.sum(-F.col("v") * F.col("s")).alias("im"))
    return out.withColumn("mag", F.hypot("re", "im"))


def mean_spectrum(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys, "bin").agg(F.avg("mag").alias("mag"))


def peak(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """(key, bin, mag) of the largest magnitude in bins low to high, the first of equal ones."""
    best = df.filter(F.col("bin").between(low, high)).groupBy(key).agg(F.max(F.struct("mag", -F.col("bin"))).alias("b"))
    return best.select(key, (-F.col("b.col2")).cast("int").alias("bin"), F.col("b.mag").alias("mag"))


def salience(df: DataFrame, key: str, candidates: DataFrame, res: float, harmonics: int, decay: float, max_hz: float, n_bins: int) -> DataFrame:
    """(key, cand, salience): the weighted sum of each candidate's harmonics. candidates: cand, in Hz. The table of
    (candidate, harmonic, bin, weight) is small and fixed, whatever the number of spectra."""
    h = candidates.select("cand", F.explode(F.sequence(F.lit(1), F.lit(harmonics))).alias("h"))
    h = h.withColumns({"bin": F.rint(F.col("cand") * F.col("h") / res).cast("int"), "w": F.pow(F.lit(decay), F.col("h") - 1)})
    h = h.filter((F.col("cand") * F.col("h") <= max_hz) & (F.col("bin") < n_bins))
    return df.join(F.broadcast(h), "bin").groupBy(key, "cand").agg(F.sum(F.col("mag") * F.col("w")).alias("salience"))


def contrast(sal: DataFrame, key: str, split: float, ratio: float = 1.3) -> DataFrame:
    """(key, best_f0, low, high, gate): the strongest candidates up to the split and above it."""
    low = F.when(F.col("cand") <= split, F.struct("salience", -F.col("cand")))
    t = sal.groupBy(key).agg(F.max(low).alias("l"), F.max(F.when(F.col("cand") > split, F.col("salience"))).alias("high"))
    t = t.select(key, (-F.col("l.col2")).alias("best_f0"), F.col("l.salience").alias("low"), F.coalesce("high", F.lit(0.0)).alias("high"))
    return t.withColumn("gate", F.col("low") > ratio * F.col("high"))


def comb(f0: str, freq: str, max_hz: float = 1000.0, width: float = 2.0) -> Column:
    """How near a frequency is to a harmonic of f0: the largest Gaussian over harmonics is that of the nearest one."""
    last = F.floor(F.lit(max_hz) / F.col(f0))
    h = F.least(F.greatest(F.rint(F.col(freq) / F.col(f0)), F.lit(1.0)), last)
    return F.when(last >= 1, F.exp(-0.5 * F.pow((F.col(freq) - h * F.col(f0)) / width, F.lit(2)))).otherwise(F.lit(0.0))


def wiener(df: DataFrame, *cell: str) -> DataFrame:
    """Adds mask = c * mag / (sum over callers of c * mag + 1e-8) within each cell. df: comb, mag."""
    w = F.col("comb") * F.col("mag")
    return df.withColumn("mask", w / (F.sum(w).over(Window.partitionBy(*cell)) + 1e-8))


def apply_mask(spec: DataFrame, mask: DataFrame, *cell: str) -> DataFrame:
    """spec with re, im (or mag) times the mask of its cell; cells without a mask become 0."""
    m = mask.select(*cell, F.col("mask").alias("_m"))
    out = spec.join(m, list(cell), "left")
    scaled = {c: F.col(c) * F.coalesce("_m", F.lit(0.0)) for c in ("re", "im", "mag") if c in spec.columns}
    return out.withColumns(scaled).drop("_m")


def upsample(mask: DataFrame, factor: int, *keys: str) -> DataFrame:
    """A mask stretched `factor` times along frames, ends on ends: frame f takes the value at f (T - 1) / (factor T - 1),
    linear in between. Columns that are not keys tell series with one T apart."""
    rest = [c for c in mask.columns if c not in (*keys, "frame", "mask")]
    for c in (*keys, *rest):
        mask = mask.filter(F.col(c).isNotNull())
    top = F.max(F.col("frame").cast("long"))
    if rest:
        size = mask.groupBy(*keys).agg(top.alias("_top"))
        sized = mask.join(size, [*keys]) if keys else mask.crossJoin(size)
    else:
        sized = mask.withColumn("_top", top.over(Window.partitionBy(*keys).orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    t = F.col("_top") + 1
    return stretch(sized, (*keys, *rest), "mask", t, t * factor).select(*keys, "frame", *rest, "mask")


def power(array: str) -> Column:
    """Mean square of an array, and a little more."""
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x.cast("double") * x) / F.size(array) + 1e-12


def unit_power(array: str) -> Column:
    root = F.sqrt(power(array))
    return F.transform(array, lambda x: x / root)


def mix_at_snr(signal: str, noise: str, snr_db: Column | float) -> Column:
    """signal plus noise scaled to the given ratio of powers; null where lengths differ."""
    db = F.lit(snr_db) if isinstance(snr_db, float | int) else snr_db
    scale = F.sqrt(power(signal) / F.pow(F.lit(10.0), db / 10) / power(noise))
    return F.when(F.size(signal) == F.size(noise), F.zip_with(signal, noise, lambda a, b: a + b * scale))


def gain(array: str, db: Column | float) -> Column:
    k = F.pow(F.lit(10.0), (F.lit(db) if isinstance(db, float | int) else db) / 20)
    return F.transform(array, lambda x: x * k)


def peak_scale(array: str, limit: float = 0.98) -> Column:
    """The factor that brings the largest absolute value down to the limit; 1 where it is below."""
    top = F.array_max(F.transform(array, lambda x: F.abs(x)))
    return F.when(top > limit, F.lit(limit) / top).otherwise(F.lit(1.0))


def chunk(array: str, start: Column, length: int) -> Column:
    """`length` values from position start (0-based) on, zeros where the array ends."""
    part = F.slice(array, start + 1, F.lit(length))
    return F.concat(part, F.array_repeat(F.lit(0.0).cast("float"), F.lit(length) - F.size(part)))


def window_rms(array: str, size: int) -> Column:
    """Root mean squares of consecutive windows of `size` values; a rest that fills no window is left out."""
    n = F.floor(F.size(array) / size).cast("int")
    each = F.transform(F.sequence(F.lit(1), n), lambda k: F.sqrt(F.aggregate(F.slice(array, (k - 1) * size + 1, size), F.lit(0.0), lambda a, x: a + x.cast("double") * x) / size + 1e-12))
    return F.when(n >= 1, each).otherwise(F.array().cast("array<double>"))


def _map_rows(df: DataFrame, fn, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                yield from fn(batch.slice(row, 1))

    return df.mapInArrow(run, schema)


def stft(audio: DataFrame, n_fft: int, hop: int, n_bins: int | None = None) -> DataFrame:
    """(file, frame, re, im) for each frame of audio rows (file, sr, samples); n_bins keeps the lowest bins only."""

    def one(b: pa.RecordBatch):
        s = kernels.stft(b.column("samples")[0].values.to_numpy(zero_copy_only=False) if b.column("samples")[0].is_valid else np.zeros(0), n_fft, hop)[:, :n_bins]
        n = len(s)
        yield pa.RecordBatch.from_arrays([pa.array(b.column("file").to_pylist() * n), pa.array(np.arange(n), pa.int32()), pa.array(list(s.real.astype(np.float32)), pa.list_(pa.float32())), pa.array(list(s.imag.astype(np.float32)), pa.list_(pa.float32()))], ["file", "frame", "re", "im"])

    return _map_rows(audio.select("file", "samples"), one, "file string, frame int, re array<float>, im array<float>")


def istft(spec: DataFrame, hop: int, lengths: DataFrame) -> DataFrame:
    """(file, samples) from packed frames. lengths: file, length. A file's frames meet in one task, so rows should
    be recordings of bounded length."""

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("frame")
        s = np.stack(t["re"].to_pylist()).astype(complex) + 1j * np.stack(t["im"].to_pylist())
        y = kernels.istft(s, hop, t["length"][0].as_py()).astype(np.float32)
        return pa.table({"file": t["file"][:1], "samples": pa.array([y], pa.list_(pa.float32()))})

    return spec.join(lengths, "file").select("file", "frame", "re", "im", F.col("length").cast("long").alias("length")).groupBy("file").applyInArrow(one, "file string, samples array<float>")


def magnitude(re: str = "re", im: str = "im") -> Column:
    return F.zip_with(re, im, lambda a, b: F.hypot(a.cast("double"), b.cast("double")))
