"""Training data and the pluggable noise-mask model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonaria.functions.ordered import running_before
from sonaria.functions.scalars import decibels, hashed_unit
from sonaria.operators import spectral as sp
from sonaria.operators.intervals import chunk_windows, rectangles

RATE, N_FFT, HOP, BINS, CHUNK_S = 4000, 8192, 1024, 2048, 8.0


def file_split(files: DataFrame, share: float = 0.8, seed: int = 42) -> DataFrame:
    """files with split: whole files, in an order that the seed alone decides, go to 'train' up to the share (rounded
    half to even, at least one and, of two or more, not all) and to 'valid'. A single file is for validation."""
    order = F.md5(F.concat_ws("|", "file", F.lit(str(seed))))
    n = files.agg(F.count("*").alias("n"))
    keyed = files.select("file", F.concat_ws("|", order, "file").alias("_k"), F.lit(1).alias("_one"))
    ranked = running_before(keyed, "_k", "_one", "_before").select("file", (F.col("_before") + 1).alias("k")).crossJoin(F.broadcast(n))
    take = F.when(F.col("n") > 1, F.greatest(F.lit(1), F.least(F.col("n") - 1, F.bround(F.col("n") * share)))).otherwise(F.lit(0))
    return ranked.select("file", F.when(F.col("k") <= take, "train").otherwise("valid").alias("split"))


def chunk_starts(calls: DataFrame, durations: DataFrame, seed: int | None = None, length: float = CHUNK_S) -> DataFrame:
    """A chunk for each call: calls with chunk_start. The call starts up to min(slack, ...) into its chunk: one second
    without a seed, at random with one; a chunk stays inside its file."""
    slack = F.greatest(F.lit(length) - (F.col("end_s") - F.col("start_s")), F.lit(0.0))
    roll = F.least(F.lit(1.0), slack) if seed is None else slack * hashed_unit("file", "id", F.lit(seed))
    start = F.col("start_s") - roll
    return calls.join(durations, "file").withColumn("chunk_start", F.greatest(F.least(start, F.col("duration") - length), F.lit(0.0))).drop("duration")


def samples(calls: DataFrame, audio: DataFrame, durations: DataFrame, noise: DataFrame | None = None, seed: int | None = None, share: float = 0.75, snr: tuple[float, float] = (-5.0, 5.0)) -> DataFrame:
    """(file, id, sr, samples, label_boxes): an 8-second chunk for each call and, counted from its start, all calls
    that reach into it. With a seed and noise (draw, samples: as many chunks as rows of calls, by position), a share
    of the chunks is mixed with noise at a random ratio."""
    chunks = chunk_starts(calls, durations, seed)
    boxes = chunk_windows(chunks.select("file", "id", F.col("chunk_start").alias("start_s")), calls, CHUNK_S)
    bands = calls.select("file", "id", "low_hz", "high_hz")
    boxes = boxes.join(bands, ["file", "id"]).groupBy("file", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("rel_start", "rel_end", "low_hz", "high_hz"))).alias("label_boxes"))
    x = audio.select("file", "sr", F.col("samples").alias("whole"))
    out = chunks.join(x, "file").withColumn("samples", sp.chunk("whole", F.rint(F.col("chunk_start") * F.col("sr")).cast("int"), int(CHUNK_S * RATE)))
    out = out.join(boxes.withColumnRenamed("chunk_id", "id"), ["file", "id"], "left")
    if noise is not None and seed is not None:
        k = F.row_number().over(Window.partitionBy("file").orderBy("id"))
        n = noise.select("file", F.col("draw").alias("k"), F.col("samples").alias("noise"))
        db = F.lit(snr[0]) + (snr[1] - snr[0]) * hashed_unit("file", "id", F.lit(seed + 1))
        mixed = F.when(F.col("noise").isNotNull() & (hashed_unit("file", "id", F.lit(seed + 2)) < share), sp.mix_at_snr("samples", "noise", db).cast("array<float>"))
        out = out.withColumn("k", k).join(n, ["file", "k"], "left").withColumn("samples", F.coalesce(mixed, "samples"))
    return out.select("file", "id", "sr", "samples", "label_boxes")


def file_pairs(items: DataFrame, key: str, group: str, n: int, seed: int = 0) -> DataFrame:
    """(draw, a, b): for each of n draws two items of different groups, by hash order. Each draw picks a group pair
    from the table of groups (small beside the items), then one item of each."""
    groups = items.select(F.col(group).alias("g")).distinct()
    draws = items.sparkSession.range(n).select(F.col("id").alias("draw"))

    def rank(d: DataFrame, by: str, *cols: str) -> DataFrame:
        return d.withColumn("_r", F.row_number().over(Window.partitionBy("draw", *([] if by == "g" else ["g"])).orderBy(F.md5(F.concat_ws("|", F.lit(f"{seed}{by}"), "draw", *cols)), *cols)))

    two = rank(draws.crossJoin(F.broadcast(groups)), "g", "g").filter("_r <= 2").withColumnRenamed("_r", "side")
    one = rank(two.join(items.select(F.col(key).alias("item"), F.col(group).alias("g")), "g"), "i", "item").filter("_r = 1")
    return one.groupBy("draw").agg(F.max(F.when(F.col("side") == 1, F.col("item"))).alias("a"), F.max(F.when(F.col("side") == 2, F.col("item"))).alias("b"))


def mixture(a: str, b: str, db_a: Column | float, db_b: Column | float, limit: float = 0.98) -> dict[str, Column]:
    """Two sources at unit power, with gains, and their sum, all scaled by one factor so that the sum stays within
    the limit."""
    x, y = sp.gain("_u", db_a), sp.gain("_v", db_b)
    total = F.zip_with(x, y, lambda p, q: p + q)
    top = F.array_max(F.transform(total, lambda v: F.abs(v)))
    k = F.when(top > limit, F.lit(limit) / top).otherwise(F.lit(1.0))
    return {"source_a": F.transform(x, lambda v: v * k), "source_b": F.transform(y, lambda v: v * k), "mixture": F.transform(total, lambda v: v * k)}


def mixtures(pairs: DataFrame, db_a: float = 0.0, db_b: float = 0.0) -> DataFrame:
    """pairs (draw, a, b: arrays) with source_a, source_b and mixture; nulls where a side is missing."""
    return pairs.withColumns({"_u": sp.unit_power("a"), "_v": sp.unit_power("b")}).withColumns(mixture("a", "b", db_a, db_b)).drop("_u", "_v")


def binary_mask(a: str, b: str, inside: str | None = None) -> Column:
    """1 where a is at least b, inside the labelled box; ties are a's."""
    m = F.col(a) >= F.col(b)
    return (m & F.col(inside) if inside else m).cast("int")


def bin_table(audio: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """Long bins of 8192-point spectra at hop 1024: file, frame, bin, x (0 to 1) and, with calls, y (1 inside a box)."""
    s = sp.stft(audio, N_FFT, HOP, BINS).select("file", "frame", F.posexplode(sp.magnitude()).alias("bin", "mag"))
    out = s.select("file", "frame", "bin", decibels("mag").alias("x"))
    if calls is None:
        return out
    y = rectangles(calls, HOP / RATE, RATE / N_FFT, BINS).withColumn("y", F.lit(1.0))
    return out.join(y.withColumns({"frame": F.col("frame").cast("int"), "bin": F.col("bin").cast("int")}), ["file", "frame", "bin"], "left").fillna(0.0, ["y"])


class MaskModel:
    """What turns bins into the probability that they belong to a call. fit() and transform() take the columns of
    bin_table; numpy() gives a function of samples that executors can run."""

    def fit(self, bins: DataFrame) -> MaskModel:
        raise NotImplementedError

    def transform(self, bins: DataFrame) -> DataFrame:
        raise NotImplementedError

    def numpy(self) -> Callable[[np.ndarray], np.ndarray]:
        raise NotImplementedError


class LogisticMask(MaskModel):
    """A logistic model of a bin's level, its level against the file's mean at that frequency, and its frequency.

    It stands in for a trained network behind the same interface; its fit is a distributed one and its weights are a
    handful of numbers."""

    COLUMNS = ("x", "over", "f", "low")

    def __init__(self, iterations: int = 30) -> None:
        self.iterations, self.weights, self.bias = iterations, None, 0.0

    @staticmethod
    def _features(bins: DataFrame) -> DataFrame:
        m = F.avg("x").over(Window.partitionBy("file", "bin"))
        f = F.col("bin") * (RATE / N_FFT) / 1000
        return bins.withColumns({"over": F.col("x") - m, "f": f, "low": F.exp(-F.pow((f * 1000 - 20) / 30, F.lit(2)))})

    def fit(self, bins: DataFrame) -> LogisticMask:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler

        data = VectorAssembler(inputCols=list(self.COLUMNS), outputCol="features").transform(self._features(bins)).select("features", F.col("y").alias("label"))
        m = LogisticRegression(maxIter=self.iterations, regParam=1e-4).fit(data)
        self.weights, self.bias = [float(v) for v in m.coefficients], float(m.intercept)
        return self

    def transform(self, bins: DataFrame) -> DataFrame:
        z = F.lit(self.bias)
        for c, w in zip(self.COLUMNS, self.weights, strict=True):
            z = z + w * F.col(c)
        return self._features(bins).withColumn("prob", 1 / (1 + F.exp(-z))).drop("over", "f", "low")

    def numpy(self) -> Callable[[np.ndarray], np.ndarray]:
        from sonaria.functions import kernels

        weights, bias = np.array(self.weights), self.bias

        def mask(y: np.ndarray) -> np.ndarray:
            mag = np.abs(kernels.stft(y, N_FFT, HOP))[:, :BINS]
            x = (np.clip(20 * np.log10(np.maximum(mag, 1e-5)), -80, 0) + 80) / 80
            f = np.broadcast_to(np.arange(x.shape[1]) * (RATE / N_FFT) / 1000, x.shape)
            z = np.stack([x, x - x.mean(0), f, np.exp(-(((f * 1000 - 20) / 30) ** 2))], -1) @ weights + bias
            p = 1 / (1 + np.exp(-z))
            at = np.arange(4 * len(p)) * (len(p) - 1) / max(1, 4 * len(p) - 1)
            lo = np.floor(at).astype(int)
            hi = np.minimum(lo + 1, len(p) - 1)
            return p[lo] + (p[hi] - p[lo]) * (at - lo)[:, None]

        return mask

    def save(self, spark, path: str) -> None:
        rows = [("bias", self.bias), *zip(self.COLUMNS, self.weights, strict=True)]
        spark.createDataFrame(rows, "name string, weight double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, *paths: str) -> LogisticMask:
        """The first of several places that holds a model."""
        for p in paths:
            try:
                rows = {r.name: r.weight for r in spark.read.parquet(p).collect()}
            except Exception as e:  # noqa: BLE001
                missing = e
                continue
            out = cls()
            out.bias, out.weights = rows["bias"], [rows[c] for c in cls.COLUMNS]
            return out
        raise FileNotFoundError(f"no model in {', '.join(paths)}") from missing


class BinEmbedding:
    """Unit vectors for bins: the principal components of the levels around a bin, in time and frequency.

    It stands in for a trained embedding behind the same use: clustering.segment() groups its vectors into sources and
    clustering.clustering_loss() scores them against known sources."""

    def __init__(self, dims: int = 20, reach: int = 2) -> None:
        self.dims, self.reach, self.mean, self.map = dims, reach, None, None

    def _patches(self, bins: DataFrame) -> DataFrame:
        from itertools import product

        near = [(f, b) for f, b in product(range(-self.reach, self.reach + 1), range(-2 * self.reach, 2 * self.reach + 1))]
        across = Window.partitionBy("file", "frame").orderBy("bin")
        along = Window.partitionBy("file", "bin").orderBy("frame")
        steps = sorted({b for _, b in near})
        rows = bins.withColumn("_row", F.array(*(F.coalesce(F.lag("x", -b).over(across) if b else F.col("x"), F.lit(0.0)) for b in steps)))
        empty = F.array_repeat(F.lit(0.0), len(steps))
        parts = [F.coalesce(F.lag("_row", -f).over(along) if f else F.col("_row"), empty) for f in range(-self.reach, self.reach + 1)]
        return rows.withColumn("patch", F.concat(*parts, F.array(F.col("bin") / BINS))).drop("_row")

    def fit(self, bins: DataFrame) -> BinEmbedding:
        from pyspark.ml.feature import PCA
        from pyspark.ml.functions import array_to_vector

        data = self._patches(bins).select(array_to_vector("patch").alias("p"))
        m = PCA(k=self.dims, inputCol="p", outputCol="z").fit(data)
        self.map = m.pc.toArray()
        return self

    def transform(self, bins: DataFrame) -> DataFrame:
        """bins with vec, of length 1."""
        columns = [F.array(*(F.lit(float(v)) for v in c)) for c in self.map.T]
        dots = F.array(*(F.aggregate(F.zip_with("patch", c, lambda p, q: p * q), F.lit(0.0), lambda a, v: a + v) for c in columns))
        norm = F.sqrt(F.aggregate("_z", F.lit(0.0), lambda a, v: a + v * v))
        return self._patches(bins).withColumn("_z", dots).withColumn("vec", F.transform("_z", lambda v: v / F.greatest(norm, F.lit(1e-12)))).drop("_z", "patch")


def best_so_far(losses: DataFrame, key: str = "run") -> DataFrame:
    """losses (run, epoch, loss) with best, the least loss up to each epoch, and whether the epoch reached it first."""
    w = Window.partitionBy(key).orderBy("epoch")
    before = F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return losses.withColumns({"best": F.min("loss").over(w), "improved": F.coalesce(F.col("loss") < before, F.lit(True))})
