"""Ordered frame series: DataFrames with file, frame (0, 1, ...) and per-frame columns. Missing values are null."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_file():
    return Window.partitionBy("file").orderBy("frame")


def nan_to_null(c: str | Column) -> Column:
    return F.nanvl(c if isinstance(c, Column) else F.col(c), F.lit(None).cast("double"))


def rolling_std(value: str, width: int, least: int = 3) -> Column:
    """Population deviation of the present values among `width` frames (half of them, rounded down, before); 0
    where fewer than `least` are present."""
    w = by_file().rowsBetween(-(width // 2), width - width // 2 - 1)
    return F.when(F.count(value).over(w) >= least, F.stddev_pop(value).over(w)).otherwise(F.lit(0.0))


def stable(std: Column, low: float = 0.2, high: float = 6.0) -> Column:
    return std.between(low, high)


def dilate(mask: str, width: int, flip: bool = False) -> Column:
    """True where any frame of the structuring element is; outside a file all is false."""
    before, after = width // 2, width - width // 2 - 1
    if flip:
        before, after = after, before
    return F.max(F.col(mask).cast("int")).over(by_file().rowsBetween(-before, after)) == 1


def erode(mask: str, width: int, flip: bool = False) -> Column:
    """True where all frames of the structuring element are; outside a file all is false."""
    before, after = width // 2, width - width // 2 - 1
    if flip:
        before, after = after, before
    return F.sum(F.col(mask).cast("int")).over(by_file().rowsBetween(-before, after)) == width


def closing(df: DataFrame, mask: str, width: int) -> DataFrame:
    """Dilation, then erosion: gaps shorter than `width` fill up, and what is near a file's ends goes."""
    return df.withColumn("_d", dilate(mask, width, flip=True)).withColumn(mask, erode("_d", width)).drop("_d")


def opening(df: DataFrame, mask: str, width: int) -> DataFrame:
    """Erosion, then dilation: runs shorter than `width` go."""
    return df.withColumn("_e", erode(mask, width)).withColumn(mask, dilate("_e", width, flip=True)).drop("_e")


def runs(df: DataFrame, mask: str) -> DataFrame:
    """(file, first, end) of each maximal run of true frames, end exclusive."""
    turn = F.col(mask) != F.coalesce(F.lag(mask).over(by_file()), ~F.col(mask))
    g = df.select("file", "frame", mask, F.sum(turn.cast("int")).over(by_file()).alias("run"))
    return g.filter(mask).groupBy("file", "run").agg(F.min("frame").alias("first"), (F.max("frame") + 1).alias("end")).drop("run")


def merge_runs(df: DataFrame, gap: float, dt: float, last_frame: Column | None = None) -> DataFrame:
    """Runs joined where the next begins no more than `gap` seconds after the one before ends. An end beyond the
    last frame counts as the last frame's time. df: file, first, end and, if last_frame names it, that column."""
    t0 = F.col("first") * dt
    t1 = (F.least("end", last_frame) if last_frame is not None else F.col("end")) * dt
    w = Window.partitionBy("file").orderBy("first")
    d = df.withColumn("t0", t0).withColumn("t1", t1)
    d = d.withColumn("_new", F.coalesce((F.col("t0") - F.lag("t1").over(w) > gap).cast("int"), F.lit(1)))
    d = d.withColumn("_g", F.sum("_new").over(w))
    return d.groupBy("file", "_g").agg(F.min("first").alias("first"), F.max("end").alias("end"), F.min("t0").alias("start_s"), F.max("t1").alias("end_s")).drop("_g")


def interpolate(value: str, frame: str = "frame") -> Column:
    """Linear between present values, the nearest one at the ends; null where fewer than two are present."""
    w = by_file()
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(frame))
    x0, x1 = F.last(at, True).over(back), F.first(at, True).over(ahead)
    y0, y1 = F.last(value, True).over(back), F.first(value, True).over(ahead)
    n = F.count(value).over(Window.partitionBy("file"))
    inner = F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (F.col(frame) - x0) / (x1 - x0))
    return F.when(n >= 2, F.coalesce(inner, y0, y1))


def median_fill(df: DataFrame, value: str, fallback: float = 20.0) -> DataFrame:
    """Missing and non-positive values become the median of the file's others, or `fallback` where there are none."""
    good = F.when(F.col(value) > 0, F.col(value))
    med = df.groupBy("file").agg(F.median(good).alias("_m"))
    return df.join(med, "file").withColumn(value, F.coalesce(good, F.col("_m"), F.lit(fallback))).drop("_m")


def extrapolate(df: DataFrame, value: str, span: int = 10, low: float = 8.0, high: float = 50.0, fallback: float = 20.0) -> DataFrame:
    """Continue a contour beyond its first and last present frames.

    The slope at either end is the least-squares line through up to `span` present frames, 0 where fewer than three
    are present; continued values stay within [low, high]. Gaps inside are interpolated. A file without any present
    value gets `fallback`.
    """
    here = df.filter(F.col(value).isNotNull()).select("file", "frame", F.col(value).alias("v"))
    up, down = Window.partitionBy("file").orderBy("frame"), Window.partitionBy("file").orderBy(F.desc("frame"))
    ranked = here.withColumns({"a": F.row_number().over(up), "z": F.row_number().over(down)})

    def slope(k: str) -> Column:
        first = F.col(k) <= span
        return F.regr_slope(F.when(first, F.col("v")), F.when(first, F.col("frame").cast("double")))

    ends = ranked.groupBy("file").agg(
        F.count("*").alias("_n"), F.min("frame").alias("_p0"), F.max("frame").alias("_p1"), F.min_by("v", "frame").alias("_v0"), F.max_by("v", "frame").alias("_v1"), slope("a").alias("_s0"), slope("z").alias("_s1")
    )
    d = df.withColumn("_i", interpolate(value)).join(ends, "file", "left")
    few = F.col("_n") < 3
    before = F.col("_v0") - (F.col("_p0") - F.col("frame")) * F.when(few, 0.0).otherwise(F.col("_s0"))
    after = F.col("_v1") + (F.col("frame") - F.col("_p1")) * F.when(few, 0.0).otherwise(F.col("_s1"))

    def held(c: Column) -> Column:
        return F.greatest(F.least(c, F.lit(high)), F.lit(low))

    out = F.when(F.col("_n").isNull(), F.lit(fallback)).when(F.col("frame") < F.col("_p0"), held(before)).when(F.col("frame") > F.col("_p1"), held(after))
    return d.withColumn(value, out.otherwise(F.coalesce(F.col(value), F.col("_i"), F.col("_v0")))).select(*df.columns)


def stretch(df: DataFrame, keys: tuple[str, ...], value: str, t: Column, n: Column) -> DataFrame:
    """(keys, frame, value): series of frames 0 to t - 1 as n frames, ends on ends, linear in between.

    A frame makes the new ones that lie on it or before the next frame, which a window brings along: a series moves
    once, and what it becomes doesn't move. A frame without a next one makes nothing between, repeated ones all pairs.
    """
    w = Window.partitionBy(*keys).orderBy("frame")
    here, ahead = (F.collect_list(F.struct(F.col(value).alias("v"))).over(w.rangeBetween(i, i)) for i in (0, 1))
    d = df.select(*keys, F.col("frame").cast("long").alias("_k"), F.col(value).alias("_v0"), t.cast("long").alias("_t"), n.cast("long").alias("_n"), here.alias("_here"), ahead.alias("_ahead"))
    k, t, n, f = (F.col(c) for c in ("_k", "_t", "_n", "frame"))
    spread = (t > 1) & (n > 1)
    first = F.when(spread, F.ceil(k * (n - 1) / (t - 1))).otherwise(F.lit(0))
    last = F.when(spread, F.least(F.ceil((k + 1) * (n - 1) / (t - 1)), n) - 1).otherwise(n - 1)
    inside = (k >= 0) & (k < F.when(spread, t).otherwise(F.lit(1))) & (first <= last)
    d = d.withColumn("frame", F.explode(F.when(inside, F.sequence(first, last))))
    d = d.withColumn("_pos", F.when(spread, f * (t - 1) / (n - 1)).otherwise(F.lit(0.0)))
    d = d.select(*keys, "frame", "_v0", (F.col("_pos") - k).alias("_part"), F.explode(F.when(F.col("_pos") == k, F.col("_here")).otherwise(F.col("_ahead"))).alias("_b"))
    return d.select(*keys, f.cast("int").alias("frame"), (F.col("_v0") + (F.col("_b.v") - F.col("_v0")) * F.col("_part")).alias(value))


def resample(df: DataFrame, value: str, n: Column | int) -> DataFrame:
    """(file, frame, value): the series stretched to n frames, ends on ends, linear in between. n may come from m, the
    number of frames of the file."""
    whole = by_file().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = df.filter("file is not null").select("file", "frame", value).withColumn("m", F.count("*").over(whole))
    return stretch(d, ("file",), value, F.col("m"), F.lit(n) if isinstance(n, int) else n)


def split_at_valleys(regions: DataFrame, frames: DataFrame, score: str, longest: float, dt: float) -> DataFrame:
    """Regions (file, first, end, last) of more than `longest` seconds cut at the lowest score of their middle four
    fifths, the first of equal ones, and so on until all are short or have fewer than four frames.

    How often a region is cut depends on its scores, so a file's regions and scores meet in one Arrow kernel, in one
    exchange. last: the file's last frame, whose time no end exceeds.
    """

    def cut(part: pa.Table, scored: pa.Table) -> pa.Table:
        if not len(part):
            return part.select(["file", "first", "end", "last"])
        frame = scored["frame"].to_numpy()
        s = np.full(int(frame.max()) + 1 if len(frame) else 0, np.inf)
        s[frame] = scored["score"].to_numpy()
        out = []
        todo = list(zip(part["first"].to_pylist(), part["end"].to_pylist(), part["last"].to_pylist(), strict=True))
        while todo:
            a, b, last = todo.pop()
            m = max(1, (b - a) // 10)
            if (min(b, last) - min(a, last)) * dt <= longest or b - a < 4 or b - a <= 2 * m:
                out.append((a, b, last))
            else:
                k = a + m + int(s[a + m : b - m].argmin())
                todo += [(a, k, last), (k, b, last)]
        first, end, last = zip(*out, strict=True)
        return pa.table({"file": pa.array([part["file"][0].as_py()] * len(out), pa.string()), "first": pa.array(first, pa.int32()), "end": pa.array(end, pa.int32()), "last": pa.array(last, pa.int32())})

    r = regions.select(F.col("file").cast("string").alias("file"), *(F.col(c).cast("int").alias(c) for c in ("first", "end", "last")))
    f = frames.select(F.col("file").cast("string").alias("file"), F.col("frame").cast("int").alias("frame"), F.col(score).cast("double").alias("score"))
    return r.groupBy("file").cogroup(f.groupBy("file")).applyInArrow(cut, "file string, first int, end int, last int")
