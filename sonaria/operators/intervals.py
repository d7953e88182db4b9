"""Interval algebra on DataFrames with columns file, start_s, end_s (seconds) and, where rows need a name, id.

Everything is keyed by file, so one exchange on file serves a whole chain of these operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonaria.functions.ordered import running_before

ORDER = ("start_s", "end_s", "id")


def duration(start: str = "start_s", end: str = "end_s") -> Column:
    """Length of an interval, never below 0."""
    return F.greatest(F.col(end) - F.col(start), F.lit(0.0))


def overlap_join(left: DataFrame, right: DataFrame, cell: float | None = None, how: str = "inner") -> DataFrame:
    """Pairs of one file whose intervals share more than a point: a.start < b.end and b.start < a.end.

    right's columns get the prefix r_. With `cell` (seconds), rows are dealt by file and time cell, so that a file
    with very many intervals doesn't meet in one task: an interval stands in every cell it touches, and a pair is
    taken only in the first cell that both touch. Only inner joins can be dealt by cells.
    """
    r = right.select(*(F.col(c).alias("file" if c == "file" else f"r_{c}") for c in right.columns))
    touch = (F.col("start_s") < F.col("r_end_s")) & (F.col("r_start_s") < F.col("end_s"))
    if cell is None:
        l, r = left.alias("l"), r.alias("r")
        joined = l.join(r, (F.col("l.file") == F.col("r.file")) & touch, how)
        return joined.select("l.*", *(F.col(f"r.r_{c}") for c in right.columns if c != "file"))
    if how != "inner":
        raise ValueError("cells need an inner join")

    def cells(a: str, b: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.greatest(F.col(a), F.col(b)) / cell)))

    l = left.withColumn("cell", cells("start_s", "end_s"))
    r = r.withColumn("cell", cells("r_start_s", "r_end_s"))
    first = F.floor(F.greatest("start_s", "r_start_s") / cell)
    return l.join(r, ["file", "cell"]).filter(touch & (F.col("cell") == first)).select(*left.columns, *(f"r_{c}" for c in right.columns if c != "file"))


def overlap_counts(source: DataFrame, target: DataFrame, cell: float | None = None) -> DataFrame:
    """source with n_overlaps, the number of target intervals that overlap each. Rows that are repeated are rows each.
    With `cell` (seconds) a file's rows are dealt by time cells, as in overlap_join."""
    t = target.select("file", "start_s", "end_s")
    times = "times_of_row"
    once = source.groupBy(*source.columns).agg(F.count("*").alias(times))
    pairs = overlap_join(once, t, cell, "left" if cell is None else "inner")
    counted = pairs.groupBy(*source.columns, times).agg(F.count("r_start_s").alias("n_overlaps"))
    if cell is not None:  # rows without an overlap come back by a join of whole rows
        none = once.alias("o").join(counted.alias("c"), [F.col(f"o.`{c}`").eqNullSafe(F.col(f"c.`{c}`")) for c in source.columns], "left_anti")
        counted = counted.unionByName(none.withColumn("n_overlaps", F.lit(0).cast("long")))
    return counted.withColumn(times, F.explode(F.sequence(F.lit(1), times))).drop(times)


def iou(a0: str, a1: str, b0: str, b1: str) -> Column:
    """Intersection over union of two intervals, 0 where the union is empty."""
    inter = F.greatest(F.least(F.col(a1), F.col(b1)) - F.greatest(F.col(a0), F.col(b0)), F.lit(0.0))
    union = (F.col(a1) - F.col(a0)) + (F.col(b1) - F.col(b0)) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def iou_pairs(left: DataFrame, right: DataFrame, cell: float | None = None) -> DataFrame:
    """Overlapping pairs of a file with their iou; all other pairs have 0."""
    return overlap_join(left, right, cell).withColumn("iou", iou("start_s", "end_s", "r_start_s", "r_end_s"))


def _by_file(*order: str):
    return Window.partitionBy("file").orderBy(*order)


def _with_groups(df: DataFrame, starts_new: Column) -> DataFrame:
    """Number the runs of rows between those where starts_new holds."""
    return df.withColumn("group_id", F.sum(F.coalesce(starts_new, F.lit(True)).cast("long")).over(_by_file(*ORDER)))


def _reach(df: DataFrame) -> DataFrame:
    """With reach, the latest end among the rows before; null for a file's first row."""
    return df.withColumn("reach", F.max("end_s").over(_by_file(*ORDER).rowsBetween(Window.unboundedPreceding, -1)))


def overlap_members(df: DataFrame) -> DataFrame:
    """Rows of transitive overlap groups (two members or more) with group_id, group_start, group_end, group_size.

    A row opens a group when it starts at or after the latest end so far.
    """
    g = _with_groups(_reach(df), F.col("start_s") >= F.col("reach")).drop("reach")
    w = Window.partitionBy("file", "group_id")
    g = g.withColumns({"group_start": F.min("start_s").over(w), "group_end": F.max("end_s").over(w), "group_size": F.count("*").over(w)})
    return g.filter("group_size >= 2")


def overlap_groups(df: DataFrame) -> DataFrame:
    """One row for each overlap group."""
    return overlap_members(df).groupBy("file", "group_id").agg(F.min("start_s").alias("group_start"), F.max("end_s").alias("group_end"), F.count("*").alias("group_size"))


def gap_merge(df: DataFrame, gap: float) -> DataFrame:
    """Merge intervals where the next starts no more than `gap` after the one before ends; ends are taken as they
    come, so rows should not be nested."""
    before = F.lag("end_s").over(_by_file(*ORDER))
    g = _with_groups(df.withColumn("before", before), F.col("start_s") - F.col("before") > gap)
    last = F.max_by("end_s", F.struct(*ORDER))
    return g.groupBy("file", "group_id").agg(F.min("start_s").alias("start_s"), last.alias("end_s"), F.count("*").alias("n_merged"))


def coalesce(df: DataFrame, touching: bool = True) -> DataFrame:
    """The union of a file's intervals as disjoint intervals; touching ones join, unless told otherwise."""
    reach = _reach(df)
    g = _with_groups(reach, F.col("start_s") > F.col("reach") if touching else F.col("start_s") >= F.col("reach"))
    return g.groupBy("file", "group_id").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).drop("group_id")


def noise_gaps(df: DataFrame, files: DataFrame, margin: float = 0.5, least: float = 2.0) -> DataFrame:
    """The free time of each file: what no interval, widened by `margin` on both sides, covers, in pieces of at
    least `least` seconds. files: file, duration. Files without intervals are free as a whole."""
    files = files.filter("duration > 0")
    busy = df.join(files, "file").select("file", F.greatest(F.col("start_s") - margin, F.lit(0.0)).alias("start_s"), F.least(F.col("end_s") + margin, F.col("duration")).alias("end_s"), F.lit(0).alias("id"))
    busy = _reach(busy.filter("end_s > start_s"))
    inner = busy.select("file", F.coalesce("reach", F.lit(0.0)).alias("gap_start"), F.col("start_s").alias("gap_end"))
    tail = files.join(busy.groupBy("file").agg(F.max("end_s").alias("gap_start")), "file", "left").select("file", F.coalesce("gap_start", F.lit(0.0)).alias("gap_start"), F.col("duration").alias("gap_end"))
    return inner.unionByName(tail).filter(F.col("gap_end") - F.col("gap_start") >= least)


def longest_solo(members: DataFrame) -> DataFrame:
    """For each row of overlap groups, the longest stretch that no other member covers (the first of equal ones);
    null when there is none. members: as overlap_members gives them."""
    own = members.select("file", "group_id", "id", "start_s", "end_s")
    other = own.select("file", "group_id", F.col("id").alias("o_id"), F.col("start_s").alias("o_start"), F.col("end_s").alias("o_end"))
    pairs = own.join(other, ["file", "group_id"]).filter("o_id <> id")
    w = Window.partitionBy("file", "group_id", "id").orderBy("o_start", "o_end", "o_id")
    seen = pairs.withColumn("cursor", F.greatest(F.col("start_s"), F.max("o_end").over(w.rowsBetween(Window.unboundedPreceding, -1))))
    seen = seen.withColumn("cursor", F.coalesce("cursor", "start_s"))
    gaps = seen.filter("o_start > cursor and o_start <= end_s").select("file", "group_id", "id", F.col("cursor").alias("solo_start"), F.col("o_start").alias("solo_end"))
    tail = pairs.groupBy("file", "group_id", "id", "start_s", "end_s").agg(F.max("o_end").alias("last"))
    tail = tail.select("file", "group_id", "id", F.greatest("start_s", "last").alias("solo_start"), F.col("end_s").alias("solo_end")).filter("solo_end > solo_start")
    best = gaps.unionByName(tail).groupBy("file", "group_id", "id").agg(F.max_by(F.struct("solo_start", "solo_end"), F.struct(F.col("solo_end") - F.col("solo_start"), -F.col("solo_start"))).alias("solo"))
    return own.join(best, ["file", "group_id", "id"], "left").select("file", "group_id", "id", "start_s", "end_s", F.col("solo.solo_start").alias("solo_start"), F.col("solo.solo_end").alias("solo_end"))


def rasterise(df: DataFrame, res: float, n_frames: Column | int | None = None) -> DataFrame:
    """(file, frame) of every frame from floor(start / res) up to ceil(end / res), below n_frames, once each."""
    first = F.greatest(F.floor(F.col("start_s") / res), F.lit(0)).cast("long")
    end = F.ceil(F.col("end_s") / res).cast("long")
    if n_frames is not None:
        end = F.least(end, F.lit(n_frames) if isinstance(n_frames, int) else n_frames)
    spans = df.select("file", first.alias("a"), end.alias("b")).filter("b > a")
    return spans.select("file", F.explode(F.sequence("a", F.col("b") - 1)).alias("frame")).distinct()


def rectangles(df: DataFrame, t_res: float, bin_hz: float, n_bins: int, low_default: float = 10.0, high_default: float = 1000.0) -> DataFrame:
    """(file, frame, bin) that any time-frequency box covers. Times round to the nearest frame, half to even; a
    frequency's bin is the first at or above it; a box has at least one frame and one bin. df: also low_hz, high_hz."""
    low, high = F.coalesce("low_hz", F.lit(low_default)), F.coalesce("high_hz", F.lit(high_default))
    t0 = F.greatest(F.rint(F.col("start_s") / t_res), F.lit(0.0)).cast("long")
    t1 = F.rint(F.col("end_s") / t_res).cast("long")
    b0 = F.least(F.greatest(F.ceil(low / bin_hz), F.lit(0)), F.lit(n_bins)).cast("long")
    b1 = F.least(F.greatest(F.ceil(high / bin_hz), F.lit(0)), F.lit(n_bins)).cast("long")
    boxes = df.select("file", t0.alias("t0"), t1.alias("t1"), b0.alias("b0"), b1.alias("b1")).filter("t1 > t0 and b1 > b0")
    frames = boxes.select("file", F.explode(F.sequence("t0", F.col("t1") - 1)).alias("frame"), "b0", "b1")
    return frames.select("file", "frame", F.explode(F.sequence("b0", F.col("b1") - 1)).alias("bin")).distinct()


def chunk_windows(chunks: DataFrame, calls: DataFrame, length: float = 8.0, cell: float | None = None) -> DataFrame:
    """Calls of a file that reach into each chunk [start_s, start_s + length), clipped and counted from its start.
    chunks: file, id, start_s. calls: file, id, start_s, end_s."""
    c = chunks.select("file", F.col("id").alias("chunk_id"), "start_s", (F.col("start_s") + length).alias("end_s"))
    j = overlap_join(c, calls.select("file", "id", "start_s", "end_s"), cell)
    return j.select("file", "chunk_id", F.col("r_id").alias("id"), (F.greatest("r_start_s", "start_s") - F.col("start_s")).alias("rel_start"), (F.least("r_end_s", "end_s") - F.col("start_s")).alias("rel_end"))


def weighted_draws(gaps: DataFrame, draws: DataFrame, chunk: float) -> DataFrame:
    """Draw free pieces in proportion to their length and a place inside. gaps: file, gap_start, gap_end. draws:
    draw_id, u, v (both in [0, 1)), which choose piece and place; the same draws give the same rows.

    The running share comes in two steps, within files and over files, and the latter in ranges of files."""
    g = gaps.withColumn("w", F.col("gap_end") - F.col("gap_start"))
    per = g.groupBy("file").agg(F.sum("w").alias("file_w"))
    upto = running_before(per, "file", "file_w", "file_begin")
    total = per.agg(F.sum("file_w").alias("total"))
    picked = draws.crossJoin(F.broadcast(total)).withColumn("x", F.col("u") * F.col("total"))
    inner = g.withColumn("upto", F.sum("w").over(Window.partitionBy("file").orderBy("gap_start"))).join(upto.select("file", "file_begin"), "file")
    inner = inner.select("file", "gap_start", "gap_end", "w", (F.col("file_begin") + F.col("upto") - F.col("w")).alias("lo"), (F.col("file_begin") + F.col("upto")).alias("hi"))
    cells = F.floor(F.col("lo") / chunk), F.floor(F.col("hi") / chunk)
    inner = inner.withColumn("cell", F.explode(F.sequence(*cells)))
    hit = picked.withColumn("cell", F.floor(F.col("x") / chunk)).join(inner, "cell").filter("x >= lo and x < hi")
    place = F.col("gap_start") + F.col("v") * F.greatest(F.col("w") - chunk, F.lit(0.0))
    return hit.select("draw_id", "file", place.alias("start_s"))
