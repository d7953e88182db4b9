"""Scores of predictions against truth. truth and pred: file, id, start_s, end_s; truth also call_type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonaria.operators.intervals import overlap_counts, rasterise
from sonaria.operators.matching import best_matches, collar_matches

THRESHOLDS = (0.3, 0.5, 0.7)


def is_rumble(c: str = "call_type", word: str = "rumble") -> Column:
    """Whether a call type names a rumble, in any case and also as part of a compound; null doesn't."""
    return F.coalesce(F.lower(c).contains(word), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def scores(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> dict[str, Column]:
    p, r = ratio(F.col(tp), F.col(tp) + F.col(fp)), ratio(F.col(tp), F.col(tp) + F.col(fn))
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)}


def per_file(truth: DataFrame, pred: DataFrame, matches: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """(file, threshold, gt_calls, pred_calls, tp, fp, fn, iou_sum, error_sum) for every file with either."""
    n = truth.groupBy("file").agg(F.count("*").alias("gt_calls")).join(pred.groupBy("file").agg(F.count("*").alias("pred_calls")), "file", "full")
    n = n.select("file", F.coalesce("gt_calls", F.lit(0)).alias("gt_calls"), F.coalesce("pred_calls", F.lit(0)).alias("pred_calls"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    m = matches.select("file", "iou", (F.col("start_error") + F.col("end_error")).alias("err"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).filter("iou >= threshold")
    m = m.groupBy("file", "threshold").agg(F.count("*").alias("tp"), F.sum("iou").alias("iou_sum"), F.sum("err").alias("error_sum"))
    j = n.join(m, ["file", "threshold"], "left").withColumns({"tp": F.coalesce("tp", F.lit(0)), "iou_sum": F.coalesce("iou_sum", F.lit(0.0)), "error_sum": F.coalesce("error_sum", F.lit(0.0))})
    return j.withColumns({"fp": F.col("pred_calls") - F.col("tp"), "fn": F.col("gt_calls") - F.col("tp")})


def event_metrics(files: DataFrame) -> DataFrame:
    """A row for each threshold. files: as per_file gives them. The boundary error is the mean over all start and
    end errors, null without matches."""
    t = files.groupBy("threshold").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "iou_sum", "error_sum")))
    return t.select("threshold", "tp", "fp", "fn", *(c.alias(k) for k, c in scores().items()), ratio(F.col("iou_sum"), F.col("tp")).alias("avg_iou"), F.when(F.col("tp") > 0, F.col("error_sum") / (2 * F.col("tp"))).alias("boundary_error"))


def rolled_up(files: DataFrame) -> DataFrame:
    """Counts for each file and threshold, each threshold, and in all (nulls mark totals)."""
    return files.rollup("threshold", "file").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def frame_confusion(truth: DataFrame, pred: DataFrame, files: DataFrame, res: float) -> DataFrame:
    """(file, tp, fp, fn, tn) over the ceil(duration / res) frames of each file. files: file, duration."""
    f = files.select("file", F.ceil(F.col("duration") / res).cast("long").alias("n"))

    def raster(df: DataFrame) -> DataFrame:
        return rasterise(df.join(f, "file"), res, F.col("n"))

    t, p = raster(truth).withColumn("t", F.lit(1)), raster(pred).withColumn("p", F.lit(1))
    cells = t.join(p, ["file", "frame"], "full").groupBy("file").agg(F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    j = f.join(cells, "file", "left").select("file", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    return j.select("file", "tp", "fp", "fn", (F.col("n") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"))


def multiple_rate(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: how many sources there are, how many overlap two targets or more, and their share in percent. Of
    predictions it is the merge rate, of truth the fragmentation rate."""
    n = overlap_counts(source, target).agg(F.count("*").alias("n"), F.count_if(F.col("n_overlaps") >= 2).alias("n_multiple"))
    return n.select("n", "n_multiple", ratio(F.col("n_multiple") * 100.0, F.col("n")).alias("rate"))


def file_universe(*tables: DataFrame) -> DataFrame:
    """Every file that any table names, once."""
    out = tables[0].select("file")
    for t in tables[1:]:
        out = out.unionByName(t.select("file"))
    return out.distinct()


def evaluate(truth: DataFrame, pred: DataFrame, audio: DataFrame, res: float = 0.256, collar: float = 1.0) -> dict[str, DataFrame]:
    """All tables of an evaluation. audio: file, duration, of the files whose sound is there. Event, frame and rate
    figures take rumbles only as truth, the collar figures all calls; false alarms count in all files, hours in
    those with sound."""
    rumbles = truth.filter(is_rumble())
    matches = best_matches(rumbles, pred)
    files = per_file(rumbles, pred, matches)
    everything = file_universe(truth, pred, audio)
    frames = frame_confusion(rumbles.join(audio, "file", "left_semi"), pred.join(audio, "file", "left_semi"), audio, res)
    sums = frames.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")))
    c = collar_matches(truth, pred, collar).agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn")))
    events = event_metrics(files)
    hours = audio.agg((F.coalesce(F.sum("duration"), F.lit(0.0)) / 3600).alias("hours"))
    at = events.filter(F.col("threshold") == THRESHOLDS[0]).select("fp", "boundary_error")
    merge = multiple_rate(pred, rumbles).select(F.col("rate").alias("merge_rate"))
    frag = multiple_rate(rumbles, pred).select(F.col("rate").alias("fragmentation_rate"))
    one = [F.broadcast(x) for x in (hours, merge, frag)]  # one row each
    diagnostics = at.crossJoin(one[0]).crossJoin(one[1]).crossJoin(one[2]).withColumn("fa_per_hour", ratio(F.col("fp"), F.col("hours")))
    half = files.filter(F.col("threshold") == 0.5).select("file", "gt_calls", "pred_calls", "tp", "fp", "fn")
    counts = everything.join(half, "file", "left").select("file", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("gt_calls", "pred_calls", "tp", "fp", "fn")))
    return {
        "events": events,
        "collar": c.select("*", *(v.alias(k) for k, v in scores().items())),
        "frames": sums.select("*", *(v.alias(k) for k, v in scores().items())),
        "diagnostics": diagnostics,
        "files": counts,
    }


def shortened(c: str, most: int = 45) -> Column:
    """A name of at most `most` characters, with three dots where it was cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(F.col(c))


def report_lines(files: DataFrame) -> DataFrame:
    """(file, line): the fixed-width rows of the per-file section, without files that have neither calls nor predictions."""
    some = files.filter("gt_calls > 0 or pred_calls > 0")
    line = F.concat(F.lit("  "), F.rpad(shortened("file"), 45, " "), *(F.concat(F.lit(" "), F.lpad(F.col(c).cast("string"), n, " ")) for c, n in (("gt_calls", 4), ("pred_calls", 5), ("tp", 4), ("fp", 4), ("fn", 4))))
    return some.select("file", line.alias("line"))


def report(tables: dict[str, DataFrame], predictions: DataFrame) -> str:
    """The whole evaluation as text, in five sections. It is read by people: the tables it prints are small."""
    pct = lambda x: f"{100 * x:.1f}%"
    out = ["Evaluation", "", "Events", f"  {'IoU':<6}{'Precision':>10}{'Recall':>10}{'F1':>10}{'Avg IoU':>10}"]
    out += [f"  {r.threshold:<6.1f}{pct(r.precision):>10}{pct(r.recall):>10}{pct(r.f1):>10}{r.avg_iou:>10.3f}" for r in tables["events"].orderBy("threshold").collect()]
    for name in ("collar", "frames"):
        r = tables[name].first()
        out += ["", name.capitalize(), f"  Precision {pct(r.precision)}, recall {pct(r.recall)}, F1 {pct(r.f1)}"]
    d = tables["diagnostics"].first()
    error = "N/A" if d.boundary_error is None else f"{d.boundary_error:.2f} s"
    out += ["", "Diagnostics", f"  Boundary error {error}, merge rate {d.merge_rate:.1f}%, fragmentation rate {d.fragmentation_rate:.1f}%, false alarms per hour {d.fa_per_hour:.1f}"]
    out += ["", "Files", f"  {'File':<45} {'GT':>4} {'Pred':>5} {'TP':>4} {'FP':>4} {'FN':>4}"]
    out += [r.line for r in report_lines(tables["files"]).orderBy("file").collect()]
    out += ["", "Predictions"]
    rows = predictions.select("Selection", shortened("Sound_file").alias("f"), "Start_time", "End_time", "Call_type").orderBy("Selection").toLocalIterator()
    out += [f"  {r.Selection:>4}  {r.f:<45}  {r.Start_time:>10.4f}  {r.End_time:>10.4f}  {r.Call_type}" for r in rows]
    return "\n".join(out) + "\n"
