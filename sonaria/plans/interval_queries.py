"""Interval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonaria.functions import scalars as fn
from sonaria.operators import intervals as iv
from sonaria.operators import matching, metrics
from sonaria.plans import views as v
from sonaria.plans.views import r, sql
from sonaria.sources import annotations

HOUR = 3600.0


def interval_overlap_join(spark, d):
    j = iv.overlap_join(v.truth(spark, d), v.predictions(spark, d), cell=86400.0)
    return j.select("file", "id", "r_id", r(F.least("end_s", "r_end_s") - F.greatest("start_s", "r_start_s")).alias("shared_s"))


def interval_iou(spark, d):
    return iv.iou_pairs(v.truth(spark, d), v.predictions(spark, d)).select("file", "id", "r_id", r("iou").alias("iou"))


def overlap_count_left(spark, d):
    return iv.overlap_counts(v.truth(spark, d), v.predictions(spark, d)).select("file", "id", "n_overlaps")


def merge_frag_rate(spark, d):
    gt, pred = v.truth(spark, d), v.predictions(spark, d)
    out = [metrics.multiple_rate(a, b).select(F.lit(k).alias("kind"), "n", "n_multiple", r("rate").alias("rate")) for k, a, b in (("fragmentation", gt, pred), ("merge", pred, gt))]
    return out[0].unionByName(out[1])


def _iv(spark, d):
    return v.intervals(spark, d).select("file", "id", "start_s", "end_s")


def overlap_groups(spark, d):
    g = iv.overlap_groups(_iv(spark, d))
    return g.select("file", r("group_start").alias("group_start"), r("group_end").alias("group_end"), "group_size")


def overlap_group_members(spark, d):
    m = iv.overlap_members(_iv(spark, d))
    return m.select("file", "id", r("group_start").alias("group_start"), "group_size")


def noise_gaps(spark, d):
    g = iv.noise_gaps(_iv(spark, d), v.durations(spark, d))
    return g.select("file", r("gap_start").alias("gap_start"), r("gap_end").alias("gap_end"))


def longest_solo(spark, d):
    s = iv.longest_solo(iv.overlap_members(_iv(spark, d)))
    return s.select("file", "id", r("solo_start").alias("solo_start"), r("solo_end").alias("solo_end"))


def gap_merge(spark, d):
    g = iv.gap_merge(_iv(spark, d), HOUR)
    return g.select("file", r("start_s").alias("start_s"), r("end_s").alias("end_s"), "n_merged")


def rasterize_frames(spark, d):
    return iv.rasterise(v.truth(spark, d), HOUR, 720).select("file", "frame")


def frame_confusion(spark, d):
    return metrics.frame_confusion(v.truth(spark, d), v.predictions(spark, d), v.durations(spark, d), HOUR).select("file", "tp", "fp", "fn", "tn")


def rect_mask(spark, d):
    t = v.intervals(spark, d).filter("event_type = 'view'")
    boxes = t.select("file", "start_s", "end_s", F.col("value").alias("low_hz"), F.when(F.col("id") % 3 != 0, F.col("value") * 2 + 40).alias("high_hz"))
    return iv.rectangles(boxes, 4 * HOUR, 25.0, 48).groupBy("file", "bin").agg(F.count("*").alias("n_frames"))


def file_universe(spark, d):
    return metrics.file_universe(v.truth(spark, d), v.predictions(spark, d), v.durations(spark, d))


def semi_has_audio(spark, d):
    some = v.durations(spark, d).filter(F.col("file").cast("int") % 3 == 0)
    return v.truth(spark, d).join(some, "file", "left_semi").select("file", "id")


def anti_unmatched(spark, d):
    gt = v.truth(spark, d)
    j = iv.iou_pairs(gt, v.predictions(spark, d)).filter("iou >= 0.3")
    return gt.join(j.select("file", "id"), ["file", "id"], "left_anti").select("file", "id")


def chunk_window_join(spark, d):
    """A chunk for every call."""
    c = iv.chunk_windows(v.truth(spark, d).select("file", "id", "start_s"), v.predictions(spark, d), 2 * HOUR)
    return c.select("file", "chunk_id", "id", r("rel_start").alias("rel_start"), r("rel_end").alias("rel_end"))


def positive_duration(spark, d):
    return v.intervals(spark, d).select("id", r(iv.duration("end_s", "start_s")).alias("backward_s"), r(iv.duration()).alias("forward_s"))


def weighted_sample_hash(spark, d):
    gaps = iv.noise_gaps(_iv(spark, d), v.durations(spark, d))
    draws = spark.range(200).select(F.col("id").alias("draw_id"), fn.hashed_unit(F.lit("u"), "id").alias("u"), fn.hashed_unit(F.lit("v"), "id").alias("v"))
    return iv.weighted_draws(gaps, draws, HOUR).select("draw_id", "file", r("start_s", 3).alias("start_s"))


def collar_greedy_match(spark, d):
    return matching.collar_matches(v.truth(spark, d), v.predictions(spark, d), HOUR)


def hungarian_match(spark, d):
    return matching.best_matches(v.truth(spark, d), v.predictions(spark, d)).select("file", "t_id", "p_id", r("iou").alias("iou"))


def _files(spark, d):
    gt, pred = v.truth(spark, d), v.predictions(spark, d)
    return metrics.per_file(gt, pred, matching.best_matches(gt, pred))


def event_metrics(spark, d):
    return metrics.event_metrics(_files(spark, d)).withColumns({c: r(c) for c in ("precision", "recall", "f1", "avg_iou", "boundary_error")})


def per_file_rollup(spark, d):
    """Counts by overlap instead of assignment, rolled up."""
    gt = iv.overlap_counts(v.truth(spark, d), v.predictions(spark, d))
    t = gt.select("file", F.lit(0.5).alias("threshold"), F.least("n_overlaps", F.lit(1)).alias("tp"), F.lit(0).alias("fp"), (1 - F.least("n_overlaps", F.lit(1))).alias("fn"))
    return metrics.rolled_up(t).select("file", "threshold", "tp", F.col("fn").cast("long").alias("fn"))


def pr_f1_safe(spark, d):
    """Frame scores of each file."""
    f = metrics.frame_confusion(v.truth(spark, d), v.predictions(spark, d), v.durations(spark, d), HOUR)
    return f.select("file", *(r(c).alias(k) for k, c in metrics.scores().items()))


def fa_per_hour(spark, d):
    pred = iv.overlap_counts(v.predictions(spark, d), v.truth(spark, d))
    fp = pred.agg(F.count_if(F.col("n_overlaps") == 0).alias("fp"))
    h = v.durations(spark, d).agg((F.sum("duration") / 3600).alias("hours"))
    return fp.crossJoin(F.broadcast(h)).select("fp", r("hours").alias("hours"), r(metrics.ratio(F.col("fp"), F.col("hours")), 9).alias("fa_per_hour"))


def report_lines(spark, d):
    f = metrics.frame_confusion(v.truth(spark, d), v.predictions(spark, d), v.durations(spark, d), HOUR)
    named = f.select(F.concat(F.lit("recording_of_a_rather_long_night_by_the_river_"), "file", F.lit(".wav")).alias("file"), F.col("tp").alias("gt_calls"), F.col("fp").alias("pred_calls"), "tp", "fp", "fn")
    return metrics.report_lines(named).select("file", "line")


def selection_ids(spark, d):
    """Seconds are those of the times themselves, not of the rounded ones of a selection table."""
    t = annotations.numbered(v.intervals(spark, d).filter("event_type = 'signup'").select("file", "start_s", "end_s"))
    return t.select("Selection", F.col("file").alias("Sound_file"), F.floor("start_s").alias("start_second"))


def dummy_annotations(spark, d):
    return annotations.dummy_annotations(v.durations(spark, d))


def basename_trim(spark, d):
    t = v.table(spark, d, "part")
    return t.select("p_partkey", fn.basename(F.concat(F.lit(" /a/"), "p_brand", F.lit("/"), "p_name", F.lit(".wav "))).alias("file"))


def rumble_filter(spark, d):
    t = v.table(spark, d, "part")
    return t.filter(metrics.is_rumble(F.when(F.col("p_size") % 7 != 0, F.upper("p_name")), "ring")).select("p_partkey", "p_name")


def frequency_defaults(spark, d):
    t = v.intervals(spark, d).select("id", F.when(F.col("event_type") == "view", F.col("value")).alias("low_hz"), F.when(F.col("event_type") != "click", F.col("value") * 3).alias("high_hz"))
    return annotations.with_default_band(t).select("id", r("low_hz").alias("low_hz"), r("high_hz").alias("high_hz"))


def frame_bin_index(spark, d):
    t = v.intervals(spark, d)
    return t.select("id", fn.to_frame("value", 4000, 1024).alias("frame"), fn.to_bin("value", 4000, 8192).alias("bin"), r(fn.frame_time(F.col("id") % 500, 4000, 256, F.lit(300))).alias("time_s"))


def format_mmss(spark, d):
    return v.intervals(spark, d).select("id", fn.minutes(F.when(F.col("event_type") != "error", F.col("start_s"))).alias("mmss"))


def timeline_percent(spark, d):
    t = v.intervals(spark, d).withColumn("total", F.lit(v.DAYS))
    return t.select("id", r(fn.left_percent("start_s", "total")).alias("left_pct"), r(fn.width_percent("start_s", "end_s", "total")).alias("width_pct"))


def session_merge(spark, d):
    from sonaria.streaming.windows import sessions

    e = v.table(spark, d, "events").select(F.col("user_id").cast("string").alias("file"), F.col("ts"), "value")
    s = sessions(e, "3 hours")
    return s.select("file", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", r("value", 4).alias("value"))


def tumbling_rms(spark, d):
    from sonaria.streaming.windows import tumbling_rms as rms

    e = v.table(spark, d, "events").select(F.col("event_type").alias("file"), "ts", "value")
    return rms(e, "6 hours").select("file", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), r("rms").alias("rms"))


TOUCH = "a.file = b.file AND a.start_s < b.end_s AND b.start_s < a.end_s"
IOU = """CASE WHEN (a.end_s - a.start_s) + (b.end_s - b.start_s) - greatest(least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s), 0) > 0
    THEN greatest(least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s), 0) / ((a.end_s - a.start_s) + (b.end_s - b.start_s) - greatest(least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s), 0)) ELSE 0 END"""
ORDERED = "(PARTITION BY file ORDER BY start_s, end_s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
GROUPED = f"""reach AS (SELECT *, max(end_s) OVER {ORDERED} AS reach FROM iv), numbered AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_s >= reach THEN 1 ELSE 0 END)
    OVER (PARTITION BY file ORDER BY start_s, end_s, id) AS g FROM reach), sized AS (SELECT *, min(start_s) OVER w AS group_start, max(end_s) OVER w AS group_end, count(*) OVER w AS group_size
    FROM numbered WINDOW w AS (PARTITION BY file, g)), members AS (SELECT * FROM sized WHERE group_size >= 2)"""
COUNTED = f"""counted AS (SELECT a.file, a.id, count(b.id) AS n_overlaps FROM gt a LEFT JOIN pred b ON {TOUCH} GROUP BY a.file, a.id),
    backward AS (SELECT a.file, a.id, count(b.id) AS n_overlaps FROM pred a LEFT JOIN gt b ON {TOUCH} GROUP BY a.file, a.id)"""


def _cells(name: str, table: str) -> str:
    return f"{name} AS (SELECT DISTINCT file, unnest(generate_series(greatest(floor(start_s / 3600), 0)::BIGINT, least(ceil(end_s / 3600), 720)::BIGINT - 1)) AS frame FROM {table})"


CONFUSION = f"""{_cells("t", "gt")}, {_cells("p", "pred")}, cells AS (SELECT file, count(*) FILTER (WHERE t.frame IS NOT NULL AND p.frame IS NOT NULL) AS tp,
    count(*) FILTER (WHERE t.frame IS NULL) AS fp, count(*) FILTER (WHERE p.frame IS NULL) AS fn FROM t FULL JOIN p USING (file, frame) GROUP BY file),
    conf AS (SELECT file, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, 720 - coalesce(tp, 0) - coalesce(fp, 0) - coalesce(fn, 0) AS tn FROM dur LEFT JOIN cells USING (file))"""
GAPS = f"""wide AS (SELECT file, greatest(start_s - 0.5, 0) AS s, least(end_s + 0.5, 2592000) AS e FROM iv), busy AS (SELECT * FROM wide WHERE e > s),
    before AS (SELECT *, max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM busy),
    gaps AS (SELECT * FROM (SELECT file, coalesce(upto, 0) AS gap_start, s AS gap_end FROM before UNION ALL SELECT file, coalesce(max(e), 0), 2592000 FROM dur LEFT JOIN busy USING (file) GROUP BY file) WHERE gap_end - gap_start >= 2)"""
HASH = "('0x' || substr(md5({0}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE"
PRF = """CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0 END AS r"""
#: The best matching by trying all: within each connected part of the overlaps, truths one after another take a free
#: prediction or none.
MATCHED = """pairs AS MATERIALIZED (SELECT *, inter / ((te - ts) + (pe - ps) - inter) AS iou FROM (SELECT gt.file, gt.id AS t, pred.id AS p, gt.start_s AS ts, gt.end_s AS te, pred.start_s AS ps, pred.end_s AS pe,
        least(gt.end_s, pred.end_s) - greatest(gt.start_s, pred.start_s) AS inter FROM gt JOIN pred ON gt.file = pred.file AND gt.start_s < pred.end_s AND pred.start_s < gt.end_s)),
    reach AS (SELECT DISTINCT t, t AS r FROM pairs UNION SELECT b.t, reach.r FROM reach JOIN pairs a ON a.t = reach.t JOIN pairs b ON b.file = a.file AND b.p = a.p),
    part AS MATERIALIZED (SELECT t, min(r) AS c FROM reach GROUP BY t),
    nth AS MATERIALIZED (SELECT c, t, row_number() OVER (PARTITION BY c ORDER BY t) AS k, count(*) OVER (PARTITION BY c) AS n FROM part),
    choice AS MATERIALIZED (SELECT t, p, iou FROM pairs UNION ALL SELECT t, NULL, 0 FROM part),
    state AS (SELECT DISTINCT c, n, 0::BIGINT AS k, []::BIGINT[] AS used, []::BIGINT[] AS taken, 0.0::DOUBLE AS total FROM nth
        UNION ALL SELECT s.c, s.n, nth.k, CASE WHEN o.p IS NULL THEN used ELSE list_append(used, o.p) END, CASE WHEN o.p IS NULL THEN taken ELSE list_append(taken, nth.t) END, total + o.iou
        FROM state s JOIN nth ON nth.c = s.c AND nth.k = s.k + 1 JOIN choice o ON o.t = nth.t WHERE o.p IS NULL OR NOT list_contains(used, o.p)),
    best AS (SELECT arg_max(used, total) AS used, arg_max(taken, total) AS taken FROM state WHERE k = n GROUP BY c),
    matched AS (SELECT pairs.* FROM (SELECT unnest(taken) AS t, unnest(used) AS p FROM best) JOIN pairs USING (t, p))"""
EVENTS = """SELECT threshold, tp, fp, fn, round(p, 6) + 0.0 AS precision, round(r, 6) + 0.0 AS recall, round(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) + 0.0 AS f1,
    round(CASE WHEN tp > 0 THEN s / tp ELSE 0 END, 6) + 0.0 AS avg_iou, round(CASE WHEN tp > 0 THEN e / (2 * tp) END, 6) + 0.0 AS boundary_error
    FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM (
        SELECT threshold, tp, (SELECT count(*) FROM pred) - tp AS fp, (SELECT count(*) FROM gt) - tp AS fn, s, e FROM (
            SELECT threshold, count(*) FILTER (WHERE iou >= threshold) AS tp, sum(iou) FILTER (WHERE iou >= threshold) AS s, sum(abs(ps - ts) + abs(pe - te)) FILTER (WHERE iou >= threshold) AS e
            FROM matched, (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS threshold) GROUP BY threshold)))"""

SQL = {
    "hungarian_match": sql("SELECT file, t AS t_id, p AS p_id, round(iou, 6) + 0.0 AS iou FROM matched", "gt", "pred", more=MATCHED),
    "event_metrics": sql(EVENTS, "gt", "pred", more=MATCHED),
    "interval_overlap_join": sql(f"SELECT a.file, a.id, b.id AS r_id, round(least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s), 6) + 0.0 AS shared_s FROM gt a JOIN pred b ON {TOUCH}", "gt", "pred"),
    "interval_iou": sql(f"SELECT a.file, a.id, b.id AS r_id, round({IOU}, 6) + 0.0 AS iou FROM gt a JOIN pred b ON {TOUCH}", "gt", "pred"),
    "overlap_count_left": sql("SELECT * FROM counted", "gt", "pred", more=COUNTED),
    "merge_frag_rate": sql(
        """SELECT 'fragmentation' AS kind, count(*) AS n, count(*) FILTER (WHERE n_overlaps >= 2) AS n_multiple, round(count(*) FILTER (WHERE n_overlaps >= 2) * 100.0::DOUBLE / count(*), 6) + 0.0 AS rate FROM counted
        UNION ALL SELECT 'merge', count(*), count(*) FILTER (WHERE n_overlaps >= 2), round(count(*) FILTER (WHERE n_overlaps >= 2) * 100.0::DOUBLE / count(*), 6) + 0.0 FROM backward""", "gt", "pred", more=COUNTED),
    "overlap_groups": sql("SELECT DISTINCT file, round(group_start, 6) + 0.0 AS group_start, round(group_end, 6) + 0.0 AS group_end, group_size FROM members", "iv", more=GROUPED),
    "overlap_group_members": sql("SELECT file, id, round(group_start, 6) + 0.0 AS group_start, group_size FROM members", "iv", more=GROUPED),
    "noise_gaps": sql("SELECT file, round(gap_start, 6) + 0.0 AS gap_start, round(gap_end, 6) + 0.0 AS gap_end FROM gaps", "iv", "dur", more=GAPS),
    "longest_solo": sql(
        """SELECT m.file, m.id, round(solo_start, 6) + 0.0 AS solo_start, round(solo_end, 6) + 0.0 AS solo_end FROM members m LEFT JOIN (SELECT * FROM free QUALIFY row_number()
        OVER (PARTITION BY file, g, id ORDER BY solo_end - solo_start DESC, solo_start) = 1) f ON f.file = m.file AND f.g = m.g AND f.id = m.id""", "iv", more=GROUPED + """,
        others AS (SELECT a.file, a.g, a.id, a.start_s, a.end_s, b.start_s AS o0, b.end_s AS o1, b.id AS oid FROM members a JOIN members b ON a.file = b.file AND a.g = b.g AND a.id <> b.id),
        swept AS (SELECT *, greatest(start_s, coalesce(max(o1) OVER (PARTITION BY file, g, id ORDER BY o0, o1, oid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_s)) AS cur FROM others),
        free AS (SELECT file, g, id, cur AS solo_start, o0 AS solo_end FROM swept WHERE o0 > cur AND o0 <= end_s UNION ALL
            SELECT file, g, id, greatest(start_s, max(o1)), end_s FROM others GROUP BY file, g, id, start_s, end_s HAVING end_s > greatest(start_s, max(o1)))"""),
    "gap_merge": sql(
        """SELECT file, round(min(start_s), 6) + 0.0 AS start_s, round(arg_max(end_s, k), 6) + 0.0 AS end_s, count(*) AS n_merged FROM (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY k) AS g FROM
        (SELECT *, row_number() OVER w AS k, CASE WHEN start_s - lag(end_s) OVER w > 3600 OR lag(end_s) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM iv WINDOW w AS (PARTITION BY file ORDER BY start_s, end_s, id))) GROUP BY file, g""", "iv"),
    "rasterize_frames": sql("SELECT file, frame FROM t", "gt", more=_cells("t", "gt")),
    "frame_confusion": sql("SELECT * FROM conf", "gt", "pred", "dur", more=CONFUSION),
    "rect_mask": sql(
        """SELECT file, bin, count(*) AS n_frames FROM (SELECT DISTINCT file, bin, unnest(generate_series(t0, t1 - 1)) AS frame FROM (SELECT file, t0, t1, unnest(generate_series(b0, b1 - 1)) AS bin FROM box WHERE t1 > t0 AND b1 > b0)) GROUP BY file, bin""", "iv",
        more="""box AS (SELECT file, greatest(round_even(start_s / 14400, 0), 0)::BIGINT AS t0, round_even(end_s / 14400, 0)::BIGINT AS t1, least(greatest(ceil(value / 25), 0), 48)::BIGINT AS b0,
        least(greatest(ceil(CASE WHEN id % 3 <> 0 THEN value * 2 + 40 ELSE 1000 END / 25), 0), 48)::BIGINT AS b1 FROM iv WHERE event_type = 'view')"""),
    "file_universe": sql("SELECT file FROM gt UNION SELECT file FROM pred UNION SELECT file FROM dur", "gt", "pred", "dur"),
    "semi_has_audio": sql("SELECT file, id FROM gt WHERE file IN (SELECT file FROM dur WHERE file::INTEGER % 3 = 0)", "gt", "dur"),
    "anti_unmatched": sql(f"SELECT file, id FROM gt WHERE (file, id) NOT IN (SELECT (a.file, a.id) FROM gt a JOIN pred b ON {TOUCH} WHERE {IOU} >= 0.3)", "gt", "pred"),
    "chunk_window_join": sql(
        """SELECT a.file, a.id AS chunk_id, b.id, round(greatest(b.start_s, a.start_s) - a.start_s, 6) + 0.0 AS rel_start, round(least(b.end_s, a.start_s + 7200) - a.start_s, 6) + 0.0 AS rel_end
        FROM gt a JOIN pred b ON a.file = b.file AND a.start_s < b.end_s AND b.start_s < a.start_s + 7200""", "gt", "pred"),
    "positive_duration": sql("SELECT id, round(greatest(start_s - end_s, 0), 6) + 0.0 AS backward_s, round(greatest(end_s - start_s, 0), 6) + 0.0 AS forward_s FROM iv", "iv"),
    "weighted_sample_hash": sql(
        """SELECT draw_id, file, round(gap_start + v * greatest(w - 3600, 0), 3) + 0.0 AS start_s FROM draws JOIN placed ON draws.u * (SELECT sum(fw) FROM per) >= lo AND draws.u * (SELECT sum(fw) FROM per) < lo + w""", "iv", "dur",
        more=GAPS + f""", per AS (SELECT file, sum(gap_end - gap_start) AS fw FROM gaps GROUP BY file), upto AS (SELECT file, sum(fw) OVER (ORDER BY file) - fw AS fb FROM per),
        placed AS (SELECT file, gap_start, gap_end - gap_start AS w, fb + sum(gap_end - gap_start) OVER (PARTITION BY file ORDER BY gap_start) - (gap_end - gap_start) AS lo FROM gaps JOIN upto USING (file)),
        draws AS (SELECT draw_id, {HASH.format("'u|' || draw_id")} AS u, {HASH.format("'v|' || draw_id")} AS v FROM (SELECT unnest(generate_series(0, 199)) AS draw_id))"""),
    "collar_greedy_match": sql(
        """SELECT file, len(taken)::BIGINT AS tp, (n - len(taken))::BIGINT AS fp, (coalesce(len(t), 0) - len(taken))::BIGINT AS fn FROM fold WHERE k = n""", "gt", "pred",
        more="""tl AS (SELECT file, list({'i': id, 's': start_s, 'e': end_s} ORDER BY id) AS t FROM gt GROUP BY file), pl AS (SELECT file, list({'s': start_s, 'e': end_s} ORDER BY id) AS p FROM pred GROUP BY file),
        fold AS (SELECT file, 0 AS k, []::BIGINT[] AS taken, t, p, coalesce(len(p), 0) AS n FROM tl FULL JOIN pl USING (file) UNION ALL SELECT file, k + 1, list_concat(taken, list_transform(list_filter(coalesce(t, []), lambda g: NOT list_contains(taken, g.i) AND
            ((p[k + 1].s + p[k + 1].e) / 2 BETWEEN g.s - 3600 AND g.e + 3600 OR (g.s + g.e) / 2 BETWEEN p[k + 1].s - 3600 AND p[k + 1].e + 3600))[1:1], lambda g: g.i)), t, p, n FROM fold WHERE k < n)"""),
    "per_file_rollup": sql(
        """SELECT file, threshold, sum(least(n_overlaps, 1))::BIGINT AS tp, sum(1 - least(n_overlaps, 1))::BIGINT AS fn FROM (SELECT *, 0.5::DOUBLE AS threshold FROM counted) GROUP BY ROLLUP (threshold, file)""", "gt", "pred", more=COUNTED),
    "pr_f1_safe": sql(
        f"""SELECT file, round(p, 6) + 0.0 AS precision, round(r, 6) + 0.0 AS recall, round(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) + 0.0 AS f1 FROM (SELECT file, {PRF} FROM conf)""", "gt", "pred", "dur", more=CONFUSION),
    "fa_per_hour": sql(
        "SELECT fp, round(hours, 6) + 0.0 AS hours, round(fp / hours, 9) + 0.0 AS fa_per_hour FROM (SELECT count(*) AS fp FROM backward WHERE n_overlaps = 0), (SELECT sum(duration) / 3600 AS hours FROM dur)", "gt", "pred", "dur", more=COUNTED),
    "report_lines": sql(
        """SELECT file, '  ' || rpad(CASE WHEN length(file) > 45 THEN substr(file, 1, 42) || '...' ELSE file END, 45, ' ') || ' ' || lpad(tp::VARCHAR, 4, ' ') || ' ' || lpad(fp::VARCHAR, 5, ' ') || ' ' || lpad(tp::VARCHAR, 4, ' ')
        || ' ' || lpad(fp::VARCHAR, 4, ' ') || ' ' || lpad(fn::VARCHAR, 4, ' ') AS line FROM (SELECT 'recording_of_a_rather_long_night_by_the_river_' || file || '.wav' AS file, tp, fp, fn FROM conf) WHERE tp > 0 OR fp > 0""", "gt", "pred", "dur", more=CONFUSION),
    "selection_ids": sql("""SELECT row_number() OVER (ORDER BY file, start_s, end_s)::INTEGER AS "Selection", file AS "Sound_file", floor(start_s)::BIGINT AS start_second FROM iv WHERE event_type = 'signup'""", "iv"),
    "dummy_annotations": sql("SELECT file, 2.0::DOUBLE AS start_s, 4.0::DOUBLE AS end_s FROM dur ORDER BY file LIMIT 5", "dur"),
    "basename_trim": "SELECT p_partkey, p_name || '.wav' AS file FROM part",
    "rumble_filter": "SELECT p_partkey, p_name FROM part WHERE p_size % 7 <> 0 AND lower(p_name) LIKE '%ring%'",
    "frequency_defaults": sql("SELECT id, round(CASE WHEN event_type = 'view' THEN value ELSE 10 END, 6) + 0.0 AS low_hz, round(CASE WHEN event_type <> 'click' THEN value * 3 ELSE 1000 END, 6) + 0.0 AS high_hz FROM iv", "iv"),
    "frame_bin_index": sql("SELECT id, round_even(value * 4000 / 1024, 0)::BIGINT AS frame, greatest(ceil(value / (4000.0::DOUBLE / 8192)), 0)::BIGINT AS bin, round(least(id % 500, 300) * 256 / 4000.0::DOUBLE, 6) + 0.0 AS time_s FROM iv", "iv"),
    "format_mmss": sql("SELECT id, CASE WHEN event_type = 'error' THEN '0:00' ELSE (floor(start_s)::BIGINT // 60)::VARCHAR || ':' || lpad((floor(start_s)::BIGINT % 60)::VARCHAR, 2, '0') END AS mmss FROM iv", "iv"),
    "timeline_percent": sql("SELECT id, round(start_s / 2592000 * 100, 6) + 0.0 AS left_pct, round(greatest(0.5, (end_s - start_s) / 2592000 * 100), 6) + 0.0 AS width_pct FROM iv", "iv"),
    "session_merge": """SELECT file, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) + 0.0 AS value FROM (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY ts) AS g FROM
        (SELECT user_id::VARCHAR AS file, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 3 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events)) GROUP BY file, g""",
    "tumbling_rms": "SELECT event_type AS file, strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M:%S') AS start, round(sqrt(avg(value * value) + 1e-12), 6) + 0.0 AS rms FROM events GROUP BY ALL",
}

QUERIES = {
    f.__name__: f
    for f in (
        interval_overlap_join, interval_iou, overlap_count_left, merge_frag_rate, overlap_groups, overlap_group_members, noise_gaps, longest_solo, gap_merge, rasterize_frames, frame_confusion, rect_mask,
        file_universe, semi_has_audio, anti_unmatched, chunk_window_join, positive_duration, weighted_sample_hash, collar_greedy_match, hungarian_match, event_metrics, per_file_rollup, pr_f1_safe, fa_per_hour,
        report_lines, selection_ids, dummy_annotations, basename_trim, rumble_filter, frequency_defaults, frame_bin_index, format_mmss, timeline_percent, session_merge, tumbling_rms,
    )
}
