"""Frame-series queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sonaria.operators import detector, features, frames as fr, training
from sonaria.operators import separation as sep
from sonaria.plans import views as v
from sonaria.plans.views import r, sql


def rolling_f0_std(spark, d):
    std = fr.rolling_std("f0", 16)
    return v.frames(spark, d).select("file", "frame", r(std).alias("std"), fr.stable(r(std)).alias("stable"))


def binary_closing(spark, d):
    return fr.closing(v.frames(spark, d).select("file", "frame", F.col("contrast").alias("mask")), "mask", 6)


def binary_opening(spark, d):
    m = v.frames(spark, d).select("file", "frame", (F.col("value") > 20).alias("mask"))
    return fr.opening(m, "mask", 4)


def connected_runs(spark, d):
    return fr.runs(v.frames(spark, d), "contrast").select("file", "first", "end")


def fused_mask(spark, d):
    return detector.fused(v.frames(spark, d)).select("file", "frame", "mask")


#: The detector at a scale that fits the event series: a closing of 4 frames, an opening of 3, calls of 5 to 20 frames.
SMALL = detector.Settings(close_s=0.256, open_s=0.192, gap_s=0.192, shortest_s=0.32, longest_s=1.28)


def detect_pipeline(spark, d):
    s = detector.segments(detector.fused(v.frames(spark, d), SMALL), SMALL)
    return s.select("file", r("start_s").alias("start_s"), r("end_s").alias("end_s"), r("confidence").alias("confidence"), r("median_f0_hz").alias("median_f0_hz"))


def valley_split(spark, d):
    f = v.frames(spark, d)
    whole = f.groupBy("file").agg(F.lit(0).alias("first"), (F.max("frame") + 1).alias("end"), F.max("frame").alias("last"))
    return fr.split_at_valleys(whole, f, "vprob", 1.0, v.DT).select("file", "first", "end")


def nan_interp(spark, d):
    return v.frames(spark, d).select("file", "frame", r(fr.interpolate("f0")).alias("f0"))


def median_fill(spark, d):
    return fr.median_fill(v.frames(spark, d), "f0").select("file", "frame", r("f0").alias("f0"))


def trend_extrapolate(spark, d):
    """The middle third of each series, continued over all of it."""
    f = v.frames(spark, d)
    n = F.count("*").over(Window.partitionBy("file"))
    f = f.withColumn("f0", F.when((F.col("frame") * 3 >= n) & (F.col("frame") * 3 < 2 * n), F.col("f0")))
    return fr.extrapolate(f.select("file", "frame", "f0"), "f0").select("file", "frame", r("f0").alias("f0"))


def contour_resample(spark, d):
    e = v.elements(spark, d).select(F.col("vec_id").cast("string").alias("file"), F.col("i").alias("frame"), "v")
    return fr.resample(e, "v", 100).select("file", F.col("frame").cast("int").alias("frame"), r("v").alias("v"))


def murmur_segments(spark, d):
    f = v.frames(spark, d).select("file", F.lit(4).alias("sr"), F.lit(1).alias("size"), "frame", (F.col("value") / 100).alias("rms"))
    return sep._active(f, 0.15, 0.5, 0.3).select("file", r("start_s").alias("start_s"), r("end_s").alias("end_s"))


def rms_profile(spark, d):
    t = features.thirds(v.frames(spark, d), "value")
    return t.select("file", r("onset").alias("onset"), r("sustain").alias("sustain"), r("offset").alias("offset"), r(features.level_db("mean")).alias("rms_db"), r(features.level_db("loudest")).alias("peak_rms_db"), features.onset_profile("onset", "sustain", "offset", "loudest").alias("profile"))


def f0_stats(spark, d):
    s = features.f0_stats(v.frames(spark, d))
    return s.select("file", "voiced", r("f0_median").alias("f0_median"), r("f0_std").alias("f0_std"), r("f0_range").alias("f0_range"), features.modulation("voiced", "f0_median", "f0_range").alias("modulation"))


def caller_rules(spark, d):
    s = v.intervals(spark, d).select("id", (F.col("value") / 2).alias("f0"), (F.col("id") % 50 / 8).alias("duration"), (F.col("id") % 40).cast("int").alias("n"))
    return s.select("id", features.caller_class("f0").alias("caller"), features.social_class("duration").alias("social"), features.harmonic_note("n").alias("harmonics"))


def clip_description(spark, d):
    s = v.intervals(spark, d).select(
        "id", F.lit("rumble").alias("clip_type"), (F.col("id") % 50 / 8).alias("duration_s"), (F.col("id") % 300 / 10).alias("fundamental_hz"), (F.col("id") % 40).cast("int").alias("harmonic_count"),
        F.col("event_type").alias("onset_profile"), F.lit("stable").alias("frequency_modulation"), (F.col("event_type") != "error").alias("is_valid"),
    )
    return features.describe(s).select("id", "analysis")


def epoch_running_min(spark, d):
    f = v.frames(spark, d).select(F.col("file").alias("run"), F.col("frame").alias("epoch"), F.col("value").alias("loss"))
    return training.best_so_far(f).select("run", "epoch", r("best").alias("best"), "improved")


def file_split(spark, d):
    return training.file_split(v.durations(spark, d).select("file"))


W = "(PARTITION BY file ORDER BY frame ROWS BETWEEN {0} PRECEDING AND {1} FOLLOWING)"
STD = f"CASE WHEN count(f0) OVER {W.format(8, 7)} >= 3 THEN stddev_pop(f0) OVER {W.format(8, 7)} ELSE 0 END"


def _morph(source: str, first: str, second: str) -> str:
    return f"SELECT file, frame, {second} AS mask FROM (SELECT file, frame, {first} AS d FROM ({source}))"


def _dil(c: str, a: int, b: int) -> str:
    return f"max({c}::INT) OVER {W.format(a, b)} = 1"


def _ero(c: str, a: int, b: int) -> str:
    return f"sum({c}::INT) OVER {W.format(a, b)} = {a + b + 1}"


def _islands(source: str, c: str) -> str:
    return f"""SELECT file, min(frame) AS first, max(frame) + 1 AS "end" FROM (SELECT *, frame - row_number() OVER (PARTITION BY file ORDER BY frame) AS g FROM ({source}) WHERE {c}) GROUP BY file, g"""


FUSED = f"SELECT file, frame, vprob, best_f0, vprob > 0.2 AND (contrast OR ({STD}) BETWEEN 0.2 AND 6.0) AS mask FROM fr"
TIDY = _morph(_morph("SELECT file, frame, mask FROM fused", _dil("mask", 1, 2), _ero("d", 2, 1)), _ero("mask", 1, 1), _dil("d", 1, 1))
SPLIT = """{0} AS (SELECT file, a, b, 0 AS depth FROM {1} UNION ALL SELECT s.file, unnest([a, cut]), unnest([cut, b]), depth + 1 FROM (SELECT r.file, r.a, r.b, r.depth,
    (SELECT arg_min(f.frame, (f.vprob, f.frame)) FROM {2} f WHERE f.file = r.file AND f.frame >= r.a + greatest(1, (r.b - r.a) // 10) AND f.frame < r.b - greatest(1, (r.b - r.a) // 10)) AS cut
    FROM {0} r JOIN ends e USING (file) WHERE (least(r.b, e.last) - least(r.a, e.last)) * 0.064::DOUBLE > {3}::DOUBLE AND r.b - r.a >= 4 AND r.b - r.a - 2 * greatest(1, (r.b - r.a) // 10) > 0) s)"""
LEAF = "NOT ((least(b, last) - least(a, last)) * 0.064::DOUBLE > {0}::DOUBLE AND b - a >= 4 AND b - a - 2 * greatest(1, (b - a) // 10) > 0)"
ENDS = "ends AS (SELECT file, max(frame) AS last FROM fr GROUP BY file)"
CALLER = """CASE WHEN {0} > 0 AND {0} < 12 THEN '{c[0]}' WHEN {0} < 18 THEN '{c[1]}' WHEN {0} < 25 THEN '{c[2]}' ELSE '{c[3]}' END"""
SOCIAL = """CASE WHEN {0} > 4 THEN '{c[0]}' WHEN {0} > 2 THEN '{c[1]}' WHEN {0} > 1 THEN '{c[2]}' ELSE '{c[3]}' END"""


def _note(n: str) -> str:
    a, b, c = ("'" + t.replace("%d", f"' || {n}::VARCHAR || '") + "'" for t in features.HARMONICS)
    return f"CASE WHEN {n} > 20 THEN {a} WHEN {n} > 5 THEN {b} ELSE {c} END"


ONSET = "CASE WHEN loudest <= 0 THEN 'silent' WHEN a > b * 1.3 THEN '{c[0]}' WHEN c > b * 1.3 THEN '{c[1]}' WHEN abs(a - c) < b * 0.2 THEN '{c[2]}' ELSE '{c[3]}' END"
_caller = CALLER.format("f0", c=features.CALLERS)

SQL = {
    "rolling_f0_std": sql(f"SELECT file, frame, round(s, 6) + 0.0 AS std, round(s, 6) BETWEEN 0.2 AND 6.0 AS stable FROM (SELECT file, frame, {STD} AS s FROM fr)", "fr"),
    "binary_closing": sql(_morph("SELECT file, frame, contrast AS mask FROM fr", _dil("mask", 2, 3), _ero("d", 3, 2)), "fr"),
    "binary_opening": sql(_morph("SELECT file, frame, value > 20 AS mask FROM fr", _ero("mask", 2, 1), _dil("d", 1, 2)), "fr"),
    "connected_runs": sql(_islands("SELECT * FROM fr", "contrast"), "fr"),
    "fused_mask": sql(f"SELECT file, frame, mask FROM ({FUSED})", "fr"),
    "detect_pipeline": sql(
        """SELECT file, round(a * 0.064::DOUBLE, 6) + 0.0 AS start_s, round(least(b, last) * 0.064::DOUBLE, 6) + 0.0 AS end_s, round(avg(vprob), 6) + 0.0 AS confidence, round(median(best_f0), 6) + 0.0 AS median_f0_hz
        FROM parts JOIN ends USING (file) JOIN fused USING (file) WHERE frame >= a AND frame < b AND """ + LEAF.format(1.28) + " GROUP BY file, a, b, last HAVING avg(vprob) >= 0.1", "fr",
        more=f"""{ENDS}, fused AS ({FUSED}), tidy AS ({TIDY}), isl AS ({_islands("SELECT * FROM tidy", "mask")}),
        timed AS (SELECT file, first, "end", first * 0.064::DOUBLE AS t0, least("end", last) * 0.064::DOUBLE AS t1 FROM isl JOIN ends USING (file)),
        numbered AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY first) AS g FROM (SELECT *, CASE WHEN t0 - lag(t1) OVER w <= 0.192::DOUBLE THEN 0 ELSE 1 END AS new FROM timed WINDOW w AS (PARTITION BY file ORDER BY first))),
        regions AS (SELECT file, min(first)::INTEGER AS a, max("end")::INTEGER AS b FROM numbered GROUP BY file, g HAVING max(t1) - min(t0) >= 0.32::DOUBLE), """ + SPLIT.format("parts", "regions", "fr", 1.28)),
    "valley_split": sql('SELECT file, a AS first, b AS "end" FROM parts JOIN ends USING (file) WHERE ' + LEAF.format(1.0), "fr", more=ENDS + ", regions AS (SELECT file, 0 AS a, max(frame) + 1 AS b FROM fr GROUP BY file), " + SPLIT.format("parts", "regions", "fr", 1.0)),
    "nan_interp": sql(
        """SELECT file, frame, round(CASE WHEN n >= 2 THEN coalesce(CASE WHEN x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (frame - x0) / (x1 - x0) END, y0, y1) END, 6) + 0.0 AS f0 FROM (SELECT file, frame, count(f0) OVER (PARTITION BY file) AS n,
        last_value(f0 IGNORE NULLS) OVER b AS y0, last_value(CASE WHEN f0 IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS x0, first_value(f0 IGNORE NULLS) OVER a AS y1, first_value(CASE WHEN f0 IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS x1
        FROM fr WINDOW b AS (PARTITION BY file ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY file ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""", "fr"),
    "median_fill": sql("SELECT file, frame, round(coalesce(CASE WHEN f0 > 0 THEN f0 END, m, 20), 6) + 0.0 AS f0 FROM fr JOIN (SELECT file, median(CASE WHEN f0 > 0 THEN f0 END) AS m FROM fr GROUP BY file) USING (file)", "fr"),
    "trend_extrapolate": sql(
        """SELECT file, frame, round(CASE WHEN n IS NULL THEN 20 WHEN frame < p0 THEN greatest(least(v0 - (p0 - frame) * CASE WHEN n < 3 THEN 0 ELSE s0 END, 50), 8) WHEN frame > p1 THEN greatest(least(v1 + (frame - p1) * CASE WHEN n < 3 THEN 0 ELSE s1 END, 50), 8)
        ELSE coalesce(f0, y0 + (y1 - y0) * (frame - x0) / (x1 - x0)) END, 6) + 0.0 AS f0 FROM wide LEFT JOIN ends USING (file)""", "fr",
        more="""mid AS (SELECT file, frame, CASE WHEN frame * 3 >= n AND frame * 3 < 2 * n THEN f0 END AS f0 FROM (SELECT *, count(*) OVER (PARTITION BY file) AS n FROM fr)),
        rk AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY frame) AS a, row_number() OVER (PARTITION BY file ORDER BY frame DESC) AS z FROM mid WHERE f0 IS NOT NULL),
        ends AS (SELECT file, count(*) AS n, min(frame) AS p0, max(frame) AS p1, arg_min(f0, frame) AS v0, arg_max(f0, frame) AS v1, regr_slope(f0, frame) FILTER (WHERE a <= 10) AS s0, regr_slope(f0, frame) FILTER (WHERE z <= 10) AS s1 FROM rk GROUP BY file),
        wide AS (SELECT file, frame, f0, last_value(f0 IGNORE NULLS) OVER b AS y0, last_value(CASE WHEN f0 IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS x0, first_value(f0 IGNORE NULLS) OVER c AS y1, first_value(CASE WHEN f0 IS NOT NULL THEN frame END IGNORE NULLS) OVER c AS x1
            FROM mid WINDOW b AS (PARTITION BY file ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), c AS (PARTITION BY file ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""),
    "contour_resample": sql(
        """SELECT a.vec_id::VARCHAR AS file, f AS frame, round(a.v + (b.v - a.v) * (f * 63 / 99.0::DOUBLE - floor(f * 63 / 99.0::DOUBLE)), 6) + 0.0 AS v FROM (SELECT unnest(generate_series(0, 99))::INTEGER AS f) JOIN emb a ON a.i = floor(f * 63 / 99.0::DOUBLE)
        JOIN emb b ON b.vec_id = a.vec_id AND b.i = ceil(f * 63 / 99.0::DOUBLE)""", "emb"),
    "murmur_segments": sql(
        """SELECT file, round(min(t0), 6) + 0.0 AS start_s, round(arg_max(t1, first), 6) + 0.0 AS end_s FROM (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY first) AS g FROM (SELECT *, CASE WHEN t0 - lag(t1) OVER w <= 0.3 THEN 0 ELSE 1 END AS new
        FROM (SELECT file, first, first * 0.25::DOUBLE AS t0, "end" * 0.25::DOUBLE AS t1 FROM (""" + _islands("SELECT *, value / 100 > 0.15::DOUBLE * max(value / 100) OVER (PARTITION BY file) AS c FROM fr", "c") + ")) WINDOW w AS (PARTITION BY file ORDER BY first))) GROUP BY file, g HAVING arg_max(t1, first) - min(t0) >= 0.5", "fr"),
    "rms_profile": sql(
        "SELECT file, round(a, 6) + 0.0 AS onset, round(b, 6) + 0.0 AS sustain, round(c, 6) + 0.0 AS \"offset\", round(20 * log10(m + 1e-12), 6) + 0.0 AS rms_db, round(20 * log10(loudest + 1e-12), 6) + 0.0 AS peak_rms_db, " + ONSET.format(c=features.ONSETS) + """ AS profile
        FROM (SELECT file, avg(value) FILTER (WHERE t = 0) AS a, avg(value) FILTER (WHERE t = 1) AS b, avg(value) FILTER (WHERE t = 2) AS c, avg(value) AS m, max(value) AS loudest FROM (SELECT *, least(frame // greatest(1, count(*) OVER (PARTITION BY file) // 3), 2) AS t FROM fr) GROUP BY file)""", "fr"),
    "f0_stats": sql(
        """SELECT file, n AS voiced, round(m, 6) + 0.0 AS f0_median, round(s, 6) + 0.0 AS f0_std, round(g, 6) + 0.0 AS f0_range, CASE WHEN n <= 5 THEN 'insufficient data' WHEN g > m * 0.15 THEN 'modulated (' || printf('%.1f', g) || ' Hz range)' ELSE 'stable' END AS modulation
        FROM (SELECT file, count(f0) AS n, coalesce(median(f0), 0) AS m, coalesce(stddev_pop(f0), 0) AS s, coalesce(max(f0) - min(f0), 0) AS g FROM fr GROUP BY file)""", "fr"),
    "caller_rules": sql(f"SELECT id, {_caller} AS caller, {SOCIAL.format('dur', c=features.SOCIAL)} AS social, {_note('n')} AS harmonics FROM (SELECT id, value / 2 AS f0, (id % 50) / 8.0::DOUBLE AS dur, id % 40 AS n FROM iv)", "iv"),
    "clip_description": sql(
        f"""SELECT id, CASE WHEN event_type <> 'error' THEN 'This rumble (' || dur::VARCHAR || 's, F0=' || printf('%.1f', f0) || ' Hz) is consistent with ' || {_caller} || '. ' || {SOCIAL.format('dur', c=features.SOCIAL)} || ' ' || {_note('n')}
        || ' Temporal envelope: ' || event_type || '. Frequency modulation: stable.' ELSE 'The clip is too short or too quiet to analyse.' END AS analysis FROM (SELECT id, event_type, (id % 300) / 10.0::DOUBLE AS f0, (id % 50) / 8.0::DOUBLE AS dur, id % 40 AS n FROM iv)""", "iv"),
    "epoch_running_min": sql(
        "SELECT file AS run, frame AS epoch, round(min(value) OVER w, 6) + 0.0 AS best, coalesce(value < min(value) OVER (PARTITION BY file ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM fr WINDOW w AS (PARTITION BY file ORDER BY frame)", "fr"),
    "file_split": sql("SELECT file, CASE WHEN row_number() OVER (ORDER BY md5(file || '|42'), file) <= greatest(1, least(n - 1, round_even(n * 0.8::DOUBLE, 0))) THEN 'train' ELSE 'valid' END AS split FROM dur, (SELECT count(*) AS n FROM dur)", "dur"),
}

QUERIES = {
    f.__name__: f
    for f in (
        rolling_f0_std, binary_closing, binary_opening, connected_runs, fused_mask, detect_pipeline, valley_split, nan_interp, median_fill, trend_extrapolate, contour_resample, murmur_segments, rms_profile,
        f0_stats, caller_rules, clip_description, epoch_running_min, file_split,
    )
}
