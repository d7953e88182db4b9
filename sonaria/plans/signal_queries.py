"""Spectral, clustering and registry queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sonaria.functions import scalars as fn
from sonaria.operators import clustering as cl
from sonaria.operators import features, registry, separation, training
from sonaria.operators import spectral as sp
from sonaria.plans import views as v
from sonaria.plans.interval_queries import GROUPED
from sonaria.plans.views import r, sql

RES, BINS = 4.0, 33


def short_dft(spark, d):
    return v.spectra(spark, d).select("vec_id", "bin", r("re", 4).alias("re"), r("im", 4).alias("im"), r("mag", 4).alias("mag"))


def mean_spectrum(spark, d):
    s = v.spectra(spark, d).join(v.vectors(spark, d).select("vec_id", "label"), "vec_id")
    return sp.mean_spectrum(s, "label").select("label", "bin", r("mag", 4).alias("mag"))


def peak_argmax(spark, d):
    s = v.spectra(spark, d).withColumn("mag", r("mag", 4))
    return sp.peak(s, "vec_id", 2, 20)


def frequency_crop(spark, d):
    return v.vectors(spark, d).select("vec_id", F.size(F.slice("x", 1, 48)).cast("long").alias("n"), r(F.aggregate(F.slice("x", 1, 48), F.lit(0.0), lambda a, x: a + x)).alias("total"))


def db_normalise(spark, d):
    return v.elements(spark, d).select("vec_id", "i", r(fn.decibels(F.abs("v"))).alias("db"))


def sigmoid_threshold(spark, d):
    p = v.elements(spark, d).select("vec_id", "i", F.abs("v").alias("spec"), fn.sigmoid(F.col("v") * 8).alias("prob"))
    return cl.double_threshold(p, "vec_id", "prob", "spec").filter("active").groupBy("vec_id").agg(F.count("*").alias("n_active"), F.sum("i").alias("sum_i"))


def harmonic_salience(spark, d):
    c = spark.range(33).select((F.col("id") * 0.5 + 4).alias("cand"))
    s = sp.salience(v.spectra(spark, d), "vec_id", c, RES, 6, 0.7, 128.0, BINS)
    return s.select("vec_id", "cand", r("salience", 4).alias("salience"))


def harmonic_contrast(spark, d):
    c = spark.range(33).select((F.col("id") * 0.5 + 4).alias("cand"))
    s = sp.salience(v.spectra(spark, d), "vec_id", c, RES, 6, 0.7, 128.0, BINS).withColumn("salience", r("salience", 4))
    return sp.contrast(s, "vec_id", 10.0, 1.05).select("vec_id", "best_f0", "low", "high", "gate")


def _grid(spark):
    return spark.range(200).select((F.col("id") * 5 + 1).cast("double").alias("freq"))


def harmonic_comb(spark, d):
    f = spark.range(80).select((F.col("id") * 0.5 + 8).alias("f0"))
    return f.crossJoin(F.broadcast(_grid(spark))).select("f0", "freq", r(sp.comb("f0", "freq")).alias("comb"))


def _timevarying_comb(frames, grid):
    g = frames.select("file", "frame", F.col("best_f0").alias("f0")).crossJoin(F.broadcast(grid)).withColumn("comb", sp.comb("f0", "freq"))
    return g.groupBy("file", "frame").agg(r(F.sum("comb"), 4).alias("total"), r(F.max("comb"), 4).alias("most"))


def timevarying_comb(spark, d):
    """Every frame and the whole grid."""
    return _timevarying_comb(v.frames(spark, d), _grid(spark))


def _pair_bins(spark, d):
    p = v.pairs(spark, d)
    return p.select("vec_id", F.posexplode(F.arrays_zip("x", "y")).alias("i", "p")).select("vec_id", "i", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def wiener_mask(spark, d):
    p = _pair_bins(spark, d).select("vec_id", "i", F.explode(F.array(F.struct(F.lit(0).alias("caller"), F.abs("x").alias("mag")), F.struct(F.lit(1).alias("caller"), F.abs("y").alias("mag")))).alias("c")).select("vec_id", "i", "c.*")
    return sp.wiener(p.withColumn("comb", (F.col("caller") + 1) / 2), "vec_id", "i").select("vec_id", "i", "caller", r("mask").alias("mask"))


def mask_apply(spark, d):
    e = v.elements(spark, d)
    spec = e.select("vec_id", "i", F.col("v").alias("re"), (-F.col("v") / 2).alias("im"))
    mask = e.filter("i % 3 <> 0").select("vec_id", "i", F.abs("v").alias("mask"))
    return sp.apply_mask(spec, mask, "vec_id", "i").select("vec_id", "i", r("re").alias("re"), r("im").alias("im"))


def mask_upsample(spark, d):
    m = v.elements(spark, d).select("vec_id", F.col("i").alias("frame"), F.abs("v").alias("mask"))
    return sp.upsample(m, 4, "vec_id").select("vec_id", "frame", r("mask").alias("mask"))


def ideal_binary_mask(spark, d):
    p = _pair_bins(spark, d).withColumn("inside", F.col("i").between(8, 40))
    return p.groupBy("vec_id").agg(F.sum(training.binary_mask("x", "y", "inside")).alias("ones"))


def snr_mix(spark, d):
    m = v.pairs(spark, d).select("vec_id", sp.mix_at_snr("x", "y", 5.0).alias("m"))
    return m.select("vec_id", F.posexplode("m").alias("i", "v")).select("vec_id", "i", r("v").alias("v"))


def unit_power(spark, d):
    return v.vectors(spark, d).select("vec_id", F.posexplode(sp.unit_power("x")).alias("i", "v")).select("vec_id", "i", r("v").alias("v"))


def peak_limit(spark, d):
    return v.vectors(spark, d).select("vec_id", r(sp.peak_scale("x", 0.25)).alias("scale"))


def signal_power(spark, d):
    return v.vectors(spark, d).select("vec_id", r(sp.power("x"), 9).alias("power"))


def two_source_mixture(spark, d):
    p = v.pairs(spark, d).select("vec_id", F.col("x").alias("a"), F.col("y").alias("b"))
    return training.mixtures(p, 3.0, -3.0).select("vec_id", r(F.array_max("mixture")).alias("top"), r(F.aggregate("source_b", F.lit(0.0), lambda a, x: a + x)).alias("sum_b"))


def chunk_pad_slice(spark, d):
    c = v.vectors(spark, d).select("vec_id", sp.chunk("x", (F.col("vec_id") % 64).cast("int"), 32).alias("c"))
    return c.select("vec_id", F.size("c").cast("long").alias("n"), r(F.aggregate("c", F.lit(0.0), lambda a, x: a + x)).alias("total"), F.size(F.filter("c", lambda x: x == 0)).cast("long").alias("zeros"))


def rms_windows(spark, d):
    return v.vectors(spark, d).select("vec_id", F.posexplode(sp.window_rms("x", 10)).alias("k", "rms")).select("vec_id", "k", r("rms").alias("rms"))


def murmur_clips(spark, d):
    t = v.vectors(spark, d).select(F.col("vec_id").cast("string").alias("file"), F.lit(16).alias("sr"), F.col("x").alias("samples"))
    return separation.murmurs(t, share=0.8).select("file", r("start_s").alias("start_s"), r("end_s").alias("end_s"))


def region_composite(spark, d):
    """Which frames of each call pass through a mask, and which stand as they are."""
    from sonaria.operators import intervals as iv

    m = iv.overlap_members(v.intervals(spark, d).select("file", "id", "start_s", "end_s"))
    h = 3600.0
    f = m.select("file", "id", *(F.rint(F.col(c) / h).cast("long").alias(a) for c, a in (("start_s", "s"), ("end_s", "e"), ("group_start", "g0"), ("group_end", "g1"))))
    masked = F.greatest(F.least("e", "g1") - F.greatest("s", "g0"), F.lit(0))
    before, after = F.greatest(F.least("g0", "e") - F.col("s"), F.lit(0)), F.greatest(F.col("e") - F.greatest("g1", "s"), F.lit(0))
    return f.select("file", "id", masked.alias("masked"), before.alias("before"), after.alias("after"))


def spectral_centroid(spark, d):
    s = v.spectra(spark, d).withColumn("freq", F.col("bin") * RES)
    return features.centroid(s, "vec_id").select("vec_id", r("centroid", 4).alias("centroid"), r("bandwidth", 4).alias("bandwidth"))


def harmonic_count(spark, d):
    s = v.spectra(spark, d).withColumn("mag", r("mag", 4))
    return features.harmonic_count(s, "vec_id", 0.5).select("vec_id", "harmonic_count", "highest_bin")


def tolerance_anti(spark, d):
    """Candidates that are not within 3 of any known value of their label."""
    p = v.vectors(spark, d).select("vec_id", "label", r(F.col("x")[0] * 100).alias("f"))
    known = p.filter("vec_id % 10 = 0").select("label", F.col("f").alias("k"))
    return p.filter("vec_id % 10 <> 0").join(known, (F.col("f") - F.col("k") < 3.0) & (F.col("k") - F.col("f") < 3.0) & (p.label == known.label), "left_anti").select("vec_id", "f")


def _positional_assign(vectors, customers):
    """The n-th candidate of a label for its n-th customer; without one left, the first."""
    p = vectors.select("label", F.col("vec_id").alias("cand"))
    w = Window.partitionBy("label")
    c = p.withColumn("k", F.row_number().over(w.orderBy("cand")))
    need = customers.select(F.pmod("c_custkey", F.lit(10)).cast("int").alias("label"), "c_custkey")
    need = need.withColumn("k", F.row_number().over(w.orderBy("c_custkey")))
    first = c.filter("k = 1").select("label", F.col("cand").alias("fallback"))
    return need.join(c, ["label", "k"], "left").join(first, "label", "left").select("c_custkey", F.coalesce("cand", "fallback").alias("cand"))


def positional_assign(spark, d):
    """Every candidate and customer."""
    return _positional_assign(v.vectors(spark, d), v.table(spark, d, "customer"))


def cluster_centroids(spark, d):
    c = cl.centroids(v.vectors(spark, d), "label", "x")
    return c.select("label", "n", F.posexplode("centroid").alias("i", "v")).select("label", "n", "i", r("v").alias("v"))


def centroid_merge_cc(spark, d):
    c = cl.centroids(v.vectors(spark, d), "label", "x")
    return cl.merged_labels(c, "label", 0.19).select("label", "merged")


def knn_label(spark, d):
    t = v.vectors(spark, d)
    return cl.knn_labels(t.select("vec_id", "x"), t.filter("vec_id % 4 = 0"), "vec_id", "x", "label")


def dc_loss_gram(spark, d):
    return cl.clustering_loss(v.vectors(spark, d), "vec_id", "x", "label").select(r("loss").alias("loss"))


def bce_logits(spark, d):
    e = v.elements(spark, d).withColumn("y", (F.col("i") % 2).cast("double"))
    return e.groupBy("label").agg(r(F.avg(cl.bce("v", "y"))).alias("loss"))


def pair_sampling_hash(spark, d):
    return training.file_pairs(v.vectors(spark, d), "vec_id", "label", 40)


def labels_without_noise(spark, d):
    return v.vectors(spark, d).select((F.col("label") - 1).alias("label")).filter("label <> -1").distinct()


def hdbscan_cluster(spark, d):
    return cl.cluster(v.vectors(spark, d).select("vec_id", "x"), "vec_id", "x", most=5000, min_cluster=8, min_samples=4)


def multipitch_iterative(spark, d):
    from sonaria.functions import kernels

    s = v.spectra(spark, d).groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "mag"))), lambda x: x["mag"]).alias("m"))

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            out = [(i, k, f) for i, m in zip(pdf["vec_id"], pdf["m"], strict=True) for k, f in enumerate(kernels.multipitch(np.asarray(m), RES, 4))]
            yield pd.DataFrame(out, columns=["vec_id", "k", "f0"]).astype({"vec_id": "int64", "k": "int32", "f0": "float64"})

    return s.mapInPandas(run, "vec_id long, k int, f0 double")


def _clips(spark, d):
    o = v.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("clip_id"), F.concat(F.lit("rec "), F.col("o_custkey").cast("string"), F.lit(".wav")).alias("parent_wav"), registry.caller_id((F.col("o_orderkey") % 3).cast("int")).alias("elephant_id"), (F.col("o_orderkey") % 97 / 4).alias("start_time"), F.col("o_orderpriority").alias("clip_type"))


def registry_register(spark, d):
    n = registry.numbered(_clips(spark, d).withColumnRenamed("clip_id", "order_id"), 1000, "elephant_id", "start_time", "order_id")
    return n.select("order_id", "parent_wav", "clip_id")


def registry_new_ids(spark, d):
    known = spark.createDataFrame([(registry.ID_PREFIX + "A", "Ann")], "elephant_id string, nickname string")
    return registry.missing_individuals(known, _clips(spark, d))


def registry_dump(spark, d):
    return _clips(spark, d).orderBy("elephant_id", "start_time").select("elephant_id", "clip_id", "parent_wav", r("start_time").alias("start_time"))


def registry_rename(spark, d):
    c = v.table(spark, d, "customer")
    people = c.select(F.col("c_name").alias("elephant_id"), F.col("c_mktsegment").alias("nickname"))
    names = c.filter("c_custkey % 9 = 0").select(F.col("c_name").alias("elephant_id"), F.concat(F.lit("N"), F.col("c_custkey").cast("string")).alias("nickname"))
    return registry.renamed(people, names)


def clips_for_parent(spark, d):
    return _clips(spark, d).filter("parent_wav = 'rec 70.wav'").orderBy("elephant_id", "start_time").select("clip_id", "elephant_id", r("start_time").alias("start_time"))


def _clip_lookup(spark, d, clips):
    on_disk = v.table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("rec "), F.col("c_custkey").cast("string"), F.lit(".wav")).alias("parent_wav"))
    return clips.join(on_disk, "parent_wav", "left_semi").select("clip_id", "parent_wav")


def clip_lookup(spark, d):
    """Every clip."""
    return _clip_lookup(spark, d, _clips(spark, d))


def _caller_nesting_json(clips):
    c = clips.select("clip_id", "parent_wav", "elephant_id", F.col("start_time").cast("long").alias("start_time"), "clip_type")
    return registry.payload(c).select("parent_wav", "json")


def caller_nesting_json(spark, d):
    """Every clip."""
    return _caller_nesting_json(_clips(spark, d))


def dominant_type(spark, d):
    e = v.table(spark, d, "events")
    return registry.dominant_type(e, "user_id", "event_type", "event_id").select("user_id", "event_type", "n")


def overview_counts(spark, d):
    return _clips(spark, d).groupBy("parent_wav").agg(F.count("*").alias("clips"), F.count_distinct("elephant_id").alias("callers"))


def clip_filename(spark, d):
    c = _clips(spark, d).withColumn("parent_wav", F.concat(F.lit("a long name of a recording "), "parent_wav"))
    return c.withColumns({"k": F.col("clip_id") % 4, "n": F.col("clip_id") % 4 + 1}).select("clip_id", registry.clip_name("parent_wav", "elephant_id", "clip_type", "start_time").alias("name"), registry.output_name("k", "n").alias("track"))


def sql_functions(spark, d):
    fn.register(spark)
    v.elements(spark, d).createOrReplaceTempView("sonaria_elements")
    return spark.sql("SELECT vec_id, i, round(normal_db(abs(v)), 6) + 0.0D AS db, round(logistic(v), 6) + 0.0D AS p, round(temporal_iou(0, 1, v, v + 1), 6) + 0.0D AS iou FROM sonaria_elements")


SAL = "sal AS (SELECT vec_id, cand, sum(mag * power(0.7::DOUBLE, h - 1)) AS salience FROM spec JOIN (SELECT cand, h FROM (SELECT unnest(generate_series(0, 32)) * 0.5::DOUBLE + 4 AS cand), (SELECT unnest(generate_series(1, 6)) AS h)) ON bin = round_even(cand * h / 4, 0) AND cand * h <= 128 AND round_even(cand * h / 4, 0) < 33 GROUP BY vec_id, cand)"
COMB = "CASE WHEN floor(1000 / f0) >= 1 THEN exp(-0.5::DOUBLE * power((freq - least(greatest(round_even(freq / f0, 0), 1), floor(1000 / f0)) * f0) / 2, 2)) ELSE 0 END"
GRID = "grid AS (SELECT (unnest(generate_series(0, 199)) * 5 + 1)::DOUBLE AS freq)"
PSUM = "pow2 AS (SELECT vec_id, sum(x * x) / 64 + 1e-12 AS ps, sum(y * y) / 64 + 1e-12 AS pn FROM pr GROUP BY vec_id)"
CLIPS = "clips AS (SELECT o_orderkey AS clip_id, 'rec ' || o_custkey || '.wav' AS parent_wav, 'Elephant_' || chr((65 + o_orderkey % 3)::INTEGER) AS elephant_id, (o_orderkey % 97) / 4.0::DOUBLE AS start_time, o_orderpriority AS clip_type FROM orders)"
DB = "(greatest(least(20 * log10(greatest(abs(v), 1e-5)), 0), -80) + 80) / 80"

SQL = {
    "short_dft": sql("SELECT vec_id, bin, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im, round(mag, 4) + 0.0 AS mag FROM spec", "spec"),
    "mean_spectrum": sql("SELECT label, bin, round(avg(mag), 4) + 0.0 AS mag FROM spec JOIN embeddings USING (vec_id) GROUP BY label, bin", "spec"),
    "peak_argmax": sql("SELECT vec_id, bin, m AS mag FROM (SELECT vec_id, bin, round(mag, 4) + 0.0 AS m FROM spec WHERE bin BETWEEN 2 AND 20) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY m DESC, bin) = 1", "spec"),
    "frequency_crop": sql("SELECT vec_id, count(*) AS n, round(sum(v), 6) + 0.0 AS total FROM emb WHERE i < 48 GROUP BY vec_id", "emb"),
    "db_normalise": sql(f"SELECT vec_id, i, round({DB}, 6) + 0.0 AS db FROM emb", "emb"),
    "sigmoid_threshold": sql("SELECT vec_id, count(*) AS n_active, sum(i)::BIGINT AS sum_i FROM (SELECT *, max(abs(v)) OVER (PARTITION BY vec_id) AS top FROM emb) WHERE top >= 1e-6 AND 1 / (1 + exp(-v * 8)) > 0.5 AND abs(v) > top - 10.0::DOUBLE / 80 GROUP BY vec_id", "emb"),
    "harmonic_salience": sql("SELECT vec_id, cand, round(salience, 4) + 0.0 AS salience FROM sal", "spec", more=SAL),
    "harmonic_contrast": sql("SELECT vec_id, arg_max(cand, (s, -cand)) FILTER (WHERE cand <= 10) AS best_f0, max(s) FILTER (WHERE cand <= 10) AS low, max(s) FILTER (WHERE cand > 10) AS high, max(s) FILTER (WHERE cand <= 10) > 1.05::DOUBLE * max(s) FILTER (WHERE cand > 10) AS gate FROM (SELECT vec_id, cand, round(salience, 4) + 0.0 AS s FROM sal) GROUP BY vec_id", "spec", more=SAL),
    "harmonic_comb": sql(f"SELECT f0, freq, round({COMB}, 6) + 0.0 AS comb FROM (SELECT unnest(generate_series(0, 79)) * 0.5::DOUBLE + 8 AS f0), grid", more=GRID),
    "timevarying_comb": sql(f"SELECT file, frame, round(sum({COMB}), 4) + 0.0 AS total, round(max({COMB}), 4) + 0.0 AS most FROM (SELECT file, frame, best_f0 AS f0 FROM fr), grid GROUP BY file, frame", "fr", more=GRID),
    "wiener_mask": sql("SELECT vec_id, i, caller, round(CASE caller WHEN 0 THEN abs(x) * 0.5::DOUBLE ELSE abs(y) END / (abs(x) * 0.5::DOUBLE + abs(y) + 1e-8), 6) + 0.0 AS mask FROM pr, (SELECT unnest([0, 1])::INTEGER AS caller)", "pr"),
    "mask_apply": sql("SELECT vec_id, i, round(CASE WHEN i % 3 <> 0 THEN v * abs(v) ELSE 0 END, 6) + 0.0 AS re, round(CASE WHEN i % 3 <> 0 THEN -v / 2 * abs(v) ELSE 0 END, 6) + 0.0 AS im FROM emb", "emb"),
    "mask_upsample": sql("SELECT a.vec_id, f AS frame, round(abs(a.v) + (abs(b.v) - abs(a.v)) * (f * 63 / 255.0::DOUBLE - floor(f * 63 / 255.0::DOUBLE)), 6) + 0.0 AS mask FROM (SELECT unnest(generate_series(0, 255))::INTEGER AS f) JOIN emb a ON a.i = floor(f * 63 / 255.0::DOUBLE) JOIN emb b ON b.vec_id = a.vec_id AND b.i = ceil(f * 63 / 255.0::DOUBLE)", "emb"),
    "ideal_binary_mask": sql("SELECT vec_id, count(*) FILTER (WHERE x >= y AND i BETWEEN 8 AND 40) AS ones FROM pr GROUP BY vec_id", "pr"),
    "snr_mix": sql("SELECT vec_id, i, round(x + y * sqrt(ps / power(10, 0.5::DOUBLE) / pn), 6) + 0.0 AS v FROM pr JOIN pow2 USING (vec_id)", "pr", more=PSUM),
    "unit_power": sql("SELECT vec_id, i, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id) / 64 + 1e-12), 6) + 0.0 AS v FROM emb", "emb"),
    "peak_limit": sql("SELECT vec_id, round(CASE WHEN max(abs(v)) > 0.25 THEN 0.25::DOUBLE / max(abs(v)) ELSE 1 END, 6) + 0.0 AS scale FROM emb GROUP BY vec_id", "emb"),
    "signal_power": sql("SELECT vec_id, round(sum(v * v) / 64 + 1e-12, 9) + 0.0 AS power FROM emb GROUP BY vec_id", "emb"),
    "two_source_mixture": sql(
        """SELECT vec_id, round(max((a + b) * k), 6) + 0.0 AS top, round(sum(b * k), 6) + 0.0 AS sum_b FROM (SELECT *, CASE WHEN max(abs(a + b)) OVER (PARTITION BY vec_id) > 0.98 THEN 0.98::DOUBLE / max(abs(a + b)) OVER (PARTITION BY vec_id) ELSE 1 END AS k FROM
        (SELECT vec_id, i, x / sqrt(ps) * power(10, 0.15::DOUBLE) AS a, y / sqrt(pn) * power(10, -0.15::DOUBLE) AS b FROM pr JOIN pow2 USING (vec_id))) GROUP BY vec_id""", "pr", more=PSUM),
    "chunk_pad_slice": sql("SELECT vec_id, 32::BIGINT AS n, round(coalesce(sum(v) FILTER (WHERE i >= vec_id % 64 AND i < vec_id % 64 + 32), 0), 6) + 0.0 AS total, 32 - least(32, 64 - vec_id % 64) + count(*) FILTER (WHERE v = 0 AND i >= vec_id % 64 AND i < vec_id % 64 + 32) AS zeros FROM emb GROUP BY vec_id", "emb"),
    "rms_windows": sql("SELECT vec_id, i // 10 AS k, round(sqrt(sum(v * v) / 10 + 1e-12), 6) + 0.0 AS rms FROM emb WHERE i < 60 GROUP BY vec_id, i // 10", "emb"),
    "murmur_clips": sql(
        """SELECT vec_id::VARCHAR AS file, round(min(t0), 6) + 0.0 AS start_s, round(max(t1), 6) + 0.0 AS end_s FROM (SELECT *, sum(new) OVER (PARTITION BY vec_id ORDER BY t0) AS g FROM (SELECT *, CASE WHEN t0 - lag(t1) OVER (PARTITION BY vec_id ORDER BY t0) <= 0.3 THEN 0 ELSE 1 END AS new FROM
        (SELECT vec_id, min(k) * 0.25::DOUBLE AS t0, (max(k) + 1) * 0.25::DOUBLE AS t1 FROM (SELECT *, k - row_number() OVER (PARTITION BY vec_id ORDER BY k) AS g FROM (SELECT *, max(rms) OVER (PARTITION BY vec_id) AS top FROM
        (SELECT vec_id, i // 4 AS k, sqrt(sum(v * v) / 4 + 1e-12) AS rms FROM emb GROUP BY vec_id, i // 4)) WHERE rms > 0.8::DOUBLE * top) GROUP BY vec_id, g))) GROUP BY vec_id, g HAVING max(t1) - min(t0) >= 0.3""", "emb"),
    "spectral_centroid": sql("SELECT vec_id, round(c, 4) + 0.0 AS centroid, round(sqrt(greatest(q - c * c, 0)), 4) + 0.0 AS bandwidth FROM (SELECT vec_id, sum(mag * bin * 4) / sum(mag) AS c, sum(mag * bin * 4 * bin * 4) / sum(mag) AS q FROM spec GROUP BY vec_id)", "spec"),
    "harmonic_count": sql(
        """SELECT vec_id, count(*) FILTER (WHERE is_on AND NOT prev) AS harmonic_count, CASE WHEN count(*) FILTER (WHERE is_on AND NOT prev) > 0 THEN max(bin) FILTER (WHERE is_on) END AS highest_bin FROM (SELECT *, lag(is_on, 1, true) OVER (PARTITION BY vec_id ORDER BY bin) AS prev FROM
        (SELECT vec_id, bin, m > 0.5::DOUBLE * max(m) OVER (PARTITION BY vec_id) AS is_on FROM (SELECT vec_id, bin, round(mag, 4) + 0.0 AS m FROM spec))) GROUP BY vec_id""", "spec"),
    "tolerance_anti": sql("SELECT vec_id, f FROM p a WHERE vec_id % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.vec_id % 10 = 0 AND b.label = a.label AND a.f - b.f < 3.0 AND b.f - a.f < 3.0)", "emb", more="p AS (SELECT vec_id, label, round(v * 100, 6) + 0.0 AS f FROM emb WHERE i = 0)"),
    "positional_assign": """WITH c AS (SELECT label, vec_id AS cand, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings), n AS (SELECT c_custkey, (c_custkey % 10)::INTEGER AS label,
        row_number() OVER (PARTITION BY c_custkey % 10 ORDER BY c_custkey) AS k FROM customer) SELECT c_custkey, coalesce(c.cand, f.cand) AS cand FROM n LEFT JOIN c USING (label, k) LEFT JOIN (SELECT label, cand FROM c WHERE k = 1) f USING (label)""",
    "cluster_centroids": sql("SELECT label, count(*) AS n, i, round(avg(v), 6) + 0.0 AS v FROM emb GROUP BY label, i", "emb"),
    "centroid_merge_cc": sql(
        "SELECT label, dense_rank() OVER (ORDER BY root)::INTEGER - 1 AS merged FROM (SELECT a AS label, min(b) AS root FROM reach GROUP BY a)", "emb",
        more="""cen AS (SELECT label, i, avg(v) AS v FROM emb GROUP BY label, i), near AS (SELECT a.label AS a, b.label AS b FROM cen a JOIN cen b USING (i) GROUP BY 1, 2 HAVING sqrt(sum((a.v - b.v) * (a.v - b.v))) < 0.19),
        reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a)"""),
    "knn_label": sql(
        """SELECT vec_id, label FROM (SELECT p AS vec_id, label, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY c DESC, q) AS k FROM sims) WHERE k <= 5 GROUP BY p, label) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) = 1""",
        more="""norms AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), sims AS (SELECT a.vec_id AS p, b.vec_id AS q, b.label, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)), 12) AS c
        FROM norms a, norms b WHERE b.vec_id % 4 = 0)"""),
    "dc_loss_gram": sql(
        "SELECT round((vv - 2 * vy + yy) / (vv + yy + 1e-8), 6) + 0.0 AS loss FROM (SELECT sum(s * s) AS vv FROM (SELECT sum(a.v * b.v) AS s FROM emb a JOIN emb b USING (vec_id) GROUP BY a.i, b.i)), (SELECT sum(s * s) AS vy FROM (SELECT sum(v) AS s FROM emb GROUP BY i, label)), (SELECT sum(s * s)::DOUBLE AS yy FROM (SELECT count(*) AS s FROM embeddings GROUP BY label))", "emb"),
    "bce_logits": sql("SELECT label, round(avg(greatest(v, 0) - v * (i % 2) + ln(1 + exp(-abs(v)))), 6) + 0.0 AS loss FROM emb GROUP BY label", "emb"),
    "pair_sampling_hash": """WITH dr AS (SELECT unnest(generate_series(0, 39)) AS draw), g AS (SELECT draw, g, side FROM (SELECT draw, g, row_number() OVER (PARTITION BY draw ORDER BY md5('0g|' || draw || '|' || g), g) AS side FROM dr, (SELECT DISTINCT label AS g FROM embeddings)) WHERE side <= 2),
        o AS (SELECT draw, side, vec_id FROM g JOIN embeddings ON label = g QUALIFY row_number() OVER (PARTITION BY draw, g ORDER BY md5('0i|' || draw || '|' || vec_id), vec_id) = 1) SELECT draw, max(vec_id) FILTER (WHERE side = 1) AS a, max(vec_id) FILTER (WHERE side = 2) AS b FROM o GROUP BY draw""",
    "labels_without_noise": "SELECT DISTINCT label - 1 AS label FROM embeddings WHERE label <> 0",
    "registry_register": sql("SELECT clip_id AS order_id, parent_wav, 1000 + row_number() OVER (ORDER BY parent_wav, elephant_id, start_time, clip_id) AS clip_id FROM clips", more=CLIPS),
    "registry_new_ids": sql("SELECT DISTINCT elephant_id, '' AS nickname FROM clips WHERE elephant_id <> 'Elephant_A'", more=CLIPS),
    "registry_dump": sql("SELECT elephant_id, clip_id, parent_wav, round(start_time, 6) + 0.0 AS start_time FROM clips", more=CLIPS),
    "registry_rename": "SELECT c_name AS elephant_id, CASE WHEN c_custkey % 9 = 0 THEN 'N' || c_custkey ELSE c_mktsegment END AS nickname FROM customer",
    "clips_for_parent": sql("SELECT clip_id, elephant_id, round(start_time, 6) + 0.0 AS start_time FROM clips WHERE parent_wav = 'rec 70.wav'", more=CLIPS),
    "clip_lookup": sql("SELECT clip_id, parent_wav FROM clips WHERE parent_wav IN (SELECT 'rec ' || c_custkey || '.wav' FROM customer WHERE c_custkey % 2 = 0)", more=CLIPS),
    "caller_nesting_json": sql(
        """SELECT parent_wav, '{"parent_wav":"' || parent_wav || '","detected_callers":' || count(*) || ',"callers":[' || string_agg('{"elephant_id":"' || elephant_id || '","clips":[' || j || ']}', ',' ORDER BY elephant_id) || '],"clip_count":' || sum(n)::BIGINT || '}' AS json FROM
        (SELECT parent_wav, elephant_id, count(*) AS n, string_agg('{"clip_id":' || clip_id || ',"start_time":' || floor(start_time)::BIGINT || ',"clip_type":"' || clip_type || '"}', ',' ORDER BY floor(start_time), clip_id) AS j FROM clips GROUP BY parent_wav, elephant_id) GROUP BY parent_wav""", more=CLIPS),
    "dominant_type": "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY user_id, event_type) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1",
    "overview_counts": sql("SELECT parent_wav, count(*) AS clips, count(DISTINCT elephant_id) AS callers FROM clips GROUP BY parent_wav", more=CLIPS),
    "clip_filename": sql("SELECT clip_id, substr(replace(replace('a long name of a recording ' || parent_wav, '.wav', ''), ' ', '_'), 1, 30) || '_' || elephant_id || '_' || clip_type || '_T' || t || '.wav' AS name, CASE WHEN clip_id % 4 = 0 THEN 'cleaned_output.wav' ELSE 'cleaned_caller_' || (clip_id % 4 + 1) || '.wav' END AS track FROM (SELECT *, CASE clip_id % 97 % 4 WHEN 1 THEN (floor(start_time)::BIGINT)::VARCHAR || '.3' WHEN 3 THEN (floor(start_time)::BIGINT)::VARCHAR || '.8' ELSE printf('%.1f', start_time) END AS t FROM clips)", more=CLIPS),
    "sql_functions": sql(f"SELECT vec_id, i, round({DB}, 6) + 0.0 AS db, round(1 / (1 + exp(-v)), 6) + 0.0 AS p, round(CASE WHEN 2 - greatest(least(1, v + 1) - greatest(0, v), 0) > 0 THEN greatest(least(1, v + 1) - greatest(0, v), 0) / (2 - greatest(least(1, v + 1) - greatest(0, v), 0)) ELSE 0 END, 6) + 0.0 AS iou FROM emb", "emb"),
    "region_composite": sql(
        "SELECT file, id, greatest(least(e, g1) - greatest(s, g0), 0) AS masked, greatest(least(g0, e) - s, 0) AS before, greatest(e - greatest(g1, s), 0) AS after FROM (SELECT file, id, round_even(start_s / 3600, 0)::BIGINT AS s, round_even(end_s / 3600, 0)::BIGINT AS e, round_even(group_start / 3600, 0)::BIGINT AS g0, round_even(group_end / 3600, 0)::BIGINT AS g1 FROM members)", "iv",
        more=GROUPED),
}

QUERIES = {
    f.__name__: f
    for f in (
        short_dft, mean_spectrum, peak_argmax, frequency_crop, db_normalise, sigmoid_threshold, harmonic_salience, harmonic_contrast, harmonic_comb, timevarying_comb, wiener_mask, mask_apply, mask_upsample,
        ideal_binary_mask, snr_mix, unit_power, peak_limit, signal_power, two_source_mixture, chunk_pad_slice, rms_windows, murmur_clips, region_composite, spectral_centroid, harmonic_count, tolerance_anti, positional_assign,
        cluster_centroids, centroid_merge_cc, knn_label, dc_loss_gram, bce_logits, pair_sampling_hash, labels_without_noise, hdbscan_cluster, multipitch_iterative, registry_register, registry_new_ids,
        registry_dump, registry_rename, clips_for_parent, clip_lookup, caller_nesting_json, dominant_type, overview_counts, clip_filename, sql_functions,
    )
}
