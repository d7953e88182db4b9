import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonaria.functions import kernels as k
from sonaria.operators import clustering as cl
from sonaria.operators import features, separation, training
from sonaria.operators import spectral as sp
from tests.test_frames import tone


def test_transform_round_trip():
    y = np.random.default_rng(1).standard_normal(9000)
    for n, hop in ((1024, 256), (8192, 1024)):
        assert np.allclose(k.istft(k.stft(y, n, hop), hop, len(y)), y, atol=1e-6)


def test_pitch_of_tones():
    for f in (12.0, 20.0, 33.0):
        f0, p = k.pyin(tone(f, 3, vibrato=0.0), 4000, 8, 50, 2048, 256)
        mid = f0[8:-8]
        assert np.isfinite(mid).mean() > 0.9 and abs(np.nanmedian(mid) - f) < 0.5 and p[8:-8].mean() > 0.5
    noise = np.random.default_rng(0).standard_normal(12000)
    assert k.pyin(noise, 4000, 8, 50, 2048, 256)[1].mean() < 0.3


def test_long_mask_stretches(spark):
    """Positions in a long mask pass 31 bits; no join sends the stretched grid about."""
    n = 24_000
    out = sp.upsample(spark.range(n).select(F.lit(7).alias("key"), F.col("id").cast("int").alias("frame"), (F.col("id") % 10).cast("double").alias("mask")), 4, "key")
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.orderBy("frame").toPandas()
    assert list(got.frame) == list(range(4 * n)) and set(got.key) == {7}
    assert np.allclose(got["mask"], np.interp(np.arange(4 * n) * (n - 1) / (4 * n - 1), np.arange(n), np.arange(n) % 10))


def test_masks_of_bins_stretch_apart(spark):
    rows = [("a", 0, 0, 1.0), ("a", 1, 0, 2.0), ("a", 0, 1, 5.0), ("a", 1, 1, 5.0), ("b", 0, 0, 4.0)]
    out = sp.upsample(spark.createDataFrame(rows, "file string, frame int, bin int, mask double"), 2, "file")
    got = sorted((x.file, x.bin, x.frame, round(x["mask"], 6)) for x in out.collect())
    assert got == [("a", 0, 0, 1.0), ("a", 0, 1, 1.333333), ("a", 0, 2, 1.666667), ("a", 0, 3, 2.0), *(("a", 1, f, 5.0) for f in range(4)), ("b", 0, 0, 4.0), ("b", 0, 1, 4.0)]


def test_assignment():
    r = np.random.default_rng(2)
    for n, m in itertools.product(range(1, 6), range(1, 6)):
        c = r.random((n, m))
        rows, cols = k.assign(c)
        small, large = (n, m) if n <= m else (m, n)
        d = c if n <= m else c.T
        best = min(sum(d[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert len(rows) == small and len(set(cols)) == small and c[rows, cols].sum() == pytest.approx(best)


def test_comb_is_the_largest_gaussian(spark):
    freqs = np.arange(0, 2000, 3.7)
    for f0 in (8.0, 21.3, 50.0, 1500.0):
        want = np.max([np.zeros(len(freqs))] + [np.exp(-0.5 * ((freqs - h * f0) / 2) ** 2) for h in range(1, int(1000 / f0) + 1)], axis=0)
        assert np.allclose(k.comb(np.array([f0]), freqs)[0], want)
        df = spark.createDataFrame([(f0, float(f)) for f in freqs], "f0 double, freq double")
        assert np.allclose([x.c for x in df.select(sp.comb("f0", "freq").alias("c")).collect()], want)


def test_multipitch_finds_both():
    mag = np.abs(k.stft(tone(14, 4, vibrato=0) + tone(23, 4, vibrato=0), 8192, 256)).mean(0)
    found = k.multipitch(mag, 4000 / 8192, 2)
    assert sorted(round(f) for f in found) == [14, 23]
    assert k.multipitch(np.zeros(4097), 4000 / 8192, 2) == []


def test_snr(spark):
    r = np.random.default_rng(3)
    a, b = r.standard_normal(4000), r.standard_normal(4000) * 7
    for db in (-5.0, 0.0, 5.0):
        df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>").select(sp.mix_at_snr("a", "b", db).alias("m"))
        m = np.array(df.first().m)
        assert 10 * np.log10((a**2).mean() / ((m - a) ** 2).mean()) == pytest.approx(db, abs=1e-6)
    assert spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(sp.mix_at_snr("a", "b", 0.0).alias("m")).first().m is None


def test_packed_transform(spark):
    y = np.random.default_rng(4).standard_normal(6000).astype(np.float32)
    audio = spark.createDataFrame([("a", 4000, y.tolist())], "file string, sr int, samples array<float>")
    back = sp.istft(sp.stft(audio, 1024, 256), 256, audio.select("file", F.size("samples").alias("length"))).first().samples
    assert np.allclose(back, y, atol=1e-3)


def test_wiener_masks_share_a_cell(spark):
    df = spark.range(40).select((F.col("id") % 10).alias("bin"), F.rand(1).alias("comb"), F.rand(2).alias("mag"))
    s = sp.wiener(df, "bin").groupBy("bin").agg(F.sum("mask").alias("s")).collect()
    assert all(0 < x.s <= 1 for x in s)


def test_murmurs_and_splice(spark):
    r = np.random.default_rng(5)
    y = np.zeros(40000)
    y[8000:16000], y[24000:32000] = r.standard_normal(8000) * 0.5, r.standard_normal(8000) * 0.3
    t = spark.createDataFrame([("x y.wav", 4000, 1, y.tolist()), ("quiet.wav", 4000, 0, [0.0] * 8000), ("short.wav", 4000, 0, [0.1] * 100)], "file string, sr int, caller int, samples array<float>")
    assert sorted((m.file, m.start_s, m.end_s) for m in separation.murmurs(t).collect()) == [("quiet.wav", 0.0, 2.0), ("short.wav", 0.0, 0.025), ("x y.wav", 2.0, 4.0), ("x y.wav", 6.0, 8.0)]
    clips = separation.splice(t).orderBy("parent_wav", "start_time").collect()
    assert [(c.parent_wav, c.elephant_id, c.start_time, len(c.samples)) for c in clips] == [("quiet.wav", "Elephant_A", 0.0, 8000), ("short.wav", "Elephant_A", 0.0, 100), ("x y.wav", "Elephant_B", 2.0, 8000), ("x y.wav", "Elephant_B", 6.0, 8000)]
    assert clips[2].file_path == "x_y_Elephant_B_rumble_T2.0.wav"


def test_separation(spark):
    n = 4000 * 10
    a, b = np.zeros(n), np.zeros(n)
    a[4000:24000], b[16000:36000] = tone(14, 5, vibrato=0.0), tone(23, 5, vibrato=0.0)
    audio = spark.createDataFrame([("m.wav", 4000, (a + b).tolist()), ("alone.wav", 4000, a.tolist())], "file string, sr int, samples array<float>")
    calls = spark.createDataFrame([("m.wav", 1, 1.0, 6.0), ("m.wav", 2, 4.0, 9.0), ("alone.wav", 3, 1.0, 6.0)], "file string, id long, start_s double, end_s double")
    got = {(x.file, x.caller): x for x in separation.separate(audio, calls).collect()}
    assert set(got) == {("m.wav", 0), ("m.wav", 1), ("alone.wav", 0)}
    assert abs(got["m.wav", 0].f0 - 14) < 1 and abs(got["m.wav", 1].f0 - 23) < 1 and got["m.wav", 0].callers == 2
    both = slice(17000, 23000)
    for c, own, other in ((0, a, b), (1, b, a)):
        y = np.array(got["m.wav", c].samples)[both]
        assert np.corrcoef(y, own[both])[0, 1] > 0.8 > abs(np.corrcoef(y, other[both])[0, 1])
    assert np.allclose(got["alone.wav", 0].samples, a, atol=1e-5)


def test_cleaning_with_a_mask(spark):
    y = np.random.default_rng(6).standard_normal(12000)
    audio = spark.createDataFrame([("a", 4000, y.tolist())], "file string, sr int, samples array<float>")
    out = separation.clean(audio, lambda s: np.ones((60, 4097))).first()
    assert np.allclose(out.samples, y, atol=1e-3)
    assert np.allclose(separation.clean(audio, lambda s: np.zeros((60, 10))).first().samples, 0)


def test_features(spark):
    y = tone(20, 3)
    audio = spark.createDataFrame([("call", 4000, y.tolist()), ("silent", 4000, [0.0] * 4000), ("none", None, None)], "file string, sr int, samples array<float>")
    got = {x.file: x for x in features.describe(features.extract(audio).withColumn("clip_type", F.lit("rumble"))).collect()}
    assert abs(got["call"].fundamental_hz - 20) < 1.5 and got["call"].is_valid and got["call"].harmonic_count > 3
    assert got["call"].analysis.startswith("This rumble (3.0s, F0=") and not got["silent"].is_valid and got["none"].onset_profile == "silent"

    def ask(prompts):
        raise OSError("no network")

    assert features.describe(features.extract(audio).withColumn("clip_type", F.lit("rumble")), ask).filter("file = 'call'").first().analysis == got["call"].analysis


def test_clusters(spark):
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(0, 0.05, (60, 3)) + [1, 0, 0], r.normal(0, 0.05, (50, 3)) + [0, 1, 0], r.uniform(-3, 3, (10, 3))])
    y = k.hdbscan(x, 20, 5)
    assert len(set(y[:60]) - {-1}) == 1 and len(set(y[60:110]) - {-1}) == 1 and y[0] != y[60] and (y[110:] == -1).sum() >= 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "bin_id long, vec array<double>")
    src, info = cl.segment(df, min_active=50, min_cluster_bins=20, min_cluster=20, min_samples=5)
    assert info["sources"] == 2 and src.filter("bin_id < 50").select("source").distinct().count() == 1
    some, info = cl.segment(df, min_active=50, min_cluster_bins=20, min_cluster=20, min_samples=5, most=90)
    assert info["sources"] == 2 and some.count() >= 100
    assert cl.segment(df, min_active=500)[1]["reason"] == "too_few_active_bins"


def test_gram_loss_is_the_affinity_loss(spark):
    r = np.random.default_rng(8)
    v, y = r.standard_normal((12, 4)), r.integers(0, 3, 12)
    df = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(v, y, strict=True))], "id long, v array<double>, y int")
    one = np.eye(3)[y]
    want = ((v @ v.T - one @ one.T) ** 2).sum() / (((v @ v.T) ** 2).sum() + ((one @ one.T) ** 2).sum() + 1e-8)
    assert cl.clustering_loss(df, "id", "v", "y").first().loss == pytest.approx(want)


def test_mask_model(spark, tmp_path):
    r = np.random.default_rng(9)
    y = r.standard_normal(4000 * 12) * 0.02
    y[4000 * 3 : 4000 * 8] += tone(20, 5)
    audio = spark.createDataFrame([("a", 4000, y.tolist())], "file string, sr int, samples array<float>")
    calls = spark.createDataFrame([("a", 1, 3.0, 8.0, 10.0, 250.0)], "file string, id long, start_s double, end_s double, low_hz double, high_hz double")
    bins = training.bin_table(audio, calls).filter("bin < 700")
    m = training.LogisticMask(15).fit(bins)
    p = m.transform(bins).groupBy("y").agg(F.avg("prob").alias("p")).collect()
    assert {x.y: x.p for x in p}[1.0] > 1.5 * {x.y: x.p for x in p}[0.0]
    m.save(spark, f"{tmp_path}/m")
    assert training.LogisticMask.load(spark, f"{tmp_path}/none", f"{tmp_path}/m").weights == m.weights
    assert m.numpy()(y).shape == (4 * 47, 2048)
    with pytest.raises(FileNotFoundError):
        training.LogisticMask.load(spark, f"{tmp_path}/none")


def test_training_samples(spark):
    calls = spark.createDataFrame([("a", 1, 3.0, 5.0, None, None), ("a", 2, 6.0, 7.0, 12.0, 90.0)], "file string, id long, start_s double, end_s double, low_hz double, high_hz double")
    audio = spark.createDataFrame([("a", 4000, [0.5] * 40000)], "file string, sr int, samples array<float>")
    d = spark.createDataFrame([("a", 10.0)], "file string, duration double")
    got = {x.id: x for x in training.samples(calls, audio, d).collect()}
    assert len(got[1].samples) == 32000 and [(b.rel_start, b.rel_end) for b in got[1].label_boxes] == [(1.0, 3.0), (4.0, 5.0)]
    noise = spark.createDataFrame([("a", 1, [0.1, -0.1] * 16000), ("a", 2, [0.1, -0.1] * 16000)], "file string, draw int, samples array<float>")
    assert training.samples(calls, audio, d, noise, seed=1, share=1.0).filter("samples[0] <> samples[1]").count() == 2


def test_split_rounds_half_even(spark):
    for n, want in ((38, 30), (2, 1), (1, 0), (5, 4)):
        f = spark.createDataFrame([(f"f{i}",) for i in range(n)], "file string")
        assert training.file_split(f).filter("split = 'train'").count() == want
