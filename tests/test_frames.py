import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonaria.functions import scalars
from sonaria.operators import detector, features
from sonaria.operators import frames as fr


def series(spark, mask, file="f"):
    return spark.createDataFrame([(file, i, bool(m)) for i, m in enumerate(mask)], "file string, frame int, mask boolean")


def values(df, c="mask"):
    return [x[c] for x in df.orderBy("file", "frame").collect()]


def at(m, i):
    return 0 <= i < len(m) and m[i]


def brute_close(m, w):
    b, a = w // 2, w - w // 2 - 1
    d = [any(at(m, i + k) for k in range(-a, b + 1)) for i in range(len(m))]
    return [all(at(d, i + k) for k in range(-b, a + 1)) for i in range(len(m))]


def brute_open(m, w):
    b, a = w // 2, w - w // 2 - 1
    e = [all(at(m, i + k) for k in range(-b, a + 1)) for i in range(len(m))]
    return [any(at(e, i + k) for k in range(-a, b + 1)) for i in range(len(m))]


@pytest.mark.parametrize("w", [1, 2, 3, 6, 16])
def test_morphology(spark, w):
    r = random.Random(w)
    m = [r.random() < 0.6 for _ in range(200)]
    assert values(fr.closing(series(spark, m), "mask", w)) == brute_close(m, w)
    o = values(fr.opening(series(spark, m), "mask", w))
    assert o == brute_open(m, w) and all(a or not b for a, b in zip(m, o, strict=True))


def test_all_true_loses_its_borders(spark):
    got = values(fr.closing(series(spark, [True] * 60), "mask", 16))
    assert [i for i, v in enumerate(got) if v] == list(range(8, 53))


def test_rolling_std_reaches_as_far_as_it_should(spark):
    df = spark.createDataFrame([("f", i, 9.0 if i == 20 else 5.0) for i in range(60)], "file string, frame int, f0 double")
    s = values(df.withColumn("s", fr.rolling_std("f0", 16)), "s")
    assert [i for i, v in enumerate(s) if v > 1e-9] == list(range(13, 29))


def test_runs(spark):
    r = random.Random(2)
    m = [r.random() < 0.5 for _ in range(300)]
    want, i = [], 0
    while i < 300:
        j = i
        while j < 300 and m[j]:
            j += 1
        if j > i:
            want.append((i, j))
        i = j + 1
    assert sorted((x["first"], x.end) for x in fr.runs(series(spark, m), "mask").collect()) == want


def test_interpolation_and_extension(spark):
    r = random.Random(5)
    y = [None if r.random() < 0.4 else r.uniform(10, 30) for _ in range(80)]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(y)] + [("g", 0, None), ("g", 1, 3.0)], "file string, frame int, v double")
    ok = [i for i, v in enumerate(y) if v is not None]
    got = [x.i for x in df.withColumn("i", fr.interpolate("v")).filter("file = 'f'").orderBy("frame").collect()]
    assert np.allclose(got, np.interp(range(80), ok, [y[i] for i in ok]))
    assert df.withColumn("i", fr.interpolate("v")).filter("file = 'g' and i is not null").count() == 0
    part = spark.createDataFrame([("f", i, 12 + 0.1 * i if 30 <= i < 50 else None) for i in range(200)], "file string, frame int, v double")
    ext = values(fr.extrapolate(part, "v"), "v")
    assert np.allclose(ext, np.clip(12 + 0.1 * np.arange(200), 8, 50))
    assert values(fr.extrapolate(part.withColumn("v", F.lit(None).cast("double")), "v"), "v") == [20.0] * 200


def test_median_fill(spark):
    df = spark.createDataFrame([("f", 0, 4.0), ("f", 1, None), ("f", 2, -1.0), ("f", 3, 8.0), ("g", 0, None)], "file string, frame int, v double")
    assert values(fr.median_fill(df, "v"), "v") == [4.0, 6.0, 6.0, 8.0, 20.0]


def test_split(spark):
    r = random.Random(8)
    n, dt, longest = 900, 0.064, 12.0
    score = [r.random() for _ in range(n)]
    df = spark.createDataFrame([("f", i, s) for i, s in enumerate(score)], "file string, frame int, s double")

    def brute(a, b):
        if (min(b, n - 1) - min(a, n - 1)) * dt <= longest or b - a < 4:
            return [(a, b)]
        m = max(1, (b - a) // 10)
        k = a + m + int(np.argmin(score[a + m : b - m]))
        return brute(a, k) + brute(k, b)

    regions = spark.createDataFrame([("f", 0, n, n - 1)], "file string, first int, end int, last int")
    got = fr.split_at_valleys(regions, df, "s", longest, dt)
    assert sorted((x["first"], x.end) for x in got.collect()) == brute(0, n)


def test_resample(spark):
    df = spark.createDataFrame([("f", i, float(i * i)) for i in range(10)], "file string, frame int, v double")
    got = values(fr.resample(df, "v", 25), "v")
    assert np.allclose(got, np.interp(np.linspace(0, 1, 25), np.linspace(0, 1, 10), np.arange(10.0) ** 2))


def test_resample_joins_nothing(spark):
    """Repeated, missing and unknown frames make what pairs of them make; what is stretched is never sent about."""
    rows = [("a", 0, 1.0), ("a", 1, 3.0), ("a", 1, 5.0), ("a", 2, None), ("b", 0, 2.0), ("b", 2, 4.0), ("b", None, 9.0), (None, 0, 7.0), ("c", 0, 6.0)]
    out = fr.resample(spark.createDataFrame(rows, "file string, frame int, v double"), "v", 5)
    want = []
    for file in ("a", "b", "c"):
        own = [x for x in rows if x[0] == file]
        for f in range(5):
            pos = f * (len(own) - 1) / 4
            pairs = [(x[2], y[2]) for x in own for y in own if (x[1], y[1]) == (pos // 1, -(-pos // 1))]
            want += [(file, f, None if None in p else p[0] + (p[1] - p[0]) * (pos % 1)) for p in pairs]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_one_decimal_is_that_of_the_binary_value(spark):
    r = random.Random(8)
    xs = [34.25, 16.15, 34.75, 0.05, 0.95, 9.95, 0.25, 1e-9, 0.0, -0.0, -0.04, -34.25, 99.95, 4503599627370495.5, *(r.randrange(400_000) / 400 for _ in range(3000)), *(r.uniform(0, 50) for _ in range(500)), *(k / 20 for k in range(-400, 2000))]
    xs += [float(np.nextafter(x, s)) for x in xs for s in (-np.inf, np.inf)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", scalars.one_decimal("x").alias("t"))
    assert [(x.x, x.t) for x in df.collect() if x.t != f"{x.x:.1f}"] == []
    got = spark.createDataFrame([(7, 20.0, x) for x in (34.25, 16.15)], "n int, m double, g double").select(features.modulation("n", "m", "g").alias("t")).collect()
    assert [x.t for x in got] == ["modulated (34.2 Hz range)", "modulated (16.1 Hz range)"]


def tone(f0, seconds, rate=4000, vibrato=1.0):
    t = np.arange(int(seconds * rate)) / rate
    f = f0 + vibrato * np.sin(2 * np.pi * 1.1 * t)
    phase = 2 * np.pi * np.cumsum(f) / rate
    return sum(np.sin(h * phase) / h for h in range(1, 12))


def test_detector_finds_a_call_and_no_generator(spark):
    rng = np.random.default_rng(0)
    quiet = rng.standard_normal(4000 * 14) * 0.01
    call = quiet.copy()
    call[4000 * 5 : 4000 * 9] += tone(20, 4)
    engine = quiet + 0.8 * sum(np.sin(2 * np.pi * 70 * h * np.arange(len(quiet)) / 4000) / h for h in range(1, 8))
    audio = spark.createDataFrame([("call.wav", 4000, call.tolist()), ("engine.wav", 4000, engine.tolist()), ("broken.wav", None, None)], "file string, sr int, samples array<float>")
    got = detector.detect(audio).collect()
    assert [x.Sound_file for x in got] == ["call.wav"] and got[0].Selection == 1
    assert abs(got[0].Start_time - 5) < 0.6 and abs(got[0].End_time - 9) < 0.6 and abs(got[0].Median_F0_Hz - 20) < 2
