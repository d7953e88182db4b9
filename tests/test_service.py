import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonaria.operators import clustering, training
from sonaria.service import Service, read_settings
from sonaria.sources import wav
from tests.test_frames import tone


def test_settings():
    assert read_settings("# c\nA=1\n B = 'x=y' \nA=2\nbad\n", {"C": "3"}) == {"C": "3", "A": "1", "B": "x=y"}


def test_from_recording_to_description(spark, tmp_path):
    y = np.zeros(40000)
    y[4000:24000] += 0.4 * tone(14, 5, vibrato=0.0)
    y[16000:36000] += 0.4 * tone(23, 5, vibrato=0.0)
    (tmp_path / "night 1.wav").write_bytes(wav.encode(y / 4, 4000))
    calls = spark.createDataFrame([("night 1.wav", 1, 1.0, 6.0), ("night 1.wav", 2, 4.0, 9.0)], "file string, id long, start_s double, end_s double")
    s = Service(spark, f"file://{tmp_path}/root", calls=calls)
    assert s.health() == {"status": "ok"}
    got = s.clean(f"{tmp_path}/night 1.wav")
    assert got["detected_callers"] == 2 and [c["elephant_id"] for c in got["callers"]] == ["Elephant_A", "Elephant_B"] and got["clip_count"] >= 2
    path, kind = s.download(got["download"])
    assert kind == "application/zip" and len(zipfile.ZipFile(path).namelist()) == 2
    assert len(s.registry_dump()["elephants"]) == 2 and s.rename("Elephant_A", " Ann ")
    clip = got["callers"][0]["clips"][0]["clip_id"]
    assert s.clip_audio(clip).endswith(".wav")
    d = s.analyse_clip(clip)
    assert d["is_valid"] and abs(d["fundamental_hz"] - 14) < 2 and d["analysis"].startswith("This rumble")
    assert s.analyse().count() == got["clip_count"]
    for bad, error in ((lambda: s.clean("x.mp3"), ValueError), (lambda: s.rename("Elephant_A", " "), ValueError), (lambda: s.rename("Nobody", "x"), LookupError), (lambda: s.clip_audio(999), LookupError), (lambda: s.download("../registry"), LookupError)):
        with pytest.raises(error):
            bad()


def test_embedding_of_bins(spark):
    r = np.random.default_rng(1)
    rows = [("f", t, b, float((0.9 if b < 20 else 0.5) + 0.02 * r.standard_normal() if (b < 20 and t % 2 == 0) or (b >= 40 and t % 3 == 0) else 0.02 * r.random())) for t in range(24) for b in range(60)]
    bins = spark.createDataFrame(rows, "file string, frame int, bin int, x double")
    v = training.BinEmbedding(6).fit(bins).transform(bins)
    n = v.select(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x).alias("n")).agg(F.min("n"), F.max("n")).first()
    assert n[0] == pytest.approx(1) and n[1] == pytest.approx(1)
    known = v.filter("x > 0.3").withColumn("y", F.when(F.col("bin") < 20, 0).otherwise(1)).withColumn("id", F.monotonically_increasing_id())
    shuffled = known.withColumn("y", (F.xxhash64("id") % 2).cast("int"))
    assert clustering.clustering_loss(known, "id", "vec", "y").first().loss < clustering.clustering_loss(shuffled, "id", "vec", "y").first().loss
