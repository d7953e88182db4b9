"""Queries on recordings: known tones in noise, one for each nation, and what must be found in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.operators import detector, features, separation
from sonaria.operators import spectral as sp
from sonaria.plans.views import table

RATE, SECONDS = 4000, 14
#: Fundamentals in Hz of a nation's call, and of the call that overlaps it.
FIRST, SECOND = "14 + n_nationkey % 5", "23 + n_nationkey % 5"


def _tone(f0: str, start: int, end: int, vibrato: float) -> str:
    """SQL of sample i: eleven harmonics from `start` to `end` seconds, their fundamental swinging by vibrato."""
    t = f"(i / {RATE}D - {start})"
    turns = f"({f0}) * {t} + {vibrato}D * (1 - cos(2.2 * pi() * {t})) / (2.2 * pi())"
    return f"if(i >= {start * RATE} and i < {end * RATE}, aggregate(sequence(1, 11), 0D, (s, h) -> s + sin(2 * pi() * h * ({turns})) / h), 0D)"


def _recordings(spark: SparkSession, d: str, *tones: str) -> DataFrame:
    noise = "pmod(xxhash64(n_nationkey, i), 2000001) / 5e7D - 0.02D"
    samples = f"transform(sequence(0, {RATE * SECONDS - 1}), i -> cast({' + '.join([noise, *tones])} as float))"
    return table(spark, d, "nation").selectExpr("n_name as file", "n_nationkey", f"{RATE} as sr", f"{samples} as samples")


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return _recordings(spark, d, _tone(FIRST, 5, 9, 1.0))


def _near(c: str, want: str, within: float) -> Column:
    return F.abs(F.col(c) - F.expr(want)) < within


def audio_transform(spark, d):
    """Packed spectra and back."""
    audio = _calls(spark, d)
    back = sp.istft(sp.stft(audio, 1024, 256), 256, audio.select("file", F.size("samples").alias("length")))
    both = audio.join(back.withColumnRenamed("samples", "back"), "file")
    return both.select("file", F.size("back").cast("long").alias("n_samples"), F.expr("array_max(zip_with(samples, back, (a, b) -> abs(a - b))) < 1e-3").alias("same"))


def audio_pitch(spark, d):
    """The fundamental in the middle of each call, and what is voiced before it begins."""
    frames = detector.frame_rows(_calls(spark, d)).join(table(spark, d, "nation").select(F.col("n_name").alias("file"), "n_nationkey"), "file")
    t = F.col("frame") * detector.Settings().dt
    inside, before = t.between(6, 8), t < 4
    found = frames.groupBy("file", "n_nationkey").agg(F.median(F.when(inside, F.col("f0"))).alias("f0"), F.avg(F.when(before, F.col("vprob"))).alias("p"))
    return found.select("file", _near("f0", FIRST, 1.0).alias("found"), (F.col("p") < 0.5).alias("quiet"))


def audio_detect(spark, d):
    """The calls of each recording, and whether times and fundamental are right."""
    found = detector.detect(_calls(spark, d)).join(table(spark, d, "nation").select(F.col("n_name").alias("Sound_file"), "n_nationkey"), "Sound_file")
    right = _near("Start_time", "5", 0.6) & _near("End_time", "9", 0.6) & _near("Median_F0_Hz", FIRST, 2.0)
    return found.groupBy(F.col("Sound_file").alias("file")).agg(F.count("*").alias("n_calls"), F.bool_and(right).alias("found"))


def audio_features(spark, d):
    """The measurements of each call, cut out."""
    clips = _calls(spark, d).withColumn("samples", F.slice("samples", 5 * RATE + 1, 4 * RATE))
    found = features.extract(clips).join(clips.select("file", "n_nationkey"), "file")
    return found.select("file", "is_valid", F.round("duration_s", 3).alias("duration_s"), _near("fundamental_hz", FIRST, 1.5).alias("found"), (F.col("harmonic_count") > 2).alias("harmonic"))


def audio_separate(spark, d):
    """Two callers that overlap from second 4 to 6, each with a track."""
    audio = _recordings(spark, d, _tone(FIRST, 1, 6, 0.3), _tone(SECOND, 4, 9, 0.3))
    both = audio.select("file", F.explode(F.expr("array(struct(1L as id, 1D as start_s, 6D as end_s), struct(2L as id, 4D as start_s, 9D as end_s))")).alias("c")).select("file", "c.*")
    found = separation.separate(audio, both).join(audio.select("file", "n_nationkey"), "file")
    right = F.when(F.col("caller") == 0, _near("f0", FIRST, 1.0)).otherwise(_near("f0", SECOND, 1.0))
    return found.groupBy("file").agg(F.count("samples").alias("n_tracks"), F.bool_and(right).alias("found"))


QUERIES = {f.__name__: f for f in (audio_transform, audio_pitch, audio_detect, audio_features, audio_separate)}
#: What the recordings hold.
SQL = {
    "audio_transform": f"SELECT n_name AS file, {RATE * SECONDS}::BIGINT AS n_samples, true AS same FROM nation",
    "audio_pitch": "SELECT n_name AS file, true AS found, true AS quiet FROM nation",
    "audio_detect": "SELECT n_name AS file, 1::BIGINT AS n_calls, true AS found FROM nation",
    "audio_features": "SELECT n_name AS file, true AS is_valid, 4.0::DOUBLE AS duration_s, true AS found, true AS harmonic FROM nation",
    "audio_separate": "SELECT n_name AS file, 2::BIGINT AS n_tracks, true AS found FROM nation",
}
