"""The operators' tables on the driver's star schema, for Spark and, as CTEs, for the checking engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.operators import spectral

DAYS = 30 * 86400.0
DT = 0.064


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def intervals(spark: SparkSession, d: str) -> DataFrame:
    s = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 1e6")
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("id"), s.alias("start_s"), (s + F.col("value") * 600).alias("end_s"), "event_type", "value")


def truth(spark: SparkSession, d: str) -> DataFrame:
    return intervals(spark, d).filter(F.col("event_type").isin("view", "click")).select("file", "id", "start_s", "end_s")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return intervals(spark, d).filter(F.col("event_type").isin("purchase", "signup")).select("file", "id", "start_s", "end_s")


def durations(spark: SparkSession, d: str) -> DataFrame:
    return intervals(spark, d).select("file").distinct().withColumn("duration", F.lit(DAYS))


def frames(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "events")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    f0 = F.lit(8.0) + F.col("value") / 10
    return e.select(
        F.col("user_id").cast("string").alias("file"), k.cast("int").alias("frame"), F.least(F.col("value") / 100, F.lit(1.0)).alias("vprob"), F.when(F.col("event_type") != "error", f0).alias("f0"),
        F.col("event_type").isin("view", "purchase").alias("contrast"), f0.alias("best_f0"), "value",
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def elements(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("vec_id", "label", F.posexplode("x").alias("i", "v"))


def spectra(spark: SparkSession, d: str) -> DataFrame:
    return spectral.dft(vectors(spark, d), "vec_id", "x", 64)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each vector beside the one with the next id."""
    v = vectors(spark, d)
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return v.select("vec_id", "x").join(b, "vec_id")


def r(c: Column | str, places: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, places) + F.lit(0.0)


CTES = {
    "iv": """iv AS (SELECT user_id::VARCHAR AS file, event_id AS id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS start_s,
        (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 + value * 600 AS end_s, event_type, value FROM events)""",
    "gt": "gt AS (SELECT file, id, start_s, end_s FROM iv WHERE event_type IN ('view', 'click'))",
    "pred": "pred AS (SELECT file, id, start_s, end_s FROM iv WHERE event_type IN ('purchase', 'signup'))",
    "dur": "dur AS (SELECT DISTINCT file, 2592000.0::DOUBLE AS duration FROM iv)",
    "fr": """fr AS (SELECT user_id::VARCHAR AS file, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS frame, least(value / 100, 1.0::DOUBLE) AS vprob,
        CASE WHEN event_type <> 'error' THEN 8.0::DOUBLE + value / 10 END AS f0, event_type IN ('view', 'purchase') AS contrast, 8.0::DOUBLE + value / 10 AS best_f0, value FROM events)""",
    "emb": "emb AS (SELECT vec_id, label, unnest(generate_series(0, len(embedding) - 1))::INTEGER AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)",
    "spec": """spec AS (SELECT vec_id, bin, re, im, sqrt(re * re + im * im) AS mag FROM (SELECT vec_id, bin, sum(v * cos(2 * pi() * ((i * bin) % 64) / 64)) AS re,
        sum(-v * sin(2 * pi() * ((i * bin) % 64) / 64)) AS im FROM emb, (SELECT unnest(generate_series(0, 32))::INTEGER AS bin) GROUP BY ALL))""",
    "pr": "pr AS (SELECT a.vec_id, a.i, a.v AS x, b.v AS y FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1 AND b.i = a.i)",
}
NEEDS = {"gt": ("iv",), "pred": ("iv",), "dur": ("iv",), "spec": ("emb",), "pr": ("emb",)}


def sql(body: str, *names: str, more: str = "") -> str:
    """body after the CTEs it names, those they need, and more of its own."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*NEEDS.get(n, ()), n) if x not in order]
    ctes = ", ".join([CTES[n] for n in order] + ([more] if more else []))
    return f"WITH RECURSIVE {ctes} {body}" if ctes else body
