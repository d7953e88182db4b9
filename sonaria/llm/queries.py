"""The opN_ queries: each applies its operator to a whole table and returns its contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.llm import decontaminate, hashing_search, html_text, jaccard_join, mil, packing, pii, quality, substring_dedup, suffix_dedup
from sonaria.llm.common import read
from sonaria.llm.sql import SQL  # noqa: F401  registered beside QUERIES


def _span_sum(spans: str):
    return F.expr(f"aggregate({spans}, 0L, (a, s) -> a + s.end - s.start)")


#: Learnt labels come from rows outside the held-out part: crc32 of the id's text modulo (parts), and the part.
def _held_out(parts: int, part: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == part, F.lit(False))


def _scored(df: DataFrame, parts: int, part: int) -> DataFrame:
    return df.select("doc_id", _held_out(parts, part).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    space = quality.train(docs, read(spark, sf_dir, "labels"), ~_held_out(5, 0))
    return _scored(quality.score(docs, space), 5, 0)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing_search.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.mask(read(spark, sf_dir, "documents"), pii.key_of(spark)).select("doc_id", "text", "n_pii")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", _span_sum("removed").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", _span_sum("removed").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = mil.train(docs, read(spark, sf_dir, "labels"), ~_held_out(4, 2))
    return _scored(mil.score(docs, model), 4, 2)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    items = F.expr("array_sort(array_distinct(filter(transform(hits, h -> cast(h.item_id as string)), i -> i is not null)))")
    n_hit = F.expr(decontaminate.covered())
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


QUERIES = {f.__name__: f for f in (op1_main_text, op2_jaccard_join, op3_quality, op4_neighbours, op5_packing, op6_pseudonyms, op7_substring_dedup, op8_suffix_dedup, op9_toxicity, op10_decontamination)}
