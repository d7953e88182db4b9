"""A training corpus from raw documents: toxic ones go, one of each near-duplicate group stays, those with benchmark
passages go, personal data is pseudonymised, and the rest is packed into sequences.

Each stage takes (spark, docs, sf_dir) with docs as the stage before it left them, and returns the columns of
documents; the last returns packed pieces. Other columns of docs pass through, whatever their names. Null texts and ids
are kept by the filtering stages as each says; texts of any length are read whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.llm import decontaminate, jaccard_join, mil, packing, pii
from sonaria.llm.common import kept, made, read, release
from sonaria.llm.queries import _held_out

#: A document of this toxicity or more is rejected.
REJECTED = 0.3
#: Keys of eight bytes that are sent to every task at most; more are joined by an exchange.
SENT = 1 << 20
#: The columns that stages read.
READ = ("doc_id", "text", "n_chars")


def _plain(docs: DataFrame) -> DataFrame:
    """docs under names that no operator gives to a column of its own."""
    return docs.toDF(*(c if c in READ else f"column {i}" for i, c in enumerate(docs.columns)))


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows of _plain(docs) under the names of docs."""
    return rows.select(*(F.col(f"`{p}`").alias(c) for p, c in zip(_plain(docs).columns, docs.columns, strict=True)))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key, of id and text: rows that share it are equal but for columns that no stage reads."""
    return _plain(docs).withColumn("key", F.xxhash64("doc_id", "text"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that multiple-instance learning finds toxic go. A null or empty text isn't toxic."""
    model = mil.train(docs, read(spark, sf_dir, "labels"), ~_held_out(4, 2))
    return _named(mil.score(_plain(docs), model).filter(F.col("score") < REJECTED), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of all rows that links of Jaccard similarity 0.8 connect, the one with the least doc_id stays, of equal ids the
    one with the least hash; rows without an id come last. Different texts of one id are rows of their own. Texts
    without words stay, one for each id and text."""
    told = _keyed(docs)
    classes = jaccard_join.join(told.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "class_id").distinct()
    ids = told.select("key", "doc_id").distinct()
    first = classes.join(ids, "key").groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("least"))
    return _named(told.join(first.select("least.key"), "key", "left_semi").dropDuplicates(["key"]), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go. Null and empty texts have none. Rows are told
    apart by the hash of their id and text, so another text of the same id, or of none, stays."""
    told = _keyed(docs)
    found = decontaminate.find(told.select(F.col("key").alias("doc_id"), "text"), read(spark, sf_dir, "benchmark")).filter(F.size("hits") > 0)
    gone = kept(found.select(F.col("doc_id").alias("key")).distinct(), "contaminated")
    small = gone.count() <= SENT
    return _named(told.join(F.broadcast(gone) if small else gone, "key", "left_anti"), docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by format-preserving pseudonyms; n_chars follows the text. No document goes."""
    masked = pii.mask(_plain(docs), pii.key_of(spark))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("n_pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return _named(masked, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, a null text as an empty one, as pieces of sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("pseudonyms", pseudonyms),
    ("packing", packed),
]

#: The first stage's model isn't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents, written to the shared folder; what the stages have written there goes."""
    mark = made()
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
        release(spark, mark, but=1)
    return docs
