"""Toxicity by multiple-instance learning.

A document is a bag of sentences, and only the document has a label. Each
sentence gets the probability of a logistic model over hashed words and word
beginnings; a document is toxic unless no sentence is: the noisy-or of its
sentences. The likelihood of the document labels trains the sentence model,
which then tells offending sentences apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sonaria.llm.arrays import ALNUM, LOWER, U64, chunks, flat, mix, word_table, word_values, words
from sonaria.llm.common import bound_batches, kept
from sonaria.llm.memory import trim

BITS = 18
ENDS = word_table(b".!?\n")
#: Bytes of features that the driver holds at once while it fits.
HELD = 1 << 26
#: Bytes of the word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6)


def instances(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features of each word, sentence of each word, text of each sentence, (start, end) bytes of each sentence).

    A sentence ends after . ! ? or a line's end and holds at least one word."""
    low = LOWER[buf]
    start, end, of = words(low, offsets, ALNUM)
    if not len(start):
        return np.zeros((0, 1 + len(BEGINNINGS)), np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    text = np.searchsorted(of, np.arange(len(start)), "right") - 1
    ends = np.cumsum(ENDS[buf])
    before = ends[start]
    new = np.concatenate([[True], (before[1:] != before[:-1]) | (text[1:] != text[:-1])])
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    word = word_values(low, start, end)
    order = np.lexsort((word, sentence))  # a word counts once in a sentence
    again = np.zeros(len(start), bool)
    again[1:] = (word[order][1:] == word[order][:-1]) & (sentence[order][1:] == sentence[order][:-1])
    one = np.sort(order[~again])
    span = np.stack([start[first], end[last]], 1)
    start, end, sentence = start[one], end[one], sentence[one]
    features = np.empty((len(start), 1 + len(BEGINNINGS)), np.int32)
    for j, n in enumerate((1 << 30, *BEGINNINGS)):
        h = word_values(low, start, np.minimum(end, start + n))
        features[:, j] = (mix(h + U64(j)) >> U64(64 - BITS)).astype(np.int32)
    return features, sentence, text[first], span


def _sampled(docs: DataFrame, labels: DataFrame, label: str, usable, per_class: int) -> DataFrame:
    """At most per_class labelled ids of each class, the first in an order that has nothing to do with the data, each
    with one text, the least of those that it has."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).filter(usable).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("y"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    some = [known.filter(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


Bags = list[tuple[int, np.ndarray, np.ndarray]]


def _bags(sample: DataFrame) -> tuple[Callable[[int], Bags], int]:
    """A function that gives a group of the bags, (label, features, sentence of each word) of each sampled document,
    and the number of groups. A group is about HELD bytes, however long the documents are."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in chunks(*flat(batch.column(1))):
                features, sentence, text, _ = instances(buf, offsets)
                cut = np.searchsorted(text[sentence], np.arange(j - i + 1)) if len(sentence) else np.zeros(j - i + 1, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(2).slice(i, j - i),
                        pa.array([features[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                        pa.array([(sentence[a:b] - sentence[a] if b > a else sentence[:0]).astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    ],
                    ["doc_id", "y", "features", "sentence"],
                )

    bags = kept(sample.select("doc_id", "text", F.col("y").cast("int").alias("y")).mapInArrow(pack, "doc_id long, y int, features binary, sentence binary"), "bags")
    groups = -(-(bags.agg(F.sum(F.length("features") + F.length("sentence"))).first()[0] or 0) // HELD) or 1

    def group(g: int) -> Bags:
        rows = bags.filter(F.pmod(F.xxhash64("doc_id"), F.lit(groups)) == g).toArrow()
        ids, y = rows["doc_id"].to_numpy(), rows["y"].to_numpy()
        features, sentence = ([x.as_buffer() for x in rows[c]] for c in ("features", "sentence"))  # views, no copies
        return [(int(y[k]), np.frombuffer(features[k], np.int32).reshape(-1, 1 + len(BEGINNINGS)), np.frombuffer(sentence[k], np.int32)) for k in np.argsort(ids, kind="stable")]

    return group, groups


class Model:
    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def logits(self, features: np.ndarray, sentence: np.ndarray) -> np.ndarray:
        if not len(sentence):
            return np.zeros(0)
        first = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
        return np.add.reduceat(self.weights[features].sum(1), first) + self.bias


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-softplus(-z))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def _batches(group: Callable[[int], Bags], groups: int, epochs: int, batch: int, rng: np.random.Generator) -> Iterator[Bags]:
    """Batches of bags with words, each epoch in another order."""
    bags, held = [], -1
    for _ in range(epochs):
        for k in rng.permutation(groups):
            if k != held:
                bags, held = group(int(k)), k
            order = rng.permutation(len(bags))
            for a in range(0, len(order), batch):
                if some := [bags[i] for i in order[a : a + batch] if len(bags[i][2])]:
                    yield some


def fit(group: Callable[[int], Bags], groups: int = 1, epochs: int = 30, batch: int = 128, rate: float = 0.15, lasso: float = 0.1, least: int = 12, seed: int = 7) -> Model:
    """Maximise the noisy-or likelihood of the bags' labels with Adam, less `lasso` times the weights' absolute sum.
    Features of fewer than `least` bags, or of a hundredth of them if that is less, keep weight 0. One group of bags
    is held at a time; an epoch goes through all of them, in an order of its own."""
    w, b = np.zeros(1 << BITS), -4.0
    model = Model(w, b)
    common, labels, n = np.zeros(len(w), np.int64), set(), 0
    for g in range(groups):
        bags = group(g)
        n += len(bags)
        for y, f, _ in bags:
            common[np.unique(f)] += 1
            labels.add(y)
    del bags
    if len(labels) < 2:
        return Model(w, -30.0)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    common = common >= max(2, min(least, n // 100))
    for step, some in enumerate(_batches(group, groups, epochs, batch, np.random.default_rng(seed)), 1):
        base = np.concatenate([[0], np.cumsum([s[-1] + 1 for _, _, s in some])])
        features = np.concatenate([f for _, f, _ in some])
        sentence = np.concatenate([s + o for (_, _, s), o in zip(some, base, strict=False)])
        y = np.array([y for y, _, _ in some])
        z = model.logits(features, sentence)
        bag = np.repeat(np.arange(len(some)), np.diff(base))
        none = -np.bincount(bag, softplus(z), len(some))  # the log of the chance that no sentence is toxic
        p = sigmoid(z)
        pull = np.where(y == 1, -np.exp(none) / np.maximum(-np.expm1(none), 1e-9), 1.0)
        g = pull[bag] * p / len(some)
        grad = np.concatenate([np.bincount(features.ravel(), np.repeat(g[sentence], features.shape[1]), len(w)), [g.sum()]])
        grad[:-1] *= common
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        w[:] = np.sign(w) * np.maximum(np.abs(w) - lasso * rate, 0)
        model.bias -= move[-1]
    return model


def train(docs: DataFrame, labels: DataFrame, usable, per_class: int = 2000) -> Model:
    """Fit on at most per_class documents of each label that the condition `usable` (on labels.doc_id) lets pass.
    The driver holds about HELD bytes of their features at a time."""
    bound_batches(docs.sparkSession)
    model = fit(*_bags(_sampled(docs, labels, "toxic", usable, per_class)))
    trim()
    return model


def score(docs: DataFrame, model: Model, locate: float = 0.5) -> DataFrame:
    """docs with columns score (0 to 1) and sentences (byte spans of sentences of probability `locate` or more).

    docs: doc_id, text and any other columns, which stay, unless they are named score or sentences. A text
    without words scores 0; equal texts score alike; very long texts are scored whole; null ids and texts stay null;
    an empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.drop("score", "sentences")
    told = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))
    names = docs.columns
    schema = StructType(docs.schema.fields + StructType.fromDDL("score double, sentences array<struct<start:long,end:long,score:double>>").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*told.value)
        for batch in batches:
            for i, j, buf, offsets in chunks(*flat(batch.column(names.index("text")))):
                features, sentence, text, span = instances(buf, offsets)
                z = m.logits(features, sentence).astype(float)
                total = -np.expm1(-np.bincount(text, softplus(z), j - i)) if len(z) else np.zeros(j - i)
                p = sigmoid(z)
                bad = np.flatnonzero(p >= locate)
                cut = np.searchsorted(text[bad], np.arange(j - i + 1)).astype(np.int32)
                span = span - offsets[text][:, None] if len(text) else span
                found = pa.StructArray.from_arrays([pa.array(span[bad, 0], pa.int64()), pa.array(span[bad, 1], pa.int64()), pa.array(p[bad], pa.float64())], ["start", "end", "score"])
                rest = [c.slice(i, j - i) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(total, pa.float64()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), found)], [*names, "score", "sentences"])

    return docs.mapInArrow(run, schema)
