"""Quality by nearest-neighbour voting in a latent semantic space.

The terms of a document are its words, the shapes of its words (letters, case,
digits and marks, runs shortened), pairs of neighbouring shapes, and whether a
word repeats what stood shortly before it. Term frequencies of a bounded
labelled sample are weighted and reduced by a truncated singular value
decomposition; every document is folded into that space. Its exact cosines
with all labelled vectors come from one matrix product for each block of
documents, and the nearest vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from sonaria.llm.arrays import BYTE_VALUES, SPACED, U64, Rolling, chunks, flat, mix, word_values, words
from sonaria.llm.common import bound_batches
from sonaria.llm.memory import trim
from sonaria.llm.mil import _sampled

#: Hashed terms of each kind: words, shapes, pairs of shapes, and repeats.
SIZES = (1 << 11, 1 << 10, 1 << 11, 16)
TERMS = sum(SIZES)
#: How much each kind counts.
SHARES = (0.5, 1.0, 1.0, 1.0)
#: How far back a word is looked for.
BACK = (1, 2, 3, 4, 8, 16, 32)


def _shape_bytes() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[ord("a") : ord("z") + 1] = ord("a")
    t[ord("A") : ord("Z") + 1] = ord("A")
    t[ord("0") : ord("9") + 1] = ord("0")
    t[0x80:] = ord("a")
    return t


SHAPES = _shape_bytes()
#: Second bytes of the capital letters from U+00C0 on.
CAPITAL = np.zeros(256, bool)
CAPITAL[0x80:0x9F] = True


def frequencies(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text: the square roots of each kind's term shares, times the kind's own share."""
    n = len(offsets) - 1
    start, end, of = words(buf, offsets, SPACED)
    out = np.zeros((n, TERMS), np.float32)
    if not len(start):
        return out
    text = np.repeat(np.arange(n), np.diff(of))
    word = word_values(buf, start, end)
    shape = SHAPES[buf]
    big = np.flatnonzero((buf == 0xC3) & CAPITAL[np.append(buf[1:], 0)])
    shape[big] = shape[np.minimum(big + 1, len(buf) - 1)] = ord("A")
    turn = np.concatenate([[True], shape[1:] != shape[:-1]])
    turn[start] = True
    place = np.concatenate([[0], np.cumsum(turn)])
    form = Rolling(BYTE_VALUES[1][shape[turn]], 1).span(place[start], place[end])
    before = np.concatenate([[U64(1)], form[:-1]])
    before[of[:-1][of[:-1] < len(start)]] = U64(1)
    kinds = [
        (word % U64(SIZES[0])).astype(np.int64),
        (form % U64(SIZES[1])).astype(np.int64),
        (mix(form + before * U64(31)) % U64(SIZES[2])).astype(np.int64),
    ]
    again = np.zeros(len(start), np.int64)
    for k, back in reversed(list(enumerate(BACK, 1))):
        if len(word) > back:
            same = (word[back:] == word[:-back]) & (text[back:] == text[:-back])
            again[back:][same] = k
    kinds.append(again)
    base = 0
    for kind, size, share in zip(kinds, SIZES, SHARES, strict=True):
        c = np.bincount(text * size + kind, minlength=n * size).reshape(n, size)
        out[:, base : base + size] = share * np.sqrt(c / np.maximum(c.sum(1, keepdims=True), 1))
        base += size
    return out


class Space:
    """Term weights, the map into the latent space, and the labelled vectors."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, dims: int = 48) -> None:
        seen = (vectors > 0).sum(0)
        self.weights = np.log((1 + len(vectors)) / (1 + seen)).astype(np.float32) + np.float32(1)
        x = vectors * self.weights
        rng = np.random.default_rng(3)
        dims = min(dims, *x.shape)
        basis = rng.standard_normal((x.shape[1], dims + 8)).astype(np.float32)
        for _ in range(4):  # randomised subspace iteration
            basis, _ = np.linalg.qr(x.T @ (x @ basis))
        _, s, v = np.linalg.svd(x @ basis, full_matrices=False)
        self.map = (basis @ v[:dims].T).astype(np.float32)
        self.labels = labels.astype(np.float32)
        self.known = self.fold(vectors)

    def fold(self, vectors: np.ndarray) -> np.ndarray:
        z = (vectors * self.weights) @ self.map
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def votes(self, vectors: np.ndarray, neighbours: int, power: float) -> np.ndarray:
        """The share of label 1 among the nearest labelled vectors, each weighing its cosine to that power; 0 for a zero vector."""
        z = self.fold(vectors)
        cosine = z @ self.known.T
        k = min(neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(float) ** power
        total = w.sum(1)
        return np.where(total > 0, (w * self.labels[near]).sum(1) / np.maximum(total, 1e-300), 0.0)


def train(docs: DataFrame, labels: DataFrame, usable, per_class: int = 1500) -> Space | None:
    """Learn from at most per_class documents of each label that the condition `usable` (on labels.doc_id) lets
    pass; None without any."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in chunks(*flat(batch.column(1))):
                f = frequencies(buf, offsets)
                at = [np.flatnonzero(r).astype(np.int32) for r in f]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([r[a].tobytes() for r, a in zip(f, at, strict=True)], pa.binary())], ["doc_id", "y", "at", "f"])

    bound_batches(docs.sparkSession)
    rows = _sampled(docs, labels, "quality", usable, per_class).selectExpr("doc_id", "text", "cast(y as int) as y").mapInArrow(pack, "doc_id long, y int, at binary, f binary").toArrow().sort_by("doc_id")
    if not len(rows):
        return None
    x = np.zeros((len(rows), TERMS), np.float32)
    for r, a, f in zip(x, rows["at"].to_pylist(), rows["f"].to_pylist(), strict=True):
        r[np.frombuffer(a, np.int32)] = np.frombuffer(f, np.float32)
    space = Space(x, np.array(rows["y"].to_pylist()))
    del x, rows
    trim()
    return space


def score(docs: DataFrame, space: Space | None, neighbours: int = 15, power: float = 8.0) -> DataFrame:
    """docs with a column score (0 to 1, higher: label 1 likelier).

    docs: doc_id, text and any other columns, which stay, unless one is named score. A text without words, or any
    text when nothing is labelled, scores 0; equal texts score alike; very long texts are scored whole; null ids and texts stay null; an empty
    table stays empty.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("score")
    names = docs.columns
    told = docs.sparkSession.sparkContext.broadcast(space)
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in chunks(*flat(batch.column(names.index("text"))), 1 << 19):
                rows = [s for a in range(0, j - i, 512) for s in [_block(told.value, buf, offsets[a : min(a + 513, j - i + 1)], neighbours, power)]]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), pa.array(np.concatenate(rows), pa.float64())], [*names, "score"])

    return docs.mapInArrow(run, schema)


def _block(space: Space | None, buf: np.ndarray, offsets: np.ndarray, neighbours: int, power: float) -> np.ndarray:
    if space is None:
        return np.zeros(len(offsets) - 1)
    f = frequencies(buf[offsets[0] : offsets[-1]], offsets - offsets[0])
    return np.where(f.any(1), space.votes(f, neighbours, power), 0.0)
