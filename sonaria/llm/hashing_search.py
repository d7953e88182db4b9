"""Nearest neighbours by multi-index hashing.

Vectors get binary codes: the signs of their coordinates after a principal
component rotation and further learned rotations that bring the coordinates
close to signs (iterative quantisation). Codes are split into substrings, each
with an index of its own: the distinct values in order, and where each stands.
Two codes within a Hamming radius differ in at least one of m substrings by no
more than radius / m bits, so probing every substring's index that far
retrieves every code within the radius; what is within is ranked by exact
distances. Index rows are shards of bounded size; queries visit them in blocks
of bounded size, one after another. Queries with fewer neighbours in the radius
than asked for are searched once more, through all codes.

Substrings are long (128 bits). In 64 dimensions without clusters the nearest
of some thousand vectors differ in about 0.4 of the bits, others in half: in
16 bits that is no difference, and probing finds nearly every code.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonaria.llm.common import bound_batches, kept

#: Bits of a word of a code, and words of a substring.
WORD, PER = 64, 2
#: How many times fewer probes than values of an index are looked up.
LOOKED = 16
#: Principal components that a rotation turns at most.
TURNED = 256
SHARD, QUERIES, SAMPLE = 8192, 16384, 4096


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of words."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


def _names(values: np.ndarray) -> np.ndarray:
    """Rows of words as byte strings, which have the order of the rows."""
    return np.ascontiguousarray(values.astype(">u8")).view(f"S{8 * values.shape[1]}").ravel()


@functools.lru_cache(maxsize=8)
def flips(words: int, far: int) -> np.ndarray:
    """A row of words for every choice of up to `far` bits, those bits set."""
    out = np.zeros((sum(comb(WORD * words, k) for k in range(far + 1)), words), np.uint64)
    at = 0
    for k in range(far + 1):
        chosen = np.array(list(combinations(range(WORD * words), k)), np.int64).reshape(comb(WORD * words, k), k)
        rows = at + np.arange(len(chosen))
        for bit in chosen.T:
            out[rows, bit // WORD] |= np.uint64(1) << (bit % WORD).astype(np.uint64)
        at += len(chosen)
    return out


class Codes:
    """Learned codes: `tables` rotations of the principal components, of the first TURNED if there are more, a bit for
    each coordinate."""

    def __init__(self, sample: np.ndarray, tables: int = 4, rounds: int = 25, seed: int = 5) -> None:
        x = sample.astype(float)
        self.mean = x.mean(0)
        x = x - self.mean
        dims = min(TURNED, -(-x.shape[1] // WORD) * WORD)
        v = np.linalg.eigh(x.T @ x)[1].T[::-1][:dims]
        rng = np.random.default_rng(seed)
        maps = []
        for _ in range(tables):
            basis = np.concatenate([v.T, np.zeros((x.shape[1], dims - len(v)))], 1)
            turn, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
            z = x @ basis
            for _ in range(rounds):  # nearest signs, then the rotation that comes nearest to them
                u, _, w = np.linalg.svd(z.T @ np.where(z @ turn >= 0, 1.0, -1.0))
                turn = u @ w
            maps.append(basis @ turn)
        self.map = np.concatenate(maps, 1)
        self.words = self.map.shape[1] // WORD

    def of(self, x: np.ndarray) -> np.ndarray:
        """A row of words for each vector."""
        bits = np.packbits((x - self.mean) @ self.map >= 0, axis=1)
        return np.ascontiguousarray(bits).view(np.uint64).reshape(len(x), self.words)

    def radius(self, sample: np.ndarray, k: int, share: float) -> int:
        """The radius that holds this share of the k nearest of some sample vectors. The whole table's nearest
        are nearer than the sample's, so it holds more of theirs."""
        x, c = sample.astype(float), self.of(sample)
        some = range(0, len(x), max(1, len(x) // 200))
        far = [0]
        for i in some:
            d = ((x - x[i]) ** 2).sum(1)
            d[i] = np.inf
            near = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
            far += distance(c[near], c[i]).tolist()
        return int(np.quantile(far, share))


class Shard:
    """The substring indexes of a bounded number of codes."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.cuts = [(a, min(a + PER, codes.shape[1])) for a in range(0, codes.shape[1], PER)]
        self.tables = []
        for a, b in self.cuts:
            value, number = np.unique(codes[:, a:b], axis=0, return_inverse=True)
            number = number.ravel()
            order = np.argsort(number, kind="stable")
            self.tables.append((value, _names(value), np.searchsorted(number[order], np.arange(len(value) + 1)), order))

    def probed(self, table: int, word: np.ndarray, far: int) -> np.ndarray:
        """Codes whose substring differs from word by at most `far` bits. Where there are LOOKED times fewer such
        substrings than the index has, each is looked up, else each of the index is compared, which costs less."""
        value, names, first, order = self.tables[table]
        if LOOKED * sum(comb(WORD * value.shape[1], k) for k in range(far + 1)) < len(value):
            probes = word ^ flips(value.shape[1], far)
            k = np.minimum(np.searchsorted(names, _names(probes)), len(value) - 1)
            near = np.unique(k[(value[k] == probes).all(1)])
        else:
            near = np.flatnonzero(distance(value, word) <= far)
        size = first[near + 1] - first[near]
        return order[np.repeat(first[near] - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def retrieved(self, code: np.ndarray, radius: int) -> np.ndarray:
        """What probing retrieves: every code within the radius, and others."""
        hit = np.zeros(len(self.codes), bool)
        for k, (a, b) in enumerate(self.cuts):
            hit[self.probed(k, code[a:b], radius // len(self.cuts))] = True
        return np.flatnonzero(hit)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every code within the radius."""
        found = self.retrieved(code, radius)
        return found[distance(self.codes[found], code) <= radius]


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    good = F.col("embedding").isNotNull() & (F.size("embedding") == dims) & F.col("vec_id").isNotNull()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(good & finite & F.exists("embedding", lambda x: x != 0))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _rows(df: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    t = df.toArrow()
    return t["vec_id"].to_numpy(), _matrix(t["embedding"].combine_chunks(), dims) if len(t) else np.zeros((0, dims))


def build_index(vectors: DataFrame, codes: Codes, dims: int) -> DataFrame:
    """Shards: the ids, vectors and codes of up to SHARD rows as bytes."""
    told = vectors.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for a in range(0, len(batch), SHARD):
                held.append(batch.slice(a, SHARD))
                n += len(held[-1])
                if n >= SHARD:
                    yield _shard(held, told.value, dims)
                    held, n = [], 0
        if n:
            yield _shard(held, told.value, dims)

    return vectors.mapInArrow(run, "ids binary, vectors binary, codes binary")


def _shard(held: list[pa.RecordBatch], codes: Codes, dims: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(held)
    x = _matrix(t["embedding"].combine_chunks(), dims)
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (t["vec_id"].to_numpy().astype(np.int64), x, codes.of(x))], ["ids", "vectors", "codes"])


def _search(index: DataFrame, told, k: int) -> DataFrame:
    """The k nearest of each shard for each query of a broadcast block (ids, vectors, codes, radius)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, codes, radius = told.value
        for batch in batches:
            for k_row in range(len(batch)):
                own, vectors, held = (batch.column(c)[k_row].as_buffer() for c in range(3))
                own = np.frombuffer(own, np.int64)
                vectors = np.frombuffer(vectors).reshape(len(own), -1)
                shard = Shard(np.frombuffer(held, np.uint64).reshape(len(own), -1))
                out = []
                for q, v, c in zip(ids, x, codes, strict=True):
                    near = shard.within(c, radius)
                    near = near[own[near] != q]
                    d = np.sqrt(((vectors[near] - v) ** 2).sum(1))
                    best = np.lexsort((own[near], d))[:k]
                    out.append((np.full(len(best), q), own[near[best]], d[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score double")


def _best(index: DataFrame, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, radius: int, k: int) -> DataFrame:
    """The k nearest of a block of queries, written; the block then leaves the driver and the executors."""
    told = index.sparkSession.sparkContext.broadcast((ids, x, codes, radius))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = _search(index, told, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    done = kept(ranked.select("query_id", "rank", "vec_id", "score"), "nearest")
    told.destroy()
    return done


def nearest(vectors: DataFrame, is_query, k: int = 10, share: float = 0.985) -> DataFrame:
    """The k nearest rows of each query row by Euclidean distance.

    vectors: vec_id, embedding; other columns are ignored, whatever their names. is_query: a condition on vec_id; a
    query's own id is no candidate. Vectors that are null, zero or of another length than most, or that hold a null or
    non-finite component, and rows without an id take no part. Returns query_id, rank (from 1, nearest first, ties to
    the smaller vec_id), vec_id, score (the distance in double precision); fewer than k rows only where there are
    fewer candidates. Repeated rows are candidates each; a repeated query row is one query. An empty table gives
    an empty result. `share` of the nearest of a sample decide the radius, so neighbours beyond it can be missed.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = vectors.filter("embedding is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dims = sizes[0].n
    good = usable(vectors, dims)
    _, sample = _rows(good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE), dims)
    if not len(sample):
        return spark.createDataFrame([], schema)
    codes = Codes(sample)
    radius = codes.radius(sample, k, share)
    index = kept(build_index(good, codes, dims), "codes")
    done = None
    for ids, x in _blocks(good.filter(is_query), dims):
        c = codes.of(x)
        some = _best(index, ids, x, c, radius, k)
        full = {r.query_id for r in some.filter(F.col("rank") == k).select("query_id").collect()}  # of one block
        short = np.array([i for i, q in enumerate(ids.tolist()) if q not in full], np.int64)
        if len(short):
            rest = _best(index, ids[short], x[short], c[short], WORD * codes.words, k)
            some = some.join(rest.select("query_id").distinct(), "query_id", "left_anti").unionByName(rest)
        done = some if done is None else done.unionByName(some)
    return spark.createDataFrame([], schema) if done is None else done


def _blocks(queries: DataFrame, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries in blocks of at most QUERIES; a block is what the driver and each executor hold at once."""
    ids, rows = [], []
    for r in queries.dropDuplicates(["vec_id"]).orderBy("vec_id").toLocalIterator():
        ids.append(r.vec_id)
        rows.append(np.array(r.embedding))
        if len(ids) == QUERIES:
            yield np.array(ids, np.int64), np.array(rows)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(rows)
