"""Packed exchange of fingerprints between buckets of texts and ranges of hashes.

Texts stay in buckets (common.bucket). A bucket sends each range of the hash
space one row: the sorted distinct fingerprints it holds, as bytes, and which
of them it holds more than once. A range merges the sorted arrays of all
buckets. A common fingerprint thus travels once for each bucket, whatever
share of the texts holds it.

What earlier loads held is in a log-structured store of sorted runs, which a new
batch is merge-joined with where the runs lie.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.llm.arrays import U64, is_in
from sonaria.llm.common import drop_dir, estimated, kept, partitions, read_text, shared_dir, write_text

#: Bytes of input for each range of the hash space, of which fingerprints are about a fifth.
RANGE = 1 << 27
#: Two of a fingerprint are as good as many.
MANY = 2
SOURCES = "t int, src int, keys binary, counts binary, weights binary"
RUNS = "t int, kind int, keys binary, counts binary, weights binary"


def ranges_for(docs: DataFrame) -> int:
    """How many ranges of the hash space: the shuffle partitions, or more, so that a range's share stays bounded."""
    return max(partitions(docs.sparkSession), estimated(docs) // RANGE)


def u64(b) -> np.ndarray:
    return np.frombuffer(b, U64)


def blobs(column: pa.ChunkedArray) -> list[pa.Buffer | None]:
    """A binary column's values without a copy."""
    return [x.as_buffer() if x.is_valid else None for x in column]


@functools.lru_cache(maxsize=4)
def range_ends(ranges: int) -> np.ndarray:
    """The first hash of each range but the first."""
    return np.array([(i << 64) // ranges + 1 for i in range(1, ranges)], dtype=U64)


def pieces(keys: np.ndarray, ranges: int) -> list[tuple[int, slice]]:
    """(range, slice) of sorted keys, without empty ones."""
    cut = np.concatenate([[0], np.searchsorted(keys, range_ends(ranges)), [len(keys)]])
    return [(int(t), slice(int(cut[t]), int(cut[t + 1]))) for t in np.flatnonzero(cut[:-1] < cut[1:])]


def merge(keys: list[np.ndarray], counts: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One sorted run of several: counts up to MANY, weights added."""
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.uint8), np.zeros(0, np.uint64)
    k = np.concatenate(keys)
    order = np.argsort(k, kind="stable")
    k = k[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    if not len(k):
        return k, np.zeros(0, np.uint8), np.zeros(0, np.uint64)
    n = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), first)
    w = np.add.reduceat(np.concatenate(weights)[order].astype(np.uint64), first)
    return k[first], np.minimum(n, MANY).astype(np.uint8), w


def source_rows(src: int, keys: np.ndarray, counts: np.ndarray, weights: np.ndarray, ranges: int) -> pa.Table:
    """Rows of SOURCES for one bucket's sorted distinct fingerprints."""
    cut = pieces(keys, ranges)
    return pa.table(
        {
            "t": pa.array([t for t, _ in cut], pa.int32()),
            "src": pa.array([src] * len(cut), pa.int32()),
            "keys": pa.array([keys[s].tobytes() for _, s in cut], pa.binary()),
            "counts": pa.array([np.minimum(counts[s], MANY).astype(np.uint8).tobytes() for _, s in cut], pa.binary()),
            "weights": pa.array([weights[s].astype(np.uint64).tobytes() for _, s in cut], pa.binary()),
        }
    )


def _arrays(t: pa.Table, src: int | None = None) -> tuple[list, list, list]:
    rows = range(len(t)) if src is None else [i for i, x in enumerate(t["src"].to_pylist()) if x == src]
    k, c, w = (blobs(t[x]) for x in ("keys", "counts", "weights"))
    return [u64(k[i]) for i in rows], [np.frombuffer(c[i], np.uint8) for i in rows], [np.frombuffer(w[i], np.uint64) for i in rows]


#: kind of a row: a run's fingerprints, or repeats that a batch has made known.
RUN, REPEATED = 0, 1


def _ingest(new: pa.Table, old: pa.Table) -> pa.Table:
    """Merge-join of a new batch's fingerprints with the runs, in one range."""
    if not len(new):
        return _rows(0, [])
    fresh, known = merge(*_arrays(new)), merge(*_arrays(old))
    both = merge(*([a, b] for a, b in zip(fresh, known, strict=True)))
    again = (both[1] >= MANY) & is_in(both[0], fresh[0])
    rows = [(RUN, *fresh), (REPEATED, *(x[again] for x in both))]
    return _rows(new["t"][0].as_py(), [r for r in rows if len(r[1])])


def _rows(t: int, rows: list) -> pa.Table:
    return pa.table(
        {
            "t": pa.array([t] * len(rows), pa.int32()),
            "kind": pa.array([r[0] for r in rows], pa.int32()),
            "keys": pa.array([r[1].tobytes() for r in rows], pa.binary()),
            "counts": pa.array([r[2].astype(np.uint8).tobytes() for r in rows], pa.binary()),
            "weights": pa.array([r[3].astype(np.uint64).tobytes() for r in rows], pa.binary()),
        }
    )


class RunStore:
    """A log-structured store of sorted runs at a path that the driver and all executors see.

    Runs are immutable: one row of `RUNS` without kind for each range of the hash space, bucketed by range, so that
    what lies there is merge-joined with a new batch without an exchange of its own. When a level has `fanout` runs,
    compact() merges them, again in place, into one run of the next level. Manifests name the live runs; the last one
    written counts, so a crash between two writes leaves only unreferenced files behind. One process writes at a time.
    """

    def __init__(self, spark: SparkSession, path: str, ranges: int, fanout: int, live: list, n: int, merged: Callable) -> None:
        self.spark, self.path, self.ranges, self.fanout, self.live, self.n, self.merged = spark, path, ranges, fanout, live, n, merged
        self.table = f"runs_{uuid.uuid4().hex}"
        columns = "t int, keys binary, counts binary, weights binary, level int, seq int"
        buckets = min(ranges, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
        spark.sql(f"create table {self.table} ({columns}) using parquet partitioned by (level, seq) clustered by (t) into {buckets} buckets location '{path}/runs'")

    @classmethod
    def create(cls, spark: SparkSession, path: str, ranges: int, fanout: int = 4, merged: Callable = merge) -> RunStore:
        out = cls(spark, path, ranges, fanout, [], 0, merged)
        out._say()
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str, merged: Callable = merge) -> RunStore:
        told = json.loads(read_text(spark, f"{path}/manifest"))
        out = cls(spark, path, told["ranges"], told["fanout"], told["live"], told["n"], merged)
        spark.sql(f"alter table {out.table} recover partitions")
        return out

    def close(self) -> None:
        """Forget the table; its files stay."""
        self.spark.sql(f"drop table if exists {self.table}")

    def _say(self) -> None:
        write_text(self.spark, f"{self.path}/manifest", json.dumps({"ranges": self.ranges, "fanout": self.fanout, "live": self.live, "n": self.n}))

    def rows(self, runs: list | None = None) -> DataFrame:
        """The rows of live runs, or of some."""
        some = self.live if runs is None else runs
        which = " or ".join(f"level = {level} and seq = {seq}" for level, seq in some) or "false"
        return self.spark.table(self.table).filter(which).select("t", "keys", "counts", "weights")

    def _write(self, rows: DataFrame, level: int) -> list:
        self.n += 1
        rows.select("t", "keys", "counts", "weights", F.lit(level).alias("level"), F.lit(self.n).alias("seq")).write.insertInto(self.table)
        return [level, self.n]

    def add(self, rows: DataFrame) -> None:
        """A new run of level 0 of rows (t, keys, counts, weights), one for each range."""
        self.live = [*self.live, self._write(rows, 0)]
        self._say()
        self.compact()

    def compact(self) -> None:
        level = 0
        while some := [r for r in self.live if r[0] == level]:
            if len(some) >= self.fanout:
                merged = self.merged

                def one(t: pa.Table) -> pa.Table:
                    return _rows(t["t"][0].as_py(), [(RUN, *merged(*_arrays(t)))])

                run = self._write(self.rows(some).groupBy("t").applyInArrow(one, RUNS), level + 1)
                self.live = [r for r in self.live if r not in some] + [run]
                self._say()
                for k, n in some:
                    drop_dir(self.spark, f"{self.path}/runs/level={k}/seq={n}")
            level += 1


def ingest(store: RunStore, batch: DataFrame) -> DataFrame:
    """Add a batch, rows of SOURCES, to a store of fingerprints. Returns rows (t, kind, keys, counts, weights) of those now
    known as repeated that the batch holds, be it within the batch or against what came before."""
    new = batch.select("t", "keys", "counts", "weights")
    done = kept(new.groupBy("t").cogroup(store.rows().groupBy("t")).applyInArrow(_ingest, RUNS), "ingested")
    store.add(done.filter(F.col("kind") == RUN))
    return done.filter(F.col("kind") == REPEATED)


def _route(table: pa.Table) -> pa.Table:
    """What each bucket holds of the repeated fingerprints of a range."""
    t = table["t"][0].as_py()
    keys, _, weights = merge(*_arrays(table, -1))
    out = []
    src, held = table["src"].to_pylist(), blobs(table["keys"])
    for s, k in zip(src, held, strict=True):
        if s >= 0:
            k = u64(k)
            if len(k := k[is_in(k, keys)]):
                out.append((s, k, weights[np.searchsorted(keys, k)]))
    return pa.table(
        {
            "t": pa.array([t] * len(out), pa.int32()),
            "src": pa.array([s for s, _, _ in out], pa.int32()),
            "keys": pa.array([k.tobytes() for _, k, _ in out], pa.binary()),
            "weights": pa.array([w.tobytes() for _, _, w in out], pa.binary()),
        }
    )


def repeated(sources: DataFrame, batches: int, ranges: int, store: RunStore | None = None) -> DataFrame:
    """(t, src, keys, weights): for each bucket the fingerprints that occur at least twice in all, in the store too.

    sources: rows of SOURCES, already written. The buckets arrive in `batches` batches, as the daily loads of a
    growing corpus do, and each is deduplicated against all before it. Without a store one is made for them.
    """
    spark = sources.sparkSession
    own = RunStore.create(spark, shared_dir(spark, "index"), ranges, fanout=2) if store is None else store
    hits = None
    for b in range(batches):
        found = ingest(own, sources.filter(F.pmod(F.col("src"), F.lit(batches)) == b))
        hits = found if hits is None else hits.unionByName(found)
    if store is None:
        own.close()
    rows = sources.unionByName(hits.select("t", F.lit(-1).alias("src"), "keys", F.lit(b"").alias("counts"), "weights").withColumn("counts", F.expr("cast(repeat('0', int(length(keys) / 8)) as binary)")))
    return kept(rows.groupBy("t").applyInArrow(_route, "t int, src int, keys binary, weights binary"), "repeats")
