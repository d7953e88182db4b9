"""Substring deduplication with a log-structured fingerprint index.

A window is `window` consecutive words of one text. Every window is named by a
fingerprint, the smallest hash of its `gram`-word sequences; neighbouring
windows mostly share it, and equal windows always do. The index keeps the
fingerprints as sorted immutable runs, merge-joins each new batch with them
and compacts them. Windows with a repeated fingerprint are then verified: all
their words go into a 96-bit hash, and only windows whose hash occurs twice
count as repeated.

An Index outlives a run: it also keeps the 96-bit hashes of all windows, in a
second store of runs, so that a later load is verified against earlier ones
without their texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.llm.arrays import SPACED, U64, Rolling, chunks, cover, distinct, flat, invalid_starts, is_in, runs, winnow, word_values, words
from sonaria.llm.common import bound_batches, bucket, buckets, kept
from sonaria.llm.exchange import SOURCES, RunStore, blobs, pieces, ranges_for, repeated, source_rows, u64

OUT = "doc_id long, n_words long, removed array<struct<start:long,end:long>>, kept string"
SENT = "t int, src int, h1 binary, h2 binary, counts binary"
SIDE = "src int, t int, keys binary, bits binary"


def _fingerprints(table: pa.Table, window: int, gram: int, ranges: int) -> pa.Table:
    src = table["b"][0].as_py()
    found = []
    for _, _, buf, offsets in chunks(*flat(table["text"])):
        start, end, of = words(buf, offsets, SPACED)
        _, _, anchors = winnow(word_values(buf, start, end), of, window, gram)
        found.append(anchors)
    keys, n = distinct(np.concatenate(found))
    return source_rows(src, keys, n, n, ranges)


class _Candidates:
    """The windows of a bucket whose fingerprint is repeated, and their distinct hashes in order."""

    def __init__(self, texts: pa.ChunkedArray, keys: np.ndarray, window: int, gram: int) -> None:
        self.parts = []
        h1, h2 = [np.zeros(0, U64)], [np.zeros(0, np.uint32)]
        for i, j, buf, offsets in chunks(*flat(texts)):
            start, end, of = words(buf, offsets, SPACED)
            values = word_values(buf, start, end)
            least, bad, _ = winnow(values, of, window, gram)
            at = np.flatnonzero(is_in(least, keys) & ~bad)
            if len(at):
                h1.append(Rolling(values, 0).windows(window)[at])
                h2.append((Rolling(values, 1).windows(window)[at] >> U64(32)).astype(np.uint32))
            self.parts.append((i, j, buf, offsets, start, end, of, at))
        h1, h2 = np.concatenate(h1), np.concatenate(h2)
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])[: len(h1)]
        self.h1, self.h2 = h1[new], h2[new]
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.counts = np.bincount(self.number, minlength=len(self.h1))


def _keys(table: pa.Table) -> np.ndarray:
    return np.sort(np.concatenate([np.zeros(0, U64), *(u64(k) for k in blobs(table["keys"]) if k is not None)]))


def _send(docs: pa.Table, side: pa.Table, window: int, gram: int, ranges: int) -> pa.Table:
    schema = pa.schema([("t", pa.int32()), ("src", pa.int32()), ("h1", pa.binary()), ("h2", pa.binary()), ("counts", pa.binary())])
    if not len(docs) or not len(side):
        return schema.empty_table()
    c = _Candidates(docs["text"], _keys(side), window, gram)
    src = docs["b"][0].as_py()
    cut = pieces(c.h1, ranges)
    return pa.table([[t for t, _ in cut], [src] * len(cut), [c.h1[s].tobytes() for _, s in cut], [c.h2[s].tobytes() for _, s in cut], [np.minimum(c.counts[s], 2).astype(np.uint8).tobytes() for _, s in cut]], schema=schema)


def _verify(table: pa.Table, past: pa.Table | None = None) -> pa.Table:
    """Which windows of a range occur at least twice, in past runs too, told to each bucket as bits in the order it sent
    them."""
    if not len(table):
        return pa.schema([("src", pa.int32()), ("t", pa.int32()), ("keys", pa.binary()), ("bits", pa.binary())]).empty_table()
    t = table["t"][0].as_py()
    h1 = [u64(x) for x in blobs(table["h1"])]
    size = [len(x) for x in h1]
    old = [] if past is None else [(u64(k), np.frombuffer(w, np.uint64).astype(np.uint32)) for k, w in zip(blobs(past["keys"]), blobs(past["weights"]), strict=True)]
    a = np.concatenate([*h1, *(k for k, _ in old)])
    b = np.concatenate([*(np.frombuffer(x, np.uint32) for x in blobs(table["h2"])), *(w for _, w in old)])
    n = np.concatenate([*(np.frombuffer(x, np.uint8) for x in blobs(table["counts"])), *(np.ones(len(k), np.uint8) for k, _ in old)])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    total = np.add.reduceat(n[order].astype(np.int64), np.flatnonzero(new))
    again = np.empty(len(order), bool)
    again[order] = (total >= 2)[np.cumsum(new) - 1]
    bits = [np.packbits(x).tobytes() for x in np.split(again, np.cumsum(size))[:-1]]
    return pa.table([table["src"], [t] * len(size), [None] * len(size), bits], schema=pa.schema([("src", pa.int32()), ("t", pa.int32()), ("keys", pa.binary()), ("bits", pa.binary())]))


def _remove(docs: pa.Table, side: pa.Table, window: int, gram: int, ranges: int) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])
    if not len(docs):
        return schema.empty_table()
    c = _Candidates(docs["text"], _keys(side), window, gram)
    bits = {t: b for t, b in zip(side["t"].to_pylist(), side["bits"].to_pylist(), strict=True) if b is not None}
    again = np.zeros(len(c.h1), bool)
    for t, s in pieces(c.h1, ranges):
        again[s] = np.unpackbits(np.frombuffer(bits[t], np.uint8), count=s.stop - s.start).astype(bool)
    again = again[c.number]
    out, k = [], 0
    ids = docs["doc_id"].combine_chunks()
    for i, j, buf, offsets, start, end, of, at in c.parts:
        hit = at[again[k : k + len(at)]]
        k += len(at)
        gone = cover(hit, hit + window, len(start))
        out.append(pa.table([ids.slice(i, j - i), np.diff(of), spans(gone, of), keep_words(buf, start, end, of, ~gone)], schema=schema))
    return pa.concat_tables(out)


def spans(gone: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """The runs of true values within each text, as positions in that text."""
    edge = np.zeros(len(gone) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], gone])
    now = np.concatenate([gone, [False]])
    first = np.flatnonzero(now & (~before | edge))
    last = np.flatnonzero(before & (~now | edge))
    row = np.searchsorted(offsets, first, "right") - 1
    base = offsets[row]
    of = np.searchsorted(first, offsets).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.StructArray.from_arrays([pa.array(first - base, pa.int64()), pa.array(last - base, pa.int64())], ["start", "end"]))


def keep_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> pa.StringArray:
    """The kept words of each text, joined by one space."""
    s, e = start[keep], end[keep]
    d = np.zeros(len(buf) + 1, np.int8)
    d[s] += 1
    d[e] -= 1
    of = np.concatenate([[0], np.cumsum(keep)])[offsets]
    size = e - s + 1
    last = of[1:][of[1:] > of[:-1]] - 1
    size[last] -= 1
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.full(at[-1], 0x20, np.uint8)
    inner = np.ones(at[-1], bool)
    gap = np.ones(len(s), bool)
    gap[last] = False
    inner[at[1:][gap] - 1] = False
    out[inner] = buf[np.cumsum(d[:-1]).astype(bool)]
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(at[of].astype(np.int32)), pa.py_buffer(out))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One sorted run of window hashes from several, each pair of hashes once."""
    a, b = (np.concatenate([np.zeros(0, U64), *x]) for x in (keys, weights))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], np.ones(int(new.sum()), np.uint8), b[new]


def _hashes(table: pa.Table, window: int, ranges: int) -> pa.Table:
    """Rows of SOURCES for all windows of a bucket: the first hash is the key, the second the weight."""
    first, second = [np.zeros(0, U64)], [np.zeros(0, np.uint64)]
    for _, _, buf, offsets in chunks(*flat(table["text"])):
        start, end, of = words(buf, offsets, SPACED)
        values = word_values(buf, start, end)
        good = ~invalid_starts(len(values), of, window)
        first.append(Rolling(values, 0).windows(window)[good])
        second.append(Rolling(values, 1).windows(window)[good] >> U64(32))
    a, n, b = _merged(first, [], second)
    return source_rows(table["b"][0].as_py(), a, n, b, ranges)


def _one_run(table: pa.Table) -> pa.Table:
    keys, _, weights = ([x(b) for b in blobs(table[c])] for c, x in (("keys", u64), ("counts", bytes), ("weights", u64)))
    a, n, b = _merged(keys, [], weights)
    return pa.table({"t": table["t"][:1], "keys": pa.array([a.tobytes()], pa.binary()), "counts": pa.array([n.tobytes()], pa.binary()), "weights": pa.array([b.tobytes()], pa.binary())})


class Index:
    """What loads before held, at a path that the driver and all executors see.

    `window`, `gram` and the number of ranges stay as they were at its creation; `ranges` is best chosen for the corpus
    to come, some 10,000 for a terabyte. A load counts once dedup() has returned; one that broke off can be repeated,
    as fingerprints alone remove nothing.
    """

    def __init__(self, fingerprints: RunStore, windows: RunStore) -> None:
        self.fingerprints, self.windows = fingerprints, windows

    @classmethod
    def create(cls, spark: SparkSession, path: str, ranges: int, fanout: int = 4) -> Index:
        return cls(RunStore.create(spark, f"{path}/fingerprints", ranges, fanout), RunStore.create(spark, f"{path}/windows", ranges, fanout, _merged))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        return cls(RunStore.open(spark, f"{path}/fingerprints"), RunStore.open(spark, f"{path}/windows", _merged))

    def close(self) -> None:
        self.fingerprints.close()
        self.windows.close()


def dedup(docs: DataFrame, window: int = 35, gram: int = 10, batches: int = 3, index: Index | None = None) -> DataFrame:
    """Remove every word that a repeated window covers.

    docs: doc_id, text; other columns are ignored. A window is repeated if its word sequence also starts
    anywhere else, in the same text too; windows are judged on the input. Returns a row for each row of docs:
    doc_id, n_words, removed (word spans, end exclusive), kept (the other words joined by one space). A null
    text has no words; a text of fewer words than a window loses none; rows that are repeated whole remove each
    other's windows; texts of any length are read whole; a null doc_id stays null; an empty table gives an empty
    result. With an index, windows that earlier loads held are repeated too, and docs are added to it; the result
    is then written.
    """
    bound_batches(docs.sparkSession)
    n = ranges_for(docs) if index is None else index.fingerprints.ranges
    d = docs.select(bucket(F.concat_ws(" ", F.xxhash64("doc_id"), F.xxhash64("text")), buckets(docs)).alias("b"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sources = kept(d.groupBy("b").applyInArrow(lambda t: _fingerprints(t, window, gram, n), SOURCES), "sources")
    flagged = repeated(sources, batches, n, None if index is None else index.fingerprints)
    side = flagged.select("src", "t", "keys")
    sent = d.groupBy("b").cogroup(side.groupBy("src")).applyInArrow(lambda a, b: _send(a, b, window, gram, n), SENT)
    if index is None:
        bits = sent.groupBy("t").applyInArrow(lambda t: _verify(t), SIDE)
    else:
        bits = sent.groupBy("t").cogroup(index.windows.rows().groupBy("t")).applyInArrow(_verify, SIDE)
    side = side.withColumn("bits", F.lit(None).cast("binary")).unionByName(bits)
    out = d.groupBy("b").cogroup(side.groupBy("src")).applyInArrow(lambda a, b: _remove(a, b, window, gram, n), OUT)
    if index is not None:
        out = kept(out, "deduplicated")
        every = d.groupBy("b").applyInArrow(lambda t: _hashes(t, window, n), SOURCES)
        index.windows.add(every.groupBy("t").applyInArrow(_one_run, "t int, keys binary, counts binary, weights binary"))
    return out
