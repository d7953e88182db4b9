"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: a shard is one row with the sorted terms
of some hundred thousand words, and for each term the positions where it stands. Test
windows are looked up from their rarest terms: the positions of a rare term
are intersected with the offset-adjusted positions of the words beside it, one
word further at each step, until a list is empty or a window is complete. No
posting leaves its shard; what the shards are told is the test set, in blocks
of bounded size, one after another. A shard looks up the rarest terms of all
windows of a block at once and goes on with those that it holds.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaria.llm.arrays import ALNUM, LOWER, U64, chunks, cover, flat, word_values, words
from sonaria.llm.common import bound_batches, kept

INDEX = "shard long, doc_ids array<long>, word_offsets binary, terms binary, cuts binary, postings binary"
OUT = "shard long, row long, doc_id long, n_words long, hits array<struct<item_id:long,start:long,end:long>>, near array<long>"
#: Words of test items that are sent to the shards at once.
BLOCK_WORDS = 1 << 20


def terms_of(column: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, term of each word, word offsets) for each chunk of whole texts."""
    for i, j, buf, offsets in chunks(*flat(column), limit):
        low = LOWER[buf]
        start, end, of = words(low, offsets, ALNUM)
        yield i, j, word_values(low, start, end), of


def build_index(docs: DataFrame, shard_bytes: int = 1 << 21) -> DataFrame:
    """Postings of every word of every text, a row for each shard."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0)
            for i, j, term, of in terms_of(batch.column(1), shard_bytes):
                order = np.argsort(term, kind="stable")
                ordered = term[order]
                cut = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(term) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([n], pa.int64()),
                        pa.array([ids.slice(i, j - i).to_pylist()], pa.list_(pa.int64())),
                        pa.array([of.astype(np.int64).tobytes()], pa.binary()),
                        pa.array([ordered[cut].tobytes()], pa.binary()),
                        pa.array([np.append(cut, len(term)).astype(np.int64).tobytes()], pa.binary()),
                        pa.array([order.astype(np.int32).tobytes()], pa.binary()),
                    ],
                    ["shard", "doc_ids", "word_offsets", "terms", "cuts", "postings"],
                )
                n += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(shards, INDEX)


class Shard:
    def __init__(self, row: dict) -> None:
        self.ids = row["doc_ids"]
        self.of = np.frombuffer(row["word_offsets"], np.int64)
        self.terms = np.frombuffer(row["terms"], U64)
        self.cuts = np.frombuffer(row["cuts"], np.int64)
        self.postings = np.frombuffer(row["postings"], np.int32)

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term in the shard, -1 if it has none."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        k = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[k] == terms, k, -1)

    def of_term(self, k: int) -> np.ndarray:
        return self.postings[self.cuts[k] : self.cuts[k + 1]] if k >= 0 else self.postings[:0]


def _frequency(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """How often each test term occurs in the whole index."""
    told = index.sparkSession.sparkContext.broadcast(terms)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(told.value), np.int64)
        for batch in batches:
            for t, c in zip(batch.column(0), batch.column(1), strict=True):
                cuts = np.frombuffer(c.as_buffer(), np.int64)
                held = np.frombuffer(t.as_buffer(), U64)
                if len(held):
                    k = np.minimum(np.searchsorted(held, told.value), len(held) - 1)
                    total += np.where(held[k] == told.value, np.diff(cuts)[k], 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["k", "n"])

    rows = index.select("terms", "cuts").mapInArrow(counts, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    out = {int(r.k): int(r.n) for r in rows.collect()}  # at most a row for each test term of the block
    told.destroy()
    return out


def _plan(items: list[tuple[int | None, np.ndarray]], frequency: dict[int, int], terms: np.ndarray, k: int) -> list[tuple]:
    """(item_id, its terms, window length, places of the rarest term of every window) of items that can occur."""
    out = []
    for item, term in items:
        n = np.array([frequency.get(int(x), 0) for x in np.searchsorted(terms, term)])
        w = min(k, len(term))
        rarest = {i + int(np.argmin(n[i : i + w])) for i in range(len(term) - w + 1)}
        out.append((item, term, w, sorted(q for q in rarest if n[q])))
    return [x for x in out if x[3]]


def _exact(shard: Shard, numbers: np.ndarray, q: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the matching words around each place of word q that complete a window."""
    at = shard.of_term(numbers[q]).astype(np.int64)
    if not len(at):
        return at, at
    doc = np.searchsorted(shard.of, at, "right") - 1
    lo, hi = shard.of[doc], shard.of[doc + 1]
    reach = []
    for step, last in ((-1, q), (1, len(numbers) - 1 - q)):
        r, live = np.zeros(len(at), np.int64), np.arange(len(at))
        for d in range(1, min(last, w - 1) + 1):
            p = at[live] + step * d
            live = live[(p >= lo[live]) & (p < hi[live])]
            beside = shard.of_term(numbers[q + step * d])
            if not len(live) or not len(beside):
                break
            p = at[live] + step * d
            found = np.minimum(np.searchsorted(beside, p), len(beside) - 1)
            live = live[beside[found] == p]
            r[live] = d
        reach.append(r)
    whole = reach[0] + reach[1] + 1 >= w
    return (at - reach[0])[whole], (at + reach[1] + 1)[whole]


def _near(shard: Shard, numbers: np.ndarray, q: int, w: int, slop: int) -> np.ndarray:
    """Documents where each word of a window around word q stands at most slop places from where it should."""
    at = shard.of_term(numbers[q]).astype(np.int64)
    doc = np.searchsorted(shard.of, at, "right") - 1
    fits = []
    for j in range(max(0, q - w + 1), min(len(numbers), q + w)):
        beside = shard.of_term(numbers[j])
        if not len(beside) or not len(at):
            fits.append(np.zeros(len(at), bool))
            continue
        want = at + (j - q)
        k = np.searchsorted(beside, np.maximum(want - slop, shard.of[doc]))
        place = beside[np.minimum(k, len(beside) - 1)]
        fits.append((k < len(beside)) & (place <= np.minimum(want + slop, shard.of[doc + 1] - 1)))
    run, good = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    for f in fits:
        run = np.where(f, run + 1, 0)
        good |= run >= w
    return np.unique(doc[good])


class Block:
    """What the shards are told of a block of test items: the items, and by rarest term where it stands in them."""

    def __init__(self, plan: list[tuple]) -> None:
        self.items = [(item, term, w) for item, term, w, _ in plan]
        at = [(int(term[q]), k, q) for k, (_, term, _, places) in enumerate(plan) for q in places]
        at.sort()
        self.rarest, first = np.unique(np.array([t for t, _, _ in at], U64), return_index=True)
        self.cuts = np.append(first, len(at))
        self.places = np.array([x[1:] for x in at], np.int64).reshape(-1, 2)

    def held(self, shard: Shard) -> Iterator[tuple[int, list[int]]]:
        """(item's number, places of its rarest terms) for the items with a rarest term in the shard."""
        some = np.flatnonzero(shard.numbers(self.rarest) >= 0)
        if len(some):
            places = np.concatenate([self.places[self.cuts[k] : self.cuts[k + 1]] for k in some])
            places = places[np.lexsort((places[:, 1], places[:, 0]))]
            cut = np.flatnonzero(np.concatenate([[True], places[1:, 0] != places[:-1, 0], [True]]))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                yield int(places[a, 0]), places[a:b, 1].tolist()


def _search(index: DataFrame, told, slop: int) -> DataFrame:
    """The hits of a broadcast Block in every shard."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = told.value
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                shard = Shard(row)
                hits: list[list] = [[] for _ in shard.ids]
                near: list[set] = [set() for _ in shard.ids]
                for n, places in block.held(shard):
                    item, term, w = block.items[n]
                    numbers = shard.numbers(term)
                    found = [_exact(shard, numbers, q, w) for q in places]
                    start, end = (np.concatenate([f[x] for f in found]) for x in (0, 1))
                    doc = np.searchsorted(shard.of, start, "right") - 1
                    for d in np.unique(doc):
                        mine = doc == d
                        base, size = shard.of[d], shard.of[d + 1] - shard.of[d]
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], cover(start[mine] - base, end[mine] - base, size).astype(np.int8), [0]])))
                        hits[d] += [{"item_id": item, "start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]
                    if slop:
                        for q in places:
                            for d in _near(shard, numbers, q, w, slop):
                                near[d].add(item)
                size = np.diff(shard.of)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * len(size), pa.int64()),
                        pa.array(np.arange(len(size)), pa.int64()),
                        pa.array(shard.ids, pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array(hits, pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array([sorted(x, key=lambda i: (i is None, i)) for x in near], pa.list_(pa.int64())),
                    ],
                    ["shard", "row", "doc_id", "n_words", "hits", "near"],
                )

    return index.mapInArrow(look, OUT)


def _found(index: DataFrame, plan: list[tuple], slop: int) -> DataFrame:
    """The hits of a block, written; the block then leaves the driver and the executors."""
    told = index.sparkSession.sparkContext.broadcast(Block(plan))
    done = kept(_search(index, told, slop), "hits")
    told.destroy()
    return done


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """The test items' terms, in blocks of a bounded number of words."""
    block, n = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        for _, _, term, _ in terms_of(pa.array([r.text], pa.string()), 1):
            if len(term):
                block.append((r.item_id, term))
                n += len(term)
        if n >= BLOCK_WORDS:
            yield block
            block, n = [], 0
    if block:
        yield block


def find(docs: DataFrame, benchmark: DataFrame, k: int = 10, slop: int = 0) -> DataFrame:
    """Where the test items' windows of k words occur.

    docs: doc_id, text. benchmark: item_id, text. Other columns are ignored. A-Z count as a-z; an item of fewer
    than k words is one window, one without words has none. Returns a row for each row of docs: shard and row
    (its place in the index), doc_id, n_words, hits (item_id and the word spans its windows cover, end exclusive),
    near (item_ids with a window whose words all stand at most `slop` places from where they should; empty
    without slop). Null texts have no words; null ids stay null; equal rows and equal items each count; an empty
    table gives no rows or no hits; texts of any length are read whole. The result is written.
    """
    bound_batches(docs.sparkSession)
    index = kept(build_index(docs), "postings")
    found = []
    for items in _blocks(benchmark):
        terms = np.unique(np.concatenate([t for _, t in items]))
        found.append(_found(index, _plan(items, _frequency(index, terms), terms, k), slop))
    if len(found) <= 1:
        return found[0] if found else _found(index, [], 0)
    done = functools.reduce(DataFrame.unionByName, found)
    merged = done.groupBy("shard", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("near")).alias("near"))
    return merged.select("shard", "row", "doc_id", "n_words", "hits", "near")


def covered(hits: str = "hits") -> str:
    """SQL: how many words the spans of all items cover."""
    return f"""aggregate(array_sort(transform({hits}, h -> struct(h.start as start, h.end as end))), struct(0L as n, 0L as upto),
        (a, s) -> struct(a.n + greatest(0L, s.end - greatest(a.upto, s.start)) as n, greatest(a.upto, s.end) as upto), a -> a.n)"""
