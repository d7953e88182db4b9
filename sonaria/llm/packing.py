"""Packing of token sequences by bin completion.

Documents are cut into pieces of at most `capacity` tokens. Which pieces share
a sequence depends on their lengths only, so the search runs on the table of
lengths (at most `capacity` rows): around the longest remaining piece, branch
and bound enumerates the undominated fillings of the free room, the best-fit
filling being the first incumbent; a filling is used as often as the lengths
allow. The pieces then find their sequence and offset by their rank among the
pieces of their length, in parallel.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonaria.llm.arrays import chunks, flat
from sonaria.llm.common import bound_batches, kept, partitions
from sonaria.llm.tokens import Encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, copy long"
#: Fillings that the search around one piece may look at before sums of the lengths decide.
NODES = 400


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """A row for each piece. Of a longer document the first piece takes the remainder, the others are full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder.at(tokenizer)
        for batch in batches:
            ids = batch.column(0)
            for i, j, buf, offsets in chunks(*flat(batch.column(1)), 1 << 20):
                token, of = encoder.ids(buf, offsets)
                rows = []
                for k in range(j - i):
                    own = np.append(token[of[k] : of[k + 1]], np.uint32(end_id)).astype("<u4")
                    first = (len(own) - 1) % capacity + 1
                    cut = [0, *range(first, len(own) + 1, capacity)]
                    data = own.tobytes()
                    rows += [(i + k, p, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
                row, piece, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), batch.column(2).take(pa.array(row))], ["doc_id", "piece", "start", "length", "ids_crc32", "copy"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("copy")).mapInArrow(run, PIECES)


def complete(count: np.ndarray, room: int, top: int) -> list[tuple[int, int]]:
    """The fullest filling of `room` from the lengths that are left (count[length], none above top).

    Branches take the longest length that fits, as often as possible first, then fewer times; a filling that
    could take one more piece is dominated and never kept. A search of more than NODES fillings ends, and the sums
    that the lengths can reach tell the fullest filling. Returns (length, times), longest first.
    """
    lengths = np.flatnonzero(count[: min(room, top) + 1])
    if not len(lengths):
        return []
    smallest = int(lengths[0])
    total = np.concatenate([[0], np.cumsum(lengths * count[lengths])])
    best: list = [room + 1, []]
    nodes = [0]

    def go(free: int, upto: int, chosen: list[tuple[int, int]]) -> bool:
        """Fill from lengths below index upto; True when the search is over."""
        nodes[0] += 1
        k = min(int(np.searchsorted(lengths, free, "right")), upto)
        if free < best[0] and (k == 0 or free < smallest):
            best[0], best[1] = free, list(chosen)
        if best[0] == 0 or nodes[0] > NODES:
            return True
        while k > 0 and free - total[k] < best[0]:  # the bound: even all shorter ones leave more waste
            k -= 1
            size = int(lengths[k])
            for times in range(min(free // size, int(count[size])), 0, -1):
                if go(free - times * size, k, [*chosen, (size, times)]):
                    return True
        if k == 0 and free < best[0]:
            best[0], best[1] = free, list(chosen)
        return False

    go(room, len(lengths), [])
    return best[1] if best[0] == 0 or nodes[0] <= NODES else fullest(count, room, top)


def fullest(count: np.ndarray, room: int, top: int) -> list[tuple[int, int]]:
    """The fullest filling by the sums up to `room` that the lengths can reach: bits of one number, a step for each
    length and each of the halved times that it is there."""
    reach, steps = 1, []
    for size in np.flatnonzero(count[: min(room, top) + 1]).tolist()[::-1]:
        left, times = min(int(count[size]), room // size), 1
        while left:
            times = min(times, left)
            steps.append((reach, size, times))
            reach |= (reach << (size * times)) & ((2 << room) - 1)
            left, times = left - times, times * 2
    at, use = reach.bit_length() - 1, {}
    for before, size, times in reversed(steps):
        if not before >> at & 1:
            at -= size * times
            use[size] = use.get(size, 0) + times
    return sorted(use.items(), reverse=True)


def plan(count: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, filling) until no piece is left. The lengths run out one by one, so there are at most about
    capacity * ln(capacity) entries, however many pieces there are."""
    count = count.copy()
    out = []
    top = len(count) - 1
    while True:
        while top > 0 and not count[top]:
            top -= 1
        if top <= 0:
            return out
        count[top] -= 1
        filling = complete(count, capacity - top, top)
        count[top] += 1
        use: dict[int, int] = {top: 1}
        for size, times in filling:
            use[size] = use.get(size, 0) + times
        n = min(int(count[size]) // times for size, times in use.items())
        for size, times in use.items():
            count[size] -= n * times
        out.append((n, sorted(use.items(), reverse=True)))


def slots(fillings: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> dict[str, np.ndarray]:
    """For each length the ranks that each filling takes, ordered by (length, first rank)."""
    used = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for n, filling in fillings:
        at = 0
        for size, times in filling:
            rows.append((size, used[size], sequence, times, at))
            used[size] += n * times
            at += size * times
        sequence += n
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "times", "offset"), a.T.copy(), strict=True))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pack all documents into as few sequences of at most `capacity` tokens as the search can.

    docs: doc_id, text; other columns are ignored. A document's tokens are its text's ids, then end_id; a null
    or empty text has end_id alone. Only documents of more than `capacity` tokens are cut. Returns a row for each
    piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Equal rows are packed as often as they
    occur; texts of any length are read whole; a null doc_id stays null; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    n = partitions(spark)
    all_pieces = kept(pieces(docs, tokenizer, capacity, end_id), "pieces").withColumn("salt", F.pmod(F.xxhash64("copy", "piece", "start"), F.lit(n)))
    per = all_pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = kept(per.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")), "lengths")
    count = np.zeros(capacity + 1, np.int64)
    for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        count[r.length] = r.n
    told = spark.sparkContext.broadcast(slots(plan(count, capacity), capacity))
    ranked = all_pieces.withColumn("at", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "copy"))).join(before.select("length", "salt", "before"), ["length", "salt"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = told.value
        key = (s["length"] << 44) | s["rank"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            k = np.searchsorted(key, (length << 44) | rank, "right") - 1
            r = rank - s["rank"][k]
            sequence = s["sequence"][k] + r // s["times"][k]
            offset = s["offset"][k] + r % s["times"][k] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("at") - 1).cast("long").alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
