"""Exact substring deduplication with longest-previous-factor arrays.

The longest previous factor of a position is the longest string that starts
there and also starts earlier. It is read off the suffix order: of all earlier
positions, the previous and the next smaller position in that order share the
longest prefix. Likewise the previous and the next larger position give the
longest next factor. A position whose factor has `length` bytes starts a repeat.

A suffix array over all texts would not fit one machine, so texts are cut into
contexts that need one another only: each `length`-byte window is named by the
smallest hash of its `gram`-byte substrings, which equal windows share, and a
context is a maximal run of windows with one name. Contexts whose name occurs
once hold no repeat. The others meet by name; equal contexts are repeats as a
whole, and the factors of the remaining ones are computed together, up to
`length` bytes, as longer ones tell nothing more. Names with more than `split`
bytes of contexts are split by a longer prefix, all bytes of a window: what
meets then is equal in `length` bytes, so every factor but the first has them,
and such groups are spread over all ranges of the hash space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaria.llm.arrays import BYTE_VALUES, U64, Rolling, chunks, cover, distinct, flat, is_in, winnow
from sonaria.llm.common import bound_batches, bucket, buckets, kept
from sonaria.llm.exchange import SOURCES, blobs, pieces, ranges_for, repeated, source_rows, u64
from sonaria.llm.substring_dedup import spans

OUT = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"
SENT = "t int, src int, kind int, fp binary, size binary, h1 binary, h2 binary, counts binary, data binary, who binary"
SIDE = "src int, t int, kind int, keys binary, weights binary, a binary, b binary, c binary"
FLAGGED, CONTEXTS, WINDOWS = 0, 1, 2
#: Bytes of contexts whose suffixes are sorted at once.
SORTED = 1 << 18
#: Bytes of texts that are hashed at once, longer texts apart.
HASHED = 1 << 18


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    k = key[order]
    rank = np.empty(len(key), np.uint32)
    rank[order] = np.cumsum(np.concatenate([[False], k[1:] != k[:-1]]), dtype=np.uint32)
    return rank


def _pair(rank: np.ndarray, by: int) -> np.ndarray:
    """Order by two prefixes, the second `by` bytes further on; past the end nothing is smallest."""
    nxt = np.zeros(len(rank), U64)
    if by < len(rank):
        nxt[:-by] = rank[by:]
        nxt[:-by] += U64(1)
    return (rank.astype(U64) << U64(32)) | nxt


def _first_rank(data: np.ndarray) -> np.ndarray:
    """Rank by the next 4 bytes; past the end sorts first."""
    wide = np.zeros(len(data) + 4, U64)
    wide[: len(data)] = data.astype(U64) + U64(1)
    key = np.zeros(len(data), U64)
    for j in range(4):
        key = (key << U64(9)) | wide[j : j + len(data)]
    return _dense(key)


def _ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(h, rank of each suffix by its first h bytes) for h of 4, 8 and so on up to length."""
    levels = [(4, _first_rank(data))]
    while levels[-1][0] * 2 <= length:
        h, rank = levels[-1]
        levels.append((h * 2, _dense(_pair(rank, h))))
    return levels


def _common(levels: list[tuple[int, np.ndarray]], data: np.ndarray, i: np.ndarray, j: np.ndarray, length: int) -> np.ndarray:
    """The common prefix lengths of suffixes i and j, up to length."""
    n, i, j, lcp = len(data), i.copy(), j.copy(), np.zeros(len(i), np.int64)
    for h, rank in reversed(levels):
        while True:  # the longest step can be taken again
            same = (i + h <= n) & (j + h <= n) & (lcp < length)
            same &= rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)]
            i, j, lcp = i + h * same, j + h * same, lcp + h * same
            if h < levels[-1][0] or not same.any():
                break
    live = np.ones(len(i), bool)
    for _ in range(3):  # less than the 4 bytes of the first level are left
        live &= (i < n) & (j < n)
        live &= data[np.minimum(i, n - 1)] == data[np.minimum(j, n - 1)]
        i, j, lcp = i + live, j + live, lcp + live
    return np.minimum(lcp, length)


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(the starts, ascending, in order of the `length` bytes from there and then of their place, common prefix length
    of each with the one before it in that order, up to length)."""
    if not len(starts):
        return starts, np.zeros(0, np.int64)
    levels = _ranks(data, length)
    h, rank = levels[-1]
    key = (_pair(rank, length - h) if h < length else rank)[starts]
    order = starts[np.argsort(key, kind="stable")]
    return order, np.concatenate([[0], _common(levels, data, order[:-1], order[1:], length)])


def _smaller(sa: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in order, the nearest earlier place with a smaller position (-1: none), and the least common
    prefix on the way there, by jumping over places already known to be larger."""
    at, m = np.arange(len(sa)) - 1, least.copy()
    far = 1 + np.flatnonzero(sa[:-1] > sa[1:])
    while len(far):
        step = at[far]
        m[far] = np.minimum(m[far], m[step])
        at[far] = step = at[step]
        far = far[(step >= 0) & (sa[step] > sa[far])]
    return at, np.where(at >= 0, m, 0)


def _longest(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The longest factor that starts at a smaller position, for each place in order."""
    _, before = _smaller(order, lcp)
    _, after = _smaller(order[::-1], np.concatenate([lcp[1:], [0]])[::-1].copy())
    return np.maximum(before, after[::-1])


def factors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start (ascending, all `length` bytes inside one context) the lengths, up to `length`, of its longest
    previous factor and of its longest next factor among the starts."""
    order, lcp = suffix_order(data, starts, length)
    place = np.searchsorted(starts, order)
    previous, following = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    if len(starts):
        previous[place], following[place] = _longest(order, lcp), _longest(-order, lcp)
    return previous, following


def lpf(data: np.ndarray) -> np.ndarray:
    """The longest previous factor of every position."""
    n = len(data)
    return factors(data, np.arange(n), max(n, 4))[0]


def _runs_of(least: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) of each maximal run of used windows with one name."""
    if not len(least):
        z = np.zeros(0, np.int64)
        return z, z
    turn = np.concatenate([[True], (least[1:] != least[:-1]) | (use[1:] != use[:-1])])
    first = np.flatnonzero(turn)
    end = np.append(first[1:], len(least))
    u = use[first]
    return first[u], end[u]


def _fingerprints(table: pa.Table, length: int, gram: int, ranges: int) -> pa.Table:
    found, names, sizes = [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for _, _, buf, offsets in chunks(*flat(table["text"]), HASHED):
        least, bad, anchors = winnow(BYTE_VALUES[0][buf], offsets, length, gram)
        i, j = _runs_of(least, ~bad)
        for to, x in ((found, anchors), (names, least[i]), (sizes, j - i + length - 1)):
            to.append(x)
    keys, n = distinct(np.concatenate(found))
    weights = np.zeros(len(keys), np.uint64)
    if len(keys):
        np.add.at(weights, np.searchsorted(keys, np.concatenate(names)), np.concatenate(sizes).astype(np.uint64))
    return source_rows(table["b"][0].as_py(), keys, n, weights, ranges)


class _Contexts:
    """Contexts with a repeated name in a bucket, and the windows of those whose name is split, each once and in order.

    With `who`, what texts are ordered by, it is known which occurrence of each comes first in that order."""

    def __init__(self, docs: pa.Table, keys: np.ndarray, hot: np.ndarray, length: int, gram: int, keep_first: bool) -> None:
        self.parts = []
        texts = docs["text"]
        told = None
        if keep_first:
            ids = docs["doc_id"].combine_chunks()
            told = np.stack([ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy(), docs["x"].to_numpy()], 1)
        who, w_who = [np.zeros((0, 4), np.int64)], [np.zeros((0, 4), np.int64)]

        def placed(at: np.ndarray, offsets: np.ndarray, i: int) -> np.ndarray:
            row = np.searchsorted(offsets, at, "right") - 1
            return np.concatenate([told[i + row], (at - offsets[row])[:, None]], 1)

        fp, size, h1 = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, U64)]
        w1, w2 = [np.zeros(0, U64)], [np.zeros(0, np.uint32)]
        for i, j, buf, offsets in chunks(*flat(texts), HASHED):
            values = BYTE_VALUES[0][buf]
            least, bad, _ = winnow(values, offsets, length, gram)
            use = ~bad & is_in(least, keys)
            warm = use & is_in(least, hot)
            a, b = _runs_of(least, use & ~warm)
            b = b + length - 1
            if len(a):
                fp.append(least[a])
                size.append(b - a)
                h1.append(Rolling(values, 0).span(a, b))
                if keep_first:
                    who.append(placed(a, offsets, i))
            at = np.flatnonzero(warm)
            if len(at):
                w1.append(Rolling(values, 0).windows(length)[at])
                w2.append((Rolling(BYTE_VALUES[1][buf], 1).windows(length)[at] >> U64(32)).astype(np.uint32))
                if keep_first:
                    w_who.append(placed(at, offsets, i))
            self.parts.append((i, j, buf, offsets, a, b, at))
        self.fp, self.size, self.h1 = map(np.concatenate, (fp, size, h1))
        who, w_who = np.concatenate(who), np.concatenate(w_who)
        self.first, self.number = _distinct_rows(self.fp, self.size, self.h1, ties=who if keep_first else None)
        self.counts = np.bincount(self.number, minlength=len(self.first))
        self.fp, self.size, self.h1 = (x[self.first] for x in (self.fp, self.size, self.h1))
        self.w1, self.w2 = np.concatenate(w1), np.concatenate(w2)
        self.w_first, self.w_number = _distinct_rows(self.w1, self.w2, ties=w_who if keep_first else None)
        self.w_counts = np.bincount(self.w_number, minlength=len(self.w_first))
        self.w1, self.w2 = self.w1[self.w_first], self.w2[self.w_first]
        self.who, self.w_who = (who[self.first], w_who[self.w_first]) if keep_first else (None, None)

    def bytes_of(self) -> list[bytes]:
        """The distinct contexts themselves."""
        where = np.concatenate([np.zeros((0, 3), np.int64), *(np.stack([np.full(len(p[4]), k), p[4], p[5]], 1) for k, p in enumerate(self.parts))])
        return [self.parts[k][2][a:b].tobytes() for k, a, b in where[self.first]]


def _distinct_rows(*columns: np.ndarray, ties: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct one in order, the number of each row's distinct one). Of equal rows the one with the
    least ties is taken, else the first."""
    order = np.lexsort([*(ties.T[::-1] if ties is not None else ()), *columns[::-1]])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _names(side: pa.Table, hot: int) -> tuple[np.ndarray, np.ndarray]:
    rows = [(u64(k), np.frombuffer(w, np.uint64)) for k, w, kind in zip(blobs(side["keys"]), blobs(side["weights"]), side["kind"].to_pylist(), strict=True) if kind == FLAGGED]
    keys = np.concatenate([np.zeros(0, U64), *(k for k, _ in rows)])
    weights = np.concatenate([np.zeros(0, np.uint64), *(w for _, w in rows)])
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    return keys, keys[weights > hot]


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _send(docs: pa.Table, side: pa.Table, length: int, gram: int, hot: int, ranges: int, keep_first: bool) -> pa.Table:
    schema = _schema(SENT)
    if not len(docs) or not len(side):
        return schema.empty_table()
    src = docs["b"][0].as_py()
    c = _Contexts(docs, *_names(side, hot), length, gram, keep_first)
    data = c.bytes_of()
    rows = []
    for t, s in pieces(c.fp, ranges):
        rows.append((t, src, CONTEXTS, c.fp[s].tobytes(), c.size[s].tobytes(), c.h1[s].tobytes(), None, _times(c.counts[s]), b"".join(data[s]), c.who[s].tobytes() if keep_first else None))
    for t, s in pieces(c.w1, ranges):
        rows.append((t, src, WINDOWS, None, None, c.w1[s].tobytes(), c.w2[s].tobytes(), _times(c.w_counts[s]), None, c.w_who[s].tobytes() if keep_first else None))
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()


def _times(counts: np.ndarray) -> bytes:
    return np.minimum(counts, 2).astype(np.uint8).tobytes()


def _who(rows: list[dict], keep_first: bool) -> np.ndarray | None:
    return np.concatenate([np.frombuffer(r["who"], np.int64).reshape(-1, 4) for r in rows]) if keep_first else None


def _split(flags: np.ndarray, rows: list[dict]) -> list[bytes]:
    """Flags of all rows' entries as bits for each row."""
    return [np.packbits(x).tobytes() for x in np.split(flags, np.cumsum([r["counts"].size for r in rows])[:-1])]


def _windows(rows: list[dict], keep_first: bool) -> list[bytes]:
    """For each row: which of its windows are repeated, or, to keep the first, which are the first of all."""
    a = np.concatenate([u64(r["h1"]) for r in rows])
    b = np.concatenate([np.frombuffer(r["h2"], np.uint32) for r in rows])
    n = np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in rows])
    first, number = _distinct_rows(a, b, ties=_who(rows, keep_first))
    if keep_first:
        flag = np.zeros(len(a), bool)
        flag[first] = True
    else:
        flag = (np.bincount(number, n, len(first)) >= 2)[number]
    return _split(flag, rows)


def _contexts(rows: list[dict], length: int, keep_first: bool) -> list[tuple[bytes, bytes, bytes]]:
    """For each row: how many repeated ranges each of its contexts has, their bounds, and whether it is the first of all
    equal ones."""
    fp = np.concatenate([u64(r["fp"]) for r in rows])
    size = np.concatenate([np.frombuffer(r["size"], np.int64) for r in rows])
    h1 = np.concatenate([u64(r["h1"]) for r in rows])
    n = np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in rows])
    data = [np.frombuffer(r["data"], np.uint8) for r in rows]
    begin = np.concatenate([np.concatenate([[0], np.cumsum(np.frombuffer(r["size"], np.int64))[:-1]]) for r in rows])
    owner = np.repeat(np.arange(len(rows)), [r["counts"].size for r in rows])
    who = _who(rows, keep_first)
    first, number = _distinct_rows(fp, size, h1, ties=who)
    whole = np.bincount(number, n, len(first)) >= 2
    if keep_first:  # the first of equal contexts is judged by its factors, and the others go as a whole
        whole[:] = False
    ranges: list[np.ndarray] = [np.array([[0, s]]) if w else np.zeros((0, 2), np.int64) for w, s in zip(whole, size[first], strict=True)]
    name = fp[first]
    cut = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1], [True]]))
    todo: list[int] = []
    held = 0
    for g in range(len(cut) - 1):
        members = np.arange(cut[g], cut[g + 1])
        if not whole[members].all():
            todo += members[np.lexsort(who[first[members]].T[::-1])].tolist() if keep_first else members.tolist()
            held += int(size[first[members]].sum())
        if todo and (held >= SORTED or g == len(cut) - 2):
            _solve(todo, first, size, begin, owner, data, whole, ranges, length, keep_first)
            todo, held = [], 0
    flag = np.zeros(len(fp), bool)
    flag[first] = True
    out = []
    for k, bits in enumerate(_split(flag, rows)):
        mine = [ranges[m] for m in number[owner == k]]
        out.append((np.array([len(x) for x in mine], np.int64).tobytes(), np.concatenate(mine).astype(np.int64).tobytes(), bits))
    return out


def _solve(todo, first, size, begin, owner, data, whole, ranges, length, keep_first) -> None:
    rows = first[todo]
    sizes = size[rows]
    at = np.concatenate([[0], np.cumsum(sizes)])
    text = np.concatenate([data[owner[r]][begin[r] : begin[r] + size[r]] for r in rows])
    ok = np.ones(len(text) + 1, bool)
    ok[np.concatenate([np.arange(e - length + 1, e) for e in at[1:]])] = False
    starts = np.flatnonzero(ok[:-1])
    previous, following = factors(text, starts, length)
    hit = starts[(previous >= length) | (following >= length) & (not keep_first)]
    gone = cover(hit, hit + length, len(text))
    for k, m in enumerate(todo):
        if not whole[m]:
            g = np.flatnonzero(np.diff(np.concatenate([[0], gone[at[k] : at[k + 1]].astype(np.int8), [0]])))
            ranges[m] = g.reshape(-1, 2)


def _verify(table: pa.Table, length: int, keep_first: bool) -> pa.Table:
    names = table.column_names
    columns = [table[x].to_pylist() if pa.types.is_integer(table[x].type) else blobs(table[x]) for x in names]
    rows = [dict(zip(names, r, strict=True)) for r in zip(*columns, strict=True)]
    out = []
    if c := [r for r in rows if r["kind"] == CONTEXTS]:
        out += [(r["src"], r["t"], CONTEXTS, None, None, *x) for r, x in zip(c, _contexts(c, length, keep_first), strict=True)]
    if w := [r for r in rows if r["kind"] == WINDOWS]:
        out += [(r["src"], r["t"], WINDOWS, None, None, x, None, None) for r, x in zip(w, _windows(w, keep_first), strict=True)]
    schema = _schema(SIDE)
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _flags(bits: bytes, s: slice) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=s.stop - s.start).astype(bool)


def _remove(docs: pa.Table, side: pa.Table, length: int, gram: int, hot: int, ranges: int, keep_first: bool) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
    if not len(docs):
        return schema.empty_table()
    c = _Contexts(docs, *_names(side, hot), length, gram, keep_first)
    told = {(k, t): (a, b, f) for k, t, a, b, f in zip(*(side[x].to_pylist() for x in ("kind", "t", "a", "b", "c")), strict=True) if k != FLAGGED}
    n, bounds, least = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)], np.zeros(len(c.fp), bool)
    for t, s in pieces(c.fp, ranges):
        a, b, f = told[CONTEXTS, t]
        n.append(np.frombuffer(a, np.int64))
        bounds.append(np.frombuffer(b, np.int64).reshape(-1, 2))
        least[s] = _flags(f, s)
    n, bounds = np.concatenate(n), np.concatenate(bounds)
    upto = np.concatenate([[0], np.cumsum(n)])
    again = np.zeros(len(c.w1), bool)
    for t, s in pieces(c.w1, ranges):
        again[s] = _flags(told[WINDOWS, t][0], s)
    again = again[c.w_number]
    other = np.zeros(len(c.number), bool)  # contexts that go as a whole, as the first of their kind is elsewhere
    if keep_first:
        kept_one = np.zeros(len(c.number), bool)
        kept_one[c.first[least]] = True
        other = ~kept_one
        kept_one = np.zeros(len(c.w_number), bool)
        kept_one[c.w_first] = True
        again = ~(again & kept_one)
    out, k, m = [], 0, 0
    ids = docs["doc_id"].combine_chunks()
    for i, j, buf, offsets, a, b, at in c.parts:
        which, gone_whole = c.number[k : k + len(a)], other[k : k + len(a)]
        k += len(a)
        many = np.where(gone_whole, 0, n[which])
        row = np.repeat(upto[which], many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        base = np.repeat(a, many)
        hit = at[again[m : m + len(at)]]
        m += len(at)
        gone = cover(np.concatenate([base + bounds[row, 0], hit, a[gone_whole]]), np.concatenate([base + bounds[row, 1], hit + length, b[gone_whole]]), len(buf))
        of = np.concatenate([[0], np.cumsum(~gone)])[offsets]
        kept_bytes = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(of.astype(np.int32)), pa.py_buffer(buf[~gone])])
        out.append(pa.table([ids.slice(i, j - i), np.diff(offsets), spans(gone, offsets), kept_bytes], schema=schema))
    return pa.concat_tables(out)


def dedup(docs: DataFrame, length: int = 400, gram: int = 64, batches: int = 3, split: int = 1 << 19, keep_first: bool = False) -> DataFrame:
    """Remove every byte that a repeated `length`-byte string covers.

    docs: doc_id, text; other columns are ignored. A string is repeated if it also starts anywhere else, in the
    same text too; strings never cross texts and are judged on the input. Returns a row for each row of docs:
    doc_id, n_bytes, removed (byte spans, end exclusive), kept (the other bytes). A null text is empty; a text of
    fewer bytes than `length` loses none; rows that are repeated whole remove each other; a null doc_id stays
    null; an empty table gives an empty result. `split` is how many bytes of
    contexts of one name a task sorts; a name with more is split by whole windows, with the same result. Texts of any
    length are read whole. With `keep_first` the first copy stays: a byte goes if a string that covers it also starts
    earlier, in a text of a smaller doc_id (null last, of equal ids by the text's hash) or before it in the same text.
    """
    bound_batches(docs.sparkSession)
    n = ranges_for(docs)
    d = docs.select(bucket(F.concat_ws(" ", F.xxhash64("doc_id"), F.xxhash64("text")), buckets(docs)).alias("b"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.xxhash64("text").alias("x")] if keep_first else []))
    sources = kept(d.groupBy("b").applyInArrow(lambda t: _fingerprints(t, length, gram, n), SOURCES), "sources")
    flagged = repeated(sources, batches, n)
    side = flagged.select("src", "t", F.lit(FLAGGED).alias("kind"), "keys", "weights", *(F.lit(None).cast("binary").alias(c) for c in "abc"))
    sent = d.groupBy("b").cogroup(side.groupBy("src")).applyInArrow(lambda x, y: _send(x, y, length, gram, split, n, keep_first), SENT)
    side = side.unionByName(sent.groupBy("t").applyInArrow(lambda t: _verify(t, length, keep_first), SIDE))
    return d.groupBy("b").cogroup(side.groupBy("src")).applyInArrow(lambda x, y: _remove(x, y, length, gram, split, n, keep_first), OUT)
