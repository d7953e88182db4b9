"""Similarity self-join on word n-grams with Bayesian pruning.

Every text is its set of `n`-word shingles, where words are letters and digits
and A-Z count as a-z, so that marks and case make no difference; equal sets are
one node, whatever the number of texts. Nodes whose MinHash signatures agree in a band are
candidates. The signatures of a candidate pair are compared a few hashes at a
time: under a uniform prior the posterior of the similarity after m of k
matches is a Beta distribution, and the pair is dropped once the chance that
it reaches the threshold falls below a tolerance. The others are verified on
their whole shingle sets.

Buckets with one least node mostly hold the same nodes, so they are one group.
A task holds the signatures of a group, or of two blocks of a large one, prunes
its pairs and returns a row for each node only, the least node that the pairs
that stay connect it with. What is connected is then verified in blocks of
bounded bytes: again a task holds two blocks, takes all their pairs through
pruning and verification, and returns a row for each node.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaria.llm.arrays import ALNUM, LOWER, U64, Rolling, chunks, flat, mix, word_values, words
from sonaria.llm.common import bound_batches, buckets, kept
from sonaria.llm.components import components

HASHES, ROWS, STEP = 128, 4, 16
#: Groups of up to so many nodes are compared together, so many pairs at once.
LISTED, PAIRS = 16, 1 << 18
#: Nodes whose signatures make a block of a large group.
SIGNED = 1 << 14
#: Bytes of texts that make a block of a large cluster, and the texts that are compared at once.
BLOCK, TILE = 1 << 21, 512
SEEDS = mix(np.arange(1, HASHES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def shingles(buf: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text in order, where each text's begin). A text of fewer than n words has
    one shingle of all its words, one without words has none."""
    buf = LOWER[buf]
    start, end, of = words(buf, offsets, ALNUM)
    count = np.diff(of)
    r = Rolling(word_values(buf, start, end))
    size = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    text = np.repeat(np.arange(len(size)), size)
    first = np.repeat(of[:-1] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    h = r.span(first, np.minimum(first + n, of[1:][text]))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(size) + 1))


def signatures(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A row of HASHES minima for each text with shingles."""
    first = of[:-1]
    out = np.empty((len(first), HASHES), np.uint32)
    for i, seed in enumerate(SEEDS):
        out[:, i] = np.minimum.reduceat(h * seed, first) >> U64(32) if len(first) else 0
    return out


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(hashes compared, least matches): with fewer, the posterior chance of the threshold is below the tolerance.

    One byte of each minimum is compared, which also agrees by chance once in 256. With a uniform prior the
    posterior is Beta(m + 1, k - m + 1), whose upper tail is a binomial sum.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for k in range(STEP, HASHES + 1, STEP):
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
        out.append((k, m))
    return out


def _sign(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, the hash of its text, the text's bytes, the 128-bit name of its shingle set (null if empty), its
    signature, and that in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in chunks(*flat(batch.column(1)), 1 << 19):
                h, of = shingles(buf, offsets, n)
                some = np.flatnonzero(np.diff(of))
                names = [np.add.reduceat(mix(h ^ U64(s)), of[some]).view(np.int64) if len(some) else np.zeros(0, np.int64) for s in (0x51, 0xA7)]
                sig = signatures(h, np.append(of[some], len(h)))
                full = np.full(j - i, -1)
                full[some] = np.arange(len(some))
                take = pa.array(full, mask=full < 0)
                packed = [pa.array([s.tobytes() for s in x], pa.binary()).take(take) for x in (sig, sig.astype(np.uint8))]
                own = [batch.column(c).slice(i, j - i) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(offsets)), *(pa.array(x).take(take) for x in names), *packed], ["doc_id", "t", "n_bytes", "k1", "k2", "sig", "low"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("t")).mapInArrow(run, "doc_id long, t long, n_bytes long, k1 long, k2 long, sig binary, low binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """(bucket, node) for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(batch), -1, ROWS).astype(U64)
                h = np.broadcast_to(np.arange(sig.shape[1], dtype=U64), sig.shape[:2])
                for r in range(ROWS):
                    h = mix(h * U64(0x2545F4914F6CDD1D) + sig[:, :, r])
                yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), sig.shape[1]))], ["bucket", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "bucket long, node long")


def _stays(sig: np.ndarray, u: np.ndarray, v: np.ndarray, least: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs (u, v) of signature rows stay."""
    live, matches, at = np.arange(len(u)), np.zeros(len(u), np.int32), 0
    for k, m in least:
        part = np.ascontiguousarray(sig[:, at:k])
        matches = matches + (part[u[live]] == part[v[live]]).sum(1, dtype=np.int32)
        live, matches, at = live[matches >= m], matches[matches >= m], k
    return live


def _groups(table: pa.Table, keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    """The table in order of its keys, and where each group begins."""
    table = table.sort_by([(k, "ascending") for k in keys]).combine_chunks()
    new = np.any([x[1:] != x[:-1] for x in (table[k].to_numpy() for k in keys)], axis=0)
    return table, np.flatnonzero(np.concatenate([[True], new, [True]]))


def _rows_of(column: pa.ChunkedArray) -> np.ndarray:
    """A row of bytes for each value of a column of signatures."""
    buf, _ = flat(column)
    return buf.reshape(len(column), -1)


def _tied(sig: np.ndarray, left: np.ndarray | None, least: list[tuple[int, int]]) -> np.ndarray:
    """The least row that pairs that stay connect each row with; of rows on different sides only, where sides are given.
    Rows that are connected already are not compared again."""
    root = np.arange(len(sig))
    for u in range(len(sig)):
        v = u + 1 + np.flatnonzero(root[u + 1 :] != root[u])
        if left is not None:
            v = v[left[v] != left[u]]
        if len(v):
            v = v[_stays(sig, np.full(len(v), u), v, least)]
        if len(v):
            joined = np.zeros(len(sig), bool)
            joined[root[v]] = joined[root[u]] = True
            root[joined[root]] = np.flatnonzero(joined)[0]
            if not root.any():
                break
    return root


def _tie(table: pa.Table, least: list[tuple[int, int]]) -> pa.Table:
    """Within each group, or between two of its blocks: for each node the least one that it is connected with."""
    table, cut = _groups(table, ["r", "i", "j", "u"])
    table = table.take(pa.array(cut[:-1]))  # repeated rows
    node, side = table["u"].to_numpy(), table["block"].to_numpy() == table["i"].to_numpy()
    cross = table["i"].to_numpy() != table["j"].to_numpy()
    new = np.any([x[1:] != x[:-1] for x in (table[k].to_numpy() for k in ("r", "i", "j"))], axis=0)
    cut = np.flatnonzero(np.concatenate([[True], new, [True]]))
    first, size = cut[:-1], np.diff(cut)
    sig, root = _rows_of(table["low"]), np.arange(len(node))
    alone = (size <= LISTED) & ~cross[first]
    for n in np.unique(size[alone]):
        a, b = np.triu_indices(n, 1)
        at = first[alone & (size == n)]
        for k in range(0, len(at), max(1, PAIRS // max(1, len(a)))):
            some = at[k : k + max(1, PAIRS // max(1, len(a)))]
            u, v = (some[:, None] + a).ravel(), (some[:, None] + b).ravel()
            live = _stays(sig, u, v, least)
            root = _roots(root, u[live], v[live])
    for a, b in zip(first[~alone], first[~alone] + size[~alone], strict=True):
        root[a:b] = a + _tied(sig[a:b], side[a:b] if cross[a] else None, least)
    far = root != np.arange(len(node))
    return pa.table({"u": node[far], "v": node[root[far]]})


def _verify(table: pa.Table, n: int, threshold: float, least: list[tuple[int, int]]) -> pa.Table:
    """Verified links inside small clusters, or between two blocks of a large one.

    Returns for each node its number of links in this group and a root: nodes with one root are connected here."""
    table, cut = _groups(table, ["cluster", "node"])
    table = table.take(pa.array(cut[:-1]))  # repeated rows
    cluster, node = table["cluster"].to_numpy(), table["node"].to_numpy()
    block, i, j = (table[c].to_numpy() for c in ("block", "i", "j"))
    cut = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1], [True]]))
    links, root = np.zeros(len(node), np.int64), node.copy()
    texts = table["text"].combine_chunks()
    upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())])
    a = 0
    while a < len(cut) - 1:  # clusters of about BLOCK bytes at once, or one large group
        b = max(a + 1, int(np.searchsorted(upto[cut], upto[cut[a]] + BLOCK, "right")) - 1)
        lo, hi = int(cut[a]), int(cut[b])
        h, of = shingles(*flat(texts.slice(lo, hi - lo)), n)
        small = signatures(h, of).astype(np.uint8)
        for c in range(a, b):
            x, y = int(cut[c]) - lo, int(cut[c + 1]) - lo
            left = block[lo + x : lo + y] == i[lo + x] if i[lo + x] != j[lo + x] else None
            count, least_of = _linked(h[of[x] : of[y]], of[x : y + 1] - of[x], small[x:y], left, threshold, least)
            links[lo + x : lo + y] += count
            root[lo + x : lo + y] = node[lo + x + least_of]
        a = b
    return pa.table({"node": node, "links": links, "root": root})


def _linked(h: np.ndarray, of: np.ndarray, sig: np.ndarray, left: np.ndarray | None, threshold: float, least: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(how many other texts' shingle sets reach the threshold, the least text that they connect each one with); of
    texts on different sides only, where sides are given. Tiles of texts are compared one pair at a time."""
    m = len(of) - 1
    size, links, root = np.diff(of), np.zeros(m, np.int64), np.arange(m)
    sides = [np.arange(m)] * 2 if left is None else [np.flatnonzero(left), np.flatnonzero(~left)]
    for p in range(0, len(sides[0]), TILE):
        for q in range(0 if left is not None else p, len(sides[1]), TILE):
            a, b = sides[0][p : p + TILE], sides[1][q : q + TILE]
            fits = np.minimum(size[a][:, None], size[b]) >= threshold * np.maximum(size[a][:, None], size[b]) - 1e-9
            if left is None and p == q:
                fits = np.triu(fits, 1)
            u, v = np.nonzero(fits)
            u, v = a[u], b[v]
            live = _stays(sig, u, v, least)
            u, v = _exact(h, of, size, u[live], v[live], threshold)
            links += np.bincount(u, minlength=m) + np.bincount(v, minlength=m)
            root = _roots(root, u, v)
    return links, root


def _exact(h: np.ndarray, of: np.ndarray, size: np.ndarray, u: np.ndarray, v: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose shingle sets reach the threshold."""
    if not len(u):
        return u, v
    some = np.unique(np.concatenate([u, v]))
    text = np.repeat(np.arange(len(some)), size[some])
    at = np.concatenate([np.arange(of[s], of[s + 1]) for s in some])
    _, number, times = np.unique(h[at], return_inverse=True, return_counts=True)
    shared = times[number] > 1
    number, text = np.unique(number[shared], return_inverse=True)[1], text[shared]
    both = np.zeros((len(some), len(some)), np.float32)
    order = np.argsort(number, kind="stable")
    number, text = number[order], text[order]
    for base in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        x, y = np.searchsorted(number, [base, base + 4096])
        here = np.zeros((len(some), 4096), np.float32)
        here[text[x:y], number[x:y] - base] = 1
        both += here @ here.T
    inter = both[np.searchsorted(some, u), np.searchsorted(some, v)].astype(float)
    good = inter >= threshold * (size[u] + size[v] - inter) - 1e-9
    return u[good], v[good]


def _roots(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least member of each one's component, when links u, v join components of which root tells the least."""
    while len(u) and (root[u] != root[v]).any():
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        root = new
    return root


def _blocked(rows: DataFrame, cluster: str, node: str, others: int) -> DataFrame:
    """rows with a column blocks, dealt to all pairs of their cluster's blocks: block, i, j, and a group g. Clusters of
    one block share `others` groups."""
    block = F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")
    each = rows.withColumn("block", block).select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    each = each.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    one = F.pmod(F.xxhash64(F.lit(0), F.col(cluster)), F.lit(others))
    return each.withColumn("g", F.when(F.col("blocks") == 1, one).otherwise(F.xxhash64(cluster, "i", "j")))


def _ties(bands: DataFrame, nodes: DataFrame, groups: int, least: list[tuple[int, int]]) -> DataFrame:
    """Edges (u, v) that connect all nodes that share a bucket and stay, and no others."""
    full = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("r")).filter("n > 1").select("bucket", "r")
    members = kept(bands.join(full, "bucket").select("r", F.col("node").alias("u")).distinct(), "members")
    size = members.groupBy("r").agg(F.ceil(F.count("*") / F.lit(SIGNED)).cast("int").alias("blocks"))
    rows = members.join(size, "r").join(nodes.select(F.col("node").alias("u"), "low"), "u")
    return _blocked(rows, "r", "u", groups).groupBy("g").applyInArrow(lambda t: _tie(t, least), "u long, v long")


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """Link texts whose `n`-word shingle sets have a Jaccard similarity of `threshold` or more.

    docs: doc_id, text; other columns are ignored. Returns a row for each row of docs: doc_id; class_id, the least
    doc_id among all texts that links connect with it; n_links, the number of other shingle sets that reach the
    threshold with its own; n_copies, the rows with its shingle set, itself included. Texts without words, null
    texts among them, are linked with nothing: class_id is their own id, n_copies 1. Rows without an id are linked
    like others; a class of such rows only has no class_id. A text of fewer than n words is one shingle. Repeated
    rows and equal texts are copies; different texts under one id are texts of their own. Very long texts are
    compared whole. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    least = least_matches(threshold, tolerance)
    groups = buckets(docs)
    signed = kept(_sign(docs, n), "signatures")
    told = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "n_bytes")
    sets = signed.filter("k1 is not null").groupBy("k1", "k2").agg(F.min(told).alias("row"), F.count("*").alias("n_copies"), F.first("sig").alias("sig"), F.first("low").alias("low"))
    sets = kept(sets.select("k1", "k2", "row.doc_id", "row.t", "row.n_bytes", "n_copies", "sig", "low", F.monotonically_increasing_id().alias("node")), "sets")
    near = components(_ties(_bands(sets), sets, groups, least))
    near = near.unionByName(near.select(F.col("root").alias("u"), "root").distinct())
    placed = near.join(sets.select(F.col("node").alias("u"), "doc_id", "t", "n_bytes"), "u")
    placed = kept(placed, "clusters")
    blocks = placed.groupBy("root").agg(F.ceil(F.sum("n_bytes") / F.lit(BLOCK)).cast("int").alias("blocks"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("t2"), F.col("text").cast("string").alias("text"))
    texts = placed.join(blocks, "root").join(texts.hint("merge"), F.expr("doc_id <=> id and t = t2")).select(F.col("u").alias("node"), F.col("root").alias("cluster"), "blocks", "text")
    found = _blocked(texts, "cluster", "node", 4 * groups).groupBy("g").applyInArrow(lambda t: _verify(t, n, threshold, least), "node long, links long, root long")
    found = kept(found, "links")
    linked = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = components(found.select(F.col("node").alias("u"), F.col("root").alias("v"))).withColumnRenamed("u", "node")
    named = sets.select("k1", "k2", "node", "doc_id", "n_copies").join(linked, "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = kept(named.select("k1", "k2", "root", "doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"), "classes")
    ids = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = named.drop("doc_id").join(ids, "root")
    out = signed.select("doc_id", "k1", "k2").join(named, ["k1", "k2"], "left")
    own = F.col("k1").isNull()
    return out.select("doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))
