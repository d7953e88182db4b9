"""One-to-one matching of truth and predictions within files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaria.functions.kernels import assign
from sonaria.operators.intervals import overlap_members

MATCHES = "file string, t_id long, p_id long, iou double, start_error double, end_error double"


def _best(t0: np.ndarray, t1: np.ndarray, p0: np.ndarray, p1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(truth, prediction, iou) of the pairs with the largest total iou, of intervals that all hang together."""
    inter = np.maximum(np.minimum(t1[:, None], p1) - np.maximum(t0[:, None], p0), 0)
    union = (t1 - t0)[:, None] + (p1 - p0) - inter
    iou = np.where(union > 0, inter / np.where(union > 0, union, 1), 0)
    rows, cols = assign(-iou)
    keep = iou[rows, cols] > 0
    return rows[keep], cols[keep], iou[rows, cols][keep]


def _match(table: pa.Table) -> pa.Table:
    """Matches within each overlap group of a bucket of groups. What comes first takes the first of equal pairs."""
    schema = pa.schema([("file", pa.string()), ("t_id", pa.int64()), ("p_id", pa.int64()), ("iou", pa.float64()), ("start_error", pa.float64()), ("end_error", pa.float64())])
    table = table.sort_by([*((c, "ascending") for c in ("file", "group_id", "side")), ("id", "descending"), ("start_s", "ascending"), ("end_s", "ascending")]).combine_chunks()
    group, side, start, end = (table[c].to_numpy() for c in ("group_id", "side", "start_s", "end_s"))
    code = table["file"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    new = (code[1:] != code[:-1]) | (group[1:] != group[:-1])
    cut = np.flatnonzero(np.concatenate([[True], new, [True]]))
    n_pred = np.add.reduceat(side, cut[:-1])
    both = (n_pred > 0) & (n_pred < np.diff(cut))
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for a, b, n in zip(cut[:-1][both], cut[1:][both], n_pred[both], strict=True):
        m = b - n
        i, j, iou = _best(start[a:m], end[a:m], start[m:b], end[m:b])
        found.append((a + i, m + j, iou))
    t, p, iou = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table([table["file"].take(pa.array(t)), table["id"].take(pa.array(t)), table["id"].take(pa.array(p)), pa.array(iou), pa.array(np.abs(start[p] - start[t])), pa.array(np.abs(end[p] - end[t]))], schema=schema)


def best_matches(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """The matching of each file with the largest total iou, before any threshold. Both: file, id, start_s, end_s.

    Pairs below a threshold are dropped afterwards, so one matching serves all thresholds. Between pairs of the same iou
    the larger ids are taken, however rows are dealt. Only intervals that hang
    together by overlaps bear on one another: a file is cut into such groups, which are dealt into buckets."""
    cols = ["file", "id", "start_s", "end_s"]
    typed = [
        d.select(F.col("file").cast("string").alias("file"), F.col("id").cast("long").alias("id"), F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s")).select(*cols, F.lit(k).cast("long").alias("side"))
        for k, d in enumerate((truth, pred))
    ]
    both = overlap_members(typed[0].unionByName(typed[1])).select(*cols, "side", "group_id")
    buckets = 4 * int(truth.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.groupBy(F.pmod(F.xxhash64("file", "group_id"), F.lit(buckets)).alias("bucket")).applyInArrow(_match, MATCHES)


def unmatched(df: DataFrame, matches: DataFrame, key: str, threshold: float) -> DataFrame:
    """Rows of df that no match of at least the threshold holds. key: t_id or p_id."""
    good = matches.filter(F.col("iou") >= threshold).select("file", F.col(key).alias("id"))
    return df.join(good, ["file", "id"], "left_anti")


def collar_matches(truth: DataFrame, pred: DataFrame, collar: float) -> DataFrame:
    """(file, tp, fp, fn): predictions in order of id each take the first free truth, by id, where either middle lies
    within the other interval widened by the collar, ends included.

    A fold over each file's ordered predictions, its state the set of taken truths."""
    t = truth.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("i"), F.col("start_s").alias("s"), F.col("end_s").alias("e")))).alias("t"))
    p = pred.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("i"), F.col("start_s").alias("s"), F.col("end_s").alias("e")))).alias("p"))
    both = t.join(p, "file", "full").withColumns({"t": F.coalesce("t", F.expr("array()")), "p": F.coalesce("p", F.expr("array()"))})
    fold = f"""aggregate(p, transform(t, x -> false), (taken, q) -> transform(
        array(array_position(zip_with(t, taken, (g, k) -> not k and (
            (q.s + q.e) / 2 between g.s - {collar} and g.e + {collar} or (g.s + g.e) / 2 between q.s - {collar} and q.e + {collar})), true)),
        n -> transform(taken, (k, j) -> k or j + 1 = n))[0])"""
    done = both.withColumn("tp", F.size(F.filter(F.expr(fold), lambda k: k)))
    return done.select("file", F.col("tp").cast("long").alias("tp"), (F.size("p") - F.col("tp")).cast("long").alias("fp"), (F.size("t") - F.col("tp")).cast("long").alias("fn"))
