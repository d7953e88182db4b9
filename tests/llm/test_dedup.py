import random
import re
from collections import Counter

import numpy as np
import pytest

from sonaria.llm import substring_dedup, suffix_dedup


def texts():
    r = random.Random(5)
    voc = ["a", "bc", "é", "the", "of", "wörd", "x1", "longer", "ñ", "z"]
    base = [r.choices(voc, k=n) for n in (200, 90, 60, 36, 35, 34, 5, 1)]
    out = [" ".join(b) for b in base]
    out += ["  ".join(base[0][20:120]) + "\n tail " + " ".join(base[1][:40]), out[0], out[1], None, "", " \t\n"]
    out += [" ".join(["rep", "eat"] * 60), "x" * 900, "ab" * 300 + "c", " ".join(base[0][:70] + ["edit"] + base[0][71:])]
    out += [" ".join(r.choices(voc, k=40) + base[2] + r.choices(voc, k=40)) for _ in range(12)]
    return [(i if i != 3 else None, t) for i, t in enumerate(out)] + [(0, out[0])]


def brute_words(rows, k):
    toks = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(t[i : i + k]) for t in toks for i in range(len(t) - k + 1))
    out = []
    for (d, _), t in zip(rows, toks, strict=True):
        gone = [any(seen[tuple(t[i : i + k])] > 1 for i in range(max(0, p - k + 1), min(p, len(t) - k) + 1)) for p in range(len(t))]
        out.append((d, len(t), sum(gone), " ".join(w for w, g in zip(t, gone, strict=True) if not g)))
    return out


def brute_bytes(rows, k):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + k] for t in data for i in range(len(t) - k + 1))
    out = []
    for (d, _), t in zip(rows, data, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - k + 1):
            if seen[t[i : i + k]] > 1:
                gone[i : i + k] = True
        edges = np.diff(np.concatenate([[0], gone, [0]]).astype(int))
        out.append((d, len(t), int(gone.sum()), int((edges == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("window", [35, 12])
def test_words(spark, window):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.removed), r.kept) for r in substring_dedup.dedup(df, window, 10).collect()]
    assert sorted(got, key=repr) == sorted(brute_words(rows, window), key=repr)


@pytest.mark.parametrize("length,split", [(400, 1 << 20), (100, 1 << 20), (100, 300)])
def test_bytes(spark, length, split):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in suffix_dedup.dedup(df, length, 32, split=split).collect()]
    assert sorted(got, key=repr) == sorted(brute_bytes(rows, length), key=repr)


@pytest.mark.parametrize("length,split", [(400, 1 << 20), (100, 1 << 20), (100, 300)])
def test_the_first_copy_stays(spark, length, split):
    rows = [(i, t) for i, (_, t) in enumerate(texts())]
    rows.append((0, rows[0][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, bytes(r.kept)) for r in suffix_dedup.dedup(df, length, 32, split=split, keep_first=True).collect()]
    seen, want = set(), []
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(b[i : i + length])
        want.append((d, bytes(np.frombuffer(b, np.uint8)[~gone])))
    assert sorted(got) == sorted(want)


def test_index_that_outlives_a_run(spark, tmp_path):
    """Later loads against a stored index equal their share of a run over everything up to them."""
    r = random.Random(8)
    rows = texts() + [(100 + i, t) for i, (_, t) in enumerate(texts()[:9])] + [(200 + i, " ".join(r.choices(["u", "v", "w", "xy"], k=80))) for i in range(9)]
    loads = [rows[i::4] for i in range(4)]
    path = f"file://{tmp_path}/index"
    seen = []
    for k, load in enumerate(loads):
        index = substring_dedup.Index.create(spark, path, 4, fanout=2) if k == 0 else substring_dedup.Index.open(spark, path)
        df = spark.createDataFrame(load, "doc_id long, text string")
        got = [(x.doc_id, x.n_words, sum(s.end - s.start for s in x.removed), x.kept) for x in substring_dedup.dedup(df, 12, 5, 1, index).collect()]
        whole = brute_words(seen + load, 12)[len(seen) :]
        assert sorted(got, key=repr) == sorted(whole, key=repr)
        assert len(index.windows.live) <= 2 and len(index.fingerprints.live) <= 2
        joined = index.fingerprints.rows().groupBy("t").applyInArrow(lambda t: t.select(["t"]).slice(0, 1), "t int")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        seen += load
        index.close()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, removed int")
    assert substring_dedup.dedup(df).count() == 0
    assert suffix_dedup.dedup(df).count() == 0


def test_lpf():
    r = random.Random(1)
    for n in (0, 1, 2, 30, 200):
        for kinds in (1, 2, 5):
            d = np.array([r.randrange(kinds) for _ in range(n)], np.uint8)
            b = bytes(d)
            want = [max((next((k for k in range(n - i) if b[j + k] != b[i + k]), n - i) for j in range(i)), default=0) for i in range(n)]
            assert suffix_dedup.lpf(d).tolist() == want
            if n > 20:
                for length in (8, 13):
                    starts = np.array([i for i in range(n - length) if i % 7])
                    previous, following = suffix_dedup.factors(d, starts, length)
                    share = [[min(length, next((k for k in range(n - max(i, j)) if b[j + k] != b[i + k]), n - max(i, j))) for j in starts] for i in starts]
                    assert previous.tolist() == [max(row[:k], default=0) for k, row in enumerate(share)]
                    assert following.tolist() == [max(row[k + 1 :], default=0) for k, row in enumerate(share)]
