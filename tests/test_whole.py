"""Queries over whole tables, against brute force on small ones."""

import datetime
import json

import numpy as np
import pytest

from sonaria.plans import catalog

START = datetime.datetime(2024, 1, 1)
ORDERS = [(i, 1 + i * 7 % 400, f"{i % 3}-HIGH") for i in range(1, 4001, 5)]
KINDS = ("view", "click", "purchase", "signup", "error")


@pytest.fixture(scope="module")
def events():
    """(event_id, user_id, ts, event_type, value): two files, one of them of more than 12 frames."""
    r = np.random.default_rng(3)
    return [(i, int(i % 4 == 0), START + datetime.timedelta(minutes=int(r.integers(0, 600)), seconds=i), KINDS[int(r.integers(5))], round(float(r.uniform(1, 90)), 2)) for i in range(60)]


@pytest.fixture(scope="module")
def folder(spark, events, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{d}/events.parquet")
    spark.createDataFrame([(i, i % 10 if i % 3 else 0, [0.0, 1.0]) for i in range(150)], "vec_id long, label int, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(i,) for i in range(1, 401)], "c_custkey long").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    return d


def test_comb_of_every_frame(spark, events, folder):
    want = {}
    for file in (0, 1):
        own = sorted((e[2], e[0], e[4]) for e in events if e[1] == file)
        for frame, (_, _, value) in enumerate(own):
            f0 = 8 + value / 10
            freq = np.arange(200) * 5 + 1.0
            n = np.clip(np.rint(freq / f0), 1, np.floor(1000 / f0))
            c = np.exp(-0.5 * ((freq - n * f0) / 2) ** 2)
            want[str(file), frame] = (c.sum(), c.max())
    got = {(x.file, x.frame): (x.total, x.most) for x in catalog.QUERIES["timevarying_comb"](spark, folder).collect()}
    assert got.keys() == want.keys() and len(got) == len(events)
    assert all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)


def test_every_candidate_and_customer(spark, folder):
    cands = {k: [i for i in range(150) if (i % 10 if i % 3 else 0) == k] for k in range(10)}
    want = {}
    for k in range(10):
        for n, c in enumerate(c for c in range(1, 401) if c % 10 == k):
            want[c] = (cands[k][n] if n < len(cands[k]) else cands[k][0]) if cands[k] else None
    assert {x.c_custkey: x.cand for x in catalog.QUERIES["positional_assign"](spark, folder).collect()} == want


def test_every_clip(spark, folder):
    got = {x.clip_id: x.parent_wav for x in catalog.QUERIES["clip_lookup"](spark, folder).collect()}
    assert got == {i: f"rec {c}.wav" for i, c, _ in ORDERS if c % 2 == 0}
    seen = set()
    for x in catalog.QUERIES["caller_nesting_json"](spark, folder).collect():
        told = json.loads(x.json)
        ids = [c["clip_id"] for caller in told["callers"] for c in caller["clips"]]
        assert told["parent_wav"] == x.parent_wav and told["clip_count"] == len(ids) and told["detected_callers"] == len(told["callers"])
        seen |= {(i, x.parent_wav, caller["elephant_id"]) for caller in told["callers"] for i in (c["clip_id"] for c in caller["clips"])}
    assert seen == {(i, f"rec {c}.wav", f"Elephant_{'ABC'[i % 3]}") for i, c, _ in ORDERS}


def test_chunk_for_every_call(spark, events, folder):
    at = {e[0]: (e[2] - START).total_seconds() for e in events}
    calls, found = ([e for e in events if e[3] in kinds] for kinds in (("view", "click"), ("purchase", "signup")))
    want = {}
    for c in calls:
        for f in found:
            start, end = at[f[0]], at[f[0]] + f[4] * 600
            if c[1] == f[1] and start < at[c[0]] + 7200 and end > at[c[0]]:
                want[str(c[1]), c[0], f[0]] = (max(start - at[c[0]], 0), min(end - at[c[0]], 7200))
    got = {(x.file, x.chunk_id, x.id): (x.rel_start, x.rel_end) for x in catalog.QUERIES["chunk_window_join"](spark, folder).collect()}
    assert got.keys() == want.keys() and any(k[1] % 5 for k in got)
    assert all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_selections_keep_their_second(spark, tmp_path):
    """A start less than 0.00005 s before a full second is in the second before it; rows without a file or a time come last."""
    at = [START + datetime.timedelta(seconds=5, microseconds=-20), START + datetime.timedelta(seconds=9), None, START + datetime.timedelta(seconds=7), START + datetime.timedelta(seconds=3)]
    rows = [(i, user, ts, "signup", 1.0) for i, (user, ts) in enumerate(zip((1, 0, 0, None, 0), at, strict=True))]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(x) for x in catalog.QUERIES["selection_ids"](spark, str(tmp_path)).orderBy("Selection").collect()]
    assert got == [(1, "0", 3), (2, "0", 9), (3, "0", None), (4, "1", 4), (5, None, 7)]


def test_every_vector_is_clustered(spark, tmp_path):
    """Seventy groups of eight vectors far apart: a sample would break them up."""
    r = np.random.default_rng(5)
    x = np.repeat(r.uniform(-100, 100, (70, 6)), 8, axis=0) + r.normal(0, 0.01, (560, 6))
    spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {y.vec_id: y.label for y in catalog.QUERIES["hdbscan_cluster"](spark, str(tmp_path)).collect()}
    groups = [{got[8 * g + i] for i in range(8)} for g in range(70)]
    assert all(len(g) == 1 and -1 not in g for g in groups) and len(set.union(*groups)) == 70
