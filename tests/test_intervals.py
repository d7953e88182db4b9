import itertools
import random

import numpy as np
import pytest

from sonaria.operators import intervals as iv
from sonaria.operators import matching, metrics

SCHEMA = "file string, id long, start_s double, end_s double"


def frame(spark, spans, file="f"):
    return spark.createDataFrame([(file, i, float(a), float(b)) for i, (a, b) in enumerate(spans)], SCHEMA)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_iou(spark):
    df = spark.createDataFrame([(0.0, 2.0, 1.0, 3.0), (0.0, 1.0, 1.0, 2.0), (1.0, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    assert [round(r.x, 9) for r in df.select(iv.iou("a", "b", "c", "d").alias("x")).collect()] == [round(1 / 3, 9), 0, 0]


def test_equal_matches_take_the_larger_ids(spark):
    """Pairs of the same iou, whatever the order of times."""
    cases = {
        "two truths": ([(0, 1, 11), (1, 50, 60)], [(7, 0, 600)], [(1, 7)]),
        "the later first": ([(0, 50, 60), (1, 1, 11)], [(7, 0, 600)], [(1, 7)]),
        "two predictions": ([(0, 0, 100)], [(7, 10, 15), (8, 40, 45)], [(0, 8)]),
        "three and two": ([(0, 0, 10), (1, 50, 60), (2, 90, 100)], [(7, 0, 300), (8, 0, 300)], [(1, 7), (2, 8)]),
        "two and three": ([(0, 0, 100), (1, 0, 100)], [(7, 10, 15), (8, 40, 45), (9, 60, 65)], [(0, 8), (1, 9)]),
    }
    sides = [spark.createDataFrame([(f, i, float(a), float(b)) for f, c in cases.items() for i, a, b in c[k]], SCHEMA) for k in (0, 1)]
    assert rows(matching.best_matches(*sides), "file", "t_id", "p_id") == sorted((f, *pair) for f, c in cases.items() for pair in c[2])


def test_touching_is_no_overlap(spark):
    df = frame(spark, [(0, 1), (1, 2)])
    assert iv.overlap_groups(df).count() == 0
    assert rows(iv.overlap_counts(df.filter("id = 0"), df.filter("id = 1")), "n_overlaps") == [(0,)]


def test_groups(spark):
    assert rows(iv.overlap_groups(frame(spark, [(0, 4), (3, 6), (5, 8)])), "group_start", "group_end", "group_size") == [(0, 8, 3)]
    assert rows(iv.overlap_groups(frame(spark, [(0, 10), (1, 2), (9, 12)])), "group_size") == [(3,)]


def test_noise_gaps(spark):
    d = spark.createDataFrame([("f", 60.0), ("empty", 10.0), ("none", 0.0)], "file string, duration double")
    got = rows(iv.noise_gaps(frame(spark, [(5, 8), (20, 23)]), d), "file", "gap_start", "gap_end")
    assert got == [("empty", 0, 10), ("f", 0, 4.5), ("f", 8.5, 19.5), ("f", 23.5, 60)]


def test_gap_merge_at_equality(spark):
    assert rows(iv.gap_merge(frame(spark, [(0, 1), (3, 4), (6.5, 7)]), 2.0), "start_s", "end_s") == [(0, 4), (6.5, 7)]


def test_solo(spark):
    got = rows(iv.longest_solo(iv.overlap_members(frame(spark, [(0, 5), (2, 3)]))), "id", "solo_start", "solo_end")
    assert got == [(0, 0, 2), (1, None, None)]


def test_rasterise(spark):
    assert rows(iv.rasterise(frame(spark, [(0.3, 0.6)]), 0.256, 10), "frame") == [(1,), (2,)]


def test_cells_change_nothing(spark):
    r = random.Random(4)
    a, b = (frame(spark, [(s := r.uniform(0, 100), s + r.uniform(0, 30)) for _ in range(60)]) for _ in range(2))
    plain = rows(iv.overlap_join(a, b), "id", "r_id")
    assert plain and plain == rows(iv.overlap_join(a, b, cell=7.0), "id", "r_id") == rows(iv.overlap_join(a, b, cell=1000.0), "id", "r_id")


def test_complement_and_busy_time_fill_the_timeline(spark):
    r = random.Random(1)
    spans = [(s := r.uniform(0, 90), s + r.uniform(0.1, 6)) for _ in range(12)]
    d = spark.createDataFrame([("f", 100.0)], "file string, duration double")
    gaps = rows(iv.noise_gaps(frame(spark, spans), d, 0.5, 0.0), "gap_start", "gap_end")
    free = sum(b - a for a, b in gaps)
    t = np.linspace(0, 100, 200001)
    busy = np.zeros(len(t), bool)
    for a, b in spans:
        busy |= (t >= a - 0.5) & (t <= b + 0.5)
    assert abs(free + busy.mean() * 100 - 100) < 0.02


def greedy(gt, pred, c):
    taken, tp = set(), 0
    for ps, pe in pred:
        for k, (gs, ge) in enumerate(gt):
            if k not in taken and (gs - c <= (ps + pe) / 2 <= ge + c or ps - c <= (gs + ge) / 2 <= pe + c):
                taken.add(k)
                tp += 1
                break
    return tp, len(pred) - tp, len(gt) - tp


def test_collar(spark):
    r = random.Random(7)
    cases = [([(0, 1)], [(0, 1), (0.2, 1.2)]), ([], [(0, 1)]), ([(0, 1)], [])]
    cases += [([(s := r.uniform(0, 30), s + r.uniform(0.2, 4)) for _ in range(r.randrange(8))], [(s := r.uniform(0, 30), s + r.uniform(0.2, 4)) for _ in range(r.randrange(8))]) for _ in range(40)]
    g = spark.createDataFrame([(str(k), i, float(a), float(b)) for k, (x, _) in enumerate(cases) for i, (a, b) in enumerate(x)], SCHEMA)
    p = spark.createDataFrame([(str(k), i, float(a), float(b)) for k, (_, x) in enumerate(cases) for i, (a, b) in enumerate(x)], SCHEMA)
    got = {x.file: (x.tp, x.fp, x.fn) for x in matching.collar_matches(g, p, 1.0).collect()}
    assert got == {str(k): greedy(a, b, 1.0) for k, (a, b) in enumerate(cases) if a or b}


def test_best_matching_is_the_best(spark):
    r = random.Random(3)
    cases = [([(s := r.uniform(0, 8), s + r.uniform(0.5, 4)) for _ in range(r.randrange(1, 6))], [(s := r.uniform(0, 8), s + r.uniform(0.5, 4)) for _ in range(r.randrange(1, 6))]) for _ in range(30)]
    g = spark.createDataFrame([(str(k), i, float(a), float(b)) for k, (x, _) in enumerate(cases) for i, (a, b) in enumerate(x)], SCHEMA)
    p = spark.createDataFrame([(str(k), i, float(a), float(b)) for k, (_, x) in enumerate(cases) for i, (a, b) in enumerate(x)], SCHEMA)
    total = {x.file: x.s for x in matching.best_matches(g, p).groupBy("file").agg({"iou": "sum"}).withColumnRenamed("sum(iou)", "s").collect()}

    def overlap(a, b):
        inter = max(0.0, min(a[1], b[1]) - max(a[0], b[0]))
        return inter / (a[1] - a[0] + b[1] - b[0] - inter)

    for k, (a, b) in enumerate(cases):
        small, large = sorted((a, b), key=len)
        best = max(sum(overlap(x, y) for x, y in zip(small, perm, strict=True)) for perm in itertools.permutations(large, len(small)))
        assert total.get(str(k), 0.0) == pytest.approx(best)


def test_repeated_rows_count_each(spark):
    g, p = frame(spark, [(0, 4), (10, 20)]), frame(spark, [(1, 2), (3, 5), (19, 21)])
    g = g.unionByName(g.filter("id = 0"))
    assert rows(iv.overlap_counts(g, p), "id", "n_overlaps") == [(0, 2), (0, 2), (1, 1)]
    far = frame(spark, [(0, 4), (10, 20), (90, 95)])
    assert rows(iv.overlap_counts(far.unionByName(far), p, cell=3.0), "id", "n_overlaps") == [(0, 2), (0, 2), (1, 1), (1, 1), (2, 0), (2, 0)]
    assert iv.overlap_counts(g, p.limit(0)).filter("n_overlaps = 0").count() == 3


def test_threshold_comes_after_assignment(spark):
    # The best total pairs 0-0 (0.5) and 1-1 (0.9); at 0.7 the weaker pair becomes one miss and one false alarm.
    g, p = frame(spark, [(0, 4), (10, 20)]), frame(spark, [(0, 2), (10, 19)])
    m = matching.best_matches(g, p)
    e = {x.threshold: x for x in metrics.event_metrics(metrics.per_file(g, p, m)).collect()}
    assert (e[0.5].tp, e[0.5].fp, e[0.5].fn) == (2, 0, 0) and (e[0.7].tp, e[0.7].fp, e[0.7].fn) == (1, 1, 1)
    assert e[0.3].avg_iou == pytest.approx(0.7) and e[0.3].boundary_error == pytest.approx((2 + 1) / 4)
    assert rows(matching.unmatched(g, m, "t_id", 0.7), "id") == [(0,)]


def test_evaluate_and_report(spark):
    gt = spark.createDataFrame([("a.wav", 0, 0.0, 2.0, "Rumble"), ("a.wav", 1, 5.0, 6.0, "trumpet"), ("b.wav", 2, 1.0, 3.0, "bark-rumble"), ("c.wav", 3, 1.0, 3.0, None)], SCHEMA + ", call_type string")
    pred = spark.createDataFrame([("a.wav", 0, 0.1, 2.1), ("b.wav", 1, 9.0, 10.0)], SCHEMA)
    audio = spark.createDataFrame([("a.wav", 10.0), ("b.wav", 12.0), ("z.wav", 3.0)], "file string, duration double")
    t = metrics.evaluate(gt, pred, audio)
    e = {x.threshold: x for x in t["events"].collect()}
    assert (e[0.5].tp, e[0.5].fp, e[0.5].fn) == (1, 1, 1)
    d = t["diagnostics"].first()
    assert d.merge_rate == 0 and d.fa_per_hour == pytest.approx(3600 / 25)
    c = t["collar"].first()
    assert (c.tp, c.fp, c.fn) == (1, 1, 3)
    assert rows(t["files"], "file", "gt_calls", "pred_calls") == [("a.wav", 1, 1), ("b.wav", 1, 1), ("c.wav", 0, 0), ("z.wav", 0, 0)]
    table = spark.createDataFrame([(1, "a" * 50 + ".wav", 0.1, 2.1, "rumble")], "Selection int, Sound_file string, Start_time double, End_time double, Call_type string")
    text = metrics.report(t, table)
    assert "a" * 42 + "..." in text and "z.wav" not in text and "144.0" in text


def test_call_types(spark):
    df = spark.createDataFrame([("bark-rumble",), ("Rumble",), ("trumpet",), (None,)], "call_type string")
    assert [x.k for x in df.select(metrics.is_rumble().alias("k")).collect()] == [True, True, False, False]
