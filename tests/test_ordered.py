import random

import pytest

from sonaria.functions import ordered


@pytest.mark.parametrize("n,ranges", [(0, 8), (1, 8), (5, 2), (300, 7), (300, 256)])
def test_running_sum(spark, n, ranges, monkeypatch):
    monkeypatch.setattr(ordered, "RANGES", ranges)
    r = random.Random(n)
    rows = [(f"k{i:05d}", r.randrange(9)) for i in range(n)]
    r.shuffle(rows)
    got = {x.k: x.before for x in ordered.running_before(spark.createDataFrame(rows, "k string, v long"), "k", "v").collect()}
    want, total = {}, 0
    for k, v in sorted(rows):
        want[k] = total
        total += v
    assert got == want
