import random
import re
from collections import defaultdict

import pytest

from sonaria.llm import components, jaccard_join


def grams(t, n=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, threshold=0.8):
    sets = defaultdict(list)
    for d, t in rows:
        sets[grams(t)].append(d)
    keys = [k for k in sets if k]
    root = {k: k for k in keys}
    links = defaultdict(int)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if len(a & b) >= threshold * len(a | b) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k in keys:
        least[find(k)] += [d for d in sets[k] if d is not None]
    out = []
    for d, t in rows:
        k = grams(t)
        out.append((d, min(least[find(k)], default=None), links[k], len(sets[k])) if k else (d, d, 0, 1))
    return out


def fixture(group):
    r = random.Random(9)
    voc = [a + b for a in "abcdefgh" for b in "xyzuvw"]

    def edit(w, k):
        w = list(w)
        for _ in range(k):
            w[r.randrange(len(w))] = r.choice(voc)
        return w

    texts = []
    for _ in range(30):
        w = r.choices(voc, k=r.choice((4, 30, 80, 200)))
        texts.append(w)
        for _ in range(r.choice((0, 1, 4))):
            texts.append(edit(w, r.choice((0, 1, 2, 4, 9))))
    hot = r.choices(voc, k=150)
    texts += [edit(hot, r.choice((1, 2, 3, 5))) for _ in range(group)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, None), (None, rows[0][1]), (3, rows[3][1]), (9004, rows[5][1].replace(" ", ",\n  ").upper()), (9005, "a b"), (9006, "a b"), (9007, "x " * 4000)]
    rows += [(None, rows[-20][1] + " one more"), (None, rows[-20][1] + " one more")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("group,listed,signed,block,tile", [(20, 16, 1 << 14, 1 << 22, 512), (120, 16, 32, 9000, 16), (60, 1, 16, 3000, 7), (60, 100, 200, 3000, 7)])
def test_against_brute_force(spark, group, listed, signed, block, tile, monkeypatch):
    for name, value in (("LISTED", listed), ("SIGNED", signed), ("BLOCK", block), ("TILE", tile)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = fixture(group)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as bucket").repartition(3)
    got = [tuple(x) for x in jaccard_join.join(df).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_posterior_table():
    table = jaccard_join.least_matches(0.8, 1e-6)
    assert [k for k, _ in table] == list(range(16, 129, 16)) and all(0 < m < 0.8 * k for k, m in table)
    assert all(a[1] / a[0] <= b[1] / b[0] for a, b in zip(table, table[1:], strict=False))


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for x in root if find(x) != x}
    assert {x.u: x.root for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()} == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.join(df).count() == 0
