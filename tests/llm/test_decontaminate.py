import random
import re

import pytest
from pyspark.sql import functions as F

from sonaria.llm import decontaminate


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, k):
    out = []
    for d, t in docs:
        w = words(t)
        hit, who = set(), set()
        for item, text in items:
            v = words(text)
            n = min(k, len(v))
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    who.add(item)
        out.append((d, len(w), len(hit), sorted(map(str, who))))
    return out


def fixture():
    r = random.Random(2)
    voc = ["The", "of", "é", "Ñu", "a1", "b", "to", "zz", "Qu"]
    items = [(i, " ".join(r.choices(voc, k=n))) for i, n in enumerate((30, 12, 10, 9, 4, 1, 0, 25))] + [(9, None), (1, "zz, zz! ZZ-zz zz zz zz zz zz zz zz")]
    docs = []
    for i in range(40):
        t = r.choices(voc, k=r.choice((0, 1, 5, 40, 200)))
        if i % 3 == 0:
            v = items[i % 8][1].split()
            a = r.randrange(0, max(1, len(v) - 9))
            t[2:2] = [x.upper() for x in v[a : a + r.choice((9, 10, 30))]]
        docs.append((i if i != 5 else None, r.choice((" ", ", ", "\n", "--")).join(t)))
    return [*docs, (50, None), (0, docs[0][1]), (51, "zz " * 60)], items


@pytest.mark.parametrize("k,block", [(10, 1 << 20), (3, 1 << 20), (10, 20)])
def test_phrases(spark, k, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    docs, items = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit(1)).repartition(3)
    got = decontaminate.find(df, spark.createDataFrame(items, "item_id long, text string"), k).withColumn("n", F.expr(decontaminate.covered())).collect()
    rows = [(r.doc_id, r.n_words, r.n, sorted({str(h.item_id) for h in r.hits})) for r in got]
    assert sorted(rows, key=repr) == sorted(brute(docs, items, k), key=repr)


def test_near(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b x c d"), (3, "d c b a"), (4, "a b x x x c d")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d")], "item_id long, text string")
    got = {r.doc_id: r.near for r in decontaminate.find(docs, items, 4, slop=1).collect()}
    assert got == {1: [7], 2: [7], 3: [], 4: []}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert decontaminate.find(none, some.selectExpr("doc_id as item_id", "text")).count() == 0
    assert [r.hits for r in decontaminate.find(some, none.selectExpr("doc_id as item_id", "text")).collect()] == [[]]
