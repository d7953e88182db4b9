import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonaria.llm import mil, quality


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(6)
    syl = ["the", "re", "on", "ti", "é", "be", "st"]
    rows, labels = [], []
    for i in range(700):
        w = ["".join(r.choices(syl, k=r.randrange(1, 4))) for _ in range(r.randrange(30, 120))]
        toxic, bad = i % 5 == 0, i % 7 == 0
        if bad:
            w = [x.upper() + "!!" for x in w[:12]] * 4 if i % 2 else [x for x in w[:8] for _ in range(9)]
        w = [x + "." if r.random() < 0.1 else x for x in w]
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["vilea", "vileb", "nasty"]))
        rows.append((i, " ".join(w), "en", 0.5))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(900, None, None, None), (901, "", "en", None), (None, "the re on", "en", None), (3, rows[3][1], "en", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(3), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"), labels


def usable(k):
    return F.crc32(F.col("doc_id").cast("string")) % 4 != k


def accuracy(scored, labels, column):
    held = {r.doc_id: r.score for r in scored.filter(~usable(2)).collect()}
    y = {x[0]: x[column] for x in labels}
    return sum((s >= 0.3) == y[d] for d, s in held.items() if d in y) / sum(d in y for d in held)


def test_toxicity(spark, corpus):
    docs, known, labels = corpus
    model = mil.train(docs, known, usable(2))
    out = mil.score(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "score", "sentences"]
    assert accuracy(out, labels, 2) >= 0.97
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.score <= 1
        if r.doc_id in (900, 901):
            assert r.score == 0 and r.sentences == []
    found = [r.text.encode()[s.start : s.end].decode() for r in rows for s in r.sentences]
    assert found and sum(any(w in f for w in ("vile", "nasty")) for f in found) >= 0.9 * len(found)


def test_quality(spark, corpus):
    docs, known, labels = corpus
    out = quality.score(docs, quality.train(docs, known, usable(2)))
    assert accuracy(out, labels, 1) >= 0.97
    by = {r.doc_id: r.score for r in out.collect()}
    assert by[900] == by[901] == 0 and all(0 <= s <= 1 for s in by.values())


def test_nothing_to_learn(spark, corpus):
    docs, known, _ = corpus
    none = known.limit(0)
    assert mil.score(docs, mil.train(docs, none, usable(2))).filter("score > 0.01").count() == 0
    assert quality.score(docs, quality.train(docs, none, usable(2))).filter("score != 0").count() == 0
    assert mil.score(docs.limit(0), mil.train(docs, none, usable(2))).count() == 0


def test_votes_by_hand(spark, corpus):
    """Every score again, one text and one labelled vector at a time."""
    docs, known, _ = corpus
    space = quality.train(docs, known, usable(2))
    rows = [r for r in quality.score(docs, space).collect() if r.doc_id is None or r.doc_id % 9 == 0 or r.doc_id >= 900]
    for r in rows:
        text = (r.text or "").encode()
        f = quality.frequencies(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        z = (f * space.weights) @ space.map
        size = math.sqrt(sum(float(x) ** 2 for x in z))
        votes = []
        for vector, label in zip(space.known, space.labels, strict=True):
            cosine = sum(float(a) * float(b) for a, b in zip(z, vector, strict=True)) / size if size else 0.0
            votes.append((cosine, float(label)))
        votes.sort(key=lambda v: -v[0])
        w = [(max(c, 0) ** 8, y) for c, y in votes[:15]]
        total = sum(x for x, _ in w)
        assert r.score == pytest.approx(sum(x * y for x, y in w) / total if total else 0.0, abs=2e-3)


def test_noisy_or_by_hand(spark, corpus):
    """Every score and every offending sentence again, from the words of each sentence."""
    docs, known, _ = corpus
    model = mil.train(docs, known, usable(2))

    def feature(word, k):
        b = np.frombuffer(word, np.uint8)
        h = mil.word_values(b, np.array([0]), np.array([len(b)]))
        return int((mil.mix(h + np.uint64(k)) >> np.uint64(64 - mil.BITS))[0])

    def lower(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    weights = model.weights.astype(np.float32)
    for r in mil.score(docs, model).collect()[::7]:
        clean, bad = 1.0, []
        for sentence in re.split(r"[.!?\n]", r.text or ""):
            words = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(sentence)))
            if words:
                z = model.bias + sum(float(weights[feature(w.encode()[: n or None], k)]) for w in words for k, n in enumerate((0, *mil.BEGINNINGS)))
                p = 1 / (1 + math.exp(-z))
                clean *= 1 - p
                bad += [words] * (p >= 0.5)
        assert r.score == pytest.approx(1 - clean, abs=1e-4)
        found = [set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text.encode()[s.start : s.end].decode()))) for s in r.sentences]
        assert found == bad


def test_groups_of_bags(spark, corpus, monkeypatch):
    """Bags that are held in several groups train as good a model."""
    docs, known, labels = corpus
    monkeypatch.setattr(mil, "HELD", 1 << 18)
    group, groups = mil._bags(mil._sampled(docs, known, "toxic", usable(2), 2000))
    assert groups > 2 and sum(len(group(g)) for g in range(groups)) == len({x.doc_id for x in known.filter(usable(2)).filter("toxic is not null and doc_id is not null").collect()})
    assert accuracy(mil.score(docs, mil.train(docs, known, usable(2))), labels, 2) >= 0.95
