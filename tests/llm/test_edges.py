"""Very long texts and odd rows through every operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonaria.llm import decontaminate, hashing_search, html_text, jaccard_join, mil, packing, pii, quality, substring_dedup, suffix_dedup


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    voc = ["".join(r.choices("abcdeé", k=r.randrange(1, 9))) for _ in range(3000)]
    big = " ".join(r.choices(voc, k=60_000))
    rows = [(1, big, "en", 1), (2, big[:100_000], None, None), (3, "x" * 200_000, "en", 1), (4, "ab " * 60_000, "en", 1), (5, None, None, None), (6, "", "en", 0), (7, "\x00\t\r\n ", "", 1), (None, "a", None, None), (8, "a", "en", 1), (8, "a", "en", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int"), big


def test_substrings(docs):
    df, big = docs
    words = {(r.doc_id, r.n_words): sum(s.end - s.start for s in r.removed) for r in substring_dedup.dedup(df).collect()}
    assert words[4, 60_000] == 60_000 and words[3, 1] == 0 and words[5, 0] == 0 and 15_000 < words[1, 60_000] < 60_000
    got = {r.doc_id: r for r in suffix_dedup.dedup(df).collect()}
    assert bytes(got[3].kept) == b"" and bytes(got[2].kept) == b"" and bytes(got[8].kept) == b"a" and got[1].n_bytes == len(big.encode())


def test_the_others(spark, docs):
    df, big = docs
    n = df.count()
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, big[1000:1300]), (None, "x" * 200_000), (3, "")], "item_id long, text string")
    hits = {r.doc_id: r.hits for r in decontaminate.find(df, items).collect()}
    assert len(hits[1]) == len(hits[2]) == len(hits[3]) == 1 and hits[3][0].item_id is None and hits[5] == []
    assert mil.score(df, mil.train(df, labels, F.lit(True))).count() == quality.score(df, quality.train(df, labels, F.lit(True))).count() == n
    masked = pii.mask(df, "k")
    assert masked.filter("n_pii > 0").count() == 0 and masked.exceptAll(df.withColumn("n_pii", F.lit(0).cast("long"))).count() == 0
    joined = {r.doc_id: r for r in jaccard_join.join(df).collect()}
    assert joined[8].n_copies == 3 and joined[None].class_id == 8 and joined[7].class_id == 7 and joined[1].n_links == 0
    P = pytest.importorskip("public_tokenizers")
    pieces = packing.pack(df, P.path("byte_bpe_50k.json"))
    assert pieces.filter("piece = 0").count() == n and pieces.filter("length > 1024").count() == 0


def test_long_pages(spark, docs):
    _, big = docs
    pages = [("<article><p>" + big + "</article>", len(big)), ("<p>" * 50_000, 0), ("<" * 50_000, 50_000), (None, 0), ("<article>" + "<p>a</p>" * 20_000, 39_999)]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(pages)], "page_id long, html string")
    assert {r.page_id: r.n_chars for r in html_text.extract(df).collect()} == {i: n for i, (_, n) in enumerate(pages)}


def test_long_vectors_and_clashing_names(spark):
    """Vectors of a thousand components, fewer rows than asked for, and columns named like those of the result."""
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(1000)], "x", "y") for i in range(6)] + [(6, None, None, None), (7, [], None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, query_id string")
    got = hashing_search.nearest(df, F.col("vec_id") < 2).collect()
    assert sorted((x.query_id, x.rank) for x in got) == [(q, k) for q in (0, 1) for k in range(1, 6)]
    x = np.array([v for _, v, _, _ in rows[:6]])
    assert all(abs(g.score - np.linalg.norm(x[g.query_id] - x[g.vec_id])) < 1e-9 for g in got)
