"""The registered queries: SQL where there is some, contracts, and held-out accuracy on the test tables."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

from sonaria.llm import queries

DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, con, name):
    df = queries.QUERIES[name](spark, DIR)
    cur = con.execute(queries.SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(cur.fetchall())


def test_bytes_against_brute_force(spark, con):
    rows = [(i, (t or "").encode()) for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall()]
    got = {r.doc_id: r for r in queries.QUERIES["op8_suffix_dedup"](spark, DIR).collect()}
    seen: dict[bytes, int] = {}
    hashes = []
    for _, t in rows:  # 64-bit window hashes by a running polynomial, apart from the operator's own
        m, h, out = (1 << 61) - 1, 0, []
        top = pow(257, 399, m)
        for k, c in enumerate(t):
            if k >= 400:
                h = (h - t[k - 400] * top) % m
            h = (h * 257 + c) % m
            if k >= 399:
                out.append(h)
                seen[h] = seen.get(h, 0) + 1
        hashes.append(out)
    for (i, t), out in zip(rows, hashes, strict=True):
        d = np.zeros(len(t) + 1, int)
        for k, h in enumerate(out):
            if seen[h] > 1:
                d[k] += 1
                d[k + 400] -= 1
        gone = np.cumsum(d[:-1]) > 0
        left = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone, [0]]).astype(int)) == 1).sum())
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())


@pytest.mark.parametrize("name,column,parts,part,least", [("op3_quality", "quality", 5, 0, 0.97), ("op9_toxicity", "toxic", 4, 2, 0.9)])
def test_held_out(spark, con, name, column, parts, part, least):
    y = dict(con.execute(f"SELECT doc_id, {column} FROM labels").fetchall())
    rows = queries.QUERIES[name](spark, DIR).collect()
    assert len(rows) == con.execute("SELECT count(*) FROM documents").fetchall()[0][0]
    right = n = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == part) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.held_out and r.doc_id in y:
            n += 1
            right += r.predicted == y[r.doc_id]
    assert right >= least * n


def test_neighbours(spark, con):
    rows = con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = {}
    for r in queries.QUERIES["op4_neighbours"](spark, DIR).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    right = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        right += len(set(ids[np.lexsort((ids, d))[:10]]) & {v for v, _ in got[q].values()})
        assert sorted(got[q]) == list(range(1, 11))
    assert right >= 0.9 * 10 * len(got) and len(got) == (ids % 100 == 0).sum()


def test_main_text(spark, con):
    import html
    import re

    want = {}
    for i, page in con.execute("SELECT page_id, html FROM pages").fetchall():
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", p))).strip() for p in re.split(r"<(?!/?b>)[^>]*>", inner)]
        want[i] = " ".join(p for p in parts if p)
    got = queries.QUERIES["op1_main_text"](spark, DIR).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_private_values_are_gone(spark, con):
    import re

    seen = re.compile(r"\b[a-z]+\.\d+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|AKIA[A-Z0-9]{16}|(?<=password=)[0-9a-f]{18}")
    old = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    rows = {r.doc_id: r for r in queries.QUERIES["op6_pseudonyms"](spark, DIR).collect()}
    assert set(rows) == set(old)
    hits = 0
    for i, t in old.items():
        found = set(seen.findall(t or ""))
        hits += len(found)
        assert not any(v in rows[i].text for v in found) and (rows[i].n_pii > 0 or rows[i].text == t)
    assert hits > 20
