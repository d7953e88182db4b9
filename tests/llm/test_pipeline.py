import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from sonaria.llm import common

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(11)
    voc = [a + b + c for a in "bcdfg" for b in "aeiou" for c in ("n", "r", "st")]
    rows, labels = [], []
    for i in range(400):
        w = [x + ("." if r.random() < 0.1 else "") for x in r.choices(voc, k=r.randrange(40, 90))]
        if i % 8 == 0:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["vilest", "foulest"]))
        rows.append([i, " ".join(w), "en", "s", 0])
        labels.append((i, 1, int(i % 8 == 0)))
    item = " ".join(r.choices(voc, k=25))
    rows[3][1] += " " + item[:120]
    rows[5][1] += " 4111111111111111 joe.doe@example.org"
    rows += [[500, rows[1][1], "en", "s", 0], [501, rows[2][1] + " extra", "en", "s", 0], [502, None, None, None, None], [503, "", "en", "s", 0], [9, rows[9][1], "en", "s", 0], [None, rows[10][1], "en", "s", 0]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
        steps[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    ids = {k: Counter(x.doc_id for x in v) for k, v in steps.items()}
    clean = {i for i in range(400) if i % 8}
    assert not [i for i in ids["toxicity"] if i is not None and i < 400 and i not in clean]
    assert clean | {500, 501, 502, 503, None} <= set(ids["toxicity"])
    assert set(ids["jaccard_join"]) == set(ids["toxicity"]) - {500, 501, None} and max(ids["jaccard_join"].values()) == 1
    assert set(ids["jaccard_join"]) - set(ids["decontamination"]) == {3}
    assert ids["pseudonyms"] == ids["decontamination"]
    text = {x.doc_id: x.text for x in steps["pseudonyms"]}
    assert "4111111111111111" not in text[5] and "joe.doe" not in text[5] and re.search(r" \d{16} [a-z]{3}\.[a-z]{3}@example\.org$", text[5])
    assert {x.doc_id: x.text for x in steps["decontamination"] if x.doc_id != 5} == {k: v for k, v in text.items() if k != 5}
    assert Counter(x.doc_id for x in steps["packing"] if x.piece == 0) == ids["pseudonyms"]
    assert sorted(map(tuple, pipeline.run(spark, folder).select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=repr) == sorted(((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in steps["packing"]), key=repr)


def test_rows_that_share_an_id_or_have_none(spark, folder):
    r = random.Random(12)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    voc = [a + b for a in "klmnp" for b in ("amo", "iru", "eto", "usa", "ona")]
    one, two, three, four, five = (" ".join(r.choices(voc, k=60)) for _ in range(5))
    item = spark.read.parquet(f"{folder}/benchmark.parquet").filter("item_id = 1").first().text
    rows = [(1, one), (1, two), (1, one), (2, two + " extra"), (None, three), (None, three + " extra"), (None, four), (None, ""), (None, None), (3, ""), (3, None), (4, five), (4, f"{four} {item}")]
    df = spark.createDataFrame([(i, x, None, None, 0) for i, x in rows], docs.schema)
    got = pipeline.near_duplicates(spark, df, folder)
    left = Counter((x.doc_id, x.text) for x in got.collect())
    near = {(None, three), (None, three + " extra")}
    assert left[None, three] + left[None, three + " extra"] == 1
    assert Counter({k: n for k, n in left.items() if k not in near}) == Counter((set(rows) - near) - {(2, two + " extra")})
    clean = {(x.doc_id, x.text) for x in pipeline.decontamination(spark, got, folder).collect()}
    assert set(left) - clean == {(4, f"{four} {item}")}


def test_columns_that_operators_use_too(spark, folder):
    """Columns with the names of an operator's own pass through, and a copy without an id goes, not its document."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id is null or doc_id < 40")
    names = ["score", "sentences", "n_pii", "_key", "key", "node", "root", "class_id", "hits", "odd name: `x`"]
    docs = docs.select("*", *(F.concat_ws("-", F.lit(k), "doc_id").alias(n) for k, n in enumerate(names)))
    columns, rows = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        got = docs.collect()
        assert all(r[n] == "-".join(map(str, [k, r.doc_id])) for r in got if r.doc_id is not None for k, n in enumerate(names))
        assert 0 < len(got) <= rows and (name == "toxicity" or not [r for r in got if r.doc_id is None])


def test_what_a_run_leaves(spark, folder):
    mark = common.made()
    out = pipeline.run(spark, folder)
    assert common.made() == mark + 1 and out.count() > 0
    common.release(spark, mark)
    assert common.made() == mark


def test_empty(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_stages_against_brute_force(spark, folder):
    """Each stage's rows again, from what the stage before it left: links, passages and pseudonyms by brute force."""
    import test_decontaminate
    import test_jaccard
    import test_pii

    from sonaria.llm import pii

    docs = pipeline.toxicity(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    classes = test_jaccard.brute([(k, t) for k, (_, t) in enumerate(rows)])  # by place, so that every row has an id
    best = {}
    for k, least, *_ in classes:
        d = rows[k][0]
        best.setdefault(least, []).append((d is None, d or 0, k))
    want = Counter(rows[min(group)[2]] for group in best.values())
    alike = {(min(group)[:2], group[0][0]) for group in best.values()}
    assert len(alike) == len(best)
    docs = pipeline.near_duplicates(spark, docs, folder)
    assert Counter((r.doc_id, r.text) for r in docs.collect()) == want

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    left = list(want)
    hit = [n > 0 for _, _, n, _ in test_decontaminate.brute(left, items, 10)]
    want = Counter(row for row, h in zip(left, hit, strict=True) if not h)
    docs = pipeline.decontamination(spark, docs, folder)
    assert Counter((r.doc_id, r.text) for r in docs.collect()) == want

    key = pii.key_of(spark)
    want = Counter((d, t and re.sub(pii.ANY, lambda m: test_pii.brute(key, m[0]), t)) for d, t in want)
    docs = pipeline.pseudonyms(spark, docs, folder)
    assert Counter((r.doc_id, r.text) for r in docs.collect()) == want

    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    size = Counter()
    for r in pipeline.packed(spark, docs, folder).collect():
        size[r.doc_id] += r.length
    assert size == Counter({d: len(tokens.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in want})
