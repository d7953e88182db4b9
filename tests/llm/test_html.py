import pytest

from sonaria.llm import html_text as H

PARA = "This paragraph has a good many plain words so that nobody would take it for a menu entry at all. "


@pytest.fixture(scope="module")
def tree():
    return H.train()


def test_tree_fits_its_table(tree):
    x, y = H.LABELLED[:, :-1], H.LABELLED[:, -1]
    assert ((tree.predict(x) >= 0.5) == y).all()


def test_neighbours_carry_weight(tree):
    """The tree looks at the words and the links of the blocks before and after, and they alone can decide."""
    used = {H.FEATURES[n[0]] for n in tree.nodes if n[0] >= 0}
    assert {"words_before", "words_after"} <= used and {"links_before", "links_after"} & used
    beside = [(7, 0.0, 4, 1.0, 3, 1.0, 0, 0, 0), (7, 0.0, 50, 0.0, 60, 0.0, 0, 0, 0)]
    assert (tree.predict(H.np.array(beside)) >= 0.5).tolist() == [False, True]


CASES = {
    "article": (
        f"<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>a</a></li><li><a href=/b>b</a></li></ul></nav>"
        f"<!-- ad 1 --><div class='ad'>Buy this thing now.</div><article><h1>A &amp; B</h1><p><b>{PARA}<br><p>Short.</p><p>x&nbsp;y&#233;&#x41; &lt;z&gt;</article><footer>&copy; me</footer></body></html>",
        f"A & B {PARA.strip()} Short. x yéA <z>",
    ),
    "comments": (f"<main><p>{PARA}</p><section id=comments><p>I am a reader and I say this.</p></section><aside>{PARA}</aside><form>Name <input></form></main>", PARA.strip()),
    "bare": (f"<p>{PARA}</p><p>So.</p><p>{PARA}</p>", f"{PARA.strip()} So. {PARA.strip()}"),
    "menu without element": (f"<div><a href=1>One</a></div><div><a href=2>Two</a></div><div>{PARA}</div>", PARA.strip()),
    "no enclosing element": (
        f"<div><a href=1>Home</a></div><div><a href=2>News</a></div><div>Welcome to the site of tests</div><div><a href=3>About us</a></div><h1>What happened</h1><p>{PARA}</p><p>A short one here.</p>"
        f"<p>{PARA}{PARA}</p><div><a href=4>Imprint</a> <a href=5>Privacy</a></div><div>All rights reserved by the makers</div>",
        f"What happened {PARA}A short one here. {PARA}{PARA.strip()}",
    ),
    "blocks of bold text": (f"<center><a href=1>a b c</a></center><center>Best site of all the web</center><center><a href=2>d e f</a></center><center>{PARA}</center><center>So it goes.</center><center>{PARA}</center>", f"{PARA}So it goes. {PARA.strip()}"),
    "list of links in front and behind": (f"<article><ul><li><a>x</a></li></ul><p>{PARA}</p><ul><li><a>y</a></li></ul></article>", f"x {PARA.strip()} y"),
    "broken": (f"<article><p>{PARA}<b>un<i>closed</p></div></nav> and <p", f"{PARA}unclosed and"),
    "inline": ("<article><p>a<b>b</b><span>c</span> d\n\t e</p></article>", "abc d e"),
    "hidden": (f"<article><p hidden>no</p><div aria-hidden=true>no</div><template><p>no</p></template><textarea>no <p></textarea><p>{PARA}</p></article>", PARA.strip()),
    "plain": ("just text & more < 3", "just text & more < 3"),
    "empty": ("", ""),
    "null": (None, ""),
    "nothing": ("<html><nav><a href=/>x</a></nav></html>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_page(tree, name):
    page, want = CASES[name]
    assert H.main_text(page, tree) == want


def test_table(spark):
    rows = [(i, "u", p, 3) for i, (p, _) in enumerate(CASES.values())] + [(None, None, CASES["article"][0], 4), (7, "u", "<p>" + "<b>x</b> " * 20000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = H.extract(df)
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    got = out.collect()
    assert [r.text for r in got[: len(CASES)]] == [w for _, w in CASES.values()]
    assert all(r.n_chars == len(r.text) for r in got) and got[-1].n_chars == 39999
    assert H.extract(df.limit(0)).count() == 0
