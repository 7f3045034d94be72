import itertools

import numpy as np
import pytest

from tessera.functions.pages import parse
from tessera.llm import html_extraction as H

LONG = "Words of a paragraph, enough of them to read like prose in an article that goes on for a while."
PROSE = f"<p>{LONG}</p>"
LAYOUTS = {
    "menu, advert, comments and footer": (
        f'<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><article><h1>Title</h1>{PROSE}<p>Of.</p><div class="ad">Buy this. {LONG}</div>{PROSE}</article>'
        f'<section id="comments"><div class=comment><div>{PROSE * 3}</div></div></section><footer>&copy; x</footer></body></html>',
        ["Title", LONG, "Of.", LONG],
    ),
    "class names only, a sidebar of prose": (
        f'<body><div id=wrap><div class="post-content"><h2>Head</h2>{PROSE * 3}<ul><li>one</li><li>two</li></ul></div><div class="sidebar"><h3>More</h3><div>{PROSE * 4}</div></div></div></body>',
        ["Head", LONG, LONG, LONG, "one", "two"],
    ),
    "names of the page's layout, a notice": (
        f'<body class="has-sidebar"><header><h1>Site</h1></header><main class="no-comments"><header><h1>Own</h1></header>{PROSE * 2}<form><label>Name</label></form></main><div class="cookie-notice">{PROSE}</div></body>',
        ["Own", LONG, LONG],
    ),
    "ends left out, raw text, references": (
        f'<article><p><b>A &amp; B &lt;c&gt; &#233;, {LONG}<br><p>x  y\n z<script>var t="</p><p>no";</script><style>p{{}}</style><!-- <p>no</p> --><p hidden>no<p>{LONG}',
        [f"A & B <c> é, {LONG}", "x y z", LONG],
    ),
    "inline names and links stay in their block": (f'<article><p>{LONG} <a href=x>a link</a> and <span class="high">light</span>.</p></article>', [f"{LONG} a link and light."]),
    "no markup": (LONG, [LONG]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts_by_the_prior_alone(name):
    page, want = LAYOUTS[name]
    got = H.content_of([page], H.potentials())[0][0].split("\n")
    assert got == want


def brute(parent, unary, edge):
    n = len(parent)
    total = np.zeros((n, 3))
    for s in itertools.product(range(3), repeat=n):
        p = np.exp(sum(unary[i, s[i]] for i in range(n)) + sum(edge[s[parent[i]], s[i]] for i in range(n) if parent[i] >= 0))
        for i in range(n):
            total[i, s[i]] += p
    return total / total.sum(axis=1, keepdims=True)


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(1, 8))
        parent = np.array([-1] + [int(rng.integers(-1, i)) for i in range(1, n)])
        unary, edge = rng.normal(0, 2, (n, 3)), rng.normal(0, 2, (3, 3))
        assert np.allclose(H.marginals(parent, unary, edge), brute(parent, unary, edge))
    assert H.marginals(np.zeros(0, np.int64), np.zeros((0, 3)), np.zeros((3, 3))).shape == (0, 3)


def test_states_follow_the_leaves():
    tree = H.tree_of(parse("<body><article><p>a</p><p>b</p></article><div><p>c</p><p>d</p></div></body>"))
    content = [t in ("a", "b", "c") for t in tree.text]
    said = {(f[0] if f else t): s for f, t, s in zip(tree.features, tree.text, H.states(tree, content), strict=True)}
    assert said["tag article"] == H.CONTENT and H.MIXED in H.states(tree, content)


def pages_of(spark, n=60):
    docs, pages = [], []
    for i in range(n):
        text = f"{LONG} Number {i}.\nOf {i}.\n{LONG} {i}"
        body = "".join(f"<p>{x}</p>" for x in text.split("\n"))
        docs.append((i, text, "other"))
        pages.append((i, f"http://h.example.com/en/{i}.html", f'<body><div class="zug"><p>{LONG} Never mind {i}.</p></div><article>{body}</article><footer>&copy; h</footer></body>', "x", "y"))
    pages += [(None, None, None, None, None), (900, "no url", "", None, None), (0, *pages[0][1:])]
    return spark.createDataFrame(pages, "page_id long, url string, html string, text string, block string"), spark.createDataFrame(docs, "doc_id long, text string, html string"), docs


def test_learns_names_from_labelled_pages(spark):
    pages, docs, texts = pages_of(spark)
    model = H.fit(pages, docs)
    assert model.feature["name zug"][H.CONTENT] < -1  # only labelled pages can tell
    got = H.extract(pages, model).collect()
    assert len(got) == 63
    for r in got:
        want = texts[r.page_id][1] if r.page_id is not None and r.page_id < 60 else ""
        assert (r.text, r.n_chars) == (want, len(want))
    few = H.labelled(pages, docs, 7)
    assert few.count() in (7, 8)  # copies of a page stand at the border
    assert H.extract(pages.limit(0), H.fit(pages.limit(0), docs)).count() == 0


def test_long_deep_and_broken_pages():
    model = H.potentials()
    deep = "<div>" * 3000 + PROSE
    long = "<article>" + PROSE * 20000 + "</article>"
    got = H.content_of([deep, long, "<", "<p", "</div></div>", "<a href='", "&#xD800;&#0;" + LONG], model)
    assert got[0][0] == LONG and got[1][0].count("\n") == 19999
    assert [t for t, _ in got[2:6]] == ["", "", "", ""] or got[2][0] == "<"
