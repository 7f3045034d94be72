"""Main text of web pages: content marginals of DOM nodes from sum-product on the page's tree.

Every element is content (all text below it is), noise (none is) or mixed; every text leaf is content or noise. Parent-child
potentials tie an element to its children; node potentials come from names (tag, words of class, id and role) and from the
text of leaves (length, share of links, ends of sentences, phrases). Messages go up and down the tree once, which is
exact on a tree, and give each leaf's marginal; leaves at one half or more are written.

Training counts states of nodes in labelled pages: pages whose path names a document, whose text says which leaves are
content. Counts are made in tasks and summed; only a table of features and states reaches the driver. At most `most`
labelled pages, chosen by a hash of their ids, are used. Pages of one layout cannot teach the names of others, so
potentials begin with what the names of HTML and common class words say (`PRIOR`), learnt terms are added, shrunk
by their counts and bounded, and no bound lets a single leaf overrule a named ancestor. Without labelled pages the prior works alone.

A leaf is the text of a stretch between borders of block elements under one element that counts: inline elements without
class or id belong to their block. References are decoded, white space becomes one blank, and blocks are joined by a
line end. Scripts, styles, heads, templates, controls and hidden elements hold no text.

Pages are independent: one narrow pass, about a megabyte of html at a time, or one page.

Defined results: null and empty html give an empty text; text without any markup is one leaf like any other; ids and urls may
be null or repeat, each row is read by itself; equal pages give equal texts; an empty table gives an empty one; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.pages import BLOCK, Page, parse

from .runtime import cut

CONTENT, NOISE, MIXED = 0, 1, 2
BATCH_BYTES = 1 << 20
FAR = -1e9
MOST_LABELLED = 2000

# Elements whose text a reader never sees as text.
UNSEEN = frozenset("script style head title template noscript noembed noframes iframe object svg math select textarea button datalist audio video canvas xmp".split())
# Tags that say something; containers such as div, section, ul or table do not.
TELLING = frozenset("article main nav aside footer header form menu dialog p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address search".split())
# Tags of single blocks. What one layout teaches of them says little of the next one, as of leaves.
SINGLE = frozenset(f"tag {t}" for t in "p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
# Log potentials of names, as (content, noise, mixed).
STRONG, SOME = (-12.0, 0.0, -12.0), (-3.0, 0.0, -2.0)
GOOD, FAIR = (0.0, -6.0, -8.0), (0.0, -2.0, -3.0)
PRIOR: dict[str, tuple[float, float, float]] = (
    {f"tag {t}": STRONG for t in "nav aside footer header form menu dialog search".split()}
    | {"tag address": SOME, "tag article": GOOD, "tag main": GOOD}
    | {f"tag {t}": (0.0, -0.5, 0.0) for t in "p h1 h2 h3 blockquote pre figcaption".split()}
    | {
        f"name {t}": STRONG
        for t in (
            "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion comment comments commentlist reply replies disqus discussion sidebar sidebars sidenav aside nav navbar navigation "
            "menu menubar breadcrumb breadcrumbs footer foot masthead topbar toolbar cookie cookies consent gdpr privacy notice notices alert popup modal overlay newsletter subscribe subscription signup signin login register "
            "form search responses response announcement teaser trending popular adslot adbox adunit adsbygoogle share sharing social related recommended recommendations widget widgets pagination pager paging copyright legal disclaimer skip"
        ).split()
    }
    | {f"name {t}": SOME for t in "header head meta tags tag toc links byline author rating vote print more hidden".split()}
    | {f"name {t}": FAIR for t in "article content contents post entry story main body text prose page maincontent articlebody".split()}
    | {"role navigation": STRONG, "role banner": STRONG, "role contentinfo": STRONG, "role complementary": STRONG, "role search": STRONG, "role form": STRONG, "role dialog": STRONG, "role alert": STRONG, "role main": GOOD, "role article": GOOD}
    | {"words 0": (-0.7, 0.0, 0.0), "words 1": (-0.3, 0.0, 0.0), "words 2": (0.0, -0.6, 0.0), "words 3": (0.0, -1.2, 0.0), "words 4": (0.0, -1.8, 0.0)}
    | {"links 2": (-0.7, 0.0, 0.0), "links 3": (-1.5, 0.0, 0.0), "sentence": (0.0, -0.4, 0.0), "owned": (-4.0, 0.0, 0.0), "phrase": (-1.5, 0.0, 0.0)}
)
# Phrases of notices and marks of ownership.
OWNED = re.compile(r"©|\(c\) ?\d{4}|all rights reserved", re.I)
PHRASE = re.compile(r"\b(?:cookies?|privacy policy|terms of (?:use|service)|subscribe|newsletter|sign (?:in|up)|log ?in|advertisement|sponsored|share this|leave a (?:reply|comment)|read more)\b", re.I)

# Parent state by child state, in logarithms: pure elements keep their state, with a small leak for marked exceptions.
EDGE_PRIOR = np.array([[0.0, -3.0, -7.0], [-12.0, 0.0, -12.0], [-0.4, -0.4, -0.4]])
ROOT_PRIOR = np.array([-1.0, -6.0, 0.0])
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Classes such as has-sidebar or no-comments tell of a page or its layout, not of the element.
FLAG = re.compile(r"(?:^|\s)(?:has|with|no|without|is|js)[-_]\S*")


@dataclass
class Tree:
    """Nodes in page order, parents first. A leaf has no name features of its own; `block` joins the leaves of a block."""

    parent: list[int] = field(default_factory=list)
    features: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    block: list[int] = field(default_factory=list)


def _named(tag: str, attributes: dict[str, str] | None, within: bool) -> tuple[str, ...]:
    """`within`: inside an article or main element, where a header holds the article's own heading."""
    found = [f"tag {tag}"] if tag in TELLING and not (within and tag == "header") else []
    if attributes and tag not in ("html", "body"):
        said = FLAG.sub(" ", f"{attributes.get('class', '')} {attributes.get('id', '')}")
        found += [f"name {w}" for w in dict.fromkeys(w.lower() for w in NAME.findall(said))]
        if attributes.get("role"):
            found.append(f"role {attributes['role'].strip().lower()}")
    return tuple(found)


def _hidden(attributes: dict[str, str] | None) -> bool:
    return bool(attributes) and ("hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I) is not None)


def _spaced(text: str) -> str:
    return " ".join(text.split())


def _said(text: str, linked: int) -> tuple[str, ...]:
    text = _spaced(text)
    n = text.count(" ") + 1
    share = linked / (len(text) - n + 1)
    found = [f"words {sum(n >= x for x in (3, 10, 25, 60))}", f"links {0 if not linked else 1 if share < 0.33 else 2 if share < 0.9 else 3}"]
    found += ["sentence"] if text[-1] in ".!?…:;\"'”»" else []
    found += ["owned"] if OWNED.search(text) else []
    return (*found, "phrase") if n < 40 and PHRASE.search(text) else tuple(found)


def tree_of(page: Page) -> Tree:
    """The page's tree of elements that count and of leaves; elements without text below them are left out."""
    n = len(page.tag)
    counts = [-1] * n  # the nearest element that counts, itself included; -2 where nothing is seen
    linked = [False] * n
    pieces: list[tuple[int, int, list[str], list[int]]] = []
    for i in range(n):
        up = page.parent[i]
        of, inside_link = (counts[up], linked[up]) if up >= 0 else (-1, False)
        tag = page.tag[i]
        if tag is None:
            if of != -2 and page.text[i]:
                if not pieces or pieces[-1][:2] != (page.block[i], of):
                    pieces.append((page.block[i], of, [], []))
                pieces[-1][2].append(page.text[i])
                pieces[-1][3].append(len("".join(page.text[i].split())) if inside_link else 0)
            continue
        a = page.attributes[i]
        linked[i] = inside_link or tag == "a"
        own = tag in BLOCK or (tag != "a" and a is not None and ("class" in a or "id" in a or "role" in a))
        counts[i] = -2 if of == -2 or tag in UNSEEN or _hidden(a) else i if own else of
    leaves = [(block, of, text, sum(links)) for block, of, texts, links in pieces if not (text := "".join(texts)).isspace()]
    needed: set[int] = set()
    for _, of, _, _ in leaves:
        while of >= 0 and of not in needed:
            needed.add(of)
            of = counts[page.parent[of]] if page.parent[of] >= 0 else -1
    tree = Tree([-1], [()], [None], [-1])  # a root above all, as pages may lack one
    place, within = {-1: 0}, {-1: False}
    for i in sorted(needed):
        up = counts[page.parent[i]] if page.parent[i] >= 0 else -1
        place[i] = len(tree.parent)
        tree.parent.append(place[up])
        within[i] = within[up] or page.tag[i] in ("article", "main")
        tree.features.append(_named(page.tag[i], page.attributes[i], within[up]))
        tree.text.append(None)
        tree.block.append(-1)
    for block, of, text, links in leaves:
        tree.parent.append(place[of])
        tree.features.append(_said(text, links))
        tree.text.append(text)
        tree.block.append(block)
    return tree


def states(tree: Tree, content: list[bool]) -> list[int]:
    """States of all nodes from those of the leaves (`content` is looked up at leaves only)."""
    seen = [0] * len(tree.parent)  # bit 0: content below, bit 1: noise below
    for i in range(len(tree.parent) - 1, -1, -1):  # leaves come after all elements, elements after their parents
        if tree.text[i] is not None:
            seen[i] = 1 if content[i] else 2
        if tree.parent[i] >= 0:
            seen[tree.parent[i]] |= seen[i]
    return [{1: CONTENT, 2: NOISE}.get(x, MIXED) for x in seen]


def labels_from(tree: Tree, document: str) -> list[bool]:
    """A leaf is content if it is a line of the document, or 40 characters or more of one."""
    lines, whole = {_spaced(x) for x in document.split("\n")}, _spaced(document)
    return [t is not None and ((x := _spaced(t)) in lines or (len(x) >= 40 and x in whole)) for t in tree.text]


@dataclass
class Potentials:
    """Log potentials by state: of features, of parent and child, of the root."""

    feature: dict[str, np.ndarray]
    edge: np.ndarray
    root: np.ndarray


def potentials(counts: dict[tuple[str, str, int], int] | None = None) -> Potentials:
    """From the prior and counts by (kind, key, state): features and numbers of elements and leaves, edges, roots."""
    feature = {k: np.array(v) for k, v in PRIOR.items()}
    edge, root = EDGE_PRIOR.copy(), ROOT_PRIOR.copy()
    counts = counts or {}
    nodes = {kind: np.array([counts.get(("nodes", kind, s), 0) for s in range(3)], float) for kind in ("element", "leaf")}
    for kind in ("element", "leaf"):
        some = nodes[kind] > 0
        for key in {k for what, k, _ in counts if what == kind}:
            n = np.array([counts.get((kind, key, s), 0) for s in range(3)], float)
            share = np.log((n + 1) / (nodes[kind] + 2))
            gain = np.where(some, share - share[some].max(), 0.0) * n.sum() / (n.sum() + 20)
            reach = 1.0 if kind == "leaf" or key in SINGLE else 4.0
            feature[key] = feature.get(key, np.zeros(3)) + np.clip(gain, -reach, 0.0)
    mixed = np.array([counts.get(("edge", str(MIXED), s), 0) for s in range(3)], float)
    if mixed.sum():  # pure parents have children of their own state by definition: only mixed ones are learnt, within bounds
        edge[MIXED] += np.clip(np.log((mixed + 5) / (mixed + 5).max()), -0.5, 0.0)
    return Potentials(feature, edge, root)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(parent: np.ndarray, unary: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Marginal distribution of every node of a forest by sum-product; parents come before their children, -1 for roots.

    Messages of all nodes of one depth are computed together, upward from the deepest, then downward.
    """
    n, k = unary.shape
    depth = np.zeros(n, np.int64)
    for i, p in enumerate(parent.tolist()):
        if p >= 0:
            depth[i] = depth[p] + 1
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if n else []
    belief, message = unary.copy(), np.zeros((n, k))
    for at in levels[:0:-1]:
        message[at] = _log_sum(edge[None] + belief[at][:, None, :], 2)
        np.add.at(belief, parent[at], message[at])
    for at in levels[1:]:
        rest = belief[parent[at]] - message[at]
        belief[at] += _log_sum(edge[None] + rest[:, :, None], 1)
    out = np.exp(belief - belief.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def folded(parent: np.ndarray, unary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node that stands for each one, parents and potentials of those): an only child has its parent's text, hence its state."""
    n = len(parent)
    alone = (parent >= 0) & (np.bincount(parent[parent >= 0], minlength=n)[parent] == 1)
    stands = np.cumsum(~alone) - 1
    for i in np.flatnonzero(alone).tolist():
        stands[i] = stands[parent[i]]
    up = parent[~alone]
    total = np.zeros((len(up), unary.shape[1]))
    np.add.at(total, stands, unary)
    return stands, np.where(up >= 0, stands[up], -1), total


def _unary(tree: Tree, model: Potentials) -> np.ndarray:
    out = np.zeros((len(tree.parent), 3))
    for i, names in enumerate(tree.features):
        for f in names:
            if (w := model.feature.get(f)) is not None:
                out[i] += w
        if tree.text[i] is not None:
            out[i, MIXED] = FAR
            edge = out[i, CONTENT] - out[i, NOISE]
            out[i, CONTENT], out[i, NOISE] = (max(-4.0, min(2.0, edge)), 0.0)
        elif not i:
            out[i] += model.root
    return out


def content_of(pages: list[str | None], model: Potentials) -> list[tuple[str, float]]:
    """(main text, smallest margin of a leaf's marginal from one half) of each page."""
    trees = [tree_of(parse(html)) for html in pages]
    first = np.cumsum([0, *(len(t.parent) for t in trees)])
    parent = np.concatenate([np.where(np.array(t.parent) >= 0, np.array(t.parent) + a, -1) for t, a in zip(trees, first[:-1], strict=True)]) if trees else np.zeros(0, np.int64)
    stands, parent, unary = folded(parent, np.concatenate([_unary(t, model) for t in trees]) if trees else np.zeros((0, 3)))
    chance = marginals(parent, unary, model.edge)[stands, CONTENT]
    out = []
    for t, a in zip(trees, first[:-1].tolist(), strict=True):
        blocks: dict[int, list[str]] = {}
        margin = 0.5
        for i in range(len(t.parent)):
            if (text := t.text[i]) is not None:
                p = float(chance[a + i])
                margin = min(margin, abs(p - 0.5))
                if p >= 0.5:
                    blocks.setdefault(t.block[i], []).append(text)
        out.append(("\n".join(_spaced("".join(blocks[b])) for b in sorted(blocks)), margin))
    return out


def document_named(url: str = "url"):
    """The id that a path such as /en/123 names."""
    return F.expr(f"try_cast(nullif(regexp_extract({url}, '^[^?#]*?://[^/?#]*/[^/?#]+/([0-9]+)', 1), '') as long)")


def labelled(pages: DataFrame, docs: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """html and document of at most `most` pages that name a document."""
    named = pages.select("html", F.xxhash64("page_id", "url").alias("key"), document_named().alias("named")).where("named is not null and html is not null")
    chosen = cut(named.select("key", "named").orderBy("key", "named").limit(most))  # keys alone, not pages, are compared
    some = named.join(F.broadcast(chosen.select("key").distinct()), "key", "left_semi")
    texts = docs.select(F.col("doc_id").alias("named"), F.col("text").alias("document")).where("document is not null")
    return some.join(texts.join(F.broadcast(chosen.select("named").distinct()), "named", "left_semi"), "named").select("html", "document")


def fit(pages: DataFrame, docs: DataFrame, most: int = MOST_LABELLED) -> Potentials:
    """Potentials from at most `most` labelled pages (a documented bound on the sample)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for html, document in zip(batch["html"].to_pylist(), batch["document"].to_pylist(), strict=True):
                tree = tree_of(parse(html))
                state = states(tree, labels_from(tree, document))
                for i, s in enumerate(state):
                    kind = "element" if tree.text[i] is None else "leaf"
                    n["nodes", kind, s] += 1
                    n.update((kind, f, s) for f in tree.features[i])
                    if tree.parent[i] >= 0:
                        n["edge", str(state[tree.parent[i]]), s] += 1
        yield pa.record_batch([pa.array([k[j] for k in n], t) for j, t in enumerate((pa.string(), pa.string(), pa.int32()))] + [pa.array(list(n.values()), pa.int64())], names=["kind", "key", "state", "n"])

    rows = labelled(pages, docs, most).mapInArrow(count, "kind string, key string, state int, n long").groupBy("kind", "key", "state").agg(F.sum("n").alias("n"))
    return potentials({(r.kind, r.key, r.state): r.n for r in rows.collect()})  # names seen in the bounded sample


def extract(pages: DataFrame, model: Potentials, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars and margin (how far from one half the least certain leaf is) of every page."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum([0, *((v or 0) for v in pc.binary_length(batch["html"]).to_pylist())])
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(size, size[i] + BATCH_BYTES, side="right")) - 1)
                got = content_of(batch["html"].slice(i, j - i).to_pylist(), model)
                texts = [t for t, _ in got]
                yield pa.record_batch([batch["page_id"].slice(i, j - i), batch["url"].slice(i, j - i), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([m for _, m in got], pa.float64())], names=["page_id", "url", "text", "n_chars", "margin"])
                i = j

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, margin double")
