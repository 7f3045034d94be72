"""The element tree of a web page, as far as reading its text needs it.

Nodes stand in page order, in parallel lists. Ends that authors leave out are implied (paragraphs, list items, table cells
and rows, options), stray end tags are ignored, raw elements keep their text unparsed. Nothing recurses, so depth is no limit.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DECODED = frozenset("textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
ENDS_PARAGRAPH = BLOCK - frozenset("body caption dd dt frameset head html legend li optgroup option select tbody td tfoot th thead title tr".split())
# A start tag ends the nearest open element of the first set, unless one of the second stands between.
IMPLIED = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"), "optgroup": ("option optgroup", "select"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tr": ("tr", "tbody thead tfoot table"),
    "tbody": ("tbody thead tfoot", "table"), "thead": ("tbody thead tfoot", "table"), "tfoot": ("tbody thead tfoot", "table"), "body": ("head", "body"),
}
IMPLIED_ENDS = {tag: (frozenset(a.split()), frozenset(b.split())) for tag, (a, b) in IMPLIED.items()}
PARAGRAPH = (frozenset(["p"]), frozenset("table td th caption button object template html".split()))

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(?:>|\Z)""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'=<>`]++)))?""")


@dataclass
class Page:
    """Elements have a tag, texts have none; `block` numbers the stretches between borders of block elements."""

    parent: list[int] = field(default_factory=list)
    tag: list[str | None] = field(default_factory=list)
    attributes: list[dict[str, str] | None] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    block: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str | None, attributes: dict[str, str] | None, text: str, block: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.text.append(text)
        self.block.append(block)
        return len(self.tag) - 1


def attributes_of(raw: str) -> dict[str, str]:
    """Names in lower case; the first of a repeated name counts."""
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def parse(source: str | None) -> Page:
    source = source or ""
    page = Page()
    stack: list[int] = []
    standing: Counter[str] = Counter()  # open elements by tag, so that deep pages are not searched for what is not there
    at = block = 0

    def end(names: frozenset, unless: frozenset) -> None:
        """Close the nearest open element of `names`, if none of `unless` is nearer."""
        nonlocal block
        if not any(standing[n] for n in names):
            return
        for depth in range(len(stack) - 1, -1, -1):
            tag = page.tag[stack[depth]]
            if tag in names:
                standing.subtract(page.tag[x] for x in stack[depth:])
                block += any(page.tag[x] in BLOCK for x in stack[depth:])
                del stack[depth:]
                return
            if tag in unless:
                return

    def write(a: int, b: int, raw: bool = False) -> None:
        if b > a:
            text = source[a:b]
            page.add(stack[-1] if stack else -1, None, None, text if raw or "&" not in text else html.unescape(text), block)

    while m := TOKEN.search(source, at):
        write(at, m.start())
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:  # an inline element is not closed across a block that stands open in it
            end(frozenset([tag]), frozenset() if tag in BLOCK else BLOCK)
            continue
        if tag in ENDS_PARAGRAPH:
            end(*PARAGRAPH)
        if tag in IMPLIED_ENDS:
            end(*IMPLIED_ENDS[tag])
        block += tag in BLOCK
        node = page.add(stack[-1] if stack else -1, tag, attributes_of(m[3]) if m[3].strip(" /\n\t") else None, "", block)
        if tag == "br":
            page.add(stack[-1] if stack else -1, None, None, "\n", block)
        if tag in VOID:
            block += tag in BLOCK
            continue
        stack.append(node)
        standing[tag] += 1
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            stop = close.start() if close else len(source)
            write(at, stop, raw=tag not in DECODED)
            at = stop
    write(at, len(source))
    return page
