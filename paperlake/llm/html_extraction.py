"""Main text of web pages by gradient-boosted trees over DOM nodes (operator 1).

A page is read into a tree of block elements. Trees over features of a node
(subtree density, attribute tokens, depth and sibling statistics, and the same of
its parent) give the log-odds that the node holds main text. Decoding picks the
most likely labelling of the whole tree in which nothing inside a rejected
element is kept, so ancestors and descendants never contradict each other.

The model is fitted in the driver on ``TRAINING_PAGES`` pages made by rule (see
``html_pages``); this bound does not depend on the input. Every page is then
judged by itself in one task, from its whole HTML.

Defined results: null or empty HTML, and pages without main text, give an empty
text and 0 characters; character references are decoded; broken nesting is
repaired as browsers do for paragraphs, list items and cells; a run of white
space is one space; blocks are joined by one space in page order; scripts,
styles, comments, sections of character data, form controls and embedded objects
never count, labels and formulas are text; a control, object or raw element that is
not closed ends with the element around it, with the next of its kind, or, if its
end tag is missing, at the next block; a tag that is not closed lasts to the end. Repeated rows
are judged alike; an empty table gives no rows; input columns named like an added
one are replaced, all others stay.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paperlake.llm.boosting import Boosted, fit
from paperlake.llm.html_pages import labelled_pages
from paperlake.llm.sentencepiece_model import slices

TRAINING_PAGES = 1_000
CHUNK = 1 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "script style noscript template head title textarea select datalist option button iframe object svg canvas audio video annotation annotation-xml input".split()
)
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var"
    " math mi mn mo ms mtext mspace mrow msup msub msubsup mfrac msqrt mroot mstyle mover munder munderover mpadded menclose mfenced mtable mtr mtd semantics".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
# An opening tag ends open elements of these kinds, up to the nearest element of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
MAIN_TOKENS = frozenset("article articles content main post entry story body text page primary".split())
OTHER_TOKENS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager tabs toc",
    "edge": "header masthead footer foot bottom top colophon copyright banner branding",
    "ad": "ad ads advert advertisement sponsored promo sponsor adslot adsense commercial",
    "side": "sidebar aside side widget related recommended popular read tags rail",
    "talk": "comment comments responses reply replies discussion disqus respond",
    "share": "share social follow byline sharing",
    "notice": "cookie cookies notice alert gdpr consent message popup modal overlay warning",
    "form": "newsletter subscribe search signup login contact form register",
}
TOKEN_KINDS = {w: k for k, (_, ws) in enumerate(OTHER_TOKENS.items()) for w in ws.split()}
TAG_GROUPS = {
    t: k
    for k, ts in enumerate(
        ("article main", "nav menu", "header", "footer", "aside", "p blockquote pre", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd",
         "form fieldset", "table tbody thead tr td th", "section", "div", "body html", "figure figcaption details")
    )
    for t in ts.split()
}
N_GROUPS = 16
BLOCKS = CLOSES_P | TAG_GROUPS.keys()
NESTED = frozenset("object svg canvas audio video template annotation-xml".split())  # skipped elements that may hold their like

# A quote opens a value only after "="; a value that is not closed is none, and the tag ends at the next ">".
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>=]|=)*+)(?:>|\Z)|[^<]+|<""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW_EDGE = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "items", "names", "main", "chars", "link_chars", "tags", "marks", "words", "index")

    def __init__(self, tag: str, parent: "Node | None"):
        self.tag, self.parent = tag, parent
        self.children: list[Node] = []
        self.items: list = []  # texts and child nodes in page order
        self.names: list[str] = []
        self.main = False
        self.chars = self.link_chars = self.tags = self.marks = self.words = self.index = 0


def parse(page: str) -> Node:
    """The tree of block elements; inline elements are text of the block around them, skipped ones are left out."""
    root = Node("html", None)
    # open elements: (tag, the block node that takes text, whether the element is such a node)
    stack: list[tuple[str, Node, bool]] = [("html", root, True)]
    skipping, inside, closed = "", [], True  # the skipped element, what is open in it, whether its end tag follows
    last: dict[str, int] = {}
    links = 0
    at, size = 0, len(page)
    last_data = page.rfind("]]>")
    while at < size:
        if at < last_data and page.startswith("<![CDATA[", at):
            at = page.index("]]>", at) + 3
            continue
        match = _TOKEN.match(page, at)
        at = match.end()
        tag = match[2]
        if tag is None:
            text = match[0]
            if not text.startswith("<") or text == "<":
                if not skipping:
                    _add_text(stack[-1][1], text, links > 0)
            continue
        tag = tag.lower()
        if skipping:
            if match[1]:
                if tag in inside:
                    while inside.pop() != tag:
                        pass
                    continue
                if tag == skipping:
                    skipping = ""
                    continue
                if tag not in ("html", "body") and all(t != tag for t, _, _ in stack[1:]):
                    continue
                skipping = ""  # an element around it ends
            elif skipping == "head" and tag not in SKIPPED and tag not in VOID:
                skipping = ""  # a head that was never closed
            elif skipping == tag and tag not in NESTED or skipping == "option" and tag == "optgroup":
                skipping = ""
            elif not closed and tag in BLOCKS:
                skipping = ""
            else:
                if not match[3].endswith("/") and tag not in VOID:
                    if tag not in RAW:
                        inside.append(tag)
                    elif end := _raw_end(page, at, tag, last):
                        at = end
                continue
        if match[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    links -= sum(1 for t, _, _ in stack[k:] if t == "a")
                    del stack[k:]
                    break
            if tag == "br":
                _add_text(stack[-1][1], " ", False)
            continue
        if tag in RAW and (end := _raw_end(page, at, tag, last)):
            at = end
            continue
        if tag in SKIPPED:
            if tag not in VOID and not match[3].endswith("/"):
                skipping, inside, closed = tag, [], tag not in RAW and _is_closed(page, at, tag, last)
            continue
        if tag in VOID:
            _add_text(stack[-1][1], " " if tag in ("br", "hr") else "", False)
            continue
        if tag in ("html", "body"):
            if tag == "body":
                root.tag = "body"
            _read_attributes(root, match[3])
            continue
        if tag in INLINE:
            links += tag == "a"
            stack[-1][1].tags += 1
            stack.append((tag, stack[-1][1], False))
            continue
        if tag in CLOSES_P:
            _close(stack, {"p"}, {"table", "td", "th", "li", "div", "section", "article", "body"})
        if tag in ENDS:
            _close(stack, *ENDS[tag])
        links = sum(1 for t, _, _ in stack if t == "a") if links else 0
        parent = stack[-1][1]
        node = Node(tag, parent)
        parent.children.append(node)
        parent.items.append(node)
        if match[3]:
            _read_attributes(node, match[3])
        stack.append((tag, node, True))
    return root


def _raw_end(page: str, at: int, tag: str, last: dict[str, int]) -> int | None:
    """Where the raw element whose start tag ends at ``at`` ends; none if its end tag is missing.

    It is missing as well if, but for scripts and styles, another element of the kind starts before it.
    """
    if last.get(f"/{tag}", at) < at:  # there is none from here on
        return None
    found = _RAW_EDGE[tag].search(page, at)
    while found and not found[1] and tag in ("script", "style"):
        found = _RAW_EDGE[tag].search(page, found.end())
    if found is None:
        last[f"/{tag}"] = -1
    return found.end() if found and found[1] else None


def _is_closed(page: str, at: int, tag: str, last: dict[str, int]) -> bool:
    """Whether the end tag of the element whose start tag ends at ``at`` follows; ``last`` keeps places of last end tags."""
    if tag in NESTED:
        if tag not in last:
            last[tag] = max((x.start() for x in re.finditer(rf"</{tag}[\s/>]", page, re.I)), default=-1)
        return last[tag] >= at
    found = re.compile(rf"<(/?){tag}[\s/>]", re.I).search(page, at)
    return found is not None and found[1] == "/"


def _close(stack: list, kinds: set, border: set) -> None:
    """End the nearest open element of the kinds, and what is open in it, unless a border stands before it."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k][0] in kinds:
            del stack[k:]
            return
        if stack[k][0] in border:
            return


def _add_text(node: Node, text: str, linked: bool) -> None:
    node.items.append(text)
    bare = len(text) - text.count(" ") if text.strip() else 0
    if bare:
        node.chars += bare
        node.link_chars += bare if linked else 0
        node.words += text.count(" ") + 1
        node.marks += text.count(".") + text.count(",") + text.count("?")


def _read_attributes(node: Node, text: str) -> None:
    for found in _ATTRIBUTE.finditer(text):
        if found[1].lower() == "data-main":
            node.main = True
        else:
            node.names += _WORD.findall((found[2] or found[3] or found[4] or "").lower())


def nodes_of(root: Node) -> list[Node]:
    """All nodes, parents before children, without recursion."""
    found, at = [root], 0
    while at < len(found):
        found[at].index = at
        found += found[at].children
        at += 1
    return found


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node."""
    n = len(nodes)
    parent = np.array([0 if x.parent is None else x.parent.index for x in nodes])
    own = np.array([(x.chars, x.link_chars, x.words, x.marks, x.tags, 1) for x in nodes], dtype=np.float64)
    whole = own.copy()
    for k in range(n - 1, 0, -1):  # children come after their parents
        whole[parent[k]] += whole[k]
    group = np.array([TAG_GROUPS.get(x.tag, N_GROUPS - 1) for x in nodes])
    named = np.zeros((n, len(OTHER_TOKENS) + 1))
    for k, x in enumerate(nodes):
        for w in x.names:
            if w in MAIN_TOKENS:
                named[k, -1] = 1
            elif w in TOKEN_KINDS:
                named[k, TOKEN_KINDS[w]] = 1
    special = np.zeros((n, 6))  # nav, header, footer, aside, form, article among the node and its ancestors
    for column, groups in enumerate((1, 2, 3, 4, 9, 0)):
        special[:, column] = group == groups
    above, depth = named.copy(), np.zeros(n)
    order, siblings = np.zeros(n), np.ones(n)
    for k in range(1, n):
        depth[k] = depth[parent[k]] + 1
        above[k] = np.maximum(above[k], above[parent[k]])
        special[k] = np.maximum(special[k], special[parent[k]])
    for x in nodes:
        for place, child in enumerate(x.children):
            order[child.index], siblings[child.index] = place, len(x.children)
    chars, links, words, marks, tags, count = whole.T
    total = max(chars[0], 1.0)
    per_word = np.maximum(words, 1)
    paragraphs = np.array([x.tag == "p" for x in nodes], dtype=np.float64)
    in_p = chars * paragraphs
    inside_p, most = in_p.copy(), np.zeros(n)
    for k in range(n - 1, 0, -1):
        inside_p[parent[k]] += 0 if paragraphs[parent[k]] else inside_p[k]
        most[parent[k]] = max(most[parent[k]], chars[k])
    basic = np.stack(
        [
            np.log1p(chars), links / np.maximum(chars, 1), np.log1p(words), marks / per_word, chars / per_word,
            chars / (tags + count), np.log1p(count), chars / total, own[:, 0] / np.maximum(chars, 1), inside_p / np.maximum(chars, 1),
        ],
        axis=1,
    )
    local = np.stack(
        [
            depth, order, order / siblings, siblings, chars / np.maximum(most[parent], 1), chars / np.maximum(chars[parent], 1),
            (own[:, 0] > 0), np.arange(n) / n,
        ],
        axis=1,
    )
    tag = np.eye(N_GROUPS)[group]
    return np.concatenate([basic, local, tag, named, above, special, basic[parent], tag[parent], named[parent]], axis=1)


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The most likely labelling in which every child of a rejected node is rejected; the root is kept."""
    keep = -np.logaddexp(0, -odds)  # log-probabilities of the node's own label
    drop = -np.logaddexp(0, odds)
    best_keep, best_drop = keep.copy(), drop.copy()
    for k in range(len(nodes) - 1, 0, -1):
        p = nodes[k].parent.index
        best_keep[p] += max(best_keep[k], best_drop[k])
        best_drop[p] += best_drop[k]
    kept = np.zeros(len(nodes), dtype=bool)
    kept[0] = True
    for k in range(1, len(nodes)):
        kept[k] = kept[nodes[k].parent.index] and best_keep[k] >= best_drop[k]
    return kept


def text_of(root: Node, kept: np.ndarray) -> str:
    """The text of the kept nodes: blocks in page order, inline markup without a trace."""
    parts: list[str] = []
    todo: list = [root]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            parts.append(item)
        elif kept[item.index]:
            parts.append("\n")
            todo.append("\n")
            todo += reversed(item.items)
    return " ".join(html.unescape("".join(parts)).split())


@lru_cache(maxsize=2)
def fitted(pages: int = TRAINING_PAGES, seed: int = 11) -> Boosted:
    """The model; the same for the same arguments."""
    rows, labels = [], []
    for page in labelled_pages(pages, seed):
        nodes = nodes_of(parse(page))
        rows.append(features(nodes)[1:])
        labels += [x.main for x in nodes[1:]]
    return fit(np.concatenate(rows), np.array(labels, dtype=np.float64))


def main_texts(pages: list[str], model: Boosted) -> list[str]:
    trees = [nodes_of(parse(p)) if p else None for p in pages]
    some = [t for t in trees if t]
    if not some:
        return ["" for _ in pages]
    odds = model.scores(np.concatenate([features(t) for t in some]))
    texts, at = [], 0
    for tree in trees:
        if tree is None:
            texts.append("")
            continue
        texts.append(text_of(tree[0], decode(tree, odds[at : at + len(tree)])))
        at += len(tree)
    return texts


def extract_text(df: DataFrame, html_col: str = "html", pages: int = TRAINING_PAGES) -> DataFrame:
    """``df`` without its HTML, with ``text`` and ``n_chars`` of each page's main text."""
    shared = df.sparkSession.sparkContext.broadcast(fitted(pages))
    kept = [f for f in df.schema.fields if f.name not in (html_col, "text", "n_chars")]
    out = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, pc.binary_length(batch.column(html_col)), CHUNK):
                texts = main_texts(part.column(html_col).to_pylist(), shared.value)
                columns = [part.column(f.name) for f in kept]
                columns += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, out.names)

    return df.mapInArrow(run, out)
