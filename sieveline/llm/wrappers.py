"""Main text of HTML pages through wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of tag and text tokens; read as a tree, a wrapper says for each element which children come in which
order, which of them are optional, which repeat, and where text slots are and whether their text varies. The wrapper of
one page folds equal neighbours into a repeated group. Aligning a wrapper with the next (longest common subsequence of
children, level by level) resolves mismatches: a child that one side lacks becomes optional, a repeated one stays
repeated, differing texts become a slot. Aligning is a merge, so each task merges the pages it reads and only one wrapper a
task and host is moved; these are merged in two rounds, so that a host with very many pages is no hot group.

The wrapper then tells what of a page is its article. Text that a host's distinct pages share, in a place that most of them
have, is fixed and left out wherever it stands; the article is where the text that varies lies (a host may have several such
places, one for each of its templates; a page is read at the one where it holds most). Of what varies, menus, headers,
footers, side bars, notices, adverts, forms and comments go by element, role, class or id, which is all that tells them from
an article; but a class or id is not believed where that would leave less than a tenth of a host's varying text. Pages that
have none of the host's places are read by the wrapper of their own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import stored

# Elements by what they do to text, and the words that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style noscript template iframe object svg canvas math head title nav header footer aside form button select textarea fieldset dialog menu audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification"
    " alert popup modal overlay newsletter subscribe subscription signup sidebar sidebars side rail menu menus nav navbar navigation breadcrumb breadcrumbs footer footnav header masthead topbar"
    " comment comments commentlist reply replies respond disqus share sharing social related recommended recommendations widget widgets toolbar pagination pager login search skip hidden".split()
)
#: Words that turn a name into one of a layout that has, or hasn't, what a word above names.
LAYOUT = frozenset("has have no not with without is open opened closed collapsed expanded active enabled disabled".split())
CONTENT = frozenset("article main".split())
TEXTS = frozenset("p ul ol dl table pre blockquote h1 h2 h3 h4 h5 h6".split())
#: Elements that an opening tag of the same group closes, as no text between may belong to both.
CLOSED_BY = {"p": "p", "li": "li", "dt": "dd", "dd": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option"}
BLOCK_OPENERS = frozenset("p div article section main ul ol dl table h1 h2 h3 h4 h5 h6 pre blockquote figure header footer nav aside form address hr".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*)>|</?([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: A host's wrapper leaves out elements that fewer than one in RARE of its pages have, if it has twice as many pages. Until
#: all its pages are merged, an element is forgotten only when its pages and those it may have been forgotten for (`missed`)
#: are no more than one in RARE of the pages so far (lossy counting): what is first met late is judged like the rest.
RARE = 500
#: Distinct pages that tell a text that is fixed from one that few pages happen to share.
FIXED = 5
#: Elements inside each other that a wrapper tells apart; what is deeper is read in order, as if it stood side by side.
DEEPEST = 120
#: Hosts whose readers a task holds before it starts afresh (speed only).
READERS = 10_000


class Node:
    """An element of a page (texts among its children) or of a wrapper (pages seen, pages that may have been forgotten,
    characters, text if it is the same on all). `skip`: 2 if it is left out, 1 if its class or id says so."""

    __slots__ = ("key", "skip", "children", "pages", "missed", "chars", "text", "repeated")

    def __init__(self, key: str, skip: int = 0):
        self.key, self.skip, self.children = key, skip, []
        self.pages, self.missed, self.chars, self.text, self.repeated = 1, 0, 0, None, False


def _name(key: str) -> str:
    return re.split("[.#=]", key, maxsplit=1)[0]


def marked(value: str) -> bool:
    """Whether a class or id (lower case) names something that is no article: by a name's first or last word."""
    for name in value.split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if parts and (parts[0] in MARKED or parts[-1] in MARKED) and LAYOUT.isdisjoint(parts):
            return True
    return False


def _opened(name: str, attributes: str) -> tuple[str, int]:
    """The key of an element and whether it is left out."""
    skip = 2 * (name in DROPPED)
    marks = []
    if attributes.strip():
        for m in _ATTRIBUTE.finditer(attributes):
            kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if kind == "hidden":
                skip = 2
            elif kind == "role":
                skip = max(skip, 2 * (value in ROLES))
                marks += ["=main"] if value == "main" else []
            else:
                if name not in ("html", "body", "article", "main") and marked(value):
                    skip = max(skip, 1)
                marks.append(("." if kind == "class" else "#") + re.sub(r"\d+", "0", " ".join(value.split())))
    return name + "".join(marks), skip


def parse(html: str | None) -> Node:
    """The tree of a page; children are Nodes, texts (str, undecoded) and " " for line breaks. Inline elements are no nodes,
    unless they are left out: these have keys that begin with ~."""
    root = Node("")
    stack, names, at = [root], [""], 0  # open elements and their names
    html = html or ""

    def close(i: int) -> None:
        del stack[i:], names[i:]
        if len(stack) > DEEPEST:  # what follows stands beside what was closed
            stack[-1] = Node(stack[-1].key, stack[-1].skip)
            stack[DEEPEST - 1].children.append(stack[-1])

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        name, attributes = (m[2] or m[4] or "").lower(), m[3] or m[5] or ""
        if not name:
            continue
        inside = names[-1] == "~" + name  # of an inline element that is left out
        if html[m.start() + 1] == "/":
            if name in INLINE:
                if inside:
                    close(len(stack) - 1)
                continue
            for i in range(len(stack) - 1, 0, -1):
                if names[i] == name:
                    close(i)
                    break
            continue
        if name in INLINE:
            skip = _opened(name, attributes)[1] if attributes.strip() else 0
            if (skip or inside) and not attributes.rstrip().endswith("/"):
                node = Node("~" + name, 2)
                stack[min(len(stack), DEEPEST) - 1].children.append(node)
                stack.append(node)
                names.append("~" + name)
            continue  # else it doesn't end a block
        if name in VOID:
            stack[-1].children.append(" ")
            continue
        closes = CLOSED_BY.get(name) or ("p" if name in BLOCK_OPENERS else "")
        if closes and len(stack) > 1 and CLOSED_BY.get(names[-1]) == closes:
            close(len(stack) - 1)
        node = Node(*_opened(name, attributes))
        if stack[-1].skip == 2:
            node.skip = 2  # also where it is deeper than it is told apart
        stack[min(len(stack), DEEPEST) - 1].children.append(node)
        if not attributes.rstrip().endswith("/"):
            stack.append(node)
            names.append(name)
    if at < len(html):
        stack[-1].children.append(html[at:])
    return root


def _clean(text: str) -> str:
    return " ".join(unescape(text).split())


def wrapper(page: Node) -> Node:
    """The wrapper of one page: texts become slots, equal neighbours one repeated group."""
    out = Node(page.key, page.skip)
    if page.skip == 2:  # what is left out needs no inside
        return out
    run = ""
    for child in [*page.children, None]:
        if isinstance(child, str):
            run += child
            continue
        if child is not None and child.key[:1] == "~":
            continue
        if text := _clean(run):
            slot = Node("$")
            slot.chars, slot.text = len(text), _crc(text)
            _append(out, slot)
        run = ""
        if child is not None:
            _append(out, wrapper(child))
    out.chars = sum(c.chars for c in out.children)
    return out


def _append(out: Node, child: Node) -> None:
    if out.children and out.children[-1].key == child.key:
        last = out.children[-1]
        pages = last.pages
        last = merge(last, child)
        last.pages, last.repeated = pages, True
        out.children[-1] = last
    else:
        out.children.append(child)


def merge(a: Node, b: Node) -> Node:
    """Aligns two wrappers of equal key."""
    out = Node(a.key, a.skip)
    out.pages, out.chars, out.repeated = a.pages + b.pages, a.chars + b.chars, a.repeated or b.repeated
    out.missed = a.missed + b.missed
    out.text = a.text if a.text == b.text else None
    x, y = a.children, b.children
    if [c.key for c in x] == [c.key for c in y]:
        out.children = [merge(p, q) for p, q in zip(x, y)]
    else:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i].key == y[j].key else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(x) or j < len(y):
            if i < len(x) and j < len(y) and x[i].key == y[j].key:
                out.children.append(merge(x[i], y[j]))
                i, j = i + 1, j + 1
            elif j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]):
                x[i].missed += b.pages // RARE  # the other side may have forgotten it
                out.children.append(x[i])  # one side lacks it: optional, as it has fewer pages than its parent
                i += 1
            else:
                y[j].missed += a.pages // RARE
                out.children.append(y[j])
                j += 1
    if out.pages // RARE > max(a.pages, b.pages) // RARE:
        out.children = [c for c in out.children if c.pages + c.missed > out.pages // RARE]
    return out


def common(node: Node) -> Node:
    """The wrapper of all pages of a host without its rare elements."""
    if node.pages >= 2 * RARE:
        node.children = [c for c in node.children if (c.pages + c.missed) * RARE >= node.pages]
    for c in node.children:
        common(c)
    return node


def expression(node: Node, pages: int | None = None) -> str:
    """The wrapper as a union-free regular expression over tags and slots, for people to read."""
    inside = "".join(expression(c, node.pages) for c in node.children)
    own = ("#TEXT" if node.text is None else "#FIXED") if node.key == "$" else f"<{node.key}>{inside}</{_name(node.key)}>" if node.key else inside
    return f"({own})+" if node.repeated else f"({own})?" if pages and node.pages < pages else own


def _pack(n: Node) -> list:
    return [n.key, n.skip, n.pages, n.missed, n.chars, n.text, n.repeated, [_pack(c) for c in n.children]]


def _unpack(x: list) -> Node:
    n = Node(x[0], x[1])
    n.pages, n.missed, n.chars, n.text, n.repeated = x[2:7]
    n.children = [_unpack(c) for c in x[7]]
    return n


def _mass(node: Node, kept: frozenset = frozenset(), skipped: int = 1) -> int:
    """Characters of text that varies, of what isn't left out."""
    if node.skip >= skipped and (node.skip == 2 or node.key not in kept):
        return 0
    if node.key == "$":
        return node.chars if node.text is None or node.pages == 1 else 0
    return sum(_mass(c, kept, skipped) for c in node.children)


def believed(node: Node) -> frozenset:
    """Keys of elements that stay although their class or id is marked: without them little of what varies would be left."""
    total = _mass(node, skipped=2)
    found: list[tuple[int, str]] = []

    def walk(n: Node) -> None:
        for c in n.children:
            if c.skip == 1:
                found.append((_mass_inside(c), c.key))
            if c.skip < 2:
                walk(c)

    walk(node)
    kept: set[str] = set()
    for _, key in sorted(found, reverse=True):
        if _mass(node, frozenset(kept)) * 10 >= total:
            break
        kept.add(key)
    return frozenset(kept)


def _mass_inside(node: Node) -> int:
    return sum(_mass(c, skipped=2) for c in node.children)


def article_paths(node: Node, kept: frozenset = frozenset()) -> list[list[str]]:
    """Keys of the elements that lead to where articles are, the place with most varying text first: the content elements,
    or else the elements that hold most of it on the pages that have them."""
    found: list[tuple[int, int, list[str]]] = []
    out = lambda c: c.skip == 2 or (c.skip == 1 and c.key not in kept)

    def walk(n: Node, path: list[str]) -> None:
        for c in n.children:
            if not out(c) and c.key != "$":
                if _name(c.key) in CONTENT or "=main" in c.key:
                    found.append((_mass(c, kept) or c.chars, len(path), [*path, c.key]))
                walk(c, [*path, c.key])

    def descend(n: Node, path: list[str]) -> None:
        inner = [c for c in n.children if c.key != "$" and not out(c) and not c.repeated and _name(c.key) not in TEXTS]
        total = _mass(n, kept)
        # An element that most of a page's varying text leads to, on the pages that have it.
        tops = [c for c in inner if (own := _mass(c, kept)) and own * n.pages * 10 >= total * c.pages * 6]
        if not tops or sum(c.pages for c in tops) < n.pages:
            found.append((total - sum(_mass(c, kept) for c in tops), len(path), path))
        for c in tops:
            descend(c, [*path, c.key])

    walk(node, [])
    if found:
        # Of nested ones, the inner one where it has half of the outer one's text.
        whole = {tuple(f[2]): f[0] for f in found}
        inner = {t for t in whole for u in whole if len(u) > len(t) and u[: len(t)] == t and whole[u] * 2 >= whole[t]}
        found = [f for f in found if tuple(f[2]) not in inner]
    else:
        descend(node, [])
    most = max(f[0] for f in found)
    return [f[2] for f in sorted(found, key=lambda f: (-f[0], -f[1], f[2])) if f[0] * 20 >= most]


def article_path(node: Node) -> list[str]:
    return article_paths(node, believed(node))[0]


def fixed_texts(node: Node) -> set[tuple[str, int]]:
    """(place, crc of the text) of the slots that hold the same text on all pages that have them, which are most of those
    that have the element around, and FIXED at least. Nothing is fixed where nothing varies."""
    out: set[tuple[str, int]] = set()

    def walk(n: Node, path: str) -> None:
        for c in n.children:
            if c.key == "$":
                if c.text is not None and not c.repeated and c.pages >= FIXED and 2 * c.pages > n.pages:
                    out.add((path, c.text))
            elif not c.repeated and c.skip < 2:
                walk(c, f"{path}/{c.key}")

    if _mass(node, skipped=2):
        walk(node, "")
    return out


def _crc(text: str) -> int:
    return crc32(text.encode("utf-8", "surrogatepass"))


class Reader:
    """What a host's wrapper says of its pages: places of articles, keys that stay, fixed texts."""

    def __init__(self, paths: list[list[str]], kept: frozenset, fixed: set[tuple[str, int]]):
        self.paths, self.kept, self.fixed = paths, kept, fixed

    @staticmethod
    def of(node: Node) -> Reader:
        kept = believed(node)
        return Reader(article_paths(node, kept), kept, fixed_texts(node))

    def dump(self) -> str:
        return json.dumps([self.paths, sorted(self.kept), sorted(self.fixed)])

    @staticmethod
    def load(text: str) -> Reader:
        paths, kept, fixed = json.loads(text)
        return Reader(paths, frozenset(kept), {(p, c) for p, c in fixed})

    def _out(self, node: Node) -> bool:
        return node.skip == 2 or (node.skip == 1 and node.key not in self.kept)

    def _blocks(self, node: Node, path: str, out: list[str]) -> None:
        run = ""
        for child in [*node.children, None]:
            if isinstance(child, str):
                run += child
                continue
            if child is not None and child.key[:1] == "~":
                continue
            if (text := _clean(run)) and not (self.fixed and (path, _crc(text)) in self.fixed):
                out.append(text)
            run = ""
            if child is not None and not self._out(child):
                self._blocks(child, f"{path}/{child.key}", out)

    def _at(self, node: Node, path: list[str]) -> list[Node]:
        nodes = [node]
        for key in path:
            nodes = [c for n in nodes for c in n.children if isinstance(c, Node) and c.key == key and not self._out(c)]
        return nodes

    def blocks(self, page: Node) -> list[str] | None:
        """The article's blocks in page order, of the innermost place that holds most of what any place of the page does;
        None if it has no such place."""
        found: list[tuple[int, list[str]]] = []
        for path in self.paths:
            if nodes := self._at(page, path):
                out: list[str] = []
                for node in nodes:
                    self._blocks(node, "".join(f"/{k}" for k in path), out)
                found.append((len(path), out))
        if not found:
            return None
        size = lambda out: sum(map(len, out))
        most = max(size(out) for _, out in found)
        return max((f for f in found if size(f[1]) * 10 >= most * 6), key=lambda f: (f[0], size(f[1])))[1]


def main_text(page: Node, reader: Reader | None) -> str:
    """The article's blocks, as the host's wrapper tells them, or else the page's own."""
    found = reader.blocks(page) if reader else None
    if found is None:
        found = Reader.of(wrapper(page)).blocks(page) or []
    return "\n\n".join(found)


def host(url: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


def infer(pages: DataFrame, *, url: str = "url", html: str = "html", salts: int = 64) -> DataFrame:
    """(host, wrapper, expression, reader): one row for each host. Equal pages that a task reads count once."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Node] = {}
        seen: set[int] = set()
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and (same := hash((h, text))) not in seen:
                    seen.add(same)
                    w = wrapper(parse(text))
                    held[h] = merge(held[h], w) if h in held else w
        salt = TaskContext.get().partitionId() % salts
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([salt] * len(held), pa.int32()), pa.array([json.dumps(_pack(w)) for w in held.values()], pa.string())], names=["host", "salt", "wrapper"])

    def one(group: pa.Table) -> pa.Table:
        merged = None
        for x in sorted(group["wrapper"].to_pylist()):  # whatever order they come in
            w = _unpack(json.loads(x))
            merged = merge(merged, w) if merged else w
        return group.slice(0, 1).select(["host", "salt"]).append_column("wrapper", pa.array([json.dumps(_pack(merged))]))

    def last(group: pa.Table) -> pa.Table:
        w = common(_unpack(json.loads(one(group)["wrapper"][0].as_py())))
        return pa.table({"host": group["host"].slice(0, 1), "wrapper": [json.dumps(_pack(w))], "expression": [expression(w)], "reader": [Reader.of(w).dump()]})

    rows = pages.select(host(url).alias("host"), F.col(html).alias("html")).mapInArrow(own, "host string, salt int, wrapper string")
    rows = rows.groupBy("host", "salt").applyInArrow(one, "host string, salt int, wrapper string")
    return rows.groupBy("host").applyInArrow(last, "host string, wrapper string, expression string, reader string")


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of pages.

    A null or empty html has an empty text; a null url, or one without a host, belongs to the host "". Repeated rows are
    rows of the result each. A page whose host's wrapper doesn't fit is read by its own. Pages may be nested and long
    without bound (see DEEPEST). An empty table gives no rows. Other columns of pages are not read.
    """
    readers = stored(infer(pages, url=url, html=html), "wrappers").select("host", "reader")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Reader | None] = {None: None}
        for batch in batches:
            texts = []
            for text, reader in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if reader not in known:
                    if len(known) > READERS:
                        known = {None: None}
                    known[reader] = Reader.load(reader)
                texts.append(main_text(parse(text), known[reader]) if text else "")
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host(url).alias("host"))
    rows = rows.join(readers, "host", "left").select("page_id", "url", "html", "reader")
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
