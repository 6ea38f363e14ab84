"""Main text of web pages by wrapper induction.

Two pages of every host, picked by a hash, serve as references. A page's DOM
tree is aligned with a reference that differs from it (with both, where the host
has too few pages to count) by simple tree matching. Text
in aligned nodes that is the same on both sides is constant, and template if at
least COMMON of the host's distinct pages have it at the same path (counted over
all pages); varying and unmatched slots are content. So copies of one article
do not become template. The content root is the element marked as the article,
and otherwise the smallest element that holds most of the varying text. Template
goes in either, unless an article would lose more than half of its text. Menus,
adverts, forms and the like go by element and class name everywhere.

Null or empty html gives empty text. A page alone on its host, or equal to its
references, has no template to learn; then only element names decide. Repeated
rows give a row each and count once; a page without a host (null url) is aligned
with others without one. Other columns are ignored; an empty table gives no rows.
Depth and length of a page are bounded by memory only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut

# Element names of HTML and class words for parts that are not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp svg object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html legend li dd dt td th tr tbody thead tfoot".split())
SIBLINGS = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": ("option", ("select",)),
}
DROPPED = frozenset("head nav footer aside button select dialog menu input script style noscript template iframe textarea title svg object canvas audio video".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices notification "
    "popup modal overlay sidebar side menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus reply replies "
    "share sharing social related recommended newsletter subscribe signup widget pagination pager toolbar skip".split()
)

#: Parts of class names that say nothing by themselves: "site-header" is a header, "side-effects" is no side.
NEUTRAL_WORDS = frozenset("area bar block bottom box container global inner item items left links list outer page right section site top wrap wrapper".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_NAMED = re.compile(r"(?:class|id|role)\s*=", re.I)
#: Elements that may hold a part of the page as a whole; class names of others (headings, paragraphs, tables) drop nothing.
CONTAINERS = frozenset("div section aside ul ol dl header hgroup span li figure fieldset details".split())
#: What makes an article or an item a reader's comment.
COMMENT_WORDS = frozenset("comment comments disqus reply replies".split())
#: Template is what this share of a host's distinct pages have, if they are at least so many.
COMMON, LEAST_PAGES = 0.9, 3
#: Rows of a step of the alignment that are kept for the way back.
STEP = 64


class Node:
    """An element: name, class names, role, children (nodes and strings)."""

    __slots__ = ("tag", "classes", "id", "role", "kids", "constant", "shape", "wraps", "own")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.classes, self.id, self.role, self.kids, self.constant, self.shape, self.wraps, self.own = tag, (), "", "", [], None, 0, False, None
        if attrs and _NAMED.search(attrs):
            for name, *values in _ATTRIBUTE.findall(attrs):
                name = name.lower()
                if name not in ("class", "id", "role"):
                    continue
                value = next((v for v in values if v), "").lower()
                if name == "role":
                    self.role = value.strip()
                elif name == "id":
                    self.id = value.strip()
                else:
                    self.classes = tuple(value.split())

    def dropped(self, in_article: bool) -> bool:
        if self.tag in DROPPED or self.role in DROPPED_ROLES or (self.tag == "header" and not in_article) or (self.tag == "form" and not self.wraps):
            return True
        if self.tag == "article":
            return any(COMMENT_WORDS & set(re.split(r"[-_]+", c)) and _says_dropped(c) for c in self.classes)
        if self.tag not in CONTAINERS:
            return False
        return any(map(_says_dropped, self.classes)) or (self.tag == "div" and bool(self.id) and _says_dropped(self.id))


def _says_dropped(name: str) -> bool:
    """Whether a class name as a whole stands for a part that is no article."""
    parts = [p for p in re.split(r"[-_]+|\d+", name) if p]
    return any(p in DROPPED_WORDS for p in parts) and all(p in DROPPED_WORDS or p in NEUTRAL_WORDS for p in parts)


def parse(html: str) -> Node:
    """A forgiving tree: implied ends of p, li, dd, dt, tr, td; unknown end tags are ignored."""
    root = Node("#root")
    stack, at, n = [root], 0, len(html)
    last = html.rfind(">") + 1  # what begins behind it is no tag
    opened: dict[str, int] = {}
    forms: list[Node] = []
    while at < n:
        m = _TAG.search(html, at) if at < last else None
        stop = m.start() if m else n
        if stop > at:
            stack[-1].kids.append(html[at:stop])
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attrs = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if closing:
            if opened.get(name):
                k = len(stack) - 1
                while stack[k].tag != name:
                    k -= 1
                _end(stack, k, opened)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at, max(at, last))
            stack[-1].kids.append(Node(name, attrs))
            at = end.end() if end else n
            continue
        if name in CLOSES_P:
            _close(stack, ("p",), ("td", "th", "table", "div", "article", "section", "body", "li"), opened)
        if name in SIBLINGS:
            ends, within = SIBLINGS[name]
            _close(stack, (ends,) if isinstance(ends, str) else ends, within, opened)
        node = Node(name, attrs)
        stack[-1].kids.append(node)
        if name == "form":
            forms.append(node)
        if name not in VOID and not attrs.endswith("/"):
            stack.append(node)
            opened[name] = opened.get(name, 0) + 1
    if forms:  # a form around most of a page is no form of the page
        whole = _characters(root)
        for form in forms:
            form.wraps = 2 * _characters(form) > whole
    return root


def _characters(node: Node) -> int:
    """Characters of text below a node, outside parts that are dropped by element."""
    total, todo = 0, [node]
    while todo:
        for k in todo.pop().kids:
            if isinstance(k, str):
                total += len(k.strip())
            elif k.tag not in DROPPED:
                todo.append(k)
    return total


def _end(stack: list[Node], k: int, opened: dict[str, int]) -> None:
    """End the open element ``k`` and all within it."""
    for node in stack[k:]:
        opened[node.tag] -= 1
    del stack[k:]


def _close(stack: list[Node], ends: tuple, within: tuple, opened: dict[str, int]) -> None:
    if not any(opened.get(name) for name in ends):
        return
    low = None
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in within:
            break
        if stack[k].tag in ends:
            low = k
            if len(ends) == 1:
                break
    if low is not None:
        _end(stack, low, opened)


def _own_text(node: Node) -> str:
    if node.own is None:
        node.own = " ".join(" ".join([k for k in node.kids if isinstance(k, str)]).split())
    return node.own


class Matcher:
    """Simple tree matching: the largest match of two trees that keeps order and ancestry.

    Nodes match if element and classes agree. The size of a match depends on
    the shapes of two subtrees alone (elements and classes, without text), so
    it is worked out once for each pair of shapes, on a stack and not by
    recursion. Equal shapes at either end of two child lists belong together in
    some largest match; the rest is aligned by dynamic programming, row by row.
    """

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.kids: list[tuple[int, ...]] = []
        self.kind: list[tuple] = []
        self.size: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def shapes(self, root: Node) -> None:
        """Set ``shape`` on all nodes below ``root``."""
        order, todo = [], [root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo.extend(k for k in node.kids if isinstance(k, Node))
        for node in reversed(order):
            kids = tuple(k.shape for k in node.kids if isinstance(k, Node))
            key = (node.tag, node.classes, kids)
            if key not in self.number:
                self.number[key] = len(self.kids)
                self.kids.append(kids)
                self.kind.append((node.tag, node.classes))
                self.size.append(1 + sum(self.size[k] for k in kids))
            node.shape = self.number[key]

    def score(self, a: int, b: int) -> int:
        """Size of the largest match of two shapes."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self._quick(x, y) is not None:
                todo.pop()
                continue
            lo, p, q = _trimmed(self.kids[x], self.kids[y])
            needed = [pair for pair in {(i, j) for i in set(p) for j in set(q)} if self._quick(*pair) is None]
            if needed:
                todo.extend(needed)
                continue
            ends = sum(self.size[k] for k in self.kids[x][:lo]) + sum(self.size[k] for k in self.kids[x][lo + len(p) :])
            self.known[x, y] = 1 + ends + (int(_last_row(self._weights(p, q))[-1]) if p and q else 0)
            todo.pop()
        return self._quick(a, b)

    def _quick(self, x: int, y: int) -> int | None:
        if x == y:
            return self.size[x]
        if self.kind[x] != self.kind[y]:
            return 0
        if not self.kids[x] or not self.kids[y]:
            return 1
        return self.known.get((x, y))

    def _weights(self, p, q):
        """Rows of match sizes of the shapes p with the shapes q, made one by one."""
        columns, place = np.unique(np.array(q), return_inverse=True)
        rows: dict[int, np.ndarray] = {}
        for i in p:
            if i not in rows:
                rows[i] = np.array([self.score(i, j) for j in columns.tolist()], np.int64)[place]
            yield rows[i]

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """Aligned nodes of a largest match."""
        found, todo = [], [(a, b)]
        while todo:
            a, b = todo.pop()
            if a.shape == b.shape:  # node by node
                found.append((a, b))
                if self.kids[a.shape]:
                    todo.extend(zip([k for k in a.kids if type(k) is Node], [k for k in b.kids if type(k) is Node]))
                continue
            if self.kind[a.shape] != self.kind[b.shape]:
                continue
            found.append((a, b))
            x, y = ([k for k in n.kids if isinstance(k, Node)] for n in (a, b))
            lo, p, q = _trimmed([k.shape for k in x], [k.shape for k in y])
            todo.extend(zip(x[:lo], y[:lo]))
            hi = len(x) - lo - len(p)
            todo.extend(zip(x[len(x) - hi :], y[len(y) - hi :]))
            if p and q:
                todo.extend((x[lo + i], y[lo + j]) for i, j in self._align(p, q))
        return found

    def _align(self, p: list[int], q: list[int]) -> list[tuple[int, int]]:
        """Places aligned by the dynamic programme; halves are solved apart, so memory is that of a row."""
        found, todo = [], [(0, len(p), 0, len(q))]
        while todo:
            i0, i1, j0, j1 = todo.pop()
            if i0 == i1 or j0 == j1:
                continue
            x, y = p[i0:i1], q[j0:j1]
            if i1 - i0 > STEP:
                half = (i1 - i0) // 2
                up = _last_row(self._weights(x[:half], y))
                down = _last_row(w[::-1] for w in self._weights(x[half:][::-1], y))[::-1]
                cut_at = int((up + down).argmax())
                todo += [(i0, i0 + half, j0, j0 + cut_at), (i0 + half, i1, j0 + cut_at, j1)]
                continue
            weights = list(self._weights(x, y))
            rows = [np.zeros(len(y) + 1, np.int64)]
            for w in weights:
                rows.append(_next_row(rows[-1], w))
            i, j = len(x), len(y)
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    found.append((i0 + i, j0 + j))
        return found


def _trimmed(x, y) -> tuple[int, list, list]:
    """(length of the equal start, what is left of x, of y) without equal ends."""
    lo, most = 0, min(len(x), len(y))
    while lo < most and x[lo] == y[lo]:
        lo += 1
    hi = 0
    while hi < most - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    return lo, list(x[lo : len(x) - hi]), list(y[lo : len(y) - hi])


def _next_row(row: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = row.copy()
    np.maximum(row[1:], row[:-1] + weights, out=out[1:])
    return np.maximum.accumulate(out)


def _last_row(rows) -> np.ndarray:
    last = None
    for w in rows:
        last = _next_row(np.zeros(len(w) + 1, np.int64) if last is None else last, w)
    return last


def simple_tree_match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """(size of the largest match, pairs of aligned nodes)."""
    matcher = Matcher()
    matcher.shapes(a)
    matcher.shapes(b)
    return matcher.score(a.shape, b.shape), matcher.pairs(a, b)


class Reference:
    """A parsed reference page with the shapes met so far."""

    def __init__(self, html: str):
        self.root, self.matcher = parse(html), None

    def aligned(self, page: Node) -> list[tuple[Node, Node]]:
        if self.matcher is None or len(self.matcher.kids) > 100_000:
            self.matcher = Matcher()
            self.matcher.shapes(self.root)
        self.matcher.shapes(page)
        return self.matcher.pairs(page, self.root)


_paths: dict[tuple[bytes, str], bytes] = {}


def slots(page: Node) -> Iterator[tuple[Node, bytes]]:
    """Nodes with text of their own, each with a hash of its path."""
    todo = [(page, b"")]
    while todo:
        node, path = todo.pop()
        key = path, node.tag
        path = _paths.get(key)
        if path is None:  # a path is hashed level by level, so that deep pages cost no more than their nodes
            if len(_paths) > 100_000:
                _paths.clear()
            path = _paths[key] = hashlib.blake2b(key[0] + node.tag.encode(), digest_size=8).digest()
        if _own_text(node):
            yield node, path
        todo.extend([(k, path) for k in node.kids if isinstance(k, Node)])


def slot_key(node: Node, path: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(path + _own_text(node).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def mark_template(page: Node, references: list[Reference], common: frozenset | None) -> bool:
    """Set ``constant`` on nodes with text of their own; False where nothing can be told.

    ``common``: hashes of slots that most pages of the host have, None where it has too few pages.
    """
    votes: dict[int, list[bool]] = {}
    differs = False
    for ref in references:
        same = [(p, _own_text(p) == _own_text(q)) for p, q in ref.aligned(page) if _own_text(p)]
        if all(s for _, s in same):
            continue
        differs = True
        for p, s in same:
            votes.setdefault(id(p), []).append(s)
        if common is not None:  # all pages of the host have a say below
            break
    if not differs and common is None:
        return False
    for node, path in slots(page):
        constant = all(votes.get(id(node), [False])) if differs else True
        node.constant = constant and (common is None or slot_key(node, path) in common)
    return True


def _varying(node: Node, memo: dict[int, int]) -> int:
    """Characters of varying text below each node, outside dropped parts."""
    order, todo = [], [node]
    while todo:
        k = todo.pop()
        order.append(k)
        todo.extend(c for c in k.kids if isinstance(c, Node) and not c.dropped(False))
    for k in reversed(order):
        memo[id(k)] = (0 if k.constant else len(_own_text(k))) + sum(memo.get(id(c), 0) for c in k.kids if isinstance(c, Node))
    return memo[id(node)]


def content_roots(page: Node) -> tuple[list[Node], bool]:
    """(roots, whether they are marked as article)."""
    for wanted in ("article", "main"):
        found, todo = [], [page]
        while todo:
            node = todo.pop()
            if node is not page and (node.tag == wanted or (wanted == "main" and node.role == "main")):
                found.append(node)
                continue
            todo.extend(k for k in reversed(node.kids) if isinstance(k, Node) and not k.dropped(False))
        if found:
            return found, True
    memo: dict[int, int] = {}
    total, node = _varying(page, memo), page
    while True:
        best = max((k for k in node.kids if isinstance(k, Node) and id(k) in memo), key=lambda k: memo[id(k)], default=None)
        if best is None or best.tag in ("p", "span", "b", "i", "a") or not total or memo[id(best)] < 0.6 * total:
            return [node], False
        node = best


def block_texts(root: Node, drop_constant: bool, in_article: bool) -> list[str]:
    """Texts of blocks below ``root`` in page order."""
    blocks: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            blocks.append(text)
        parts.clear()

    todo: list = [root]
    while todo:
        k = todo.pop()
        if k is None:
            flush()
        elif isinstance(k, str):
            parts.append(k)
        elif k is root or not k.dropped(in_article):
            if k.tag == "br":
                parts.append(" ")
                continue
            block = k.tag in BLOCK or k.tag == "#root"
            if block:
                flush()
                todo.append(None)
            kids = k.kids if not (drop_constant and k.constant) else [c for c in k.kids if isinstance(c, Node)]
            todo.extend(reversed(kids))
    flush()
    return blocks


def main_text(html: str | None, references: list[Reference], common: frozenset | None = None) -> str:
    page = parse(html or "")
    learned = mark_template(page, references, common)
    roots, marked = content_roots(page)
    whole = [b for r in roots for b in block_texts(r, False, marked)]
    if not learned or (marked and common is None):
        return "\n\n".join(whole)
    kept = [b for r in roots for b in block_texts(r, True, marked)]
    # An article that is mostly "template" is a copy; so is a page of nothing else.
    enough = 2 * sum(map(len, kept)) >= sum(map(len, whole)) if marked else bool(kept)
    return "\n\n".join(kept if enough else whole)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


EXTRACTED = "page_id long, url string, text string, n_chars long"


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` (page_id, url, html, _host) with html compressed: body, and size in bytes; both null where html is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            ids, urls, htmls, hosts = batch.columns
            raw = htmls.cast(pa.binary()).to_pylist()
            body = pa.array([None if b is None else codec.compress(b, asbytes=True) for b in raw], pa.binary())
            size = pa.array([None if b is None else len(b) for b in raw], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, urls, hosts, body, size], names=["page_id", "url", "_host", "body", "size"])

    return rows.select("page_id", "url", "html", "_host").mapInArrow(run, "page_id long, url string, _host string, body binary, size long")


def references(pages: DataFrame) -> DataFrame:
    """host, first, second: html of two pages of each host, picked by hash."""
    keyed = pages.select("_host", F.xxhash64("page_id", "url").alias("_h"), "html").where(F.length("html") > 0)
    picked = (
        keyed.groupBy("_host")
        .agg(F.min("_h").alias("lo"), F.max("_h").alias("hi"))
        .select("_host", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("lo").alias("_h")), F.struct(F.lit(1).alias("k"), F.col("hi").alias("_h")))).alias("p"))
        .select("_host", "p.k", "p._h")
    )
    # Written out, so that its size is known: where it is small, the pages need no shuffle here.
    picked = cut(picked, "hosts")
    return (
        keyed.join(picked, ["_host", "_h"])
        .groupBy("_host")
        .agg(F.min(F.when(F.col("k") == 0, F.col("html"))).alias("first"), F.min(F.when(F.col("k") == 1, F.col("html"))).alias("second"))
    )


def common_slots(pages: DataFrame) -> DataFrame:
    """host, n_pages (distinct pages), common (hashes of slots that nearly all of them have; no more than a page has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, hashes, htmls = (c.to_pylist() for c in batch.columns)
            found = [sorted({slot_key(*slot) for slot in slots(parse(html))}) for html in htmls]
            sizes = [len(f) for f in found]
            at = np.repeat(np.arange(len(found)), sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()).take(pa.array(at)), pa.array(hashes, pa.int64()).take(pa.array(at)), pa.array([k for f in found for k in f], pa.int64())], names=["_host", "_page", "slot"]
            )

    keyed = pages.where(F.length("html") > 0).select("_host", F.xxhash64("html").alias("_page"), "html")
    seen = keyed.mapInArrow(run, "_host string, _page long, slot long").groupBy("_host", "slot", "_page").agg(F.lit(1).alias("one"))
    counts = seen.groupBy("_host", "slot").agg(F.count("one").alias("n"))
    totals = keyed.select("_host", "_page").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= LEAST_PAGES)
    kept = counts.where(F.col("n") >= LEAST_PAGES).join(totals, "_host").where(F.col("n") >= F.col("n_pages") * COMMON)
    return totals.join(kept.groupBy("_host").agg(F.collect_list("slot").alias("common")), "_host", "left").select("_host", "n_pages", F.coalesce("common", F.array().cast("array<bigint>")).alias("common"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, Reference] = {}
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            ids, urls, bodies, sizes, first, second, common = (c.to_pylist() for c in batch.columns)
            htmls = [None if b is None else codec.decompress(b, n, asbytes=True).decode("utf-8") if n else "" for b, n in zip(bodies, sizes)]
            texts = []
            for html, *refs, slots_ in zip(htmls, first, second, common):
                trees = []
                for ref in {r for r in refs if r and r != html}:
                    if ref not in parsed:
                        if len(parsed) >= 64:
                            parsed.clear()
                        parsed[ref] = Reference(ref)
                    trees.append(parsed[ref])
                texts.append(main_text(html, trees, None if slots_ is None else frozenset(slots_)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host_of(F.col("url")).alias("_host"))
    common = cut(common_slots(rows), "slots")
    refs = cut(references(rows).join(common, "_host", "left"), "references")
    # Pages travel compressed to the references of their host: every byte of theirs that is shuffled is on disk.
    return packed(rows).join(refs, "_host", "left").select("page_id", "url", "body", "size", "first", "second", "common").mapInArrow(run, EXTRACTED)
