"""Main text of web pages by wrapper induction.

Each page becomes a tree of its blocks, without the elements that HTML itself sets apart from an article: menus, site
headers, footers, asides, forms, scripts. The trees of a host are aligned with up to three of its own pages, those of
its most frequent shapes, by simple tree matching. A block whose text is the same at one aligned node on most of the
different pages that have this node is template; the others are slots, and what they hold is content.

Every page is aligned and counted. A reference travels to its host's pages by a salted join; what is shuffled of a page
is its tree and hashes, never a host's pages together.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from html import unescape
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import materialize, salted_join

# HTML's elements by kind, and the words that mark what is no article.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noframes noembed xmp svg math object".split())
FOREIGN = frozenset("svg math".split())
DROPPED = frozenset("nav footer aside form dialog menu head".split())
#: Inline elements that are no text of the block they stand in, and controls that are only if the block has text.
UNSEEN = frozenset("select option datalist audio video canvas".split())
CONTROLS = frozenset("button label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
MARKS = frozenset("nav navigation navbar menu menubar sidebar footer header banner masthead ad ads adv advert adverts advertisement advertising adsense promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments commentlist disqus respond reply replies share sharing social newsletter subscribe subscription signup login related recommended breadcrumb breadcrumbs pagination pager toolbar widget skip".split())
#: Words that may stand beside a mark in one class name or id without giving it another sense.
BESIDE = frozenset("site page main top bottom left right primary secondary global box block wrap wrapper container area bar list section inner outer link links buttons button icons items item form posts post text message thread slot unit zone user users reader readers".split())
#: Marks of what readers write; however long it is, it is no article.
READERS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Words that name a paragraph of an article's header as part of the article.
LEADS = frozenset("lead lede intro introduction standfirst summary abstract dek deck subtitle teaser".split())
#: With one of these a word header names the article's own.
OWN = frozenset("article entry post content story".split())
ROOTS = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What around a block says where it belongs, and elements that are text themselves, whatever their names.
TELLING = ("article", "main", "header", "lead", *sorted(HEADINGS))
TEXTS = frozenset("p") | HEADINGS
#: Blocks in which a control is part of a sentence.
PROSE = frozenset("p li dd dt td th blockquote figcaption caption h1 h2 h3 h4 h5 h6".split())
#: An element that ends an open one of the same family, and what shields the latter.
FAMILIES = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
SHIELDS = frozenset("article main body html td th".split())

#: A value begins after an equals sign; quotes elsewhere, or without an end, are ordinary characters.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)|[^>])*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)|<[A-Za-z][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|$))""", re.I)

#: A text is template if this share of a host's different pages that have its node have it there, and if they are at
#: least so many, and so large a part of the host's different pages.
SHARE, LEAST_PAGES, PART = 0.8, 3, 0.3
#: Pages that a host's pages are aligned with, and the nodes beyond which more don't make a page a better one.
REFERENCES, ENOUGH_NODES = 3, 60
#: Shapes of trees, and a thousand for each reference, that a task keeps from page to page.
KNOWN_SHAPES = 300_000
#: Cells of an alignment table that are kept at once; larger tables are made in blocks of rows, with the same result.
CELLS = 1_000_000


#: Where a name written in one word with capitals is cut; numbers and sizes say nothing.
HUMP, NUMBER = re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"\d+(?:x\d+)?")


def _words(value: str) -> list[list[str]]:
    """The words of each name in a class or id."""
    return [[w for w in re.split("[_-]+", HUMP.sub("-", n).lower()) if not NUMBER.fullmatch(w)] for n in value.strip("\"'").split()]


def _marked(attributes: str) -> int:
    """3: hidden, or a role that is no article's; 2: what readers write; 1: a class or id, as a whole, names something
    else; else 0."""
    found = 0
    for name, value in ATTRIBUTE.findall(attributes):
        name, names = name.lower(), value.strip("\"'").lower().split()
        if name == "hidden" and value.strip("\"'").lower() != "until-found" or name == "aria-hidden" and "true" in names or name == "role" and ROLES.intersection(names):
            return 3
        if name in ("class", "id"):
            for words in _words(value):
                marks = MARKS.intersection(words)
                if marks and all(w in MARKS or w in BESIDE for w in words) and not (marks == {"header"} and OWN.intersection(words)):
                    found = max(found, 2 if READERS & marks else 1)
    return found


class Page:
    """The blocks of a page's article in order, and the tree they stand in.

    tree: nodes in the order of their beginnings as (parent, name); blocks are nodes named #. blocks: (node, text).

    Pages with an article element give its blocks, and their h1 if it stands before it; else those of main, else all.
    An article inside another one or inside an element with a mark is what readers write or a teaser: a section like
    others. An element whose class or id names something else is left out unless it holds the article or half of the
    text; one for what readers write is left out wherever there is other text. Paragraphs and headings are never left
    out for their names. Work is in proportion to the page, however deep elements stand in each other."""

    def __init__(self, html: str) -> None:
        self.tree: list[tuple[int, str]] = [(-1, "page")]
        self.found: list[tuple[int, str, frozenset[str], tuple[int, ...]]] = []  # node, text, tags around, marked elements around
        self.holds: list[bool] = []  # by marked element: an article or main element
        self.readers: list[bool] = []  # by marked element: what readers write
        self._stack: list[tuple[str, int, bool, int, str]] = [("page", 0, False, -1, "page")]  # tag, node, dropped, marked element, what it counts as
        self._open_tags: Counter = Counter()  # of the stack, by tag and, in _kinds, by what it counts as
        self._kinds: Counter = Counter()
        self._drops, self._marks = 0, []
        self._text: list[str] = []
        endless: set[str] = set()
        at, n = 0, len(html)
        while at < n:
            m = TAG.search(html, at)
            begin = m.start() if m else n
            if begin > at and not self._drops:
                self._text.append(unescape(html[at:begin]))
            if not m:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                self._close(tag)
            elif tag in RAW:
                if tag in FOREIGN and (m[3] or "").endswith("/"):
                    continue
                end = None if tag in endless else re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I).search(html, at)
                if not end:
                    endless.add(tag)
                at = end.end() if end else at if tag in FOREIGN else n
            elif m[4]:
                self._open(tag, m[3] or "")
        self._flush()
        self.blocks = self._chosen()

    def _push(self, tag: str, node: int, drop: bool, element: int = -1, kind: str | None = None) -> None:
        self._stack.append((tag, node, drop, element, kind or tag))
        self._open_tags[tag] += 1
        self._kinds[kind or tag] += 1
        self._drops += drop
        if element >= 0:
            self._marks.append(element)

    def _cut(self, k: int) -> None:
        """Ends the elements from place k of the stack on."""
        for tag, _, drop, element, kind in self._stack[k:]:
            self._open_tags[tag] -= 1
            self._kinds[kind] -= 1
            self._drops -= drop
            if element >= 0:
                self._marks.pop()
        del self._stack[k:]

    def _chosen(self) -> list[tuple[int, str]]:
        whole, inside = 0, [0] * len(self.holds)
        for _, text, _, marks in self.found:
            whole += len(text)
            for k in marks:
                inside[k] += len(text)
        left = {k for k, size in enumerate(inside) if not self.holds[k] and (2 * size < whole or self.readers[k] and size < whole)}
        rest = [(node, t, tags) for node, t, tags, marks in self.found if not left.intersection(marks)]
        has = {name for _, name in self.tree}
        if "article" in has:
            first = next((node for node, (_, name) in enumerate(self.tree) if name == "article"), 0)
            titled = any("article" in tags and "h1" in tags for _, _, tags in rest)
            return [(node, t) for node, t, tags in rest if "article" in tags or "h1" in tags and node < first and not titled]
        if "main" in has:
            return [(node, t) for node, t, tags in rest if "main" in tags]
        return [(node, t) for node, t, _ in rest]

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text = []
        if not text or self._drops:
            return
        tags = frozenset(k for k in TELLING if self._kinds[k] > 0)
        if "header" in tags and not HEADINGS & tags and "lead" not in tags:
            return
        self.found.append((len(self.tree), text, tags, tuple(self._marks)))
        self.tree.append((self._stack[-1][1], "#"))

    def _open(self, tag: str, attributes: str) -> None:
        node = self._stack[-1][1]
        marked = 0 if tag in ROOTS and tag != "article" or not attributes else _marked(attributes)
        if marked < 3 and tag in TEXTS:
            marked = 0
        if tag not in BLOCKS:
            if tag == "br":
                if not self._drops:
                    self._text.append("\n")
            elif tag in CONTROLS and self._stack[-1][0] not in PROSE:
                self._flush()
                self._push(tag, node, True)
            elif tag in UNSEEN or marked == 3 and tag not in VOID:
                self._push(tag, node, True)
            return
        self._flush()
        if self._stack[-1][0] == "p":
            self._cut(len(self._stack) - 1)
        if tag in FAMILIES and any(self._open_tags[t] for t in FAMILIES[tag][0]):
            ended, shields = FAMILIES[tag]
            for k in range(len(self._stack) - 1, 0, -1):
                if self._stack[k][0] in shields or self._stack[k][0] in SHIELDS and self._stack[k][0] not in ended:
                    break
                if self._stack[k][0] in ended:
                    self._cut(k)
                    break
        if tag in VOID:
            return
        drop = tag in DROPPED or marked == 3 or tag == "header" and not (self._open_tags["article"] or self._open_tags["main"])
        kind = tag
        if tag == "article" and (marked or self._marks or self._kinds["article"]):
            kind = "section"
        elif attributes and tag == "p" and self._kinds["header"] and LEADS.intersection(w for name, value in ATTRIBUTE.findall(attributes) if name.lower() == "class" for words in _words(value) for w in words):
            kind = "lead"
        node, element = self._stack[-1][1], -1
        if not drop and not self._drops:
            self.tree.append((node, "p" if kind == "lead" else kind))
            node = len(self.tree) - 1
            if kind in ("article", "main"):
                for k in self._marks:
                    self.holds[k] = True
            if marked:
                element = len(self.holds)
                self.holds.append(False)
                self.readers.append(marked == 2)
        self._push(tag, node, drop, element, kind)

    def _close(self, tag: str) -> None:
        if tag not in BLOCKS:
            # An inline element is on the stack only if it is left out.
            for k in range(len(self._stack) - 1, 0, -1) if self._open_tags[tag] else ():
                if self._stack[k][0] == tag:
                    self._cut(k)
                    break
                if self._stack[k][0] in BLOCKS:
                    break
            return
        self._flush()
        for k in range(len(self._stack) - 1, 0, -1) if self._open_tags[tag] else ():
            if self._stack[k][0] == tag:
                self._cut(k)
                break
            if self._stack[k][0] in SHIELDS:
                break


class _Tree:
    """Children, the shape of each subtree as a number (equal shapes, equal numbers) and its texts as a hash; 0: none."""

    def __init__(self, tree: list[tuple[int, str]], texts: dict[int, int], shapes: dict[tuple, int]) -> None:
        self.children: list[list[int]] = [[] for _ in tree]
        for node, (parent, _) in enumerate(tree):
            if parent >= 0:
                self.children[parent].append(node)
        self.shape, self.text = [0] * len(tree), [0] * len(tree)
        for node in range(len(tree) - 1, -1, -1):  # children follow their parents
            kids = self.children[node]
            self.shape[node] = shapes.setdefault((tree[node][1], *(self.shape[k] for k in kids)), len(shapes))
            if node in texts or any(self.text[k] for k in kids):
                self.text[node] = hash((texts.get(node, 0), *(self.text[k] for k in kids))) or 1


def _table(weights: Iterable[np.ndarray], first: np.ndarray) -> Iterator[np.ndarray]:
    """Best sums of weights of matches in order, for every pair of beginnings: a row for each row of weights, ``first``
    before them."""
    row = first
    yield row
    for w in weights:
        above, row = row, np.zeros_like(row)
        np.maximum.accumulate(np.maximum(above[1:], above[:-1] + w), out=row[1:])
        yield row


def _matches(row: Callable[[int], np.ndarray], height: int, width: int) -> Iterator[tuple[int, int]]:
    """Places of the pairs of the best matching in order, from the last, by rows of weights.

    Of the table at most about CELLS values, or twice the square root of its rows, are kept: the rows that blocks begin
    with, from which each block is made again when it is read backwards. The pairs are those of the whole table."""
    step = max(math.isqrt(height), CELLS // (width + 1))
    begins = [np.zeros(width + 1, np.int32)]
    for i, values in enumerate(_table(map(row, range((height - 1) // step * step)), begins[0])):
        if i and i % step == 0:
            begins.append(values)
    i, j = height, width
    for begin in reversed(begins):
        base = (i - 1) // step * step
        table = list(_table(map(row, range(base, i)), begin))
        while i > base and j:
            w = row(i - 1)[j - 1]
            here, above = table[i - base], table[i - base - 1]
            if w and here[j] == above[j - 1] + w:
                i, j = i - 1, j - 1
                yield i, j
            elif here[j] == above[j]:
                i -= 1
            else:
                j -= 1
        if not j:
            return


class _Matching:
    """Simple tree matching of two trees: nodes with nodes of their name, parents with parents, in order.

    The weight of two subtrees by shape is the size of their largest matching, computed once for each pair of shapes;
    equal texts weigh one more, which decides between neighbours of one shape."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.known: dict[tuple[int, int], int] = {}

    def learn(self, shapes: dict[tuple, int]) -> None:
        self.parts.extend(islice(shapes, len(self.parts), None))  # numbers are places, in order

    def weight(self, a: int, b: int) -> int:
        waiting = [(a, b)]
        while waiting:
            x, y = waiting[-1]
            left, right = self.parts[x], self.parts[y]
            if (x, y) in self.known:
                waiting.pop()
            elif left[0] != right[0]:
                self.known[x, y] = 0
            elif len(left) == 1 or len(right) == 1:
                self.known[x, y] = 1
            else:
                pairs = {(p, q) for p in set(left[1:]) for q in set(right[1:])}
                more = [p for p in pairs if p not in self.known]
                if more:
                    waiting.extend(more)
                else:
                    kinds = {q: n for n, q in enumerate(dict.fromkeys(right[1:]))}
                    columns = np.array([kinds[q] for q in right[1:]])
                    rows = {p: np.array([self.known[p, q] for q in kinds], np.int32) for p in set(left[1:])}
                    for last in _table((rows[p][columns] for p in left[1:]), np.zeros(len(right), np.int32)):
                        pass
                    self.known[x, y] = 1 + int(last[-1])
        return self.known[a, b]

    def children(self, one: _Tree, other: _Tree, left: list[int], right: list[int]) -> Iterator[tuple[int, int]]:
        """Pairs of the two lists. Equal beginnings and ends go first; what lies between is matched by a table."""
        same = lambda x, y: one.shape[x] == other.shape[y] and one.text[x] == other.text[y]
        i, j, k = 0, len(left), len(right)
        while i < min(j, k) and same(left[i], right[i]):
            yield left[i], right[i]
            i += 1
        while i < j and i < k and same(left[j - 1], right[k - 1]):
            j, k = j - 1, k - 1
            yield left[j], right[k]
        left, right = left[i:j], right[i:k]
        if not left or not right:
            return
        kinds = {p: n for n, p in enumerate(dict.fromkeys(other.shape[y] for y in right))}
        columns = np.array([kinds[other.shape[y]] for y in right])
        rows = {p: np.array([self.weight(p, q) for q in kinds], np.int32) for p in {one.shape[x] for x in left}}
        texts = np.array([other.text[y] for y in right], np.int64)

        def row(i: int) -> np.ndarray:
            w = rows[one.shape[left[i]]][columns]
            return w + ((w > 0) & (texts == one.text[left[i]]) & (texts != 0))

        yield from ((left[i], right[j]) for i, j in _matches(row, len(left), len(right)))


class Reference:
    """A tree that others are aligned with; what is known of shapes is kept from one to the next."""

    def __init__(self, tree: list[tuple[int, str]], texts: dict[int, int]) -> None:
        self.tree = tree
        self.shapes: dict[tuple, int] = {}
        self.own = _Tree(tree, texts, self.shapes)
        self.matching = _Matching()

    def align(self, tree: list[tuple[int, str]], texts: dict[int, int]) -> dict[int, int]:
        one, two, matching, matched, waiting = _Tree(tree, texts, self.shapes), self.own, self.matching, {}, [(0, 0)]
        matching.learn(self.shapes)
        while waiting:
            a, b = waiting.pop()
            matched[a] = b
            left, right = one.children[a], two.children[b]
            if len(left) == len(right) == 1:
                if tree[left[0]][1] == self.tree[right[0]][1]:
                    waiting.append((left[0], right[0]))
            elif left and right:
                waiting.extend((x, y) for x, y in matching.children(one, two, left, right) if tree[x][1] == self.tree[y][1])
        return matched


def align(tree: list[tuple[int, str]], other: list[tuple[int, str]], texts: tuple[dict[int, int], dict[int, int]] = ({}, {})) -> dict[int, int]:
    """Nodes of tree matched with nodes of other; texts: hashes of the blocks by node."""
    return Reference(other, texts[1]).align(tree, texts[0])


def host_of(url: Column) -> Column:
    """The host of a URL column, lower case, without user and port; an unreadable or null one: empty."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _keys(ident: str, url: str, html: str) -> list[Column]:
    """96 bits of hash that stand for a page; pages equal in all three have one key and one result."""
    whole = [F.col(ident), F.col(url), F.col(html)]
    return [F.xxhash64(*whole).alias("k0"), F.hash(*whole).alias("k1")]


def parsed(pages: DataFrame, ident: str, url: str, html: str) -> DataFrame:
    """(k0, k1, host, page_hash, shape, nodes, tree, block_nodes, block_hashes): a row for each page that has a block."""
    names = ["k0", "k1", "host", "page_hash", "shape", "nodes", "tree", "block_nodes", "block_hashes"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        import xxhash

        number = lambda t: xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63)
        for batch in batches:
            rows, kept = [], []
            for k, value in enumerate(batch.column(3)):
                page = Page(value.as_py() or "")
                if page.blocks:
                    kept.append(k)
                    tree, texts = json.dumps(page.tree, separators=(",", ":")), [t for _, t in page.blocks]
                    rows.append((number("\n".join(texts)), number(tree), len(page.tree), tree, [n for n, _ in page.blocks], [number(t) for t in texts]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            own = [c.take(pa.array(kept, pa.int64())) for c in batch.columns[:3]]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    given = pages.select(*_keys(ident, url, html), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    return given.mapInArrow(run, "k0 long, k1 int, host string, page_hash long, shape long, nodes int, tree string, block_nodes array<int>, block_hashes array<long>")


def aligned(trees: DataFrame) -> DataFrame:
    """(k0, k1, host, page_hash, hashes, slots): for each reference of the host the nodes that the page's blocks are
    matched with, in order of the blocks; -1: none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        known: dict[tuple[str, int], Reference] = {}
        for batch in batches:
            out = []
            for tree, nodes, hashes, references in zip(*(batch.column(c).to_pylist() for c in ("tree", "block_nodes", "hashes", "references")), strict=True):
                own, slots, texts = json.loads(tree), [], dict(zip(nodes, hashes, strict=True))
                for r in references:
                    name = r["tree"], r["page_hash"]
                    if name not in known:
                        if sum(len(x.shapes) for x in known.values()) + 1000 * len(known) > KNOWN_SHAPES:
                            known.clear()
                        known[name] = Reference(json.loads(r["tree"]), dict(zip(r["block_nodes"], r["block_hashes"], strict=True)))
                    matched = known[name].align(own, texts)
                    slots.append([matched.get(n, -1) for n in nodes])
                out.append(slots)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k0", "k1", "host", "page_hash", "hashes")), pa.array(out, pa.list_(pa.list_(pa.int32())))], names=["k0", "k1", "host", "page_hash", "hashes", "slots"])

    shapes = trees.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.min("page_hash").alias("page_hash"))
    best = shapes.join(trees.select("host", "shape", "page_hash", "nodes", "tree", "block_nodes", "block_hashes"), ["host", "shape", "page_hash"])
    order = F.struct("n", F.least("nodes", F.lit(ENOUGH_NODES)), "page_hash", "shape")
    best = best.groupBy("host", F.pmod("shape", F.lit(REFERENCES)).alias("k")).agg(F.max_by(F.struct("tree", "page_hash", "block_nodes", "block_hashes"), order).alias("x"))
    references = best.groupBy("host").agg(F.collect_list("x").alias("references"))
    given = salted_join(trees.select("k0", "k1", "host", "page_hash", "tree", "block_nodes", F.col("block_hashes").alias("hashes")), references, ["host"], by=F.col("k0"))
    return given.mapInArrow(run, "k0 long, k1 int, host string, page_hash long, hashes array<long>, slots array<array<int>>")


def template(blocks: DataFrame, share: float = SHARE, least: int = LEAST_PAGES, part: float = PART) -> DataFrame:
    """(host, k, slot, hash): the texts that are template, by reference and node. Pages with equal texts count once."""
    pages = materialize(blocks.groupBy("host", "page_hash").agg(F.min(F.struct("hashes", "slots")).alias("x")).select("host", "page_hash", "x.*"), "html-distinct")
    many = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least)
    # A text that is template stands on several pages; the others need not be counted by node.
    texts = pages.select("host", F.explode(F.array_distinct("hashes")).alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("host", "hash")
    nodes = pages.select("host", F.posexplode("slots").alias("k", "s")).select("host", "k", F.explode(F.array_distinct("s")).alias("slot")).where("slot >= 0").groupBy("host", "k", "slot").agg(F.count(F.lit(1)).alias("have"))
    each = pages.select("host", F.posexplode("slots").alias("k", "s"), "hashes").select("host", "k", F.explode(F.array_distinct(F.arrays_zip(F.col("s").alias("slot"), F.col("hashes").alias("hash")))).alias("b")).select("host", "k", "b.slot", "b.hash").where("slot >= 0")
    at = salted_join(each, texts, ["host", "hash"], "left_semi", by=F.xxhash64("hash", "slot")).groupBy("host", "k", "slot", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    found = at.join(nodes, ["host", "k", "slot"]).join(many, "host")
    return found.where((F.col("n") >= share * F.col("have")) & (F.col("n") >= part * F.col("pages"))).select("host", "k", "slot", "hash")


def main_text(pages: DataFrame, ident: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """ident, url, text (blocks in page order, joined by two line feeds), n_chars (long, code points), n_template.

    Character references are decoded and white space within a block becomes one space. What a page gives: see Page.
    n_template: blocks left out because the host's template has them.

    Null or empty html: the empty text. A null or unreadable url: the host with the empty name. Broken or cut markup
    is read as far as it goes; an unclosed tag at the end is dropped. Rows that repeat: a result each. A template needs
    LEAST_PAGES different pages that show it; pages without blocks count nowhere, so empty ones change nothing. Pages
    of any length are aligned by the one rule, in memory that doesn't grow with pairs of children; their time does. Empty
    table: no rows. Other columns play no part.
    """
    trees = materialize(parsed(pages, ident, url, html), "html-trees")
    blocks = materialize(aligned(trees), "html-aligned")
    constant = template(blocks)
    each = blocks.select("k0", "k1", "host", "hashes", F.posexplode("slots").alias("k", "s")).select("k0", "k1", "host", "k", F.posexplode(F.arrays_zip(F.col("s").alias("slot"), F.col("hashes").alias("hash"))).alias("at", "b"))
    each = each.select("k0", "k1", "host", "k", "at", "b.slot", "b.hash").where("slot >= 0")
    gone = salted_join(each, constant, ["host", "k", "slot", "hash"], "left_semi", by=F.col("k0")).groupBy("k0", "k1").agg(F.collect_set("at").alias("gone"))
    # Written first, so that its size is known when the pages are joined: a small one needs no shuffle of the pages.
    gone = materialize(gone, "html-gone")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[t for _, t in Page(v.as_py() or "").blocks] for v in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.list_(pa.string()))], names=["k0", "k1", "id", "url", "blocks"])

    kind = pages.schema[ident].dataType.simpleString()
    given = pages.select(*_keys(ident, url, html), F.col(ident).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    joined = given.mapInArrow(read, f"k0 long, k1 int, id {kind}, url string, blocks array<string>").join(gone, ["k0", "k1"], "left")
    left = F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda _, i: ~F.array_contains("gone", i)))
    out = joined.select("id", "url", F.array_join(left, "\n\n").alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_template"))
    return out.select(F.col("id").alias(ident), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"), F.greatest("n_template", F.lit(0)).alias("n_template"))
