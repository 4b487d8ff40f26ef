"""Main text of web pages by wrappers inferred as union-free regular expressions.

A page is read as a balanced stream of tags and text slots, that is, a tree. Within an element, neighbours of one symbol, or of one
group of symbols, are a repeated group (``+``). Up to ``SAMPLE`` distinct pages of a host (those of the smallest hashes of the html) are
aligned one after another, element by element: what both sides have stays one node, what one side lacks becomes optional
(``?``), and each text slot gathers what the pages hold there. From that each slot is decided once for the host: it is main text
if it is inside the article (``article`` or ``main``, else the elements with most varying text outside links), and, where the
region isn't marked as an article, the texts that a slot holds on every page go, unless they outweigh all that varies.

A page is matched with its host's expression; a text that falls into a slot is kept or dropped as the slot says. Element and class
names decide for text without a slot, and for slots of elements that say what they are; the less certain names (``WEAK``)
yield to slots that vary.
"""

from __future__ import annotations

import html as htmllib
import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from quillmark.llm._spark import bounded_batches, written
from quillmark.llm._words import trimmed

SAMPLE = 8
BROADCAST_HOSTS = 10_000
SALTS = 32
ALIGN_CELLS = 1_000_000

# Element kinds of HTML, and words that mark an element as something other than the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select option".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav footer aside form button dialog menu head select option input object applet audio video canvas".split()) | RAW
MARKS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent notice notices alert gdpr newsletter subscribe subscription nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar side footer masthead topbar toolbar comment comments commentlist disqus reply replies respond share sharing social related recommended widget modal popup overlay login signup search pagination pager copyright skip".split()
)
WEAK = frozenset("alert banner login modal overlay pager pagination popup promo promotion replies reply search side skip social toolbar widget".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
ARTICLE = frozenset(("article", "main"))
IMPLIED = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}  # start tags that end these

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)[^>]*\Z", re.S)
_ATTR = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")  # of any alphabet


def tokens(source: str) -> list[tuple[str, str, str]]:
    """(kind, name, data): ("open", tag, attributes), ("close", tag, "") and ("text", "", raw text); comments go."""
    out, at, n = [], 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            out.append(("text", "", source[at:]))
            break
        if m.start() > at:
            out.append(("text", "", source[at : m.start()]))
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            out.append(("close", name, ""))
            continue
        out.append(("open", name, m[3] or ""))
        if name in RAW and not (m[3] or "").endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(source, at)
            stop = end.start() if end else n
            if stop > at:
                out.append(("raw", name, source[at:stop]))
            at = stop
    return out


@lru_cache(maxsize=4096)
def _marked(tag: str, attributes: str) -> int:
    """2 if an element says that it is something other than the article, 1 if only a ``WEAK`` name says so, else 0."""
    if tag in DROPPED:
        return 2
    level = 0
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("hidden", "aria-hidden") and value != "false" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 2
        if name == "role" and value in ROLES:
            return 2
        if name in ("class", "id") and tag not in ("html", "body"):
            words = set(re.split(r"[^a-z0-9]+", value)) & MARKS
            if words - WEAK:
                return 2
            level = max(level, int(bool(words)))
    return level


@lru_cache(maxsize=4096)
def _symbol(tag: str, attributes: str) -> str:
    named = sorted((n.lower(), (a or b or c).lower()) for n, a, b, c in _ATTR.findall(attributes) if n.lower() in ("class", "id", "role"))
    return f"<{tag}{''.join(f' {n}={v}' for n, v in named)}>"


def clean(raw: str) -> str:
    return _SPACE.sub(" ", htmllib.unescape(raw))


class Text:
    """A piece of text: its path, how marked it is, whether it is in an article and in a link, and its block."""

    __slots__ = ("path", "marked", "inside", "link", "block", "raw")

    def __init__(self, path: tuple, marked: int, inside: bool, link: bool, block: int, raw: str):
        self.path, self.marked, self.inside, self.link, self.block, self.raw = path, marked, inside, link, block, raw


class Node:
    """An element, a text slot (``#``) or a group of a page."""

    __slots__ = ("symbol", "children", "texts")

    def __init__(self, symbol: str, children: list | None = None):
        self.symbol, self.children, self.texts = symbol, children or [], []


class Page:
    """A page's tree without inline elements, and its texts in order; white space alone is a text without a slot."""

    def __init__(self, source: str):
        self.root = Node("")
        self.texts: list[Text] = []
        stack: list[tuple[str, Node, int]] = []
        open_nodes = [self.root]
        block = 0
        for kind, name, data in tokens(source):
            if kind == "open":
                if name not in INLINE:
                    block += 1
                if name in IMPLIED:
                    self._close(stack, open_nodes, IMPLIED[name])
                node = Node(_symbol(name, data))
                single = name in VOID or data.endswith("/")
                if name not in INLINE and name != "br":
                    open_nodes[-1].children.append(node)
                if not single:
                    stack.append((name, node, _marked(name, data)))
                    if name not in INLINE:
                        open_nodes.append(node)
            elif kind == "close":
                if name not in INLINE:
                    block += 1
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        self._pop(stack, open_nodes, i)
                        break
            elif kind == "text":
                inside = any(s[0] in ARTICLE for s in stack)
                marked = max((2 if s[0] == "header" and not inside else s[2] for s in stack), default=0)
                found = Text(tuple(s[1].symbol for s in stack if s[0] not in INLINE and s[0] not in ("p", "li")), marked, inside, any(s[0] == "a" for s in stack), block, data)
                self.texts.append(found)
                if not data.isspace():
                    siblings = open_nodes[-1].children
                    if not siblings or siblings[-1].symbol != "#":
                        siblings.append(Node("#"))
                    siblings[-1].texts.append(found)

    @staticmethod
    def _pop(stack: list, open_nodes: list, i: int) -> None:
        blocks = sum(s[0] not in INLINE for s in stack[i:])
        del stack[i:]
        if blocks:
            del open_nodes[-blocks:]

    @classmethod
    def _close(cls, stack: list, open_nodes: list, names: tuple) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                cls._pop(stack, open_nodes, i)
                return
            if stack[i][0] not in INLINE:
                return


def fold(nodes: list[Node], known: frozenset = frozenset()) -> list[tuple[str, list[Node]]]:
    """Runs (symbol, nodes) of neighbours. Runs of equal symbols first, then groups of runs that repeat at once, the shortest first; a
    group of ``known`` counts even if it occurs once."""
    runs: list[tuple[str, list[Node]]] = []
    for n in nodes:
        if runs and runs[-1][0] == n.symbol:
            runs[-1][1].append(n)
        else:
            runs.append((n.symbol, [n]))
    known_sizes = {len(k) for k in known}
    size = 2
    while size <= max(len(runs) // 2, max(known_sizes, default=0)):
        if size in known_sizes or _repeating([r[0] for r in runs], size):
            out, i = [], 0
            while i < len(runs):
                group = tuple(r[0] for r in runs[i : i + size])
                j = i + size
                while len(group) == size and tuple(r[0] for r in runs[j : j + size]) == group:
                    j += size
                if len(group) == size and (j > i + size or group in known):
                    turns = [Node(_group(group), [n for r in runs[k : k + size] for n in r[1]]) for k in range(i, j, size)]
                    out.append((_group(group), turns))
                    i = j
                else:
                    out.append(runs[i])
                    i += 1
            runs = out
        size += 1
    return runs


def _group(symbols: tuple) -> str:
    return json.dumps(symbols)


def _repeating(symbols: list[str], size: int) -> bool:
    """Whether some ``size`` neighbours are followed by the same again."""
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(s, len(number)) for s in symbols])
    same = ids[:-size] == ids[size:]
    if same.sum() < size:
        return False
    ends = np.concatenate([[-1], np.flatnonzero(~same), [len(same)]])
    return bool((np.diff(ends) > size).any())


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence. Beyond ``ALIGN_CELLS`` cells, what lies between symbols that occur once on each side is
    aligned on its own, and a part without such symbols is a mismatch as a whole."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        n, m = a1 - a0, b1 - b0
        if not n or not m:
            continue
        if n * m > ALIGN_CELLS:
            once_a, once_b = _once(a, a0, a1), _once(b, b0, b1)
            last_a, last_b = a0, b0
            cuts = []
            for s, i in once_a.items():  # in order of the left side; a symbol out of order on the right is no cut
                j = once_b.get(s, -1)
                if j >= last_b:
                    cuts.append((last_a, i, last_b, j))
                    out.append((i, j))
                    last_a, last_b = i + 1, j + 1
            if cuts:
                todo += cuts + [(last_a, a1, last_b, b1)]
            continue
        best = [[0] * (m + 1)]
        for i in range(n - 1, -1, -1):
            above, row = best[-1], [0] * (m + 1)
            for j in range(m - 1, -1, -1):
                row[j] = above[j + 1] + 1 if a[a0 + i] == b[b0 + j] else max(above[j], row[j + 1])
            best.append(row)
        best.reverse()
        i = j = 0
        while i < n and j < m:
            if a[a0 + i] == b[b0 + j]:
                out.append((a0 + i, b0 + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return sorted(out)


def _once(symbols: list[str], lo: int, hi: int) -> dict[str, int]:
    count: dict[str, int] = {}
    for s in symbols[lo:hi]:
        count[s] = count.get(s, 0) + 1
    return {s: i for i, s in enumerate(symbols[lo:hi], lo) if count[s] == 1}


class Part:
    """A node of the expression: how often its parent and it were there, whether it repeats, and a slot's texts by page."""

    __slots__ = ("symbol", "children", "seen", "there", "plus", "texts", "keep", "fixed")

    def __init__(self, symbol: str):
        self.symbol, self.children = symbol, []
        self.seen = self.there = 0
        self.plus, self.keep = False, False
        self.texts: dict[int, list[Text]] = {}
        self.fixed: frozenset = frozenset()

    def known(self) -> frozenset:
        return frozenset(tuple(json.loads(c.symbol)) for c in self.children if c.symbol.startswith("["))


def _merge(root: Part, page: Page, number: int) -> None:
    todo = [(root, page.root)]
    while todo:
        part, node = todo.pop()
        part.seen += 1
        if part.symbol == "#":
            part.texts.setdefault(number, []).extend(node.texts)
            continue
        runs = fold(node.children, part.known())
        pairs = dict((j, i) for i, j in align([c.symbol for c in part.children], [r[0] for r in runs]))
        merged, at = [], 0
        for j, (symbol, nodes) in enumerate(runs):
            if j in pairs:
                merged += part.children[at : pairs[j]]
                own, at = part.children[pairs[j]], pairs[j] + 1
            else:
                own = Part(symbol)
            own.there += 1
            own.plus |= len(nodes) > 1
            merged.append(own)
            todo += [(own, n) for n in nodes]
        part.children = merged + part.children[at:]


class Wrapper:
    """The expression of a host's pages, its decided slots, and the containers of pages without an article."""

    def __init__(self, root: Part, containers: list[str]):
        self.root, self.containers = root, containers

    def expression(self) -> str:
        out, todo = [], [(self.root, c) for c in reversed(self.root.children)]
        while todo:
            parent, part = todo.pop()
            if isinstance(part, str):
                out.append(part)
                continue
            sign = ("+" if part.plus else "") + ("?" if part.there < parent.seen else "")
            tag = re.match(r"<([^\s>]+)", part.symbol)
            out.append(("(" if sign else "") + ("" if part.symbol.startswith("[") else part.symbol))
            todo.append((parent, (f"</{tag[1]}>" if tag else "") + (")" + sign if sign else "")))
            todo += [(part, c) for c in reversed(part.children)]
        return "".join(out)

    def dump(self) -> str:
        """A row (symbol, its parent's row, kept, texts that go) for every node, parents first; nesting has no bound."""
        rows, todo = [], [(c, -1) for c in reversed(self.root.children)]
        while todo:
            part, parent = todo.pop()
            rows.append((part.symbol, parent, int(part.keep), sorted(part.fixed)))
            todo += [(c, len(rows) - 1) for c in reversed(part.children)]
        return json.dumps({"containers": self.containers, "nodes": rows, "expression": self.expression()})


def _slots(root: Part) -> list[Part]:
    out, todo = [], [root]
    while todo:
        part = todo.pop()
        if part.symbol == "#":
            out.append(part)
        todo += part.children
    return out


def _containers(texts: list[tuple[Text, str]]) -> list[str]:
    """The paths with most text outside links and marked elements: the longest, and all of a fifth of its length or more."""
    weight: dict[str, int] = {}
    for t, text in texts:
        if not t.marked and not t.link:
            weight[" ".join(t.path)] = weight.get(" ".join(t.path), 0) + len(text)
    most = max(weight.values(), default=0)
    return sorted(p for p, n in weight.items() if n and 5 * n >= most)


def _within(t: Text, containers: list[str]) -> bool:
    path = " ".join(t.path)
    return any(path == c or path.startswith(c + " ") or not c for c in containers)


def infer(sources: list[str]) -> Wrapper:
    """The wrapper of some pages of one host; the longest page is the first version of the expression."""
    pages = [Page(s) for s in sorted(sources, key=lambda s: (-len(s), s))]
    root = Part("")
    for k, page in enumerate(pages):
        _merge(root, page, k)
    slots = _slots(root)
    article = {k for k, p in enumerate(pages) if any(t.inside and t.marked < 2 and not t.raw.isspace() for t in p.texts)}
    same: dict[int, frozenset] = {}
    for s in slots:
        sets = [{clean(t.raw).strip() for t in ts} for ts in s.texts.values()]
        same[id(s)] = frozenset(set.intersection(*sets)) if len(sets) > 2 else frozenset()
    plain = [(t, clean(t.raw).strip(), s) for s in slots for k, ts in s.texts.items() if k not in article for t in ts]
    containers = _containers([(t, text) for t, text, s in plain if text not in same[id(s)]])
    held = [(len(text), text in same[id(s)]) for t, text, s in plain if not t.marked and not t.link and _within(t, containers)]
    copies = sum(n for n, f in held if f) >= sum(n for n, f in held if not f)  # copies of one article: what is equal is the article
    if copies:
        containers = _containers([(t, text) for t, text, _ in plain])
    for s in slots:
        texts = [t for ts in s.texts.values() for t in ts]
        in_article = all(t.inside for t in texts)
        sets = {tuple(clean(t.raw).strip() for t in ts) for ts in s.texts.values()}
        varies = len(s.texts) > 2 and len(sets) > 1 and 2 * sum(len(t.raw) for t in texts if t.link) < sum(len(t.raw) for t in texts)
        marked = max(t.marked for t in texts)
        region = in_article or not set(s.texts) & article and all(_within(t, containers) for t in texts)
        s.keep = region and (marked == 0 or marked == 1 and varies)
        if not in_article and not copies:
            s.fixed = same[id(s)]
    return Wrapper(root, containers)


@lru_cache(maxsize=256)
def _loaded(dumped: str | None) -> tuple[Part, list[str]]:
    x = json.loads(dumped) if dumped else {"containers": [], "nodes": []}
    root, parts = Part(""), []
    for symbol, parent, keep, fixed in x["nodes"]:
        part = Part(symbol)
        part.keep, part.fixed = bool(keep), frozenset(fixed)
        (parts[parent] if parent >= 0 else root).children.append(part)
        parts.append(part)
    return root, x["containers"]


def match(root: Part, page: Page) -> dict[int, Part]:
    """The slot of each text (by its ``id``) that the expression has a place for."""
    out, todo = {}, [(root, page.root)]
    while todo:
        part, node = todo.pop()
        if part.symbol == "#":
            out.update((id(t), part) for t in node.texts)
            continue
        if not part.children or not node.children:
            continue
        runs = fold(node.children, part.known())
        for i, j in align([c.symbol for c in part.children], [r[0] for r in runs]):
            todo += [(part.children[i], n) for n in runs[j][1]]
    return out


def main_text(source: str, wrapper: str | None) -> str:
    """The page's kept blocks, each with single spaces and trimmed, joined by one space."""
    page = Page(source or "")
    root, containers = _loaded(wrapper)
    slot = match(root, page)
    texts = [t for t in page.texts if not t.raw.isspace()]
    article = any(t.inside and not t.marked for t in texts)
    if not article and not any(_within(t, containers) for t in texts):
        containers = _containers([(t, t.raw) for t in texts])  # a page unlike its host's others
    blocks: dict[int, list[str]] = {}
    for t in page.texts:
        if t.raw.isspace():
            if t.block in blocks:
                blocks[t.block].append(" ")
            continue
        own = slot.get(id(t))
        if own is not None:
            keep = own.keep and clean(t.raw).strip() not in own.fixed
        else:
            keep = not t.marked and (t.inside if article else _within(t, containers))
        if keep:
            blocks.setdefault(t.block, []).append(t.raw)
    return " ".join(x for x in (clean("".join(b)).strip(" ") for b in blocks.values()) if x)


def wrappers(pages: DataFrame, *, sample: int = SAMPLE, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """(host, wrapper) of every host from (host, html), by the ``sample`` distinct pages of the least hashes; null pages teach nothing, a
    host without any page has no row."""
    hashed = pages.where("html is not null").select("host", "html", F.xxhash64("html").alias("order"))
    ranked = hashed.select("host", "order").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy("order")))
    chosen = written(ranked.where(F.col("rank") <= sample).select("host", "order"), "page-sample")
    if chosen.count() <= sample * broadcast_hosts:  # the html of the other pages stays where it is
        chosen = F.broadcast(chosen)
    few = hashed.join(chosen, ["host", "order"], "left_semi").dropDuplicates(["host", "order"]).select("host", "html")  # copies of a page count once

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": frame["host"].iloc[:1], "wrapper": [infer(sorted(set(frame["html"]))).dump()]})

    return few.groupBy("host").applyInPandas(fit, "host string, wrapper string")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """(page_id, url, text, wrapper) per row. Null or empty html gives the empty text; a null url belongs to the host ''.

    A host of fewer than three distinct pages has no slot that is known to vary or to stay, so names and containers decide there.
    Repeated rows repeat; other columns are ignored. Wrappers are broadcast for up to ``broadcast_hosts`` hosts; with more, rows
    and wrappers are joined by host and a salt, so that a host with many pages is spread.
    """
    bounded_batches(pages)
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    src = src.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit("")))
    found = written(wrappers(src.select("host", "html"), sample=sample, broadcast_hosts=broadcast_hosts), "wrappers")
    if found.count() <= broadcast_hosts:
        joined = src.join(F.broadcast(found), "host", "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = src.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches):
        for b in trimmed(batches):
            text = [main_text(h, w) for h, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), b.column(3)], names=["page_id", "url", "text", "wrapper"])

    kind = src.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(run, f"page_id {kind}, url string, text string, wrapper string")
