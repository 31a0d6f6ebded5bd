"""Main text of web pages by host consensus.

Every page scores its containers: the characters of a block (less those of links, none if links are
half of it) go to the container around it and, less a tenth a level, to those around that; tags and classes that name an
article weigh more. The best container's path of generalised tags and classes (digits as ``0``)
is the page's vote. Spark counts votes by host; the path with the most pages wins (then more
characters, then the larger path). Each page is then read again: the text of every element at its
host's winning path, in page order.

Left out at any depth: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments, known by their tags, roles and the words of their classes and ids. A header
inside an article keeps its headings.

Blocks are joined by one line feed; white space inside a block (a line break included) is one space.
Tags need not be closed: a block element ends an open paragraph, a list item the one before it.

Counts by host fold in the tasks, so a host of any size sends one row a task and path; the winners
are broadcast up to ``BROADCAST_BYTES`` and joined by a shuffle beyond it.

Defined results: every row stays. A null page is an empty one and has an empty text. A page without
a host, or without text at its host's winning path, is taken from its own best container. Repeated
rows vote each. ``text`` and ``n_chars`` replace input columns of these names; all others pass. An
empty table gives an empty table.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markup
from .common import cut, without

BROADCAST_BYTES = 8 << 20
#: What a container keeps of the score of those inside it.
DECAY = 0.9
#: Containers and the weight of their tags; body is the last resort.
CONTAINERS = {"article": 1.6, "main": 1.3, "section": 1.0, "div": 1.0, "td": 0.9, "body": 0.5}
#: Words in classes that name an article.
NAMING = frozenset("article articlebody body content entry main post story text".split())
#: Tags that are never main text.
OUTSIDE = frozenset("nav footer aside form script style noscript template iframe object svg math canvas select option textarea button dialog head title menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: Words in classes and ids that name something else than main text.
NAMES = frozenset(
    "ad ads adbox adsbygoogle advert advertisement advertising adverts adslot alert announcement banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies copyright "
    "discussion disqus feedback flash footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup "
    "promo promotion recommended related replies reply respond rail share sharing side sidebar signup skyscraper social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Words that turn such a class into a remark on the layout (``has-sidebar``).
LAYOUT = frozenset("has with without no layout wrapper page template".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PLAIN = frozenset("html body main".split())
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")
_TELLING = re.compile(r"class|id\s*=|role|hidden|style|itemprop", re.I)
_KEPT, _OUT, _HEAD = range(3)
#: Elements that the next of their kind ends if they are still open (a block ends p), and where that stops:
#: at the first elements for all of them, at the keys of the second for those named there.
_OPEN = ("p", "li", "dt", "tr", "td", "option")
_ALIAS = {"dd": "dt", "th": "td"}
_SCOPE = frozenset("table caption button object template html".split())
_BOUNDS = {"ul": ["li"], "ol": ["li"], "menu": ["li"], "dl": ["dt"], "tr": ["td"], "select": ["option"], "td": ["p", "li", "dt", "option"], "th": ["p", "li", "dt", "option"]}


def _is_other(given: dict[str, str], tag: str) -> bool:
    """Whether attributes name something else than main text."""
    if tag in _PLAIN:
        return False
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or given.get("role", "").lower() in ROLES or "display:none" in given.get("style", "").replace(" ", "").lower():
        return True
    for name in f"{given.get('class', '')} {given.get('id', '')}".split():
        words = {w.lower() for w in _SPLIT.split(name)}
        if words & NAMES and not words & LAYOUT:
            return True
    return False


def _selector(tag: str, given: dict[str, str]) -> str:
    classes = sorted({_DIGITS.sub("0", c.lower()).replace("/", "%2f") for c in given.get("class", "").split()})
    return ".".join([tag, *classes])


class Page:
    """The blocks of a page, and the elements around them."""

    def __init__(self, page: str):
        self.tag, self.above, self.selector, self.weight, self.zone = [""], [0], [""], [0.0], [_KEPT]
        self.blocks: list[tuple[str, int, int]] = []
        self._read(page)

    def _read(self, page: str) -> None:
        stack, opened = [0], [dict.fromkeys(_OPEN, 0)]  # of each open element, the depth of the nearest open p, li, ... that it may end
        depths: dict[str, list[int]] = {}
        words: list[str] = []
        links = owner = linked = headings = articles = 0

        def flush() -> None:
            nonlocal links
            if words:
                if text := " ".join("".join(words).split()):
                    self.blocks.append((text, owner, links))
                words.clear()
            links = 0

        def pop(depth: int) -> None:
            nonlocal linked, headings, articles
            while len(stack) > depth:
                at = stack.pop()
                opened.pop()
                tag = self.tag[at]
                depths[tag].pop()
                linked -= tag == "a"
                headings -= tag in _HEADINGS
                articles -= tag == "article"

        for kind, name, more in markup.tokens(page):
            top = stack[-1]
            if kind == markup.TEXT:
                zone = self.zone[top]
                if zone == _KEPT or (zone == _HEAD and headings):
                    if not words:
                        owner = top
                    words.append(name)
                    if linked:
                        links += len(name)
            elif kind == markup.START:
                block = name in markup.BLOCKS
                if block or name == "hr":
                    flush()
                elif name in ("br", "wbr", "img"):
                    words.append(" " if name == "br" else "")
                if name in markup.VOID:
                    continue
                if block:
                    near, key = opened[-1], _ALIAS.get(name, name)
                    ended = near["p"] if name not in ("option", "button") else 0
                    if key in near and near[key]:
                        ended = min(ended or near[key], near[key])
                    if ended:
                        pop(ended)
                        top = stack[-1]
                given = markup.attributes(more) if _TELLING.search(more) else {}
                zone = self.zone[top]
                if zone != _OUT:
                    if name in OUTSIDE or (given and _is_other(given, name)):
                        header = articles and (name in ("header", "div", "section", "hgroup")) and "header" in _SPLIT.split(f"{given.get('class', '')} {given.get('id', '')}".lower())
                        zone = _HEAD if header else _OUT
                    elif name == "header":
                        zone = _HEAD if articles else _OUT
                at = len(self.tag)
                self.tag.append(name)
                self.above.append(top)
                self.selector.append(_selector(name, given) if given else name)
                self.weight.append(self._weight(name, given))
                self.zone.append(zone)
                depth = len(stack)
                near = opened[-1]
                own = _ALIAS.get(name, name)
                if name in _SCOPE or name in _BOUNDS:
                    near = dict.fromkeys(_OPEN, 0) if name in _SCOPE else near | dict.fromkeys(_BOUNDS[name], 0)
                if own in near:
                    near = near | {own: depth}
                stack.append(at)
                opened.append(near)
                depths.setdefault(name, []).append(depth)
                linked += name == "a"
                headings += name in _HEADINGS
                articles += name == "article"
            elif kind == markup.END:
                block = name in markup.BLOCKS
                if block:
                    flush()
                found = depths.get(name)
                # an inline element that a block has meanwhile begun inside stays open, as does what is around it
                if found and (block or not any(self.tag[x] in markup.BLOCKS for x in stack[found[-1] + 1 : found[-1] + 64])):
                    pop(found[-1])
        flush()

    @staticmethod
    def _weight(name: str, given: dict[str, str]) -> float:
        weight = CONTAINERS.get(name, 0.0)
        if weight and given and name != "body":
            named = {w.lower() for w in _SPLIT.split(f"{given.get('class', '')} {given.get('id', '')}")}
            weight *= 1.3 if named & NAMING or given.get("role") in ("main", "article") or given.get("itemprop") == "articleBody" else 1.0
        return weight

    def best(self) -> tuple[int, float]:
        """The element with the highest score (the first among equals) and its characters; (0, 0) without text."""
        held = [0.0] * len(self.tag)
        for text, owner, links in self.blocks:
            held[owner] += len(text) - links if 2 * links < len(text) else 0
        for at in range(len(held) - 1, 0, -1):  # an element comes after those around it
            held[self.above[at]] += held[at] * (DECAY if self.weight[at] else 1.0)
        scores = [h * w for h, w in zip(held, self.weight)]
        top = max(range(len(scores)), key=lambda i: (scores[i], -i))
        return (top, held[top]) if scores[top] > 0 else (0, 0.0)

    def path(self, at: int) -> str:
        names = []
        while at:
            names.append(self.selector[at])
            at = self.above[at]
        return "/".join(reversed(names))

    def inside(self, path: str) -> list[bool]:
        """For each element, whether it lies at the path or below an element that does."""
        steps, count = path.split("/"), [0] * len(self.tag)  # steps of the path that the element and those around it take
        held = [False] * len(self.tag)
        for at in range(1, len(self.tag)):
            above = self.above[at]
            depth = count[above] if above else 0
            count[at] = depth + 1 if 0 <= depth < len(steps) and self.selector[at] == steps[depth] else -1
            held[at] = held[above] or count[at] == len(steps)
        return held

    def below(self, top: int) -> list[bool]:
        held = [False] * len(self.tag)
        for at in range(len(held)):
            held[at] = at == top or (at > 0 and held[self.above[at]])
        return held

    def text(self, path: str | None = None) -> str:
        """The blocks at a path, or of the best container if there are none."""
        if path is not None:
            held = self.inside(path)
            if found := [text for text, owner, _ in self.blocks if held[owner]]:
                return "\n".join(found)
        held = self.below(self.best()[0])
        return "\n".join(text for text, owner, _ in self.blocks if held[owner])


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without user and port; null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def votes(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, path, pages, chars): the paths that the pages of a host vote for."""

    def run(batches):
        for batch in batches:
            hosts, paths, chars = [], [], []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("page").to_pylist()):
                read = Page(page)
                at, held = read.best()
                if at:
                    hosts.append(host)
                    paths.append(read.path(at))
                    chars.append(int(held))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(chars, pa.int64())], names=["host", "path", "chars"])

    rows = df.select(host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("page")).filter("host is not null and page is not null")
    return rows.mapInArrow(run, "host string, path string, chars bigint").groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"))


def winners(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, path): the path with most votes of each host."""
    return votes(df, html, url).groupBy("host").agg(F.max_by("path", F.struct("pages", "chars", "path")).alias("path"))


def extract(df: DataFrame, html: str = "html", url: str = "url", keep_html: bool = True) -> DataFrame:
    """``df`` with ``text`` and ``n_chars`` (bigint, code points)."""
    found = cut(winners(df, html, url))
    size = found.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found
    kept = without(df, "text", "n_chars", *([] if keep_html else [html]))
    names = [f"`{c}`" for c in kept.columns]
    rows = df.select(F.struct(*names).alias("row") if names else F.lit(None).cast("string").alias("row"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("page"), host_of(F.col(url)).alias("host"))
    placed = rows.join(found, "host", "left").select("row", "page", "path")

    def run(batches):
        for batch in batches:
            texts = [Page(page).text(path) for page, path in zip(batch.column("page").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["row", "text", "n_chars"])

    out = placed.mapInArrow(run, T.StructType([placed.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
    return out.select(*(["row.*"] if names else []), "text", "n_chars")
