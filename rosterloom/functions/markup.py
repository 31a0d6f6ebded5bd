"""HTML as a stream of tokens: a small state machine over the whole page.

States are data, tag, comment and raw text. Attribute values may hold ``>``; comments end as browsers
end them; the contents of script, style and the like are one raw token, those of title and textarea
are text. What looks like a tag and is none is text. A page that ends inside a tag or a comment ends
there. Every pattern is possessive, so the time grows with the page alone.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT, START, END, RAW = range(4)

_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++)?)?"""
_TAG = re.compile(
    rf"""<(?:
      !--(?:-?>|(?P<comment>)(?s:.*?)(?:--!?>|\Z))      # a comment, also a page that ends in one
    | [!?][^>]*+(?:>|\Z)                                # a declaration
    | /(?P<end>[a-zA-Z][^\s/>]*+)(?:[\s/]++|{_ATTRIBUTE})*+(?:>|\Z)
    | /(?![a-zA-Z])[^>]++(?:>|\Z) | /> 
    | (?P<start>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[\s/]++|{_ATTRIBUTE})*+)(?P<closed>>)?
    )""",
    re.X,
)
_PAIR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|((?!["'])[^\s>]++))?)?""")
#: Elements whose contents are no markup; those of the second line are text all the same.
RAW_ELEMENTS = frozenset("script style xmp iframe noembed noframes".split())
TEXT_ELEMENTS = frozenset("title textarea".split())
#: Elements without contents.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
_ENDS: dict[str, re.Pattern] = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in RAW_ELEMENTS | TEXT_ELEMENTS}


def tokens(page: str) -> Iterator[tuple[int, str, str]]:
    """(TEXT, text, ""), (START, name, attributes), (END, name, "") and (RAW, name, contents) in order."""
    at, done, size = 0, 0, len(page)
    find, match = page.find, _TAG.match
    while (at := find("<", at)) >= 0:
        tag = match(page, at)
        if tag is None:  # a bare less-than sign
            at += 1
            continue
        if at > done:
            yield TEXT, entities.unescape(page[done:at]), ""
        at = done = tag.end()
        if name := tag["start"]:
            if tag["closed"] is None:  # the page ends inside the tag
                return
            name = name.lower()
            yield START, name, tag["attributes"]
            if (end := _ENDS.get(name)) is not None:
                stop = end.search(page, at)
                at = done = stop.start() if stop else size
                if name in RAW_ELEMENTS:
                    yield RAW, name, page[tag.end() : at]
                elif at > tag.end():
                    yield TEXT, entities.unescape(page[tag.end() : at]), ""
        elif name := tag["end"]:
            yield END, name.lower(), ""
    if done < size:
        yield TEXT, entities.unescape(page[done:]), ""


def attributes(given: str) -> dict[str, str]:
    """The attributes of a start tag, the first of a name; values are decoded."""
    out: dict[str, str] = {}
    for name, *values in _PAIR.findall(given):
        value = next(filter(None, values), "")
        out.setdefault(name.lower(), entities.unescape(value) if "&" in value else value)
    return out


def lines(page: str) -> list[str]:
    """The text of a page by blocks and line breaks, single-spaced; scripts, styles and the head are left out."""
    out, line, hidden = [], [], 0
    for kind, name, _ in tokens(page):
        if kind == TEXT:
            if not hidden:
                line.append(name)
        elif kind != RAW:
            if name in ("head", "template"):
                hidden = max(0, hidden + (1 if kind == START else -1))
            elif name == "body":  # a head that was never closed
                hidden = 0
            if name in BLOCKS or name in ("br", "break"):  # the second is no tag of HTML, but is sent
                out.append(line)
                line = []
    return [text for text in (" ".join("".join(x).split()) for x in [*out, line]) if text]


def page_text(html: Column) -> Column:
    """The lines of a page as one text; a null page has none."""

    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else "\n".join(lines(p)) for p in pages], dtype=object)

    return F.pandas_udf(run, "string")(html)
