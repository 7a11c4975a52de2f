"""Text and links of HTML, as column expressions where regular expressions can say it."""

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import text as t

_ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
_HIDDEN = ("script", "style", "noscript")
_BLOCKS = "p|div|section|article|main|h[1-6]|li|br|tr"


def html_to_text(html: Column) -> Column:
    """A page's text: scripts and styles dropped, a line for each block, other tags spaces, the common entities decoded, cleaned. Null stays null."""
    out = html
    for name in _HIDDEN:
        out = F.regexp_replace(out, rf"(?is)<{name}\b[^>]*>.*?</{name}>", " ")
    out = F.regexp_replace(F.regexp_replace(out, rf"(?i)</?(?:{_BLOCKS})\b[^>]*>", "\n"), r"<[^>]+>", " ")
    for entity, by in _ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(by))
    return t.cleaned(out)


def anchors(html: Column) -> Column:
    """An array of (href, label) of the links of a page, in order; labels without tags, collapsed. Null gives null."""
    pattern = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("label"))
    return F.transform(pairs, lambda x: F.struct(F.trim(x["href"]).alias("href"), t.collapsed(F.regexp_replace(x["label"], r"<[^>]+>", " ")).alias("label")))


class _Main(HTMLParser):
    """Text of the tree without navigation, consent boxes and the like, kept apart for main, article and the whole."""

    dropped, void = frozenset("script style noscript svg template nav header footer form".split()), frozenset("area base br col embed hr img input link meta source track wbr".split())
    marks = ("cookie", "consent", "banner", "modal", "popup")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.parts = [], {"main": [], "article": [], "": []}

    def handle_starttag(self, tag, attrs):
        if tag in self.void:
            self._say("\n")
            return
        named = " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower()
        gone = tag in self.dropped or any(x in named for x in self.marks)
        self.open.append((tag, gone or bool(self.open and self.open[-1][1]), {tag} | (self.open[-1][2] if self.open else set())))
        self._say("\n")

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break
        self._say("\n")

    def handle_data(self, data):
        self._say(data)

    def _say(self, data):
        if self.open and self.open[-1][1]:
            return
        self.parts[""].append(data)
        for name in ("main", "article"):
            if self.open and name in self.open[-1][2]:
                self.parts[name].append(data)


def main_content(html: str | None) -> str | None:
    """The text of a page's main element, else of its article, else of all of it, without navigation, headers, footers, forms
    and what is named a cookie, consent, banner, modal or popup box; one line a block, blank lines dropped. Null stays null."""
    if html is None:
        return None
    parser = _Main()
    parser.feed(html)
    parser.close()
    for name in ("main", "article", ""):
        lines = [" ".join(x.split()) for x in "".join(parser.parts[name]).split("\n")]
        if any(lines):
            return "\n".join(x for x in lines if x)
    return ""


@F.pandas_udf(T.StringType())
def _main_content(pages: pd.Series) -> pd.Series:
    return pages.map(main_content)


def html_main_text(html: Column) -> Column:
    """``main_content`` over Arrow batches: a tree of tags has no built-in."""
    return _main_content(html)
