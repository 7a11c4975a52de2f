"""Text normal forms as column expressions."""

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def collapsed(text: Column) -> Column:
    """White space (Unicode) single, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def fingerprint(text: Column) -> Column:
    """SHA-256 of the lower-cased, collapsed text; null stays null."""
    return F.sha2(collapsed(F.lower(text)), 256)


def cleaned(text: Column) -> Column:
    """Markdown images made spaces; blank lines in a row one; runs of spaces and tabs single; no white space at the ends."""
    out = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]+\)", " ")
    for pattern, by in ((r"(?U)\n\s*\n+", "\n\n"), (r"[ \t]+", " "), (r"(?U)^\s+|\s+\z", "")):
        out = F.regexp_replace(out, pattern, by)
    return out


def squeezed(text: Column) -> Column:
    """No-break spaces made spaces, line ends ``\\n``, runs of spaces single, no more than one blank line in a row."""
    out = F.translate(text, "\u00a0", " ")
    for pattern, by in ((r"\r\n?", "\n"), (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+\z", "")):
        out = F.regexp_replace(out, pattern, by)
    return out


def lines_squeezed(text: Column) -> Column:
    """Each line collapsed, empty lines dropped."""
    return F.array_join(F.filter(F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), collapsed), lambda x: x != ""), "\n")


def undated(text: Column) -> Column:
    """Lower-cased and collapsed, without dates of update and what follows them up to the next mark: what near-duplicate documents are compared by."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)\s+", " "), r"\b(?:last updated|effective date|revision date) ?[:-]? ?[a-z0-9, /.-]+", " "), "^ +| +$", "")


#: Characters that stand for others in comparisons: quotation marks, dashes, the ellipsis, spaces. Fixed values.
_QUOTES, _DOUBLE, _DASHES, _NOTHING = "\u2018\u2019\u201a\u201b", "\u201c\u201d\u201e\u201f\u00ab\u00bb", "\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "\u200b\u200c\u200d\u2060\ufeff"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&#x27;", "'"), ("&rsquo;", "\u2019"), ("&lsquo;", "\u2018"), ("&rdquo;", "\u201d"), ("&ldquo;", "\u201c"), ("&ndash;", "\u2013"), ("&mdash;", "\u2014"), ("&hellip;", "\u2026"), ("&amp;", "&"))


def unescaped(text: Column) -> Column:
    """The common HTML entities decoded; ``&amp;`` last, so nothing is decoded twice."""
    for entity, by in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(by))
    return text


def _closed_up(text: Column) -> Column:
    """No space before closing marks and after opening brackets."""
    for pattern, by in ((r" ([,.;:!?)\]}])", "$1"), (r"([(\[{]) ", "$1")):
        text = F.regexp_replace(text, pattern, by)
    return text


def dedupe_form(text: Column) -> Column:
    """What clauses are compared by: entities decoded, NFKC, invisible characters and the marks ``* _ ` `` dropped, quotation
    marks and dashes made plain, white space single and closed up around marks, lower case."""
    out = F.translate(nfkc(unescaped(text)), _QUOTES + _DOUBLE + _DASHES + _NOTHING + "`*_", "'" * len(_QUOTES) + '"' * len(_DOUBLE) + "-" * len(_DASHES))
    return F.lower(_closed_up(collapsed(F.replace(out, F.lit("\u2026"), F.lit("...")))))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility form of Unicode; only texts that are not ASCII leave the JVM's hands changed."""
    return _nfkc(text)


def grounding_form(text: Column) -> Column:
    """What an excerpt is looked for by: entities decoded, invisible characters and soft hyphens dropped, quotation marks and
    dashes made plain, white space single, closed up around marks and hyphens, lower case."""
    out = F.translate(unescaped(text), "\u2018\u2019\u201a\u201b\u2032" + "\u201c\u201d\u201e\u201f\u2033" + _DASHES + "\u00a0\u2007\u202f" + _NOTHING + "\u00ad", "'" * 5 + '"' * 5 + "-" * len(_DASHES) + "   ")
    return F.regexp_replace(_closed_up(F.lower(collapsed(out))), r" ?- ?", "-")


def classifier_form(text: Column) -> Column:
    """Lower case, en and em dashes made hyphens, white space single."""
    return collapsed(F.translate(F.lower(text), "\u2013\u2014", "--"))


def grounded(source: Column, excerpt: Column) -> Column:
    """Whether an excerpt of at least 20 characters stands in a source, in their grounding forms; an excerpt with ellipses also if
    its parts, two or more of at least 12 characters each, stand there in order. Null counts as not."""
    s, e = grounding_form(source), grounding_form(excerpt)
    parts = F.filter(F.transform(F.split(e, r"\.{3,}|\u2026"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce((F.length(e) >= 20) & ((F.instr(s, e) > 0) | ((F.size(parts) >= 2) & _in_order(parts, s))), F.lit(False))


def _in_order(parts: Column, source: Column) -> Column:
    """Whether all of ``parts`` (of at least 12 characters each) stand in ``source``, one after the other."""
    rest = F.aggregate(parts, source, lambda left, x: F.when((F.length(x) >= 12) & (F.instr(left, x) > 0), F.substring(left, F.instr(left, x) + F.length(x), F.length(left))))
    return rest.isNotNull()


def first_sentence(text: Column, least: int = 40, most: int = 500) -> Column:
    """The first sentence of at least ``least`` characters, cut at ``most``; else the text's start."""
    parts = F.filter(F.split(collapsed(text), r"(?<=[.!?])\s+"), lambda x: F.length(x) >= least)
    return F.substring(F.coalesce(F.get(parts, F.lit(0)), collapsed(text)), 1, most)


def hits(low: Column, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases stand in a lower-cased text; null counts as none."""
    return sum((F.coalesce(F.contains(low, F.lit(x)), F.lit(False)).cast("int") for x in phrases[1:]), F.coalesce(F.contains(low, F.lit(phrases[0])), F.lit(False)).cast("int"))


def has_any(low: Column, phrases: tuple[str, ...]) -> Column:
    """Whether any of the phrases stands in a lower-cased text; one pass of one alternation."""
    return F.coalesce(low.rlike("|".join(re.escape(x) for x in phrases)), F.lit(False))


def has_word(low: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words or phrases stands alone in a lower-cased text: no letter or digit (ASCII) before or after it."""
    return F.coalesce(low.rlike("(?<![a-z0-9])(?:" + "|".join(re.escape(x) for x in words) + ")(?![a-z0-9])"), F.lit(False))


def count_of(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def salvaged_json(raw: Column) -> Column:
    """The JSON of a model's answer: without code fences, from the first brace or bracket to the last, without trailing commas."""
    bare = F.regexp_replace(raw, r"```(?:json)?", "")
    sliced = F.regexp_extract(bare, r"(?s)([\[{].*[\]}])", 1)
    return F.nullif(F.regexp_replace(sliced, r",(\s*[\]}])", "$1"), F.lit(""))


def listed_or_single(many: Column, one: Column) -> Column:
    """``listed`` of the array, or, where that is null, of the one string."""
    return listed(F.coalesce(many, F.when(one.isNotNull(), F.array(one))))


def listed(value: Column) -> Column:
    """Cleaned, non-empty entries of an array of strings; null gives an empty array."""
    return F.coalesce(F.filter(F.transform(value, collapsed), lambda x: x != ""), F.array().cast("array<string>"))
