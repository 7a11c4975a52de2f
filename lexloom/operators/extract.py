"""Clauses and evidence taken out of texts by rule: sections, matches, excerpts with whole sentences, stable ids."""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import text as t
from lexloom.functions import urls
from lexloom.operators import classify, filters
from lexloom.operators.lexicon import POLICY, Lexicon

LEAST_TEXT, LEAST_EXCERPT, LONGEST_EXCERPT, MOST_CLAUSES = 220, 40, 1200, 20
BACK, BACK_EVIDENCE, AHEAD, LEAST_GROUNDED = 250, 200, 350, 20
#: A section begins after a blank line, or on a new line before a number, capitals up to a colon, a heading or "Section n".
SECTION = r"\n\s*\n|\n(?=\s*(?:[0-9]+[.)]|[A-Z\s]{3,}:|#+\s+|Section\s+[0-9]+))"
#: Words that go on with a sentence begun before; an excerpt at the start of a source that begins with one is no whole sentence. Fixed values.
CONNECTORS = frozenset("or and but nor for yet so including such as well fitness merchantability non-infringement implied express uninterrupted unlimited indirect incidental consequential punitive special".split())


def sections(df: DataFrame, keys: list[str], text: str, least: int = LEAST_EXCERPT) -> DataFrame:
    """``keys``, section_no (from 0, over all sections), section (collapsed) of at least ``least`` characters; null and empty texts have none."""
    parts = df.where(F.length(text) > 0).select(*keys, F.posexplode(F.split(text, SECTION)).alias("section_no", "section"))
    return parts.select(*keys, "section_no", t.collapsed(F.col("section")).alias("section")).where(F.length("section") >= least)


def matches(df: DataFrame, keys: list[str], text: str, lexicon: Lexicon = POLICY) -> DataFrame:
    """``keys``, ``text``, rule_no, title, category, at (from 1), size: the first place of each rule's first pattern that hits in ``text`` (collapsed).

    The rules are columns of one pass over a text, not rows of a join; a text that no rule hits has no rows."""
    low = F.col("_low")
    rules = []
    for k, (title, category, patterns) in enumerate(lexicon.rules):
        hit = F.coalesce(*(F.when(low.rlike(p), F.lit(p)) for p in patterns))
        rules.append(F.when(classify.possible(low, title, lexicon) & hit.isNotNull(), F.struct(F.lit(k).alias("rule_no"), F.lit(title).alias("title"), F.lit(category).alias("category"), hit.alias("pattern"))))
    base = df.withColumn("_low", F.explode(F.array(F.lower(text))))
    each = base.select(*keys, text, "_low", F.explode(F.array_compact(F.array(*rules))).alias("m"))
    found = each.select(*keys, text, "_low", "m.*").withColumn("hit", F.regexp_substr("_low", F.col("pattern")))
    return found.select(*keys, text, "rule_no", "title", "category", F.instr(F.col("_low"), F.col("hit")).alias("at"), F.length("hit").alias("size"))


def excerpt(text: Column, at: Column, size: Column, back: int = BACK, ahead: int = AHEAD) -> Column:
    """The sentence or sentences around a match: from after the last end of a sentence in the ``back`` characters before it to
    the first end in the ``ahead`` characters after it, else as far as these reach. ``text`` is collapsed, ``at`` counts from 1."""
    start = F.greatest(at - back, F.lit(1))
    before = F.substring(text, start, at - start)
    cut = F.length(F.regexp_extract(before, r"(?s)^(.*[.!?]\s+)", 1))
    after = F.substring(text, at + size, F.lit(ahead))
    rest = F.regexp_extract(after, r"(?s)^(.*?[.!?])(?:\s|$)", 1)
    tail = F.when(rest == "", F.length(after)).otherwise(F.length(rest))
    return F.trim(F.substring(text, start + cut, at + size + tail - start - cut))


def clause_id(title: Column, category: Column, source: Column) -> Column:
    """A stable id: ``clause-`` and 16 hex digits of the SHA-256 of the three."""
    return F.concat(F.lit("clause-"), F.substring(F.sha2(F.concat_ws("|", title, category, source), 256), 1, 16))


def evidence(chunks: DataFrame, lexicon: Lexicon = POLICY) -> DataFrame:
    """document_url, chunk_index, clause_id, title, category, source_text: what the rules find in chunks (document_url, chunk_index, chunk).

    An excerpt that two rules of a category give in a chunk counts once, for the first rule."""
    flat = chunks.select("document_url", "chunk_index", F.explode(F.array(t.collapsed(F.col("chunk")))).alias("flat")).where("flat != ''")
    found = matches(flat, ["document_url", "chunk_index"], "flat", lexicon)
    cut = found.select("document_url", "chunk_index", "rule_no", "title", "category", excerpt(F.col("flat"), F.col("at"), F.col("size"), BACK_EVIDENCE).alias("source_text")).where(F.length("source_text") >= LEAST_EXCERPT)
    doc = F.coalesce(urls.canonical_with_query(F.col("document_url")), F.lit(""))
    words = F.trim(F.regexp_replace(F.lower("source_text"), r"(?U)\W+", " "))
    keyed = cut.withColumn("_doc", doc).withColumn("_words", words)
    first = Window.partitionBy("_doc", "chunk_index", "category", "_words").orderBy("rule_no", "document_url")
    name = F.concat(F.lit("risk-"), F.substring(F.sha2(F.concat_ws("|", "_doc", F.col("chunk_index").cast("string"), "category", "_words"), 256), 1, 16))
    once = keyed.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return once.select("document_url", "chunk_index", name.alias("clause_id"), "title", "category", F.substring("source_text", 1, LONGEST_EXCERPT).alias("source_text"))


def clauses(df: DataFrame, key: str, text: str, lexicon: Lexicon = POLICY) -> DataFrame:
    """``key``, clause_id, title, category, summary, source_text, n (order): clauses of texts of at least LEAST_TEXT characters, by rule.

    Sections of a text first, each a clause of every rule that it hits, then sentences around matches in the whole text.
    Of clauses of a category with the same first 100 characters the first stays, the first MOST_CLAUSES of a text count, and
    those that state no provision are left out. Excerpts keep whole sentences (``repaired``)."""
    base = df.where(F.length(F.trim(text)) >= LEAST_TEXT).select(key, F.col(text).alias("source"))
    by_section = matches(sections(base, [key], "source"), [key, "section_no"], "section", lexicon).select(key, "section_no", "rule_no", "title", "category", F.lit(False).alias("whole"), F.col("section").alias("cut"))
    flat = base.select(key, F.explode(F.array(t.collapsed(F.col("source")))).alias("flat"))
    whole = matches(flat, [key], "flat", lexicon).select(key, F.lit(None).cast("int").alias("section_no"), "rule_no", "title", "category", F.lit(True).alias("whole"), excerpt(F.col("flat"), F.col("at"), F.col("size")).alias("cut"))
    found = by_section.unionByName(whole)
    # a text meets its excerpts once; a text has at most one for each rule and section
    cuts = found.groupBy(key, "whole").agg(F.collect_set("cut").alias("cuts")).join(base, key)
    held = cuts.withColumn("source", F.when(F.col("whole"), t.collapsed(F.col("source"))).otherwise(F.col("source")))
    fixed = held.select(key, "whole", F.explode(F.arrays_zip("cuts", _repaired_all("source", "cuts").alias("fixed"))).alias("f")).select(key, "whole", F.col("f.cuts").alias("cut"), F.col("f.fixed").alias("source_text"))
    both = found.join(fixed, [key, "whole", "cut"]).where(F.length("source_text") >= LEAST_EXCERPT).drop("cut", "whole")
    order = [F.asc_nulls_last("section_no"), F.col("rule_no")]
    same = Window.partitionBy(key, "category", F.lower(F.substring("source_text", 1, 100))).orderBy(*order)
    once = both.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    taken = once.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("n") <= MOST_CLAUSES)
    short = taken.withColumn("source_text", F.substring("source_text", 1, LONGEST_EXCERPT))
    kept = filters.prepared(short, "source_text").where(filters.is_clause(F.col("category")))
    return kept.select(key, clause_id(F.col("title"), F.col("category"), F.col("source_text")).alias("clause_id"), "title", "category", t.first_sentence(F.col("source_text")).alias("summary"), "source_text", "n")


# the boundaries of an excerpt ----------------------------------------------------------------------------------------

_BREAK = re.compile(r"[.!?]\s+|\n+")
_END = re.compile(r"[.!?](?:\s+|$|[\"'])|\n+")
_HEADING = re.compile(r"(?:^|\n)\s*(?:\d+[.)]|[A-Z\s]{3,}:|#+\s+|[A-Z][A-Za-z\s]{2,40}\n)\s*$")


def _flat(text: str) -> tuple[str, list[int]]:
    """A text in lower case with single spaces, and where each of its characters stands in it."""
    out, places = [], []
    for m in re.finditer(r"\S+", text):
        if out:
            out.append(" ")
            places.append(m.start() - 1)
        # a character whose lower case is longer than one stays as it is, so that places hold
        out += [c if len(c.lower()) > 1 else c.lower() for c in m.group()]
        places += range(m.start(), m.end())
    return "".join(out), places


def repair(source: str | None, excerpt: str | None, known: tuple[str, list[int]] | None = None) -> str | None:
    """An excerpt widened to whole words and sentences of its source; ``''`` if the sentence begins before the source does.

    An excerpt that the source does not hold, or that is null or empty, stays as it is; ``known`` is the source's ``_flat``."""
    if not source or not excerpt:
        return excerpt
    flat, places = known or _flat(source)
    wanted = _flat(excerpt)[0]
    at = flat.find(wanted) if wanted else -1
    if at < 0:
        return excerpt
    start, end = places[at], places[at + len(wanted) - 1] + 1
    while start and source[start - 1].isalnum():
        start -= 1
    if not _starts(source, start):
        floor = max(0, start - BACK)
        breaks = [m.end() for m in _BREAK.finditer(source, floor, start)]
        if breaks:
            start = breaks[-1]
            while start < end and source[start].isspace():
                start += 1
        elif not floor:
            start = 0
    while end < len(source) and source[end - 1].isalnum() and source[end].isalnum():
        end += 1
    rest = source[end:].lstrip()
    if end < len(source) and source[end - 1] not in ".!?\n" and rest:
        m = _END.search(source, end, min(len(source), end + AHEAD))
        end = m.end() if m else end
    out = " ".join(source[start:end].split())
    if len(out) < LEAST_GROUNDED:
        return excerpt
    before = source[:start].rstrip()
    if before and before[-1] not in ".!?":
        return ""
    if out[0].islower() or out[0] in ",;)]}":
        return ""
    word = re.match(r"[A-Za-z][A-Za-z-]*", out)
    if not start and word and word.group().lower().rstrip("-") in CONNECTORS:
        return ""
    return out


def _starts(source: str, at: int) -> bool:
    """Whether a sentence or what follows a heading begins at a place."""
    before = source[:at].rstrip()
    return not before or before[-1] in ".!?" or _HEADING.search(source[max(0, at - 200) : at]) is not None


@F.pandas_udf(T.StringType())
def _repaired(sources: pd.Series, excerpts: pd.Series) -> pd.Series:
    return pd.Series([repair(s, e) for s, e in zip(sources, excerpts, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _repaired_all(sources: pd.Series, excerpts: pd.Series) -> pd.Series:
    return pd.Series([(lambda known, s=s: [repair(s, e, known) for e in es])(_flat(s)) for s, es in zip(sources, excerpts, strict=True)], dtype=object)


def repaired(source: str, excerpt: str) -> Column:
    """``repair`` of two columns, over Arrow batches: offsets into a text have no built-in."""
    return _repaired(F.col(source), F.col(excerpt))
