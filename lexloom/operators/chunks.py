"""Chunks of long texts, their relevance, and which are taken."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import count_of
from lexloom.operators.lexicon import POLICY, Lexicon

SIZE, OVERLAP = 9000, 300


def chunked(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Pieces of up to ``size`` characters. A piece ends before its last blank line if that lies past 55 % of the size, else
    after its last sentence if past 65 %; the next begins ``overlap`` characters earlier, or where the first word after
    that place begins. A text of several pieces ends with one of at most ``overlap`` characters that repeats the end of the
    one before. A text within the size is one piece, as it is."""
    out, start, length = [], 0, len(text)
    if length <= size:
        return [text] if text else []
    while start < length:
        end = min(start + size, length)
        if end < length:
            blank, stop = text.rfind("\n\n", start, end), text.rfind(". ", start, end)
            if blank > start + 0.55 * size:
                end = blank
            elif stop > start + 0.65 * size:
                end = stop + 1
        piece = text[start:end].strip()
        if piece:
            out.append(piece)
        follow = end - overlap
        if follow <= start:
            start = end
            continue
        while follow < length and text[follow - 1].isalnum() and text[follow].isalnum():
            follow += 1
        while follow < length and not text[follow].isspace() and not text[follow].isalnum():
            follow += 1
        while follow < length and text[follow].isspace():
            follow += 1
        start = min(follow, end)  # a word that goes on past the piece is cut, so that nothing is lost
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _chunks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: chunked(t) if t else [])


def chunks(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, chunk_index (from 0), chunk: texts within the size stay in the JVM."""
    base = df.where(F.length(text) > 0).select(*keys, F.col(text).alias("_t"))
    short = base.where(F.length("_t") <= SIZE).select(*keys, F.lit(0).alias("chunk_index"), F.regexp_replace("_t", r"(?U)^\s+|\s+$", "").alias("chunk")).where("chunk != ''")
    long = base.where(F.length("_t") > SIZE).select(*keys, F.posexplode(_chunks("_t")).alias("chunk_index", "chunk"))
    return short.unionByName(long)


#: A heading, as the reference sees it: a line with '#', or capitals up to a colon. White space as in Python.
_HEADING = r"(?U)(?:^|\n)[\s\x1c-\x1f]{0,3}(?:#+[\s\x1c-\x1f]+|[A-Z][A-Z\s\x1c-\x1f]{4,80}:)"


def with_relevance(df: DataFrame, text: str, lexicon: Lexicon = POLICY) -> DataFrame:
    """``df`` and relevance: occurrences of the relevance terms, at most 4 of each, and headings, at most 6, less one for each
    shop term, at least 0; null for a null text. The text is lower-cased and collapsed once, not once a term."""
    low = df.withColumn("_low", F.explode(F.array(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))))
    score = F.least(F.regexp_count(text, F.lit(_HEADING)), F.lit(6))
    for term in lexicon.relevance:
        score = score + F.least(count_of(F.col("_low"), term), F.lit(4))
    for term in lexicon.shop:
        score = score - F.contains("_low", F.lit(term)).cast("int")
    return low.withColumn("relevance", F.greatest(score, F.lit(0))).drop("_low")


def selected(df: DataFrame, group: list[str], document: list[str], order: list[Column], each: int = 4, total: int = 12) -> DataFrame:
    """Of each group the ``total`` best rows, at most ``each`` of a document first, then the rest in order; ``rank`` from 1."""
    inner = Window.partitionBy(*group, *document).orderBy(*order)
    ranked = df.withColumn("_n", F.row_number().over(inner)).where(F.col("_n") <= total)  # more of a document can never be taken
    outer = Window.partitionBy(*group).orderBy(F.col("_n") > each, *order)
    return ranked.withColumn("rank", F.row_number().over(outer)).where(F.col("rank") <= total).drop("_n")
