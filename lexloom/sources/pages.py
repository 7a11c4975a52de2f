"""Texts of fetched pages: what a fetch left (markdown, HTML, a PDF's bytes and texts) becomes one text, the best of several sources one page."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import html, text, urls
from lexloom.operators import filters

LEAST_CHARS, MOST_BYTES = 500, 25 * 1024 * 1024
#: Ways a page is fetched, the best first.
METHODS = ("crawl", "static", "dynamic", "reader")


def page_text(markdown: Column, cleaned_html: Column, raw_html: Column) -> Column:
    """The first that is not blank of markdown, text of the cleaned HTML, text of the HTML; cleaned; null where all are."""
    parts = (text.cleaned(markdown), html.html_to_text(cleaned_html), html.html_to_text(raw_html))
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in parts))


def pdf_files(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """path, length, content of the files below ``path`` that are PDFs by their first bytes and have at most ``most`` bytes; larger ones are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where((F.col("length") <= most) & urls.is_pdf_body(F.col("content"))).select("path", "length", "content")


def pdf_text(body: Column, first: Column, second: Column) -> Column:
    """(text, source) of a PDF out of two extractors' texts: the first that can be a document; empty for what is no PDF or has none."""
    one, two = filters.is_pdf_text(first), filters.is_pdf_text(second)
    fine = urls.is_pdf_body(body)
    return F.struct(
        F.coalesce(F.when(fine & one, text.cleaned(first)), F.when(fine & two, text.cleaned(second)), F.lit("")).alias("text"),
        F.when(fine & one, "first").when(fine & two, "second").otherwise("").alias("source"),
    )


def best_source(df: DataFrame, key: str, least: int = LEAST_CHARS) -> DataFrame:
    """Of the rows (``key``, method, text) of each key the one of the best method whose text has ``least`` characters; keys without any are
    absent. Of two rows of a method the longer counts, of equals the first by text; unknown methods come last."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(m) for m in METHODS)), F.col("method")), F.lit(0)), F.lit(len(METHODS) + 1))
    w = Window.partitionBy(key).orderBy(place, F.desc(F.length("text")), "text")
    return df.where(F.length(F.trim("text")) >= least).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
