"""Queries of this subpackage over the tables of a data folder."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import encode, leakage, mainbody, nearpairs, pieces, quality, residue, sentences, sitelines
from lexloom.sources.tables import table


def clauses(spark: SparkSession, base: str) -> DataFrame:
    """tbl, row_id, text of the clauses that have a text."""
    return table(spark, base, "clause_analysis").where(F.length("source_text") > 0).select(F.lit("clause_analysis").alias("tbl"), "row_id", F.col("source_text").alias("text"))


def scrapes(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "firecrawl_scrape").where(F.length("content") > 0).select(F.lit("firecrawl_scrape").alias("tbl"), F.col("scrape_id").alias("row_id"), F.col("content").alias("text"))


def requests(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "agent1_request").where(F.length("browser_page_text") > 0).select(F.lit("agent1_request").alias("tbl"), F.col("request_id").alias("row_id"), F.col("browser_page_text").alias("text"))


def common_words(spark: SparkSession, base: str) -> frozenset[str]:
    """The word list: a table of a few hundred words, the same at every scale."""
    return frozenset(r.word for r in table(spark, base, "common_word").select("word").where("word is not null").distinct().collect())


def p1_found(spark, base):
    cut = pieces.pieces(mainbody.pages(spark, base), "text", ["tbl", "row_id"])
    return cut.where("n_pieces > 1 and piece_no = 1").select("tbl", "row_id")


def p1_pieces(spark, base):
    return pieces.pieces(mainbody.pages(spark, base), "text", ["tbl", "row_id"])


def p2_found(spark, base):
    return sitelines.repeated_lines(table(spark, base, "firecrawl_scrape")).select("scrape_id", "line_no")


def p2_cleaned(spark, base):
    return sitelines.cleaned(table(spark, base, "firecrawl_scrape"))


def p2_report(spark, base):
    return sitelines.line_report(table(spark, base, "firecrawl_scrape"))


def p3_found(spark, base):
    return mainbody.chrome_lines(mainbody.pages(spark, base))


def p3_main(spark, base):
    return mainbody.main_bodies(mainbody.pages(spark, base))


def p4_found(spark, base):
    return residue.residue(mainbody.pages(spark, base)).select("tbl", "row_id")


def p4_labels(spark, base):
    return residue.residue(mainbody.pages(spark, base))


def p5_statistics(spark, base):
    words = common_words(spark, base)
    named = residue.residue(mainbody.pages(spark, base)).where("tbl = 'agent1_request'").select("tbl", "row_id")
    pages = quality.without(quality.quality(requests(spark, base), words, True), named)
    return pages.unionByName(quality.quality(clauses(spark, base), words, False))


def p5_found(spark, base):
    return p5_statistics(spark, base).where("kind in ('list', 'table', 'junk')").select("tbl", "row_id")


def p6_found(spark, base):
    return nearpairs.pairs(clauses(spark, base).unionByName(scrapes(spark, base)))


def p6_links(spark, base):
    return nearpairs.links(clauses(spark, base).unionByName(scrapes(spark, base)))


def p7_ids(spark, base):
    return encode.encoded(table(spark, base, "documents"), "text", "doc_id")


def p7_offsets(spark, base):
    return encode.slice_offsets(table(spark, base, "documents"), "text", "doc_id")


def p8_found(spark, base):
    return leakage.leaks(table(spark, base, "documents"), table(spark, base, "benchmark")).select("doc_id", "item_id")


def p8_matches(spark, base):
    return leakage.matches(table(spark, base, "documents"), table(spark, base, "benchmark"))


def p8_clean(spark, base):
    return leakage.clean_ids(table(spark, base, "documents"), table(spark, base, "benchmark"))


def p9_found(spark, base):
    return sentences.sentence_spans(table(spark, base, "documents"), "text", "doc_id")


QUERIES = {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}

#: DuckDB on the same tables, where SQL can say it.
SQL = {
    "p1_found": """
        SELECT 'firecrawl_scrape' AS tbl, scrape_id AS row_id FROM firecrawl_scrape WHERE length(content) > 9000
        UNION ALL SELECT 'agent1_request', request_id FROM agent1_request WHERE length(browser_page_text) > 9000
    """,
    "p2_found": r"""
        WITH pages AS (
            SELECT scrape_id, regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', '') AS site, string_split(content, chr(10)) AS lines
            FROM firecrawl_scrape WHERE url IS NOT NULL AND length(content) > 0),
        each AS (
            SELECT scrape_id, site, unnest(range(1, len(lines) + 1)) AS line_no, regexp_replace(lower(unnest(lines)), '[^\p{L}\p{N}]+', '', 'g') AS k
            FROM pages WHERE site <> ''),
        often AS (SELECT site, k FROM each WHERE k <> '' GROUP BY site, k HAVING count(DISTINCT scrape_id) >= 8)
        SELECT scrape_id, CAST(line_no AS INTEGER) AS line_no FROM each JOIN often USING (site, k)
    """,
    "p8_clean": None,
}
SQL = {k: v for k, v in SQL.items() if v}
