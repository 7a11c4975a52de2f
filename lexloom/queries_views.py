"""Queries of sources, summaries and what a reader sees; and the same in DuckDB's SQL."""

from pyspark.sql import functions as F

from lexloom.functions import urls
from lexloom.operators import classify, extract, factors, filters, summary
from lexloom.operators import lexicon as lx
from lexloom.queries_rules import _TYPE, _collapsed, _hits, _host, _part, _q
from lexloom.sources import pages
from lexloom.sources.tables import table


def best_sources(spark, base):
    """One text a URL: fetched markdown before what a browser showed."""
    crawled = table(spark, base, "firecrawl_scrape").select(urls.canonical(F.col("url")).alias("link"), F.lit("crawl").alias("method"), F.col("content").alias("text"))
    shown = table(spark, base, "agent1_request").select(urls.canonical(F.col("url")).alias("link"), F.lit("dynamic").alias("method"), F.col("browser_page_text").alias("text"))
    best = pages.best_source(crawled.unionByName(shown).where("link is not null"), "link")
    return best.select("link", "method", F.length("text").alias("n_chars"), F.md5("text").alias("md5"))


def shown_types(spark, base):
    rows = filters.prepared(table(spark, base, "firecrawl_scrape").select("scrape_id", "url", "title", "content", classify.document_type(F.col("type")).alias("type")), "content")
    path_type = classify.type_of_path(F.col("url"))
    return rows.select("scrape_id", path_type.alias("path_type"), classify.coarse_type(F.col("url"), F.col("title")).alias("coarse_type"), filters.is_browser_document(F.col("url"), F.col("type")).alias("is_document"))


def clause_titles(spark, base):
    rows = table(spark, base, "clause_analysis")
    bare = F.when(F.pmod(F.col("row_id"), F.lit(3)) == 0, F.lit(" Untitled ")).otherwise(F.col("title"))
    return rows.select("row_id", summary.display_title(bare, F.col("category"), F.col("source_text")).alias("shown"))


def site_documents(spark, base):
    rows = table(spark, base, "firecrawl_scrape").where("url is not null").select("scrape_id", urls.host(F.col("url")).alias("site"), "url", "content")
    return summary.site_documents(rows, "site", "scrape_id", "url", "content")


def document_summaries(spark, base):
    """By document: the score of the evidence in its clauses' texts, counts and findings of its clauses."""
    rows = table(spark, base, "clause_analysis").where("document_url is not null").select(urls.canonical_with_query(F.col("document_url")).alias("doc"), "row_id", "chunk_index", "title", "risk_reason", "risk_score", "risk_level", "source_text")
    found = extract.evidence(rows.select(F.col("doc").alias("document_url"), "chunk_index", F.col("source_text").alias("chunk")))
    scored = factors.scored(found.select(F.col("document_url").alias("doc"), "clause_id", "title", "source_text"))
    made = summary.summarised(rows, scored, "doc")
    return made.select("doc", "overall_score", "critical", "high", "medium", "low", F.array_join("findings", " | ").alias("findings"))


QUERIES = {f.__name__: f for f in (best_sources, shown_types, clause_titles, site_documents, document_summaries)}

# SQL ------------------------------------------------------------------------------------------------------------------

_HTTP = "coalesce(regexp_matches(trim(url), '^(?i:https?)://[^/?#]+'), false)"
_CANONICAL = f"CASE WHEN {_HTTP} THEN regexp_replace(lower({_part(1)} || '://' || {_part(2)} || {_part(3)}), '/+$', '') END"
_U3 = "regexp_replace(lower(regexp_replace(trim(url), '#.*$', '')), '/+$', '')"
_WORDS = " ".join(f"WHEN contains(lower(source_text), '{w}') THEN {_q(v)}" for w, v in summary.TITLE_WORDS.items())
_LABELS = " ".join(f"WHEN '{k}' THEN {_q(v)}" for k, v in lx.CATEGORY_TITLES.items() if k != "other")
_SHOPS = ", ".join(_q(x) for x in classify.SHOP_PATHS)
_FIRST = f"list_filter(string_split(lower({_part(3)}), '/'), lambda x: x <> '')[1]"
_COMPACT = f"regexp_replace(lower({_part(3)}), '[^a-z0-9]+', '', 'g')"
_URL_TYPE = f"""CASE WHEN regexp_matches({_COMPACT}, 'privacy|dataprotection') THEN 'privacy' WHEN regexp_matches({_COMPACT}, 'cookie') THEN 'cookies' WHEN regexp_matches({_COMPACT}, 'termsandconditions|termsofuse|termsofservice|useragreement|terms$|termsconditions$') THEN 'terms'
    WHEN regexp_matches({_COMPACT}, 'return|refund|cancellation') THEN 'returns' WHEN regexp_matches({_COMPACT}, 'payment|fees') THEN 'payments' WHEN regexp_matches({_COMPACT}, 'promotion|offerterms') THEN 'promotions' WHEN regexp_matches({_COMPACT}, 'legal|disclaimer|agreement|policy$') THEN 'legal' ELSE 'other' END"""
_PATH_TYPE = f"CASE WHEN coalesce({_FIRST} IN ({_SHOPS}), false) OR url IS NULL THEN '' ELSE {_URL_TYPE} END"
_NAMED = "lower(coalesce(url, '') || ' ' || coalesce(title, ''))"

SQL = {
    "best_sources": f"""
        WITH a AS (SELECT {_CANONICAL} AS link, 'crawl' AS method, 1 AS p, content AS t FROM firecrawl_scrape UNION ALL SELECT {_CANONICAL}, 'dynamic', 3, browser_page_text FROM agent1_request)
        SELECT link, method, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS md5 FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY p, length(t) DESC, t) AS k FROM a WHERE link IS NOT NULL AND length(trim(t)) >= 500) WHERE k = 1""",
    "shown_types": f"""
        SELECT scrape_id, {_PATH_TYPE} AS path_type, CASE WHEN contains({_NAMED}, 'privacy') THEN 'privacy' WHEN contains({_NAMED}, 'cookie') THEN 'cookies' WHEN contains({_NAMED}, 'refund') OR contains({_NAMED}, 'return') THEN 'returns'
                WHEN contains({_NAMED}, 'terms') OR contains({_NAMED}, 'conditions') THEN 'terms' ELSE 'legal' END AS coarse_type,
            length(low) >= 500 AND {_PATH_TYPE} = kind AND NOT (length(low) < 5000 AND {_hits(classify.SHOP_SIGNALS)} >= 3) AS is_document
        FROM (SELECT scrape_id, url, title, {_TYPE} AS kind, lower({_collapsed("coalesce(content, '')")}) AS low FROM firecrawl_scrape)""",
    "clause_titles": f"""
        SELECT row_id, CASE WHEN length(c) > 60 THEN rtrim(substring(c, 1, 59)) || '…' ELSE c END AS shown FROM (SELECT row_id, coalesce(CASE WHEN lower(t) NOT IN ({', '.join(_q(x) for x in summary.BLANK_TITLES)}) THEN t END,
            CASE lower(trim(category)) {_LABELS} END, CASE {_WORDS} END, 'Clause') AS c FROM (SELECT *, CASE WHEN row_id % 3 = 0 THEN 'Untitled' ELSE {_collapsed('title')} END AS t FROM clause_analysis))""",
    "site_documents": f"""
        WITH a AS (SELECT scrape_id, {_host()} AS site, {_U3} AS link, substring({_collapsed('lower(content)')}, 1, 5000) AS start FROM firecrawl_scrape WHERE url IS NOT NULL AND length(content) > 0),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, link ORDER BY scrape_id) AS k FROM a) WHERE k = 1), c AS (SELECT * FROM (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY site, start ORDER BY scrape_id) AS j FROM b) WHERE j = 1)
        SELECT site, scrape_id, link AS url, CAST(p AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY scrape_id) AS p FROM c) WHERE p <= 20""",
}
