"""Queries over the tables of a data folder, and the same in DuckDB's SQL where SQL can say it."""

from pyspark.sql import functions as F

from lexloom import queries_rules, queries_texts, queries_views
from lexloom.functions import text, urls
from lexloom.operators import chunks, classify, dedupe, filters, scores
from lexloom.operators.lexicon import CATEGORIES, POLICY
from lexloom.plans import pipeline
from lexloom.sources.tables import table
from lexloom.streaming import runs as store

FLAGSHIP = "run_scores"


def url_forms(spark, base):
    u = F.col("url")
    return table(spark, base, "agent1_request").select(
        "request_id", urls.host(u).alias("host"), urls.canonical(u).alias("canonical"), urls.canonical_with_query(u).alias("with_query"), urls.is_http(u).alias("is_http"), urls.is_pdf(u).alias("is_pdf"), urls.locale_family(u).alias("family")
    )


def host_rollup(spark, base):
    return table(spark, base, "firecrawl_scrape").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n_pages"), F.countDistinct(urls.canonical(F.col("url"))).alias("n_urls"))


def type_counts(spark, base):
    named = table(spark, base, "firecrawl_scrape").select(classify.document_type(F.col("type")).alias("type"), classify.type_of_url(F.col("url")).alias("url_type"))
    return named.groupBy("type", "url_type").agg(F.count("*").alias("n"))


def page_links(spark, base):
    rows = table(spark, base, "agent1_request").select("request_id", "url", F.explode("browser_links").alias("link"))
    target = urls.resolve(F.col("url"), F.col("link.url"))
    each = rows.select("request_id", urls.host(F.col("url")).alias("site"), target.alias("target")).where("target is not null")
    return each.select("request_id", urls.canonical(F.col("target")).alias("target"), urls.same_site(F.col("site"), urls.host(F.col("target"))).alias("same_site")).groupBy("request_id", "target", "same_site").agg(F.count("*").alias("n"))


def page_dedupe(spark, base):
    rows = table(spark, base, "firecrawl_scrape").where(urls.is_http(F.col("url"))).select("scrape_id", urls.canonical(F.col("url")).alias("canonical"), "scraped_at")
    return dedupe.first_by(rows, [F.col("canonical")], [F.asc_nulls_last("scraped_at"), F.col("scrape_id")]).select("canonical", "scrape_id")


def fingerprint_dedupe(spark, base):
    rows = table(spark, base, "firecrawl_scrape").where(F.length("content") > 0).select("scrape_id", text.fingerprint(F.col("content")).alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.min("scrape_id").alias("scrape_id"), F.count("*").alias("n"))


def clause_dedupe(spark, base):
    rows = table(spark, base, "clause_analysis").where(F.length("source_text") > 0)
    keyed = rows.select("row_id", urls.canonical_with_query(F.col("document_url")).alias("doc"), F.lower("document_type").alias("type"), text.fingerprint(F.col("source_text")).alias("fingerprint"))
    return keyed.groupBy("doc", "type", "fingerprint").agg(F.min("row_id").alias("row_id"))


def level_counts(spark, base):
    rows = table(spark, base, "clause_analysis")
    return rows.groupBy("run_id").agg(F.count("*").alias("n"), *(F.count_if(F.lower("risk_level") == x).alias(x) for x in ("critical", "high", "medium", "low")), F.count_if(F.coalesce(classify.level(F.col("risk_score")), F.lit("")) != F.coalesce(F.lower("risk_level"), F.lit(""))).alias("n_off"))


def category_counts(spark, base):
    return table(spark, base, "clause_analysis").groupBy(classify.domain_category(F.col("category")).alias("category")).agg(F.count("*").alias("n"), F.sum("risk_score").alias("sum_score"))


def run_scores(spark, base):
    return pipeline.run_scores(table(spark, base, "clause_analysis"))


def key_findings(spark, base):
    rows = table(spark, base, "clause_analysis").where("run_id is not null and lower(risk_level) in ('high', 'critical')")
    w = F.row_number().over(_by_run())
    top = rows.select("run_id", w.alias("rank"), F.concat(F.coalesce("title", F.lit("")), F.lit(": "), F.coalesce("risk_reason", F.lit(""))).alias("finding"))
    return top.where("rank <= 8")


def _by_run():
    from pyspark.sql import Window

    return Window.partitionBy("run_id").orderBy(F.desc_nulls_last("risk_score"), "row_id")


def batches(spark, base):
    rows = table(spark, base, "clause_analysis").where("run_id is not null").select("run_id", "row_id", "risk_score")
    return rows.select("run_id", "row_id", F.floor((F.row_number().over(_by_run()) - 1) / 10).cast("int").alias("batch"))


def coverage(spark, base):
    rows = table(spark, base, "clause_analysis").where("run_id is not null").groupBy("run_id", "clause_id").agg(F.count("*").alias("n"))
    double = F.sort_array(F.collect_list(F.when(F.col("n") > 1, F.col("clause_id"))))
    return rows.groupBy("run_id").agg(F.sum("n").alias("n_rows"), F.count("clause_id").alias("n_ids"), F.array_join(double, ",").alias("repeated"))


def runs_latest(spark, base):
    return store.latest(table(spark, base, "runs")).select("run_id", "stored_at", "status", "policy_count", "document_count")


def runs_held(spark, base):
    return store.held(table(spark, base, "runs")).select("run_id", "stored_at", "status")


def run_state(spark, base):
    clauses = table(spark, base, "clause_analysis").groupBy("run_id").agg(F.count("*").alias("n_clauses"))
    return store.latest(table(spark, base, "runs")).select("run_id", "status").join(clauses, "run_id", "left").select("run_id", "status", F.coalesce("n_clauses", F.lit(0)).alias("n_clauses"))


def relevance(spark, base):
    rows = table(spark, base, "firecrawl_scrape").where(F.length("content") > 0)
    return chunks.with_relevance(rows.select("scrape_id", "content"), "content").select("scrape_id", "relevance")


def rule_hits(spark, base):
    low = filters.prepared(table(spark, base, "firecrawl_scrape").select("scrape_id", "content"), "content")
    rows = low.select("scrape_id", F.explode(classify.rule_titles(F.col("low"))).alias("title"))
    return rows.groupBy("title").agg(F.count("*").alias("n"), F.min("scrape_id").alias("first_row"))


def first_sentences(spark, base):
    return table(spark, base, "clause_analysis").where(F.length("source_text") > 0).select("row_id", text.first_sentence(F.col("source_text")).alias("sentence"))


def text_forms(spark, base):
    rows, t = table(spark, base, "firecrawl_scrape").where(F.length("content") > 0), F.col("content")
    return rows.select("scrape_id", F.length(text.collapsed(t)).alias("n_collapsed"), F.length(text.cleaned(t)).alias("n_cleaned"), F.md5(text.lines_squeezed(t)).alias("squeezed"), F.length(text.undated(t)).alias("n_undated"))


def chunk_stats(spark, base):
    rows = table(spark, base, "firecrawl_scrape").select("scrape_id", "content")
    return chunks.chunks(rows, ["scrape_id"], "content").select("scrape_id", "chunk_index", F.length("chunk").alias("n_chars"))


def top_chunks(spark, base):
    return pipeline.top_chunks(pipeline.documents(table(spark, base, "firecrawl_scrape")))


def rebind(spark, base):
    from pyspark.sql import Window

    rows = table(spark, base, "clause_analysis").where("run_id is not null").select("run_id", "row_id", "clause_id", F.coalesce("explanation", F.lit("")).alias("answer"))
    placed = rows.withColumn("position", F.row_number().over(Window.partitionBy("run_id").orderBy("row_id")))
    # answers in another order; a third with wrong ids, every seventh missing, every fifth once more
    p = F.col("position")
    told = placed.where(p % 7 != 0).withColumn("clause_id", F.when(p % 3 == 0, F.concat(F.lit("x"), "clause_id")).otherwise(F.col("clause_id")))
    told = told.unionByName(placed.where(p % 5 == 0).withColumn("answer", F.lit("surplus")).withColumn("row_id", -F.col("row_id")))
    mixed = told.withColumn("position", F.row_number().over(Window.partitionBy("run_id").orderBy(F.md5(F.col("row_id").cast("string")))))
    return scores.rebound(placed.drop("answer"), mixed.drop("row_id"), "run_id")


QUERIES = {f.__name__: f for f in (url_forms, host_rollup, type_counts, page_links, page_dedupe, fingerprint_dedupe, clause_dedupe, level_counts, category_counts, run_scores, key_findings, batches, coverage, runs_latest, runs_held, run_state, relevance, rule_hits, first_sentences, text_forms, chunk_stats, top_chunks, rebind)}

# SQL ------------------------------------------------------------------------------------------------------------------


def _part(n: int, url: str = "url") -> str:
    return rf"regexp_extract(trim({url}), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', {n})"


def _host(url: str = "url") -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({_part(2, url)}), '^.*@', ''), ':\d*$', ''), '^www\.', '')"


def _canonical(url: str = "url") -> str:
    return f"CASE WHEN {_http(url)} THEN regexp_replace(lower({_part(1, url)} || '://' || {_part(2, url)} || {_part(3, url)}), '/+$', '') END"


def _http(url: str = "url") -> str:
    return f"coalesce(regexp_matches(trim({url}), '^(?i:https?)://[^/?#]+'), false)"


_QUERY = "regexp_replace(lower(regexp_replace(trim({0}), '#.*$', '')), '/+$', '')"
_WHITE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _collapsed(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '{_WHITE}', ' ', 'g'), '^ | $', '', 'g')"


def _relevance() -> str:
    low = f"regexp_replace(lower(content), '{_WHITE}', ' ', 'g')"
    white = _WHITE[1:-2]
    heading = rf"(?:^|\n)[{white}]{{0,3}}(?:#+[{white}]+|[A-Z][A-Z{white}]{{4,80}}:)"
    plus = " + ".join(f"least((length(t) - length(replace(t, '{x}', ''))) // {len(x)}, 4)" for x in POLICY.relevance)
    minus = "".join(f" - CAST(contains(t, '{x}') AS INTEGER)" for x in POLICY.shop)
    return f"SELECT scrape_id, CAST(greatest({plus}{minus} + least(h, 6), 0) AS INTEGER) AS relevance FROM (SELECT scrape_id, {low} AS t, len(regexp_extract_all(content, '{heading}')) AS h FROM firecrawl_scrape WHERE length(content) > 0)"


def _types() -> str:
    known = POLICY.aliases | {t: t for t in POLICY.types}
    return "coalesce(CASE lower(trim(type)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in known.items()) + " END, 'other')"


def _rules() -> str:
    parts = []
    for title, _, patterns in POLICY.rules:
        hit = " OR ".join(f"regexp_matches(low, '{p}')" for p in patterns)
        parts.append(f"SELECT '{title}' AS title, count(*) AS n, min(scrape_id) AS first_row FROM pages WHERE {hit} HAVING count(*) > 0")
    return f"WITH pages AS (SELECT scrape_id, lower({_collapsed('content')}) AS low FROM firecrawl_scrape WHERE content IS NOT NULL) " + " UNION ALL ".join(parts)


_REBIND = """
    WITH placed AS (SELECT run_id, row_id, clause_id, coalesce(explanation, '') AS answer, row_number() OVER (PARTITION BY run_id ORDER BY row_id) AS position FROM clause_analysis WHERE run_id IS NOT NULL),
    told AS (SELECT run_id, row_id, CASE WHEN position % 3 = 0 THEN 'x' || clause_id ELSE clause_id END AS clause_id, answer FROM placed WHERE position % 7 <> 0
        UNION ALL SELECT run_id, -row_id, clause_id, 'surplus' FROM placed WHERE position % 5 = 0),
    given AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY md5(CAST(row_id AS VARCHAR))) AS at_ FROM told),
    w AS (SELECT *, row_number() OVER (PARTITION BY run_id, clause_id ORDER BY position) AS n FROM placed), g AS (SELECT *, row_number() OVER (PARTITION BY run_id, clause_id ORDER BY at_) AS n FROM given),
    exact AS (SELECT w.run_id, w.position, w.clause_id, g.answer, g.at_ FROM w JOIN g ON w.run_id = g.run_id AND w.clause_id = g.clause_id AND w.n = g.n),
    free AS (SELECT run_id, position, clause_id, row_number() OVER (PARTITION BY run_id ORDER BY position) AS k FROM placed p WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.run_id = p.run_id AND e.position = p.position)),
    spare AS (SELECT run_id, answer, row_number() OVER (PARTITION BY run_id ORDER BY at_) AS k FROM given x WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.run_id = x.run_id AND e.at_ = x.at_))
    SELECT run_id, CAST(position AS INTEGER) AS position, clause_id, answer FROM exact UNION ALL SELECT free.run_id, CAST(position AS INTEGER), clause_id, answer FROM free JOIN spare ON free.run_id = spare.run_id AND free.k = spare.k"""

_LEVEL = "CASE WHEN {0} > 80 THEN 'high' WHEN {0} >= 45 THEN 'medium' WHEN {0} IS NOT NULL THEN 'low' END"
_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY stored_at DESC NULLS LAST, status DESC NULLS LAST, document_count DESC NULLS LAST, policy_count DESC NULLS LAST) AS k FROM runs WHERE run_id IS NOT NULL) WHERE k = 1"
_BY_RUN = "row_number() OVER (PARTITION BY run_id ORDER BY risk_score DESC NULLS LAST, row_id)"

SQL = {
    "url_forms": rf"""
        SELECT request_id, {_host()} AS host, {_canonical()} AS canonical, {_QUERY.format("url")} AS with_query, {_http()} AS is_http,
            coalesce(regexp_matches(lower({_part(3)}), '\.pdf$') OR contains(lower({_part(3)}), '.pdf/'), false) AS is_pdf,
            coalesce(CASE WHEN len(segments) >= 3 AND segments[1] IN ('policy', 'policies') AND regexp_full_match(segments[2], '[a-z]{{2}}') AND {_http()}
                THEN lower({_part(1)}) || '://' || lower({_part(2)}) || '/' || segments[1] || '/' || array_to_string(segments[3:], '/') END, '') AS family
        FROM (SELECT *, list_filter(string_split(lower({_part(3)}), '/'), lambda x: x <> '') AS segments FROM agent1_request)""",
    "host_rollup": f"SELECT {_host()} AS host, count(*) AS n_pages, count(DISTINCT {_canonical()}) AS n_urls FROM firecrawl_scrape GROUP BY 1",
    "type_counts": f"""
        SELECT type, url_type, count(*) AS n FROM (
            SELECT {_types()} AS type, CASE WHEN regexp_matches(c, 'privacy|dataprotection') THEN 'privacy' WHEN regexp_matches(c, 'cookie') THEN 'cookies'
                WHEN regexp_matches(c, 'termsandconditions|termsofuse|termsofservice|useragreement|terms$|termsconditions$') THEN 'terms' WHEN regexp_matches(c, 'return|refund|cancellation') THEN 'returns'
                WHEN regexp_matches(c, 'payment|fees') THEN 'payments' WHEN regexp_matches(c, 'promotion|offerterms') THEN 'promotions' WHEN regexp_matches(c, 'legal|disclaimer|agreement') THEN 'legal'
                WHEN regexp_matches(c, 'policy$') THEN 'legal' ELSE 'other' END AS url_type
            FROM (SELECT type, regexp_replace(lower({_part(3)}), '[^a-z0-9]+', '', 'g') AS c FROM firecrawl_scrape)) GROUP BY ALL""",
    "page_dedupe": f"""
        SELECT canonical, scrape_id FROM (SELECT {_canonical()} AS canonical, scrape_id, row_number() OVER (PARTITION BY {_canonical()} ORDER BY scraped_at NULLS LAST, scrape_id) AS k
            FROM firecrawl_scrape WHERE {_http()}) WHERE k = 1""",
    "fingerprint_dedupe": f"SELECT sha256({_collapsed('lower(content)')}) AS fingerprint, min(scrape_id) AS scrape_id, count(*) AS n FROM firecrawl_scrape WHERE length(content) > 0 GROUP BY 1",
    "clause_dedupe": f"""
        SELECT {_QUERY.format("document_url")} AS doc, lower(document_type) AS type, sha256({_collapsed('lower(source_text)')}) AS fingerprint, min(row_id) AS row_id
        FROM clause_analysis WHERE length(source_text) > 0 GROUP BY ALL""",
    "level_counts": f"""
        SELECT run_id, count(*) AS n, {", ".join(f"count(*) FILTER (lower(risk_level) = '{x}') AS {x}" for x in ("critical", "high", "medium", "low"))},
            count(*) FILTER (coalesce({_LEVEL.format("risk_score")}, '') <> coalesce(lower(risk_level), '')) AS n_off FROM clause_analysis GROUP BY run_id""",
    "category_counts": f"SELECT CASE WHEN c IN ({', '.join(repr(x) for x in CATEGORIES)}) THEN c ELSE 'other' END AS category, count(*) AS n, CAST(sum(risk_score) AS BIGINT) AS sum_score FROM (SELECT regexp_replace(lower(trim(category)), '[\\s-]+', '_', 'g') AS c, risk_score FROM clause_analysis) GROUP BY 1",
    "run_scores": f"""
        WITH once AS (SELECT run_id, row_id, risk_score FROM (SELECT *, row_number() OVER (PARTITION BY run_id, clause_id ORDER BY row_id) AS k FROM clause_analysis WHERE run_id IS NOT NULL) WHERE k = 1),
        best AS (SELECT *, [0.40, 0.25, 0.15, 0.10, 0.10][n] AS w FROM (SELECT *, {_BY_RUN} AS n FROM once) WHERE n <= 5),
        both_ AS (SELECT run_id, CAST(least(100, round_even(coalesce(avg(CASE WHEN risk_score > 0 THEN risk_score END), 0), 0)) AS INTEGER) AS overall_top,
            CAST(round_even(coalesce(sum(risk_score * CAST(w AS DOUBLE)) / sum(CASE WHEN risk_score IS NOT NULL THEN CAST(w AS DOUBLE) END), 0), 0) AS INTEGER) AS overall_weighted FROM best GROUP BY run_id)
        SELECT *, {_LEVEL.format("overall_top")} AS level FROM both_""",
    "key_findings": f"""
        SELECT * FROM (SELECT run_id, CAST({_BY_RUN} AS INTEGER) AS rank, coalesce(title, '') || ': ' || coalesce(risk_reason, '') AS finding
            FROM clause_analysis WHERE run_id IS NOT NULL AND lower(risk_level) IN ('high', 'critical')) WHERE rank <= 8""",
    "batches": f"SELECT run_id, row_id, CAST(({_BY_RUN} - 1) // 10 AS INTEGER) AS batch FROM clause_analysis WHERE run_id IS NOT NULL",
    "coverage": """
        SELECT run_id, CAST(sum(n) AS BIGINT) AS n_rows, count(clause_id) AS n_ids, coalesce(string_agg(CASE WHEN n > 1 THEN clause_id END, ',' ORDER BY clause_id), '') AS repeated
        FROM (SELECT run_id, clause_id, count(*) AS n FROM clause_analysis WHERE run_id IS NOT NULL GROUP BY ALL) GROUP BY run_id""",
    "runs_latest": f"SELECT run_id, stored_at, status, policy_count, document_count FROM ({_LATEST})",
    "runs_held": f"SELECT run_id, stored_at, status FROM ({_LATEST}) WHERE stored_at >= (SELECT max(stored_at) FROM runs) - INTERVAL 3600 SECOND ORDER BY stored_at DESC, run_id LIMIT 100",
    "run_state": f"SELECT run_id, status, coalesce(n_clauses, 0) AS n_clauses FROM ({_LATEST}) LEFT JOIN (SELECT run_id, count(*) AS n_clauses FROM clause_analysis GROUP BY run_id) USING (run_id)",
    "relevance": _relevance(),
    "rule_hits": _rules(),
    "rebind": _REBIND,
}

for _more in (queries_rules, queries_texts, queries_views):
    QUERIES |= _more.QUERIES
    SQL |= _more.SQL
