"""Queries of the text operators: HTML, near copies, extraction, grounding, answers, candidates; and the same in DuckDB's SQL where SQL can say it."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.functions import html, text, urls
from lexloom.operators import answers, classify, dedupe, documents, extract, scores
from lexloom.queries_rules import _CLEANED, _HTTP, _LEVEL, _WHITE, _collapsed, _host, _part, _q
from lexloom.sources.tables import table
from lexloom.streaming import runs as store


def _pages_as_html(spark, base):
    """A page of markup around each text of agent1_request: what fetched pages look like."""
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("browser_page_text", "&", "&amp;"), "<", "&lt;"), r"\r?\n", "</p>\n<p>")
    page = F.concat(F.lit("<html><head><style>p{}</style><SCRIPT type='a'>if (a<b) {}\n</SCRIPT></head><body><nav><a href='/x'>Menu</a></nav><main><p>"), body, F.lit("</p><br/>end&nbsp;&quot;of&quot; page</main><footer>foot</footer></body></html>"))
    return table(spark, base, "agent1_request").where(F.length("browser_page_text") > 0).select("request_id", page.alias("html"))


def html_text(spark, base):
    t = html.html_to_text(F.col("html"))
    return _pages_as_html(spark, base).select("request_id", F.length(t).alias("n_chars"), F.md5(t).alias("md5"))


def html_main(spark, base):
    t = html.html_main_text(F.col("html"))
    return _pages_as_html(spark, base).select("request_id", F.length(t).alias("n_chars"), F.contains(t, F.lit("Menu")).alias("menu"), F.contains(t, F.lit("foot")).alias("foot"), (F.right(t, F.lit(13)) == 'end "of" page').alias("ended"))


def html_anchors(spark, base):
    rows = table(spark, base, "agent1_request").where(F.size("browser_links") > 0)
    link = F.transform("browser_links", lambda x: F.concat(F.lit('<a class="l" HREF="'), F.coalesce(x["url"], F.lit("")), F.lit('"><b>'), F.coalesce(F.regexp_replace(x["text"], r"[<>\r\n]", " "), F.lit("")), F.lit("</b>\n</a>")))
    page = rows.select("request_id", F.array_join(link, " ").alias("html"))
    return page.select("request_id", F.posexplode(html.anchors(F.col("html"))).alias("n", "a")).select("request_id", "n", "a.href", "a.label")


def page_candidates(spark, base):
    """Links of pages first, then pages as fetched: candidates in order of priority, one a URL, without locale copies."""
    links = table(spark, base, "agent1_request").select(F.lit(0).alias("priority"), F.col("request_id").alias("row_id"), "url", F.posexplode("browser_links").alias("n", "link"))
    found = links.select("priority", "row_id", "n", urls.resolve(F.col("url"), F.col("link.url")).alias("url"))
    fetched = table(spark, base, "firecrawl_scrape").select(F.lit(1).alias("priority"), F.col("scrape_id").alias("row_id"), F.lit(0).alias("n"), "url")
    each = found.unionByName(fetched).select("priority", "row_id", "n", urls.canonical(F.col("url")).alias("canonical"), urls.locale_family(F.col("url")).alias("family"), F.col("url").alias("given")).where("canonical is not null")
    first = dedupe.first_by(each, [F.col("canonical")], [F.col("priority"), F.col("row_id"), F.col("n")])
    return dedupe.without_locale_copies(first, "canonical", "family").select("canonical", "priority", "row_id", classify.type_of_url(F.col("given")).alias("type"))


def longest_pages(spark, base):
    """Of pages of one URL the one with the longest content; of equals the first."""
    rows = table(spark, base, "firecrawl_scrape").where(urls.is_http(F.col("url"))).select(urls.canonical_with_query(F.col("url")).alias("link"), "scrape_id", F.coalesce(F.length("content"), F.lit(0)).alias("n_chars"))
    best = rows.groupBy("link").agg(F.max(F.struct("n_chars", (-F.col("scrape_id")).alias("k"))).alias("m"), F.count("*").alias("n"))
    return best.select("link", (-F.col("m.k")).alias("scrape_id"), F.col("m.n_chars").alias("n_chars"), "n")


def near_documents(spark, base):
    rows = table(spark, base, "firecrawl_scrape").where("url is not null").select("scrape_id", urls.host(F.col("url")).alias("site"), "url", "content")
    return documents.deduped(rows, "site", "scrape_id", "url", "content")


def clause_containment(spark, base):
    keyed = documents.clause_keys(table(spark, base, "clause_analysis").select("row_id", "document_url", "document_type", "source_text"), "document_url", "document_type", "source_text")
    once = documents.exact_clauses(keyed, "row_id")
    return documents.uncontained(once, "row_id").select("row_id", "doc", "type")


def clause_order(spark, base):
    order = [F.coalesce(urls.canonical_with_query(F.col("document_url")), F.lit("")), F.coalesce(F.lower("document_type"), F.lit("")), F.coalesce("chunk_index", F.lit(0)), F.coalesce("category", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("clause_id", F.lit("")), F.col("row_id")]
    rows = table(spark, base, "clause_analysis").where("run_id is not null").select("run_id", "row_id", "document_url", "document_type", "chunk_index", "category", "title", "clause_id")
    return rows.select("run_id", "row_id", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)).alias("place"))


def stable_ids(spark, base):
    rows = table(spark, base, "clause_analysis")
    return rows.select("row_id", extract.clause_id(*(F.coalesce(c, F.lit("")) for c in ("title", "category", "source_text"))).alias("stable_id"))


def grounding(spark, base):
    """Each clause's own text, its middle with an ellipsis, and another clause's text, looked for in it."""
    rows = table(spark, base, "clause_analysis").where(F.length("source_text") > 0).select("row_id", "source_text", F.lead("source_text").over(Window.partitionBy("run_id").orderBy("row_id")).alias("other"))
    s = F.col("source_text")
    n = F.length(s)
    cut = F.concat(F.substring(s, 1, (n / 3).cast("int")), F.lit(" ... "), F.substring(s, (n / 2).cast("int"), n))
    swapped = F.concat(F.substring(s, (n / 2).cast("int"), n), F.lit(" ... "), F.substring(s, 1, (n / 3).cast("int")))
    return rows.select("row_id", text.grounded(s, F.replace(s, F.lit(" "), F.lit("  \n"))).alias("own"), text.grounded(s, cut).alias("in_order"), text.grounded(s, swapped).alias("swapped"), text.grounded(s, F.col("other")).alias("other"))


def repaired_excerpts(spark, base):
    """The middle half of each clause, widened to whole words and sentences within it."""
    rows = table(spark, base, "clause_analysis").where(F.length("source_text") >= 80).select("row_id", "source_text", F.substring("source_text", (F.length("source_text") / 4).cast("int"), (F.length("source_text") / 2).cast("int")).alias("excerpt"))
    return rows.select("row_id", extract.repaired("source_text", "excerpt").alias("repaired"))


def page_sections(spark, base):
    return extract.sections(table(spark, base, "firecrawl_scrape"), ["scrape_id"], "content").groupBy("scrape_id").agg(F.count("*").alias("n_sections"), F.sum(F.length("section")).alias("n_chars"))


def page_clauses(spark, base):
    rows = table(spark, base, "firecrawl_scrape").where("url is not null").select("scrape_id", "content")
    return extract.clauses(rows, "scrape_id", "content")


def _answers(spark, base):
    """Raw answers of a model for the clauses of a run: a list in a fence with a comma too many, an object, or prose around single objects."""
    rows = table(spark, base, "clause_analysis").where("run_id is not null and clause_id is not null").select("run_id", "row_id", "clause_id", "title", "category", "risk_level", F.col("risk_score").cast("string").alias("risk_score"), F.substring(F.regexp_replace("summary", r"[{}\[\]]", ""), 1, 60).alias("summary"))
    items = rows.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("row_id", F.to_json(F.struct("clause_id", "title", "category", "risk_level", "risk_score", "summary")).alias("j")))).alias("items"))
    each = F.transform("items", lambda x: x["j"])
    kind = F.pmod(F.crc32("run_id"), F.lit(3))
    raw = F.when(kind == 0, F.concat(F.lit("Here it is:\n```json\n["), F.array_join(each, ",\n"), F.lit(",]\n```\nDone."))).when(kind == 1, F.concat(F.lit('{"analyses": ['), F.array_join(each, ", "), F.lit("]}"))).otherwise(F.concat(F.lit("First [one: "), F.array_join(each, " and then "), F.lit(" that is all")))
    return items.select("run_id", raw.alias("raw"))


def answers_parsed(spark, base):
    found = _answers(spark, base).select("run_id", F.explode(answers.parsed_items(F.col("raw"))).alias("x"))
    return found.groupBy("run_id", F.col("x.clause_id").alias("clause_id"), F.col("x.title").alias("title"), F.col("x.risk_score").alias("risk_score")).agg(F.count("*").alias("n"))


def answer_rows(spark, base):
    rows = table(spark, base, "clause_analysis").where("run_id is not null")
    given = rows.select("run_id", "row_id", "clause_id", "category", F.lit("MODERATE ").alias("risk_level"), F.concat(F.col("risk_score").cast("string"), F.lit("")).alias("risk_score"), "summary", "explanation", F.lit(None).cast("string").alias("user_impact"), F.lit(" ").alias("recommendation"), F.lit(None).cast("string").alias("evidence"))
    found = answers.analyses(given, ["run_id", "row_id"])
    own = rows.select("run_id", F.col("row_id").alias("position"), "clause_id", "category", "risk_level", F.col("risk_score").cast("string").alias("risk_score"))
    return answers.preserved(found, own, "run_id").select("run_id", "row_id", "clause_id", "category", "risk_level", "risk_score", F.md5("summary").alias("summary_md5"), "user_impact", "recommendation")


def explain_inputs(spark, base):
    return answers.inputs(table(spark, base, "clause_analysis")).select("row_id", "run_id", "clause_id", F.md5("text").alias("text_md5"), "title", "category", "risk_score", "risk_level")


def explain_checks(spark, base):
    return answers.complaints(table(spark, base, "clause_analysis"), "run_id")


def stage3_overall(spark, base):
    """A run's stored score and level if it has either (here: every second run), else those over its clauses, on the scale of 10."""
    rows = table(spark, base, "clause_analysis").where("run_id is not null").select("run_id", "row_id", F.coalesce(F.least(F.greatest((F.col("risk_score") / 10).cast("int"), F.lit(0)), F.lit(10)), F.lit(0)).alias("score10"), "risk_score")
    alone = scores.overall(rows, "run_id", "score10", "row_id").select("run_id", F.col("overall_weighted").alias("alone"))
    given = rows.groupBy("run_id").agg(F.max("risk_score").alias("top"))
    both = alone.join(given, "run_id").withColumn("given", F.when(F.substring("run_id", 1, 1).between("0", "7"), F.col("top")))
    score = F.when(F.col("given").isNotNull(), answers.score100(F.col("given").cast("string"))).otherwise(F.col("alone"))
    level = F.when(F.col("given").isNotNull(), classify.level(score)).otherwise(answers.level10(F.lit(None).cast("string"), F.col("alone")))
    return both.select("run_id", score.cast("int").alias("score"), level.alias("level"))


def level_groups(spark, base):
    rows = table(spark, base, "clause_analysis").where("run_id is not null")
    level = F.upper(F.coalesce(answers.named_level(F.col("risk_level")), F.lit("low")))
    shown = F.when(level == "CRITICAL", "HIGH").otherwise(level)
    return rows.groupBy("run_id", shown.alias("level")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("row_id")), lambda x: x.cast("string")), ",").alias("row_ids"), F.round(F.max(-90 + F.coalesce("risk_score", F.lit(0)) * 1.8), 2).alias("angle"))


def list_fields(spark, base):
    rows = table(spark, base, "clause_analysis")
    return rows.select("row_id", F.array_join(text.listed(F.col("obligations")), "|").alias("obligations"), F.size(text.listed_or_single(F.col("permissions"), F.col("risk_reason"))).alias("n_permissions"))


def runs_missing(spark, base):
    return store.missing(store.latest(table(spark, base, "runs")).select("run_id", "status"), table(spark, base, "clause_analysis").where("risk_score is not null"))


QUERIES = {
    f.__name__: f
    for f in (html_text, html_main, html_anchors, page_candidates, longest_pages, near_documents, clause_containment, clause_order, stable_ids, grounding, repaired_excerpts, page_sections, page_clauses, answers_parsed, answer_rows, explain_inputs, explain_checks, stage3_overall, level_groups, list_fields, runs_missing)
}

# SQL ------------------------------------------------------------------------------------------------------------------

_U3 = "regexp_replace(lower(regexp_replace(trim({0}), '#.*$', '')), '/+$', '')"
_NAMED = "CASE lower(trim({0})) WHEN 'moderate' THEN 'medium' WHEN 'low' THEN 'low' WHEN 'medium' THEN 'medium' WHEN 'high' THEN 'high' WHEN 'critical' THEN 'critical' END"
_ANSWER = f"CASE WHEN lower(trim({{0}})) IN ({', '.join(_q(x) for x in answers.ANSWER_CATEGORIES)}) THEN lower(trim({{0}})) ELSE 'other' END"


def _grounded(e: str) -> str:
    parts = rf"list_filter(list_transform(regexp_split_to_array({e}, '\.{{3,}}|…'), lambda x: trim(x)), lambda x: x <> '')"
    rest = f"list_reduce({parts}, lambda y, x: CASE WHEN length(x) >= 12 AND instr(y, x) > 0 THEN substring(y, instr(y, x) + length(x)) END, s)"
    return f"coalesce(length({e}) >= 20 AND (contains(s, {e}) OR (len({parts}) >= 2 AND {rest} IS NOT NULL)), false)"


def _form(t: str) -> str:
    marks = r"regexp_replace(regexp_replace(lower({0}), ' ([,.;:!?)\]}}])', '\1', 'g'), '([(\[{{]) ', '\1', 'g')"
    plain = f"translate({t}, '‘’‚‛′“”„‟″‐‑‒–—―−', '''''''''''\"\"\"\"\"-------')"
    gone = rf"regexp_replace({plain}, '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{2060}}\x{{FEFF}}\x{{AD}}]', '', 'g')"
    return f"regexp_replace({marks.format(_collapsed(gone))}, ' ?- ?', '-', 'g')"


_PLAIN = "translate(nfc_normalize(source_text), '‘’‚‛“”„‟«»‐‑‒–—―−', '''''''''\"\"\"\"\"\"-------')"
_INVISIBLE = r"[`*_]|[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]"
_DOTTED = f"replace(regexp_replace({_PLAIN}, '{_INVISIBLE}', '', 'g'), '…', '...')"
_DEDUPE = rf"lower(regexp_replace(regexp_replace({_collapsed(_DOTTED)}, ' ([,.;:!?)\]}}])', '\1', 'g'), '([(\[{{]) ', '\1', 'g'))"
# a section's mark is set before each place where one begins on a new line, as there is no look-ahead
_SPLIT = r"unnest(regexp_split_to_array(regexp_replace(content, '\n(\s*(?:[0-9]+[.)]|[A-Z\s]{3,}:|#+\s+|Section\s+[0-9]+))', chr(10) || chr(10) || '\1', 'g'), '\n\s*\n'))"
_PAGE = rf"regexp_replace(regexp_replace(regexp_replace(browser_page_text, '&', '&amp;', 'g'), '<', '&lt;', 'g'), '\r?\n', '</p>' || chr(10) || '<p>', 'g')"

# a link made absolute: absolute, //host, /path, ?query, relative to the page's folder
_LINK = "regexp_replace(trim(link_url), '#.*$', '')"
_FOLDER = f"CASE WHEN regexp_replace({_part(3)}, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace({_part(3)}, '[^/]*$', '') END"
_RESOLVED = f"""CASE WHEN {_LINK} = '' OR link_url IS NULL OR NOT {_HTTP} THEN NULL WHEN regexp_matches({_LINK}, '^(?i:https?)://[^/?#]') THEN {_LINK} WHEN regexp_matches({_LINK}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with({_LINK}, '//') THEN {_part(1)} || ':' || {_LINK} WHEN starts_with({_LINK}, '/') THEN {_part(1)} || '://' || {_part(2)} || {_LINK} WHEN starts_with({_LINK}, '?') THEN {_part(1)} || '://' || {_part(2)} || coalesce(nullif({_part(3)}, ''), '/') || {_LINK}
    ELSE {_part(1)} || '://' || {_part(2)} || ({_FOLDER}) || {_LINK} END"""
_CANONICAL = f"CASE WHEN {_HTTP} THEN regexp_replace(lower({_part(1)} || '://' || {_part(2)} || {_part(3)}), '/+$', '') END"
_TARGET = f"CASE WHEN {_HTTP.replace('url', 'target')} THEN regexp_replace(lower({_part(1, 'target')} || '://' || {_part(2, 'target')} || {_part(3, 'target')}), '/+$', '') END"
_COMPACT_T = f"regexp_replace(lower({_part(3, 'target')}), '[^a-z0-9]+', '', 'g')"

# sentences end at a mark before a space; the text is collapsed, so a line break can part them
_SENTENCES = r"list_filter(string_split(regexp_replace(t, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda x: length(x) >= 40)"
_DATED = r"\b(?:last updated|effective date|revision date) ?[:-]? ?[a-z0-9, /.-]+"

SQL = {
    "first_sentences": f"SELECT row_id, substring(coalesce({_SENTENCES}[1], t), 1, 500) AS sentence FROM (SELECT row_id, {_collapsed('source_text')} AS t FROM clause_analysis WHERE length(source_text) > 0)",
    "text_forms": f"""
        WITH a AS (SELECT scrape_id, {_collapsed('content')} AS flat, {_CLEANED} AS clean, list_filter(list_transform(regexp_split_to_array(content, '\\r\\n?|\\n'), lambda x: {_collapsed('x')}), lambda x: x <> '') AS lines, regexp_replace(lower(content), '{_WHITE}', ' ', 'g') AS low FROM firecrawl_scrape WHERE length(content) > 0)
        SELECT scrape_id, CAST(length(flat) AS INTEGER) AS n_collapsed, CAST(length(clean) AS INTEGER) AS n_cleaned, md5(array_to_string(lines, chr(10))) AS squeezed, CAST(length(regexp_replace(regexp_replace(low, '{_DATED}', ' ', 'g'), '^ +| +$', '', 'g')) AS INTEGER) AS n_undated FROM a""",
    "page_links": f"""
        WITH a AS (SELECT request_id, url, unnest(browser_links).url AS link_url FROM agent1_request), b AS (SELECT request_id, {_host()} AS site, {_RESOLVED} AS target FROM a),
        c AS (SELECT request_id, {_TARGET} AS target, site <> '' AND (site = {_host('target')} OR ends_with({_host('target')}, '.' || site)) AS same_site FROM b WHERE target IS NOT NULL)
        SELECT request_id, target, same_site, count(*) AS n FROM c GROUP BY ALL""",
    "page_candidates": f"""
        WITH links AS (SELECT request_id, url, unnest(browser_links).url AS link_url, unnest(range(len(browser_links))) AS n FROM agent1_request),
        each AS (SELECT 0 AS priority, request_id AS row_id, n, {_RESOLVED} AS target FROM links UNION ALL SELECT 1, scrape_id, 0, url FROM firecrawl_scrape),
        named AS (SELECT *, {_TARGET} AS canonical, list_filter(string_split(lower({_part(3, 'target')}), '/'), lambda x: x <> '') AS segments FROM each),
        first_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY priority, row_id, n) AS k FROM named WHERE canonical IS NOT NULL) WHERE k = 1),
        family AS (SELECT *, CASE WHEN len(segments) >= 3 AND segments[1] IN ('policy', 'policies') AND regexp_full_match(segments[2], '[a-z]{{2}}') THEN lower({_part(1, 'target')}) || '://' || lower({_part(2, 'target')}) || '/' || segments[1] || '/' || array_to_string(segments[3:], '/') ELSE '' END AS fam, {_COMPACT_T} AS c FROM first_)
        SELECT canonical, priority, row_id, CASE WHEN regexp_matches(c, 'privacy|dataprotection') THEN 'privacy' WHEN regexp_matches(c, 'cookie') THEN 'cookies'
            WHEN regexp_matches(c, 'termsandconditions|termsofuse|termsofservice|useragreement|terms$|termsconditions$') THEN 'terms' WHEN regexp_matches(c, 'return|refund|cancellation') THEN 'returns'
            WHEN regexp_matches(c, 'payment|fees') THEN 'payments' WHEN regexp_matches(c, 'promotion|offerterms') THEN 'promotions' WHEN regexp_matches(c, 'legal|disclaimer|agreement|policy$') THEN 'legal' ELSE 'other' END AS type
        FROM family f WHERE NOT EXISTS (SELECT 1 FROM first_ o WHERE o.canonical = f.fam)""",
    "stage3_overall": f"""
        WITH a AS (SELECT run_id, row_id, risk_score, coalesce(least(greatest(risk_score // 10, 0), 10), 0) AS s FROM clause_analysis WHERE run_id IS NOT NULL),
        best AS (SELECT *, CAST([0.40, 0.25, 0.15, 0.10, 0.10][n] AS DOUBLE) AS w FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY s DESC, row_id) AS n FROM a) WHERE n <= 5),
        alone AS (SELECT run_id, CAST(round_even(sum(s * w) / sum(w), 0) AS INTEGER) AS alone FROM best GROUP BY run_id), top_ AS (SELECT run_id, max(risk_score) AS top FROM a GROUP BY run_id)
        SELECT run_id, CASE WHEN given IS NOT NULL THEN least(greatest(given, 0), 100) ELSE alone END AS score, CASE WHEN given IS NOT NULL THEN {_LEVEL.format('given')} WHEN alone <= 2 THEN 'low' WHEN alone <= 6 THEN 'medium' WHEN alone <= 8 THEN 'high' ELSE 'critical' END AS level
        FROM (SELECT run_id, alone, CASE WHEN substring(run_id, 1, 1) BETWEEN '0' AND '7' THEN top END AS given FROM alone JOIN top_ USING (run_id))""",
    "html_text": rf"""
        WITH a AS (SELECT request_id, '<html><head><style>p{{}}</style><SCRIPT type=''a''>if (a<b) {{}}' || chr(10) || '</SCRIPT></head><body><nav><a href=''/x''>Menu</a></nav><main><p>' || {_PAGE} || '</p><br/>end&nbsp;&quot;of&quot; page</main><footer>foot</footer></body></html>' AS h FROM agent1_request WHERE length(browser_page_text) > 0),
        b AS (SELECT request_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '<style\b[^>]*>.*?</style>', ' ', 'gis'), '<script\b[^>]*>.*?</script>', ' ', 'gis'), '</?(?:p|div|section|article|main|h[1-6]|li|br|tr)\b[^>]*>', chr(10), 'gi'), '<[^>]+>', ' ', 'g') AS t FROM a),
        c AS (SELECT request_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') AS content FROM b),
        d AS (SELECT request_id, {_CLEANED} AS t FROM c) SELECT request_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS md5 FROM d""",
    "html_anchors": rf"""
        SELECT request_id, CAST(n - 1 AS INTEGER) AS n, trim(coalesce(link.url, '')) AS href, {_collapsed(r"coalesce(regexp_replace(link.text, '[<>\r\n]', ' ', 'g'), '')")} AS label
        FROM (SELECT request_id, unnest(browser_links) AS link, unnest(range(1, len(browser_links) + 1)) AS n FROM agent1_request WHERE len(browser_links) > 0)""",
    "html_main": f"""
        WITH a AS (SELECT request_id, array_to_string(list_append(list_filter(list_transform(regexp_split_to_array(browser_page_text, '\\r?\\n'), lambda x: {_collapsed('x')}), lambda x: x <> ''), 'end "of" page'), chr(10)) AS t FROM agent1_request WHERE length(browser_page_text) > 0)
        SELECT request_id, CAST(length(t) AS INTEGER) AS n_chars, contains(t, 'Menu') AS menu, contains(t, 'foot') AS foot, true AS ended FROM a""",
    "clause_containment": f"""
        WITH a AS (SELECT row_id, coalesce({_U3.format('document_url')}, '') AS doc, coalesce(lower(trim(document_type)), 'legal') AS type, {_DEDUPE} AS form FROM clause_analysis WHERE length(source_text) > 0),
        once AS (SELECT doc, type, form, min(row_id) AS row_id FROM a GROUP BY doc, type, form)
        SELECT row_id, doc, type FROM once x
        WHERE length(form) < 80 OR NOT EXISTS (SELECT 1 FROM once y WHERE y.doc = x.doc AND y.type = x.type AND length(y.form) > length(x.form) AND contains(y.form, x.form))""",
    "longest_pages": f"""
        SELECT link, scrape_id, n_chars, n FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY n_chars DESC, scrape_id) AS k, count(*) OVER (PARTITION BY link) AS n
            FROM (SELECT {_U3.format('url')} AS link, scrape_id, CAST(coalesce(length(content), 0) AS INTEGER) AS n_chars FROM firecrawl_scrape WHERE coalesce(regexp_matches(trim(url), '^(?i:https?)://[^/?#]+'), false))) WHERE k = 1""",
    "clause_order": f"""
        SELECT run_id, row_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY coalesce({_U3.format('document_url')}, ''), coalesce(lower(document_type), ''), coalesce(chunk_index, 0), coalesce(category, ''), coalesce(title, ''), coalesce(clause_id, ''), row_id) AS INTEGER) AS place
        FROM clause_analysis WHERE run_id IS NOT NULL""",
    "stable_ids": "SELECT row_id, 'clause-' || substring(sha256(coalesce(title, '') || '|' || coalesce(category, '') || '|' || coalesce(source_text, '')), 1, 16) AS stable_id FROM clause_analysis",
    "grounding": f"""
        WITH a AS (SELECT row_id, source_text AS x, lead(source_text) OVER (PARTITION BY run_id ORDER BY row_id) AS o, length(source_text) AS n FROM clause_analysis WHERE length(source_text) > 0),
        b AS (SELECT row_id, {_form('x')} AS s, {_form("replace(x, ' ', '  ' || chr(10))")} AS e1, {_form("substring(x, 1, CAST(floor(n / 3) AS INTEGER)) || ' ... ' || substring(x, greatest(CAST(floor(n / 2) AS INTEGER), 1), n)")} AS e2,
            {_form("substring(x, greatest(CAST(floor(n / 2) AS INTEGER), 1), n) || ' ... ' || substring(x, 1, CAST(floor(n / 3) AS INTEGER))")} AS e3, {_form('o')} AS e4 FROM a)
        SELECT row_id, {_grounded('e1')} AS own, {_grounded('e2')} AS in_order, {_grounded('e3')} AS swapped, {_grounded('e4')} AS other FROM b""",
    "page_sections": f"""
        WITH a AS (SELECT scrape_id, {_collapsed(_SPLIT)} AS section FROM firecrawl_scrape WHERE length(content) > 0)
        SELECT scrape_id, count(*) AS n_sections, CAST(sum(length(section)) AS BIGINT) AS n_chars FROM a WHERE length(section) >= 40 GROUP BY 1""",
    "answers_parsed": "SELECT run_id, clause_id, title, CAST(risk_score AS VARCHAR) AS risk_score, count(*) AS n FROM clause_analysis WHERE run_id IS NOT NULL AND clause_id IS NOT NULL GROUP BY ALL",
    "answer_rows": f"""
        WITH rows_ AS (SELECT * FROM clause_analysis WHERE run_id IS NOT NULL), last_ AS (SELECT * FROM (SELECT run_id, clause_id, category, risk_level, risk_score, row_number() OVER (PARTITION BY run_id, clause_id ORDER BY row_id DESC) AS k FROM rows_) WHERE k = 1)
        SELECT r.run_id, r.row_id, trim(r.clause_id) AS clause_id, CASE WHEN (o.risk_score IS NOT NULL OR o.risk_level IS NOT NULL) AND trim(o.category) <> '' THEN {_ANSWER.format('o.category')} ELSE {_ANSWER.format('r.category')} END AS category,
            CASE WHEN o.risk_score IS NOT NULL OR o.risk_level IS NOT NULL THEN coalesce({_NAMED.format('o.risk_level')}, {_LEVEL.format('least(greatest(coalesce(o.risk_score, 0), 0), 100)')}) ELSE 'medium' END AS risk_level,
            CAST(CASE WHEN o.risk_score IS NOT NULL OR o.risk_level IS NOT NULL THEN least(greatest(coalesce(o.risk_score, 0), 0), 100) ELSE least(greatest(coalesce(r.risk_score, 0), 0), 100) END AS INTEGER) AS risk_score,
            md5(coalesce(trim(r.summary), 'No summary provided.')) AS summary_md5, 'No user impact identified.' AS user_impact, '' AS recommendation
        FROM rows_ r LEFT JOIN last_ o ON r.run_id = o.run_id AND trim(r.clause_id) = o.clause_id WHERE trim(r.clause_id) <> ''""",
    "explain_inputs": """
        SELECT row_id, run_id, coalesce(nullif(trim(clause_id), ''), 'clause-' || row_id) AS clause_id, md5(t) AS text_md5, coalesce(nullif(trim(title), ''), 'Untitled clause') AS title, category, risk_score, risk_level
        FROM (SELECT *, coalesce(nullif(trim(source_text), ''), nullif(trim(summary), ''), nullif(trim(explanation), '')) AS t FROM clause_analysis) WHERE t IS NOT NULL""",
    "explain_checks": """
        SELECT *, n_clauses <= 100 AND n_blank = 0 AND n_unnamed = 0 AS valid FROM (SELECT run_id, count(*) AS n_clauses, count(*) FILTER (coalesce(trim(source_text), '') = '') AS n_blank, count(*) FILTER (coalesce(trim(clause_id), '') = '') AS n_unnamed FROM clause_analysis GROUP BY run_id)""",
    "level_groups": f"""
        SELECT run_id, level, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_id) AS row_ids, round(max(-90 + coalesce(risk_score, 0) * CAST(1.8 AS DOUBLE)), 2) AS angle
        FROM (SELECT *, CASE WHEN upper(coalesce({_NAMED.format('risk_level')}, 'low')) = 'CRITICAL' THEN 'HIGH' ELSE upper(coalesce({_NAMED.format('risk_level')}, 'low')) END AS level FROM clause_analysis WHERE run_id IS NOT NULL) GROUP BY run_id, level""",
    "list_fields": f"""
        SELECT row_id, array_to_string(list_filter(list_transform(coalesce(obligations, []), lambda x: {_collapsed('x')}), lambda x: x <> ''), '|') AS obligations,
            CAST(len(list_filter(list_transform(coalesce(permissions, CASE WHEN risk_reason IS NOT NULL THEN [risk_reason] END, []), lambda x: {_collapsed('x')}), lambda x: x <> '')) AS INTEGER) AS n_permissions FROM clause_analysis""",
    "runs_missing": """
        SELECT run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY stored_at DESC NULLS LAST, status DESC NULLS LAST, document_count DESC NULLS LAST, policy_count DESC NULLS LAST) AS k FROM runs WHERE run_id IS NOT NULL)
        WHERE k = 1 AND run_id NOT IN (SELECT run_id FROM clause_analysis WHERE run_id IS NOT NULL AND risk_score IS NOT NULL)""",
}
