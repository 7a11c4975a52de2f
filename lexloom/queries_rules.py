"""Queries of the rule operators: URLs, types, filters, categories, factors, evidence; and the same in DuckDB's SQL."""

from pyspark.sql import functions as F

from lexloom.functions import text, urls
from lexloom.operators import categories, classify, extract, factors, filters, scores
from lexloom.operators import lexicon as lx
from lexloom.sources.tables import table


def url_rules(spark, base):
    u = F.col("url")
    wrapped = F.concat(F.lit("https://duckduckgo.com/l/?uddg="), F.url_encode(u))
    coded = F.concat(F.lit("https://www.bing.com/ck/a?x=1&u=a1"), F.translate(F.regexp_replace(F.base64(F.encode(u, "utf-8")), r"[=\r\n]", ""), "+/", "-_"))
    host = urls.host(u)
    return table(spark, base, "firecrawl_scrape").select(
        "scrape_id", urls.canonical_search(u).alias("search_form"), urls.root_domain(host).alias("root"), urls.same_root(host, urls.host(F.col("source_url"))).alias("same_root"),
        urls.is_commerce(u).alias("commerce"), urls.is_blocked(u).alias("blocked"), urls.is_bad_candidate(u).alias("bad"), urls.looks_like_policy(u).alias("policy"), urls.has_strong_path(u).alias("strong"),
        urls.unwrap_search(wrapped).alias("unwrapped"), urls.unwrap_search(coded).alias("decoded"), urls.unwrap_search(u).alias("plain"), urls.candidate(u, F.lit(None).cast("string"), F.col("source_url")).alias("candidate"),
    )


def url_types(spark, base):
    rows = table(spark, base, "firecrawl_scrape")
    score = classify.type_scores(F.col("url"))
    return rows.select("scrape_id", classify.type_of_page(F.col("url"), F.col("title"), F.col("content")).alias("page_type"), score["type"].alias("scored_type"), score["score"].alias("score"), classify.search_score(F.col("url"), F.col("title"), F.lit(""), classify.document_type(F.col("type"))).alias("search_score"), classify.label(classify.document_type(F.col("type"))).alias("label"))


def site_types(spark, base):
    named = table(spark, base, "firecrawl_scrape").select(urls.host(F.col("url")).alias("site"), classify.document_type(F.col("type")).alias("type"))
    kind = F.when(F.col("type").isin(*lx.DOCUMENT_TYPES), F.col("type")).otherwise("legal")
    return named.withColumn("kind", kind).groupBy("site").agg(F.count("*").alias("n"), *(F.count_if(F.col("kind") == x).alias(x) for x in lx.DOCUMENT_TYPES))


def page_filters(spark, base):
    rows = table(spark, base, "firecrawl_scrape").select("scrape_id", "url", "content", classify.document_type(F.col("type")).alias("type"))
    seen = filters.signals(filters.prepared(rows, "content"))
    u, kind, held = F.col("url"), F.col("type"), F.coalesce(F.trim("content") != "", F.lit(False))
    policy, candidate = filters.is_policy_content(u, kind), filters.is_candidate(u, kind, F.col("content"))
    names = ["shell", "body", "links", "menu", "service", "commerce", "groups", "group", "structure", "title", "duty"]
    return seen.select("scrape_id", *names, filters.is_shell().alias("is_shell"), filters.fits_type(kind).alias("fits_type"), policy.alias("is_policy"), candidate.alias("is_candidate"), (candidate & held & policy).alias("is_real"), filters.is_substantive_page(kind).alias("is_substantive"), filters.is_search_content(kind).alias("is_found"))


def pdf_texts(spark, base):
    rows = table(spark, base, "firecrawl_scrape").where(F.length("content") > 0)
    return rows.select("scrape_id", filters.is_pdf_text(F.col("content")).alias("is_text"), F.round(filters.distinct_line_share(F.col("content")), 6).alias("distinct_lines"))


def excerpt_filters(spark, base):
    rows = filters.prepared(table(spark, base, "clause_analysis").select("row_id", "source_text", classify.category(F.col("category")).alias("category")), "source_text")
    c = F.col("category")
    return rows.select("row_id", filters.is_clean_excerpt().alias("clean"), filters.is_menu_text().alias("menu"), filters.fits_category(c).alias("fits"), filters.is_investment().alias("investment"), filters.is_clause(c).alias("clause"))


def phrase_category(spark, base):
    rows = filters.prepared(table(spark, base, "clause_analysis").select("row_id", "title", "source_text", classify.domain_category(F.col("category")).alias("proposed")), "source_text")
    formed = rows.withColumn("form", F.explode(F.array(text.classifier_form(F.col("flat"))))).withColumn("suggested", F.explode(F.array(categories.suggested(F.col("form")))))
    both = formed.withColumn("category", categories.reconciled(F.col("proposed"), F.col("form"), F.col("suggested")))
    return both.select("row_id", "proposed", "suggested", "category", categories.retitled(F.col("title"), F.col("proposed"), F.col("category")).alias("title"))


def factor_scores(spark, base):
    rows = factors.scored(table(spark, base, "clause_analysis").select("row_id", *factors.TEXT_FIELDS))
    return rows.select("row_id", F.array_join("risk_factors", ",").alias("factors"), "factor_score", "factor_level")


def factor_group_suppression(spark, base):
    rows = table(spark, base, "clause_analysis").select("row_id", *factors.TEXT_FIELDS)
    low = rows.select("row_id", F.explode(F.array(factors.clause_text(rows))).alias("low"))
    found = low.select("row_id", F.explode(F.array(factors.inferred(F.col("low")))).alias("found"))
    return found.select("row_id", F.size("found").alias("n_found"), F.size(factors.suppressed(F.col("found"))).alias("n_kept"), F.array_join(F.array_except("found", factors.suppressed(F.col("found"))), ",").alias("dropped"))


def run_factor_scores(spark, base):
    rows = factors.scored(table(spark, base, "clause_analysis").where("run_id is not null").select("run_id", "row_id", *factors.TEXT_FIELDS))
    return scores.overall(rows, "run_id", "factor_score", "row_id").select("run_id", F.col("overall_top").alias("score"), classify.level(F.col("overall_top")).alias("level"))


def risk_evidence(spark, base):
    pages = table(spark, base, "firecrawl_scrape").where("content is not null and url is not null").select(F.col("url").alias("document_url"), F.lit(0).alias("chunk_index"), F.col("content").alias("chunk"))
    found = extract.evidence(pages)
    return found.select("clause_id", "title", "category", F.md5("source_text").alias("source_md5"), F.length("source_text").alias("n_chars"))


QUERIES = {f.__name__: f for f in (url_rules, url_types, site_types, page_filters, pdf_texts, excerpt_filters, phrase_category, factor_scores, factor_group_suppression, run_factor_scores, risk_evidence)}

# SQL ------------------------------------------------------------------------------------------------------------------


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _part(n: int, url: str = "url") -> str:
    return rf"regexp_extract(trim({url}), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', {n})"


def _host(url: str = "url") -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({_part(2, url)}), '^.*@', ''), ':\d*$', ''), '^www\.', '')"


_WHITE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _collapsed(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '{_WHITE}', ' ', 'g'), '^ | $', '', 'g')"


def _hits(words, t: str = "low") -> str:
    return "(" + " + ".join(f"CAST(contains({t}, {_q(w)}) AS INTEGER)" for w in words) + ")"


def _any(words, t: str = "low") -> str:
    return "(" + " OR ".join(f"contains({t}, {_q(w)})" for w in words) + ")"


def _word(words, t: str = "form") -> str:
    return f"regexp_matches({t}, '(^|[^a-z0-9])(?:{'|'.join(words)})([^a-z0-9]|$)')"


_KNOWN = " ".join(f"WHEN {_q(a)} THEN {_q(b)}" for a, b in (lx.TYPE_ALIASES | {x: x for x in lx.DOCUMENT_TYPES}).items())
_TYPE = f"coalesce(CASE lower(trim(type)) {_KNOWN} END, 'other')"
_PATH = f"lower({_part(3)})"
_SEGMENTS = f"list_filter(string_split({_PATH}, '/'), lambda x: x <> '')"
_COMMERCE = f"coalesce(trim(url) = '' OR len(list_intersect({_SEGMENTS}, [{', '.join(_q(x) for x in lx.COMMERCE_PATHS)}])) > 0, true)"
_BLOCKED = f"coalesce(trim(url) = '' OR len(list_intersect({_SEGMENTS}, [{', '.join(_q(x) for x in lx.BLOCKED_SEGMENTS)}])) > 0 OR coalesce({_SEGMENTS}[1] IN ('u', 'user', 'users'), false), true)"
_COMPACT = f"regexp_replace({_PATH}, '[^a-z0-9]+', '', 'g')"
_LOOKS = f"coalesce(NOT {_COMMERCE} AND ({_any(lx.POLICY_PATH_WORDS, _COMPACT)} OR ends_with({_COMPACT}, 'policy')), false)"
_STRONG = f"coalesce(regexp_matches({_PATH}, '(?:^|/)(?:{'|'.join(lx.STRONG_PATH_WORDS)})(?:$|[-_/])'), false)"
_PDF = rf"coalesce(ends_with({_PATH}, '.pdf') OR contains({_PATH}, '.pdf/'), false)"
_HTTP = "coalesce(regexp_matches(trim(url), '^(?i:https?)://[^/?#]+'), false)"


def _url_rules() -> str:
    site = rf"regexp_replace(lower({_part(2)}), '^.*@', '')"
    bare = rf"CASE WHEN (lower({_part(1)}) = 'http' AND {site} LIKE '%:80') OR (lower({_part(1)}) = 'https' AND {site} LIKE '%:443') OR regexp_matches({site}, ':0*$') THEN regexp_replace({site}, ':\d*$', '') ELSE {site} END"
    path = f"regexp_replace({_part(3)}, ';[^/]*$', '')"
    ended = f"CASE WHEN {path} IN ('', '/') THEN '/' ELSE regexp_replace({path}, '/+$', '') END"
    query = f"CASE WHEN {_part(4)} = '?' THEN '' ELSE {_part(4)} END"
    root = rf"regexp_extract({{0}}, '([^.]*\.)?[^.]*$')"
    link = "CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE '' END"
    return f"""
        SELECT scrape_id, coalesce(CASE WHEN {_part(1)} <> '' AND ({bare}) <> '' THEN lower({_part(1)}) || '://' || ({bare}) || ({ended}) || ({query}) ELSE '' END, '') AS search_form,
            {root.format(_host())} AS root, coalesce({_host()} <> '' AND {_host('source_url')} <> '' AND {root.format(_host())} = {root.format(_host('source_url'))}, false) AS same_root,
            {_COMMERCE} AS commerce, {_BLOCKED} AS blocked,
            coalesce({_any(lx.BAD_URL_WORDS, 'lower(url)')} OR regexp_matches({_PATH}, '\\.(?:{'|'.join(lx.ASSETS)})$'), false) AS bad, {_LOOKS} AS policy, {_STRONG} AS strong,
            CASE WHEN url IS NULL THEN '' WHEN trim(url) = '' THEN 'https://duckduckgo.com/l/?uddg=' || url_encode(url) ELSE CASE WHEN regexp_matches(trim(url), '^https?://') THEN trim(url) ELSE '' END END AS unwrapped,
            coalesce({link}, '') AS decoded, coalesce({link}, '') AS plain,
            CASE WHEN {_HTTP} THEN lower({_part(1)}) || '://' || lower({_part(2)}) || {path} || {_part(4)}
                 WHEN coalesce(trim(url), '') = '' AND {_HTTP.replace('url', 'source_url')} THEN lower({_part(1, 'source_url')}) || '://' || lower({_part(2, 'source_url')}) || regexp_replace({_part(3, 'source_url')}, ';[^/]*$', '') || {_part(4, 'source_url')} END AS candidate
        FROM firecrawl_scrape"""


def _url_types() -> str:
    named = f"lower(regexp_replace(coalesce(url, '') || ' ' || coalesce(title, ''), '{_WHITE}', ' ', 'g'))"
    first = " ".join(f"WHEN regexp_matches(named, {_q(p)}) THEN '{k}'" for k, p in classify.PAGE_PATTERNS.items())
    inside = " ".join(f"WHEN regexp_matches(both_, {_q(p)}) THEN '{k}'" for k, p in classify.CONTENT_PATTERNS)
    points = {k: " + ".join(f"10 * CAST(regexp_matches(lower(url), {_q(p)}) AS INTEGER)" for p in ps) for k, ps in classify.SCORE_PATTERNS.items()}
    best = " ".join(f"WHEN s[{i}] = list_max(s) THEN '{k}'" for i, k in enumerate(points, 1))
    asset = rf"regexp_matches(lower(url), '\.(?:{'|'.join(lx.ASSETS)})(?:$|\?)')"
    hit = " ".join(f"WHEN kind = '{k}' THEN 3 * CAST({_any(u, 'lower(u)')} AS INTEGER) + 2 * {_hits(w, 'found')}" for k, (u, w) in classify.SEARCH_SIGNALS.items())
    labels = " ".join(f"WHEN '{k}' THEN {_q(v)}" for k, v in classify.LABELS.items())
    return f"""
        WITH a AS (SELECT scrape_id, coalesce(url, '') AS u, {named} AS named, lower(coalesce(url, '') || ' ' || coalesce(title, '') || ' ') AS found, {_TYPE} AS kind,
                lower({_collapsed("substring(coalesce(content, ''), 1, 16000)")}) AS body, CASE WHEN coalesce({asset}, true) THEN [0] ELSE [{', '.join(points.values())}] END AS s FROM firecrawl_scrape),
        b AS (SELECT *, named || ' ' || body AS both_ FROM a)
        SELECT scrape_id, CASE {first} WHEN body = '' THEN '' {inside} ELSE '' END AS page_type, CASE WHEN list_max(s) = 0 THEN 'unknown' {best} END AS scored_type, CAST(list_max(s) AS INTEGER) AS score,
            CAST(CASE {hit} ELSE 0 END AS INTEGER) AS search_score, CASE kind {labels} ELSE 'Other' END AS label FROM b"""


def _page_filters() -> str:
    groups = [f"{_any(words)} AS g{k}" for k, words in enumerate(lx.POLICY_GROUPS.values())]
    n = len(groups)
    group = " ".join(f"WHEN g{k} THEN '{name}'" for k, name in enumerate(lx.POLICY_GROUPS))
    fits = " ".join(f"WHEN '{k}' THEN {_any(w)}" for k, w in lx.TYPE_PHRASES.items())
    shop = ("add to bag", "add to cart", "shop now", "sort by popularity", "sort by price", "all products", "buy now", "wishlist", "shopping cart")
    page = {
        "privacy": ("privacy policy", "privacy notice", "personal information", "personal data", "data protection", "collect your information"), "terms": ("terms and conditions", "terms of use", "terms of service", "user agreement", "these terms"),
        "cookies": ("cookie policy", "cookie notice", "cookies", "tracking technologies", "similar technologies"), "returns": ("return policy", "returns", "refund policy", "refund", "exchange"),
        "payments": ("payment policy", "payment terms", "payments", "fees", "transaction"), "promotions": ("promotion", "promotional", "sale policy", "offer terms", "discount"), "legal": ("legal notice", "grievance", "corporate information", "legal information", "notice"),
    }
    found = {
        "terms": ("terms and conditions", "terms of use", "terms of service", "user agreement", "governing law", "intellectual property", "limitation of liability"), "privacy": ("privacy policy", "personal information", "personal data", "data protection", "information we collect", "third party", "cookies"),
        "cookies": ("cookie policy", "cookie notice", "cookies", "strictly necessary", "analytics cookies", "advertising cookies", "cookie preferences"), "returns": ("return policy", "cancellation policy", "refund", "return request", "replacement", "return period"),
        "payments": ("payment policy", "payment methods", "payment terms", "credit card", "debit card", "payment gateway"), "legal": ("legal notice", "disclaimer", "grievance officer", "jurisdiction", "applicable law", "copyright"),
    }
    evident = "(structure >= 2 OR duty >= 3 OR title >= 1)"
    return f"""
        WITH a AS (SELECT scrape_id, url, content, {_TYPE} AS kind, {_collapsed("coalesce(content, '')")} AS flat FROM firecrawl_scrape),
        b AS (SELECT *, lower(flat) AS low FROM a),
        c AS (SELECT *, {_hits(lx.SHELL_PHRASES)} AS shell, {_hits(lx.BODY_PHRASES)} AS body, greatest(len(regexp_extract_all(low, 'https?://')), len(regexp_extract_all(low, '\\]\\('))) AS links, {_hits(lx.MENU_PHRASES)} AS menu,
            {_hits(lx.SERVICE_PHRASES)} AS service, {_hits(lx.COMMERCE_PHRASES)} AS commerce, {', '.join(groups)},
            {_hits(lx.STRUCTURE_PHRASES)} + CAST(regexp_matches(low, '\\b1\\.\\d+\\s+') AS INTEGER) + CAST(regexp_matches(low, '\\b2\\.\\d+\\s+') AS INTEGER) + CAST(regexp_matches(low, '\\b3\\.\\d+\\s+') AS INTEGER) AS structure,
            {_hits(lx.TITLE_PHRASES)} AS title, {_hits(lx.DUTY_PHRASES)} AS duty FROM b),
        d AS (SELECT *, {' + '.join(f'CAST(g{k} AS INTEGER)' for k in range(n))} AS groups, CASE {group} ELSE '' END AS "group", flat = '' OR (shell >= 1 AND body <= 2) OR (length(flat) < 5000 AND links >= 3 AND menu >= 3) AS is_shell,
            CASE kind {fits} ELSE true END AS fits_type FROM c),
        e AS (SELECT *, CASE WHEN length(flat) < 500 OR is_shell OR NOT fits_type OR {_BLOCKED} OR service >= 4 OR commerce >= 2 THEN false
                WHEN length(flat) < 1200 THEN groups >= 2 OR (structure >= 3 AND duty >= 3 AND title >= 1)
                WHEN title >= 1 AND (structure >= 2 OR duty >= 2) THEN true WHEN groups >= 2 THEN true
                WHEN groups = 1 AND (CASE WHEN "group" IN ('payments', 'promotions') THEN title >= 1 AND (structure >= 2 OR duty >= 3) ELSE {evident} END) THEN true
                ELSE coalesce({_LOOKS} AND {_any(('terms', 'privacy', 'cookie', 'disclaimer', 'legal', 'agreement', 'policy', 'data protection', 'mitc', 'kfs'), f"regexp_replace({_PATH}, '[^a-z0-9]+', ' ', 'g')")} AND {evident}, false) END AS is_policy FROM d),
        f AS (SELECT *, NOT {_COMMERCE} AND ({_STRONG} OR {_PDF} OR kind IN ('terms', 'privacy', 'cookies', 'returns', 'legal', 'promotions') OR (coalesce(trim(content), '') <> '' AND is_policy)) AS is_candidate FROM e)
        SELECT scrape_id, shell, body, CAST(links AS INTEGER) AS links, menu, service, commerce, groups, "group", structure, title, duty, is_shell, fits_type, is_policy, is_candidate, is_candidate AND coalesce(trim(content), '') <> '' AND is_policy AS is_real,
            length(flat) >= 500 AND (CASE kind {' '.join(f"WHEN '{k}' THEN {_any(w)}" for k, w in page.items())} ELSE true END) AND NOT ({_hits(lx.HOMEPAGE_PHRASES)} >= 3 AND length(flat) < 5000) AS is_substantive,
            length(flat) >= 500 AND {_hits(shop)} < 3 AND (CASE kind {' '.join(f"WHEN '{k}' THEN {_hits(w)} >= 2" for k, w in found.items())} ELSE false END) AS is_found FROM f"""


_CLEANED = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '!\[[^\]]*\]\([^)]+\)', ' ', 'g'), '\n{_WHITE[:-1]}*\n+', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '^{_WHITE}|{_WHITE}$', '', 'g')"
_LINES = r"list_filter(list_transform(regexp_split_to_array(lower({0}), '\r\n?|\n'), lambda x: trim(x)), lambda x: x <> '')"


def _excerpts() -> str:
    menu = _hits(filters.MENU_WORDS)
    words = " + ".join(rf"CAST(regexp_matches(low, '\b{w}\b') AS INTEGER)" for w in lx.CHROME_WORDS)
    return rf"""
        WITH a AS (SELECT row_id, {_CATEGORY} AS category, lower({_collapsed("coalesce(source_text, '')")}) AS low FROM clause_analysis),
        b AS (SELECT *, len(regexp_extract_all(low, 'https?://')) AS n1, len(regexp_extract_all(low, '\]\s*\(')) AS n2, len(regexp_extract_all(low, 'javascript\s*:')) AS n3, len(regexp_extract_all(low, '\[[^\]]{{1,120}}\]\s*\(')) AS n4, {words} AS n5 FROM a),
        c AS (SELECT *, low <> '' AND n1 < 2 AND n2 < 2 AND n3 < 1 AND n5 < 4 AND n4 < 2 AND (length(low) <= 900 OR n1 + n2 + n3 + n4 = 0) AS clean,
            regexp_matches(low, '{filters.MENU_SENTENCE}') OR {menu} >= 2 AS menu,
            CASE category WHEN 'auto_renewal' THEN regexp_matches(low, '\bautomatically\s+renew|\bauto[- ]renew(?:al)?\b.{{0,180}}\b(?:subscription|plan|service|term|membership)\b|\b(?:subscription|plan|service|membership)\b.{{0,180}}\b(?:auto[- ]renew|renew(?:s|ed)?\b)|\brenew(?:s|ed|al)?\b.{{0,180}}\b(?:unless|until|cancel|cancellation|notice|fee|charge|term)\b')
                WHEN 'refund' THEN regexp_matches(low, '\beligib(?:le|ility)\b.{{0,160}}\brefund|\brefund(?:ed|s|ing)?\b.{{0,220}}\b(?:amount|request|process|issue|receive|customer|payment|purchase|order|transaction|cancel|cancellation|return|reimburse)\b|\b(?:amount|payment|money|funds)\b.{{0,180}}\b(?:refund(?:ed|s|ing)?|returned|reimbursed)\b|\bnon[- ]refundable\b|\brefund policy\b')
                ELSE true END AS fits, regexp_matches(low, '\b(?:ipo|asba)\b|application supported by blocked amount|\b(?:public|share|securities) issues?\b|\binvestors?\b.{{0,100}}\bsubscriptions?\b|\bsubscriptions?\b.{{0,100}}\b(?:shares|securities|ipo|public issue)\b') AS investment,
            len(regexp_extract_all(low, '{filters.OPERATIVE}')) AS op, regexp_matches(low, '{filters.DEFINING}') AS def, regexp_matches(low, '{filters.MATERIAL}') AS mat, regexp_matches(low, '{filters.DESCRIPTIVE}') AS des FROM b)
        SELECT row_id, clean, menu, fits, investment, length(low) >= 40 AND clean AND (op > 0 OR def OR mat) AND NOT (des AND NOT mat AND (op = 0 OR (op < 2 AND NOT def))) AND fits AS clause FROM c"""


_CATEGORY = r"coalesce(nullif(regexp_replace(lower(trim(category)), '[\s-]+', '_', 'g'), ''), 'other')"


def _phrases() -> str:
    invested = _word([f"{x} {y}" for x in lx.INVESTING for y in lx.SUBSCRIBING[0]])
    subscribed = f"NOT {invested} AND ({_word(lx.MEMBERSHIP)} OR ({_word(lx.SUBSCRIBING[0])} AND {_word(lx.SUBSCRIBING[1])}))"
    words = {k: _word(v) for k, v in lx.CATEGORY_WORDS.items()}
    changes, law, refunded, renewed = (x.replace("'", "''") for x in (categories.CHANGES, categories.GOVERNING, categories.REFUNDED, categories.RENEWED))
    late = " ".join(f"WHEN {words[k]} THEN '{k}'" for k in ("intellectual_property", "prohibited_use", "license", "liability", "warranty", "termination", "tracking", "security", "privacy", "payments"))
    own = "coalesce(CASE category " + " ".join(f"WHEN '{k}' THEN {_q(v)}" for k, v in lx.CATEGORY_TITLES.items()) + " END, title)"
    return rf"""
        WITH a AS (SELECT row_id, title, CASE WHEN {_CATEGORY} IN ({', '.join(_q(x) for x in lx.CATEGORIES)}) THEN {_CATEGORY} ELSE 'other' END AS proposed, {_collapsed("coalesce(source_text, '')")} AS flat FROM clause_analysis),
        b AS (SELECT *, lower(flat) AS low, {_collapsed("translate(lower(flat), '–—', '--')")} AS form FROM a),
        c AS (SELECT *, CASE WHEN form = '' OR regexp_matches(form, '{changes}') THEN 'other' WHEN {_word(lx.RENEWING[0])} AND {_word(lx.RENEWING[1])} THEN 'auto_renewal' WHEN {words['refund']} THEN 'refund' WHEN {words['age_requirement']} THEN 'age_requirement'
            WHEN {_word(lx.SHARING[0])} AND {_word(lx.SHARING[1])} THEN 'data_sharing' WHEN {_word(lx.COLLECTING[0])} AND {_word(lx.COLLECTING[1])} THEN 'data_collection' WHEN {subscribed} THEN 'subscription'
            WHEN {words['cancellation']} THEN 'cancellation' WHEN {words['arbitration']} THEN 'arbitration' WHEN {words['indemnification']} THEN 'indemnification' WHEN regexp_matches(form, '{law}') THEN 'governing_law' {late} ELSE 'other' END AS suggested,
            regexp_matches(low, '\b(?:ipo|asba)\b|application supported by blocked amount|\b(?:public|share|securities) issues?\b|\binvestors?\b.{{0,100}}\bsubscriptions?\b|\bsubscriptions?\b.{{0,100}}\b(?:shares|securities|ipo|public issue)\b') AS inv FROM b),
        d AS (SELECT *, CASE
            WHEN proposed = 'refund' AND (suggested = 'payments' OR (inv AND NOT regexp_matches(form, '{refunded}'))) THEN 'payments'
            WHEN proposed = 'refund' AND suggested = 'other' AND NOT regexp_matches(form, '{refunded}') THEN 'other'
            WHEN proposed = 'subscription' AND suggested = 'payments' THEN 'payments' WHEN proposed = 'subscription' AND inv THEN 'other'
            WHEN proposed = 'auto_renewal' AND inv THEN CASE WHEN suggested = 'payments' THEN 'payments' ELSE 'other' END
            WHEN proposed = 'auto_renewal' AND suggested IN ('payments', 'other') AND NOT regexp_matches(form, '{renewed}') THEN suggested
            WHEN proposed = 'data_collection' AND suggested = 'other' AND regexp_matches(form, '{changes}') THEN 'other'
            WHEN proposed = 'governing_law' AND NOT regexp_matches(form, '{law}') THEN CASE WHEN suggested <> 'other' THEN suggested WHEN {_any(('personal information', 'personal data', 'privacy', 'data controller', 'data protection'), 'form')} THEN 'privacy' ELSE 'other' END
            WHEN proposed = 'other' THEN suggested ELSE proposed END AS category FROM c)
        SELECT row_id, proposed, suggested, category, CASE WHEN contains(lower(title), 'policy change') AND category <> 'other' THEN {own} WHEN contains(lower(title), 'license') AND category NOT IN ('license', 'other') THEN {own}
            WHEN contains(lower(title), 'data collection') AND category = 'other' THEN 'Policy Changes' WHEN contains(lower(title), 'governing law') AND category <> 'governing_law' THEN {own}
            WHEN category <> proposed AND NOT coalesce(list_bool_or(list_transform(string_split(category, '_'), lambda w: contains(lower(title), w))), true) THEN {own} ELSE title END AS title FROM d"""


def _factors() -> str:
    """row_id, run_id, ord, f, w, g, n of each factor found (g: its group)."""
    group = {f: k for k, fs in enumerate(lx.FACTOR_GROUPS) for f in fs}
    parts = [f"SELECT row_id, run_id, {k} AS ord, '{f}' AS f, {w} AS w, {group.get(f, 'NULL')} AS g FROM texts WHERE regexp_matches(low, '{p}')" for k, (f, (w, p)) in enumerate(lx.FACTORS.items())]
    whole = " || ' ' || ".join(f"coalesce({c}, '')" for c in ("title", "summary", "explanation", "risk_reason", "source_text"))
    kept = ", ".join(_q(x) for x in lx.KEPT_FACTORS)
    return f"""texts AS (SELECT row_id, run_id, {_collapsed(f"lower({whole})")} AS low FROM clause_analysis), found AS ({' UNION ALL '.join(parts)}),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id, g ORDER BY w DESC, ord) AS n FROM found),
        kept AS (SELECT * FROM ranked WHERE g IS NULL OR n = 1 OR f IN ({kept})),
        scored AS (SELECT t.row_id, any_value(t.run_id) AS run_id, coalesce(string_agg(f, ',' ORDER BY ord), '') AS factors, CAST(least(greatest(coalesce(sum(w), 0), 5), 100) AS INTEGER) AS factor_score FROM texts t LEFT JOIN kept k ON t.row_id = k.row_id GROUP BY t.row_id)"""


_LEVEL = "CASE WHEN {0} > 80 THEN 'high' WHEN {0} >= 45 THEN 'medium' WHEN {0} IS NOT NULL THEN 'low' END"


def _evidence() -> str:
    parts = []
    for k, (title, category, patterns) in enumerate(lx.CLAUSE_RULES):
        first = " ".join(f"WHEN regexp_matches(low, {_q(p)}) THEN regexp_extract(low, {_q(p)})" for p in patterns)
        parts.append(f"SELECT doc, url, flat, low, {k} AS rule, '{title}' AS title, '{category}' AS category, CASE {first} END AS hit FROM pages")
    return rf"""
        WITH pages AS (SELECT *, lower(flat) AS low FROM (SELECT url, regexp_replace(lower(regexp_replace(trim(url), '#.*$', '')), '/+$', '') AS doc, {_collapsed('content')} AS flat FROM firecrawl_scrape WHERE content IS NOT NULL AND url IS NOT NULL) WHERE flat <> ''),
        hits AS ({' UNION ALL '.join(parts)}), placed AS (SELECT *, instr(low, hit) AS pos, length(hit) AS size FROM hits WHERE hit IS NOT NULL),
        ends AS (SELECT *, greatest(pos - 200, 1) AS start, substring(flat, greatest(pos - 200, 1), pos - greatest(pos - 200, 1)) AS before, substring(flat, pos + size, 350) AS after FROM placed),
        cut AS (SELECT *, length(regexp_extract(before, '(?s)^(.*[.!?]\s+)', 1)) AS gone, CASE WHEN regexp_extract(after, '(?s)^(.*?[.!?])(?:\s|$)', 1) = '' THEN length(after) ELSE length(regexp_extract(after, '(?s)^(.*?[.!?])(?:\s|$)', 1)) END AS tail FROM ends),
        texts AS (SELECT doc, url, rule, title, category, trim(substring(flat, start + gone, pos + size + tail - start - gone)) AS s FROM cut),
        keyed AS (SELECT *, trim(regexp_replace(lower(s), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\x{{200C}}\x{{200D}}\x{{24B6}}-\x{{24E9}}]+', ' ', 'g')) AS words FROM texts WHERE length(s) >= 40),
        once AS (SELECT *, row_number() OVER (PARTITION BY doc, category, words ORDER BY rule, url) AS n FROM keyed)
        SELECT 'risk-' || substring(sha256(doc || '|0|' || category || '|' || words), 1, 16) AS clause_id, title, category, md5(substring(s, 1, 1200)) AS source_md5, CAST(length(substring(s, 1, 1200)) AS INTEGER) AS n_chars FROM once WHERE n = 1"""


SQL = {
    "url_rules": _url_rules(),
    "url_types": _url_types(),
    "site_types": f"SELECT {_host()} AS site, count(*) AS n, {', '.join(f'count(*) FILTER (kind = {_q(x)}) AS {x}' for x in lx.DOCUMENT_TYPES)} FROM (SELECT url, CASE WHEN {_TYPE} = 'other' THEN 'legal' ELSE {_TYPE} END AS kind FROM firecrawl_scrape) GROUP BY 1",
    "page_filters": _page_filters(),
    "pdf_texts": rf"""
        WITH a AS (SELECT scrape_id, content, {_CLEANED} AS t FROM firecrawl_scrape WHERE length(content) > 0), b AS (SELECT *, {_LINES.format('t')} AS lines, {_LINES.format('content')} AS raw FROM a)
        SELECT scrape_id, length(t) >= 500 AND {_hits(lx.VIEWER_PHRASES, 'lower(t)')} < 2 AND (len(lines) < 10 OR len(list_distinct(lines)) >= 0.10 * len(lines)) AND length(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g')) >= 250 AS is_text,
            CASE WHEN len(raw) > 0 THEN round(CAST(len(list_distinct(raw)) AS DOUBLE) / len(raw), 6) END AS distinct_lines FROM b""",
    "excerpt_filters": _excerpts(),
    "phrase_category": _phrases(),
    "factor_scores": f"WITH {_factors()} SELECT row_id, factors, factor_score, {_LEVEL.format('factor_score')} AS factor_level FROM scored",
    "factor_group_suppression": f"WITH {_factors()} SELECT t.row_id, CAST(count(r.f) AS INTEGER) AS n_found, CAST(count(k.f) AS INTEGER) AS n_kept, coalesce(string_agg(CASE WHEN k.f IS NULL THEN r.f END, ',' ORDER BY r.ord), '') AS dropped FROM texts t LEFT JOIN ranked r ON t.row_id = r.row_id LEFT JOIN kept k ON r.row_id = k.row_id AND r.f = k.f GROUP BY t.row_id",
    "run_factor_scores": f"""
        WITH {_factors()}, best AS (SELECT * FROM (SELECT run_id, factor_score, row_number() OVER (PARTITION BY run_id ORDER BY factor_score DESC, row_id) AS n FROM scored WHERE run_id IS NOT NULL) WHERE n <= 5),
        runs_ AS (SELECT run_id, CAST(round_even(avg(factor_score), 0) AS INTEGER) AS score FROM best GROUP BY run_id) SELECT run_id, score, {_LEVEL.format('score')} AS level FROM runs_""",
    "risk_evidence": _evidence(),
}
