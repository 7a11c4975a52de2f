"""Which pages, documents and excerpts are what they claim to be: counts of signals, and the rules over the counts.

Each test takes columns and gives a column. Texts are lower-cased and collapsed once, in a projection of their own
(``prepared``), since an expression over them is repeated in each of some hundred terms."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as t
from lexloom.functions import urls
from lexloom.operators import classify
from lexloom.operators import lexicon as lx

LEAST_POLICY, LEAST_SUBSTANTIVE, LEAST_ALNUM, LONGEST_SHELL, LEAST_CLAUSE = 500, 1200, 250, 5000, 40
SIGNALS = ("body", "links", "menu", "service", "commerce", "groups", "group", "structure", "title", "duty")


def prepared(df: DataFrame, text: str) -> DataFrame:
    """``df`` and ``flat`` (the text collapsed) and ``low`` (in lower case), '' for null; computed once a row.

    The text passes through a generator, which Catalyst does not duplicate into the expressions above it."""
    flat = F.coalesce(t.collapsed(F.col(text)), F.lit(""))
    return df.withColumn("_p", F.explode(F.array(F.struct(flat.alias("flat"), F.lower(flat).alias("low"))))).select("*", "_p.flat", "_p.low").drop("_p")


def signals(df: DataFrame) -> DataFrame:
    """``df`` (prepared) and SIGNALS: how many signals of each sort a text has; ``group`` is the first group of phrases that occurs."""
    low = F.col("low")
    found = {name: t.has_any(low, phrases) for name, phrases in lx.POLICY_GROUPS.items()}
    numbered = sum((low.rlike(rf"\b{k}\.\d+\s+").cast("int") for k in (1, 2, 3)), F.lit(0))
    columns = {
        "shell": t.hits(low, lx.SHELL_PHRASES),
        "body": t.hits(low, lx.BODY_PHRASES),
        "links": F.greatest(F.regexp_count(low, F.lit("https?://")), F.regexp_count(low, F.lit(r"\]\("))),
        "menu": t.hits(low, lx.MENU_PHRASES),
        "service": t.hits(low, lx.SERVICE_PHRASES),
        "commerce": t.hits(low, lx.COMMERCE_PHRASES),
        "groups": sum((x.cast("int") for x in found.values()), F.lit(0)),
        "group": F.coalesce(*(F.when(x, F.lit(name)) for name, x in found.items()), F.lit("")),
        "structure": t.hits(low, lx.STRUCTURE_PHRASES) + numbered,
        "title": t.hits(low, lx.TITLE_PHRASES),
        "duty": t.hits(low, lx.DUTY_PHRASES),
    }
    return df.withColumn("_s", F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))))).select("*", "_s.*").drop("_s")


def is_shell() -> Column:
    """Of a row of ``signals``: whether the page only names policies, or is links and menus; an empty text counts as one."""
    links = (F.length("flat") < LONGEST_SHELL) & (F.col("links") >= 3) & (F.col("menu") >= 3)
    return (F.col("flat") == "") | ((F.col("shell") >= 1) & (F.col("body") <= 2)) | links


def fits_type(policy_type: Column) -> Column:
    """Of a prepared row: whether the text has a phrase of its type; a type without phrases fits."""
    out = F
    for name, phrases in lx.TYPE_PHRASES.items():
        out = out.when(policy_type == name, t.has_any(F.col("low"), phrases))
    return out.otherwise(True)


def is_policy_content(url: Column, policy_type: Column) -> Column:
    """Of a row of ``signals``: whether a page holds a policy. The rules in order; the first that applies decides."""
    length, groups, group = F.length("flat"), F.col("groups"), F.col("group")
    structure, title, duty = F.col("structure"), F.col("title"), F.col("duty")
    strong = urls.looks_like_policy(url) & F.regexp_replace(F.lower(urls.part(url, 3)), "[^a-z0-9]+", " ").rlike("terms|privacy|cookie|disclaimer|legal|agreement|policy|data protection|mitc|kfs")
    evident = (structure >= 2) | (duty >= 3) | (title >= 1)
    one = F.when(group.isin("payments", "promotions"), (title >= 1) & ((structure >= 2) | (duty >= 3))).otherwise(evident)
    return (
        F.when((length < LEAST_POLICY) | is_shell() | ~fits_type(policy_type) | urls.is_blocked(url) | (F.col("service") >= 4) | (F.col("commerce") >= 2), False)
        .when(length < LEAST_SUBSTANTIVE, (groups >= 2) | ((structure >= 3) & (duty >= 3) & (title >= 1)))
        .when((title >= 1) & ((structure >= 2) | (duty >= 2)), True)
        .when(groups >= 2, True)
        .when((groups == 1) & one, True)
        .otherwise(strong & evident)
    )


def is_candidate(url: Column, policy_type: Column, content: Column) -> Column:
    """Of a row of ``signals``: whether a page is worth fetching: no shop, and a strong path, a PDF, a known type, or content that holds a policy."""
    known = policy_type.isin("terms", "privacy", "cookies", "returns", "legal", "promotions")
    held = F.coalesce(F.trim(content) != "", F.lit(False)) & is_policy_content(url, policy_type)
    return ~urls.is_commerce(url) & (urls.has_strong_path(url) | urls.is_pdf(url) | known | held)


def is_substantive_page(policy_type: Column) -> Column:
    """Of a prepared row: at least 500 characters, a word of the expected type, and no shop's home page."""
    words = {
        "privacy": ("privacy policy", "privacy notice", "personal information", "personal data", "data protection", "collect your information"),
        "terms": ("terms and conditions", "terms of use", "terms of service", "user agreement", "these terms"),
        "cookies": ("cookie policy", "cookie notice", "cookies", "tracking technologies", "similar technologies"),
        "returns": ("return policy", "returns", "refund policy", "refund", "exchange"),
        "payments": ("payment policy", "payment terms", "payments", "fees", "transaction"),
        "promotions": ("promotion", "promotional", "sale policy", "offer terms", "discount"),
        "legal": ("legal notice", "grievance", "corporate information", "legal information", "notice"),
    }
    out = F
    for name, phrases in words.items():
        out = out.when(policy_type == name, t.has_any(F.col("low"), phrases))
    shop = (t.hits(F.col("low"), lx.HOMEPAGE_PHRASES) >= 3) & (F.length("flat") < LONGEST_SHELL)
    return (F.length("flat") >= LEAST_POLICY) & out.otherwise(True) & ~shop


def is_browser_document(url: Column, policy_type: Column) -> Column:
    """Of a prepared row: at least 500 characters, a path of the expected type, and no short page of a shop."""
    shop = (t.hits(F.col("low"), classify.SHOP_SIGNALS) >= 3) & (F.length("flat") < LONGEST_SHELL)
    return (F.length("flat") >= LEAST_POLICY) & F.coalesce(classify.type_of_path(url) == policy_type, F.lit(False)) & ~shop


def is_search_content(policy_type: Column) -> Column:
    """Of a prepared row: at least 500 characters, fewer than three signs of a shop, at least two phrases of the type."""
    shop = ("add to bag", "add to cart", "shop now", "sort by popularity", "sort by price", "all products", "buy now", "wishlist", "shopping cart")
    groups = {
        "terms": ("terms and conditions", "terms of use", "terms of service", "user agreement", "governing law", "intellectual property", "limitation of liability"),
        "privacy": ("privacy policy", "personal information", "personal data", "data protection", "information we collect", "third party", "cookies"),
        "cookies": ("cookie policy", "cookie notice", "cookies", "strictly necessary", "analytics cookies", "advertising cookies", "cookie preferences"),
        "returns": ("return policy", "cancellation policy", "refund", "return request", "replacement", "return period"),
        "payments": ("payment policy", "payment methods", "payment terms", "credit card", "debit card", "payment gateway"),
        "legal": ("legal notice", "disclaimer", "grievance officer", "jurisdiction", "applicable law", "copyright"),
    }
    out = F
    for name, phrases in groups.items():
        out = out.when(policy_type == name, t.hits(F.col("low"), phrases) >= 2)
    return (F.length("flat") >= LEAST_POLICY) & (t.hits(F.col("low"), shop) < 3) & out.otherwise(False)


def distinct_line_share(text: Column) -> Column:
    """Different non-blank lines (trimmed, lower case) by all of them; null without lines."""
    lines = F.filter(F.transform(F.split(F.lower(text), r"\r\n?|\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.size(F.array_distinct(lines)) / F.nullif(F.size(lines), F.lit(0))


def is_pdf_text(text: Column) -> Column:
    """Whether a text can be a document out of a PDF: 500 characters, under two signs of a viewer, lines that differ, 250 letters and digits."""
    clean = F.coalesce(t.cleaned(text), F.lit(""))
    lines = F.filter(F.transform(F.split(F.lower(clean), r"\r\n?|\n"), lambda x: F.trim(x)), lambda x: x != "")
    varied = (F.size(lines) < 10) | (F.size(F.array_distinct(lines)) >= 0.10 * F.size(lines))
    return (F.length(clean) >= LEAST_POLICY) & (t.hits(F.lower(clean), lx.VIEWER_PHRASES) < 2) & varied & (F.length(F.regexp_replace(clean, r"[^\p{L}\p{N}]", "")) >= LEAST_ALNUM)


def is_clean_excerpt() -> Column:
    """Of a prepared row: whether an excerpt is free of a page's links and menus."""
    low = F.col("low")
    addresses, links = F.regexp_count(low, F.lit("https?://")), F.regexp_count(low, F.lit(r"\]\s*\("))
    scripts, labels = F.regexp_count(low, F.lit(r"javascript\s*:")), F.regexp_count(low, F.lit(r"\[[^\]]{1,120}\]\s*\("))
    words = sum((low.rlike(rf"\b{w}\b").cast("int") for w in lx.CHROME_WORDS), F.lit(0))
    return (low != "") & (addresses < 2) & (links < 2) & (scripts < 1) & (words < 4) & (labels < 2) & ((F.length(low) <= 900) | (addresses + links + scripts + labels == 0))


#: What a clause does, by sort of statement; over lower-cased, collapsed text.
OPERATIVE = r"\b(?:shall|must|may not|may|will not|agrees? to|are required to|is required to|are entitled to|reserves? the right|is prohibited|are prohibited|not allowed|not permitted|are responsible|is responsible|owns?|belongs? to|grants?|waives?)\b"
DEFINING = r"\b(?:means|refers to|is defined as|includes but is not limited to|for the purposes? of)\b"
MATERIAL = r"\b(?:collect|share|disclose|retain|refund|terminat|suspend|indemnif|arbitrat|governed by|liab|renew|licen[cs]e|cancel)\w*"
DESCRIPTIVE = r"\b(?:this (?:page|section|site|website) (?:lists|contains|shows|provides|describes)|links? to|click here|learn more|read more)\b"
MENU_WORDS = ("home", "about us", "contact us", "careers", "press", "blog", "news", "login", "sign in", "sign up", "menu", "navigation", "quick links", "useful links", "related links", "site map", "sitemap", "categories", "sort by", "filter", "wishlist", "add to cart", "shop now", "buy now", "product details", "best sellers")
MENU_SENTENCE = r"\b(?:lists?|shows?|contains?|provides?)\s+(?:links?|navigation|menus?|options?)\b|\b(?:navigation|menu|footer|header)\b.{0,120}\b(?:links?|categories|options?)\b|\b(?:click|select|visit|go to|view all|explore)\b.{0,100}\b(?:link|page|section|menu)\b"


def is_menu_text() -> Column:
    """Of a prepared row: whether an excerpt speaks of menus, or has two or more of their words."""
    return F.col("low").rlike(MENU_SENTENCE) | (t.hits(F.col("low"), MENU_WORDS) >= 2)


def fits_category(category: Column) -> Column:
    """Of a prepared row: whether the text bears out the categories that menus and asides name without meaning them."""
    low = F.col("low")
    renewal = low.rlike(r"\bautomatically\s+renew|\bauto[- ]renew(?:al)?\b.{0,180}\b(?:subscription|plan|service|term|membership)\b|\b(?:subscription|plan|service|membership)\b.{0,180}\b(?:auto[- ]renew|renew(?:s|ed)?\b)|\brenew(?:s|ed|al)?\b.{0,180}\b(?:unless|until|cancel|cancellation|notice|fee|charge|term)\b")
    refund = low.rlike(r"\beligib(?:le|ility)\b.{0,160}\brefund|\brefund(?:ed|s|ing)?\b.{0,220}\b(?:amount|request|process|issue|receive|customer|payment|purchase|order|transaction|cancel|cancellation|return|reimburse)\b|\b(?:amount|payment|money|funds)\b.{0,180}\b(?:refund(?:ed|s|ing)?|returned|reimbursed)\b|\bnon[- ]refundable\b|\brefund policy\b")
    return F.when(category == "auto_renewal", renewal).when(category == "refund", refund).otherwise(True)


def is_clause(category: Column) -> Column:
    """Of a prepared row: whether an excerpt states a provision: 40 characters, clean, an operative, defining or material
    statement, no mere description of a page, and its category borne out."""
    operative, defining, material = F.regexp_count("low", F.lit(OPERATIVE)), F.col("low").rlike(DEFINING), F.col("low").rlike(MATERIAL)
    descriptive = F.col("low").rlike(DESCRIPTIVE)
    stated = (operative > 0) | defining | material
    described = descriptive & ~material & ((operative == 0) | ((operative < 2) & ~defining))
    return F.coalesce((F.length("low") >= LEAST_CLAUSE) & is_clean_excerpt() & stated & ~described & fits_category(F.lower(F.trim(category))), F.lit(False))


def is_investment() -> Column:
    """Of a prepared row: whether a clause speaks of buying shares."""
    return F.col("low").rlike(r"\b(?:ipo|asba)\b|application supported by blocked amount|\b(?:public|share|securities) issues?\b|\binvestors?\b.{0,100}\bsubscriptions?\b|\bsubscriptions?\b.{0,100}\b(?:shares|securities|ipo|public issue)\b")
