"""Types, categories and levels, as column expressions over a lexicon."""

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import text, urls
from lexloom.operators.lexicon import ASSETS, CATEGORIES, POLICY, Lexicon


def document_type(raw: Column, lexicon: Lexicon = POLICY) -> Column:
    """A type's alias, trimmed and lower-cased, mapped to its domain; ``other`` for null and unknown."""
    value = F.lower(F.trim(raw))
    known = lexicon.aliases | {t: t for t in lexicon.types}
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(known.items())))
    return F.coalesce(table[value], F.lit("other"))


def type_of_url(url: Column) -> Column:
    """The type that a URL's path names; the first of the ordered rules that hits, else ``other``."""
    compact = F.regexp_replace(F.lower(urls.part(url, 3)), "[^a-z0-9]+", "")
    rules = (
        ("privacy|dataprotection", "privacy"),
        ("cookie", "cookies"),
        ("termsandconditions|termsofuse|termsofservice|useragreement|terms$|termsconditions$", "terms"),
        ("return|refund|cancellation", "returns"),
        ("payment|fees", "payments"),
        ("promotion|offerterms", "promotions"),
        ("legal|disclaimer|agreement", "legal"),
        ("policy$", "legal"),
    )
    out = F
    for pattern, name in rules:
        out = out.when(compact.rlike(pattern), F.lit(name))
    return out.otherwise("other")


def category(raw: Column) -> Column:
    """A category's odd spellings made one: lower case, words joined by underscores; ``other`` for null and blank."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim(raw)), r"[\s-]+", "_"), F.lit("")), F.lit("other"))


def domain_category(raw: Column) -> Column:
    """``category`` where that is one of the domain, else ``other``."""
    name = category(raw)
    return F.when(name.isin(*CATEGORIES), name).otherwise("other")


#: Types with what names them in a URL or link label, and, after those, in a page's text; in the order of trial. Fixed values.
PAGE_PATTERNS = {
    "privacy": r"\bprivacy\b|privacypolicy|data[-_ ](?:protection|privacy)|personal[-_ ]data",
    "terms": r"\bterms\b|termsofuse|termsandcondition|user[-_ ](?:agreement|terms)|legal[-_ ]agreement",
    "cookies": r"\bcookies?\b",
    "returns": r"\breturns?\b|\brefunds?\b|return[-_ ]?refund|(?:return|refund)[-_ ]policy",
    "payments": r"\bpayments?\b|payment[-_ ](?:policy|terms)|fees?[-_ ]payment",
    "promotions": r"\bpromotions?\b|(?:promotion|promo|sale)[-_ ]policy|offer[-_ ]terms",
    "legal": r"legal[-_ ]notices?|\bgrievance\b|\bimprint\b|corporate[-_ ]information|corp[-_ ]info",
}
CONTENT_PATTERNS = (
    ("privacy", r"\bprivacy (?:policy|notice|statement)\b"), ("terms", r"\bterms (?:of (?:use|service)|and conditions)\b|\buser agreement\b"), ("cookies", r"\bcookie (?:policy|notice)\b|\bcookies? and tracking\b"),
    ("returns", r"\breturns? and refunds?\b|\brefund policy\b"), ("payments", r"\bpayment (?:policy|terms)\b"), ("promotions", r"\b(?:promotion|sale) policy\b"), ("legal", r"\bgrievance\b|\blegal notices?\b"),
)
#: Types with the patterns of a URL that give ten points each.
SCORE_PATTERNS = {
    "privacy": (r"\bprivacy\b", r"\bprivacy-policy\b", r"\bprivacy_policy\b", r"\bprivacypolicy\b", r"\bdata[-_]?privacy\b"),
    "terms": (r"\bterms\b", r"\bterms[-_]?and[-_]?conditions\b", r"\bterms[-_]?of[-_]?use\b", r"\bterms[-_]?of[-_]?service\b", r"\buser[-_]?agreement\b", r"\buser[-_]?terms\b"),
    "cookies": (r"\bcookies?\b", r"\bcookie[-_]?policy\b", r"\bcookie[-_]?notice\b", r"\bcookies[-_]?policy\b"),
    "returns": (r"\breturn[-_]?refund\b", r"\breturns?\b", r"\brefunds?\b", r"\brefund[-_]?policy\b", r"\breturn[-_]?policy\b"),
    "payments": (r"\bpayment\b", r"\bpayments\b", r"\bfees?[-_]?payment\b", r"\bpayment[-_]?policy\b"),
    "promotions": (r"\bpromotion\b", r"\bpromotions\b", r"\bpromo[-_]?policy\b", r"\bsale[-_]?policy\b", r"\boffer[-_]?terms\b"),
    "legal": (r"\blegal[-_]?notices?\b", r"\bnotices?\b", r"\bcorporate[-_]?information\b", r"\bcorp[-_]?info\b", r"\bimprint\b"),
}
#: Types with what gives a search result three points once in its URL, and two points each in URL, title and snippet.
SEARCH_SIGNALS = {
    "terms": (("terms",), ("terms and conditions", "terms of use", "terms of service")), "privacy": (("privacy",), ("privacy policy", "privacy notice")), "cookies": (("cookie",), ("cookie policy", "cookie notice", "cookies")),
    "returns": (("return", "refund", "cancellation"), ("return policy", "refund policy", "cancellation policy")), "payments": (("payment",), ("payment policy", "payment terms")), "legal": (("legal", "disclaimer", "notice"), ("legal notice", "disclaimer")),
}
LABELS = {"terms": "Terms & Conditions", "privacy": "Privacy Policy", "cookies": "Cookie Policy", "returns": "Return & Refund Policy", "payments": "Payment Policy", "promotions": "Promotion Policy", "legal": "Legal"}
READ = 16_000  #: characters of a page that its type is looked for in, a part of the rule


def type_of_page(url: Column, label: Column, content: Column) -> Column:
    """The type that URL and label name, else the one that the start of the page names; '' for none."""
    named = F.lower(F.regexp_replace(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(label, F.lit(""))), r"(?U)\s+", " "))
    body = F.lower(text.collapsed(F.substring(F.coalesce(content, F.lit("")), 1, READ)))
    both = F.concat_ws(" ", named, body)
    out = F
    for name, pattern in PAGE_PATTERNS.items():
        out = out.when(named.rlike(pattern), F.lit(name))
    out = out.when(body == "", F.lit(""))
    for name, pattern in CONTENT_PATTERNS:
        out = out.when(both.rlike(pattern), F.lit(name))
    return out.otherwise("")


def type_scores(url: Column) -> Column:
    """(type, score): ten points for each pattern of a type that a URL has; the best type, of equals the first; assets, nulls
    and URLs without points are ``unknown``."""
    low = F.lower(url)
    asset = low.rlike(r"\.(?:" + "|".join(ASSETS) + r")(?:$|\?)")
    points = {name: sum((low.rlike(p).cast("int") for p in patterns), F.lit(0)) * 10 for name, patterns in SCORE_PATTERNS.items()}
    best = F.array_max(F.array(*(F.struct(s.alias("score"), F.lit(-k).alias("place"), F.lit(name).alias("type")) for k, (name, s) in enumerate(points.items()))))
    fine = F.coalesce(~asset & (best["score"] > 0), F.lit(False))
    return F.struct(F.when(fine, best["type"]).otherwise("unknown").alias("type"), F.when(fine, best["score"]).otherwise(0).alias("score"))


def search_score(url: Column, title: Column, snippet: Column, policy_type: Column) -> Column:
    """Points of a search result for a type: three if its URL names it, two for each phrase of the type; results from three on are kept."""
    low = F.lower(F.coalesce(url, F.lit("")))
    found = F.lower(F.concat_ws(" ", *(F.coalesce(x, F.lit("")) for x in (url, title, snippet))))
    out = F
    for name, (words, phrases) in SEARCH_SIGNALS.items():
        out = out.when(policy_type == name, text.has_any(low, words).cast("int") * 3 + text.hits(found, phrases) * 2)
    return out.otherwise(0)


#: First segments of a shop's paths, under which no policy is looked for; phrases of a shop's pages.
SHOP_PATHS = ("s", "product", "products", "p", "shop", "search", "category", "categories", "collection", "collections", "brand", "brands", "sale", "offer", "offers", "campaign", "campaigns", "catalog", "catalogue", "beauty", "skin", "makeup", "hair", "bath", "body")
SHOP_SIGNALS = ("add to cart", "add to bag", "shop now", "buy now", "new arrivals", "best sellers", "sort by", "wishlist")


def type_of_path(url: Column) -> Column:
    """``type_of_url``, but '' below a shop's paths and for null."""
    first = F.get(F.filter(F.split(F.lower(urls.part(url, 3)), "/"), lambda x: x != ""), F.lit(0))
    return F.when(url.isNull() | F.coalesce(first.isin(*SHOP_PATHS), F.lit(False)), "").otherwise(type_of_url(url))


def coarse_type(url: Column, label: Column) -> Column:
    """The type that a link's URL and label name at a glance; ``legal`` for none."""
    named = F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(label, F.lit(""))))

    def has(*words: str) -> Column:
        return text.has_any(named, words)

    return F.when(has("privacy"), "privacy").when(has("cookie"), "cookies").when(has("refund", "return"), "returns").when(has("terms", "conditions"), "terms").otherwise("legal")


def label(policy_type: Column) -> Column:
    """What a type is called where it is shown; ``Other`` for those without a name."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))[policy_type], F.lit("Other"))


def level(score: Column) -> Column:
    """Level of a score: above 80 high, from 45 medium, else low; null for null."""
    return F.when(score > 80, "high").when(score >= 45, "medium").when(score.isNotNull(), "low")


def rule_titles(low: Column, lexicon: Lexicon = POLICY) -> Column:
    """Titles of the clause rules of which any pattern occurs in a text (collapsed, in lower case), in the rules' order."""
    hits = [F.when(possible(low, title, lexicon) & low.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(title)) for title, _, patterns in lexicon.rules]
    return F.array_compact(F.array(*hits))


def possible(low: Column, title: str, lexicon: Lexicon = POLICY) -> Column:
    """Whether a text has any of a rule's cues, which are far cheaper to look for than its patterns."""
    found = F.lit(False)
    for cue in lexicon.cues.get(title, ("",)):
        found = found | F.contains(low, F.lit(cue))
    return found
