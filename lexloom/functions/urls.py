"""URL operators as column expressions; all narrow, all inside code generation."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.operators.lexicon import ASSETS, BAD_URL_WORDS, BLOCKED_SEGMENTS, COMMERCE_PATHS, POLICY_PATH_WORDS, STRONG_PATH_WORDS

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def part(url: Column, n: int) -> Column:
    """Part ``n`` of an absolute URL (1 scheme, 2 authority, 3 path, 4 query with ``?``, 5 fragment with ``#``); '' if absent."""
    return F.regexp_extract(F.trim(url), _PARTS, n)


def host(url: Column) -> Column:
    """Host in lower case without user, port and ``www.``; '' where there is none."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(part(url, 2)), r"^.*@", ""), r":\d*$", "")
    return F.regexp_replace(bare, r"^www\.", "")


def canonical(url: Column) -> Column:
    """scheme://authority/path in lower case, without closing slashes, query and fragment; null for what is no http(s) URL."""
    base = F.lower(F.concat(part(url, 1), F.lit("://"), part(url, 2), part(url, 3)))
    return F.when(is_http(url), F.regexp_replace(base, "/+$", ""))


def canonical_with_query(url: Column) -> Column:
    """The URL up to ``#`` in lower case, without closing slashes; the query stays. Null stays null."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.trim(url), "#.*$", "")), "/+$", "")


def is_http(url: Column) -> Column:
    """Whether it is http or https with a host; null counts as not."""
    return F.coalesce(F.trim(url).rlike(r"^(?i:https?)://[^/?#]+"), F.lit(False))


def is_pdf(url: Column) -> Column:
    path = F.lower(part(url, 3))
    return F.coalesce(path.rlike(r"\.pdf$") | F.contains(path, F.lit(".pdf/")), F.lit(False))


def _without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; what climbs above the root is dropped."""
    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))).when(x == ".", out).otherwise(F.concat(out, F.array(x))))
    folder = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.when(F.contains(path, F.lit("/.")), F.concat(F.array_join(kept, "/"), folder)).otherwise(path)


def resolve(base: Column, link: Column) -> Column:
    """A link made absolute on its page: absolute, ``//host``, ``/path``, ``?query`` or relative to the page's folder, with
    ``.`` and ``..`` followed; without fragment. Null for other schemes, blanks and links of a page that is no http(s) URL."""
    link = F.regexp_replace(F.trim(link), "#.*$", "")
    origin = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(part(base, 3), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    path, query = F.regexp_extract(link, r"^([^?]*)(\?.*)?$", 1), F.regexp_extract(link, r"^([^?]*)(\?.*)?$", 2)
    return (
        F.when((link == "") | link.isNull() | ~is_http(base), F.lit(None))
        .when(link.rlike("^(?i:https?)://[^/?#]"), link)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(part(base, 1), F.lit(":"), link))
        .when(link.startswith("?"), F.concat(origin, F.coalesce(F.nullif(part(base, 3), F.lit("")), F.lit("/")), link))
        .when(link.startswith("/"), F.concat(origin, _without_dots(path), query))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, path)), query))
    )


def same_site(a: Column, b: Column) -> Column:
    """Whether host ``b`` is host ``a`` or below it."""
    return (a != "") & ((a == b) | F.endswith(b, F.concat(F.lit("."), a)))


def locale_family(url: Column) -> Column:
    """For a path ``/policy/<two letters>/rest`` or ``/policies/…`` the canonical URL without the locale, else ''."""
    path = F.regexp_replace(F.lower(part(url, 3)), "/+", "/")
    pattern = r"^/(policy|policies)/[a-z]{2}(/[^/].*)$"
    short = F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), F.regexp_replace(path, pattern, "/$1$2"))
    return F.coalesce(F.when(is_http(url) & path.rlike(pattern), F.regexp_replace(short, "/+$", "")), F.lit(""))


def parameter(url: Column, name: str) -> Column:
    """The first value of a query parameter, percent-decoded; null where it is absent, blank or wrongly coded."""
    raw = F.regexp_replace(F.regexp_extract(part(url, 4), rf"[?&]{name}=([^&#]*)", 1), r"\+", " ")
    return F.nullif(F.trim(F.try_url_decode(raw)), F.lit(""))


def unwrap_search(url: Column) -> Column:
    """The target of a search engine's redirect: Bing's base64 ``u``, DuckDuckGo's ``uddg``, Google's ``url``, ``q`` or ``u``.

    A redirect of the first two without a target gives ''; so does what is no http(s) URL; any other URL stays."""
    site = F.lower(part(url, 2))

    def http(x: Column) -> Column:
        return F.when(x.rlike("^https?://"), x)

    coded = parameter(url, "u")
    bare = F.regexp_replace(coded, "^a1", "")
    padded = F.rpad(F.translate(bare, "-_", "+/"), (F.ceil(F.length(bare) / 4) * 4).cast("int"), F.lit("="))
    bing = F.coalesce(http(F.try_to_binary(padded, F.lit("base64")).cast("string")), http(coded), F.lit(""))
    google = F.coalesce(*(http(parameter(url, k)) for k in ("url", "q", "u")), http(url), F.lit(""))
    return (
        F.when(F.contains(site, F.lit("bing.com")) & part(url, 3).startswith("/ck/a"), bing)
        .when(F.contains(site, F.lit("duckduckgo.com")) & parameter(url, "uddg").isNotNull(), F.coalesce(http(parameter(url, "uddg")), F.lit("")))
        .when(F.contains(site, F.lit("google.com")), google)
        .otherwise(F.coalesce(http(url), F.lit("")))
    )


def candidate(url: Column, href: Column, source_url: Column) -> Column:
    """The first non-blank of three columns, absolute on ``source_url``, scheme and host in lower case, without parameters of
    the path and fragment; null for what is no http(s) URL."""
    first = F.coalesce(*(F.nullif(F.trim(x), F.lit("")) for x in (url, href, source_url)))
    whole = F.coalesce(resolve(source_url, first), F.when(is_http(first), first))
    path = F.regexp_replace(part(whole, 3), ";[^/]*$", "")
    return F.when(is_http(whole), F.concat(F.lower(part(whole, 1)), F.lit("://"), F.lower(part(whole, 2)), path, part(whole, 4)))


def canonical_search(url: Column) -> Column:
    """Scheme and host in lower case without user and default port, the path as it is without closing slashes (``/`` if empty),
    the query kept, no fragment; '' for what has no scheme or host."""
    scheme, authority = F.lower(part(url, 1)), F.regexp_replace(F.lower(part(url, 2)), "^.*@", "")
    default = ((scheme == "http") & authority.rlike(":80$")) | ((scheme == "https") & authority.rlike(":443$"))
    site = F.when(default | authority.rlike(":0*$"), F.regexp_replace(authority, r":\d*$", "")).otherwise(authority)
    path = F.regexp_replace(part(url, 3), ";[^/]*$", "")
    path = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    return F.coalesce(F.when((scheme != "") & (site != ""), F.concat(scheme, F.lit("://"), site, path, F.nullif(part(url, 4), F.lit("?")))), F.when((scheme != "") & (site != ""), F.concat(scheme, F.lit("://"), site, path)), F.lit(""))


def root_domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(F.regexp_replace(F.lower(host), r"^\.+|\.+$", ""), ".", -2)


def same_root(a: Column, b: Column) -> Column:
    """Whether two hosts have their last two labels in common; blank hosts never do."""
    return F.coalesce((a != "") & (b != "") & (root_domain(a) == root_domain(b)), F.lit(False))


def is_pdf_body(body: Column) -> Column:
    """Whether ``%PDF-`` stands in the first 1,024 bytes of a binary."""
    return F.coalesce(F.instr(F.decode(F.substring(body, 1, 1024), "ISO-8859-1"), "%PDF-") > 0, F.lit(False))


def compact_path(url: Column) -> Column:
    """The path's letters and digits (ASCII), in lower case."""
    return F.regexp_replace(F.lower(part(url, 3)), "[^a-z0-9]+", "")


def is_commerce(url: Column) -> Column:
    """Whether a path has a segment of a shop or service; a null or empty URL counts as one."""
    found = F.lower(part(url, 3)).rlike("/(?:" + "|".join(COMMERCE_PATHS) + ")(?:/|$)")
    return F.coalesce((F.trim(url) == "") | found, F.lit(True))


def is_blocked(url: Column) -> Column:
    """Whether the route is one of a forum, profile, search or shop; a null or empty URL counts as one."""
    segments = F.filter(F.split(F.lower(part(url, 3)), "/"), lambda x: x != "")
    listed = F.arrays_overlap(segments, F.array(*(F.lit(x) for x in BLOCKED_SEGMENTS)))
    return F.coalesce((F.trim(url) == "") | listed | F.get(segments, F.lit(0)).isin("u", "user", "users"), F.coalesce(F.trim(url) == "", F.lit(True)))


def is_bad_candidate(url: Column) -> Column:
    """Whether a URL has a word of pages that only sound legal, or is an asset."""
    low = F.lower(url)
    asset = F.lower(part(url, 3)).rlike(r"\.(?:" + "|".join(ASSETS) + ")$")
    return F.coalesce(low.rlike("|".join(BAD_URL_WORDS)) | asset, F.lit(False))


def looks_like_policy(url: Column) -> Column:
    """Whether a path names a policy; a shop's path never does."""
    compact = compact_path(url)
    return F.coalesce(~is_commerce(url) & (compact.rlike("|".join(POLICY_PATH_WORDS)) | compact.rlike("policy$")), F.lit(False))


def has_strong_path(url: Column) -> Column:
    """Whether a segment of the path begins with a strong policy word that ends at ``-``, ``_``, ``/`` or the end."""
    return F.coalesce(F.lower(part(url, 3)).rlike("(?:^|/)(?:" + "|".join(STRONG_PATH_WORDS) + ")(?:$|[-_/])"), F.lit(False))
