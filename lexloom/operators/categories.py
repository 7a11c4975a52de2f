"""The category of a clause: what its words say, and how that is reconciled with a category proposed by a model."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import text as t
from lexloom.operators import filters
from lexloom.operators import lexicon as lx

_POLICY = r"\b(?:policy|terms|agreement|notice)\b"
#: Patterns over classifier_form: a clause about changes of the policy itself; one about the law that governs.
CHANGES = rf"\b(?:chang(?:e|es)|modif(?:y|ication)|updates?|amend|amendments?|revis(?:e|ions?)|replace)\b.{{0,160}}{_POLICY}|{_POLICY}.{{0,160}}\b(?:from time to time|periodically|occasionally)\b|{_POLICY}.{{0,180}}\breflect(?:ing)? (?:changes|updates|revisions)\b"
GOVERNING = r"\bgoverned (?:by|in accordance with)\b|\bgoverning law\b|\blaws? of\b|\bjurisdiction\b|\bcourts? (?:of|in|at)\b|\bvenue\b|\bdispute resolution\b|\bproper law\b"
REFUNDED = r"\brefund(?:s|ed|ing)?\b|\breimburse(?:ment|ments|d)?\b|\bnon[- ]refundable\b|\bmoney back\b"
RENEWED = r"\bautomatically renew(?:s|ed|ing)?\b|\bauto[- ]renew(?:al)?\b|\b(?:subscription|plan|service|membership)\b.{0,180}\brenew(?:s|ed|al)?\b"


def suggested(form: Column) -> Column:
    """The category that the words of a text (in classifier_form) suggest; ``other`` for none, null and blank.

    Specific categories come before broad ones; a clause about changes of the policy is ``other`` whatever it mentions."""

    def word(name: str) -> Column:
        return t.has_word(form, lx.CATEGORY_WORDS[name])

    invested = t.has_word(form, tuple(f"{x} {y}" for x in lx.INVESTING for y in lx.SUBSCRIBING[0]))
    subscribed = ~invested & (t.has_word(form, lx.MEMBERSHIP) | (t.has_word(form, lx.SUBSCRIBING[0]) & t.has_word(form, lx.SUBSCRIBING[1])))
    out = (
        F.when(form.isNull() | (form == "") | form.rlike(CHANGES), "other")
        .when(t.has_word(form, lx.RENEWING[0]) & t.has_word(form, lx.RENEWING[1]), "auto_renewal")
        .when(word("refund"), "refund")
        .when(word("age_requirement"), "age_requirement")
        .when(t.has_word(form, lx.SHARING[0]) & t.has_word(form, lx.SHARING[1]), "data_sharing")
        .when(t.has_word(form, lx.COLLECTING[0]) & t.has_word(form, lx.COLLECTING[1]), "data_collection")
        .when(subscribed, "subscription")
    )
    for name in ("cancellation", "arbitration", "indemnification"):
        out = out.when(word(name), name)
    out = out.when(form.rlike(GOVERNING), "governing_law")
    for name in ("intellectual_property", "prohibited_use", "license", "liability", "warranty", "termination", "tracking", "security", "privacy", "payments"):
        out = out.when(word(name), name)
    return out.otherwise("other")


def reconciled(proposed: Column, form: Column, found: Column) -> Column:
    """A proposed category (of the domain), corrected where the text (in classifier_form, with its suggested category ``found``) speaks against it."""
    invested = filters.is_investment()  # over ``low``
    refund = F.when(invested & (found == "payments"), "payments").when(invested & ~form.rlike(REFUNDED), "payments").when(found == "payments", "payments").when((found == "other") & ~form.rlike(REFUNDED), "other")
    subscription = F.when(found == "payments", "payments").when(invested, "other")
    renewal = F.when(invested & (found == "payments"), "payments").when(invested, "other").when(found.isin("payments", "other") & ~form.rlike(RENEWED), found)
    collection = F.when((found == "other") & form.rlike(CHANGES), "other")
    law = F.when(~form.rlike(GOVERNING), F.when(found != "other", found).when(t.has_any(form, ("personal information", "personal data", "privacy", "data controller", "data protection")), "privacy").otherwise("other"))
    corrected = F.when(proposed == "refund", refund).when(proposed == "subscription", subscription).when(proposed == "auto_renewal", renewal).when(proposed == "data_collection", collection).when(proposed == "governing_law", law).when(proposed == "other", found)
    return F.coalesce(corrected, proposed)


def retitled(title: Column, proposed: Column, category: Column) -> Column:
    """A clause's title, exchanged for that of its category where the category was corrected or the title names another subject."""
    low = F.lower(title)
    own = F.coalesce(F.create_map(*(F.lit(x) for pair in lx.CATEGORY_TITLES.items() for x in pair))[category], title)
    named = F.exists(F.split(category, "_"), lambda w: F.contains(low, w))
    return (
        F.when(F.contains(low, F.lit("policy change")) & (category != "other"), own)
        .when(F.contains(low, F.lit("license")) & ~category.isin("license", "other"), own)
        .when(F.contains(low, F.lit("data collection")) & (category == "other"), "Policy Changes")
        .when(F.contains(low, F.lit("governing law")) & (category != "governing_law"), own)
        .when((category != proposed) & ~named, own)
        .otherwise(title)
    )
