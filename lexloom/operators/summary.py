"""What a reader sees of an analysis: titles of clauses, documents kept for a site, the summary of a run."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text, urls
from lexloom.operators import lexicon as lx
from lexloom.operators import scores
from lexloom.operators.pairs import first_of

LONGEST_TITLE, MOST_DOCUMENTS, COMPARED = 60, 20, 5000
#: Words of a clause that give it a title where it has none and its category says nothing; the first that occurs. Fixed values.
TITLE_WORDS = {"cookie": "Cookies and Tracking", "refund": "Cancellation and Refund Policy", "arbitration": "Arbitration", "liab": "Limitation of Liability", "terminat": "Account Termination", "privacy": "Privacy Policy", "payment": "Payment Obligations"}
BLANK_TITLES = ("", "clause", "untitled", "untitled clause", "n/a", "unknown", "other")


def display_title(title: Column, category: Column, source: Column) -> Column:
    """A clause's title if it has a real one, else its category's, else one by a word of its text, else ``Clause``; at most 60 characters."""
    flat = text.collapsed(title)
    own = F.when(~F.lower(flat).isin(*BLANK_TITLES), flat)
    labels = {k: v for k, v in lx.CATEGORY_TITLES.items() if k != "other"}
    named = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))[F.lower(F.trim(category))]
    by_word = F.coalesce(*(F.when(F.contains(F.lower(source), F.lit(word)), F.lit(name)) for word, name in TITLE_WORDS.items()))
    chosen = F.coalesce(own, named, by_word, F.lit("Clause"))
    return F.when(F.length(chosen) > LONGEST_TITLE, F.concat(F.rtrim(F.substring(chosen, 1, LONGEST_TITLE - 1)), F.lit("…"))).otherwise(chosen)


def site_documents(df: DataFrame, site: str, key: str, url: str, content: str, most: int = MOST_DOCUMENTS) -> DataFrame:
    """site, key, url, place: the documents kept for a site: of one URL the first, of one beginning (COMPARED characters, collapsed,
    lower case) the first, then the first ``most`` in order of arrival (by key): the limit is the feature. Empty contents are left out."""
    base = df.where(F.length(content) > 0).select(site, key, F.coalesce(urls.canonical_with_query(F.col(url)), F.lit("")).alias("url"), F.xxhash64(F.substring(text.collapsed(F.lower(content)), 1, COMPARED)).alias("start"))
    once = first_of(first_of(base, [F.col(site), F.col("url")], [F.col(key)]), [F.col(site), F.col("start")], [F.col(key)])
    return once.withColumn("place", F.row_number().over(Window.partitionBy(site).orderBy(key))).where(F.col("place") <= most).drop("start")


def summarised(clauses: DataFrame, evidence: DataFrame, group: str) -> DataFrame:
    """group, overall_score, critical, high, medium, low, findings of runs.

    The score is that of the evidence (group, clause_id, factor_score) where the group has any, else that of its clauses
    (group, row_id, risk_score, risk_level, title, risk_reason); the counts and the first 8 findings come from the clauses."""
    by_evidence = scores.overall(evidence, group, "factor_score", "clause_id").select(group, F.col("overall_top").alias("_e"))
    by_clauses = scores.overall(clauses, group, "risk_score", "row_id").select(group, F.col("overall_top").alias("_c"))
    level = F.lower("risk_level")
    worst = first_rows(clauses.where(level.isin("high", "critical")), group, 8)
    counts = clauses.groupBy(group).agg(*(F.count_if(level == x).alias(x) for x in ("critical", "high", "medium", "low")))
    both = counts.join(by_clauses, group, "left").join(by_evidence, group, "left").join(worst, group, "left")
    return both.select(group, F.coalesce("_e", "_c", F.lit(0)).alias("overall_score"), "critical", "high", "medium", "low", F.coalesce("findings", F.array().cast("array<string>")).alias("findings"))


def first_rows(clauses: DataFrame, group: str, most: int) -> DataFrame:
    """group, findings: ``title: reason`` of the ``most`` clauses of highest score (then by row_id), in that order."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last("risk_score"), "row_id")
    top = clauses.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    said = F.concat(F.coalesce("title", F.lit("")), F.lit(": "), F.coalesce("risk_reason", F.lit("")))
    return top.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_n", said.alias("f")))).alias("_f")).select(group, F.transform("_f", lambda x: x["f"]).alias("findings"))
