"""Risk factors of a clause: found in its text, joined with declared ones, near-synonyms suppressed, weights added up."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as t
from lexloom.operators import classify
from lexloom.operators.lexicon import POLICY, Lexicon

TEXT_FIELDS = ("title", "summary", "explanation", "risk_reason", "source_text")
LEAST, MOST = 5, 100


def clause_text(df: DataFrame, fields: tuple[str, ...] = TEXT_FIELDS) -> Column:
    """What a clause is scored by: the fields it has, joined by spaces, lower case, white space single. Generated wording counts too."""
    return t.collapsed(F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in fields if c in df.columns))))


def inferred(low: Column, lexicon: Lexicon = POLICY) -> Column:
    """Factors whose pattern occurs in a lower-cased text, in the lexicon's order."""
    return F.array_compact(F.array(*(F.when(low.rlike(pattern), F.lit(name)) for name, (_, pattern) in lexicon.factors.items())))


def declared(factors: Column, lexicon: Lexicon = POLICY) -> Column:
    """Given factors, trimmed and lower-cased, those the lexicon knows, each once; null gives none."""
    known = F.array(*(F.lit(x) for x in lexicon.factors))
    given = F.transform(F.coalesce(factors, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(given, lambda x: F.array_contains(known, x)))


def weight_of(factor: Column, lexicon: Lexicon = POLICY) -> Column:
    """A factor's weight, 0 for an unknown one."""
    return F.coalesce(F.create_map(*(F.lit(x) for name, (w, _) in lexicon.factors.items() for x in (name, w)))[factor], F.lit(0))


def suppressed(factors: Column, lexicon: Lexicon = POLICY) -> Column:
    """``factors`` without those of a group that are not its strongest (the first of equals), but for the ones always kept.

    A factor is in one group, so the groups do not touch each other."""
    group_of = {name: k for k, group in enumerate(lexicon.groups) for name in group}
    groups = F.create_map(*(F.lit(x) for pair in group_of.items() for x in pair))
    kept = F.array(*(F.lit(x) for x in lexicon.kept))
    # a factor goes if another of its group is stronger, or as strong and found before it
    rank = F.transform(factors, lambda f, i: F.struct(f.alias("f"), groups[f].alias("g"), (weight_of(f, lexicon) * 1000 - i).alias("w")))
    return F.transform(F.filter(rank, lambda x: x["g"].isNull() | F.array_contains(kept, x["f"]) | ~F.exists(rank, lambda y: y["g"].eqNullSafe(x["g"]) & (y["w"] > x["w"]))), lambda x: x["f"])


def scored(df: DataFrame, lexicon: Lexicon = POLICY, given: str | None = None) -> DataFrame:
    """``df`` and risk_factors, factor_score (5 to 100), factor_level of each clause; ``given`` names a column of declared factors.

    A clause without any text or factor has the least score."""
    low = df.withColumn("_low", F.explode(F.array(clause_text(df))))
    found = inferred(F.col("_low"), lexicon)
    both = F.array_union(declared(F.col(given), lexicon), found) if given else found
    named = low.withColumn("_factors", F.explode(F.array(both))).drop("_low")
    chosen = named.withColumn("risk_factors", suppressed(F.col("_factors"), lexicon)).drop("_factors")
    total = F.aggregate("risk_factors", F.lit(0), lambda s, f: s + weight_of(f, lexicon))
    score = F.least(F.greatest(total, F.lit(LEAST)), F.lit(MOST))
    return chosen.withColumn("factor_score", score).withColumn("factor_level", classify.level(F.col("factor_score")))
