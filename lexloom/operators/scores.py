"""Scores of runs from the scores of their clauses, and answers bound back to clauses."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (0.40, 0.25, 0.15, 0.10, 0.10)  #: of the five highest scores


def overall(df: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """group, overall_top (half-even mean of the five highest positive scores, at most 100), overall_weighted (WEIGHTS over
    the five highest scores, renormalised). Groups without a score have 0; null scores count as absent."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(score), tie)
    best = df.select(group, score, tie).withColumn("n", F.row_number().over(w)).where("n <= 5")
    weight = F.get(F.array(*(F.lit(x) for x in WEIGHTS)), F.col("n") - 1)
    top = F.avg(F.when(F.col(score) > 0, F.col(score)))
    weighted = F.sum(F.col(score) * weight) / F.sum(F.when(F.col(score).isNotNull(), weight))
    return best.groupBy(group).agg(F.least(F.lit(100), F.bround(F.coalesce(top, F.lit(0.0))).cast("int")).alias("overall_top"), F.bround(F.coalesce(weighted, F.lit(0.0))).cast("int").alias("overall_weighted"))


def rebound(expected: DataFrame, answers: DataFrame, group: str) -> DataFrame:
    """group, position, clause_id, answer: answers (group, position, clause_id, answer) bound to expected (group, position, clause_id).

    Each answer is used once. Of the answers with an expected id the first takes the first position of that id, the second
    the second, and so on; the answers that are left take, in order, the positions that are left; surplus ones are dropped,
    positions without an answer are absent. All by joins on (group, rank); a null id is expected by none."""
    turn = Window.partitionBy(group, "clause_id").orderBy("position")
    wanted = expected.select(group, "clause_id", F.row_number().over(turn).alias("_n"), F.col("position").alias("_to"))
    given = answers.select(group, "clause_id", F.row_number().over(turn).alias("_n"), F.col("position").alias("_at"), F.struct("answer").alias("_a"))
    met = wanted.join(given, [group, "clause_id", "_n"], "full_outer")
    kind = F.when(F.col("_at").isNull(), "free").when(F.col("_to").isNull(), "spare").otherwise("exact")
    sorted_ = met.withColumn("_kind", kind).withColumn("_k", F.row_number().over(Window.partitionBy(group, "_kind").orderBy(F.coalesce("_to", "_at"))))
    # the k-th free position and the k-th spare answer of a group become one row
    slot = F.when(F.col("_kind") == "exact", F.lit("exact")).otherwise("rest")
    rows = sorted_.groupBy(group, slot.alias("_slot"), "_k").agg(F.max(F.when(F.col("_to").isNotNull(), F.struct("_to", "clause_id"))).alias("f"), F.max(F.when(F.col("_at").isNotNull(), F.col("_a"))).alias("s"))
    return rows.where("f is not null and s is not null").select(group, F.col("f._to").alias("position"), "f.clause_id", "s.answer")
