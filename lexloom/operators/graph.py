"""Connected components of a graph given by its edges, by joins alone."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.cluster import discard, durable

ROUNDS = 60


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the least node of its component) for every node of ``edges``.

    Alternating large-star and small-star steps: every step replaces the edges by no more edges, so hubs do not grow,
    and the number of steps grows with the logarithm of the longest path. Each step is a table in the shared folder.
    Loops and repeated edges are ignored; an empty graph has no rows.
    """
    pairs = edges.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u != v")
    now = durable(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    for _ in range(ROUNDS):
        # large star: a node's larger neighbours are linked to the least of its neighbours and itself
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: a node and its smaller neighbours are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        last, now = now, durable(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
        discard(last)
        before, mark = mark, _mark(now)
        if before == mark:
            break
    else:
        raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct())


def _mark(df: DataFrame) -> tuple:
    """A number that tells one set of edges from another."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h
