"""Pairs of rows that share a bucket, without a task that holds a whole bucket."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512  #: rows of a bucket that meet in one piece


def meet(rows: DataFrame, bucket: str, key: str, names: list[str], block: int = BLOCK) -> DataFrame:
    """key_x, key_y and names_x, names_y: each pair of rows (key_x < key_y) of a bucket, once for each bucket they share.

    Buckets are counted with a map-side combine; a bucket of over ``block`` rows is cut into blocks that meet pairwise, so
    the work of a frequent bucket is spread. Rows whose bucket or key is null meet nothing; copies of a row meet as it does."""
    base = rows.where(F.col(bucket).isNotNull() & F.col(key).isNotNull())
    sizes = base.groupBy(bucket).agg(F.count("*").alias("_n")).where("_n > 1")
    held = base.join(sizes, bucket).withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int")).withColumn("_own", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    x = held.select(bucket, F.col("_own").alias("_i"), F.explode(F.sequence("_own", F.col("_blocks") - 1)).alias("_j"), *(F.col(c).alias(f"{c}_x") for c in (key, *names)))
    y = held.select(bucket, F.explode(F.sequence(F.lit(0), "_own")).alias("_i"), F.col("_own").alias("_j"), *(F.col(c).alias(f"{c}_y") for c in (key, *names)))
    met = x.join(y, [bucket, "_i", "_j"]).where(((F.col("_i") < F.col("_j")) & (F.col(f"{key}_x") != F.col(f"{key}_y"))) | (F.col(f"{key}_x") < F.col(f"{key}_y")))
    swap = F.col(f"{key}_x") > F.col(f"{key}_y")
    columns = []
    for c in (key, *names):
        columns += [F.when(swap, F.col(f"{c}_y")).otherwise(F.col(f"{c}_x")).alias(f"{c}_x"), F.when(swap, F.col(f"{c}_x")).otherwise(F.col(f"{c}_y")).alias(f"{c}_y")]
    return met.select(*columns)


def first_of(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
