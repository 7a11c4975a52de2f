"""First-wins and longest-wins dedupe by key; one shuffle on the key each, hot keys cut by the rank limit on the map side."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order`` (which must be total). Rows with a null key are a key of their own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def without_locale_copies(df: DataFrame, url: str, family: str) -> DataFrame:
    """Without the rows whose ``family`` (a canonical URL) is another row's ``url``."""
    bases = df.select(F.col(url).alias("_base")).where("_base is not null").distinct()
    return df.join(bases, df[family] == F.col("_base"), "left_anti")
