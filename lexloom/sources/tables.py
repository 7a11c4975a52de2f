"""Tables of a data folder, one Parquet file or directory each."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table ``name`` below ``base``; columns are pruned by Catalyst, so nothing is read that a plan does not use."""
    return spark.read.parquet(f"{base}/{name}.parquet")
