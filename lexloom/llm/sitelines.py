"""Problem 2: lines that one site repeats in many of its pages.

Duplicate pages of a site are collapsed first (by the keys of their lines); each line is then counted once per cluster of
duplicates, weighted by the cluster's rows, so a line's rows, clusters and days are all known. A third of all rows in
one site, or one line in a third of all rows, are no hot spot: counting has a map-side combine by (site, line), and
repeated lines are spread over SALT keys before they meet the pages again.

Cases: rows without a url, with a null or an empty content have no lines; lines without letters and digits are left out;
a line that stands twice in a page counts once for it and is removed at both places.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_ROWS = 8
SALT = 16


def site_of(url: Column) -> Column:
    """Host in lower case without user, port and a leading ``www.``; null where there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def _lines(df: DataFrame) -> DataFrame:
    """scrape_id, site, day, keys: one key a line, null for a line without letters and digits."""
    bare = F.split(F.regexp_replace(F.lower("content"), r"[^\p{L}\p{N}\n]+", ""), "\n")
    # 96 bits a line, and the site in it
    key = F.transform(bare, lambda x: F.when(x != "", F.struct(F.xxhash64("site", x).alias("a"), F.hash(x, F.lit(7)).alias("b"))))
    return df.select("scrape_id", site_of(F.col("url")).alias("site"), F.to_date("scraped_at").alias("day"), "content").where("site is not null and length(content) > 0").select("scrape_id", "site", "day", key.alias("keys"))


def line_counts(df: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """a, b (a line's key), n_rows, n_clusters of lines that stand in at least ``least`` rows of their site."""
    lines = _lines(df)
    distinct = F.array_distinct(F.filter("keys", lambda x: x.isNotNull()))
    clusters = lines.select(distinct.alias("keys")).groupBy(F.xxhash64("keys").alias("h1"), F.hash("keys", F.lit(11)).alias("h2")).agg(F.count("*").alias("w"), F.first("keys").alias("keys"))
    return (
        clusters.select("w", F.explode("keys").alias("k")).groupBy("k.a", "k.b").agg(F.sum("w").alias("n_rows"), F.count("*").alias("n_clusters")).where(F.col("n_rows") >= least)
    )


def repeated_lines(df: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """scrape_id, site, line_no, day, a, b, n_rows, n_clusters of every line to be removed."""
    salt = F.pmod(F.xxhash64("scrape_id"), F.lit(SALT)).cast("int")
    each = _lines(df).select("scrape_id", "site", "day", salt.alias("salt"), F.posexplode("keys").alias("n", "k")).where("k is not null").select("scrape_id", "site", "day", "salt", (F.col("n") + 1).alias("line_no"), "k.a", "k.b")
    found = line_counts(df, least).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return each.join(found, ["a", "b", "salt"]).drop("salt")


def cleaned(df: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """scrape_id, n_removed, content: every page with a content, without the lines its site repeats (``\\n`` between the rest).

    Here clusters of duplicate pages decide, not rows: a line in ``least`` rows that are copies of one page (an article
    published again) is no boilerplate and stays."""
    gone = repeated_lines(df, least).where(F.col("n_clusters") >= least).groupBy("scrape_id").agg(F.collect_set("line_no").alias("gone"))
    base = df.where(F.length("content") > 0).select("scrape_id", F.split("content", "\n").alias("lines"))
    kept = F.filter("lines", lambda x, i: ~F.coalesce(F.array_contains("gone", i + 1), F.lit(False)))
    return base.join(gone, "scrape_id", "left").select("scrape_id", F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"), F.array_join(kept, "\n").alias("content"))


def line_report(df: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """site, a, b, n_rows, n_clusters, n_days, boilerplate: the repeated lines with the days on which their pages were fetched, and
    whether ``cleaned`` takes them out."""
    day = repeated_lines(df, least).groupBy("site", "a", "b", "day").agg(F.max("n_rows").alias("n_rows"), F.max("n_clusters").alias("n_clusters"))
    each = day.groupBy("site", "a", "b").agg(F.max("n_rows").alias("n_rows"), F.max("n_clusters").alias("n_clusters"), F.count("day").alias("n_days"))
    return each.withColumn("boilerplate", F.col("n_clusters") >= least)
