"""The whole analysis as one lazy plan: documents, chunks, rule hits, scores by run."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text, urls
from lexloom.operators import chunks, classify, dedupe, scores
from lexloom.operators.lexicon import POLICY, Lexicon


def documents(scrapes: DataFrame) -> DataFrame:
    """Pages to documents: canonical URL, type, fingerprint; the first page of a fingerprint in a site stays."""
    base = scrapes.where(urls.is_http(F.col("url")) & (F.length("content") > 0))
    base = base.select("scrape_id", urls.host(F.col("url")).alias("site"), urls.canonical(F.col("url")).alias("url"), "type", "content")
    named = classify.document_type(F.col("type"))
    base = base.withColumn("type", F.when(named == "other", classify.type_of_url(F.col("url"))).otherwise(named)).withColumn("fingerprint", text.fingerprint(F.col("content")))
    return dedupe.first_by(base, [F.col("site"), F.col("fingerprint")], [F.col("scrape_id")])


def top_chunks(docs: DataFrame, lexicon: Lexicon = POLICY) -> DataFrame:
    """site, url, type, chunk_index, scrape_id, relevance, rank: the chunks of a site that are analysed.

    Chunks without any relevance are left out where the site has others; texts of under 220 characters have none."""
    parts = chunks.chunks(docs.where(F.length("content") >= 220), ["site", "url", "type", "scrape_id"], "content")
    scored = chunks.with_relevance(parts, "chunk", lexicon).select("site", "url", "type", "scrape_id", "chunk_index", "relevance")
    order = [F.desc("relevance"), F.col("url"), F.col("type"), F.col("chunk_index"), F.col("scrape_id")]
    taken = chunks.selected(scored, ["site"], ["url"], order)
    best = F.max("relevance").over(Window.partitionBy("site"))
    return taken.withColumn("_best", best).where("relevance > 0 or _best = 0").drop("_best")


def run_scores(clauses: DataFrame) -> DataFrame:
    """run_id, overall_top, overall_weighted, level of each run, over its clauses delivered once."""
    once = dedupe.first_by(clauses.where("run_id is not null").select("run_id", "clause_id", "row_id", "risk_score"), [F.col("run_id"), F.col("clause_id")], [F.col("row_id")])
    both = scores.overall(once, "run_id", "risk_score", "row_id")
    return both.withColumn("level", classify.level(F.col("overall_top")))
