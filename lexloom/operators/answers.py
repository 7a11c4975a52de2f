"""Answers of a model: read out of raw text, made uniform, bound to clauses, asked for by a pluggable client."""

import json
import re
import time
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import text as t
from lexloom.operators import classify
from lexloom.operators import lexicon as lx

ITEM = "struct<clause_id:string,title:string,category:string,risk_level:string,risk_score:string,summary:string,explanation:string,user_impact:string,recommendation:string,evidence:string,source_text:string>"
#: Categories that answers know; others become ``other``.
ANSWER_CATEGORIES = tuple(c for c in lx.CATEGORIES if c not in ("account", "advertising", "age_requirement", "dispute_resolution", "limitation_of_liability", "third_party_services", "warranty"))
DEFAULTS = {"summary": "No summary provided.", "explanation": "No explanation provided.", "user_impact": "No user impact identified.", "recommendation": "Review this clause carefully.", "evidence": ""}
MOST_CLAUSES, BATCH = 100, 10


def parsed_items(raw: Column) -> Column:
    """The items of a raw answer as an array of ITEM: of an object's ``analyses`` or ``clauses``, of a list, or, where the whole
    cannot be read even after repair (``salvaged_json``), of each object without inner braces that can. Null and garbage give an empty array."""
    bare = t.salvaged_json(raw)
    listed = F.from_json(F.when(bare.startswith("["), bare), f"array<{ITEM}>")
    held = F.from_json(F.when(bare.startswith("{"), bare), f"struct<analyses:array<{ITEM}>,clauses:array<{ITEM}>>")
    each = F.transform(F.regexp_extract_all(F.regexp_replace(raw, r",(\s*[\]}])", "$1"), F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda x: F.from_json(x, ITEM))
    some = F.filter(each, lambda x: x.isNotNull() & F.coalesce(x["clause_id"], x["title"], x["source_text"]).isNotNull())
    return F.coalesce(F.filter(F.coalesce(listed, held["analyses"], held["clauses"]), lambda x: x.isNotNull()), some, F.array().cast(f"array<{ITEM}>"))


def strict_object(raw: Column) -> Column:
    """The JSON object of an answer in a code fence or bare, as a string; null for anything else."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), r"^```(?:json)?", ""), r"```$", ""), r"^\s+|\s+$", "")
    return F.when(F.from_json(bare, "map<string,string>").isNotNull() & F.regexp_replace(bare, r"^\s+", "").startswith("{"), bare)


def score100(raw: Column) -> Column:
    """A score as an integer from 0 to 100; 0 for null and what is no number."""
    return F.coalesce(F.least(F.greatest(raw.try_cast("int"), F.lit(0)), F.lit(100)), F.lit(0))


def score10(raw: Column) -> Column:
    """As ``score100``, from 0 to 10."""
    return F.coalesce(F.least(F.greatest(raw.try_cast("int"), F.lit(0)), F.lit(10)), F.lit(0))


def level100(raw: Column, score: Column) -> Column:
    """A named level (``moderate`` is medium), else the score's: over 80 high, from 45 medium, else low."""
    return F.coalesce(named_level(raw), classify.level(score))


def level10(raw: Column, score: Column) -> Column:
    """A named level, else the score's of 10: up to 2 low, 6 medium, 8 high, else critical."""
    return F.coalesce(named_level(raw), F.when(score <= 2, "low").when(score <= 6, "medium").when(score <= 8, "high").otherwise("critical"))


def named_level(raw: Column) -> Column:
    """The level a string names, trimmed and in any case; null for others."""
    low = F.lower(F.trim(raw))
    return F.when(low == "moderate", "medium").when(low.isin("low", "medium", "high", "critical"), low)


def answer_category(raw: Column) -> Column:
    """A category of ANSWER_CATEGORIES, else ``other``."""
    low = F.lower(F.trim(raw))
    return F.when(low.isin(*ANSWER_CATEGORIES), low).otherwise("other")


def analyses(items: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, clause_id, category, risk_level, risk_score, summary, explanation, user_impact, recommendation, evidence of
    items (keys and the fields of ITEM): trimmed, of their domains, with DEFAULTS for nulls; items without a clause_id are dropped."""
    score = score100(F.col("risk_score"))
    texts = [F.coalesce(F.trim(c), F.lit(d)).alias(c) for c, d in DEFAULTS.items()]
    named = items.where(F.trim("clause_id") != "")
    return named.select(*keys, F.trim("clause_id").alias("clause_id"), answer_category(F.col("category")).alias("category"), level100(F.col("risk_level"), score).alias("risk_level"), score.alias("risk_score"), *texts)


def preserved(found: DataFrame, clauses: DataFrame, group: str) -> DataFrame:
    """``found`` (group, clause_id, category, risk_level, risk_score, …) with the score, level and category of its clause (group,
    position, clause_id, category, risk_level, risk_score) where that has a score or level; of clauses of one id the last counts.

    A left join on (group, clause_id): both sides are as large as the clauses, so neither is broadcast by hand."""
    last = clauses.groupBy(group, "clause_id").agg(F.max_by(F.struct("category", "risk_level", "risk_score"), "position").alias("own"))
    both = found.join(last, [group, "clause_id"], "left")
    judged = F.col("own.risk_score").isNotNull() | F.col("own.risk_level").isNotNull()
    score = score100(F.col("own.risk_score"))
    return both.select(
        *(c for c in found.columns if c not in ("category", "risk_level", "risk_score")),
        F.when(judged & (F.trim("own.category") != ""), answer_category(F.col("own.category"))).otherwise(F.col("category")).alias("category"),
        F.when(judged, level100(F.col("own.risk_level"), score)).otherwise(F.col("risk_level")).alias("risk_level"),
        F.when(judged, score).otherwise(F.col("risk_score")).alias("risk_score"),
    )


def inputs(df: DataFrame) -> DataFrame:
    """group, clause_id, text, title, category, risk_score, risk_level of clauses (run_id, …): the first non-blank of source_text,
    summary and explanation is the text; clauses without any are skipped."""
    body = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in ("source_text", "summary", "explanation")))
    given = df.withColumn("text", body).where("text is not null")
    return given.select("run_id", "row_id", F.coalesce(F.nullif(F.trim("clause_id"), F.lit("")), F.concat(F.lit("clause-"), F.col("row_id").cast("string"))).alias("clause_id"), "text", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled clause")).alias("title"), "category", "risk_score", "risk_level")


def complaints(df: DataFrame, group: str, most: int = MOST_CLAUSES) -> DataFrame:
    """group, n_clauses, n_blank (no text), n_unnamed (no clause_id), valid: whether a group can be explained: at least one clause, no more than ``most``, none blank or unnamed."""
    counts = df.groupBy(group).agg(F.count("*").alias("n_clauses"), F.count_if(F.coalesce(F.trim("source_text"), F.lit("")) == "").alias("n_blank"), F.count_if(F.coalesce(F.trim("clause_id"), F.lit("")) == "").alias("n_unnamed"))
    return counts.withColumn("valid", (F.col("n_clauses") <= most) & (F.col("n_blank") == 0) & (F.col("n_unnamed") == 0))


class Client(Protocol):
    """What asks a model; ``explained`` takes any object with this method."""

    def generate(self, system_prompt: str, user_prompt: str, model: str | None = None) -> str: ...


_TRANSIENT = re.compile(r"503|unavailable|429|resource_exhausted", re.I)


def ask(client: Client, system: str, user: str, models: tuple[str | None, ...] = (None,), retries: int = 2, sleep: Callable[[float], None] = time.sleep) -> str:
    """A model's answer. What fails for a passing reason (503, 429, unavailable, exhausted) is tried again ``retries`` times after
    1, 2, 4, … seconds; then, or for another reason, the next of ``models`` is asked; the last one's error is raised."""
    failed: Exception | None = None
    for model in models:
        for k in range(retries + 1):
            try:
                return client.generate(system, user, model)
            except Exception as error:  # a client may raise anything
                failed = error
                if not _TRANSIENT.search(str(error)) or k == retries:
                    break
                sleep(2.0**k)
    raise failed if failed else ValueError("no model to ask")


def explained(clauses: DataFrame, make: Callable[[], Client], system: str, models: tuple[str | None, ...] = (None,), size: int = BATCH, retries: int = 2) -> DataFrame:
    """run_id, batch, raw, error: answers for batches of ``size`` clauses (run_id, batch, clause_id, text).

    ``make`` builds a client once a partition; a batch whose models all fail has a null answer and the error, so that rules can take its place."""
    schema = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("batch", T.IntegerType()), T.StructField("raw", T.StringType()), T.StructField("error", T.StringType())])

    def run(frames):
        client = make()
        for frame in frames:
            rows = []
            for run_id, batch, items in zip(frame.run_id, frame.batch, frame["items"], strict=True):
                user = json.dumps([{"clause_id": x["clause_id"], "text": x["text"]} for x in items], ensure_ascii=False)
                try:
                    rows.append((run_id, batch, ask(client, system, user, models, retries), None))
                except Exception as error:
                    rows.append((run_id, batch, None, str(error)))
            yield pd.DataFrame(rows, columns=schema.names)

    grouped = clauses.groupBy("run_id", "batch").agg(F.sort_array(F.collect_list(F.struct("clause_id", "text"))).alias("items"))
    return grouped.mapInPandas(run, schema)
