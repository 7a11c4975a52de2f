"""The store of runs: the latest state of each, as a batch over a table or as a stream."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.dedupe import first_by

TTL_SECONDS, MOST = 3600, 100


def latest(runs: DataFrame) -> DataFrame:
    """The latest row of each run_id by stored_at; of equal times the one whose status sorts last."""
    return first_by(runs.where("run_id is not null"), [F.col("run_id")], [F.desc_nulls_last("stored_at"), F.desc_nulls_last("status"), F.desc_nulls_last("document_count"), F.desc_nulls_last("policy_count")])


def held(runs: DataFrame, ttl: int = TTL_SECONDS, most: int = MOST) -> DataFrame:
    """What a store of ``most`` runs that keeps each ``ttl`` seconds holds at the time of the last insert: the feature is the limit."""
    last = runs.agg(F.max("stored_at").alias("now"))
    fresh = latest(runs).join(F.broadcast(last)).where(F.col("stored_at") >= F.col("now") - F.expr(f"interval {ttl} seconds"))  # one row
    return fresh.drop("now").orderBy(F.desc("stored_at"), "run_id").limit(most)


def missing(wanted: DataFrame, stored: DataFrame, key: str = "run_id") -> DataFrame:
    """The rows of ``wanted`` whose key has no stored result: what is left to compute. Null keys are always left."""
    return wanted.join(stored.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def latest_stream(runs: DataFrame, ttl: int = TTL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """run_id, stored_at, status, event of a stream's runs (run_id, stored_at, status): a store keyed by run, each entry kept ``ttl``
    seconds of event time after its last insert.

    ``event`` is ``held`` for an insert that is the newest of its run (a later insert refreshes the entry's age; an older one
    changes nothing), ``expired`` when the watermark has passed an entry's age. Null run_ids and times are left out."""
    timed = runs.where("run_id is not null and stored_at is not null").select("run_id", F.col("stored_at").cast("timestamp").alias("stored_at"), "status").withWatermark("stored_at", late)
    schema = "run_id string, stored_at timestamp, status string, event string"

    def step(key, frames, state):
        if state.hasTimedOut:
            at, status = state.get
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "stored_at": [pd.Timestamp(at, unit="us")], "status": [status], "event": ["expired"]})
            return
        best = state.get if state.exists else None
        changed = False
        for frame in frames:
            for at, status in zip(frame.stored_at.astype("datetime64[us]").astype("int64"), frame.status, strict=True):
                if best is None or (at, status or "") > (best[0], best[1] or ""):
                    best, changed = (int(at), status), True
        if changed:
            state.update(best)
            state.setTimeoutTimestamp(max(best[0] // 1000 + ttl * 1000, state.getCurrentWatermarkMs() + 1))
            yield pd.DataFrame({"run_id": [key[0]], "stored_at": [pd.Timestamp(best[0], unit="us")], "status": [best[1]], "event": ["held"]})

    return timed.groupBy("run_id").applyInPandasWithState(step, schema, "at bigint, status string", "append", "EventTimeTimeout")
