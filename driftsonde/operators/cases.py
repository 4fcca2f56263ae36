"""Revisioned cases: folds of ordered events, expiry, retries, stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_cases(events: DataFrame, most_revisions: int = 20) -> DataFrame:
    """Events (case_id, seq, submission_id, action, value, at) to each case's last state.

    Replayed submissions change nothing; submits after `most_revisions` are refused, a withdrawal is not.
    """
    fresh = events.groupBy("case_id", "submission_id").agg(F.min(F.struct("seq", "action", "value", "at")).alias("e")).select("case_id", "e.*")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "action", "value", "at")))
    start = F.struct(F.lit(0).alias("revision"), F.lit("none").alias("status"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))

    def step(state: Column, e: Column) -> Column:
        accepted = (e["action"] == "withdraw") & (state["status"] == "pending") | (e["action"] == "submit") & (state["revision"] < most_revisions)
        after = F.struct(
            (state["revision"] + 1).alias("revision"),
            F.when(e["action"] == "submit", "pending").otherwise("withdrawn").alias("status"),
            F.when(e["action"] == "submit", e["value"]).otherwise(state["value"]).alias("value"),
            e["at"].alias("updated_at"),
        )
        return F.when(accepted, after).otherwise(state)

    folded = fresh.groupBy("case_id").agg(ordered.alias("events"), F.min("at").alias("created_at"))
    return folded.select("case_id", F.aggregate("events", start, step).alias("s"), "created_at").select("case_id", "s.*", "created_at")


def expired(expires_at: Column, now: Column) -> Column:
    """A missing expiry counts as passed."""
    return F.coalesce(expires_at <= now, F.lit(True))


def retry_delay(attempt: Column) -> Column:
    """Seconds: 60, doubled each time, 3600 at most."""
    return F.least(F.lit(3600.0), 60 * F.pow(F.lit(2.0), attempt - 1))


def effective_review(state: Column, source_revision: Column, revision: Column) -> Column:
    """A review of an older revision is pending again."""
    return F.when(state.isNull() | (source_revision != revision), "pending").otherwise(state)


def next_stage(done: Column, attempts: Column, stages: list[str], most: int = 3) -> Column:
    """The first stage that isn't done, or `exhausted` once it was tried `most` times; `complete` after the last. attempts: map of stage to tries."""
    out = F.lit("complete")
    for stage in reversed(stages):
        tries = F.coalesce(F.try_element_at(attempts, F.lit(stage)), F.lit(0))
        out = F.when(F.array_contains(done, stage), out).otherwise(F.when(tries >= most, "exhausted").otherwise(stage))
    return out


def reconcile(documents: DataFrame, points: DataFrame, id_column: str, version: str) -> DataFrame:
    """Ids of two stores that disagree: missing there, orphaned, or of another version."""
    a = documents.select(id_column, F.col(version).alias("wanted"))
    b = points.select(id_column, F.col(version).alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("wanted").isNull(), "orphan").when(F.col("wanted") != F.col("found"), "stale").otherwise("ok")
    return a.join(b, id_column, "full").withColumn("state", state).where("state <> 'ok'")
