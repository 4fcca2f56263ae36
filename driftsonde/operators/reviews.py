"""Reviews of cases: compare-and-set, lists by state, and the cycle that keeps an index of approved cases true."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftsonde.operators.cases import expired

STATES = ("pending", "approved", "held", "excluded")
#: Characters that a reusable text and a note may have, and how many reviews a case remembers.
MOST_TEXT, MOST_NOTE, MOST_HISTORY = 500, 500, 20


def apply_reviews(cases: DataFrame, reviews: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Cases after all reviews of a batch, and each review's outcome (case_id, seq, outcome).

    cases: (case_id, revision, status, expires_at, review_state, review_version, reusable_text, index_state); reviews:
    (case_id, seq, state, text, note, expected_revision, expected_version). A case's reviews apply one after another, in order
    of seq. One applies if its state is known, text and note are short enough, an approval has a text, and the case
    is there, alive, not withdrawn and of the revision and review version that the reviewer saw; it raises the version by
    one, and an approval makes the index pending with it. A repeated review that changes nothing is `replayed`. A case's
    reviews are few and folded in one row.
    """
    held = F.array_sort(F.collect_list(F.struct("seq", "state", F.trim(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("note", F.lit("")).alias("note"), "expected_revision", "expected_version")))
    asked = reviews.groupBy("case_id").agg(held.alias("_reviews"))
    rows = cases.withColumn("_there", F.lit(True)).join(asked, "case_id", "full")
    start = F.struct(
        F.coalesce("review_state", F.lit("pending")).alias("state"),
        F.coalesce("review_version", F.lit(0)).cast("int").alias("version"),
        F.coalesce("reusable_text", F.lit("")).alias("text"),
        F.col("index_state").cast("string").alias("index"),
        F.array().cast("array<struct<seq:bigint,outcome:string>>").alias("outcomes"),
    )

    def step(s: Column, r: Column) -> Column:
        same = (s["version"] == r["expected_version"] + 1) & (s["state"] == r["state"]) & (s["text"] == r["text"])
        outcome = (
            F.when(~r["state"].isin(*STATES), "invalid_state")
            .when(F.length(r["text"]) > MOST_TEXT, "text_too_long")
            .when(F.length(r["note"]) > MOST_NOTE, "note_too_long")
            .when((r["state"] == "approved") & (r["text"] == ""), "text_required")
            .when(F.col("_there").isNull(), "not_found")
            .when(expired(F.col("expires_at"), now), "expired")
            .when(F.col("status") != "pending", "withdrawn")
            .when(F.col("revision") != r["expected_revision"], "stale_revision")
            .when(s["version"] == r["expected_version"], "applied")
            .when(same, "replayed")
            .otherwise("stale_review")
        )
        done = outcome == "applied"
        return F.struct(
            F.when(done, r["state"]).otherwise(s["state"]).alias("state"),
            F.when(done, s["version"] + 1).otherwise(s["version"]).cast("int").alias("version"),
            F.when(done, r["text"]).otherwise(s["text"]).alias("text"),
            F.when(done, F.when(r["state"] == "approved", "pending")).otherwise(s["index"]).alias("index"),
            F.concat(s["outcomes"], F.array(F.struct(r["seq"].cast("bigint").alias("seq"), outcome.alias("outcome")))).alias("outcomes"),
        )

    none = F.array().cast("array<struct<seq:bigint,state:string,text:string,note:string,expected_revision:int,expected_version:int>>")
    reviews_of = F.transform(F.coalesce("_reviews", none), lambda r: F.struct(r["seq"].cast("bigint").alias("seq"), r["state"], r["text"], r["note"], r["expected_revision"].cast("int").alias("expected_revision"), r["expected_version"].cast("int").alias("expected_version")))
    folded = rows.withColumn("_s", F.aggregate(reviews_of, start, step))
    after = folded.where("_there").withColumns({"review_state": F.col("_s.state"), "review_version": F.col("_s.version"), "reusable_text": F.nullif(F.col("_s.text"), F.lit("")), "index_state": F.col("_s.index")})
    outcomes = folded.select("case_id", F.explode("_s.outcomes").alias("o")).select("case_id", "o.*")
    return after.select(*cases.columns), outcomes


def review_list(cases: DataFrame, state: str, now: Column, after: int | None = None, limit: int | None = None) -> DataFrame:
    """Living cases of a list (all, withdrawn, pending or a decision) with the seconds they have left, by id from behind `after`."""
    decided = F.coalesce(F.col("review_state").isin(*STATES[1:]), F.lit(False))
    kept = {"all": F.lit(True), "withdrawn": F.col("status") == "withdrawn", "pending": (F.col("status") == "pending") & ~decided}
    kept |= {s: (F.col("status") == "pending") & (F.col("review_state") == s) for s in STATES[1:]}
    if state not in kept:
        raise ValueError(f"unknown list {state}")
    rows = cases.where(~expired(F.col("expires_at"), now) & kept[state])
    rows = rows.withColumn("seconds_left", F.unix_timestamp(F.col("expires_at").cast("timestamp")) - F.unix_timestamp(now.cast("timestamp")))
    rows = rows.where(F.col("case_id") > after) if after is not None else rows
    return rows.orderBy("case_id").limit(limit) if limit is not None else rows


def reusable(cases: DataFrame, now: Column) -> DataFrame:
    """Cases to be found by others: approved in their present revision, with a text, alive."""
    return cases.where(~expired(F.col("expires_at"), now) & (F.col("status") == "pending") & (F.col("review_state") == "approved") & F.col("reusable_text").isNotNull())


def index_cycle(cases: DataFrame, points: DataFrame, now: Column, embed: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """What a cycle does to an index of points (case_id, revision, version, expires_at), step by step; a step that fails doesn't keep others from running.

    expired_points and stale_points are to be deleted (ids), to_index to be added (cases without a point of their version,
    passed through `embed`), to_repair are indexed cases that must be pending again, expired_cases to be deleted last.
    Failed steps are missing from the result and named in `errors` (step, error).
    """
    good = reusable(cases, now).select("case_id", "revision", F.col("review_version").alias("version"), "reusable_text", "expires_at", "index_state")
    living = points.where(~expired(F.col("expires_at"), now))
    same = good.select("case_id", "revision", "version")
    steps: dict[str, Callable[[], DataFrame]] = {
        "expired_points": lambda: points.where(expired(F.col("expires_at"), now)).select("case_id"),
        "stale_points": lambda: living.join(same, ["case_id", "revision", "version"], "left_anti").select("case_id"),
        "to_index": lambda: (embed or (lambda df: df))(good.join(living.select("case_id", "revision", "version"), ["case_id", "revision", "version"], "left_anti").drop("index_state")),
        "to_repair": lambda: good.where("index_state = 'done'").join(living.select("case_id", "revision", "version"), ["case_id", "revision", "version"], "left_anti").select("case_id"),
        "expired_cases": lambda: cases.where(expired(F.col("expires_at"), now)).select("case_id"),
    }
    out: dict[str, DataFrame] = {}
    errors = []
    for name, step in steps.items():
        try:
            out[name] = step()
        except Exception as error:  # noqa: BLE001  the steps are independent of each other
            errors.append((name, type(error).__name__))
    out["errors"] = cases.sparkSession.createDataFrame(errors, "step string, error string")
    return out
