"""Streams: windowed counts with late data, and case state kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", ts: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """Tumbling counts and sums by kind; on a stream, rows later than the watermark are dropped."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark(ts, late)
    out = stamped.groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), kind, "n", "total")


def case_states(events: DataFrame, most_revisions: int = 20, keep: str = "30 days", late: str = "2 hours", remember: int = 64) -> DataFrame:
    """Stream of (case_id long, seq long, action string, value double, ts timestamp and, maybe, submission_id long) to each case's state after each batch.

    Submits count up to `most_revisions`, a withdrawal ends what is pending. A submission that comes again changes
    nothing, as far as it is among the last `remember` of its case. Events up to `late` behind the latest count; states expire
    after `keep` of event time.
    """
    named = "submission_id" in events.columns

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        revision, status, value, seen = state.get if state.exists else (0, "none", None, [])
        seen = list(seen)
        rows = pd.concat(list(frames)).sort_values("seq")
        ids = rows["submission_id"] if named else [None] * len(rows)
        for action, v, s in zip(rows["action"], rows["value"], ids, strict=True):
            if s is not None and int(s) in seen:
                continue
            if s is not None:
                seen = [*seen, int(s)][-remember:]
            if action == "withdraw" and status == "pending":
                revision, status = revision + 1, "withdrawn"
            elif action == "submit" and revision < most_revisions:
                revision, status, value = revision + 1, "pending", float(v)
        state.update((revision, status, value, seen))
        ends = int(rows["ts"].max().timestamp() * 1000 + pd.Timedelta(keep).total_seconds() * 1000)
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"case_id": [key[0]], "revision": [revision], "status": [status], "value": [value]})

    schema = "case_id long, revision int, status string, value double"
    return events.withWatermark("ts", late).groupBy("case_id").applyInPandasWithState(step, schema, "revision int, status string, value double, seen array<long>", "update", GroupStateTimeout.EventTimeTimeout)
