"""Retrieval metrics, latency summaries and run comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall_at(ranked: Column, positives: Column, k: int) -> Column:
    return F.when(F.size(positives) == 0, 0.0).otherwise(F.size(F.array_intersect(F.slice(ranked, 1, k), positives)) / F.size(positives))


def first_rank(ranked: Column, positives: Column) -> Column:
    """Rank of the first positive, null if none."""
    at = F.filter(F.transform(ranked, lambda x, i: F.when(F.array_contains(positives, x), i + 1)), lambda x: x.isNotNull())
    return F.try_element_at(at, F.lit(1))


def reciprocal_rank(ranked: Column, positives: Column, k: int | None = None) -> Column:
    first = first_rank(F.slice(ranked, 1, k) if k else ranked, positives)
    return F.coalesce(1 / first, F.lit(0.0))


def ndcg_at(ranked: Column, positives: Column, k: int) -> Column:
    """Binary gains; the ideal has min(positives, k) at the top."""
    gain = F.aggregate(F.transform(F.slice(ranked, 1, k), lambda x, i: F.when(F.array_contains(positives, x), 1 / F.log2(i + 2.0)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.size(positives), F.lit(k))), lambda i: 1 / F.log2(i + 1.0)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(positives) == 0, 0.0).otherwise(gain / ideal)


def negative_rate_at(ranked: Column, negatives: Column, k: int) -> Column:
    return F.when(F.size(negatives) == 0, 0.0).otherwise(F.size(F.array_intersect(F.slice(ranked, 1, k), negatives)) / F.size(negatives))


def mean_negative_rank(ranked: Column, negatives: Column) -> Column:
    """Mean rank of the negatives that are there; null if none is."""
    at = F.filter(F.transform(ranked, lambda x, i: F.when(F.array_contains(negatives, x), (i + 1).cast("double"))), lambda x: x.isNotNull())
    return F.when(F.size(at) > 0, F.aggregate(at, F.lit(0.0), lambda s, x: s + x) / F.size(at))


def ranked_arrays(ranked: DataFrame, id_column: str = "id") -> DataFrame:
    """Long ranked lists to one array a query."""
    rows = F.array_sort(F.collect_list(F.struct("rank", id_column)))
    return ranked.groupBy("query_id").agg(F.transform(rows, lambda x: x[id_column]).alias("ranked"))


def from_ranks(found: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """Each query's metrics from its judged ranks, without lists of all that is relevant.

    found: (query_id, id, rank, positive, negative) of the ranked rows; totals: (query_id, n_positive, n_negative) of all
    there are. Columns: recall, rr, ndcg, negative_rate (all within k), first_rank and negative_rank (of all ranked rows).
    """
    rank = F.col("rank")
    within = lambda flag: F.col(flag) & (rank <= k)
    by = found.groupBy("query_id").agg(
        F.count_if(within("positive")).alias("_hits"),
        F.min(F.when(F.col("positive"), rank)).alias("first_rank"),
        F.sort_array(F.collect_list(F.when(within("positive"), rank))).alias("_at"),
        F.count_if(within("negative")).alias("_bad"),
        F.avg(F.when(F.col("negative"), rank.cast("double"))).alias("negative_rank"),
    )
    rows = totals.join(by, "query_id", "left")
    gain = F.aggregate(F.coalesce("_at", F.array().cast("array<int>")), F.lit(0.0), lambda acc, r: acc + 1 / F.log2(r + 1.0))
    most = F.least(F.col("n_positive"), F.lit(k)).cast("int")
    ideal = F.aggregate(F.when(most > 0, F.sequence(F.lit(1), most)), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1.0))
    share = lambda n, total: F.when(F.col(total) > 0, F.coalesce(n, F.lit(0)) / F.col(total)).otherwise(0.0)
    return rows.select(
        "query_id",
        share("_hits", "n_positive").alias("recall"),
        F.when(F.col("first_rank") <= k, 1 / F.col("first_rank")).otherwise(0.0).alias("rr"),
        F.coalesce(gain / ideal, F.lit(0.0)).alias("ndcg"),
        "first_rank",
        share("_bad", "n_negative").alias("negative_rate"),
        "negative_rank",
    )


def latency_summary(spans: DataFrame, group: str, value: str, small: int = 10_000) -> DataFrame:
    """n, median, three 95th percentiles (floor index, nearest rank half-even, interpolated), max, min; exact.

    A sketch of bounded size bounds each quantile's value; values between the bounds (all, in groups of up to `small`) are
    counted by value, and only these counts are put in order, so that a group that holds the table isn't sorted in one task.
    """
    rows = spans.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).where("_v is not null and _g is not null")
    near = F.percentile_approx("_v", [0.498, 0.502, 0.948, 0.952], 100_000)
    sizes = rows.groupBy("_g").agg(F.count("*").alias("n"), F.max("_v").alias("max"), F.min("_v").alias("min"), near.alias("_q"))
    edge = lambda i, all_of: F.when(F.col("n") <= small, F.col(all_of)).otherwise(F.col("_q")[i])
    bands = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), edge(2 * b, "min").alias("low"), edge(2 * b + 1, "max").alias("high")) for b in (0, 1)))).alias("b")
    limits = sizes.select("_g", bands).select("_g", "b.*")
    placed = rows.join(F.broadcast(limits), "_g")
    below = placed.where("_v < low").groupBy("_g", "band").agg(F.count("*").alias("_below"))
    counted = placed.where("_v >= low and _v <= high").groupBy("_g", "band", "_v").agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy("_g", "band").orderBy("_v"))
    counted = counted.withColumn("_end", upto).join(below, ["_g", "band"], "left").join(sizes.select("_g", "n"), "_g")
    end = F.col("_end") + F.coalesce("_below", F.lit(0))
    last = F.col("n") - 1
    at = lambda band, r: F.max(F.when((F.col("band") == band) & (r < end) & (r >= end - F.col("_m")), F.col("_v")))
    ranks = {"m0": (0, F.floor(last * 0.5)), "m1": (0, F.ceil(last * 0.5)), "f": (1, F.least(F.floor(F.col("n") * 0.95), last)), "r": (1, F.bround(last * 0.95)), "l0": (1, F.floor(last * 0.95)), "l1": (1, F.ceil(last * 0.95))}
    found = counted.groupBy("_g").agg(*(at(b, r).alias(f"_{name}") for name, (b, r) in ranks.items()))
    between = lambda low, high, p: F.col(low) + (F.col(high) - F.col(low)) * (last * p - F.floor(last * p))
    return sizes.join(found, "_g").select(
        F.col("_g").alias(group),
        "n",
        F.round(between("_m0", "_m1", 0.5), 1).alias("median"),
        F.round("_f", 1).alias("p95_floor"),
        F.round("_r", 1).alias("p95_nearest"),
        F.round(between("_l0", "_l1", 0.95), 1).alias("p95_linear"),
        F.round("max", 1).alias("max"),
        F.round("min", 1).alias("min"),
    )


def rank_bucket(rank: Column) -> Column:
    return F.when(rank <= 5, "top5").when(rank <= 10, "6-10").otherwise("out")


def drop_stage(pooled: Column, fused_rank: Column, final_rank: Column, cut: int) -> Column:
    """Where a wanted id was lost."""
    return F.when(final_rank.isNotNull(), "kept").when(~pooled, "no_path").when(fused_rank.isNull() | (fused_rank > cut), "fusion_cut").otherwise("final_cut")


def paired_changes(off: DataFrame, on: DataFrame, k: int) -> DataFrame:
    """(query_id, first_rank) of two runs to recovered, lost, kept and missed queries."""
    pair = off.select("query_id", F.col("first_rank").alias("before")).join(on.select("query_id", F.col("first_rank").alias("after")), "query_id", "full")
    was, now = F.coalesce(F.col("before") <= k, F.lit(False)), F.coalesce(F.col("after") <= k, F.lit(False))
    return pair.withColumn("change", F.when(was & now, "kept").when(now, "recovered").when(was, "lost").otherwise("missed"))


def discrimination(values: DataFrame, slot: str, value: str) -> DataFrame:
    """Per slot: distinct values, coverage and 1 - sum of squared shares; empty values count against coverage only."""
    n = values.groupBy(slot, value).count()
    total = n.groupBy(slot).agg(
        F.sum("count").alias("n"),
        F.coalesce(F.sum(F.when(F.col(value).isNotNull(), F.col("count"))), F.lit(0)).alias("filled"),
        F.count_if(F.col(value).isNotNull()).alias("n_values"),
        F.coalesce(F.sum(F.when(F.col(value).isNotNull(), F.col("count") * F.col("count"))), F.lit(0)).alias("_squares"),
    )
    gini = F.when(F.col("filled") == 0, 0.0).otherwise(1 - F.col("_squares") / (F.col("filled") * F.col("filled")))
    return total.select(slot, "n_values", (F.col("filled") / F.col("n")).alias("coverage"), gini.alias("discrimination"))
