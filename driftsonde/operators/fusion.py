"""Rank fusion, boosts and blends over long ranked lists (query_id, path, id, rank)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
UNIT = 1 / (RRF_K + 1)


def rrf(ranked: DataFrame, weights: dict[str, float], limit: int | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion. Paths of weight 0 leave with their candidates; ties go to the earlier path, then the better rank there.

    One conditional maximum per path, summed in a fixed order, so that a result doesn't hang on how rows arrive.
    """
    live = [(p, w) for p, w in weights.items() if w]
    order = {p: i for i, (p, _) in enumerate(live)}
    at = F.element_at(F.create_map(*(x for p, i in order.items() for x in (F.lit(p), F.lit(i)))), F.col("path"))
    rows = ranked.where(F.col("path").isin(*order)).withColumn("_at", at)
    parts = [F.coalesce(F.max(F.when(F.col("path") == p, F.lit(w) / (F.lit(RRF_K) + F.col("rank")))), F.lit(0.0)) for p, w in live]
    fused = rows.groupBy("query_id", "id").agg(reduce(lambda a, b: a + b, parts).alias("score"), F.min(F.struct("_at", "rank")).alias("_first"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "_first", "id")
    out = fused.withColumn("rank", F.row_number().over(w)).drop("_first")
    return out.where(F.col("rank") <= limit) if limit else out


def rrf_by_query(ranked: DataFrame, paths: list[str], limit: int | None = None) -> DataFrame:
    """`rrf` with a weight for each query and path: (query_id, path, id, rank, weight). Weights of 0 or none take their candidates out."""
    order = F.element_at(F.create_map(*(x for i, p in enumerate(paths) for x in (F.lit(p), F.lit(i)))), F.col("path"))
    rows = ranked.where(F.col("path").isin(*paths) & (F.col("weight") > 0)).withColumn("_at", order)
    parts = [F.coalesce(F.max(F.when(F.col("path") == p, F.col("weight") / (F.lit(RRF_K) + F.col("rank")))), F.lit(0.0)) for p in paths]
    fused = rows.groupBy("query_id", "id").agg(reduce(lambda a, b: a + b, parts).alias("score"), F.min(F.struct("_at", "rank")).alias("_first"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "_first", "id")
    out = fused.withColumn("rank", F.row_number().over(w)).drop("_first")
    return out.where(F.col("rank") <= limit) if limit else out


def contributions(ranked: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The ledger behind `rrf`: one row for what each path adds to each id."""
    weight = F.element_at(F.create_map(*(x for p, w in weights.items() for x in (F.lit(p), F.lit(float(w))))), F.col("path"))
    return ranked.select("query_id", "id", "path", (weight / (F.lit(RRF_K) + F.col("rank"))).alias("delta")).where("delta <> 0")


def clue_max(clues: DataFrame) -> DataFrame:
    """(query_id, id, clue, rank, confidence) to the best clue of each id, never their sum; the first clue on ties."""
    score = F.col("confidence") / (F.lit(RRF_K) + F.col("rank"))
    return clues.withColumn("score", score).groupBy("query_id", "id").agg(F.max("score").alias("score"), F.min_by("clue", F.struct(-F.col("score"), F.col("clue"))).alias("clue"), F.count("*").alias("n_clues"))


def interleave(lists: DataFrame, limit: int = 10) -> DataFrame:
    """Round robin over lists (query_id, list_no, rank, id), each id at its first place."""
    first = lists.groupBy("query_id", "id").agg(F.min(F.struct("rank", "list_no")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at", "id")
    return first.select("query_id", "id", F.row_number().over(w).alias("position")).where(F.col("position") <= limit)


def modality_weights(columns: list[str], enabled: dict[str, bool], floor: float = 0.10) -> list[Column]:
    """Enabled weights of at least `floor`, others 0, summing to 1, to 6 places."""
    raised = [F.greatest(F.col(c), F.lit(floor)) if enabled[c] else F.lit(0.0) for c in columns]
    total = reduce(lambda a, b: a + b, raised)
    return [F.round(r / total, 6).alias(c) for c, r in zip(columns, raised, strict=True)]


def era_similarity(year: Column, start: Column, end: Column) -> Column:
    """1, .75, .5, .25 or 0 by the years between `year` and the window."""
    gap = F.greatest(start - year, year - end, F.lit(0))
    return F.when(year.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - 0.25 * gap))


def lyric_boost(kind: Column, score: Column, rank: Column) -> Column:
    """Unit times 8, 5 or 3 by how the phrase was found; all but exact finds decay with the rank."""
    scale = F.when(kind == "exact", 8.0).when(kind == "phonetic", 5.0).when(kind == "fuzzy", 3.0).otherwise(0.0)
    return F.lit(UNIT) * scale * score * F.when(kind == "exact", 1.0).otherwise(F.lit(RRF_K + 1) / (F.lit(RRF_K) + rank))


def minmax(column: str, over: str = "query_id") -> Column:
    """To 0..1 within the group; all 1 where there is no spread."""
    w = Window.partitionBy(over)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return F.when(high == low, 1.0).otherwise((F.col(column) - low) / (high - low))


def rerank_blend(scored: DataFrame, base: float = 0.45, spread_ref: float = 4.0) -> DataFrame:
    """(query_id, id, retrieval, judged) to a blend whose weight grows with the judged scores' spread; unjudged rows last."""
    w = Window.partitionBy("query_id")
    spread = F.max("judged").over(w) - F.min("judged").over(w)
    share = F.lit(base) * F.least(F.lit(1.0), spread / spread_ref)
    rows = scored.withColumn("_r", minmax("retrieval")).withColumn("_j", minmax("judged")).withColumn("_w", share)
    rows = rows.withColumn("score", F.col("_w") * F.col("_j") + (1 - F.col("_w")) * F.col("_r"))
    by = Window.partitionBy("query_id").orderBy(F.col("judged").isNull(), F.desc(F.coalesce("score", "_r")), "id")
    return rows.select("query_id", "id", F.coalesce("score", "_r").alias("score"), F.row_number().over(by).alias("rank"))


def pass_scores(passes: DataFrame, n: int) -> DataFrame:
    """(query_id, id, pass_rank, relevance) of several listwise passes to one score: .75 mean rank score + .25 mean relevance."""
    rank_score = F.lit(1.0) if n <= 1 else 1 - (F.coalesce("pass_rank", F.lit(n)) - 1) / (n - 1)
    return passes.groupBy("query_id", "id").agg((0.75 * F.avg(rank_score) + 0.25 * F.avg(F.coalesce("relevance", F.lit(0.0)))).alias("llm_score"))


def listwise_weight(confidence: Column, base: float = 0.85, sure: float = 0.55) -> Column:
    return F.when(confidence < sure, F.lit(base) * F.greatest(F.lit(0.35), confidence / sure)).otherwise(base)


def protect(ranked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, rank, protected, tier): protected rows first by tier, the others as they were, cut to k."""
    w = Window.partitionBy("query_id").orderBy(F.desc("protected"), F.desc(F.when(F.col("protected"), F.col("tier")).otherwise(0)), "rank")
    return ranked.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= k)


def supplement(base: DataFrame, extra: DataFrame, most: int, weight: float, k: int) -> DataFrame:
    """Insert at most `most` new ids (query_id, id, extra_rank) at the score of the row that they displace (the last one of shorter lists), times weight, in their order."""
    new = extra.join(base, ["query_id", "id"], "left_anti")
    new = new.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("extra_rank", "id"))).where(F.col("_n") <= most)
    count = new.groupBy("query_id").agg(F.max("_n").alias("_m"))
    size = base.groupBy("query_id").agg(F.max("rank").alias("_size"))
    anchor = base.join(count, "query_id").join(size, "query_id").where(F.col("rank") == F.least(F.lit(k) - F.col("_m") + 1, F.col("_size"))).select("query_id", F.col("score").alias("_anchor"))
    rows = new.join(anchor, "query_id").select("query_id", "id", (F.col("_anchor") * weight - (F.col("_n") - 1) * 1e-6).alias("score"), F.lit(True).alias("is_new"))
    every = base.select("query_id", "id", "score", F.lit(False).alias("is_new")).unionByName(rows)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "is_new", "id")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def counterfactual_ranks(scored: DataFrame, columns: list[str]) -> DataFrame:
    """For each score: one more than the rows with a strictly larger one."""
    return scored.withColumns({f"{c}_rank": F.rank().over(Window.partitionBy("query_id").orderBy(F.desc(c))) for c in columns})
