"""Comparing runs and stores, scoring candidates, laying out and cutting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differences(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose value differs, or that only one side has."""
    a, b = before.withColumnRenamed(value, "before"), after.withColumnRenamed(value, "after")
    return a.join(b, keys, "full").where(~F.col("before").eqNullSafe(F.col("after")))


def reuse_plan(wanted: DataFrame, cached: DataFrame, id_column: str, key: str) -> DataFrame:
    """missing, changed or reuse for each wanted id."""
    both = wanted.join(cached.withColumnRenamed(key, "_key"), id_column, "left")
    return both.select(id_column, F.when(F.col("_key").isNull(), "missing").when(F.col("_key") != F.col(key), "changed").otherwise("reuse").alias("plan"))


def outcome(flags: Column, known: Column) -> Column:
    """The word for how reranking went, by the first flag that holds."""
    has = lambda x: F.array_contains(flags, x)
    return F.when(has("exception"), "exception").when(has("policy"), "policy_skipped").when(has("fallback"), "fallback").when(~known, "unknown").otherwise("applied")


def matched_field(clue: Column, fields: dict[str, Column]) -> Column:
    """The one field that holds the clue, `both` if several do, `none` if none does."""
    held = F.filter(F.array(*(F.when(F.contains(F.lower(c), F.lower(clue)), name) for name, c in fields.items())), lambda x: x.isNotNull())
    return F.when(F.size(held) > 1, "both").when(F.size(held) == 1, held[0]).otherwise("none")


def verdict(points: list[tuple[Column, int]], hard: Column, least: int) -> tuple[Column, Column]:
    """(score, verdict): the sum of the points of what holds; rejected outright, accepted from `least`, else to review."""
    score = reduce(lambda a, b: a + b, [F.when(c, p).otherwise(0) for c, p in points])
    return score.alias("score"), F.when(hard, "reject").when(score < least, "review").otherwise("accept").alias("verdict")


def mean_present(rules: list[tuple[Column, Column]]) -> Column:
    """Mean of the values of those rules that are asked; null if none is."""
    n = reduce(lambda a, b: a + b, [asked.cast("int") for asked, _ in rules])
    total = reduce(lambda a, b: a + b, [F.when(asked, value).otherwise(0.0) for asked, value in rules])
    return F.when(n > 0, total / n)


def canvas(points: DataFrame, width: float, height: float, margin: float) -> DataFrame:
    """Scale x and y to a canvas; bounds are one row."""
    b = points.agg(F.min("x").alias("_lx"), F.max("x").alias("_hx"), F.min("y").alias("_ly"), F.max("y").alias("_hy"))
    at = lambda c, low, high, size: F.when(F.col(high) == F.col(low), F.lit(size / 2)).otherwise(margin + (F.col(c) - F.col(low)) / (F.col(high) - F.col(low)) * (size - 2 * margin))
    out = points.crossJoin(F.broadcast(b)).withColumns({"x": at("x", "_lx", "_hx", width), "y": at("y", "_ly", "_hy", height)})
    return out.drop("_lx", "_hx", "_ly", "_hy")


def best_rotation(points: DataFrame, x: str, y: str, target: str, steps) -> DataFrame:
    """The quarter-degree step whose axis correlates most with the target: one aggregate row, all angles from second moments."""
    m = points.agg(F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.var_pop(target).alias("zz"), F.covar_pop(x, y).alias("xy"), F.covar_pop(x, target).alias("xz"), F.covar_pop(y, target).alias("yz"))
    rows = m.select("*", F.explode(F.array(*map(F.lit, steps))).alias("step")).withColumn("a", F.radians(F.col("step") / 4.0))
    c, s = F.cos("a"), F.sin("a")
    spread = c * c * F.col("xx") + s * s * F.col("yy") + 2 * c * s * F.col("xy")
    out = rows.select("step", ((c * F.col("xz") + s * F.col("yz")) / F.sqrt(spread * F.col("zz"))).alias("correlation"))
    return out.orderBy(F.desc(F.round(F.abs("correlation"), 9)), "step").limit(1)


def chunks(docs: DataFrame, id_column: str, text_column: str, size: int, overlap: int) -> DataFrame:
    """Overlapping pieces of fixed size: id, start, chunk. An empty text is one empty piece."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text_column) - 1, F.lit(0)), F.lit(size - overlap))
    return docs.select(id_column, text_column, F.explode(starts).alias("start")).select(id_column, "start", F.substring(F.col(text_column), F.col("start") + 1, F.lit(size)).alias("chunk"))
