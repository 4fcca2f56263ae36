"""Exact vector search, hybrid sums and grouped bests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftsonde.sources.steps import materialise


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def normalise(a: Column, eps: float = 1e-12) -> Column:
    """Unit length; vectors shorter than eps stay."""
    return F.when(norm(a) < eps, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / norm(a)))


def top_k(scored: DataFrame, k: int, group: str = "query_id", score: str = "score", id_column: str = "id") -> DataFrame:
    """The k best of each group by score, then id; Catalyst cuts each partition to k before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(id_column))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense_scores(queries: DataFrame, corpus: DataFrame, measure=dot, most_queries: int | None = None, block: int = 1024) -> DataFrame:
    """(query_id, id, score) of all queries (query_id, query) against all of the corpus (id, vector), own id left out.

    The queries are dealt over blocks of about `block` rows, one array each; every block meets every corpus row, and all scores come out: `dense_topk` is what to rank by. Callers
    that want their query set bounded give `most_queries`; more raise.
    """
    n = queries.agg(F.count("*").alias("n"))
    if most_queries is not None:
        n = n.select(F.when(F.col("n") > most_queries, F.raise_error(F.lit(f"more than {most_queries} queries"))).otherwise(F.col("n")).alias("n"))
    n = n.select(F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block))).alias("n"))
    dealt = queries.crossJoin(F.broadcast(n)).withColumn("block", F.pmod(F.xxhash64("query_id", "query"), F.col("n")))
    packed = dealt.groupBy("block").agg(F.collect_list(F.struct("query_id", "query")).alias("qs")).select("qs")
    pairs = corpus.crossJoin(packed).select("id", "vector", F.explode("qs").alias("q")).where(F.col("q.query_id") != F.col("id"))
    return pairs.select("q.query_id", "id", measure(F.col("q.query"), F.col("vector")).alias("score"))


class Best:
    """The k best rows seen so far of each of some queries, best first; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.found = np.full((queries, k), np.iinfo(np.int64).max)

    def merge(self, begin: int, ids: np.ndarray, score: np.ndarray) -> None:
        """Scores of the queries from `begin` on (rows) for the ids (columns); minus infinity is none."""
        part = slice(begin, begin + len(score))
        rows = np.flatnonzero((score > -np.inf).any(1) & (score.max(1, initial=-np.inf) >= self.score[part, -1]))
        if not len(rows):
            return
        every = np.concatenate([self.score[part][rows], score[rows]], 1)
        known = np.concatenate([self.found[part][rows], np.where(np.isneginf(score[rows]), np.iinfo(np.int64).max, ids[None, :])], 1)
        order = np.lexsort((known, -every), axis=1)[:, : self.k]
        self.score[begin + rows] = np.take_along_axis(every, order, 1)
        self.found[begin + rows] = np.take_along_axis(known, order, 1)

    def columns(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of all that is held."""
        held = ~np.isneginf(self.score)
        return np.repeat(queries, held.sum(1)), self.found[held], self.score[held]


class _Block:
    """A block of queries that rows are streamed past."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, least: float | None):
        self.ids, self.vectors, self.k, self.least = ids, vectors, k, least
        self.reset()

    def reset(self) -> None:
        self.best = Best(len(self.ids), self.k)

    def take(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for begin in range(0, len(self.ids), TILE):
            part = slice(begin, begin + TILE)
            score = self.vectors[part] @ vectors.T
            drop = (self.ids[part, None] == ids[None, :]) | ~np.isfinite(score)
            if self.least is not None:
                drop |= score < self.least
            score[drop] = -np.inf
            self.best.merge(begin, ids, score)

    def rows(self, by: object) -> pa.RecordBatch:
        query, found, score = self.best.columns(self.ids)
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array([by] * len(query), pa.string()), pa.array(found), pa.array(score)], names=["query_id", "by", "id", "score"])


#: Queries and corpus rows multiplied at once.
TILE = 1024


def _matrix(column: pa.Array, unit: bool) -> np.ndarray:
    out = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    if unit:
        with np.errstate(invalid="ignore", divide="ignore"):
            out = out / np.linalg.norm(out, axis=1, keepdims=True)
    return out


def _stream(k: int, least: float | None, unit: bool):
    """Rows sorted by group, queries first: each group's queries are held, its corpus rows streamed; one list a query and value of `by`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, best, held, by = None, None, [], None
        for batch in batches:
            if not len(batch):
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("dim", "block", "strip", "role", "by")), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if keys[a][:3] != group:
                    if best is not None:
                        yield best.rows(by)
                    group, best, held, by = keys[a][:3], None, [], keys[a][4]
                own = batch.slice(a, b - a)
                if keys[a][3] == 0:
                    held.append((own.column("id").to_numpy(), _matrix(own.column("vector"), unit)))
                    continue
                if best is None:
                    if not held:
                        continue
                    best, by = _Block(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), k, least), keys[a][4]
                if keys[a][4] != by:
                    yield best.rows(by)
                    best.reset()
                    by = keys[a][4]
                for at in range(0, len(own), TILE):
                    part = own.slice(at, TILE)
                    best.take(part.column("id").to_numpy(), _matrix(part.column("vector"), unit))
        if best is not None:
            yield best.rows(by)

    return run


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, measure: str = "dot", least: float | None = None, by: str | None = None, block: int = 16_384, strips: int = 8) -> DataFrame:
    """(query_id, id, score, rank): the k best of the corpus (id, vector) for each query (query_id, query), own id left out; with `by`, the k best of each of its values.

    Exact, by matrix products. Queries are dealt over blocks of `block`, the corpus over `strips`; a group of both holds its
    queries, streams the corpus past them and sends k rows a query, so that neither pairs nor a block's corpus are held.
    The corpus is shuffled once for each block of queries. Rows without a vector, or whose score is no finite number or
    less than `least`, aren't found. Vectors of different dimension don't meet. A query of several rows asks with each.
    """
    dense = lambda df, one, vector: df.select(F.col(one).cast("bigint").alias("id"), F.col(vector).alias("vector"), F.size(vector).alias("dim"), *([F.col(by).cast("string").alias("by")] if by and one == "id" else [F.lit(None).cast("string").alias("by")]))
    asked, given = dense(queries, "query_id", "query").where("dim > 0").distinct(), dense(corpus, "id", "vector").where("dim > 0 and id is not null")
    blocks = max(1, -(-asked.count() // block))
    mine = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    held = asked.select("dim", mine(1, blocks).alias("block"), every(strips).alias("strip"), F.lit(0).alias("role"), "by", "id", "vector")
    rows = held.unionByName(given.select("dim", every(blocks).alias("block"), mine(2, strips).alias("strip"), F.lit(1).alias("role"), "by", "id", "vector"))
    dealt = rows.repartition(blocks * strips, "dim", "block", "strip").sortWithinPartitions("dim", "block", "strip", "role", "by")
    found = dealt.mapInArrow(_stream(k, least, measure == "cosine"), "query_id bigint, by string, id bigint, score double")
    w = Window.partitionBy(*(["query_id", "by"] if by else ["query_id"])).orderBy(F.desc("score"), F.asc("id"))
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("query_id", *([F.col("by").cast(corpus.schema[by].dataType).alias(by)] if by else []), "id", "score", "rank")


def similarity_report(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Each query's cosines to all other corpus rows without the pairs: n, mean (from the sum of unit vectors), most and least."""
    unit = lambda df, c: df.withColumn(c, normalise(F.col(c)))
    q, c = unit(queries, "query"), unit(corpus, "vector")
    total = mean_vector(c, "vector").crossJoin(c.agg(F.count("*").alias("n")))
    high = dense_topk(q, c, 1).select("query_id", F.col("score").alias("most"))
    turned = F.transform("query", lambda x: -x)
    low = dense_topk(q.withColumn("query", turned), c, 1).select("query_id", (-F.col("score")).alias("least"))
    here = q.join(c.select(F.col("id").alias("query_id"), F.lit(1).alias("_here")), "query_id", "left").crossJoin(F.broadcast(total))
    others = F.col("n") - F.coalesce("_here", F.lit(0))
    mean = (dot(F.col("query"), F.col("mean")) * F.col("n") - F.coalesce("_here", F.lit(0))) / others
    return here.select("query_id", others.alias("n"), mean.alias("mean")).join(high, "query_id").join(low, "query_id")


def hybrid_search(dense: DataFrame, sparse: DataFrame, queries: DataFrame, alpha: float) -> DataFrame:
    """`hybrid_sum` for queries (query_id, has_terms); those without terms take their dense scores unscaled."""
    both = hybrid_sum(dense.join(queries.where("has_terms"), "query_id", "left_semi"), sparse, alpha)
    return both.unionByName(dense.join(queries.where("not has_terms"), "query_id", "left_semi").select("query_id", "id", "score"))


def hybrid_sum(dense: DataFrame, sparse: DataFrame, alpha: float) -> DataFrame:
    """alpha * dense + (1 - alpha) * sparse over both lists' ids; a missing side adds nothing. A union and one aggregate, no outer join."""
    both = dense.select("query_id", "id", (F.col("score") * alpha).alias("d"), F.lit(None).cast("double").alias("s")).unionByName(
        sparse.select("query_id", "id", F.lit(None).cast("double").alias("d"), (F.col("score") * (1 - alpha)).alias("s"))
    )
    return both.groupBy("query_id", "id").agg((F.coalesce(F.sum("d"), F.lit(0.0)) + F.coalesce(F.sum("s"), F.lit(0.0))).alias("score"))


def hybrid_topk(queries: DataFrame, corpus: DataFrame, sparse, alpha: float | str, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k best of alpha * dense + (1 - alpha) * sparse over all of both sides, a missing side adding nothing.

    alpha is a number or a column of the queries (query_id, query). sparse: rows (query_id, id, score), or what makes them,
    a `bm25.Scores`, which sums both sides where its postings are. Rows are exact without all pairs, too. A row without a sparse score (none below 0) can only be among the k best by
    dense score. Of the others only those are scored whose sparse share and the query's best dense score reach the k-th
    best of the rows known by then: the k best of either side.
    """
    if isinstance(sparse, DataFrame):
        sparse = Listed(sparse)
    share = F.col(alpha) if isinstance(alpha, str) else F.lit(alpha)
    if hasattr(sparse, "fused"):
        return top_k(sparse.fused(queries.select("query_id", "query", share.alias("alpha")), corpus.select("id", "vector"), k), k)
    vectors, asked = corpus.select("id", "vector"), queries.select("query_id", "query", share.cast("double").alias("_alpha"))
    near = materialise(dense_topk(asked.select("query_id", "query"), vectors, k), "near")
    top = near.groupBy("query_id").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("_most"))
    a = F.col("_alpha")

    def fused(pairs: DataFrame) -> DataFrame:
        """(query_id, id, s) with their dense scores."""
        there = pairs.join(asked, "query_id").join(vectors, "id", "left")
        dense = F.when(F.col("query_id") != F.col("id"), dot(F.col("query"), F.col("vector")))
        return there.select("query_id", "id", "s", (F.coalesce(dense, F.lit(0.0)) * a + F.coalesce("s", F.lit(0.0)) * (1 - a)).alias("score"))

    best = materialise(sparse.top(k).select("query_id", "id", F.col("score").alias("s")), "best")
    # A row near by vector has at least its dense share; its sparse score, if any, comes with the rest.
    first = materialise(fused(best.unionByName(near.select("query_id", "id", F.lit(None).cast("double").alias("s")).join(best.select("query_id", "id"), ["query_id", "id"], "left_anti"))), "first")
    bar = top_k(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("_bar"))
    needed = asked.select("query_id", "_alpha").join(bar, "query_id", "left").join(top, "query_id", "left")
    reach = (F.col("_bar") - 1e-9 - a * F.coalesce("_most", F.lit(0.0))) / (1 - a)
    needed = needed.select("query_id", F.when(a < 1, F.coalesce(reach, F.lit(float("-inf")))).otherwise(F.lit(float("-inf"))).alias("bar"))
    rest = sparse.above(needed).select("query_id", "id", F.col("score").alias("s"))
    more = fused(rest)
    every = first.select("query_id", "id", "score").unionByName(more.select("query_id", "id", "score"))
    return top_k(every.groupBy("query_id", "id").agg(F.max("score").alias("score")), k)


class Listed:
    """Sparse scores that are there as rows (query_id, id, score)."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def top(self, k: int) -> DataFrame:
        return top_k(self.rows, k).drop("rank")

    def above(self, bars: DataFrame) -> DataFrame:
        """Rows of at least the bar of their query (query_id, bar)."""
        return self.rows.join(bars, "query_id").where("score >= bar").drop("bar")


def mean_vector(vectors: DataFrame, column: str) -> DataFrame:
    """One row: the component-wise mean of all rows, from one aggregate row per component."""
    parts = vectors.select(F.posexplode(column).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))


def mean_centre(vectors: DataFrame, column: str) -> DataFrame:
    """Subtract the corpus mean and make unit length; the mean is one row, broadcast."""
    with_mean = vectors.crossJoin(F.broadcast(mean_vector(vectors, column)))
    centred = with_mean.withColumn("_c", F.zip_with(F.col(column), F.col("mean"), lambda x, m: x.cast("double") - m))
    return centred.withColumn(column, normalise(F.col("_c"))).drop("_c", "mean")


def best_per_group(scored: DataFrame, group: str, limit: int | None = None, query: str = "query_id", id_column: str = "id") -> DataFrame:
    """Each group's best row (first id on ties; non-finite scores rejected), then the best `limit` groups."""
    fine = scored.where(~F.isnan("score") & (F.abs("score") != float("inf")))
    best = fine.groupBy(query, group).agg(F.max("score").alias("score"), F.min_by(id_column, F.struct(-F.col("score"), F.col(id_column))).alias(id_column))
    return top_k(best, limit, query, "score", group) if limit else best


def vector_issues(vectors: DataFrame, dim: int, id_column: str, column: str, tolerance: float = 2e-3) -> DataFrame:
    """Counts of rows that break a rule for publishing: one pass, and duplicates by id."""
    v = F.col(column)
    finite = ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    rules = vectors.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(id_column).isNull()).alias("n_empty_id"),
        F.count_if(F.size(v) != dim).alias("n_bad_dim"),
        F.count_if(~finite).alias("n_not_finite"),
        F.count_if(F.abs(norm(v) - 1) > tolerance).alias("n_bad_norm"),
    )
    twice = vectors.groupBy(id_column).count().where("count > 1").agg(F.count("*").alias("n_duplicate_id"))
    return rules.crossJoin(F.broadcast(twice))
