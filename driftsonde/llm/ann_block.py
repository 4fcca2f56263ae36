"""Nearest neighbours by a block matrix join on int8 codes.

Queries are dealt over blocks, candidates over a fixed number of strips; each block meets each strip in one group. A
group holds its queries and streams its candidates past them, tile by tile. A tile codes both sides in int8 with a scale
each and multiplies the codes; the products and the norms of what coding lost bound each inner product from both sides.
Pairs whose upper bound reaches what the query's k-th best must have at least are recomputed from the original vectors
in double precision and go into the query's list of k best. A group sends k rows a query, whatever it has read, and the
strips' lists are merged by heaps. The bounds are safe, so the result is exact. Of equal vectors only the k + 1 rows of
the smallest ids are candidates, as ties go to the smaller id: a vector that much of the table repeats costs no more.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do pairs of different
dimension. Candidates with the query's own id are left out; repeated rows are candidates each. A query id that has
several rows asks once, with the row of the smallest vector hash. Where a sum overflows, the score is infinite, and
pairs without a score (infinity less infinity) come last. An empty table, or no queries, gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftsonde.llm.graphs import map_groups

#: Queries and candidates of one tile, and pairs recomputed at once; they bound a worker's memory.
TILE = (512, 2048)
PAIRS = 65_536


def usable(vector: Column) -> Column:
    """Not null, not zero, every component there and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def code(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of what the codes stand for, norms of what they lost."""
    scale = np.abs(vectors).max(1) / 127
    scale[scale == 0] = 1  # below the smallest double: all is lost, and bounded so
    whole = vectors / scale[:, None]
    codes = np.clip(np.rint(whole), -127, 127).astype(np.int8)
    return codes, scale, np.linalg.norm(codes.astype(np.float64), axis=1) * scale, np.linalg.norm(whole - codes, axis=1) * scale


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in order of the components."""
    out = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(a.shape[1]):
            out += a[:, d] * b[:, d]
    return out


class Nearest:
    """A block of queries and the k best candidates seen so far of each, best first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        codes, self.scale, self.stand, self.lost = code(vectors)
        self.kind = np.float32 if vectors.shape[1] <= 1000 else np.float64  # sums of int8 products are whole in it
        self.codes = codes.astype(self.kind)
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), -1, np.int64)
        self.number = np.zeros(len(ids), np.int64)

    def take(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        codes, scale, stand, lost = code(vectors)
        codes = codes.astype(self.kind)
        with np.errstate(over="ignore", invalid="ignore"):
            for begin in range(0, len(self.ids), TILE[0]):
                part = slice(begin, begin + TILE[0])
                near = (self.codes[part] @ codes.T).astype(np.float64) * self.scale[part, None] * scale[None, :]
                wide = (self.stand[part] + self.lost[part])[:, None] * lost[None, :] + self.lost[part, None] * stand[None, :]
                wide += 1e-12 * (1 + np.abs(near))
                other = self.ids[part, None] != ids[None, :]
                least = np.where(self.number[part] < self.k, -np.inf, self.score[part, -1])
                if (self.number[part] < self.k).any() and len(ids) >= self.k:  # nothing known yet: the tile's own k-th lower bound
                    low = np.where(other, near - wide, -np.inf)
                    low[np.isnan(low)] = -np.inf
                    least = np.maximum(least, np.partition(low, -self.k, axis=1)[:, -self.k])
                row, col = np.nonzero(other & ~(near + wide < least[:, None]))  # bounds that are no number pass
                for at in range(0, len(row), PAIRS):
                    own, its = row[at : at + PAIRS] + begin, col[at : at + PAIRS]
                    self._merge(own, ids[its], inner(self.vectors[own], vectors[its]))

    def _merge(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        rank = np.where(np.isnan(score), -np.inf, score)
        better = (self.number[row] < self.k) | (rank >= np.where(np.isnan(self.score[row, -1]), -np.inf, self.score[row, -1]))
        row, ids, score = row[better], ids[better], score[better]
        touched = np.unique(row)
        if not len(touched):
            return
        held = np.arange(self.k)[None, :] < self.number[touched, None]
        row = np.concatenate([np.repeat(touched, held.sum(1)), row])
        ids, score = np.concatenate([self.found[touched][held], ids]), np.concatenate([self.score[touched][held], score])
        order = np.lexsort((ids, np.where(np.isnan(score), np.inf, -score), row))
        row, ids, score = row[order], ids[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < self.k
        row, place = row[best], place[best]
        self.found[row, place], self.score[row, place] = ids[best], score[best]
        self.number[touched] = np.bincount(np.searchsorted(touched, row), minlength=len(touched))

    def rows(self) -> pa.RecordBatch:
        held = np.arange(self.k)[None, :] < self.number[:, None]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, self.number)), pa.array(self.found[held]), pa.array(self.score[held])], names=["query_id", "vec_id", "score"])


def _search(k: int):
    """Rows sorted by group, queries first: each group's queries are held, its candidates streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, block, held = None, None, []
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "query_block", "strip")], 1)
            role = batch.column("role").to_numpy()
            edges = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1) | (role[1:] != role[:-1]))).tolist()
            for a, b in zip(edges, [*edges[1:], len(batch)], strict=True):
                if (now := tuple(keys[a].tolist())) != group:
                    if block is not None:
                        yield block.rows()
                    group, block, held = now, None, []
                own = batch.slice(a, b - a)
                if role[a] == 0:
                    held.append((own.column("id").to_numpy(), matrix(own.column("vector"))))
                    continue
                if block is None and held:
                    block, held = Nearest(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), k), []
                if block is not None:
                    for at in range(0, len(own), TILE[1]):
                        part = own.slice(at, TILE[1])
                        block.take(part.column("id").to_numpy(), matrix(part.column("vector")))
        if block is not None:
            yield block.rows()

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", query_block: int = 65_536, strips: int = 8) -> DataFrame:
    """The k nearest of each query row by inner product: query_id, rank, vec_id, score.

    `query_block` queries are held at once; candidates are shuffled once for each block of queries. `strips` is how many
    groups share the candidates of a block, and what is merged a query is k times that.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(usable(F.col("vector"))).withColumn("dim", F.size("vector")).withColumn("hash", F.xxhash64("vector"))
    asked = rows.where("asks").groupBy("id").agg(F.min_by(F.struct("dim", "vector"), "hash").alias("q")).select("id", "q.*")
    asking = rows.where("asks").agg(F.approx_count_distinct("id", 0.02)).first()[0]
    n_blocks = max(1, -(-int(asking * 1.1) // query_block))
    same = rows.groupBy("hash", "dim", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"), F.first("vector").alias("vector"))
    first = same.withColumn("place", F.row_number().over(Window.partitionBy("hash", "dim").orderBy("id"))).where(F.col("place") <= k + 1)
    first = first.select("id", "dim", "vector", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    mine = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    held = asked.select("dim", mine(1, n_blocks).alias("query_block"), every(strips).alias("strip"), F.lit(0).alias("role"), "id", "vector")
    given = first.select("dim", every(n_blocks).alias("query_block"), mine(2, strips).alias("strip"), F.lit(1).alias("role"), "id", "vector")
    groups = ["dim", "query_block", "strip"]
    dealt = held.unionByName(given).repartition(max(n_blocks * strips, int(spark.conf.get("spark.sql.shuffle.partitions"))), *groups)
    found = dealt.sortWithinPartitions(*groups, "role", "id").mapInArrow(_search(k), "query_id bigint, vec_id bigint, score double")

    def merge(groups: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for g in groups:
            score = g.column("score").to_numpy()
            rank = np.where(np.isnan(score), np.inf, -score)
            best = heapq.nsmallest(k, zip(rank.tolist(), g.column("vec_id").to_pylist(), score.tolist(), strict=True))
            out += [(g.column("query_id")[0].as_py(), i, v, s) for i, (_, v, s) in enumerate(best, 1)]
        columns = zip(*out, strict=True) if out else ((), (), (), ())
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "rank", "vec_id", "score"])

    return map_groups(found, ["query_id"], merge, "query_id bigint, rank int, vec_id bigint, score double", ranged=False)
