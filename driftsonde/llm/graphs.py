"""Connected components of distributed links, and work on groups and tiles of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftsonde.llm.arrays import durable, release


#: Bytes of rows from which groups are worked on, however few rows they are.
HELD_BYTES = 1 << 25


class Forest:
    """Union-find over 0..n-1; the smaller root stays."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = x = p[p[x]]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Of links among 0..n-1, some that connect the same."""
    forest = Forest(n)
    return [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if forest.union(x, y)]


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b): the smallest node that links reach.

    Alternates large-star and small-star steps; each is an aggregation with partial results and joins that can be
    split where a node has very many links. Every round is written to the shared folder.
    """
    ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, mark = durable(ends, "links"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, durable(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "links")
        release(last)
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def map_groups(rows: DataFrame, keys: list[str], work: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, within: list[str] | None = None, ranged: bool = True, least: int = 1) -> DataFrame:
    """Give `work` whole groups, ordered by `within`, as many as an Arrow batch completes, or batches of `least` rows or HELD_BYTES together.

    Partitions are ranges of the keys with even numbers of rows, which takes a look at a sample of `rows` first, or, not
    `ranged`, hashes of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def split(table: pa.Table) -> np.ndarray:
            new = np.zeros(len(table), bool)
            for k in keys:
                v = table.column(k).to_numpy()
                new[1:] |= v[1:] != v[:-1]
            return np.flatnonzero(new)

        def groups(table: pa.Table, edges: list[int]) -> list[pa.RecordBatch]:
            whole = table.combine_chunks().to_batches()[0]
            return [whole.slice(a, b - a) for a, b in zip([0, *edges], [*edges, len(table)], strict=True)]

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) < least and sum(x.nbytes for x in held) < HELD_BYTES:
                continue
            table = pa.Table.from_batches(held)
            edges = split(table).tolist()
            if edges:
                yield from work(groups(table.slice(0, edges[-1]), edges[:-1]))
                held = table.slice(edges[-1]).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from work(groups(table, split(table).tolist()))

    dealt = rows.repartitionByRange(*keys) if ranged else rows.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *(within or [])).mapInArrow(run, schema)


def tiles(members: DataFrame, node: str = "node", block: str = "block", most: int = 128) -> DataFrame:
    """`members` with (tile_i, tile_j, chunk): blocks of more than `most` rows are cut into chunks, and each pair of chunks makes a tile.

    Two members of a block meet in exactly one tile if their chunks differ, else in that of their chunk alone.
    """
    parts = members.groupBy(block).agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("parts"))
    with_parts = members.join(parts, block).withColumn("chunk", F.pmod(F.xxhash64(node, F.lit(7)), F.col("parts")).cast("int"))
    out = with_parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return out.withColumn("tile_i", F.least("chunk", "other")).withColumn("tile_j", F.greatest("chunk", "other")).drop("other", "parts")
