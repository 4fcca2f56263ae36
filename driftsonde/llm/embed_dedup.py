"""Embedding near-duplicates: every pair of one label, compared tile by tile.

The vectors of a label are dealt over chunks, and each pair of chunks makes a tile of bounded size in which all pairs are
compared in full precision. That is exact; work grows with the square of a label's number of distinct vectors, and what
is shuffled with that square over the chunk's size. A tile sends on the number of links of each vector and as many links
as connect the same, of which groups are made.

Rows link only if their labels are equal and not null. Vectors that are null, empty, zero or hold null or non-finite
components, and those of different dimensions, link with nothing; each row is its own component then. Equal vectors of
one label are handled once, with their number. Repeated rows of one id are other vectors to each other, and share the
id's component. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftsonde.llm.ann_block import matrix, usable
from driftsonde.llm.arrays import durable
from driftsonde.llm.graphs import connected_components, map_groups, tiles

#: Rows compared at once within a tile; bounds a worker's memory.
STRIP = 512


def spanning_links(near: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the links in a symmetric matrix, some that connect the same."""
    a, b, unseen = [], [], np.ones(len(near), bool)
    for root in np.flatnonzero(near.any(1)).tolist():
        stack = [root] if unseen[root] else []
        unseen[root] = False
        while stack:
            x = stack.pop()
            new = np.flatnonzero(near[x] & unseen)
            unseen[new] = False
            a += [x] * len(new)
            b += new.tolist()
            stack += new.tolist()
    return a, b


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def embedding_groups(vectors: DataFrame, threshold: float = 0.93, passes: int = 16, window: int = 32, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", most: int = 2048) -> DataFrame:
    """One row per row of `vectors`: id, n_links, component_id, kept.

    `passes` and `window` bounded an approximate search once; all pairs are compared now, and they change nothing.
    """
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"), F.col(label_column).cast("string").alias("label"))
    fit = F.col("label").isNotNull() & usable(F.col("vector"))
    rows = rows.withColumn("vector", F.when(fit, F.transform("vector", lambda x: x + F.lit(0.0))))  # -0.0 is 0.0
    rows = rows.withColumn("k1", F.when(fit, F.xxhash64("label", "vector"))).withColumn("k2", F.when(fit, F.xxhash64("vector", "label")))
    classes = rows.where(fit).groupBy("k1", "k2").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = durable(classes.withColumn("dim", F.size("vector")), "classes")

    def links(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in batches:
            chunk, key, node = g.column("chunk").to_numpy(), g.column("k1").to_numpy(), g.column("node").to_numpy()
            crossed = bool((chunk != chunk[0]).any())
            if not crossed and g.column("tile_i")[0] != g.column("tile_j")[0]:
                continue
            at, copies = _unit(matrix(g.column("vector"))), g.column("copies").to_numpy()
            near, others = np.zeros((len(g), len(g)), bool), np.zeros(len(g), np.int64)
            for begin in range(0, len(g), STRIP):
                part = slice(begin, begin + STRIP)
                hit = at[part] @ at.T >= threshold
                hit[np.arange(len(hit)), begin + np.arange(len(hit))] = False
                if crossed:
                    hit &= chunk[part, None] != chunk[None, :]
                near[part], others[part] = hit, hit @ copies
            full = np.flatnonzero(others)
            a, b = spanning_links(near | near.T)
            n = len(full)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(key[full]), pa.nulls(len(a), pa.int64())]),
                    pa.concat_arrays([pa.array(others[full]), pa.nulls(len(a), pa.int64())]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(node[a] if a else [], pa.int64())]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(node[b] if b else [], pa.int64())]),
                ],
                names=["k1", "others", "a", "b"],
            )

    members = classes.select("node", "k1", F.concat_ws(":", F.col("dim").cast("string"), "label").alias("block"), "copies", "vector")
    found = durable(map_groups(tiles(members, node="k1", most=most), ["block", "tile_i", "tile_j"], links, "k1 bigint, others bigint, a bigint, b bigint"), "found")
    groups = connected_components(found.where("a is not null").select("a", "b"))
    counted = found.where("k1 is not null").groupBy("k1").agg(F.sum("others").alias("others"))
    known = classes.select("k1", "k2", "node", "copies").join(groups, "node", "left").join(counted, "k1", "left")
    out = rows.select("id", "k1", "k2").join(known, ["k1", "k2"], "left")
    component = F.coalesce("component", "node", "id")
    return out.select(
        F.col("id").alias(id_column),
        (F.coalesce("others", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
