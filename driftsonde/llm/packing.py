"""Packing token sequences into windows by non-negative least squares over length combinations.

Documents longer than the window are cut into full windows and a rest. The rests' lengths form a histogram of fewer
bins than the window has tokens, whatever the input's size. Shallow combinations (two or three lengths that fill the
window but for a small slack) are its columns; non-negative least squares gives how often to use each, rounded down
to what the histogram still holds. What remains is packed greedily, longest first. The plan, a bounded list of
(length, ranks, sequence, offset), is applied to the rests by their rank within their length.

Null and empty texts hold the end id alone. Repeated rows each get a place; ties of rank are broken by id, start and
checksum and, beyond that, are interchangeable. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftsonde.llm.arrays import durable, map_batches, text_chunks
from driftsonde.llm.token_count import WordBpe

#: Parts into which the rows of one length are dealt for ranking, so that no length is ranked in one task.
RANK_PARTS = 256


def pieces(docs: DataFrame, path: str, window: int, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """Full windows and the rest of each document: id, start, length, ids_crc32, doc_tokens."""

    def make():
        bpe = WordBpe(path)

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for part, texts in text_chunks(batch):
                ids, counts = bpe.encode(texts)
                data, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
                end = np.array([end_id], "<u4").tobytes()
                row, start, length, crc = [], [], [], []
                for i, (n, stop) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
                    whole = data[4 * (stop - n) : 4 * stop] + end
                    for at in range(0, n + 1, window):
                        own = whole[4 * at : 4 * (at + window)]
                        row.append(i)
                        start.append(at)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                yield {"key": batch.column("key").slice(part.start, part.stop - part.start).take(pa.array(row, pa.int64())), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": counts[row] + 1}

        return work

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("key"), docs[text_column].cast("string").alias("text"))
    return map_batches(rows, make, f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def combinations(counts: np.ndarray, window: int, slack: int) -> list[tuple[int, ...]]:
    """Shallow columns: for each length, its fullest partners in twos and, through evenly spread second lengths, in threes."""
    there = np.flatnonzero(counts)
    out = set()
    for a in there[::-1].tolist():
        for b in there[: np.searchsorted(there, window - a, side="right")][::-1][:3].tolist():
            if window - slack <= a + b:
                out.add((max(a, b), min(a, b)))
        seconds = there[: np.searchsorted(there, min(a, window - a - 1), side="right")]
        for b in seconds[np.unique(np.linspace(0, len(seconds) - 1, 4).astype(int))].tolist() if len(seconds) else []:
            k = np.searchsorted(there, min(b, window - a - b), side="right")
            if k and window - slack <= a + b + there[k - 1]:
                out.add((a, b, int(there[k - 1])))
    return sorted(out)


def nnls(columns: list[tuple[int, ...]], target: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Minimise |A x - target|^2 over x >= 0 by cyclic coordinate descent; a column holds the multiplicity of each length."""
    rest, x = target.astype(float).tolist(), [0.0] * len(columns)
    sparse = [[(v, c.count(v)) for v in set(c)] for c in columns]
    norms = [sum(m * m for _, m in s) for s in sparse]
    for _ in range(sweeps):
        moved = 0.0
        for j, s in enumerate(sparse):
            step = max(-x[j], sum(m * rest[v] for v, m in s) / norms[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for v, m in s:
                    rest[v] -= m * step
        if moved < 0.25:
            break
    return np.array(x)


def plan(counts: np.ndarray, window: int, slack: int = 8) -> tuple[np.ndarray, int]:
    """Slots (length, first rank, last rank + 1, first sequence, ranks a sequence, offset) for all of `counts`, and the number of sequences."""
    left, slots, sequences = counts.astype(np.int64).copy(), [], 0
    used = np.zeros(len(left), np.int64)

    def use(pattern: list[tuple[int, int]], repeats: int) -> None:
        nonlocal sequences
        at = 0
        for length, m in pattern:
            slots.append((length, used[length], used[length] + repeats * m, sequences, m, at))
            used[length] += repeats * m
            left[length] -= repeats * m
            at += length * m
        sequences += repeats

    columns = combinations(left, window, slack)
    times = nnls(columns, left)
    for j in np.argsort(-times, kind="stable").tolist():
        pattern = [(v, columns[j].count(v)) for v in sorted(set(columns[j]), reverse=True)]
        repeats = min(int(times[j]), *(int(left[v]) // m for v, m in pattern))
        if repeats > 0:
            use(pattern, repeats)
    while (there := np.flatnonzero(left)).size:
        pattern, room, k = [], window, len(there) - 1
        while k >= 0:
            v = int(there[k])
            if m := min(int(left[v]), room // v):
                pattern.append((v, m))
                room -= m * v
            k = int(np.searchsorted(there[:k], room, side="right")) - 1
        use(pattern, min(int(left[v]) // m for v, m in pattern))
    return np.array(slots, np.int64).reshape(-1, 6), sequences


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    held = durable(pieces(docs, path, window, end_id, id_column, text_column), "pieces")
    rests = held.where(F.col("length") < window).withColumn("part", F.pmod(F.xxhash64("key", "start", "ids_crc32"), F.lit(RANK_PARTS)))
    by_part = durable(rests.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")  # at most window * RANK_PARTS rows
    counts = np.zeros(window + 1, np.int64)
    for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most window rows
        counts[row["length"]] = row["n"]
    slots, sequences = plan(counts, window)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    big = int(counts.max()) + 1
    firsts = slots[:, 0] * big + slots[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            own = slots[np.searchsorted(firsts, length * big + rank, side="right") - 1] if len(slots) else np.zeros((len(length), 6), np.int64)
            k = rank - own[:, 1]
            columns = [batch.column(c) for c in ("key", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own[:, 3] + k // own[:, 4]), pa.array(own[:, 5] + k % own[:, 4] * length)], names=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    within = Window.partitionBy("length", "part").orderBy("key", "start", "ids_crc32", "doc_tokens")
    ranked = rests.withColumn("own", F.row_number().over(within) - 1).join(before, ["length", "part"])
    ranked = ranked.select("key", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("own")).alias("rank"))
    kind = held.schema["key"].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    full = held.where(F.col("length") == window).select("*", (F.monotonically_increasing_id() + sequences).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return full.unionByName(placed).withColumnRenamed("key", id_column)
