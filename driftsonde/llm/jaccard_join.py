"""N-gram Jaccard join by T-occurrence search.

A document's set holds the 64-bit hashes of its distinct word shingles; equal sets form a class. Classes of similar
size are routed to blocks by signatures: a set is cut by hash range into more parts than linked sets can differ in, so
some part of any two linked sets is equal. Of classes that share a part's signature, those stay together whose parity
sketches differ in no more bits than linked sets can have differing shingles: each such shingle turns one bit. Classes
kept together, directly or over others, make a block. In a block (or in tiles of it, if it is large) each set is a query against an inverted index: T, the overlap
the threshold needs, lets DivideSkip leave the longest lists out; the short ones are merged, and only the candidates
that reach the rest of T there are probed for, by binary search, in the long ones.

Words are maximal runs of characters other than \\x20 and \\x09-\\x0D after lower-casing A-Z. A text of fewer words than
a shingle has one shingle, the whole sequence. Null, empty and blank texts have empty sets and link with nothing.
Repeated rows are linked copies; rows that share an id share a component. Ties don't matter: a component's id is its
smallest. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import bisect
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftsonde.llm.arrays import byte_words, durable, map_batches, mix64, text_chunks
from driftsonde.llm.graphs import Forest, connected_components, map_groups, spanning, tiles

_A, _B, _C = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def shingle_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after another, and their numbers."""
    words, counts = byte_words([x.encode() for x in texts])
    with np.errstate(over="ignore"):
        total = max(0, len(words) - n + 1)
        rolled = np.zeros(total, np.uint64)
        for i in range(n):
            rolled = mix64(rolled * _A + words[i : i + total])
        owner = np.repeat(np.arange(len(texts)), counts)
        whole = np.flatnonzero(owner[n - 1 :] == owner[:total]) if total else np.zeros(0, np.int64)
        hashes, owners = rolled[whole], owner[whole]
        few = np.flatnonzero((counts > 0) & (counts < n))
        if len(few):
            begin = np.cumsum(counts) - counts
            single = []
            for i in few.tolist():
                h = np.zeros(1, np.uint64)
                for w in words[begin[i] : begin[i] + counts[i]]:
                    h = mix64(h * _A + w)
                single.append(mix64(h + np.uint64(counts[i]))[0])
            hashes, owners = np.append(hashes, np.array(single, np.uint64)), np.append(owners, few)
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[new], np.bincount(owners[new], minlength=len(texts))


class Bands:
    """Set sizes in bands such that linked sets are in one or in neighbouring bands. num/den is the threshold."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low = num, den, [1]

    def _grow(self) -> None:
        self.low.append(self.low[-1] * self.den // self.num + 1)

    def of(self, size: int) -> int:
        while self.low[-1] <= size:
            self._grow()
        return bisect.bisect_right(self.low, size) - 1

    def parts(self, band: int) -> int:
        """Two parts more than linked sets can differ in, so that two are equal. 1 if only equal sets link."""
        while len(self.low) < band + 2:
            self._grow()
        differ = (self.low[band + 1] - 1) * (self.den - self.num) // self.num
        return differ + 2 if differ else 1


def part_signatures(hashes: np.ndarray, band: int, parts: int) -> np.ndarray:
    """Signatures of a set's parts by hash range. With two or more empty parts, pairs of those have signatures too: an untouched part may be empty."""
    at = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    with np.errstate(over="ignore"):
        tag = np.uint64(band * 2 + 1) * _B
        sums = np.add.reduceat(mix64(hashes + _C), starts)
        out = mix64(sums + tag + at[starts] * _C)
        if len(starts) + 2 <= parts:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), at[starts])
            x, y = np.triu_indices(len(empty), 1)
            out = np.append(out, mix64(mix64(empty[x] * _A + empty[y]) + tag))
    return out


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set."""
    with np.errstate(over="ignore"):
        return tuple(int(np.add.reduce(mix64(x)).view(np.int64)) if len(x) else 0 for x in (hashes ^ _B, hashes + _C))


def parity_sketch(hashes: np.ndarray) -> bytes:
    """How often each low end of a hash occurs, modulo 2: a power of two of bits, the set's size or more."""
    bits = max(256, 1 << max(0, len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def near_sketches(sketches: list[bytes], sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs (upper triangle) may link: sketches folded to the shortest one's length differ in few enough bits."""
    least = min(map(len, sketches))
    words = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, least // 8), axis=0) for x in sketches])
    differ = np.zeros((len(words), len(words)), np.int64)
    for w in range(words.shape[1]):
        differ += np.bitwise_count(words[:, w, None] ^ words[None, :, w])
    return np.triu(differ * (den + num) <= (den - num) * (sizes[:, None] + sizes[None, :]), 1)


def _class_rows(docs: DataFrame, n: int, num: int, den: int, id_column: str, text_column: str) -> DataFrame:
    """Per row: key, n_shingles, two digests of the set, the signatures of its parts and its parity sketch."""

    def make():
        bands = Bands(num, den)
        once: set[int] = set()  # sets whose signatures this task gave already; bounded, a miss only repeats them

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for part, texts in text_chunks(batch):
                hashes, counts = shingle_sets(texts, n)
                ends = np.cumsum(counts)
                d1, d2, given, sketches = [], [], [], []
                with np.errstate(over="ignore"):
                    for i, (size, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
                        own = slice(end - size, end)
                        for d, x in zip((d1, d2), digest(hashes[own]), strict=True):
                            d.append(x)
                        sketches.append(None)
                        if not size or d1[-1] in once:
                            given.append(None)
                            continue
                        sketches[-1] = parity_sketch(hashes[own])
                        if len(once) > 200_000:
                            once.clear()
                        once.add(d1[-1])
                        band = bands.of(size)
                        sigs = [part_signatures(hashes[own], b, k) for b in (band, band - 1) if b >= 0 and (k := bands.parts(b)) > 1]
                        given.append(np.concatenate(sigs).view(np.int64) if sigs else None)
                yield {"key": batch.column("key")[part.start : part.stop], "n_shingles": counts, "d1": d1, "d2": d2, "signatures": pa.array(given, pa.list_(pa.int64())), "sketch": pa.array(sketches, pa.binary())}

        return work

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("key"), docs[text_column].cast("string").alias("text"))
    return map_batches(rows, make, f"key {kind}, n_shingles bigint, d1 bigint, d2 bigint, signatures array<bigint>, sketch binary")


def divide_skip(sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links among a tile's sets that connect what all links would: T-occurrence search, each set against an index of the smaller ones.

    side: only sets of different sides are compared, unless all are of one.
    """
    n, forest, out = len(sets), Forest(len(sets)), []
    across = bool(len(side)) and bool((side != side[0]).any())
    sizes = np.array([len(x) for x in sets])
    order = np.argsort(sizes, kind="stable")
    every = np.concatenate(sets)
    ids, which = np.unique(every, return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    by = np.lexsort((place[owner], which))
    lists, members = which[by], place[owner][by]  # an inverted list holds places, ascending
    begin = np.searchsorted(lists, np.arange(len(ids) + 1))
    pairs = lists * n + members  # ascending: binary search finds a list's member
    lengths = np.diff(begin)
    starts = np.cumsum(sizes) - sizes
    for at in range(1, n):
        x = int(order[at])
        own = which[starts[x] : starts[x] + sizes[x]]
        least = -(-num * int(sizes[x]) // den)  # smaller sets of fewer shingles can't link
        own = own[np.argsort(lengths[own], kind="stable")]
        short, long = own[: len(own) - least + 1], own[len(own) - least + 1 :]  # T >= least: a link shows in a short list
        runs = [members[a:b] for a, b in zip(begin[short].tolist(), begin[short + 1].tolist(), strict=True) if b - a > 1]
        if not runs:
            continue
        heap = Counter(heapq.merge(*(r.tolist() for r in runs))) if sum(map(len, runs)) <= 64 else _counted(runs)
        low = int(np.searchsorted(sizes[order], least))
        cand = [(c, k) for c, k in heap.items() if low <= c < at]
        cand = [(c, k) for c, k in cand if (not across or side[order[c]] != side[x]) and forest.find(x) != forest.find(int(order[c]))]
        cand.sort(key=lambda ck: -ck[1])
        for c, k in cand:
            y = int(order[c])
            if forest.find(x) == forest.find(y):
                continue
            want = -(-num * (int(sizes[x]) + int(sizes[y])) // (num + den))
            if k + len(long) < want:
                continue
            probe = long * n + c
            slot = np.minimum(np.searchsorted(pairs, probe), len(pairs) - 1)
            if k + int((pairs[slot] == probe).sum()) >= want:
                forest.union(x, y)
                out.append((x, y))
    return out


def _counted(runs: list[np.ndarray]) -> dict[int, int]:
    """What merging many lists gives: each member and in how many it is."""
    got, number = np.unique(np.concatenate(runs), return_counts=True)
    return dict(zip(got.tolist(), number.tolist(), strict=True))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_column: str = "doc_id", text_column: str = "text", most: int = 128) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id. Sets link if den * |intersection| >= num * |union|."""
    rows = durable(_class_rows(docs, n, num, den, id_column, text_column), "sets")
    classes = rows.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("key").alias("first"))
    given = rows.select(F.explode("signatures").alias("s"), F.col("d1").alias("a"))
    ordered = Window.partitionBy("s").orderBy("a")  # frames of a row or up to it: nothing of a group is held
    alike = given.withColumn("low", F.first("a").over(ordered)).withColumn("next", F.lead("a").over(ordered))
    alike = alike.where("(next is null and low <> a) or next <> a").select("s", "a")  # once each, and not alone
    sketches = rows.where("sketch is not null").groupBy("d1").agg(F.first("sketch").alias("sketch"), F.first("n_shingles").alias("size")).withColumnRenamed("d1", "a")

    def route(groups: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for g in (g for g in groups if len(g) > 1):
            chunk, node = g.column("chunk").to_numpy(), g.column("a").to_numpy()
            near = near_sketches(g.column("sketch").to_pylist(), g.column("size").to_numpy(), num, den)
            if (chunk != chunk[0]).any():
                near &= chunk[:, None] != chunk[None, :]
            for x, y in spanning(*np.nonzero(near), len(node)):
                a.append(node[x])
                b.append(node[y])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    alike = tiles(durable(alike, "alike"), node="a", block="s", most=most).join(sketches, "a")
    routed = connected_components(map_groups(alike, ["s", "tile_i", "tile_j"], route, "a bigint, b bigint"))

    def search(groups: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for g in groups:
            hashes, counts = shingle_sets([x or "" for x in g.column("text").to_pylist()], n)
            sets = np.split(hashes, np.cumsum(counts)[:-1])
            chunk, node = g.column("chunk").to_numpy(), g.column("node").to_pylist()
            own = [i for i, x in enumerate(sets) if digest(x)[0] == node[i]]  # not another text of the same id
            if len(own) < len(sets):
                sets, chunk, node = [sets[i] for i in own], chunk[own], [node[i] for i in own]
            if not sets:
                continue
            if g.column("tile_i")[0] != g.column("tile_j")[0] and (chunk == chunk[0]).all():
                continue
            for x, y in divide_skip(sets, chunk, num, den):
                a.append(node[x])
                b.append(node[y])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    members = classes.join(routed, F.col("d1") == F.col("node")).groupBy("node").agg(F.first("component").alias("block"), F.min("first").alias("key"))
    texts = docs.select(docs[id_column].alias("key"), docs[text_column].cast("string").alias("text"))
    found = connected_components(map_groups(durable(tiles(members.join(texts, "key"), most=most), "tiles"), ["block", "tile_i", "tile_j"], search, "a bigint, b bigint"))
    linked = classes.join(found, F.col("d1") == F.col("node"), "left").select("d1", "d2", "first", F.coalesce("component", "d1").alias("component"))
    least = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    known = linked.join(least, "component").select("d1", "d2", "component_id")
    by_id = rows.select("key", "n_shingles", "d1", "d2").join(known, ["d1", "d2"], "left")
    return by_id.select(F.col("key").alias(id_column), "n_shingles", F.coalesce("component_id", "key").alias("component_id"))
