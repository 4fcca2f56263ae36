"""SentencePiece encoding and decoding, giant texts by a max-plus parallel scan.

The model at hand merges pairs (BPE with byte fallback), and its result is the one path of pieces whose neighbours are
all compatible: a and b are if the library encodes the two strings' concatenation as [a, b]. With weight 0 for
compatible neighbours and minus infinity for others, encoding is a max-plus path problem. A chunk of a giant text is
a transfer matrix from the states at its left boundary (the last piece before it, and where that ends) to those at its
right one. Pieces never hold a space behind another character, so a word start resets the state and matrices are
small; they combine associatively, in a tree, and once each chunk's ends are known it is traced back alone. Between the
first and the last word start of a chunk no state is open, so that words are encoded as such there.

Texts of at most `giant` characters are encoded word by word: distinct words are merged together as ragged arrays, the
rest come from memory. Words of very many characters are left to the library.

Decoding joins pieces, bytes of byte pieces included, turns \\u2581 into spaces and drops the one put in front. It gives
back every text without \\u2581 itself, which becomes a space. Null and empty texts have no ids. Rows are independent;
repeated rows and ties change nothing, an empty table gives an empty result, extra columns are not read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftsonde.llm.arrays import chunks, durable, map_batches, span_hashes
from driftsonde.llm.graphs import map_groups
from driftsonde.llm.token_count import MergeTable, WordMemory, merge_ragged

#: Characters of short texts handled at once: their arrays take some hundred bytes a character, besides the words kept.
AT_ONCE = 400_000

State = tuple[int, int]  # last piece, position it ends at


class PieceMerges(MergeTable):
    """All ways to join two pieces to a third, ranked by its score."""

    def __init__(self, splits: list[tuple[int, int, int, int]], size: int):
        rank, left, right, made = (np.array(x, np.int64) for x in zip(*splits, strict=True))
        self.size = size
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], rank[order].astype(np.int32)
        self.made = np.full(int(rank.max()) + 1, -1, np.int32)
        self.made[rank] = made


class PieceCodec:
    """The library's model with a bounded memory of words and of compatible pairs."""

    def __init__(self, path: str, remember: int = 1_000_000, longest: int = 200):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.ids = {p: i for i, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces))
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.pieces)]
        self.byte_ids = {self.bytes_of[i][0]: i for i in range(len(self.pieces)) if self.model.is_byte(i)}
        self.special = {i for i in range(len(self.pieces)) if self.model.is_control(i) or self.model.is_unknown(i)}
        self.remember, self.longest_word = remember, longest
        self.pairs: dict[tuple[int, int], bool] = {}
        self.steps: dict[str, list[tuple[int, int, tuple[int, ...]]]] = {}
        plain = [(i, p) for i, p in enumerate(self.pieces) if i not in self.special and not self.model.is_byte(i)]
        self.plain = {p: i for i, p in plain}
        order = {i: k for k, (i, _) in enumerate(sorted(plain, key=lambda x: -self.model.get_score(x[0])))}
        splits = [(order[i], self.ids[p[:k]], self.ids[p[k:]], i) for i, p in plain for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        self.merges = PieceMerges(splits, len(self.pieces))
        self.single = np.full(0x110000, -1, np.int32)
        for i, p in plain:
            if len(p) == 1:
                self.single[ord(p)] = i
        raw = [self.bytes_of[i] for i in range(len(self.pieces))]
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.memory = WordMemory(self._merge, remember)

    def surface(self, text: str) -> str:
        """What the model cuts into pieces: spaces escaped, one put in front."""
        return "▁" + text.replace(" ", "▁") if text else ""

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words; those of very many characters by the library."""
        short = [w if len(w) <= self.longest_word else "" for w in words]
        codes = np.frombuffer("".join(short).encode("utf-32-le"), np.uint32)
        symbols, owner = self.single[codes], np.repeat(np.arange(len(words)), [len(w) for w in short])
        lost = np.flatnonzero(symbols < 0)
        if len(lost):
            raw = [[self.byte_ids[b] for b in chr(c).encode()] for c in codes[lost].tolist()]
            many = np.ones(len(symbols), np.int64)
            many[lost] = [len(x) for x in raw]
            owner = np.repeat(owner, many)
            at = np.repeat(np.isin(np.arange(len(symbols)), lost), many)
            symbols = np.repeat(symbols, many)
            symbols[at] = [i for x in raw for i in x]
        ids, numbers = merge_ragged(symbols, np.bincount(owner, minlength=len(words)), self.merges)
        long = [k for k, w in enumerate(words) if len(w) > self.longest_word]
        if long:
            parts = np.split(ids, np.cumsum(numbers)[:-1])
            for k in long:
                parts[k] = np.array(self.model.encode(words[k][1:].replace("▁", " ")), np.int32)
            ids, numbers = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, numbers

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and their numbers."""
        surface = [self.surface(x) for x in texts]
        joined = "".join(surface)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(x) for x in surface], np.int64)
        ends = np.cumsum(sizes)
        space = codes == 0x2581
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[(ends - sizes)[sizes > 0]] = True  # a text's start
        starts = np.flatnonzero(first)
        hashes, lengths = span_hashes(codes, np.ones(len(codes), bool), starts)
        slot = self.memory.slots(hashes, starts, lengths, joined)
        number = self.memory.number[slot]
        total = np.append(0, np.cumsum(number))
        return self.memory.gather(slot, number), np.diff(total[np.searchsorted(starts, ends)], prepend=0)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode_many(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of each run of ids."""
        size = self.raw_size[ids]
        begin = np.cumsum(size) - size
        data = self.raw[np.arange(int(size.sum())) + np.repeat(self.raw_at[ids] - begin, size)].tobytes()
        ends = np.append(0, np.cumsum(size))[np.cumsum(counts)].tolist()
        return [data[a + (data[a : a + 1] == b" ") : b] for a, b in zip([0, *ends], ends, strict=False)]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_many(ids, np.array([len(ids)]))[0].decode("utf-8", "replace")

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the two pieces' characters is these two pieces."""
        if (a, b) not in self.pairs:
            if len(self.pairs) > self.remember:
                self.pairs.clear()
            x, y = self.pieces[a], self.pieces[b]
            if self.model.is_byte(a) or self.model.is_byte(b):  # characters without a piece of their own merge with nothing
                self.pairs[a, b] = True
            else:
                # A letter after a line end starts no word, and neither does what follows it.
                got = self.model.encode("\n" + (x + y).replace("▁", " "))
                self.pairs[a, b] = got[2:] == [a, b]
        return self.pairs[a, b]

    def _step(self, text: str, at: int) -> list[tuple[int, int, tuple[int, ...]]]:
        """Pieces that start at `at`: (end, last id, ids)."""
        own = text[at : at + self.longest]
        known = self.steps.get(own)
        if known is None:
            if len(self.steps) > self.remember:
                self.steps.clear()
            known = [(n, i, (i,)) for n in range(1, len(own) + 1) if (i := self.plain.get(own[:n])) is not None]
            if not known or known[0][0] > 1:  # a character without a piece of its own
                raw = tuple(self.byte_ids[b] for b in own[0].encode())
                known.append((1, raw[-1], raw))
            self.steps[own] = known
        return [(at + n, i, ids) for n, i, ids in known]

    def entries(self, text: str, at: int) -> list[State]:
        """All states that may hold at a boundary: pieces that start before it and end at or behind it."""
        out = []
        for begin in range(max(0, at - self.longest), at):
            out += [(piece, end) for end, piece, _ in self._step(text, begin) if end >= at]
        return sorted(set(out))

    def transfer(self, text: str, entries: list[State | None], stop: int, last: bool) -> list[tuple[int, State]]:
        """Entries (as bit masks) and the states at `stop` that they reach, through all of the text between."""
        reach: dict[int, dict[int, int]] = {}
        out: dict[State, int] = {}
        for k, entry in enumerate(entries):
            piece, at = entry or (-1, 0)
            if at >= stop and (at == stop or not last):
                out[piece, at] = out.get((piece, at), 0) | 1 << k
            elif at < stop:
                own = reach.setdefault(at, {})
                own[piece] = own.get(piece, 0) | 1 << k
        for i in range(min(reach, default=stop), stop):
            for before, mask in reach.pop(i, {}).items():
                for end, piece, ids in self._step(text, i):
                    if before < 0 or self.compatible(before, ids[0]):
                        if end < stop:
                            own = reach.setdefault(end, {})
                            own[piece] = own.get(piece, 0) | mask
                        elif end == stop or not last:
                            out[piece, end] = out.get((piece, end), 0) | mask
        return [(mask, state) for state, mask in out.items()]

    def matrix(self, text: str, begin: int, stop: int, last: bool) -> list[tuple[State, State]]:
        """A chunk's transfer matrix: the pairs of boundary states whose weight is 0. begin: 0 is the text's own start."""
        entries = self.entries(text, begin) if begin else [None]
        head, tail = word_start(text, begin), last_word_start(text, stop)
        if begin < head < stop or head == begin > 0:  # a word starts in the chunk: what is before and behind don't touch
            near = 0
            for mask, _ in self.transfer(text[:head], entries, head, True):
                near |= mask
            exits = [state for _, state in self.transfer(text, [(-1, tail)], stop, last)] if tail < stop else None
            if exits is None:
                return [(e or (-1, 0), (-1, stop)) for k, e in enumerate(entries) if near >> k & 1]
            return [(e or (-1, 0), x) for k, e in enumerate(entries) if near >> k & 1 for x in exits]
        return [(entries[k] or (-1, 0), x) for mask, x in self.transfer(text, entries, stop, last) for k in range(len(entries)) if mask >> k & 1]

    def trace(self, text: str, entry: State, goal: State) -> list[int]:
        """The ids from an entry state to an exit state."""
        piece, at = entry
        if goal[1] <= at:
            return []
        head, tail = word_start(text, at), last_word_start(text, goal[1])
        if head < tail:
            middle = self.encode_words(text[head:tail])
            return [*self._path(text, piece, at, None, head), *middle, *self._path(text, -1, tail, goal[0], goal[1])]
        return self._path(text, piece, at, goal[0], goal[1])

    def _path(self, text: str, piece: int, begin: int, goal: int | None, end: int) -> list[int]:
        reach: dict[int, dict[int, tuple]] = {begin: {piece: ()}}
        for i in range(begin, end):
            for before, chain in reach.pop(i, {}).items():
                for e, p, ids in self._step(text[:end], i):
                    if before < 0 or self.compatible(before, ids[0]):
                        reach.setdefault(e, {}).setdefault(p, (chain, ids))
        found = reach.get(end, {})
        chain = found[goal] if goal is not None and goal >= 0 else next(iter(found.values()))
        out = []
        while chain:
            chain, ids = chain
            out.append(ids)
        return [i for ids in reversed(out) for i in ids]

    def encode_words(self, surface: str) -> list[int]:
        """Ids of whole words."""
        return self.encode(surface[1:].replace("▁", " ")).tolist() if surface else []


def word_start(text: str, at: int) -> int:
    """The first word start at or behind `at`, or the end. Position 0 is one."""
    for i in range(at, len(text)):
        if i == 0 or text[i] == "▁" and text[i - 1] != "▁":
            return i
    return len(text)


def last_word_start(text: str, at: int) -> int:
    """The last word start before `at`, or 0."""
    for i in range(at - 1, 0, -1):
        if text[i] == "▁" and text[i - 1] != "▁":
            return i
    return 0


def compose(left: set[tuple[State, State]], right: set[tuple[State, State]]) -> set[tuple[State, State]]:
    """Max-plus product of matrices of weights 0 and minus infinity, kept as the pairs of weight 0."""
    onward: dict[State, list[State]] = {}
    for b, c in right:
        onward.setdefault(b, []).append(c)
    return {(a, c) for a, b in left for c in onward.get(b, ())}


Matrix = set[tuple[State, State]]


def products(matrices: list[Matrix]) -> list[list[Matrix]]:
    """A tree over the matrices: level by level, neighbours composed; an odd last one goes up as it is."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([compose(row[i], row[i + 1]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)])
    return levels


def states(matrices: list[Matrix]) -> list[State]:
    """The states at all boundaries of the one path through all matrices: down the tree, each node's ends give the state between its halves."""
    levels = products(matrices)
    ends = [min(levels[-1][0])]
    for row in reversed(levels[:-1]):
        below = []
        for i, (a, c) in enumerate(ends):
            if 2 * i + 1 == len(row):
                below.append((a, c))
                continue
            after = {x for x, y in row[2 * i + 1] if y == c}
            middle = min(y for x, y in row[2 * i] if x == a and y in after)
            below += [(a, middle), (middle, c)]
        ends = below
    return [ends[0][0], *(c for _, c in ends)]


def split(surface: str, chunk: int, margin: int) -> list[tuple[int, int, int, str]]:
    """(begin, stop, offset of the slice, slice) of each chunk; slices overlap by `margin` characters on both sides."""
    cuts = [*range(0, len(surface), chunk), len(surface)]
    return [(a, b, max(0, a - margin), surface[max(0, a - margin) : b + margin]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def encode_giant(codec: PieceCodec, text: str, chunk: int) -> list[int]:
    """A whole text by way of its chunks, in one place; encode_docs does the same over the cluster."""
    surface = codec.surface(text)
    if not surface:
        return []
    parts = split(surface, chunk, codec.longest + 1)
    made = [_matrix(codec, *p, len(surface)) for p in parts]
    path = states(made)
    return [i for p, a, b in zip(parts, path, path[1:], strict=False) for i in _trace(codec, p[2], p[3], a, b)]


def _matrix(codec: PieceCodec, begin: int, stop: int, offset: int, own: str, whole: int) -> set[tuple[State, State]]:
    move = lambda s: (s[0], s[1] + offset)
    guard = "\n" if offset else ""  # a slice's start is not the text's
    shift = len(guard)
    pairs = codec.matrix(guard + own, begin - offset + shift, stop - offset + shift, stop == whole)
    return {((a[0], a[1] + offset - shift) if begin else a, move((b[0], b[1] - shift))) for a, b in pairs}


def _trace(codec: PieceCodec, offset: int, own: str, entry: State, goal: State) -> list[int]:
    guard = "\n" if offset else ""
    at = lambda s: (s[0], s[1] - offset + len(guard))
    return codec.trace(guard + own, at(entry) if entry != (-1, 0) else entry, at(goal))


def encode_docs(docs: DataFrame, path: str, giant: int = 65_536, chunk: int = 16_384, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_ids, ids_crc32 (ids as little-endian unsigned 32 bits), round_trip (decoding gives the text back).

    Texts longer than `giant` are cut in chunks; shorter ones are one chunk, of which nothing is to be combined.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("key"), docs[text_column].cast("string").alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))
    result = f"key {kind}, n_ids bigint, ids_crc32 bigint, round_trip boolean"

    def short():
        codec = PieceCodec(path)

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for part in chunks(pc.coalesce(pc.utf8_length(batch.column("text")), 0).to_pylist(), AT_ONCE):
                texts = [x or "" for x in batch.column("text")[part.start : part.stop].to_pylist()]
                ids, counts = codec.encode_many(texts)
                data, ends = ids.astype("<i4").tobytes(), np.cumsum(counts).tolist()
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip([0, *ends], ends, strict=False)]
                same = [x == y.encode() for x, y in zip(codec.decode_many(ids, counts), texts, strict=True)]
                yield {"key": batch.column("key")[part.start : part.stop], "n_ids": counts, "ids_crc32": crc, "round_trip": same}

        return work

    def cut():
        codec = PieceCodec(path)

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for k, text in enumerate(batch.column("text").to_pylist()):
                surface = codec.surface(text)
                begin, stop, offset, own = zip(*split(surface, chunk, codec.longest + 1), strict=True)
                n = len(begin)
                yield {"key": batch.column("key").take(pa.array([k] * n)), "doc": [uuid.uuid4().int >> 65] * n, "chunk": list(range(n)), "begin": begin, "stop": stop, "off": offset, "own": own, "whole": [len(surface)] * n}

        return work

    def matrices():
        codec = PieceCodec(path)

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            made = [json.dumps(sorted(_matrix(codec, *(r[c] for c in ("begin", "stop", "off", "own", "whole"))))) for r in batch.to_pylist()]
            yield {"doc": batch.column("doc"), "chunk": batch.column("chunk"), "matrix": made}

        return work

    def scan(groups: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups:
            made = [{(tuple(a), tuple(b)) for a, b in json.loads(m)} for m in g.column("matrix").to_pylist()]
            at = json.dumps(states(made))
            path_of = json.loads(at)
            yield pa.RecordBatch.from_arrays([g.column("doc"), g.column("chunk"), pa.array([json.dumps(x) for x in zip(path_of, path_of[1:], strict=False)])], names=["doc", "chunk", "ends"])

    def traces():
        codec = PieceCodec(path)

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            ids, same = [], []
            for r in batch.to_pylist():
                a, b = (tuple(x) for x in json.loads(r["ends"]))
                got = _trace(codec, r["off"], r["own"], a, b)
                want = r["own"][a[1] - r["off"] : b[1] - r["off"]].replace("▁", " ").encode()
                ids.append(np.array(got, "<i4").tobytes())
                same.append(b"".join(codec.bytes_of[i] for i in got) == want)
            yield {"key": batch.column("key"), "doc": batch.column("doc"), "chunk": batch.column("chunk"), "ids": pa.array(ids, pa.binary()), "same": same}

        return work

    def gather(groups: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups:
            ids = b"".join(g.column("ids").to_pylist())
            columns = [g.column("key").slice(0, 1), pa.array([len(ids) // 4]), pa.array([zlib.crc32(ids)]), pa.array([all(g.column("same").to_pylist())])]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_ids", "ids_crc32", "round_trip"])

    pieces = durable(map_batches(rows.where(size > giant), cut, f"key {kind}, doc bigint, chunk int, begin bigint, stop bigint, off bigint, own string, whole bigint"), "giants")
    spread = pieces.repartition("doc", "chunk")
    found = map_groups(map_batches(spread, matrices, "doc bigint, chunk int, matrix string"), ["doc"], scan, "doc bigint, chunk int, ends string", within=["chunk"])
    traced = map_batches(pieces.join(found, ["doc", "chunk"]), traces, f"key {kind}, doc bigint, chunk int, ids binary, same boolean")
    large = map_groups(traced, ["doc"], gather, result, within=["chunk"])
    return map_batches(rows.where(size <= giant), short, result).unionByName(large).withColumnRenamed("key", id_column)
