"""Token counts by rank-synchronous merging of ragged symbol arrays.

Pre-tokens of a batch of texts are cut by character class, reduced to distinct ones by hash, and those not seen
before are held as one ragged array of symbols. Each round merges, in every sequence at once, the pair of lowest
rank; sequences without a known pair leave the array. What is left of each are its tokens.

Null and empty texts have no tokens. Rows are independent: repeated rows, ties and extra columns change nothing, an
empty table gives an empty result. Texts of any length are taken whole.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftsonde.llm.arrays import map_batches, span_hashes, text_chunks

_NONE = np.int32(2**31 - 1)
SPACE, LETTER, NUMBER, OTHER, ODD = range(5)
#: White_Space of Unicode.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def character_classes() -> np.ndarray:
    """Class of each code point; ODD ones (outside the basic plane, or unassigned here) are left to the library."""
    kinds = np.full(0x110000, ODD, np.uint8)
    for c in range(0x10000):
        k = unicodedata.category(chr(c))
        kinds[c] = ODD if k in ("Cn", "Cs") else LETTER if k[0] == "L" else NUMBER if k[0] == "N" else OTHER
    kinds[_WHITE] = SPACE
    return kinds


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class MergeTable:
    """Ranked merges, looked up by pairs of symbol ids."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)


def merge_ragged(symbols: np.ndarray, lengths: np.ndarray, merges: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge every sequence to its tokens: (ids of all sequences one after another, their numbers)."""
    counts, done = np.zeros(len(lengths), np.int64), []
    owner = np.repeat(np.arange(len(lengths)), lengths)
    symbols = symbols.astype(np.int32)

    def ranked(sym: np.ndarray, own: np.ndarray) -> np.ndarray:
        rank = np.full(len(sym), _NONE, np.int32)
        if len(sym) > 1:
            inner = np.flatnonzero(own[1:] == own[:-1])
            rank[inner] = merges.rank(sym[inner], sym[inner + 1])
        return rank

    rank = ranked(symbols, owner)
    while len(symbols):
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        least = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(owner)))
        over = np.repeat(least == _NONE, sizes)
        if over.any():
            counts += np.bincount(owner[over], minlength=len(counts))
            done.append((owner[over], symbols[over]))
            symbols, owner, rank = symbols[~over], owner[~over], rank[~over]
            least, sizes = least[least != _NONE], sizes[least != _NONE]
            if not len(symbols):
                break
        hit = rank == np.repeat(least, sizes)
        at = np.flatnonzero(hit)
        touching = np.append(False, np.diff(at) == 1)
        if touching.any():  # of x x x, the left pair merges
            run = np.cumsum(~touching) - 1
            at = at[(np.arange(len(at)) - np.flatnonzero(~touching)[run]) % 2 == 0]
        symbols[at] = merges.made[rank[at]]
        live = np.ones(len(symbols), bool)
        live[at + 1] = False
        changed = np.zeros(len(symbols), bool)
        changed[at] = True
        symbols, owner, rank, changed = symbols[live], owner[live], rank[live], changed[live]
        redo = changed.copy()
        redo[:-1] |= changed[1:]
        redo = np.flatnonzero(redo)
        last = len(symbols) - 1
        nxt = np.minimum(redo + 1, last)
        inner = (redo < last) & (owner[nxt] == owner[redo])
        rank[redo] = _NONE
        rank[redo[inner]] = merges.rank(symbols[redo[inner]], symbols[redo[inner] + 1])
    if not done:
        return np.zeros(0, np.int32), counts
    owners, ids = (np.concatenate(x) for x in zip(*done, strict=True))
    return ids[np.argsort(owners, kind="stable")], counts


class WordMemory:
    """Ids of distinct words by hash; `merge` gives those of new ones. At most `most` words are kept between calls."""

    def __init__(self, merge, most: int):
        self.merge, self.most = merge, most
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.where = self.number = np.zeros(0, np.int64)
        self.store = np.zeros(0, np.int32)

    def slots(self, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, text: str) -> np.ndarray:
        """The place of each word of `text` in the memory."""
        seen, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        new = ~np.isin(seen, self.known, assume_unique=True)
        if len(self.known) and len(self.known) + int(new.sum()) > self.most:
            self.forget()
            new[:] = True
        if new.any():
            at = first[new]
            ids, numbers = self.merge([text[a : a + n] for a, n in zip(starts[at].tolist(), sizes[at].tolist(), strict=True)])
            place = np.searchsorted(self.known, seen[new])
            self.where = np.insert(self.where, place, len(self.store) + np.cumsum(numbers) - numbers)
            self.number = np.insert(self.number, place, numbers)
            self.known = np.insert(self.known, place, seen[new])
            self.store = np.concatenate((self.store, ids))
        return np.searchsorted(self.known, seen)[inverse] if len(seen) else np.zeros(0, np.int64)

    def gather(self, slot: np.ndarray, number: np.ndarray) -> np.ndarray:
        begin = np.cumsum(number) - number
        return self.store[np.arange(int(number.sum())) + np.repeat(self.where[slot] - begin, number)]


class WordBpe:
    """Byte-level BPE with word ends over lower-cased, normalised text, as the tokenizers file at `path` defines it.

    Texts with added tokens' strings or ODD characters, and pre-tokens of more than `longest` characters, go to the
    library itself. `remember` bounds the distinct pre-tokens kept between batches.
    """

    def __init__(self, path: str, remember: int = 1_000_000, longest: int = 200):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.merges = MergeTable(vocab, spec["model"]["merges"])
        stand = byte_symbols()
        self.inner = np.array([vocab[x] for x in stand], np.int32)
        self.final = np.array([vocab[x + self.suffix] for x in stand], np.int32)
        self.kinds = character_classes()
        self.longest = longest
        self.memory = WordMemory(self._merge, remember)

    def _clean(self, text: str) -> str | None:
        if any(x in text for x in self.added):
            return None
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _pretokens(self, codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Where pre-tokens start: letters, single numbers, others, and the contractions that may follow a word."""
        first = kinds != SPACE
        first[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
        quotes = np.flatnonzero(codes[:-3] == 39) if len(codes) > 3 else np.zeros(0, np.int64)
        quotes = quotes[(quotes == 0) | (kinds[quotes - 1] != OTHER)]
        one, two = codes[quotes + 1], codes[quotes + 2]
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        for at, n in ((quotes[short], 2), (quotes[long], 3)):
            for k in range(1, n):
                first[at + k] = False
            first[at + n] |= kinds[at + n] != SPACE
        return np.flatnonzero(first)

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        short = [w for w in words if len(w) <= self.longest]
        raw = [w.encode() for w in short]
        codes, lengths = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        symbols = self.inner[codes]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.final[codes[ends]]
        ids, numbers = merge_ragged(symbols, lengths, self.merges)
        if len(short) < len(words):
            pieces, mine = np.split(ids, np.cumsum(numbers)[:-1]) if len(numbers) else [], iter(range(len(short)))
            every = [pieces[next(mine)] if len(w) <= self.longest else np.array(self.library.encode(w, add_special_tokens=False).ids, np.int32) for w in words]
            ids, numbers = np.concatenate(every), np.array([len(x) for x in every], np.int64)
        return ids, numbers

    def encode(self, texts: list[str], ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, or none if not asked for; the number of each text's tokens)."""
        clean = [self._clean(x) for x in texts]
        own = {i for i, x in enumerate(clean) if x is None}
        joined = "\n".join(x or "" for x in clean) + "\n\n\n\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kinds[codes]
        ends = np.cumsum([len(x or "") + 1 for x in clean])
        if odd := set(np.searchsorted(ends, np.flatnonzero(kinds == ODD), side="right").tolist()):
            own |= odd
            kinds[kinds == ODD] = OTHER
        starts = self._pretokens(codes, kinds)
        hashes, sizes = span_hashes(codes, kinds != SPACE, starts)
        slot = self.memory.slots(hashes, starts, sizes, joined)
        number = self.memory.number[slot]
        bounds = np.searchsorted(starts, ends)
        total = np.append(0, np.cumsum(number))
        counts = np.diff(total[bounds], prepend=0)
        out = self.memory.gather(slot, number) if ids else np.zeros(0, np.int32)
        if own:
            library = {i: np.array(x.ids, np.int32) for i, x in zip(sorted(own), self.library.encode_batch([texts[i] for i in sorted(own)], add_special_tokens=False), strict=True)}
            if ids:
                parts = np.split(out, np.cumsum(counts)[:-1])
                out = np.concatenate([library.get(i, x) for i, x in enumerate(parts)])
            counts = np.array([len(library[i]) if i in library else n for i, n in enumerate(counts.tolist())], np.int64)
        return out, counts


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of `docs`: its id, n_bytes (UTF-8), n_tokens and whether they exceed `limit`."""

    def make():
        bpe = WordBpe(path)

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for part, texts in text_chunks(batch):
                _, counts = bpe.encode(texts, ids=False)
                yield {"key": batch.column("key")[part.start : part.stop], "n_bytes": [len(x.encode()) for x in texts], "n_tokens": counts, "over_limit": counts > limit}

        return work

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("key"), docs[text_column].cast("string").alias("text"))
    return map_batches(rows, make, f"key {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("key", id_column)
