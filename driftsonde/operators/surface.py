"""Phrase search on normalised surfaces: exact, fuzzy by trigrams and common substrings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count, groupby
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from driftsonde.functions.unicode import surface_of
from driftsonde.sources.steps import spread


def surface(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def ngrams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams; the whole text if it has no more than n characters."""
    return F.when(F.length(text) <= n, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))))


def longest_common(phrase: Column, text: Column) -> Column:
    """Length of the phrase's longest substring that the text holds."""
    n = F.length(phrase)
    held = lambda size: F.exists(F.sequence(F.lit(1), n - size + 1), lambda i: F.contains(text, F.substring(phrase, i, size)))
    return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), n), held)), F.lit(0))


def fuzzy_score(phrase: Column, text: Column, least_cover: float = 0.55, least: float = 0.78) -> Column:
    """.65 trigram cover + .35 common substring share, 0 below `least`; phrases of under five characters have no fuzzy score."""
    grams = ngrams(phrase)
    cover = F.size(F.array_intersect(grams, ngrams(text))) / F.size(grams)
    score = 0.65 * cover + 0.35 * longest_common(phrase, text) / F.length(phrase)
    return F.when((F.length(phrase) >= 5) & (cover >= least_cover), F.when(score >= least, score).otherwise(0.0)).otherwise(0.0)


#: Characters by which a string is looked for, and of a pack of texts that is searched at once.
MOST, PACK = 16, 1 << 18


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Finder:
    """Rows of characters (by length, at most MOST), found at all places of a text at once: a window's hash leads to rows, whose characters are compared."""

    def __init__(self, rows: dict[int, np.ndarray]):
        for salt in count(1):
            self.factor = np.uint64(2 * salt * 0x5851F42D4C957F2D & (1 << 64) - 1 | 1)
            self.sizes = {size: self._size(rows[size]) for size in sorted(rows) if len(rows[size])}
            if all(x is not None for x in self.sizes.values()):
                return

    def _size(self, rows: np.ndarray) -> tuple | None:
        """None if different rows have one hash; then another factor is tried."""
        hashes = np.zeros(len(rows), np.uint64)
        for k in range(rows.shape[1]):
            hashes = hashes * self.factor + _mixed(rows[:, k])
        order = np.argsort(hashes, kind="stable")
        known, first, n = np.unique(hashes[order], return_index=True, return_counts=True)
        if (rows[order] != np.repeat(rows[order[first]], n, 0)).any():
            return None
        shift = np.uint64(64 - min(24, max(16, int(len(known)).bit_length() + 3)))
        table = np.zeros(1 << (64 - int(shift)), bool)
        table[known >> shift] = True
        return known, first, n, order, rows[order[first]], table, shift

    def places(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple]]:
        """(size, places, groups of equal rows, what is known of the size), places in order."""
        mixed, hashes, at = _mixed(codes), np.zeros(len(codes) + 1, np.uint64), 0
        for size, own in self.sizes.items():
            if size > len(codes):
                return
            while at < size:
                hashes, at = hashes[:-1] * self.factor + mixed[at:], at + 1
            known, _, _, _, rows, table, shift = own
            found = np.flatnonzero(table[hashes >> shift])
            group = np.minimum(np.searchsorted(known, hashes[found]), len(known) - 1)
            same = known[group] == hashes[found]
            found, group = found[same], group[same]
            same = np.ones(len(found), bool)
            for k in range(size):
                same &= codes[found + k] == rows[group, k]
            yield size, found[same], group[same], own


def _expanded(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and the place in it, for each member of ranges of n from first on."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) + np.repeat(first - (np.cumsum(n) - n), n)


class Pack:
    """Texts side by side, parted by what no string holds."""

    def __init__(self, texts: list[str]):
        self.texts, self.ends = texts, np.cumsum([len(x) + 1 for x in texts])
        self.codes = _codes("\0".join([*texts, ""])).copy()
        self.codes[self.ends - 1] = 0x110000  # no character

    def of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, "right")


def packs(texts: list[str], most: int = 64) -> Iterator[tuple[int, Pack]]:
    """Texts in order, `most` at once or PACK characters, with the number of the first."""
    begin, size = 0, 0
    for i, x in enumerate(texts):
        if i > begin and (size + len(x) > PACK or i - begin == most):
            yield begin, Pack(texts[begin:i])
            begin, size = i, 0
        size += len(x)
    if texts:
        yield begin, Pack(texts[begin:])


class Held:
    """Distinct strings looked for whole: by their first MOST characters, and the rest where those stand."""

    def __init__(self, strings: list[str]):
        self.strings, by = strings, {}
        for i, x in enumerate(strings):
            by.setdefault(min(len(x), MOST), []).append(i)
        self.own = {size: np.array(x) for size, x in by.items()}
        self.finder = Finder({size: _codes("".join(strings[i][:size] for i in x)).reshape(-1, size) for size, x in by.items()})

    def within(self, pack: Pack) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(texts, strings) of the strings that each text holds, each pair once; some strings at a time."""
        for size, places, group, (known, first, n, order, *_) in self.finder.places(pack.codes):
            seen = np.zeros((len(pack.texts), len(known)), bool)
            seen[pack.of(places), group] = True
            text, group = np.nonzero(seen)
            which, item = _expanded(first[group], n[group])
            text, string = text[which], self.own[size][order[item]]
            if size == MOST:
                there = np.fromiter((self.strings[j] in pack.texts[i] for i, j in zip(text.tolist(), string.tolist(), strict=True)), bool, len(text))
                text, string = text[there], string[there]
            yield text, string


class Near:
    """Distinct phrases looked for by their fuzzy score.

    A score of `least` needs a common substring of (least - .65) / .35 of the phrase, as no cover is above 1. So each
    phrase is led to by its substrings of that length (or MOST, or somewhat fewer characters); where they follow one another on both
    sides they make up the longest one in common. Only pairs with one long enough are scored.
    """

    STEPS = (3, 4, 5, 6, 8, 10, 12, MOST)

    def __init__(self, phrases: list[str], least_cover: float, least: float, pairs: int = 1 << 22):
        self.phrases, self.least_cover, self.least, self.pairs = phrases, least_cover, least, pairs
        self.longest = max(map(len, phrases), default=0)
        self.grams = [sorted({p[i : i + 3] for i in range(len(p) - 2)}) for p in phrases]
        self.needed = np.array([max(3, ceil((least - 0.65) / 0.35 * len(p) - 1e-6)) for p in phrases], np.int64)
        self.items, rows = {}, {}
        seed = np.array([max(s for s in self.STEPS if s <= n) for n in self.needed], np.int64)
        for size in np.unique(seed).tolist():
            own = [i for i in np.flatnonzero(seed == size).tolist() if max(5, self.needed[i]) <= len(phrases[i])]
            if not own:
                continue
            n = np.array([len(phrases[i]) for i in own])
            which, at = _expanded(np.cumsum(n) - n, n - size + 1)
            codes = _codes("".join(phrases[i] for i in own))
            rows[size] = codes[at[:, None] + np.arange(size)]
            self.items[size] = np.array(own)[which], at - (np.cumsum(n) - n)[which]
        self.finder = Finder(rows)

    def common(self, pack: Pack) -> Iterator[tuple[int, int, int]]:
        """(text, phrase, length of the longest substring in common) of pairs where it is long enough."""
        for size, places, group, (_, first, n, order, *_) in self.finder.places(pack.codes):
            phrases, offsets = self.items[size]
            text = pack.of(places)
            share = np.cumsum(n[group])
            begin = 0
            while begin < len(places):  # some texts at a time, or one
                stop = int(np.searchsorted(share, (share[begin - 1] if begin else 0) + self.pairs, "right"))
                last = text[min(stop, len(text) - 1)]
                stop = len(places) if stop == len(places) else int(np.searchsorted(text, last)) if last > text[begin] else int(np.searchsorted(text, last, "right"))
                part = slice(begin, stop)
                total = int(share[stop - 1] - (share[begin - 1] if begin else 0))
                if total > 4 * self.pairs:  # one text, of a few characters again and again
                    i = int(text[begin])
                    for p in np.unique(phrases[order[_expanded(first[np.unique(group[part])], n[np.unique(group[part])])[1]]]).tolist():
                        found = common_length(self.phrases[p], pack.texts[i])
                        if found >= self.needed[p]:
                            yield i, p, found
                    begin = stop
                    continue
                begin = stop
                which, item = _expanded(first[group[part]], n[group[part]])
                item, at = order[item], places[part][which]
                phrase = phrases[item]
                line = phrase * (len(pack.codes) + self.longest) + at - offsets[item] + self.longest
                sort = np.argsort(line, kind="stable")
                line, at, phrase = line[sort], at[sort], phrase[sort]
                edge = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (phrase[1:] != phrase[:-1]) | (at[1:] != at[:-1] + 1)]))
                length = np.diff(np.append(edge, len(line))) + size - 1
                phrase, owner = phrase[edge], pack.of(at[edge])
                long = length >= self.needed[phrase]
                pair, length = owner[long] * len(self.phrases) + phrase[long], length[long]
                if len(pair):
                    sort = np.argsort(pair, kind="stable")
                    pair, heads = np.unique(pair[sort], return_index=True)
                    yield from zip((pair // len(self.phrases)).tolist(), (pair % len(self.phrases)).tolist(), np.maximum.reduceat(length[sort], heads).tolist(), strict=True)

    def near(self, pack: Pack) -> Iterator[tuple[int, int, float]]:
        """(text, phrase, score) of scores of at least `least`."""
        pairs = sorted(self.common(pack))
        for i, own in groupby(pairs, lambda x: x[0]):
            own, text = list(own), pack.texts[i]
            held = text if len(own) < 16 else {text[j : j + 3] for j in range(len(text) - 2)}
            for _, p, length in own:
                cover = sum(g in held for g in self.grams[p]) / len(self.grams[p])
                score = 0.65 * cover + 0.35 * length / len(self.phrases[p])
                if cover >= self.least_cover and score >= self.least:
                    yield i, p, score


def common_length(phrase: str, text: str) -> int:
    """Length of the phrase's longest substring that the text holds: where one of some length is, shorter ones are."""
    low, high = 0, len(phrase)
    while low < high:
        mid = (low + high + 1) // 2
        if any(phrase[i : i + mid] in text for i in range(len(phrase) - mid + 1)):
            low = mid
        else:
            high = mid - 1
    return low


def _by_blocks(phrases: DataFrame, docs: DataFrame, make: Callable[[list[str]], Callable], block: int) -> DataFrame:
    """One pass over docs (id, text) for each `block` phrases (phrase_id, phrase, confidence), which go along with the tasks.

    make: gives, for distinct phrases, what yields (text, phrase, score) of a pack of texts.
    """
    rows = [(r["phrase_id"], surface_of(r["phrase"] or ""), r["confidence"]) for r in phrases.select("phrase_id", "phrase", "confidence").distinct().toLocalIterator()]
    rows = sorted(r for r in rows if r[1])
    kind = docs.schema["id"].dataType.simpleString()
    owner = phrases.schema["phrase_id"].dataType.simpleString()

    def over(part: list[tuple[int, str, float]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            owners: dict[str, list[tuple]] = {}
            for phrase_id, phrase, confidence in part:
                owners.setdefault(phrase, []).append((phrase_id, confidence))
            own = list(owners.values())
            work = make(list(owners))
            for batch in batches:
                for at in range(0, len(batch), 256):
                    ids, texts = (batch.column(c).slice(at, 256).to_pylist() for c in ("id", "text"))
                    for first, pack in packs([surface_of(x) if x else "" for x in texts]):
                        found = [(q, ids[first + i], None if confidence is None else s * confidence) for i, p, s in work(pack) for q, confidence in own[p]]
                        columns = zip(*found, strict=True) if found else ((), (), ())
                        yield pa.RecordBatch.from_pydict(dict(zip(("phrase_id", "id", "score"), map(list, columns), strict=True)), schema=pa.schema([("phrase_id", types[0]), ("id", types[1]), ("score", pa.float64())]))

        return spread(docs.select("id", "text")).mapInArrow(run, f"phrase_id {owner}, id {kind}, score double")

    types = [to_arrow_type(phrases.schema["phrase_id"].dataType), to_arrow_type(docs.schema["id"].dataType)]
    return reduce(DataFrame.unionByName, [over(rows[i : i + block]) for i in range(0, max(1, len(rows)), block)])


def phrase_matches(phrases: DataFrame, docs: DataFrame, block: int = 100_000) -> DataFrame:
    """(phrase_id, phrase, confidence) in docs (id, text): (phrase_id, id, kind, score), exact finds only where the phrase is there as it is.

    Phrases are looked up by their first characters, so that a document costs one pass however many there are; more than
    `block` take a pass over the documents each.
    """

    def make(strings: list[str]):
        held = Held(strings)
        return lambda pack: ((i, p, 1.0) for found in held.within(pack) for i, p in zip(*(x.tolist() for x in found), strict=True))

    return _by_blocks(phrases, docs, make, block).select("phrase_id", "id", F.lit("exact").alias("kind"), "score")


def fuzzy_matches(phrases: DataFrame, docs: DataFrame, least_cover: float = 0.55, least: float = 0.78, block: int = 100_000) -> DataFrame:
    """Fuzzy finds (phrase_id, id, score): a document's substrings lead to phrases, of which those that share one long enough are scored."""

    if least_cover <= 0:
        raise ValueError("least_cover must be above 0")

    def make(strings: list[str]):
        return Near(strings, least_cover, least).near

    return _by_blocks(phrases, docs, make, block)


def surface_frequency(words: DataFrame, docs: DataFrame, block: int = 100_000) -> DataFrame:
    """(term, df): how many docs (id, text) hold each distinct word of `words` (term) as a substring. Found words are counted in each task first."""
    rows = sorted(r["term"] for r in words.select("term").distinct().where("term <> ''").toLocalIterator())

    def over(part: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, counts = Held(part), np.zeros(len(part), np.int64)
            for batch in batches:
                for at in range(0, len(batch), 256):
                    for _, pack in packs([x.lower() for x in batch.column("text").slice(at, 256).to_pylist() if x]):
                        for _, found in held.within(pack):
                            counts += np.bincount(found, minlength=len(part))
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([part[i] for i in some.tolist()], pa.string()), pa.array(counts[some])], names=["term", "n"])

        return spread(docs.select("text")).mapInArrow(run, "term string, n bigint")

    found = reduce(DataFrame.unionByName, [over(rows[i : i + block]) for i in range(0, max(1, len(rows)), block)])
    return found.groupBy("term").agg(F.sum("n").alias("df"))


def best_clue(matches: DataFrame, group: str = "query_id") -> DataFrame:
    """Each document's best phrase (kind, then score, then first), with how many documents each phrase matched."""
    order = F.when(F.col("kind") == "exact", 0).when(F.col("kind") == "phonetic", 1).otherwise(2)
    counted = matches.withColumn("phrase_count", F.count("*").over(Window.partitionBy(group, "phrase_id")))
    w = Window.partitionBy(group, "id").orderBy(order, F.desc("score"), "phrase_id")
    return counted.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def mentions(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Sentences of docs (id, text) that hold a name (name_id, name) as whole words: names of n words meet sentences by equal n-word runs."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    n = names.select("name_id", F.array_join(words(F.col("name")), " ").alias("run"), F.size(words(F.col("name"))).alias("n")).where("n > 0")
    sizes = n.agg(F.array_sort(F.collect_set("n")).alias("ns"))
    s = docs.select("id", F.explode(F.split("text", r"[.!?\n]+")).alias("sentence")).select("id", F.trim("sentence").alias("sentence")).where("sentence <> ''").distinct()
    runs = s.crossJoin(F.broadcast(sizes)).withColumn("w", words(F.col("sentence"))).select("id", "sentence", "w", F.explode("ns").alias("n")).where(F.size("w") >= F.col("n"))
    runs = runs.select("id", "sentence", "n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " ")))).alias("run"))
    return runs.join(n, ["run", "n"]).select("name_id", "id", "sentence")
