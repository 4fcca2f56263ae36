"""Fuzzy line dedup: SimHash, blocks of equal keys, edit similarity, one occurrence of each connected group.

Lines are what \\n parts. A normalised line is lower-cased, its white space collapsed. Lines of fewer than `min_chars`
normalised characters are structure: they always stay and link with nothing. Equal normalised lines are one class.
Classes link if their edit similarity, 1 - distance / longer length, reaches `similarity` and, where `hamming` is given,
their 64-bit SimHashes over distinct words differ in at most `hamming` bits. In that case the SimHash is cut into
hamming + 2 blocks, of which links share two, and nothing that meets both is missed. With `hamming` None, edit similarity
alone counts; candidates are those that share a MinHash band, are of lengths that permit the similarity and whose
SimHashes differ in at most WIDE bits (NARROW, if one of them is long), which finds most links, not all.

Candidates of a key are all near pairs. Up to PAIRED members give them as pairs. Of keys that more share, a first pass
compares the first PAIRED members in the order of their SimHashes, and any further one with the CHAIN before it. What
that leaves apart is then compared to the end: members of such keys that aren't connected yet meet in tiles of two
chunks, with their lines, a pair in the least of its keys alone, and a tile gives links and no pairs. Its rows grow with a
key's members, and beyond TILE of them with their square over TILE. Pairs of the first pass are verified star by star,
nearest first, where they aren't connected yet. Of each connected group the occurrence of the smallest (id, line number)
stays.

Null texts stay null; empty texts stay empty. Rows that share an id keep the lines of that id's first occurrences
each. Repeated rows lose what an earlier id holds. Rows without an id keep all their lines, which count for nothing.
Ties can't happen: (id, line number) orders occurrences. An empty table gives an empty result. All other columns are
kept as they are, but for columns named as those that are added (`counts`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftsonde.llm.arrays import byte_words, durable, map_batches, mix64, text_chunks
from driftsonde.llm.graphs import Forest, connected_components, map_groups, tiles

#: Rows (16 bytes each) up to which positions of lines are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Members of one key up to which all pairs are compared at once, and predecessors that any further one is compared with first.
PAIRED, CHAIN = 32, 2
#: A line's key as it travels packed; lines for each bucket of keys, and keys of one bucket that are held at once.
ROW = np.dtype([("block_key", "<i8"), ("node", "<i8"), ("sim", "<i8"), ("n", "<i4")])
BUCKET_LINES, MOST_KEYS = 32_768, 4_000_000
CANDIDATES = "a bigint, b bigint, differ int, block_key bigint, sim bigint, n int"
#: Members in a chunk of a larger key, rows or candidates of tiles and stars held at once, members of a tile that are compared with the others at once.
TILE, HELD, STRIP = 1024, 65_536, 64
#: Pairs of like length from which edit distances are computed together, pairs at a time, bytes of their tables; lengths are alike up to one part in so many.
TOGETHER, SLICE, TABLE, LIKE = 12, 16_384, 1 << 25, 4
#: Lengths of character runs whose counts bound distances, and bits of their hashes.
RUNS = ((1, 6), (2, 9))
#: Features by a line's bytes: runs of five bytes up to SHORT and up to LONG, word pairs from three quarters of LONG on.
SHORT, LONG = 48, 128
#: MinHashes a key and keys a line: for the shortest lines, for short ones, for word pairs.
BANDS = ((2, 16), (3, 16), (2, 10))
#: Bits in which the SimHashes of candidates may differ: lines of up to LONG bytes, and longer ones.
WIDE, NARROW = 24, 20
_MULTIPLIERS = np.random.default_rng(20240808).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: For each byte, its bits as the eight bytes of one number: sums of up to 255 of them count eight bits at once.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).ravel()

_NO_MARKS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def normalise(line: str) -> str:
    return " ".join(line.lower().split())


def simhashes(words: np.ndarray, counts: np.ndarray, own: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each run of word hashes over the distinct ones (told apart by 40 bits). A run without any has its own hash."""
    line = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    keys = np.sort(line << np.uint64(40) | words >> np.uint64(24))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    keys = keys[new]
    number = np.bincount((keys >> np.uint64(40)).astype(np.int64), minlength=len(counts))
    out, full = own.copy(), np.flatnonzero(number)
    if not len(full):
        return out
    bits = mix64(keys & np.uint64((1 << 40) - 1))
    runs = -(-number[full] // 255)
    first = np.cumsum(runs) - runs
    at = np.repeat((np.cumsum(number) - number)[full], runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(first, runs))
    votes = np.empty((len(full), 8, 8), np.int32)
    for plane in range(8):
        sums = np.add.reduceat(_LANES[(bits >> np.uint64(8 * plane)) & np.uint64(255)], at).view(np.uint8).reshape(-1, 8)
        votes[:, plane] = np.add.reduceat(sums, first, axis=0, dtype=np.int32)
    out[full] = np.packbits(2 * votes.reshape(len(full), 64) > number[full, None], axis=1).copy().view(np.uint64).ravel()
    return out


def line_sketches(lines: list[bytes], own: np.ndarray, banded: bool) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """SimHash of each line, ASCII marks left out, and, if `banded`, keys of its MinHash bands.

    Lines of edit similarity 0.8 are of lengths within 0.8 of each other, so that the overlaps of the kinds of features
    give both of any two the same kind of key.
    """
    plain = [x.translate(_NO_MARKS) for x in lines]
    words, counts = byte_words(plain, lower=False)
    sims, keys = simhashes(words, counts, own), [[] for _ in lines]
    if not banded:
        return sims, [None] * len(lines)
    sizes = np.array([len(x) for x in lines], np.int64)
    kinds = (np.flatnonzero(sizes <= SHORT), np.flatnonzero((sizes > SHORT * 3 // 4) & (sizes <= LONG)))
    for kind, at in enumerate(kinds):
        if len(at):
            _add_keys(keys, at, *_byte_runs([plain[i] for i in at], [lines[i] for i in at]), kind)
    _add_keys(keys, np.arange(len(lines)), *_word_pairs(words, counts, sizes > LONG * 3 // 4), 2)
    return sims, [np.concatenate(k).view(np.int64) if k else own[i : i + 1].view(np.int64) for i, k in enumerate(keys)]


def _add_keys(keys: list[list[np.ndarray]], at: np.ndarray, features: np.ndarray, counts: np.ndarray, kind: int) -> None:
    """Keys of one kind for those lines that have such features. The least of multiples stands for the least of hashes."""
    full = np.flatnonzero(counts)
    if not len(full):
        return
    starts = (np.cumsum(counts) - counts)[full]
    rows, bands = BANDS[kind]
    columns = []
    with np.errstate(over="ignore"):
        for band in range(bands):
            key = np.full(len(full), band * 3 + kind + 1, np.uint64)
            for row in range(rows):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(features * _MULTIPLIERS[band * rows + row], starts))
            columns.append(key)
    for i, own in zip(at[full].tolist(), np.stack(columns, 1), strict=True):
        keys[i].append(own)


def _word_pairs(words: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of neighbouring words of the wanted lines, and their numbers; a single word is paired with nothing."""
    last = np.zeros(len(words), bool)
    last[np.cumsum(counts)[counts > 0] - 1] = True
    after = np.append(words[1:], np.uint64(0))
    after[last] = 0
    line = np.repeat(np.arange(len(counts)), counts)
    kept = (~last | (counts[line] == 1)) & wanted[line]
    with np.errstate(over="ignore"):
        return mix64(words * np.uint64(3) + after)[kept], np.bincount(line[kept], minlength=len(counts))


def _byte_runs(plain: list[bytes], lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of five bytes without white space, and their numbers; lines of marks keep them."""
    packed = [b"".join(x.split()) for x in plain]
    packed = [x if len(x) >= 8 else b"".join(y.split()) for x, y in zip(packed, lines, strict=True)]
    packed = [x.ljust(5) for x in packed]
    codes = np.frombuffer(b"".join(packed), np.uint8).astype(np.uint64)
    sizes = np.array([len(x) for x in packed], np.int64)
    runs = sum(codes[i : len(codes) - 4 + i] << np.uint64(8 * i) for i in range(5))
    left = np.repeat(np.cumsum(sizes), sizes)[: len(runs)] - np.arange(len(runs))
    return mix64(runs)[left >= 5], sizes - 4


def edit_distance(a: str, b: str, limit: int | None = None) -> int:
    """Levenshtein distance: common ends are cut off, the rest goes bit-parallel over whole columns. Beyond `limit`, some number beyond it."""
    k = _common(a, 0, b, 0)
    a, b = a[k:], b[k:]
    k = _common(a[::-1], 0, b[::-1], 0)
    if k:
        a, b = a[:-k], b[:-k]
    if len(a) > len(b):
        a, b = b, a
    m, left = len(a), len(b)
    if not m:
        return left
    most = m + left if limit is None else limit
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score = full, 0, m
    ahead = left - m
    for j, c in enumerate(b, 1):
        eq = where.get(c, 0)
        xv = eq | mv
        xh = ((eq & pv) + pv ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if not j & 31 and j > ahead:
            below = (1 << j - ahead) - 1
            on_way = j + (pv & below).bit_count() - (mv & below).bit_count()
            if on_way > most:  # edits never become fewer along the diagonal to the end
                return on_way
    return score


def _common(a: str, i: int, b: str, j: int) -> int:
    """Length of the common prefix of a[i:] and b[j:], by doubling and halving."""
    most = min(len(a) - i, len(b) - j)
    low, step = 0, 16
    while low < most and a[i + low : i + min(low + step, most)] == b[j + low : j + min(low + step, most)]:
        low, step = min(low + step, most), step * 2
    high = min(low + step, most)
    while low < high:
        mid = (low + high + 1) // 2
        if a[i + low : i + mid] == b[j + low : j + mid]:
            low = mid
        else:
            high = mid - 1
    return low


#: Characters that must agree for texts to be in step again, and how far that is looked for.
ANCHOR, AHEAD = 8, 64


def within(a: str, b: str, limit: int) -> bool:
    """Whether a plain walk along both texts, in step again at the next common run, needs no more than `limit` edits. If so, the distance is no more."""
    i = j = cost = 0
    while True:
        k = _common(a, i, b, j)
        i, j = i + k, j + k
        if i == len(a) or j == len(b):
            return cost + (len(a) - i) + (len(b) - j) <= limit
        for step in range(min(AHEAD, limit - cost + 1)):
            anchor = a[i + step : i + step + ANCHOR]
            if len(anchor) < ANCHOR:
                return cost + max(len(a) - i, len(b) - j) <= limit
            at = b.find(anchor, j, j + limit - cost + ANCHOR)
            if at >= 0:
                break
        else:
            return False
        cost += max(step, at - j)
        if cost > limit:
            return False
        i, j = i + step, at


def _limit(longer: int, similarity: float) -> int:
    """The most edits that leave lines similar."""
    limit = int(longer - similarity * longer)
    return limit + (longer - (limit + 1) >= similarity * longer)  # as the comparison of similarities rounds


def near_walk(a: str, b: str, similarity: float) -> bool:
    """Whether a plain walk from either end shows the lines to be similar."""
    longer = max(len(a), len(b))
    limit = _limit(longer, similarity)
    return min(len(a), len(b)) >= similarity * longer and (within(a, b, limit) or within(a[::-1], b[::-1], limit))


def similar(a: str, b: str, similarity: float) -> bool:
    longer = max(len(a), len(b))
    if min(len(a), len(b)) < similarity * longer:
        return False
    return near_walk(a, b, similarity) or longer - edit_distance(a, b, _limit(longer, similarity)) >= similarity * longer


def _banded(codes: np.ndarray, starts: np.ndarray, size: np.ndarray, letters: int, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether pairs, a the shorter line of each, are at most that many edits apart: Myers' columns for all pairs and all words of 64 characters at once.

    Lines get as many equal marks in front as make all of a equally long. A word is a column behind the word below it, so
    that it finds what that hands up. Words take part while paths of few enough edits can cross them, and a pair ends once
    the diagonal to its end holds more edits than it may have, as they never become fewer along it.
    """
    rows = int(size[a].max())
    words = -(-rows // 64)
    pad = rows - size[a]
    order = np.argsort(-(size[b] + pad), kind="stable")
    a, b, pad, most = a[order], b[order], pad[order], most[order].astype(np.int64)
    end = size[b] + pad
    off = end - rows
    spare = np.maximum(1, (most - off) // 2)
    wide, past = int(spare.max()), int((off + spare).max())
    patterns, row = np.unique(a, return_inverse=True)
    many, lead = size[patterns], rows - size[patterns]
    owner = np.repeat(np.arange(len(patterns)), many)
    inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    table = np.zeros((words, len(patterns), letters + 1), np.uint64)
    place = inner + lead[owner]
    np.bitwise_or.at(table, (place >> 6, owner, codes[starts[patterns][owner] + inner]), np.uint64(1) << (place & 63).astype(np.uint64))
    for w in range(words):
        ones = np.clip(lead - 64 * w, 0, 64)
        table[w, :, letters] = np.where(ones == 64, ~np.uint64(0), (np.uint64(1) << (ones & 63).astype(np.uint64)) - np.uint64(1))
    table = table.ravel()
    at = np.empty((64 * words + past + 1, len(a)), np.int64)
    at[:] = row * (letters + 1)
    number = np.arange(1, len(at))[:, None]
    inside = (number > pad) & (number <= end)
    at[1:] += np.where(inside, codes[np.where(inside, starts[b] - pad + number - 1, 0)], letters)
    number = np.arange(words)
    begin = np.maximum(64 * number + 1 - wide, 1)
    first, final = begin + number, 64 * number + 64 + past + number
    base = (number * (len(patterns) * (letters + 1)))[:, None]
    top, height = np.full((words, 1), 63, np.uint64), np.full(words, 64)
    height[-1] = rows - 64 * (words - 1)
    top[-1] = height[-1] - 1
    middle = int(np.median(off))
    looks = {64 * (w + 1) + middle + w: w for w in range(words - 1)}
    one, k = np.uint64(1), len(a)
    pv, mv = np.full((words, k), ~np.uint64(0)), np.zeros((words, k), np.uint64)
    up, down = np.ones((words + 1, k), np.uint64), np.zeros((words + 1, k), np.uint64)
    score = np.repeat(np.cumsum(height)[:, None], k, 1)
    out, alive = np.zeros(k, bool), np.arange(k)
    low = high = 0
    for t in range(1, int(end[0]) + words):
        while high < words and first[high] <= t:
            if begin[high] > 1:
                score[high] = score[high - 1] + height[high] - up[high].view(np.int64) + down[high].view(np.int64)
            high += 1
        while final[low] < t:
            low += 1
        if low and final[low - 1] < t - 1:
            up[low], down[low] = 1, 0
        p, m, plus, minus = pv[low:high, :k], mv[low:high, :k], up[low:high, :k], down[low:high, :k]
        eq = table.take(at[t - high + 1 : t - low + 1, :k][::-1] + base[low:high])
        xv = eq | m
        eq |= minus
        xh = eq & p
        xh += p
        xh ^= p
        xh |= eq
        ph = xh | p
        np.invert(ph, out=ph)
        ph |= m
        mh = p & xh
        more, less = ph >> top[low:high] & one, mh >> top[low:high] & one
        score[low:high, :k] += (more - less).view(np.int64)
        ph <<= one
        ph |= plus
        mh <<= one
        mh |= minus
        np.bitwise_and(ph, xv, out=m)
        ph |= xv
        np.invert(ph, out=ph)
        np.bitwise_or(mh, ph, out=p)
        up[low + 1 : high + 1, :k], down[low + 1 : high + 1, :k] = more, less
        if end[k - 1] == t - words + 1:
            left = int(np.searchsorted(-end[:k], -end[k - 1]))
            out[alive[left:k]] = score[-1, left:k] <= most[left:k]
            k = left
            if not k:
                break
        if t in looks:
            stay = np.flatnonzero(score[looks[t], :k] - np.abs(middle - off[:k]) <= most[:k])
            if not len(stay):
                break
            if len(stay) <= 0.8 * k:
                pv, mv, up, down, score, at = (x[:, stay] for x in (pv, mv, up, down, score, at))
                alive, end, off, most, k = alive[stay], end[stay], off[stay], most[stay], len(stay)
    back = np.empty(len(out), bool)
    back[order] = out
    return back


def _counts(codes: np.ndarray, size: np.ndarray, q: int, bits: int) -> np.ndarray:
    """How often each line has runs of q characters, by hash."""
    owner = np.repeat(np.arange(len(size)), size)
    with np.errstate(over="ignore"):
        runs = sum(codes[i : len(codes) - q + 1 + i].astype(np.uint64) * _MULTIPLIERS[i] for i in range(q)) * np.uint64(0x9E3779B97F4A7C15)
    whole = owner[: len(runs)] == owner[q - 1 :]
    at = owner[: len(runs)][whole] << bits | (runs[whole] >> np.uint64(64 - bits)).astype(np.int64)
    return np.bincount(at, minlength=len(size) << bits).reshape(len(size), 1 << bits).astype(np.uint16 if size.max() < 1 << 16 else np.int32)


def _apart(codes: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether lines share so few runs of characters that they can't be similar, as an edit changes at most q runs of q."""
    out, longer = np.zeros(len(a), bool), size[b]
    most = np.floor(longer - similarity * longer).astype(np.int64) + 1
    for q, bits in RUNS:
        if len(codes) < q:
            continue
        counts = _counts(codes, size, q, bits)
        for i in range(0, len(a), SLICE):
            both = np.minimum(counts[a[i : i + SLICE]], counts[b[i : i + SLICE]]).sum(1, dtype=np.int64)
            out[i : i + SLICE] |= both < longer[i : i + SLICE] - q + 1 - q * most[i : i + SLICE]
    return out


def similar_pairs(lines: list[str], a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether each pair of lines, given by their places, is similar; what makes too few pairs or too large a table goes one by one."""
    out = np.zeros(len(a), bool)
    used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    own = [lines[i] for i in used.tolist()]
    size = np.array([len(x) for x in own], np.int64)
    alphabet, codes = np.unique(np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    starts = np.cumsum(size) - size
    a, b = at[: len(a)], at[len(a) :]
    swap = size[a] > size[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    longer = size[b]
    fit = size[a] >= similarity * longer
    if len(a) >= TOGETHER:
        fit &= ~_apart(codes, size, a, b, similarity)
    most = np.floor(longer - similarity * longer).astype(np.int64)
    most += longer - (most + 1) >= similarity * longer
    most -= longer - most < similarity * longer
    left = np.flatnonzero(fit)
    left = left[np.argsort(-size[a[left]], kind="stable")]
    lengths = size[a[left]]
    i = 0
    while i < len(left):
        rows = int(lengths[i])
        part = left[i : int(np.searchsorted(-lengths, -(rows - rows // LIKE), side="right"))]
        part = part[: max(1, min(SLICE, TABLE // (8 * (2 * rows + len(alphabet) * (rows // 64 + 1)))))]
        if len(part) < TOGETHER or not size[a[part[-1]]]:
            pairs = [(own[x], own[y]) for x, y in zip(a[part].tolist(), b[part].tolist(), strict=True)]
            out[part] = [edit_distance(x, y, m) <= m for (x, y), m in zip(pairs, most[part].tolist(), strict=True)]
        else:
            out[part] = _banded(codes, starts, size, len(alphabet), a[part], b[part], most[part])
        i += len(part)
    return out


def line_table(docs: DataFrame, id_column: str, text_column: str, min_chars: int, banded: bool = False) -> DataFrame:
    """Every line of enough characters: key, pos, two hashes of it normalised, its length; its SimHash and, if `banded`, its keys, null for lines seen before."""

    def make():
        once: set[int] = set()  # lines whose sketches this task gave already; bounded, a miss only repeats them

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for part, texts in text_chunks(batch):
                row, pos, lines, sizes = [], [], [], []
                for i, text in enumerate(texts):
                    for j, line in enumerate(text.split("\n")):
                        if len(line) >= min_chars and len(plain := normalise(line)) >= min_chars:
                            row.append(i)
                            pos.append(j)
                            lines.append(plain.encode())
                            sizes.append(len(plain))
                h1, h2 = (np.ascontiguousarray(h) for h in _digests(lines).T)
                keys = batch.column("key").slice(part.start, part.stop - part.start).take(pa.array(row, pa.int64()))
                new = []
                for i, h in enumerate(h1.tolist()):
                    if h not in once:
                        once.add(h)
                        new.append(i)
                if len(once) > 500_000:
                    once.clear()
                sims, bands = line_sketches([lines[i] for i in new], h1[new], banded)
                sim = np.zeros(len(lines), np.int64)
                sim[new] = sims.view(np.int64)
                known = np.ones(len(lines), bool)
                known[new] = False
                out = {"key": keys, "pos": pos, "h1": h1.view(np.int64), "h2": h2.view(np.int64), "n": sizes, "sim": pa.array(sim, mask=known)}
                if banded:
                    every: list[np.ndarray | None] = [None] * len(lines)
                    for i, k in zip(new, bands, strict=True):
                        every[i] = k
                    out["bands"] = pa.array(every, pa.list_(pa.int64()))
                yield out

        return work

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("key"), docs[text_column].cast("string").alias("text"))
    return map_batches(rows, make, f"key {kind}, pos int, h1 bigint, h2 bigint, n int, sim bigint" + ", bands array<bigint>" * banded)


def _digests(lines: list[bytes]) -> np.ndarray:
    """Two 64-bit halves of a digest of each line."""
    joined = b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in lines)
    return np.frombuffer(joined, np.uint64).reshape(-1, 2)


def block_keys(sim: Column, hamming: int) -> Column:
    """A key for every two of the SimHash's hamming + 2 blocks."""
    cuts = np.linspace(0, 64, hamming + 3).round().astype(int)
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    both = [x | y for x, y in combinations(masks, 2)]
    signed = [x - 2**64 if x >= 2**63 else x for x in both]
    return F.explode(F.array(*(F.xxhash64(sim.bitwiseAND(F.lit(m)), F.lit(i)) for i, m in enumerate(signed))))


def _packed(buckets: int):
    """Rows (bucket, rows): the keys of lines (bands, h1, sim, n) by ranges of the key, as bytes of ROW."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            bands = batch.column("bands")
            keys, sizes = bands.flatten().to_numpy(), pc.list_value_length(bands).to_numpy()
            rows = np.empty(len(keys), ROW)
            rows["block_key"] = keys
            for name, column in (("node", "h1"), ("sim", "sim"), ("n", "n")):
                rows[name] = np.repeat(batch.column(column).to_numpy(), sizes)
            bucket = (keys.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            order = np.argsort(bucket.astype(np.uint16), kind="stable")
            number = np.bincount(bucket.astype(np.int64), minlength=buckets)
            full = np.flatnonzero(number)
            ends = (np.append(0, np.cumsum(number[full])) * ROW.itemsize).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer(ends), pa.py_buffer(rows[order])])
            yield {"bucket": full, "rows": packed}

        return work

    return make


def _lengths(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether lines of these lengths can be similar."""
    return np.minimum(a, b) >= similarity * np.maximum(a, b)


def _near(sim: np.ndarray, size: np.ndarray, other: np.ndarray, its: np.ndarray, bits: tuple[int, int], similarity: float) -> np.ndarray:
    """Whether SimHashes differ in few enough bits, by the longer line, and lengths permit the similarity."""
    differ = np.bitwise_count(sim ^ other)
    return (differ <= np.where(np.maximum(size, its) <= LONG, *bits)) & _lengths(size, its, similarity)


def _candidates(bits: tuple[int, int], similarity: float):
    """From rows sorted by key, SimHash and class: near pairs (a, b, differ), and members of large groups (block_key, a, sim, n). Only a bounded tail of rows is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, sim, size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        passed = 0  # rows of the tail's first group that are gone
        for batch in batches:
            old = len(key)
            added = [batch.column(c).to_numpy() for c in ("block_key", "node", "sim", "n")]
            key, node = np.append(key, added[0]), np.append(node, added[1])
            sim, size = np.append(sim, added[2].view(np.uint64)), np.append(size, added[3])
            fresh = np.ones(len(key), bool)  # a class may have been sketched by several tasks
            fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node, sim, size = key[fresh], node[fresh], sim[fresh], size[fresh]
            n = len(key)
            if not n:
                continue
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(starts, n))
            index = np.arange(n) - np.repeat(starts, sizes)
            if passed:
                index[: sizes[0]] += passed
            late = np.arange(n) >= old
            a, b, differ = [], [], []
            for s in range(1, PAIRED):
                at = s + np.flatnonzero((key[s:] == key[:-s]) & late[s:] & ((index[s:] < PAIRED) | (s <= CHAIN)))
                if not len(at):
                    break
                at = at[_near(sim[at], size[at], sim[at - s], size[at - s], bits, similarity)]
                a.append(np.minimum(node[at], node[at - s]))
                b.append(np.maximum(node[at], node[at - s]))
                differ.append(np.bitwise_count(sim[at] ^ sim[at - s]))
            turn = np.flatnonzero(late & (index == PAIRED))
            large = np.unique(np.concatenate([np.flatnonzero(late & (index >= PAIRED)), (turn[:, None] - np.arange(1, PAIRED + 1)).ravel()]))
            pairs, members = sum(map(len, a)), len(large)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(np.concatenate(a) if a else [], pa.int64()), pa.array(node[large])]),
                    pa.concat_arrays([pa.array(np.concatenate(b) if b else [], pa.int64()), pa.nulls(members, pa.int64())]),
                    pa.concat_arrays([pa.array(np.concatenate(differ).astype(np.int32) if a else [], pa.int32()), pa.nulls(members, pa.int32())]),
                    pa.concat_arrays([pa.nulls(pairs, pa.int64()), pa.array(key[large])]),
                    pa.concat_arrays([pa.nulls(pairs, pa.int64()), pa.array(sim[large].view(np.int64))]),
                    pa.concat_arrays([pa.nulls(pairs, pa.int32()), pa.array(size[large], pa.int32())]),
                ],
                names=["a", "b", "differ", "block_key", "sim", "n"],
            )
            cut = max(0, n - PAIRED - 1, int(starts[-1]))
            passed = int(index[cut])
            key, node, sim, size = key[cut:], node[cut:], sim[cut:], size[cut:]

    return run


def _compared(keyed: DataFrame, bits: tuple[int, int], similarity: float) -> DataFrame:
    dealt = keyed.repartition("block_key").sortWithinPartitions("block_key", "sim", "node")
    return dealt.mapInArrow(_candidates(bits, similarity), CANDIDATES)


def _candidates_packed(bits: tuple[int, int], similarity: float):
    """The same from packed rows sorted by bucket. Of a bucket with more than MOST_KEYS, which can't be held, the rows are given back, with -1 bits that differ."""
    compare = _candidates(bits, similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now, total, over = None, 0, False

        def given() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            rows = np.concatenate(held)
            held.clear()
            key, node, sim, n = (rows[name].copy() for name in ROW.names)
            if over:
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(rows), pa.int64()), pa.array(np.full(len(rows), -1, np.int32)), pa.array(key), pa.array(sim), pa.array(n)], names=["a", "b", "differ", "block_key", "sim", "n"])
                return
            order = np.argsort(key)
            same = np.append(np.diff(key[order]) == 0, False)
            same[1:] |= same[:-1].copy()
            again = order[same]
            again = again[np.lexsort((node[again], sim[again], key[again]))]
            yield from compare(iter([pa.RecordBatch.from_arrays([pa.array(x[again]) for x in (key, node, sim, n)], names=list(ROW.names))]))

        for batch in batches:
            packed = batch.column("rows")
            ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != now:
                    yield from given()
                    now, total, over = bucket, 0, False
                held.append(np.frombuffer(packed.buffers()[2], np.uint8)[ends[i] : ends[i + 1]].copy().view(ROW))
                total += len(held[-1])
                if total > MOST_KEYS:
                    over, total = True, 0
                    yield from given()
        yield from given()

    return run


def _banded_candidates(lines: DataFrame, bits: tuple[int, int], similarity: float) -> DataFrame:
    """Candidates from the keys of banded lines, which travel packed: a task sorts its buckets itself, without the keys that no other row has."""
    buckets = min(max(64, lines.count() // BUCKET_LINES), 1 << 16)
    packed = map_batches(lines.where("sim is not null").select("bands", "h1", "sim", "n"), _packed(buckets), "bucket int, rows binary")
    found = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_candidates_packed(bits, similarity), CANDIDATES)
    found = durable(found, "candidates")
    too_many = found.where("differ = -1").select("block_key", F.col("a").alias("node"), "sim", "n")
    return found.where("differ is null or differ >= 0").unionByName(durable(_compared(too_many, bits, similarity), "candidates"))


def _links(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b, differ), links that connect what all links would within a star: pairs around one class meet in one group, with their lines (node, line)."""
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    star = ends.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("star"))
    of = lambda end: star.select(F.col("node").alias(end), F.col("star").alias(f"star_{end}"))
    dealt = pairs.join(of("a"), "a").join(of("b"), "b").select(F.least("star_a", "star_b").alias("star"), "a", "b", "differ")
    dealt = durable(dealt, "stars")
    needed = dealt.select("star", F.col("a").alias("node")).union(dealt.select("star", "b")).distinct()
    lines = needed.join(texts, "node").select("star", F.lit(-1).alias("differ"), F.col("node").alias("a"), F.lit(None).cast("bigint").alias("b"), "line")
    rows = lines.unionByName(dealt.select("star", "differ", "a", "b", F.lit(None).cast("string").alias("line")))

    def work(groups: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, lines, nodes, open_pairs = [], [], [], [], []
        for g in groups:
            first, second, said = g.column("a").to_pylist(), g.column("b").to_pylist(), g.column("line").to_pylist()
            text = {x: t for x, y, t in zip(first, second, said, strict=True) if y is None}
            place = {x: i for i, x in enumerate(text)}
            forest, left = Forest(len(place)), []
            for x, y in zip(first, second, strict=True):
                if y is not None and x in place and y in place and forest.find(place[x]) != forest.find(place[y]):
                    if near_walk(text[x], text[y], similarity):
                        forest.union(place[x], place[y])
                        a.append(x)
                        b.append(y)
                    else:
                        left.append((len(lines) + place[x], len(lines) + place[y]))
            open_pairs += [(x, y) for x, y in left if forest.find(x - len(lines)) != forest.find(y - len(lines))]
            lines += text.values()
            nodes += place
        if open_pairs:
            x, y = np.array(open_pairs, np.int64).T
            good = similar_pairs(lines, x, y, similarity)
            a += [nodes[i] for i in x[good].tolist()]
            b += [nodes[i] for i in y[good].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return map_groups(rows, ["star"], work, "a bigint, b bigint", within=["differ"], ranged=False, least=HELD)


def _rest(large: DataFrame, linked: DataFrame, texts: DataFrame, bits: tuple[int, int], similarity: float) -> DataFrame:
    """Links (a, b) between components, or classes of none, that connect what all near pairs within large keys would: `large` (block_key, node, sim, n), `linked` (node, component)."""
    members = large.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parted = members.groupBy("block_key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("block_key")
    members = durable(members.join(parted, "block_key"), "members")
    keys = members.groupBy("node").agg(F.collect_list("block_key").alias("keys"))
    dealt = tiles(members, block="block_key", most=TILE).join(keys, "node").join(texts, "node")

    def work(groups: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = np.array(list(_tile_links(groups, bits, similarity)), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    return map_groups(dealt, ["block_key", "tile_i", "tile_j"], work, "a bigint, b bigint", ranged=False, least=HELD)


def _shared(keys: pa.Array, own: int) -> np.ndarray:
    """For each member, the keys below `own` as bits of 64-bit words."""
    values, sizes = keys.flatten().to_numpy(), pc.list_value_length(keys).to_numpy()
    below = values < own
    place, at = np.unique(values[below], return_inverse=True)
    out = np.zeros((len(sizes), max(1, -(-len(place) // 64))), np.uint64)
    np.bitwise_or.at(out, (np.repeat(np.arange(len(sizes)), sizes)[below], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def _tile_links(groups: list[pa.RecordBatch], bits: tuple[int, int], similarity: float) -> Iterator[tuple[int, int]]:
    """Links between components of tiles' members; candidates of several tiles are verified together."""
    rows = pa.Table.from_batches(groups)
    names, of = np.unique(rows.column("component").to_numpy(), return_inverse=True)
    _, first, place = np.unique(rows.column("node").to_numpy(), return_index=True, return_inverse=True)
    lines, of_line, sim_line = rows.column("line").take(pa.array(first)).to_pylist(), of[first], rows.column("sim").to_numpy()[first].view(np.uint64)
    forest = Forest(len(names))
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def roots() -> np.ndarray:
        return np.array([forest.find(i) for i in range(len(names))], np.int64)

    def verified() -> Iterator[tuple[int, int]]:
        x, y = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.argsort(np.bitwise_count(sim_line[x] ^ sim_line[y]), kind="stable")
        x, y = x[order], y[order]
        for i in range(0, len(x), SLICE):
            now = roots()[of_line]
            p, q = x[i : i + SLICE], y[i : i + SLICE]
            apart = now[p] != now[q]
            p, q = p[apart], q[apart]
            if len(p):
                good = similar_pairs(lines, p, q, similarity)
                for u, v in zip(of_line[p[good]].tolist(), of_line[q[good]].tolist(), strict=True):
                    if forest.union(u, v):
                        yield int(names[u]), int(names[v])

    total = at = 0
    whole = roots()
    for tile in groups:
        own, its = place[at : at + len(tile)], of[at : at + len(tile)]
        at += len(tile)
        now = whole[its]
        if (now == now[0]).all():
            continue
        size = tile.column("n").to_numpy()
        order = np.argsort(size, kind="stable")
        own, its, now, size = own[order], its[order], now[order], size[order]
        sim, chunk = tile.column("sim").to_numpy()[order].view(np.uint64), tile.column("chunk").to_numpy()[order]
        alone = tile.column("tile_i")[0].as_py() == tile.column("tile_j")[0].as_py()
        shared = _shared(tile.column("keys"), tile.column("block_key")[0].as_py())[order]
        for i in range(0, len(size), STRIP):
            strip = slice(i, min(i + STRIP, len(size)))
            low = int(np.searchsorted(size >= similarity * size[i], True))  # shorter ones are similar to none of the strip
            j = slice(low, strip.stop)
            fit = _near(sim[strip, None], size[strip, None], sim[None, j], size[None, j], bits, similarity) & (now[strip, None] != now[None, j])
            if not alone:
                fit &= chunk[strip, None] != chunk[None, j]
            x, y = np.nonzero(fit)
            x, y = x + i, y + low
            x, y = x[y < x], y[y < x]
            new = ~(shared[x] & shared[y]).any(1)
            if new.any():
                held.append((own[x[new]], own[y[new]]))
                total += int(new.sum())
            if total >= HELD:
                yield from verified()
                whole, total = roots(), 0
                now = whole[its]
    if held:
        yield from verified()


def _lines_at(docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(node, line) for `wanted` (key, pos, node): normalised lines at positions. Bounded lists of positions are broadcast."""
    small = wanted.count() <= BROADCAST_ROWS
    by_doc = wanted.groupBy("key").agg(F.collect_list(F.struct("pos", "node")).alias("at"))
    texts = docs.select(docs[id_column].alias("key"), docs[text_column].cast("string").alias("text"))

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            nodes, lines = [], []
            for text, at in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist(), strict=True):
                own = (text or "").split("\n")
                for x in at:
                    if x["pos"] < len(own):
                        nodes.append(x["node"])
                        lines.append(normalise(own[x["pos"]]))
            same = _digests([x.encode() for x in lines])[:, 0].view(np.int64) == np.array(nodes, np.int64)  # not another text of the same id
            kept = np.flatnonzero(same).tolist()
            yield {"node": [nodes[i] for i in kept], "line": [lines[i] for i in kept]}

        return work

    found = map_batches(texts.join(F.broadcast(by_doc) if small else by_doc, "key").select("text", "at"), make, "node bigint, line string")
    return found.dropDuplicates(["node"])


def dedup_lines(docs: DataFrame, similarity: float = 0.8, hamming: int | None = 3, min_chars: int = 16, id_column: str = "doc_id", text_column: str = "text", counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """`docs` with every repeated or near-repeated line but the first of its group taken out of `text_column`; `counts` names the numbers of lines and of dropped ones."""
    banded = hamming is None
    bits = (WIDE, NARROW) if banded else (hamming, hamming)
    lines = durable(line_table(docs.where(docs[id_column].isNotNull()), id_column, text_column, min_chars, banded), "lines")
    classes = durable(lines.groupBy("h1", "h2").agg(F.min(F.struct("key", "pos")).alias("first"), F.count("*").alias("copies")).withColumnRenamed("h1", "node"), "classes")
    if banded:
        found = _banded_candidates(lines, bits, similarity)
    else:
        found = durable(_compared(lines.where("sim is not null").select(block_keys(F.col("sim"), hamming).alias("block_key"), F.col("h1").alias("node"), "sim", "n"), bits, similarity), "candidates")
    pairs = durable(found.where("b is not null").groupBy("a", "b").agg(F.min("differ").alias("differ")), "pairs")
    large = found.where("b is null").select("block_key", F.col("a").alias("node"), "sim", "n")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large.select("node")).distinct()
    wanted = durable(classes.join(nodes, "node"), "wanted")
    texts = durable(_lines_at(docs, wanted.select("node", "first.key", "first.pos"), id_column, text_column), "texts")
    linked = durable(connected_components(_links(pairs, texts, similarity)), "linked")
    joined = connected_components(_rest(large, linked, texts, bits, similarity)).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    several = wanted.where("copies = 1").unionByName(classes.where("copies > 1"))  # no others can lose a line
    grouped = several.join(linked, "node", "left").withColumn("linked", F.col("component").isNotNull()).withColumn("component", F.coalesce("component", "node"))
    grouped = grouped.join(joined, "component", "left").where("copies > 1 or linked or whole is not null").withColumn("component", F.coalesce("whole", "component"))
    grouped = durable(grouped.select("node", "h2", "first", "component"), "grouped")
    best = grouped.groupBy("component").agg(F.min("first").alias("stays"))
    stays = grouped.join(best, "component").select(F.col("node").alias("h1"), "h2", "stays")
    dropped = lines.select("key", "pos", "h1", "h2").join(stays.hint("shuffle_hash"), ["h1", "h2"]).where((F.col("key") != F.col("stays.key")) | (F.col("pos") != F.col("stays.pos")))
    by_doc = dropped.groupBy("key").agg(F.collect_set("pos").alias("gone"))
    mark, gone = (next(c for c in (f"{name}{'_' * i}" for i in range(1, 99)) if c.lower() not in {x.lower() for x in docs.columns}) for name in ("key", "gone"))
    out = docs.join(by_doc.withColumnsRenamed({"key": mark, "gone": gone}).hint("shuffle_hash"), docs[id_column] == F.col(mark), "left").drop(mark)
    parts = F.split(F.col(text_column).cast("string"), "\n", -1)
    kept = F.array_join(F.transform(F.filter(F.transform(parts, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(gone, s["i"])), lambda s: s["x"]), "\n")
    return out.withColumns({counts[0]: F.size(parts), counts[1]: F.coalesce(F.size(gone), F.lit(0)), text_column: F.when(F.col(gone).isNull(), F.col(text_column)).otherwise(kept)}).drop(gone)
