"""Pieces of texts with their places: chunks cut at sentence ends, sentences that respect quotes and brackets, names in texts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ENDS = re.compile(r"[.!?。]\s+|\n+")


def cuts(text: str, limit: int) -> list[tuple[int, int]]:
    """(start, end) of pieces of at most `limit` characters: up to the last sentence end, else the last space of the second half, else as it is."""
    ends = [m.end() for m in _ENDS.finditer(text)]
    out, start, k = [], 0, 0
    while start < len(text):
        stop = min(start + limit, len(text))
        if stop < len(text):
            while k < len(ends) and ends[k] <= start:
                k += 1
            last = k
            while last < len(ends) and ends[last] <= stop:
                last += 1
            if last > k:
                stop = ends[last - 1]
            else:
                space = text.rfind(" ", start + limit // 2, stop)
                stop = space + 1 if space > start else stop
        out.append((start, stop))
        start = stop
    return out


def chunk_spans(text: str, size: int) -> list[tuple[int, int]]:
    """(start, end) of chunks made of fragments of a third of `size` each, as many as fit; the last fragment of a chunk begins the next."""
    third = max(1, size // 3)
    parts, step = cuts(text, third), max(1, size // third - 1)
    return [(parts[max(0, at - 1)][0], parts[min(at + step, len(parts)) - 1][1]) for at in range(0, len(parts), step)]


def chunks(docs: DataFrame, id_column: str, text_column: str, size: int, rows: int = 256) -> DataFrame:
    """(id, chunk, start, end, text) of the chunks of each document, made where it is read: neither texts nor pieces are shuffled. Batches hold about `rows` documents or chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, len(whole), rows):
                batch = whole.slice(begin, rows)
                made = ((i, n, a, b, x[a:b]) for i, x in enumerate(batch.column(1).to_pylist()) if x for n, (a, b) in enumerate(chunk_spans(x, size)))
                while part := list(islice(made, rows)):
                    at, n, start, end, text = zip(*part, strict=True)
                    columns = [batch.column(0).take(pa.array(at)), pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(text, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=[id_column, "chunk", "start", "end", "text"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, chunk int, start bigint, end bigint, text string")


_PAIRS = {"(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "《": "》", "“": "”", "‘": "’"}
_CLOSERS = frozenset(_PAIRS.values())


def sentence_list(text: str, limit: int = 400) -> list[str]:
    """Sentences: an end mark counts only outside quotes and brackets; those longer than `limit` are left out."""
    out, begin, open_marks, quoted = [], 0, [], False
    for i, c in enumerate(text):
        if c == '"':
            quoted = not quoted
        elif c in _PAIRS:
            open_marks.append(_PAIRS[c])
        elif c in _CLOSERS and c in open_marks:
            while open_marks.pop() != c:
                pass
        ends = c == "\n" or c in ".!?。" and not open_marks and not quoted and (i + 1 == len(text) or text[i + 1].isspace())
        if ends:
            out.append(text[begin : i + 1].strip())
            begin = i + 1
            if c == "\n":
                open_marks, quoted = [], False
    out.append(text[begin:].strip())
    return [x for x in out if x and len(x) <= limit]


def quoted_sentences(text: Column, limit: int = 400) -> Column:
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else sentence_list(x, limit))

    return F.pandas_udf(run, "array<string>")(text)


#: Particles that may follow a name.
PARTICLES = ("에서", "에서는", "에선", "의", "에서의", "에", "으로", "로", "를", "을", "은", "는", "이", "가", "도")


def named_in(name: str, text: str) -> bool:
    """Whether a text names a work: spaces and underscores may differ, particles may follow, letters may not. Names of one character never do."""
    name, text = (unicodedata.normalize("NFKC", x).casefold() for x in (name, text))
    parts = name.replace("_", " ").split()
    key = "".join(parts)
    kept = [i for i, c in enumerate(text) if c != "_" and not c.isspace()]
    plain = "".join(text[i] for i in kept)
    at = plain.find(key) if len(key) > 1 else -1
    while at >= 0:
        begin, stop = kept[at], kept[at + len(key) - 1] + 1
        rest = text[stop:]
        alone = not rest[:1].isalnum() or any(rest.startswith(p) and not rest[len(p) : len(p) + 1].isalnum() for p in PARTICLES)
        spaced = len(key) > 2 or text[begin:stop].replace("_", " ").split() == parts  # short names keep their spacing
        if alone and spaced and not text[max(0, begin - 1) : begin].isalnum():
            return True
        at = plain.find(key, at + 1)
    return False


def media_named(name: Column, text: Column) -> Column:
    def run(names: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if n is None or t is None else named_in(n, t) for n, t in zip(names, texts, strict=True)], dtype="object")

    return F.pandas_udf(run, "boolean")(name, text)
