"""Quality by positive-unlabelled learning.

Features are counts over the whole text: bytes, pairs of byte classes, and how words repeat. Trusted positives are
rows labelled good; all others, whatever they are, are the unlabelled web text. First a plain classifier of positives
against unlabelled rows estimates the class prior: the least ratio of unlabelled to positive rows above any of its
scores. Then a logistic model minimises the non-negative unbiased risk: prior * R_P+ + max(0, R_U- - prior * R_P-).

Labels are learnt only from rows outside the held-out fold, and from at most `sample` positive and `sample` unlabelled
rows, those of the smallest id hashes; of rows that share an id, the least text. The weight decay is the one of DECAYS
of least risk on a quarter of these rows, learnt from the others. Every row is scored on its whole text. Null and empty texts are scored alike.
Repeated rows score alike; ties can't change a row. Extra columns are not read. An empty table gives an empty result;
without any labelled positive all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftsonde.llm.arrays import byte_words, chunks, map_batches, text_chunks

#: Byte classes: lower, upper, digit, space, line end, sentence marks, other marks, beyond ASCII.
_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9]], _CLASS[[10, 13]], _CLASS[128:] = 0, 1, 2, 3, 4, 7
_CLASS[[ord(c) for c in ".,;:'\"?"]] = 5
WIDTH = 256 + 64 + 6
#: Weight decays to choose from.
DECAYS = (0.002, 0.005, 0.02, 0.05)


def features(texts: list[str]) -> np.ndarray:
    """One row of WIDTH numbers for each text."""
    raw = [x.encode() for x in texts]
    n = len(raw)
    sizes = np.array([len(x) for x in raw], np.int64)
    codes = np.frombuffer(b"".join(raw), np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    kinds = _CLASS[codes]
    scale = np.maximum(sizes, 1)[:, None]
    single = np.bincount(owner * 256 + codes, minlength=n * 256).reshape(n, 256) / scale
    inner = owner[1:] == owner[:-1]
    pairs = np.bincount((owner[1:] * 64 + kinds[:-1] * 8 + kinds[1:])[inner], minlength=n * 64).reshape(n, 64) / scale
    words, counts = byte_words(raw)
    own = np.repeat(np.arange(n), counts)
    again = (words[1:] == words[:-1]) & (own[1:] == own[:-1])
    order = np.lexsort((words, own))
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (own[order][1:] != own[order][:-1])
    many = np.maximum(counts, 1)
    repeated = np.bincount(own[1:][again], minlength=n) / many
    distinct = np.bincount(own[order][new], minlength=n) / many
    rest = np.stack([np.log1p(sizes) / 10, np.log1p(counts) / 10, repeated, distinct, sizes / many / 20, counts == 0], 1)
    return np.concatenate([np.sqrt(single), np.sqrt(pairs), rest], 1).astype(np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _adam(grad, width: int, steps: int, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, decay: float = 1e-3) -> float:
    """Share of positives among the unlabelled rows, from matrices of standardised features with a column of ones."""
    p, u = positive[::2], unlabelled[::2]

    def grad(w):
        return -p.T @ (1 - _sigmoid(p @ w)) / len(p) + u.T @ _sigmoid(u @ w) / len(u) + decay * w

    w = _adam(grad, p.shape[1], 150)
    p, u = np.sort(positive[1::2] @ w), np.sort(unlabelled[1::2] @ w)
    cut = np.quantile(p, np.linspace(0.02, 0.6, 59))
    above = lambda x: 1 - np.searchsorted(x, cut) / len(x)
    return float(np.clip(np.min(above(u) / np.maximum(above(p), 1e-9)), 0.05, 0.98))


def nnpu_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, w: np.ndarray) -> float:
    """Non-negative unbiased risk of weights under the sigmoid loss."""
    sp, su = _sigmoid(positive @ w).mean(), _sigmoid(unlabelled @ w).mean()
    return float(prior * (1 - sp) + max(0.0, su - prior * sp))


def choose_decay(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The weight decay of least risk on every fourth row, fitted on the rest; the largest of equals."""
    inner = [x[np.arange(len(x)) % 4 > 0] for x in (positive, unlabelled)]
    outer = [x[::4] for x in (positive, unlabelled)]
    if not all(len(x) for x in inner):
        return DECAYS[-1]
    return min(DECAYS, key=lambda d: (nnpu_risk(*outer, prior, fit_nnpu(*inner, prior, 200, d)), -d))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int, decay: float) -> np.ndarray:
    """Weights of least non-negative unbiased risk under the sigmoid loss; where the negative part's risk falls below 0, its gradient is turned."""

    def grad(w):
        sp, su = _sigmoid(positive @ w), _sigmoid(unlabelled @ w)
        dp, du = sp * (1 - sp), su * (1 - su)
        negative = su.mean() - prior * sp.mean()  # loss of calling z positive: sigmoid(z)
        g_neg = unlabelled.T @ du / len(su) - prior * (positive.T @ dp) / len(sp)
        if negative < 0:
            return -g_neg + decay * w
        return -prior * (positive.T @ dp) / len(sp) + g_neg + decay * w

    return _adam(grad, positive.shape[1], steps)


class Model:
    """Standardisation and weights."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray):
        every = np.concatenate([positive, unlabelled]) if len(positive) else unlabelled
        self.mean = every.mean(0) if len(every) else np.zeros(WIDTH)
        self.scale = every.std(0) + 1e-3 if len(every) else np.ones(WIDTH)
        self.prior, self.decay, self.weights = 0.5, DECAYS[-1], np.zeros(WIDTH + 1)
        if len(positive) > 1 and len(unlabelled) > 1:
            p, u = self.shaped(positive), self.shaped(unlabelled)
            self.prior = estimate_prior(p, u)
            self.decay = choose_decay(p, u, self.prior)
            self.weights = fit_nnpu(p, u, self.prior, 500, self.decay)

    def shaped(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, np.ones((len(z), 1))], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.shaped(x) @ self.weights)


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def _matrix(rows: DataFrame) -> np.ndarray:
    """Features of at most `sample` rows, on the driver."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for _, texts in text_chunks(batch):
                yield {"x": pa.array([x.tobytes() for x in features(texts)], pa.binary())}

        return work

    got = map_batches(rows.select("text"), make, "x binary").toArrow()
    return np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, WIDTH).astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Model:
    """Fit on bounded samples outside the held-out fold."""
    key = F.col("key")
    texts = docs.select(docs[id_column].alias("key"), docs[text_column].cast("string").alias("text")).where(~held_out(key))
    good = labels.where(F.col(label_column) == 1).select(labels[id_column].alias("key")).where(key.isNotNull() & ~held_out(key)).distinct()
    first = lambda ids: ids.orderBy(F.xxhash64("key", F.lit(11)), "key").limit(sample)
    picked = [first(good), first(texts.where(key.isNotNull()).select("key").distinct().join(good, "key", "left_anti"))]
    return Model(*(_matrix(texts.join(F.broadcast(ids), "key").groupBy("key").agg(F.min("text").alias("text"))) for ids in picked))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: id, held_out, score, predicted."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for part, texts in text_chunks(batch):
                s = model.score(features(texts))
                yield {"key": batch.column("key")[part.start : part.stop], "held_out": batch.column("held_out")[part.start : part.stop], "score": s, "predicted": (s >= threshold).astype(np.int32)}

        return work

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("key"), F.coalesce(held_out(docs[id_column]), F.lit(False)).alias("held_out"), docs[text_column].cast("string").alias("text"))
    return map_batches(rows, make, f"key {kind}, held_out boolean, score double, predicted int").withColumnRenamed("key", id_column)


def keep(docs: DataFrame, model: Model, threshold: float = 0.3, text_column: str = "text") -> DataFrame:
    """The rows of `docs` whose text scores at least `threshold`, all columns as they are."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = ["" if x is None else x for x in batch]
            parts = [model.score(features(texts[p])) >= threshold for p in chunks([len(x) for x in texts])]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0, bool))

    return docs.where(F.pandas_udf(run, "boolean")(F.col(text_column).cast("string")))
