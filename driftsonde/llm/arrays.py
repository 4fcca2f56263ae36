"""Shared numpy routines on ragged text arrays, and Arrow plumbing for the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_RNG = np.random.default_rng(20240229)
#: One random 64-bit value for each byte or BMP code point, and odd multipliers by position.
_VALUES = _RNG.integers(1, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RATIO = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, np.uint64)
#: Characters handled at once; bounds a worker's memory whatever the Arrow batch holds.
CHUNK_CHARS = 1_500_000


def powers(n: int) -> np.ndarray:
    """At least n powers of an odd constant modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n, 1 << 12), _RATIO))), dtype=np.uint64)
    return _POWERS


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def span_hashes(codes: np.ndarray, keep: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each span's kept codes and how many it keeps; a span runs from its start to the next one's, its kept codes come first."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    base = starts[0]
    codes, keep, starts = codes[base:], keep[base:], starts - base
    at = np.zeros(len(codes), np.int64)
    at[starts[1:]] = starts[:-1] - starts[1:]
    at += 1
    at[0] = 0
    np.cumsum(at, out=at)
    kept = np.add.reduceat(keep.astype(np.int64), starts)
    with np.errstate(over="ignore"):
        values = _VALUES[codes if codes.dtype == np.uint8 else codes & 0xFFFF] * powers(int(np.diff(np.append(starts, len(codes))).max()))[at]
        values[~keep] = 0
        return mix64(np.add.reduceat(values, starts) + kept.astype(np.uint64)), kept


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def byte_words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of UTF-8 texts: their hashes, and for each text the number of its words."""
    joined = b" ".join(texts) + b" "
    if lower:
        joined = joined.translate(_LOWER)
    codes = np.frombuffer(joined, np.uint8)
    keep = ~_SPACE[codes]
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    starts = np.flatnonzero(first)
    ends = np.cumsum([len(x) + 1 for x in texts]) if texts else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    return span_hashes(codes, keep, starts)[0], counts


def chunks(sizes: list[int], most: int = CHUNK_CHARS) -> Iterator[slice]:
    """Runs of items whose sizes sum to at most `most`, or single larger ones."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: str) -> DataFrame:
    """mapInArrow with per-task state: `make()` runs once a task, its result once a batch, yielding column dicts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    parsed = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for columns in work(batch):
                yield pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, parsed)


def text_chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[slice, list[str]]]:
    """The batch's texts, null as empty, in runs of bounded size."""
    texts = [x or "" for x in batch.column(column).to_pylist()]
    for part in chunks([len(x) for x in texts]):
        yield part, texts[part]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for cut lineage: spark.checkpoint.dir. A session of one machine may do without; its own is set then."""
    at = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="driftsonde-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: While a step is written, Spark shall remove its shuffle files as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: lineage ends there, and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what `durable` wrote, once nothing that is still to be computed reads it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.durable_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
