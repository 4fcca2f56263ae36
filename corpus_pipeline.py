"""The corpus pipeline: quality, line dedup, near-duplicate documents, personal data, packing.

Each stage takes (spark, docs, sf_dir) and is given what the one before kept, written as Parquet and read again. All
but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftsonde.llm import jaccard_join, line_dedup, packing, pii, quality_pu
from driftsonde.llm.arrays import shared_dir, table
from driftsonde.llm.queries import tokenizer_path

#: No SQL for a learnt classifier, edit similarity or the tokenizer.
ORACLE_SQL = None


def _columns(docs: DataFrame, like: DataFrame) -> DataFrame:
    return docs.select(*like.columns).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(like.schema["n_chars"].dataType)) if "n_chars" in like.columns else docs.select(*like.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from this stage's input and the labels table, does not reject."""
    model = quality_pu.train(docs, table(spark, sf_dir, "labels"))
    return quality_pu.keep(docs, model, threshold=0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those of which no line stays go, those blank before stay."""
    names = {c.lower() for c in docs.columns}
    counts = tuple(next(c for c in (f"{n}{'_' * i}" for i in range(99)) if c not in names) for n in ("n_lines", "n_dropped"))
    out = line_dedup.dedup_lines(docs, hamming=None, counts=counts)
    out = out.where((F.col(counts[1]) == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return _columns(out, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group linked by Jaccard similarity of five-word shingles of 0.8 or more."""
    groups = jaccard_join.jaccard_components(docs, n=5, num=8, den=10).where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return docs.join(groups, "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the kind's name."""
    return _columns(pii.redact_pii(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), window=2048, end_id=1)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
