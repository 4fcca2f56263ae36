"""Steps of long plans, written to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def materialise(rows: DataFrame, name: str) -> DataFrame:
    """`rows` as a table in the shared folder (spark.checkpoint.dir), read back: what is used several times is computed once, and lost executors cost nothing before it.

    A session of one machine without that setting makes a folder of its own; elsewhere its absence raises.
    """
    spark = rows.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="driftsonde-")
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """`rows` over as many partitions as there are cores, where they are read from fewer files than that and would all fit them; larger tables stay as they are read."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if rows.isStreaming or len(rows.inputFiles()) >= cores:
        return rows
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * 128 * 2**20 else rows
