"""Record stores: JSON lines and documents, CSV, merges by id, published generations."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from driftsonde.functions import text as T


def read_jsonl(spark: SparkSession, path: str, schema: StructType, id_column: str) -> DataFrame:
    """JSON lines; blank and broken ones are left out, of an id the last line stays."""
    rows = spark.read.text(path, wholetext=False).where(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_n"))
    rows = rows.where(F.col(f"r.{id_column}").isNotNull()).select("r.*", "_f", "_n")
    last = Window.partitionBy(id_column).orderBy(F.desc("_f"), F.desc("_n"))
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_f", "_n", "_r")


def read_json_tree(spark: SparkSession, path: str, schema: StructType, name: str = "meta.json") -> DataFrame:
    """All documents of that name below a folder."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", True).option("pathGlobFilter", name).json(path)


def read_json_map(spark: SparkSession, path: str, value: StructType, id_column: str = "id") -> DataFrame:
    """A document that maps ids to records, or lists records with an id (and, maybe, their fields below `metadata`); one row each."""
    whole = spark.read.text(path, wholetext=True)
    kind = value.simpleString()
    listed = F.trim("value").startswith("[")
    mapped = whole.where(~listed).select(F.explode(F.from_json("value", f"map<string,{kind}>")).alias(id_column, "r"))
    items = whole.where(listed).select(F.explode(F.from_json("value", f"array<struct<id:string,metadata:{kind}>>")).alias("a"), "value").select(F.col("a.id").alias(id_column), F.col("a.metadata").alias("r"))
    flat = whole.where(listed).select(F.posexplode(F.from_json("value", ArrayType(StructType([*StructType.fromDDL("id string").fields, *(f for f in value.fields if f.name != "id")]))))).select(F.col("col.id").alias(id_column), F.struct(*(F.col(f"col.{f.name}").alias(f.name) for f in value.fields)).alias("r"))
    nested = items.where("r is not null")
    rows = mapped.where("r is not null").unionByName(nested).unionByName(flat.join(nested.select(id_column), id_column, "left_anti"))
    return rows.where(F.col(id_column).isNotNull()).select(id_column, "r.*")


#: Fields of the blocks of a record that go into the flat one.
BLOCKS = {
    "metadata": ("title", "artist", "release_date", "genre", "type", "vocal_gender"),
    "lyrics_data": ("lyrics_highlight", "lyrics_summary"),
    "semantic_analysis": ("search_style_summary", "mood_tags", "time_weather_tags", "place_activity_tags", "emotion_tags", "vibe_tags", "relation_context_tags", "color_tags", "sound_tags", "melon_playlist_tags", "visual_imagery"),
    "community_feedback": ("sentiment_summary", "fans_tags", "major_emotion"),
}


def flatten(rows: DataFrame) -> DataFrame:
    """Nested records to flat ones with title features: `id` from id or song_id, blocks that are there; rows without an id leave."""
    ids = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in ("id", "song_id") if c in rows.columns]
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    fields = [F.col(block)[name].alias(name) for block, names in BLOCKS.items() if isinstance(kinds.get(block), StructType) for name in names if name in kinds[block].fieldNames()]
    f = T.title_features(F.col("metadata")["title"])
    names = {"script": "script", "char_count": "char_count", "word_count": "word_count", "contains_number": "contains_number", "repeated_char": "repeated_char", "repeated_word": "repeated_word", "has_latin_anywhere": "latin_anywhere", "has_hangul_anywhere": "hangul_anywhere", "has_hanja_anywhere": "hanja_anywhere", "has_number_anywhere": "number_anywhere"}
    return rows.select(F.coalesce(*ids).alias("id"), *fields, *(f[own].alias(f"title_{name}") for name, own in names.items())).where("id is not null")


def read_vectors(rows: DataFrame, column: str, dim: int) -> DataFrame:
    """Rows whose vectors have `dim` finite components; any other raises, when it is read."""
    v = F.col(column)
    good = v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.withColumn(column, F.when(good, v).otherwise(F.raise_error(F.lit(f"a vector that isn't {dim} finite numbers")).cast(rows.schema[column].dataType)))


def read_sparse(rows: DataFrame, id_column: str, indices: str = "indices", values: str = "values") -> DataFrame:
    """(id, term, weight) of sparse vectors kept as two arrays; arrays of different lengths raise."""
    checked = F.when(F.size(indices) == F.size(values), F.arrays_zip(F.col(indices).alias("term"), F.col(values).alias("weight"))).otherwise(F.raise_error(F.lit("indices and values differ in length")).cast("array<struct<term:bigint,weight:double>>"))
    return rows.select(id_column, F.explode(checked).alias("p")).select(id_column, F.col("p.term").alias("term"), F.col("p.weight").alias("weight"))


def segment_starts(seconds: Column, window: float = 120.0, segment: float = 12.0, n: int = 8) -> Column:
    """Where `n` segments start, evenly spread over the first `window` seconds; one start where the whole is no longer than a segment."""
    reach = F.least(seconds, F.lit(window)) - segment
    spread = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: reach * i / max(1, n - 1))
    return F.when(reach <= 0, F.array(F.lit(0.0))).otherwise(spread)


def best_metadata(sources: list[DataFrame], id_column: str) -> DataFrame:
    """One row an id: each column from the first source that has a value other than Unknown there. Sources have the same columns."""
    every = None
    for i, one in enumerate(sources):
        one = one.withColumn("_source", F.lit(i))
        every = one if every is None else every.unionByName(one)
    names = [c for c in sources[0].columns if c != id_column]
    known = lambda c: F.when(F.col(c).isNotNull() & (F.lower(F.trim(F.col(c).cast("string"))) != "unknown") & (F.trim(F.col(c).cast("string")) != ""), F.col(c))
    return every.groupBy(id_column).agg(*(F.min_by(known(c), F.when(known(c).isNotNull(), F.col("_source"))).alias(c) for c in names))


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header; a byte order mark is no part of it."""
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").option("enforceSchema", True).csv(path)


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """`base` with rows of equal keys replaced, new ones added."""
    return base.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def remove(base: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(ids, keys, "left_anti")


def lookup(table: DataFrame, wanted: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    """Rows of `wanted` (id, pos) in its order, unknown ids left out."""
    return wanted.join(table.select(id_column, *fields), id_column).orderBy("pos")


def scroll(table: DataFrame, id_column: str, after: object, limit: int) -> DataFrame:
    """The next page by id."""
    return table.where(F.col(id_column) > after).orderBy(id_column).limit(limit)


def append_new(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """`base` with those rows whose keys it doesn't have."""
    return base.unionByName(rows.join(base.select(*keys).distinct(), keys, "left_anti"))


def sync(base: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """`base` made equal to the records: their rows, in place of those of equal keys; rows without a record leave."""
    return base.join(records.select(*keys).distinct(), keys, "left_semi").transform(lambda kept: upsert(kept, records, keys))


def write_csv(rows: DataFrame, path: str) -> None:
    """A CSV folder with a header, written whole or not at all by the committer."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def content_digest(rows: DataFrame) -> tuple[int, int]:
    """Number of rows and an order-free digest of them."""
    n, digest = rows.agg(F.count("*"), F.bit_xor(F.xxhash64(*(F.col(f"`{c}`") for c in sorted(rows.columns))))).first()
    return n, digest or 0


def write_bundle(tables: dict[str, DataFrame], root: str) -> dict:
    """Tables below a new folder with a manifest of their digests, written last; `read_bundle` checks them."""
    spark = next(iter(tables.values())).sparkSession
    at = f"{root}/bundle={uuid.uuid4().hex}"
    manifest = {}
    for name, rows in tables.items():
        rows.write.parquet(f"{at}/{name}")
        manifest[name] = content_digest(spark.read.parquet(f"{at}/{name}"))
    _put(spark, f"{at}/manifest.json", json.dumps(manifest))
    return {"path": at, "tables": manifest}


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    manifest = json.loads(spark.read.text(f"{path}/manifest.json").first()["value"])
    out = {name: spark.read.parquet(f"{path}/{name}") for name in manifest}
    for name, rows in out.items():
        if list(content_digest(rows)) != manifest[name]:
            raise ValueError(f"{name} is not what was written")
    return out


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and move it there in one step, over what is there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = beside.getFileSystem(conf).create(beside, True)
    out.write(bytearray((text + "\n").encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf) if target.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
    context.rename(beside, target, options)


def _pointer(spark: SparkSession, root: str) -> dict | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/current")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return json.loads(spark.read.text(f"{root}/current").first()["value"])


def publish(rows: DataFrame, root: str, id_column: str, keep: int = 2) -> dict:
    """Write a new generation, verify it, then move a new pointer over the old one; readers of older ones are not touched.

    Of older generations the last `keep` - 1 stay. Ids that are there twice, and rows that don't come back, raise before
    the pointer moves.
    """
    spark = rows.sparkSession
    generation = f"{root}/gen={uuid.uuid4().hex}"
    rows.write.parquet(generation)
    back = spark.read.parquet(generation)
    n, ids = back.agg(F.count("*"), F.count_distinct(id_column)).first()
    if n != ids:
        raise ValueError(f"{n - ids} ids are there twice")
    before = _pointer(spark, root)
    older = [x for x in ([before["path"]] if before else []) + (before or {}).get("older", [])]
    manifest = {"path": generation, "rows": n, "columns": back.columns, "at": time.time(), "older": older[: max(0, keep - 1)]}
    _put(spark, f"{root}/current", json.dumps(manifest))
    for path in older[max(0, keep - 1) :]:
        old = spark._jvm.org.apache.hadoop.fs.Path(path)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return manifest


def current(spark: SparkSession, root: str, most_seconds: float | None = None) -> DataFrame:
    """The published generation; one older than `most_seconds` raises."""
    manifest = _pointer(spark, root)
    if manifest is None:
        raise ValueError(f"nothing is published at {root}")
    if most_seconds is not None and time.time() - manifest["at"] > most_seconds:
        raise ValueError(f"the generation at {root} is older than {most_seconds} s")
    return spark.read.parquet(manifest["path"])


def publication_state(spark: SparkSession, root: str, columns: list[str]) -> str:
    """ready, missing (nothing published) or misconfigured (other columns, or rows that aren't there)."""
    manifest = _pointer(spark, root)
    if manifest is None:
        return "missing"
    try:
        back = spark.read.parquet(manifest["path"])
    except Exception:  # noqa: BLE001  whatever keeps it from being read
        return "misconfigured"
    return "ready" if set(columns) <= set(back.columns) and back.count() == manifest["rows"] else "misconfigured"
