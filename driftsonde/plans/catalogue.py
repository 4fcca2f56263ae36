"""Registered queries and their SQL, one for each operator or small group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftsonde.operators import bm25, filters, fusion, search, surface
from driftsonde.sources import records

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    from driftsonde.plans import catalogue_eval, catalogue_links, catalogue_more, catalogue_paths  # noqa: F401  they register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


# Vector search -------------------------------------------------------------------------------------------------------


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """Every embedding whose id is divisible by 50, as a query."""
    return t(spark, d, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _corpus(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), *more)


_DENSE_SQL = """s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)"""


@query(f"WITH {_DENSE_SQL} SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 10")
def v_dense_topk_dot(spark, d):
    return search.dense_topk(_queries(spark, d), _corpus(spark, d), 10).withColumn("score", r6("score"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score
FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 10""")
def v_dense_topk_cosine(spark, d):
    return search.dense_topk(_queries(spark, d), _corpus(spark, d), 10, "cosine").withColumn("score", r6("score"))


@query(f"""WITH {_DENSE_SQL} SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank
FROM s JOIN embeddings e ON e.vec_id = s.id WHERE score >= 0.1 AND e.label IN (1, 3, 5) QUALIFY rank <= 20""")
def v_threshold_filtered(spark, d):
    near = search.dense_topk(_queries(spark, d), _corpus(spark, d, "label").where(F.col("label").isin(1, 3, 5)), 20, least=0.1)
    return near.withColumn("score", r6("score"))


@query("SELECT vec_id, round(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))[1], 6) AS first, round(list_sum(list_transform(embedding, lambda x: pow(x::DOUBLE, 2))) / list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS length FROM embeddings")
def v_l2_normalise(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", search.normalise(F.col("embedding")).alias("u"))
    return e.select("vec_id", r6(F.col("u")[0]).alias("first"), r6(search.norm(F.col("u"))).alias("length"))


@query("""WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT pos, avg(x) AS m FROM x GROUP BY pos), c AS (SELECT vec_id, pos, x - m AS c FROM x JOIN m USING (pos)),
n AS (SELECT vec_id, sqrt(sum(c * c)) AS n FROM c GROUP BY vec_id)
SELECT vec_id, round(sum(c / n * pos), 5) AS probe FROM c JOIN n USING (vec_id) GROUP BY vec_id""")
def v_mean_centre(spark, d):
    out = search.mean_centre(t(spark, d, "embeddings"), "embedding")
    probe = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return out.select("vec_id", F.round(probe, 5).alias("probe"))


@query("""WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label, pos::INT AS pos, round(avg(x), 6) AS mean FROM x GROUP BY label, pos""")
def v_group_mean_pool(spark, d):
    parts = t(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    return parts.groupBy("label", "p").agg(r6(F.avg(F.col("x").cast("double"))).alias("mean")).select("label", (F.col("p") + 1).alias("pos"), "mean")


@query("""SELECT a.vec_id AS query_id, count(*) AS n, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS mean,
round(max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS most, round(min(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS least
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY a.vec_id""")
def v_pairwise_similarity(spark, d):
    out = search.similarity_report(_queries(spark, d), _corpus(spark, d))
    return out.select("query_id", "n", *(r6(c).alias(c) for c in ("mean", "most", "least")))


@query(f"""WITH {_DENSE_SQL}, g AS (SELECT query_id, e.label AS label, id, score, row_number() OVER (PARTITION BY query_id, e.label ORDER BY score DESC, id) AS n FROM s JOIN embeddings e ON e.vec_id = s.id)
SELECT query_id, label, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label)::INT AS rank FROM g WHERE n = 1 QUALIFY rank <= 5""")
def v_best_per_group(spark, d):
    near = search.dense_topk(_queries(spark, d), _corpus(spark, d, "label"), 1, by="label")
    return search.best_per_group(near, "label", 5).select("query_id", "label", "id", r6("score").alias("score"), "rank")


@query(f"""WITH {_DENSE_SQL} SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank
FROM s WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1) QUALIFY rank <= 5""")
def v_restricted_search(spark, d):
    ids = t(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return search.dense_topk(_queries(spark, d), filters.id_filter(_corpus(spark, d), ids, "id", "bigint"), 5).withColumn("score", r6("score"))


@query(f"""WITH {_DENSE_SQL}, top AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM top JOIN embeddings e ON e.vec_id = id
WHERE label = (SELECT label FROM embeddings x WHERE x.vec_id = query_id)""")
def v_evidence_attached(spark, d):
    """Rows attached to the final candidates only: the label joins after the cut."""
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    near = search.dense_topk(_queries(spark, d), _corpus(spark, d), 20).drop("rank").join(e, "id")
    same = near.join(e.withColumnsRenamed({"id": "query_id", "label": "wanted"}), "query_id").where("label = wanted").select("query_id", "id", "score")
    return search.top_k(same, 20).withColumn("score", r6("score"))


@query("""SELECT count(*) AS n_rows, count(*) FILTER (vec_id IS NULL) AS n_empty_id, count(*) FILTER (len(embedding) <> 64) AS n_bad_dim,
count(*) FILTER (len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0) AS n_not_finite,
count(*) FILTER (abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 0.002) AS n_bad_norm,
count(*) - count(DISTINCT vec_id) AS n_duplicate_id FROM embeddings""")
def x_vector_issues(spark, d):
    return search.vector_issues(t(spark, d, "embeddings"), 64, "vec_id", "embedding")


# BM25 and hybrid -----------------------------------------------------------------------------------------------------

_TOKENS = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda x: x <> '')"
_BM25_SQL = f"""d AS (SELECT doc_id AS id, {_TOKENS} AS ts FROM documents), o AS (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM d),
p AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM o GROUP BY id, term),
st AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avgdl FROM d WHERE len(ts) > 0), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
b AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark),
i AS (SELECT query_id, term, ln((n_docs + 1) / (coalesce(df, 1) + 0.5)) AS idf FROM b LEFT JOIN df USING (term), st),
w AS (SELECT query_id, term, idf / sum(idf) OVER (PARTITION BY query_id) AS qw FROM i),
sc AS (SELECT query_id, id, sum(qw * tf / (1.2 * (0.25 + 0.75 * dl / avgdl) + tf)) AS score FROM p JOIN w USING (term), st GROUP BY query_id, id)"""


def _bm25(spark, d):
    return bm25.Scores(t(spark, d, "benchmark"), t(spark, d, "documents"), "item_id", "text", "doc_id", "text")


@query(f"WITH {_BM25_SQL} SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INT AS rank FROM sc QUALIFY rank <= 10")
def b_bm25_topk(spark, d):
    return search.top_k(_bm25(spark, d).top(12).withColumn("score", F.round("score", 9)), 10).withColumn("score", r6("score"))


@query(f"""WITH d AS (SELECT doc_id AS id, {_TOKENS} AS ts FROM documents), p AS (SELECT DISTINCT id, unnest(ts) AS term FROM d), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
l AS (SELECT count(*) AS n_docs, min(len(ts)) AS min_length, avg(len(ts)) AS avg_length, max(len(ts)) AS max_length FROM d WHERE len(ts) > 0)
SELECT n_docs, min_length::BIGINT AS min_length, round(avg_length, 6) AS avg_length, max_length::BIGINT AS max_length, (SELECT count(*) FROM f) AS unique_terms, (SELECT count(*) FROM f WHERE df = 1) AS singleton_terms FROM l""")
def b_corpus_stats(spark, d):
    return bm25.corpus_stats(t(spark, d, "documents"), "doc_id", "text").withColumn("avg_length", r6("avg_length"))


@query(f"""WITH d AS (SELECT doc_id AS id, {_TOKENS} AS ts FROM documents), p AS (SELECT DISTINCT id, unnest(ts) AS term FROM d)
SELECT term, count(*) AS df, round(count(*) / (SELECT count(*) FROM d WHERE len(ts) > 0), 6) AS ratio FROM p GROUP BY term ORDER BY df DESC, term LIMIT 20""")
def b_top_terms(spark, d):
    docs = t(spark, d, "documents")
    df = bm25.document_frequency(bm25.postings(docs, "doc_id", "text"))
    return df.orderBy(F.desc("df"), "term").limit(20).crossJoin(bm25.fit(docs, "doc_id", "text")).select("term", "df", r6(F.col("df") / F.col("n_docs")).alias("ratio"))


@query(f"""WITH w AS (SELECT item_id, unnest(list_distinct({_TOKENS})) AS term FROM benchmark),
n AS (SELECT count(*) AS n FROM documents), c AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT term FROM w) JOIN documents ON contains(lower(text), term) GROUP BY term)
SELECT item_id, term, coalesce(df, 0) AS df, coalesce(df, 0) <= greatest(10, round_even(0.045 * n, 0)) AS rare FROM w LEFT JOIN c USING (term), n""")
def b_surface_frequency(spark, d):
    """How many documents hold each query word as a substring."""
    words = t(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(bm25.terms(F.col("text")))).alias("term"))
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    found = surface.surface_frequency(words, docs)
    out = words.join(found, "term", "left").crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).withColumn("df", F.coalesce("df", F.lit(0)))
    return out.select("item_id", "term", "df", bm25.is_rare(F.col("df"), F.col("n")).alias("rare"))


@query(f"""WITH p AS (SELECT DISTINCT unnest({_TOKENS}) AS term FROM documents), h AS (SELECT term, ('0x' || substr(md5(term), 1, 4))::BIGINT AS bucket FROM p),
g AS (SELECT bucket, count(*) AS n, string_agg(term, ' ' ORDER BY term) AS terms FROM h GROUP BY bucket) SELECT bucket, n, terms FROM g WHERE n > 1""")
def b_hash_collisions(spark, d):
    """Terms of all documents that share a bucket; sixteen bits of MD5 here, as DuckDB has no Murmur3."""
    posts = t(spark, d, "documents").select(F.explode_outer(bm25.terms(F.col("text"))).alias("term")).where("term is not null")
    short = lambda c: F.conv(F.substring(F.md5(c.cast("binary")), 1, 4), 16, 10).cast("bigint")
    return bm25.hash_collisions(posts, short).select("bucket", "n", F.array_join("terms", " ").alias("terms"))


_HYBRID_SQL = f"""{_BM25_SQL}, s AS (SELECT item_id AS query_id, c.vec_id AS id, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score
  FROM benchmark JOIN embeddings q ON q.vec_id = item_id JOIN embeddings c ON q.vec_id <> c.vec_id),
h AS (SELECT query_id, id, 0.6 * score AS d, 0.0 AS s FROM s UNION ALL SELECT query_id, id, 0.0, 0.4 * score FROM sc),
f AS (SELECT query_id, id, round(sum(d) + sum(s), 9) AS score FROM h GROUP BY query_id, id)"""


@query(f"WITH {_HYBRID_SQL} SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM f QUALIFY rank <= 10")
def q_hybrid_search(spark, d):
    """Every benchmark item: its text against all documents, the embedding of its number against all embeddings."""
    asked = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id")).join(t(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), "query_id", "left")
    near = search.hybrid_topk(asked, _corpus(spark, d), _bm25(spark, d), 0.6, 12)
    return search.top_k(near.drop("rank").withColumn("score", F.round("score", 9)), 10).withColumn("score", r6("score"))


# Filters and lookups -------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 30 AND (p_brand = 'Brand#11' OR p_brand IN ('Brand#12', 'Brand#23') AND p_retailprice < 1500) AND NOT (p_size = 20)""")
def f_and_or_not(spark, d):
    p = t(spark, d, "part")
    spec = {"p_size": {"$gte": 10, "$lte": 30}, "$or": [{"p_brand": "Brand#11"}, {"$and": [{"p_brand": {"$in": ["Brand#12", "Brand#23"]}}, {"p_retailprice": {"$lt": 1500}}]}], "$not": {"p_size": 20}}
    return p.where(filters.compile_filter(p, spec)).select("p_partkey")


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS brand FROM part)
SELECT p_partkey, NOT coalesce(brand = 'Brand#11', false) AS differs, brand IS NOT NULL AND brand NOT IN ('Brand#11', 'Brand#12') AS outside FROM p""")
def f_null_semantics(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("brand"))
    return p.select("p_partkey", filters.passes(p, {"brand": {"$ne": "Brand#11"}}).alias("differs"), filters.passes(p, {"brand": {"$nin": ["Brand#11", "Brand#12"]}}).alias("outside"))


@query("""SELECT doc_id FROM documents WHERE list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'the') AND list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'er')""")
def f_text_tokens(spark, d):
    x = t(spark, d, "documents")
    return x.where(filters.compile_filter(x, {"text": {"$text": "The, er!"}})).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) IN (1996, 1997, 1999)")
def f_era_windows(spark, d):
    o = t(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy.MM.dd"))
    return o.where(filters.compile_filter(o, filters.era_filter([(1996, 1997), (1999, 1999), (1960, 1990)], "day"))).select("o_orderkey")


@query(f"""WITH {_DENSE_SQL}, k AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, rank::INT AS rank, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS kept_rank FROM k WHERE rank <= 15 AND (query_id + id) % 3 <> 0 QUALIFY kept_rank <= 5""")
def f_reject_then_trim(spark, d):
    ranked = search.dense_topk(_queries(spark, d), _corpus(spark, d), 15)
    rejected = ranked.where("(query_id + id) % 3 = 0").select("query_id", "id")
    return filters.reject_then_trim(ranked, rejected, 5).select("query_id", "id", "rank", "kept_rank")


@query("SELECT p.pos, c_custkey, c_name FROM (SELECT unnest([30, 7, 999999999, 12]) AS k, generate_subscripts([30, 7, 999999999, 12], 1) AS pos) p JOIN customer ON c_custkey = k")
def s_point_lookup(spark, d):
    wanted = spark.createDataFrame([(k, i + 1) for i, k in enumerate((30, 7, 999999999, 12))], "c_custkey bigint, pos bigint")
    return records.lookup(t(spark, d, "customer"), wanted, "c_custkey", ["c_name"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 100 ORDER BY c_custkey LIMIT 25")
def s_keyset_scroll(spark, d):
    return records.scroll(t(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 100, 25)


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 7 <> 0 UNION ALL SELECT 1000000007, 'new', 1.5")
def k_upsert_remove(spark, d):
    base = t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    changes = base.where("s_suppkey % 4 = 0").withColumn("s_acctbal", F.lit(0.0)).unionByName(spark.sql("SELECT 1000000007L AS s_suppkey, 'new' AS s_name, 1.5D AS s_acctbal"))
    return records.remove(records.upsert(base, changes, ["s_suppkey"]), base.where("s_suppkey % 7 = 0").select("s_suppkey"), ["s_suppkey"])


# Fusion --------------------------------------------------------------------------------------------------------------

_LISTS_SQL = f"""{_DENSE_SQL}, lists AS (
SELECT query_id, 'dense' AS path, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 30
UNION ALL SELECT query_id, 'mixed', id, row_number() OVER (PARTITION BY query_id ORDER BY list_inner_product(q.embedding[1:32]::DOUBLE[], c.embedding[1:32]::DOUBLE[]) DESC, id) AS rank
  FROM s JOIN embeddings q ON q.vec_id = query_id JOIN embeddings c ON c.vec_id = id QUALIFY rank <= 30
UNION ALL SELECT query_id, 'id', id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM s QUALIFY rank <= 10)"""


def _lists(spark, d) -> DataFrame:
    """Three ranked lists a query: by all of the vector, by its first half, and the first ids."""
    asked, corpus = _queries(spark, d), _corpus(spark, d)
    half = lambda df, c: df.withColumn(c, F.slice(c, 1, 32))
    path = lambda rows, name: rows.select("query_id", F.lit(name).alias("path"), "id", "rank")
    first = asked.select("query_id").crossJoin(F.broadcast(corpus.select("id").orderBy("id").limit(11))).where("id <> query_id")
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).where("rank <= 10")
    dense, mixed = search.dense_topk(asked, corpus, 30), search.dense_topk(half(asked, "query"), half(corpus, "vector"), 30)
    return path(dense, "dense").unionByName(path(mixed, "mixed")).unionByName(path(first, "id"))


_RRF_SQL = f"""{_LISTS_SQL}, r AS (SELECT query_id, id,
coalesce(max(CASE WHEN path = 'dense' THEN 1.0 / (60 + rank) END), 0) + coalesce(max(CASE WHEN path = 'mixed' THEN 0.5 / (60 + rank) END), 0) AS score,
min(CASE path WHEN 'dense' THEN 0 ELSE 1 END * 1000 + rank) AS first FROM lists WHERE path <> 'id' GROUP BY query_id, id),
f AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id)::INT AS rank FROM r)"""
_WEIGHTS = {"dense": 1.0, "mixed": 0.5, "id": 0.0}


@query(f"WITH {_RRF_SQL} SELECT query_id, id, round(score, 9) AS score, rank FROM f WHERE rank <= 20")
def r_weighted_rrf(spark, d):
    return fusion.rrf(_lists(spark, d), _WEIGHTS, 20).withColumn("score", F.round("score", 9))


@query(f"WITH {_LISTS_SQL} SELECT query_id, id, path, round(CASE path WHEN 'dense' THEN 1.0 ELSE 0.5 END / (60 + rank), 9) AS delta FROM lists WHERE path <> 'id'")
def r_contribution_ledger(spark, d):
    return fusion.contributions(_lists(spark, d), _WEIGHTS).withColumn("delta", F.round("delta", 9))


@query(f"""WITH {_LISTS_SQL}, c AS (SELECT query_id, id, path, CASE path WHEN 'dense' THEN 0.9 WHEN 'mixed' THEN 0.8 ELSE 1.0 END / (60 + rank) AS score FROM lists)
SELECT query_id, id, round(max(score), 9) AS score, arg_min(path, (-score, path)) AS clue, count(*) AS n_clues FROM c GROUP BY query_id, id""")
def r_clue_max(spark, d):
    out = fusion.clue_max(_lists(spark, d).withColumnRenamed("path", "clue").withColumn("confidence", F.when(F.col("clue") == "dense", 0.9).when(F.col("clue") == "mixed", 0.8).otherwise(1.0)))
    return out.withColumn("score", F.round("score", 9))


@query(f"""WITH {_LISTS_SQL}, p AS (SELECT query_id, id, min(rank * 10 + CASE path WHEN 'dense' THEN 1 WHEN 'mixed' THEN 2 ELSE 3 END) AS place FROM lists GROUP BY query_id, id)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY place, id)::INT AS position FROM p QUALIFY position <= 10""")
def r_interleave(spark, d):
    no = F.when(F.col("path") == "dense", 1).when(F.col("path") == "mixed", 2).otherwise(3)
    return fusion.interleave(_lists(spark, d).withColumn("list_no", no))


@query("""WITH w AS (SELECT event_id, value AS text, (event_id % 7)::DOUBLE AS image FROM events),
x AS (SELECT event_id, greatest(text, 0.1) AS text, greatest(image, 0.1) AS image FROM w)
SELECT event_id, round(text / (text + image + 0.0), 6) AS text, round(image / (text + image + 0.0), 6) AS image, 0.0 AS audio FROM x""")
def r_modality_weights(spark, d):
    e = t(spark, d, "events").select("event_id", F.col("value").alias("text"), (F.col("event_id") % 7).cast("double").alias("image"), F.lit(5.0).alias("audio"))
    return e.select("event_id", *fusion.modality_weights(["text", "image", "audio"], {"text": True, "image": True, "audio": False}))


@query("""SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1997 AND 1998 THEN 1.0
ELSE greatest(0.0, 1 - 0.25 * greatest(1997 - year(o_orderdate), year(o_orderdate) - 1998)) END AS similarity FROM orders""")
def r_era_similarity(spark, d):
    return t(spark, d, "orders").select("o_orderkey", fusion.era_similarity(F.year("o_orderdate"), F.lit(1997), F.lit(1998)).alias("similarity"))


@query("""WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'phonetic' WHEN 2 THEN 'fuzzy' ELSE 'none' END AS kind, 1 + event_id % 50 AS rank FROM events)
SELECT event_id, round(1.0 / 61 * CASE kind WHEN 'exact' THEN 8 WHEN 'phonetic' THEN 5 WHEN 'fuzzy' THEN 3 ELSE 0 END * 0.9 * CASE WHEN kind = 'exact' THEN 1 ELSE 61.0 / (60 + rank) END, 9) AS boost FROM x""")
def r_lyric_boost(spark, d):
    m = F.col("event_id") % 4
    kind = F.when(m == 0, "exact").when(m == 1, "phonetic").when(m == 2, "fuzzy").otherwise("none")
    return t(spark, d, "events").select("event_id", F.round(fusion.lyric_boost(kind, F.lit(0.9), 1 + F.col("event_id") % 50), 9).alias("boost"))


@query("""WITH p AS (SELECT p_brand AS query_id, p_partkey AS id, p_retailprice AS retrieval, CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey * 13 % 29)::DOUBLE END AS judged FROM part),
n AS (SELECT *, CASE WHEN max(retrieval) OVER w = min(retrieval) OVER w THEN 1.0 ELSE (retrieval - min(retrieval) OVER w) / (max(retrieval) OVER w - min(retrieval) OVER w) END AS r,
CASE WHEN max(judged) OVER w = min(judged) OVER w THEN 1.0 ELSE (judged - min(judged) OVER w) / (max(judged) OVER w - min(judged) OVER w) END AS j,
0.45 * least(1.0, (max(judged) OVER w - min(judged) OVER w) / 4.0) AS w FROM p WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT query_id, id, judged, coalesce(w * j + (1 - w) * r, r) AS score FROM n)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY judged IS NULL, score DESC, id)::INT AS rank FROM b""")
def r_rerank_blend(spark, d):
    judged = F.when(F.col("p_partkey") % 3 != 0, (F.col("p_partkey") * 13 % 29).cast("double"))
    rows = t(spark, d, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("retrieval"), judged.alias("judged"))
    return fusion.rerank_blend(rows).withColumn("score", r6("score"))


@query("""WITH p AS (SELECT event_type AS query_id, user_id AS id, CASE WHEN event_id % 4 <> 0 THEN 1 + event_id % 20 END AS r, (event_id % 11) / 10.0 AS rel FROM events)
SELECT query_id, id, round(0.75 * avg(1 - (coalesce(r, 20) - 1) / 19.0) + 0.25 * avg(rel), 6) AS llm_score FROM p GROUP BY query_id, id""")
def r_pass_scores(spark, d):
    e = t(spark, d, "events").select(F.col("event_type").alias("query_id"), F.col("user_id").alias("id"), F.when(F.col("event_id") % 4 != 0, 1 + F.col("event_id") % 20).alias("pass_rank"), (F.col("event_id") % 11 / 10.0).alias("relevance"))
    return fusion.pass_scores(e, 20).withColumn("llm_score", r6("llm_score"))


@query("SELECT event_id, round(CASE WHEN (event_id % 100) / 100.0 < 0.55 THEN 0.85 * greatest(0.35, (event_id % 100) / 100.0 / 0.55) ELSE 0.85 END, 9) AS weight FROM events")
def r_listwise_weight(spark, d):
    return t(spark, d, "events").select("event_id", F.round(fusion.listwise_weight(F.col("event_id") % 100 / 100.0), 9).alias("weight"))


@query(f"""WITH {_RRF_SQL} SELECT query_id, id, rank, row_number() OVER (PARTITION BY query_id ORDER BY id % 7 = 0 DESC, CASE WHEN id % 7 = 0 THEN id % 3 ELSE 0 END DESC, rank)::INT AS new_rank
FROM f WHERE rank <= 20 QUALIFY new_rank <= 10""")
def r_protected_placement(spark, d):
    rows = fusion.rrf(_lists(spark, d), _WEIGHTS, 20).withColumn("protected", F.col("id") % 7 == 0).withColumn("tier", F.col("id") % 3)
    return fusion.protect(rows, 10).select("query_id", "id", "rank", "new_rank")


@query(f"""WITH {_RRF_SQL}, base AS (SELECT * FROM f WHERE rank <= 10),
n AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS n FROM lists l WHERE path = 'id' AND NOT EXISTS (SELECT 1 FROM base b WHERE b.query_id = l.query_id AND b.id = l.id) QUALIFY n <= 3),
m AS (SELECT query_id, max(n) AS m FROM n GROUP BY query_id), a AS (SELECT b.query_id, b.score AS anchor FROM base b JOIN m USING (query_id) WHERE b.rank = 10 - m + 1),
e AS (SELECT query_id, id, score, false AS is_new FROM base UNION ALL SELECT query_id, id, anchor * 1.0 - (n - 1) * 1e-6, true FROM n JOIN a USING (query_id))
SELECT query_id, id, round(score, 9) AS score, is_new, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, is_new, id)::INT AS rank FROM e QUALIFY rank <= 10""")
def r_supplement(spark, d):
    lists = _lists(spark, d)
    extra = lists.where("path = 'id'").select("query_id", "id", F.col("rank").alias("extra_rank"))
    return fusion.supplement(fusion.rrf(lists, _WEIGHTS, 10), extra, 3, 1.0, 10).withColumn("score", F.round("score", 9))


@query("""SELECT p_brand AS query_id, p_partkey AS id, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC)::INT AS p_size_rank,
rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC)::INT AS p_retailprice_rank FROM part""")
def x_counterfactual_ranks(spark, d):
    p = t(spark, d, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("id"), "p_size", "p_retailprice")
    return fusion.counterfactual_ranks(p, ["p_size", "p_retailprice"]).drop("p_size", "p_retailprice")


# Phrase search -------------------------------------------------------------------------------------------------------

_SURFACE = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _phrases(spark, d):
    words = F.slice(F.split("text", " "), 3, 5)
    return t(spark, d, "benchmark").select(F.col("item_id").alias("phrase_id"), F.array_join(words, " ").alias("phrase"), F.lit(0.9).alias("confidence"))


_PHRASE = _SURFACE.format("array_to_string(string_split(text, ' ')[3:7], ' ')")


@query(f"""WITH p AS (SELECT item_id AS phrase_id, {_PHRASE} AS p FROM benchmark),
s AS (SELECT doc_id AS id, {_SURFACE.format("text")} AS s FROM documents)
SELECT phrase_id, id, 'exact' AS kind, 0.9 AS score, count(*) OVER (PARTITION BY phrase_id) AS phrase_count FROM p JOIN s ON contains(s, p) WHERE p <> ''
QUALIFY row_number() OVER (PARTITION BY id ORDER BY phrase_id) = 1""")
def l_exact_phrases(spark, d):
    found = surface.phrase_matches(_phrases(spark, d), t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return surface.best_clue(found.withColumn("_q", F.lit(1)), "_q").select("phrase_id", "id", "kind", F.col("score"), "phrase_count")


@query(f"""WITH p AS (SELECT item_id AS phrase_id, {_PHRASE} AS p FROM benchmark),
b AS (SELECT phrase_id, CASE WHEN phrase_id % 2 = 0 THEN p ELSE substr(p, 1, 6) || 'zq' || substr(p, 9) END AS p FROM p WHERE length(p) >= 5),
g AS (SELECT phrase_id, p, list_distinct(list_transform(generate_series(1, length(p) - 2), lambda i: substr(p, i, 3))) AS g FROM b),
s AS (SELECT doc_id AS id, {_SURFACE.format("text")} AS s FROM documents),
c AS (SELECT phrase_id, id, p, len(list_filter(g, lambda x: contains(s, x))) / len(g) AS cover,
  coalesce(list_max(list_filter(generate_series(1, length(p)), lambda n: len(list_filter(generate_series(1, length(p) - n + 1), lambda i: contains(s, substr(p, i, n)))) > 0)), 0) / length(p) AS common
  FROM g JOIN s ON len(list_filter(g, lambda x: contains(s, x))) >= 0.55 * len(g) AND 0.65 * len(list_filter(g, lambda x: contains(s, x))) / len(g) + 0.35 >= 0.78)
SELECT phrase_id, id, round((0.65 * cover + 0.35 * common) * 0.9, 6) AS score FROM c WHERE 0.65 * cover + 0.35 * common >= 0.78""")
def l_fuzzy_phrases(spark, d):
    p = _phrases(spark, d).withColumn("phrase", surface.surface(F.col("phrase"))).where(F.length("phrase") >= 5)
    broken = F.concat(F.substring("phrase", 1, 6), F.lit("zq"), F.substring("phrase", 9, 1000))
    p = p.withColumn("phrase", F.when(F.col("phrase_id") % 2 == 0, F.col("phrase")).otherwise(broken))
    return surface.fuzzy_matches(p, t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).withColumn("score", r6("score"))


@query("""WITH n AS (SELECT n_nationkey AS name_id, lower(n_name) AS name FROM nation UNION ALL SELECT 100 + r_regionkey, 'the ' || lower(substr(r_name, 1, 2)) FROM region UNION ALL SELECT 200, 'of the'),
s AS (SELECT DISTINCT doc_id AS id, trim(unnest(string_split_regex(text, '[.!?\n]+')), ' ') AS sentence FROM documents)
SELECT name_id, id, sentence FROM n JOIN s ON contains(' ' || array_to_string(regexp_extract_all(lower(sentence), '[\\p{L}\\p{N}]+'), ' ') || ' ', ' ' || array_to_string(regexp_extract_all(name, '[\\p{L}\\p{N}]+'), ' ') || ' ') WHERE sentence <> ''""")
def l_mentions(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("name_id"), F.lower("n_name").alias("name"))
    n = n.unionByName(t(spark, d, "region").select((F.col("r_regionkey") + 100).cast("bigint").alias("name_id"), F.concat(F.lit("the "), F.lower(F.substring("r_name", 1, 2))).alias("name")))
    n = n.unionByName(spark.sql("SELECT 200L AS name_id, 'of the' AS name"))
    return surface.mentions(t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), n)
