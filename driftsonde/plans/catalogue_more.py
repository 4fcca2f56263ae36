"""Registered queries on ledgers, run comparisons, index building and linkage."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from driftsonde.operators import fusion, linkage
from driftsonde.plans.catalogue import _RRF_SQL, _WEIGHTS, _lists, query, r6, t


@query("""WITH e AS (SELECT user_id, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL)
SELECT user_id, coalesce(sum(n) FILTER (event_type = 'view'), 0) AS view_n, coalesce(sum(n) FILTER (event_type = 'click'), 0) AS click_n,
round(coalesce(sum(total) FILTER (event_type = 'view'), 0), 4) AS view_total, round(coalesce(sum(total) FILTER (event_type = 'click'), 0), 4) AS click_total FROM e GROUP BY user_id""")
def a_stage_pivot(spark, d):
    e = t(spark, d, "events")
    on = lambda kind, c: F.coalesce(F.sum(F.when(F.col("event_type") == kind, c)), F.lit(0))
    return e.groupBy("user_id").agg(on("view", F.lit(1)).alias("view_n"), on("click", F.lit(1)).alias("click_n"), F.round(on("view", F.col("value")), 4).alias("view_total"), F.round(on("click", F.col("value")), 4).alias("click_total"))


@query("""WITH x AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS queued FROM events)
SELECT event_id, epoch_us(ts) - epoch_us(queued) AS wait_us, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS span FROM x""")
def a_span_waits(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return t(spark, d, "events").select("event_id", (us(F.col("ts")) - us(F.lag("ts").over(w))).alias("wait_us"), F.row_number().over(w).alias("span"))


@query("""WITH c AS (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus = 'O') AS before, count(*) FILTER (o_orderstatus = 'F') AS after FROM orders GROUP BY o_custkey)
SELECT count(*) FILTER (after > before) AS gained, count(*) FILTER (after < before) AS lost, count(*) FILTER (after = before) AS same, count(*) FILTER (after > before) > count(*) FILTER (after < before) AS adopt FROM c""")
def a_adoption_gate(spark, d):
    on = lambda s: F.count_if(F.col("o_orderstatus") == s)
    c = t(spark, d, "orders").groupBy("o_custkey").agg(on("O").alias("before"), on("F").alias("after"))
    out = c.agg(F.count_if(F.expr("after > before")).alias("gained"), F.count_if(F.expr("after < before")).alias("lost"), F.count_if(F.expr("after = before")).alias("same"))
    return out.withColumn("adopt", F.col("gained") > F.col("lost"))


@query("""WITH a AS (SELECT c_custkey AS run, unnest(['segment', 'nation', 'balance']) AS name, unnest([c_mktsegment, c_nationkey::VARCHAR, (c_custkey % 3)::VARCHAR]) AS value FROM customer),
b AS (SELECT run, name, CASE WHEN name = 'balance' AND run % 2 = 0 THEN 'x' ELSE value END AS value FROM a WHERE NOT (name = 'nation' AND run % 5 = 0))
SELECT run, name, a.value AS before, b.value AS after FROM a FULL JOIN b USING (run, name) WHERE a.value IS DISTINCT FROM b.value""")
def a_condition_differences(spark, d):
    pairs = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("balance"), (F.col("c_custkey") % 3).cast("string"))
    a = t(spark, d, "customer").select(F.col("c_custkey").alias("run"), F.explode(pairs).alias("name", "value"))
    b = a.where(~((F.col("name") == "nation") & (F.col("run") % 5 == 0))).withColumn("value", F.when((F.col("name") == "balance") & (F.col("run") % 2 == 0), "x").otherwise(F.col("value")))
    return linkage.differences(a, b, ["run", "name"], "value")


@query("""WITH x AS (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS tag, p_retailprice AS v FROM part), m AS (SELECT tag, avg(v) AS mean, count(*) AS n FROM x GROUP BY tag HAVING count(*) >= 20)
SELECT tag, n, round(mean, 6) AS mean, 'high' AS side FROM m QUALIFY row_number() OVER (ORDER BY round(mean, 6) DESC, tag) <= 5 UNION ALL SELECT tag, n, round(mean, 6), 'low' FROM m QUALIFY row_number() OVER (ORDER BY round(mean, 6), tag) <= 5""")
def a_axis_tags(spark, d):
    m = t(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("tag"), "p_retailprice").groupBy("tag").agg(F.count("*").alias("n"), r6(F.avg("p_retailprice")).alias("mean")).where("n >= 20")
    return m.orderBy(F.desc("mean"), "tag").limit(5).withColumn("side", F.lit("high")).unionByName(m.orderBy("mean", "tag").limit(5).withColumn("side", F.lit("low")))


@query(f"""WITH {_RRF_SQL}, p AS (SELECT query_id, id, rank FROM f), k AS (SELECT unnest([5, 10, 20, 30]) AS depth), w AS (SELECT q.vec_id AS query_id, c.vec_id AS id FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT depth, count(*) FILTER (rank <= depth) AS found, count(*) FILTER (rank <= depth AND rank > 10) AS gained, count(*) FILTER (rank <= 10 AND rank > depth) AS lost FROM w JOIN p USING (query_id, id), k GROUP BY depth""")
def x_depth_sweep(spark, d):
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    wanted = e.where("id % 50 = 0").select(F.col("id").alias("query_id"), "label").join(e, "label").where("id <> query_id").select("query_id", "id")
    ranks = wanted.join(fusion.rrf(_lists(spark, d), _WEIGHTS).select("query_id", "id", "rank"), ["query_id", "id"]).select("rank", F.explode(F.array(*map(F.lit, (5, 10, 20, 30)))).alias("depth"))
    return ranks.groupBy("depth").agg(F.count_if(F.expr("rank <= depth")).alias("found"), F.count_if(F.expr("rank <= depth and rank > 10")).alias("gained"), F.count_if(F.expr("rank <= 10 and rank > depth")).alias("lost"))


@query(f"""WITH {_RRF_SQL} SELECT l.query_id, l.id, round(sum(CASE path WHEN 'dense' THEN 1.0 WHEN 'mixed' THEN 0.5 END / (60 + l.rank)) - any_value(f.score), 9) AS gap, count(*) AS n_paths
FROM lists l JOIN f ON f.query_id = l.query_id AND f.id = l.id WHERE path <> 'id' GROUP BY l.query_id, l.id""")
def x_ledger_totals(spark, d):
    """The ledger adds up to the fused score."""
    lists = _lists(spark, d)
    total = fusion.contributions(lists, _WEIGHTS).groupBy("query_id", "id").agg(F.sum("delta").alias("total"), F.count("*").alias("n_paths"))
    out = total.join(fusion.rrf(lists, _WEIGHTS), ["query_id", "id"])
    return out.select("query_id", "id", (F.round(F.col("total") - F.col("score"), 9) + 0.0).alias("gap"), "n_paths")


@query("""SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'exception' WHEN event_id % 7 = 0 THEN 'policy_skipped' WHEN event_type = 'purchase' THEN 'fallback' WHEN value IS NULL THEN 'unknown' ELSE 'applied' END AS outcome FROM events""")
def x_rerank_outcome(spark, d):
    flags = F.filter(F.array(F.when(F.col("event_id") % 13 == 0, "exception"), F.when(F.col("event_id") % 7 == 0, "policy"), F.when(F.col("event_type") == "purchase", "fallback")), lambda x: x.isNotNull())
    return t(spark, d, "events").select("event_id", linkage.outcome(flags, F.col("value").isNotNull()).alias("outcome"))


@query("SELECT lang, doc_id // 1000 AS part, string_agg(doc_id::VARCHAR, '|' ORDER BY doc_id) AS relevant_ids FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 GROUP BY lang, part")
def x_eval_export(spark, d):
    x = t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels").where("quality = 1 and toxic = 0"), "doc_id")
    return x.groupBy("lang", F.floor(F.col("doc_id") / 1000).alias("part")).agg(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), "|").alias("relevant_ids"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'a') AND contains(lower(p_type), 'a') THEN 'both' WHEN contains(lower(p_name), 'a') THEN 'name' WHEN contains(lower(p_type), 'a') THEN 'type' ELSE 'none' END AS field,
lower(concat_ws(' ', p_name, p_brand, p_type)) AS clue_text FROM part""")
def x_matched_field(spark, d):
    fields = {"name": F.col("p_name"), "type": F.col("p_type")}
    return t(spark, d, "part").select("p_partkey", linkage.matched_field(F.lit("a"), fields).alias("field"), F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("clue_text"))


@query("""WITH w AS (SELECT vec_id AS id, sha256(array_to_string(embedding[1:4], ',')) AS h FROM embeddings) SELECT id, CASE WHEN id % 4 = 0 THEN 'missing' WHEN id % 6 = 0 THEN 'changed' ELSE 'reuse' END AS plan FROM w""")
def m_embedding_plan(spark, d):
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.sha2(F.concat_ws(",", F.col("embedding").cast("array<string>")), 256).alias("key"))
    cached = e.where("id % 4 <> 0").withColumn("key", F.when(F.col("id") % 6 == 0, F.lit("old")).otherwise(F.col("key")))
    return linkage.reuse_plan(e, cached, "id", "key")


@query("""SELECT 'no metadata' AS problem, count(*) AS n FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'no vector', count(*) FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def m_preload_problems(spark, d):
    v, m = t(spark, d, "embeddings").select(F.col("vec_id").alias("id")), t(spark, d, "labels").select(F.col("doc_id").alias("id"))
    n = lambda a, b, name: a.join(b, "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    return n(v, m, "no metadata").unionByName(n(m, v, "no vector"))


@query("""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM p)
SELECT vec_id, round(40 + (x - lx) / (hx - lx) * 920, 4) AS x, round(40 + (y - ly) / (hy - ly) * 620, 4) AS y FROM p, b""")
def m_canvas(spark, d):
    p = t(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return linkage.canvas(p, 1000, 700, 40).select("vec_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("""WITH p AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), a AS (SELECT unnest(generate_series(0, 720)) AS step),
c AS (SELECT step, corr(cos(radians(step / 4.0)) * x + sin(radians(step / 4.0)) * y, z) AS c FROM p, a GROUP BY step) SELECT step::INT AS step, round(c, 6) AS correlation FROM c QUALIFY row_number() OVER (ORDER BY round(abs(c), 9) DESC, step) = 1""")
def m_best_rotation(spark, d):
    p = t(spark, d, "embeddings").select(*(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")))
    return linkage.best_rotation(p, "x", "y", "z", range(721)).withColumn("correlation", r6("correlation"))


@query("""WITH p AS (SELECT p_partkey, lower(regexp_replace(p_name, '\\s+', '', 'g')) AS key, p_name, p_brand, p_size FROM part),
s AS (SELECT p_partkey, CASE WHEN p_name LIKE '%1%' THEN 100 WHEN p_name LIKE '%2%' THEN 60 ELSE 0 END + CASE WHEN p_brand = 'Brand#11' THEN 20 ELSE 0 END - CASE WHEN p_size > 40 THEN 40 ELSE 0 END AS score, p_size = 1 AS hard FROM p)
SELECT p_partkey, score, CASE WHEN hard THEN 'reject' WHEN score < 60 THEN 'review' ELSE 'accept' END AS verdict FROM s""")
def m_candidate_scores(spark, d):
    points = [(F.col("p_name").contains("1"), 100), (~F.col("p_name").contains("1") & F.col("p_name").contains("2"), 60), (F.col("p_brand") == "Brand#11", 20), (F.col("p_size") > 40, -40)]
    return t(spark, d, "part").select("p_partkey", *linkage.verdict(points, F.col("p_size") == 1, 60))


@query("""SELECT conv_id, string_agg(upper(substr(role, 1, 1)) || ': ' || text, chr(10) ORDER BY turn, upper(substr(role, 1, 1)) || ': ' || text) AS case_text, count(*) FILTER (role = 'user') < 4 AS may_ask FROM conversations GROUP BY conv_id""")
def c_case_text_and_limits(spark, d):
    line = F.concat(F.upper(F.substring("role", 1, 1)), F.lit(": "), F.col("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(lines, "\n").alias("case_text"), (F.count_if(F.col("role") == "user") < 4).alias("may_ask"))


@query("""WITH d AS (SELECT doc_id, text FROM documents), c AS (SELECT doc_id, unnest(generate_series(0, greatest(length(text) - 1, 0), 400)) AS start, text FROM d)
SELECT doc_id, start::INT AS start, substr(text, start + 1, 500) AS chunk FROM c""")
def t_fixed_chunks(spark, d):
    return linkage.chunks(t(spark, d, "documents"), "doc_id", "text", 500, 100)
