"""Registered queries on evaluation, clarification, cases, text and record linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftsonde.functions import text as T
from driftsonde.operators import cases, clarify, fusion, metrics, search
from driftsonde.plans.catalogue import _DENSE_SQL, _RRF_SQL, _WEIGHTS, _corpus, _lists, _queries, query, r6, t
from driftsonde.streaming.cases import windowed_counts

# Metrics -------------------------------------------------------------------------------------------------------------

_JUDGED_SQL = f"""{_DENSE_SQL}, top AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 20),
pos AS (SELECT q.vec_id AS query_id, c.vec_id AS id FROM embeddings q JOIN embeddings c ON q.label = c.label AND c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 AND c.vec_id % 2 = 0),
neg AS (SELECT q.vec_id AS query_id, c.vec_id AS id FROM embeddings q JOIN embeddings c ON (q.label + 1) % 10 = c.label WHERE q.vec_id % 50 = 0)"""


_METRIC_ROWS = """m AS (SELECT q.vec_id AS query_id, q.label,
coalesce((SELECT count(*) FROM top JOIN pos USING (query_id, id) WHERE query_id = q.vec_id AND rank <= 10) / nullif((SELECT count(*) FROM pos WHERE query_id = q.vec_id), 0), 0) AS recall,
coalesce(1.0 / (SELECT min(rank) FROM top JOIN pos USING (query_id, id) WHERE query_id = q.vec_id AND rank <= 10), 0) AS rr,
coalesce((SELECT sum(1 / log2(rank + 1)) FROM top JOIN pos USING (query_id, id) WHERE query_id = q.vec_id AND rank <= 10)
 / (SELECT sum(1 / log2(i + 1)) FROM generate_series(1, least(10, (SELECT count(*) FROM pos WHERE query_id = q.vec_id))) g(i)), 0) AS ndcg,
(SELECT min(rank) FROM top JOIN pos USING (query_id, id) WHERE query_id = q.vec_id) AS first_rank,
coalesce((SELECT count(*) FROM top JOIN neg USING (query_id, id) WHERE query_id = q.vec_id AND rank <= 10) / nullif((SELECT count(*) FROM neg WHERE query_id = q.vec_id), 0), 0) AS negative_rate,
(SELECT avg(rank) FROM top JOIN neg USING (query_id, id) WHERE query_id = q.vec_id) AS negative_rank
FROM embeddings q WHERE q.vec_id % 50 = 0)"""


def _measured(spark, d) -> DataFrame:
    """Metrics of the 20 nearest: rows of the same label and an even id are right, those of the next label wrong."""
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    asked = e.where("id % 50 = 0").select(F.col("id").alias("query_id"), "label")
    sizes = e.groupBy("label").agg(F.count_if(F.col("id") % 2 == 0).alias("_even"), F.count("*").alias("_all"))
    after = sizes.select(((F.col("label") + 9) % 10).alias("label"), F.col("_all").alias("n_negative"))
    totals = asked.join(sizes, "label").join(after, "label", "left")
    totals = totals.select("query_id", "label", (F.col("_even") - (F.col("query_id") % 2 == 0).cast("int")).alias("n_positive"), F.coalesce("n_negative", F.lit(0)).alias("n_negative"))
    near = search.dense_topk(_queries(spark, d), _corpus(spark, d), 20).join(e.withColumnRenamed("label", "_other"), "id").join(asked, "query_id")
    found = near.select("query_id", "id", "rank", ((F.col("_other") == F.col("label")) & (F.col("id") % 2 == 0)).alias("positive"), (F.col("_other") == (F.col("label") + 1) % 10).alias("negative"))
    return metrics.from_ranks(found, totals, 10).join(asked, "query_id")


@query(f"WITH {_JUDGED_SQL}, {_METRIC_ROWS} SELECT query_id, label, round(recall, 6) AS recall, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg, first_rank::INT AS first_rank, round(negative_rate, 6) AS negative_rate, round(negative_rank, 6) AS negative_rank FROM m")
def a_query_metrics(spark, d):
    names = ["recall", "rr", "ndcg", "negative_rate", "negative_rank"]
    return _measured(spark, d).withColumns({n: r6(n) for n in names}).select("query_id", "label", *names, "first_rank")


@query(f"WITH {_JUDGED_SQL}, {_METRIC_ROWS} SELECT label, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit5 FROM m GROUP BY GROUPING SETS ((label), ())")
def a_group_means(spark, d):
    hit = F.when(F.col("first_rank") <= 5, 1.0).otherwise(0.0)
    return _measured(spark, d).rollup("label").agg(F.count("*").alias("n"), r6(F.avg("recall")).alias("recall"), r6(F.avg("rr")).alias("mrr"), r6(F.avg("ndcg")).alias("ndcg"), r6(F.avg(hit)).alias("hit5"))


@query(f"WITH {_DENSE_SQL}, top AS (SELECT query_id, id FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10) SELECT query_id, round(count(DISTINCT label) / count(*), 6) AS diversity FROM top JOIN embeddings ON vec_id = id GROUP BY query_id")
def a_diversity(spark, d):
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return search.dense_topk(_queries(spark, d), _corpus(spark, d), 10).join(e, "id").groupBy("query_id").agg(r6(F.count_distinct("label") / F.count("*")).alias("diversity"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 1) AS median, round(max(CASE WHEN r = least(floor(n * 0.95), n - 1) + 1 THEN value END), 1) AS p95_floor,
round(max(CASE WHEN r = round_even((n - 1) * 0.95, 0) + 1 THEN value END), 1) AS p95_nearest, round(quantile_cont(value, 0.95), 1) AS p95_linear, round(max(value), 1) AS max, round(min(value), 1) AS min FROM r GROUP BY event_type""")
def a_latency_summary(spark, d):
    return metrics.latency_summary(t(spark, d, "events"), "event_type", "value")


@query(f"WITH {_RRF_SQL} SELECT CASE WHEN rank <= 5 THEN 'top5' WHEN rank <= 10 THEN '6-10' ELSE 'out' END AS bucket, count(*) AS n FROM f GROUP BY bucket")
def a_rank_buckets(spark, d):
    return fusion.rrf(_lists(spark, d), _WEIGHTS).groupBy(metrics.rank_bucket(F.col("rank")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH {_RRF_SQL}, w AS (SELECT q.vec_id AS query_id, c.vec_id AS id FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT w.query_id, w.id, CASE WHEN rank <= 10 THEN 'kept' WHEN NOT EXISTS (SELECT 1 FROM lists l WHERE l.query_id = w.query_id AND l.id = w.id) THEN 'no_path' WHEN rank IS NULL OR rank > 30 THEN 'fusion_cut' ELSE 'final_cut' END AS stage
FROM w LEFT JOIN f ON f.query_id = w.query_id AND f.id = w.id""")
def a_drop_stage(spark, d):
    e, lists = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), _lists(spark, d)
    wanted = e.where("id % 50 = 0").select(F.col("id").alias("query_id"), "label").join(e, "label").where("id <> query_id").select("query_id", "id")
    pool = lists.select("query_id", "id", F.lit(True).alias("pooled")).distinct()
    out = wanted.join(pool, ["query_id", "id"], "left").join(fusion.rrf(lists, _WEIGHTS).select("query_id", "id", "rank"), ["query_id", "id"], "left")
    final = F.when(F.col("rank") <= 10, F.col("rank"))
    return out.select("query_id", "id", metrics.drop_stage(F.coalesce("pooled", F.lit(False)), F.col("rank"), final, 30).alias("stage"))


@query("""WITH b AS (SELECT user_id AS query_id, 1 + min(event_id % 23) AS before FROM events WHERE event_type = 'click' GROUP BY user_id),
a AS (SELECT user_id AS query_id, 1 + min(event_id % 17) AS after FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT query_id, before, after, CASE WHEN coalesce(before <= 3, false) AND coalesce(after <= 3, false) THEN 'kept' WHEN coalesce(after <= 3, false) THEN 'recovered' WHEN coalesce(before <= 3, false) THEN 'lost' ELSE 'missed' END AS change FROM b FULL JOIN a USING (query_id)""")
def a_paired_changes(spark, d):
    e = t(spark, d, "events").withColumnRenamed("user_id", "query_id")
    run = lambda kind, m: e.where(F.col("event_type") == kind).groupBy("query_id").agg((1 + F.min(F.col("event_id") % m)).alias("first_rank"))
    return metrics.paired_changes(run("click", 23), run("view", 17), 3)


@query("""WITH l AS (SELECT doc_id, quality, toxic, lang FROM labels JOIN documents USING (doc_id)),
q AS (SELECT lang, doc_id, (quality = 1 AND toxic = 0)::INT AS strict, (quality = 1)::INT AS relaxed FROM l)
SELECT coalesce(lang, 'all') AS scope, count(*) AS n, round(avg(strict), 6) AS strict, round(avg(relaxed), 6) AS relaxed FROM q GROUP BY GROUPING SETS ((lang), ())""")
def a_strict_relaxed(spark, d):
    q = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    q = q.select("lang", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("strict"), (F.col("quality") == 1).cast("int").alias("relaxed"))
    return q.rollup("lang").agg(F.count("*").alias("n"), r6(F.avg("strict")).alias("strict"), r6(F.avg("relaxed")).alias("relaxed")).select(F.coalesce("lang", F.lit("all")).alias("scope"), "n", "strict", "relaxed")


@query("SELECT coalesce(d.doc_id, v.vec_id) AS id, CASE WHEN v.vec_id IS NULL THEN 'no_vector' ELSE 'no_document' END AS gap FROM (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) d FULL JOIN embeddings v ON d.doc_id = v.vec_id WHERE d.doc_id IS NULL OR v.vec_id IS NULL")
def a_id_gaps(spark, d):
    docs, v = t(spark, d, "documents").where("doc_id % 3 <> 0").select("doc_id"), t(spark, d, "embeddings").select("vec_id")
    missing = docs.join(v, docs["doc_id"] == v["vec_id"], "left_anti").select(F.col("doc_id").alias("id"), F.lit("no_vector").alias("gap"))
    return missing.unionByName(v.join(docs, docs["doc_id"] == v["vec_id"], "left_anti").select(F.col("vec_id").alias("id"), F.lit("no_document").alias("gap")))


@query("""WITH e AS (SELECT event_id, date_trunc('hour', ts) AS h, event_type, value FROM events)
SELECT h AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY ALL""")
def a_windowed_counts(spark, d):
    return windowed_counts(t(spark, d, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


# Clarification -------------------------------------------------------------------------------------------------------

_POOL_SQL = """pool AS (SELECT p_brand AS query_id, p_partkey AS id, p_type AS kind, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_size / 10)::INT::VARCHAR END AS era, CASE WHEN p_partkey % 10 < 9 THEN 'a' ELSE 'b' END AS voice FROM part),
vals AS (SELECT query_id, id, 'kind' AS slot, kind AS value FROM pool UNION ALL SELECT query_id, id, 'era', era FROM pool UNION ALL SELECT query_id, id, 'voice', voice FROM pool),
vc AS (SELECT query_id, slot, value, count(*) AS n FROM vals GROUP BY ALL),
ms AS (SELECT query_id, slot, count(value) AS n_values, sum(CASE WHEN value IS NOT NULL THEN n ELSE 0 END) / sum(n) AS coverage,
1 - sum(CASE WHEN value IS NOT NULL THEN n * n ELSE 0 END) / pow(sum(CASE WHEN value IS NOT NULL THEN n ELSE 0 END), 2) AS discrimination FROM vc GROUP BY query_id, slot)"""


def _values(spark, d):
    # DuckDB and Spark round halves of a cast alike away from zero, so the decade is made by rounding.
    era = F.when(F.col("p_partkey") % 3 != 0, F.round(F.col("p_size") / 10).cast("int").cast("string"))
    voice = F.when(F.col("p_partkey") % 10 < 9, "a").otherwise("b")
    pool = t(spark, d, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), era.alias("era"), voice.alias("voice"))
    return clarify.slot_values(pool, ["kind", "era", "voice"])


@query(f"WITH {_POOL_SQL.replace('(p_size / 10)::INT', 'round(p_size / 10)::INT')} SELECT query_id, slot, n_values, round(coverage, 6) AS coverage, round(discrimination, 6) AS discrimination, n_values >= 2 AND coverage >= 0.6 AND discrimination >= 0.15 AS askable FROM ms")
def c_slot_measures(spark, d):
    return clarify.askable(_values(spark, d)).withColumns({"coverage": r6("coverage"), "discrimination": r6("discrimination")})


@query(f"""WITH {_POOL_SQL.replace('(p_size / 10)::INT', 'round(p_size / 10)::INT')}, f AS (SELECT query_id, arg_min(slot, CASE slot WHEN 'era' THEN 1 WHEN 'kind' THEN 2 ELSE 3 END) AS slot FROM ms WHERE n_values >= 2 AND coverage >= 0.6 AND discrimination >= 0.15 GROUP BY query_id)
SELECT f.query_id, f.slot, string_agg(value, '|' ORDER BY n DESC, value) AS options FROM f JOIN vc ON vc.query_id = f.query_id AND vc.slot = f.slot WHERE value IS NOT NULL GROUP BY f.query_id, f.slot""")
def c_questions(spark, d):
    return clarify.questions(_values(spark, d), ["era", "kind", "voice"]).select("query_id", "slot", F.array_join("options", "|").alias("options"))


@query(f"""WITH {_POOL_SQL.replace('(p_size / 10)::INT', 'round(p_size / 10)::INT')}, rk AS (SELECT p_brand AS query_id, p_partkey AS id, p_retailprice / 100000 AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part),
h AS (SELECT query_id, id, count(*) AS hits FROM vals WHERE slot = 'era' AND value = '3' OR slot = 'voice' AND value = 'b' GROUP BY ALL)
SELECT rk.query_id, rk.id, rank::INT AS rank, round(score + coalesce(hits, 0) * 3.0 / 61, 9) AS new_score, row_number() OVER (PARTITION BY rk.query_id ORDER BY score + coalesce(hits, 0) * 3.0 / 61 DESC, rank)::INT AS new_rank FROM rk LEFT JOIN h ON h.query_id = rk.query_id AND h.id = rk.id""")
def c_answer_bonus(spark, d):
    p = t(spark, d, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("id"), "p_retailprice")
    w = Window.partitionBy("query_id").orderBy(F.desc("p_retailprice"), "id")
    ranked = p.select("query_id", "id", (F.col("p_retailprice") / 100000).alias("score"), F.row_number().over(w).alias("rank"))
    said = F.explode(F.array(F.struct(F.lit("era").alias("slot"), F.lit("3").alias("answer")), F.struct(F.lit("voice").alias("slot"), F.lit("b").alias("answer")))).alias("a")
    answers = p.select("query_id").distinct().select("query_id", said).select("query_id", "a.*")
    return clarify.answer_bonus(ranked, answers, _values(spark, d)).select("query_id", "id", "rank", F.round("new_score", 9).alias("new_score"), "new_rank")


@query("""SELECT conv_id, turn, role, count(*) FILTER (role = 'user') OVER w AS user_turns, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before, sum(length(text)) OVER w AS chars_so_far
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def w_turn_progress(spark, d):
    by = Window.partitionBy("conv_id").orderBy("turn")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    return t(spark, d, "conversations").select("conv_id", "turn", "role", F.count_if(F.col("role") == "user").over(so_far).alias("user_turns"), F.coalesce(F.lag("role").over(by), F.lit("")).alias("before"), F.sum(F.length("text")).over(so_far).alias("chars_so_far"))


# Cases ---------------------------------------------------------------------------------------------------------------


def _case_events(spark, d):
    e = t(spark, d, "events")
    action = F.when(F.col("event_type") == "click", "withdraw").otherwise("submit")
    return e.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 50).alias("submission_id"), action.alias("action"), "value", F.col("ts").alias("at"))


@query("""WITH RECURSIVE f AS (SELECT user_id AS case_id, min(event_id) AS seq, event_id % 50 AS sid FROM events GROUP BY user_id, event_id % 50),
o AS (SELECT case_id, seq, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS n, event_type = 'click' AS withdraw, value, ts FROM f JOIN events ON event_id = seq),
st(case_id, n, revision, status, value, updated_at) AS (SELECT DISTINCT case_id, 0::BIGINT, 0, 'none', NULL::DOUBLE, NULL::TIMESTAMP FROM o
UNION ALL SELECT o.case_id, o.n,
 CASE WHEN withdraw AND status = 'pending' OR NOT withdraw AND revision < 20 THEN revision + 1 ELSE revision END,
 CASE WHEN withdraw AND status = 'pending' THEN 'withdrawn' WHEN NOT withdraw AND revision < 20 THEN 'pending' ELSE status END,
 CASE WHEN NOT withdraw AND revision < 20 THEN o.value ELSE st.value END,
 CASE WHEN withdraw AND status = 'pending' OR NOT withdraw AND revision < 20 THEN ts ELSE updated_at END
 FROM st JOIN o ON o.case_id = st.case_id AND o.n = st.n + 1)
SELECT st.case_id, revision, status, value, updated_at, (SELECT min(ts) FROM o WHERE o.case_id = st.case_id) AS created_at FROM st
WHERE n = (SELECT max(n) FROM o WHERE o.case_id = st.case_id)""")
def st_case_fold(spark, d):
    return cases.fold_cases(_case_events(spark, d))


@query("""WITH l AS (SELECT user_id AS case_id, max(ts) AS updated_at, arg_max(value, event_id) AS value, max(event_id) AS revision FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
SELECT case_id, revision, value, coalesce(CASE WHEN case_id % 10 <> 0 THEN updated_at + INTERVAL 30 DAY END <= now, true) AS expired FROM l, n""")
def st_latest_and_expired(spark, d):
    e = t(spark, d, "events")
    last = e.groupBy(F.col("user_id").alias("case_id")).agg(F.max("ts").alias("updated_at"), F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("revision"))
    ends = F.when(F.col("case_id") % 10 != 0, F.col("updated_at") + F.expr("INTERVAL 30 DAYS"))
    return last.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).select("case_id", "revision", "value", cases.expired(ends, F.col("now")).alias("expired"))


@query("SELECT event_id, least(3600.0, 60 * pow(2.0, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)) AS delay FROM events")
def st_retry_backoff(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return t(spark, d, "events").select("event_id", cases.retry_delay(n).alias("delay"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 4 <> 1 THEN 'pending' ELSE 'approved' END AS review FROM events""")
def st_effective_review(spark, d):
    state = F.when(F.col("event_id") % 3 != 0, "approved")
    return t(spark, d, "events").select("event_id", cases.effective_review(state, F.col("event_id") % 4, F.lit(1)).alias("review"))


@query("""WITH x AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT unnest(['view', 'click', 'purchase']) AS stage, unnest([1, 2, 3]) AS pos),
u AS (SELECT DISTINCT user_id FROM x), g AS (SELECT user_id, stage, pos, coalesce(n, 0) AS n FROM u CROSS JOIN s LEFT JOIN x USING (user_id) WHERE x.event_type = stage OR x.event_type IS NULL),
a AS (SELECT u.user_id, s.stage, s.pos, coalesce((SELECT n FROM x WHERE x.user_id = u.user_id AND x.event_type = s.stage), 0) AS n FROM u CROSS JOIN s)
SELECT user_id, coalesce(arg_min(CASE WHEN n >= 3 THEN 'exhausted' ELSE stage END, pos) FILTER (n % 2 = 0), 'complete') AS next FROM a GROUP BY user_id""")
def st_next_stage(spark, d):
    """A stage is done after an odd number of tries here."""
    n = t(spark, d, "events").groupBy("user_id", "event_type").count()
    by = n.groupBy("user_id").agg(F.collect_list(F.when(F.col("count") % 2 == 1, F.col("event_type"))).alias("done"), F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("tries"))
    return by.select("user_id", cases.next_stage(F.col("done"), F.col("tries"), ["view", "click", "purchase"]).alias("next"))


@query("""WITH a AS (SELECT s_suppkey AS id, s_nationkey AS wanted FROM supplier WHERE s_suppkey % 5 <> 0), b AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN -1 ELSE s_nationkey END AS found FROM supplier WHERE s_suppkey % 6 <> 0)
SELECT id, wanted, found, CASE WHEN found IS NULL THEN 'missing' WHEN wanted IS NULL THEN 'orphan' ELSE 'stale' END AS state FROM a FULL JOIN b USING (id) WHERE wanted IS DISTINCT FROM found""")
def j_reconcile(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("version"))
    return cases.reconcile(s.where("id % 5 <> 0"), s.where("id % 6 <> 0").withColumn("version", F.when(F.col("id") % 7 == 0, F.lit(-1)).otherwise(F.col("version"))), "id", "version")


# Joins, windows, sets -------------------------------------------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.05)")
def j_semi_anti(spark, d):
    p, line = t(spark, d, "part").select("p_partkey"), t(spark, d, "lineitem")
    big = line.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return p.join(big, "p_partkey", "left_anti").join(line.where("l_discount > 0.05").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")


@query("""WITH p AS (SELECT p_partkey, lower(regexp_replace(p_name, '\\s+', '', 'g')) AS key, p_brand FROM part)
SELECT a.p_partkey AS a, min(b.p_partkey) AS b FROM p a JOIN p b ON a.key = b.key AND a.p_brand = b.p_brand AND b.p_partkey < a.p_partkey GROUP BY a.p_partkey""")
def j_entity_match(spark, d):
    """Equal title keys and brands: the first earlier match, by one window instead of a self join."""
    w = Window.partitionBy(T.equality_key(F.col("p_name")), "p_brand")
    return t(spark, d, "part").select(F.col("p_partkey").alias("a"), F.min("p_partkey").over(w).alias("b")).where("a <> b")


@query("""WITH o AS (SELECT c_nationkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F')
SELECT c_nationkey, n_name, o_orderkey, rank::INT AS rank FROM o JOIN nation ON n_nationkey = c_nationkey WHERE rank <= 20""")
def w_group_cap(spark, d):
    o = t(spark, d, "orders").where("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey", "o_totalprice").join(t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    capped = o.withColumn("rank", F.row_number().over(w)).where("rank <= 20")
    return capped.join(t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").select("c_nationkey", "n_name", "o_orderkey", "rank")


@query("""WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS a, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice + CASE WHEN p_size > 40 THEN 200 ELSE 0 END DESC, p_partkey) AS b FROM part)
SELECT p_partkey, (a - b)::INT AS moved FROM r""")
def w_rank_delta(spark, d):
    by = lambda c: F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc(c), "p_partkey"))
    return t(spark, d, "part").select("p_partkey", (by(F.col("p_retailprice")) - by(F.col("p_retailprice") + F.when(F.col("p_size") > 40, 200).otherwise(0))).alias("moved"))


@query("""WITH h AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS history FROM h WHERE n <= 20 GROUP BY user_id""")
def w_last_history(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    last = t(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("n")).where("n <= 20")
    return last.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("event_id")).cast("array<string>"), ",").alias("history"))


@query(f"""WITH {_RRF_SQL}, a AS (SELECT query_id, id FROM f WHERE rank <= 10), b AS (SELECT query_id, id FROM lists WHERE path = 'dense' AND rank <= 10)
SELECT query_id, id, 'entered' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT query_id, id, 'displaced' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT query_id, id, 'stayed' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def u_set_changes(spark, d):
    lists = _lists(spark, d)
    a, b = fusion.rrf(lists, _WEIGHTS, 10).select("query_id", "id"), lists.where("path = 'dense' AND rank <= 10").select("query_id", "id")
    tag = lambda df, x: df.withColumn("change", F.lit(x))
    return tag(a.subtract(b), "entered").unionByName(tag(b.subtract(a), "displaced")).unionByName(tag(a.intersect(b), "stayed"))


@query("""WITH p AS (SELECT p_partkey, p_brand, lower(regexp_replace(p_name, '\\s+', '', 'g')) AS key, p_size, p_retailprice FROM part),
r AS (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN 'existing' WHEN p_size < 3 THEN 'variant' WHEN min(p_partkey) OVER (PARTITION BY p_brand, key) < p_partkey THEN 'duplicate' END AS reason FROM p),
k AS (SELECT p_partkey, reason, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY p_brand, reason IS NULL ORDER BY p_retailprice DESC, p_partkey) END AS n FROM r)
SELECT p_partkey, coalesce(reason, CASE WHEN n <= 20 THEN 'accepted' ELSE 'cap' END) AS reason FROM k""")
def m_assembly_reasons(spark, d):
    first = F.min("p_partkey").over(Window.partitionBy("p_brand", T.equality_key(F.col("p_name"))))
    reason = F.when(F.col("p_partkey") % 11 == 0, "existing").when(F.col("p_size") < 3, "variant").when(first < F.col("p_partkey"), "duplicate")
    rows = t(spark, d, "part").withColumn("reason", reason)
    n = F.row_number().over(Window.partitionBy("p_brand", F.col("reason").isNull()).orderBy(F.desc("p_retailprice"), "p_partkey"))
    return rows.withColumn("n", n).select("p_partkey", F.coalesce("reason", F.when(F.col("n") <= 20, "accepted").otherwise("cap")).alias("reason"))


@query("""WITH h AS (SELECT user_id AS id, event_id FROM events), s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR), doc_id) AS n FROM documents) SELECT doc_id, lang FROM s WHERE n <= 10""")
def m_stratified_pick(spark, d):
    """Ten documents of each language by the order of their ids' digests."""
    w = Window.partitionBy("lang").orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id")
    return t(spark, d, "documents").select("doc_id", "lang", F.row_number().over(w).alias("n")).where("n <= 10").select("doc_id", "lang")


# Text ----------------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || ' (live 2)' WHEN 1 THEN '사랑 愛' WHEN 2 THEN 'na na NA' WHEN 3 THEN '(intro)' ELSE p_partkey::VARCHAR END AS title FROM part),
b AS (SELECT *, CASE WHEN trim(regexp_extract(title, '^([^(\\[]*)', 1)) = '' THEN title ELSE trim(regexp_extract(title, '^([^(\\[]*)', 1)) END AS base FROM p),
f AS (SELECT *, regexp_replace(base, '[^A-Za-z0-9가-힣一-鿿]', '', 'g') AS letters, regexp_extract_all(lower(base), '[A-Za-z0-9가-힣一-鿿]+') AS words FROM b),
k AS (SELECT *, regexp_matches(letters, '[A-Za-z]') AS l, regexp_matches(letters, '[가-힣]') AS h, regexp_matches(letters, '[一-鿿]') AS c, regexp_matches(letters, '[0-9]') AS n FROM f)
SELECT p_partkey, base, CASE WHEN l::INT + h::INT + c::INT + n::INT > 1 THEN 'mixed' WHEN l THEN 'latin' WHEN h THEN 'hangul' WHEN c THEN 'hanja' WHEN n THEN 'numeric' END AS script,
nullif(length(letters), 0)::INT AS char_count, nullif(len(words), 0)::INT AS word_count, n AS contains_number,
length(letters) >= 2 AND len(list_distinct(string_split(lower(letters), ''))) = 1 AS repeated_char, len(words) >= 2 AND len(list_distinct(words)) = 1 AS repeated_word,
regexp_matches(title, '[A-Za-z]') AS latin_anywhere, regexp_matches(title, '[가-힣]') AS hangul_anywhere, regexp_matches(title, '[一-鿿]') AS hanja_anywhere, regexp_matches(title, '[0-9]') AS number_anywhere FROM k""")
def t_title_features(spark, d):
    m, key = F.col("p_partkey") % 5, F.col("p_partkey").cast("string")
    title = F.when(m == 0, F.concat("p_name", F.lit(" (live 2)"))).when(m == 1, "사랑 愛").when(m == 2, "na na NA").when(m == 3, "(intro)").otherwise(key)
    return t(spark, d, "part").select("p_partkey", T.title_features(title).alias("f")).select("p_partkey", "f.*")


@query("""WITH f AS (SELECT p_partkey, len(regexp_extract_all(p_name, '[A-Za-z0-9]+')) AS n_words, length(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS n_chars FROM part)
SELECT p_partkey, round(CASE WHEN p_partkey % 4 = 0 THEN (n_words = 2)::INT ELSE ((n_words = 2)::INT + (n_chars = 9)::INT) / 2 END, 6) AS ratio FROM f""")
def t_match_ratio(spark, d):
    f = T.title_features(F.col("p_name"))
    wanted = F.when(F.col("p_partkey") % 4 != 0, F.lit(9))
    return t(spark, d, "part").select("p_partkey", r6(T.match_ratio((F.lit(2), f["word_count"]), (wanted, f["char_count"]))).alias("ratio"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y.%m.%d') AS day, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y.%m') ELSE strftime(o_orderdate, '%Y') END AS part FROM orders""")
def t_date_keys(spark, d):
    o = t(spark, d, "orders")
    loose = F.concat_ws("-", F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"))
    part = F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws(" / ", F.year("o_orderdate"), F.month("o_orderdate"))).otherwise(F.year("o_orderdate").cast("string"))
    return o.select("o_orderkey", T.date_key(loose).alias("day"), T.date_key(part).alias("part"))


@query("""SELECT p_partkey, 'passage: Title: ' || p_name || chr(10) || 'Brand: ' || p_brand || CASE WHEN p_size > 10 THEN chr(10) || 'Type: ' || p_type ELSE '' END AS passage FROM part""")
def t_passages(spark, d):
    fields = [("Title", F.col("p_name")), ("Brand", F.col("p_brand")), ("Note", F.lit("  ")), ("Type", F.when(F.col("p_size") > 10, F.col("p_type")))]
    return t(spark, d, "part").select("p_partkey", T.labelled_passage("passage", fields).alias("passage"))


@query("""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(text, '[.!?]+[\\s]+|\\n+'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS s FROM documents)
SELECT doc_id, count(*) AS n_sentences, max(length(s)) AS longest, count(*) FILTER (length(s) BETWEEN 12 AND 400) AS fit FROM s GROUP BY doc_id""")
def t_sentences(spark, d):
    s = t(spark, d, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.length("s")).alias("longest"), F.count_if(F.length("s").between(12, 400)).alias("fit"))


@query("""WITH b AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN 'and ' || text || ' (' WHEN 2 THEN 'Short' ELSE substr(text, 1, 50) || ',' END AS text FROM benchmark)
SELECT item_id, array_to_string(list_filter([CASE WHEN length(text) NOT BETWEEN 12 AND 400 THEN 'length' END,
CASE WHEN length(text) - length(replace(text, '(', '')) <> length(text) - length(replace(text, ')', '')) OR length(text) - length(replace(text, '[', '')) <> length(text) - length(replace(text, ']', '')) OR (length(text) - length(replace(text, '"', ''))) % 2 <> 0 THEN 'unbalanced' END,
CASE WHEN regexp_matches(lower(text), '^(and|but|because|which|that)\\b') THEN 'dependent_start' END, CASE WHEN regexp_matches(text, '[,:;(]$') THEN 'incomplete' END,
CASE WHEN lower(text) = 'short' THEN 'title_only' END], lambda x: x IS NOT NULL), ',') AS issues FROM b""")
def t_fact_issues(spark, d):
    m = F.col("item_id") % 4
    text = F.when(m == 0, F.col("text")).when(m == 1, F.concat(F.lit("and "), "text", F.lit(" ("))).when(m == 2, "Short").otherwise(F.concat(F.substring("text", 1, 50), F.lit(",")))
    return t(spark, d, "benchmark").select("item_id", F.array_join(T.fact_issues(text, F.lit("sh ort")), ",").alias("issues"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'steel|tin') THEN 'metal' WHEN regexp_matches(lower(p_type), 'brass') THEN 'alloy' ELSE 'other' END AS category FROM part""")
def t_classify(spark, d):
    return t(spark, d, "part").select("p_partkey", T.classify(F.col("p_type"), [("metal", "steel|tin"), ("alloy", "brass")]).alias("category"))


@query("""WITH p AS (SELECT page_id, regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g') AS h FROM pages), q AS (SELECT page_id, regexp_replace(h, '<[^>]*>', ' ', 'g') AS h FROM p)
SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g'), ' ')) AS text_sha256 FROM q""")
def t_strip_tags(spark, d):
    return t(spark, d, "pages").select("page_id", F.sha2(T.strip_tags(F.col("html")), 256).alias("text_sha256"))


@query("""SELECT page_id, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS n_links, coalesce(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title FROM pages""")
def t_links(spark, d):
    return t(spark, d, "pages").select("page_id", F.size(T.links(F.col("html"))).alias("n_links"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"))


@query("""WITH c AS (SELECT conv_id, turn, text || CASE turn WHEN 0 THEN ' #Rain #night #rain' WHEN 1 THEN ' see https://x.y' ELSE '' END AS text FROM conversations)
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '#([\\p{L}\\p{N}_]+)', 1), lambda x: lower(x)))), ',') AS tags,
length(trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), ' ')) BETWEEN 8 AND 199 AND NOT regexp_matches(text, '(?i)subscribe|https?://|www\\.') AS ok FROM c""")
def t_comments(spark, d):
    c = t(spark, d, "conversations")
    text = F.concat("text", F.when(F.col("turn") == 0, " #Rain #night #rain").when(F.col("turn") == 1, " see https://x.y").otherwise(""))
    return c.select("conv_id", "turn", F.array_join(F.array_sort(T.hashtags(text)), ",").alias("tags"), T.comment_ok(text).alias("ok"))


@query("""WITH e AS (SELECT o_orderkey, year(o_orderdate) AS y, o_orderkey % 4 AS m FROM orders)
SELECT o_orderkey, CASE m WHEN 0 THEN y WHEN 1 THEN y // 10 * 10 WHEN 2 THEN y // 10 * 10 + 7 END::INT AS start, CASE m WHEN 0 THEN y WHEN 1 THEN y // 10 * 10 + 9 WHEN 2 THEN y // 10 * 10 + 9 END::INT AS "end",
CASE m WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.9 END AS confidence FROM e""")
def t_era_windows(spark, d):
    y, m = F.year("o_orderdate").cast("string"), F.col("o_orderkey") % 4
    said = F.when(m == 0, F.concat(F.lit("sung in "), y)).when(m == 1, F.concat(F.lit("a "), F.substring(y, 1, 3), F.lit("0s song"))).when(m == 2, F.concat(F.lit("from the late "), F.substring(y, 3, 1), F.lit("0s"))).otherwise("who knows")
    return t(spark, d, "orders").select("o_orderkey", T.era_window(said).alias("w")).select("o_orderkey", "w.start", "w.end", "w.confidence")


@query("SELECT c_custkey, greatest(1900, 1890 + c_custkey % 200 + 12) AS start, least(2100, 1890 + c_custkey % 200 + 20) AS \"end\" FROM customer")
def t_birth_windows(spark, d):
    return t(spark, d, "customer").select("c_custkey", T.birth_window(1890 + F.col("c_custkey") % 200, 13, 19).alias("w")).select("c_custkey", "w.*")


@query("SELECT p_partkey, sha256(p_partkey::VARCHAR || chr(31) || p_name || chr(31) || CASE WHEN p_size > 25 THEN chr(0) ELSE p_brand END) AS digest FROM part")
def t_digests(spark, d):
    return t(spark, d, "part").select("p_partkey", T.digest(F.col("p_partkey"), F.col("p_name"), F.when(F.col("p_size") <= 25, F.col("p_brand"))).alias("digest"))


@query("""WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda x: length(x) >= 2 AND x NOT IN ('the', 'of', 'and'))) AS w FROM benchmark)
SELECT item_id, len(w) AS n_words, array_to_string(list_sort(w), ' ') AS words FROM w""")
def x_content_words(spark, d):
    words = T.content_words(F.col("text"), ["the", "of", "and"])
    return t(spark, d, "benchmark").select("item_id", F.size(words).alias("n_words"), F.array_join(F.array_sort(words), " ").alias("words"))


@query("""SELECT doc_id, reason FROM (SELECT doc_id, unnest([CASE WHEN n_chars <> length(text) THEN 'length' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'lang' END, CASE WHEN length(text) < 100 THEN 'short' END, CASE WHEN source = 'src0' THEN 'source' END]) AS reason FROM documents) WHERE reason IS NOT NULL""")
def t_validation_issues(spark, d):
    rules = {"length": F.col("n_chars") != F.length("text"), "lang": ~F.col("lang").isin("en", "de"), "short": F.length("text") < 100, "source": F.col("source") == "src0"}
    return T.issues(t(spark, d, "documents"), "doc_id", rules)


@query("""SELECT event_id, CASE WHEN v >= 100000000 THEN 'legend' WHEN v >= 10000000 THEN 'hit' WHEN v >= 1000000 THEN 'known' ELSE 'quiet' END AS tag FROM (SELECT event_id, event_id * 40009 AS v FROM events)""")
def t_popularity(spark, d):
    return t(spark, d, "events").select("event_id", T.popularity(F.col("event_id") * 40009).alias("tag"))


@query("""WITH v(slot, word) AS (VALUES ('sad', 'the'), ('sad', 'of'), ('glad', 'and'), ('calm', 'in')), w AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents),
c AS (SELECT doc_id, slot, count(*) AS n FROM w JOIN v USING (word) GROUP BY ALL) SELECT doc_id, slot, n AS evidence FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, slot) = 1""")
def t_vocabulary(spark, d):
    v = spark.createDataFrame([("sad", "the"), ("sad", "of"), ("glad", "and"), ("calm", "in")], "slot string, word string")
    w = t(spark, d, "documents").select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("word")).join(F.broadcast(v), "word").groupBy("doc_id", "slot").agg(F.count("*").alias("evidence"))
    return w.groupBy("doc_id").agg(F.min_by(F.struct("slot", "evidence"), F.struct(-F.col("evidence"), F.col("slot"))).alias("b")).select("doc_id", "b.*")


@query("""SELECT event_id, user_id, json_extract(props, '$.k')::INT AS k FROM events""")
def t_json_path(spark, d):
    return t(spark, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""WITH h AS (SELECT event_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('x' || event_id)) AS h FROM events)
SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN (event_id * 1000003)::VARCHAR ELSE substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
['8', '9', 'a', 'b'][1 + ('0x' || substr(h, 17, 1))::INT % 4] || substr(h, 18, 3) || '-' || substr(h, 21, 12) END AS point FROM h""")
def x_point_ids(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), "event_id")).otherwise((F.col("event_id") * 1000003).cast("string"))
    return t(spark, d, "events").select("event_id", T.point_id(raw).alias("point"))
