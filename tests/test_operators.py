"""Semantics that the tables don't show: nulls, ties, errors, stores and streams."""

import datetime
import json
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftsonde.functions import text as T
from driftsonde.operators import bm25, cases, filters, fusion, metrics, search, surface
from driftsonde.sources import records
from driftsonde.streaming.cases import case_states, windowed_counts


def test_filter_semantics(spark):
    df = spark.createDataFrame([(1, "a", ["x", "y"], 5), (2, None, None, None), (3, "b b", ["z"], 7)], "id int, s string, tags array<string>, n int")
    ids = lambda spec: sorted(r["id"] for r in df.where(filters.compile_filter(df, spec)).collect())
    assert ids({"s": "a"}) == [1]
    assert ids({"s": {"$ne": "a"}}) == [2, 3]
    assert ids({"s": {"$nin": ["a"]}}) == [3]
    assert ids({"tags": "x"}) == [1] and ids({"tags": {"$in": ["y", "z"]}}) == [1, 3] and ids({"tags": {"$ne": "x"}}) == [2, 3]
    assert ids({"n": {"$gt": 5, "$lte": 7}}) == [3]
    assert ids({"s": {"$text": "B"}}) == [3]
    assert ids({"$or": [{"s": "a"}, {"n": 7}], "$not": {"id": 1}}) == [3]
    assert ids({"$and": [{"s": "a"}, {"n": 5}]}) == [1]
    assert ids({}) == [1, 2, 3]
    for bad in ({"s": {"$regex": "a"}}, {"$nor": []}):
        with pytest.raises(ValueError, match="unknown operator"):
            filters.compile_filter(df, bad)


def test_rrf_ties_go_to_the_earlier_path(spark):
    rows = [(1, "a", 10, 1), (1, "b", 20, 1), (1, "c", 30, 1)]
    ranked = spark.createDataFrame(rows, "query_id int, path string, id int, rank int")
    out = fusion.rrf(ranked, {"b": 1.0, "a": 1.0, "c": 0.0}).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in out] == [(20, 1 / 61), (10, 1 / 61)]
    total = fusion.contributions(ranked, {"b": 1.0, "a": 1.0, "c": 0.0}).groupBy("id").agg(F.sum("delta")).collect()
    assert {tuple(r) for r in total} == {(20, 1 / 61), (10, 1 / 61)}


def test_bm25_golden_weights(spark):
    docs = spark.createDataFrame([(1, "x x c"), (2, "c y")], "id int, text string")
    posts, stats = bm25.postings(docs, "id", "text"), bm25.fit(docs, "id", "text")
    w = posts.crossJoin(stats).select("id", "term", bm25.weight(F.col("tf"), F.col("dl"), F.col("avgdl")).alias("w")).collect()
    assert {(r["id"], r["term"]): r["w"] for r in w}[1, "x"] == pytest.approx(2 / (1.2 * (0.25 + 0.75 * 3 / 2.5) + 2))
    q = bm25.query_weights(spark.createDataFrame([(1, "x c unseen x")], "id int, text string"), "id", "text", bm25.document_frequency(posts), stats).collect()
    import math

    raw = {"x": math.log(3 / 1.5), "c": math.log(3 / 2.5), "unseen": math.log(3 / 1.5)}
    assert {r["term"]: r["qw"] for r in q} == pytest.approx({k: v / sum(raw.values()) for k, v in raw.items()})


def test_hybrid_keeps_negative_scores_and_missing_sides(spark):
    dense = spark.createDataFrame([(1, 1, -0.5), (1, 2, 0.2)], "query_id int, id int, score double")
    sparse = spark.createDataFrame([(1, 2, 1.0), (1, 3, 0.4)], "query_id int, id int, score double")
    assert {r["id"]: r["score"] for r in search.hybrid_sum(dense, sparse, 0.5).collect()} == pytest.approx({1: -0.25, 2: 0.6, 3: 0.2})


def test_query_sets_are_bounded(spark):
    v = spark.createDataFrame([(i, [1.0]) for i in range(5)], "id int, vector array<double>")
    q = v.select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    with pytest.raises(Exception, match="more than 3 queries"):
        search.dense_scores(q, v, most_queries=3).collect()


def test_zero_vectors_and_groups(spark):
    v = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in v.select(search.normalise(F.col("v"))).collect()] == [[0.0, 0.0], [0.6, 0.8]]
    rows = spark.createDataFrame([(1, "g", 2, 0.5), (1, "g", 1, 0.5), (1, "h", 3, float("nan")), (1, "i", 4, 0.1)], "query_id int, grp string, id int, score double")
    assert [(r["grp"], r["id"]) for r in search.best_per_group(rows, "grp", 5).orderBy("rank").collect()] == [("g", 1), ("i", 4)]


def test_fuzzy_scores(spark):
    rows = spark.createDataFrame([("abcdefgh", "xxabcdefghyy"), ("abcdefgh", "abcdexgh"), ("abcd", "abcd"), ("abcdefgh", "zzz")], "p string, t string")
    got = [r[0] for r in rows.select(surface.fuzzy_score(F.col("p"), F.col("t"), 0.3, 0.4)).collect()]
    assert got == pytest.approx([1.0, 0.65 * 3 / 6 + 0.35 * 5 / 8, 0.0, 0.0])
    assert surface.mentions(spark.createDataFrame([(1, "I love Blue Moon. Bluer moons!")], "id int, text string"), spark.createDataFrame([(7, "blue moon"), (8, "blue")], "name_id int, name string")).orderBy("name_id").collect() == [(7, 1, "I love Blue Moon"), (8, 1, "I love Blue Moon")]


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([([1, 2], [], [2]), ([3, 1], [1], [])], "r array<int>, p array<int>, n array<int>")
    r, p, n = F.col("r"), F.col("p"), F.col("n")
    got = df.select(metrics.recall_at(r, p, 2), metrics.ndcg_at(r, p, 2), metrics.reciprocal_rank(r, p), metrics.mean_negative_rank(r, n)).collect()
    assert tuple(got[0]) == (0.0, 0.0, 0.0, 2.0)
    assert tuple(got[1])[:3] == pytest.approx((1.0, 0.6309297535714575, 0.5)) and got[1][3] is None


def test_case_fold_replays_and_limits(spark):
    at = datetime.datetime(2024, 1, 1)
    events = [(1, s, s, "submit", float(s), at) for s in range(25)] + [(1, 30, 3, "submit", 9.0, at), (1, 31, 31, "withdraw", 0.0, at), (1, 32, 32, "withdraw", 0.0, at), (2, 1, 1, "withdraw", 0.0, at)]
    df = spark.createDataFrame(events, "case_id int, seq int, submission_id int, action string, value double, at timestamp_ntz")
    got = {r["case_id"]: r for r in cases.fold_cases(df).collect()}
    assert (got[1]["revision"], got[1]["status"], got[1]["value"]) == (21, "withdrawn", 19.0)
    assert (got[2]["revision"], got[2]["status"]) == (0, "none")


def test_text_functions(spark):
    row = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert row(T.era_window(F.lit("early 90s"))) == (1990, 1993, 0.9)
    assert row(T.era_window(F.lit("nothing"))) is None
    assert row(T.date_key(F.lit("2001년 3월 9일"))) == "2001.03.09"
    assert row(T.base_title(F.lit("(Intro)"))) == "(Intro)"
    for text in ("18446744073709551616", "x1", "²", ""):
        assert row(T.point_id(F.lit(text))) == str(uuid.uuid5(uuid.NAMESPACE_URL, text))
    assert row(T.point_id(F.lit(" 18446744073709551615"))) == "18446744073709551615"
    assert row(T.labelled_passage("passage", [("A", F.lit(None).cast("string"))])) == "passage: EMPTY"
    assert row(T.clean_fact(F.lit("a [1]  b ,c"))) == "a b,c"
    assert row(T.listed(F.lit(" a, b,,a"))) == ["a", "b"]


def test_record_stores(spark, tmp_path):
    schema = StructType.fromDDL("id string, title string")
    (tmp_path / "r.jsonl").write_text('{"id": "1", "title": "a"}\n\nbroken\n{"id": "1", "title": "b"}\n{"id": "2"}\n')
    assert {tuple(r) for r in records.read_jsonl(spark, str(tmp_path / "r.jsonl"), schema, "id").collect()} == {("1", "b"), ("2", None)}
    (tmp_path / "tree/x").mkdir(parents=True)
    (tmp_path / "tree/x/meta.json").write_text('{"id": "7",\n "title": "t"}')
    (tmp_path / "tree/other.json").write_text('{"id": "8"}')
    assert records.read_json_tree(spark, str(tmp_path / "tree"), schema).collect() == [("7", "t")]
    (tmp_path / "m.json").write_text(json.dumps({"1": {"title": "a"}, "2": {"title": "b"}}))
    assert {tuple(r) for r in records.read_json_map(spark, str(tmp_path / "m.json"), StructType.fromDDL("title string")).collect()} == {("1", "a"), ("2", "b")}
    (tmp_path / "c.csv").write_bytes(b"\xef\xbb\xbfid,title\n1,a\n")
    assert records.read_csv(spark, str(tmp_path / "c.csv"), schema).collect() == [("1", "a")]
    base = spark.createDataFrame([("1", "a"), ("2", "b")], schema)
    records.publish(base, str(tmp_path / "store"), "id")
    records.publish(records.upsert(base, spark.createDataFrame([("2", "c")], schema), ["id"]), str(tmp_path / "store"), "id")
    assert {tuple(r) for r in records.current(spark, str(tmp_path / "store")).collect()} == {("1", "a"), ("2", "c")}
    with pytest.raises(ValueError, match="twice"):
        records.publish(base.union(base), str(tmp_path / "store"), "id")


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(1, 1, "submit", 2.0, datetime.datetime(2024, 1, 1, 0, 10)), (1, 2, "withdraw", 0.0, datetime.datetime(2024, 1, 1, 1, 5)), (2, 1, "submit", 5.0, datetime.datetime(2024, 1, 1, 0, 20))]
    batch = spark.createDataFrame(rows, "case_id long, seq long, action string, value double, ts timestamp")
    batch.write.parquet(str(source))
    stream = spark.readStream.schema(batch.schema).parquet(str(source))
    q = case_states(stream).writeStream.outputMode("update").format("memory").queryName("cases").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("cases").collect()} == {(1, 2, "withdrawn", 2.0), (2, 1, "pending", 5.0)}
    again = [(1, s, sid, a, v, datetime.datetime(2024, 1, 1, 0, s)) for s, sid, a, v in [(1, 7, "submit", 2.0), (2, 7, "submit", 3.0), (3, 8, "submit", 4.0)]]
    spark.createDataFrame(again, "case_id long, seq long, submission_id long, action string, value double, ts timestamp").write.parquet(str(tmp_path / "again"))
    replayed = spark.readStream.schema(spark.read.parquet(str(tmp_path / "again")).schema).parquet(str(tmp_path / "again"))
    q = case_states(replayed).writeStream.outputMode("update").format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "ck3")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("replayed").collect()] == [(1, 2, "pending", 4.0)]
    counts = windowed_counts(stream.withColumnRenamed("action", "event_type")).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert sorted((r["event_type"], r["n"], r["total"]) for r in spark.table("counts").collect()) == [("submit", 2, 7.0), ("withdraw", 1, 0.0)]
