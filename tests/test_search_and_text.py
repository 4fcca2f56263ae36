"""Searches, filters, texts, stores and dialogues against plain Python on small tables."""

import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftsonde.functions import linking, segments, unicode
from driftsonde.operators import bm25, boosts, clarify, explain, filters, ledgers, metrics, paths, retrieval, reviews, search, surface, works
from driftsonde.plans import catalogue
from driftsonde.sources import records


def test_dense_scores_take_any_number_of_queries(spark):
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id bigint, vector array<double>")
    got = search.dense_scores(table.selectExpr("id as query_id", "vector as query"), table, block=7)
    assert {(r["query_id"], r["id"]): r["score"] for r in got.collect()} == {(a, b): a * b + 1.0 for a in range(50) for b in range(50) if a != b}
    assert got.count() == 50 * 49


def test_embedding_plan_hashes_the_whole_vector(spark, tmp_path, monkeypatch):
    rows = [(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [1.0, 2.0, 3.0, 4.0, 6.0])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    catalogue.queries()
    from driftsonde.plans import catalogue_more

    seen = []
    monkeypatch.setattr(catalogue_more.linkage, "reuse_plan", lambda wanted, *rest: seen.append(wanted))
    catalogue_more.m_embedding_plan(spark, str(tmp_path))
    assert len({r["key"] for r in seen[0].collect()}) == 2


def vectors(n=120, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[10:16] = x[10]
    return [(i, v.tolist(), f"g{i % 3}") for i, v in enumerate(x)] + [(500, None, "g0"), (501, [1.0] * 3, "g1"), (502, [0.0] * dim, "g2")]


@pytest.mark.parametrize("measure", ["dot", "cosine"])
def test_dense_topk_equals_brute_force(spark, measure):
    rows = vectors()
    table = spark.createDataFrame(rows, "id bigint, vector array<double>, grp string")
    asked = table.where("id % 20 = 0").selectExpr("id as query_id", "vector as query")
    own = {i: np.array(v) for i, v, _ in rows if v and len(v) == 6}
    if measure == "cosine":
        own = {i: v / np.linalg.norm(v) for i, v in own.items() if np.linalg.norm(v)}
    group = {i: g for i, _, g in rows}
    for options in ({}, {"least": 0.2}, {"by": "grp"}):
        got = search.dense_topk(asked, table, 4, measure, block=2, strips=3, **options).collect()
        want = set()
        for q in (i for i in own if i % 20 == 0 and i < 500):
            scored = sorted(((round(float(own[q] @ own[c]), 9), c) for c in own if c != q and own[q] @ own[c] >= options.get("least", -9e9)), key=lambda x: (-x[0], x[1]))
            for part in ("g0", "g1", "g2") if "by" in options else (None,):
                want |= {(q, c, r) for r, (_, c) in enumerate([x for x in scored if part in (None, group[x[1]])][:4], 1)}
        assert {(r["query_id"], r["id"], r["rank"]) for r in got if r["query_id"] < 500} == want


def test_hybrid_topk_equals_the_full_sum(spark):
    rnd = random.Random(3)
    rows = vectors(60)[:60]
    table = spark.createDataFrame([(i, v) for i, v, _ in rows], "id bigint, vector array<double>")
    asked = [(q, rows[q][1], [0.2, 0.6, 0.9][q % 3]) for q in range(8)] + [(99, None, 0.5)]
    sparse = [(q, i, rnd.random()) for q in [*range(8), 99] for i in rnd.sample(range(80), 40)]
    got = search.hybrid_topk(spark.createDataFrame(asked, "query_id bigint, query array<double>, a double"), table, spark.createDataFrame(sparse, "query_id bigint, id bigint, score double"), "a", 7)
    by = {}
    for r in got.collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["id"], round(r["score"], 9)))
    for q, v, a in asked:
        total = {}
        for i, w, _ in rows:
            if v and i != q:
                total[i] = a * float(np.dot(v, w))
        for p, i, s in sparse:
            if p == q:
                total[i] = total.get(i, 0) + (1 - a) * s
        want = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:7]
        assert [(i, s) for _, i, s in sorted(by[q])] == [(i, round(s, 9)) for i, s in want]


def test_queries_without_terms_take_dense_scores_as_they_are(spark):
    d = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.5)], "query_id int, id int, score double")
    s = spark.createDataFrame([(1, 1, 1.0)], "query_id int, id int, score double")
    q = spark.createDataFrame([(1, True), (2, False)], "query_id int, has_terms boolean")
    assert {(r["query_id"], r["score"]) for r in search.hybrid_search(d, s, q, 0.4).collect()} == {(1, 0.4 * 0.5 + 0.6), (2, 0.5)}


def test_bm25_search_equals_its_parts_and_refuses_an_empty_corpus(spark):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "b d"), (3, ""), (4, None), (5, "e e e")], "id int, text string")
    asked = spark.createDataFrame([(7, "b x"), (8, "e"), (9, "")], "query_id int, text string")
    posts, stats = bm25.postings(docs, "id", "text"), bm25.fit(docs, "id", "text")
    want = bm25.scores(posts, bm25.query_weights(asked, "query_id", "text", bm25.document_frequency(posts), stats), stats)
    key = lambda df: sorted((r["query_id"], r["id"], round(r["score"], 12)) for r in df.collect())
    assert key(bm25.search(asked, docs)) == key(want) == key(bm25.search(asked, docs, most_terms=1))
    with pytest.raises(Exception, match="without any term"):
        bm25.search(asked, docs.where("id = 3")).collect()


def test_filters_reach_the_scan_and_empty_branches_add_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "a", 5), (2, None, None), (3, "b", 7)], "id int, s string, n int").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    ids = lambda spec: sorted(r["id"] for r in df.where(filters.compile_filter(df, spec)).collect())
    assert ids({"$or": []}) == ids({"$and": []}) == ids({"$or": [{}, {"s": "a"}]}) == ids(None) == [1, 2, 3]
    assert ids({"$not": {"s": "a", "n": 7}}) == [2] and ids({"$not": {"$or": [{"s": "a"}, {"n": 7}]}}) == [2]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = df.where(filters.compile_filter(df, {"n": {"$gte": 5}, "s": {"$ne": "b"}, "$or": [{"id": 1}, {"id": 2}]}))._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan)[1]
    assert "GreaterThanOrEqual(n,5)" in pushed and "Or(EqualTo(id,1),EqualTo(id,2))" in pushed and "Not(EqualTo(s,b))" in pushed.replace("EqualNullSafe", "EqualTo")
    flags = [tuple(r) for r in df.select(filters.passes(df, {"n": {"$gt": 5}}), filters.passes(df, {"s": {"$ne": "a"}})).collect()]
    assert sorted(flags) == [(False, False), (False, True), (True, True)]


def test_filter_builders():
    assert filters.attribute_filter({"era": (1990, 2005), "voice": "여성"}) is None  # too wide
    assert filters.attribute_filter({"era": (1999, 2000)}) is None and filters.attribute_filter({"era": (1999, 2000)}, "two_axes") is not None
    got = filters.attribute_filter({"era": (1999, 2000), "voice": "혼성", "genre": "랩", "artist_types": ["듀오"]})
    assert got == {"$and": [{"$or": [{"release_date": {"$text": "1999"}}, {"release_date": {"$text": "2000"}}]}, {"vocal_gender": {"$eq": "혼성"}}, {"genre": {"$in": ["랩/힙합"]}}, {"type": {"$in": ["듀엣", "듀오"]}}]}
    assert filters.genre_axis({"voice": "여성"}, None, "conditional") == (False, "gender_condition")
    assert filters.genre_axis({"voice": "여성"}, "발라드", "conditional") == (True, "answered_genre")
    assert filters.performance_filter("duet", ["남성랩", "여성노래"]) and not filters.performance_filter("duet", ["남성노래", "여성노래"])
    assert filters.title_filter({"script": "latin"}) == {"title_script": {"$eq": "latin"}}
    assert filters.title_presence_filter({"script": "hanja"}) and not filters.title_presence_filter({"script": "latin"})


def test_phrases_of_any_script_are_found(spark):
    docs = spark.createDataFrame([(1, "Ｆｕｌｌ width LETTERS, 사랑 노래!"), (2, "nothing"), (3, None)], "id int, text string")
    phrases = spark.createDataFrame([(1, "full-width", 1.0), (2, "사랑노래", 0.5), (3, "zz", 1.0), (4, "", 1.0), (5, "a", 1.0)], "phrase_id int, phrase string, confidence double")
    assert {(r["phrase_id"], r["id"]) for r in surface.phrase_matches(phrases, docs, block=2).collect()} == {(1, 1), (2, 1)}
    near = surface.fuzzy_matches(spark.createDataFrame([(1, "full width letterz", 1.0)], "phrase_id int, phrase string, confidence double"), docs).collect()
    s, p = unicode.surface_of("Ｆｕｌｌ width LETTERS, 사랑 노래!"), "fullwidthletterz"
    assert [r["id"] for r in near] == [1] and near[0]["score"] == pytest.approx(0.65 * 13 / 14 + 0.35 * surface.common_length(p, s) / 16)
    words = spark.createDataFrame([("the",), ("e",), ("the",)], "term string")
    assert {tuple(r) for r in surface.surface_frequency(words, spark.createDataFrame([(1, "The end"), (2, "breathe"), (3, "")], "id int, text string")).collect()} == {("the", 2), ("e", 2)}


def test_unicode_forms():
    assert unicode.identity_of("Ｂéyoncé  Ünder_Ⅻ") == "beyonceunderxii"
    assert unicode.excerpt_of("one\nTwo  words, here \nthree", "two-words") == "Two  words, here"
    assert unicode.excerpt_of("one", "two") is None
    for text in ("ﬁne ½ Å", "é é"):
        plain, origins = unicode.with_origins(text)
        assert len(plain) == len(origins) and all(unicodedata.normalize("NFKC", text[o]).lower().find(c) >= 0 for c, o in zip(plain, origins, strict=True))


def test_hybrid_sums_are_made_beside_the_postings(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12)))) for i in range(0, 120)]
    vectors = [(i, [rnd.gauss(0, 1) for _ in range(3)]) for i in range(60, 160)] + [(70, [0.5, 0.5, 0.5]), (71, [1.0, 2.0]), (200, [float("nan"), 1.0, 1.0]), (3, [float("inf"), 1.0, 1.0]), (5, None), (None, [1.0, 1.0, 1.0])]
    asked = [(i, " ".join(rnd.choice(words) for _ in range(4)), [rnd.gauss(0, 1) for _ in range(3)] if i % 4 else None, rnd.choice([0.0, 0.3, 0.6, 1.0])) for i in range(60, 80)] + [(500, "w1 w2", [1.0, 2.0], 0.5), (501, "unseen", [1.0, 2.0, 3.0], 0.5)]
    q = spark.createDataFrame(asked, "query_id int, text string, query array<double>, a double")
    sparse = bm25.Scores(q, spark.createDataFrame(docs, "id bigint, text string"), block=8)
    got = {}
    for r in search.hybrid_topk(q, spark.createDataFrame(vectors, "id bigint, vector array<float>"), sparse, "a", 7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], round(r["score"], 5)))
    shares = {(r["query_id"], r["id"]): r["score"] for r in sparse.all().collect()}
    for query_id, _, query, a in asked:
        dense = {}
        for i, v in vectors:
            if i is not None and i != query_id and query and v and len(v) == len(query) and all(map(math.isfinite, v)):
                dense[i] = max(dense.get(i, -math.inf), sum(x * y for x, y in zip(query, v, strict=True)))
        known = {i: s for (n, i), s in shares.items() if n == query_id}
        every = sorted((-(a * dense.get(i, 0.0) + (1 - a) * known.get(i, 0.0)), i) for i in {*dense, *known})[:7]
        mine = sorted(got.get(query_id, []))
        assert [x[2] for x in mine] == pytest.approx([-s for s, _ in every], abs=2e-5) and [x[1] for x in mine] == [i for _, i in every]


def test_corpus_stats_need_no_postings(spark):
    docs = spark.createDataFrame([(1, "a a b"), (1, "a c"), (2, "d b"), (None, "e d"), (None, "f"), (3, " "), (4, None)], "id int, text string")
    found = bm25.corpus_stats(docs, "id", "text")
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.first().asDict() == {"n_docs": 3, "min_length": 2, "avg_length": 10 / 3, "max_length": 5, "unique_terms": 6, "singleton_terms": 4}


@pytest.mark.parametrize("name", ["l_clue_extraction", "t_versions"])
def test_small_files_of_costly_rows_go_to_all_cores(spark, name):
    assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def _syllables(rnd: random.Random):
    known = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 3))) for _ in range(12)]
    return lambda n: "".join(rnd.choice(known) for _ in range(n))


def test_fuzzy_finds_score_only_pairs_with_a_long_enough_substring_in_common():
    rnd = random.Random(3)
    made = _syllables(rnd)
    phrases, texts = sorted({made(rnd.randint(1, 14)) for _ in range(60)}), [made(rnd.randint(0, 120)) for _ in range(150)] + [""]
    for pairs in (1, 40, 1 << 22):  # a text at a time and plainly, some texts at a time, all
        near = surface.Near(phrases, 0.55, 0.78, pairs)
        want = set()
        for i, text in enumerate(texts):
            for p, phrase in enumerate(phrases):
                grams = {phrase[j : j + 3] for j in range(len(phrase) - 2)}
                cover = sum(g in text for g in grams) / max(1, len(grams))
                score = 0.65 * cover + 0.35 * surface.common_length(phrase, text) / len(phrase)
                if len(phrase) >= 5 and cover >= 0.55 and score >= 0.78:
                    want.add((i, p, score))
        got = [(first + i, p, score) for first, pack in surface.packs(texts) for i, p, score in near.near(pack)]
        scored = [(first + i, p, n) for first, pack in surface.packs(texts) for i, p, n in near.common(pack)]
        assert len(got) == len(want) and set(got) == want
        assert all(n == surface.common_length(phrases[p], texts[i]) for i, p, n in scored) and len(scored) < len(texts) * len(phrases) / 2


def test_strings_held_are_found_in_one_pass_over_packs():
    rnd = random.Random(5)
    made = _syllables(rnd)
    strings, texts = sorted({made(n) for n in range(1, 30) for _ in range(4)}), [made(rnd.randint(0, 200)) for _ in range(150)] + ["", "\0", "é", "이야기"]
    strings += ["é", "야기", "\0a"]
    held = surface.Held(strings)
    got = [(first + i, p) for first, pack in surface.packs(texts) for found in held.within(pack) for i, p in zip(*(x.tolist() for x in found), strict=True)]
    assert len(got) == len(set(got)) and set(got) == {(i, p) for i, text in enumerate(texts) for p, x in enumerate(strings) if x in text}


def test_chunks_cut_at_sentence_ends_and_cover_the_text(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["word ", "another ", "end. ", "x" * 20, "\n", "why? "]) for _ in range(rnd.randint(0, 200))) for _ in range(40)] + ["", "y" * 1000, None]
    for text in filter(None, texts):
        spans = segments.cuts(text, 100)
        assert "".join(text[a:b] for a, b in spans) == text and all(0 < b - a <= 100 for a, b in spans)
        for a, b in spans[:-1]:
            ends = [m.end() for m in re.finditer(r"[.!?。]\s+|\n+", text) if a < m.end() <= a + 100]
            assert b == (ends[-1] if ends else b)
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in segments.chunks(docs, "id", "text", 300).collect():
        got.setdefault(r["id"], []).append((r["chunk"], r["start"], r["end"], r["text"]))
    for i, text in enumerate(texts):
        own = sorted(got.get(i, []))
        assert all(text[a:b] == t and b - a <= 400 for _, a, b, t in own)
        assert set().union(*(range(a, b) for _, a, b, _ in own)) == set(range(len(text or "")))


def test_chunks_are_made_where_texts_are_read(spark):
    docs = spark.createDataFrame([("a", "one. " * 400), ("a", "x" * 700), ("b", "")], "`the id` string, text string")
    found = segments.chunks(docs, "the id", "text", 300, rows=2)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()  # a window would shuffle the whole text with each of its pieces
    spans = [x for text in ("one. " * 400, "x" * 700) for x in enumerate(segments.chunk_spans(text, 300))]
    assert sorted((r["chunk"], (r["start"], r["end"])) for r in found.collect()) == sorted(spans)  # rows of one id stay apart


def test_sentences_respect_quotes_and_brackets():
    assert segments.sentence_list('He said "Go. Now." and left. (A. B.) Then? Yes') == ['He said "Go. Now." and left.', "(A. B.) Then?", "Yes"]
    assert segments.sentence_list("open ( never closed. Next\nnew line. ok") == ["open ( never closed. Next", "new line.", "ok"]


def test_names_in_texts():
    for name, text, there in [("호텔 델루나", "호텔델루나에서", True), ("호텔델루나", "호텔 델_루나!", True), ("내일", "내 일", False), ("내일", "내일은", True), ("it", "its", False), ("x", "x", False), ("it", "bit it", True)]:
        assert segments.named_in(name, text) is there, (name, text)


def test_artists_and_aliases(spark):
    rows = spark.createDataFrame([(1, "싹쓰리 (유두래곤, 린다G), TWICE (트와이스)"), (2, "DAY6"), (3, None)], "id int, artist string")
    aliases = linking.alias_map(spark.createDataFrame([(1, "트와이스", "TWICE"), (2, "other", "twice")], "position int, artist string, alias string"))
    got = {r["id"]: r["artists"] for r in linking.canonical_artists(rows, aliases, "id", "artist").collect()}
    assert got == {1: sorted(["싹쓰리", "싹쓰리유두래곤린다g", "트와이스", "twice트와이스"]), 2: ["day6"]}
    pairs = linking.match_entities(spark.createDataFrame([(1, "k", ["a", "b"])], "id int, key string, artists array<string>"), spark.createDataFrame([(9, "k", ["b", "c"]), (8, "k", ["z"])], "id int, key string, artists array<string>"))
    assert pairs.collect() == [(1, 9)]


def test_stores_are_published_in_one_step(spark, tmp_path):
    root = f"{tmp_path}/store"
    assert records.publication_state(spark, root, ["id"]) == "missing"
    with pytest.raises(ValueError, match="nothing is published"):
        records.current(spark, root)
    generations = []
    for n in range(4):
        old = records.current(spark, root) if n else None
        generations.append(records.publish(spark.range(n + 1), root, "id", keep=2)["path"])
        assert old is None or old.count() == n  # readers of the generation before go on
    assert records.current(spark, root).count() == 4 and records.publication_state(spark, root, ["id"]) == "ready" and records.publication_state(spark, root, ["x"]) == "misconfigured"
    assert sorted(p.name for p in (tmp_path / "store").iterdir() if p.name.startswith("gen=")) == sorted(g.rsplit("/", 1)[1] for g in generations[-2:])
    with pytest.raises(ValueError, match="older"):
        records.current(spark, root, most_seconds=-1)
    made = records.write_bundle({"a": spark.range(3), "b": spark.range(2)}, f"{tmp_path}/bundles")
    assert {n: t.count() for n, t in records.read_bundle(spark, made["path"]).items()} == {"a": 3, "b": 2}
    spark.range(9).write.mode("append").parquet(f"{made['path']}/a")
    with pytest.raises(ValueError, match="not what was written"):
        records.read_bundle(spark, made["path"])


def test_json_lists_and_merges(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"id": "1", "metadata": {"title": "a"}}, {"id": "2", "title": "b"}, {"title": "c"}]')
    (tmp_path / "m.json").write_text('{"3": {"title": "d"}, "4": null}')
    read = lambda name: {tuple(r) for r in records.read_json_map(spark, str(tmp_path / name), StructType.fromDDL("title string")).collect()}
    assert read("l.json") == {("1", "a"), ("2", "b")} and read("m.json") == {("3", "d")}
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(records.append_new(base, new, ["id"]).collect()) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(records.sync(base, new, ["id"]).collect()) == [(2, "c"), (3, "d")]
    with pytest.raises(Exception, match="finite"):
        records.read_vectors(spark.createDataFrame([([1.0, float("nan")],)], "v array<double>"), "v", 2).collect()


def test_reviews_apply_one_after_another(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    cases = spark.createDataFrame([(1, 1, "pending", "2025-01-01", None, 0, None, None), (2, 1, "pending", None, None, 0, None, None)], "case_id int, revision int, status string, expires_at string, review_state string, review_version int, reusable_text string, index_state string").withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    asked = [(1, 1, "approved", "rain", "", 1, 0), (1, 2, "held", "rain", "", 1, 0), (1, 3, "held", "", "", 1, 1), (1, 4, "odd", "", "", 1, 2), (1, 5, "held", "x" * 501, "", 1, 2), (2, 1, "held", "", "", 1, 0), (3, 1, "held", "", "", 1, 0)]
    after, outcomes = reviews.apply_reviews(cases, spark.createDataFrame(asked, "case_id int, seq int, state string, text string, note string, expected_revision int, expected_version int"), now)
    assert {(r["case_id"], r["seq"]): r["outcome"] for r in outcomes.collect()} == {(1, 1): "applied", (1, 2): "stale_review", (1, 3): "applied", (1, 4): "invalid_state", (1, 5): "text_too_long", (2, 1): "expired", (3, 1): "not_found"}
    one = after.where("case_id = 1").first()
    assert (one["review_state"], one["review_version"], one["index_state"]) == ("held", 2, None)
    bad = reviews.index_cycle(after, spark.createDataFrame([], "case_id int, revision int, version int, expires_at timestamp"), now, embed=lambda df: 1 / 0)
    assert [tuple(r) for r in bad["errors"].collect()] == [("to_index", "ZeroDivisionError")] and bad["expired_cases"].collect() == [(2,)]


def test_dialogues_with_answers(spark):
    rows = [(1, i, 1.0 - i / 100, i + 1) for i in range(30)]
    ranked = spark.createDataFrame(rows, "query_id int, id int, score double, rank int")
    values = spark.createDataFrame([(1, i, "kind", "a" if i in (25, 26) else "b") for i in range(30)], "query_id int, id int, slot string, value string")
    targets = spark.createDataFrame([(1, 25)], "query_id int, target int")
    got = {}
    for r in clarify.simulated_turns(ranked, values, targets, ["reject", "skip", "oracle", "noisy"], ["kind"], top_k=10).collect():
        got.setdefault(r["policy"], []).append((r["turn"], r["rank"]))
    assert sorted(got["reject"]) == sorted(got["skip"]) == [(1, 26), (2, 16), (3, 6)]
    assert sorted(got["oracle"])[1][1] < 16 <= sorted(got["noisy"])[1][1]


def test_a_search_explains_its_scores(spark):
    rnd = random.Random(8)
    rng = np.random.default_rng(8)
    items = spark.createDataFrame([(i, f"Song {i}", f"Artist {i % 4}", ["rock", "pop"][i % 2], ["남성", "여성", "혼성"][i % 3], f"{1990 + i % 10}.01.01") for i in range(60)], "id bigint, title string, artist string, genre string, vocal_gender string, release_date string")
    said = ["rain", "night", "sea", "star", "train", "home"]
    passages = [(i, " ".join(rnd.choice(said) for _ in range(12))) for i in range(60)]
    vec = [(i, rng.standard_normal(8).tolist()) for i in range(60)]
    corpus = retrieval.Corpus(items, spark.createDataFrame(passages, "id bigint, text string"), spark.createDataFrame(vec, "id bigint, vector array<double>"), audio_vectors=spark.createDataFrame(vec[::-1], "id bigint, vector array<double>"), lyrics=spark.createDataFrame(passages, "id bigint, text string"))
    phrase = " ".join(passages[7][1].split()[:4])
    queries = spark.createDataFrame([(1, "rain night", [1.0] * 8, ["rain", "night"], "여성", [(phrase, "verbatim", 0.9)], "a sound", [1.0] * 8, 0.7, 0.3), (2, "sea", [0.5] * 8, ["sea"], None, None, None, None, 1.0, 0.0)], "query_id bigint, query string, text_vector array<double>, tags array<string>, want_voice string, phrases array<struct<phrase:string,kind:string,confidence:double>>, audio_query string, audio_vector array<double>, w_text double, w_audio double")
    rejected = spark.createDataFrame([(2, 0), (2, 1)], "query_id bigint, id bigint")
    auxiliary = spark.createDataFrame([(2, "title", 59, 1, 1.0, None), (2, "attr_filter", 58, 1, 1.0, None)], "query_id bigint, path string, id bigint, rank int, confidence double, strength double")
    extra = spark.createDataFrame([(1, 55, 1)], "query_id bigint, id bigint, extra_rank int")
    out, ledger = retrieval.search(queries, corpus, retrieval.Config(top_k=8), rejected=rejected, auxiliary=auxiliary)
    got = {}
    for r in out.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    assert {q: [r for r, _, _ in sorted(x)] for q, x in got.items()} == {1: list(range(1, 9)), 2: list(range(1, 9))}
    assert sorted(got[1])[0][1] == 7  # the exact lyric comes first
    assert not {i for _, i, _ in got[2]} & {0, 1}
    totals = explain.ledger_totals(ledger)
    assert explain.unbalanced(totals, out.select("query_id", "id", "score")).count() == 0
    names = {(r["query_id"], r["name"]) for r in ledger.select("query_id", "name").distinct().collect()}
    assert {(1, "text"), (1, "audio"), (1, "lyrics_surface"), (1, "vocal_gender"), (2, "text"), (2, "title")} <= names and (2, "attr_filter") not in names
    assert {r["id"]: r["evidence"] for r in explain.evidence_kind(ledger.where("query_id = 1")).collect()}[7] == "ranking"
    pinned, _ = retrieval.search(queries.where("query_id = 1"), corpus, retrieval.Config(top_k=60), supplement=extra, rejected=spark.createDataFrame([(1, 55)], "query_id bigint, id bigint"))
    assert pinned.orderBy(F.desc("rank")).first()["id"] == 55
    judged = retrieval.Config(top_k=5, reranker=lambda df: df.where("id % 2 = 0").withColumn("judged", F.col("id").cast("double")))
    assert all(r["id"] % 2 == 0 for r in retrieval.search(queries, corpus, judged)[0].where("rank <= 3").collect())


def test_pinned_rows_go_down_by_shares(spark):
    ranked = spark.createDataFrame([(1, i, s, r) for r, (i, s) in enumerate([(1, 0.9), (2, 0.8), (3, 0.7), (4, 0.6)], 1)], "query_id bigint, id bigint, score double, rank int")
    got = paths.pin_last(ranked, spark.createDataFrame([(1, 2, 2), (1, 1, 1)], "query_id bigint, id bigint, place int")).orderBy("rank").collect()
    low = 0.6 - 0.6 * 1e-6
    assert [(r["id"], r["score"]) for r in got] == [(3, 0.7), (4, 0.6), (1, low), (2, low - low * 1e-6)]


def test_boost_scales_are_checked():
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="scale"):
            boosts.boost_rules(genre_scale=bad)


def test_widths_and_hooks():
    assert paths.candidate_widths(10) == {"candidates": 30, "pool": 30, "fusion": 30, "deep": 30}
    assert paths.candidate_widths(10, 40, 20, 70, deep=True) == {"candidates": 40, "pool": 60, "fusion": 70, "deep": 100}


def test_percentiles_of_a_large_group_are_exact(spark):
    rnd = random.Random(2)
    values = [rnd.choice([rnd.random() * 1000, 5.0]) for _ in range(5000)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", 2.0), ("c", None)], "g string, v double")
    for small in (10, 100_000):
        got = {r["g"]: r for r in metrics.latency_summary(df, "g", "v", small=small).collect()}
        s = sorted(values)
        assert got["a"]["median"] == round(float(np.median(s)), 1) and got["a"]["p95_linear"] == pytest.approx(round(float(np.percentile(s, 95)), 1))
        assert got["a"]["p95_floor"] == round(s[min(int(5000 * 0.95), 4999)], 1) and got["a"]["p95_nearest"] == round(s[round(4999 * 0.95)], 1)
        assert (got["b"]["n"], got["b"]["median"]) == (2, 1.5) and "c" not in got


def test_small_ledgers(spark):
    rows = spark.createDataFrame([(1, "ok", 5), (2, None, 3)], "id int, s string, n int")
    good, bad = ledgers.accept_or_reject(rows, "id", {"s": F.col("s").isNull(), "n": F.col("n") < 4})
    assert [r["id"] for r in good.collect()] == [1] and {tuple(r) for r in bad.collect()} == {(2, "s"), (2, "n")}
    facts = spark.createDataFrame([("1", "A", "T", "c", "x"), ("1", "A", "T", "c", "x")], "song_id string, artist string, title string, category string, text string")
    assert ledgers.context_records(facts).select("dense_text").collect() == [("A T c x",)]
    audit = ledgers.audit_collection(spark.createDataFrame([("s1", "a", "t"), ("s2", "b", "t")], "seed string, artist_key string, title_key string"), spark.createDataFrame([("a", "t", 1, 10, "old"), ("a", "t", 2, 11, "done")], "artist_key string, title_key string, position int, id int, status string"))
    assert {tuple(r) for r in audit.collect()} == {("s1", 11, "done"), ("s2", None, "missing")}
    files = spark.createDataFrame([("f", "a"), ("f", "b"), ("g", "a")], "folder string, name string")
    assert {(r["folder"], r["complete"], tuple(r["missing"])) for r in ledgers.completeness(files, ["a", "b"]).collect()} == {("f", True, ()), ("g", False, ("b",))}
    lab = spark.createDataFrame([(1, [5, 3])], "query_id int, positives array<int>")
    sys = ledgers.baselines(lab, spark.createDataFrame([(i,) for i in range(9)], "id int"), 2).collect()
    assert [(r["rank"], r["id"]) for r in sys if r["system"] == "perfect"] == [(1, 3), (2, 5)] and len([r for r in sys if r["system"] == "random"]) == 2
    terms = spark.range(1).select(ledgers.cut_terms(F.array(*map(F.lit, ["노래를", "가수", "노래방", "x", "the", "노래방"])), ["the"], ["를", "은"], F.array(F.lit("노래"))).alias("t")).first()["t"]
    assert terms == ["가수", "노래방"]
    assert spark.range(1).select(ledgers.document_text([("a", F.lit("x")), ("b", F.lit(" ")), ("c", F.lit("yy"))], 7).alias("t")).first()["t"] == "a: x\nc:"
    sweep = ledgers.stage_sweep(spark.createDataFrame([("g", 1, "a"), ("g", 1, "b"), ("g", 2, "a")], "g string, s int, stage string"), "g", "s", "stage", ["a", "b"])
    assert sorted(tuple(r) for r in sweep.collect()) == [("g", 1, 1, 1), ("g", 2, 1, 0)]


def test_hash_collisions(spark):
    terms = spark.createDataFrame([("a",), ("b",), ("a",), ("cc",)], "term string")
    assert bm25.hash_collisions(terms, lambda t: F.length(t).cast("bigint")).collect() == [(1, 2, ["a", "b"])]
    assert bm25.hash_collisions(terms).count() == 0


def test_query_digests_ignore_spacing(spark):
    rows = spark.createDataFrame([(" a  b ",), ("a b",)], "q string")
    assert len({r[0] for r in rows.select(works.query_key(F.col("q"))).collect()}) == 1


def test_reuse_expiry_indexes_and_main_axes(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    same, digest = ledgers.reuse_or_fit(rows, None)
    assert not same and ledgers.reuse_or_fit(rows.repartition(3), digest)[0] and not ledgers.reuse_or_fit(rows.limit(1), digest)[0]
    state = lambda *x: ledgers.ttl_state(spark.createDataFrame(list(x), "keys array<string>, seconds int")).first()["state"]
    assert [state((["a"], 0)), state((["expires_at"], None)), state((["expires_at"], 5)), state((["expires_at"], 5), (["expires_at"], 0))] == ["missing", "not_ttl", "wrong_seconds", "ready"]
    assert ledgers.blank_without_evidence(rows, ["t"], "id", 2).collect() == [(1, None), (2, "b")]
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 5)) * [5, 1, 3, 0.5, 0.1] + 7
    got = {r["id"]: (r["x"], r["y"]) for r in ledgers.plane(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>"), "id", "v").collect()}
    _, axes = np.linalg.eigh(np.cov(x.T))
    for k in (0, 1):
        want = (x - x.mean(0)) @ axes[:, -1 - k]
        assert abs(np.corrcoef(want, [got[i][k] for i in range(300)])[0, 1]) > 0.999
