"""Registered queries on names, versions, chunks, works, dialogues, reviews and small ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftsonde.functions import clues, linking, segments
from driftsonde.functions import text as T
from driftsonde.functions.unicode import excerpt, identity_key
from driftsonde.operators import clarify, ledgers, reviews, works
from driftsonde.plans.catalogue import query, r6, t
from driftsonde.sources import records
from driftsonde.sources.steps import spread

_TITLE = "CASE p_partkey % 8 WHEN 0 THEN p_name || ' (Live)' WHEN 1 THEN p_name || ' (Inst.)' WHEN 2 THEN p_name || ' Two' WHEN 3 THEN p_name || ' (Boy With Luv)' WHEN 4 THEN 'My ' || p_name WHEN 5 THEN p_name || ' - Sped Up' ELSE p_name END"


def _titles(d, spark):
    name, m = F.col("p_name"), F.col("p_partkey") % 8
    tail = lambda x: F.concat(name, F.lit(x))
    return t(spark, d, "part").withColumn("title", F.when(m == 0, tail(" (Live)")).when(m == 1, tail(" (Inst.)")).when(m == 2, tail(" Two")).when(m == 3, tail(" (Boy With Luv)")).when(m == 4, F.concat(F.lit("My "), name)).when(m == 5, tail(" - Sped Up")).otherwise(name))


@query(f"""WITH p AS (SELECT p_partkey, {_TITLE} AS title FROM part) SELECT p_partkey, trim(regexp_replace(lower(strip_accents(regexp_replace(regexp_replace(title, '\\([^)]*\\)', ' ', 'g'), '(?i)\\s+(feat\\.?|ft\\.|prod\\.?)\\s+.*$', ''))), '[^a-z0-9]', '', 'g')) AS key FROM p""")
def t_title_keys(spark, d):
    return _titles(d, spark).select("p_partkey", linking.title_key(F.col("title")).alias("key"))


@query("""SELECT c_custkey, regexp_replace(lower(strip_accents(c_name || ' É-ü_' || c_mktsegment)), '[^a-z0-9]', '', 'g') AS key FROM customer""")
def t_identity_keys(spark, d):
    return t(spark, d, "customer").select("c_custkey", identity_key(F.concat("c_name", F.lit(" É-ü_"), "c_mktsegment")).alias("key"))


@query("""WITH n AS (SELECT s_suppkey, s_name || ' (S' || s_suppkey || '), Band & Other (a, b)' AS artist FROM supplier)
SELECT s_suppkey, 3 AS n_names, list_sort(list_distinct([regexp_replace(lower(s), '[^a-z0-9]', '', 'g') FOR s IN [split_part(artist, ' (', 1) || 'S' || s_suppkey, split_part(artist, ' (', 1), 'S' || s_suppkey, 'canon', 'Other a b', 'Other']])) AS tokens FROM n""")
def t_artists(spark, d):
    """Names parted outside brackets, their keys, and one alias."""
    rows = t(spark, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit(" (S"), "s_suppkey", F.lit("), Band & Other (a, b)")).alias("artist"))
    aliases = linking.alias_map(spark.sql("SELECT 1 AS position, 'Canon' AS artist, 'BAND' AS alias"))
    own = linking.canonical_artists(rows, aliases, "s_suppkey", "artist")
    return rows.select("s_suppkey", F.size(linking.split_artists(F.col("artist"))).alias("n_names")).join(own.withColumnRenamed("artists", "tokens"), "s_suppkey")


@query(f"""WITH p AS (SELECT p_partkey, {_TITLE} AS title, p_partkey % 8 AS m FROM part)
SELECT p_partkey, CASE m WHEN 0 THEN '라이브판' WHEN 1 THEN '반주/MR' ELSE '' END AS labels, CASE m WHEN 0 THEN '- / 라이브판' WHEN 1 THEN '- / 반주/MR' END AS mismatch, CASE m WHEN 0 THEN '라이브판: (Live)' WHEN 1 THEN 'Inst/MR' WHEN 5 THEN 'Sped Up: (Sped Up)' ELSE '' END AS variant FROM p""")
def t_versions(spark, d):
    title = F.col("title")
    return spread(_titles(d, spark).select("p_partkey", "p_name", "title")).select("p_partkey", F.array_join(F.array_sort(linking.version_labels(title)), ",").alias("labels"), linking.version_mismatch(F.col("p_name"), title).alias("mismatch"), linking.variant_reason(title).alias("variant"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 8 AS m, CASE WHEN p_partkey % 16 >= 8 THEN -50 ELSE 0 END AS album FROM part)
SELECT p_partkey, CASE m WHEN 0 THEN -100 WHEN 1 THEN -200 WHEN 3 THEN 60 WHEN 4 THEN -40 WHEN 2 THEN 0 WHEN 5 THEN 0 ELSE 100 END + album AS score, m IN (0, 1, 2, 4, 5) AS hard,
CASE WHEN m IN (0, 1, 2, 4, 5) THEN 'reject' WHEN CASE m WHEN 3 THEN 60 ELSE 100 END + album < 60 THEN 'review' ELSE 'accept' END AS verdict FROM p""")
def m_candidate_scores(spark, d):
    album = F.when(F.col("p_partkey") % 16 >= 8, "Tour Album").otherwise("Album")
    return _titles(d, spark).select("p_partkey", linking.candidate_score(F.col("p_name"), F.col("title"), album).alias("s")).select("p_partkey", "s.*")


@query("""WITH p AS (SELECT p_partkey AS position, p_partkey AS id, p_partkey % 3 = 0 AS asked, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS a, lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS n FROM part),
k AS (SELECT a AS artist_key, n || 'x' AS title_key, arg_max(id, position) AS id FROM p WHERE asked GROUP BY ALL),
o AS (SELECT a AS artist_key, n AS title_key, min(id) AS id FROM p GROUP BY ALL HAVING min(id) = max(id))
SELECT artist_key, title_key, id FROM k UNION ALL SELECT artist_key, title_key, id FROM o WHERE (artist_key, title_key) NOT IN (SELECT (artist_key, title_key) FROM k)""")
def x_seed_index(spark, d):
    asked = F.col("p_partkey") % 3 == 0
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("position"), F.col("p_partkey").alias("id"), F.when(asked, F.col("p_brand")).alias("asked_artist"), F.when(asked, F.concat("p_name", F.lit("x"))).alias("asked_title"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"))
    return linking.seed_index(rows)


@query("""WITH e AS (SELECT p_brand AS "group", p_partkey AS id, p_partkey % 4 = 1 AS hard, p_partkey % 4 = 2 AS soft, p_partkey % 2 = 0 AS named, p_size > 25 AS official, p_retailprice AS views FROM part WHERE p_partkey % 6 <> 0),
c AS (SELECT *, bool_or(NOT soft) OVER (PARTITION BY "group") AS clean FROM e WHERE NOT hard)
SELECT "group", id, row_number() OVER (PARTITION BY "group" ORDER BY named DESC, official DESC, views DESC, id)::INT AS rank FROM c WHERE NOT soft OR NOT clean QUALIFY rank <= 3""")
def x_select_videos(spark, d):
    i = F.col("p_partkey")
    title = F.when(i % 6 == 0, F.concat("p_name", F.lit(" (Remix)"))).when(i % 4 == 1, F.concat("p_name", F.lit(" Cover"))).when(i % 4 == 2, F.concat("p_name", F.lit(" reaction"))).otherwise(F.col("p_name"))
    rows = t(spark, d, "part").select(F.col("p_brand").alias("group"), i.alias("id"), F.col("p_name").alias("wanted"), title.alias("title"), F.lit("tube").alias("channel"), (i % 2 == 0).alias("named"), (F.col("p_size") > 25).alias("official"), F.col("p_retailprice").alias("views"))
    return linking.select_videos(rows, ["cover"], ["reaction"]).select("group", "id", "rank")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '여성' WHEN 1 THEN '남성' WHEN 2 THEN '혼성' WHEN 3 THEN 'unknown' WHEN 4 THEN '혼성' ELSE '남성' END AS voice,
CASE event_id % 4 WHEN 0 THEN ['듀오'] WHEN 1 THEN ['솔로'] WHEN 2 THEN ['unknown'] ELSE ['밴드', '그룹'] END AS types FROM events""")
def t_voices_and_types(spark, d):
    i = F.col("event_id")
    said = F.when(i % 6 == 0, "female vocal").when(i % 6 == 1, "남성 듀엣").when(i % 6 == 2, "men and women").when(i % 6 == 3, "duet").when(i % 6 == 4, "mixed").otherwise("a boy")
    lit = lambda *x: F.array(*map(F.lit, x))
    types = F.when(i % 4 == 0, lit("보컬리스트", "힙합듀오")).when(i % 4 == 1, lit("singer", "producer")).when(i % 4 == 2, lit("?")).otherwise(lit("rock band", "걸그룹", "a trio"))
    return t(spark, d, "events").select("event_id", linking.voice_of(said).alias("voice"), linking.artist_types_of(types).alias("types"))


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 0.2 WHEN 1 THEN 0.9 WHEN 2 THEN 0.7425 WHEN 3 THEN 1.0 WHEN 4 THEN 0.9475 WHEN 5 THEN 0.0 ELSE 0.2 END AS name, (event_id % 7 IN (0, 5))::INT::DOUBLE AS sentence FROM events""")
def t_title_meaning(spark, d):
    m = F.col("event_id") % 7
    title = F.when(m == 0, "One Two Three").when(m == 1, "Maria").when(m == 2, "Robert").when(m == 3, "마리아 (Maria)").when(m == 4, "로버트 (Robert)").when(m == 5, "사랑 노래 하나").otherwise("TTL")
    ratio = lambda kind: F.round(T.title_meaning_ratio(title, F.lit(kind)), 4)
    return t(spark, d, "events").select("event_id", ratio("foreign_person_name").alias("name"), ratio("sentence").alias("sentence"))


@query("""WITH y AS (SELECT event_id, event_id % 9 AS m, 1990 + event_id % 30 AS y, event_id % 40 AS n FROM events)
SELECT event_id, CASE m WHEN 0 THEN y WHEN 1 THEN 1990 WHEN 2 THEN 2007 WHEN 3 THEN 2024 WHEN 4 THEN 2022 WHEN 5 THEN 2018 WHEN 6 THEN 2025 WHEN 7 THEN 2018 END::INT AS start, CASE m WHEN 0 THEN y WHEN 1 THEN 1993 WHEN 2 THEN 2009 WHEN 3 THEN 2024 WHEN 4 THEN 2024 WHEN 5 THEN 2024 WHEN 6 THEN 2026 WHEN 7 THEN 2026 END::INT AS "end",
CASE m WHEN 0 THEN 0.9 WHEN 1 THEN 0.75 WHEN 2 THEN 0.9 WHEN 3 THEN 0.85 WHEN 4 THEN 0.6 WHEN 5 THEN 0.35 WHEN 6 THEN 0.65 WHEN 7 THEN 0.35 END AS confidence FROM y""")
def t_korean_era(spark, d):
    i = F.col("event_id")
    m, y = i % 9, (1990 + i % 30).cast("string")
    said = F.when(m == 0, F.concat(y, F.lit("년 노래"))).when(m == 1, "90년대 초반 같아").when(m == 2, "2000년대 후반 곡").when(m == 3, "재작년에 들은").when(m == 4, "세 년쯤 전").when(m == 5, "몇 년 전").when(m == 6, "신곡").when(m == 7, "요즘 노래").otherwise("노래")
    return t(spark, d, "events").select("event_id", T.korean_era(said, 2026).alias("w")).select("event_id", "w.start", "w.end", "w.confidence")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1998 WHEN 1 THEN 1990 + event_id % 20 END::INT AS year, CASE event_id % 4 WHEN 0 THEN 'latin' WHEN 1 THEN 'hanja' END AS script, CASE event_id % 4 WHEN 0 THEN 3 WHEN 2 THEN 12 END::INT AS char_count, event_id % 4 = 0 AS strong FROM events""")
def x_birth_years_and_shapes(spark, d):
    i = F.col("event_id")
    said = F.when(i % 4 == 0, "1996~2000년생").when(i % 4 == 1, F.concat((1990 + i % 20).cast("string"), F.lit("년생"))).otherwise("12345")
    shape = F.when(i % 4 == 0, "영어 제목 세 글자").when(i % 4 == 1, "한자로 된 제목").when(i % 4 == 2, "12 글자").otherwise("제목")
    return t(spark, d, "events").select("event_id", T.birth_year(said).alias("year"), T.title_shape(shape).alias("s")).select("event_id", "year", "s.*")


@query("""SELECT event_id, event_id % 3 <> 2 AS found, CASE WHEN event_id % 3 <> 2 THEN json_extract(props, '$.k')::INT END AS k, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 6 ELSE NULL END::INT AS start, CASE event_id % 4 WHEN 0 THEN 'quote_not_in_source' WHEN 1 THEN NULL ELSE 'quote_occurs_multiple_times' END AS problem FROM events""")
def x_json_and_quotes(spark, d):
    i = F.col("event_id")
    noisy = F.when(i % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(i % 3 == 1, F.concat(F.lit("Sure: "), "props", F.lit(" ok"))).otherwise("{ none")
    span = T.quote_span(F.lit("a rose is a rose"), F.when(i % 4 == 0, "lily").when(i % 4 == 1, " is").otherwise("rose"))
    out = t(spark, d, "events").select("event_id", T.json_object(noisy).alias("o"), span.alias("q"))
    return out.select("event_id", F.col("o").isNotNull().alias("found"), F.get_json_object("o", "$.k").cast("int").alias("k"), F.col("q.start").cast("int").alias("start"), F.col("q.problem").alias("problem"))


@query("""WITH s AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS h FROM pages)
SELECT page_id, length(trim(regexp_replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g'), ' ')) < 200 AND regexp_matches(html, '(?i)<script') AS shell, regexp_matches(lower(html), 'captcha|cf-challenge|just a moment|access denied|unusual traffic') AS challenged FROM s""")
def t_page_shells(spark, d):
    return t(spark, d, "pages").select("page_id", T.needs_rendering(F.col("html")).alias("shell"), T.challenge(F.col("html")).alias("challenged"))


@query(None)
def t_chunks(spark, d):
    """Chunks of all documents, cut at sentence ends. Compared with a plain walk in the tests."""
    return segments.chunks(t(spark, d, "documents"), "doc_id", "text", 900).select("doc_id", "chunk", "start", "end", F.sha2("text", 256).alias("text_sha256"))


@query(None)
def t_quoted_sentences(spark, d):
    """Sentences of all documents, quotes and brackets respected."""
    s = t(spark, d, "documents").select("doc_id", segments.quoted_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.sha2(F.array_join("s", "\n"), 256).alias("sentences_sha256"))


@query("""SELECT item_id, trim(split_part(text, chr(10), 1), ' ') AS excerpt FROM benchmark""")
def l_excerpts(spark, d):
    """The line around a clue whose marks differ from the text's."""
    words = F.slice(F.split(F.split("text", "\n")[0], " "), 1, 3)
    return t(spark, d, "benchmark").select("item_id", excerpt(F.col("text"), F.array_join(words, "--")).alias("excerpt"))


@query("""SELECT event_id, event_id % 5 IN (0, 1, 3) AS named FROM events""")
def l_media_names(spark, d):
    m = F.col("event_id") % 5
    text = F.when(m == 0, "호텔델루나에서 들은 노래").when(m == 1, "드라마 호텔 델루나 ost").when(m == 2, "호텔델루나틱 얘기").when(m == 3, "HOTEL, 호텔_델루나!").otherwise("내 일은 아니다")
    name = F.when(m == 4, "내일").otherwise("호텔 델루나")
    return t(spark, d, "events").select("event_id", segments.media_named(name, text).alias("named"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN ['verbatim:1.0:너를 사랑해'] WHEN 1 THEN ['partial:0.92:너를 사랑해도 되겠니'] WHEN 2 THEN ['partial:0.9:눈이 내려와', 'partial:0.82:눈이 내려와라는'] ELSE [] END AS clues,
CASE event_id % 5 WHEN 0 THEN '여성' WHEN 3 THEN '혼성' END AS voice, CASE event_id % 5 WHEN 1 THEN '발라드' WHEN 3 THEN '록' END AS genre FROM events""")
def l_clue_extraction(spark, d):
    m = F.col("event_id") % 5
    said = F.when(m == 0, "여자 가수 노래인데 가사에 “너를 사랑해”가 있어").when(m == 1, "발라드 곡, 가사에 너를 사랑해도 되겠니 라는 말이 있었어").when(m == 2, "눈이 내려와라는 가사가 나오는 곡").when(m == 3, "남자 보컬이랑 여자 보컬, 락 음악").otherwise("재즈인지 모르겠고 남자 친구 얘기 '제목'")
    out = spread(t(spark, d, "events").select("event_id", said.alias("said"))).select("event_id", clues.lyric_clues(F.col("said")).alias("c"), clues.slot_statements(F.col("said")).alias("s"))
    return out.select("event_id", F.transform("c", lambda x: F.concat_ws(":", x["kind"], x["confidence"].cast("string"), x["text"])).alias("clues"), "s.voice", "s.genre")


# Works --------------------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'no_media_word' WHEN 1 THEN 'media_negated' WHEN 2 THEN 'explicit_work_named' WHEN 3 THEN 'quoted_work_name' WHEN 4 THEN 'no_description' ELSE 'indirect_description' END AS reason, event_id % 6 = 5 AS opened FROM events""")
def w_gate(spark, d):
    m = F.col("event_id") % 6
    said = F.when(m == 0, "a sad song of rain").when(m == 1, "드라마 말고 슬픈 노래").when(m == 2, "the drama with a ghost").when(m == 3, "드라마 “도깨비” 노래").when(m == 4, "드라마 노래").otherwise("귀신이 나오는 호텔 드라마 노래")
    rows = t(spark, d, "events").select("event_id", said.alias("query"), F.when(m == 2, F.array(F.lit("Ghost"))).alias("named"))
    return works.gate(rows).select("event_id", "reason", "opened")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'failed' WHEN 2 THEN 'abstain' WHEN 3 THEN 'candidates' ELSE 'failed' END AS status, CASE event_id % 5 WHEN 0 THEN 'parse_error' WHEN 1 THEN 'schema_error' WHEN 4 THEN 'no_valid_work_entries' END AS error, CASE WHEN event_id % 5 = 3 THEN 3 END::INT AS n_works, CASE WHEN event_id % 5 = 3 THEN 1 ELSE 0 END::INT AS truncated FROM events""")
def w_parse_answers(spark, d):
    m = F.col("event_id") % 5
    work = '{"name": " A  B ", "aliases": ["x", " ", "y", "z"], "media_type": "drama", "evidence": "e"}'
    answer = F.when(m == 0, "not json").when(m == 1, '{"decision": "maybe"}').when(m == 2, '{"decision": "abstain", "works": []}').when(m == 3, f'{{"decision": "candidates", "works": [{", ".join([work] * 4)}]}}').otherwise('{"decision": "candidates", "works": []}')
    out = works.parse_answers(t(spark, d, "events").select("event_id", answer.alias("answer")))
    return out.select("event_id", "status", "error", F.size("works").alias("n_works"), "truncated")


@query("""WITH m AS (SELECT lower(p_brand) AS term, p_partkey AS id FROM part), n AS (SELECT term, count(DISTINCT id) AS n FROM m GROUP BY term),
w AS (SELECT c_custkey AS query_id, unnest([0, 1, 2]) AS position, unnest(['Brand#11', 'Brand#99', 'Brand#11']) AS name FROM customer)
SELECT query_id, position, name, CASE WHEN query_id % 3 = 0 THEN 'evidence_not_in_query' WHEN position = 0 THEN CASE WHEN n > 200 THEN 'too_generic' WHEN n IS NULL THEN 'no_local_data' END WHEN position = 1 THEN CASE WHEN n IS NULL THEN 'no_local_data' END ELSE CASE WHEN n > 200 THEN 'too_generic' WHEN n IS NULL THEN 'no_local_data' ELSE 'duplicate' END END AS reject_reason FROM w LEFT JOIN n ON lower(name) = term""")
def w_validate(spark, d):
    mentions = t(spark, d, "part").select(F.lower("p_brand").alias("term"), F.col("p_partkey").alias("id"))
    listed = F.posexplode(F.array(F.lit("Brand#11"), F.lit("Brand#99"), F.lit("Brand#11"))).alias("position", "name")
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.lit("a ghost in a hotel").alias("query"), listed)
    rows = rows.withColumns({"aliases": F.array().cast("array<string>"), "media_type": F.lit("drama"), "evidence": F.when(F.col("query_id") % 3 == 0, "a dragon").otherwise("ghost in a"), "explicit": F.array().cast("array<string>")})
    return works.validate_works(rows, mentions).select("query_id", "position", "name", "reject_reason")


@query("""SELECT c_custkey AS query_id, CASE WHEN c_custkey % 3 = 0 THEN 'missing' WHEN c_custkey % 5 = 0 THEN 'drift' ELSE 'hit' END AS state, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 THEN c_mktsegment END AS analysis, c_custkey % 3 = 0 OR c_custkey % 5 = 0 AS cache_miss FROM customer""")
def w_caches(spark, d):
    """Stored analyses by id and text, stored answers by the digest of the text."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("query"), F.col("c_mktsegment").alias("analysis"))
    stored = c.where("query_id % 3 <> 0").withColumn("query", F.when(F.col("query_id") % 5 == 0, "other").otherwise(F.concat(F.lit(""), "query")))
    a = works.analysis_cache(c.drop("analysis"), stored).select("query_id", "state", "analysis")
    b = works.replay(c.select("query_id", F.concat(F.lit(" "), "query").alias("query")), stored.select(works.query_key(F.col("query")).alias("key"), F.col("analysis").alias("answer")))
    return a.join(b.select("query_id", F.col("error").isNotNull().alias("cache_miss")), "query_id")


# Dialogues ------------------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, contains(lower(p_type), 'steel') AS genre, p_partkey % 3 = 0 AS kind, p_size % 20 BETWEEN 0 AND 9 AS era, p_partkey % 4 = 1 AS voice FROM part""")
def c_answer_matches(spark, d):
    i = F.col("p_partkey")
    types = F.when(i % 3 == 0, F.array(F.lit("인디 밴드"))).otherwise(F.array(F.lit("솔로")))
    date = (2000 + F.col("p_size") % 20).cast("string")
    voice = F.when(i % 4 == 1, "여성").otherwise("남성")
    on = lambda slot, value: clarify.answer_matches(F.lit(slot), F.lit(value), F.lit(False), F.col("p_type"), types, date, voice)
    return t(spark, d, "part").select("p_partkey", on("genre", "STEEL ").alias("genre"), on("type", "밴드").alias("kind"), on("release_era", "2000년대").alias("era"), on("vocal_gender", "여성").alias("voice"))


@query("""WITH q AS (SELECT c_custkey AS query_id, CASE WHEN c_custkey % 2 = 0 THEN '남성' END AS voice, c_custkey % 3 = 0 AS era, c_custkey % 5 = 0 AS stage FROM customer)
SELECT query_id, CASE WHEN query_id % 4 < 2 THEN '여성' ELSE voice END AS voice, 'tin' AS genre, CASE WHEN query_id % 7 = 0 THEN 2010 WHEN era THEN 1990 WHEN stage THEN 2010 END::INT AS era_start, CASE WHEN query_id % 7 = 0 THEN 2019 WHEN era THEN 1995 WHEN stage THEN 2014 END::INT AS era_end,
query_id % 2 = 0 AND query_id % 4 >= 2 AS confirms_voice FROM q""")
def c_merge_answers(spark, d):
    """Answers put into analyses; the voice's answer confirms where it is what was said before."""
    i = F.col("query_id")
    q = t(spark, d, "customer").select(F.col("c_custkey").alias("query_id"))
    era = i % 3 == 0
    a = q.select("query_id", F.when(i % 2 == 0, "남성").alias("voice"), F.lit("steel").alias("genre"), F.array().cast("array<string>").alias("types"), F.when(era, 1990).alias("era_start"), F.when(era, 1995).alias("era_end"), F.lit(0.5).alias("era_confidence"), F.when(i % 5 == 0, 13).alias("stage_from"), F.when(i % 5 == 0, 15).alias("stage_to"), F.lit(0.6).alias("stage_confidence"))
    said = lambda p, slot, value, when: q.where(when).select("query_id", F.lit(p).alias("position"), F.lit(slot).alias("slot"), F.lit(value).alias("value"), F.lit(False).alias("skipped"))
    answers = said(1, "vocal_gender", "여성", i % 4 < 2).unionByName(said(1, "vocal_gender", "남성", i % 4 >= 2).where("query_id % 2 = 0")).unionByName(said(2, "genre", "brass", F.lit(True))).unionByName(said(3, "genre", "tin", F.lit(True))).unionByName(said(4, "release_era", "2010년대", i % 7 == 0)).unionByName(said(5, "birth_year", "1998년생", F.lit(True))).unionByName(said(6, "vocal_gender", "robot", F.lit(True)))
    same = clarify.answer_confirms(a, answers.where("slot = 'vocal_gender'")).groupBy("query_id").agg(F.max("confirms").alias("confirms_voice"))
    return clarify.merge_answers(a, answers).join(same, "query_id").select("query_id", "voice", "genre", "era_start", "era_end", "confirms_voice")


@query("""WITH p AS (SELECT p_brand AS query_id, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part), g AS (SELECT query_id, max(id) AS target, count(*) AS n FROM p GROUP BY query_id), x AS (SELECT query_id, r, n FROM g JOIN p USING (query_id) WHERE id = target)
SELECT query_id, 'reject' AS policy, turn::INT AS turn, (r - 10 * (turn - 1))::INT AS rank, least(10, n - 10 * (turn - 1))::INT AS shown FROM x, (SELECT unnest([1, 2, 3]) AS turn) WHERE r > 10 * (turn - 1)""")
def c_reject_dialogues(spark, d):
    """Dialogues that only reject: each turn shows the next ten."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    ranked = t(spark, d, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("id"), F.lit(0.0).alias("score"), F.row_number().over(w).alias("rank"))
    targets = ranked.groupBy("query_id").agg(F.max("id").alias("target"))
    values = ranked.select("query_id", "id", F.lit("kind").alias("slot"), (F.col("id") % 3).cast("string").alias("value"))
    return clarify.simulated_turns(ranked, values, targets, ["reject"], ["kind"])


@query("""WITH r AS (SELECT user_id AS query_id, event_type AS policy, event_id, 1 + event_id % 25 AS rank FROM events WHERE value IS NOT NULL), q AS (SELECT policy, query_id, avg((rank <= 1)::INT) AS h1, avg((rank <= 5)::INT) AS h5, avg((rank <= 10)::INT) AS h10, avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END) AS m FROM r GROUP BY ALL)
SELECT policy, count(*) AS n_queries, round(avg(h1), 4) AS hit1, round(avg(h5), 4) AS hit5, round(avg(h10), 4) AS hit10, round(avg(m), 4) AS mrr10 FROM q GROUP BY policy""")
def a_policy_means(spark, d):
    rows = t(spark, d, "events").where("value is not null").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("policy"), (1 + F.col("event_id") % 25).alias("rank"))
    return clarify.policy_means(rows)


@query("""WITH p AS (SELECT unnest(['initial', 'reject_only', 'oracle:a', 'oracle:b', 'oracle:best']) AS policy), c AS (SELECT c_custkey AS query_id FROM customer), x AS (SELECT query_id, policy, CASE policy WHEN 'initial' THEN 9 WHEN 'reject_only' THEN 7 WHEN 'oracle:a' THEN 5 WHEN 'oracle:b' THEN 1 + query_id % 9 END AS rank, CASE policy WHEN 'initial' THEN true WHEN 'reject_only' THEN query_id % 2 = 0 WHEN 'oracle:a' THEN query_id % 3 = 0 WHEN 'oracle:b' THEN query_id % 3 = 0 ELSE query_id % 3 = 0 END AS ran FROM c, p)
SELECT query_id, policy, CASE WHEN NOT ran THEN CASE WHEN query_id % 2 = 0 THEN 7 ELSE 9 END WHEN policy = 'oracle:best' THEN least(5, 1 + query_id % 9) ELSE rank END::INT AS rank, ran FROM x""")
def c_fill_policies(spark, d):
    c, i = t(spark, d, "customer").select(F.col("c_custkey").alias("query_id")), F.col("query_id")
    one = lambda policy, rank, when: c.where(when).select("query_id", F.lit(policy).alias("policy"), rank.cast("int").alias("rank"))
    ran = one("initial", F.lit(9), F.lit(True)).unionByName(one("reject_only", F.lit(7), i % 2 == 0)).unionByName(one("oracle:a", F.lit(5), i % 3 == 0)).unionByName(one("oracle:b", 1 + i % 9, i % 3 == 0))
    return clarify.fill_policies(clarify.best_oracle(ran), ["initial", "reject_only", "oracle:a", "oracle:b", "oracle:best"])


# Reviews --------------------------------------------------------------------------------------------------------------------


def _cases(spark, d):
    i = F.col("c_custkey")
    c = t(spark, d, "customer")
    ends = F.when(i % 10 != 0, F.expr("TIMESTAMP'2024-06-01 00:00:00'")).otherwise(F.expr("TIMESTAMP'2023-06-01 00:00:00'"))
    return c.select(i.alias("case_id"), (i % 3).cast("int").alias("revision"), F.when(i % 7 == 0, "withdrawn").otherwise("pending").alias("status"), ends.alias("expires_at"), F.lit(None).cast("string").alias("review_state"), F.lit(0).alias("review_version"), F.lit(None).cast("string").alias("reusable_text"), F.lit(None).cast("string").alias("index_state"))


_NOW = "TIMESTAMP'2024-01-01 00:00:00'"


@query("""WITH c AS (SELECT c_custkey AS i FROM customer), o AS (SELECT i, unnest([1, 2, 3]) AS seq FROM c)
SELECT i AS case_id, seq::BIGINT AS seq, CASE WHEN seq = 3 AND i % 2 = 0 THEN 'text_required' WHEN i % 10 = 0 THEN 'expired' WHEN i % 7 = 0 THEN 'withdrawn' WHEN i % 3 <> 1 THEN 'stale_revision' WHEN seq = 1 THEN 'applied' WHEN seq = 2 THEN 'replayed' ELSE 'applied' END AS outcome FROM o""")
def st_reviews(spark, d):
    """Three reviews of every case: an approval, the same again, and one more with or without a text."""
    one = lambda seq, text, version: t(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.lit(seq).cast("bigint").alias("seq"), F.lit("approved").alias("state"), text.alias("text"), F.lit("").alias("note"), F.lit(1).alias("expected_revision"), F.lit(version).alias("expected_version"))
    asked = one(1, F.lit("rain"), 0).unionByName(one(2, F.lit("rain "), 0)).unionByName(one(3, F.when(F.col("c_custkey") % 2 == 1, "more rain"), 1))
    return reviews.apply_reviews(_cases(spark, d), asked, F.expr(_NOW))[1]


@query("""WITH c AS (SELECT c_custkey AS i FROM customer), g AS (SELECT i FROM c WHERE i % 10 <> 0 AND i % 7 <> 0 AND i % 3 = 1), p AS (SELECT i, i % 3 AS revision, i % 4 = 0 AS old FROM c WHERE i % 2 = 0)
SELECT 'expired_points' AS step, i AS case_id FROM p WHERE old UNION ALL SELECT 'stale_points', i FROM p WHERE NOT old AND i NOT IN (SELECT i FROM g) UNION ALL SELECT 'to_index', i FROM g WHERE i NOT IN (SELECT i FROM p WHERE NOT old) UNION ALL SELECT 'expired_cases', i FROM c WHERE i % 10 = 0""")
def st_index_cycle(spark, d):
    asked = t(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.lit(1).cast("bigint").alias("seq"), F.lit("approved").alias("state"), F.lit("rain").alias("text"), F.lit("").alias("note"), F.lit(1).alias("expected_revision"), F.lit(0).alias("expected_version"))
    cases, _ = reviews.apply_reviews(_cases(spark, d), asked, F.expr(_NOW))
    ends = F.when(F.col("case_id") % 4 == 0, F.expr("TIMESTAMP'2023-01-01 00:00:00'")).otherwise(F.expr("TIMESTAMP'2025-01-01 00:00:00'"))
    points = cases.where("case_id % 2 = 0").select("case_id", "revision", F.lit(1).alias("version"), ends.alias("expires_at"))
    steps = reviews.index_cycle(cases, points, F.expr(_NOW))
    out = None
    for name in ("expired_points", "stale_points", "to_index", "expired_cases"):
        one = steps[name].select(F.lit(name).alias("step"), "case_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT c_custkey AS case_id, epoch(TIMESTAMP '2024-06-01' - TIMESTAMP '2024-01-01')::BIGINT AS seconds_left FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 7 <> 0 AND c_custkey > 20 ORDER BY c_custkey LIMIT 15""")
def x_review_list(spark, d):
    return reviews.review_list(_cases(spark, d), "pending", F.expr(_NOW), after=20, limit=15).select("case_id", F.col("seconds_left").cast("bigint").alias("seconds_left"))


# Ledgers --------------------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'migrate' WHEN 1 THEN 'collect' WHEN 2 THEN 'skip' WHEN 3 THEN 'skip' WHEN 4 THEN 'reextract' WHEN 5 THEN 'migrate' WHEN 6 THEN 'collect' ELSE 'collect' END AS action,
CASE event_id % 8 WHEN 0 THEN 'repair_missing_collected_at' WHEN 1 THEN 'retry_incomplete_or_error' WHEN 2 THEN 'needs_review_manual_resolution' WHEN 3 THEN 'already_complete' WHEN 4 THEN 'upgrade_refinement_rules_from_cached_source' WHEN 5 THEN 'upgrade_compact_schema' WHEN 6 THEN 'missing' ELSE 'repair_unknown_current_schema' END AS reason FROM events""")
def x_backfill_plan(spark, d):
    m = F.col("event_id") % 8
    version = F.when(m < 4, 3).when(m == 4, 2).when(m == 5, 1).when(m == 7, 99)
    status = F.when(m == 1, "error").when(m == 2, "needs_review").when(m == 3, "ok").when(m == 4, "ok").when(m == 5, "no_trivia").when(m == 0, "ok")
    return t(spark, d, "events").select("event_id", ledgers.backfill_action(version, status, F.when(m != 0, "2024").otherwise(" ")).alias("a")).select("event_id", "a.*")


@query("""WITH a AS (SELECT p_brand AS query_id, p_partkey AS id, p_retailprice AS score FROM part), b AS (SELECT query_id, id, score + CASE WHEN id % 50 = 0 THEN 300 ELSE 0.25 END AS score FROM a),
x AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM a), y AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM b)
SELECT query_id, bool_and(x.r = y.r) AS same_order, round(max(abs(a.score - b.score)), 6) AS most, count(*) AS n FROM x JOIN y USING (query_id, id) JOIN a USING (query_id, id) JOIN b USING (query_id, id) GROUP BY query_id""")
def x_batch_comparison(spark, d):
    a = t(spark, d, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    b = a.withColumn("score", F.col("score") + F.when(F.col("id") % 50 == 0, 300).otherwise(0.25))
    return ledgers.compare_orders(a, b).withColumn("most", r6("most"))


@query("""WITH a AS (SELECT event_type AS metric, round(avg(value), 6) AS value FROM events GROUP BY event_type) SELECT metric, value AS before, value + 0.01 AS after FROM a WHERE metric <> 'click'""")
def x_summary_check(spark, d):
    a = t(spark, d, "events").groupBy(F.col("event_type").alias("metric")).agg(r6(F.avg("value")).alias("value"))
    b = a.withColumn("value", F.col("value") + F.when(F.col("metric") == "click", 0.000001).otherwise(0.01))
    return ledgers.differing(a, b)


@query("""WITH c AS (SELECT conv_id AS "group", turn AS id, (turn * 7 + conv_id) % 5 AS score FROM conversations), k AS (SELECT *, count(*) FILTER (score >= 3) OVER (PARTITION BY "group") AS three FROM c)
SELECT "group", id, row_number() OVER (PARTITION BY "group" ORDER BY score DESC, id)::INT AS rank FROM k WHERE score >= CASE WHEN three > 0 THEN 3 ELSE 2 END QUALIFY rank <= 4""")
def x_comment_fallback(spark, d):
    rows = t(spark, d, "conversations").select(F.col("conv_id").alias("group"), F.col("turn").alias("id"), ((F.col("turn") * 7 + F.col("conv_id")) % 5).alias("score"), F.lit(False).alias("keep"))
    return ledgers.pick_comments(rows, 4).select("group", "id", "rank")


@query("""WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'Unknown' WHEN p_partkey % 3 = 1 THEN p_name END AS title, p_brand AS artist FROM part), q AS (SELECT p_partkey AS id, p_type AS title, 'x' AS artist FROM part WHERE p_partkey % 2 = 0)
SELECT p.id, CASE WHEN p.title IS NULL OR p.title = 'Unknown' THEN q.title ELSE p.title END AS title, p.artist FROM p LEFT JOIN q USING (id)""")
def j_metadata_merge(spark, d):
    p = t(spark, d, "part")
    a = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, "Unknown").when(F.col("p_partkey") % 3 == 1, F.col("p_name")).alias("title"), F.col("p_brand").alias("artist"))
    b = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("title"), F.lit("x").alias("artist"))
    return records.best_metadata([a, b], "id")


@query("""SELECT doc_id, list_filter(['overlap', 'no_reason', 'no_positive'], lambda x: x = 'overlap' AND quality = 1 AND toxic = 1 OR x = 'no_reason' AND toxic = 1 OR x = 'no_positive' AND quality = 0) AS problems FROM labels WHERE quality = 0 OR toxic = 1""")
def u_label_overlaps(spark, d):
    lab = t(spark, d, "labels")
    none = F.array().cast("array<bigint>")
    rows = lab.select("doc_id", F.when(F.col("quality") == 1, F.array("doc_id")).otherwise(none).alias("positives"), none.alias("allowed"), F.when(F.col("toxic") == 1, F.array("doc_id")).otherwise(none).alias("negatives"), F.lit(None).cast("string").alias("negative_reason"), F.lit("labeled").alias("status"))
    return ledgers.label_problems(rows, "doc_id")


@query("""SELECT l.lang, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad, round(count(quality) / count(*), 6) AS coverage, count(*) FILTER (quality IS NULL) AS unresolved FROM documents l LEFT JOIN labels USING (doc_id) GROUP BY l.lang""")
def a_catalogue_coverage(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("status")), "doc_id", "left")
    return ledgers.coverage(rows, "lang", "status", ["good", "bad"]).withColumn("coverage", r6("coverage"))


@query("""SELECT p_partkey, concat_ws(chr(10), p_name, CASE WHEN p_size > 10 THEN 'tags: ' || p_type END, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_mfgr END) AS passage FROM (SELECT *, 'none' AS p_mfgr FROM part)""")
def t_sparse_passages(spark, d):
    blocks = [("", [F.col("p_name")]), ("tags: ", [F.when(F.col("p_size") > 10, F.col("p_type"))]), ("", [F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")), F.lit("none")])]
    return t(spark, d, "part").select("p_partkey", ledgers.sparse_passage(blocks).alias("passage"))


@query("""SELECT page_id, regexp_extract(url, '([^/?#]+)(\\?[^#]*)?(#.*)?$', 1) AS key FROM pages""")
def x_cover_keys(spark, d):
    return t(spark, d, "pages").select("page_id", ledgers.cover_key(F.col("url")).alias("key"))


@query("""SELECT o_orderkey, list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda i: round(CASE WHEN o_orderkey % 200 <= 12 THEN 0 ELSE (least(o_orderkey % 200, 120) - 12) * i / 7 END, 6)) AS starts FROM orders WHERE o_orderkey % 200 > 12 UNION ALL SELECT o_orderkey, [0.0] FROM orders WHERE o_orderkey % 200 <= 12""")
def s_segment_starts(spark, d):
    starts = records.segment_starts((F.col("o_orderkey") % 200).cast("double"))
    return t(spark, d, "orders").select("o_orderkey", F.transform(starts, lambda x: F.round(x, 6)).alias("starts"))


@query("""SELECT vec_id, unnest(generate_series(1, 64))::BIGINT AS term, unnest(embedding)::DOUBLE AS weight FROM embeddings""")
def s_sparse_rows(spark, d):
    rows = records.read_vectors(t(spark, d, "embeddings"), "embedding", 64)
    packed = rows.select("vec_id", F.sequence(F.lit(1).cast("bigint"), F.lit(64).cast("bigint")).alias("indices"), F.col("embedding").cast("array<double>").alias("values"))
    return records.read_sparse(packed, "vec_id")
