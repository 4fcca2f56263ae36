"""Registered queries on whole searches, path weights, boosts, rescues, explanations and filter builders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftsonde.functions import text as T
from driftsonde.operators import boosts, explain, filters, fusion, paths, retrieval
from driftsonde.plans.catalogue import _HYBRID_SQL, _LISTS_SQL, _RRF_SQL, _WEIGHTS, _corpus, _lists, query, r6, t

U = "(1.0 / 61)"


@query(f"""WITH {_HYBRID_SQL}, k AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 30),
bo AS (SELECT query_id, id, 1.0 / (60 + rank) AS fused,
 CASE WHEN query_id % 3 = 0 AND contains(lower(p_type), 'steel') THEN {U} ELSE 0 END AS genre,
 CASE WHEN query_id % 2 = 0 AND p_brand = 'Brand#13' THEN {U} ELSE 0 END AS artist,
 CASE WHEN query_id % 5 = 0 AND p_size % 2 = 0 THEN 1.25 * 0.8 * {U} * greatest(0.0, 1 - 0.25 * greatest(1990 + 2 * query_id % 20 - 1960 - p_size, p_size + 1960 - 1995 - 2 * query_id % 20, 0)) ELSE 0 END AS era
 FROM k JOIN part ON p_partkey = id)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(fused + artist + era + genre, 12) DESC, fused DESC, id)::INT AS rank, round(fused + artist + era + genre, 9) AS score FROM bo QUALIFY rank <= 10""")
def q_whole_search(spark, d):
    """Every benchmark item as a query over embeddings, documents and parts: hybrid text search, explicit boosts, the first ten."""
    asked = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    own = t(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("text_vector"))
    i = F.col("query_id")
    asked = asked.join(own, "query_id", "left").select(
        "query_id", F.col("text").alias("query"), "text_vector", F.lit(0.6).alias("alpha"), F.array("text").alias("tags"),
        F.when(i % 3 == 0, "steel").alias("want_genre"), F.when(i % 2 == 0, "brand#13").alias("want_artist"),
        F.when(i % 5 == 0, F.struct((1990 + 2 * i % 20).cast("int").alias("start"), (1995 + 2 * i % 20).cast("int").alias("end"), F.lit(0.8).alias("confidence"))).alias("era"),
    )
    items = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("genre"), F.when(F.col("p_size") % 2 == 0, (F.col("p_size") + 1960).cast("string")).alias("release_date"))
    corpus = retrieval.Corpus(items, t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), _corpus(spark, d))
    out, _ = retrieval.search(asked, corpus, retrieval.Config(top_k=10, candidate_k=30))
    return out.select("query_id", "id", "rank", F.round("score", 9).alias("score"))


@query("""WITH q AS (SELECT event_id AS query_id, event_id % 7 / 10.0 AS w_text, event_id % 5 / 10.0 AS w_image, event_id % 3 / 10.0 AS w_audio, event_id % 2 = 0 AS visual, event_id % 4 = 1 AS exact_lyric, event_id % 6 = 5 AS lexical,
 CASE WHEN event_id % 3 <> 2 THEN 'mixed' ELSE 'mood' END AS intent, event_id % 5 < 3 AS has_image, event_id % 4 < 3 AS has_audio, event_id % 9 = 8 AS forced FROM events),
u AS (SELECT *, CASE WHEN forced THEN has_image ELSE visual AND has_image AND w_image > 0 END AS use_image, CASE WHEN forced THEN has_audio ELSE NOT exact_lyric AND has_audio AND w_audio > 0 END AS use_audio FROM q),
m AS (SELECT *, NOT forced AND intent = 'mixed' AND NOT lexical AND use_audio AND NOT use_image AS mixed FROM u),
w AS (SELECT query_id, use_image, use_audio, CASE WHEN forced THEN 0.2 WHEN mixed THEN greatest(w_text, 0.6) ELSE w_text END AS a, CASE WHEN use_image THEN CASE WHEN forced THEN 0.3 ELSE w_image END ELSE 0 END AS b,
 CASE WHEN use_audio THEN CASE WHEN forced THEN 0.5 WHEN mixed THEN least(w_audio, 0.4) ELSE w_audio END ELSE 0 END AS c FROM m)
SELECT query_id, use_image, use_audio, round(CASE WHEN a + b + c > 0 THEN a / (a + b + c) ELSE 1 END, 6) AS text, round(CASE WHEN a + b + c > 0 THEN b / (a + b + c) ELSE 0 END, 6) AS image, round(CASE WHEN a + b + c > 0 THEN c / (a + b + c) ELSE 0 END, 6) AS audio FROM w""")
def r_path_weights(spark, d):
    i = F.col("event_id")
    q = t(spark, d, "events").select(
        i.alias("query_id"), (i % 7 / 10.0).alias("w_text"), (i % 5 / 10.0).alias("w_image"), (i % 3 / 10.0).alias("w_audio"), (i % 2 == 0).alias("visual"), (i % 4 == 1).alias("exact_lyric"), (i % 6 == 5).alias("lexical_lyric"),
        F.when(i % 3 != 2, "mixed").otherwise("mood").alias("intent"), F.when(i % 5 < 3, "a cover").alias("image_query"), F.when(i % 4 < 3, "a sound").otherwise("  ").alias("audio_query"), F.lit("longing").alias("lyric_query"),
        F.when(i % 9 == 8, F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5))).alias("forced"),
    )
    return paths.path_weights(q).select("query_id", "use_image", "use_audio", r6("text").alias("text"), r6("image").alias("image"), r6("audio").alias("audio"))


@query(f"""WITH {_LISTS_SQL}, a AS (SELECT query_id, id, rank, CASE path WHEN 'dense' THEN 'performance' WHEN 'mixed' THEN 'title' ELSE 'metadata' END AS path, (id % 10) / 10.0 AS strength FROM lists WHERE rank <= 15),
x AS (SELECT query_id, id, sum(CASE path WHEN 'performance' THEN 0.55 * 0.9 * strength WHEN 'title' THEN 0.35 * 0.9 ELSE 0.2 * strength END / (60 + rank)) AS added FROM a GROUP BY query_id, id),
f AS (SELECT query_id, id, 1.0 / (60 + rank) AS score FROM lists WHERE path = 'dense')
SELECT query_id, id, round(coalesce(score, 0) + coalesce(added, 0), 9) AS score FROM f FULL JOIN (SELECT * FROM x WHERE added <> 0) USING (query_id, id)""")
def r_auxiliary(spark, d):
    lists = _lists(spark, d)
    name = F.when(F.col("path") == "dense", "performance").when(F.col("path") == "mixed", "title").otherwise("metadata")
    hits = lists.where("rank <= 15").select("query_id", "id", "rank", name.alias("path"), F.lit(0.9).alias("confidence"), (F.col("id") % 10 / 10.0).alias("strength"))
    base = lists.where("path = 'dense'").select("query_id", "id", (1 / (60 + F.col("rank"))).alias("score"))
    return paths.add_contributions(base, paths.auxiliary_contributions(hits)).withColumn("score", F.round("score", 9))


@query(f"""WITH {_LISTS_SQL}, st AS (SELECT query_id, id, rank AS place, CASE WHEN id % 4 = 0 THEN 0 ELSE 0.8::DOUBLE * greatest(0.0, 1 - 0.25::DOUBLE * greatest(1994 - (1990 + id % 12), 1990 + id % 12 - 1996, 0)) END + CASE WHEN id % 3 = 0 THEN 0.6::DOUBLE ELSE 0 END AS strength FROM lists l WHERE path = 'dense')
SELECT query_id, id, round(strength, 6) AS strength, row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, place, id)::INT AS rank FROM st WHERE strength > 0 QUALIFY rank <= 15""")
def r_metadata_strength(spark, d):
    i = F.col("id")
    year = F.when(i % 4 != 0, (1990 + i % 12).cast("int"))
    types = F.when(i % 3 == 0, F.array(F.lit("밴드"))).otherwise(F.array(F.lit("솔로")))
    strength = paths.metadata_strength(year, F.lit(1994), F.lit(1996), F.lit(0.8), types, F.array(F.lit("밴드"), F.lit("듀오")), F.lit(0.6))
    out = paths.strongest(_lists(spark, d).where("path = 'dense'").withColumn("strength", strength))
    return out.select("query_id", "id", r6("strength").alias("strength"), "rank")


@query(f"""WITH {_LISTS_SQL}, st AS (SELECT query_id, id, rank + CASE path WHEN 'dense' THEN 0 WHEN 'mixed' THEN 100 ELSE 200 END AS place, ((id + length(path)) % 10) / 10.0 AS strength FROM lists),
o AS (SELECT query_id, id, max(strength) AS strength, arg_min(place, (-strength, place)) AS place FROM st WHERE strength >= 0.25 GROUP BY query_id, id)
SELECT query_id, id, strength, place, row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, place, id)::INT AS rank FROM o QUALIFY rank <= 15""")
def r_best_strength(spark, d):
    no = F.when(F.col("path") == "dense", 0).when(F.col("path") == "mixed", 1).otherwise(2)
    rows = _lists(spark, d).withColumns({"list_no": no, "strength": (F.col("id") + F.length("path")) % 10 / 10.0})
    return paths.best_strength(rows).withColumn("place", F.col("place").cast("bigint"))


_BOOST_SQL = f"""p AS (SELECT p_partkey AS id, p_name AS title, p_brand AS artist, p_type AS genre, CASE p_partkey % 4 WHEN 0 THEN '남성' WHEN 1 THEN '여성' WHEN 2 THEN '혼성' END AS voice, 1990 + p_size % 12 AS y FROM part),
r AS (SELECT id,
CASE WHEN id % 2 = 0 THEN CASE WHEN contains(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 'an') THEN 4 * 0.9 ELSE 0 END ELSE 0 END AS lyric_clue,
CASE WHEN title = 'x' THEN 5 ELSE 0 END AS title_exact,
(((length(regexp_replace(title, '[^A-Za-z0-9가-힣一-鿿]', '', 'g')) = 9)::INT + (len(regexp_extract_all(title, '[A-Za-z0-9가-힣一-鿿]+')) = 2)::INT) / 2) * 0.7 AS title_constraints,
1.25 * (len(regexp_extract_all(title, '[A-Za-z0-9가-힣一-鿿]+')) >= 3)::INT * 0.5 AS title_meaning,
CASE WHEN contains(lower(artist), 'brand#1') THEN 1 ELSE 0 END AS artist_match,
CASE WHEN voice = '여성' THEN 1 WHEN voice = '혼성' THEN 0.25 WHEN voice = '남성' THEN -0.5 ELSE 0 END AS vocal_gender,
1.25 * 0.8 * greatest(0.0, 1 - 0.25 * greatest(1995 - y, y - 1996, 0)) AS release_era,
CASE WHEN contains(regexp_replace(lower(genre), '\\s', '', 'g'), 'brass') THEN 1 ELSE 0 END AS genre_match FROM p)"""


@query(f"""WITH {_BOOST_SQL} SELECT id, round(lyric_clue * {U}, 9) AS lyric_clue, round(title_exact * {U}, 9) AS title_exact, round(title_constraints * {U}, 9) AS title_constraints, round(title_meaning * {U}, 9) AS title_meaning,
round(artist_match * {U}, 9) AS artist_match, round(vocal_gender * {U}, 9) AS vocal_gender, round(release_era * {U}, 9) AS release_era, round(genre_match * {U}, 9) AS genre_match,
round(0.01 + (lyric_clue + title_exact + title_constraints + title_meaning + artist_match + vocal_gender + release_era + genre_match) * {U}, 9) AS boosted FROM r""")
def r_boost_ledger(spark, d):
    """Each rule keeps a column of its own, so that the ledger is the plan."""
    i = F.col("p_partkey")
    rows = t(spark, d, "part").select(
        i.alias("id"), F.lit(0.01).alias("score"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("genre"),
        F.when(i % 4 == 0, "남성").when(i % 4 == 1, "여성").when(i % 4 == 2, "혼성").alias("vocal_gender"), (1990 + F.col("p_size") % 12).cast("string").alias("release_date"),
        F.when(i % 2 == 0, F.col("p_name")).otherwise("").alias("lyrics_highlight"), F.lit("").alias("lyrics_summary"), F.lit(None).cast("array<string>").alias("artist_types"), F.lit("").alias("clue_text"), F.lit(None).cast("string").alias("lyric_match_type"),
        F.lit("x").alias("want_title"), F.lit("Brand#1").alias("want_artist"), F.lit("여성").alias("want_voice"), F.lit("BRASS").alias("want_genre"), F.lit(None).cast("array<string>").alias("keywords"),
        F.expr("array(named_struct('kind', 'verbatim', 'text', 'a n', 'variants', array(), 'confidence', 0.9D))").alias("clues"),
        F.expr("named_struct('script', cast(null as string), 'char_count', 9, 'word_count', 2, 'contains_number', cast(null as boolean), 'repeated_char', cast(null as boolean), 'repeated_word', cast(null as boolean), 'confidence', 0.7D)").alias("title_constraints"),
        F.expr("named_struct('kind', 'sentence', 'confidence', 0.5D)").alias("meaning"), F.expr("named_struct('start', 1995, 'end', 1996, 'confidence', 0.8D)").alias("era"),
        F.expr("cast(null as struct<values:array<string>,confidence:double>)").alias("types"), F.expr("cast(null as struct<count:string,roles:array<string>,sounds:array<string>,confidence:double>)").alias("performance"),
    )
    names = ["lyric_clue", "title_exact", "title_constraints", "title_meaning", "artist_match", "vocal_gender", "release_era", "genre_match"]
    return boosts.apply_boosts(rows, mismatch_scale=0.5).select("id", *((F.round(f"boost_{n}", 9) + 0.0).alias(n) for n in names), F.round("boosted", 9).alias("boosted"))


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '남성' WHEN 1 THEN '여성' WHEN 2 THEN '혼성' ELSE '' END AS voice, p_partkey % 3 = 0 AS band, p_partkey % 5 = 0 AS feat, p_type LIKE '%STEEL%' AS whistle FROM part)
SELECT p_partkey, round((greatest(CASE WHEN voice = '혼성' THEN 1.0 ELSE 0 END, CASE WHEN feat THEN 0.9 ELSE 0 END)
 + ((voice IN ('여성', '혼성'))::INT + feat::INT) / 2 + whistle::INT) / 3, 6) AS similarity FROM p""")
def r_performance_similarity(spark, d):
    i = F.col("p_partkey")
    voice = F.when(i % 4 == 0, "남성").when(i % 4 == 1, "여성").when(i % 4 == 2, "혼성").otherwise("")
    clue = F.expr("named_struct('count', 'duet', 'roles', array('여성노래', '피처링보컬', 'unknown'), 'sounds', array('휘파람'), 'confidence', 0.9D)")
    text = F.when(F.contains("p_type", F.lit("STEEL")), "a whistle in it").otherwise("plain")
    title = F.when(i % 5 == 0, "Song feat. Her").otherwise("Song")
    types = F.when(i % 3 == 0, F.array(F.lit("밴드"))).otherwise(F.array(F.lit("솔로")))
    out = boosts.performance_similarity(clue, voice, types, text, F.lit("rock"), boosts.featured(title, F.lit("x")))
    return t(spark, d, "part").select("p_partkey", r6(out).alias("similarity"))


@query("""SELECT p_partkey, CASE WHEN p_name = 'x' THEN 4 ELSE 0 END + CASE WHEN contains(lower(p_brand), 'brand#2') THEN 3 ELSE 0 END + CASE p_partkey % 4 WHEN 0 THEN -2 WHEN 1 THEN 2 WHEN 2 THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(p_type), 'tin') THEN 1 ELSE 0 END AS tier FROM part""")
def r_exact_lyric_tier(spark, d):
    i = F.col("p_partkey")
    rows = t(spark, d, "part").select(i, F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("genre"), F.when(i % 4 == 0, "남성").when(i % 4 == 1, "여성").when(i % 4 == 2, "혼성").alias("vocal_gender"), F.lit("x").alias("want_title"), F.lit("brand #2").alias("want_artist"), F.lit("여성").alias("want_voice"), F.lit("Tin").alias("want_genre"))
    return rows.select("p_partkey", boosts.exact_lyric_tier().alias("tier"))


@query(f"""WITH {_RRF_SQL}, tp AS (SELECT * FROM f WHERE rank <= 10), en AS (SELECT *, (id % 5 = 0) AS entrant FROM tp), la AS (SELECT query_id, arg_max(score, rank) AS last FROM en WHERE NOT entrant GROUP BY query_id)
SELECT query_id, id, entrant AS is_entrant, CASE WHEN NOT entrant OR last IS NULL THEN round(score, 9) END AS score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN last IS NULL THEN false ELSE entrant END, CASE WHEN entrant AND last IS NOT NULL THEN id END, rank)::INT AS rank FROM en LEFT JOIN la USING (query_id)""")
def r_pin_last(spark, d):
    """Scores of pinned rows are left out here: they go down by shares of a millionth."""
    ranked = fusion.rrf(_lists(spark, d), _WEIGHTS, 10)
    out = paths.pin_last(ranked, ranked.where("id % 5 = 0").select("query_id", "id", F.col("id").alias("place")))
    last = F.max((~F.col("is_entrant")).cast("int")).over(Window.partitionBy("query_id"))
    return out.withColumn("score", F.when(~F.col("is_entrant") | (last == 0), F.round("score", 9))).select("query_id", "id", "is_entrant", "score", "rank")


@query(f"""WITH {_RRF_SQL}, tp AS (SELECT query_id, id, rank, id % 4 = 0 AS fits FROM f WHERE rank <= 20),
n AS (SELECT *, least(sum((rank > 10 AND fits)::INT) OVER q, sum((rank <= 10 AND NOT fits)::INT) OVER q) AS n, row_number() OVER (PARTITION BY query_id, rank <= 10, fits ORDER BY rank) AS a, row_number() OVER (PARTITION BY query_id, rank <= 10, fits ORDER BY rank DESC) AS z FROM tp WINDOW q AS (PARTITION BY query_id))
SELECT query_id, id, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank > 10 AND fits AND a <= n THEN 1 WHEN rank <= 10 AND NOT fits AND z <= n THEN 2 WHEN rank <= 10 THEN 0 ELSE 3 END, rank)::INT AS new_rank FROM n""")
def r_title_shape_rescue(spark, d):
    return paths.title_shape_rescue(fusion.rrf(_lists(spark, d), _WEIGHTS, 20).select("query_id", "id", "rank", (F.col("id") % 4 == 0).alias("fits")))


@query(f"""WITH {_RRF_SQL}, tp AS (SELECT query_id, id, rank, rank AS retrieval_rank, CASE WHEN query_id % 100 = 0 THEN 'exact' WHEN rank = 1 OR id % 3 = 0 THEN 'phonetic' END AS kind, 0.5 + (query_id % 4) / 10.0 AS score FROM f WHERE rank <= 10),
an AS (SELECT query_id, id, 11 - rank AS rank, retrieval_rank = 1 AND (kind = 'exact' OR kind = 'phonetic' AND (score >= 0.7 OR NOT coalesce(bool_or(retrieval_rank > 1 AND kind IS NOT NULL) OVER (PARTITION BY query_id), false))) AS first FROM tp)
SELECT query_id, id, rank, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(first, false) DESC, rank)::INT AS new_rank FROM an""")
def r_lyric_anchor(spark, d):
    r = fusion.rrf(_lists(spark, d), _WEIGHTS, 10)
    kind = F.when(F.col("query_id") % 100 == 0, "exact").when((F.col("rank") == 1) | (F.col("id") % 3 == 0), "phonetic")
    rows = r.select("query_id", "id", (11 - F.col("rank")).alias("rank"), F.col("rank").alias("retrieval_rank"), kind.alias("kind"), (0.5 + F.col("query_id") % 4 / 10.0).alias("score"))
    return paths.lyric_anchor_first(rows)


@query(f"""WITH {_RRF_SQL}, tp AS (SELECT query_id, id, rank, CASE WHEN rank = 15 THEN 0.95 ELSE 0.5 + (id % 30) / 100.0 END AS support, query_id % 100 = 0 AS sure FROM f WHERE rank <= 20)
SELECT query_id, id, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank = 15 AND sure THEN 8.5 ELSE rank END)::INT AS new_rank FROM tp""")
def r_rare_fact_rescue(spark, d):
    r = fusion.rrf(_lists(spark, d), _WEIGHTS, 20)
    support = F.when(F.col("rank") == 15, 0.95).otherwise(0.5 + F.col("id") % 30 / 100.0)
    rows = r.select("query_id", "id", "rank", support.alias("support"), F.lit(2).alias("n_matched"), F.lit(0).alias("n_against"), F.lit(1).alias("needed"), F.when(F.col("query_id") % 100 == 0, 0.9).otherwise(0.1).alias("confidence"))
    return paths.rare_fact_rescue(rows)


@query("""WITH p AS (SELECT p_brand AS query_id, p_partkey AS id, p_retailprice AS retrieval, (p_partkey % 20) / 20.0 AS rank_score, (p_partkey % 7) / 7.0 AS relevance, (p_size % 10) / 10.0 AS confidence FROM part),
n AS (SELECT *, CASE WHEN max(retrieval) OVER w = min(retrieval) OVER w THEN 1.0 ELSE (retrieval - min(retrieval) OVER w) / (max(retrieval) OVER w - min(retrieval) OVER w) END AS r, CASE WHEN confidence < 0.55 THEN 0.85 * greatest(0.35, confidence / 0.55) ELSE 0.85 END AS w FROM p WINDOW w AS (PARTITION BY query_id))
SELECT query_id, id, round(w * (0.7 * rank_score + 0.3 * relevance) + (1 - w) * r, 6) AS score FROM n""")
def r_listwise_fuse(spark, d):
    i = F.col("p_partkey")
    rows = t(spark, d, "part").select(F.col("p_brand").alias("query_id"), i.alias("id"), F.col("p_retailprice").alias("retrieval"), (i % 20 / 20.0).alias("rank_score"), (i % 7 / 7.0).alias("relevance"), (F.col("p_size") % 10 / 10.0).alias("confidence"))
    return paths.listwise_fuse(rows).withColumn("score", r6("score"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 10 >= 7 THEN 'image_dominant' WHEN event_id % 5 = 0 THEN 'unverifiable_scene' END AS reason, round(0.8 * (event_id % 4) / 4.0 * CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END, 6) AS weight FROM events""")
def r_skip_and_context(spark, d):
    i = F.col("event_id")
    return t(spark, d, "events").select("event_id", paths.skip_rerank(i % 10 / 10.0, i % 2 == 0, i % 5 == 0).alias("reason"), r6(paths.context_weight(F.lit(0.8), i % 4 / 4.0, i % 3 == 0, F.lit(True))).alias("weight"))


@query("""WITH q AS (SELECT event_id, event_id % 3 = 0 AS e, event_id % 3 = 1 AS p, event_id % 10 / 10.0 AS alpha FROM events)
SELECT event_id, CASE WHEN e THEN 'rain falls Moon' WHEN p THEN 'reyn night Moon' ELSE 'night Moon' END AS sparse_text, 'a song' || CASE WHEN NOT e THEN chr(10) || 'lyric meaning: longing' ELSE '' END || CASE WHEN p THEN chr(10) || 'heard as: reyn' ELSE '' END AS dense_text,
CASE WHEN e THEN least(alpha, 0.1) WHEN p THEN least(0.6, greatest(alpha, 0.5)) ELSE alpha END AS text_alpha, least(0.6, greatest(alpha, 0.45)) AS performance_alpha FROM q""")
def r_text_plan(spark, d):
    i = F.col("event_id")
    lit = lambda *x: F.array(*map(F.lit, x))
    q = t(spark, d, "events").select("event_id", F.lit("a song").alias("query"), (i % 10 / 10.0).alias("alpha"), F.when(i % 3 == 0, lit("rain falls")).alias("exact_terms"), F.when(i % 3 == 1, lit("reyn")).alias("phonetic_terms"), lit("night").alias("tags"), lit("").alias("aliases"), F.lit("Moon").alias("title"), F.lit(None).cast("string").alias("artist"), F.lit("longing").alias("lyric_meaning"))
    return paths.text_plan(q).select("event_id", "sparse_text", "dense_text", "text_alpha", paths.path_alpha("performance", F.col("alpha")).alias("performance_alpha"))


@query("""SELECT event_id, event_id % 4 = 0 OR event_id % 6 = 0 AND event_id % 5 = 0 OR event_id % 7 = 0 AS composite, event_id % 3 <> 2 OR event_id % 8 = 0 AS lexical, event_id % 3 = 0 OR event_id % 8 = 0 AS exact FROM events""")
def r_clue_predicates(spark, d):
    i = F.col("event_id")
    roles = F.when(i % 7 == 0, F.array(F.lit("a"), F.lit("b"))).when(i % 6 == 0, F.array(F.lit("a")))
    sounds = F.when(i % 4 == 0, F.array(F.lit("휘파람"))).when(i % 5 == 0, F.array(F.lit("피아노")))
    kinds = F.when(i % 3 == 0, F.array(F.lit("verbatim"))).when(i % 3 == 1, F.array(F.lit("phonetic"))).otherwise(F.array(F.lit("semantic")))
    flags = paths.clue_flags(kinds, F.when(i % 8 == 0, F.array(F.lit("rain"))), F.lit(None).cast("string"))
    return t(spark, d, "events").select("event_id", paths.composite_performance(F.lit(""), roles, sounds, F.lit(0.4)).alias("composite"), flags["lexical_lyric"].alias("lexical"), flags["exact_lyric"].alias("exact"))


# Filters -----------------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND o_orderkey % 4 IN (1, 2)""")
def f_attribute_filter(spark, d):
    i = F.col("o_orderkey")
    rows = t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy.MM.dd").alias("release_date"), F.when(i % 4 == 0, "남성").when(i % 4 == 1, "여성").when(i % 4 == 2, "혼성").alias("vocal_gender"))
    return rows.where(filters.compile_filter(rows, filters.attribute_filter({"era": (1996, 1998), "voice": "여성"}))).select("o_orderkey")


@query("""SELECT p_partkey, len(regexp_extract_all(p_name, '[A-Za-z0-9]+')) >= 3 AS sentence, length(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) = 9 AND NOT regexp_matches(p_name, '[0-9]') AS shaped FROM part""")
def f_title_filters(spark, d):
    f = T.title_features(F.col("p_name"))
    rows = t(spark, d, "part").select("p_partkey", *(f[n].alias(c) for n, c in filters.TITLE_COLUMNS.items()))
    meaning, shape = filters.title_meaning_filter("sentence"), filters.title_filter({"char_count": 9, "contains_number": False})
    return rows.select("p_partkey", filters.passes(rows, meaning).alias("sentence"), filters.passes(rows, shape).alias("shaped"))


@query("""SELECT p_partkey::VARCHAR AS id, p_name AS title, p_brand AS artist, CASE WHEN regexp_matches(p_name, '[A-Za-z]') AND regexp_matches(p_name, '[0-9]') THEN 'mixed' WHEN regexp_matches(p_name, '[A-Za-z]') THEN 'latin' WHEN regexp_matches(p_name, '[0-9]') THEN 'numeric' END AS title_script, substr(p_type, 1, 5) AS genre FROM part WHERE p_partkey % 9 <> 0""")
def f_flatten_payload(spark, d):
    """Nested records flattened, title features derived, strings cut to five characters here; records without an id leave."""
    from driftsonde.sources import records

    i = F.col("p_partkey")
    nested = t(spark, d, "part").select(F.when(i % 9 != 0, i.cast("string")).alias("song_id"), F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("genre")).alias("metadata"))
    return filters.select_payload(records.flatten(nested).select("id", "title", "artist", "title_script", F.substring("genre", 1, 5).alias("genre")), ["id", "title", "artist", "title_script", "genre"])


# Explanations --------------------------------------------------------------------------------------------------------------


def _ledger(spark, d):
    deltas = fusion.contributions(_lists(spark, d), _WEIGHTS)
    rows = deltas.select("query_id", "id", F.lit("path").alias("kind"), F.when(F.col("path") == "dense", "lyrics_surface").otherwise("text").alias("name"), "delta", (F.col("id") % 4 == 0).alias("dropped"))
    return rows.unionByName(rows.where("id % 3 = 0").select("query_id", "id", F.lit("rule").alias("kind"), F.lit("title_exact").alias("name"), F.lit(0.05).alias("delta"), F.lit(False).alias("dropped")).distinct())


_LEDGER_SQL = f"""{_LISTS_SQL}, c AS (SELECT query_id, id, 'path' AS kind, CASE path WHEN 'dense' THEN 'lyrics_surface' ELSE 'text' END AS name, CASE path WHEN 'dense' THEN 1.0 ELSE 0.5 END / (60 + rank) AS delta, id % 4 = 0 AS dropped FROM lists WHERE path <> 'id'),
l AS (SELECT * FROM c UNION ALL SELECT DISTINCT query_id, id, 'rule', 'title_exact', 0.05, false FROM c WHERE id % 3 = 0)"""


@query(f"""WITH {_LEDGER_SQL} SELECT query_id, id, round(coalesce(sum(delta) FILTER (kind = 'path' AND NOT dropped), 0), 9) AS paths, round(coalesce(sum(delta) FILTER (kind = 'path' AND dropped), 0), 9) AS dropped, round(coalesce(sum(delta) FILTER (kind = 'rule'), 0), 9) AS rules, count(*) FILTER (kind = 'path' AND NOT dropped) AS n_paths,
CASE WHEN bool_or(name = 'lyrics_surface' AND NOT dropped) THEN 'ranking' ELSE 'supplementary' END AS evidence FROM l GROUP BY query_id, id""")
def x_ledger_evidence(spark, d):
    ledger = _ledger(spark, d)
    out = explain.ledger_totals(ledger).join(explain.evidence_kind(ledger), ["query_id", "id"])
    return out.select("query_id", "id", *(F.round(c, 9).alias(c) for c in ("paths", "dropped", "rules")), "n_paths", "evidence")


@query(f"""WITH {_LEDGER_SQL}, pt AS (SELECT *, CASE WHEN kind = 'path' AND NOT dropped THEN 0 WHEN kind = 'rule' THEN 1 ELSE 3 END AS part FROM l)
SELECT query_id, id, string_agg(CASE WHEN part = 3 THEN 'not kept: ' ELSE '' END || name || ' ' || printf('%+.6f', round(delta, 6)), chr(10) ORDER BY part, -abs(delta), name) AS text FROM pt GROUP BY query_id, id""")
def x_ledger_text(spark, d):
    return explain.render(_ledger(spark, d))


@query("""WITH p AS (SELECT p_brand AS query_id, p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '여성' WHEN 1 THEN '혼성' END AS voice, p_type LIKE '%TIN%' AS tin FROM part),
c AS (SELECT query_id, id, 0 AS position, 'voice' AS slot, '여성' AS clue, voice AS observed, CASE WHEN voice IS NULL THEN 'unverified' WHEN voice = '여성' THEN 'match' ELSE 'partial' END AS status FROM p
UNION ALL SELECT query_id, id, 1, 'genre', 'tin', CASE WHEN tin THEN 'tin' ELSE 'other' END, CASE WHEN tin THEN 'match' ELSE 'conflict' END FROM p)
SELECT query_id, id, position, slot, clue, observed, status FROM c""")
def x_clue_checks(spark, d):
    i = F.col("p_partkey")
    rows = t(spark, d, "part").select(F.col("p_brand").alias("query_id"), i.alias("id"), F.when(i % 3 == 0, "여성").when(i % 3 == 1, "혼성").alias("voice"), F.when(F.contains("p_type", F.lit("TIN")), "tin").otherwise("other").alias("genre"))
    return explain.clue_checks(rows, {"voice": (F.lit("여성"), F.col("voice"), F.col("voice") == "혼성"), "genre": (F.lit("tin"), F.col("genre"), F.lit(False)), "era": (F.lit(None).cast("string"), F.col("genre"), F.lit(False))})


@query("""WITH p AS (SELECT p_brand AS query_id, p_partkey AS id, p_partkey % 3 = 0 AS voice, p_type LIKE '%TIN%' AS tin FROM part),
n AS (SELECT *, sum(voice::INT) OVER w AS nv, sum(tin::INT) OVER w AS nt FROM p WINDOW w AS (PARTITION BY query_id))
SELECT query_id, id, concat_ws(' ', CASE WHEN voice OR tin THEN 'Fits what you said: ' || CASE WHEN voice AND tin THEN CASE WHEN nt < nv THEN 'genre tin, voice 여성' ELSE 'voice 여성, genre tin' END WHEN voice THEN 'voice 여성' ELSE 'genre tin' END || '.' END, CASE WHEN NOT voice THEN 'Differs: voice is 남성, not 여성.' WHEN NOT tin THEN 'Differs: genre is other, not tin.' END) AS summary FROM n""")
def x_summaries(spark, d):
    i = F.col("p_partkey")
    rows = t(spark, d, "part").select(F.col("p_brand").alias("query_id"), i.alias("id"), F.when(i % 3 == 0, "여성").otherwise("남성").alias("voice"), F.when(F.contains("p_type", F.lit("TIN")), "tin").otherwise("other").alias("genre"))
    checks = explain.clue_checks(rows, {"voice": (F.lit("여성"), F.col("voice"), F.lit(False)), "genre": (F.lit("tin"), F.col("genre"), F.lit(False))})
    return explain.summaries(checks)
