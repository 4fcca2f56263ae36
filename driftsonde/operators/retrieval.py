"""A whole search, from analysed queries to ranked and explained rows, for any number of queries at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftsonde.operators import bm25, boosts, fusion, paths, surface
from driftsonde.operators import search as vectors
from driftsonde.sources.steps import materialise


@dataclass(frozen=True)
class Corpus:
    """What is searched: items (id and payload columns that boosts read), passages (id, text), and what else there is."""

    items: DataFrame
    passages: DataFrame
    text_vectors: DataFrame
    image_vectors: DataFrame | None = None
    audio_vectors: DataFrame | None = None
    lyrics: DataFrame | None = None


@dataclass(frozen=True)
class Config:
    """Widths, scales and hooks of a search."""

    top_k: int = 10
    candidate_k: int | None = None
    path_k: int | None = None
    audio_scale: float = 1.0
    boost_scales: dict[str, float] = field(default_factory=dict)
    auxiliary: dict[str, float] = field(default_factory=dict)
    lyric_scale: float = 1.0
    protect_from: float = 0.80
    tokenizer: Callable = bm25.terms
    #: (query_id, id, retrieval) to (query_id, id, judged); rows it leaves out stay behind the judged ones.
    reranker: Callable[[DataFrame], DataFrame] | None = None


#: Columns that a search reads of its queries, with what stands for a missing one.
DEFAULTS = {
    "query": "string", "alpha": "double", "w_text": "double", "w_image": "double", "w_audio": "double", "text_vector": "array<double>",
    "image_vector": "array<double>", "audio_vector": "array<double>", "image_query": "string", "audio_query": "string", "lyric_query": "string",
    "visual": "boolean", "exact_lyric": "boolean", "lexical_lyric": "boolean", "intent": "string", "forced": "array<double>", "exact_terms": "array<string>",
    "phonetic_terms": "array<string>", "tags": "array<string>", "aliases": "array<string>", "title": "string", "artist": "string", "lyric_meaning": "string",
    "phrases": "array<struct<phrase:string,kind:string,confidence:double>>", "want_title": "string", "want_artist": "string", "want_voice": "string", "want_genre": "string",
    "keywords": "array<string>", "clues": "array<struct<kind:string,text:string,variants:array<string>,confidence:double>>",
    "title_constraints": "struct<script:string,char_count:int,word_count:int,contains_number:boolean,repeated_char:boolean,repeated_word:boolean,confidence:double>",
    "meaning": "struct<kind:string,confidence:double>", "era": "struct<start:int,end:int,confidence:double>", "types": "struct<values:array<string>,confidence:double>",
    "performance": "struct<count:string,roles:array<string>,sounds:array<string>,confidence:double>",
}
#: Payload columns that boosts read of an item.
PAYLOAD = {"title": "string", "artist": "string", "vocal_gender": "string", "genre": "string", "artist_types": "array<string>", "release_date": "string", "lyrics_highlight": "string", "lyrics_summary": "string", "clue_text": "string"}
_FILLED = {"alpha": 0.5, "w_text": 1.0, "w_image": 0.0, "w_audio": 0.0, "visual": False, "exact_lyric": False, "lexical_lyric": False}


def _complete(rows: DataFrame, columns: dict[str, str], filled: dict) -> DataFrame:
    have = set(rows.columns)
    value = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    return rows.withColumns({c: F.coalesce(value(c, kind), F.lit(filled[c])) if c in filled else value(c, kind) for c, kind in columns.items()})


def _dense(rows: DataFrame, used: str, column: str, corpus: DataFrame | None, k: int, path: str) -> DataFrame | None:
    if corpus is None:
        return None
    asked = rows.where(F.col(used) & F.col(column).isNotNull()).select("query_id", F.col(column).alias("query"))
    return vectors.dense_topk(asked, corpus, k, "cosine").select("query_id", F.lit(path).alias("path"), "id", "rank")


def search(queries: DataFrame, corpus: Corpus, config: Config | None = None, rejected: DataFrame | None = None, supplement: DataFrame | None = None, auxiliary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, ledger) of analysed queries (query_id and any of the columns in DEFAULTS).

    results: query_id, id, rank, score, retrieval_rank. ledger: query_id, id, kind, name, delta, dropped; live paths and rules
    add up to the score before reranking. Steps: weights by what a query holds, text by hybrid sums, image and audio by
    cosine, weighted reciprocal rank fusion, lyric finds and auxiliary paths (`auxiliary`: query_id, path, id, rank,
    confidence, strength), explicit boosts, rejected rows (query_id, id) out before the cut, exact lyrics first, rows
    from feedback (`supplement`: query_id, id, extra_rank) at the tail, and the reranker. Lists, pool and results are
    written to the shared folder, as several steps read them.
    """
    config = config or Config()
    rows = paths.path_weights(_complete(queries, DEFAULTS, _FILLED), config.audio_scale)
    rows = paths.text_plan(rows)
    width = paths.candidate_widths(config.top_k, config.candidate_k, 0, config.path_k)
    # Rejected rows leave before the cut; lists are longer by as many as any query rejects.
    extra = 0 if rejected is None else rejected.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    depth = min(paths.DEEPEST, max(width["fusion"], width["candidates"] + extra))

    rows = materialise(rows, "queries")
    sparse = bm25.Scores(rows.select("query_id", F.col("sparse_text").alias("text")), corpus.passages, tokenizer=config.tokenizer)
    text = vectors.hybrid_topk(rows.select("query_id", F.col("text_vector").alias("query"), "text_alpha"), corpus.text_vectors, sparse, "text_alpha", depth)
    lists = [text.select("query_id", F.lit("text").alias("path"), "id", "rank"), _dense(rows, "use_image", "image_vector", corpus.image_vectors, depth, "image"), _dense(rows, "use_audio", "audio_vector", corpus.audio_vectors, depth, "audio")]
    weights = rows.select("query_id", F.explode(F.create_map(*(x for p in ("text", "image", "audio") for x in (F.lit(p), F.col(p))))).alias("path", "weight"))
    ranked = None
    for one in (x for x in lists if x is not None):
        ranked = one if ranked is None else ranked.unionByName(one)
    ranked = ranked.join(weights, ["query_id", "path"])
    if rejected is not None:
        ranked = ranked.join(rejected.select("query_id", "id"), ["query_id", "id"], "left_anti")
    ranked = materialise(ranked, "ranked")
    kept = fusion.rrf_by_query(ranked, ["text", "image", "audio"])
    deltas = ranked.where("weight > 0").select("query_id", "id", F.lit("path").alias("kind"), F.col("path").alias("name"), (F.col("weight") / (F.lit(fusion.RRF_K) + F.col("rank"))).alias("delta"))
    scores = kept.select("query_id", "id", "score")

    found = None
    if corpus.lyrics is not None:
        said = rows.select("query_id", F.explode("phrases").alias("p")).select("query_id", "p.*")
        said = said.select(F.xxhash64("query_id", "phrase").alias("phrase_id"), "query_id", "phrase", "confidence").dropDuplicates(["phrase_id"])
        hits = surface.phrase_matches(said.select("phrase_id", "phrase", "confidence"), corpus.lyrics).join(said.select("phrase_id", "query_id"), "phrase_id")
        near = surface.fuzzy_matches(said.select("phrase_id", "phrase", "confidence"), corpus.lyrics).join(said.select("phrase_id", "query_id"), "phrase_id")
        near = near.join(hits.select("phrase_id", "id"), ["phrase_id", "id"], "left_anti").select("phrase_id", "id", F.lit("fuzzy").alias("kind"), "score", "query_id")
        found = surface.best_clue(hits.select("phrase_id", "id", "kind", "score", "query_id").unionByName(near))
        if rejected is not None:
            found = found.join(rejected.select("query_id", "id"), ["query_id", "id"], "left_anti")
        by = Window.partitionBy("query_id").orderBy(F.when(F.col("kind") == "exact", 0).otherwise(1), F.desc("score"), "id")
        found = materialise(found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= depth), "lyrics")
        lyric = found.select("query_id", "id", (fusion.lyric_boost(F.col("kind"), F.col("score"), F.col("rank")) * config.lyric_scale).alias("delta"))
        deltas = deltas.unionByName(lyric.select("query_id", "id", F.lit("path").alias("kind"), F.lit("lyrics_surface").alias("name"), "delta"))
    if auxiliary is not None:
        more = paths.auxiliary_contributions(auxiliary, config.auxiliary)
        deltas = deltas.unionByName(more.select("query_id", "id", F.lit("path").alias("kind"), F.col("path").alias("name"), "delta"))
    if found is not None or auxiliary is not None:
        added = deltas.where(~F.col("name").isin("text", "image", "audio")).groupBy("query_id", "id").agg(F.array_sort(F.collect_list(F.struct("name", "delta"))).alias("_d"))
        both = scores.join(added, ["query_id", "id"], "full")
        total = F.aggregate(F.coalesce("_d", F.array().cast("array<struct<name:string,delta:double>>")), F.coalesce("score", F.lit(0.0)), lambda acc, x: acc + x["delta"])
        scores = both.select("query_id", "id", total.alias("score"))

    asked = rows.select("query_id", *(c for c in ("want_title", "want_artist", "want_voice", "want_genre", "keywords", "clues", "title_constraints", "meaning", "era", "types", "performance")))
    payload = _complete(corpus.items, PAYLOAD, {}).select("id", *PAYLOAD)
    matched = found.select("query_id", "id", F.col("kind").alias("lyric_match_type"), F.col("score").alias("lyric_score")) if found is not None else None
    cand = scores.join(asked, "query_id").join(payload, "id")
    cand = cand.join(matched, ["query_id", "id"], "left") if matched is not None else cand.withColumns({"lyric_match_type": F.lit(None).cast("string"), "lyric_score": F.lit(None).cast("double")})
    cand = boosts.apply_boosts(cand, **config.boost_scales).withColumn("tier", boosts.exact_lyric_tier())
    rules = [c for c in cand.columns if c.startswith("boost_")]
    order = Window.partitionBy("query_id").orderBy(F.desc("boosted"), F.desc("score"), "id")
    pool = cand.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= width["candidates"])
    pool = materialise(pool.select("query_id", "id", "boosted", "tier", "lyric_match_type", "lyric_score", "_place", *rules), "pool")
    protected = F.coalesce((F.col("lyric_match_type") == "exact") & (F.col("lyric_score") >= config.protect_from), F.lit(False))
    base = fusion.protect(pool.select("query_id", "id", F.col("boosted").alias("score"), F.col("_place").alias("rank"), protected.alias("protected"), "tier"), width["candidates"])
    base = base.select("query_id", "id", "score", F.col("new_rank").alias("rank"), "protected")

    results = base.select("query_id", "id", "score", "rank")
    if supplement is not None:
        entered = fusion.supplement(results, supplement, 3, 1.0, width["candidates"])
        results = paths.pin_last(entered.select("query_id", "id", "score", "rank"), entered.where("is_new").select("query_id", "id", F.col("rank").alias("place"))).select("query_id", "id", "score", "rank")
    results = results.withColumn("retrieval_rank", F.col("rank"))
    if config.reranker is not None:
        judged = config.reranker(results.select("query_id", "id", F.col("score").alias("retrieval")))
        blended = fusion.rerank_blend(results.select("query_id", "id", F.col("score").alias("retrieval")).join(judged.select("query_id", "id", "judged"), ["query_id", "id"], "left"))
        results = results.drop("score", "rank").join(blended, ["query_id", "id"])
    results = results.where(F.col("rank") <= config.top_k).select("query_id", "id", "rank", "score", "retrieval_rank")

    results = materialise(results, "results")
    told = pool.select("query_id", "id", F.explode(F.create_map(*(x for c in rules for x in (F.lit(c.removeprefix("boost_")), F.col(c))))).alias("name", "delta")).where("delta <> 0")
    inside = pool.select("query_id", "id", F.lit(False).alias("dropped"))
    ledger = deltas.join(inside, ["query_id", "id"]).unionByName(told.select("query_id", "id", F.lit("rule").alias("kind"), "name", "delta", F.lit(False).alias("dropped")))
    moved = base.join(pool.select("query_id", "id", "_place"), ["query_id", "id"]).where("protected and rank < _place")
    ledger = ledger.unionByName(moved.select("query_id", "id", F.lit("order").alias("kind"), F.lit("lyric_protected").alias("name"), F.lit(0.0).alias("delta"), F.lit(False).alias("dropped")))
    return results, ledger
