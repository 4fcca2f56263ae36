"""Which search paths a query opens, how deep and how heavy they are, and what auxiliary paths add after fusion.

Queries are rows; what an analysis said of them are columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftsonde.operators.fusion import RRF_K, era_similarity

#: Most candidates that any list holds.
DEEPEST = 100


def candidate_widths(top_k: int, candidate_k: int | None = None, n_rejected: int = 0, path_k: int | None = None, deep: bool = False, default: int = 30) -> dict[str, int]:
    """Candidates kept, the pool before rejected ones leave, the depth of fusion and of paths that look deeper."""
    candidates = min(DEEPEST, max(top_k, candidate_k or max(top_k * 3, default)))
    pool = min(DEEPEST, candidates + n_rejected)
    return {"candidates": candidates, "pool": pool, "fusion": max(pool, path_k or 0), "deep": min(DEEPEST, max(candidates * 3, 60, pool)) if deep else pool}


def _filled(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def path_weights(queries: DataFrame, audio_scale: float = 1.0) -> DataFrame:
    """Add use_image, use_audio and the fusion weights text, image, audio that sum to 1.

    Columns read: w_text, w_image, w_audio, image_query, audio_query, lyric_query (texts), visual, exact_lyric,
    lexical_lyric (booleans), intent, and forced (array of three, or null). Image needs a visual clue, audio no exact
    lyric, both a query text and a weight. Mixed queries about a lyric's meaning that use audio but not image hold text at
    .60 or more and audio at .40 or less. Forced weights skip these rules but not the query texts. No weight at all is text
    alone.
    """
    forced, has = F.col("forced"), lambda c: _filled(F.col(c))
    given = forced.isNotNull()
    image = F.when(given, (forced[1] > 0) & has("image_query")).otherwise(F.col("visual") & has("image_query") & (F.col("w_image") > 0))
    audio = F.when(given, (forced[2] > 0) & has("audio_query")).otherwise(~F.col("exact_lyric") & has("audio_query") & (F.col("w_audio") > 0) & F.lit(audio_scale > 0))
    rows = queries.withColumns({"use_image": F.coalesce(image, F.lit(False)), "use_audio": F.coalesce(audio, F.lit(False))})
    mixed = ~given & (F.col("intent") == "mixed") & has("lyric_query") & ~F.col("lexical_lyric") & F.col("use_audio") & ~F.col("use_image")
    text = F.when(given, forced[0]).when(mixed, F.greatest("w_text", F.lit(0.60))).otherwise(F.col("w_text"))
    pictured = F.when(F.col("use_image"), F.when(given, forced[1]).otherwise(F.col("w_image"))).otherwise(0.0)
    heard = F.when(F.col("use_audio"), F.when(given, forced[2]).otherwise(F.when(mixed, F.least(F.col("w_audio") * audio_scale, F.lit(0.40))).otherwise(F.col("w_audio") * audio_scale))).otherwise(0.0)
    rows = rows.withColumns({"_t": text, "_i": pictured, "_a": heard})
    total = F.col("_t") + F.col("_i") + F.col("_a")
    share = lambda c, alone: F.when(total > 0, F.col(c) / total).otherwise(alone)
    return rows.withColumns({"text": share("_t", 1.0), "image": share("_i", 0.0), "audio": share("_a", 0.0)}).drop("_t", "_i", "_a")


@dataclass(frozen=True)
class Auxiliary:
    """What a path adds to a row after fusion: weight (times confidence, times strength) / (60 + rank)."""

    weight: float
    by_confidence: bool = False
    by_strength: bool = False


#: The auxiliary paths in the order in which they add.
AUXILIARY = {
    "title": Auxiliary(0.35, by_confidence=True),
    "title_presence": Auxiliary(0.35, by_confidence=True),
    "title_meaning": Auxiliary(0.50, by_confidence=True),
    "balanced_semantic": Auxiliary(0.30),
    "performance": Auxiliary(0.55, by_confidence=True, by_strength=True),
    "performance_metadata": Auxiliary(0.5, by_confidence=True),
    "attr_filter": Auxiliary(0.0),
    "metadata": Auxiliary(0.20, by_strength=True),
    "work_name": Auxiliary(0.5),
}


def auxiliary_contributions(hits: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, path, id, rank, confidence, strength) to (query_id, id, path, delta); paths of weight 0 and unknown ones add nothing.

    Only paths of the status `applied` are to be passed for `work_name`.
    """
    rules = {p: Auxiliary((weights or {}).get(p, a.weight), a.by_confidence, a.by_strength) for p, a in AUXILIARY.items()}
    delta = F.lit(None).cast("double")
    for path, a in reversed(list(rules.items())):
        value = F.lit(float(a.weight))
        if a.by_confidence:
            value = value * F.coalesce("confidence", F.lit(0.0))
        if a.by_strength:
            value = value * F.coalesce("strength", F.lit(0.0))
        delta = F.when(F.col("path") == path, value / (F.lit(RRF_K) + F.col("rank"))).otherwise(delta)
    return hits.select("query_id", "id", "path", delta.alias("delta")).where("delta <> 0")


def add_contributions(fused: DataFrame, deltas: DataFrame) -> DataFrame:
    """Fused scores (query_id, id, score) with contributions (query_id, id, path, delta) added; new ids enter with what they are given. Sums run over paths in their fixed order."""
    order = {p: i for i, p in enumerate(AUXILIARY)}
    parts = [F.coalesce(F.sum(F.when(F.col("path") == p, F.col("delta"))), F.lit(0.0)) for p in order]
    added = deltas.groupBy("query_id", "id").agg(*(x.alias(f"_{i}") for i, x in enumerate(parts)))
    both = fused.select("query_id", "id", "score").join(added, ["query_id", "id"], "full")
    total = F.coalesce("score", F.lit(0.0))
    for i in range(len(parts)):
        total = total + F.coalesce(F.col(f"_{i}"), F.lit(0.0))
    return both.select("query_id", "id", total.alias("score"))


def metadata_strength(year: Column, start: Column, end: Column, era_confidence: Column, types: Column, wanted: Column, type_confidence: Column) -> Column:
    """Era similarity and whether any artist type is among the wanted ones, each by its confidence."""
    era = era_similarity(year, start, end) * F.coalesce(era_confidence, F.lit(0.0))
    kind = F.coalesce(F.arrays_overlap(types, wanted), F.lit(False)).cast("double") * F.coalesce(type_confidence, F.lit(0.0))
    return F.coalesce(era, F.lit(0.0)) + kind


def strongest(hits: DataFrame, most: int = 15, candidates: int = 30) -> DataFrame:
    """(query_id, id, rank, strength) above 0: the strongest, then those ranked first, of which a new rank is made."""
    w = Window.partitionBy("query_id").orderBy(F.desc("strength"), "rank", "id")
    return hits.where("strength > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= min(most, candidates))


def best_strength(lists: DataFrame, least: float = 0.25, most: int = 15, candidates: int = 30) -> DataFrame:
    """(query_id, list_no, id, rank, strength) of several lists: each id where it is strongest, then first; places of later lists come 100 behind."""
    place = F.col("rank") + 100 * F.col("list_no")
    rows = lists.where(F.col("strength") >= least).withColumn("place", place)
    one = rows.groupBy("query_id", "id").agg(F.max(F.struct("strength", (-F.col("place")).alias("place"))).alias("_b"))
    one = one.select("query_id", "id", F.col("_b.strength").alias("strength"), (-F.col("_b.place")).alias("place"))
    w = Window.partitionBy("query_id").orderBy(F.desc("strength"), "place", "id")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= min(most, candidates))


def context_weight(weight: Column, confidence: Column, grounded: Column, named: Column, multiplier: float = 2.0) -> Column:
    """A context path's weight: by its best clue's confidence, more if a named and grounded one is among them."""
    return weight * confidence * F.when(grounded & named, F.lit(multiplier)).otherwise(1.0)


def pin_last(ranked: DataFrame, entrants: DataFrame, step: float = 1e-6) -> DataFrame:
    """(query_id, id, score, rank) with the entrants (query_id, id, place) behind all others, in their order.

    Going down from the last other's score, each entrant has at most the one before it less a share of `step`. Queries
    with entrants alone stay as they are. A query's entrants are few, so that they are folded in one row.
    """
    rows = ranked.join(entrants.select("query_id", "id", "place"), ["query_id", "id"], "left")
    entered = F.col("place").isNotNull()
    last = F.max(F.when(~entered, F.struct("rank", "score")))["score"]
    moved = F.array_sort(F.collect_list(F.when(entered, F.struct("place", "id", "score"))))
    start = F.struct(F.col("_last").alias("low"), F.array().cast("array<struct<id:bigint,pinned:double>>").alias("out"))

    def down(acc: Column, x: Column) -> Column:
        low = F.least(x["score"], acc["low"] - F.greatest(F.abs(acc["low"]), F.lit(1e-12)) * step)
        return F.struct(low.alias("low"), F.concat(acc["out"], F.array(F.struct(x["id"].cast("bigint").alias("id"), low.alias("pinned")))).alias("out"))

    folded = rows.groupBy("query_id").agg(last.alias("_last"), moved.alias("_moved")).where("_last is not null and size(_moved) > 0")
    folded = folded.select("query_id", F.explode(F.aggregate("_moved", start, down, lambda acc: acc["out"])).alias("p")).select("query_id", "p.*")
    out = rows.join(folded, ["query_id", "id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.col("pinned").isNotNull(), F.when(F.col("pinned").isNotNull(), F.col("place")), "rank")
    return out.select("query_id", "id", F.coalesce("pinned", "score").alias("score"), F.row_number().over(order).alias("rank"), F.col("place").isNotNull().alias("is_entrant"))


def skip_rerank(image_weight: Column, visual: Column, unverifiable: Column, heavy: float = 0.70) -> Column:
    """Why a query's candidates aren't reranked, null if they are: its image rules, or nothing in the catalogue could confirm its scene."""
    return F.when(visual & (image_weight >= heavy), "image_dominant").when(unverifiable, "unverifiable_scene")


def lyric_anchor_first(ranked: DataFrame, sure: float = 0.70) -> DataFrame:
    """(query_id, id, retrieval_rank, rank, kind, score): the row that retrieval had first comes first again if the lyric found it.

    An exact find does; a phonetic one does if its score is at least `sure` or no other row was found by the lyric.
    """
    by = Window.partitionBy("query_id")
    found = F.coalesce(F.col("kind").isin("exact", "phonetic"), F.lit(False))
    others = F.max(F.when(found & (F.col("retrieval_rank") > 1), 1).otherwise(0)).over(by)
    strong = (F.col("kind") == "exact") | ((F.col("kind") == "phonetic") & (F.coalesce(F.col("score") >= sure, F.lit(False)) | (others == 0)))
    rows = ranked.withColumn("_first", F.coalesce((F.col("retrieval_rank") == 1) & strong, F.lit(False)))
    return rows.select("query_id", "id", "rank", F.row_number().over(by.orderBy(F.desc("_first"), "rank")).alias("new_rank"))


def title_shape_rescue(ranked: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, rank, fits): rows behind the first k whose title fits take the places of the last rows within k that don't; all else stays in order."""
    by = Window.partitionBy("query_id")
    inside = F.col("rank") <= k
    rows = ranked.withColumns({"_up": F.sum((~inside & F.col("fits")).cast("int")).over(by), "_down": F.sum((inside & ~F.col("fits")).cast("int")).over(by)})
    rows = rows.withColumn("_n", F.least("_up", "_down"))
    behind = F.row_number().over(Window.partitionBy("query_id", inside, "fits").orderBy("rank"))
    from_end = F.row_number().over(Window.partitionBy("query_id", inside, "fits").orderBy(F.desc("rank")))
    rows = rows.withColumns({"_promoted": ~inside & F.col("fits") & (behind <= F.col("_n")), "_dropped": inside & ~F.col("fits") & (from_end <= F.col("_n"))})
    part = F.when(F.col("_promoted"), 1).when(F.col("_dropped"), 2).when(inside, 0).otherwise(3)
    return rows.select("query_id", "id", "rank", F.row_number().over(by.orderBy(part, "rank")).alias("new_rank"))


def rare_fact_rescue(ranked: DataFrame, least_support: float = 0.86, least_confidence: float = 0.78, margin: float = 0.06, place: int = 9) -> DataFrame:
    """(query_id, id, rank, support, n_matched, n_against, needed, confidence): the row that checks bear out best moves up to `place`.

    It needs enough support and matched clues, at most one contradiction unless support is .94, and a lead of `margin` over
    every other row, eligible or not. Rows already there don't move.
    """
    by = Window.partitionBy("query_id")
    support = F.coalesce("support", F.lit(0.0))
    fit = (F.col("confidence") >= least_confidence) & (support >= least_support) & (F.col("n_matched") >= F.col("needed")) & ~((F.col("n_against") >= 2) & (support < 0.94))
    rows = ranked.withColumns({"_s": support, "_fit": F.coalesce(fit, F.lit(False))})
    best = F.max(F.when(F.col("_fit"), F.struct("_s", F.col("id").cast("string").alias("t")))).over(by)
    rows = rows.withColumn("_best", F.coalesce((best["_s"] == F.col("_s")) & (best["t"] == F.col("id").cast("string")) & F.col("_fit"), F.lit(False)))
    second = F.max(F.when(~F.col("_best"), F.col("_s"))).over(by)
    rows = rows.withColumn("_up", F.col("_best") & (F.col("_s") - F.coalesce(second, F.lit(0.0)) >= margin) & (F.col("rank") > place))
    order = F.when(F.col("_up"), F.lit(place) - 0.5).otherwise(F.col("rank").cast("double"))
    return rows.select("query_id", "id", "rank", F.row_number().over(by.orderBy(order)).alias("new_rank"))


def listwise_fuse(rows: DataFrame, base: float = 0.85, sure: float = 0.55) -> DataFrame:
    """(query_id, id, retrieval, rank_score, relevance, confidence) to a score: .7 rank + .3 relevance, by a weight that falls with confidence, and min-maxed retrieval for the rest."""
    from driftsonde.operators.fusion import listwise_weight, minmax

    judged = 0.7 * F.col("rank_score") + 0.3 * F.col("relevance")
    w = listwise_weight(F.col("confidence"), base, sure)
    return rows.withColumn("_r", minmax("retrieval")).select("query_id", "id", (w * judged + (1 - w) * F.col("_r")).alias("score"))


def text_plan(queries: DataFrame, source: str = "tags") -> DataFrame:
    """Texts and alpha of the text path: sparse_text, dense_text, text_alpha.

    Columns read: query, alpha, exact_terms, phonetic_terms, tags, aliases (arrays), title, artist, lyric_meaning. Exact
    lyric terms alone make the sparse text and hold alpha at .10 or less; phonetic ones join the tags and hold it at .50 to
    .60; else the tags do, or the query itself, or both (`source`). Title, artist and aliases follow. Without exact terms
    the dense text goes on with the lyric's meaning and its possible spellings.
    """
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(F.col(c), none)
    exact, phonetic = F.size(listed("exact_terms")) > 0, F.size(listed("phonetic_terms")) > 0
    plain = {"query": F.array("query"), "both": F.concat(listed("tags"), F.array("query"))}.get(source, listed("tags"))
    head = F.when(exact, listed("exact_terms")).when(phonetic, F.array_distinct(F.concat(listed("phonetic_terms"), listed("tags")))).otherwise(plain)
    words = F.filter(F.concat(head, F.array("title", "artist"), listed("aliases")), lambda x: F.coalesce(x != "", F.lit(False)))
    alpha = F.when(exact, F.least("alpha", F.lit(0.10))).when(phonetic, F.least(F.lit(0.60), F.greatest("alpha", F.lit(0.50)))).otherwise(F.col("alpha"))
    meaning = F.when(~exact & _filled(F.col("lyric_meaning")), F.concat(F.lit("lyric meaning: "), "lyric_meaning"))
    spelled = F.when(~exact & phonetic, F.concat(F.lit("heard as: "), F.array_join("phonetic_terms", " / ")))
    sparse = F.coalesce(F.nullif(F.array_join(words, " "), F.lit("")), F.col("query"))
    return queries.withColumns({"sparse_text": sparse, "dense_text": F.concat_ws("\n", "query", meaning, spelled), "text_alpha": alpha})


#: Alpha of the other text paths, as (lowest, highest); null leaves it as it is.
PATH_ALPHA = {"balanced": (0.60, 0.60), "performance": (0.45, 0.60), "performance_metadata": (1.0, 1.0), "title_meaning": None, "title": None, "title_presence": None}


def path_alpha(path: str, alpha: Column) -> Column:
    bounds = PATH_ALPHA[path]
    return alpha if bounds is None else F.least(F.lit(bounds[1]), F.greatest(alpha, F.lit(bounds[0])))


#: Sounds so rare that one alone opens the performance path.
RARE_SOUNDS = ("휘파람", "비프음", "벨소리", "박수", "핑거스냅", "사이렌", "전화음", "자연음", "인도풍", "중동풍", "국악")
#: Words that name a genre in a query.
GENRE_WORDS = ("힙합", "랩", "발라드", "록 음악", "록 느낌", "록밴드", "락 음악", "락 느낌", "락밴드", "재즈", "알앤비", "r&b", "댄스", "트로트", "메탈", "포크", "클래식")


def _some(c: Column) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def composite_performance(count: Column, roles: Column, sounds: Column, confidence: Column) -> Column:
    """Whether performance clues carry a path of their own: a rare sound, two of the three kinds, or two roles."""
    said = F.coalesce(confidence > 0, F.lit(False))
    counted = _filled(count)
    rare = F.coalesce(F.arrays_overlap(sounds, F.array(*map(F.lit, RARE_SOUNDS))), F.lit(False))
    return said & (rare | (counted & _some(roles)) | (_some(roles) & _some(sounds)) | (counted & _some(sounds)) | F.coalesce(F.size(roles) >= 2, F.lit(False)))


def balanced_recall(query: Column, lyric_meaning: Column, lexical: Column, alpha: Column, has_era: Column, has_type: Column, sounds: Column, genre: Column) -> Column:
    """Whether a second look at alpha .60 is due: a lyric's meaning without its words, with era, artist type, sounds and a genre all said, on the dense side."""
    named = _filled(genre) | F.exists(F.array(*map(F.lit, GENRE_WORDS)), lambda w: F.contains(F.lower(query), w))
    return _filled(lyric_meaning) & ~lexical & (alpha > 0.60) & has_era & has_type & _some(sounds) & F.coalesce(named, F.lit(False))


def clue_flags(kinds: Column, keywords: Column, lyric_meaning: Column) -> dict[str, Column]:
    """What lyric clues (their kinds) and keywords amount to."""
    any_of = lambda *names: F.coalesce(F.exists(kinds, lambda k: k.isin(*names)), F.lit(False))
    lexical = _some(keywords) | any_of("verbatim", "partial", "phonetic")
    return {
        "lexical_lyric": lexical,
        "exact_lyric": _some(keywords) | any_of("verbatim", "partial"),
        "phonetic_lyric": any_of("phonetic"),
        "any_lyric": lexical | _filled(lyric_meaning) | any_of("semantic"),
    }
