"""Narrowing by questions: which slot to ask, what an answer adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftsonde.functions import text as T
from driftsonde.functions.linking import canonical_types
from driftsonde.operators.filters import FEMALE, MALE, MIXED
from driftsonde.operators.fusion import UNIT
from driftsonde.operators.metrics import discrimination

#: What an answer may say of voices and artist types, and how sure an answer is.
VOICES, TYPES, SURE = (MALE, FEMALE, MIXED), ("솔로", "그룹", "듀오", "밴드"), 1.0


def slot_values(pool: DataFrame, slots: list[str]) -> DataFrame:
    """(query_id, id, slot, value): candidates' values in long form, first part of comma lists."""
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("slot"), F.nullif(F.trim(F.split(F.col(s).cast("string"), ",")[0]), F.lit("")).alias("value")) for s in slots)))
    return pool.select("query_id", "id", pairs.alias("p")).select("query_id", "id", "p.slot", "p.value")


def askable(values: DataFrame, least_coverage: float = 0.6, least_discrimination: float = 0.15) -> DataFrame:
    """(query_slot, ...) measures of each query's slots and whether they are worth a question."""
    keyed = values.withColumn("_key", F.struct("query_id", "slot"))
    out = discrimination(keyed, "_key", "value").select("_key.*", "n_values", "coverage", "discrimination")
    return out.withColumn("askable", (F.col("n_values") >= 2) & (F.col("coverage") >= least_coverage) & (F.col("discrimination") >= least_discrimination))


def questions(values: DataFrame, priority: list[str], asked: DataFrame | None = None) -> DataFrame:
    """One question a query: the first askable slot by priority, its options by number, then name."""
    slots = askable(values).where("askable")
    if asked is not None:
        slots = slots.join(asked, ["query_id", "slot"], "left_anti")
    order = F.array_position(F.array(*map(F.lit, priority)), F.col("slot"))
    first = slots.groupBy("query_id").agg(F.min_by("slot", order).alias("slot"))
    options = values.where("value is not null").join(first, ["query_id", "slot"]).groupBy("query_id", "slot", "value").count()
    listed = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "value")))
    return options.groupBy("query_id", "slot").agg(F.transform(listed, lambda x: x["value"]).alias("options"))


def answer_bonus(ranked: DataFrame, answers: DataFrame, values: DataFrame, multiplier: float = 3.0) -> DataFrame:
    """Ranked rows (query_id, id, score, rank) with multiplier units for each answer (query_id, slot, answer) that they match, ranked anew; equal scores as before."""
    hits = values.join(answers, ["query_id", "slot"]).where(F.col("value") == F.col("answer")).groupBy("query_id", "id").agg(F.count("*").alias("hits"))
    rows = ranked.join(hits, ["query_id", "id"], "left").withColumn("bonus", F.coalesce("hits", F.lit(0)) * multiplier * UNIT).withColumn("new_score", F.col("score") + F.col("bonus"))
    w = Window.partitionBy("query_id").orderBy(F.desc("new_score"), "rank")
    return rows.withColumn("new_rank", F.row_number().over(w)).drop("hits")


def decade(text: Column) -> Column:
    """The decade of the first year from 1900 to 2099 that a text holds."""
    year = F.regexp_extract(F.coalesce(text, F.lit("")), r"((?:19|20)\d{2})", 1)
    return F.when(year != "", (F.floor(F.when(year != "", year).otherwise("0").cast("int") / 10) * 10).cast("int"))


def answer_matches(slot: Column, value: Column, skipped: Column, genre: Column, types: Column, release_date: Column, voice: Column) -> Column:
    """Whether a row bears out an answer: a genre by part, an artist type by its spellings, an era by decade, a voice exactly."""
    plain = lambda c: T.equality_key(F.coalesce(c, F.lit("")))
    said = F.trim(value)
    hit = (
        F.when(slot == "genre", F.contains(plain(genre), plain(said)))
        .when(slot.isin("type", "artist_type"), F.array_contains(canonical_types(types), said))
        .when(slot == "release_era", decade(said) == decade(release_date))
        .when(slot == "vocal_gender", F.trim(voice).isin(*VOICES) & (F.trim(voice) == said))
    )
    return F.coalesce(hit & ~F.coalesce(skipped, F.lit(False)) & (F.length(said) > 0), F.lit(False))


def _usable(slot: Column, value: Column) -> Column:
    """The answer's value where its slot can take it."""
    said = F.trim(value)
    good = (
        F.when(slot == "vocal_gender", said.isin(*VOICES))
        .when(slot == "genre", F.length(said) > 0)
        .when(slot.isin("type", "artist_type"), said.isin(*TYPES))
        .when(slot == "release_era", decade(said).isNotNull())
        .when(slot == "birth_year", T.birth_year(said).isNotNull())
    )
    return F.when(F.coalesce(good, F.lit(False)), said)


def merge_answers(analyses: DataFrame, answers: DataFrame) -> DataFrame:
    """Analyses (query_id, voice, genre, types, era_start, era_end, era_confidence, stage_from, stage_to, stage_confidence) with answers (query_id, position, slot, value, skipped) put in; later answers correct earlier ones.

    Skipped answers and values that a slot can't take say nothing. A birth year makes an era only where a stage of life is
    known and no era is.
    """
    fit = answers.where("not coalesce(skipped, false)").withColumn("said", _usable(F.col("slot"), F.col("value"))).where("said is not null")
    last = lambda *slots: F.max_by(F.when(F.col("slot").isin(*slots), F.col("said")), F.when(F.col("slot").isin(*slots), F.col("position")))
    by = fit.groupBy("query_id").agg(last("vocal_gender").alias("_voice"), last("genre").alias("_genre"), last("type", "artist_type").alias("_type"), last("release_era").alias("_era"), last("birth_year").alias("_birth"))
    rows = analyses.join(by, "query_id", "left")
    start = decade(F.col("_era"))
    window = T.birth_window(T.birth_year(F.col("_birth")), F.col("stage_from"), F.col("stage_to"))
    born = F.col("_birth").isNotNull() & F.col("stage_from").isNotNull() & F.col("era_start").isNull() & start.isNull()
    return rows.withColumns(
        {
            "voice": F.coalesce("_voice", "voice"),
            "genre": F.coalesce("_genre", "genre"),
            "types": F.when(F.col("_type").isNotNull(), F.array("_type")).otherwise(F.col("types")),
            "era_confidence": F.when(start.isNotNull(), SURE).when(born, F.col("stage_confidence")).otherwise(F.col("era_confidence")),
            "era_end": F.when(start.isNotNull(), start + 9).when(born, window["end"]).otherwise(F.col("era_end")).cast("int"),
            "era_start": F.coalesce(start, F.when(born, window["start"]), F.col("era_start")).cast("int"),
        }
    ).drop("_voice", "_genre", "_type", "_era", "_birth")


def answer_confirms(analyses: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers with `confirms`: whether one only repeats what the analysis says of its slot."""
    rows = answers.join(analyses, "query_id").withColumn("said", F.when(~F.coalesce("skipped", F.lit(False)), _usable(F.col("slot"), F.col("value"))))
    same = (
        F.when(F.col("slot") == "vocal_gender", F.col("said") == F.col("voice"))
        .when(F.col("slot") == "genre", F.col("said") == F.col("genre"))
        .when(F.col("slot").isin("type", "artist_type"), F.array("said") == F.col("types"))
        .when(F.col("slot") == "release_era", (decade(F.col("said")) == F.col("era_start")) & (F.col("era_end") == F.col("era_start") + 9))
    )
    return rows.select(*answers.columns, F.coalesce(same, F.lit(False)).alias("confirms"))


def may_ask(turn: Column, n_asked: Column, n_rejected: Column, top_k: Column, most_turns: int = 3, most_asked: int = 2, most_rejected: int = 30) -> Column:
    """Whether another question is allowed: turns and asked slots are few, and what the next one would reject still fits."""
    return (turn < most_turns) & (n_asked < most_asked) & (n_rejected + top_k <= most_rejected)


def reranker_order(before: DataFrame, after: DataFrame, mode: str = "bonus") -> DataFrame:
    """Candidates (query_id, id, score, rank) for a reranker that reads answers: after the answers' bonus, or before it (`pre_bonus`)."""
    if mode not in ("bonus", "pre_bonus"):
        raise ValueError(f"unknown order {mode}")
    return (after if mode == "bonus" else before).select("query_id", "id", "score", "rank")


#: Wrong answers that are near the truth.
WRONG_VOICE = {MALE: FEMALE, FEMALE: MALE, MIXED: FEMALE}


def true_answer(slot: Column, voice: Column, types: Column, genre: Column, release_date: Column) -> Column:
    """What someone who remembers the row rightly says of a slot; null if it has no value for it."""
    known = canonical_types(types)
    kind = F.try_element_at(F.filter(F.array(*map(F.lit, TYPES)), lambda x: F.array_contains(known, x)), F.lit(1))
    ten = decade(release_date)
    return (
        F.when(slot == "vocal_gender", F.when(voice.isin(*VOICES), voice))
        .when(slot == "type", kind)
        .when(slot == "genre", F.nullif(F.trim(F.split(genre, ",")[0]), F.lit("")))
        .when(slot == "release_era", F.when(ten.isNotNull(), F.concat(ten.cast("string"), F.lit("년대"))))
    )


def wrong_answer(slot: Column, voice: Column, types: Column, genre: Column, release_date: Column) -> Column:
    """What someone who remembers it wrongly says, always the same; null if there is nothing to be wrong about."""
    truth = true_answer(slot, voice, types, genre, release_date)
    turned = F.lit(None).cast("string")
    for right, wrong in WRONG_VOICE.items():
        turned = F.when(truth == right, wrong).otherwise(turned)
    known = canonical_types(types)
    kind = F.try_element_at(F.filter(F.array(*map(F.lit, TYPES)), lambda x: ~F.array_contains(known, x)), F.lit(1))
    ten = decade(release_date)
    return F.when(truth.isNotNull(), F.when(slot == "vocal_gender", turned).when(slot == "type", kind).when(slot == "genre", F.when(truth == "발라드", "댄스").otherwise("발라드")).when(slot == "release_era", F.concat(F.when(ten > 1990, ten - 10).otherwise(ten + 10).cast("string"), F.lit("년대"))))


def simulated_turns(ranked: DataFrame, values: DataFrame, targets: DataFrame, policies: list[str], priority: list[str], top_k: int = 10, turns: int = 3) -> DataFrame:
    """(query_id, policy, turn, rank, shown, answer_kind): dialogues over ranked rows (query_id, id, score, rank) with values (query_id, id, slot, value) and one target (query_id, target) each.

    Each turn shows the best `top_k` rows not shown yet, and ends when the target is among them. Policies: `reject` only
    says no; `skip` is asked and doesn't answer; `oracle` answers by the target's value, `noisy` by the most frequent other
    one. An answer adds its bonus to matching rows. Slots are asked by priority, each once.
    """
    base = ranked.join(targets, "query_id")
    out = []
    for policy in policies:
        left, bonus = base.withColumn("_bonus", F.lit(0.0)), None
        for turn in range(1, turns + 1):
            if turn > 1 and policy in ("oracle", "noisy") and turn - 2 < len(priority):
                slot = priority[turn - 2]
                own = values.where(F.col("slot") == slot).select("query_id", "id", "value").where("value is not null")
                truth = own.join(targets, "query_id").where("id = target").select("query_id", F.col("value").alias("_truth"))
                counts = own.join(left.select("query_id", "id"), ["query_id", "id"], "left_semi").groupBy("query_id", "value").count().join(truth, "query_id")
                said = truth.select("query_id", F.col("_truth").alias("_said")) if policy == "oracle" else counts.where("value <> _truth").groupBy("query_id").agg(F.max(F.struct("count", "value"))["value"].alias("_said"))
                hits = own.join(said, "query_id").where("value = _said").select("query_id", "id", F.lit(3.0 * UNIT).alias("_more"))
                left = left.join(hits, ["query_id", "id"], "left").withColumn("_bonus", F.col("_bonus") + F.coalesce("_more", F.lit(0.0))).drop("_more")
            order = Window.partitionBy("query_id").orderBy(F.desc(F.col("score") + F.col("_bonus")), "rank")
            placed = left.withColumn("_at", F.row_number().over(order))
            place = F.max(F.when(F.col("id") == F.col("target"), F.col("_at")))
            out.append(placed.groupBy("query_id").agg(place.alias("rank"), F.least(F.count("*"), F.lit(top_k)).cast("int").alias("shown")).select("query_id", F.lit(policy).alias("policy"), F.lit(turn).alias("turn"), "rank", "shown"))
            found = placed.where((F.col("id") == F.col("target")) & (F.col("_at") <= top_k)).select("query_id")
            left = placed.where(F.col("_at") > top_k).drop("_at").join(found, "query_id", "left_anti")
    every = out[0]
    for one in out[1:]:
        every = every.unionByName(one)
    return every


def best_oracle(results: DataFrame) -> DataFrame:
    """Results (query_id, policy, rank) with `oracle:best` added: the best of the policies that start with `oracle:`, first by name on ties."""
    oracles = results.where(F.col("policy").startswith("oracle:"))
    best = oracles.groupBy("query_id").agg(F.min_by("rank", F.struct(F.coalesce("rank", F.lit(10**6)), "policy")).alias("rank"))
    return results.select("query_id", "policy", "rank").unionByName(best.select("query_id", F.lit("oracle:best").alias("policy"), "rank"))


def fill_policies(results: DataFrame, policies: list[str]) -> DataFrame:
    """One row for each query and policy: what ran (`ran`), else what `reject_only` gave, else `initial`."""
    ids = results.select("query_id").distinct().withColumn("policy", F.explode(F.array(*map(F.lit, policies))))
    ran = results.select("query_id", "policy", "rank", F.lit(True).alias("ran"))
    other = results.groupBy("query_id").agg(F.max(F.when(F.col("policy") == "reject_only", F.struct("rank"))).alias("r"), F.max(F.when(F.col("policy") == "initial", F.struct("rank"))).alias("i"))
    rows = ids.join(ran, ["query_id", "policy"], "left").join(other, "query_id")
    return rows.select("query_id", "policy", F.when(F.coalesce("ran", F.lit(False)), F.col("rank")).otherwise(F.coalesce("r", "i")["rank"]).alias("rank"), F.coalesce("ran", F.lit(False)).alias("ran"))


def policy_means(rows: DataFrame) -> DataFrame:
    """(policy, n_queries, hit1, hit5, hit10, mrr10) of rows (query_id, policy, rank): means within each query first, then over queries, to 4 places."""
    hit = lambda k: F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double"))
    mrr = F.avg(F.when(F.col("rank") <= 10, 1 / F.col("rank")).otherwise(0.0))
    by = rows.groupBy("policy", "query_id").agg(hit(1).alias("hit1"), hit(5).alias("hit5"), hit(10).alias("hit10"), mrr.alias("mrr10"))
    return by.groupBy("policy").agg(F.count("*").alias("n_queries"), *(F.round(F.avg(c), 4).alias(c) for c in ("hit1", "hit5", "hit10", "mrr10")))
