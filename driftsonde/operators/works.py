"""Queries that describe a work without its name: the gate, the resolver's answers, and which of its works to trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftsonde.functions.unicode import nfkc

MOST_WORKS, MOST_ALIASES, MOST_ROWS = 3, 3, 200
#: Words of media, by kind; words of their use; negations that follow them.
KINDS = {"drama": ("드라마", "drama"), "film": ("영화", "film", "movie"), "variety": ("예능", "variety"), "audition": ("오디션", "경연", "audition"), "animation": ("애니메이션", "애니", "만화", "animation"), "webtoon": ("웹툰", "webtoon"), "musical": ("뮤지컬", "musical"), "documentary": ("다큐멘터리", "다큐", "documentary")}
USES = ("ost", "삽입곡", "주제곡", "주제가", "배경음악", "soundtrack", "theme")
NEGATIONS = ("말고", "아니고", "아닌", "not", "without")
_GENERIC = r"(?i)^(?:" + "|".join(w for words in KINDS.values() for w in words) + r"|작품|프로그램|방송)$"


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(nfkc(text)), r"[\s_]+", "")


def _pattern(words) -> str:
    return r"(?i)(" + "|".join(words) + ")"


_MEDIA = _pattern([w for words in KINDS.values() for w in words] + list(USES))
_NEGATED = _MEDIA + r"\s*(?:는|은|가|이|ost)?\s*(?:" + "|".join(NEGATIONS) + ")"


def gate(queries: DataFrame, named: str = "named") -> DataFrame:
    """Add `opened`, `reason`, `content`: whether a query (query, `named` an array of works that it names) describes an unnamed work.

    It must speak of a medium, not only to rule it out, name none, quote none beside it, and describe it by two words or
    more in the same clauses.
    """
    said = F.regexp_extract_all("query", F.lit(_MEDIA), F.lit(1))
    live = F.regexp_extract_all(F.regexp_replace("query", _NEGATED, " "), F.lit(_MEDIA), F.lit(1))
    quoted = F.col("query").rlike(r"(?i)[\"'“‘「『《<][^\"'”’」』》>]{2,40}[\"'”’」』》>]\s{0,2}" + _MEDIA + "|" + _MEDIA + r".{0,4}[\"'“‘「『《<][^\"'”’」』》>]{2,40}[\"'”’」』》>]")
    clauses = F.filter(F.split("query", r"[,.!?\n]+"), lambda c: c.rlike(_MEDIA))
    words = F.flatten(F.transform(clauses, lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]{2,})"), F.lit(1))))
    content = F.array_distinct(F.filter(words, lambda w: ~w.rlike(_MEDIA)))
    reason = (
        F.when(F.size(said) == 0, "no_media_word")
        .when(F.size(live) == 0, "media_negated")
        .when(F.coalesce(F.size(named) > 0, F.lit(False)), "explicit_work_named")
        .when(quoted, "quoted_work_name")
        .when(F.size(content) < 2, "no_description")
        .otherwise("indirect_description")
    )
    return queries.withColumns({"content": content, "reason": reason}).withColumn("opened", F.col("reason") == "indirect_description")


_SCHEMA = "decision string, works array<struct<name:string,aliases:array<string>,media_type:string,evidence:string>>"


def parse_answers(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Add status, error, works, truncated to a resolver's JSON answers: candidates (at most three works of three aliases each), abstain or failed."""
    read = F.from_json(column, _SCHEMA, {"mode": "PERMISSIVE"})
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    kinds = F.array(*map(F.lit, KINDS))
    names = F.filter(F.slice(F.coalesce("_r.works", F.array().cast("array<struct<name:string,aliases:array<string>,media_type:string,evidence:string>>")), 1, MOST_WORKS), lambda w: w["name"].isNotNull())
    works = F.transform(
        names,
        lambda w: F.struct(
            plain(w["name"]).alias("name"),
            F.filter(F.transform(F.slice(F.coalesce(w["aliases"], F.array().cast("array<string>")), 1, MOST_ALIASES), plain), lambda a: a != "").alias("aliases"),
            F.when(F.array_contains(kinds, w["media_type"]), w["media_type"]).otherwise("other").alias("media_type"),
            plain(w["evidence"]).alias("evidence"),
        ),
    )
    broken = F.get_json_object(column, "$").isNull()
    schema = ~F.coalesce(F.col("_r.decision").isin("candidates", "abstain"), F.lit(False))
    rows = answers.withColumn("_r", read).withColumn("_w", works)
    error = F.when(broken, "parse_error").when(schema, "schema_error").when((F.col("_r.decision") == "candidates") & (F.size("_w") == 0), "no_valid_work_entries")
    out = rows.withColumn("error", error).withColumn("status", F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("_r.decision")))
    return out.withColumns({"works": F.when(F.col("status") == "candidates", F.col("_w")), "truncated": F.greatest(F.lit(0), F.coalesce(F.size("_r.works"), F.lit(0)) - MOST_WORKS)}).drop("_r", "_w")


def query_key(query: Column) -> Column:
    """Digest of a query with single spaces, by which stored answers are found."""
    return F.sha2(F.trim(F.regexp_replace(query, r"\s+", " ")), 256)


def replay(queries: DataFrame, stored: DataFrame) -> DataFrame:
    """Queries (query) with the stored answers (key, answer) of their digest; `cache_miss` where there is none."""
    rows = queries.withColumn("key", query_key(F.col("query"))).join(stored.select("key", "answer").dropDuplicates(["key"]), "key", "left")
    return rows.withColumn("error", F.when(F.col("answer").isNull(), "cache_miss"))


def analysis_cache(queries: DataFrame, stored: DataFrame) -> DataFrame:
    """Queries (query_id, query) with a stored analysis (query_id, query, analysis): `hit` by id and text, `drift` if the text has changed, `missing` else; drifted ones are to be made anew."""
    held = stored.select("query_id", F.col("query").alias("_then"), "analysis")
    rows = queries.join(held, "query_id", "left")
    state = F.when(F.col("_then").isNull(), "missing").when(F.col("_then") == F.col("query"), "hit").otherwise("drift")
    return rows.withColumn("state", state).withColumn("analysis", F.when(state == "hit", F.col("analysis"))).drop("_then")


def validate_works(works: DataFrame, mentions: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """Works (query_id, position, query, name, aliases, media_type, evidence, explicit: array) with `reject_reason`, null for those to trust, and `usable` terms.

    Reasons, first one counts: evidence that the query doesn't hold, an invalid name, a negated name, one that the query
    names itself, a negated medium, a name that an earlier work has, terms that more than `most_rows` rows mention, no row
    that does, and the same rows as an earlier work. mentions: (term, id), terms compact.
    """
    whole = compact(F.col("query"))
    valid = lambda x: (F.length(F.regexp_replace(x, r"[\s_]+", "")) >= 2) & (F.length(x) <= 40) & ~F.trim(x).rlike(_GENERIC)
    negated = F.regexp_extract_all("query", F.lit(r"([\p{L}\p{N}]{2,})\s*(?:는|은|가|이)?\s*(?:" + "|".join(NEGATIONS) + ")"), F.lit(1))
    rows = works.withColumns({"_query": whole, "_negated": negated, "_evidence": compact(F.coalesce("evidence", F.lit("")))})
    terms = F.concat(F.array("name"), F.filter("aliases", valid))
    rows = rows.withColumn("_terms", F.array_distinct(F.transform(terms, lambda x: F.regexp_replace(F.lower(x), r"[\s_]+", ""))))
    keys = F.filter("_terms", lambda x: F.length(x) >= 2)
    clash = F.exists(keys, lambda k: F.exists(F.coalesce("explicit", F.array().cast("array<string>")), lambda n: F.contains(F.regexp_replace(F.lower(n), r"[\s_]+", ""), k) | F.contains(k, F.regexp_replace(F.lower(n), r"[\s_]+", ""))))
    kinds = F.lit(None).cast("string")
    for kind, words in KINDS.items():
        kinds = F.when(F.col("media_type") == kind, _pattern(words)).otherwise(kinds)
    away = F.coalesce(F.regexp_like("query", F.concat(kinds, F.lit(r"\s*(?:는|은|가|이|ost)?\s*(?:" + "|".join(NEGATIONS) + ")"))), F.lit(False))
    rows = rows.withColumn(
        "_early",
        F.when((F.length("_evidence") < 2) | ~F.contains("_query", F.col("_evidence")), "evidence_not_in_query")
        .when(~valid(F.col("name")), "invalid_name")
        .when(F.exists("_terms", lambda x: F.exists("_negated", lambda n: F.contains(x, F.lower(n)))), "conflicts_negation")
        .when(clash, "explicit_work_named")
        .when(away, "conflicts_negated_media_type"),
    )
    fit = rows.where("_early is null").select("query_id", "position", F.explode("_terms").alias("term"))
    counts = mentions.groupBy("term").agg(F.count_distinct("id").alias("n"))
    known = fit.join(counts, "term", "left").groupBy("query_id", "position").agg(
        F.collect_set(F.when(F.col("n") <= most_rows, F.col("term"))).alias("usable"), F.max(F.coalesce(F.col("n") > most_rows, F.lit(False))).alias("_generic")
    )
    found = fit.join(mentions, "term").join(counts.where(F.col("n") <= most_rows), "term").select("query_id", "position", "id").distinct()
    marks = found.groupBy("query_id", "position").agg(F.count("*").alias("n_rows"), F.bit_xor(F.xxhash64("id")).alias("_same"))
    rows = rows.join(known, ["query_id", "position"], "left").join(marks, ["query_id", "position"], "left")
    sound = F.col("_early").isNull() & F.col("n_rows").isNotNull()
    before = Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.flatten(F.collect_list(F.when(sound, F.col("_terms"))).over(before))
    rows = rows.withColumn("_earlier", F.when(F.col("_early").isNull(), earlier))
    again = F.row_number().over(Window.partitionBy("query_id", sound, "n_rows", "_same").orderBy("position"))
    rows = rows.withColumn("_again", again)
    reason = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(F.coalesce(F.arrays_overlap("_terms", "_earlier"), F.lit(False)), "duplicate")
        .when(F.col("n_rows").isNull(), F.when(F.coalesce("_generic", F.lit(False)), "too_generic").otherwise("no_local_data"))
        .when(F.col("_again") > 1, "duplicate_mentions")
    )
    return rows.withColumn("reject_reason", reason).drop("_query", "_negated", "_evidence", "_terms", "_early", "_generic", "_same", "_earlier", "_again")
