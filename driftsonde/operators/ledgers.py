"""Small decisions and comparisons over tables of results, labels and collected records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a collected record after which nothing is left to do.
DONE = ("ok", "no_trivia", "not_found", "needs_review")


def backfill_action(version: Column, status: Column, collected_at: Column, current: int = 3, reextract: tuple[int, ...] = (2,), migrate: tuple[int, ...] = (1,), retry_not_found: bool = False, retry_review: bool = False, force: bool = False) -> Column:
    """(action, reason): collect, reextract, migrate or skip a record of a schema version and status."""
    told = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    if force:
        return told("collect", "forced")
    dated = F.coalesce(F.length(F.trim(collected_at)) > 0, F.lit(False))
    here, finished = version == current, F.coalesce(status.isin(*DONE), F.lit(False))
    missing = F.coalesce(status == "not_found", F.lit(False))
    rules = [
        (version.isNull(), ("collect", "missing")),
        (here & ~dated, ("migrate", "repair_missing_collected_at")),
        (here & missing & F.lit(retry_not_found), ("collect", "retry_not_found")),
        (here & (status == "needs_review") & F.lit(not retry_review), ("skip", "needs_review_manual_resolution")),
        (here & finished, ("skip", "already_complete")),
        (here, ("collect", "retry_incomplete_or_error")),
        (version.isin(*reextract, *migrate) & missing & F.lit(retry_not_found), ("collect", "retry_not_found")),
        (version.isin(*reextract) & status.isin("ok", "no_trivia"), ("reextract", "upgrade_refinement_rules_from_cached_source")),
        (version.isin(*reextract, *migrate) & finished, ("migrate", "upgrade_compact_schema")),
        (version.isin(*reextract, *migrate), ("collect", "retry_incomplete_compact_legacy")),
    ]
    out = F.when(*[(F.coalesce(c, F.lit(False)), told(*r)) for c, r in rules[:1]][0])
    for condition, result in rules[1:]:
        out = out.when(F.coalesce(condition, F.lit(False)), told(*result))
    return out.otherwise(told("collect", "repair_unknown_current_schema"))


def compare_orders(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, same_order, most, n) of two scored lists (query_id, id, score): whether they rank alike, and by how much scores differ; ids of one list alone are left out."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    place = lambda df, n: df.select("query_id", "id", F.col("score").alias(f"s{n}"), F.row_number().over(w).alias(f"r{n}"))
    both = place(before, 1).join(place(after, 2), ["query_id", "id"])
    return both.groupBy("query_id").agg(F.bool_and(F.col("r1") == F.col("r2")).alias("same_order"), F.max(F.abs(F.col("s1") - F.col("s2"))).alias("most"), F.count("*").alias("n"))


def differing(before: DataFrame, after: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Metrics (metric, value) whose values differ by more than the tolerance."""
    both = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), "metric")
    return both.where(F.abs(F.col("before") - F.col("after")) > tolerance).select("metric", "before", "after")


def pick_comments(rows: DataFrame, most: int) -> DataFrame:
    """The best `most` comments (group, id, score, keep) of each group: kept ones, else those of score 3 or more, else 2 or more, never less."""
    by = Window.partitionBy("group")
    some = lambda flag: F.max(flag.cast("int")).over(by) == 1
    tiers = rows.withColumns({"_keep": some(F.col("keep")), "_three": some(F.col("score") >= 3)})
    fit = F.when(F.col("_keep"), F.col("keep")).when(F.col("_three"), F.col("score") >= 3).otherwise(F.col("score") >= 2)
    w = by.orderBy(F.desc("score"), "id")
    return tiers.where(fit).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("_keep", "_three")


def label_problems(labels: DataFrame, id_column: str) -> DataFrame:
    """(id, problems) of labels (positives, allowed, negatives, negative_reason, status) that contradict themselves."""
    some = lambda c: F.size(c) > 0
    rules = {
        "overlap": F.arrays_overlap("positives", "negatives"),
        "allowed_overlap": F.arrays_overlap("allowed", "positives") | F.arrays_overlap("allowed", "negatives"),
        "no_reason": some("negatives") & F.col("negative_reason").isNull(),
        "no_positive": (F.col("status") == "labeled") & ~some("positives"),
        "target_of_none": (F.col("status") == "no_target") & some("positives"),
    }
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return labels.select(id_column, found.alias("problems")).where(F.size("problems") > 0)


def coverage(rows: DataFrame, group: str, status: str, values: list[str]) -> DataFrame:
    """For each group: rows of each status, share of rows with one, rows without."""
    counts = [F.count_if(F.col(status) == v).alias(v) for v in values]
    return rows.groupBy(group).agg(*counts, (F.count(status) / F.count("*")).alias("coverage"), F.count_if(F.col(status).isNull()).alias("unresolved"))


def sparse_passage(blocks: list[tuple[str, list[Column]]]) -> Column:
    """Lines of the blocks (label, columns): each the first of its columns that isn't blank; blocks without any are left out."""
    first = lambda columns: F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in columns))
    return F.concat_ws("\n", *(F.when(first(columns).isNotNull(), F.concat(F.lit(label), first(columns))) for label, columns in blocks))


def cover_key(url: Column) -> Column:
    """The last part of an address's path, which names a picture."""
    return F.regexp_extract(url, r"([^/?#]+)(\?[^#]*)?(#.*)?$", 1)


def accept_or_reject(rows: DataFrame, id_column: str, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule, and (id, reason) of those that do: each rejected row with all its reasons."""
    broken = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(n)) for n, bad in rules.items())), lambda x: x.isNotNull())
    marked = rows.withColumn("_broken", broken)
    return marked.where(F.size("_broken") == 0).drop("_broken"), marked.where(F.size("_broken") > 0).select(id_column, F.explode("_broken").alias("reason"))


def stage_sweep(rows: DataFrame, group: str, setting: str, stage: str, stages: list[str]) -> DataFrame:
    """For each group and setting: how many rows reach each stage, by one pivot of known stages."""
    return rows.groupBy(group, setting).agg(*(F.count_if(F.col(stage) == s).alias(s) for s in stages))


def context_records(facts: DataFrame) -> DataFrame:
    """Facts (song_id, artist, title, category, text) with an id by digest and the text that is embedded; equal ones once."""
    digest = F.sha2(F.concat_ws("\u001f", "song_id", "category", "text"), 256)
    dense = F.concat_ws(" ", *(F.nullif(F.trim(c), F.lit("")) for c in ("artist", "title", "category", "text")))
    return facts.select("song_id", digest.alias("record_id"), "category", "text", dense.alias("dense_text")).dropDuplicates(["record_id"])


def audit_collection(seeds: DataFrame, records: DataFrame) -> DataFrame:
    """Seeds (seed, artist_key, title_key) with what was collected (artist_key, title_key, position, id, status): the last record of a key, or `missing`."""
    last = records.groupBy("artist_key", "title_key").agg(F.max_by(F.struct("id", "status"), "position").alias("r"))
    return seeds.join(last, ["artist_key", "title_key"], "left").select("seed", F.col("r.id").alias("id"), F.coalesce("r.status", F.lit("missing")).alias("status"))


def completeness(files: DataFrame, needed: list[str]) -> DataFrame:
    """(folder, complete, missing) of files (folder, name)."""
    by = files.groupBy("folder").agg(F.collect_set("name").alias("have"))
    gone = F.array_except(F.array(*map(F.lit, needed)), F.col("have"))
    return by.select("folder", (F.size(gone) == 0).alias("complete"), F.array_sort(gone).alias("missing"))


def baselines(labels: DataFrame, ids: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """(query_id, system, rank, id): the labels themselves as a perfect search, and ids in an order of digests as a random one."""
    w = Window.partitionBy("query_id").orderBy("id")
    perfect = labels.select("query_id", F.explode("positives").alias("id")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    first = ids.select("id").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("id", F.lit(seed)), "id")))
    chance = labels.select("query_id").crossJoin(F.broadcast(first))
    return perfect.select("query_id", F.lit("perfect").alias("system"), "rank", "id").unionByName(chance.select("query_id", F.lit("random").alias("system"), "rank", "id"))


def cut_terms(terms: Column, stop: list[str], particles: list[str], known: Column, most: int = 80) -> Column:
    """Distinct terms without stop words, particles taken off where a known word is left, parts of longer terms left out, `most` at most."""

    def base(x: Column) -> Column:
        ends = [F.when(x.endswith(p) & F.array_contains(known, F.substring(x, F.lit(1), F.length(x) - len(p))), F.substring(x, F.lit(1), F.length(x) - len(p))) for p in sorted(particles, key=len, reverse=True)]
        return F.coalesce(*ends, x)

    bare = F.array_distinct(F.transform(terms, base))
    fit = F.filter(bare, lambda x: ~x.isin(*stop) & (F.length(x) > 1))
    whole = F.filter(fit, lambda x: ~F.exists(fit, lambda y: (F.length(y) > F.length(x)) & F.contains(y, x)))
    return F.slice(whole, 1, most)


def document_text(fields: list[tuple[str, Column]], most: int = 1200) -> Column:
    """What a reranker reads of a row: labelled fields that have a value, on lines, cut to `most` characters."""
    lines = [F.when(F.trim(c) != "", F.concat(F.lit(f"{name}: "), F.trim(c))) for name, c in fields]
    return F.substring(F.concat_ws("\n", *lines), 1, most)


def collection_name(index: Column, space: Column) -> Column:
    return F.concat_ws("__", index, space)


def ttl_state(indexes: DataFrame) -> DataFrame:
    """One row: ready, wrong_seconds, not_ttl or missing, of the indexes (keys: array, seconds) that are on the expiry alone."""
    own = F.col("keys") == F.array(F.lit("expires_at"))
    rank = F.when(~own, 0).when(F.col("seconds").isNull(), 1).when(F.col("seconds") == 0, 3).otherwise(2)
    best = indexes.agg(F.coalesce(F.max(rank), F.lit(0)).alias("r"))
    return best.select(F.element_at(F.array(*map(F.lit, ("missing", "not_ttl", "wrong_seconds", "ready"))), F.col("r") + 1).alias("state"))


def reuse_or_fit(corpus: DataFrame, digest_before: tuple[int, int] | None) -> tuple[bool, tuple[int, int]]:
    """Whether what was fitted on a corpus of that digest can stay, and the corpus's digest now: any change asks for a new fit."""
    from driftsonde.sources.records import content_digest

    now = content_digest(corpus)
    return now == digest_before, now


def blank_without_evidence(rows: DataFrame, fields: list[str], evidence: str, least: int = 1) -> DataFrame:
    """Fields that only evidence could fill are emptied where there is less of it than `least`."""
    return rows.withColumns({c: F.when(F.coalesce(F.col(evidence), F.lit(0)) >= least, F.col(c)) for c in fields})


def plane(vectors: DataFrame, id_column: str, column: str, rounds: int = 30) -> DataFrame:
    """(id, x, y): places on the two main axes of the vectors, by power iteration on their covariance (a row a component, whatever the number of vectors).

    Stands for a neighbour map, which has no distributed form here. Signs are such that each axis's largest part is positive.
    """
    import numpy as np

    size = vectors.select(F.size(column)).first()[0]
    cells = vectors.select(F.posexplode(column).alias("i", "a"), F.col(column).alias("v"))
    sums = cells.select("i", F.col("a").cast("double").alias("a"), F.posexplode("v").alias("j", "b")).where("j >= i").groupBy("i", "j").agg(F.avg(F.col("a") * F.col("b").cast("double")).alias("c")).collect()
    mean = np.array([r["m"] for r in cells.groupBy("i").agg(F.avg(F.col("a").cast("double")).alias("m")).orderBy("i").collect()])
    spread = np.zeros((size, size))
    for r in sums:
        spread[r["i"], r["j"]] = spread[r["j"], r["i"]] = r["c"]
    spread -= np.outer(mean, mean)
    axes = []
    for k in range(2):
        v = np.ones(size) / np.sqrt(size) + np.arange(size) * 1e-3 * (k + 1)
        for _ in range(rounds):
            v = spread @ v
            for u in axes:
                v -= u * (u @ v)
            v /= np.linalg.norm(v) or 1.0
        axes.append(v * np.sign(v[np.argmax(np.abs(v))] or 1.0))
    at = lambda axis: F.aggregate(F.zip_with(F.col(column), F.array(*map(F.lit, axis.tolist())), lambda x, w: x.cast("double") * w), F.lit(0.0), lambda acc, x: acc + x) - float(mean @ axis)
    return vectors.select(id_column, at(axes[0]).alias("x"), at(axes[1]).alias("y"))
