"""Why a row stands where it stands: a ledger of what paths and rules added, its totals, clue checks and their texts.

Ledger rows: (query_id, id, kind, name, delta, dropped), where kind is `path`, `rule` or `order`, and dropped marks path
contributions that a cut took out again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The path of lyric finds, and order rules that lyrics set off.
LYRIC_PATH, LYRIC_ORDER = "lyrics_surface", ("lyric_protected", "lyric_anchor_protect")


def ledger_totals(ledger: DataFrame) -> DataFrame:
    """(query_id, id): sum of live paths, of dropped ones and of rules, and whether order rules fired. Sums run in order of names."""
    live = (F.col("kind") == "path") & ~F.coalesce("dropped", F.lit(False))

    def total(flag: Column) -> Column:
        held = F.array_sort(F.collect_list(F.when(flag, F.struct("name", "delta"))))
        return F.aggregate(held, F.lit(0.0), lambda acc, x: acc + x["delta"])

    return ledger.groupBy("query_id", "id").agg(
        total(live).alias("paths"),
        total((F.col("kind") == "path") & F.coalesce("dropped", F.lit(False))).alias("dropped"),
        total(F.col("kind") == "rule").alias("rules"),
        F.count_if(live).alias("n_paths"),
        F.count_if(F.col("kind") == "order").alias("n_order_rules"),
    )


def unbalanced(totals: DataFrame, scores: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Rows whose ledger doesn't add up to their score (query_id, id, score)."""
    gap = F.col("paths") + F.col("rules") - F.col("score")
    return totals.join(scores, ["query_id", "id"]).withColumn("gap", gap).where(F.abs("gap") > tolerance)


def evidence_kind(ledger: DataFrame) -> DataFrame:
    """(query_id, id, evidence): `ranking` where a live lyric contribution isn't 0 or a lyric order rule moved the row, else `supplementary`."""
    scored = (F.col("kind") == "path") & (F.col("name") == LYRIC_PATH) & ~F.coalesce("dropped", F.lit(False)) & (F.col("delta") != 0)
    moved = (F.col("kind") == "order") & F.col("name").isin(*LYRIC_ORDER)
    made = F.max(F.coalesce(scored | moved, F.lit(False)))
    return ledger.groupBy("query_id", "id").agg(F.when(made, "ranking").otherwise("supplementary").alias("evidence"))


#: How a clue and what the row shows agree.
MATCH, PARTIAL, UNVERIFIED, CONFLICT = "match", "partial", "unverified", "conflict"


def check_value(wanted: Column, observed: Column, partly: Column) -> Column:
    """match if they are equal, partial if `partly` holds, unverified if the row shows nothing, conflict else; null if nothing is wanted."""
    return F.when(wanted.isNull(), None).when(observed.isNull(), UNVERIFIED).when(wanted == observed, MATCH).when(F.coalesce(partly, F.lit(False)), PARTIAL).otherwise(CONFLICT)


def clue_checks(rows: DataFrame, checks: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """(query_id, id, position, slot, clue, observed, status): one row for each slot (wanted, observed, partly) that a query states."""
    every = [F.struct(F.lit(i).alias("position"), F.lit(slot).alias("slot"), w.cast("string").alias("clue"), o.cast("string").alias("observed"), check_value(w, o, p).alias("status")) for i, (slot, (w, o, p)) in enumerate(checks.items())]
    return rows.select("query_id", "id", F.explode(F.filter(F.array(*every), lambda x: x["status"].isNotNull())).alias("c")).select("query_id", "id", "c.*")


def summaries(checks: DataFrame) -> DataFrame:
    """(query_id, id, summary): at most two sentences. The first names up to three clues that fit, those first that fewest rows of the query fit; the second one that speaks against the row."""
    fits = F.col("status").isin(MATCH, PARTIAL)
    shared = F.sum(fits.cast("int")).over(Window.partitionBy("query_id", "slot", "clue"))
    rows = checks.withColumn("shared", shared)
    good = F.slice(F.array_sort(F.collect_list(F.when(fits, F.struct("shared", "position", "slot", "clue")))), 1, 3)
    bad = F.slice(F.array_sort(F.collect_list(F.when(F.col("status") == CONFLICT, F.struct("position", "slot", "clue", "observed")))), 1, 1)
    by = rows.groupBy("query_id", "id").agg(good.alias("good"), bad.alias("bad"))
    named = F.array_join(F.transform("good", lambda x: F.concat(x["slot"], F.lit(" "), x["clue"])), ", ")
    first = F.when(F.size("good") > 0, F.concat(F.lit("Fits what you said: "), named, F.lit(".")))
    against = F.try_element_at("bad", F.lit(1))
    second = F.when(F.size("bad") > 0, F.concat(F.lit("Differs: "), against["slot"], F.lit(" is "), against["observed"], F.lit(", not "), against["clue"], F.lit(".")))
    return by.select("query_id", "id", F.concat_ws(" ", first, second).alias("summary"))


def render(ledger: DataFrame) -> DataFrame:
    """(query_id, id, text): the ledger as lines, live paths first, then rules, order rules and what a cut took out; largest amounts first."""
    part = F.when((F.col("kind") == "path") & ~F.coalesce("dropped", F.lit(False)), 0).when(F.col("kind") == "rule", 1).when(F.col("kind") == "order", 2).otherwise(3)
    line = F.when(F.col("kind") == "order", F.format_string("moved by %s", "name")).otherwise(F.format_string("%s%s %+.6f", F.when(part == 3, "not kept: ").otherwise(""), F.col("name"), F.col("delta")))
    lines = F.array_sort(F.collect_list(F.struct(part.alias("part"), (-F.abs(F.coalesce("delta", F.lit(0.0)))).alias("size"), "name", line.alias("line"))))
    return ledger.groupBy("query_id", "id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
