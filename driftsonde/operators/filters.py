"""A nested-dict filter language compiled to one Column, and builders of such filters from what a query says.

A filter is a conjunction of conditions. `$and` adds its branches' conditions, `$or` is one condition (any branch, each a
conjunction; without branches it adds nothing), `$not` holds if none of its conditions does. Conditions on a field:
`$eq` (also a bare value), `$ne` (rows without a value pass), `$in`, `$nin` (a value is needed), `$gt $gte $lt $lte`
(one range) and `$text` (every token of the operand is a token of the field). Of an array field some element must meet a
condition. Unknown operators raise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda x: x != "")


#: What an operator asks of one value.
_TESTS: dict[str, Callable[[Column, object], Column]] = {
    "$eq": lambda x, v: x == F.lit(v),
    "$ne": lambda x, v: x == F.lit(v),
    "$in": lambda x, v: x.isin(*v),
    "$nin": lambda x, v: ~x.isin(*v),
    "$text": lambda x, v: F.size(F.array_except(tokens(F.lit(str(v))), tokens(x))) == 0,
}
_BOUNDS: dict[str, Callable[[Column, object], Column]] = {"$gt": Column.__gt__, "$gte": Column.__ge__, "$lt": Column.__lt__, "$lte": Column.__le__}


@dataclass(frozen=True)
class Condition:
    """`holds` is null or false where the condition doesn't hold. `fails` is true there: both can reach a scan."""

    holds: Column
    fails: Column


def _all(columns: Iterable[Column]) -> Column:
    return reduce(Column.__and__, columns, F.lit(True))


def _any(columns: Iterable[Column]) -> Column:
    return reduce(Column.__or__, columns, F.lit(False))


def _condition(df: DataFrame, name: str, test: Callable[[Column], Column], turned: bool = False) -> Condition:
    col = df[name]
    if isinstance(df.schema[name].dataType, T.ArrayType):
        met = F.coalesce(F.exists(col, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))
        out = Condition(met, ~met)
    else:
        met = test(col)
        out = Condition(met, col.isNull() | ~met)
    return Condition(out.fails, out.holds) if turned else out


def _field(df: DataFrame, name: str, asked: object) -> list[Condition]:
    asked = asked if isinstance(asked, dict) else {"$eq": asked}
    unknown = set(asked) - set(_TESTS) - set(_BOUNDS)
    if unknown:
        raise ValueError(f"unknown operator {sorted(unknown)[0]}")
    out = [_condition(df, name, lambda x, op=op, v=v: _TESTS[op](x, v), turned=op == "$ne") for op, v in asked.items() if op in _TESTS]
    bounds = [(op, v) for op, v in asked.items() if op in _BOUNDS]
    if bounds:
        out.append(_condition(df, name, lambda x: _all(_BOUNDS[op](x, F.lit(v)) for op, v in bounds)))
    return out


def _conditions(df: DataFrame, spec: dict | None) -> list[Condition]:
    out: list[Condition] = []
    for key, value in (spec or {}).items():
        if key == "$and":
            out += [c for branch in value or [] for c in _conditions(df, branch)]
        elif key == "$or":
            branches = [_conditions(df, branch) for branch in value or []]
            if branches:
                out.append(Condition(_any(_all(c.holds for c in b) for b in branches), _all(_any(c.fails for c in b) for b in branches)))
        elif key == "$not":
            inner = _conditions(df, value)
            out.append(Condition(_all(c.fails for c in inner), _any(c.holds for c in inner)))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        else:
            out += _field(df, key, value)
    return out


def compile_filter(df: DataFrame, spec: dict | None) -> Column:
    """For `where`: null or false where a row does not pass, and plain enough to reach the scan."""
    return _all(c.holds for c in _conditions(df, spec))


def passes(df: DataFrame, spec: dict | None) -> Column:
    """For projections: whether a row passes, never null."""
    return F.coalesce(compile_filter(df, spec), F.lit(False))


def reject_then_trim(ranked: DataFrame, rejected: DataFrame, k: int, group: str = "query_id", id_column: str = "id", rank: str = "rank") -> DataFrame:
    """Rejected ids leave before the cut to k, so that others move up."""
    left = ranked.join(rejected, [group, id_column], "left_anti")
    return left.withColumn("kept_rank", F.row_number().over(Window.partitionBy(group).orderBy(rank, id_column))).where(F.col("kept_rank") <= k)


def id_filter(rows: DataFrame, ids: DataFrame, id_column: str, id_type: str = "string") -> DataFrame:
    """Rows whose id, as a string or as `id_type`, is among `ids`: a semi join, so that ids may be many."""
    wanted = ids.select(F.col(id_column).cast(id_type).alias("_id")).distinct()
    return rows.join(wanted, rows[id_column].cast(id_type) == wanted["_id"], "left_semi")


def select_payload(rows: DataFrame, allowed: list[str], most: int = 2000) -> DataFrame:
    """The allowed columns that are there, strings trimmed and cut to `most` characters, nulls out of arrays."""

    def clean(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.StringType):
            return F.substring(F.trim(f.name), 1, most).alias(f.name)
        if isinstance(f.dataType, T.ArrayType):
            there = F.filter(f.name, lambda x: x.isNotNull())
            return (F.transform(there, lambda x: F.substring(F.trim(x), 1, most)) if isinstance(f.dataType.elementType, T.StringType) else there).alias(f.name)
        return F.col(f.name)

    return rows.select(*(clean(f) for f in rows.schema.fields if f.name in allowed))


# Filters from what a query says ------------------------------------------------------------------------------------------

#: Voices that the catalogue knows; "either" stands for mixed voices and fits both others.
MALE, FEMALE, MIXED = "남성", "여성", "혼성"
#: Genres that are registered.
GENRES = (
    "발라드", "댄스", "랩/힙합", "인디음악", "록/메탈", "R&B/Soul", "국내드라마", "포크/블루스", "일렉트로니카", "애니메이션/웹툰",
    "성인가요/트로트", "국내영화", "재즈", "키즈", "애시드/퓨전/팝", "게임", "국내뮤지컬", "보사노바", "국외영화",
)
#: How the catalogue spells each type of artist.
ARTIST_TYPES = {
    "솔로": ("솔로", "싱어송라이터"),
    "그룹": ("그룹", "걸그룹", "혼성", "프로젝트그룹", "아이돌그룹", "혼성그룹"),
    "듀오": ("듀오", "듀엣"),
    "밴드": ("밴드", "인디밴드"),
}
#: The widest era, in years, that narrows anything.
WIDEST_ERA = 12


def _plain(text: str | None) -> str:
    return "".join((text or "").split()).lower()


def registered_genres(said: str | None, genres: Iterable[str] = GENRES) -> list[str]:
    wanted = _plain(said)
    return [g for g in genres if wanted in _plain(g)] if wanted else []


def era_filter(windows: list[tuple[int, int]], column: str, widest: int = WIDEST_ERA) -> dict:
    """Years of all windows of at most `widest` years, any of which may match."""
    years = sorted({y for a, b in windows if a <= b and b - a + 1 <= widest for y in range(a, b + 1)})
    return {"$or": [{column: {"$text": str(y)}} for y in years]} if years else {}


def attribute_filter(analysis: dict, gate: str = "era_plus", use_genre: bool = True, genres: Iterable[str] = GENRES) -> dict | None:
    """What a query says of era (start, end), voice, genre and artist types as a filter; none where the gate stays shut.

    `era_plus` asks for an era and one more axis, `two_axes` for an era or two others. A voice admits mixed ones, a genre
    all registered ones that hold its name, an artist type all its spellings.
    """
    era = era_filter([analysis["era"]], "release_date") if analysis.get("era") else {}
    axes: list[dict] = []
    voice = (analysis.get("voice") or "").strip()
    if voice in (MALE, FEMALE):
        axes.append({"vocal_gender": {"$in": [voice, MIXED]}})
    elif voice == MIXED:
        axes.append({"vocal_gender": {"$eq": MIXED}})
    if use_genre and (found := registered_genres(analysis.get("genre"), genres)):
        axes.append({"genre": {"$in": found}})
    types = sorted({x for t in analysis.get("artist_types") or () for x in ARTIST_TYPES.get(t.strip(), ())})
    if types:
        axes.append({"type": {"$in": types}})
    opened = bool(era) and bool(axes) if gate == "era_plus" else bool(era) or len(axes) >= 2
    return {"$and": [era, *axes] if era else axes} if opened else None


def genre_axis(analysis: dict, answered: str | None, policy: str = "always", enabled: bool = True) -> tuple[bool, str]:
    """Whether the genre narrows this query, and why: an answered genre always does under `conditional`, a stated voice keeps an unanswered one out."""
    if not enabled:
        return False, "switch_off"
    if policy != "conditional":
        return True, "always"
    if registered_genres(answered):
        return True, "answered_genre"
    if (analysis.get("voice") or "").strip() in (MALE, FEMALE, MIXED):
        return False, "gender_condition"
    return True, "no_gender"


def performance_filter(count: str | None, roles: Iterable[str]) -> dict | None:
    """Mixed voices in rap, for a duet of both voices of which one raps; other clues open nothing."""
    roles = set(roles)
    both = roles & {"남성랩", "남성노래"} and roles & {"여성랩", "여성노래"}
    rap = roles & {"남성랩", "여성랩", "랩"}
    return {"$and": [{"vocal_gender": {"$eq": MIXED}}, {"genre": {"$eq": "랩/힙합"}}]} if count == "duet" and both and rap else None


#: Title features that a query can state, by the payload column that holds them.
TITLE_COLUMNS = {name: f"title_{name}" for name in ("script", "char_count", "word_count", "contains_number", "repeated_char", "repeated_word")}


def title_filter(stated: dict) -> dict | None:
    """Exact title features; one condition stands alone, several make a conjunction."""
    clauses = [{column: {"$eq": stated[name]}} for name, column in TITLE_COLUMNS.items() if stated.get(name) is not None]
    return None if not clauses else clauses[0] if len(clauses) == 1 else {"$and": clauses}


def title_presence_filter(stated: dict) -> dict | None:
    """Titles with Chinese characters anywhere, for queries that remember such a title."""
    return {"title_has_hanja_anywhere": {"$eq": True}} if stated.get("script") == "hanja" else None


def title_meaning_filter(kind: str | None) -> dict | None:
    """What titles of a kind of meaning have in common, as far as features show it."""
    return {
        "foreign_person_name": {"title_has_latin_anywhere": {"$eq": True}},
        "sentence": {"title_word_count": {"$gte": 3}},
        "onomatopoeia": {"$or": [{"title_repeated_char": {"$eq": True}}, {"title_repeated_word": {"$eq": True}}]},
    }.get(kind or "")
