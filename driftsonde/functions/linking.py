"""Names, titles and versions of catalogue rows, for telling which rows are the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftsonde.functions.unicode import identity_key, nfkc

#: Brackets of titles and names.
OPEN, CLOSE = "([{（［【「『〈<", ")]}）］】」』〉>"
_BRACKET = rf"[{OPEN.replace('[', chr(92) + '[')}][^{CLOSE.replace(']', chr(92) + ']')}]*[{CLOSE.replace(']', chr(92) + ']')}]"
_PARTS = rf"((?:[{OPEN.replace('[', chr(92) + '[')}][^{CLOSE.replace(']', chr(92) + ']')}]*(?:[{CLOSE.replace(']', chr(92) + ']')}]|$)|[^,&{OPEN.replace('[', chr(92) + '[')}])+)"
_CREDIT = r"(?i)\s+(?:feat\.?|ft\.|prod\.?)\s+.*$"


def without_brackets(text: Column) -> Column:
    return F.regexp_replace(text, _BRACKET, " ")


def title_key(title: Column) -> Column:
    """Identity key of a title without brackets and credits; of all of it where nothing else is left."""
    raw = nfkc(F.coalesce(title, F.lit("")))
    bare = identity_key(F.regexp_replace(without_brackets(raw), _CREDIT, ""))
    return F.when(bare != "", bare).otherwise(identity_key(raw))


def split_artists(text: Column) -> Column:
    """Names parted by commas and ampersands outside brackets."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PARTS), F.lit(1))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def bracket_parts(text: Column) -> Column:
    """What stands in round and square brackets."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\(（\[]([^)）\]]*)[\)）\]]"), F.lit(1)), lambda x: F.trim(x))


def artist_tokens(rows: DataFrame, id_column: str, artist_column: str) -> DataFrame:
    """(id, token): identity keys of each named artist, with and without brackets, and of a bracket that is no list."""
    names = rows.select(id_column, F.explode(split_artists(F.col(artist_column))).alias("name"))
    inner = F.filter(bracket_parts(F.col("name")), lambda x: ~x.rlike("[,&]"))
    every = names.select(id_column, F.explode(F.concat(F.array("name", without_brackets(F.col("name"))), inner)).alias("name"))
    return every.select(id_column, identity_key(F.col("name")).alias("token")).where("token <> ''").distinct()


def alias_map(rows: DataFrame) -> DataFrame:
    """(token, canonical) of rows (position, artist, alias): every name's keys stand for the artist's own key, the first row wins a token."""
    own = identity_key(without_brackets(F.col("artist")))
    rows = rows.where(F.length(F.trim("artist")) > 0).withColumn("canonical", F.when(own != "", own).otherwise(identity_key(F.col("artist"))))
    names = rows.select("position", "canonical", F.explode(F.array("artist", F.coalesce("alias", F.lit("")))).alias("name"))
    keys = names.select("position", "canonical", F.explode(F.array(identity_key(F.col("name")), identity_key(without_brackets(F.col("name"))))).alias("token")).where("token <> ''")
    return keys.groupBy("token").agg(F.min_by("canonical", "position").alias("canonical"))


def canonical_artists(rows: DataFrame, aliases: DataFrame, id_column: str, artist_column: str) -> DataFrame:
    """(id, artists): each row's set of canonical artist keys, sorted."""
    tokens = artist_tokens(rows, id_column, artist_column).join(aliases, "token", "left")
    return tokens.groupBy(id_column).agg(F.array_sort(F.collect_set(F.coalesce("canonical", "token"))).alias("artists"))


def match_entities(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows (id, key, artists) with equal title keys whose artist sets meet: an equi-join on key and artist, not on pairs."""
    part = lambda df, name: df.select("key", F.explode("artists").alias("artist"), F.col("id").alias(name))
    return part(left, "a").join(part(right, "b"), ["key", "artist"]).select("a", "b").distinct()


# Versions ---------------------------------------------------------------------------------------------------------------

#: Marks of other recordings (pattern, points, label, whether they rule a row out).
MARKERS = (
    (r"\b(japan|japanese)\b", -200, "일본어판", True),
    (r"\b(chinese|mandarin|cantonese)\b", -200, "중국어판", True),
    (r"\benglish\s*ver", -200, "영어판", True),
    (r"\bjp\s*ver", -200, "일본어판", True),
    (r"(일본어|중국어|영어)\s*(버전|ver)", -200, "외국어판", True),
    (r"\b(inst|instrumental)\b|반주", -200, "반주/MR", True),
    (r"\b(duet)\b|듀엣", -150, "듀엣판", False),
    (r"\b(live|tour|concert|unplugged)\b|실황", -100, "라이브판", False),
    (r"\b(remix|mix|acoustic|orchestra|rock\s*ver|ballad\s*ver)\b|어쿠스틱|리믹스", -80, "편곡판", False),
    (r"\bkorean\s*ver|한국어\s*(버전|ver)|\bexo\s*k\b", 50, "한국어판", False),
    (r"\boriginal\s*ver", 10, "원곡표기", False),
)
#: Labels that always rule a row out, and those that both sides must share.
REJECTED = ("일본어판", "중국어판", "영어판", "외국어판", "반주/MR")
COMPARED = ("듀엣판", "라이브판", "편곡판", *REJECTED)
#: Labels that make a title a variant.
VARIANTS = ("반주/MR", "라이브판", "편곡판", "일본어판", "중국어판", "영어판", "외국어판")
EXACT, SUBTITLE, PREFIX, ALBUM = 100, 60, -40, 0.5
_INSTRUMENTAL = r"(?i)^(inst\.?|instrumental|mr\.?|반주)(\s*(ver\.?|version|버전))?$"


def soften(text: Column) -> Column:
    """Lower case, marks as single spaces, so that words keep their borders."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^0-9a-z가-힣]+", " "))


def squeeze(text: Column) -> Column:
    """Lower-case letters, digits and Hangul alone."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9가-힣]", "")


def is_instrumental(title: Column) -> Column:
    """Whether a bracket says that and nothing else; a title like Mr. does not."""
    return F.exists(bracket_parts(title), lambda x: x.rlike(_INSTRUMENTAL))


def _labels(soft: Column, also: Column | None = None) -> Column:
    names = list(dict.fromkeys(label for _, _, label, _ in MARKERS))
    found = []
    for name in names:
        hit = reduce(Column.__or__, [soft.rlike(p) for p, _, label, _ in MARKERS if label == name])
        if name == "반주/MR" and also is not None:
            hit = hit | also
        found.append(F.when(hit, F.lit(name)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def version_labels(title: Column) -> Column:
    """Labels of the marks that a text bears."""
    return _labels(soften(title), is_instrumental(title))


def version_mismatch(left: Column, right: Column) -> Column:
    """Labels that only one of two titles bears, of those that both must share; null if they agree."""
    own = lambda x: F.array_intersect(version_labels(x), F.array(*map(F.lit, COMPARED)))
    a, b = F.array_except(own(left), own(right)), F.array_except(own(right), own(left))
    said = lambda x: F.coalesce(F.nullif(F.array_join(F.array_sort(x), ","), F.lit("")), F.lit("-"))
    return F.when((F.size(a) > 0) | (F.size(b) > 0), F.concat(said(a), F.lit(" / "), said(b)))


def candidate_score(seed: Column, title: Column, album: Column) -> Column:
    """(score, hard, verdict) of a found title for a wanted one.

    Equal titles gain; marks that the found title has beyond the wanted one lose, those of the album half as much. Bare
    words around the wanted title make it another one; a bracket behind it is a subtitle, words in front lose points.
    Foreign and instrumental marks anywhere, and versions that only one side names, rule a row out.
    """
    exact = squeeze(seed) == squeeze(title)
    soft_seed, soft_title = soften(seed), soften(title)
    extra = F.when((soft_seed != "") & F.contains(soft_title, soft_seed), F.trim(F.replace(soft_title, soft_seed, F.lit(" ")))).otherwise(soft_title)
    points = {label: delta for _, delta, label, _ in MARKERS}
    strict = F.array(*(F.lit(label) for label in dict.fromkeys(x for _, _, x, hard in MARKERS if hard)))

    def scan(soft: Column, weight: float) -> tuple[Column, Column, Column]:
        labels = _labels(soft)
        total = reduce(lambda a, b: a + b, [F.when(F.array_contains(labels, name), int(delta * weight)).otherwise(0) for name, delta in points.items()])
        return total, F.size(labels) > 0, F.arrays_overlap(labels, strict)

    marks, marked, hard_title = scan(extra, 1.0)
    album_marks, _, hard_album = scan(soften(album), ALBUM)
    kept = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.translate(F.coalesce(x, F.lit("")), "（）", "()")), "[^0-9a-z가-힣()]+", " "), r"\s+", " "))
    a, b = kept(seed), kept(title)
    at = F.instr(b, a)
    head, tail = F.trim(F.substring(b, F.lit(1), at - 1)), F.trim(F.substring(b, at + F.length(a), F.length(b)))
    around = F.concat(head, F.lit(" "), tail)
    bare = F.regexp_replace(around, r"\([^)]*\)", " ")
    for pattern, *_ in MARKERS:
        bare = F.regexp_replace(bare, pattern, " ")
    bare = F.trim(F.regexp_replace(bare, r"\b(ver|version|버전)\b|[()]", " "))
    shaped = ~exact & (a != "") & (b != "") & (at > 0)
    other = shaped & (bare != "")
    shape = F.when(shaped & (head != ""), PREFIX).when(shaped & (bare == "") & ~marked & tail.startswith("("), SUBTITLE).otherwise(0)
    banned = F.arrays_overlap(F.array_union(version_labels(title), version_labels(album)), F.array(*map(F.lit, REJECTED)))
    score = F.when(exact, EXACT).otherwise(0) + marks + shape + album_marks
    hard = hard_title | hard_album | other | banned | version_mismatch(seed, title).isNotNull()
    return F.struct(score.alias("score"), hard.alias("hard"), F.when(hard, "reject").when(score < SUBTITLE, "review").otherwise("accept").alias("verdict"))


def variant_reason(title: Column) -> Column:
    """What marks a title as a variant, looked for in brackets and behind a dash; an empty string if nothing does."""
    dashed = F.slice(F.split(F.coalesce(title, F.lit("")), " - "), 2, 100)
    segments = F.filter(F.concat(bracket_parts(title), dashed), lambda s: ~s.rlike(r"(?i)^\s*(feat|ft|prod|with|narr)\b") & ~s.rlike(r"(?i)\boriginal\s*mix\b"))

    def reason(s: Column) -> Column:
        labels = F.array_sort(F.array_intersect(version_labels(s), F.array(*map(F.lit, VARIANTS))))
        version = s.rlike(r"(?i)\b(ver|version)\b|버전") & ~s.rlike(r"(?i)\b(korean|original)\s*ver|한국어\s*(버전|ver)")
        more = F.regexp_extract(s, r"(?i)\b(sped\s*up|speed\s*up|slowed|nightcore|demo|guide|karaoke|radio\s*edit|extended|tv\s*size)\b", 1)
        told = lambda name: F.concat(name, F.lit(": ("), s, F.lit(")"))
        return F.when(F.size(labels) > 0, told(F.array_join(labels, "/"))).when(version, told(F.lit("Ver."))).when(more != "", told(more))

    found = F.filter(F.transform(segments, reason), lambda x: x.isNotNull())
    return F.when(is_instrumental(title), "Inst/MR").otherwise(F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("")))


# Indexes and candidates ---------------------------------------------------------------------------------------------------


def seed_index(rows: DataFrame) -> DataFrame:
    """(artist_key, title_key, id) from rows (position, id, asked_artist, asked_title, artist, title): keys asked for win, the last row among them; others only if one id has them."""
    key = lambda a, t: rows.select("position", "id", squeeze(F.col(a)).alias("artist_key"), squeeze(F.col(t)).alias("title_key")).where("artist_key <> '' and title_key <> ''")
    asked = key("asked_artist", "asked_title").groupBy("artist_key", "title_key").agg(F.max_by("id", "position").alias("id"))
    own = key("artist", "title").groupBy("artist_key", "title_key").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other").drop("other")
    return asked.unionByName(own.join(asked, ["artist_key", "title_key"], "left_anti"))


def select_videos(entries: DataFrame, hard: list[str], soft: list[str], limit: int = 3) -> DataFrame:
    """The `limit` best entries (group, id, wanted, title, channel, named, official, views) of each group.

    Entries of another version or with a hard word go; those with a soft word come back only where nothing else is left.
    Named artists come first, then official ones, then views.
    """
    said = F.lower(F.concat_ws(" ", F.trim(F.replace(F.lower("title"), F.lower("wanted"), F.lit(" "))), F.coalesce("channel", F.lit(""))))
    has = lambda words: reduce(Column.__or__, [F.contains(said, F.lit(w.lower())) for w in words], F.lit(False))
    rows = entries.where(version_mismatch(F.col("wanted"), F.col("title")).isNull()).withColumns({"_hard": has(hard), "_soft": has(soft)}).where("not _hard")
    rows = rows.withColumn("_clean", F.max(~F.col("_soft")).over(Window.partitionBy("group"))).where("not _soft or not _clean")
    w = Window.partitionBy("group").orderBy(F.desc("named"), F.desc("official"), F.desc("views"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("_hard", "_soft", "_clean")


# Free text to fixed values ------------------------------------------------------------------------------------------------

#: Words of voices, by substring and by word.
VOICES = {"남성": (("남성", "남자"), ("male", "man", "men", "boy", "boys", "guy", "guys")), "여성": (("여성", "여자"), ("female", "woman", "women", "girl", "girls", "lady", "ladies")), "혼성": (("혼성", "남녀"), ("mixed", "coed"))}
#: Words of line-ups, first match first, and of roles, which count as solo only where no line-up is named.
LINEUPS = ((("듀오", "듀엣"), ("duo",), "듀오"), (("밴드",), ("band",), "밴드"), (("그룹", "유닛", "중창단", "프로젝트", "콜라보"), ("group", "unit", "trio", "quartet"), "그룹"), (("솔로",), ("solo",), "솔로"), (("혼성",), ("mixed", "coed"), "혼성"))
ROLES = ((("싱어송라이터", "래퍼", "랩퍼", "프로듀서", "보컬리스트", "가수", "록커"), ("rapper", "producer", "vocalist", "singer", "songwriter"), "솔로"),)


def _mentions(text: Column, parts: tuple[str, ...], words: tuple[str, ...]) -> Column:
    return F.lower(text).rlike("|".join([*parts, rf"(?<![a-z])(?:{'|'.join(words)})(?![a-z])"]))


def voice_of(text: Column) -> Column:
    """남성, 여성, 혼성 or unknown; a duet alone says nothing of the voices."""
    male, female, mixed = (_mentions(text, *VOICES[v]) for v in ("남성", "여성", "혼성"))
    return F.when(mixed | (male & female), "혼성").when(male, "남성").when(female, "여성").otherwise("unknown")


def artist_types_of(values: Column) -> Column:
    """Distinct line-ups that the values name, in order; roles where none is named; else unknown."""

    def mapped(table) -> Column:
        def one(x: Column) -> Column:
            out = F.lit(None).cast("string")
            for parts, words, name in reversed(table):
                out = F.when(_mentions(x, parts, words), name).otherwise(out)
            return out

        return F.array_distinct(F.filter(F.transform(values, one), lambda x: x.isNotNull()))

    lineups, roles = mapped(LINEUPS), mapped(ROLES)
    return F.when(F.size(lineups) > 0, lineups).when(F.size(roles) > 0, roles).otherwise(F.array(F.lit("unknown")))


#: Spellings of artist types that answers and boosts compare by.
TYPE_ALIASES = {"솔로": "솔로", "솔로가수": "솔로", "그룹": "그룹", "아이돌그룹": "그룹", "혼성그룹": "그룹", "듀오": "듀오", "듀엣": "듀오", "밴드": "밴드", "인디밴드": "밴드"}


def canonical_types(values: Column) -> Column:
    """Distinct types whose spellings the values hold, sorted."""
    compact = F.transform(values, lambda x: F.regexp_replace(x, r"\s+", ""))
    holds = lambda alias: F.exists(compact, lambda x: F.contains(x, F.lit(alias)))
    hits = [F.when(holds(alias), F.lit(name)) for alias, name in TYPE_ALIASES.items()]
    return F.array_sort(F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull())))
