"""What explicit clues of a query add to a candidate's score: one column a rule, so that the ledger is the plan.

A candidate is a row of query columns and catalogue columns. Query columns (all may be null): want_title, want_artist,
want_voice, want_genre, keywords (array), clues (array of kind, text, variants, confidence), title_constraints (struct of
script, char_count, word_count, contains_number, repeated_char, repeated_word, confidence), meaning (struct of kind,
confidence), era (struct of start, end, confidence), types (struct of values, confidence), performance (struct of count,
roles, sounds, confidence). Catalogue columns: title, artist, vocal_gender, genre, artist_types (array), release_date,
lyrics_highlight, lyrics_summary, clue_text (`track_text`), and lyric_match_type, set where a lyric path found the row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftsonde.functions import text as T
from driftsonde.operators.filters import FEMALE, MALE, MIXED
from driftsonde.operators.fusion import UNIT, era_similarity
from driftsonde.operators.surface import surface

#: Sounds by the words that the catalogue has for them; a sound without an entry stands for itself.
SOUND_ALIASES: dict[str, tuple[str, ...]] = {
    "밴드사운드": ("밴드", "록", "락", "기타", "드럼"),
    "어쿠스틱": ("어쿠스틱", "통기타", "언플러그드"),
    "오케스트라": ("오케스트라", "관현악", "웅장한 현악"),
    "전자음악": ("전자음", "일렉트로닉", "신스", "신디사이저", "edm"),
    "라이브": ("라이브", "공연", "관객"),
    "아카펠라": ("아카펠라", "무반주"),
    "브라스": ("브라스", "트럼펫", "트롬본", "색소폰"),
    "스트링": ("스트링", "현악", "바이올린", "첼로"),
    "피아노": ("피아노", "건반"),
    "기타": ("기타", "guitar"),
    "퍼커션": ("퍼커션", "드럼", "타악기"),
    "휘파람": ("휘파람", "휘슬", "whistle", "whistling"),
    "비프음": ("비프", "삐삐", "beep"),
    "벨소리": ("벨소리", "종소리", "차임", "초인종"),
    "박수": ("박수", "손뼉", "clap"),
    "핑거스냅": ("핑거스냅", "손가락", "snap"),
    "사이렌": ("사이렌", "경보음", "siren"),
    "전화음": ("전화", "연결음", "통화음", "수화기"),
    "자연음": ("빗소리", "파도", "새소리", "바람소리", "물소리"),
    "플루트": ("플루트", "플룻", "피리"),
    "하모니카": ("하모니카",),
    "국악": ("국악", "판소리", "가야금", "해금", "대금", "장구"),
    "인도풍": ("인도", "볼리우드", "시타르", "이국적"),
    "중동풍": ("중동", "아랍", "이국적"),
}
#: What marks a featured voice in a title or an artist's name.
FEATURED = r"(?i)(?:\bfeat(?:uring)?\.?\b|\bwith\b|피처링|듀엣)"
#: Words of rap genres, choirs, narration and choruses.
RAP = ("힙합", "랩", "hip hop", "hip-hop", "rap")
CHOIR = ("합창", "콰이어", "성가대", "떼창")
NARRATION = ("나레이션", "내레이션", "낭독")
CHORUS = ("코러스", "합창", "콰이어", "떼창")


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])


def _number(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)).cast("double")


def track_text(*columns: Column) -> Column:
    """Lower-case clue text of a row, empty parts left out."""
    return F.lower(F.array_join(F.filter(F.array(*(c.cast("string") for c in columns)), lambda x: F.coalesce(x != "", F.lit(False))), " "))


def featured(title: Column, artist: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(artist, F.lit(""))).rlike(FEATURED)


def performance_similarity(clue: Column, voice: Column, types: Column, text: Column, genre: Column, is_featured: Column) -> Column:
    """Mean over the kinds of clues that are there (how many voices, which roles, which sounds) of how well a row bears them out."""
    is_type = lambda name: F.coalesce(F.array_contains(types, name), F.lit(False))
    is_voice = lambda *names: F.coalesce(F.trim(voice).isin(*names), F.lit(False))
    when = lambda flag, value: F.when(flag, value).otherwise(0.0)
    rap = _number(_holds(F.lower(F.coalesce(genre, F.lit(""))), RAP))
    count = (
        F.when(clue["count"] == "duet", F.greatest(when(is_voice(MIXED), 1.0), when(is_featured, 0.90), when(is_type("듀오"), 0.75)))
        .when(clue["count"] == "solo", F.greatest(when(is_type("솔로") & ~is_featured, 0.85), when(is_voice(MALE, FEMALE) & ~is_featured, 0.70)))
        .when(clue["count"] == "multiple", F.greatest(when(is_type("그룹"), 0.90), when(is_voice(MIXED), 0.75), when(is_featured, 0.65)))
        .when(F.length(clue["count"]) > 0, _number(_holds(text, CHOIR)))
    )

    def role(r: Column) -> Column:
        return (
            F.when(r == "남성랩", 0.65 * rap + 0.35 * _number(is_voice(MALE, MIXED)))
            .when(r == "여성랩", 0.65 * rap + 0.35 * _number(is_voice(FEMALE, MIXED)))
            .when(r == "남성노래", _number(is_voice(MALE, MIXED)))
            .when(r == "여성노래", _number(is_voice(FEMALE, MIXED)))
            .when(r == "피처링보컬", _number(is_featured))
            .when(r == "나레이션", _number(_holds(text, NARRATION)))
            .when(r.isin("코러스", "합창"), _number(_holds(text, CHORUS)))
        )

    def sound(s: Column) -> Column:
        own = _number(F.contains(text, F.lower(s)))
        for name, aliases in SOUND_ALIASES.items():
            own = F.when(s == name, _number(_holds(text, tuple(a.lower() for a in aliases)))).otherwise(own)
        return own

    def mean(values: Column) -> Column:
        known = F.filter(values, lambda x: x.isNotNull())
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x) / F.size(known))

    parts = F.array(count, mean(F.transform(clue["roles"], role)), mean(F.transform(clue["sounds"], sound)))
    return F.coalesce(mean(parts), F.lit(0.0))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([0-9a-z가-힣]+)"), F.lit(1))


def matched_field(surfaces: Column, highlight: Column, summary: Column) -> Column:
    """Where any of the surfaces is: highlight, summary, or only in both together."""
    inside = lambda text: F.exists(surfaces, lambda x: (x != "") & F.contains(surface(F.coalesce(text, F.lit(""))), x))
    return F.when(inside(highlight), "highlight").when(inside(summary), "summary").otherwise("combined")


def boost_rules(scale: float = 1.0, attribute_scale: float = 1.0, mismatch_scale: float = 0.0, genre_scale: float = 1.0) -> dict[str, Column]:
    """Each rule's addition to a candidate, 0 where it doesn't apply. Scales other than finite and non-negative raise."""
    for value in (scale, attribute_scale, mismatch_scale, genre_scale):
        if not 0 <= value < float("inf"):
            raise ValueError(f"a scale must be finite and not negative, not {value}")
    unit, c = UNIT * scale, F.col
    unit_of_attributes = unit * attribute_scale
    plain = lambda x: T.equality_key(F.coalesce(x, F.lit("")))
    text = F.concat_ws(" ", F.nullif(c("lyrics_highlight"), F.lit("")), F.nullif(c("lyrics_summary"), F.lit("")))
    unfound = c("lyric_match_type").isNull()

    clues = F.filter("clues", lambda x: x["kind"].isin("verbatim", "partial", "phonetic"))
    surfaces = lambda x: F.transform(F.concat(F.array(x["text"]), F.coalesce(x["variants"], F.array().cast("array<string>"))), surface)
    here = surface(text)
    first = F.try_element_at(F.filter(clues, lambda x: F.exists(surfaces(x), lambda s: (s != "") & F.contains(here, s))), F.lit(1))
    lyric = F.when(unfound & first.isNotNull(), F.when(first["kind"] == "phonetic", 2.5).otherwise(4.0) * first["confidence"] * unit)

    asked = F.array_distinct(F.flatten(F.transform("keywords", _words)))
    cover = F.size(F.array_intersect(asked, _words(text))) / F.size(asked)
    keyword = F.when(unfound & (F.size(asked) > 0) & (cover > 0), F.when(cover == 1, 2.0).otherwise(0.5 * cover) * unit)

    wanted = c("title_constraints")
    title = T.title_features(c("title"))
    pairs = [(wanted[name], title[feature]) for name, feature in ((n, n) for n in ("script", "char_count", "word_count", "contains_number", "repeated_char", "repeated_word"))]
    ratio = T.match_ratio(*pairs)
    voice, actual = F.trim(c("want_voice")), F.trim(c("vocal_gender"))
    known = (F.length(voice) > 0) & (F.length(actual) > 0)
    either = F.array_sort(F.array(voice, actual)) == F.array_sort(F.array(F.lit(MALE), F.lit(FEMALE)))
    gender = (
        F.when(known & (voice == actual), 1.0)
        .when(known & (actual == MIXED) & voice.isin(MALE, FEMALE), 0.25)
        .when(known & (voice == MIXED) & actual.isin(MALE, FEMALE), -0.5 * mismatch_scale)
        .when(known & either, -1.0 * mismatch_scale)
    )
    year = F.regexp_extract("release_date", r"((?:19|20)\d{2})", 1)
    era = era_similarity(F.when(year != "", year.cast("int")), c("era")["start"], c("era")["end"]) * F.when(c("era")["confidence"] > 0, c("era")["confidence"])
    kinds = F.arrays_overlap("artist_types", c("types")["values"]).cast("double") * c("types")["confidence"]
    performed = performance_similarity(c("performance"), c("vocal_gender"), c("artist_types"), c("clue_text"), c("genre"), featured(c("title"), c("artist")))
    within = lambda small, large: (plain(small) != "") & F.contains(plain(large), plain(small))
    rules = {
        "lyric_clue": lyric,
        "lyric_keyword_tokens": keyword,
        "title_exact": F.when((plain(c("want_title")) != "") & (plain(c("want_title")) == plain(c("title"))), 5.0 * unit),
        "title_constraints": ratio * wanted["confidence"] * unit,
        "title_hanja_presence": F.when((wanted["script"] == "hanja") & title["hanja_anywhere"], 2.0 * wanted["confidence"] * unit),
        "title_meaning": T.title_meaning_ratio(c("title"), c("meaning")["kind"]) * c("meaning")["confidence"] * (1.25 * unit),
        "artist_match": F.when(within(c("want_artist"), c("artist")), unit),
        "vocal_gender": gender * unit_of_attributes,
        "release_era": era * (1.25 * unit_of_attributes),
        "artist_type": kinds * unit_of_attributes,
        "performance_clues": F.when(c("performance")["confidence"] > 0, performed * c("performance")["confidence"] * (1.50 * unit_of_attributes)),
        "genre_match": F.when(within(c("want_genre"), c("genre")), unit_of_attributes * genre_scale),
    }
    return {name: F.coalesce(value.cast("double"), F.lit(0.0)) for name, value in rules.items()}


def apply_boosts(candidates: DataFrame, **scales: float) -> DataFrame:
    """Candidates (with `score`) with a column of each rule's addition and `boosted`, the score with all of them added in their order."""
    rules = boost_rules(**scales)
    rows = candidates.withColumns({f"boost_{n}": r for n, r in rules.items()})
    return rows.withColumn("boosted", reduce(lambda a, b: a + b, [F.col(f"boost_{n}") for n in rules], F.col("score")))


def exact_lyric_tier(title_ratio: Column | None = None) -> Column:
    """How well a row that has the lyric word for word fits what else the query says."""
    c = F.col
    plain = lambda x: T.equality_key(F.coalesce(x, F.lit("")))
    within = lambda small, large: (plain(small) != "") & F.contains(plain(large), plain(small))
    voice, actual = F.trim(c("want_voice")), F.trim(c("vocal_gender"))
    either = F.array_sort(F.array(voice, actual)) == F.array_sort(F.array(F.lit(MALE), F.lit(FEMALE)))
    known = (F.length(voice) > 0) & (F.length(actual) > 0)
    gender = F.when(known & (voice == actual), 2.0).when(known & (actual == MIXED) & voice.isin(MALE, FEMALE), 0.5).when(known & either, -2.0).otherwise(0.0)
    parts = [
        F.when((plain(c("want_title")) != "") & (plain(c("want_title")) == plain(c("title"))), 4.0).otherwise(0.0),
        F.when(within(c("want_artist"), c("artist")), 3.0).otherwise(0.0),
        F.coalesce(gender, F.lit(0.0)),
        F.when(within(c("want_genre"), c("genre")), 1.0).otherwise(0.0),
    ]
    if title_ratio is not None:
        parts.append(F.coalesce(title_ratio, F.lit(0.0)))
    return reduce(lambda a, b: a + b, parts)
