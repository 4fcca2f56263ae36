"""What a query says in words: lyric phrases with how sure they are, and voices and genres that it states."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from driftsonde.functions.unicode import surface_of

#: Words that speak of lyrics, marks of quotes, and words that make a phrase a description.
CUES = ("가사", "가삿말", "노랫말", "구절", "후렴", "도입부", "브릿지")
DESCRIPTIONS = ("내용", "식의", "식으로", "이야기", "주제", "분위기", "느낌", "의미", "횟수")
DESCRIPTION_ENDS = ("다는", "한다는", "했다는", "였다는", "있다는", "없다는", "했던", "하는", "하는 내용")
_QUOTED = re.compile(r"[\"'“”‘’]([^\"'“”‘’\n]{2,120})[\"'“”‘’]")
#: How a phrase stands beside a cue, with the confidence of each.
_BESIDE = (
    (re.compile(r"(?:가사|가삿말|노랫말|후렴|도입부)(?:에서|에는|에|중에)?\s*(?:이|가|은|는|도)?\s*[:：-]?\s*([^,.!?\n]{2,100}?)\s*(?:이라는|라는|이라고|라고|이런|그런|비슷한)\s*(?:말|가사|가삿말|노랫말|구절|부분|소리)"), 0.92),
    (re.compile(r"(?:^|[,.!?]\s*|(?:근데|그리고|또)\s+)([^,.!?\n]{2,100}?)\s*(?:이라는|라는|이라고|라고)\s*(?:가사|가삿말|노랫말|구절|말|소리)(?:이|가|은|는|도|을|를)?\s*(?:있|나오|들리|반복|시작|기억|했|한)"), 0.90),
    (re.compile(r"(?:^|[,.!?]\s*)([^,.!?\n]{3,80}?)\s+(?:가사|가삿말|노랫말|구절)(?:이|가|은|는|도|을|를)?\s*(?:있|나오|들리|반복|시작|기억|였|이었)"), 0.82),
    (re.compile(r"(?:가사|가삿말|노랫말|후렴|도입부)(?:이|가|은|는)[ \t]*([^,.!?\n]{2,80}?)[ \t]*(?:하고[ \t]*(?:나오|나왔|들리|들렸|시작)|라고[ \t]*(?:했|나오|나왔|들리|들렸))"), 0.82),
)


def _plain(phrase: str) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", phrase)).strip(" \"'“”‘’~…-–—")


def _fits(phrase: str, quoted: bool) -> bool:
    """A phrase is short, more than a number and, unless quoted, no description and no talk of lyrics."""
    if not 2 <= len(phrase) <= 100 or surface_of(phrase).isdigit():
        return False
    spoken = any(w in phrase for w in (*CUES, *DESCRIPTIONS)) or phrase.endswith(DESCRIPTION_ENDS) or len(phrase.split()) > 14
    return quoted or not (spoken or any(c in phrase for c in "\"'“”‘’"))


def lyric_clues_of(query: str, around: int = 36) -> list[dict]:
    """Phrases that a query gives as lyrics: quoted ones near a cue for sure, others by how they stand beside one. Of equal surfaces the surest stays."""
    found: dict[str, dict] = {}

    def add(text: str, kind: str, confidence: float) -> None:
        phrase, key = _plain(text), surface_of(text)
        if key and _fits(phrase, kind == "verbatim") and confidence > found.get(key, {"confidence": 0.0})["confidence"]:
            found[key] = {"text": phrase, "kind": kind, "confidence": confidence}

    if any(c in query for c in CUES):
        for m in _QUOTED.finditer(query):
            if any(c in query[max(0, m.start() - around) : m.end() + around] for c in CUES):
                add(m[1], "verbatim", 1.0)
        for pattern, confidence in _BESIDE:
            for m in pattern.finditer(query):
                add(m[1], "partial", confidence)
    return list(found.values())


def lyric_clues(query: Column) -> Column:
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: [] if x is None else lyric_clues_of(x))

    return F.pandas_udf(run, "array<struct<text:string,kind:string,confidence:double>>")(query)


#: Words of voices and genres, other spellings of genres, and words that take a statement back.
VOICE_WORDS = {"남녀": "혼성", "혼성": "혼성", "남자": "남성", "남성": "남성", "남돌": "남성", "여자": "여성", "여성": "여성", "여돌": "여성", "걸그룹": "여성", "보이그룹": "남성"}
PERFORMERS = "가수|보컬|아이돌|솔로|래퍼|밴드|듀오|듀엣|그룹|목소리|음색|보이스|노래|곡|부르|부른|불렀"
GENRE_WORDS = {"발라드": "발라드", "댄스": "댄스", "힙합": "힙합", "랩곡": "힙합", "알앤비": "알앤비", "알엔비": "알앤비", "r&b": "알앤비", "소울": "소울", "록": "록", "락": "록", "메탈": "메탈", "인디": "인디", "포크": "포크", "블루스": "블루스", "일렉트로니카": "일렉트로니카", "edm": "일렉트로니카", "트로트": "트로트", "재즈": "재즈"}
TAKEN_BACK = r"모르|확실하지|헷갈|긴가민가|인지|였는지|일\s*수도|일지도|아닐|기억.{0,4}안|아니|아닌|말고|빼고|없이"


def slot_statements(query: Column) -> Column:
    """(voice, genre) that a query states for sure: clause by clause, quotes left out; null where it states none, or takes it back within three words."""
    clauses = F.split(F.regexp_replace(query, r"[\"“‘'][^\"”’'\n]*[\"”’']", " "), r"[,.!?\n]+|(?<=지만)\s|(?<=는데)\s|(?<=인데)\s")

    low = F.lower(query)  # patterns are tried where their word stands at all

    def stated(words: dict[str, str], behind: str) -> Column:
        one = []
        for word, value in words.items():
            pattern = rf"(?i)(?<![가-힣a-z0-9]){re.escape(word)}(?!\s*친구){behind}"
            back = rf"{pattern}\S*\s*(?:\S+\s+){{0,2}}\S*(?:{TAKEN_BACK})"
            one.append(F.when(F.contains(low, F.lit(word)) & F.exists(clauses, lambda c: c.rlike(pattern) & ~c.rlike(back)), F.lit(value)))  # noqa: B023  called at once
        return F.filter(F.array(*one), lambda x: x.isNotNull())

    voices = F.array_distinct(stated(VOICE_WORDS, rf"(?=\s*(?:\S+\s+){{0,3}}\S*(?:{PERFORMERS}))"))
    voice = F.when(F.array_contains(voices, "혼성") | (F.size(voices) > 1), "혼성").otherwise(F.try_element_at(voices, F.lit(1)))
    genres = stated(GENRE_WORDS, r"(?!\s*(?:기타|베이스|드럼|카페|클럽|라는\s*말))")
    return F.struct(voice.alias("voice"), F.try_element_at(genres, F.lit(1)).alias("genre"))
