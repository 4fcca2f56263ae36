"""Text features, cleaning, parsing and validation as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftsonde.functions.unicode import nfkc


def equality_key(text: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def base_title(title: Column) -> Column:
    """What stands before the first round or square bracket; the whole title if that is nothing."""
    whole = F.trim(F.coalesce(title, F.lit("")))
    head = F.trim(F.regexp_extract(whole, r"^([^(\[]*)", 1))
    return F.when(head == "", whole).otherwise(head)


#: What counts as a character of a title.
_LETTERS = "A-Za-z0-9가-힣\u4e00-\u9fff"


def title_features(title: Column) -> Column:
    """Script, counts and repetition of the base title; the *_anywhere flags look at all of it. Nothing is counted of titles without characters."""
    base = base_title(title)
    letters = F.regexp_replace(base, f"[^{_LETTERS}]", "")
    words = F.regexp_extract_all(F.lower(base), F.lit(f"([{_LETTERS}]+)"), F.lit(1))
    kinds = {"latin": "[A-Za-z]", "hangul": "[가-힣]", "hanja": "[\u4e00-\u9fff]", "numeric": "[0-9]"}
    has = {name: letters.rlike(pattern) for name, pattern in kinds.items()}
    n = reduce(lambda a, b: a + b, [x.cast("int") for x in has.values()])
    script = F.when(n > 1, "mixed")
    for name, flag in has.items():
        script = script.when(flag, name)
    anywhere = lambda pattern: F.coalesce(title.rlike(pattern), F.lit(False))
    one = lambda array: (F.size(array) >= 2) & (F.size(F.array_distinct(array)) == 1)
    chars = F.filter(F.split(F.lower(letters), ""), lambda c: c != "")
    return F.struct(
        base.alias("base"),
        script.alias("script"),
        F.nullif(F.length(letters), F.lit(0)).alias("char_count"),
        F.nullif(F.size(words), F.lit(0)).alias("word_count"),
        has["numeric"].alias("contains_number"),
        one(chars).alias("repeated_char"),
        one(words).alias("repeated_word"),
        *(anywhere(pattern).alias(f"{'number' if name == 'numeric' else name}_anywhere") for name, pattern in kinds.items()),
    )


def match_ratio(*asked: tuple[Column, Column]) -> Column:
    """Satisfied shares of what is asked: pairs of (wanted, actual), where a null wanted is not asked. Null if nothing is."""
    n = reduce(lambda a, b: a + b, [w.isNotNull().cast("int") for w, _ in asked])
    good = reduce(lambda a, b: a + b, [F.coalesce(w == a, F.lit(False)).cast("int") for w, a in asked])
    return F.when(n > 0, good / n)


#: Credits in brackets, and endings of names of persons.
_CREDITS = r"(?i)^(?:feat(?:uring)?\.?|with|prod(?:uced)?\.?|remix|remaster(?:ed)?|live|inst(?:rumental)?\.?|ost|ver(?:sion)?\.?)\b"
_NAME_ENDINGS = ("a", "ia", "na", "ella", "elle", "ina", "ine", "ette", "ita", "ito", "o", "us")


def title_meaning_ratio(title: Column, kind: Column) -> Column:
    """How well a title's look bears out a kind of meaning: a foreign name, a sentence, a question, an onomatopoeia."""
    f = title_features(title)
    latin = lambda text: F.regexp_extract_all(text, F.lit(r"([A-Za-z]+(?:[-'][A-Za-z]+)*)"), F.lit(1))

    def name_like(words: Column) -> Column:
        word = F.try_element_at(words, F.lit(1))
        plain = F.translate(word, "-'", "")
        shaped = (F.size(words) == 1) & (F.length(plain) >= 3) & plain.rlike("^[A-Z][a-z]+$")
        return F.when(shaped, F.when(plain.rlike(f"(?:{'|'.join(_NAME_ENDINGS)})$"), 1.0).otherwise(0.65)).otherwise(0.0)

    whole = F.trim(F.coalesce(title, F.lit("")))
    base = f["base"]
    notes = F.transform(F.regexp_extract_all(whole, F.lit(r"[\(\[]([^\)\]]+)[\)\]]"), F.lit(1)), lambda x: F.trim(x))
    alias = F.array_max(F.transform(F.filter(notes, lambda x: ~x.rlike(_CREDITS)), lambda x: name_like(latin(x))))
    korean = base.rlike("[가-힣]") & (F.size(latin(base)) == 0)
    own = name_like(latin(base))
    name = F.when(~f["latin_anywhere"], 0.0).when(korean & (alias > 0), 0.85 + 0.15 * alias).when(own > 0, 0.45 + 0.45 * own).otherwise(0.20)
    yes = lambda flag: F.coalesce(flag, F.lit(False)).cast("double")
    return (
        F.when(kind == "foreign_person_name", name)
        .when(kind == "sentence", yes(f["word_count"] >= 3))
        .when(kind == "question", yes(F.contains(whole, F.lit("?"))))
        .when(kind == "onomatopoeia", yes(f["repeated_char"] | f["repeated_word"]))
        .otherwise(0.0)
    )


def date_key(text: Column) -> Column:
    """Y, Y.M or Y.M.D with any separators to YYYY, YYYY.MM or YYYY.MM.DD; null if no year is there."""
    part = lambda i: F.regexp_extract(text, r"^\s*(\d{4})(?:\D+(\d{1,2}))?(?:\D+(\d{1,2}))?", i)
    two = lambda c: F.when(c != "", F.lpad(c, 2, "0"))
    return F.when(part(1) != "", F.concat_ws(".", part(1), two(part(2)), two(part(3))))


def listed(text: Column) -> Column:
    """A comma list to its trimmed, distinct items in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))


def labelled_passage(prefix: str, fields: list[tuple[str, Column]]) -> Column:
    """Labelled lines of the fields that have a value; EMPTY if none has."""
    lines = [F.when(F.trim(c) != "", F.concat(F.lit(f"{name}: "), F.trim(c))) for name, c in fields]
    body = F.concat_ws("\n", *lines)
    return F.concat(F.lit(f"{prefix}: "), F.when(body == "", "EMPTY").otherwise(body))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?]+[\s]+|\n+"), lambda x: F.trim(x)), lambda x: x != "")


def clean_fact(text: Column) -> Column:
    """Footnote marks off, white space single, no space before marks."""
    out = F.regexp_replace(nfkc(text), r"\[\d+\]", "")
    out = F.regexp_replace(out, r"\s+", " ")
    return F.trim(F.regexp_replace(out, r" ([.,;:!?])", "$1"))


def fact_issues(text: Column, title: Column, low: int = 12, high: int = 400) -> Column:
    """Why a fact can't be indexed; an empty array if it can."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    rules = [
        ("length", ~F.length(text).between(low, high)),
        ("unbalanced", (count("(") != count(")")) | (count("[") != count("]")) | (count('"') % 2 != 0)),
        ("dependent_start", F.lower(text).rlike(r"^(and|but|because|which|that)\b")),
        ("incomplete", text.rlike(r"[,:;(]$")),
        ("title_only", equality_key(text) == equality_key(title)),
    ]
    return F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules)), lambda x: x.isNotNull())


def classify(text: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """The first rule whose pattern is found."""
    out = F.lit(other)
    for name, pattern in reversed(rules):
        out = F.when(F.lower(text).rlike(pattern), name).otherwise(out)
    return out


def strip_tags(html: Column) -> Column:
    """Text of a page: scripts, styles and tags off, entities of markup back, white space single."""
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def hashtags(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"#([\p{L}\p{N}_]+)"), F.lit(1)), lambda x: F.lower(x)))


def comment_ok(text: Column, low: int = 8, high: int = 200, stop: str = r"(?i)subscribe|https?://|www\.") -> Column:
    """Long enough, short enough, no link or call to follow."""
    plain = strip_tags(text)
    return (F.length(plain) >= low) & (F.length(plain) < high) & ~plain.rlike(stop)


def era_window(text: Column) -> Column:
    """(start, end, confidence) of a year or a decade, with its early, mid or late third, named in a text; null if none is."""
    decade = F.regexp_extract(text, r"(\d{2,4})s\b", 1)
    year = F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1)
    two = F.try_to_number(decade, F.lit("9999")).cast("int")
    start = F.when(F.length(decade) == 4, two).when(F.length(decade) == 2, F.when(two <= 30, two + 2000).otherwise(two + 1900))
    lower = F.lower(text)
    early, mid, late = (lower.rlike(rf"\b{w}\b") for w in ("early", "mid", "late"))
    low = F.when(early, 0).when(mid, 4).when(late, 7).otherwise(0)
    high = F.when(early, 3).when(mid, 6).when(late, 9).otherwise(9)
    exact = F.try_to_number(year, F.lit("9999")).cast("int")
    return F.when(year != "", F.struct(exact.alias("start"), exact.alias("end"), F.lit(1.0).alias("confidence"))).when(
        start.isNotNull(), F.struct((start + low).alias("start"), (start + high).alias("end"), F.when(early | mid | late, 0.9).otherwise(0.8).alias("confidence"))
    )


def birth_window(birth: Column, first: int | Column, last: int | Column) -> Column:
    """Years in which someone born then was between `first` and `last`, a year wider on both sides, within 1900 to 2100."""
    return F.struct(F.greatest(F.lit(1900), birth + first - 1).alias("start"), F.least(F.lit(2100), birth + last + 1).alias("end"))


def digest(*columns: Column) -> Column:
    """SHA-256 of canonical values."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(c.cast("string"), F.lit("\u0000")) for c in columns)), 256)


def content_words(text: Column, stop: list[str]) -> Column:
    """Distinct words of two characters or more, in order, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2)), F.array(*map(F.lit, stop)))


def issues(df: DataFrame, id_column: str, rules: dict[str, Column]) -> DataFrame:
    """One row for each rule that a row breaks: id, reason."""
    broken = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items())), lambda x: x.isNotNull())
    return df.select(id_column, F.explode(broken).alias("reason"))


#: Fixed value: the name space of URLs in name-based UUIDs.
_URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(text: Column) -> Column:
    """The name-based UUID (SHA-1) of a text in the name space of URLs."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(_URL_SPACE)), F.encode(text, "UTF-8"))), 1, 32)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def point_id(text: Column) -> Column:
    """The number that up to 20 digits spell if it fits 64 bits, as a string; of anything else the name-based UUID. Never null, never raises."""
    plain = F.trim(F.coalesce(text.cast("string"), F.lit("")))
    number = F.when(plain.rlike("^[0-9]{1,20}$"), F.when(plain.rlike("^[0-9]{1,20}$"), plain).otherwise("0").cast("decimal(20,0)"))
    fits = F.coalesce(number <= F.lit("18446744073709551615").cast("decimal(20,0)"), F.lit(False))
    return F.when(fits, number.cast("string")).otherwise(uuid5(plain))


def birth_year(text: Column) -> Column:
    """The mean of the first two years that a text names, halves to even, within 1900 to 2100."""
    years = F.slice(F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1)), lambda y: y.cast("int")), 1, 2)
    mean = F.bround(F.try_divide(F.aggregate(years, F.lit(0), lambda acc, y: acc + y), F.size(years))).cast("int")
    return F.when((F.size(years) > 0) & mean.between(1900, 2100), mean)


#: Numbers in words, and words that make a remembered year unsure.
NUMBERS = {"한": 1, "두": 2, "세": 3, "네": 4, "다섯": 5, "여섯": 6, "일곱": 7, "여덟": 8, "아홉": 9, "열": 10}
UNSURE = ("같아", "같은데", "쯤", "정도", "기억")


def _window(start: Column, end: Column, confidence: Column) -> Column:
    low = F.greatest(F.lit(1900), F.least(F.lit(2100), start))
    return F.struct(low.cast("int").alias("start"), F.greatest(low, F.least(F.lit(2100), end)).cast("int").alias("end"), confidence.cast("double").alias("confidence"))


def korean_era(text: Column, now: int) -> Column:
    """(start, end, confidence) of the time that a Korean text names, seen from the year `now`; null if it names none.

    A year; a decade in four or two digits (up to 30 is this century) with its part; last year and the like; so many years
    ago, wider if unsure; some years ago; new; recent.
    """
    group = lambda pattern, i: F.regexp_extract(text, pattern, i)
    number = lambda c: F.when(c.rlike("^[0-9]+$"), F.when(c.rlike("^[0-9]{1,9}$"), c).otherwise("0").cast("int"))
    unsure = text.rlike("|".join(UNSURE))
    sure = F.when(unsure, 0.75).otherwise(0.9)
    part = r"(?:\s*(초중반|중후반|초반|중반|후반))?"
    exact = number(group(r"(?<!\d)((?:19|20)\d{2})\s*년(?!대)", 1))
    long, short = rf"(?<!\d)((?:19|20)\d0)\s*년대{part}", rf"(?<!\d)(\d0)\s*년대{part}"
    two = number(group(short, 1))
    decade = F.coalesce(number(group(long, 1)), F.when(two <= 30, two + 2000).otherwise(two + 1900))
    phase = F.when(group(long, 1) != "", group(long, 2)).otherwise(group(short, 2))
    low = F.when(phase.isin("중반", "중후반"), 4).when(phase == "후반", 7).otherwise(0)
    high = F.when(phase == "초반", 3).when(phase.isin("초중반", "중반"), 6).otherwise(9)
    count = group(rf"(\d+|{'|'.join(NUMBERS)})\s*년\s*(쯤|정도)?\s*전", 1)
    ago = number(count)
    for word, n in NUMBERS.items():
        ago = F.when(count == word, n).otherwise(ago)
    about = (group(rf"(\d+|{'|'.join(NUMBERS)})\s*년\s*(쯤|정도)?\s*전", 2) != "") | unsure
    this = F.lit(now)
    return (
        F.when(exact.isNotNull(), _window(exact, exact, sure))
        .when(decade.isNotNull(), _window(decade + low, decade + high, sure))
        .when(text.rlike("재작년"), _window(this - 2, this - 2, F.lit(0.85)))
        .when(text.rlike("작년"), _window(this - 1, this - 1, F.lit(0.85)))
        .when(text.rlike("올해|금년"), _window(this, this, F.lit(0.90)))
        .when(ago.isNotNull(), F.when(about, _window(this - ago - 1, this - ago + 1, F.lit(0.60))).otherwise(_window(this - ago, this - ago, F.lit(0.75))))
        .when(text.rlike(r"몇\s*년\s*(?:쯤|정도)?\s*전"), _window(this - 8, this - 2, F.lit(0.35)))
        .when(text.rlike(r"최신곡?|신곡|막\s*나온\s*(?:곡|노래)"), _window(this - 1, this, F.lit(0.65)))
        .when(text.rlike(r"최근|요즘|요새|근래|얼마\s*안\s*된\s*(?:곡|노래)"), _window(this - 8, this, F.lit(0.35)))
    )


def title_shape(text: Column) -> Column:
    """(script, char_count, strong) of a title's shape that a query names: its script, and how many characters it has."""
    near = lambda words: text.rlike(rf"(?:{words}).{{0,8}}(?:제목|글자|이름)|(?:제목|이름).{{0,8}}(?:{words})")
    script = F.when(near("알파벳|영어|영문"), "latin").when(near("한자"), "hanja").when(near("한글"), "hangul")
    said = F.regexp_extract(text, rf"(\d+|{'|'.join(NUMBERS)})\s*글자", 1)
    count = F.when(said.rlike("^[0-9]{1,9}$"), F.when(said.rlike("^[0-9]{1,9}$"), said).otherwise("0").cast("int"))
    for word, n in NUMBERS.items():
        count = F.when(said == word, n).otherwise(count)
    return F.struct(script.alias("script"), count.alias("char_count"), (script.isNotNull() & count.isNotNull()).alias("strong"))


def json_object(text: Column) -> Column:
    """The JSON object that noisy text holds: without a code fence, else from the first brace to the last; null if that is no object."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    object_of = lambda c: F.when(F.get_json_object(c, "$").startswith("{"), c)
    return F.coalesce(object_of(bare), object_of(F.regexp_extract(bare, r"(?s)(\{.*\})", 1)))


def quote_span(text: Column, quote: Column) -> Column:
    """(start, end, problem) of a quote in its source, in code points: a quote must be there, and once only."""
    at = F.instr(text, quote)
    rest = F.substring(text, at + 1, F.length(text))
    problem = F.when(at == 0, "quote_not_in_source").when(F.contains(rest, quote), "quote_occurs_multiple_times")
    return F.struct(F.when(problem.isNull(), at - 1).alias("start"), F.when(problem.isNull(), at - 1 + F.length(quote)).alias("end"), problem.alias("problem"))


def needs_rendering(html: Column, least: int = 200) -> Column:
    """Whether a page is a shell that scripts fill: next to no text, but scripts."""
    return (F.length(strip_tags(html)) < least) & html.rlike(r"(?i)<script")


def challenge(html: Column) -> Column:
    """Whether a page asks to prove that no robot reads it."""
    return F.lower(html).rlike(r"captcha|cf-challenge|just a moment|access denied|unusual traffic")


def popularity(views: Column) -> Column:
    return F.when(views >= 100_000_000, "legend").when(views >= 10_000_000, "hit").when(views >= 1_000_000, "known").otherwise("quiet")
