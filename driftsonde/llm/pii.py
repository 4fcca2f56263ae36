"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

The base kinds keep every confirmed match: email, ip (parts at most 255), card (12 to 19 digits passing Luhn), phone
(9 to 15 digits). A further kind, iban (mod-97), is kept where its score reaches `threshold`. The patterns are tried
only inside runs of characters that a match of theirs can hold, so long texts cost one scan. Spans are code points,
end exclusive; matches of a kind don't overlap, kinds may.

Null and empty texts have no spans. Rows are independent: ties and repeated rows change nothing, an empty table gives
an empty result, extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftsonde.llm.arrays import map_batches, text_chunks

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = 4
#: An email is a run of these, an @ and a domain.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: The same matches as `[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`: none can start within a run of digits that none starts at.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_DIGITS = re.compile(r"[0-9+][0-9+\x20().-]*+")
_IBAN_HEAD = re.compile(r"[A-Z]{2}[0-9]{2}")
#: Score before context, and how much a context word within `reach` characters adds.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.7}
CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|contact|write to|mailto)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server|login)\b", re.I),
    "card": re.compile(r"\b(?:card|credit|visa|mastercard|payment)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|transfer)\b", re.I),
}


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _is_ip(text: str) -> bool:
    return all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in text.split(".")))


def _is_card(text: str) -> bool:
    d = _digits(text)
    return 12 <= len(d) <= 19 and luhn(d)


def _is_phone(text: str) -> bool:
    return 9 <= len(_digits(text)) <= 15


def _is_iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and mod97(plain)


def _email_spans(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost emails that don't overlap. Every @ looks back no further than to the one before, so that it's one scan."""
    low, at = 0, text.find("@")
    while at >= 0:
        begin = low + len(text[low:at].rstrip(LOCAL))
        low = at + 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            low = m.end()
        at = text.find("@", low)


def find_spans(text: str, reach: int = 40, threshold: float = 0.7) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of all kept spans, ordered by start, then kind."""
    found = [(a, b, "email") for a, b in _email_spans(text)] if "@" in text else []
    for run in _DIGITS.finditer(text):
        a, own = run.start(), run[0].rstrip("+ ().-")
        if len(own) < 7:
            continue
        if own.count(".") >= 3:
            found += [(a + m.start(), a + m.end(), "ip") for m in IP.finditer(own) if _is_ip(m[0])]
        if len(own) >= 12:
            found += [(a + m.start(), a + m.end(), "card") for m in CARD.finditer(own) if _is_card(m[0])]
        if "+" in own:
            found += [(a + m.start(), a + m.end(), "phone") for m in PHONE.finditer(own) if _is_phone(m[0])]
    if _IBAN_HEAD.search(text):
        found += [(*m.span(), "iban") for m in IBAN.finditer(text) if _is_iban(m[0])]
    out = []
    for a, b, kind in found:
        near = CONTEXT[kind].search(text, max(0, a - reach), min(len(text), b + reach)) is not None
        score = min(1.0, SCORES[kind] + 0.2 * near)
        if KINDS.index(kind) < BASE or score >= threshold:
            out.append((a, b, kind, score))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def pii_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: its id and `found`, an array of (start, end, kind, score)."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for part, texts in text_chunks(batch):
                found = [[{"start": a, "end": b, "kind": k, "score": s} for a, b, k, s in find_spans(x)] for x in texts]
                yield {"key": batch.column("key")[part.start : part.stop], "found": found}

        return work

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("key"), docs[text_column].cast("string").alias("text"))
    return map_batches(rows, make, f"key {kind}, found array<struct<start:bigint,end:bigint,kind:string,score:double>>").withColumnRenamed("key", id_column)


def redact(text: str) -> str:
    """The text with each span, or chain of overlapping ones, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for a, b, kind, _ in find_spans(text):
        if a >= at:
            out.append(f"{text[at:a]}[{kind.upper()}]")
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_pii(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """`docs` with its texts redacted; null texts stay null. All other columns are kept as they are."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else redact(x))

    return docs.withColumn(text_column, F.pandas_udf(run, "string")(F.col(text_column).cast("string")))
