"""Unicode forms that no built-in expression makes, as Arrow batch functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Runs of what str.isalnum() holds of.
_ALNUM = re.compile(r"[^\W_]+")


def surface_of(text: str) -> str:
    """Compatibility form, lower case, letters and digits only."""
    return "".join(_ALNUM.findall(unicodedata.normalize("NFKC", text).lower()))


def with_origins(text: str) -> tuple[str, list[int]]:
    """The surface made character by character, and the place in `text` that each of its characters comes from."""
    made = [(c, i) for i, x in enumerate(text) for c in unicodedata.normalize("NFKC", x).lower() if c.isalnum()]
    return "".join(c for c, _ in made), [i for _, i in made]


def identity_of(text: str) -> str:
    """Case, accents, marks and spaces taken off, whatever the script."""
    folded = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
    bare = unicodedata.normalize("NFC", "".join(c for c in folded if unicodedata.category(c) != "Mn"))
    return re.sub(r"[\W_]+", "", bare)


def excerpt_of(text: str, phrase: str) -> str | None:
    """The lines of `text` around the first place whose surface is the phrase's; none if the place, made a surface again, is another."""
    wanted = surface_of(phrase)
    plain, origins = with_origins(text)
    at = plain.find(wanted) if wanted else -1
    if at < 0:
        return None
    begin, end = origins[at], origins[at + len(wanted) - 1] + 1
    if surface_of(text[begin:end]) != wanted:
        return None
    stop = text.find("\n", end)
    return text[text.rfind("\n", 0, begin) + 1 : stop if stop >= 0 else len(text)].strip()


def _mapped(make: Callable[[str], str], column: Column) -> Column:
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else make(x))

    return F.pandas_udf(run, "string")(column.cast("string"))


def nfkc(column: Column) -> Column:
    return _mapped(lambda x: unicodedata.normalize("NFKC", x), column)


def identity_key(column: Column) -> Column:
    return _mapped(identity_of, column)


def unicode_surface(column: Column) -> Column:
    return _mapped(surface_of, column)


def excerpt(text: Column, phrase: Column) -> Column:
    def run(texts: pd.Series, phrases: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or p is None else excerpt_of(t, p) for t, p in zip(texts, phrases, strict=True)])

    return F.pandas_udf(run, "string")(text, phrase)
