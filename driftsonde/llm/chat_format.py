"""Chat formatting: schema fingerprints select declarative mappings to canonical turns, which one template renders.

A layout's fingerprint is the SHA-256 of its sorted nested field paths; arrays add `[]` to a path, and `.`, `[` and `\\`
within a field's name have a `\\` before them. Typed tables are fingerprinted once from their schema, JSON records one by
one from the fields they hold; broken, too deeply nested and null records have no fingerprint. A mapping names, for its
fingerprint, where the turns are; optional fields have mappings of their own. Layouts that hold further fields take the
mapping of most fields that the rest would select. Layouts without a mapping raise for tables, and give null turns for
JSON records, with the fingerprint beside them.

The template marks a turn `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts `\\` becomes `\\\\` and `<|`
becomes `<\\|`, and in roles a line end becomes `\\n`, so control strings cannot occur there and `parse` gets back
exactly what went in. Null roles and texts are empty strings. Turns are ordered by turn (null first), then role and
text; repeated rows are repeated turns. A conversation is one row of the result, so it is formatted in one task. An
empty table gives an empty result, fields and columns that no mapping names are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftsonde.llm.arrays import chunks, map_batches

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


def _step(at: str | None, name: str) -> str:
    """The path of a field below `at`; marks of paths within names are escaped."""
    name = re.sub(r"([\\.\[])", r"\\\1", name)
    return name if at is None else f"{at}.{name}"


def schema_paths(kind: T.DataType, at: str | None = None) -> list[str]:
    """Nested field paths of a schema."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, _step(at, f.name))]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at or ''}[]")
    return [at or ""]


def value_paths(value: object, at: str | None = None) -> set[str]:
    """Nested field paths of a JSON value; null fields count as there."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in value_paths(v, _step(at, k))} or {f"{at or ''}.{{}}"}
    if isinstance(value, list):
        return {p for v in value for p in value_paths(v, f"{at or ''}[]")} or {f"{at or ''}[]"}
    return {at or ""}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """How to get turns from one layout.

    rows: one turn a row, with the columns (conversation, turn, role, text). messages: a list of (role, text) fields.
    fields: roles and the paths whose texts they say, joined by blank lines.
    """

    paths: tuple[str, ...]
    rows: tuple[str, str, str, str] | None = None
    messages: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))

    @property
    def key(self) -> str:
        return fingerprint(self.paths)


MAPPINGS = (
    Mapping(("conv_id", "turn", "role", "text"), rows=("conv_id", "turn", "role", "text"), roles=()),
    Mapping(("messages[].role", "messages[].content"), messages=("messages", "role", "content")),
    Mapping(("conversations[].from", "conversations[].value"), messages=("conversations", "from", "value")),
    Mapping(("prompt", "response"), fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("prompt", "completion"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping(("instruction", "output"), fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping(("instruction", "input", "output"), fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping(("system", "prompt", "response"), fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
)


def select_mapping(paths, mappings=MAPPINGS) -> Mapping | None:
    """The mapping of these paths' fingerprint, else the one of most paths whose fingerprint the paths give without the others."""
    paths, key = set(paths), fingerprint(paths)
    exact = next((m for m in mappings if m.key == key), None)
    within = sorted((m for m in mappings if fingerprint(paths & set(m.paths)) == m.key), key=lambda m: -len(m.paths))
    return exact or next(iter(within), None)


def _role(role: Column, mapping: Mapping) -> Column:
    out = F.coalesce(role, F.lit(""))
    for theirs, ours in mapping.roles:
        out = F.when(role == theirs, ours).otherwise(out)
    return out


def canonical_turns(rows: DataFrame, id_column: str = "conv_id", mappings=MAPPINGS, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, turns) of a typed table. Columns that the mapping doesn't name are not read; `extra` names some that it shall not."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    paths = schema_paths(T.StructType([f for f in rows.schema.fields if f.name not in extra]))
    mapping = select_mapping(paths, [m for m in mappings if not m.rows or id_column == m.rows[0]])
    if mapping is None:
        raise ValueError(f"no mapping for the layout {paths} (fingerprint {fingerprint(paths)})")
    if mapping.rows:
        conv, turn, role, said = mapping.rows
        one = F.struct(F.col(turn).alias("turn"), _role(F.col(role).cast("string"), mapping).alias("role"), text(F.col(said)).alias("text"))
        turns = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
        return rows.groupBy(F.col(conv).alias(id_column)).agg(turns.alias("turns"))
    if mapping.messages:
        many, role, said = mapping.messages
        turns = F.transform(F.coalesce(F.col(many), F.array()), lambda x: F.struct(_role(x[role].cast("string"), mapping).alias("role"), text(x[said]).alias("text")))
    else:
        turns = F.array(*(F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *(F.nullif(text(F.col(p)), F.lit("")) for p in paths)).alias("text")) for role, paths in mapping.fields))
    return rows.select(id_column, turns.alias("turns"))


def canonical_json_turns(rows: DataFrame, json_column: str, id_column: str, mappings=MAPPINGS) -> DataFrame:
    """(id, fingerprint, turns) of JSON records of mixed layouts; turns are null for unknown layouts and broken or null records."""
    known, chosen = [m for m in mappings if not m.rows], {}

    def said(x: object) -> str:
        plain = "" if x is None else x if isinstance(x, str) else json.dumps(x)
        return plain.encode("utf-8", "replace").decode()  # halves of surrogate pairs are no characters

    def turns(record: str | None) -> tuple[str | None, list | None]:
        try:
            value = json.loads(record or "")
            paths = value_paths(value)
        except (ValueError, RecursionError):
            return None, None
        key = fingerprint(paths)
        if key not in chosen:
            if len(chosen) > 10_000:
                chosen.clear()
            chosen[key] = select_mapping(paths, known)
        m = chosen[key]
        if m is None:
            return key, None
        names = dict(m.roles)
        if m.messages:
            many, role, text = m.messages
            return key, [{"role": names.get(r := said(x.get(role)), r), "text": said(x.get(text))} for x in value[many] if isinstance(x, dict)]
        return key, [{"role": role, "text": "\n\n".join(y for p in paths if (y := said(value[p])))} for role, paths in m.fields]

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            records = batch.column("record").to_pylist()
            for part in chunks([len(x or "") for x in records]):
                keys, every = zip(*map(turns, records[part]), strict=True)
                yield {"key": batch.column("key")[part.start : part.stop], "fingerprint": keys, "turns": every}

        return work

    kind = rows.schema[id_column].dataType.simpleString()
    read = rows.select(rows[id_column].alias("key"), rows[json_column].cast("string").alias("record"))
    return map_batches(read, make, f"key {kind}, fingerprint string, turns {TURNS}").withColumnRenamed("key", id_column)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Undo `escape`: a backslash stands for the character after it."""
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\", -1), lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|")))
    return F.array_join(parts, "\\")


def render(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """Add `formatted` and `loss_spans`: [start, end) in code points of what the role `trained` says, end mark left out."""
    one = lambda x: F.concat(F.lit(START), _escape_role(x["role"]), F.lit("\n"), escape(x["text"]), F.lit(f"{END}\n"))
    sizes = F.transform("turns", lambda x: F.struct(F.length(one(x)).cast("bigint").alias("all"), F.length(escape(x["text"])).cast("bigint").alias("said"), (x["role"] == trained).alias("on")))
    tail = len(END) + 1
    walk = F.aggregate(
        sizes,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["all"]).alias("at"),
            F.when(x["on"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["all"] - tail - x["said"]).alias("start"), (acc["at"] + x["all"] - tail).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return turns.select("*", F.array_join(F.transform("turns", one), "").alias("formatted"), walk.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns that a rendered text holds."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b.startswith(START))
    cut = lambda b: F.instr(b, "\n")
    head = len(START)
    return F.transform(
        blocks,
        lambda b: F.struct(_unescape_role(F.substring(b, F.lit(head + 1), cut(b) - head - 1)).alias("role"), unescape(F.substring(b, cut(b) + 1, F.length(b))).alias("text")),
    )


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def format_chats(rows: DataFrame, id_column: str = "conv_id", mappings=MAPPINGS, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, turns, formatted, loss_spans) of a typed table of any mapped layout; columns that `extra` names are left out."""
    return render(canonical_turns(rows, id_column, mappings, extra))
