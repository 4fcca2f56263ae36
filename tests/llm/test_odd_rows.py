"""Rows that are odd in ways that have broken operators: huge numbers, repeated ids, clashing names, hostile texts."""

import json
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftsonde.llm import ann_block, arrays, chat_format, pii, quality_pu


def near(rows, k=5, schema="vec_id bigint, embedding array<double>", **options):
    def run(spark):
        out = {}
        for r in ann_block.nearest(spark.createDataFrame(rows, schema), F.col("vec_id") % 20 == 0, k=k, **options).collect():
            out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        return {q: sorted(x) for q, x in out.items()}

    return run


def test_huge_vectors_have_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (x * 10.0 ** (200 if i % 2 else 150)).tolist()) for i, x in enumerate(rng.standard_normal((60, 6)))]
    got = near(rows, strips=2)(spark)
    for q in (0, 20, 40):
        a = np.array(rows[q][1])
        score = lambda c: ann_block.inner(a[None], np.array(rows[c][1])[None])[0]
        want = sorted((np.inf if np.isnan(score(c)) else -score(c), c) for c in range(60) if c != q)[:5]
        assert [v for _, v, _ in got[q]] == [c for _, c in want]


def test_a_repeated_query_asks_once_and_repeated_rows_are_candidates(spark):
    rng = np.random.default_rng(3)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.standard_normal((40, 4)))]
    rows += [rows[0], rows[0], rows[7], rows[7]] + [(100 + i, rows[9][1]) for i in range(50)]
    got = near(rows, strips=2, query_block=1)(spark)
    for q in (0, 20, 100, 120, 140):
        a = np.array(dict(rows)[q])
        want = sorted((-ann_block.inner(a[None], np.array(v)[None])[0], c) for c, v in rows if c != q)[:5]
        assert [(v, s) for _, v, s in got[q]] == [(c, -s) for s, c in want]
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]


def test_nearest_sends_k_rows_a_query_and_strip(spark):
    rng = np.random.default_rng(4)
    block = ann_block.Nearest(np.arange(3), rng.standard_normal((3, 8)), 4)
    for _ in range(5):
        block.take(rng.integers(10, 10_000, 500), rng.standard_normal((500, 8)))
    assert len(block.rows()) == 12


def test_clashing_columns_do_not_matter(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0], i % 2, 1, 1, 1) for i in range(30)], "vec_id bigint, embedding array<double>, label int, id int, vector int, dim int")
    assert ann_block.nearest(rows, F.col("vec_id") % 20 == 0, k=3).count() == 6
    chats = spark.createDataFrame([(1, 0, "user", "hi", "x", 3)], "conv_id bigint, turn int, role string, text string, turns string, formatted int")
    assert chat_format.format_chats(chats).first()["formatted"] == "<|im_start|>user\nhi<|im_end|>\n"


def test_hostile_json_records_give_null_or_text(spark):
    records = [
        {"messages[].role": "user", "messages[].content": "hi"},
        {"": {"prompt": "a", "response": "b"}},
        {"messages": [{"role": "user"}, {"content": "x"}]},
        {"messages": [{"role": "user", "content": {}}, "odd", None]},
        {"prompt": "hi", "response": "yo", "meta": {"n": 1}},
        {"prompt": 3, "response": None},
        [],
        {},
        "text",
    ]
    texts = [json.dumps(r) for r in records] + ["[" * 100_000, '{"prompt": "\\ud800", "response": "b"}', '{"\\ud800": 1}', "", None]
    table = spark.createDataFrame(list(enumerate(texts)), "key int, record string")
    got = {r["key"]: r["turns"] and [tuple(t) for t in r["turns"]] for r in chat_format.canonical_json_turns(table, "record", "key").collect()}
    assert [got[i] for i in (0, 1, 6, 7, 8, 9, 11, 12, 13)] == [None] * 9
    assert got[2] == [("user", ""), ("", "x")]
    assert got[4] == [("user", "hi"), ("assistant", "yo")]
    assert got[5] == [("user", "3"), ("assistant", "")]
    assert got[10] == [("user", "?"), ("assistant", "b")]


def test_long_runs_cost_one_scan():
    n = 300_000
    texts = ["a" * n + "@", "a" * n + "@b." * 5, "a@" * (n // 2), "0" * n + ".1.1.1", "1" * n + "." * 9, "1." * (n // 2), "+" * n, "+ " * (n // 2), "+1" + "(" * n, "1 " * (n // 2), "a" * n + "@b.c" + "d" * n]
    for text in texts:
        began = time.perf_counter()
        pii.find_spans(text)
        assert time.perf_counter() - began < 5, text[:20]
    assert [s[2] for s in pii.find_spans("0" * 5000 + ".1.1.1")] == ["ip"]
    assert pii.find_spans("9" * 5000 + ".1.1.1") == []


def test_base_patterns_on_their_own_alphabets():
    rnd = random.Random(6)
    plain = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub(r"\D", "", s)) <= 19 and pii.luhn(re.sub(r"\D", "", s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15),
    }
    for alphabet in ("ab.@-_", "012.", "01 -", "+01 .()-", "a@.1+ "):
        for _ in range(3000):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
            want = sorted(((m.start(), m.end(), k) for k, (p, ok) in plain.items() for m in re.finditer(p, text) if ok(m[0])), key=lambda x: (x[0], pii.KINDS.index(x[2])))
            assert [s[:3] for s in pii.find_spans(text) if s[2] != "iban"] == want, text


def test_repeated_ids_give_the_classifier_one_row_each(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i} here") for i in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] * 3, "doc_id bigint, quality int, toxic int")
    model = quality_pu.train(docs, labels, sample=10)
    assert model.weights.shape == (quality_pu.WIDTH + 1,) and model.decay in quality_pu.DECAYS
    assert quality_pu.score(docs, model).count() == 400


def test_a_cluster_without_a_shared_folder_raises():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: "")

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        arrays.shared_dir(Session)
