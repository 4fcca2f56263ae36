"""Every registered query of the subpackage and every stage of the pipeline, over tables with odd rows, extra columns and no rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftsonde.llm import jaccard_join, line_dedup, piece_codec, pii, queries
from driftsonde.llm.graphs import Forest

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
#: Names that operators use inside, as extra columns.
CLASHING = ("key", "node", "component", "component_id", "_gone", "gone", "_key", "block", "chunk", "score", "held_out", "n_lines", "N_DROPPED", "found", "text2", "stays", "start", "d1")
ODD = [None, "", " ", "\n\n", "a", "a b", "x" * 3000, "word " * 4000, "<|endoftext|> it's 42²! Σς ﬁ😀 ümlaut　漢字\x85", "mail a.b@c.de now\ncard 4111 1111 1111 1111", "0" * 5000 + ".1.1.1"]


def tables(rnd):
    prose = lambda n: " ".join(f"w{rnd.randrange(2500)}" for _ in range(n))
    base = ["\n".join(prose(rnd.randint(8, 40)) for _ in range(rnd.randint(1, 4))) for _ in range(40)]
    texts = base + base[:6] * 2 + [x + " tail" for x in base[6:14]] + [f"{base[k]}\n{prose(12)}" for k in (20, 20, 21)] + ODD
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    docs += [docs[1], (2, "another text of the same id that says something else", None, None, None)]
    labels = [(i, int(i < 30), 0) for i in range(0, 70, 2)] + [(None, 1, 0), (4, 1, 0)]
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((60, 8)).astype(np.float32)
    vectors[10:20] = vectors[10] + 0.1 * rng.standard_normal((10, 8)).astype(np.float32)
    vectors[20:25] = vectors[20]
    bad = [None, [], [0.0] * 8, [float("nan")] * 8, [None] + [1.0] * 7]
    embeddings = [(i, v.tolist(), None if i == 12 else i % 2 if i < 10 else 1) for i, v in enumerate(vectors)] + [(100 + i, v, 1) for i, v in enumerate(bad)]
    turns = [(c, t, ["user", "assistant", None][t % 3], [texts[(7 * c + t) % 60], "<|im_end|>\\n", None][t % 3]) for c in range(9) for t in range(c)]
    return {"documents": docs, "labels": labels, "embeddings": embeddings, "conversations": turns}


def written(spark, at, rows, extra=()):
    for name, schema in SCHEMAS.items():
        table = spark.createDataFrame(rows.get(name, []), schema).withColumns({c: F.lit(i) for i, c in enumerate(extra)})
        table.repartition(3).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    rows = tables(random.Random(3))
    return written(spark, tmp_path_factory.mktemp("odd"), rows), rows


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("clash"), tables(random.Random(3)), CLASHING)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("empty"), {})


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def sets(rows, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.queries()) + ["pipeline"])
def test_extra_columns_change_nothing(spark, fixture, clashing, name):
    run = {**queries.queries(), **corpus_pipeline.queries()}[name]
    plainly, beside = run(spark, fixture[0]), run(spark, clashing)
    keys = [c for c in plainly.columns if c not in ("sequence_id", "offset")]
    assert sets(plainly.collect(), keys) == sets(beside.collect(), keys)


@pytest.mark.parametrize("name", sorted(queries.queries()) + ["pipeline"])
def test_empty_tables_give_empty_results(spark, empty, name):
    run = {**queries.queries(), **corpus_pipeline.queries()}[name]
    assert run(spark, empty).count() == (1 if name == "op1_chat_format" else 0)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("where", ["fixture", "/root/testdata/sf0.001"])
def test_equals_sql(spark, fixture, name, where):
    at = fixture[0] if where == "fixture" else where
    con = duckdb.connect()
    for table in SCHEMAS:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet{'/*.parquet' if where == 'fixture' else ''}'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, at)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    theirs = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert sets(got.collect(), columns) == sets(theirs, columns)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def groups(rows, n, num, den):
    """Component of each id by brute force: rows of one id are one node."""
    held = [(i, shingles(t, n)) for i, t in rows]
    size = max((i for i, _ in rows), default=0) + 1
    forest = Forest(size)
    for a in range(len(held)):
        for b in range(a):
            if held[a][1] and den * len(held[a][1] & held[b][1]) >= num * len(held[a][1] | held[b][1]):
                forest.union(held[a][0], held[b][0])
    return {i: forest.find(i) for i, _ in rows}


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))


def test_packing_query(spark, fixture):
    lib, by = library(), {}
    texts = [(r[0], r[1] or "") for r in fixture[1]["documents"]]
    for r in queries.op3_packing(spark, fixture[0]).collect():
        by.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for i in {i for i, _ in texts}:
        want = []
        for own in (t for j, t in texts if j == i):
            ids = np.array([*lib.encode(own, add_special_tokens=False).ids, 1], "<u4")
            want.append((len(ids), {zlib.crc32(ids[a : a + 2048].tobytes()) for a in range(0, len(ids), 2048)}))
        assert sorted(n for n, _ in want) == sorted(t for s, _, _, t in by[i] if s == 0)
        assert sum(n for n, _ in want) == sum(n for _, n, _, _ in by[i])
        assert {c for _, _, c, _ in by[i]} == set().union(*(c for _, c in want))


def test_quality_query(spark, fixture):
    got = queries.op5_quality_pu(spark, fixture[0]).collect()
    assert len(got) == len(fixture[1]["documents"])
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_codec_query(spark, fixture):
    codec = piece_codec.PieceCodec(queries.tokenizer_path("piece_bpe_32k.model"))
    got = sets(queries.op6_piece_codec(spark, fixture[0]).collect(), ["doc_id", "n_ids", "ids_crc32", "round_trip"])
    want = []
    for i, text, *_ in fixture[1]["documents"]:
        ids = codec.model.encode(text or "")
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True))
    assert got == sorted(want, key=repr)


def test_jaccard_query(spark, fixture):
    rows = [(r[0], r[1]) for r in fixture[1]["documents"]]
    want = groups(rows, 3, 90, 100)
    got = queries.op7_jaccard_join(spark, fixture[0]).collect()
    assert sets(got, ["doc_id", "n_shingles", "component_id"]) == sorted(((i, len(shingles(t, 3)), want[i]) for i, t in rows), key=repr)


def test_line_query(spark, fixture):
    got = sets(queries.op8_line_dedup(spark, fixture[0]).collect(), ["doc_id", "n_lines", "n_dropped", "kept_chars", "kept_sha256"])
    rows = lines_by_brute_force([(r[0], r[1]) for r in fixture[1]["documents"]])
    want = [(i, -1 if t is None else len(t.split("\n")), n, None if k is None else len(k), None if k is None else hashlib.sha256(k.encode()).hexdigest()) for i, t, k, n in rows]
    assert [tuple(None if x == -1 else x for x in r) for r in got] == [tuple(None if x == -1 else x for x in r) for r in sorted(want, key=repr)]


def lines_by_brute_force(rows):
    """(id, text, kept text, lines dropped): of lines linked by edit similarity, the one of the smallest (id, line number) stays, in every row of its id."""
    at = sorted({(i, j, line_dedup.normalise(x)) for i, t in rows for j, x in enumerate((t or "").split("\n")) if len(line_dedup.normalise(x)) >= 16})
    forest = Forest(len(at))
    for a in range(len(at)):
        for b in range(a):
            if forest.find(a) != forest.find(b) and (at[a][2] == at[b][2] or line_dedup.similar(at[a][2], at[b][2], 0.8)):
                forest.union(a, b)
    stays = {at[k][2]: at[forest.find(k)][:2] for k in range(len(at))}
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, t, None, 0))
            continue
        lines = t.split("\n")
        gone = [stays.get(line_dedup.normalise(x), (i, j)) != (i, j) for j, x in enumerate(lines)]
        out.append((i, t, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), sum(gone)))
    return out


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub(r"\D", "", s)) <= 19 and pii.luhn(re.sub(r"\D", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15),
}


def test_pii_query(spark, fixture):
    want = []
    for i, text, *_ in fixture[1]["documents"]:
        own = sorted(((m.start(), m.end(), k) for k, (p, ok) in BASE.items() for m in re.finditer(p, text or "") if ok(m[0])), key=lambda x: (x[0], list(BASE).index(x[2])))
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in own)
        want.append((i, *(sum(x[2] == k for x in own) for k in BASE), hashlib.sha256(joined.encode()).hexdigest(), joined))
    got = queries.op9_pii(spark, fixture[0]).collect()
    assert sets(got, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]) == sorted(want, key=repr)


def test_token_query(spark, fixture):
    lib, want = library(), []
    for i, text, *_ in fixture[1]["documents"]:
        n = len(lib.encode(text or "", add_special_tokens=False).ids)
        want.append((i, len((text or "").encode()), n, n > 2048))
    assert sets(queries.op10_token_count(spark, fixture[0]).collect(), ["doc_id", "n_bytes", "n_tokens", "over_limit"]) == sorted(want, key=repr)


def test_pipeline_stages_do_what_their_operators_decide(spark, fixture):
    at = fixture[0]
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "personal_data", "pack"]
    kept = corpus_pipeline.quality(spark, docs, at)
    good = {r["doc_id"] for r in queries.op5_quality_pu(spark, at).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} <= good and kept.columns == docs.columns
    lines = corpus_pipeline.lines(spark, docs, at)
    by_hand = [(i, k) for i, t, k, n in lines_by_brute_force([(r["doc_id"], r["text"]) for r in docs.collect()]) if not n or k.strip()]
    assert sets(lines.collect(), ["doc_id", "text"]) == sorted(by_hand, key=repr)
    assert lines.columns == docs.columns and lines.where("n_chars <> coalesce(length(text), 0)").count() == 0
    near = corpus_pipeline.near_duplicates(spark, docs, at)
    want = groups([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 8, 10)
    assert sorted({r["doc_id"] for r in near.collect()}) == sorted(i for i, c in want.items() if i == c)
    clean = corpus_pipeline.personal_data(spark, docs, at)
    assert sets(clean.collect(), ["doc_id", "text"]) == sorted(((r["doc_id"], None if r["text"] is None else pii.redact(r["text"])) for r in docs.collect()), key=repr)
    assert "a.b@c.de" not in "".join(r["text"] or "" for r in clean.collect())
    out = corpus_pipeline.run(spark, at)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} <= good
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0
