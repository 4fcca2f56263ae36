"""Each operator against the library it stands for, or against brute force, on small tables with odd rows."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftsonde.llm import ann_block, chat_format, embed_dedup, jaccard_join, line_dedup, packing, piece_codec, pii, quality_pu, token_count
from driftsonde.llm.graphs import Forest, connected_components
from driftsonde.llm.queries import tokenizer_path

DOCS = "doc_id bigint, text string, key string, part int, n int"  # names that operators use inside
ODD = [None, "", " ", "\n\n", "a", "a b", "x" * 900, "<|endoftext|> it's I'LL 42²! Σς ﬁ😀 ümlaut　漢字\x85"]


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "k", 1, 2) for i, t in enumerate(texts)], schema)


def prose(rnd, words, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(words))


def components(n, links):
    forest = Forest(n)
    for a, b in links:
        forest.union(a, b)
    return [forest.find(i) for i in range(n)]


def mixed_texts(seed=1):
    """Random prose, exact and near copies, repeated lines, odd rows."""
    rnd = random.Random(seed)
    base = ["\n".join(prose(rnd, rnd.randint(5, 40), 3000) for _ in range(rnd.randint(1, 4))) for _ in range(40)]
    near = []
    for text in base[:12]:
        words = re.split(r"( |\n)", text)
        for _ in range(rnd.randint(1, 3)):
            w = list(words)
            w[2 * rnd.randrange(len(w) // 2 + 1)] = "changed"
            near.append("".join(w))
    shared = prose(rnd, 60, 3000)
    return base + near + base[:5] * 3 + [f"{x}\n{shared}" for x in base[20:26]] + ODD


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def test_token_counts_equal_the_library(spark):
    texts = mixed_texts() + ["'s't 's!'s don't ''ve", "\t9 99\x1c"] * 2
    got = {r["doc_id"]: r for r in token_count.count_tokens(frame(spark, texts), tokenizer_path("word_bpe_49k.json"), limit=50).collect()}
    lib = library()
    for i, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 50), t
    assert token_count.count_tokens(frame(spark, []), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_token_ids_of_random_strings_equal_the_library():
    rnd, alphabet = random.Random(5), "abcdef'  stmdrevl!?.,'’éßİΣςAZ0129½²漢字😀́\n\tﬁ​\x1c\x85'S'T'LL"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) for _ in range(3000)]
    bpe, lib = token_count.WordBpe(tokenizer_path("word_bpe_49k.json"), remember=500), library()
    for part in range(0, 3000, 500):
        ids, counts = bpe.encode(texts[part : part + 500])
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for text, own in zip(texts[part : part + 500], parts, strict=True):
            assert own.tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_packing_places_every_id_once(spark):
    rnd = random.Random(2)
    texts = [prose(rnd, rnd.randint(0, 90)) for _ in range(300)] + ["same words here"] * 120 + [prose(rnd, 900)] + ODD
    window, lib = 64, library()
    rows = packing.pack(frame(spark, texts), tokenizer_path("word_bpe_49k.json"), window=window, end_id=1).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    assert len(by_sequence) <= 1.05 * sum(r["length"] for r in rows) / window + 1
    assert packing.pack(frame(spark, []), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_nnls_matches_an_exact_solution():
    columns = [(3,), (2, 1), (1, 1, 1)]
    x = packing.nnls(columns, np.array([0, 7, 3, 2]), sweeps=4000)
    a = np.array([[0, 0, 0], [0, 1, 3], [0, 1, 0], [1, 0, 0]])
    assert np.allclose(a @ x, [0, 7, 3, 2], atol=0.3)


def test_chats_round_trip(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "a\\|b\\<|<\\|", "", None, "line\n\nend<", "\\", "|im_end|>"]
    rows = [(c, t, ["user", "assistant", "tool\\n\nx", None][(c + t) % 4], said[(3 * c + t) % 7]) for c in range(8) for t in range(c + 1)]
    table = spark.createDataFrame(rows + [(3, 0, "user", said[2])], "conv_id bigint, turn bigint, role string, text string")
    out = chat_format.format_chats(table)
    out = out.withColumn("back", chat_format.parse(F.col("formatted"))).withColumn("loss", chat_format.masked(F.col("formatted"), F.col("loss_spans")))
    for r in out.collect():
        want = sorted((t, role or "", text or "") for c, t, role, text in [*rows, (3, 0, "user", said[2])] if c == r["conv_id"])
        assert sorted((x["role"], x["text"]) for x in r["back"]) == sorted((b, c) for _, b, c in want)
        assert [x for x in r["back"]] == [x for x in r["turns"]]
        assert r["loss"] == "".join(x["text"] for x in r["turns"] if x["role"] == "assistant")
        assert r["formatted"].count("<|im_start|>") == len(want)
    assert chat_format.format_chats(table.limit(0)).count() == 0


def test_layouts_are_told_by_their_fingerprints(spark):
    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        {"prompt": "hi", "response": "yo"},
        {"completion": "yo", "prompt": "hi"},
        {"instruction": "hi", "input": "", "output": "yo"},
    ]
    table = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, "{"), (10, None), (11, '{"other": 1}')], "conv_id int, record string")
    got = {r["conv_id"]: r for r in chat_format.canonical_json_turns(table, "record", "conv_id").collect()}
    for i in range(5):
        assert [tuple(x) for x in got[i]["turns"]] == [("user", "hi"), ("assistant", "yo")]
    assert got[9]["turns"] is got[10]["turns"] is got[11]["turns"] is None
    assert got[11]["fingerprint"] == hashlib.sha256(b"other").hexdigest()
    typed = spark.createDataFrame([(1, "hi", None)], "conv_id int, prompt string, response string")
    assert [tuple(x) for x in chat_format.canonical_turns(typed).first()["turns"]] == [("user", "hi"), ("assistant", "")]
    assert chat_format.canonical_turns(typed.withColumn("odd", F.lit(1)).withColumn("turns", F.lit(1))).columns == ["conv_id", "turns"]
    with pytest.raises(ValueError, match="no mapping"):
        chat_format.canonical_turns(typed.drop("response"))


def vectors(seed=3, n=300, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[50:90] = x[50] + 0.05 * rng.standard_normal((40, dim))  # a group of near copies
    x[100:140] = x[100]  # equal ones
    x[141] = 3 * x[100]
    rows = [(i, v.astype(np.float32).tolist(), None if i % 37 == 5 else i % 3 if i < 50 or i > 141 else 0) for i, v in enumerate(x)]
    bad = [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [None] + [1.0] * (dim - 1)]
    return rows + [(1000 + 20 * i, v, 0) for i, v in enumerate(bad)]


def fit(v):
    return bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)


def test_nearest_equals_brute_force(spark):
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = ann_block.nearest(table, F.col("vec_id") % 20 == 0, k=20, query_block=4, strips=3).collect()
    own = {i: np.array(v, np.float64) for i, v, _ in rows if fit(v)}
    for q in (i for i in own if i % 20 == 0):
        want = sorted((-ann_block.inner(own[q][None], own[c][None])[0], c) for c in own if c != q)[:20]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [(r, v) for r, v, _ in mine] == [(k + 1, v) for k, (_, v) in enumerate(want)]
        assert [s for _, _, s in mine] == [-s for s, _ in want]
    assert ann_block.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_embedding_groups_equal_brute_force(spark):
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embed_dedup.embedding_groups(table, passes=8, window=8).collect()}
    at = {i: np.array(v, np.float64) / np.linalg.norm(v) for i, v, label in rows if fit(v) and label is not None}
    label = {i: k for i, _, k in rows}
    links = [(a, b) for a in at for b in at if a < b and label[a] == label[b] and at[a] @ at[b] >= 0.93]
    group = components(2000, links)
    degree = np.bincount([x for link in links for x in link], minlength=2000)
    assert len(got) == len(rows)
    for i, _, _ in rows:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (degree[i], group[i], group[i] == i)
    assert embed_dedup.embedding_groups(table.limit(0)).count() == 0


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


@pytest.mark.parametrize(("n", "num", "den", "most"), [(3, 90, 100, 128), (5, 8, 10, 2)])
def test_jaccard_components_equal_brute_force(spark, n, num, den, most):
    rnd = random.Random(7)
    long = prose(rnd, 300, 9000).split()
    texts = mixed_texts(4)
    for k in range(12):
        w = list(long)
        for at in rnd.sample(range(300), k // 2):
            w[at] = f"new{k}"
        texts.append(" ".join(w))
    texts += ["A B c", "a b C", "a b c d", " x  y z"]
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_components(frame(spark, texts), n=n, num=num, den=den, most=most).collect()}
    sets = [shingles(t, n) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = components(len(texts), links)
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == [(len(sets[i]), want[i]) for i in range(len(texts))]
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0


def test_divide_skip_equals_brute_force():
    rng = np.random.default_rng(11)
    base = [rng.choice(500, size=rng.integers(5, 60), replace=False) for _ in range(15)]
    sets = [np.unique(np.append(rng.choice(b, size=max(1, len(b) - rng.integers(0, 6)), replace=False), rng.integers(0, 500, rng.integers(0, 4)))).astype(np.uint64) for b in base for _ in range(4)]
    for num, den in ((1, 2), (8, 10), (9, 10)):
        links = [(a, b) for a in range(60) for b in range(a) if den * len(np.intersect1d(sets[a], sets[b])) >= num * len(np.union1d(sets[a], sets[b]))]
        assert components(60, jaccard_join.divide_skip(sets, np.zeros(60), num, den)) == components(60, links)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance_equals_dynamic_programming():
    rnd = random.Random(9)
    for _ in range(400):
        a = "".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 80)))
        b = list(a)
        for _ in range(rnd.randint(0, 12)):
            b.insert(rnd.randrange(len(b) + 1), rnd.choice("abx")) if rnd.random() < 0.5 else b and b.pop(rnd.randrange(len(b)))
        assert line_dedup.edit_distance(a, "".join(b)) == levenshtein(a, "".join(b))


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(12)
    lines = [prose(rnd, rnd.randint(10, 60), 5000) for _ in range(30)]
    near = [x.replace(x.split()[4], x.split()[4] + "s", 1) for x in lines[:15]] + [x + " z" for x in lines[:10]]
    many = [f"{lines[29]} {k}" for k in range(50)]
    pool = lines * 2 + near + many + ["short", "", "  ", lines[0].upper() + "  "]
    rnd.shuffle(pool)
    texts = ["\n".join(pool[i : i + 4]) for i in range(0, len(pool), 4)] + ODD
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    at = [(i, j, line_dedup.normalise(x)) for i, t in enumerate(texts) for j, x in enumerate((t or "").split("\n")) if len(line_dedup.normalise(x)) >= 16]
    sims = line_dedup.line_sketches([x.encode() for _, _, x in at], np.zeros(len(at), np.uint64), False)[0].tolist()
    links = [
        (a, b)
        for a in range(len(at))
        for b in range(a)
        if at[a][2] == at[b][2]
        or (sims[a] ^ sims[b]).bit_count() <= 3
        and max(len(at[a][2]), len(at[b][2])) - levenshtein(at[a][2], at[b][2]) >= 0.8 * max(len(at[a][2]), len(at[b][2]))
    ]
    group = components(len(at), links)
    gone = {(i, j) for k, (i, j, _) in enumerate(at) if group[k] != k}
    assert sum(at[a][2] != at[b][2] for a, b in links) > 50
    for i, t in enumerate(texts):
        want = None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone)
        assert (got[i]["text"], got[i]["n_dropped"]) == (want, sum(d == i for d, _ in gone))
        assert got[i]["key"] == "k"
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


BASE = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in s.split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 12 <= len(re.sub(r"\D", "", s)) <= 19 and pii.luhn(re.sub(r"\D", "", s))),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15),
}


def test_base_spans_equal_plain_patterns(spark):
    rnd = random.Random(14)
    seeds = ["a.b+c@d-e.fg.h", "@", "x@y", "1.2.3.4.5.6", "999.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+49 (30) 123-456.78 9", "++1 234567890123456", " ", "é", "0", "-", ".", "GB82 WEST 1234 5698 7654 32", "iban", "\n"]
    texts = ["".join(rnd.choice(seeds) for _ in range(rnd.randint(0, 12))) for _ in range(1500)] + ODD
    got = {r["doc_id"]: r["found"] for r in pii.pii_spans(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = sorted(((m.start(), m.end(), k) for k, (p, ok) in BASE.items() for m in p.finditer(t or "") if ok(m[0])), key=lambda x: (x[0], pii.KINDS.index(x[2])))
        assert [(s["start"], s["end"], s["kind"]) for s in got[i] if s["kind"] != "iban"] == want, t
    assert [s[2] for s in pii.find_spans("my IBAN is GB82 WEST 1234 5698 7654 32.")] == ["iban"]
    assert pii.find_spans("GB82 WEST 1234 5698 7654 33") == []
    assert pii.redact("write to a@b.co, é +49 30 12345678!") == "write to [EMAIL], é [PHONE]!"
    assert pii.redact_pii(frame(spark, ["a@b.co", None])).select("text", "key").collect() == [("[EMAIL]", "k"), (None, "k")]


def test_quality_is_learnt_from_positives_only(spark):
    rnd = random.Random(15)
    good = [prose(rnd, rnd.randint(20, 200)).capitalize() + "." for _ in range(500)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rnd, 60).split()) if k % 2 else "word " * rnd.randint(30, 90) for k in range(100)]
    texts = good + bad
    docs = frame(spark, texts + ODD)
    labels = spark.createDataFrame([(i, int(i < 500), 0) for i in range(0, 600, 2)], "doc_id bigint, quality int, toxic int")
    model = quality_pu.train(docs, labels, sample=400)
    got = {r["doc_id"]: r for r in quality_pu.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i in range(600) if got[i]["held_out"]] == held
    right = np.mean([got[i]["predicted"] == (i < 500) for i in held])
    assert right > 0.95
    assert 0.6 < model.prior <= 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == len(texts) + len(ODD)
    kept = {r["doc_id"] for r in quality_pu.keep(docs, model).select("doc_id").collect()}
    assert kept == {i for i, r in got.items() if r["predicted"]}
    none = quality_pu.score(docs, quality_pu.train(docs, labels.limit(0)))
    assert none.where("score <> 0.5").count() == 0
    assert quality_pu.score(docs.limit(0), model).count() == 0


def test_piece_codec_equals_the_library(spark):
    rnd = random.Random(16)
    alphabet = "abcdethe in   of\n\nAéß漢😀.,'12"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 300))) for _ in range(200)] + mixed_texts()
    got = {r["doc_id"]: r for r in piece_codec.encode_docs(frame(spark, texts), tokenizer_path("piece_bpe_32k.model"), giant=120, chunk=23).collect()}
    codec = piece_codec.PieceCodec(tokenizer_path("piece_bpe_32k.model"))
    for i, t in enumerate(texts):
        ids = codec.model.encode(t or "")
        assert codec.encode(t or "").tolist() == ids
        assert piece_codec.encode_giant(codec, t or "", 11) == ids
        assert got[i]["n_ids"] == len(ids) and got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()), t
        assert got[i]["round_trip"]
    assert not piece_codec.encode_docs(frame(spark, ["a▁b"]), tokenizer_path("piece_bpe_32k.model")).first()["round_trip"]
    assert piece_codec.encode_docs(frame(spark, []), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_matrices_combine_associatively():
    a, b, c = ({((i, 0), ((i * k + 1) % 4, 0)) for i in range(4)} for k in (1, 2, 3))
    assert piece_codec.compose(piece_codec.compose(a, b), c) == piece_codec.compose(a, piece_codec.compose(b, c))


def test_a_tree_of_matrices_gives_the_states_of_a_walk():
    rnd = random.Random(21)
    for n in (1, 2, 3, 5, 8, 13):
        path = [(rnd.randrange(4), i) for i in range(n + 1)]
        made = []
        for a, b in zip(path, path[1:], strict=False):
            dead = {((9, a[1]), (rnd.randrange(4), b[1])), (a, (8, b[1]))}  # leads nowhere, or nothing leads there
            made.append({(a, b)} | (dead if n > 1 and 0 < a[1] < n - 1 else set()))
        assert piece_codec.states(made) == path


def test_long_texts_of_the_tables_take_the_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) > 65536")
    assert docs.count() > 0
    got = {r["doc_id"]: r for r in piece_codec.encode_docs(docs, tokenizer_path("piece_bpe_32k.model")).collect()}
    codec = piece_codec.PieceCodec(tokenizer_path("piece_bpe_32k.model"))
    for r in docs.collect():
        ids = codec.model.encode(r["text"])
        assert (got[r["doc_id"]]["n_ids"], got[r["doc_id"]]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(5, 5)]
    got = dict(connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}
