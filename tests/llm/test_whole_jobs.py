"""Operators against the whole job by brute force, where a shortcut of the operator could lose a part."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from driftsonde.llm import embed_dedup, line_dedup, piece_codec, queries
from driftsonde.llm.graphs import Forest

DOCS = "doc_id bigint, text string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_link_by_edit_similarity_alone(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8)))
    base = [[word() for _ in range(k)] for k in (6, 8, 10, 10, 15, 20, 20, 30, 30, 40, 60)]
    lines = [" ".join(x) for x in base]
    for words in base:
        for changed in (1, len(words) // 8):
            near = list(words)
            for at in rnd.sample(range(len(words)), changed):
                near[at] = word()
            lines.append(" ".join(near))
        lines.append(" ".join(f"{x}!" if i % 3 else x for i, x in enumerate(words)))
    rnd.shuffle(lines)
    forest, links = Forest(len(lines)), []
    for i, a in enumerate(lines):
        for j in range(i):
            longer = max(len(a), len(lines[j]))
            if longer - distance(a, lines[j]) >= 0.8 * longer:
                links.append((i, j))
                forest.union(i, j)
    sims = line_dedup.line_sketches([x.encode() for x in lines], np.zeros(len(lines), np.uint64), False)[0].tolist()
    assert sum((sims[i] ^ sims[j]).bit_count() > 3 for i, j in links) > 20
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), DOCS), hamming=None).collect()}
    assert got == {i: int(forest.find(i) != i) for i in range(len(lines))}


def test_embeddings_link_whatever_lies_between(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(64)
    at = 0.7 * centre / np.linalg.norm(centre) + 0.714 * rng.standard_normal((4000, 64)) / 8  # a hot label
    at /= np.linalg.norm(at, axis=1, keepdims=True)
    for i in range(200):
        off = rng.standard_normal(64)
        off -= off @ at[i] * at[i]
        at[2000 + i] = 0.931 * at[i] + np.sqrt(1 - 0.931**2) * off / np.linalg.norm(off)
    table = spark.createDataFrame([(i, v.tolist(), 1 + i // 3990) for i, v in enumerate(at)], "vec_id bigint, embedding array<double>, label int").repartition(7)
    near = at @ at.T >= 0.93
    near &= (np.arange(4000) // 3990)[:, None] == (np.arange(4000) // 3990)[None, :]
    np.fill_diagonal(near, False)
    forest = Forest(4000)
    for a, b in zip(*np.nonzero(near), strict=True):
        forest.union(int(a), int(b))
    for most in (300, 2048):
        got = {r["vec_id"]: r for r in embed_dedup.embedding_groups(table, passes=1, window=2, most=most).collect()}
        assert [(got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in range(4000)] == [(near[i].sum(), forest.find(i), forest.find(i) == i) for i in range(4000)]


def planted(rnd, line, kind, vocabulary):
    """A line near another one: words replaced (one, or up to a share of its characters), or single characters."""
    words = line.split()
    if kind == "one word":
        words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        return " ".join(words)
    share = float(kind.split()[1])
    if kind.startswith("characters"):
        chars = list(line)
        for at in rnd.sample(range(len(chars)), int(share * len(chars))):
            chars[at] = rnd.choice("abcdefghijkl")
        return line_dedup.normalise("".join(chars))
    left = share * len(line)
    for at in rnd.sample(range(len(words)), len(words)):
        word = rnd.choice(vocabulary)
        left -= max(len(words[at]), len(word))
        if left < 0:
            break
        words[at] = word
    return " ".join(words)


def candidate_share(lines, near):
    """Share of pairs that share a key and pass the wide filter."""
    sims, keys = line_dedup.line_sketches([x.encode() for x in lines + near], np.arange(2 * len(lines), dtype=np.uint64), True)
    n = len(lines)
    size = np.array([len(x) for x in lines + near])
    fit = line_dedup._near(sims[:n], size[:n], sims[n:], size[n:], (line_dedup.WIDE, line_dedup.NARROW), 0.8)
    return float(np.mean([f and bool(np.intersect1d(a, b).size) for f, a, b in zip(fit.tolist(), keys[:n], keys[n:], strict=True)]))


def test_near_lines_are_candidates_whatever_their_length():
    import pyarrow.parquet as pq

    rnd = random.Random(4)
    lines = sorted({line_dedup.normalise(x) for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist() for x in (t or "").split("\n")})
    vocabulary = [w for x in rnd.sample(lines, 1000) for w in x.split()]
    for low, high in ((16, 40), (40, 80), (80, 128), (128, 300), (300, 800), (800, 9000)):
        pool = [x for x in lines if low <= len(x) < high and len(x.split()) > 2]
        for kind, least in (("one word", 0.85 if high == 40 else 0.95), ("words 0.1", 0.9), ("words 0.18", 0.85)):
            pairs = [(x, y) for x in rnd.sample(pool, min(300, len(pool))) if (y := planted(rnd, x, kind, vocabulary)) != x and line_dedup.similar(x, y, 0.8)]
            if len(pairs) > 30:
                assert candidate_share(*map(list, zip(*pairs, strict=True))) >= least, (low, kind)


def test_similar_pairs_at_once_equal_one_by_one():
    rnd = random.Random(9)
    lines = ["", "q"]
    for n in (1, 5, 63, 64, 65, 100, 128, 129, 200, 300) * 24:
        line = [rnd.choice("abcdé漢 😀") for _ in range(n)]
        near = list(line)
        for _ in range(int(n * rnd.choice((0.1, 0.19, 0.22)))):
            at = rnd.randrange(len(near))
            near[at : at + 1] = rnd.choice(["", "z", "zq"])
            near = near or ["q"]
        lines += ["".join(line), "".join(near)]
    a, b = np.triu_indices(len(lines), 1)
    fit = np.array([min(len(lines[i]), len(lines[j])) >= 0.8 * max(len(lines[i]), len(lines[j])) for i, j in zip(a, b, strict=True)])
    a, b = a[fit][::2], b[fit][::2]
    got = line_dedup.similar_pairs(lines, a, b, 0.8)
    assert got.tolist() == [line_dedup.similar(lines[i], lines[j], 0.8) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert got.sum() > 50


def crowded():
    """Lines around a few large keys, and which of them go if all near pairs of each key are compared."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 7)))
    common, lines = [word() for _ in range(9)], []
    for _ in range(200):  # all share most of their words; the other words of similar ones differ in a letter each, so that no small key leads there
        own = [word() for _ in range(6)]
        lines.append(" ".join([*common, *own]))
        lines.append(" ".join([*common, *(x[: len(x) // 2] + "z" + x[len(x) // 2 + 1 :] for x in own)]))
    lines += [" ".join(word() for _ in range(12)) for _ in range(100)]
    rnd.shuffle(lines)
    size = np.array([len(x) for x in lines])
    own = line_dedup._digests([x.encode() for x in lines])[:, 0].copy()
    sims, keys = line_dedup.line_sketches([x.encode() for x in lines], own, True)
    members: dict[int, list[int]] = {}
    for i, k in enumerate(keys):
        for key in set(k.tolist()):
            members.setdefault(key, []).append(i)
    assert max(map(len, members.values())) > 4 * line_dedup.PAIRED
    bits, forest = (line_dedup.WIDE, line_dedup.NARROW), Forest(len(lines))
    for i, j in {(i, j) for at in members.values() for i in at for j in at if i < j}:
        if line_dedup._near(sims[[i]], size[[i]], sims[[j]], size[[j]], bits, 0.8)[0] and line_dedup.similar(lines[i], lines[j], 0.8):
            forest.union(i, j)
    return lines, {i: int(forest.find(i) != i) for i in range(len(lines))}


def test_large_keys_are_compared_to_the_end(spark, monkeypatch):
    lines, want = crowded()
    monkeypatch.setattr(line_dedup, "TILE", 50)
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), DOCS), hamming=None).collect()}
    assert got == want
    assert 100 < sum(got.values()) < 250


def test_the_lines_stage_compares_large_keys_to_the_end(spark):
    lines, want = crowded()
    kept = corpus_pipeline.lines(spark, spark.createDataFrame(list(enumerate(lines)), DOCS), "").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == [i for i, gone in want.items() if not gone]


def test_short_texts_are_encoded_a_bounded_number_of_characters_at_once(spark, monkeypatch):
    made, plain, sizes = [], piece_codec.map_batches, []
    monkeypatch.setattr(piece_codec, "map_batches", lambda df, make, schema: made.append((make, schema)) or plain(df, make, schema))
    piece_codec.encode_docs(spark.createDataFrame([(1, "a")], DOCS), queries.tokenizer_path("piece_bpe_32k.model"))
    many = piece_codec.PieceCodec.encode_many
    monkeypatch.setattr(piece_codec.PieceCodec, "encode_many", lambda self, texts: sizes.append(sum(map(len, texts))) or many(self, texts))
    work = next(make for make, schema in reversed(made) if "round_trip" in schema)()
    texts = [None, *["some words " * 2000] * 50, ""]
    rows = pa.RecordBatch.from_pydict({"key": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    assert [k.as_py() for out in work(rows) for k in out["key"]] == list(range(len(texts)))
    assert sum(sizes) == sum(len(x or "") for x in texts) and max(sizes) <= 400_000


def test_lines_of_like_length_are_verified_together(monkeypatch):
    rnd = random.Random(3)
    lines = []
    for _ in range(20):
        line = [rnd.choice("abcdefgh ") for _ in range(rnd.randint(300, 330))]
        near = list(line)
        for at in rnd.sample(range(len(near)), int(rnd.choice((0.1, 0.19, 0.23, 0.4)) * len(near))):
            near[at : at + 1] = rnd.choice(["", "z", "zz"])
        lines += ["".join(line), "".join(near)]
    a, b = np.arange(0, 40, 2), np.arange(1, 40, 2)
    want = [(longer := max(len(lines[i]), len(lines[j]))) - distance(lines[i], lines[j]) >= 0.8 * longer for i, j in zip(a, b, strict=True)]
    monkeypatch.setattr(line_dedup, "edit_distance", None)  # none goes one by one
    assert line_dedup.similar_pairs(lines, a, b, 0.8).tolist() == want
    assert 0 < sum(want) < len(want)


def test_keys_of_buckets_that_cannot_be_held_are_compared_too(spark, monkeypatch):
    lines, want = crowded()
    monkeypatch.setattr(line_dedup, "MOST_KEYS", 20)
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), DOCS), hamming=None).collect()}
    assert got == want
