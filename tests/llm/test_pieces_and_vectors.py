"""SentencePiece, whitening and hard negatives against the library, numpy and plain Python."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from foliant.llm import negatives, pieces, queries, whitening
from foliant.llm.vectors import integer_vectors
from foliant.session import read_table
from tests.llm.helpers import EDGES, frame

MODEL = public_tokenizers.path(queries.PIECES)
VECTORS = "vec_id long, embedding array<float>, label int, x string, row string, n string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    return pieces.codec_of(pieces.read_model(MODEL))[0]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(library, doc_id, text):
    ids = library.encode(text or "", add_eos=True)
    return doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), True


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_pieces_of_edge_texts(spark, library):
    got = pieces.encode_pieces(frame(spark), MODEL)
    assert by_id(map(tuple, got.collect())) == by_id(expected(library, r[0], r[1]) for r in EDGES)
    assert pieces.encode_pieces(frame(spark, []), MODEL).collect() == []


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_pieces_query(spark, library, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    got = queries.QUERIES["op11_pieces"](spark, sf_dir).collect()
    assert by_id(map(tuple, got)) == by_id(expected(library, r[0], r[1]) for r in docs)


def test_pieces_round_trip(spark, library):
    encoded = pieces.encode_pieces(frame(spark), MODEL, keep_ids=True)
    got = by_id(map(tuple, pieces.decode_pieces(encoded, MODEL).collect()))
    assert got == by_id((r[0], (r[1] or "").replace("▁", " ")) for r in EDGES)
    lone = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert by_id(map(tuple, pieces.decode_pieces(lone, MODEL).collect())) == [(1, None), (2, "")]


def test_strange_texts_as_the_library(codec, library):
    rnd = random.Random(5)
    parts = [*" \t\n\r\x00\x0b▁aAbé汉字😀", "<s>", "</s>", "<unk>", "<0x0A>", "  ", "    ", "the ", " the", "⁇", "�", "​", " ", "$$$"]
    for _ in range(3000):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 40)))
        ids = codec.encode(text)
        assert ids == library.encode(text, add_eos=True), text
        assert codec.decode(ids) == library.decode(ids), text


def test_any_ids_decode_as_the_library(codec, library):
    rnd = random.Random(6)
    pool = [0, 1, 2, *range(3, 300), *[codec.ids["▁"]] * 20, *range(300, 32000, 97)]
    for _ in range(5000):
        ids = rnd.choices(pool, k=rnd.randint(0, 9))
        assert codec.decode(ids) == library.decode(ids), ids


def test_a_word_without_end_and_ties_of_scores(codec, library):
    for text in ("ab" * 20_000, " " * 4_001, "a" + " " * 33 + "b", "x" * 10_000):
        assert codec.encode(text) == library.encode(text, add_eos=True)


def test_what_the_library_says_otherwise_shows(codec, library):
    right = {s: codec.merge(s) for s in ("▁the", "▁", "the", "\n\n", "▁▁a")}
    assert pieces.unlike(library, right) == set()
    assert pieces.unlike(library, right | {"▁the": (5,), "the": (6,)}) == {"▁the", "the"}


def numbered(vectors, labels=None):
    return [(i, v, labels[i] if labels else i % 3, "clash", "clash", "clash") for i, v in enumerate(vectors)]


ODD = [(900, None, 1, "", "", ""), (901, [1.0, None, 0.0], 1, "", "", ""), (902, [float("nan")] * 3, 1, "", "", ""), (903, [1.0, float("inf"), 0.0], 1, "", "", "")]


def whitened(spark, rows):
    return whitening.whiten_embeddings(spark.createDataFrame(rows, VECTORS)).collect()


def check_whitening(rows, x, components):
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    v = np.cov(fit.T, bias=True)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    want = (x - total / n) @ vectors / np.sqrt(values)
    assert len(rows) == len(x) * components
    for c in range(components):
        mine = sorted((r for r in rows if r["component"] == c + 1), key=lambda r: r["vec_id"])
        assert {r["n"] for r in mine} == {n} and max(r["identity_error"] for r in mine) < 1e-9
        got = np.array([r["whitened"] for r in mine])
        assert min(np.abs(got - want[:, c]).max(), np.abs(got + want[:, c]).max()) < 1e-8
        assert np.allclose([r["explained"] for r in mine], values[c] / np.trace(v), rtol=1e-10)
        assert [r["deviation"] for r in mine] == [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total)) for row in x]


def test_whitening_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    table = read_table(spark, sf_dir, "embeddings").toPandas().sort_values("vec_id")
    x = np.floor(np.array(table["embedding"].tolist(), dtype=float) * 256).astype(int)
    check_whitening(queries.QUERIES["op12_whitening"](spark, sf_dir).collect(), x, 4)


def test_whitening_of_copies_and_odd_rows(spark):
    rnd = np.random.default_rng(3)
    vectors = rnd.normal(size=(40, 6)) * [5, 4, 3, 2, 1, 0.5] + 1000
    vectors = np.float32(np.vstack([vectors, vectors[:10]]))
    x = np.floor(vectors.astype(float) * 256).astype(int)
    check_whitening(whitened(spark, numbered(vectors.tolist()) + ODD), x, 4)


def test_whitening_of_low_ranks(spark):
    line = [[float(i), 2.0 * i, 0.0] for i in range(5)]
    rows = whitened(spark, numbered(line) + ODD)
    assert {r["component"] for r in rows} == {1} and len(rows) == 5 and all(abs(r["explained"] - 1) < 1e-12 for r in rows)
    assert whitened(spark, numbered([[1.0, 2.0]] * 4)) == []
    assert whitened(spark, ODD) == [] and whitened(spark, []) == [] and whitened(spark, numbered([[], []])) == []
    short = whitened(spark, numbered([[1.0], [0.0, 1.0], [0.0]]))
    assert {r["n"] for r in short} == {3} and {r["component"] for r in short} == {1, 2}


def test_jacobi_keeps_small_eigenvalues():
    rnd = np.random.default_rng(4)
    turn, _ = np.linalg.qr(rnd.normal(size=(7, 7)))
    values = np.array([1e6, 1e6, 3e3, 5.0, 1e-2, 1e-4, 1e-5])
    order, t = whitening.pivoted_cholesky(turn @ np.diag(values) @ turn.T)
    found, components = whitening.one_sided_jacobi(t)
    assert np.allclose(t, np.tril(t)) and np.allclose(found, values, rtol=1e-3) and np.allclose(components.T @ components, np.eye(7), atol=1e-12)
    pairs = [p for a, b in whitening.rounds(7) for p in zip(a.tolist(), b.tolist())]
    assert len(pairs) == 21 == len({frozenset(p) for p in pairs})


def test_entries_too_large_are_an_error(spark):
    with pytest.raises(ValueError):
        integer_vectors(spark.createDataFrame(numbered([[1e30]]), VECTORS), "embedding")


def mined(rows, anchors=lambda i: i is not None and i % 100 == 0, k=5):
    """(anchor, positive, rank, negative, scores) by plain sorting of all rows."""
    rows = [(i, [math.floor(float(np.float32(c)) * 256) for c in v], label) for i, v, label in rows]
    score = lambda a, b: sum(p * q for p, q in zip(a, b))
    found = []
    for at, (i, v, label) in enumerate(rows):
        if anchors(i):
            others = sorted(((-score(v, w), j is None, j or 0, j, other) for k2, (j, w, other) in enumerate(rows) if k2 != at), key=lambda r: r[:3])
            for p in [r for r in others if r[4] == label][:k]:
                fit = [r for r in others if r[4] != label and 80 * -p[0] <= 100 * -r[0] <= 100 * -p[0]][:k]
                found += [(i, p[3], rank, r[3], -p[0], -r[0]) for rank, r in enumerate(fit, 1)]
    return sorted(found, key=repr)


def negatives_of(spark, rows, **options):
    table = spark.createDataFrame([(i, v, label, "a", "b", "c") for i, v, label in rows], VECTORS)
    return sorted(map(tuple, negatives.hard_negatives(table, **options).collect()), key=repr)


@pytest.mark.parametrize("shard_rows", [60, 100_000])
def test_negatives_of_clusters(spark, shard_rows):
    rnd = np.random.default_rng(9)
    centres = rnd.normal(size=(6, 8))
    vectors = np.vstack([c + 0.15 * rnd.normal(size=(70, 8)) for c in centres] + [rnd.normal(size=(80, 8)) * 3]).astype(np.float32)
    rows = [(10 * i, v, int(rnd.integers(0, 4))) for i, v in enumerate(vectors.tolist())]
    assert negatives_of(spark, rows, shard_rows=shard_rows) == mined(rows)


def test_negatives_of_copies_ties_and_odd_rows(spark):
    rnd = np.random.default_rng(10)
    base = rnd.integers(-2, 3, size=(12, 3)).astype(float).tolist()
    rows = [(i % 130, base[i % 12] if i % 3 else base[0], i % 2) for i in range(260)]
    rows += [(200, [0.0, 0.0, 0.0], 0), (300, [1.0], 1), (None, base[1], 0), (None, base[2], 1), (100, base[1], 0), (100, base[1], 0)]
    odd = [(i, v, 1) for i, v, *_ in ODD] + [(400, base[0], None)]
    assert negatives_of(spark, rows + odd, shard_rows=50) == mined(rows)
    assert negatives_of(spark, []) == [] and negatives_of(spark, odd) == [] and negatives_of(spark, [(1, [1.0], 1)]) == []


def test_negatives_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    table = read_table(spark, sf_dir, "embeddings").toPandas()
    rows = [(int(i), v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in zip(table["vec_id"], table["embedding"], table["label"])]
    got = sorted(map(tuple, queries.QUERIES["op13_negatives"](spark, sf_dir).collect()), key=repr)
    assert got == mined(rows) and len(got) > 50


def test_cover_tree_nets_and_bounds():
    rnd = np.random.default_rng(11)
    x = np.unique(np.vstack([rnd.integers(-900, 900, size=(150, 5)), rnd.integers(-20, 20, size=(150, 5)), np.full((1, 5), 3)]), axis=0)
    tree = negatives.CoverTree(x)
    norms = (x.astype(float) ** 2).sum(axis=1)
    y = np.column_stack([x, np.sqrt(norms.max() - norms)])
    apart = np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2))
    seen = {0: np.array([tree.root])}
    for level in range(len(tree.children) - 1):
        by_owner, starts = tree.children[level]
        for node in seen[level]:
            children = by_owner[starts[node] : starts[node + 1]]
            assert node in children  # nesting
            assert set(tree.below(level, np.array([node]))) == set(tree.below(level + 1, children))
            below = tree.below(level, np.array([node]))
            assert 2 * np.arcsin(np.minimum(1, apart[node, below] / (2 * tree.radius))).max() <= tree.angle[level][node] + 1e-9
        seen[level + 1] = np.unique(by_owner)
        members = seen[level + 1]
        gaps = apart[np.ix_(members, members)] + np.eye(len(members)) * 1e9
        scale = 2.0 ** math.floor(math.log2(gaps.min()))
        assert apart[members].min(axis=0).max() <= 2 * scale + 1e-6 or len(members) == len(x)  # covering against separation
    assert len(seen[len(tree.children) - 1]) == len(x) and tree.size[0][tree.root] == len(x)
