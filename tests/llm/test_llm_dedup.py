"""Near duplicates of vectors and documents against brute force."""

import random
import re

import numpy as np
import pytest

from ledgerlens.llm import minhash, vectors
from ledgerlens.llm.components import components


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_chain_star_and_noise(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(8, 60)]
    edges = chain + star + [(5, 5), (None, 3), (3, None), (160, 100), (101, 100)]
    got = {r["node"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 60)}}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def expected_documents(rows, width):
    sets = {i: shingles(t, width) for i, t in rows}
    ids = sorted(sets)
    pairs = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
        if (n := len(sets[a] & sets[b])) and 100 * n >= 80 * len(sets[a] | sets[b])
    ]
    label = roots(ids, pairs)
    return {(i, len(sets[i]), label[i], i == label[i]) for i in ids}


def family(random_, words, size, edits):
    """Copies of one text with a few words replaced: similarities on both sides of the limit."""
    base = [f"w{random_.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(size):
        copy = list(base)
        for at in random_.sample(range(words), random_.randrange(edits)):
            copy[at] = f"x{random_.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("width", [4, 5])
def test_documents_against_all_pairs(spark, width, monkeypatch):
    monkeypatch.setattr(minhash, "_CHUNK_DOCS", 16)
    random_ = random.Random(3)
    texts = [t for size, words in ((90, 120), (40, 60), (25, 400), (30, 12)) for t in family(random_, words, size, max(2, words // 12))]
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [f"{passage} " + " ".join(f"u{random_.randrange(10**6)}" for _ in range(random_.randrange(5, 200))) for _ in range(60)]
    texts += ["Same  text\there"] * 7 + ["same text here", "SAME text\nhere", "", "", None, " \n\t ", "one", "ONE", "two words", "É é", "é é"]
    texts += ["word " * 30_000, "word " * 29_000 + "end", "long " + " ".join(map(str, range(50_000)))]
    rows = list(enumerate(texts))
    random_.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, kept int")
    got = minhash.near_duplicates(docs.repartition(8), width).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == expected_documents(rows, width)


def test_documents_without_ids_and_repeated_ids(spark):
    docs = spark.createDataFrame([
        (None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "k l m n o p"), (9, "k l m n o p"), (1, None),
    ], "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(docs, 4).collect()), key=str)
    assert got == sorted([
        (None, 3, None, True), (None, 3, None, True), (3, 3, 3, True), (3, 3, 3, True), (9, 3, 3, False), (1, 0, 1, True)], key=str)


def test_every_text_of_a_repeated_id_counts(spark):
    one, other, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    docs = spark.createDataFrame([
        (3, one, "x"), (3, other, "x"), (5, one + " more", "x"), (9, other + " more", "x"), (3, third, "x"), (3, third, "y"),
        (4, None, "x"), (4, "", "x"), (4, "lone words", "x"), (None, one, "x"),
    ], "doc_id long, text string, source string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(3, 3, True), (5, 3, False), (9, 3, False), (4, 4, True), (None, None, True)}
    left = [tuple(r)[:2] for r in minhash.without_near_duplicates(docs).collect()]
    assert len(left) == 6 and {r for r in left if r[1]} == {(3, one), (3, other), (3, third), (4, "lone words"), (None, one)}


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert minhash.near_duplicates(docs).count() == 0
    assert minhash.without_near_duplicates(docs).columns == ["doc_id", "text", "lang"]


def test_stage_keeps_one_of_a_group(spark):
    text = " ".join(map(str, range(60)))
    docs = spark.createDataFrame([
        (5, text, "a"), (2, text + " more", "b"), (8, text, None), (4, "something else", "c"), (4, "something else", "c"), (None, text, "d"),
    ], "doc_id long, text string, source string")
    got = sorted(map(tuple, minhash.without_near_duplicates(docs).collect()), key=str)
    assert got == sorted([(2, text + " more", "b"), (4, "something else", "c"), (None, text, "d")], key=str)


def expected_vectors(rows):
    usable = {
        i: (l, np.array(v, float) / max(map(abs, v))) for i, v, l in rows
        if l is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)
    }
    pairs = []
    for a in usable:
        for b in usable:
            (la, x), (lb, y) = usable[a], usable[b]
            if a < b and la == lb and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                pairs.append((a, b))
    label = roots([r[0] for r in rows], pairs)
    degree = {r[0]: 0 for r in rows}
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    return {(i, degree[i], label[i], i == label[i]) for i in degree}


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK_VECTORS", 16)
    random_ = np.random.default_rng(2)
    base = random_.standard_normal((12, 24))
    rows, i = [], 0
    for k, n in enumerate((120, 30, 20, 10, 5, 3, 2, 1, 1, 1, 1, 1)):
        for _ in range(n):
            rows.append((i, (base[k] + 0.13 * random_.standard_normal(24)).tolist(), int(k % 3)))
            i += 1
    rows += [(i + j, base[0].tolist(), 1) for j in range(9)] + [(i + 9 + j, (base[0] * 10**j).tolist(), 1) for j in range(1, 4)]
    i += 20
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0], [1.0, 2.0], [1e300, 1e300], [1e-300, 1e-300]]
    rows += [(i + j, v, 1) for j, v in enumerate(odd)] + [(i + 20 + j, base[0].tolist(), None) for j in range(3)]
    df = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "vec_id long, embedding array<double>, label int, kept string")
    got = vectors.near_vectors(df.repartition(5)).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == expected_vectors(rows)


def test_vectors_without_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, vectors.near_vectors(df).collect()), key=str) == sorted([(None, 0, None, True), (4, 0, 4, True), (4, 0, 4, True)], key=str)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_repeated_ids(spark, monkeypatch):
    """Each different vector counts by itself; the rows of an id are one node."""
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, [0.0, 1.0], 1)]
    kind = "vec_id long, embedding array<double>, label int"
    assert {tuple(r) for r in vectors.near_vectors(spark.createDataFrame(rows, kind)).collect()} == {(1, 2, 1, True), (2, 0, 2, True)}
    monkeypatch.setattr(vectors, "CHUNK_VECTORS", 4)
    random_ = np.random.default_rng(4)
    base = random_.standard_normal((6, 8))
    rows = [(int(random_.integers(40)), (base[k % 6] + 0.1 * random_.standard_normal(8)).tolist(), int(k % 2)) for k in range(90)]
    rows += [(5, base[0].tolist(), 0)] * 9 + [(6, base[0].tolist(), 0), (6, base[0].tolist(), 1)]
    distinct = sorted({(i, tuple(v), l) for i, v, l in rows})
    pairs = []
    for a, (i, v, l) in enumerate(distinct):
        for j, w, m in distinct[a + 1:]:
            if l == m and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                pairs.append((i, j))
    label = roots({i for i, _, _ in rows}, [p for p in pairs if p[0] != p[1]])
    got = {tuple(r) for r in vectors.near_vectors(spark.createDataFrame(rows, kind)).collect()}
    assert got == {(i, sum((a == i) + (b == i) for a, b in pairs), label[i], i == label[i]) for i in label}


def test_table_plan_keeps_the_miss_bound():
    for rows in (0, 1, 10, 10**4, 10**7, 10**10):
        bits, tables = vectors.table_plan(rows, 0.98, 1e-6)
        assert (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** tables <= 1e-6
