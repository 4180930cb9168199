"""Runs of words, Katz scores and collocations against brute force."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import katz, phrases, runs, tokens


def test_lyndon_lengths():
    random_ = random.Random(1)
    for _ in range(600):
        c = [random_.randrange(random_.choice([1, 2, 3, 6])) for _ in range(random_.randint(1, 30))]
        # the next smaller suffix ends the longest Lyndon word
        want = [next((j for j in range(i + 1, len(c)) if c[j:] < c[i:]), len(c)) - i for i in range(len(c))]
        assert runs.lyndon_lengths(np.array(c)).tolist() == want


def plain_runs(c, min_length=24, min_exponent=3):
    found = {}
    for q in range(1, len(c) // min_exponent + 1):
        t = 0
        while t + q < len(c):
            start = t
            while t + q < len(c) and c[t] == c[t + q]:
                t += 1
            if t - start + q >= max(min_length, min_exponent * q):
                found.setdefault((start, t - start + q), q)
            t += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def sequence(random_):
    out = []
    for _ in range(random_.randint(1, 4)):
        unit = [random_.randrange(random_.choice([1, 2, 3, 9])) for _ in range(random_.randint(1, 12))]
        out += unit * random_.choice([1, 1, 2, 3, 5, 9]) + [random_.randrange(50) for _ in range(random_.randint(0, 4))]
    return out


@pytest.mark.parametrize("limits", [(24, 3), (4, 2), (6, 2), (9, 3), (8, 4)])
def test_word_runs(limits):
    random_, found = random.Random(2), 0
    for _ in range(700):
        c = sequence(random_)
        want = plain_runs(c, *limits)
        found += len(want)
        assert runs.word_runs(np.array(c), *limits) == want
    assert found > 100


def test_runs_of_nested_periods():
    a, b = [0, 1], [0, 0, 1]
    for _ in range(12):  # Fibonacci words: very many runs
        a, b = b, b + a
    assert runs.word_runs(np.array(b), 4, 2) == plain_runs(b, 4, 2)


def words(text, lower=False):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text)


ODD = [None, "", " \t\n", "a", " é\x1cb", "the " * 30, "x y " * 40 + "z", "\r\n".join(["ab cd ef"] * 9), "A a " * 12]


def collapsed(c, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(c) if i not in gone)


def test_find_runs(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_BYTES", 64)
    random_ = random.Random(3)
    texts = ODD + [" ".join(f"w{x}" for x in sequence(random_)) for _ in range(60)] + ["the " * 30]
    rows = [(i, t, "r", "c") for i, t in enumerate(texts)] + [(None, "q " * 50, "r", "c"), (3, "q " * 50, "r", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed string").repartition(3)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.find_runs(df).collect())
    want = []
    for i, t, _, _ in rows:
        found = plain_runs(words(t))
        want.append((-1 if i is None else i, found, collapsed(words(t), found)))
    assert got == sorted(want) and sum(map(len, (r[1] for r in got))) > 10
    assert runs.find_runs(df.limit(0)).count() == 0


def test_long_texts_have_runs_quickly(spark):
    unit = " ".join(f"w{i}" for i in range(5_000))
    df = spark.createDataFrame([(1, "a " * 300_000), (2, (unit + " ") * 60)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in runs.find_runs(df).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 300_000, 1)] and got[1]["collapsed"] == "a"
    assert [tuple(r) for r in got[2]["runs"]] == [(0, 300_000, 5_000)] and got[2]["collapsed"] == unit


def line(counts):
    counts = sorted((r, n) for r, n in Counter(counts).items() if r <= katz.FITTED)
    if len(counts) < 2:
        return katz.SLOPE
    r, n = [c[0] for c in counts], [c[1] for c in counts]
    z = [2 * n[i] / ((r[i + 1] if i + 1 < len(r) else 2 * r[-1] - r[-2]) - (r[i - 1] if i else 0)) for i in range(len(r))]
    x, y = [math.log(v) for v in r], [math.log(v) for v in z]
    mx, my = sum(x) / len(x), sum(y) / len(y)
    return min(katz.MAX_SLOPE, sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x))


class PlainKatz:
    def __init__(self, texts):
        runs_ = [[*words(t, True), ""] for t in texts]
        self.c = Counter(w for t in runs_ for w in t)
        self.c2 = Counter(p for t in runs_ for p in zip(["", *t[:-1]], t))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.b, self.b2 = line(self.c.values()), line(self.c2.values())
        self.after = {}
        for (v, w), c in self.c2.items():
            self.after.setdefault(v, {})[w] = c

    def single(self, w):
        star = lambda c: c * (1 + 1 / c) ** (self.b + 1)
        if w in self.c:
            return star(self.c[w]) / self.n
        return sum(c - star(c) for c in self.c.values()) / self.n if self.n else 1.0

    def p(self, v, w):
        seen = self.after.get(v)
        if not seen:
            return self.single(w)
        star = lambda c: c * (1 + 1 / c) ** (self.b2 + 1)
        total = sum(seen.values())
        if w in seen:
            return star(seen[w]) / total
        left = 1 - sum(map(star, seen.values())) / total
        return left / (1 - sum(self.single(x) for x in seen)) * self.single(w)

    def scores(self, text):
        t = [*words(text, True), ""]
        return (len(t), sum(w in self.c for w in t), sum(math.log10((self.c[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in t),
                sum(math.log10(self.p(v, w)) for v, w in zip(["", *t[:-1]], t)))


def corpus(seed):
    random_ = random.Random(seed)
    texts = [" ".join(f"{random_.choice('Wwx')}{int(random_.paretovariate(0.7)) % 60}" for _ in range(random_.randrange(40))) for _ in range(80)]
    return [(i, t, i % 4 != 0, "s") for i, t in enumerate(ODD + texts + texts[:20])]


def compare(spark, rows, parts=1):
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean, score string").repartition(parts)
    got, model = katz.score_corpus(df, F.col("learn"))
    plain = PlainKatz([t for _, t, learn, _ in rows if learn])
    key = lambda i, learn, s: (-1 if i is None else i, not learn, s[0], s[1], plain.n, round(s[2], 6), round(s[3], 6))
    want = sorted(key(i, learn, plain.scores(t)) for i, t, learn, _ in rows)
    rows_ = [tuple(r) for r in got.collect()]
    found = sorted((-1 if r[0] is None else r[0], *r[1:5], round(r[5], 6), round(r[6], 6)) for r in rows_)
    for a, b in zip(found, want):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 2e-6 and abs(a[6] - b[6]) < 2e-6
    assert len(found) == len(want)
    return model, plain


@pytest.mark.parametrize("pairs", [50, 10**6])
def test_katz_scores(spark, monkeypatch, pairs):
    monkeypatch.setattr(katz, "PART_PAIRS", pairs)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 256)
    rows = corpus(5)
    # repeated rows, a repeated id with another text, rows without id, and a null choice
    rows += [rows[30], rows[30], (30, "other words", True, "s"), (None, "w1 w2", True, "s"), (None, "w1 w2", True, "s")]
    model, plain = compare(spark, rows, 3)
    known = sorted(plain.c) + ["never seen"]
    for v in [*plain.after, "never seen"]:
        assert abs(sum(plain.p(v, w) for w in known) - 1) < 1e-9
    weights = {r["history"]: (r["total"], r["weight"]) for r in model.histories.collect()}
    assert set(weights) == set(plain.after)
    for v, (total, weight) in weights.items():
        assert total == sum(plain.after[v].values())
        assert abs(weight * plain.single("never seen") - plain.p(v, "never seen")) < 1e-12
    grams = Counter()
    for r in model.grams.collect():
        assert r["count"] == plain.c[r["word"]]
        grams.update({(h, r["word"]): c for h, c in zip(r["histories"], r["counts"])})
    assert grams == plain.c2


def test_katz_without_training_or_rows(spark):
    compare(spark, [(1, "a b", False, "s"), (2, None, False, "s")])
    compare(spark, [(1, "a a a", True, "s"), (2, "a b", False, "s")])
    df = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, learn boolean")
    assert katz.score_corpus(df, F.col("learn"))[0].select("held_out", "n_known").collect() == [(True, 0)]
    assert katz.score_corpus(df.limit(0), F.col("learn"))[0].count() == 0


def test_katz_slices_and_parts_in_small_pieces(spark, monkeypatch):
    for name, value in {"SLICE_SHARE": 2**15, "PART_PAIRS": 50, "PASS_PAIRS": 7, "BATCH_ROWS": 3}.items():
        monkeypatch.setattr(katz, name, value)
    model, _ = compare(spark, corpus(6), 2)
    # a folder for each kind of row would be written sorted by kind
    assert not any("kind=" in f for f in model.grams.inputFiles())


def test_katz_memory_of_a_slice(spark):
    random_ = np.random.default_rng(3)
    texts = [" ".join(f"word{k}" for k in random_.integers(0, 50_000, 500)) for _ in range(1_600)]
    size = sum(map(len, texts))
    assert 0.9 * tokens.SLICE_BYTES < size < tokens.SLICE_BYTES
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    blocks = [pa.scalar(r["block"], pa.binary()) for r in katz.sliced(df, F.lit(True)).collect()]
    found, most = 0, 0
    for block in blocks:
        tracemalloc.start()
        own = katz.Slice(block, 7)
        own.pair_up()
        most = max(most, tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        found += len(own.codes)
    assert found == 1_600 * 501
    # five bytes for each byte of text that the other operators take at a time
    assert most < 5 * tokens.SLICE_BYTES


def test_katz_part_goes_out_in_batches(monkeypatch):
    monkeypatch.setattr(katz, "BATCH_ROWS", 10)
    monkeypatch.setattr(katz, "PASS_PAIRS", 90)
    words = [f"é{i}" for i in range(100)]
    block = katz.squeeze(*katz.spelt(pa.array(words, pa.large_string())), np.full(100, 2), *katz.spelt(pa.array(["", "b"], pa.large_string())),
                         np.tile([0, 1], 100), np.tile([0, 300], 100))
    group = pa.table({"part": pa.array([0], pa.int32()), "slice": pa.array([5], pa.int64()), "block": pa.array([block], pa.binary())})
    out = katz._part(group, {"é3": 999})
    assert max(b.num_rows for b in out.to_batches()) <= 10
    grams = {r["word"]: (r["count"], r["histories"], r["counts"]) for r in out.to_pylist() if r["kind"] == "gram"}
    assert grams == {w: (999 if w == "é3" else 300, ["b"], [300]) for w in words}
    answer = [r for r in out.to_pylist() if r["kind"] == "answer"]
    assert [(r["part"], r["slice"]) for r in answer] == [(0, 5)]
    counts, pairs = katz.unsqueeze(pa.py_buffer(answer[0]["block"]))
    assert counts.tolist() == [999 if w == "é3" else 300 for w in words] and pairs.tolist() == [0, 300] * 100


def test_squeeze():
    columns = [[], [0], [255], [256, 0, 3], [2**16, 1], [2**40, 2**32, 7], list(range(300))]
    assert [c.tolist() for c in katz.unsqueeze(pa.py_buffer(katz.squeeze(*(np.array(c, np.int64) for c in columns))))] == columns
    for words_ in (["", "a", "é\x1c", "x" * 300], [""]):
        array = pa.array(["cut", *words_], pa.large_string()).slice(1)
        assert katz.strings(*katz.unsqueeze(pa.py_buffer(katz.squeeze(*katz.spelt(array))))).to_pylist() == words_


def plain_phrases(rows, least, top, most=5):
    out = []
    langs = {}
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        langs.setdefault(lang or "und", []).extend(re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text))
    for lang, pieces in langs.items():
        f = Counter(tuple(p[i:i + k]) for p in pieces for k in range(1, most + 1) for i in range(len(p) - k + 1))
        n = sum(len(p) for p in pieces)
        candidates = [g for g, a in f.items() if len(g) > 1 and a >= least]
        longer = Counter()
        for g in candidates:
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    longer[g[i:i + k]] = max(longer[g[i:i + k]], f[g])
        rows_ = []
        for g in candidates:
            if longer[g] >= f[g]:
                continue
            score, k = min((1000 * f[g] * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            rows_.append((-score, -f[g], " ".join(g).encode(), f[g[:k]], f[g[k:]], n, score))
        for rank, r in enumerate(sorted(rows_)[:top]):
            out.append((lang, rank + 1, r[2].decode(), -r[1], *r[3:]))
    return sorted(out)


@pytest.mark.parametrize("least,top,most,chunk", [(2, 2000, 5, 3), (3, 7, 5, 32), (2, 2000, 3, 1), (1, 2000, 4, 5), (10**6, 5, 5, 8)])
def test_collocations(spark, monkeypatch, least, top, most, chunk):
    monkeypatch.setattr(tokens, "SLICE_BYTES", 512)
    random_ = random.Random(7)
    passage = "the Quick brown fox, jumps over: the lazy\tdog again and again"
    rows = [(None, None, "p"), ("en", "", "p"), ("en", " ., \n", "p"), ("é", "é x é x\x1cy", "p"), (None, "a b a b a b a b", "p")]
    for i in range(120):
        text = " ".join(f"{'wW'[i % 2]}{int(random_.paretovariate(0.9)) % 12}" + random_.choice(["", "", "", "", ",", ".\n", " ;"]) for _ in range(random_.randrange(50)))
        rows.append((["en", "de", None][i % 3], text + passage * (i % 2), "p"))
    df = spark.createDataFrame(rows, "lang string, text string, phrase string").repartition(3)
    got = phrases.collocations(df, least=least, top=top, max_words=most, chunk_words=chunk)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_phrases([r[:2] for r in rows], least, top, most)


def test_every_word_of_the_parse_counts_once(spark):
    text = " ".join(f"w{i % 7}" for i in range(5_000))
    df = spark.createDataFrame([("en", text), ("en", text)], "lang string, text string")
    chunks = phrases.parse(df, 8)
    assert chunks.agg(F.max("freq")).first()[0] >= 2
    assert {r["phrase"]: r["f"] for r in phrases.count_phrases(phrases.numbered(chunks), 1, None).collect()}[""] == 10_000
    assert phrases.collocations(df.limit(0)).count() == 0
