"""Language, quality and packing: held-out accuracy, invariants and exact round trips."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import language_id, packing, quality, queries

SF_DIR = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@needs_tables
def test_language_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.QUERIES["op3_language_id"](spark, SF_DIR).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and 0.15 < len(held) / len(got) < 0.35
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


def test_language_edge_cases(spark):
    rows = [(i, "der die und das nicht " * 5, "de", "x") for i in range(20)] + [(i + 20, "the of and that with " * 5, "en", "x") for i in range(20)]
    docs = spark.createDataFrame(rows + [(90, "no label", None, "x"), (None, "und der die", "de", "x")], "doc_id long, text string, lang string, score string")
    model = language_id.fit(docs)
    assert sorted(set(model[1])) == ["de", "en"]
    odd = [None, "", " \n", "123 $%", "漢字かな交じり文", "THE AND OF THAT", "und nicht", "the of " * 200_000, "𝒜𝒷"]
    asked = spark.createDataFrame([(i, t, "own") for i, t in enumerate(odd * 2)], "doc_id long, text string, score string")
    got = [r["lang_pred"] for r in language_id.predict(asked, model).orderBy("doc_id").collect()]
    assert got == ["und", "und", "und", "und", "und", "en", "de", "en", "und"] * 2
    assert language_id.predict(asked, model).columns == ["doc_id", "lang_pred", "score"]
    assert language_id.predict(asked, model, keep_text=True).where("text = 'und nicht'").count() == 2
    nothing = language_id.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(asked, nothing).collect()} == {"und"}
    assert language_id.predict(asked.limit(0), model).count() == 0


def test_every_ngram_counts():
    letters = language_id._letters()
    assert language_id.ngram_counts("abc", letters).sum() == 3 + 2 + 1
    assert (language_id.ngram_counts("A--B", letters) == language_id.ngram_counts("a b", letters)).all()
    assert language_id.ngram_counts("x" * 10**6, letters).sum() == 3 * 10**6 - 3


@needs_tables
def test_quality_held_out_ranking(spark):
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    got = queries.QUERIES["op6_quality_classifier"](spark, SF_DIR).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    good = [r["score"] for r in got if r["held_out"] and marks.get(r["doc_id"]) == 1]
    bad = [r["score"] for r in got if r["held_out"] and marks.get(r["doc_id"]) == 0]
    assert np.mean([[(g > b) + (g == b) / 2 for g in good] for b in bad]) > 0.95


def test_quality_edge_cases(spark):
    rows = [(i, f"plain words number {i} stand here.", "x") for i in range(40)] + [(i + 40, f"AA## BB%% {i} $$$ ||", "x") for i in range(40)]
    rows += [(90, None, "x"), (91, "", "x"), (92, "long " * 100_000, "x"), (None, "plain words", "x"), (0, rows[0][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)] + [(1, 1), (2, None), (None, 1), (3, 7)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels, F.lit(True)).collect()}
    assert len(got) == 84 and got[90]["score"] == got[91]["score"]
    assert np.mean([got[i]["predicted"] == int(i < 40) for i in range(80)]) > 0.95
    assert {r["score"] for r in quality.classify(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels, F.lit(True)).count() == 0
    assert quality.filter_texts(docs, None).count() == len(rows)
    # one class only
    assert quality.classify(docs, labels.where("quality = 1"), F.lit(True)).count() == len(rows)


def test_isotonic_against_minimax():
    random = np.random.default_rng(4)
    for _ in range(20):
        n = random.integers(1, 12)
        y, w = random.random(n), random.integers(1, 5, n).astype(float)
        x, v = quality.isotonic(np.arange(n, dtype=float), y, w)
        fit = [
            max(min(np.average(y[i:j + 1], weights=w[i:j + 1]) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        assert np.all(np.diff(v) >= 0) and np.isclose(sorted(set(np.round(fit, 9))), sorted(set(np.round(v, 9)))).all()


def test_partitions_sum_to_the_same_model(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 7 + 1)) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    rows = quality.labelled(quality.statistics_of(docs), labels)
    one, many = quality.fit(rows.coalesce(1)), quality.fit(rows.repartition(7))
    assert np.allclose(one.weights, many.weights, atol=1e-6)


def test_ids_equal_the_tokenizers_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    texts = ["", "Hello  world\n\n it's 12345 naïve — 漢字 😀", " lead", "tail ", "\t\r\n  x", "<|endoftext|>", "a" * 30_000, "don't won't I'LL", "x\x00y"]
    if os.path.isdir(SF_DIR):
        texts += [r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").limit(150).collect()]
    bpe = packing.encoding(packing.default_vocabulary())
    assert [list(bpe.encode_to_numpy(t, disallowed_special=())) for t in texts] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_packing_round_trip(spark, monkeypatch, score):
    monkeypatch.setattr(packing, "GROUP_PIECES", 40)
    texts = [None, "", "one", "word " * 500, "many different words " * 90] + [f"text {i} " * (i % 23) for i in range(90)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "lost", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    got = packing.pack(docs, max_tokens=64, max_documents=5, with_ids=True, score=score).collect()
    bpe = packing.encoding(packing.default_vocabulary())
    whole = {}
    for r in got:
        assert r["length"] == len(r["ids"]) <= 64 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        whole.setdefault(r["doc_id"], {}).setdefault(r["start"], []).append(r)
    for i, t, _ in rows:
        pieces = sorted(whole[i].items())
        ids = [x for _, same in pieces for x in same[0]["ids"]]
        assert ids == [*bpe.encode_ordinary(t or ""), 0]
        assert [same[0]["piece"] for _, same in pieces] == list(range(len(pieces)))
        assert all(same[0]["length"] == 64 for _, same in pieces[1:])
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for members in sequences.values():
        members.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in members] == [sum(m["length"] for m in members[:i]) for i in range(len(members))]
        assert sum(r["length"] for r in members) <= 64 and len(members) <= 5 and sum(r["length"] ** 2 for r in members) <= 64 ** 2
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit", [" ", "\n", "\t", "z"])
def test_very_long_runs_of_one_character(spark, unit):
    """Texts that the quick tokeniser's regular expressions refuse get the same ids from the other one."""
    own = packing.tokenizer(packing.default_vocabulary())
    short = "x" + unit * 3_000 + "y"
    assert own.encode(short, add_special_tokens=False).ids == packing.token_ids(short, packing.default_vocabulary()).tolist()
    text = "x" + unit * 2_000_000 + "y"
    ids = np.append(own.encode(text, add_special_tokens=False).ids, 0).astype("<u4")
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = packing.pack(docs).where("doc_id = 1").orderBy("start").collect()
    assert sum(r["length"] for r in got) == len(ids)
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) for r in got)


def plain_best_fit(lengths, capacity, weights, score):
    """The definition: longest first, into the sequence with the best score among those with room, else a new one."""
    bins, places = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        want = (lengths[i], 1, lengths[i] ** 2)
        best = None
        for b, room in enumerate(bins):
            if all(r >= w for r, w in zip(room, want)):
                if score == "dot":
                    value = -sum(r / c * (w / c) * x for r, w, c, x in zip(room, want, capacity, weights))
                else:
                    value = sum(((r - w) / c) ** 2 * x for r, w, c, x in zip(room, want, capacity, weights))
                if best is None or value < best[0] - 1e-12:
                    best = (value, b)
        if best is None:
            bins.append(list(capacity))
            best = (0, len(bins) - 1)
        places[i] = (best[1], capacity[0] - bins[best[1]][0])
        bins[best[1]] = [r - w for r, w in zip(bins[best[1]], want)]
    return places


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(64, 64, 64.0**2), (64, 3, 64.0**2), (64, 5, 1.2 * 64.0**2)])
def test_best_fit_by_its_definition(score, capacity):
    lengths = np.random.default_rng(3).integers(1, 65, 300)
    sequence, offset = packing.best_fit(lengths, capacity, packing.WEIGHTS, score)
    assert {i: (s, o) for i, (s, o) in enumerate(zip(sequence, offset))} == plain_best_fit(lengths.tolist(), capacity, packing.WEIGHTS, score)


def test_packing_carries_columns(spark):
    docs = spark.createDataFrame([(1, "a b c " * 40, 0.25), (2, "d", None)], "doc_id long, text string, position double")
    got = packing.pack(docs, max_tokens=32, carry=("position",)).collect()
    assert {(r["doc_id"], r["position"]) for r in got} == {(1, 0.25), (2, None)} and len(got) > 3


def test_best_fit_is_near_the_bound():
    lengths = np.random.default_rng(1).integers(1, 2049, 5_000)
    sequence, _ = packing.best_fit(lengths, (2048, 2048, 2048.0 ** 2), packing.WEIGHTS)
    assert len(set(sequence.tolist())) <= 1.02 * np.ceil(lengths.sum() / 2048)


def test_cut():
    assert packing.cut(10, 4) == [(0, 2), (2, 4), (6, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)] and packing.cut(4, 4) == [(0, 4)]
