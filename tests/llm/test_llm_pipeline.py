"""The stages of the corpus pipeline on one small table, each against what it was given."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from ledgerlens.llm import packing

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = spark.createDataFrame([
        (10**6, None, None, None, None), (10**6 + 1, "", "en", "src1", 0), (10**6 + 2, "?? 12 ##", "en", None, 8),
        (10**6 + 3, docs.where("doc_id = 1").first()["text"], None, "src9", 3),
    ], docs.schema)
    out = [docs.union(extra).select(*COLUMNS)]
    for name, stage in corpus_pipeline.STAGES:
        done = corpus_pipeline.save(stage(spark, out[-1], SF_DIR), name)
        out.append(done)
    return [d.collect() for d in out]


def test_rejected_documents_go_and_others_stay(steps):
    before, language, good, distinct, mixed, _ = steps
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in language} == {10**6, 10**6 + 1, 10**6 + 2}
    for earlier, later in ((before, language), (language, good), (good, distinct)):
        rows = {tuple(r) for r in earlier}
        assert later and all(tuple(r) in rows for r in later) and later[0].__fields__ == COLUMNS
    assert 10**6 + 3 not in {r["doc_id"] for r in distinct}
    assert {tuple(r)[:-1] for r in mixed} <= {tuple(r) for r in distinct} and mixed[0].__fields__ == [*COLUMNS, "position"]


def test_sequences_keep_the_training_order(steps):
    """Every piece has the position of its document, copies their own."""
    want, got = {}, {}
    for r in steps[4]:
        want.setdefault(r["doc_id"], []).append(r["position"])
    for r in steps[5]:
        if r["piece"] == 0:
            got.setdefault(r["doc_id"], []).append(r["position"])
    assert {d: sorted(p) for d, p in got.items()} == {d: sorted(p) for d, p in want.items()} and all(0 <= p <= 1 for ps in got.values() for p in ps)


def test_sequences_hold_the_mixed_documents(steps):
    bpe = packing.encoding(packing.default_vocabulary())
    want = sorted(
        zlib.crc32(ids[s:s + n].tobytes())
        for r in steps[4] for ids in [np.array([*bpe.encode_ordinary(r["text"]), 0], "<u4")] for s, n in packing.cut(len(ids), 2048))
    assert sorted(r["ids_crc32"] for r in steps[5]) == want


def test_unlearned_languages_and_random_letters_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*COLUMNS)
    draw = np.random.default_rng(4)
    words = ["".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), draw.integers(3, 9))) for _ in range(100)]
    odd = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью.",
        "人人生而自由在尊严和权利上一律平等他们赋有理性和良心", "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق", " ".join(words),
    ]
    extra = spark.createDataFrame([(10**7 + i, t, None, "odd", len(t)) for i, t in enumerate(odd)], docs.schema)
    left = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.union(extra), "").select("doc_id").collect()}
    assert left == {r["doc_id"] for r in docs.where("lang IS NOT NULL").select("doc_id").collect()}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SF_DIR)
        assert done.count() == 0
        docs = docs if name == "best_fit_packing" else corpus_pipeline.save(done, name)
