"""Search, mixing, chat windows and URL filters against plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import chat, knn, mixing, url_filter


def test_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 64)
    monkeypatch.setattr(knn, "GROUP_QUERIES", 8)
    random_ = np.random.default_rng(1)
    rows = [(i, random_.integers(-3, 4, 6) / 4) for i in range(400)] + [(400 + i, np.array([9.0] * 6) / 8) for i in range(50)]
    rows = [(i, v.tolist()) for i, v in rows]
    odd = [(900, None), (910, [None, 1.0]), (920, [float("nan")] * 6), (None, [1.0] * 6), (930, []), (940, [float("-inf")] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, score string")
    got = knn.nearest_by_product(df.repartition(6), 5, 256, F.col("vec_id") % 10 == 0).collect()
    q = {i: np.floor(256 * np.array(v)) for i, v in rows}
    want = set()
    for i in q:
        if i % 10 == 0:
            best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:5]
            want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_search_with_few_rows_and_two_lengths(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [1.0]), (50, [2.0]), (50, [2.0])], "vec_id long, embedding array<float>")
    got = {tuple(r) for r in knn.nearest_by_product(df, 5, 256, F.col("vec_id") % 50 == 0).collect()}
    assert got == {(0, 1, 1, 256 * 128), (50, 1, 2, 512 * 256)}
    assert knn.nearest_by_product(df.limit(0), 5, 256, F.lit(True)).count() == 0
    assert knn.nearest_by_product(df, 5, 256, F.lit(False)).count() == 0


def test_search_among_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 16)
    df = spark.createDataFrame([(50, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [-3.0, 0.0]), (2, [0.1, 0.0])], "vec_id long, embedding array<double>")
    got = {tuple(r) for r in knn.nearest_by_product(df, 5, 256, F.col("vec_id") % 50 == 0).collect()}
    assert got == {(50, 1, 1, 32768), (50, 2, 2, 6400), (50, 3, 1, -196608)}
    random_ = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(random_.integers(0, 40, 300), random_.integers(-3, 4, (300, 4)))]
    rows += [(7, [1.0, 2.0, 3.0, 3.0])] * 200
    got = sorted(tuple(r) for r in knn.nearest_by_product(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 1, F.col("vec_id") % 20 == 0).collect())
    want, distinct = [], sorted({(i, tuple(v)) for i, v in rows})
    for q in (0, 20):
        best = sorted((-int(np.dot(v, w)), j) for i, v in distinct if i == q for j, w in distinct if j != q)[:5]
        want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_search_with_large_components(spark):
    def search(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        return sorted(tuple(r) for r in knn.nearest_by_product(df, 5, 256, F.col("vec_id") == 0).collect())

    assert search([(0, [1.0, 1.0]), (1, [1e7, 0.5]), (2, [-1e7, 1e7])]) == [(0, 1, 1, 256 * (2560000000 + 128)), (0, 2, 2, 0)]
    # beyond the whole numbers of doubles: sums that doubles would round
    assert search([(0, [2.0**40, 1 / 256]), (1, [1.0, 1 / 256]), (2, [1.0, 2 / 256])]) == [(0, 1, 2, 2**56 + 2), (0, 2, 1, 2**56 + 1)]
    with pytest.raises(Exception):
        search([(0, [1e200, 0.0]), (1, [1e200, 0.0])])


def test_search_among_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(knn, "LENGTHS", 2)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 3)
    monkeypatch.setattr(knn, "GROUP_QUERIES", 2)
    random_ = np.random.default_rng(9)
    rows = [(i, random_.integers(-3, 4, 1 + i % 7).astype(float).tolist()) for i in range(150)]
    got = {tuple(r) for r in knn.nearest_by_product(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 1, F.col("vec_id") % 5 == 0).collect()}
    want = set()
    for q, v in rows[::5]:
        best = sorted((-int(np.dot(v, w)), j) for j, w in rows if j != q and len(w) == len(v))[:5]
        want |= {(q, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    assert got == want


def test_pruned_groups_leave_out_data(spark):
    """Two far clusters: the bounds keep each group's data to its own side."""
    rows = [(i, [4.0 * (1 if i % 2 else -1), (i % 7) / 100]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = knn.nearest_by_product(df, 3, 256, F.col("vec_id") % 100 == 1).collect()
    assert len(got) == 18 and all(r["vec_id"] % 2 == 1 for r in got)


def mixed(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, mix string")
    return mixing.mix(df, **options), df


def level(sizes, weights):
    """Targets by pouring the excess again until none is above three times its source."""
    target, open_, rest = {}, dict(weights), sum(sizes.values())
    while open_:
        share = rest / sum(open_.values())
        full = [s for s in open_ if share * open_[s] > 3 * sizes[s]]
        if not full:
            return target | {s: share * w for s, w in open_.items()}
        for s in full:
            target[s] = 3 * sizes[s]
            rest -= target[s]
            del open_[s]
    return target


@pytest.mark.parametrize("bucket", [3, 10_000])
def test_mix(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    rows = [(i, ["a", "b", "é", "Z", None][i % 5 if i < 50 else 0], "w " * (i % 9), "x") for i in range(200)]
    rows += [(7, "b", None, "x"), (None, "c", "one two", "x"), (None, "c", "one two", "x"), (7, "b", "again\x1cone\u00a0word", "x")]
    out, df = mixed(spark, rows)
    got = [r.asDict(True) for r in out.collect()]
    assert len(got) == len(rows) and out.columns == [*df.columns, "_mix"]
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["_mix"]["size"]
    order = sorted(s for s in sizes if s is not None) + [None]
    want = level(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    for s in order:
        own = [r["_mix"] for r in got if r["source"] == s]
        taken = sum(m["taken"] for m in own)
        assert all(m["source_size"] == sizes[s] and abs(m["target"] - want[s]) < 1e-9 * max(1, want[s]) for m in own)
        assert abs(taken - want[s]) <= max(m["size"] for m in own) / 2 + 1e-9
        assert all(m["taken"] <= 3 * m["size"] and len(m["positions"]) == m["copies"] and m["positions"] == sorted(m["positions"]) for m in own)
        assert all(0 <= p <= 1 for m in own for p in m["positions"])
    again = [r.asDict(True) for r in mixed(spark, rows[::-1])[0].collect()]
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_curriculum_follows_the_schedules(spark):
    rows = [(i, "ab"[i % 2], "w w w w", "x") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, position string")
    options = {"weights": (1, 1), "schedules": ((1.8, 0.2), (0.2, 1.8))}
    found = mixing.curriculum(df, **options)
    assert found.columns == [*df.columns, "_position"]
    rows = found.collect()
    sources = [r["source"] for r in rows]
    assert len(sources) == 600 and sources[:150].count("a") > 110 and sources[-150:].count("b") > 110
    assert rows == sorted(rows, key=lambda r: (r["_position"], r["doc_id"])) and {r["position"] for r in rows} == {"x"}
    # the numbers of the copies are those of the sorted rows
    ordered = mixing.training_order(mixing.mix(df, **options).select("doc_id", "source", "mix")).collect()
    assert sorted((n, r["doc_id"]) for r in ordered for n in r["orders"]) == [(i, r["doc_id"]) for i, r in enumerate(rows)]


def test_training_order_of_copies(spark):
    rows = [(i, "ab"[i > 2], "w " * 10, "x") for i in range(40)] + [(None, "a", "w w", "x"), (5, "b", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, mix string")
    ordered = mixing.training_order(mixing.mix(df, weights=(5, 1)).select("doc_id", "_mix"), "_mix").collect()
    at = sorted((p, n) for r in ordered for p, n in zip(r["_mix"]["positions"], r["orders"]))
    assert [n for _, n in at] == list(range(len(at))) and any(len(r["orders"]) == 3 for r in ordered)
    assert all(len(r["orders"]) == r["_mix"]["copies"] for r in ordered) and len(ordered) == len(rows)


def test_mix_of_nothing(spark):
    assert mixed(spark, [])[0].count() == 0
    assert mixed(spark, [(1, "a", "", "x"), (2, None, None, "x")])[0].select("_mix.taken").collect() == [(0,), (0,)]


def read(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_windows(df, **options)
    return windows, {r["conv_id"]: r for r in chat.read_windows(windows).collect()}


NASTY = [
    "", None, "^", "^^", "<|", "<^|", "^<|", "<<|^|", "<|im_end|><|im_start|>assistant ok", "line\n<|im_end|>\n<|im_start|>user\n", "é😀", "\\1 $1 %0A +",
    "<^^|", "<", "|", "<|im_start|>" * 3, "tail <",
]


def test_chat_round_trip(spark):
    rows, want = [], {}
    roles = ["system", "user", "assistant", None, "as\nsist<|ant", "assistant"]
    for conv in range(40):
        turns = [(t, roles[(conv + t * 7) % 6] if t or conv % 3 else "system", (NASTY[(conv * 5 + t) % len(NASTY)] or "") * (1 + conv % 4)) for t in range(conv % 9 + 1)]
        rows += [(conv, t, r, x, "w") for t, r, x in turns]
        want[conv] = [(r or "", x) for _, r, x in turns]
    rows.append((None, 0, "user", None, "w"))
    windows, got = read(spark, rows, budget=24, history=8)
    assert len(got) == 41 and got[None]["turns"] == [("user", "")]
    for conv, turns in want.items():
        assert [tuple(t) for t in got[conv]["turns"]] == turns
        assert got[conv]["loss_text"] == "".join(x for r, x in turns if r == "assistant")
    assert windows.where("window > 0").count() > 20


def test_chat_windows_keep_the_budget(spark):
    rows = [(1, 0, "system", "s " * 5, "w")] + [(1, t, "user" if t % 2 else "assistant", "w " * 10, "w") for t in range(1, 30)]
    windows, got = read(spark, rows, budget=60, history=20)
    texts = windows.orderBy("window").collect()
    assert all(w["text"].startswith("<|im_start|>system\n") for w in texts) and len(texts) > 5
    assert all(w["text"].count(" w") + w["text"].count("\nw") + w["text"].count("s ") + 4 * w["text"].count(chat.START) <= 60 for w in texts)
    assert all(w["n_repeated"] == 2 for w in texts[1:]) and texts[0]["n_repeated"] == 0
    assert len(got[1]["turns"]) == 30
    digest = hashlib.sha256(("w " * 10 * 14).encode()).hexdigest()
    assert hashlib.sha256(got[1]["loss_text"].encode()).hexdigest() == digest


def test_chat_of_nothing(spark):
    assert read(spark, [])[1] == {}


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.b", "", "block"), ("x.a.b", "/q", "allow"), ("long.net", "/en/deep/er", "block")]


def judge(url, listed=RULES):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] + [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([i for i in (path.find(c) for c in "?#") if i >= 0] + [len(path)])]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in listed if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "https://NET", "http://net/", "http://a.net/x?y#z", "http://Example.NET/en/1", "http://m.example.net/en",
        "http://example.net?u=http://a.b/", "http://xnet/", "http://a.b", "http://c.x.a.b/qq", "http://x.a.b/#q", "http://www.long.net/en/deep/er/still",
        "http://long.net/en/deep/", "ftp://u:p@net:80/", "http://.net/", "http://net./", "a\nb://net/\nx?", "http://É.net/é", "x://y://net/", "http://net/" + "a/" * 20_000,
    ] * 2
    pages = spark.createDataFrame([(i, u, "own", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, _rule string")
    listed = spark.createDataFrame(RULES + [(None, "/", "block"), ("q", None, "block"), ("net", "/", "block")], "host string, path string, verdict string")
    out = url_filter.judge_urls(pages, listed)
    assert out.columns == ["page_id", "url", "host", "_rule", "_host", "path", "rule", "verdict"]
    got = {r["page_id"]: (r["_host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls)}


def test_urls_of_very_many_labels_and_odd_lists(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_LENGTHS", 3)
    listed = RULES + [("a." * 9 + "deep", "/" + "p" * n, "block") for n in range(6)] + [("x.net", "/" + "q" * n, "allow") for n in range(9)]
    long = "x." * 100_000 + "net"
    urls = [f"http://{long}/", f"http://{long}/qqqqqq", "http://b." + "a." * 9 + "deep/pppp", "http://" + "a." * 8 + "deep/pp", "http://x.net/qqq1", "http://y.x.net/qqqqqqqqq", "http://q/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(listed, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {i: judge(u, listed) for i, u in enumerate(urls)}


def test_urls_with_empty_tables(spark):
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    assert url_filter.judge_urls(pages.limit(0), listed).count() == 0
    assert url_filter.judge_urls(pages, listed.limit(0)).select("verdict", "rule").collect() == [("allow", None)]


def test_bloom_filter_has_no_false_negatives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".org")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    pages = spark.range(6000).select("id", F.concat(F.lit("http://h"), "id", F.lit(".org/x")).alias("url"))
    got = url_filter.judge_urls(pages, listed).groupBy("verdict").count().collect()
    assert sorted(map(tuple, got)) == [("allow", 3000), ("block", 3000)]
