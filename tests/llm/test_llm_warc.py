"""WARC archives: round trips, revisits, pushed predicates, foreign files."""

import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from ledgerlens.llm import warc

PAGES = [
    (1, "http://a/", "same"), (2, "http://b/?x=\r\n1", "same"), (3, None, "other é😀"), (4, "http://d/é ", ""), (5, "x", None),
    (6, "y", "big " * 100_000), (7, "z", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (9, "same url", "same"), (None, "n", "nobody"), (None, "n", "same"),
    (3, "again", "other é😀"),
]


@pytest.fixture()
def archive(spark, folder):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload string")
    path = f"{folder}/archive"
    warc.write_pages(pages.repartition(4), path)
    return path


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark, archive):
    got = warc.read_archives(spark, archive).withColumn("page_id", warc.page_of("record_id")).withColumn("to", warc.page_of("refers_to")).collect()
    assert len(got) == len(PAGES)
    want = []
    for page_id, _, html in PAGES:
        top = max((i for i, _, h in PAGES if i is not None and (h or "") == (html or "")), default=None)
        revisit = top is not None and (page_id is None or page_id < top)
        want.append((page_id, len((html or "").encode()), digest(html), "revisit" if revisit else "response", top if revisit else None, None if revisit else (html or "").encode()))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["to"], None if r["payload"] is None else bytes(r["payload"])) for r in got), key=str) == sorted(want, key=str)


def test_archives_roll_over(spark, folder, monkeypatch):
    monkeypatch.setattr(warc, "ROLL_BYTES", 600)
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.write_pages(pages, f"{folder}/rolled")
    files = warc.WarcReader({"path": f"{folder}/rolled"}).partitions()
    assert len(files) > 10 and all(f.size < 600 + 400 for f in files)
    read = warc.read_archives(spark, f"{folder}/rolled")
    assert read.rdd.getNumPartitions() == len(files) and sorted(r["target_uri"] for r in read.collect()) == ["u"] * 40
    assert warc.qualified(spark, f"{folder}/x") == f"file:{folder}/x"


def test_small_payloads_stay_responses(spark, folder):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    warc.write_pages(pages, f"{folder}/a", min_bytes=3)
    got = warc.read_archives(spark, f"{folder}/a").where("record_type = 'revisit'").select("record_id", "refers_to").collect()
    assert got == [("urn:page:3", "urn:page:4")]


def test_predicates_reach_the_reader(spark, archive):
    revisits = warc.read_archives(spark, archive).where(F.col("record_type") == "revisit")
    plan = revisits._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: []" not in plan and revisits.count() == 4
    assert warc.read_archives(spark, archive).where(F.col("payload_digest").isin(digest("same"), "x")).count() == 4
    reader = warc.WarcReader({"path": archive})
    rest = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("record_id",), ("urn:page:9", "urn:page:1")), GreaterThan(("payload_bytes",), 3)]))
    assert rest == [GreaterThan(("payload_bytes",), 3)]
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[1] for r in rows] == ["urn:page:9"]


def test_unwanted_payloads_are_not_inflated(archive, monkeypatch):
    seen = []
    monkeypatch.setattr(warc._Source, "upto", lambda self, n: seen.append(n))
    reader = warc.WarcReader({"path": archive, "payload": "false"})
    assert len([r for p in reader.partitions() for r in reader.read(p)]) == len(PAGES) and not seen


@pytest.mark.parametrize("packed", ["plain", "gzip", "own"])
def test_foreign_archives(packed):
    """Records without the extra field, and uncompressed ones, with other record types between them."""
    row = {"record_id": "urn:page:1", "target_uri": "u", "refers_to": None, "payload_digest": digest("x" * 9_000), "payload_bytes": 9_000, "payload": b"x" * 9_000}
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    parts = [info, warc.record_bytes(row), info, warc.record_bytes(row | {"refers_to": "urn:page:2"})]
    pack = {"plain": lambda b: b, "gzip": gzip.compress, "own": warc.member}[packed]
    data = b"".join(map(pack, parts))
    rows = list(warc.records(io.BytesIO(data), len(data)))
    assert [r[0] for r in rows] == ["warcinfo", "response", "warcinfo", "revisit"]
    assert rows[1][5:] == (9_000, b"x" * 9_000) and rows[3][5:] == (9_000, None) and rows[0][5:] == (None, None)
    assert len(list(warc.records(io.BytesIO(data), len(data), lambda r: r["record_type"] == "revisit"))) == 1
    if packed == "own":
        assert gzip.decompress(data) == b"".join(parts)


def test_broken_payload_is_noticed():
    row = {"record_id": "urn:page:1", "target_uri": None, "refers_to": None, "payload_digest": digest("a"), "payload_bytes": 1, "payload": b"b"}
    data = warc.member(warc.record_bytes(row))
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(io.BytesIO(data), len(data)))


def test_no_pages(spark, folder):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_pages(pages, f"{folder}/a")
    assert warc.read_archives(spark, f"{folder}/a").count() == 0
