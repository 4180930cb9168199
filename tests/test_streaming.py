import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.history import expanding_history, recency
from ledgerlens.operators.keyed import Keyed
from ledgerlens.operators.state import seed_rows
from ledgerlens.operators.velocity import velocity
from ledgerlens.sources.tables import read_stream
from ledgerlens.streaming import jobs, tables
from ledgerlens.streaming.processor import EntityFeatures

ROLES = jobs.StreamRoles({"card1": "card1", "email": "P_emaildomain"})
SCHEMA = "TransactionID long, TransactionDT long, TransactionAmt double, card1 long, P_emaildomain string"


@pytest.fixture(scope="module")
def session(spark):
    return jobs.streaming_session(spark, 4)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    return [
        (i, draw.randrange(90, 300) * 3600, round(draw.uniform(1, 90), 2), draw.choice([1, 2, 3, None]), draw.choice(["a.com", "b.com", None]))
        for i in range(200)
    ]


def publish(session, folder, rows):
    session.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").parquet(f"{folder}/in")


def stream(session, folder):
    schema = session.createDataFrame([], SCHEMA).schema
    return read_stream(session, f"{folder}/in", schema)


def batch_features(df, key, prefix):
    spec = Keyed(key)
    return recency(velocity(expanding_history(df, spec, "h", "n"), spec, prefix, null_key="zero"), spec, "last", "first")


def assert_same(session, folder, rows, prefix, key):
    got = {r["TransactionID"]: r for r in session.read.parquet(f"{folder}/out").collect()}
    expected = batch_features(session.createDataFrame(rows, SCHEMA), key, prefix).collect()
    assert len(got) == len(expected) == len(rows)
    for r in expected:
        g = got[r["TransactionID"]]
        for w in ("1hr", "24hr", "7day"):
            assert g[f"{prefix}_count_{w}"] == r[f"{prefix}_count_{w}"]
            assert g[f"{prefix}_amt_sum_{w}"] == pytest.approx(r[f"{prefix}_amt_sum_{w}"])
        assert g[f"{prefix}_txn_count"] == (r["n"] or 0)
        for online, offline in (("mean", "h_mean"), ("std", "h_std"), ("zscore", "h_zscore")):
            assert g[f"{prefix}_amt_{online}"] == pytest.approx(r[offline]) if r[offline] is not None else g[f"{prefix}_amt_{online}"] is None
        assert g[f"{prefix}_since_last"] == r["last"]
        assert g[f"{prefix}_days_since_first"] == pytest.approx(r["first"] or 0.0)


def test_shuffled_micro_batches_equal_batch_windows(session, folder, rows):
    """Files arrive in time order, rows inside them do not."""
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    for part in (ordered[:70], ordered[70:120], ordered[120:]):
        part = list(part)
        random.Random(1).shuffle(part)
        publish(session, folder, part)
        jobs.start_features(stream(session, folder), ROLES, f"{folder}/out", f"{folder}/ck").awaitTermination()
    assert_same(session, folder, rows, "card1", "card1")
    assert_same(session, folder, rows, "email", "P_emaildomain")
    # idle state expires 90 days after its last write
    state = session.read.format("statestore").option("stateVarName", "stats").load(f"{folder}/ck")
    days = state.select((F.col("value.ttlExpirationMs") / 1000 - F.unix_timestamp()) / 86400).collect()
    assert len(days) == 5 and all(89.9 < d[0] <= 90 for d in days)


def test_cold_start_equals_a_longer_stream(session, folder, rows):
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    history = session.createDataFrame(ordered[:120], SCHEMA)
    seed = seed_rows(history, {"card1": Keyed("card1"), "email": Keyed("P_emaildomain")})
    publish(session, folder, ordered[120:])
    jobs.start_features(stream(session, folder), ROLES, f"{folder}/out", f"{folder}/ck", seed).awaitTermination()
    got = {r["TransactionID"]: r for r in session.read.parquet(f"{folder}/out").collect()}
    expected = {r["TransactionID"]: r for r in batch_features(session.createDataFrame(rows, SCHEMA), "card1", "card1").collect()}
    assert len(got) == 80
    for key, g in got.items():
        assert g["card1_count_7day"] == expected[key]["card1_count_7day"]
        assert g["card1_txn_count"] == (expected[key]["n"] or 0)
        assert g["card1_amt_mean"] == (pytest.approx(expected[key]["h_mean"]) if expected[key]["h_mean"] is not None else None)


class Memory:
    """A value or map state held in memory."""

    def __init__(self):
        self.value, self.map = None, {}

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    update = lambda self, v: setattr(self, "value", v)
    iterator = lambda self: iter(list(self.map.items()))
    updateValue = lambda self, k, v: self.map.__setitem__(k, v)
    removeKey = lambda self, k: self.map.pop(k, None)


def processor():
    p = EntityFeatures()
    p.stats, p.hours = Memory(), Memory()
    return p


def feed(p, *events):
    pdf = pd.DataFrame([{"row_id": i, "t": t, "amount": a} for i, t, a in events])
    return pd.concat(list(p.handleInputRows(("card", "x"), iter([pdf]), None)), ignore_index=True)


def test_features_are_read_before_the_update():
    p = processor()
    first = feed(p, (1, 1000, 10.0)).iloc[0]
    assert (first.count_1hr, first.txn_count, first.since_last, first.days_since_first) == (0, 0, -1, 0.0)
    assert first.amt_mean is None and first.amt_zscore == 0.0
    second = feed(p, (2, 1000, 30.0)).iloc[0]
    assert second.count_1hr == 0 and second.txn_count == 1 and second.amt_mean == 10.0 and second.since_last == 0


def test_late_events_see_what_the_state_holds():
    p = processor()
    feed(p, (1, 10_000, 10.0), (2, 20_000, 20.0))
    late = feed(p, (3, 12_000, 5.0)).iloc[0]
    assert late.count_1hr == 1 and late.amt_sum_1hr == 10.0 and late.since_last == 2_000
    assert late.txn_count == 2 and late.amt_mean == 15.0
    early = feed(p, (4, 5_000, 5.0)).iloc[0]
    assert early.count_7day == 0 and early.since_last == -1 and early.days_since_first == 0.0
    assert p.stats.value[3:] == (5_000, 20_000)


def test_state_keeps_the_retention_only():
    p = processor()
    week = 7 * 86400
    feed(p, (1, 100, 1.0), (2, 5_000, 2.0), (3, 100 + week, 4.0))
    kept = sorted(t for v in p.hours.map.values() for t in v[0])
    assert kept == [100, 5_000, 100 + week]
    feed(p, (4, 5_001 + week, 8.0))
    kept = sorted(t for v in p.hours.map.values() for t in v[0] if t >= 5_001)
    assert kept == [100 + week, 5_001 + week]
    feed(p, (5, 20_000 + week, 8.0))
    assert min(t for v in p.hours.map.values() for t in v[0]) == 100 + week
    assert p.stats.value[0] == 5 and p.stats.value[3] == 100


def test_busy_entity_state_is_bounded_by_instants():
    p = processor()
    feed(p, *[(i, i % 10, 1.0) for i in range(5_000)])
    (hour,) = p.hours.map.values()
    assert len(hour[0]) == 10 and sum(hour[1]) == 5_000


def test_missing_amounts():
    p = processor()
    out = feed(p, (1, 0, 5.0), (2, 10, np.nan), (3, 20, 7.0))
    assert list(out.count_1hr) == [0, 1, 2] and list(out.amt_sum_1hr) == [0.0, 5.0, 5.0]
    assert list(out.txn_count) == [0, 1, 1]


def test_scoring_job_writes_its_logs(session, folder):
    data = [(1, 90_000, 10.0, 7, "a.com"), (2, 90_100, 20.0, 7, None), (3, 90_200, -1.0, 7, "a.com"), (None, 90_300, 5.0, 7, "a.com")]
    publish(session, folder, data)
    logs = jobs.ScoringLogs(*[f"{folder}/{n}" for n in ("scored", "audit", "drift", "rejected")])

    def start():
        return jobs.start_scoring(
            stream(session, folder), ROLES, logs, f"{folder}/ck", lambda d: d.withColumn("double_amount", F.col("TransactionAmt") * 2),
            lambda d: d.withColumn("score", F.col("card1_count_24hr") * 0.25 + 0.3), 0.5, "3", ["double_amount", "card1_count_24hr", "absent"],
        )

    start().awaitTermination()
    scored = {r["TransactionID"]: r for r in session.read.parquet(logs.scored).collect()}
    assert set(scored) == {1, 2}
    assert (scored[2]["fraud_probability"], scored[2]["is_fraud"], scored[2]["risk_level"], scored[2]["model_version"]) == (0.55, True, "HIGH", "3")
    assert scored[2]["email_count_24hr"] == 0 and scored[2]["email_since_last"] == -1
    assert session.read.parquet(logs.rejected).count() == 2
    assert set(session.read.parquet(logs.drift).columns) == {"TransactionID", "TransactionDT", "double_amount", "card1_count_24hr", "batch", "day"}
    assert session.read.parquet(logs.audit).count() == 2


def test_a_repeated_micro_batch_replaces_itself(session, folder, rows):
    df = session.createDataFrame(rows[:10], SCHEMA)
    for _ in range(2):
        jobs.write_batch(df, f"{folder}/log", 4)
    jobs.write_batch(df, f"{folder}/log", 5)
    assert session.read.parquet(f"{folder}/log").count() == 20


def table_state(session, folder, **options):
    return tables.StateTables(f"{folder}/state", ROLES, snapshot=2, **options)


def table_stream(session, folder, state, parts, late=None):
    for part in parts:
        session.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = read_stream(session, f"{folder}/in", session.createDataFrame([], SCHEMA).schema, max_files=1)
    tables.start_table_features(source, state, f"{folder}/out", f"{folder}/ck", late).awaitTermination()


def test_state_tables_equal_batch_windows(session, folder, rows):
    """Micro-batches shuffled inside, over a snapshot; entities are split over slices; then the stream resumes."""
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    cuts = [0, 60, 150, 170]
    parts = [random.Random(i).sample(ordered[a:b], b - a) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    state = table_state(session, folder, hot_rows=5, rows_per_slice=3)
    tables.start_state(session, state)
    table_stream(session, folder, state, parts)
    table_stream(session, folder, state, [ordered[170:]])
    assert_same(session, folder, rows, "card1", "card1")
    assert_same(session, folder, rows, "email", "P_emaildomain")


def test_state_tables_from_history(session, folder, rows):
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    state = table_state(session, folder)
    tables.start_state(session, state, session.createDataFrame(ordered[:120], SCHEMA))
    table_stream(session, folder, state, [ordered[120:160], ordered[160:]])
    got = {r["TransactionID"]: r for r in session.read.parquet(f"{folder}/out").collect()}
    expected = {r["TransactionID"]: r for r in batch_features(session.createDataFrame(rows, SCHEMA), "card1", "card1").collect()}
    assert set(got) == {r[0] for r in ordered[120:]}
    for i, g in got.items():
        assert g["card1_count_7day"] == expected[i]["card1_count_7day"] and g["card1_txn_count"] == (expected[i]["n"] or 0)
        assert g["card1_amt_sum_24hr"] == pytest.approx(expected[i]["card1_amt_sum_24hr"]) and g["card1_since_last"] == expected[i]["last"]


def test_a_batch_reads_border_hours_only(session, folder):
    """An entity with an event every ten seconds for a week: an hour's batch reads four hours of instants, not 168."""
    history = [(i, i * 10, 1.0, 1, None) for i in range(60_480)]
    state = table_state(session, folder)
    tables.start_state(session, state, session.createDataFrame(history, SCHEMA))
    batch = session.createDataFrame([(10**6 + i, 604_800 + 600 + i, 1.0, 1, None) for i in range(60)], SCHEMA)
    asked = jobs.entity_rows(batch, ROLES).withColumn("entity", tables.entity_name(F.col("entity_type"), F.col("entity_id")))
    instants, hours, stats = state.asked(session, 0, asked)
    assert instants.count() == 3 * 360 and hours.count() == 165 and stats.count() == 1
    got = {r["row_id"]: r for r in tables.batch_features(jobs.entity_rows(batch, ROLES), state, 0).collect()}
    first = got[10**6]
    assert (first["count_1hr"], first["count_24hr"], first["count_7day"]) == (300, 8580, 60_420)
    assert first["txn_count"] == 60_480 and first["since_last"] == 610


def test_huge_amounts_do_not_wipe_later_windows(session, folder):
    rows = [(1, 90_000, 1e30, 1, None), (2, 90_001, 0.1, 1, None), (3, 94_000, 0.2, 1, None), (4, 94_100, 5.0, 1, None)]
    state = table_state(session, folder)
    tables.start_state(session, state)
    table_stream(session, folder, state, [rows[:2], rows[2:]])
    got = {r["TransactionID"]: r["card1_amt_sum_1hr"] for r in session.read.parquet(f"{folder}/out").collect()}
    assert got == {1: 0.0, 2: 1e30, 3: 0.0, 4: 0.2}


def test_late_rows_see_their_own_past(session, folder):
    state = table_state(session, folder)
    tables.start_state(session, state)
    table_stream(session, folder, state, [[(1, 100_000, 1.0, 1, None), (2, 101_000, 2.0, 1, None)], [(3, 300_000, 4.0, 1, None)], [(4, 101_500, 8.0, 1, None)]])
    late = next(r for r in session.read.parquet(f"{folder}/out").collect() if r["TransactionID"] == 4)
    assert (late["card1_count_1hr"], late["card1_amt_sum_24hr"], late["card1_txn_count"], late["card1_since_last"]) == (2, 3.0, 3, 500)
    assert late["email_txn_count"] == 0 and late["email_since_last"] == -1


def test_idle_entities_start_anew(session, folder):
    state = table_state(session, folder, ttl_ms=1)
    tables.start_state(session, state)
    table_stream(session, folder, state, [[(1, 100_000, 1.0, 1, None)], [(2, 101_000, 2.0, 1, None)]])
    assert {r["card1_txn_count"] for r in session.read.parquet(f"{folder}/out").collect()} == {0}


def test_late_policy_sets_rows_aside(session, folder):
    state = table_state(session, folder)
    tables.start_state(session, state)
    late = tables.LatePolicy(3_600, f"{folder}/rejected", f"{folder}/counts")
    parts = [[(1, 100_000, 1.0, 1, None), (2, 90_000, 1.0, 1, None)], [(3, 96_400, 1.0, 1, None), (4, 96_399, 1.0, 1, None), (5, None, 1.0, 1, None)], [(6, 200_000, 1.0, 1, None)]]
    table_stream(session, folder, state, parts, late)
    assert {r["TransactionID"] for r in session.read.parquet(f"{folder}/out").collect()} == {1, 2, 3, 5, 6}
    rejected = session.read.parquet(f"{folder}/rejected").collect()
    assert [(r["TransactionID"], r["reason"]) for r in rejected] == [(4, "event time 96399 is before 96400")]
    counts = {r["batch"]: (r["newest"], r["kept"], r["late"]) for r in session.read.parquet(f"{folder}/counts").collect()}
    assert counts == {-1: (None, 0, 0), 0: (100_000, 2, 0), 1: (100_000, 2, 1), 2: (200_000, 1, 0)}


def test_an_ordinary_entity_is_read_and_written_once_in_a_batch():
    """Events in forty hours: one entry of the state, not one per hour."""
    p, calls = processor(), []
    write, read = p.hours.updateValue, p.hours.iterator
    p.hours.updateValue = lambda k, v: (calls.append("write"), write(k, v))
    p.hours.iterator = lambda: (calls.append("read"), read())[1]
    feed(p, *[(i, i * 3_600, 1.0) for i in range(40)])
    assert calls == ["write"]
    feed(p, *[(i, i * 3_600, 1.0) for i in range(40, 60)])
    assert calls == ["write", "read", "write"] and list(p.hours.map) == [(0,)]


def test_entries_of_a_busy_entity_keep_every_instant():
    """Entries are cut between hours, late rows come before all of them, and no instant is lost or too old."""
    draw, p, week, seen, last = random.Random(5), processor(), 7 * 86_400, {}, 0
    for batch in range(12):
        low = 300_000 if batch < 2 else draw.randrange(0, 1_200_000)
        times = [draw.randrange(low, low + 120_000) for _ in range(900)]
        feed(p, *[(i, t, 1.0) for i, t in enumerate(times)])
        last = max(last, *times)
        for t in times:
            seen[t] = seen.get(t, 0) + 1
        seen = {t: n for t, n in seen.items() if t >= last - week}
        entries = [p.hours.map[k] for k in sorted(p.hours.map)]
        assert [t for e in entries for t in e[0]] == sorted(seen)
        assert [n for e in entries for n in e[1]] == [seen[t] for t in sorted(seen)]
        assert all(len({t // 3_600 for t in e[0]}) == 1 or len(e[0]) <= 512 for e in entries)


def test_a_late_policy_that_starts_again_keeps_its_counts(session, folder):
    policy = tables.LatePolicy(10, f"{folder}/rejected", f"{folder}/counts")
    policy.start(session)
    jobs.write_batch(session.createDataFrame([(5, 1, 0)], "newest long, kept long, late long"), policy.counts, 0)
    # the setting of the streaming session is not needed
    policy.start(session.newSession())
    assert [r["batch"] for r in session.read.parquet(policy.counts).orderBy("batch").collect()] == [-1, 0]
