"""Registered queries: streams over the event table. Every stream runs twice and resumes from its checkpoint."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from ledgerlens.operators import monitoring as M
from ledgerlens.operators.state import seed_rows
from ledgerlens.plans.feature_queries import USER, WINDOWS_US
from ledgerlens.plans.metric_queries import FIVE, LOG_SQL, bucket, prediction_log, starts
from ledgerlens.plans.registry import DAY_US, EVENTS_SQL, HOUR_US, SECOND, events, near, near_sql, query
from ledgerlens.scratch import scratch_path
from ledgerlens.sources.tables import read_stream
from ledgerlens.streaming import jobs as ST
from ledgerlens.streaming import tables as TB

MIDDLE = 1_705_363_200 * SECOND  # 2024-01-16
ROLES = ST.StreamRoles({"user": "user_id", "kind": "maybe_user"}, "event_id", "t", "value", SECOND)


def in_two_runs(spark, df, split, run):
    """Publish ``df`` in two parts, calling ``run(stream)`` after each; returns nothing."""
    folder = scratch_path(spark, "stream-source")
    session = ST.streaming_session(spark, spark.sparkContext.defaultParallelism)
    for part in (split, ~split):
        df.where(part).write.mode("append").parquet(folder)
        run(read_stream(session, folder, df.schema)).awaitTermination()


def stream_sql(key: str, prefix: str, masked: bool) -> str:
    known = f"{key} IS NOT NULL" if masked else "TRUE"
    rows = f"OVER (PARTITION BY {key} ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    out = []
    for name, width in WINDOWS_US.items():
        frame = f"OVER (PARTITION BY {key} ORDER BY t RANGE BETWEEN {width} PRECEDING AND 1 PRECEDING)"
        total = near_sql(f"coalesce(sum(value) {frame}, 0.0)")
        out += [f"CASE WHEN {known} THEN count(*) {frame} ELSE 0 END AS {prefix}_count_{name}",
                f"CASE WHEN {known} THEN {total} ELSE 0.0 END AS {prefix}_amt_sum_{name}"]
    out += [f"CASE WHEN {known} THEN count(*) {rows} ELSE 0 END AS {prefix}_txn_count",
            f"CASE WHEN {known} THEN {near_sql(f'avg(value) {rows}', 4)} END AS {prefix}_amt_mean",
            f"CASE WHEN {known} THEN {near_sql(f'stddev_samp(value) {rows}', 4)} END AS {prefix}_amt_std",
            f"CASE WHEN {known} THEN coalesce(t - lag(t) OVER (PARTITION BY {key} ORDER BY t, event_id), -1) ELSE -1 END AS {prefix}_since_last",
            f"CASE WHEN {known} THEN {near_sql(f'(t - min(t) OVER (PARTITION BY {key})) / {DAY_US}.0')} ELSE 0.0 END AS {prefix}_days_since_first"]
    return ", ".join(out)


@query("t1_stateful_features", f"WITH e AS ({EVENTS_SQL}) SELECT event_id, {stream_sql('user_id', 'user', False)}, {stream_sql('maybe_user', 'kind', True)} FROM e")
def t1_stateful_features(spark, sf_dir):
    """Two entities per event, one of them missing at times; equal to the batch windows."""
    df = events(spark, sf_dir).select("event_id", "t", "value", "user_id", "maybe_user")
    path, checkpoint = scratch_path(spark, "t1"), scratch_path(spark, "t1-checkpoint")
    in_two_runs(spark, df, F.col("t") < MIDDLE, lambda s: ST.start_features(s, ROLES, path, checkpoint))
    return stream_out(spark.read.parquet(path))


def stream_out(df, prefixes=("user", "kind")):
    columns = ["event_id"]
    for p in prefixes:
        for n in WINDOWS_US:
            columns.append(f"{p}_count_{n}")
            columns.append(F.when(F.col(f"{p}_count_{n}") == 0, 0.0).otherwise(near(f"{p}_amt_sum_{n}")).alias(f"{p}_amt_sum_{n}"))
        columns += [f"{p}_txn_count", near(f"{p}_amt_mean", 4).alias(f"{p}_amt_mean"), near(f"{p}_amt_std", 4).alias(f"{p}_amt_std"),
                    f"{p}_since_last",
                    F.when(F.col(f"{p}_days_since_first") == 0, 0.0).otherwise(near(f"{p}_days_since_first")).alias(f"{p}_days_since_first")]
    return df.select(*columns)


def stored_state(spark, sf_dir, variable):
    """State of the users after the whole table has streamed, read back from the checkpoint."""
    df = events(spark, sf_dir).select("event_id", "t", "value", "user_id")
    roles = ST.StreamRoles({"user": "user_id"}, "event_id", "t", "value", SECOND)
    session = ST.streaming_session(spark, spark.sparkContext.defaultParallelism)
    folder, checkpoint = scratch_path(spark, "stream-source"), scratch_path(spark, "state-checkpoint")
    df.write.parquet(folder)
    ST.start_features(read_stream(session, folder, df.schema), roles, scratch_path(spark, "state"), checkpoint).awaitTermination()
    return session.read.format("statestore").option("stateVarName", variable).load(checkpoint)


@query("t5_running_stats_in_state", f"""
WITH e AS ({EVENTS_SQL})
SELECT CAST(user_id AS VARCHAR) AS entity_id, count(*) AS n, {near_sql('avg(value)', 4)} AS mean, {near_sql('stddev_samp(value)', 4)} AS std,
       min(t) AS first_seen, max(t) AS last_seen FROM e GROUP BY user_id""")
def t5_running_stats_in_state(spark, sf_dir):
    stats = stored_state(spark, sf_dir, "stats").select("key.entity_id", "value.value.*")
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return stats.select("entity_id", "n", near("mean", 4).alias("mean"), near(std, 4).alias("std"), "first_seen", "last_seen")


@query("t3_state_retention", f"""
WITH e AS ({EVENTS_SQL}), s AS (SELECT *, max(t) OVER (PARTITION BY user_id) AS last FROM e)
SELECT CAST(user_id AS VARCHAR) AS entity_id, t, count(*) AS rows, {near_sql('sum(value)')} AS amount FROM s WHERE t >= last - {7 * DAY_US} GROUP BY user_id, t""")
def t3_state_retention(spark, sf_dir):
    """Instants that the state still holds: none older than seven days before the user's last event."""
    hour = "user_map_value.value"
    instants = F.explode(F.arrays_zip(f"{hour}.t", f"{hour}.rows", f"{hour}.amount")).alias("i")
    hours = stored_state(spark, sf_dir, "hours").select("key.entity_id", instants)
    return hours.select("entity_id", F.col("i.t").alias("t"), F.col("i.rows").alias("rows"), near(F.col("i.amount")).alias("amount"))


@query("t7_cold_start_from_history", f"""
WITH e AS ({EVENTS_SQL}), a AS (SELECT event_id, t, {stream_sql('user_id', 'user', False)} FROM e)
SELECT * EXCLUDE (t) FROM a WHERE t >= {MIDDLE}""")
def t7_cold_start_from_history(spark, sf_dir):
    """The first half of the month is history that seeds the state; the second half streams."""
    df = events(spark, sf_dir).select("event_id", "t", "value", "user_id")
    roles = ST.StreamRoles({"user": "user_id"}, "event_id", "t", "value", SECOND)
    session = ST.streaming_session(spark, spark.sparkContext.defaultParallelism)
    folder, history = scratch_path(spark, "stream-source"), scratch_path(spark, "history")
    df.where(F.col("t") < MIDDLE).write.parquet(history)
    df.where(F.col("t") >= MIDDLE).write.parquet(folder)
    seed = seed_rows(session.read.parquet(history), {"user": USER})
    path = scratch_path(spark, "t7")
    stream = read_stream(session, folder, df.schema)
    ST.start_features(stream, roles, path, scratch_path(spark, "t7-checkpoint"), seed).awaitTermination()
    return stream_out(spark.read.parquet(path), ["user"])


HALF_SQL = EVENTS_SQL.replace("event_id, user_id", "event_id, event_id % 2 AS half, user_id")


def half_events(spark, sf_dir):
    """All events belong to two entities."""
    return events(spark, sf_dir).select("event_id", "t", "value", (F.col("event_id") % 2).alias("half"))


def hot_state(spark, history=None):
    """State in tables, cut finely: entities are split within a micro-batch, and a snapshot comes every third batch."""
    roles = ST.StreamRoles({"half": "half"}, "event_id", "t", "value", SECOND)
    state = TB.StateTables(scratch_path(spark, "state"), roles, snapshot=3, hot_rows=500, rows_per_slice=250)
    TB.start_state(spark, state, history)
    return state


def in_batches(spark, df, number, batches, state, late=None):
    """Stream ``df`` as one micro-batch for each value of the column ``number``, from 0: each is published, by any number of
    tasks, when the one before it is done."""
    folder, path, checkpoint = (scratch_path(spark, n) for n in ("stream-source", "features", "checkpoint"))
    numbered = df.withColumn("_number", number)
    session = ST.streaming_session(spark, spark.sparkContext.defaultParallelism)
    for i in range(batches):
        numbered.where(F.col("_number") == i).drop("_number").write.mode("append").parquet(folder)
        # all that was published is one micro-batch
        stream = read_stream(session, folder, df.schema, max_files=(1 << 31) - 1)
        TB.start_table_features(stream, state, path, checkpoint, late).awaitTermination()
    return spark.read.parquet(path)


def passed(bounds):
    """How many of the bounds an event's time has reached."""
    return sum([(F.col("t") >= b).cast("int") for b in bounds], F.lit(0))


@query("t1_stateful_features_hot_entity", f"WITH e AS ({HALF_SQL}) SELECT event_id, {stream_sql('half', 'half', False)} FROM e")
def t1_stateful_features_hot_entity(spark, sf_dir):
    """Two entities hold all events, which come in six micro-batches; equal to the batch windows."""
    bounds = [MIDDLE + days * DAY_US for days in (-10, -5, 0, 1, 8)]
    return stream_out(in_batches(spark, half_events(spark, sf_dir), passed(bounds), 6, hot_state(spark)), ["half"])


@query("t7_cold_start_hot_entity", f"""
WITH e AS ({HALF_SQL}), a AS (SELECT event_id, t, {stream_sql('half', 'half', False)} FROM e)
SELECT * EXCLUDE (t) FROM a WHERE t >= {MIDDLE}""")
def t7_cold_start_hot_entity(spark, sf_dir):
    """The history of two entities becomes state in pieces; the second half of the month streams."""
    df = half_events(spark, sf_dir)
    state = hot_state(spark, df.where(F.col("t") < MIDDLE))
    late_half = df.where(F.col("t") >= MIDDLE)
    return stream_out(in_batches(spark, late_half, passed([MIDDLE + 2 * DAY_US]), 2, state), ["half"])


LATE_SQL = f"""
WITH e AS ({HALF_SQL}),
b AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN 2 WHEN t >= {MIDDLE} THEN 1 ELSE 0 END AS batch FROM e),
w AS (SELECT batch, max(max(t)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {3 * DAY_US} AS mark FROM b GROUP BY batch),
m AS (SELECT b.*, mark, coalesce(t < mark, FALSE) AS late FROM b JOIN w USING (batch)),
k AS (SELECT event_id, half, t, batch FROM m WHERE NOT late),
f AS (SELECT x.event_id, (SELECT count(*) FROM k y WHERE y.half = x.half AND y.t < x.t AND y.t >= x.t - {HOUR_US} AND y.batch <= x.batch) AS n FROM k x)
SELECT 'row' AS kind, event_id AS id, 'kept' AS status, NULL AS reason, n FROM f
UNION ALL SELECT 'row', event_id, 'rejected', 'event time ' || t || ' is before ' || mark, NULL FROM m WHERE late
UNION ALL SELECT 'batch', batch, CASE WHEN late THEN 'rejected' ELSE 'kept' END, NULL, n
FROM (SELECT batch, late, count(m.event_id) AS n FROM (SELECT DISTINCT batch FROM b) CROSS JOIN (VALUES (TRUE), (FALSE)) l(late) LEFT JOIN m USING (batch, late) GROUP BY ALL)"""


@query("t8_late_policy", LATE_SQL)
def t8_late_policy(spark, sf_dir):
    """A tenth of the events comes in a last micro-batch; those three days behind are rejected with their reason."""
    number = F.when(F.col("event_id") % 10 == 0, 2).otherwise(passed([MIDDLE]))
    policy = TB.LatePolicy(3 * 86_400, scratch_path(spark, "rejected"), scratch_path(spark, "late-counts"))
    kept = in_batches(spark, half_events(spark, sf_dir), number, 3, hot_state(spark), policy)
    rows = kept.select(
        F.lit("row").alias("kind"), F.col("event_id").alias("id"), F.lit("kept").alias("status"), F.lit(None).cast("string").alias("reason"),
        F.col("half_count_1hr").alias("n"))
    rejected = spark.read.parquet(policy.rejected).select(
        F.lit("row"), "event_id", F.lit("rejected"), "reason", F.lit(None).cast("long"))
    counts = spark.read.parquet(policy.counts).where("batch >= 0").select(
        F.lit("batch"), F.col("batch").cast("long"), F.explode(F.create_map(F.lit("kept"), "kept", F.lit("rejected"), "late")).alias("status", "n"))
    none = F.lit(None).cast("string")
    return rows.union(rejected).union(counts.toDF("kind", "id", "status", "n").select("kind", "id", "status", none, "n"))


EXPIRY_MS = 2_000


@query("t4_idle_expiry", f"""
WITH e AS ({EVENTS_SQL})
SELECT DISTINCT CAST(user_id AS VARCHAR) AS entity_id, CASE WHEN user_id % 3 = 0 THEN 'gone' ELSE 'alive' END AS state FROM e""")
def t4_idle_expiry(spark, sf_dir):
    """Entities that come early only outlive their expiry unseen; those that come again, or late, are alive."""
    df = events(spark, sf_dir).select("event_id", "t", "value", "user_id")
    roles = ST.StreamRoles({"user": "user_id"}, "event_id", "t", "value", SECOND)
    session = ST.streaming_session(spark, spark.sparkContext.defaultParallelism)
    folder, path, checkpoint = (scratch_path(spark, n) for n in ("stream-source", "features", "checkpoint"))
    kind, odd = F.col("user_id") % 3, F.col("event_id") % 2 == 1
    # of users 3k + 1, one half of the events comes early; one user may have a single event
    for part in (kind.isin(0, 1) & (odd | (kind == 0)), kind.isin(1, 2) & ~(odd & (kind == 1))):
        df.where(part).write.mode("append").parquet(folder)
        ST.start_features(read_stream(session, folder, df.schema), roles, path, checkpoint, ttl_ms=EXPIRY_MS).awaitTermination()
        time.sleep(EXPIRY_MS / 1000)
    alive = ST.live_state(session, checkpoint).select("key.entity_id").distinct().withColumn("_alive", F.lit(True))
    seen = spark.read.parquet(path).select(F.col("user_id").cast("string").alias("entity_id")).distinct()
    return seen.join(alive, "entity_id", "left").select("entity_id", F.when(F.col("_alive"), "alive").otherwise("gone").alias("state"))


@query("s7_stream_source", f"WITH e AS ({EVENTS_SQL}) SELECT event_id, t, value FROM e")
def s7_stream_source(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", "t", "value")
    path, checkpoint = scratch_path(spark, "s7"), scratch_path(spark, "s7-checkpoint")

    def run(stream):
        return stream.writeStream.format("parquet").option("path", path).option(
            "checkpointLocation", checkpoint
        ).trigger(availableNow=True).start()

    in_two_runs(spark, df, F.col("value") < 50, run)
    return spark.read.parquet(path)


@query("t8_duplicates_and_late_events", f"WITH e AS ({EVENTS_SQL}) SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {WINDOWS_US['24hr']} PRECEDING AND 1 PRECEDING) AS user_count_24hr FROM e")
def t8_duplicates_and_late_events(spark, sf_dir):
    """Every event is sent twice; a repeat neither adds a row nor counts."""
    df = events(spark, sf_dir).select(
        "event_id", "t", "value", "user_id", F.timestamp_micros("t").alias("at")
    )
    roles = ST.StreamRoles({"user": "user_id"}, "event_id", "t", "value", SECOND)
    path, checkpoint = scratch_path(spark, "t8"), scratch_path(spark, "t8-checkpoint")

    def run(stream):
        return ST.start_features(ST.distinct_rows(stream, roles), roles, path, checkpoint)

    in_two_runs(spark, df.unionAll(df), F.col("t") < MIDDLE, run)
    return spark.read.parquet(path).select("event_id", "user_count_24hr")


@query("t8_late_events", "SELECT event_id, CAST(1 AS BIGINT) AS rows FROM events")
def t8_late_events(spark, sf_dir):
    """The older half arrives second, up to a month late, and everything is sent twice: each event comes out once."""
    df = events(spark, sf_dir).select("event_id", "t", "value", "user_id")
    roles = ST.StreamRoles({"user": "user_id"}, "event_id", "t", "value", SECOND)
    path, checkpoint = scratch_path(spark, "t8-late"), scratch_path(spark, "t8-late-checkpoint")

    def run(stream):
        return ST.start_features(ST.distinct_rows(stream, roles), roles, path, checkpoint)

    in_two_runs(spark, df.unionAll(df), F.col("t") >= MIDDLE, run)
    return spark.read.parquet(path).groupBy("event_id").agg(F.count(F.lit(1)).alias("rows"))


@query("t9_streaming_scoring", f"""
WITH e AS ({EVENTS_SQL}), v AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {WINDOWS_US['24hr']} PRECEDING AND 1 PRECEDING) AS c
  FROM e WHERE value > 0), s AS (SELECT *, least(value / 100, 1.0) * CASE WHEN c > 2 THEN 0.9 ELSE 0.6 END AS p FROM v)
SELECT event_id, c AS user_count_24hr, {near_sql('p')} AS fraud_probability, p >= 0.5 AS is_fraud,
       CASE WHEN p < 0.3 THEN 'LOW' WHEN p < 0.5 THEN 'MEDIUM' WHEN p < 0.8 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level FROM s""")
def t9_streaming_scoring(spark, sf_dir):
    """A fixed scoring rule stands for the model, so that the result has an SQL form."""
    df = events(spark, sf_dir).select("event_id", "t", "value", "user_id")
    roles = ST.StreamRoles({"user": "user_id"}, "event_id", "t", "value", SECOND)
    logs = ST.ScoringLogs(*[scratch_path(spark, f"log-{n}") for n in ("scored", "audit", "drift", "rejected")])
    checkpoint = scratch_path(spark, "t9-checkpoint")

    def score(ready):
        weight = F.when(F.col("user_count_24hr") > 2, 0.9).otherwise(0.6)
        return ready.withColumn("score", F.least(F.col("value") / 100, F.lit(1.0)) * weight)

    def run(stream):
        return ST.start_scoring(
            stream, roles, logs, checkpoint, lambda d: d, score, 0.5, "1", ["value", "user_count_24hr"]
        )

    in_two_runs(spark, df, F.col("t") < MIDDLE, run)
    return spark.read.parquet(logs.scored).select(
        "event_id", "user_count_24hr", near("fraud_probability").alias("fraud_probability"), "is_fraud", "risk_level"
    )


@query("t9_resent_ids", f"WITH e AS ({EVENTS_SQL}) SELECT event_id, CAST(1 AS BIGINT) AS rows, least(value / 100, 1.0) >= 0.5 AS is_fraud FROM e WHERE value > 0")
def t9_resent_ids(spark, sf_dir):
    """Every event is sent twice, the second time in part a run later: it is scored and logged once."""
    df = events(spark, sf_dir).select("event_id", "t", "value", "user_id")
    roles = ST.StreamRoles({"user": "user_id"}, "event_id", "t", "value", SECOND)
    logs = ST.ScoringLogs(*[scratch_path(spark, f"log-{n}") for n in ("scored", "audit", "drift", "rejected")])
    checkpoint = scratch_path(spark, "t9-checkpoint")

    def run(stream):
        return ST.start_scoring(
            stream, roles, logs, checkpoint, lambda d: d, lambda d: d.withColumn("score", F.least(F.col("value") / 100, F.lit(1.0))),
            0.5, "1", ["value"])

    # the number tells the two sendings of an event apart, and is not read
    twice = df.withColumn("sent", F.explode(F.array(F.lit(0), F.lit(1))))
    in_two_runs(spark, twice, (F.col("sent") == 0) | (F.col("event_id") % 2 == 0), run)
    return spark.read.parquet(logs.scored).groupBy("event_id").agg(F.count(F.lit(1)).alias("rows"), F.max("is_fraud").alias("is_fraud"))


@query("t10_request_rate_stream", f"WITH p AS ({LOG_SQL}) SELECT {bucket(FIVE)} AS window_start, endpoint, status, count(*) AS requests FROM p GROUP BY ALL")
def t10_request_rate_stream(spark, sf_dir):
    """The batch aggregate on a stream: windows are updated, the latest state of each one counts."""
    df = prediction_log(spark, sf_dir)
    path, checkpoint = scratch_path(spark, "t10"), scratch_path(spark, "t10-checkpoint")

    def write(batch, epoch):
        ST.write_batch(batch, path, epoch)

    def run(stream):
        rates = M.request_rate(stream.withWatermark("ts", "40 days"))
        return rates.writeStream.outputMode("update").foreachBatch(write).option(
            "checkpointLocation", checkpoint
        ).trigger(availableNow=True).start()

    in_two_runs(spark, df, F.col("ts") < F.timestamp_micros(F.lit(MIDDLE)), run)
    latest = spark.read.parquet(path).groupBy("window_start", "endpoint", "status").agg(F.max_by("requests", "batch").alias("requests"))
    return starts(latest)


QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query("t11_latency_sketches", f"""
WITH p AS ({LOG_SQL})
SELECT {bucket(DAY_US)} AS window_start, endpoint, count(*) AS n, TRUE AS p50_near, TRUE AS p95_near, TRUE AS p99_near FROM p GROUP BY 1, 2""")
def t11_latency_sketches(spark, sf_dir):
    """Sketches that a stream stores for each batch and window, merged; ranks in the exact log are at most 2 percent off."""
    log = prediction_log(spark, sf_dir).withColumn("late", F.crc32(F.col("batch_id").cast("string")) % 2 == 0)
    path, checkpoint = scratch_path(spark, "sketches"), scratch_path(spark, "sketch-checkpoint")

    def write(batch, epoch):
        ST.write_batch(M.window_sketches(batch, "latency", width="1 day"), path, epoch)

    def run(stream):
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    in_two_runs(spark, log, F.col("late"), run)
    found = starts(M.sketch_quantiles(spark.read.parquet(path), QUANTILES))
    placed = log.select(F.unix_seconds(F.window("ts", "1 day")["start"]).alias("window_start"), "endpoint", "latency")
    # a value of a rank between those of the estimate and of what is below it
    both = placed.join(found, ["window_start", "endpoint"])
    ranks = both.groupBy("window_start", "endpoint", "n").agg(*[
        ((F.count_if(F.col("latency") < F.col(q)) / F.count(F.lit(1)) <= p + 0.02)
         & (F.count_if(F.col("latency") <= F.col(q)) / F.count(F.lit(1)) >= p - 0.02)).alias(f"{q}_near") for q, p in QUANTILES.items()])
    return ranks
