"""Registered queries: keyed features, joins against a history, encoding, global order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import encoding as E
from ledgerlens.operators import joins as J
from ledgerlens.operators import ordered as O
from ledgerlens.operators.history import expanding_history, recency
from ledgerlens.operators.keyed import Keyed
from ledgerlens.operators.time_features import clock_features
from ledgerlens.operators.velocity import velocity
from ledgerlens.plans.pipeline import FeaturePlan, build_features
from ledgerlens.plans.registry import (
    DAY_US, EPOCH_2024, EVENTS_SQL, HOUR_US, ORDERS_SQL, SECOND, WEEK_US, events, near, near_sql, orders, query,
    table,
)
from ledgerlens.skew import slice_count

USER = Keyed("user_id", "t", "event_id", "value", SECOND)
MAYBE_USER = Keyed("maybe_user", "t", "event_id", "value", SECOND)
TYPE = Keyed("event_type", "t", "event_id", "value", SECOND)
CUSTOMER = Keyed("o_custkey", "t", "o_orderkey", "o_totalprice", SECOND)

WINDOWS_US = {"1hr": HOUR_US, "24hr": DAY_US, "7day": WEEK_US}


def velocity_sql(source: str, key: str, row_id: str, amount: str, masked: bool = False) -> str:
    columns = []
    for name, width in WINDOWS_US.items():
        frame = f"OVER (PARTITION BY {key} ORDER BY t RANGE BETWEEN {width} PRECEDING AND 1 PRECEDING)"
        count, total = f"count(*) {frame}", near_sql(f"coalesce(sum({amount}) {frame}, 0.0)")
        if masked:
            count = f"CASE WHEN {key} IS NOT NULL THEN {count} END"
            total = f"CASE WHEN {key} IS NOT NULL THEN {total} END"
        columns += [f"{count} AS {key}_count_{name}", f"{total} AS {key}_amt_sum_{name}"]
    return f"WITH e AS ({source}) SELECT {row_id}, {', '.join(columns)} FROM e"


def velocity_out(df, key, row_id):
    return df.select(
        row_id,
        *[c for n in WINDOWS_US for c in (f"{key}_count_{n}", near(f"{key}_amt_sum_{n}").alias(f"{key}_amt_sum_{n}"))],
    )


@query("w1_velocity", velocity_sql(EVENTS_SQL, "user_id", "event_id", "value"))
def w1_velocity(spark, sf_dir):
    return velocity_out(velocity(events(spark, sf_dir), USER), "user_id", "event_id")


@query("w1_velocity_ties", velocity_sql(ORDERS_SQL, "o_custkey", "o_orderkey", "o_totalprice"))
def w1_velocity_ties(spark, sf_dir):
    return velocity_out(velocity(orders(spark, sf_dir), CUSTOMER), "o_custkey", "o_orderkey")


@query("w1_velocity_hot_keys", velocity_sql(EVENTS_SQL, "event_type", "event_id", "value"))
def w1_velocity_hot_keys(spark, sf_dir):
    """Five keys hold all rows: every one is cut into slices."""
    df = velocity(events(spark, sf_dir), TYPE, frame_rows=1_000, rows_per_slice=20_000)
    return velocity_out(df, "event_type", "event_id")


# a seventh of the events has no time; users differ in the size of their amounts, and some amounts are huge
EXTREME_SQL = f"""
WITH e AS (
  SELECT event_id, event_type, CASE WHEN event_id % 7 <> 0 THEN t END AS t,
         CASE WHEN event_type IN ('view', 'click') THEN value * 1e-12 WHEN event_id % 50 = 3 THEN 1e30 ELSE value END AS x
  FROM ({EVENTS_SQL})),
w AS (
  SELECT event_id, t IS NULL AS untimed, {", ".join(
    f"count(*) OVER (PARTITION BY event_type, t IS NULL ORDER BY t RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING) AS n_{n}, "
    f"sum(x) OVER (PARTITION BY event_type, t IS NULL ORDER BY t RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING) AS s_{n}"
    for n, w in WINDOWS_US.items())}
  FROM e)
SELECT branch, event_id, {", ".join(
    f"CASE WHEN untimed THEN 0 ELSE n_{n} END AS event_type_count_{n}, CASE WHEN untimed OR n_{n} = 0 THEN 0.0 "
    f"WHEN s_{n} >= 1e20 THEN {near_sql(f's_{n} / 1e24', 3)} WHEN s_{n} < 1e-3 THEN {near_sql(f's_{n} * 1e12', 3)} "
    f"ELSE {near_sql(f's_{n}')} END AS event_type_amt_sum_{n}" for n in WINDOWS_US)}
FROM w, (VALUES ('frame'), ('prefix')) b(branch)"""


@query("w1_switch_extremes", EXTREME_SQL)
def w1_switch_extremes(spark, sf_dir):
    """Range frames and prefix sums over the same rows; sums are shown in units of their size."""
    kind = F.col("event_type").isin("view", "click")
    df = events(spark, sf_dir).select(
        "event_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("t")).alias("t"),
        F.when(kind, F.col("value") * F.lit(1e-12)).when(F.col("event_id") % 50 == 3, F.lit(1e30)).otherwise(F.col("value")).alias("value"),
    )

    def shown(c: str):
        s = F.col(c)
        return F.when(s >= 1e20, near(s / 1e24, 3)).when(s < 1e-3, near(s * 1e12, 3)).otherwise(near(s)).alias(c)

    branches = {"frame": {"frame_rows": 1 << 40}, "prefix": {"frame_rows": 1, "rows_per_slice": 20_000}}
    frame, prefix = (
        velocity(df, TYPE, **tuning).select(
            F.lit(branch).alias("branch"), "event_id",
            *[c for n in WINDOWS_US for c in (f"event_type_count_{n}", shown(f"event_type_amt_sum_{n}"))])
        for branch, tuning in branches.items()
    )
    return frame.unionByName(prefix)


@query("p5_null_key_masking", velocity_sql(EVENTS_SQL, "maybe_user", "event_id", "value", masked=True))
def p5_null_key_masking(spark, sf_dir):
    return velocity_out(velocity(events(spark, sf_dir), MAYBE_USER), "maybe_user", "event_id")


def history_sql(source: str, key: str, row_id: str, amount: str, masked: bool = False) -> str:
    frame = f"OVER (PARTITION BY {key} ORDER BY t, {row_id} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    known = f"{key} IS NOT NULL" if masked else "TRUE"
    return f"""
WITH e AS ({source}),
h AS (SELECT {row_id}, {amount} AS x, {known} AS known, count({amount}) {frame} AS n, avg({amount}) {frame} AS m,
             stddev_samp({amount}) {frame} AS s FROM e)
SELECT {row_id}, CASE WHEN known THEN n END AS n, CASE WHEN known THEN {near_sql('m', 4)} END AS h_mean,
       CASE WHEN known THEN {near_sql('s', 4)} END AS h_std,
       CASE WHEN known THEN {near_sql('x - m', 4)} END AS h_deviation,
       CASE WHEN known AND s > 0 THEN {near_sql('(x - m) / s', 4)} ELSE 0.0 END AS h_zscore
FROM h"""


def history_out(df, row_id):
    return df.select(
        row_id, "n", *[near(c, 4).alias(c) for c in ("h_mean", "h_std", "h_deviation")],
        F.when(F.col("h_zscore") == 0, 0.0).otherwise(near("h_zscore", 4)).alias("h_zscore"),
    )


@query("w2_expanding_history", history_sql(ORDERS_SQL, "o_custkey", "o_orderkey", "o_totalprice"))
def w2_expanding_history(spark, sf_dir):
    return history_out(expanding_history(orders(spark, sf_dir), CUSTOMER, "h", "n"), "o_orderkey")


@query("w3_deviation_zscore", history_sql(EVENTS_SQL, "maybe_user", "event_id", "value", masked=True))
def w3_deviation_zscore(spark, sf_dir):
    return history_out(expanding_history(events(spark, sf_dir), MAYBE_USER, "h", "n"), "event_id")


@query("w2_expanding_history_hot_keys", history_sql(EVENTS_SQL, "event_type", "event_id", "value"))
def w2_expanding_history_hot_keys(spark, sf_dir):
    df = expanding_history(events(spark, sf_dir), TYPE, "h", "n", hot_rows=1_000, rows_per_slice=10_000)
    return history_out(df, "event_id")


@query("w4_time_since_last", f"""
WITH e AS ({EVENTS_SQL})
SELECT event_id, CASE WHEN maybe_user IS NULL THEN -1
       ELSE coalesce(t - lag(t) OVER (PARTITION BY maybe_user ORDER BY t, event_id), -1) END AS since_last
FROM e""")
def w4_time_since_last(spark, sf_dir):
    return recency(events(spark, sf_dir), MAYBE_USER, "since_last", "since_first").select("event_id", "since_last")


@query("w5_days_since_first", f"""
WITH e AS ({EVENTS_SQL})
SELECT event_id, CASE WHEN maybe_user IS NOT NULL
       THEN {near_sql(f'(t - min(t) OVER (PARTITION BY maybe_user)) / {DAY_US}.0')} END AS since_first
FROM e""")
def w5_days_since_first(spark, sf_dir):
    df = recency(events(spark, sf_dir), MAYBE_USER, "since_last", "since_first")
    return df.select("event_id", near("since_first").alias("since_first"))


CLOCK_SQL = f"""
SELECT event_id, user_id, t, CAST((t // {HOUR_US}) % 24 AS BIGINT) AS hour_of_day,
       CAST((t // {DAY_US}) % 7 AS BIGINT) AS day_of_week,
       {near_sql(f'(t - {EPOCH_2024}) / {DAY_US}.0')} AS days_since_start,
       CAST((t // {HOUR_US}) % 24 >= 23 OR (t // {HOUR_US}) % 24 <= 5 AS INT) AS is_night_transaction,
       CAST((t // {DAY_US}) % 7 >= 5 AS INT) AS is_weekend
FROM e"""


@query("f1_f5_clock_features", f"WITH e AS ({EVENTS_SQL}) {CLOCK_SQL}")
def f1_f5_clock_features(spark, sf_dir):
    df = clock_features(events(spark, sf_dir), USER, EPOCH_2024)
    return df.select(
        "event_id", "user_id", "t", "hour_of_day", "day_of_week", near("days_since_start").alias("days_since_start"),
        "is_night_transaction", "is_weekend",
    )


@query("time_features", f"""
WITH e AS ({EVENTS_SQL}), c AS ({CLOCK_SQL})
SELECT * EXCLUDE (user_id, t), coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id), -1) AS since_last,
       {near_sql(f'(t - min(t) OVER (PARTITION BY user_id)) / {DAY_US}.0')} AS since_first
FROM c""")
def time_features_query(spark, sf_dir):
    df = clock_features(events(spark, sf_dir), USER, EPOCH_2024)
    df = recency(df, USER, "since_last", "since_first")
    return df.select(
        "event_id", "hour_of_day", "day_of_week", near("days_since_start").alias("days_since_start"),
        "is_night_transaction", "is_weekend", "since_last", near("since_first").alias("since_first"),
    )


@query("f6_f11_scalar_functions", f"""
WITH e AS ({EVENTS_SQL})
SELECT event_id, CASE WHEN maybe_user > 10 THEN value ELSE -1.0 END AS chosen, coalesce(maybe_user, -1) AS filled,
       (maybe_user IS NULL) AS missing, {near_sql('ln(greatest(value, 0.0001))')} AS log_floor,
       {near_sql('sqrt(abs(value - 50))')} AS root, {near_sql('value * value', 4)} AS square,
       event_type IN ('view', 'click') AS browsing,
       translate(event_type || ': a/b', ': /', '___') AS safe
FROM e""")
def f6_f11_scalar_functions(spark, sf_dir):
    value = F.col("value")
    return events(spark, sf_dir).select(
        "event_id", S.where(F.col("maybe_user") > 10, value, F.lit(-1.0)).alias("chosen"),
        F.coalesce("maybe_user", F.lit(-1).cast("long")).alias("filled"), F.col("maybe_user").isNull().alias("missing"),
        near(F.ln(S.floor_clip(value, 1e-4))).alias("log_floor"), near(F.sqrt(F.abs(value - 50))).alias("root"),
        near(F.pow(value, F.lit(2.0)), 4).alias("square"), S.in_domain(F.col("event_type"), ["view", "click"]).alias("browsing"),
        S.safe_key(F.concat("event_type", F.lit(": a/b"))).alias("safe"),
    )


# --- lookups of requests in a history: purchases ask, all other events are the history ---

def point_sql(key: str) -> str:
    """Requests are purchases, history is everything else; only earlier instants count."""
    windows = ", ".join(
        f"count(h.event_id) FILTER (h.t >= r.t - {w}) AS {key}_count_{n}, "
        f"{near_sql(f'coalesce(sum(h.value) FILTER (h.t >= r.t - {w}), 0.0)')} AS {key}_amt_sum_{n}"
        for n, w in WINDOWS_US.items()
    )
    return f"""
WITH e AS ({EVENTS_SQL}), r AS (SELECT * FROM e WHERE label = 1), h AS (SELECT * FROM e WHERE label = 0)
SELECT r.event_id, {windows}, count(h.event_id) AS n, {near_sql('avg(h.value)', 4)} AS mean,
       {near_sql('stddev_samp(h.value)', 4)} AS std, coalesce(r.t - max(h.t), -1) AS since_last,
       {near_sql(f'coalesce((r.t - min(h.t)) / {DAY_US}.0, 0.0)')} AS since_first
FROM r LEFT JOIN h ON h.{key} = r.{key} AND h.t < r.t GROUP BY r.event_id, r.t"""


def point_out(df, key):
    return df.select(
        "event_id",
        *[c for n in WINDOWS_US for c in (f"{key}_count_{n}", near(f"{key}_amt_sum_{n}").alias(f"{key}_amt_sum_{n}"))],
        F.col(f"{key}_txn_count").alias("n"), near(f"{key}_amt_mean", 4).alias("mean"),
        near(f"{key}_amt_std", 4).alias("std"), F.col(f"{key}_since_last").alias("since_last"),
        near(f"{key}_days_since_first").alias("since_first"),
    )


@query("j6_point_in_time_join", point_sql("user_id"))
def j6_point_in_time_join(spark, sf_dir):
    df = events(spark, sf_dir)
    return point_out(J.point_in_time(df.where("label = 1"), df.where("label = 0"), USER, "user_id"), "user_id")


ENCODED_ROLE = Keyed("half", "t", "event_id", "value", SECOND)


@query("j6_point_in_time_join_hot_keys", f"""
WITH e AS ({EVENTS_SQL}), k AS (SELECT *, CAST(value > 50 AS INT) AS half FROM e)
SELECT event_id, count(*) FILTER (label = 0) OVER w1 AS half_count_1hr,
       {near_sql('coalesce(sum(value) FILTER (label = 0) OVER w1, 0.0)')} AS half_amt_sum_1hr,
       count(*) FILTER (label = 0) OVER w2 AS n, {near_sql('avg(value) FILTER (label = 0) OVER w2', 4)} AS mean
FROM k
WINDOW w1 AS (PARTITION BY half ORDER BY t RANGE BETWEEN {HOUR_US} PRECEDING AND 1 PRECEDING),
       w2 AS (PARTITION BY half ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
QUALIFY label = 1""")
def j6_point_in_time_join_hot_keys(spark, sf_dir):
    """Two keys hold all rows."""
    df = events(spark, sf_dir).withColumn("half", (F.col("value") > 50).cast("int"))
    out = J.point_in_time(
        df.where("label = 1"), df.where("label = 0"), ENCODED_ROLE, "half", frame_rows=1_000, hot_rows=1_000, rows_per_slice=20_000
    )
    return out.select(
        "event_id", "half_count_1hr", near("half_amt_sum_1hr").alias("half_amt_sum_1hr"),
        F.col("half_txn_count").alias("n"), near("half_amt_mean", 4).alias("mean"),
    )


@query("j7_last_seen", f"""
WITH e AS ({EVENTS_SQL})
SELECT event_id, coalesce(t - max(t) FILTER (label = 0) OVER (PARTITION BY user_id ORDER BY t
       RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS since_last
FROM e QUALIFY label = 1""")
def j7_last_seen(spark, sf_dir):
    df = events(spark, sf_dir)
    return J.last_seen(df.where("label = 1"), df.where("label = 0"), USER).select("event_id", "since_last")


@query("t6_first_seen_defaults", f"""
WITH e AS ({EVENTS_SQL})
SELECT event_id, CASE WHEN maybe_user IS NULL THEN 0 ELSE count(*) OVER w1 END AS maybe_user_count_24hr,
       CASE WHEN maybe_user IS NULL THEN 0.0 ELSE {near_sql('coalesce(sum(value) OVER w1, 0.0)')} END AS maybe_user_amt_sum_24hr,
       CASE WHEN maybe_user IS NULL THEN 0 ELSE count(*) OVER w2 END AS n,
       CASE WHEN maybe_user IS NULL THEN NULL ELSE {near_sql('avg(value) OVER w2', 4)} END AS mean,
       CASE WHEN maybe_user IS NULL THEN -1 ELSE coalesce(t - max(t) OVER w2, -1) END AS since_last,
       CASE WHEN maybe_user IS NULL THEN 0.0
            ELSE {near_sql(f'coalesce((t - min(t) OVER w2) / {DAY_US}.0, 0.0)')} END AS since_first
FROM e
WINDOW w1 AS (PARTITION BY maybe_user ORDER BY t RANGE BETWEEN {DAY_US} PRECEDING AND 1 PRECEDING),
       w2 AS (PARTITION BY maybe_user ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def t6_first_seen_defaults(spark, sf_dir):
    df = events(spark, sf_dir)
    out = J.point_in_time(df, df, MAYBE_USER, "maybe_user", null_key="zero")
    return out.select(
        "event_id", "maybe_user_count_24hr", F.when(F.col("maybe_user").isNull(), 0.0).otherwise(near("maybe_user_amt_sum_24hr")).alias("maybe_user_amt_sum_24hr"),
        F.col("maybe_user_txn_count").alias("n"), near("maybe_user_amt_mean", 4).alias("mean"),
        F.col("maybe_user_since_last").alias("since_last"),
        F.when(F.col("maybe_user").isNull(), 0.0).otherwise(near("maybe_user_days_since_first")).alias("since_first"),
    )


# --- target encoding ---

FOLDS_SQL = f"""
WITH e AS ({EVENTS_SQL}), y AS (SELECT *, CAST(value > 80 AS INT) AS target FROM e),
i AS (SELECT *, row_number() OVER (ORDER BY t, event_id) - 1 AS pos, count(*) OVER () AS rows FROM y),
f AS (SELECT *, CASE WHEN pos < (rows % 5) * (rows // 5 + 1) THEN pos // (rows // 5 + 1)
             ELSE rows % 5 + (pos - (rows % 5) * (rows // 5 + 1)) // (rows // 5) END AS fold,
             avg(target) OVER () AS g FROM i)"""


@query("a2_out_of_fold_encoding", FOLDS_SQL + f""",
s AS (SELECT user_id, fold, sum(target) AS s, count(*) AS n FROM f GROUP BY 1, 2),
a AS (SELECT user_id, sum(s) AS s, sum(n) AS n FROM s GROUP BY 1)
SELECT f.event_id, {near_sql('CASE WHEN a.n - s.n > 0 THEN (a.s - s.s + g) / (a.n - s.n + 1.0) ELSE g END')} AS user_id_encoded
FROM f JOIN s USING (user_id, fold) JOIN a USING (user_id)""")
def a2_out_of_fold_encoding(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("target", (F.col("value") > 80).cast("int"))
    out, _ = E.fold_encode(df, ["user_id"], "target", ["t", "event_id"])
    return out.select("event_id", near("user_id_encoded").alias("user_id_encoded"))


@query("a2_out_of_fold_encoding_null_category", FOLDS_SQL + f""",
s AS (SELECT maybe_user, fold, sum(target) AS s, count(*) AS n FROM f WHERE maybe_user IS NOT NULL GROUP BY 1, 2),
a AS (SELECT maybe_user, sum(s) AS s, sum(n) AS n FROM s GROUP BY 1)
SELECT f.event_id, {near_sql('CASE WHEN a.n - s.n > 0 THEN (a.s - s.s + g) / (a.n - s.n + 1.0) ELSE g END')} AS maybe_user_encoded
FROM f LEFT JOIN s ON f.maybe_user = s.maybe_user AND f.fold = s.fold LEFT JOIN a ON f.maybe_user = a.maybe_user""")
def a2_out_of_fold_encoding_null_category(spark, sf_dir):
    """The lookup runs as a shuffled join here, as it does for a large category table."""
    df = events(spark, sf_dir).withColumn("target", (F.col("value") > 80).cast("int"))
    out, _ = E.fold_encode(df, ["maybe_user"], "target", ["t", "event_id"], broadcast_rows=0)
    return out.select("event_id", near("maybe_user_encoded").alias("maybe_user_encoded"))


@query("a1_smoothed_group_mean", f"""
WITH o AS ({ORDERS_SQL}), g AS (SELECT avg(label) AS g FROM o),
l AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS category, label FROM o
      UNION ALL SELECT 'o_orderpriority', o_orderpriority, label FROM o)
SELECT "column", category, {near_sql('(sum(label) + 1.0 * any_value(g)) / (count(*) + 1.0)')} AS smoothed_mean,
       {near_sql('any_value(g)')} AS global_mean
FROM l, g GROUP BY 1, 2""")
def a1_smoothed_group_mean(spark, sf_dir):
    table_ = E.encoding_table(orders(spark, sf_dir), ["o_orderstatus", "o_orderpriority"], "label")
    return table_.select(
        "column", "category", near("smoothed_mean").alias("smoothed_mean"), near("global_mean").alias("global_mean")
    )


LATE_ORDERS = "o_orderstatus <> 'P'"


@query("a3_encode_for_serving", f"""
WITH o AS ({ORDERS_SQL}), fit AS (SELECT * FROM o WHERE {LATE_ORDERS}), g AS (SELECT avg(label) AS g FROM fit),
m AS (SELECT o_orderstatus, (sum(label) + any_value(g)) / (count(*) + 1.0) AS v FROM fit, g GROUP BY 1)
SELECT o_orderkey, {near_sql('coalesce(v, g)')} AS o_orderstatus_encoded FROM o LEFT JOIN m USING (o_orderstatus), g""")
def a3_encode_for_serving(spark, sf_dir):
    """One status never occurs where the encodings are learnt: it gets the global mean."""
    df = orders(spark, sf_dir)
    encodings = E.encoding_table(df.where(LATE_ORDERS), ["o_orderstatus"], "label")
    out = E.apply_encoding(df, encodings, ["o_orderstatus"])
    return out.select("o_orderkey", near("o_orderstatus_encoded").alias("o_orderstatus_encoded"))


@query("j5_lookup_with_default", """
WITH m AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0)
SELECT o_orderkey, coalesce(c_acctbal, -1.0) AS balance FROM orders LEFT JOIN m ON o_custkey = c_custkey""")
def j5_lookup_with_default(spark, sf_dir):
    accounts = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    df = J.lookup(orders(spark, sf_dir), accounts, "o_custkey", "c_acctbal", "balance", F.lit(-1.0), accounts.count())
    return df.select("o_orderkey", "balance")


# --- global order ---

@query("w7_row_index", f"WITH o AS ({ORDERS_SQL}) SELECT o_orderkey, row_number() OVER (ORDER BY t, o_orderkey) - 1 AS row_index FROM o")
def w7_row_index(spark, sf_dir):
    df = orders(spark, sf_dir).select("o_orderkey", "t")
    return O.row_index(df, ["t", "o_orderkey"]).select("o_orderkey", "row_index")


@query("w8_prefix_sums", f"""
WITH o AS ({ORDERS_SQL})
SELECT o_orderkey, {near_sql("coalesce(sum(o_totalprice) OVER (ORDER BY t, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)", 2)} AS before
FROM o""")
def w8_prefix_sums(spark, sf_dir):
    df = orders(spark, sf_dir)
    out = O.prefix_sums(df, ["t", "o_orderkey"], {"before": F.col("o_totalprice")}, slice_count(df, 20_000))
    return out.select("o_orderkey", near("before", 2).alias("before"))


@query("w6_ordered_split", f"""
WITH o AS ({ORDERS_SQL}), i AS (SELECT o_orderkey, row_number() OVER (ORDER BY t, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM o)
SELECT o_orderkey, CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'validate' END AS part FROM i""")
def w6_ordered_split(spark, sf_dir):
    train, rest = O.ordered_split(orders(spark, sf_dir), ["t", "o_orderkey"])
    return train.select("o_orderkey", F.lit("train").alias("part")).unionByName(
        rest.select("o_orderkey", F.lit("validate").alias("part"))
    )


@query("w6_ordered_split_slices", f"""
WITH o AS ({ORDERS_SQL}), i AS (SELECT o_orderkey, row_number() OVER (ORDER BY t, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM o)
SELECT o_orderkey, CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'validate' END AS part FROM i""")
def w6_ordered_split_slices(spark, sf_dir):
    """The same split over at least eight slices."""
    df = orders(spark, sf_dir)
    train, rest = O.ordered_split(df, ["t", "o_orderkey"], rows_per_slice=max(1, df.count() // 8))
    return train.select("o_orderkey", F.lit("train").alias("part")).unionByName(
        rest.select("o_orderkey", F.lit("validate").alias("part"))
    )


NULL_TIMES_SQL = f"""
WITH o AS ({ORDERS_SQL}),
m AS (SELECT o_orderkey, label, CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE t END AS t FROM o),
i AS (SELECT *, row_number() OVER (ORDER BY t NULLS LAST, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM m)"""


def orders_without_times(spark, sf_dir):
    df = orders(spark, sf_dir)
    return df.withColumn("t", F.when(F.col("o_orderkey") % 10 != 3, F.col("t")))


@query("w6_split_null_times", f"""{NULL_TIMES_SQL}
SELECT CAST(ratio AS VARCHAR) AS ratio, o_orderkey, CASE WHEN pos < floor(n * ratio) THEN 'train' ELSE 'validate' END AS part FROM i, (VALUES (0.05), (0.8), (0.95)) r(ratio)""")
def w6_split_null_times(spark, sf_dir):
    """Rows without a time come last and stay in a part; the bound of the last ratio is such a row."""
    df, parts = orders_without_times(spark, sf_dir), []
    for ratio in (0.05, 0.8, 0.95):
        for name, part in zip(("train", "validate"), O.ordered_split(df, ["t", "o_orderkey"], ratio)):
            parts.append(part.select(F.lit(f"{ratio:.2f}").alias("ratio"), "o_orderkey", F.lit(name).alias("part")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("w7_row_index_slices", f"""{NULL_TIMES_SQL}
SELECT o_orderkey, pos AS row_index FROM i""")
def w7_row_index_slices(spark, sf_dir):
    df = orders_without_times(spark, sf_dir).select("o_orderkey", "t")
    rows = df.count()
    return O.row_index(df, ["t", "o_orderkey"], rows_per_slice=max(1, rows // 8)).select("o_orderkey", "row_index")


RANKS = (0, 17, 700, 1200)


@query("w6_positions_narrowed", f"""{NULL_TIMES_SQL}
SELECT pos, t, o_orderkey, branch FROM i, (VALUES ('all'), ('narrowed')) b(branch) WHERE pos IN {RANKS}""")
def w6_positions_narrowed(spark, sf_dir):
    """The rows at given positions, from the whole order and from the rows around the positions."""
    df, found = orders_without_times(spark, sf_dir), []
    for branch, narrow in (("all", 10**12), ("narrowed", 0)):
        for rank, (t, key) in zip(RANKS, O.rows_at(df, ["t", "o_orderkey"], list(RANKS), narrow_rows=narrow)):
            found.append((rank, t, key, branch))
    return spark.createDataFrame(found, "pos long, t long, o_orderkey long, branch string")


@query("w8_prefix_sums_slices", f"""
WITH o AS ({ORDERS_SQL})
SELECT o_orderkey, {near_sql("coalesce(sum(o_totalprice) OVER (ORDER BY t, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)", 2)} AS before
FROM o""")
def w8_prefix_sums_slices(spark, sf_dir):
    out = O.prefix_sums(orders(spark, sf_dir), ["t", "o_orderkey"], {"before": F.col("o_totalprice")}, 9)
    return out.select("o_orderkey", near("before", 2).alias("before"))


@query("a2_folds_null_times", f"""{NULL_TIMES_SQL},
f AS (SELECT *, CASE WHEN pos < (n % 5) * (n // 5 + 1) THEN pos // (n // 5 + 1)
             ELSE n % 5 + (pos - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold,
             avg(label) OVER () AS g FROM i JOIN orders USING (o_orderkey)),
s AS (SELECT o_orderpriority, fold, sum(label) AS s, count(*) AS k FROM f GROUP BY 1, 2),
a AS (SELECT o_orderpriority, sum(s) AS s, sum(k) AS k FROM s GROUP BY 1)
SELECT f.o_orderkey, {near_sql('CASE WHEN a.k - s.k > 0 THEN (a.s - s.s + g) / (a.k - s.k + 1.0) ELSE g END')} AS priority
FROM f JOIN s USING (o_orderpriority, fold) JOIN a USING (o_orderpriority)""")
def a2_folds_null_times(spark, sf_dir):
    out, _ = E.fold_encode(orders_without_times(spark, sf_dir), ["o_orderpriority"], "label", ["t", "o_orderkey"])
    return out.select("o_orderkey", near("o_orderpriority_encoded").alias("priority"))


@query("a2_mixed_cardinality", f"""
WITH o AS ({ORDERS_SQL}), g AS (SELECT avg(label) AS g FROM o),
p AS (SELECT o_orderstatus, (sum(label) + any_value(g)) / (count(*) + 1.0) AS v FROM o, g GROUP BY 1),
c AS (SELECT o_custkey, (sum(label) + any_value(g)) / (count(*) + 1.0) AS v FROM o, g GROUP BY 1)
SELECT o_orderkey, {near_sql('p.v')} AS status, {near_sql('c.v')} AS customer FROM o JOIN p USING (o_orderstatus) JOIN c USING (o_custkey)""")
def a2_mixed_cardinality(spark, sf_dir):
    """A small broadcast limit: the column with few categories is broadcast, the other one is shuffled."""
    df = orders(spark, sf_dir).withColumn("o_custkey", F.col("o_custkey").cast("string"))
    encodings = E.encoding_table(df, ["o_orderstatus", "o_custkey"], "label")
    out = E.apply_encoding(df, encodings, ["o_orderstatus", "o_custkey"], broadcast_rows=10)
    return out.select("o_orderkey", near("o_orderstatus_encoded").alias("status"), near("o_custkey_encoded").alias("customer"))


@query("j5_lookup_hot_key", f"""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 7 WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_custkey END AS k FROM orders)
SELECT o_orderkey, coalesce(c_acctbal, -1.0) AS balance FROM o LEFT JOIN customer ON k = c_custkey""")
def j5_lookup_hot_key(spark, sf_dir):
    """A third of the rows has one key, a third none; the lookup is shuffled and deals both out."""
    remainder = F.col("o_orderkey") % 3
    df = orders(spark, sf_dir).select("o_orderkey", F.when(remainder == 0, F.lit(7).cast("long")).when(remainder == 2, F.col("o_custkey")).alias("k"))
    accounts = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), "c_acctbal")
    out = J.lookup(df, accounts, "k", "c_acctbal", "balance", F.lit(-1.0), accounts.count(), broadcast_rows=0, hot_rows=100)
    return out.select("o_orderkey", "balance")


@query("w10_first_per_class", f"""
WITH e AS ({EVENTS_SQL})
SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY t, event_id) AS class_rank
FROM e QUALIFY class_rank <= 5""")
def w10_first_per_class(spark, sf_dir):
    df = O.first_per_class(events(spark, sf_dir), "label", 5, ["t", "event_id"])
    return df.select("event_id", "label", F.col("class_rank").cast("long").alias("class_rank"))


@query("o1_event_time_sort", f"WITH o AS ({ORDERS_SQL}) SELECT o_orderkey, t, o_custkey FROM o ORDER BY t, o_orderkey")
def o1_event_time_sort(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", "t", "o_custkey").orderBy("t", "o_orderkey")


@query("o2_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def o2_top_k(spark, sf_dir):
    return O.top_k(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, "o_orderkey")


@query("o3_seeded_sample", f"""
WITH e AS ({EVENTS_SQL})
SELECT event_id, t, value FROM (SELECT * FROM e ORDER BY md5(event_id || '|42'), event_id LIMIT 2000) ORDER BY t, event_id""")
def o3_seeded_sample(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", "t", "value")
    return O.seeded_sample(df, row_id="event_id", order=["t", "event_id"])


@query("o4_scored_in_input_order", f"""
WITH e AS ({EVENTS_SQL})
SELECT event_id AS position, event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {HOUR_US} PRECEDING AND 1 PRECEDING) AS user_id_count_1hr
FROM e ORDER BY position""")
def o4_scored_in_input_order(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("position", F.col("event_id"))
    scored = velocity(df, USER, windows={"1hr": 3600}).select("position", "event_id", "user_id_count_1hr")
    return O.in_input_order(scored, "position")


PIPELINE = FeaturePlan(
    primary="user_id", secondary="event_type", primary_prefix="user_amt", secondary_prefix="type_amt",
    primary_count="user_txn_count", since_last="since_last", since_first="since_first", time="t", row_id="event_id",
    amount="value", label="label", ticks=SECOND, start=EPOCH_2024, categories=["event_type"],
)


def pipeline_sql() -> str:
    columns = []
    for key in ("user_id", "event_type"):
        for name, width in WINDOWS_US.items():
            frame = f"OVER (PARTITION BY {key} ORDER BY t RANGE BETWEEN {width} PRECEDING AND 1 PRECEDING)"
            columns.append(f"count(*) {frame} AS {key}_count_{name}")
            columns.append(f"{near_sql(f'coalesce(sum(value) {frame}, 0.0)')} AS {key}_amt_sum_{name}")
    for key, prefix in (("user_id", "user_amt"), ("event_type", "type_amt")):
        frame = f"OVER (PARTITION BY {key} ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        mean, std = f"avg(value) {frame}", f"stddev_samp(value) {frame}"
        columns.append(f"{near_sql(mean, 4)} AS {prefix}_mean")
        columns.append(f"{near_sql(std, 4)} AS {prefix}_std")
        columns.append(f"{near_sql(f'value - {mean}', 4)} AS {prefix}_deviation")
    rows = "OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return FOLDS_SQL.replace("CAST(value > 80 AS INT)", "label") + f""",
s AS (SELECT event_type, fold, sum(target) AS s, count(*) AS n FROM f GROUP BY 1, 2),
a AS (SELECT event_type, sum(s) AS s, sum(n) AS n FROM s GROUP BY 1)
SELECT f.event_id, CAST((t // {HOUR_US}) % 24 AS BIGINT) AS hour_of_day, CAST((t // {DAY_US}) % 7 >= 5 AS INT) AS is_weekend,
       count(value) {rows} AS user_txn_count, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id), -1) AS since_last,
       {', '.join(columns)},
       {near_sql('CASE WHEN a.n - s.n > 0 THEN (a.s - s.s + g) / (a.n - s.n + 1.0) ELSE g END')} AS event_type_encoded
FROM f JOIN s USING (event_type, fold) JOIN a USING (event_type)"""


@query("m6_feature_pipeline", pipeline_sql())
def m6_feature_pipeline(spark, sf_dir):
    out, _ = build_features(events(spark, sf_dir), PIPELINE, fit=True)
    sums = [f"{k}_amt_sum_{n}" for k in ("user_id", "event_type") for n in WINDOWS_US]
    counts = [f"{k}_count_{n}" for k in ("user_id", "event_type") for n in WINDOWS_US]
    stats = [f"{p}_{s}" for p in ("user_amt", "type_amt") for s in ("mean", "std", "deviation")]
    return out.select(
        "event_id", "hour_of_day", "is_weekend", "user_txn_count", "since_last", *counts,
        *[near(c).alias(c) for c in sums], *[near(c, 4).alias(c) for c in stats],
        near("event_type_encoded").alias("event_type_encoded"),
    )
