"""Registered queries: evaluation, drift, entity state, monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.config import BATCH_SIZE_BUCKETS, SCORE_BUCKETS, SWEEP_THRESHOLDS
from ledgerlens.functions import scalars as S
from ledgerlens.operators import drift as D
from ledgerlens.operators import evaluation as V
from ledgerlens.operators import importance as I
from ledgerlens.operators import monitoring as M
from ledgerlens.operators import state as ST
from ledgerlens.operators.quantiles import grouped_quantiles
from ledgerlens.plans.feature_queries import MAYBE_USER, USER
from ledgerlens.plans.registry import (
    DAY_US, EVENTS_SQL, HOUR_US, SECOND, WEEK_US, events, near, near_sql, query, table,
)
from ledgerlens.sources.tables import scored_log_rows

# --- ranking metrics: purchases scored by a bounded function of their value ---

CURVE_SQL = f"""
WITH e AS ({EVENTS_SQL}), g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM e GROUP BY 1),
c AS (SELECT score AS threshold, pos, neg, coalesce(sum(pos) OVER w, 0) AS pb, coalesce(sum(neg) OVER w, 0) AS nb,
      sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g
      WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT threshold, (p - pb) / (p - pb + n - nb) AS precision, (p - pb) / p AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM r)"""


def sweep_sql(thresholds: list[float]) -> str:
    values = ", ".join(f"({t})" for t in thresholds)
    return CURVE_SQL + f""",
a AS (SELECT sum(pos * (nb + neg / 2)) / any_value(p * n) AS auc, sum(pos / p * ((p - pb) / (p - pb + n - nb))) AS ap FROM c),
t AS (SELECT CAST(col0 AS DOUBLE) AS tau FROM (VALUES {values})),
m AS (SELECT tau, count(*) FILTER (score >= tau AND label = 1) AS tp, count(*) FILTER (score >= tau AND label = 0) AS fp,
      sum(label) AS p, count(*) AS n FROM e, t GROUP BY 1)
SELECT round(auc, 4) AS auc_roc, round(ap, 4) AS auc_pr, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 4) AS precision,
       round(tp / p, 4) AS recall, round(2 * tp / (tp + fp + p), 4) AS f1, round(tau, 4) AS threshold,
       round((tp + fp) / n, 4) AS predicted_fraud_rate, round(p / n, 4) AS actual_fraud_rate
FROM m, a"""


@query("a15_confusion_metrics", sweep_sql([0.97]))
def a15_confusion_metrics(spark, sf_dir):
    return V.evaluate(events(spark, sf_dir), "label", "score", 0.97)


@query("a16_roc_auc", CURVE_SQL + f" SELECT {near_sql('sum(pos * (nb + neg / 2)) / any_value(p * n)')} AS auc_roc FROM c")
def a16_roc_auc(spark, sf_dir):
    return V.evaluate(events(spark, sf_dir), "label", "score", digits=12).select(near("auc_roc").alias("auc_roc"))


@query("a17_average_precision", CURVE_SQL + f" SELECT {near_sql('sum(pos / p * ((p - pb) / (p - pb + n - nb)))')} AS auc_pr FROM c")
def a17_average_precision(spark, sf_dir):
    return V.evaluate(events(spark, sf_dir), "label", "score", digits=12).select(near("auc_pr").alias("auc_pr"))


@query("a18_precision_recall_curve", CURVE_SQL + f" SELECT {near_sql('threshold', 9)} AS threshold, {near_sql('precision')} AS precision, {near_sql('recall')} AS recall, {near_sql('f1')} AS f1 FROM f")
def a18_precision_recall_curve(spark, sf_dir):
    curve = V.precision_recall_curve(events(spark, sf_dir), "label", "score")
    return curve.select(near("threshold", 9).alias("threshold"), *[near(c).alias(c) for c in ("precision", "recall", "f1")])


@query("a18_precision_recall_curve_ties", f"""
WITH l AS (SELECT quality AS label, round(n_chars / 1000) AS score FROM documents JOIN labels USING (doc_id)),
t AS (SELECT DISTINCT score AS threshold FROM l),
m AS (SELECT threshold, sum(label) FILTER (score >= threshold) AS tp, count(*) FILTER (score >= threshold) AS flagged, sum(label) AS p FROM l, t GROUP BY 1)
SELECT threshold, {near_sql('tp / flagged')} AS precision, {near_sql('tp / p')} AS recall FROM m""")
def a18_precision_recall_curve_ties(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.round(F.col("n_chars") / 1000).alias("score"))
    df = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    curve = V.precision_recall_curve(df, "quality", "score")
    return curve.select("threshold", near("precision").alias("precision"), near("recall").alias("recall"))


@query("a19_threshold_f1", CURVE_SQL + f" SELECT {near_sql('threshold', 9)} AS threshold FROM f ORDER BY f1 DESC, f.threshold LIMIT 1")
def a19_threshold_f1(spark, sf_dir):
    return V.optimal_threshold(events(spark, sf_dir), "label", "score").select(near("threshold", 9).alias("threshold"))


@query("a19_threshold_recall_constrained", CURVE_SQL + f" SELECT {near_sql('threshold', 9)} AS threshold FROM f WHERE recall >= 0.6 ORDER BY precision DESC, f.threshold LIMIT 1")
def a19_threshold_recall_constrained(spark, sf_dir):
    best = V.optimal_threshold(events(spark, sf_dir), "label", "score", "recall_constrained", 0.6)
    return best.select(near("threshold", 9).alias("threshold"))


@query("a20_threshold_sweep", sweep_sql(SWEEP_THRESHOLDS))
def a20_threshold_sweep(spark, sf_dir):
    return V.threshold_sweep(events(spark, sf_dir), "label", "score")


# --- gates: event types stand for runs; one run lacks a metric ---

RUNS_SQL = f"""
WITH e AS ({EVENTS_SQL}),
r AS (SELECT event_type AS run_id, avg(CAST(value > 8 AS INT)) AS auc_roc, avg(CAST(value > 45 AS INT)) AS auc_pr,
      avg(CAST(value > 25 AS INT)) AS recall, CASE WHEN event_type <> 'error' THEN avg(CAST(value > 60 AS INT)) END AS precision FROM e GROUP BY 1)"""
GATES_SQL = RUNS_SQL + """,
g AS (SELECT run_id, 'auc_roc' AS metric, 0.85 AS required, auc_roc AS actual FROM r UNION ALL SELECT run_id, 'auc_pr', 0.4, auc_pr FROM r
      UNION ALL SELECT run_id, 'recall', 0.6, recall FROM r UNION ALL SELECT run_id, 'precision', 0.3, precision FROM r)"""


def runs(spark, sf_dir):
    def share(bound):
        return F.avg((F.col("value") > bound).cast("int"))

    return events(spark, sf_dir).groupBy(F.col("event_type").alias("run_id")).agg(
        share(8).alias("auc_roc"), share(45).alias("auc_pr"), share(25).alias("recall"),
        F.when(F.col("event_type") != "error", share(60)).alias("precision"),
    )


def run_metrics(spark, sf_dir):
    wide = runs(spark, sf_dir)
    return wide.unpivot("run_id", ["auc_roc", "auc_pr", "recall", "precision"], "metric", "value").where("value is not null")


@query("a29_quality_gates", GATES_SQL + f"""
SELECT run_id, metric, CAST(required AS DOUBLE) AS required, {near_sql('actual')} AS actual, coalesce(actual >= required, FALSE) AS passed,
       CASE WHEN actual IS NULL THEN 'metric not found in run' END AS reason FROM g""")
def a29_quality_gates(spark, sf_dir):
    gates = V.check_gates(run_metrics(spark, sf_dir), digits=9)
    return gates.withColumn("actual", near("actual"))


@query("a29_promotion", GATES_SQL + """
SELECT run_id, bool_and(coalesce(actual >= required, FALSE)) AS all_passed,
       coalesce(string_agg(metric, ', ' ORDER BY metric) FILTER (NOT coalesce(actual >= required, FALSE)), '') AS failed
FROM g GROUP BY 1""")
def a29_promotion(spark, sf_dir):
    return V.promotion(run_metrics(spark, sf_dir))


@query("a30_champion", RUNS_SQL + f" SELECT run_id, {near_sql('auc_pr')} AS auc_pr FROM r ORDER BY r.auc_pr DESC, run_id LIMIT 1")
def a30_champion(spark, sf_dir):
    return V.champion(runs(spark, sf_dir).select("run_id", "auc_pr")).withColumn("auc_pr", near("auc_pr"))


@query("a30_newest_version", "SELECT o_orderstatus, CAST(max(o_orderkey) AS VARCHAR) AS version FROM orders GROUP BY 1")
def a30_newest_version(spark, sf_dir):
    versions = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_orderkey").cast("string").alias("version"))
    return V.newest_version(versions, "o_orderstatus")


CONTRIBUTIONS = {"l_quantity": "l_quantity - 25", "l_discount": "l_discount - 0.05", "l_tax": "l_tax - 0.04"}


@query("a28_feature_importance", f"""
WITH m AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, avg(abs({c})) AS m FROM lineitem" for f, c in CONTRIBUTIONS.items())})
SELECT feature, {near_sql('m')} AS mean_abs_contribution, row_number() OVER (ORDER BY m DESC) AS rank FROM m""")
def a28_feature_importance(spark, sf_dir):
    contributions = table(spark, sf_dir, "lineitem").select(*[F.expr(c).alias(f) for f, c in CONTRIBUTIONS.items()])
    return I.importance(contributions, list(CONTRIBUTIONS)).select(
        "feature", near("mean_abs_contribution").alias("mean_abs_contribution"), F.col("rank").cast("long").alias("rank")
    )


# --- drift: first against second half of the month; values grow in the second half ---

MIDDLE = 1_705_363_200 * SECOND  # 2024-01-16
DRIFT_FEATURES = ["value", "grown", "hour_of_day", "user_id", "is_night", "often_null"]
DRIFT_FRAME_SQL = f"""
WITH e AS ({EVENTS_SQL}),
x AS (SELECT t >= {MIDDLE} AS late, label, value, CASE WHEN t >= {MIDDLE} THEN value * 2 ELSE value END AS grown,
      (t // {HOUR_US}) % 24 AS hour_of_day, user_id, CAST((t // {HOUR_US}) % 24 >= 23 OR (t // {HOUR_US}) % 24 <= 5 AS INT) AS is_night,
      CASE WHEN event_type = 'view' THEN value END AS often_null FROM e)"""


def drift_frame(spark, sf_dir):
    t, value = F.col("t"), F.col("value")
    late, hour = t >= MIDDLE, S.hour_of_day(t, SECOND)
    df = events(spark, sf_dir).select(
        "label", "value", F.when(late, value * 2).otherwise(value).alias("grown"), hour.alias("hour_of_day"),
        "user_id", S.is_night(hour).alias("is_night"), F.when(F.col("event_type") == "view", value).alias("often_null"),
        late.alias("late"),
    )
    return df.where(~F.col("late")).drop("late"), df.where("late").drop("late")


def psi_sql(features: list[str]) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, late, CAST({f} AS DOUBLE) AS v FROM x WHERE {f} IS NOT NULL" for f in features
    )
    qs = ", ".join(str(i / 10) for i in range(11))
    return DRIFT_FRAME_SQL + f""",
l AS ({long}),
q AS (SELECT feature, quantile_cont(v, [{qs}]) AS q, count(*) AS ne FROM l WHERE NOT late GROUP BY 1),
u AS (SELECT feature, unnest(list_distinct(q)) AS edge, ne FROM q),
d AS (SELECT feature, edge AS lo, lead(edge) OVER (PARTITION BY feature ORDER BY edge) AS hi,
      row_number() OVER (PARTITION BY feature ORDER BY edge) AS i, count(*) OVER (PARTITION BY feature) AS edges, ne FROM u),
b AS (SELECT * FROM d WHERE hi IS NOT NULL),
k AS (SELECT b.feature, i, count(*) FILTER (NOT late) AS e, count(*) FILTER (late) AS a FROM b JOIN l
      ON l.feature = b.feature AND v >= lo AND (v < hi OR (v = hi AND i = edges - 1)) GROUP BY 1, 2),
z AS (SELECT feature, greatest(e / sum(e) OVER (PARTITION BY feature), 0.0001) AS pe,
      greatest(a / sum(a) OVER (PARTITION BY feature), 0.0001) AS pa FROM k),
s AS (SELECT feature, sum((pa - pe) * ln(pa / pe)) AS raw FROM z GROUP BY 1),
c AS (SELECT feature, count(*) FILTER (NOT late) AS ne, count(*) FILTER (late) AS na FROM l GROUP BY 1),
p AS (SELECT c.feature, CASE WHEN ne >= 10 AND na >= 10 AND (SELECT max(edges) FROM d WHERE d.feature = c.feature) >= 3
      THEN coalesce(raw, 0.0) ELSE 0.0 END AS psi FROM c LEFT JOIN s USING (feature))"""


@query("a21_psi", psi_sql(["value"]) + f" SELECT feature, {near_sql('psi')} AS psi FROM p")
def a21_psi(spark, sf_dir):
    before, after = drift_frame(spark, sf_dir)
    return D.psi_table(before, after, ["value"]).select("feature", near("psi").alias("psi"))


@query("a22_feature_drift", psi_sql(DRIFT_FEATURES) + """
SELECT feature, round(psi, 4) AS psi, CASE WHEN psi >= 0.25 THEN 'CRITICAL' WHEN psi >= 0.1 THEN 'WARNING' ELSE 'OK' END AS status FROM p""")
def a22_feature_drift(spark, sf_dir):
    before, after = drift_frame(spark, sf_dir)
    return D.feature_drift(before, after, [*DRIFT_FEATURES, "absent"])


LABEL_DRIFT_SQL = DRIFT_FRAME_SQL + """,
y AS (SELECT round(avg(label) FILTER (NOT late), 4) AS b, round(avg(label) FILTER (late), 4) AS p FROM x)"""


@query("a23_label_drift", LABEL_DRIFT_SQL + """
SELECT b AS baseline_fraud_rate, p AS production_fraud_rate, round(abs(p - b), 4) AS absolute_change, abs(p - b) > 0.05 AS drifted FROM y""")
def a23_label_drift(spark, sf_dir):
    return D.label_drift(*drift_frame(spark, sf_dir), label="label")


@query("a24_drift_decision", psi_sql(DRIFT_FEATURES) + """,
y AS (SELECT round(avg(label) FILTER (NOT late), 4) AS b, round(avg(label) FILTER (late), 4) AS p, count(*) FILTER (NOT late) AS nb,
      count(*) FILTER (late) AS np FROM x),
j AS (SELECT count(*) AS total, count(*) FILTER (psi < 0.1) AS ok, count(*) FILTER (psi >= 0.1 AND psi < 0.25) AS warning,
      count(*) FILTER (psi >= 0.25) AS critical FROM p)
SELECT np < 500 AS skipped, CASE WHEN np >= 500 THEN total END AS total_features, CASE WHEN np >= 500 THEN ok END AS ok,
       CASE WHEN np >= 500 THEN warning END AS warning, CASE WHEN np >= 500 THEN critical END AS critical,
       CASE WHEN np >= 500 THEN round(critical / total, 4) END AS drift_fraction, CASE WHEN np >= 500 THEN nb END AS baseline_rows,
       np AS production_rows, np >= 500 AND (critical / total >= 0.15 OR abs(p - b) > 0.05) AS should_retrain,
       CASE WHEN np < 500 THEN 'Insufficient production data (' || np || ' < 500)'
            WHEN critical / total >= 0.15 THEN critical || '/' || total || ' features  (' || round(100 * critical / total)::INT || '%) exceeded critical PSI threshold'
            ELSE 'No significant drift detected' END AS reason
FROM j, y""")
def a24_drift_decision(spark, sf_dir):
    before, after = drift_frame(spark, sf_dir)
    return D.drift_decision(before, after, DRIFT_FEATURES, "label", fraction=0.15)


@query("a21_quantiles_per_group", f"""
SELECT event_type, {near_sql('quantile_cont(value, 0.5)')} AS p50, {near_sql('quantile_cont(value, 0.95)')} AS p95 FROM events GROUP BY 1""")
def a21_quantiles_per_group(spark, sf_dir):
    found = grouped_quantiles(events(spark, sf_dir), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    return found.select("event_type", near("p50").alias("p50"), near("p95").alias("p95"))


# --- entity state as tables ---

@query("a26_entity_stats", f"""
WITH e AS ({EVENTS_SQL}), s AS (SELECT user_id, count(*) AS n, sum(value) AS amt_sum, sum(value * value) AS amt_sum_sq, avg(value) AS mean,
  stddev_samp(value) AS std, min(t) AS first_seen, max(t) AS last_seen FROM e GROUP BY 1)
SELECT user_id, n, {near_sql('amt_sum', 4)} AS amt_sum, {near_sql('amt_sum_sq', 3)} AS amt_sum_sq, {near_sql('mean', 4)} AS mean,
       {near_sql('std', 4)} AS std, first_seen, last_seen FROM s""")
def a26_entity_stats(spark, sf_dir):
    return ST.entity_stats(events(spark, sf_dir), USER).select(
        "user_id", "n", near("amt_sum", 4).alias("amt_sum"), near("amt_sum_sq", 3).alias("amt_sum_sq"),
        near("mean", 4).alias("mean"), near("std", 4).alias("std"), "first_seen", "last_seen",
    )


@query("a26_deviation_from_stats", f"""
WITH e AS ({EVENTS_SQL}), s AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS d FROM e WHERE label = 0 GROUP BY 1)
SELECT event_id, {near_sql('value - m', 4)} AS u_deviation, CASE WHEN d > 0 THEN {near_sql('(value - m) / d', 4)} ELSE 0.0 END AS u_zscore
FROM e LEFT JOIN s USING (user_id)""")
def a26_deviation_from_stats(spark, sf_dir):
    df = events(spark, sf_dir)
    stats = ST.entity_stats(df.where("label = 0"), USER)
    out = ST.deviation_from_stats(df, stats, USER, "u", stats.count())
    zscore = F.when(F.col("u_zscore") == 0, 0.0).otherwise(near("u_zscore", 4))
    return out.select("event_id", near("u_deviation", 4).alias("u_deviation"), zscore.alias("u_zscore"))


@query("a27_state_bootstrap", f"""
WITH e AS ({EVENTS_SQL}), s AS (SELECT *, max(t) OVER (PARTITION BY maybe_user) AS last FROM e WHERE maybe_user IS NOT NULL)
SELECT event_id, maybe_user, t, value FROM s WHERE t > last - {WEEK_US}""")
def a27_state_bootstrap(spark, sf_dir):
    _, recent = ST.bootstrap_state(events(spark, sf_dir), MAYBE_USER)
    return recent.select("event_id", "maybe_user", "t", "value")


@query("t7_stream_seed", f"""
WITH e AS ({EVENTS_SQL}), s AS (SELECT *, max(t) OVER w AS last, min(t) OVER w AS first_seen, count(*) OVER w AS n, avg(value) OVER w AS mean
  FROM e WHERE maybe_user IS NOT NULL WINDOW w AS (PARTITION BY maybe_user))
SELECT 'user' AS entity_type, CAST(maybe_user AS VARCHAR) AS entity_id, t, count(*) AS rows, {near_sql('sum(value)')} AS amount_sum, any_value(n) AS n,
       {near_sql('any_value(mean)', 4)} AS mean, any_value(first_seen) AS first_seen, any_value(last) AS last_seen
FROM s WHERE t > last - {WEEK_US} GROUP BY maybe_user, t""")
def t7_stream_seed(spark, sf_dir):
    return ST.seed_rows(events(spark, sf_dir), {"user": MAYBE_USER}).select(
        "entity_type", "entity_id", "t", "rows", near("amount_sum").alias("amount_sum"), "n", near("mean", 4).alias("mean"),
        "first_seen", "last_seen",
    )


# --- monitoring: events stand for the prediction log ---

LOG_SQL = f"""
SELECT epoch_us(ts) AS t, event_type AS endpoint, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status, value / 100 AS latency,
       value / (50 + value) AS score, value > 80 AS flagged,
       CASE WHEN value / (50 + value) < 0.3 THEN 'LOW' WHEN value / (50 + value) < 0.5 THEN 'MEDIUM' WHEN value / (50 + value) < 0.8 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level,
       CASE WHEN event_type = 'error' THEN CASE WHEN value > 50 THEN 'timeout' ELSE 'invalid' END END AS error_type, user_id AS batch_id,
       CASE WHEN event_type = 'click' THEN 'unknown' ELSE CAST(user_id AS VARCHAR) END AS model_version
FROM events"""
FIVE = 300 * SECOND


def prediction_log(spark, sf_dir):
    df, value = table(spark, sf_dir, "events"), F.col("value")
    score = value / (50 + value)
    return df.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status"), (value / 100).alias("latency"),
        score.alias("score"), (value > 80).alias("flagged"), S.risk_level(score).alias("risk_level"),
        F.when(F.col("event_type") == "error", F.when(value > 50, "timeout").otherwise("invalid")).alias("error_type"),
        F.col("user_id").alias("batch_id"),
        F.when(F.col("event_type") == "click", "unknown").otherwise(F.col("user_id").cast("string")).alias("model_version"),
    )


def starts(df):
    """Window starts as seconds, so that both engines compare integers."""
    return df.withColumn("window_start", F.unix_seconds("window_start"))


def bucket(width: int) -> str:
    return f"CAST((t // {width}) * {width} // {SECOND} AS BIGINT)"


@query("t10_request_rate", f"WITH p AS ({LOG_SQL}) SELECT {bucket(FIVE)} AS window_start, endpoint, status, count(*) AS requests FROM p GROUP BY ALL")
def t10_request_rate(spark, sf_dir):
    return starts(M.request_rate(prediction_log(spark, sf_dir)))


@query("t11_latency_quantiles", f"""
WITH p AS ({LOG_SQL})
SELECT {bucket(DAY_US)} AS window_start, endpoint, {near_sql('quantile_cont(latency, 0.5)')} AS p50, {near_sql('quantile_cont(latency, 0.95)')} AS p95,
       {near_sql('quantile_cont(latency, 0.99)')} AS p99 FROM p GROUP BY 1, 2""")
def t11_latency_quantiles(spark, sf_dir):
    found = starts(M.latency_quantiles(prediction_log(spark, sf_dir), width="1 day"))
    return found.select("window_start", "endpoint", *[near(c).alias(c) for c in ("p50", "p95", "p99")])


@query("t12_flag_rate", f"""
WITH p AS ({LOG_SQL})
SELECT {bucket(FIVE)} AS window_start, endpoint, count(*) FILTER (flagged) AS flagged, count(*) AS requests, {near_sql('count(*) FILTER (flagged) / count(*)')} AS flag_rate
FROM p GROUP BY 1, 2""")
def t12_flag_rate(spark, sf_dir):
    return starts(M.flag_rate(prediction_log(spark, sf_dir))).withColumn("flag_rate", near("flag_rate"))


@query("t13_score_histogram", f"""
WITH p AS ({LOG_SQL}), b AS (SELECT CAST(col0 AS DOUBLE) AS le FROM (VALUES {', '.join(f'({b})' for b in SCORE_BUCKETS)}))
SELECT {bucket(DAY_US)} AS window_start, endpoint, le, count(*) FILTER (score <= le) AS scores FROM p, b GROUP BY 1, 2, 3""")
def t13_score_histogram(spark, sf_dir):
    return starts(M.score_histogram(prediction_log(spark, sf_dir), width="1 day"))


@query("t13_score_quantiles", f"""
WITH p AS ({LOG_SQL})
SELECT {bucket(DAY_US)} AS window_start, endpoint, {near_sql('quantile_cont(score, 0.5)')} AS p50, {near_sql('quantile_cont(score, 0.9)')} AS p90,
       {near_sql('quantile_cont(score, 0.99)')} AS p99 FROM p GROUP BY 1, 2""")
def t13_score_quantiles(spark, sf_dir):
    found = starts(M.score_quantiles(prediction_log(spark, sf_dir), width="1 day"))
    return found.select("window_start", "endpoint", *[near(c).alias(c) for c in ("p50", "p90", "p99")])


@query("t14_sliding_totals", f"""
WITH p AS ({LOG_SQL}),
l AS (SELECT t, 'requests' AS metric, endpoint AS label FROM p UNION ALL SELECT t, 'flagged', risk_level FROM p WHERE flagged
      UNION ALL SELECT t, 'errors', error_type FROM p WHERE error_type IS NOT NULL),
s AS (SELECT t // {FIVE} AS step, metric, label, count(*) AS n FROM l GROUP BY ALL)
SELECT CAST((step - i) * 300 AS BIGINT) AS window_start, metric, label, CAST(sum(n) AS BIGINT) AS total FROM s, range(12) r(i) GROUP BY 1, 2, 3""")
def t14_sliding_totals(spark, sf_dir):
    return starts(M.operations_totals(prediction_log(spark, sf_dir)))


@query("t15_batch_size_histogram", f"""
WITH p AS ({LOG_SQL}), s AS (SELECT batch_id, count(*) AS n FROM p GROUP BY 1),
b AS (SELECT CAST(col0 AS BIGINT) AS le FROM (VALUES {', '.join(f'({b})' for b in BATCH_SIZE_BUCKETS)}))
SELECT le, count(*) FILTER (n <= le) AS batches FROM s, b GROUP BY 1""")
def t15_batch_size_histogram(spark, sf_dir):
    return M.batch_size_histogram(prediction_log(spark, sf_dir))


@query("t15_latest_model_version", f"WITH p AS ({LOG_SQL}) SELECT coalesce(TRY_CAST(arg_max(model_version, t) AS DOUBLE), -1.0) AS model_version FROM p")
def t15_latest_model_version(spark, sf_dir):
    return M.latest_model_version(prediction_log(spark, sf_dir))


@query("a25_scoring_summary", f"""
WITH p AS ({LOG_SQL}), r AS (SELECT CASE WHEN status = '200' THEN score END AS pr, CASE WHEN status = '200' THEN flagged END AS fl FROM p)
SELECT count(*) AS total_rows, count(pr) AS successfully_scored, count(*) FILTER (pr IS NULL) AS errors, count(*) FILTER (fl) AS flagged_as_fraud,
       round(count(*) FILTER (fl) / count(pr), 4) AS fraud_rate FROM r""")
def a25_scoring_summary(spark, sf_dir):
    good = F.col("status") == "200"
    results = prediction_log(spark, sf_dir).select(
        F.when(good, F.col("score")).alias("fraud_probability"), F.when(good, F.col("flagged")).alias("is_fraud"),
        F.when(good, F.col("risk_level")).otherwise("ERROR").alias("risk_level"),
    )
    return M.scoring_summary(results)


@query("f12_reason_strings", f"""
WITH e AS ({EVENTS_SQL}), s AS (SELECT event_type, count(*) FILTER (value > 80) AS k, count(*) AS n, avg(label) AS r FROM e GROUP BY 1),
t AS (SELECT event_type, concat_ws(' AND ', CASE WHEN k * 5 >= n THEN k || '/' || n || ' features  (' || round(100 * k / n)::INT || '%) exceeded critical PSI threshold' END,
       CASE WHEN r > 0.05 THEN 'Target fraud rate shifted by ' || printf('%.4f', r) END) AS reason FROM s)
SELECT event_type, CASE WHEN reason = '' THEN 'No significant drift detected' ELSE reason END AS reason FROM t""")
def f12_reason_strings(spark, sf_dir):
    """The texts of the retraining decision, for the counts and rates of every event type."""
    s = events(spark, sf_dir).groupBy("event_type").agg(
        F.count_if(F.col("value") > 80).alias("k"), F.count(F.lit(1)).alias("n"), F.avg("label").alias("r")
    )
    k, n, r = F.col("k"), F.col("n"), F.col("r")
    return s.select("event_type", D.decision_reason(k * 5 >= n, k, n, r > 0.05, r).alias("reason"))


@query("f9_rounding", f"""
WITH e AS ({EVENTS_SQL}) SELECT event_id, round(score, 6) + 0.0 AS fraud_probability, {near_sql('score')} AS six, {near_sql('score', 4)} AS four FROM e""")
def f9_rounding(spark, sf_dir):
    """Probabilities as the scored log holds them, and at six and four places."""
    scored = events(spark, sf_dir).select("event_id", F.col("score").alias("fraud_probability"), near("score").alias("six"), near("score", 4).alias("four"))
    return scored_log_rows(scored).select("event_id", "fraud_probability", "six", "four")
