"""Registered queries: sources, sinks, projections, joins, quality, sets."""

from __future__ import annotations

from pyspark.sql import functions as F


from ledgerlens.functions import scalars as S
from ledgerlens.operators import align as A
from ledgerlens.operators import encoding as E
from ledgerlens.operators import joins as J
from ledgerlens.operators import quality as Q
from ledgerlens.operators import training_set as R
from ledgerlens.operators.drift import drift_decision, feature_drift
from ledgerlens.plans.metric_queries import drift_frame, psi_sql
from ledgerlens.plans.registry import (
    DAY_US, EVENTS_SQL, ORDERS_SQL, SECOND, events, near, near_sql, orders, query, table,
)
from ledgerlens.scratch import scratch_path
from ledgerlens.sources import contract as C
from ledgerlens.sources import tables as IO

CUSTOMER_SCHEMA = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("s1_csv_scan", "SELECT * FROM customer")
def s1_csv_scan(spark, sf_dir):
    path = scratch_path(spark, "customer-csv")
    IO.write_any(table(spark, sf_dir, "customer"), path)
    return IO.read_csv(spark, path, CUSTOMER_SCHEMA)


@query("s2_parquet_projection", "SELECT l_orderkey, l_quantity FROM lineitem")
def s2_parquet_projection(spark, sf_dir):
    return IO.read_parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("s3_format_by_suffix", "SELECT c_custkey, c_acctbal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def s3_format_by_suffix(spark, sf_dir):
    path = scratch_path(spark, "supplier") + ".csv"
    IO.write_any(table(spark, sf_dir, "supplier"), path)
    left = IO.read_any(spark, f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")
    right = IO.read_any(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    return left.union(right.select("s_suppkey", "s_acctbal"))


# errors come without an id, and small or zero amounts turn negative or zero
INCOMING_SQL = f"""
WITH e AS ({EVENTS_SQL}), i AS (SELECT event_id AS rid, CASE WHEN event_type <> 'error' THEN event_id END AS id,
     CASE WHEN event_type = 'click' THEN -1 ELSE t END AS t, CASE WHEN value > 5 THEN value WHEN value > 1 THEN 1 - value END AS amount FROM e)"""


@query("s5_contract_split", INCOMING_SQL + """
SELECT rid, concat_ws('; ', CASE WHEN id IS NULL THEN 'id missing' END, CASE WHEN amount IS NULL THEN 'amount missing' END,
       CASE WHEN amount <= 0 THEN 'amount must be positive' END, CASE WHEN t < 0 THEN 't must be non-negative' END) AS reason
FROM i""")
def s5_contract_split(spark, sf_dir):
    value, kind = F.col("value"), F.col("event_type")
    incoming = events(spark, sf_dir).select(
        F.col("event_id").alias("rid"), F.when(kind != "error", F.col("event_id")).alias("id"),
        F.when(kind == "click", F.lit(-1).cast("long")).otherwise(F.col("t")).alias("t"),
        F.when(value > 5, value).when(value > 1, 1 - value).alias("amount"),
    )
    valid, rejected = C.split_valid(incoming, "id", "t", "amount")
    return valid.select("rid", F.lit("").alias("reason")).unionByName(rejected.select("rid", "reason"))


@query("s6_batch_contract", """
SELECT count(*) AS rows, 0 AS repeated_ids, CASE WHEN count(*) > 10000 THEN 'batch has more than 10000 rows' END AS reason,
       count(*) <= 10000 AS accepted FROM customer""")
def s6_batch_contract(spark, sf_dir):
    return C.check_batch(table(spark, sf_dir, "customer"), "c_custkey")


@query("s6_batch_contract_repeats", """
SELECT sum(n)::BIGINT AS rows, count(*) FILTER (n > 1) AS repeated_ids, CASE WHEN sum(n) > 100000000 THEN 'batch has more than 100000000 rows'
       WHEN count(*) FILTER (n > 1) > 0 THEN 'ids in a batch must be unique' END AS reason, count(*) FILTER (n > 1) = 0 AS accepted
FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""")
def s6_batch_contract_repeats(spark, sf_dir):
    return C.check_batch(table(spark, sf_dir, "orders"), "o_custkey", limit=100_000_000)


@query("k1_feature_table_overwrite", "SELECT o_orderkey, o_totalprice FROM orders")
def k1_feature_table_overwrite(spark, sf_dir):
    path = scratch_path(spark, "features")
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    IO.write_table(df.where("o_totalprice > 100000"), path)
    IO.write_table(df, path)
    return spark.read.parquet(path)


@query("k2_scored_output_by_suffix", "SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_totalprice FROM orders")
def k2_scored_output_by_suffix(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    columnar, text = scratch_path(spark, "scored") + ".parquet", scratch_path(spark, "scored") + ".csv"
    IO.write_any(df, columnar)
    IO.write_any(df, text)
    return IO.read_any(spark, columnar).unionByName(IO.read_any(spark, text, df.schema))


@query("k3_append_only_log", f"WITH e AS ({EVENTS_SQL}) SELECT event_id, {near_sql('score')} AS fraud_probability, CAST(t // {DAY_US} AS BIGINT) AS day FROM e")
def k3_append_only_log(spark, sf_dir):
    path = scratch_path(spark, "scored-log")
    scored = IO.scored_log_rows(events(spark, sf_dir).select("event_id", "t", near("score").alias("fraud_probability")))
    IO.append_log(scored.where("fraud_probability < 0.9"), path, "t", SECOND)
    IO.append_log(scored.where("fraud_probability >= 0.9"), path, "t", SECOND)
    return spark.read.parquet(path).select("event_id", near("fraud_probability").alias("fraud_probability"), F.col("day").cast("long").alias("day"))


@query("k4_rolling_retention", f"""
WITH e AS ({EVENTS_SQL})
SELECT event_id, t FROM e WHERE t >= (SELECT max(t) FROM e) - {20 * DAY_US}""")
def k4_rolling_retention(spark, sf_dir):
    df = events(spark, sf_dir)
    existing = df.where("event_type <> 'view'").select("event_id", "t", "value")
    new = df.where("event_type = 'view'").select("event_id", "t")
    return R.append_with_retention(existing, new, 20 * DAY_US, "t").select("event_id", "t")


@query("k5_drift_report_and_history", psi_sql(["value", "grown", "user_id"]) + f""",
feature_rows AS (SELECT feature AS name, round(psi, 4) AS psi, CASE WHEN psi >= 0.25 THEN 'CRITICAL' WHEN psi >= 0.1 THEN 'WARNING' ELSE 'OK' END AS status FROM p),
label_rates AS (SELECT round(avg(label) FILTER (NOT late), 4) AS b, round(avg(label) FILTER (late), 4) AS p, count(*) FILTER (late) AS n FROM x),
moved AS (SELECT count(*) FILTER (status = 'CRITICAL') / count(*) AS share FROM feature_rows)
SELECT 'feature' AS kind, name, psi AS value, status AS said, CAST(2 AS BIGINT) AS runs FROM feature_rows
UNION ALL SELECT 'decision', CASE WHEN n >= 500 AND (share >= 0.2 OR abs(p - b) > 0.05) THEN 'retrain' ELSE 'keep' END,
  CASE WHEN n >= 500 THEN round(share, 4) END,
  CASE WHEN n < 500 THEN 'Insufficient production data (' || n || ' < 500)' WHEN share >= 0.2 THEN
    (SELECT count(*) FILTER (status = 'CRITICAL') || '/' || count(*) || ' features  (' || round(100 * share)::INT || '%) exceeded critical PSI threshold' FROM feature_rows)
    ELSE 'No significant drift detected' END, 2 FROM label_rates, moved""")
def k5_drift_report_and_history(spark, sf_dir):
    """Two runs are reported; the features of the reports and the decisions of the history are read back."""
    folder = scratch_path(spark, "drift")
    before, after = drift_frame(spark, sf_dir)
    for _ in range(2):
        drift = feature_drift(before, after, ["value", "grown", "user_id"])
        IO.write_drift_report(drift, drift_decision(before, after, drift=drift, label="label"), folder)
    history = spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/history")
    reports = spark.read.json(f"{folder}/reports")
    runs = F.count(F.lit(1)).alias("runs")
    decided = F.when(F.col("should_retrain"), "retrain").otherwise("keep").alias("name")
    return reports.groupBy(F.lit("feature").alias("kind"), F.col("feature").alias("name"), F.col("psi").alias("value"), F.col("status").alias("said")).agg(
        runs,
    ).unionByName(history.groupBy(
        F.lit("decision").alias("kind"), decided, F.col("drift_fraction").cast("double").alias("value"), F.col("reason").alias("said")).agg(runs))


@query("k7_encoding_table_roundtrip", f"""
WITH o AS ({ORDERS_SQL}), g AS (SELECT avg(label) AS g FROM o)
SELECT 'o_orderpriority' AS "column", o_orderpriority AS category, {near_sql('(sum(label) + any_value(g)) / (count(*) + 1.0)')} AS smoothed_mean
FROM o, g GROUP BY 2""")
def k7_encoding_table_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "encodings")
    IO.write_encodings(E.encoding_table(orders(spark, sf_dir), ["o_orderpriority"], "label"), path)
    return IO.read_encodings(spark, path).select("column", "category", near("smoothed_mean").alias("smoothed_mean"))


# documents with their labels, in the roles of transactions with identity records
DOCS_SQL = "SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)"
DOC_ROLES = Q.Roles(
    row_id="doc_id", label="quality", time="n_chars", amount="n_chars", key="lang", category="source",
    side_marker="toxic", required=["doc_id", "quality", "n_chars", "lang", "source"],
)
CUSTOMER_ROLES = Q.Roles(
    row_id="c_nationkey", label="absent", time="c_custkey", amount="c_acctbal", key="c_name", category="c_mktsegment",
    side_marker="absent", required=["c_custkey", "c_phone"],
)


def documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return J.load_joined(docs, table(spark, sf_dir, "labels"), "doc_id")


@query("k9_validation_report", f"""
WITH d AS ({DOCS_SQL})
SELECT 'null_rate' AS level, 'quality' AS "check", {near_sql('avg(CAST(quality IS NULL AS INT))')} AS value FROM d
UNION ALL SELECT 'null_rate', 'toxic', {near_sql('avg(CAST(toxic IS NULL AS INT))')} FROM d
UNION ALL SELECT 'error', 'label_domain', {near_sql('count(*) FILTER (quality IS NULL)')} FROM d
UNION ALL SELECT 'info', 'columns', {near_sql('count(*)')} FROM (DESCRIBE {DOCS_SQL})
UNION ALL SELECT 'warning', 'label_rate', {near_sql('avg(quality)')} FROM d""")
def k9_validation_report(spark, sf_dir):
    path = scratch_path(spark, "validation")
    Q.validation_report(documents(spark, sf_dir), DOC_ROLES).coalesce(1).write.mode("overwrite").json(path)
    report = spark.read.json(path)
    return report.where("level <> 'ok' and value > 0").select("level", "check", near("value").alias("value"))


@query("k10_baseline_snapshot", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def k10_baseline_snapshot(spark, sf_dir):
    source, target = scratch_path(spark, "source"), scratch_path(spark, "baseline")
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    IO.write_table(df.where("o_totalprice > 100000"), source)
    R.snapshot_baseline(spark, source, target, promoted=True)
    IO.write_table(df, source)
    R.snapshot_baseline(spark, source, target, promoted=False)
    R.snapshot_baseline(spark, source + "-missing", target, promoted=True)
    return spark.read.parquet(target)


@query("p1_exclude_identifiers", "SELECT user_id, event_type, value FROM events")
def p1_exclude_identifiers(spark, sf_dir):
    return A.without_identifiers(table(spark, sf_dir, "events"), ["event_id", "ts", "props"])


@query("p2_feature_selection", f"WITH d AS ({DOCS_SQL}) SELECT n_chars, quality, toxic FROM d")
def p2_feature_selection(spark, sf_dir):
    """The texts go, and a column with too many nulls; the labelled columns stay."""
    df = documents(spark, sf_dir).withColumn("rare", F.when(F.col("n_chars") < 0, 1.0))
    return A.select_features(df, drop=["doc_id"])


@query("p3_align_to_trained_columns", "SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(NULL AS DOUBLE) AS missing, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders")
def p3_align_to_trained_columns(spark, sf_dir):
    return A.align_to_columns(table(spark, sf_dir, "orders"), ["o_totalprice", "missing", "o_custkey"], keep=["o_orderkey"])


@query("p4_align_to_table", "SELECT s_suppkey AS c_custkey, s_name AS c_name, s_nationkey AS c_nationkey, s_acctbal AS c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment FROM supplier")
def p4_align_to_table(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").toDF("c_custkey", "c_name", "c_nationkey", "c_acctbal").withColumn("extra", F.lit(1))
    return A.align_to_schema(supplier, table(spark, sf_dir, "customer").schema)


@query("p6_nan_to_null", "SELECT event_id, CASE WHEN value > 10 THEN value END AS value FROM events")
def p6_nan_to_null(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") > 10, F.col("value")).otherwise(F.lit(float("nan"))).alias("value"))
    return A.normalise_nan(df)


@query("p7_widen_integers", "SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, l_quantity, l_returnflag FROM lineitem")
def p7_widen_integers(spark, sf_dir):
    return A.widen_integers(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"))


@query("p8_decision", f"WITH e AS ({EVENTS_SQL}) SELECT event_id, score >= 0.97 AS is_fraud, {near_sql('score')} AS fraud_probability, 0.97 AS threshold_used FROM e")
def p8_decision(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id", S.decision(F.col("score"), 0.97).alias("is_fraud"), near("score").alias("fraud_probability"),
        F.round(F.lit(0.97), 4).alias("threshold_used"),
    )


@query("p9_risk_bands", f"""
WITH e AS ({EVENTS_SQL})
SELECT event_id, CASE WHEN value / 100 < 0.3 THEN 'LOW' WHEN value / 100 < 0.5 THEN 'MEDIUM' WHEN value / 100 < 0.8 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level
FROM e""")
def p9_risk_bands(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", S.risk_level(F.col("value") / 100).alias("risk_level"))


@query("p10_key_sanitising", "SELECT page_id, replace(replace(replace(url, ':', '_'), ' ', '_'), '/', '_') AS safe FROM pages")
def p10_key_sanitising(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.safe_key(F.col("url")).alias("safe"))


@query("p11_sliding_retention", f"WITH o AS ({ORDERS_SQL}) SELECT o_orderkey, t FROM o WHERE t >= (SELECT max(t) FROM o) - {180 * DAY_US}")
def p11_sliding_retention(spark, sf_dir):
    return R.keep_recent(orders(spark, sf_dir), "t", 180 * DAY_US).select("o_orderkey", "t")


@query("p12_domain_predicates", f"WITH d AS ({DOCS_SQL}) SELECT doc_id, coalesce(quality IN (0, 1), FALSE) AS known, n_chars - 500 < 0 AS negative FROM d")
def p12_domain_predicates(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", S.in_domain(F.col("quality"), [0, 1]).alias("known"), (F.col("n_chars") - 500 < 0).alias("negative")
    )


@query("j1_left_join", DOCS_SQL)
def j1_left_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return J.left_join(docs, table(spark, sf_dir, "labels"), "doc_id")


@query("j2_join_cardinality", "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j2_join_cardinality(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return J.load_joined(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), customer, "o_custkey")


@query("j3_match_rates", f"""
WITH d AS ({DOCS_SQL})
SELECT 'merged_rows' AS rate, {near_sql('avg(CAST(toxic IS NOT NULL AS INT))')} AS value FROM d
UNION ALL SELECT 'side_rows', {near_sql('avg(CAST(doc_id IN (SELECT doc_id FROM documents) AS INT))')} FROM labels""")
def j3_match_rates(spark, sf_dir):
    rates = J.match_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "toxic")
    return rates.select("rate", near("value").alias("value"))


@query("j4_attach_labels", "SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)")
def j4_attach_labels(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return J.attach_labels(scored, table(spark, sf_dir, "labels"), "doc_id", "quality")


@query("j4_attach_labels_latest", "SELECT c_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def j4_attach_labels_latest(spark, sf_dir):
    scored = table(spark, sf_dir, "customer").select("c_custkey")
    labels = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return J.attach_labels(scored, labels, "c_custkey", "o_orderstatus", dedupe_by="o_orderkey")


CHECKS_SQL = f"""
WITH d AS ({DOCS_SQL}), s AS (SELECT count(*) AS n, count(*) FILTER (quality IS NULL OR quality NOT IN (0, 1)) AS bad, avg(quality) AS rate,
  count(*) FILTER (n_chars < 0) AS neg, avg(CAST(n_chars IS NULL AS INT)) AS an, avg(CAST(lang IS NULL AS INT)) AS kn,
  avg(CAST(toxic IS NOT NULL AS INT)) AS cov, count(*) - count(DISTINCT doc_id) AS dup, count(DISTINCT source) AS card FROM d)
SELECT 'required_columns' AS "check", 'ok' AS level, 0.0 AS value FROM s
UNION ALL SELECT 'not_empty', CASE WHEN n = 0 THEN 'error' ELSE 'ok' END, n FROM s
UNION ALL SELECT 'label_domain', CASE WHEN bad > 0 THEN 'error' ELSE 'ok' END, bad FROM s
UNION ALL SELECT 'label_rate', CASE WHEN rate < 0.01 OR rate > 0.1 THEN 'warning' ELSE 'ok' END, {near_sql('rate')} FROM s
UNION ALL SELECT 'amount_sign', CASE WHEN neg > 0 THEN 'error' ELSE 'ok' END, neg FROM s
UNION ALL SELECT 'amount_nulls', CASE WHEN an > 0.05 THEN 'error' ELSE 'ok' END, {near_sql('an')} FROM s
UNION ALL SELECT 'key_nulls', CASE WHEN kn > 0.05 THEN 'warning' ELSE 'ok' END, {near_sql('kn')} FROM s
UNION ALL SELECT 'time_sign', CASE WHEN neg > 0 THEN 'error' ELSE 'ok' END, neg FROM s
UNION ALL SELECT 'join_coverage', CASE WHEN cov < 0.01 THEN 'error' ELSE 'ok' END, {near_sql('cov')} FROM s
UNION ALL SELECT 'duplicate_ids', CASE WHEN dup > 0 THEN 'error' ELSE 'ok' END, dup FROM s
UNION ALL SELECT 'category_cardinality', CASE WHEN card < 1 OR card > 20 THEN 'warning' ELSE 'ok' END, card FROM s"""


@query("a5_a11_quality_checks", CHECKS_SQL)
def a5_a11_quality_checks(spark, sf_dir):
    return Q.quality_checks(documents(spark, sf_dir), DOC_ROLES).select("check", "level", near("value").alias("value"))


NULL_RATES_SQL = " UNION ALL ".join(
    f"SELECT 'null_rate {c}', 'info', {near_sql(f'avg(CAST({c} IS NULL AS INT))')} FROM d"
    for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic"))


@query("a12_profile_merged", f"SELECT * FROM ({CHECKS_SQL}) WHERE \"check\" <> 'duplicate_ids' UNION ALL (WITH d AS ({DOCS_SQL}) {NULL_RATES_SQL})")
def a12_profile_merged(spark, sf_dir):
    """Three loads are profiled one by one; the checks of all of them come from the three stored rows."""
    docs, path = documents(spark, sf_dir), scratch_path(spark, "profiles")
    for load in range(3):
        Q.load_profile(docs.where(F.col("doc_id") % 3 == load), DOC_ROLES).write.mode("append").parquet(path)
    return Q.profile_checks(spark.read.parquet(path), DOC_ROLES).select("check", "level", near("value").alias("value"))


@query("a12_quality_suite", """
WITH s AS (SELECT count(*) AS n, count(*) FILTER (c_acctbal < 0) AS neg, count(*) - count(DISTINCT c_nationkey) AS dup FROM customer)
SELECT 'Missing required columns: [''c_phone'']' AS message FROM s
UNION ALL SELECT 'Found ' || neg || ' negative c_acctbal values' FROM s WHERE neg > 0
UNION ALL SELECT 'Found ' || dup || ' duplicate c_nationkeys' FROM s WHERE dup > 0""")
def a12_quality_suite(spark, sf_dir):
    """All error messages of a table that breaks several rules."""
    return Q.quality_checks(table(spark, sf_dir, "customer"), CUSTOMER_ROLES).where("level = 'error'").select("message")


@query("a6_duplicate_count", "SELECT count(*) - count(DISTINCT o_custkey) AS duplicates FROM orders")
def a6_duplicate_count(spark, sf_dir):
    return Q.duplicate_count(table(spark, sf_dir, "orders"), "o_custkey")


@query("a13_null_rates", f"""
WITH d AS ({DOCS_SQL})
SELECT 'doc_id' AS "column", {near_sql('avg(CAST(doc_id IS NULL AS INT))')} AS null_rate FROM d
UNION ALL SELECT 'lang', {near_sql('avg(CAST(lang IS NULL AS INT))')} FROM d
UNION ALL SELECT 'source', {near_sql('avg(CAST(source IS NULL AS INT))')} FROM d
UNION ALL SELECT 'n_chars', {near_sql('avg(CAST(n_chars IS NULL AS INT))')} FROM d
UNION ALL SELECT 'quality', {near_sql('avg(CAST(quality IS NULL AS INT))')} FROM d
UNION ALL SELECT 'toxic', {near_sql('avg(CAST(toxic IS NULL AS INT))')} FROM d""")
def a13_null_rates(spark, sf_dir):
    return A.null_rates(documents(spark, sf_dir)).select("column", near("null_rate").alias("null_rate"))


@query("a14_class_balance", f"""
SELECT quality, count(*) AS rows, {near_sql('count(*) / (SELECT count(quality) FROM labels)')} AS share FROM labels WHERE quality IS NOT NULL GROUP BY 1""")
def a14_class_balance(spark, sf_dir):
    balance = Q.class_balance(table(spark, sf_dir, "labels"), "quality")
    return balance.select("quality", "rows", near("share").alias("share"))


@query("a14_positive_weight", f"SELECT count(*) FILTER (toxic = 0) AS negatives, count(*) FILTER (toxic = 1) AS positives, {near_sql('count(*) FILTER (toxic = 0) / count(*) FILTER (toxic = 1)')} AS positive_weight FROM labels")
def a14_positive_weight(spark, sf_dir):
    return Q.positive_weight(table(spark, sf_dir, "labels"), "toxic").withColumn("positive_weight", near("positive_weight"))


@query("u1_union_all_by_name", """
SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""")
def u1_union_all_by_name(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"))
    return A.union_all(customer, supplier)


# documents are scored rows, labels arrive later; the base set holds long documents with a known label
@query("u2_training_set_refresh", """
WITH base AS (SELECT doc_id, n_chars, lang, CAST(n_chars > 3000 AS INT) AS quality FROM documents WHERE n_chars > 2000),
added AS (SELECT doc_id, n_chars, lang, quality FROM documents JOIN labels USING (doc_id)),
merged AS (SELECT * FROM base UNION ALL SELECT * FROM added)
SELECT * FROM merged WHERE n_chars >= (SELECT max(n_chars) FROM merged) - 100000""")
def u2_training_set_refresh(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    base = docs.where("n_chars > 2000").select("doc_id", "n_chars", "lang", (F.col("n_chars") > 3000).cast("int").alias("quality"))
    scored = docs.select("lang", "doc_id", "n_chars", "source")
    return R.refresh_training_set(base, scored, table(spark, sf_dir, "labels"), "doc_id", "quality", "n_chars", 100_000)


@query("u2_training_set_fallback", "SELECT doc_id, n_chars, CAST(n_chars > 3000 AS INT) AS quality FROM documents")
def u2_training_set_fallback(spark, sf_dir):
    """The labels lack the label column: the base set is returned as it is."""
    base = table(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.col("n_chars") > 3000).cast("int").alias("quality"))
    labels = table(spark, sf_dir, "labels").drop("quality")
    return R.refresh_training_set(base, base.drop("quality"), labels, "doc_id", "quality", "n_chars", 100)
