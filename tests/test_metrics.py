import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import drift, evaluation, monitoring, ordered, quantiles
from ledgerlens.operators.importance import importance
from ledgerlens.operators.quantiles import grouped_quantiles


def scores(spark, y, p):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "label int, score double").repartition(4)


def brute(y, p):
    y, p = np.asarray(y), np.asarray(p)
    pos, neg = p[y == 1], p[y == 0]
    auc = sum((a > neg).sum() + (a == neg).sum() / 2 for a in pos) / (len(pos) * len(neg))
    points = []
    for t in np.unique(p):
        flagged = p >= t
        tp = (y[flagged] == 1).sum()
        points.append((t, tp / flagged.sum(), tp / len(pos)))
    ap, last = 0.0, 0.0
    for _, precision, recall in reversed(points):
        ap += (recall - last) * precision
        last = recall
    return auc, ap, points


@pytest.fixture(scope="module", params=["distinct", "ties", "equal"])
def sample(request):
    rng = np.random.default_rng(5)
    y = (rng.random(400) < 0.2).astype(int)
    p = np.where(y == 1, rng.beta(5, 2, 400), rng.beta(1, 5, 400))
    if request.param == "ties":
        p = np.round(p, 1)
    if request.param == "equal":
        p = np.full(400, 0.5)
    return y, p


def test_metrics_and_curve(spark, sample):
    y, p = sample
    df = scores(spark, y, p)
    auc, ap, points = brute(y, p)
    curve = evaluation.score_curve(df, "label", "score", rows_per_slice=30)
    got = evaluation.evaluate(df, "label", "score", 0.5, digits=12, curve=curve).first()
    assert got["auc_roc"] == pytest.approx(auc) and got["auc_pr"] == pytest.approx(ap)
    flagged = p >= 0.5
    assert got["recall"] == pytest.approx((y[flagged] == 1).sum() / y.sum())
    rows = evaluation.precision_recall_curve(df, "label", "score", curve).orderBy("threshold").collect()
    assert [(r.threshold, r.precision, r.recall) for r in rows] == [pytest.approx(q) for q in points]
    best = max(points, key=lambda q: (2 * q[1] * q[2] / (q[1] + q[2]) if q[1] + q[2] else 0, -q[0]))
    assert evaluation.optimal_threshold(df, "label", "score").first()[0] == pytest.approx(best[0])
    reach = [q for q in points if q[2] >= 0.6]
    best = max(reach, key=lambda q: (q[1], -q[0]))
    assert evaluation.optimal_threshold(df, "label", "score", "recall_constrained", 0.6).first()[0] == pytest.approx(best[0])


def test_unreachable_recall_falls_back(spark):
    df = scores(spark, [0, 1, 1, 0], [0.1, 0.8, 0.9, 0.2])
    f1 = evaluation.optimal_threshold(df, "label", "score").first()[0]
    assert evaluation.optimal_threshold(df, "label", "score", "recall_constrained", 1.5).first()[0] == f1
    assert evaluation.optimal_threshold(df.limit(0), "label", "score").first()[0] == 0.5
    with pytest.raises(ValueError):
        evaluation.optimal_threshold(df, "label", "score", "best")


def test_one_class_is_an_error(spark):
    with pytest.raises(ValueError):
        evaluation.evaluate(scores(spark, [1, 1], [0.1, 0.2]), "label", "score")


def test_sweep(spark):
    df = scores(spark, [0, 1, 1, 0], [0.15, 0.85, 0.55, 0.25])
    rows = evaluation.threshold_sweep(df, "label", "score").orderBy("threshold").collect()
    assert len(rows) == 9 and rows[0]["recall"] == 1.0 and rows[-1]["precision"] == 0.0


def test_gates(spark):
    def run(name, **metrics):
        return [(name, k, v) for k, v in metrics.items()]

    rows = run("good", auc_roc=0.91, auc_pr=0.55, recall=0.65, precision=0.45)
    rows += run("one", auc_roc=0.91, auc_pr=0.35, recall=0.65, precision=0.45)
    rows += run("missing", auc_roc=0.91, recall=0.65, precision=0.45)
    rows += run("boundary", auc_roc=0.85, auc_pr=0.40, recall=0.60, precision=0.30)
    rows += run("bad", auc_roc=0.5, auc_pr=0.03, recall=0.1, precision=0.04)
    df = spark.createDataFrame(rows, "run_id string, metric string, value double")
    got = {r.run_id: (r.all_passed, r.failed) for r in evaluation.promotion(df).collect()}
    assert got == {
        "good": (True, ""), "one": (False, "auc_pr"), "missing": (False, "auc_pr"), "boundary": (True, ""),
        "bad": (False, "auc_pr, auc_roc, precision, recall"),
    }
    reason = evaluation.check_gates(df).where("run_id = 'missing' and metric = 'auc_pr'").first()["reason"]
    assert reason == "metric not found in run"


def psi_by_numpy(expected, actual):
    expected, actual = expected[~np.isnan(expected)], actual[~np.isnan(actual)]
    if len(expected) < 10 or len(actual) < 10:
        return 0.0
    edges = np.unique(np.percentile(expected, np.linspace(0, 100, 11)))
    if len(edges) < 3:
        return 0.0
    e, a = (np.histogram(v, edges)[0] for v in (expected, actual))
    e, a = np.maximum(e / e.sum(), 1e-4), np.maximum(a / a.sum(), 1e-4)
    return float(np.sum((a - e) * np.log(a / e)))


RNG = np.random.default_rng(42)
PSI_CASES = {
    "same": (RNG.normal(0, 1, 2000),) * 2,
    "slight": (RNG.normal(0, 1, 2000), RNG.normal(0.05, 1, 1000)),
    "shift": (RNG.normal(0, 1, 2000), RNG.normal(3, 1, 1000)),
    "moderate": (RNG.normal(0, 1, 2000), RNG.normal(0.5, 1.2, 2000)),
    "inside": (RNG.uniform(0, 100, 2000), RNG.uniform(10, 90, 1000)),
    "nulls": (np.where(RNG.random(500) < 0.3, np.nan, RNG.normal(0, 1, 500)), RNG.normal(0, 1, 500)),
    "few": (np.array([1.0, 2.0, 3.0]), RNG.normal(0, 1, 100)),
    "empty": (np.full(100, np.nan), RNG.normal(0, 1, 100)),
    "constant": (np.full(100, 5.0), np.full(100, 5.0)),
    "counts": (RNG.poisson(2, 1000).astype(float), RNG.poisson(3, 1000).astype(float)),
}


def test_psi(spark):
    """All cases as features of one job."""
    def side(i):
        n = max(len(c[i]) for c in PSI_CASES.values())
        columns = {k: [None if j >= len(c[i]) or np.isnan(c[i][j]) else float(c[i][j]) for j in range(n)] for k, c in PSI_CASES.items()}
        return spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{k} double" for k in columns))

    table = drift.psi_table(side(0), side(1), list(PSI_CASES), rows_per_slice=500)
    got = {r.feature: r.psi for r in table.collect()}
    expected = {k: psi_by_numpy(*c) for k, c in PSI_CASES.items()}
    assert got == pytest.approx(expected, abs=1e-9)
    assert got["same"] < 0.01 and got["slight"] < 0.1 and got["shift"] > 0.25 and 0.05 < got["moderate"] < 0.5
    assert got["few"] == got["empty"] == got["constant"] == 0.0


def test_narrowed_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    values = {"normal": rng.normal(0, 1, 20_000), "counts": rng.poisson(4, 20_000).astype(float), "few": np.arange(25.0)}
    rows = [tuple(float(v[i]) if i < len(v) else None for v in values.values()) + (None,) for i in range(20_000)]
    df = spark.createDataFrame(rows, "normal double, counts double, few double, none double").repartition(4)
    qs = [i / 10 for i in range(11)]
    columns = {c: F.col(c) for c in df.columns}
    want = {f: pytest.approx(list(np.percentile(v, np.arange(0, 101, 10)))) for f, v in values.items()}
    large = {c: F.col(c) for c in ("normal", "counts")}
    assert quantiles._narrowed(df, large, qs, 2_000, 100) == {c: want[c] for c in large}
    for held in (10, 10**9):
        assert quantiles.column_quantiles(df, columns, qs, 20_000, held, accuracy=2_000) == want
    assert quantiles.column_quantiles(df, {"none": F.col("none")}, qs, 20_000, 10) == {}


def test_drift_reads_rows_without_copying_them(spark, monkeypatch):
    """One aggregation for the edges and one of each side for the counts; no row is repeated per feature."""
    frame = drift_frame(spark, 1, 500, (0, 1), (0, 100), 2)
    plans, first = [], type(frame).first

    def seen(self):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return first(self)

    monkeypatch.setattr(type(frame), "first", seen)
    drift.psi_table(frame, frame, frame.columns)
    assert len(plans) == 3 and not any(x in p for p in plans for x in ("Generate", "Join", "hashpartitioning"))


def test_psi_of_values_outside_the_range(spark):
    inside = spark.range(100).select(F.col("id").cast("double").alias("x"))
    outside = inside.select((F.col("x") + 1000).alias("x"))
    assert drift.psi(inside, outside, "x") > 0.25
    assert drift.psi(inside, outside, "x", open_ends=True) > 0.25


def drift_frame(spark, seed, n, a, b, c, rate=None):
    rng = np.random.default_rng(seed)
    columns = [rng.normal(*a, n), rng.uniform(*b, n), rng.exponential(c, n)]
    names = "feature_a double, feature_b double, feature_c double"
    if rate is not None:
        columns.append((rng.random(n) < rate).astype(int))
        names += ", isFraud int"
    return spark.createDataFrame([tuple(v.item() for v in row) for row in zip(*columns)], names)


def test_drift_decision(spark, folder):
    base = drift_frame(spark, 42, 3000, (0, 1), (0, 100), 2, 0.035)
    options = {"features": ["feature_a", "feature_b", "feature_c", "gone"], "min_rows": 100}
    calm = drift.drift_decision(base, drift_frame(spark, 43, 1000, (0, 1), (0, 100), 2, 0.035), **options).first()
    assert not calm["should_retrain"] and calm["total_features"] == 3 and calm["reason"] == "No significant drift detected"
    moved = drift.drift_decision(base, drift_frame(spark, 44, 1000, (3, 2), (50, 200), 10, 0.15), **options).first()
    assert moved["should_retrain"] and moved["critical"] >= 1 and " AND Target fraud rate shifted by " in moved["reason"]
    labels = drift.drift_decision(base, drift_frame(spark, 45, 1000, (0, 1), (0, 100), 2, 0.15), **options).first()
    assert labels["should_retrain"] and labels["critical"] == 0
    few = drift.drift_decision(base, base.limit(3), **options).first()
    assert few["skipped"] and not few["should_retrain"] and few["reason"] == "Insufficient production data (3 < 100)"
    unlabelled = drift.label_drift(base, base.drop("isFraud")).first()
    assert unlabelled["production_fraud_rate"] is None and not unlabelled["drifted"]


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(np.round(v, 1))) for g in ("a", "b", "c") for v in rng.normal(0, 3, 301)] + [("d", 4.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = grouped_quantiles(df, ["g"], "v", {"q10": 0.1, "q50": 0.5, "q99": 0.99}, rows_per_slice=25).collect()
    for r in got:
        values = [v for g, v in rows if g == r.g and v is not None]
        assert (r.q10, r.q50, r.q99) == pytest.approx(tuple(np.percentile(values, [10, 50, 99])))


@pytest.fixture(scope="module")
def unordered(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), int(t), int(i) % 3) for i, t in zip(rng.permutation(997), rng.integers(0, 50, 997))]
    return spark.createDataFrame(rows, "TransactionID long, TransactionDT long, isFraud int").repartition(5)


def test_row_index_and_split(unordered):
    order = ["TransactionDT", "TransactionID"]
    expected = {r.TransactionID: i for i, r in enumerate(sorted(unordered.collect(), key=lambda r: (r.TransactionDT, r.TransactionID)))}
    indexed = ordered.row_index(unordered, order, rows_per_slice=100)
    assert {r.TransactionID: r.row_index for r in indexed.collect()} == expected
    train, rest = ordered.ordered_split(unordered, rows_per_slice=100)
    assert {r.TransactionID for r in train.collect()} == {k for k, i in expected.items() if i < 797}
    assert rest.count() == 200
    folds = ordered.with_fold(unordered, 5, order, rows_per_slice=100)
    sizes = [200, 200, 199, 199, 199]
    assert [r["count"] for r in folds.groupBy("fold").count().orderBy("fold").collect()] == sizes
    assert {r.TransactionID for r in folds.where("fold = 0").collect()} == {k for k, i in expected.items() if i < 200}
    with pytest.raises(ValueError):
        ordered.with_fold(unordered.limit(3), 5, order)


def test_rows_at_positions(unordered, spark):
    order = ["TransactionDT", "TransactionID"]
    expected = sorted((r.TransactionDT, r.TransactionID) for r in unordered.collect())
    ranks = [0, 5, 400, 401, 996]
    for narrow_rows in (10, 10_000):
        assert ordered.rows_at(unordered, order, ranks, 100, narrow_rows=narrow_rows) == [expected[r] for r in ranks]
    many = spark.range(50_000).select(F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("t"), "id")
    times = sorted((r.t, r.id) for r in many.collect())
    near, at = ordered.near_ranks(many, "t", [10_000, 40_000], 50_000)
    assert near.count() < 500 and at[10_000] < at[40_000] < 500
    assert ordered.rows_at(many, ["t", "id"], [40_000, 10_000], narrow_rows=10) == [times[40_000], times[10_000]]


def test_wide_rows_never_meet_in_one_task(unordered):
    indexed = ordered.row_index(unordered, ["TransactionDT", "TransactionID"], rows_per_slice=100)
    plan = indexed._jdf.queryExecution().executedPlan().toString()
    # the only single partition is the table of slice totals
    single = plan.split("Exchange SinglePartition")
    assert len(single) == 2 and "HashAggregate(keys=[_slice" in single[1][:400]


def test_sample_and_examples(unordered):
    sample = ordered.seeded_sample(unordered, 50)
    assert [r.TransactionID for r in sample.collect()] == [r.TransactionID for r in ordered.seeded_sample(unordered, 50).collect()]
    times = [r.TransactionDT for r in sample.collect()]
    assert len(times) == 50 and times == sorted(times)
    assert ordered.seeded_sample(unordered, 5000).count() == 997
    counts = ordered.first_per_class(unordered).groupBy("isFraud").count().collect()
    assert {r["count"] for r in counts} == {5}


def test_importance(spark):
    df = spark.createDataFrame([(1.0, -3.0), (-1.0, 5.0)], "a double, b double")
    rows = importance(df, ["a", "b"]).collect()
    assert [(r.feature, r.mean_abs_contribution, r.rank) for r in rows] == [("b", 4.0, 1), ("a", 1.0, 2)]


def test_risk_bands(spark):
    from ledgerlens.functions.scalars import risk_level

    values = [0.0, 0.29, 0.30, 0.49, 0.50, 0.79, 0.80, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    bands = ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL"]
    assert [r[0] for r in df.orderBy("p").select(risk_level(F.col("p"))).collect()] == bands


def test_approximate_quantiles_per_window(spark):
    df = spark.range(1000).select(
        F.timestamp_seconds("id").alias("ts"), F.lit("x").alias("endpoint"), F.col("id").cast("double").alias("latency")
    )
    exact = monitoring.latency_quantiles(df, width="1 day").first()
    rough = monitoring.approx_window_quantiles(df, "latency", {"p50": 0.5}, width="1 day").first()
    assert exact["p50"] == 499.5 and abs(rough["p50"] - 499.5) < 2


def test_rounding_query_shows_the_log_and_both_digits():
    """A change of its SQL had dropped the columns of six and four places."""
    from ledgerlens.plans.catalog import SQL

    assert all(f"AS {c}" in SQL["f9_rounding"] for c in ("fraud_probability", "six", "four"))


def test_permuted_rows_are_scored_by_all_cores(spark):
    """The pairs are small, so they came to one task, which then scored every variant of them."""
    from ledgerlens.operators.importance import permutation_importance

    df = spark.range(40_000).selectExpr(
        "id", "id div 3 as t", "cast(id % 4 = 0 as int) as label", "cast(id % 4 = 0 as double) + id % 7 / 10D as a", "cast(id % 5 as double) as b")
    tasks = []

    def score(variants):
        tasks.append(variants.rdd.getNumPartitions())
        return variants.withColumn("score", F.col("a"))

    rows = permutation_importance(df, ["a", "b"], score, "label", "id", "t").collect()
    assert tasks == [8]
    assert [(r.feature, r.rank) for r in rows] == [("a", 1), ("b", 2)]
    own = df.orderBy("t", "id").toPandas()
    other = df.orderBy(F.xxhash64(F.col("id"), F.lit(43)), "id").toPandas()
    y, a, shuffled = own["label"].to_numpy(), own["a"].to_numpy(), other["a"].to_numpy()
    assert rows[0].loss == pytest.approx(brute_precision(y, a) - brute_precision(y, shuffled)) and rows[1].loss == pytest.approx(0.0)


def brute_precision(y, p):
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        flagged = p >= t
        recall = (y[flagged] == 1).sum() / (y == 1).sum()
        ap, last = ap + (recall - last) * (y[flagged] == 1).sum() / flagged.sum(), recall
    return ap
