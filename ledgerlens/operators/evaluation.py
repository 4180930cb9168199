"""Exact ranking metrics, threshold search, gates and champion selection.

Everything derives from one table: rows per distinct score with the positives and negatives below
it. Scores are combined before they are ordered, and ordered in slices, so ties are exact and no
task sees the whole curve.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import MIN_RECALL, QUALITY_GATES, ROWS_PER_SLICE, SWEEP_THRESHOLDS
from ledgerlens.operators.ordered import prefix_sums
from ledgerlens.skew import slice_count


@dataclass(frozen=True)
class ScoreCurve:
    """``rows``: threshold, pos, neg, pos_below, neg_below; one row per distinct score."""

    rows: DataFrame
    positives: int
    negatives: int

    @property
    def tp(self) -> Column:
        return F.lit(self.positives) - F.col("pos_below")

    @property
    def fp(self) -> Column:
        return F.lit(self.negatives) - F.col("neg_below")


def score_curve(
    df: DataFrame, label: str, score: str, rows_per_slice: int = ROWS_PER_SLICE
) -> ScoreCurve:
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    counts = known.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    slices = slice_count(counts, rows_per_slice, rows=known.count())
    rows = prefix_sums(
        counts, ["threshold"], {"pos_below": F.col("pos"), "neg_below": F.col("neg")}, slices, "score-curve"
    )
    total = rows.agg(F.coalesce(F.sum("pos"), F.lit(0)), F.coalesce(F.sum("neg"), F.lit(0))).first()
    return ScoreCurve(rows, total[0], total[1])


def average_precisions(
    df: DataFrame, run: str, label: str, score: str, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """``(run, auc_pr)``: the exact average precision of every run, all of them in one order of (run, score)."""
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    counts = known.groupBy(run, F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    slices = slice_count(counts, rows_per_slice, rows=known.count())
    rows = prefix_sums(counts, [run, "threshold"], {"pos_below": F.col("pos"), "neg_below": F.col("neg")}, slices, "score-curves")
    # what lies below the first score of a run belongs to the runs before it
    totals = rows.groupBy(run).agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), F.min("pos_below").alias("_p0"), F.min("neg_below").alias("_n0"))
    tp = F.col("_p") + F.col("_p0") - F.col("pos_below")
    fp = F.col("_n") + F.col("_n0") - F.col("neg_below")
    return rows.join(totals, run).groupBy(run).agg(
        F.coalesce(F.sum(F.try_divide(F.col("pos"), F.col("_p")) * tp / (tp + fp)), F.lit(0.0)).alias("auc_pr"))


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def threshold_sweep(
    df: DataFrame, label: str, score: str, thresholds: list[float] = SWEEP_THRESHOLDS, digits: int = 4,
    curve: ScoreCurve | None = None,
) -> DataFrame:
    """One row of metrics per threshold (predict positive when score >= threshold), in one aggregation."""
    curve = curve or score_curve(df, label, score)
    if not curve.positives or not curve.negatives:
        raise ValueError("both classes must occur among the labels")
    p, n = float(curve.positives), float(curve.negatives)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    area = F.sum(pos * (F.col("neg_below") + neg / 2)) / F.lit(p * n)
    precision_steps = F.sum(pos / F.lit(p) * (curve.tp / (curve.tp + curve.fp)))
    hits = []
    for i, t in enumerate(thresholds):
        flagged = F.col("threshold") >= F.lit(float(t))
        hits.append(F.coalesce(F.sum(F.when(flagged, pos)), F.lit(0.0)).alias(f"tp{i}"))
        hits.append(F.coalesce(F.sum(F.when(flagged, neg)), F.lit(0.0)).alias(f"fp{i}"))
    summed = curve.rows.agg(area.alias("auc_roc"), precision_steps.alias("auc_pr"), *hits)

    def row(i: int, t: float) -> Column:
        tp, fp = F.col(f"tp{i}"), F.col(f"fp{i}")
        values = {
            "auc_roc": F.col("auc_roc"), "auc_pr": F.col("auc_pr"),
            "precision": _ratio(tp, tp + fp), "recall": tp / F.lit(p),
            "f1": _ratio(2 * tp, tp + fp + F.lit(p)), "threshold": F.lit(float(t)),
            "predicted_fraud_rate": (tp + fp) / F.lit(p + n), "actual_fraud_rate": F.lit(p / (p + n)),
        }
        return F.struct(*[F.round(c, digits).alias(name) for name, c in values.items()])

    rows = F.array(*[row(i, t) for i, t in enumerate(thresholds)])
    return summed.select(F.explode(rows).alias("m")).select("m.*")


def evaluate(
    df: DataFrame, label: str, score: str, threshold: float = 0.5, digits: int = 4,
    curve: ScoreCurve | None = None,
) -> DataFrame:
    """One row: auc_roc, auc_pr, precision, recall, f1, threshold, predicted and actual rate."""
    return threshold_sweep(df, label, score, [threshold], digits, curve)


def precision_recall_curve(
    df: DataFrame, label: str, score: str, curve: ScoreCurve | None = None
) -> DataFrame:
    """``(threshold, precision, recall, f1)`` for every distinct score."""
    curve = curve or score_curve(df, label, score)
    tp, fp = curve.tp.cast("double"), curve.fp.cast("double")
    recall = tp / F.lit(float(curve.positives)) if curve.positives else F.lit(1.0)
    points = curve.rows.select(
        "threshold", (tp / (tp + fp)).alias("precision"), recall.alias("recall")
    )
    both = F.col("precision") + F.col("recall")
    return points.withColumn(
        "f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0))
    )


def optimal_threshold(
    df: DataFrame, label: str, score: str, strategy: str = "f1", min_recall: float = MIN_RECALL,
    curve: ScoreCurve | None = None,
) -> DataFrame:
    """One row ``threshold``. ``recall_constrained`` maximises precision among the points that reach
    ``min_recall``, and F1 if none does; the lowest threshold wins ties; no points give 0.5."""
    points = precision_recall_curve(df, label, score, curve)
    if strategy == "f1":
        reached, metric = F.lit(False), F.col("f1")
    elif strategy == "recall_constrained":
        reached = F.col("recall") >= F.lit(min_recall)
        metric = F.when(reached, F.col("precision")).otherwise(F.col("f1"))
    else:
        raise ValueError(f"unknown strategy {strategy}, choose f1 or recall_constrained")
    rank = F.struct(reached.alias("reached"), metric.alias("metric"), (-F.col("threshold")).alias("low"))
    return points.agg(F.coalesce(F.max_by("threshold", rank), F.lit(0.5)).alias("threshold"))


def check_gates(metrics: DataFrame, gates: dict[str, float] = QUALITY_GATES, digits: int = 4) -> DataFrame:
    """``(run_id, metric, required, actual, passed, reason)`` from long ``(run_id, metric, value)`` rows."""
    wide = metrics.groupBy("run_id").agg(*[
        F.max(F.when(F.col("metric") == g, F.col("value"))).alias(g) for g in gates
    ])
    rows = F.array(*[
        F.struct(
            F.lit(g).alias("metric"), F.lit(float(minimum)).alias("required"),
            F.round(F.col(g), digits).alias("actual"),
            F.coalesce(F.col(g) >= F.lit(float(minimum)), F.lit(False)).alias("passed"),
            F.when(F.col(g).isNull(), "metric not found in run").alias("reason"),
        )
        for g, minimum in gates.items()
    ])
    return wide.select("run_id", F.explode(rows).alias("g")).select("run_id", "g.*")


def promotion(metrics: DataFrame, gates: dict[str, float] = QUALITY_GATES) -> DataFrame:
    """``(run_id, all_passed, failed)``: a run is promoted when every gate passes."""
    return check_gates(metrics, gates).groupBy("run_id").agg(
        F.bool_and("passed").alias("all_passed"),
        F.concat_ws(", ", F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("metric"))))).alias("failed"),
    )


def champion(runs: DataFrame, run: str = "run_id", metric: str = "auc_pr") -> DataFrame:
    """The run with the highest metric; the first by name among equals."""
    return runs.orderBy(F.col(metric).desc(), run).limit(1)


def newest_version(versions: DataFrame, stage: str = "stage", version: str = "version") -> DataFrame:
    """The newest version per stage by integer order."""
    return versions.groupBy(stage).agg(F.max_by(version, F.col(version).cast("long")).alias(version))
