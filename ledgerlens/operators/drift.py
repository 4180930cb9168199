"""Population stability, label drift and the retraining decision."""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import (
    DRIFT_FRACTION, DRIFT_MIN_ROWS, HELD_VALUES, LABEL, LABEL_DRIFT, MONITORED_FEATURES, PSI_BINS, PSI_CRITICAL, PSI_FLOOR,
    PSI_MIN_VALUES, PSI_WARNING, ROWS_PER_SLICE,
)
from ledgerlens.operators.quantiles import column_quantiles
from ledgerlens.scratch import save

log = logging.getLogger(__name__)


def _monitored(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The monitored columns, written once: the plan behind ``df`` runs once, whatever reads them afterwards."""
    found = [c for c in dict.fromkeys(columns) if c in df.columns]
    return save(df.select(*found), name) if found else df


def _values(features: list[str]) -> dict[str, Column]:
    """The features as doubles, without NaN."""
    values = {c: F.col(c).cast("double") for c in features}
    return {c: F.when(~F.isnan(v), v) for c, v in values.items()}


def _per_bin(df: DataFrame, edges: dict[str, list[float]], open_ends: bool) -> dict[str, list[int]]:
    """Rows of every feature outside and in each bin, from one aggregation of all features.

    A bin holds ``edge <= value < next edge``, the last one its upper edge, too.
    """
    values, places, counts = _values(list(edges)), [], []
    for k, (feature, at) in enumerate(edges.items()):
        value = values[feature]
        # the value at the top is in the last bin; edges equal to the top open no other
        place = sum([F.when(value >= F.lit(e), 1).otherwise(0) for e in at[1:-1] if e < at[-1]], F.lit(0))
        inside = F.lit(True) if open_ends else value.between(F.lit(at[0]), F.lit(at[-1]))
        places.append(F.when(value.isNotNull(), F.when(inside, place).otherwise(F.lit(-1))).alias(f"_{k}"))
        counts += [F.count_if(F.col(f"_{k}") == i) for i in range(-1, len(at) - 1)]
    found, out, start = df.select(*places).agg(*counts).first(), {}, 0
    for feature, at in edges.items():
        out[feature] = list(found[start:start + len(at)])
        start += len(at)
    return out


def _stability(expected: list[int], actual: list[int]) -> float:
    """The index of counts (outside, bin 0, bin 1, ...); only bins that a side has rows in count."""
    if min(sum(expected), sum(actual)) < PSI_MIN_VALUES:
        return 0.0
    total = 0.0
    n_e, n_a = sum(expected[1:]), sum(actual[1:])
    for e, a in zip(expected[1:], actual[1:]):
        if e or a:
            pe, pa = max(e / n_e, PSI_FLOOR), max(a / n_a if n_a else 0.0, PSI_FLOOR)
            total += (pa - pe) * math.log(pa / pe)
    return total


def psi_table(
    expected: DataFrame, actual: DataFrame, features: list[str], bins: int = PSI_BINS, open_ends: bool = False,
    rows_per_slice: int = ROWS_PER_SLICE, held: int = HELD_VALUES,
) -> DataFrame:
    """``(feature, psi)`` for all features together.

    Bin edges are exact interpolated quantiles of the expected side; equal edges collapse. All features share one
    aggregation of the expected side for the edges and one of each side for the counts: rows are never copied per feature
    or shuffled. Actual values outside the edges are ignored, or join the end bins with ``open_ends``.
    """
    qs = [i / bins for i in range(bins + 1)]
    found = column_quantiles(expected, _values(features), qs, expected.count(), held, rows_per_slice=rows_per_slice)
    edges = {f: [float(e) for e in found[f]] for f in features if f in found and len(set(found[f])) >= 3}
    counts = [_per_bin(side, edges, open_ends) if edges else {} for side in (expected, actual)]
    rows = [(f, _stability(counts[0][f], counts[1][f]) if f in edges else 0.0) for f in features]
    return expected.sparkSession.createDataFrame(rows, "feature string, psi double")


def psi(expected: DataFrame, actual: DataFrame, feature: str, **options) -> float:
    return psi_table(expected, actual, [feature], **options).first()["psi"]


def drift_status(value: Column, warning: float = PSI_WARNING, critical: float = PSI_CRITICAL) -> Column:
    return F.when(value >= critical, "CRITICAL").when(value >= warning, "WARNING").otherwise("OK")


def feature_drift(
    baseline: DataFrame, production: DataFrame, features: list[str] = MONITORED_FEATURES,
    warning: float = PSI_WARNING, critical: float = PSI_CRITICAL, digits: int = 4, written: bool = False, **options,
) -> DataFrame:
    """``(feature, psi, status)``; features absent on a side are skipped. Status precedes rounding.

    ``written`` says that both sides are cheap to read several times."""
    shared = [f for f in features if f in baseline.columns and f in production.columns]
    if skipped := [f for f in features if f not in shared]:
        log.warning("drift not measured, column absent: %s", skipped)
    if not shared:
        return baseline.sparkSession.createDataFrame([], "feature string, psi double, status string")
    if not written:
        baseline, production = _monitored(baseline, shared, "baseline"), _monitored(production, shared, "production")
    table = psi_table(baseline, production, shared, **options)
    return table.select(
        "feature", F.round("psi", digits).alias("psi"), drift_status(F.col("psi"), warning, critical).alias("status")
    )


def label_drift(
    baseline: DataFrame, production: DataFrame, label: str = LABEL, threshold: float = LABEL_DRIFT, digits: int = 4
) -> DataFrame:
    """One row: both label rates, their absolute change and whether it exceeds the threshold.

    A side without the label has a null rate, and then nothing has drifted.
    """
    def rate(df: DataFrame, name: str) -> DataFrame:
        value = F.round(F.avg(label), digits) if label in df.columns else F.max(F.lit(None).cast("double"))
        return df.agg(F.lit(name).alias("side"), value.alias("rate"))

    both = rate(baseline, "baseline").unionByName(rate(production, "production"))
    change = F.abs(F.col("production_fraud_rate") - F.col("baseline_fraud_rate"))
    return both.agg(
        F.max(F.when(F.col("side") == "baseline", F.col("rate"))).alias("baseline_fraud_rate"),
        F.max(F.when(F.col("side") == "production", F.col("rate"))).alias("production_fraud_rate"),
    ).select(
        "*", F.round(change, digits).alias("absolute_change"),
        F.coalesce(change > threshold, F.lit(False)).alias("drifted"),
    )


def decision_reason(moved: Column, critical: Column, total: Column, drifted: Column, change: Column) -> Column:
    """What led to the decision: the features moved, the label rate drifted, both, or nothing. The texts are fixed values."""
    reasons = F.concat_ws(
        " AND ",
        F.when(moved, F.format_string(
            "%d/%d features  (%.0f%%) exceeded critical PSI threshold", critical, total, critical / total * 100)),
        F.when(drifted, F.format_string("Target fraud rate shifted by %.4f", change)),
    )
    return F.when(reasons == "", "No significant drift detected").otherwise(reasons)


def drift_decision(
    baseline: DataFrame, production: DataFrame, features: list[str] = MONITORED_FEATURES, label: str = LABEL,
    min_rows: int = DRIFT_MIN_ROWS, fraction: float = DRIFT_FRACTION, label_threshold: float = LABEL_DRIFT,
    drift: DataFrame | None = None, **options,
) -> DataFrame:
    """One row with counts per status, the drift fraction, the decision and its reason."""
    spark = baseline.sparkSession
    wanted = [label] if drift is not None else [*features, label]
    baseline, production = _monitored(baseline, wanted, "baseline"), _monitored(production, wanted, "production")
    production_rows = production.count()
    if production_rows < min_rows:
        return spark.range(1).select(
            F.lit(True).alias("skipped"), *[F.lit(None).cast("long").alias(c) for c in ("total_features", "ok", "warning", "critical")],
            F.lit(None).cast("double").alias("drift_fraction"), F.lit(None).cast("long").alias("baseline_rows"),
            F.lit(production_rows).cast("long").alias("production_rows"), F.lit(False).alias("should_retrain"),
            F.lit(f"Insufficient production data ({production_rows} < {min_rows})").alias("reason"),
        )
    drift = feature_drift(baseline, production, features, written=True, **options) if drift is None else drift
    labels = label_drift(baseline, production, label, label_threshold).first()
    share = F.coalesce(F.try_divide(F.col("critical"), F.col("total_features")), F.lit(0.0))
    summary = drift.agg(
        F.count(F.lit(1)).alias("total_features"),
        F.count_if(F.col("status") == "OK").alias("ok"),
        F.count_if(F.col("status") == "WARNING").alias("warning"),
        F.count_if(F.col("status") == "CRITICAL").alias("critical"),
    ).withColumn("_share", share)
    features_moved = F.col("_share") >= fraction
    reasons = decision_reason(
        features_moved, F.col("critical"), F.col("total_features"), F.lit(labels["drifted"]), F.lit(labels["absolute_change"] or 0.0))
    return summary.select(
        F.lit(False).alias("skipped"), "total_features", "ok", "warning", "critical",
        F.round("_share", 4).alias("drift_fraction"), F.lit(baseline.count()).cast("long").alias("baseline_rows"),
        F.lit(production_rows).cast("long").alias("production_rows"),
        (features_moved | F.lit(labels["drifted"])).alias("should_retrain"),
        reasons.alias("reason"),
    )
