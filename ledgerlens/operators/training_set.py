"""Retention by event time, training-set refresh and the drift baseline."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import DAY, DRIFT_LOG_RETENTION, ID, LABEL, TIME, TRAINING_RETENTION
from ledgerlens.operators.align import align_to_schema, union_all
from ledgerlens.operators.joins import attach_labels

log = logging.getLogger(__name__)


def keep_recent(df: DataFrame, time: str = TIME, span: int = TRAINING_RETENTION) -> DataFrame:
    """Rows with ``time >= max(time) - span``; the maximum is a scalar subquery."""
    return df.where(F.col(time) >= df.agg(F.max(time)).scalar() - F.lit(span))


def append_with_retention(
    existing: DataFrame, new: DataFrame, span: int = DRIFT_LOG_RETENTION, time: str = TIME
) -> DataFrame:
    """Both tables by column name, without rows older than ``span`` before the latest one."""
    return keep_recent(union_all(existing, new), time, span)


def retire_days(spark, path: str, time: str = TIME, span: int = DRIFT_LOG_RETENTION, day: str = "day") -> DataFrame:
    """Read a day-partitioned log within its retention; older partitions are not listed into the scan."""
    table = spark.read.parquet(path)
    newest = table.agg(F.max(day)).first()[0]
    if newest is None:
        return table
    first = newest - span // DAY - 1
    return keep_recent(table.where(F.col(day) >= first), time, span)


def refresh_training_set(
    base: DataFrame,
    scored: DataFrame | None,
    labels: DataFrame | None,
    row_id: str = ID,
    label: str = LABEL,
    time: str = TIME,
    span: int = TRAINING_RETENTION,
    dedupe_by: str | None = None,
) -> DataFrame:
    """Base rows plus scored rows whose label has arrived, within the retention.

    Falls back to ``base`` when there is nothing scored, nothing labelled, no usable label columns or
    no match. Write the result to a new path: Spark cannot overwrite a table that it is reading.
    """
    if scored is None or labels is None:
        log.info("no labelled production rows, training on the base set")
        return base
    if row_id not in labels.columns or label not in labels.columns:
        log.error("labels need columns %s and %s, training on the base set", row_id, label)
        return base
    labelled = attach_labels(scored, labels, row_id, label, dedupe_by)
    if labelled.isEmpty():
        log.info("no label matches a scored row, training on the base set")
        return base
    return keep_recent(union_all(base, align_to_schema(labelled, base.schema)), time, span)


def snapshot_baseline(spark, source: str, target: str, promoted: bool) -> bool:
    """Copy the feature table to the drift baseline after a promotion; keep the old one otherwise."""
    if not promoted:
        log.info("not promoted, drift baseline unchanged")
        return False
    try:
        table = spark.read.parquet(source)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("baseline source %s not readable, drift baseline unchanged: %s", source, error)
        return False
    table.write.mode("overwrite").parquet(target)
    return True
