"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.operators.history import history_outputs
from ledgerlens.operators.keyed import keyed_features
from ledgerlens.config import VELOCITY_WINDOWS
from ledgerlens.plans import (  # noqa: F401
    feature_queries, metric_queries, model_queries, stream_queries, table_queries,
)
from ledgerlens.plans.registry import QUERIES, SQL, events

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = feature_queries.USER
    return keyed_features(
        events(spark, sf_dir), spec, VELOCITY_WINDOWS, "user", True,
        lambda d: history_outputs(d, spec, "user_amt", "user_txn_count"),
    )
