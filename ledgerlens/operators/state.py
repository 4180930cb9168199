"""Entity state as tables: running statistics and the recent events that seed a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import STATE_RETENTION
from ledgerlens.operators.history import zscore
from ledgerlens.operators.joins import lookup
from ledgerlens.operators.keyed import Keyed
from ledgerlens.scratch import save


def entity_stats(df: DataFrame, spec: Keyed) -> DataFrame:
    """``(key, n, amt_sum, amt_sum_sq, mean, m2, std, first_seen, last_seen)``, combined before the shuffle."""
    amount = F.col(spec.amount)
    return df.where(F.col(spec.key).isNotNull()).groupBy(spec.key).agg(
        F.count(amount).alias("n"),
        F.sum(amount).alias("amt_sum"),
        F.sum(amount * amount).alias("amt_sum_sq"),
        F.avg(amount).alias("mean"),
        (F.var_pop(amount) * F.count(amount)).alias("m2"),
        F.stddev_samp(amount).alias("std"),
        F.min(spec.time).alias("first_seen"),
        F.max(spec.time).alias("last_seen"),
    )


def deviation_from_stats(df: DataFrame, stats: DataFrame, spec: Keyed, prefix: str, stat_rows: int) -> DataFrame:
    """Deviation and z-score of amounts against stored statistics."""
    known = stats.select(spec.key, F.struct("mean", "std").alias("_stats"))
    none = F.lit(None).cast(known.schema["_stats"].dataType)
    deviation = F.col(spec.amount) - F.col("_known.mean")
    return lookup(df, known, spec.key, "_stats", "_known", none, stat_rows).withColumns({
        f"{prefix}_deviation": deviation, f"{prefix}_zscore": zscore(deviation, F.col("_known.std")),
    }).drop("_known")


def bootstrap_state(
    df: DataFrame, spec: Keyed, retention: int = STATE_RETENTION
) -> tuple[DataFrame, DataFrame]:
    """(statistics over all history, events within ``retention`` of the key's last one)."""
    stats = save(entity_stats(df, spec), "entity-stats")
    events = df.select(spec.key, spec.row_id, spec.time, spec.amount).where(F.col(spec.key).isNotNull())
    never = F.lit(None).cast(stats.schema["last_seen"].dataType)
    events = lookup(events, stats, spec.key, "last_seen", "_last", never, stats.count())
    recent = events.where(F.col(spec.time) > F.col("_last") - F.lit(retention * spec.ticks)).drop("_last")
    return stats, recent


def seed_rows(df: DataFrame, keys: dict[str, Keyed], retention: int = STATE_RETENTION) -> DataFrame:
    """Initial stream state: per entity its statistics, and per recent instant one row of count and sum.

    ``(entity_type, entity_id, t, rows, amount_sum, n, mean, m2, first_seen, last_seen)``; at most one
    row per instant of the retention, so a busy key stays bounded.
    """
    parts = []
    for entity_type, spec in keys.items():
        stats, recent = bootstrap_state(df, spec, retention)
        instants = recent.groupBy(spec.key, spec.time).agg(
            F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(spec.amount), F.lit(0.0)).alias("amount_sum")
        )
        parts.append(
            instants.join(stats, spec.key).select(
                F.lit(entity_type).alias("entity_type"), F.col(spec.key).cast("string").alias("entity_id"),
                F.col(spec.time).alias("t"), "rows", "amount_sum", "n", "mean", "m2", "first_seen", "last_seen",
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
