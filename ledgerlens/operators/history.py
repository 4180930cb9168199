"""Expanding statistics per key over the rows before, and the deviation from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import DAY
from ledgerlens.functions.scalars import where
from ledgerlens.operators.keyed import Keyed, keyed_features


def zscore(deviation: Column, std: Column) -> Column:
    return where(std > 0, deviation / std, F.lit(0.0))


def history_outputs(df: DataFrame, spec: Keyed, prefix: str, count_name: str | None) -> DataFrame:
    keyed = F.col(spec.key).isNotNull()
    deviation = F.col(spec.amount) - F.col("_mean")
    out = {
        f"{prefix}_mean": F.when(keyed, F.col("_mean")),
        f"{prefix}_std": F.when(keyed, F.col("_std")),
        f"{prefix}_deviation": F.when(keyed, deviation),
        f"{prefix}_zscore": where(keyed, zscore(deviation, F.col("_std")), F.lit(0.0)),
    }
    if count_name:
        out[count_name] = F.when(keyed, F.col("_n"))
    return df.withColumns(out)


def recency_outputs(df: DataFrame, spec: Keyed, since_last: str, since_first: str) -> DataFrame:
    keyed = F.col(spec.key).isNotNull()
    time = F.col(spec.time)
    return df.withColumns({
        since_last: F.coalesce(F.when(keyed, time - F.col("_last")), F.lit(-1)).cast("long"),
        since_first: F.when(keyed, (time - F.coalesce("_first", time)) / F.lit(DAY * spec.ticks)),
    })


def expanding_history(
    df: DataFrame, spec: Keyed, prefix: str, count_name: str | None = None, **tuning
) -> DataFrame:
    """``{prefix}_mean|std|deviation|zscore`` (and a count) over the earlier rows of the key.

    Earlier means by (time, id), so an earlier row of the same instant counts.
    """
    return keyed_features(
        df, spec, with_running=True,
        finish=lambda d: history_outputs(d, spec, prefix, count_name), **tuning,
    )


def recency(
    df: DataFrame,
    spec: Keyed,
    since_last: str = "time_since_last_txn_card1",
    since_first: str = "days_since_card_first_seen",
    **tuning,
) -> DataFrame:
    """Ticks since the key's previous row (-1 if none) and days since its first row."""
    return keyed_features(
        df, spec, with_running=True,
        finish=lambda d: recency_outputs(d, spec, since_last, since_first), **tuning,
    )
