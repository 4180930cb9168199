"""Joins: side tables, labels, lookups with a default, and lookups of requests in a history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import BROADCAST_ROWS, HOT_ROWS, ID, LABEL, VELOCITY_WINDOWS
from ledgerlens.operators.history import zscore
from ledgerlens.operators.keyed import Keyed, keyed_features
from ledgerlens.skew import broadcast_if_small, find_hot_keys, salted


def left_join(left: DataFrame, right: DataFrame, on: str = ID) -> DataFrame:
    """Left outer join on ``on``; rows without a side record keep nulls."""
    return left.join(right, on, "left")


def check_unique(df: DataFrame, key: str) -> None:
    """Raise if ``key`` repeats: a left join with such a side would add rows."""
    repeated = df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{key} repeats in the side table, the join would change the row count")


def load_joined(left: DataFrame, right: DataFrame, on: str = ID) -> DataFrame:
    check_unique(right, on)
    return left_join(left, right, on)


def match_rates(left: DataFrame, right: DataFrame, on: str = ID, marker: str = "id_01") -> DataFrame:
    """Share of joined rows whose ``marker`` is known, and share of side rows whose id occurs left."""
    merged = left_join(left, right, on).agg(
        F.lit("merged_rows").alias("rate"), F.avg(F.col(marker).isNotNull().cast("double")).alias("value")
    )
    ids = left.select(on).distinct().withColumn("_hit", F.lit(1.0))
    side = right.join(ids, on, "left").agg(
        F.lit("side_rows").alias("rate"), F.avg(F.coalesce("_hit", F.lit(0.0))).alias("value")
    )
    return merged.unionByName(side)


def attach_labels(
    scored: DataFrame, labels: DataFrame, on: str = ID, label: str = LABEL, dedupe_by: str | None = None
) -> DataFrame:
    """Inner join with confirmed labels. With ``dedupe_by`` only the latest label of an id counts."""
    columns = [on, label]
    if dedupe_by:
        latest = labels.groupBy(on).agg(F.max_by(label, F.struct(dedupe_by, label)).alias(label))
        labels = latest.select(*columns)
    return scored.drop(label).join(labels.select(*columns), on, "inner")


def lookup(
    df: DataFrame, table: DataFrame, key: str, value: str, out: str, default: Column, rows: int,
    broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``out``: the table's value for ``key``, or ``default`` for unknown and missing keys.

    ``table`` must be unique in ``key``; ``rows`` is a count of it that decides on broadcasting. In a shuffled join
    rows without a key are spread evenly, and keys with more than ``hot_rows`` rows are dealt over several tasks.
    """
    table = table.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    if rows <= broadcast_rows:
        joined = df.join(broadcast_if_small(table, rows, broadcast_rows), F.col(key) == F.col("_key"), "left")
        return joined.withColumn(out, F.coalesce("_value", default)).drop("_key", "_value")
    left, right = salted(df, table, key, "_key", find_hot_keys(df, key, hot_rows))
    right = right.withColumnRenamed("_spread", "_part")
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_spread") == F.col("_part"))
    return (
        left.join(right, same, "left")
        .withColumn(out, F.coalesce("_value", default))
        .drop("_key", "_value", "_spread", "_part")
    )


def point_in_time(
    requests: DataFrame,
    history: DataFrame,
    spec: Keyed,
    prefix: str,
    windows: dict[str, int] = VELOCITY_WINDOWS,
    null_key: str = "null",
    **tuning,
) -> DataFrame:
    """Features of requests against a history they are not part of; only earlier instants count.

    Adds trailing counts and sums, ``{prefix}_txn_count``, ``{prefix}_amt_mean|std|deviation|zscore``,
    ``{prefix}_since_last`` (-1 if none) and ``{prefix}_days_since_first``. ``null_key="zero"`` gives
    requests without a key the values of a first-seen entity.
    """
    tagged = Keyed(spec.key, spec.time, spec.row_id, spec.amount, spec.ticks, history="_is_history")
    columns = [spec.row_id, spec.key, spec.time, spec.amount]
    extra = [c for c in requests.columns if c not in columns]
    both = requests.select(*columns, *extra, F.lit(False).alias("_is_history")).unionByName(
        history.select(*columns, F.lit(True).alias("_is_history")), allowMissingColumns=True
    )

    def finish(df: DataFrame) -> DataFrame:
        keyed = F.col(spec.key).isNotNull()
        deviation = F.col(spec.amount) - F.col("_mean")
        time = F.col(spec.time)
        return df.withColumns({
            f"{prefix}_txn_count": F.when(keyed, F.col("_n")),
            f"{prefix}_amt_mean": F.when(keyed, F.col("_mean")),
            f"{prefix}_amt_std": F.when(keyed, F.col("_std")),
            f"{prefix}_amt_deviation": F.when(keyed, deviation),
            f"{prefix}_amt_zscore": F.when(keyed, zscore(deviation, F.col("_std"))).otherwise(F.lit(0.0)),
            f"{prefix}_since_last": F.coalesce(F.when(keyed, time - F.col("_last")), F.lit(-1)).cast("long"),
            f"{prefix}_days_since_first": F.when(
                keyed, (time - F.coalesce("_first", time)) / F.lit(86_400 * spec.ticks)
            ),
        })

    out = keyed_features(
        both, tagged, windows=windows, prefix=prefix, with_running=True, finish=finish, **tuning
    ).where(~F.col("_is_history")).drop("_is_history")
    if null_key == "zero":
        out = first_seen_defaults(out, prefix, windows)
    return out


def first_seen_defaults(df: DataFrame, prefix: str, windows: dict[str, int] = VELOCITY_WINDOWS) -> DataFrame:
    """Values of an entity without history: zero counts and sums, z-score 0, 0 days, -1 since last."""
    zeros = [f"{prefix}_{kind}_{name}" for name in windows for kind in ("count", "amt_sum")]
    zeros += [f"{prefix}_txn_count", f"{prefix}_amt_zscore", f"{prefix}_days_since_first"]
    df = df.fillna(0, subset=[c for c in zeros if c in df.columns])
    last = f"{prefix}_since_last"
    return df.fillna(-1, subset=[last]) if last in df.columns else df


def last_seen(requests: DataFrame, history: DataFrame, spec: Keyed, out: str = "since_last", **tuning) -> DataFrame:
    """Ticks since the latest history row strictly before the request, -1 if none."""
    found = point_in_time(requests, history, spec, "_j", windows={}, **tuning)
    return found.select(*requests.columns, F.col("_j_since_last").alias(out))
