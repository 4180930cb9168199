"""Finding keys with too many rows for one task, and working around them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import BROADCAST_ROWS, HOT_ROWS, ROWS_PER_SLICE, SALTS, SLICES_PER_CORE
from ledgerlens.scratch import save

SLICE = "_slice"


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a counted number of rows; otherwise leave the join to AQE."""
    return F.broadcast(df) if rows <= limit else df


def slice_count(df: DataFrame, rows_per_slice: int = ROWS_PER_SLICE, rows: int | None = None) -> int:
    """How many range partitions ``df`` needs, never fewer than keep the cores busy.

    Slices finer than the default are cut up to ``SLICES_PER_CORE`` for each core; with more rows they grow up to the default."""
    rows = df.count() if rows is None else rows
    cores = df.sparkSession.sparkContext.defaultParallelism
    most = max(math.ceil(rows / ROWS_PER_SLICE), SLICES_PER_CORE * cores)
    return max(1, min(math.ceil(rows / rows_per_slice), most), min(cores, rows // 10_000))


@dataclass(frozen=True)
class HotKeys:
    """Keys above a row limit with their ``_rows``. There are at most (all rows / limit) of them."""

    table: DataFrame | None = None
    keys: int = 0
    rows: int = 0

    def __bool__(self) -> bool:
        return self.table is not None

    def above(self, limit: int) -> HotKeys:
        if not self:
            return self
        table = self.table.where(F.col("_rows") > limit)
        keys, rows = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("_rows"), F.lit(0))).first()
        return HotKeys(table, keys, rows) if keys else HotKeys()


def find_hot_keys(df: DataFrame, key: str, limit: int = HOT_ROWS) -> HotKeys:
    """Count rows per key (combined before the shuffle) and keep the keys above ``limit``."""
    counted = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > limit)
    )
    found = counted.limit(BROADCAST_ROWS + 1).collect()
    if not found:
        return HotKeys()
    if len(found) <= BROADCAST_ROWS:
        table = df.sparkSession.createDataFrame(found, counted.schema)
        return HotKeys(table, len(found), sum(r["_rows"] for r in found))
    table = save(counted, "hot-keys")
    keys, rows = table.agg(F.count(F.lit(1)), F.sum("_rows")).first()
    return HotKeys(table, keys, rows)


def split_hot(df: DataFrame, key: str, hot: HotKeys) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary and null keys, rows of hot keys)."""
    table = broadcast_if_small(hot.table.select(key), hot.keys)
    return df.join(table, key, "left_anti"), df.join(table, key, "left_semi")


def salted(
    df: DataFrame, table: DataFrame, key: str, table_key: str, hot: HotKeys, salts: int = SALTS
) -> tuple[DataFrame, DataFrame]:
    """Both sides of a left join with the column ``_spread``: rows without a key are dealt out by their content, rows of
    hot keys over ``salts`` numbers, and the table repeats its rows of hot keys once per number."""
    content = F.xxhash64(*df.columns)
    zero = F.lit(0).cast("long")
    spread = F.when(F.col(key).isNull(), content)
    if hot:
        marks = broadcast_if_small(hot.table.select(F.col(key).alias("_hot")), hot.keys)
        df = df.join(marks, F.col(key) == F.col("_hot"), "left")
        spread = spread.when(F.col("_hot").isNotNull(), F.pmod(content, F.lit(salts)))
        table = table.join(marks, F.col(table_key) == F.col("_hot"), "left").withColumn(
            "_spread", F.explode(F.when(F.col("_hot").isNull(), F.array(zero)).otherwise(F.sequence(zero, F.lit(salts - 1).cast("long"))))
        ).drop("_hot")
    else:
        table = table.withColumn("_spread", zero)
    df = df.withColumn("_spread", spread.otherwise(zero))
    return (df.drop("_hot") if hot else df), table


def null_spread(key: str, row_id: str) -> Column:
    """Second partitioning column: one group per key, but null keys spread row by row."""
    return F.when(F.col(key).isNull(), F.xxhash64(row_id)).otherwise(F.lit(0).cast("long"))


def range_slices(df: DataFrame, order: list, slices: int, label: str) -> DataFrame:
    """Range-partition on ``order`` and record the partition number in ``_slice``.

    The result is written: a second evaluation of a range partitioning may draw other bounds.
    """
    ranged = df.repartitionByRange(slices, *order)
    return save(ranged.withColumn(SLICE, F.spark_partition_id().cast("long") + 1), label)
