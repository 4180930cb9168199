"""Exact interpolated quantiles per group, without holding a group's values in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.config import HELD_VALUES, ROWS_PER_SLICE, SKETCH_ACCURACY
from ledgerlens.skew import SLICE, range_slices, slice_count


def ranked_counts(sliced: DataFrame, groups: list[str], value: str, copies: str) -> DataFrame:
    """Add ``_rank`` of a value's first copy in its group, ``_end`` after its last, and the group's ``_size``.

    ``sliced`` has distinct (group, value) rows in range slices. A value's rank is its rank in the
    slice plus the group's copies in earlier slices.
    """
    whole = Window.partitionBy(*groups)
    earlier = whole.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    # one row per slice, and one more per group
    carried = sliced.groupBy(*groups, SLICE).agg(F.sum(copies).alias("_n")).select(
        *groups, SLICE, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_n").over(whole).alias("_size"),
    )
    before = Window.partitionBy(SLICE, *groups).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.withColumn("_local", F.coalesce(F.sum(copies).over(before), F.lit(0)))
    rank = F.col("_start") + F.col("_local")
    return local.join(carried, [*groups, SLICE]).select(
        *groups, value, "_size", rank.alias("_rank"), (rank + F.col(copies)).alias("_end")
    )


def covers(position: Column) -> Column:
    return (F.col("_rank") <= position) & (position < F.col("_end"))


def between(low: Column, high: Column, part: Column) -> Column:
    return F.when(low == high, low).otherwise(low + (high - low) * part)


def quantiles_of_counts(
    sliced: DataFrame, groups: list[str], value: str, copies: str, quantiles: dict[str, float]
) -> DataFrame:
    """One column per quantile. Only values that cover a wanted rank go on, so the last aggregations see
    at most two rows per group and quantile."""
    ranked = ranked_counts(sliced, groups, value, copies)

    def position(q: Column) -> Column:
        return q * (F.col("_size") - 1)

    wanted = F.array(*[F.lit(float(q)) for q in sorted(set(quantiles.values()))])
    hit = F.filter(wanted, lambda q: covers(F.floor(position(q))) | covers(F.ceil(position(q))))
    hits = ranked.withColumn("_q", F.explode(hit))
    at = position(F.col("_q"))
    ends = hits.groupBy(*groups, "_q").agg(
        F.max(F.when(covers(F.floor(at)), F.col(value))).alias("low"),
        F.max(F.when(covers(F.ceil(at)), F.col(value))).alias("high"),
        F.first(at - F.floor(at)).alias("part"),
    )
    found = between(F.col("low"), F.col("high"), F.col("part"))
    return ends.withColumn("_found", found).groupBy(*groups).agg(*[
        F.max(F.when(F.col("_q") == q, F.col("_found"))).alias(name) for name, q in quantiles.items()
    ])


def count_slices(
    counted: DataFrame, groups: list[str], value: str, rows: int, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    return range_slices(counted, [*groups, value], slice_count(counted, rows_per_slice, rows=rows), "quantiles")


def grouped_quantiles(
    df: DataFrame, groups: list[str], value: str, quantiles: dict[str, float], rows_per_slice: int = ROWS_PER_SLICE,
    rows: int | None = None,
) -> DataFrame:
    """``groups`` plus one column per quantile; nulls are ignored."""
    known = df.where(F.col(value).isNotNull())
    counted = known.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_copies"))
    rows = known.count() if rows is None else rows
    sliced = count_slices(counted, groups, value, rows, rows_per_slice)
    return quantiles_of_counts(sliced, groups, value, "_copies", quantiles)


def column_quantiles(
    df: DataFrame, columns: dict[str, Column], quantiles: list[float], rows: int, held: int = HELD_VALUES,
    accuracy: int = SKETCH_ACCURACY, rows_per_slice: int = ROWS_PER_SLICE,
) -> dict[str, list[float]]:
    """Exact quantiles of a handful of columns (doubles; nulls are ignored), such as the monitored features, to the driver.

    All columns share one aggregation, so the rows are never copied per column. Of more than ``held`` values a mergeable
    sketch brackets every wanted rank, one aggregation counts the values below the brackets, and only the values inside, a
    few per mille, become rows that are ordered. Columns without values are left out.
    """
    qs, names = sorted(set(quantiles)), list(columns)
    if rows * len(columns) > held:
        found = _narrowed(df, columns, qs, accuracy, rows_per_slice)
        if found is not None:
            return found
        # a bracket missed its rank, which a column of few values can cause
        long = df.select(F.explode(_pairs(columns)).alias("_p")).select("_p.name", "_p.value").where("value IS NOT NULL")
        marks = {f"q{i}": q for i, q in enumerate(qs)}
        exact = grouped_quantiles(long, ["name"], "value", marks, rows_per_slice, rows * len(columns)).collect()
        return {r["name"]: [r[m] for m in marks] for r in exact}
    wanted = F.array(*[F.lit(q) for q in qs])
    row = df.agg(*[F.percentile(c, wanted).alias(f"_{i}") for i, c in enumerate(columns.values())]).first()
    return {name: list(row[i]) for i, name in enumerate(names) if row[i] is not None}


def _pairs(columns: dict[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("name"), c.alias("value")) for name, c in columns.items()])


def _narrowed(
    df: DataFrame, columns: dict[str, Column], qs: list[float], accuracy: int, rows_per_slice: int
) -> dict[str, list[float]] | None:
    """None if a bracket misses its rank."""
    margin = 2 / accuracy
    probes = [min(max(q + side * margin, 0.0), 1.0) for q in qs for side in (-1, 1)]
    sketch = df.agg(*[
        F.struct(F.count(c).alias("n"), F.percentile_approx(c, probes, accuracy).alias("p")) for c in columns.values()]).first()
    known = {name: (s["n"], s["p"][::2], s["p"][1::2]) for name, s in zip(columns, sketch) if s["n"]}
    below = df.agg(*[
        F.count_if(columns[name] < F.lit(float(low))) for name, (_, lows, _) in known.items() for low in lows]).first() if known else []
    targets = []
    for k, (name, (n, lows, highs)) in enumerate(known.items()):
        for i, q in enumerate(qs):
            position, under = q * (n - 1), below[k * len(qs) + i]
            low, high = math.floor(position), math.ceil(position)
            targets.append((name, i, low - under, high - under, position - low))
    if not targets:
        return {}
    inside = F.array_compact(F.array(*[
        F.when(columns[name].between(F.lit(float(low)), F.lit(float(high))), F.struct(
            F.lit(name).alias("name"), F.lit(i).alias("_i"), columns[name].alias("value")))
        for name, (_, lows, highs) in known.items() for i, (low, high) in enumerate(zip(lows, highs))]))
    # rows without a value in a bracket go before anything is copied
    near = df.select(inside.alias("_near")).where(F.size("_near") > 0).select(F.explode("_near").alias("_v")).select("_v.*")
    counted = near.groupBy("name", "_i", "value").agg(F.count(F.lit(1)).alias("_copies"))
    wanted = df.sparkSession.createDataFrame(targets, "name string, _i int, _low long, _high long, _part double")
    expected = int(sum(n for n, _, _ in known.values()) * margin * 3 * len(qs)) + 1
    sliced = count_slices(counted, ["name", "_i"], "value", expected, rows_per_slice)
    hits = ranked_counts(sliced, ["name", "_i"], "value", "_copies").join(F.broadcast(wanted), ["name", "_i"]).where(
        covers(F.col("_low")) | covers(F.col("_high"))
    )
    ends = hits.groupBy("name", "_i").agg(
        F.max(F.when(covers(F.col("_low")), F.col("value"))).alias("low"),
        F.max(F.when(covers(F.col("_high")), F.col("value"))).alias("high"), F.first("_part").alias("part"),
    ).select("name", "_i", between(F.col("low"), F.col("high"), F.col("part")).alias("found")).collect()
    values = {(r["name"], r["_i"]): r["found"] for r in ends}
    out = {name: [values.get((name, i)) for i in range(len(qs))] for name in known}
    return None if any(v is None for found in out.values() for v in found) else out
