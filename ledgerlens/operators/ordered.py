"""Global order without a single-task window: row numbers, prefix sums, splits and examples.

Rows are range-partitioned on the order columns into slices of bounded size. Totals per slice give
every slice its offset, and windows run inside the slices. Nulls of an order column come last, in every
operator of this module.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.config import (
    ATTRIBUTION_ROWS, EXAMPLES_PER_CLASS, ID, LABEL, NARROW_ROWS, ROWS_PER_SLICE, SKETCH_ACCURACY, TIME, TRAIN_RATIO,
)
from ledgerlens.skew import SLICE, broadcast_if_small, range_slices, slice_count


def nulls_last(order: list[str | Column]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]


def prefix_sums(
    df: DataFrame, order: list[str], sums: dict[str, Column], slices: int, label: str = "order"
) -> DataFrame:
    """Add, for every entry of ``sums``, its sum over the rows strictly before in ``order``."""
    inputs = {f"_in_{name}": c for name, c in sums.items()}
    order = nulls_last(order)
    sliced = range_slices(df.withColumns(inputs), order, slices, label)
    # one row per slice
    earlier = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(SLICE)
        .agg(*[F.sum(f"_in_{name}").alias(name) for name in sums])
        .select(SLICE, *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_off_{name}") for name in sums])
    )
    before = Window.partitionBy(SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.withColumns({
        f"_loc_{name}": F.coalesce(F.sum(f"_in_{name}").over(before), F.lit(0)) for name in sums
    })
    joined = local.join(broadcast_if_small(offsets, slices), SLICE)
    return joined.select(
        *df.columns, *[(F.col(f"_off_{name}") + F.col(f"_loc_{name}")).alias(name) for name in sums]
    )


def row_index(
    df: DataFrame, order: list[str], name: str = "row_index", rows_per_slice: int = ROWS_PER_SLICE,
    rows: int | None = None,
) -> DataFrame:
    """0-based position of every row in ``order``."""
    slices = slice_count(df, rows_per_slice, rows=rows)
    return prefix_sums(df, order, {name: F.lit(1)}, slices, "row-index").withColumn(name, F.col(name).cast("long"))


def rows_at(
    df: DataFrame, order: list[str], ranks: list[int], rows_per_slice: int = ROWS_PER_SLICE,
    rows: int | None = None, narrow_rows: int = NARROW_ROWS,
) -> list[tuple]:
    """The order columns of the rows at the given positions. Moves only these columns, and of a large
    table only the rows around the wanted positions."""
    if not ranks:
        return []
    rows = df.count() if rows is None else rows
    keys, at = df.select(*order), {rank: rank for rank in ranks}
    if rows > narrow_rows:
        keys, at = near_ranks(keys, order[0], ranks, rows)
    indexed = row_index(keys, order, "_rank", rows_per_slice, None if rows > narrow_rows else rows)
    wanted = indexed.where(F.col("_rank").isin(list(at.values()))).collect()
    found = {r["_rank"]: tuple(r[c] for c in order) for r in wanted}
    return [found[at[rank]] for rank in ranks]


def near_ranks(
    df: DataFrame, column: str, ranks: list[int], rows: int, accuracy: int = SKETCH_ACCURACY
) -> tuple[DataFrame, dict[int, int]]:
    """(rows around the given positions, their positions among these rows).

    A mergeable sketch brackets every position among the rows with a value, and one pass counts the rows below and
    inside the brackets. Nulls come last: a position among them, or one that its bracket misses, keeps all rows.
    """
    margin = 2 / accuracy
    known = df.agg(F.count(column)).first()[0]
    if max(ranks) >= known:
        return df, {rank: rank for rank in ranks}
    probes = [min(max(rank / known + side * margin, 0.0), 1.0) for rank in ranks for side in (-1, 1)]
    values = df.agg(F.percentile_approx(column, probes, accuracy)).first()[0]
    brackets: list[list] = []
    for low, high in sorted(zip(values[::2], values[1::2])):
        if brackets and low <= brackets[-1][1]:
            brackets[-1][1] = max(brackets[-1][1], high)
        else:
            brackets.append([low, high])
    within = [F.col(column).between(low, high) for low, high in brackets]
    counts = df.agg(
        *[F.count_if(F.col(column) < low) for low, _ in brackets], *[F.count_if(c) for c in within]
    ).first()
    below, inside = counts[:len(brackets)], counts[len(brackets):]
    at = {}
    for rank in ranks:
        for i in range(len(brackets)):
            if below[i] <= rank < below[i] + inside[i]:
                at[rank] = rank - below[i] + sum(inside[:i])
    if len(at) < len(set(ranks)):
        return df, {rank: rank for rank in ranks}
    return df.where(reduce(lambda a, b: a | b, within)), at


def at_or_after(order: list[str], bound: tuple) -> Column:
    """``order >= bound`` compared column by column, nulls last; never null itself."""
    later, equal = [], F.lit(True)
    for name, value in zip(order, bound):
        after = F.lit(False) if value is None else F.coalesce(F.col(name) > F.lit(value), F.lit(True))
        later.append(equal & after)
        equal = equal & F.col(name).eqNullSafe(F.lit(value))
    return reduce(lambda a, b: a | b, later) | equal


def ordered_split(
    df: DataFrame, order: list[str] = (TIME, ID), ratio: float = TRAIN_RATIO,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> tuple[DataFrame, DataFrame]:
    """(first ``floor(n * ratio)`` rows, the rest). Both are filters of ``df``: wide rows never move."""
    order = list(order)
    rows = df.count()
    cut = int(rows * ratio)
    if cut >= rows:
        return df, df.limit(0)
    (bound,) = rows_at(df, order, [cut], rows_per_slice, rows)
    late = at_or_after(order, bound)
    return df.where(~late), df.where(late)


def fold_starts(rows: int, folds: int) -> list[int]:
    """First positions of folds 1.. of a contiguous split; the first ``rows % folds`` get one row more."""
    size, extra = divmod(rows, folds)
    return [k * size + min(k, extra) for k in range(1, folds)]


def fold_column(
    df: DataFrame, folds: int, order: list[str], rows_per_slice: int = ROWS_PER_SLICE
) -> Column:
    """Number of a row's contiguous fold by position; the bounds are ``folds - 1`` literals."""
    rows = df.count()
    if rows < folds:
        raise ValueError(f"cannot split {rows} rows into {folds} folds")
    bounds = rows_at(df, order, fold_starts(rows, folds), rows_per_slice, rows)
    return reduce(lambda a, b: a + b, [at_or_after(order, b).cast("int") for b in bounds], F.lit(0))


def with_fold(
    df: DataFrame, folds: int, order: list[str], name: str = "fold", rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    return df.withColumn(name, fold_column(df, folds, order, rows_per_slice))


def first_per_class(
    df: DataFrame, label: str = LABEL, n: int = EXAMPLES_PER_CLASS, order: list[str] = (TIME, ID),
    name: str = "class_rank",
) -> DataFrame:
    """The first ``n`` rows of every class; each task passes on at most ``n`` rows per class."""
    ranked = Window.partitionBy(label).orderBy(*nulls_last(order))
    return df.withColumn(name, F.row_number().over(ranked)).where(F.col(name) <= n)


def seeded_sample(
    df: DataFrame, n: int = ATTRIBUTION_ROWS, seed: int = 42, row_id: str = ID, order: list[str] = (TIME, ID)
) -> DataFrame:
    """At most ``n`` rows without replacement, the same for the same seed, in time order.

    The lottery is the MD5 of id and seed, which any engine can repeat."""
    lottery = F.md5(F.concat_ws("|", F.col(row_id).cast("string"), F.lit(str(seed))))
    return df.orderBy(lottery, row_id).limit(n).orderBy(*nulls_last(order))


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.col(by).desc(), F.col(tie)).limit(k)


def in_input_order(df: DataFrame, position: str) -> DataFrame:
    """Return results in the order given by an input position column."""
    return df.orderBy(position)
