"""Point-in-time features per key.

One engine serves trailing windows, expanding statistics, time since the last row and lookups of
requests against a history. Ordinary keys use plain windows: one exchange on the key and one sort.
Keys above ``hot_rows`` are cut into ordered slices of bounded size; running values come from the
slice's own window merged with a carry from the earlier slices. Keys above ``frame_rows`` get their
trailing windows from sums per time bucket (``buckets.py``), whose cost does not depend on the
length of the window. Both ways add amounts as whole numbers (``exact.py``), so their sums are equal.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.config import AMOUNT, FRAME_ROWS, HOT_ROWS, ID, ROWS_PER_SLICE, TIME
from ledgerlens.operators.buckets import bucket_windows
from ledgerlens.operators.exact import ExactSum
from ledgerlens.scratch import save
from ledgerlens.skew import (
    SLICE, HotKeys, broadcast_if_small, find_hot_keys, null_spread, range_slices, slice_count, split_hot,
)

RUNNING = ["_n", "_mean", "_std", "_last", "_first"]


@dataclass(frozen=True)
class Keyed:
    """Roles of the columns. ``history`` names a boolean column: only true rows feed other rows."""

    key: str
    time: str = TIME
    row_id: str = ID
    amount: str = AMOUNT
    ticks: int = 1
    history: str | None = None

    def fed(self, c: Column) -> Column:
        return F.when(F.col(self.history), c) if self.history else c

    @property
    def order(self) -> list[str]:
        """Row order inside a key; requests come before history of the same instant."""
        return [self.time, *([self.history] if self.history else []), self.row_id]


def running(df: DataFrame, spec: Keyed) -> DataFrame:
    """Count, mean, sample deviation, last and first time over the rows before, within ``_slice``."""
    before = (
        Window.partitionBy(spec.key, SLICE).orderBy(*spec.order).rowsBetween(Window.unboundedPreceding, -1)
    )
    amount, time = spec.fed(F.col(spec.amount)), spec.fed(F.col(spec.time))
    return df.withColumns({
        "_n": F.count(amount).over(before),
        "_mean": F.avg(amount).over(before),
        "_std": F.stddev_samp(amount).over(before),
        "_last": F.max(time).over(before),
        "_first": F.min(time).over(before),
    })


def running_sliced(sliced: DataFrame, spec: Keyed, carry_rows: int) -> DataFrame:
    """As :func:`running`, for slices of hot keys: merges every slice with what came before it."""
    amount, time = spec.fed(F.col(spec.amount)), spec.fed(F.col(spec.time))
    totals = sliced.groupBy(spec.key, SLICE).agg(
        F.count(amount).alias("n"),
        F.avg(amount).alias("mean"),
        (F.var_pop(amount) * F.count(amount)).alias("m2"),
        F.max(time).alias("last"),
        F.min(time).alias("first"),
    )
    # at most (slices + hot keys) rows from here on; means are centred on the key's mean
    # so that the sums of squares keep their digits
    whole = Window.partitionBy(spec.key)
    past = whole.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    centre = F.coalesce(F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole), F.lit(0.0))
    centred = totals.withColumn("_centre", centre).withColumn("_off", F.col("mean") - F.col("_centre"))
    carried = centred.select(
        spec.key, SLICE, "_centre",
        F.coalesce(F.sum("n").over(past), F.lit(0)).alias("_n0"),
        F.sum(F.col("n") * F.col("_off")).over(past).alias("_off0"),
        F.sum(F.col("m2") + F.col("n") * F.col("_off") * F.col("_off")).over(past).alias("_sq0"),
        F.max("last").over(past).alias("_last0"),
        F.min("first").over(past).alias("_first0"),
    ).select(
        spec.key, SLICE, "_n0", "_last0", "_first0",
        F.when(F.col("_n0") > 0, F.col("_centre") + F.col("_off0") / F.col("_n0")).alias("_mean0"),
        F.when(F.col("_n0") > 0, F.col("_sq0") - F.col("_off0") * F.col("_off0") / F.col("_n0")).alias("_m20"),
    )
    before = (
        Window.partitionBy(spec.key, SLICE).orderBy(*spec.order).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = sliced.withColumns({
        "_n1": F.count(amount).over(before),
        "_mean1": F.coalesce(F.avg(amount).over(before), F.lit(0.0)),
        "_m21": F.coalesce(F.var_pop(amount).over(before), F.lit(0.0)) * F.count(amount).over(before),
        "_last1": F.max(time).over(before),
        "_first1": F.min(time).over(before),
    })
    joined = local.join(broadcast_if_small(carried, carry_rows), [spec.key, SLICE], "left")
    n = F.col("_n0") + F.col("_n1")
    mean0, m20 = F.coalesce("_mean0", F.lit(0.0)), F.coalesce("_m20", F.lit(0.0))
    gap = F.col("_mean1") - mean0
    m2 = m20 + F.col("_m21") + F.when(n > 0, gap * gap * F.col("_n0") * F.col("_n1") / n).otherwise(0.0)
    return joined.withColumns({
        "_n": n,
        "_mean": F.when(n > 0, mean0 + gap * F.col("_n1") / n),
        "_std": F.when(n > 1, F.sqrt(F.greatest(m2, F.lit(0.0)) / (n - 1))),
        "_last": F.greatest("_last0", "_last1"),
        "_first": F.least("_first0", "_first1"),
    }).drop("_n0", "_mean0", "_m20", "_last0", "_first0", "_n1", "_mean1", "_m21", "_last1", "_first1")


def trailing(df: DataFrame, spec: Keyed, windows: dict[str, int], prefix: str, exact: ExactSum) -> DataFrame:
    """Count and sum over ``[t - w, t)`` by range frames, within ``_slice``. No row is in the window of a null time.

    Each is what lies before ``t`` less what lies before ``t - w``: whole numbers, so nothing is lost, and frames that
    only grow are summed once, while a sliding frame is summed again for every row."""
    ordered = Window.partitionBy(spec.key, SLICE).orderBy(spec.time)
    keyed, timed = F.col(spec.key).isNotNull(), F.col(spec.time).isNotNull()
    # rows without a time come first in the order and would be in every frame
    parts = [F.when(timed, part) for part in exact.parts(spec.fed(F.col(spec.amount)))]
    sums = [F.count(F.when(timed, spec.fed(F.lit(1)))), *[F.sum(part) for part in parts]]
    shifts = {"": 0} | {name: width * spec.ticks for name, width in windows.items()}
    before = {name: [f"_before{i}_{name}" for i in range(len(sums))] for name in shifts}
    summed = df.withColumns({
        c: F.coalesce(s.over(ordered.rangeBetween(Window.unboundedPreceding, -shift - 1)), F.lit(0))
        for name, shift in shifts.items() for c, s in zip(before[name], sums)})
    out = {}
    for name in windows:
        rows, *parts = [F.col(c) - F.col(earlier) for c, earlier in zip(before[""], before[name])]
        out[f"{prefix}_count_{name}"] = F.when(keyed, F.when(timed, rows).otherwise(F.lit(0)))
        out[f"{prefix}_amt_sum_{name}"] = F.when(keyed, F.when(timed, exact.total(parts)).otherwise(F.lit(0.0)))
    return summed.withColumns(out).drop(*[c for names in before.values() for c in names])


def trailing_buckets(
    df: DataFrame, spec: Keyed, windows: dict[str, int], prefix: str, exact: ExactSum, rows_per_slice: int
) -> DataFrame:
    """The same for busy keys, from sums per time bucket, which are whole numbers: nothing is lost in a difference.

    The result depends on (key, instant) only, so rows are combined to instants first. Rows without a time stay out of it.
    """
    key, time = spec.key, spec.time
    timed = df.where(F.col(time).isNotNull())
    parts = {f"_p{i}": part for i, part in enumerate(exact.parts(spec.fed(F.col(spec.amount))))}
    instants = timed.groupBy(key, time).agg(
        F.count(spec.fed(F.lit(1))).alias("_c"), *[F.coalesce(F.sum(part), F.lit(0)).alias(c) for c, part in parts.items()])
    instants = save(instants.where("_c > 0"), "instants")
    ticks = {name: width * spec.ticks for name, width in windows.items()}
    found = bucket_windows(timed, instants, [key], time, ticks, ["_c", *parts], rows_per_slice)
    columns = [f"{prefix}_{kind}_{name}" for name in windows for kind in ("count", "amt_sum")]
    values = [c for name in windows for c in (F.col(f"_c_{name}"), exact.total([F.col(f"{part}_{name}") for part in parts]))]
    zeros = [F.lit(0).cast("long"), F.lit(0.0)] * len(windows)
    untimed = df.where(F.col(time).isNull()).select(*df.columns, *[z.alias(c) for c, z in zip(columns, zeros)])
    return found.select(*df.columns, *[v.alias(c) for c, v in zip(columns, values)]).unionByName(untimed)


def running_for_busy_keys(
    df: DataFrame, spec: Keyed, finish: Callable[[DataFrame], DataFrame], hot: HotKeys, rows_per_slice: int
) -> DataFrame:
    """Running features of keys that are known not to be null; hot ones are split over tasks."""
    rest, warm = split_hot(df, spec.key, hot) if hot else (df, None)
    out = finish(running(rest.select(*df.columns, F.lit(0).cast("long").alias(SLICE)), spec)).drop(SLICE, *RUNNING)
    if warm is None:
        return out
    slices = slice_count(warm, rows_per_slice, rows=hot.rows)
    sliced = range_slices(warm, [spec.key, *spec.order], slices, "running")
    done = finish(running_sliced(sliced, spec, slices + hot.keys)).drop(SLICE, *RUNNING)
    return out.unionByName(done.select(*out.columns))


def keyed_features(
    df: DataFrame,
    spec: Keyed,
    windows: dict[str, int] | None = None,
    prefix: str | None = None,
    with_running: bool = False,
    finish: Callable[[DataFrame], DataFrame] = lambda d: d,
    frame_rows: int = FRAME_ROWS,
    hot_rows: int = HOT_ROWS,
    rows_per_slice: int = ROWS_PER_SLICE,
    profile: HotKeys | None = None,
    exact: ExactSum | None = None,
) -> DataFrame:
    """Running and trailing features of one key; ``finish`` turns the running columns into outputs.

    ``profile`` may bring the keys above :func:`busy_limit`, and ``exact`` the range of the amounts, if they are known.
    """
    prefix = prefix or spec.key
    if profile is None:
        profile = find_hot_keys(df, spec.key, busy_limit(bool(windows), with_running, frame_rows, hot_rows))
    if windows and exact is None:
        exact = ExactSum.of(df, F.col(spec.amount))
    cold, busy = split_hot(df, spec.key, profile) if profile else (df, None)
    cold = cold.select(*df.columns, null_spread(spec.key, spec.row_id).alias(SLICE))
    # row frames first, range frames second: one exchange and one sort serve both
    if with_running:
        cold = finish(running(cold, spec)).drop(*RUNNING)
    if windows:
        cold = trailing(cold, spec, windows, prefix, exact)
    cold = cold.drop(SLICE)
    if busy is None:
        return cold
    busy = busy.select(*df.columns)
    if with_running:
        busy = running_for_busy_keys(busy, spec, finish, profile.above(hot_rows), rows_per_slice)
    if windows:
        busy = trailing_buckets(busy, spec, windows, prefix, exact, rows_per_slice)
    return cold.unionByName(busy.select(*cold.columns))


def busy_limit(windows: bool, with_running: bool, frame_rows: int = FRAME_ROWS, hot_rows: int = HOT_ROWS) -> int:
    return min([frame_rows] * windows + [hot_rows] * with_running)
