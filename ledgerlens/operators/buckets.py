"""Trailing windows of busy keys from sums per time bucket.

The sum over ``[t - w, t)`` is the sum before ``t`` less the sum before ``t - w``. Every instant of the data is copied once
for each window, ``w`` later: a copy lies before ``t`` exactly if its instant lies before ``t - w``. Both sums then need
one bucket of time only, that of ``t``: what lies before the bucket comes as one row of totals, and what lies inside it
is a running sum. Rows, copies and totals of a bucket meet in one exchange, and the rows need no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.scratch import save
from ledgerlens.skew import broadcast_if_small


def _bucket(time: str, width: str) -> Column:
    # any division that keeps the order will do
    return F.expr(f"`{time}` div {width}")


def bucket_windows(
    rows: DataFrame, instants: DataFrame, keys: list[str], time: str, windows: dict[str, int], sums: list[str], rows_per_slice: int
) -> DataFrame:
    """``rows`` with ``{sum}_{window}`` for every window: the sum of the instants of the row's key in ``[t - w, t)``.

    ``instants`` has the keys, the time and ``sums``, whole numbers, once per key and time; it is read twice. No key and
    no time is null. Buckets are as wide as the shortest window, and narrower for keys with more than ``rows_per_slice``
    rows in one; what still is too full, a single instant for example, is dealt to several tasks.
    """
    shortest = min(windows.values())
    marks = [0, *windows.values()]
    counts = rows.groupBy(*keys, _bucket(time, str(shortest)).alias("_b")).agg(F.count(F.lit(1)).alias("_rows"))
    fine = counts.groupBy(*keys).agg(F.max("_rows").alias("_peak")).where(F.col("_peak") > rows_per_slice)
    # at most all rows / rows_per_slice keys
    busy = fine.count()
    if busy:
        fine = save(fine, "busy-buckets")
        parts = F.greatest(F.lit(1).cast("long"), F.expr(f"{shortest} div ceil(_peak / {rows_per_slice})"))
        widths = broadcast_if_small(fine.select(*keys, parts.alias("_width")), busy)
        rows_, instants = rows.join(widths, keys, "left"), instants.join(widths, keys, "left")
        default = F.coalesce("_width", F.lit(shortest).cast("long"))
        rows_, instants = rows_.withColumn("_width", default), instants.withColumn("_width", default)
    else:
        rows_, instants = (d.withColumn("_width", F.lit(shortest).cast("long")) for d in (rows, instants))
    rows_ = rows_.withColumn("_b", _bucket(time, "_width"))
    shifts = F.array(*[F.struct(F.lit(m).alias("mark"), F.lit(w).cast("long").alias("shift")) for m, w in enumerate(marks)])
    copies = instants.select(*keys, time, "_width", *sums, F.explode(shifts).alias("_m")).select(
        *keys, "_width", F.col("_m.mark").alias("_mark"), (F.col(time) + F.col("_m.shift")).alias("_at"), *sums,
    ).withColumn("_b", _bucket("_at", "_width"))

    wide = {f"_{m}{s}": F.when(F.col("_mark") == m, F.col(s)) for m in range(len(marks)) for s in sums}
    whole = [*keys, "_b"]
    asked = rows_.groupBy(*whole, "_width").agg(F.count(F.lit(1)).alias("_rows"))
    totals = copies.groupBy(*whole).agg(*[F.sum(c).alias(name) for name, c in wide.items()])
    both = totals.unionByName(asked, allowMissingColumns=True).groupBy(*whole).agg(
        F.max("_rows").alias("_rows"), F.max("_width").alias("_width"), *[F.sum(name).alias(name) for name in wide])
    # one row per bucket and key
    past = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = F.ceil(F.col("_rows") / F.lit(rows_per_slice)).cast("long")
    before = both.select(
        *whole, "_width", parts.alias("_parts"), *[F.coalesce(F.sum(name).over(past), F.lit(0)).alias(name) for name in wide],
    ).where("_parts IS NOT NULL")
    before = save(before, "bucket-totals")
    buckets, most = before.agg(F.count(F.lit(1)), F.max("_parts")).first()

    # what lies before the bucket is an instant before all of it
    firsts = F.array(*[F.struct(F.lit(m).alias("_mark"), *[F.col(f"_{m}{s}").alias(s) for s in sums]) for m in range(len(marks))])
    firsts = before.select(*whole, "_parts", ((F.col("_b") - 1) * F.col("_width")).alias("_at"), F.explode(firsts).alias("_f")).select(
        *whole, "_parts", "_at", "_f.*")
    inside = copies.drop("_width").join(broadcast_if_small(before.select(*whole, "_parts"), buckets), whole)
    data = firsts.unionByName(inside)
    zero = F.lit(0).cast("long")
    if (most or 1) > 1:
        dealt = before.where("_parts > 1").select(*whole, "_parts")
        rows_ = rows_.join(broadcast_if_small(dealt, dealt.count()), whole, "left").withColumn(
            "_part", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_parts")), zero)).drop("_parts")
        data = data.withColumn("_part", F.explode(F.sequence(zero, F.col("_parts") - 1)))
    else:
        rows_, data = rows_.withColumn("_part", zero), data.withColumn("_part", zero)
    line = rows_.drop("_width").withColumn("_at", F.col(time)).unionByName(data.drop("_parts"), allowMissingColumns=True)
    earlier = Window.partitionBy(*whole, "_part").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)

    def total(m: int, s: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_mark") == m, F.col(s))).over(earlier), zero)

    found = line.withColumns({f"_{m}{s}": total(m, s) for m in range(len(marks)) for s in sums}).where("_mark IS NULL")
    return found.select(*rows.columns, *[
        (F.col(f"_0{s}") - F.col(f"_{m + 1}{s}")).alias(f"{s}_{name}") for m, name in enumerate(windows) for s in sums])
