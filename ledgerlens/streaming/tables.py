"""Entity features on streams whose state is tables: one entity spreads over many tasks.

The state of an entity is cut by time. ``instants`` holds the rows and amounts of every instant, ``hours`` those of every
hour, ``stats`` the running statistics; every micro-batch adds its own part of each under its number, so a repeated
attempt replaces what it wrote. A micro-batch reads, for the entities and hours of its rows, the totals of the hours
inside its windows and the instants of the hours at their borders only. Windows come from sums per time bucket, running
statistics from ordered slices with a carry, as in batch; amounts add as whole numbers in both. Every ``snapshot``
batches the state is merged into one, without what is older than the retention.

Rows of a micro-batch see what earlier batches and earlier instants of the batch brought, as with
:mod:`ledgerlens.streaming.processor`. A late row sees the whole retained past of its own time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.config import DAY, HOT_ROWS, HOUR, ROWS_PER_SLICE, STATE_RETENTION, STATE_TTL_MS, VELOCITY_WINDOWS
from ledgerlens.operators.buckets import bucket_windows
from ledgerlens.operators.exact import ExactSum
from ledgerlens.operators.history import zscore
from ledgerlens.operators.joins import last_seen, lookup
from ledgerlens.operators.keyed import Keyed, running_for_busy_keys
from ledgerlens.operators.state import entity_stats
from ledgerlens.scratch import save
from ledgerlens.skew import broadcast_if_small, find_hot_keys
from ledgerlens.streaming.jobs import StreamRoles, assemble, entity_rows, write_batch
from ledgerlens.streaming.processor import feature_schema

# amounts up to 1e35 without loss down to 1e-17, whatever comes later in the stream; infinities and NaN count as missing
SUMS = ExactSum(-56, 5)
PARTS = [f"_p{i}" for i in range(SUMS.size)]
PART_COLUMNS = ", ".join(f"{p} bigint" for p in PARTS)
SCHEMAS = {
    "stats": "entity string, n bigint, mean double, m2 double, first_seen bigint, last_seen bigint, touched timestamp, base int, batch int, day bigint",
    "hours": f"entity string, hour bigint, last bigint, _c bigint, {PART_COLUMNS}, base int, batch int, day bigint",
    "instants": f"entity string, hour bigint, t bigint, _c bigint, {PART_COLUMNS}, base int, batch int, day bigint",
}
STATS = "struct<batch: int, n: bigint, mean: double, m2: double, first_seen: bigint, last_seen: bigint, touched: timestamp>"


def entity_name(kind: Column, key: Column) -> Column:
    return F.concat(kind, F.lit("\u0000"), key)


@dataclass(frozen=True)
class StateTables:
    """Where the state is, and how it is cut."""

    path: str
    roles: StreamRoles
    windows: dict[str, int] = field(default_factory=lambda: dict(VELOCITY_WINDOWS))
    retention: int = STATE_RETENTION
    ttl_ms: int = STATE_TTL_MS
    snapshot: int = 20
    hot_rows: int = HOT_ROWS
    rows_per_slice: int = ROWS_PER_SLICE

    @property
    def hour(self) -> int:
        return HOUR * self.roles.ticks

    @property
    def sums(self) -> list[str]:
        return ["_c", *PARTS]

    def table(self, spark: SparkSession, name: str, epoch: int, own: bool = False) -> DataFrame:
        """Rows of the state before micro-batch ``epoch``, or with its ``own``: the last snapshot and the batches after it."""
        base = epoch // self.snapshot * self.snapshot - 1
        rows = spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")
        merged = (F.col("base") == 1) & (F.col("batch") == base)
        return rows.where(merged | ((F.col("base") == 0) & (F.col("batch") > base) & (F.col("batch") < epoch + own)))

    def write(self, df: DataFrame, name: str, epoch: int, base: int) -> None:
        numbered = df.withColumns({"base": F.lit(base), "batch": F.lit(epoch)})
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("base", "batch", "day").parquet(
            f"{self.path}/{name}")

    # --- what is written ---

    def instants_of(self, rows: DataFrame) -> DataFrame:
        """Rows (entity, t, amount) combined to instants."""
        finite = F.abs("amount") < F.lit(float("inf"))
        parts = SUMS.parts(F.when(finite, F.col("amount")))
        return rows.where("t IS NOT NULL").groupBy("entity", "t").agg(
            F.count(F.lit(1)).alias("_c"), *[F.coalesce(F.sum(p), F.lit(0)).alias(n) for n, p in zip(PARTS, parts)]
        ).withColumn("hour", F.expr(f"t div {self.hour}"))

    def add(self, rows: DataFrame, instants: DataFrame, epoch: int, base: int = 0) -> None:
        """Write what ``rows`` add to the state; ``instants`` are theirs."""
        day = F.expr("hour div 24").alias("day")
        self.write(instants.select("entity", "hour", "t", *self.sums, day), "instants", epoch, base)
        per_hour = instants.groupBy("entity", "hour").agg(F.max("t").alias("last"), *[F.sum(c).alias(c) for c in self.sums])
        self.write(per_hour.select("entity", "hour", "last", *self.sums, day), "hours", epoch, base)
        keyed = Keyed("entity", "t", "row_id", "amount", self.roles.ticks)
        stats = entity_stats(rows, keyed).select("entity", "n", "mean", "m2", "first_seen", "last_seen")
        self.write(stats.withColumns({"touched": F.current_timestamp(), "day": F.lit(0).cast("long")}), "stats", epoch, base)

    def merge(self, spark: SparkSession, epoch: int) -> None:
        """Write the state up to ``epoch`` as one snapshot. Older instants and hours than the retention go."""
        stats = save(self.stats(self.table(spark, "stats", epoch, own=True)), "stats")
        self.write(stats.withColumn("day", F.lit(0).cast("long")), "stats", epoch, 1)
        oldest = stats.select("entity", (F.col("last_seen") - self.retention * self.roles.ticks).alias("_oldest"))
        count = oldest.count()
        for name, key, extra in (("instants", ["hour", "t"], []), ("hours", ["hour"], [F.max("last").alias("last")])):
            rows = self.table(spark, name, epoch, own=True).join(broadcast_if_small(oldest, count), "entity")
            until = F.col("t") if name == "instants" else (F.col("hour") + 1) * self.hour
            rows = rows.where(until >= F.col("_oldest")).groupBy("entity", *key).agg(*extra, *[F.sum(c).alias(c) for c in self.sums])
            self.write(rows.withColumn("day", F.expr("hour div 24")), name, epoch, 1)

    # --- what is read ---

    def stats(self, rows: DataFrame) -> DataFrame:
        """Merged statistics of the entities, without those that nothing touched for ``ttl_ms``.

        There are at most ``snapshot`` rows an entity to merge, in the order of the batches.
        """
        parts = rows.groupBy("entity").agg(
            F.array_sort(F.collect_list(F.struct("batch", "n", "mean", "m2", "first_seen", "last_seen", "touched"))).alias("_s"))
        kept = F.expr(f"INTERVAL {self.ttl_ms} MILLISECONDS")

        def step(a: Column, b: Column) -> Column:
            n = a["n"] + b["n"]
            share = F.when(n > 0, b["n"] / n).otherwise(F.lit(0.0))
            gap = F.coalesce(b["mean"] - a["mean"], F.lit(0.0))
            both = F.struct(
                b["batch"].alias("batch"), n.alias("n"),
                F.when(a["n"] == 0, b["mean"]).when(b["n"] == 0, a["mean"]).otherwise(a["mean"] + gap * share).alias("mean"),
                (F.coalesce(a["m2"], F.lit(0.0)) + F.coalesce(b["m2"], F.lit(0.0)) + gap * gap * a["n"] * share).alias("m2"),
                F.least(a["first_seen"], b["first_seen"]).alias("first_seen"),
                F.greatest(a["last_seen"], b["last_seen"]).alias("last_seen"),
                F.greatest(a["touched"], b["touched"]).alias("touched"))
            return F.when(a.isNull() | (a["touched"] < b["touched"] - kept), b).otherwise(both)

        merged = parts.select("entity", F.aggregate("_s", F.lit(None).cast(STATS), step).alias("_s")).select("entity", "_s.*")
        return merged.drop("batch").where(F.col("touched") >= F.current_timestamp() - kept)

    def asked(self, spark: SparkSession, epoch: int, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What the windows of ``rows`` reach into: instants of the border hours, totals of the other hours, and statistics.

        The borders of ``[t - w, t)`` lie in the hours of ``t`` and of ``t - w``.
        """
        hours = save(rows.select("entity", F.expr(f"t div {self.hour}").alias("hour")).distinct(), "asked-hours")
        first, last, count = hours.agg(F.min("hour"), F.max("hour"), F.count(F.lit(1))).first()
        widths = sorted({0, *(w * self.roles.ticks for w in self.windows.values())})
        # a width that is no multiple of an hour has its border in one of two hours
        steps = sorted({s for w in widths for s in (w // self.hour, math.ceil(w / self.hour))})
        shifts = F.array(*[F.lit(s).cast("long") for s in steps])
        borders = hours.select("entity", F.explode(F.transform(shifts, lambda s: F.col("hour") - s)).alias("hour")).distinct()
        borders, entities = broadcast_if_small(borders, count * len(steps)), broadcast_if_small(hours.select("entity").distinct(), count)
        first, last = (first or 0) - max(steps), last or 0

        def between(name: str) -> DataFrame:
            days = F.col("day").between(first // 24 - 1, last // 24 + 1)
            return self.table(spark, name, epoch).where(days & F.col("hour").between(first, last)).drop("base", "batch", "day")

        instants = between("instants").join(borders, ["entity", "hour"], "left_semi")
        totals = between("hours").join(entities, "entity", "left_semi").join(borders, ["entity", "hour"], "left_anti")
        return instants, totals, self.stats(self.table(spark, "stats", epoch).join(entities, "entity", "left_semi"))


def batch_features(rows: DataFrame, state: StateTables, epoch: int) -> DataFrame:
    """Features of the rows (entity_type, entity_id, row_id, t, amount) of micro-batch ``epoch``; adds them to the state.

    ``rows`` are read several times."""
    spark, ticks = rows.sparkSession, state.roles.ticks
    rows = rows.select("*", entity_name(F.col("entity_type"), F.col("entity_id")).alias("entity"))
    own = save(state.instants_of(rows), "batch-instants")
    near, inside, known = state.asked(spark, epoch, rows)
    columns = ["entity", "t", *state.sums]
    totals = inside.withColumn("t", F.col("hour") * state.hour)
    instants = own.select(columns).union(near.select(columns)).union(totals.select(columns)).groupBy("entity", "t").agg(
        *[F.sum(c).alias(c) for c in state.sums])
    widths = {name: width * ticks for name, width in state.windows.items()}
    timed = bucket_windows(rows.where("t IS NOT NULL"), save(instants, "instants"), ["entity"], "t", widths, state.sums, state.rows_per_slice)
    untimed = rows.where("t IS NULL").select("*", *[F.lit(0).cast("long").alias(f"{c}_{n}") for n in widths for c in state.sums])
    found = timed.unionByName(untimed)

    stats = save(known.select("entity", F.struct("n", "mean", "m2", "first_seen", "last_seen").alias("_stats")), "asked-stats")
    none = F.lit(None).cast(stats.schema["_stats"].dataType)
    found = lookup(found, stats, "entity", "_stats", "_old", none, stats.count())

    spec = Keyed("entity", "t", "row_id", "amount", ticks)
    t, amount, old = F.col("t"), F.col("amount"), F.col("_old")

    def finish(df: DataFrame) -> DataFrame:
        n0, n1 = F.coalesce(old["n"], F.lit(0)), F.col("_n")
        n = n0 + n1
        gap = F.coalesce(F.col("_mean") - old["mean"], F.lit(0.0))
        mean = F.when(n0 == 0, F.col("_mean")).when(n1 == 0, old["mean"]).otherwise(old["mean"] + gap * n1 / n)
        m2 = F.coalesce(old["m2"], F.lit(0.0)) + F.coalesce(F.col("_std") * F.col("_std") * (n1 - 1), F.lit(0.0)) + F.when(
            n > 0, gap * gap * n0 * n1 / n).otherwise(0.0)
        std = F.when(n > 1, F.sqrt(m2 / (n - 1)))
        sums = []
        for name in state.windows:
            sums.append(F.col(f"_c_{name}").alias(f"count_{name}"))
            sums.append(SUMS.total([F.col(f"{p}_{name}") for p in PARTS]).alias(f"amt_sum_{name}"))
        return df.select(
            "entity", "entity_type", "entity_id", "row_id", "t", *sums, n.alias("txn_count"), mean.alias("amt_mean"), std.alias("amt_std"),
            (amount - mean).alias("amt_deviation"), F.coalesce(zscore(amount - mean, std), F.lit(0.0)).alias("amt_zscore"),
            F.greatest("_last", F.when(old["last_seen"] <= t, old["last_seen"])).alias("_previous"), (old["last_seen"] > t).alias("_late"),
            (t - F.least(F.coalesce("_first", t), F.coalesce(old["first_seen"], t))).alias("_age"))

    hot = find_hot_keys(rows, "entity", state.hot_rows)
    done = save(running_for_busy_keys(found, spec, finish, hot, state.rows_per_slice), "features")
    late = done.where("_late")
    if late.limit(1).count():
        # rows before the entity's last time look for the last instant that is not after them
        seen = near.select("entity", "t").union(inside.select("entity", F.col("last").alias("t"))).select(
            "entity", "t", F.lit(0).cast("long").alias("row_id"), F.lit(0.0).alias("amount"))
        asks = late.select("entity", (F.col("t") + 1).alias("t"), "row_id", F.lit(0.0).alias("amount"), F.col("t").alias("_t"), "entity_type")
        before = last_seen(asks, seen, spec, "_since", hot_rows=state.hot_rows, rows_per_slice=state.rows_per_slice).where("_since >= 0").select(
            "entity", "row_id", (F.col("t") - F.col("_since")).alias("_before"))
        done = done.join(before, ["entity", "row_id"], "left").withColumn("_previous", F.greatest("_previous", "_before"))
    state.add(rows, own, epoch)
    done = done.withColumns({
        "since_last": F.coalesce(t - F.col("_previous"), F.lit(-1)),
        "days_since_first": F.coalesce(F.col("_age") / F.lit(DAY * ticks), F.lit(0.0)),
    })
    return done.select(*[F.col(f.name).cast(f.dataType) for f in feature_schema(state.windows).fields])


def start_state(spark: SparkSession, state: StateTables, history: DataFrame | None = None) -> None:
    """Write the state that a stream starts from: empty, or that of a history of transactions.

    History is combined to hours and instants as anywhere else, so no task holds an entity's past; instants older than the
    retention before the entity's last row are left out.
    """
    if history is None:
        for name, schema in SCHEMAS.items():
            state.write(spark.createDataFrame([], schema).drop("base", "batch"), name, -1, 1)
        return
    rows = entity_rows(history, state.roles)
    rows = save(rows.select("*", entity_name(F.col("entity_type"), F.col("entity_id")).alias("entity")), "history-rows")
    last = rows.groupBy("entity").agg(F.max("t").alias("_t"))
    last = save(last, "last-seen")
    oldest = F.col("_t") - state.retention * state.roles.ticks
    instants = state.instants_of(rows)
    recent = lookup(instants, last, "entity", "_t", "_t", F.lit(None).cast("long"), last.count()).where(F.col("t") >= oldest).drop("_t")
    state.add(rows, save(recent, "history-instants"), -1, 1)


@dataclass(frozen=True)
class LatePolicy:
    """Rows more than ``delay`` seconds behind the newest event time of earlier micro-batches are set aside.

    ``rejected`` gets them with a reason, ``counts`` one row per micro-batch. A row without a time is never late.
    """

    delay: int
    rejected: str
    counts: str

    def start(self, spark: SparkSession) -> None:
        # a stream that resumes keeps the counts of its earlier micro-batches
        none = spark.createDataFrame([(None, 0, 0, -1)], "newest long, kept long, late long, batch int")
        none.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.counts)

    def apply(self, batch: DataFrame, roles: StreamRoles, epoch: int) -> DataFrame:
        """The rows in time, written once; the same rows whenever the micro-batch is repeated."""
        spark = batch.sparkSession
        counts = spark.read.schema("newest long, kept long, late long, batch int").parquet(self.counts)
        newest = counts.where(F.col("batch") < epoch).agg(F.max("newest")).first()[0]
        time, watermark = F.col(roles.time), None if newest is None else newest - self.delay * roles.ticks
        late = F.coalesce(time < F.lit(watermark).cast("long"), F.lit(False))
        seen = Observation("lateness")
        # counted while the rows are written
        rows = save(batch.withColumn("_late", late).observe(
            seen, F.max(time).alias("newest"), F.count_if(~late).alias("kept"), F.count_if(late).alias("late")), "batch")
        found = seen.get
        summary = [(newest if found["newest"] is None else max(found["newest"], newest or found["newest"]), found["kept"], found["late"])]
        reason = F.concat(F.lit("event time "), time, F.lit(f" is before {watermark}"))
        write_batch(rows.where("_late").drop("_late").withColumn("reason", reason), self.rejected, epoch)
        write_batch(spark.createDataFrame(summary, "newest long, kept long, late long"), self.counts, epoch)
        return rows.where("NOT _late").drop("_late")


def start_table_features(
    txns: DataFrame, state: StateTables, path: str, checkpoint: str, late: LatePolicy | None = None
) -> StreamingQuery:
    """Keep a table of transactions with their features; :func:`start_state` has written the first state.

    Without a policy, late rows are scored like any others.
    """
    columns = txns.columns
    if late:
        late.start(txns.sparkSession)

    def write(batch: DataFrame, epoch: int) -> None:
        batch = late.apply(batch, state.roles, epoch) if late else save(batch, "batch")
        features = batch_features(entity_rows(batch, state.roles), state, epoch)
        both = batch.withColumn("_kind", F.lit("txn")).unionByName(
            features.withColumnRenamed("t", "_t").withColumn("_kind", F.lit("features")), allowMissingColumns=True)
        write_batch(assemble(both, columns, state.roles), path, epoch)
        if (epoch + 1) % state.snapshot == 0:
            state.merge(batch.sparkSession, epoch)

    return txns.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
