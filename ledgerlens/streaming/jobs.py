"""Streaming jobs: stateful features per transaction, and scoring with its logs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.config import AMOUNT, DAY, ID, TIME, VELOCITY_WINDOWS
from ledgerlens.functions.scalars import decision, risk_level
from ledgerlens.operators.joins import first_seen_defaults
from ledgerlens.sources.contract import split_valid
from ledgerlens.streaming.processor import EntityFeatures, feature_schema

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FEATURES = [f.name for f in feature_schema().fields if f.name not in ("entity_type", "entity_id", "row_id", "t")]


@dataclass(frozen=True)
class StreamRoles:
    """Column roles of the stream; ``entities`` maps a feature prefix to its key column."""

    entities: dict[str, str] = field(default_factory=lambda: {"card1": "card1", "P_emaildomain": "P_emaildomain"})
    row_id: str = ID
    time: str = TIME
    amount: str = AMOUNT
    ticks: int = 1


def streaming_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session of its own for the settings of stateful queries."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    session.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    # state with an expiry asks for another batch forever, and a run over the available data would not end
    session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", False)
    if state_partitions:
        session.conf.set("spark.sql.shuffle.partitions", state_partitions)
    return session


def distinct_rows(txns: DataFrame, roles: StreamRoles, keep: str = "7 days") -> DataFrame:
    """Drop ids that are sent again within ``keep`` of their arrival; the state is spread by id.

    The watermark is on the arrival, so a row is never late, however old its event time is."""
    arrived = txns.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", keep)
    return arrived.dropDuplicatesWithinWatermark([roles.row_id]).drop("_arrived")


def entity_rows(txns: DataFrame, roles: StreamRoles) -> DataFrame:
    """One row per (transaction, entity) with a known entity."""
    pairs = F.array(*[
        F.struct(F.lit(prefix).alias("entity_type"), F.col(key).cast("string").alias("entity_id"))
        for prefix, key in roles.entities.items()
    ])
    return txns.select(
        F.col(roles.row_id).alias("row_id"), F.col(roles.time).alias("t"), F.col(roles.amount).alias("amount"),
        F.explode(pairs).alias("e"),
    ).select("e.entity_type", "e.entity_id", "row_id", "t", "amount").where(F.col("entity_id").isNotNull())


def entity_features(txns: DataFrame, roles: StreamRoles, seed: DataFrame | None = None, **options) -> DataFrame:
    """Features per (transaction, entity); ``seed`` is the initial state from history."""
    keys = ["entity_type", "entity_id"]
    return entity_rows(txns, roles).groupBy(*keys).transformWithStateInPandas(
        EntityFeatures(ticks=roles.ticks, **options), feature_schema(), "append", "ProcessingTime",
        initialState=None if seed is None else seed.groupBy(*keys),
    )


def with_entity_features(txns: DataFrame, roles: StreamRoles, seed: DataFrame | None = None, **options) -> DataFrame:
    """Transactions and their features in one stream; :func:`assemble` puts a micro-batch together."""
    features = entity_features(txns, roles, seed, **options).withColumnRenamed("t", "_t")
    return txns.withColumn("_kind", F.lit("txn")).unionByName(
        features.withColumn("_kind", F.lit("features")), allowMissingColumns=True
    )


def assemble(batch: DataFrame, columns: list[str], roles: StreamRoles) -> DataFrame:
    """One row per transaction: its columns, and ``{prefix}_{feature}`` of every entity.

    A transaction without an entity gets the values of a first-seen one."""
    txns = batch.where("_kind = 'txn'").select(*columns)
    features = batch.where("_kind = 'features'").groupBy("row_id").agg(*[
        F.max(F.when(F.col("entity_type") == prefix, F.col(f))).alias(f"{prefix}_{f}")
        for prefix in roles.entities for f in FEATURES
    ])
    out = txns.join(features, txns[roles.row_id] == features["row_id"], "left").drop(features["row_id"])
    for prefix in roles.entities:
        out = first_seen_defaults(out, prefix, VELOCITY_WINDOWS)
    return out


def write_batch(df: DataFrame, path: str, epoch: int, partition: list[str] = ()) -> None:
    """Write a micro-batch under its number: a repeated attempt replaces its own rows."""
    numbered = df.withColumn("batch", F.lit(epoch))
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *partition).parquet(path)


def live_state(session: SparkSession, checkpoint: str, variable: str = "stats") -> DataFrame:
    """What the state of a feature stream holds: one row per entity (``stats``), or per entity and hour (``hours``)."""
    return session.read.format("statestore").option("stateVarName", variable).load(checkpoint)


def start_features(
    txns: DataFrame, roles: StreamRoles, path: str, checkpoint: str, seed: DataFrame | None = None, **options
) -> StreamingQuery:
    """Keep a table of transactions with their stateful features."""
    columns = txns.columns

    def write(batch: DataFrame, epoch: int) -> None:
        # both halves of the batch are read: without persisting, the state would be processed twice
        batch = batch.persist()
        try:
            write_batch(assemble(batch, columns, roles), path, epoch)
        finally:
            batch.unpersist()

    stream = with_entity_features(txns, roles, seed, **options)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass(frozen=True)
class ScoringLogs:
    """Paths of the scored-feature log, the raw audit log, the drift log and the rejected records."""

    scored: str
    audit: str
    drift: str
    rejected: str


def start_scoring(
    txns: DataFrame,
    roles: StreamRoles,
    logs: ScoringLogs,
    checkpoint: str,
    features: Callable[[DataFrame], DataFrame],
    score: Callable[[DataFrame], DataFrame],
    threshold: float,
    model_version: str,
    monitored: list[str],
    seed: DataFrame | None = None,
    resent: str | None = "7 days",
) -> StreamingQuery:
    """Validate, read features from state, add row features, score, decide, and write the logs.

    ``features`` adds what the row alone gives, ``score`` adds the column ``score``. Logs are
    partitioned by micro-batch and day; the 30-day retention of the drift log is applied on reading. An id that is sent
    again within ``resent`` of its arrival is neither scored nor counted a second time; None scores every row.
    """
    columns = txns.columns
    valid, rejected = split_valid(txns, roles.row_id, roles.time, roles.amount)
    if resent:
        valid = distinct_rows(valid, roles, resent)
    stream = with_entity_features(valid, roles, seed).unionByName(
        rejected.withColumn("_kind", F.lit("rejected")), allowMissingColumns=True
    )

    def write(batch: DataFrame, epoch: int) -> None:
        batch, scored = batch.persist(), None
        try:
            ready = features(assemble(batch, columns, roles))
            day = F.floor(F.col(roles.time) / F.lit(DAY * roles.ticks)).cast("long")
            scored = score(ready).withColumns({
                "fraud_probability": F.round("score", 6), "is_fraud": decision(F.col("score"), threshold),
                "risk_level": risk_level(F.col("score")), "threshold_used": F.round(F.lit(threshold), 4),
                "model_version": F.lit(model_version), "scored_at": F.current_timestamp(), "day": day,
            }).persist()
            decided = ["fraud_probability", "is_fraud", "risk_level", "threshold_used", "model_version"]
            online = [f"{p}_{f}" for p in roles.entities for f in FEATURES]
            keys = list(dict.fromkeys([roles.row_id, roles.time, roles.amount, *roles.entities.values()]))
            write_batch(scored.select(*keys, *decided, "scored_at", *online, "day"), logs.scored, epoch, ["day"])
            write_batch(scored.select(*columns, *decided, "day"), logs.audit, epoch, ["day"])
            watched = [c for c in monitored if c in scored.columns and c not in (roles.row_id, roles.time)]
            write_batch(scored.select(roles.row_id, roles.time, *watched, "day"), logs.drift, epoch, ["day"])
            write_batch(batch.where("_kind = 'rejected'").select(*columns, "reason"), logs.rejected, epoch)
        finally:
            if scored is not None:
                scored.unpersist()
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
