"""Registered queries: a Spark function on the driver's tables, and SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import micros

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Doubles are compared at six places. The shift keeps decimal halves off the rounding boundary, where
# the order of a sum would decide the last digit; adding zero turns -0.0 into 0.0.
SHIFT = "1.7e-8"


def near(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(float(SHIFT)), digits) + F.lit(0.0)


def near_sql(expression: str, digits: int = 6) -> str:
    return f"(round(({expression}) + {SHIFT}, {digits}) + 0.0)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# the event table in the roles of a transaction table; sign-ups carry no key
EVENTS_SQL = """
SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t,
       CASE WHEN event_type = 'signup' THEN NULL ELSE user_id END AS maybe_user,
       CAST(event_type = 'purchase' AS INT) AS label, value / (1 + value) AS score
FROM events"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.select(
        "event_id", "user_id", "event_type", "value", micros(df, "ts").alias("t"),
        F.when(F.col("event_type") != "signup", F.col("user_id")).alias("maybe_user"),
        (F.col("event_type") == "purchase").cast("int").alias("label"),
        (F.col("value") / (1 + F.col("value"))).alias("score"),
    )


ORDERS_SQL = """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority, epoch_us(o_orderdate) AS t,
       CAST(o_totalprice > 250000 AS INT) AS label
FROM orders"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    return df.select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority",
        micros(df, "o_orderdate").alias("t"), (F.col("o_totalprice") > 250000).cast("int").alias("label"),
    )


SECOND = 1_000_000
HOUR_US, DAY_US, WEEK_US = 3600 * SECOND, 86400 * SECOND, 7 * 86400 * SECOND
EPOCH_2024 = 1_704_067_200 * SECOND
