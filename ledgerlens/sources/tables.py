"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.config import DAY, TIME
from ledgerlens.operators.align import normalise_nan


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and a declared schema; missing fields and NaN are null."""
    return normalise_nan(spark.read.schema(schema).option("header", True).csv(path))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return normalise_nan(df.select(*columns) if columns else df)


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet by its suffix, CSV otherwise."""
    if path.rstrip("/").endswith(".parquet"):
        return read_parquet(spark, path)
    if schema is None:
        raise ValueError("a CSV source needs a schema")
    return read_csv(spark, path, schema)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; records that do not parse keep their text in ``_corrupt_record``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return normalise_nan(
        spark.read.schema(full).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    )


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_bytes: int = 1 << 30,
    max_files: int | None = None,
) -> DataFrame:
    """Transactions that arrive as files; any other streaming source with the schema serves as well.

    ``max_bytes`` (or ``max_files``) bounds a micro-batch, and with it the rows that one entity can bring to one task.
    """
    limit = {"maxFilesPerTrigger": max_files} if max_files else {"maxBytesPerTrigger": max_bytes}
    return spark.readStream.schema(schema).format(fmt).options(**limit).load(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_any(df: DataFrame, path: str) -> None:
    """Parquet by its suffix, CSV with a header otherwise."""
    if path.rstrip("/").endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").option("header", True).csv(path)


def day_of(time: str = TIME, ticks: int = 1) -> Column:
    return F.floor(F.col(time) / F.lit(DAY * ticks)).cast("long")


def append_log(df: DataFrame, path: str, time: str = TIME, ticks: int = 1, day: str = "day") -> None:
    """Append to a log partitioned by day, so that retention and drift read only the days they need.

    Rebalancing gathers a day's rows into few files and splits a busy day over several tasks.
    """
    dated = df.withColumn(day, day_of(time, ticks)).hint("rebalance", F.col(day))
    dated.write.mode("append").partitionBy(day).parquet(path)


def scored_log_rows(scored: DataFrame) -> DataFrame:
    """Rows of the scored-feature log: probability to six places and the time of scoring."""
    return scored.withColumns({
        "fraud_probability": F.round("fraud_probability", 6), "scored_at": F.current_timestamp(),
    })


def write_encodings(table: DataFrame, path: str) -> None:
    table.select("column", "category", "smoothed_mean", "global_mean").write.mode("overwrite").parquet(path)


def read_encodings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_drift_report(report: DataFrame, summary: DataFrame, folder: str) -> None:
    """The per-feature report as JSON of this run, and one summary row appended to the history."""
    stamped = summary.withColumn("timestamp", F.current_timestamp())
    report.withColumn("timestamp", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{folder}/reports")
    stamped.coalesce(1).write.mode("append").option("header", True).csv(f"{folder}/history")
