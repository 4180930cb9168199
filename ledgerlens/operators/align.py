"""Column selection and schema alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.config import ID, LABEL, MAX_NULL_RATE, NON_FEATURE_COLUMNS, TIME
from ledgerlens.functions.scalars import nan_to_null

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def without_identifiers(df: DataFrame, columns: list[str] = (ID, LABEL, TIME)) -> DataFrame:
    return df.drop(*columns)


def null_rates(df: DataFrame) -> DataFrame:
    """``(column, null_rate)`` of every column in one pass, highest first."""
    rates = F.array(*[
        F.struct(F.lit(c).alias("column"), F.avg(F.col(f"`{c}`").isNull().cast("double")).alias("null_rate"))
        for c in df.columns
    ])
    return df.agg(F.explode(rates).alias("r")).select("r.*").orderBy(F.col("null_rate").desc(), "column")


def feature_columns(
    df: DataFrame, drop: list[str] = NON_FEATURE_COLUMNS, max_null_rate: float = MAX_NULL_RATE
) -> list[str]:
    """Columns for model input, in table order: not dropped, not text, null rate at most the bound."""
    candidates = [
        f.name for f in df.schema.fields if f.name not in set(drop) and not isinstance(f.dataType, T.StringType)
    ]
    if not candidates:
        return []
    rates = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in candidates]).first()
    return [c for c in candidates if rates[c] is None or rates[c] <= max_null_rate]


def select_features(df: DataFrame, keep: list[str] = (), **options) -> DataFrame:
    return df.select(*keep, *feature_columns(df, **options))


def align_to_columns(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """Exactly the trained columns in their order, all double; missing ones are null."""
    return df.select(*keep, *[
        (F.col(c) if c in df.columns else F.lit(None)).cast("double").alias(c) for c in columns
    ])


def align_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of another table in its order; missing ones are null, extra ones go."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def normalise_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floats}) if floats else df


def widen_integers(df: DataFrame) -> DataFrame:
    return df.withColumns({
        f.name: F.col(f.name).cast("double") for f in df.schema.fields if isinstance(f.dataType, INTEGERS)
    })


def union_all(*frames: DataFrame) -> DataFrame:
    """Append by column name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_feature_list(df: DataFrame, columns: list[str], path: str) -> None:
    """Store the trained column list with its order."""
    rows = [(i, c) for i, c in enumerate(columns)]
    df.sparkSession.createDataFrame(rows, "position int, name string").coalesce(1).write.mode("overwrite").parquet(path)


def read_feature_list(spark, path: str) -> list[str]:
    """The stored list in order; a plain text list works too, blank lines are ignored."""
    if path.endswith(".txt"):
        names = spark.read.text(path, wholetext=True).first()[0].splitlines()
    else:
        names = [r["name"] for r in spark.read.parquet(path).orderBy("position").collect()]
    return [n.strip() for n in names if n.strip()]
