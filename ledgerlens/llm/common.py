"""What several of the operators need: words, shared paths, and rows with their columns kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# words are separated by space and the ASCII control characters from tab to carriage return
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Number of words; 0 for a null text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only ``columns`` of ``df``: other columns, whatever their names, cannot clash with the operator's own."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df.select(*columns)


def own_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
