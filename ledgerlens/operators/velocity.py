"""Trailing-window counts and sums per key."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerlens.config import VELOCITY_WINDOWS
from ledgerlens.operators.keyed import Keyed, keyed_features


def velocity_columns(prefix: str, windows: dict[str, int] = VELOCITY_WINDOWS) -> list[str]:
    return [f"{prefix}_{kind}_{name}" for name in windows for kind in ("count", "amt_sum")]


def velocity(
    df: DataFrame,
    spec: Keyed,
    prefix: str | None = None,
    windows: dict[str, int] = VELOCITY_WINDOWS,
    null_key: str = "null",
    **tuning,
) -> DataFrame:
    """``{prefix}_count_*`` and ``{prefix}_amt_sum_*`` over ``[t - w, t)``.

    Rows of the same instant do not see each other. Rows without a key get nulls, or zeros with
    ``null_key="zero"``.
    """
    out = keyed_features(df, spec, windows=windows, prefix=prefix, **tuning)
    if null_key == "zero":
        out = out.fillna(0, subset=velocity_columns(prefix or spec.key, windows))
    return out
