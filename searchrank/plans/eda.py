"""Exploratory tables over the log (the data behind the original figures)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.profile import column_profile, run_all_analyses


def run(df: DataFrame) -> dict[str, DataFrame]:
    """Every report; nothing stays cached."""
    return run_all_analyses(df) | {"column_profile": column_profile(df)}
