"""Outlier filter and constant fill.

The price bounds are scalars computed by exact distributed selection (nearest
rank over non-null values); the filter is then a literal comparison, which Spark
pushes into the Parquet scan.  Rows with a NULL price fail the comparison and are
dropped, as in the original filter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .selection import nearest_quantiles

IQR_FACTOR = 1.5


@dataclass
class IqrBounds:
    q1: float | None
    q3: float | None

    @property
    def iqr(self) -> float | None:
        return None if self.q1 is None else self.q3 - self.q1

    @property
    def upper(self) -> float | None:
        return None if self.q1 is None else self.q3 + IQR_FACTOR * self.iqr


def iqr_bounds(df: DataFrame, col: str = "price_usd") -> IqrBounds:
    q = nearest_quantiles(df, col, [0.25, 0.75])
    return IqrBounds(q[0.25], q[0.75])


def iqr_filter(df: DataFrame, col: str = "price_usd", bounds: IqrBounds | None = None) -> DataFrame:
    """Keep rows with ``col <= Q3 + 1.5 IQR`` (upper side only)."""
    b = bounds or iqr_bounds(df, col)
    if b.upper is None:
        return df.where(F.lit(False))
    return df.where(F.col(col) <= F.lit(b.upper))


def fill_zero(df: DataFrame, cols: list[str] | tuple[str, ...] = ("prop_review_score",)) -> DataFrame:
    """NULL becomes 0; NaN is a value and stays."""
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in cols if c in df.columns}
    return df.withColumns(zero) if zero else df


def data_cleaning(df: DataFrame, col: str = "price_usd") -> DataFrame:
    """Outlier filter on price, then missing review score -> 0."""
    return fill_zero(iqr_filter(df, col))
