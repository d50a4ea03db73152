"""Property aggregate features and the model feature list.

``feature_engineering`` follows the original order of work: type both sets,
impute each set on its own, align and concatenate them, compute per-property
statistics over the combined, already imputed values, and attach them to both
sets with a left join on ``prop_id``.

Scale: the aggregate has one row per property.  Spark broadcasts it when its
estimated size is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise
runs a sort-merge join (AQE splits a skewed property).  Exact medians come from a
range-partitioned histogram, so no task holds all values of a property.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ITEM_COL, NON_FEATURE_COLUMNS, property_columns
from ..sources.searchlog import apply_dtypes
from .align import align_columns
from .impute import mean_fill, median_fill
from .selection import MEDIAN_ROWS, hot_group_medians
from .skew import HotKeys, find_hot, join_per_key, split_by_keys

DERIVED_SUFFIXES = ("_mean", "_median", "_std")


def base_property_columns(df: DataFrame) -> list[str]:
    """Property attributes of the input (derived ``_mean/_median/_std`` excluded)."""
    return [c for c in property_columns(df.columns) if not c.endswith(DERIVED_SUFFIXES)]


def property_stats(df: DataFrame, cols: list[str], mean: bool = True, median: bool = True,
                   std: bool = True, key: str = ITEM_COL, hot: HotKeys | None = None) -> DataFrame:
    """One row per property: means, medians and deviations by one aggregate, medians of hot properties by histogram."""
    flags = (("mean", mean, F.avg), ("median", median, F.median), ("std", std, F.stddev_samp))

    def stats(rows: DataFrame, *without: str) -> DataFrame:
        exprs = [fn(F.col(c).cast("double")).alias(f"{c}_{s}") for s, on, fn in flags if on and s not in without for c in cols]
        return rows.groupBy(key).agg(*exprs) if exprs else rows.select(key).distinct()

    if not median:
        return stats(df)
    hot = find_hot(df, key, MEDIAN_ROWS) if hot is None else hot
    normal, heavy = split_by_keys(df, HotKeys(hot.keys, hot.count), key)
    out = stats(normal)
    if hot.count:
        medians = hot_group_medians(heavy, key, cols, [f"{c}_median" for c in cols])
        out = out.unionByName(stats(heavy, "median").join(medians, key, "left"))
    return out


def hot_properties(*frames: DataFrame, key: str = ITEM_COL) -> HotKeys:
    """Properties above ``MEDIAN_ROWS`` rows in all frames together: one pass, good for each of them."""
    keys = frames[0].select(key)
    for df in frames[1:]:
        keys = keys.unionByName(df.select(key))
    return find_hot(keys, key, MEDIAN_ROWS)


def _combined_stat(train: DataFrame, test: DataFrame, cols: list[str], **flags) -> tuple[DataFrame, DataFrame]:
    a, b = align_columns(train, test)
    hot = hot_properties(a, b)
    stats = property_stats(a.unionByName(b), cols, hot=hot, **flags)
    return join_per_key(a, stats, ITEM_COL, "left", hot=hot), stats


def add_mean_features(train: DataFrame, test: DataFrame, cols: list[str]) -> DataFrame:
    return _combined_stat(train, test, cols, mean=True, median=False, std=False)[0]


def add_median_features(train: DataFrame, test: DataFrame, cols: list[str]) -> DataFrame:
    return _combined_stat(train, test, cols, mean=False, median=True, std=False)[0]


def add_std_features(train: DataFrame, test: DataFrame, cols: list[str]) -> DataFrame:
    return _combined_stat(train, test, cols, mean=False, median=False, std=True)[0]


def feature_engineering(train: DataFrame, test: DataFrame, fill_means: bool = True, fill_medians: bool = False,
                        add_mean: bool = True, add_median: bool = True, add_std: bool = True,
                        agg_columns: list[str] | None = None, apply_types: bool = True
                        ) -> tuple[DataFrame, DataFrame]:
    """Impute, then attach per-property statistics to both sets."""
    if apply_types:
        train = apply_dtypes(train, is_train=True)
        test = apply_dtypes(test, is_train=False)
    cols = agg_columns if agg_columns is not None else base_property_columns(train)
    hot = hot_properties(train, test)  # imputation keeps every row and key
    if fill_means:
        train, test = mean_fill(train, cols, hot=hot), mean_fill(test, cols, hot=hot)
    if fill_medians:
        train, test = median_fill(train, cols, hot=hot), median_fill(test, cols, hot=hot)
    train, test = align_columns(train, test)
    if add_mean or add_median or add_std:
        stats = property_stats(train.unionByName(test), cols, add_mean, add_median, add_std, hot=hot)
        train = join_per_key(train, stats, ITEM_COL, "left", hot=hot)
        test = join_per_key(test, stats, ITEM_COL, "left", hot=hot)
    return train, test


def feature_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    """Model features: every column but ids, target and leak columns."""
    drop = set(NON_FEATURE_COLUMNS if exclude is None else exclude)
    return [c for c in df.columns if c not in drop]
