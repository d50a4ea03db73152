"""Feature pipeline: raw CSV -> typed -> (optional cleaning) -> imputed + property
features -> processed Parquet for train and test.

The property statistics are one shared aggregate joined to both sets; both outputs are
written by executors in parallel.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.clean import data_cleaning
from ..operators.features import feature_engineering
from ..sources.searchlog import read_raw_data
from ..sources.sinks import write_processed


def run(spark: SparkSession, train_path: str, test_path: str, out_dir: str, clean: bool = False,
        fill_means: bool = True, fill_medians: bool = False, add_mean: bool = True, add_median: bool = True,
        add_std: bool = True) -> tuple[str, str]:
    train, test = read_raw_data(spark, train_path, test_path)
    if clean:
        from ..sources.searchlog import apply_dtypes
        train = data_cleaning(apply_dtypes(train, is_train=True))
    train_f, test_f = feature_engineering(train, test, fill_means, fill_medians, add_mean, add_median, add_std)
    out = out_dir.rstrip("/")
    return (write_processed(train_f, f"{out}/train_features"), write_processed(test_f, f"{out}/test_features"))
