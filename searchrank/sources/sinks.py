"""Writers for processed tables, submissions and metric rows.

Every writer targets a folder (many part files written in parallel).  Processed
tables are Parquet; the submission is CSV ``srch_id,prop_id`` in rank order: a
global sort whose range partitioning splits a large search across tasks, so part
files concatenated in name order give the final file.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import DEFAULT_TIEBREAK
from ..schema import GROUP_COL, ITEM_COL


def write_processed(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).parquet(path)
    return path


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def submission_frame(df: DataFrame, pred_col: str, tiebreak: Sequence[str] = DEFAULT_TIEBREAK) -> DataFrame:
    """(srch_id, prop_id) sorted by search, then prediction descending."""
    present = [c for c in tiebreak if c in df.columns]
    order = [F.col(GROUP_COL).asc(), F.col(pred_col).desc_nulls_last(), *[F.col(c).asc() for c in present]]
    return df.select(GROUP_COL, ITEM_COL, pred_col, *[c for c in present if c not in (GROUP_COL, ITEM_COL)]) \
        .orderBy(*order).select(GROUP_COL, ITEM_COL)


# The submission's file name (time stamp, three decimals of the score).
def submission_name(ndcg: float | None = None, now: datetime.datetime | None = None) -> str:
    ts = (now or datetime.datetime.now()).strftime("%Y%m%d_%H%M")
    suffix = f"_{ndcg:.3f}" if ndcg is not None else ""
    return f"submission_{ts}{suffix}"


def generate_submission(df: DataFrame, pred_col: str, out_dir: str, name: str | None = None,
                        ndcg: float | None = None) -> str:
    """Write the ranked submission CSV under ``out_dir`` and return its path."""
    path = f"{out_dir.rstrip('/')}/{name or submission_name(ndcg)}.csv"
    submission_frame(df, pred_col).write.mode("overwrite").option("header", True).csv(path)
    return path


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(f"{GROUP_COL} long, {ITEM_COL} long").csv(path)


def metrics_frame(metrics: dict[str, DataFrame]) -> DataFrame:
    """One row, one column per metric, from one-row metric frames (union + pivot)."""
    names = list(metrics)
    parts = [m.select(F.lit(name).alias("metric"), F.col(m.columns[0]).cast("double").alias("value"))
             for name, m in metrics.items()]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return long.groupBy().pivot("metric", names).agg(F.first("value"))


def log_evaluation_summary(metrics: DataFrame, path: str | None = None, mode: str = "overwrite") -> DataFrame:
    """Write the metrics row to a CSV folder when a path is given (``mode='append'`` keeps earlier rows)."""
    if path:
        metrics.coalesce(1).write.mode(mode).option("header", True).csv(path)  # one row
    return metrics


def read_evaluation_summary(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    return spark.read.option("header", True).schema(", ".join(f"{n} double" for n in names)).csv(path)
