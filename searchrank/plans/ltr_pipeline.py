"""Learning-to-rank pipeline: processed tables -> date parts -> group fold ->
boosted ranker -> validation metrics and baselines -> ranked test submission."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import preprocess
from ..operators import features, ltr, metrics, split
from ..schema import TARGET_COL
from ..sources import model_store
from ..sources.registry import Registry
from ..sources.sinks import generate_submission, log_evaluation_summary, metrics_frame, read_processed


@dataclass
class LTRRun:
    model: ltr.LTRModel
    metrics: DataFrame
    submission_path: str | None


def evaluate(model: ltr.LTRModel, val: DataFrame, k: int = 5) -> DataFrame:
    """Model NDCG two ways plus the price and star-rating baselines, in one row."""
    scored = ltr.predict_ltr(model, val)
    return metrics_frame({
        "ndcg_at_5": metrics.ndcg_tie(scored, k, "pred", TARGET_COL),
        "ndcg_at_5_helpers": metrics.ndcg_binary(scored, k, "pred", TARGET_COL),
        "price_baseline": metrics.baseline_ndcg(val, "price_usd", "asc", k),
        "rating_baseline": metrics.baseline_ndcg(val, "prop_starrating", "desc", k),
    })


def run(spark: SparkSession, train_path: str, test_path: str | None = None, out_dir: str | None = None,
        fold: int = 0, n_trees: int = 5000, max_depth: int = 12, learning_rate: float = 0.03, k: int = 5,
        model_dir: str | None = None, **params) -> LTRRun:
    """``params`` go to :func:`ltr.fit_ltr` (leaves, leaf size, patience, row and column sample, L2, child weight).

    With ``model_dir`` the fitted ranker is published there as the newest version.
    """
    train = preprocess(read_processed(spark, train_path))
    fit, val = split.group_kfold(train, 5, fold)
    feats = features.feature_columns(train)
    model = ltr.fit_ltr(fit, feats, TARGET_COL, valid=val, k=k, n_trees=n_trees, max_depth=max_depth,
                        learning_rate=learning_rate, **params)
    if model_dir:
        Registry(spark, model_dir, "ranker").publish(lambda folder: model_store.save_ltr_model(spark, model, folder))
    row = evaluate(model, val, k)
    path = None
    if out_dir:
        log_evaluation_summary(row, f"{out_dir.rstrip('/')}/metrics")
        if test_path:
            test = preprocess(read_processed(spark, test_path))
            score = row.select(F.col("ndcg_at_5")).first()[0]
            path = generate_submission(ltr.predict_ltr(model, test), "pred", f"{out_dir.rstrip('/')}/submissions",
                                       ndcg=score)
    return LTRRun(model, row, path)


def predict(spark: SparkSession, test_path: str, out_dir: str, model_dir: str) -> str:
    """Rank the test table with the newest ranker saved under ``model_dir``."""
    path = Registry(spark, model_dir, "ranker").newest()
    if path is None:
        raise FileNotFoundError(f"no saved ranker under {model_dir}")
    test = preprocess(read_processed(spark, test_path))
    return generate_submission(ltr.predict_ltr(model_store.load_ltr_model(spark, path), test), "pred", out_dir)
