"""Matrix-factorisation pipeline: ratings table -> 80/20 row split -> bias + ALS ->
RMSE/MAE -> ranked test submission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import mf, split
from ..sources import model_store
from ..sources.registry import Registry
from ..sources.sinks import generate_submission, read_processed, write_processed


def make_dataset(train: DataFrame, test: DataFrame, out_dir: str) -> tuple[str, str]:
    """Write both tables as one published version; returns their paths."""
    ratings, pairs = mf.preprocess_data(train, test)

    def write(folder: str) -> None:
        write_processed(ratings, f"{folder}/ratings")
        write_processed(pairs, f"{folder}/test_pairs")

    path = Registry(train.sparkSession, out_dir, "mf_tables").publish(write)
    return f"{path}/ratings", f"{path}/test_pairs"


def newest_dataset(spark: SparkSession, out_dir: str) -> tuple[str, str]:
    """Paths of the newest published tables."""
    path = Registry(spark, out_dir, "mf_tables").newest()
    if path is None:
        raise FileNotFoundError(f"no published tables under {out_dir}")
    return f"{path}/ratings", f"{path}/test_pairs"


def train(spark: SparkSession, ratings_path: str, tune: bool = False, model_dir: str | None = None,
          **params) -> tuple[mf.MFModel, DataFrame]:
    """Fit on 80% of the rating rows, report RMSE/MAE on the rest, optionally save."""
    ratings = read_processed(spark, ratings_path)
    if tune:
        grid = mf.tune_mf(ratings)
        best = grid.orderBy("rmse").first()
        params = {"rank": best["rank"], "max_iter": best["max_iter"], "reg": best["reg_param"]}
    fit, held = split.random_split(ratings, 20, 42)
    model = mf.fit_mf(fit, **params)
    if model_dir:
        Registry(spark, model_dir, "svd_model").publish(lambda folder: model_store.save_mf_model(model, folder))
    return model, mf.rating_error(mf.predict_mf(model, held))


def predict(spark: SparkSession, model: mf.MFModel | None, pairs_path: str, out_dir: str,
            model_dir: str | None = None) -> str:
    """Rank test pairs; without a model, the newest one saved under ``model_dir`` is used."""
    if model is None:
        path = Registry(spark, model_dir, "svd_model").newest() if model_dir else None
        if path is None:
            raise FileNotFoundError(f"no saved model under {model_dir}")
        model = model_store.load_mf_model(spark, path)
    pairs = read_processed(spark, pairs_path)
    return generate_submission(mf.predict_mf(model, pairs), "prediction", out_dir)
