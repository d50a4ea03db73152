"""End to end: raw CSV -> features -> ranker -> metrics + submission."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from searchrank.plans import eda, feature_pipeline, ltr_pipeline, mf_pipeline
from searchrank.sources import fixture, searchlog


def _raw(spark, scratch):
    train_csv, test_csv = os.path.join(scratch, "train_csv"), os.path.join(scratch, "test_csv")
    searchlog.write_raw_csv(fixture.train_log(spark, SF_SMALL), train_csv)
    searchlog.write_raw_csv(fixture.test_log(spark, SF_SMALL), test_csv)
    return train_csv, test_csv


def test_feature_and_ltr_pipelines(spark, scratch):
    train_csv, test_csv = _raw(spark, scratch)
    tr_path, te_path = feature_pipeline.run(spark, train_csv, test_csv, os.path.join(scratch, "processed"))
    tr = spark.read.parquet(tr_path)
    assert "prop_review_score_median" in tr.columns and tr.where(F.col("prop_review_score").isNull()).count() == 0
    run = ltr_pipeline.run(spark, tr_path, te_path, os.path.join(scratch, "out"), n_trees=3, max_depth=3, learning_rate=0.1)
    row = run.metrics.first().asDict()
    assert set(row) == {"ndcg_at_5", "ndcg_at_5_helpers", "price_baseline", "rating_baseline"}
    assert all(0.0 <= v <= 1.0 for v in row.values())
    sub = spark.read.option("header", True).csv(run.submission_path)
    assert sub.columns == ["srch_id", "prop_id"]
    assert sub.count() == spark.read.parquet(te_path).count()


def test_mf_pipeline(spark, scratch):
    paths = mf_pipeline.make_dataset(fixture.train_log(spark, SF_SMALL), fixture.test_log(spark, SF_SMALL),
                                     os.path.join(scratch, "mf"))
    model_dir = os.path.join(scratch, "models")
    model, err = mf_pipeline.train(spark, paths[0], model_dir=model_dir, rank=5, max_iter=5, reg=0.1)
    e = err.first()
    assert e["rmse"] >= e["mae"] >= 0
    out = mf_pipeline.predict(spark, None, paths[1], os.path.join(scratch, "mf_sub"), model_dir=model_dir)
    assert spark.read.option("header", True).csv(out).count() == spark.read.parquet(paths[1]).count()


def test_eda_tables(spark):
    tables = eda.run(fixture.train_log(spark, SF_SMALL))
    assert {r["column"] for r in tables["missing_values"].collect()} == {"prop_review_score", "prop_location_score2"}
    assert tables["click_booking_relation"].agg(F.sum("count")).first()[0] == fixture.train_log(spark, SF_SMALL).count()
