"""Model save / load round trips and newest-model lookup."""

import datetime
import os

import numpy as np
import pandas as pd
import pytest

from searchrank.operators import ltr, mf
from searchrank.sources import model_store


def _ratings(spark):
    rng = np.random.default_rng(11)
    rows = [(int(u), int(i), int(rng.choice([0, 1, 5]))) for u in range(40) for i in rng.choice(30, 6, replace=False)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["srch_id", "prop_id", "rating"]))


def test_mf_round_trip_and_newest(spark, scratch):
    ratings = _ratings(spark)
    model = mf.fit_mf(ratings, rank=4, max_iter=3, reg=0.1)
    old = os.path.join(scratch, model_store.model_name("svd_model", datetime.datetime(2024, 1, 1)))
    new = os.path.join(scratch, model_store.model_name("svd_model", datetime.datetime(2025, 6, 1)))
    model_store.save_mf_model(model, old)
    model_store.save_mf_model(model, new)
    assert model_store.newest_model(spark, scratch, "svd_model") == new
    loaded = model_store.load_mf_model(spark, new)
    a = {(r[0], r[1]): r[2] for r in mf.predict_mf(model, ratings).select("srch_id", "prop_id", "prediction").collect()}
    b = {(r[0], r[1]): r[2] for r in mf.predict_mf(loaded, ratings).select("srch_id", "prop_id", "prediction").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_ltr_round_trip(spark, scratch):
    rng = np.random.default_rng(12)
    rows = [(s, j, float(rng.normal()), int(rng.random() < 0.2)) for s in range(60) for j in range(6)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["srch_id", "prop_id", "x", "booking_bool"]))
    model = ltr.fit_ltr(df, ["x"], "booking_bool", n_trees=2, max_depth=2, min_instances=2)
    path = model_store.save_ltr_model(spark, model, os.path.join(scratch, "ltr_model_x"))
    loaded = model_store.load_ltr_model(spark, path)
    a = sorted(r[0] for r in ltr.predict_ltr(model, df).select("pred").collect())
    b = sorted(r[0] for r in ltr.predict_ltr(loaded, df).select("pred").collect())
    assert np.allclose(a, b)


def test_publishers_get_numbers_of_their_own(spark, scratch):
    from concurrent.futures import ThreadPoolExecutor

    from searchrank.sources.registry import Registry

    def publish(k):
        return Registry(spark, scratch, "model").publish(lambda folder: spark.range(k, k + 1).write.parquet(f"{folder}/part"))

    with ThreadPoolExecutor(4) as pool:
        paths = list(pool.map(publish, range(8)))
    registry = Registry(spark, scratch, "model")
    assert len(set(paths)) == 8 and registry.versions() == list(range(1, 9))
    assert sorted(spark.read.parquet(f"{p}/part").first()[0] for p in paths) == list(range(8))
    last = publish(99)
    assert registry.newest() == last and spark.read.parquet(f"{last}/part").first()[0] == 99
    assert Registry(spark, scratch, "other").newest() is None and Registry(spark, f"{scratch}/none", "model").versions() == []


def test_a_publisher_that_dies_is_not_seen(spark, scratch):
    from searchrank.sources.registry import Registry

    registry = Registry(spark, scratch, "model")
    first = registry.publish(lambda folder: spark.range(1).write.parquet(folder))

    def dies(folder):
        spark.range(2).write.parquet(folder)
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        registry.publish(dies)
    assert registry.newest() == first
    registry.claim()  # one that dies after it took a number
    assert registry.newest() == first
    again = registry.publish(lambda folder: spark.range(3).write.parquet(folder))
    assert registry.newest() == again and registry.versions() == [1, 3] and spark.read.parquet(again).count() == 3
