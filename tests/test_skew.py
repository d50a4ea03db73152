"""Hot keys: the split join and hot-path gradients equal the plain versions."""

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from searchrank.operators import ltr, ranking, selection, skew


def test_join_per_key_with_hot_key(spark):
    rows = [(1, i) for i in range(500)] + [(k, i) for k in range(2, 60) for i in range(3)] + [(None, 0)]
    big = spark.createDataFrame(rows, "prop_id long, v int")
    per_key = spark.createDataFrame([(k, float(k) / 2) for k in range(1, 40)], "prop_id long, m double")
    plain = sorted(map(tuple, big.join(per_key, "prop_id", "left").collect()), key=str)
    split = sorted(map(tuple, skew.join_per_key(big, per_key, "prop_id", "left", threshold=50).collect()), key=str)
    assert plain == split
    inner = skew.join_per_key(big, per_key, "prop_id", "inner", threshold=50)
    assert inner.count() == big.join(per_key, "prop_id").count()


def test_lambda_gradients_hot_path(spark):
    rng = np.random.default_rng(9)
    recs = [(0, j, float(rng.normal()), int(rng.choice([0, 1, 5]))) for j in range(400)]
    recs += [(s, j, float(rng.normal()), int(rng.choice([0, 0, 1]))) for s in range(1, 30) for j in range(6)]
    df = spark.createDataFrame(pd.DataFrame(recs, columns=["srch_id", "prop_id", "score", "rel"]))
    a = {(r[0], r[1]): (round(r[2], 12), round(r[3], 12)) for r in
         ltr.lambda_gradients(df, "score", "rel", 5, id_cols=("prop_id",), hot_threshold=None)
         .select("srch_id", "prop_id", "lambda", "hessian").collect()}
    b = {(r[0], r[1]): (round(r[2], 12), round(r[3], 12)) for r in
         ltr.lambda_gradients(df, "score", "rel", 5, id_cols=("prop_id",), hot_threshold=100)
         .select("srch_id", "prop_id", "lambda", "hessian").collect()}
    assert a == b


def test_hot_null_key_is_set_apart(spark):
    rows = [(None, i) for i in range(300)] + [(1, i) for i in range(200)] + [(k, 0) for k in range(2, 40)]
    big = spark.createDataFrame(rows, "prop_id long, v int")
    per_key = spark.createDataFrame([(k, float(k)) for k in range(1, 30)], "prop_id long, m double")
    hot = skew.find_hot(big, "prop_id", 50)
    assert (hot.count, hot.null) == (1, True)
    for how in ("left", "inner"):
        plain = sorted(map(tuple, big.join(per_key, "prop_id", how).collect()), key=str)
        assert sorted(map(tuple, skew.join_per_key(big, per_key, "prop_id", how, threshold=50).collect()), key=str) == plain


def test_too_many_hot_keys_are_salted(spark, monkeypatch):
    monkeypatch.setattr(skew, "MAX_BROADCAST_KEYS", 1)
    rows = [(k, i) for k in range(5) for i in range(100)] + [(k, 0) for k in range(5, 40)]
    big = spark.createDataFrame(rows, "prop_id long, v int")
    per_key = spark.createDataFrame([(k, float(k)) for k in range(1, 30)], "prop_id long, m double")
    plain = sorted(map(tuple, big.join(per_key, "prop_id", "left").collect()), key=str)
    assert sorted(map(tuple, skew.join_per_key(big, per_key, "prop_id", "left", threshold=50).collect()), key=str) == plain


def test_hot_null_group_is_ranked_apart(spark):
    rows = [(None, i % 7, i) for i in range(300)] + [(1, i % 5, i) for i in range(30)]
    df = spark.createDataFrame(rows, "srch_id long, s int, prop_id long").withColumn("price_usd", F.lit(1.0))
    order = ranking.order_spec("s")
    a = sorted(map(tuple, ranking.rank_within(df, order, hot_threshold=None).collect()), key=str)
    assert sorted(map(tuple, ranking.rank_within(df, order, hot_threshold=50).collect()), key=str) == a


def test_group_medians_with_a_hot_property(spark):
    rng = np.random.default_rng(4)
    rows = [(1, float(x), None if x > 1 else 2.0) for x in rng.normal(size=3001)]
    rows += [(int(k), float(v), float(v)) for k in range(2, 50) for v in rng.integers(0, 5, rng.integers(1, 9))]
    rows += [(99, None, None), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "prop_id long, a double, b double").repartition(4)
    for hot_rows in (1000, 10**6):  # with and without a hot property
        check_medians(df, rows, hot_rows)


def check_medians(df, rows, hot_rows):
    got = {r["prop_id"]: (r["ma"], r["mb"]) for r in selection.group_medians(df, "prop_id", ["a", "b"], ["ma", "mb"], hot_rows=hot_rows).collect()}
    want = pd.DataFrame(rows, columns=["k", "a", "b"]).dropna(subset=["k"]).groupby("k").median()
    assert set(got) == {int(k) for k in want.index} - {99}
    for k, (a, b) in got.items():
        assert abs(a - want.loc[k, "a"]) < 1e-12 and abs(b - want.loc[k, "b"]) < 1e-12


def test_property_statistics_with_hot_properties(spark, monkeypatch):
    from searchrank.operators import features, impute

    rng = np.random.default_rng(5)
    rows = [(k % 60, int(rng.choice([1, 1, 1, 2, 3, 4])), *[float(x) if rng.random() < 0.8 else None for x in rng.integers(0, 9, 2)]) for k in range(900)]
    rows += [(7, None, 1.0, None), (8, 50, None, None)]
    df = spark.createDataFrame(rows, "srch_id int, prop_id int, prop_a double, prop_b double").repartition(3)
    cols = ["prop_a", "prop_b"]

    def result():
        out = [features.property_stats(df, cols), impute.median_fill(df, cols), features.add_median_features(df, df.drop("srch_id"), cols)]
        return [sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in o.select(sorted(o.columns)).collect()], key=str) for o in out]
    plain = result()
    for module in (features, impute):
        monkeypatch.setattr(module, "MEDIAN_ROWS", 200)  # property 1 is hot
    assert result() == plain
