"""Nearest-rank quantiles, IQR filter, imputation with global fallback, dense index."""

import numpy as np
import pandas as pd

from searchrank.operators import clean, features, impute, selection


def test_values_at_ranks_with_hot_value(spark):
    rng = np.random.default_rng(0)
    vals = np.concatenate([np.full(400, 7.0), rng.normal(size=800).round(3)])
    rng.shuffle(vals)
    df = spark.createDataFrame(pd.DataFrame({"v": vals}))
    s = np.sort(vals)
    ranks = [0, 1, 299, 600, 601, 1199]
    n, got = selection.values_at_ranks(df, "v", ranks)
    assert n == len(vals)
    assert got == [float(s[r]) for r in ranks]


def test_nearest_quantiles_small_counts(spark):
    for n in (1, 2, 3, 4, 5, 7, 10, 11):
        vals = [float(x) for x in range(n, 0, -1)]
        df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "v double")
        q = selection.nearest_quantiles(df, "v", [0.25, 0.75])
        s = sorted(vals)
        assert q[0.25] == s[int(np.floor((n - 1) * 0.25 + 0.5))]
        assert q[0.75] == s[int(np.floor((n - 1) * 0.75 + 0.5))]


def test_iqr_filter_drops_null_and_outliers(spark):
    rows = [(i, float(i)) for i in range(1, 11)] + [(11, 1000.0), (12, None)]
    df = spark.createDataFrame(rows, "id int, price_usd double")
    b = clean.iqr_bounds(df)
    assert (b.q1, b.q3) == (4.0, 9.0)  # 11 values: nearest ranks 3 and 8 (0-based)
    kept = {r["id"] for r in clean.iqr_filter(df, bounds=b).collect()}
    assert kept == set(range(1, 11))


def test_exact_median(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 3, 2]] + [(None,)], "v double")
    assert selection.exact_median(df, "v") == 2.5


def test_mean_fill_group_then_global(spark):
    rows = [(1, 10, 1.0), (2, 10, None), (3, 20, None), (4, None, None), (5, 30, 5.0), (6, 30, 3.0)]
    df = spark.createDataFrame(rows, "id int, prop_id long, x double")
    out = {r["id"]: r["x"] for r in impute.mean_fill(df, ["x"]).collect()}
    assert out[1] == 1.0 and out[5] == 5.0      # non-null values untouched
    assert out[2] == 1.0                        # property mean
    assert out[3] == 3.0 and out[4] == 3.0      # all-null property and NULL key -> global mean (1+5+3)/3


def test_median_fill(spark):
    rows = [(1, 10, 1.0), (2, 10, 4.0), (3, 10, None), (4, 20, None), (5, 30, 9.0)]
    df = spark.createDataFrame(rows, "id int, prop_id long, x double")
    out = {r["id"]: r["x"] for r in impute.median_fill(df, ["x"]).collect()}
    assert out[3] == 2.5 and out[4] == 4.0


def test_property_std_single_row_is_null(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (2, 5.0)], "prop_id long, x double")
    st = {r["prop_id"]: r["x_std"] for r in features.property_stats(df, ["x"], False, False, True).collect()}
    assert st[1] is None and abs(st[2] - np.std([3.0, 5.0], ddof=1)) < 1e-12


def test_dense_index_is_contiguous(spark):
    ids = [10 ** 12 + 7 * i for i in range(300)] * 2
    df = spark.createDataFrame([(i,) for i in ids], "srch_id long")
    idx = selection.dense_index(df, "srch_id", "uidx").orderBy("srch_id").collect()
    assert [r["uidx"] for r in idx] == list(range(300))


def test_iqr_bound_is_pushed_to_parquet_scan(spark, scratch):
    path = f"{scratch}/prices"
    spark.range(1000).selectExpr("id AS srch_id", "CAST(id % 97 AS DOUBLE) AS price_usd", "id AS other") \
        .write.parquet(path)
    kept = clean.iqr_filter(spark.read.parquet(path), "price_usd").select("srch_id", "price_usd")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(price_usd" in plan          # bound reaches the scan as a pushed filter
    assert "other" not in plan.split("ReadSchema")[1].split("\n")[0]  # pruned column


def test_zero_fill_keeps_nan_and_empty_tables_have_no_share(spark):
    from searchrank.operators import clean, profile

    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, 1.5)], "k int, prop_review_score double")
    got = {r["k"]: r["prop_review_score"] for r in clean.fill_zero(df).collect()}
    assert got[1] == 0.0 and got[2] != got[2] and got[3] == 1.5
    assert [r["pct"] for r in profile.zero_profile(df.where("false"), ["prop_review_score"]).collect()] == [None]
