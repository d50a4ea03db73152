"""Balanced folds against greedy dealing, cast report, one-scan reports."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from searchrank.operators import profile, split
from searchrank.sources import searchlog


def greedy(sizes, n_folds):
    """Fold of each (size, id), largest first, each to the lightest fold (the first of equal ones)."""
    loads, out = [0] * n_folds, {}
    for n, key in sorted(sizes, key=lambda x: (-x[0], x[1] is not None, x[1] or 0)):
        f = min(range(n_folds), key=lambda k: (loads[k], k))
        loads[f] += n
        out[key] = (n, f)
    return out


@pytest.mark.parametrize("n_folds,seed", [(5, 0), (3, 1), (1, 2), (7, 3)])
def test_balanced_folds_equal_greedy_dealing(spark, n_folds, seed):
    rng = np.random.default_rng(seed)
    sizes = [(int(n), k) for k, n in enumerate(rng.choice([1, 2, 3, 5, 8, 40], 120))] + [(300, 500), (7, None)]
    df = spark.createDataFrame([(k,) for n, k in sizes for _ in range(n)], "srch_id long").repartition(4)
    got = {r["srch_id"]: (r["n_rows"], r["fold"]) for r in split.balanced_folds(df, n_folds).collect()}
    assert got == greedy(sizes, n_folds)
    fit, held = split.balanced_kfold(df, n_folds, 0)
    assert held.count() == sum(n for n, f in got.values() if f == 0) and fit.count() + held.count() == df.count()


def test_patterns_are_few_whatever_the_number_of_searches():
    patterns = split.dealt_patterns({1: 10**12, 50: 10**7, 10**6: 3}, 5)
    assert len(patterns) < 20 and sum(b - a for _, a, b, _ in patterns) == 10**12 + 10**7 + 3


def test_folds_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "srch_id long")
    assert split.balanced_folds(empty).count() == 0
    with pytest.raises(ValueError):
        split.balanced_folds(empty, 0)


def test_cast_report_counts_bad_values_and_malformed_lines(spark, scratch):
    path = os.path.join(scratch, "raw.csv")
    with open(path, "w") as f:
        f.write("srch_id,date_time,site_id,price_usd,other\n"
                "1,2013-01-01 10:00:00,3,1.5,x\n"
                "x1,2013-02-31 10:00:00,300,abc,y\n"
                "2,NULL,NULL,NaN,z\n"
                "3,2013-01-01 10:00:00,4\n"
                "4,2013-01-01 10:00:00,5,2.5,x,too,many\n")
    out = os.path.join(scratch, "typed")
    report = {r["column"]: r["failures"] for r in searchlog.write_typed(spark, path, out).collect()}
    assert report == {"srch_id": 1, "date_time": 1, "site_id": 1, "price_usd": 1, searchlog.MALFORMED: 2}
    typed = spark.read.parquet(out)
    assert typed.columns == ["srch_id", "date_time", "site_id", "price_usd", "other"] and typed.count() == 5
    assert sorted(map(tuple, typed.select("srch_id", "price_usd").collect()), key=str) == sorted(
        [(1, 1.5), (None, None), (2, None), (3, None), (4, 2.5)], key=str)


def test_reports_come_from_one_scan(spark, scratch):
    rows = [(1, c, b, r, s, None if k % 3 else 1.0) for k, (c, b, r, s) in enumerate(
        [(0, 0, 1, 0), (1, 0, 0, 0), (1, 1, 1, 3), (None, 1, 1, None), (1, None, None, 2), (0, 0, 1, 4)])]
    log = spark.createDataFrame(rows, "srch_id int, click_bool int, booking_bool int, random_bool int, prop_starrating int, x double")
    log = log.withColumns({c: F.lit(2) for c in ("prop_id", "srch_length_of_stay", "price_usd")})
    log.write.parquet(f"{scratch}/log")
    df = spark.read.parquet(f"{scratch}/log")
    out = profile.all_reports(df)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {(r["report"], r["item"]): (r["n"], r["total"]) for r in out.collect()}
    assert got["missing_values", "x"] == (4, 6) and got["missing_values", "click_bool"] == (1, 6) and ("missing_values", "srch_id") not in got
    assert got["zero_values", "prop_starrating"] == (2, 6)
    assert got["click_booking_relation", "0/0"] == (2, 4) and got["click_booking_relation", "1/1"] == (1, 4)
    assert got["booking_rates_by_sort", "1"] == (2, 4) and got["booking_rates_by_sort", None] == (None, 0)
    one, several = profile.run_all_analyses(df), {
        "missing_values": profile.missing_profile(df), "zero_values": profile.zero_profile(df), "click_booking_relation": profile.click_booking(df),
        "booking_rates_by_sort": profile.booking_rate_by_sort(df)}
    for name, want in several.items():
        assert sorted(map(tuple, one[name].select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str), name
    assert profile.all_reports(df.where(F.lit(False))).where("n > 0").count() == 0


def test_sketches_of_parts_merge_like_one(spark, scratch):
    from searchrank.operators import sketches

    rng = np.random.default_rng(8)
    rows = [(int(k % 3), float(x), int(y), None) for k, (x, y) in enumerate(zip(rng.normal(size=6000), rng.integers(0, 50, 6000)))]
    df = spark.createDataFrame([*rows, (0, float("nan"), None, None)], "part int, x double, y int, z double").repartition(4)
    cols = ["x", "y", "z"]
    for k in range(3):  # parts are appended, nothing is read again
        sketches.sketch_columns(df.where(F.col("part") == k), cols, F.col("part")).write.mode("append").parquet(f"{scratch}/sketches")
    stored = spark.read.parquet(f"{scratch}/sketches")
    assert stored.count() == 9
    profile_ = sketches.sketched_profile(stored)
    got = {r["column"]: r for r in profile_.collect()}
    assert got["x"]["n"] == got["y"]["n"] == 6000 and got["y"]["approx_distinct"] == 50 and got["z"]["p50"] is None
    assert abs(got["x"]["p50"]) < 0.1 and abs(got["x"]["approx_distinct"] - 6000) < 300
    checked = {r["column"]: r for r in sketches.within_stated_errors(df, cols, profile_).collect()}
    assert all(r["distinct_ok"] and r["quartiles_ok"] for r in checked.values()) and checked["z"]["exact_distinct"] == 0
    wrong = profile_.withColumn("p50", F.col("p50") + 1).withColumn("approx_distinct", F.col("approx_distinct") + 10_000)
    bad = {r["column"]: r for r in sketches.within_stated_errors(df, cols, wrong).collect()}
    assert not bad["x"]["quartiles_ok"] and not bad["y"]["distinct_ok"]
