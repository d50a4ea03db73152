"""Ranking: total order, top-k, and the hot-group path equal to the plain window."""

import numpy as np

from searchrank.operators import ranking


def test_hot_groups_ranked_like_window(spark):
    rng = np.random.default_rng(1)
    rows = [(0, int(j), float(rng.integers(0, 50))) for j in range(3000)]          # one hot search
    rows += [(int(s), int(j), float(rng.integers(0, 50))) for s in range(1, 200) for j in range(5)]
    df = spark.createDataFrame(rows, "srch_id long, prop_id long, price_usd double")
    order = ranking.order_spec("price_usd", descending=False)
    plain = {(r[0], r[1]): r[2] for r in ranking.rank_within(df, order).select("srch_id", "prop_id", "rank").collect()}
    split = {(r[0], r[1]): r[2] for r in
             ranking.rank_within(df, order, hot_threshold=100).select("srch_id", "prop_id", "rank").collect()}
    assert plain == split
    assert sorted(v for (s, _), v in split.items() if s == 0) == list(range(1, 3001))


def test_top_k_plan_limits_before_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS srch_id", "id AS prop_id", "cast(id AS double) AS price_usd")
    top = ranking.top_k(df, ranking.order_spec("price_usd"), 5)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert top.count() == 15
