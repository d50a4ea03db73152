"""Search-log view over the driver's star-schema tables.

The test tables carry no search log, so one is derived from them:
``lineitem`` joined with ``orders``, ``customer`` and ``part`` (all inner, no row
lost).  Each line item is one candidate shown in one search; missing values are
planted on purpose because the source tables hold none.  The same definition is
written as SQL in :data:`SEARCH_LOG_SQL` for the DuckDB oracle.

Train / test split: ``srch_id % 10 <> 0`` / ``= 0`` (test drops the interaction
columns), validation fold ``srch_id % 5 = 0`` within train.  Both halves are used,
so the split partitions the whole log rather than sampling it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEST_COLUMNS_DROPPED = ["position", "click_bool", "booking_bool"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search log (train and test rows, all with interaction columns)."""
    li = _table(spark, sf_dir, "lineitem")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_retailprice")

    # orders x customer first: lineitem is shuffled once for orders and once for part.
    oc = orders.join(customer, orders.o_custkey == customer.c_custkey)
    j = li.join(oc, li.l_orderkey == oc.o_orderkey).join(part, li.l_partkey == part.p_partkey)

    c = F.col
    null: Column = F.lit(None)
    return j.select(
        c("l_orderkey").alias("srch_id"),
        c("l_partkey").alias("prop_id"),
        c("l_shipdate").cast("timestamp_ntz").alias("date_time"),
        (c("l_suppkey") % 34).cast("int").alias("site_id"),
        c("c_nationkey").alias("visitor_location_country_id"),
        (c("p_size") % 6).cast("int").alias("prop_starrating"),
        F.when((c("l_partkey") % 50 == 0) | (c("l_quantity") % 10 == 0), null.cast("double"))
        .otherwise(c("l_quantity") / 10).alias("prop_review_score"),
        F.when(c("p_brand").like("Brand#1%"), 1).otherwise(0).alias("prop_brand_bool"),
        (c("l_tax") * 100).alias("prop_location_score1"),
        F.when(c("l_linenumber") == 7, null.cast("double"))
        .otherwise(c("l_discount") * 10).alias("prop_location_score2"),
        F.when(c("l_partkey") % 20 == 0, F.lit(0.0))
        .otherwise(F.log(c("p_retailprice"))).alias("prop_log_historical_price"),
        c("l_linenumber").alias("position"),
        (c("l_extendedprice") / 100).alias("price_usd"),
        F.when(c("l_discount") >= 0.05, 1).otherwise(0).alias("promotion_flag"),
        (1 + c("l_quantity") % 7).cast("int").alias("srch_length_of_stay"),
        F.when(c("l_orderkey") % 3 == 0, 1).otherwise(0).alias("random_bool"),
        F.when(c("l_returnflag").isin("A", "R") & (c("l_linenumber") <= 5), 1).otherwise(0).alias("click_bool"),
        F.when((c("l_returnflag") == "R") & (c("l_linestatus") == "F"), 1).otherwise(0).alias("booking_bool"),
    )


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = search_log(spark, sf_dir)
    return log.where(F.col("srch_id") % 10 != 0)


def test_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = search_log(spark, sf_dir)
    return log.where(F.col("srch_id") % 10 == 0).drop(*TEST_COLUMNS_DROPPED)


def validation_mask(col: str = "srch_id") -> Column:
    """Fold used for validation inside train (oracle-reproducible)."""
    return F.col(col) % 5 == 0


# Same view for DuckDB (the expressions are valid in both engines).
SEARCH_LOG_SQL = """
SELECT
  l.l_orderkey AS srch_id,
  l.l_partkey AS prop_id,
  CAST(l.l_shipdate AS TIMESTAMP) AS date_time,
  CAST(l.l_suppkey % 34 AS INTEGER) AS site_id,
  c.c_nationkey AS visitor_location_country_id,
  CAST(p.p_size % 6 AS INTEGER) AS prop_starrating,
  CASE WHEN l.l_partkey % 50 = 0 OR l.l_quantity % 10 = 0 THEN NULL ELSE l.l_quantity / 10 END AS prop_review_score,
  CASE WHEN p.p_brand LIKE 'Brand#1%' THEN 1 ELSE 0 END AS prop_brand_bool,
  l.l_tax * 100 AS prop_location_score1,
  CASE WHEN l.l_linenumber = 7 THEN NULL ELSE l.l_discount * 10 END AS prop_location_score2,
  CASE WHEN l.l_partkey % 20 = 0 THEN 0.0e0 ELSE ln(p.p_retailprice) END AS prop_log_historical_price,
  l.l_linenumber AS position,
  l.l_extendedprice / 100 AS price_usd,
  CASE WHEN l.l_discount >= 0.05 THEN 1 ELSE 0 END AS promotion_flag,
  CAST(1 + l.l_quantity % 7 AS INTEGER) AS srch_length_of_stay,
  CASE WHEN l.l_orderkey % 3 = 0 THEN 1 ELSE 0 END AS random_bool,
  CASE WHEN l.l_returnflag IN ('A', 'R') AND l.l_linenumber <= 5 THEN 1 ELSE 0 END AS click_bool,
  CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'F' THEN 1 ELSE 0 END AS booking_bool
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN part p ON l.l_partkey = p.p_partkey
"""

ORACLE_PRELUDE = f"""
WITH log AS ({SEARCH_LOG_SQL}),
train AS (SELECT * FROM log WHERE srch_id % 10 <> 0),
test AS (SELECT * EXCLUDE (position, click_bool, booking_bool) FROM log WHERE srch_id % 10 = 0)
"""
