"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
search log derived from the driver tables (see :mod:`searchrank.sources.fixture`);
queries with a fit, a written table or order statistics run jobs while they are built.
Floating outputs are rounded to 6 decimals on both sides so that summation order
does not matter; every output column is aliased to the same name in the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import metrics, ranking
from .session import stored
from .sources import fixture
from .sources.fixture import ORACLE_PRELUDE

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}

K = 5
DIGITS = 6


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, None if sql is None else ORACLE_PRELUDE + sql)
        return fn
    return deco


def r6(c):
    """Round a numeric column (name or Column) to the compared precision."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), DIGITS)


def present(df: DataFrame) -> DataFrame:
    """Floats rounded to 6 decimals as double, timestamps as text."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(r6(f.name).alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# --------------------------------------------------------------------------- R1, R2
@register("rank_candidates", """
SELECT srch_id, prop_id, round(price_usd, 6) AS price_usd,
       row_number() OVER (PARTITION BY srch_id
            ORDER BY price_usd ASC NULLS LAST, prop_id ASC NULLS LAST, price_usd ASC NULLS LAST) AS rank
FROM log
""")
def q_rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture.search_log(spark, sf_dir)
    ranked = ranking.rank_within(log, ranking.order_spec("price_usd", descending=False))
    return ranked.select("srch_id", "prop_id", r6("price_usd").alias("price_usd"), "rank")


@register("topk", """
SELECT srch_id, prop_id, rank FROM (
  SELECT srch_id, prop_id,
         CAST(row_number() OVER (PARTITION BY srch_id
              ORDER BY prop_review_score DESC NULLS LAST, prop_id ASC NULLS LAST, price_usd ASC NULLS LAST) AS INTEGER) AS rank
  FROM log) t
WHERE rank <= 5
""")
def q_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture.search_log(spark, sf_dir)
    top = ranking.top_k(log, ranking.order_spec("prop_review_score"), K)
    return top.select("srch_id", "prop_id", "rank")


# --------------------------------------------------------------------------- R3-R8
def _graded(log: DataFrame) -> DataFrame:
    from .functions.labels import graded_label
    return log.withColumn("rating", graded_label())


NDCG_EXP_SQL = """,
lab AS (SELECT srch_id, prop_id, price_usd,
               CASE WHEN booking_bool = 1 THEN 5 WHEN click_bool = 1 THEN 1 ELSE 0 END AS rating FROM log),
pairs AS (SELECT srch_id, prop_id, max(rating) AS rel FROM lab GROUP BY srch_id, prop_id),
pr AS (SELECT srch_id, prop_id, row_number() OVER (PARTITION BY srch_id
         ORDER BY price_usd ASC NULLS LAST, prop_id ASC NULLS LAST, price_usd ASC NULLS LAST) AS r FROM lab),
dcg AS (SELECT pr.srch_id,
               sum(CASE WHEN pr.r <= 5 THEN coalesce((pow(2.0, pairs.rel) - 1) / log2(pr.r + 1), 0) ELSE 0 END) AS dcg
        FROM pr LEFT JOIN pairs ON pr.srch_id = pairs.srch_id AND pr.prop_id = pairs.prop_id
        GROUP BY pr.srch_id),
id AS (SELECT srch_id, rel, row_number() OVER (PARTITION BY srch_id ORDER BY rel DESC) AS r FROM pairs),
idcg AS (SELECT srch_id, sum(CASE WHEN r <= 5 THEN (pow(2.0, rel) - 1) / log2(r + 1) ELSE 0 END) AS idcg
         FROM id GROUP BY srch_id)
SELECT round(coalesce(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 0), 6) AS ndcg
FROM dcg JOIN idcg ON dcg.srch_id = idcg.srch_id
"""


@register("ndcg_exp", NDCG_EXP_SQL)
def q_ndcg_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = stored(_graded(fixture.search_log(spark, sf_dir)).select("srch_id", "prop_id", "price_usd", "rating"), "ndcg")
    pred = lab.withColumn("score", -F.col("price_usd"))
    out = metrics.ndcg_exp(pred, lab, K, score="score", rel="rating")
    return out.select(r6("ndcg").alias("ndcg"))


def _tie_sql(score_expr: str, rel_expr: str = "booking_bool", source: str = "log", alias: str = "ndcg") -> str:
    return f""",
base AS (SELECT srch_id, CAST({score_expr} AS DOUBLE) AS s, CAST({rel_expr} AS DOUBLE) AS rel FROM {source}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY srch_id ORDER BY s DESC NULLS LAST) AS r FROM base),
tg AS (SELECT srch_id, s, avg(rel) AS g, sum(CASE WHEN r <= 5 THEN 1.0 / log2(r + 1) ELSE 0 END) AS d
       FROM ranked GROUP BY srch_id, s),
dcg AS (SELECT srch_id, sum(g * d) AS dcg FROM tg GROUP BY srch_id),
ideal AS (SELECT srch_id, rel, row_number() OVER (PARTITION BY srch_id ORDER BY rel DESC) AS r FROM base),
idcg AS (SELECT srch_id, sum(CASE WHEN r <= 5 THEN rel / log2(r + 1) ELSE 0 END) AS idcg FROM ideal GROUP BY srch_id),
st AS (SELECT srch_id FROM base GROUP BY srch_id HAVING count(*) > 1 AND sum(rel) <> 0)
SELECT round(coalesce(avg(CASE WHEN idcg <> 0 THEN dcg / idcg ELSE 0 END), 0), 6) AS {alias}
FROM st JOIN dcg USING (srch_id) JOIN idcg USING (srch_id)
"""


@register("ndcg_tie", _tie_sql("prop_location_score1"))
def q_ndcg_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture.search_log(spark, sf_dir)
    out = metrics.ndcg_tie(log.withColumn("score", F.col("prop_location_score1")), K, "score", "booking_bool")
    return out.select(r6("ndcg").alias("ndcg"))


@register("baseline_price", _tie_sql("-price_usd"))
def q_baseline_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture.search_log(spark, sf_dir)
    return metrics.baseline_ndcg(log, "price_usd", "asc", K).select(r6("ndcg").alias("ndcg"))


@register("baseline_rating", _tie_sql("prop_starrating"))
def q_baseline_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture.search_log(spark, sf_dir)
    return metrics.baseline_ndcg(log, "prop_starrating", "desc", K).select(r6("ndcg").alias("ndcg"))


@register("baseline_price_desc", _tie_sql("price_usd"))
def q_baseline_price_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture.search_log(spark, sf_dir)
    return metrics.baseline_ndcg(log, "price_usd", "desc", K).select(r6("ndcg").alias("ndcg"))


@register("baseline_rating_asc", _tie_sql("-prop_starrating"))
def q_baseline_rating_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture.search_log(spark, sf_dir)
    return metrics.baseline_ndcg(log, "prop_starrating", "asc", K).select(r6("ndcg").alias("ndcg"))


@register("ndcg_binary", """,
pr AS (SELECT srch_id, prop_id, row_number() OVER (PARTITION BY srch_id
         ORDER BY prop_location_score2 DESC NULLS LAST, prop_id ASC NULLS LAST, price_usd ASC NULLS LAST) AS r FROM log),
pairs AS (SELECT srch_id, prop_id, max(booking_bool) AS rel FROM log GROUP BY srch_id, prop_id),
dcg AS (SELECT pr.srch_id,
               sum(CASE WHEN pr.r <= 5 THEN coalesce((pow(2.0, pairs.rel) - 1) / log2(pr.r + 1), 0) ELSE 0 END) AS dcg
        FROM pr LEFT JOIN pairs ON pr.srch_id = pairs.srch_id AND pr.prop_id = pairs.prop_id
        GROUP BY pr.srch_id),
id AS (SELECT srch_id, rel, row_number() OVER (PARTITION BY srch_id ORDER BY rel DESC) AS r FROM pairs),
idcg AS (SELECT srch_id, sum(CASE WHEN r <= 5 THEN (pow(2.0, rel) - 1) / log2(r + 1) ELSE 0 END) AS idcg
         FROM id GROUP BY srch_id)
SELECT round(coalesce(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 0), 6) AS ndcg
FROM dcg JOIN idcg ON dcg.srch_id = idcg.srch_id
""")
def q_ndcg_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture.search_log(spark, sf_dir).select("srch_id", "prop_id", "price_usd", "prop_location_score2", "booking_bool")
    scored = stored(log, "ndcg").withColumn("score", F.col("prop_location_score2"))  # three steps read it
    return metrics.ndcg_binary(scored, K, "score", "booking_bool").select(r6("ndcg").alias("ndcg"))


from . import catalog_more as _more  # noqa: E402,F401  (registers the remaining queries)
from . import catalog_models as _models  # noqa: E402,F401


def queries() -> dict[str, QueryFn]:
    return {name: fn for name, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}
