"""Mergeable column sketches (A13): distinct counts and quantiles by parts of the data, without a rescan.

A stored table has a row per part and column with the value count, an HLL sketch and a KLL sketch.  New parts are
appended; the profile of any set of parts comes from merging their rows.  Sketches have a fixed size, so the
table grows with the number of parts, not with the data.

Stated errors: distinct counts within ``DISTINCT_ERROR`` (three standard errors of 2 ** ``LG_K`` registers), quantiles within
``RANK_ERROR`` of their rank (the bound of KLL sketches of size ``KLL_K``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, KLL_K = 12, 400
DISTINCT_ERROR, RANK_ERROR = 0.05, 0.015
QUARTILES = (0.25, 0.5, 0.75)


def _value(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def sketch_columns(df: DataFrame, cols: Sequence[str], part: Column | str = "") -> DataFrame:
    """``(part, column, n, distinct, quantiles)``: sketches of each column in one aggregate per part; NaN is missing."""
    part = F.lit(part) if isinstance(part, str) else part
    exprs = []
    for k, c in enumerate(cols):
        x = _value(c)
        exprs += [F.count(x).alias(f"n{k}"), F.hll_sketch_agg(x.cast("string"), F.lit(LG_K)).alias(f"d{k}"),
                  F.kll_sketch_agg_double(x, F.lit(KLL_K)).alias(f"q{k}")]
    wide = df.groupBy(part.cast("string").alias("part")).agg(*exprs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{k}").alias("n"), F.col(f"d{k}").alias("distinct"), F.col(f"q{k}").alias("quantiles"))
                     for k, c in enumerate(cols)])
    return wide.select("part", F.explode(rows).alias("s")).select("part", "s.*")


def merge_sketches(table: DataFrame) -> DataFrame:
    """``(column, n, distinct, quantiles)`` of all parts together."""
    return table.groupBy("column").agg(F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"),
                                       F.kll_merge_agg_double("quantiles").alias("quantiles"))


def sketched_profile(table: DataFrame) -> DataFrame:
    """``(column, n, approx_distinct, p25, p50, p75)`` from a stored table; null quartiles of empty columns."""
    merged = merge_sketches(table)
    quartiles = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(q))).alias(f"p{round(100 * q)}") for q in QUARTILES]
    return merged.select("column", "n", F.hll_sketch_estimate("distinct").alias("approx_distinct"), *quartiles)


def within_stated_errors(df: DataFrame, cols: Sequence[str], profile: DataFrame) -> DataFrame:
    """``(column, n, exact_distinct, distinct_ok, quartiles_ok)``: a sketched profile held against the data."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), _value(c).alias("value")) for c in cols])
    counts = (df.select(F.explode(rows).alias("r")).select("r.*").where(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("c")))
    names = [f"p{round(100 * q)}" for q in QUARTILES]
    held = counts.join(F.broadcast(profile.select("column", *names)), "column")  # a row per column
    ranks = [F.sum(F.when(test, F.col("c")).otherwise(0)).alias(f"{side}_{p}") for p in names
             for side, test in (("below", F.col("value") < F.col(p)), ("up_to", F.col("value") <= F.col(p)))]
    exact = held.groupBy("column").agg(F.count(F.lit(1)).alias("exact_distinct"), F.sum("c").alias("total"), *ranks)
    ok = F.lit(True)
    for q, p in zip(QUARTILES, names):
        ok = ok & (F.col(f"below_{p}") <= (q + RANK_ERROR) * F.col("total")) & (F.col(f"up_to_{p}") >= (q - RANK_ERROR) * F.col("total"))
    out = profile.join(exact, "column", "left").withColumn("exact_distinct", F.coalesce("exact_distinct", F.lit(0)).cast("long"))
    near = F.abs(F.col("approx_distinct") - F.col("exact_distinct")) <= DISTINCT_ERROR * F.col("exact_distinct")
    return out.select("column", "n", "exact_distinct", near.alias("distinct_ok"), F.coalesce(ok, F.lit(True)).alias("quartiles_ok"))
