"""Data profiling tables behind the exploratory reports.

Each report is one aggregation pass over the log; per-column results are turned
into rows with ``stack`` on the one-row aggregate, never by looping over columns
with separate jobs.  Percentages use half-even rounding to 2 decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import click_booking_category, sort_type_label
from ..schema import GROUP_COL, SIGNIFICANT_ZERO_COLUMNS
from ..session import cut_lineage

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _pct(part, whole):
    """Percentage; NULL when there is nothing to divide by."""
    return F.bround(F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0), 2)


def _stacked(agg: DataFrame, names: list[str], prefix: str, value_name: str) -> DataFrame:
    """One-row aggregate with ``{prefix}{name}`` columns -> (``_rows``, column, value) rows."""
    args = [x for c in names for x in (F.lit(c), F.col(f"{prefix}{c}"))]
    return agg.select(F.col("_rows"), F.stack(F.lit(len(names)), *args).alias("column", value_name))


def group_sizes(df: DataFrame, group: str = GROUP_COL) -> DataFrame:
    """Rows per search."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))


def missing_profile(df: DataFrame) -> DataFrame:
    """(column, missing, pct) for columns with at least one NULL."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(c).isNull()).alias(f"_m_{c}") for c in cols])
    long = _stacked(agg, cols, "_m_", "missing")
    return (long.where(F.col("missing") > 0)
            .select("column", F.col("missing").cast("long").alias("missing"),
                    _pct(F.col("missing"), F.col("_rows")).alias("pct")))


def zero_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, zeros, pct of all rows) for the columns where 0 has a meaning."""
    names = [c for c in (cols or SIGNIFICANT_ZERO_COLUMNS) if c in df.columns]
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(c) == 0).alias(f"_z_{c}") for c in names])
    long = _stacked(agg, names, "_z_", "zeros")
    return long.select("column", F.col("zeros").cast("long").alias("zeros"),
                       _pct(F.col("zeros"), F.col("_rows")).alias("pct"))


def click_booking(df: DataFrame) -> DataFrame:
    """Counts per (click, booking) pair with category and share of all rows (A10)."""
    counts = (df.where(F.col("click_bool").isNotNull() & F.col("booking_bool").isNotNull())
              .groupBy("click_bool", "booking_bool").agg(F.count(F.lit(1)).alias("count")))
    # at most one row per distinct (click, booking) pair: the total is a tiny window
    total = F.sum("count").over(Window.partitionBy())
    return counts.select("click_bool", "booking_bool", "count",
                         click_booking_category().alias("category"),
                         _pct(F.col("count"), total).alias("pct"))


def booking_rate_by_sort(df: DataFrame) -> DataFrame:
    """Booking rate per sort method."""
    g = df.groupBy("random_bool").agg(F.count("booking_bool").alias("total_properties"),
                                      F.sum("booking_bool").cast("long").alias("booked_properties"))
    return g.select("random_bool", "total_properties", "booked_properties",
                    _pct(F.col("booked_properties"), F.col("total_properties")).alias("booking_rate"),
                    sort_type_label().alias("sort_type"))


def stay_vs_price(df: DataFrame) -> DataFrame:
    """Booked rows: length of stay against price, with the log10 price for a log axis."""
    return (df.where(F.col("booking_bool") == 1)
            .select(GROUP_COL, "prop_id", "srch_length_of_stay", "price_usd",
                    F.when(F.col("price_usd") > 0, F.log10(F.col("price_usd"))).alias("log10_price")))


def all_reports(df: DataFrame) -> DataFrame:
    """``(report, item, n, total, pct, click_bool, booking_bool, random_bool)``: A8-A11 in one scan.

    Grouping sets give the rows of both group reports and one row of the whole table, whose counters of nulls and zeros are
    stacked; all of them are partial sums before the shuffle.  The result has a few rows, whatever the input.
    """
    zeros = [c for c in SIGNIFICANT_ZERO_COLUMNS if c in df.columns]
    keys = ["click_bool", "booking_bool", "random_bool"]
    agg = df.groupingSets([[F.col("click_bool"), F.col("booking_bool")], [F.col("random_bool")], []], *[F.col(c) for c in keys]).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("_rows"), F.count("booking_bool").alias("_known"),
        F.sum("booking_bool").cast("long").alias("_booked"),
        *[F.count_if(F.col(c).isNull()).alias(f"_m_{c}") for c in df.columns], *[F.count_if(F.col(c) == 0).alias(f"_z_{c}") for c in zeros])
    pair, sort, whole = F.col("_set") == 1, F.col("_set") == 6, F.col("_set") == 7
    labelled = pair & F.col("click_bool").isNotNull() & F.col("booking_bool").isNotNull()
    agg = agg.withColumn("_pairs", F.sum(F.when(labelled, F.col("_rows"))).over(Window.partitionBy()))  # a few rows

    def entry(report: str, item, n, total):
        return F.struct(F.lit(report).alias("report"), item.cast("string").alias("item"), n.cast("long").alias("n"), total.cast("long").alias("total"))

    rows = F.col("_rows")
    entries = (F.when(whole, F.array(*[entry("missing_values", F.lit(c), F.col(f"_m_{c}"), rows) for c in df.columns],
                                     *[entry("zero_values", F.lit(c), F.col(f"_z_{c}"), rows) for c in zeros]))
               .when(labelled, F.array(entry("click_booking_relation", F.concat_ws("/", "click_bool", "booking_bool"), rows, F.col("_pairs"))))
               .when(sort, F.array(entry("booking_rates_by_sort", F.col("random_bool"), F.col("_booked"), F.col("_known")))))
    out = agg.select(*keys, F.explode(entries).alias("e")).select("e.*", *keys)
    out = out.where((F.col("report") != "missing_values") | (F.col("n") > 0))
    return out.select("report", "item", "n", "total", _pct(F.col("n"), F.col("total")).alias("pct"), *keys)


def run_all_analyses(df: DataFrame) -> dict[str, DataFrame]:
    """All exploratory tables (A12): four from one scan, made once, and the booked rows."""
    reports = cut_lineage(all_reports(df))

    def of(name: str) -> DataFrame:
        return reports.where(F.col("report") == name)

    return {
        "missing_values": of("missing_values").select(F.col("item").alias("column"), F.col("n").alias("missing"), "pct"),
        "zero_values": of("zero_values").select(F.col("item").alias("column"), F.col("n").alias("zeros"), "pct"),
        "click_booking_relation": of("click_booking_relation").select("click_bool", "booking_bool", F.col("n").alias("count"),
                                                                      click_booking_category().alias("category"), "pct"),
        "stay_vs_price": stay_vs_price(df),
        "booking_rates_by_sort": of("booking_rates_by_sort").select("random_bool", F.col("total").alias("total_properties"),
                                                                    F.col("n").alias("booked_properties"), F.col("pct").alias("booking_rate"),
                                                                    sort_type_label().alias("sort_type")),
    }


CORR_AT_ONCE = 34


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def column_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Exact per-column summary (A13): count, missing, distinct, zeros, mean, std, min, max.

    Moments come from one wide aggregate.  Distinct counts come from a long
    (column, value) histogram: partial aggregation collapses repeated values before
    the shuffle, and no per-column distinct expansion of the rows is needed.
    """
    names = cols or numeric_columns(df)
    stats = ["n", "missing", "zeros", "mean", "std", "min", "max"]
    exprs = []
    for c in names:
        x = F.col(c).cast("double")
        exprs += [F.count(x).alias(f"n__{c}"), F.count_if(x.isNull()).alias(f"missing__{c}"),
                  F.count_if(x == 0).alias(f"zeros__{c}"), F.avg(x).alias(f"mean__{c}"),
                  F.stddev_samp(x).alias(f"std__{c}"), F.min(x).alias(f"min__{c}"), F.max(x).alias(f"max__{c}")]
    wide = df.agg(*exprs)
    stack_args = []
    for c in names:
        stack_args.append(F.lit(c))
        for s in stats:
            stack_args.append(F.col(f"{s}__{c}").cast("double"))
    moments = wide.select(F.stack(F.lit(len(names)), *stack_args).alias("column", *stats))

    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                          for c in names])).alias("cv")).select("cv.column", "cv.value")
    distinct = (pairs.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("_c"))
                .groupBy("column").agg(F.count(F.lit(1)).alias("distinct")))
    return (moments.join(distinct, "column", "left")
            .select("column", F.col("n").cast("long").alias("n"), F.col("missing").cast("long").alias("missing"),
                    F.coalesce(F.col("distinct"), F.lit(0)).cast("long").alias("distinct"),
                    F.col("zeros").cast("long").alias("zeros"), "mean", "std", "min", "max"))


def column_profile_approx(df: DataFrame, cols: list[str] | None = None, accuracy: int = 10000) -> DataFrame:
    """Sketch-based summary: approximate distinct count and quartiles (bounded memory)."""
    names = cols or numeric_columns(df)
    exprs = []
    for c in names:
        x = F.col(c).cast("double")
        exprs += [F.approx_count_distinct(x).alias(f"adistinct__{c}"),
                  F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy).alias(f"q__{c}")]
    wide = df.agg(*exprs)
    args = []
    for c in names:
        args += [F.lit(c), F.col(f"adistinct__{c}").cast("long"), F.col(f"q__{c}")[0], F.col(f"q__{c}")[1],
                 F.col(f"q__{c}")[2]]
    return wide.select(F.stack(F.lit(len(names)), *args).alias("column", "approx_distinct", "p25", "p50", "p75"))


def column_correlation(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair over pairwise-complete rows.

    Wide aggregates of ``corr`` without any row expansion: a task sends one row of
    states per aggregate.  ``CORR_AT_ONCE`` pairs share an aggregate, which keeps the
    generated code of one aggregate small however many columns there are.
    """
    names = cols or numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    out = None
    for at in range(0, len(pairs), CORR_AT_ONCE):
        part = pairs[at:at + CORR_AT_ONCE]
        wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(part)])
        args = [x for i, (a, b) in enumerate(part) for x in (F.lit(a), F.lit(b), F.col(f"c{i}"))]
        long = wide.select(F.stack(F.lit(len(part)), *args).alias("feature_a", "feature_b", "corr"))
        out = long if out is None else out.unionByName(long)
    return out.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))


def top_values(df: DataFrame, cols: list[str] | None = None, k: int = 10) -> DataFrame:
    """The ``k`` most frequent non-null values of each column (ties: smaller value first)."""
    names = cols or numeric_columns(df)
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                          for c in names])).alias("cv")).select("cv.column", "cv.value")
    counts = pairs.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc())
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
