"""Registered queries for IO, alignment, cleaning, imputation, features, profiles,
labels, splits and sinks.  SQL texts are generated from the same column lists the
Spark side uses, so both sides always name and type the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import K, present, r6, register
from .functions.dates import preprocess
from .functions.labels import graded_label
from .operators import align, clean, features, impute, metrics, profile, sketches, split
from .schema import dtype_map
from .session import shared_path
from .sources import fixture, searchlog, sinks

# ----------------------------------------------------------------- shared helpers
# column -> kind of the search-log view: i = integer, f = floating, t = timestamp
VIEW_KINDS = {
    "srch_id": "i", "prop_id": "i", "date_time": "t", "site_id": "i", "visitor_location_country_id": "i",
    "prop_starrating": "i", "prop_review_score": "f", "prop_brand_bool": "i", "prop_location_score1": "f",
    "prop_location_score2": "f", "prop_log_historical_price": "f", "position": "i", "price_usd": "f",
    "promotion_flag": "i", "srch_length_of_stay": "i", "random_bool": "i", "click_bool": "i", "booking_bool": "i",
}
TRAIN_COLS = list(VIEW_KINDS)
TEST_COLS = [c for c in TRAIN_COLS if c not in fixture.TEST_COLUMNS_DROPPED]
AGG_COLS = [c for c in TRAIN_COLS if c.startswith("prop") and c not in ("prop_id", "prop_country_id")]

DUCK = {T.ByteType: "TINYINT", T.ShortType: "SMALLINT", T.IntegerType: "INTEGER", T.LongType: "BIGINT",
        T.FloatType: "FLOAT", T.DoubleType: "DOUBLE"}


def sql_present(cols: list[tuple[str, str]], src: str, extra: str = "") -> str:
    parts = []
    for name, kind in cols:
        if kind == "f":
            parts.append(f"round(CAST({name} AS DOUBLE), 6) AS {name}")
        elif kind == "t":
            parts.append(f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}")
        else:
            parts.append(name)
    return f"SELECT {', '.join(parts)} FROM {src} {extra}"


def sql_typed(src: str, cols: list[str], is_train: bool) -> str:
    types = dtype_map(is_train)
    parts = [f"TRY_CAST({c} AS {DUCK[type(types[c])]}) AS {c}" if c in types else c for c in cols]
    return f"SELECT {', '.join(parts)} FROM {src}"


def typed_kinds(cols: list[str]) -> list[tuple[str, str]]:
    return [(c, VIEW_KINDS[c]) for c in cols]


def _train(spark, sf_dir):
    return fixture.train_log(spark, sf_dir)


def _test(spark, sf_dir):
    return fixture.test_log(spark, sf_dir)


# ----------------------------------------------------------------- S1-S3: reading and typing
@register("read_search_log", f""",
t AS ({sql_typed('train', TRAIN_COLS, True)})
{sql_present(typed_kinds(TRAIN_COLS), 't')}
""")
def q_read_search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "raw_search_log_csv")
    searchlog.write_raw_csv(_train(spark, sf_dir), path)
    return present(searchlog.read_search_log(spark, path, is_train=True))


# Values that do not fit their type, planted over the whole log: column -> (condition, text).
_PLANTED = {
    "site_id": ("srch_id % 7 = 0", "300"),
    "position": ("srch_id % 11 = 0", "3.7"),
    "prop_starrating": ("srch_id % 13 = 0", "NULL"),
    "date_time": ("srch_id % 17 = 0", "2013-02-31 10:00:00"),
    "price_usd": ("srch_id % 19 = 0", "NaN"),
}


@register("typed_cast", f""",
planted AS (SELECT * REPLACE ({', '.join(f"CASE WHEN {cond} THEN NULL ELSE {c} END AS {c}" for c, (cond, _) in _PLANTED.items())}) FROM log),
t AS ({sql_typed('planted', TRAIN_COLS, True)})
{sql_present(typed_kinds(TRAIN_COLS), 't')}
""")
def q_typed_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(searchlog.apply_dtypes(_planted_text(spark, sf_dir), is_train=True))


_FAILING = {c: cond for c, (cond, text) in _PLANTED.items() if text not in ("NULL", "NaN")}
_TYPED = [c for c in TRAIN_COLS if c in dtype_map(True) or VIEW_KINDS[c] == "t"]
_FAILURES_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(count_if({_FAILING.get(c, 'false')}"
    + (f" OR ({c} IS NOT NULL AND TRY_CAST({c} AS {DUCK[type(dtype_map(True)[c])]}) IS NULL)" if c in dtype_map(True) else "")
    + ") AS BIGINT) AS failures FROM log" for c in _TYPED)


def _planted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture.search_log(spark, sf_dir)
    return log.select(*[
        F.when(F.expr(_PLANTED[c][0]), F.lit(_PLANTED[c][1])).otherwise(F.col(c).cast("string")).alias(c) if c in _PLANTED
        else F.col(c).cast("string").alias(c) for c in log.columns])


@register("cast_failures", f"""
SELECT feature, failures FROM ({_FAILURES_SQL} UNION ALL SELECT '{searchlog.MALFORMED}', 0) u
""")
def q_cast_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that did not fit, counted while the typed log is written from CSV."""
    path = shared_path(spark, "planted_csv")
    searchlog.write_raw_csv(_planted_text(spark, sf_dir), path)
    return searchlog.write_typed(spark, path, shared_path(spark, "typed_log")).withColumnRenamed("column", "feature")


# ----------------------------------------------------------------- U1, U2
_ALIGN_KINDS = [(c, "s" if c == "date_time" else ("f" if c == "site_id" else VIEW_KINDS[c])) for c in sorted(TRAIN_COLS)]
_ALIGN_TRAIN = ", ".join(
    "CAST(date_time AS VARCHAR) AS date_time" if c == "date_time" else
    "CAST(site_id AS DOUBLE) AS site_id" if c == "site_id" else c for c in TRAIN_COLS)
_ALIGN_TEST = ", ".join(
    "strftime(date_time, '%Y-%m-%d %H:%M:%S') AS date_time" if c == "date_time" else
    "CAST(CAST(site_id AS TINYINT) AS DOUBLE) AS site_id" if c == "site_id" else c for c in TEST_COLS)


@register("align_union", f""",
u AS (SELECT {_ALIGN_TRAIN} FROM train
      UNION ALL BY NAME
      SELECT {_ALIGN_TEST}, CAST(NULL AS INTEGER) AS position, CAST(NULL AS INTEGER) AS click_bool,
             CAST(NULL AS INTEGER) AS booking_bool FROM test)
{sql_present(_ALIGN_KINDS, 'u')}
""")
def q_align_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _train(spark, sf_dir)
    test = (_test(spark, sf_dir).withColumn("site_id", F.col("site_id").cast("tinyint"))
            .withColumn("date_time", F.date_format("date_time", "yyyy-MM-dd HH:mm:ss")))
    return present(align.align_union(train, test))


# ----------------------------------------------------------------- F1-F3, P2
@register("date_parts", """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) AS INTEGER) AS dow FROM events
""")
def q_date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").alias("date_time"))
    return preprocess(events)


_FEATURES = [c for c in TRAIN_COLS if c not in ("srch_id", "prop_id", "date_time", "position", "click_bool",
                                                "booking_bool")]


@register("feature_columns", f""",
p AS (SELECT *, CAST(hour(date_time) AS INTEGER) AS hour, CAST(isodow(date_time) AS INTEGER) AS dow FROM train)
{sql_present([(c, VIEW_KINDS[c]) for c in _FEATURES] + [('hour', 'i'), ('dow', 'i')], 'p')}
""")
def q_feature_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = preprocess(_train(spark, sf_dir))
    return present(feats.select(*features.feature_columns(feats)))


# ----------------------------------------------------------------- P3, P4, A6
_IQR_CTE = """,
v AS (SELECT price_usd AS v, row_number() OVER (ORDER BY price_usd) - 1 AS i, count(*) OVER () AS n
      FROM train WHERE price_usd IS NOT NULL),
b AS (SELECT max(CASE WHEN i = CAST(floor((n - 1) * 0.25 + 0.5) AS BIGINT) THEN v END) AS q1,
             max(CASE WHEN i = CAST(floor((n - 1) * 0.75 + 0.5) AS BIGINT) THEN v END) AS q3 FROM v)
"""


@register("iqr_bounds", _IQR_CTE + """
SELECT round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, round(q3 + 1.5 * (q3 - q1), 6) AS upper FROM b
""")
def q_iqr_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = clean.iqr_bounds(_train(spark, sf_dir), "price_usd")
    row = spark.createDataFrame([(b.q1, b.q3, b.iqr, b.upper)], "q1 double, q3 double, iqr double, upper double")
    return present(row)


@register("iqr_filter", _IQR_CTE + """
SELECT srch_id, prop_id, round(price_usd, 6) AS price_usd FROM train, b WHERE price_usd <= q3 + 1.5 * (q3 - q1)
""")
def q_iqr_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = clean.iqr_filter(_train(spark, sf_dir), "price_usd")
    return present(kept.select("srch_id", "prop_id", "price_usd"))


@register("fill_zero", """
SELECT srch_id, prop_id, round(price_usd, 6) AS price_usd, round(coalesce(prop_review_score, 0), 6) AS prop_review_score
FROM train
""")
def q_fill_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = clean.fill_zero(_train(spark, sf_dir))
    return present(filled.select("srch_id", "prop_id", "price_usd", "prop_review_score"))


# ----------------------------------------------------------------- A5a, A5b
def _impute_sql(stat: str) -> str:
    m = ", ".join(f"{stat}(CAST({c} AS DOUBLE)) AS m_{c}" for c in AGG_COLS)
    filled = ", ".join(f"round(coalesce(CAST({c} AS DOUBLE), m_{c}, g_{c}), 6) AS {c}" for c in AGG_COLS)
    g = ", ".join(f"{stat}(CAST({c} AS DOUBLE)) AS g_{c}" for c in AGG_COLS)
    return f""",
tt AS ({sql_typed('train', TRAIN_COLS, True)}),
gm AS (SELECT prop_id, {m} FROM tt GROUP BY prop_id),
gg AS (SELECT {g} FROM tt)
SELECT srch_id, prop_id, round(CAST(price_usd AS DOUBLE), 6) AS price_usd, {filled}
FROM tt LEFT JOIN gm ON tt.prop_id = gm.prop_id CROSS JOIN gg
""".replace("SELECT srch_id, prop_id,", "SELECT tt.srch_id AS srch_id, tt.prop_id AS prop_id,")


@register("impute_mean", _impute_sql("avg"))
def q_impute_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    tt = searchlog.apply_dtypes(_train(spark, sf_dir), True)
    return present(impute.mean_fill(tt, AGG_COLS).select("srch_id", "prop_id", "price_usd", *AGG_COLS))


@register("impute_median", _impute_sql("median"))
def q_impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    tt = searchlog.apply_dtypes(_train(spark, sf_dir), True)
    return present(impute.median_fill(tt, AGG_COLS).select("srch_id", "prop_id", "price_usd", *AGG_COLS))


# ----------------------------------------------------------------- A1-A4, S4
def _stats_sql(mean: bool, median: bool, std: bool) -> str:
    parts = []
    if mean:
        parts += [f"avg(CAST({c} AS DOUBLE)) AS {c}_mean" for c in AGG_COLS]
    if median:
        parts += [f"median(CAST({c} AS DOUBLE)) AS {c}_median" for c in AGG_COLS]
    if std:
        parts += [f"stddev_samp(CAST({c} AS DOUBLE)) AS {c}_std" for c in AGG_COLS]
    return ", ".join(parts)


def _stat_names(mean: bool, median: bool, std: bool) -> list[str]:
    out = []
    for on, suf in ((mean, "_mean"), (median, "_median"), (std, "_std")):
        if on:
            out += [f"{c}{suf}" for c in AGG_COLS]
    return out


def _add_stat_sql(mean: bool, median: bool, std: bool) -> str:
    names = _stat_names(mean, median, std)
    cols = ", ".join(f"round({n}, 6) AS {n}" for n in names)
    agg = ", ".join(AGG_COLS)
    return f""",
tt AS ({sql_typed('train', TRAIN_COLS, True)}),
te AS ({sql_typed('test', TEST_COLS, False)}),
comb AS (SELECT prop_id, {agg} FROM tt UNION ALL SELECT prop_id, {agg} FROM te),
st AS (SELECT prop_id, {_stats_sql(mean, median, std)} FROM comb GROUP BY prop_id)
SELECT tt.srch_id AS srch_id, tt.prop_id AS prop_id, round(CAST(tt.price_usd AS DOUBLE), 6) AS price_usd, {cols}
FROM tt LEFT JOIN st ON tt.prop_id = st.prop_id
"""


def _add_stat_query(fn, mean: bool, median: bool, std: bool):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        tt = searchlog.apply_dtypes(_train(spark, sf_dir), True)
        te = searchlog.apply_dtypes(_test(spark, sf_dir), False)
        out = fn(tt, te, AGG_COLS)
        return present(out.select("srch_id", "prop_id", "price_usd", *_stat_names(mean, median, std)))
    return q


register("prop_mean", _add_stat_sql(True, False, False))(_add_stat_query(features.add_mean_features, True, False, False))
register("prop_median", _add_stat_sql(False, True, False))(
    _add_stat_query(features.add_median_features, False, True, False))
register("prop_std", _add_stat_sql(False, False, True))(_add_stat_query(features.add_std_features, False, False, True))


def _filled_cte(name: str, src: str, cols: list[str]) -> str:
    m = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}" for c in AGG_COLS)
    g = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS g_{c}" for c in AGG_COLS)
    sel = ", ".join(f"coalesce(CAST({src}.{c} AS DOUBLE), gm_{name}.m_{c}, gg_{name}.g_{c}) AS {c}"
                    if c in AGG_COLS else f"{src}.{c} AS {c}" for c in cols)
    return f"""gm_{name} AS (SELECT prop_id, {m} FROM {src} GROUP BY prop_id),
gg_{name} AS (SELECT {g} FROM {src}),
{name} AS (SELECT {sel} FROM {src} LEFT JOIN gm_{name} ON {src}.prop_id = gm_{name}.prop_id CROSS JOIN gg_{name})"""


_FE_NAMES = _stat_names(True, True, True)
_FE_KINDS = ([(c, "f" if c in AGG_COLS else VIEW_KINDS[c]) for c in sorted(TRAIN_COLS)]
             + [(n, "f") for n in _FE_NAMES])


def _feature_sql(which: str) -> str:
    agg = ", ".join(AGG_COLS)
    if which == "train":
        src = "ftr"
        body = f"SELECT ftr.*, {', '.join('st.' + n for n in _FE_NAMES)} FROM ftr LEFT JOIN st ON ftr.prop_id = st.prop_id"
    else:
        src = "fte"
        body = (f"SELECT fte.*, CAST(NULL AS INTEGER) AS position, CAST(NULL AS TINYINT) AS click_bool, "
                f"CAST(NULL AS TINYINT) AS booking_bool, {', '.join('st.' + n for n in _FE_NAMES)} "
                f"FROM fte LEFT JOIN st ON fte.prop_id = st.prop_id")
    del src
    return f""",
tt AS ({sql_typed('train', TRAIN_COLS, True)}),
te AS ({sql_typed('test', TEST_COLS, False)}),
{_filled_cte('ftr', 'tt', TRAIN_COLS)},
{_filled_cte('fte', 'te', TEST_COLS)},
comb AS (SELECT prop_id, {agg} FROM ftr UNION ALL SELECT prop_id, {agg} FROM fte),
st AS (SELECT prop_id, {_stats_sql(True, True, True)} FROM comb GROUP BY prop_id),
res AS ({body})
{sql_present(_FE_KINDS, 'res')}
"""


@register("prop_features", _feature_sql("train"))
def q_prop_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = features.feature_engineering(_train(spark, sf_dir), _test(spark, sf_dir))
    return present(train)


@register("processed_roundtrip", _feature_sql("test"))
def q_processed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, test = features.feature_engineering(_train(spark, sf_dir), _test(spark, sf_dir))
    path = sinks.write_processed(test, shared_path(spark, "test_processed"))
    return present(sinks.read_processed(spark, path))


# ----------------------------------------------------------------- P5, P6
_RATING = "CASE WHEN booking_bool = 1 THEN 5 WHEN click_bool = 1 THEN 1 ELSE 0 END"


@register("graded_label", f"""
SELECT srch_id, prop_id, round(price_usd, 6) AS price_usd, click_bool, booking_bool, {_RATING} AS rating FROM train
""")
def q_graded_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _train(spark, sf_dir)
    return present(t.select("srch_id", "prop_id", "price_usd", "click_bool", "booking_bool",
                            graded_label().alias("rating")))


@register("user_item_rating", f"""
SELECT srch_id, prop_id, {_RATING} AS rating FROM train
""")
def q_user_item_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.mf import preprocess_data
    train_ratings, _ = preprocess_data(_train(spark, sf_dir), _test(spark, sf_dir))
    return train_ratings


# ----------------------------------------------------------------- A7-A13, P7
@register("group_sizes", """
SELECT srch_id, count(*) AS n_rows FROM train GROUP BY srch_id
""")
def q_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.group_sizes(_train(spark, sf_dir))


def _unpivot_counts(expr_of, value: str, where: str = "") -> str:
    sel = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({expr_of(c)} AS BIGINT) AS {value}, count(*) AS n FROM train" for c in TRAIN_COLS)
    return f"""
SELECT feature, {value}, round_even(CAST({value} AS DOUBLE) / n * 100.0, 2) AS pct FROM ({sel}) u {where}
"""


@register("missing_profile", _unpivot_counts(lambda c: f"count(*) - count({c})", "missing", "WHERE missing > 0"))
def q_missing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.missing_profile(_train(spark, sf_dir)).withColumnRenamed("column", "feature")


_ZERO_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(count_if({c} = 0) AS BIGINT) AS zeros, count(*) AS n FROM train"
    for c in profile.SIGNIFICANT_ZERO_COLUMNS)


@register("zero_profile", f"""
SELECT feature, zeros, round_even(CAST(zeros AS DOUBLE) / n * 100.0, 2) AS pct FROM ({_ZERO_SQL}) u
""")
def q_zero_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.zero_profile(_train(spark, sf_dir)).withColumnRenamed("column", "feature")


@register("click_booking", """,
c AS (SELECT click_bool, booking_bool, count(*) AS count FROM train
      WHERE click_bool IS NOT NULL AND booking_bool IS NOT NULL GROUP BY click_bool, booking_bool)
SELECT click_bool, booking_bool, count,
       CASE WHEN click_bool = 0 AND booking_bool = 0 THEN 'No Click, No Booking'
            WHEN click_bool = 1 AND booking_bool = 0 THEN 'Click, No Booking'
            WHEN click_bool = 0 AND booking_bool = 1 THEN 'No Click, Booking (Error/Direct)'
            WHEN click_bool = 1 AND booking_bool = 1 THEN 'Click and Booking'
            ELSE 'Unknown' END AS category,
       round_even(CAST(count AS DOUBLE) / sum(count) OVER () * 100.0, 2) AS pct
FROM c
""")
def q_click_booking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.click_booking(_train(spark, sf_dir))


@register("booking_rate_by_sort", """,
g AS (SELECT random_bool, count(booking_bool) AS total_properties, CAST(sum(booking_bool) AS BIGINT) AS booked_properties
      FROM train GROUP BY random_bool)
SELECT random_bool, total_properties, booked_properties,
       round_even(CAST(booked_properties AS DOUBLE) / total_properties * 100.0, 2) AS booking_rate,
       CASE WHEN random_bool = 1 THEN 'Random Sort' ELSE 'Default Sort' END AS sort_type
FROM g
""")
def q_booking_rate_by_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.booking_rate_by_sort(_train(spark, sf_dir))


_MISSING_SQL = " UNION ALL ".join(
    f"SELECT 'missing_values' AS report, '{c}' AS item, count(*) - count({c}) AS n, count(*) AS total FROM train" for c in TRAIN_COLS)
_ZEROS_SQL = " UNION ALL ".join(
    f"SELECT 'zero_values', '{c}', count_if({c} = 0), count(*) FROM train" for c in profile.SIGNIFICANT_ZERO_COLUMNS)


@register("all_reports", f""",
u AS (SELECT * FROM ({_MISSING_SQL}) m WHERE n > 0 UNION ALL {_ZEROS_SQL} UNION ALL
      SELECT 'click_booking_relation', concat(click_bool, '/', booking_bool), count(*), sum(count(*)) OVER () FROM train
      WHERE click_bool IS NOT NULL AND booking_bool IS NOT NULL GROUP BY click_bool, booking_bool UNION ALL
      SELECT 'booking_rates_by_sort', CAST(random_bool AS VARCHAR), sum(booking_bool), count(booking_bool) FROM train GROUP BY random_bool)
SELECT report, item, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total, round_even(CAST(n AS DOUBLE) / total * 100.0, 2) AS pct FROM u
""")
def q_all_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exploratory reports from one scan of the log."""
    return profile.all_reports(_train(spark, sf_dir)).select("report", "item", "n", "total", "pct")


@register("stay_vs_price", """
SELECT srch_id, prop_id, srch_length_of_stay, round(price_usd, 6) AS price_usd,
       round(CASE WHEN price_usd > 0 THEN log10(price_usd) END, 6) AS log10_price
FROM train WHERE booking_bool = 1
""")
def q_stay_vs_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(profile.stay_vs_price(_train(spark, sf_dir)))


_PROFILE_COLS = [c for c in TRAIN_COLS if VIEW_KINDS[c] != "t"]
_PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count({c}) AS n, count(*) - count({c}) AS missing,
        count(DISTINCT CAST({c} AS DOUBLE)) AS "distinct", count_if({c} = 0) AS zeros,
        avg(CAST({c} AS DOUBLE)) AS mean, stddev_samp(CAST({c} AS DOUBLE)) AS std,
        min(CAST({c} AS DOUBLE)) AS min, max(CAST({c} AS DOUBLE)) AS max FROM train""" for c in _PROFILE_COLS)


@register("column_profile", f"""
SELECT feature, CAST(n AS BIGINT) AS n, CAST(missing AS BIGINT) AS missing, CAST("distinct" AS BIGINT) AS "distinct",
       CAST(zeros AS BIGINT) AS zeros, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min,
       round(max, 6) AS max
FROM ({_PROFILE_SQL}) u
""")
def q_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.column_profile(_train(spark, sf_dir), _PROFILE_COLS).withColumnRenamed("column", "feature")
    return present(out)


_CORR_PAIRS = [(a, b) for i, a in enumerate(_PROFILE_COLS) for b in _PROFILE_COLS[i + 1:]]
_CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS c FROM train"
    for a, b in _CORR_PAIRS)


@register("column_correlation", f"""
SELECT feature_a, feature_b, round(CASE WHEN isnan(c) THEN NULL ELSE c END, 6) AS corr FROM ({_CORR_SQL}) u
""")
def q_column_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(profile.column_correlation(_train(spark, sf_dir), _PROFILE_COLS))


_TOP_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM train WHERE {c} IS NOT NULL" for c in _PROFILE_COLS)


@register("top_values", f""",
cnt AS (SELECT feature, value, count(*) AS count FROM ({_TOP_SQL}) u GROUP BY feature, value),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY feature ORDER BY count DESC, value ASC) AS INTEGER) AS rank FROM cnt)
SELECT feature, round(value, 6) AS value, count, rank FROM rk WHERE rank <= 10
""")
def q_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.top_values(_train(spark, sf_dir), _PROFILE_COLS, 10).withColumnRenamed("column", "feature")
    return present(out)


_SKETCH_SQL = " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, count(DISTINCT CAST({c} AS DOUBLE)) AS d FROM train" for c in _PROFILE_COLS)


@register("column_profile_approx", f"""
SELECT feature, CAST(n AS BIGINT) AS n, CAST(d AS BIGINT) AS exact_distinct, true AS distinct_ok, true AS quartiles_ok FROM ({_SKETCH_SQL}) u
""")
def q_column_profile_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches stored by part, merged without a rescan, and held against the exact values."""
    train, path = _train(spark, sf_dir), shared_path(spark, "sketches")
    sketches.sketch_columns(train, _PROFILE_COLS, F.pmod("srch_id", F.lit(4))).write.parquet(path)
    found = sketches.sketched_profile(spark.read.parquet(path))
    return sketches.within_stated_errors(train, _PROFILE_COLS, found).withColumnRenamed("column", "feature")


# ----------------------------------------------------------------- M1, M2
def _md5_bucket_sql(key: str, buckets: int) -> str:
    return f"(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % {buckets})"


@register("random_split", f"""
SELECT srch_id, prop_id, CASE WHEN booking_bool = 1 THEN 5 WHEN click_bool = 1 THEN 1 ELSE 0 END AS rating
FROM train WHERE {_md5_bucket_sql("'42|' || srch_id || '|' || prop_id", 100)} < 20
""")
def q_random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _train(spark, sf_dir).select("srch_id", "prop_id", graded_label().alias("rating"))
    _, held_out = split.random_split(t, 20, 42)
    return held_out


@register("group_kfold", """
SELECT CAST(srch_id % 5 AS INTEGER) AS fold, count(DISTINCT srch_id) AS searches, count(*) AS n_rows
FROM train GROUP BY 1
""")
def q_group_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _train(spark, sf_dir).withColumn("fold", split.group_fold(5, method="modulo"))
    return t.groupBy("fold").agg(F.count_distinct("srch_id").alias("searches"), F.count(F.lit(1)).alias("n_rows"))


@register("group_kfold_balanced", """,
g AS (SELECT srch_id, count(*) AS n_rows, row_number() OVER (ORDER BY count(*) DESC, srch_id) AS i FROM train GROUP BY srch_id),
deal AS (
  WITH RECURSIVE d(i, fold, loads) AS (
    SELECT CAST(0 AS BIGINT), 0, [0, 0, 0, 0, 0]::BIGINT[] UNION ALL
    SELECT g.i, list_position(d.loads, list_min(d.loads)) - 1,
           list_transform(d.loads, lambda x, k: CASE WHEN k = list_position(d.loads, list_min(d.loads)) THEN x + g.n_rows ELSE x END)
    FROM d JOIN g ON g.i = d.i + 1)
  SELECT i, fold FROM d WHERE i > 0)
SELECT g.srch_id, g.n_rows, CAST(deal.fold AS INTEGER) AS fold FROM g JOIN deal USING (i)
""")
def q_group_kfold_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches dealt greedily to five folds of even row counts."""
    return split.balanced_folds(_train(spark, sf_dir))


@register("group_kfold_hash", f"""
SELECT CAST({_md5_bucket_sql("CAST(srch_id AS VARCHAR)", 5)} AS INTEGER) AS fold, count(DISTINCT srch_id) AS searches, count(*) AS n_rows
FROM train GROUP BY 1
""")
def q_group_kfold_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _train(spark, sf_dir).withColumn("fold", split.group_fold(5))
    return t.groupBy("fold").agg(F.count_distinct("srch_id").alias("searches"), F.count(F.lit(1)).alias("n_rows"))


# ----------------------------------------------------------------- S7-S9, M10
# ``rank`` is the pair's place among its search's lines in the written file.
@register("submission", """
SELECT srch_id, prop_id, row_number() OVER (PARTITION BY srch_id
       ORDER BY price_usd ASC NULLS LAST, prop_id ASC, price_usd ASC) AS rank FROM test
""")
def q_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = _test(spark, sf_dir).withColumn("pred", -F.col("price_usd"))
    path = sinks.generate_submission(test, "pred", shared_path(spark, "submissions"))
    lines = sinks.read_submission(spark, path).withColumns({
        "_file": F.col("_metadata.file_name"), "_block": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()})
    place = Window.partitionBy("srch_id").orderBy("_file", "_block", "_line")
    return lines.select("srch_id", "prop_id", F.row_number().over(place).cast("long").alias("rank"))


def _tie_scalar(score_expr: str, source: str) -> str:
    return f"""(WITH base AS (SELECT srch_id, CAST({score_expr} AS DOUBLE) AS s, CAST(booking_bool AS DOUBLE) AS rel
                   FROM {source}),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY srch_id ORDER BY s DESC NULLS LAST) AS r FROM base),
  tg AS (SELECT srch_id, s, avg(rel) AS g, sum(CASE WHEN r <= 5 THEN 1.0 / log2(r + 1) ELSE 0 END) AS d
         FROM ranked GROUP BY srch_id, s),
  dcg AS (SELECT srch_id, sum(g * d) AS dcg FROM tg GROUP BY srch_id),
  ideal AS (SELECT srch_id, rel, row_number() OVER (PARTITION BY srch_id ORDER BY rel DESC) AS r FROM base),
  idcg AS (SELECT srch_id, sum(CASE WHEN r <= 5 THEN rel / log2(r + 1) ELSE 0 END) AS idcg FROM ideal GROUP BY srch_id),
  st AS (SELECT srch_id FROM base GROUP BY srch_id HAVING count(*) > 1 AND sum(rel) <> 0)
  SELECT coalesce(avg(CASE WHEN idcg <> 0 THEN dcg / idcg ELSE 0 END), 0)
  FROM st JOIN dcg USING (srch_id) JOIN idcg USING (srch_id))"""


def _exp_scalar(score_col: str, rel_col: str, source: str) -> str:
    return f"""(WITH pr AS (SELECT srch_id, prop_id, row_number() OVER (PARTITION BY srch_id
         ORDER BY {score_col} DESC NULLS LAST, prop_id ASC NULLS LAST, price_usd ASC NULLS LAST) AS r FROM {source}),
  pairs AS (SELECT srch_id, prop_id, max({rel_col}) AS rel FROM {source} GROUP BY srch_id, prop_id),
  dcg AS (SELECT pr.srch_id,
          sum(CASE WHEN pr.r <= 5 THEN coalesce((pow(2.0, pairs.rel) - 1) / log2(pr.r + 1), 0) ELSE 0 END) AS dcg
          FROM pr LEFT JOIN pairs ON pr.srch_id = pairs.srch_id AND pr.prop_id = pairs.prop_id GROUP BY pr.srch_id),
  id AS (SELECT srch_id, rel, row_number() OVER (PARTITION BY srch_id ORDER BY rel DESC) AS r FROM pairs),
  idcg AS (SELECT srch_id, sum(CASE WHEN r <= 5 THEN (pow(2.0, rel) - 1) / log2(r + 1) ELSE 0 END) AS idcg
           FROM id GROUP BY srch_id)
  SELECT coalesce(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 0) FROM dcg JOIN idcg ON dcg.srch_id = idcg.srch_id)"""


@register("metrics_row", f""",
val AS (SELECT * FROM train WHERE srch_id % 5 = 0)
SELECT round({_tie_scalar('prop_location_score1', 'val')}, 6) AS ndcg_at_5,
       round({_exp_scalar('prop_location_score1', 'booking_bool', 'val')}, 6) AS ndcg_at_5_helpers,
       round({_tie_scalar('-price_usd', 'val')}, 6) AS price_baseline,
       round({_tie_scalar('prop_starrating', 'val')}, 6) AS rating_baseline
""")
def q_metrics_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    val = _train(spark, sf_dir).where(fixture.validation_mask())
    scored = val.withColumn("score", F.col("prop_location_score1"))
    row = sinks.metrics_frame({
        "ndcg_at_5": metrics.ndcg_tie(scored, K, "score", "booking_bool"),
        "ndcg_at_5_helpers": metrics.ndcg_binary(scored, K, "score", "booking_bool"),
        "price_baseline": metrics.baseline_ndcg(val, "price_usd", "asc", K),
        "rating_baseline": metrics.baseline_ndcg(val, "prop_starrating", "desc", K),
    })
    path = shared_path(spark, "metrics_log")
    sinks.log_evaluation_summary(row, path)
    return present(sinks.read_evaluation_summary(spark, path, row.columns))
