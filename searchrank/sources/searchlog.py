"""Reading the raw search log.

The raw log is CSV with a header, one row per (search, candidate), the token
``NULL`` for missing values.  It is read as text (no schema inference pass over
the data) and then typed in one projection of ``try_cast`` expressions: a value
that does not fit its type (``'NULL'``, ``'300'`` for a tinyint, ``'3.7'`` for an
integer, a bad date) becomes NULL instead of failing the job, as a non-strict cast.
NaN in a float column becomes NULL too.
Columns without a declared type pass through unchanged.

``write_typed`` also reports what was lost: values that did not fit, by column, and malformed lines.  The counters are observed
while the typed table is written, so the report costs no second scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DATE_COLUMNS, dtype_map


def read_raw_csv(spark: SparkSession, path: str | list[str], null_value: str = "NULL") -> DataFrame:
    """All columns as strings; names from the header."""
    return (spark.read.option("header", True).option("inferSchema", False)
            .option("nullValue", null_value).option("mode", "PERMISSIVE").csv(path))


def read_raw_data(spark: SparkSession, train_path: str, test_path: str) -> tuple[DataFrame, DataFrame]:
    return read_raw_csv(spark, train_path), read_raw_csv(spark, test_path)


def apply_dtypes(df: DataFrame, is_train: bool = True) -> DataFrame:
    """Non-strict cast of every known column; text dates become timestamp_ntz."""
    types = dtype_map(is_train)
    cols = []
    for field in df.schema.fields:
        name = field.name
        if name in types:
            target = types[name]
            value = F.col(name) if field.dataType == target else F.col(name).try_cast(target)
            if isinstance(target, (T.FloatType, T.DoubleType)):
                value = F.when(~F.isnan(value), value)  # NaN is missing
            cols.append(value.alias(name))
        elif name in DATE_COLUMNS and isinstance(field.dataType, T.StringType):
            cols.append(F.col(name).try_cast(T.TimestampNTZType()).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


MALFORMED = "_malformed"


def read_marked_csv(spark: SparkSession, path: str | list[str], null_value: str = "NULL") -> DataFrame:
    """Like :func:`read_raw_csv`, with the text of lines of too few or too many values in ``MALFORMED`` (else null)."""
    names = read_raw_csv(spark, path, null_value).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, MALFORMED]])
    return (spark.read.option("header", True).option("nullValue", null_value).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", MALFORMED).option("enforceSchema", True).schema(schema).csv(path))


def cast_failures(df: DataFrame, is_train: bool = True) -> dict[str, Column]:
    """Per typed column of a text table: the number of values that do not fit.  Missing values and NaN are no failures."""
    types = dict(dtype_map(is_train)) | {c: T.TimestampNTZType() for c in DATE_COLUMNS}
    return {c: F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(types[c]).isNull()) for c in df.columns if c in types}


def write_typed(spark: SparkSession, source: str | list[str] | DataFrame, out_path: str, is_train: bool = True) -> DataFrame:
    """Write the typed log as Parquet and return ``(column, failures)`` of every typed column, plus ``MALFORMED``.

    ``source`` is the path of raw CSV files or a text table.  Malformed lines are written with what could be read.
    """
    raw = source if isinstance(source, DataFrame) else read_marked_csv(spark, source)
    counters = cast_failures(raw, is_train)
    if MALFORMED in raw.columns:
        counters[MALFORMED] = F.count(MALFORMED)
    seen = Observation()
    observed = raw.observe(seen, *[n.alias(c) for c, n in counters.items()]) if counters else raw
    apply_dtypes(observed.drop(MALFORMED), is_train).write.mode("overwrite").parquet(out_path)
    found = seen.get if counters else {}
    return spark.createDataFrame([(c, found[c]) for c in counters], "column string, failures long")  # a row per column


def read_search_log(spark: SparkSession, path: str | list[str], is_train: bool = True) -> DataFrame:
    """CSV -> typed search log in one scan and one projection."""
    return apply_dtypes(read_raw_csv(spark, path), is_train)


def write_raw_csv(df: DataFrame, path: str, null_value: str = "NULL") -> None:
    """Write a log in the raw text format (header, ``NULL`` tokens)."""
    (df.write.mode("overwrite").option("header", True).option("nullValue", null_value)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))
