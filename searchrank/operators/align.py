"""Schema alignment and concatenation of train and test.

Rule per column of the union of both column sets (output columns sorted by name):
same type -> kept; both numeric but different -> double; any other mismatch ->
string; present on one side only -> that type, typed NULL on the other side.
Only the schemas are inspected on the driver; the data moves in one projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _is_numeric(t: T.DataType) -> bool:
    return isinstance(t, NUMERIC)


def unified_type(a: T.DataType | None, b: T.DataType | None) -> T.DataType:
    if a is None:
        return b
    if b is None:
        return a
    if a == b:
        return a
    if _is_numeric(a) and _is_numeric(b):
        return T.DoubleType()
    return T.StringType()


def aligned_schema(df1: DataFrame, df2: DataFrame) -> dict[str, T.DataType]:
    s1 = {f.name: f.dataType for f in df1.schema.fields}
    s2 = {f.name: f.dataType for f in df2.schema.fields}
    return {c: unified_type(s1.get(c), s2.get(c)) for c in sorted(set(s1) | set(s2))}


def _conform(df: DataFrame, schema: dict[str, T.DataType]) -> DataFrame:
    present = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for name, t in schema.items():
        if name not in present:
            cols.append(F.lit(None).cast(t).alias(name))
        elif present[name] == t:
            cols.append(F.col(name))
        else:
            cols.append(F.col(name).cast(t).alias(name))
    return df.select(*cols)


def align_columns(df1: DataFrame, df2: DataFrame) -> tuple[DataFrame, DataFrame]:
    schema = aligned_schema(df1, df2)
    return _conform(df1, schema), _conform(df2, schema)


def align_union(df1: DataFrame, df2: DataFrame) -> DataFrame:
    """Align, then concatenate (all rows kept)."""
    a, b = align_columns(df1, df2)
    return a.unionByName(b)
