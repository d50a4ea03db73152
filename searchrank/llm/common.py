"""Shared helpers of the training-data operators.

Python work runs in Arrow batches (``mapInArrow``): texts arrive as UTF-8 bytes and
rows leave in batches bounded by their size, so no task holds more than one input
batch and one output batch.
"""

from __future__ import annotations

import functools
import gc
import os
import tempfile
import time
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

# Rows enter a Python task in batches of about this many bytes (the JVM and Python hold a few each), and leave it likewise.
IN_BYTES = 4_000_000
OUT_BYTES = 1_000_000  # as ``size`` counts them; small rows take ten times that as Python objects
# Rows whose texts are Python objects at a time.
IN_ROWS = 512


def small_transfers(spark: SparkSession) -> None:
    """Have Spark send rows to Python in batches of at most ``IN_BYTES``, unless the session asks for fewer bytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > IN_BYTES:
        spark.conf.set(key, str(IN_BYTES))


def ship(spark: SparkSession) -> None:
    """Give the executors this package when their Python path may not hold it, and rows in small batches."""
    small_transfers(spark)
    if PACKAGE_ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if getattr(sc, "_searchrank_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="searchrank-code-"), "searchrank_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(os.path.join(PACKAGE_ROOT, "searchrank")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, PACKAGE_ROOT))
    sc.addPyFile(path)
    sc._searchrank_shipped = True


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now: its cleaner follows the driver's collector.

    What the last job held becomes free in a first collection and its files go after a second one.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(df: DataFrame) -> dict[str, np.ndarray]:
    """Columns of a table of proven size, as numpy arrays (Arrow all the way, no row objects)."""
    table = df.toArrow()
    return {name: table.column(name).to_numpy() for name in table.column_names}


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def byte_values(col: pa.Array) -> list[bytes | None]:
    """Values of a string column as UTF-8 bytes (null stays None)."""
    if not (pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)):
        col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    return col.to_pylist()


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = IN_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``rows``, so that few texts are Python objects at a time.

    Python workers live on over many tasks, and Arrow's own allocators keep what is freed. With the system's one, what
    Arrow and numpy have freed goes back after each batch.
    """
    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


def batched(rows: Iterable[tuple], schema: pa.Schema, size: Callable[[tuple], int],
            limit: int = OUT_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``limit`` bytes from row tuples."""
    held: list[tuple] = []
    n = 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n >= limit:
            yield to_batch(held, schema)
            held, n = [], 0
    if held:
        yield to_batch(held, schema)


def to_batch(rows: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def row_map(df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: str, size: Callable[[tuple], int] | None = None) -> DataFrame:
    """``mapInArrow`` of a generator over batches; ``fn(batch)`` yields output tuples."""
    out = T._parse_datatype_string(schema)
    target = arrow_schema(out)
    measure = size or (lambda row: 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in small_batches(batches):
                yield from fn(b)
        yield from batched(rows(), target, measure)

    ship(df.sparkSession)
    return df.mapInArrow(run, out)


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


@functools.lru_cache(maxsize=8)
def read_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
