"""Exact order statistics and dense indexes without a single-task sort.

``values_at_ranks`` finds the values at given 0-based positions of the sorted
non-null values of a column:

1. histogram ``value -> count`` (partial aggregation: a value held by a third of
   all rows is one entry);
2. range-partition the histogram by value, checkpoint it (stable partition ids);
3. per-partition totals (one row per partition) locate the partition and the
   position inside it for each wanted rank;
4. only those partitions get a running count, and one row per rank is returned.

Memory per task is bounded by one range partition of distinct values; the driver
only sees one row per partition and one row per requested rank.  Range partitions
carry no fixed count, so AQE sizes them from the data; partition ids are read after
that and fixed by the checkpoint.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import HotKeys, find_hot, split_by_keys

# A key with more rows than this has its medians found by distributed selection.
MEDIAN_ROWS = 100_000


def values_at_ranks(df: DataFrame, col: str, ranks: Sequence[int]) -> tuple[int, list[float | None]]:
    """(number of non-null values, value at each 0-based rank) for one column."""
    counts, values = values_at_ranks_multi(df, {col: list(ranks)})
    return counts[col], values[col]


def values_at_ranks_multi(df: DataFrame, wanted_ranks: dict[str, list[int]]
                          ) -> tuple[dict[str, int], dict[str, list[float | None]]]:
    """Order statistics of several columns in one pass.

    The columns are stacked into (column, value) pairs so one histogram, one range
    partitioning and one pick job serve all of them.
    """
    cols = list(wanted_ranks)
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("_k"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(cols)
    ])).alias("_kv")).select("_kv._k", "_kv._v")
    hist = pairs.where(F.col("_v").isNotNull()).groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_c"))
    parted = cut_lineage(hist.repartitionByRange("_k", "_v")
                         .withColumn("_pid", F.spark_partition_id()))
    totals = parted.groupBy("_pid", "_k").agg(F.sum("_c").alias("_n")).collect()
    per_col: dict[int, list[tuple[int, int]]] = {}
    for r in totals:
        per_col.setdefault(r["_k"], []).append((r["_pid"], r["_n"]))
    counts = {c: sum(n for _, n in per_col.get(i, [])) for i, c in enumerate(cols)}
    # (pid, column index) -> [(output slot, rank inside that partition's run of the column)]
    wanted: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, c in enumerate(cols):
        runs = sorted(per_col.get(i, []))
        for slot, rk in enumerate(wanted_ranks[c]):
            if rk < 0 or rk >= counts[c]:
                raise ValueError(f"rank {rk} outside 0..{counts[c] - 1} for {c}")
            before = 0
            for pid, cnt in runs:
                if rk < before + cnt:
                    wanted.setdefault((pid, i), []).append((slot, rk - before))
                    break
                before += cnt
    values: dict[str, list[float | None]] = {c: [None] * len(wanted_ranks[c]) for c in cols}
    if not wanted:
        return counts, values
    w = Window.partitionBy("_pid", "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    asked = [(pid, k, slot, rank) for (pid, k), items in wanted.items() for slot, rank in items]  # one row per wanted rank
    asked = F.broadcast(df.sparkSession.createDataFrame(asked, "_pid int, _k int, _slot int, _rank long"))
    local = parted.join(asked.select("_pid", "_k").distinct(), ["_pid", "_k"], "left_semi").withColumn("_cum", F.sum("_c").over(w))
    hits = local.join(asked, ["_pid", "_k"]).where((F.col("_cum") - F.col("_c") <= F.col("_rank")) & (F.col("_rank") < F.col("_cum")))
    for h in hits.select("_k", "_slot", "_v").collect():
        values[cols[h["_k"]]][h["_slot"]] = h["_v"]
    return counts, values


def nearest_rank(n: int, q: float) -> int:
    """0-based index of the nearest-rank quantile: floor((n - 1) q + 0.5)."""
    return int(math.floor((n - 1) * q + 0.5))


def count_non_null(df: DataFrame, col: str) -> int:
    return df.agg(F.count(F.col(col)).alias("n")).first()["n"]


def nearest_quantiles(df: DataFrame, col: str, qs: Sequence[float]) -> dict[float, float | None]:
    n = count_non_null(df, col)
    if n == 0:
        return {q: None for q in qs}
    _, vals = values_at_ranks(df, col, [nearest_rank(n, q) for q in qs])
    return dict(zip(qs, vals))


def exact_median(df: DataFrame, col: str) -> float | None:
    """Median with the midpoint of the two central values for an even count."""
    return exact_medians(df, [col])[col]


def exact_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact medians of several columns: one count pass, one selection pass."""
    cols = list(cols)
    n = df.agg(*[F.count(F.col(c)).alias(c) for c in cols]).first().asDict()
    present = {c: [(n[c] - 1) // 2, n[c] // 2] for c in cols if n[c] > 0}
    out: dict[str, float | None] = {c: None for c in cols}
    if present:
        _, vals = values_at_ranks_multi(df, present)
        for c, (a, b) in vals.items():
            out[c] = (a + b) / 2.0
    return out


def group_medians(df: DataFrame, key: str, cols: Sequence[str], names: Sequence[str], hot: HotKeys | None = None,
                  hot_rows: int = MEDIAN_ROWS) -> DataFrame:
    """``(key, *names)``: exact median of every column per key; keys without any value are left out.

    A key of up to ``hot_rows`` rows is one aggregate, whose memory that bounds.  Hotter keys (``hot``, if found
    earlier) take :func:`hot_group_medians`.  Rows with a NULL key are left out (they match nothing in a join).
    """
    df = df.where(F.col(key).isNotNull())
    hot = find_hot(df, key, hot_rows) if hot is None else hot
    normal, heavy = split_by_keys(df, HotKeys(hot.keys, hot.count), key)
    out = normal.groupBy(key).agg(*[F.median(F.col(c).cast("double")).alias(n) for c, n in zip(cols, names)])
    if hot.count:
        out = out.unionByName(hot_group_medians(heavy, key, cols, names))
    return out.dropna(how="all", subset=list(names))


def hot_group_medians(df: DataFrame, key: str, cols: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``(key, *names)``: exact medians without a value map per key.

    1. Histogram ``(key, column, value) -> count``, combined before the shuffle.
    2. Range partitions of the histogram: a key with very many distinct values is cut over
       several of them.  Checkpointed, so that partition ids are stable.
    3. Running counts inside each partition, plus the group's count in earlier partitions, place
       every value; the values at the two middle ranks are averaged.
    """
    pairs = df.where(F.col(key).isNotNull()).select(key, F.explode(F.array(*[
        F.struct(F.lit(i).alias("_k"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(cols)
    ])).alias("_kv")).select(key, "_kv._k", "_kv._v")
    hist = pairs.where(F.col("_v").isNotNull()).groupBy(key, "_k", "_v").agg(F.count(F.lit(1)).alias("_c"))
    parted = cut_lineage(hist.repartitionByRange(key, "_k", "_v").withColumn("_pid", F.spark_partition_id()))
    runs = parted.groupBy(key, "_k", "_pid").agg(F.sum("_c").alias("_n"))
    group = Window.partitionBy(key, "_k")
    before = group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(key, "_k", "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                       F.sum("_n").over(group).alias("_total"))
    local = Window.partitionBy(key, "_k", "_pid").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = (parted.withColumn("_cum", F.sum("_c").over(local)).join(runs, [key, "_k", "_pid"])
              .withColumn("_to", F.col("_before") + F.col("_cum")).withColumn("_from", F.col("_to") - F.col("_c")))
    low, high = F.expr("(_total - 1) div 2"), F.expr("_total div 2")
    at_low = (F.col("_from") <= low) & (low < F.col("_to"))
    at_high = (F.col("_from") <= high) & (high < F.col("_to"))
    middle = (placed.where(at_low | at_high).groupBy(key, "_k")
              .agg(((F.max(F.when(at_low, F.col("_v"))) + F.max(F.when(at_high, F.col("_v")))) / 2).alias("_m")))
    return middle.groupBy(key).agg(*[F.max(F.when(F.col("_k") == i, F.col("_m"))).alias(n) for i, n in enumerate(names)])


def dense_index(df: DataFrame, col: str, name: str = "idx") -> DataFrame:
    """(value, 0-based dense index in value order) for each distinct value of ``col``.

    Used to map 64-bit ids onto the int range required by ALS without collecting
    the id list: distinct keys are range-partitioned, each partition numbers its own
    keys, and per-partition offsets (one row per partition) are broadcast.
    """
    spark = df.sparkSession
    keys = df.select(col).where(F.col(col).isNotNull()).distinct()
    parted = cut_lineage(keys.repartitionByRange(col).withColumn("_pid", F.spark_partition_id()))
    counts = sorted((r["_pid"], r["count"]) for r in parted.groupBy("_pid").count().collect())
    offsets, acc = [], 0
    for pid, cnt in counts:
        offsets.append((pid, acc))
        acc += cnt
    if acc > 2**31 - 1:
        raise ValueError(f"{acc} distinct values of {col}; int indexes (a limit of MLlib's ALS) end at 2**31 - 1")
    off = spark.createDataFrame(offsets, "_pid int, _offset long")
    w = Window.partitionBy("_pid").orderBy(col)
    # one row per partition: a bounded broadcast
    return (parted.join(F.broadcast(off), "_pid")
            .select(col, (F.col("_offset") + F.row_number().over(w) - 1).cast("int").alias(name)))
