"""Ranking candidates inside each search.

Spark has no input order, so every ranking is a total order: the score first,
then tie-breaking columns (``prop_id`` and ``price_usd`` by default; the triple
``(srch_id, prop_id, price_usd)`` is unique in the search log).

Scale notes
-----------
* ``top_k`` filters ``row_number() <= k``; Catalyst turns this into a partial
  ``WindowGroupLimit`` *before* the shuffle, so a search holding a third of all
  rows still sends at most ``k`` rows per map task.
* ``rank_within`` ranks every candidate.  Searches are normally tiny, so a window
  partitioned by search is the right plan.  Searches larger than
  ``hot_threshold`` rows are split off and ranked by a range-partitioned sort
  (see :func:`_rank_hot_groups`), so no single task ever holds a hot search.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import GROUP_COL
from .skew import DEFAULT_HOT_ROWS, HotKeys, find_hot, split_by_keys  # groups above this are ranked by the distributed path

DEFAULT_TIEBREAK = ("prop_id", "price_usd")


def order_spec(score: str | Column, descending: bool = True,
               tiebreak: Sequence[str] = DEFAULT_TIEBREAK) -> list[Column]:
    """Score (nulls last) followed by ascending tie-break columns."""
    s = F.col(score) if isinstance(score, str) else score
    first = s.desc_nulls_last() if descending else s.asc_nulls_last()
    return [first, *[F.col(c).asc_nulls_last() for c in tiebreak]]


def top_k(df: DataFrame, order: Sequence[Column], k: int, group: str = GROUP_COL,
          rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows of every group in ``order`` with their 1-based rank."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def rank_within(df: DataFrame, order: Sequence[Column], group: str = GROUP_COL,
                rank_col: str = "rank", hot_threshold: int | None = DEFAULT_HOT_ROWS, hot: HotKeys | None = None) -> DataFrame:
    """Rank every row of its group (1-based, dense positions, total order).

    Groups above ``hot_threshold`` rows are ranked by a distributed sort instead of
    a per-group window; finding them costs one partial-aggregate count pass.  With
    ``hot_threshold=None`` every group goes through the window.  ``hot`` passes hot groups found earlier.
    """
    w = Window.partitionBy(group).orderBy(*order)
    if hot is None and hot_threshold is not None:
        hot = find_hot(df, group, hot_threshold)
    if hot is None or not hot.count and not hot.null:
        return df.withColumn(rank_col, F.row_number().over(w).cast("long"))
    normal, heavy = split_by_keys(df, hot, group)
    ranked_normal = normal.withColumn(rank_col, F.row_number().over(w).cast("long"))
    ranked_heavy = _rank_hot_groups(heavy, order, group, rank_col)
    return ranked_normal.unionByName(ranked_heavy)


def _rank_hot_groups(df: DataFrame, order: Sequence[Column], group: str, rank_col: str) -> DataFrame:
    """Rank rows of a few very large groups without one task per group.

    1. Range-partition on (group, order...): the sampler splits a hot group over
       many partitions; each partition then holds a contiguous run of the order.
    2. The partitioned rows are checkpointed so partition ids are stable.
    3. Per (partition, group) row counts (tiny: partitions + groups rows) give, by a
       window over that small table, the number of rows of the group that sit in
       earlier partitions.
    4. A row's rank = rows of its group in earlier partitions + its position inside
       its own partition, the latter from a window on (partition, group) whose
       size is bounded by one range partition.
    """
    from ..session import cut_lineage

    sort_cols = [F.col(group).asc(), *order]
    parted = df.repartitionByRange(*sort_cols).withColumn("_pid", F.spark_partition_id())
    parted = cut_lineage(parted)
    counts = parted.groupBy("_pid", group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy("_pid", group).orderBy(*order)
    ranked = parted.withColumn("_local", F.row_number().over(local))
    # offsets has at most (partitions + hot groups) rows; a NULL group is a group like any other
    offsets = offsets.select(F.col("_pid").alias("_opid"), F.col(group).alias("_ogroup"), "_offset")
    match = (ranked["_pid"] == offsets["_opid"]) & ranked[group].eqNullSafe(offsets["_ogroup"])
    return (ranked.join(offsets, match)
            .withColumn(rank_col, (F.col("_offset") + F.col("_local")).cast("long"))
            .drop("_pid", "_local", "_offset", "_opid", "_ogroup"))
