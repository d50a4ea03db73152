"""Train / validation splits (M1, M2).

The hash splits are pure functions of the row's key columns, so they are stable under
re-execution, re-partitioning and executor loss (unlike ``randomSplit``, whose
result depends on the input partitioning and order).

``balanced_folds`` deals whole searches to folds of even row counts: largest search first, each to the fold that has
fewest rows (the first of equal ones), searches of one size by id.  Only the histogram size -> number of searches comes
to the driver.  Searches of one size are alike to the folds: fold f takes one whenever its load is next in the
order of ``(load, fold)``, so it gets those at ``L_f, L_f + size, L_f + 2 size, ...``.  Sorted over all folds that
order is periodic between two starting loads: a few repeating patterns for each size, looked up by the search's
rank within its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import GROUP_COL, ITEM_COL
from .ranking import rank_within


def hash_bucket(buckets: int, *cols: str | Column) -> Column:
    """Bucket of a row by the first 32 bits of the md5 of its key columns, which any engine can compute."""
    text = F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def random_split_mask(test_pct: int = 20, seed: int = 42, cols: tuple[str, ...] = (GROUP_COL, ITEM_COL)) -> Column:
    """True for the held-out share of rows (row-level split, 80/20 by default)."""
    return hash_bucket(100, F.lit(seed), *cols) < test_pct


def random_split(df: DataFrame, test_pct: int = 20, seed: int = 42,
                 cols: tuple[str, ...] = (GROUP_COL, ITEM_COL)) -> tuple[DataFrame, DataFrame]:
    m = random_split_mask(test_pct, seed, cols)
    return df.where(~m), df.where(m)


def group_fold(n_folds: int = 5, group: str = GROUP_COL, method: str = "hash") -> Column:
    """Fold number of a row; whole searches always land in one fold."""
    if method == "hash":
        return hash_bucket(n_folds, group).cast("int")
    if method == "modulo":
        return F.pmod(F.col(group), F.lit(n_folds)).cast("int")
    raise ValueError("method must be 'hash' or 'modulo'")


def group_kfold(df: DataFrame, n_folds: int = 5, fold: int = 0, group: str = GROUP_COL,
                method: str = "hash") -> tuple[DataFrame, DataFrame]:
    """(train, validation) for one fold."""
    f = group_fold(n_folds, group, method)
    return df.where(f != fold), df.where(f == fold)


def dealt_patterns(sizes: dict[int, int], n_folds: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, first rank, end rank, folds in turn) of searches by 0-based rank within their size, largest size first."""
    loads, out = [0] * n_folds, []
    for size in sorted(sizes, reverse=True):
        left, rank, taken = sizes[size], 0, [0] * n_folds
        while left:
            # folds that take the next searches, until the next fold's load is reached
            level = min(load + size * t for load, t in zip(loads, taken))
            active = sorted((load + size * t, f) for f, (load, t) in enumerate(zip(loads, taken)) if load + size * t < level + size)
            waiting = [load + size * t for load, t in zip(loads, taken) if load + size * t >= level + size]
            rounds = max(1, (min(waiting) - level) // size) if waiting else -(-left // len(active))
            # whole turns in which no waiting fold comes first
            n = min(left, rounds * len(active))
            turn = [f for _, f in active]
            out.append((size, rank, rank + n, turn))
            for k, f in enumerate(turn):
                taken[f] += n // len(turn) + (k < n % len(turn))
            rank, left = rank + n, left - n
        loads = [load + size * t for load, t in zip(loads, taken)]
    return out


def balanced_folds(df: DataFrame, n_folds: int = 5, group: str = GROUP_COL) -> DataFrame:
    """``(group, n_rows, fold)`` of every search; a NULL search is one like any other (the first of its size)."""
    if n_folds < 1:
        raise ValueError("n_folds is at least 1")
    searches = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    sizes = {r["n_rows"]: r["c"] for r in searches.groupBy("n_rows").agg(F.count(F.lit(1)).alias("c")).collect()}  # a row per size
    ranked = rank_within(searches, [F.col(group).asc_nulls_first()], "n_rows", "_rank")
    patterns = df.sparkSession.createDataFrame(dealt_patterns(sizes, n_folds), "n_rows long, _from long, _to long, _folds array<int>")
    place = F.col("_rank") - 1
    found = ranked.join(F.broadcast(patterns), "n_rows").where((F.col("_from") <= place) & (place < F.col("_to")))  # some rows per size
    turn = F.pmod(place - F.col("_from"), F.size("_folds").cast("long")).cast("int")
    return found.select(group, "n_rows", F.get("_folds", turn).alias("fold"))


def balanced_kfold(df: DataFrame, n_folds: int = 5, fold: int = 0, group: str = GROUP_COL) -> tuple[DataFrame, DataFrame]:
    """(train, validation) for one balanced fold."""
    folds = balanced_folds(df, n_folds, group).select(F.col(group).alias("_g"), F.col("fold").alias("_fold"))
    held = folds.where(F.col("_fold") == fold)
    same = F.col(group).eqNullSafe(F.col("_g"))
    return df.join(held, same, "left_anti"), df.join(held, same, "left_semi")
