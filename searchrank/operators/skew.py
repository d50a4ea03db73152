"""Hot-key detection, splitting, and skew-safe joins to per-key tables.

A search (or property) may hold a large share of all rows.  Two tools keep such a
key from landing in one task:

* :func:`split_by_keys` separates the rows of hot keys so an operator can send
  them down a distributed path (full ranking does this);
* :func:`join_per_key` joins a fact table to a table with one row per key (group
  statistics, biases, id maps).  Rows of hot keys are joined map-side against a
  broadcast of *only the hot keys' rows* of the per-key table (at most
  ``rows / threshold`` of them, counted before broadcast); all other rows take the
  ordinary join that Spark plans.  The hot rows are never shuffled on the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is "hot": more than one task should handle it.
DEFAULT_HOT_ROWS = 1_000_000
# A broadcast hot-key list is allowed up to this many keys; beyond it the split
# uses shuffle joins instead.
MAX_BROADCAST_KEYS = 1_000_000


# Parts a hot key is cut into when there are too many hot keys to broadcast.
SALTS = 32


def hot_keys(df: DataFrame, key: str | Sequence[str], threshold: int) -> DataFrame:
    """Keys with more than ``threshold`` rows (partial aggregation, skew-safe)."""
    keys = [key] if isinstance(key, str) else list(key)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
            .where(F.col("_rows") > threshold).select(*keys))


@dataclass
class HotKeys:
    """Keys of a table with more than ``threshold`` rows, how many there are, and whether NULL is one."""
    keys: DataFrame
    count: int
    null: bool = False


def find_hot(df: DataFrame, key: str, threshold: int = DEFAULT_HOT_ROWS) -> HotKeys:
    """One partial-aggregate pass over the key column.

    A left join to a per-key table keeps every row and key, so the hot keys of the
    input are those of the output: compute them once and pass them along a chain.
    """
    hot = hot_keys(df, key, threshold).cache()
    state = hot.agg(F.count(key).alias("n"), F.count_if(F.col(key).isNull()).alias("nulls")).first()
    if state["n"] == 0:
        hot.unpersist()
    return HotKeys(hot.where(F.col(key).isNotNull()), state["n"], state["nulls"] > 0)


def _side(hot: HotKeys) -> DataFrame:
    return F.broadcast(hot.keys) if hot.count <= MAX_BROADCAST_KEYS else hot.keys


def split_by_keys(df: DataFrame, hot: HotKeys, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of other keys, rows of hot keys); NULL goes with the hot keys if it is hot."""
    normal, heavy = df, df.where(F.lit(False))
    if hot.count:
        normal, heavy = df.join(_side(hot), key, "left_anti"), df.join(_side(hot), key, "left_semi")
    if hot.null:
        heavy = heavy.unionByName(df.where(F.col(key).isNull()))
        normal = normal.where(F.col(key).isNotNull())
    return normal, heavy


def join_per_key(big: DataFrame, per_key: DataFrame, key: str, how: str = "left",
                 threshold: int | None = DEFAULT_HOT_ROWS, hot: HotKeys | None = None) -> DataFrame:
    """``big.join(per_key, key, how)`` where ``per_key`` has at most one row per key.

    ``hot`` passes hot keys found earlier (see :func:`find_hot`); otherwise they are
    found on ``big``.  With ``threshold=None`` and no ``hot`` this is the plain join.
    Hot keys too many to broadcast are joined in ``SALTS`` parts each instead.  Rows with a hot NULL key
    match nothing and are set apart without a shuffle.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    if hot is None:
        if threshold is None:
            return big.join(per_key, key, how)
        hot = find_hot(big, key, threshold)
    rest = None
    if hot.null:
        if how == "left":
            added = {f.name: F.lit(None).cast(f.dataType) for f in per_key.schema.fields if f.name != key}
            rest = big.where(F.col(key).isNull()).withColumns(added)
        big = big.where(F.col(key).isNotNull())
    if hot.count == 0:
        out = big.join(per_key, key, how)
    else:
        normal, heavy = split_by_keys(big, HotKeys(hot.keys, hot.count), key)
        hot_rows = per_key.join(_side(hot), key, "left_semi")  # at most hot.count rows
        if hot.count <= MAX_BROADCAST_KEYS:
            joined = heavy.join(F.broadcast(hot_rows), key, how)
        else:
            part = F.pmod(F.xxhash64(*[F.col(f.name) for f in heavy.schema.fields if not _is_map(f.dataType)]), F.lit(SALTS))
            spread = hot_rows.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
            joined = heavy.withColumn("_salt", part).join(spread, [key, "_salt"], how).drop("_salt")
        out = normal.join(per_key, key, how).unionByName(joined)
    return out if rest is None else out.unionByName(rest)


def _is_map(kind) -> bool:
    return kind.typeName() == "map"
