"""Trusted rows by labels, shared by the quality operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# Models are fitted on every trusted row that is not held out.  Up to so many of their ids are broadcast to the texts; more are
# joined to them by a shuffle, so that no task and not the driver holds them all.
TRUSTED_ROWS = 1_000_000
HOLD = 10  # one trusted row in this many is held out of every fit, for the threshold


def held_out(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.lit("held")), F.lit(HOLD)) == 0


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids labelled good and never labelled bad or toxic (one row each)."""
    good = F.min(F.coalesce(F.col("quality"), F.lit(0))) == 1
    clean = F.max(F.coalesce(F.col("toxic"), F.lit(0))) == 0
    return (labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(good.alias("g"), clean.alias("c"))
            .where("g and c").select(F.col(id_col).alias("_tid")))


def with_fit(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``rows`` with ``_fit``: is the row one of the trusted ones to fit on."""
    ids = cut_lineage(trusted_ids(labels).where(~held_out("_tid")))
    ids = F.broadcast(ids) if ids.count() <= TRUSTED_ROWS else ids.hint("merge")
    return rows.join(ids, rows[id_col] == ids["_tid"], "left").withColumn("_fit", F.col("_tid").isNotNull()).drop("_tid")
