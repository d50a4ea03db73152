"""Hard-negative mining with exact integer scores by the method of the Four Russians.

Vector components are quantised to ``floor(scale * x)`` and stored as packed bit planes in two's complement: plane b
holds bit b of every component, eight components to a byte.  For an anchor and a group of eight dimensions, a
table holds the sums of all 256 subsets of the anchor's components; a candidate's byte of one plane and group
is an index into it.  Shifting and adding the looked-up sums from the top plane (which counts negative)
to the lowest gives the full exact inner product.

The anchors are a stated query set; they meet all rows in blocks.  Rows are dealt by a hash of their position into groups
of about ``CANDIDATES``, anchors into groups of about ``ANCHORS``, whatever their ids and labels; a task scores one anchor
group against one row group.  First pass: each anchor's best rows of its own label, merged over groups
to its positives.  Second pass: for each positive the best rows of other labels inside its score window, merged to its
negatives.  A group returns at most ``positives`` rows an anchor, then ``negatives`` rows a positive.

Defined results: rows with a null label, a null vector, or a null, NaN or infinite component take no part; a null id is
no anchor and comes last among ties; null in ``is_anchor`` is no; vectors shorter than the longest count as padded with zeros; rows that
repeat are rows of their own (an anchor is only not its own positive); an empty table gives no rows.  Scores must fit:
``dimensions * largest squared component`` of the quantised vectors below 2**46, or a ValueError names the bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import common

CANDIDATES = 8192
ANCHORS = 8192
TILE = 64      # anchors scored at a time, by ROWS candidates
ROWS = 2048
LAST_ID = 2**63 - 1  # stands for a null id
LOWEST = np.iinfo(np.int64).min


def pack_planes(q: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bits, groups) bytes of the bit planes of (rows, 8 * groups) integers."""
    return np.stack([np.packbits(((q >> b) & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits)], axis=1)


def unpack_planes(planes: np.ndarray) -> np.ndarray:
    bits = planes.shape[1]
    weight = 1 << np.arange(bits, dtype=np.int64)
    weight[-1] = -weight[-1]
    return np.einsum("b,rbd->rd", weight, np.unpackbits(planes, axis=2, bitorder="little").astype(np.int64))


def subset_sums(q: np.ndarray, dtype) -> np.ndarray:
    """(groups, 256, anchors): sums of every subset of eight components of each anchor."""
    parts = q.astype(dtype).reshape(len(q), -1, 8).transpose(1, 2, 0)
    out = np.zeros((parts.shape[0], 256, len(q)), dtype=dtype)
    for k in range(8):
        out[:, 1 << k:2 << k] = out[:, :1 << k] + parts[:, k:k + 1]
    return out


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(rows, anchors) exact inner products."""
    groups, bits = tables.shape[0], planes.shape[1]
    out = np.zeros((len(planes), tables.shape[2]), dtype=tables.dtype)
    for b in range(bits - 1, -1, -1):
        out <<= 1
        for g in range(groups):
            if b == bits - 1:
                out -= tables[g].take(planes[:, b, g], axis=0)
            else:
                out += tables[g].take(planes[:, b, g], axis=0)
    return out


class Cell:
    """One group of anchors against one group of rows."""

    def __init__(self, anchors: pa.Table, rows: pa.Table, bits: int, small: bool):
        self.dtype = np.int32 if small else np.int64
        rows = {c: rows.column(c).combine_chunks() for c in ("_id", "_label", "_row", "_planes")}
        order = np.lexsort((rows["_row"].to_numpy(), rows["_id"].to_numpy()))
        self.ids, self.labels, self.rows = (rows[c].to_numpy()[order] for c in ("_id", "_label", "_row"))
        self.planes = planes_of(rows["_planes"], bits)[order]
        self.n = len(order)
        self.a_labels, self.a_rows = (anchors.column(c).to_numpy() for c in ("a_label", "a_row"))
        self.q = unpack_planes(planes_of(anchors.column("a_planes").combine_chunks(), bits))

    def ranked(self, same: bool):
        """(anchors, rows, keys) tiles; larger keys rank first: score, then smaller id.

        The rows of a tile have the anchors' label (``same``) or another one.
        """
        for label in np.unique(self.a_labels):
            mine = np.flatnonzero(self.a_labels == label)
            at = np.flatnonzero((self.labels == label) == same)
            planes = self.planes[at]
            for first in range(0, len(mine) if len(at) else 0, TILE):
                part = mine[first:first + TILE]
                tables = subset_sums(self.q[part], self.dtype)
                out = np.empty((len(part), len(at)), dtype=np.int64)
                for k in range(0, len(at), ROWS):
                    out[:, k:k + ROWS] = scores(planes[k:k + ROWS], tables).T
                out *= self.n
                out += self.n - 1 - at
                yield part, at, out

    def split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, score) of ranking keys."""
        return self.n - 1 - keys % self.n, keys // self.n


def planes_of(col: pa.Array, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint8).reshape(len(col), bits, -1)


def best(keys: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest of each row, unordered."""
    return np.partition(keys, keys.shape[1] - k, axis=1)[:, -k:] if keys.shape[1] > k else keys


def mine_hard_negatives(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                        label: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                        scale: int = 256) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank)``.

    For each anchor and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other
    labels with ``low * positive_score <= 100 * negative_score <= high * positive_score``.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("_id"), (F.col("label") if label is None else label).cast("long").alias("_label"),
                     F.col(vector_col).cast("array<double>").alias("_x"), F.coalesce(is_anchor, F.lit(False)).alias("_anchor"))
    wrong = F.exists("_x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.where(F.col("_label").isNotNull() & F.col("_x").isNotNull() & ~wrong)
    rows = rows.select(F.coalesce("_id", F.lit(LAST_ID)).alias("_id"), "_label", (F.col("_anchor") & F.col("_id").isNotNull()).alias("_anchor"),
                       F.transform("_x", lambda x: F.floor(x * scale)).alias("_q"))
    state = rows.agg(F.max(F.size("_q")), F.max(F.array_max("_q")), F.min(F.array_min("_q")), F.count(F.lit(1)),
                     F.count_if("_anchor")).first()
    dims, top, n, n_anchors = state[0] or 0, max(state[1] or 0, -(state[2] or 0), 1), state[3], state[4]
    if dims * top * top >= 2**46:
        raise ValueError("dimensions * largest squared quantised component must be below 2**46")
    bits, groups, small = top.bit_length() + 1, max(1, -(-dims // 8)), max(dims, 1) * top * top < 2**30

    def pack(batches):
        for batch in batches:
            lists = batch.column(3)
            sizes = lists.value_lengths().to_numpy()
            q = np.zeros((batch.num_rows, 8 * groups), dtype=np.int64)
            q[np.arange(8 * groups) < sizes[:, None]] = lists.flatten().to_numpy()
            planes = [p.tobytes() for p in pack_planes(q, bits)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(planes, type=pa.binary())], names=["_id", "_label", "_anchor", "_planes"])

    common.ship(spark)
    packed = rows.mapInArrow(pack, "_id long, _label long, _anchor boolean, _planes binary")
    packed = cut_lineage(packed.withColumn("_row", F.monotonically_increasing_id()))
    row_groups, anchor_groups = max(1, -(-n // CANDIDATES)), max(1, -(-n_anchors // ANCHORS))

    def dealt(groups: int) -> Column:
        return F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int")

    def to_all(groups: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))

    everyone = packed.withColumn("gc", dealt(row_groups)).withColumn("ga", to_all(anchor_groups))
    anchors = packed.where("_anchor").select(dealt(anchor_groups).alias("ga"), F.col("_row").alias("a_row"), F.col("_label").alias("a_label"),
                                             F.col("_planes").alias("a_planes"))

    def each_cell(asked: DataFrame, fn, schema: str) -> DataFrame:
        asked = asked.withColumn("gc", to_all(row_groups))
        return asked.groupBy("ga", "gc").cogroup(everyone.groupBy("ga", "gc")).applyInArrow(fn, schema)

    def table(schema: pa.Schema, parts: list[tuple]) -> pa.Table:
        cols = [np.concatenate(c) if parts else np.zeros(0, dtype=np.int64) for c in (zip(*parts) if parts else [()] * len(schema))]
        return pa.table([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)

    first_schema = pa.schema([("_row", pa.int64()), ("p_row", pa.int64()), ("p_id", pa.int64()), ("p_score", pa.int64())])

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if len(left) and len(right):
            cell = Cell(left, right, bits, small)
            for part, at, keys in cell.ranked(same=True):
                own = cell.rows[at][None, :] == cell.a_rows[part][:, None]
                keys[own] = LOWEST
                top_keys = best(keys, positives)
                pos, score = cell.split(top_keys)
                real = top_keys != LOWEST
                who = np.repeat(cell.a_rows[part], real.sum(axis=1))
                parts.append((who, cell.rows[pos[real]], cell.ids[pos[real]], score[real]))
        return table(first_schema, parts)

    found = each_cell(anchors, find_positives, "_row long, p_row long, p_id long, p_score long")
    order = Window.partitionBy("_row").orderBy(F.col("p_score").desc(), "p_id", "p_row")
    found = cut_lineage(found.withColumn("p_rank", F.row_number().over(order)).where(F.col("p_rank") <= positives))
    windows = found.groupBy(F.col("_row").alias("a_row")).agg(F.sort_array(F.collect_list(F.struct("p_rank", "p_score"))).alias("p"))
    asked = anchors.join(windows, "a_row").select("ga", "a_row", "a_label", "a_planes", F.col("p.p_rank").alias("a_ranks"),
                                                  F.col("p.p_score").alias("a_scores"))  # at most ``positives`` each
    second_schema = pa.schema([("_row", pa.int64()), ("p_rank", pa.int64()), ("n_id", pa.int64()), ("n_score", pa.int64()), ("n_row", pa.int64())])

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if len(left) and len(right):
            cell = Cell(left, right, bits, small)
            ranks, wanted = left.column("a_ranks").to_pylist(), left.column("a_scores").to_pylist()
            n = cell.n
            for part, _, keys in cell.ranked(same=False):
                for a, mine in zip(part.tolist(), keys):
                    lows = [-(-low * p // 100) for p in wanted[a]]    # smallest and largest score of each window
                    highs = [high * p // 100 for p in wanted[a]]
                    near = np.sort(mine[(mine >= min(lows) * n) & (mine < (max(highs) + 1) * n)])
                    for rank, lo, hi in zip(ranks[a], lows, highs):
                        end = int(np.searchsorted(near, (hi + 1) * n))
                        start = max(int(np.searchsorted(near, lo * n)), end - negatives)
                        if start < end:
                            pos, score = cell.split(near[start:end])
                            k = end - start
                            parts.append((np.full(k, cell.a_rows[a]), np.full(k, rank), cell.ids[pos], score, cell.rows[pos]))
        return table(second_schema, parts)

    negative = each_cell(asked, find_negatives, "_row long, p_rank long, n_id long, n_score long, n_row long")
    order = Window.partitionBy("_row", "p_rank").orderBy(F.col("n_score").desc(), "n_id", "n_row")
    negative = negative.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = found.join(packed.where("_anchor").select("_row", F.col("_id").alias("anchor_id")), "_row")
    out = negative.join(named.withColumn("p_rank", F.col("p_rank").cast("long")), ["_row", "p_rank"])

    def known(c: str) -> Column:
        return F.when(F.col(c) != LAST_ID, F.col(c))

    return out.select("anchor_id", known("p_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), known("n_id").alias("negative_id"),
                      F.col("p_score").alias("positive_score"), F.col("n_score").alias("negative_score"),
                      F.col("p_rank").cast("int").alias("positive_rank"))
