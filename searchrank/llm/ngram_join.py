"""Exact n-gram Jaccard self-join by vertical partitioning, with connected components.

The global order of n-grams is the order of their 64-bit hashes.  It is cut into fragments,
so that every document's sorted set falls into the same number of fragments, and two sets
are compared fragment by fragment: partial overlaps are counted separately and summed per pair.

**Candidates.**  A pair of sets with sizes ``a`` and ``b`` links at ``100 * o >= percent * u``, that is
at an overlap of at least ``need = percent * (a + b) / (100 + percent)``.  Sort every set by one common order, rarest
n-grams first.  The first m shared n-grams of a linked pair then stand at places up to ``a - need + m - 1`` and
``b - need + m - 1``, since enough shared n-grams follow the first; m is ``1 + D / MORE`` for the D differences that
the smaller set may have.  A pair is a candidate if it shares m tokens at such places.  The larger the partner, the
earlier the places: tokens at which a set can be the smaller one of a pair are about half of its prefix.  A
document that differs from its family in more n-grams than a link allows has its own n-grams there, is left with
fewer than m shared tokens, and meets no other member of about its size, however large the family.

The order comes from counts of all n-grams of all documents in hash buckets: a table of bounded size, broadcast.
Any order gives the same links; a good one gives few candidates.

Most prefix tokens belong to one set.  A first aggregation finds the others from one row of each set (rows are told by a
bit table of fixed size) and writes them into another bit table (``FILTER_BITS``, broadcast); the join itself moves only
tokens that table lets through.  A fuller table lets more through and changes no result.

**Links and components.**  Documents with equal sets are one class from the start.  Then

1. each class is compared with one centre, among those of its tokens the one it shares most tokens with (a
   token's centre has the most common n-grams on average: the likely original of a family); links give
   first components;
2. of each token, the pairs from two different components are compared whose places allow a link, so no link
   between components is lost, while pairs inside a component, whose class is already settled,
   are never made.  Two classes with one centre are left out if their overlaps with it and the n-grams that they may share
   outside it are too few.  A family of m copies costs about m comparisons instead of m * m.

Both count a pair's shared tokens.  Step 2 joins by token and band of the larger size, (members outside the token's main component) x (members), by
sort-merge joins that adaptive execution can split.  Shared tokens have one order in both sets, so where the last of those asked for meets, both
sets have as many tokens up to there: only such rows are joined.  A family's common tokens that stand first among a
member's tokens make no pair; the pairs that meet have their shared tokens counted.

Defined results: a text of fewer than ``n`` words but not none is one n-gram; null texts and texts
without words have an empty set, link with nothing and are their own component; rows that share
a document id keep a row each; null ids never become a component's id unless all are null.
Set digests have 64 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import common, textnum
from .components import components

ORDER_BUCKETS = 1 << 18  # two bytes each, broadcast; more for more n-grams, up to MOST_BUCKETS
MOST_BUCKETS = 1 << 24
FILTER_BITS = 1 << 25    # 4 MB, broadcast
MORE = 2                 # one more shared token asked for every so many differences allowed
PART = 512               # n-grams in a vertical fragment of a set
BAND = 1.02              # sizes in a band differ by less than this factor


class Threshold:
    """Sizes and places at which two sets may link, for a Jaccard similarity of ``percent`` or more."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("percent is between 50 and 100")
        self.percent = percent

    def smallest_partner(self, size: int) -> int:
        return -(-size * self.percent // 100)

    def tokens(self, smaller):
        """Shared prefix tokens of a linked pair whose smaller set has this size."""
        return 1 + smaller * (100 - self.percent) // (200 * MORE)

    def last_place(self, size, partner):
        """Last place in a set of ``size`` of the shared tokens asked for with a set of ``partner``."""
        need = -(-self.percent * (size + partner) // (100 + self.percent))
        return size - need + self.tokens(np.minimum(size, partner)) - 1

    def places(self, size: int) -> tuple[int, np.ndarray]:
        """(prefix length, largest partner by place, for the places at which the set can be the smaller one)."""
        prefix = int(self.last_place(size, np.arange(self.smallest_partner(size), size + 1)).max()) + 1
        last = self.last_place(size, np.arange(size, size * 100 // self.percent + 1))  # falls with the partner
        return min(size, prefix), size + np.searchsorted(-last, -np.arange(min(size, int(last[0]) + 1)), "right") - 1


def order_buckets(n: int) -> int:
    """Buckets of the order's table for ``n`` n-grams in all: about one for every 1,000, between the bounds."""
    return min(MOST_BUCKETS, max(ORDER_BUCKETS, 1 << max(0, n // 1000 - 1).bit_length()))


def ngram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text (A-Z lower-cased, split at white space)."""
    w = textnum.words_of(texts, textnum.SPACES)
    out = []
    runs = textnum.run_hashes(w.hashes, n)
    for j in range(len(texts)):
        a, b = int(w.first[j]), int(w.first[j + 1])
        if b - a >= n:
            x = np.sort(runs[a:b - n + 1])
            keep = np.empty(len(x), dtype=bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        else:
            out.append(textnum.run_hashes(w.hashes[a:b], b - a) if b > a else np.zeros(0, dtype=np.uint64))
    return out


def set_digest(x: np.ndarray) -> int:
    """64-bit digest of a sorted set; 0 for the empty set."""
    if not len(x):
        return 0
    total = np.array([x.sum(dtype=np.uint64), np.bitwise_xor.reduce(textnum.mix(x)), len(x)], dtype=np.uint64)
    return int(textnum.run_hashes(total, 3)[0].view(np.int64))


def bit_table(values: DataFrame, column: str) -> np.ndarray:
    """A bit table of ``FILTER_BITS`` bits with the bits of all values set."""
    at = F.pmod(F.col(column), F.lit(FILTER_BITS))
    words = (values.select(F.shiftright(at, 6).alias("w"), F.pmod(at, F.lit(64)).cast("int").alias("b")).groupBy("w")
             .agg(F.expr("bit_or(shiftleft(1L, b))").alias("bits")))
    words = common.columns_of(words)  # at most FILTER_BITS / 64 rows
    table = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    table[words["w"]] = words["bits"]
    return table.view(np.uint64)


def in_table(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the int64 values the bit table lets through."""
    at = np.mod(values, len(table) * 64)
    return (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return (x >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def jaccard_components(df: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text",
                       with_hash: bool = False) -> DataFrame:
    """``(id_col, n_shingles, component_id, set_id, group_id)`` of every row.

    ``component_id`` is the smallest document id reachable by links (``100 * intersection >=
    percent * union`` of distinct n-grams), ``set_id`` the class of equal sets and ``group_id`` the
    component as a number of its own (null for empty sets).  ``with_hash``
    adds ``text_hash`` (xxhash64 of the text), to join results with rows of repeated ids.
    """
    spark = df.sparkSession
    limit, part = Threshold(percent), PART
    docs = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    id_type = docs.schema["_id"].dataType.simpleString()

    def each_set(batch: pa.RecordBatch, at: int):
        texts = common.byte_values(batch.column(at))
        row = 0
        for run in textnum.slices(texts):
            for x in ngram_sets(texts[run], n):
                yield row, x
                row += 1

    # ------------------------------------------------ sets, classes and token order
    def digests(batch: pa.RecordBatch):
        ids, hs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for row, x in each_set(batch, 2):
            yield ids[row], hs[row], set_digest(x), len(x)

    hashed = docs.select("_id", F.xxhash64("_text").alias("_h"), "_text")
    sets = cut_lineage(common.row_map(hashed, digests, f"_id {id_type}, _h long, s long, n long"))

    common.ship(spark)
    classes = sets.where("n > 0").groupBy("s").agg(F.min("_id").alias("low"), F.min(F.struct("_id", "_h")).alias("r"), F.max("n").alias("n"))
    classes = cut_lineage(classes)
    buckets = order_buckets(classes.agg(F.sum("n")).first()[0] or 0)

    def row_table(rows: DataFrame):
        """Bit table of the rows that stand for their sets."""
        return spark.sparkContext.broadcast(bit_table(rows.select(F.xxhash64("r._id", "r._h").alias("row")), "row"))

    standing = row_table(classes)
    text = hashed.select(F.xxhash64("_id", "_h").alias("row"), "_text")

    def each_standing(batch: pa.RecordBatch, table):
        for _, x in each_set(batch.filter(pa.array(in_table(table.value, batch.column(0).to_numpy()))), 1):
            if len(x):
                yield x

    def count(batches):
        seen = np.zeros(buckets, dtype=np.int64)
        for batch in common.small_batches(batches):
            held = list(each_standing(batch, standing))
            if held:
                seen += np.bincount(bucket_of(np.concatenate(held), buckets), minlength=buckets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["k", "c"])

    counted = text.mapInArrow(count, "k int, c long").groupBy("k").agg(F.sum("c").alias("c"))
    counted = common.columns_of(counted)  # at most ``buckets`` rows
    order = np.zeros(buckets, dtype=np.uint16)
    order[counted["k"]] = 64 * np.log2(1 + counted["c"])
    order = spark.sparkContext.broadcast(order)

    # ------------------------------------------------------------- prefix tokens
    def prefixes(let=None):
        done: set[int] = set()  # a task's own: equal sets of one partition give their tokens once

        def run(batch: pa.RecordBatch):
            rank = order.value
            for x in each_standing(batch, standing):
                s, n = set_digest(x), len(x)
                if s in done:
                    continue
                done.add(s)
                c = rank[bucket_of(x, buckets)]
                prefix, reach = limit.places(n)
                first = x[np.argsort(c, kind="stable")[:prefix]].view("<i8")  # equal counts by hash
                if let is None:
                    for place, v in enumerate(first.tolist()):
                        yield v, place < len(reach)
                    continue
                at, usual = np.flatnonzero(in_table(let.value, first)), int(c.mean() * 100)
                if len(at) < limit.tokens(limit.smallest_partner(n)):
                    continue
                most = np.zeros(prefix, dtype=np.int64)
                if np.searchsorted(at, len(reach)) >= limit.tokens(n):  # else too few shared tokens to be the smaller set of a pair
                    most[:len(reach)] = reach
                for v, place, m in zip(first[at].tolist(), at.tolist(), most[at].tolist()):
                    yield v, s, n, place, m, usual
        return run

    # of use are tokens of two sets, at a place where one of them can be the smaller set of a pair
    ends = (common.row_map(text, prefixes(), "t long, small boolean", size=lambda r: 16)
            .groupBy("t").agg(F.count(F.lit(1)).alias("m"), F.max("small").alias("small")).where("m > 1 and small").select("t"))
    ends = cut_lineage(ends)
    common.release(spark)  # every prefix token was moved once; only the shared ones matter from here
    let = spark.sparkContext.broadcast(bit_table(ends, "t"))
    shared = common.row_map(text, prefixes(let), "t long, s long, n long, place long, reach long, c long", size=lambda r: 48)
    shared = cut_lineage(shared.join(ends, "t").distinct())

    # ------------------------------------------- vertical fragments of the sets in question
    def fragments_of(pairs: DataFrame) -> DataFrame:
        """``(s, parts, k, x)``: the sets of all pairs in vertical fragments."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()
        rows_let = row_table(classes.join(wanted, "s"))

        def cut(batch: pa.RecordBatch):
            for x in each_standing(batch, rows_let):
                s, parts = set_digest(x), vertical_parts(len(x), part)
                frag = ((x >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                at = np.searchsorted(frag, np.arange(parts + 1, dtype=np.uint64)).tolist()
                for k in range(parts):
                    yield s, parts, k, x[at[k]:at[k + 1]].tobytes()
                half = parts // 2  # partners just below the step have half as many fragments
                for k in range(half):
                    yield s, half, k, x[at[2 * k]:at[2 * k + 2]].tobytes()

        pieces = common.row_map(text, cut, "s long, parts int, k int, x binary", size=lambda r: 64 + len(r[3]))
        return cut_lineage(pieces.join(wanted, "s", "left_semi").dropDuplicates(["s", "parts", "k"]))

    def overlaps(pairs: DataFrame) -> DataFrame:
        """``(a, b, na, nb, o)``: partial overlaps per fragment, summed per pair."""
        full = F.expr(f"(least(na, nb) - 1) div {PART}")
        bits = F.when(full == 0, 0).otherwise(F.length(F.bin(full)))
        fragments = fragments_of(pairs)
        todo = pairs.withColumn("parts", F.pow(F.lit(2), bits).cast("int"))
        left = fragments.select(F.col("s").alias("a"), "parts", "k", F.col("x").alias("xa"))
        right = fragments.select(F.col("s").alias("b"), "parts", "k", F.col("x").alias("xb"))
        both = todo.join(left, ["a", "parts"]).join(right, ["b", "parts", "k"]).select("a", "b", "na", "nb", "xa", "xb")

        def overlap(batch: pa.RecordBatch):
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for a, b, na, nb, xa, xb in zip(*cols):
                o = len(np.intersect1d(np.frombuffer(xa, np.uint64), np.frombuffer(xb, np.uint64), assume_unique=True))
                yield a, b, na, nb, o

        partial = common.row_map(both, overlap, "a long, b long, na long, nb long, o long", size=lambda r: 40)
        return partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))

    need = F.expr(f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}")
    asked = F.expr(f"1 + least(na, nb) * {100 - percent} div {200 * MORE}")
    early = (F.col("pa") < F.col("na") - need + asked) & (F.col("pb") < F.col("nb") - need + asked)
    linked = 100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")

    # ---------------------------------------------------- 1. each class and its centre
    top = shared.groupBy("t").agg(F.max(F.struct("c", (-F.col("s")).alias("b"), "n", "place")).alias("top"))
    centre = cut_lineage(top.select("t", (-F.col("top.b")).alias("b"), F.col("top.n").alias("nb"), F.col("top.place").alias("pb")))
    star = (shared.select("t", F.col("s").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa")).join(centre, "t")
            .where(F.col("a") != F.col("b")).where(near & early)
            .groupBy("a", "na", "b", "nb").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= asked)
            .groupBy("a", "na").agg(F.max(F.struct("m", "b", "nb")).alias("p")).select("a", "na", "p.b", "p.nb"))
    met = cut_lineage(overlaps(cut_lineage(star)))
    common.release(spark)
    first = met.where(linked).select("a", "b")
    comp = components(first)

    # ------------------------------------------------ 2. pairs across first components
    about = met.select(F.col("a").alias("s"), F.col("b").alias("z"), "o").join(comp.withColumnRenamed("v", "s"), "s", "full")
    placed = (shared.drop("c").join(about, "s", "left").withColumn("g", F.coalesce("comp", "s")).drop("comp"))
    sizes = placed.groupBy("t", "g").agg(F.count(F.lit(1)).alias("m"))
    mixed = sizes.groupBy("t").agg(F.max_by("g", "m").alias("main"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    open_ = placed.join(mixed.select("t", "main").join(centre.select("t", "b", "pb"), "t"), "t")
    # n-grams outside the centre that a partner may share, if this token is one of those asked for: of the n-grams before it all
    # but those asked for are not shared, and at most as many as stand before it in the centre belong to the centre
    outside = F.when(F.col("z") == F.col("b"), F.col("place") - F.col("pb") - F.expr(f"n * {100 - percent} div {200 * MORE}"))
    open_ = open_.withColumn("free", F.col("n") - F.col("o") - F.greatest(outside, F.lit(0))).drop("b", "pb")
    open_ = open_.withColumn("nth", F.row_number().over(Window.partitionBy("s").orderBy("place")))  # among the set's tokens
    open_ = cut_lineage(open_)

    def band(size):
        return F.floor(F.ln(size) / F.lit(math.log(BAND)))

    side = ["s", "n", "place", "g", "z", "o", "free", "nth"]
    in_main = F.col("g") == F.col("main")
    # the last shared token asked for has that many tokens of either set up to it; the larger set may meet its smallest partner
    # the smaller set of a pair goes to the bands that its partners may have
    small = open_.where("reach >= n").where(f"nth >= 1 + n * {100 - percent} div {200 * MORE}").select("t", F.explode(F.sequence(band(F.col("n")), band(F.col("reach")))).alias("band"), in_main.alias("in_main"), *side)
    large = (open_.where(f"nth >= 1 + ((n * {percent} + 99) div 100) * {100 - percent} div {200 * MORE}")
             .select("t", band(F.col("n")).alias("band"), in_main.alias("in_main"), *side))

    def met_at(x: DataFrame, y: DataFrame) -> DataFrame:
        x = x.select("t", "band", *[F.col(c).alias(d) for c, d in zip(side, ("a", "na", "pa", "ga", "za", "oa", "fa", "ta"))])
        y = y.select("t", "band", *[F.col(c).alias(d) for c, d in zip(side, ("b", "nb", "pb", "gb", "zb", "ob", "fb", "tb"))])
        in_order = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
        compared = (F.col("za") == F.col("b")) | (F.col("zb") == F.col("a"))
        apart = (F.col("za") == F.col("zb")) & (F.least("oa", "ob") + F.least("fa", "fb") < need)
        return (x.join(y, ["t", "band"]).where((F.col("ga") != F.col("gb")) & in_order & near & early & (F.least("ta", "tb") >= asked))
                .where(~F.coalesce(compared | apart, F.lit(False))).select("a", "b", "na", "nb"))

    cross = met_at(small.where("not in_main"), large).unionByName(met_at(small.where("in_main"), large.where("not in_main")))
    cross = cut_lineage(cross.distinct().select("a", "na", "b", "nb"))
    left = open_.select("t", F.col("s").alias("a"), F.col("place").alias("pa"))
    right = open_.select("t", F.col("s").alias("b"), F.col("place").alias("pb"))
    cross = (cross.join(left, "a").join(right, ["t", "b"]).where(early)
             .groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= asked).drop("m"))
    cross = cut_lineage(cross)
    common.release(spark)
    edges = first.unionByName(cut_lineage(overlaps(cross).where(linked).select("a", "b")))
    comp = components(edges)

    # ------------------------------------------------------------------- result
    classes = classes.select("s", "low").join(comp.withColumnRenamed("v", "s"), "s", "left").withColumn("g", F.coalesce("comp", "s"))
    lowest = classes.groupBy("g").agg(F.min("low").alias("component_id"))
    full = sets.where("n > 0").join(classes.join(lowest, "g").select("s", "g", "component_id"), "s")
    none = sets.where("n = 0").withColumn("g", F.lit(None).cast("long")).withColumn("component_id", F.col("_id"))
    out = full.unionByName(none)
    extra = [F.col("_h").alias("text_hash")] if with_hash else []
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("s").alias("set_id"), F.col("g").alias("group_id"), *extra)


def vertical_parts(size: int, part: int) -> int:
    """Vertical fragments of a set: the power of two that keeps them at about ``part`` n-grams."""
    return 1 << ((size - 1) // part).bit_length()
