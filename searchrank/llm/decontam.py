"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is ``size`` consecutive words of an item (the whole item if it has fewer).  Its
shingles are runs of three words (of all words, in shorter windows).  A document holds a window when all of
the window's shingles stand in order, so the required overlap is every shingle and the prefix
that must be joined is one: the rarest.

1. Rarity: one pass over the documents counts the shingles that items have; counts are summed
   over all documents.  Shingles are ordered by count, then by hash.
2. Prefix join: a second pass keeps, for every document, the places whose shingle is some
   window's rarest, with the words around it.  These places are joined with the windows on that shingle.
3. Length and positional bounds: the window must fit in the document around the place, so
   enough words stand before and after it.
4. Verification: the words around the place equal the window's words, hash by hash.

Both passes only test membership in sorted arrays of at most ``SHINGLES_AT_ONCE`` hashes; a
larger benchmark goes through in blocks, each broadcast in its turn, and the places of all
blocks are joined together.  Matches meet per document text, never per item or
window, so an item that a third of all documents hold is spread like its documents.

Defined results: null or empty texts have no words, no hits and are not contaminated; items
without words have no windows; items with the same id count once; the windows of items with a null id
count as hit words but the null is not listed; rows with equal id and text get the same result each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import common, textnum

SHINGLE = 3
SHINGLES_AT_ONCE = 500_000  # 8 bytes each


def item_windows(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``(item, words, n)``: the word hashes of each window of each item, as bytes."""
    def run(batch: pa.RecordBatch):
        keys, texts = batch.column(0).to_pylist(), [t or b"" for t in common.byte_values(batch.column(1))]
        for part in textnum.slices(texts):
            w = textnum.words_of(texts[part], textnum.NON_ALNUM)
            for j, key in enumerate(keys[part]):
                h = w.hashes[w.first[j]:w.first[j + 1]]
                k = min(size, len(h))
                for i in range(len(h) - k + 1 if k else 0):
                    yield key, h[i:i + k].tobytes(), k

    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string"))
    return common.row_map(rows, run, "item string, words binary, n int", size=lambda r: 200).distinct()


def window_shingles(words: bytes) -> np.ndarray:
    h = np.frombuffer(words, dtype=np.uint64)
    return textnum.run_hashes(h, min(SHINGLE, len(h)))


def shingles_of(windows: DataFrame) -> DataFrame:
    """``(item, words, n, offset, shingle, s)``: every shingle of every window, ``s`` its words."""
    def run(batch: pa.RecordBatch):
        for item, words, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for k, x in enumerate(window_shingles(words).view("<i8").tolist()):
                yield item, words, n, k, x, min(SHINGLE, n)

    return common.row_map(windows, run, "item string, words binary, n int, offset int, shingle long, s int",
                          size=lambda r: 200)


def blocks_of(shingles: DataFrame) -> Iterator[dict[int, np.ndarray]]:
    """Distinct shingles in sorted arrays by their word count, in blocks of bounded size; at least one block.

    A block is a hash range of the shingles with about half of ``SHINGLES_AT_ONCE``; only the one in use is on the driver.
    """
    n_blocks = max(1, -(-2 * shingles.count() // SHINGLES_AT_ONCE))
    part = shingles.withColumn("block", F.pmod(F.xxhash64("shingle"), F.lit(n_blocks)))
    for b in range(n_blocks):
        got = common.columns_of(part.where(F.col("block") == b).select("shingle", "s").distinct())
        yield {int(s): np.sort(got["shingle"][got["s"] == s].astype(np.int64).view(np.uint64)) for s in np.unique(got["s"])}


def places(h: np.ndarray, s: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, index in ``known``) of the document shingles that ``known`` holds."""
    x = textnum.run_hashes(h, s)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    hit = np.flatnonzero(known[at] == x)
    return hit, at[hit]


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id_col, *carry, n_words, n_hit, items)`` of every row; ``items`` is sorted."""
    if clash := set(carry) & {id_col, "n_words", "n_hit", "items"}:
        raise ValueError(f"carried columns clash with the result's: {sorted(clash)}")
    spark = docs.sparkSession
    shingles = cut_lineage(shingles_of(item_windows(items, size, item_id, item_text)))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
                       *[F.col(c) for c in carry])
    id_type = rows.schema["_id"].dataType.simpleString()
    keyed = rows.select("_id", F.xxhash64("_text").alias("_h"), "_text")

    # 1. rarity
    def count(known):
        def run(batches):
            sums: dict[int, np.ndarray] = {s: np.zeros(len(k), dtype=np.int64) for s, k in known.value.items()}
            for batch in common.small_batches(batches):
                texts = common.byte_values(batch.column(0))
                for part in textnum.slices(texts):
                    w = textnum.words_of(texts[part], textnum.NON_ALNUM)
                    for s, k in known.value.items():
                        # runs over the ends of texts only move the order, never the result
                        at = places(w.hashes, s, k)[1]
                        sums[s] += np.bincount(at, minlength=len(k))
            got = [(k[np.flatnonzero(sums[s])].view("<i8"), sums[s][np.flatnonzero(sums[s])]) for s, k in known.value.items()]
            for x, n in got:
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(n)], names=["shingle", "n_seen"])
        return run

    common.ship(spark)
    seen = spark.createDataFrame([], "shingle long, n_seen long")
    for block in blocks_of(shingles):  # a shingle is in one block
        held = spark.sparkContext.broadcast(block)
        one = keyed.select("_text").mapInArrow(count(held), "shingle long, n_seen long").groupBy("shingle").agg(F.sum("n_seen").alias("n_seen"))
        seen = seen.unionByName(cut_lineage(one))
        held.unpersist()

    # a window whose rarest shingle no document holds cannot occur
    rarest = F.min(F.struct(F.coalesce("n_seen", F.lit(0)).alias("n_seen"), "shingle", "offset", "s")).alias("r")
    prefix = (shingles.join(seen, "shingle", "left").groupBy("item", "words", "n").agg(rarest)
              .where("r.n_seen > 0").select("item", "words", "n", "r.shingle", "r.offset", "r.s"))
    prefix = cut_lineage(prefix)

    # 2. prefix join
    around = size - 1

    def find(known):
        def run(batch: pa.RecordBatch):
            ids, hs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.byte_values(batch.column(2))
            for part in textnum.slices(texts):
                w = textnum.words_of(texts[part], textnum.NON_ALNUM)
                for j, (d, x) in enumerate(zip(ids[part], hs[part])):
                    h = w.hashes[w.first[j]:w.first[j + 1]]
                    found = []
                    for s, k in known.value.items():
                        for p, i in zip(*(v.tolist() for v in places(h, s, k))):
                            left = min(p, around)
                            found.append((int(k[i].view(np.int64)), p, left, h[p - left:p + size].tobytes()))
                    yield d, x, len(h), found
        return run

    schema = (f"_id {id_type}, _h long, n_words long, "
              "found array<struct<shingle: long, at: long, around_left: int, around: binary>>")
    marked = seen_at = None
    for block in blocks_of(prefix):
        held = spark.sparkContext.broadcast(block)
        one = common.row_map(keyed, find(held), schema, size=lambda r: 64 + 240 * len(r[3]))
        one = cut_lineage(one if marked is None else one.where(F.size("found") > 0))
        held.unpersist()
        marked = one if marked is None else marked  # the first pass has every row
        hit = one.where(F.size("found") > 0)
        seen_at = hit if seen_at is None else seen_at.unionByName(hit)

    # 3. bounds and 4. verification
    place = seen_at.select("_id", "_h", "n_words", F.explode("found").alias("f")).select("_id", "_h", "n_words", "f.*")
    pair = place.join(prefix, "shingle")
    first = F.col("at") - F.col("offset")
    pair = pair.where((F.col("offset") <= F.col("around_left")) & (first + F.col("n") <= F.col("n_words")))
    from_byte = (F.col("around_left") - F.col("offset")) * 8 + 1
    pair = pair.where(F.substring(F.col("around"), from_byte, F.col("n") * 8) == F.col("words"))
    hits = pair.groupBy("_id", "_h").agg(
        F.collect_set(F.struct(first.alias("a"), (first + F.col("n")).alias("b"))).alias("spans"),
        F.sort_array(F.collect_set("item")).alias("items"))
    covered = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["b"]).alias("end"),
                                (acc["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(acc["end"], x["a"]))).alias("n")),
        lambda acc: acc["n"])
    hits = hits.select(F.col("_id").alias("_hid"), F.col("_h").alias("_hh"), covered.alias("n_hit"), "items")
    if carry:
        base = rows.withColumn("_h", F.xxhash64("_text"))
        words = marked.groupBy("_id", "_h").agg(F.max("n_words").alias("n_words"))
        words = words.select(F.col("_id").alias("_wid"), F.col("_h").alias("_wh"), "n_words")
        base = base.join(words, base["_id"].eqNullSafe(words["_wid"]) & (base["_h"] == words["_wh"]), "left")
    else:
        base = marked.drop("found")
    out = base.join(hits, base["_id"].eqNullSafe(hits["_hid"]) & (base["_h"] == hits["_hh"]), "left")
    return out.select(F.col("_id").alias(id_col), *carry, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))
