"""Spelling variant grouping by Bloom-guided neighbourhoods.

Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF) of at least ``min_chars`` code points, A-Z lower-cased, that occur
at least twice.  Two words are near if one inserted, deleted or replaced code point turns one into the other.

1. Words are counted in the task, summed over tasks, and get a 64-bit polynomial key over their code points.
2. The vocabulary's keys go into blocked Bloom filters, one shard per word length: a key sets ``PROBES`` bits of one 64-bit block.
   The filters are broadcast; ``FILTER_BLOCKS`` bounds their size.  A larger vocabulary is dealt by key to several passes, each with
   filters of that size.
3. Every word generates its edits: each deletion, probed in the shard one shorter, and each replacement by a larger
   letter of the alphabet, probed in its own shard.  An insertion is a deletion seen from the longer word, a smaller letter a larger
   one seen from the other word, so every near pair is generated once.  Edits exist as keys only: a
   key after an edit follows from the word's prefix sums, for many words and places at a time.
4. Only edits that a filter lets through are shuffled.  An exact join with the vocabulary by key and
   a comparison of the edited strings themselves remove false positives and equal keys of different words.

A word's form is its near word of largest count (ties: smallest in code-point order) if that count is at least ``ratio`` times
its own.  Counts grow along forms, so roots are found by doubling in a few rounds of joins.

Defined results: null and empty texts have no words; a null id counts as the empty string where ids enter a hash;
repeated rows count as often as they occur; an empty table gives no rows.  Long texts are read whole, long words are
edited in blocks of places.  Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import common, textnum

ALPHABET = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], dtype=np.uint8)
KEYS_PER_BLOCK = 4            # 16 bits a key
PROBES = 4
FILTER_BLOCKS = 1 << 22       # 32 MB of filters broadcast at a time
TASK_WORDS = 200_000          # distinct words a task holds before it hands on their counts
PLACES = 1 << 18              # (word, place) pairs edited at a time
MULT = 0x9E3779B97F4A7C15
BACK = np.uint64(pow(MULT, -1, 2**64))
_VALUE = np.random.Generator(np.random.PCG64(12)).integers(1, 2**63, size=256, dtype=np.uint64)
_U = np.uint64


# -------------------------------------------------------------------- words
def count_words(df: DataFrame, min_chars: int, change: Callable[[str, str], str] | None, id_col: str, text_col: str) -> DataFrame:
    """``(word, n)`` over all texts; ``change(id, run)`` may rewrite a run of a document."""
    docs = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    find = re.compile("[a-zÀ-ÿ]{%d,}" % min_chars).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.string()), pa.array(list(total.values()), type=pa.int64())],
                                              names=["word", "n"])
        for batch in common.small_batches(batches):
            for d, text in zip(batch.column(0).to_pylist(), common.byte_values(batch.column(1))):
                if not text:
                    continue
                for word, n in Counter(find(text.lower().decode("utf-8"))).items():
                    if change is not None:
                        word = change(d, word)
                    if len(word) >= min_chars:
                        total[word] += n
            if len(total) >= TASK_WORDS:
                yield out()
                total.clear()
        yield out()

    common.ship(df.sparkSession)
    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def drop_by_crc(doc_id: str, run: str, one_in: int = 31) -> str:
    """The run without one code point for one in ``one_in`` (document, run) pairs by crc32, else the run."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % one_in:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


# --------------------------------------------------------------------- keys
def letters(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), length)


def finish(h: np.ndarray, length: int) -> np.ndarray:
    return textnum.mix(h + _U(length * MULT % 2**64))


def powers(length: int) -> np.ndarray:
    out = np.full(length, _U(MULT), dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_keys(words: list[str]) -> np.ndarray:
    """64-bit keys (signed)."""
    out = np.zeros(len(words), dtype=np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for length in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == length)
        step = max(1, PLACES // length)
        for k in range(0, len(at), step):
            part = at[k:k + step]
            x = letters([words[i] for i in part], length)
            out[part] = finish((_VALUE[x] * powers(length)).sum(axis=1, dtype=np.uint64), length)
    return out.view(np.int64)


# ------------------------------------------------------------------ filters
def block_and_bits(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, mask of ``PROBES`` bits) of unsigned keys in a shard of ``blocks`` blocks (a power of two)."""
    mask = np.zeros(len(keys), dtype=np.uint64)
    for k in range(PROBES):
        mask |= _U(1) << ((keys >> _U(6 * k)) & _U(63))
    return (keys >> _U(6 * PROBES)).astype(np.int64) & (blocks - 1), mask


class Filters:
    """Layout of one pass: per word length a shard of blocks in one array."""

    def __init__(self, counts: dict[int, int], passes: int):
        self.passes = passes
        self.shards: dict[int, tuple[int, int]] = {}
        self.blocks = 0
        for length, n in sorted(counts.items()):
            size = 1 << max(0, -(-n // (passes * KEYS_PER_BLOCK)) - 1).bit_length()
            self.shards[length] = self.blocks, size
            self.blocks += size

    def places(self, keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        first, size = self.shards[length]
        block, mask = block_and_bits(keys, size)
        return block + first, mask

    def turn(self, keys: np.ndarray) -> np.ndarray:
        """The pass that a key belongs to."""
        return ((keys >> _U(32)) % _U(self.passes)).astype(np.int64)


def layout(counts: dict[int, int]) -> Filters:
    passes = 1
    while (found := Filters(counts, passes)).blocks > max(FILTER_BLOCKS, 2 * len(counts)):
        passes += 1
    return found


# -------------------------------------------------------------------- edits
def edits(x: np.ndarray, first: int, stop: int, h: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, letter or 0, word, place, key) of the deletions and larger-letter replacements at places ``first:stop``.

    ``x`` holds words of one length, ``h`` their unfinished hashes, ``before`` the hash of each word before ``first``.
    """
    length = x.shape[1]
    part = x[:, first:stop]
    up = powers(length)[first:stop]
    own = _VALUE[part] * up
    pre = before[:, None] + np.cumsum(own, axis=1, dtype=np.uint64) - own
    after = x[:, first + 1:stop + 1]
    last = np.ones(part.shape, dtype=bool)  # deleting any of a run of equal letters is one edit
    last[:, :after.shape[1]] = after != part[:, :after.shape[1]]
    w, p = np.nonzero(last)
    yield length - 1, 0, w, p + first, finish(pre[w, p] + (h[w] - pre[w, p] - own[w, p]) * BACK, length - 1)
    for c in ALPHABET.tolist():
        w, p = np.nonzero(part < c)
        yield length, c, w, p + first, finish(h[w] - own[w, p] + _VALUE[c] * up[p], length)


def probe(words: list[str], filters: Filters, table: np.ndarray, turn: int):
    """(word index, key, place, letter) of the edits that a filter lets through."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for length in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == length)
        wide = min(length, PLACES)
        for k in range(0, len(at), max(1, PLACES // wide)):
            mine = at[k:k + max(1, PLACES // wide)]
            x = letters([words[i] for i in mine], length)
            h = (_VALUE[x] * powers(length)).sum(axis=1, dtype=np.uint64)
            before = np.zeros(len(mine), dtype=np.uint64)
            for first in range(0, length, wide):
                stop = min(length, first + wide)
                for size, letter, w, place, key in edits(x, first, stop, h, before):
                    if size not in filters.shards or not len(key):
                        continue
                    block, mask = filters.places(key, size)
                    hit = np.flatnonzero(table[block] & mask == mask)
                    if filters.passes > 1:
                        hit = hit[filters.turn(key[hit]) == turn]
                    if len(hit):
                        yield mine[w[hit]], key[hit].view(np.int64), place[hit], letter
                before = before + (_VALUE[x[:, first:stop]] * powers(length)[first:stop]).sum(axis=1, dtype=np.uint64)


# ----------------------------------------------------------------- operator
def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """``(a, b, na, nb)``: every near pair of ``vocabulary(word, n, key)`` once."""
    spark = vocabulary.sparkSession
    counts = {r["size"]: r["c"] for r in vocabulary.groupBy(F.length("word").alias("size")).agg(F.count(F.lit(1)).alias("c")).collect()}
    filters = layout(counts)
    found = None
    for turn in range(filters.passes):
        def mark(batches, turn=turn):
            for batch in batches:
                keys, sizes = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
                for length in np.unique(sizes).tolist():
                    mine = keys[sizes == length]
                    block, mask = filters.places(mine[filters.turn(mine) == turn], length)
                    yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(mask.view(np.int64))], names=["block", "bits"])

        marked = vocabulary.select("key", F.length("word").alias("size")).mapInArrow(mark, "block long, bits long")
        rows = common.columns_of(marked.groupBy("block").agg(F.expr("bit_or(bits)").alias("bits")))  # at most FILTER_BLOCKS rows
        table = np.zeros(filters.blocks, dtype=np.int64)
        table[rows["block"]] = rows["bits"]
        table = spark.sparkContext.broadcast(table.view(np.uint64))

        def ask(batches, turn=turn, table=table):
            for batch in common.small_batches(batches, 8192):
                words, keys = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                for w, key, place, letter in probe(words, filters, table.value, turn):
                    put = pa.array(["" if letter == 0 else chr(letter)] * len(w))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[w]), pa.array(key), pa.array(place), put], names=["src", "key", "place", "put"])

        hits = vocabulary.select("word", "key").mapInArrow(ask, "src long, key long, place long, put string")
        exact = hits.join(vocabulary.select("key", F.col("word").alias("b"), F.col("n").alias("nb")), "key")
        exact = exact.join(vocabulary.select(F.col("key").alias("src"), F.col("word").alias("a"), F.col("n").alias("na")), "src")
        edited = F.expr("concat(substring(a, 1, int(place)), put, substring(a, int(place) + 2))")
        exact = cut_lineage(exact.where(edited == F.col("b")).select("a", "b", "na", "nb").distinct())
        found = exact if found is None else found.unionByName(exact)
    return found


def group_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 7, min_count: int = 2,
                   ratio: int = 10, change: Callable[[str, str], str] | None = None) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of every word."""
    common.ship(df.sparkSession)

    def keyed(batches):
        for batch in batches:
            key = word_keys(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], names=["word", "n", "key"])

    words = count_words(df, min_chars, change, id_col, text_col).where(F.col("n") >= min_count)
    vocabulary = cut_lineage(words.mapInArrow(keyed, "word string, n long, key long"))
    pairs = near_pairs(vocabulary)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("nb").alias("na"), F.col("na").alias("nb")))
    best = both.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("nb")).alias("m"), F.col("b").alias("w"))).alias("best"))
    out = vocabulary.join(best.withColumnRenamed("a", "word"), "word", "left")
    takes = -F.col("best.m") >= ratio * F.col("n")
    out = cut_lineage(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.w")).alias("form"),
                                 F.when(takes, -F.col("best.m")).alias("form_n")))
    roots = out.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:  # doubling: a chain of k forms takes log2(k) rounds
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut_lineage(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = not step.where("moved").isEmpty()
        roots = step.drop("moved")
        if not moved:
            break
    return out.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
