"""SimHash near duplicates: exact Hamming links by bit-sliced comparison, with connected components.

**Fingerprint.**  A-Z are lower-cased, words split at white space; the hashes of a text's ``width``-word
shingles (repeats included; fewer words: the whole sequence) vote on each of 64 bits.  A bit is one if over half
of the hashes have it.  Texts without words have fingerprint zero, linked like any other.

**Candidates.**  Rows of one fingerprint are a class from the start; only distinct fingerprints are compared.
The 64 bits are cut into ``radius + extra`` blocks: two fingerprints within ``radius`` bits agree on
``extra`` whole blocks, so every choice of ``extra`` blocks gives one table whose key is their bits,
and each link shares a key in some table.  ``extra`` follows from the number of
fingerprints, so that a key has about ``BUCKET`` of them at most; any value gives the same links.  Keys
with more than ``CHUNK`` fingerprints are dealt in chunks, one cell per pair of chunks, so no task holds a whole hot key.

**Comparison.**  A task sorts its fingerprints by cell and stores them vertically: plane p packs bit p of 64 fingerprints
into one word.  Distances of a query to all 64 lanes of a word are counted together: eight planes at a
time go through carry-save adders into bit-sliced counters of ones, twos and fours, lanes over the radius are marked, and
words whose lanes are all marked are abandoned before the next planes.  In a large cell leaders come first (the
fingerprint nearest the majority of those left takes all within the radius); words whose lanes and query already
share a leader are skipped, so a family of m near copies is not compared m * m times.  A
cell returns a spanning forest of its links, at most one row per fingerprint, never all pairs.

Defined results: null text is empty text; rows that share an id keep a row each; null ids never become a component's id
unless all of it are null; an empty table gives no rows.  Very long texts are hashed in blocks of
``BLOCK`` bytes.  Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import find_hot, join_per_key
from ..session import cut_lineage
from . import common
from .components import components

BITS = 64
SEED = 42
BLOCK = 1 << 20    # bytes of a text hashed at a time
BUCKET = 2048      # fingerprints a key should have at most, if they were spread evenly
CHUNK = 8192       # fingerprints of one key in one cell
HELD = 1 << 16     # fingerprints compared at a time, beyond one cell
PAIRS = 1 << 19    # (query, word) pairs counted at a time
LARGE = 512        # cells from this size get leaders
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_U = np.uint64


# ---------------------------------------------------------------- fingerprints
def word_blocks(text: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """Lower-cased words of a text, some ``size`` bytes at a time, cut at white space."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()
        at = end


def shingle_votes(words: list[bytes], width: int) -> tuple[np.ndarray, int]:
    """(hashes that have each bit, number of hashes) of the shingles of at least ``width`` words."""
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b - 1], SEED) for a, b in zip([0, *ends], ends[width - 1:])])
    bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8)).reshape(-1, BITS)
    return bits.sum(axis=0, dtype=np.int64), len(bits)


def fingerprint(text: bytes, width: int = 4) -> int:
    """Fingerprint of a text (unsigned)."""
    votes, n, held = np.zeros(BITS, dtype=np.int64), 0, []
    for block in word_blocks(text):
        held += block
        if len(held) >= width:
            more, m = shingle_votes(held, width)
            votes, n = votes + more, n + m
            held = held[len(held) - width + 1:]
    if n == 0:
        if not held:
            return 0
        votes, n = shingle_votes(held, len(held))
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


# ------------------------------------------------------- bit-sliced comparison
def planes_of(fp: np.ndarray) -> np.ndarray:
    """(64, words): bit p of fingerprint r is bit ``r % 64`` of ``planes[p, r // 64]``."""
    padded = np.zeros(-(-len(fp) // 64) * 64, dtype=_U)
    padded[:len(fp)] = fp
    rows = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(rows.T), axis=1, bitorder="little").view(_U)


def _add(a, b, c):
    """Carry-save adder: (sum, carry) of three bit vectors."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _over(ones, twos, fours, radius: int):
    """Lanes whose three-bit count is above the radius."""
    above, equal = np.zeros_like(ones), ~np.zeros_like(ones)
    for bit, lane in ((4, fours), (2, twos), (1, ones)):
        if radius & bit:
            equal = equal & lane
        else:
            above = above | (equal & lane)
            equal = equal & ~lane
    return above


def lanes_within(planes: np.ndarray, queries: np.ndarray, word: np.ndarray, outside: np.ndarray, radius: int):
    """(index, lanes): the (query, word) pairs that have lanes within the radius, and those lanes as bits.

    ``outside`` marks lanes that do not count.  Pairs whose lanes are all over the radius are abandoned
    after each eight planes.
    """
    at = np.arange(len(word))
    ones, twos, fours = (np.zeros(len(word), dtype=_U) for _ in range(3))
    over = outside
    for first in range(0, BITS, 8):
        x = [planes[p][word] ^ (_U(0) - ((queries >> _U(p)) & _U(1))) for p in range(first, first + 8)]
        ones, a = _add(ones, x[0], x[1])
        ones, b = _add(ones, x[2], x[3])
        twos, c = _add(twos, a, b)
        ones, a = _add(ones, x[4], x[5])
        ones, b = _add(ones, x[6], x[7])
        twos, d = _add(twos, a, b)
        fours, eights = _add(fours, c, d)
        over = over | eights | _over(ones, twos, fours, radius)
        alive = np.flatnonzero(~over)
        if len(alive) < len(at):
            at, word, queries, over = at[alive], word[alive], queries[alive], over[alive]
            ones, twos, fours = ones[alive], twos[alive], fours[alive]
    return at, ~over


def leaders_of(fp: np.ndarray, radius: int) -> np.ndarray:
    """Leader of each fingerprint of a large cell (itself, if none took it)."""
    leader, left = np.arange(len(fp)), np.arange(len(fp))
    while len(left) >= 64:
        rest = fp[left]
        votes = np.unpackbits(rest.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        middle = np.packbits(2 * votes > len(rest), bitorder="little").view(_U)[0]
        k = int(np.argmin(np.bitwise_count(rest ^ middle)))
        near = np.bitwise_count(rest ^ rest[k]) <= radius
        leader[left[near]] = left[k]
        left = left[~near]
        if near.sum() < max(32, len(left) // 16):
            break
    return leader


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` indices by the links."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))  # hang roots below smaller roots
        while not np.array_equal(up := label[label], label):
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def cell_links(cell: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside each cell; ``cell`` is sorted, fingerprints of a cell are distinct."""
    n = len(fp)
    start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.append(start, n))
    links_a, links_b = [], []
    leader = np.full(n, -1)
    large = np.flatnonzero(size >= LARGE)
    if len(large):
        fp = fp.copy()
        for s, m in zip(start[large].tolist(), size[large].tolist()):
            own = leaders_of(fp[s:s + m], radius)
            count = np.bincount(own, minlength=m)
            order = np.lexsort((own, -count[own]))  # the largest families lie together
            place = np.empty(m, dtype=np.int64)
            place[order] = np.arange(m)
            fp[s:s + m] = fp[s:s + m][order]
            leader[s:s + m] = place[own[order]] + s
            links_a.append(np.arange(s, s + m))
            links_b.append(leader[s:s + m])
    planes = planes_of(fp)
    end = np.repeat(start + size, size)
    row = np.arange(n)
    first, last = row // 64, (end - 1) // 64
    held = np.full(planes.shape[1] * 64, -1)
    held[:n] = leader
    held = held.reshape(-1, 64)
    pure = np.where((held == held[:, :1]).all(axis=1), held[:, 0], -2)  # the one leader of all lanes of a word
    counts = last - first + 1
    ends = np.cumsum(counts)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        q = np.repeat(row[at:stop], counts[at:stop])
        w = np.arange(len(q)) - np.repeat(ends[at:stop] - counts[at:stop] - (ends[at - 1] if at else 0), counts[at:stop]) + first[q]
        at = stop
        if len(large):
            todo = (leader[q] < 0) | (pure[w] != leader[q])
            q, w = q[todo], w[todo]
        # lanes after the query and before its cell's end
        low = np.clip(q + 1 - w * 64, 0, 64)
        high = np.clip(end[q] - w * 64, 0, 64)
        inside = _ones(high) & ~_ones(low)
        k, lanes = lanes_within(planes, fp[q], w, ~inside, radius)
        which, lane = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        links_a.append(q[k[which]])
        links_b.append(w[k[which]] * 64 + lane)
    label = forest(n, np.concatenate(links_a), np.concatenate(links_b))
    moved = np.flatnonzero(label != row)
    return fp[moved], fp[label[moved]]


def _ones(count: np.ndarray) -> np.ndarray:
    """Words with the lowest ``count`` (0 to 64) bits set."""
    return np.where(count >= 64, ~_U(0), (_U(1) << (count % 64).astype(_U)) - _U(1))


# ------------------------------------------------------------------- operator
def tables_of(n: int, radius: int) -> list[int]:
    """Bit masks of the tables' keys for ``n`` fingerprints (signed 64-bit integers)."""
    for extra in range(1, BITS - radius):
        blocks = radius + extra
        cuts = [BITS * k // blocks for k in range(blocks + 1)]
        if n <= BUCKET << (extra * (BITS // blocks)) or extra == 4:
            break
    block_masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in itertools.pairwise(cuts)]
    masks = [sum(chosen) for chosen in itertools.combinations(block_masks, extra)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def hamming_links(prints: DataFrame, radius: int) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints ``fp`` within the radius, a spanning forest per cell."""
    if not 0 <= radius <= 7:
        raise ValueError("radius is between 0 and 7")
    masks = tables_of(prints.count(), radius)
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                                for t, m in enumerate(masks)]))
    keyed = prints.select("fp", table.alias("k")).select("k.t", "k.key", "fp")
    hot = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > CHUNK)
    hot = cut_lineage(hot.select("t", "key", F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks")))
    if hot.isEmpty():
        cells = keyed.select("t", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    else:
        # at most (tables * fingerprints / CHUNK) rows: Spark broadcasts them by their measured size
        cells = keyed.join(hot, ["t", "key"], "left")
        mine = F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int")
        cells = cells.withColumn("c", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
        cells = cells.select("t", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp")
    cells = cells.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = np.zeros((0, 5), dtype=np.int64), None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = np.concatenate([held, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)])
                if len(held) < HELD:
                    continue
            if not len(held):
                continue
            change = np.concatenate([[True], (held[1:, :4] != held[:-1, :4]).any(axis=1)])
            last = len(held) if batch is None else int(np.flatnonzero(change)[-1])  # the last cell may go on
            if last:
                a, b = cell_links(np.cumsum(change)[:last], np.ascontiguousarray(held[:last, 4]).view(_U), radius)
                held = held[last:]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    common.ship(prints.sparkSession)
    return cells.mapInArrow(compare, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` of every row; ``fingerprint`` is 16 lowercase hex digits."""
    docs = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    id_type = docs.schema["_id"].dataType.simpleString()

    def hashed(batch: pa.RecordBatch):
        for d, text in zip(batch.column(0).to_pylist(), common.byte_values(batch.column(1))):
            yield d, int(np.uint64(fingerprint(text, width)).view(np.int64))

    prints = cut_lineage(common.row_map(docs, hashed, f"_id {id_type}, fp long", size=lambda r: 32))
    classes = cut_lineage(prints.groupBy("fp").agg(F.min("_id").alias("low")))
    comp = components(hamming_links(classes.select("fp"), radius))
    joined = classes.join(comp.withColumnRenamed("v", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    lowest = joined.groupBy("comp").agg(F.min("low").alias("component_id"))
    per_class = cut_lineage(joined.join(lowest, "comp").select("fp", "component_id"))
    out = join_per_key(prints, per_class, "fp", "inner", hot=find_hot(prints, "fp"))
    return out.select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
