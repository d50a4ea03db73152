"""Substring deduplication over sliding sentence spans.

A text is cut into sentences: after a word ending in ``.``, ``!`` or ``?`` (closing quotes
and brackets may follow) and at line ends.  A sentence of more than ``LONG`` words is also cut after the word
with the least hash of every ``WINDOW`` consecutive words of it (the last of equal ones), so no piece has over
``WINDOW`` words and the cuts move with the words.  Pieces count as sentences.  Any 51 words that two texts
share hold a common span, wherever they start and end: at most 15 words at either end are cut differently.

Removed is what every run of at least ``min_sentences`` sentences and ``min_words`` words covers that is repeated.  Two
kinds of span are hashed for it: from every sentence the shortest such run that starts there, and
to every sentence the shortest one that ends there.  A sentence of a longer run lies in a span inside that run,
so spans cover what all runs cover.  Spans are hashed to 128 bits (words lower-cased A-Z) and joined
over all documents:

1. smallest and largest document per span, combined before the shuffle, so a span that a third
   of all documents hold is one row per task; spans with two documents set bits in a table of fixed size,
   which is broadcast;
2. (span, document, text, place) rows of the spans that the table lets through, once a task however often a row
   repeats: few of all spans are moved a second time; an exact join finds the first holder of each;
3. spans with two documents go back to every holder but the smallest, and one pass over the
   texts removes the sentences that such a span covers, or that a span covers which occurred
   earlier in the same text.  Spans are found again by their places.

Rows that share a document id count as one document; null ids are one document, before all
others.  Null and empty texts have no sentences.  Kept sentences keep their own bytes and
the white space after them; removed ones go with theirs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path
from . import common, textnum
from .ngram_join import bit_table, in_table

LONG, WINDOW = 13, 8
NULL_ID = -2**63
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True
_CLOSE = np.zeros(256, dtype=bool)
_CLOSE[list(b"\"')]}")] = True


def sentence_starts(w: textnum.Words, a: int, b: int) -> np.ndarray:
    """Index (from ``a``) of the first word of each sentence among words ``a`` to ``b``, then ``b - a``."""
    n = b - a
    if n == 0:
        return np.zeros(1, dtype=np.int64)
    starts, ends, data = w.starts[a:b], w.ends[a:b], w.data
    last = data[ends - 1]
    stop = _STOP[last]
    for k in (2, 3):  # up to two closing marks after the stop
        at = ends - k
        stop |= _CLOSE[last] & (at >= starts) & _STOP[data[np.maximum(at, 0)]]
    lo, hi = int(starts[0]), int(ends[-1])
    feeds = np.concatenate([[0], np.cumsum(data[lo:hi] == 10)])
    stop[:-1] |= feeds[starts[1:] - lo] > feeds[ends[:-1] - lo]
    stop[-1] = True
    cut = np.concatenate([[0], np.flatnonzero(stop) + 1])
    size = np.diff(cut)
    if (size > LONG).any():
        sentence = np.repeat(np.arange(len(size)), size)
        at = np.arange(n - WINDOW + 1)
        at = at[(sentence[at] == sentence[at + WINDOW - 1]) & (size[sentence[at]] > LONG)]
        windows = np.lib.stride_tricks.sliding_window_view(w.hashes[a:b], WINDOW)[at, ::-1]
        cut = np.union1d(cut, at + WINDOW - np.argmin(windows, axis=1))
    return cut


def spans_of(w: textnum.Words, a: int, b: int, min_sentences: int, min_words: int):
    """(sentence starts, first sentence, end sentence, 128-bit hash) of each span of a text, by first sentence."""
    cut = sentence_starts(w, a, b)
    m = len(cut) - 1
    at = np.arange(m)
    stop = np.maximum(at + min_sentences, np.searchsorted(cut, cut[:-1] + min_words, "left")) if m else at
    start = np.minimum(at + 1 - min_sentences, np.searchsorted(cut, cut[1:] - min_words, "right") - 1) if m else at
    by_start, by_end = stop <= m, start >= 0
    span = np.unique(np.concatenate([at[by_start] * (m + 1) + stop[by_start], start[by_end] * (m + 1) + at[by_end] + 1]))
    first, stop = span // (m + 1), span % (m + 1)
    h = w.hashes[a:b]
    one = textnum.span_hash(h, cut[first], cut[stop])
    two = textnum.span_hash(textnum.mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A)), cut[first], cut[stop])
    return cut, first, stop, np.stack([one, two], axis=1).view("<i8")


def dedup_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = 2,
                min_words: int = 15) -> DataFrame:
    """``(id_col, n_sentences, n_shared, n_removed, n_removed_words, first_docs, kept)`` of every row.

    ``n_shared`` counts sentences in spans that another document also holds (the first
    holder has them too), ``n_removed`` those taken out, ``first_docs`` the documents that
    keep the passages removed here, ``kept`` the remaining text.
    """
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    docs = docs.withColumn("_h", F.xxhash64("_text"))

    def found_spans(batch, done: set | None = None):
        """(rows, places, hashes): spans of a batch's texts, each once per text; texts in ``done`` are left out."""
        texts = common.byte_values(batch.column(2))
        if done is not None:
            for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if key in done:
                    texts[k] = b""
                done.add(key)
        for part in textnum.slices(texts):
            w = textnum.words_of(texts[part], textnum.SPACES)
            found = [spans_of(w, w.first[j], w.first[j + 1], min_sentences, min_words)[3] for j in range(len(w.first) - 1)]
            sizes = np.array([len(k) for k in found])
            row = np.repeat(np.arange(len(found)), sizes)
            one, two = np.concatenate(found).T
            order = np.lexsort((two, one, row))
            row, one, two = row[order], one[order], two[order]
            new = np.ones(len(row), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            row = row[new]
            yield part.start + row, order[new] - (np.cumsum(sizes) - sizes)[row], one[new], two[new]

    def emit(batches):
        for batch in common.small_batches(batches):
            ids = batch.column(0).to_numpy()
            for row, _, one, _ in found_spans(batch):
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(ids[row])], names=["_one", "_id"])

    common.ship(spark)
    texts = docs.select("_id", "_h", "_text")

    def shared_table() -> np.ndarray:
        """Bits of the first halves of the hashes that several documents have."""
        first = texts.mapInArrow(emit, "_one long, _id long").groupBy("_one").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi"))
        return bit_table(first.where("lo < hi"), "_one")

    table = spark.sparkContext.broadcast(shared_table())
    common.release(spark)  # that shuffle's files go before others are written

    def emit_shared(batches):
        done: set = set()  # a task's own: rows that repeat as a whole give their spans once
        for batch in common.small_batches(batches):
            ids, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, place, one, two in found_spans(batch, done):
                let = in_table(table.value, one)
                columns = one[let], two[let], ids[row[let]], hs[row[let]], place[let].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_one", "_two", "_id", "_h", "_place"])

    path = shared_path(spark, "spans")
    texts.mapInArrow(emit_shared, "_one long, _two long, _id long, _h long, _place int").write.parquet(path)
    spans = spark.read.parquet(path)
    shared = spans.groupBy("_one", "_two").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi")).where("_lo < _hi").drop("_hi")
    # a set: copies of a row in several tasks give the same marks
    marks = (spans.join(shared, ["_one", "_two"]).groupBy("_id", "_h").agg(F.collect_set(F.struct("_place", "_lo")).alias("_marks"))
             .select(F.col("_id").alias("_mid"), F.col("_h").alias("_mh"), "_marks"))
    held = docs.join(marks, (docs["_id"] == marks["_mid"]) & (docs["_h"] == marks["_mh"]), "left")
    out = (f"`{id_col}` long, n_sentences long, n_shared long, n_removed long, n_removed_words long, "
           "first_docs array<long>, kept binary")

    def rebuild(batch: pa.RecordBatch):
        ids, texts, marks_col = batch.column(0).to_pylist(), common.byte_values(batch.column(1)), batch.column(2)
        sizes = pc.fill_null(pc.list_value_length(marks_col), 0).to_numpy()
        flat, ends = marks_col.flatten(), np.cumsum(sizes)
        places, los = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        row = 0
        for part in textnum.slices(texts):
            w = textnum.words_of(texts[part], textnum.SPACES)
            for j, d in enumerate(ids[part]):
                mine = slice(ends[row] - sizes[row], ends[row])
                row += 1
                yield (None if d == NULL_ID else d, *strip(w, j, d, texts[part][j], places[mine], los[mine], min_sentences, min_words))

    result = common.row_map(held.select("_id", "_text", "_marks"), rebuild, out, size=lambda r: 64 + len(r[6]))
    return result.withColumn("kept", F.decode("kept", "utf-8"))


def strip(w: textnum.Words, j: int, doc: int, text: bytes, places: np.ndarray, los: np.ndarray, min_sentences: int, min_words: int):
    """Remove from text ``j`` the sentences of non-first repeated spans; ``los`` are the first holders of the spans at ``places``."""
    a, b = int(w.first[j]), int(w.first[j + 1])
    cut, first, stop, keys = spans_of(w, a, b, min_sentences, min_words)
    m, n = len(cut) - 1, len(first)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    new = np.ones(n, dtype=bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
    if not len(places) and new.all():
        return m, 0, 0, 0, [], text
    kind = np.empty(n, dtype=np.int64)  # equal spans have one number
    kind[order] = np.cumsum(new) - 1
    holder = np.full(n, doc)
    known = np.zeros(n, dtype=bool)
    holder[kind[places]], known[kind[places]] = los, True
    shared, elsewhere = known[kind], holder[kind] < doc
    gone = elsewhere | (order[new][kind] != np.arange(n))  # a span of an earlier document, or not the first of its kind here

    def covered(chosen: np.ndarray) -> np.ndarray:
        step = np.bincount(first[chosen], minlength=m + 1) - np.bincount(stop[chosen], minlength=m + 1)
        return np.cumsum(step)[:m] > 0

    is_shared, is_gone = covered(shared), covered(gone)
    if not is_gone.any():
        return m, int(is_shared.sum()), 0, 0, [], text
    at = int(w.at[j])
    bounds = [0, *(w.starts[a + cut[1:m]] - at).tolist(), len(text)]
    kept = b"".join(text[bounds[i]:bounds[i + 1]] for i in range(m) if not is_gone[i])
    holders = np.unique(holder[kind[elsewhere]])
    return (m, int(is_shared.sum()), int(is_gone.sum()), int(np.diff(cut)[is_gone].sum()),
            holders[holders != NULL_ID].tolist(), kept)
