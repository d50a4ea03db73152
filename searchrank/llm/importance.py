"""Quality rules: hashed n-gram log-likelihood ratio of trusted target against raw corpus.

A text's n-grams are its words, its pairs of neighbouring words and its runs of four bytes.  Each kind is
hashed into ``BUCKETS`` buckets.  Two multinomials over the buckets of each kind are counted:

* raw: every row of the corpus;
* target: the trusted rows (all but a tenth, by hash of their id, that is held out).

A text's score is the sum over kinds of the mean log ratio of its n-grams, so it is normalised by
length.  Counts are added per task, then summed by bucket; the two tables have a fixed
size (``BUCKETS`` entries a kind) and are broadcast.  The threshold is a low quantile of the held-out trusted
rows' scores less a margin, an exact order statistic; it is applied to every row, with no sampling.  Log ratios are
fixed-point integers, so sums do not depend on their order: the same text always gives the same score and verdict.

Base rules come first: a text with fewer than ``min_words`` words, or more than half of whose words stand in
a run of three words found twice or more in it, fails whatever its score.

Defined results: null and empty texts have no words and fail; without held-out rows the
threshold is minus infinity; rows with repeated or null ids are judged by their own text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.selection import nearest_quantiles
from ..session import cut_lineage
from . import common, textnum
from .trusted import held_out, trusted_ids, with_fit

BUCKETS = 1 << 18
KINDS = 3
FIXED = 1 << 20  # steps of a log ratio
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = np.ones(256, dtype=bool)
_LEAD[0x80:0xC0] = False  # UTF-8 continuation bytes start no code point


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64)


def features(w: textnum.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per kind: bucket of every n-gram of the slice, and each text's first n-gram (plus the end)."""
    one = bucket(w.hashes)
    two = bucket(textnum.run_hashes(w.hashes, 2))
    # pairs that run over the end of a text belong to none
    inside = np.ones(len(two), dtype=bool)
    over = w.first[1:-1] - 1
    inside[over[(over >= 0) & (over < len(two))]] = False
    first_two = np.searchsorted(np.flatnonzero(inside), w.first)
    data = w.data.astype(np.uint64)
    n = max(len(data) - 3, 0)
    run = data[:n] | data[1:n + 1] << np.uint64(8) | data[2:n + 2] << np.uint64(16) | data[3:n + 3] << np.uint64(24)
    within = np.ones(n, dtype=bool)  # likewise runs of bytes
    over = (w.at[1:, None] - 1 - np.arange(4)).ravel()
    within[over[(over >= 0) & (over < n)]] = False
    first_run = np.searchsorted(np.flatnonzero(within), w.at)
    return [(one, w.first), (two[inside], first_two), (bucket(textnum.mix(run[within] + np.uint64(77))), first_run)]


def counts(rows: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(k, raw, target)``: n-grams per bucket (kind * BUCKETS + bucket) over all rows, and over the
    trusted ones to fit on, in one pass."""
    def run(batches):
        seen = np.zeros((2, KINDS * BUCKETS), dtype=np.int64)
        for batch in common.small_batches(batches):
            trusted = batch.column(0).to_pylist()
            texts = [t or b"" for t in common.byte_values(batch.column(1))]
            for which, chosen in enumerate(([t for t, x in zip(texts, trusted) if not x], [t for t, x in zip(texts, trusted) if x])):
                for part in textnum.slices(chosen):
                    for kind, (b, _) in enumerate(features(textnum.words_of(chosen[part], textnum.SPACES, lower=False))):
                        seen[which, kind * BUCKETS:(kind + 1) * BUCKETS] += np.bincount(b, minlength=BUCKETS)
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[0, at] + seen[1, at]), pa.array(seen[1, at])],
                                         names=["k", "raw", "target"])

    common.ship(rows.sparkSession)
    flagged = with_fit(rows.select(id_col, text_col), labels, id_col)
    return (flagged.select("_fit", F.col(text_col).cast("string")).mapInArrow(run, "k int, raw long, target long")
            .groupBy("k").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))


def log_ratios(counted: DataFrame) -> np.ndarray:
    """Log of target over raw probability per bucket, in steps of 1 / FIXED; the target is smoothed towards raw."""
    out = np.zeros((KINDS, BUCKETS), dtype=np.int32)
    got = common.columns_of(counted)  # at most KINDS * BUCKETS rows
    tables = []
    for name in ("raw", "target"):
        t = np.zeros(KINDS * BUCKETS)
        t[got["k"].astype(np.int64)] = got[name]
        tables.append(t.reshape(KINDS, BUCKETS))
    for kind in range(KINDS):
        r, t = tables[0][kind], tables[1][kind]
        p_raw = (r + 1) / (r.sum() + BUCKETS)
        p_target = (t + p_raw * BUCKETS / 2) / (t.sum() + BUCKETS / 2)
        out[kind] = np.rint(np.log(p_target / p_raw) * FIXED)
    return out


def base_figures(w: textnum.Words, j: int, text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of text ``j`` of a slice."""
    a, b = int(w.first[j]), int(w.first[j + 1])
    n = b - a
    if n == 0:
        return 0, 0, int(_SYMBOL[np.frombuffer(text, np.uint8)].sum()), 0, 0
    data = w.data[int(w.at[j]):int(w.at[j]) + len(text)]
    blank = textnum.SPACES[data]
    chars = int((_LEAD[data] & ~blank).sum())
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    repeat = 0
    if n >= 3:
        runs = textnum.run_hashes(w.hashes[a:b], 3)
        _, back, times = np.unique(runs, return_inverse=True, return_counts=True)
        twice = (times[back] >= 2).astype(np.int8)
        edge = np.zeros(n + 1, dtype=np.int64)
        edge[:n - 2] += twice
        edge[3:n + 1] -= twice
        repeat = int((np.cumsum(edge)[:n] > 0).sum())
    return n, chars, int(_SYMBOL[data].sum()), len(lines) - len(set(lines)), repeat


def judge(docs: DataFrame, labels: DataFrame, quantile: float = 0.002, margin: float = 0.05, min_words: int = 50,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, threshold, base_failed, kept)``."""
    spark = docs.sparkSession
    table = log_ratios(counts(docs, labels, id_col, text_col))
    table = spark.sparkContext.broadcast(table)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        ids, texts = batch.column(0).to_pylist(), common.byte_values(batch.column(1))
        for part in textnum.slices(texts):
            w = textnum.words_of(texts[part], textnum.SPACES, lower=False)
            score = np.zeros(len(w.first) - 1)
            for kind, (b, first) in enumerate(features(w)):
                total = np.concatenate([[0], np.cumsum(table.value[kind][b], dtype=np.int64)])
                score += (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1) / FIXED
            for j, d in enumerate(ids[part]):
                yield d, *base_figures(w, j, texts[part][j]), float(round(score[j], 6))

    scored = cut_lineage(common.row_map(
        rows, run, f"_id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"))
    known = scored.join(trusted_ids(labels), F.col("_id") == F.col("_tid"), "left_semi")
    known = known.where((F.col("n_words") >= min_words) & held_out("_id"))
    limit = nearest_quantiles(known, "score", [quantile])[quantile]
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = scored.withColumn("threshold", F.lit(float("-inf") if limit is None else limit - margin)).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.col("threshold"))).withColumnRenamed("_id", id_col)
