"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model is over characters (order ``ORDER``): white space is one symbol, digits are one, letters
keep their case, code points above 2047 share 1024 symbols.  An n-gram is one 64-bit integer of
12-bit symbols, so contexts and suffixes are shifts and masks.

1. *Counts.*  One pass gathers the distinct n-grams of the whole corpus, with their counts in the trusted rows (all
   but a tenth, by hash of the id, that is held out for the thresholds).  Each task merges its
   own, one aggregation the tasks.  Lower orders are continuation counts: aggregations of the
   distinct n-grams of the order above.
2. *Probabilities by count joins.*  Discounts come from each order's counts of counts.  Every
   order's counts and context weights are joined to the corpus's n-grams: a table with the log probability of
   every n-gram that any document holds, which grows with the corpus.
3. *Perplexity.*  The ``SHARD`` most frequent n-grams of the table are broadcast (12 bytes each), and a pass over the documents
   adds up their share of each text.  Other n-grams leave the tasks as (text, n-gram, count) rows and are joined to the rest
   of the table on Spark; their shares are summed per text.  Texts are never shuffled.  Log probabilities are
   fixed-point integers, so sums do not depend on the order: equal texts have equal perplexity.
4. *Thresholds.*  Per language, a high quantile of the held-out trusted rows' perplexity, drawn towards that of all
   languages as if ``SHRINK`` rows of the pool were among them.  Quantiles are exact.  Every row is judged.

Defined results: a null or empty text has no perplexity and is rejected, as is a text without
any word; without held-out rows (no labels) everything with a word is kept; rows that share an id
are judged by their own text; rows equal in id, text and language are one row; a null language is a language of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import common, textnum
from .trusted import held_out, trusted_ids, with_fit

ORDER = 5
BITS = 12
SHARD = 4_000_000
SHRINK = 30
FIXED = 1 << 20  # steps of a log2 probability
MAX_LANGS = 100_000  # thresholds of so many languages are broadcast
STEADY = 32  # symbols at the language's median that every text is given besides its own


def symbols(text: bytes) -> np.ndarray:
    """Folded symbols of a text."""
    cp = np.frombuffer(text.decode().encode("utf-32-le"), dtype="<u4").astype(np.int64)
    out = np.where(cp < 2048, cp, 2048 + cp % 1024)
    out[(cp >= 48) & (cp <= 57)] = 48
    out[((cp >= 9) & (cp <= 13)) | (cp == 0xA0)] = 32
    return out


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes of all positions of all texts, and each text's first position (plus the end).

    Every text is preceded by ``ORDER - 1`` spaces.
    """
    pad = np.full(ORDER - 1, 32, dtype=np.int64)
    parts, lens = [], []
    for t in texts:
        s = symbols(t)
        parts += [pad, s]
        lens.append(len(s))
    first = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    if not parts:
        return np.zeros(0, dtype=np.int64), first
    flat = np.concatenate(parts)
    n = len(flat) - ORDER + 1
    code = np.zeros(max(n, 0), dtype=np.int64)
    for i in range(ORDER):
        code = (code << BITS) | flat[i:i + n]
    # positions whose window ends inside the pad belong to no text
    keep = np.ones(n, dtype=bool)
    for k in range(1, len(texts)):
        at = first[k] + k * (ORDER - 1)
        keep[at - (ORDER - 1):at] = False
    return code[keep], first


def gram_counts(rows: DataFrame, labels: DataFrame | None, id_col: str, text_col: str) -> DataFrame:
    """``(g, c, m)``: every n-gram of all rows with its count in the trusted rows to fit on and in all.

    Without ``labels`` all rows are.  A task's n-grams are merged before they leave it.
    """
    flagged = rows.withColumn("_fit", F.lit(True)) if labels is None else with_fit(rows.select(id_col, text_col), labels, id_col)

    def run(batches):
        keys, sums = np.zeros(0, dtype=np.int64), np.zeros((2, 0), dtype=np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums[0]), pa.array(sums[1])], names=["g", "c", "m"])
        for batch in common.small_batches(batches):
            trusted = batch.column(0).to_pylist()
            texts = [t or b"" for t in common.byte_values(batch.column(1))]
            groups = [(1, [t for t, x in zip(texts, trusted) if x]), (0, [t for t, x in zip(texts, trusted) if not x])]
            for weight, part in [(w, group[s]) for w, group in groups for s in textnum.slices(group)]:
                k, m = np.unique(ngrams(part)[0], return_counts=True)
                keys, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
                new = np.concatenate([sums, [m * weight, m]], axis=1)
                sums = np.stack([np.bincount(at, weights=x, minlength=len(keys)) for x in new]).astype(np.int64)
                if len(keys) > SHARD:
                    yield out()
                    keys, sums = keys[:0], sums[:, :0]
        yield out()

    common.ship(rows.sparkSession)
    return (flagged.select("_fit", F.col(text_col).cast("string")).mapInArrow(run, "g long, c long, m long")
            .groupBy("g").agg(F.sum("c").alias("c"), F.sum("m").alias("m")))


def discounts(counts_of_counts: dict[int, int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more."""
    n = [counts_of_counts.get(k, 0) for k in (1, 2, 3, 4)]
    if not n[0] or not n[1]:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else k + 1 - 0.5 for k in range(3)]
    return [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]


class KneserNey:
    """Count and context tables of every order, made from the highest order's counts."""

    def __init__(self, top: DataFrame):
        self.tables: list[tuple[DataFrame, DataFrame, list[float]]] = []
        counts = cut_lineage(top)
        for order in range(ORDER, 0, -1):
            seen = {r["c"]: r["n"] for r in counts.where("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
            d = discounts(seen)
            off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
            contexts = counts.groupBy(F.shiftright("g", BITS).alias("ctx")).agg(
                F.sum("c").alias("total"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"),
                F.count_if(F.col("c") > 2).alias("n3"))
            contexts = contexts.withColumn("left", F.col("n1") * d[0] + F.col("n2") * d[1] + F.col("n3") * d[2])
            self.tables.append((counts.select("g", F.greatest(F.col("c") - off, F.lit(0.0)).alias("num")),
                                contexts.select("ctx", "total", (F.col("left") / F.col("total")).alias("weight")), d))
            suffix = F.col("g").bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1))
            counts = cut_lineage(counts.groupBy(suffix.alias("g")).agg(F.count(F.lit(1)).alias("c")))

    def log_probability(self, grams: DataFrame) -> DataFrame:
        """``(g, lp)``: log2 probability of the last symbol of each n-gram in ``grams(g)``.

        Lower orders first: each order's n-grams are the distinct suffixes of the one above.
        """
        orders = [grams.select("g").distinct()]
        for k in range(ORDER - 1, 0, -1):
            orders.append(orders[-1].select(F.col("g").bitwiseAND(F.lit((1 << (BITS * k)) - 1)).alias("g")).distinct())
        lower = None
        for k, want in zip(range(1, ORDER + 1), reversed(orders)):
            num, ctx, _ = self.tables[ORDER - k]
            x = want.join(num, "g", "left").withColumn("ctx", F.shiftright("g", BITS)).join(ctx, "ctx", "left")
            if lower is None:
                x = x.withColumn("low", F.lit(1.0 / (1 << BITS)))
            else:
                x = x.withColumn("sub", F.col("g").bitwiseAND(F.lit((1 << (BITS * (k - 1))) - 1))).join(
                    lower.select(F.col("g").alias("sub"), F.col("p").alias("low")), "sub")
            p = F.coalesce("num", F.lit(0.0)) / F.coalesce("total", F.lit(1)) + F.coalesce("weight", F.lit(1.0)) * F.col("low")
            lower = x.select("g", p.alias("p"))
        return lower.select("g", F.log2("p").cast("float").alias("lp"))


def frequent(table: DataFrame) -> DataFrame:
    """The most frequent rows of ``table(g, lp, m)``, at most ``SHARD`` of them, whole counts at a time."""
    by_count = table.groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.orderBy(F.col("m").desc()))  # one row per count
    least = by_count.withColumn("so_far", so_far).where(F.col("so_far") <= SHARD).agg(F.min("m")).first()[0]
    return table.where(F.col("m") >= least) if least is not None else table.where(F.lit(False))


def log_probabilities(docs: DataFrame, table: DataFrame) -> DataFrame:
    """``docs(_id, _h, lang, worded, _text)`` with ``(lp, n)`` instead of the text, each distinct row once.

    ``lp`` is the sum of the n-grams' fixed-point log2 probabilities, ``n`` the symbol count.
    """
    spark = docs.sparkSession
    n_grams = table.count()
    hot = table if n_grams <= SHARD else frequent(table)
    got = common.columns_of(hot.select("g", "lp"))  # at most SHARD rows
    order = np.argsort(got["g"])
    shard = spark.sparkContext.broadcast((got["g"][order].astype(np.int64), got["lp"][order].astype(np.int32)))
    del got, order

    def looked_up(texts: list[bytes]):
        """(distinct n-grams, place of each position's, probability or 0, whether known, first position per text)."""
        keys, lp = shard.value
        code, first = ngrams(texts)
        uniq, back = np.unique(code, return_inverse=True)
        if not len(keys):
            return uniq, back, np.zeros(len(uniq), dtype=np.int64), np.zeros(len(uniq), dtype=bool), first
        at = np.minimum(np.searchsorted(keys, uniq), len(keys) - 1)
        known = keys[at] == uniq
        return uniq, back, np.where(known, lp[at], 0).astype(np.int64), known, first

    def run(batch: pa.RecordBatch):
        held, texts = [batch.column(i).to_pylist() for i in range(4)], common.byte_values(batch.column(4))
        for part in textnum.slices(texts):
            _, back, value, _, first = looked_up(texts[part])
            total = np.concatenate([[0], np.cumsum(value[back])])
            yield from zip(*(x[part] for x in held), (total[first[1:]] - total[first[:-1]]).tolist(), np.diff(first).tolist())

    id_type = docs.schema["_id"].dataType.simpleString()
    out = common.row_map(docs, run, f"_id {id_type}, _h long, lang string, worded boolean, lp long, n long").distinct()
    if n_grams <= SHARD:
        return out

    def rest(batch: pa.RecordBatch):
        ids, hs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.byte_values(batch.column(2))
        for part in textnum.slices(texts):
            uniq, back, _, known, first = looked_up(texts[part])
            at = np.flatnonzero(~known[back])
            text = np.searchsorted(first, at, "right") - 1
            pairs, times = np.unique(np.stack([text, back[at]]), axis=1, return_counts=True)
            for j, g, k in zip(pairs[0].tolist(), uniq[pairs[1]].tolist(), times.tolist()):
                yield ids[part][j], hs[part][j], g, k

    # rows equal in id and text give theirs once
    cold = common.row_map(docs.select("_id", "_h", "_text"), rest, f"_id {id_type}, _h long, g long, k long").distinct()
    cold = cold.join(table.select("g", "lp"), "g").groupBy(F.col("_id").alias("_cid"), F.col("_h").alias("_ch")).agg(F.sum(F.col("lp") * F.col("k")).alias("more"))
    out = out.join(cold, F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_h") == F.col("_ch")), "left")
    return out.withColumn("lp", F.col("lp") + F.coalesce("more", F.lit(0))).drop("_cid", "_ch", "more")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, slack: float = 1.02, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(id_col, _h, lang, perplexity, steady, threshold, kept)`` of every distinct (id, text, language).

    ``steady`` is the perplexity with ``STEADY`` symbols at the language's median added, which
    keeps a few rare letters from condemning a short text.  A row is kept if ``steady`` is at most
    ``threshold``: the quantile of the language's held-out rows (see above) times ``slack``.
    """
    grams = cut_lineage(gram_counts(docs, labels, id_col, text_col))
    model = KneserNey(grams.where("c > 0").select("g", "c"))
    table = model.log_probability(grams).select("g", F.round(F.col("lp") * FIXED).cast("int").alias("lp"))
    table = cut_lineage(table.join(grams.select("g", "m"), "g"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                       text.rlike(r"[\p{L}\p{N}]").alias("worded"), text.alias("_text"))
    scores = log_probabilities(rows, table)
    per_symbol = -F.col("lp") / F.lit(FIXED) / F.col("n")
    scores = cut_lineage(scores.withColumn("perplexity", F.when(F.col("n") > 0, F.pow(F.lit(2.0), per_symbol))).drop("lp"))
    known = scores.join(trusted_ids(labels), F.col("_id") == F.col("_tid"), "left_semi")
    known = cut_lineage(known.where(F.col("perplexity").isNotNull() & held_out("_id")))

    def quantiles(source: DataFrame, value: str, q: float, name: str) -> tuple[DataFrame, float | None]:
        """(per language, of all): exact over values of four decimals, so a task holds few distinct ones."""
        at = F.percentile(F.round(value, 4), F.lit(q))
        pool = source.agg(at).first()[0]
        own = source.groupBy("lang").agg(at.alias("own"), F.count(F.lit(1)).alias("m"))
        return cut_lineage(own.select("lang", ((F.col("own") * F.col("m") + F.lit(pool) * SHRINK) / (F.col("m") + SHRINK)).alias(name))), pool

    def with_quantile(rows: DataFrame, found: tuple[DataFrame, float | None], name: str) -> DataFrame:
        own, pool = found
        if own.count() <= MAX_LANGS:
            own = F.broadcast(own)
        return rows.join(own, "lang", "left").withColumn(name, F.coalesce(name, F.lit(pool).cast("double")))

    def steadied(rows: DataFrame) -> DataFrame:
        usual = F.log2(F.coalesce("middle", "perplexity"))
        bits = (F.log2("perplexity") * F.col("n") + usual * STEADY) / (F.col("n") + STEADY)
        return rows.withColumn("steady", F.pow(F.lit(2.0), bits))

    middle = quantiles(known, "perplexity", 0.5, "middle")
    judged = steadied(with_quantile(scores, middle, "middle"))
    limit = quantiles(steadied(with_quantile(known, middle, "middle")), "steady", quantile, "limit")
    judged = with_quantile(judged, limit, "limit").withColumn("threshold", F.col("limit") * slack)
    kept = F.coalesce(F.col("worded") & (F.col("steady") <= F.coalesce("threshold", F.lit(math.inf))), F.lit(False))
    return judged.select(F.col("_id").alias(id_col), "_h", "lang", "perplexity", "steady", "threshold", kept.alias("kept"))
