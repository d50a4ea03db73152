"""Corpus pipeline: documents in, token ids of the clean ones out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and
read again as the next stage's ``docs``.  All but the last return the columns they were given, in their order,
whatever their names; texts change in the line stage, and ``n_chars`` with them.

1. quality classifier: rows whose perplexity is over their language's threshold go;
2. line dedup: repeated lines go, documents stay;
3. n-gram Jaccard join (words of five, 0.8): one document of each group stays, the one with the smallest id (of
   rows that share it, the smallest text hash); documents without words stay;
4. benchmark decontamination: contaminated documents go;
5. BPE encoding and decoding: ids and decoded text of every document that is left, as digests.

Rows that repeat as a whole are one document of their group in stage 3.  Rows with a null id are documents like
any other; in a group they stay only if no row has an id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchrank.llm import bpe, common, decontam, kn_quality, line_dedup, ngram_join
from searchrank.llm.queries import vocabulary
from searchrank.session import ensure_checkpoint_dir, shared_path

NGRAM, PERCENT = 5, 80  # near duplicates: five words a shingle, similarity 0.8
ORACLE_SQL = None       # trained thresholds and token ids have no SQL form


def packed(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, row)``: all columns in one struct, so that no name can clash."""
    return docs.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def keyed(docs: DataFrame, hash_col) -> DataFrame:
    """Adds the row key (is the id null, id or 0, text hash)."""
    return (docs.withColumn("_null", F.col("doc_id").isNull()).withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(0)))
            .withColumn("_h", hash_col))


KEY = ["_null", "_id", "_h"]


def text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    verdict = kn_quality.classify(docs, common.read_table(spark, sf_dir, "labels"))
    good = keyed(verdict.where("kept"), F.col("_h")).select(*KEY)
    return keyed(packed(docs), text_hash()).join(good, KEY, "left_semi").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    out = line_dedup.dedup_lines(packed(docs), carry=("row",))
    same = F.col("n_dropped") == 0
    changed = {"text": F.when(same, F.col("row.text")).otherwise(F.col("kept")),
               "n_chars": F.when(same, F.col("row.n_chars")).otherwise(F.length("kept"))} if "n_chars" in docs.columns else {
               "text": F.when(same, F.col("row.text")).otherwise(F.col("kept"))}
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    groups = ngram_join.jaccard_components(docs, n=NGRAM, percent=PERCENT, with_hash=True)
    rows = keyed(groups, F.col("text_hash"))
    first = rows.where(F.col("group_id").isNotNull()).groupBy("group_id").agg(F.min(F.struct(*KEY)).alias("k")).select("k.*")
    alone = rows.where(F.col("group_id").isNull()).select(*KEY).distinct()
    stay = first.withColumn("_one", F.lit(True)).unionByName(alone.withColumn("_one", F.lit(False)))
    held = keyed(packed(docs), text_hash()).join(stay, KEY)  # texts are shuffled once
    # of a group's row repeated as a whole one stays; rows without words all stay
    held = held.withColumn("_copy", F.when(F.col("_one"), F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id()))
    return held.dropDuplicates([*KEY, "_copy"]).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    out = decontam.decontaminate(packed(docs), common.read_table(spark, sf_dir, "benchmark"), carry=("row",))
    return out.where(~((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))).select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(docs, vocabulary())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result goes through Parquet in the shared folder."""
    ensure_checkpoint_dir(spark)
    docs = common.read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = shared_path(spark, f"pipeline-{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
