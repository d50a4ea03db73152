"""Line deduplication: drop lines that many documents share, all but the last holder's.

1. Every text is exploded into the keys of its lines: white space stripped at both ends,
   A-Z lower-cased, keys under ``min_chars`` code points left out, hashed to 128 bits.
   The key table holds hashes only and is checkpointed, so both uses read it from the
   shared folder.
2. Distinct (key, document) pairs, then a count and the largest document per key: two
   aggregations, both combined before their shuffle, so a line that a third of all
   documents hold is one row per task.
3. Keys over the threshold go back to the documents that hold them, one array of hashes
   per text, and each text is reassembled by position in one pass.

Rows are known by document id and text hash, so repeated or null ids never pull the
lines of different texts into one group; an id counts once per key however many rows it
has (null is an id that sorts below all others).  Null and empty texts are one empty line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import common

BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key, None if the key is too short."""
    key = line.strip(BLANK)
    if len(key) < min_chars:
        return None
    key = key.lower()  # bytes: A-Z only
    if len(key) < 4 * min_chars and not key.isascii() and len(key.decode()) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
                min_docs: int = 3, carry: Sequence[str] = ()) -> DataFrame:
    """``(id_col, *carry, n_lines, n_dropped, kept)`` of every row.

    A line whose key is found in at least ``min_docs`` documents stays only in the largest
    document id that holds it; ``kept`` is the other lines joined by a line feed.
    """
    clash = {"n_lines", "n_dropped", "kept"} & set(carry)
    if clash:
        raise ValueError(f"carried columns clash with output columns: {sorted(clash)}")
    docs = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
                     *[F.col(c) for c in carry])
    docs = docs.withColumn("_h", F.xxhash64("_text"))
    id_type = docs.schema["_id"].dataType.simpleString()

    def keys_of(batch: pa.RecordBatch):
        for d, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.byte_values(batch.column(2))):
            found = {line_key(x, min_chars) for x in text.split(b"\n")}
            found.discard(None)
            for k in found:
                yield k, d, h

    keys = cut_lineage(common.row_map(docs.select("_id", "_h", "_text"), keys_of,
                                      f"_key binary, _id {id_type}, _h long", size=lambda r: 48))
    shared = (keys.select("_key", "_id").distinct().groupBy("_key")
              .agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_last")).where(F.col("_n") >= min_docs)
              .select("_key", "_last"))
    drops = (keys.join(shared, "_key").where(~F.col("_id").eqNullSafe(F.col("_last")))
             .groupBy("_id", "_h").agg(F.collect_set("_key").alias("_drop")))
    drops = drops.select(F.col("_id").alias("_did"), F.col("_h").alias("_dh"), "_drop")
    marked = docs.join(drops, docs["_id"].eqNullSafe(drops["_did"]) & (docs["_h"] == drops["_dh"]), "left")
    marked = marked.select(F.col("_id").alias(id_col), *carry, F.col("_text"), F.col("_drop"))
    kept_fields = marked.drop("_text", "_drop").schema
    out_schema = kept_fields.add("n_lines", "long").add("n_dropped", "long").add("kept", "string")
    target = common.arrow_schema(out_schema)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            n, gone, kept = [], [], []
            drop_col = batch.column(batch.num_columns - 1)
            texts = common.byte_values(batch.column(batch.num_columns - 2))
            for k, text in enumerate(texts):
                lines = text.split(b"\n")
                n.append(len(lines))
                if not drop_col[k].is_valid:
                    gone.append(0)
                    kept.append(text)
                    continue
                drop = set(drop_col[k].as_py())
                rest = [x for x in lines if line_key(x, min_chars) not in drop]
                gone.append(len(lines) - len(rest))
                kept.append(b"\n".join(rest))
            cols = [c.cast(f.type) for c, f in zip(batch.columns[:-2], target)]
            new = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                   pa.array(kept, pa.binary()).cast(target.field("kept").type)]
            yield pa.RecordBatch.from_arrays(cols + new, schema=target)

    return marked.mapInArrow(rebuild, out_schema)
