"""Token-ID files: fixed-width bit packing with block offsets.

Each id takes the minimum number of bits its vocabulary needs.  A shard file is

    magic | packed blocks ... | block offsets | document ids, document starts | footer

* a block holds ``BLOCK`` ids, packed most significant bit first; the last block may be
  shorter and is padded with zero bits to a whole byte;
* block offsets are unsigned 64-bit byte positions, one more than there are blocks, so
  any range of ids is read from the bytes of its blocks alone and unpacked with numpy;
* the footer has the width, counts and section positions as 64-bit integers.

Shards are range partitions of the document id: shard order, and order inside a shard,
is ascending document id (null first; rows with the same id by the hash of their text, and
rows that repeat as a whole by their place, which also splits an id that holds many rows over shards).  Ids are
64-bit integers; others are cast, and what cannot be cast is a null id or an error, as the session's settings have it.  A task writes its file under
a name of its own attempt and reports it; the manifest, a Parquet table with one row per
shard, names the files of successful tasks only, so a retried task or a lost executor
leaves at most an unused file.  Folders are opened with ``pyarrow.fs`` (local or shared
mounts, HDFS, object stores).

Defined results: a null or empty text holds only the end id; an empty table gives an
empty manifest.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"TOKBITS1"
FOOTER = struct.Struct("<7q8s")  # bits, block, ids, docs, offsets at, doc ids at, doc starts at, magic
BLOCK = 8192
CACHE_BYTES = 64_000_000  # of a worker's known pieces and their ids
SLICE_BYTES = 8_000_000   # text encoded at a time


# ---------------------------------------------------------------------- packing
def width_of(vocab_size: int) -> int:
    """Bits that every id of a vocabulary fits in."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive ``bits``-wide big-endian fields."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError("an id needs more bits than the vocabulary's width")
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    fields = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits:]
    return np.packbits(fields).tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes, as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f">u{bits // 8}", count=n).astype("<u4")
    fields = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits).reshape(n, bits)
    whole = np.zeros((n, 32), dtype=np.uint8)
    whole[:, 32 - bits:] = fields
    return np.packbits(whole, axis=1).view(">u4").reshape(n).astype("<u4")


class ShardWriter:
    """Streams ids of documents into one shard; holds at most a block of ids and the index."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits, self.at = sink, bits, 0
        self.offsets: list[int] = []
        self.doc_ids: list[int] = []
        self.starts: list[int] = [0]
        self.rest: list[np.ndarray] = []
        self.held = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.add_many(np.array([NULL_ID if doc_id is None else doc_id]), np.array([len(ids)]), ids)

    def add_many(self, doc_ids: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> None:
        """Consecutive documents of ``lens`` ids each."""
        self.doc_ids += doc_ids.tolist()
        self.starts += (self.starts[-1] + np.cumsum(lens)).tolist()
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= 16 * BLOCK:
            self._blocks(self.held // BLOCK * BLOCK)

    def _blocks(self, n: int) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, dtype=np.uint32)
        for k in range(0, n, BLOCK):
            self.offsets.append(self.at)
            self._put(pack(ids[k:min(k + BLOCK, n)], self.bits))
        self.rest, self.held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._blocks(self.held)
        self.offsets.append(self.at)
        places = []
        for section in (np.array(self.offsets, "<u8"), np.array(self.doc_ids, "<i8"), np.array(self.starts, "<i8")):
            places.append(self.at)
            self._put(section.tobytes())
        self._put(FOOTER.pack(self.bits, BLOCK, self.starts[-1], len(self.doc_ids), *places, MAGIC))


NULL_ID = -2**63  # stands for a null document id in the index


class ShardReader:
    """Random access to a shard by id position or document."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        self.bits, self.block, self.n_ids, self.n_docs, at_off, at_ids, at_starts, magic = FOOTER.unpack(
            self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.offsets = np.frombuffer(self._read(at_off, at_ids - at_off), "<u8")
        self.doc_ids = np.frombuffer(self._read(at_ids, at_starts - at_ids), "<i8")
        self.starts = np.frombuffer(self._read(at_starts, (self.n_docs + 1) * 8), "<i8")

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids at positions ``start`` to ``stop`` (exclusive), reading only their blocks."""
        if stop <= start:
            return np.zeros(0, dtype="<u4")
        first, last = start // self.block, (stop - 1) // self.block
        data = self._read(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        base = first * self.block
        n = min((last + 1) * self.block, self.n_ids) - base
        return unpack(data, self.bits, n)[start - base:stop - base]

    def documents(self, ids_at_once: int = 1 << 19) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, start, ids) in order, a bounded run of ids in memory at a time."""
        k = 0
        while k < self.n_docs:
            end = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + ids_at_once, "right")) - 1)
            end = min(end, self.n_docs)
            base = int(self.starts[k])
            run = self.ids(base, int(self.starts[end]))
            for i in range(k, end):
                a, b, d = int(self.starts[i]), int(self.starts[i + 1]), int(self.doc_ids[i])
                yield (None if d == NULL_ID else d), a, run[a - base:b - base]
            k = end


# --------------------------------------------------------------------- encoding
class LibraryEncoder:
    """Ids from the ``tokenizers`` library, remembered per white-space piece.

    White space is never part of a token and neither normaliser nor pre-tokeniser joins
    over it, so a text's ids are those of its pieces in order.  Arrow splits a slice of texts, numbers its distinct
    pieces and looks them up among the known ones; new ones go to the library in joined batches, and ids are
    attributed to pieces by the offsets it returns.  All ids of the slice are then gathered at once.  Known pieces are an Arrow
    column, their ids one array; beyond ``CACHE_BYTES`` the less used half goes.
    """

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.vocab_size = self.tok.get_vocab_size(with_added_tokens=True)
        self.known = pa.array([], type=pa.large_string())
        self.flat, self.lens, self.used = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per piece) of pieces without white space."""
        ids, lens = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        for k in range(0, len(pieces), 20_000):
            part = pieces[k:k + 20_000]
            groups = [part[j:j + 250] for j in range(0, len(part), 250)]
            for group, got in zip(groups, self.tok.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
                ends = np.cumsum(np.fromiter(map(len, group), dtype=np.int64, count=len(group)) + 1)
                starts = np.fromiter((a for a, _ in got.offsets), dtype=np.int64, count=len(got.ids))
                ids.append(np.array(got.ids, dtype="<u4"))
                lens.append(np.diff(np.searchsorted(starts, ends, "left"), prepend=0))
        return np.concatenate(ids), np.concatenate(lens)

    def _forget(self) -> None:
        keep = np.sort(np.argsort(self.used, kind="stable")[len(self.used) // 2:])
        self.flat = self.flat[gather(self.lens, keep)]
        self.known, self.lens, self.used = self.known.take(pa.array(keep)), self.lens[keep], self.used[keep] // 2

    def places_of(self, pieces: pa.Array) -> np.ndarray:
        """Places of distinct pieces among the known ones, new ones learnt first."""
        if self.known.nbytes + 4 * len(self.flat) + 16 * len(self.lens) > CACHE_BYTES:
            self._forget()
        at = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy().astype(np.int64)
        lost = np.flatnonzero(at < 0)
        if len(lost):
            new = pieces.take(pa.array(lost))
            ids, lens = self._learn(new.to_pylist())
            at[lost] = len(self.lens) + np.arange(len(lost))
            self.known = pa.concat_arrays([self.known, new])
            self.flat, self.lens = np.concatenate([self.flat, ids]), np.concatenate([self.lens, lens])
            self.used = np.concatenate([self.used, np.zeros(len(lost), dtype=np.int64)])
        self.used[at] += 1
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per text) of a string column without nulls."""
        cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        words = cut.flatten().dictionary_encode()
        place = self.places_of(words.dictionary)[words.indices.to_numpy()] if len(words) else np.zeros(0, dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(self.lens[place])])
        offsets = cut.offsets.to_numpy()
        return self.flat[gather(self.lens, place)], np.diff(ends[offsets - offsets[0]])


def gather(lens: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Indices of the chosen ones of consecutive runs of ``lens`` items, in the order chosen."""
    first, each = np.cumsum(lens) - lens, lens[chosen]
    ends = np.cumsum(each)
    return np.repeat(first[chosen] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder_of(spec: str) -> LibraryEncoder:
    """The worker's encoder of a tokenizer file; it stays between tasks."""
    key = hashlib.sha1(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = LibraryEncoder(spec)
    return _ENCODERS[key]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[slice]:
    """Consecutive slices of about ``limit`` bytes of text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield slice(at, stop)
        at = stop


# ----------------------------------------------------------------- Spark surface
def open_folder(uri: str):
    """(file system, path) of a folder URI."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_token_files(df: DataFrame, out_dir: str, tokenizer_path: str, end_id: int | None = None,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all rows, write the shard files under ``out_dir`` and return the manifest.

    The manifest ``(shard, path, n_docs, n_ids, first_id)`` has a row per shard, with
    ``first_id`` the number of ids in all shards before it; it is also kept as Parquet
    in ``out_dir/manifest``.
    """
    spark = df.sparkSession
    common.ship(spark)
    spec = spark.sparkContext.broadcast(common.read_text(tokenizer_path))
    rows = (df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
            .withColumn("h", F.xxhash64("text")).withColumn("k", F.monotonically_increasing_id()))  # k cuts rows that repeat as a whole
    rows = rows.repartitionByRange("id", "h", "k").sortWithinPartitions("id", "h").select("id", "text")
    schema = common.arrow_schema(spark.createDataFrame([], "shard int, path string, n_docs long, n_ids long").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder_of(spec.value)
        task = TaskContext.get()
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.bits"
        fs, folder = open_folder(out_dir)
        sink = writer = None
        for batch in batches:
            ids = pc.fill_null(batch.column(0), NULL_ID).to_numpy()
            texts = pc.fill_null(batch.column(1), "")
            for part in slices(texts):
                got, lens = coder.encode(texts.slice(part.start, part.stop - part.start))
                if end_id is not None:
                    got, lens = np.insert(got, np.cumsum(lens), np.uint32(end_id)), lens + 1
                if writer is None:
                    fs.create_dir(folder, recursive=True)
                    sink = fs.open_output_stream(f"{folder}/{name}")
                    writer = ShardWriter(sink, width_of(max(coder.vocab_size, (end_id or 0) + 1)))
                writer.add_many(ids[part], lens, got)
        if writer is not None:
            writer.close()
            sink.close()
            yield common.to_batch([(task.partitionId(), name, len(writer.doc_ids), writer.starts[-1])], schema)

    rows.mapInArrow(run, "shard int, path string, n_docs long, n_ids long").write.mode("overwrite").parquet(f"{out_dir}/manifest")
    return read_manifest(spark, out_dir)


def read_manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    """The manifest with each shard's first id position (one row per shard)."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = spark.read.parquet(f"{out_dir}/manifest")
    return shards.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_token_files(spark: SparkSession, out_dir: str, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, start, n_tokens, ids)`` of every document from the shard files.

    ``start`` counts the ids of all documents before it; ``ids`` are little-endian uint32.
    """
    manifest = read_manifest(spark, out_dir)
    n = max(1, spark.read.parquet(f"{out_dir}/manifest").count())  # one row per shard
    common.ship(spark)

    def run(batch: pa.RecordBatch):
        fs, folder = open_folder(out_dir)
        for path, first in zip(batch.column("path").to_pylist(), batch.column("first_id").to_pylist()):
            with fs.open_input_file(f"{folder}/{path}") as source:
                for doc, start, ids in ShardReader(source).documents():
                    yield doc, first + start, len(ids), ids.tobytes()

    spread = manifest.select("path", "first_id").repartition(n, "path")
    return common.row_map(spread, run, f"`{id_col}` long, start long, n_tokens long, ids binary",
                          size=lambda r: 64 + len(r[3]))
