"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word is a row of symbols.  The leaves of a segment tree hold, for every symbol,
the merge rank of the pair it forms with its right neighbour (ties: the position),
so the root is the leftmost lowest-rank merge.  A merge changes three leaves (the
merged pair, its left neighbour and the symbol that went), each a point update of
logarithmic cost; the word is done when the root holds no pair.

Words of up to 64 symbols are merged many at a time: one numpy array holds a tree
per row and each step merges every row's root pair.  Longer words use one scalar tree,
so a word of a million symbols costs a million logarithmic updates.

A text is cut at ASCII white space first.  Pieces are independent of each other
(the pre-tokeniser never joins over white space, normalisation neither), so ids are
remembered per piece in a bounded two-generation cache that the Python worker keeps
between tasks.  The normaliser and pre-tokeniser named in the tokenizer file come from
the ``tokenizers`` library; all merging is done here.

Defined results: a null or empty text has no ids and decodes to the empty text;
special tokens written in a text become their ids, as the library does by default;
rows are never merged, so repeated ids and null ids give a row each.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

INF = np.int64(2**62)
WIDE = 64          # symbols a row of the vectorised tree may have
ROWS = 4096        # rows merged at a time
CACHE_PIECES = 500_000  # pieces in one generation of the worker's cache


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class BpeModel:
    """Vocabulary, merge ranks and pre-tokeniser of a ``tokenizers`` JSON file."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        data = json.loads(spec)
        model = data["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout"):
            raise ValueError("a deterministic BPE file without continuing prefix is needed")
        library = Tokenizer.from_str(spec)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        chars = byte_chars()
        self.unchar = {c: b for b, c in enumerate(chars)}
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in chars], dtype=np.int64)
        pairs = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.pairs = pairs
        keys = np.array([(a << 32) | b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in pairs.values()], dtype=np.int64)[order]
        self.made = np.zeros(len(model["merges"]) + 1, dtype=np.int64)
        for rank, new in pairs.values():
            self.made[rank] = new
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        names = sorted((re.escape(s.encode()) for s in self.special), key=len, reverse=True)
        self.cut = re.compile(b"(" + b"|".join(names) + b")") if names else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for text, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = text.encode()
        self.ascii_unit = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0D\x20a-z0-9]+")
        self.plain = self._plain_rule(data)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @staticmethod
    def _plain_rule(data: dict) -> bool:
        """Whether ASCII pieces follow the one split rule that ``ascii_unit`` writes out."""
        parts = (data.get("pre_tokenizer") or {}).get("pretokenizers") or []
        rule = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        kinds = [n["type"] for n in (data.get("normalizer") or {}).get("normalizers", [])]
        return kinds == ["NFC", "Replace", "Lowercase"] and len(parts) == 2 and parts[0].get("pattern") == {"Regex": rule}

    # ------------------------------------------------------------------ words
    def units(self, piece: bytes) -> list[bytes]:
        """The words of a piece that holds no special token, as bytes."""
        if self.plain and piece.isascii():
            return self.ascii_unit.findall(piece.lower())
        text = piece.decode()
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        byte = self.unchar
        return [bytes([byte[c] for c in chars]) for chars, _ in self.pre_tokenizer.pre_tokenize_str(text)]

    def _rank(self, a: np.ndarray, b: np.ndarray, pos: np.ndarray, bits: int) -> np.ndarray:
        """Leaf values: rank and position of each pair, INF if it does not merge."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), (self.ranks[at] << bits) | pos, INF)

    def merge_rows(self, words: list[bytes], bits: int) -> list[bytes]:
        """Merge words of at most ``2 ** bits`` symbols; ids as little-endian uint32."""
        n_rows, width = len(words), 1 << bits
        lens = np.fromiter(map(len, words), dtype=np.int64, count=n_rows)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        cols = np.arange(width)
        live = cols < lens[:, None]
        sym = np.full((n_rows, width + 1), -1, dtype=np.int64)
        sym[:, :width][live] = self.inner[flat]
        last = flat[np.cumsum(lens) - 1]
        every = np.arange(n_rows)
        sym[every, lens - 1] = self.final[last]
        nxt = np.broadcast_to(np.arange(1, width + 2), (n_rows, width + 1)).copy()
        nxt[:, width] = width
        nxt[every, lens - 1] = width
        prv = np.broadcast_to(np.arange(-1, width), (n_rows, width + 1)).copy()
        tree = np.full((n_rows, 2 * width), INF, dtype=np.int64)
        tree[:, width:] = self._rank(sym[:, :width], sym[:, 1:], cols, bits)
        half = width // 2
        while half:
            tree[:, half:2 * half] = np.minimum(tree[:, 2 * half:4 * half:2], tree[:, 2 * half + 1:4 * half:2])
            half //= 2

        def point(rows: np.ndarray, pos: np.ndarray, value) -> None:
            i = pos + width
            tree[rows, i] = value
            for _ in range(bits):
                i >>= 1
                tree[rows, i] = np.minimum(tree[rows, 2 * i], tree[rows, 2 * i + 1])

        rows = every
        while True:
            root = tree[rows, 1]
            on = root < INF
            rows, root = rows[on], root[on]
            if not len(rows):
                break
            pos, rank = root & (width - 1), root >> bits
            gone = nxt[rows, pos]
            after = nxt[rows, gone]
            new = self.made[rank]
            sym[rows, pos] = new
            nxt[rows, pos] = after
            prv[rows, after] = pos
            live[rows, gone] = False
            point(rows, gone, INF)
            point(rows, pos, self._rank(new, sym[rows, after], pos, bits))
            before = prv[rows, pos]
            some = before >= 0
            r, p = rows[some], before[some]
            point(r, p, self._rank(sym[r, p], new[some], p, bits))
        ids = sym[:, :width][live].astype("<u4").tobytes()
        ends = (np.cumsum(live.sum(axis=1)) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def merge_long(self, word: bytes) -> bytes:
        """The same merge of one long word, with a scalar tree."""
        n = len(word)
        sym = self.inner[np.frombuffer(word, dtype=np.uint8)].tolist()
        sym[-1] = int(self.final[word[-1]])
        bits = (n - 1).bit_length()
        width, none, pairs, made = 1 << bits, int(INF), self.pairs, self.made
        mask = width - 1
        tree = [none] * (2 * width)

        def leaf(i: int, j: int) -> int:
            found = pairs.get((sym[i], sym[j])) if j < n else None
            return (found[0] << bits) | i if found else none

        for i in range(n - 1):
            tree[width + i] = leaf(i, i + 1)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def point(pos: int, value: int) -> None:
            i = pos + width
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    return
                tree[i] = low

        nxt, prv = list(range(1, n + 2)), list(range(-1, n + 1))
        while tree[1] < none:
            pos, rank = tree[1] & mask, tree[1] >> bits
            gone = nxt[pos]
            after = nxt[gone]
            sym[pos], sym[gone] = int(made[rank]), -1
            nxt[pos], prv[after] = after, pos
            point(gone, none)
            point(pos, leaf(pos, after))
            if prv[pos] >= 0:
                point(prv[pos], leaf(prv[pos], pos))
        return np.array([s for s in sym if s >= 0], dtype="<u4").tobytes()

    def merge_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """ids (little-endian uint32 bytes) of each distinct word."""
        out: dict[bytes, bytes] = {}
        by_bits: dict[int, list[bytes]] = {}
        for w in words:
            if len(w) > WIDE:
                out[w] = self.merge_long(w)
            else:
                by_bits.setdefault(max(1, (len(w) - 1).bit_length()), []).append(w)
        for bits, group in by_bits.items():
            for k in range(0, len(group), ROWS):
                part = group[k:k + ROWS]
                out.update(zip(part, self.merge_rows(part, bits)))
        return out

    # ----------------------------------------------------------------- pieces
    def learn(self, pieces: Iterable[bytes]) -> None:
        """Put the ids of new pieces into the cache."""
        plans: list[tuple[bytes, list]] = []
        words: set[bytes] = set()
        for piece in pieces:
            if self.cut and self.cut.search(piece):
                parts: list = []
                for k, s in enumerate(self.cut.split(piece)):
                    parts.extend([self.special[s.decode()]] if k % 2 else self.units(s) if s else [])
                words.update(p for p in parts if not isinstance(p, int))
            else:
                parts = self.units(piece)
                words.update(parts)
            plans.append((piece, parts))
        ids = self.merge_words(words)
        ids.update((i, i.to_bytes(4, "little")) for i in self.special.values())
        young = self.young
        for piece, parts in plans:
            young[piece] = ids[parts[0]] if len(parts) == 1 else b"".join([ids[p] for p in parts])

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """ids of each text as little-endian uint32 bytes."""
        cut = [(t or b"").split() for t in texts]
        young, old = self.young, self.old
        if len(young) > CACHE_PIECES:
            self.old, self.young = young, {}
            young, old = self.young, self.old
        wanted = set().union(*cut) if cut else set()
        wanted.difference_update(young.keys())
        for w in [w for w in wanted if w in old]:
            young[w] = old[w]
            wanted.discard(w)
        self.learn(wanted)
        return [b"".join([young[w] for w in words]) for words in cut]

    def decode(self, ids: bytes) -> bytes:
        """Tokens joined by single spaces, the library's rule for a file without decoder."""
        table = self.tokens
        return b" ".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


_MODELS: dict[str, BpeModel] = {}


def model_of(spec: str) -> BpeModel:
    """The worker's model of a tokenizer file; it stays between tasks."""
    key = hashlib.sha1(spec.encode()).hexdigest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = BpeModel(spec)
    return _MODELS[key]


def slices(texts: list, limit: int = 2_000_000) -> Iterator[slice]:
    """Consecutive slices of about ``limit`` bytes of text."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or b"")
        if size >= limit:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encode_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids, n_tokens, decoded)`` of every row.

    ``ids`` are the token ids as little-endian unsigned 32-bit integers and ``decoded``
    is the text decoded from them.  The vocabulary file is read once on the driver and
    broadcast; its size is that of the file and does not depend on the data.
    """
    spec = df.sparkSession.sparkContext.broadcast(common.read_text(tokenizer_path))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        model = model_of(spec.value)
        keys, texts = batch.column(0).to_pylist(), common.byte_values(batch.column(1))
        for part in slices(texts):
            for key, ids in zip(keys[part], model.encode(texts[part])):
                yield key, ids, len(ids) // 4, model.decode(ids)

    rows = df.select(F.col(id_col), F.col(text_col).cast("string"))
    out = common.row_map(rows, run, f"`{id_col}` {id_type}, ids binary, n_tokens long, decoded binary",
                         size=lambda r: 64 + len(r[1]) + len(r[3]))
    return out.withColumn("decoded", F.decode("decoded", "utf-8"))
