"""BPE against the tokenizers library; token files by exact round trips."""

import io
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_helpers import make_docs  # noqa: F401
from searchrank.llm import bpe, token_files
from searchrank.llm.common import read_text
from searchrank.llm.queries import vocabulary


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def model():
    return bpe.BpeModel(read_text(vocabulary()))


ODD = ["", " ", "a<|endoftext|>b <|startoftext|>", "İSTANBUL ſt Ⅷ x́ y \x1c\x1d a", "a" * 1000, "ab" * 3000, "é né 日本語 ①²３ 😀  x",
       "it's WE'LL 'S o'REILLY don't", "\x00\x01 \x7f", "Σίσυφος ΟΔΟΣ", "ǅ ŉ ẞ ﬁ ᾼ", "x\u2028y\u00a0z\u3000q", "<|endoftext|>" * 3]


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_odd_texts_match_the_library(model, library):
    got = model.encode([t.encode() for t in ODD])
    for text, data in zip(ODD, got):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(data) == want
        assert model.decode(data).decode() == library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_matches_the_library(model, library, text):
    assert ids_of(model.encode([text.encode()])[0]) == library.encode(text, add_special_tokens=False).ids


def test_row_trees_and_scalar_tree_agree(model):
    rng = random.Random(5)
    for n in (1, 2, 3, 15, 16, 17, 63, 64):
        words = [bytes(rng.choice(b"aeinorst") for _ in range(n)) for _ in range(20)]
        bits = max(1, (n - 1).bit_length())
        assert model.merge_rows(words, bits) == [model.merge_long(w) for w in words]


def test_encode_decode_rows(make_docs):
    rows = [(1, "Hello world"), (1, "Hello world"), (None, None), (2, ""), (3, "x " * 5000)]
    got = sorted(bpe.encode_decode(make_docs(rows), vocabulary()).collect(), key=str)
    assert len(got) == 5
    by = {r["doc_id"]: r for r in got}
    assert by[None]["n_tokens"] == 0 and by[2]["decoded"] == "" and by[3]["n_tokens"] == 5000
    assert bpe.encode_decode(make_docs([]), vocabulary()).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype("<u4")
    data = token_files.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert np.array_equal(token_files.unpack(data, bits, 1001), ids)


def test_width():
    assert [token_files.width_of(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_shard_random_access():
    rng = np.random.default_rng(3)
    docs = [(None, rng.integers(0, 5000, 0)), *[(k, rng.integers(0, 5000, rng.integers(0, 40_000))) for k in range(12)]]
    sink = io.BytesIO()
    w = token_files.ShardWriter(sink, 13)
    for d, ids in docs:
        w.add(d, ids.astype("<u4"))
    w.close()
    r = token_files.ShardReader(Source(sink.getvalue()))
    flat = np.concatenate([ids for _, ids in docs])
    for a, b in [(0, 0), (0, 1), (5, 9000), (8191, 8193), (len(flat) - 3, len(flat))]:
        assert np.array_equal(r.ids(a, b), flat[a:b])
    for (d, ids), (d2, _, got) in zip(docs, r.documents(ids_at_once=10_000)):
        assert d == d2 and np.array_equal(ids, got)


def test_files_round_trip(spark, make_docs, scratch, library):
    rows = [(k, f"text number {k} " * (k % 7)) for k in range(60)] + [(None, None), (5, "again"), (5, "again")]
    manifest = token_files.write_token_files(make_docs(rows), scratch, vocabulary(), end_id=1)
    assert manifest.agg({"n_docs": "sum"}).first()[0] == 63
    got = token_files.read_token_files(spark, scratch).orderBy("start").collect()
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert keys == sorted(keys)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows if i != 5}
    for r in got:
        if r["doc_id"] in want:
            assert ids_of(r["ids"]) == want[r["doc_id"]]


def test_empty_table_of_files(spark, make_docs, scratch):
    assert token_files.write_token_files(make_docs([]), scratch, vocabulary()).count() == 0
    assert token_files.read_token_files(spark, scratch).count() == 0
