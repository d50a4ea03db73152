"""SimHash links, spelling variants and hard negatives against brute force."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm_helpers import make_docs, words  # noqa: F401
from searchrank.llm import hard_negatives, queries, simhash, spelling

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --------------------------------------------------------------------- simhash
def brute_print(text, width=4):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UP))
    if not w:
        return 0
    width = min(width, len(w))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + width]).encode(), 42) for i in range(len(w) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_near(rows, radius=4):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            root[find(i)] = find(j)
    low = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            low[find(k)] = min(low.get(find(k), d), d)
    return sorted(((d, f"{p:016x}", low.get(find(k))) for k, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_simhash_links_equal_brute_force(spark, make_docs):  # noqa: F811
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(12):
        base = words(rng, int(rng.integers(150, 400)))
        for _ in range(int(rng.integers(1, 12))):
            w = list(base)
            for k in rng.integers(0, len(w), size=int(rng.integers(0, 4))):
                w[k] = "x" + w[k]
            rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "One"), (904, "one"), (905, "ONE two\x0bthree"), (906, "É é a B c"), (None, rows[0][1]),
             (None, "only nulls here and nowhere else"), (7, rows[7][1]), (7, "another text of the same id")]
    got = found(simhash.near_duplicates(make_docs(rows)))
    assert got == brute_near(rows)
    assert len({r[2] for r in got}) < len(rows) - 20


def test_simhash_other_widths_odd_tables_and_types(spark, make_docs):  # noqa: F811
    assert simhash.near_duplicates(make_docs([])).count() == 0
    rows = [("b", "x y z", 1, 2), ("a", "x  Y z", 3, 4), (None, "x y z", 5, 6)]
    df = spark.createDataFrame(rows, "name string, body string, fp long, component_id long")
    got = simhash.near_duplicates(df, "name", "body", width=2, radius=0)
    assert {r["component_id"] for r in got.collect()} == {"a"} and got.columns == ["name", "fingerprint", "component_id"]
    with pytest.raises(ValueError):
        simhash.hamming_links(spark.createDataFrame([(1,)], "fp long"), 8)


def test_long_texts_are_hashed_whole():
    rng = np.random.default_rng(5)
    text = " ".join(words(rng, 30_000)).encode()
    whole = simhash.fingerprint(text)
    votes, n = simhash.shingle_votes(text.split(), 4)
    assert whole == int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")
    old, simhash.word_blocks.__defaults__ = simhash.word_blocks.__defaults__, (777,)
    try:
        assert simhash.fingerprint(text) == whole
        assert simhash.fingerprint(b"a" * 5000 + b" b c") == brute_print("a" * 5000 + " b c")
    finally:
        simhash.word_blocks.__defaults__ = old


def prints_around(rng, centres, members, flips):
    out = set()
    for c in rng.integers(0, 2**63, size=centres, dtype=np.uint64).tolist():
        for _ in range(members):
            x = c
            for b in rng.integers(0, 64, size=int(rng.integers(0, flips))).tolist():
                x ^= 1 << b
            out.add(x)
    return np.array(sorted(out), dtype=np.uint64)


@pytest.mark.parametrize("chunk,bucket", [(8192, 2048), (50, 2048), (8192, 0)])
def test_links_of_large_families_chunks_and_more_tables(spark, monkeypatch, chunk, bucket):
    """Same components from one cell a key, hot keys in chunks, and tables with longer keys."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(8)
    fp = np.concatenate([prints_around(rng, 40, 6, 6), prints_around(rng, 1, 900, 7)])
    fp = np.unique(fp)
    near = [np.flatnonzero(np.bitwise_count(fp[k + 1:] ^ fp[k]) <= 4) + k + 1 for k in range(len(fp))]
    want = simhash.forest(len(fp), np.repeat(np.arange(len(fp)), [len(x) for x in near]), np.concatenate(near))
    assert (len(simhash.tables_of(len(fp), 4)) > 5) == (bucket == 0)
    links = simhash.hamming_links(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long").repartition(3), 4).collect()
    place = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    a, b = (np.array([place[r[c]] for r in links]) for c in "ab")
    assert np.array_equal(simhash.forest(len(fp), a, b), want)
    if chunk == 8192 and bucket == 2048:
        assert len(links) <= 5 * len(fp)  # a forest for each table, not all pairs


def test_bit_sliced_distances():
    rng = np.random.default_rng(2)
    fp = prints_around(rng, 3, 60, 9)
    planes = simhash.planes_of(fp)
    for radius in (0, 3, 4, 7):
        q, w = np.repeat(np.arange(len(fp)), planes.shape[1]), np.tile(np.arange(planes.shape[1]), len(fp))
        outside = ~simhash._ones(np.clip(len(fp) - w * 64, 0, 64))
        k, lanes = simhash.lanes_within(planes, fp[q], w, outside, radius)
        got = {(int(q[i]), int(w[i]) * 64 + lane) for i, bits in zip(k, lanes.tolist()) for lane in range(64) if bits >> lane & 1}
        assert got == {(i, j) for i in range(len(fp)) for j in range(len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= radius}


# -------------------------------------------------------------------- spelling
def brute_variants(rows, change=spelling.drop_by_crc):
    total = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(UP)
            word = change("" if d is None else str(d), word)
            if len(word) >= 7:
                total[word] += 1
    vocab = {w: n for w, n in total.items() if n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return len(long) == len(short) + 1 and any(long[:k] + long[k + 1:] == short for k in range(len(long)))
    form, n_near = {}, {}
    for w, n in vocab.items():
        others = [x for x in vocab if abs(len(x) - len(w)) <= 1 and near(w, x)]
        n_near[w] = len(others)
        best = min(others, key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= 10 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted(((w, n, n_near[w], form[w], vocab.get(form[w]), root(w)) for w, n in vocab.items()), key=str)


def variant_rows(rng):
    letters = list("abcdefghijklmnopqrstuvwxyzÀéÿ×")
    stems = ["".join(rng.choice(letters, int(rng.integers(7, 12)))) for _ in range(25)]
    rows = []
    for d in range(300):
        picked = []
        for s in rng.choice(stems, 12, p=np.arange(1, 26)[::-1] / 325).tolist():
            x, k = rng.random(), int(rng.integers(len(s)))
            if x < 0.05:
                s = s[:k] + s[k + 1:]
            elif x < 0.1:
                s = s[:k] + str(rng.choice(letters)) + s[k:]
            elif x < 0.2:
                s = s[:k] + str(rng.choice(["a", "b", "é"])) + s[k + 1:]
            picked.append(s.upper() if s.isascii() and rng.random() < 0.2 else s)
        rows.append((d, ", ".join(picked) + " 12 aĀb"))
    chain = [(1000 + k, " ".join(["chainedworda"] * 3 + ["chainedwordb"] * 40 + ["chainedwordbc"] * 500)) for k in range(1)]
    return rows + chain + [(None, "unknown unknown unknowm unknowm"), (5, None), (6, ""), (7, "kaaaaaatt " * 3 + "kaaaaatt " * 4), (7, "kaaaaaatt " * 3)]


def test_variants_equal_brute_force(make_docs):  # noqa: F811
    rows = variant_rows(np.random.default_rng(4))
    got = found(spelling.group_variants(make_docs(rows), change=spelling.drop_by_crc))
    want = brute_variants(rows)
    assert got == want
    assert sum(r[3] is not None for r in want) > 5 and any(r[3] is not None and r[5] != r[3] for r in want)


def test_variants_in_several_passes_blocks_and_with_false_positives(make_docs, monkeypatch):  # noqa: F811
    rows = variant_rows(np.random.default_rng(6))
    monkeypatch.setattr(spelling, "FILTER_BLOCKS", 8)
    assert spelling.layout({9: 400, 10: 40}).passes > 1
    assert found(spelling.group_variants(make_docs(rows), change=spelling.drop_by_crc)) == brute_variants(rows)
    assert found(spelling.group_variants(make_docs(rows))) == brute_variants(rows, lambda d, w: w)
    assert spelling.group_variants(make_docs([])).count() == 0
    assert spelling.group_variants(make_docs([(1, None), (2, "")])).count() == 0


def test_edits_in_blocks_of_places_and_full_filters():
    """Every edit of a long word passes a full filter, whatever the block of places; keys equal those of the edited words."""
    word = "abracadabraé" * 3
    filters = spelling.Filters({len(word): 4, len(word) - 1: 4}, 1)
    full = np.full(filters.blocks, ~np.uint64(0))
    old = spelling.PLACES
    try:
        for places in (5, 1000):
            spelling.PLACES = places
            seen = {}
            for w, key, place, letter in spelling.probe([word, "x" * 40], filters, full, 0):
                for p, k in zip(place.tolist(), key.tolist()):
                    if w[0] == 0:
                        seen[word[:p] + ("" if letter == 0 else chr(letter)) + word[p + 1:]] = k
            bigger = {word[:p] + chr(c) + word[p + 1:] for p in range(len(word)) for c in spelling.ALPHABET.tolist() if chr(c) > word[p]}
            assert set(seen) == bigger | {word[:p] + word[p + 1:] for p in range(len(word))}
            assert spelling.word_keys(list(seen)).tolist() == list(seen.values())
    finally:
        spelling.PLACES = old


def test_crc_rule():
    run = "wonderful"
    hit = next(d for d in range(1000) if zlib.crc32(f"{d}:{run}".encode()) % 31 == 0)
    k = zlib.crc32(f"{hit}:{run}".encode()) % len(run)
    assert spelling.drop_by_crc(str(hit), run) == run[:k] + run[k + 1:]


# -------------------------------------------------------------- hard negatives
def brute_negatives(rows, anchor=lambda d: d is not None and d % 50 == 0, positives=5, negatives=3):
    ok = []
    for d, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        ok.append((d, [int(np.floor(256 * float(np.float32(x)))) for x in v], label))
    out = []

    def order(x):
        return -x[0], x[1] is None, x[1] or 0
    for i, (d, q, label) in enumerate(ok):
        if not anchor(d):
            continue
        scored = [(sum(a * b for a, b in zip(q, r)), e, other) for j, (e, r, other) in enumerate(ok) if j != i]
        for p, e, _ in sorted([x for x in scored if x[2] == label], key=order)[:positives]:
            fit = sorted([x for x in scored if x[2] != label and 50 * p <= 100 * x[0] <= 95 * p], key=order)[:negatives]
            out += [(d, e, k + 1, n, p, s) for k, (s, n, _) in enumerate(fit)]
    return sorted(out, key=str)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return found(hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 50 == 0, **kw).drop("positive_rank"))


def vectors(rng, n, dims, labels=3, spread=0.5):
    centre = rng.normal(size=dims) * spread
    return [(k, (centre + rng.normal(size=dims) * 0.3).astype(np.float32).tolist(), int(rng.integers(labels))) for k in range(n)]


@pytest.mark.parametrize("dims", [3, 16, 21])
def test_negatives_equal_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    rows = vectors(rng, 260, dims)
    rows += [(300, rows[0][1], 1)] + [(310 + k, rows[1][1], 0) for k in range(6)] + [(320 + k, rows[1][1], 2) for k in range(6)]  # ties
    rows += [(350, None, 1), (400, [None] * dims, 1), (450, [float("nan")] * dims, 1), (500, [float("inf")] * dims, 1), (550, rows[3][1], None),
             (None, rows[5][1], 1), (None, rows[5][1], 2), (600, rows[5][1][:2], 1), (601, [], 1), (50, rows[9][1], 1), (50, rows[9][1], 1)]
    want = brute_negatives(rows)
    assert mined(spark, rows) == want and len(want) > 20


def test_negatives_over_many_groups_and_tiles(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(50 * k if k % 3 else 50 * k + 1, v, label) for k, v, label in vectors(rng, 300, 10, labels=2)]
    want = brute_negatives(rows)
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 40)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 30)
    assert mined(spark, rows) == want and len(want) > 100


def test_negatives_of_odd_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(k, [], k % 2) for k in range(4)]) == brute_negatives([(k, [], k % 2) for k in range(4)])
    wide = [(0, [2000.0, 1.0], 1), (1, [2000.0, 2.0], 1), (2, [1500.0, -3.0], 2), (3, [-1e-9, 0.0], 2)]
    assert mined(spark, wide) == brute_negatives(wide) != []
    with pytest.raises(ValueError):
        mined(spark, [(0, [1e9], 1), (1, [1e9], 1)])


def test_four_russians_scores_are_exact():
    rng = np.random.default_rng(0)
    for top in (1, 160, 5000):
        q, a = rng.integers(-top, top + 1, size=(100, 24)), rng.integers(-top, top + 1, size=(30, 24))
        planes = hard_negatives.pack_planes(q, top.bit_length() + 1)
        assert np.array_equal(hard_negatives.unpack_planes(planes), q)
        assert np.array_equal(hard_negatives.scores(planes, hard_negatives.subset_sums(a, np.int64)), q @ a.T)


def test_simhash_query_equals_brute_force(spark):
    """op11 over the whole smallest table; its SQL form does not exist (no XXH64 in SQL)."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(queries.QUERIES["op11_simhash"](spark, "/root/testdata/sf0.001")) == brute_near(rows)
