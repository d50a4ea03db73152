"""Jaccard components, decontamination, line and span dedup, url rules, against brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_helpers import make_docs, words  # noqa: F401
from searchrank.llm import common, decontam, line_dedup, ngram_join, span_dedup, url_rules
from searchrank.llm.components import components
from searchrank.llm.queries import URL_RULES

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ------------------------------------------------------------------ components
def union_find(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in links:
        up[find(a)] = find(b)
    return [find(k) for k in range(n)]


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200)]
    got = {r["v"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in range(100, 160)} == {100} and got[202] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --------------------------------------------------------------------- jaccard
def shingles(text, n):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(UP)) if x]
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                links.append((i, j))
    root = union_find(len(rows), links)
    low = {}
    for k, r in enumerate(root):
        if rows[k][0] is not None:
            low[r] = min(low.get(r, rows[k][0]), rows[k][0])
    return sorted(((d, len(s), low.get(r) if s else d) for (d, _), s, r in zip(rows, sets, root)), key=str)


def family(rng, base, count, edits):
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.integers(0, edits + 1)):
            w[rng.integers(len(w))] = f"e{rng.integers(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (1, 50), (2, 100)])
def test_jaccard_components_match_all_pairs(spark, make_docs, n, percent):
    rng = np.random.default_rng(n)
    texts = [" ".join(words(rng, int(rng.integers(1, 120)))) for _ in range(60)]
    passage = " ".join(words(rng, 60))
    texts += [" ".join(words(rng, 40)) + " " + passage for _ in range(25)]
    texts += family(rng, words(rng, 160), 70, 12) + family(rng, words(rng, 700), 25, 30) + family(rng, words(rng, 12), 20, 2)
    chain = words(rng, 200)  # each copy edits the one before
    for _ in range(20):
        chain = list(chain)
        for _ in range(4):
            chain[rng.integers(len(chain))] = f"c{rng.integers(10**6)}"
        texts.append(" ".join(chain))
    texts += [texts[70]] * 30 + ["", " \n ", "one", "One", "two words", None]
    order = rng.permutation(len(texts))
    rows = [(int(k), texts[int(k)]) for k in order] + [(None, texts[90]), (3, texts[3]), (4, texts[100])]
    got = ngram_join.jaccard_components(make_docs(rows), n=n, percent=percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, n, percent)


def test_jaccard_with_crowded_tables(spark, make_docs, monkeypatch):
    """Full order and bit tables, and small vertical fragments, change no result."""
    monkeypatch.setattr(ngram_join, "FILTER_BITS", 64)
    monkeypatch.setattr(ngram_join, "PART", 16)
    rng = np.random.default_rng(9)
    rows = list(enumerate(family(rng, words(rng, 150), 60, 10) + family(rng, words(rng, 37), 20, 3)))
    got = ngram_join.jaccard_components(make_docs(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, 3, 90)


def counted_candidates(monkeypatch):
    """Rows of every table of candidate pairs that the join makes from here on."""
    made, real = [], ngram_join.cut_lineage

    def cut(df, *a):
        out = real(df, *a)
        if out.columns == ["a", "b", "na", "nb"]:
            made.append(out.count())
        return out
    monkeypatch.setattr(ngram_join, "cut_lineage", cut)
    return made


@pytest.mark.parametrize("jitter", [0, 6])
def test_family_just_below_the_threshold_has_few_candidates(spark, make_docs, monkeypatch, jitter):
    """3,000 copies, most of them a little too far from the original and from each other, with equal or different lengths."""
    made = counted_candidates(monkeypatch)
    rng = np.random.default_rng(21)
    base, texts = words(rng, 242, 10**6), []
    for k in range(3000):
        w = list(base)
        for p in rng.choice(np.arange(10, 235, 4), 5 if k % 8 else 3, replace=False):
            w[p] = f"own{k}x{p}"
        cut = int(rng.integers(0, jitter + 1))
        texts.append(" ".join(w[cut:]))
    rows = list(enumerate([" ".join(base), *texts]))
    got = ngram_join.jaccard_components(make_docs(rows)).select("doc_id", "n_shingles", "component_id").collect()
    ids: dict[tuple, int] = {}
    sets = [np.array([ids.setdefault(g, len(ids)) for g in shingles(t, 3)]) for _, t in rows]
    common_part = np.array(sorted(ids[g] for g in shingles(rows[0][1], 3)))
    # own n-grams belong to one document each, so overlaps lie inside the original's n-grams
    inside = np.zeros((len(rows), len(common_part)), dtype=np.float32)
    for k, s in enumerate(sets):
        inside[k] = np.isin(common_part, s)
    o, n = inside @ inside.T, np.array([len(s) for s in sets])
    i, j = np.nonzero(np.triu(100 * o >= 90 * (n[:, None] + n[None, :] - o), 1))
    root = union_find(len(rows), list(zip(i.tolist(), j.tolist())))
    low = {}
    for k, r in enumerate(root):
        low[r] = min(low.get(r, k), k)
    want = [(k, int(n[k]), low[root[k]]) for k in range(len(rows))]
    assert sorted(map(tuple, got)) == want and 300 < sum(w[2] == 0 for w in want)
    assert sum(made) < 2 * len(rows)


def test_family_with_few_common_tokens_meets_in_few_rows(spark, make_docs, monkeypatch):
    """Copies that share fewer tokens than a link asks for, but share those with all others: no join of all with all."""
    made, frame = [], type(spark.range(1))
    real = frame.unionByName

    def union(self, other, *a, **kw):
        out = real(self, other, *a, **kw)
        if out.columns == ["a", "b", "na", "nb"]:
            made.append(out.count())
        return out
    monkeypatch.setattr(frame, "unionByName", union)
    rng = np.random.default_rng(22)
    base, texts = words(rng, 242, 10**6), []
    for k in range(400):
        w = list(base)
        for p in rng.choice(np.arange(10, 235, 4), 5 if k % 8 else 3, replace=False):
            w[p] = f"own{k}x{p}"
        texts.append(" ".join(w))
    rows = list(enumerate([" ".join(base), *texts]))
    got = ngram_join.jaccard_components(make_docs(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, 3, 90)
    assert made and sum(made) < 10 * len(rows)


def test_jaccard_of_empty_table(make_docs):
    assert ngram_join.jaccard_components(make_docs([])).count() == 0


# ------------------------------------------------------------- decontamination
def brute_hits(text, items, size=13):
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = pat.findall((text or "").translate(UP))
    hit, found = set(), set()
    for i, t in items:
        v = pat.findall((t or "").translate(UP))
        k = min(size, len(v))
        wins = {tuple(v[a:a + k]) for a in range(len(v) - k + 1)} if k else set()
        for p in range(len(w) - k + 1 if k else 0):
            if tuple(w[p:p + k]) in wins:
                hit |= set(range(p, p + k))
                if i is not None:
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_decontamination_matches_brute_force(spark, make_docs):
    rng = np.random.default_rng(4)
    items = [(k, " ".join(words(rng, int(n), 50))) for k, n in enumerate([40, 20, 13, 12, 5, 2, 1, 0, 30])]
    items += [(8, items[0][1]), (None, " ".join(words(rng, 20))), (9, None)]
    texts = [" ".join(words(rng, 200, 50)) for _ in range(20)]
    for i, t in items:
        if t:
            w = t.split()
            texts.append(" ".join(words(rng, 30) + w + words(rng, 5)).upper())
            texts.append(" ".join(words(rng, 10) + w[3:] + ["- ,"] + w[:-1]))
            texts.append(t)
    texts += ["", None, items[0][1] + " " + items[0][1], ", ".join(items[0][1].split())]
    rows = list(enumerate(texts)) + [(None, items[0][1]), (1, texts[30]), (1, texts[30])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(make_docs(rows), bench).select("doc_id", "n_words", "n_hit", "items").collect()
    want = [(d, *brute_hits(t, items)) for d, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    # blocks of a few shingles give the same
    old, decontam.SHINGLES_AT_ONCE = decontam.SHINGLES_AT_ONCE, 60
    try:
        got = decontam.decontaminate(make_docs(rows), bench).select("doc_id", "n_words", "n_hit", "items").collect()
    finally:
        decontam.SHINGLES_AT_ONCE = old
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_decontamination_of_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontam.decontaminate(make_docs([(1, "a b")]), none).collect()] == [(1, 2, 0, [])]
    assert decontam.decontaminate(make_docs([]), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


# ------------------------------------------------------------------ line dedup
def brute_lines(rows, min_chars=20, min_docs=3):
    blank = " \t\n\x0b\x0c\r"
    keys = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            k = x.strip(blank).translate(UP)
            if len(k) >= min_chars:
                keys.setdefault(k, set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for x in lines:
            held = keys.get(x.strip(blank).translate(UP), set())
            last = max((y for y in held if y is not None), default=None)
            if len(held) < min_docs or d == last:
                kept.append(x)
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup_matches_brute_force(make_docs):
    common_ = ["This line stands in many documents.", "  another LINE of more than twenty  ", "short line", "ünïcödé línè öf ëxáctly 20 x", "é" * 19, "É" * 20]
    rng = np.random.default_rng(2)
    rows = []
    for k in range(40):
        lines = [" ".join(words(rng, 6)) for _ in range(4)] + [c for c in common_ if rng.random() < 0.4]
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines)))
    rows += [(None, common_[0] + "\n"), (7, common_[0].upper()), (7, common_[0].upper()), (50, ""), (51, None), (52, "\n\n"),
             (53, "\r" + common_[0] + "\x0b\n" + common_[0])]
    got = line_dedup.dedup_lines(make_docs(rows)).select("doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows)


def test_line_dedup_carries_columns(spark, make_docs):
    df = make_docs([(1, "a")]).withColumnRenamed("lang", "other")
    assert line_dedup.dedup_lines(df, carry=("other",)).columns == ["doc_id", "other", "n_lines", "n_dropped", "kept"]
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(df.withColumnRenamed("other", "kept"), carry=("kept",))
    assert line_dedup.dedup_lines(make_docs([])).count() == 0


# ------------------------------------------------------------------ span dedup
def sentences(rng, n):
    return [" ".join(words(rng, int(rng.integers(4, 14)), 10**6)).capitalize() + "." for _ in range(n)]


def test_repeated_passages_lose_all_but_the_first(make_docs):
    rng = np.random.default_rng(6)
    passage = sentences(rng, 8)
    rows, own = [], {}
    for k in range(30):
        a, b = sentences(rng, 5), sentences(rng, 5)
        own[k] = (a, b)
        rows.append((k, " ".join(a + (passage if k % 3 == 0 else []) + b)))
    rows += [(100, None), (101, ""), (102, " ".join(passage).upper()), (103, "No stop " * 5)]
    got = {r["doc_id"]: r for r in span_dedup.dedup_spans(make_docs(rows)).collect()}
    for k in range(30):
        r = got[k]
        a, b = own[k]
        if k == 0:
            assert r["n_removed"] == 0 and r["n_shared"] == 8 and r["kept"] == rows[0][1]
        elif k % 3 == 0:
            assert r["n_removed"] == 8 and r["first_docs"] == [0] and r["kept"].split() == " ".join(a + b).split()
        else:
            assert r["n_removed"] == r["n_shared"] == 0 and r["kept"] == rows[k][1]
    assert got[102]["kept"] == "" and got[102]["n_removed"] == 8
    assert got[100]["n_sentences"] == 0 and got[101]["kept"] == ""


def test_passage_without_stops_is_found_anywhere(make_docs):
    rng = np.random.default_rng(8)
    passage = words(rng, 120, 10**6)
    rows = [(k, " ".join(words(rng, 37 + k, 10**6) + passage + words(rng, 50, 10**6))) for k in range(4)]
    got = {r["doc_id"]: r for r in span_dedup.dedup_spans(make_docs(rows)).collect()}
    assert got[0]["n_removed"] == 0 and all(got[k]["n_removed_words"] > 60 for k in (1, 2, 3))


def test_repeat_inside_a_text_and_same_id(make_docs):
    rng = np.random.default_rng(1)
    p = sentences(rng, 4)
    got = span_dedup.dedup_spans(make_docs([(1, " ".join(p + sentences(rng, 2) + p)), (2, " ".join(sentences(rng, 3)))])).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_removed"] == 4 and by[2]["n_removed"] == 0
    twice = span_dedup.dedup_spans(make_docs([(1, " ".join(p)), (1, " ".join(p)), (None, " ".join(p))])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in twice) == [("1", 4), ("1", 4), ("None", 0)]
    assert span_dedup.dedup_spans(make_docs([])).count() == 0


def test_short_passage_at_unaligned_places_in_long_sentences(make_docs):
    rng = np.random.default_rng(15)
    for low, high in ((20, 41), (10, 31), (3, 60)):
        def prose_words(n):
            out = []
            while len(out) < n:
                out += words(rng, int(rng.integers(low, high)), 10**6)
                out[-1] += "."
            return out[:n]

        rows, of = [], {}
        for k in range(60):
            passage = prose_words(51 + k % 10)[-(51 + k % 10):]
            for d in (2 * k, 2 * k + 1):
                before = prose_words(int(rng.integers(30, 90)))
                rows.append((d, " ".join(before + passage + prose_words(int(rng.integers(30, 90))))))
            of[2 * k + 1] = (len(before), set(passage))
        got = {r["doc_id"]: r for r in span_dedup.dedup_spans(make_docs(rows)).collect()}
        for d, (_, held) in of.items():
            gone = set(rows[d][1].split()) - set(got[d]["kept"].split())
            assert len(held & gone) >= 15 and gone <= held
            assert got[d]["first_docs"] == [d - 1] and got[d - 1]["n_removed"] == 0


def brute_spans(rows, min_sentences=2, min_words=15):
    """Removed sentences of each document, over all runs of whole sentences."""
    texts = {d: [tuple(x.lower().split()) for x in t] for d, t in rows}
    runs = {d: [(i, e, tuple(t[i:e])) for i in range(len(t)) for e in range(i + min_sentences, len(t) + 1)
                if sum(map(len, t[i:e])) >= min_words] for d, t in texts.items()}
    low = {}
    for d in sorted(runs):
        for _, _, key in runs[d]:
            low.setdefault(key, d)
    out = {}
    for d, found in runs.items():
        seen, gone = set(), set()
        for i, e, key in found:
            if low[key] < d or key in seen:
                gone |= set(range(i, e))
            seen.add(key)
        out[d] = gone
    return out


def test_thousands_of_equal_rows_and_null_ids(make_docs):
    """Rows of one id and text, and of no id, give their spans once a task: the work does not grow with their square."""
    rng = np.random.default_rng(17)
    text = " ".join(sentences(rng, 120))
    rows = [(None, text)] * 3000 + [(5, text)] + [(6, text)] * 1500 + [(7, " ".join(sentences(rng, 4)))]
    got = span_dedup.dedup_spans(make_docs(rows)).groupBy("doc_id", "n_removed", "kept").count().collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 4 and by[None]["count"] == 3000 and by[None]["kept"] == text and by[6]["count"] == 1500
    assert by[5]["kept"] == by[6]["kept"] == "" and by[7]["n_removed"] == 0


def test_spans_cover_what_all_runs_cover(make_docs):
    rng = np.random.default_rng(16)
    pool = [" ".join(words(rng, int(rng.choice([1, 2, 3, 5, 8, 13])), 10**6)) + "." for _ in range(25)]
    rows = [(0, [pool[5], pool[6]])]
    for d in range(1, 80):
        a = int(rng.integers(len(pool) - 6))
        rows.append((d, sentences(rng, 2) + pool[a:a + int(rng.integers(2, 7))] + sentences(rng, int(rng.integers(3)))))
    rows += [(90, pool), (91, pool[:12] + pool[3:12])]
    tail = [" ".join(words(rng, n, 10**6)) + "." for n in (13, 5, 5, 2)]
    rows += [(95, tail), (96, tail)]
    want = brute_spans(rows)
    got = {r["doc_id"]: r for r in span_dedup.dedup_spans(make_docs([(d, " ".join(t)) for d, t in rows])).collect()}
    for d, t in rows:
        assert got[d]["kept"].split() == " ".join(x for i, x in enumerate(t) if i not in want[d]).split()
    assert got[96]["kept"] == "" and sum(map(len, want.values())) > 100


# ------------------------------------------------------------------- url rules
def brute_url(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(UP), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules
            if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


def test_url_rules_match_brute_force(spark):
    rng = np.random.default_rng(3)
    hosts = ["example.org", "a.example.org", "b.a.example.org", "org", "com", "x.com", "EXAMPLE.org", "notexample.org", "example.org.com", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x", "/fr/#/de/", "/de/a", "//es/", "/en/2"]
    urls = [f"http{'s' * int(rng.integers(2))}://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "a://b://c/d", "x://h\n.org/\nq"]
    rules = [*URL_RULES, ("allow", "a.example.org", "/es/"), ("block", "b.a.example.org", ""), ("allow", "x.com", "/de/a"), ("block", "x.com", "/de/a"),
             ("allow", "", "/")]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls * 2)] + [(None, urls[0])], "page_id long, url string").repartition(3)
    for use in (URL_RULES, rules, []):
        want = sorted(((k, *brute_url(u, use)) for k, u in [*enumerate(urls * 2), (None, urls[0])]), key=str)
        assert sorted(map(tuple, url_rules.filter_urls(pages, use).collect()), key=str) == want
        old, url_rules.RULES_AT_ONCE = url_rules.RULES_AT_ONCE, 2
        try:
            assert sorted(map(tuple, url_rules.filter_urls(pages, use).collect()), key=str) == want
        finally:
            url_rules.RULES_AT_ONCE = old


# ------------------------------------------------------------------ long texts
def test_texts_of_several_megabytes(spark, make_docs):
    """One text of 20 MB is hashed block by block; texts of 3 MB go through the joins whole."""
    import tracemalloc

    from searchrank.llm import textnum

    tracemalloc.start()
    w = textnum.words_of([b"word and more "] * 1 + [b"word and more " * 1_430_000], textnum.SPACES)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6 and len(np.unique(w.hashes)) == 3
    rng = np.random.default_rng(31)
    base = words(rng, 450_000, 10**6)
    other = list(base)
    other[200_000] = "changed"
    item = " ".join(words(rng, 20))
    rows = [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(words(rng, 50)) + " " + item)]
    assert len(rows[0][1]) > 3_000_000
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(make_docs(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    spans = {r["doc_id"]: r for r in span_dedup.dedup_spans(make_docs(rows)).collect()}
    assert spans[1]["n_removed"] == 0 and spans[2]["n_removed_words"] > 449_900 and spans[3]["n_removed"] == 0
    bench = spark.createDataFrame([(7, item), (8, " ".join(base[449_900:449_920]))], "item_id long, text string")
    hits = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontam.decontaminate(make_docs(rows), bench).collect()}
    assert hits == {1: (20, ["8"]), 2: (20, ["8"]), 3: (20, ["7"])}


# ------------------------------------------------------------ memory of Python tasks
def test_texts_enter_and_leave_python_in_small_batches(spark):
    """40 MB of texts in one partition: the batches that a task holds are a few MB, and what it has freed goes back."""
    def held(batch):
        yield batch.num_rows, batch.get_total_buffer_size(), pa.default_memory_pool().backend_name

    texts = spark.range(0, 8000, 1, 1).select("id", F.repeat(F.lit("x"), 5000).alias("text"))
    got = common.row_map(texts, held, "n long, size long, pool string").collect()
    assert sum(r["n"] for r in got) == 8000
    assert max(r["size"] for r in got) < 5e6 and {r["pool"] for r in got} == {"system"}
    # small rows of 16 bytes, as the n-gram join sends them
    out = list(common.batched(((k, True) for k in range(300_000)), pa.schema([("t", pa.int64()), ("small", pa.bool_())]), lambda r: 16))
    assert sum(b.num_rows for b in out) == 300_000 and max(b.num_rows for b in out) < 70_000


def test_a_smaller_batch_size_of_the_session_stays(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "1m")
        common.ship(spark)
        assert spark.conf.get(key) == "1m"
        spark.conf.set(key, "64m")
        common.ship(spark)
        assert spark.conf.get(key) == str(common.IN_BYTES)
    finally:
        spark.conf.set(key, old)
