"""Quality rules, secret scan, Kneser-Ney classifier and the pipeline."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import make_docs, words  # noqa: F401
from searchrank.llm import importance, kn_quality, secret_scan, textnum, trusted

GOOD = ["ba", "lo", "mi", "ren", "tas", "vo", "kel", "dur"]


def prose(rng, n):
    out = []
    for k in range(n):
        w = "".join(rng.choice(GOOD, int(rng.integers(1, 4))))
        out.append(w.capitalize() + "." if rng.random() < 0.1 else w)
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(11)
    rows = [(k, prose(rng, int(rng.integers(60, 200))), "en" if k % 2 else "xx") for k in range(400)]
    junk = [(400 + k, " ".join(x.upper() + "!!#" for x in prose(rng, 90).split()), "en") for k in range(60)]
    odd = [(None, None, None), (900, "", "en"), (901, "  \n ", None), (902, prose(rng, 80), "new"), (902, prose(rng, 80), "new"),
           (None, prose(rng, 80), None), (903, "### $$$ !!!", "en")]
    docs = spark.createDataFrame(rows + junk + odd, "doc_id long, text string, lang string").repartition(4).cache()
    labels = [(k, 1, 0) for k in range(0, 300)] + [(k, 0, 0) for k in range(400, 430)] + [(5, 1, 1), (6, None, None), (None, 1, 0)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_rules(corpus, spark):
    docs, labels = corpus
    got = importance.judge(docs, labels).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    assert len(got) == docs.count()
    for r in got:
        wants = []
        for t in texts[r["doc_id"]]:
            w = re.findall("[^\x20\x09-\x0d]+", t)
            c = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
            rep = {k + i for k in range(len(w) - 2) if c[tuple(w[k:k + 3])] > 1 for i in range(3)}
            lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            wants.append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) in wants
    good = [r for r in got if r["doc_id"] is not None and 300 <= r["doc_id"] < 400]
    bad = [r for r in got if r["doc_id"] is not None and 400 <= r["doc_id"] < 460]
    assert sum(r["kept"] for r in good) >= 98 and not any(r["kept"] for r in bad)
    empty = labels.where("false")
    assert all(r["kept"] == (not r["base_failed"]) for r in importance.judge(docs, empty).collect())
    assert importance.judge(docs.where("false"), labels).count() == 0


def test_repeat_words_and_lines():
    text = b"a b c d a b c\n\n x \nx\n x \n\t"
    w = textnum.words_of([text], textnum.SPACES, lower=False)
    assert importance.base_figures(w, 0, text) == (10, 10, 0, 1, 6)


def test_words_do_not_depend_on_neighbours():
    texts = ["alpha beta".encode(), b"", "été alpha".encode(), b" beta\tALPHA "]
    w = textnum.words_of(texts, textnum.SPACES)
    each = [textnum.words_of([t], textnum.SPACES).hashes.tolist() for t in texts]
    assert [w.hashes[w.first[j]:w.first[j + 1]].tolist() for j in range(4)] == each
    assert each[0][0] == each[2][1] == each[3][1] and len(set(sum(each, []))) == 3


# --------------------------------------------------------------------- secrets
@pytest.fixture(scope="module")
def efficiency():
    import public_tokenizers as P

    return secret_scan.TokenEfficiency("t", open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)


RANDOM = ["xK9vQ2mZ7pL4wR8tY1nB", "q8Zr2Vt7Xw1Ks9Lp4Mb6Nc3", "dGhJ83kslP0qwZxN5vRt"]


def test_random_strings_are_found(efficiency):
    for s in RANDOM:
        text = f"the key is {s}, keep it"
        assert secret_scan.random_spans(text, [], efficiency, 2.2) == [(11, 3, 11 + len(s))]


@pytest.mark.parametrize("text", [
    "d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "2024-01-02/10-20-30-400", "internationalization2024",
    "https://example.org/a8Zr2Vt7Xw1Ks9Lp4Mb6N", "me.xK9vQ2mZ7pL4wR8tY1nB@example.org", "anthropomorphically", "chapter1-introduction-overview",
])
def test_known_forms_are_left_alone(efficiency, text):
    assert secret_scan.random_spans(f"see {text} now", [], efficiency, 2.2) == []


LETTERS = ["qZxVtKpLwRbYnGmHsDfJ", "xkqvzjwpthgbnmrdfslc", "QXKZVJWPBHTGNMRDFSLC"]


@pytest.mark.parametrize("key", RANDOM + LETTERS)
def test_random_strings_in_their_surroundings(efficiency, key):
    for text in ("see {} now", "https://h.org/p?key={}&x=1", "postgres://user:{}@db.example.org/main", "/srv/data/{}", "user:{}@host.org",
                 "my-long-readable-introduction-{}", '"https://h.org/p","k":"{}"', "a.{}.b", "internationalization_{}/chapter"):
        at = text.index("{}")
        spans = secret_scan.random_spans(text.format(key), [], efficiency, 2.2)
        assert any(a <= at and at + len(key) <= b for a, _, b in spans), text


def test_all_segments_of_a_web_token(efficiency):
    parts = ["eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9", "eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkpvaG4ifQ", "SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV"]
    assert [(b - a) for a, _, b in secret_scan.random_spans(".".join(parts), [], efficiency, 2.2)] == [len(x) for x in parts]


@pytest.mark.parametrize("text", ["getElementsByTagNameAndClass", "Geschwindigkeitsbegrenzung", "INTERNATIONALIZATION", "and-so-on-and-so-forth-again",
                                  "mailto:me.xK9vQ2mZ7pL4wR8tY1nB@example.org", "responsabilidades"])
def test_words_without_digits_are_left_alone(efficiency, text):
    assert secret_scan.random_spans(f"see {text} now", [], efficiency, 2.2) == []


def test_scan_rows(make_docs):
    import public_tokenizers as P

    hexes = "0123456789abcdef" * 3
    rows = [(1, f"é password = 'abcdefgh' {hexes} AKIA0123456789AB AKIA0"), (2, None), (2, ""), (None, f"Token:\"{RANDOM[0]}\""),
            (3, f"token: api_key: abcdefghijk {RANDOM[1]}")]
    got = {(r["doc_id"], r["spans"]): r for r in secret_scan.scan(make_docs(rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    one = next(r for r in got.values() if r["doc_id"] == 1)
    assert one["base"] == "assign:2:22,hex:24:72,access:73:89" and (one["n_assign"], one["n_access"], one["n_hex"]) == (1, 1, 1)
    assert (2, "") in got and next(r for r in got.values() if r["doc_id"] is None)["n_assign"] == 1
    three = next(r for r in got.values() if r["doc_id"] == 3)
    assert three["n_assign"] == 0 and three["spans"] == "random:28:51" and three["base"] == ""
    assert secret_scan.scan(make_docs([]), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def brute_base(text):
    """The base patterns read character by character."""
    def run(i, allowed):
        j = i
        while j < len(text) and text[j] in allowed:
            j += 1
        return j
    digits, upper = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    letters = upper + upper.lower()
    lowered = text.translate(str.maketrans(upper, upper.lower()))
    found = []
    i = 0
    while i < len(text):
        for key in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if not lowered.startswith(key, i):
                continue
            j = i + len(key)
            j = run(j + (text[j:j + 1] in ("'", '"') and j < len(text)), " ")
            if j >= len(text) or text[j] not in ":=":
                continue
            j = run(j + 1, " ")
            j += j < len(text) and text[j] in "'\""
            end = run(j, letters + digits + "+/_.=-")
            if end > j:
                if end - j >= 8:
                    found.append((i, 0, end))
                i = end - 1
                break
        i += 1
    for kind, head, allowed, least in ((1, "AKIA", upper + digits, 16), (2, "", digits + "abcdef", 32)):
        i = 0
        while i < len(text):
            end = run(i + len(head), allowed) if text.startswith(head, i) else i
            if end > i + len(head):
                if end - i >= least:
                    found.append((i, kind, end))
                i = end
            else:
                i += 1
    return sorted(found)


def test_base_spans_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    parts = ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "'", '"', " ", ":", "=", "abcdefgh", "x", "AKIA", "AKIA0123456789AB", "0123456789abcdef" * 2,
             "dead", "-", "\n", "é", "K", "ſecret", "to\u212Aen", "..", "+/_"]
    made = ["".join(rng.choice(parts, int(rng.integers(1, 30)))) for _ in range(3000)]
    texts = made + [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sum(bool(brute_base(t)) for t in made) > 500
    for t in texts:
        assert secret_scan.base_spans(t) == brute_base(t), t


def test_addresses_of_any_length(efficiency):
    key = RANDOM[0]
    for gap in (3, 300, 5000):
        path = "ab/" * gap
        assert secret_scan.random_spans(f"https://h.org/{path}{key} x", [], efficiency, 2.2) == []
        assert len(secret_scan.random_spans(f"https://h.org/{path}?k={key} x", [], efficiency, 2.2)) == 1
        assert len(secret_scan.random_spans(f"postgres://u:{key}{'.b' * gap}@h.org/x", [], efficiency, 2.2)) == 1
        assert secret_scan.random_spans(f"see {key}{'.b' * gap}@h.org now", [], efficiency, 2.2) == []
    many = " ".join(f"{k} secret = {key}{k}" for k in range(20_000))
    base = secret_scan.base_spans(many)
    assert len(base) == 20_000 and secret_scan.random_spans(many, base, efficiency, 2.2) == []


# ------------------------------------------------------------------ Kneser-Ney
def brute_kneser_ney(texts, order):
    """Nested dictionaries of the same model over small symbols."""
    counts = Counter()
    for t in texts:
        s = [32] * (order - 1) + kn_quality.symbols(t.encode()).tolist()
        counts.update(tuple(s[i:i + order]) for i in range(len(s) - order + 1))
    levels = []
    for _ in range(order):
        d = kn_quality.discounts(Counter(c for c in counts.values() if c <= 4))
        levels.append((counts, d))
        counts = Counter(g[1:] for g in counts)
    levels.reverse()

    def p(g):
        c, d = levels[len(g) - 1]
        low = p(g[1:]) if len(g) > 1 else 1.0 / (1 << kn_quality.BITS)
        ctx = [n for h, n in c.items() if h[:-1] == g[:-1]]
        if not ctx:
            return low
        off = [d[min(n, 3) - 1] for n in ctx]
        own = c.get(g, 0)
        return max(own - (d[min(own, 3) - 1] if own else 0), 0) / sum(ctx) + sum(off) / sum(ctx) * low
    return p


def test_model_matches_brute_force_and_sums_to_one(spark, make_docs):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abc d"), 60)) for _ in range(4)] + ["abcabcabc", "é1２ Z"]
    model = kn_quality.KneserNey(kn_quality.gram_counts(make_docs(list(enumerate(texts))), None, "doc_id", "text"))
    p = brute_kneser_ney(texts, kn_quality.ORDER)
    probe = texts[:2] + ["zzz abc", "abd\U0001f600"]
    grams = kn_quality.gram_counts(make_docs(list(enumerate(probe))), None, "doc_id", "text")
    got = model.log_probability(grams).collect()
    assert len(got) > 50
    for r in got:
        g = tuple((r["g"] >> (kn_quality.BITS * k)) & 4095 for k in range(kn_quality.ORDER - 1, -1, -1))
        assert math.isclose(r["lp"], math.log2(p(g)), rel_tol=1e-4, abs_tol=1e-4)
    context = tuple(kn_quality.symbols(b"abca").tolist())
    seen = {s for t in texts for s in kn_quality.symbols(t.encode()).tolist()} | {32}
    rest = (1 << kn_quality.BITS) - len(seen)
    unseen = p(context + (4000,))
    assert math.isclose(sum(p(context + (s,)) for s in seen) + rest * unseen, 1.0, rel_tol=1e-6)


def test_ngrams_of_a_slice_are_those_of_each_text():
    texts = [b"hello", b"", "é wörld".encode(), b"x"]
    code, first = kn_quality.ngrams(texts)
    for j, t in enumerate(texts):
        assert code[first[j]:first[j + 1]].tolist() == kn_quality.ngrams([t])[0].tolist()


def test_classifier_keeps_prose_and_rejects_junk(corpus, monkeypatch):
    docs, labels = corpus
    got = kn_quality.classify(docs, labels).collect()
    assert len(got) == docs.distinct().count()
    good = [r for r in got if r["doc_id"] is not None and 300 <= r["doc_id"] < 400]
    bad = [r for r in got if r["doc_id"] is not None and 400 <= r["doc_id"] < 460]
    assert sum(r["kept"] for r in good) >= 98 and not any(r["kept"] for r in bad)
    assert not any(r["kept"] for r in got if r["doc_id"] in (900, 901, 903))
    assert all(r["kept"] for r in got if r["doc_id"] == 902)
    monkeypatch.setattr(kn_quality, "SHARD", 300)  # several shards
    again = kn_quality.classify(docs, labels).collect()
    key = lambda r: (str(r["doc_id"]), r["_h"])
    for a, b in zip(sorted(got, key=key), sorted(again, key=key)):
        assert a["kept"] == b["kept"] and (a["perplexity"] is None or math.isclose(a["perplexity"], b["perplexity"], rel_tol=1e-6))
    none = kn_quality.classify(docs, labels.where("false")).collect()
    assert all(r["kept"] for r in none if r["doc_id"] is not None and r["doc_id"] < 400)
    assert kn_quality.classify(docs.where("false"), labels).count() == 0


def test_threshold_is_the_shrunk_held_out_quantile(corpus):
    docs, labels = corpus
    got = kn_quality.classify(docs, labels)
    rows = got.join(kn_quality.trusted_ids(labels), got["doc_id"] == F.col("_tid"), "left_semi")
    held = [(r["lang"], r["steady"]) for r in rows.where(kn_quality.held_out("doc_id")).collect()]
    pool = np.quantile([round(v, 4) for _, v in held], 0.995)
    want = {}
    for lang in {r["lang"] for r in got.select("lang").distinct().collect()}:
        own = [round(v, 4) for x, v in held if x == lang]
        q = np.quantile(own, 0.995) if own else pool
        want[lang] = 1.02 * (q * len(own) + pool * kn_quality.SHRINK) / (len(own) + kn_quality.SHRINK)
    assert len(set(want.values())) >= 3  # two languages with trusted rows of their own, and the pool
    assert all(math.isclose(r["threshold"], want[r["lang"]], rel_tol=1e-9) for r in got.collect())


def test_repeated_rows_are_one_and_partitions_do_not_matter(corpus, spark):
    docs, labels = corpus
    many = docs.unionByName(docs.where("doc_id < 20").crossJoin(spark.range(60)).drop("id"))

    def result(parts):
        return sorted(map(tuple, kn_quality.classify(many.repartition(parts), labels).collect()), key=str)
    first = result(7)
    assert first == result(3) and len(first) == docs.distinct().count()


def test_rule_scores_do_not_depend_on_partitions(corpus):
    docs, labels = corpus

    def result(parts):
        return sorted(map(tuple, importance.judge(docs.repartition(parts), labels).collect()), key=str)
    assert result(2) == result(9)


# -------------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, scratch):
    cp = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(21)
    clean = [prose(rng, 120) for _ in range(150)]
    item = " ".join(words(rng, 30))
    boiler = "This very same notice stands under many a text."
    rows = [(k, t + ("\n" + boiler if k % 5 == 0 else "")) for k, t in enumerate(clean)]
    near = clean[3].split()
    near[50] = "changed"
    rows += [(200, " ".join(near)), (201, clean[7]), (None, clean[8]), (202, None), (203, "!!## " * 80), (203, "!!## " * 80),
             (204, clean[9][:200] + " " + prose(rng, 100) + " " + " ".join(prose(rng, 13).split()))]
    full = [(i, t, "en", "s", len(t or ""), 1, "x") for i, t in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, _h int, kept string")
    docs = docs.repartition(3)
    spark.createDataFrame([(k, 1, 0) for k in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{scratch}/labels.parquet")
    spark.createDataFrame([(1, item), (2, clean[11])], "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    stages = dict(cp.STAGES)
    assert len(stages) == 5

    def through(name, frame):
        out = stages[name](spark, frame, scratch)
        path = f"{scratch}/{name.replace(' ', '_')}"
        out.write.parquet(path)
        return spark.read.parquet(path)

    a = through("quality classifier", docs)
    assert a.columns == docs.columns
    left = [r["doc_id"] for r in a.collect()]
    assert 203 not in left and 202 not in left and sum(x is not None and x < 150 for x in left) >= 147 and None in left
    b = through("line dedup", a)
    assert b.columns == docs.columns and b.count() == a.count()
    assert b.where(b["text"].contains(boiler)).count() == 1 and b.where("n_chars <> length(text)").count() == 0
    c = through("n-gram Jaccard join", b)
    ids = [r["doc_id"] for r in c.collect()]
    assert 200 not in ids and 201 not in ids and None not in ids and 204 in ids and {3, 7, 8} <= set(ids)
    d = through("benchmark decontamination", c)
    assert d.columns == docs.columns and set(ids) - {r["doc_id"] for r in d.collect()} == {11}
    e = stages["BPE encoding and decoding"](spark, d, scratch)
    assert e.count() == d.count() and e.where("n_tokens = 0").count() == 0
    empty = docs.where("false")
    for name, stage in cp.STAGES:
        assert stage(spark, empty, scratch).count() == 0
    hurt = spark.createDataFrame([(None, None, None, None, None, None, None)] * 2 + [(1, "", None, None, None, None, None)], docs.schema)
    assert stages["n-gram Jaccard join"](spark, hurt, scratch).count() == 3
    assert stages["line dedup"](spark, hurt, scratch).count() == 3


def test_models_are_fitted_on_every_trusted_row(corpus, monkeypatch):
    docs, labels = corpus
    by_kind = {}
    for rows in (trusted.TRUSTED_ROWS, 5):  # ids broadcast, ids joined
        monkeypatch.setattr(trusted, "TRUSTED_ROWS", rows)
        by_kind[rows] = [sorted(map(tuple, found.collect())) for found in (
            kn_quality.gram_counts(docs, labels, "doc_id", "text"), importance.counts(docs, labels, "doc_id", "text"))]
    first, second = by_kind.values()
    assert first == second
    ids = {r["_tid"] for r in trusted.trusted_ids(labels).where(~trusted.held_out("_tid")).collect()}
    texts = [r["text"].encode() for r in docs.collect() if r["doc_id"] in ids and r["text"]]
    assert len(ids) > 5 and sum(c for _, c, _ in first[0]) == len(kn_quality.ngrams(texts)[0])
