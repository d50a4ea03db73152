"""Registered queries of the training-data operators, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shared_path
from . import (bpe, common, decontam, hard_negatives, importance, kn_quality, line_dedup, ngram_join, secret_scan, simhash,
               span_dedup, spelling, token_files, url_rules)

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def vocabulary() -> str:
    """Path of the public vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


LOWER_SQL = f"translate({{}}, '{common.UPPER}', '{common.LOWER}')"


@register("op1_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(common.read_table(spark, sf_dir, "documents"), vocabulary())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register("op2_ngram_join", rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 2, 1) END + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM o JOIN n na ON x = na.doc_id JOIN n nb ON y = nb.doc_id WHERE 100 * o >= 90 * (na.n + nb.n - o)),
sym AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(x, y) AS (SELECT x, y FROM sym UNION SELECT r.x, s.y FROM reach r JOIN sym s ON r.y = s.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.y, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN low ON d.doc_id = low.x
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.jaccard_components(common.read_table(spark, sf_dir, "documents"), n=3, percent=90)
    return out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


@register("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return importance.judge(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@register("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = secret_scan.scan(common.read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                           public_tokenizers.PATTERN)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
                      "spans", "n_random")


@register("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = shared_path(spark, "token_files")
    token_files.write_token_files(common.read_table(spark, sf_dir, "documents"), folder, vocabulary(), end_id=1)
    out = token_files.read_token_files(spark, folder)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


NON_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@register("op6_decontamination", f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '{NON_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '{NON_ALNUM}') AS w FROM benchmark),
bw AS (SELECT item_id, least(13, len(w)) AS k, unnest(range(1, greatest(len(w) - 12, least(1, len(w))) + 1)) AS i, w FROM b),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS t FROM bw),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, w, unnest(range(1, greatest(len(w) - k + 1, 0) + 1)) AS p FROM d, ks),
hit AS (SELECT dw.doc_id, dw.p, dw.k, win.item_id FROM dw JOIN win ON dw.k = win.k AND array_to_string(dw.w[dw.p:dw.p + dw.k - 1], ' ') = win.t),
pos AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
        FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    out = decontam.decontaminate(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
                      ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


@register("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs = common.read_table(spark, sf_dir, "documents")
    return kn_quality.classify(docs, common.read_table(spark, sf_dir, "labels")).select(
        "doc_id", "lang", F.round("perplexity", 4).alias("perplexity"), F.round("threshold", 4).alias("threshold"), "kept")


@register("op9_span_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    out = span_dedup.dedup_spans(common.read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", "n_shared", "n_removed", "n_removed_words", "first_docs",
                      F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


# Rules of the url contract.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

@register("op7_line_dedup", f"""
WITH lines AS (
  SELECT doc_id, i, lines[i] AS line, {LOWER_SQL.format("trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
shared AS (SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.doc_id, l.i, l.line, (s.key IS NOT NULL AND l.doc_id <> s.last) AS gone
           FROM lines l LEFT JOIN shared s ON l.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    out = line_dedup.dedup_lines(common.read_table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@register("op10_url_rules", f"""
WITH r(verdict, host, path) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)}),
p AS (SELECT page_id,
        {LOWER_SQL.format("coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '')")} AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
m AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
        row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(common.read_table(spark, sf_dir, "pages"), URL_RULES)


@register("op11_simhash")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return simhash.near_duplicates(common.read_table(spark, sf_dir, "documents"), width=4, radius=4)


_LETTERS = "[A-Za-z\u00C0-\u00FF]+"
# crc32 from its defining polynomial: the remainders of the 256 bytes by eight shifts, then one table step per byte
@register("op12_spelling_variants", f"""
WITH RECURSIVE crc(b, k, r) AS (
  SELECT i, 0, i FROM range(256) AS t(i) UNION ALL
  SELECT b, k + 1, CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END FROM crc WHERE k < 8),
tab AS (SELECT list(r ORDER BY b) AS t FROM crc WHERE k = 8),
runs AS (SELECT doc_id, r, count(*) AS n
         FROM (SELECT doc_id, {LOWER_SQL.format(f"unnest(regexp_extract_all(text, '{_LETTERS}'))")} AS r FROM documents)
         WHERE length(r) >= 7 GROUP BY doc_id, r),
bytes AS (SELECT doc_id, r, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r, ''),
                 lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS bs FROM runs),
h AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(bs, lambda x: x::BIGINT)),
                 lambda c, x: xor(c >> 8, tab.t[1 + xor(c & 255, x)])), 4294967295::BIGINT) AS h FROM bytes, tab),
made AS (SELECT CASE WHEN h % 31 = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
del AS (SELECT word, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT DISTINCT * FROM (
  SELECT d.word AS a, v.word AS b FROM del d JOIN v ON d.rest = v.word UNION ALL
  SELECT v.word, d.word FROM del d JOIN v ON d.rest = v.word UNION ALL
  SELECT x.word, y.word FROM del x JOIN del y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word)),
ranked AS (SELECT near.a AS word, v.word AS form, v.n AS form_n, count(*) OVER (PARTITION BY near.a) AS n_near,
                  row_number() OVER (PARTITION BY near.a ORDER BY v.n DESC, v.word) AS k FROM near JOIN v ON near.b = v.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * v.n THEN form END AS form,
             CASE WHEN form_n >= 10 * v.n THEN form_n END AS form_n FROM v LEFT JOIN ranked ON v.word = ranked.word AND k = 1),
walk(word, root) AS (SELECT word, word FROM f UNION ALL SELECT w.word, f.form FROM walk w JOIN f ON w.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, w.root FROM f JOIN walk w ON f.word = w.word JOIN f AS e ON w.root = e.word AND e.form IS NULL
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spelling.group_variants(common.read_table(spark, sf_dir, "documents"), min_chars=7, min_count=2, ratio=10, change=spelling.drop_by_crc)


@register("op13_hard_negatives", """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score,
       s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) QUALIFY row_number() OVER w <= 3
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hard_negatives.mine_hard_negatives(common.read_table(spark, sf_dir, "embeddings"), is_anchor=F.col("vec_id") % 50 == 0, label=relabelled)
    return out.drop("positive_rank")
