"""One query for each operator over its whole table, the pipeline, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, exact_dedup, html_text, importance, language_id, mixing, near_dedup, quality, sharding, spelling, toxicity, url_filter
from .common import shared_path, table

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table arrives in twelve parts of unequal size; the rows are read back from the compacted store."""
    store = sharding.ShardStore(spark, shared_path(spark, "shards"))
    rows = sharding.store_dealt(store, table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), 0.98)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_sharding, op2_url_filter, op3_html_text, op4_language_id, op5_mixing, op6_embedding_dedup, op7_quality, op8_near_dedup, op9_bpe, op10_exact_dedup, op11_importance, op12_spelling, op13_toxicity, pipeline)
    return {query.__name__: query for query in found}


_HOST = "CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1) ELSE '' END"
_PATH = "CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 in SQL: the table of a byte, then ``hashed(f, crc)`` of a table ``keys(f)``, byte by byte.
_CRC_TABLE = """
step(k, v, i) AS (SELECT range::UBIGINT, range::UBIGINT, 0 FROM range(256) UNION ALL SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, i + 1 FROM step WHERE i < 8),
crcs AS (SELECT list(v ORDER BY k) AS tab FROM step WHERE i = 8)"""
_HASHED = """
hashed AS (SELECT f, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, (len(hx) / 2)::BIGINT), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::UBIGINT)),
  lambda c, b: xor(c >> 8, tab[((xor(c, b) & 255) + 1)::BIGINT]))) AS crc FROM (SELECT DISTINCT f, hex(encode(f)) AS hx FROM keys), crcs)"""

ORACLES = {
    "op11_importance": f"""
WITH RECURSIVE {_CRC_TABLE},
texts AS (SELECT 0 AS side, doc_id AS id, {_LOWER} AS t FROM documents UNION ALL SELECT 1, item_id, {_LOWER} FROM benchmark),
words AS (SELECT side, id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM texts),
feats AS (SELECT side, id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM words),
keys AS (SELECT DISTINCT f FROM feats), {_HASHED},
placed AS (SELECT side, id, crc % 10000 AS bucket FROM feats JOIN hashed USING (f)),
sums AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM placed GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM sums),
weighed AS (SELECT id, count(*) AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM placed JOIN gain USING (bucket) WHERE side = 0 GROUP BY 1),
scored AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296.0))))::BIGINT AS score FROM documents LEFT JOIN weighed ON id = doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 39)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)""",
    "op12_spelling": f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]{{7,}}')) AS run FROM documents),
keys AS (SELECT DISTINCT doc_id || ':' || run AS f FROM runs), {_HASHED},
words AS (SELECT w AS word, count(*) AS n FROM (SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, (crc % length(run))::BIGINT) || substr(run, (crc % length(run))::BIGINT + 2) ELSE run END AS w
  FROM runs JOIN hashed ON f = doc_id || ':' || run) WHERE length(w) >= 7 GROUP BY 1 HAVING count(*) >= 2),
less AS (SELECT DISTINCT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON l.cut = w.word UNION SELECT w.word, l.word FROM less l JOIN words w ON l.cut = w.word),
near AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS best, max(n) AS best_n FROM pairs JOIN words ON b = word GROUP BY 1),
forms AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM words LEFT JOIN near USING (word)),
walk(word, root, form) AS (SELECT word, word, form FROM forms UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN forms f ON w.form = f.word)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w ON w.word = f.word AND w.form IS NULL""",
    "op1_sharding": "SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
    "op2_url_filter": f"""
WITH rules(rhost, rpath, verdict) AS (VALUES {", ".join(repr(rule) for rule in RULES)}),
p AS (SELECT page_id, url, row_number() OVER () AS rn,
  coalesce(translate({_HOST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce({_PATH}, '') AS path FROM pages),
m AS (SELECT rn, rhost || rpath AS rule, verdict,
  row_number() OVER (PARTITION BY rn ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.rn = m.rn AND m.k = 1""",
    "op10_exact_dedup": """
WITH g AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM documents JOIN g ON coalesce(text, '') = t""",
}
