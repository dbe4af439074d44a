"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm import context_tree, fill_middle, fm_index, jaccard, packing, preferences, quality, resampling, secret_scan, token_files, tokenize, top_k, toxicity

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(_table(spark, sf_dir, "documents")))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=0)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=1))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.format_pairs(preferences.last_reply_pairs(_table(spark, sf_dir, "conversations")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.apply_rules(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.digest(fm_index.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_texts(_table(spark, sf_dir, "documents"))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.rearrange(_table(spark, sf_dir, "documents")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_token_files": op2_token_files,
    "op3_packing": op3_packing,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_preferences": op5_preferences,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_counts": op8_token_counts,
    "op9_decontamination": op9_decontamination,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_exact_top_k": op11_exact_top_k,
    "op12_fill_middle": op12_fill_middle,
    "op13_resampling": op13_resampling,
}

ORACLE_SQL: dict[str, str] = {}

# Every 13-word window of a document against every window of an item, words numbered in the document.
ORACLE_SQL["op9_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM items),
grams AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, k, grams.n, item_id FROM grams JOIN items ON grams.n = items.n AND grams.g = items.g),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM found) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS joined FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN names ON d.doc_id = names.doc_id
"""

ORACLE_SQL["op5_preferences"] = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS i,
                  coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, count(*) AS n, max(CASE WHEN role = 'assistant' THEN i END) AS last FROM t GROUP BY conv_id),
reply AS (SELECT xor(c.conv_id, 1) AS conv_id, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i = c.last),
rejected AS (
  SELECT t.conv_id, i, role, text FROM t JOIN c ON t.conv_id = c.conv_id WHERE i < coalesce(last, n + 1)
  UNION ALL
  SELECT c.conv_id, coalesce(last, n + 1) AS i, reply.role, reply.text FROM c JOIN reply ON reply.conv_id = c.conv_id),
differ AS (SELECT coalesce(t.conv_id, r.conv_id) AS conv_id, min(coalesce(t.i, r.i)) AS first FROM t FULL JOIN rejected r ON t.conv_id = r.conv_id AND t.i = r.i
           WHERE t.i IS NULL OR r.i IS NULL OR t.role <> r.role OR t.text <> r.text GROUP BY 1),
common AS (SELECT c.conv_id, coalesce(first - 1, n) AS k FROM c LEFT JOIN differ ON differ.conv_id = c.conv_id),
sides AS (SELECT true AS is_chosen, * FROM t UNION ALL SELECT false, * FROM rejected),
pieces AS (SELECT is_chosen, s.conv_id, i, i <= k AS shared, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece
           FROM sides s JOIN common ON s.conv_id = common.conv_id),
placed AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY is_chosen, conv_id, shared ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM pieces),
joined AS (SELECT is_chosen, conv_id, shared, string_agg(piece, '' ORDER BY i) AS body,
                  string_agg(CASE WHEN role = 'assistant' THEN CAST(CAST(begun + length(role) + 5 AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(begun + length(piece) AS BIGINT) AS VARCHAR) END, ',' ORDER BY i) AS mask
           FROM placed GROUP BY is_chosen, conv_id, shared)
SELECT common.conv_id AS pair_id, CAST(k AS INTEGER) AS n_common, coalesce(p.body, '') AS prompt, coalesce(a.body, '') AS chosen, coalesce(r.body, '') AS rejected,
       coalesce(a.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM common
LEFT JOIN joined p ON p.conv_id = common.conv_id AND p.is_chosen AND p.shared
LEFT JOIN joined a ON a.conv_id = common.conv_id AND a.is_chosen AND NOT a.shared
LEFT JOIN joined r ON r.conv_id = common.conv_id AND NOT r.is_chosen AND NOT r.shared
"""

# Pairs of documents by their common shingles, then everything that is reachable by links.
ORACLE_SQL["op4_ngram_jaccard"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
s AS (SELECT g.doc_id, gram, n FROM g JOIN n ON g.doc_id = n.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) + any_value(b.n) AS total FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id
      WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2),
e AS (SELECT x, y FROM p WHERE 100 * c >= 90 * (total - c) UNION ALL SELECT y, x FROM p WHERE 100 * c >= 90 * (total - c)),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(y, d.doc_id)) AS BIGINT) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.x
"""

ORACLE_SQL["op11_exact_top_k"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE_SQL["op12_fill_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT *, CAST(length(text) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS g FROM d),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR g[3] % 100 >= 90 THEN 'plain' WHEN g[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
             least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b FROM n),
p AS (SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

# crc32 bit by bit: its table of 256 entries from the polynomial, then a fold over the bytes of each distinct feature.
ORACLE_SQL["op13_resampling"] = r"""
WITH RECURSIVE bits(k, c, step) AS (
  SELECT k, k, 0 FROM range(256) r(k) UNION ALL
  SELECT k, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY k) AS entries FROM bits WHERE step = 8),
texts AS (SELECT 'd' || row_number() OVER () AS row_id, doc_id, text FROM documents UNION ALL SELECT 'b' || row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS (SELECT row_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM w),
hexed AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM f)),
b AS (
  SELECT feature, xor(4294967295, list_reduce(list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
         lambda c, x: xor(entries[CAST(xor(c, x) & 255 AS BIGINT) + 1], c >> 8), CAST(4294967295 AS BIGINT))) % 10000 AS bucket FROM hexed, crc),
n AS (SELECT f.row_id, bucket, count(*) AS n FROM f JOIN b USING (feature) GROUP BY 1, 2),
totals AS (SELECT bucket, coalesce(sum(n) FILTER (row_id[1] = 'd'), 0) AS s, coalesce(sum(n) FILTER (row_id[1] = 'b'), 0) AS t FROM n GROUP BY 1),
st AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM totals),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain FROM totals, st),
weights AS (SELECT row_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM n JOIN g USING (bucket) GROUP BY 1),
d AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
         CASE WHEN n_features IS NULL THEN 0 ELSE (total - ((total % n_features + n_features) % n_features)) // n_features END AS weight,
         CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM w LEFT JOIN weights USING (row_id) WHERE row_id[1] = 'd'),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d),
ranked AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_words >= 20) OVER () AS eligible FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CAST(CASE WHEN place <= 25 * eligible // 100 THEN place END AS BIGINT) AS rank
FROM ranked
"""
