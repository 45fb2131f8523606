"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbside.llm import (
    decontaminate,
    extraction,
    fingerprints,
    katz,
    line_dedup,
    merkle,
    ngram_join,
    packing,
    quality,
    sharding,
    token_files,
    toxicity,
    trie,
)
from kerbside.llm.tokens import tokenizer_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "text", "n_lines", "n_removed")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(
        table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_line_dedup,
        op3_html_extraction,
        op4_benchmark_decontamination,
        op5_token_files,
        op6_quality_classifier,
        op7_document_fingerprints,
        op8_sharding,
        op9_best_fit_packing,
        op10_toxicity,
        op11_katz_backoff,
        op12_merkle_manifest,
        op13_conversation_trie,
    )
}

#: crc32 of a text of digits ``s``: one step for each byte, and eight shifts.
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
  string_split(s, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""


def _crc32(s: str) -> str:
    return _CRC32.replace("string_split(s,", f"string_split({s},")


ORACLES = {
    "op4_benchmark_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), starts AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT n FROM win)
  WHERE i + n - 1 <= len(w)
), hit AS (
  SELECT s.doc_id, s.i, s.n, win.item_id FROM starts s JOIN win ON s.n = win.n AND s.phrase = win.phrase
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op8_sharding": """
WITH r AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
    ((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) >> 2) << 30)
    + (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')),
       1, 8) AS BIGINT) >> 2) AS h
  FROM documents
), level AS (
  SELECT d, h >> CAST(60 - d AS INT) AS p, sum(n_bytes) AS bytes, min(h) AS lo, max(h) AS hi
  FROM r, range(0, 61) t(d) GROUP BY ALL
), fit AS (SELECT * FROM level WHERE bytes <= 67108864 OR lo = hi OR d = 60),
own AS (
  SELECT r.doc_id, r.n_bytes, fit.d, fit.p, fit.bytes,
    row_number() OVER (PARTITION BY r.doc_id, r.h ORDER BY fit.d) AS k
  FROM r JOIN fit ON r.h >> CAST(60 - fit.d AS INT) = fit.p
)
SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(p), CAST(d AS INT), '0') END AS shard,
  CAST(d AS INT) AS depth, CAST(bytes AS BIGINT) AS shard_bytes, bytes > 67108864 AS over_limit
FROM own WHERE k = 1
""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 AS hit,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small
  FROM documents
), leaves AS (
  SELECT doc_id, source, leaf, altered,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(CASE WHEN coalesce(hit, false) THEN strlen(small) || ':' || small
      ELSE strlen(text) || ':' || text END, '-')) AS altered FROM rows_)
), nodes AS (
  SELECT source, 0 AS level, idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT source, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY source, level, n, idx // 16
), subroots AS (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), top AS (
  SELECT 0 AS level, idx, n, h FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx))
  FROM top WHERE n > 1 GROUP BY level, n, idx // 16
), beside AS (
  SELECT a.source, a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level
    AND a.idx // 16 = b.idx // 16 GROUP BY ALL
), top_beside AS (
  SELECT a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM top a JOIN top b ON a.level = b.level AND a.idx // 16 = b.idx // 16 GROUP BY ALL
), walk AS (
  SELECT doc_id, source, leaf, 0 AS level, idx, n, altered AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT w.doc_id, w.source, w.leaf, w.level + 1, w.idx // 16, (w.n + 15) // 16, sha256(l || w.h || r),
    proof || l || r
  FROM walk w JOIN beside b ON w.source IS NOT DISTINCT FROM b.source AND w.level = b.level AND w.idx = b.idx
  WHERE w.n > 1
), up AS (
  SELECT w.doc_id, w.leaf, s.h AS subroot, 0 AS level, s.idx, s.n, w.h, w.proof
  FROM walk w JOIN subroots s ON w.source IS NOT DISTINCT FROM s.source WHERE w.n = 1
  UNION ALL
  SELECT u.doc_id, u.leaf, u.subroot, u.level + 1, u.idx // 16, (u.n + 15) // 16, sha256(l || u.h || r),
    proof || l || r
  FROM up u JOIN top_beside b ON u.level = b.level AND u.idx = b.idx WHERE u.n > 1
)
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256,
  h AS folded_root, h = (SELECT h FROM top WHERE n = 1) AS verified
FROM up WHERE n = 1
""",
    "op13_conversation_trie": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h,
    list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text))
    AS own
  FROM t GROUP BY conv_id
), r AS (
  SELECT c.conv_id, list_concat(coalesce(b.own[1 : c.h], []), c.own[c.h + 1 :]) AS s
  FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100
), nodes AS (
  SELECT d AS depth, s[1 : d] AS p, min(conv_id) AS conv_id, count(*) AS n_convs
  FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM r) GROUP BY ALL
), kids AS (
  SELECT depth - 1 AS depth, p[1 : depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), own AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children, (n_convs - 1) * coalesce(length(n.p[n.depth].text), 0) AS saved
  FROM nodes n LEFT JOIN kids k ON n.depth = k.depth AND n.p = k.p
), below AS (
  SELECT a.depth, a.p, sum(b.saved) AS saved, count(*) FILTER (b.n_children = 0) AS leaves
  FROM own a JOIN own b ON b.depth >= a.depth AND b.p[1 : a.depth] = a.p GROUP BY ALL
), ends AS (
  SELECT s AS p, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ids FROM r GROUP BY s
)
SELECT o.conv_id, o.depth, u.conv_id AS parent_conv_id, o.n_convs, o.n_children,
  CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens,
  coalesce(ids, sha256('')) AS ends_sha256
FROM own o JOIN below b ON o.depth = b.depth AND o.p = b.p
LEFT JOIN nodes u ON u.depth = o.depth - 1 AND u.p = o.p[1 : o.depth - 1]
LEFT JOIN ends e ON e.p = o.p
""",
}
