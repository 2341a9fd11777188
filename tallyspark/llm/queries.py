"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import byte_bpe, centroids, exact_dedup, html_extraction, language_id, mixing, nearest, pii, prefix_trie, quality_classifier, quality_rules, simhash, url_filter

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

URL_RULES = (
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
)

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir), shingle=3)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_of(_documents(spark, sf_dir))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).drop("copies")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_documents(spark, sf_dir))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_documents(spark, sf_dir))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Query] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_url_filter": op3_url_filter,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_mix_sources": op6_mix_sources,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_quality_rules": op8_quality_rules,
    "op9_html_extraction": op9_html_extraction,
    "op10_personal_data": op10_personal_data,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}

#: DuckDB SQL for the queries that SQL can express; a word is as in common.WORD.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4_SQL = """
WITH hashed AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
  grouped AS (SELECT h, max(doc_id) AS keep_id, count(*) AS n FROM hashed GROUP BY h)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM hashed JOIN grouped USING (h)
"""

OP6_SQL = f"""
WITH sized AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
  per AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(3 * sum(size) AS DOUBLE) AS cap,
      ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
    FROM sized GROUP BY source),
  levels AS (
    SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM per WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  final AS (SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1),
  targets AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM final) * weight), cap) AS target FROM per),
  placed AS (
    SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
      coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY substr(md5('mix:' || doc_id), 1, 8), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, floor(target + 0.5) - epochs * source_size - earlier)) AS BIGINT) AS taken
FROM placed
"""


def _op8_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in quality_rules.STOP_WORDS.values() for w in ws.split()}))
    kept = " AND ".join(f"(n_words < {r.from_words} OR " + " AND ".join([f"{r.measure} >= {r.least}"] * (r.least is not None) + [f"{r.measure} <= {r.most}"] * (r.most is not None)) + ")" for r in quality_rules.RULES)
    return rf"""
WITH split AS (
    SELECT doc_id, row_number() OVER () AS id, coalesce(text, '') AS t, {_WORDS} AS w,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM documents),
  counted AS (
    SELECT doc_id, id, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
      len(list_filter(ls, lambda x: length(x) < 10)) AS n_short, len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop
    FROM split),
  grams AS (SELECT id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM split)),
  again AS (SELECT id, i FROM grams QUALIFY count(*) OVER (PARTITION BY id, g) > 1),
  spans AS (SELECT id, least(5, coalesce(lead(i) OVER (PARTITION BY id ORDER BY i) - i, 5)) AS n FROM again),
  repeats AS (SELECT id, CAST(sum(n) AS BIGINT) AS n FROM spans GROUP BY id),
  judged AS (
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n, 0) AS n_repeat_words, word_chars / greatest(n_words, 1) AS mean_word_chars,
      n_symbols / greatest(word_chars, 1) AS symbol_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_short / greatest(n_lines, 1) AS short_line_ratio, n_stop / greatest(n_words, 1) AS stop_word_ratio
    FROM counted LEFT JOIN repeats USING (id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {kept} AS kept
FROM judged
"""

def _op11_sql(clusters: int = 16, rounds: int = 3) -> str:
    """Each round compares every vector with every centroid."""
    nearest = """
  a{k} AS (
    SELECT id, arg_min(cluster, struct_pack(d, cluster)) AS cluster, min(d) AS d FROM (
      SELECT q.id, c.cluster, list_sum(list_transform(range(1, 65), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i]))) AS d FROM q, c{k} AS c)
    GROUP BY id)"""
    moves = """
  s{k} AS (SELECT cluster, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS x FROM a{j} JOIN q USING (id), range(1, 65) AS r(i) GROUP BY cluster, i),
  c{k} AS (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{j} AS c LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS v FROM s{k} GROUP BY cluster) AS m USING (cluster))"""
    steps = [nearest.format(k=0)] + [part for k in range(1, rounds + 1) for part in (moves.format(k=k, j=k - 1), nearest.format(k=k))]
    return f"""
WITH q AS (
    SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
  c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, v FROM q ORDER BY cluster LIMIT {clusters}),{",".join(steps)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN q USING (id) JOIN c{rounds} USING (cluster)
"""


#: Nodes are whole prefixes here, as lists of MD5 sums, and subtrees are asked through the prefixes of each node.
OP12_SQL = """
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS m,
      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
    FROM conversations WHERE conv_id IS NOT NULL),
  bits AS (SELECT n, list_reduce([n, 1, 2, 3, 4, 5, 6, 7, 8], lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS t FROM (SELECT CAST(range AS BIGINT) AS n FROM range(256))),
  crc_table AS (SELECT list(t ORDER BY n) AS t FROM bits),
  convs AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base,
      xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a // 256, crc_table.t[CAST(xor(a & 255, b) + 1 AS BIGINT)])), 4294967295) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
  parts AS (
    SELECT c.conv_id, 0 AS own, pos, m, w FROM convs AS c JOIN turns AS t ON t.conv_id = c.base AND pos <= h
    UNION ALL SELECT c.conv_id, 1, pos, m, w FROM convs AS c JOIN turns AS t ON t.conv_id = c.conv_id AND pos > h),
  path AS (SELECT conv_id, list(m ORDER BY own, pos) AS ms, list(w ORDER BY own, pos) AS ws FROM parts GROUP BY conv_id),
  whole AS (SELECT conv_id, coalesce(ms, []) AS ms, coalesce(ws, []) AS ws FROM convs LEFT JOIN path USING (conv_id)),
  seen AS (SELECT conv_id, unnest(range(0, len(ms) + 1)) AS depth, ms, ws FROM whole),
  occ AS (SELECT conv_id, depth, md5(array_to_string(ms[1:depth], '')) AS node, md5(array_to_string(ms[1:depth - 1], '')) AS above, depth = len(ms) AS ends, coalesce(ws[depth], 0) AS w FROM seen),
  node AS (
    SELECT node, depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
      coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends FROM occ GROUP BY node, depth),
  kids AS (SELECT above, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
  full_node AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM node AS n LEFT JOIN kids AS k ON k.above = n.node AND k.depth = n.depth),
  under AS (
    SELECT o.node, o.depth, sum((n.n_children = 0)::INT) AS n_leaves, sum((n.n_convs - 1) * n.w) AS saved_tokens
    FROM full_node AS n JOIN occ AS o ON o.conv_id = n.conv_id AND o.depth <= n.depth GROUP BY ALL)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(n.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_node AS n JOIN under AS u ON u.node = n.node AND u.depth = n.depth LEFT JOIN node AS p ON n.depth > 0 AND p.node = n.above AND p.depth = n.depth - 1
"""


ORACLES: dict[str, str] = {"op4_exact_dedup": OP4_SQL, "op6_mix_sources": OP6_SQL, "op8_quality_rules": _op8_sql(), "op11_centroid_clusters": _op11_sql(), "op12_prefix_trie": OP12_SQL}
