"""Registered queries of the corpus operators, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.llm import langid, lines, merkle, mixing, perplexity, records, shards, simhash, trie, urls, vptree, winnow, zonemaps
from quoteloom.llm.text import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@register("op1_simhash_dedup")
def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op2_binary_token_records")
def op2_binary_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(spark, table(spark, sf_dir, "documents"), records.default_tokenizer())


@register("op3_kd_tree_shards")
def op3_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard(table(spark, sf_dir, "documents"), 40)
    law, grown = F.lit("bytes"), F.lit(None).cast("int")
    return placed.select("doc_id", "size", "text_crc32", law.alias("law"), F.col("shard").cast("int").alias("shard"), "slot", grown.alias("grown_shard"))


@register(
    "op4_benchmark_decontamination",
    r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
iw AS (
  SELECT item_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM benchmark),
items AS (SELECT item_id, w, least(len(w), 10) AS m FROM iw WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM items) u),
spans AS (
  SELECT r, i, m, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM items) l WHERE len(w) >= m) u),
met AS (SELECT s.r, s.i, s.m, x.item_id FROM spans s JOIN windows x ON s.g = x.g AND s.m = x.m),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + m)) AS p FROM met) q GROUP BY r),
found AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM met WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
""",
)
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        winnow.digest("item_ids").alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@register("op5_url_templates")
def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")


@register("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.of_documents(table(spark, sf_dir, "documents"))


@register("page_language")
def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where markup and addresses speak too."""
    return langid.of_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@register("op7_source_mixing")
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    names = ("size", "source_size", "target", "taken", "position")
    return planned.orderBy("_position", "doc_id").select("doc_id", *[F.col(f"_{n}").alias(n) for n in names])


@register(
    "op8_line_window_dedup",
    """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, text, i, array_to_string(l[i : i + 2], chr(10)) AS t
  FROM (SELECT doc_id, text, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) >= 3) u),
used AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, i) AS n
  FROM w WHERE length(trim(replace(t, chr(10), ''), ' ')) > 0),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS i FROM used WHERE n > 1),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d),
kept AS (
  SELECT x.doc_id, string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY x.i) AS text, count(*) AS n_lines, count(g.i) AS n_removed
  FROM lines x LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(k.text, '')) END AS text_md5, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
)
def op8_line_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", F.md5("text").alias("text_md5"), "n_lines", "n_removed")


@register("op9_vantage_point_neighbours")
def op9_vantage_point_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@register("op10_trie_scores")
def op10_trie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return trie.score(docs, trie.held_out(docs["doc_id"]))


@register("op11_kneser_ney_bands")
def op11_kneser_ney_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = perplexity.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "lower", "upper")
    return found.select("doc_id", *[F.col(f"_quality.{n}").alias(n) for n in names])


@register(
    "op12_merkle_manifest",
    r"""
WITH RECURSIVE
enc AS (SELECT doc_id, lang, n_chars, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
          || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
        coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail, CAST(doc_id AS VARCHAR) AS id FROM documents),
bits AS (SELECT *, list_transform(range(0, 8 * length(id)), lambda j: (ascii(id[j // 8 + 1]) >> (j % 8)) & 1) AS b FROM enc),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) AS crc FROM bits),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(length(CAST(n_chars + t AS VARCHAR)) || ':' || (n_chars + t), '-') || tail) AS claim
  FROM (SELECT *, CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END AS t FROM crc) q),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS i FROM leaves),
low AS (
  SELECT coalesce('=' || lang, '-') AS k, 0 AS level, i, leaf AS d FROM placed
  UNION ALL
  SELECT k, level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM low) q
  WHERE n > 1 GROUP BY k, level, i // 2),
subs AS (SELECT k, d, row_number() OVER (ORDER BY CASE WHEN k = '-' THEN 0 ELSE 1 END, encode(k)) - 1 AS i, level AS height FROM
  (SELECT *, max(level) OVER (PARTITION BY k) AS top FROM low) q WHERE level = top),
high AS (
  SELECT 0 AS level, i, d FROM subs
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM high) q
  WHERE n > 1 GROUP BY level, i // 2),
roots AS (SELECT d AS root, level AS top FROM high ORDER BY level DESC LIMIT 1),
fold AS (
  SELECT coalesce('=' || p.lang, '-') AS k, p.i AS place, 0 AS step, CASE WHEN s.height = 0 THEN s.i ELSE p.i END AS i, p.claim AS d, '' AS proof, s.height, s.i AS top_i, s.d AS subroot, r.top, r.root
  FROM placed p JOIN subs s ON s.k = coalesce('=' || p.lang, '-'), roots r
  UNION ALL
  SELECT f.k, f.place, f.step + 1, CASE WHEN f.step + 1 = f.height THEN f.top_i ELSE f.i // 2 END,
         sha256(CASE WHEN f.i % 2 = 1 THEN coalesce(a.d, b.d, '') ELSE '' END || f.d || CASE WHEN f.i % 2 = 0 THEN coalesce(a.d, b.d, '') ELSE '' END),
         f.proof || coalesce(a.d, b.d, ''), f.height, f.top_i, f.subroot, f.top, f.root
  FROM fold f
  LEFT JOIN low a ON f.step < f.height AND a.k = f.k AND a.level = f.step AND a.i = xor(f.i, 1)
  LEFT JOIN high b ON f.step >= f.height AND b.level = f.step - f.height AND b.i = xor(f.i, 1)
  WHERE f.step < f.height + f.top)
SELECT p.doc_id, p.leaf, f.subroot, f.root, sha256(f.proof) AS proof_sha256, f.d AS folded_root, f.d = f.root AS verified
FROM placed p JOIN fold f ON f.k = coalesce('=' || p.lang, '-') AND f.place = p.i AND f.step = f.height + f.top
""",
)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.manifest(table(spark, sf_dir, "documents"), tampered={"n_chars": F.when(chosen, F.col("n_chars") + 1)})
    proof = F.sha2(F.array_join("proof", "").cast("binary"), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _cluster_sql(rounds: int = zonemaps.ROUNDS) -> str:
    """Plain rounds: every vector against every centroid."""
    tables = [
        """
v AS (
  SELECT vec_id, x, row_number() OVER () AS r FROM (
    SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64) q),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS k, x AS c FROM v
  QUALIFY k < 16)"""
    ]
    nearest = """
a{i} AS (
  SELECT r, k, d FROM (
    SELECT r, k, CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{i}) q
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)"""
    means = """
m{i} AS (
  SELECT k, list(m ORDER BY j) AS c FROM (
    SELECT k, j, (sum(x[j]) - ((sum(x[j]) % count(*) + count(*)) % count(*))) // count(*) AS m
    FROM a{i} JOIN v USING (r), (SELECT unnest(range(1, 65)) AS j) u GROUP BY k, j) q GROUP BY k),
c{n} AS (SELECT k, CAST(coalesce(m{i}.c, c{i}.c) AS BIGINT[]) AS c FROM c{i} LEFT JOIN m{i} USING (k))"""
    for i in range(rounds):
        tables += [nearest.format(i=i), means.format(i=i, n=i + 1)]
    tables.append(nearest.format(i=rounds))
    return "WITH" + ",".join(tables) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (k)
"""


@register("op13_zone_map_clusters", _cluster_sql())
def op13_zone_map_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = zonemaps.cluster(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join("centroid", ",").cast("binary"), 256)
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))
