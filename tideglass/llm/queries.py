"""The operators as queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html, langid, linededup, mixing, packing, pii, quality, secrets, simhash, trie, vectors, webp, whitening
from .common import read


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents")).drop("source").withColumn("target", F.round("target", 6))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_report(read(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


def op9_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media_report(read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.col("text").alias("clean_text"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(read(spark, sf_dir, "pages"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read(spark, sf_dir, "conversations"))


def queries() -> dict:
    made = (op1_language, op2_quality, op3_pii, op4_mixing, op5_secrets, op6_packing, op7_simhash, op8_embeddings, op9_webp, op10_line_dedup, op11_whitening, op12_html, op13_trie)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4, "op8_embeddings": OP8, "op10_line_dedup": OP10, "op13_trie": OP13}


OP4 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), sources AS (
  SELECT source, sum(size) AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sized GROUP BY source
), ranked AS (
  SELECT *, 2.0 * source_size AS top, 2.0 * source_size / weight AS ratio FROM sources
), filled AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(top) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM ranked WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levelled AS (
  SELECT source, source_size, top, weight, (SELECT level FROM filled WHERE level <= ratio ORDER BY ratio, level LIMIT 1) AS level FROM filled
), targets AS (
  SELECT source, source_size, CAST(least(top, coalesce(level, CAST('inf' AS DOUBLE)) * weight) AS DOUBLE) AS target FROM levelled
), drawn AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('7:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / 281474976710656.0 AS coin
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), copied AS (
  SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM drawn
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, round(target, 6) AS target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM copied
"""
OP8 = r"""
WITH RECURSIVE wide AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), good AS (
  SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM wide
  WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.93 * a.norm * b.norm
), reached AS (
  SELECT a AS vec_id, b AS other FROM links UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a
), grouped AS (SELECT vec_id, min(other) AS least FROM reached GROUP BY vec_id
), counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(g.least, e.vec_id)) AS component_id, e.vec_id <= coalesce(g.least, e.vec_id) AS kept
FROM embeddings e LEFT JOIN counted c ON e.vec_id = c.vec_id LEFT JOIN grouped g ON e.vec_id = g.vec_id
"""
OP10 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL
), cut AS (
  SELECT doc_id, k, string_split(regexp_replace(line, '([.!?] )', '\1' || chr(1), 'g'), chr(1)) AS ps FROM lines
), pieces AS (
  SELECT doc_id, k, piece, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS i, regexp_replace(piece, '^[ \t\r\v\f]+|[ \t\r\v\f]+$', '', 'g') AS plain
  FROM (SELECT doc_id, k, unnest(ps) AS piece, unnest(range(len(ps))) AS j FROM cut)
), windows AS (
  SELECT doc_id, i, plain AS p0, lead(plain) OVER w AS p1, lead(plain, 2) OVER w AS p2, count(*) OVER (PARTITION BY doc_id) AS n FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY p0, p1, p2 ORDER BY doc_id, i) AS nth
  FROM windows WHERE (p2 IS NOT NULL OR i = 0) AND p0 || coalesce(p1, '') || coalesce(p2, '') <> ''
), gone AS (
  SELECT DISTINCT doc_id, i + d AS i FROM ranked, (VALUES (0), (1), (2)) AS t(d) WHERE nth > 1
), kept AS (
  SELECT p.doc_id, p.i, p.k, p.piece, lag(p.k) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS before FROM pieces p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i
), left_over AS (
  SELECT doc_id, count(*) AS n, string_agg(CASE WHEN before < k THEN chr(10) ELSE '' END || piece, '' ORDER BY i) AS clean_text FROM kept GROUP BY doc_id
), counted AS (SELECT doc_id, count(*) AS n FROM pieces GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.text) - len(replace(d.text, chr(10), '')) + 1, 0) AS n_lines, coalesce(c.n - coalesce(l.n, 0), 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(l.clean_text, '') END AS clean_text
FROM documents d LEFT JOIN counted c ON d.doc_id = c.doc_id LEFT JOIN left_over l ON d.doc_id = l.doc_id
"""
OP13 = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL
), stored AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS ts FROM turns GROUP BY conv_id
), sized AS (
  SELECT conv_id, ts, 3 - list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, b: list_reduce(list_transform(range(8), lambda i: CAST(0 AS BIGINT)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)), 4294967295) % 4 AS h
  FROM stored
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.ts[1:c.h], []), c.ts[c.h + 1:]) AS ts FROM sized c LEFT JOIN stored b ON b.conv_id = c.conv_id - c.conv_id % 20
), prefixes AS (
  SELECT conv_id, len(ts) AS total, unnest(range(len(ts) + 1)) AS depth, ts FROM rebuilt
), nodes AS (
  SELECT depth, ts[1:depth] AS k, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (total = depth) AS ends FROM prefixes GROUP BY depth, ts[1:depth]
), family AS (
  SELECT depth - 1 AS depth, k[1:depth - 1] AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2
), known AS (
  SELECT n.*, coalesce(f.n_children, 0) AS n_children, (n.n_convs - 1) * coalesce(len(regexp_extract_all(n.k[-1].text, '[^\x20\x09-\x0D]+')), 0) AS saved FROM nodes n LEFT JOIN family f ON n.depth = f.depth AND n.k = f.k
), above AS (
  SELECT depth, k, saved, n_children, unnest(range(depth + 1)) AS top FROM known
), summed AS (
  SELECT top AS depth, k[1:top] AS k, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY 1, 2
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM known n JOIN summed s ON n.depth = s.depth AND n.k = s.k LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.k = n.k[1:n.depth - 1]
"""
