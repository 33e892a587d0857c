"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, brown, hardneg, linedup, mixing, pii, rules, simhash, site_quality, spm, store, supermin, trie, warc

MODEL = public_tokenizers.path("piece_bpe_32k.model")
Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.digests(_docs(spark, sf_dir), MODEL)


def op4_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return site_quality.score(_docs(spark, sf_dir), labels, F.col("source"), F.col("lang"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rules.ledger(_docs(spark, sf_dir))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~rules.passes("base-1")).alias("base_failed"), rules.passes("strict-1").alias("kept"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_path(spark, "warc")
    warc.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.read_index(spark, path)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linedup.with_bitmaps(_docs(spark, sf_dir))
    dropped = F.coalesce(F.aggregate(F.map_values("__drop"), F.lit(0), lambda n, w: n + F.bit_count(w)), F.lit(0)).cast("long")
    text = linedup.kept_text(F.col("text"), F.col("__drop"))
    return rows.select("doc_id", F.size(linedup.split_lines(F.col("text"))).cast("long").alias("n_lines"), dropped.alias("n_dropped"), F.sha2(F.encode(text, "UTF-8"), 256).alias("kept_sha256"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supermin.near_duplicates(_docs(spark, sf_dir), 4)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_docs(spark, sf_dir))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.scores(_docs(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, ids = trie.rebuilt(trie.positions(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return trie.nodes(turns, ids)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(hardneg.usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select(F.col("vec_id").alias("id"), label.alias("label"), hardneg.whole(F.col("embedding"), 256).alias("vec"))
    return hardneg.hard_negatives(rows, F.col("id") % 100 == 0)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(_docs(spark, sf_dir))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict[str, Query]:
    import corpus_pipeline

    own = [op1_nearest_vectors, op2_mix_sources, op3_sentencepiece, op4_site_quality, op5_quality_rules, op6_warc, op7_line_dedup, op8_near_duplicates, op9_personal_data, op10_language_model, op11_prefix_trie, op12_hard_negatives, op13_simhash]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
g AS (SELECT doc_id, i, [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] AS k, lead(w, 4) OVER o AS last FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g WHERE last IS NOT NULL),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE len(trim(line, {SPACES})) > 0 GROUP BY doc_id),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(text) - len(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(text) - len(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT) AS n_upper,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN m USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (10 > n_words OR n_repeat_words * 100 > n_words * 20) AS base_failed,
  NOT (10 > n_words OR n_repeat_words * 100 > n_words * 20 OR n_symbols * 10 > n_words OR n_dup_lines * 100 > n_lines * 35 OR word_chars > n_words * 14 OR n_words * 2 > word_chars OR n_upper * 2 > word_chars) AS kept
FROM f
"""

OP7_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, {LOWER.format(f"trim(line, {SPACES})")} AS key FROM l),
g AS (SELECT key, max(doc_id) AS first FROM k WHERE len(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, g.first IS NOT NULL AND k.doc_id <> g.first AS gone FROM k LEFT JOIN g ON k.key = g.key AND len(k.key) >= 40)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

OP8_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END AS g FROM d),
e AS (SELECT doc_id, hash(unnest(g)) AS h FROM s),
z AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
p AS (SELECT x, y FROM c JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE 100 * common >= 80 * (a.n + b.n - common)),
q AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
t AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT q.y, t.r FROM t JOIN q ON q.x = t.v WHERE t.r < q.y)
SELECT doc_id, n AS n_shingles, min(t.r) AS component_id, doc_id = min(t.r) AS kept FROM z JOIN t ON t.v = z.doc_id GROUP BY doc_id, n
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": OP5_SQL, "op7_line_dedup": OP7_SQL, "op8_near_duplicates": OP8_SQL, "op6_warc": OP6_SQL, "op11_prefix_trie": OP11_SQL, "op12_hard_negatives": OP12_SQL}


OP6_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS hex FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(4), lambda k: list_aggregate(list_transform(range(8), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(10 * k + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * i AS INT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM m
"""

# CRC-32 by its bits: the table of a byte, then the digits of an id one after another
OP11_SQL = r"""
WITH RECURSIVE bits AS (SELECT b AS byte, CAST(b AS UBIGINT) AS c, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
t0 AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS UBIGINT) AS c FROM (SELECT DISTINCT conv_id FROM t0)
  UNION ALL SELECT conv_id, s, i + 1, xor(c >> 8, t[CAST(xor(c & 255, CAST(ord(s[i + 1]) AS UBIGINT)) AS BIGINT) + 1]) FROM crc, tab WHERE i < len(s)),
ids AS (SELECT conv_id, conv_id - conv_id % 100 AS base, CAST(xor(c, CAST(4294967295 AS UBIGINT)) % 6 AS BIGINT) AS h FROM crc WHERE i = len(s)),
seqs AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY pos) AS s FROM t0 GROUP BY conv_id),
re AS (SELECT i.conv_id, coalesce(b.s[1:i.h], []) || coalesce(o.s[i.h + 1:], []) AS s FROM ids i JOIN seqs o USING (conv_id) LEFT JOIN seqs b ON b.conv_id = i.base),
st AS (SELECT conv_id, s[d] AS turn, d, row_number() OVER () AS k FROM (SELECT conv_id, s, unnest(range(1, len(s) + 1)) AS d FROM re)),
walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS d, '' AS p, CAST(NULL AS VARCHAR) AS q, CAST(0 AS BIGINT) AS n FROM re
  UNION ALL SELECT w.conv_id, CAST(st.d AS BIGINT), sha256(w.p || sha256(st.turn.r) || sha256(st.turn.t)), w.p, CAST(len(st.turn.t) AS BIGINT) FROM walk w JOIN st ON st.conv_id = w.conv_id AND st.d = w.d + 1),
node AS (SELECT d, p, min(q) AS q, min(conv_id) AS conv_id, count(*) AS n_convs, min(n) AS n FROM walk GROUP BY d, p),
kid AS (SELECT d - 1 AS d, q AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children, up.conv_id AS parent_conv_id FROM node LEFT JOIN kid USING (d, p) LEFT JOIN node up ON up.d = node.d - 1 AND up.p = node.q),
sub AS (SELECT a.d, a.p, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.n) AS saved FROM full_node f JOIN walk a ON a.conv_id = f.conv_id AND a.d <= f.d GROUP BY a.d, a.p),
fin AS (SELECT w.d, w.p, string_agg(CAST(w.conv_id AS VARCHAR), ',' ORDER BY w.conv_id) AS ends FROM walk w JOIN re ON re.conv_id = w.conv_id AND len(re.s) = w.d GROUP BY w.d, w.p)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM full_node JOIN sub USING (d, p) LEFT JOIN fin USING (d, p)
"""

OP12_SQL = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10
"""
