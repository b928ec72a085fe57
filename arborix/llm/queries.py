"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.llm import decontaminate, importance, language_model, mixing, pii, prefix_trie, quality_rules, simhash, site_quality, token_counts, token_ids, toxicity, url_filter
from arborix.session import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sizes(table(spark, sf_dir, "documents"))
    return mixing.plan(sized).select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 5 == 0
    model = toxicity.train(docs, labels.where(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def sites_of(pages: DataFrame) -> DataFrame:
    """(doc_id, host, path): one page's host and first path part for each page id."""
    url = F.col("url")
    own = F.min(F.struct(url_filter.host(url).alias("host"), F.regexp_extract(url_filter.path(url), "^/([^/]*)", 1).alias("path")))
    return pages.where(F.col("page_id").isNotNull()).groupBy(F.col("page_id").alias("doc_id")).agg(own.alias("s")).select("doc_id", "s.*")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by host and first path part of the page with their id (of several the
    first by host and path), without one by source and language."""
    sites = sites_of(table(spark, sf_dir, "pages"))
    host = F.concat(F.lit("source="), "source")
    return site_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), host, F.col("lang"), sites=sites)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.round_trip(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations after the first turns of each became those of its group of 20."""
    return prefix_trie.trie(*prefix_trie.with_borrowed_heads(*prefix_trie.placed(table(spark, sf_dir, "conversations"))))


_OPERATORS = (
    op1_url_filter, op2_lm_scoring, op3_quality_rules, op4_mixing, op5_toxicity, op6_quality_classifier, op7_decontamination,
    op8_pii, op9_token_ids, op10_simhash, op11_importance, op12_token_counts, op13_prefix_trie,
)
QUERIES = {f.__name__: f for f in _OPERATORS}

#: The mix in SQL: targets by filling sources in the order of cap / weight, then
#: one running sum for each source in the order of the hash-random key.
OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         'mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '') || ':'
         || (row_number() OVER (PARTITION BY doc_id, source, text) - 1) AS drawn FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), w AS (
  SELECT *, 2.0 * source_size AS cap,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS weight FROM s
), f AS (
  SELECT *, cap / weight AS ratio,
         (sum(source_size) OVER () * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, CAST(coalesce(least(cap, (SELECT level FROM f WHERE level < ratio ORDER BY ratio, level LIMIT 1) * weight), cap) AS DOUBLE) AS target FROM f
), r AS (
  SELECT doc_id, size, source_size, target,
         coalesce(CAST(floor(target / nullif(source_size, 0)) AS BIGINT), 0) AS epochs,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(drawn), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken FROM r
"""

#: CRC-32 in SQL: the table of bytes, and the CRC of a list of them.
_CRC_TABLE = "(SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def _crc(text: str) -> str:
    data = f"list_transform(range(strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 dw AS (SELECT r, unnest(w) AS w FROM d), bw AS (SELECT unnest(w) AS w FROM b),
 v AS MATERIALIZED (SELECT w, {_crc("w")} % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw) x, {_CRC_TABLE} y),
 s AS (SELECT bucket, count(*) AS s FROM dw JOIN v USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw JOIN v USING (w) GROUP BY bucket),
 g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
 x AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN v USING (w) JOIN g USING (bucket) GROUP BY r),
 y AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN x USING (r)),
 z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM z
"""

OP13_SQL = rf"""
WITH o AS (SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_id,
   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT conv_id, {_crc("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM o) x, {_CRC_TABLE} y),
 r AS (SELECT c.conv_id, o.pos, turn_id, words FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 WHERE pos < h
   UNION ALL SELECT conv_id, pos + 4, turn_id, words FROM c JOIN o USING (conv_id) WHERE pos >= h),
 l AS (SELECT conv_id, list(turn_id ORDER BY pos) FILTER (turn_id IS NOT NULL) AS seq, list(words ORDER BY pos) FILTER (turn_id IS NOT NULL) AS words FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id),
 m AS (SELECT conv_id, d, coalesce(seq[:d], []) AS path, d = coalesce(len(seq), 0) AS ends, coalesce(words[d], 0) AS words FROM (SELECT *, unnest(range(coalesce(len(seq), 0) + 1)) AS d FROM l)),
 n AS (SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY path, d),
 k AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
 v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
 s AS (SELECT path[:up] AS path, CAST(sum(CAST(n_children = 0 AS INT)) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS up FROM v) GROUP BY 1)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM v JOIN s USING (path) LEFT JOIN n p ON v.depth > 0 AND p.depth = v.depth - 1 AND p.path = v.path[:v.depth - 1]
"""

ORACLES: dict[str, str] = {"op4_mixing": OP4_SQL, "op11_importance": OP11_SQL, "op13_prefix_trie": OP13_SQL}
