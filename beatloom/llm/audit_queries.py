"""Registered queries of operators 11 to 13: name -> (DataFrame function, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.llm import divergence, pii, prefix_trie
from beatloom.sources.tables import table


def op11_pii(spark: SparkSession, d: str) -> DataFrame:
    rows = pii.scanned(table(spark, d, "documents").select("doc_id", "text"), keep=["doc_id"])
    of_kind = lambda k: F.size(F.filter("_spans", lambda x: x["k"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{pii.KINDS[k]}") for k in range(4)],
        F.sha2(pii.listed(F.filter("_spans", lambda x: x["k"] < 4)), 256).alias("base_sha256"),
        pii.listed(F.col("_spans")).alias("spans"),
    )


def op12_divergence(spark: SparkSession, d: str) -> DataFrame:
    return divergence.audited(table(spark, d, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (
  SELECT id, lang, source, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), gs AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term
), every AS (
  SELECT gs.lang, gs.source, kept.term, coalesce(c.n, 0) AS n FROM gs JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM every JOIN v USING (lang)
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(total) + any_value(v)) AS q
  FROM every JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS total FROM every GROUP BY lang) x USING (lang) GROUP BY lang, term
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM gs a JOIN gs b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  ) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), words AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM words)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""

def op13_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, d, "conversations")).withColumn("depth", F.col("depth").cast("long"))


# The CRC-32 of a decimal: each byte is added, then eight bits are shifted out (-1 stands for a shift).
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"""
OP13_SQL = f"""
WITH t AS (
  SELECT conv_id, key, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS pos
  FROM (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, strlen(coalesce(text, '')) AS bytes
        FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS head, {_CRC32} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)
), given AS (
  SELECT c.conv_id, t.pos + 1 AS depth, t.key, t.bytes FROM c JOIN t ON t.conv_id = c.head AND t.pos < c.h
), m AS (
  SELECT c.conv_id, c.h, count(g.depth) AS m FROM c LEFT JOIN given g USING (conv_id) GROUP BY ALL
), r AS (
  SELECT * FROM given UNION ALL SELECT conv_id, t.pos - m.h + m.m + 1, t.key, t.bytes FROM t JOIN m USING (conv_id) WHERE t.pos >= m.h
), p AS (
  SELECT conv_id, 0 AS depth, '' AS node, 0 AS bytes FROM c
  UNION ALL SELECT conv_id, depth, md5(string_agg(key, ',') OVER (PARTITION BY conv_id ORDER BY depth)), bytes FROM r
), q AS (
  SELECT *, lag(node) OVER w AS up, lead(node) OVER w IS NULL AS ends FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
), n AS (
  SELECT node, any_value(depth) AS depth, any_value(up) AS up, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM q GROUP BY node
), k AS (
  SELECT n.*, coalesce(x.n, 0) AS n_children FROM n LEFT JOIN (SELECT up AS node, count(*) AS n FROM n GROUP BY up) x USING (node)
), s AS (
  SELECT q.node, sum(CAST(k.n_children = 0 AS BIGINT)) AS n_leaves, sum((k.n_convs - 1) * k.bytes) AS saved_tokens
  FROM k JOIN q ON q.conv_id = k.conv_id AND q.depth <= k.depth GROUP BY q.node
)
SELECT k.conv_id, CAST(k.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
FROM k JOIN s USING (node) LEFT JOIN n u ON u.node = k.up
"""

QUERIES: dict = {
    "op11_pii": (op11_pii, None),
    "op12_divergence": (op12_divergence, OP12_SQL),
    "op13_prefix_trie": (op13_prefix_trie, OP13_SQL),
}
