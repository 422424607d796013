"""Registered queries of the numbered operators: name -> (DataFrame function, SQL or None)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.llm import decontamination, jaccard, mixing, quality, secrets, token_output, topk, toxicity, url_filter, warc
from beatloom.llm.audit_queries import QUERIES as AUDITS
from beatloom.llm.labelled import held_out
from beatloom.sources.tables import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_url_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = url_filter.judged(table(spark, d, "pages").select("page_id", "url"), RULES)
    return rows.select("page_id", *[F.col(f"_{c}").alias(c) for c in ("host", "path", "rule", "verdict")])


_RULE_SQL = " ".join(
    f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{{}}'".format(
        r
    )
    for _, r in sorted(RULES, key=lambda x: (-len(x[1]), x[1]))
)
_VIEWS = [f"{x}{v}" for x in "ar" for v in url_filter.VIEWS]


def _order_sql(k: int) -> str:
    """Smoothed probabilities of all runs of k + 1 characters, from those of k."""
    cols = lambda f: ", ".join(f(c) for c in _VIEWS)
    own = f"""SELECT substr(gram, {url_filter.ORDER - k + 1}, {k + 1}) AS gram, {cols(lambda c: f"sum({c}) AS {c}")} FROM full_counts GROUP BY 1"""
    wide = f"""SELECT *, {cols(lambda c: f"CAST(sum({c}) OVER w AS DOUBLE) AS n_{c}, CAST(count(*) FILTER (WHERE {c} > 0) OVER w AS DOUBLE) AS t_{c}")}
      FROM ({own}) WINDOW w AS (PARTITION BY substr(gram, 1, {k}))"""
    low = lambda c: f"{url_filter.BASE!r}::DOUBLE" if k == 0 else f"s.q_{c}"
    back = lambda c: f"CASE WHEN n_{c} + t_{c} > 0 THEN (CAST({c} AS DOUBLE) + t_{c} * {low(c)}) / (n_{c} + t_{c}) ELSE {low(c)} END AS q_{c}"
    join = "" if k == 0 else f"JOIN o{k - 1} s ON s.gram = substr(x.gram, 2)"
    return f"o{k} AS (SELECT x.gram, {cols(back)} FROM ({wide}) x {join})"


OP1_SQL = f"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u
), r AS (
  SELECT *, CASE {_RULE_SQL} END AS rule FROM h
), v AS (
  SELECT *, CASE {' '.join(f"WHEN rule = '{r}' THEN '{k}'" for k, r in RULES)} END AS said FROM r
), d AS (
  SELECT row_number() OVER () AS id, * FROM (SELECT url, any_value(said) AS said, count(*) AS n, CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) % {url_filter.FOLDS} AS fold FROM v GROUP BY url)
), g AS (
  SELECT id, unnest(list_transform(range(1, length(url) + 2), lambda i: substr(repeat(chr(2), {url_filter.ORDER}) || translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || chr(3), i, {url_filter.ORDER + 1}))) AS gram FROM d
), full_counts AS (
  SELECT gram, {', '.join(f"coalesce(sum(n) FILTER (WHERE said = '{'allow' if c[0] == 'a' else 'block'}' AND fold <> {int(c[1]) - 1}), 0) AS {c}" for c in _VIEWS)}
  FROM g JOIN d USING (id) GROUP BY gram
), lonely AS (
  SELECT f FROM (SELECT unnest(range({url_filter.FOLDS})) AS f) x
  WHERE (SELECT count(*) FROM d WHERE said = 'allow' AND fold <> f) = 0 OR (SELECT count(*) FROM d WHERE said = 'block' AND fold <> f) = 0
), {', '.join(map(_order_sql, range(url_filter.ORDER + 1)))}, m AS (
  SELECT gram, [{', '.join(f"CAST(round((ln(q_a{v}) - ln(q_r{v})) * {url_filter.SCALE}) AS BIGINT)" for v in url_filter.VIEWS)}] AS ratios FROM o{url_filter.ORDER}
), s AS (
  SELECT id, CAST(floor(sum(ratios[CASE WHEN said IS NULL OR fold IN (SELECT f FROM lonely) THEN 1 ELSE fold + 2 END]) / count(*) / {url_filter.STEP}) AS BIGINT) AS score FROM g JOIN m USING (gram) JOIN d USING (id) GROUP BY id
), bins AS (
  SELECT score, coalesce(sum(n) FILTER (WHERE said = 'allow'), 0) AS a, coalesce(sum(n) FILTER (WHERE said = 'block'), 0) AS r FROM s JOIN d USING (id) WHERE said IS NOT NULL GROUP BY score
), steps AS (
  SELECT score, lag(score) OVER (ORDER BY score) AS below, sum(a) OVER w AS a, sum(r) OVER w AS r, sum(a) OVER () AS all_a, sum(r) OVER () AS all_r
  FROM (SELECT * FROM bins UNION ALL SELECT max(score) + 1, 0, 0 FROM bins HAVING count(*) > 0)
  WINDOW w AS (ORDER BY score DESC)
), lim AS (
  SELECT first(coalesce(CAST(ceil((score + below) / 2.0) AS BIGINT), score) ORDER BY CASE WHEN all_a > 0 THEN a * all_r - r * all_a ELSE -r END DESC, score) AS edge FROM steps WHERE all_r > 0
)
SELECT page_id, host, path, rule, coalesce(v.said, CASE WHEN edge IS NULL OR score >= edge THEN 'allow' ELSE 'block' END) AS verdict
FROM v JOIN d USING (url) JOIN s USING (id), lim
"""


def op2_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = quality.scored(docs, quality.train(docs, table(spark, d, "labels")))
    return rows.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = toxicity.scored(docs, toxicity.train(docs, table(spark, d, "labels")))
    return rows.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op4_secrets(spark: SparkSession, d: str) -> DataFrame:
    rows = secrets.scanned(table(spark, d, "documents").select("doc_id", "text"))
    of_kind = lambda k: F.size(F.filter("_spans", lambda x: x["k"] == k)).cast("long")
    base = F.filter("_spans", lambda x: x["k"] < 3)
    return rows.select(
        "doc_id",
        of_kind(0).alias("n_assign"),
        of_kind(1).alias("n_access"),
        of_kind(2).alias("n_hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("_spans")).alias("spans"),
    )


def _located(pattern: str, keep: str) -> str:
    """Matches of a pattern as (start, end, match), from the pieces around them."""
    return f"""SELECT id, a, a + length(m) AS b, m FROM (
      SELECT id, m, CAST(list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM (
        SELECT id, gaps, ms, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m FROM (
          SELECT id, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS ms FROM d WHERE regexp_matches(text, '{pattern}')))) WHERE {keep}"""


_ASSIGN_SQL = "(" + "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")
) + """)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_MOST = "CASE " + " ".join(
    f"WHEN regexp_matches(m, '{p}') THEN {round(secrets.SCALE * secrets.WINDOW * (math.log2(secrets.WINDOW) - b))}" for p, b in secrets.CLASSES
) + " END"
OP4_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents
), base AS (
  SELECT id, a, 0 AS k, b FROM ({_located(_ASSIGN_SQL, f"length(regexp_extract(m, '{_ASSIGN_SQL}', 2)) >= 6")})
  UNION ALL SELECT id, a, 1, b FROM ({_located('AKIA[A-Z0-9]+', 'length(m) >= 20')})
  UNION ALL SELECT id, a, 2, b FROM ({_located('[0-9a-f]+', 'length(m) >= 24')})
), runs AS (
  SELECT id, a, m, {_MOST} AS most FROM ({_located('[A-Za-z0-9+/_=-]{20,}', 'true')}) WHERE regexp_matches(m, '[0-9]') AND NOT regexp_matches(m, '{secrets.ALLOWED_WHOLE}')
), cuts AS (
  SELECT id, a, most, string_split_regex(m, '{secrets.ALLOWED_PART}') AS gaps, regexp_extract_all(m, '{secrets.ALLOWED_PART}') AS ms FROM runs
), parts AS (
  SELECT id, most, m, CAST(a + coalesce(list_sum(list_transform(gaps[:i - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
  FROM (SELECT *, unnest(gaps) AS m, unnest(range(1, len(gaps) + 1)) AS i FROM cuts)
), wins AS (
  SELECT id, a, most, unnest(range(0, length(m) - 19)) AS p, unnest(list_transform(range(0, length(m) - 19), lambda p: substr(m, p + 1, 20))) AS w FROM parts WHERE length(m) >= 20
), hit AS (
  SELECT id, a, p FROM wins
  WHERE list_sum(list_transform(map_values(list_histogram(string_split(w, ''))), lambda c: {secrets.PARTS!r}[CAST(c AS BIGINT) + 1])) <= most
), parted AS (
  SELECT *, sum(CAST(p > coalesce(before, -100) + 20 AS INT)) OVER (PARTITION BY id, a ORDER BY p) AS part
  FROM (SELECT *, lag(p) OVER (PARTITION BY id, a ORDER BY p) AS before FROM hit)
), every AS (
  SELECT * FROM base UNION ALL SELECT id, a + min(p), 3, a + max(p) + 20 FROM parted GROUP BY id, a, part
), named AS (
  SELECT id, k, a, b, ['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || a || ':' || b AS name FROM every
), made AS (
  SELECT id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
    string_agg(name, ',' ORDER BY a, k, b) FILTER (WHERE k < 3) AS base, string_agg(name, ',' ORDER BY a, k, b) AS spans
  FROM named GROUP BY id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN made USING (id)
"""

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op3_decontamination(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = decontamination.judged(docs, table(spark, d, "benchmark"))
    return rows.select(
        "doc_id",
        F.col("_words").alias("n_words"),
        decontamination.n_hit().alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        decontamination.items_sha256().alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


_WORDS3 = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = f"""
WITH i AS (
  SELECT DISTINCT item_id, {_WORDS3} AS w FROM benchmark WHERE text IS NOT NULL
), iw AS (
  SELECT item_id, least(len(w), 13) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda p: array_to_string(w[p:p + least(len(w), 13) - 1], ' '))) AS win
  FROM i WHERE len(w) > 0
), d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce({_WORDS3}, []) AS w FROM documents
), dw AS (
  SELECT row, n, unnest(range(1, len(w) - n + 2)) AS p, unnest(list_transform(range(1, len(w) - n + 2), lambda p: array_to_string(w[p:p + n - 1], ' '))) AS win
  FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n
), hit AS (
  SELECT row, p, n, item_id FROM dw JOIN iw USING (n, win)
), pos AS (
  SELECT row, count(DISTINCT q) AS n_hit FROM (SELECT row, unnest(range(p, p + n)) AS q FROM hit) GROUP BY row
), items AS (
  SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (row) LEFT JOIN items USING (row)
"""


def op6_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.groups(table(spark, d, "documents")).select("doc_id", "n_shingles", "component_id")


OP6_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda p: array_to_string(w[p:p + 3], ' ')) END) AS g FROM d
), e AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), least AS (
  SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a
)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(b, s.doc_id)) AS component_id
FROM s LEFT JOIN least USING (doc_id)
"""


def op5_top_k(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", topk.whole_components(F.col("embedding"), 64).alias("vector"))
    queries = rows.filter(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id")
    return topk.top_k(rows, queries, 20)


OP5_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""


def op7_mixing(spark: SparkSession, d: str) -> DataFrame:
    plan = mixing.schedule(table(spark, d, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("turns") * F.col("size")).alias("taken"))


OP7_SQL = r"""
WITH r AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(concat_ws('|', 'mix', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS draw
  FROM documents
), t AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM r GROUP BY source
), f AS (
  SELECT *, source_size * 2 AS lim, CAST(source_size * 2 AS DOUBLE) / w AS per FROM t
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - (sum(lim) OVER (ORDER BY per, source NULLS LAST) - lim))
      / (sum(w) OVER () - sum(w) OVER (ORDER BY per, source NULLS LAST) + w) AS level FROM f
), lv AS (
  SELECT first(level ORDER BY per, source NULLS LAST) AS level FROM l WHERE per >= level
), g AS (
  SELECT l.source, l.source_size, least(CAST(lim AS DOUBLE), coalesce(w * lv.level, CAST(lim AS DOUBLE))) AS target FROM l LEFT JOIN lv ON true
), q AS (
  SELECT r.*, g.source_size, g.target, CAST(sum(size) OVER (PARTITION BY r.source ORDER BY draw) AS BIGINT) AS sent
  FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source
), e AS (
  SELECT size, (sent + p * source_size) / target AS finish FROM q, (VALUES (0), (1)) AS x(p) WHERE size > 0 AND target > 0
), c AS (
  SELECT max(finish) AS cut FROM (
    SELECT finish, sum(sum(size)) OVER (ORDER BY finish) AS until FROM e GROUP BY finish
  ) WHERE until <= (SELECT sum(size) * 1.5::DOUBLE FROM r)
)
SELECT doc_id, size, source_size, target,
  CASE WHEN size > 0 AND target > 0 AND c.cut IS NOT NULL
    THEN size * (CAST(sent / target <= c.cut AS BIGINT) + CAST((sent + source_size) / target <= c.cut AS BIGINT)) ELSE 0 END AS taken
FROM q, c
"""


def op8_token_output(spark: SparkSession, d: str) -> DataFrame:
    return token_output.encoded(table(spark, d, "documents"), vocabulary())


def op10_warc(spark: SparkSession, d: str) -> DataFrame:
    rows = warc.captures(table(spark, d, "pages"))
    number = lambda c: F.regexp_extract(c, r"^<urn:capture:(-?\d+):", 1)
    return rows.select(
        F.expr(f"try_cast(metadata.fields['{warc.PAGE_KEY}'] AS long)").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(F.col("response.refers_to").isNotNull(), number(F.col("response.refers_to")).cast("long")).alias("refers_to"),
    )


_B32 = "||".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {15 - 5 * i}) & 31) + 1 AS BIGINT), 1)"
    for g in range(8)
    for i in range(4)
)
OP10_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h FROM p),
w AS (SELECT h, max(page_id) AS last FROM h GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_B32} AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM h JOIN w USING (h)
"""

QUERIES: dict = {
    "op1_url_filter": (op1_url_filter, OP1_SQL),
    "op2_quality": (op2_quality, None),
    "op4_secrets": (op4_secrets, OP4_SQL),
    "op9_toxicity": (op9_toxicity, None),
    "op3_decontamination": (op3_decontamination, OP3_SQL),
    "op6_jaccard": (op6_jaccard, OP6_SQL),
    "op5_top_k": (op5_top_k, OP5_SQL),
    "op7_mixing": (op7_mixing, OP7_SQL),
    "op8_token_output": (op8_token_output, None),
    "op10_warc": (op10_warc, OP10_SQL),
} | AUDITS
