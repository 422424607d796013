"""Registered queries: sources, sinks and their round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from beatloom.constants import MAX_SIGNAL
from beatloom.functions.arrays import as_text
from beatloom.operators import metrics as M
from beatloom.operators import splits as X
from beatloom.operators.ordered import hash_ranked
from beatloom.plans import fixtures as fx
from beatloom.plans.fixtures import with_fixtures
from beatloom.plans.segment_queries import _text
from beatloom.plans.sentence_queries import _SENT, token_sentence_frame, vocab_offsets
from beatloom.session import shared_dir
from beatloom.sources import signals as G
from beatloom.sources.tables import table


LEAD_COLUMNS = ["lead_0", "lead_1", "lead_2", "lead_3"]


def _wide(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as records of four lead columns that hold the whole vector, once to three times over
    by label, so that records differ in length."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    quarter = F.floor(F.size("v") / 4).cast("int")
    lead = lambda i: F.flatten(F.array_repeat(F.slice("v", quarter * i + 1, quarter), (F.col("label") % 3 + 1).cast("int")))
    return e.select("vec_id", "label", *[lead(i).alias(c) for i, c in enumerate(LEAD_COLUMNS)])


def wide_to_long(spark: SparkSession, d: str) -> DataFrame:
    """Leads fitted to 40 samples: most records are padded, the longest lose their end."""
    stacked = G.stack_leads(_wide(spark, d), ["vec_id"], LEAD_COLUMNS, 40)
    return G.long_form(stacked, ["vec_id"], "leads").withColumn("value", F.round("value", 6))


def stacked_leads(spark: SparkSession, d: str) -> DataFrame:
    s = G.stack_leads(_wide(spark, d), ["vec_id"], LEAD_COLUMNS, 40)
    return s.select("vec_id", "length", "even", as_text(F.flatten("leads"), 10_000).alias("leads"))


def _stored_signals(spark: SparkSession, d: str, cap: int) -> DataFrame:
    rows = _wide(spark, d).select("vec_id", F.array(*LEAD_COLUMNS).alias("leads"))
    path = f"{_folder(spark)}/signal_rows"
    G.signal_rows(rows, "leads", len(LEAD_COLUMNS), cap=cap).write.parquet(path)
    return spark.read.parquet(path).select("vec_id", "length", "stored_length", as_text(F.flatten("leads"), 10_000).alias("leads"))


def signal_rows(spark: SparkSession, d: str) -> DataFrame:
    """Signals stored whole: the longest stored length is far above theirs."""
    return _stored_signals(spark, d, MAX_SIGNAL)


def signal_rows_capped(spark: SparkSession, d: str) -> DataFrame:
    """Signals longer than the stored length lose their end and keep their true length."""
    return _stored_signals(spark, d, 30)


def _folder(spark: SparkSession) -> str:
    """A new folder per call below the one all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/beatloom-{uuid.uuid4().hex}"


def segment_store(spark: SparkSession, d: str) -> DataFrame:
    """Waves written by lead as segment type, then counted from the stored files."""
    w = fx.waves(spark, d).withColumn("segment", F.concat(F.lit("L"), F.col("lead_idx").cast("string")))
    path = f"{_folder(spark)}/segments"
    G.write_segments(w.to(StructType.fromDDL(G.SEGMENT_SCHEMA)), path)
    stored = spark.read.schema(G.SEGMENT_SCHEMA).parquet(path)
    files = G.file_rows(stored, ["segment"])
    per = files.groupBy("segment").agg(F.sum("n_rows").alias("n_rows"))
    held = F.aggregate("data", F.lit(0.0), lambda a, x: a + F.floor(x * 100 + 0.5)).cast("bigint")
    real = stored.filter("original_len > 0").groupBy("segment").agg(F.count("*").alias("n_real"), F.sum(held).alias("held"))
    return per.join(real, "segment")


def sentence_store(spark: SparkSession, d: str) -> DataFrame:
    """Sentences stored with their vocabulary and read back."""
    path = _folder(spark)
    G.sentence_set(token_sentence_frame(spark, d).withColumn("num_beats", F.col("num_beats").cast("tinyint")), path, vocab_offsets(spark, d))
    back = spark.read.parquet(f"{path}/sentences").groupBy(F.concat(F.lit("sentences of "), F.col("num_beats").cast("string")).alias("what"))
    vocab = spark.read.parquet(f"{path}/vocab").agg(F.lit("vocabulary").alias("what"), F.max("vocab_size").alias("n"))
    return back.agg(F.count("*").alias("n")).unionByName(vocab)


def assignment_store(spark: SparkSession, d: str) -> DataFrame:
    """Token assignments stored by segment and scanned back with the stored types."""
    a = fx.assignments(spark, d).select(
        F.col("patient_id").cast("string"), F.col("study_id").cast("string"), "beat_idx", F.col("token").cast("smallint").alias("token_index"), "segment", F.lit(48).alias("codebook_size")
    )
    path = f"{_folder(spark)}/assignments"
    G.write_segments(a, path)
    back = spark.read.schema(G.ASSIGNMENT_SCHEMA).parquet(path)
    return back.groupBy("segment").agg(F.count("*").alias("n"), F.sum(F.col("token_index").cast("bigint")).alias("tokens"), F.count_distinct("study_id").alias("studies"), F.max("codebook_size").alias("codebook_size"))


def shard_list(spark: SparkSession, d: str) -> DataFrame:
    """All source shards found in the stored files, with their place in the shuffled list."""
    path = f"{_folder(spark)}/documents"
    table(spark, d, "documents").select("doc_id", "source").write.partitionBy("source").parquet(path)
    found = G.shuffled_shards(G.list_files(spark, path, ".parquet"), lambda p: F.regexp_extract(p, r"/source=([^/]+)/", 1))
    return hash_ranked(found, "shard", 42).select("shard", "pos", "n").orderBy("pos")


def split_store(spark: SparkSession, d: str) -> DataFrame:
    """A split stored once: a second, different computation reuses the first."""
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("patient_id"))
    path = f"{_folder(spark)}/split"
    first = G.write_once(X.patient_split(ids, "patient_id", [("train", 0.8), ("val", 0.15), ("test", 0.05)], seed=7), path)
    again = G.write_once(X.patient_split(ids, "patient_id", [("train", 0.5), ("val", 0.5)], seed=8), path)
    return first.join(again.withColumnRenamed("split", "again"), "patient_id").groupBy("split", "again").agg(F.count("*").alias("n"))


def csv_tables(spark: SparkSession, d: str) -> DataFrame:
    """Customers through a CSV file with a header and a given schema."""
    path = f"{_folder(spark)}/customers"
    table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").write.csv(path, header=True)
    back = G.read_csv(spark, path, "c_custkey bigint, c_nationkey int, c_mktsegment string")
    return back.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_nationkey").alias("nations"))


def metric_store(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds of run results into one stored table, by seed and epoch: all, then the good
    ones with one more column."""
    e = fx.epochs(spark, d).withColumnRenamed("run", "seed")
    path = f"{_folder(spark)}/metrics"
    G.upsert_stored(e.select("seed", "epoch", "acc"), path, ["seed", "epoch"])
    last = G.upsert_stored(e.filter("acc > 0.5").select("seed", "epoch", (F.col("acc") + 1).alias("acc"), "gmean"), path, ["seed", "epoch"])
    return spark.read.parquet(last)


def report_store(spark: SparkSession, d: str) -> DataFrame:
    """One JSON report per member with nested metrics, collected by run tag and seed."""
    path = _folder(spark)
    p = fx.predictions(spark, d)
    for seed in range(3):
        pred, label = (F.get("probs", F.lit(seed)) > 0.5).cast("int"), F.get("labels", F.lit(0))
        m = M.rates(p.agg(*M.confusion(pred, label)))
        G.write_report(m.select(F.struct("tp", "fp", "fn", "tn").alias("counts"), F.struct("accuracy", "gmean").alias("metrics")), f"{path}/metrics_cw1.9_r8_seed{seed}")
    schema = "counts struct<tp:bigint,fp:bigint,fn:bigint,tn:bigint>, metrics struct<accuracy:double,gmean:double>"
    runs = G.run_files(spark, path, schema, r"metrics_(.+)_seed(\d+)", contains="cw1.9")
    return runs.select("run_tag", "seed", "counts.tp", "counts.fp", "counts.fn", "counts.tn", F.round("metrics.accuracy", 6).alias("accuracy"))


def first_shards(spark: SparkSession, d: str) -> DataFrame:
    """Documents stored by source; the first five source shards in shuffled order are
    picked from the file names, then read."""
    path = f"{_folder(spark)}/documents"
    table(spark, d, "documents").select("doc_id", "n_chars", "source").write.partitionBy("source").parquet(path)
    shard = lambda p: F.regexp_extract(p, r"/source=([^/]+)/", 1)
    picked = G.shuffled_shards(G.list_files(spark, path, ".parquet"), shard, limit=5)
    rows = X.members(spark.read.parquet(path), picked.withColumnRenamed("shard", "source"), "source")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def signal_csv(spark: SparkSession, d: str) -> DataFrame:
    """Recordings written as headerless CSV files, one per label, and read back."""
    path = f"{_folder(spark)}/signals"
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("sample_idx", "x"))
    sums = e.groupBy("label", "sample_idx").agg(F.count("*").alias("a"), F.sum("vec_id").alias("b"))
    # One output file per label holds its samples in order: 64 lines by construction.
    one = sums.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("sample_idx", "a", "b"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(",", x["a"].cast("string"), x["b"].cast("string"))), "\n")
    one.select(F.concat(F.lit("rec"), F.col("label").cast("string")).alias("rec"), text.alias("value")).write.partitionBy("rec").text(path)
    folder = lambda p: F.element_at(F.split(p, "/"), -2)
    rows = G.read_signal_csv(spark, f"{path}/*/*.txt", 2, recording=folder)
    return rows.groupBy(F.col("sample_idx").cast("int").alias("sample_idx"), "lead_idx").agg(F.sum("value").cast("bigint").alias("total"), F.countDistinct("recording_id").alias("records"))


_STORED = """SELECT vec_id, CAST(n AS INT) AS length, CAST(least(n, {cap}) AS INT) AS stored_length, {text} AS leads FROM wide"""
_WIDE = {
    "wide": """
        SELECT vec_id, len(v) // 4 * (label % 3 + 1) AS n, list_transform(range(4), lambda l:
            flatten(list_transform(range(label % 3 + 1), lambda k: v[len(v) // 4 * l + 1:len(v) // 4 * (l + 1)]))) AS ls
        FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e""",
    "stacked": """
        SELECT vec_id, n, list_transform(ls, lambda l: list_transform(range(40), lambda i: CASE WHEN i < len(l) THEN l[i + 1] ELSE 0 END)) AS leads FROM wide""",
}


def _stored(cap: int) -> str:
    return with_fixtures([], _STORED.format(cap=cap, text=_text(f"flatten(list_transform(ls, lambda l: l[1:{cap}]))", 10000)), extra={"wide": _WIDE["wide"]})


QUERIES = {
    "wide_to_long": (
        wide_to_long,
        with_fixtures(
            [],
            """SELECT vec_id, CAST(l AS INT) AS lead_idx, CAST(i AS INT) AS sample_idx, round(leads[l + 1][i + 1], 6) AS value
               FROM stacked CROSS JOIN (SELECT unnest(range(4)) AS l) x CROSS JOIN (SELECT unnest(range(40)) AS i) y""",
            extra=_WIDE,
        ),
    ),
    "stacked_leads": (
        stacked_leads,
        with_fixtures([], f"SELECT vec_id, CAST(n AS INT) AS length, true AS even, {_text('flatten(leads)', 10000)} AS leads FROM stacked", extra=_WIDE),
    ),
    "signal_rows": (signal_rows, _stored(MAX_SIGNAL)),
    "signal_rows_capped": (signal_rows_capped, _stored(30)),
    "segment_store": (
        segment_store,
        with_fixtures(
            ["waves"],
            "SELECT concat('L', lead_idx) AS segment, count(*) AS n_rows, count(*) FILTER (WHERE original_len > 0) AS n_real, CAST(sum(list_sum(list_transform(CAST(data AS FLOAT[]), lambda x: floor(CAST(x AS DOUBLE) * 100 + 0.5)))) FILTER (WHERE original_len > 0) AS BIGINT) AS held FROM waves GROUP BY 1",
        ),
    ),
    "sentence_store": (
        sentence_store,
        with_fixtures(
            ["assignments"],
            """SELECT concat('sentences of ', num_beats) AS what, count(*) AS n FROM sent GROUP BY 1
               UNION ALL SELECT 'vocabulary', CAST(3 + sum(k) AS BIGINT) FROM (SELECT max(token) + 1 AS k FROM assignments GROUP BY segment) x""",
            recursive=True,
            extra=_SENT,
        ),
    ),
    "assignment_store": (
        assignment_store,
        with_fixtures(
            ["assignments"],
            """SELECT segment, count(*) AS n, CAST(sum(token) AS BIGINT) AS tokens, count(DISTINCT study_id) AS studies, CAST(48 AS INTEGER) AS codebook_size
               FROM assignments GROUP BY segment""",
        ),
    ),
    "shard_list": (
        shard_list,
        """SELECT source AS shard, row_number() OVER (ORDER BY md5(concat_ws('|', '42', source)), source) - 1 AS pos, count(*) OVER () AS n
           FROM (SELECT DISTINCT source FROM documents) s""",
    ),
    "split_store": (
        split_store,
        """SELECT split, split AS again, count(*) AS n
           FROM (SELECT CASE WHEN r < floor(n * 0.8::DOUBLE) THEN 'train' WHEN r < floor(n * 0.8::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split
                 FROM (SELECT row_number() OVER (ORDER BY md5(concat_ws('|', '7', c_custkey)), c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer) a) b
           GROUP BY split""",
    ),
    "csv_tables": (csv_tables, "SELECT c_mktsegment, count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS nations FROM customer GROUP BY 1"),
    "metric_store": (
        metric_store,
        with_fixtures(
            ["epochs"],
            """SELECT run AS seed, epoch, CASE WHEN acc > 0.5 THEN acc + 1 ELSE acc END AS acc, CASE WHEN acc > 0.5 THEN gmean END AS gmean FROM epochs""",
        ),
    ),
    "report_store": (
        report_store,
        with_fixtures(
            ["long_predictions"],
            """SELECT 'cw1.9_r8' AS run_tag, class AS seed, count(*) FILTER (WHERE prob > 0.5 AND y0 = 1) AS tp, count(*) FILTER (WHERE prob > 0.5 AND y0 = 0) AS fp,
                      count(*) FILTER (WHERE prob <= 0.5 AND y0 = 1) AS fn, count(*) FILTER (WHERE prob <= 0.5 AND y0 = 0) AS tn,
                      round(count(*) FILTER (WHERE (prob > 0.5) = (y0 = 1)) / count(*)::DOUBLE, 6) AS accuracy
               FROM (SELECT 0 AS class, p0 AS prob, y0 FROM predictions UNION ALL SELECT 1, p1, y0 FROM predictions UNION ALL SELECT 2, p2, y0 FROM predictions) x GROUP BY class""",
        ),
    ),
    "first_shards": (
        first_shards,
        """SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents
           WHERE source IN (SELECT source FROM (SELECT DISTINCT source FROM documents) s ORDER BY md5(concat_ws('|', '42', source)), source LIMIT 5)
           GROUP BY source""",
    ),
    "signal_csv": (
        signal_csv,
        """SELECT CAST(i - 1 AS INT) AS sample_idx, l AS lead_idx, CASE l WHEN 0 THEN count(*) ELSE CAST(sum(vec_id) AS BIGINT) END AS total, count(DISTINCT label) AS records
           FROM embeddings CROSS JOIN (SELECT unnest(range(1, 65)) AS i) x CROSS JOIN (SELECT 0 AS l UNION ALL SELECT 1) y GROUP BY i, l""",
    ),
}
