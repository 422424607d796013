"""Registered queries: epoch rules, run tables, manifests, upserts, dataset checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.functions.hashing import shard_of
from beatloom.operators import quality as Q
from beatloom.operators import runs as R
from beatloom.plans import fixtures as fx
from beatloom.plans.fixtures import with_fixtures
from beatloom.sources.tables import table

PATIENCE = 6
SHARDS = 16


def trailing_mean(spark: SparkSession, d: str) -> DataFrame:
    t = R.trailing_mean(fx.epochs(spark, d), ["run"], ["auroc", "acc"])
    return t.select("run", "epoch", "full", F.round("auroc_smooth", 6).alias("auroc_smooth"), F.round("acc_smooth", 6).alias("acc_smooth"))


def best_epoch_loss(spark: SparkSession, d: str) -> DataFrame:
    b = R.best_epoch_by_loss(fx.epochs(spark, d), ["run"], "val_loss", 0.0005, PATIENCE)
    return R.value_at_best(b, "val_loss").select("run", "best_epoch", "stop_epoch", "epochs", "best_val_loss")


def best_epoch_gmean(spark: SparkSession, d: str) -> DataFrame:
    b = R.best_epoch_by_gmean(fx.epochs(spark, d), ["run"], "gmean", "auroc", PATIENCE)
    return R.value_at_best(b, "gmean").select("run", "best_epoch", "stop_epoch", "epochs", "best_gmean")


def best_epoch_smooth(spark: SparkSession, d: str) -> DataFrame:
    b = R.best_epoch_smoothed(fx.epochs(spark, d), ["run"], "auroc", "acc", 0.0007, PATIENCE)
    return b.select("run", "best_epoch", "stop_epoch", "epochs")


def _configs(spark: SparkSession, d: str) -> DataFrame:
    """Parts as run settings."""
    k, s = F.col("p_partkey"), F.col("p_size")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    return table(spark, d, "part").select(
        k,
        pick(3, "1.9", "2.2", "3.5").alias("cw"),
        F.when(k % 2 == 0, 1e-4).otherwise(1e-5).alias("lr"),
        F.when(s > 25, 8).otherwise(4).alias("r"),
        F.lit("0.1").alias("do"),
        pick(4, "0.1", "0.1", "0.2", "0.05").alias("ld"),
        F.lit(1e-4).alias("wd"),
        (s % 2 == 0).alias("all_modules"),
        F.when(k % 5 == 0, "val_loss").otherwise("gmean").alias("ck"),
        pick(2, "0.1", "0.5").alias("hf"),
        F.when(k % 7 == 0, 32).otherwise(16).alias("a"),
        F.when(k % 4 > 0, (k % 4).cast("int")).alias("fold"),
        F.when(k % 3 == 0, "repeat").otherwise("unique").alias("dup"),
    )


def run_tags(spark: SparkSession, d: str) -> DataFrame:
    tagged = _configs(spark, d).select("p_partkey", R.run_tag().alias("tag"))
    return tagged.select("p_partkey", "tag", R.short_tag(F.col("tag")).alias("short"), *[c.alias(n) for n, c in R.tag_settings(F.col("tag")).items()])


def untagged_runs(spark: SparkSession, d: str) -> DataFrame:
    """Settings of runs by the names of their metric files; every third run was saved without a tag."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("metrics_"), F.when(k % 3 == 0, "").otherwise(F.concat(R.run_tag(), F.lit("_"))), F.lit("seed"), (k % 5).cast("string"))
    tag, seed = R.stem_tag(F.col("stem"))
    rows = _configs(spark, d).select(k, name.alias("stem")).select("p_partkey", tag.alias("tag"), seed.alias("seed"))
    settings = R.tag_settings(F.col("tag"))
    return rows.select("p_partkey", "tag", "seed", R.short_tag(F.col("tag")).alias("short"), settings["class_weight"].alias("class_weight"), settings["ckpt_metric"].alias("ckpt_metric"))


def run_table(spark: SparkSession, d: str) -> DataFrame:
    """All runs, best first: value at the best epoch joined with the settings in the tag."""
    e = fx.epochs(spark, d)
    best = R.best_epoch_by_gmean(e, ["run"], "gmean", "auroc", PATIENCE)
    best = R.value_at_best(R.value_at_best(best, "gmean"), "auroc")
    tags = _configs(spark, d).select(F.col("p_partkey").alias("run"), R.run_tag().alias("tag"))
    rows = best.select("run", "best_epoch", "best_gmean", "best_auroc").join(tags, "run")
    top = R.ranked_runs(rows, ["best_gmean", "best_auroc"], "run")
    return top.select("run", "best_epoch", "best_gmean", "best_auroc", "tag", R.tag_settings(F.col("tag"))["class_weight"].alias("class_weight"))


def metric_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Results of all epochs overwritten where newer ones are good; the newer ones have one
    more column."""
    e = fx.epochs(spark, d).withColumnRenamed("run", "seed")
    old = e.select("seed", "epoch", "acc")
    new = e.filter("acc > 0.4").select("seed", "epoch", (F.col("acc") + 1).alias("acc"), "gmean")
    return R.upsert(old, new, ["seed", "epoch"])


def missing_outputs(spark: SparkSession, d: str) -> DataFrame:
    fold = F.col("n_chars") % 10
    split = F.when(fold == 9, "test").when(fold == 8, "val").otherwise("train")
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id")
    have = docs.select(split.alias("split"), shard_of("doc_id", 256).alias("shard")).distinct()
    return R.missing_outputs(have, ["train", "val", "test"], 256)


def _shard_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders spread over shards by id, each order priority being a segment type."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("segment"))
    shard = shard_of("o_orderkey", SHARDS)
    idx = F.when(F.col("shard") < 12, F.floor(F.col("shard") / 4).cast("int"))
    return o.withColumn("shard", shard).withColumn("worker", F.col("shard") % 4).withColumn("shard_idx", idx)


def shard_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Statuses F and O act as two rounds of records; two shards were never recorded."""
    rows = _shard_rows(spark, d)
    keys = ["shard", "worker", "shard_idx", "segment"]
    seq = F.when(F.col("o_orderstatus") == "F", 0).otherwise(1)
    recorded = rows.filter("o_orderstatus <> 'P' AND shard < 14").groupBy(*keys, seq.alias("seq")).agg(F.count("*").alias("n_rows"))
    listed = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    return R.shard_manifest(recorded, listed).orderBy(*R.manifest_order())


def shard_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", shard_of("o_orderkey", 64).alias("shard"))


def shard_skew(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "orders").groupBy(shard_of("o_orderkey", 64).alias("shard")).agg(F.count("*").alias("n"))
    return Q.skew_report(counts)


def dataset_diff(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings against an altered copy: label 9 is gone, label 3 is off by 0.01 in
    one value, label 5 by 0.0001 in all."""
    a = table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    shift = lambda x, i: F.when((F.col("label") == 3) & (i == 7), x + 0.01).when(F.col("label") == 5, x + 0.0001).otherwise(x)
    b = a.filter("label <> 9").withColumn("embedding", F.transform("embedding", shift))
    rows = Q.diff_rows(a, b, "vec_id", "embedding", atol=1e-3)
    return Q.diff_summary(rows.join(a.select("vec_id", "label"), "vec_id"), ["label"])


def record_ids(spark: SparkSession, d: str) -> DataFrame:
    """Customers have several orders, so the position in key order is the record id."""
    return Q.numbered(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


def log_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Training log lines written from the epochs, read back, and the difference column."""
    e = fx.epochs(spark, d)
    text = lambda c: F.coalesce(c.cast("string"), F.lit("nan"))
    line = F.concat(F.lit("INFO train loss = "), text(F.col("val_loss")), F.lit(" train recon_error = "), text(F.col("gmean")), F.lit(" val loss="), text(F.col("acc")))
    logs = e.select("run", "epoch", line.alias("line"))
    out = logs.select(
        "run",
        "epoch",
        *[R.log_metric(F.col("line"), m).alias(m.replace(" ", "_")) for m in R.LOG_METRICS],
    )
    return out.withColumn("quantisation_loss", F.round(F.col("train_loss") - F.col("train_recon_error"), 6))


def _rule_sql(before: str, init: str, improved: str, keep: str) -> dict[str, str]:
    """Walk the epochs of each run one by one. ``keep`` lists the new best values."""
    cols = ", ".join(f"CASE WHEN w.stop IS NULL AND ({improved}) THEN {new} ELSE w.{name} END AS {name}" for name, new in [k.split("=") for k in keep.split(";")])
    names = ", ".join(k.split("=")[0] for k in keep.split(";"))
    return {
        "curve": before,
        "walk": f"""
            SELECT run, CAST(0 AS INT) AS epoch, {init}, CAST(NULL AS INT) AS best_epoch, 0 AS bad, CAST(NULL AS INT) AS stop FROM (SELECT DISTINCT run FROM curve) r
            UNION ALL
            SELECT w.run, c.epoch, {cols},
                   CASE WHEN w.stop IS NULL AND ({improved}) THEN c.epoch ELSE w.best_epoch END,
                   CASE WHEN w.stop IS NOT NULL THEN w.bad WHEN {improved} THEN 0 ELSE w.bad + 1 END,
                   CASE WHEN w.stop IS NOT NULL THEN w.stop WHEN {improved} THEN NULL WHEN w.bad + 1 >= {PATIENCE} THEN c.epoch END
            FROM walk w JOIN curve c ON c.run = w.run AND c.epoch = w.epoch + 1""",
        "ends": f"SELECT w.run, w.best_epoch, w.stop AS stop_epoch, n.epochs FROM walk w JOIN (SELECT run, CAST(max(epoch) AS INT) AS epochs FROM curve GROUP BY 1) n ON w.run = n.run AND w.epoch = n.epochs",
    }


_LOSS = _rule_sql(
    "SELECT run, epoch, val_loss FROM epochs", "CAST('infinity' AS DOUBLE) AS top", "w.top - c.val_loss > 0.0005::DOUBLE", "top=c.val_loss"
)
_GMEAN = _rule_sql(
    "SELECT run, epoch, gmean, auroc FROM epochs",
    "CAST('-infinity' AS DOUBLE) AS top, CAST('-infinity' AS DOUBLE) AS second",
    "coalesce(c.gmean - w.top > 0.005::DOUBLE OR (abs(c.gmean - w.top) <= 0.005::DOUBLE AND c.auroc > w.second), false)",
    "top=c.gmean;second=coalesce(c.auroc, CAST('nan' AS DOUBLE))",
)
_SMOOTH_SQL = """
    SELECT run, epoch, n = 5 AS "full", CASE WHEN ka = n THEN a END AS auroc_smooth, c AS acc_smooth
    FROM (SELECT run, epoch, count(*) OVER w AS n, count(auroc) OVER w AS ka, avg(auroc) OVER w AS a, avg(acc) OVER w AS c
          FROM epochs WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) x"""
_SMOOTH = _rule_sql(
    _SMOOTH_SQL,
    "CAST('-infinity' AS DOUBLE) AS ta, CAST('-infinity' AS DOUBLE) AS tc",
    'c."full" AND CASE WHEN c.auroc_smooth IS NULL THEN c.acc_smooth - w.tc > 0.0007::DOUBLE ELSE c.auroc_smooth - w.ta > 0.0007::DOUBLE END',
    "ta=CASE WHEN c.auroc_smooth IS NULL THEN w.ta ELSE c.auroc_smooth END;tc=CASE WHEN c.auroc_smooth IS NULL THEN c.acc_smooth ELSE w.tc END",
)
_CONF = {
    "conf": """
        SELECT p_partkey AS k, ['1.9', '2.2', '3.5'][p_partkey % 3 + 1] AS cw, CASE WHEN p_partkey % 2 = 0 THEN '1e-04' ELSE '1e-05' END AS lr,
               CASE WHEN p_size > 25 THEN '8' ELSE '4' END AS r, ['0.1', '0.1', '0.2', '0.05'][p_partkey % 4 + 1] AS ld,
               CASE WHEN p_size % 2 = 0 THEN 'all' ELSE 'attn' END AS tm, p_partkey % 5 = 0 AS vloss, ['0.1', '0.5'][p_partkey % 2 + 1] AS hf,
               CASE WHEN p_partkey % 7 = 0 THEN '32' ELSE '16' END AS a, CASE WHEN p_partkey % 4 > 0 THEN CAST(p_partkey % 4 AS VARCHAR) END AS fold,
               CASE WHEN p_partkey % 4 > 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'repeat' ELSE 'unique' END END AS dup
        FROM part""",
    "tags": """
        SELECT *, concat('cw', cw, '_lr', lr, '_r', r, '_do0.1_ld', ld, '_wd1e-04_tm', tm, CASE WHEN vloss THEN '_ckvloss' ELSE '' END,
                         CASE WHEN hf = '0.1' THEN '' ELSE '_hf' || hf END, CASE WHEN a = '16' THEN '' ELSE '_a' || a END,
                         CASE WHEN fold IS NULL THEN '' ELSE '_f' || fold END, CASE WHEN dup = 'repeat' THEN '_dupr' ELSE '' END) AS tag FROM conf""",
}
_MD5_MOD = "(SELECT list_reduce(list_prepend(0::BIGINT, list_transform(range(32), lambda i: strpos('0123456789abcdef', substr(md5(CAST({key} AS VARCHAR)), CAST(i + 1 AS INT), 1)) - 1)), lambda acc, x: (acc * 16 + x) % {n}))"


def _shard_sql(key: str, n: int) -> str:
    return f"CAST({_MD5_MOD.format(key=key, n=n)} AS INT)"


_SHARD = {
    "shards": f"""
        SELECT o_orderkey, o_orderstatus, substr(o_orderpriority, 1, 1) AS segment, shard, shard % 4 AS worker, CASE WHEN shard < 12 THEN shard // 4 END AS shard_idx
        FROM (SELECT *, {_shard_sql('o_orderkey', SHARDS)} AS shard FROM orders) x""",
}

QUERIES = {
    "trailing_mean": (
        trailing_mean,
        with_fixtures(
            ["epochs"],
            'SELECT run, epoch, "full", round(auroc_smooth, 6) AS auroc_smooth, round(acc_smooth, 6) AS acc_smooth FROM smooth',
            extra={"smooth": _SMOOTH_SQL},
        ),
    ),
    "best_epoch_loss": (
        best_epoch_loss,
        with_fixtures(
            ["epochs"],
            "SELECT e.run, best_epoch, stop_epoch, epochs, c.val_loss AS best_val_loss FROM ends e LEFT JOIN curve c ON c.run = e.run AND c.epoch = best_epoch",
            recursive=True,
            extra=_LOSS,
        ),
    ),
    "best_epoch_gmean": (
        best_epoch_gmean,
        with_fixtures(
            ["epochs"],
            "SELECT e.run, best_epoch, stop_epoch, epochs, c.gmean AS best_gmean FROM ends e LEFT JOIN curve c ON c.run = e.run AND c.epoch = best_epoch",
            recursive=True,
            extra=_GMEAN,
        ),
    ),
    "best_epoch_smooth": (
        best_epoch_smooth,
        with_fixtures(["epochs"], "SELECT run, best_epoch, stop_epoch, epochs FROM ends", recursive=True, extra=_SMOOTH),
    ),
    "run_tags": (
        run_tags,
        with_fixtures(
            [],
            """SELECT k AS p_partkey, tag,
                      concat('cw', cw, CASE WHEN lr = '1e-04' THEN '' ELSE ' lr' || lr END, CASE WHEN r = '8' THEN '' ELSE ' r' || r END,
                             CASE WHEN ld = '0.1' THEN '' ELSE ' ld' || ld END, CASE WHEN tm = 'all' THEN '' ELSE ' tm' || tm END,
                             CASE WHEN vloss THEN ' ckvloss' ELSE '' END, CASE WHEN hf = '0.1' THEN '' ELSE ' hf' || hf END, CASE WHEN a = '16' THEN '' ELSE ' a' || a END) AS short,
                      cw AS class_weight, lr, r AS lora_r, '0.1' AS dropout, ld AS lora_dropout, '1e-04' AS weight_decay, tm AS target_modules, hf AS lr_head_factor,
                      a AS lora_alpha, fold, dup AS fold_dup, CASE WHEN vloss THEN 'val_loss' ELSE 'gmean' END AS ckpt_metric FROM tags""",
            extra=_CONF,
        ),
    ),
    "untagged_runs": (
        untagged_runs,
        with_fixtures(
            [],
            """SELECT k AS p_partkey, CASE WHEN k % 3 = 0 THEN '(untagged)' ELSE tag END AS tag, CAST(k % 5 AS INT) AS seed,
                      CASE WHEN k % 3 = 0 THEN '(untagged)' ELSE concat('cw', cw, CASE WHEN lr = '1e-04' THEN '' ELSE ' lr' || lr END, CASE WHEN r = '8' THEN '' ELSE ' r' || r END,
                             CASE WHEN ld = '0.1' THEN '' ELSE ' ld' || ld END, CASE WHEN tm = 'all' THEN '' ELSE ' tm' || tm END,
                             CASE WHEN vloss THEN ' ckvloss' ELSE '' END, CASE WHEN hf = '0.1' THEN '' ELSE ' hf' || hf END, CASE WHEN a = '16' THEN '' ELSE ' a' || a END) END AS short,
                      CASE WHEN k % 3 > 0 THEN cw END AS class_weight, CASE WHEN k % 3 > 0 THEN CASE WHEN vloss THEN 'val_loss' ELSE 'gmean' END END AS ckpt_metric FROM tags""",
            extra=_CONF,
        ),
    ),
    "run_table": (
        run_table,
        with_fixtures(
            ["epochs"],
            """SELECT e.run, best_epoch, c.gmean AS best_gmean, c.auroc AS best_auroc, t.tag, t.cw AS class_weight
               FROM ends e JOIN curve c ON c.run = e.run AND c.epoch = best_epoch JOIN tags t ON t.k = e.run
               ORDER BY best_gmean DESC NULLS LAST, best_auroc DESC NULLS LAST, e.run""",
            recursive=True,
            extra={**_GMEAN, **_CONF},
        ),
    ),
    "metric_upsert": (
        metric_upsert,
        with_fixtures(
            ["epochs"],
            """SELECT run AS seed, epoch, CASE WHEN acc > 0.4 THEN acc + 1 ELSE acc END AS acc, CASE WHEN acc > 0.4 THEN gmean END AS gmean FROM epochs""",
        ),
    ),
    "missing_outputs": (
        missing_outputs,
        f"""SELECT split, CAST(shard AS INT) AS shard FROM (SELECT unnest(['train', 'val', 'test']) AS split) a CROSS JOIN (SELECT unnest(range(256)) AS shard) b
            EXCEPT SELECT CASE n_chars % 10 WHEN 9 THEN 'test' WHEN 8 THEN 'val' ELSE 'train' END, {_shard_sql('doc_id', 256)}
            FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""",
    ),
    "shard_manifest": (
        shard_manifest,
        with_fixtures(
            [],
            """SELECT shard, worker, shard_idx, segment, arg_max(n_rows, seq) AS n_rows, 'recorded' AS source
               FROM (SELECT shard, worker, shard_idx, segment, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS seq, count(*) AS n_rows FROM shards
                     WHERE o_orderstatus <> 'P' AND shard < 14 GROUP BY 1, 2, 3, 4, 5) r GROUP BY 1, 2, 3, 4
               UNION ALL SELECT shard, worker, shard_idx, segment, count(*), 'listed' FROM shards WHERE shard >= 14 GROUP BY 1, 2, 3, 4""",
            extra=_SHARD,
        ),
    ),
    "shard_ids": (shard_ids, f"SELECT o_orderkey, {_shard_sql('o_orderkey', 64)} AS shard FROM orders"),
    "shard_skew": (
        shard_skew,
        f"""SELECT max(n) AS largest, min(n) AS smallest, round(max(n) / min(n)::DOUBLE, 6) AS ratio, max(n) / min(n)::DOUBLE > 1.5 AS skewed
            FROM (SELECT {_shard_sql('o_orderkey', 64)} AS shard, count(*) AS n FROM orders GROUP BY 1) x""",
    ),
    "dataset_diff": (
        dataset_diff,
        """SELECT label, count(*) FILTER (WHERE label = 9) AS only_left, 0::BIGINT AS only_right, count(*) FILTER (WHERE label NOT IN (3, 5, 9)) AS equal,
                  count(*) FILTER (WHERE label NOT IN (3, 9)) AS within, CAST(sum(CASE label WHEN 3 THEN 1 WHEN 5 THEN 64 ELSE 0 END) AS BIGINT) AS values_differing
           FROM embeddings GROUP BY label""",
    ),
    "record_ids": (record_ids, "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS record_id FROM orders"),
    "log_metrics": (
        log_metrics,
        with_fixtures(
            ["epochs"],
            """SELECT run, epoch, gmean AS train_recon_error, val_loss AS train_loss, NULL::DOUBLE AS train_perplexity, NULL::DOUBLE AS val_recon_error, acc AS val_loss,
                      NULL::DOUBLE AS val_perplexity, round(val_loss - gmean, 6) AS quantisation_loss FROM epochs""",
        ),
    ),
}
