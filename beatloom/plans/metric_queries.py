"""Registered queries: decisions, votes, metrics, ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.functions.arrays import ints_text
from beatloom.operators import metrics as M
from beatloom.plans import fixtures as fx
from beatloom.plans.fixtures import with_fixtures

CLASSES = 3


def _logits(preds: DataFrame) -> DataFrame:
    return preds.withColumn("logits", F.transform("probs", lambda p: p * 10 - 5))


def pred_and_loss(spark: SparkSession, d: str) -> DataFrame:
    df = _logits(fx.predictions(spark, d))
    df = df.withColumn("soft", M.softmax(F.col("logits"))).withColumn("multi", M.sigmoid(F.col("logits")))
    df = df.withColumn("top", M.argmax(F.col("soft"))).withColumn("hot", M.one_hot(F.col("top"), CLASSES)).withColumn("on", M.above(F.col("multi")))
    # The label 0 is the true class here, with weights 1.0 and 1.9 for its two outcomes.
    y = F.get("labels", F.lit(0))
    p1 = F.get("multi", F.lit(0))
    counts = [F.sum(F.get("hot", F.lit(i)).cast("bigint")).alias(f"top{i}") for i in range(CLASSES)]
    counts += [F.sum(F.get("on", F.lit(i)).cast("bigint")).alias(f"on{i}") for i in range(CLASSES)]
    return df.agg(
        *counts,
        F.round(M.weighted_cross_entropy(df, F.when(y == 1, p1).otherwise(1 - p1), F.when(y == 1, 1.9).otherwise(1.0)), 6).alias("cross_entropy"),
        F.round(M.mean_bce(F.col("multi"), F.col("labels")), 6).alias("bce"),
    )


def record_vote_multi(spark: SparkSession, d: str) -> DataFrame:
    r = M.record_scores(fx.predictions(spark, d), "record_id", CLASSES)
    return r.select("record_id", "n", ints_text(F.col("votes")).alias("votes"), ints_text(F.col("pred")).alias("pred"), ints_text(F.col("labels")).alias("labels"))


def record_vote_binary(spark: SparkSession, d: str) -> DataFrame:
    r = M.record_scores(fx.predictions(spark, d), "record_id", CLASSES)
    prob = F.get("probs", F.lit(0))
    return r.select(
        "record_id",
        F.get("pred", F.lit(0)).alias("vote"),
        (prob >= 0.5).cast("int").alias("by_mean"),
        F.round(prob, 9).alias("mean_prob"),
        F.get("labels", F.lit(0)).alias("label"),
    )


def record_vote_single(spark: SparkSession, d: str) -> DataFrame:
    return M.record_class(fx.predictions(spark, d), "record_id")


def _record_long(spark: SparkSession, d: str) -> DataFrame:
    r = M.record_scores(fx.predictions(spark, d), "record_id", CLASSES)
    return M.long_scores(r)


def class_auroc(spark: SparkSession, d: str) -> DataFrame:
    r = M.class_auroc(M.long_scores(fx.predictions(spark, d)))
    return r.withColumn("auroc", F.round("auroc", 6))


def macro_auroc(spark: SparkSession, d: str) -> DataFrame:
    return M.macro_auroc(_record_long(spark, d)).withColumn("macro_auroc", F.round("macro_auroc", 6))


def macro_f1_subset_acc(spark: SparkSession, d: str) -> DataFrame:
    s = fx.predictions(spark, d).withColumn("pred", M.above(F.col("probs")))
    r = M.record_scores(fx.predictions(spark, d), "record_id", CLASSES)
    both = M.multilabel_summary(s, CLASSES).withColumn("level", F.lit("sentence")).unionByName(
        M.multilabel_summary(r, CLASSES).withColumn("level", F.lit("record"))
    )
    return both.select("level", "n", F.round("subset_accuracy", 6).alias("subset_accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    r = M.record_scores(fx.predictions(spark, d), "record_id", CLASSES)
    counts = r.agg(*M.confusion(F.get("pred", F.lit(0)), F.get("labels", F.lit(0))))
    out = M.rates(counts)
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("sensitivity", "specificity", "precision", "gmean", "f1", "accuracy")])


def seed_summary(spark: SparkSession, d: str) -> DataFrame:
    e = fx.epochs(spark, d)
    out = M.seed_summary(e, ["epoch"], ["gmean", "auroc", "acc"])
    return out.select("epoch", "seeds", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("epoch", "seeds")])


def batch_loss(spark: SparkSession, d: str) -> DataFrame:
    """Orders as batches of lines: loss weighted by batch size, per clerk status."""
    p = fx.predictions(spark, d)
    batches = p.groupBy("record_id", F.get("labels", F.lit(0)).alias("label")).agg(
        F.sum(F.floor(F.get("probs", F.lit(0)) * 1000 + 0.5)).alias("loss_sum"), F.count("*").alias("n")
    )
    out = M.weighted_loss(batches, ["label"], F.col("loss_sum"), F.col("n"))
    return out.select("label", F.round("loss", 6).alias("loss"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Three members per sentence; a member that scored 0 is absent."""
    p = fx.predictions(spark, d)
    rows = p.select("record_id", "sentence_id", F.get("labels", F.lit(0)).alias("label"), F.posexplode("probs").alias("member", "prob"))
    return rows.filter(F.col("prob") > 0)


def ensemble_probs(spark: SparkSession, d: str) -> DataFrame:
    e = M.ensemble(_members(spark, d), ["record_id", "sentence_id", "label"], "member", "prob", list(range(CLASSES)))
    return e.select("record_id", "sentence_id", "label", F.round("prob", 9).alias("prob"))


def ensemble_record_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Ensemble probability, record vote, then the confusion counts of the records."""
    e = M.ensemble(_members(spark, d), ["record_id", "sentence_id", "label"], "member", "prob", list(range(CLASSES)))
    arrays = e.select("record_id", F.array("prob").alias("probs"), F.array("label").alias("labels"))
    r = M.record_scores(arrays, "record_id", 1)
    return r.agg(*M.confusion(F.get("pred", F.lit(0)), F.get("labels", F.lit(0))))


def ensemble_gaps(spark: SparkSession, d: str) -> DataFrame:
    return M.alignment_gaps(_members(spark, d), ["record_id", "sentence_id"], "member", "prob", list(range(CLASSES)))


_REC = {
    "rec": """
        SELECT record_id, count(*) AS n, CAST(sum(CASE WHEN p0 > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS v0,
               CAST(sum(CASE WHEN p1 > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS v1, CAST(sum(CASE WHEN p2 > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS v2,
               CAST(sum(CAST(p0 AS DECIMAL(28,12))) AS DOUBLE) / count(p0) AS m0, CAST(sum(CAST(p1 AS DECIMAL(28,12))) AS DOUBLE) / count(p1) AS m1, CAST(sum(CAST(p2 AS DECIMAL(28,12))) AS DOUBLE) / count(p2) AS m2, max(y0) AS y0, max(y1) AS y1, max(y2) AS y2
        FROM predictions GROUP BY 1""",
    "voted": """
        SELECT *, CASE WHEN 2*v0 > n THEN 1 ELSE 0 END AS d0, CASE WHEN 2*v1 > n THEN 1 ELSE 0 END AS d1, CASE WHEN 2*v2 > n THEN 1 ELSE 0 END AS d2 FROM rec""",
}
_AUC = """
        SELECT class, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives,
               CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) END AS auroc
        FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY class ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
              FROM (SELECT class, prob, sum(label) AS pos, sum(1 - label) AS neg FROM long_scores GROUP BY 1, 2) g) h
        GROUP BY class"""
_MEM = {
    "members": """
        SELECT record_id, sentence_id, y0 AS label, 0 AS member, p0 AS prob FROM predictions WHERE p0 > 0
        UNION ALL SELECT record_id, sentence_id, y0, 1, p1 FROM predictions WHERE p1 > 0
        UNION ALL SELECT record_id, sentence_id, y0, 2, p2 FROM predictions WHERE p2 > 0""",
    "ens": """
        SELECT record_id, sentence_id, label, CAST(sum(CAST(prob AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS prob FROM members GROUP BY 1, 2, 3 HAVING count(*) = 3 AND count(DISTINCT member) = 3""",
}
_F1 = lambda p, y: f"coalesce(2.0::DOUBLE * sum({p} * {y}) / nullif(sum({p} + {y}), 0), 0)"

QUERIES = {
    "pred_and_loss": (
        pred_and_loss,
        with_fixtures(
            ["predictions"],
            """SELECT count(*) FILTER (WHERE top = 0) AS top0, count(*) FILTER (WHERE top = 1) AS top1, count(*) FILTER (WHERE top = 2) AS top2,
                      count(*) FILTER (WHERE s0 > 0.5) AS on0, count(*) FILTER (WHERE s1 > 0.5) AS on1, count(*) FILTER (WHERE s2 > 0.5) AS on2,
                      round(sum(w * -ln(CASE WHEN y0 = 1 THEN s0 ELSE 1 - s0 END)) / sum(w), 6) AS cross_entropy,
                      round(sum(-ln(CASE WHEN y0 = 1 THEN s0 ELSE 1 - s0 END) - ln(CASE WHEN y1 = 1 THEN s1 ELSE 1 - s1 END)
                                - ln(CASE WHEN y2 = 1 THEN s2 ELSE 1 - s2 END)) / (3 * count(*)), 6) AS bce
               FROM (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS top, CASE WHEN y0 = 1 THEN 1.9::DOUBLE ELSE 1.0::DOUBLE END AS w,
                            1 / (1 + exp(-(p0 * 10 - 5))) AS s0, 1 / (1 + exp(-(p1 * 10 - 5))) AS s1, 1 / (1 + exp(-(p2 * 10 - 5))) AS s2
                     FROM predictions) x""",
        ),
    ),
    "record_vote_multi": (
        record_vote_multi,
        with_fixtures(
            ["predictions"],
            "SELECT record_id, n, concat_ws(',', v0, v1, v2) AS votes, concat_ws(',', d0, d1, d2) AS pred, concat_ws(',', y0, y1, y2) AS labels FROM voted",
            extra=_REC,
        ),
    ),
    "record_vote_binary": (
        record_vote_binary,
        with_fixtures(
            ["predictions"],
            "SELECT record_id, d0 AS vote, CASE WHEN m0 >= 0.5 THEN 1 ELSE 0 END AS by_mean, round(m0, 9) AS mean_prob, y0 AS label FROM voted",
            extra=_REC,
        ),
    ),
    "record_vote_single": (
        record_vote_single,
        with_fixtures(
            ["predictions"],
            """SELECT record_id, class, votes, n FROM (
                 SELECT record_id, class, votes, CAST(sum(votes) OVER (PARTITION BY record_id) AS BIGINT) AS n,
                        row_number() OVER (PARTITION BY record_id ORDER BY votes DESC, class) AS r
                 FROM (SELECT record_id, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS class, count(*) AS votes
                       FROM predictions GROUP BY 1, 2) v) w WHERE r = 1""",
        ),
    ),
    "class_auroc": (
        class_auroc,
        with_fixtures(
            ["long_predictions"],
            "SELECT class, positives, negatives, round(auroc, 6) AS auroc FROM auc",
            extra={"long_scores": "SELECT class, prob, label FROM long_predictions", "auc": _AUC},
        ),
    ),
    "macro_auroc": (
        macro_auroc,
        with_fixtures(
            ["predictions"],
            "SELECT round(avg(auroc), 6) AS macro_auroc, count(auroc) AS classes FROM auc",
            extra={
                **_REC,
                "long_scores": """SELECT 0 AS class, m0 AS prob, y0 AS label FROM rec UNION ALL SELECT 1, m1, y1 FROM rec UNION ALL SELECT 2, m2, y2 FROM rec""",
                "auc": _AUC,
            },
        ),
    ),
    "macro_f1_subset_acc": (
        macro_f1_subset_acc,
        with_fixtures(
            ["predictions"],
            f"""SELECT level, count(*) AS n, round(avg(CASE WHEN d0 = y0 AND d1 = y1 AND d2 = y2 THEN 1 ELSE 0 END), 6) AS subset_accuracy,
                       round(({_F1('d0', 'y0')} + {_F1('d1', 'y1')} + {_F1('d2', 'y2')}) / 3, 6) AS macro_f1
                FROM (SELECT 'record' AS level, d0, d1, d2, y0, y1, y2 FROM voted
                      UNION ALL SELECT 'sentence', CASE WHEN p0 > 0.5 THEN 1 ELSE 0 END, CASE WHEN p1 > 0.5 THEN 1 ELSE 0 END,
                                CASE WHEN p2 > 0.5 THEN 1 ELSE 0 END, y0, y1, y2 FROM predictions) x
                GROUP BY level""",
            extra=_REC,
        ),
    ),
    "binary_metrics": (
        binary_metrics,
        with_fixtures(
            ["predictions"],
            """SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS sensitivity, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity,
                      round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision",
                      round(sqrt(coalesce(tp / nullif(tp + fn, 0), 0) * coalesce(tn / nullif(tn + fp, 0), 0)), 6) AS gmean,
                      round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
                      round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy
               FROM (SELECT count(*) FILTER (WHERE d0 = 1 AND y0 = 1) AS tp, count(*) FILTER (WHERE d0 = 1 AND y0 = 0) AS fp,
                            count(*) FILTER (WHERE d0 = 0 AND y0 = 1) AS fn, count(*) FILTER (WHERE d0 = 0 AND y0 = 0) AS tn FROM voted) c""",
            extra=_REC,
        ),
    ),
    "seed_summary": (
        seed_summary,
        with_fixtures(
            ["epochs"],
            """SELECT epoch, count(*) AS seeds, round(avg(gmean), 6) AS gmean_mean, round(stddev_pop(gmean), 6) AS gmean_std,
                      round(avg(auroc), 6) AS auroc_mean, round(stddev_pop(auroc), 6) AS auroc_std,
                      round(avg(acc), 6) AS acc_mean, round(stddev_pop(acc), 6) AS acc_std
               FROM epochs GROUP BY epoch""",
        ),
    ),
    "batch_loss": (
        batch_loss,
        with_fixtures(
            ["predictions"],
            """SELECT y0 AS label, round(sum(CAST(floor(p0 * 1000 + 0.5) AS BIGINT)) / greatest(count(*), 1), 6) AS loss FROM predictions GROUP BY 1""",
        ),
    ),
    "ensemble_probs": (
        ensemble_probs,
        with_fixtures(["predictions"], "SELECT record_id, sentence_id, label, round(prob, 9) AS prob FROM ens", extra=_MEM),
    ),
    "ensemble_record_metrics": (
        ensemble_record_metrics,
        with_fixtures(
            ["predictions"],
            """SELECT count(*) FILTER (WHERE d = 1 AND label = 1) AS tp, count(*) FILTER (WHERE d = 1 AND label = 0) AS fp,
                      count(*) FILTER (WHERE d = 0 AND label = 1) AS fn, count(*) FILTER (WHERE d = 0 AND label = 0) AS tn
               FROM (SELECT record_id, max(label) AS label, CASE WHEN 2 * count(*) FILTER (WHERE prob > 0.5) > count(*) THEN 1 ELSE 0 END AS d
                     FROM ens GROUP BY 1) r""",
            extra=_MEM,
        ),
    ),
    "ensemble_gaps": (
        ensemble_gaps,
        with_fixtures(
            ["predictions"], "SELECT record_id, sentence_id, count(DISTINCT member) AS members, count(*) AS predictions FROM members GROUP BY 1, 2 HAVING count(*) <> 3 OR count(DISTINCT member) <> 3", extra=_MEM
        ),
    ),
}
