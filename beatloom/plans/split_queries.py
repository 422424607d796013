"""Registered queries: splits, folds, samples, set checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.operators import splits as X
from beatloom.plans import fixtures as fx
from beatloom.plans.fixtures import with_fixtures
from beatloom.sources.tables import table

THREE = [("train", 0.8), ("val", 0.15), ("test", 0.05)]
TWO = [("train", 0.85), ("val", 0.15)]


def _patients(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"))


def patient_split(spark: SparkSession, d: str) -> DataFrame:
    return X.patient_split(_patients(spark, d), "patient_id", THREE)


def patient_split_two(spark: SparkSession, d: str) -> DataFrame:
    return X.patient_split(_patients(spark, d), "patient_id", TWO)


def split_disjoint(spark: SparkSession, d: str) -> DataFrame:
    """Rows with their patient's split: the splits must share no patient."""
    split = X.patient_split(_patients(spark, d), "patient_id", THREE)
    rows = X.propagate(table(spark, d, "orders").withColumnRenamed("o_custkey", "patient_id"), split, "patient_id")
    shared = X.overlap(rows, "patient_id").agg(F.lit("shared").alias("split"), F.lit(0).cast("bigint").alias("rows"), F.count("*").alias("patients"))
    # Per patient first, so that the distinct count works on patients, not rows.
    per = rows.groupBy("split", "patient_id").agg(F.count("*").alias("n")).groupBy("split").agg(F.sum("n").alias("rows"), F.count("*").alias("patients"))
    return per.unionByName(shared)


def _strata(spark: SparkSession, d: str) -> DataFrame:
    s = fx.supervised(spark, d)
    return s.withColumn("label", F.concat_ws("-", "source", F.col("quality").cast("string"), F.col("toxic").cast("string")))


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return X.stratified_split(_strata(spark, d), "doc_id", "label")


def stratified_missing(spark: SparkSession, d: str) -> DataFrame:
    return X.missing_labels(stratified_split(spark, d), "label")


def dedup_split(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer take the split of the customer's first order status."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    ids = X.first_label(o, "o_custkey", "o_orderstatus", ["o_orderkey"])
    split = X.stratified_split(ids, "o_custkey", "o_orderstatus", min_count=15)
    return X.propagate(o, split, "o_custkey").select("o_orderkey", "o_custkey", "split")


def official_split(spark: SparkSession, d: str) -> DataFrame:
    fold = (F.col("n_chars") % 10 + 1).cast("int")
    docs = table(spark, d, "documents").select("doc_id", fold.alias("strat_fold"), "n_chars")
    return docs.select(
        "doc_id",
        "strat_fold",
        X.official_split(F.col("strat_fold"), [9], [10]).alias("narrow"),
        X.official_split(F.col("strat_fold"), [8], [9, 10]).alias("wide"),
        X.tagged_split((F.col("n_chars") % 3).cast("int")).alias("tagged"),
    )


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """Label rows as three fixed id lists: toxic ids test, poor ones val, the rest train."""
    lab = table(spark, d, "labels")
    return X.tagged_lists(
        {
            "train": lab.filter("toxic = 0 AND quality = 1"),
            "val": lab.filter("toxic = 0 AND quality = 0"),
            "test": lab.filter("toxic = 1"),
        },
        "doc_id",
    )


def fixed_list_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    out = X.balance(X.propagate(docs, _lists(spark, d), "doc_id"), F.col("lang") == "en")
    return out.withColumn("positive_share", F.round("positive_share", 6))


def guarded_lists(spark: SparkSession, d: str) -> DataFrame:
    """Rows on the fixed lists, after the guards: no id on two lists, none on no list, and splits of the lists' sizes."""
    lists = _lists(spark, d)
    docs = X.members(table(spark, d, "documents").select("doc_id", "lang"), lists, "doc_id")
    X.require_none(X.overlap(lists, "doc_id"), "an id is on two lists")
    X.require_none(X.unlisted(docs, lists, "doc_id"), "an id is on no list")
    rows = X.propagate(docs, lists, "doc_id")
    X.require_counts(rows, {r["split"]: r["count"] for r in lists.groupBy("split").count().collect()})
    return rows.groupBy("split", "lang").agg(F.count("*").alias("n"))


def unlisted_ids(spark: SparkSession, d: str) -> DataFrame:
    return X.unlisted(table(spark, d, "documents"), _lists(spark, d), "doc_id")


def _sidecar(spark: SparkSession, d: str) -> DataFrame:
    """How often each labelled document occurs in each of three folds: 0, 1 or 2 times."""
    s = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    fold = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    return s.select("doc_id", "quality", "n_chars", fold.alias("fold")).select(
        "doc_id", "quality", "fold", ((F.col("n_chars") + F.col("fold")) % 3).cast("int").alias("n")
    )


def fold_repeat(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return X.all_fold_rows(docs, _sidecar(spark, d), "doc_id", repeat=True).select("doc_id", "lang", "fold", "copy")


def fold_unique(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return X.fold_rows(docs, _sidecar(spark, d), "doc_id", 2, repeat=False).select("doc_id", "lang", "copy")


def fold_summary(spark: SparkSession, d: str) -> DataFrame:
    return X.fold_summary(_sidecar(spark, d), "doc_id", "quality")


def fold_union_check(spark: SparkSession, d: str) -> DataFrame:
    """The union of the folds must be the training list."""
    folds = _sidecar(spark, d).filter("n > 0").select("doc_id")
    return X.same_set(folds, table(spark, d, "labels").select("doc_id"))


def train_fraction(spark: SparkSession, d: str) -> DataFrame:
    fold = (F.col("n_chars") % 10 + 1).cast("int")
    docs = table(spark, d, "documents").select("doc_id", X.official_split(fold, [9], [10]).alias("split"))
    return X.train_fraction(docs, "doc_id", 0.3)


def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    return X.sample_n(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100)


def semi_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return X.members(docs, table(spark, d, "labels").filter("toxic = 1"), "doc_id")


def id_sets(spark: SparkSession, d: str) -> DataFrame:
    """Distinct ids, their union over two tables, and the differences both ways."""
    docs = table(spark, d, "documents").select("doc_id")
    labels = table(spark, d, "labels").select("doc_id")
    convs = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"))
    s = X.sides({"docs": docs, "labels": labels, "convs": convs})
    return s.agg(
        F.count_if(F.col("docs") & ~F.col("labels")).alias("only_left"),
        F.count_if(F.col("labels") & ~F.col("docs")).alias("only_right"),
        F.count_if(F.col("convs") | F.col("labels")).alias("union_ids"),
        F.count_if("convs").alias("conv_ids"),
    )


_FLOORS = lambda a, b: f"CASE WHEN r < floor(n * {a}::DOUBLE) THEN 'train' WHEN r < floor(n * {a}::DOUBLE) + floor(n * {b}::DOUBLE) THEN 'val' ELSE 'test' END"
_PAT = {
    "shuffled": """
        SELECT patient_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', patient_id)), patient_id) - 1 AS r, count(*) OVER () AS n
        FROM (SELECT DISTINCT o_custkey AS patient_id FROM orders) x""",
    "split": f"SELECT patient_id, {_FLOORS('0.8', '0.15')} AS split FROM shuffled",
}
_STRAT = {
    "strata": "SELECT doc_id, concat_ws('-', source, quality, toxic) AS label FROM supervised",
    "split": f"""
        SELECT doc_id, label, CASE WHEN n < 10 THEN 'train' ELSE {_FLOORS('0.7', '0.1')} END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', doc_id)), doc_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n
              FROM strata) x""",
}
_LIST = {
    "lists": "SELECT doc_id, CASE WHEN toxic = 1 THEN 'test' WHEN quality = 0 THEN 'val' ELSE 'train' END AS split FROM labels",
}
_SIDE = {
    "sidecar": """
        SELECT d.doc_id, d.lang, l.quality, f AS fold, CAST((n_chars + f) % 3 AS INT) AS n
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id CROSS JOIN (SELECT unnest([1, 2, 3]) AS f) u""",
}
_OFF = "CASE WHEN n_chars % 10 + 1 = 10 THEN 'test' WHEN n_chars % 10 + 1 = 9 THEN 'val' ELSE 'train' END"

QUERIES = {
    "patient_split": (patient_split, with_fixtures([], "SELECT patient_id, split FROM split", extra=_PAT)),
    "patient_split_two": (
        patient_split_two,
        with_fixtures(
            [], "SELECT patient_id, CASE WHEN r < floor(n * 0.85::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM shuffled", extra={"shuffled": _PAT["shuffled"]}
        ),
    ),
    "split_disjoint": (
        split_disjoint,
        with_fixtures(
            [],
            """SELECT split, count(*) AS "rows", count(DISTINCT patient_id) AS patients FROM orders JOIN split ON o_custkey = patient_id GROUP BY split
               UNION ALL SELECT 'shared', 0, count(*) FROM (SELECT patient_id FROM split GROUP BY 1 HAVING count(DISTINCT split) > 1) z""",
            extra=_PAT,
        ),
    ),
    "stratified_split": (stratified_split, with_fixtures(["supervised"], "SELECT doc_id, label, split FROM split", extra=_STRAT)),
    "stratified_missing": (
        stratified_missing,
        with_fixtures(
            ["supervised"],
            """SELECT * FROM (SELECT label, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val,
                      count(*) FILTER (WHERE split = 'test') AS test FROM split GROUP BY label) x WHERE val = 0 OR test = 0""",
            extra=_STRAT,
        ),
    ),
    "dedup_split": (
        dedup_split,
        with_fixtures(
            [],
            """SELECT o.o_orderkey, o.o_custkey, s.split FROM orders o JOIN split s ON o.o_custkey = s.o_custkey""",
            extra={
                "ids": "SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS label FROM orders GROUP BY 1",
                "split": f"""
                    SELECT o_custkey, CASE WHEN n < 15 THEN 'train' ELSE {_FLOORS('0.7', '0.1')} END AS split
                    FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', o_custkey)), o_custkey) - 1 AS r,
                                 count(*) OVER (PARTITION BY label) AS n FROM ids) x""",
            },
        ),
    ),
    "official_split": (
        official_split,
        f"""SELECT doc_id, CAST(n_chars % 10 + 1 AS INT) AS strat_fold, {_OFF} AS narrow,
                  CASE WHEN n_chars % 10 + 1 >= 9 THEN 'test' WHEN n_chars % 10 + 1 = 8 THEN 'val' ELSE 'train' END AS wide,
                  CASE n_chars % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS tagged FROM documents""",
    ),
    "fixed_list_split": (
        fixed_list_split,
        with_fixtures(
            [],
            """SELECT split, count(*) AS "rows", round(avg(CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0 END), 6) AS positive_share
               FROM documents d JOIN lists l ON d.doc_id = l.doc_id GROUP BY split""",
            extra=_LIST,
        ),
    ),
    "guarded_lists": (
        guarded_lists,
        with_fixtures([], "SELECT split, lang, count(*) AS n FROM documents d JOIN lists l ON d.doc_id = l.doc_id GROUP BY 1, 2", extra=_LIST),
    ),
    "unlisted_ids": (
        unlisted_ids,
        with_fixtures([], "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM lists)", extra=_LIST),
    ),
    "fold_repeat": (
        fold_repeat,
        with_fixtures([], "SELECT doc_id, lang, fold, c AS copy FROM (SELECT *, CAST(unnest(range(1, n + 1)) AS INT) AS c FROM sidecar) x", extra=_SIDE),
    ),
    "fold_unique": (fold_unique, with_fixtures([], "SELECT doc_id, lang, 1 AS copy FROM sidecar WHERE fold = 2 AND n > 0", extra=_SIDE)),
    "fold_summary": (
        fold_summary,
        with_fixtures(
            [],
            """SELECT fold, CAST(sum(n) AS BIGINT) AS entries, count(DISTINCT doc_id) AS unique_ids, count(DISTINCT doc_id) FILTER (WHERE quality = 0) AS unique_negative,
                      count(DISTINCT doc_id) FILTER (WHERE quality = 1) AS unique_positive, max(n) AS max_repeat
               FROM sidecar WHERE n > 0 GROUP BY fold""",
            extra=_SIDE,
        ),
    ),
    "fold_union_check": (
        fold_union_check,
        with_fixtures(
            [],
            """SELECT (SELECT count(*) FROM (SELECT doc_id FROM sidecar WHERE n > 0 EXCEPT SELECT doc_id FROM labels) a) AS only_left,
                      (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM sidecar WHERE n > 0) b) AS only_right""",
            extra=_SIDE,
        ),
    ),
    "train_fraction": (
        train_fraction,
        f"""WITH docs AS (SELECT doc_id, {_OFF} AS split FROM documents),
                 tr AS (SELECT doc_id, split, row_number() OVER (ORDER BY md5(concat_ws('|', '42', doc_id)), doc_id) - 1 AS r, count(*) OVER () AS n FROM docs WHERE split = 'train')
            SELECT doc_id, split FROM tr WHERE r < floor(n * 0.3::DOUBLE) UNION ALL SELECT doc_id, split FROM docs WHERE split <> 'train'""",
    ),
    "sample_rows": (
        sample_rows,
        "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(concat_ws('|', '42', o_orderkey)), o_orderkey LIMIT 100",
    ),
    "semi_filter": (
        semi_filter,
        "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    ),
    "id_sets": (
        id_sets,
        """SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) a) AS only_left,
                  (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) b) AS only_right,
                  (SELECT count(*) FROM (SELECT conv_id FROM conversations UNION SELECT doc_id FROM labels) c) AS union_ids,
                  (SELECT count(DISTINCT conv_id) FROM conversations) AS conv_ids""",
    ),
}
