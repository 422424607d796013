"""Registered queries: code maps, multi-hot labels, ids, header comments, list joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.functions.arrays import ints_text
from beatloom.operators import labels as L
from beatloom.plans import fixtures as fx
from beatloom.plans.fixtures import with_fixtures
from beatloom.sources.tables import table


def _code_table(spark: SparkSession, d: str) -> DataFrame:
    """Nations as code statements: code C<key>, region as class; some codes have none."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    code = F.concat(F.lit("C"), F.col("n_nationkey").cast("string"))
    return n.filter("n_regionkey <> 4").select(code.alias("code"), F.col("r_name").alias("class"), "n_name")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the codes of their dict literal, ordered by name."""
    c = fx.coded(spark, d).withColumn("map", L.code_map(F.col("codes")))
    return c.select("doc_id", "lang", F.array_sort(F.map_keys("map")).alias("code_list"))


def code_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = fx.coded(spark, d).select("doc_id", F.concat(F.lit("C"), F.col("code2").cast("string")).alias("code"))
    return L.lookup(c, _code_table(spark, d), "code", "class").select("doc_id", "code", "class")


def code_lookup_many(spark: SparkSession, d: str) -> DataFrame:
    """Region codes of a document to all nations of the region, flattened."""
    c = fx.coded(spark, d).select("doc_id", F.array((F.col("code1") % 6).cast("int"), (F.col("code2") % 6).cast("int")).alias("code_list"))
    nations = table(spark, d, "nation").select(F.col("n_regionkey").alias("code"), F.col("n_name").alias("name"))
    return L.lookup_many(c, "doc_id", "code_list", nations, "code", "name").select("doc_id", F.array_join("names", ",").alias("names"))


def _classes(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, classs): super-class names per code, kept with repeats, unknown marked."""
    return L.lookup_many(_records(spark, d), "doc_id", "code_list", _code_table(spark, d), "code", "class").withColumnRenamed("classs", "classes")


def code_to_class(spark: SparkSession, d: str) -> DataFrame:
    """Distinct super-classes, the sub-class list with repeats, and a listed subset."""
    known = L.lookup_many(_records(spark, d), "doc_id", "code_list", _code_table(spark, d), "code", "class", default=None)
    form = L.only_listed(F.col("code_list"), ["C1", "C2", "C3", "C5", "C8", "C13"])
    both = _records(spark, d).select("doc_id", F.array_join(form, ",").alias("form")).join(known, "doc_id")
    return both.select(
        "doc_id", "form", F.array_join(L.distinct_sorted(F.col("classs")), ",").alias("super"), F.array_join("classs", ",").alias("sub")
    )


def multi_hot(spark: SparkSession, d: str) -> DataFrame:
    """Labels over the sorted classes, with the Unknown column removed and unlabelled
    records dropped."""
    c = _classes(spark, d).withColumn("classes", L.distinct_sorted(L.drop_code(F.col("classes"))))
    c = L.multi_hot_by_join(c, "doc_id", "classes", _code_table(spark, d).select("class")).filter(L.labelled(F.col("labels")))
    return c.select("doc_id", ints_text(F.col("labels")).alias("labels"))


def known_records(spark: SparkSession, d: str) -> DataFrame:
    """Records with an unknown code dropped whole."""
    c = L.without_code(_classes(spark, d), "classes")
    return c.select("doc_id", F.array_join("classes", ",").alias("classes"))


def label_profile(spark: SparkSession, d: str) -> DataFrame:
    c = _classes(spark, d).withColumn("classes", L.distinct_sorted(L.drop_code(F.col("classes"))))
    return L.multi_label_profile(c, "classes")


def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.class_counts(_classes(spark, d), "classes")


def binary_hot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id", ints_text(L.binary_hot(F.col("toxic") == 1)).alias("labels"))


def label_ids(spark: SparkSession, d: str) -> DataFrame:
    """Single-label records with their id by sorted name, by first appearance, and in a fixed list."""
    c = _classes(spark, d).withColumn("classes", L.distinct_sorted(L.drop_code(F.col("classes"))))
    one = L.single_label(c, "classes").select("doc_id", "class")
    by_name = L.with_label_ids(one, L.sorted_ids(one, "class"), "class").withColumnRenamed("label_id", "by_name")
    seen = L.first_seen_ids(one, "class", "doc_id")
    both = L.with_label_ids(by_name, seen, "class").withColumnRenamed("label_id", "by_first")
    return both.withColumn("fixed", L.fixed_ids(F.col("class"), ["ASIA", "AFRICA", "EUROPE"]))


def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return fx.coded(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n"))


def header_parse(spark: SparkSession, d: str) -> DataFrame:
    c = fx.coded(spark, d).withColumn("comments", F.array("age", "sex", "dx"))
    m = L.code_map(F.col("codes"))
    return c.select(
        "doc_id",
        L.header_value(F.col("comments"), "AGE").cast("int").alias("age"),
        F.lower(L.header_value(F.col("comments"), "sex")).alias("sex"),
        F.array_join(L.header_codes(F.element_at("comments", 3)), ",").alias("dx"),
        F.array_join(F.array_sort(F.map_keys(m)), ",").alias("codes"),
        F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x).alias("likelihood"),
    )


def split_join(spark: SparkSession, d: str) -> DataFrame:
    """Order lines joined on four keys with three lists, and the same lists tagged."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", (F.col("n_chars") % 10 + 1).cast("int").alias("strat_fold"))
    keys = ["doc_id", "lang", "source", "strat_fold"]
    parts = {
        "train": docs.filter("strat_fold <= 8").withColumn("age", F.col("strat_fold") * 2),
        "val": docs.filter("strat_fold = 9").withColumn("age", F.col("strat_fold") * 2),
        "test": docs.filter("strat_fold = 10").withColumn("age", F.col("strat_fold") * 2),
    }
    labelled = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return L.join_lists(labelled, parts, keys).select("doc_id", "lang", "strat_fold", "quality", "age", "split")


def split_join_renamed(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels").withColumnRenamed("doc_id", "file_id")
    parts = {0: lab.filter("toxic = 0 AND quality = 1"), 1: lab.filter("toxic = 0 AND quality = 0"), 2: lab.filter("toxic = 1")}
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return L.join_renamed(docs, "doc_id", parts, "file_id").select("doc_id", "lang", "tag")


def union_common(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "labels")
    b = table(spark, d, "documents").select("doc_id", F.lit(0).alias("toxic"), "lang")
    return L.union_common([a, b])


def class_columns(spark: SparkSession, d: str) -> DataFrame:
    """Class columns are all columns that are not in the fixed list; sum each of them."""
    lab = table(spark, d, "labels")
    names = L.class_columns(lab.columns, ["doc_id"])
    return lab.agg(*[F.sum(F.col(c).cast("bigint")).alias(c) for c in names])


_CODES = {
    "code_table": """
        SELECT concat('C', n_nationkey) AS code, r_name AS class FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey <> 4""",
    # A dict keeps one entry per key, so a repeated code counts once.
    "codes": """
        SELECT doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY code) AS pos
        FROM (SELECT doc_id, concat('C', code1) AS code FROM coded UNION SELECT doc_id, concat('C', code2) FROM coded) u""",
    "mapped": """
        SELECT c.doc_id, c.code, c.pos, t.class FROM codes c LEFT JOIN code_table t ON c.code = t.code""",
    "sets": """
        SELECT doc_id, list(DISTINCT class ORDER BY class) FILTER (WHERE class IS NOT NULL) AS classes, count(DISTINCT class) AS k FROM mapped GROUP BY doc_id""",
}

QUERIES = {
    "code_lookup": (
        code_lookup,
        with_fixtures(
            ["coded"],
            """SELECT doc_id, concat('C', code2) AS code, coalesce(class, 'Unknown') AS class FROM coded LEFT JOIN code_table ON code_table.code = concat('C', code2)""",
            extra={"code_table": _CODES["code_table"]},
        ),
    ),
    "code_lookup_many": (
        code_lookup_many,
        with_fixtures(
            ["coded"],
            """SELECT doc_id, string_agg(coalesce(n_name, 'Unknown'), ',' ORDER BY pos, n_name) AS names
               FROM (SELECT doc_id, 0 AS pos, code1 % 6 AS code FROM coded UNION ALL SELECT doc_id, 1, code2 % 6 FROM coded) x
               LEFT JOIN nation ON n_regionkey = code GROUP BY doc_id""",
        ),
    ),
    "code_to_class": (
        code_to_class,
        with_fixtures(
            ["coded"],
            """SELECT doc_id, coalesce(string_agg(code, ',' ORDER BY pos) FILTER (WHERE code IN ('C1', 'C2', 'C3', 'C5', 'C8', 'C13')), '') AS form,
                      coalesce(string_agg(DISTINCT class, ',' ORDER BY class), '') AS super, coalesce(string_agg(class, ',' ORDER BY pos), '') AS sub
               FROM mapped GROUP BY doc_id""",
            extra=_CODES,
        ),
    ),
    "multi_hot": (
        multi_hot,
        with_fixtures(
            ["coded"],
            """SELECT doc_id, array_to_string(list_transform((SELECT list(DISTINCT class ORDER BY class) FROM code_table),
                      lambda c: CASE WHEN list_contains(classes, c) THEN 1 ELSE 0 END), ',') AS labels FROM sets WHERE k > 0""",
            extra=_CODES,
        ),
    ),
    "known_records": (
        known_records,
        with_fixtures(
            ["coded"],
            """SELECT doc_id, string_agg(class, ',' ORDER BY pos) AS classes FROM mapped GROUP BY doc_id HAVING count(*) = count(class)""",
            extra=_CODES,
        ),
    ),
    "label_profile": (
        label_profile,
        with_fixtures(
            ["coded"],
            """SELECT count(*) AS records, count(*) FILTER (WHERE k > 1) AS several, count(*) FILTER (WHERE k = 0) AS none, CAST(sum(k) AS BIGINT) AS labels FROM sets""",
            extra=_CODES,
        ),
    ),
    "class_counts": (
        class_counts,
        with_fixtures(["coded"], "SELECT coalesce(class, 'Unknown') AS class, count(*) AS n FROM mapped GROUP BY 1", extra=_CODES),
    ),
    "binary_hot": (binary_hot, "SELECT doc_id, CASE WHEN toxic = 1 THEN '0,1' ELSE '1,0' END AS labels FROM labels"),
    "label_ids": (
        label_ids,
        with_fixtures(
            ["coded"],
            """SELECT doc_id, class, CAST(dense_rank() OVER (ORDER BY class) - 1 AS INT) AS by_name, CAST(dense_rank() OVER (ORDER BY first) - 1 AS INT) AS by_first,
                      CASE class WHEN 'ASIA' THEN 0 WHEN 'AFRICA' THEN 1 WHEN 'EUROPE' THEN 2 END AS fixed
               FROM (SELECT doc_id, classes[1] AS class, min(doc_id) OVER (PARTITION BY classes[1]) AS first FROM sets WHERE k = 1) x""",
            extra=_CODES,
        ),
    ),
    "value_counts": (value_counts, "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2"),
    "header_parse": (
        header_parse,
        with_fixtures(
            ["coded"],
            """SELECT c.doc_id, CAST(regexp_extract(age, '(\\d+)', 1) AS INT) AS age, lower(regexp_extract(sex, ': *(.*)$', 1)) AS sex,
                      array_to_string(regexp_extract_all(dx, '(\\d+)', 1), ',') AS dx, k.codes,
                      CASE WHEN code1 = code2 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END AS likelihood
               FROM coded c JOIN (SELECT doc_id, string_agg(code, ',' ORDER BY pos) AS codes FROM codes GROUP BY 1) k ON c.doc_id = k.doc_id""",
            extra={"codes": _CODES["codes"]},
        ),
    ),
    "split_join": (
        split_join,
        """SELECT d.doc_id, lang, CAST(n_chars % 10 + 1 AS INT) AS strat_fold, quality, CAST((n_chars % 10 + 1) * 2 AS INT) AS age,
                  CASE WHEN n_chars % 10 + 1 <= 8 THEN 'train' WHEN n_chars % 10 + 1 = 9 THEN 'val' ELSE 'test' END AS split
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "split_join_renamed": (
        split_join_renamed,
        """SELECT d.doc_id, lang, CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END AS tag FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "union_common": (union_common, "SELECT doc_id, toxic FROM labels UNION ALL SELECT doc_id, 0 FROM documents"),
    "class_columns": (class_columns, "SELECT CAST(sum(quality) AS BIGINT) AS quality, CAST(sum(toxic) AS BIGINT) AS toxic FROM labels"),
}
