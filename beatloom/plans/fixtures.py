"""The data model's shapes derived from the given tables, as DataFrames and as the
same statements in SQL. Every row of the source tables takes part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from beatloom.operators.ordered import CELL, hot_keys, ranked, ranked_beside
from beatloom.sources.tables import table

REC = ["patient_id", "study_id"]


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Events as one signal per user; the position is the rank in time."""
    e = table(spark, d, "events").select(
        F.col("user_id").alias("patient_id"), F.lit(0).alias("study_id"), "event_id", "ts", "event_type", "value"
    )
    out = ranked(e, REC, ["ts", "event_id"], out="sample_idx")
    return out.select(*REC, "event_id", F.col("sample_idx").cast("int"), "event_type", "value")


def landmarks(spark: SparkSession, d: str) -> DataFrame:
    """Six landmark columns per run of 12 samples, some missing, some reversed; those behind the last
    sample of a shorter run are missing."""
    b = F.col("beat_idx")
    m = F.col("m")
    inside = lambda at: F.when(at < 12 * b + F.col("c"), at)
    return (
        samples(spark, d)
        .groupBy(*REC, F.floor(F.col("sample_idx") / 12).cast("int").alias("beat_idx"))
        .agg(F.min("event_id").cast("int").alias("m"), F.count("*").alias("c"))
        .select(
            *REC,
            "beat_idx",
            F.when(m % 11 != 0, 12 * b).alias("p_on"),
            inside(12 * b + 2).alias("p_off"),
            inside(12 * b + 4).alias("r_on"),
            inside(F.when(m % 13 == 0, 12 * b + 3).otherwise(12 * b + 6 + m % 2)).alias("r_off"),
            inside(F.when(m % 17 == 0, 12 * b + 6 + m % 2).otherwise(12 * b + 8 + m % 2)).alias("t_on"),
            inside(F.when(m % 19 != 0, 12 * b + 10 + F.when(m % 4 == 0, 1).otherwise(0))).alias("t_off"),
        )
    )


def waves(spark: SparkSession, d: str) -> DataFrame:
    """Segment-waveform rows: 12 samples per beat and three leads. A beat that
    starts with 'error' lacks lead 2, one that starts with 'signup' is blank on lead 0."""
    s = samples(spark, d)
    beats = s.groupBy(*REC, F.floor(F.col("sample_idx") / 12).cast("int").alias("beat_idx")).agg(
        F.count("*").cast("int").alias("n"),
        F.min_by("event_type", "sample_idx").alias("first_type"),
        F.transform(F.sort_array(F.collect_list(F.struct("sample_idx", "value"))), lambda x: x["value"]).alias("vals"),
    )
    rows = beats.withColumn("lead_idx", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).filter(
        ~((F.col("first_type") == "error") & (F.col("lead_idx") == 2))
    )
    blank = (F.col("first_type") == "signup") & (F.col("lead_idx") == 0)
    value = lambda x: F.when(blank, F.lit(0.0)).when(F.col("lead_idx") == 0, x).when(F.col("lead_idx") == 1, x * 0.5 - 1).otherwise(10 - x)
    return rows.select(
        *REC, "beat_idx", "lead_idx", F.when(blank, 0).otherwise(F.col("n")).alias("original_len"), F.transform("vals", value).alias("data")
    )


def beats(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as beats of a study, numbered in a fixed order."""
    return dealt_beats(spark, d)[0]


def dealt_beats(spark: SparkSession, d: str, cell: int = CELL) -> tuple[DataFrame, bool]:
    """The beats, and whether each study lies in one task."""
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "study_id")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("study_id"), F.col("o_custkey").alias("patient_id"), "o_orderstatus", "o_orderpriority", "o_totalprice"
    )
    rows, whole = ranked_beside(li.select("study_id", *order), orders, ["study_id"], order, out="beat_idx", cell=cell)
    code = lambda c: F.pmod(c.cast("int"), F.lit(48)).cast("int")
    out = rows.select(
        "patient_id",
        "study_id",
        F.col("beat_idx").cast("int"),
        F.when(F.col("l_discount") > 0, code(F.col("l_partkey"))).alias("p"),
        code(F.col("l_suppkey")).alias("pq"),
        code(F.col("l_quantity")).alias("qrs"),
        code(F.round(F.col("l_discount") * 100)).alias("st"),
        F.when(F.col("l_tax") > 0, code(F.dayofmonth("l_shipdate"))).alias("t"),
        "l_partkey",
        "l_suppkey",
        "o_orderstatus",
        "o_orderpriority",
        "o_totalprice",
    )
    return out, whole


def long_studies(spark: SparkSession, d: str, cell: int) -> DataFrame:
    """Orders with more than ``cell`` lines, from the key column alone."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("study_id"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("study_id"), F.col("o_custkey").alias("patient_id"))
    return hot_keys(li, ["study_id"], cell).join(orders, "study_id").select(*REC)


def assignments(spark: SparkSession, d: str) -> DataFrame:
    """One row per (beat, segment) that has a token; one scan for all segments."""
    return dealt_assignments(spark, d)[0]


def dealt_assignments(spark: SparkSession, d: str, cell: int = CELL) -> tuple[DataFrame, bool]:
    """The assignments, and whether each study lies in one task."""
    pairs = F.array(
        *[F.struct(F.lit(s).alias("segment"), F.col(c).alias("token")) for s, c in zip(["P", "PQ", "QRS", "ST", "T"], ["p", "pq", "qrs", "st", "t"])]
    )
    rows, whole = dealt_beats(spark, d, cell)
    out = rows.select(*REC, "beat_idx", F.explode(pairs).alias("x")).select(*REC, "beat_idx", "x.segment", "x.token").filter("token IS NOT NULL")
    return out, whole


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Sentence probabilities and record labels; the third label never occurs."""
    score = lambda a, b: ((F.col("l_partkey") * a + F.col("l_suppkey") * b + F.col("beat_idx")) % 1000) / F.lit(1000.0)
    flag = lambda c: F.when(c, 1).otherwise(0)
    return beats(spark, d).select(
        F.col("study_id").alias("record_id"),
        F.col("beat_idx").alias("sentence_id"),
        F.array(score(7919, 31), score(104729, 17), score(1299709, 13)).alias("probs"),
        F.array(
            flag(F.col("o_orderstatus") == "F"), flag(F.col("o_orderpriority").startswith("1")), flag(F.col("o_totalprice") > 1000000000)
        ).alias("labels"),
    )


def epochs(spark: SparkSession, d: str) -> DataFrame:
    """Parts as training runs of 20 epochs each; some AUROC values are missing."""
    k = F.col("p_partkey")
    part = lambda f: (k * f % 1000) / F.lit(1000.0)
    return table(spark, d, "part").select(
        F.floor(k / 20).alias("run"),
        (k % 20 + 1).cast("int").alias("epoch"),
        part(7919).alias("val_loss"),
        part(104729).alias("gmean"),
        F.when(F.floor(k / 20) % 7 != 0, part(31)).alias("auroc"),
        part(17).alias("acc"),
    )


def coded(spark: SparkSession, d: str) -> DataFrame:
    """Documents as coded records: a code dict literal and header comment lines."""
    c1 = F.substring("source", 4, 20).cast("int")
    c2 = (F.col("n_chars") % 23).cast("int")
    return table(spark, d, "documents").select(
        "doc_id",
        "lang",
        "source",
        c1.alias("code1"),
        c2.alias("code2"),
        F.concat(F.lit("{'C"), c2.cast("string"), F.lit("': 100.0, 'C"), c1.cast("string"), F.lit("': 0.0}")).alias("codes"),
        F.concat(F.lit("Dx: "), c1.cast("string"), F.lit(","), c2.cast("string")).alias("dx"),
        F.concat(F.lit("Age: "), (F.col("n_chars") % 90).cast("string")).alias("age"),
        F.concat(F.lit("Sex: "), F.when(F.col("doc_id") % 2 == 0, "Female").otherwise("Male")).alias("sex"),
    )


def supervised(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return docs.join(table(spark, d, "labels"), "doc_id")


def codebook(spark: SparkSession, d: str, size: int = 16, seed: int = 42) -> DataFrame:
    """``size`` vectors by lowest keyed hash, a few rows: a codebook's starting entries."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col("vec_id").cast("string")))
    top = table(spark, d, "embeddings").select("vec_id", "embedding", h.alias("h")).orderBy("h", "vec_id").limit(size)
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("h", "vec_id"))
    return top.select((rank - 1).cast("int").alias("code"), F.col("embedding").cast("array<double>").alias("vec"))


SQL = {
    "samples": """
        SELECT user_id AS patient_id, 0 AS study_id, event_id,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS sample_idx, event_type, value
        FROM events""",
    "landmarks": """
        SELECT patient_id, study_id, beat_idx, p_on, CASE WHEN p_off < stop THEN p_off END AS p_off, CASE WHEN r_on < stop THEN r_on END AS r_on,
               CASE WHEN r_off < stop THEN r_off END AS r_off, CASE WHEN t_on < stop THEN t_on END AS t_on, CASE WHEN t_off < stop THEN t_off END AS t_off
        FROM (SELECT patient_id, study_id, b AS beat_idx, 12*b + c AS stop,
                     CASE WHEN m % 11 = 0 THEN NULL ELSE 12*b END AS p_on, 12*b + 2 AS p_off, 12*b + 4 AS r_on,
                     CASE WHEN m % 13 = 0 THEN 12*b + 3 ELSE 12*b + 6 + m % 2 END AS r_off,
                     CASE WHEN m % 17 = 0 THEN 12*b + 6 + m % 2 ELSE 12*b + 8 + m % 2 END AS t_on,
                     CASE WHEN m % 19 = 0 THEN NULL ELSE 12*b + 10 + CASE WHEN m % 4 = 0 THEN 1 ELSE 0 END END AS t_off
              FROM (SELECT patient_id, study_id, CAST(floor(sample_idx / 12) AS INT) AS b, CAST(min(event_id) AS INT) AS m, count(*) AS c
                    FROM samples GROUP BY 1, 2, 3) x) y""",
    "waves": """
        SELECT patient_id, study_id, beat_idx, lead_idx,
               CASE WHEN first_type = 'signup' AND lead_idx = 0 THEN 0 ELSE n END AS original_len,
               list_transform(vals, lambda x: CASE WHEN first_type = 'signup' AND lead_idx = 0 THEN 0.0
                   WHEN lead_idx = 0 THEN x WHEN lead_idx = 1 THEN x * 0.5 - 1 ELSE 10 - x END::DOUBLE) AS data
        FROM (SELECT patient_id, study_id, CAST(floor(sample_idx / 12) AS INT) AS beat_idx, CAST(count(*) AS INT) AS n,
                     arg_min(event_type, sample_idx) AS first_type, list(value ORDER BY sample_idx) AS vals
              FROM samples GROUP BY 1, 2, 3) b
        CROSS JOIN (SELECT 0 AS lead_idx UNION ALL SELECT 1 UNION ALL SELECT 2) l
        WHERE NOT (first_type = 'error' AND lead_idx = 2)""",
    "beats": """
        SELECT o.o_custkey AS patient_id, l.l_orderkey AS study_id,
               CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
                    l_shipdate, l_quantity, l_discount, l_tax) - 1 AS INT) AS beat_idx,
               CASE WHEN l_discount > 0 THEN CAST(l_partkey % 48 AS INT) END AS p, CAST(l_suppkey % 48 AS INT) AS pq,
               CAST(l_quantity AS INT) % 48 AS qrs, CAST(round(l_discount * 100) AS INT) % 48 AS st,
               CASE WHEN l_tax > 0 THEN CAST(extract(day FROM l_shipdate) AS INT) % 48 END AS t,
               l_partkey, l_suppkey, o_orderstatus, o_orderpriority, o_totalprice
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "assignments": """
        SELECT patient_id, study_id, beat_idx, 'P' AS segment, p AS token FROM beats WHERE p IS NOT NULL
        UNION ALL SELECT patient_id, study_id, beat_idx, 'PQ', pq FROM beats
        UNION ALL SELECT patient_id, study_id, beat_idx, 'QRS', qrs FROM beats
        UNION ALL SELECT patient_id, study_id, beat_idx, 'ST', st FROM beats
        UNION ALL SELECT patient_id, study_id, beat_idx, 'T', t FROM beats WHERE t IS NOT NULL""",
    "predictions": """
        SELECT study_id AS record_id, beat_idx AS sentence_id,
               ((l_partkey * 7919 + l_suppkey * 31 + beat_idx) % 1000) / 1000.0::DOUBLE AS p0,
               ((l_partkey * 104729 + l_suppkey * 17 + beat_idx) % 1000) / 1000.0::DOUBLE AS p1,
               ((l_partkey * 1299709 + l_suppkey * 13 + beat_idx) % 1000) / 1000.0::DOUBLE AS p2,
               CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y0,
               CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS y1,
               CASE WHEN o_totalprice > 1000000000 THEN 1 ELSE 0 END AS y2
        FROM beats""",
    "long_predictions": """
        SELECT record_id, sentence_id, 0 AS class, p0 AS prob, y0 AS label FROM predictions
        UNION ALL SELECT record_id, sentence_id, 1, p1, y1 FROM predictions
        UNION ALL SELECT record_id, sentence_id, 2, p2, y2 FROM predictions""",
    "epochs": """
        SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS run, CAST(p_partkey % 20 + 1 AS INT) AS epoch,
               (p_partkey * 7919 % 1000) / 1000.0::DOUBLE AS val_loss, (p_partkey * 104729 % 1000) / 1000.0::DOUBLE AS gmean,
               CASE WHEN CAST(floor(p_partkey / 20) AS BIGINT) % 7 <> 0 THEN (p_partkey * 31 % 1000) / 1000.0::DOUBLE END AS auroc,
               (p_partkey * 17 % 1000) / 1000.0::DOUBLE AS acc
        FROM part""",
    "coded": """
        SELECT doc_id, lang, source, CAST(substr(source, 4) AS INT) AS code1, CAST(n_chars % 23 AS INT) AS code2,
               concat('{''C', n_chars % 23, ''': 100.0, ''C', substr(source, 4), ''': 0.0}') AS codes,
               concat('Dx: ', substr(source, 4), ',', n_chars % 23) AS dx, concat('Age: ', n_chars % 90) AS age,
               concat('Sex: ', CASE WHEN doc_id % 2 = 0 THEN 'Female' ELSE 'Male' END) AS sex
        FROM documents""",
    "supervised": """
        SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "codebook": """
        SELECT CAST(row_number() OVER (ORDER BY h, vec_id) - 1 AS INT) AS code, CAST(embedding AS DOUBLE[]) AS vec
        FROM (SELECT vec_id, embedding, md5(concat('42|', vec_id)) AS h FROM embeddings) x ORDER BY h, vec_id LIMIT 16""",
    # Squared distance of every vector to every code, and the nearest code per vector.
    "distances": """
        SELECT vec_id, label, embedding, code, list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist
        FROM embeddings CROSS JOIN codebook""",
    "assigned": """
        SELECT vec_id, any_value(label) AS label, CAST(arg_min(code, ROW(dist, code)) AS INT) AS code, min(dist) AS dist
        FROM distances GROUP BY vec_id""",
}

NEEDS = {
    "landmarks": ["samples"],
    "waves": ["samples"],
    "assignments": ["beats"],
    "predictions": ["beats"],
    "long_predictions": ["predictions"],
    "distances": ["codebook"],
    "assigned": ["distances"],
}


def with_fixtures(names: list[str], body: str, recursive: bool = False, extra: dict[str, str] | None = None) -> str:
    """``body`` with the named fixtures (and what they need) as CTEs in front."""
    order: list[str] = []

    def visit(n: str) -> None:
        for need in NEEDS.get(n, []):
            visit(need)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({SQL[n].strip()})" for n in order] + [f"{k} AS ({v.strip()})" for k, v in (extra or {}).items()]
    if not parts:
        return body.strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body.strip()


def sql_draw(seed, *keys: str) -> str:
    """The keyed draw in SQL."""
    joined = ", ".join([f"'{seed}'", *keys])
    return f"CAST(('0x' || substr(md5(concat_ws('|', {joined})), 1, 8)) AS BIGINT)"
