"""Registered queries: quality gate, bounds, waveforms, profiles, peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom import constants as C
from beatloom.functions import arrays as A
from beatloom.functions import text as T
from beatloom.operators import segments as S
from beatloom.operators.ordered import CELL, hot_keys
from beatloom.plans import fixtures as fx
from beatloom.plans.fixtures import REC, with_fixtures
from beatloom.sources.tables import table

LEADS = 3


def path_ids(spark: SparkSession, d: str) -> DataFrame:
    """Page addresses: section and number from the path, else the stem."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^([^?#]*)", 1).alias("path"))
    section = r"/(fr|de)/(\d+)"
    return pages.select(
        "page_id",
        T.path_id(F.col("path"), 1, section).alias("patient_id"),
        T.path_id(F.col("path"), 2, section).alias("study_id"),
        T.path_stem(F.col("path")).alias("stem"),
    )


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Orders as records with the state of each processing step; orders without lines are empty."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n_samples"),
        F.countDistinct("l_linenumber").alias("n_leads"),
        (F.max("l_tax") > 0.02).alias("clean_ok"),
        (F.max("l_discount") > 0.03).alias("peaks_ok"),
        F.count_if(F.col("l_quantity") > 15).alias("n_peaks"),
        (F.min("l_quantity") > 2).alias("delineate_ok"),
        F.count_if(F.col("l_returnflag") == "N").alias("n_cycles"),
    )
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") != "P").alias("read_ok"))
    filled = {"n_samples": 0, "n_leads": 0, "n_peaks": 0, "n_cycles": 0, "clean_ok": False, "peaks_ok": False, "delineate_ok": False}
    return o.join(li, "o_orderkey", "left").fillna(filled)


def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("o_orderkey", S.drop_reason(LEADS, 2).alias("reason"))


def drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    return S.reason_counts(_records(spark, d).withColumn("reason", S.drop_reason(LEADS, 2)))


def lead_complete(spark: SparkSession, d: str) -> DataFrame:
    t = S.beat_tensors(fx.waves(spark, d), REC, LEADS)
    lead = F.element_at(S.lead_subset(F.col("tensor"), [1], LEADS), 1)
    return t.select(*REC, "beat_idx", "original_len", A.as_text(lead).alias("lead_ii"), A.as_text(F.flatten("tensor")).alias("tensor"))


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("patient_id")).agg(F.count("*").cast("int").alias("n_samples")).withColumn("study_id", F.lit(0))


def _beats(spark: SparkSession, d: str, cell: int = CELL) -> DataFrame:
    return S.beat_segments(fx.landmarks(spark, d), REC, _lengths(spark, d), cell)


def beat_bounds(spark: SparkSession, d: str, cell: int = CELL) -> DataFrame:
    rows = _beats(spark, d, cell).select(*REC, "beat_idx", "kept", F.explode("segments").alias("s"))
    return rows.select(*REC, "beat_idx", "s.segment", "s.start", F.col("s.end").alias("stop"), "s.missing", "s.ok", "s.original_len", "kept")


def skipped_beats(spark: SparkSession, d: str) -> DataFrame:
    return _beats(spark, d).agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("skipped"))


def _signal(spark: SparkSession, d: str) -> DataFrame:
    return fx.samples(spark, d).select(*REC, F.lit(1).alias("lead_idx"), "sample_idx", "value")


def segment_waveforms(spark: SparkSession, d: str) -> DataFrame:
    """Normalised segments, padded to the full length; missing waves stay as zeros."""
    segs = S.segment_rows(_beats(spark, d), REC, keep_missing=True)
    rows = S.cut_samples(segs, _signal(spark, d), REC, blank_leads=[1])
    padding = F.forall(F.slice("data", F.col("original_len") + 1, F.lit(C.PAD_LENGTH)), lambda x: x == 0)
    wave = A.as_text(F.slice("data", F.lit(1), F.col("original_len")), 10_000)
    return rows.select(*REC, "beat_idx", "segment", "original_len", F.size("data").alias("padded"), padding.alias("blank_end"), wave.alias("data"))


def segment_heads(spark: SparkSession, d: str) -> DataFrame:
    """Segments longer than the target lose their end before they are normalised."""
    rows = S.cut_samples(S.segment_rows(_beats(spark, d), REC), _signal(spark, d), REC, target=2)
    return rows.select(*REC, "beat_idx", "segment", "original_len", A.as_text(F.col("data"), 10_000).alias("data"))


def segment_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Segments cut from records that are one array per lead; bounds outside a record give none."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    half = F.floor(F.size("v") / 2).cast("int")
    records = e.select("vec_id", F.posexplode(F.array(F.slice("v", F.lit(1), half), F.slice("v", half + 1, half))).alias("lead_idx", "samples"))
    b = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("beat_idx")
    start, width = F.col("beat_idx") * 7, F.col("label") + F.col("beat_idx") + 2
    bounds = e.select("vec_id", "label", b).select(
        "vec_id", "beat_idx", F.lit("S").alias("segment"), start.alias("start"), (start + width).alias("end"), F.lit(False).alias("missing"), width.cast("int").alias("original_len")
    )
    rows = S.cut_records(records, bounds, ["vec_id"], target=10, block=16)
    return rows.select("vec_id", "beat_idx", "lead_idx", "original_len", A.as_text(F.col("data"), 10_000).alias("data"))


def truncated_waves(spark: SparkSession, d: str) -> DataFrame:
    """Waves normalised at full length, then cut to the modelling length of their lead."""
    w = fx.waves(spark, d).filter("original_len > 0").withColumn("segment", F.concat(F.lit("L"), F.col("lead_idx").cast("string")))
    data = S.truncated(A.z_normalise(F.col("data")), F.col("segment"), {"L0": 3, "L1": 5, "L2": 12})
    return w.select(*REC, "beat_idx", "lead_idx", A.as_text(data, 10_000).alias("data"))


def segment_profile(spark: SparkSession, d: str) -> DataFrame:
    p = S.length_profile(S.segment_rows(_beats(spark, d), REC, keep_missing=True), "segment", "original_len", score=2)
    return p.select("segment", "zeros", "n", "longest", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p50", "p95", "p99", "score_rank")])


def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", "n_chars")
    return S.histogram(docs, "lang", "n_chars")


def mean_wave(spark: SparkSession, d: str) -> DataFrame:
    m = S.mean_wave(fx.waves(spark, d), "lead_idx", "data")
    return m.select("lead_idx", "pos", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"))


def held_waves(spark: SparkSession, d: str) -> DataFrame:
    """Each wave re-indexed to 12 positions, holding its last value."""
    w = fx.waves(spark, d).filter("original_len > 0")
    return w.select(*REC, "beat_idx", "lead_idx", A.as_text(A.hold_to(F.col("data"), F.lit(12))).alias("data"))


def amplitude_range(spark: SparkSession, d: str) -> DataFrame:
    r = S.amplitude_range(fx.waves(spark, d).filter("original_len > 0"), "lead_idx", "data")
    return r.select("lead_idx", F.round("lowest", 6).alias("lowest"), F.round("highest", 6).alias("highest"))


def detrended(spark: SparkSession, d: str, cell: int = CELL) -> DataFrame:
    c = S.detrend(_signal(spark, d), [*REC, "lead_idx"], cell=cell)
    return c.select(*REC, "sample_idx", F.round("clean", 6).alias("clean"))


def peaks(spark: SparkSession, d: str, cell: int = CELL) -> DataFrame:
    # Users with more events than a cell, from the key column alone.
    longer = hot_keys(table(spark, d, "events").select(F.col("user_id").alias("patient_id"), F.lit(0).alias("study_id")), REC, cell)
    return S.peaks(_signal(spark, d), REC, spacing=6, cell=cell, long_keys=longer)


def peak_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.enough_peaks(S.peaks(_signal(spark, d), REC), REC)


def beat_block(spark: SparkSession, d: str) -> DataFrame:
    """All leads of each record's third real beat."""
    return S.nth_beat(fx.waves(spark, d), REC, 2).select(*REC, "beat_idx", "lead_idx", A.as_text(F.col("data")).alias("data"))


def boundary_pairs(spark: SparkSession, d: str) -> DataFrame:
    """PQ and ST bounds per run of 64 beats as arrays, missing ones stripped."""
    lm = fx.landmarks(spark, d).withColumn("run", F.floor(F.col("beat_idx") / 64))
    cols = ["p_on", "p_off", "r_on", "r_off", "t_on"]
    packed = lm.groupBy(*REC, "run").agg(F.sort_array(F.collect_list(F.struct("beat_idx", *cols))).alias("x"))
    arr = lambda c: F.transform("x", lambda s: s[c])
    text = lambda pairs: F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["s"].cast("string"), p["e"].cast("string"))), ",")
    return packed.select(
        *REC,
        "run",
        text(A.boundary_pairs(arr("p_on"), arr("p_off"))).alias("p"),
        text(A.boundary_pairs(arr("r_off"), arr("t_on"))).alias("st"),
        A.ints_text(A.strip_nan(A.doubles(arr("p_on")))).alias("p_onsets"),
    )


_NUM = "list_transform({a}, lambda x: CAST(floor(x * {s} + 0.5) AS BIGINT))"


def _text(a: str, s: int = 1000000) -> str:
    return f"array_to_string({_NUM.format(a=a, s=s)}, ',')"


_GATE = {
    "li": """
        SELECT l_orderkey, count(*) AS n_samples, count(DISTINCT l_linenumber) AS n_leads, max(l_tax) > 0.02 AS clean_ok, max(l_discount) > 0.03 AS peaks_ok,
               count(*) FILTER (WHERE l_quantity > 15) AS n_peaks, min(l_quantity) > 2 AS delineate_ok, count(*) FILTER (WHERE l_returnflag = 'N') AS n_cycles
        FROM lineitem GROUP BY 1""",
    "gate": """
        SELECT o_orderkey, coalesce(n_cycles, 0) AS n_cycles,
               CASE WHEN o_orderstatus = 'P' THEN 'failed_read' WHEN n_samples IS NULL THEN 'empty' WHEN n_leads <> 3 THEN 'missing_12_leads'
                    WHEN NOT clean_ok THEN 'failed_cleaning' WHEN NOT peaks_ok THEN 'ecg_peaks_error' WHEN n_peaks < 2 THEN 'too_few_r_peaks'
                    WHEN NOT delineate_ok THEN 'ecg_delineate_error' WHEN n_cycles = 0 THEN 'no_beat_cycles' ELSE 'accepted' END AS reason
        FROM orders LEFT JOIN li ON l_orderkey = o_orderkey""",
}
_FULL = {
    "full_beats": """
        SELECT patient_id, study_id, beat_idx, list(data ORDER BY lead_idx) AS tensor, min(original_len) AS original_len
        FROM waves WHERE original_len > 0 GROUP BY 1, 2, 3 HAVING count(DISTINCT lead_idx) = 3""",
}
_SEG = {
    "lengths": "SELECT user_id AS patient_id, CAST(count(*) AS INT) AS n_samples FROM events GROUP BY 1",
    "paired": """
        SELECT l.*, n.p_on AS next_p_on, s.n_samples
        FROM landmarks l JOIN landmarks n ON l.patient_id = n.patient_id AND l.study_id = n.study_id AND n.beat_idx = l.beat_idx + 1
        JOIN lengths s ON l.patient_id = s.patient_id""",
    "cuts": """
        SELECT patient_id, study_id, beat_idx, n_samples, 'P' AS segment, p_on AS a, p_off AS z FROM paired
        UNION ALL SELECT patient_id, study_id, beat_idx, n_samples, 'PQ', p_off, r_on FROM paired
        UNION ALL SELECT patient_id, study_id, beat_idx, n_samples, 'QRS', r_on, r_off FROM paired
        UNION ALL SELECT patient_id, study_id, beat_idx, n_samples, 'ST', r_off, t_on FROM paired
        UNION ALL SELECT patient_id, study_id, beat_idx, n_samples, 'T', t_on, t_off FROM paired
        UNION ALL SELECT patient_id, study_id, beat_idx, n_samples, 'TP', t_off, next_p_on FROM paired""",
    "judged": """
        SELECT *, (a IS NULL OR z IS NULL OR a > z) AND beat_idx > 0 AS missing, a IS NOT NULL AND z IS NOT NULL AND a >= 0 AND z <= n_samples AND z - a >= 2 AS fits FROM cuts""",
    "bounds": """
        SELECT patient_id, study_id, beat_idx, segment, CAST(a AS INT) AS start, CAST(z AS INT) AS stop, missing, missing OR fits AS ok,
               CASE WHEN missing THEN 0 ELSE CAST(z - a AS INT) END AS original_len, bool_and(missing OR fits) OVER (PARTITION BY patient_id, study_id, beat_idx) AS kept
        FROM judged""",
    "cut": """
        SELECT b.patient_id, b.study_id, b.beat_idx, b.segment, b.original_len, list(s.value ORDER BY s.sample_idx) AS raw
        FROM bounds b JOIN samples s ON s.patient_id = b.patient_id AND s.study_id = b.study_id AND s.sample_idx >= b.start AND s.sample_idx < least(b.stop, b.start + 800)
        WHERE b.kept AND b.original_len > 0 GROUP BY 1, 2, 3, 4, 5""",
    "normal": """
        SELECT patient_id, study_id, beat_idx, segment, original_len,
               list_transform(raw, lambda x: CASE WHEN list_stddev_pop(raw) > 0 THEN (x - list_avg(raw)) / list_stddev_pop(raw) ELSE x - list_avg(raw) END) AS data
        FROM cut""",
}
_PEAK = {
    "near": """
        SELECT patient_id, study_id, sample_idx, value, max(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS l,
               max(value) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS r, avg(value) OVER p + stddev_pop(value) OVER p AS level
        FROM samples WINDOW w AS (PARTITION BY patient_id, study_id ORDER BY sample_idx), p AS (PARTITION BY patient_id, study_id)""",
    "cand": """
        SELECT patient_id, study_id, CAST(sample_idx AS BIGINT) AS sample_idx FROM near WHERE value > level AND (l IS NULL OR value > l) AND (r IS NULL OR value > r)""",
}

QUERIES = {
    "path_ids": (
        path_ids,
        """SELECT page_id, coalesce(nullif(regexp_extract(path, '/(fr|de)/([0-9]+)', 1), ''), stem) AS patient_id,
                  coalesce(nullif(regexp_extract(path, '/(fr|de)/([0-9]+)', 2), ''), stem) AS study_id, stem
           FROM (SELECT page_id, path, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '[.][^.]*$', '') AS stem
                 FROM (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS path FROM pages) a) b""",
    ),
    "quality_gate": (quality_gate, with_fixtures([], "SELECT o_orderkey, reason FROM gate", extra=_GATE)),
    "drop_reasons": (
        drop_reasons,
        with_fixtures(
            [],
            """SELECT reason, count(*) AS records, CAST(sum(CASE WHEN reason = 'accepted' THEN n_cycles ELSE 0 END) AS BIGINT) AS beats,
                      CAST(sum(CASE WHEN reason = 'accepted' THEN 0 ELSE n_cycles END) AS BIGINT) AS skipped FROM gate GROUP BY reason""",
            extra=_GATE,
        ),
    ),
    "lead_complete": (
        lead_complete,
        with_fixtures(
            ["waves"],
            f"""SELECT patient_id, study_id, beat_idx, original_len, {_text('tensor[2]')} AS lead_ii, {_text('flatten(tensor)')} AS tensor FROM full_beats""",
            extra=_FULL,
        ),
    ),
    "beat_bounds": (
        beat_bounds,
        with_fixtures(
            ["landmarks"],
            "SELECT patient_id, study_id, beat_idx, segment, start, stop, missing, ok, original_len, kept FROM bounds",
            extra={k: _SEG[k] for k in ("lengths", "paired", "cuts", "judged", "bounds")},
        ),
    ),
    "skipped_beats": (
        skipped_beats,
        with_fixtures(
            ["landmarks"],
            """SELECT count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept) AS skipped
               FROM (SELECT DISTINCT patient_id, study_id, beat_idx, kept FROM bounds) x""",
            extra={k: _SEG[k] for k in ("lengths", "paired", "cuts", "judged", "bounds")},
        ),
    ),
    "segment_waveforms": (
        segment_waveforms,
        with_fixtures(
            ["landmarks"],
            f"""SELECT patient_id, study_id, beat_idx, segment, original_len, 800 AS padded, true AS blank_end, {_text('data', 10000)} AS data FROM normal
                UNION ALL SELECT patient_id, study_id, beat_idx, segment, 0, 800, true, '' FROM bounds WHERE kept AND missing""",
            extra=_SEG,
        ),
    ),
    "segment_heads": (
        segment_heads,
        with_fixtures(
            ["landmarks"],
            f"""SELECT patient_id, study_id, beat_idx, segment, original_len, {_text('data', 10000)} AS data FROM normal""",
            extra={**_SEG, "cut": _SEG["cut"].replace("+ 800", "+ 2")},
        ),
    ),
    "segment_arrays": (
        segment_arrays,
        f"""WITH r AS (
              SELECT vec_id, CAST(lead AS INT) AS lead_idx, label, CAST(embedding AS DOUBLE[])[1 + lead * (len(embedding) // 2):(1 + lead) * (len(embedding) // 2)] AS v
              FROM embeddings CROSS JOIN (SELECT unnest([0, 1]) AS lead)
            ), c AS (
              SELECT vec_id, CAST(b AS INT) AS beat_idx, lead_idx, CAST(label + b + 2 AS INT) AS original_len, v[7 * b + 1:7 * b + least(label + b + 2, 10)] AS raw
              FROM r CROSS JOIN (SELECT unnest(range(5)) AS b) WHERE 7 * b + least(label + b + 2, 10) <= len(v)
            ), n AS (
              SELECT *, list_transform(raw, lambda x: CASE WHEN list_stddev_pop(raw) > 0 THEN (x - list_avg(raw)) / list_stddev_pop(raw) ELSE x - list_avg(raw) END) AS data FROM c
            )
            SELECT vec_id, beat_idx, lead_idx, original_len, concat({_text('data', 10000)}, repeat(',0', CAST(10 - len(data) AS INT))) AS data FROM n""",
    ),
    "truncated_waves": (
        truncated_waves,
        with_fixtures(
            ["waves"],
            f"""SELECT patient_id, study_id, beat_idx, lead_idx,
                       {_text('list_transform(data[1:CASE lead_idx WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 12 END], lambda x: CASE WHEN sd > 0 THEN (x - m) / sd ELSE 0.0 END)', 10000)} AS data
                FROM (SELECT *, list_avg(data) AS m, list_stddev_pop(data) AS sd FROM waves WHERE original_len > 0) x""",
        ),
    ),
    "segment_profile": (
        segment_profile,
        with_fixtures(
            ["landmarks"],
            """SELECT segment, count(*) FILTER (WHERE original_len = 0) AS zeros, count(v) AS n, max(v) AS longest, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std,
                      round(quantile_cont(v::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(v::DOUBLE, 0.95), 6) AS p95, round(quantile_cont(v::DOUBLE, 0.99), 6) AS p99,
                      round((count(*) FILTER (WHERE v < 2) + count(*) FILTER (WHERE v <= 2) + CASE WHEN count(*) FILTER (WHERE v = 2) > 0 THEN 1 ELSE 0 END) * 50.0::DOUBLE / count(v), 6) AS score_rank
               FROM (SELECT *, CASE WHEN original_len > 0 THEN original_len END AS v FROM bounds WHERE kept) x GROUP BY segment""",
            extra={k: _SEG[k] for k in ("lengths", "paired", "cuts", "judged", "bounds")},
        ),
    ),
    "length_histogram": (
        length_histogram,
        """SELECT lang, CAST(CASE WHEN hi = lo THEN 5 ELSE least((n_chars - lo) * 10 // (hi - lo), 9) END AS INT) AS bin, count(*) AS n
           FROM (SELECT lang, n_chars, min(n_chars) OVER (PARTITION BY lang) AS lo, max(n_chars) OVER (PARTITION BY lang) AS hi FROM documents) x GROUP BY 1, 2""",
    ),
    "mean_wave": (
        mean_wave,
        with_fixtures(
            ["waves"],
            """SELECT lead_idx, CAST(i AS INT) AS pos, round(avg(data[least(i + 1, len(data))]) * 1000, 3) AS mean, round(stddev_pop(data[least(i + 1, len(data))]) * 1000, 3) AS std
               FROM waves CROSS JOIN (SELECT unnest(range(12)) AS i) p GROUP BY 1, 2""",
        ),
    ),
    "held_waves": (
        held_waves,
        with_fixtures(
            ["waves"],
            f"""SELECT patient_id, study_id, beat_idx, lead_idx, {_text('list_transform(range(12), lambda i: data[least(i + 1, len(data))])')} AS data FROM waves WHERE original_len > 0""",
        ),
    ),
    "amplitude_range": (
        amplitude_range,
        with_fixtures(
            ["waves"],
            "SELECT lead_idx, round(min(list_min(data)), 6) AS lowest, round(max(list_max(data)), 6) AS highest FROM waves WHERE original_len > 0 GROUP BY 1",
        ),
    ),
    "detrended": (
        detrended,
        with_fixtures(
            ["samples"],
            """SELECT patient_id, study_id, sample_idx, round(value - avg(value) OVER (PARTITION BY patient_id, study_id ORDER BY sample_idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS clean
               FROM samples""",
        ),
    ),
    "peaks": (
        peaks,
        with_fixtures(
            ["samples"],
            "SELECT patient_id, study_id, sample_idx FROM kept",
            recursive=True,
            extra={
                **_PEAK,
                "follow": """SELECT a.patient_id, a.study_id, a.sample_idx, min(b.sample_idx) AS nxt FROM cand a JOIN cand b
                             ON a.patient_id = b.patient_id AND a.study_id = b.study_id AND b.sample_idx >= a.sample_idx + 6 GROUP BY 1, 2, 3""",
                "kept": """SELECT patient_id, study_id, min(sample_idx) AS sample_idx FROM cand GROUP BY 1, 2
                           UNION ALL SELECT k.patient_id, k.study_id, f.nxt FROM kept k JOIN follow f
                           ON k.patient_id = f.patient_id AND k.study_id = f.study_id AND k.sample_idx = f.sample_idx""",
            },
        ),
    ),
    "peak_counts": (
        peak_counts,
        with_fixtures(["samples"], "SELECT patient_id, study_id, count(*) AS n_peaks, count(*) >= 4 AS enough FROM cand GROUP BY 1, 2", extra=_PEAK),
    ),
    "beat_block": (
        beat_block,
        with_fixtures(
            ["waves"],
            f"""SELECT patient_id, study_id, beat_idx, lead_idx, {_text('data')} AS data
                FROM (SELECT *, dense_rank() OVER (PARTITION BY patient_id, study_id ORDER BY beat_idx) AS r FROM waves WHERE original_len > 0) x WHERE r = 3""",
        ),
    ),
    "boundary_pairs": (
        boundary_pairs,
        with_fixtures(
            ["landmarks"],
            """SELECT patient_id, study_id, CAST(beat_idx // 64 AS BIGINT) AS run,
                      coalesce(string_agg(concat_ws(':', p_on, p_off), ',' ORDER BY beat_idx) FILTER (WHERE p_on IS NOT NULL AND p_off IS NOT NULL), '') AS p,
                      coalesce(string_agg(concat_ws(':', r_off, t_on), ',' ORDER BY beat_idx) FILTER (WHERE r_off IS NOT NULL AND t_on IS NOT NULL), '') AS st,
                      coalesce(string_agg(CAST(p_on AS VARCHAR), ',' ORDER BY beat_idx) FILTER (WHERE p_on IS NOT NULL), '') AS p_onsets
               FROM landmarks GROUP BY 1, 2, 3""",
        ),
    ),
}
