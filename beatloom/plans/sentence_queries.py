"""Registered queries: beat join, sentences, encoding, masking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom import constants as C
from beatloom.functions.arrays import ints_text
from beatloom.operators import sentences as S
from beatloom.operators.ordered import CELL
from beatloom.plans import fixtures as fx
from beatloom.plans.fixtures import REC, sql_draw, with_fixtures
from beatloom.sources.tables import table

SEGS = C.MODEL_SEGMENTS
OFFSETS = S.offsets(SEGS)
VOCAB = C.FIRST_TOKEN + C.CODEBOOK_SIZE * len(SEGS)


def beat_join(spark: SparkSession, d: str) -> DataFrame:
    beats = S.join_beats(S.placed(fx.assignments(spark, d), REC), REC, SEGS)
    tokens = F.array(*[F.col(s) for s in SEGS])
    return beats.select(*REC, "beat_idx", ints_text(tokens).alias("tokens"))


def beat_join_report(spark: SparkSession, d: str) -> DataFrame:
    beats = S.join_beats(S.placed(fx.assignments(spark, d), REC), REC, SEGS, keep_incomplete=True)
    complete = F.lit(True)
    for s in SEGS:
        complete = complete & F.col(s).isNotNull()
    return beats.agg(F.count_if(complete).alias("complete"), F.count_if(~complete).alias("dropped"))


def token_sentence_frame(spark: SparkSession, d: str, cell: int = CELL) -> DataFrame:
    rows, whole = fx.dealt_assignments(spark, d, cell)
    return S.sentences(rows, REC, OFFSETS, cell=cell, long_keys=fx.long_studies(spark, d, cell), whole=whole)


def token_sentences(spark: SparkSession, d: str, cell: int = CELL) -> DataFrame:
    """Flagship: the fixed-width token sentences of every study."""
    return token_sentence_frame(spark, d, cell).select(
        *REC, "start_pos", "num_beats", "beat_idx_start", "beat_idx_end", ints_text(S.sentence_tokens()).alias("tokens")
    )


ROLES = ["user", "assistant", "system"]


def conversation_sentences(spark: SparkSession, d: str) -> DataFrame:
    role = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")), F.lit(0)), F.lit(4)) - 1
    turns = table(spark, d, "conversations").select(
        "conv_id", F.col("turn").alias("beat_idx"), F.lit("R").alias("segment"), role.cast("int").alias("token")
    )
    return S.sentences(turns, ["conv_id"], {"R": C.FIRST_TOKEN})


def beat_sentences(spark: SparkSession, d: str) -> DataFrame:
    return conversation_sentences(spark, d).select(
        "conv_id",
        "start_pos",
        F.col("num_beats"),
        "beat_idx_start",
        "beat_idx_end",
        ints_text(F.concat(F.flatten("beat_tokens"), F.array(F.lit(C.SEP)))).alias("tokens"),
    )


def vocab_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Codebook size of a segment = highest token seen + 1, offsets from the sizes."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEGS]), F.col("segment"))
    sizes = fx.assignments(spark, d).groupBy("segment").agg((F.max("token") + 1).alias("codebook_size")).withColumn("rank", rank)
    return S.vocabulary(sizes)


def masks_types(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("num_beats")
    return token_sentence_frame(spark, d).select(
        *REC,
        "start_pos",
        ints_text(S.attention_mask(n, len(SEGS))).alias("attention_mask"),
        ints_text(S.token_types(n, len(SEGS))).alias("token_types"),
    )


def vector_placement(spark: SparkSession, d: str) -> DataFrame:
    """Two-value vectors (token, half of it) put at their token positions."""
    vec = lambda t: F.array(t.cast("double"), t / F.lit(2.0))
    placed = S.place_vectors(F.transform(F.flatten("beat_tokens"), vec), C.SENTENCE_WIDTH, 2)
    text = ints_text(F.transform(F.flatten(placed), lambda x: (x * 2).cast("int")))
    return token_sentence_frame(spark, d).select(*REC, "start_pos", text.alias("vectors"))


def masked_frame(spark: SparkSession, d: str) -> DataFrame:
    rows = token_sentence_frame(spark, d).withColumn("ids", S.sentence_tokens())
    return S.masked(rows, [*REC, "start_pos"], "ids", VOCAB)


def mlm_masking(spark: SparkSession, d: str) -> DataFrame:
    return masked_frame(spark, d).select(
        *REC,
        "start_pos",
        ints_text(F.col("masked_pos")).alias("masked_pos"),
        ints_text(F.col("masked_tokens")).alias("masked_tokens"),
        ints_text(F.col("masked_ids")).alias("masked_ids"),
    )


def masked_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Share of targets that the masked input itself still shows, PAD and SEP ignored."""
    guess = F.transform("masked_pos", lambda p: F.element_at("masked_ids", p + 1))
    pairs = F.arrays_zip(guess.alias("guess"), F.col("masked_tokens").alias("target"))
    rows = masked_frame(spark, d).select(F.explode(pairs).alias("x")).select("x.guess", "x.target")
    from beatloom.operators.metrics import masked_token_accuracy

    return masked_token_accuracy(rows, "guess", "target", [C.PAD, C.SEP])


_BEAT_SQL = {
    "complete": """
        SELECT patient_id, study_id, beat_idx, max(CASE WHEN segment = 'P' THEN token END) AS p, max(CASE WHEN segment = 'PQ' THEN token END) AS pq,
               max(CASE WHEN segment = 'QRS' THEN token END) AS qrs, max(CASE WHEN segment = 'ST' THEN token END) AS st,
               max(CASE WHEN segment = 'T' THEN token END) AS t
        FROM assignments GROUP BY 1, 2, 3 HAVING count(DISTINCT segment) = 5"""
}


def _fit_sql(seed_keys: list[str], pos: str, left: str) -> str:
    """Sentence length by keyed draw among 1, 2, 6, 8 not above what is left."""
    d = sql_draw(42, *seed_keys, pos)
    fit = f"(CASE WHEN {left} >= 8 THEN 4 WHEN {left} >= 6 THEN 3 WHEN {left} >= 2 THEN 2 ELSE 1 END)"
    return f"[1, 2, 6, 8][CAST({d} % {fit} AS INT) + 1]"


def _walk_sql(keys: list[str]) -> dict[str, str]:
    """Recursive walk over ``ordered`` (keys, pos, n): one row per sentence start."""
    k = ", ".join(keys)
    return {
        "lens": f"SELECT {k}, count(*) AS n FROM ordered GROUP BY {k}",
        "walk": f"""
            SELECT {k}, n, CAST(0 AS BIGINT) AS start_pos, CAST({_fit_sql(keys, '0', 'n')} AS BIGINT) AS len FROM lens
            UNION ALL
            SELECT {k}, n, start_pos + len, CAST({_fit_sql(keys, '(start_pos + len)', '(n - start_pos - len)')} AS BIGINT)
            FROM walk WHERE start_pos + len < n""",
    }


_SENT = {
    **_BEAT_SQL,
    "ordered": """
        SELECT *, row_number() OVER (PARTITION BY patient_id, study_id ORDER BY beat_idx) - 1 AS pos FROM complete""",
    **_walk_sql(REC),
    "sent": """
        SELECT w.patient_id, w.study_id, w.start_pos, CAST(w.len AS INT) AS num_beats, min(o.beat_idx) AS beat_idx_start, max(o.beat_idx) AS beat_idx_end,
               flatten(list([o.p + 3, o.pq + 51, o.qrs + 99, o.st + 147, o.t + 195] ORDER BY o.pos)) AS body
        FROM walk w JOIN ordered o ON w.patient_id = o.patient_id AND w.study_id = o.study_id
             AND o.pos >= w.start_pos AND o.pos < w.start_pos + w.len
        GROUP BY 1, 2, 3, 4""",
    "padded": """
        SELECT patient_id, study_id, start_pos, num_beats, beat_idx_start, beat_idx_end, body,
               list_concat(list_append(body, 1), list_transform(range(40 - len(body)), lambda i: 0)) AS ids
        FROM sent""",
}
_K = ["patient_id", "study_id", "start_pos"]
_MASKED = {
    **_SENT,
    "cells": f"""
        SELECT patient_id, study_id, start_pos, i AS spot, ids[i + 1] AS token FROM padded, LATERAL (SELECT unnest(range(41)) AS i) u""",
    "scored": f"""
        SELECT *, row_number() OVER (PARTITION BY patient_id, study_id, start_pos
                     ORDER BY CASE WHEN token IN (0, 1) THEN 1 ELSE 0 END, substr(md5(concat(base, '|score|', spot // 4)), CAST(spot % 4 * 8 + 1 AS INT), 8), spot) AS r,
               floor(CAST('0x' || substr(md5(concat(base, '|pick|', spot)), 1, 8) AS BIGINT) * 10 / 4294967296) AS kind,
               3 + CAST('0x' || substr(md5(concat(base, '|pick|', spot)), 9, 8) AS BIGINT) % {VOCAB - 3} AS fresh
        FROM (SELECT *, md5(concat_ws('|', '42', patient_id, study_id, start_pos)) AS base FROM cells) c""",
    "swapped": """
        SELECT *, CASE WHEN r > 7 THEN token WHEN kind < 8 THEN 2 WHEN kind < 9 THEN fresh ELSE token END AS shown FROM scored""",
}

_CONV = {
    "ordered": """
        SELECT conv_id, turn, CASE role WHEN 'user' THEN 3 WHEN 'assistant' THEN 4 WHEN 'system' THEN 5 ELSE 6 END AS token,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos
        FROM conversations""",
    **_walk_sql(["conv_id"]),
}

QUERIES = {
    "beat_join": (
        beat_join,
        with_fixtures(
            ["assignments"],
            "SELECT patient_id, study_id, beat_idx, concat_ws(',', p, pq, qrs, st, t) AS tokens FROM complete",
            extra=_BEAT_SQL,
        ),
    ),
    "beat_join_report": (
        beat_join_report,
        with_fixtures(
            ["assignments"],
            """SELECT count(*) FILTER (WHERE c = 5) AS complete, count(*) FILTER (WHERE c < 5) AS dropped
               FROM (SELECT count(DISTINCT segment) AS c FROM assignments GROUP BY patient_id, study_id, beat_idx) x""",
        ),
    ),
    "beat_sentences": (
        beat_sentences,
        with_fixtures(
            [],
            """SELECT w.conv_id, w.start_pos, CAST(w.len AS INT) AS num_beats, min(o.turn) AS beat_idx_start, max(o.turn) AS beat_idx_end,
                      concat(string_agg(CAST(o.token AS VARCHAR), ',' ORDER BY o.pos), ',1') AS tokens
               FROM walk w JOIN ordered o ON w.conv_id = o.conv_id AND o.pos >= w.start_pos AND o.pos < w.start_pos + w.len
               GROUP BY 1, 2, 3""",
            recursive=True,
            extra=_CONV,
        ),
    ),
    "token_sentences": (
        token_sentences,
        with_fixtures(
            ["assignments"],
            """SELECT patient_id, study_id, start_pos, num_beats, beat_idx_start, beat_idx_end, array_to_string(ids, ',') AS tokens FROM padded""",
            recursive=True,
            extra=_SENT,
        ),
    ),
    "vocab_offsets": (
        vocab_offsets,
        with_fixtures(
            ["assignments"],
            """SELECT segment, CAST(3 + coalesce(sum(k) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
                      CAST(3 + sum(k) OVER () AS BIGINT) AS vocab_size
               FROM (SELECT segment, max(token) + 1 AS k, list_position(['P', 'PQ', 'QRS', 'ST', 'T'], segment) AS r FROM assignments GROUP BY segment) x""",
        ),
    ),
    "masks_types": (
        masks_types,
        with_fixtures(
            ["assignments"],
            """SELECT patient_id, study_id, start_pos,
                      array_to_string(list_transform(range(41), lambda i: CASE WHEN i <= 5 * num_beats THEN 1 ELSE 0 END), ',') AS attention_mask,
                      array_to_string(list_transform(range(41), lambda i: CASE WHEN i < 5 * num_beats THEN i // 5 WHEN i = 5 * num_beats THEN 8 ELSE 0 END), ',') AS token_types
               FROM sent""",
            recursive=True,
            extra=_SENT,
        ),
    ),
    "vector_placement": (
        vector_placement,
        with_fixtures(
            ["assignments"],
            """SELECT patient_id, study_id, start_pos,
                      array_to_string(list_concat(flatten(list_transform(body, lambda t: [2 * t, t])), list_transform(range(82 - 2 * len(body)), lambda i: 0)), ',') AS vectors
               FROM sent""",
            recursive=True,
            extra=_SENT,
        ),
    ),
    "mlm_masking": (
        mlm_masking,
        with_fixtures(
            ["assignments"],
            """SELECT patient_id, study_id, start_pos,
                      string_agg(CAST(spot AS VARCHAR), ',' ORDER BY r) FILTER (WHERE r <= 7) AS masked_pos,
                      string_agg(CAST(token AS VARCHAR), ',' ORDER BY r) FILTER (WHERE r <= 7) AS masked_tokens,
                      string_agg(CAST(shown AS VARCHAR), ',' ORDER BY spot) AS masked_ids
               FROM swapped GROUP BY 1, 2, 3""",
            recursive=True,
            extra=_MASKED,
        ),
    ),
    "masked_accuracy": (
        masked_accuracy,
        with_fixtures(
            ["assignments"],
            """SELECT count(*) FILTER (WHERE token NOT IN (0, 1)) AS valid, count(*) FILTER (WHERE token NOT IN (0, 1) AND shown = token) AS correct,
                      round(count(*) FILTER (WHERE token NOT IN (0, 1) AND shown = token) / count(*) FILTER (WHERE token NOT IN (0, 1))::DOUBLE, 6) AS accuracy
               FROM swapped WHERE r <= 7""",
            recursive=True,
            extra=_MASKED,
        ),
    ),
}
