"""Registered queries: code assignment, usage, refitting, reconstruction error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.functions import arrays as A
from beatloom.operators import codebook as B
from beatloom.plans import fixtures as fx
from beatloom.plans.fixtures import with_fixtures
from beatloom.plans.segment_queries import _text
from beatloom.sources.tables import table

DIM = 64
DECAY, EPS, ROUNDS = 0.5, 1e-6, 3


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding")


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return B.assign(_vectors(spark, d), "embedding", fx.codebook(spark, d)).drop("embedding")


def code_assign(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).select("vec_id", "code", F.round("dist", 6).alias("dist"))


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", A.as_text(A.unit_norm_scaled(F.col("embedding")), 10_000).alias("vec"))


def code_usage(spark: SparkSession, d: str) -> DataFrame:
    return B.usage(_assigned(spark, d), fx.codebook(spark, d))


def code_usage_summary(spark: SparkSession, d: str) -> DataFrame:
    s = B.usage_summary(code_usage(spark, d))
    return s.select("codes", "used", "skewed", *[F.round(c, 6).alias(c) for c in ("perplexity", "used_pct", "ratio")])


def top_codes(spark: SparkSession, d: str) -> DataFrame:
    return B.top_codes(code_usage(spark, d), 5)


def quant_loss(spark: SparkSession, d: str) -> DataFrame:
    loss = B.quantisation_loss(_assigned(spark, d), DIM)
    return loss.select(*[F.round(c, 6).alias(c) for c in loss.columns])


def code_update(spark: SparkSession, d: str) -> DataFrame:
    state = B.start_state(fx.codebook(spark, d))
    new = B.update(state, _vectors(spark, d), "embedding", "vec_id", decay=DECAY, epsilon=EPS)
    return new.select("code", "dead", F.round("ema_n", 6).alias("ema_n"), A.as_text(F.col("vec"), 10_000).alias("vec"))


def code_fit(spark: SparkSession, d: str) -> DataFrame:
    """Three refitting rounds, then the codes' use."""
    vectors = _vectors(spark, d)
    state = B.fit(fx.codebook(spark, d), vectors, "embedding", "vec_id", ROUNDS, decay=DECAY, epsilon=EPS)
    used = B.usage(B.assign(vectors, "embedding", state), state)
    return state.join(used, "code").select("code", F.round("ema_n", 6).alias("ema_n"), "n")


def _recon(spark: SparkSession, d: str) -> DataFrame:
    """Waves and a coarse copy of them (whole numbers) as the reconstruction."""
    w = fx.waves(spark, d)
    return w.withColumn("recon", F.transform("data", lambda x: F.floor(x).cast("double")))


def recon_mse_by_lead(spark: SparkSession, d: str) -> DataFrame:
    m = B.lead_mse(_recon(spark, d), "lead_idx", "data", "recon", "original_len")
    return m.select("lead_idx", "n", F.round("mse", 6).alias("mse"), F.round("mse_unmasked", 6).alias("mse_unmasked"))


def recon_mse_summary(spark: SparkSession, d: str) -> DataFrame:
    s = B.lead_mse_summary(B.lead_mse(_recon(spark, d), "lead_idx", "data", "recon", "original_len"), "lead_idx")
    return s.select("best_lead", "worst_lead", F.round("overall", 6).alias("overall"), F.round("ratio", 6).alias("ratio"))


def huber_loss(spark: SparkSession, d: str) -> DataFrame:
    shifted = fx.waves(spark, d).withColumn("recon", F.transform("data", lambda x: x * 0.9))
    return B.huber_loss(shifted, "data", "recon", "original_len").select(F.round("loss", 6).alias("loss"))


_USE = {
    "per_code": "SELECT c.code, count(a.vec_id) AS n FROM codebook c LEFT JOIN assigned a ON a.code = c.code GROUP BY 1",
}
_UPD = {
    "cells": """
        SELECT c.code, i AS dim, c.vec[i] AS w0, count(a.vec_id) AS n, coalesce(sum(CAST(e.embedding[i] AS DOUBLE)), 0) AS s
        FROM codebook c CROSS JOIN (SELECT unnest(range(1, 65)) AS i) u LEFT JOIN assigned a ON a.code = c.code LEFT JOIN embeddings e ON e.vec_id = a.vec_id
        GROUP BY 1, 2, 3""",
    "moved": f"SELECT code, dim, {DECAY}::DOUBLE * w0 + {1 - DECAY}::DOUBLE * s AS w, {1 - DECAY}::DOUBLE * n AS raw_n FROM cells",
    "sizes": f"""
        SELECT code, (max(raw_n) + {EPS}::DOUBLE) * sum(max(raw_n)) OVER () / (sum(max(raw_n)) OVER () + count(*) OVER () * {EPS}::DOUBLE) AS n,
               0.5::DOUBLE * (SELECT count(*) FROM embeddings) / count(*) OVER () AS line FROM moved GROUP BY code""",
    "dead": "SELECT code, row_number() OVER (ORDER BY code) AS r FROM sizes WHERE n < line",
    "pool": "SELECT embedding, row_number() OVER (ORDER BY md5(concat_ws('|', '42|1', vec_id)), vec_id) AS r FROM embeddings",
}



def _nearest_sql(state: str) -> str:
    dist = "list_sum(list_transform(list_zip(e.v, s.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"SELECT vec_id, arg_min(code, ROW(dist, code)) AS code FROM (SELECT vec_id, code, {dist} AS dist FROM e CROSS JOIN {state} s) x GROUP BY vec_id"


def _round_sql(r: int) -> dict[str, str]:
    """One refitting round, from the state s<r-1> to s<r>."""
    return {
        f"a{r}": _nearest_sql(f"s{r - 1}"),
        f"c{r}": f"""
            SELECT s.code, i AS dim, {DECAY}::DOUBLE * any_value(s.w[i]) + {1 - DECAY}::DOUBLE * coalesce(sum(e.v[i]), 0) AS w,
                   {DECAY}::DOUBLE * any_value(s.n) + {1 - DECAY}::DOUBLE * count(a.vec_id) AS raw_n, count(a.vec_id) AS seen
            FROM s{r - 1} s CROSS JOIN (SELECT unnest(range(1, {DIM} + 1)) AS i) u LEFT JOIN a{r} a ON a.code = s.code LEFT JOIN e ON e.vec_id = a.vec_id GROUP BY s.code, i""",
        f"z{r}": f"""
            SELECT code, (raw_n + {EPS}::DOUBLE) * sum(raw_n) OVER () / (sum(raw_n) OVER () + count(*) OVER () * {EPS}::DOUBLE) AS n, 0.5::DOUBLE * sum(seen) OVER () / count(*) OVER () AS line
            FROM (SELECT code, max(raw_n) AS raw_n, max(seen) AS seen FROM c{r} GROUP BY code) x""",
        f"d{r}": f"SELECT code, row_number() OVER (ORDER BY code) AS at FROM z{r} WHERE n < line",
        f"p{r}": f"SELECT v, row_number() OVER (ORDER BY md5(concat_ws('|', '42|{r}', vec_id)), vec_id) AS at FROM e",
        f"s{r}": f"""
            SELECT z.code, CASE WHEN d.code IS NULL THEN k.vec ELSE p.v END AS vec, CASE WHEN d.code IS NULL THEN z.n ELSE z.line * 0.5 END AS n, CASE WHEN d.code IS NULL THEN k.w ELSE p.v END AS w
            FROM z{r} z JOIN (SELECT c.code, list(c.w / z.n ORDER BY dim) AS vec, list(c.w ORDER BY dim) AS w FROM c{r} c JOIN z{r} z ON z.code = c.code GROUP BY c.code) k ON k.code = z.code
            LEFT JOIN d{r} d ON d.code = z.code LEFT JOIN p{r} p ON p.at = d.at""",
    }


_FIT = {
    "e": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "s0": "SELECT code, vec, 0.0::DOUBLE AS n, vec AS w FROM codebook",
    **{k: v for r in range(1, ROUNDS + 1) for k, v in _round_sql(r).items()},
    "last": _nearest_sql(f"s{ROUNDS}"),
}

QUERIES = {
    "code_assign": (code_assign, with_fixtures(["assigned"], "SELECT vec_id, code, round(dist, 6) AS dist FROM assigned")),
    "unit_vectors": (
        unit_vectors,
        f"""SELECT vec_id, {_text('list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))) * sqrt(64.0::DOUBLE))', 10000)} AS vec
            FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e""",
    ),
    "code_usage": (code_usage, with_fixtures(["assigned"], "SELECT code, n FROM per_code", extra=_USE)),
    "code_usage_summary": (
        code_usage_summary,
        with_fixtures(
            ["assigned"],
            """SELECT codes, used, used > 0 AND used / perplexity > 1.5 AS skewed, round(perplexity, 6) AS perplexity, round(used * 100.0::DOUBLE / codes, 6) AS used_pct,
                      round(used / perplexity, 6) AS ratio
               FROM (SELECT count(*) AS codes, count(*) FILTER (WHERE n > 0) AS used, exp(-sum(p * ln(p + 1e-10::DOUBLE))) AS perplexity
                     FROM (SELECT n, n / greatest(sum(n) OVER (), 1)::DOUBLE AS p FROM per_code) x) y""",
            extra=_USE,
        ),
    ),
    "top_codes": (top_codes, with_fixtures(["assigned"], "SELECT code, n FROM per_code ORDER BY n DESC, code LIMIT 5", extra=_USE)),
    "quant_loss": (
        quant_loss,
        with_fixtures(
            ["assigned"],
            """SELECT round(m, 6) AS mse, round(0.25::DOUBLE * m, 6) AS ema_loss, round(1.25::DOUBLE * m, 6) AS plain_loss
               FROM (SELECT sum(dist) / (count(*) * 64) AS m FROM assigned) x""",
        ),
    ),
    "code_update": (
        code_update,
        with_fixtures(
            ["assigned"],
            f"""SELECT s.code, d.code IS NOT NULL AS dead, round(CASE WHEN d.code IS NULL THEN s.n ELSE s.line * 0.5 END, 6) AS ema_n,
                       CASE WHEN d.code IS NULL THEN v.vec ELSE {_text('CAST(p.embedding AS DOUBLE[])', 10000)} END AS vec
                FROM sizes s JOIN (SELECT m.code, string_agg(CAST(CAST(floor(m.w / z.n * 10000 + 0.5) AS BIGINT) AS VARCHAR), ',' ORDER BY m.dim) AS vec
                                   FROM moved m JOIN sizes z ON m.code = z.code GROUP BY 1) v ON s.code = v.code
                LEFT JOIN dead d ON d.code = s.code LEFT JOIN pool p ON p.r = d.r""",
            extra=_UPD,
        ),
    ),
    "code_fit": (
        code_fit,
        with_fixtures(
            ["codebook"],
            f"SELECT s.code, round(any_value(s.n), 6) AS ema_n, count(l.vec_id) AS n FROM s{ROUNDS} s LEFT JOIN last l ON l.code = s.code GROUP BY s.code",
            extra=_FIT,
        ),
    ),
    "recon_mse_by_lead": (
        recon_mse_by_lead,
        with_fixtures(
            ["waves"],
            """SELECT lead_idx, CAST(count(*) FILTER (WHERE i <= original_len) AS BIGINT) AS n,
                      round(sum(CASE WHEN i <= original_len THEN (x - floor(x)) * (x - floor(x)) ELSE 0 END) / greatest(count(*) FILTER (WHERE i <= original_len), 1), 6) AS mse,
                      round(avg((x - floor(x)) * (x - floor(x))), 6) AS mse_unmasked
               FROM (SELECT lead_idx, original_len, unnest(data) AS x, unnest(range(1, len(data) + 1)) AS i FROM waves) s GROUP BY 1""",
        ),
    ),
    "recon_mse_summary": (
        recon_mse_summary,
        with_fixtures(
            ["waves"],
            """SELECT arg_min(lead_idx, mse) AS best_lead, arg_max(lead_idx, mse) AS worst_lead, round(sum(sq) / sum(n), 6) AS overall, round(max(mse) / min(mse), 6) AS ratio
               FROM (SELECT lead_idx, sum((x - floor(x)) * (x - floor(x))) AS sq, count(*) AS n, avg((x - floor(x)) * (x - floor(x))) AS mse
                     FROM (SELECT lead_idx, unnest(data[1:original_len]) AS x FROM waves) s GROUP BY 1) t""",
        ),
    ),
    "huber_loss": (
        huber_loss,
        with_fixtures(
            ["waves"],
            """SELECT round(sum(CASE WHEN abs(e) < 1 THEN 0.5::DOUBLE * e * e ELSE abs(e) - 0.5::DOUBLE END) / (count(*) + 1e-8::DOUBLE), 6) AS loss
               FROM (SELECT x - x * 0.9::DOUBLE AS e FROM (SELECT unnest(data[1:original_len]) AS x FROM waves) a) b""",
        ),
    ),
}
