"""Registered queries: pooling, resampling, vector cleaning, kernel features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom import constants as C
from beatloom.functions import arrays as A
from beatloom.functions import pooling as P
from beatloom.operators import encoders as E
from beatloom.operators.sentences import blank_vectors, sentence_tokens
from beatloom.plans.fixtures import sql_draw, with_fixtures
from beatloom.plans.segment_queries import _text
from beatloom.plans.sentence_queries import _MASKED, _SENT, masked_frame, token_sentence_frame
from beatloom.sources.tables import table

REC = ["patient_id", "study_id"]
CHANNELS, FRAMES, STRIDE = 4, 16, 8
TAPS = [0.1, 0.2, 0.4, 0.2, 0.1]


def _vec(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _channels() -> Column:
    return F.array(*[F.slice("v", 1 + i * FRAMES, FRAMES) for i in range(CHANNELS)])


def pooled_roi(spark: SparkSession, d: str) -> DataFrame:
    start, end = F.col("label") * 60, F.col("label") * 85 + 10
    return _vec(spark, d).select("vec_id", A.as_text(P.roi_pool(_channels(), start, end, STRIDE), 10_000).alias("pooled"))


def adaptive_pool(spark: SparkSession, d: str) -> DataFrame:
    return _vec(spark, d).select("vec_id", A.as_text(P.adaptive_pool(_channels(), 10), 10_000).alias("pooled"))


def _token_vectors(tokens: pa.Array) -> pa.Array:
    """The token and a quarter of its square."""
    t = tokens.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return pa.FixedSizeListArray.from_arrays(pa.array(np.column_stack([t, t * t / 4.0]).ravel()), 2)


def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    """Two-value token vectors averaged over the real tokens of each sentence."""
    rows = token_sentence_frame(spark, d).withColumn("ids", sentence_tokens())
    pooled = P.masked_mean(_token_vectors, F.col("ids"), 2, C.PAD)
    return rows.select(*REC, "start_pos", A.as_text(pooled, 1000).alias("pooled"))


def masked_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Sum of the token values left after blanking the masked positions."""
    vec = F.transform("ids", lambda t: F.array(t.cast("double")))
    left = F.aggregate(blank_vectors(vec, F.col("masked_pos")), F.lit(0.0), lambda s, v: s + F.element_at(v, 1))
    return masked_frame(spark, d).select(*REC, "start_pos", left.cast("bigint").alias("left"))


def center_crop(spark: SparkSession, d: str) -> DataFrame:
    """Whole vectors cropped around their centre, and padded on both sides."""
    fitted = lambda n: A.as_text(A.centre_fit(F.col("v"), n), 10_000)
    return _vec(spark, d).select("vec_id", fitted(20).alias("cropped"), fitted(81).alias("padded"))


def decimate(spark: SparkSession, d: str) -> DataFrame:
    return _vec(spark, d).select("vec_id", A.as_text(A.decimate(F.col("v"), TAPS, 5), 10_000).alias("low"))


def channel_z(spark: SparkSession, d: str) -> DataFrame:
    return _vec(spark, d).select("vec_id", A.as_text(A.channel_z(F.col("v")), 10_000).alias("z"))


def vector_clean(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with a NaN and two infinities put in by position, cleaned and doubled."""
    inf = F.lit(float("inf"))
    dirty = F.transform(
        "v", lambda x, i: F.when(i == F.col("label"), F.lit(float("nan"))).when(i == F.col("label") + 10, inf).when(i == F.col("label") + 20, -inf).otherwise(x)
    )
    rows = _vec(spark, d).withColumn("dirty", dirty)
    return rows.select("vec_id", A.count_unclean(F.col("dirty")).alias("bad"), A.as_text(A.scaled(A.clean(F.col("dirty")), 2.0), 10_000).alias("vec"))


KERNELS, PROJECTED = 20, 6


def kernel_features(spark: SparkSession, d: str) -> DataFrame:
    """Random-kernel features of the embeddings seen as 4 channels of 16 samples."""
    kernels = E.random_kernels(spark, CHANNELS, FRAMES, KERNELS)
    rows = _vec(spark, d).select("vec_id", _channels().alias("signal"))
    return E.by_name("kernels")(rows, "signal", kernels).select("vec_id", A.as_text(F.col("features"), 10_000).alias("features"))


def projected_features(spark: SparkSession, d: str) -> DataFrame:
    """The same, mapped to fewer values."""
    kernels = E.random_kernels(spark, CHANNELS, FRAMES, KERNELS)
    rows = _vec(spark, d).select("vec_id", _channels().alias("signal"))
    out = E.with_kernel_features(rows, "signal", kernels, E.random_projection(spark, 2 * KERNELS, PROJECTED))
    return out.select("vec_id", A.as_text(F.col("features"), 10_000).alias("features"))


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield rows.assign(features=[[float(v[0]), float(v[-1]), float(max(v))] for v in rows["v"]])


def user_encoder(spark: SparkSession, d: str) -> DataFrame:
    """An encoder of the user's, chosen by name like the built-in one."""
    rows = E.by_name("user")(_vec(spark, d).select("vec_id", "v"), _ends)
    return rows.select("vec_id", A.as_text(F.col("features"), 10_000).alias("features"))


_V = {"e": "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"}
_CH = "[v[1:16], v[17:32], v[33:48], v[49:64]]"



def _u(what: str, *more: str) -> str:
    return f"({sql_draw(42, repr(what), 'kernel', *more)} / 4294967296.0::DOUBLE)"


def _n(*keys: str) -> str:
    radius, angle = (f"({sql_draw(42, repr(x), *keys)} / 4294967296.0::DOUBLE)" for x in ("radius", "angle"))
    return f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {radius})) * cos(2 * pi() * {angle}))"


_KERNELS = {
    "k0": f"""
        SELECT kernel, [7, 9, 11][CAST(floor({_u('length')} * 3) AS INT) + 1] AS n, {_u('subset')} AS us, {_u('dilation')} AS ud, {_u('padding')} AS up, {_u('bias')} * 2 - 1 AS bias
        FROM (SELECT unnest(range({KERNELS})) AS kernel) r""",
    "k1": f"""
        SELECT *, greatest(1, CAST(floor(pow(2.0::DOUBLE, ud * log2({FRAMES - 1}.0::DOUBLE / (n - 1)))) AS INT)) AS dilation,
               list_transform(list_sort(list_transform(range({CHANNELS}), lambda c: {{'u': {_u('channel', 'c')}, 'c': c}}))[1:CAST(floor(us * {CHANNELS}) AS INT) + 1], lambda x: x.c) AS used
        FROM k0""",
    "k2": f"""SELECT kernel, channel, place, {_n('kernel', 'channel', 'place')} AS w FROM (SELECT kernel, channel, unnest(range(n)) AS place FROM (SELECT kernel, n, unnest(used) AS channel FROM k1) a) b""",
    "k3": """
        SELECT k1.kernel, n, dilation, bias, CASE WHEN up < 0.5 THEN (n - 1) * dilation // 2 ELSE 0 END AS padding, taps
        FROM k1 JOIN (SELECT kernel, list({'c': channel, 't': place, 'w': w - m} ORDER BY channel, place) AS taps FROM (SELECT *, avg(w) OVER (PARTITION BY kernel) AS m FROM k2) x GROUP BY kernel) y USING (kernel)""",
    "resp": f"""
        SELECT vec_id, kernel, list_transform(range({FRAMES} + 2 * padding - (n - 1) * dilation), lambda s: bias + list_sum(list_transform(taps, lambda t:
            t.w * CASE WHEN s + t.t * dilation - padding BETWEEN 0 AND {FRAMES - 1} THEN v[t.c * {FRAMES} + s + t.t * dilation - padding + 1] ELSE 0 END))) AS r
        FROM e CROSS JOIN k3""",
    "feat": """SELECT vec_id, flatten(list([len(list_filter(r, lambda x: x > 0)) / len(r)::DOUBLE, list_max(r)] ORDER BY kernel)) AS f FROM resp GROUP BY vec_id""",
    "map": f"""SELECT out, list({_n("'projection'", 'out', 'feature')} / sqrt({2 * KERNELS}::DOUBLE) ORDER BY feature) AS w
        FROM (SELECT unnest(range({PROJECTED})) AS out) o CROSS JOIN (SELECT unnest(range({2 * KERNELS})) AS feature) f GROUP BY out""",
    "proj": """SELECT vec_id, list(list_sum(list_transform(list_zip(f, w), lambda z: z[1] * z[2])) ORDER BY out) AS f FROM feat CROSS JOIN map GROUP BY vec_id""",
}
_FEAT = {**_V, **{k: v for k, v in _KERNELS.items() if k not in ("map", "proj")}}

QUERIES = {
    "pooled_roi": (
        pooled_roi,
        with_fixtures(
            [],
            f"""SELECT vec_id, {_text('list_concat(list_transform(parts, lambda a: list_avg(a)), list_transform(parts, lambda a: list_max(a)))', 10000)} AS pooled
                FROM (SELECT vec_id, list_transform({_CH}, lambda ch: ch[CAST(lo + 1 AS BIGINT):CAST(hi AS BIGINT)]) AS parts
                      FROM (SELECT vec_id, v, greatest(0, (label * 12) // 8 - 2) AS lo, least(16, ceil((label * 17 + 2) / 8.0::DOUBLE) + 2) AS hi FROM e) b) c""",
            extra=_V,
        ),
    ),
    "adaptive_pool": (
        adaptive_pool,
        with_fixtures(
            [],
            f"""SELECT vec_id, {_text('list_concat(list_transform(parts, lambda a: list_avg(a)), list_transform(parts, lambda a: list_max(a)))', 10000)} AS pooled
                FROM (SELECT vec_id, flatten(list_transform({_CH}, lambda ch: list_transform(range(10),
                             lambda i: ch[(i * 16) // 10 + 1:((i + 1) * 16 + 9) // 10]))) AS parts FROM e) b""",
            extra=_V,
        ),
    ),
    "mean_pool": (
        mean_pool,
        with_fixtures(
            ["assignments"],
            f"""SELECT patient_id, study_id, start_pos,
                       {_text("[list_sum(list_append(body, 1)) / (len(body) + 1)::DOUBLE, list_sum(list_transform(list_append(body, 1), lambda t: t * t / 4.0::DOUBLE)) / (len(body) + 1)]", 1000)} AS pooled
                FROM sent""",
            recursive=True,
            extra=_SENT,
        ),
    ),
    "masked_vectors": (
        masked_vectors,
        with_fixtures(
            ["assignments"],
            """SELECT patient_id, study_id, start_pos, CAST(sum(CASE WHEN r > 7 THEN token ELSE 0 END) AS BIGINT) AS "left" FROM swapped GROUP BY 1, 2, 3""",
            recursive=True,
            extra=_MASKED,
        ),
    ),
    "center_crop": (
        center_crop,
        with_fixtures(
            [],
            f"""SELECT vec_id, {_text('v[(n - 20) // 2 + 1:(n - 20) // 2 + 20]', 10000)} AS cropped,
                       {_text('list_concat(list_transform(range((81 - n) // 2), lambda i: 0.0::DOUBLE), list_concat(v, list_transform(range(81 - n - (81 - n) // 2), lambda i: 0.0::DOUBLE)))', 10000)} AS padded
                FROM (SELECT vec_id, v, len(v) AS n FROM e) b""",
            extra=_V,
        ),
    ),
    "decimate": (
        decimate,
        with_fixtures(
            [],
            f"""SELECT vec_id, {_text('list_transform(range(0, 64, 5), lambda i: 0.1::DOUBLE * coalesce(p[i + 5], 0) + 0.2::DOUBLE * coalesce(p[i + 4], 0) + 0.4::DOUBLE * coalesce(p[i + 3], 0) + 0.2::DOUBLE * coalesce(p[i + 2], 0) + 0.1::DOUBLE * coalesce(p[i + 1], 0))', 10000)} AS low
                FROM (SELECT vec_id, list_concat([0.0::DOUBLE, 0.0::DOUBLE], v) AS p FROM e) b""",
            extra=_V,
        ),
    ),
    "channel_z": (
        channel_z,
        with_fixtures(
            [],
            f"""SELECT vec_id, {_text('list_transform(v, lambda x: (x - list_avg(v)) / (CASE WHEN list_stddev_pop(v) < 1e-8 THEN 1 ELSE list_stddev_pop(v) END + 1e-8::DOUBLE))', 10000)} AS z FROM e""",
            extra=_V,
        ),
    ),
    "vector_clean": (
        vector_clean,
        with_fixtures(
            [],
            f"""SELECT vec_id, 3 AS bad, {_text('list_transform(range(64), lambda i: CASE WHEN i IN (label, label + 10, label + 20) THEN 0 ELSE 2 * v[i + 1] END)', 10000)} AS vec FROM e""",
            extra=_V,
        ),
    ),
    "kernel_features": (kernel_features, with_fixtures([], f"SELECT vec_id, {_text('f', 10000)} AS features FROM feat", extra=_FEAT)),
    "projected_features": (projected_features, with_fixtures([], f"SELECT vec_id, {_text('f', 10000)} AS features FROM proj", extra={**_V, **_KERNELS})),
    "user_encoder": (user_encoder, with_fixtures([], f"SELECT vec_id, {_text('[v[1], v[len(v)], list_max(v)]', 10000)} AS features FROM e", extra=_V)),
}
