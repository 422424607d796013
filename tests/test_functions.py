"""Array, text, hashing and pooling functions against NumPy, with edge rows."""

import datetime
import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from beatloom import constants as C
from beatloom.functions import arrays as A
from beatloom.functions import hashing as H
from beatloom.functions import pooling as P
from beatloom.functions import text as T
from beatloom.operators import labels as L
from beatloom.plans import feature_queries as FQ

RNG = np.random.default_rng(0)
SIGNALS = [RNG.normal(size=n).tolist() for n in (2, 3, 17, 40)] + [[5.0] * 9, [1.0], []]


def values(spark, rows, expr, ddl="v array<double>"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {ddl}")
    return [r["x"] for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def z(a):
    a = np.array(a)
    return (a - a.mean()) / a.std() if a.std() > 0 else a - a.mean()


def test_z_normalise(spark):
    got = values(spark, [(s,) for s in SIGNALS], A.z_normalise(F.col("v")))
    for s, g in zip(SIGNALS, got):
        assert np.allclose(g, z(s) if s else [], atol=1e-12)


def test_channel_z(spark):
    got = values(spark, [(s,) for s in SIGNALS], A.channel_z(F.col("v")))
    for s, g in zip(SIGNALS, got):
        if s:
            sd = np.std(s)
            sd = 1.0 if sd < 1e-8 else sd
            assert np.allclose(g, (np.array(s) - np.mean(s)) / (sd + 1e-8))
    bad = values(spark, [([1.0, float("nan")],)], A.channel_z(F.col("v")))[0]
    assert abs(bad[0] - 1.0) < 1e-6 and math.isnan(bad[1])


@pytest.mark.parametrize("target", [4, 12])
def test_cut_normalise_pad(spark, target):
    sig = RNG.normal(size=20).tolist()
    bounds = [(0, 2), (3, 3), (5, 4), (None, 4), (2, None), (-1, 5), (15, 20), (15, 21), (4, 5), (2, 18), (0, 20)]
    rows = [(sig, a, b) for a, b in bounds]
    got = values(spark, rows, A.cut_normalise_pad(F.col("v"), F.col("a"), F.col("b"), target), "v array<double>, a int, b int")
    for (a, b), g in zip(bounds, got):
        if a is None or b is None or a < 0 or b > 20 or b - a < 2:
            assert g is None
        else:
            want = np.zeros(target)
            part = z(sig[a:b][:target])
            want[: len(part)] = part
            assert g["original_len"] == b - a and np.allclose(g["data"], want)


def test_fitting_and_holding(spark):
    rows = [(s,) for s in SIGNALS if s]
    for n in (1, 8, 25):
        for s, g in zip([r[0] for r in rows], values(spark, rows, A.centre_fit(F.col("v"), n))):
            if len(s) >= n:
                lo = (len(s) - n) // 2
                want = s[lo : lo + n]
            else:
                left = (n - len(s)) // 2
                want = [0.0] * left + s + [0.0] * (n - len(s) - left)
            assert g == want
        for s, g in zip([r[0] for r in rows], values(spark, rows, A.hold_to(F.col("v"), F.lit(n)))):
            assert np.allclose(g, np.interp(np.arange(n), np.arange(len(s)), s))
        for s, g in zip([r[0] for r in rows], values(spark, rows, A.fit(F.col("v"), n))):
            assert g == (s + [0.0] * n)[:n]


def test_decimate(spark):
    taps = [0.25, 0.5, 0.25]
    for s, g in zip(SIGNALS, values(spark, [(s,) for s in SIGNALS], A.decimate(F.col("v"), taps, 5))):
        want = np.convolve(s, taps, "same")[::5] if len(s) >= len(taps) else [np.convolve(s, taps)[1]][: 1 if s else 0] if s else []
        assert np.allclose(g, want)


def test_cleaning(spark):
    row = [([1.0, float("nan"), float("inf"), -float("inf"), 2.0],)]
    assert values(spark, row, A.clean(F.col("v")))[0] == [1.0, 0.0, 0.0, 0.0, 2.0]
    assert values(spark, row, A.count_unclean(F.col("v")))[0] == 3
    assert values(spark, [([1.0, float("nan"), None, 3.0],)], A.strip_nan(F.col("v")))[0] == [1, 3]
    got = values(spark, [([3.0, 4.0],), ([0.0, 0.0],)], A.unit_norm_scaled(F.col("v")))
    assert np.allclose(got[0], np.array([0.6, 0.8]) * math.sqrt(2)) and got[1] == [0.0, 0.0]


def test_shard_of_is_the_full_digest(spark):
    keys = [str(i * 37) for i in range(60)]
    for n in (1, 4, 64, 1000003):
        got = values(spark, [(k,) for k in keys], H.shard_of("v", n), "v string")
        assert got == [int(hashlib.md5(k.encode()).hexdigest(), 16) % n for k in keys]


def test_draw(spark):
    got = values(spark, [("a", 1), ("b", 2)], H.draw(42, "v", "w"), "v string, w int")
    assert got == [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in ("42|a|1", "42|b|2")]


def test_paths(spark):
    rows = [("x/p12/s345/678.csv",), ("x/record.v2.csv",), ("record",), ("a/p1/s/2.csv",)]
    assert values(spark, rows, T.path_id(F.col("v"), 1), "v string") == ["12", "record.v2", "record", "2"]
    assert values(spark, rows, T.path_id(F.col("v"), 2), "v string") == ["345", "record.v2", "record", "2"]


def test_headers_and_literals(spark):
    rows = [(["Age: 61", "Sex: Male", "Dx: 426177001,164934002", "Rx: none"],), (["dx: 7", "AGE: 5"],), ([],)]
    ddl = "v array<string>"
    assert values(spark, rows, L.header_value(F.col("v"), "age"), ddl) == ["61", "5", None]
    assert values(spark, rows, F.lower(L.header_value(F.col("v"), "sex")), ddl) == ["male", None, None]
    assert values(spark, [("Dx: 1, 22,333",)], L.header_codes(F.col("v")), "v string") == [["1", "22", "333"]]
    got = values(spark, [("{'A': 100.0, 'B': 0.0, 'A': 15.0}",), ("{}",)], L.code_map(F.col("v")), "v string")
    assert got == [{"A": 15.0, "B": 0.0}, {}]


def roi(x, start, end, stride):
    frames = x.shape[1]
    s, e = round(start / 5), round(end / 5)
    e = s + 1 if e <= s else e
    lo, hi = max(0, s // stride - 2), min(frames, math.ceil(e / stride) + 2)
    if hi - lo < 3:
        need = 3 - (hi - lo)
        lo, hi = max(0, lo - need // 2), min(frames, hi + need - need // 2)
        hi = min(frames, lo + 1) if hi <= lo else hi
    if hi <= lo:
        return None
    part = np.nan_to_num(x[:, lo:hi], nan=0.0, posinf=0.0, neginf=0.0)
    return np.concatenate([part.mean(1), part.max(1)])


def test_roi_pool(spark):
    x = RNG.normal(size=(3, 12))
    x[0, 4], x[1, 5] = np.nan, np.inf
    for start, end in [(0, 10), (100, 180), (40, 40), (0, 0), (450, 480), (470, 900), (2000, 2100)]:
        got = values(spark, [(x.tolist(),)], P.roi_pool(F.col("v"), F.lit(start), F.lit(end), 8), "v array<array<double>>")[0]
        want = roi(x, start, end, 8)
        assert (got is None) == (want is None)
        assert got is None or np.allclose(got, want)


def test_adaptive_pool(spark):
    for n in (5, 10, 23):
        x = RNG.normal(size=(2, n))
        cut = lambda i: x[:, (i * n) // 10 : -(-((i + 1) * n) // 10)]
        want = np.concatenate([np.stack([cut(i).mean(1) for i in range(10)], 1), np.stack([cut(i).max(1) for i in range(10)], 1)]).ravel()
        got = values(spark, [(x.tolist(),)], P.adaptive_pool(F.col("v"), 10), "v array<array<double>>")[0]
        assert np.allclose(got, want)


def test_masked_mean(spark):
    rows = [([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [5, 1, 0]), ([[1.0, 1.0]], [0])]
    got = values(spark, rows, P.masked_mean(F.col("v"), F.col("t"), 2), "v array<array<double>>, t array<int>")
    assert got == [[2.0, 3.0], [0.0, 0.0]]


MEANS = [
    (None, [1], None),
    ([[1.0, 2.0]], None, None),
    ([], [], [0.0, 0.0]),
    ([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], [7, None, 0], [1.0, 2.0]),
    ([None, [1.0, 2.0]], [0, 1], [1.0, 2.0]),
    ([None, [1.0, 2.0]], [1, 1], None),
    ([[1.0, 2.0]], [1, 1], None),
    ([[1.0, 2.0], [8.0, 8.0]], [1], [1.0, 2.0]),
    ([[1.0], [3.0, 4.0]], [1, 1], [2.0, None]),
    ([[1.0, 2.0, 3.0], [3.0, 4.0]], [1, 1], [2.0, 3.0, None]),
    ([[None, 2.0], [1.0, 4.0]], [1, 1], [None, 3.0]),
    ([[1e16, 1.0], [1.0, 1.0], [-1e16, 1.0]], [1, 1, 1], [0.0, 1.0]),
]


def test_masked_mean_on_batches(spark):
    """Missing arrays, vectors and values, and vectors of other lengths, without a lambda per token."""
    df = spark.createDataFrame([(i, v, t) for i, (v, t, _) in enumerate(MEANS)], "i int, v array<array<double>>, t array<int>")
    means = df.repartition(2).select("i", P.masked_mean(F.col("v"), F.col("t"), 2).alias("x"))
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan
    assert [r["x"] for r in means.orderBy("i").collect()] == [want for _, _, want in MEANS]


def test_masked_mean_of_made_vectors(spark):
    """Vectors that a function makes of the tokens are averaged like those of a column."""
    rows = [([3, 4, 1, 0, 0],), ([0, 0],), ([],), (None,), ([5, None, 2, 0],)]

    def vectors(tokens: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [float(t), t * t / 4.0] for t in tokens.to_pylist()], pa.list_(pa.float64()))

    beside = F.transform("t", lambda t: F.array(t.cast("double"), t * t / F.lit(4.0)))
    got = values(spark, rows, P.masked_mean(vectors, F.col("t"), 2), "t array<int>")
    assert got == values(spark, rows, P.masked_mean(beside, F.col("t"), 2), "t array<int>")
    assert got == [[8 / 3, 6.5 / 3], [0.0, 0.0], [0.0, 0.0], None, [3.5, 3.625]]


def test_masked_mean_in_parts():
    """A batch is averaged some rows at a time, however wide the rows are."""
    vectors = pa.array([v for v, _, _ in MEANS], pa.list_(pa.list_(pa.float64())))
    tokens = pa.array([t for _, t, _ in MEANS], pa.list_(pa.int32()))
    for most in (1, 12, 1 << 20):
        assert P._masked_means(vectors, tokens, 2, 0, most).to_pylist() == [want for _, _, want in MEANS]
    assert P._masked_means(vectors[:0], tokens[:0], 2, 0).to_pylist() == []


def test_mean_pool_without_a_lambda_per_token(spark, tmp_path):
    """The vectors are made and averaged on batches; NULL keys and repeated lines take part as before."""
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate date, l_quantity double, l_discount double, l_tax double"
    day = datetime.date(1995, 1, 2)
    lines = [(1, 1, 5, 6, 1.0, day, 7.0, 0.08, 0.01)] * 2 + [(None, 1, 5, 6, 1.0, day, 7.0, 0.08, 0.01), (2, 1, 5, 6, 1.0, day, 7.0, 0.0, 0.01)]
    spark.createDataFrame(lines, line).write.parquet(str(tmp_path / "lineitem.parquet"))
    order = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double"
    spark.createDataFrame([(1, 9, "F", "1", 1.0), (2, 9, "F", "1", 1.0), (None, 9, "F", "1", 1.0)], order).write.parquet(str(tmp_path / "orders.parquet"))
    pooled = FQ.mean_pool(spark, str(tmp_path))
    steps = pooled._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in steps and "zip_with" not in steps
    # Codes 5, 6, 7, 8 and 2 at the offsets of their segments; beats of 1 or 2 to a sentence, then the separator.
    beat = [C.FIRST_TOKEN + 48 * k + c for k, c in enumerate([5, 6, 7, 8, 2])]
    mean = lambda ids: ",".join(str(math.floor(1000 * sum(x) / len(ids) + 0.5)) for x in (ids, [t * t / 4 for t in ids]))
    got = sorted(tuple(r) for r in pooled.collect())
    assert got in ([(9, 1, 0, mean(beat * 2 + [1]))], [(9, 1, k, mean(beat + [1])) for k in range(2)])
