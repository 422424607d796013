"""Assignment, refitting and reconstruction against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom.operators import codebook as B
from beatloom.operators import encoders as E

RNG = np.random.default_rng(4)
X = RNG.normal(size=(200, 6))
CODES = np.vstack([X[:7], X[3:4], np.full((1, 6), 50.0)])  # code 7 equals code 3, code 8 is never near


@pytest.fixture(scope="module")
def frames(spark):
    vec = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "vec_id bigint, v array<double>").repartition(5)
    book = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(CODES)], "code int, vec array<double>")
    return vec, book


def nearest(x, c):
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


def test_assign(frames):
    vec, book = frames
    at, dist = nearest(X, CODES)
    got = {r["vec_id"]: (r["code"], r["dist"]) for r in B.assign(vec, "v", book).collect()}
    assert all(got[i][0] == at[i] and abs(got[i][1] - dist[i]) < 1e-9 for i in range(len(X)))
    # Equal codes: the lower index.
    assert got[3][0] == 3 and 7 not in {c for c, _ in got.values()}


def test_usage(frames):
    vec, book = frames
    per = B.usage(B.assign(vec, "v", book), book)
    n = np.bincount(nearest(X, CODES)[0], minlength=len(CODES))
    assert {r["code"]: r["n"] for r in per.collect()} == dict(enumerate(n.tolist()))
    s = B.usage_summary(per).first()
    p = n / n.sum()
    assert (s["codes"], s["used"]) == (9, (n > 0).sum()) and s["perplexity"] == pytest.approx(np.exp(-(p * np.log(p + 1e-10)).sum()))
    top = [r["code"] for r in B.top_codes(per, 3).collect()]
    assert top == sorted(range(9), key=lambda c: (-n[c], c))[:3]


def step(x, c, n, w, decay, eps, dead_pool):
    at, _ = nearest(x, c)
    count = np.bincount(at, minlength=len(c))
    total = np.zeros_like(c)
    np.add.at(total, at, x)
    n = n * decay + (1 - decay) * count
    n = (n + eps) * n.sum() / (n.sum() + len(c) * eps)
    w = w * decay + (1 - decay) * total
    vec = w / n[:, None]
    line = 0.5 * len(x) / len(c)
    dead = n < line
    for j, code in enumerate(np.nonzero(dead)[0]):
        vec[code] = w[code] = x[dead_pool[j]]
        n[code] = line * 0.5
    return vec, n, w, dead


def pool(round_no, size):
    import hashlib

    ids = sorted(range(len(X)), key=lambda i: (hashlib.md5(f"42|{round_no}|{i}".encode()).hexdigest(), i))
    return ids[:size]


def test_update_and_fit(frames):
    vec, book = frames
    n, c, w = np.zeros(len(CODES)), CODES.copy(), CODES.copy()
    for rounds in (1, 2):
        c, n, w, dead = step(X, c, n, w, 0.5, 1e-6, pool(rounds, len(CODES)))
        got = {r["code"]: r for r in B.fit(book, vec, "v", "vec_id", rounds, decay=0.5).collect()}
        for i in range(len(CODES)):
            assert np.allclose(got[i]["vec"], c[i]) and np.allclose(got[i]["ema_w"], w[i]) and got[i]["ema_n"] == pytest.approx(n[i])
    one = {r["code"]: r["dead"] for r in B.update(B.start_state(book), vec, "v", "vec_id", decay=0.5).collect()}
    assert one[8] and one[7] and not all(one.values())


def test_update_without_dead_codes(frames, spark):
    vec, _ = frames
    book = spark.createDataFrame([(0, [0.0] * 6)], "code int, vec array<double>")
    r = B.update(B.start_state(book), vec, "v", "vec_id", decay=0.0).first()
    assert not r["dead"] and np.allclose(r["vec"], X.mean(0))


def test_refuses_an_empty_codebook(spark, frames):
    vec, _ = frames
    with pytest.raises(ValueError):
        B.assign(vec, "v", spark.createDataFrame([], "code int, vec array<double>"))


def test_codes_in_blocks(spark, frames, monkeypatch):
    """Codebooks above one block: the nearest of all codes, the lowest on ties, NULL for NULL."""
    vec, book = frames
    with_null = vec.unionByName(spark.createDataFrame([(-1, None)], "vec_id bigint, v array<double>"))
    at, dist = nearest(X, CODES)
    count, total = np.bincount(at, minlength=len(CODES)), np.zeros_like(CODES)
    np.add.at(total, at, X)
    monkeypatch.setattr(B, "BLOCK_VALUES", 13)  # two codes each
    monkeypatch.setattr(B, "VECTORS_PER_TASK", 40)
    got = {r["vec_id"]: (r["code"], r["dist"]) for r in B.assign(with_null, "v", book).collect()}
    assert got.pop(-1) == (None, None) and len(got) == len(X)
    assert all(got[i][0] == at[i] and abs(got[i][1] - dist[i]) < 1e-9 for i in range(len(X)))
    for r in B.code_sums(with_null, "v", book).collect():
        assert r["n"] == count[r["code"]] and r["total"] == pytest.approx(total[r["code"], r["dim"]])


def test_codebook_of_many_values(spark):
    """65,536 codes of 128 values, which one broadcast of bounded size does not hold."""
    book = spark.range(65_536).select(F.col("id").cast("int").alias("code"), F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.when(i == F.col("id") % 128, F.col("id").cast("double")).otherwise(0.0)).alias("vec"))
    vec = spark.createDataFrame([(c,) for c in (5, 40_000, 65_535)], "vec_id int").join(book.withColumnRenamed("code", "vec_id"), "vec_id")
    got = {r["vec_id"]: (r["code"], r["dist"]) for r in B.assign(vec, "vec", book).collect()}
    assert got == {c: (c, 0.0) for c in (5, 40_000, 65_535)}


def test_losses(spark, frames):
    vec, book = frames
    _, dist = nearest(X, CODES)
    r = B.quantisation_loss(B.assign(vec, "v", book), 6, 0.25).first()
    assert r["mse"] == pytest.approx(dist.sum() / X.size) and r["ema_loss"] == pytest.approx(0.25 * r["mse"]) and r["plain_loss"] == pytest.approx(1.25 * r["mse"])
    rows = [(i % 3, RNG.normal(size=9).tolist(), RNG.normal(size=9).tolist(), 4 + i % 5) for i in range(30)]
    df = spark.createDataFrame(rows, "lead int, x array<double>, y array<double>, n int")
    for length in (None, "n"):
        sq, m, hub = {0: 0.0, 1: 0.0, 2: 0.0}, {0: 0, 1: 0, 2: 0}, []
        for lead, x, y, n in rows:
            e = np.array(x)[: n if length else None] - np.array(y)[: n if length else None]
            sq[lead] += (e**2).sum()
            m[lead] += len(e)
            hub.extend(np.where(abs(e) < 1, 0.5 * e**2, abs(e) - 0.5))
        per = B.lead_mse(df, "lead", "x", "y", length)
        mse = {k: sq[k] / m[k] for k in sq}
        assert {r["lead"]: pytest.approx(r["mse"]) for r in per.collect()} == mse
        s = B.lead_mse_summary(per, "lead").first()
        assert s["worst_lead"] == max(mse, key=mse.get) and s["best_lead"] == min(mse, key=mse.get)
        assert s["overall"] == pytest.approx(sum(sq.values()) / sum(m.values())) and s["ratio"] == pytest.approx(max(mse.values()) / min(mse.values()))
        assert B.huber_loss(df, "x", "y", length).first()["loss"] == pytest.approx(np.mean(hub), rel=1e-6)


def test_kernel_features(spark):
    table = E.random_kernels(spark, 3, 20, 25, seed=9)
    kernels = sorted(table.collect())
    assert kernels == sorted(E.random_kernels(spark, 3, 20, 25, seed=9).collect())
    x = RNG.normal(size=(11, 3, 20))
    want = np.zeros((11, 50))
    for i, k in enumerate(kernels):
        n = max(t["place"] for t in k["taps"]) + 1
        w = np.zeros((3, n))
        for t in k["taps"]:
            w[t["channel"], t["place"]] = t["weight"]
        used = np.any(w != 0, axis=1)
        assert n in (7, 9, 11) and used.sum() >= 1 and abs(w[used].mean()) < 1e-9 and -1 <= k["bias"] < 1
        p = np.pad(x, ((0, 0), (0, 0), (k["padding"], k["padding"])))
        steps = p.shape[2] - (n - 1) * k["dilation"]
        assert steps > 0
        for r in range(11):
            resp = [sum(w[c, t] * p[r, c, s + t * k["dilation"]] for c in range(3) for t in range(n)) + k["bias"] for s in range(steps)]
            want[r, 2 * i], want[r, 2 * i + 1] = np.mean(np.array(resp) > 0), max(resp)
    assert len({k["dilation"] for k in kernels}) > 1 and {k["padding"] > 0 for k in kernels} == {True, False}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, s array<array<double>>").repartition(3)
    got = {r["i"]: r["features"] for r in E.by_name("kernels")(df, "s", table).collect()}
    assert np.allclose([got[i] for i in range(11)], want)
    p = E.random_projection(spark, 50, 4)
    m = np.array([r["weights"] for r in sorted(p.collect())])
    got = {r["i"]: r["features"] for r in E.with_kernel_features(df, "s", table, p).collect()}
    assert np.allclose([got[i] for i in range(11)], want @ m.T)
    with pytest.raises(ValueError):
        E.random_kernels(spark, 1, 11, 1)
    with pytest.raises(ValueError):
        E.by_name("other")
    assert E.by_name("none") is None


def test_user_encoder(spark):
    df = spark.range(5)

    def double(batches):
        for pdf in batches:
            yield pdf.assign(features=[[float(i), i * 2.0] for i in pdf["id"]])

    assert sorted(r["features"][1] for r in E.encode(df, double).collect()) == [0.0, 2.0, 4.0, 6.0, 8.0]
