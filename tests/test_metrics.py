"""Votes, metrics and losses against brute force, ties and empty classes included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom.operators import metrics as M

RNG = np.random.default_rng(2)
DDL = "r int, probs array<double>, labels array<int>"


def auroc(score, label):
    pos, neg = score[label == 1], score[label == 0]
    if not len(pos) or not len(neg):
        return None
    return ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))


def test_auroc(spark):
    n = 400
    score = np.round(RNG.random((n, 4)), 2)
    score[:5] = [0.0, 1.0, 0.5, 1e-9]
    label = (RNG.random((n, 4)) < score).astype(int)
    label[:, 2] = 0
    label[:, 3] = 1
    df = spark.createDataFrame([(i, p.tolist(), y.tolist()) for i, (p, y) in enumerate(zip(score, label))], DDL)
    got = {r["class"]: r["auroc"] for r in M.class_auroc(M.long_scores(df)).collect()}
    want = {c: auroc(score[:, c], label[:, c]) for c in range(4)}
    assert got[2] is None and got[3] is None and np.allclose([got[0], got[1]], [want[0], want[1]])
    macro = M.macro_auroc(M.long_scores(df)).first()
    assert macro["classes"] == 2 and abs(macro["macro_auroc"] - (want[0] + want[1]) / 2) < 1e-12
    none = M.macro_auroc(M.long_scores(df).filter("class = 2")).first()
    assert none["macro_auroc"] is None


def test_record_votes(spark):
    rows = [
        (1, [0.9, 0.1], [1, 0]), (1, [0.2, 0.8], [1, 0]),  # one of two: a tie is negative
        (2, [0.9, 0.5], [0, 1]), (2, [0.8, 0.6], [0, 1]), (2, [0.1, 0.7], [0, 1]),
        (3, [0.6, 0.6], [1, 1]), (3, [0.6, 0.4], [1, 1]), (3, [0.1, 0.6], [1, 1]), (3, [0.2, 0.6], [1, 1]),
    ]
    df = spark.createDataFrame(rows, DDL)
    got = {r["r"]: (r["n"], r["votes"], r["pred"], r["labels"]) for r in M.record_scores(df, "r", 2).collect()}
    assert got == {1: (2, [1, 1], [0, 0], [1, 0]), 2: (3, [2, 2], [1, 1], [0, 1]), 3: (4, [2, 3], [0, 1], [1, 1])}
    single = {r["r"]: (r["class"], r["votes"], r["n"]) for r in M.record_class(df, "r").collect()}
    # Record 3: two sentences each way (0.6/0.6 counts for the first), so the lowest class.
    assert single == {1: (0, 1, 2), 2: (0, 2, 3), 3: (0, 2, 4)}


def test_summary_and_rates(spark):
    pred = RNG.integers(0, 2, (60, 3))
    lab = RNG.integers(0, 2, (60, 3))
    lab[:, 2] = pred[:, 2] = 0
    df = spark.createDataFrame([(p.tolist(), y.tolist()) for p, y in zip(pred, lab)], "pred array<int>, labels array<int>")
    r = M.multilabel_summary(df, 3).first()
    f1 = [2 * (pred[:, c] & lab[:, c]).sum() / max(1, (pred[:, c] + lab[:, c]).sum()) for c in range(3)]
    assert abs(r["macro_f1"] - np.mean(f1)) < 1e-12 and abs(r["subset_accuracy"] - (pred == lab).all(1).mean()) < 1e-12
    counts = df.agg(*M.confusion(F.get("pred", F.lit(0)), F.get("labels", F.lit(0))))
    r = M.rates(counts).first()
    p, y = pred[:, 0], lab[:, 0]
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == ((p & y).sum(), (p & ~y & 1).sum(), (~p & y & 1).sum(), ((1 - p) & (1 - y)).sum())
    assert abs(r["gmean"] - np.sqrt(r["sensitivity"] * r["specificity"])) < 1e-12
    empty = M.rates(df.filter("false").agg(*M.confusion(F.get("pred", F.lit(0)), F.get("labels", F.lit(0))))).first()
    assert (empty["sensitivity"], empty["precision"], empty["gmean"]) == (0.0, 0.0, 0.0)


def test_decisions_and_losses(spark):
    z = RNG.normal(0, 4, (30, 3))
    df = spark.createDataFrame([(i, r.tolist(), [int(x) for x in RNG.integers(0, 2, 3)]) for i, r in enumerate(z)], DDL.replace("probs", "z"))
    rows = df.select("z", "labels", M.softmax(F.col("z")).alias("s"), M.sigmoid(F.col("z")).alias("g")).collect()
    for r in rows:
        e = np.exp(np.array(r["z"]) - max(r["z"]))
        assert np.allclose(r["s"], e / e.sum()) and np.allclose(r["g"], 1 / (1 + np.exp(-np.array(r["z"]))))
    y, g = np.array([r["labels"] for r in rows]), np.array([r["g"] for r in rows])
    bce = df.select(M.sigmoid(F.col("z")).alias("g"), "labels").agg(M.mean_bce(F.col("g"), F.col("labels")).alias("x")).first()["x"]
    assert abs(bce - -(y * np.log(g) + (1 - y) * np.log(1 - g)).mean()) < 1e-12
    edge = spark.createDataFrame([(0.0, 1), (1.0, 0)], "p double, y int")
    x = edge.agg(M.mean_bce(F.array("p"), F.array("y")).alias("x")).first()["x"]
    assert x == 100.0
    top = spark.createDataFrame([([0.4, 0.4, 0.2],)], "p array<double>").select(M.one_hot(M.argmax(F.col("p")), 3).alias("x")).first()["x"]
    assert top == [1, 0, 0]


def test_ensemble(spark):
    rows = [(1, "a", 0.2), (1, "b", 0.4), (2, "a", 0.5)]
    df = spark.createDataFrame(rows, "s int, m string, prob double")
    assert [(r["s"], round(r["prob"], 9)) for r in M.ensemble(df, ["s"], "m", "prob", 2).collect()] == [(1, 0.3)]
    assert [r["s"] for r in M.alignment_gaps(df, ["s"], "m", "prob", 2).collect()] == [2]
    # A doubled member does not stand in for a missing one.
    twice = spark.createDataFrame([(1, "a", 0.2), (1, "a", 0.3), (2, "a", 0.5), (2, "b", 0.7), (2, "b", 0.7)], "s int, m string, prob double")
    assert M.ensemble(twice, ["s"], "m", "prob", 2).count() == 0
    for names in (["a", "b"], [f"x{i}" for i in range(70)] + ["a", "b"]):
        listed = spark.createDataFrame([(s, m, 0.25) for s in (1, 2) for m in names] + [(2, names[-1], 0.5), (3, names[0], 0.5), (4, "other", 0.1)], "s int, m string, prob double")
        assert [(r["s"], r["prob"], r["members"]) for r in M.ensemble(listed, ["s"], "m", "prob", names).collect()] == [(1, 0.25, len(names))]
        gaps = sorted((r["s"], r["members"], r["predictions"]) for r in M.alignment_gaps(listed, ["s"], "m", "prob", names).collect())
        assert gaps == [(2, len(names), len(names) + 1), (3, 1, 1), (4, 0, 1)]
    assert M.ensemble(twice, ["s"], "m", "prob", 3).count() == 0
    assert sorted(r["s"] for r in M.alignment_gaps(twice, ["s"], "m", "prob", 2).collect()) == [1, 2]


def test_small_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 5.0, 8), ("b", 0.0, 0)], "k string, l double, n int")
    assert {r["k"]: r["loss"] for r in M.weighted_loss(df, ["k"], F.col("l"), F.col("n")).collect()} == {"a": 0.6, "b": 0.0}
    toks = spark.createDataFrame([(5, 5), (4, 5), (0, 0), (1, 1)], "g int, t int")
    r = M.masked_token_accuracy(toks, "g", "t", [0, 1]).first()
    assert (r["valid"], r["correct"], r["accuracy"]) == (2, 1, 0.5)
    s = M.seed_summary(df.withColumn("e", F.lit(1)), ["e"], ["l"]).first()
    assert s["l_mean"] == 2.0 and s["l_std"] == pytest.approx(np.std([1.0, 5.0, 0.0]))
