"""Splits, labels, runs, comparisons and sinks: properties and edge rows."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from beatloom.operators import labels as L
from beatloom.operators import quality as Q
from beatloom.operators import runs as R
from beatloom.operators import splits as X
from beatloom.sources import signals as G

PARTS = [("train", 0.8), ("val", 0.15), ("test", 0.05)]


def test_patient_split(spark):
    rows = spark.range(1000).select((F.col("id") % 207).alias("p"))
    s = X.patient_split(rows, "p", PARTS)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": int(207 * 0.8), "val": int(207 * 0.15), "test": 207 - int(207 * 0.8) - int(207 * 0.15)}
    assert s.select("p").distinct().count() == 207 and X.overlap(X.propagate(rows, s, "p"), "p").count() == 0
    other = X.patient_split(rows, "p", PARTS, seed=1)
    assert s.join(other, ["p", "split"]).count() < 207
    with pytest.raises(ValueError):
        X.patient_split(rows, "p", [("a", 0.5), ("b", 0.4)])
    with pytest.raises(PySparkException):
        X.patient_split(rows.limit(3), "p", PARTS).collect()


def test_stratified_split(spark):
    ids = spark.createDataFrame([(i, "big" if i < 200 else "small" if i < 209 else "ten") for i in range(219)], "id int, label string")
    s = X.stratified_split(ids, "id", "label")
    got = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    assert got == {("big", "train"): 140, ("big", "val"): 20, ("big", "test"): 40, ("small", "train"): 9, ("ten", "train"): 7, ("ten", "val"): 1, ("ten", "test"): 2}
    assert [r["label"] for r in X.missing_labels(s, "label").collect()] == ["small"]
    rec = spark.createDataFrame([(1, 5, "x"), (1, 2, "y"), (2, 9, "z")], "id int, o int, label string")
    assert {(r["id"], r["label"]) for r in X.first_label(rec, "id", "label", ["o"]).collect()} == {(1, "y"), (2, "z")}


def test_lists_and_folds(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(6)], "id int, y int")
    lists = X.tagged_lists({"train": rows.filter("id < 3"), "test": rows.filter("id in (3, 4)")}, "id")
    assert [r["id"] for r in X.unlisted(rows, lists, "id").collect()] == [5]
    with pytest.raises(ValueError, match="not listed"):
        X.require_none(X.unlisted(rows, lists, "id"), "not listed")
    X.require_none(X.unlisted(rows.filter("id < 5"), lists, "id"), "not listed")
    X.require_counts(X.propagate(rows, lists, "id"), {"train": 3, "test": 2})
    with pytest.raises(ValueError, match="expected"):
        X.require_counts(X.propagate(rows, lists, "id"), {"train": 4, "test": 1})
    side = spark.createDataFrame([(0, 1, 2), (1, 1, 1), (2, 1, 0), (2, 2, 3)], "id int, fold int, n int")
    rep = sorted((r["id"], r["copy"]) for r in X.fold_rows(rows, side, "id", 1, True).collect())
    assert rep == [(0, 1), (0, 2), (1, 1)]
    assert sorted(r["id"] for r in X.fold_rows(rows, side, "id", 1, False).collect()) == [0, 1]
    s = {r["fold"]: r.asDict() for r in X.fold_summary(side.join(rows, "id"), "id", "y").collect()}
    assert s[1] == {"fold": 1, "entries": 3, "unique_ids": 2, "unique_negative": 1, "unique_positive": 1, "max_repeat": 2}
    same = X.same_set(side.filter("n > 0").select("id"), rows.filter("id < 3").select("id")).first()
    assert (same["only_left"], same["only_right"]) == (0, 0)
    assert X.same_set(rows.select("id"), side.select("id")).first()["only_left"] == 3


def test_many_copies_spread(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, x string")
    side = spark.createDataFrame([(1, 1, 50_000), (1, 2, 7), (2, 1, 3), (3, 1, 0)], "id int, fold int, n int")
    out = X.all_fold_rows(rows, side, "id", True, chunk=100)
    got = {(r["id"], r["fold"]): (r["count"], r["lo"], r["hi"]) for r in out.groupBy("id", "fold").agg(F.count("*").alias("count"), F.min("copy").alias("lo"), F.max("copy").alias("hi")).collect()}
    assert got == {(1, 1): (50_000, 1, 50_000), (1, 2): (7, 1, 7), (2, 1): (3, 1, 3)}
    assert out.select("id", "fold", "copy").distinct().count() == 50_010
    parts = out.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 30_000


def test_fraction_and_sample(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") < 40, "train").otherwise("val").alias("split"))
    out = X.train_fraction(rows, "id", 0.33)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 13, "val": 60}
    a = {r["id"] for r in X.sample_n(rows, "id", 10).collect()}
    assert len(a) == 10 and a == {r["id"] for r in X.sample_n(rows.repartition(5), "id", 10).collect()}
    assert X.members(rows, rows.filter("id < 5"), "id").count() == 5 and X.members(rows, rows.limit(0), "id").count() == 0
    folds = spark.createDataFrame([(f,) for f in range(1, 11)], "f int")
    got = [r["x"] for r in folds.select("f", X.official_split(F.col("f"), [9], [10]).alias("x")).orderBy("f").collect()]
    assert got == ["train"] * 8 + ["val", "test"]


def test_labels(spark):
    codes = spark.createDataFrame([("1", "A"), ("2", "B"), ("2", "A")], "code string, name string")
    rows = spark.createDataFrame([(1, ["2", "9", "1"]), (2, []), (3, ["1", "1"])], "id int, codes array<string>")
    got = {r["id"]: r["names"] for r in L.lookup_many(rows, "id", "codes", codes, "code", "name").collect()}
    assert got == {1: ["A", "B", "Unknown", "A"], 2: [], 3: ["A", "A"]}
    got = {r["id"]: r["names"] for r in L.lookup_many(rows, "id", "codes", codes.limit(0), "code", "name").collect()}
    assert got[1] == ["Unknown"] * 3 and got[2] == []
    cls = spark.createDataFrame([(1, ["B", "A"]), (2, ["Unknown"]), (3, ["C"]), (4, [])], "id int, c array<string>")
    hot = {r["id"]: r["x"] for r in cls.select("id", L.multi_hot(F.col("c"), ["A", "B", "C"]).alias("x")).collect()}
    assert hot == {1: [1, 1, 0], 2: [0, 0, 0], 3: [0, 0, 1], 4: [0, 0, 0]}
    assert cls.filter(L.labelled(L.multi_hot(F.col("c"), ["A", "B", "C"]))).count() == 2
    assert {r["id"] for r in L.without_code(cls, "c").collect()} == {1, 3, 4}
    p = L.multi_label_profile(cls, "c").first()
    assert (p["records"], p["several"], p["none"], p["labels"]) == (4, 1, 1, 4)
    one = L.single_label(cls, "c")
    assert {(r["id"], r["class"]) for r in one.collect()} == {(2, "Unknown"), (3, "C")}
    seen = L.first_seen_ids(spark.createDataFrame([("z", 1), ("a", 2), ("z", 3)], "k string, i int"), "k", "i")
    assert {r["k"]: r["label_id"] for r in seen.collect()} == {"z": 0, "a": 1}
    assert {r["class"]: r["label_id"] for r in L.sorted_ids(one, "class").collect()} == {"C": 0, "Unknown": 1}


def test_multi_hot_by_join(spark):
    """Places follow the sorted names, however many there are."""
    many = spark.range(10_005).select(F.format_string("c%05d", "id").alias("class"))
    rows = spark.createDataFrame([(1, ["c00003", "c10004"]), (2, []), (3, ["other"]), (4, None)], "id int, c array<string>")
    got = {r["id"]: r["labels"] for r in L.multi_hot_by_join(rows, "id", "c", many).collect()}
    assert {k: [i for i, x in enumerate(v) if x] for k, v in got.items()} == {1: [3, 10_004], 2: [], 3: [], 4: []}
    assert {len(v) for v in got.values()} == {10_005}


def walk(curve, better, keep, start, patience):
    state, best, bad, stop = start, None, 0, None
    for e, row in enumerate(curve, 1):
        if better(state, row):
            state, best, bad = keep(state, row), e, 0
        else:
            bad += 1
            if bad >= patience:
                stop = e
                break
    return best, stop


def test_best_epochs(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    data = {r: np.round(rng.random((30, 4)), 3) for r in range(12)}
    rows = [(r, e + 1, *map(float, v)) for r, m in data.items() for e, v in enumerate(m)]
    rows = [(r, e, lo, g, None if r % 3 == 0 and e % 11 == 0 else a, c) for r, e, lo, g, a, c in rows]
    df = spark.createDataFrame(rows, "run int, epoch int, loss double, gmean double, auroc double, acc double")
    curves = {r: [x[2:] for x in rows if x[0] == r] for r in data}
    inf = float("inf")
    got = {r["run"]: (r["best_epoch"], r["stop_epoch"]) for r in R.best_epoch_by_loss(df, ["run"], "loss", 0.05, 4).collect()}
    assert got == {r: walk(c, lambda s, x: s - x[0] > 0.05, lambda s, x: x[0], inf, 4) for r, c in curves.items()}

    def gain(s, x):
        d = x[1] - s[0]
        return d > 0.1 or (abs(d) <= 0.1 and x[2] is not None and s[1] is not None and x[2] > s[1])

    got = {r["run"]: (r["best_epoch"], r["stop_epoch"]) for r in R.best_epoch_by_gmean(df, ["run"], "gmean", "auroc", 5, delta=0.1).collect()}
    assert got == {r: walk(c, gain, lambda s, x: (x[1], x[2]), (-inf, -inf), 5) for r, c in curves.items()}

    def smoothed(c):
        out = []
        for i in range(len(c)):
            w = c[max(0, i - 4) : i + 1]
            a = None if any(x[2] is None for x in w) else sum(x[2] for x in w) / len(w)
            out.append((a, sum(x[3] for x in w) / len(w), len(w) == 5))
        return out

    better = lambda s, x: x[2] and ((x[1] - s[1]) if x[0] is None else (x[0] - s[0])) > 0.0123
    keep = lambda s, x: (s[0], x[1]) if x[0] is None else (x[0], s[1])
    got = {r["run"]: (r["best_epoch"], r["stop_epoch"]) for r in R.best_epoch_smoothed(df, ["run"], "auroc", "acc", 0.0123, 6).collect()}
    assert got == {r: walk(smoothed(c), better, keep, (-inf, -inf), 6) for r, c in curves.items()}


def test_a_long_run_streams(spark):
    long = spark.range(200_000).select(F.lit(1).alias("run"), (F.col("id") + 1).alias("epoch"), (F.lit(1.0) / (F.col("id") % 150_000 + 1)).alias("loss"))
    short = spark.createDataFrame([(None, 1, 0.5), (None, 2, None), (2, 1, None)], "run int, epoch long, loss double")
    best = R.value_at_best(R.best_epoch_by_loss(long.unionByName(short), ["run"], "loss", 0.0, 60_000), "loss")
    got = {r["run"]: (r["best_epoch"], r["stop_epoch"], r["epochs"], r["best_loss"]) for r in best.collect()}
    assert got == {1: (150_000, None, 200_000, 1 / 150_000), None: (1, None, 2, 0.5), 2: (None, None, 1, None)}


def test_trailing_mean_by_rows_splits_a_run(spark):
    epochs = [3 * e + e % 2 for e in range(300)]  # gaps in the numbers
    rows = [(r, e, None if e % 97 == 0 else float((e * 7919) % 13)) for r in (1, 2) for e in epochs[: 300 if r == 1 else 7]]
    df = spark.createDataFrame(rows, "run int, epoch int, acc double")
    got = {(r["run"], r["epoch"]): (r["acc_smooth"], r["full"]) for r in R.trailing_mean(df, ["run"], ["acc"], cell=16).collect()}
    for r in (1, 2):
        mine = [x for x in rows if x[0] == r]
        for i, (_, e, _) in enumerate(mine):
            w = [x[2] for x in mine[max(0, i - 4) : i + 1]]
            mean, full = got[r, e]
            assert full == (len(w) == 5) and (mean is None) == (None in w)
            assert mean is None or abs(mean - sum(w) / len(w)) < 1e-9


def test_tags(spark):
    tags = ["cw1.9_lr1e-04_r8_do0.1_ld0.1_wd1e-04_tmall", "cw2.2_lr1e-05_r4_do0.1_ld0.1_wd1e-04_tmattn_ckvloss_hf0.5_a32_f2_dupr", "(untagged)"]
    df = spark.createDataFrame([(t,) for t in tags], "t string")
    rows = df.select("t", R.short_tag(F.col("t")).alias("short"), *[c.alias(n) for n, c in R.tag_settings(F.col("t")).items()]).collect()
    a, b, c = rows
    assert (a["lr_head_factor"], a["lora_alpha"], a["fold"], a["fold_dup"], a["ckpt_metric"], a["short"]) == ("0.1", "16", None, None, "gmean", "cw1.9")
    assert (b["class_weight"], b["lora_r"], b["lora_alpha"], b["fold"], b["fold_dup"], b["ckpt_metric"]) == ("2.2", "4", "32", "2", "repeat", "val_loss")
    assert c["class_weight"] is None and c["lr_head_factor"] is None and c["ckpt_metric"] is None


def test_upsert_and_planner(spark):
    old = spark.createDataFrame([(1, 0.5), (2, 0.6)], "seed int, acc double")
    new = spark.createDataFrame([(2, 0.7, 0.9), (3, 0.8, 0.1)], "seed int, acc double, g double")
    once = R.upsert(old, new, ["seed"])
    assert {tuple(r) for r in once.collect()} == {(1, 0.5, None), (2, 0.7, 0.9), (3, 0.8, 0.1)}
    assert {tuple(r) for r in R.upsert(once, new, ["seed"]).collect()} == {tuple(r) for r in once.collect()}
    have = spark.createDataFrame([("train", 0), ("val", 1)], "split string, shard int")
    assert {tuple(r) for r in R.missing_outputs(have, ["train", "val"], 2).collect()} == {("train", 1), ("val", 0)}
    assert R.missing_outputs(have, ["train", "val"], 2, force=True).count() == 4


def test_stored_upsert(spark, tmp_path):
    path = str(tmp_path / "m")
    G.upsert_stored(spark.createDataFrame([(1, 0.5)], "seed int, acc double"), path, ["seed"])
    last = G.upsert_stored(spark.createDataFrame([(1, 0.6), (2, 0.7)], "seed int, acc double"), path, ["seed"])
    assert {tuple(r) for r in spark.read.parquet(last).collect()} == {(1, 0.6), (2, 0.7)} and G.latest_version(spark, path) == 1
    with pytest.raises(PySparkException):
        G.write_report(spark.range(1), path)


def test_signal_rows(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]])], "i int, s array<array<double>>")
    r = G.signal_rows(df, "s", 2, cap=2).first()
    assert (r["length"], r["stored_length"], r["s"]) == (3, 2, [[1.0, 2.0], [4.0, 5.0]])
    for bad in ([[1.0], [1.0, 2.0]], [[1.0]]):
        with pytest.raises(PySparkException):
            G.signal_rows(spark.createDataFrame([(1, bad)], "i int, s array<array<double>>"), "s", 2).collect()


def test_diff(spark):
    nan = float("nan")
    a = spark.createDataFrame([(1, [1.0, nan]), (2, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [1.0])], "k int, v array<double>")
    b = spark.createDataFrame([(1, [1.0, nan]), (2, [1.0, 2.0005]), (3, [1.0, 3.0]), (5, [1.0])], "k int, v array<double>")
    rows = {r["k"]: (r["state"], r["equal"], r["within"], r["n_diff"]) for r in Q.diff_rows(a, b, "k", "v", atol=1e-3).collect()}
    assert rows == {1: ("both", True, True, 0), 2: ("both", False, True, 1), 3: ("both", False, False, 1), 4: ("only_left", None, None, None), 5: ("only_right", None, None, None)}
    s = Q.diff_summary(Q.diff_rows(a, b, "k", "v", atol=1e-3)).first()
    assert (s["only_left"], s["only_right"], s["equal"], s["within"], s["values_differing"]) == (1, 1, 1, 2, 2)
    skew = Q.skew_report(Q.partition_counts(spark.range(0, 90, numPartitions=3))).first()
    assert (skew["ratio"], skew["skewed"]) == (1.0, False)


def test_signal_csv_in_blocks(spark, tmp_path):
    """A long recording is read by several tasks and numbered as one, blank lines left out."""
    lines = [f"{i}, {i * 2},9" if i % 7 else f"\n{i}, {i * 2},9\r" for i in range(3000)]
    (tmp_path / "long.csv").write_bytes("\n".join(lines).encode())
    (tmp_path / "short.csv").write_bytes(b"5,6\r\n\r\n7,8")
    (tmp_path / "none.csv").write_bytes(b"")
    conf = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "0", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = G.read_signal_csv(spark, str(tmp_path), 2).select("*", F.spark_partition_id().alias("task"))
        rows = df.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = {(r["recording_id"], r["sample_idx"], r["lead_idx"]): r["value"] for r in rows}
    want = {("long", i, k): float(i * (k + 1)) for i in range(3000) for k in range(2)}
    assert len(got) == len(rows) and got == want | {("short", i, k): float(5 + 2 * i + k) for i in range(2) for k in range(2)}
    assert len({r["task"] for r in rows if r["recording_id"] == "long"}) > 1
