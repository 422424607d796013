"""Order-dependent helpers against plain Python, with cells small enough to matter."""

import hashlib
import random

import pytest

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from beatloom.operators import ordered as O
from beatloom.operators import segments as S
from beatloom.operators.quality import numbered


def _rows(seed, n, hot=0.4):
    rng = random.Random(seed)
    return [("hot" if rng.random() < hot else f"k{rng.randrange(6)}", i * 3 % 997, i) for i in range(n)]


def test_ranked_hot_and_cold(spark):
    rows = _rows(1, 600)
    df = spark.createDataFrame(rows, "k string, v int, i int")
    got = O.ranked(df, ["k"], ["v", "i"], pieces=9).collect()
    seen = {}
    for k, v, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        seen.setdefault(k, []).append(i)
    want = {(k, i): p for k, ids in seen.items() for p, i in enumerate(ids)}
    assert {(r["k"], r["i"]): r["pos"] for r in got} == want


def test_hash_ranked_is_a_permutation(spark):
    ids = spark.range(500).withColumn("g", (F.col("id") % 3).cast("int"))
    rows = O.hash_ranked(ids, "id", 1).collect()
    assert sorted(r["pos"] for r in rows) == list(range(500)) and {r["n"] for r in rows} == {500}
    assert [r["id"] for r in sorted(rows, key=lambda r: r["pos"])] != list(range(500))
    again = {r["id"]: r["pos"] for r in O.hash_ranked(ids.repartition(7), "id", 1).collect()}
    assert again == {r["id"]: r["pos"] for r in rows}
    by = O.hash_ranked(ids, "id", 1, by=["g"]).collect()
    for g in range(3):
        part = [r["pos"] for r in by if r["g"] == g]
        assert sorted(part) == list(range(len(part)))


def test_windowed_equals_whole_window(spark):
    rows = [("a", i, float((i * 7919) % 31)) for i in range(200) if i % 13] + [("b", 0, 1.0)]
    df = spark.createDataFrame(rows, "k string, p int, v double")
    wide = O.windowed(df, ["k"], "p", 40, 0, lambda f: {"s": F.count("v").over(f(-40, -1))}, cell=8).collect()
    assert all(r["s"] == sum(1 for k, q, _ in rows if k == r["k"] and r["p"] - 40 <= q < r["p"]) for r in wide)
    got = O.windowed(df, ["k"], "p", 4, 3, lambda f: {"s": F.sum("v").over(f(-4, 3))}, cell=8).collect()
    by = {(k, p): v for k, p, v in rows}
    for r in got:
        want = sum(by.get((r["k"], q), 0.0) for q in range(r["p"] - 4, r["p"] + 4))
        assert abs(r["s"] - want) < 1e-9
    assert len(got) == len(rows)


def test_running_sums(spark):
    rows = [("a", i, i % 5) for i in range(300)] + [("b", 7, 2)]
    df = spark.createDataFrame(rows, "k string, c int, v int")
    got = O.running_total(df, ["k"], "c", "v", "t", fanout=16).collect()
    for r in got:
        mine = [v for k, c, v in rows if k == r["k"]]
        assert r["t"] == sum(v for k, c, v in rows if k == r["k"] and c < r["c"]) and r["t_all"] == sum(mine)
    got = O.running(df, ["k"], ["c"], "v", "t", pieces=6).collect()
    assert all(r["t"] == sum(v for k, c, v in rows if k == r["k"] and c < r["c"]) for r in got) and len(got) == len(rows)


@pytest.mark.parametrize("n", [0, 1, 37, 299, 300, 900])
@pytest.mark.parametrize("digits,edge", [(1, 5), (3, 100_000)])
def test_lowest_hashes(spark, n, digits, edge):
    ids = list(range(300))
    df = spark.createDataFrame([(i, f"x{i}") for i in ids], "id int, x string")
    want = sorted(ids, key=lambda i: (hashlib.md5(f"7|{i}".encode()).hexdigest(), i))[:n]
    assert sorted(r["id"] for r in O.lowest(df, "id", 7, n, digits, edge).collect()) == sorted(want)


def test_lowest_of_repeated_keys(spark):
    df = spark.createDataFrame([(1, i) for i in range(90)], "id int, x int")
    assert sorted(r["x"] for r in O.lowest(df, "id", 7, 20, edge=4).collect()) == list(range(20))


def test_entry_states_compose(spark):
    rng = random.Random(3)
    rows = [("a", i, [rng.randrange(4) for _ in range(4)]) for i in range(90)] + [("b", 0, [1, 0, 2, 3])]
    df = spark.createDataFrame(rows, "k string, c bigint, t array<int>")
    for levels in (0, 1, 2):
        got = {(r["k"], r["c"]): r["entry"] for r in O.entry_states(df, ["k"], "c", "t", levels=levels, fanout=5).collect()}
        state, want = 0, {("b", 0): 0}
        for k, c, t in rows[:-1]:
            want[(k, c)] = state
            state = t[state]
        assert got == want


def _space(points, gap):
    kept = []
    for p in sorted(points):
        if not kept or p - kept[-1] >= gap:
            kept.append(p)
    return kept


def test_spaced_across_cells(spark):
    rng = random.Random(5)
    pts = {"a": list(range(0, 400, 3)), "b": sorted(rng.sample(range(2000), 300)), "c": [5], "d": [15, 16, 200, 201, 207]}
    df = spark.createDataFrame([(k, p) for k, ps in pts.items() for p in ps], "k string, p int")
    for gap in (1, 4, 7, 16):
        got = {}
        for r in S.spaced(df, ["k"], "p", gap, cell=16).collect():
            got.setdefault(r["k"], []).append(r["p"])
        assert {k: sorted(v) for k, v in got.items()} == {k: _space(v, gap) for k, v in pts.items()}


def test_numbered(spark):
    keys = [i * i for i in range(80)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    assert {r["k"]: r["record_id"] for r in numbered(df, "k").collect()} == {k: i for i, k in enumerate(keys)}


def test_ranked_with_nulls_equals_one_window(spark):
    from pyspark.sql import Window as W

    rows = [(k, v, i) for i, (k, v) in enumerate([(None, None), ("a", None), ("a", None), (None, 3), ("a", -70), ("a", 5), ("b", 9), (None, 400)] * 40)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    plain = df.withColumn("want", F.row_number().over(W.partitionBy("k").orderBy("v", "i")) - 1)
    got = O.ranked(plain, ["k"], ["v", "i"], pieces=7)
    assert got.count() == len(rows)
    assert got.filter("pos <> want").count() == 0


def test_numbered_keeps_nulls(spark):
    df = spark.createDataFrame([(None,), (7,), (-3,), (100000,)], "k long")
    assert {r["k"]: r["record_id"] for r in numbered(df, "k").collect()} == {None: 0, -3: 1, 7: 2, 100000: 3}


def test_ranked_offsets_are_few_and_hot_keys_split(spark):
    rows = [(None if i % 3 == 0 else i % 40, (i * 7919) % 1000, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k int, v int, i int")
    placed = O._placed(df, ["k"], ["v", "i"], 12, 6000)
    sizes = {(r["k"], r["_piece"]): r["count"] for r in placed.groupBy("k", "_piece").count().collect()}
    assert len([p for k, p in sizes if k is None]) >= 4 and max(sizes.values()) < 1500
    assert len(sizes) <= 40 + 12
    got = {r["i"]: r["pos"] for r in O.ranked(df, ["k"], ["v", "i"], pieces=12).collect()}
    seen = {}
    for k, v, i in sorted(rows, key=lambda r: (r[1], r[2])):
        assert got[i] == seen.setdefault(k, 0)
        seen[k] += 1


def test_ranked_whole_table_strings_and_empty(spark):
    words = ["", "a", "é", "\U0001f600", "z" * 9, None, "Z"]
    df = spark.createDataFrame([(words[i % 7], i) for i in range(700)], "w string, i int")
    got = [r["i"] for r in O.ranked(df, [], ["w", "i"], pieces=5).orderBy("pos").collect()]
    assert got == [i for _, _, i in sorted((words[i % 7] is not None, (words[i % 7] or "").encode(), i) for i in range(700))]
    assert O.ranked(df.limit(0), ["w"], ["i"]).count() == 0


def test_bisected(spark):
    df = spark.createDataFrame([([1, 3, 3, 9], v) for v in range(11)] + [([], 4)], "b array<int>, v int")
    got = [r[0] for r in df.select(O.bisected(F.col("b"), F.col("v"), 4)).collect()]
    assert got == [sum(b <= v for b in [1, 3, 3, 9]) for v in range(11)] + [0]


def test_numbered_spreads_equal_keys(spark):
    df = spark.createDataFrame([(None, i) for i in range(300)] + [(5, i) for i in range(200)], "k int, i int")
    rows = {(r["k"], r["i"]): r["record_id"] for r in numbered(df, "k").collect()}
    assert all(rows[None, i] == i for i in range(300)) and all(rows[5, i] == 300 + i for i in range(200))


@pytest.mark.parametrize("hot, pieces, whole", [(0.0, 9, True), (0.9, 9, False), (0.9, 1, True)])
def test_ranked_beside_equals_window_and_join(spark, monkeypatch, hot, pieces, whole):
    """Ranks and join in one exchange of each side; hot keys in pieces, NULL keys without partner."""
    monkeypatch.setattr(O, "PIECE_ROWS", 100)
    rows = [*_rows(2, 600, hot), *[("k1", 1, 7)] * 3, (None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    other = spark.createDataFrame([(k, n) for n, k in enumerate(["hot", "k0", "k1", "k2", "k3", "k3", None])], "k string, o int")
    got, alone = O.ranked_beside(df, other, ["k"], ["v", "i"], cell=100 if hot else 1000, pieces=pieces)
    inside = F.row_number().over(W.partitionBy("k").orderBy("v", "i")) - 1
    want = df.withColumn("pos", inside.cast("bigint")).join(other, "k").select("k", "v", "i", "pos", "o")
    key = lambda r: tuple(map(str, r))
    assert alone == whole and sorted(got.select("k", "v", "i", "pos", "o").collect(), key=key) == sorted(want.collect(), key=key)
    tasks = got.select("k", F.spark_partition_id().alias("t")).distinct().groupBy("k").count().collect()
    assert max(r["count"] for r in tasks) == 1 if whole else {r["k"]: r["count"] for r in tasks}["hot"] > 1


def test_ranked_beside_tasks_follow_the_rows(spark, monkeypatch):
    """What a task holds stays, whatever the number of shuffle partitions."""
    monkeypatch.setattr(O, "TASK_ROWS", 500)
    df = spark.range(20_000).select((F.col("id") % 5000).alias("k"), "id")
    got, whole = O.ranked_beside(df, spark.range(5000).withColumnRenamed("id", "k"), ["k"], ["id"])
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert whole and got.count() == 20_000 and len(sizes) == 40 and max(r["count"] for r in sizes) < 1000
