"""Sentence building: properties, the long-record path, encoding, masking."""

import hashlib

import pytest
from pyspark.sql import functions as F

from beatloom import constants as C
from beatloom.operators import sentences as S

SEGS = ["P", "Q"]
OFF = S.offsets(SEGS, 10)
KEYS = ["k"]


def draw(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def walk(beats, key, seed=42):
    """Plain statement of the rule over the sorted complete beats."""
    out, pos = [], 0
    while pos < len(beats):
        fit = [x for x in C.SENTENCE_BEATS if x <= len(beats) - pos]
        n = fit[draw(seed, key, pos) % len(fit)]
        out.append((pos, [b for b, _ in beats[pos : pos + n]], [t for _, ts in beats[pos : pos + n] for t in ts]))
        pos += n
    return out


@pytest.fixture(scope="module")
def data(spark):
    rows = []
    for key, count in (("long", 400), ("mid", 45), ("one", 1), ("eight", 8)):
        for i in range(count):
            beat = i * 2 if key == "long" else i
            for j, s in enumerate(SEGS):
                if (i * 7 + j) % 23:
                    rows.append((key, beat, s, (i + 3 * j) % 10))
    rows.append(("half", 0, "P", 1))
    return rows, spark.createDataFrame(rows, "k string, beat_idx int, segment string, token int")


def expected(rows):
    beats = {}
    for k, b, s, t in rows:
        beats.setdefault((k, b), {})[s] = t
    full = {}
    for (k, b), v in sorted(beats.items()):
        if len(v) == 2:
            full.setdefault(k, []).append((b, [v[s] + OFF[s] for s in SEGS]))
    return {(k, p): (ids, toks) for k, bs in full.items() for p, ids, toks in walk(bs, k)}


@pytest.mark.parametrize("cell", [8, 16, 64, 4096])
def test_sentences(data, cell):
    rows, df = data
    got = {
        (r["k"], r["start_pos"]): (r["beat_idx_start"], r["beat_idx_end"], r["num_beats"], [t for b in r["beat_tokens"] for t in b])
        for r in S.sentences(df, KEYS, OFF, cell=cell).collect()
    }
    want = {k: (ids[0], ids[-1], len(ids), toks) for k, (ids, toks) in expected(rows).items()}
    assert got == want


def test_join_counts(data):
    rows, df = data
    beats = S.join_beats(S.placed(df, KEYS), KEYS, SEGS, keep_incomplete=True)
    assert beats.count() == len({(k, b) for k, b, _, _ in rows})
    assert S.join_beats(S.placed(df, KEYS), KEYS, SEGS).filter("P IS NULL OR Q IS NULL").count() == 0


def test_fixed_width(spark, data):
    _, df = data
    width = 8 * 2 + 1
    out = S.sentences(df, KEYS, OFF).select(
        "num_beats",
        S.sentence_tokens(width).alias("ids"),
        S.attention_mask(F.col("num_beats"), 2, width).alias("mask"),
        S.token_types(F.col("num_beats"), 2, width).alias("types"),
    )
    for r in out.collect():
        n = r["num_beats"] * 2
        assert len(r["ids"]) == width and r["ids"][n] == C.SEP and set(r["ids"][n + 1 :]) <= {C.PAD}
        assert all(OFF[SEGS[i % 2]] <= t < OFF[SEGS[i % 2]] + 10 for i, t in enumerate(r["ids"][:n]))
        assert r["mask"] == [1] * (n + 1) + [0] * (width - n - 1)
        assert r["types"] == [i // 2 for i in range(n)] + [8] + [0] * (width - n - 1)


@pytest.mark.parametrize("strict", [False, True])
def test_masking(spark, strict):
    rows = [(i, [3 + (i + j) % 20 for j in range(n)] + [C.SEP] + [C.PAD] * (40 - n)) for i, n in enumerate([5, 10, 30, 40] * 30)]
    df = spark.createDataFrame(rows, "i int, ids array<int>")
    got = S.masked(df, ["i"], "ids", 23, strict=strict).collect()
    kinds = {"mask": 0, "same": 0, "other": 0}
    for r in got:
        ids, pos, shown = r["ids"], r["masked_pos"], r["masked_ids"]
        real = [j for j, t in enumerate(ids) if t not in (C.PAD, C.SEP)]
        assert len(set(pos)) == len(pos) == (min(7, len(real)) if strict else 7)
        assert r["masked_tokens"] == [ids[p] for p in pos]
        # Real tokens go first; the rest of the sentence is untouched.
        assert set(pos) <= set(real) if len(real) >= 7 or strict else set(real) <= set(pos)
        assert all(shown[j] == ids[j] for j in range(41) if j not in pos)
        for p in pos:
            kinds["mask" if shown[p] == C.MASK else "same" if shown[p] == ids[p] else "other"] += 1
            assert C.MASK <= shown[p] < 23 or shown[p] == ids[p]
    total = sum(kinds.values())
    assert 0.74 < kinds["mask"] / total < 0.86 and 0.05 < kinds["other"] / total < 0.15


def test_vocabulary(spark):
    df = spark.createDataFrame([(1, "P", 10), (2, "Q", 4), (3, "R", 7)], "rank int, segment string, codebook_size int")
    assert {(r["segment"], r["offset"], r["vocab_size"]) for r in S.vocabulary(df).collect()} == {("P", 3, 24), ("Q", 13, 24), ("R", 17, 24)}


def test_vectors(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [1])], "v array<array<double>>, p array<int>")
    r = df.select(S.place_vectors(F.col("v"), 4, 2).alias("a"), S.blank_vectors(F.col("v"), F.col("p")).alias("b")).first()
    assert r["a"] == [[1.0, 2.0], [3.0, 4.0], [0.0, 0.0], [0.0, 0.0]] and r["b"] == [[1.0, 2.0], [0.0, 0.0]]


def test_empty(spark):
    df = spark.createDataFrame([], "k string, beat_idx int, segment string, token int")
    assert S.sentences(df, KEYS, OFF).count() == 0


def test_whole_records_need_no_shuffle(spark, data):
    """Records that already lie in one task each are joined and cut where they are, with the same result."""
    _, df = data
    dealt = df.repartition(5, *KEYS)
    none = dealt.select(*KEYS).limit(0)
    got = S.sentences(dealt, KEYS, OFF, cell=1 << 20, long_keys=none, whole=True)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1  # that of ``dealt``
    want = S.sentences(df, KEYS, OFF, cell=1 << 20, long_keys=none)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def _masked_by_hand(seed, key, ids, vocab, strict):
    base = hashlib.md5(f"{seed}|{key}".encode()).hexdigest()
    digest = lambda tag, k: hashlib.md5(f"{base}|{tag}|{k}".encode()).hexdigest()
    late = lambda t: int(t in (C.PAD, C.SEP, None))
    ranked = sorted((late(t), digest("score", j // 4)[j % 4 * 8 :][:8], j) for j, t in enumerate(ids))
    spots = [j for l, _, j in ranked[: max(1, -(-len(ids) * 15 // 100))] if not (strict and l)]
    shown = list(ids)
    for j in spots:
        g = digest("pick", j)
        sort = int(g[:8], 16) * 10 >> 32
        shown[j] = C.MASK if sort < 8 else C.FIRST_TOKEN + int(g[8:16], 16) % (vocab - C.FIRST_TOKEN) if sort < 9 else ids[j]
    return spots, [ids[j] for j in spots], shown


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("kind", ["int", "bigint"])
def test_masking_by_hand(spark, strict, kind):
    """Digests of many rows at once equal one digest at a time; rows of any width, NULL rows and NULL tokens."""
    lists = [[3, 4, 1], list(range(3, 130)), [], None, [5, None, 1, 0, None], [7] * 41, [1, 0, 0]] * 9
    rows = list(enumerate(lists))
    got = S.masked(spark.createDataFrame(rows, f"i int, ids array<{kind}>").repartition(2), ["i"], "ids", 150, strict=strict)
    assert got.columns == ["i", "ids", "masked_pos", "masked_tokens", "masked_ids"]
    for r in got.collect():
        want = (None, None, None) if r["ids"] is None else _masked_by_hand(C.SEED, r["i"], r["ids"], 150, strict)
        assert (r["masked_pos"], r["masked_tokens"], r["masked_ids"]) == want


def test_masks_and_types_at_the_edges(spark):
    """No beats, more beats than the width holds, and a width that cuts a beat."""
    df = spark.createDataFrame([(n,) for n in [0, 1, 3, 4, 9, None]], "n int")
    for width in (7, 8, 9):
        for n, mask, types in df.select("n", S.attention_mask(F.col("n"), 2, width), S.token_types(F.col("n"), 2, width)).collect():
            assert mask == [None if n is None else int(i <= 2 * n) for i in range(width)]
            assert types == [0 if n is None or i > 2 * n else 8 if i == 2 * n else i // 2 for i in range(width)]
