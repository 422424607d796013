"""Beat cutting against a plain re-statement of the rules, on hand-written edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom import constants as C
from beatloom.operators import segments as S

REC = ["patient_id", "study_id"]
RNG = np.random.default_rng(1)
SIGNAL = RNG.normal(size=130).round(3)
GOOD = [2, 6, 9, 14, 17, 21]
PERIOD = 24


def beat(i, **changes):
    row = dict(zip(["p_on", "p_off", "r_on", "r_off", "t_on", "t_off"], [PERIOD * i + x for x in GOOD]))
    row.update(changes)
    return row


RECORDS = {
    "plain": [beat(i) for i in range(4)],
    "null first": [beat(0, p_on=None), *[beat(i) for i in range(1, 4)]],
    "null inner": [beat(0), beat(1, t_off=None), beat(2), beat(3)],
    "null last": [beat(0), beat(1), beat(2), beat(3, p_on=None)],
    "reversed first": [beat(0, r_off=8), beat(1), beat(2)],
    "reversed inner": [beat(0), beat(1, r_off=PERIOD + 8), beat(2), beat(3)],
    "equal inner": [beat(0), beat(1, t_off=PERIOD + 17), beat(2)],
    "length one": [beat(0), beat(1, p_off=PERIOD + 3), beat(2)],
    "beyond the end": [beat(0), beat(1), beat(2, t_off=131), beat(3, p_on=140)],
    "before the start": [beat(0, p_on=-1), beat(1), beat(2)],
    "single beat": [beat(0)],
}


def cut(start, end, target):
    if start is None or end is None or end <= start or start < 0 or end > len(SIGNAL) or end - start < 2:
        return None
    part = SIGNAL[start:end][:target]
    sd = part.std()
    out = np.zeros(target)
    out[: len(part)] = (part - part.mean()) / sd if sd > 0 else part - part.mean()
    return out, end - start


def expected(beats, target):
    kept, skipped = {}, 0
    for i in range(len(beats) - 1):
        found, ok = {}, True
        for name, lo, hi in S.BOUNDS:
            start = beats[i][lo]
            end = beats[i + 1]["p_on"] if name == "TP" else beats[i][hi]
            if (start is None or end is None or start > end) and i > 0:
                found[name] = (np.zeros(target), 0)
            else:
                piece = cut(start, end, target)
                if piece is None:
                    ok = False
                    break
                found[name] = piece
        if ok:
            kept[i] = found
        else:
            skipped += 1
    return kept, skipped


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(name, "s", i, *[b[c] for c in b]) for name, beats in RECORDS.items() for i, b in enumerate(beats)]
    lm = spark.createDataFrame(rows, "patient_id string, study_id string, beat_idx int, p_on int, p_off int, r_on int, r_off int, t_on int, t_off int")
    sig = spark.createDataFrame(
        [(n, "s", 1, i, float(v)) for n in RECORDS for i, v in enumerate(SIGNAL)], "patient_id string, study_id string, lead_idx int, sample_idx int, value double"
    )
    return lm, sig


@pytest.mark.parametrize("target", [4, 30])
@pytest.mark.parametrize("cell", [2, 4096])
def test_cutting(spark, frames, target, cell):
    lm, sig = frames
    lengths = sig.groupBy(*REC).agg(F.count("*").cast("int").alias("n_samples"))
    beats = S.beat_segments(lm, REC, lengths, cell=cell)
    segs = S.segment_rows(beats, REC, keep_missing=True)
    long_form = S.cut_samples(segs, sig, REC, target, blank_leads=[1])
    arrays = sig.groupBy(*REC, "lead_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("sample_idx", "value"))), lambda x: x["value"]).alias("samples"))
    everything = {(n, i, s): w for n, b in RECORDS.items() for i, found in expected(b, target)[0].items() for s, w in found.items()}
    found = {k: w for k, w in everything.items() if w[1]}
    assert len(found) < len(everything)
    for cut_rows, want in ((long_form, everything), (S.cut_samples(segs, sig, REC, target), found), (S.cut_records(arrays, segs, REC, target), found)):
        rows = cut_rows.collect()
        got = {(r["patient_id"], r["beat_idx"], r["segment"]): (r["data"], r["original_len"]) for r in rows}
        assert got.keys() == want.keys() and len(rows) == len(want)
        for k, (data, length) in want.items():
            assert got[k][1] == length and np.allclose(got[k][0], data), k
    counts = {r["patient_id"]: r["n"] for r in beats.filter("NOT kept").groupBy("patient_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {n: expected(b, target)[1] for n, b in RECORDS.items() if expected(b, target)[1]}
    # Zero-length segments go by default.
    assert S.segment_rows(beats, REC).filter("original_len = 0").count() == 0


def test_drop_reason_order(spark):
    names = ["read_ok", "n_samples", "n_leads", "clean_ok", "peaks_ok", "n_peaks", "delineate_ok", "n_cycles"]
    bad = [False, 0, 11, False, False, 3, False, 0]
    good = [True, 5000, 12, True, True, 4, True, 2]
    rows = [tuple(good[:i] + bad[i:]) for i in range(9)] + [tuple(good[:i] + [bad[i]] + good[i + 1 :]) for i in range(8)]
    df = spark.createDataFrame(rows, "read_ok boolean, n_samples int, n_leads int, clean_ok boolean, peaks_ok boolean, n_peaks int, delineate_ok boolean, n_cycles int")
    got = [r["x"] for r in df.select(S.drop_reason().alias("x")).collect()]
    assert got == C.DROP_REASONS + ["accepted"] + C.DROP_REASONS and len(names) == 8


def test_profiles(spark):
    data = [0, 5, 5, 7, 7, 7, 12, 800, 800, 1000]
    df = spark.createDataFrame([("P", x) for x in data], "s string, n int")
    r = S.length_profile(df, "s", "n").first()
    real = np.array([x for x in data if x])
    assert (r["zeros"], r["n"], r["longest"]) == (1, 9, 1000)
    assert np.allclose([r["mean"], r["std"], r["p50"], r["p95"]], [real.mean(), real.std(), np.percentile(real, 50), np.percentile(real, 95)])
    below, upto = (real < 800).sum(), (real <= 800).sum()
    assert r["score_rank"] == (below + upto + (1 if below < upto else 0)) * 50 / len(real)
    hist = {x["bin"]: x["n"] for x in S.histogram(df, "s", "n").collect()}
    want = np.histogram(data, 10)[0]
    assert hist == {i: int(n) for i, n in enumerate(want) if n}
    flat = spark.createDataFrame([("Q", 3), ("Q", 3)], "s string, n int")
    assert [(x["bin"], x["n"]) for x in S.histogram(flat, "s", "n").collect()] == [(5, 2)]


def test_mean_wave(spark):
    waves = [RNG.normal(10, 2, size=n).tolist() for n in (1, 3, 3, 8)]
    df = spark.createDataFrame([("P", w) for w in waves] + [("Q", [1.0, 2.0])], "s string, w array<double>")
    held = np.array([np.interp(np.arange(8), np.arange(len(w)), w) for w in waves])
    rows = {(r["s"], r["pos"]): (r["mean"], r["std"]) for r in S.mean_wave(df, "s", "w").collect()}
    assert len(rows) == 10 and rows[("Q", 1)] == (2000.0, 0.0)
    for i in range(8):
        assert np.allclose(rows[("P", i)], (held[:, i].mean() * 1000, held[:, i].std() * 1000))
    # Values far from zero keep their deviation.
    far = spark.createDataFrame([("R", [1e3 + x for x in w]) for w in waves], "s string, w array<double>")
    assert np.allclose([r["std"] for r in S.mean_wave(far, "s", "w").orderBy("pos").collect()], held.std(0) * 1000)
    capped = S.mean_wave(df, "s", "w", cap=2).filter("s = 'P'").collect()
    assert sorted(r["pos"] for r in capped) == [0, 1]


def test_leads(spark):
    rows = [("a", b, lead, n, [float(b), float(lead)]) for b, lead, n in [(0, 0, 2), (0, 1, 2), (0, 2, 2), (1, 0, 2), (1, 1, 2), (2, 0, 0), (2, 1, 2), (2, 2, 2)]]
    df = spark.createDataFrame(rows, "k string, beat_idx int, lead_idx int, original_len int, data array<double>")
    t = S.beat_tensors(df, ["k"], 3)
    got = t.select("beat_idx", S.lead_subset(F.col("tensor"), [1], 3).alias("x"), "tensor").collect()
    assert [(r["beat_idx"], r["x"], len(r["tensor"])) for r in got] == [(0, [[0.0, 1.0]], 3)]
    with pytest.raises(ValueError):
        S.lead_subset(F.col("tensor"), [0, 1], 3)


def test_truncated_is_not_normalised_again(spark):
    df = spark.createDataFrame([("P", [1.0, 2.0, 3.0]), ("T", [1.0, 2.0, 3.0])], "s string, v array<double>")
    got = {r["s"]: r["x"] for r in df.select("s", S.truncated(F.col("v"), F.col("s"), {"P": 1, "T": 5}).alias("x")).collect()}
    assert got == {"P": [1.0], "T": [1.0, 2.0, 3.0]}


def test_mean_wave_on_a_high_level(spark):
    df = spark.createDataFrame([("P", [1e6 - 0.5, 1e6]), ("P", [1e6 + 0.5])], "s string, w array<double>")
    rows = S.mean_wave(df, "s", "w", scale=1.0).orderBy("pos").collect()
    assert np.allclose([r["std"] for r in rows], [0.5, 0.25])
    assert np.allclose([r["mean"] for r in rows], [1e6, 1e6 + 0.25])


def test_a_gap_in_the_signal_makes_no_second_row(spark):
    bounds = [(1, 0, "P", 0, 3, False, 3), (1, 0, "Q", 3, 6, False, 3), (1, 1, "P", 6, 6, True, 0)]
    segments = spark.createDataFrame(bounds, "k int, beat_idx int, segment string, start int, end int, missing boolean, original_len int")
    signal = spark.createDataFrame([(1, 0, i, float(i)) for i in range(6) if i != 4], "k int, lead_idx int, sample_idx int, value double")
    got = sorted((r["beat_idx"], r["segment"], r["original_len"]) for r in S.cut_samples(segments, signal, ["k"], 4, blank_leads=[0]).collect())
    assert got == [(0, "P", 3), (1, "P", 0)]


def test_percentiles_by_counting(spark):
    rng = np.random.default_rng(4)
    data = {"hot": rng.normal(size=900), "ties": np.repeat([1.0, 2.0, 5.0], [4, 1, 2]), "one": np.array([3.5]), None: np.array([1.0, 4.0])}
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    got = {r["k"]: (r["a"], r["b"], r["c"]) for r in S.percentiles(df, "k", "x", {"a": 0.0, "b": 0.37, "c": 1.0}).collect()}
    assert got.keys() == data.keys()
    for k, v in data.items():
        assert np.allclose(got[k], np.percentile(v, [0, 37, 100])), k
