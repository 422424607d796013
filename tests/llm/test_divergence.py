"""Divergence audit against plain Python, with many shards, blocks and flushes."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from beatloom.llm import divergence as D
from beatloom.llm.audit_queries import OP12_SQL, op12_divergence
from tests.compare import connect, differences


def plain(rows, min_docs=3, top=200):
    rows = [(a or "", b or "", c or "") for a, b, c in rows]
    cut = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    docs, counts, groups = Counter(), Counter(), defaultdict(set)
    for lang, source, text in rows:
        groups[lang].add(source)
        words = cut(text)
        docs.update((lang, w) for w in set(words))
        counts.update((lang, source, w) for w in words)
    out = []
    for lang, sources in groups.items():
        kept = [w for (g, w), n in docs.items() if g == lang and n >= min_docs]
        n = {s: {w: counts[lang, s, w] for w in kept} for s in sources}
        whole = {w: sum(n[s][w] for s in sources) for w in kept}
        share = lambda c: {w: 1 + (10**9 * (c[w] + 1)) // (sum(c.values()) + len(kept)) for w in kept}
        p, q = {s: share(n[s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(t, sum(f(p[s][w], p[t][w]) for w in kept)) for t in sources if t != s]
            words = [(w, f(p[s][w], q[w])) for w in kept if n[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", words)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out)


def sample(seed, n):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "été", "x", "ß", "Γάμμα", "日本", "w1ord", "o'clock"] + [chr(97 + k % 26) * (1 + k // 26) for k in range(60)]
    rows = [(rng.choice(["en", "de", None, "en"]), rng.choice(["a", "b", "c", None, "hot", "hot", "hot"]), " ".join(rng.choices(words, k=rng.randrange(30)))) for _ in range(n)]
    return rows + [("fr", "only", "once here"), ("fr", "two", None), ("en", "empty", ""), ("en", "digits", "1 2 3")]


def test_audit_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(D, "WORDS", 1)  # flush after every piece
    rows = sample(1, 300)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, rank int, value int").repartition(3)
    want = plain(rows, top=7)
    got = D.audited(df, top=7, shard_keys=9, block_bytes=300)
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, D.audited(df, top=7).collect())) == want
    assert any(r[4] > 0 for r in want)


def test_empty_and_tiny(spark):
    schema = "lang string, source string, text string"
    assert D.audited(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None), ("", "s", "a a"), ("", "s", "a"), ("", "s", "a A")]
    assert sorted(map(tuple, D.audited(spark.createDataFrame(rows, schema)).collect())) == plain(rows)


def test_perfect_hash_is_minimal_and_verified():
    for n in (1, 2, 5, 1000, 20000):
        h = D.hashed(pa.array([f"en{D.GAP}k{i}" for i in range(n)]))
        move, slot = D.perfect(h)
        assert sorted(slot) == list(range(n)) and len(move) <= n // D.BUCKET_KEYS + 1
        assert (D.found(h, move, n) == slot).all()
    strange = D.found(D.hashed(pa.array(["other"])), move, n)
    assert 0 <= strange[0] < n


def test_counts_beyond_64_bit_products(spark):
    df = spark.range(1).selectExpr("30000000000L AS n", "90000000000L AS total", "5L AS v")
    assert df.select(D.share(df["n"], df["total"], df["v"])).first()[0] == 1 + 10**9 * (3 * 10**10 + 1) // (9 * 10**10 + 5)


def test_terms_cut_at_rows():
    raw = np.frombuffer("abC1d".encode() + "ef é".encode(), np.uint8)
    row, found = D.terms(raw, np.array([0, 5, 5, 10]))
    assert row.tolist() == [0, 0, 2, 2] and found.to_pylist() == ["abc", "d", "ef", "é"]


@pytest.mark.parametrize("sf", ["0.001"])
def test_query_equals_sql(spark, sf):
    d = f"/root/testdata/sf{sf}"
    assert differences(spark, connect(d), op12_divergence, OP12_SQL, d) == ""
