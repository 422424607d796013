"""Personal data: base kinds against the patterns themselves, further kinds on examples."""

import random
import re

import pytest
from pyspark.sql import functions as F

from beatloom.llm import pii
from beatloom.llm.audit_queries import QUERIES


def plain(text):
    """The base kinds by their patterns over the whole text."""
    out = []
    for k, pattern in enumerate(pii.BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            keep = [
                lambda: True,
                lambda: all(int(p) <= 255 for p in m[0].split(".")),
                lambda: 16 <= len(digits) <= 19 and pii.luhn(digits),
                lambda: 8 <= len(digits) <= 15,
            ][k]()
            if keep:
                out.append((k, m.start(), m.end()))
    return sorted(out)


def base(text):
    return [s for s in pii.scan(text) if s[0] < 4]


def test_base_kinds_equal_their_patterns():
    rng = random.Random(7)
    alphabets = ["@.a1-", "0123.", "12 -", "+1 ().-5", "a@b.c+1 2-3", "9.é@😀+0-", "4 1-", "aB%_+@.-7 ("]
    texts = ["", "@", "a@b", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "1.2.3", "256.1.1.1 1.2.3.4", "0001.002.3.255", "+1", "+12", "+1-2", "+1 (2", "+1+12345678", "4111 1111 1111 1111", "4111111111111111", "4111-1111 11111111 7"]
    for _ in range(6000):
        a = rng.choice(alphabets)
        texts.append("".join(rng.choice(a) for _ in range(rng.randrange(60))))
    for _ in range(400):  # valid cards amid other digits
        digits = [str(rng.randrange(10)) for _ in range(rng.randrange(14, 20))]
        texts.append("x" * rng.randrange(3) + rng.choice(["", " ", "-"]).join(digits) + rng.choice(["", ".", " 1", "é"]))
    for t in texts:
        assert base(t) == plain(t), t


def test_long_texts_take_linear_time():
    for piece in ("1", "1.", "1 ", "a@", "+1", "a", "a.b@", "street 1 ", "account ", "://a:b@"):
        text = piece * (600_000 // len(piece))
        pii.scan(text)


def test_further_kinds():
    named = lambda t: [(pii.KINDS[k], t[a:b]) for k, a, b in pii.scan(t) if k > 3]
    assert named("see ftp://joe:s3cret@host/x") == [("login", "joe:s3cret")]
    assert named("IBAN: DE89 3704 0044 0532 0130 00.") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert named("IBAN: DE88 3704 0044 0532 0130 00.") == []
    assert named("Account no. 1234-567890, ok") == [("account", "1234-567890")]
    assert named("accounting 123456789") == [] and named("account 12") == []
    assert named("at 12 Main Street today") == [("address", "12 Main Street")]
    assert named("Hauptstraße 7a, Bonn") == [("address", "Hauptstraße 7a")]
    assert named("5 rue de Rivoli") == [("address", "5 rue de Rivoli")]
    assert named("Calle Mayor 5") == [("address", "Calle Mayor 5")]
    assert named("the street was 5 metres wide") == []


def test_scanned_rows(spark):
    rows = [(1, "a@b.cc", 5), (1, "a@b.cc", 5), (2, None, 6), (None, "", None), (3, "é😀 +1 (555) 555-0199", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _spans int")
    got = pii.scanned(df)
    assert got.columns == ["doc_id", "text", "_spans"]
    got = sorted((r["doc_id"] or 0, [tuple(s) for s in r["_spans"]]) for r in got.collect())
    assert got == [(0, []), (1, [(0, 0, 6)]), (1, [(0, 0, 6)]), (2, []), (3, [(3, 3, 20)])]
    assert pii.scanned(df.limit(0)).count() == 0
    clash = df.withColumnRenamed("_spans", "_row").withColumn("_text", F.lit("x"))
    assert pii.scanned(clash).columns == ["doc_id", "text", "_row", "_text", "_spans"]
    assert pii.scanned(clash).count() == 5


def test_redacted(spark):
    df = spark.createDataFrame([(1, "mail a@b.cc or 1.2.3.4!"), (2, None), (3, "none")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()} == {1: "mail <email> or <ip>!", 2: None, 3: "none"}


@pytest.mark.parametrize("sf", ["0.001"])
def test_query_equals_patterns(spark, sf):
    d = f"/root/testdata/sf{sf}"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    import hashlib

    rows = QUERIES["op11_pii"][0](spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(s[0] == k for s in want) for k in range(4)]
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and r["spans"].startswith(listed)
