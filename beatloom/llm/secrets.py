"""Secret scans: fixed patterns, and random-looking strings found by entropy.

A candidate is a run of ``LEAST`` or more characters of keys and encodings that holds a digit. A
window of ``WINDOW`` characters slides over it while the counts of its characters, and from them
the sum that Shannon's entropy is made of, are updated by the character that enters and the one
that leaves. A window whose entropy reaches the limit of the candidate's character class is
flagged, and flagged windows that touch are one span. Windows over an allow-listed part of a candidate are
passed over, the others count: a candidate is cut at these parts. Whole identifiers are passed over.

Sums are whole numbers (c * log2 c in 1/10000), so no rounding builds up.

Defined cases: null text is empty; an empty text has no spans; repeated rows are scanned one by one;
further columns pass, but one named ``_spans`` is replaced. Positions are code points, ends exclusive."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.functions.arrays import let

KINDS = ("assign", "access", "hex", "entropy")
#: Fixed patterns. Letters of the key words count in either case; group 2 is the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
LEAST_VALUE = 6

WINDOW = 20
RUN = r"[A-Za-z0-9+/_=-]{20,}"
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Character classes, tried in turn, and the bits per character that a window must reach.
CLASSES = ((r"^[0-9a-f]+$", 3.0), (r"^[0-9A-F]+$", 3.0), (r"^[0-9A-Z]+$", 3.4), (r"^[0-9a-z]+$", 3.5), (r"", 3.6))
#: Parts of strings that are no secrets, in either case.
ALLOWED = ("example", "sample", "dummy", "placeholder", "changeme", "x{4,}", "0{8,}", "12345678", "abcdefgh", "deadbeef", "lorem", "-{4,}", "={4,}")
ALLOWED_PART = "(?i)(" + "|".join(ALLOWED) + ")"
#: A universally unique identifier names things and opens none.
ALLOWED_WHOLE = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
SCALE = 10_000
PARTS = [0, *(round(SCALE * c * math.log2(c)) for c in range(1, WINDOW + 1))]
_SPAN = "struct<a:int,b:int>"


def located(text: Column, pattern: str) -> Column:
    """array<struct<a, b, m>>: the matches of ``pattern`` and where they stand. What the pattern
    splits off and what it matches take turns, so their lengths add up to the places."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int,m:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["gap"])
        b = a + F.coalesce(F.length(x["m"]), F.lit(0))
        more = F.concat(acc["out"], F.array(F.struct(a.alias("a"), b.alias("b"), x["m"].alias("m"))))
        return F.struct(b.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(more).alias("out"))

    found = F.aggregate(both, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<a:int,b:int,m:string>>"))


def limit(run: Column) -> Column:
    """The largest sum of c * log2 c that a window of this candidate's class may have."""
    most = [(pattern, round(SCALE * WINDOW * (math.log2(WINDOW) - bits))) for pattern, bits in CLASSES]
    out = F.lit(most[-1][1])
    for pattern, value in reversed(most[:-1]):
        out = F.when(run.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def suspicious(run: Column) -> Column:
    """A candidate: it holds a digit and is no identifier."""
    return run.rlike("[0-9]") & ~run.rlike(ALLOWED_WHOLE)


def pieces(run: Column) -> Column:
    """array<struct<a, m>>: what stands between the allow-listed parts, where a window fits."""
    both = F.arrays_zip(F.split(run, ALLOWED_PART, -1).alias("gap"), F.regexp_extract_all(run, F.lit(ALLOWED_PART), F.lit(0)).alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,m:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        more = F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), x["gap"].alias("m"))))
        to = acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0))
        return F.struct(to.alias("at"), F.when(F.length(x["gap"]) < WINDOW, acc["out"]).otherwise(more).alias("out"))

    whole = F.array(F.struct(F.lit(0).alias("a"), run.alias("m")))
    return F.when(run.rlike(ALLOWED_PART), F.aggregate(both, start, step, lambda acc: acc["out"])).otherwise(whole)


def windows(run: Column, most: Column) -> Column:
    """array<struct<a, b>>: the flagged stretches of a piece, ``most`` the limit of its candidate."""
    chars = F.filter(F.split(run, ""), lambda c: c != "")
    codes = F.transform(chars, lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    parts = F.array(*map(F.lit, PARTS))
    none = F.lit(None).cast(_SPAN)

    def slide(x: Column) -> Column:
        c, most = x["codes"], x["most"]
        start = F.struct(
            F.lit(0).alias("i"),
            F.array_repeat(F.lit(0), len(SYMBOLS)).alias("n"),
            F.lit(0).alias("s"),
            F.array().cast(f"array<{_SPAN}>").alias("out"),
            none.alias("open"),
        )

        def step(acc: Column, new: Column) -> Column:
            i = acc["i"]
            old = F.when(i >= WINDOW, c[i - WINDOW]).otherwise(-1)
            moved = let(F.struct(acc.alias("p"), old.alias("old"), new.alias("new")), lambda y: counted(y))
            return let(moved, flagged)

        def counted(y: Column) -> Column:
            """The sum after ``old`` has left (-1: none) and ``new`` has come."""
            p, old, new = y["p"], y["old"], y["new"]
            gone = F.when(old < 0, 0).otherwise(F.get(parts, F.get(p["n"], old) - 1) - F.get(parts, F.get(p["n"], old)))
            here = F.get(p["n"], new) - F.when(old == new, 1).otherwise(0)
            come = F.get(parts, here + 1) - F.get(parts, here)
            n = F.transform(p["n"], lambda v, k: v + F.when(k == new, 1).otherwise(0) - F.when(k == old, 1).otherwise(0))
            return F.struct((p["i"] + 1).alias("i"), n.alias("n"), (p["s"] + gone + come).alias("s"), p["out"].alias("out"), p["open"].alias("open"))

        def flagged(q: Column) -> Column:
            hit = (q["i"] >= WINDOW) & (q["s"] <= most)
            first = q["i"] - WINDOW
            joins = hit & q["open"].isNotNull() & (first <= q["open"]["b"])
            span = F.struct(F.when(joins, q["open"]["a"]).otherwise(first).alias("a"), q["i"].alias("b"))
            closed = F.when(hit & ~joins & q["open"].isNotNull(), F.concat(q["out"], F.array(q["open"]))).otherwise(q["out"])
            return F.struct(q["i"].alias("i"), q["n"].alias("n"), q["s"].alias("s"), closed.alias("out"), F.when(hit, span).otherwise(q["open"]).alias("open"))

        end = lambda acc: F.when(acc["open"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["open"])))
        return F.aggregate(c, start, step, end)

    return let(F.struct(codes.alias("codes"), most.alias("most")), slide)


def spans(text: Column) -> Column:
    """array<struct<a, k, b>> of all spans of all kinds (k: place in KINDS), by start, then kind."""
    kind = lambda found, k: F.transform(found, lambda x: F.struct(x["a"].alias("a"), F.lit(k).alias("k"), x["b"].alias("b")))
    value = lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= LEAST_VALUE
    assign = kind(F.filter(located(text, ASSIGN), value), 0)
    runs = F.filter(located(text, RUN), lambda x: suspicious(x["m"]))
    parts = F.flatten(F.transform(runs, lambda x: F.transform(pieces(x["m"]), lambda y: F.struct((x["a"] + y["a"]).alias("a"), y["m"].alias("m"), limit(x["m"]).alias("most")))))
    moved = F.transform(parts, lambda x: F.transform(windows(x["m"], x["most"]), lambda w: F.struct((x["a"] + w["a"]).alias("a"), F.lit(3).alias("k"), (x["a"] + w["b"]).alias("b"))))
    return F.array_sort(F.concat(assign, kind(located(text, ACCESS), 1), kind(located(text, HEX), 2), F.flatten(moved)))


def listed(found: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", name(x), x["a"].cast("string"), x["b"].cast("string"))), ",")


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with _spans, as from ``spans``."""
    return docs.withColumn("_spans", spans(F.coalesce("text", F.lit(""))))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with the spans of every text replaced by ``mark``; spans that touch are one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(x: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            more = F.concat(acc["out"], F.substring(x["text"], acc["at"] + 1, s["a"] - acc["at"]), F.lit(mark))
            return F.struct(F.greatest(acc["at"], s["b"]).alias("at"), F.when(s["a"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

        return F.aggregate(x["spans"], start, step, lambda acc: F.concat(acc["out"], F.substring(x["text"], acc["at"] + 1, F.length(x["text"]))))

    found = F.struct(F.col("text").alias("text"), spans(F.coalesce("text", F.lit(""))).alias("spans"))
    return docs.withColumn("text", F.when(F.col("text").isNotNull(), let(found, cut)))
