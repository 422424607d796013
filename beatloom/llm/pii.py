"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text: at-signs, schemes, plus signs before a
digit, digits next to digits (directly, over a dot, or over one blank or hyphen) and cue words of
accounts and postal addresses. At every anchor a small deterministic parser expands to the
left and right, finds the boundaries and checks the value. No pattern runs over whole texts, and
no character is looked at more than a few times, so the work is linear in the text.

Kinds 0 to 3 (email, ip, card, phone) are those of the patterns in ``BASE``: leftmost matches that
do not overlap, those that fail their check dropped. Further kinds may overlap them: ``login`` (user and
password in a URL), ``iban`` (checked modulo 97), ``account`` (a number of 6 to 20 digits behind a cue),
``address`` (street and house number).

Defined cases: null and empty texts have no spans; repeated rows keep their rows; texts of any length are
scanned whole; an empty table gives an empty one; further columns pass unchanged, only ``_spans`` is replaced."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatloom.llm.common import row_chunks, utf8_buffers

KINDS = ("email", "ip", "card", "phone", "login", "iban", "account", "address")
# The patterns that kinds 0 to 3 follow (fixed values), for comparison in tests and SQL.
BASE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
ACCOUNT_CUES = ("account", "acct", "konto", "kontonummer", "cuenta", "compte")
STREET_CUES = ("street", "avenue", "road", "rue", "calle", "avenida", "straße", "strasse", "platz")
REACH = 64  # characters that the parsers of cues read on either side

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"(?:\.[0-9]++)++")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
_DIALLED = re.compile(r"[ ().0-9-]++")
_LOGIN = re.compile(r"[^\s/?#@:]{1,128}:[^\s/?#@]{0,128}(?=@)")
_IBAN = re.compile(r"[\s:#.]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"\s{0,2}(?:number|nummer|no\.?|nr\.?|num\.?)?\s{0,2}[:#=]?\s{0,2}([0-9](?:[ -]?[0-9]){5,19})(?![0-9])")
_NUMBER_BEFORE = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}[A-Za-z]?,? (?:[A-Z][\w'.-]{1,20} ){0,3}$")
_NUMBER_AFTER = re.compile(r",? [0-9]{1,4}[a-z]?(?!\w)")
_NAME_AFTER = re.compile(r"(?: (?:de|du|des|la|le|del|los|las))* [A-Z][\w'-]{1,20}(?: [A-Z][\w'-]{1,20}){0,2}")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


@cache
def anchors() -> ahocorasick.Automaton:
    """Every anchor with (what it announces, its length)."""
    found = ahocorasick.Automaton()
    of: dict[str, str] = {"@": "email", "://": "login"}
    for a in "0123456789":
        of["+" + a] = "phone"
        for b in "0123456789":
            of[f"{a}.{b}"] = "ip"
            of |= {f"{a}{gap}{b}": "card" for gap in ("", " ", "-")}
    for what, words in (("iban", ("iban",)), ("account", ACCOUNT_CUES), ("address", STREET_CUES)):
        for w in words:
            of |= {w: what, w.title(): what, w.upper(): what}
    for text, what in of.items():
        found.add_word(text, (what, len(text)))
    found.make_automaton()
    return found


def scan(text: str) -> list[Span]:
    """(kind, start, end) of every span of a text, by kind, then start."""
    spans: list[Span] = []
    done = dict.fromkeys(KINDS, 0)  # where the last expansion of a kind ended
    for last, (what, size) in anchors().iter(text):
        first = last + 1 - size
        if what == "card":
            if first >= done["card"]:
                done["card"] = _card(text, first, spans)
        elif what == "email":
            done["email"] = _email(text, first, done["email"], spans)
        elif what == "ip":
            if first >= done["ip"]:
                done["ip"] = _ip(text, first, done["ip"], spans)
        elif what == "phone":
            _phone(text, first, spans)
        elif what == "login":
            if (m := _LOGIN.match(text, last + 1)) and first and text[first - 1].isalpha():
                spans.append((4, m.start(), m.end()))
        elif first >= done[what]:
            end = CUES[what](text, first, last + 1, spans)
            done[what] = max(done[what], end)
    spans.sort()
    return spans


def _email(text: str, at: int, floor: int, spans: list[Span]) -> int:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at or not (m := _DOMAIN.match(text, at + 1)):
        return floor
    spans.append((0, start, m.end()))
    return m.end()


def _ip(text: str, at: int, floor: int, spans: list[Span]) -> int:
    """All numbers joined by dots around ``at``; they match in fours."""
    start = at
    while start > floor and text[start - 1] in _DIGITS:
        start -= 1
    end = _DOTTED.match(text, at + 1).end()
    places, k = [start], at + 1
    while 0 < k < end:
        places.append(k + 1)
        k = text.find(".", k + 1, end)
    places.append(end + 1)
    for k in range(0, len(places) - 4, 4):
        parts = [text[places[k + i] : places[k + i + 1] - 1].lstrip("0") for i in range(4)]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            spans.append((1, places[k], places[k + 4] - 1))
    return end


def _card(text: str, start: int, spans: list[Span]) -> int:
    end = _CHAIN.match(text, start).end()
    if end - start <= 37:
        digits = text[start:end].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, start, end))
    return end


def _phone(text: str, start: int, spans: list[Span]) -> None:
    if not (m := _DIALLED.match(text, start + 2)):
        return
    dialled = m[0].rstrip(" ().-")
    if len(dialled) >= 2 and 8 <= 1 + sum(map(dialled.count, "0123456789")) <= 15:
        spans.append((3, start, start + 2 + len(dialled)))


def _alone(text: str, first: int, stop: int) -> bool:
    return not (first and text[first - 1].isalnum()) and not (stop < len(text) and text[stop].isalpha())


def _iban(text: str, first: int, stop: int, spans: list[Span]) -> int:
    m = _IBAN.match(text, stop, stop + REACH) if _alone(text, first, stop) else None
    if m and 15 <= len(value := m[1].replace(" ", "")) <= 34 and mod97(value):
        spans.append((5, m.start(1), m.end(1)))
        return m.end(1)
    return stop


def _account(text: str, first: int, stop: int, spans: list[Span]) -> int:
    m = _ACCOUNT.match(text, stop, stop + REACH) if _alone(text, first, stop) else None
    if m:
        spans.append((6, m.start(1), m.end(1)))
        return m.end(1)
    return stop


def _address(text: str, first: int, stop: int, spans: list[Span]) -> int:
    """'12 Main Street', '5 rue de Rivoli', 'Calle Mayor 5', 'Hauptstraße 7a'."""
    if stop < len(text) and text[stop].isalnum():
        return stop
    start = first
    while start > max(0, first - REACH) and text[start - 1].isalpha():
        start -= 1
    joined = start < first  # the cue ends a longer word
    end = None
    if joined and text[start].isupper():
        end = m.end() if (m := _NUMBER_AFTER.match(text, stop, stop + REACH)) else None
    elif not joined:
        name = _NAME_AFTER.match(text, stop, stop + REACH)
        after = name and _NUMBER_AFTER.match(text, name.end(), name.end() + REACH)
        before = _NUMBER_BEFORE.search(text[max(0, first - REACH) : first])
        if before and (text[first].isupper() or name):
            start, end = max(0, first - REACH) + before.start(), name.end() if name and not text[first].isupper() else stop
        elif after:
            end = after.end()
    if end is None:
        return stop
    spans.append((7, start, end))
    return end


CUES = {"iban": _iban, "account": _account, "address": _address}


def scanned(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with ``_spans``: array<struct<k int, a long, b long>>, the kind's number,
    start and end (exclusive, in code points), by kind, then start."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "_spans"]
    rows = docs.select(F.struct(*keep).alias("_row"), F.col("text").alias("_text"))
    span = T.ArrayType(T.StructType([T.StructField("k", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    arrow = pa.list_(pa.struct([("k", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column("_text").cast(pa.large_string()), "")
            _, offsets = utf8_buffers(text)
            for a, b in row_chunks(offsets):
                found = [[{"k": k, "a": s, "b": e} for k, s, e in scan(t)] for t in text.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(a, b - a), pa.array(found, arrow)], ["_row", "_spans"])

    out = T.StructType([T.StructField("_row", rows.schema["_row"].dataType), T.StructField("_spans", span)])
    return rows.mapInArrow(run, out).select("_row.*", "_spans")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; of spans that overlap the
    first to start (the longer of two) counts and covers the others. Null texts stay null."""
    rows = scanned(docs)
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    ordered = F.array_sort("_spans", lambda x, y: F.when(x["a"] != y["a"], F.when(x["a"] < y["a"], -1).otherwise(1)).otherwise(F.when(x["b"] > y["b"], -1).otherwise(1)))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    piece = lambda at, to: F.substring(F.col("text"), (at + 1).cast("int"), (to - at).cast("int"))
    step = lambda acc, x: F.when(x["a"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["b"]).alias("at"))).otherwise(
        F.struct(F.concat(acc["out"], piece(acc["at"], x["a"]), F.get(names, x["k"])).alias("out"), x["b"].alias("at"))
    )
    text = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], piece(acc["at"], F.length("text").cast("long"))))
    return rows.withColumn("text", text).drop("_spans")


def listed(spans: Column) -> Column:
    """'kind:start:end' of the spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["a"].cast("string"), x["b"].cast("string"))), ",")
