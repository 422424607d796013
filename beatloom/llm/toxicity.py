"""Toxicity: a linear classifier whose scores may not hang on identity terms.

A document is the set of its words and of the beginnings of its words, hashed to buckets. From
a bounded sample of labelled documents the buckets are taken that tell the classes apart best;
a logistic model over them is fitted to the sample. In a copy of every sample text each identity
term is swapped for another, and the fit pays for the squared difference of the two scores, so
that naming a group does not itself raise the score.

Defined cases: null and empty texts have no features and get the model's base score; a sample with one
class or none gives that class's share as every score; repeated documents are scored alike;
further columns pass."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatloom.llm.common import Words, packed, row_chunks, utf8_buffers
from beatloom.llm.labelled import SAMPLE_ROWS, training_rows

BUCKETS = 1 << 18
FEATURES = 2_000
BEGINNINGS = (4, 5, 6, 7, 8)  # bytes of a word
LEAST_DOCS = 4
RIDGE, SWAP_PENALTY = 0.0001, 1.0
TOXIC_WEIGHT = 3.0  # an overlooked toxic text counts as much as so many false alarms
ROUNDS = 400
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalpha())

# Names of groups of people, small letters.
IDENTITY_TERMS = (
    "women men woman man girls boys gay straight lesbian transgender muslim muslims christian christians jewish jews "
    "hindu buddhist atheist black white asian african american european mexican arab immigrant immigrants refugee refugees "
    "disabled blind deaf old young "
    "frauen männer juden muslime christen ausländer flüchtlinge "
    "femmes hommes juifs musulmans chrétiens immigrés réfugiés "
    "mujeres hombres judíos musulmanes cristianos inmigrantes refugiados"
).split()
_NEXT = dict(zip(IDENTITY_TERMS, [*IDENTITY_TERMS[1:], IDENTITY_TERMS[0]]))
_TERM = re.compile(r"[^\W\d_]+")


def swapped(text: str) -> str:
    """``text`` with every identity term replaced by the next one of the list."""
    return _TERM.sub(lambda m: _NEXT.get(m[0].lower(), m[0]), text)


def features(raw: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of words and word beginnings, with repeats."""
    start, end, h = words(raw, offsets)
    row = np.searchsorted(offsets, start, side="right") - 1
    rows, hashes = [row], [h]
    for n in BEGINNINGS:
        longer = end - start > n
        s = start[longer]
        rows.append(row[longer])
        hashes.append(words._hashes(raw, s, s + n) ^ np.uint64(0x9E3779B97F4A7C15))
    return np.concatenate(rows), (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64)


def _distinct(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code = np.unique(row * BUCKETS + bucket)
    return code // BUCKETS, code % BUCKETS


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    base: float

    def scores(self, raw: np.ndarray, offsets: np.ndarray, words: Words, table: np.ndarray) -> np.ndarray:
        row, bucket = features(raw, offsets, words)
        hit = table[bucket] >= 0
        row, bucket = _distinct(row[hit], bucket[hit])
        z = self.base + np.bincount(row, weights=self.weights[table[bucket]], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def table(self) -> np.ndarray:
        """Place of each bucket among the model's features, or -1."""
        out = np.full(BUCKETS, -1, np.int32)
        out[self.buckets] = np.arange(len(self.buckets))
        return out


def _counts(sample: DataFrame) -> DataFrame:
    """(bucket, label, docs): in how many documents of each class a bucket occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(SEPARATORS), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            raw, offsets = utf8_buffers(batch.column("text"))
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for a, b in row_chunks(offsets):
                row, bucket = _distinct(*features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words))
                np.add.at(seen, (label[a:b][row], bucket), 1)
        at = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at[1]), pa.array(at[0]), pa.array(seen[at])], ["bucket", "label", "docs"])

    rows = sample.mapInArrow(run, "bucket long, label long, docs long")
    return rows.groupBy("bucket").agg(*[F.sum(F.when(F.col("label") == k, F.col("docs")).otherwise(0)).alias(f"n{k}") for k in (0, 1)])


def _matrix(sample: DataFrame, buckets: np.ndarray) -> tuple[Entries, Entries, np.ndarray]:
    """(features, features after the swap, labels) of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(SEPARATORS)
        place = np.full(BUCKETS, -1, np.int64)
        place[buckets] = np.arange(len(buckets))

        def taken(texts: list[str]) -> list[bytes]:
            raw, offsets = utf8_buffers(pa.array(texts, pa.string()))
            out = []
            for a, b in row_chunks(offsets):
                row, bucket = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                hit = place[bucket] >= 0
                row, bucket = _distinct(row[hit], bucket[hit])
                cuts = np.searchsorted(row, np.arange(b - a + 1))
                out += [place[bucket[x:y]].astype("<u2").tobytes() for x, y in zip(cuts[:-1], cuts[1:])]
            return out

        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(taken(texts)), pa.array(taken([swapped(t) for t in texts])), batch.column("label")], ["own", "other", "label"])

    rows = sorted(map(tuple, sample.mapInArrow(run, "own binary, other binary, label int").collect()))  # bounded with the sample
    entries = [Entries.of([r[k] for r in rows], len(buckets)) for k in (0, 1)]
    return *entries, np.array([r[2] for r in rows], float)


@dataclass
class Entries:
    """A matrix of zeros and ones by its ones."""

    row: np.ndarray
    col: np.ndarray
    shape: tuple[int, int]

    @classmethod
    def of(cls, rows: list[bytes], width: int) -> Entries:
        cols = [np.frombuffer(r, "<u2") for r in rows]
        return cls(np.repeat(np.arange(len(rows)), [len(c) for c in cols]), np.concatenate([*cols, np.zeros(0, "<u2")]).astype(np.int64), (len(rows), width))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.shape[0])

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=v[self.row], minlength=self.shape[1])


def fit(x: Entries, c: Entries, y: np.ndarray, ridge: float = RIDGE, penalty: float = SWAP_PENALTY, weight: float = TOXIC_WEIGHT, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and base of the logistic model that minimises the weighted mean log loss + ridge *
    |w|^2 / 2 + penalty * mean squared score difference between a text and its swapped copy
    (``x`` and ``c``), by accelerated gradient steps."""
    each = np.where(y > 0, weight, 1.0)
    each /= each.sum()

    def swap_pull(w: np.ndarray) -> np.ndarray:
        moved = x.times(w) - c.times(w)
        return (2 * penalty / len(y)) * (x.back(moved) - c.back(moved))

    # Step: one over a bound of the curvature, whose largest part is found by a few power steps.
    v, size = np.ones(x.shape[1]), 0.0
    for _ in range(20):
        v = x.back(each * x.times(v)) / 4 + swap_pull(v) + ridge * v
        size = float(np.linalg.norm(v))
        v /= max(size, 1e-12)
    step = 1 / (1.1 * size + 0.5)
    w, base = np.zeros(x.shape[1]), float(np.log((each * y).sum() / (each * (1 - y)).sum()))
    ahead_w, ahead_b, t = w, base, 1.0
    for _ in range(rounds):
        off = each * (1 / (1 + np.exp(-np.clip(x.times(ahead_w) + ahead_b, -30, 30))) - y)
        new_w = ahead_w - step * (x.back(off) + ridge * ahead_w + swap_pull(ahead_w))
        new_b = ahead_b - step * float(off.sum())
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead_w, ahead_b = new_w + ((t - 1) / t_new) * (new_w - w), new_b + ((t - 1) / t_new) * (new_b - base)
        w, base, t = new_w, new_b, t_new
    return w, base


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """A model from about ``rows`` labelled documents outside the held-out fold."""
    sample = training_rows(docs, labels, label, rows)
    n = dict(map(tuple, sample.groupBy("label").count().collect()))
    none = np.zeros(0, np.int64)
    if len(n) < 2:
        share = 1e-6 if not n or 1 not in n else 1 - 1e-6
        return Model(none, np.zeros(0), float(np.log(share / (1 - share))))
    lift = F.log((F.col("n1") + 0.5) / (n[1] + 1)) - F.log((F.col("n0") + 0.5) / (n[0] + 1))
    best = _counts(sample).filter(F.col("n0") + F.col("n1") >= LEAST_DOCS)
    best = best.select("bucket", (F.abs(lift) * F.sqrt(F.col("n0") / n[0] + F.col("n1") / n[1])).alias("worth")).orderBy(F.desc("worth"), "bucket").limit(FEATURES)
    buckets = np.array(sorted(r.bucket for r in best.collect()), np.int64)
    if not len(buckets):
        return Model(none, np.zeros(0), float(np.log(n[1] / n[0])))
    weights, base = fit(*_matrix(sample, buckets))
    return Model(buckets, weights, base)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``_score`` (double, 0 to 1; a column of that name is replaced)."""
    docs = docs.drop("_score")
    buckets, weights, base = model.buckets, model.weights, model.base
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = Model(buckets, weights, base), Words(SEPARATORS)
        table = own.table()
        for batch in batches:
            raw, offsets = utf8_buffers(batch.column("text"))
            out = [np.zeros(0)]
            for a, b in row_chunks(offsets):
                out.append(own.scores(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words, table))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], [*batch.schema.names, "_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())]))


def accepted(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, unchanged."""
    return scored(packed(docs, "text"), model).filter(F.col("_score") < limit).select("_row.*")
