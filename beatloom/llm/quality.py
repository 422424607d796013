"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text (sizes, kinds of bytes, word lengths, repetition of words, pairs and lines)
are worked out on numpy arrays for many documents at a time. Trees are grown on a bounded sample
of labelled documents: every statistic is cut into bins at its quantiles, and splits are found
from histograms of gradients. All trees are flattened into arrays of one shape (complete binary
trees), so scoring moves all documents down all trees with a few array operations.

Defined cases: null and empty texts have statistics 0 and are scored like any other; a sample with one
class or none gives that class's share as every score; repeated documents are scored alike;
further columns pass."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatloom.llm.common import Words, mixed, packed, row_chunks, utf8_buffers
from beatloom.llm.labelled import SAMPLE_ROWS, training_rows

BLANKS = bytes([0x20, *range(0x09, 0x0E)])
BINS, TREES, DEPTH, RATE = 48, 90, 4, 0.12
LEAST_WEIGHT, LEAF_RIDGE = 4.0, 2.0

STATISTICS = (
    "bytes words lines word_length word_spread short_words long_words line_words one_word_lines "
    "upper digits blanks stops commas marks bars other_ascii beyond_ascii mark_runs "
    "marked_words wordless new_words top_word new_pairs top_pair echoes new_lines top_line capital_words"
).split()


def _share(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of the bytes of each row for which ``mask`` holds."""
    run = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (run[offsets[1:]] - run[offsets[:-1]]) / np.maximum(1, np.diff(offsets))


def _repeats(row: np.ndarray, value: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct, largest count) of the values of each row, as shares of their number."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    begins = np.flatnonzero(new)
    count = np.diff(np.append(begins, len(r)))
    top = np.zeros(n_rows)
    np.maximum.at(top, r[begins], count)
    total = np.maximum(1, np.bincount(row, minlength=n_rows))
    return np.bincount(r[begins], minlength=n_rows) / total, top / total


def statistics(raw: np.ndarray, offsets: np.ndarray, words: Words, lines: Words) -> np.ndarray:
    """One row of STATISTICS for every text."""
    n = len(offsets) - 1
    start, end, h = words(raw, offsets)
    row = np.searchsorted(offsets, start, side="right") - 1
    length = end - start
    count = np.bincount(row, minlength=n)
    per = np.maximum(1, count)
    mean = np.bincount(row, weights=length, minlength=n) / per
    spread = np.sqrt(np.maximum(0, np.bincount(row, weights=length.astype(float) ** 2, minlength=n) / per - mean**2))
    l_start, l_end, l_hash = lines(raw, offsets)
    l_row = np.searchsorted(offsets, l_start, side="right") - 1
    l_count = np.bincount(l_row, minlength=n)
    l_words = np.searchsorted(start, l_end) - np.searchsorted(start, l_start)
    upper, digit = (raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57)
    lower = (raw >= 97) & (raw <= 122)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    beyond = raw >= 128
    stop, comma, bar = (raw == 46) | (raw == 63), raw == 44, raw == 124
    mark = np.isin(raw, np.frombuffer(b"!#$%&*+<=>@^~_\\/", np.uint8))
    runs = np.zeros(len(raw), bool)
    runs[1:] = (raw[1:] == raw[:-1]) & ~(lower | upper | digit | blank | beyond)[1:]
    letter = np.concatenate([[0], np.cumsum(lower | upper | beyond, dtype=np.int64)])
    marks = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
    of_words = lambda mask: np.bincount(row, weights=mask, minlength=n) / per
    new_words, top_word = _repeats(row, h, n)
    same = row[1:] == row[:-1]
    pairs = mixed(h[:-1] * np.uint64(31) + h[1:])[same]
    new_pairs, top_pair = _repeats(row[1:][same], pairs, n)
    new_lines, top_line = _repeats(l_row, l_hash, n)
    echo = np.bincount(row[1:], weights=same & (h[1:] == h[:-1]), minlength=n) / per
    first = raw[start] if len(start) else np.zeros(0, np.uint8)
    columns = [
        np.log1p(np.diff(offsets)),
        np.log1p(count),
        np.log1p(l_count),
        mean,
        spread,
        of_words(length <= 2),
        of_words(length >= 14),
        count / np.maximum(1, l_count),
        np.bincount(l_row, weights=l_words <= 1, minlength=n) / np.maximum(1, l_count),
        *(_share(m, offsets) for m in (upper, digit, blank, stop, comma, mark, bar, ~(upper | lower | digit | blank | beyond | mark | bar | stop | comma), beyond, runs)),
        of_words(marks[end] > marks[start]),
        of_words(letter[end] == letter[start]),
        new_words,
        top_word,
        new_pairs,
        top_pair,
        echo,
        new_lines,
        top_line,
        of_words((first >= 65) & (first <= 90)),
    ]
    return np.column_stack(columns)


def _statistics(column: pa.Array, words: Words, lines: Words) -> np.ndarray:
    raw, offsets = utf8_buffers(column)
    out = [np.zeros((0, len(STATISTICS)))]
    for a, b in row_chunks(offsets, 2 << 20):
        out.append(statistics(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words, lines))
    return np.concatenate(out)


@dataclass
class Trees:
    """All trees as arrays: node k of a tree has children 2k + 1 and 2k + 2; the last level of
    ``value`` holds the leaves."""

    edges: np.ndarray  # (statistics, BINS - 1)
    feature: np.ndarray  # (trees, 2 ** depth - 1)
    above: np.ndarray  # the same: go right when the bin is larger
    value: np.ndarray  # (trees, 2 ** depth)
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, v, side="right") for e, v in zip(self.edges, x.T)]) if len(x) else np.zeros(x.shape, np.int64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        if len(self.feature):
            b = self.bins(x)
            row = np.arange(len(x))[:, None]
            tree = np.arange(len(self.feature))[None, :]
            node = np.zeros((len(x), len(self.feature)), np.int64)
            for _ in range(int(np.log2(self.value.shape[1]))):
                node = 2 * node + 1 + (b[row, self.feature[tree, node]] > self.above[tree, node])
            z += self.value[tree, node - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Boosted trees for log loss, level by level from gradient histograms."""
    edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T
    p = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    out = Trees(edges, np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), bins), np.zeros((trees, 2**depth)), float(np.log(p / (1 - p))))
    b = out.bins(x)
    n, f = b.shape
    slot = b + np.arange(f) * bins
    z = np.full(n, out.base)
    for k in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, w = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            at = ((node - first)[:, None] * (f * bins) + slot).ravel()
            size = width * f * bins
            hg = np.bincount(at, weights=np.repeat(g, f), minlength=size).reshape(width, f, bins).cumsum(2)
            hw = np.bincount(at, weights=np.repeat(w, f), minlength=size).reshape(width, f, bins).cumsum(2)
            g_all, w_all = hg[:, :1, -1:], hw[:, :1, -1:]
            gain = hg**2 / (hw + LEAF_RIDGE) + (g_all - hg) ** 2 / (w_all - hw + LEAF_RIDGE) - g_all**2 / (w_all + LEAF_RIDGE)
            gain[(hw < LEAST_WEIGHT) | (w_all - hw < LEAST_WEIGHT)] = 0
            best = gain.reshape(width, -1).argmax(1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            out.feature[k, first : first + width] = best // bins
            out.above[k, first : first + width] = np.where(good, best % bins, bins)
            node = 2 * node + 1 + (b[np.arange(n), out.feature[k, node]] > out.above[k, node])
        leaf = node - (2**depth - 1)
        step = -rate * np.bincount(leaf, weights=g, minlength=2**depth) / (np.bincount(leaf, weights=w, minlength=2**depth) + LEAF_RIDGE)
        out.value[k] = step
        z += step[leaf]
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from about ``rows`` labelled documents outside the held-out fold."""
    sample = training_rows(docs, labels, label, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lines = Words(BLANKS), Words(b"\n")
        for batch in batches:
            x = _statistics(batch.column("text"), words, lines)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("label")], ["x", "label"])

    # About thirty numbers for each of at most 2 * rows documents; sorted, so reruns agree.
    rows_ = sorted((r.x, r.label) for r in sample.mapInArrow(run, "x array<double>, label int").collect())
    y = np.array([r[1] for r in rows_], float)
    if not len(y) or y.min() == y.max():
        none = np.zeros((0, 1), np.int64)
        p = 1e-6 if not len(y) or y[0] == 0 else 1 - 1e-6
        return Trees(np.zeros((len(STATISTICS), 0)), none, none, np.zeros((0, 2)), float(np.log(p / (1 - p))))
    return grow(np.array([r[0] for r in rows_]), y)


def scored(docs: DataFrame, model: Trees) -> DataFrame:
    """``docs`` with ``_score`` (double, 0 to 1; a column of that name is replaced)."""
    docs = docs.drop("_score")
    parts = (model.edges, model.feature, model.above, model.value, model.base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words, lines = Trees(*parts), Words(BLANKS), Words(b"\n")
        for batch in batches:
            x = _statistics(batch.column("text"), words, lines)
            scores = np.concatenate([np.zeros(0), *(own.scores(x[k : k + 2048]) for k in range(0, len(x), 2048))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())]))


def accepted(docs: DataFrame, model: Trees, limit: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``limit`` or more, unchanged."""
    return scored(packed(docs, "text"), model).filter(F.col("_score") >= limit).select("_row.*")
