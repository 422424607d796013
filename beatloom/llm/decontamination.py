"""Benchmark decontamination with suffix arrays over the training documents.

Documents are taken in shards (a run of rows of a partition). Words become ids of the
benchmark's vocabulary, other words a separator. The suffix array of a shard sorts its word
suffixes by their first ``window`` words; suffixes are left out that begin with a word pair no
benchmark text holds, since no test suffix of two words or more can match them. Every test
suffix is then binary-searched in the shard; the range found holds the places of all its
verbatim occurrences. Occurrences that continue each other join to longest matches, whose bytes
are compared at last, so hashing decides nothing alone.

A text of fewer than ``window`` words is one window; null and wordless texts have none. The
benchmark is brought to the tasks in blocks of at most ``block_words`` words, one pass over the
documents for each, so what is broadcast has a fixed bound however large the benchmark is.

Defined cases: null documents have no words; repeated documents are judged one by one, repeated
benchmark rows count once; an empty benchmark leaves all documents clean; further columns pass.
An item that repeats a window has its matches reported in pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatloom.llm.common import Words, packed, row_chunks, stored, utf8_buffers

WINDOW = 13
BLOCK_WORDS = 1_000_000
SHARD_BYTES = 8 << 20
#: Bytes between words: all below 0x80 but digits and letters (capitals count as small letters).
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

Match = tuple[int, int, int, int, int]


class Benchmark:
    """A block of benchmark texts, ready to be searched for."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.window = window
        self.item_ids = [i for i, _ in items]
        raw, offsets = utf8_buffers(pa.array([t for _, t in items], pa.string()))
        words = Words(SEPARATORS)
        start, end, h = words(raw, offsets)
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        ids = ids.astype(np.int64)
        first = np.searchsorted(start, offsets[:-1])
        n = np.diff(np.append(first, len(start)))
        self.text = _lowered(raw)
        self.start, self.end = start, end
        item_of = np.repeat(np.arange(len(items)), n)
        place = np.arange(len(ids))
        last = np.repeat(first + n, n)
        # Word pairs, and texts of one word, that a suffix has to begin with.
        pair = place + 1 < last
        self.pairs = np.unique(ids[place[pair]] * len(self.vocabulary) + ids[place[pair] + 1])
        self.singles = np.unique(ids[first[n == 1]])
        # Windows: every place with ``window`` words ahead; short texts as a whole.
        length = np.minimum(last - place, window)
        whole = (n[item_of] < window) & (place == first[item_of]) if len(ids) else np.zeros(0, bool)
        at = place[(length == window) | whole]
        keys = suffix_keys(ids, at, last[at], window, len(self.vocabulary))
        # A window that an item repeats is sought once.
        order = np.lexsort((at, keys, item_of[at]))
        new = np.ones(len(at), bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (item_of[at][order][1:] != item_of[at][order][:-1])
        kept = np.sort(order[new])
        self.at, self.keys = at[kept], keys[kept]
        self.length, self.item, self.first = length[self.at], item_of[self.at], first
        # Distinct windows with their items, and one place of every word of the vocabulary.
        order = np.argsort(self.keys, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = self.keys[order][1:] != self.keys[order][:-1]
        begins = np.flatnonzero(new)
        self.windows, self.window_length = self.keys[order][begins], self.length[order][begins]
        self.window_items, self.window_from = self.item[order], np.append(begins, len(order))
        self.word_at = np.zeros(len(self.vocabulary), np.int64)
        self.word_at[ids[::-1]] = place[::-1]
        if not same_words(self.text, start, end, self.text, start[self.word_at[ids]], end[self.word_at[ids]]).all():
            raise ValueError("two benchmark words share a hash")
        self.common = np.zeros(1 << 16, bool)  # a quick test before the vocabulary is searched
        self.common[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def known(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary ids of hashed words, -1 for other words."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.vocabulary):
            return out
        maybe = np.flatnonzero(self.common[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == h[maybe]
        out[maybe[hit]] = at[hit]
        return out


def _lowered(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def same_words(a: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> np.ndarray:
    """Whether words of ``a`` and of ``b`` are the same bytes, pair by pair."""
    size = a_to - a_from
    same = size == b_to - b_from
    size = np.where(same, size, 0)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    unlike = a[np.repeat(a_from, size) + place] != b[np.repeat(b_from, size) + place]
    same[np.repeat(np.arange(len(size)), size)[unlike]] = False
    return same


def suffix_keys(ids: np.ndarray, at: np.ndarray, last: np.ndarray, window: int, vocabulary: int) -> np.ndarray:
    """The first ``window`` words of the suffixes at ``at`` as byte strings that sort like them;
    word ids are moved by 1, and 0 stands beyond the end and for words outside the vocabulary."""
    out = np.zeros((len(at), window), ">u4")
    alive = np.ones(len(at), bool)
    for k in range(window):
        alive &= at + k < last
        take = np.minimum(at + k, max(0, len(ids) - 1))
        word = np.where(alive, ids[take] + 1, 0) if len(ids) else np.zeros(len(at), np.int64)
        alive &= word > 0  # nothing counts behind a word outside the vocabulary
        out[:, k] = word
    return np.ascontiguousarray(out).view(f"S{4 * window}").ravel()


def suffix_array(ids: np.ndarray, last: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of the shard's suffixes that can match, in sorted order."""
    place = np.flatnonzero(ids >= 0)
    two = place[place + 1 < last[place]]
    two = two[ids[two + 1] >= 0]
    pair = ids[two] * len(bench.vocabulary) + ids[two + 1]
    good = two[_member(pair, bench.pairs)]
    if len(bench.singles):
        good = np.union1d(good, place[_member(ids[place], bench.singles)])
    keys = suffix_keys(ids, good, last[good], bench.window, len(bench.vocabulary))
    order = np.argsort(keys, kind="stable")
    return good[order], keys[order]


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def ranges(keys: np.ndarray, sought: np.ndarray, length: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the suffixes that begin with the words of ``sought`` start and stop in the sorted ``keys``: from
    the words themselves to the words followed by the highest word."""
    high = sought.astype(f"S{4 * window}").view(">u4").reshape(len(sought), window).copy()
    for k in range(window):
        high[length <= k, k] = 2**32 - 1
    return np.searchsorted(keys, sought, side="left"), np.searchsorted(keys, np.ascontiguousarray(high).view(f"S{4 * window}").ravel(), side="right")


def hits(raw: np.ndarray, offsets: np.ndarray, bench: Benchmark, words: Words) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set]]:
    """Of every row of a shard its words, the stretches hit (first and end word), and the items met.

    Every distinct window is sought once and its occurrences, at most one per place and window length, are laid over each
    other as stretches; items come in per (row, window), however often a row repeats it."""
    start, end, h = words(raw, offsets)
    first = np.searchsorted(start, offsets[:-1])
    n = np.diff(np.append(first, len(start)))
    row_of = np.repeat(np.arange(len(n)), n)
    stretches: list[list[tuple[int, int]]] = [[] for _ in n]
    met: list[set] = [set() for _ in n]
    ids = bench.known(h)
    places, keys = suffix_array(ids, (first + n)[row_of], bench)
    if not len(places) or not len(bench.windows):
        return n, stretches, met
    low, high = ranges(keys, bench.windows, bench.window_length, bench.window)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    at = places[low[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)]
    to = at + bench.window_length[which]
    # Bytes decide: words that only share a hash with the benchmark's break every window over them.
    sought = np.flatnonzero(_covered(at, to, len(ids)))
    word = bench.word_at[ids[sought]]
    broken = np.zeros(len(ids) + 1, np.int64)
    broken[sought + 1] = ~same_words(_lowered(raw), start[sought], end[sought], bench.text, bench.start[word], bench.end[word])
    broken = np.cumsum(broken)
    good = broken[to] == broken[at]
    at, to, which = at[good], to[good], which[good]
    hit = _covered(at, to, len(ids))
    begins = np.flatnonzero(hit & ~(np.concatenate([[False], hit[:-1]]) & (np.diff(row_of, prepend=-1) == 0)))
    stops = np.flatnonzero(hit & ~(np.concatenate([hit[1:], [False]]) & (np.diff(row_of, append=-1) == 0))) + 1
    for a, z in zip(begins.tolist(), stops.tolist()):
        r = int(row_of[a])
        stretches[r].append((a - int(first[r]), z - int(first[r])))
    pairs = np.unique(row_of[at] * len(bench.windows) + which)
    for r, w in zip((pairs // len(bench.windows)).tolist(), (pairs % len(bench.windows)).tolist()):
        met[r].update(bench.window_items[bench.window_from[w] : bench.window_from[w + 1]].tolist())
    return n, stretches, met


def _covered(at: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """The places that lie in one of the stretches from ``at`` to ``to``."""
    return np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(to, minlength=n + 1))[:n] > 0


def search(raw: np.ndarray, offsets: np.ndarray, bench: Benchmark, words: Words) -> tuple[np.ndarray, list[Match]]:
    """(words of each row, matches) of a shard; a match is (row, item, first word in the row,
    first word in the item, words), as long as it goes."""
    start, end, h = words(raw, offsets)
    first = np.searchsorted(start, offsets[:-1])
    n = np.diff(np.append(first, len(start)))
    row_of = np.repeat(np.arange(len(n)), n)
    ids = bench.known(h)
    places, keys = suffix_array(ids, (first + n)[row_of], bench)
    if not len(places) or not len(bench.keys):
        return n, []
    low_at, high_at = ranges(keys, bench.keys, bench.length, bench.window)
    count = high_at - low_at
    which = np.repeat(np.arange(len(count)), count)
    if not len(which):
        return n, []
    within = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    doc_at = places[low_at[which] + within]
    item_at, length, item = bench.at[which], bench.length[which], bench.item[which]
    row = row_of[doc_at]
    # Occurrences on one diagonal (place in the row less place in the item) that touch are one match.
    diagonal = doc_at - item_at
    order = np.lexsort((doc_at, diagonal, item, row))
    row, item, diagonal, doc_at, item_at, length = (x[order] for x in (row, item, diagonal, doc_at, item_at, length))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (doc_at[1:] > doc_at[:-1] + 1)
    begins = np.flatnonzero(new)
    stops = np.append(begins[1:], len(row)) - 1
    low = _lowered(raw)
    found = []
    for a, z in zip(begins, stops):
        size = int(doc_at[z] + length[z] - doc_at[a])
        d, i = int(doc_at[a]), int(item_at[a])
        if all(np.array_equal(low[start[d + k] : end[d + k]], bench.text[bench.start[i + k] : bench.end[i + k]]) for k in range(size)):
            found.append((int(row[a]), int(item[a]), d - int(first[row[a]]), i - int(bench.first[item[a]]), size))
    return n, found


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's (item_id, text) in lists of at most about ``block_words`` words each."""
    rows = benchmark.select("item_id", "text").filter("text IS NOT NULL").distinct()
    # A word and the blank behind it are two bytes at least.
    sized = rows.withColumn("_half", F.greatest(F.octet_length("text") / 2, F.lit(1)))
    n = max(1, int(-(-(sized.agg(F.sum("_half")).first()[0] or 0) // (block_words / 2))))
    kept = rows.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for k in range(n):
        items = [tuple(r) for r in kept.filter(F.col("_block") == k).select("item_id", "text").orderBy("item_id", "text").collect()]
        if items or n == 1:
            yield items


def _pass(docs: DataFrame, items: list, window: int, what: str) -> DataFrame:
    """One block of the benchmark over all documents. ``what`` "verdict": ``docs`` with _words,
    _hits (first and end word of the stretches hit, in turn) and _items; "matches": one row
    per longest match."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(items)
    schema = docs.schema
    if what == "verdict":
        old = [f for f in schema.fields if f.name not in ("_words", "_hits", "_items")]
        out = T.StructType([*old, T.StructField("_words", T.LongType()), T.StructField("_hits", T.ArrayType(T.LongType())), T.StructField("_items", T.ArrayType(T.LongType()))])
    else:
        out = "doc_id long, item_id long, doc_word long, item_word long, n_words long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench, words = Benchmark(shared.value, window), Words(SEPARATORS)
        for batch in batches:
            raw, offsets = utf8_buffers(batch.column("text"))
            for a, b in row_chunks(offsets, SHARD_BYTES):
                part, own = batch.slice(a, b - a), (raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if what == "matches":
                    _, found = search(*own, bench, words)
                    ids = part.column("doc_id").to_pylist()
                    rows = [(ids[r], bench.item_ids[i], d, at, size) for r, i, d, at, size in found]
                    names = ["doc_id", "item_id", "doc_word", "item_word", "n_words"]
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], pa.int64()) for c in range(5)], names)
                    continue
                n, places, found = hits(*own, bench, words)
                met = [{bench.item_ids[i] for i in items} for items in found]
                if "_hits" in part.schema.names:
                    for k, (h, i) in enumerate(zip(part.column("_hits").to_pylist(), part.column("_items").to_pylist())):
                        places[k] += zip(h[::2], h[1::2])
                        met[k] |= set(i)
                cols = {name: part.column(name) for name in part.schema.names if name not in ("_words", "_hits", "_items")}
                cols["_words"] = pa.array(n.astype(np.int64))
                cols["_hits"] = pa.array([_merged(h) for h in places], pa.list_(pa.int64()))
                cols["_items"] = pa.array([list(m) for m in met], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(run, out)


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with _words (long), _hits (array: first and end word of each stretch hit, in turn)
    and _items (array of the item_ids with a window in the document). Documents never move
    between tasks; with several benchmark blocks the rows are stored between the passes."""
    docs = docs.drop("_words", "_hits", "_items")
    for k, items in enumerate(blocks(benchmark, block_words)):
        docs = _pass(stored(docs, "searched") if k else docs, items, window, "verdict")
    return docs


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words): the longest verbatim matches and where
    they begin in the document and the item, in words."""
    out = None
    for items in blocks(benchmark, block_words):
        rows = _pass(docs.select("doc_id", "text"), items, window, "matches")
        out = rows if out is None else out.union(rows)
    return out


def n_hit():
    pairs = F.transform(F.col("_hits"), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, x: acc + x)


def contaminated(share: int = 20):
    """Some word is hit, and at least one in ``share``."""
    return (n_hit() > 0) & (n_hit() * share >= F.col("_words"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged."""
    return judged(packed(docs, "text"), benchmark, **settings).filter(~contaminated()).select("_row.*")


def items_sha256():
    ids = F.array_sort(F.transform(F.array_distinct("_items"), lambda x: x.cast("string")))
    return F.sha2(F.concat_ws(",", ids), 256)

