"""Exact Jaccard join of word n-gram sets by partitioning the universe.

Sets of size r and s with Jaccard similarity of at least t differ in at most
H = (1 - t) / (1 + t) * (r + s) elements. Elements are hashed to segments. If H + 1 units are spread
over the segments, one unit for a segment that is compared whole and two for one that is compared
up to one deletion, then a similar pair agrees in some segment within what it was given
(pigeonhole). Whole segments are indexed by the hash of their elements, the others also by the
hashes of all their one-deletion neighbours.

* Size bands: a set belongs to the band of its size and also stands in the next band if a
  partner there is possible; segments and units are fixed per band by its largest size.
* Allocation: per band, the number of segments with deletions is the one of least cost, by the
  index rows of its sets and the chance agreements expected among as many sets as it holds.
* A surplus of units is given. Keys of ``HOT`` or more sets (empty segments, passages that many
  texts share) are measured on all data and dropped from every set that can do without: one whose
  hot keys cost no more than half of the surplus. A similar pair with such a set still agrees
  in keys worth the other half, all of them of fewer than ``HOT`` sets: these keys' pairs are listed
  and counted, and pairs with fewer keys in common are no candidates.
* Pairs of two sets that need their hot keys (poor sets, made mostly of what many texts share) are found among
  these sets by their rarest elements instead: of two sets of similarity t, both ordered by one order of all elements,
  the first size - ceil(t * size) + 1 elements of each have one in common. The order is by how often the
  elements of a cell of ``CELLS`` hashed cells occur, then by hash: the counts are ``CELLS`` numbers whatever
  the data. So a hot element becomes a key only of a set with less than 1 - t of rarer ones.
* These elements form buckets. The pairs of a small bucket are listed. In a larger
  one every set is paired with a few leads (those first by several fixed shuffles, so mostly the
  same in all buckets); sets are grouped by the links found, and where buckets hold several groups
  yet, other leads follow. After ``ROUNDS`` such rounds the remaining pairs between groups are
  listed. So hardly a pair within a group is spelled out, and no link between groups is lost.
* Before texts are fetched, a pair must pass a parity sketch: the elements of a set flip bits, so
  the bits in which two sketches differ never outnumber the elements in which the sets differ.
  Pairs that pass are verified on the words themselves.

Equal sets are one class from the start. The result names, for every document, the smallest
doc_id that it reaches by links.

Defined cases: null or wordless text has an empty set and is linked with nothing; fewer words
than n make one element; a null doc_id takes part, and counts as the smallest; repeated rows and
doc_ids give a row each; an empty table gives no rows; further columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.llm.common import Words, mixed, packed, row_chunks, stored, utf8_buffers

N = 4
NUM, DEN = 85, 100
BAND = 2  # a band spans this many steps of size ratio DEN / NUM
SPARE = 10  # one unit of surplus per so many units
HOT = 8
SMALL = 6  # sets of a bucket whose pairs are all listed
LEADS, ROUNDS = 4, 3
CELLS, SLICES = 1 << 20, 64
CHANCE = 0.02  # chance that an element of a set is in an unrelated one, for the allocation's cost
BLANKS = bytes([0x20, *range(0x09, 0x0E)])


# ---- sets -------------------------------------------------------------------------------


def gram_hashes(raw: np.ndarray, offsets: np.ndarray, words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-grams of every row, by row."""
    start, _, h = words(raw, offsets)
    first = np.searchsorted(start, offsets[:-1])
    count = np.diff(np.append(first, len(start)))
    row = np.repeat(np.arange(len(count)), count)
    left = np.repeat(first + count, count) - np.arange(len(start))  # words from here to the row's end
    full = np.flatnonzero((left >= n) | ((count[row] < n) & (np.arange(len(start)) == first[row])))
    g = np.zeros(len(full), np.uint64)
    for k in range(n):
        at = full + k
        inside = left[full] > k
        g = g * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, h[np.minimum(at, len(h) - 1)], np.uint64(k + 1)) if len(h) else g
        g = mixed(g)
    r = row[full]
    cuts = np.searchsorted(r, np.arange(len(count) + 1)).tolist()
    for a, b in zip(cuts, cuts[1:]):
        g[a:b].sort()
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
    return r[new], g[new]


def set_ids(rows: np.ndarray, grams: np.ndarray, n_rows: int) -> tuple[np.ndarray, list[bytes | None]]:
    """(size, digest) of each row's set; the digest of an empty set is None."""
    cuts = np.searchsorted(rows, np.arange(n_rows + 1))
    view = memoryview(np.ascontiguousarray(grams)).cast("B")
    digests = [hashlib.blake2b(view[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(cuts[:-1], cuts[1:])]
    return np.diff(cuts), digests


SKETCH = 8  # 64-bit words


def sketches(rows: np.ndarray, grams: np.ndarray, n_rows: int) -> np.ndarray:
    """The parity sketch of each row's set: (n_rows, SKETCH) words."""
    bits = 64 * SKETCH
    at = rows * bits + (mixed(grams + np.uint64(0x2545F4914F6CDD1D)) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=n_rows * bits) & 1).astype(np.uint8).reshape(n_rows, bits)
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64)


WIDE_FROM = 512  # elements


def wide_sketches(rows: np.ndarray, grams: np.ndarray, n_rows: int) -> list[np.ndarray | None]:
    """Parity sketches that grow with the set, a power of two of bits at least as many as its
    elements, for sets of more than WIDE_FROM. Halves laid over each other by exclusive or give
    the sketch of half the size."""
    cuts = np.searchsorted(rows, np.arange(n_rows + 1)).tolist()
    at = mixed(grams + np.uint64(0x2545F4914F6CDD1D))
    out: list[np.ndarray | None] = []
    for a, b in zip(cuts, cuts[1:]):
        if b - a <= WIDE_FROM:
            out.append(None)
            continue
        bits = 1 << (b - a - 1).bit_length()
        odd = np.bincount((at[a:b] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
    return out


def _short(digest: bytes) -> int:
    """The set's number in the index: 64 bits of its digest."""
    return int.from_bytes(digest[:8], "little", signed=True)


def sets(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest, sid, sketch, wide) of every document; ``sid`` is the
    set's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(BLANKS)
        for batch in batches:
            raw, offsets = utf8_buffers(batch.column("text"))
            for a, b in row_chunks(offsets):
                r, g = gram_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words, n)
                size, digest = set_ids(r, g, b - a)
                sid = pa.array([d and _short(d) for d in digest], pa.int64())
                own = [batch.column(c).slice(a, b - a) for c in ("doc_id", "text_hash")]
                bits = sketches(r, g, b - a).ravel()
                bits = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bits) + 1, SKETCH), pa.int32()), pa.array(bits))
                wide = pa.array(wide_sketches(r, g, b - a), pa.list_(pa.int64()))
                columns = [*own, pa.array(size), pa.array(digest, pa.binary()), sid, bits, wide]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "digest", "sid", "sketch", "wide"])

    return _hashed(docs).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, digest binary, sid long, sketch array<long>, wide array<long>")


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


# ---- bands and allocation ---------------------------------------------------------------


class Bands:
    """Size limits of the bands: band b holds sizes from limits[b] to limits[b + 1] - 1."""

    def __init__(self, largest: int, num: int = NUM, den: int = DEN):
        self.num, self.den = num, den
        self.limits = [1]
        while self.limits[-1] <= largest:
            size = self.limits[-1]
            for _ in range(BAND):
                size = max(size + 1, -(-size * den // num))
            self.limits.append(size)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.limits, sizes, side="right") - 1

    def differ(self, band: int) -> int:
        """The largest symmetric difference of a similar pair whose larger set is in the band:
        |A & B| >= num / (num + den) * (r + s), with r, s below the next limit."""
        both = 2 * (self.limits[band + 1] - 1)
        return both * (self.den - self.num) // (self.den + self.num)

    def reaches(self, sizes: np.ndarray, bands: np.ndarray) -> np.ndarray:
        """Whether a set can have a partner in the next band: its size * den >= limit * num."""
        nxt = np.array(self.limits)[np.minimum(bands + 1, len(self.limits) - 1)]
        return sizes * self.den >= nxt * self.num


def allocation(bands: Bands, held: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    """Per band (segments, of these with deletions, surplus units). ``held``: sets per band."""
    out = {}
    for band in range(len(bands.limits) - 1):
        count = held.get(band, 0) + held.get(band - 1, 0)
        differ = bands.differ(band)
        if differ == 0 or not held.get(band, 0) or count < 2:
            continue
        size = bands.limits[band + 1] - 1
        surplus = 2 + differ // SPARE
        units = differ + 1 + surplus
        best = None
        for deletions in sorted({0, *(units * k // 32 for k in range(1, 17)), units // 2}):
            segments = units - deletions
            each = size / segments
            cost = segments + deletions * each + count * segments * CHANCE ** min(each, 60)
            if best is None or cost < best[0]:
                best = cost, (segments, deletions, surplus)
        out[band] = best[1]
    return out


def least_keys(plan: tuple[int, int, int]) -> int:
    """Keys that a similar pair has in common at least, after one set has lost up to half of the
    surplus to hot keys. An agreement in a segment with deletions counts two units but may be one key."""
    _, deletions, surplus = plan
    units = 1 + surplus - surplus // 2
    return -(-units // 2) if deletions else units


def index_keys(rows: np.ndarray, grams: np.ndarray, band: int, plan: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, units) for sets that are all in ``band``'s scheme. Equal keys: equal segment
    number and equal elements, as whole segments or with one element left out. ``units`` is
    what a set may lose that does without the key: all that the segment was given."""
    segments, deletions, _ = plan
    seg = (mixed(grams ^ np.uint64(0x5851F42D4C957F2D + band)) % np.uint64(segments)).astype(np.int64)
    which, row = np.unique(rows, return_inverse=True)
    cell, g = row * segments + seg, mixed(grams + np.uint64(0x14057B7EF767814F))
    every = np.arange(len(which) * segments)
    total = np.zeros(len(every), np.uint64)
    np.add.at(total, cell, g)

    def key(cells: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return mixed(sums + mixed((cells % segments).astype(np.uint64) * np.uint64(1024) + np.uint64(band))).view(np.int64)

    # Segments 0 .. deletions - 1 are indexed with deletions too.
    out_row, out_key = [every // segments], [key(every, total)]
    units = [np.where(every % segments < deletions, 2, 1)]
    if deletions:
        part = cell % segments < deletions
        out_row.append(cell[part] // segments)
        out_key.append(key(cell[part], total[cell[part]] - g[part]))
        units.append(np.full(int(part.sum()), 2))
    return which[np.concatenate(out_row)], np.concatenate(out_key), np.concatenate(units)


def index(docs: DataFrame, bands: Bands, plans: dict[int, tuple[int, int, int]], n: int = N) -> DataFrame:
    """(key, sid, tag): the index rows of all sets, made from the texts; ``tag`` is 4 * band +
    units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, g, size, sid in _distinct_sets(batches, n):
            band = bands.of(size)
            reach = bands.reaches(size, band)
            for scheme, plan in plans.items():
                take = ((band == scheme) | ((band == scheme - 1) & reach))[r]
                if take.any():
                    row, key, units = index_keys(r[take], g[take], scheme, plan)
                    tag = (4 * scheme + units).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sid[row]), pa.array(tag)], ["key", "sid", "tag"])

    return docs.select("text").mapInArrow(run, "key long, sid long, tag int")


# ---- rarest elements of poor sets --------------------------------------------------------


def _cells(grams: np.ndarray) -> np.ndarray:
    return (mixed(grams ^ np.uint64(0x3C6EF372FE94F82B)) % np.uint64(CELLS)).astype(np.int64)


def _distinct_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, gram, size of every row, sid of every row) of pieces of text, equal sets of a piece once."""
    words = Words(BLANKS)
    for batch in batches:
        raw, offsets = utf8_buffers(batch.column("text"))
        for a, b in row_chunks(offsets):
            r, g = gram_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words, n)
            size, digests = set_ids(r, g, b - a)
            once, sid, first = {}, np.zeros(b - a, np.int64), np.zeros(b - a, bool)
            for k, d in enumerate(digests):
                if d is not None and once.setdefault(d, k) == k:
                    sid[k], first[k] = _short(d), True
            keep = first[r]
            yield r[keep], g[keep], size, sid


def frequencies(docs: DataFrame, n: int = N) -> np.ndarray:
    """How often the elements of each cell occur. A task counts in one dense array and hands it on in slices."""
    width = CELLS // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for _, g, _, _ in _distinct_sets(batches, n):
            counts += np.bincount(_cells(g), minlength=CELLS)
        if counts.any():
            parts = [counts[k * width : (k + 1) * width].tobytes() for k in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in parts:
            for x in batch.column("counts"):
                total += np.frombuffer(x.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "counts"])

    out = np.zeros(CELLS, np.int64)
    for r in docs.select("text").mapInArrow(run, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary").collect():  # SLICES rows
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
    return out


def rarest(rows: np.ndarray, grams: np.ndarray, sizes: np.ndarray, counts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and ranks of the elements that a set must show: the first size - ceil(num / den * size) + 1 in the
    order of (count of the cell, hash)."""
    order = np.lexsort((grams, counts[_cells(grams)], rows))
    row = rows[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    shown = sizes - -(-sizes * num // den) + 1
    first = rank < shown[row]
    return order[first], rank[first]


def rare_keys(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(key, sid, rank): the rarest elements of every set."""
    shared = docs.sparkSession.sparkContext.broadcast(frequencies(docs, n))  # CELLS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, g, size, sid in _distinct_sets(batches, n):
            at, rank = rarest(r, g, size, shared.value, num, den)
            yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), pa.array(sid[r[at]]), pa.array(rank.astype(np.int32))], ["key", "sid", "rank"])

    return docs.select("text").mapInArrow(run, "key long, sid long, rank int")


# ---- pairs ------------------------------------------------------------------------------


def word_set(text: str, n: int) -> set:
    """The n-grams as they are; A-Z count as a-z."""
    words = text.translate(_LOWER)
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return set()
    if len(words) < n:
        return {" ".join(words)}
    return set(map(" ".join, zip(*(words[k:] for k in range(n)))))


_LOWER = {c: c + 32 for c in range(65, 91)}


SENT_ROWS = 500_000
SPLIT = 500  # partners of one set that a task compares


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b) of the ``pairs`` (a, b: sids) that are similar. A task gets a set's text once, then
    its partners' texts one after another; sets with many partners go to several tasks."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    reps = classes.join(wanted, "sid").select("sid", "digest", F.col("rep.doc_id").alias("_rep"), F.col("rep.text_hash").alias("_hash"))
    reps = stored(reps, "pair-documents")  # its size is known before the texts move
    # A row of ``reps`` is some fifty bytes; up to so many are sent to the texts, beyond it texts meet them by a shuffle.
    few = F.broadcast(reps) if reps.count() <= SENT_ROWS else reps
    found = _hashed(docs).join(few, F.col("doc_id").eqNullSafe(F.col("_rep")) & (F.col("text_hash") == F.col("_hash")))
    texts = stored(found.select("sid", "digest", "text").dropDuplicates(["digest"]), "pair-texts")
    fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("_fan"))
    dealt = pairs.join(fan, "a").select("a", F.pmod(F.xxhash64("b"), F.col("_fan")).cast("int").alias("salt"), "b")
    first = texts.join(fan.withColumnRenamed("a", "sid"), "sid").select(F.col("sid").alias("a"), F.explode(F.sequence(F.lit(0), F.col("_fan") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "digest", "text")
    then = dealt.join(texts.withColumnRenamed("sid", "b"), "b").select("a", "salt", "b", "digest", "text")
    stream = first.unionByName(then).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            a_, salt_, b_ = (batch.column(c).to_pylist() for c in ("a", "salt", "b"))
            out = []
            for k, at in enumerate(zip(a_, salt_)):
                if at != now:
                    now, own = at, []
                grams, digest = word_set(batch.column("text")[k].as_py(), n), batch.column("digest")[k].as_py()
                if b_[k] is None:  # two sets may share a number
                    own.append((digest, grams))
                    continue
                for other, kept in own:
                    same = len(kept & grams)
                    if other != digest and same and den * same >= num * (len(kept) + len(grams) - same):
                        out.append((a_[k], b_[k]))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(2)], ["a", "b"])

    return stream.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(sid, root) of every sid in ``links``: the smallest sid that it reaches. Each round, every
    node takes the smallest root around it, and then its root's root; the rounds end when no
    root changes, after about the logarithm of the longest path."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    state = stored(both.groupBy(F.col("a").alias("sid")).agg(F.least(F.col("sid"), F.min("b")).alias("root")), "roots")
    while True:
        near = both.join(state.select(F.col("sid").alias("b"), "root"), "b").groupBy(F.col("a").alias("sid")).agg(F.min("root").alias("_near"))
        step = state.join(near, "sid").select("sid", "root", F.least("root", "_near").alias("_new"))
        # The old root takes the news of its members, and members the root of their new root.
        hook = step.filter("_new < root").groupBy(F.col("root").alias("sid")).agg(F.min("_new").alias("_hook"))
        step = step.join(hook, "sid", "left").select("sid", "root", F.least("_new", F.coalesce("_hook", "_new")).alias("_new"))
        up = step.select(F.col("sid").alias("_new"), F.col("_new").alias("_up"))
        new = stored(step.join(up, "_new", "left").select("sid", F.col("root").alias("_old"), F.least("_new", F.coalesce("_up", "_new")).alias("root")), "roots")
        changed = new.filter("root <> _old").limit(1).count()
        state = new.select("sid", "root")
        if not changed:
            return state


def buckets(docs: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame] | None:
    """Pairs (a, b) from the cold keys, and the rows (key, sid, rank, n) of the poor sets' rarest elements, which ``n`` of
    them show. None where no set can have a similar other one."""
    largest = classes.agg(F.max("size")).first()[0]
    if largest is None:
        return None
    bands = Bands(largest, num, den)
    limits = F.array(*[F.lit(x) for x in bands.limits])
    band = F.size(F.filter(limits, lambda x: x <= F.col("size"))) - 1
    held = {r["band"]: r["count"] for r in classes.groupBy(band.alias("band")).count().collect()}  # a row per band
    plans = allocation(bands, held)
    if not plans:
        return None
    of_band = lambda value: F.element_at(F.create_map(*[F.lit(x) for b, plan in plans.items() for x in (b, value(plan))]), F.col("band"))
    rows = index(docs, bands, plans, n)
    # Copies that were indexed apart count too: a key of copies alone ends with one row.
    held_by = lambda df: df.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(held_by(rows), "key").groupBy("key", "sid").agg(F.max("tag").alias("tag"), F.first("n").alias("n"))
    rows = stored(rows.select("key", "sid", F.floor(F.col("tag") / 4).cast("int").alias("band"), (F.col("tag") % 4).alias("units"), (F.col("n") >= HOT).alias("hot")), "index-rows")
    hot, cold = rows.filter("hot"), rows.filter("NOT hot")
    poor = hot.groupBy("sid", "band").agg(F.sum("units").alias("_lost")).filter(F.col("_lost") > of_band(lambda plan: plan[2] // 2))
    poor = stored(poor.select("sid", "band"), "poor")
    kept = rare_keys(docs, n, num, den).join(poor.select("sid").distinct(), "sid", "left_semi").groupBy("key", "sid").agg(F.min("rank").alias("rank"))
    kept = stored(kept, "rare-rows")
    left = cold.select("key", "band", F.col("sid").alias("a"))
    met = left.join(cold.select("key", F.col("sid").alias("b")), "key").filter("a < b").groupBy("a", "b", "band").agg(F.count("*").alias("_keys"))
    met = stored(met, "met")
    pairs = met.filter(F.col("_keys") >= of_band(least_keys)).select("a", "b")
    return pairs, kept.join(held_by(kept), "key")


def _marked(classes: DataFrame, sid: str, tag: str) -> DataFrame:
    """(sid, size, sketch words) of the classes under names of one side of a pair."""
    words = [F.col("sketch")[k].alias(f"{tag}{k}") for k in range(SKETCH)]
    return classes.select(F.col("sid").alias(sid), F.col("size").alias(f"{tag}_size"), *words)


def _near(left: str, right: str, num: int, den: int) -> Column:
    """Whether sizes and sketches leave a similar pair possible."""
    differ = sum((F.bit_count(F.col(f"{left}{k}").bitwiseXOR(F.col(f"{right}{k}"))) for k in range(SKETCH)), F.lit(0))
    sizes = F.greatest(f"{left}_size", f"{right}_size") * num <= F.least(f"{left}_size", f"{right}_size") * den
    return sizes & (differ * (den + num) <= (F.col(f"{left}_size") + F.col(f"{right}_size")) * (den - num))


def _possible(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The distinct ``pairs`` (a, b) that the sketches allow; pairs of two large sets, few of which
    the small sketch can tell apart, must pass the wide one too."""
    both = pairs.distinct().join(_marked(classes, "a", "x"), "a").join(_marked(classes, "b", "y"), "b")
    large = F.least("x_size", "y_size") > WIDE_FROM
    first = stored(both.filter(_near("x", "y", num, den)).select("a", "b", large.alias("_large")), "near")
    side = lambda sid, tag: classes.filter(F.col("size") > WIDE_FROM).select(F.col("sid").alias(sid), F.col("size").alias(f"{tag}_size"), F.col("wide").alias(tag))
    wide = first.filter("_large").select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b").filter(_near_wide("x", "y", num, den))
    return first.filter("NOT _large").select("a", "b").union(wide.select("a", "b"))


def _near_wide(left: str, right: str, num: int, den: int) -> Column:
    """As ``_near``, of wide sketches: the longer one is halved until both are of one length."""
    half = lambda w: F.zip_with(F.slice(w, F.lit(1), F.floor(F.size(w) / 2).cast("int")), F.slice(w, F.floor(F.size(w) / 2).cast("int") + 1, F.floor(F.size(w) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    turns = lambda w, other: F.array_repeat(F.lit(0), F.round(F.log2(F.size(w) / F.size(other))).cast("int"))
    fit = lambda w, other: F.when(F.size(w) > F.size(other), F.aggregate(turns(w, other), w, lambda acc, _: half(acc))).otherwise(w)
    differ = F.aggregate(F.zip_with(fit(F.col(left), F.col(right)), fit(F.col(right), F.col(left)), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0).cast("long"), lambda t, x: t + x)
    sizes = F.greatest(f"{left}_size", f"{right}_size") * num <= F.least(f"{left}_size", f"{right}_size") * den
    return sizes & (differ * (den + num) <= (F.col(f"{left}_size") + F.col(f"{right}_size")) * (den - num))


def listed(shared: DataFrame) -> DataFrame:
    """(a, b): all pairs of the small buckets."""
    rows = shared.filter(F.col("n") <= SMALL).select("key", "sid")
    left, right = rows.withColumnRenamed("sid", "a"), rows.withColumnRenamed("sid", "b")
    return left.join(right, "key").filter("a < b").select("a", "b")


def led(rows: DataFrame, turn: int) -> DataFrame:
    """(a, b): the sets of every bucket with its leads of this turn, as far as they are in
    different groups. ``rows``: (key, sid, root)."""
    first = [F.min_by(F.struct("sid", "root"), F.xxhash64("sid", F.lit(LEADS * turn + k))) for k in range(LEADS)]
    leads = rows.groupBy("key").agg(F.array_distinct(F.array(*first)).alias("_leads"))
    met = rows.join(leads, "key").select("sid", "root", F.explode("_leads").alias("_lead")).filter("root <> _lead.root")
    return met.select(F.least("sid", "_lead.sid").alias("a"), F.greatest("sid", "_lead.sid").alias("b"))


def divided(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The (key, sid, rank, root) of buckets that hold several groups."""
    placed = rows.select("key", "sid", "rank").join(roots, "sid", "left").select("key", "sid", "rank", F.coalesce("root", "sid").alias("root"))
    split = placed.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo < _hi").select("key")
    return stored(placed.join(split, "key"), "divided")


def crossing(rows: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): all pairs of a bucket in different groups that sketches and ranks allow: at the first
    element that a similar pair shares, enough elements must be left behind it in both sets."""
    left = rows.withColumnRenamed("sid", "a").join(_marked(classes, "a", "x"), "a")
    right = rows.select("key", F.col("sid").alias("b"), F.col("rank").alias("_rank"), F.col("root").alias("_root")).join(_marked(classes, "b", "y"), "b")
    left_over = F.least(F.col("x_size") - F.col("rank"), F.col("y_size") - F.col("_rank"))
    enough = left_over * (num + den) >= (F.col("x_size") + F.col("y_size")) * num
    same = (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (F.col("root") != F.col("_root")) & enough & _near("x", "y", num, den)
    return left.join(right, same).select("a", "b").distinct()


def linked(docs: DataFrame, classes: DataFrame, cold: DataFrame, shared: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(sid, root) of the sets that have links: the smallest set that they reach."""
    large = shared.filter(F.col("n") > SMALL).select("key", "sid", "rank", F.col("sid").alias("root"))
    pairs = stored(_possible(cold.union(listed(shared)).union(led(large, 0)), classes, num, den), "pairs")
    links = stored(verified(pairs, classes, docs, n, num, den), "links")
    roots = components(links)
    for turn in range(1, ROUNDS + 1):
        rest = divided(large, roots)
        if not rest.limit(1).count():
            break
        met = led(rest, turn) if turn < ROUNDS else crossing(rest, classes, num, den)
        more = stored(_possible(met, classes, num, den).join(pairs, ["a", "b"], "left_anti"), "pairs")
        if not more.limit(1).count():
            continue
        found = stored(verified(more, classes, docs, n, num, den), "links")
        pairs = pairs.union(more)
        if found.limit(1).count():
            links = links.union(found)
            roots = components(links)
    return roots


def groups(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, group) of every document; ``group`` tells
    groups apart where doc_ids are repeated."""
    least = -(2**63)
    members = stored(sets(docs, n), "sets")
    classes = members.filter("sid IS NOT NULL").groupBy("digest", "sid").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"))
    classes = stored(classes, "classes")
    shared = buckets(docs, classes, n, num, den)
    named = classes.select("digest", F.coalesce("rep.doc_id", F.lit(least)).alias("_first"), F.col("sid").alias("_root"))
    if shared is not None:
        roots = linked(docs, classes, *shared, n, num, den)
        found = classes.join(roots, "sid").select("digest", "root", F.coalesce("rep.doc_id", F.lit(least)).alias("_first"))
        found = found.join(found.groupBy("root").agg(F.min("_first").alias("_least")), "root").select("digest", "_least", "root")
        named = named.join(found, "digest", "left").select("digest", F.coalesce("_least", "_first").alias("_first"), F.coalesce("root", "_root").alias("_root"))
    out = members.drop("sketch", "wide").join(named, "digest", "left")
    alone = F.coalesce("_first", "doc_id")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(alone != least, alone).alias("component_id"), F.col("_root").alias("group"))


def first_documents(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows of ``docs`` with one document left of each group, the smallest doc_id; documents
    without words stay. Of rows that repeat that doc_id in the group one stays."""
    plan = groups(docs, n, num, den)
    keep = plan.filter("n_shingles > 0").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("_k"))
    keep = keep.select(F.col("_k.doc_id").alias("_id"), F.col("_k.text_hash").alias("_hash"), F.lit(True).alias("_grouped"))
    empty = plan.filter("n_shingles = 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.lit(False).alias("_grouped")).distinct()
    full = packed(docs, "doc_id", F.xxhash64("text").alias("_text_hash"))
    kept = full.join(keep.union(empty), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")))
    once = kept.filter("_grouped").dropDuplicates(["_id", "_text_hash"])
    return once.select("_row.*").union(kept.filter("NOT _grouped").select("_row.*"))
