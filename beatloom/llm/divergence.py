"""Source divergence audit: how far the words of one source stray from those of another.

1. Exact frequency filtering: documents per (lang, term), summed before and after one exchange;
   a language keeps the terms of ``min_docs`` documents or more.
2. The kept terms are dealt by hash to shards of about ``SHARD_KEYS``; a task builds the minimal perfect
   hash of a shard: small buckets of keys, one displacement each, found largest bucket first; a bucket of one
   key states its slot. A shard stores its keys in slot order. Slots of all shards are numbered in turn.
3. Recount: shards are broadcast, ``BLOCK_BYTES`` at a time, with one pass over the documents per block. A
   task looks up the distinct terms of a piece of text, compares each with the key stored in its slot, and
   increments dense slots, group by group, for every ``WORDS`` words it has gathered.
4. Shares of a group and of its language are p = 1 + floor(scale * (count + 1) / (N + V)), exact.

The divergence of a pair of sources sums f = floor((p-q)^2 / q) over all kept terms, absent ones too, without
spelling the absent ones out: with p0 and q0 the shares of a count of 0, terms of the first source give f(p, q0), those of the
second f(p0, q), all others f(p0, q0), and terms of both a correction, taken per range of slots from the dense counts.

Defined cases: null text, lang and source are empty strings; a document without terms still makes its group occur; repeated rows count
each; a language without kept terms has pairs of value 0 and no term rows; an empty table gives no rows; further
columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from beatloom.llm.common import row_chunks, stored, utf8_buffers

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
SHARD_KEYS = 16_384
BLOCK_BYTES = 64 << 20  # of stored keys in one broadcast
PAGE = 1_024  # slots whose terms are compared at once
PIECE_BYTES = 1 << 20  # of texts taken apart at once
WORDS = 4_000_000  # gathered in a task before they are counted
BUCKET_KEYS = 2  # keys per displacement, on average
GAP = "\x1f"  # between lang and term in a key; terms hold letters only

_LETTER = np.ones(256, bool)
_LETTER[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---- terms of texts ---------------------------------------------------------------------


def terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(row, term) of every term of the rows, in order; A-Z count as a-z."""
    letter = _LETTER[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[False], letter[:-1]]) if len(raw) else letter
    start = np.flatnonzero(letter & (~before | cut[:-1]))
    # The letters without what stands between them: a term ends where the next one starts.
    place = np.cumsum(letter, dtype=np.int32) - 1 if len(raw) < 1 << 31 else np.cumsum(letter) - 1
    off = np.append(place[start], int(letter.sum())).astype(np.int64)
    data = pa.py_buffer(_LOWER[raw[letter]].tobytes())
    found = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(off.tobytes()), data])
    return np.searchsorted(offsets, start, side="right") - 1, found


def _coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    d = values.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def _counted_sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sorted, and how often each occurs)."""
    keys = np.sort(keys)
    edges = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[edges], np.diff(edges, append=len(keys))


def _distinct(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sorted, and the place of every key among them) of keys below ``size``."""
    if size > 16 * len(keys):
        return np.unique(keys, return_inverse=True)
    seen = np.zeros(size, bool)
    seen[keys] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[keys]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array]]:
    """Batches in pieces of bounded bytes: (piece, row of every term, its code, distinct terms)."""
    for batch in batches:
        raw, offsets = utf8_buffers(batch.column("text"))
        for a, b in row_chunks(offsets, PIECE_BYTES):
            row, found = terms(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield batch.slice(a, b - a), row, *_coded(found)


def document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, docs) in parts, one row per language, term and piece of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, row, code, names in _pieces(batches):
            lang, langs = _coded(piece.column("lang"))
            width = max(1, len(names))
            seen, _ = _counted_sorted(row * width + code)  # once per document
            key, n = _counted_sorted(lang[seen // width] * width + seen % width)
            at = [langs.take(pa.array(key // width)), names.take(pa.array(key % width)).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*at, pa.array(n.astype(np.int64))], ["lang", "term", "docs"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, term string, docs long")


# ---- minimal perfect hashes -------------------------------------------------------------


def hashed(keys: pa.Array) -> np.ndarray:
    """128 bits of every key, as two columns."""
    digests = b"".join(map(xxhash.xxh3_128_digest, keys.cast(pa.large_binary()).to_pylist()))
    return np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)


def shard_of(h: np.ndarray, count: int) -> np.ndarray:
    return (h[:, 0] % np.uint64(count)).astype(np.int64)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h[:, 1] >> np.uint64(17)) % np.uint64(buckets)).astype(np.int64)


def _slot(h: np.ndarray, move: np.ndarray | int, n: int) -> np.ndarray:
    mix = ((h[:, 0] >> np.uint64(9)) + np.asarray(move).astype(np.uint64) * (h[:, 1] | np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mix >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def perfect(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacement of every bucket, slot of every key) of distinct hashes; n keys fill slots 0..n-1.

    Buckets of many keys come first. In a round all open buckets of a size try the same move; a bucket is
    placed where its keys fall on free slots that no bucket before it claims. Buckets of one key get
    what is left over, as -1 - slot."""
    n = len(h)
    buckets = max(1, -(-n // BUCKET_KEYS))
    bucket = _bucket(h, buckets)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    move = np.zeros(buckets, np.int32)
    slot = np.zeros(n, np.int64)
    taken = np.zeros(n, bool)
    for size in range(int(sizes.max(initial=0)), 1, -1):
        open_ = np.flatnonzero(sizes == size)
        keys = order[first[open_][:, None] + np.arange(size)]
        tried = 0
        while len(open_):
            at = _slot(h[keys.ravel()], tried, n)
            claim = np.zeros(len(at), bool)
            claim[np.unique(at, return_index=True)[1]] = True
            good = (claim & ~taken[at]).reshape(-1, size).all(1)
            at = at.reshape(-1, size)
            move[open_[good]] = tried
            slot[keys[good]] = at[good]
            taken[at[good]] = True
            open_, keys, tried = open_[~good], keys[~good], tried + 1
    single = np.flatnonzero(sizes == 1)
    free = np.flatnonzero(~taken)
    move[single] = -1 - free
    slot[order[first[single]]] = free
    return move, slot


def found(h: np.ndarray, move: np.ndarray, n: int) -> np.ndarray:
    """The slot of every hash; that of a key not stored is any slot."""
    d = move[_bucket(h, len(move))]
    return np.where(d < 0, -1 - d, _slot(h, np.maximum(d, 0), n))


def shards(kept: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(shard, move, keys, base) of distinct ``kept`` (lang, term): displacements, keys in slot order and the
    number of slots before the shard."""
    n = max(1, -(-kept.count() // shard_keys))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key")
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(hashed(keys), n), pa.int32()), keys], ["shard", "key"])

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        keys = rows.column("key").combine_chunks()
        h = hashed(keys)
        if len(np.unique(h, axis=0)) < len(h):
            raise ValueError("two terms share all 128 bits of their hash")
        move, slot = perfect(h)
        inside = np.empty(len(slot), np.int64)
        inside[slot] = np.arange(len(slot))
        return pa.table({"shard": [key[0].as_py()], "move": [move], "keys": [keys.take(pa.array(inside))]}, schema=pa.schema([("shard", pa.int32()), ("move", pa.list_(pa.int32())), ("keys", pa.list_(pa.string()))]))

    dealt = kept.select(F.concat_ws(GAP, "lang", "term").alias("key")).mapInArrow(deal, "shard int, key string")
    built = stored(dealt.groupBy("shard").applyInArrow(build, "shard int, move array<int>, keys array<string>"), "hashes")
    # One row per SHARD_KEYS terms.
    bases = built.select("shard", F.size("keys").cast("long").alias("_n")).withColumn("_run", F.floor(F.col("shard") / 1024))
    inner = F.sum("_n").over(W.partitionBy("_run").orderBy("shard")) - F.col("_n")
    runs = bases.groupBy("_run").agg(F.sum("_n").alias("_all"))
    outer = runs.select("_run", (F.sum("_all").over(W.orderBy("_run")) - F.col("_all")).alias("_before"))
    bases = bases.select("shard", "_run", inner.alias("_inner")).join(outer, "_run").select("shard", (F.col("_inner") + F.col("_before")).alias("base"))
    return stored(built.join(bases, "shard"), "sharded-hashes")


class Recount:
    """Broadcast shards as a task uses them, and the dense slots of one group at a time: the words of
    ``WORDS`` are gathered, dealt by group, and each group's slots are incremented, read and cleared."""

    def __init__(self, block: list[tuple[int, int, bytes, pa.Array]], count: int):
        self.block = {s: (base, np.frombuffer(move, np.int32), keys) for s, base, move, keys in block}
        self.count = count
        self.base = min((base for _, base, _, _ in block), default=0)
        size = max((base + len(keys) for _, base, _, keys in block), default=0) - self.base
        self.dense, self.mark = np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.words: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def slots(self, keys: pa.Array) -> np.ndarray:
        """Slot of every key, -1 where no shard of the block stores it."""
        h = hashed(keys)
        out = np.full(len(h), -1, np.int64)
        shard = shard_of(h, self.count)
        order = np.argsort(shard, kind="stable")
        edges = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for mine in np.split(order, edges[1:]) if len(order) else []:
            if (held := self.block.get(int(shard[mine[0]]))) is None:
                continue
            base, move, stored_keys = held
            at = found(h[mine], move, len(stored_keys))
            same = pc.equal(stored_keys.take(pa.array(at)), keys.take(pa.array(mine))).to_numpy(zero_copy_only=False)
            out[mine[same]] = base + at[same]
        return out

    def add(self, group: np.ndarray, slot: np.ndarray) -> None:
        self.words.append((group.astype(np.int32), (slot - self.base).astype(np.int32)))
        self.held += len(slot)

    def flush(self, langs: list[str], sources: list[str]) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        group, slot = (np.concatenate(x) for x in zip(*self.words))
        self.words, self.held = [], 0
        order = np.argsort(group, kind="stable")
        group, slot = group[order], slot[order]
        edges = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], len(group))):
            mine, place = slot[a:b], np.arange(b - a, dtype=np.int32)
            np.add.at(self.dense, mine, np.int32(1))
            self.mark[mine] = place
            used = mine[self.mark[mine] == place]  # every slot once
            n = self.dense[used].astype(np.int64)
            self.dense[used] = 0
            lang, source = langs[group[a]], sources[group[a]]
            for k in range(0, len(used), 65_536):
                part = used[k : k + 65_536].astype(np.int64) + self.base
                same = [pa.repeat(pa.scalar(x, pa.string()), len(part)) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(part), pa.array(n[k : k + 65_536])], ["lang", "source", "slot", "n"])


def recount(docs: DataFrame, hashes: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, source, slot, n): occurrences of the stored terms, summed. ``docs`` is read once per block."""
    spark = docs.sparkSession
    count, size = hashes.agg(F.count("*"), F.sum(F.expr("aggregate(keys, 0L, (a, x) -> a + octet_length(x) + 8L)"))).first()
    blocks = max(1, -(-int(size or 0) // block_bytes))
    per = max(1, -(-count // blocks))
    out = None
    for k in range(0, max(1, count), per):
        mine = hashes.filter((F.col("shard") >= k) & (F.col("shard") < k + per)).toArrow()
        block = [(s.as_py(), base.as_py(), np.asarray(move.values, np.int32).tobytes(), keys.values) for s, base, move, keys in zip(*(mine.column(c) for c in ("shard", "base", "move", "keys")))]
        # Copies, so that a shard's arrays do not drag the whole block along.
        shared = spark.sparkContext.broadcast([(s, base, move, pa.concat_arrays([keys])) for s, base, move, keys in block])
        part = stored(_counted(docs, shared, max(1, count)).groupBy("lang", "source", "slot").agg(F.sum("n").alias("n")), "recount")
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _counted(docs: DataFrame, shared, count: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Recount(shared.value, count)
        langs, sources, ids = [], [], {}
        for piece, row, code, names in _pieces(batches):
            pair = list(zip(piece.column("lang").to_pylist(), piece.column("source").to_pylist()))
            for p in pair:
                if p not in ids:
                    ids[p] = len(ids)
                    langs.append(p[0])
                    sources.append(p[1])
            group = np.array([ids[p] for p in pair], np.int64)
            lang, distinct = _coded(piece.column("lang"))
            # Distinct (lang, term) of the piece are looked up once each.
            width = max(1, len(names))
            key, back = _distinct(lang[row] * width + code, len(distinct) * width)
            tags = [distinct.take(pa.array(key // width)), names.take(pa.array(key % width)).cast(pa.string())]
            whole = pc.binary_join_element_wise(*tags, GAP)
            slot = state.slots(whole)[back]
            good = slot >= 0
            state.add(group[row[good]], slot[good])
            if state.held > WORDS:
                yield from state.flush(langs, sources)
                langs, sources, ids = [], [], {}
        yield from state.flush(langs, sources)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, slot long, n long")


# ---- divergence -------------------------------------------------------------------------


def share(count: Column, total: Column, terms: Column, scale: int = SCALE) -> Column:
    """1 + floor(scale * (count + 1) / (total + terms)), in exact decimals."""
    top = (count.cast("decimal(20,0)") + 1).cast("decimal(20,0)") * F.lit(scale).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, total.cast("decimal(20,0)") + terms.cast("decimal(19,0)"))


def stray(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so squares fit in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _corrections(counts: DataFrame) -> DataFrame:
    """(lang, source, item, v): per ordered pair of sources, over the terms that both hold, f(p, q) - f(p, q0) -
    f(p0, q) + f(p0, q0), and their number. ``counts``: lang, source, slot, p, p0. The pairs are met per
    (lang, page of slots), where each source is a dense vector."""
    rows = counts.select("lang", F.floor(F.col("slot") / PAGE).alias("page"), "source", (F.col("slot") % PAGE).cast("int").alias("at"), "p", "p0")
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "lang", "page").sortWithinPartitions("lang", "page", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, str], list[int]] = {}
        for lang, sources, at, p, p0 in _grouped(batches):
            held = np.zeros((len(sources), PAGE), np.int64)
            for k, (a, v) in enumerate(zip(at, p)):
                held[k, a] = v
            for k, s in enumerate(sources):
                cols = np.flatnonzero(held[k])
                q = held[:, cols]
                mine, own0, q0 = held[k, cols][None, :], p0[k], p0[:, None]
                both = q > 0
                safe = np.where(both, q, 1)
                v = (mine - safe) ** 2 // safe - (mine - q0) ** 2 // q0 - (own0 - safe) ** 2 // safe + (own0 - q0) ** 2 // q0
                v, n = np.where(both, v, 0).sum(1), both.sum(1)
                for j, t in enumerate(sources):
                    if j != k and n[j]:
                        cell = sums.setdefault((lang, s, t), [0])
                        cell[0] += int(v[j])
            if len(sums) > 200_000:
                yield _summed(sums)
                sums = {}
        yield _summed(sums)

    return rows.mapInArrow(run, "lang string, source string, item string, v decimal(38,0)").groupBy("lang", "source", "item").agg(F.sum("v").alias("v"))


def _summed(sums: dict) -> pa.RecordBatch:
    from decimal import Decimal

    keys = list(sums)
    cols = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
    return pa.RecordBatch.from_arrays([*cols, pa.array([Decimal(sums[k][0]) for k in keys], pa.decimal128(38, 0))], ["lang", "source", "item", "v"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(lang, sources, places, shares, share of 0) of every (lang, page), whole, from sorted batches."""
    held: list[pa.RecordBatch] = []
    now = None

    def whole() -> tuple:
        t = pa.Table.from_batches(held)
        code, names = _coded(t.column("source").combine_chunks())
        edges = np.flatnonzero(np.diff(code, prepend=-1))
        at, p, p0 = (t.column(c).to_numpy() for c in ("at", "p", "p0"))
        return now[0], names.take(pa.array(code[edges])).to_pylist(), np.split(at, edges[1:]), np.split(p, edges[1:]), p0[edges]

    for batch in batches:
        if not batch.num_rows:
            continue
        lang, names = _coded(batch.column("lang"))
        page = batch.column("page").to_numpy()
        edges = np.flatnonzero((np.diff(lang, prepend=-1) != 0) | (np.diff(page, prepend=-1) != 0))
        for a, b in zip(edges, np.append(edges[1:], batch.num_rows)):
            key = (names[int(lang[a])].as_py(), int(page[a]))
            if key != now and held:
                yield whole()
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield whole()


def audited(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, shard_keys: int = SHARD_KEYS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: every other source of the language, by how far the
    group's shares stray from its; part ``term``: the ``top`` terms whose share most exceeds the language's."""
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = document_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    kept = stored(kept.select("lang", "term"), "kept-terms")
    hashes = shards(kept, shard_keys)
    counts = recount(docs, hashes, block_bytes)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms_kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "held", "terms_kept"])
    zero = F.when(F.col("terms_kept") > 0, share(F.lit(0), F.col("total"), F.col("terms_kept")))
    groups = stored(groups.withColumn("p0", zero), "divergence-groups")

    by_group = counts.join(groups.select("lang", "source", "total", "terms_kept", "p0"), ["lang", "source"])
    by_group = stored(by_group.select("lang", "source", "slot", "n", share(F.col("n"), F.col("total"), F.col("terms_kept")).alias("p"), "p0", "terms_kept"), "shares")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = _pairs(by_group, groups).withColumn("rank", rank)
    words = _words(by_group, groups, hashes).withColumn("rank", rank).filter(F.col("rank") <= top)
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(cols).unionByName(words.withColumn("part", F.lit("term")).select(cols))


def _pairs(by_group: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a language's sources."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("held").alias("other_held"))
    base = groups.join(other, "lang").filter(F.col("source") != F.col("item"))
    # Few distinct shares per group: one row each, however many terms have it.
    shares = by_group.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms"))
    crossed = shares.join(other.select("lang", "item", "q0"), "lang").filter(F.col("source") != F.col("item"))
    wide = lambda c: c.cast("decimal(19,0)") * F.col("terms").cast("decimal(19,0)")
    sides = crossed.groupBy("lang", "source", "item").agg(F.sum(wide(stray(F.col("p"), F.col("q0")))).alias("mine"), F.sum(wide(stray(F.col("q0"), F.col("p")))).alias("theirs"))
    own = sides.select("lang", "source", "item", F.col("mine").alias("v"))
    theirs = sides.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("theirs").alias("v"))
    rest = (F.col("terms_kept") - F.col("held") - F.col("other_held")).cast("decimal(19,0)") * F.coalesce(stray(F.col("p0"), F.col("q0")), F.lit(0)).cast("decimal(19,0)")
    absent = base.select("lang", "source", "item", rest.alias("v"))
    every = [x.select("lang", "source", "item", F.col("v").cast("decimal(38,0)").alias("v")) for x in (absent, own, theirs, _corrections(by_group))]
    out = every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])
    return out.groupBy("lang", "source", "item").agg(F.sum("v").cast("long").alias("value"))


def _words(by_group: DataFrame, groups: DataFrame, hashes: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms with a larger share in the group than in its language."""
    langs = groups.groupBy("lang").agg(F.sum("total").alias("all"))
    q = share(F.sum("n").over(W.partitionBy("slot")), F.col("all"), F.col("terms_kept"))
    rows = by_group.join(langs, "lang").withColumn("q", q).filter(F.col("p") > F.col("q"))
    names = hashes.select("base", F.posexplode("keys").alias("at", "key")).select((F.col("base") + F.col("at")).alias("slot"), F.substring_index("key", GAP, -1).alias("item"))
    return rows.select("lang", "source", "slot", stray(F.col("p"), F.col("q")).alias("value")).join(names, "slot").drop("slot")
