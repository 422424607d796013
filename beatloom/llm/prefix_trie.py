"""Prefix trie of conversations: which beginnings they share, and what sharing them saves.

A node is a distinct sequence of first turns (role, text). Texts are hashed once (SHA-256, 128 bits of it) where
they are read and never shuffled; a conversation's path is its turns' hashes, so byte order of paths keeps every
subtree in one stretch.

1. Paths end where they can: a turn deeper than the first power of two at which no other conversation has
   the same beginning belongs to one conversation alone. Its node is stated at once, and a path row is
   at most about twice as long as the longest beginning that two conversations share.
2. Splitters, sampled (path, conversation) rows, deal the rows to shards; a group of equal conversations splits too. The
   trie of the splitter paths, the skeleton, is broadcast: at most ``SHARDS`` paths of ``SKELETON_DEPTH`` turns.
3. Each shard is sorted and scanned once with the open nodes on a stack. A subtree met by two shards holds a splitter, so
   every node outside the skeleton is finished there; skeleton nodes give partial aggregates.
4. Partials are summed per skeleton node; what a node's own skeleton descendants add comes from running sums along
   the sorted splitter paths. The conversations that end at a skeleton node are hashed in order of their ids, as
   a stream.

Defined cases: null role and text are empty; rows with null ids are no conversation's; turns of equal number (null first)
follow the hash of role and text, and repeated rows are turns each; a table without conversations has no nodes; further columns are
ignored."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from beatloom.llm.common import parts, stored
from beatloom.operators.ordered import ranked

WIDTH = 16  # bytes of a turn's hash
SHARD_BYTES = 32 << 20
SHARDS = 16_384
SKELETON_DEPTH = 64  # turns of a splitter's path
SAMPLED = 32  # rows sampled per splitter

NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, hash, bytes): every turn with its place in its conversation, from 0."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    tagged = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    slim = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(F.sha2(tagged, 256), 1, 2 * WIDTH)).alias("hash"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    return ranked(stored(slim, "turns"), ["conv_id"], ["turn", "hash"]).select("conv_id", "pos", "hash", "bytes")


def rebuilt(turns: DataFrame, family: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their family does: (conv_id, depth from 1, hash, bytes) of their
    turns and (conv_id, size) of all, those without turns too. Conversation c takes the first crc32(c) % ``longest``
    turns of c - c % ``family``, then its own from there on."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    heads = turns.filter((F.col("conv_id") % family == 0) & (F.col("pos") < longest - 1))
    heads = heads.groupBy(F.col("conv_id").alias("head")).agg(F.sort_array(F.collect_list(F.struct("pos", "hash", "bytes"))).alias("first"))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest
    convs = own.withColumns({"h": taken, "head": F.col("conv_id") - F.col("conv_id") % family}).join(heads, "head", "left")
    convs = convs.withColumn("first", F.when(F.col("first").isNotNull(), F.slice("first", F.lit(1), F.col("h").cast("int"))))
    convs = convs.withColumn("m", F.coalesce(F.size("first"), F.lit(0)).cast("long")).withColumn("m", F.greatest("m", F.lit(0)))
    convs = stored(convs.select("conv_id", "h", "m", "first", (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")), "conversations")
    given = convs.select("conv_id", F.explode("first").alias("t")).select("conv_id", (F.col("t.pos") + 1).alias("depth"), "t.hash", "t.bytes")
    later = turns.filter(F.col("pos") >= taken).join(convs.select("conv_id", "h", "m"), "conv_id")
    later = later.select("conv_id", (F.col("pos") - F.col("h") + F.col("m") + 1).alias("depth"), "hash", "bytes")
    return given.unionByName(later), convs.select("conv_id", "size")


def cuts(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv_id, size, cut): the first power of two of turns at which the conversation's beginning is no other's,
    or its size. Beginnings are compared by 128 bits, combined from the hashes of (place, turn) in any order."""
    step = F.when(F.col("depth") == 1, 0).otherwise(F.length(F.bin(F.col("depth") - 1)))  # of the doubling that holds it
    half = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "depth", "hash"))
    spans = rows.groupBy("conv_id", step.alias("step")).agg(half(1).alias("a"), half(2).alias("b"))
    upto = W.partitionBy("conv_id").orderBy("step")  # a row per doubling: few
    whole = sizes.join(spans, "conv_id").filter(F.expr("shiftleft(1L, step)") <= F.col("size"))
    marks = whole.select("conv_id", "step", *[F.aggregate(F.collect_list(c).over(upto), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y)).alias(c) for c in ("a", "b")])
    alone = marks.groupBy("step", "a", "b").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).filter("n = 1")
    first = alone.groupBy("conv_id").agg(F.min(F.expr("shiftleft(1L, step)")).alias("cut"))
    return sizes.join(first, "conv_id", "left").select("conv_id", "size", F.coalesce("cut", "size").alias("cut"))


def paths(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """(conv_id, path, lens, more): hashes of the turns down to the cut in one value, their texts' bytes, and
    whether turns follow."""
    kept = rows.join(cut.filter("size > 0"), "conv_id").filter(F.col("depth") <= F.col("cut"))
    turn = F.array_sort(F.collect_list(F.struct("depth", "hash", "bytes")))
    held = kept.groupBy("conv_id").agg(turn.alias("t"))
    held = held.select("conv_id", F.transform("t", lambda x: x["hash"]).alias("h"), F.transform("t", lambda x: x["bytes"]).alias("lens"))
    path = F.unhex(F.array_join(F.transform("h", F.hex), ""))
    return cut.join(held, "conv_id", "left").select(
        "conv_id", F.coalesce(path, F.unhex(F.lit(""))).alias("path"), F.coalesce("lens", F.array().cast("array<long>")).alias("lens"), (F.col("cut") < F.col("size")).alias("more")
    )


def tails(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """The nodes below the cuts: each belongs to one conversation."""
    one = F.lit(1).cast("long")
    last = F.col("depth") == F.col("size")
    below = rows.join(cut.filter(F.col("cut") < F.col("size")), "conv_id").filter(F.col("depth") > F.col("cut"))
    return below.select(
        "conv_id",
        F.col("depth").cast("int").alias("depth"),
        F.col("conv_id").alias("parent_conv_id"),
        one.alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.sha2(F.when(last, F.col("conv_id").cast("string")).otherwise(""), 256).alias("ends_sha256"),
    )


# ---- skeleton ---------------------------------------------------------------------------


class Skeleton:
    """The trie of the sorted splitters (path, conv_id), their paths cut to ``depth`` turns. A node is named by the first
    splitter that runs through it and its depth; the root is (0, 0), without any splitter too."""

    def __init__(self, splitters: list[tuple[bytes, int]], depth: int = SKELETON_DEPTH):
        self.splitters = sorted(splitters)
        self.paths = [p[: depth * WIDTH] for p, _ in self.splitters]
        self.shared = [0] + [common(a, b) for a, b in zip(self.paths, self.paths[1:])]
        self.names: list[list[int]] = []  # by splitter and depth: the first splitter that runs through the node
        for k, p in enumerate(self.paths):
            same = self.shared[k] + 1 if k else 1
            self.names.append((self.names[-1][:same] if k else [0]) + [k] * (len(p) // WIDTH + 1 - same))

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.splitters, (path, conv_id))

    def on(self, shard: int, path: bytes) -> tuple[int, int]:
        """(splitter, depth): the longest beginning of ``path``, a row of ``shard``, that lies on the skeleton. Every
        skeleton node above a shard lies on the path of the splitter before or behind it."""
        best = (0, 0)
        for k in (shard - 1, shard):
            if 0 <= k < len(self.paths) and (d := common(self.paths[k], path)) > best[1]:
                best = (k, d)
        return best

    def name(self, splitter: int, depth: int) -> int:
        return self.names[splitter][depth] if depth else 0


def common(a: bytes, b: bytes) -> int:
    """Turns at the beginning of both paths."""
    n = min(len(a), len(b)) // WIDTH
    if a[: n * WIDTH] == b[: n * WIDTH]:
        return n
    low, high = 0, n  # equal up to low, unlike by high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH] else (low, mid)
    return low


def skeleton(rows: DataFrame, shards: int | None = None, depth: int = SKELETON_DEPTH) -> Skeleton:
    total, held = rows.agg(F.count("*"), F.sum(F.octet_length("path") + 64)).first()
    shards = min(SHARDS, max(parts(held, SHARD_BYTES), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))) if shards is None else shards
    share = min(1.0, shards * SAMPLED / max(1, total))
    # At most about SHARDS * SAMPLED rows of a bounded beginning of the path.
    sample = rows.select(F.substring("path", 1, depth * WIDTH).alias("path"), (F.octet_length("path") <= depth * WIDTH).alias("whole"), "conv_id").sample(share, seed=7)
    # A path that goes on behind its beginning sorts behind that beginning, whatever the id.
    found = sorted((bytes(r["path"]), r["conv_id"] if r["whole"] else (1 << 63) - 1) for r in sample.collect())
    step = max(1, -(-len(found) // shards))
    return Skeleton(sorted(set(found[step::step])), depth)


# ---- one shard --------------------------------------------------------------------------


class Scan:
    """A sorted shard, one row at a time; open nodes stand on a stack from the root down.

    An open node is [smallest id, members, children outside the skeleton, leaves and saved bytes of finished nodes
    below, hash of the ids that end here, bytes of its text, finished children]. A finished node states its parent's
    smallest id: its parent's close tells it, or, on the skeleton, a later join."""

    def __init__(self, trie: Skeleton):
        self.trie = trie
        self.path, self.stack = b"", []
        self.line: tuple[int, int] = (0, 0)
        self.nodes: list[tuple] = []  # finished: NODE, without parents on the skeleton (splitter, depth) instead
        self.partial: list[tuple] = []
        self.ends: list[tuple[int, int, int]] = []

    def _open(self, n_bytes: int) -> None:
        self.stack.append([None, 0, 0, 0, 0, None, n_bytes, []])

    def row(self, shard: int, conv_id: int, path: bytes, lens: list[int], more: bool) -> None:
        same = common(self.path, path) if self.stack else 0
        self.close(same + 1)
        if not self.stack:
            self._open(0)
        for d in range(same, len(lens)):
            self._open(lens[d])
        self.path, self.line = path, self.trie.on(shard, path)
        last = self.stack[-1]
        last[0] = conv_id if last[0] is None else min(last[0], conv_id)
        last[1] += 1
        if more:  # one conversation goes on alone: one child, one leaf
            last[2] += 1
            last[3] += 1
        elif len(lens) <= self.line[1]:
            self.ends.append((self.trie.name(self.line[0], len(lens)), len(lens), conv_id))
        else:
            if last[5] is None:
                last[5] = hashlib.sha256()
                last[5].update(str(conv_id).encode())
            else:
                last[5].update(b",%d" % conv_id)

    def close(self, keep: int) -> None:
        """Closes all nodes but the first ``keep`` of the stack."""
        while len(self.stack) > keep:
            least, members, children, leaves, saved, digest, n_bytes, waiting = self.stack.pop()
            depth = len(self.stack)
            above = self.stack[-1] if self.stack else None
            if depth <= self.line[1]:
                self.partial.append((self.trie.name(self.line[0], depth), depth, least, members, children, leaves, saved, n_bytes))
            else:
                leaves += not children
                saved += (members - 1) * n_bytes
                self.nodes += [(n[0], n[1], least, *n[3:], None, None) for n in waiting]
                own = (least, depth, None, members, children, leaves, saved, (digest or hashlib.sha256()).hexdigest())
                if depth - 1 <= self.line[1]:
                    self.nodes.append((*own, self.trie.name(self.line[0], depth - 1), depth - 1))
                else:
                    above[7].append(own)
                above[2] += 1
            if above:
                above[0] = least if above[0] is None else min(above[0], least)
                above[1] += members
                above[3] += leaves
                above[4] += saved


def _streamed(shared) -> Callable:
    """Rows of a sorted partition through one scan per shard; out come finished nodes, partials and ends."""
    names = [x.split()[0] for x in NODE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, now = None, None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("shard", "conv_id", "path", "lens", "more")]
            for shard, conv_id, path, lens, more in zip(*cols):
                if shard != now:
                    if scan:
                        scan.close(0)
                        yield from out(scan)
                    scan, now = Scan(shared.value), shard
                scan.row(shard, conv_id, path, lens, more)
                if len(scan.nodes) + len(scan.ends) > 20_000:
                    yield from out(scan)
        if scan:
            scan.close(0)
            yield from out(scan)

    def out(scan: Scan) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string()]
        whole = {n: pa.array([r[k] for r in scan.nodes], t) for k, (n, t) in enumerate(zip(names, types))}
        yield _batch("node", len(scan.nodes), whole | {"name": pa.array([r[8] for r in scan.nodes], pa.int32()), "at": pa.array([r[9] for r in scan.nodes], pa.int32())})
        p = scan.partial
        of = lambda k, t=pa.int64(): pa.array([r[k] for r in p], t)
        yield _batch("part", len(p), {"name": of(0, pa.int32()), "depth": of(1, pa.int32()), "conv_id": of(2), "n_convs": of(3), "n_children": of(4), "n_leaves": of(5), "saved_tokens": of(6), "bytes": of(7)})
        e = scan.ends
        yield _batch("end", len(e), {"name": pa.array([r[0] for r in e], pa.int32()), "depth": pa.array([r[1] for r in e], pa.int32()), "conv_id": pa.array([r[2] for r in e], pa.int64())})
        scan.nodes, scan.partial, scan.ends = [], [], []

    return run


SCANNED = "kind string, " + NODE + ", name int, at int, bytes long"
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def _batch(kind: str, n: int, given: dict[str, pa.Array]) -> pa.RecordBatch:
    cols = dict(x.split() for x in SCANNED.split(", "))
    made = {c: given.get(c, pa.nulls(n, _ARROW[t])) for c, t in cols.items()} | {"kind": pa.array([kind] * n, pa.string())}
    return pa.RecordBatch.from_pydict(made)


def _ends(rows: DataFrame) -> DataFrame:
    """(name, depth, ends_sha256) from (name, depth, conv_id): ids in order, hashed as a stream, so a node at
    which very many conversations end holds one hash state."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, "name", "depth").sortWithinPartitions("name", "depth", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for name, depth, conv_id in zip(*(batch.column(c).to_pylist() for c in ("name", "depth", "conv_id"))):
                if (name, depth) != now:
                    if now:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (name, depth), hashlib.sha256(str(conv_id).encode())
                else:
                    digest.update(b",%d" % conv_id)
            yield made(done)
        if now:
            yield made([(*now, digest.hexdigest())])

    def made(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))], ["name", "depth", "ends_sha256"])

    return dealt.select("name", "depth", "conv_id").mapInArrow(run, "name int, depth int, ends_sha256 string")


def _reduced(parts: DataFrame, trie: Skeleton) -> DataFrame:
    """The skeleton's nodes, whole, from the shards' partials: at most SHARDS * SKELETON_DEPTH rows, so what
    follows the first sum is small.

    Nodes named by splitter j lie on its path below its stretch shared with the one before. The subtree of a node of
    depth d named j holds the nodes named j from depth d down, and all nodes of the splitters behind j as far as
    they share d turns with it."""
    spark = parts.sparkSession
    sums = parts.groupBy("name", "depth").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("bytes").alias("bytes"))
    places = []  # every place (splitter, depth) of the trie with its name, its parent's and the splitter that ends its subtree
    n = max(1, len(trie.paths))
    until = [n - 1] * (max([len(p) // WIDTH for p in trie.paths], default=0) + 1)
    for j in reversed(range(n)):
        size = len(trie.paths[j]) // WIDTH if trie.paths else 0
        own = trie.shared[j] if j else -1
        for d in range(own + 1, size + 1):
            places.append((j, d, trie.name(j, d - 1) if d else None, until[d]))
        # A splitter before j shares at most shared[j] turns with j: deeper subtrees end before j.
        for d in range(own + 1, len(until)):
            until[d] = j - 1
    known = spark.createDataFrame(places, "name int, depth int, up int, until int")
    nodes = sums.join(F.broadcast(known), ["name", "depth"])
    held = nodes.groupBy(F.col("up").alias("name"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("more"))
    nodes = nodes.join(held, ["name", "depth"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    nodes = nodes.withColumns({"own_leaf": (F.col("n_children") == 0).cast("long"), "own_saved": (F.col("n_convs") - 1) * F.col("bytes")})
    down = W.partitionBy("name").orderBy(F.desc("depth"))
    nodes = nodes.withColumns({f"{c}_down": F.sum(f"own_{c}").over(down) for c in ("leaf", "saved")})
    lines = nodes.groupBy("name").agg(F.sum("own_leaf").alias("leaf"), F.sum("own_saved").alias("saved"))
    running = W.orderBy("name")  # one row per splitter
    lines = lines.select("name", *[F.sum(c).over(running).alias(c) for c in ("leaf", "saved")])
    # Every splitter up to ``until`` has a line: a splitter is a conversation's path, and its last node is named by
    # it or by one before it with the same path; the latest line at or before a splitter is looked up.
    every = spark.range(n).select(F.col("id").cast("int").alias("name")).join(lines, "name", "left")
    latest = [F.last(c, ignorenulls=True).over(running).alias(c) for c in ("leaf", "saved")]
    every = every.select("name", *latest)
    at_end = every.select(F.col("name").alias("until"), F.col("leaf").alias("leaf_end"), F.col("saved").alias("saved_end"))
    at_own = every.select("name", F.col("leaf").alias("leaf_own"), F.col("saved").alias("saved_own"))
    nodes = nodes.join(F.broadcast(at_end), "until").join(F.broadcast(at_own), "name")
    leaves = F.col("n_leaves") + F.col("leaf_down") + F.col("leaf_end") - F.col("leaf_own")
    saved = F.col("saved_tokens") + F.col("saved_down") + F.col("saved_end") - F.col("saved_own")
    return nodes.select("name", "depth", "up", "conv_id", "n_convs", "n_children", leaves.alias("n_leaves"), saved.alias("saved_tokens"))


def trie_nodes(rows: DataFrame, trie: Skeleton) -> DataFrame:
    """All nodes above the cuts, from ``paths``."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(trie)

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = [shared.value.shard(p, c) for p, c in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where, pa.int32())], [*batch.schema.names, "shard"])

    cols = "conv_id long, path binary, lens array<long>, more boolean"
    dealt = rows.select("conv_id", "path", "lens", "more").mapInArrow(tagged, f"{cols}, shard int")
    # One shard per task.
    dealt = dealt.repartitionById(len(trie.paths) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    found = stored(dealt.mapInArrow(_streamed(shared), SCANNED), "trie")
    names = [x.split()[0] for x in NODE.split(", ")]
    core = stored(_reduced(found.filter("kind = 'part'").select("name", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "bytes"), trie), "skeleton")
    ends = _ends(found.filter("kind = 'end'"))
    above = F.broadcast(core.select(F.col("name").alias("up"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id")))
    none = hashlib.sha256().hexdigest()
    whole = core.join(above, ["up", "depth"], "left").join(ends, ["name", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
    under = F.broadcast(core.select("name", F.col("depth").alias("at"), F.col("conv_id").alias("_parent")))
    local = found.filter("kind = 'node'").join(under, ["name", "at"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent"))
    return local.select(names).unionByName(whole.select(names))


def nodes(conversations: DataFrame, family: int = 5, longest: int = 9, shards: int | None = None, depth: int = SKELETON_DEPTH) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations (``NODE``)."""
    rows, sizes = rebuilt(stored(turns(conversations), "placed-turns"), family, longest)
    rows = stored(rows, "rebuilt-turns")
    cut = stored(cuts(rows, sizes), "cuts")
    held = stored(paths(rows, cut), "paths")
    return trie_nodes(held, skeleton(held, shards, depth)).unionByName(tails(rows, cut))
