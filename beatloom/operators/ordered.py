"""Order-dependent work that still splits when one key holds most of the rows.

A window or a collected list puts a whole key into one task. The helpers here cut
the order of a key into *cells* (a coarse, order-preserving function of the sort
key), work per (key, cell), and carry only a small summary across cells.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from beatloom.functions.arrays import let
from beatloom.functions.hashing import keyed_md5

HOT_ROWS = 1_000_000
CELL = 1024
FANOUT = 1024
EDGE = 100_000
PIECE_ROWS = 65_536
SAMPLED = 64  # rows sampled per border
TASK_ROWS = 250_000  # rows that a task of a dealt frame holds


class Walk(Protocol):
    """State of a walk along the rows of a key."""

    def step(self, *values) -> None: ...

    def end(self) -> tuple: ...


def hot_keys(df: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """Keys with more than ``rows`` rows. At most total/rows of them exist, so the
    result is small whatever the data."""
    return df.groupBy(*keys).count().filter(F.col("count") > (HOT_ROWS if rows is None else rows)).select(*keys)


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str = "pos", pieces: int | None = None) -> DataFrame:
    """Zero-based rank of each row within its key, in ``order`` (ascending, NULL first).

    Borders are sampled from the sorted (key, order) of all rows, so every piece between two borders
    holds about as many rows, whatever the keys. A key without a border is ranked as a whole; a key with
    borders is ranked piece by piece, and moved by the rows of its earlier pieces. There are as many ``pieces`` as shuffle
    partitions, but one per ``PIECE_ROWS`` rows at most. Rows cross the network
    once, dealt by (key, piece); counts are taken for the keys with borders alone, so at most ``pieces``
    offsets exist. NULL keys are keys like any other. Rows that are equal in key and order stay together:
    name columns in ``order`` that tell them apart. Where the borders fall never changes a rank."""
    inside = lambda w: F.row_number().over(w) - 1
    return _moved(df, keys, order, inside, F.count("*"), out, pieces).withColumn(out, F.col(out).cast("bigint"))


def ranked_beside(df: DataFrame, other: DataFrame, keys: list[str], order: list[str], out: str = "pos", cell: int = CELL, pieces: int | None = None) -> tuple[DataFrame, bool]:
    """The rows of ``df`` with their rank as in ``ranked``, joined with those of ``other`` by the ``keys``. One exchange
    of each side serves both, into as many tasks as the rows need, so that what a task holds does not grow with the table.

    Only keys of more than ``cell`` rows are ranked in pieces; ``other`` is copied to each of their pieces. The second result tells
    whether there are none: then all rows of a key lie in one task, and grouping by the keys needs no exchange."""
    total_rows = df.count()
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(min(partitions, -(-total_rows // PIECE_ROWS)), -(-total_rows // TASK_ROWS), 1)
    pieces = pieces or max(1, total_rows // PIECE_ROWS)
    lists = None if pieces == 1 else _borders(df, keys, order, pieces, total_rows, least=2)
    if lists is not None:
        # A key with borders may still be short where equal rows were sampled: at most ``pieces`` keys are counted.
        long = hot_keys(joined(df.select(*keys), F.broadcast(lists.select(*keys)), keys), keys, cell)
        lists = df.sparkSession.createDataFrame(joined(lists, long, keys).collect(), lists.schema)
        lists = None if lists.isEmpty() else lists
    inside = lambda w: F.row_number().over(w) - 1
    if lists is None:
        rows = df.repartition(tasks, *keys).withColumn(out, inside(W.partitionBy(*keys).orderBy(*order)).cast("bigint"))
        return rows.join(other.repartition(tasks, *keys), keys), True
    placed = _among(df, keys, order, lists, pieces)
    rows = _pieced(placed, placed.drop("_borders").repartition(tasks, *keys, "_piece"), keys, order, inside, F.count("*"), out)
    copies = joined(other, F.broadcast(lists), keys, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce(F.size("_borders"), F.lit(0)))))
    both = rows.withColumn(out, F.col(out).cast("bigint")).join(copies.drop("_borders").repartition(tasks, *keys, "_piece"), [*keys, "_piece"])
    return both.drop("_piece"), False


def running(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, pieces: int | None = None) -> DataFrame:
    """Exclusive running sum of ``value`` within each key, in ``order``, split as in ``ranked``."""
    inside = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return _moved(df, keys, order, inside, F.sum(value), out, pieces)


def _moved(df: DataFrame, keys: list[str], order: list[str], inside: Callable[[W], Column], total: Column, out: str, pieces: int | None) -> DataFrame:
    """``inside`` a piece, plus the ``total`` of the key's earlier pieces."""
    if not keys:
        return _moved(df.withColumn("_all", F.lit(0)), ["_all"], order, inside, total, out, pieces).drop("_all")
    slim = df.select(*keys, *[c for c in order if c not in keys])
    total_rows = slim.count()
    pieces = pieces or max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), total_rows // PIECE_ROWS))
    if pieces == 1:  # one piece has no border
        return df.withColumn(out, inside(W.partitionBy(*keys).orderBy(*order)))
    placed = _placed(df, keys, order, pieces, total_rows)
    return _pieced(placed, placed.drop("_borders"), keys, order, inside, total, out).drop("_piece")


def _pieced(placed: DataFrame, rows: DataFrame, keys: list[str], order: list[str], inside: Callable[[W], Column], total: Column, out: str) -> DataFrame:
    """The ``rows`` of ``placed`` with ``inside`` their piece, moved by the ``total`` of earlier pieces."""
    earlier = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    sums = placed.filter(F.col("_borders").isNotNull()).groupBy(*keys, "_piece").agg(total.alias("_sum"))
    before = sums.select(*keys, "_piece", F.sum("_sum").over(earlier).alias("_before")).filter("_before IS NOT NULL")
    rows = rows.withColumn("_in", inside(W.partitionBy(*keys, "_piece").orderBy(*order)))
    rows = joined(rows, F.broadcast(before), [*keys, "_piece"], "left")
    return rows.withColumn(out, F.col("_in") + F.coalesce("_before", F.lit(0))).drop("_in", "_before")


def _placed(df: DataFrame, keys: list[str], order: list[str], pieces: int, rows: int) -> DataFrame:
    """``df`` with ``_piece``, the number of borders of the row's key at or before the row, and the key's
    ``_borders`` (NULL where it has none). At most ``pieces`` borders are broadcast. ``rows``: how many ``df`` has."""
    return _among(df, keys, order, _borders(df, keys, order, pieces, rows), pieces)


def _borders(df: DataFrame, keys: list[str], order: list[str], pieces: int, rows: int, least: int = 1) -> DataFrame | None:
    """Keys with their sorted ``_borders``, of keys with ``least`` of them; None if more than one is asked for and no key has as many."""
    spark = df.sparkSession
    slim = df.select(*keys, *[c for c in order if c not in keys])
    share = min(1.0, pieces * SAMPLED / max(1, rows))
    sample = sorted(slim.sample(share, seed=42).collect(), key=lambda r: [(v is not None, v) for v in r])
    step = max(1, -(-len(sample) // pieces))
    cuts = sample[step::step]
    if least > 1:
        held = Counter(r[: len(keys)] for r in cuts)
        cuts = [r for r in cuts if held[r[: len(keys)]] >= least]
        if not cuts:
            return None
    borders = spark.createDataFrame(cuts, slim.schema)
    value = F.struct(*[F.col(c).alias(f"_{k}") for k, c in enumerate(order)])
    return borders.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_borders"))


def _among(df: DataFrame, keys: list[str], order: list[str], lists: DataFrame, pieces: int) -> DataFrame:
    """``df`` with ``_piece`` and ``_borders``, given the borders of each key."""
    value = F.struct(*[F.col(c).alias(f"_{k}") for k, c in enumerate(order)])
    found = joined(df, F.broadcast(lists), keys, "left")
    at = F.when(F.col("_borders").isNull(), 0).otherwise(let(value, lambda v: bisected(F.col("_borders"), v, pieces)))
    return found.withColumn("_piece", at.cast("int"))


def bisected(borders: Column, value: Column, most: int) -> Column:
    """How many of at most ``most`` sorted ``borders`` are at or below ``value``."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, most.bit_length())))])
    below = lambda at: (at <= F.size(borders)) & (F.get(borders, at - 1) <= value)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(below(at + step), at + step).otherwise(at))


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of both sides in which NULL equals NULL."""
    names = {c: f"_on_{c}" for c in on}
    right = right.withColumnsRenamed(names)
    same = [left[c].eqNullSafe(right[n]) for c, n in names.items()]
    return left.join(right, reduce(lambda a, b: a & b, same), how).drop(*names.values())


def hash_ranked(ids: DataFrame, key: str, seed: int | str, by: list[str] | None = None, out: str = "pos") -> DataFrame:
    """Seeded shuffle of distinct ids as a zero-based rank, with the group size in ``n``.

    The order is (md5(seed|id), id). Its first three hex digits give 4096 even
    cells, so no task sorts more than 1/4096 of a group and the offsets that
    cross cells are 4096 rows per group.
    """
    by = by or []
    hashed = ids.withColumn("_h", keyed_md5(seed, key)).withColumn("_cell", F.substring("_h", 1, 3))
    counts = hashed.groupBy(*by, "_cell").agg(F.count("*").alias("_rows"))
    group = [*by] or [F.lit(0)]
    before = W.partitionBy(*group).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *by,
        "_cell",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(W.partitionBy(*group)).alias("n"),
    )
    inside = W.partitionBy(*by, "_cell").orderBy("_h", key)
    return (
        hashed.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*by, "_cell"])
        .withColumn(out, F.col("_before") + F.col("_rn") - 1)
        .drop("_rn", "_before", "_h", "_cell")
    )


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Few small rows that each stand for much work: give them all tasks. Adaptive
    execution would merge such partitions by size; a stated number is kept."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys)


def with_halo(df: DataFrame, position: str, before: int, after: int, cell: int = CELL) -> DataFrame:
    """Assign rows to cells of ``cell`` positions and copy the rows a neighbouring
    cell needs: ``before`` positions ahead of its start, ``after`` past its end.
    ``_core`` marks the row of its own cell. A window partitioned by (key, _cell)
    then sees the same frame as one over the whole key. Cells are as wide as the reach at least."""
    cell = max(cell, before, after)
    own = F.floor(F.col(position) / cell)
    first = F.floor((F.col(position) - after) / cell)
    last = F.floor((F.col(position) + before) / cell)
    return df.withColumn("_cell", F.explode(F.sequence(first, last))).withColumn("_core", F.col("_cell") == own)


def windowed(
    df: DataFrame,
    keys: list[str],
    position: str,
    before: int,
    after: int,
    exprs: Callable[[Callable[[int, int], W]], dict[str, Column]],
    cell: int = CELL,
) -> DataFrame:
    """Add window columns over the neighbours of each row by position, per key.

    ``exprs`` receives a frame builder (lo, hi) and returns the columns. Frames are
    by position value, so gaps and hot keys are both handled."""
    base = W.partitionBy(*keys, "_cell").orderBy(position)
    frame = lambda lo, hi: base.rangeBetween(lo, hi)
    wide = with_halo(df, position, before, after, cell)
    for name, col in exprs(frame).items():
        wide = wide.withColumn(name, col)
    return wide.filter("_core").drop("_cell", "_core")


def folded(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], walk: Callable[[], Walk], fields: dict[str, tuple[str, pa.DataType]]
) -> DataFrame:
    """One row per key from a walk over its rows in ``order``: the keys and the ``fields`` (name -> type in Spark and in
    Arrow) of the walk's end. For steps that hang on the one before and do not compose.

    One exchange by key; a partition is sorted and streams through, and only the state of the key at hand is kept
    between batches, so a key of any length takes constant memory."""
    slim = df.select(*keys, *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], *[F.col(c).alias(f"_c{k}") for k, c in enumerate(columns)])
    dealt = slim.repartition(*keys).sortWithinPartitions(*keys, *[f"_o{k}" for k in range(len(order))])
    dealt = dealt.select(*keys, *[f"_c{k}" for k in range(len(columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, types = None, None, None

        def ended(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [*types, *[t for _, t in fields.values()]]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [*keys, *fields])

        for batch in batches:
            types, done = [batch.schema.field(k).type for k in keys], []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key = row[: len(keys)]
                if at is None or key != now:
                    if at is not None:
                        done.append((*now, *at.end()))
                    now, at = key, walk()
                at.step(*row[len(keys) :])
            yield ended(done)
        if at is not None:
            yield ended([(*now, *at.end())])

    ends = ", ".join(f"{name} {kind}" for name, (kind, _) in fields.items())
    return dealt.mapInArrow(run, T.StructType([*dealt.select(*keys).schema.fields, *T.StructType.fromDDL(ends).fields]))


def running_total(df: DataFrame, keys: list[str], cell: str, value: str, out: str, fanout: int = FANOUT) -> DataFrame:
    """Exclusive running sum of ``value`` over integer ``cell`` within a key, in two
    levels, plus the key's total in ``<out>_all``. One row per (key, cell)."""
    sup = df.withColumn("_sup", F.floor(F.col(cell) / fanout))
    sums = sup.groupBy(*keys, "_sup").agg(F.sum(value).alias("_sum"))
    over = W.partitionBy(*keys)
    tops = sums.select(
        *keys,
        "_sup",
        F.coalesce(F.sum("_sum").over(over.orderBy("_sup").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_sum").over(over).alias(f"{out}_all"),
    )
    inner = W.partitionBy(*keys, "_sup").orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    return (
        sup.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(tops, [*keys, "_sup"])
        .withColumn(out, F.col(out) + F.col("_base"))
        .drop("_sup", "_base")
    )


def entry_states(cells: DataFrame, keys: list[str], cell: str, step: str, levels: int = 1, fanout: int = FANOUT) -> DataFrame:
    """State in which a left-to-right scan enters each cell of a key.

    ``step`` is an array: leaving state for each entering state 0..S-1 of that cell.
    Such steps compose associatively, so runs of ``fanout`` cells are folded into
    one step, that shorter list is solved first, and its answers are pushed back
    down. The scan starts in state 0. Returns (keys, cell, entry)."""
    follow = lambda state, t: F.element_at(t, state + 1)
    cols = F.struct(F.col(cell).cast("bigint").alias("c"), F.col(step).alias("t"))

    def scan(start: Column) -> Column:
        # All entering states along the run, starting from ``start``.
        init = F.struct(start.cast("int").alias("now"), F.array().cast("array<int>").alias("seen"))
        merge = lambda acc, x: F.struct(
            follow(acc["now"], x["t"]).cast("int").alias("now"), F.concat(acc["seen"], F.array(acc["now"])).alias("seen")
        )
        return F.aggregate(F.col("_run"), init, merge, lambda acc: acc["seen"])

    def unpack(df: DataFrame, start: Column) -> DataFrame:
        both = F.arrays_zip(F.transform("_run", lambda x: x["c"]).alias("c"), scan(start).alias("s"))
        return df.select(*keys, F.explode(both).alias("_x")).select(*keys, F.col("_x.c").alias(cell), F.col("_x.s").alias("entry"))

    if levels == 0:
        runs = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(cols)).alias("_run"))
        return unpack(runs, F.lit(0))
    sup = f"_sup{levels}"
    runs = (
        cells.withColumn(sup, F.floor(F.col(cell) / fanout))
        .groupBy(*keys, sup)
        .agg(F.sort_array(F.collect_list(cols)).alias("_run"))
    )
    states = lambda run: F.sequence(F.lit(0), F.size(F.element_at(run, 1)["t"]) - 1)
    through = lambda run, s: F.aggregate(run, s.cast("int"), lambda acc, x: follow(acc, x["t"]).cast("int"))
    fold = let(F.col("_run"), lambda run: F.transform(states(run), lambda s: through(run, s)))
    tops = entry_states(runs.select(*keys, sup, fold.alias("_step")), keys, sup, "_step", levels - 1, fanout)
    return unpack(runs.join(tops, [*keys, sup]), F.col("entry"))


def lowest(df: DataFrame, key: str, seed: int | str, n: int, digits: int = 3, edge: int = EDGE) -> DataFrame:
    """The ``n`` rows of lowest (md5(seed|key), key), or all of fewer.

    Selection by digits: a step counts the rows by the next hex digits of the hash, at most 16 ** ``digits``
    numbers, and goes into the cell in which the n-th row lies, until that cell is small. Everything below
    it is a filter, and only its own rows are ranked; no task holds n rows."""
    hashed = df.withColumn("_h", keyed_md5(seed, key))
    prefix, taken, held = "", 0, None
    while held is None or (held > edge and len(prefix) < 32):
        width = len(prefix) + digits
        cells = hashed.filter(F.col("_h").startswith(prefix)).groupBy(F.substring("_h", 1, width).alias("c")).count()
        for c, rows in sorted(map(tuple, cells.collect())):
            if taken + rows > n:
                prefix, held = c, rows
                break
            taken += rows
        else:
            return df  # fewer rows than asked for
        if taken == n:
            break
    head = F.substring("_h", 1, len(prefix))
    below = hashed.filter(head < prefix)
    if taken < n:
        ties = [c for c, t in df.dtypes if c != key and not t.startswith(("map", "variant"))]
        rest = ranked(hashed.filter(head == prefix), [], ["_h", key, *ties], "_at").filter(F.col("_at") < n - taken)
        below = below.unionByName(rest.drop("_at"))
    return below.drop("_h")
