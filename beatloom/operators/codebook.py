"""Nearest-code assignment, codebook usage, refitting, and reconstruction error.

A codebook of at most BLOCK_VALUES values is sent to the tasks and matched with matrix products per Arrow batch.
A larger one is cut, in the order of norms, into blocks of that size, and vectors meet blocks in one exchange: a vector
goes to the blocks whose norms leave a nearer code possible, and the least (distance, code) of its blocks counts. So the
vectors are read once whatever the codebook, and neither the driver nor a task holds more than a block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatloom.functions.hashing import keyed_md5
from beatloom.operators.ordered import lowest, ranked
from beatloom.session import cut_lineage

BLOCK_VALUES = 8_000_000
FEW_CODES = 1_024  # fetched at once to see how large the codebook is
ROWS_PER_PRODUCT = 8192
PRODUCT_BYTES = 64 << 20
VECTORS_PER_TASK = 250_000  # that one task matches with a block


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row index into ``c`` and squared distance; the lowest index on ties. Codes are taken in
    blocks whose products hold at most PRODUCT_BYTES."""
    step = max(1, PRODUCT_BYTES // (8 * max(1, len(x))))
    best, low = _nearest_in(x, c[:step])
    for first in range(step, len(c), step):
        at, dist = _nearest_in(x, c[first : first + step])
        closer = dist < low
        best, low = np.where(closer, at + first, best), np.where(closer, dist, low)
    return best, low


def _nearest_in(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)[None, :]
    best = d.argmin(1)
    low = d[np.arange(len(x)), best]
    # The product form rounds: decide close calls on the plain differences.
    close = d <= (low + 1e-9 * (1.0 + np.abs(low)))[:, None]
    for i in np.nonzero(close.sum(1) > 1)[0]:
        at = np.nonzero(close[i])[0]
        exact = ((x[i] - c[at]) ** 2).sum(1)
        best[i] = at[exact.argmin()]
    return best, ((x - c[best]) ** 2).sum(1)


def dense(column: pa.Array, *inner: int) -> np.ndarray:
    """List column as a rows x ... array, taken from the Arrow values without going
    through Python objects. ``inner`` gives all but the last nested size."""
    rows = len(column)
    values = column
    while pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        values = values.flatten()
    out = values.to_numpy(zero_copy_only=False).astype(np.float64)
    return out.reshape(rows, *inner, -1)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS_PER_PRODUCT):
            yield batch.slice(i, ROWS_PER_PRODUCT)


def assign(vectors: DataFrame, vec: str, codebook: DataFrame) -> DataFrame:
    """Add ``code`` and ``dist`` (squared distance) of the nearest code; NULL for a NULL vector.
    The lowest code on ties."""
    rows = codebook.select("code", "vec").limit(FEW_CODES + 1).collect()
    if not rows:
        raise ValueError("not a codebook: no codes")
    if len(rows) > FEW_CODES or sum(len(r["vec"]) for r in rows) > BLOCK_VALUES:
        count, values = codebook.agg(F.count("*"), F.sum(F.size("vec"))).first()
        if values > BLOCK_VALUES:
            return _assign_exchanged(vectors, vec, codebook, max(1, BLOCK_VALUES * count // values))
        rows = codebook.select("code", "vec").collect()  # at most BLOCK_VALUES values
    rows = sorted(rows, key=lambda r: r["code"])
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([r["code"] for r in rows], np.int64), np.array([r["vec"] for r in rows], np.float64)))
    schema = T.StructType([*vectors.schema.fields, T.StructField("code", T.IntegerType()), T.StructField("dist", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, c = shared.value
        for part in _batches(batches):
            known = part.column(vec).is_valid().to_numpy(zero_copy_only=False)
            code, dist = np.zeros(len(known), np.int32), np.zeros(len(known))
            if known.any():
                at, dist[known] = _nearest(dense(part.column(vec).drop_null()), c)
                code[known] = codes[at]
            added = [pa.array(code, mask=~known), pa.array(dist, mask=~known)]
            yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, "code", "dist"])

    return vectors.mapInArrow(run, schema)


def _norm(vec: str) -> Column:
    return F.sqrt(F.aggregate(F.transform(vec, lambda x: (x * x).cast("double")), F.lit(0.0), lambda a, x: a + x))


def _assign_exchanged(vectors: DataFrame, vec: str, codebook: DataFrame, per_block: int) -> DataFrame:
    """``assign`` to a codebook of several blocks of ``per_block`` codes.

    The middle code of every block is a pivot; the nearest pivot bounds a vector's distance, and |norm(x) - norm(c)| is
    never above the distance, so only blocks with norms within that bound are asked."""
    placed = ranked(cut_lineage(codebook.select("code", "vec", _norm("vec").alias("_norm"))), [], ["_norm", "code"], "_at")
    codes = cut_lineage(placed.withColumn("block", F.floor(F.col("_at") / per_block)))
    middle = F.abs(F.col("_at") % per_block - per_block // 2)
    blocks = codes.groupBy("block").agg(F.min("_norm").alias("lo"), F.max("_norm").alias("hi"), F.min_by("vec", middle).alias("pivot")).orderBy("block").collect()
    names = np.array([r["block"] for r in blocks])
    shared = vectors.sparkSession.sparkContext.broadcast((names, np.array([[r["lo"], r["hi"]] for r in blocks]), np.array([r["pivot"] for r in blocks], np.float64)))
    rows = cut_lineage(vectors.withColumn("_row", F.monotonically_increasing_id()))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ends, pivots = shared.value
        for part in _batches(batches):
            part = part.filter(part.column("x").is_valid())
            if not part.num_rows:
                continue
            x = dense(part.column("x"))
            _, reach = _nearest(x, pivots)
            norm = np.sqrt((x * x).sum(1))[:, None]
            gap = np.maximum(np.maximum(ends[:, 0] - norm, norm - ends[:, 1]), 0)
            row, block = np.nonzero(gap**2 <= reach[:, None] * (1 + 1e-9) + 1e-9)
            for k in range(0, len(row), ROWS_PER_PRODUCT):
                at = pa.array(row[k : k + ROWS_PER_PRODUCT])
                yield pa.RecordBatch.from_arrays([pa.array(names[block[k : k + ROWS_PER_PRODUCT]]), *part.take(at).columns], ["block", "_row", "x"])

    def match(mine: pa.Table, book: pa.Table) -> pa.Table:
        best = pa.table({"_row": pa.array([], pa.int64()), "code": pa.array([], pa.int32()), "dist": pa.array([], pa.float64())})
        if not mine.num_rows or not book.num_rows:
            return best
        book = book.sort_by("code")
        c, label = dense(book.column("vec").combine_chunks()), book.column("code").to_numpy()
        found = [_nearest(x, c) for x in np.array_split(dense(mine.column("x").combine_chunks()), -(-mine.num_rows // ROWS_PER_PRODUCT))]
        at, dist = (np.concatenate(v) for v in zip(*found))
        return pa.table({"_row": mine.column("_row"), "code": pa.array(label[at], pa.int32()), "dist": pa.array(dist)})

    width = vectors.schema[vec].dataType.simpleString()
    asked = rows.select("_row", F.col(vec).alias("x")).mapInArrow(ask, f"block long, _row long, x {width}")
    buckets = max(1, -(-rows.count() // VECTORS_PER_TASK))
    asked = asked.withColumn("bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    sent = codes.select("block", F.col("code").cast("int").alias("code"), F.col("vec").cast("array<double>").alias("vec"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"))
    near = asked.groupBy("block", "bucket").cogroup(sent.groupBy("block", "bucket")).applyInArrow(match, "_row long, code int, dist double")
    least = near.groupBy("_row").agg(F.min(F.struct("dist", "code")).alias("_least"))
    return rows.join(least, "_row", "left").select(*vectors.columns, F.col("_least.code").alias("code"), F.col("_least.dist").alias("dist"))


def code_sums(vectors: DataFrame, vec: str, codebook: DataFrame) -> DataFrame:
    """(code, dim, n, total) of the vectors nearest to each code: every batch of vectors is
    reduced to one row per code that it holds before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches):
            part = part.filter(part.column("code").is_valid())
            if not part.num_rows:
                continue
            code, x = part.column("code").to_numpy(), dense(part.column(vec))
            order = code.argsort(kind="stable")
            present, first, counts = np.unique(code[order], return_index=True, return_counts=True)
            columns = [pa.array(present), pa.array(counts), pa.array(list(np.add.reduceat(x[order], first)), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["code", "n", "total"])

    partial = assign(vectors.select(vec), vec, codebook).mapInArrow(run, "code int, n bigint, total array<double>")
    cells = partial.select("code", "n", F.posexplode("total").alias("dim", "x"))
    return cells.groupBy("code", "dim").agg(F.sum("n").alias("n"), F.sum("x").alias("total"))


def update(
    state: DataFrame,
    vectors: DataFrame,
    vec: str,
    key: str,
    round_no: int = 1,
    decay: float = 0.99,
    epsilon: float = 1e-6,
    seed: int = 42,
) -> DataFrame:
    """One refitting round over (code, vec, ema_n, ema_w): decayed counts with Laplace
    smoothing, decayed sums, new vectors, and a fresh input for each dead code.

    Everything past ``code_sums`` has one row per code (and dimension)."""
    sums = code_sums(vectors, vec, state)
    size = state.select("code", "ema_n", F.posexplode("ema_w").alias("dim", "w"))
    keep, gain = F.lit(decay), F.lit(1 - decay)
    cells = size.join(sums, ["code", "dim"], "left").select(
        "code",
        "dim",
        F.coalesce(F.col("n"), F.lit(0)).alias("seen"),
        (F.col("ema_n") * keep + gain * F.coalesce(F.col("n"), F.lit(0))).alias("raw_n"),
        (F.col("w") * keep + gain * F.coalesce(F.col("total"), F.lit(0.0))).alias("w"),
    )
    grouped = cells.groupBy("code").agg(
        F.max("seen").alias("seen"),
        F.max("raw_n").alias("raw_n"),
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "w"))), lambda x: x["w"]).alias("w"),
    )
    grouped = cut_lineage(grouped)
    # Every vector is counted at one code, so the counts add up to the batch.
    all_n, k, seen = grouped.agg(F.coalesce(F.sum("raw_n"), F.lit(0.0)), F.count("*"), F.coalesce(F.sum("seen"), F.lit(0))).first()
    smooth = (F.col("raw_n") + epsilon) * F.lit(all_n) / F.lit(all_n + k * epsilon)
    line = 0.5 * seen / max(1, k)
    judged = grouped.select("code", "w", smooth.alias("n")).withColumn("dead", F.col("n") < line)
    fresh = _fresh(judged.filter("dead").select("code"), vectors.select(vec, key), vec, key, f"{seed}|{round_no}")
    return judged.join(fresh, "code", "left").select(
        "code",
        F.coalesce("fresh", F.transform("w", lambda x: x / F.col("n"))).alias("vec"),
        F.when(F.col("dead"), line * 0.5).otherwise(F.col("n")).alias("ema_n"),
        F.coalesce("fresh", "w").alias("ema_w"),
        "dead",
    )


def _fresh(dead: DataFrame, vectors: DataFrame, vec: str, key: str, seed: str) -> DataFrame:
    """(code, fresh): the j-th dead code takes the input with the j-th lowest keyed hash. Both sides are
    numbered in pieces and meet by number; inputs are selected by the digits of their hashes."""
    n = dead.count()
    picks = lowest(vectors, key, seed, n) if n else vectors.limit(0)
    pool = cut_lineage(picks.select(F.col(vec).cast("array<double>").alias("fresh"), keyed_md5(seed, key).alias("_h"), F.col(key).alias("_key")))
    places = ranked(cut_lineage(dead), [], ["code"], "_at") if n else dead.withColumn("_at", F.lit(0).cast("bigint"))
    return places.join(ranked(pool, [], ["_h", "_key"], "_at").select("_at", "fresh"), "_at").select("code", "fresh")


def start_state(codebook: DataFrame) -> DataFrame:
    return codebook.select("code", "vec", F.lit(0.0).alias("ema_n"), F.col("vec").alias("ema_w"))


def fit(codebook: DataFrame, vectors: DataFrame, vec: str, key: str, rounds: int, **options) -> DataFrame:
    """``rounds`` updates. The state between rounds is stored in the shared folder: no lineage
    builds up and nothing has to be kept on an executor or at the driver."""
    state = start_state(codebook)
    for r in range(1, rounds + 1):
        state = cut_lineage(update(state, vectors, vec, key, round_no=r, **options).drop("dead"))
    return state


# ---- usage and loss --------------------------------------------------------


def usage(assigned: DataFrame, codebook: DataFrame) -> DataFrame:
    """Selections of every code, unused ones included."""
    counts = assigned.groupBy("code").agg(F.count("*").alias("n"))
    return codebook.select("code").join(counts, "code", "left").select("code", F.coalesce(F.col("n"), F.lit(0)).alias("n"))


def usage_summary(per_code: DataFrame) -> DataFrame:
    """Used codes, share of the table, effective number of codes, and whether a long
    tail is used (ratio above 1.5)."""
    p = F.col("n") / F.greatest(F.col("all_n"), F.lit(1))
    total = F.broadcast(per_code.agg(F.sum("n").alias("all_n")))  # one row
    out = per_code.crossJoin(total).agg(
        F.count("*").alias("codes"), F.count_if(F.col("n") > 0).alias("used"), F.exp(-F.sum(p * F.ln(p + 1e-10))).alias("perplexity")
    )
    ratio = F.col("used") / F.col("perplexity")
    return out.withColumns({"used_pct": F.col("used") * 100 / F.col("codes"), "ratio": ratio, "skewed": (F.col("used") > 0) & (ratio > 1.5)})


def top_codes(per_code: DataFrame, k: int = 10) -> DataFrame:
    return per_code.orderBy(F.desc("n"), "code").limit(k)


def quantisation_loss(assigned: DataFrame, dim: int, commitment: float = 0.25) -> DataFrame:
    """Mean squared error to the chosen code, the loss with moving averages (commitment
    weight times it), and the one without (the codebook term added)."""
    mse = F.sum("dist") / (F.count("*") * F.lit(dim))
    return assigned.agg(mse.alias("mse"), (mse * commitment).alias("ema_loss"), (mse * (commitment + 1.0)).alias("plain_loss"))


# ---- reconstruction --------------------------------------------------------


def _pairs(x: str, y: str, length: str | None) -> tuple[Column, Column]:
    """Both arrays cut to the valid length."""
    if length is None:
        return F.col(x), F.col(y)
    return F.slice(x, F.lit(1), F.col(length)), F.slice(y, F.lit(1), F.col(length))


def _error_sum(a: Column, b: Column, each) -> Column:
    return F.aggregate(F.zip_with(a, b, each), F.lit(0.0), lambda acc, e: acc + e)


def lead_mse(df: DataFrame, lead: str, x: str, y: str, length: str | None = None) -> DataFrame:
    """Mean squared error per lead, over valid positions when ``length`` is given, and
    over all positions as ``mse_unmasked``, in one pass."""
    square = lambda p, q: (p - q) * (p - q)
    a, b = _pairs(x, y, length)
    sums = df.select(
        lead,
        _error_sum(a, b, square).alias("e"),
        F.size(a).cast("bigint").alias("n"),
        _error_sum(F.col(x), F.col(y), square).alias("e_all"),
        F.size(x).cast("bigint").alias("n_all"),
    )
    total = sums.groupBy(lead).agg(F.sum("e").alias("sq"), F.sum("n").alias("n"), F.sum("e_all").alias("_sq"), F.sum("n_all").alias("_n"))
    mean = lambda s, n: F.col(s) / F.greatest(F.col(n), F.lit(1))
    return total.select(lead, "sq", "n", mean("sq", "n").alias("mse"), mean("_sq", "_n").alias("mse_unmasked"))


def lead_mse_summary(per_lead: DataFrame, lead: str) -> DataFrame:
    """Overall error, best and worst lead, and their ratio."""
    worst, best = F.max("mse"), F.min("mse")
    return per_lead.agg(
        (F.sum("sq") / F.greatest(F.sum("n"), F.lit(1))).alias("overall"),
        F.max_by(lead, F.struct(F.col("mse"), -F.col(lead))).alias("worst_lead"),
        F.min_by(lead, F.struct(F.col("mse"), F.col(lead))).alias("best_lead"),
        (worst / F.greatest(best, F.lit(1e-12))).alias("ratio"),
    )


def huber_loss(df: DataFrame, x: str, y: str, length: str | None = None) -> DataFrame:
    """Smooth L1 (beta 1) averaged over valid positions."""
    a, b = _pairs(x, y, length)
    each = lambda p, q: F.when(F.abs(p - q) < 1, (p - q) * (p - q) * 0.5).otherwise(F.abs(p - q) - 0.5)
    sums = df.select(_error_sum(a, b, each).alias("e"), F.size(a).alias("n"))
    return sums.agg((F.sum("e") / (F.sum("n") + F.lit(1e-8))).alias("loss"))
