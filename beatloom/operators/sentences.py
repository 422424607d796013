"""Beats to token sentences: join the tokens of a beat, cut ordered beats into
sentences of random length, encode them at fixed width, and mask them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from beatloom import constants as C
from beatloom.functions.arrays import let
from beatloom.functions.hashing import DRAW_RANGE, draw, keyed_md5, md5_ends, md5_words
from beatloom.operators.ordered import CELL, entry_states, running_total, spread, with_halo
from beatloom.session import cut_lineage, shared_dir


# ---- vocabulary ------------------------------------------------------------


def vocabulary(codebooks: DataFrame) -> DataFrame:
    """Token offset per segment and total vocabulary size from (rank, segment,
    codebook_size). One row per segment type, a handful in all."""
    before = W.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    return codebooks.select(
        "segment",
        (F.lit(C.FIRST_TOKEN) + F.coalesce(F.sum("codebook_size").over(before), F.lit(0))).cast("bigint").alias("offset"),
        (F.lit(C.FIRST_TOKEN) + F.sum("codebook_size").over(everything)).cast("bigint").alias("vocab_size"),
    )


def offsets(segments: list[str], size: int = C.CODEBOOK_SIZE) -> dict[str, int]:
    """The same offsets for equal codebooks, as plan constants."""
    return {s: C.FIRST_TOKEN + i * size for i, s in enumerate(segments)}


# ---- beats -----------------------------------------------------------------


def placed(assignments: DataFrame, keys: list[str], cell: int = CELL) -> DataFrame:
    """Lay rows out by (key, run of ``cell`` beats): the only shuffle that beat
    joining and sentence building need. A long record spreads over many tasks."""
    return in_cells(assignments, cell).repartition(*keys, "_cell")


def in_cells(assignments: DataFrame, cell: int = CELL) -> DataFrame:
    return assignments.withColumn("_cell", F.floor(F.col("beat_idx") / cell))


def join_beats(assignments: DataFrame, keys: list[str], segments: list[str], keep_incomplete: bool = False) -> DataFrame:
    """One row per beat with the token of every segment; beats lacking any segment
    are dropped unless ``keep_incomplete``. ``assignments`` must be ``placed``."""
    picks = [F.max(F.when(F.col("segment") == s, F.col("token"))).alias(s) for s in segments]
    beats = assignments.groupBy(*keys, "_cell", "beat_idx").agg(*picks)
    if keep_incomplete:
        return beats
    complete = F.lit(True)
    for s in segments:
        complete = complete & F.col(f"`{s}`").isNotNull()
    return beats.filter(complete)


def encoded(beats: DataFrame, vocab_offsets: dict[str, int]) -> DataFrame:
    """Replace the segment columns by ``tokens``: vocabulary ids in segment order."""
    ids = F.array(*[(F.col(f"`{s}`") + F.lit(o)).cast("int") for s, o in vocab_offsets.items()])
    return beats.withColumn("tokens", ids).drop(*vocab_offsets)


# ---- sentences -------------------------------------------------------------


def sentence_length(seed: int, keys: list[str], pos: Column, remaining: Column, lengths: list[int]) -> Column:
    """Keyed draw among the lengths that still fit (``lengths`` in ascending order,
    starting with 1)."""
    choices = F.array(*[F.lit(n) for n in lengths])
    fitting = F.lit(1)
    for i, n in enumerate(lengths[1:], 2):
        fitting = F.when(remaining >= n, F.lit(i)).otherwise(fitting)
    return F.element_at(choices, (draw(seed, *keys, pos) % fitting).cast("int") + 1)


def _walk(seed: int, keys: list[str], lengths: list[int], count: Column, offset: Column, n: Column, entry: Column) -> Column:
    """Array of (at, len): sentence starts among ``count`` beats at ``offset``. The
    arguments must be plain or bound values."""
    init = F.struct(entry.cast("int").alias("next"), F.array().cast("array<struct<at:int,len:int>>").alias("cuts"))

    def visit(acc: Column, i: Column) -> Column:
        size = sentence_length(seed, keys, offset + i, n - offset - i, lengths)
        grow = lambda s: F.struct(
            (i + s).cast("int").alias("next"),
            F.concat(acc["cuts"], F.array(F.struct(i.cast("int").alias("at"), s.cast("int").alias("len")))).alias("cuts"),
        )
        # Bind the draw once; it is used for the jump and for the record.
        jump = F.element_at(F.transform(F.array(size), grow), 1)
        return F.when(i == acc["next"], jump).otherwise(acc)

    steps = F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)).cast("int"))
    return F.aggregate(steps, init, visit, lambda acc: acc["cuts"])


def _emit(chunks: DataFrame, keys: list[str], seed: int, lengths: list[int]) -> DataFrame:
    """Explode (beats, count, offset, n, entry) into sentences. Each piece is cut
    before exploding, so the long array is not copied per sentence."""

    def parts(t: Column) -> Column:
        part = lambda c: F.struct(
            (t["offset"] + c["at"]).cast("bigint").alias("start_pos"), F.slice(t["beats"], c["at"] + 1, c["len"]).alias("beats")
        )
        return F.transform(_walk(seed, keys, lengths, t["count"], t["offset"], t["n"], t["entry"]), part)

    # Bound together: inside a lambda a computed column would be worked out per step.
    bound = F.struct("beats", "count", "offset", "n", "entry")
    rows = chunks.select(*keys, F.explode(let(bound, parts)).alias("s"))
    first, last = F.element_at("s.beats", 1), F.element_at("s.beats", -1)
    return rows.select(
        *keys,
        F.col("s.start_pos").alias("start_pos"),
        F.size("s.beats").alias("num_beats"),
        first["beat_idx"].alias("beat_idx_start"),
        last["beat_idx"].alias("beat_idx_end"),
        F.transform("s.beats", lambda b: b["tokens"]).alias("beat_tokens"),
    )


def _long_sentences(beats: DataFrame, keys: list[str], seed: int, lengths: list[int], cell: int) -> DataFrame:
    """Sentences of records longer than a cell. Where the next sentence starts
    depends on all earlier draws, but only through the overhang (0..7 beats) at a
    cell boundary, so cells are walked in parallel once their entry is known."""
    sizes = beats.groupBy(*keys, "_cell").agg(F.count("*").alias("_rows"))
    bases = running_total(sizes, keys, "_cell", "_rows", "_start").select(*keys, "_cell", "_start", F.col("_start_all").alias("n"))
    inside = W.partitionBy(*keys, "_cell").orderBy("beat_idx")
    placed_at = (
        beats.withColumn("_rn", F.row_number().over(inside))
        .join(bases, [*keys, "_cell"])
        .withColumn("pos", F.col("_start") + F.col("_rn") - 1)
        .drop("_cell", "_rn", "_start")
    )
    reach = max(lengths) - 1
    chunks = (
        with_halo(placed_at, "pos", before=0, after=reach, cell=cell)
        .groupBy(*keys, "_cell")
        .agg(
            F.sort_array(F.collect_list(F.struct("pos", "beat_idx", "tokens"))).alias("beats"),
            F.count_if("_core").cast("int").alias("count"),
            F.max("n").alias("n"),
        )
        .filter("count > 0")
        .withColumn("offset", F.col("_cell") * cell)
    )
    heads = placed_at.withColumn("_cell", F.floor(F.col("pos") / cell)).groupBy(*keys, "_cell")
    heads = heads.agg(F.count("*").cast("int").alias("count"), F.max("n").alias("n")).withColumn("offset", F.col("_cell") * cell)
    heads = spread(heads, [*keys, "_cell"])

    def leaving(entry: Column) -> Column:
        # The overhang is where the last sentence of the cell ends.
        step = lambda acc, i: F.when(
            i == acc, (i + sentence_length(seed, keys, F.col("offset") + i, F.col("n") - F.col("offset") - i, lengths)).cast("int")
        ).otherwise(acc)
        last = F.aggregate(F.sequence(F.lit(0), F.col("count") - 1), entry.cast("int"), step)
        return (last - F.col("count")).cast("int")

    # Small, costly to make, and read by every level of the fold.
    steps = cut_lineage(heads.select(*keys, "_cell", F.transform(F.sequence(F.lit(0), F.lit(reach)), leaving).alias("_step")))
    entries = entry_states(steps, keys, "_cell", "_step")
    return _emit(chunks.join(entries, [*keys, "_cell"]), keys, seed, lengths)


def sentences(
    assignments: DataFrame,
    keys: list[str],
    vocab_offsets: dict[str, int],
    seed: int = C.SEED,
    lengths: list[int] = C.SENTENCE_BEATS,
    cell: int = CELL,
    long_keys: DataFrame | None = None,
    whole: bool = False,
) -> DataFrame:
    """Walk the complete beats of each record in order and cut them into sentences
    whose lengths are keyed draws. Gaps in ``beat_idx`` do not break a sentence.

    ``long_keys`` may name the records that reach beyond ``cell`` beats; by default
    they are found by a filter on ``beat_idx`` that Parquet statistics answer. ``whole``: the plan of
    ``assignments`` already lays each record out in one task, so short ones need no shuffle."""
    shared_dir(assignments.sparkSession)  # long records are stored on the way: fail before any work, whatever the data
    if long_keys is None:
        long_keys = assignments.filter(F.col("beat_idx") >= cell).select(*keys).distinct()
    found = None if long_keys.isEmpty() else long_keys
    usual = assignments if found is None else assignments.join(found, keys, "left_anti")
    segments = list(vocab_offsets)
    chunks = (
        encoded(join_beats(in_cells(usual, cell) if whole else placed(usual, keys, cell), keys, segments), vocab_offsets)
        .groupBy(*keys, "_cell")
        .agg(F.sort_array(F.collect_list(F.struct("beat_idx", "tokens"))).alias("beats"))
        .withColumn("count", F.size("beats"))
        .withColumns({"offset": F.lit(0), "n": F.col("count"), "entry": F.lit(0)})
    )
    out = _emit(chunks, keys, seed, lengths)
    if found is None:
        return out
    rest = placed(assignments.join(found, keys, "left_semi"), keys, cell)
    # Read by four steps below, so worked out once.
    beats = cut_lineage(encoded(join_beats(rest, keys, segments), vocab_offsets))
    return out.unionByName(_long_sentences(beats, keys, seed, lengths, cell))


# ---- fixed-width encoding --------------------------------------------------


def sentence_tokens(width: int = C.SENTENCE_WIDTH) -> Column:
    """Beat tokens, the separator, then padding to ``width``."""
    body = F.concat(F.flatten("beat_tokens"), F.array(F.lit(C.SEP)))
    return F.concat(body, F.array_repeat(F.lit(C.PAD), F.greatest(F.lit(width) - F.size(body), F.lit(0))))


def attention_mask(num_beats: Column, per_beat: int, width: int = C.SENTENCE_WIDTH) -> Column:
    ones = _bounded(num_beats * per_beat + 1, width)
    filled = F.concat(F.array_repeat(F.lit(1), ones), F.array_repeat(F.lit(0), F.lit(width) - ones))
    return F.when(num_beats.isNull(), F.array_repeat(F.lit(None).cast("int"), width)).otherwise(filled)


def _bounded(n: Column, width: int) -> Column:
    """``n`` within 0 and ``width``."""
    return F.greatest(F.lit(0), F.least(n, F.lit(width))).cast("int")


def token_types(num_beats: Column, per_beat: int, width: int = C.SENTENCE_WIDTH, max_beats: int = C.MAX_BEATS) -> Column:
    """Beat number per token; the separator has its own type, padding is 0."""
    n = F.coalesce(num_beats, F.lit(-1))
    beats = _bounded(F.least(n, F.lit(-(-width // per_beat))), width)
    # Beat numbers spelled out as far as the width asks for them, cut to the beats at hand.
    numbers = F.array(*[F.lit(i // per_beat) for i in range(-(-width // per_beat) * per_beat)])
    own = F.when(n >= 0, F.array(F.lit(max_beats))).otherwise(F.array().cast("array<int>"))
    kinds = F.concat(F.slice(numbers, F.lit(1), beats * per_beat), own, F.array_repeat(F.lit(0), width))
    return F.slice(kinds, 1, width)


def place_vectors(vectors: Column, width: int, dim: int) -> Column:
    """Segment vectors at their token positions; separator and padding get zeros."""
    zero = F.array_repeat(F.lit(0.0), dim)
    return F.concat(vectors, F.array_repeat(zero, F.greatest(F.lit(width) - F.size(vectors), F.lit(0))))


# ---- masking ---------------------------------------------------------------


def masked(
    df: DataFrame,
    keys: list[str],
    tokens: str,
    vocab_size: int,
    ratio_pct: int = 15,
    seed: int = C.SEED,
    strict: bool = False,
) -> DataFrame:
    """Choose ``max(1, ceil(width * ratio))`` positions by lowest keyed score, real
    tokens first, and replace 80 % by MASK, 10 % by a random real token.

    Adds ``masked_pos``, ``masked_tokens`` (the targets) and ``masked_ids``. With few
    real tokens the quota runs over into separator and padding positions, as in
    usual practice; ``strict`` keeps to real tokens. A sentence is one bounded row,
    so this is array work without a shuffle, done on Arrow batches."""
    kind = df.schema[tokens].dataType.elementType
    wide = kind if isinstance(kind, T.LongType) else T.IntegerType()
    parts = {"masked_pos": T.IntegerType(), "masked_tokens": kind, "masked_ids": wide}

    @F.arrow_udf(T.StructType([T.StructField(name, T.ArrayType(t)) for name, t in parts.items()]))
    def choose(base: pa.Array, ids: pa.Array) -> pa.Array:
        return _masked_batch(base, ids, vocab_size, ratio_pct, strict)

    return df.withColumn("_m", choose(keyed_md5(seed, *keys), tokens)).select(*df.columns, "_m.*")


def _masked_batch(base: pa.Array, ids: pa.Array, vocab_size: int, ratio_pct: int, strict: bool) -> pa.Array:
    """Struct (masked_pos, masked_tokens, masked_ids) of every row, all NULL where ``ids`` is NULL. Rows of one width are
    worked on as a matrix."""
    known = np.asarray(ids.is_valid())
    width = np.asarray(ids.value_lengths().fill_null(0)).astype(np.int64)
    start = np.cumsum(width) - width
    flat = ids.flatten()
    real = np.asarray(flat.is_valid())
    token = np.asarray(flat.fill_null(C.PAD)).astype(np.int64)
    text = base.cast(pa.large_string())
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset]
    word = np.frombuffer(text.buffers()[2], np.uint32, 8 * len(text), at).reshape(-1, 8) if len(text) else np.zeros((0, 8), np.uint32)
    quota = np.minimum(np.maximum(1, -(-width * ratio_pct // 100)), width)
    shown, shown_real = token.copy(), real.copy()
    place = np.cumsum(quota) - quota
    picked, taken = np.zeros(int(quota.sum()), np.int64), np.zeros(int(quota.sum()), bool)
    for w in np.unique(width[known]).tolist():
        rows = np.flatnonzero(known & (width == w))
        if not w:
            continue
        q = int(quota[rows[0]])
        own = [np.ascontiguousarray(word[rows, k]) for k in range(8)]
        cells = start[rows][:, None] + np.arange(w)
        late = ~real[cells] | (token[cells] == C.PAD) | (token[cells] == C.SEP)
        # One digest of the sentence key yields four scores.
        scores = np.stack([s for b in range(-(-w // 4)) for s in md5_words(own, md5_ends(b"|score|", [b])[0].tolist())], axis=1)[:, :w]
        ordered = (late.astype(np.uint64) << np.uint64(63)) | (scores.astype(np.uint64) << np.uint64(31)) | np.arange(w, dtype=np.uint64)
        first = np.sort(ordered, axis=1)[:, :q]
        spot = (first & np.uint64(2**31 - 1)).astype(np.int64)
        ends = md5_ends(b"|pick|", range(w))[spot.ravel()]
        number, other, _, _ = md5_words([np.repeat(x, q) for x in own], [np.ascontiguousarray(ends[:, k]) for k in range(8)])
        sort = (number.astype(np.int64) * 10 // DRAW_RANGE).reshape(-1, q)
        fresh = C.FIRST_TOKEN + other.astype(np.int64).reshape(-1, q) % (vocab_size - C.FIRST_TOKEN)
        keep = (first >> np.uint64(63)) == 0 if strict else np.ones(first.shape, bool)
        cell = start[rows][:, None] + spot
        shown[cell[keep]] = np.where(sort < 8, C.MASK, np.where(sort < 9, fresh, token[cell]))[keep]
        shown_real[cell[keep]] = (real[cell] | (sort < 9))[keep]
        to = place[rows][:, None] + np.arange(q)
        picked[to], taken[to] = spot, keep
    row = np.repeat(np.arange(len(width)), quota)[taken]
    held = np.bincount(row, minlength=len(width))
    cell = start[row] + picked[taken]

    def lists(values: np.ndarray, valid: np.ndarray | None, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        items = pa.array(values, mask=None if valid is None else ~valid).cast(kind)
        return pa.ListArray.from_arrays(ends, items, mask=pa.array(~known))

    kind = ids.type.value_type
    columns = [
        lists(picked[taken], None, held, pa.int32()),
        lists(token[cell], real[cell], held, kind),
        lists(shown, shown_real, width, pa.int64() if kind == pa.int64() else pa.int32()),
    ]
    return pa.StructArray.from_arrays(columns, ["masked_pos", "masked_tokens", "masked_ids"])


def blank_vectors(vectors: Column, positions: Column) -> Column:
    """Zero the vectors at masked positions, which are a plain column: they are looked at per vector."""
    blank = lambda v, i: F.when(F.array_contains(positions, i), F.transform(v, lambda x: F.lit(0.0))).otherwise(v)
    return F.transform(vectors, blank)
