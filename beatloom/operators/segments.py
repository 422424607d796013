"""Records to beats to segment waveforms: quality gate, landmark bounds, cutting,
lead completeness, profiles, and the two neighbourhood rules (detrend, peaks)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from beatloom import constants as C
from beatloom.functions.arrays import let, pad_right, z_normalise
from beatloom.operators.ordered import CELL, entry_states, joined, running, spread, windowed
from beatloom.session import cut_lineage, shared_dir

BLOCK = 4096  # positions of a signal in one array

# Landmark columns that bound each segment; TP ends at the next beat.
BOUNDS = [
    ("P", "p_on", "p_off"),
    ("PQ", "p_off", "r_on"),
    ("QRS", "r_on", "r_off"),
    ("ST", "r_off", "t_on"),
    ("T", "t_on", "t_off"),
    ("TP", "t_off", "next_p_on"),
]


# ---- quality gate ----------------------------------------------------------


def drop_reason(leads: int = C.NUM_LEADS, min_peaks: int = C.MIN_PEAKS) -> Column:
    """Exactly one outcome per record, the first that applies. Expects read_ok,
    n_samples, n_leads, clean_ok, peaks_ok, n_peaks, delineate_ok, n_cycles."""
    tests = [
        ~F.col("read_ok"),
        F.col("n_samples") == 0,
        F.col("n_leads") != leads,
        ~F.col("clean_ok"),
        ~F.col("peaks_ok"),
        F.col("n_peaks") < min_peaks,
        ~F.col("delineate_ok"),
        F.col("n_cycles") == 0,
    ]
    out = None
    for test, reason in zip(tests, C.DROP_REASONS):
        out = F.when(test, reason) if out is None else out.when(test, reason)
    return out.otherwise("accepted")


def reason_counts(records: DataFrame) -> DataFrame:
    """Records and beat cycles per outcome; the cycles of dropped records count as skipped."""
    kept = F.col("reason") == "accepted"
    return records.groupBy("reason").agg(
        F.count("*").alias("records"),
        F.sum(F.when(kept, F.col("n_cycles")).otherwise(0)).alias("beats"),
        F.sum(F.when(kept, 0).otherwise(F.col("n_cycles"))).alias("skipped"),
    )


# ---- landmarks to segments -------------------------------------------------


def with_next_onset(landmarks: DataFrame, keys: list[str], cell: int = CELL) -> DataFrame:
    """P onset of the following beat, and whether there is one."""
    add = lambda frame: {
        "next_p_on": F.max("p_on").over(frame(1, 1)),
        "_more": F.count(F.lit(1)).over(frame(1, 1)) > 0,
    }
    return windowed(landmarks, keys, "beat_idx", 0, 1, add, cell)


def beat_segments(landmarks: DataFrame, keys: list[str], lengths: DataFrame, cell: int = CELL) -> DataFrame:
    """One row per beat with its six segments and whether the beat is kept.

    Beats with a follower are considered. A segment with a missing or reversed bound
    counts as a missing wave, except on beat 0, where it is invalid. Any invalid
    segment (empty, outside the signal, shorter than 2) drops the whole beat.
    ``lengths`` holds (keys, n_samples)."""

    def segment(name: str, lo: str, hi: str) -> Column:
        start, end = F.col(lo), F.col(hi)
        missing = (start.isNull() | end.isNull() | (start > end)) & (F.col("beat_idx") > 0)
        fits = start.isNotNull() & end.isNotNull() & (start >= 0) & (end <= F.col("n_samples")) & (end - start >= 2)
        return F.struct(
            F.lit(name).alias("segment"),
            start.cast("int").alias("start"),
            end.cast("int").alias("end"),
            missing.alias("missing"),
            F.coalesce(missing | fits, F.lit(False)).alias("ok"),
            F.when(missing, 0).otherwise(end - start).cast("int").alias("original_len"),
        )

    beats = with_next_onset(landmarks, keys, cell).filter("_more").join(lengths, keys)
    beats = beats.withColumn("segments", F.array(*[segment(*b) for b in BOUNDS]))
    return beats.select(*keys, "beat_idx", "segments", F.forall("segments", lambda s: s["ok"]).alias("kept"))


def segment_rows(beats: DataFrame, keys: list[str], keep_missing: bool = False) -> DataFrame:
    """Rows (keys, beat_idx, segment, start, end, missing, original_len) of kept beats."""
    rows = beats.filter("kept").select(*keys, "beat_idx", F.explode("segments").alias("s")).select(*keys, "beat_idx", "s.*").drop("ok")
    return rows if keep_missing else rows.filter("original_len > 0")


def sample_blocks(signal: DataFrame, keys: list[str], target: int = C.PAD_LENGTH, block: int = BLOCK) -> DataFrame:
    """A signal in long form (keys, lead_idx, sample_idx, value) as arrays of ``block`` positions, each
    followed by the samples that a segment of ``target`` may reach behind it: (keys, lead_idx, block,
    at, samples), ``at`` the positions of the samples. Missing values leave gaps in ``at``."""
    own = lambda c: F.floor(F.col("sample_idx") / block) if c is None else F.floor((F.col("sample_idx") - c) / block)
    both = F.explode(F.array_distinct(F.array(own(None), own(target - 1)))).alias("block")
    rows = signal.filter("value IS NOT NULL").select(*keys, "lead_idx", both, F.col("sample_idx").cast("int").alias("at"), F.col("value").cast("double").alias("v"))
    packed = rows.groupBy(*keys, "lead_idx", "block").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("_x"))
    return packed.select(*keys, "lead_idx", "block", F.transform("_x", lambda x: x["at"]).alias("at"), F.transform("_x", lambda x: x["v"]).alias("samples"))


def record_blocks(records: DataFrame, keys: list[str], target: int = C.PAD_LENGTH, block: int = BLOCK) -> DataFrame:
    """The same from records stored as one array per lead (keys, lead_idx, samples)."""
    start = F.sequence(F.lit(0), F.greatest(F.size("samples") - 1, F.lit(0)), F.lit(block))
    pieces = records.select(*keys, "lead_idx", F.explode(start).alias("_s"), F.col("samples").alias("_all"))
    cut = pieces.select(*keys, "lead_idx", F.floor(F.col("_s") / block).alias("block"), "_s", F.slice("_all", F.col("_s") + 1, F.lit(block + target - 1)).alias("_v"))
    held = F.filter(F.transform("_v", lambda v, i: F.struct((F.col("_s") + i).alias("at"), v.cast("double").alias("v"))), lambda x: x["v"].isNotNull())
    return cut.withColumn("_x", held).select(*keys, "lead_idx", "block", F.transform("_x", lambda x: x["at"]).alias("at"), F.transform("_x", lambda x: x["v"]).alias("samples"))


def cut_blocks(segments: DataFrame, blocks: DataFrame, keys: list[str], target: int = C.PAD_LENGTH, blank_leads: list[int] | None = None, block: int = BLOCK) -> DataFrame:
    """Segment waveforms from a signal in blocks.

    A segment meets the one block that holds its start, so a row moves per segment and per block, not per
    sample, and a record of any length spreads. At most ``target`` samples are cut, since truncation comes before
    normalising. Missing waves are left out, or come as zeros for each of ``blank_leads``. A segment
    that lacks a sample in a lead is dropped for that lead: it is no segment of the given bounds."""
    rows = segments.filter("NOT missing").select(
        *keys, "beat_idx", "segment", "original_len", F.col("start").cast("int").alias("_from"), F.least(F.col("end"), F.col("start") + target).cast("int").alias("_to")
    )
    met = rows.withColumn("block", F.floor(F.col("_from") / block)).join(blocks, [*keys, "block"])
    # Without gaps the place follows from the first position; behind a gap it is sought.
    guess = (F.col("_from") - F.get("at", F.lit(0)) + 1).cast("int")
    place = F.when(F.get("at", guess - 1) == F.col("_from"), guess).otherwise(F.array_position("at", F.col("_from")).cast("int"))
    met = met.withColumns({"_p": place, "_n": F.col("_to") - F.col("_from")})
    whole = (F.col("_p") > 0) & (F.get("at", F.col("_p") + F.col("_n") - 2) == F.col("_to") - 1)
    cut = met.filter(whole).select(*keys, "beat_idx", "segment", "lead_idx", "original_len", F.slice("samples", F.col("_p"), F.col("_n")).alias("raw"))
    if blank_leads is not None:
        lead = dict(cut.dtypes)["lead_idx"]
        each = F.explode(F.array(*[F.lit(x).cast(lead) for x in blank_leads])).alias("lead_idx")
        blank = segments.filter("missing").select(*keys, "beat_idx", "segment", each, "original_len", F.array().cast(dict(cut.dtypes)["raw"]).alias("raw"))
        cut = cut.select(*blank.columns).unionByName(blank)
    return cut.select(*keys, "beat_idx", "segment", "lead_idx", "original_len", pad_right(z_normalise(F.col("raw")), target).alias("data"))


def cut_samples(segments: DataFrame, signal: DataFrame, keys: list[str], target: int = C.PAD_LENGTH, blank_leads: list[int] | None = None, block: int = BLOCK) -> DataFrame:
    """``cut_blocks`` from a signal in long form."""
    block = max(block, target)
    return cut_blocks(segments, sample_blocks(signal, keys, target, block), keys, target, blank_leads, block)


def cut_records(records: DataFrame, segments: DataFrame, keys: list[str], target: int = C.PAD_LENGTH, block: int = BLOCK) -> DataFrame:
    """``cut_blocks`` from records with one array per lead."""
    block = max(block, target)
    return cut_blocks(segments.filter("original_len > 0"), record_blocks(records, keys, target, block), keys, target, None, block)


def truncated(data: Column, segment: Column, lengths: dict[str, int]) -> Column:
    """Cut to the modelling length of the segment, without normalising again."""
    table = F.create_map(*[F.lit(x) for kv in lengths.items() for x in kv])
    return F.slice(data, F.lit(1), F.element_at(table, segment))


# ---- leads -----------------------------------------------------------------


def beat_tensors(waves: DataFrame, keys: list[str], leads: int = C.NUM_LEADS) -> DataFrame:
    """One row per beat that has every lead: the lead arrays in lead order.
    Zero-length waves count as absent."""
    real = waves.filter("original_len > 0")
    rows = real.groupBy(*keys, "beat_idx").agg(F.sort_array(F.collect_list(F.struct("lead_idx", "data", "original_len"))).alias("_all"))
    full = rows.filter(F.size(F.array_distinct(F.transform("_all", lambda x: x["lead_idx"]))) == leads)
    return full.select(
        *keys, "beat_idx", F.transform("_all", lambda x: x["data"]).alias("tensor"), F.element_at("_all", 1)["original_len"].alias("original_len")
    )


def nth_beat(waves: DataFrame, keys: list[str], n: int) -> DataFrame:
    """All leads of each record's n-th real beat, counted from 0. The rank limit is
    applied on the map side, so a long record sends only its first beats."""
    real = waves.filter("original_len > 0")
    rank = F.dense_rank().over(W.partitionBy(*keys).orderBy("beat_idx"))
    return real.withColumn("_r", rank).filter(F.col("_r") <= n + 1).filter(F.col("_r") == n + 1).drop("_r")


def lead_subset(tensor: Column, leads: list[int], all_leads: int = C.NUM_LEADS) -> Column:
    """Lead II alone or every lead; anything else is an error."""
    if leads == [C.LEAD_II]:
        return F.slice(tensor, C.LEAD_II + 1, 1)
    if leads == list(range(all_leads)):
        return tensor
    raise ValueError("use lead II alone or all leads")


# ---- profiles --------------------------------------------------------------


def percentile_of_score(value: Column, score) -> Column:
    """Aggregate: mean percentage rank of ``score`` among the values."""
    below, upto = F.count_if(value < score), F.count_if(value <= score)
    return (below + upto + (below < upto).cast("bigint")) * 50 / F.nullif(F.count(value), F.lit(0))


def percentiles(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles per key, between two values by the line through them: (key, one column per name). NULL
    values do not count.

    Selection by counting: equal values are merged, running counts give the ranks, and the two values around a
    share are read off. No task or buffer holds a key's values."""
    counts = cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")))
    below = running(counts, [key], ["_v"], "_n", "_below")
    rows = joined(below, counts.groupBy(key).agg(F.sum("_n").alias("_all")), [key])
    place = {name: (F.col("_all") - 1) * F.lit(p) for name, p in shares.items()}
    at = lambda rank: F.max(F.when((F.col("_below") <= rank) & (rank < F.col("_below") + F.col("_n")), F.col("_v")))
    ends = [x for name, h in place.items() for x in (at(F.floor(h)).alias(f"_lo_{name}"), at(F.ceil(h)).alias(f"_hi_{name}"))]
    found = rows.groupBy(key).agg(F.max("_all").alias("_all"), *ends)
    line = lambda name: F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (place[name] - F.floor(place[name]))
    return found.select(key, *[line(name).alias(name) for name in shares])


def length_profile(df: DataFrame, key: str, length: str, score: int = C.PAD_LENGTH) -> DataFrame:
    """Length statistics per segment type over non-zero lengths, plus the zero count."""
    real = F.when(F.col(length) > 0, F.col(length))
    stats = df.groupBy(key).agg(
        F.count_if(F.col(length) == 0).alias("zeros"),
        F.count(real).alias("n"),
        F.avg(real).alias("mean"),
        F.stddev_pop(real).alias("std"),
        F.max(real).alias("longest"),
        percentile_of_score(real, F.lit(score)).alias("score_rank"),
    )
    exact = percentiles(df.select(key, real.alias("_length")), key, "_length", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    rows = joined(stats, exact, [key], "left")
    return rows.select(key, "zeros", "n", "mean", "std", "p50", "p95", "p99", "longest", "score_rank")


def histogram(df: DataFrame, key: str, value: str, bins: int = 10) -> DataFrame:
    """Counts in ``bins`` equal bins between each key's minimum and maximum; the last
    bin includes its right edge. Equal values are merged before the join."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("_n"))
    ends = counts.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = F.col("hi") - F.col("lo")
    at = F.least(F.floor(F.try_divide((F.col(value) - F.col("lo")) * bins, width)), F.lit(bins - 1))
    # A single value sits in the middle bin, as numeric libraries widen such a range by half.
    slot = F.when(width > 0, at).otherwise(F.lit(bins // 2)).cast("int")
    return counts.join(ends, key).groupBy(key, slot.alias("bin")).agg(F.sum("_n").alias("n"))


def mean_wave(waves: DataFrame, key: str, data: str, cap: int | None = None, scale: float = 1000.0) -> DataFrame:
    """Mean and population deviation per position over waves extended to the longest.

    A wave keeps its samples and holds its last value. The held part is not written
    out: waves that end before a position enter it as running sums over end
    positions, so the cost follows the samples, not waves times the longest. Moments are
    taken around each key's lowest value, so a high level costs no digits. ``cap`` may
    limit the samples of a wave."""
    wave = F.col(data) if cap is None else F.slice(data, 1, cap)
    floor = waves.groupBy(key).agg(F.min(F.array_min(data)).cast("double").alias("_floor"))
    point = lambda pos, x, held: F.struct(pos.cast("int").alias("pos"), x.cast("double").alias("x"), F.lit(held).alias("held"))
    samples = lambda w: F.transform(w, lambda x, i: point(i, x, False))
    points = let(wave, lambda w: F.when(F.size(w) > 0, F.concat(samples(w), F.array(point(F.size(w), F.element_at(w, -1), True)))))
    rows = waves.select(key, F.explode(points).alias("_p")).select(key, "_p.pos", "_p.x", "_p.held")
    rows = rows.join(floor, key).withColumn("x", F.col("x") - F.col("_floor"))
    part = lambda held, c: F.sum(F.when(F.col("held") == held, c).otherwise(0.0))
    terms = {"_n": F.lit(1.0), "_s": F.col("x"), "_q": F.col("x") * F.col("x")}
    sums = rows.groupBy(key, "pos").agg(F.max("_floor").alias("_floor"), *[part(h, c).alias(f"{n}{int(h)}") for n, c in terms.items() for h in (False, True)])
    upto = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    add = lambda a: (F.col(f"{a}0") + F.sum(f"{a}1").over(upto)).alias(a)
    at = sums.select(key, "pos", "_floor", "_n0", *[add(n) for n in terms]).filter("_n0 > 0")
    mean, second = F.col("_s") / F.col("_n"), F.col("_q") / F.col("_n")
    std = F.sqrt(F.greatest(second - mean * mean, F.lit(0.0)))
    return at.select(key, "pos", ((mean + F.col("_floor")) * scale).alias("mean"), (std * scale).alias("std"))


def amplitude_range(waves: DataFrame, key: str, data: str) -> DataFrame:
    return waves.groupBy(key).agg(F.min(F.array_min(data)).alias("lowest"), F.max(F.array_max(data)).alias("highest"))


# ---- neighbourhood rules ---------------------------------------------------


def detrend(signal: DataFrame, keys: list[str], reach: int = 5, out: str = "clean", cell: int = CELL) -> DataFrame:
    """Value minus the average of the centred run of 2*reach+1 samples."""
    return windowed(signal, keys, "sample_idx", reach, reach, lambda frame: {out: F.col("value") - F.avg("value").over(frame(-reach, reach))}, cell)


def peak_candidates(signal: DataFrame, keys: list[str], reach: int = 2, height: float = 1.0, cell: int = CELL) -> DataFrame:
    """Samples strictly above their ``reach`` neighbours on each side and above
    mean + height * population deviation of their key."""
    level = signal.groupBy(*keys).agg((F.avg("value") + height * F.stddev_pop("value")).alias("_level"))
    sides = lambda frame: {"_left": F.max("value").over(frame(-reach, -1)), "_right": F.max("value").over(frame(1, reach))}
    near = windowed(signal, keys, "sample_idx", reach, reach, sides, cell)
    above = lambda c: F.coalesce(F.col("value") > F.col(c), F.lit(True))
    tops = near.filter(above("_left") & above("_right"))
    # Only local maxima meet the level join, a fraction of the samples.
    return tops.join(level, keys).filter(F.col("value") > F.col("_level")).drop("_left", "_right", "_level")


def _keep_apart(at: Column, free: Column, spacing: int) -> Column:
    """Scan sorted positions from ``free`` on, keeping those not blocked by the last kept."""
    init = F.struct(free.cast("bigint").alias("free"), F.array().cast("array<bigint>").alias("kept"))
    take = lambda acc, p: F.struct((p + spacing).cast("bigint").alias("free"), F.concat(acc["kept"], F.array(p)).alias("kept"))
    return F.aggregate(at, init, lambda acc, p: F.when(p >= acc["free"], take(acc, p)).otherwise(acc), lambda acc: acc["kept"])


def spaced(
    points: DataFrame, keys: list[str], position: str, spacing: int, cell: int = CELL, long_keys: DataFrame | None = None
) -> DataFrame:
    """Scan forward and drop every point closer than ``spacing`` to the last kept one.

    Records within one cell are scanned as they are. ``long_keys`` may name the others;
    by default they are the ones with a point at ``cell`` or later."""
    cell = max(cell, spacing)
    shared_dir(points.sparkSession)  # long records are stored on the way: fail before any work, whatever the data
    if long_keys is None:
        long_keys = points.filter(F.col(position) >= cell).select(*keys).distinct()
    found = None if long_keys.isEmpty() else long_keys
    usual = points if found is None else points.join(found, keys, "left_anti")
    at = F.sort_array(F.collect_list(F.col(position).cast("bigint"))).alias("_at")
    short = usual.groupBy(*keys).agg(at).select(*keys, F.explode(_keep_apart(F.col("_at"), F.lit(0), spacing)).alias(position))
    if found is None:
        return short
    own = F.floor(F.col(position) / cell)
    # Read by three steps below, so worked out once.
    cells = cut_lineage(points.join(found, keys, "left_semi").withColumn("_cell", own).groupBy(*keys, "_cell").agg(at))
    return short.unionByName(_spaced_cells(cells, keys, position, spacing, cell))


def _spaced_cells(cells: DataFrame, keys: list[str], position: str, spacing: int, cell: int) -> DataFrame:
    """Across a cell boundary only the distance still blocked (0..spacing-1) matters, so
    cells are scanned in parallel once their entry is known."""
    start = F.col("_cell") * cell

    def leaving(at: Column, entry: Column) -> Column:
        free = F.aggregate(at, start + entry, lambda acc, p: F.when(p >= acc, p + spacing).otherwise(acc))
        return F.greatest(free - start - cell, F.lit(0)).cast("int")

    # After an empty cell nothing is blocked any more. Only keys and cell numbers meet.
    before = cells.select(*keys, (F.col("_cell") + 1).alias("_cell"), F.lit(True).alias("_after"))
    neighbours = cells.join(before, [*keys, "_cell"], "left").withColumn("_joined", F.coalesce("_after", F.lit(False))).drop("_after")
    states = F.sequence(F.lit(0), F.lit(spacing - 1))
    ways = lambda at: F.transform(states, lambda e: leaving(at, F.when(F.col("_joined"), e).otherwise(0)))
    flagged = spread(neighbours, [*keys, "_cell"])
    # Small, costly to make, and read by every level of the fold.
    steps = cut_lineage(flagged.select(*keys, "_cell", "_joined", let(F.col("_at"), ways).alias("_step")))
    entries = entry_states(steps, keys, "_cell", "_step")
    first = entries.join(steps.select(*keys, "_cell", "_joined"), [*keys, "_cell"]).select(*keys, "_cell", F.when(F.col("_joined"), F.col("entry")).otherwise(0).alias("entry"))
    kept = _keep_apart(F.col("_at"), start + F.col("entry"), spacing)
    return cells.join(first, [*keys, "_cell"]).select(*keys, F.explode(kept).alias(position))


def peaks(
    signal: DataFrame,
    keys: list[str],
    reach: int = 2,
    height: float = 1.0,
    spacing: int = 3,
    cell: int = CELL,
    long_keys: DataFrame | None = None,
) -> DataFrame:
    """Peak positions. ``long_keys`` may name the records longer than a cell; by default
    a filter on the stored sample index finds them."""
    found = peak_candidates(signal, keys, reach, height, cell).select(*keys, F.col("sample_idx").cast("bigint").alias("sample_idx"))
    # Strict local maxima are always more than ``reach`` apart.
    if spacing <= reach + 1:
        return found
    if long_keys is None:
        long_keys = signal.filter(F.col("sample_idx") >= cell).select(*keys).distinct()
    return spaced(found, keys, "sample_idx", spacing, cell, long_keys)


def enough_peaks(found: DataFrame, keys: list[str], least: int = C.MIN_PEAKS) -> DataFrame:
    return found.groupBy(*keys).agg(F.count("*").alias("n_peaks")).withColumn("enough", F.col("n_peaks") >= least)
