"""Column functions over sample arrays. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression. A lambda body is evaluated per
    element, so anything it shares (a mean, a norm) is bound outside it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _zero() -> Column:
    return F.lit(0.0)


def total(a: Column) -> Column:
    return F.aggregate(a, _zero(), lambda acc, x: acc + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def sum_squares(a: Column) -> Column:
    return F.aggregate(a, _zero(), lambda acc, x: acc + x * x)


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def _centred(a: Column, body: Callable[[Column], Column]) -> Column:
    """Bind (c, sd): the values minus their mean, and the population deviation."""
    centre = lambda s: F.transform(s["a"], lambda x: x - s["m"])
    spread = lambda c: F.struct(c.alias("c"), F.sqrt(F.try_divide(sum_squares(c), F.size(c))).alias("sd"))
    bound = F.struct(doubles(a).alias("a"), mean(doubles(a)).alias("m"))
    return let(let(let(bound, centre), spread), body)


def z_normalise(a: Column) -> Column:
    """Zero mean, unit population deviation; a flat signal is only centred."""
    return _centred(a, lambda t: F.when(t["sd"] > 0, F.transform(t["c"], lambda x: x / t["sd"])).otherwise(t["c"]))


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def channel_z(a: Column, eps: float = 1e-8) -> Column:
    """Z-score guarded by ``eps``: a tiny or non-finite deviation counts as 1, a
    non-finite mean as 0, and the divisor is ``sd + eps``."""
    stats = lambda s: F.struct(
        s["a"].alias("a"),
        F.when(_finite(s["m"]), s["m"]).otherwise(0.0).alias("m"),
        F.sqrt(F.try_divide(F.aggregate(s["a"], _zero(), lambda acc, x: acc + (x - s["m"]) * (x - s["m"])), F.size(s["a"]))).alias("sd"),
    )
    scaled = lambda t: let(
        F.struct(t["a"].alias("a"), t["m"].alias("m"), F.when(_finite(t["sd"]) & (t["sd"] >= eps), t["sd"]).otherwise(1.0).alias("sd")),
        lambda u: F.transform(u["a"], lambda x: (x - u["m"]) / (u["sd"] + eps)),
    )
    return let(let(F.struct(doubles(a).alias("a"), mean(doubles(a)).alias("m")), stats), scaled)


def zeros(n: Column | int) -> Column:
    return F.array_repeat(_zero(), n if isinstance(n, Column) else F.lit(n))


def pad_right(a: Column, n: int) -> Column:
    """Right-pad with zeros; longer arrays are left as they are."""
    return F.concat(a, zeros(F.greatest(F.lit(n) - F.size(a), F.lit(0)))) 


def fit(a: Column, n: int) -> Column:
    """Truncate or zero-pad to exactly ``n`` values."""
    return pad_right(F.slice(a, 1, n), n)


def cut_normalise_pad(signal: Column, start: Column, end: Column, target: int) -> Column:
    """Struct (data, original_len) for ``signal[start:end)``, NULL for a bound that
    is missing, reversed, outside the signal, or fewer than two samples apart.
    Truncation happens before normalising; the length is the one before it."""
    valid = start.isNotNull() & end.isNotNull() & (start >= 0) & (end <= F.size(signal)) & (end - start >= 2)
    # A bound outside the array would be rejected by slice itself.
    lo = F.when(valid, start + 1).otherwise(1).cast("int")
    n = F.when(valid, F.least(end - start, F.lit(target))).otherwise(0).cast("int")
    return F.when(
        valid,
        F.struct(
            pad_right(z_normalise(F.slice(signal, lo, n)), target).alias("data"),
            (end - start).cast("int").alias("original_len"),
        ),
    )


def centre_fit(a: Column, n: int) -> Column:
    """Crop around the centre, or zero-pad on both sides (the odd one on the right)."""
    size = F.size(a)
    drop = F.greatest(F.floor((size - n) / 2), F.lit(0)).cast("int")
    left = F.greatest(F.floor((F.lit(n) - size) / 2), F.lit(0)).cast("int")
    right = F.greatest(F.lit(n) - size - left, F.lit(0)).cast("int")
    return F.concat(zeros(left), F.slice(a, drop + 1, F.lit(n)), zeros(right))


def decimate(a: Column, taps: list[float], step: int) -> Column:
    """Centred FIR filter evaluated at every ``step``-th sample only; samples
    beyond either end count as zero."""
    half = len(taps) // 2
    weights = F.array(*[F.lit(float(t)) for t in taps])
    tap = lambda t, i: F.aggregate(
        F.sequence(F.lit(0), F.lit(len(taps) - 1)),
        _zero(),
        lambda acc, j: acc + F.element_at(weights, j + 1) * F.coalesce(F.get(t, i + F.lit(half) - j), _zero()),
    )
    points = lambda t: F.when(F.size(t) > 0, F.sequence(F.lit(0), F.greatest(F.size(t) - 1, F.lit(0)), F.lit(step)))
    return let(a, lambda t: F.coalesce(F.transform(points(t), lambda i: tap(t, i)), F.array().cast("array<double>")))


def hold_to(a: Column, n: Column) -> Column:
    """Re-index to positions 0..n-1: values keep their index and the last is held."""
    at = lambda t, i: F.element_at(t, F.least(i + 1, F.size(t)).cast("int"))
    return let(a, lambda t: F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(t, i)))


def clean(a: Column) -> Column:
    """NaN and infinities become 0."""
    return F.transform(doubles(a), lambda x: F.when(_finite(x), x).otherwise(0.0))


def count_unclean(a: Column) -> Column:
    return F.size(F.filter(doubles(a), lambda x: ~_finite(x)))


def strip_nan(a: Column) -> Column:
    """Drop NaN and NULL positions and cast the rest to int."""
    return F.transform(F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x)), lambda x: x.cast("int"))


def unit_norm_scaled(a: Column) -> Column:
    """L2-normalise and multiply by the square root of the dimension."""
    scale = lambda s: F.when(s["n"] > 0, F.transform(s["a"], lambda x: x / s["n"] * F.sqrt(F.size(s["a"])))).otherwise(s["a"])
    return let(F.struct(doubles(a).alias("a"), F.sqrt(sum_squares(doubles(a))).alias("n")), scale)


def scaled(a: Column, factor: float) -> Column:
    return F.transform(doubles(a), lambda x: x * factor)


def boundary_pairs(ends: Column, starts: Column) -> Column:
    """Pairs (end of one wave, start of the next) with either side missing dropped."""
    pairs = F.arrays_zip(ends.alias("s"), starts.alias("e"))
    return F.filter(F.transform(pairs, lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"))), lambda p: p["s"].isNotNull() & p["e"].isNotNull())


def as_text(a: Column, scale: int = 1_000_000) -> Column:
    """Comma-joined integers of ``value * scale``, for reports and comparisons."""
    return F.array_join(F.transform(a, lambda x: F.floor(x * scale + 0.5).cast("bigint").cast("string")), ",")


def ints_text(a: Column) -> Column:
    return F.array_join(a.cast("array<string>"), ",")
