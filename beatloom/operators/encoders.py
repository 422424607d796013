"""Vector features of fixed-length multi-channel signals: random convolution kernels as a table, drawn by keyed
hashes and applied with array functions, and encoders that users bring.

A kernel is a row (kernel, taps, dilation, padding, bias); a tap is (channel, place, weight). The table has as many rows
as there are kernels, whatever the data, and travels as one row beside every signal."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatloom.functions.arrays import let
from beatloom.functions.hashing import DRAW_RANGE, draw

# The kernel lengths to choose from.
KERNEL_LENGTHS = (7, 9, 11)


def uniform(seed: int, *keys) -> Column:
    """In [0, 1), from the keyed draw."""
    return draw(seed, *keys) / F.lit(float(DRAW_RANGE))


def normal(seed: int, *keys) -> Column:
    """Standard normal (Box and Muller) from two keyed draws."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - uniform(seed, F.lit("radius"), *keys)))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(seed, F.lit("angle"), *keys))


def random_kernels(spark: SparkSession, channels: int, signal_len: int, count: int, seed: int = 42, lengths: tuple[int, ...] = KERNEL_LENGTHS) -> DataFrame:
    """(kernel, taps, dilation, padding, bias): random length, dilation up to the signal's, a random subset of the
    channels, normal weights centred over the taps used, bias in [-1, 1), and padding for half of them on average."""
    if signal_len <= max(lengths):
        raise ValueError("the signal must be longer than the longest kernel")
    u = lambda what, *more: uniform(seed, F.lit(what), "kernel", *more)
    sizes = F.array(*[F.lit(n) for n in lengths])
    drawn = spark.range(count).select(F.col("id").cast("int").alias("kernel")).withColumn("_n", F.get(sizes, F.floor(u("length") * len(lengths)).cast("int")))
    reach = F.log2(F.lit(float(signal_len - 1)) / (F.col("_n") - 1))
    drawn = drawn.withColumn("dilation", F.greatest(F.lit(1), F.floor(F.pow(F.lit(2.0), u("dilation") * reach)).cast("int")))
    order = F.array_sort(F.array(*[F.struct(u("channel", F.lit(c)).alias("u"), F.lit(c).alias("c")) for c in range(channels)]))
    used = F.slice(F.transform(order, lambda x: x["c"]), F.lit(1), (F.floor(u("subset") * channels) + 1).cast("int"))
    places = drawn.select("*", F.explode(used).alias("channel")).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("place"))
    weighted = places.withColumn("weight", normal(seed, "kernel", "channel", "place"))
    tap = F.struct("channel", "place", "weight")
    rows = weighted.groupBy("kernel", "_n", "dilation").agg(F.sort_array(F.collect_list(tap)).alias("_taps"), F.avg("weight").alias("_mean"))
    centred = F.transform("_taps", lambda t: F.struct(t["channel"].alias("channel"), t["place"].alias("place"), (t["weight"] - F.col("_mean")).alias("weight")))
    half = F.floor((F.col("_n") - 1) * F.col("dilation") / 2).cast("int")
    padding = F.when(u("padding") < 0.5, half).otherwise(0).alias("padding")
    return rows.select("kernel", centred.alias("taps"), "dilation", padding, (u("bias") * 2 - 1).alias("bias"))


def random_projection(spark: SparkSession, features: int, width: int, seed: int = 42) -> DataFrame:
    """(out, weights): a fixed random map of ``features`` values to ``width``."""
    cells = spark.range(width).select(F.col("id").cast("int").alias("out"), F.explode(F.sequence(F.lit(0), F.lit(features - 1))).alias("feature"))
    cells = cells.withColumn("w", normal(seed, F.lit("projection"), "out", "feature") / F.lit(math.sqrt(features)))
    return cells.groupBy("out").agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", "w"))), lambda x: x["w"]).alias("weights"))


def response(signal: Column, kernel: Column) -> Column:
    """The kernel at every step of the signal (channels x samples); beyond both ends the signal is 0."""
    reach = F.aggregate(kernel["taps"], F.lit(0), lambda a, t: F.greatest(a, t["place"])) * kernel["dilation"]
    steps = F.size(F.get(signal, F.lit(0))) + kernel["padding"] * 2 - reach
    at = lambda t, s: F.get(F.get(signal, t["channel"]), s + t["place"] * kernel["dilation"] - kernel["padding"])
    sum_at = lambda s: F.aggregate(kernel["taps"], kernel["bias"], lambda a, t: a + t["weight"] * F.coalesce(at(t, s), F.lit(0.0)))
    return F.transform(F.sequence(F.lit(0), steps - 1), sum_at)


def with_kernel_features(df: DataFrame, signal: str, kernels: DataFrame, projection: DataFrame | None = None) -> DataFrame:
    """Add ``features`` of ``signal`` (channels x samples, equal lengths above the kernels'): per kernel the share of positive
    steps and the largest, in kernel order, or a ``projection`` of them."""
    one = lambda rows, order, name: F.broadcast(rows.agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in rows.columns if c != order]))).alias(name)))
    both = lambda r: F.array(F.size(F.filter(r, lambda x: x > 0)) / F.size(r).cast("double"), F.array_max(r))
    wide = df.withColumn(signal, F.col(signal).cast("array<array<double>>")).crossJoin(one(kernels, "kernel", "_kernels"))  # one row
    features = F.flatten(F.transform("_kernels", lambda k: let(response(F.col(signal), k), both)))
    out = wide.withColumn("features", features).drop("_kernels")
    if projection is not None:
        dot = lambda w: F.aggregate(F.zip_with("features", w, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        out = out.crossJoin(one(projection, "out", "_map")).withColumn("features", F.transform("_map", lambda r: dot(r["weights"]))).drop("_map")
    return out


def encode(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], added: str = "features array<double>") -> DataFrame:
    """Apply a user encoder: an iterator of pandas batches in, the same rows plus the
    ``added`` columns out."""
    extra = T.StructType.fromDDL(added)
    return df.mapInPandas(fn, T.StructType([*df.schema.fields, *extra.fields]))


PROVIDERS: dict[str, Callable] = {"kernels": with_kernel_features, "user": encode}


def by_name(name: str | None) -> Callable | None:
    """Encoder by name, or None for no embedding."""
    if name in (None, "none"):
        return None
    if name not in PROVIDERS:
        raise ValueError(f"unknown encoder {name}; known: {sorted(PROVIDERS)}")
    return PROVIDERS[name]
