"""Leak-free splits. Orders are keyed hashes over *distinct ids*; rows get their
split by a join on the id. The row side of that join may be skewed: the id side is
unique, so adaptive execution splits a hot id without changing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom import constants as C
from beatloom.operators.ordered import hash_ranked, lowest, spread

CHUNK = 4_096


def _cuts(parts: list[tuple[str, float]], pos: Column, n: Column) -> Column:
    """First part whose end lies beyond ``pos``; each part takes floor(n * share),
    the last one the rest. A part left empty is an error."""
    sizes = [F.floor(n * F.lit(share)) for _, share in parts[:-1]]
    ends, end = [], F.lit(0)
    for s in sizes:
        end = end + s
        ends.append(end)
    empty = F.lit(False)
    for s in sizes:
        empty = empty | (s <= 0)
    empty = empty | (ends[-1] >= n)
    out = F.when(empty, F.raise_error(F.lit("a split would be empty")))
    for (name, _), e in zip(parts[:-1], ends):
        out = out.when(pos < e, F.lit(name))
    return out.otherwise(F.lit(parts[-1][0]))


def patient_split(ids: DataFrame, key: str, parts: list[tuple[str, float]], seed: int = C.SEED) -> DataFrame:
    """(key, split) with exact part sizes from a seeded shuffle of the distinct ids."""
    if abs(sum(s for _, s in parts) - 1) > 1e-9:
        raise ValueError("shares must sum to 1")
    order = hash_ranked(ids.select(key).distinct(), key, seed)
    return order.select(key, _cuts(parts, F.col("pos"), F.col("n")).alias("split"))


def first_label(rows: DataFrame, key: str, label: str, order: list[str]) -> DataFrame:
    """One row per id with the label of its first record in ``order``."""
    return rows.groupBy(key).agg(F.min_by(label, F.struct(*order)).alias(label))


def stratified_split(
    ids: DataFrame, key: str, label: str, train: float = 0.7, val: float = 0.1, min_count: int = 10, seed: int = C.SEED
) -> DataFrame:
    """(key, label, split): cut inside each label; labels with fewer than
    ``min_count`` ids go wholly to train. ``ids`` holds one row per id."""
    order = hash_ranked(ids.select(key, label), key, seed, by=[label])
    end_train = F.floor(F.col("n") * F.lit(train))
    end_val = end_train + F.floor(F.col("n") * F.lit(val))
    split = (
        F.when((F.col("n") < min_count) | (F.col("pos") < end_train), F.lit("train"))
        .when(F.col("pos") < end_val, F.lit("val"))
        .otherwise(F.lit("test"))
    )
    return order.select(key, label, split.alias("split"))


def missing_labels(split: DataFrame, label: str) -> DataFrame:
    """Labels that occur in train but not in val or not in test."""
    has = lambda s: F.count_if(F.col("split") == s)
    return (
        split.groupBy(label)
        .agg(has("train").alias("train"), has("val").alias("val"), has("test").alias("test"))
        .filter((F.col("val") == 0) | (F.col("test") == 0))
    )


def propagate(rows: DataFrame, split: DataFrame, key: str) -> DataFrame:
    return rows.join(split.select(key, "split"), key)


def official_split(fold: Column, val: list[int], test: list[int]) -> Column:
    """Official folds: named folds are val and test, all lower ones train."""
    return F.when(fold.isin(test), "test").when(fold.isin(val), "val").otherwise("train")


def tagged_split(tag: Column) -> Column:
    return F.when(tag == 0, "train").when(tag == 1, "val").when(tag == 2, "test")


def tagged_lists(lists: dict[str, DataFrame], key: str) -> DataFrame:
    """Fixed id lists as one table (key, split)."""
    out = None
    for name, ids in lists.items():
        part = ids.select(key).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def unlisted(rows: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """Ids of ``rows`` that are on no list."""
    return rows.select(key).distinct().join(lists.select(key).distinct(), key, "left_anti")


def require_none(df: DataFrame, message: str) -> None:
    """Guard: raise when ``df`` has a row. Stops at the first one found."""
    found = df.head(1)
    if found:
        raise ValueError(f"{message}: {found[0].asDict()}")


def overlap(split: DataFrame, key: str) -> DataFrame:
    """Ids in more than one split (must be empty)."""
    return split.groupBy(key).agg(F.countDistinct("split").alias("splits")).filter("splits > 1")


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many distinct rows each side has alone."""
    return sides({"left": a, "right": b}).agg(
        F.count_if(F.col("left") & ~F.col("right")).alias("only_left"), F.count_if(F.col("right") & ~F.col("left")).alias("only_right")
    )


def sides(parts: dict[str, DataFrame]) -> DataFrame:
    """Distinct rows of all parts with one flag per part, in one shuffle: unions,
    intersections and differences are then filters on the flags."""
    both = None
    for name, df in parts.items():
        part = df.withColumn("_from", F.lit(name))
        both = part if both is None else both.union(part)
    keys = [c for c in both.columns if c != "_from"]
    return both.groupBy(*keys).agg(*[F.max(F.col("_from") == name).alias(name) for name in parts])


def require_counts(rows: DataFrame, expected: dict[str, int]) -> None:
    """Guard: the splits must have exactly the expected sizes."""
    got = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count("*").alias("n")).collect()}
    if got != expected:
        raise ValueError(f"split sizes {got}, expected {expected}")


def balance(rows: DataFrame, positive: Column) -> DataFrame:
    """Rows and positive share per split."""
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.avg(positive.cast("double")).alias("positive_share"))


# ---- folds -----------------------------------------------------------------


def fold_rows(rows: DataFrame, sidecar: DataFrame, key: str, fold: int, repeat: bool) -> DataFrame:
    """Training rows of one fold: repeated as often as the fold lists the id, or once."""
    return all_fold_rows(rows, sidecar.filter(F.col("fold") == fold), key, repeat).drop("fold")


def all_fold_rows(rows: DataFrame, sidecar: DataFrame, key: str, repeat: bool, chunk: int = CHUNK) -> DataFrame:
    """The same for every fold in one join, ``copy`` counting the copies from 1. Ids listed more than ``chunk`` times
    go out as chunks of copies, dealt over all tasks before they are spelled out, so one id of any number of
    copies spreads."""
    listed = sidecar.filter(F.col("n") > 0).select(key, "fold", F.col("n").cast("bigint").alias("n"))
    if not repeat:
        return rows.join(listed, key).withColumn("copy", F.lit(1)).drop("n")
    few = rows.join(listed.filter(F.col("n") <= chunk), key).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    start = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"), F.lit(chunk).cast("bigint")))
    chunks = rows.join(listed.filter(F.col("n") > chunk), key).withColumn("_from", start)
    copies = F.sequence(F.col("_from").cast("int"), F.least(F.col("n"), F.col("_from") + chunk - 1).cast("int"))
    many = spread(chunks, [key, "fold", "_from"]).withColumn("copy", F.explode(copies))
    return few.drop("n").unionByName(many.drop("n", "_from"))


def fold_summary(sidecar: DataFrame, key: str, label: str) -> DataFrame:
    """Entries, unique ids, unique ids per label and the largest repeat of each fold.
    The sidecar has one row per (id, fold), so counting rows counts ids."""
    listed = sidecar.filter(F.col("n") > 0)
    return listed.groupBy("fold").agg(
        F.sum(F.col("n").cast("bigint")).alias("entries"),
        F.count("*").alias("unique_ids"),
        F.count_if(F.col(label) == 0).alias("unique_negative"),
        F.count_if(F.col(label) == 1).alias("unique_positive"),
        F.max(F.col("n").cast("int")).alias("max_repeat"),
    )


# ---- samples and filters ---------------------------------------------------


def train_fraction(rows: DataFrame, key: str, share: float, seed: int = C.SEED) -> DataFrame:
    """Seeded shuffle of the training rows, first floor(n * share) of them; other
    splits are kept whole. ``key`` identifies a row."""
    kept = hash_ranked(rows.filter("split = 'train'").select(key), key, seed).filter(F.col("pos") < F.floor(F.col("n") * F.lit(share))).select(key)
    train = rows.filter("split = 'train'").join(kept, key, "left_semi")
    return train.unionByName(rows.filter("split <> 'train'"))


def sample_n(df: DataFrame, key: str, n: int, seed: int = C.SEED) -> DataFrame:
    """Exactly ``n`` rows (all of fewer), the same ones every time: those of lowest keyed hash."""
    return lowest(df, key, seed, n)


def members(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose id is in the set."""
    return rows.join(ids.select(key), key, "left_semi")
