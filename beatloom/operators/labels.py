"""Code maps, multi-hot labels, label ids and header comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.functions.arrays import let
from beatloom.operators.ordered import ranked
from beatloom.session import cut_lineage

UNKNOWN = "Unknown"


def lookup(rows: DataFrame, codes: DataFrame, on: str, value: str, default: str = UNKNOWN) -> DataFrame:
    """One-to-one code lookup; a code that is not in the table gets ``default``."""
    return rows.join(codes.select(on, value), on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def lookup_many(rows: DataFrame, key: str, codes_col: str, codes: DataFrame, code: str, value: str, default: str | None = UNKNOWN) -> DataFrame:
    """One-to-many lookup of a code list, flattened in code order and then by value.

    Returns (key, <value>s). Duplicates stay. A record's codes sit in one row, so
    the lists merge map-side before the shuffle on the key."""
    one = rows.select(key, F.posexplode_outer(codes_col).alias("_pos", code))
    found = one.join(codes.select(code, value), code, "left")
    # A record without codes comes through with no position and stays empty.
    found = found.withColumn(value, F.when(F.col("_pos").isNotNull(), F.coalesce(F.col(value), F.lit(default))))
    packed = F.collect_list(F.when(F.col(value).isNotNull(), F.struct("_pos", value)))
    return found.groupBy(key).agg(F.transform(F.sort_array(packed), lambda x: x[value]).alias(f"{value}s"))


def distinct_sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def only_listed(codes: Column, allowed: list[str]) -> Column:
    keep = F.array(*[F.lit(c) for c in allowed])
    return F.filter(codes, lambda c: F.array_contains(keep, c))


# ---- literals and headers --------------------------------------------------


def code_map(literal: Column) -> Column:
    """A dict literal with single quotes, as ``map<string,double>``. As in a dict, a
    repeated key counts once, at its first place and with its last value."""
    parsed = F.from_json(F.replace(literal, F.lit("'"), F.lit('"')), "map<string,double>")
    return let(F.map_entries(parsed), _last_per_key)


def _last_per_key(entries: Column) -> Column:
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def header_codes(line: Column) -> Column:
    """All digit runs of a ``Dx`` comment."""
    return F.regexp_extract_all(line, F.lit(r"(\d+)"), 1)


def header_field(line: Column) -> Column:
    """Text after the first colon, trimmed."""
    return F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1))


def header_value(comments: Column, name: str) -> Column:
    """Field of the first comment that starts with ``name`` in any case."""
    hit = F.filter(comments, lambda c: F.lower(c).startswith(name.lower()))
    return header_field(F.get(hit, F.lit(0)))


# ---- classes ---------------------------------------------------------------


def class_columns(columns: list[str], not_classes: list[str]) -> list[str]:
    return [c for c in columns if c not in set(not_classes)]


def multi_hot(classes: Column, names: list[str]) -> Column:
    """0/1 vector over the fixed class order; a record may hold any subset."""
    order = F.array(*[F.lit(n) for n in names])
    return let(classes, lambda t: F.transform(order, lambda c: F.array_contains(t, c).cast("int")))


def multi_hot_by_join(rows: DataFrame, key: str, classes: str, table: DataFrame) -> DataFrame:
    """``rows`` with ``labels``, the 0/1 vector over the sorted classes of ``table`` (class), however
    many there are: places come by a join. ``key`` is unique; a class that is not in the table adds nothing."""
    places = sorted_ids(table.filter("class IS NOT NULL"), "class").select("class", F.col("label_id").alias("_place"))
    held = rows.select(key, F.explode(classes).alias("class")).distinct().join(places, "class").groupBy(key).agg(F.collect_set("_place").alias("_places"))
    full = rows.join(held, key, "left").crossJoin(F.broadcast(places.agg(F.count("*").cast("int").alias("_n"))))
    none = F.array().cast("array<int>")
    ones = lambda t: F.map_from_entries(F.transform(t, lambda p: F.struct(p.cast("int"), F.lit(1))))
    at = F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(none)
    hot = let(ones(F.coalesce(F.col("_places").cast("array<int>"), none)), lambda m: F.transform(at, lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0))))
    return full.withColumn("labels", hot).drop("_places", "_n")


def binary_hot(positive: Column) -> Column:
    return F.when(positive, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(0)))


def labelled(labels: Column) -> Column:
    return F.aggregate(labels, F.lit(0), lambda a, x: a + x) > 0


def without_code(df: DataFrame, classes: str, code: str = UNKNOWN) -> DataFrame:
    """Drop whole records that hold the code."""
    return df.filter(~F.array_contains(classes, code))


def drop_code(classes: Column, code: str = UNKNOWN) -> Column:
    """Drop only the code, keep the record."""
    return F.filter(classes, lambda c: c != code)


def single_label(df: DataFrame, classes: str, out: str = "class") -> DataFrame:
    """Records with exactly one class, and that class."""
    return df.filter(F.size(classes) == 1).withColumn(out, F.element_at(classes, 1))


def multi_label_profile(df: DataFrame, classes: str) -> DataFrame:
    """Records, records with several classes, and records with none."""
    n = F.size(classes)
    return df.agg(F.count("*").alias("records"), F.count_if(n > 1).alias("several"), F.count_if(n == 0).alias("none"), F.sum(n.cast("bigint")).alias("labels"))


def class_counts(df: DataFrame, classes: str) -> DataFrame:
    return df.select(F.explode(classes).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


# ---- label ids -------------------------------------------------------------


def sorted_ids(df: DataFrame, cls: str) -> DataFrame:
    """Dense ids in the order of the distinct classes, however many there are."""
    return _numbered(df.select(cls).distinct(), [cls]).select(cls, "label_id")


def first_seen_ids(df: DataFrame, cls: str, position: str) -> DataFrame:
    return _numbered(df.groupBy(cls).agg(F.min(position).alias("_first")), ["_first", cls]).select(cls, "label_id")


def _numbered(classes: DataFrame, order: list[str]) -> DataFrame:
    # Looked at more than once, so found once.
    return ranked(cut_lineage(classes), [], order, "label_id").withColumn("label_id", F.col("label_id").cast("int"))


def fixed_ids(cls: Column, names: list[str]) -> Column:
    """Position in a fixed list; NULL for other classes."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]), cls)
    return F.when(at > 0, (at - 1).cast("int"))


def with_label_ids(df: DataFrame, ids: DataFrame, cls: str) -> DataFrame:
    return df.join(ids, cls, "left")


# ---- joins with split lists ------------------------------------------------


def join_lists(rows: DataFrame, lists: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Rows joined on several keys with their train/val/test lists, in one join."""
    tagged = None
    for name, part in lists.items():
        part = part.withColumn("split", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    return rows.join(tagged, keys)


def join_renamed(rows: DataFrame, left_key: str, lists: dict[int, DataFrame], right_key: str) -> DataFrame:
    """Join on differently named keys, tagging the lists 0, 1, 2."""
    tagged = None
    for tag, part in lists.items():
        part = part.withColumn("tag", F.lit(tag))
        tagged = part if tagged is None else tagged.unionByName(part)
    return rows.join(tagged, rows[left_key] == tagged[right_key]).drop(right_key)


def union_common(parts: list[DataFrame]) -> DataFrame:
    """Union that keeps the columns every part has, in the order of the first."""
    keep = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    out = parts[0].select(*keep)
    for p in parts[1:]:
        out = out.unionByName(p.select(*keep))
    return out
