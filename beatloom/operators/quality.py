"""Comparing two versions of a dataset, partition skew, and record numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.operators.ordered import ranked


def close(a: Column, b: Column, atol: float, rtol: float) -> Column:
    """Equal within tolerance; NaN equals NaN."""
    return (F.isnan(a) & F.isnan(b)) | (F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b))


def diff_rows(a: DataFrame, b: DataFrame, key: str, values: str, atol: float = 0.0, rtol: float = 0.0) -> DataFrame:
    """One row per key of either side: present on which side, and for common keys
    whether the arrays are equal, equal within tolerance, and how many values differ."""
    left = a.select(key, F.col(values).cast("array<double>").alias("_a"), F.lit(True).alias("_in_a"))
    right = b.select(key, F.col(values).cast("array<double>").alias("_b"), F.lit(True).alias("_in_b"))
    both = left.join(right, key, "full_outer")
    same_size = F.size("_a") == F.size("_b")
    near = F.forall(F.zip_with("_a", "_b", lambda x, y: close(x, y, atol, rtol)), lambda ok: ok)
    off = F.size(F.filter(F.zip_with("_a", "_b", lambda x, y: ~x.eqNullSafe(y)), lambda d: d))
    neither = F.col("_a").isNull() & F.col("_b").isNull()
    state = F.when(F.col("_in_b").isNull(), "only_left").when(F.col("_in_a").isNull(), "only_right").otherwise("both")
    common = lambda c: F.when(F.col("state") == "both", c)
    return both.withColumn("state", state).select(
        key,
        "state",
        common(F.col("_a").eqNullSafe(F.col("_b"))).alias("equal"),
        common(neither | F.coalesce(same_size & near, F.lit(False))).alias("within"),
        common(F.when(neither, 0).otherwise(F.coalesce(off, F.size("_a"), F.size("_b")))).alias("n_diff"),
    )


def diff_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(
        F.count_if(F.col("state") == "only_left").alias("only_left"),
        F.count_if(F.col("state") == "only_right").alias("only_right"),
        F.count_if(F.col("equal")).alias("equal"),
        F.count_if(F.col("within")).alias("within"),
        F.coalesce(F.sum(F.col("n_diff").cast("bigint")), F.lit(0)).alias("values_differing"),
    )


def skew_report(counts: DataFrame, n: str = "n", line: float = 1.5) -> DataFrame:
    """Largest and smallest part, their ratio, and whether it exceeds the line."""
    ratio = F.max(n) / F.nullif(F.min(n), F.lit(0))
    return counts.agg(
        F.max(n).alias("largest"), F.min(n).alias("smallest"), F.round(ratio, 6).alias("ratio"), F.coalesce(ratio > line, F.lit(True)).alias("skewed")
    )


def partition_counts(df: DataFrame) -> DataFrame:
    """Rows per partition of a DataFrame as it is laid out."""
    return df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))


def numbered(df: DataFrame, key: str, out: str = "record_id", ties: list[str] | None = None) -> DataFrame:
    """Row position in the order of a key, NULL first. Rows of equal key follow the columns
    ``ties`` (by default all others that can be sorted), so that a key of any number of rows splits."""
    if ties is None:
        ties = [c for c, t in df.dtypes if c != key and not t.startswith(("map", "variant"))]
    return ranked(df, [], [key, *ties], out)
