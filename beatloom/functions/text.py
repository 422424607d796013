"""Ids and run settings carried in paths, names and log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The path shape that carries patient and study.
ID_PATTERN = r"/p(\d+)/s(\d+)/"
STEM_PATTERN = r"([^/]+?)(\.[^./]*)?$"


def path_stem(path: Column) -> Column:
    """File name without folder and without its last extension."""
    return F.regexp_extract(path, STEM_PATTERN, 1)


def path_id(path: Column, group: int, pattern: str = ID_PATTERN) -> Column:
    """The numbered id in the path, or the file stem where the path has none."""
    found = F.regexp_extract(path, pattern, group)
    return F.when(found == "", path_stem(path)).otherwise(found)


def metric_values(line: Column) -> Column:
    """Map of every ``name = value`` pair in a log line."""
    pattern = r"([A-Za-z_]\w*) = ([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    names = F.regexp_extract_all(line, F.lit(pattern), 1)
    values = F.regexp_extract_all(line, F.lit(pattern), 2)
    return F.arrays_zip(names.alias("name"), F.transform(values, lambda v: v.cast("double")).alias("value"))
