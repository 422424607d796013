"""Signal sources and sinks: explicit schemas in, Parquet out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom import constants as C
from beatloom.functions.arrays import fit
from beatloom.functions.hashing import keyed_md5
from beatloom.functions.text import path_stem
from beatloom.operators.ordered import ranked

# Schemas of stored tables.
SEGMENT_SCHEMA = "segment string, patient_id string, study_id string, beat_idx int, lead_idx int, original_len int, data array<float>"
SENTENCE_SCHEMA = (
    "sentence_tokens array<int>, num_beats tinyint, patient_id string, study_id string, beat_idx_start int, beat_idx_end int, labels array<int>"
)
ASSIGNMENT_SCHEMA = "patient_id string, study_id string, beat_idx int, token_index smallint, segment string, codebook_size int"


def list_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(path, length) of the files with a suffix, at any depth. Contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", "length")


def shuffled_shards(files: DataFrame, shard: Callable[[Column], Column] = path_stem, seed: int = C.SEED, limit: int | None = None) -> DataFrame:
    """Distinct shards of a file list in keyed-hash order, optionally the first ``limit``."""
    shards = files.select(shard(F.col("path")).alias("shard")).distinct().orderBy(keyed_md5(seed, "shard"), "shard")
    return shards if limit is None else shards.limit(limit)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with a header line and a given schema; nothing is inferred."""
    return spark.read.csv(path, header=True, schema=schema)


def read_signal_csv(spark: SparkSession, path: str, leads: int, recording: Callable[[Column], Column] = path_stem) -> DataFrame:
    """One file = one record, a line = a sample, a column = a lead, no header. The
    record is named by ``recording`` of the file path.

    Lines carry no number: a block of a file is read by one task from its first line to its
    last, which numbers them there, and the lines of the blocks before are added. So a long
    recording is read in blocks like any other file. Blank lines do not count."""
    text = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", r"\r$", "").alias("line")
    )
    lines = text.filter(F.trim("line") != "").withColumn("_line", F.monotonically_increasing_id())
    # In pieces at any size: a short table's lines may be long, and one file all of it.
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = ranked(lines, ["path"], ["block", "_line"], out="sample_idx", pieces=pieces)
    cells = F.transform(F.split("line", ","), lambda x: F.trim(x).cast("double"))
    return rows.select(recording(F.col("path")).alias("recording_id"), "sample_idx", F.posexplode(F.slice(cells, 1, leads)).alias("lead_idx", "value"))


def stack_leads(df: DataFrame, keys: list[str], lead_columns: list[str], max_len: int) -> DataFrame:
    """Wide lead columns to (samples: array of leads, each fitted to ``max_len``), with
    the true length, and whether the leads agree on it."""
    sizes = F.array(*[F.size(c) for c in lead_columns])
    return df.select(
        *keys,
        F.array(*[fit(F.col(c).cast("array<double>"), max_len) for c in lead_columns]).alias("leads"),
        F.size(lead_columns[0]).alias("length"),
        (F.array_max(sizes) == F.array_min(sizes)).alias("even"),
    )


def long_form(df: DataFrame, keys: list[str], leads: str) -> DataFrame:
    """(keys, lead_idx, sample_idx, value) from stacked leads."""
    one = df.select(*keys, F.posexplode(leads).alias("lead_idx", "_s"))
    return one.select(*keys, "lead_idx", F.posexplode("_s").alias("sample_idx", "value"))


def signal_rows(df: DataFrame, leads: str, n_leads: int, cap: int | None = None) -> DataFrame:
    """Rows ready to store: signals cut at ``cap`` if one is given, with the true and the stored length.
    A record with the wrong number of leads, or leads of different length, is an error."""
    sizes = F.transform(leads, lambda a: F.size(a))
    fits = (F.size(leads) == n_leads) & (F.array_max(sizes) == F.array_min(sizes))
    checked = F.when(fits, (F.col(leads) if cap is None else F.transform(leads, lambda a: F.slice(a, 1, cap)))).otherwise(F.raise_error(F.lit("a record does not have the expected leads")))
    length = F.size(F.element_at(leads, 1))
    return df.withColumn("length", length).withColumn("stored_length", (length if cap is None else F.least(length, F.lit(cap)))).withColumn(leads, checked)


def write_segments(df: DataFrame, path: str, mode: str = "error") -> None:
    """One folder per segment type, so that a reader opens only what it needs."""
    df.write.mode(mode).partitionBy("segment").parquet(path)


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Compute and store the first time, reuse afterwards."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A JSON report that never replaces an earlier one."""
    df.write.mode("error").json(path)


def sentence_set(df: DataFrame, path: str, vocab: DataFrame, mode: str = "error") -> None:
    """Sentences and, beside them, the vocabulary they were encoded with."""
    df.write.mode(mode).parquet(f"{path}/sentences")
    vocab.write.mode(mode).parquet(f"{path}/vocab")


def upsert_stored(new: DataFrame, path: str, keys: list[str]) -> str:
    """Keyed upsert of a stored table. Writers that share a name would overwrite what
    they read, so each version gets its own folder; returns the one just written."""
    from beatloom.operators.runs import upsert

    spark = new.sparkSession
    old = latest_version(spark, path)
    merged = new if old is None else upsert(spark.read.parquet(f"{path}/v={old}"), new, keys)
    target = f"{path}/v={(-1 if old is None else old) + 1}"
    merged.write.mode("error").parquet(target)
    return target


def latest_version(spark: SparkSession, path: str) -> int | None:
    """Highest complete version folder of a stored table."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    done = [s.getPath().getName() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    numbers = [int(n[2:]) for n in done if n.startswith("v=")]
    return max(numbers) if numbers else None


def file_rows(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows per (file, by) of a file scan."""
    return df.groupBy(F.col("_metadata.file_path").alias("file"), *by).agg(F.count("*").alias("n_rows"))


def run_files(spark: SparkSession, path: str, schema: str, pattern: str, contains: str | None = None) -> DataFrame:
    """Metric files of many runs, with run tag and seed taken from the file name."""
    rows = spark.read.schema(schema).json(path, recursiveFileLookup=True)
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
    name: Column = F.regexp_extract(folder, pattern, 1)
    seed = F.regexp_extract(folder, pattern, 2).cast("int")
    out = rows.select("*", name.alias("run_tag"), seed.alias("seed"))
    return out if contains is None else out.filter(F.col("run_tag").contains(contains))
