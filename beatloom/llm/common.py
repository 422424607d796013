"""What the operators share: tables and raw files in the folder all executors reach,
bounded samples, and words of a text column as numpy arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.session import shared_dir


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _released(spark: SparkSession):
    """The shuffle files of a write are of no use once it has ended: Spark removes them then."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the cluster's clean-up of that folder removes it."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: worked out once,
    lineage cut, safe when executors are lost."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with _released(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_raw(df: DataFrame, path: str, separator: str) -> None:
    """One binary column to files: every row's bytes, then ``separator`` (its code points as
    bytes). Spark's text writer is used because it commits per task and reaches any store."""
    (name,) = df.columns
    with _released(df.sparkSession):
        df.select(F.col(name).cast("string").alias("value")).write.option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file that ``write_raw`` made, whole files as rows."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def packed(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and, as ``_row``, whole rows, so that no further column can clash with those
    an operator adds; ``select("_row.*")`` gives the rows back."""
    return df.select(F.struct("*").alias("_row"), *columns)


def parts(total_bytes: int | None, per_part: int) -> int:
    return max(1, -(-int(total_bytes or 0) // per_part))


def bounded_sample(df: DataFrame, key: str, wanted: int, total: int) -> DataFrame:
    """About ``wanted`` rows of ``df``, the same on every run: those whose hashed ``key`` falls
    under wanted / total; never more than twice as many. For fitting only."""
    share = min(1.0, wanted / max(1, total))
    draw = F.crc32(F.concat_ws("|", F.lit("sample"), F.col(key).cast("string")).cast("binary"))
    return df.filter(draw < int(share * 2**32)).limit(2 * wanted)


# ---- words of a text column, batch-wise -------------------------------------------------

MAX_BYTES = 512 << 10  # of text worked on at once; a worker holds some fifty bytes for each


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=column.offset + n + 1)[column.offset :] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, most: int = MAX_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


class Words:
    """Cuts bytes into words and hashes them.

    ``separators``: the byte values that no word holds. A-Z count as a-z. The hash is a
    polynomial in the bytes modulo 2**64, taken from running sums, so no word is ever a
    Python object; equal words have equal hashes, and users verify what hashes find."""

    def __init__(self, separators: bytes):
        draw = np.random.default_rng(20240607)
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False
        values = draw.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        upper = np.arange(65, 91)
        values[upper] = values[upper + 32]
        self.values = values
        p = 0x9E3779B97F4A7C15 | 1
        self.up = self._powers(p)
        self.down = self._powers(pow(p, -1, 2**64))

    @staticmethod
    def _powers(p: int) -> np.ndarray:
        out = np.full(MAX_BYTES + 1, p & (2**64 - 1), dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash) of every word of the rows, in order."""
        starts, ends = [], []
        for a, b in self._pieces(raw):
            mask = self.is_word[raw[a:b]]
            edge = np.zeros(b - a + 1, bool)
            cut = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, side="right")]
            edge[cut - a] = True
            edge[0] |= a == 0
            before, after = np.empty_like(mask), np.empty_like(mask)
            before[0], before[1:] = False, mask[:-1]
            after[-1], after[:-1] = False, mask[1:]
            starts.append(np.flatnonzero(mask & (~before | edge[:-1])) + a)
            ends.append(np.flatnonzero(mask & (~after | edge[1:])) + a + 1)
        start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        return start, end, self._hashes(raw, start, end)

    def _pieces(self, raw: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pieces that end after a byte between words (or with the bytes)."""
        a = 0
        while a < len(raw):
            b = min(len(raw), a + MAX_BYTES)
            while b < len(raw):
                gap = np.flatnonzero(~self.is_word[raw[max(a, b - 4096) : b]])
                if len(gap):
                    b = max(a, b - 4096) + int(gap[-1]) + 1
                    break
                b = min(len(raw), b + 4096)
            yield a, b
            a = b

    def _hashes(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.uint64)
        i = 0
        while i < len(start):
            a = int(start[i])
            j = int(np.searchsorted(end, a + MAX_BYTES, side="right"))
            if j <= i:  # one word longer than a piece
                out[i] = self._long(raw[a : int(end[i])])
                i += 1
                continue
            b = int(end[j - 1])
            run = np.zeros(b - a + 1, np.uint64)
            np.cumsum(self.values[raw[a:b]] * self.up[: b - a], out=run[1:])
            s, e = start[i:j] - a, end[i:j] - a
            out[i:j] = (run[e] - run[s]) * self.down[s]
            i = j
        return mixed(out + (end - start).astype(np.uint64))

    def _long(self, word: np.ndarray) -> np.uint64:
        total, scale, p = 0, 1, int(self.up[1])
        for k in range(0, len(word), MAX_BYTES):
            piece = word[k : k + MAX_BYTES]
            total += scale * int((self.values[piece] * self.up[: len(piece)]).sum(dtype=np.uint64))
            scale = scale * pow(p, len(piece), 2**64) % 2**64
        return np.uint64(total % 2**64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (multiply and shift)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA24BAED4963EE407)
    return h ^ (h >> np.uint64(32))
