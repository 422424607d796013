"""Token-id output: documents in doc_id order as separately compressed frames.

A folder holds ``dictionary`` (one zstandard dictionary, trained on serialized id arrays) and
``data`` (part files in doc_id order). A part file is a chain of segments:

    magic 6 bytes | dictionary sha-256, first 16 bytes | documents u32 | tokens u64
    per document: has id u8, doc_id i64, tokens u64, end of its frame u64 (from the first frame)
    the frames | one byte 0x0A

All numbers are little-endian. A frame is the zstandard form of the document's ids as unsigned
32-bit integers, made on its own with the shared dictionary, so one document is reached through
the index without touching the others (``read_document``).

Defined cases: null text is empty; an empty text has the end id only; rows with a null doc_id
come first; repeated doc_ids follow each other; an empty table gives no rows;
further columns are ignored."""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beatloom.llm.common import bounded_sample, parts, read_raw, shared_path, stored, write_raw

MAGIC = b"BLTOK\x01"
HEAD, ENTRY = "<6s16sIQ", np.dtype([("known", "u1"), ("doc_id", "<i8"), ("tokens", "<u8"), ("end", "<u8")])
END_ID = 1
SEGMENT_BYTES = 4 << 20
FILE_BYTES = 48 << 20  # text bytes per file: a file is read whole
CACHE_WORDS = 800_000
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 1_000, 32 << 10, 64 << 10


class Encoder:
    """Ids of texts by the tokenizers library. The pre-tokenizer never joins what a blank or
    line feed parts, so each distinct blank-delimited word is encoded once and remembered. Up to
    ``CACHE_WORDS`` words stay for the life of the Python worker; later ones last for their batch of
    texts. New words are encoded together, with a mark of one id between them; words that
    hold the mark go alone."""

    MARK, TOGETHER = "\u2605", 256
    _made: dict[str, Encoder] = {}

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        mark = self._ids([self.MARK])[0]
        self.mark = mark[0] if len(mark) == 1 else None
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, vocabulary: str) -> Encoder:
        """The worker's encoder of this vocabulary."""
        if vocabulary not in cls._made:
            cls._made[vocabulary] = cls(vocabulary)
        return cls._made[vocabulary]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        alone = [w for w in words if self.mark is None or self.MARK in w]
        yield from zip(alone, (ids.tobytes() for ids in self._ids(alone)))
        rest = words if not alone else [w for w in words if not (self.mark is None or self.MARK in w)]
        groups = [rest[k : k + self.TOGETHER] for k in range(0, len(rest), self.TOGETHER)]
        between = f" {self.MARK} "
        for group, ids in zip(groups, self._ids([between.join(g) for g in groups])):
            data, cuts = ids.tobytes(), [-4, *(4 * np.flatnonzero(ids == self.mark)).tolist(), 4 * len(ids)]
            for word, a, b in zip(group, cuts, cuts[1:]):
                yield word, data[a + 4 : b]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        known = self.known
        new = [w for w in set().union(*split) if w not in known]
        room = max(0, CACHE_WORDS - len(known))
        known.update(self._encoded(new[:room]))
        if len(new) <= room:
            return [b"".join(map(known.__getitem__, words)) for words in split]
        brief = dict(self._encoded(new[room:]))
        return [b"".join([known[w] if w in known else brief[w] for w in words]) for words in split]

    def in_turn(self, texts: Iterable[str], most: int = 1 << 20) -> Iterator[bytes]:
        """As a call, over texts of about ``most`` characters at a time."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= most:
                yield from self(held)
                held, size = [], 0
        yield from self(held)


def _end(end_id: int | None) -> bytes:
    return b"" if end_id is None else struct.pack("<I", end_id)


def train_dictionary(docs: DataFrame, vocabulary: str, total: int, sample_docs: int = SAMPLE_DOCS, size: int = DICT_BYTES) -> bytes:
    """A dictionary from the id arrays of about ``sample_docs`` documents (at most twice as
    many), at most ``SAMPLE_BYTES`` of each. It decides sizes only, never what is read back."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(vocabulary)
        for batch in batches:
            texts = (t.as_py() or "" for t in batch.column("text"))
            yield pa.RecordBatch.from_pydict({"ids": pa.array([x[:SAMPLE_BYTES] for x in encode.in_turn(texts)], pa.binary())})

    rows = bounded_sample(docs.select("doc_id", "text"), "doc_id", sample_docs, total).select("text").mapInArrow(ids, "ids binary")
    samples = sorted(r.ids for r in rows.collect() if r.ids)
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on: their bytes are the dictionary
        return b"".join(samples)[:size]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = END_ID, level: int = 3) -> None:
    """Documents (doc_id, text) to the folder ``path``. One exchange: the texts, by ranges of doc_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    dictionary = train_dictionary(docs, vocabulary, total)
    one = spark.createDataFrame([(bytearray(dictionary),)], "value binary").coalesce(1)
    write_raw(one, f"{path}/dictionary", "\n")
    tag = hashlib.sha256(dictionary).digest()[:16]
    tail = _end(end_id)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(vocabulary)
        shrink = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_content_size=True)
        entries: list[tuple[int, int, int, int]] = []
        frames: list[bytes] = []
        held = 0

        def segment() -> pa.RecordBatch:
            index = np.array(entries, dtype=ENTRY)
            data = struct.pack(HEAD, MAGIC, tag, len(entries), int(index["tokens"].sum())) + index.tobytes() + b"".join(frames)
            entries.clear()
            frames.clear()
            return pa.RecordBatch.from_pydict({"value": pa.array([data], pa.binary())})

        for batch in batches:
            texts = (t.as_py() for t in batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.in_turn(texts)):
                ids += tail
                frames.append(shrink.compress(ids))
                held += len(frames[-1])
                entries.append((doc_id is not None, doc_id or 0, len(ids) // 4, held))
                if held >= SEGMENT_BYTES:
                    yield segment()
                    held = 0
        if entries:
            yield segment()

    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = docs.repartitionByRange(parts(size, FILE_BYTES), *by).sortWithinPartitions(*by)
    write_raw(dealt.mapInArrow(segments, "value binary"), f"{path}/data", "\n")


def _segments(data: memoryview) -> Iterator[tuple[bytes, np.ndarray, int, int]]:
    """(dictionary tag, index, where the frames begin, where the segment ends) of each segment."""
    at = 0
    while at < len(data):
        magic, tag, n, _ = struct.unpack_from(HEAD, data, at)
        if magic != MAGIC:
            raise ValueError("not a token file")
        index = np.frombuffer(data, ENTRY, n, at + struct.calcsize(HEAD))
        first = at + struct.calcsize(HEAD) + index.nbytes
        end = first + (int(index["end"][-1]) if n else 0)
        yield tag, index, first, end
        at = end + 1


def stored_dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(read_raw(spark, f"{path}/dictionary").first().content)[:-1]


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document: ``start`` counts the ids of
    all documents before it, ``ids`` are the little-endian bytes. Without ids the rows are
    kept as a small table, so files are read once."""
    dictionary = stored_dictionary(spark, path)
    tag = hashlib.sha256(dictionary).digest()[:16]
    schema = "file string, doc_id long, ahead long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content")):
                data, ahead = memoryview(content.as_buffer()), 0
                for found, index, first, _ in _segments(data):
                    if found != tag:
                        raise ValueError("segment written with another dictionary")
                    cuts = np.concatenate([[0], index["end"].astype(np.int64)]) + first
                    ids = [grow.decompress(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                    tokens = index["tokens"].astype(np.int64)
                    if any(len(x) != 4 * t for x, t in zip(ids, tokens)):
                        raise ValueError("frame does not match its index")
                    cols = {
                        "file": pa.array([file.as_py()] * len(ids), pa.string()),
                        "doc_id": pa.array(index["doc_id"].astype(np.int64), mask=index["known"] == 0),
                        "ahead": pa.array(ahead + np.cumsum(tokens) - tokens),
                        "n_tokens": pa.array(tokens),
                        "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    }
                    if with_ids:
                        cols["ids"] = pa.array(ids, pa.binary())
                    ahead += int(tokens.sum())
                    yield pa.RecordBatch.from_pydict(cols)

    rows = read_raw(spark, f"{path}/data").mapInArrow(decode, schema)
    if not with_ids:
        rows = stored(rows, "token-rows")
    # One row per file; part numbers follow the doc_id ranges.
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("_all"))
    number = F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("long")
    before = totals.select("file", (F.sum("_all").over(Window.orderBy(number)) - F.col("_all")).alias("_before"))
    out = ["doc_id", (F.col("_before") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32"]
    return rows.join(before, "file").select(*out, *(["ids"] if with_ids else []))


def read_document(data: bytes, dictionary: bytes, number: int) -> np.ndarray:
    """Ids of document ``number`` of a part file: only its own frame is decompressed."""
    view = memoryview(data)
    for _, index, first, _ in _segments(view):
        if number < len(index):
            a = int(index["end"][number - 1]) if number else 0
            frame = view[first + a : first + int(index["end"][number])]
            return np.frombuffer(zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress(frame), "<u4")
        number -= len(index)
    raise IndexError(number)


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes ``docs`` and reads them back: (doc_id, start, n_tokens, ids_crc32)."""
    path = shared_path(docs.sparkSession, "tokens")
    write(docs, path, vocabulary)
    return read(docs.sparkSession, path, with_ids=False)
