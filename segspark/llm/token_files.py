"""Operator 5: token ids in binary files, document boundaries in Elias-Fano code.

A file holds one run of documents in ascending ``doc_id`` order::

    magic "EFIDS1\\0\\0" | width u64 | n_docs u64 | n_null u64 | n_ids u64 | first_id i64 | size_b u64 | size_d u64
    boundaries (size_b bytes) | doc ids (size_d bytes) | ids (n_ids * width bytes)

``boundaries`` are the end offsets of the documents, ``doc ids`` the ids minus
``first_id``; both ascend and are Elias-Fano coded: of n values below u, the
``l = floor(log2(u / n))`` low bits of each are packed, the rest is a unary bit
vector, and the place of every 256th set bit is kept, so ``EliasFano.get(i)``
reads one block. That takes about ``2 + log2(u / n)`` bits a document instead
of 64. ``width`` is 2 bytes for vocabularies below 65,536, else 4.

Cases: a null text counts as empty (its only id is ``end_id``); null ``doc_id``
rows come first and read back as null; equal ids keep all their rows, ordered
by text; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segspark.llm.shared import file_system, materialise, shuffle_partitions, work_path
from segspark.llm.tokens import default_tokenizer, ids_of, tokenizer

MAGIC = b"EFIDS1\0\0"
HEADER = struct.Struct("<8sQQQQqQQ")
BLOCK = 256
FILE_IDS = 2_000_000


class EliasFano:
    """Ascending unsigned integers in about ``2 + log2(u / n)`` bits each, with random access."""

    def __init__(self, raw: bytes | memoryview) -> None:
        self.n, self.low_bits, n_low, n_high = struct.unpack_from("<QQQQ", raw)
        at = 32
        self.low = np.frombuffer(raw, np.uint8, n_low, at)
        self.high = np.frombuffer(raw, np.uint8, n_high, at + n_low)
        self.samples = np.frombuffer(raw, "<u4", -(-self.n // BLOCK), at + n_low + n_high)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        low = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        packed_low, packed_high = (np.packbits(x, bitorder="little").tobytes() for x in (low.reshape(-1), high))
        return (struct.pack("<QQQQ", n, bits, len(packed_low), len(packed_high)) + packed_low + packed_high
                + ones[::BLOCK].astype("<u4").tobytes())

    def _low_of(self, first: int, count: int) -> np.ndarray:
        b = self.low_bits
        bits = np.unpackbits(self.low, bitorder="little")[first * b:(first + count) * b] if count == self.n else \
            np.unpackbits(self.low[first * b // 8:-(-(first + count) * b // 8)], bitorder="little")[first * b % 8:][:count * b]
        return (bits.reshape(count, b).astype(np.uint64) << np.arange(b, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low_of(0, self.n)

    def get(self, i: int) -> int:
        """The i-th value: the block's sampled bit, then the remaining set bits from there."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start, left, byte = int(self.samples[i // BLOCK]), i % BLOCK, 0
        at = start // 8
        seen = np.unpackbits(self.high[at:at + 64], bitorder="little")
        seen[:start % 8] = 0
        while seen.sum() <= left:
            left -= int(seen.sum())
            byte += 64
            seen = np.unpackbits(self.high[at + byte:at + byte + 64], bitorder="little")
        one = (at + byte) * 8 + int(np.flatnonzero(seen)[left])
        return ((one - i) << self.low_bits) | int(self._low_of(i, 1)[0])


def encode_file(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """One file's bytes. ``doc_ids`` ascend, nulls first."""
    n_null = sum(x is None for x in doc_ids)
    known = np.array(doc_ids[n_null:], np.int64)
    first = int(known[0]) if len(known) else 0
    ends = EliasFano.encode(np.cumsum(sizes).astype(np.uint64))
    names = EliasFano.encode(known.view(np.uint64) - np.array([first], np.int64).view(np.uint64))
    return (HEADER.pack(MAGIC, width, len(doc_ids), n_null, len(ids), first, len(ends), len(names)) + ends + names
            + ids.astype(f"<u{width}").tobytes())


class TokenFile:
    """A file read back. ``span(i)`` is a document's (start, end); ``ids`` is the whole array without a copy."""

    def __init__(self, raw: bytes) -> None:
        magic, width, self.n_docs, self.n_null, n_ids, self.first_id, size_b, size_d = HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        view = memoryview(raw)
        at = HEADER.size
        self.ends, self.names = EliasFano(view[at:at + size_b]), EliasFano(view[at + size_b:at + size_b + size_d])
        self.ids = np.frombuffer(raw, f"<u{width}", n_ids, at + size_b + size_d)

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.get(i - 1) if i else 0), self.ends.get(i)

    def doc_ids(self) -> list:
        own = self.names.decode() + np.array([self.first_id], np.int64).view(np.uint64)
        return [None] * self.n_null + own.view(np.int64).tolist()


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Tokenise every text and write files in ascending ``doc_id`` order; returns the manifest.

    The manifest has a row a file: file, n_docs, n_ids, first (ids of all files
    before it). Documents are dealt by ranges of (doc_id, text hash), so one task
    holds a few files' worth of ids at most; a task that is run again writes the
    same names, each complete before it is moved into place.
    """
    spark = docs.sparkSession
    ordered = (docs.select("doc_id", "text").withColumn("_h", F.xxhash64("text"))
               .repartitionByRange(shuffle_partitions(spark), "doc_id", "_h").sortWithinPartitions("doc_id", "text")
               .drop("_h"))
    width = 2 if tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 else 4

    def write(batches):
        fs, path = file_system(folder)
        part, k, held, total = TaskContext.get().partitionId(), 0, [], 0
        fs.create_dir(f"{path}/_tmp", recursive=True)

        def flush():
            nonlocal k, held, total
            name = f"ids-{part:08d}-{k:06d}.bin"
            doc_ids = [x for h in held for x in h[0]]
            ids = np.concatenate([h[2] for h in held])
            tmp = f"{path}/_tmp/{uuid.uuid4().hex}"
            with fs.open_output_stream(tmp) as f:
                f.write(encode_file(doc_ids, np.concatenate([h[1] for h in held]), ids, width))
            fs.move(tmp, f"{path}/{name}")
            k, held, total = k + 1, [], 0
            return pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(doc_ids)], "n_ids": [len(ids)]})

        for b in batches:
            names = b.column(0)
            for i, j, ids, ends in ids_of(b.column(1), tokenizer_path, end_id):
                held.append((names.slice(i, j - i).to_pylist(), np.diff(ends), ids))
                total += len(ids)
                if total >= FILE_IDS:
                    yield flush()
        if held:
            yield flush()

    manifest = materialise(ordered.mapInArrow(write, "file string, n_docs long, n_ids long"), "token-manifest")
    # one row a file: a window over file counts, not over documents
    return manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(
        Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32 (crc32 of the ids as little-endian uint32)."""
    def read(batches):
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1)):
                f = TokenFile(raw.as_py())
                ends = f.ends.decode().astype(np.int64)
                start = np.concatenate([[0], ends])
                wide = f.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:z]) for a, z in zip(start.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array([path] * f.n_docs, pa.string()), pa.array(f.doc_ids(), pa.int64()), pa.array(start[:-1], pa.int64()),
                    pa.array(np.diff(start), pa.int64()), pa.array(crc, pa.int64())], ["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    rows = files.mapInArrow(read, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return (rows.join(manifest.select("file", "first"), "file")
            .select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


def token_files(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1) -> DataFrame:
    """Write the files to a new work folder and read them back."""
    folder = work_path(docs.sparkSession, "token-files")
    manifest = write_token_files(docs, folder, tokenizer_path or default_tokenizer(), end_id)
    return read_token_files(docs.sparkSession, folder, manifest)
