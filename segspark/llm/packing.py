"""Operator 10: concatenate and cut.

All documents, each closed by ``end_id``, form one long sequence of ids that is
cut into windows of ``length`` ids, so only the last window is padded. Global
offsets come from two passes: the first tokenises, stores the ids and each
document's offset inside its partition; partition totals (a row each) give the
partitions' bases by a prefix sum; the second pass adds the bases and cuts.

Cases: a null or empty text is the one id ``end_id``; a document longer than a
window has several pieces; null or repeated ``doc_id`` rows are kept as they
are; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segspark.llm.shared import materialise, work_path
from segspark.llm.textbytes import as_bytes, ragged
from segspark.llm.tokens import default_tokenizer, ids_of, tokenizer

MAX_SENT = 500_000  # rows of two numbers

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "padded_length long")


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """First pass, written to the shared folder: doc_id, part, pos (ids before it in its partition), n, ids (binary)."""
    spark = docs.sparkSession
    width = 2 if tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 else 4

    def run(batches):
        part, pos = TaskContext.get().partitionId(), 0
        for b in batches:
            for i, j, ids, ends in ids_of(b.column(1), tokenizer_path, end_id):
                raw = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((ends * width).astype(np.int32)),
                                                                      pa.py_buffer(ids.astype(f"<u{width}"))])
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, j - i), pa.array(np.full(j - i, part), pa.int32()), pa.array(pos + ends[:-1], pa.int64()),
                    pa.array(np.diff(ends), pa.int64()), raw], ["doc_id", "part", "pos", "n", "ids"])
                pos += len(ids)

    path = work_path(spark, "packing-ids")
    schema = "doc_id long, part int, pos long, n long, ids binary"
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
     .write.option("compression", "zstd").parquet(path))
    return spark.read.schema(schema).parquet(path)


def pack(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2, length: int = 4096,
         with_ids: bool = False) -> DataFrame:
    """Boundary records: one row per piece of a document inside a sequence.

    ``start`` counts the document's ids before the piece, ``offset`` its place in
    sequence ``sequence_id``. ``padded_length`` is the sequence's length as
    stored: the last one is padded to ``length`` unless its fill is a power of two.
    ``with_ids`` adds the piece's ids as little-endian uint32.
    """
    path = tokenizer_path or default_tokenizer()
    width = 2 if tokenizer(path).get_vocab_size() <= 1 << 16 else 4
    toks = tokenised(docs, path, end_id)
    totals = toks.groupBy("part").agg(F.sum("n").alias("total"))
    # one row a partition of the first pass
    bases = totals.select("part", F.coalesce(F.sum("total").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # read back, so that its size is known: it is sent to the ids, not the ids to it, up to MAX_SENT rows
    bases = materialise(bases, "packing-bases")
    bases = F.broadcast(bases) if bases.count() <= MAX_SENT else bases
    everything = totals.agg(F.sum("total").alias("all_ids"))
    placed = toks.join(bases, "part").join(F.broadcast(everything))  # one row

    def cut(batches):
        for b in batches:
            g = b.column("pos").to_numpy() + b.column("base").to_numpy()
            n = b.column("n").to_numpy()
            w0, w1 = g // length, (g + n - 1) // length
            k = w1 - w0 + 1
            row = np.repeat(np.arange(len(n)), k)
            seq = ragged(w0, k)
            left = np.maximum(g[row], seq * length)
            right = np.minimum(g[row] + n[row], (seq + 1) * length)
            start = left - g[row]
            data, off = as_bytes(b.column("ids"))
            ids = data.view(f"<u{width}").astype("<u4")
            at = off[row] // width + start
            pieces = [ids[a:z] for a, z in zip(at.tolist(), (at + right - left).tolist())]
            total = int(b.column("all_ids")[0].as_py()) if len(n) else 0
            fill = np.minimum(total - seq * length, length)
            cols = [b.column("doc_id").take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (
                start, right - left, np.array([zlib.crc32(p) for p in pieces], np.int64), n[row], seq, left - seq * length,
                np.where(fill & (fill - 1) == 0, fill, length)))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"]
            if with_ids:
                cols.append(pa.array([p.tobytes() for p in pieces], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return placed.mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))
