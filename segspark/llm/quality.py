"""Operator 4: quality by nearest-neighbour voting in a latent semantic space.

Terms are hashed words and hashed word shapes (case, digits, marks, repetition
of the word before); counts are damped, weighted by inverse document frequency
over all documents, and each of the two blocks gets a fixed share of the unit
length. A truncated singular value decomposition of a bounded labelled sample
gives the latent axes. The labelled vectors (``max_labelled`` rows of ``RANK``
floats) are broadcast; every document's cosine with each of them is computed
exactly, in blocks, and its ``NEIGHBOURS`` nearest vote by similarity.

Cases: null and empty texts have the zero vector and score the labelled share
of ones; null or repeated ``doc_id`` rows keep a row each; without labels every
score is 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.llm.sampling import by_hash, fold, texts_of
from segspark.llm.textbytes import LOWER, NON_SPACE, U, as_bytes, chunks, mix64, prefix_hash, range_hash, spans

SHAPES, WORDS = 1024, 3072
DIMS = SHAPES + WORDS
SHAPE_SHARE = 0.8
RANK, NEIGHBOURS, BLOCK = 48, 31, 1024

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = 65
_CLASS[97:123] = 97
_CLASS[48:58] = 48
_CLASS[128:] = 97


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents x DIMS counts: word shapes first, then words."""
    n = len(offsets) - 1
    s, e, first = spans(data, offsets, NON_SPACE)
    word = range_hash(prefix_hash(LOWER[data]), s, e)
    doc = np.repeat(np.arange(n), np.diff(first))
    again = np.zeros(len(s), bool)
    again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    c = _CLASS[data].astype(np.uint64)
    last = [c[np.maximum(e - k, s)] << U(8 * k) for k in (1, 2, 3)] if len(s) else [np.zeros(0, np.uint64)] * 3
    shape = mix64((c[s] if len(s) else np.zeros(0, np.uint64)) | last[0] | last[1] | last[2] | (again.astype(np.uint64) << U(40)))
    at = np.concatenate([doc * DIMS + (shape % U(SHAPES)).astype(np.int64),
                         doc * DIMS + SHAPES + (word % U(WORDS)).astype(np.int64)])
    return np.bincount(at, minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts times idf; the shape and word blocks are scaled to fixed lengths."""
    x = np.log1p(counts) * idf
    for block, share in ((x[:, :SHAPES], SHAPE_SHARE), (x[:, SHAPES:], 1 - SHAPE_SHARE)):
        norm = np.sqrt((block * block).sum(axis=1, keepdims=True))
        block *= np.sqrt(share) / np.maximum(norm, 1e-12)
    return x


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with each term, over all documents, and their number. DIMS numbers reach the driver."""
    def run(batches):
        total, rows = np.zeros(DIMS, np.int64), 0
        for b in batches:
            data, offsets = as_bytes(b.column("text"))
            for i, j, raw, off in chunks(data, offsets, docs=BLOCK):
                total += (term_counts(raw, off) > 0).sum(axis=0)
                rows += j - i
        yield pa.RecordBatch.from_pydict({"term": np.arange(DIMS + 1), "n": np.append(total, rows)})

    got = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMS + 1, np.int64)
    for r in got:
        out[r["term"]] = r["n"]
    return out[:DIMS], int(out[DIMS])


def latent_axes(x: np.ndarray, rank: int, seed: int = 11) -> np.ndarray:
    """Leading right singular vectors (DIMS x rank) by a randomised range finder with two power steps."""
    rank = min(rank, *x.shape)
    y = x @ np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + 16, x.shape[0]))).astype(np.float32)
    for _ in range(2):
        q, _ = np.linalg.qr(y)
        y = x @ (x.T @ q)
    q, _ = np.linalg.qr(y)
    return np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000):
    """(idf, axes, labelled vectors, labels), or None without labels. ``labels``: doc_id, quality."""
    df, n = document_frequency(docs)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + 1
    ids = by_hash(labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", max_labelled, 3)
    got = texts_of(docs, ids).mapInArrow(_weighted_rows(idf), "quality int, x binary").collect()  # at most max_labelled rows
    if not got:
        return None
    got.sort(key=lambda r: (r["x"], r["quality"]))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32)
    axes = latent_axes(x, RANK)
    return idf, axes, unit(x @ axes), np.array([r["quality"] for r in got], np.float32)


def _weighted_rows(idf: np.ndarray):
    def run(batches):
        for b in batches:
            data, offsets = as_bytes(b.column("text"))
            for i, j, raw, off in chunks(data, offsets, docs=BLOCK):
                x = weighted(term_counts(raw, off), idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column("quality").slice(i, j - i).cast(pa.int32()),
                                                  pa.array([r.tobytes() for r in x], pa.binary())], ["quality", "x"])
    return run


def vote(x: np.ndarray, vectors: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Similarity-weighted share of ones among each row's ``k`` nearest labelled vectors."""
    sim = x @ vectors.T
    k = min(k, len(labels))
    near = np.argpartition(sim, len(labels) - k, axis=1)[:, len(labels) - k:]
    weight = np.maximum(np.take_along_axis(sim, near, axis=1), 0) ** 2
    total = weight.sum(axis=1)
    return np.where(total > 0, (weight * labels[near]).sum(axis=1) / np.maximum(total, 1e-12), labels.mean())


def score(docs: DataFrame, model) -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_labelled, RANK and DIMS

    def run(batches):
        for b in batches:
            data, offsets = as_bytes(b.column("text"))
            for i, j, raw, off in chunks(data, offsets, docs=BLOCK):
                if shared.value:
                    idf, axes, vectors, labels = shared.value
                    p = vote(unit(weighted(term_counts(raw, off), idf) @ axes), vectors, labels, NEIGHBOURS)
                else:
                    p = np.full(j - i, 0.5)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(np.clip(p, 0, 1), pa.float64())],
                                                 ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """Learn from the rows of ``labels`` outside the held-out fold and score every document."""
    known = labels.where((fold(F.col("doc_id"), folds) != held_out) & F.col("quality").isNotNull())
    return score(docs, fit(docs, known.select("doc_id", "quality"))).select(
        "doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
