"""Operator 9: non-negative positive-unlabelled learning of toxicity.

Positives are confirmed toxic examples, everything else is unlabelled text; no
example counts as negative. With class prior p the risk is
``p * R(positives, +) + max(0, R(unlabelled, -) - p * R(positives, -))``: the
second part estimates the risk on the unseen negatives, and where a mini-batch
makes it negative (over-fitting) the step goes against it. The model is linear
over hashed words and word beginnings, so inflected forms share weights.

Model size is fixed by ``DIMS``. The sample is bounded by ``max_positive`` and
``max_unlabelled``, taken by hash from the whole tables.

Cases: null and empty texts get the score of a text without features; null or
repeated ``doc_id`` rows keep a row each; without any positive example every
score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segspark.llm.sampling import by_hash, fold, texts_of
from segspark.llm.textbytes import ALNUM, LOWER, U, as_bytes, chunks, prefix_hash, range_hash, spans

BITS = 20
DIMS = 1 << BITS
BEGINNINGS = (4, 5, 6)
CHUNK = 1 << 19  # bytes of text at a time; a word has up to four features of eight bytes, several times over


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every word and word beginning, repeats included."""
    data = LOWER[data]
    s, e, first = spans(data, offsets, ALNUM)
    p = prefix_hash(data)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    out_doc, out = [doc], [range_hash(p, s, e)]
    for k in BEGINNINGS:
        long = e - s > k
        out_doc.append(doc[long])
        out.append(range_hash(p, s[long], s[long] + k) + U(k))
    return np.concatenate(out_doc), (np.concatenate(out) >> U(64 - BITS)).astype(np.int64)


def feature_rows(docs: DataFrame) -> DataFrame:
    """Distinct features of each document as little-endian uint32."""
    keep = [f for f in docs.schema.fields if f.name != "text"]
    def run(batches):
        for b in batches:
            data, offsets = as_bytes(b.column("text"))
            for i, j, raw, off in chunks(data, offsets, CHUNK):
                doc, feat = features(raw, off)
                key = np.unique(doc * DIMS + feat)
                ends = np.searchsorted(key, np.arange(j - i + 1) * DIMS)
                flat = (key % DIMS).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(f.name).slice(i, j - i) for f in keep),
                     pa.array([flat[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:])], pa.binary())],
                    [*(f.name for f in keep), "feats"])

    return docs.select(*[f.name for f in keep], "text").mapInArrow(run, T.StructType([*keep, T.StructField("feats", T.BinaryType())]))


def slopes(z: np.ndarray, n_positive: int, prior: float) -> tuple[float, np.ndarray]:
    """Estimated risk on unseen negatives, and the step's direction for each score of a batch, positives first.

    With the logistic loss the slopes of loss(+) and loss(-) are s - 1 and s. While the estimate is not negative the
    whole risk goes down; otherwise the step goes up the estimate alone.
    """
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    minus = np.logaddexp(0, z)
    n_unlabelled = len(z) - n_positive
    negative = minus[n_positive:].mean() - prior * minus[:n_positive].mean()
    g = np.empty(len(z))
    if negative >= 0:
        g[:n_positive] = prior * (s[:n_positive] - 1) / n_positive - prior * s[:n_positive] / n_positive
        g[n_positive:] = s[n_positive:] / n_unlabelled
    else:
        g[:n_positive] = prior * s[:n_positive] / n_positive
        g[n_positive:] = -s[n_positive:] / n_unlabelled
    return float(negative), g


def nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 30, batch: int = 1024,
         rate: float = 0.05, decay: float = 1e-3, min_docs: int = 4, z_score: float = 5.0, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Features used, their weights and the bias of a linear model with the logistic loss, by Adam."""
    # copies would make the words of one text look like a habit of many
    positive, unlabelled = ([x for _, x in sorted({r.tobytes(): r for r in side}.items())] for side in (positive, unlabelled))
    rows = positive + unlabelled
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    n_p, n_u = len(positive), len(unlabelled)
    in_p = np.bincount(flat[:lengths[:n_p].sum()], minlength=DIMS)
    in_u = np.bincount(flat[lengths[:n_p].sum():], minlength=DIMS)
    both = (in_p + in_u) / max(len(rows), 1)
    apart = np.abs(in_p / max(n_p, 1) - in_u / max(n_u, 1)) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / max(n_p, 1) + 1 / max(n_u, 1)))
    used = np.flatnonzero((in_p + in_u >= min_docs) & (apart > z_score))  # rates that differ beyond chance
    code = np.full(DIMS, -1, np.int32)
    code[used] = np.arange(len(used))
    rows = np.split(code[flat], np.cumsum(lengths)[:-1]) if rows else []
    rows = [r[r >= 0] for r in rows]
    w = np.zeros(len(used) + 1)  # the last weight is the bias
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    rng = np.random.default_rng(seed)
    rounds = max(1, -(-n_u // batch))
    for _ in range(epochs):
        u_order = rng.permutation(n_u) + n_p
        for k in range(rounds):
            u = u_order[k * batch:(k + 1) * batch]
            p = rng.integers(0, n_p, max(1, min(batch, n_p)))
            pick = np.concatenate([p, u])
            at = np.concatenate([rows[x] for x in pick])
            who = np.repeat(np.arange(len(pick)), [len(rows[x]) for x in pick])
            z = np.bincount(who, w[at], len(pick)) + w[-1]
            _, g = slopes(z, len(p), prior)
            grad = np.bincount(at, g[who], len(w)) + decay * w
            grad[-1] = g.sum()
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w = w - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return used, w[:-1].astype(np.float32), float(w[-1])


def _fit_rows(prior: float):
    """Feature (-1: the bias) and weight, from the sample's rows."""
    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by([("positive", "ascending"), ("doc_id", "ascending"), ("feats", "ascending")])
        sides: dict[bool, list] = {True: [], False: []}
        for yes, raw in zip(t.column("positive").to_pylist(), t.column("feats").to_pylist()):
            sides[yes].append(np.frombuffer(raw, "<u4"))
        at, w, bias = nnpu(sides[True], sides[False], prior) if sides[True] and sides[False] else (np.zeros(0, np.int64), np.zeros(0), None)
        return pa.table([pa.array(np.append(at, -1) if bias is not None else at, pa.int32()),
                         pa.array(np.append(w, bias) if bias is not None else w, pa.float64())], ["feature", "weight"])
    return run


def train(docs: DataFrame, positives: DataFrame, prior: float, max_positive: int = 3000, max_unlabelled: int = 6000):
    """Fit on texts of ``positives`` (doc_id) and of unlabelled documents; both samples bounded. None without positives.

    The sample is one group, fitted in one task; its non-zero weights (at most ``DIMS``) come back.
    """
    pos = by_hash(positives.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", max_positive, 1)
    unl = by_hash(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", max_unlabelled, 2)
    ids = pos.withColumn("positive", F.lit(True)).unionByName(unl.withColumn("positive", F.lit(False)))
    rows = feature_rows(texts_of(docs, ids)).groupBy(F.lit(0).alias("_sample")).applyInArrow(_fit_rows(prior), "feature int, weight double")
    got = sorted(map(tuple, rows.collect()))
    if not got:
        return None
    at, w = (np.array(x) for x in zip(*got))
    return at[1:].astype(np.int64), w[1:].astype(np.float32), float(w[0])  # the bias is feature -1


def _dense(model):
    """Weights over ``DIMS`` and bias, of one task."""
    if model is None:
        return None
    at, weight, bias = model
    w = np.zeros(DIMS, np.float32)
    w[at] = weight
    return w, bias


def _scores(column: pa.Array, model):
    """Yield (first row, end row, score) over runs of rows."""
    data, offsets = as_bytes(column)
    for i, j, raw, off in chunks(data, offsets, CHUNK):
        if model is None:
            yield i, j, np.zeros(j - i)
            continue
        w, bias = model
        doc, feat = features(raw, off)
        live = w[feat] != 0
        key = np.unique(doc[live] * DIMS + feat[live])
        z = np.bincount(key // DIMS, w[key % DIMS], j - i) + bias
        yield i, j, 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model) -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    def run(batches):
        dense = _dense(model)
        for b in batches:
            for i, j, p in _scores(b.column("text"), dense):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(p, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def below(docs: DataFrame, model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, all columns as they are."""
    place = docs.columns.index("text")

    def run(batches):
        dense = _dense(model)
        for b in batches:
            for i, j, p in _scores(b.column(place), dense):
                yield b.slice(i, j - i).filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)


def class_prior(labels: DataFrame, label: str = "toxic") -> float:
    """Share of positives among the labelled rows (all of them), kept within 0.01 .. 0.5."""
    share = labels.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return min(0.5, max(0.01, share or 0.0))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2):
    """Model from the rows of ``labels`` outside the held-out fold; None without a positive example."""
    known = labels.where((fold(F.col("doc_id"), folds) != held_out) & F.col("toxic").isNotNull())
    return train(docs, known.where("toxic = 1"), class_prior(known))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return score(docs, fit(docs, labels, folds, held_out)).select(
        "doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """The documents that score under ``threshold``."""
    return below(docs, fit(docs, labels, folds, held_out), threshold)
