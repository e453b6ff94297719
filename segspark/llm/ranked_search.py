"""Operator 11: ranked lexical search with per-term geometric blocking.

Documents are scored for a set of queries by whole-number term weights. What a
document holds of the queries' terms is its vector. Documents are dealt to
shards of at most ``SHARD`` around representatives of a bounded sample (nearest
by cosine of a random projection), so a shard's documents are alike; a group
above that size is cut by hash.

In a shard every term has a posting list. A list is clustered by the similarity
of its documents (farthest-first heads) into blocks of about ``BLOCK``, and each block stores the
coordinatewise maximum of its documents' vectors (the coordinates that some
query asks together with the term; no other enters a bound). For a query:

* the lists with the smallest maxima whose sum stays under the score to beat
  are not opened: a document of those alone cannot reach it;
* of the lists that are opened, a block is skipped when the query's product
  with its summary, an exact whole number, stays under the score to beat;
* documents of the blocks that are left are scored from their vectors.

The score to beat starts as the k-th best over all tasks of a first pass that
scores the documents holding a query's rarest terms, and rises in the shard.
Ties are kept, so the result is that of scoring everything.

Texts are read once for each lot of queries (``LOT_TERMS`` terms, which bounds
what is broadcast and collected) into vectors written to the shared folder;
counts cover all documents; a shard is one task's group; at most k rows a query
leave it. A list that a third of all documents share is cut by the shards.

Cases: null texts and texts without terms are not counted and never found; a
query without terms, or whose terms stand nowhere, has no rows; queries of one
id and text are one; null ``doc_id`` rows come after all others of their score,
repeated ones are documents of their own; texts of any length count whole; an
empty table on either side gives no rows; other columns are ignored. Terms are
told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segspark.llm.sampling import by_hash
from segspark.llm.shared import materialise
from segspark.llm.textbytes import ALNUM, LOWER, as_bytes, chunks, prefix_hash, ragged, range_hash, spans

SHARD, BLOCK = 4096, 32
REPRESENTATIVES, WIDTH = 1024, 24
LOT_TERMS = 200_000
SEED_TERMS = 3
NULL_ID = np.iinfo(np.int64).max


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every term, first term of each text): runs of letters, digits and non-ASCII, A-Z in lower case."""
    data = LOWER[data]
    s, e, first = spans(data, offsets, ALNUM)
    return range_hash(prefix_hash(data), s, e), first


class Queries:
    """One lot of queries: term numbers and multiplicities of each, and the terms asked together with each term."""

    def __init__(self, terms: list[np.ndarray]) -> None:
        self.vocabulary = np.unique(np.concatenate(terms)) if terms else np.zeros(0, np.uint64)
        self.terms, self.times = [], []
        for t in terms:
            own, times = np.unique(np.searchsorted(self.vocabulary, t), return_counts=True)
            self.terms.append(own)
            self.times.append(times.astype(np.int64))
        owner = np.concatenate([np.repeat(t, len(t)) for t in self.terms]) if terms else np.zeros(0, np.int64)
        other = np.concatenate([np.tile(t, len(t)) for t in self.terms]) if terms else np.zeros(0, np.int64)
        n = len(self.vocabulary)
        pairs = np.unique(owner * n + other)
        self.co_first = np.searchsorted(pairs, np.arange(n + 1) * n)
        self.co_terms = pairs % n if n else pairs

    def together(self, t: int) -> np.ndarray:
        return self.co_terms[self.co_first[t]:self.co_first[t + 1]]


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)


def gains(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def length_part(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    return 25 + 75 * n.astype(np.int64) * docs // total


def _vector_rows(shared):
    """doc_id, n, terms and their counts of every text with terms."""
    def run(batches):
        vocabulary = shared.value.vocabulary
        v = len(vocabulary)
        for b in batches:
            data, offsets = as_bytes(b.column(1))
            for i, j, raw, off in chunks(data, offsets):
                h, first = term_hashes(raw, off)
                doc = np.repeat(np.arange(j - i), np.diff(first))
                at = np.minimum(np.searchsorted(vocabulary, h), max(v - 1, 0))
                known = vocabulary[at] == h if v else np.zeros(len(h), bool)
                key, tf = np.unique(doc[known] * max(v, 1) + at[known], return_counts=True)
                edge = np.searchsorted(key, np.arange(j - i + 1) * max(v, 1))
                term = (key % max(v, 1)).astype("<i4")
                tf = tf.astype("<i4")
                n = np.diff(first)
                keep = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i).take(pa.array(keep)).cast(pa.int64()), pa.array(n[keep], pa.int64()),
                     *(pa.array([x[edge[k]:edge[k + 1]].tobytes() for k in keep], pa.binary()) for x in (term, tf))],
                    ["doc_id", "n", "terms", "tf"])
    return run


VECTORS = "doc_id long, n long, terms binary, tf binary"


class Vectors:
    """Documents of an Arrow table: ids, and rows of (term, count)."""

    def __init__(self, table) -> None:
        ids = table.column("doc_id")
        self.null = np.asarray(ids.is_null())
        self.ids = ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False) if isinstance(ids, pa.Array) else ids.combine_chunks().fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        self.n = table.column("n").to_numpy()
        raw, offsets = as_bytes(table.column("terms"))
        self.terms, self.first = raw.view("<i4"), offsets // 4
        self.tf = as_bytes(table.column("tf"))[0].view("<i4").astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))


def _document_counts(shared):
    """Documents with each term; under -1 the documents, under -2 all their terms."""
    def run(batches):
        v = len(shared.value.vocabulary)
        df, docs, total = np.zeros(v, np.int64), 0, 0
        for b in batches:
            x = Vectors(b)
            df += np.bincount(x.terms, minlength=v)
            docs, total = docs + len(x.n), total + int(x.n.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": np.concatenate([at, [-1, -2]]), "n": np.concatenate([df[at], [docs, total]])})
    return run


def projection(v: int) -> np.ndarray:
    return np.random.default_rng(17).standard_normal((v, WIDTH)).astype(np.float32)


def sketches(x: Vectors, gain: np.ndarray, weight: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit random projections of the documents' weighted vectors."""
    out = np.zeros((len(x.ids), WIDTH), np.float64)
    some = np.flatnonzero(np.diff(x.first))
    if len(some):
        parts = axes[x.terms] * (gain * weight[x.terms]).astype(np.float32)[:, None]
        out[some] = np.add.reduceat(parts, x.first[:-1][some], axis=0)
    return (out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float32)


def clusters(x: np.ndarray, most: int) -> np.ndarray:
    """Nearest of at most ``most`` farthest-first heads of every unit vector."""
    near, cluster = x @ x[0], np.zeros(len(x), np.int64)
    for c in range(1, most):
        far = int(near.argmin())
        if near[far] > 1 - 1e-5:
            break
        dot = x @ x[far]
        closer = dot > near
        cluster[closer], near[closer] = c, dot[closer]
    return cluster


class Shard:
    """Posting lists of a shard's documents, blocked when a query first opens them."""

    def __init__(self, x: Vectors, queries: Queries, weight: np.ndarray, gain: np.ndarray, sketch: np.ndarray) -> None:
        self.x, self.queries, self.weight, self.gain, self.sketch = x, queries, weight, gain, sketch
        order = np.argsort(x.terms, kind="stable")
        self.post_doc = x.doc[order]
        self.post_first = np.searchsorted(x.terms[order], np.arange(len(weight) + 1))
        self.largest = np.zeros(len(weight), np.int64)
        some = np.flatnonzero(np.diff(self.post_first))
        if len(some):
            self.largest[some] = np.maximum.reduceat(gain[order], self.post_first[:-1][some])
        self.lists: dict[int, tuple] = {}
        self.column = np.full(len(weight), -1, np.int64)
        self.query_weight = np.zeros(len(weight), np.int64)
        self.opened = self.skipped = 0

    def blocks(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(documents in block order, first of each block, summaries, the terms of their columns) of a list."""
        if t not in self.lists:
            docs = self.post_doc[self.post_first[t]:self.post_first[t + 1]]
            count = -(-len(docs) // BLOCK)
            if count > 1:
                cluster = clusters(self.sketch[docs], count)
                order = np.argsort(cluster, kind="stable")
                docs = docs[order]
                first = np.flatnonzero(np.concatenate([[True], np.diff(cluster[order]) > 0]))
            else:
                first = np.zeros(1, np.int64)
            terms = self.queries.together(t)
            self.column[terms] = np.arange(len(terms))
            size = np.diff(self.x.first)[docs]
            at = ragged(self.x.first[docs], size)
            column = self.column[self.x.terms[at]]
            block = np.repeat(np.repeat(np.arange(len(first)), np.diff(np.append(first, len(docs)))), size)
            own = column >= 0
            summary = np.zeros(len(first) * len(terms), np.int64)
            np.maximum.at(summary, block[own] * len(terms) + column[own], self.gain[at[own]])
            self.column[terms] = -1
            self.lists[t] = docs, first, summary.reshape(len(first), len(terms)).astype(np.int32), terms
        return self.lists[t]

    def scores(self, docs: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Whole scores of documents for a query's terms."""
        self.query_weight[terms] = weight
        size = np.diff(self.x.first)[docs]
        at = ragged(self.x.first[docs], size)
        part = np.concatenate([[0], np.cumsum(self.query_weight[self.x.terms[at]] * self.gain[at])])
        end = np.cumsum(size)
        self.query_weight[terms] = 0
        return part[end] - part[end - size]

    def search(self, q: int, k: int, beat: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the first ``k`` documents of at least ``beat`` by score, then id."""
        terms = self.queries.terms[q]
        weight = self.queries.times[q] * self.weight[terms]
        most = self.largest[terms] * weight
        order = np.argsort(most, kind="stable")
        closed = np.cumsum(most[order]) < beat
        seen = np.zeros(len(self.x.ids), bool)
        docs, got = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for t in terms[order[~closed]][::-1]:
            if self.largest[t] == 0:
                continue
            members, first, summary, columns = self.blocks(int(t))
            bound = summary[:, np.searchsorted(columns, terms)].astype(np.int64) @ weight
            live = bound >= beat
            self.opened, self.skipped = self.opened + int(live.sum()), self.skipped + int((~live).sum())
            new = members[np.repeat(live, np.diff(np.append(first, len(members))))]
            new = new[~seen[new]]
            if not len(new):
                continue
            seen[new] = True
            s = self.scores(new, terms, weight)
            fit = s >= beat
            docs, got = np.concatenate([docs, new[fit]]), np.concatenate([got, s[fit]])
            if len(docs) > k:
                keep = np.lexsort((self.x.ids[docs], self.x.null[docs], -got))[:k]
                docs, got = docs[keep], got[keep]
            if len(docs) == k:
                beat = max(beat, int(got.min()))
        return docs, got


def _seeds(shared, k: int):
    """The ``k`` best scores, for each query, among a task's documents that hold one of its rarest terms."""
    def run(batches):
        queries, weight, docs, total, _ = shared.value
        best = np.zeros((len(queries.terms), k), np.int64)
        for b in batches:
            x = Vectors(b)
            gain = gains(x.tf, length_part(x.n, docs, total)[x.doc])
            shard = Shard(x, queries, weight, gain, np.zeros((len(x.ids), 0), np.float32))
            for q, terms in enumerate(queries.terms):
                own = weight[terms]
                rare = terms[np.argsort(-own, kind="stable")][:SEED_TERMS]
                found = [shard.post_doc[shard.post_first[t]:shard.post_first[t + 1]] for t in rare]
                found = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
                if len(found):
                    s = np.concatenate([best[q], shard.scores(found, terms, queries.times[q] * own)])
                    best[q] = np.sort(s)[::-1][:k]
        q, c = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(best[q, c])], ["query", "score"])
    return run


def _nearest(shared, shared_heads):
    """Number of the nearest representative of every document."""
    def run(batches):
        queries, weight, docs, total, axes = shared.value
        heads = shared_heads.value
        for b in batches:
            x = Vectors(b)
            sketch = sketches(x, gains(x.tf, length_part(x.n, docs, total)[x.doc]), weight, axes)
            group = (sketch @ heads.T).argmax(axis=1) if len(heads) else np.zeros(len(x.ids), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(group.astype(np.int32))], [*b.schema.names, "grp"])
    return run


def _search(shared, shared_beat, k: int):
    def run(table: pa.Table) -> pa.Table:
        queries, weight, docs, total, axes = shared.value
        beat = shared_beat.value
        x = Vectors(table)
        gain = gains(x.tf, length_part(x.n, docs, total)[x.doc])
        shard = Shard(x, queries, weight, gain, sketches(x, gain, weight, axes))
        out: list = [[], [], []]
        for q in range(len(queries.terms)):
            found, score = shard.search(q, k, int(beat[q]))
            for col, part in zip(out, (np.full(len(found), q), found, score)):
                col.append(part)
        query, found, score = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
        return pa.table([pa.array(query.astype(np.int32)), pa.array(x.ids[found], pa.int64(), mask=x.null[found]), pa.array(score, pa.int64())],
                        ["query", "doc_id", "score"])
    return run


def _lot(docs: DataFrame, items: list, k: int) -> DataFrame:
    """Results of one lot of queries (rows item, text): item, doc_id, score of at most ``k`` documents each, unranked across shards."""
    spark = docs.sparkSession
    texts = pa.array([r["text"] for r in items], pa.string())
    h, first = term_hashes(*as_bytes(texts))
    queries = Queries([h[a:b] for a, b in zip(first[:-1], first[1:])])
    made = [spark.sparkContext.broadcast(queries)]  # about LOT_TERMS terms
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_vector_rows(made[0]), VECTORS), "vectors")
    counts = rows.mapInArrow(_document_counts(made[0]), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df, n, total = np.zeros(len(queries.vocabulary), np.int64), 0, 0
    for r in counts.collect():  # a row a term of the lot
        if r["term"] >= 0:
            df[r["term"]] = r["n"]
        elif r["term"] == -1:
            n = r["n"]
        else:
            total = r["n"]
    schema = "query int, doc_id long, score long"
    if not n or not len(queries.vocabulary):
        return spark.createDataFrame([], schema)
    weight = weights(df, n)
    made.append(spark.sparkContext.broadcast((queries, weight, n, total, projection(len(weight)))))
    seeds = rows.mapInArrow(_seeds(made[1], k), "query int, score long")
    kth = (seeds.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("_n") == k)
           .select("query", "score").collect())  # a row a query
    beat = np.ones(len(items), np.int64)
    for r in kth:
        beat[r["query"]] = max(1, r["score"])
    made.append(spark.sparkContext.broadcast(beat))
    # representatives: at most REPRESENTATIVES documents of the table, by hash
    sample = by_hash(rows.where(F.octet_length("terms") > 0).withColumn("_h", F.xxhash64("doc_id", "terms", "tf")), "_h",
                     min(REPRESENTATIVES, -(-n // SHARD)), 3).drop("_h").toArrow()
    x = Vectors(sample)
    heads = sketches(x, gains(x.tf, length_part(x.n, n, total)[x.doc]), weight, projection(len(weight)))
    made.append(spark.sparkContext.broadcast(heads))
    near = rows.where(F.octet_length("terms") > 0).mapInArrow(_nearest(made[1], made[3]), f"{VECTORS}, grp int")
    sizes = {r["grp"]: r["n"] for r in near.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a representative
    pieces = F.get(F.array(*[F.lit(-(-sizes.get(g, 0) // SHARD)) for g in range(max(1, len(heads)))]), F.col("grp"))
    dealt = near.withColumn("piece", F.pmod(F.xxhash64("doc_id", "n", "terms", "tf", F.monotonically_increasing_id()), pieces))
    found = materialise(dealt.groupBy("grp", "piece").applyInArrow(_search(made[1], made[2], k), schema), "found")
    for b in made:
        b.destroy()
    return found


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of the first ``k`` documents (doc_id, text) of every item (item_id, text)."""
    if k < 1:
        raise ValueError("k must be positive")
    spark = docs.sparkSession
    asked = materialise(items.select("item_id", "text").where("text IS NOT NULL").distinct()
                        .withColumn("_item", F.monotonically_increasing_id()), "items")
    # every term but the first follows a separator of at least one byte
    terms = asked.agg(F.sum((F.octet_length("text") / 2).cast("long") + 1)).first()[0] or 0
    lots = max(1, -(-terms // LOT_TERMS))
    out = None
    for lot in range(lots if terms else 0):
        rows = asked.where(F.pmod(F.xxhash64("_item"), F.lit(lots)) == lot).select("_item", "text").orderBy("_item").collect()
        if rows:
            names = spark.createDataFrame([(i, r["_item"]) for i, r in enumerate(rows)], "query int, _item long")
            found = _lot(docs, rows, k).join(names, "query").drop("query")
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "doc_id long, score long, _item long")
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("_item", "item_id"), "_item").select("item_id", "rank", "doc_id", "score")
