"""Operator 1: similarity join of n-gram sets with PartEnum signatures.

Two sets link when their Jaccard similarity is at least ``percent`` / 100. Set
sizes fall in bands ``[l, floor(l * 100 / percent)]``; linked sets lie in one
band or in two neighbouring ones, so a set is signed for its own band and for
the next. In a band with largest size r, linked sets differ in at most
``k = floor(2 r (100 - percent) / (100 + percent))`` elements. The feature
domain is cut by hash into ``n1 = ceil((k + 1) / (K2 + 1))`` parts, one of which
has at most ``K2`` differences, and each part into ``N2`` smaller ones, of which
``N2 - K2`` then have none: the elements in each choice of ``N2 - K2`` smaller
parts make a signature, and linked sets share one for certain.

Signatures with at most one element say little; documents that only share such
a signature are compared by 64 counts of their elements (differences of counts
bound the sets' difference from below) before they become candidates.

Equal sets are one class from the start. Candidates are joined into clusters
(spanning edges, never pairs), a cluster is cut into chunks and every two
chunks meet in a task of their own, twice: first with a count sketch of each
set, a byte for about every ``PER_COUNT`` elements, whose distance is a lower
bound of the sets' difference and breaks up clusters that long texts chain
together; then, for what still hangs together, with exact intersections. Only
spanning edges leave a task. Words are compared by 64-bit hashes.

The sketches come from the first pass over the texts, so only the last step moves
texts: those of the documents still in question, told from the others before the
shuffle by a Bloom filter of at most ``BLOOM_BITS`` bits.

Cases: texts without words (null, empty, white space) have no elements and link
with nothing; rows of one text are one class however often they come; rows of
one id with different texts belong to the class of their own text each; null
``doc_id`` rows belong to their class, whose id is the smallest one that is not
null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.llm.components import components
from segspark.llm.shared import materialise, shuffle_partitions, unused
from segspark.llm.textbytes import U, as_bytes, chunks, mix64, ragged, shingle_hashes

K2, N2 = 1, 3
HIST = 64
PER_COUNT = 8
CHUNK_SETS, CHUNK_ELEMENTS = 1024, 2_000_000
BUCKET_ELEMENTS = 400_000
BLOOM_BITS = 1 << 26


def sets_of(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every document, ascending inside it: (elements, first per document)."""
    h, first = shingle_hashes(data, offsets, n)
    parts = [np.unique(h[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else h), np.concatenate([[0], np.cumsum(sizes)])


def set_keys(elements: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of each set."""
    out = []
    for salt in (U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(elements ^ salt), dtype=np.uint64)])
        out.append(mix64(total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out[0], out[1]


def bands(largest: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest size of each band, up to the band after the one holding ``largest``."""
    low, high = [], []
    at = 1
    while not high or (len(high) < 2 or high[-2] < largest):
        low.append(at)
        high.append(at * 100 // percent)
        at = high[-1] + 1
    return np.array(low), np.array(high)


def differences(size: np.ndarray, percent: int) -> np.ndarray:
    """Most elements in which two linked sets of at most ``size`` elements differ."""
    return 2 * size * (100 - percent) // (100 + percent)


def signatures(elements: np.ndarray, first: np.ndarray, percent: int):
    """(signature, set number, elements in it) of all sets."""
    sizes = np.diff(first)
    low, high = bands(int(sizes.max(initial=1)), percent)
    band = np.searchsorted(high, sizes)
    choices = list(combinations(range(N2), N2 - K2))
    out_sig, out_set, out_n = [], [], []
    mixed = mix64(elements + U(0x2545F4914F6CDD1D))
    for step in (0, 1):
        inst = np.minimum(band + step, len(high) - 1)
        k = differences(high[inst], percent)
        n1 = np.where((sizes > 0) & (k > 0), -(-(k + 1) // (K2 + 1)), 0)  # k = 0: only equal sets link
        if not n1.any():
            continue
        cells = n1 * N2
        base = np.cumsum(cells) - cells
        live = np.repeat(n1 > 0, sizes)
        who = np.repeat(np.arange(len(sizes)), sizes)[live]
        f = elements[live]
        p1 = ((f >> U(32)) * n1[who].astype(np.uint64)) >> U(32)
        p2 = ((f & U(0xFFFFFFFF)) * U(N2)) >> U(32)
        cell = base[who] + (p1 * U(N2) + p2).astype(np.int64)
        total = np.zeros(int(cells.sum()), np.uint64)
        np.add.at(total, cell, mixed[live])
        count = np.bincount(cell, minlength=len(total)).reshape(-1, N2)
        total = total.reshape(-1, N2)
        owner = np.repeat(np.arange(len(sizes)), n1)
        part = ragged(np.zeros(len(n1), np.int64), n1)
        place = mix64((inst[owner].astype(np.uint64) << U(40)) | (part.astype(np.uint64) << U(8)))
        for c, choice in enumerate(choices):
            s = total[:, choice].sum(axis=1, dtype=np.uint64)
            out_sig.append(mix64(s + mix64(place + U(c))))
            out_set.append(owner)
            out_n.append(count[:, choice].sum(axis=1))
    if not out_sig:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_sig), np.concatenate(out_set), np.concatenate(out_n)


def histograms(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """sets x HIST element counts, held at 255."""
    sizes = np.diff(first)
    who = np.repeat(np.arange(len(sizes)), sizes)
    at = who * HIST + (mix64(elements ^ U(0x1D8E4E27C47D124F)) >> U(58)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=len(sizes) * HIST), 255).astype(np.uint8).reshape(-1, HIST)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of 0 .. n - 1 by the links (a, b)."""
    root = np.arange(n)
    while len(a):
        new = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return root


def _set_rows(n: int):
    def run(batches):
        for b in batches:
            data, offsets = as_bytes(b.column("text"))
            for i, j, raw, off in chunks(data, offsets):
                el, first = sets_of(raw, off, n)
                k1, k2 = set_keys(el, first)
                sketches = [sketch(el[a:z]).tobytes() if z > a else b"" for a, z in zip(first[:-1].tolist(), first[1:].tolist())]
                cols = [b.column("doc_id").slice(i, j - i).cast(pa.int64()), pa.array(np.diff(first)), pa.array(k1), pa.array(k2),
                        b.column("h").slice(i, j - i), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "k1", "k2", "h", "sketch"])
    return run


SET_ROWS = "doc_id long, n long, k1 long, k2 long, h long, sketch binary"


def _signature_rows(n: int, percent: int, buckets: int):
    def run(batches):
        for b in batches:
            data, offsets = as_bytes(b.column("text"))
            for i, j, raw, off in chunks(data, offsets):
                el, first = sets_of(raw, off, n)
                k1, _ = set_keys(el, first)
                one = np.unique(k1, return_index=True)[1]  # copies inside the chunk sign once
                size = np.diff(first)[one]
                el = el[ragged(first[:-1][one], size)]
                first = np.concatenate([[0], np.cumsum(size)])
                sig, who, count = signatures(el, first, percent)
                key = k1[one][who]
                hist = histograms(el, first)
                bucket = (sig % U(buckets)).astype(np.int32)
                weak = count <= 1
                cols: list = [[] for _ in range(6)]
                order = np.argsort(bucket, kind="stable")
                edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(edge)):
                    at = order[edge[k]:edge[k + 1]]
                    s, w = at[~weak[at]], at[weak[at]]
                    for col, x in zip(cols, (k, sig[s].view(np.int64), key[s], sig[w].view(np.int64), key[w], hist[who[w]].tobytes())):
                        col.append(x)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int32()), *(pa.array(c, pa.list_(pa.int64())) for c in cols[1:5]), pa.array(cols[5], pa.binary())],
                        ["bucket", "sig", "key", "weak_sig", "weak_key", "hist"])
    return run


SIGNATURE_ROWS = "bucket int, sig array<long>, key array<long>, weak_sig array<long>, weak_key array<long>, hist binary"


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks]) if column.num_chunks else np.zeros(0, np.int64)


def _runs(sig: np.ndarray, key: np.ndarray):
    """Distinct (sig, key) in order, and the run each belongs to, of runs of more than one key."""
    order = np.lexsort((key, sig))
    s, k = sig[order], key[order]
    new_s = np.ones(len(s), bool)
    new_s[1:] = s[1:] != s[:-1]
    fresh = new_s.copy()
    fresh[1:] |= k[1:] != k[:-1]
    at = order[fresh]
    run = np.cumsum(new_s[fresh]) - 1
    many = np.bincount(run)[run] > 1 if len(run) else np.zeros(0, bool)
    return at[many], run[many]


def _candidates(percent: int):
    """Spanning edges of the keys that share a signature in a bucket."""
    def run(table: pa.Table) -> pa.Table:
        a, b = [], []
        key = _flat(table.column("key"))
        at, run_of = _runs(_flat(table.column("sig")), key)
        if len(at):
            lead = at[np.concatenate([[True], run_of[1:] != run_of[:-1]])]
            a.append(key[lead][np.unique(run_of, return_inverse=True)[1]])
            b.append(key[at])
        weak_key = _flat(table.column("weak_key"))
        at, run_of = _runs(_flat(table.column("weak_sig")), weak_key)
        if len(at):
            hist = np.frombuffer(b"".join(x.as_py() for x in table.column("hist")), np.uint8).reshape(-1, HIST)
            cut = np.flatnonzero(np.diff(run_of)) + 1
            for g in np.split(at, cut):
                h = hist[g].astype(np.int16)
                size = h.sum(axis=1, dtype=np.int64)
                full = (h == 255).any(axis=1)
                step = max(1, (1 << 16) // len(g))
                joined = np.arange(len(g))
                for x in range(0, len(g), step):
                    gap = np.abs(h[x:x + step, None, :] - h[None, :, :]).sum(axis=2, dtype=np.int64)
                    most = (size[x:x + step, None] + size[None, :]) * (100 - percent) // (100 + percent)
                    # a held count hides elements: such pairs stay candidates
                    i, j = np.nonzero((gap <= most) | full[x:x + step, None] | full[None, :])
                    i = i + x
                    up = i < j
                    joined = roots(len(g), np.concatenate([joined, i[up]]), np.concatenate([np.arange(len(g)), j[up]]))
                a.append(weak_key[g[joined]])
                b.append(weak_key[g])
        if not a:
            return pa.table([pa.array([], pa.int64())] * 2, ["a", "b"])
        a, b = np.concatenate(a), np.concatenate(b)
        nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = roots(len(nodes), back[:len(a)], back[len(a):])
        own = root != np.arange(len(nodes))
        return pa.table([pa.array(nodes[root[own]]), pa.array(nodes[own])], ["a", "b"])
    return run


def links_between(sets: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (i, j) among sets of which at least one has side 3 or whose sides differ."""
    size = np.array([len(s) for s in sets], np.int64)
    m = len(sets)
    inter = np.zeros((m, m), np.float32)
    if m == 2:
        inter[0, 1] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        who = np.repeat(np.arange(m, dtype=np.int32), size)[order]
        same = flat[1:] == flat[:-1]
        keep = np.zeros(len(flat), bool)  # elements of more than one set
        keep[1:] = same
        keep[:-1] |= same
        col, who = flat[keep], who[keep]
        col = np.cumsum(np.concatenate([[0], (col[1:] != col[:-1]).astype(np.int64)])) if len(col) else col
        wide = max(64, min(4096, (8 << 20) // m))
        for x in range(0, int(col[-1]) + 1 if len(col) else 0, wide):
            a, b = np.searchsorted(col, [x, x + wide])
            block = np.zeros((m, wide), np.float32)
            block[who[a:b], col[a:b] - x] = 1
            inter += block @ block.T
    inter = np.rint(inter).astype(np.int64)
    linked = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
    linked &= (size > 0)[:, None] & (size > 0)[None, :]
    linked &= (side[:, None] == 3) | (side[None, :] == 3) | (side[:, None] != side[None, :])
    return np.nonzero(np.triu(linked, 1))


def sketch_width(size: int) -> int:
    """Counters of a set's sketch: a power of two."""
    return max(HIST, 1 << max(0, (size // PER_COUNT - 1).bit_length()))


def sketch(elements: np.ndarray) -> np.ndarray:
    """Element counts by the leading bits of a hash, held at 255. Adding neighbours gives the sketch of half the width."""
    width = sketch_width(len(elements))
    at = (mix64(elements ^ U(0x1D8E4E27C47D124F)) >> U(65 - width.bit_length())).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=width), 255).astype(np.uint8)


def _folded(sketches: list[np.ndarray], width: int) -> np.ndarray:
    """The sketches at ``width`` counters, one row each."""
    out = np.empty((len(sketches), width), np.int16)
    for k, s in enumerate(sketches):
        out[k] = s if len(s) == width else np.minimum(s.reshape(width, -1).sum(axis=1, dtype=np.int64), 255)
    return out


def sketch_edges(sketches: list[np.ndarray], size: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Smallest index reachable by pairs whose sketches allow a link. Held counts only make distances smaller."""
    order = np.argsort(size, kind="stable")
    size, side = size[order], side[order]
    m, joined = len(size), np.arange(len(size))
    x = 0
    while x < m:
        width = len(sketches[order[x]])
        z = min(m, x + 32)
        end = int(np.searchsorted(size, size[z - 1] * 100 // percent, "right"))  # larger sets differ too much in size
        mine = _folded([sketches[k] for k in order[x:z]], width)
        step = max(1, (2 << 20) // (32 * width))
        for y in range(x, end, step):
            other = _folded([sketches[k] for k in order[y:min(end, y + step)]], width)
            gap = np.abs(mine[:, None, :] - other[None, :, :]).sum(axis=2, dtype=np.int64)
            most = (size[x:z, None] + size[None, y:y + len(other)]) * (100 - percent) // (100 + percent)
            meet = (side[x:z, None] == 3) | (side[None, y:y + len(other)] == 3) | (side[x:z, None] != side[None, y:y + len(other)])
            i, j = np.nonzero((gap <= most) & meet)
            i, j = i + x, j + y
            up = (i < j) & (joined[i] != joined[j])
            if up.any():
                joined = roots(m, np.concatenate([joined, i[up]]), np.concatenate([np.arange(m), j[up]]))
        x = z
    out = np.empty(m, np.int64)
    out[order] = order[joined]
    return out


def _sketched(percent: int):
    """Spanning edges of the members whose sketches allow a link, of the units (cluster, i, j) of one task."""
    def run(table: pa.Table) -> pa.Table:
        a, b = [], []
        for t, g in _units(table):
            sketches = [np.frombuffer(t.column("elements")[int(k)].as_py(), np.uint8) for k in g]
            root = sketch_edges(sketches, t.column("n").to_numpy()[g], t.column("side").to_numpy()[g], percent)
            own = np.flatnonzero(root != np.arange(len(g)))
            rep = t.column("rep").to_numpy()[g]
            a.append(rep[root[own]])
            b.append(rep[own])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def _units(table: pa.Table):
    """(table, row numbers by rep) of every unit (cluster, i, j) of more than one rep; repeated rows of a rep count once."""
    if not table.num_rows:
        return
    t = table.combine_chunks()
    unit = np.stack([t.column(c).to_numpy() for c in ("cluster", "i", "j")])
    rep = t.column("rep").to_numpy()
    order = np.lexsort((rep, *unit[::-1]))
    again = np.zeros(len(order), bool)
    again[1:] = np.all(np.diff(unit[:, order], axis=1) == 0, axis=0) & (np.diff(rep[order]) == 0)
    order = order[~again]
    cut = np.flatnonzero(np.any(np.diff(unit[:, order], axis=1) != 0, axis=0)) + 1
    for g in np.split(order, cut):
        if len(g) > 1:
            yield t, g


def _verified(percent: int):
    def run(table: pa.Table) -> pa.Table:
        a, b = [], []
        for t, g in _units(table):
            sets = [np.frombuffer(t.column("elements")[int(k)].as_py(), np.uint64) for k in g]
            i, j = links_between(sets, t.column("side").to_numpy()[g], percent)
            root = roots(len(g), i, j)
            own = np.flatnonzero(root != np.arange(len(g)))
            rep = t.column("rep").to_numpy()[g]
            a.append(rep[root[own]])
            b.append(rep[own])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def _element_rows(n: int):
    """Sets of the representatives' texts; of rows with one id, those whose set is the class's."""
    def run(batches):
        for b in batches:
            data, offsets = as_bytes(b.column("text"))
            for i, j, raw, off in chunks(data, offsets):
                el, first = sets_of(raw, off, n)
                k1, k2 = set_keys(el, first)
                part = b.slice(i, j - i)
                same = np.flatnonzero((k1 == part.column("k1").to_numpy()) & (k2 == part.column("k2").to_numpy()))
                take = pa.array(same)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(take) for c in ("rep", "cluster", "chunks", "n")),
                     pa.array([el[first[k]:first[k + 1]].tobytes() for k in same], pa.binary())],
                    ["rep", "cluster", "chunks", "n", "elements"])
    return run


def _bloom_places(column: str, bits: int) -> list:
    return [F.pmod(F.xxhash64(F.lit(k), column), F.lit(bits)) for k in range(3)]


def _possibly_in(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) whose id is one of ``ids`` (doc_id), and few others."""
    bits = min(BLOOM_BITS, max(1 << 12, 1 << (16 * ids.count()).bit_length()))
    words = ids.select(F.explode(F.array(*_bloom_places("doc_id", bits))).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()  # at most BLOOM_BITS / 64 rows
    table = np.zeros(bits // 64, np.uint64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for c in ("p0", "p1", "p2"):
                p = b.column(c).to_numpy().astype(np.uint64)
                keep &= (shared.value[(p >> U(6)).astype(np.int64)] >> (p & U(63))) & U(1) == 1
            yield b.select(["doc_id", "text"]).filter(pa.array(keep))

    marked = docs.select("doc_id", "text", *[p.alias(f"p{k}") for k, p in enumerate(_bloom_places("doc_id", bits))])
    return marked.mapInArrow(run, docs.select("doc_id", "text").schema)


def _chunked(members: DataFrame) -> DataFrame:
    """``members`` with the number of chunks of their cluster: of about CHUNK_SETS sets or CHUNK_ELEMENTS elements."""
    plan = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_ELEMENTS)).cast("int").alias("chunks"))
    return members.join(plan, "cluster")


def _linked(sets: DataFrame, bins: int, links) -> DataFrame:
    """What ``links`` finds in every two chunks of each cluster. ``sets``: rep, cluster, chunks, n, elements."""
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    units = sets.withColumn("_c", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    units = units.select("cluster", F.least("_c", "_o").alias("i"), F.greatest("_c", "_o").alias("j"), "rep", "n", "elements",
                         F.when(F.col("_c") == F.col("_o"), 3).when(F.col("_c") < F.col("_o"), 1).otherwise(2).alias("side"))
    return (units.withColumn("_bin", F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(bins)))
            .groupBy("_bin").applyInArrow(links, "a long, b long"))


def _placed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n, k1, k2, h (text hash), _node (key of the component of the row's text) and component_id of every row."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must lie in 1..100")
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = materialise(d.withColumn("h", F.xxhash64("text")).mapInArrow(_set_rows(n), SET_ROWS), "ngram-sizes")
    classes = sizes.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("doc"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    buckets = max(4 * shuffle_partitions(spark), -(-total // BUCKET_ELEMENTS))
    shared = (d.where("doc_id IS NOT NULL").mapInArrow(_signature_rows(n, percent, buckets), SIGNATURE_ROWS)
              .groupBy("bucket").applyInArrow(_candidates(percent), "a long, b long"))
    # a class is named by its first key, never by an id, which several classes may have
    clusters = components(shared).withColumnRenamed("node", "k1").withColumnRenamed("component", "cluster")
    members = materialise(classes.join(clusters, "k1").withColumn("rep", F.col("k1")), "ngram-members")
    own = sizes.select(F.col("doc_id").alias("doc"), "k1", "k2", F.col("sketch").alias("elements"))
    near = _linked(own.join(_chunked(members), ["doc", "k1", "k2"]), buckets, _sketched(percent))
    clusters = components(near).withColumnRenamed("node", "rep").withColumnRenamed("component", "cluster")
    members = materialise(members.drop("cluster").join(clusters, "rep"), "ngram-near")
    wanted = _chunked(members).withColumnRenamed("doc", "doc_id")
    texts = _possibly_in(d, members.select(F.col("doc").alias("doc_id")).distinct()).join(wanted, "doc_id")
    sets = texts.select("text", "rep", "cluster", "chunks", "n", "k1", "k2").mapInArrow(
        _element_rows(n), "rep long, cluster long, chunks int, n long, elements binary")
    links = _linked(sets, buckets, _verified(percent))
    comp = components(links).withColumnRenamed("node", "k1")
    nodes = classes.join(comp, "k1", "left").select("k1", "k2", "n", "doc", F.coalesce("component", "k1").alias("_node"))
    smallest = nodes.groupBy("_node").agg(F.min("doc").alias("component_id"))
    named = nodes.drop("doc").join(smallest, "_node")
    return (sizes.join(named, ["k1", "k2", "n"], "left")
            .withColumn("component_id", F.coalesce("component_id", "doc_id")))


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    return _placed(docs, n, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the smallest by id, set keys and text hash. Equal texts of one id are one.

    Texts without words are a component for each id. Rows with null ``doc_id`` stay.
    """
    rows = _placed(docs, n, percent).where("doc_id IS NOT NULL")
    keep = (rows.groupBy((F.col("n") == 0).alias("_empty"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("_node")).alias("_of"))
            .agg(F.min(F.struct("doc_id", "k1", "k2", "h")).alias("_row")))
    key, = unused(docs.columns, "_h")
    keep = keep.select("_row.doc_id", F.col("_row.h").alias(key))
    known = docs.where("doc_id IS NOT NULL").withColumn(key, F.xxhash64("text")).join(keep, ["doc_id", key], "left_semi")
    return known.dropDuplicates(["doc_id", key]).select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
