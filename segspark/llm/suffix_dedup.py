"""Operator 6: removal of repeated byte strings by a hash-compared suffix sort.

A byte goes when it lies in a string of ``width`` bytes that also starts in a
document with a smaller ``doc_id``. Suffixes are compared up to ``width`` bytes:
prefix polynomial hashes tell which agree that far, those that do not are sorted
by their bytes, eight at a time, and neighbours of one hash are equal, which
their bytes then confirm.

To sort only what can repeat, and nothing in one place, suffixes are dealt by
content. The anchor of a ``width``-byte window is the smallest hash of its
``GRAM``-byte strings, equal for equal windows; consecutive windows with one
anchor form a piece. Documents are cut into blocks by id hash.

1. Every block names its anchors, once each; anchors met in one document only
   are dropped. (5 bytes an anchor are shuffled.)
2. Every block sends each distinct piece with a kept anchor and the smallest
   ``doc_id`` it has for it to the anchor's bucket. There equal pieces are
   joined and the windows of the others are suffix-sorted within their anchor;
   the answer says which windows start in a smaller document of another block.
3. Every block marks its bytes from the answers and its own smallest ids.

A piece that a third of all documents hold reaches its bucket once per block.
An anchor whose pieces come to more than ``hot_bytes`` (one inside a line that
many documents hold in different surroundings) is not kept in one bucket: its
pieces are cut into single windows, each distinct one sent once per block to the
bucket of its own hash, so that equal windows still meet and others spread.
The texts are shuffled once; the three steps reuse that exchange.

Cases: null texts are empty; texts under ``width`` bytes lose nothing; rows
with null ``doc_id`` neither lose nor take anything; rows of one id never take
from each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.llm.shared import shuffle_partitions
from segspark.llm.textbytes import U, as_bytes, chunks, mix64, powers, prefix_hash, ragged, range_hash

GRAM = 20
BLOCK_BYTES = 8 << 20
KEY_BITS = 40
HOT_BYTES = 1 << 20
PIECE_CHUNK = 1 << 17  # bytes hashed at a time: their arrays stay in a core's cache
LISTED = 160  # bytes of an anchor's pieces in a block from which they are counted one by one
_KEY = U((1 << KEY_BITS) - 1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    if len(x) < w:
        return x[:0]
    out, have = x, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = w - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def grams(data: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Hash of every GRAM-byte string."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = prefix[GRAM:] - prefix[:n]
    out *= powers(n, "inv")
    return mix64(out)


def pieces(data: np.ndarray, offsets: np.ndarray, width: int):
    """(document, first byte, windows, anchor, hash of the bytes) of every piece of a block."""
    out = []
    for i, _, raw, off in chunks(data, offsets, PIECE_CHUNK):
        p = prefix_hash(raw)
        low = sliding_min(grams(raw, p), width - GRAM + 1)
        end = np.maximum(off[1:] - width + 1, off[:-1])  # behind a document's last window
        has = np.flatnonzero(end > off[:-1])
        if not len(has):
            continue
        new = np.ones(len(low), bool)
        np.not_equal(low[1:], low[:-1], out=new[1:])
        new[off[has]] = True
        s = np.flatnonzero(new)
        doc = np.searchsorted(off, s, "right") - 1
        live = s < end[doc]  # windows that run into the next document are none
        n = np.minimum(np.append(s[1:], len(low)), end[doc]) - s
        s, doc, n = s[live], doc[live], n[live]
        out.append((doc + i, s + offsets[i], n, low[s], range_hash(p, s, s + n + width - 1)))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    return tuple(np.concatenate(c) for c in zip(*out))


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> U(KEY_BITS)) % U(buckets)).astype(np.int64)


def _pack(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :KEY_BITS // 8].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // (KEY_BITS // 8), 8), np.uint8)
    out[:, :KEY_BITS // 8] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BITS // 8)
    return out.view("<u8").reshape(-1).astype(np.uint64)


def equal_ranges(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether x[a:a+n] and y[b:b+n] are the same bytes, for each (a, b, n); n > 0."""
    out = np.empty(len(a), bool)
    for i in range(0, len(a), 1 << 15):
        m = n[i:i + (1 << 15)]
        same = x[ragged(a[i:i + len(m)], m)] == y[ragged(b[i:i + len(m)], m)]
        out[i:i + len(m)] = np.logical_and.reduceat(same, np.cumsum(m) - m)
    return out


class Suffixes:
    """Suffixes of a byte buffer, compared up to ``width`` bytes through prefix hashes."""

    def __init__(self, data: np.ndarray, width: int) -> None:
        self.data, self.width = data, width
        self.prefix = prefix_hash(data)
        n = max(len(data) - width + 1, 0)
        self.whole = (self.prefix[width:] - self.prefix[:n]) * powers(n, "inv") if n else self.prefix[:0]

    def _word(self, at: np.ndarray, offset: int) -> np.ndarray:
        """The eight bytes (those below ``width``) at ``offset`` of every suffix, as a number that sorts as they do."""
        n = min(8, self.width - offset)
        return self._words[at + offset].astype(np.uint64) >> U(64 - 8 * n)

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes ``at`` inside each run of equal ``group`` (ascending), equal ones as they come.

        One of every hash is sorted: eight bytes at a time, all runs at once,
        and only what the bytes before left together goes on. The others follow
        the one of their hash.
        """
        n = len(at)
        if not n:
            return np.zeros(0, np.int64)
        whole = self.whole[at]
        by = np.lexsort((whole, group))
        new = np.ones(n, bool)
        new[1:] = (group[by[1:]] != group[by[:-1]]) | (whole[by[1:]] != whole[by[:-1]])
        kind = np.empty(n, np.int64)
        kind[by] = np.cumsum(new) - 1
        lead = by[new]
        rank = np.arange(len(lead))  # places are final but for the open ones
        slot, cls = rank, group[lead]
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        self._words = np.ndarray(len(self.data) + 1, ">u8", padded, strides=(1,))
        who = rank
        for offset in range(0, self.width, 8):
            edge = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
            size = np.diff(np.append(edge, len(cls)))
            open_ = np.repeat(size > 1, size)
            slot, who, cls = slot[open_], who[open_], np.repeat(edge, size)[open_]
            if not len(slot):
                break
            word = self._word(at[lead[who]], offset)
            o = np.lexsort((word, cls))
            who, word = who[o], word[o]
            rank[slot] = who
            split = np.ones(len(cls), bool)
            split[1:] = (cls[1:] != cls[:-1]) | (word[1:] != word[:-1])
            cls = np.cumsum(split)
        place = np.empty(len(lead), np.int64)
        place[rank] = np.arange(len(lead))
        return np.argsort(place[kind], kind="stable")


def smallest_of_equal(data: np.ndarray, start: np.ndarray, windows: np.ndarray, doc: np.ndarray, width: int):
    """For pieces (start, windows, smallest doc): the smallest doc of every window's string, piece after piece."""
    s = Suffixes(data, width)
    g = grams(data, s.prefix)
    top = width - GRAM + 1
    anchor = np.minimum.reduceat(np.append(g, U(2**64 - 1)), np.stack([start, start + top], 1).reshape(-1))[::2] if len(start) else g[:0]
    whole = range_hash(s.prefix, start, start + windows + width - 1)
    order = np.lexsort((whole, windows, anchor))
    new = np.ones(len(order), bool)
    prev, now = order[:-1], order[1:]
    new[1:] = (anchor[now] != anchor[prev]) | (windows[now] != windows[prev]) | (whole[now] != whole[prev])
    twin = np.flatnonzero(~new)
    if len(twin):  # equal hashes: the bytes decide
        new[twin] = ~equal_ranges(data, start[order[twin]], data, start[order[twin - 1]], windows[order[twin]] + width - 1)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    lead = order[new]
    best = np.full(len(lead), np.iinfo(np.int64).max)
    np.minimum.at(best, kind, doc)
    # windows of anchors with several different pieces
    lead_anchor = anchor[lead]
    run = np.cumsum(np.concatenate([[0], (lead_anchor[1:] != lead_anchor[:-1]).astype(np.int64)])) if len(lead) else lead
    several = np.bincount(run)[run] > 1 if len(lead) else np.zeros(0, bool)
    first = np.cumsum(windows[lead]) - windows[lead]
    least = np.repeat(best, windows[lead])
    pick = np.flatnonzero(several)
    if len(pick):
        own = np.repeat(pick, windows[lead[pick]])
        slot = ragged(first[pick], windows[lead[pick]])
        at = start[lead[own]] + slot - first[own]
        # equal windows hold their leftmost anchor at the same distance
        likely = np.zeros(1 << 16, bool)  # on the top 16 bits first
        likely[lead_anchor[pick] >> U(48)] = True
        hits = np.flatnonzero(likely[g >> U(48)])
        hits = hits[np.isin(g[hits], lead_anchor[pick])]
        reach = hits[np.searchsorted(hits, at)]
        wrong = np.flatnonzero(g[reach] != lead_anchor[own])
        while len(wrong):
            reach[wrong] = hits[np.searchsorted(hits, reach[wrong], "right")]
            wrong = wrong[g[reach[wrong]] != lead_anchor[own[wrong]]]
        by = np.lexsort((reach - at, run[own]))
        at, slot, own, gap = at[by], slot[by], own[by], (reach - at)[by]
        group = np.cumsum(np.concatenate([[0], ((run[own][1:] != run[own][:-1]) | (gap[1:] != gap[:-1])).astype(np.int64)]))
        # equal rank inside a group means equal strings
        o = s.sort(at, group)
        at, slot, group = at[o], slot[o], group[o]
        a, b = at[:-1], at[1:]
        same = group[1:] == group[:-1]
        same[same] = s.whole[a[same]] == s.whole[b[same]]
        same[same] = equal_ranges(data, a[same], data, b[same], np.full(int(same.sum()), width))
        cls = np.concatenate([[0], np.cumsum(~same)])
        low = np.full(int(cls[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, cls, least[slot])
        least[slot] = low[cls]
    return least[ragged(first[kind], windows)]


def _weights(anchor: np.ndarray, n: np.ndarray, whole: np.ndarray, width: int):
    """Anchors whose distinct pieces come to more than LISTED bytes, and these bytes."""
    order = np.argsort(anchor, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = anchor[order[1:]] != anchor[order[:-1]]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(order)))
    total = np.add.reduceat(n[order] + width - 1, at) if len(at) else n[:0]
    order = order[np.repeat(total > LISTED, size)]
    order = order[np.lexsort((whole[order], n[order], anchor[order]))]
    a, b = order[1:], order[:-1]
    new = np.ones(len(order), bool)
    new[1:] = (anchor[a] != anchor[b]) | (n[a] != n[b]) | (whole[a] != whole[b])
    order = order[new]
    heavy, which = np.unique(anchor[order], return_inverse=True)
    weight = np.bincount(which, n[order] + width - 1, len(heavy)).astype(np.int64)
    return heavy[weight > LISTED], weight[weight > LISTED]


def _name_anchors(width: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        data, offsets = as_bytes(table.column("text"))
        ids = table.column("doc_id").to_numpy()
        doc, _, n, anchor, whole = pieces(data, offsets, width)
        heavy, weight = _weights(anchor, n, whole, width)
        home = _bucket(heavy, buckets)
        order = np.lexsort((ids[doc], anchor))
        a, d = anchor[order], ids[doc][order]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(a)) - 1
        many = d[last] != d[at] if len(at) else np.zeros(0, bool)
        a = a[at]
        bucket = _bucket(a, buckets)
        order = np.argsort(bucket, kind="stable")
        a, many, bucket = a[order], many[order], bucket[order]
        edge = np.searchsorted(bucket, np.arange(buckets + 1))
        by = np.argsort(home, kind="stable")
        heavy, weight = heavy[by], weight[by]
        cut = np.searchsorted(home[by], np.arange(buckets + 1))
        rows = [(int(k), _pack(a[i:j][~many[i:j]] & _KEY), _pack(a[i:j][many[i:j]] & _KEY),
                 _pack(heavy[cut[k]:cut[k + 1]] & _KEY), weight[cut[k]:cut[k + 1]].astype("<u4").tobytes())
                for k, i, j in zip(range(buckets), edge[:-1], edge[1:]) if j > i]
        block = table.column("block")[0].as_py()
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int32()),
                         *(pa.array([r[c] for r in rows], pa.binary()) for c in (1, 2, 3, 4))],
                        ["bucket", "block", "once", "many", "heavy", "weight"])
    return run


def _shared_anchors(hot_bytes: int):
    """Of one bucket: each block's anchors that more than one document has, those of little weight and the hot ones."""
    def run(table: pa.Table) -> pa.Table:
        rows = [(b, _unpack(o), _unpack(m)) for b, o, m in zip(*(table.column(c).to_pylist() for c in ("block", "once", "many")))]
        everything = np.concatenate([np.concatenate([o, m, m]) for _, o, m in rows])
        key, n = np.unique(everything, return_counts=True)
        # an anchor a block does not list has at most LISTED bytes there
        weight = np.bincount(np.searchsorted(key, np.concatenate([np.concatenate([o, m]) for _, o, m in rows])), minlength=len(key)) * LISTED
        heavy = _unpack(b"".join(table.column("heavy").to_pylist()))
        np.add.at(weight, np.searchsorted(key, heavy), np.frombuffer(b"".join(table.column("weight").to_pylist()), "<u4").astype(np.int64))
        hot, key = key[(n > 1) & (weight > hot_bytes)], key[(n > 1) & (weight <= hot_bytes)]
        bucket = table.column("bucket")[0].as_py()
        out = [(b, *(_pack(np.intersect1d(np.concatenate([o, m]), k, assume_unique=True)) for k in (key, hot))) for b, o, m in rows]
        out = [r for r in out if r[1] or r[2]]
        return pa.table([pa.array([r[0] for r in out], pa.int32()), pa.array([bucket] * len(out), pa.int32()),
                         pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.binary())],
                        ["block", "bucket", "keys", "hot"])
    return run


def _listed(anchor: np.ndarray, bucket: np.ndarray, keys: dict[int, np.ndarray]) -> np.ndarray:
    """Whether each anchor is among the keys of its bucket: one search, however many buckets there are."""
    wanted = np.concatenate([np.zeros(0, np.uint64), *(v | U(k << KEY_BITS) for k, v in keys.items())])
    if not len(wanted):
        return np.zeros(len(anchor), bool)
    wanted.sort()
    mine = (anchor & _KEY) | (bucket.astype(np.uint64) << U(KEY_BITS))
    order = np.argsort(mine)
    at = np.empty(len(mine), np.int64)
    at[order] = np.searchsorted(wanted, mine[order])
    return wanted[np.minimum(at, len(wanted) - 1)] == mine


def _kept_pieces(table: pa.Table, keys: dict[int, np.ndarray], hot, width: int, buckets: int):
    """Pieces of a block with a kept anchor, those of hot anchors cut into their windows, and their entries.

    ``hot`` tells of (anchors, their buckets) which are hot.

    An entry is a distinct piece, in the order of (bucket, anchor, length,
    hash): returns (pieces, entry of each piece, first piece of each entry,
    smallest doc_id of each entry, bucket of each entry).
    """
    data, offsets = as_bytes(table.column("text"))
    ids = table.column("doc_id").to_numpy()
    doc, start, n, anchor, whole = pieces(data, offsets, width)
    bucket = _bucket(anchor, buckets)
    parted = hot(anchor, bucket)
    live = _listed(anchor, bucket, keys)
    live &= ~parted
    cut = np.flatnonzero(parted)
    kept = [x[live] for x in (doc, start, n, anchor, whole, bucket)]
    if len(cut):
        begin, prefix = ragged(start[cut], n[cut]), prefix_hash(data)
        window = range_hash(prefix, begin, begin + width)
        single = (np.repeat(doc[cut], n[cut]), begin, np.ones(len(begin), n.dtype), np.repeat(anchor[cut], n[cut]), window,
                  _bucket(mix64(window), buckets))
        kept = [np.concatenate(x) for x in zip(kept, single)]
    doc, start, n, anchor, whole, bucket = kept
    order = np.lexsort((start, whole, n, anchor, bucket))
    new = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    new[1:] = (bucket[a] != bucket[b]) | (anchor[a] != anchor[b]) | (n[a] != n[b]) | (whole[a] != whole[b])
    twin = np.flatnonzero(~new)
    if len(twin):
        new[twin] = ~equal_ranges(data, start[order[twin]], data, start[order[twin - 1]], n[order[twin]] + width - 1)
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    lead = order[new]
    least = np.full(len(lead), np.iinfo(np.int64).max)
    np.minimum.at(least, entry, ids[doc])
    return data, offsets, ids, (doc, start, n, anchor), entry, lead, least, bucket[lead]


def _send_pieces(width: int, buckets: int):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), *(pa.binary(),) * 5)],
                            ["bucket", "block", "bytes", "windows", "least", "keys", "hot"])
        keys, warm = ({k: _unpack(v) for k, v in zip(replies.column("bucket").to_pylist(), replies.column(c).to_pylist())} for c in ("keys", "hot"))

        def hot(anchor: np.ndarray, home: np.ndarray) -> np.ndarray:
            return _listed(anchor, home, warm)

        data, _, _, (_, start, n, anchor), _, lead, least, bucket = _kept_pieces(table, keys, hot, width, buckets)
        parted = hot(anchor, _bucket(anchor, buckets))
        edge = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = []
        for k in np.flatnonzero(np.diff(edge)):
            at = lead[edge[k]:edge[k + 1]]
            rows.append((int(k), data[ragged(start[at], n[at] + width - 1)].tobytes(), n[at].astype("<u4").tobytes(),
                         least[edge[k]:edge[k + 1]].astype("<i8").tobytes(), _pack(anchor[at[~parted[at]]] & _KEY),
                         np.unique(anchor[at[parted[at]]]).astype("<u8").tobytes()))
        block = table.column("block")[0].as_py()
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int32()),
                         *(pa.array([r[c] for r in rows], pa.binary()) for c in (1, 2, 3, 4, 5))],
                        ["bucket", "block", "bytes", "windows", "least", "keys", "hot"])
    return run


def _answer(width: int):
    """Of one bucket: for every entry of every block, the windows that start in a smaller document elsewhere (bits)."""
    def run(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_pylist() for c in ("block", "bytes", "windows", "least", "keys", "hot")}
        data = np.frombuffer(b"".join(col["bytes"]), np.uint8)
        n = [np.frombuffer(w, "<u4").astype(np.int64) for w in col["windows"]]
        windows, doc = np.concatenate(n), np.frombuffer(b"".join(col["least"]), "<i8")
        size = windows + width - 1
        least = smallest_of_equal(data, np.cumsum(size) - size, windows, doc, width)
        flag = least < np.repeat(doc, windows)
        edge = np.concatenate([[0], np.cumsum([w.sum() for w in n])])
        bits = [np.packbits(flag[i:j]).tobytes() for i, j in zip(edge[:-1], edge[1:])]
        bucket = table.column("bucket")[0].as_py()
        return pa.table([pa.array(col["block"], pa.int32()), pa.array([bucket] * len(bits), pa.int32()), pa.array(col["keys"], pa.binary()),
                         pa.array(col["hot"], pa.binary()), pa.array(bits, pa.binary())], ["block", "bucket", "keys", "hot", "bits"])
    return run


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _remove(width: int, buckets: int):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(),) * 4 + (pa.binary(),)], names)
        by = dict(zip(replies.column("bucket").to_pylist(), zip(replies.column("keys").to_pylist(), replies.column("bits").to_pylist())))
        parted = np.unique(np.frombuffer(b"".join(replies.column("hot").to_pylist()), "<u8"))
        data, offsets, ids, (doc, start, n, _), entry, lead, least, bucket = _kept_pieces(
            table, {k: _unpack(v[0]) for k, v in by.items()}, lambda anchor, home: np.isin(anchor, parted), width, buckets)
        room = n[lead]
        first = np.cumsum(room) - room
        flag = np.zeros(int(room.sum()), bool)
        edge = np.searchsorted(bucket, np.arange(buckets + 1))
        for k, (_, bits) in by.items():
            i, j = edge[k], edge[k + 1]
            if j > i:
                flag[first[i]:first[j - 1] + room[j - 1]] = np.unpackbits(np.frombuffer(bits, np.uint8))[:int(room[i:j].sum())]
        # a window goes when another block, or this one, has it in a smaller document
        gone = np.repeat(least[entry] < ids[doc], n) | flag[ragged(first[entry], n)]
        at = ragged(start, n)[gone]
        step = np.zeros(len(data) + width + 1, np.int32)
        step[:len(data) + 1] = np.bincount(at, minlength=len(data) + 1)
        step[width:] -= step[:-width].copy()  # a window ends ``width`` bytes on
        covered = np.cumsum(step)[:len(data)] > 0
        total = np.concatenate([[0], np.cumsum(covered)])
        begins = covered.copy()
        begins[1:] &= ~covered[:-1]
        inner = offsets[1:-1][offsets[1:-1] < len(data)]
        begins[inner] = covered[inner]
        spans = np.concatenate([[0], np.cumsum(begins)])
        removed = total[offsets[1:]] - total[offsets[:-1]]
        kept_off = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)]).astype(np.int32)
        kept = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(kept_off), pa.py_buffer(data[~covered])])
        return pa.table([table.column("doc_id").combine_chunks(), pa.array(np.diff(offsets)), pa.array(removed),
                         pa.array(spans[offsets[1:]] - spans[offsets[:-1]]), kept], names)
    return run


def remove_repeats(docs: DataFrame, width: int = 50, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the remaining bytes ``kept`` of every row."""
    if width < GRAM:
        raise ValueError(f"width must be at least {GRAM}")
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = d.where("doc_id IS NOT NULL")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = shuffle_partitions(spark)
    blocks = max(parts, -(-int(total) // BLOCK_BYTES))
    buckets = max(parts, -(-int(total) // (BLOCK_BYTES // 4)))
    dealt = known.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text")
    by_block = dealt.groupBy("block")
    named = by_block.applyInArrow(_name_anchors(width, buckets), "bucket int, block int, once binary, many binary, heavy binary, weight binary")
    shared = named.groupBy("bucket").applyInArrow(_shared_anchors(hot_bytes), "block int, bucket int, keys binary, hot binary")
    sent = by_block.cogroup(shared.groupBy("block")).applyInArrow(
        _send_pieces(width, buckets), "bucket int, block int, bytes binary, windows binary, least binary, keys binary, hot binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer(width), "block int, bucket int, keys binary, hot binary, bits binary")
    out = by_block.cogroup(answers.groupBy("block")).applyInArrow(_remove(width, buckets), OUT)
    raw = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    nameless = d.where("doc_id IS NULL").select(
        "doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), raw.alias("kept"))
    return out.unionByName(nameless)
