"""Ranked search against scoring everything, its SQL, and the defined edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from segspark.llm import ranked_search as R

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERMS.findall((text or "").translate(UPPER))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in dict.fromkeys(items):
        q = terms(text)
        scored = []
        for i, b in bags:
            m = 100 - 75 + (75 * sum(b.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * b[w] // (1000 * b[w] + 8 * m)) for w in q if b[w])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(str(item), r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus(seed=2, n=500):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéñ01") for _ in range(r.randint(1, 6))) for _ in range(600)]
    topic = [words[k * 50:(k + 1) * 50] for k in range(12)]
    docs = []
    for i in range(n):
        own = topic[r.randrange(12)]
        t = [r.choice(own) if r.random() < 0.7 else words[min(599, int(r.expovariate(0.05)))] for _ in range(r.randint(1, 120))]
        docs.append((i, r.choice([" ", "_", "\n", "-"]).join(x.upper() if r.random() < 0.1 else x for x in t)))
    docs += [(n + k, docs[k % n][1]) for k in range(40)] + [(n + 50 + k, docs[7][1]) for k in range(30)]
    docs += [(900, None), (901, ""), (902, " .-"), (903, "only here zzz"), (904, " ".join(words * 60)), (None, docs[3][1]), (5, docs[9][1]), (5, docs[9][1])]
    items = [(k, " ".join(r.choice(topic[k % 12]) for _ in range(r.randint(1, 30)))) for k in range(30)]
    items += [(100, None), (101, "..."), (102, "nowhere atall"), (103, "ZZZ zzz"), (104, docs[3][1]), (0, items[0][1]), (0, "zzz"), (None, "zzz")]
    return docs, items


def frame(spark, rows, name):
    return spark.createDataFrame([(i, t, "k", 1) for i, t in rows], f"{name} long, text string, terms string, n int")


def run(spark, docs, items, k=10):
    got = R.ranked_search(frame(spark, docs, "doc_id"), frame(spark, items, "item_id"), k).collect()
    return sorted(((str(r.item_id), r.rank, r.doc_id, r.score) for r in got), key=str)


@pytest.mark.parametrize("shard,lot", [(4096, 200_000), (64, 300)])
def test_brute_force(spark, monkeypatch, shard, lot):
    monkeypatch.setattr(R, "LOT_TERMS", lot)
    monkeypatch.setattr(R, "SHARD", shard)
    docs, items = corpus()
    # the items of id 0 have a ranking for each text
    assert run(spark, docs, items) == brute(docs, items)


def test_edges(spark):
    docs, items = corpus(n=12)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []
    assert run(spark, [(1, "a b"), (2, "b")], [(1, "b a a")], 1) == brute([(1, "a b"), (2, "b")], [(1, "b a a")], 1)


def sharded(docs, texts):
    """One shard of the documents for the queries, and dense gains."""
    import pyarrow as pa
    h, first = R.term_hashes(*R.as_bytes(pa.array(texts)))
    queries = R.Queries([h[a:b] for a, b in zip(first[:-1], first[1:])])

    class Shared:
        value = queries
    batch = pa.record_batch([pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs])], ["doc_id", "text"])
    x = R.Vectors(pa.Table.from_batches(R._vector_rows(Shared)([batch])))
    weight = R.weights(np.bincount(x.terms, minlength=len(queries.vocabulary)), len(x.n))
    gain = R.gains(x.tf, R.length_part(x.n, len(x.n), int(x.n.sum()))[x.doc])
    dense = np.zeros((len(x.ids), len(weight)), np.int64)
    dense[x.doc, x.terms] = gain
    return R.Shard(x, queries, weight, gain, R.sketches(x, gain, weight, R.projection(len(weight)))), dense


def test_blocks():
    """Summaries are coordinatewise maxima of their blocks, and a search finds what scoring everything finds."""
    docs, items = corpus(n=2000)
    shard, dense = sharded(docs, [t for _, t in items if terms(t)])
    for q, own in enumerate(shard.queries.terms):
        want = dense[:, own] @ (shard.queries.times[q] * shard.weight[own])
        for t in own[:5]:
            members, starts, summary, columns = shard.blocks(int(t))
            assert sorted(members) == list(np.flatnonzero(dense[:, t]))
            for a, b, top in zip(starts, np.append(starts[1:], len(members)), summary) if len(members) else ():
                assert (top == dense[members[a:b]][:, columns].max(axis=0)).all()
        found, score = shard.search(q, 10, max(1, int(np.sort(want)[-10])))
        assert sorted(score) == sorted(np.sort(want[want > 0])[-10:]) and (want[found] == score).all()
    assert shard.skipped > 0


def test_unlike_blocks_are_skipped():
    """Of a list whose documents are of two kinds, the blocks of the other kind stay closed."""
    docs = [(i, f"{'a1 a2 a3' if i % 2 else 'b1 b2 b3'} own{i}" + (" link" if i < 256 else "")) for i in range(3000)]
    shard, _ = sharded(docs, ["link a1 a2 a3"])
    beat = brute(docs, [(0, "link a1 a2 a3")])[9][3]
    found, _ = shard.search(0, 10, beat)
    assert sorted(found) == list(range(1, 20, 2)) and shard.skipped >= 1 and shard.opened == 1
