"""Operator 7: benchmark decontamination by winnowing, in DataFrame functions only.

Of the word k-gram hashes of a text the smallest in every run of ``n - k + 1``
is kept. Any span of ``n`` words holds one whole run, so two texts that share
such a span keep a fingerprint in common; joining the fingerprints of documents
and benchmark items therefore finds every pair that shares a window. The hits
are extended on the words themselves: a window counts only if it is the same
text, so the result is exact whatever the hashes do.

An item of fewer than ``n`` words is one window of its own length; the lengths
that occur (at most ``n - 1`` numbers) add the documents' word sequences of
those lengths to their fingerprints.

Cases: null texts have no words and no hits; an item without words or without
id takes no part; items of one id count once; null or repeated ``doc_id`` rows
are judged row by row; empty tables give no rows, or rows without hits; other
columns of ``docs`` pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.llm.shared import let, materialise, unused

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEPARATORS = "".join(chr(c) for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters of the lower-cased text; none for null."""
    inner = F.btrim(ascii_lower(text), F.lit(_SEPARATORS))
    return F.when(F.octet_length(inner) > 0, F.split(inner, SEPARATOR)).otherwise(F.array().cast("array<string>"))


def _positions(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: str, k: int) -> Column:
    """Hash of each run of ``k`` word hashes."""
    h = F.col(hashes)
    return F.transform(_positions(F.size(h) - (k - 1)), lambda i: F.xxhash64(F.lit(k), *[F.get(h, i + d) for d in range(k)]))


def _winnow(grams: str, w: int) -> Column:
    """Distinct minima of every ``w`` consecutive values."""
    g = F.col(grams)
    return F.array_distinct(F.transform(_positions(F.size(g) - (w - 1)), lambda i: F.least(*[F.get(g, i + d) for d in range(w)])))


def with_grams(df: DataFrame, k: int) -> DataFrame:
    """Adds the word hashes ``_h`` and the k-gram hashes ``_g`` of ``_words``."""
    return df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_g", _grams("_h", k))


def item_windows(items: DataFrame, n: int) -> DataFrame:
    """item_id (text), _words, _len (words of a window) and _windows (their distinct texts) of the items with words."""
    d = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("_words"))
    d = d.where("item_id IS NOT NULL AND size(_words) > 0").withColumn("_len", F.least(F.size("_words"), F.lit(n)))
    return d.withColumn("_windows", F.array_distinct(F.transform(
        _positions(F.size("_words") - F.col("_len") + 1),
        lambda i: F.array_join(F.slice("_words", i + 1, F.col("_len")), " "))))


def contamination(docs: DataFrame, items: DataFrame, n: int = 13, k: int = 5) -> DataFrame:
    """``docs`` with n_words, n_hit, ``item_ids`` (sorted texts of the items with an occurring window).

    To filter on these columns write the result first, or use ``clean``: a
    filter is pushed below the projections and would repeat their work per word.
    """
    key, candidates, words, hits = unused(docs.columns, "_key", "_items", "_words", "_hits")
    found = _found(docs.select("doc_id", "text"), items, n, k).select(F.col("_key").alias(key), F.col("_items").alias(candidates))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(found, key, "left")
    return _extend(keyed, candidates, words, hits).drop(key)


def clean(docs: DataFrame, items: DataFrame, n: int = 13, k: int = 5) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they are.

    Only documents that share a fingerprint are judged; the verdicts are
    written before the rows of contaminated ones are taken out.
    """
    d = docs.select("doc_id", "text")
    keyed = d.withColumn("_key", F.xxhash64("doc_id", "text")).join(_found(d, items, n, k), "_key")
    second = F.xxhash64(F.lit(1), "text", "doc_id")  # with the key, 128 bits name a row
    verdict = materialise(_extend(keyed, "_items", "_words", "_hits").select("_key", second.alias("_second"), "n_words", "n_hit"), "verdicts")
    names = unused(docs.columns, "_key", "_second")
    gone = verdict.where(is_contaminated()).select(F.col("_key").alias(names[0]), F.col("_second").alias(names[1])).distinct()
    named = docs.withColumns({names[0]: F.xxhash64("doc_id", "text"), names[1]: second})
    return named.join(gone, names, "left_anti").select(*docs.columns)


def _found(docs: DataFrame, items: DataFrame, n: int, k: int) -> DataFrame:
    """For each ``_key`` of ``docs`` the items that share a fingerprint with it, in ``_items``."""
    if not 1 <= k <= n:
        raise ValueError("k must lie in 1..n")
    win = item_windows(items, n)
    short = sorted(r[0] for r in win.where(F.col("_len") < n).select("_len").distinct().collect())  # at most n - 1 numbers
    # a key of the row; two rows of one key only share candidates, which the windows themselves settle
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    left = with_grams(keyed.select("_key", words_of(F.col("text")).alias("_words")), k)
    prints = [_winnow("_g", n - k + 1), *[F.array_distinct(_grams("_h", m)) for m in short]]
    left = left.select("_key", F.explode(F.concat(*prints) if short else prints[0]).alias("_fp"))
    own = _winnow("_g", n - k + 1)
    for m in short:
        own = F.when(F.col("_len") == m, _grams("_h", m)).otherwise(own)
    right = with_grams(win, k).select("item_id", "_windows", F.explode(own).alias("_fp"))
    pairs = left.join(right.select("_fp", "item_id", F.xxhash64("_windows").alias("_item")).distinct(), "_fp").select(
        "_key", "item_id", "_item").distinct()
    texts = win.select("item_id", F.xxhash64("_windows").alias("_item"), "_len", "_windows").distinct()
    return pairs.join(texts, ["item_id", "_item"]).groupBy("_key").agg(
        F.collect_list(F.struct("item_id", "_len", "_windows")).alias("_items"))  # the items of one document


def _extend(df: DataFrame, candidates: str, words: str, hit: str) -> DataFrame:
    """Exact hits: every position where a window of a candidate item stands. The names are of helper columns."""
    df = df.withColumn(words, words_of(F.col("text")))
    def places(x):
        at = _positions(F.size(words) - x["_len"] + 1)
        # what both hold is found by hash; only those few windows are looked up place by place
        return let(F.transform(at, lambda i: F.array_join(F.slice(words, i + 1, x["_len"]), " ")), lambda own: let(
            F.array_intersect(own, x["_windows"]), lambda both: F.when(F.size(both) > 0, F.filter(at, lambda i: F.array_contains(
                both, F.get(own, i)))).otherwise(F.array().cast("array<int>"))))

    hits = F.transform(candidates, lambda x: F.struct(x["item_id"].alias("item_id"), x["_len"].alias("len"), places(x).alias("at")))
    df = df.withColumn(hit, F.when(F.col(candidates).isNotNull(), F.filter(hits, lambda x: F.size(x["at"]) > 0)))
    covered = F.array_distinct(F.flatten(F.transform(hit, lambda x: F.flatten(F.transform(
        x["at"], lambda i: F.sequence(i, i + x["len"] - 1))))))
    return df.withColumns({
        "n_words": F.size(words).cast("long"),
        "n_hit": F.when(F.col(hit).isNull(), 0).otherwise(F.size(covered)).cast("long"),
        "item_ids": F.when(F.col(hit).isNull(), F.array().cast("array<string>")).otherwise(
            F.array_sort(F.array_distinct(F.transform(hit, lambda x: x["item_id"])))),
    }).drop(words, candidates, hit)


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
