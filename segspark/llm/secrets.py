"""Operator 13: secret scans with a battery of randomness tests, in DataFrame functions only.

Three kinds are found by pattern: ``assign`` (a named secret and its value of
six or more characters; the span is the whole match), ``access`` (key ids) and
``hex`` (24 or more lower-case hex digits). Each kind is matched leftmost and
non-overlapping on its own; spans count code points, ends are exclusive.

The battery adds ``random`` spans. A candidate is a run of 20 or more characters
of the base64 alphabets outside the patterns' matches, with its padding. Its
encoding is the smallest alphabet that holds all its characters (hex, base32,
base36, base62, base64, base64url); it needs a letter and a digit, so words and
numbers have none. Against "every character is drawn evenly from the alphabet":

* chi-squared of the symbol counts, with its exact mean and variance;
* number of runs above and below the middle of the alphabet;
* correlation of each symbol's place with the next one's.

The three p-values are combined by Fisher's method into p. Random strings have
p spread evenly over 0..1, structured ones pile up near 0, the more the longer
they are; so for each class of lengths the distinct candidates of the whole
table are counted by p, the number of random ones is estimated from the upper
half of p, and the smallest threshold is taken at which the estimated share of
others among the candidates above it is at most ``alpha``. A class without a
candidate in the upper half reports none.

Only candidates' hashes and counts are shuffled (one row per distinct candidate
and task); the thresholds are at most one number per class of lengths. Texts
are read once; what is found is written to the shared folder before the
thresholds are applied.

Cases: a null text counts as empty and has no spans; rows with null or repeated
``doc_id`` are scanned row by row; a text of any length is scanned whole, its
positions by sums in blocks; a candidate that begins before a pattern's match
and runs into it may overlap it; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.llm.shared import let, materialise

# The patterns of the three base kinds.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"  # the longest match of a run starts at its first AKIA: 20 characters or none
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
VALUE_LENGTH = 6
KINDS = ["assign", "access", "hex", "random"]

CANDIDATE_LENGTH = 20
ANY = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}"""
       rf"|([A-Za-z0-9+/_-]{{{CANDIDATE_LENGTH},}}={{0,2}})")
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: (characters allowed, alphabet in order), smallest first
ENCODINGS = [("[0-9a-f]", _DIGITS + _LOWER[:6]), ("[0-9A-F]", _DIGITS + _UPPER[:6]), ("[A-Z2-7]", _UPPER + "234567"),
             ("[0-9a-z]", _DIGITS + _LOWER), ("[0-9A-Z]", _DIGITS + _UPPER), ("[0-9A-Za-z]", _DIGITS + _UPPER + _LOWER),
             ("[0-9A-Za-z+/]", _UPPER + _LOWER + _DIGITS + "+/"), ("[0-9A-Za-z_-]", _UPPER + _LOWER + _DIGITS + "-_")]
LENGTH_CLASSES = [24, 32, 48, 80]  # lengths below these, in order, are the classes 0, 1, ...
BINS = 100
SUM_BLOCK = 256


def running_totals(lengths: Column) -> Column:
    """Inclusive prefix sums of an array of numbers, summed in blocks so that long arrays stay cheap."""
    zero = F.array(F.lit(0).cast("long"))

    def grown(acc, x):
        return F.concat(acc, F.array(F.element_at(acc, -1) + x))

    def summed(values):
        starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(SUM_BLOCK))
        return F.transform(starts, lambda s: F.aggregate(F.slice(values, s, F.lit(SUM_BLOCK)), zero, grown))

    def joined(parts):
        bases = F.aggregate(parts, zero, lambda acc, p: grown(acc, F.element_at(p, -1)))
        return let(bases, lambda b: F.flatten(F.transform(
            parts, lambda p, i: F.transform(F.slice(p, F.lit(2), F.size(p) - 1), lambda x: x + F.get(b, i)))))

    return let(lengths, lambda values: let(summed(values), joined))


def spans_of(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, match), in code points."""
    def placed(found):
        gaps = F.split(text, pattern, -1)  # as many as matches, and the rest
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda a, b: F.length(a).cast("long") + F.length(b))
        return F.zip_with(found, running_totals(steps), lambda m, end: F.struct(
            (end - F.length(m)).alias("start"), end.alias("end"), m.alias("match")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    return let(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, (start, rank of the kind, end), in order."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    # a text without the marks a pattern needs is not searched for it
    assign = F.when(F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), spans_of(text, ASSIGN)).otherwise(none)
    assign = F.filter(assign, lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= VALUE_LENGTH)
    access = F.when(F.contains(text, F.lit("AKIA")), spans_of(text, ACCESS)).otherwise(none)
    return F.array_sort(F.concat(*[_of_kind(spans, k) for k, spans in enumerate([assign, access, spans_of(text, HEX)])]))


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def upper_tail(z: Column) -> Column:
    """P(normal > z) for z >= 0 by the rational approximation 26.2.17 of Abramowitz and Stegun (error below 1e-7)."""
    def of(x, t):
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return let(z, lambda x: let(1 / (1 + 0.2316419 * x), lambda t: of(x, t)))


def _encoding(token: Column) -> Column:
    abc = F
    for allowed, alphabet in ENCODINGS:
        abc = abc.when(token.rlike(f"^{allowed}+$"), F.lit(alphabet))
    return F.when(token.rlike("[0-9]") & token.rlike("[A-Za-z]"), abc)


def _length_class(n: Column) -> Column:
    out = F
    for k, below in enumerate(LENGTH_CLASSES):
        out = out.when(n < below, F.lit(k))
    return out.otherwise(F.lit(len(LENGTH_CLASSES)))


def _total(values: Column, of=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + of(x))


def _neighbours(values: Column, of) -> Column:
    n = F.size(values) - 1
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(2), n), of)


def _sums(token: Column, abc: Column) -> Column:
    """Whole numbers the tests need: n, k, symbol counts squared, upper half, runs, sums of places."""
    def of(places):
        k = F.length(abc)
        up = F.transform(places, lambda v: 2 * v >= k)
        squares = F.aggregate(F.regexp_extract_all(abc, F.lit("."), F.lit(0)), F.lit(0).cast("long"), lambda acc, c: let(
            (F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("long"), lambda m: acc + m * m))
        return F.struct(
            F.size(places).cast("long").alias("n"), k.cast("long").alias("k"), squares.alias("squares"),
            F.size(F.filter(up, lambda u: u)).cast("long").alias("n1"),
            let(up, lambda u: F.size(F.filter(_neighbours(u, lambda a, b: a != b), lambda x: x))).cast("long").alias("changes"),
            _total(places).alias("s"), _total(places, lambda v: v * v).alias("ss"),
            _total(_neighbours(places, lambda a, b: a * b)).alias("lag"),
            (F.get(places, F.lit(0)) + F.element_at(places, -1)).alias("ends"))

    places = F.transform(F.regexp_extract_all(token, F.lit("."), F.lit(0)), lambda c: (F.position(c, abc) - 1).cast("long"))
    return let(places, of)


def _p_value(x: Column) -> Column:
    """Fisher's combination of the three tests from the sums ``x``."""
    def scores(v):
        n, k = v["n"], v["k"]
        return F.struct(
            n.alias("n"), v["spread"].alias("spread"), v["around"].alias("around"),
            ((k / n * v["squares"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)).alias("even"),
            F.when(v["spread"] > 0, F.abs((v["changes"] + 1 - (v["mixed"] / n + 1)) / F.sqrt(v["spread"]))).alias("runs"),
            F.when(v["around"] > 0, F.abs((v["together"] / v["around"] + 1 / n) * F.sqrt(n))).alias("serial"))

    def moments(v):
        n, mean = v["n"], v["s"] / v["n"]
        mixed = 2 * v["n1"] * (n - v["n1"])
        return let(mixed, lambda m: let(mean, lambda c: F.struct(
            n.alias("n"), v["k"].alias("k"), v["squares"].alias("squares"), v["changes"].alias("changes"), m.alias("mixed"),
            (m * (m - n) / (n * n * (n - 1))).alias("spread"), (v["ss"] - v["s"] * c).alias("around"),
            (v["lag"] - c * (2 * v["s"] - v["ends"]) + (n - 1) * c * c).alias("together"))))

    def held(p):
        return F.ln(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-300)))

    def combined(z):
        least = F.pow(F.lit(2.0), 1 - z["n"])  # of a string that stays in one half, or in one place
        even = let(upper_tail(F.abs(z["even"])), lambda p: F.when(z["even"] >= 0, p).otherwise(1 - p))
        logs = -(held(even) + held(F.coalesce(2 * upper_tail(z["runs"]), least)) + held(F.coalesce(2 * upper_tail(z["serial"]), least)))
        return let(logs, lambda h: F.exp(-h) * (1 + h + h * h / 2))

    doubles = F.struct(*[x[c].cast("double").alias(c) for c in ("n", "k", "squares", "n1", "changes", "s", "ss", "lag", "ends")])
    return let(doubles, lambda v: let(moments(v), lambda m: let(scores(m), combined)))


def candidates(text: Column) -> Column:
    """(start, end, class, token, bin, p) of every candidate with an encoding; bin is the hundredth of p."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    # the group is empty where a pattern matched
    own = F.regexp_extract_all(text, F.lit(ANY), F.lit(1))
    has = text.rlike(f"[A-Za-z0-9+/_-]{{{CANDIDATE_LENGTH}}}")
    spans = F.when(has, F.filter(F.transform(F.arrays_zip(spans_of(text, ANY).alias("s"), own.alias("own")), lambda x: F.when(
        F.length(x["own"]) > 0, x["s"])), lambda s: s.isNotNull())).otherwise(none)
    named = F.transform(spans, lambda s: let(F.rtrim(s["match"], F.lit("=")), lambda t: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), t.alias("token"), _encoding(t).alias("abc"))))
    named = F.filter(named, lambda s: s["abc"].isNotNull() & (F.length(s["token"]) >= CANDIDATE_LENGTH))
    tested = F.transform(named, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), _length_class(F.length(s["token"])).alias("class"),
        F.xxhash64(s["token"]).alias("token"), let(_sums(s["token"], s["abc"]), _p_value).alias("p")))
    return F.transform(tested, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["class"].alias("class"), s["token"].alias("token"),
        F.least(F.floor(s["p"] * BINS), F.lit(BINS - 1)).cast("int").alias("bin"), s["p"].alias("p")))


def thresholds(found: DataFrame, alpha: float) -> dict[int, int]:
    """Smallest bin reported in each class of lengths. ``found``: class, token, bin. At most classes x BINS rows are collected."""
    counts = found.groupBy("class", "bin", "token").agg(F.lit(1).alias("_one")).groupBy("class", "bin").agg(F.count(F.lit(1)).alias("n"))
    table: dict[int, list[int]] = {}
    for r in counts.collect():
        table.setdefault(r["class"], [0] * BINS)[r["bin"]] = r["n"]
    out = {}
    for k, n in table.items():
        random = 2 * sum(n[BINS // 2:])
        for b in range(BINS // 2 + 1):
            above = sum(n[b:])
            if random and BINS * above - random * (BINS - b) <= alpha * BINS * above:
                out[k] = b
                break
    return out


def scan(docs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """doc_id, ``base`` and ``added`` of every row of ``docs`` (doc_id, text).

    Both are arrays of (start, kind, end) in order, kind being the index in ``KINDS``.
    """
    if not 0 <= alpha < 1:
        raise ValueError("alpha must lie in [0, 1)")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = materialise(d.select("doc_id", base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("found")), "secrets")
    limits = thresholds(found.select(F.explode("found").alias("f")).select("f.class", "f.token", "f.bin"), alpha)
    least = F.array(*[F.lit(limits.get(k, BINS)) for k in range(len(LENGTH_CLASSES) + 1)])
    added = _of_kind(F.filter("found", lambda s: s["bin"] >= F.get(least, s["class"])), KINDS.index("random"))
    return found.select("doc_id", "base", added.alias("added"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of (start, kind, end) structs, comma-joined in their order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
