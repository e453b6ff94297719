"""The queries ``opN_<name>``: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from segspark.session import ensure_checkpoint_dir
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir)
        run.__doc__, run.__name__ = fn.__doc__, fn.__name__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_token_files")
def op5(spark, sf_dir):
    """Every document tokenised, written in the Elias-Fano file format and read back."""
    from segspark.llm.token_files import token_files
    return token_files(table(spark, sf_dir, "documents"), end_id=1)


@query("op8_hilbert_shards")
def op8(spark, sf_dir):
    """All documents in eight shards along the Hilbert curve of language, source and size."""
    from segspark.llm.hilbert import hilbert_shards
    d = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    out = hilbert_shards(d, ["lang", "source", "size"], 8, 5, ("doc_id", "size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query("op10_packing")
def op10(spark, sf_dir):
    """All documents concatenated and cut into sequences of 4096 ids."""
    from segspark.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), end_id=2, length=4096)


@query("op9_toxicity")
def op9(spark, sf_dir):
    """Toxicity of every document by non-negative positive-unlabelled learning."""
    from segspark.llm.toxicity import toxicity
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_quality")
def op4(spark, sf_dir):
    """Quality of every document by nearest labelled vectors in a latent semantic space."""
    from segspark.llm.quality import quality
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP7_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS win
       FROM b, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS t(i) WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
       FROM w, lens, unnest(range(1, len(ws) - n + 2)) AS t(i) WHERE len(ws) >= n),
hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query("op7_decontaminate", OP7_SQL)
def op7(spark, sf_dir):
    """Benchmark windows in every document, by joined winnowing fingerprints and extended hits."""
    from segspark.llm.decontaminate import contamination, is_contaminated
    d = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                    F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


@query("op3_line_templates")
def op3(spark, sf_dir):
    """Lines of recurring templates dropped from every document."""
    from segspark.llm.line_templates import drop_boilerplate
    d = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.octet_length("text").cast("long").alias("kept_bytes"),
                    F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op2_embedding_dedup")
def op2(spark, sf_dir):
    """Links and components of all embeddings at cosine 0.95 and above."""
    from segspark.llm.embedding_dedup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


@query("op1_ngram_jaccard")
def op1(spark, sf_dir):
    """Components of all documents by Jaccard similarity 0.9 of three-word shingles."""
    from segspark.llm.ngram_join import jaccard_components
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90)


@query("op6_suffix_dedup")
def op6(spark, sf_dir):
    """Bytes of every document left after removing 50-byte strings that start in an earlier document."""
    from segspark.llm.suffix_dedup import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents"), 50).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _op13_sql() -> str:
    """Base spans, the candidates' tests and the thresholds of ``secrets`` in DuckDB SQL."""
    from segspark.llm import secrets as S
    words = ["password", "passwd", "secret", "token", "api_?key"]
    either = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in words).replace("'", "''")
    rest = r"""["\']?\x20*[:=]\x20*["\']?""".replace("\\'", "''")
    assign = f"({either}){rest}([A-Za-z0-9+/_.=-]+)"
    token = f"[A-Za-z0-9+/_-]{{{S.CANDIDATE_LENGTH},}}"
    every = f"(?:{either}){rest}[A-Za-z0-9+/_.=-]+|AKIA[A-Z0-9]{{16,}}|[0-9a-f]{{24,}}|({token}={{0,2}})"

    def spans(m: str, g: str, own: str = "''") -> str:
        def upto(x: str, i: str) -> str:
            return f"coalesce(list_sum(list_transform({x}[1:{i}], lambda z: length(z))), 0)"
        return (f"list_transform(range(1, len({m}) + 1), lambda i: {{'s': CAST({upto(g, 'i')} + {upto(m, 'i - 1')} AS BIGINT), "
                f"'e': CAST({upto(g, 'i')} + {upto(m, 'i')} AS BIGINT), 'm': {m}[i], 'own': {own}}})")

    kinds = [("a", assign), ("k", "AKIA[A-Z0-9]{16,}"), ("h", "[0-9a-f]{24,}"), ("c", every)]
    found = ", ".join(f"regexp_extract_all(t, '{p}', 0) AS {n}m, string_split_regex(t, '{p}') AS {n}g" for n, p in kinds)
    abc = " ".join(f"WHEN regexp_matches(tok, '^{allowed}+$') THEN '{alphabet}'" for allowed, alphabet in S.ENCODINGS)
    classes = " ".join(f"WHEN n < {below} THEN {k}" for k, below in enumerate(S.LENGTH_CLASSES)) + f" ELSE {len(S.LENGTH_CLASSES)}"

    def tail(z: str) -> str:
        t = f"(1 / (1 + 0.2316419::DOUBLE * abs({z})))"
        poly = (f"{t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * "
                f"(-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE))))")
        own = f"(exp(-({z}) * ({z}) / 2) * 0.3989422804014327::DOUBLE * {poly})"
        return f"(CASE WHEN {z} >= 0 THEN {own} ELSE 1 - {own} END)"

    def held(p: str) -> str:
        return f"greatest(least({p}, 1.0::DOUBLE), 1e-300::DOUBLE)"

    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT rid, {found}, regexp_extract_all(t, '{assign}', 2) AS av, regexp_extract_all(t, '{every}', 1) AS co FROM d),
l AS (SELECT rid, {spans('am', 'ag', 'av[i]')} AS a, {spans('km', 'kg')} AS k, {spans('hm', 'hg')} AS h, {spans('cm', 'cg', "coalesce(co[i], '')")} AS c FROM x),
base AS (SELECT rid, 0 AS kind, u.s AS s, u.e AS e FROM (SELECT rid, unnest(a) AS u FROM l) WHERE length(u.own) >= {S.VALUE_LENGTH}
  UNION ALL SELECT rid, 1, u.s, u.e FROM (SELECT rid, unnest(k) AS u FROM l)
  UNION ALL SELECT rid, 2, u.s, u.e FROM (SELECT rid, unnest(h) AS u FROM l)),
c0 AS (SELECT rid, u.s AS s, u.e AS e, rtrim(u.m, '=') AS tok FROM (SELECT rid, unnest(c) AS u FROM l) WHERE u.own <> ''),
c1 AS (SELECT *, CASE {abc} END AS abc FROM c0
  WHERE length(tok) >= {S.CANDIDATE_LENGTH} AND regexp_matches(tok, '[0-9]') AND regexp_matches(tok, '[A-Za-z]')),
c2 AS (SELECT rid, s, e, tok, length(tok) AS n, length(abc) AS k,
  list_sum(list_transform(string_split(abc, ''), lambda q: (length(tok) - length(replace(tok, q, ''))) * (length(tok) - length(replace(tok, q, ''))))) AS squares,
  list_transform(string_split(tok, ''), lambda q: strpos(abc, q) - 1) AS v FROM c1 WHERE abc IS NOT NULL),
c3 AS (SELECT rid, s, e, tok, CASE {classes} END AS class, CAST(n AS DOUBLE) AS n, CAST(k AS DOUBLE) AS k, CAST(squares AS DOUBLE) AS squares,
  CAST(len(list_filter(v, lambda q: 2 * q >= k)) AS DOUBLE) AS n1,
  CAST(len(list_filter(range(1, n), lambda i: (2 * v[i] >= k) <> (2 * v[i + 1] >= k))) AS DOUBLE) AS changes,
  CAST(list_sum(v) AS DOUBLE) AS sv, CAST(list_sum(list_transform(v, lambda q: q * q)) AS DOUBLE) AS ss,
  CAST(list_sum(list_transform(range(1, n), lambda i: v[i] * v[i + 1])) AS DOUBLE) AS lag, CAST(v[1] + v[n] AS DOUBLE) AS ends FROM c2),
c4 AS (SELECT *, (k / n * squares - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) AS z1, 2 * n1 * (n - n1) AS mixed, sv / n AS mean,
  pow(2.0::DOUBLE, 1 - n) AS few FROM c3),
c5 AS (SELECT *, mixed * (mixed - n) / (n * n * (n - 1)) AS spread, ss - sv * mean AS around,
  lag - mean * (2 * sv - ends) + (n - 1) * mean * mean AS tog FROM c4),
c6 AS (SELECT *, CASE WHEN spread > 0 THEN abs((changes + 1 - (mixed / n + 1)) / sqrt(spread)) END AS z2,
  CASE WHEN around > 0 THEN abs((tog / around + 1 / n) * sqrt(n)) END AS z3 FROM c5),
c7 AS (SELECT *, -(ln({held(tail('z1'))}) + ln({held(f"CASE WHEN spread > 0 THEN 2 * {tail('z2')} ELSE few END")})
  + ln({held(f"CASE WHEN around > 0 THEN 2 * {tail('z3')} ELSE few END")})) AS hh FROM c6),
c8 AS (SELECT rid, s, e, tok, class, CAST(least(floor(exp(-hh) * (1 + hh + hh * hh / 2) * {S.BINS}), {S.BINS - 1}) AS INTEGER) AS bin FROM c7),
tested AS (SELECT DISTINCT class, bin, tok FROM c8),
cuts AS (SELECT class, b FROM (SELECT DISTINCT class FROM tested), (SELECT range AS b FROM range({S.BINS // 2 + 1}))),
above AS (SELECT class, b, count_if(bin >= b) AS n, 2 * count_if(bin >= {S.BINS // 2}) AS random FROM cuts JOIN tested USING (class) GROUP BY class, b),
limits AS (SELECT class, min(b) AS b FROM above WHERE random > 0 AND {S.BINS} * n - random * ({S.BINS} - b) <= 0.05::DOUBLE * {S.BINS} * n GROUP BY class),
named AS (SELECT rid, s, kind, e FROM base UNION ALL SELECT rid, s, 3, e FROM c8 JOIN limits USING (class) WHERE bin >= b),
told AS (SELECT rid, count_if(kind = 0) AS n0, count_if(kind = 1) AS n1, count_if(kind = 2) AS n2,
  string_agg(['assign', 'access', 'hex', 'random'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) AS spans,
  string_agg(['assign', 'access', 'hex', 'random'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER (WHERE kind < 3) AS own
  FROM named GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(own, '')) AS base_sha256,
       coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (rid)"""


OP13_SQL = _op13_sql()


@query("op13_secret_scan", OP13_SQL)
def op13(spark, sf_dir):
    """Secrets of every document by pattern and by tests of randomness."""
    from segspark.llm.secrets import KINDS, listed, scan
    d = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return d.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                    listed(F.concat("base", "added")).alias("spans"))


def _is_kind(k: int):
    return lambda s: s["kind"] == k


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS s
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, other AS positive_id, s AS positive_score FROM p WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, other) <= 5),
neg AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, other) AS INTEGER) AS rank,
               other AS negative_id, positive_score, s AS negative_score
        FROM pos JOIN p USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s AND s <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark, sf_dir):
    """Hard negatives of every hundredth embedding by cover trees."""
    from segspark.llm.cover_tree import hard_negatives
    e = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(e.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


OP11_SQL = r"""
WITH tk AS (SELECT rid, doc_id, unnest(ws) AS w, len(ws) AS n FROM (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents)),
st AS (SELECT count(DISTINCT rid) AS n_docs, count(*) AS n_terms FROM tk),
tf AS (SELECT rid, doc_id, w, count(*) AS tf, min(n) AS n FROM tk GROUP BY rid, doc_id, w),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
q AS (SELECT item_id, text, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
s AS (SELECT item_id, text, rid, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT)
        * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN df USING (w) JOIN tf USING (w), st GROUP BY item_id, text, rid, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 10"""


@query("op11_ranked_search", OP11_SQL)
def op11(spark, sf_dir):
    """The ten best documents of every benchmark item by posting lists in geometric blocks."""
    from segspark.llm.ranked_search import ranked_search
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
