"""Operator 3: line de-duplication with a log-template tree, in DataFrame functions only.

A line is masked (tokens with a digit become ``<*>``) and filed in a tree of
fixed depth: number of tokens, then the first ``depth`` tokens. A leaf keeps a
list of templates, found in rounds. A template is, place by place, the token
most documents have there; a line agreeing with it on at least ``similarity``
of its places belongs to it, the places that differ being its variable fields.
Its lines are taken out and the rest votes again; a rest of which the vote took
under a quarter is first divided by its tokens at the place where they recur
most, tokens of one document staying together. A line of no such template is
its own, masked. A recurring template is boilerplate: it stays in the document
with the smallest ``doc_id`` and its lines are dropped everywhere else.

A template recurs in ``min_docs`` documents; in ``variable_docs`` if its lines
differ or are mostly masks, or have 2 to ``min_tokens`` - 1 tokens; in
``word_docs`` if it is one token. Lines under ``min_tokens`` tokens match only
whole, and unmasked where nothing but masks would be left.

Counts cover all documents. Only hashes, places and counts are shuffled, one
row per distinct line and document at most, and every count is summed before
its shuffle, so a line that a third of all documents share is a row per task.
A leaf needs at most as many divisions as its lines have tokens.

Cases: a null text has no lines and stays null; blank lines are never dropped;
a text whose lines all go becomes empty and keeps its row; rows with null
``doc_id`` are counted as documents of their own text and come after all
others; repeated rows of one id and text are one document; empty tables give no
rows; other columns pass through under any name. A variable field whose values recur themselves may divide its template by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.llm.shared import materialise, unused

MASK = "<*>"


def masked(line: Column) -> Column:
    """The line's tokens joined by single spaces, every token that holds a digit replaced by ``<*>``."""
    tidy = F.btrim(F.regexp_replace(F.regexp_replace(line, r"[^\s0-9]*+[0-9]\S*+", MASK), r"[ \t\r\x0b\x0c]+", " "))
    return F.when(line.rlike("[0-9\t\r\x0b\x0c]|  "), tidy).otherwise(F.btrim(line))


def _lines(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """_key, doc_id, _pos, _mask, _leaf, _line, _tokens, _bare (mostly masks) of every line that is not blank."""
    d = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_key"), F.posexplode(F.split("text", "\n")).alias("_pos", "_text"))
    d = d.where(F.btrim("_text", F.lit(" \t\r\x0b\x0c")) != "").select("_key", "doc_id", "_pos", "_text", masked(F.col("_text")).alias("_mask"))
    nothing = [" ".join([MASK] * n) for n in range(1, min_tokens)]
    raw = F.btrim(F.regexp_replace("_text", r"[ \t\r\x0b\x0c]+", " "))
    d = d.withColumn("_mask", F.when(F.col("_mask").isin(nothing), raw).otherwise(F.col("_mask"))) if nothing else d
    tokens = F.octet_length("_mask") - F.octet_length(F.replace("_mask", F.lit(" "), F.lit(""))) + 1
    d = d.select("_key", "doc_id", "_pos", "_mask", tokens.alias("_tokens"))
    masks = (F.octet_length("_mask") - F.octet_length(F.replace("_mask", F.lit(MASK), F.lit("")))) / len(MASK)
    head = F.when(F.col("_tokens") < min_tokens, F.col("_mask")).otherwise(F.substring_index("_mask", " ", depth))
    return d.select("*", F.xxhash64(F.col("_tokens") - 1, head).alias("_leaf"), F.xxhash64("_mask").alias("_line"),
                    (F.contains("_mask", F.lit(MASK)) & (2 * masks > F.col("_tokens"))).alias("_bare"))


def _templates(lines: DataFrame, min_docs: int, similarity: float) -> list[DataFrame]:
    """_leaf, _line, _group of the lines that agree with a template of their leaf, a table a round."""
    found, todo = [], lines.withColumn("_node", F.col("_leaf"))
    while True:
        size = todo.groupBy("_node").agg(F.sum("docs").alias("_all"), F.count(F.lit(1)).alias("_n")).where(
            (F.col("_all") >= min_docs) & (F.col("_n") > 1)).drop("_n")
        todo = materialise(todo.join(size, "_node"), "leaf-lines")
        if todo.isEmpty():
            return found
        votes = (todo.select("_node", "_all", "docs", F.posexplode("_toks").alias("_at", "_tok"))
                 .groupBy("_node", "_all", "_at", "_tok").agg(F.sum("docs").alias("docs")))
        recurs = F.when((F.col("docs") > 1) & (F.col("docs") < F.col("_all")), F.col("docs").cast("double") * F.col("docs"))
        plan = (votes.groupBy("_node", "_at").agg(F.max_by("_tok", F.struct("docs", "_tok")).alias("_tok"), F.sum(recurs).alias("_score"))
                .groupBy("_node").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_tok"))), lambda x: x["_tok"]).alias("_tmpl"),
                                      F.max(F.when(F.col("_score").isNotNull(), F.struct("_score", -F.col("_at")))).alias("_best"))
                .select("_node", "_tmpl", (-F.col("_best.col2")).alias("_place")))
        agree = F.aggregate(F.zip_with("_toks", "_tmpl", lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
        fits = todo.join(plan, "_node").select(
            "_leaf", "_line", "_node", "_all", "docs", "_toks", (agree >= similarity * F.size("_toks")).alias("_fits"),
            "_place", F.get("_toks", F.col("_place")).alias("_tok"))
        got = fits.where("_fits").groupBy("_node").agg(F.sum("docs").alias("_got")).where(F.col("_got") >= min_docs)
        shared = votes.where("docs > 1").select("_node", F.col("_at").alias("_place"), "_tok", F.lit(True).alias("_many"))
        taken = F.col("_fits") & F.col("_got").isNotNull()
        node = (F.when(taken, None).when(4 * F.col("_got") >= F.col("_all"), F.col("_node"))
                .when(F.col("_place").isNull(), None)
                .when(F.col("_many"), F.xxhash64("_node", "_place", "_tok")).otherwise(F.xxhash64("_node", "_place")))
        done = materialise(fits.join(got, "_node", "left").join(shared, ["_node", "_place", "_tok"], "left").select(
            "_leaf", "_line", "docs", "_toks", node.alias("_next"),
            F.when(taken, F.xxhash64("_node", F.lit(len(found)))).alias("_group")), "leaf-round")
        found.append(done.where("_group IS NOT NULL").select("_leaf", "_line", "_group"))
        todo = done.where("_next IS NOT NULL").select("_leaf", "_line", "docs", "_toks", F.col("_next").alias("_node"))


def boilerplate(docs: DataFrame, min_docs: int = 2, min_tokens: int = 4, depth: int = 3, similarity: float = 0.7,
                variable_docs: int = 3, word_docs: int = 6) -> DataFrame:
    """Lines to drop: _key (row hash), _pos, template."""
    variable_docs = max(min_docs, variable_docs)
    word_docs = max(variable_docs, word_docs)
    need = (F.when(F.col("_tokens") == 1, F.lit(word_docs if min_tokens > 1 else min_docs))
            .when((F.col("_tokens") < min_tokens) | F.col("_bare"), F.lit(variable_docs)).otherwise(F.lit(min_docs)))
    kept = materialise(_lines(docs, depth, min_tokens).select("_key", "doc_id", "_pos", "_leaf", "_line", need.alias("_need")), "lines")
    by_doc = kept.groupBy("_leaf", "_line", "_key").agg(F.min("doc_id").alias("doc_id"), F.min("_need").alias("_need"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_key")
    # distinct lines, with the documents that hold each
    lines = by_doc.groupBy("_leaf", "_line").agg(F.count(F.lit(1)).alias("docs"), F.min_by("_key", order).alias("_first"),
                                                 F.min("_need").alias("_need"), F.min("_key").alias("_low"), F.max("_key").alias("_high"))
    several = lines.groupBy("_leaf").agg(F.count(F.lit(1)).alias("_n"), F.sum("docs").alias("docs"), F.min("_low").alias("_low"),
                                         F.max("_high").alias("_high")).where(
        (F.col("_n") > 1) & (F.col("docs") >= variable_docs) & (F.col("_low") < F.col("_high"))).select("_leaf")
    several = materialise(several, "leaves")  # its size is known before the texts are read again
    # tokens of the lines of recurring leaves that hold more than one; a leaf of short lines holds one
    texts = (_lines(docs, depth, min_tokens).select("_key", "_leaf", "_line", "_mask")
             .join(several, "_leaf", "left_semi").groupBy("_leaf", "_line")
             .agg(F.first("_mask").alias("_mask"), F.count_distinct("_key").alias("docs"))
             .select("_leaf", "_line", "docs", F.transform(F.split("_mask", " "), lambda t: F.xxhash64(t)).alias("_toks")))
    grouped = None
    for x in _templates(texts, variable_docs, similarity):
        grouped = x if grouped is None else grouped.unionByName(x)
    recurring = lines.where(F.col("docs") >= F.col("_need")).select(
        "_leaf", "_line", F.lit(0).alias("_rank"), F.xxhash64(F.lit("line"), "_leaf", "_line").alias("template"), "_first")
    if grouped is not None:
        once = by_doc.join(grouped, ["_leaf", "_line"]).groupBy("_group", "_key").agg(F.min("doc_id").alias("doc_id"))
        groups = once.groupBy("_group").agg(F.count(F.lit(1)).alias("docs"), F.min_by("_key", order).alias("_first")).where(
            F.col("docs") >= variable_docs).select("_group", "_first")
        of_group = grouped.join(groups, "_group").select(
            "_leaf", "_line", F.lit(1).alias("_rank"), F.xxhash64(F.lit("leaf"), "_group").alias("template"), "_first")
        recurring = recurring.unionByName(of_group).groupBy("_leaf", "_line").agg(
            F.max_by(F.struct("template", "_first"), "_rank").alias("_of")).select("_leaf", "_line", "_of.template", "_of._first")
    return kept.join(recurring, ["_leaf", "_line"]).where(F.col("_key") != F.col("_first")).select("_key", "_pos", "template")


def drop_boilerplate(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with recurring lines removed from ``text``, and n_lines, n_dropped (in place of columns so named)."""
    key, out, split = unused(docs.columns, "_key", "_gone", "_split")
    gone = boilerplate(docs, **how).groupBy(F.col("_key").alias(key)).agg(F.collect_set("_pos").alias(out))  # of one document
    d = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(gone, key, "left").withColumn(split, F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), out)  # by hash, so long texts stay linear
    left = F.transform(stay, lambda i: F.get(split, i))
    return d.select(*[F.when(F.col(out).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text") if c == "text"
                      else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
                    F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
                    F.when(F.col(out).isNull(), 0).otherwise(F.size(out)).cast("long").alias("n_dropped"))
