"""Cleaning pipeline over ``documents``: each stage calls one operator of ``segspark.llm``.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read back as the next
one's ``docs``; all but the last return the columns of ``documents``. Null or
repeated ids, empty texts, further columns and empty tables behave as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm import decontaminate, line_templates, ngram_join, packing, toxicity
from segspark.llm.shared import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity model, trained as in ``op9``, scores below 0.3."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of templates that recur across documents; ``n_chars`` follows the text."""
    kept = line_templates.drop_boilerplate(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                               .otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with similarity 0.8 or more."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in benchmark windows."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of the sequences of 4096 ids."""
    return packing.pack(docs, end_id=2, length=4096)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_template_lines), ("ngram_jaccard", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("packing", pack)]

#: The classifier and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
