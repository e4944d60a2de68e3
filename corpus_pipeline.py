"""A corpus pipeline of four stages: quality rules, line dedup, MinHash near-dedup, packing.

Each stage takes the documents that its predecessor kept and works on all of them. run() applies the stages to
the table `documents` one after another; between stages the documents are a Parquet table in the folder that
the cluster shares (spark.checkpoint.dir), so a lost executor never costs more than the running stage. Once a
stage's result is written, the tables that it wrote on its way are deleted, and so is its predecessor's result.

SQL can't express the near-dedup of texts that line dedup has changed, nor packing; ORACLE_SQL is None, and
tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.llm import line_templates, minhash_dedup, packing, quality_rules
from evigrain.llm.bpe import public_path
from evigrain.llm.shared import settled, ship, table

#: Near-duplicates: shingles of so many words, and this Jaccard similarity in hundredths.
SHINGLE, SIMILAR = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    ship(spark)
    return quality_rules.filtered(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, and documents of which nothing is left; n_chars follows the text."""
    ship(spark)
    out = line_templates.deduplicated(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id."""
    ship(spark)
    return minhash_dedup.deduplicated(docs, SHINGLE, SIMILAR)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in sequences for training: one row for each piece, with its ids."""
    ship(spark)
    return packing.packed(docs, public_path(), with_ids=True)


STAGES = [("quality_rules", quality), ("line_dedup", line_dedup), ("minhash_dedup", near_dedup), ("packing", pack)]
ORACLE_SQL = None


def after(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The documents that the first n stages keep."""
    if n == 0:
        return table(spark, sf_dir, "documents")
    name, stage = STAGES[n - 1]
    # A stage's input is among the tables that are written on the way to its result.
    return settled(spark, lambda: stage(spark, after(spark, sf_dir, n - 1), sf_dir), name)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STAGES[-1][1](spark, after(spark, sf_dir, len(STAGES) - 1), sf_dir)
