"""Joins on keys of which a few may have very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrain.sources import store

#: A key is heavy if it has more than one in so many of all rows; so there are fewer heavy keys than that.
SHARE = 512


def spread_join(rows: DataFrame, side: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with side, which has each key once. Rows of a heavy key are spread over as many parts as they are times
    too many, and side's row is there in each; the heavy keys are few by definition and are broadcast."""
    total = rows.count()
    n = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") * SHARE > total)
    heavy = F.broadcast(store.cut(n.select(key, F.ceil(F.col("_n") * SHARE / max(total, 1)).cast("int").alias("_parts"))))
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.join(heavy, key, "left").withColumn("_part", F.pmod(F.xxhash64(*rows.columns), parts).cast("int")).drop("_parts")
    right = side.join(heavy, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right.hint("merge"), [key, "_part"], how).drop("_part")
