"""Evidence fusion: one row per source for coverage, the rest by score, duplicates out, stable numbers.

Rows are (source, pos, key, score): pos is the rank within the source, key the identity. A fused result has at most
top_k rows, so the ordered windows over it are bounded by top_k; the input is only ranked within its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evigrain.sources import store


def fused(rows: DataFrame, top_k: int) -> DataFrame:
    """rows with place: the best of each source (sources in order), then by score, cut to top_k, then without
    rows whose key is empty or came before. Cutting comes first, so fewer than top_k may be left.

    The best of a source is a minimum, and of all rows only the 2 top_k of the highest scores can fill the rest."""
    own = rows.columns
    cover = rows.groupBy("source").agg(F.min_by(F.struct(*own), "pos").alias("r")).select("r.*").orderBy("source").limit(top_k)
    high = rows.orderBy(F.desc("score"), "source", "pos").limit(2 * top_k)
    rest = high.join(F.broadcast(cover.select("source", "pos")), ["source", "pos"], "left_anti").select(*own)
    order = lambda a, s: F.struct(F.lit(a).alias("a"), s.cast("double").alias("s"), F.col("source").alias("o"), F.col("pos").alias("p"))
    both = cover.withColumn("_order", order(0, F.lit(0.0))).unionByName(rest.withColumn("_order", order(1, -F.col("score"))))
    cut = both.orderBy("_order").limit(top_k)
    seen = cut.filter("key <> ''").groupBy("key").agg(F.min_by(F.struct(*own, "_order"), "_order").alias("r")).select("r.*")
    return seen.withColumn("place", F.row_number().over(W.orderBy("_order"))).select(*own, "place")


def deduplicated(rows: DataFrame, order: Column) -> DataFrame:
    """The first row of each key in ascending order; rows without a key go. A minimum, aggregated before the shuffle."""
    return rows.filter("key <> ''").groupBy("key").agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def running(rows: DataFrame, order: str, size: Column) -> DataFrame:
    """rows with before: the sum of `size` over the rows that come earlier in the order, without one task for all.

    The rows are range-sorted and written; each range sums up its own rows, and only the ranges' totals, a number
    each, reach the driver."""
    spark = rows.sparkSession
    ranges = rows.select("*", size.alias("_size")).repartitionByRange(order).sortWithinPartitions(order)
    placed = store.cut(ranges.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")))
    before, starts = 0, []
    for r, n in sorted((r[0], r[1]) for r in placed.groupBy("_range").agg(F.sum("_size")).collect()):
        starts.append((r, before))
        before += n or 0
    inner = F.sum("_size").over(W.partitionBy("_range").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)) - F.col("_size")
    offsets = F.broadcast(spark.createDataFrame(starts, "_range int, _start long"))
    return placed.join(offsets, "_range").withColumn("before", (F.col("_start") + inner).cast("long")).select(*rows.columns, "before")


def numbered(packets: DataFrame) -> DataFrame:
    """Citation numbers by the first appearance of a key in (packet, pos) order; later appearances reuse theirs."""
    first = packets.filter("key <> ''").groupBy("key").agg(F.min(F.struct("packet", "pos")).alias("first"))
    numbers = running(first, "first", F.lit(1)).select("key", (F.col("before") + 1).alias("number"))
    return packets.join(numbers, "key")
