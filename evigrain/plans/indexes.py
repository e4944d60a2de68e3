"""Queries over indexes that follow their input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evigrain.operators import ranking
from evigrain.plans.registry import query, table
from evigrain.plans.retrieval import BM25, WORDS
from evigrain.sources import segments, store

FILES, EARLIER = 16, 5
#: Documents in a file of a bucket, at most: a file's content is digested in one piece.
ROWS = 2_000


@query("m01_incremental_bm25", f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM bm")
def incremental_bm25(spark, d):
    """The documents as files of buckets, each of bounded size; the index is built when some buckets hold other texts, one is missing and one more is
    there, and then follows. Only postings of those buckets are written anew, and the scores are those of a full build."""
    home = f"{store._steps(spark)}/incremental-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", "text", F.coalesce(F.pmod("doc_id", F.lit(FILES)), F.lit(0)).alias("bucket"))

    def put(rows):
        # Where they are read: texts don't move, and no task has a bucket to itself.
        rows.write.option("maxRecordsPerFile", ROWS).partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{home}/in")

    def update():
        read = lambda files: spark.read.schema("doc_id long, text string").parquet(*(files if files is not None else [f"{home}/in"])).select(F.col("_metadata.file_path").alias("file"), F.col("doc_id").alias("key"), "text")
        return segments.update(spark, f"{home}/index", segments.digests(spark, f"{home}/in", "*.parquet"), read)

    twice = docs.filter("bucket <> 1").withColumn("bucket", F.explode(F.when(F.col("bucket") == 2, F.array("bucket", F.lit(FILES))).otherwise(F.array("bucket"))))
    put(twice.withColumn("text", F.when(F.col("bucket") < EARLIER, F.concat(F.lit("the earlier words of "), F.reverse("text"))).otherwise(F.col("text"))))
    update()
    put(docs.filter(F.col("bucket") < EARLIER))
    segments._delete(spark, f"{home}/in/bucket={FILES}")
    update()
    # The index holds all that a search asks for.
    segments._delete(spark, f"{home}/in")
    return ranking.bm25(segments.index(spark, f"{home}/index"), WORDS, "key").select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))
