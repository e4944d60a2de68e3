"""Queries over staged chains and queues."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evigrain.operators import runs
from evigrain.plans.registry import query, table
from evigrain.sources import store
from evigrain.streaming import queue

_DNA = "upper(translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'))"
_CHAIN = f"""g AS (SELECT p_partkey, p_size, CASE WHEN p_size % 5 <> 4 THEN 'AC' || p_partkey END AS accession, {_DNA} || CASE WHEN p_size % 7 = 0 THEN 'N' ELSE '' END AS sequence FROM part),
t AS (SELECT *, regexp_extract(sequence, '([ACGT]{{20}})[ACGT]GG', 1) AS target FROM g),
c AS (SELECT p_partkey, CASE WHEN accession IS NULL THEN 'accession' WHEN contains(sequence, 'N') THEN 'sequence' WHEN target = '' THEN 'target' ELSE 'done' END AS stage, accession, target FROM t)"""


def _staged(spark, d):
    dna = _DNA.replace("VARCHAR", "STRING")
    named = lambda df: df.withColumn("accession", F.expr("CASE WHEN p_size % 5 <> 4 THEN 'AC' || CAST(p_partkey AS STRING) END")).withColumn("error", F.when(F.col("accession").isNull(), "no accession"))
    read = lambda df: df.withColumn("sequence", F.expr(f"{dna} || CASE WHEN p_size % 7 = 0 THEN 'N' ELSE '' END")).withColumn("error", F.when(~F.col("sequence").rlike("^[ACGT]+$"), "unknown bases"))
    aimed = lambda df: df.withColumn("target", F.regexp_extract("sequence", "([ACGT]{20})[ACGT]GG", 1)).withColumn("error", F.when(F.col("target") == "", "no target"))
    written = lambda df: df.withColumn("protocol", F.concat(F.lit("# "), "accession", F.lit("\ncut "), "target")).withColumn("error", F.lit(None).cast("string"))
    stages = [runs.Stage(n, f) for n, f in (("accession", named), ("sequence", read), ("target", aimed), ("protocol", written))]
    return runs.chain(table(spark, d, "part").select("p_partkey", "p_size"), stages, f"{store.root_of(spark)}/chain-{uuid.uuid4().hex}")


@query(
    "x14_chain",
    f"WITH {_CHAIN} SELECT p_partkey, stage, CASE stage WHEN 'accession' THEN 'no accession' WHEN 'sequence' THEN 'unknown bases' WHEN 'target' THEN 'no target' END AS error, "
    "CASE WHEN stage = 'done' THEN '# ' || accession || chr(10) || 'cut ' || target END AS protocol FROM c",
)
def chain(spark, d):
    """From a gene to its protocol in four stages; a row that fails stops alone and says where and why."""
    return _staged(spark, d).select("p_partkey", "stage", "error", "protocol")


@query("x14_by_stage", f"WITH {_CHAIN} SELECT stage, CASE stage WHEN 'accession' THEN 'no accession' WHEN 'sequence' THEN 'unknown bases' WHEN 'target' THEN 'no target' END AS error, count(*)::BIGINT AS n FROM c GROUP BY 1, 2")
def by_stage(spark, d):
    return runs.by_stage(_staged(spark, d))


def _jobs(spark, d):
    """Events as those of queues: a user's queue, kinds and workers by number."""
    n = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("submit", "lease", "submit", "done", "lease", "failed"))), (F.pmod(F.hash(n), F.lit(6)) + 1).cast("int"))
    force = (F.pmod(F.hash(n, F.lit(1)), F.lit(5)) == 0).alias("force")
    more = (F.concat(F.lit("j"), n % 4).alias("job"), F.concat(F.lit("w"), n % 2).alias("worker"), force, F.col("event_type").alias("reason"))
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("queue"), F.col("ts").cast("timestamp").alias("at"), n.alias("id"), kind.alias("kind"), *more)


@query("st6_queue")
def queues(spark, d):
    """What happened in each user's queue of jobs."""
    return queue.folded(_jobs(spark, d)).withColumn("at", F.col("at").cast("timestamp_ntz"))
