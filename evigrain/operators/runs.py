"""Runs that fail in parts: tasks with retries whose results are kept as they come, and chains of stages in which a failing row
stops alone."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from evigrain.operators import evaluation
from evigrain.sources import store

RESULT = "question long, answer string, score double, max_score double, status string, error string, attempts int"
#: Questions whose results are kept together.
BATCH = 1000


def tried(task: Callable[[dict], dict], row: dict, retries: int, delay: float) -> tuple[dict, int]:
    """What the task gives, and at which attempt; after a failure it waits delay, then twice as long, and so on."""
    for attempt in range(retries + 1):
        try:
            return task(row), attempt + 1
        except MemoryError:
            raise
        except Exception:
            if attempt == retries:
                raise
            time.sleep(delay * 2**attempt)
    raise AssertionError


def evaluated(questions: DataFrame, task: Callable[[dict], dict], retries: int = 2, delay: float = 1.0) -> DataFrame:
    """A result row for each question (question, ... and max_score, if there is one). A task that fails to the end gives a row
    with its error, no answer and no points."""

    schema = to_arrow_schema(StructType.fromDDL(RESULT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                base = {"question": row["question"], "answer": "", "score": 0.0, "max_score": float(row.get("max_score") or 0.0), "status": "completed", "error": None}
                try:
                    told, n = tried(task, row, retries, delay)
                    out.append(base | {k: v for k, v in told.items() if k in base} | {"attempts": n})
                except MemoryError:
                    raise
                except Exception as e:
                    out.append(base | {"status": "runner_error", "error": str(e), "attempts": retries + 1})
            yield pa.RecordBatch.from_pylist(out, schema)

    return questions.mapInArrow(run, RESULT)


def _runs(spark: SparkSession, folder: str) -> list[str]:
    path, fs = store._fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("run=")) if fs.exists(path) else []


def kept(spark: SparkSession, folder: str) -> DataFrame:
    """The results of all runs; of a question's several ones the last run's. A batch counts once it is whole."""
    found = []
    for run in _runs(spark, folder):
        path, fs = store._fs(spark, f"{folder}/{run}")
        found += [f"{folder}/{run}/{s.getPath().getName()}" for s in fs.listStatus(path) if fs.exists(store._fs(spark, f"{folder}/{run}/{s.getPath().getName()}/_SUCCESS")[0])]
    if not found:
        return spark.createDataFrame([], RESULT + ", run int")
    rows = spark.read.option("basePath", folder).schema(RESULT + ", run int").parquet(*found).select(*[c.split()[0] for c in RESULT.split(", ")], "run")
    return evaluation.latest(rows, ["question"], F.col("run"))


def run(questions: DataFrame, task: Callable[[dict], dict], folder: str, retries: int = 2, delay: float = 1.0, batch: int = BATCH, resume: bool = True, retry_failed: bool = False) -> DataFrame:
    """Evaluate the questions that have no result yet under folder (retry_failed: or a failed one), and give all results.

    A run works in batches by a hash of the question; each is a job that writes its results when it is done, to a place
    of its own, so a batch that is repeated replaces itself and one that is broken off leaves nothing. A later run
    goes on with what is left."""
    spark = questions.sparkSession
    done = kept(spark, folder) if resume else spark.createDataFrame([], RESULT + ", run int")
    todo = store.cut(evaluation.remaining(questions, _by_outcome(done), retry_failed))
    n = -(-todo.count() // batch)
    number = 1 + max([0, *(int(r.split("=")[1]) for r in _runs(spark, folder))])
    for k in range(n):
        part = todo.filter(F.pmod(F.xxhash64("question"), F.lit(n)) == k)
        evaluated(part, task, retries, delay).write.mode("overwrite").parquet(f"{folder}/run={number}/batch={k}")
    return kept(spark, folder)


def _by_outcome(done: DataFrame) -> DataFrame:
    """Results as the evaluation's rules for failures read them."""
    return done.withColumn("detail", F.lit("").cast("string"))


class Stage(NamedTuple):
    """A name, and what makes of rows the same rows with more columns and `error`, null where all went well."""

    name: str
    apply: Callable[[DataFrame], DataFrame]


def attempted(work: Callable[[dict], dict], schema: str) -> Callable[[DataFrame], DataFrame]:
    """A stage's work from a function of a row, whose exceptions become the row's error. schema: the columns that it adds."""

    def apply(rows: DataFrame) -> DataFrame:
        added = StructType.fromDDL(schema)
        own = rows.drop(*added.names, "error")
        whole = StructType([*own.schema.fields, *added.fields, StructField("error", StringType())])
        told = to_arrow_schema(whole)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    try:
                        out.append(row | work(row) | {"error": None})
                    except MemoryError:
                        raise
                    except Exception as e:
                        out.append(row | {"error": f"{type(e).__name__}: {e}"})
                yield pa.RecordBatch.from_pylist(out, told)

        return own.mapInArrow(run, whole)

    return apply


def chain(rows: DataFrame, stages: list[Stage], folder: str) -> DataFrame:
    """All rows with stage and error: where a row stopped and why, or `done` and null, with what it had by then.

    Each stage's rows are written under folder; a chain that was broken off goes on behind its last whole stage."""
    spark, alive, out = rows.sparkSession, rows, None
    for i, stage in enumerate(stages):
        path = f"{folder}/{i}-{stage.name}"
        marker, fs = store._fs(spark, f"{path}/_SUCCESS")
        if not fs.exists(marker):
            stage.apply(alive).write.mode("overwrite").parquet(path)
        here = spark.read.parquet(path)
        failed = here.filter("error IS NOT NULL").withColumn("stage", F.lit(stage.name))
        out = failed if out is None else out.unionByName(failed, allowMissingColumns=True)
        alive = here.filter("error IS NULL").drop("error")
    done = alive.withColumn("error", F.lit(None).cast("string")).withColumn("stage", F.lit("done"))
    return done if out is None else out.unionByName(done, allowMissingColumns=True)


def by_stage(told: DataFrame) -> DataFrame:
    """How many rows stopped at each stage, for each reason."""
    return told.groupBy("stage", "error").agg(F.count("*").alias("n"))
