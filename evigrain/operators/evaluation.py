"""Evaluation analytics over result rows (question, agent, version, score, max_score, status, error, detail, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Statuses that say by themselves that a row failed.
FAILURES = ("agent_error", "judge_error", "runner_error")


def failure_type(status="status", error="error", detail="detail") -> Column:
    """Why a row can't be scored, or null: its status, else its detail's prefix, else any error text."""
    s, e, t = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in (status, error, detail))
    return F.when(s.isin(*FAILURES), s).when(t.startswith("Agent 失败:"), "agent_error").when(t.startswith("Judge 失败:"), "judge_error").when(e != "", "runner_error")


def parsed_time(c: str) -> Column:
    """ISO text with or without Z, a date, or seconds since 1970; null if none fits."""
    t = F.col(c).cast("string")
    return F.coalesce(F.when(t.rlike(r"^\d+(\.\d+)?$"), F.timestamp_seconds(t.try_cast("double"))), t.try_cast("timestamp"))


def selected(df: DataFrame, agent=None, version=None, after=None, before=None, least=None, most=None) -> DataFrame:
    """Rows in the bounds: ids inclusive, after inclusive, before exclusive. A time that can't be read stays; a
    null id goes if ids are bounded."""
    keep = F.lit(True)
    for column, value in (("agent", agent), ("version", version)):
        if value is not None:
            keep = keep & (F.col(column) == value)
    if after is not None:
        keep = keep & (parsed_time("ts").isNull() | (parsed_time("ts") >= F.lit(after).cast("timestamp")))
    if before is not None:
        keep = keep & (parsed_time("ts").isNull() | (parsed_time("ts") < F.lit(before).cast("timestamp")))
    if least is not None:
        keep = keep & (F.col("question") >= least)
    if most is not None:
        keep = keep & (F.col("question") <= most)
    return df.filter(keep)


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key. A maximum by order, so it is aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return df.groupBy(*keys).agg(row).select(*keys, "r.*").select(*df.columns)


def statistics(df: DataFrame, *by: str) -> DataFrame:
    """Totals of scored rows; failed rows count, but not as zero. A score of zero is a score."""
    marked = df.withColumn("_failed", failure_type().isNotNull())
    ok = ~F.col("_failed")
    sums = marked.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("valid"),
        F.sum(F.when(ok, F.coalesce("score", F.lit(0.0)))).alias("s"),
        F.sum(F.when(ok, F.coalesce("max_score", F.lit(0.0)))).alias("m"),
    )
    percent = lambda a, b: F.format_string("%.2f%%", F.when(b > 0, a / b * 100).otherwise(0.0))
    s, m = F.coalesce("s", F.lit(0.0)), F.coalesce("m", F.lit(0.0))
    mean = F.round(F.when(F.col("valid") > 0, s / F.col("valid")).otherwise(0.0), 2)
    return sums.select(*by, "total", "valid", (F.col("total") - F.col("valid")).alias("failed"), percent(F.col("valid"), F.col("total")).alias("success_rate"), F.round(s, 2).alias("score"), F.round(m, 2).alias("max_score"), mean.alias("mean_score"), percent(s, m).alias("score_rate"))


def remaining(questions: DataFrame, done: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Questions without a result; with retry_failed, those whose result failed as well."""
    settled = done.filter(failure_type().isNull()) if retry_failed else done
    return questions.join(settled.select("question").distinct(), "question", "left_anti")


def clamped_total(items: str) -> Column:
    """The sum of rubric points of an array of struct(points, most), each held between 0 and most."""
    return F.round(F.aggregate(items, F.lit(0.0), lambda a, x: a + F.greatest(F.lit(0.0), F.least(x["points"], x["most"]))), 4)


def checkpoint_status(done: DataFrame, questions: DataFrame) -> DataFrame:
    """One row: results, completed and failed ones, and the questions without a result."""
    failed = failure_type().isNotNull()
    n = done.agg(F.count("*").alias("total"), F.count_if(~failed).alias("completed"), F.count_if(failed).alias("failed"))
    left = questions.join(done.select("question").distinct(), "question", "left_anti").agg(F.count("*").alias("remaining"))
    return n.join(F.broadcast(left))


def result_rows(answers: DataFrame) -> DataFrame:
    """question, status and score for (question, answer, judged); without an answer the agent failed, without a judgement the judge."""
    status = F.when(F.coalesce("answer", F.lit("")) == "", "agent_error").when(F.col("judged").isNull(), "judge_error").otherwise("completed")
    return answers.select("question", status.alias("status"), F.when(status == "completed", F.col("judged")).otherwise(0.0).alias("score"))


def checkpoint_names(files: DataFrame) -> DataFrame:
    """agent and version of checkpoint files agent_version.jsonl; the last underscore parts them."""
    stem = F.regexp_replace("file", r"\.jsonl$", "")
    return files.select(F.regexp_extract(stem, "^(.*)_[^_]*$", 1).alias("agent"), F.regexp_extract(stem, "^.*_([^_]*)$", 1).alias("version"))


# Fixed value: how a judgement marks an item and its points.
MARK = r"(?U)采分点\s*(\d+)\s*[:：]\s*(-?\d+(?:\.\d+)?)\s*分"


def rubric_points(rows: DataFrame, key: str, detail: str) -> DataFrame:
    """key, item, points of each item that a judgement's detail marks; of a repeated item the last points."""
    marks = F.regexp_extract_all(detail, F.lit(MARK), F.lit(0))
    each = rows.select(key, F.posexplode(marks).alias("at", "mark"))
    each = each.select(key, "at", F.regexp_extract("mark", MARK, 1).cast("int").alias("item"), F.regexp_extract("mark", MARK, 2).cast("double").alias("points"))
    return each.groupBy(key, "item").agg(F.max_by("points", "at").alias("points"))
