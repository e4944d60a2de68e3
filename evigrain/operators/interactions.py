"""Captured interactions: folding events into records, training rows and preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_feedback(interactions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Interactions with the rating that came last, or none."""
    last = feedback.groupBy("interaction_id").agg(F.max_by("rating", "at").alias("rating"))
    return interactions.join(last, "interaction_id", "left")


def training_rows(interactions: DataFrame) -> DataFrame:
    """Completed interactions with an answer and messages; the answer becomes the last message."""
    done = interactions.filter("status = 'completed' AND coalesce(answer, '') <> '' AND size(messages) > 0")
    answer = F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text"))
    return done.select("interaction_id", F.array_append("messages", answer).alias("messages"), F.coalesce("rating", F.lit("")).alias("feedback"))


# What tells that a text quotes a user's own files.
PERSONAL = ("source_type': 'personal'", '"source_type": "personal"', "来源: personal")


def personal(*values: Column) -> Column:
    """Whether any of the texts, or of the texts in the arrays, quotes a user's own files."""
    some = F.lit(False)
    for v in values:
        low = F.lower(v)
        for mark in PERSONAL:
            some = some | F.coalesce(low.contains(mark), F.lit(False))
    return some


def preference_pairs(interactions: DataFrame) -> DataFrame:
    """Each answer rated up with each rated down for the same query. The pairs are the result asked for."""
    asked = interactions.filter("status = 'completed' AND coalesce(answer, '') <> ''").withColumn("query", F.lower(F.trim("query"))).filter("query <> ''")
    side = lambda rating, name: asked.filter(F.col("rating") == rating).select("query", F.col("interaction_id").alias(f"{name}_id"), F.col("answer").alias(name))
    return side("up", "chosen").join(side("down", "rejected"), "query")


def folded(turns: DataFrame) -> DataFrame:
    """One record per conversation: its messages in order, the first user text as query, the last assistant text as answer."""
    message = F.struct("turn", "role", "text")
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m"))
    answers = F.filter("m", lambda x: x["role"] == "assistant")
    asks = F.filter("m", lambda x: x["role"] == "user")
    last = F.get(F.col("m"), F.size("m") - 1)["role"]
    return ordered.select(
        F.col("conv_id").alias("interaction_id"),
        F.when(last == "assistant", "completed").otherwise("open").alias("status"),
        F.get(asks, F.lit(0))["text"].alias("query"),
        F.get(answers, F.size(answers) - 1)["text"].alias("answer"),
        F.transform(F.filter("m", lambda x: x["role"] != "assistant"), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages"),
    )
