"""Ranking: BM25, dense similarity, schema-weighted keywords, reciprocal rank fusion.

The corpus side is never collected; a query is a few terms or one vector. Scores are aggregated by partial
sums, and the only sort is the final top-k.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evigrain.functions import text as T
from evigrain.sources import store

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60


def term_counts(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, term, tf; rows without tokens don't show."""
    return docs.select(key, F.explode(T.tokens(column)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def doc_lengths(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    return docs.select(key, F.size(T.tokens(column)).cast("long").alias("dl"))


def inverse_frequencies(tf: DataFrame, n_docs: int) -> DataFrame:
    """term, df, idf: negative values become a quarter of the mean over the vocabulary."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.withColumn("raw", F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


class Index(NamedTuple):
    """What BM25 asks of a corpus: postings (key, term, tf, dl), terms (term, df, idf) and stats (n, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def counted(w: Column) -> Column:
    """An array of tokens as array of struct(term, tf, dl, first), sorted by term; one without tokens has one entry without a
    term. first marks one entry of each row."""
    bound = lambda value, body: F.transform(F.array(value), body)[0]

    def starts(a: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1)))

    def told(a: Column, at: Column) -> Column:
        end = lambda i: F.coalesce(F.get(at, i + 1), F.size(a))
        one = lambda x, i: F.struct(F.get(a, x).alias("term"), (end(i) - x).cast("long").alias("tf"), F.size(a).cast("long").alias("dl"), (i == 0).alias("first"))
        return F.transform(at, one)

    none = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf"), F.lit(0).cast("long").alias("dl"), F.lit(True).alias("first")))
    return bound(F.sort_array(w), lambda a: F.when(F.size(a) == 0, none).otherwise(bound(starts(a), lambda at: told(a, at))))


def index_tables(docs: DataFrame, key: str = "doc_id", column: str = "text") -> dict[str, DataFrame]:
    """The tables of an index, to be written: postings and terms are sorted by term within ranges of terms, so that a
    search reads the row groups of its terms only.

    A text's terms are counted inside its row, so only the sort by term moves them; keys that several rows have are then
    put together, if there are any."""
    each = store.cut(docs.select(key, F.inline(counted(T.tokens(column)))))
    postings = each.filter("term IS NOT NULL").select(key, "term", "tf", "dl")
    if not each.filter("first").groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        postings = store.cut(postings.groupBy(key, "term").agg(F.sum("tf").alias("tf"), F.any_value("dl").alias("dl")))
    stats = each.filter("first").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    # Counted once: the mean, the terms and their sort's sample read it.
    df = store.cut(postings.groupBy("term").agg(F.count("*").alias("df")))
    raw = df.join(F.broadcast(stats.select("n"))).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    terms = raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    by_term = lambda t: t.repartitionByRange("term").sortWithinPartitions("term")
    return {"postings": by_term(postings), "terms": by_term(terms), "stats": stats}


def bm25(docs: DataFrame | Index, query: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, score for documents that hold a query term. A repeated query term counts again, unless it repeats at once.

    If no score is positive, the score is the plain count of the distinct query terms. docs: an index that was
    built before, or a table, whose index is then computed on the way. The query's terms reach the scan."""
    index = docs if isinstance(docs, Index) else Index(**index_tables(docs, key, column))
    spark = index.postings.sparkSession
    wanted = Counter(spark.range(1).select(T.tokens(F.lit(query)).alias("w")).first()["w"])
    if not wanted:
        return index.postings.limit(0).select(key, F.lit(0.0).alias("score"))
    avgdl = index.stats.first()["avgdl"]
    idf = {r["term"]: r["idf"] for r in index.terms.filter(F.col("term").isin(list(wanted))).collect()}
    of = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("term")]
    hits = index.postings.filter(F.col("term").isin(list(idf)))
    if not idf:
        return hits.select(key, F.lit(0.0).alias("score"))
    weight = of(idf) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(avgdl or 1))))
    # Term by term in the query's order: a sum of doubles in the order of arrival would part copies of a text in their last digit.
    each = [F.coalesce(F.sum(F.when(F.col("term") == t, weight * of(dict(wanted)))), F.lit(0.0)) for t in wanted if t in idf]
    scored = hits.groupBy(key).agg(reduce(add, each).alias("weighted"), F.sum("tf").cast("double").alias("plain"))
    best = scored.agg((F.max("weighted") > 0).alias("some"))
    return scored.join(F.broadcast(best)).select(key, F.when(F.col("some"), F.col("weighted")).otherwise(F.col("plain")).alias("score"))


def top(scored: DataFrame, k: int, *order: Column, positive: bool = False) -> DataFrame:
    out = scored.orderBy(*order).limit(k)
    return out.filter("score > 0") if positive else out


def norm(c: str) -> Column:
    return F.sqrt(F.aggregate(F.transform(c, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))


def dot(c: str, vector: list[float]) -> Column:
    return F.aggregate(F.zip_with(c, F.array(*map(F.lit, vector)), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)


def dense(vectors: DataFrame, query: list[float], epsilon: float = 0.0) -> DataFrame:
    """vectors with score: the cosine with the query; a zero denominator counts as 1."""
    if not query or any(x != x or x in (float("inf"), float("-inf")) for x in query):
        raise ValueError("the query vector must be finite and not empty")
    size = sum(x * x for x in query) ** 0.5
    below = norm("embedding") * size + epsilon
    return vectors.withColumn("score", dot("embedding", query) / F.when(below == 0, 1.0).otherwise(below))


def rrf(lists: list[tuple[DataFrame, float]], key: str = "id", k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists (key, rank from 1); ties: the first list, then the rank in it."""
    rows = None
    for i, (df, weight) in enumerate(lists):
        one = df.select(key, F.col("rank"), F.lit(i).alias("list"), (F.lit(float(weight)) / (k + F.col("rank"))).alias("part"))
        rows = one if rows is None else rows.unionByName(one)
    # List by list, as above.
    each = [F.coalesce(F.sum(F.when(F.col("list") == i, F.col("part"))), F.lit(0.0)) for i in range(len(lists))]
    return rows.groupBy(key).agg(reduce(add, each).alias("score"), F.min(F.struct("list", "rank")).alias("first"))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """rank from 1 over a result that a limit has bounded."""
    return df.withColumn("rank", F.row_number().over(W.orderBy(*order)))
