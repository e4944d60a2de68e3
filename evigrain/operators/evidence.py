"""Evidence as rows: (source, pos, title, doi, pmid, url, journal, gene_name, content, score), citations, prompts, answers."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.functions import text as T
from evigrain.sources import store

# How many rows each source may give, by mode.
BUDGETS = {"normal": {"pubmed": 6, "gene": 12, "graph": 4, "personal": 8}, "deep": {"pubmed": 12, "gene": 20, "graph": 8, "personal": 12}}
#: A citation mark in an answer.
MARK = r"\[(\d+)\]"


def derived_url(doi: str, pmid: str, url: str) -> Column:
    """A row's own url, else that of its DOI, else that of its PMID."""
    u, d, p = T.url(url), T.doi(doi), T.pmid(pmid)
    return F.when(u != "", u).when(d != "", F.concat(F.lit("https://doi.org/"), d)).when(p != "", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), p, F.lit("/"))).otherwise("")


def tool_index(source_id: str) -> Column:
    """The number that a citation has in the text; 0 where its id is no number."""
    c = F.col(source_id).cast("string")
    return F.when(c.rlike(r"^\d+$"), c.try_cast("long")).otherwise(F.lit(0).cast("long"))


def prompt_block(**columns: str) -> Column:
    """A row as text: number and title, source, what is known of gene, journal, DOI, PMID and url, then the content."""
    c = lambda k: F.coalesce(F.col(columns[k]).cast("string"), F.lit("")) if k in columns else F.lit("")
    # The labels of the lines.
    told = [F.when(c(k) != "", F.concat(F.lit(f"{label}: "), c(k))) for k, label in (("gene_name", "基因"), ("journal", "期刊"), ("doi", "DOI"), ("pmid", "PMID"), ("url", "链接"))]
    return F.concat_ws("\n", F.concat(F.lit("["), c("source_id"), F.lit("] "), c("title")), F.concat(F.lit("来源: "), c("source")), *told, F.concat(F.lit("内容: "), c("content")))


def within_budget(rows: DataFrame, mode: str) -> DataFrame:
    """The rows (source, pos from 1) of each source up to its budget; a source without a budget gives none."""
    budget = BUDGETS["deep" if mode == "deep" else "normal"]
    most = F.lit(0)
    for source, n in budget.items():
        most = F.when(F.col("source") == source, n).otherwise(most)
    return rows.filter(F.col("pos") <= most)


def source_counts(rows: DataFrame, sources: list[str]) -> DataFrame:
    """source, n and a warning for each source that gave nothing."""
    all_ = rows.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    n = F.coalesce("n", F.lit(0)).cast("long")
    counted = all_.join(rows.groupBy("source").agg(F.count("*").alias("n")), "source", "left").select("source", n.alias("n"))
    return counted.withColumn("warning", F.when(F.col("n") == 0, F.concat("source", F.lit(" returned nothing"))))


ROWS = "source string, pos long, key string, score double, title string"


def together(sources: dict) -> tuple[DataFrame, DataFrame]:
    """The rows of all sources, each a function that gives its rows (pos, key, score, title), and a row for each source: its state,
    how many rows it gave, and its error.

    Each source is a job of its own, all at once, and its result is a written table. Whatever fails, in setting a source
    up or in one of its tasks after Spark's own retries, costs that source only. Memory running out is no answer of a
    source: it ends the search."""
    spark = SparkSession.active()

    def one(name: str, rows) -> tuple[str, DataFrame | None, str | None]:
        try:
            return name, store.cut(rows().select(F.lit(name).alias("source"), F.col("pos").cast("long"), F.col("key").cast("string"), F.col("score").cast("double"), "title")), None
        except MemoryError:
            raise
        except Exception as e:
            return name, None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"

    with ThreadPoolExecutor(max(1, len(sources))) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(lambda x: one(*x)), sources.items()))
    out = spark.createDataFrame([], ROWS)
    for _, found, _ in done:
        out = out if found is None else out.unionByName(found)
    states = spark.createDataFrame([(n, "failed" if f is None else "answered", 0 if f is None else f.count(), e) for n, f, e in done], "source string, state string, n long, error string")
    return out, states


def mentioned(answers: DataFrame, key: str = "id", column: str = "answer") -> DataFrame:
    """key, number, first: the numbers that an answer cites, and where each is first."""
    marks = F.posexplode(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(MARK), F.lit(1))).alias("at", "n")
    return answers.select(key, marks).select(key, "at", F.col("n").try_cast("long").alias("number")).filter("number IS NOT NULL").groupBy(key, "number").agg(F.min("at").alias("first"))


def cited(citations: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """The citations (key, number) that their answer cites; all of an answer's citations where it cites none of them."""
    hit = citations.join(mentioned(answers, key).select(key, "number"), [key, "number"], "left_semi")
    return hit.unionByName(citations.join(hit.select(key).distinct(), key, "left_anti"))


def renumbered(citations: DataFrame, answers: DataFrame, key: str = "id", column: str = "answer") -> tuple[DataFrame, DataFrame]:
    """Answers and citations with numbers from 1 by first mention; marks of unknown citations stay as they are."""
    known = mentioned(answers, key, column).join(citations.select(key, "number").distinct(), [key, "number"], "left_semi")
    order = known.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "number"))), lambda x: x["number"]).alias("order"))
    place = lambda n: F.array_position("order", n)
    # Text between marks and marks alternate.
    parts = F.split(F.col(column), MARK)
    numbers = F.regexp_extract_all(column, F.lit(MARK), F.lit(1))
    mark = lambda n: F.concat(F.lit("["), F.coalesce(F.nullif(place(n.try_cast("long")), F.lit(0)).cast("string"), n), F.lit("]"))
    new = F.concat_ws("", F.flatten(F.transform(parts, lambda p, i: F.array(p, F.coalesce(mark(F.get(numbers, i)), F.lit(""))))))
    told = answers.join(order, key, "left").withColumn(column, F.when(F.col("order").isNull(), F.col(column)).otherwise(new)).select(*answers.columns)
    moved = citations.join(order, key, "left").withColumn("place", F.when(F.col("order").isNull(), F.col("number")).otherwise(place(F.col("number"))))
    return told, moved.filter("place > 0").select(*[F.col("place").cast("long").alias("number") if c == "number" else F.col(c) for c in citations.columns])
