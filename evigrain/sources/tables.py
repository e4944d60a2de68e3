"""Small formats as sources and sinks: lines of JSON, tab-separated and comma-separated tables, graphs, HTML tables, XML records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str) -> int:
    """Write rows as lines of JSON and return how many there were, which Spark counts while it writes."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def questions(spark: SparkSession, path: str, schema: str, body: str = "body", limit: int | None = None) -> DataFrame:
    """Questions from lines of JSON; those without a body are left out."""
    rows = spark.read.schema(schema).json(path).filter(F.trim(F.coalesce(body, F.lit(""))) != "")
    return rows if limit is None else rows.limit(limit)


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results from lines of JSON; blank lines and lines that don't parse are left out."""
    read = spark.read.schema(f"{schema}, _broken STRING").option("columnNameOfCorruptRecord", "_broken").json(path)
    return read.filter("_broken IS NULL").drop("_broken")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def gene_table(spark: SparkSession, path: str) -> DataFrame:
    """gene and species of a tab-separated table with a head; rows without a gene are left out."""
    rows = spark.read.option("sep", "\t").option("header", True).schema("gene STRING, species STRING").csv(path)
    return rows.select(F.trim("gene").alias("gene"), F.trim(F.coalesce("species", F.lit(""))).alias("species")).filter("gene <> ''")


def graph_tables(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, name) and edges (src, dst, relation) of two comma-separated tables; rows that lack a key are left out."""
    read = lambda path, schema: spark.read.option("header", True).schema(schema).csv(path)
    return read(nodes, "id STRING, type STRING, name STRING").dropna(subset=["id"]), read(edges, "src STRING, dst STRING, relation STRING").dropna(subset=["src", "dst"])


def export_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """A graph as node and edge tables, as an edge list, and as links by JSON."""
    nodes.write.mode("overwrite").option("header", True).csv(f"{folder}/nodes")
    edges.write.mode("overwrite").option("header", True).csv(f"{folder}/edges")
    edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.mode("overwrite").text(f"{folder}/edge_list")
    edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "relation").write.mode("overwrite").json(f"{folder}/links")


def _told(c) -> Column:
    """A name without control characters, as XML holds it."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return plain


def _in_order(parts: list[DataFrame], path: str) -> None:
    """Lines of parts one after another, each sorted, as text files whose names are in that order."""
    rows = None
    for i, part in enumerate(parts):
        one = part.select(F.lit(i).alias("part"), "key", "value")
        rows = one if rows is None else rows.unionByName(one)
    rows.orderBy("part", "key").select("value").write.mode("overwrite").text(path)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A directed graph as GraphML, in files that are one document when they are put together in the order of their names."""
    line = lambda *texts: nodes.sparkSession.createDataFrame([(f"{i:03}", t) for i, t in enumerate(texts)], "key string, value string")
    key = lambda i, end, name: f'<key id="{i}" for="{end}" attr.name="{name}" attr.type="string"/>'
    head = line('<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', key("d0", "node", "node_type"), key("d1", "edge", "edge_type"), '<graph edgedefault="directed">')
    data = lambda k, c: F.concat(F.lit(f'<data key="{k}">'), _told(F.col(c)), F.lit("</data>"))
    n = nodes.select(F.col("id").alias("key"), F.concat(F.lit('<node id="'), _told(F.col("id")), F.lit('">'), data("d0", "type"), F.lit("</node>")).alias("value"))
    e = edges.select(F.concat_ws("\u0001", "src", "dst", "relation").alias("key"), F.concat(F.lit('<edge source="'), _told(F.col("src")), F.lit('" target="'), _told(F.col("dst")), F.lit('">'), data("d1", "relation"), F.lit("</edge>")).alias("value"))
    _in_order([head, n, e, line("</graph>", "</graphml>")], path)


def write_gml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A directed graph as GML, in files as above. A node's number is a hash of its id."""
    line = lambda *texts: nodes.sparkSession.createDataFrame([(f"{i:03}", t) for i, t in enumerate(texts)], "key string, value string")
    number = F.conv(F.substring(F.sha1(F.col("id")), 1, 13), 16, 10)
    quoted = lambda c: F.concat(F.lit('"'), _told(c), F.lit('"'))
    n = nodes.select(F.col("id").alias("key"), F.concat(F.lit("  node [ id "), number, F.lit(" label "), quoted(F.col("id")), F.lit(" node_type "), quoted(F.col("type")), F.lit(" ]")).alias("value"))
    of = lambda c: F.conv(F.substring(F.sha1(F.col(c)), 1, 13), 16, 10)
    e = edges.select(F.concat_ws("\u0001", "src", "dst", "relation").alias("key"), F.concat(F.lit("  edge [ source "), of("src"), F.lit(" target "), of("dst"), F.lit(" edge_type "), quoted(F.col("relation")), F.lit(" ]")).alias("value"))
    _in_order([line("graph [", "  directed 1"), n, e, line("]")], path)


def listing(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """file, bytes and modified of a folder's files, the newest first; nothing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "file")


def html_rows(pages: DataFrame, column: str, least: int) -> DataFrame:
    """pages with cells: the texts of the cells of each table row that has `least` of them or more."""
    rows = F.explode(F.regexp_extract_all(column, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("_row")
    cells = F.transform(F.regexp_extract_all("_row", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", "")))
    return pages.select("*", rows).withColumn("cells", cells).filter(F.size("cells") >= least).drop("_row")


def articles(records: DataFrame, column: str) -> DataFrame:
    """records with title and abstract of an article's XML: parts with a label as `LABEL: text`, joined by line feeds."""
    part = "STRUCT<_Label: STRING, _VALUE: STRING>"
    schema = f"ArticleTitle STRING, Abstract STRUCT<AbstractText: ARRAY<{part}>>"
    read = records.withColumn("_x", F.from_xml(column, schema, {"rowTag": "Article"}))
    text = F.transform("_x.Abstract.AbstractText", lambda p: F.when(p["_Label"].isNotNull(), F.concat(p["_Label"], F.lit(": "), p["_VALUE"])).otherwise(p["_VALUE"]))
    told = F.array_join(text, "\n")
    return read.withColumn("title", F.col("_x.ArticleTitle")).withColumn("abstract", F.coalesce(F.nullif(told, F.lit("")), F.lit("(no abstract)"))).drop("_x")
