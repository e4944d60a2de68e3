"""Sources and sinks: papers as JSON, lines of JSON, Markdown, FASTA, tab-separated tables, versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENES = "ARRAY<MAP<STRING,STRING>>"
BUCKETS = ("Pathway_Genes", "Regulation_Genes", "Common_Genes", "Plant_Genes")
PAPER = f"Title STRING, Journal STRING, DOI STRING, {', '.join(f'{b} {GENES}' for b in BUCKETS)}"


def _paper_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema(PAPER + ", _broken STRING").option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").option("pathGlobFilter", "*.json").json(folder)
    return rows.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per JSON file, with its name. The schema is given, not inferred; files that don't parse are left out."""
    return _paper_rows(spark, folder).filter("_broken IS NULL").drop("_broken")


def broken_papers(spark: SparkSession, folder: str) -> DataFrame:
    """The names of the JSON files that don't parse, and their titles as far as they could be read."""
    return _paper_rows(spark, folder).filter("_broken IS NOT NULL").select("file", "Title")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def markdown(spark: SparkSession, folder: str, most: int) -> DataFrame:
    """file, text of Markdown files of at most `most` bytes; larger ones are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder).filter(F.col("length") <= most)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.decode("content", "UTF-8").alias("text"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """header, sequence; records with letters other than ACGTN are marked as not valid."""
    records = spark.read.option("lineSep", ">").text(path).filter(F.length(F.trim("value")) > 0)
    lines = F.split("value", "\r?\n")
    rows = records.select(F.trim(F.get(lines, F.lit(0))).alias("header"), F.upper(F.array_join(F.slice(lines, 2, 1 << 30), "")).alias("sequence"))
    return rows.withColumn("valid", F.col("sequence").rlike("^[ACGTN]+$"))


def accessions(spark: SparkSession, path: str) -> DataFrame:
    """species, gene, accession of rows with three fields or more and an accession."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.size(parts) >= 3).select(*[F.trim(F.get(parts, F.lit(i))).alias(c) for i, c in enumerate(("species", "gene", "accession"))])
    return rows.filter("accession <> ''")


def pathway_genes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Genes of pathways (ord, name, substrate, product) of all papers, in the order of files and places, for a static graph;
    and the files that don't parse, each with its error."""
    rows = papers(spark, folder).select("file", F.posexplode("Pathway_Genes").alias("at", "g")).filter("g IS NOT NULL")
    genes = rows.select(F.struct("file", "at").alias("ord"), F.col("g")["Gene_Name"].alias("name"), F.col("g")["Primary_Substrate"].alias("substrate"), F.col("g")["Primary_Product"].alias("product"))
    return genes, broken_papers(spark, folder).select("file", F.concat(F.lit("no JSON"), F.coalesce(F.concat(F.lit(" after the title "), "Title"), F.lit(""))).alias("error"))
