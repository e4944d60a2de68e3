"""Queries over protocols and templates, made from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrain.operators import protocols
from evigrain.plans.registry import query, table

# Lines and what becomes of them; a part has those whose condition holds. {n} is its name, {s} its size.
_LINES = (
    ("TRUE", "  Protocol {n} ", "# Protocol {n}"),
    ("TRUE", "物种： {n}", "**物种：** {n}"),
    ("TRUE", "", ""),
    ("s % 2 = 0", "Step 1: cut {s}", "\n## Step 1：cut {s}"),
    ("TRUE", "1.2 aims", "### 1.2 aims"),
    ("s % 3 = 0", "1.2.{s} detail", "#### 1.2.{s} detail"),
    ("TRUE", "试剂：water", "**试剂：** water"),
    ("s % 5 = 0", "操作:", "**操作：**"),
    ("TRUE", "a\t{s}\tc", "| a | {s} | c |\n| --- | --- | --- |"),
    ("s % 2 = 1", "•• keep cold", "- keep cold"),
    ("TRUE", "d\t\tf", "| d |   | f |"),
    ("s % 7 = 0", "plain {s}", "plain {s}"),
    ("s % 7 = 0", "g\th", "| g | h |\n| --- | --- |"),
    ("TRUE", "start │ flow", "```\nstart │ flow"),
    ("s % 3 = 1", "1.3 inside the chart", "1.3 inside the chart"),
    ("s % 4 = 0", "______", "```\n---"),
    ("s % 4 <> 0", " \t ", "```\n"),
    ("TRUE", "Day 1-3 — wait", "#### Day 1-3  — wait"),
    ("TRUE", "注意：hot", "> **注意：** hot"),
    ("TRUE", "3.\tthird", "3. third"),
    ("TRUE", "o\tsub", "  - sub"),
    ("s % 2 = 0", "（A）letter", "#### （A）letter"),
    ("TRUE", "附录 {s}", "\n## 附录 {s}"),
    ("s % 5 = 1", "▼", "```\n▼\n```"),
)


def _sql_string(text: str) -> str:
    parts = text.replace("'", "''").replace("{n}", "' || p_name || '").replace("{s}", "' || s || '")
    for a, code in (("\n", 10), ("\t", 9)):
        parts = parts.replace(a, f"' || chr({code}) || '")
    return f"'{parts}'"


def _joined(at: int) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c[0]} THEN {_sql_string(c[at])} END" for c in _LINES) + "], lambda x: x IS NOT NULL), chr(10))"


@query("f48_markdown", f"SELECT p_partkey, {_joined(2)} AS markdown FROM (SELECT *, p_size AS s FROM part)")
def markdown(spark, d):
    """Each part's protocol: headings, labels, tables that stay open across marks, charts that end at blanks, rules or the end."""
    lines = [F.when(F.expr(c.replace("s %", "p_size %")), F.expr(_sql_string(t).replace("|| s ||", "|| CAST(p_size AS STRING) ||"))) for c, t, _ in _LINES]
    texts = table(spark, d, "part").select("p_partkey", F.array_join(F.array_compact(F.array(*lines)), "\n").alias("text"))
    return protocols.to_markdown(texts, "p_partkey", "text")


_TEMPLATE = "Before _gene_name_\n• _gene_name_  in\n  GenBank _gene_accession_\nseq _gene_sequence_\n(3). Record The end\nmiddle\n• _gene_name_-_target_number_-T0\n## tail"
_BLOCKS = [("• _GENE_NAME_ in GenBank", "(3). record the END"), ("• _gene_name_-_target_number_-T0", "•  _gene_name_-_target_number_-T0"), ("never there", "nor here")]
_PLACES = {"_gene_name_": "gene", "_gene_accession_": "accession", "_gene_sequence_": "sequence", "_target_number_": "number"}
_GENES = "g AS (SELECT p_brand, p_partkey, 'G' || p_partkey AS gene, 'A' || p_size AS accession, upper(p_name) AS sequence, p_size::VARCHAR AS number FROM part WHERE p_brand IS NOT NULL)"


@query(
    "f49_template_blocks",
    f"WITH {_GENES} SELECT p_brand, 'Before _gene_name_' || chr(10) || string_agg('• ' || gene || '  in' || chr(10) || '  GenBank ' || accession || chr(10) || 'seq ' || sequence || chr(10) || '(3). Record The end', chr(10) ORDER BY p_partkey) || chr(10) || 'middle' || chr(10) || "
    "string_agg('• ' || gene || '-' || number || '-T0', chr(10) ORDER BY p_partkey) || chr(10) || '## tail' AS text FROM g GROUP BY p_brand",
)
def template_blocks(spark, d):
    """One design a brand: blocks of a template, found by their markers, filled for all its parts."""
    gene = F.struct("p_partkey", F.expr("'G' || CAST(p_partkey AS STRING)").alias("gene"), F.expr("'A' || CAST(p_size AS STRING)").alias("accession"), F.upper("p_name").alias("sequence"), F.col("p_size").cast("string").alias("number"))
    designs = table(spark, d, "part").filter("p_brand IS NOT NULL").groupBy("p_brand").agg(F.sort_array(F.collect_list(gene)).alias("genes")).withColumn("text", F.lit(_TEMPLATE))
    return protocols.with_blocks(designs, "text", "genes", _BLOCKS, _PLACES).select("p_brand", "text")


@query(
    "f50_without_section",
    "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'top' || chr(10) || '## B' || chr(10) || 'b' WHEN p_size % 3 = 1 THEN 'top' || chr(10) ELSE 'top' || chr(10) || '## B' || chr(10) || '## C' END AS text FROM part",
)
def without_section(spark, d):
    """A section in the middle, one at the end, and none of that name."""
    n = F.col("p_size") % 3
    text = F.when(n == 0, "top\n ## A \na\n### deeper\n## B\nb").when(n == 1, "top\n## A\nrest\n## A\nmore").otherwise("top\n## B\n## C")
    return table(spark, d, "part").select("p_partkey", protocols.without_section(text, F.lit("## A")).alias("text"))


@query("f51_combined", "SELECT o_custkey, string_agg('## order ' || o_orderkey || chr(10) || o_orderpriority, chr(10) || chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey")
def combined(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.expr("'order ' || CAST(o_orderkey AS STRING)").alias("name"), "o_orderpriority")
    return protocols.combined(rows, "o_custkey", "o_orderkey", "name", "o_orderpriority")


_SEQ, _OLIGO = "• _gene_name_ _gene_accession_\nup _gene_accession_up2k _gene_sequence_up2k_\nown _gene_sequence_\n", "oligo _gene_name_ + [_gene_up25_] + [_gene_down25_rc_]"
_TRANSFER = f"# T\n## Step 1\n{_SEQ}## Step 2 one\nsingle\n## Step 2 many\n{_OLIGO}\n## Step 3\nend"
_DNA = "repeat(translate(substr(md5(CAST({} AS VARCHAR)), 1, 20), '0123456789abcdef', 'ACGTACGTACGTacgt'), 2)"


@query(
    "x15_transfer",
    f"""WITH g AS (SELECT s_nationkey, s_suppkey, 'G' || s_suppkey AS gene, 'AC' || s_suppkey AS acc, {_DNA.format("'u' || s_suppkey")} AS up, {_DNA.format("'d' || s_suppkey")} AS down FROM supplier),
o AS (SELECT *, 'oligo ' || gene || ' + [' || right(up, 25) || '] + [' || reverse(translate(left(down, 25), 'ACGTacgt', 'TGCAtgca')) || ']' AS oligo, '• ' || gene || ' ' || acc || chr(10) || 'up ' || acc || '_up2k ' || up || chr(10) || 'own ' || lower(gene) || chr(10) AS seq FROM g)
SELECT s_nationkey, '# T' || chr(10) || '## Step 1' || chr(10) || string_agg(seq, chr(10) ORDER BY s_suppkey) || CASE WHEN count(*) > 1 THEN '## Step 2 many' || chr(10) || string_agg(oligo, chr(10) ORDER BY s_suppkey) || chr(10) ELSE '## Step 2 one' || chr(10) || 'single' || chr(10) END || '## Step 3' || chr(10) || 'end' AS text FROM o GROUP BY s_nationkey""",
)
def transfer(spark, d):
    """One protocol a nation for the genes of its suppliers, of which some have one."""
    dna = lambda x: F.expr(_DNA.format(x).replace("VARCHAR", "STRING"))
    key = "CAST(s_suppkey AS STRING)"
    gene = F.struct("s_suppkey", F.expr(f"'G' || {key}").alias("gene"), F.expr(f"'AC' || {key}").alias("accession"), F.expr(f"'g' || {key}").alias("sequence"), dna(f"'u' || {key}").alias("upstream"), dna(f"'d' || {key}").alias("downstream"))
    designs = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(gene)).alias("genes")).withColumn("text", F.lit(_TRANSFER))
    return protocols.transfer(designs, "text", "genes", _SEQ, _OLIGO, "## Step 2 one", "## Step 2 many").select("s_nationkey", "text")
