"""From gene records to a graph: which field of which kind of gene gives which edge, and where each edge comes from.

There are two forms. The local one keeps some fields whole and tells effects of common genes from those of regulators; the
stored one splits every list and knows branches of pathways. A record's edges carry its evidence as a struct
with three names for where they come from: the record's key, the path to the item, and a hash that doesn't
depend on the order of files.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrain.functions import text as T
from evigrain.operators.chunking import genes


class Rule(NamedTuple):
    """Field of genes of a bucket to edges; into the gene or out of it; to nodes of a kind; item by item or whole."""

    bucket: str
    field: str
    relation: str
    out: bool
    kind: str
    split: bool


# The edges of the local graph.
LOCAL = tuple(
    Rule(*r)
    for r in (
        ("Pathway_Genes", "Primary_Substrate", "INPUT_OF", False, "Metabolite", True),
        ("Pathway_Genes", "Primary_Product", "PRODUCES", True, "Metabolite", True),
        ("Pathway_Genes", "Terminal_Metabolite", "CONTRIBUTES_TO", True, "Metabolite", False),
        ("Pathway_Genes", "Biosynthetic_Pathway", "PARTICIPATES_IN", True, "Pathway", False),
        ("Pathway_Genes", "Applied_Species", "TESTED_IN", True, "Species", False),
        ("Regulation_Genes", "Primary_Regulatory_Targets", "REGULATES", True, "Gene", True),
        ("Regulation_Genes", "Upstream_Signals_or_Inputs", "UPSTREAM_SIGNAL_OF", False, "Signal", True),
        ("Regulation_Genes", "Metabolic_Process_Controlled", "CONTROLS", True, "Process", False),
        ("Regulation_Genes", "Terminal_Metabolite", "AFFECTS", True, "Metabolite", True),
        ("Common_Genes", "Terminal_Metabolite", "ASSOCIATED_WITH", True, "Metabolite", False),
        ("Common_Genes", "Core_Phenotypic_Effect", "HAS_EFFECT", True, "Phenotype", False),
        ("Common_Genes", "Applied_Species", "TESTED_IN", True, "Species", False),
    )
)
# The edges of the stored graph.
STORED = tuple(
    Rule(*r)
    for r in (
        ("Pathway_Genes", "Primary_Substrate", "INPUT_OF", False, "Metabolite", True),
        ("Pathway_Genes", "Primary_Product", "PRODUCES", True, "Metabolite", True),
        ("Pathway_Genes", "Terminal_Metabolite", "CONTRIBUTES_TO", True, "Metabolite", True),
        ("Pathway_Genes", "Biosynthetic_Pathway", "PARTICIPATES_IN", True, "Pathway", True),
        ("Pathway_Genes", "Pathway_Branch_or_Subpathway", "PARTICIPATES_IN", True, "Pathway", True),
        ("Pathway_Genes", "Applied_Species", "TESTED_IN", True, "Species", False),
        ("Regulation_Genes", "Primary_Regulatory_Targets", "REGULATES", True, "Gene", True),
        ("Regulation_Genes", "Upstream_Signals_or_Inputs", "UPSTREAM_SIGNAL_OF", False, "Signal", True),
        ("Regulation_Genes", "Metabolic_Process_Controlled", "CONTROLS", True, "Process", True),
        ("Regulation_Genes", "Terminal_Metabolite", "AFFECTS", True, "Metabolite", True),
        ("Regulation_Genes", "Applied_Species", "TESTED_IN", True, "Species", False),
        ("Common_Genes", "Terminal_Metabolite", "AFFECTS", True, "Metabolite", True),
        ("Common_Genes", "Core_Phenotypic_Effect", "HAS_EFFECT", True, "Phenotype", False),
        ("Common_Genes", "Applied_Species", "TESTED_IN", True, "Species", False),
    )
)
FORMS = {"local": LOCAL, "stored": STORED}
# Where a gene's species is looked for, in this order.
SPECIES = ("Species_Latin_Name", "Source_Species_Latin_Name", "Applied_Species_Latin_Name", "Source_Species", "Applied_Species", "Species")
LIST = r"[;,\n]"


def told(c: Column) -> Column:
    """A field's value; empty if it says that there is none."""
    return T.clean(c, T.GRAPH_BLANKS)


def first_told(gene: Column, fields) -> Column:
    return F.coalesce(*[F.when(told(gene[f]) != "", told(gene[f])) for f in fields], F.lit(""))


def species(gene: Column) -> Column:
    return first_told(gene, SPECIES)


def json_string(c: Column) -> Column:
    """A text as a JSON string of ASCII characters only."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    beyond = lambda n: n - 0x10000
    # The short escapes of JSON.
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}

    def shown(x: Column) -> Column:
        n = F.ascii(x)
        out = F.when(x == '"', short['"'])
        for k, v in list(short.items())[1:]:
            out = out.when(x == k, v)
        pair = F.concat(unit(F.floor(beyond(n) / 1024) + 0xD800), unit(beyond(n) % 1024 + 0xDC00))
        return out.when((n >= 32) & (n < 127), x).when(n >= 0x10000, pair).otherwise(unit(n))

    each = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: shown(F.substring(c, i, F.lit(1))))
    return F.concat(F.lit('"'), F.when(c.rlike(r'^[ !#-\[\]-~]*$'), c).otherwise(F.array_join(each, "")), F.lit('"'))


def relationship_key(paper: Column, bucket: Column, place: Column, relation: Column, field: Column, item: Column, at: Column) -> Column:
    """sha1 of what an edge's evidence is, as JSON with sorted keys."""
    parts = {"field": json_string(field), "item": json_string(T.name(item)), "item_index": at, "paper": json_string(paper), "record_index": place, "relation": json_string(relation), "section": json_string(bucket)}
    told_ = F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v.cast("string")) for k, v in parts.items()])
    return F.sha1(F.concat(F.lit("{"), told_, F.lit("}")))


def gene_edges(papers: DataFrame, form: str = "local") -> DataFrame:
    """src, dst, relation, evidence: the form's rules applied to every gene. Edges without a name at either end are left out."""
    g = F.col("gene")
    own = T.node_id(F.lit("Gene"), told(g["Gene_Name"]), species(g))
    none = F.array().cast("array<struct<field:string,relation:string,out:boolean,other:string,item:string,at:int>>")

    def of(rule: Rule) -> Column:
        if rule.field == "Applied_Species" and form == "stored":
            whole = first_told(g, ("Applied_Species_Latin_Name", "Applied_Species"))
        else:
            whole = told(g[rule.field])
        items = T.items(whole, LIST) if rule.split else F.when(whole != "", F.array(whole))
        edge = lambda x, i: F.struct(F.lit(rule.field).alias("field"), F.lit(rule.relation).alias("relation"), F.lit(rule.out).alias("out"), T.node_id(F.lit(rule.kind), x, species(g)).alias("other"), x.alias("item"), i.alias("at"))
        return F.when(F.col("bucket") == rule.bucket, F.transform(items, edge))

    found = F.explode(F.flatten(F.array(*[F.coalesce(of(r), none) for r in FORMS[form]])))
    doi, name = told(F.col("DOI")), F.regexp_extract("file", r"[^/]*$", 0)
    paper = F.when(doi != "", doi).otherwise(name)
    note = [species(g).alias("species"), told(g["Core_Validation_Method"]).alias("validation"), told(g["Summary_Key_Findings_of_Core_Gene"]).alias("summary"), F.when(F.col("bucket") == "Regulation_Genes", told(g["Regulation_Mode"])).alias("mode")]
    rows = genes(papers).filter(told(g["Gene_Name"]) != "").select("file", "bucket", "place", doi.alias("doi"), paper.alias("paper"), *note, own.alias("own"), found.alias("x"))
    record = F.concat(F.col("paper"), F.lit("::"), F.col("bucket"), F.lit("["), F.col("place"), F.lit("]"))
    path = F.concat(record, F.lit("::"), F.col("x.field"), F.lit("["), F.col("x.at"), F.lit("]::"), F.col("x.relation"))
    key = relationship_key(F.col("paper"), F.col("bucket"), F.col("place"), F.col("x.relation"), F.col("x.field"), F.col("x.item"), F.col("x.at"))
    evidence = F.struct(
        *("file", "doi", "bucket", "place", "x.field", "x.item", F.col("x.at").alias("item_index"), "species", "validation", "summary", "mode"),
        *(record.alias("record_key"), path.alias("relationship_index"), key.alias("relationship_key")),
    )
    out = F.col("x.out")
    return rows.select(F.when(out, F.col("own")).otherwise(F.col("x.other")).alias("src"), F.when(out, F.col("x.other")).otherwise(F.col("own")).alias("dst"), "x.relation", evidence.alias("evidence"))


def merged(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, relation): its evidence_count, its sections, and of its evidence the one with the least
    relationship_key, which is the same however files are ordered. All of it stays in the rows of gene_edges()."""
    first = F.min_by("evidence", F.col("evidence.relationship_key"))
    return edges.groupBy("src", "dst", "relation").agg(F.count("*").alias("evidence_count"), F.array_sort(F.collect_set("evidence.bucket")).alias("sections"), first.alias("evidence"))
