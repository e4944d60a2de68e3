"""From papers to chunks. A gene record is an open map of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evigrain.functions import text as T
from evigrain.sources import store
from evigrain.sources.corpus import BUCKETS

# What counts as no value in a record; spelling matters.
EMPTY = ("", "NA", "na", "N/A", "null", "None", "Not established", "not established", "Unknown", "unknown")
LEAST_BODY = 80


def filled(c: Column) -> Column:
    return c.isNotNull() & ~F.trim(c).isin(*EMPTY)


def _kinds(genes: str, field: str) -> Column:
    """How many distinct values a field has over an array of genes."""
    return F.size(F.array_distinct(F.filter(F.transform(genes, lambda g: g[field]), filled)))


def route() -> Column:
    """plant_genes, mixed_bucket, pathway_chain or generic."""
    has = lambda b: F.coalesce(F.size(b), F.lit(0)) > 0
    chain = (F.size("Pathway_Genes") >= 3) & (_kinds("Pathway_Genes", "Terminal_Metabolite") <= 2) & (_kinds("Pathway_Genes", "Biosynthetic_Pathway") <= 2)
    mixed = has("Regulation_Genes") & (has("Pathway_Genes") | has("Common_Genes"))
    return F.when(has("Plant_Genes"), "plant_genes").when(mixed, "mixed_bucket").when(has("Pathway_Genes") & chain, "pathway_chain").otherwise("generic")


def genes(papers: DataFrame) -> DataFrame:
    """One row per gene: the paper's columns, bucket, its place there and the record."""
    def of(bucket: str) -> Column:
        none = F.array().cast("array<map<string,string>>")
        return F.transform(F.coalesce(bucket, none), lambda g, i: F.struct(F.lit(bucket).alias("bucket"), i.alias("place"), g.alias("gene")))

    each = F.flatten(F.array(*map(of, BUCKETS)))
    return papers.select("file", "Title", "Journal", "DOI", F.explode(each).alias("x")).select("file", "Title", "Journal", "DOI", "x.*")


def generic_chunks(papers: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """One chunk per gene with all its filled fields, whatever their length. labels: what fields are called."""
    named = F.create_map(*[F.lit(x) for kv in (labels or {"Gene_Name": "Gene_Name"}).items() for x in kv])
    known = lambda c: F.coalesce(F.when(c == "", None).otherwise(c), F.lit("Unknown"))
    rest = F.filter(F.map_entries("gene"), lambda e: (e["key"] != "Gene_Name") & filled(e["value"]))
    lines = F.transform(rest, lambda e: F.concat(F.coalesce(named[e["key"]], e["key"]), F.lit(": "), F.trim(e["value"])))
    name = known(F.col("gene")["Gene_Name"])
    # The labels of the head of a chunk.
    head = [F.concat(F.lit(f"{k}: "), v) for k, v in (("基因名称", name), ("文章", known(F.col("Title"))), ("期刊", known(F.col("Journal"))), ("DOI", known(F.col("DOI"))), ("基因类型", F.col("bucket")))]
    content = F.array_join(F.concat(F.array(*head, F.lit("")), lines), "\n")
    return genes(papers).select("file", (F.row_number().over(W.partitionBy("file").orderBy(F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket")), "place")) - 1).alias("place"), name.alias("gene_name"), F.col("bucket").alias("gene_type"), F.lit("gene").alias("chunk_type"), content.alias("content"), F.concat(F.array(F.lit("Gene_Name")), F.transform(rest, lambda e: e["key"])).alias("source_fields"), F.col("gene").alias("metadata"))


def body_length(content: Column) -> Column:
    """The length of a chunk without its head and section lines."""
    body = F.filter(F.split(F.trim(content), "\n"), lambda x: ~x.startswith("[") & ~x.startswith("── "))
    return F.aggregate(body, F.lit(0), lambda a, x: a + F.length(x))


# The fields of each section of a chunk, in order.
PLANT_GROUPS = {
    "identity": ("Gene_Name", "Gene_Accession_Number", "Chromosome_Position", "Species", "Species_Latin_Name", "Variety", "Reference_Genome_Version", "QTL_or_Locus_Name"),
    "overview": ("Summary_key_Findings_of_Core_Gene", "Summary_Key_Findings_of_Core_Gene", "Core_Phenotypic_Effect", "Research_Topic", "Trait_Category"),
    "mechanism": ("Regulatory_Mechanism", "Regulatory_Pathway", "Biosynthetic_Pathway", "Upstream_or_Downstream_Regulation", "Protein_Family_or_Domain", "Subcellular_Localization", "Interacting_Proteins", "Expression_Pattern"),
    "phenotype": ("Quantitative_Phenotypic_Alterations", "Other_Phenotypic_Effects", "Key_Environment_or_Treatment_Factor"),
    "variant_breeding": ("Key_Variant_Site", "Key_Variant_Type", "Favorable_Allele", "Superior_Haplotype", "Breeding_Application_Value", "Field_Trials", "Genetic_Population", "Genomic_Selection_Application"),
    "methods": ("Experimental_Methods", "Experimental_Materials", "Core_Validation_Method", "Gene_Discovery_or_Cloning_Method"),
}
PATHWAY_GROUPS = {
    "reaction": ("Primary_Substrate", "Primary_Product", "Catalyzed_Reaction_Description", "Biosynthetic_Pathway", "Pathway_Branch_or_Subpathway", "Metabolic_Step_Position", "End_Product_Connection_Type", "Rate_Limiting_or_Key_Control_Step"),
    "terminal": ("Terminal_Metabolite", "Terminal_Metabolite_Class", "Terminal_Metabolite_Function", "Terminal_Metabolite_Accumulation_Site"),
    "function": ("Core_Phenotypic_Effect", "Summary_Key_Findings_of_Core_Gene", "Core_Validation_Method", "Environment_or_Treatment_Factor"),
    "interactions": ("Interacting_Proteins",),
    "engineering": ("Breeding_or_Engineering_Application_Value", "Potential_Tradeoffs", "Other_Important_Info"),
}
REGULATION_CORE = ("Regulator_Type", "Regulation_Mode", "Primary_Regulatory_Targets", "Regulatory_Effect_on_Target_Genes", "Upstream_Signals_or_Inputs", "Metabolic_Process_Controlled", "Decisive_Influence_on_Target_Product", "Feedback_or_Feedforward_Regulation", "Protein_Complex_Involvement", "Epigenetic_Regulation")
#: How many filled fields each kind of plant chunk needs.
PLANT_LEAST = {"mechanism": 2, "phenotype": 1, "variant_breeding": 1, "methods": 1}
SPECIES = ("Species_Latin_Name", "Source_Species_Latin_Name", "Species", "Source_Species")
PAPER_NAME = "__PAPER__"


def section(gene: Column, fields, title: str, labels: dict[str, str] | None = None) -> Column:
    """The lines of a section: its title and `label: value` for each filled field; none if no field is. Of fields with
    one label the first filled one counts."""
    labels, by_label = labels or {}, {}
    for f in fields:
        by_label.setdefault(labels.get(f, f), []).append(gene[f])
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(*[F.when(filled(v), F.trim(v)) for v in values])) for label, values in by_label.items()]
    body = F.array_compact(F.array(*lines))
    return F.when(F.size(body) > 0, F.concat(F.array(F.lit(f"── {title} ──")), body)).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<string>")


def _line(*parts) -> Column:
    return F.array(F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def _told(c: Column) -> Column:
    """A value that isn't empty, or null."""
    return F.when(c != "", c)


def header(gene: Column | None = None) -> Column:
    """The head of a chunk: the gene (where there is one), the paper, the journal with its DOI, the species."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    lines = [_line("[Paper] ", text("Title")), _line("[Journal] ", text("Journal"), F.when(text("DOI").isin("", "NA", "Unknown"), "").otherwise(F.concat(F.lit("  [DOI] "), text("DOI"))))]
    if gene is not None:
        part = lambda label, f: F.coalesce(F.concat(F.lit(f"  [{label}] "), _told(gene[f])), F.lit(""))
        own = F.when(_told(gene["Gene_Name"]).isNotNull(), _line("[Gene] ", gene["Gene_Name"], part("Enzyme", "Enzyme_Name"), part("Family", "Protein_Family_or_Domain"))).otherwise(_none())
        first = F.coalesce(*[_told(gene[f]) for f in SPECIES])
        lines = [own, *lines, F.when(filled(first), _line("[Species] ", first)).otherwise(_none())]
    return F.concat(*lines)


def _chunk(kind: str, gene_type: str, lines: Column, gene: Column | None = None, when: Column | None = None) -> Column:
    """A chunk as a struct; null where `when` doesn't hold or its body is short."""
    content = F.trim(F.array_join(lines, "\n"), F.lit(" \t\n\r"))
    name = F.lit(PAPER_NAME) if gene is None else F.coalesce(_told(gene["Gene_Name"]), F.lit(PAPER_NAME))
    made = lambda c: F.struct(F.lit(kind).alias("chunk_type"), F.lit(gene_type).alias("gene_type"), name.alias("gene_name"), c.alias("content"))
    # The content is bound to a variable, so that it is put together once.
    fits = F.get(F.transform(F.array(content), lambda c: F.when(body_length(c) >= LEAST_BODY, made(c))), F.lit(0))
    return fits if when is None else F.when(F.coalesce(when, F.lit(False)), fits)


def _blank() -> Column:
    return F.array(F.lit(""))


def plant_chunks(gene: Column, labels=None) -> Column:
    """The overview of a plant gene, and a chunk for each other group with enough filled fields."""
    head = header(gene)
    overview = F.concat(head, _blank(), section(gene, PLANT_GROUPS["identity"], "Identity", labels), _blank(), section(gene, PLANT_GROUPS["overview"], "Overview", labels))
    out = [_chunk("plant_gene_overview", "Plant_Genes", overview, gene)]
    for group, least in PLANT_LEAST.items():
        n = sum((F.coalesce(filled(gene[f]), F.lit(False)).cast("int") for f in PLANT_GROUPS[group]), F.lit(0))
        out.append(_chunk(f"plant_gene_{group}", "Plant_Genes", F.concat(head, _blank(), section(gene, PLANT_GROUPS[group], group.title(), labels)), gene, n >= least))
    return F.array(*out)


def pathway_gene_chunk(gene: Column, bucket: str, kind: str, labels=None) -> Column:
    """A gene of a pathway, by reaction, function, interactions and engineering; none if all are empty."""
    parts = F.concat(*[section(gene, PATHWAY_GROUPS[g], g.title(), labels) for g in ("reaction", "function", "interactions", "engineering")])
    return _chunk(kind, bucket, F.concat(header(gene), _blank(), parts), gene, F.size(parts) > 0)


def regulation_gene_chunk(gene: Column, labels=None) -> Column:
    parts = [section(gene, REGULATION_CORE, "Regulation Core", labels), *[section(gene, PATHWAY_GROUPS[g], g.title(), labels) for g in ("terminal", "function", "interactions")]]
    spaced = [F.when(F.size(p) > 0, F.concat(p, _blank())).otherwise(_none()) for p in parts]
    return _chunk("regulation_gene", "Regulation_Genes", F.concat(header(gene), _blank(), *spaced), gene)


def pathway_overview_chunk() -> Column:
    """Pathways, end products and genes of a chain."""
    distinct = lambda f: F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("Pathway_Genes", lambda g: g[f]), filled))), "; ")
    or_na = lambda c: F.when(c == "", "NA").otherwise(c)
    names = F.array_join(F.transform("Pathway_Genes", lambda g: F.coalesce(_told(g["Gene_Name"]), F.lit("?"))), ", ")
    body = F.array(F.lit("── Pathway Overview ──"), F.concat(F.lit("通路: "), or_na(distinct("Biosynthetic_Pathway"))), F.concat(F.lit("终产物: "), or_na(distinct("Terminal_Metabolite"))), F.concat(F.lit("涉及基因 ("), F.size("Pathway_Genes").cast("string"), F.lit("): "), names))
    return _chunk("pathway_overview", PAPER_NAME, F.concat(header(), _blank(), body))


def reaction_steps() -> Column:
    """A line for each gene of a chain: [step] substrate --(gene)--> product."""
    or_ = lambda c, other: F.coalesce(_told(c), F.lit(other))
    step = lambda g: F.concat(F.lit("["), or_(g["Metabolic_Step_Position"], ""), F.lit("] "), or_(g["Primary_Substrate"], "?"), F.lit(" --("), or_(g["Gene_Name"], "?"), F.lit(")--> "), or_(g["Primary_Product"], "?"))
    return F.transform("Pathway_Genes", step)


def reaction_chain_chunk() -> Column:
    """The steps of a chain. Its lines begin like heads, so that the least length leaves a chain of nothing else out."""
    return _chunk("pathway_graph", PAPER_NAME, F.concat(header(), _blank(), F.array(F.lit("── Reaction Chain ──")), reaction_steps()))


def directory_chunk() -> Column:
    """The names of a paper's genes, with their enzymes, by bucket."""
    named = lambda g: F.concat(F.coalesce(_told(g["Gene_Name"]), F.lit("?")), F.coalesce(F.concat(F.lit(" ("), _told(g["Enzyme_Name"]), F.lit(")")), F.lit("")))
    lines = [F.when(F.size(b) > 0, _line(f"{b} (", F.size(b).cast("string"), "): ", F.array_join(F.transform(b, named), ", "))).otherwise(_none()) for b in ("Common_Genes", "Pathway_Genes", "Regulation_Genes")]
    return _chunk("paper_overview", PAPER_NAME, F.concat(header(), _blank(), F.array(F.lit("── Gene Directory ──")), *lines))


def list_field(c: Column) -> Column:
    """The items of a list in a text, separated by semicolons; none for a placeholder."""
    return F.when(filled(c), F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")).otherwise(_none())


def _regulators() -> Column:
    """name, targets and effect of each regulator with targets."""
    of = lambda g: F.struct(F.coalesce(_told(g["Gene_Name"]), F.lit("?")).alias("name"), list_field(g["Primary_Regulatory_Targets"]).alias("targets"), F.coalesce(g["Regulatory_Effect_on_Target_Genes"], F.lit("")).alias("effect"))
    return F.filter(F.transform("Regulation_Genes", of), lambda r: F.size(r["targets"]) > 0)


def network_chunk() -> Column:
    """Who regulates whom, with the effect; none if nobody does."""
    line = lambda r: F.concat(F.lit("  "), r["name"], F.lit(" → "), F.array_join(r["targets"], ", "), F.coalesce(F.concat(F.lit(" ["), _told(r["effect"]), F.lit("]")), F.lit("")))
    lines = F.transform(_regulators(), line)
    return _chunk("regulatory_network", PAPER_NAME, F.concat(header(), _blank(), F.array(F.lit("── Regulatory Network ──")), lines), None, F.size(lines) > 0)


def regulations(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each paper: regulator and targets, where a later regulator of the same name replaces an earlier one; and
    target and regulators, in order, where both count."""
    rows = papers.select("file", F.posexplode(_regulators()).alias("at", "r")).select("file", "at", "r.name", "r.targets")
    forward = rows.groupBy("file", "name").agg(F.max_by("targets", "at").alias("targets"))
    each = rows.select("file", "at", "name", F.posexplode("targets").alias("place", "target"))
    inverse = each.groupBy("file", "target").agg(F.array_sort(F.collect_list(F.struct("at", "place", "name"))).alias("x")).select("file", "target", F.transform("x", lambda x: x["name"]).alias("regulators"))
    return forward, inverse


def broken() -> Column:
    """Whether one of a paper's buckets holds something that is no record."""
    some = F.lit(False)
    for b in BUCKETS:
        some = some | F.coalesce(F.exists(b, lambda g: g.isNull()), F.lit(False))
    return some


def chunks(papers: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """file, route, place, chunk_type, gene_type, gene_name and content of each paper's chunks by its route. A generic paper has one for each
    gene, of any length; others leave out chunks with a short body. A paper that a route can't work on falls back to generic
    chunks of the records that it has.

    Each route is a projection of its own papers; papers are read once and kept as a table for that."""
    def each(bucket: str, make) -> Column:
        return F.transform(F.coalesce(bucket, F.array().cast("array<map<string,string>>")), make)

    kind = "struct<chunk_type:string,gene_type:string,gene_name:string,content:string>"
    chain = F.concat(F.array(pathway_overview_chunk(), reaction_chain_chunk()), each("Pathway_Genes", lambda g: pathway_gene_chunk(g, "Pathway_Genes", "pathway_gene", labels)))
    mixed = F.concat(
        F.array(directory_chunk(), network_chunk()),
        each("Common_Genes", lambda g: pathway_gene_chunk(g, "Common_Genes", "common_gene", labels)),
        each("Pathway_Genes", lambda g: pathway_gene_chunk(g, "Pathway_Genes", "pathway_gene", labels)),
        each("Regulation_Genes", lambda g: regulation_gene_chunk(g, labels)),
    )
    plant = F.flatten(each("Plant_Genes", lambda g: plant_chunks(g, labels)))
    whole = papers.select("*", F.when(broken(), "generic").otherwise(route()).alias("route"))
    records = [F.filter(b, lambda g: g.isNotNull()).alias(b) for b in BUCKETS]
    routed = store.cut(whole.select(*[c for c in whole.columns if c not in BUCKETS], *records))

    def typed(name: str, made: Column) -> DataFrame:
        own = routed.filter(F.col("route") == name).select("file", "route", F.posexplode(F.array_compact(made.cast(f"array<{kind}>"))).alias("place", "c"))
        return own.select("file", "route", "place", "c.*")

    plain = generic_chunks(routed.filter("route = 'generic'"), labels)
    typed_all = typed("plant_genes", plant).unionByName(typed("mixed_bucket", mixed)).unionByName(typed("pathway_chain", chain))
    generic = plain.select("file", F.lit("generic").alias("route"), "place", "chunk_type", "gene_type", "gene_name", "content")
    return typed_all.unionByName(generic)


# What a chunk's own columns are called as fields.
PSEUDO_FIELDS = ("gene_name", "paper_title", "journal", "doi", "gene_type", "chunk_type", "content", "source_fields", "relations")


def fields_of(records: DataFrame) -> DataFrame:
    """id, field, value of each filled field: the records' columns but id and metadata, and the entries of metadata."""
    own = [c for c in records.columns if c not in ("id", "metadata")]
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in own])
    more = F.transform(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value")))
    return records.select("id", F.explode(F.concat(pairs, more)).alias("x")).select("id", "x.*").filter(filled(F.col("value")))


def keyword_text(*columns: str, metadata: str = "metadata") -> Column:
    """All a chunk says, for its index: the given columns, then its metadata by name."""
    told = F.array_compact(F.array(*[_told(F.trim(F.col(c))) for c in columns]))
    more = F.filter(F.transform(F.array_sort(F.map_entries(metadata)), lambda e: e["value"]), filled)
    return F.array_join(F.concat(told, more), "\n")


def requested(fields: DataFrame, wanted: dict[str, float], aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """id, asked, weight, field, value: the stored fields that each requested one names, by its aliases or itself; `*` names all. A field that
    two names reach counts for both."""
    spark = fields.sparkSession
    rows = [(asked, float(w), stored) for asked, w in wanted.items() if asked != "*" for stored in aliases.get(asked, (asked,))]
    named = F.broadcast(spark.createDataFrame(rows, "asked string, weight double, field string"))
    out = fields.join(named, "field").select("id", "asked", "weight", "field", "value")
    if "*" in wanted:
        out = out.unionByName(fields.select("id", F.lit("*").alias("asked"), F.lit(float(wanted["*"])).alias("weight"), "field", "value"))
    return out
