"""Queries over papers: chunks by route, fields of chunks, regulation maps, gene edges.

The tables hold no papers, so five parts make one: each part is a gene, its columns give the gene's fields, and the
paper's number decides which buckets its genes are in. The same expressions state it for Spark and for the SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrain.operators import chunking, gene_graph
from evigrain.plans.registry import query, table
from evigrain.sources.corpus import BUCKETS

FIELDS = {
    "Gene_Name": "p_name || ' ' || CAST(p_partkey AS STRING)",
    "Enzyme_Name": "CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END",
    "Species_Latin_Name": "CASE WHEN p_size % 4 = 0 THEN '' ELSE 'Oryza sativa' END",
    "Species": "'rice'",
    "Primary_Substrate": "CASE WHEN p_size % 6 = 0 THEN 'NA' ELSE lower(p_type) || ' acid' END",
    "Primary_Product": "p_brand",
    "Metabolic_Step_Position": "CAST(p_size AS STRING)",
    "Biosynthetic_Pathway": "'pathway ' || CAST(file % 3 AS STRING)",
    "Terminal_Metabolite": "'acid ' || CAST(file % 7 AS STRING) || '; ester'",
    "Core_Phenotypic_Effect": "CASE WHEN p_size % 5 = 0 THEN 'Unknown' ELSE 'the grain of ' || p_name || ' weighs more in dry fields when ' || p_type || ' is high' END",
    "Regulatory_Mechanism": "CASE WHEN p_size % 2 = 0 THEN 'binds the promoter of the kinase gene and of ' || p_brand END",
    "Regulatory_Pathway": "'light signalling and the circadian clock under long days'",
    "Primary_Regulatory_Targets": "CASE WHEN p_size % 5 = 1 THEN 'NA' ELSE p_type || '; ' || p_brand END",
    "Regulatory_Effect_on_Target_Genes": "CASE WHEN p_size % 2 = 0 THEN 'up' ELSE '' END",
}
BUCKET = "CASE WHEN file % 4 = 0 THEN 'Pathway_Genes' WHEN file % 4 = 2 THEN 'Plant_Genes' WHEN file % 4 = 3 THEN 'Common_Genes' WHEN p_partkey % 5 < 2 THEN 'Regulation_Genes' WHEN p_partkey % 5 = 2 THEN 'Common_Genes' ELSE 'Pathway_Genes' END"
PAPER = {"Title": "'On the parts ' || CAST(file AS STRING)", "Journal": "'Journal of Parts'", "DOI": "CASE WHEN file % 3 = 0 THEN 'NA' ELSE '10.1/' || CAST(file AS STRING) END"}
GENES_SQL = f"""p AS (SELECT *, CAST(floor(p_partkey / 5) AS BIGINT) AS file FROM part),
g AS (SELECT file, p_partkey, {BUCKET} AS bucket, {', '.join(f'{e} AS {n}' for n, e in {**PAPER, **FIELDS}.items())} FROM p)"""


def papers(spark, d, more: dict[str, str] | None = None):
    """file (as text), Title, Journal, DOI and the four buckets of genes. more: further fields of a gene."""
    parts = table(spark, d, "part").withColumn("file", F.floor(F.col("p_partkey") / 5).cast("long"))
    gene = F.create_map(*[x for n, e in {**FIELDS, **(more or {})}.items() for x in (F.lit(n), F.expr(e))])
    rows = parts.select("file", "p_partkey", F.expr(BUCKET).alias("bucket"), *[F.expr(e).alias(n) for n, e in PAPER.items()], F.struct("p_partkey", gene.alias("gene")).alias("g"))
    of = lambda b: F.transform(F.array_sort(F.collect_list(F.when(F.col("bucket") == b, F.col("g"))), lambda x, y: (x["p_partkey"] - y["p_partkey"]).cast("int")), lambda x: x["gene"]).alias(b)
    return rows.groupBy("file", *PAPER).agg(*[of(b) for b in BUCKETS]).withColumn("file", F.col("file").cast("string"))


_BLANK = "(" + ", ".join(f"'{b}'" for b in chunking.EMPTY) + ")"
_FILLED = lambda x: f"({x} IS NOT NULL AND trim({x}) NOT IN {_BLANK})"
_LINES = lambda xs: f"array_to_string(list_filter([{', '.join(xs)}], lambda z: z IS NOT NULL), chr(10))"
_OR = lambda x, other: f"coalesce(nullif({x}, ''), '{other}')"


def _section(fields, title: str) -> str:
    own = [f for f in fields if f in FIELDS]
    if not own:
        return "NULL"
    some = " OR ".join(_FILLED(f) for f in own)
    lines = [f"CASE WHEN {_FILLED(f)} THEN '{f}: ' || trim({f}) END" for f in own]
    return f"CASE WHEN {some} THEN {_LINES([repr(f'── {title} ──'), *lines])} END"


def _head(gene: bool) -> list[str]:
    paper = ["'[Paper] ' || Title", "'[Journal] ' || Journal || CASE WHEN DOI = 'NA' THEN '' ELSE '  [DOI] ' || DOI END"]
    if not gene:
        return paper
    name = "'[Gene] ' || Gene_Name || coalesce('  [Enzyme] ' || nullif(Enzyme_Name, ''), '')"
    return [name, *paper, "'[Species] ' || coalesce(nullif(Species_Latin_Name, ''), Species)"]


_ALL = f"g2 AS (SELECT *, {_LINES(_head(True))} AS head, {_LINES(_head(False))} AS paper_head FROM g)"
_CHAIN = [f"{_section(chunking.PATHWAY_GROUPS[k], k.title())}" for k in ("reaction", "function", "interactions", "engineering")]
_KINDS = [
    ("file % 4 = 2", "plant_gene_overview", _LINES(["head", "''", _section(chunking.PLANT_GROUPS["identity"], "Identity"), "''", _section(chunking.PLANT_GROUPS["overview"], "Overview")])),
    ("file % 4 = 2 AND " + " + ".join(f"{_FILLED(f)}::INT" for f in chunking.PLANT_GROUPS["mechanism"] if f in FIELDS) + " >= 2", "plant_gene_mechanism", _LINES(["head", "''", _section(chunking.PLANT_GROUPS["mechanism"], "Mechanism")])),
    ("file % 4 IN (0, 1) AND bucket = 'Pathway_Genes'", "pathway_gene", _LINES(["head", "''", *_CHAIN])),
    ("file % 4 = 1 AND bucket = 'Common_Genes'", "common_gene", _LINES(["head", "''", *_CHAIN])),
    ("bucket = 'Regulation_Genes'", "regulation_gene", _LINES(["head", "''", *[x for s in (_section(chunking.REGULATION_CORE, "Regulation Core"), _section(chunking.PATHWAY_GROUPS["terminal"], "Terminal"), _section(chunking.PATHWAY_GROUPS["function"], "Function")) for x in (s, f"CASE WHEN ({s}) IS NOT NULL THEN '' END")]])),
]
_NAMES = f"string_agg({_OR('Gene_Name', '?')}, ', ' ORDER BY p_partkey)"
_TARGETS = "list_filter(list_transform(string_split(Primary_Regulatory_Targets, ';'), lambda x: trim(x)), lambda x: x <> '')"
_DIRECTORY = lambda b: f"'{b} (' || nullif(count(*) FILTER (bucket = '{b}'), 0) || '): ' || string_agg(Gene_Name || coalesce(' (' || nullif(Enzyme_Name, '') || ')', ''), ', ' ORDER BY p_partkey) FILTER (bucket = '{b}')"
_PAPER_KINDS = [
    ("file % 4 = 0", "pathway_overview", _LINES(["any_value(paper_head)", "''", "'── Pathway Overview ──'", "'通路: ' || any_value(Biosynthetic_Pathway)", "'终产物: ' || any_value(Terminal_Metabolite)", f"'涉及基因 (' || count(*) || '): ' || {_NAMES}"])),
    ("file % 4 = 0", "pathway_graph", _LINES(["any_value(paper_head)", "''", "'── Reaction Chain ──'", "string_agg('[' || Metabolic_Step_Position || '] ' || Primary_Substrate || ' --(' || Gene_Name || ')--> ' || Primary_Product, chr(10) ORDER BY p_partkey)"])),
    ("file % 4 = 1", "paper_overview", _LINES(["any_value(paper_head)", "''", "'── Gene Directory ──'", *[_DIRECTORY(b) for b in ("Common_Genes", "Pathway_Genes", "Regulation_Genes")]])),
    ("bucket = 'Regulation_Genes' AND Primary_Regulatory_Targets <> 'NA'", "regulatory_network", _LINES(["any_value(paper_head)", "''", "'── Regulatory Network ──'", f"string_agg('  ' || Gene_Name || ' → ' || array_to_string({_TARGETS}, ', ') || coalesce(' [' || nullif(Regulatory_Effect_on_Target_Genes, '') || ']', ''), chr(10) ORDER BY p_partkey)"])),
]
TYPED_SQL = f"WITH {GENES_SQL}, {_ALL}, c AS (" + " UNION ALL ".join([f"SELECT file, '{k}' AS chunk_type, Gene_Name AS gene_name, trim({content}, ' ' || chr(10)) AS content FROM g2 WHERE {where}" for where, k, content in _KINDS] + [f"SELECT file, '{k}', '{chunking.PAPER_NAME}', trim({content}, ' ' || chr(10)) FROM g2 WHERE {where} GROUP BY file HAVING count(*) > 0" for where, k, content in _PAPER_KINDS]) + f""")
SELECT CAST(file AS STRING) AS file, chunk_type, gene_name, content FROM c WHERE list_sum(list_transform(string_split(content, chr(10)), lambda x: CASE WHEN starts_with(x, '[') OR starts_with(x, '── ') THEN 0 ELSE length(x) END)) >= {chunking.LEAST_BODY}"""


def _typed(spark, d, *kinds):
    return chunking.chunks(papers(spark, d)).filter(F.col("chunk_type").isin(*kinds)).select("file", "chunk_type", "gene_name", "content")


def _kinds_query(name: str, *kinds: str):
    only = ", ".join(f"'{k}'" for k in kinds)

    @query(name, f"SELECT * FROM ({TYPED_SQL}) WHERE chunk_type IN ({only})")
    def chunks_of(spark, d):
        return _typed(spark, d, *kinds)

    return chunks_of


plant = _kinds_query("p04_plant_chunks", "plant_gene_overview", "plant_gene_mechanism", "plant_gene_phenotype", "plant_gene_variant_breeding", "plant_gene_methods")
overview = _kinds_query("p05_pathway_overview", "pathway_overview")
pathway_genes = _kinds_query("p07_pathway_genes", "pathway_gene", "common_gene")
directory = _kinds_query("p08_directory", "paper_overview")
network = _kinds_query("p09_network", "regulatory_network")
regulation_genes = _kinds_query("p10_regulation_genes", "regulation_gene")

ROUTE_SQL = f"SELECT CAST(file AS STRING) AS file, CASE file % 4 WHEN 0 THEN CASE WHEN count(*) >= 3 THEN 'pathway_chain' ELSE 'generic' END WHEN 1 THEN CASE WHEN bool_or(bucket = 'Regulation_Genes') AND bool_or(bucket <> 'Regulation_Genes') THEN 'mixed_bucket' ELSE 'generic' END WHEN 2 THEN 'plant_genes' ELSE 'generic' END AS route FROM g GROUP BY file"


@query("p01_routes", f"WITH {GENES_SQL} {ROUTE_SQL}")
def routes(spark, d):
    return papers(spark, d).select("file", chunking.route().alias("route"))


@query(
    "p02_dispatch",
    f"WITH {GENES_SQL}, r AS ({ROUTE_SQL}), t AS ({TYPED_SQL}) SELECT r.file, route, CASE WHEN route = 'generic' THEN (SELECT "
    f"count(*) FROM g WHERE CAST(g.file AS STRING) = r.file) ELSE (SELECT count(*) FROM t WHERE t.file = r.file) END::BIGINT AS "
    f"n_chunks FROM r",
)
def dispatch(spark, d):
    """How many chunks each paper gives by its route."""
    p = papers(spark, d)
    n = chunking.chunks(p).groupBy("file").agg(F.count("*").alias("n_chunks"))
    return p.select("file", chunking.route().alias("route")).join(n, "file", "left").select("file", "route", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"))


_GENERIC = [f"CASE WHEN {_FILLED(f)} THEN '{f}: ' || trim({f}) END" for f in FIELDS if f != "Gene_Name"]


@query(
    "p03_generic_chunks",
    f"WITH {GENES_SQL} SELECT CAST(file AS STRING) AS file, Gene_Name AS gene_name, "
    f"{_LINES(['$基因名称: $ || Gene_Name'.replace('$', chr(39)), chr(39) + '文章: ' + chr(39) + ' || Title', chr(39) + '期刊: ' + chr(39) + ' || Journal', chr(39) + 'DOI: ' + chr(39) + ' || DOI', chr(39) + '基因类型: ' + chr(39) + ' || bucket', chr(39) * 2, *_GENERIC])} "
    f"AS content FROM g WHERE file % 4 = 3",
)
def generic(spark, d):
    return _typed(spark, d, "gene").filter("int(file) % 4 = 3").select("file", "gene_name", "content")


@query(
    "p09_regulates",
    f"WITH {GENES_SQL}, r AS (SELECT *, {_TARGETS} AS targets FROM g WHERE bucket = 'Regulation_Genes' AND "
    f"Primary_Regulatory_Targets <> 'NA') SELECT CAST(file AS STRING) AS file, Gene_Name AS name, array_to_string(arg_max(targets, "
    f"p_partkey), '|') AS targets FROM r GROUP BY file, Gene_Name",
)
def regulates(spark, d):
    return chunking.regulations(papers(spark, d))[0].select("file", "name", F.array_join("targets", "|").alias("targets"))


@query(
    "p09_regulated_by",
    f"WITH {GENES_SQL}, r AS (SELECT *, {_TARGETS} AS targets FROM g WHERE bucket = 'Regulation_Genes' AND "
    f"Primary_Regulatory_Targets <> 'NA'), e AS (SELECT file, p_partkey, Gene_Name, targets[i] AS target, i FROM r, "
    f"unnest(range(1, len(targets) + 1)) AS u(i)) SELECT CAST(file AS STRING) AS file, target, string_agg(Gene_Name, '|' ORDER BY "
    f"p_partkey, i) AS regulators FROM e GROUP BY file, target",
)
def regulated_by(spark, d):
    return chunking.regulations(papers(spark, d))[1].select("file", "target", F.array_join("regulators", "|").alias("regulators"))


def _records(spark, d):
    g = chunking.genes(papers(spark, d))
    return g.select(F.concat_ws("/", "file", "bucket", "place").alias("id"), F.col("Title").alias("paper_title"), F.col("DOI").alias("doi"), F.col("gene").alias("metadata"))


_PLACE = "CAST(file AS STRING) || '/' || bucket || '/' || (row_number() OVER (PARTITION BY file, bucket ORDER BY p_partkey) - 1)"


@query("p15_fields", f"WITH {GENES_SQL}, r AS (SELECT *, {_PLACE} AS id FROM g) SELECT id, field, value FROM (" + " UNION ALL ".join(f"SELECT id, '{label}' AS field, {c} AS value FROM r" for label, c in [("paper_title", "Title"), ("doi", "DOI"), *[(f, f) for f in FIELDS]]) + f") WHERE {_FILLED('value')}")
def fields(spark, d):
    """Every filled field of every gene, one a row."""
    return chunking.fields_of(_records(spark, d))


@query(
    "p16_keyword_text",
    f"WITH {GENES_SQL} SELECT {_PLACE} AS id, "
    f"{_LINES(['Title', 'DOI', *[f'CASE WHEN {_FILLED(f)} THEN {f} END' for f in sorted(FIELDS)]])} AS words FROM g",
)
def keyword_text(spark, d):
    return _records(spark, d).select("id", chunking.keyword_text("paper_title", "doi").alias("words"))


@query(
    "p17_requested",
    f"WITH {GENES_SQL}, r AS (SELECT *, {_PLACE} AS id FROM g), v AS (SELECT id, 'gene' AS asked, 2.0 AS weight, 'Gene_Name' AS "
    f"field, Gene_Name AS value FROM r UNION ALL SELECT id, 'gene', 2.0, 'Enzyme_Name', Enzyme_Name FROM r UNION ALL SELECT id, "
    f"'Enzyme_Name', 0.5, 'Enzyme_Name', Enzyme_Name FROM r) SELECT id, asked, weight::DOUBLE AS weight, field, value FROM v WHERE "
    f"{_FILLED('value')}",
)
def requested(spark, d):
    """A requested field may name several stored ones, and a stored one may count for several."""
    return chunking.requested(chunking.fields_of(_records(spark, d)), {"gene": 2.0, "Enzyme_Name": 0.5}, {"gene": ("Gene_Name", "Enzyme_Name")})


@query(
    "p11_bodies",
    "SELECT doc_id, list_sum(list_transform(string_split(trim(text, ' '), chr(10)), lambda x: CASE WHEN starts_with(x, '[') OR "
    "starts_with(x, '── ') THEN 0 ELSE length(x) END))::INT AS body FROM documents WHERE text IS NOT NULL AND text <> ''",
)
def bodies(spark, d):
    return table(spark, d, "documents").filter("text <> ''").select("doc_id", chunking.body_length(F.col("text")).alias("body"))


MORE = {
    "Gene_Accession_Number": "'AC' || CAST(p_partkey AS STRING)",
    "Source_Species_Latin_Name": "CASE WHEN p_size % 8 = 0 THEN 'Zea mays' ELSE 'Unknown' END",
    "Applied_Species_Latin_Name": "CASE WHEN p_size % 3 = 0 THEN 'Hordeum vulgare' END",
    "Applied_Species": "CASE WHEN p_size % 2 = 0 THEN 'barley, winter type' ELSE 'n/a' END",
    "Pathway_Branch_or_Subpathway": "'branch a; branch b\nbranch ' || CAST(p_size AS STRING)",
    "Upstream_Signals_or_Inputs": "'light; cold, Light'",
    "Metabolic_Process_Controlled": "'growth; yield'",
    "Regulation_Mode": "CASE WHEN p_size % 2 = 0 THEN 'activates' ELSE 'none' END",
    "Summary_Key_Findings_of_Core_Gene": "p_name || ' matters'",
}
# The SQL states each rule by hand. Items of a list are distinct by their lower-case form, the first spelling counts.
_CLEAN = lambda x: f"CASE WHEN lower(trim({x})) IN ('', '-', 'na', 'n/a', 'none', 'null', 'nan', 'unknown', 'not established', 'not available', 'not applicable') THEN NULL ELSE trim({x}) END"
_SPECIES = ", ".join(_CLEAN(f) for f in ("Species_Latin_Name", "Source_Species_Latin_Name", "Applied_Species_Latin_Name", "Applied_Species", "Species"))
_ITEMS = lambda f: f"list_filter(list_transform(string_split_regex({f}, '[;,\n]'), lambda x: {_CLEAN('x')}), lambda x: x IS NOT NULL)"
_MORE_SQL = "p AS (SELECT *, CAST(floor(p_partkey / 5) AS BIGINT) AS file FROM part), " + f"g AS (SELECT file, p_partkey, {BUCKET} AS bucket, row_number() OVER (PARTITION BY floor(p_partkey / 5), {BUCKET} ORDER BY p_partkey) - 1 AS place, " + ", ".join(f"{e} AS {n}" for n, e in {**PAPER, **FIELDS, **MORE}.items()) + " FROM p)"
_WHOLE = lambda b, r, f, e=None: f"SELECT *, '{r}' AS relation, '{f}' AS field, [{e or _CLEAN(f)}] AS items FROM g WHERE bucket = '{b}_Genes' AND {e or _CLEAN(f)} IS NOT NULL"
_EACH = lambda b, r, f: f"SELECT *, '{r}' AS relation, '{f}' AS field, {_ITEMS(f)} AS items FROM g WHERE bucket = '{b}_Genes' AND {_CLEAN(f)} IS NOT NULL"
_LATIN = f"coalesce({_CLEAN('Applied_Species_Latin_Name')}, {_CLEAN('Applied_Species')})"
LOCAL_SQL = [
    *(_EACH("Pathway", "INPUT_OF", "Primary_Substrate"), _EACH("Pathway", "PRODUCES", "Primary_Product"), _WHOLE("Pathway", "CONTRIBUTES_TO", "Terminal_Metabolite")),
    *(_WHOLE("Pathway", "PARTICIPATES_IN", "Biosynthetic_Pathway"), _WHOLE("Pathway", "TESTED_IN", "Applied_Species"), _EACH("Regulation", "REGULATES", "Primary_Regulatory_Targets")),
    *(_EACH("Regulation", "UPSTREAM_SIGNAL_OF", "Upstream_Signals_or_Inputs"), _WHOLE("Regulation", "CONTROLS", "Metabolic_Process_Controlled"), _EACH("Regulation", "AFFECTS", "Terminal_Metabolite")),
    *(_WHOLE("Common", "ASSOCIATED_WITH", "Terminal_Metabolite"), _WHOLE("Common", "HAS_EFFECT", "Core_Phenotypic_Effect"), _WHOLE("Common", "TESTED_IN", "Applied_Species")),
]
STORED_SQL = [
    *(_EACH("Pathway", "INPUT_OF", "Primary_Substrate"), _EACH("Pathway", "PRODUCES", "Primary_Product"), _EACH("Pathway", "CONTRIBUTES_TO", "Terminal_Metabolite")),
    *(_EACH("Pathway", "PARTICIPATES_IN", "Biosynthetic_Pathway"), _EACH("Pathway", "PARTICIPATES_IN", "Pathway_Branch_or_Subpathway"), _EACH("Regulation", "REGULATES", "Primary_Regulatory_Targets")),
    *(_EACH("Regulation", "UPSTREAM_SIGNAL_OF", "Upstream_Signals_or_Inputs"), _EACH("Regulation", "CONTROLS", "Metabolic_Process_Controlled"), _EACH("Regulation", "AFFECTS", "Terminal_Metabolite")),
    *(_EACH("Common", "AFFECTS", "Terminal_Metabolite"), _WHOLE("Common", "HAS_EFFECT", "Core_Phenotypic_Effect"), *[_WHOLE(b, "TESTED_IN", "Applied_Species", _LATIN) for b in ("Pathway", "Regulation", "Common")]),
]
_DISTINCT = "list_filter(items, lambda x, i: list_position(list_transform(items, lambda y: lower(y)), lower(x)) = i)"


def _edges_sql(rules: list[str]) -> str:
    return f"""WITH {_MORE_SQL}, r AS ({' UNION ALL '.join(rules)}), d AS (SELECT *, {_DISTINCT} AS own, coalesce(nullif(DOI, 'NA'), CAST(file AS STRING)) AS paper FROM r),
e AS (SELECT * EXCLUDE (own, items), own[i] AS item, i - 1 AS nth FROM d, unnest(range(1, len(own) + 1)) AS u(i)),
k AS (SELECT *, paper || '::' || bucket || '[' || place || ']' AS record_key, sha1('{{"field": "' || field || '", "item": "' || lower(item) || '", "item_index": ' || nth || ', "paper": "' || paper || '", "record_index": ' || place || ', "relation": "' || relation || '", "section": "' || bucket || '"}}') AS relationship_key FROM e)"""


def _graph_edges(spark, d, form: str):
    return gene_graph.gene_edges(papers(spark, d, MORE), form).select("src", "dst", "relation", "evidence.*")


_COUNTS = " SELECT CAST(file AS STRING) AS file, relation, field, count(*)::BIGINT AS n, count(DISTINCT lower(item))::BIGINT AS items FROM k GROUP BY ALL"


def _counted(edges):
    return edges.groupBy("file", "relation", "field").agg(F.count("*").alias("n"), F.count_distinct(F.lower("item")).alias("items"))


@query("g01_gene_edges", _edges_sql(LOCAL_SQL) + _COUNTS)
def gene_edges(spark, d):
    """The local form: how many edges each rule gives in each paper, and to how many different things."""
    return _counted(_graph_edges(spark, d, "local"))


@query("g04_stored_edges", _edges_sql(STORED_SQL) + _COUNTS)
def stored_edges(spark, d):
    """The stored form, which splits every list and knows branches."""
    return _counted(_graph_edges(spark, d, "stored"))


@query("f22_gene_species", f"WITH {_MORE_SQL} SELECT CAST(file AS STRING) AS file, bucket, place::INT AS place, coalesce({_SPECIES}, '') AS species FROM g")
def gene_species(spark, d):
    genes = chunking.genes(papers(spark, d, MORE))
    return genes.select("file", "bucket", F.col("place").cast("int").alias("place"), gene_graph.species(F.col("gene")).alias("species"))


@query("f25_provenance", _edges_sql(STORED_SQL) + " SELECT record_key, record_key || '::' || field || '[' || nth || ']::' || relation AS relationship_index, relationship_key, item, mode FROM (SELECT *, CASE WHEN bucket = 'Regulation_Genes' THEN coalesce(" + _CLEAN("Regulation_Mode") + ", '') END AS mode FROM k)")
def provenance(spark, d):
    """Where each edge comes from: its record, the path to the item, and a key that no order of files changes."""
    return _graph_edges(spark, d, "stored").select("record_key", "relationship_index", "relationship_key", "item", "mode")


@query("f25_merged_provenance", _edges_sql(LOCAL_SQL) + ", n AS (SELECT *, sha1('Gene|' || lower(Gene_Name) || '|' || lower(coalesce(" + _SPECIES + ", ''))) AS own FROM k WHERE relation = 'CONTRIBUTES_TO') SELECT own AS src, count(*)::BIGINT AS evidence_count, min(relationship_key) AS relationship_key FROM n GROUP BY own, lower(item)")
def merged_provenance(spark, d):
    """Edges to end products, merged: how much evidence each has, and the first by key."""
    e = gene_graph.gene_edges(papers(spark, d, MORE), "local").filter("relation = 'CONTRIBUTES_TO'")
    return gene_graph.merged(e).select("src", "evidence_count", "evidence.relationship_key")


@query(
    "p06_reaction_chain",
    f"WITH {GENES_SQL} SELECT CAST(file AS STRING) AS file, string_agg('[' || Metabolic_Step_Position || '] ' || Primary_Substrate || ' --(' || "
    f"Gene_Name || ')--> ' || Primary_Product, chr(10) ORDER BY p_partkey) AS steps FROM g WHERE file % 4 = 0 GROUP BY file",
)
def reactions(spark, d):
    """The steps of each chain."""
    chains = papers(spark, d).filter(chunking.route() == "pathway_chain")
    return chains.select("file", F.array_join(chunking.reaction_steps(), "\n").alias("steps"))
