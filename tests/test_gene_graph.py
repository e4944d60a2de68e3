"""Rules of the two graphs, provenance, seeds, walks and packets."""

import hashlib
import json

from evigrain.operators import gene_graph, graph
from pyspark.sql import functions as F

PAPERS = "file string, Title string, Journal string, DOI string, Common_Genes array<map<string,string>>, Pathway_Genes array<map<string,string>>, Regulation_Genes array<map<string,string>>, Plant_Genes array<map<string,string>>"
COMMON = {"Gene_Name": "G1", "Terminal_Metabolite": "x acid; y", "Core_Phenotypic_Effect": "taller, greener", "Applied_Species": "rice", "Applied_Species_Latin_Name": "Oryza sativa"}
PATHWAY = {"Gene_Name": "CHS", "Primary_Substrate": "a, b; A", "Primary_Product": "c", "Terminal_Metabolite": "x acid; y", "Biosynthetic_Pathway": "p, q", "Pathway_Branch_or_Subpathway": "r", "Source_Species": "maize", "Species": "corn"}
REGULATION = {"Gene_Name": "MYB", "Primary_Regulatory_Targets": "CHS; DFR", "Upstream_Signals_or_Inputs": "light", "Metabolic_Process_Controlled": "growth; yield", "Terminal_Metabolite": "x; y", "Applied_Species": "rice", "Regulation_Mode": "up"}


def papers(spark, name="dir/p.json", doi="10.1/x"):
    return spark.createDataFrame([(name, "t", "j", doi, [COMMON, {"Gene_Name": "NA", "Terminal_Metabolite": "z"}], [PATHWAY], [REGULATION], None)], PAPERS)


def items(rows, bucket):
    return sorted((r.relation, r.evidence.item) for r in rows if r.evidence.bucket == bucket)


def test_the_two_forms(spark):
    local, stored = (gene_graph.gene_edges(papers(spark), f).collect() for f in ("local", "stored"))
    assert items(local, "Common_Genes") == [("ASSOCIATED_WITH", "x acid; y"), ("HAS_EFFECT", "taller, greener"), ("TESTED_IN", "rice")]
    assert items(stored, "Common_Genes") == [("AFFECTS", "x acid"), ("AFFECTS", "y"), ("HAS_EFFECT", "taller, greener"), ("TESTED_IN", "Oryza sativa")]
    assert items(local, "Pathway_Genes") == [("CONTRIBUTES_TO", "x acid; y"), ("INPUT_OF", "a"), ("INPUT_OF", "b"), ("PARTICIPATES_IN", "p, q"), ("PRODUCES", "c")]
    assert items(stored, "Pathway_Genes") == [("CONTRIBUTES_TO", "x acid"), ("CONTRIBUTES_TO", "y"), ("INPUT_OF", "a"), ("INPUT_OF", "b"), ("PARTICIPATES_IN", "p"), ("PARTICIPATES_IN", "q"), ("PARTICIPATES_IN", "r"), ("PRODUCES", "c")]
    assert items(local, "Regulation_Genes") == [("AFFECTS", "x"), ("AFFECTS", "y"), ("CONTROLS", "growth; yield"), ("REGULATES", "CHS"), ("REGULATES", "DFR"), ("UPSTREAM_SIGNAL_OF", "light")]
    assert items(stored, "Regulation_Genes") == [("AFFECTS", "x"), ("AFFECTS", "y"), ("CONTROLS", "growth"), ("CONTROLS", "yield"), ("REGULATES", "CHS"), ("REGULATES", "DFR"), ("TESTED_IN", "rice"), ("UPSTREAM_SIGNAL_OF", "light")]


def test_species_in_order(spark):
    fields = list(gene_graph.SPECIES)
    for i, f in enumerate(fields):
        gene = {x: "here" if x == f else "behind" if fields.index(x) > i else "N/A" for x in fields}
        df = spark.createDataFrame([(gene,)], "gene map<string,string>")
        assert df.select(gene_graph.species(F.col("gene"))).first()[0] == "here"


def test_provenance(spark):
    odd = 'β-carotene "all\\trans"\t😀 é\x01 \x7f'
    df = papers(spark).withColumn("Pathway_Genes", F.array(F.create_map(F.lit("Gene_Name"), F.lit("G"), F.lit("Primary_Product"), F.lit("c; " + odd))))
    got = {r.evidence.item: r.evidence for r in gene_graph.gene_edges(df).filter("relation = 'PRODUCES'").collect()}
    e = got[odd]
    assert (e.record_key, e.relationship_index, e.item_index) == ("10.1/x::Pathway_Genes[0]", "10.1/x::Pathway_Genes[0]::Primary_Product[1]::PRODUCES", 1)
    name = " ".join(odd.lower().split())
    raw = {"paper": "10.1/x", "section": "Pathway_Genes", "record_index": 0, "relation": "PRODUCES", "field": "Primary_Product", "item": name, "item_index": 1}
    assert e.relationship_key == hashlib.sha1(json.dumps(raw, sort_keys=True).encode()).hexdigest()
    # Without a DOI the file's name tells the paper, wherever the file lies.
    a, b = (gene_graph.gene_edges(papers(spark, f"{d}/p.json", "NA")).select("evidence.relationship_key").collect() for d in ("x", "y/z"))
    assert sorted(a) == sorted(b)


def test_merged_evidence_is_stable(spark):
    both = [papers(spark, "a.json", "10.1/a"), papers(spark, "b.json", "10.1/b")]
    one, two = ({(r.src, r.dst, r.relation): (r.evidence_count, tuple(r.sections), r.evidence.relationship_key) for r in gene_graph.merged(gene_graph.gene_edges(x.unionByName(y))).collect()} for x, y in (both, both[::-1]))
    assert one == two and {v[0] for v in one.values()} == {2}


def test_seeds(spark):
    rows = [("1", "Metabolite", "CHS"), ("2", "Gene", "chs"), ("3", "Gene", "DFR"), ("4", "Pathway", "chs like thing"), ("5", "Gene", "A_B"), ("6", "Gene", "AxB")]
    nodes = spark.createDataFrame([(*r, "rice" if r[0] == "3" else "") for r in rows], "id string, type string, name string, species string")
    ids = lambda *a, **k: [r.id for r in graph.seeds(*a, **k).collect()]
    assert ids("What about CHS and dfr?", nodes) == ["2", "3", "1"]
    assert ids("What about CHS and dfr?", nodes, limit=1) == ["2"]
    assert ids("What about CHS and dfr?", nodes, species="Maize") == ["2", "1"]
    assert ids("hs  LIKE", nodes) == ["4"] and ids("_b", nodes) == ["5", "6"] and ids(" ", nodes) == []


def test_an_edge_comes_again(spark):
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("x", "y", "r")], "src string, dst string, relation string")
    start = spark.createDataFrame([("a",)], "id string")
    walk = lambda *a, **k: sorted((r.hop, r.src, r.dst) for r in graph.question_walk(start, edges, *a, **k).collect())
    assert walk(2) == [(1, "a", "b"), (2, "a", "b"), (2, "b", "c")]
    assert walk(2, limit=2) == [(1, "a", "b"), (2, "a", "b")]
    assert walk(3, "downstream") == [(1, "a", "b"), (2, "b", "c")]
    assert walk(1, "upstream") == []


def test_packets_of_paths(spark):
    node = lambda i: {"id": i, "name": f"n{i}"}
    rows = [(1, 0, [node("a"), node("b"), node("c")], [{"src": "a", "dst": "b"}, {"src": "b", "dst": "c"}]), (1, 1, [node("a"), node("d")], [{"src": "a", "dst": "d"}, {"src": "", "dst": "d"}]), (2, 0, [node("z")], [])]
    paths = spark.createDataFrame(rows, "packet int, path int, nodes array<struct<id:string,name:string>>, edges array<struct<src:string,dst:string>>")
    nodes, edges = graph.evidence_graphs(*graph.flattened(paths), 2, 3)
    assert sorted((r.packet, r["rank"], r.src, r.dst) for r in edges.collect()) == [(1, 1, "a", "b"), (1, 2, "b", "c")]
    assert sorted((r.packet, r["rank"], r.id) for r in nodes.collect()) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c")]
