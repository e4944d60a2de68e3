"""Papers, chunks, edges, FASTA and generations."""

import json
import shutil

import pytest

from evigrain.operators import chunking, gene_graph, graph
from evigrain.sources import corpus, store


@pytest.fixture
def papers(spark, tmp_path):
    gene = lambda n, **f: {"Gene_Name": n, "Biosynthetic_Pathway": "Flavonoid", "Terminal_Metabolite": "Anthocyanin; Flavonol", **f}
    chain = {"Title": "A chain", "Journal": "J", "DOI": "10.1/a", "Pathway_Genes": [gene("CHS", Primary_Substrate="CoA", Primary_Product="chalcone"), gene("CHI"), gene("F3H", Species="Zea mays")]}
    mixed = {"Title": "Mixed", "Journal": "J", "Common_Genes": [{"Gene_Name": "G1", "Core_Phenotypic_Effect": "tall, green"}], "Regulation_Genes": [{"Gene_Name": "MYB1", "Primary_Regulatory_Targets": "CHS; DFR"}]}
    common = {"Title": "One", "Common_Genes": [{"Gene_Name": "G2", "Note": "x", "Empty": "NA"}]}
    for name, paper in (("a", chain), ("b", mixed), ("c", common)):
        (tmp_path / f"{name}.json").write_text(json.dumps(paper))
    (tmp_path / "bad.json").write_text("{")
    return corpus.papers(spark, str(tmp_path))


def test_routes(papers):
    got = {r.file: r.route for r in papers.select("file", chunking.route().alias("route")).collect()}
    assert got == {"a.json": "pathway_chain", "b.json": "mixed_bucket", "c.json": "generic"}


def test_chunks(papers):
    rows = {r.gene_name: r for r in chunking.generic_chunks(papers, {"Note": "Remark"}).collect()}
    assert set(rows) == {"CHS", "CHI", "F3H", "G1", "MYB1", "G2"}
    assert rows["G2"].content.endswith("\n\nRemark: x") and rows["G2"].source_fields == ["Gene_Name", "Note"]
    kinds = [(r.file, r.chunk_type, r.gene_name) for r in chunking.chunks(papers).orderBy("file", "place").collect()]
    assert kinds == [("a.json", "pathway_gene", "CHS"), ("c.json", "gene", "G2")] or kinds[-1] == ("c.json", "gene", "G2")


def test_edges(papers):
    rows = gene_graph.gene_edges(papers).collect()
    assert sorted(r.relation for r in rows if r.evidence.file == "b.json") == ["HAS_EFFECT", "REGULATES", "REGULATES"]
    made = {(r.relation, r.evidence.item) for r in rows if r.evidence.file == "a.json"}
    assert ("INPUT_OF", "CoA") in made and ("PRODUCES", "chalcone") in made


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a one\nACG\nTN\n>b\nAXZ\n")
    got = {r.header: (r.sequence, r.valid) for r in corpus.fasta(spark, str(tmp_path / "x.fa")).collect()}
    assert got == {"a one": ("ACGTN", True), "b": ("AXZ", False)}


def test_generations(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert store.manifest(spark, root) is None
    for n in (3, 5):
        folder = store.published({"ids": spark.range(n).toDF("id")}, root, f"g{n}")
        assert store.current(spark, root)["ids"].count() == n and store.manifest(spark, root)["sources"] == f"g{n}"
    shutil.rmtree(folder.removeprefix("file://") + "/ids")
    spark.range(4).toDF("id").write.parquet(f"{folder}/ids")
    with pytest.raises(ValueError):
        store.current(spark, root)
    (tmp_path / "store" / ".CURRENT.crc").unlink(missing_ok=True)
    (tmp_path / "store" / "CURRENT").write_text((tmp_path / "store" / "CURRENT").read_text().replace("g5", "g6"))
    with pytest.raises(ValueError):
        store.manifest(spark, root)
    listing = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert [r.name for r in store.to_prune(listing, ["a"], "c").collect()] == ["b"]


def test_derived_tables_are_built_once_and_anew_when_files_change(spark, tmp_path):
    path, built = f"{tmp_path}/t.parquet", []
    spark.range(3).write.parquet(path)

    def build():
        built.append(1)
        return {"t": spark.read.parquet(path)}

    assert store.kept(spark, path, "test", build)["t"].count() == 3
    store._opened.clear()
    assert store.kept(spark, path, "test", build)["t"].count() == 3 and len(built) == 1
    spark.range(9).write.mode("overwrite").parquet(path)
    assert store.kept(spark, path, "test", build)["t"].count() == 9 and len(built) == 2
    assert store.kept(spark, path, "test", build, version="2")["t"].count() == 9 and len(built) == 3


def test_broken_papers(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"Title": "t", "Plant_Genes": [{"Gene_Name": "g"}]}')
    (tmp_path / "bad.json").write_text('{"Title": ')
    (tmp_path / "other.txt").write_text("no paper")
    assert [r.file for r in corpus.papers(spark, str(tmp_path)).collect()] == ["good.json"]
    assert [r.file for r in corpus.broken_papers(spark, str(tmp_path)).collect()] == ["bad.json"]


def test_generations_are_named_by_their_content_and_pruned(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    rows = lambda n: {"ids": spark.range(n).coalesce(1).toDF("id")}
    first = store.published(rows(3), root, "s")
    assert store.published(rows(3), root, "s") == first and store.current(spark, root)["ids"].count() == 3
    assert len({first, store.published(rows(4), root, "s"), store.published(rows(3), root, "t")}) == 3
    store.published(rows(9), root, "s")
    # The current one and the one before it.
    assert len([p for p in (tmp_path / "store").iterdir() if p.is_dir()]) == 2 and store.current(spark, root)["ids"].count() == 9


def test_a_paper_with_something_that_is_no_record_is_generic(spark):
    rows = [(f, "t", "j", "d", None, None, None, genes) for f, genes in (("a", [{"Gene_Name": "g"}, None]), ("b", [{"Gene_Name": "g"}]))]
    maps = "array<map<string,string>>"
    df = spark.createDataFrame(rows, f"file string, Title string, Journal string, DOI string, Common_Genes {maps}, Pathway_Genes {maps}, Regulation_Genes {maps}, Plant_Genes {maps}")
    assert [(r.file, r.route, r.gene_name) for r in chunking.chunks(df).collect()] == [("a", "generic", "g")]


def test_pathway_genes_and_markdown_and_accessions(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"Title": "t", "Pathway_Genes": [{"Gene_Name": "g", "Primary_Substrate": "s", "Primary_Product": "p"}, {"Gene_Name": "h"}]}')
    (tmp_path / "a.json").write_text('{"Title": "t", "Pathway_Genes": [{"Gene_Name": "f"}]}')
    (tmp_path / "c.json").write_text("{")
    genes, failed = corpus.pathway_genes(spark, str(tmp_path))
    assert [(r.name, r.substrate, r["product"]) for r in genes.orderBy("ord").collect()] == [("f", None, None), ("g", "s", "p"), ("h", None, None)]
    assert [tuple(r) for r in failed.collect()] == [("c.json", "no JSON")]
    (tmp_path / "small.md").write_text("# é")
    (tmp_path / "large.md").write_text("x" * 100)
    assert [tuple(r) for r in corpus.markdown(spark, str(tmp_path), 50).collect()] == [("small.md", "# é")]
    (tmp_path / "acc.tsv").write_text("rice\tg1\tNM_1\tmore\nrice\tg2\nrice\tg3\t \n\nmaize\tg4\tNM_4\n")
    assert sorted(tuple(r) for r in corpus.accessions(spark, f"{tmp_path}/acc.tsv").collect()) == [("maize", "g4", "NM_4"), ("rice", "g1", "NM_1")]


def test_components_of_a_hub_and_a_chain(spark):
    pairs = [("hub", f"n{i:04}") for i in range(1500)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("z", "z"), ("y", "x")]
    edges = spark.createDataFrame([(a, b, "r") for a, b in pairs], "src string, dst string, relation string")
    got = {r.id: r.component for r in graph.weak_components(edges).collect()}
    assert len(got) == 1501 + 61 + 1 + 2 and {v for k, v in got.items() if k[0] in "hn"} == {"hub"} and {v for k, v in got.items() if k[0] == "c"} == {"c000"}
    assert (got["z"], got["x"], got["y"]) == ("z", "x", "x")
