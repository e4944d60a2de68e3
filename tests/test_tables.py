"""Small formats, read and written."""

import json
import re
from xml.etree import ElementTree

from evigrain.sources import tables


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "b")], "id long, body string")
    assert tables.write_json_lines(df, f"{tmp_path}/q") == 4
    got = tables.questions(spark, f"{tmp_path}/q", "id LONG, body STRING")
    assert sorted(r.id for r in got.collect()) == [1, 4]
    assert tables.questions(spark, f"{tmp_path}/q", "id LONG, body STRING", limit=1).count() == 1


def test_tsv_and_csv(spark, tmp_path):
    tables.write_tsv(spark.createDataFrame([("g1", "Zea mays"), ("", "x"), ("g2", None)], "gene string, species string"), f"{tmp_path}/t")
    assert sorted(map(tuple, tables.gene_table(spark, f"{tmp_path}/t").collect())) == [("g1", "Zea mays"), ("g2", "")]
    nodes = spark.createDataFrame([("a", "Gene", "A"), (None, "Gene", "B"), ("c", "Gene", "C")], "id string, type string, name string")
    edges = spark.createDataFrame([("a", "c", "R"), ("a", None, "R")], "src string, dst string, relation string")
    tables.export_graph(nodes, edges, f"{tmp_path}/g")
    n, e = tables.graph_tables(spark, f"{tmp_path}/g/nodes", f"{tmp_path}/g/edges")
    assert sorted(r.id for r in n.collect()) == ["a", "c"] and [tuple(r) for r in e.collect()] == [("a", "c", "R")]
    assert {json.dumps(r.asDict(), sort_keys=True) for r in spark.read.json(f"{tmp_path}/g/links").filter("target IS NOT NULL").collect()} == {'{"relation": "R", "source": "a", "target": "c"}'}
    assert spark.read.text(f"{tmp_path}/g/edge_list").count() == 2


def test_listing(spark, tmp_path):
    for i, name in enumerate(("b", "a")):
        (tmp_path / f"{name}.json").write_text("{}" * (i + 1))
    (tmp_path / "x.txt").write_text("no")
    got = tables.listing(spark, str(tmp_path)).collect()
    assert {(r.file, r.bytes) for r in got} == {("a.json", 4), ("b.json", 2)}
    assert [r.modified for r in got] == sorted((r.modified for r in got), reverse=True)


def test_graph_documents(spark, tmp_path):
    nodes = spark.createDataFrame([("a<b", "Gene"), ("c\x01&", "Metabolite")], "id string, type string")
    edges = spark.createDataFrame([("a<b", "c\x01&", 'x"y')], "src string, dst string, relation string")
    whole = lambda name: "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
    tables.write_graphml(nodes, edges, f"{tmp_path}/graphml")
    space = "{http://graphml.graphdrawing.org/xmlns}"
    graph = ElementTree.fromstring(whole("graphml").encode()).find(f"{space}graph")
    assert [(n.get("id"), n[0].text) for n in graph.findall(f"{space}node")] == [("a<b", "Gene"), ("c&", "Metabolite")]
    assert [(e.get("source"), e.get("target"), e[0].text) for e in graph.findall(f"{space}edge")] == [("a<b", "c&", 'x"y')]
    tables.write_gml(nodes, edges, f"{tmp_path}/gml")
    text = whole("gml")
    ids = re.findall(r"node \[ id (\d+) label", text)
    assert text.startswith("graph [\n  directed 1\n") and text.endswith("]\n") and len(set(ids)) == 2
    assert re.findall(r"edge \[ source (\d+) target (\d+) edge_type \"(.*?)\" \]", text) == [(*ids, "x&quot;y")]


def test_results(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"question": 1, "answer": "a"}\n\n{"question": \n{"question": 2, "answer": null}\n')
    assert [(r.question, r.answer) for r in tables.results(spark, f"{tmp_path}/r.jsonl", "question LONG, answer STRING").orderBy("question").collect()] == [(1, "a"), (2, None)]
