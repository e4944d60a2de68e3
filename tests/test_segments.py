"""An index that follows its files against one that is built anew."""

import json
from pathlib import Path

import pytest

from evigrain.operators import ranking
from evigrain.sources import segments


def put(folder: Path, name: str, rows: dict) -> None:
    (folder / name).write_text("\n".join(json.dumps({"doc_id": k, "text": v}) for k, v in rows.items()))


def scores(spark, index, query):
    return {r[0]: round(r[1], 9) for r in ranking.bm25(index, query, key="key").collect()}


def anew(spark, folder, query):
    docs = spark.read.schema("doc_id long, text string").json(str(folder)).withColumnRenamed("doc_id", "key")
    return {r[0]: round(r[1], 9) for r in ranking.bm25(docs, query, key="key").collect()}


class Corpus:
    def __init__(self, spark, folder):
        self.spark, self.folder, self.root = spark, folder / "in", f"file://{folder}/index"
        self.folder.mkdir()
        self.read = []

    def update(self, version="1"):
        def read(files):
            self.read = files
            return self.spark.read.schema("doc_id long, text string").json(files or str(self.folder)).selectExpr("_metadata.file_path AS file", "doc_id AS key", "text")

        return segments.update(self.spark, self.root, segments.digests(self.spark, str(self.folder), "*.json"), read, version)

    def check(self, *queries):
        for q in queries:
            got = scores(self.spark, segments.index(self.spark, self.root), q)
            assert got == anew(self.spark, self.folder, q) and got


@pytest.fixture
def corpus(spark, tmp_path):
    c = Corpus(spark, tmp_path)
    for i in range(30):
        put(c.folder, f"{i}.json", {10 * i + j: f"gene alpha{i % 5} binds beta{j} in the root " * (1 + (i + j) % 3) for j in range(4)})
    return c


def test_only_changed_files_are_read_and_all_numbers_are_exact(corpus):
    said = corpus.update()
    assert said["changed"] == 30 and said["n"] == 120
    corpus.check("alpha1 beta2", "the root", "gene")
    assert corpus.update()["changed"] == 0

    put(corpus.folder, "7.json", {70: "gamma alone", 71: "alpha2 alpha2 beta1", 72: "", 300: "the new one"})
    (corpus.folder / "9.json").unlink()
    put(corpus.folder, "30.json", {400: "beta2 again"})
    said = corpus.update()
    assert sorted(f.rsplit("/", 1)[1] for f in corpus.read) == ["30.json", "7.json"]
    assert (said["changed"], said["buried"], said["n"], len(said["segments"])) == (2, 2, 117, 2)
    corpus.check("alpha1 beta2", "the root", "gamma", "gene alpha2 new")
    # The same content under a later time is no change.
    put(corpus.folder, "7.json", {70: "gamma alone", 71: "alpha2 alpha2 beta1", 72: "", 300: "the new one"})
    assert corpus.update()["changed"] == 0


def test_a_file_that_changes_again_and_comes_back(corpus):
    corpus.update()
    for text in ("gene one", "gene two two", "gene one"):
        put(corpus.folder, "3.json", {30: text})
        corpus.update()
        corpus.check("gene two", "gene")
    (corpus.folder / "3.json").unlink()
    corpus.update()
    corpus.check("gene", "alpha4 one")
    put(corpus.folder, "3.json", {30: "gene one"})
    corpus.update()
    corpus.check("gene one")


def test_segments_are_merged_and_pruned(corpus):
    corpus.update()
    merged = [False]
    for i in range(segments.MANY):
        put(corpus.folder, f"{i}.json", {10 * i: f"delta{i} gene"})
        merged.append(corpus.update()["merged"])
    assert any(merged)
    note = segments.pointer(corpus.spark, corpus.root)
    assert len(note["segments"]) <= segments.MANY
    corpus.check("delta1 gene", "alpha3 beta1")
    assert segments.prune(corpus.spark, corpus.root) and segments.prune(corpus.spark, corpus.root) == []
    corpus.check("delta1 gene", "alpha3 beta1")


def test_many_dead_files_are_merged_away(corpus):
    corpus.update()
    for i in range(12):
        (corpus.folder / f"{i}.json").unlink()
    said = corpus.update()
    assert said["merged"] and len(said["segments"]) == 1 and said["n"] == 72
    corpus.check("gene alpha3")


def test_another_version_makes_all_new(corpus):
    corpus.update()
    assert corpus.update("2")["changed"] == 30
    corpus.check("gene alpha3")


def test_a_damaged_pointer_is_an_error(corpus, tmp_path):
    corpus.update()
    pointer = tmp_path / "index" / "CURRENT"
    pointer.write_text(pointer.read_text().replace('\\"n\\": 120', '\\"n\\": 121'))
    (tmp_path / "index" / ".CURRENT.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="damaged"):
        segments.index(corpus.spark, corpus.root)


def moved(spark) -> int:
    """Rows that shuffles have written so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_an_update_moves_no_postings(spark, tmp_path):
    """Disk holds a segment once: neither counting nor sorting sends its postings through a shuffle."""
    c, words = Corpus(spark, tmp_path), [f"word{i}" for i in range(50)]
    for i in range(8):
        put(c.folder, f"{i}.json", {100 * i + j: " ".join(words[j % 3 :] + words) for j in range(100)})
    before = moved(spark)
    c.update()
    held = spark.read.parquet(f"{segments.pointer(spark, c.root)['segments'][0]}/postings").count()
    assert held == 800 * 50 and moved(spark) - before < held / 4
    before = moved(spark)
    put(c.folder, "3.json", {300: "word1 alone"})
    c.update()
    assert moved(spark) - before < held / 4
    c.check("word1 alone", "word2 word49")


def test_several_rows_of_one_key_in_a_file(spark, tmp_path):
    c = Corpus(spark, tmp_path)
    lines = [(1, "gene alpha root"), (1, "gene beta root"), (2, "gene gamma stem"), (1, "gene alpha root")]
    (c.folder / "0.json").write_text("\n".join(json.dumps({"doc_id": k, "text": t}) for k, t in lines))
    put(c.folder, "1.json", {3: "stem beta", 4: "", 5: None})
    assert c.update()["n"] == 7
    c.check("gene alpha", "beta root", "stem")
    put(c.folder, "0.json", {2: "gene gamma stem", 6: "alpha"})
    assert c.update()["n"] == 5
    c.check("gene alpha", "beta", "stem")


def test_an_index_of_another_format_is_built_anew(corpus):
    corpus.update()
    note = segments.pointer(corpus.spark, corpus.root)
    segments._point(corpus.spark, corpus.root, {k: v for k, v in note.items() if k not in ("format", "next")})
    with pytest.raises(ValueError, match="another format"):
        segments.index(corpus.spark, corpus.root)
    assert corpus.update()["changed"] == 30
    corpus.check("gene alpha3")


def test_names_that_a_path_encodes(spark, tmp_path):
    c, odd = Corpus(spark, tmp_path), ("a b+c.json", "d%20é#.json")
    for i, name in enumerate(("plain.json", *odd)):
        put(c.folder, name, {10 * i + j: f"gene alpha{j} of {i} " * (1 + j) for j in range(3)})
    assert c.update()["n"] == 9
    c.check("alpha1 gene", "alpha2 of")
    put(c.folder, odd[0], {10: "alpha1 alone"})
    (c.folder / odd[1]).unlink()
    said = c.update()
    assert (said["changed"], said["buried"], said["n"]) == (1, 2, 4)
    c.check("alpha1 gene", "alone alpha2")
