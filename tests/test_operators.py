"""Operators on small cases with known results."""

import pytest
from pyspark.sql import functions as F

from evigrain import plans
from evigrain.functions import text as T
from evigrain.operators import curation, evaluation, fusion, graph, interactions, keywords, ranking, sequences


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_tokens(spark):
    got = one(spark, T.tokens("t", True), t="GAME8 and CYP72A208 affect 25S α-番茄碱; DOI 10.1038/s41467-000.")
    assert {"game8", "cyp72a208", "25s", "α-番茄碱", "10.1038/s41467-000."} <= set(got)
    assert one(spark, T.tokens("t"), t="rare rare spacer rare") == ["rare", "spacer", "rare"]
    assert one(spark, T.tokens("t"), t="番茄碱") == ["番茄", "茄碱"]


def test_identifiers(spark):
    assert one(spark, T.doi("t"), t="https://dx.doi.org/10.1/x ") == "10.1/x"
    assert one(spark, T.title_key("t"), t="A <i>Big</i> α_Title!") == "a big α title"
    assert one(spark, T.items("t"), t="CHS; dfr,DFR\nNA") == ["CHS", "dfr"]
    assert one(spark, T.gene_names("t"), t="OsNAS1 and SpCas9 with ZmPSY1 and OsNAS1") == ["OsNAS1", "ZmPSY1"]
    assert one(spark, T.reverse_complement("t"), t="ACGTNacg") == "cgtNACGT"


def test_bm25_ranks_the_rare_term_and_falls_back(spark):
    docs = spark.createDataFrame([(0, "GAME8 controls stereochemistry"), (1, "PSY1 controls carotenoids"), (2, "other words")], "doc_id long, text string")
    assert ranking.top(ranking.bm25(docs, "GAME8 stereochemistry"), 1, F.desc("score")).first()["doc_id"] == 0
    long = spark.createDataFrame([(0, "rare spacer " * 70000)], "doc_id long, text string")
    assert [tuple(r) for r in ranking.bm25(long, "rare").collect()] == [(0, 70000.0)]


def test_rrf(spark):
    a = spark.createDataFrame([(1, 1), (0, 2)], "id long, rank int")
    b = spark.createDataFrame([(0, 1)], "id long, rank int")
    assert [r["id"] for r in ranking.rrf([(a, 1.0), (b, 1.0)]).orderBy(F.desc("score"), "first").collect()] == [0, 1]


def test_keyword_needs_a_cohit(spark):
    docs = spark.createDataFrame([(0, "GA means glycyrrhetinic acid in licorice"), (1, "GA means gibberellic acid")], "id long, content string")
    spec = [keywords.Concept("ga", (keywords.Form("GA", 1.0, "token", ("glycyrrhetinic", "licorice")),), {"content": 1.0})]
    assert [r["id"] for r in keywords.scored(docs, spec).collect()] == [0]


def test_fusion_covers_both_sources(spark):
    rows = spark.createDataFrame([("p", 1, "x", 0.0), ("g", 1, "y", 5.0), ("g", 2, "x", 4.0)], "source string, pos int, key string, score double")
    assert [(r["key"], r["source"]) for r in fusion.fused(rows, 3).orderBy("place").collect()] == [("y", "g"), ("x", "p")]


def test_statistics_leave_failures_out(spark):
    rows = spark.createDataFrame([(1, 8.0, 10.0, "", "", ""), (2, 0.0, 10.0, "", "", ""), (3, 0.0, 10.0, "judge_error", "", "")], "question long, score double, max_score double, status string, error string, detail string")
    r = evaluation.statistics(rows).first()
    assert (r["total"], r["valid"], r["success_rate"], r["mean_score"], r["score_rate"]) == (3, 2, "66.67%", 4.0, "40.00%")
    left = evaluation.remaining(rows.select("question"), rows, retry_failed=True)
    assert [x["question"] for x in left.collect()] == [3]


def test_interactions(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "better"), (2, 0, "user", "Q "), (2, 1, "assistant", "worse")], "conv_id long, turn long, role string, text string")
    feedback = spark.createDataFrame([(1, "down", 0), (1, "up", 1), (2, "down", 0)], "interaction_id long, rating string, at int")
    rows = interactions.with_feedback(interactions.folded(turns), feedback)
    assert [(r["chosen"], r["rejected"]) for r in interactions.preference_pairs(rows).collect()] == [("better", "worse")]
    assert {r["feedback"] for r in interactions.training_rows(rows).collect()} == {"up", "down"}


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "R"), ("b", "c", "R"), ("c", "a", "R")], "src string, dst string, relation string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert sorted(r["nodes"] for r in graph.paths(ids("a"), ids("c"), e, 3).collect()) == [["a", "b", "c"], ["a", "c"]]
    twice = spark.createDataFrame([("a", "b", "R", "s1", "", 0), ("a", "b", "R", "s2", "v", 1)], "src string, dst string, relation string, section string, value string, ord int")
    r = graph.merged_edges(twice).first()
    assert (r["evidence_count"], r["sections"], r["value"]) == (2, ["s1", "s2"], "v")


def test_manifest(spark):
    old = spark.createDataFrame([("a", "1", "2"), ("b", "1", "2"), ("c", "1", "2")], "file string, sha string, chunker_version string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "1")], "file string, sha string")
    assert {tuple(r) for r in curation.manifest_diff(old, new, "2").collect()} == {("a", "keep"), ("b", "rebuild"), ("c", "drop"), ("d", "rebuild")}


def test_a_budget_is_a_jobs(spark, tmp_path):
    rows = spark.range(400_000).select(F.col("id").alias("p_partkey"), F.lit(50).alias("p_size"))
    rows.write.parquet(f"{tmp_path}/part.parquet")
    assert plans.QUERIES["a30_checked_total"](spark, str(tmp_path)).count() == 400_000
    held = lambda total: sequences.within_total(rows, "p_size", 50, total, F.floor(F.col("p_partkey") / 100))
    assert held(5_000).count() == 400_000
    for over in (held(4_999), sequences.within_total(rows, "p_size", 50, 8_000_000), sequences.within_total(rows, "p_size", 49, 1 << 40)):
        with pytest.raises(Exception, match="over their budget"):
            over.collect()


def test_copies_of_a_text_have_equal_scores(spark):
    """Whatever the order in which their postings come."""
    terms = {"w1": 0.1, "w2": 0.2, "w3": 0.3, "w4": 1e16, "w5": 0.7}
    rows = [(k, t, 1, 5) for k in range(40) for t in (sorted(terms) if k % 2 else sorted(terms, reverse=True))]
    postings = spark.createDataFrame(rows, "doc_id long, term string, tf long, dl long").coalesce(1)
    index = ranking.Index(postings, spark.createDataFrame([(t, 1, x) for t, x in terms.items()], "term string, df long, idf double"), spark.createDataFrame([(40, 5.0)], "n long, avgdl double"))
    assert ranking.bm25(index, " ".join(terms)).select("score").distinct().count() == 1
    parts = [(i, w) for i, w in enumerate((0.1, 0.2, 1e16, 0.3))]
    lists = [(spark.createDataFrame([(k, 1) for k in range(40)], "id long, rank int"), w) for _, w in parts]
    assert ranking.rrf(lists).select("score").distinct().count() == 1
