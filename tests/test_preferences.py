"""Preference pairs come from answers to the same query."""

from evigrain import plans
from tests.compare import rows


def test_pairs_of_repeated_queries(spark, tmp_path):
    asked = {1: "How tall is it?", 2: " how tall is it? ", 3: "How wide is it?", 4: "HOW TALL IS IT?", 5: "how wide is it?", 6: "Other", 7: "", 8: ""}
    turns = [(i, n, role, text) for i, q in asked.items() for n, (role, text) in enumerate([("user", q), ("assistant", f"answer {i}")])]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    good = {1: 1, 2: 0, 3: 1, 4: 0, 5: 1, 6: 0, 7: 1, 8: 0}
    spark.createDataFrame([(i, q, 0) for i, q in good.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [(r["query"], r.chosen_id, r.rejected_id) for r in plans.QUERIES["x11_same_query"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [("how tall is it?", 1, 2), ("how tall is it?", 1, 4)]


def test_pairs_against_sql(spark, small):
    got, want = rows(spark, plans.QUERIES["x11_same_query"], plans.ORACLE_SQL["x11_same_query"], small)
    assert got == want
