"""Compatibility forms give the tokens, scores and matches of the plain forms."""

import re
import tracemalloc
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from evigrain import plans
from evigrain.functions import text as T
from evigrain.operators import keywords, ranking

FORMS = ["ＧＡＭＥ８ gene", "ﬁeld eﬃcacy", "H₂O and x² or ①", "Ⅳ ㎏ ﾊﾝｶｸ", "plain α-番茄碱", "a b　c", "café ｰ", None, ""]


def test_registered_queries_normalise(spark, tmp_path):
    spark.createDataFrame(list(enumerate(FORMS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plain = spark.createDataFrame([(i, unicodedata.normalize("NFKC", t or "")) for i, t in enumerate(FORMS)], "doc_id long, text string")
    want = {r.doc_id: (r.w, r.n) for r in plain.select("doc_id", T.tokens("text", False).alias("w"), T.normal_text("text", False).alias("n")).collect()}
    got = {r.doc_id: r.tokens for r in plans.QUERIES["f01_tokenize"](spark, str(tmp_path)).collect()}
    assert got == {i: " ".join(w) for i, (w, n) in want.items()}
    assert (got[0], got[1]) == ("game8 gene", "field efficacy")
    got = {r.doc_id: r.normal for r in plans.QUERIES["f03_normal_text"](spark, str(tmp_path)).collect()}
    assert got == {i: n for i, (w, n) in want.items()}
    assert got == {i: T.normal_form(t or "") for i, t in enumerate(FORMS)}


def test_rankings_match_compatibility_forms(spark):
    docs = spark.createDataFrame([(0, "ＧＡＭＥ８ controls"), (1, "PSY1 controls"), (2, "other words")], "doc_id long, text string")
    assert ranking.top(ranking.bm25(docs, "game8"), 1, F.desc("score")).first()["doc_id"] == 0
    assert ranking.top(ranking.bm25(docs, "ＰＳＹ１"), 1, F.desc("score")).first()["doc_id"] == 1
    spec = [keywords.Concept("x", (keywords.Form("ｇａｍｅ８", 1.0, "token", ("ｃｏｎｔｒｏｌｓ",)),), {"text": 1.0})]
    assert [r["id"] for r in keywords.scored(docs.withColumnRenamed("doc_id", "id"), spec).collect()] == [0]


def test_plain_characters_stand_for_themselves(spark):
    """Alone, and beside each other: none is a mark, and none joins the one before."""
    inside = re.compile(re.sub(r"\\x\{(\w+)\}", r"\\u\1", f"[{T.PLAIN}]"))
    plain = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000 and inside.match(chr(i))]
    assert len(plain) > 20_000 and all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in plain)
    seconds = {chr(int(x, 16)) for c in map(chr, range(0x110000)) for x in unicodedata.decomposition(c).split()[1:] if x[0] != "<"}
    assert not [c for c in plain if c in seconds and any(unicodedata.normalize("NFKC", a + c) != a + c for a in plain[:900])]


def test_only_text_that_may_change_goes_to_python(spark):
    rows = [("caf\u00e9 \u2013 \u03b1-\u756a\u8304\u78b1",), ("plain",), (None,), ("cafe\u0301",), ("\uff27",), ("\U0001d400",)]
    df = spark.createDataFrame(rows, "t string").select("t", T.nfkc(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [r.t and unicodedata.normalize("NFKC", r.t) for r in df.collect()]
    sent = F.col("t").rlike(T.CHANGING)
    assert [r.s for r in df.select(sent.alias("s")).collect()] == [False, False, None, True, True, True]


def test_a_batch_is_never_whole_as_python_strings():
    text = pa.array(["x\u00b2 plain " * 1_000, None] * 1_000)
    tracemalloc.start()
    got = T._normalised.func(text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.equals(pa.array(["x2 plain " * 1_000, None] * 1_000)) and most < 0.2 * text.nbytes
    assert [T._normalised.func(pa.array(x, pa.string())).to_pylist() for x in ([], [None], ["\uff27"] * (T.SLICE + 1))] == [[], [None], ["G"] * (T.SLICE + 1)]


def test_keyword_scores_of_all_slices(spark, tmp_path):
    """Of a batch of several slices each text has its own score."""
    texts = [None if i % 5 == 0 else "\uff4c\uff49\uff43\uff45\uff4e\uff53\uff45 \u00b2" * (i % 4) for i in range(5 * T.SLICE + 3)]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: r.score for r in plans.QUERIES["a07_keyword_scores"](spark, str(tmp_path)).collect()}
    count = {i: len(re.findall(r"(?<![\w.-])license(?![\w.-])", unicodedata.normalize("NFKC", t or ""))) for i, t in enumerate(texts)}
    assert got == {i: round(1 - 0.5**n, 6) for i, n in count.items() if n}


def test_idf_of_all_slices(spark, tmp_path):
    """Document frequencies count compatibility forms and plain ones of all slices together."""
    texts = [None if i % 5 == 0 else f"{'ＧＡＭＥ' if i % 2 else 'game'} {'①' * (1 + i % 3)}" for i in range(3 * T.SLICE + 3)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter(w for t in texts for w in set(unicodedata.normalize("NFKC", t or "").lower().split()))
    got = plans.QUERIES["a03_idf"](spark, str(tmp_path))
    assert {r.term: r.df for r in got.collect()} == want and set(want) == {"game", "1", "11", "111"}
    assert "ArrowEvalPython" in (plan := got._jdf.queryExecution().toString()) and "RLIKE" in plan
