"""Queries that take whole texts and all texts, by brute force."""

import re

import pytest

from evigrain import plans
from evigrain.functions import text as T


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def _items(text):
    out = {}
    for x in re.split("[;,\n]", text or ""):
        x = x.strip(" ")
        if x.lower() not in T.GRAPH_BLANKS:
            out.setdefault(re.sub(r"[ \t\n\x0b\f\r]+", " ", x).lower(), x)
    return list(out.values())


def test_items_of_all_lines(spark, small, docs):
    got = {r.doc_id: r["items"] for r in plans.QUERIES["f21_items_whole"](spark, small).collect()}
    assert got == {i: "|".join(_items(t)) for i, t in docs.items()}
    assert any(len(_items(t)) > len(_items(t.split("\n")[0])) for t in docs.values() if t)


def test_items_of_repeated_keys(spark):
    texts = [(1, "b; a,B\nc"), (1, "d"), (1, "d"), (None, "x;X"), (2, None), (3, "NA; -")]
    got = T.item_lists(spark.createDataFrame(texts, "k long, t string"), "k", "t").collect()
    assert sorted(map(repr, [(r["k"], list(r["items"])) for r in got])) == sorted(map(repr, [(k, _items(t)) for k, t in texts]))


def test_reverse_complement_of_all_texts(spark, small, docs):
    got = {r.doc_id: r.complement for r in plans.QUERIES["n06_reverse_complement_all"](spark, small).collect()}
    assert got == {i: (t or "").translate(str.maketrans("ACGTacgt", "TGCAtgca"))[::-1] for i, t in docs.items()}
    assert any(not (t or "").isascii() for t in docs.values())
