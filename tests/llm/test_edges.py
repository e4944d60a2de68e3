"""Nulls, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names."""

import pytest

from evigrain.llm import backoff_lm, bpe, chat_format, grid_join, hilbert_shards, line_templates, minhash_dedup, packing, quality_rules, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, shard string, kept string, n_dropped int"
LONG = "word " * 60_000 + "x" * 100_000
ROWS = [
    (1, None, None, None, None, 1, "a", "b", 0),
    (2, "", "en", "s", 0, 1, "a", "b", 0),
    (3, " \t\n\x0b\x0c\r ", "en", "s", 7, 1, "a", "b", 0),
    (4, "one two", "en", "s", 7, 1, "a", "b", 0),
    (4, "one two", "en", "s", 7, 1, "a", "b", 0),
    (None, "one two three four five six", "de", None, 27, 1, "a", "b", 0),
    (5, LONG, "en", "s", len(LONG), 1, "a", "b", 0),
    (6, LONG, "en", "s", len(LONG), 1, "a", "b", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_quality_rules(docs, none):
    assert [r.base_failed for r in quality_rules.judged(docs).orderBy("n_words").collect()][:6] == [True] * 6
    assert quality_rules.filtered(docs).columns == docs.columns and quality_rules.filtered(none).count() == 0
    assert quality_rules.judged(none).count() == 0


def test_line_templates(docs, none):
    out = line_templates.cleaned(docs)
    assert out.count() == len(ROWS) and out.columns.count("n_dropped") == 1
    assert {r.doc_id: r.text for r in out.collect()}[1] is None
    assert line_templates.deduplicated(docs).columns == docs.columns
    assert line_templates.cleaned(none).count() == 0


def test_line_templates_drop_what_varies_only_in_numbers(spark):
    line = "this page was printed on day {} of the year by the copying machine number {}"
    df = spark.createDataFrame([(i, f"own words of text {'abcdefgh'[i] * 3}\n{line.format(i, i + 7)}") for i in range(8)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_templates.cleaned(df).collect()}
    assert out[0] == f"own words of text aaa\n{line.format(0, 7)}" and out[3] == "own words of text ddd"


def test_minhash(docs, none):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash_dedup.grouped(docs).collect()}
    assert got[1, 0] == (1, True) and got[2, 0] == (2, True) and got[3, 0] == (3, True) and got[4, 1] == (4, True)
    assert got[None, 2] == (None, True)
    assert [v for (i, _), v in got.items() if i == 6] == [(5, False)]
    assert minhash_dedup.deduplicated(docs).columns == docs.columns
    # Of the two equal rows of document 4 one stays; rows without words or id all stay.
    assert sorted(str(r.doc_id) for r in minhash_dedup.deduplicated(docs).collect()) == ["1", "2", "3", "4", "5", "None"]
    assert minhash_dedup.grouped(none).count() == 0


def test_minhash_of_repeated_ids(spark):
    df = spark.createDataFrame([(3, "a b c d e f g"), (5, "a b c d e f g"), (5, "t u v w x y z"), (6, "t u v w x y z"), (8, "t u v w x y z"), (9, "k l m n o")], "doc_id long, text string").selectExpr("*", "1 AS _state")
    assert {(r.doc_id, r.component_id) for r in minhash_dedup.grouped(df).collect()} == {(3, 3), (5, 3), (6, 3), (8, 3), (9, 9)}
    assert sorted((r.doc_id, r.text) for r in minhash_dedup.deduplicated(df).collect()) == [(3, "a b c d e f g"), (9, "k l m n o")]
    alone = df.filter("doc_id = 5")
    assert [(r.doc_id, r.text) for r in minhash_dedup.deduplicated(alone).collect()] == [(5, "a b c d e f g")]


def test_lm(docs, none):
    got = backoff_lm.scored(docs).collect()
    assert len(got) == len(ROWS) and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert backoff_lm.scored(none).count() == 0


def test_bpe_and_packing(docs, none):
    path = bpe.public_path()
    assert {r.n_tokens for r in bpe.digested(docs, path).collect() if r.doc_id in (1, 2)} == {0}
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(docs, path), path).collect()}
    assert back[5] == LONG and back[1] == ""
    pieces = packing.packed(docs, path, with_ids=True).collect()
    assert all(len(r.ids) == r.length for r in pieces)
    assert [r.length for r in pieces if r.doc_id == 1] == [1]
    assert bpe.digested(none, path).count() == packing.packed(none, path).count() == 0


def test_shards(spark, docs, none):
    order = [docs.doc_id]
    got = hilbert_shards.sharded(docs, order, 3).collect()
    assert sorted(r.slot for r in got if r.shard == 0) == [0, 1, 2] and len(got) == len(ROWS)
    assert hilbert_shards.sharded(none, [none.doc_id], 3).count() == 0
    clash = docs.selectExpr("doc_id", "1 AS _part", "2 AS _order", "3 AS _Before", "4 AS _rank", "5 AS _at", "6 AS slot")
    out = hilbert_shards.sharded(clash, [clash.doc_id], 3)
    assert out.columns == ["doc_id", "_part", "_order", "_Before", "_rank", "_at", "shard", "slot"] and {r._part for r in out.collect()} == {1}


def test_chat(spark):
    df = spark.createDataFrame([(None, None, None, None, 1), (1, 0, "user", None, 1), (1, 0, "user", None, 1), (1, 1, "assistant", "a<|b", 1), (2, 5, "tool", LONG, 1)], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat_format.formatted(df).collect()}
    assert got[1].n_turns == 3 and chat_format.parsed(bytes(got[1].formatted).decode()) == [("user", ""), ("user", ""), ("assistant", "a<|b")]
    assert got[None].n_turns == 1 and chat_format.parsed(bytes(got[2].formatted).decode()) == [("tool", LONG)]
    assert chat_format.formatted(df.limit(0)).count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [2.0, 0.0], 0), (4, None, 0), (5, [0.0, 0.0], 0), (6, [float("nan"), 1.0], 0), (7, [1.0, None], 0), (8, [1.0, 0.0], None), (None, [1.0, 0.0], 0), (9, [1.0, 0.0, 0.0], 0), (10, [], 0), (11, [0.9, 0.1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS n_links")
    got = {r.vec_id: (r.n_links, r.component_id) for r in grid_join.deduplicated(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 11: (3, 1), **{i: (0, i) for i in (4, 5, 6, 7, 8, None, 9, 10)}}
    assert grid_join.deduplicated(df.limit(0)).count() == 0


def test_urls(spark, docs, none):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://WWW.Example.COM/en/x?q"), (4, "http://a.example.com/en/"), (5, "x://" + "a" * 5000 + "/p#f"), (None, "http://b.net/es/")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host")
    got = [(r.page_id, r.host[:20], r.path, r.rule, r.verdict) for r in url_filter.judged(df, docs).collect()]
    assert (4, "www.example.com", "/en/x", "www.example.com/en/", "allow") in got and (4, "a.example.com", "/en/", "example.com/en/", "block") in got
    assert (None, "b.net", "/es/", "net/es/", "block") in got and (1, "", "", None, "allow") in got and len(got) == len(rows)
    assert url_filter.judged(df.limit(0), none).count() == 0


def test_chat_of_more_bytes_than_a_value_has(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(chat_format, "MOST_BYTES", 60)
    rows = lambda n: pa.RecordBatch.from_pydict({"conv_id": pa.array([1]), "role": pa.array(["user"]), "text": pa.array(["x" * n])})
    assert next(chat_format._assembled(rows(10))).num_rows == 1
    with pytest.raises(ValueError, match="2 GB"):
        next(chat_format._assembled(rows(60)))
