"""Keyword specifications, and the index over fields against a scan."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evigrain.operators import field_index, keywords
from evigrain.operators.keywords import Concept, Form, Spec


def test_coercion(spark):
    by = lambda v: keywords.coerced(v, spark)
    assert by(None) == by("") == by("  ") == by([]) == by([1, "x"]) == by(7) == Spec([])
    c = {"name": "ga", "weight": 0, "candidates": ["GA", {"term": "gibberellin", "weight": 0, "match": " Token ", "requires_cohit": ["", "plant"]}, 5, " "], "target_fields": ["content", " "]}
    want = Concept("ga", (Form("GA"), Form("gibberellin", 1.0, "token", ("plant",))), {"content": 1.0})
    assert by(c).concepts == by([c]).concepts == by(json.dumps([c])).concepts == [want]
    spec = by({"concepts": [c, {"concept": "none"}], "occurrence_decay": 0.25, "max_occurrences_per_field": 3})
    assert spec == Spec([want], 0.25, 3)
    assert by({"surface_forms": ["x"]}).concepts[0].name == "unnamed_concept"
    assert by('["a"]') == Spec([]) and [f.name for f in by("{not json gene").concepts] == ["query_term:not", "query_term:json", "query_term:gene"]


def test_a_plain_query(spark):
    got = keywords.from_query("""what does 'chalcone synthase' do in Arabidopsis thaliana? "GA" ab the-one the""", spark).concepts
    assert [c.forms[0].text for c in got][:3] == ["chalcone synthase", "GA", "Arabidopsis thaliana"]
    assert all(c.multiplier == 1.5 and c.fields == keywords.DEFAULT_FIELDS for c in got)
    assert {c.forms[0].text: c.forms[0].match for c in got}["GA"] == "token" and "ab" not in [c.forms[0].text for c in got]
    assert len(keywords.from_query(" ".join(f"word{i}" for i in range(60)), spark).concepts) == 24


@pytest.mark.parametrize(
    "spec",
    [
        Spec([Concept("x", (Form("a"),))] * 33),
        Spec([Concept("x", (Form("a"),) * 129)]),
        Spec([Concept("x", (Form("a" * 257),))]),
        Spec([Concept("x", (Form("a", cohit=("b",) * 17),))]),
        Spec([Concept("x", (Form("a", cohit=("b" * 257,)),))]),
        Spec([Concept("x", (Form("a"),), {f"f{i}": 1.0 for i in range(65)})]),
        Spec([Concept("x", (Form("a", float("nan")),))]),
        Spec([], 1.1),
        Spec([], -0.1),
        Spec([], 0.5, 0),
        Spec([], 0.5, 101),
    ],
)
def test_limits(spec):
    with pytest.raises(ValueError):
        keywords.validate(*spec)


RECORDS = [("Flavonoid pathway of GA in rice", "GA1"), ("the GA-GA game, ga. Ga", "gene two"), ("nothing here", "c4"), (None, "Flavonoid"), ("", "-"), ("x" * 50 + "flavonoid flavonoid", None), ("c4 C4 plants; +a ++a", "rice")]


@pytest.fixture(scope="module")
def fields(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(RECORDS * 3)]
    return keywords.long_fields(spark.createDataFrame(rows, "id long, text string, name string")).cache()


@pytest.fixture(scope="module")
def index(fields):
    return field_index.FieldIndex(**{k: v.cache() for k, v in field_index.tables(fields).items()})


def test_candidates_lose_nothing(fields, index):
    draw = random.Random(4)
    forms = ["GA", "ga", "flavonoid", "Flavonoid pathway", "c4", "+a", "xx", "rice", "no such thing", "e", "avo", "GA-GA"]
    for _ in range(5):
        one = lambda: Form(draw.choice(forms), draw.choice([1.0, 0.5]), draw.choice(["token", "phrase"]), tuple(draw.sample(["rice", "ga", "plants", "x"], draw.choice([0, 0, 1, 2]))))
        spec = Spec([Concept(f"c{i}", tuple(one() for _ in range(draw.choice([1, 2]))), draw.choice([{"text": 1.0}, {"text": 1.0, "name": 0.5}, {"*": 1.0}]), draw.choice([1.0, 0.3]), draw.choice([2.0, 0.6])) for i in range(2)])
        scan = sorted(map(tuple, keywords.matches(fields, spec).collect()))
        assert sorted(map(tuple, field_index.explained(index, spec).collect())) == scan
        assert sorted(map(tuple, field_index.scored(index, spec).collect())) == sorted(map(tuple, keywords.totals(fields, spec).collect()))
        total = {}
        for r in scan:
            total[r[0]] = total.get(r[0], 0) + r[6]
        assert {r.id: round(r.score, 9) for r in keywords.totals(fields, spec).collect()} == {k: round(v, 9) for k, v in total.items()}


def test_postings_leave_out_what_can_not_match(index):
    got = {r.id for r in field_index.candidates(index, Spec([Concept("f", (Form("flavonoid pathway"),), {"text": 1.0})])).collect()}
    assert got == {0, 7, 14}
    assert field_index.candidates(index, Spec([Concept("f", (Form("zzzz"),), {"text": 1.0})])).count() == 0
    assert field_index.candidates(index, Spec([])).count() == 0


def test_all_fields_together_and_caps(spark):
    fields = keywords.long_fields(spark.createDataFrame([(1, "gene gene", "a gene")], "id long, text string, name string"))
    [row] = keywords.matches(fields, Spec([Concept("g", (Form("gene"),), {"*": 2.0}, 1.0, 0.5)])).collect()
    assert (row.field, row.n, row.score, row.part) == ("*", 3, 2.0 * 1.75, 1.0)


def test_the_index_grows_with_blocks_and_not_with_records(spark):
    """Records of a block share its words, so a block of copies takes no more rows than one of them."""
    rows = lambda n: spark.range(n).select("id", F.lit("licensed under terms of use").alias("text"), F.lit("src1").alias("name"))
    sizes = []
    for n in (1, field_index.SPAN, 4 * field_index.SPAN):
        index = field_index.FieldIndex(**field_index.tables(keywords.long_fields(rows(n))))
        sizes.append(sum(t.count() for t in index if t is not index.fields))
        spec = Spec([Concept("x", (Form("ensed und"), Form("src", cohit=("f us",))), {"*": 1.0})])
        assert index.fields.count() == n == field_index.candidates(index, spec).count()
        assert field_index.candidates(index, Spec([Concept("x", (Form("terms under"),), {"text": 1.0})])).count() == 0
    assert sizes == [6, 6, 24]
