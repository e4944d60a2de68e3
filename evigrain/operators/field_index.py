"""An inverted index over fields: which records a keyword specification can match, by the words of blocks of records.

`fields` has a row for each record with all its fields, sorted by id; a block is a run of SPAN ids. `words` has a row for each
word that a field holds somewhere in a block. A form of one word lies inside a word; of a form of several the first ends a word,
the last begins one and those between are words. Blocks in which one requested field has all of these are read; their
records are held against the forms as they are, and what is left is scored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrain.operators.keywords import Ask, Spec, asks, matches, totals, validate
from evigrain.sources import store

SPAN = 512
#: Blocks that are broadcast to the records, which then stay where they are; more are joined.
NEAR = 250_000


class FieldIndex(NamedTuple):
    fields: DataFrame
    words: DataFrame


def tables(fields: DataFrame) -> dict[str, DataFrame]:
    """The tables of an index over long_fields(), to be written."""
    # Range-sorted first: a range then has whole records, and whole blocks but for its ends, so words are counted out where they are.
    ranges = fields.repartitionByRange("id")
    records = ranges.groupBy("id").agg(F.collect_list(F.struct("field", "value")).alias("fields"))
    records = store.cut(records.select("id", F.floor(F.col("id") / SPAN).alias("block"), "fields").sortWithinPartitions("id"))
    each = records.select("block", F.explode("fields").alias("x")).select("block", "x.field", F.explode(F.array_distinct(F.split("x.value", " "))).alias("word"))
    return {"fields": records, "words": each.distinct()}


class _Look(NamedTuple):
    """A string to find in some fields (None: in any)."""

    needle: str
    fields: frozenset[str] | None


def _looks(a: Ask) -> _Look:
    return _Look(a.needle, None if "*" in a.fields else frozenset(a.fields))


def _inside(look: _Look, field: Column) -> Column:
    return F.lit(True) if look.fields is None else field.isin(sorted(look.fields))


def _wanted(spec: Spec) -> list[tuple[_Look, list[_Look]]]:
    """What each form looks for, and what it looks for beside it."""
    return [(_looks(a), [_Look(w, None) for w in a.cohit]) for a in asks(spec.concepts)]


def _some(wanted: list[tuple[_Look, list[_Look]]], has) -> Column:
    """Whether one of the forms is there, and one of its cohit words."""
    return reduce(or_, [has(look) & reduce(or_, map(has, beside)) if beside else has(look) for look, beside in wanted])


def _parts(needle: str) -> list[Column]:
    """What the words must be that a needle runs through."""
    first, *rest = needle.split(" ")
    word = F.col("word")
    return [word.contains(first)] if not rest else [word.endswith(first), *(word == x for x in rest[:-1]), word.startswith(rest[-1])]


def _blocks(index: FieldIndex, wanted: list[tuple[_Look, list[_Look]]]) -> DataFrame:
    """The blocks that may hold a record that matches."""
    looks = list(dict.fromkeys(x for look, beside in wanted for x in (look, *beside)))
    at, parts = {x: k for k, x in enumerate(looks)}, [_parts(x.needle) for x in looks]
    hit = [F.when(c & _inside(x, F.col("field")), F.struct(F.lit(k).alias("look"), F.lit(i).alias("part"), F.lit(len(p)).alias("of"))) for k, (x, p) in enumerate(zip(looks, parts)) for i, c in enumerate(p)]
    hits = index.words.select("block", "field", F.explode(F.array_compact(F.array(*hit))).alias("x")).select("block", "field", "x.*").distinct()
    full = hits.groupBy("block", "field", "look").agg(F.count("*").alias("n"), F.any_value("of").alias("of")).filter("n = of")
    # At most as many numbers a block as there are looks.
    held = full.groupBy("block").agg(F.collect_set("look").alias("looks"))
    return held.filter(_some(wanted, lambda x: F.array_contains("looks", at[x]))).select("block")


def _matching(index: FieldIndex, spec: Spec) -> DataFrame:
    """The records that hold a form as a string in one of its fields, and one of its cohit words anywhere."""
    validate(*spec)
    wanted = _wanted(spec)
    if not wanted:
        return index.fields.limit(0)
    has = lambda look: F.exists("fields", lambda x: _inside(look, x["field"]) & x["value"].contains(look.needle))
    blocks = store.cut(_blocks(index, wanted))
    if blocks.count() <= NEAR:
        blocks = F.broadcast(blocks)
    return index.fields.join(blocks, "block", "left_semi").filter(_some(wanted, has))


def candidates(index: FieldIndex, spec: Spec) -> DataFrame:
    """id of each record that the specification may match."""
    return _matching(index, spec).select("id")


#: What is proposed after the values have been looked at; they always are.
held = candidates


def _found(index: FieldIndex, spec: Spec) -> DataFrame:
    """The fields of the candidates, as a table: they are read more than once."""
    return store.cut(_matching(index, spec).select("id", F.explode("fields").alias("x")).select("id", "x.*"))


def explained(index: FieldIndex, spec: Spec) -> DataFrame:
    """matches() of the candidates: id, concept, field, surface_form, n, score and part."""
    return matches(_found(index, spec), spec)


def scored(index: FieldIndex, spec: Spec) -> DataFrame:
    """totals() of the candidates: id and score."""
    return totals(_found(index, spec), spec)
