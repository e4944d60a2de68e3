"""Schema-weighted keyword scoring over a long table of fields (id, field, value).

A specification is a bounded list of concepts: forms with weights and a way to match, target fields with weights,
words of which one must occur anywhere in the record. It is compiled into expressions; records are aggregated
once by (id, concept) and once by id.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evigrain.functions import text as T

# How much a specification may ask for, and the default fields with their weights.
MOST = {"concepts": 32, "forms": 128, "fields": 64, "chars": 256, "cohits": 16}
DEFAULT_FIELDS = {
    "Gene_Name": 2.6,
    "Enzyme_Name": 2.2,
    "Terminal_Metabolite": 2.4,
    "Terminal_Metabolite_Class": 1.5,
    "Primary_Substrate": 2.2,
    "Primary_Product": 2.4,
    "Catalyzed_Reaction_Description": 1.9,
    "Biosynthetic_Pathway": 1.8,
    "Pathway_Branch_or_Subpathway": 1.5,
    "Metabolic_Step_Position": 1.3,
    "Rate_Limiting_or_Key_Control_Step": 1.6,
    "Regulation_Mode": 1.5,
    "Metabolic_Process_Controlled": 1.6,
    "Primary_Regulatory_Targets": 1.8,
    "Regulatory_Effect_on_Target_Genes": 1.5,
    "Protein_Complex_Involvement": 1.4,
    "Interacting_Proteins": 1.4,
    "Source_Species": 1.2,
    "Source_Species_Latin_Name": 1.4,
    "Applied_Species": 1.2,
    "Applied_Species_Latin_Name": 1.4,
    "Summary_Key_Findings_of_Core_Gene": 1.0,
    "Core_Phenotypic_Effect": 1.0,
    "Other_Important_Info": 0.9,
    "Potential_Tradeoffs": 0.9,
    "paper_title": 0.7,
    "content": 0.35,
}
DECAY, MOST_OCCURRENCES = 0.5, 8


@dataclass(frozen=True)
class Form:
    text: str
    weight: float = 1.0
    match: str = "phrase"
    cohit: tuple[str, ...] = ()


@dataclass(frozen=True)
class Concept:
    name: str
    forms: tuple[Form, ...]
    fields: dict[str, float] = field(default_factory=dict)
    weight: float = 1.0
    multiplier: float = 2.0

    def cap(self) -> float:
        top = lambda xs: max([0.0, *xs])
        return max(0.0, self.weight) * top(self.fields.values()) * top(f.weight for f in self.forms) * max(0.0, self.multiplier)


class Spec(NamedTuple):
    """What to look for, how much each further occurrence counts, and how many count at all."""

    concepts: list[Concept]
    decay: float = DECAY
    most: int = MOST_OCCURRENCES


def validate(concepts: list[Concept], decay: float = DECAY, most: int = MOST_OCCURRENCES) -> None:
    forms = [f for c in concepts for f in c.forms]
    sizes = {
        "concepts": len(concepts),
        "forms": len(forms),
        "fields": max([0, *(len(c.fields) for c in concepts)]),
        "chars": max([0, *(len(t) for f in forms for t in (f.text, *f.cohit))]),
        "cohits": max([0, *(len(f.cohit) for f in forms)]),
    }
    if any(n > MOST[k] for k, n in sizes.items()):
        raise ValueError(f"a keyword specification is limited to {MOST}")
    if not all(math.isfinite(x) for c in concepts for x in (c.weight, c.multiplier, *c.fields.values(), *(f.weight for f in c.forms))):
        raise ValueError("weights must be finite")
    if not 0 <= decay <= 1:
        raise ValueError("the decay must lie between 0 and 1")
    if not 1 <= most <= 100:
        raise ValueError("between 1 and 100 occurrences can count")


def normal_fields(records: DataFrame) -> DataFrame:
    """records (id and one column per field) with all fields as scored() compares them; worth keeping as a table."""
    return records.select("id", *[T.normal_text(c).alias(c) for c in records.columns if c != "id"])


def scored(records: DataFrame, concepts: list[Concept], decay: float = DECAY, most: int = MOST_OCCURRENCES, normal: bool = False) -> DataFrame:
    """id, score > 0. records: id and one column per field; normal: they come from normal_fields()."""
    validate(concepts, decay, most)
    names = [c for c in records.columns if c != "id"]
    low = records if normal else normal_fields(records)
    everything = F.concat_ws(" ", *names)
    # What holds no form at all is left out by plain searches before anything is counted.
    some = F.lit(False)
    total = F.lit(0.0)
    for c in concepts:
        own = F.lit(0.0)
        for f in c.forms:
            needle = T.normal_form(f.text)
            allowed = F.lit(True) if not f.cohit else F.lit(False)
            for word in f.cohit:
                allowed = allowed | everything.contains(T.normal_form(word))
            for name, weight in c.fields.items():
                count = (T.token_count if f.match == "token" else T.phrase_count)(F.col(name), needle)
                part = c.weight * max(0.0, f.weight) * max(0.0, weight)
                if part > 0:
                    some = some | F.col(name).contains(needle)
                    own = own + F.when(allowed & F.col(name).contains(needle), F.lit(part) * T.discounted(count, decay, most)).otherwise(0.0)
        total = total + (F.least(own, F.lit(c.cap())) if c.cap() > 0 else own)
    # One row generator, so that the filter doesn't compute the score a second time.
    return low.filter(some).select("id", F.explode(F.array(total)).alias("score")).filter("score > 0")


def long_fields(records: DataFrame, key: str = "id") -> DataFrame:
    """id, field and value, as matches() compares them, of each field that isn't empty; worth keeping as a table."""
    names = [c for c in records.columns if c != key]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), T.normal_text(c).alias("value")) for c in names]))
    return records.select(F.col(key).alias("id"), each.alias("x")).select("id", "x.*").filter("value <> ''")


class Ask(NamedTuple):
    """One form of one concept: what to find, where, and what must be found beside it."""

    concept: int
    form: int
    needle: str
    token: bool
    fields: dict[str, float]
    cohit: tuple[str, ...]
    weight: float


def asks(concepts: list[Concept]) -> list[Ask]:
    return [
        Ask(i, j, needle, f.match == "token", c.fields or DEFAULT_FIELDS, tuple(w for w in map(T.normal_form, f.cohit) if w), c.weight * max(0.0, f.weight))
        for i, c in enumerate(concepts)
        for j, f in enumerate(c.forms)
        if (needle := T.normal_form(f.text))
    ]


def _matched(fields: DataFrame, spec: Spec) -> DataFrame:
    """What matches() says, with the concept's number (at) and cap."""
    concepts, decay, most = spec
    validate(concepts, decay, most)
    wanted = asks(concepts)
    hit = []
    for k, a in enumerate(wanted):
        n = (T.token_count if a.token else T.phrase_count)(F.col("value"), a.needle)
        for name in a.fields:
            here = F.lit(True) if name == "*" else F.col("field") == name
            hit.append(F.when(here & F.col("value").contains(a.needle), F.struct(F.lit(k).alias("ask"), F.lit(name).alias("target"), n.cast("long").alias("n"))))
    if not hit:
        return fields.limit(0).select("id", F.lit("").alias("concept"), "field", F.lit("").alias("surface_form"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("score"), F.lit(0).alias("at"), F.lit(0.0).alias("cap"))
    found = fields.select("id", F.explode(F.array_compact(F.array(*hit))).alias("x")).select("id", "x.*").filter("n > 0")
    found = found.groupBy("id", "ask", "target").agg(F.sum("n").alias("n"))
    strict = {k: a.cohit for k, a in enumerate(wanted) if a.cohit}
    if strict:
        words = sorted({w for ws in strict.values() for w in ws})
        seen = fields.select("id", F.explode(F.array_compact(F.array(*[F.when(F.col("value").contains(w), F.lit(w)) for w in words]))).alias("word")).distinct()
        pairs = F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("ask"), F.lit(w).alias("w")) for k, ws in strict.items() for w in ws]), lambda p: p["w"] == F.col("word")))
        allowed = seen.select("id", pairs.alias("p")).select("id", "p.ask").distinct()
        free = found.filter(~F.col("ask").isin(list(strict)))
        found = free.unionByName(found.filter(F.col("ask").isin(list(strict))).join(allowed, ["id", "ask"], "left_semi"))
    # The specification is bounded, so it is a literal table.
    rows = [(k, a.concept, concepts[a.concept].name, concepts[a.concept].forms[a.form].text, t, a.weight * max(0.0, w), cap(concepts[a.concept])) for k, a in enumerate(wanted) for t, w in a.fields.items()]
    of = fields.sparkSession.createDataFrame(rows, "ask int, at int, concept string, surface_form string, target string, weight double, cap double")
    told = found.join(F.broadcast(of), ["ask", "target"]).withColumn("score", F.col("weight") * T.discounted(F.col("n"), decay, most)).filter("score > 0")
    return told.select("id", "concept", F.col("target").alias("field"), "surface_form", "n", "score", "at", "cap")


def matches(fields: DataFrame, spec: Spec) -> DataFrame:
    """id, concept, field, surface_form, n, score and part: one row for each form that a field of a record holds.

    fields: long_fields(). The field * stands for all fields together. A form with cohit words counts in records that
    hold one of them anywhere. `part` is the score's share of the record's score, after its concept's cap."""
    told = _matched(fields, spec)
    whole = F.sum("score").over(W.partitionBy("id", "at"))
    part = F.when((F.col("cap") > 0) & (whole > F.col("cap")), F.col("score") * F.col("cap") / whole).otherwise(F.col("score"))
    return told.withColumn("part", part).drop("at", "cap")


def totals(fields: DataFrame, spec: Spec) -> DataFrame:
    """id and score > 0 of the records of long_fields() that match: the sum over concepts, each up to its cap."""
    own = _matched(fields, spec).groupBy("id", "at").agg(F.sum("score").alias("score"), F.any_value("cap").alias("cap"))
    return own.groupBy("id").agg(F.sum(F.when(F.col("cap") > 0, F.least("score", "cap")).otherwise(F.col("score"))).alias("score")).filter("score > 0")


def cap(concept: Concept) -> float:
    return concept.cap() if concept.fields else replace(concept, fields=DEFAULT_FIELDS).cap()


# What a plain query is taken apart into.
QUOTED = r"""['"]([^'"]{2,80})['"]"""
LATIN = r"\b[A-Z][a-z]+(?:\s+[a-z][a-z.-]+){1,2}\b"
TOKEN_CHARS, FALLBACK_TERMS, FALLBACK_MULTIPLIER, SHORTEST = 6, 24, 1.5, 3


def _form(value) -> Form:
    if isinstance(value, str):
        return Form(value)
    if not isinstance(value, dict):
        return Form("")
    cohit = tuple(str(x) for x in value.get("requires_cohit", ()) if str(x).strip())
    return Form(str(value.get("text") or value.get("term") or "").strip(), float(value.get("weight", 1.0) or 1.0), str(value.get("match") or "phrase").strip().lower(), cohit)


def _concept(value) -> Concept | None:
    """A concept with a form at least, or None. A weight of 0 or nothing counts as 1."""
    if not isinstance(value, dict):
        return None
    listed = next((value[k] for k in ("surface_forms", "candidates", "aliases") if k in value), [])
    forms = tuple(f for f in map(_form, listed) if T.normal_form(f.text))
    target = value.get("target_fields") or {}
    fields = {str(k): float(w) for k, w in target.items()} if isinstance(target, dict) else {str(k): 1.0 for k in target if str(k).strip()} if isinstance(target, list) else {}
    name = str(value.get("concept") or value.get("name") or "").strip() or "unnamed_concept"
    weight = float(value.get("query_weight", value.get("weight", 1.0)) or 1.0)
    return Concept(name, forms, fields, weight, float(value.get("concept_cap_multiplier", 2.0) or 2.0)) if forms else None


def coerced(value, spark: SparkSession) -> Spec:
    """A specification from a mapping, a list of concepts, their JSON, or a plain query. Concepts without a form are left out;
    one without fields looks in the default ones."""
    if isinstance(value, Spec):
        return value
    if isinstance(value, str):
        text = value.strip()
        if text[:1] in ("{", "["):
            try:
                return coerced(json.loads(text), spark)
            except json.JSONDecodeError:
                pass
        return from_query(text, spark) if text else Spec([])
    more = {}
    if isinstance(value, dict):
        if "concepts" in value:
            more = {"decay": float(value.get("occurrence_decay", DECAY)), "most": int(value.get("max_occurrences_per_field", MOST_OCCURRENCES))}
        value = (value["concepts"] or []) if "concepts" in value else [value]
    out = Spec([c for c in map(_concept, value if isinstance(value, list) else []) if c], **more)
    validate(*out)
    return out


def from_query(query: str, spark: SparkSession) -> Spec:
    """The specification of a plain query: quoted parts, Latin species names and tokens of three characters or more, in that
    order; of the first 24 each form counts once, and short ones match as tokens."""
    words = spark.range(1).select(T.tokens(F.lit(query)).alias("w")).first()["w"]
    seen: dict[str, str] = {}
    for t in [*re.findall(QUOTED, query), *re.findall(LATIN, query), *(w for w in words if len(w) >= SHORTEST)][:FALLBACK_TERMS]:
        if form := T.normal_form(t):
            seen.setdefault(form, t)
    return Spec([Concept(f"query_term:{t}", (Form(t, 1.0, "token" if len(t) <= TOKEN_CHARS else "phrase"),), DEFAULT_FIELDS, 1.0, FALLBACK_MULTIPLIER) for t in seen.values()])
