"""Operator 8, quality rules: a threshold table compiled into one projection.

Every rule is a row of RULES: a ratio of two measures and the bounds it must keep. `judged` compiles the
table into one projection over the measures; everything is a built-in function, so no Python runs on the
executors.

Defined results: a null text counts as empty (all measures 0, base_failed, not kept); rows with a null
doc_id, repeated rows and ties are judged one by one; an empty table gives no rows; other columns of the
input are neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.llm.shared import A_Z, a_z, table, words

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that it for on with as by be are was this or an at from which "
    "der die das und in zu den von mit ist des im für auf nicht ein eine dem "
    "le la les de des et en un une du que qui dans pour par sur est au avec "
    "el los las y que se del por con una para es al lo como más su"
)
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """measure / per must lie in [least, most]; a rule with per of 0 holds."""

    name: str
    measure: str
    per: str
    least: float | None = None
    most: float | None = None


BASE = (
    Rule("words", "n_words", "one", least=50),
    Rule("repeated_windows", "n_repeat_words", "n_words", most=0.5),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", least=2, most=14),
    Rule("symbols", "n_symbols", "n_words", most=0.25),
    Rule("repeated_lines", "n_dup_lines", "n_word_lines", most=0.5),
    Rule("stop_words", "n_stop_words", "n_words", least=0.02),
)


def _repeated_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. The windows are sorted with their places, so
    equal ones are neighbours; texts whose windows all differ skip the sort."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, j: (F.get(s, j - 1)["k"] == x["k"]) | (F.get(s, j + 1)["k"] == x["k"]))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def counted(k: Column) -> Column:
        placed = F.sort_array(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(k)) < F.size(k), _with(placed, covered)).otherwise(0)

    return F.when(F.size(w) < 4, 0).otherwise(_with(windows, counted)).cast("long")


def _with(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures that rules may name.

    The measures leave a generator of one row: a later filter on them stays above it, so no measure is
    computed twice and the words are split once."""
    text = F.coalesce("text", F.lit(""))
    stop = sorted({*STOP_WORDS.split()})
    blanks = " \t\n\x0b\x0c\r"
    split = docs.select("doc_id", text.alias("text"), words(F.col("text")).alias("w"), F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, blanks, "")) > 0).alias("lines"))
    one = F.struct(
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", blanks, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("w")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_word_lines"),
        F.size(F.filter("w", lambda x: F.translate(x, A_Z + ".,;:!?", a_z).isin(stop))).cast("long").alias("n_stop_words"),
    )
    return split.select("doc_id", F.explode(F.array(one)).alias("m")).select("doc_id", "m.*")


def failed(rules) -> Column:
    """True if a rule of the table doesn't hold. Bounds are compared without a division: measure against bound * per."""
    out = F.lit(False)
    for r in rules:
        measure, per = F.col(r.measure), F.lit(1) if r.per == "one" else F.col(r.per)
        if r.least is not None:
            out = out | (measure < F.lit(r.least) * per)
        if r.most is not None:
            out = out | (measure > F.lit(r.most) * per)
    return out


def judged(docs: DataFrame, base=BASE, rules=RULES) -> DataFrame:
    """The measures of every document, base_failed and kept."""
    return measures(docs).withColumn("base_failed", failed(base)).withColumn("kept", ~F.col("base_failed") & ~failed(rules))


def filtered(docs: DataFrame, base=BASE, rules=RULES) -> DataFrame:
    """The documents that pass, with all their columns. The verdict is taken on the row itself, so neither a
    join nor a key is needed, and repeated or null ids are no matter."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("doc_id")
    return judged(docs.select(row, "text"), base, rules).filter("kept").select("doc_id.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


def _sql_rules(rules) -> str:
    parts = []
    for r in rules:
        per = "1" if r.per == "one" else r.per
        parts += [f"{r.measure} < {r.least!r} * {per}"] if r.least is not None else []
        parts += [f"{r.measure} > {r.most!r} * {per}"] if r.most is not None else []
    return " OR ".join(parts)


_STOP_SQL = ", ".join(f"'{w}'" for w in sorted({*STOP_WORDS.split()}))
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM w, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) >= 3),
again AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
m AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_word_lines,
  len(list_filter(w.w, lambda x: regexp_replace(translate(x, '{A_Z}', '{a_z}'), '[.,;:!?]', '', 'g') IN ({_STOP_SQL})))::BIGINT AS n_stop_words
  FROM w LEFT JOIN covered c USING (r)),
b AS (SELECT *, ({_sql_rules(BASE)}) AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT ({_sql_rules(RULES)}) AS kept FROM b
"""
