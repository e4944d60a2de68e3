"""Operator 5, line dedup by a log-template tree.

Lines are parsed down a tree of fixed depth: number of tokens, then the first DEPTH tokens, where a token with a
digit is the variable `<*>`. In a leaf a line's leads are found by parts: of two lines that agree in `similar` of
their n positions, one of floor(n * (1 - similar)) + 1 parts of what follows the leading tokens is the same. Of the
lines that share a part the most frequent is the lead (of equals, that with the greatest key); a line joins the
foremost of its leads that it agrees with and that comes before it in this order. So a leaf may hold any number of
templates: each is a lead with the lines that joined it and those that joined these. A
template recurs if it is found in enough different texts: long_texts for lines of long_tokens tokens or more,
short_texts for lines of short_tokens or more; shorter lines never count (see Rule, a parameter). The text of the
least doc_id that holds a recurring template keeps its line, as do texts equal to it; all other texts lose theirs.

All of it is DataFrame functions. Leaves found in one text only are left out before anything but keys is
shuffled, and only lines with a possible lead are compared, and so moved, as texts; leaf and line keys are hashes that are partially aggregated, so a line that a third of all documents
hold is one row a task. A join of all lines or texts with a table of keys broadcasts the keys if they are few,
which is counted, and else deals hot keys over parts. Texts meet the places of their dropped lines in one join by
text hash.

Defined results: a null text has no lines and stays null; a document whose lines all go keeps an empty text
(`deduplicated` drops it); equal texts have equal results whatever their ids; null ids come after others; rows
are never merged; an empty table gives no rows. `cleaned` keeps all columns of its input, whatever their names.

Passages inside lines, or over several: `unrepeated` cuts a text after words whose hash falls in a residue class,
so that cuts move with the words around them. A segment runs from each cut to the first cut LONG words on; one that
stands in LONG_TEXTS different texts goes from all of them but the text of the least doc_id that holds it and texts
equal to that. A dropped word takes the blanks before it along; where a gap began a line, the next word does. What
stays of a repeated passage are its words before its first cut and after its last, about CUT at each end.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.llm.components import components
from evigrain.llm.shared import dealt_join, hot_keys, near_join, private, settled, table, written

DEPTH = 3


class Rule(NamedTuple):
    """Which templates recur. Long lines say enough to be one passage in two texts already; short ones (names, dates,
    headings) only if many texts have them; lines below short_tokens never say enough. similar is in hundredths."""

    short_tokens: int = 3
    short_texts: int = 20
    long_tokens: int = 12
    long_texts: int = 2
    similar: int = 80


RULE = Rule()
LONG, LONG_TEXTS = RULE.long_tokens, RULE.long_texts
#: One word in so many is followed by a cut.
CUT = 8
BLANKS = " \t\n\x0b\x0c\r"
#: A token with a digit, and the blank or line start before it.
VARIABLE = r"(^|[\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
GAPS = r"[\x20\x09\x0B-\x0D]+"


def _key(column: Column) -> list[Column]:
    """96 bits that stand for a text."""
    return [F.xxhash64(column).alias("t1"), F.hash(column).alias("t2")]


def _lines(docs: DataFrame, rule: Rule) -> DataFrame:
    """t1, t2, doc_id, at, leaf, line, n and the masked line of each line that counts."""
    # The costly replacements run on lines that need them only, and before the generator, so that no later filter repeats them.
    odd = lambda x: x.rlike(r"[0-9\x09\x0B-\x0D]") | x.contains("  ")
    plain = lambda x: F.trim(F.when(odd(x), F.regexp_replace(F.regexp_replace(x, VARIABLE, "$1<*>"), GAPS, " ")).otherwise(x))
    gaps = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))
    masked = F.transform(F.split("text", "\n"), plain)
    counted = F.transform(masked, lambda x: F.struct(x.alias("masked"), (gaps(x) + 1).alias("n")))
    rows = docs.filter("text IS NOT NULL").select("doc_id", *_key(F.col("text")), F.posexplode(counted).alias("at", "x"))
    rows = rows.filter(F.col("x.n") >= rule.short_tokens).select("doc_id", "t1", "t2", "at", "x.n", "x.masked")
    number = F.conv(F.substring(F.md5("masked"), 1, 15), 16, 10).cast("long")
    return rows.select("*", F.xxhash64("n", F.substring_index("masked", " ", DEPTH)).alias("leaf"), number.alias("line"))


def _parts(rule: Rule) -> Column:
    """Keys of the parts of the tokens behind the leading ones; none where all positions must agree."""
    many = F.floor(F.col("n") * (100 - rule.similar) / 100) + 1
    cut = lambda i: (DEPTH + F.floor(i * (F.col("n") - DEPTH) / many)).cast("int")
    # The tokens are bound to a variable, so that they are split once.
    keys = lambda w: F.transform(F.sequence(F.lit(0), (many - 1).cast("int")), lambda i: F.xxhash64(i, F.slice(w, cut(i) + 1, cut(i + 1) - cut(i))))
    return F.when(many > 1, F.transform(F.array(F.split("masked", " ")), keys)[0]).otherwise(F.array().cast("array<long>"))


def _agree(a: Column, b: Column) -> Column:
    """In how many positions two lines with as many tokens agree."""
    return F.size(F.filter(F.arrays_zip(F.split(a, " ").alias("a"), F.split(b, " ").alias("b")), lambda x: x["a"] == x["b"]))


def _first() -> Column:
    """The text of the least id; null ids come last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("t1").alias("k1"), F.col("t2").alias("k2")))


def templates(lines: DataFrame, keys: DataFrame, similar: int) -> DataFrame:
    """leaf, line, template: of the lines (leaf, line, n, texts, parts) that share a template with another. The
    template is one of its lines, as a struct. keys: where the lines' masked text is."""
    part = lines.filter("size(parts) > 0").select("leaf", "line", "n", "texts", F.explode("parts").alias("part"))
    lead = part.groupBy("leaf", "part").agg(F.count("*").alias("lines"), F.max(F.struct("texts", "line")).alias("lead")).filter("lines > 1")
    part = written(part, "parts")
    met = dealt_join(part, lead.select("leaf", "part", "lead"), ["leaf", "part"]).filter("struct(texts, line) < lead")
    pairs = written(met.select("leaf", "line", "n", F.col("lead.line").alias("lead"), F.col("lead.texts").alias("lead_texts")).distinct(), "pairs")
    wanted = written(pairs.select("leaf", "line").unionByName(pairs.select("leaf", F.col("lead").alias("line"))).distinct(), "wanted")
    masked = near_join(keys.select("leaf", "line", "masked"), wanted, ["leaf", "line"], "left_semi").groupBy("leaf", "line").agg(F.any_value("masked").alias("masked"))
    masked = written(masked, "masked")
    both = dealt_join(pairs, masked, ["leaf", "line"])
    both = dealt_join(both, masked.select("leaf", F.col("line").alias("lead"), F.col("masked").alias("lead_masked")), ["leaf", "lead"], hot=hot_keys(pairs.select("leaf", "lead")))
    alike = both.filter(100 * _agree(F.col("masked"), F.col("lead_masked")) >= similar * F.col("n"))
    joins = alike.groupBy("leaf", "line").agg(F.max(F.struct("lead_texts", "lead")).alias("best"))
    comp = components(joins.select(F.struct("leaf", "line").alias("a"), F.struct("leaf", F.col("best.lead").alias("line")).alias("b")))
    return comp.select("node.leaf", "node.line", F.col("component").alias("template"))


def recurring(keys: DataFrame, rule: Rule = RULE) -> DataFrame:
    """leaf, line, k1 and k2: the lines of recurring templates, and the text that keeps the template. keys: the
    lines' keys and masked text."""
    live = keys.groupBy("leaf").agg(F.min("t1").alias("lo"), F.max("t1").alias("hi"), (F.min("line") < F.max("line")).alias("several")).filter("lo <> hi")
    live = written(live.select("leaf", "several"), "leaves")
    short = keys.select("leaf", "line", "t1", "t2", "doc_id", "n")
    each = near_join(short, live.select("leaf"), ["leaf"], "left_semi").groupBy("leaf", "line", "t1", "t2").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    each = written(each, "lines")
    per = written(each.groupBy("leaf", "line").agg(F.count("*").alias("texts"), F.max("n").alias("n")), "per")
    # Only in leaves with different lines is there anything to compare.
    several = written(live.filter("several").select("leaf"), "several")
    cut = keys.select("leaf", "line", _parts(rule).alias("parts"))
    parts = near_join(cut, several, ["leaf"], "left_semi").groupBy("leaf", "line").agg(F.any_value("parts").alias("parts"))
    lines = written(parts.join(per.hint("merge"), ["leaf", "line"]), "several_lines")
    of = per.join(templates(lines, keys, rule.similar).hint("merge"), ["leaf", "line"], "left")
    of = written(of.select("leaf", "line", "n", F.coalesce("template", F.struct("leaf", "line")).alias("template")), "templates")
    # A text counts once for a template, however many of its lines have it.
    member = dealt_join(each.select("leaf", "line", "t1", "t2", "doc_id"), of, ["leaf", "line"])
    texts = member.groupBy("template", "t1", "t2").agg(F.any_value("n").alias("n"), F.min("doc_id").alias("doc_id"))
    owner = texts.groupBy("template").agg(F.count("*").alias("texts"), F.any_value("n").alias("n"), _first().alias("k"))
    again = owner.filter(((F.col("n") >= rule.long_tokens) & (F.col("texts") >= rule.long_texts)) | (F.col("texts") >= rule.short_texts)).select("template", "k.k1", "k.k2")
    return near_join(of, written(again, "again"), ["template"]).select("leaf", "line", "k1", "k2")


def cleaned(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """docs with the recurring lines gone from text, and n_lines and n_dropped."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    t1, t2, gone = private(["_t1", "_t2", "_gone"], docs.columns)

    def places() -> DataFrame:
        keys = written(_lines(docs, rule), "keys")
        hit = near_join(keys.select("t1", "t2", "at", "leaf", "line"), settled(docs.sparkSession, lambda: recurring(keys, rule), "recurring"), ["leaf", "line"])
        hit = hit.filter((F.col("t1") != F.col("k1")) | (F.col("t2") != F.col("k2")))
        return hit.groupBy(F.col("t1").alias(t1), F.col("t2").alias(t2)).agg(F.collect_set("at").alias(gone))

    drop = settled(docs.sparkSession, places, "gone")
    both = _met(docs.select(*own), drop, t1, t2)
    lines = F.split("text", "\n")
    left = F.transform(F.array(lines), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: F.get(x, i)), "\n"))[0]
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    return both.select(*[text.alias(c) if c == "text" else F.col(c) for c in own], n.alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"))


def _met(docs: DataFrame, places: DataFrame, t1: str, t2: str) -> DataFrame:
    """docs with what places hold for their texts; a text that very many rows have is a hot key."""
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(_key(F.col("text")), (t1, t2))])
    return dealt_join(keyed, places, [t1, t2], "left", F.monotonically_increasing_id())


def _once(c: Column) -> Column:
    """A column behind a one-row generator, so that functions of its elements read it and don't compute it anew."""
    return F.explode(F.array(c))


def _segments(docs: DataFrame) -> DataFrame:
    """t1, t2, doc_id, a, b, u1 and u2 of each segment: the words from a to before b, and 96 bits that stand for them."""
    plain = F.when(F.col("text").rlike("[0-9]"), F.regexp_replace("text", VARIABLE, "$1<*>")).otherwise(F.col("text"))
    words = docs.filter("text IS NOT NULL").select("doc_id", *_key(F.col("text")), _once(F.split(F.trim(plain, F.lit(BLANKS)), r"[\x20\x09-\x0D]+")).alias("w"))
    after = F.array_compact(F.transform("w", lambda x, i: F.when(F.pmod(F.hash(x), F.lit(CUT)) == 0, i + 1)))
    # The ends of the text are cuts, too.
    cuts = words.select("*", _once(F.array_union(F.concat(F.array(F.lit(0)), after), F.array(F.size("w")))).alias("c"))
    # Cuts are a word apart at least, so the first one that is LONG words on is among the next LONG.
    end = lambda x, j: F.coalesce(*[F.when(F.get("c", j + k) - x >= LONG, F.get("c", j + k)) for k in range(1, LONG + 1)])
    spans = F.filter(F.transform("c", lambda x, j: F.struct(x.alias("a"), end(x, j).alias("b"))), lambda x: x["b"].isNotNull())
    of = lambda x: F.slice("w", x["a"] + 1, x["b"] - x["a"])
    hashed = F.transform(spans, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.xxhash64(of(x)).alias("u1"), F.hash(of(x)).alias("u2")))
    return cuts.select("doc_id", "t1", "t2", F.explode(hashed).alias("x")).select("doc_id", "t1", "t2", "x.*")


def unrepeated(docs: DataFrame) -> DataFrame:
    """docs without the segments that recur in other texts, and n_words_dropped."""
    own = [c for c in docs.columns if c != "n_words_dropped"]
    t1, t2, out, pieces, inside = private(["_t1", "_t2", "_out", "_pieces", "_inside"], docs.columns)

    def lost() -> DataFrame:
        each = written(_segments(docs), "segments")
        # Two numbers a segment, so that most of this is aggregated in place; owners are looked for among what recurs only.
        live = each.groupBy("u1", "u2").agg(F.min("t1").alias("lo"), F.max("t1").alias("hi")).filter("lo <> hi").select("u1", "u2")
        hits = written(near_join(each, written(live, "live"), ["u1", "u2"], "left_semi"), "recurring")
        owner = hits.groupBy("u1", "u2").agg(_first().alias("k")).select("u1", "u2", "k.k1", "k.k2")
        other = near_join(hits, written(owner, "owners"), ["u1", "u2"]).filter((F.col("t1") != F.col("k1")) | (F.col("t2") != F.col("k2")))
        return other.groupBy("t1", "t2").agg(F.collect_set(F.struct("a", "b")).alias("s"))

    gone = settled(docs.sparkSession, lost, "lost").select(F.col("t1").alias(t1), F.col("t2").alias(t2), F.array_distinct(F.flatten(F.transform("s", lambda x: F.sequence(x["a"], x["b"] - 1)))).alias(out))
    both = _met(docs.select(*own), gone, t1, t2)
    # Words with the blanks before them; the blanks after the last one are added at the end.
    cut = F.when(F.col(out).isNotNull(), F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0)))
    both = both.select("*", _once(cut).alias(pieces)).select("*", _once(F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), out)).alias(inside))
    before = lambda k: F.when(k == 0, -1).otherwise(F.get(inside, k - 1))
    line = lambda i, k: (before(k) + 1 < i) & F.get(pieces, before(k) + 1).contains("\n") & ~F.get(pieces, i).contains("\n")
    word = lambda i, k: F.when(line(i, k), F.concat(F.lit("\n"), F.ltrim(F.get(pieces, i), F.lit(BLANKS)))).otherwise(F.get(pieces, i))
    left = F.array_join(F.transform(inside, word), "")
    tail = F.substring(F.col("text"), F.length(F.rtrim("text", F.lit(BLANKS))) + 1, F.length("text"))
    text = F.when(F.col(out).isNull(), F.col("text")).when(F.size(inside) == 0, "").otherwise(F.concat(left, tail))
    return both.select(*[text.alias(c) if c == "text" else F.col(c) for c in own], F.coalesce(F.size(out), F.lit(0)).cast("long").alias("n_words_dropped"))


def deduplicated(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """The documents without their recurring lines and segments; one of which nothing is left goes too. Columns stay as they are."""
    # Columns of the same names as the counts are set aside under others.
    aside = dict(zip(("n_lines", "n_dropped", "n_words_dropped"), private(["_n_lines", "_n_dropped", "_n_words_dropped"], docs.columns)))
    plain = docs.select(*[F.col(c).alias(aside.get(c, c)) for c in docs.columns])
    lines = written(cleaned(plain, rule).filter("NOT (n_dropped > 0 AND text = '')").select(*plain.columns), "lines_out")
    out = unrepeated(lines).filter("NOT (n_words_dropped > 0 AND text = '')")
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines, as its SQL states them; op5_passages goes on with what recurs inside and across lines."""
    return cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unrepeated(written(cleaned(table(spark, sf_dir, "documents").select("doc_id", "text")), "lines_out"))


_W = r"[^\x20\x09-\x0D]"
ORACLE = rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
raw AS (SELECT r, doc_id, text, i - 1 AS pos, l[i] AS raw FROM (SELECT *, string_split(text, chr(10)) AS l FROM docs WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS u(i)),
toks AS (SELECT r, doc_id, text, pos, list_transform(regexp_extract_all(raw, '{_W}+'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM raw),
lines AS (SELECT *, len(w) AS n, array_to_string(w, ' ') AS masked, array_to_string(w[1:{DEPTH}], ' ') AS lead FROM toks WHERE len(w) >= {RULE.short_tokens}),
texts AS (SELECT n, lead, masked, text, min(doc_id) AS doc_id FROM lines GROUP BY ALL),
per AS (SELECT n, lead, masked, count(*) AS c, n * (100 - {RULE.similar}) // 100 + 1 AS many FROM texts GROUP BY ALL),
ids AS (SELECT *, ('0x' || substr(md5(masked), 1, 15))::BIGINT AS line FROM per),
part AS (SELECT n, lead, masked, line, c, i, string_split(masked, ' ')[{DEPTH} + i * (n - {DEPTH}) // many + 1 : {DEPTH} + (i + 1) * (n - {DEPTH}) // many] AS part FROM ids, unnest(range(many)) AS u(i) WHERE many > 1),
top AS (SELECT n, lead, i, part, max({{'c': c, 'l': line, 'm': masked}}) AS top FROM part GROUP BY ALL),
best AS (SELECT n, lead, masked, max(top) AS best FROM part JOIN top USING (n, lead, i, part)
  WHERE {{'c': c, 'l': line, 'm': masked}} < top AND 100 * len(list_filter(list_zip(string_split(masked, ' '), string_split(top.m, ' ')), lambda x: x[1] = x[2])) >= {RULE.similar} * n GROUP BY ALL),
walk AS (SELECT n, lead, masked, masked AS spot, 0 AS steps FROM per UNION ALL SELECT w.n, w.lead, w.masked, b.best.m, steps + 1 FROM walk w JOIN best b ON w.n = b.n AND w.lead = b.lead AND w.spot = b.masked),
tem AS (SELECT n, lead, masked, arg_max(spot, steps) AS template FROM walk GROUP BY ALL),
memb AS (SELECT n, lead, template, text, min(doc_id) AS doc_id FROM texts JOIN tem USING (n, lead, masked) GROUP BY ALL),
own AS (SELECT n, lead, template, arg_min(text, {{'none': doc_id IS NULL, 'id': coalesce(doc_id, 0)}}) AS keeper FROM memb GROUP BY ALL HAVING (n >= {RULE.long_tokens} AND count(*) >= {RULE.long_texts}) OR count(*) >= {RULE.short_texts}),
gone AS (SELECT l.r, list(l.pos) AS gone FROM lines l JOIN tem USING (n, lead, masked) JOIN own USING (n, lead, template) WHERE l.text <> keeper GROUP BY l.r)
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string([l[i + 1] for i in range(len(l)) if NOT list_contains(gone, i)], chr(10)) END AS text,
  coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped
FROM (SELECT *, string_split(text, chr(10)) AS l FROM docs) LEFT JOIN gone USING (r)
"""
