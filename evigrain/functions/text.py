"""Text and identifier functions as column expressions. All take a column and treat null as empty."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType
from pyspark.sql.types import StringType

# What counts as no value, for evidence and for graph entries.
EVIDENCE_BLANKS = ("", "-", "na", "n/a", "none", "null", "nan", "unknown", "not available", "not applicable")
GRAPH_BLANKS = ("", "-", "na", "n/a", "none", "null", "nan", "unknown", "not established", "not available", "not applicable")
# The token families of mixed scientific text.
ASCII_TOKEN = r"[A-Za-z0-9][A-Za-z0-9._\-/]*"
GREEK_TOKEN = r"[\x{03b1}-\x{03c9}][\-\x{2010}-\x{2015}][A-Za-z0-9\x{4e00}-\x{9fff}]+"
CJK_RUN = r"[\x{4e00}-\x{9fff}]+"
# Names of tools that look like gene names, and words that make a name vague.
GENE_NAME = r"\b[A-Z][a-z]{1,2}[A-Z][A-Za-z]{0,10}\d{0,3}[A-Za-z]?\b"
NOT_GENES = ("SpCas9", "SaCas9", "FnCas12a", "LbCpf1", "AsCpf1", "CasRx", "dCas9", "nCas9", "Cas12a", "Cas13a", "PubMed")
VAGUE = ("之类", "之类的", "等", "等等", "类似")


# Characters that stand for themselves in NFKC beside any others of these: none is composed, reordered or replaced. Text
# of these alone never leaves the JVM.
PLAIN = r"\x{0000}-\x{009f}\x{00a1}-\x{00a7}\x{00a9}\x{00ab}-\x{00ae}\x{00b0}\x{00b1}\x{00b6}\x{00b7}\x{00bb}\x{00bf}-\x{0131}\x{0134}-\x{013e}\x{0141}-\x{0148}\x{014a}-\x{017e}"
PLAIN += r"\x{0391}-\x{03a1}\x{03a3}-\x{03c9}\x{0400}-\x{0482}\x{2010}\x{2012}-\x{2015}\x{2018}-\x{201e}\x{2022}\x{2212}\x{3001}\x{3002}\x{4e00}-\x{9fff}"

# Any other character. ASCII, most of all text, is passed by one comparison.
CHANGING = rf"[^\x{{0000}}-\x{{007f}}](?<![{PLAIN}])"


# Fixed value: of so many texts at a time a batch has Python strings.
SLICE = 64


def _nfkc():
    # Nested, so that it is sent by value and executors don't need this package.
    size = SLICE

    @F.arrow_udf(StringType())
    def nfkc(text: pa.Array) -> pa.Array:
        """Compatibility composition, which Spark lacks. ASCII and already composed text passes through unchanged.

        Slice by slice: as Python strings a whole batch would take several times its bytes."""
        if text.null_count == len(text):
            return text
        slices = (text.slice(i, size).to_pylist() for i in range(0, len(text), size))
        return pa.chunked_array([pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in x], text.type) for x in slices]).combine_chunks()

    return nfkc


_normalised = _nfkc()


def nfkc(c: Column) -> Column:
    """NFKC. Only text that may change is sent to Python; of the rest its batches hold nulls, which cost nothing."""
    return F.coalesce(_normalised(F.when(c.rlike(CHANGING), c)), c)


def text_of(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def clean(c, blanks=EVIDENCE_BLANKS) -> Column:
    t = F.trim(text_of(c))
    return F.when(F.lower(t).isin(*blanks), "").otherwise(t)


def doi(c) -> Column:
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(clean(c), r"(?i)^https?://(?:dx\.)?doi\.org/", "")), "^doi:", ""))
    return F.when(F.lower(bare).isin(*EVIDENCE_BLANKS), "").otherwise(bare)


def pmid(c) -> Column:
    return F.regexp_extract(clean(c), r"\d+", 0)


def url(c) -> Column:
    return F.when(clean(c).rlike("(?i)^https?://"), clean(c)).otherwise("")


def title_key(c) -> Column:
    plain = F.regexp_replace(F.lower(clean(c)), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(plain, r"(?U)[\W_]+", " "))


def evidence_key(title, doi_=None, pmid_=None, url_=None) -> Column:
    """struct(kind, value): the DOI, else the PMID, else the url, else the title."""
    nothing = F.lit("")
    d, p, u = (doi(doi_) if doi_ is not None else nothing), (pmid(pmid_) if pmid_ is not None else nothing), (url(url_) if url_ is not None else nothing)
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    return F.when(d != "", pair("doi", F.lower(d))).when(p != "", pair("pmid", p)).when(u != "", pair("url", F.lower(F.regexp_replace(u, "/+$", "")))).otherwise(pair("title", title_key(title)))


def name(c) -> Column:
    """A graph name: no placeholder, single blanks, lower case."""
    return F.lower(F.regexp_replace(clean(c, GRAPH_BLANKS), r"\s+", " "))


def items(c, separators=r"[;,\n]") -> Column:
    """The distinct items of a list in a text; of names that are equal, the first spelling."""
    all_ = F.filter(F.transform(F.split(text_of(c), separators), lambda x: clean(x, GRAPH_BLANKS)), lambda x: x != "")
    return F.transform(F.array(all_), lambda a: F.filter(a, lambda x, i: F.array_position(F.transform(a, name), name(x)) == i + 1))[0]


def item_lists(rows: DataFrame, key: str, column: str, separators=r"[;,\n]") -> DataFrame:
    """key and items for each row: as items(), by grouped minima instead of a search for each item, for long texts.

    Rows that repeat a key are told apart by their text."""
    t = rows.select(key, text_of(column).alias("_t")).select("*", F.xxhash64("_t").alias("_h"), F.hash("_t").alias("_g"))
    cleaned = F.transform(F.split("_t", separators), lambda x: clean(x, GRAPH_BLANKS))
    each = t.select(key, "_h", "_g", F.posexplode(cleaned).alias("at", "item")).filter("item <> ''")
    first = each.groupBy(key, "_h", "_g", name("item").alias("name")).agg(F.min(F.struct("at", "item")).alias("x"))
    lists = first.groupBy(F.col(key).alias("_key"), F.col("_h").alias("_h2"), F.col("_g").alias("_g2")).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]).alias("items"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_h") == F.col("_h2")) & (F.col("_g") == F.col("_g2"))
    return t.drop("_t").join(lists, same, "left").select(key, F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_adjacent(a: Column) -> Column:
    """An array without elements that equal the one before."""
    return F.transform(F.array(a), lambda x: F.filter(x, lambda t, i: (i == 0) | (t != F.get(x, i - 1))))[0]


def tokens(c, normalise: bool = True) -> Column:
    """Tokens of mixed text, family by family: ASCII words, Greek compounds, pairs of CJK characters; lower case,
    without repeats side by side. normalise: apply NFKC first (in Python, where it may change the text)."""
    t = nfkc(text_of(c)) if normalise else text_of(c)
    pairs = lambda run: F.when(F.length(run) > 1, F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    families = [F.regexp_extract_all(t, F.lit(ASCII_TOKEN), F.lit(0)), F.regexp_extract_all(t, F.lit(GREEK_TOKEN), F.lit(0)), F.flatten(F.transform(F.regexp_extract_all(t, F.lit(CJK_RUN), F.lit(0)), pairs))]
    return drop_adjacent(F.transform(F.concat(*families), F.lower))


def normal_text(c, normalise: bool = True) -> Column:
    """NFKC unless left out, six kinds of dash become a hyphen, blanks single, lower case."""
    t = nfkc(text_of(c)) if normalise else text_of(c)
    return F.lower(F.trim(F.regexp_replace(F.translate(t, "‐‑‒–—−", "------"), r"\s+", " ")))


def normal_form(text: str) -> str:
    """normal_text of a plain string."""
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", unicodedata.normalize("NFKC", text).translate(str.maketrans("‐‑‒–—−", "------"))).strip(" ").lower()


def phrase_count(text: Column, needle: str) -> Column:
    return F.when(F.lit(needle) == "", 0).otherwise(((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / max(1, len(needle))).cast("int"))


def token_count(text: Column, needle: str) -> Column:
    """Occurrences with no word character, dot or hyphen on either side."""
    return F.regexp_count(text, F.lit(rf"(?U)(?<![\w.-])\Q{needle}\E(?![\w.-])"))


def discounted(count: Column, decay: float, most: int = 8) -> Column:
    """1 + decay + decay^2 + ... for at most `most` occurrences."""
    n = F.least(count, F.lit(most))
    if decay == 1:
        return n.cast("double")
    return F.when(n <= 0, 0.0).otherwise((1 - F.pow(F.lit(float(decay)), n)) / (1 - decay))


def node_id(kind, name_, species) -> Column:
    return F.sha1(F.concat_ws("|", kind, name(name_), F.when(kind == "Gene", name(species)).otherwise("")))


def edge_id(src: Column, dst: Column, relation: Column) -> Column:
    return F.sha1(F.format_string('{"dst": "%s", "relation": "%s", "src": "%s"}', dst, F.upper(relation), src))


def gene_names(c) -> Column:
    found = F.regexp_extract_all(text_of(c), F.lit(f"(?U)({GENE_NAME})(?!{'|'.join(VAGUE)})"), F.lit(1))
    return F.filter(F.array_distinct(found), lambda x: ~x.isin(*NOT_GENES))


def clean_markdown(c) -> Column:
    """Without images and bracketed links' targets; no more than one empty line in a row."""
    t = F.regexp_replace(F.regexp_replace(text_of(c), r"!\[[^\]]*\]\([^)]*\)", ""), r"\(https?://[^)]*\)", "")
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


def sections(c) -> Column:
    """The parts of a Markdown text, each from its `# ` heading on."""
    return F.split(text_of(c), r"(?m)(?=^# )")


def windows(c, size: int = 1500, step: int = 1300) -> Column:
    """Windows of characters: array of struct(start, piece)."""
    t = text_of(c)
    return F.when(F.length(t) == 0, F.array().cast("array<struct<start:int,piece:string>>")).otherwise(F.transform(F.sequence(F.lit(0), F.length(t) - 1, F.lit(step)), lambda i: F.struct(i.alias("start"), F.substring(t, i + 1, F.lit(size)).alias("piece"))))


def truncated(c, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(F.col(c))


def reverse_complement(c) -> Column:
    """Case is kept; N stays N."""
    return F.reverse(F.translate(text_of(c), "ACGTacgt", "TGCAtgca"))


def folder_name(stem: Column) -> Column:
    """A file's stem as the name of a folder: no converter's prefix, no mark of a second copy, hyphens for underscores."""
    return F.replace(F.replace(F.regexp_replace(stem, "^MinerU_markdown_", ""), F.lit("_(1)"), F.lit("")), F.lit("_"), F.lit("-"))


def blocks(rows: DataFrame, key: str, column: str, size: int = 1800, most: int = 100) -> DataFrame:
    """key, place, block: a text in blocks of `size` characters, the first `most`."""
    n = F.least(F.lit(most), F.ceil(F.length(column) / size)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(column), i * size + 1, F.lit(size)))
    return rows.filter(F.length(column) > 0).select(key, F.posexplode(cut).alias("place", "block"))


def value_text(c: Column, blanks=EVIDENCE_BLANKS) -> Column:
    """A list of texts as one, without placeholders; null is empty."""
    told = F.filter(F.transform(c, lambda x: clean(x, blanks)), lambda x: x != "")
    return F.coalesce(F.array_join(told, "; "), F.lit(""))


def truncated_deep(c: Column, kind: DataType, most: int) -> Column:
    """A value of any type in which each text that is longer is cut, and says so."""
    if isinstance(kind, StringType):
        return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("\n...[truncated]"))).otherwise(c)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: truncated_deep(x, kind.elementType, most))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda k, v: truncated_deep(v, kind.valueType, most))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[truncated_deep(c[f.name], f.dataType, most).alias(f.name) for f in kind.fields]))
    return c


FRONT = r"(?s)\A[^\S\n]*---[^\S\n]*\n(.*?)(?:(?<=\n)[^\S\n]*---[^\S\n]*(?:\n|\z))"
ENTRY = r"(?m)^([^:\n]*):(?:[ \t]*>[ \t]*(?=\n|\z)((?:\n  [^\n]*)*)|([^\n]*))"


def front_matter(c: Column) -> Column:
    """The entries (key, value, items) that a text's head between two lines of dashes holds: a value that is `>` is the
    indented lines below, joined; one in brackets is a list. Of a repeated key the last entry counts."""
    meta = F.regexp_extract(c, FRONT, 1)
    part = lambda n: F.regexp_extract_all(meta, F.lit(ENTRY), F.lit(n))
    zipped = F.arrays_zip(part(1).alias("k"), part(2).alias("folded"), part(3).alias("plain"))

    def entry(x: Column) -> Column:
        folded = F.trim(F.array_join(F.transform(F.split(x["folded"], "\n"), lambda y: F.trim(y)), " "))
        plain = F.trim(x["plain"])
        value = F.when(plain != "", plain).otherwise(folded)
        listed = F.filter(F.transform(F.split(F.regexp_extract(plain, r"(?s)^\[(.*)\]$", 1), ","), lambda y: F.trim(y)), lambda y: y != "")
        return F.struct(F.trim(x["k"]).alias("key"), value.alias("value"), F.when(plain.rlike(r"(?s)^\[.*\]$"), listed).alias("items"))

    entries = F.transform(zipped, entry)
    return F.transform(F.array(entries), lambda a: F.filter(a, lambda x, i: F.size(F.filter(F.slice(a, i + 2, F.size(a)), lambda y: y["key"] == x["key"])) == 0))[0]


def without_front_matter(c: Column) -> Column:
    """A text without such a head, trimmed; one without it stays as it is."""
    return F.when(c.rlike(FRONT), F.regexp_replace(F.regexp_replace(c, FRONT, ""), r"^\s+|\s+$", "")).otherwise(c)
