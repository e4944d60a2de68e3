"""Queries over text functions and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrain.functions import text as T
from evigrain.plans.registry import query, table

_BLANKS = "('', '-', 'na', 'n/a', 'none', 'null', 'nan', 'unknown', 'not available', 'not applicable')"
_ADJ = "list_filter({x}, lambda t, i: i = 1 OR t <> {x}[i - 1])"
TOKENS_SQL = "SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9][A-Za-z0-9._\\-/]*'), lambda x: lower(x)) AS w FROM documents"
KEPT_SQL = f"SELECT doc_id, {_ADJ.format(x='w')} AS w FROM ({TOKENS_SQL})"


@query("f01_tokenize", f"SELECT doc_id, array_to_string(w, ' ') AS tokens, len(w)::BIGINT AS n_tokens FROM ({KEPT_SQL})")
def tokenize(spark, d):
    w = table(spark, d, "documents").select("doc_id", T.tokens("text").alias("w"))
    return w.select("doc_id", F.array_join("w", " ").alias("tokens"), F.size("w").cast("long").alias("n_tokens"))


@query(
    "f03_normal_text",
    r"SELECT doc_id, lower(trim(regexp_replace(translate(text, '‐‑‒–—−', '------'), '\s+', ' ', 'g'))) AS normal FROM documents",
)
def normal_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normal_text("text").alias("normal"))


@query(
    "f11_clean_text",
    f"SELECT event_id, CASE WHEN lower(trim(coalesce(event_type, ''))) IN {_BLANKS} THEN '' ELSE trim(event_type) END AS cleaned "
    f"FROM events",
)
def clean_text(spark, d):
    return table(spark, d, "events").select("event_id", T.clean("event_type").alias("cleaned"))


@query("f12_doi", "SELECT page_id, regexp_replace('https://doi.org/10.1000/' || page_id, '^https?://(?:dx\\.)?doi\\.org/', '') AS doi FROM pages")
def doi(spark, d):
    return table(spark, d, "pages").select("page_id", T.doi(F.concat(F.lit("HTTPS://doi.org/10.1000/"), "page_id")).alias("doi"))


@query("f13_pmid", r"SELECT page_id, regexp_extract(url, '\d+') AS pmid FROM pages")
def pmid(spark, d):
    return table(spark, d, "pages").select("page_id", T.pmid("url").alias("pmid"))


@query("f14_url", "SELECT page_id, CASE WHEN regexp_matches(lower(trim(url)), '^https?://') THEN trim(url) ELSE '' END AS link FROM pages")
def url(spark, d):
    return table(spark, d, "pages").select("page_id", T.url("url").alias("link"))


_TITLE = r"trim(regexp_replace(regexp_replace(lower(trim({x})), '<[^>]+>', ' ', 'g'), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]+|_+', ' ', 'g'))"


@query(
    "f15_title_key",
    rf"SELECT doc_id, trim(regexp_replace({_TITLE.format(x=chr(115) + 'plit_part(text, chr(10), 1)')}, ' +', ' ', 'g')) AS title "
    rf"FROM documents",
)
def title_key(spark, d):
    return table(spark, d, "documents").select("doc_id", T.title_key(F.split("text", "\n")[0]).alias("title"))


@query(
    "f16_evidence_key",
    "SELECT page_id, 'url' AS kind, lower(regexp_replace(trim(url), '/+$', '')) AS value FROM pages WHERE "
    "regexp_matches(lower(trim(url)), '^https?://')",
)
def evidence_key(spark, d):
    return table(spark, d, "pages").select("page_id", T.evidence_key(F.lit("untitled"), url_="url").alias("k")).select("page_id", "k.*").filter("kind = 'url'")


@query("f20_name", r"SELECT p_partkey, lower(regexp_replace(trim(p_name), '\s+', ' ', 'g')) AS norm_name FROM part")
def name(spark, d):
    return table(spark, d, "part").select("p_partkey", T.name("p_name").alias("norm_name"))


_GRAPH_BLANKS = "('', '-', 'na', 'n/a', 'none', 'null', 'nan', 'unknown', 'not established', 'not available', 'not applicable')"
ITEMS_SQL = rf"""WITH s AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '[;,\n]') AS parts FROM documents),
e AS (SELECT doc_id, trim(parts[i]) AS item, i FROM s, unnest(range(1, len(parts) + 1)) AS u(i)),
k AS (SELECT doc_id, lower(regexp_replace(item, '\s+', ' ', 'g')) AS name, min(i) AS i, arg_min(item, i) AS item FROM e WHERE lower(item) NOT IN {_GRAPH_BLANKS} GROUP BY ALL)
SELECT s.doc_id, coalesce(string_agg(item, '|' ORDER BY i), '') AS items FROM s LEFT JOIN k USING (doc_id) GROUP BY s.doc_id"""


@query("f21_items_whole", ITEMS_SQL)
@query("f21_items", ITEMS_SQL)
def items(spark, d):
    """The distinct items of whole texts, in order."""
    lists = T.item_lists(table(spark, d, "documents"), "doc_id", "text")
    return lists.select("doc_id", F.array_join("items", "|").alias("items"))


@query(
    "f23_node_id",
    "SELECT n_nationkey, sha1('Gene|' || lower(trim(n_name)) || '|' || lower(trim(r_name))) AS id FROM nation JOIN region ON "
    "n_regionkey = r_regionkey",
)
def node_id(spark, d):
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", T.node_id(F.lit("Gene"), "n_name", "r_name").alias("id"))


@query("f24_edge_id", """SELECT s_suppkey, sha1('{"dst": "' || s_nationkey || '", "relation": "BASED_IN", "src": "' || s_suppkey || '"}') AS id FROM supplier""")
def edge_id(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", T.edge_id(F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"), F.lit("based_in")).alias("id"))


@query(
    "f34_clean_markdown",
    r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\(https?://[^)]*\)', "
    r"'', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS cleaned FROM pages",
)
def clean_markdown(spark, d):
    return table(spark, d, "pages").select("page_id", T.clean_markdown("html").alias("cleaned"))


@query(
    "f35_sections",
    "SELECT doc_id, i - 1 AS at, l[i] AS section FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), "
    "unnest(range(1, len(l) + 1)) AS u(i)",
)
def sections(spark, d):
    """Each line becomes a heading, so that each is a section of its own."""
    marked = F.regexp_replace(F.concat(F.lit("# "), F.regexp_replace("text", "\n", "\n# ")), "\r", "")
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.sections(marked)).alias("at", "section"))
    return rows.select("doc_id", F.col("at").cast("long").alias("at"), F.regexp_replace(F.regexp_replace("section", "^# ", ""), "\n$", "").alias("section"))


@query("f43_pseudonym", "SELECT user_id, sha256('salt:' || user_id) AS pseudonym FROM (SELECT DISTINCT user_id FROM events)")
def pseudonym(spark, d):
    return table(spark, d, "events").select("user_id").distinct().select("user_id", F.sha2(F.concat(F.lit("salt:"), F.col("user_id").cast("string")), 256).alias("pseudonym"))


@query("f45_gene_names")
def gene_names(spark, d):
    return table(spark, d, "documents").select("doc_id", T.gene_names("text").alias("names")).filter(F.size("names") > 0)


COMPLEMENT_SQL = "SELECT doc_id, array_to_string(list_reverse(regexp_extract_all(translate(coalesce(text, ''), 'ACGTacgt', 'TGCAtgca'), '(?s).')), '') AS complement FROM documents"


@query("f45_gene_names_of_parts", "SELECT p_partkey, 'GmFAD' || p_size || ',OsMYB' || p_partkey % 7 || 'a' AS names FROM part")
def gene_names_of_parts(spark, d):
    """Texts with names, a tool, a repeated name, one that goes on in another script, and one inside a word."""
    text = F.expr("'in GmFAD' || CAST(p_size AS STRING) || ' and OsMYB' || CAST(p_partkey % 7 AS STRING) || 'a, SpCas9; OsMYB' || CAST(p_partkey % 7 AS STRING) || 'a or AtPAL1等 and xZmA1 '")
    return table(spark, d, "part").select("p_partkey", F.array_join(T.gene_names(text), ",").alias("names"))


@query("n06_reverse_complement_all", COMPLEMENT_SQL)
@query("n06_reverse_complement", COMPLEMENT_SQL)
def reverse_complement(spark, d):
    """Texts are reversed by code points; a null text counts as empty."""
    return table(spark, d, "documents").select("doc_id", T.reverse_complement("text").alias("complement"))


@query(
    "n09_flanks",
    "SELECT l_orderkey, l_linenumber, greatest(1, CASE WHEN l_linenumber % 2 = 1 THEN l_partkey + 1 - 2000 ELSE l_partkey + "
    "l_suppkey + 2 END) AS up_from, CASE WHEN l_linenumber % 2 = 1 THEN l_partkey ELSE l_partkey + l_suppkey + 1 + 2000 END AS "
    "up_to FROM lineitem",
)
def flanks(spark, d):
    """The upstream region of 1-based genes [partkey + 1, partkey + suppkey + 1]; odd lines lie on the plus strand."""
    start, stop = F.col("l_partkey") + 1, F.col("l_partkey") + F.col("l_suppkey") + 1
    plus = F.col("l_linenumber") % 2 == 1
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.greatest(F.lit(1), F.when(plus, start - 2000).otherwise(stop + 1)).alias("up_from"), F.when(plus, start - 1).otherwise(stop + 2000).alias("up_to"))


@query(
    "w13_windows",
    "SELECT doc_id, i::BIGINT AS start, substring(text, i + 1, 1500) AS piece FROM documents, unnest(range(0, length(text), "
    "1300)) AS u(i)",
)
def windows(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(T.windows("text")).alias("w")).select("doc_id", F.col("w.start").cast("long").alias("start"), "w.piece")


@query(
    "p28_truncate",
    "SELECT conv_id, turn, CASE WHEN role = 'assistant' AND length(text) > 800 THEN substring(text, 1, 800) || '...' ELSE text "
    "END AS shown FROM conversations",
)
def truncate(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", T.truncated("text", 800)).otherwise(F.col("text")).alias("shown"))


@query(
    "p28_truncated_deep",
    "SELECT conv_id, turn, role, CASE WHEN length(text) > 40 THEN substring(text, 1, 40) || chr(10) || '...[truncated]' ELSE text END AS shown, CASE WHEN text IS NULL THEN 0 ELSE 2 END::INT AS n FROM conversations",
)
def truncated_deep(spark, d):
    """Texts inside lists and maps inside a record are cut; all else stays."""
    value = F.struct(F.col("turn").alias("turn"), F.array(F.create_map(F.lit("role"), F.col("role"), F.lit("text"), F.col("text"))).alias("said"))
    rows = table(spark, d, "conversations").select("conv_id", "text", value.alias("value"))
    cut = rows.select("conv_id", "text", T.truncated_deep(F.col("value"), rows.schema["value"].dataType, 40).alias("v"))
    said = F.col("v.said")[0]
    return cut.select("conv_id", "v.turn", said["role"].alias("role"), said["text"].alias("shown"), F.when(F.col("text").isNull(), 0).otherwise(F.size(said)).alias("n"))


@query(
    "f46_front_matter",
    "SELECT p_partkey, p_name AS name, CASE WHEN p_size % 3 = 0 THEN 'first second' ELSE '>' || p_size END AS told, CASE WHEN p_size % 2 = 0 THEN 'a,b ' || p_size END AS tags, CASE WHEN p_size % 5 = 0 THEN '--- ' || p_name ELSE 'Body' || chr(10) || '---' || chr(10) || 'more' END AS body "
    "FROM part WHERE p_size % 5 <> 0 UNION ALL SELECT p_partkey, NULL, NULL, NULL, '--- ' || p_name || chr(10) || 'name: x' FROM part WHERE p_size % 5 = 0",
)
def front_matter(spark, d):
    """Heads of texts: plain values, folded ones, lists, repeated keys; and texts whose head doesn't end."""
    told = "CASE WHEN p_size % 3 = 0 THEN ' >\n  first\n   second' ELSE ' >' || CAST(p_size AS STRING) END"
    tags = "CASE WHEN p_size % 2 = 0 THEN 'tags: [a, , b ' || CAST(p_size AS STRING) || ']\n' ELSE 'no tags\n' END"
    head = F.expr(f"'--- \nname: old\ntold:' || {told} || '\n\n' || {tags} || 'name: ' || p_name || '\n---\n\n Body\n---\nmore\n'")
    text = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("--- "), "p_name", F.lit("\nname: x"))).otherwise(head)
    rows = table(spark, d, "part").select("p_partkey", text.alias("t")).select("p_partkey", T.front_matter(F.col("t")).alias("m"), T.without_front_matter(F.col("t")).alias("body"))
    of = lambda k: F.get(F.filter("m", lambda x: x["key"] == k), F.lit(0))
    return rows.select("p_partkey", of("name")["value"].alias("name"), of("told")["value"].alias("told"), F.array_join(of("tags")["items"], ",").alias("tags"), "body")
