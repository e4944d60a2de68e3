"""Queries over evidence, citations and answers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evigrain.functions import text as T
from evigrain.operators import evidence, fusion, interactions, ranking
from evigrain.plans.registry import query, table
from evigrain.sources import library, store

_IDS = """p AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'https://doi.org/10.1000/' || page_id WHEN 1 THEN 'doi:10.7/' || page_id WHEN 2 THEN 'n/a' ELSE '' END AS doi,
CASE WHEN page_id % 3 = 0 THEN 'PMID: ' || (1000 + page_id) WHEN page_id % 3 = 1 THEN 'none' END AS pmid, CASE WHEN page_id % 5 = 0 THEN url WHEN page_id % 5 = 1 THEN 'ftp://x' ELSE '' END AS link, 'On <b>Page</b> ' || (page_id % 50) AS title FROM pages)"""
_DOI = "CASE page_id % 4 WHEN 0 THEN '10.1000/' || page_id WHEN 1 THEN '10.7/' || page_id ELSE '' END"
_PMID = "CASE WHEN page_id % 3 = 0 THEN (1000 + page_id)::VARCHAR ELSE '' END"
_URL = "CASE WHEN page_id % 5 = 0 THEN url ELSE '' END"


def _ids(spark, d):
    """Pages with identifiers of every form: urls and prefixes before a DOI, placeholders, other schemes, none."""
    n = F.col("page_id")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    doi = F.when(n % 4 == 0, text("https://doi.org/10.1000/", n)).when(n % 4 == 1, text("doi:10.7/", n)).when(n % 4 == 2, "n/a").otherwise("")
    pmid = F.when(n % 3 == 0, text("PMID: ", n + 1000)).when(n % 3 == 1, "none")
    link = F.when(n % 5 == 0, F.col("url")).when(n % 5 == 1, "ftp://x").otherwise("")
    return table(spark, d, "pages").select("page_id", "url", doi.alias("doi"), pmid.alias("pmid"), link.alias("link"), text("On <b>Page</b> ", n % 50).alias("title"))


@query("f12_doi_forms", f"WITH {_IDS} SELECT page_id, {_DOI} AS doi FROM p")
def doi_forms(spark, d):
    return _ids(spark, d).select("page_id", T.doi("doi").alias("doi"))


@query(
    "f16_evidence_kinds",
    f"WITH {_IDS}, k AS (SELECT page_id, {_DOI} AS d, {_PMID} AS m, {_URL} AS u FROM p) SELECT page_id, CASE WHEN d <> '' THEN "
    f"'doi' WHEN m <> '' THEN 'pmid' WHEN u <> '' THEN 'url' ELSE 'title' END AS kind, CASE WHEN d <> '' THEN d WHEN m <> '' THEN "
    f"m WHEN u <> '' THEN lower(regexp_replace(u, '/+$', '')) ELSE 'on page ' || (page_id % 50) END AS value FROM k",
)
def evidence_kinds(spark, d):
    """Every branch of the identity of a row: DOI, PMID, url, title."""
    return _ids(spark, d).select("page_id", T.evidence_key("title", "doi", "pmid", "link").alias("k")).select("page_id", "k.kind", "k.value")


@query(
    "f17_derived_url",
    f"WITH {_IDS} SELECT page_id, CASE WHEN {_URL} <> '' THEN {_URL} WHEN {_DOI} <> '' THEN 'https://doi.org/' || {_DOI} WHEN "
    f"{_PMID} <> '' THEN 'https://pubmed.ncbi.nlm.nih.gov/' || {_PMID} || '/' ELSE '' END AS link FROM p",
)
def derived_url(spark, d):
    return _ids(spark, d).select("page_id", evidence.derived_url("doi", "pmid", "link").alias("link"))


@query(
    "f18_tool_index",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE event_id::VARCHAR END AS source_id, CASE WHEN event_id % 3 "
    "= 0 THEN 0 ELSE event_id END::BIGINT AS tool_index FROM events",
)
def tool_index(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string")).alias("source_id"))
    return rows.withColumn("tool_index", evidence.tool_index("source_id"))


@query(
    "f19_prompt_block",
    f"WITH {_IDS} SELECT page_id, '[' || page_id || '] ' || title || chr(10) || '来源: ' || 'web' || CASE WHEN {_DOI} <> '' THEN "
    f"chr(10) || 'DOI: ' || {_DOI} ELSE '' END || CASE WHEN {_PMID} <> '' THEN chr(10) || 'PMID: ' || {_PMID} ELSE '' END || CASE "
    f"WHEN link <> '' THEN chr(10) || '链接: ' || link ELSE '' END || chr(10) || '内容: ' || url AS block FROM p",
)
def prompt_block(spark, d):
    rows = _ids(spark, d).withColumn("doi", T.doi("doi")).withColumn("pmid", T.pmid("pmid")).withColumn("source", F.lit("web"))
    return rows.select("page_id", evidence.prompt_block(source_id="page_id", title="title", source="source", doi="doi", pmid="pmid", url="link", content="url").alias("block"))


_SOURCES = "s AS (SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'pubmed' WHEN 1 THEN 'gene' WHEN 2 THEN 'graph' WHEN 3 THEN 'personal' ELSE 'other' END AS source, value FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY value DESC, event_id) AS pos FROM s)"


def _sources(spark, d):
    n = F.col("user_id") % 5
    name = F.when(n == 0, "pubmed").when(n == 1, "gene").when(n == 2, "graph").when(n == 3, "personal").otherwise("other")
    return table(spark, d, "events").select("event_id", name.alias("source"), "value")


def _ranked(rows, most: int):
    """pos within each source, up to `most`: Spark keeps the first few of each partition before it shuffles."""
    pos = F.row_number().over(W.partitionBy("source").orderBy(F.desc("value"), "event_id"))
    return rows.withColumn("pos", pos).filter(F.col("pos") <= most)


@query(
    "t07_budgets",
    f"WITH {_SOURCES} SELECT event_id, source, pos FROM r WHERE pos <= CASE source WHEN 'pubmed' THEN 6 WHEN 'gene' THEN 12 WHEN "
    f"'graph' THEN 4 WHEN 'personal' THEN 8 ELSE 0 END",
)
def budgets(spark, d):
    return evidence.within_budget(_ranked(_sources(spark, d), 20), "normal").select("event_id", "source", F.col("pos").cast("long").alias("pos"))


@query(
    "t07_deep_budgets",
    f"WITH {_SOURCES} SELECT event_id, source, pos FROM r WHERE pos <= CASE source WHEN 'pubmed' THEN 12 WHEN 'gene' THEN 20 WHEN "
    f"'graph' THEN 8 WHEN 'personal' THEN 12 ELSE 0 END",
)
def deep_budgets(spark, d):
    return evidence.within_budget(_ranked(_sources(spark, d), 20), "deep").select("event_id", "source", F.col("pos").cast("long").alias("pos"))


@query(
    "a21_warnings",
    f"WITH {_SOURCES}, all_ AS (SELECT unnest(['pubmed', 'gene', 'nowhere']) AS source) SELECT source, count(event_id)::BIGINT AS "
    f"n, CASE WHEN count(event_id) = 0 THEN source || ' returned nothing' END AS warning FROM all_ LEFT JOIN s USING (source) "
    f"GROUP BY source",
)
def warnings(spark, d):
    return evidence.source_counts(_sources(spark, d), ["pubmed", "gene", "nowhere"])


@query(
    "v05_gene_rows",
    "SELECT doc_id::VARCHAR AS source_id, 'gene' AS source, coalesce(nullif(source, ''), 'Unknown') AS title, text AS content, n_chars::DOUBLE AS score FROM documents WHERE text IS NOT NULL ORDER BY n_chars DESC, doc_id LIMIT 12",
)
def gene_rows(spark, d):
    """Ranked chunks as evidence."""
    rows = table(spark, d, "documents").filter("text IS NOT NULL").orderBy(F.desc("n_chars"), "doc_id").limit(12)
    return rows.select(F.col("doc_id").cast("string").alias("source_id"), F.lit("gene").alias("source"), F.coalesce(F.nullif("source", F.lit("")), F.lit("Unknown")).alias("title"), F.col("text").alias("content"), F.col("n_chars").cast("double").alias("score"))


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_PERSONAL = f"""q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), c AS (SELECT e.vec_id, e.label AS user_id, 'file' || (e.vec_id % 7) || '.pdf' AS filename, e.vec_id % 20 + 1 AS page,
{_DOT.format(a='e.embedding', b='q.embedding')} / (sqrt({_DOT.format(a='e.embedding', b='e.embedding')}) * sqrt({_DOT.format(a='q.embedding', b='q.embedding')}) + 1e-9) AS score FROM embeddings e, q)"""


def _personal(spark, d):
    v = table(spark, d, "embeddings")
    vector = [float(x) for x in v.filter("vec_id = 0").first()["embedding"]]
    rows = v.select("vec_id", F.col("label").alias("user_id"), F.concat(F.lit("file"), F.col("vec_id") % 7, F.lit(".pdf")).alias("filename"), (F.col("vec_id") % 20 + 1).alias("page"), "embedding")
    return rows, vector


@query("n03_personal_cosine", f"WITH {_PERSONAL} SELECT vec_id, round(score, 6) AS score FROM c")
def personal_cosine(spark, d):
    rows, vector = _personal(spark, d)
    return ranking.dense(rows, vector, 1e-9).select("vec_id", F.round("score", 6).alias("score"))


@query(
    "v06_personal_search",
    f"WITH {_PERSONAL} SELECT filename || ' (p.' || page || ')' AS title, round(score, 6) AS score FROM c WHERE user_id = 3 ORDER "
    f"BY c.score DESC, vec_id DESC LIMIT 8",
)
def personal_search(spark, d):
    """One user's own pages only; the filter comes before the ranking and reaches the scan."""
    rows, vector = _personal(spark, d)
    best = ranking.top(ranking.dense(rows.filter("user_id = 3"), vector, 1e-9), 8, F.desc("score"), F.desc("vec_id"))
    return best.select(F.concat("filename", F.lit(" (p."), "page", F.lit(")")).alias("title"), F.round("score", 6).alias("score"))


@query("t14_personal_ties", "SELECT vec_id FROM embeddings WHERE label = 2 ORDER BY floor(vec_id / 5) DESC, vec_id DESC LIMIT 8")
def personal_ties(spark, d):
    """Equal scores: the row that came last is first."""
    rows = table(spark, d, "embeddings").filter("label = 2").select("vec_id", F.floor(F.col("vec_id") / 5).alias("score"))
    return ranking.top(rows, 8, F.desc("score"), F.desc("vec_id")).select("vec_id")


@query(
    "v11_personal_files",
    f"WITH {_PERSONAL} SELECT user_id, filename, count(*)::BIGINT AS chunks, max(page)::BIGINT AS pages FROM c WHERE user_id IS "
    f"NOT NULL GROUP BY ALL",
)
def personal_files(spark, d):
    rows, _ = _personal(spark, d)
    return rows.filter("user_id IS NOT NULL").groupBy("user_id", "filename").agg(F.count("*").alias("chunks"), F.max("page").alias("pages"))


def _asked(spark, d):
    """Two sources answer; one can't be set up, and one fails in its tasks."""
    rows = _sources(spark, d)

    def of(name, most):
        return lambda: _ranked(rows.filter(F.col("source") == name), most).select("pos", F.col("event_id").alias("key"), F.col("value").alias("score"), F.lit("").alias("title"))

    def absent():
        raise OSError("no connection")

    def breaking():
        return of("pubmed", 12)().withColumn("title", F.when(F.col("pos") > 1, F.raise_error(F.lit("half an answer")).cast("string")).otherwise("one"))

    return evidence.together({"gene": of("gene", 12), "personal": absent, "pubmed": breaking, "graph": of("graph", 4)})


@query(
    "v07_all_sources",
    f"WITH {_SOURCES} SELECT source, event_id::VARCHAR AS key, pos::BIGINT AS pos FROM r WHERE (source = 'gene' AND pos <= 12) OR (source = 'graph' AND "
    f"pos <= 4)",
)
def all_sources(spark, d):
    """A source's failure, at any time, costs its own rows only."""
    return _asked(spark, d)[0].select("source", "key", "pos")


@query(
    "v07_source_states",
    f"WITH {_SOURCES} SELECT s AS source, CASE WHEN s IN ('gene', 'graph') THEN 'answered' ELSE 'failed' END AS state, CASE WHEN s IN ('gene', 'graph') THEN (SELECT count(*) FROM r WHERE source = s AND pos <= CASE s "
    "WHEN 'gene' THEN 12 ELSE 4 END) ELSE 0 END::BIGINT AS n FROM (SELECT unnest(['gene', 'personal', 'pubmed', 'graph']) AS s)",
)
def source_states(spark, d):
    return _asked(spark, d)[1].select("source", "state", "n")


@query(
    "m10_library",
    f"WITH {_PERSONAL}, f AS (SELECT vec_id, page, score, CASE filename WHEN 'file1.pdf' THEN 'renamed.pdf' ELSE filename END AS file FROM c WHERE user_id = 3 AND filename <> 'file2.pdf') "
    "SELECT file, page::BIGINT AS page, vec_id::BIGINT AS at, round(score, 6) AS score FROM f",
)
def library_(spark, d):
    """A user's files are added, one is renamed, one deleted, and the rest is searched under their names."""
    rows, vector = _personal(spark, d)
    own = library.Library(spark, f"{store.root_of(spark)}/libraries-{uuid.uuid4().hex}", "user 3", library.Limits(chunks=10**9, chars=10**12))
    own.put(rows.filter("user_id = 3").select(F.col("filename").alias("file"), F.col("page").cast("long"), F.col("vec_id").cast("long").alias("at"), F.lit("").alias("text"), F.col("embedding").cast("array<double>").alias("embedding")))
    own.rename("file1.pdf", "renamed.pdf")
    own.delete("file2.pdf")
    return ranking.dense(own.chunks(), vector, 1e-9).select("file", "page", "at", F.round("score", 6).alias("score"))


_ANSWERS = """a AS (SELECT o_orderkey AS id, 'see [' || (o_orderkey % 7 + 1) || '] and [9] and [' || (o_orderkey % 3 + 1) || '] or [' || (o_orderkey % 7 + 1) || ']' AS answer FROM orders),
c AS (SELECT o_orderkey AS id, n::BIGINT AS number FROM orders, unnest([1, 2, 3, 4, 5]) AS u(n) WHERE (o_orderkey + n) % 4 <> 0),
m AS (SELECT id, x::BIGINT AS number, min(i) AS first FROM (SELECT id, unnest(regexp_extract_all(answer, '\\[(\\d+)\\]', 1)) AS x, generate_subscripts(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), 1) AS i FROM a) GROUP BY id, x),
k AS (SELECT m.* FROM m JOIN c USING (id, number)), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY first) AS place FROM k)"""


def _answers(spark, d):
    n = F.col("o_orderkey")
    orders = table(spark, d, "orders").select("o_orderkey")
    text = F.concat(F.lit("see ["), n % 7 + 1, F.lit("] and [9] and ["), n % 3 + 1, F.lit("] or ["), n % 7 + 1, F.lit("]"))
    cites = orders.select(n.alias("id"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(1, 6)])).alias("number"))
    return orders.select(n.alias("id"), text.alias("answer")), cites.filter((F.col("id") + F.col("number")) % 4 != 0)


@query("j11_cited", f"WITH {_ANSWERS} SELECT id, number FROM k UNION ALL SELECT id, number FROM c ANTI JOIN k USING (id)")
def cited(spark, d):
    answers, citations = _answers(spark, d)
    return evidence.cited(citations, answers)


@query(
    "w06_renumbered",
    f"WITH {_ANSWERS} SELECT a.id, 'see [' || coalesce(x.place, a.id % 7 + 1) || '] and [9] and [' || coalesce(y.place, a.id % 3 + "
    f"1) || '] or [' || coalesce(x.place, a.id % 7 + 1) || ']' AS answer FROM a LEFT JOIN o x ON x.id = a.id AND x.number = a.id % "
    f"7 + 1 LEFT JOIN o y ON y.id = a.id AND y.number = a.id % 3 + 1",
)
def renumbered_answers(spark, d):
    answers, citations = _answers(spark, d)
    return evidence.renumbered(citations, answers)[0]


@query("w06_citations", f"WITH {_ANSWERS} SELECT id, place AS number FROM o UNION ALL SELECT id, number FROM c ANTI JOIN o USING (id)")
def renumbered_citations(spark, d):
    answers, citations = _answers(spark, d)
    return evidence.renumbered(citations, answers)[1]


@query(
    "w04_consecutive",
    f"WITH {_SOURCES} SELECT event_id, row_number() OVER (ORDER BY source, pos) AS number FROM r WHERE source IN ('gene', 'graph') "
    f"AND pos <= 8",
)
def consecutive(spark, d):
    """Numbers from 1 in the order of a bounded result."""
    rows = _ranked(_sources(spark, d).filter(F.col("source").isin("gene", "graph")), 8)
    return fusion.numbered(rows.select("event_id", F.col("source").alias("packet"), "pos", F.col("event_id").cast("string").alias("key"))).select("event_id", "number")


@query(
    "u04_ordered_bag",
    f"WITH {_SOURCES} SELECT source, event_id FROM r WHERE (source = 'gene' OR source = 'graph') AND pos <= 3 UNION ALL SELECT "
    f"source, event_id FROM r WHERE source = 'gene' AND pos <= 2",
)
def ordered_bag(spark, d):
    """Rows of several sources side by side, repeated ones too."""
    best = _ranked(_sources(spark, d).filter(F.col("source").isin("gene", "graph")), 3)
    again = best.filter("source = 'gene' AND pos <= 2")
    return best.select("source", "event_id").unionByName(again.select("source", "event_id"))


_NOTE = "CASE event_id % 5 WHEN 0 THEN 'x {''source_type'': ''personal''}' WHEN 1 THEN '[{\"source_type\": \"Personal\"}]' WHEN 2 THEN '来源: PERSONAL notes' WHEN 3 THEN 'source_type personal' END"


@query("f44_personal_marks", "SELECT event_id, event_id % 5 < 3 AS personal FROM events")
def personal_marks(spark, d):
    """Whether a tool's result, or what it was asked with, says that it came from a user's own files."""
    return table(spark, d, "events").select("event_id", interactions.personal(F.col("props"), F.expr(_NOTE)).alias("personal"))
