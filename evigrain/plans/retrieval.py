"""Queries over ranking, keyword scoring and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evigrain.functions import text as T
from evigrain.operators import field_index, fusion, keywords, ranking
from evigrain.plans.registry import query, table
from evigrain.sources import store
from evigrain.plans.text import KEPT_SQL

WORDS = "the licensed under free the"
TOP = 20

TF = f"tf AS (SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM ({KEPT_SQL})) GROUP BY ALL), dl AS (SELECT doc_id, len(w)::BIGINT AS dl FROM ({KEPT_SQL}))"
IDF = TF + ", raw AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM dl) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf GROUP BY term), idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"
BM25 = IDF + """, q AS (SELECT unnest(['the', 'licensed', 'under', 'free', 'the']) AS term), qt AS (SELECT term, count(*) AS qtf FROM q GROUP BY term),
s AS (SELECT doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dl))) * qtf) AS weighted, sum(tf)::DOUBLE AS plain FROM tf JOIN qt USING (term) JOIN idf USING (term) JOIN dl USING (doc_id) GROUP BY doc_id),
bm AS (SELECT doc_id, CASE WHEN (SELECT max(weighted) > 0 FROM s) THEN weighted ELSE plain END AS score FROM s)"""
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
COS = f"cos AS (SELECT e.vec_id, e.label, {_DOT.format(a='e.embedding', b='q.embedding')} / (sqrt({_DOT.format(a='e.embedding', b='e.embedding')}) * sqrt({_DOT.format(a='q.embedding', b='q.embedding')})) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


def _vector(spark, d) -> list[float]:
    """The query vector: that of vec_id 0."""
    return [float(x) for x in table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]]


@query("a01_term_counts", f"WITH {TF} SELECT doc_id, term, tf::BIGINT AS tf FROM tf")
def term_counts(spark, d):
    return ranking.term_counts(table(spark, d, "documents"))


@query("a02_lengths", f"WITH {TF} SELECT count(*)::BIGINT AS n, round(avg(dl), 6) AS avgdl FROM dl")
def lengths(spark, d):
    return ranking.doc_lengths(table(spark, d, "documents")).agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"))


@query("a03_idf", f"WITH {IDF} SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM idf")
def idf(spark, d):
    docs = table(spark, d, "documents")
    out = ranking.inverse_frequencies(ranking.term_counts(docs), docs.count())
    return out.select("term", "df", F.round("idf", 6).alias("idf"))


def _index(spark, d) -> ranking.Index:
    """The index of the documents, built once and kept until their files change."""
    docs = table(spark, d, "documents")
    return ranking.Index(**store.kept(spark, f"{d}/documents.parquet", "bm25", lambda: ranking.index_tables(docs), "2"))


@query("a04_bm25", f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM bm")
def bm25(spark, d):
    return ranking.bm25(_index(spark, d), WORDS).select("doc_id", F.round("score", 6).alias("score"))


@query("a05_bm25_fallback", "SELECT doc_id, 2.0::DOUBLE * (1 + doc_id % 5) AS score FROM documents WHERE doc_id IS NOT NULL")
def bm25_fallback(spark, d):
    """A corpus in which every text holds every word: no weight is positive anywhere, so scores are plain counts."""
    docs = table(spark, d, "documents").filter("doc_id IS NOT NULL").select("doc_id", F.expr("repeat('of the ', 1 + int(doc_id % 5))").alias("text"))
    return ranking.bm25(docs, "of the")


@query(
    "v02_bm25_top",
    f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM bm ORDER BY score DESC, doc_id DESC LIMIT {TOP}) "
    f"WHERE score > 0",
)
def bm25_top(spark, d):
    return ranking.top(ranking.bm25(_index(spark, d), WORDS), TOP, F.desc("score"), F.desc("doc_id"), positive=True).select("doc_id", F.round("score", 6).alias("score"))


@query("n01_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(ranking.norm("embedding"), 6).alias("norm"))


@query("n02_cosine", f"WITH {COS} SELECT vec_id, round(score, 6) AS score FROM cos")
def cosine(spark, d):
    return ranking.dense(table(spark, d, "embeddings"), _vector(spark, d)).select("vec_id", F.round("score", 6).alias("score"))


@query("v01_dense_top", f"WITH {COS} SELECT vec_id, round(score, 6) AS score FROM cos ORDER BY cos.score DESC, vec_id DESC LIMIT {TOP}")
def dense_top(spark, d):
    return ranking.top(ranking.dense(table(spark, d, "embeddings"), _vector(spark, d)), TOP, F.desc("score"), F.desc("vec_id")).select("vec_id", F.round("score", 6).alias("score"))


@query(
    "p21_dense_filtered",
    f"WITH {COS} SELECT vec_id, label, round(score, 6) AS score FROM cos WHERE label IN (1, 3) ORDER BY cos.score DESC, vec_id "
    f"DESC LIMIT {TOP}",
)
def dense_filtered(spark, d):
    """The filter comes before the cut and reaches the scan."""
    v = table(spark, d, "embeddings").filter(F.col("label").isin(1, 3))
    return ranking.top(ranking.dense(v, _vector(spark, d)), TOP, F.desc("score"), F.desc("vec_id")).select("vec_id", "label", F.round("score", 6).alias("score"))


SPEC = [keywords.Concept("licence", (keywords.Form("licensed under", 1.0), keywords.Form("license", 0.5, "token")), {"text": 1.0, "source": 0.5}), keywords.Concept("source", (keywords.Form("src1", 2.0, "phrase", ("the", "und")),), {"source": 1.5}, 0.8, 1.5)]
_N = r"lower(trim(regexp_replace(translate({x}, '‐‑‒–—−', '------'), '\s+', ' ', 'g')))"
_D = "(CASE WHEN {n} <= 0 THEN 0.0 ELSE (1 - pow(0.5, least({n}, 8))) / 0.5 END)"
_PH = "((length({t}) - length(replace({t}, '{w}', ''))) // {k})"
_TK = r"len(regexp_extract_all(regexp_replace(' ' || {t} || ' ', '([^\p{{L}}\p{{Nd}}_.-])', '\1\1', 'g'), '[^\p{{L}}\p{{Nd}}_.-]{w}[^\p{{L}}\p{{Nd}}_.-]'))"
_PARTS = " + ".join(f"{w} * {_D.format(n=n)}" for w, n in ((1.0, _PH.format(t="t", w="licensed under", k=14)), (0.5, _PH.format(t="s", w="licensed under", k=14)), (0.5, _TK.format(t="t", w="license")), (0.25, _TK.format(t="s", w="license"))))
KEYWORD_SQL = f"""WITH r AS (SELECT doc_id AS id, {_N.format(x='text')} AS t, {_N.format(x='source')} AS s FROM documents),
k AS (SELECT id, least({_PARTS}, 2.0) + least(CASE WHEN contains(t || ' ' || s, 'the') OR contains(t || ' ' || s, 'und') THEN 2.4 * {_D.format(n=_PH.format(t='s', w='src1', k=4))} ELSE 0.0 END, 3.6) AS score FROM r)"""


def _keyword(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    fields = store.kept(spark, f"{d}/documents.parquet", "fields", lambda: {"fields": keywords.normal_fields(rows)})["fields"]
    return keywords.scored(fields, SPEC, normal=True)


@query("a07_keyword_scores", KEYWORD_SQL + " SELECT id, round(score, 6) AS score FROM k WHERE score > 0")
def keyword_scores(spark, d):
    return _keyword(spark, d).select("id", F.round("score", 6).alias("score"))


def _fields(spark, d) -> field_index.FieldIndex:
    """The index of the documents' fields, built once and kept until their files change."""
    rows = table(spark, d, "documents").filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text", "source")
    return field_index.FieldIndex(**store.kept(spark, f"{d}/documents.parquet", "field-index", lambda: field_index.tables(keywords.long_fields(rows)), "2"))


def _explained(spark, d):
    return field_index.explained(_fields(spark, d), keywords.Spec(SPEC))


@query("v03_keyword_top", KEYWORD_SQL + f" SELECT id, round(score, 6) AS score FROM k WHERE score > 0 ORDER BY k.score DESC, id LIMIT {TOP}")
def keyword_top(spark, d):
    """Candidates come from postings; only their fields are read."""
    return ranking.top(field_index.scored(_fields(spark, d), keywords.Spec(SPEC)), TOP, F.desc("score"), F.asc("id")).select("id", F.round("score", 6).alias("score"))


_FORMS = (("licence", "text", "licensed under", 1.0, _PH.format(t="t", w="licensed under", k=14), 2.0), ("licence", "source", "licensed under", 0.5, _PH.format(t="s", w="licensed under", k=14), 2.0), ("licence", "text", "license", 0.5, _TK.format(t="t", w="license"), 2.0))
_FORMS += (("licence", "source", "license", 0.25, _TK.format(t="s", w="license"), 2.0), ("source", "source", "src1", 2.4, f"CASE WHEN contains(t || ' ' || s, 'the') OR contains(t || ' ' || s, 'und') THEN {_PH.format(t='s', w='src1', k=4)} ELSE 0 END", 3.6))
EXPLAIN_SQL = KEYWORD_SQL + ", m AS (" + " UNION ALL ".join(f"SELECT id, '{c}' AS concept, '{f}' AS field, '{x}' AS surface_form, ({n})::BIGINT AS n, {w} * {_D.format(n=n)} AS score, {cap} AS cap FROM r" for c, f, x, w, n, cap in _FORMS)
EXPLAIN_SQL += "), p AS (SELECT *, score * least(1.0, cap / sum(score) OVER (PARTITION BY id, concept)) AS part FROM m WHERE n > 0)"


@query("v03_explain", EXPLAIN_SQL + " SELECT id, concept, field, surface_form, n, round(score, 6) AS score, round(part, 6) AS part FROM p")
def explain(spark, d):
    """One row for each form that a field holds; a record's parts add up to its score."""
    return _explained(spark, d).select("id", "concept", "field", "surface_form", "n", F.round("score", 6).alias("score"), F.round("part", 6).alias("part"))


@query("j03_candidates", KEYWORD_SQL + ", c AS (SELECT id FROM r WHERE contains(t, 'licensed under') OR contains(s, 'licensed under') OR contains(t, 'license') OR contains(s, 'license') OR (contains(s, 'src1') AND (contains(t, 'the') OR contains(s, 'the') OR contains(t, 'und') OR contains(s, 'und')))) SELECT id FROM c")
def candidates(spark, d):
    """What the postings propose, after the values have been looked at."""
    index = _fields(spark, d)
    return field_index.held(index, keywords.Spec(SPEC))


FIELD_WEIGHT = 1.15
DEPTH = 50
LISTS = f"""WITH {BM25}, {COS}, {KEYWORD_SQL.removeprefix("WITH ")},
b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id DESC) AS rank FROM (SELECT * FROM bm ORDER BY score DESC, doc_id DESC LIMIT {DEPTH}) WHERE score > 0),
v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id DESC) AS rank FROM (SELECT * FROM cos ORDER BY score DESC, vec_id DESC LIMIT {DEPTH})),
w AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM k WHERE score > 0 ORDER BY k.score DESC, id LIMIT {DEPTH})),
l AS (SELECT id, rank, 0 AS list, 1.0::DOUBLE / (60 + rank) AS part FROM v UNION ALL SELECT id, rank, 1, 1.0::DOUBLE / (60 + rank) FROM b UNION ALL SELECT id, rank, 2, {FIELD_WEIGHT}::DOUBLE / (60 + rank) FROM w)"""
FUSED = ", f AS (SELECT id, sum(part) AS score, min({'l': list, 'r': rank}) AS first FROM l GROUP BY id)"


def _legs(spark, d, vector) -> list:
    """The dense, BM25 and field lists with their weights. Without a query vector, as when no model answers, the dense list is left
    out; so is a list without hits, whose weight moves nothing."""
    legs = []
    if vector is not None:
        dense = ranking.top(ranking.dense(table(spark, d, "embeddings"), vector), DEPTH, F.desc("score"), F.desc("vec_id"))
        legs.append((ranking.ranked(dense.withColumnRenamed("vec_id", "id"), F.desc("score"), F.desc("id")), 1.0))
    docs = ranking.top(ranking.bm25(_index(spark, d), WORDS), DEPTH, F.desc("score"), F.desc("doc_id"), positive=True)
    legs.append((ranking.ranked(docs.withColumnRenamed("doc_id", "id"), F.desc("score"), F.desc("id")), 1.0))
    fields = ranking.top(field_index.scored(_fields(spark, d), keywords.Spec(SPEC)), DEPTH, F.desc("score"), F.asc("id"))
    return [*legs, (ranking.ranked(fields, F.desc("score"), F.asc("id")), FIELD_WEIGHT)]


@query("a06_rrf", LISTS + FUSED + " SELECT id, round(score, 8) AS score FROM f")
def rrf(spark, d):
    return ranking.rrf(_legs(spark, d, _vector(spark, d))).select("id", F.round("score", 8).alias("score"))


def _best(fused):
    return fused.orderBy(F.desc("score"), "first").limit(TOP).select("id", F.round("score", 8).alias("score"))


@query("v04_hybrid", LISTS + FUSED + f" SELECT id, round(score, 8) AS score FROM f ORDER BY f.score DESC, first LIMIT {TOP}")
def hybrid(spark, d):
    """Dense, sparse and field rankings, fused; ties go to the first list, then to the rank in it."""
    return _best(ranking.rrf(_legs(spark, d, _vector(spark, d))))


@query("v04_hybrid_without_vector", LISTS + FUSED.replace("FROM l", "FROM l WHERE list > 0") + f" SELECT id, round(score, 8) AS score FROM f ORDER BY f.score DESC, first LIMIT {TOP}")
def hybrid_without_vector(spark, d):
    return _best(ranking.rrf(_legs(spark, d, None)))


#: Results to show, and candidates to rank anew.
SHOWN, RERANKED = 10, 25


@query("t05_candidate_depth", LISTS + FUSED + f" SELECT id, round(score, 8) AS score, place, place <= {SHOWN} AS shown FROM (SELECT id, score, row_number() OVER (ORDER BY f.score DESC, first)::INT AS place FROM f) WHERE place <= greatest({SHOWN}, {RERANKED})")
def candidate_depth(spark, d):
    """A hybrid search takes as many candidates as are shown, or are ranked anew if these are more; each list is asked for four
    times what is shown, DEPTH at least."""
    best = ranking.rrf(_legs(spark, d, _vector(spark, d))).orderBy(F.desc("score"), "first").limit(max(SHOWN, RERANKED))
    return ranking.ranked(best, F.desc("score"), F.col("first")).select("id", F.round("score", 8).alias("score"), F.col("rank").alias("place"), (F.col("rank") <= SHOWN).alias("shown"))


@query("f05_phrase_count", "SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3)::INT AS n FROM documents")
def phrase_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.phrase_count(F.col("text"), "the").alias("n"))


ROWS = r"rows_ AS (SELECT lang AS source, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS pos, lower(source) AS key, n_chars::DOUBLE AS score, doc_id FROM documents)"


def _rows(spark, d):
    """Documents as results of four sources, their languages; identity is the document's source. pos, the place in a source, is
    what orders it, so nothing has to be ranked."""
    pos = F.struct((-F.col("n_chars")).alias("n"), "doc_id")
    return table(spark, d, "documents").select(F.col("lang").alias("source"), pos.alias("pos"), F.lower("source").alias("key"), F.col("n_chars").cast("double").alias("score"), "doc_id")


@query("w02_best_of_source", f"WITH {ROWS} SELECT source, doc_id, score FROM rows_ WHERE pos = 1")
def best_of_source(spark, d):
    return _rows(spark, d).groupBy("source").agg(F.min_by(F.struct("doc_id", "score"), "pos").alias("r")).select("source", "r.*")


@query(
    "v08_fusion",
    f"WITH {ROWS}, o AS (SELECT *, CASE WHEN pos = 1 THEN 0 ELSE 1 END AS a, CASE WHEN pos = 1 THEN 0.0 ELSE -score END AS s FROM "
    f"rows_), c AS (SELECT * FROM o ORDER BY a, s, source, pos LIMIT {TOP}), k AS (SELECT *, row_number() OVER (PARTITION BY key "
    f"ORDER BY a, s, source, pos) AS again FROM c WHERE key <> '') SELECT row_number() OVER (ORDER BY a, s, source, pos)::INT AS "
    f"place, doc_id, key FROM k WHERE again = 1",
)
def fusion_(spark, d):
    return fusion.fused(_rows(spark, d), TOP).select("place", "doc_id", "key")


@query(
    "w03_dedupe",
    f"WITH {ROWS} SELECT key, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, doc_id) AS n FROM "
    f"rows_) WHERE n = 1",
)
def dedupe(spark, d):
    return fusion.deduplicated(_rows(spark, d), F.struct(-F.col("score"), "doc_id")).select("key", "doc_id")


@query(
    "w05_numbering",
    "SELECT doc_id, dense_rank() OVER (ORDER BY first)::BIGINT AS number FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY "
    "lower(text)) AS first FROM documents WHERE trim(text) <> '')",
)
def numbering(spark, d):
    """Documents are packets of one row; identity is the whole text."""
    rows = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("packet"), F.lit(0).alias("pos"), F.lower("text").alias("key")).filter("trim(key) <> ''")
    return fusion.numbered(rows).select("doc_id", "number")
