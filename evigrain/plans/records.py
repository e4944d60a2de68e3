"""Queries over evaluation records, curation, sources and interaction privacy."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrain.functions import text as T
from evigrain.operators import chunking, curation, evaluation, graph
from evigrain.plans.analytics import FAILED, RESULTS, results
from evigrain.plans.graph import EDGES, edges
from evigrain.plans.registry import query, table
from evigrain.sources import tables


@query(
    "a16_status_counts",
    f"WITH {RESULTS} SELECT count(*)::BIGINT AS total, count(*) FILTER ({FAILED} IS NULL)::BIGINT AS completed, count(*) FILTER "
    f"({FAILED} IS NOT NULL)::BIGINT AS failed, (SELECT count(*) FROM documents)::BIGINT - count(DISTINCT question) FILTER "
    f"(question IN (SELECT doc_id FROM documents))::BIGINT AS remaining FROM r",
)
def status_counts(spark, d):
    """A checkpoint's results by outcome, and the questions without any."""
    return evaluation.checkpoint_status(results(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("question")))


@query(
    "a20_fidelity",
    "SELECT count(*)::BIGINT AS total, sum(quality)::BIGINT AS supported, round(sum(quality) / count(*), 6) AS fidelity FROM "
    "labels WHERE quality IS NOT NULL",
)
def fidelity(spark, d):
    """How much of a whole corpus is supported."""
    rows = table(spark, d, "labels").filter("quality IS NOT NULL")
    return rows.agg(F.count("*").alias("total"), F.sum("quality").alias("supported"), F.round(F.sum("quality") / F.count("*"), 6).alias("fidelity"))


@query(
    "a23_index_status",
    "SELECT count(*)::BIGINT AS files, count(l.doc_id)::BIGINT AS indexed, (count(*) - count(l.doc_id))::BIGINT AS missing, "
    "printf('%.1f%%', count(l.doc_id) / count(*) * 100) AS synced FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN "
    "(SELECT DISTINCT doc_id FROM labels) l USING (doc_id)",
)
def index_status(spark, d):
    file = F.col("doc_id").alias("file")
    return curation.index_status(table(spark, d, "documents").select(file), table(spark, d, "labels").select(file))


@query(
    "a24_dashboard",
    "SELECT 'customers' AS what, count(*)::BIGINT AS n FROM customer UNION ALL SELECT 'open orders', count(*) FROM orders WHERE "
    "o_orderstatus = 'O' UNION ALL SELECT 'documents', count(*) FROM documents",
)
def dashboard(spark, d):
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(table(spark, d, "customer"), "customers").unionByName(count(table(spark, d, "orders").filter("o_orderstatus = 'O'"), "open orders")).unionByName(count(table(spark, d, "documents"), "documents"))


@query(
    "t16_details",
    f"WITH {RESULTS} SELECT question, agent, score FROM (SELECT CASE WHEN question % 9 = 0 THEN NULL ELSE question END AS "
    f"question, agent, score FROM r) ORDER BY coalesce(question, 0), agent, score",
)
def details(spark, d):
    """By question, with rows without one first."""
    rows = results(spark, d).select(F.when(F.col("question") % 9 != 0, F.col("question")).alias("question"), "agent", "score")
    return rows.orderBy(F.coalesce("question", F.lit(0)), "agent", "score")


@query("p20_created_after", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-10 12:00:00'")
def created_after(spark, d):
    rows = table(spark, d, "events").withColumn("t", F.col("ts").cast("string"))
    return rows.filter(evaluation.parsed_time("t") > F.lit("2024-01-10T12:00:00Z").cast("timestamp")).select("event_id")


@query(
    "f40_time_forms",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN "
    "date_trunc('second', ts) WHEN 3 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS parsed FROM events",
)
def time_forms(spark, d):
    """ISO with Z, a date, seconds since 1970, ISO with an offset, and text that is no time."""
    ts, n = F.date_trunc("second", F.col("ts").cast("timestamp")), F.col("event_id") % 5
    form = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(n == 0, F.concat(form, F.lit("Z"))).when(n == 1, F.date_format(ts, "yyyy-MM-dd")).when(n == 2, F.unix_timestamp(ts).cast("string")).when(n == 3, F.concat(form, F.lit("+02:00"))).otherwise("soon")
    return table(spark, d, "events").select("event_id", text.alias("t")).select("event_id", evaluation.parsed_time("t").cast("timestamp_ntz").alias("parsed"))


@query(
    "f41_rubric",
    "SELECT event_id, 1 AS item, (CASE WHEN event_id % 3 = 0 THEN event_id % 11 ELSE event_id % 7 END)::DOUBLE AS points FROM events "
    "UNION ALL SELECT event_id, 2, -(event_id % 5 + 0.5) FROM events WHERE event_id % 2 = 0",
)
def rubric(spark, d):
    """Item and points of every line of a judgement's detail."""
    n = F.col("event_id")
    two = F.when(n % 2 == 0, F.concat(F.lit("\n采分点2 ： -"), (n % 5).cast("string"), F.lit(".5  分"))).otherwise("\n采分点3: 分")
    again = F.when(n % 3 == 0, F.concat(F.lit("; 采分点 1:"), (n % 11).cast("string"), F.lit("分"))).otherwise("")
    return evaluation.rubric_points(table(spark, d, "events").select("event_id", F.concat(F.lit("采分点 1: "), (n % 7).cast("string"), F.lit("分 (of 7)"), two, again).alias("detail")), "event_id", "detail")


@query(
    "x05_outcomes",
    "SELECT CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 4 = 0 THEN 'skipped' ELSE 'processed' END AS outcome, "
    "count(*)::BIGINT AS n, min(event_id) AS first FROM events GROUP BY 1",
)
def outcomes(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("file"), F.when(F.col("event_type") == "error", "boom").alias("error"), (F.col("event_id") % 4 == 0).alias("had_output"))
    return curation.outcomes(rows)


_BUCKETS = "SELECT o_custkey AS file, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS bucket, o_orderkey AS ord, o_orderpriority AS name FROM orders"


@query(
    "x06_collected",
    f"SELECT file, bucket, (row_number() OVER (PARTITION BY file, bucket ORDER BY ord) - 1)::INT AS place, ord AS gene FROM "
    f"({_BUCKETS})",
)
def collected(spark, d):
    """Genes of three arrays, each with its place in its own."""
    of = lambda status, name: F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == status, F.col("o_orderkey")))).alias(name)
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("file")).agg(of("F", "done"), of("O", "open"), of("P", "part"))
    return curation.collected(rows, ("done", "open", "part"))


@query("x02_categories", f"SELECT file, name, arg_max(bucket, ord) AS bucket FROM ({_BUCKETS}) GROUP BY file, name")
def categories(spark, d):
    """Each name's category; the last one counts."""
    bucket = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "open").otherwise("part")
    return curation.categories(table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("name"), bucket.alias("bucket"), F.col("o_orderkey").alias("ord")))


@query(
    "j09_corrected",
    "SELECT doc_id AS gene, 'text' AS field, CASE WHEN quality = 0 THEN 'NA' ELSE lang END AS value FROM documents LEFT JOIN "
    "(SELECT doc_id, quality FROM labels) USING (doc_id)",
)
def corrected(spark, d):
    """Values whose last verdict is unsupported become NA; genes without a verdict stay."""
    fields = table(spark, d, "documents").select(F.col("doc_id").alias("gene"), F.lit("text").alias("field"), F.col("lang").alias("value"))
    verdict = F.when(F.col("quality") == 0, "UNSUPPORTED").otherwise("SUPPORTED")
    old = table(spark, d, "labels").select(F.col("doc_id").alias("gene"), F.lit("text").alias("field"), F.lit("UNSUPPORTED").alias("verdict"), F.lit(0).alias("at"))
    new = table(spark, d, "labels").select(F.col("doc_id").alias("gene"), F.lit("text").alias("field"), verdict.alias("verdict"), F.lit(1).alias("at"))
    return curation.corrected(fields, old.unionByName(new)).select("gene", "field", "value")


@query(
    "x07_result_rows",
    "SELECT event_id AS question, CASE WHEN event_type = 'error' THEN 'agent_error' WHEN event_id % 3 = 0 THEN 'judge_error' ELSE "
    "'completed' END AS status, CASE WHEN event_type <> 'error' AND event_id % 3 <> 0 THEN value ELSE 0.0 END AS score FROM "
    "events",
)
def result_rows(spark, d):
    """A result row of each question: no answer is the agent's failure, no judgement the judge's, else its score counts."""
    n = F.col("event_id")
    rows = table(spark, d, "events").select(n.alias("question"), F.when(F.col("event_type") != "error", "text").alias("answer"), F.when(n % 3 != 0, F.col("value")).alias("judged"))
    return evaluation.result_rows(rows)


@query(
    "x13_checkpoints",
    "SELECT agent, version, count(*)::BIGINT AS n FROM (SELECT 'run_' || (user_id % 3) AS agent, 'v' || (event_id % 2) AS version "
    "FROM events) GROUP BY ALL",
)
def checkpoints(spark, d):
    """Agent and version from a file name; the last underscore parts them."""
    file = F.concat(F.lit("run_"), F.col("user_id") % 3, F.lit("_v"), F.col("event_id") % 2, F.lit(".jsonl"))
    return evaluation.checkpoint_names(table(spark, d, "events").select(file.alias("file"))).groupBy("agent", "version").agg(F.count("*").alias("n"))


@query(
    "j21_new_uploads",
    "SELECT 'doc' || doc_id || '.md' AS file, 'doc' || doc_id AS stem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM "
    "labels) AND doc_id % 7 <> 0",
)
def new_uploads(spark, d):
    stem = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    docs = table(spark, d, "documents")
    return curation.new_stems(docs.select(F.concat(stem, F.lit(".md")).alias("file")), table(spark, d, "labels").select(stem.alias("stem")), docs.filter("doc_id % 7 = 0").select(stem.alias("stem")))


_FIELD_ROWS = "f AS (SELECT doc_id AS id, 'source' AS field, source AS value FROM documents WHERE source IS NOT NULL UNION ALL SELECT doc_id, 'lang', lang FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, 'text', text FROM documents WHERE text IS NOT NULL)"


def _field_rows(spark, d):
    docs = table(spark, d, "documents")
    one = lambda c: docs.filter(F.col(c).isNotNull()).select(F.col("doc_id").alias("id"), F.lit(c).alias("field"), F.col(c).alias("value"))
    return one("source").unionByName(one("lang")).unionByName(one("text"))


@query(
    "j01_field_candidates",
    f"WITH {_FIELD_ROWS} SELECT DISTINCT id FROM f WHERE field IN ('source', 'text') AND contains(lower(value), 'licensed')",
)
def field_candidates(spark, d):
    """Records that hold a form in one of the fields asked for."""
    return _field_rows(spark, d).filter(F.col("field").isin("source", "text") & F.lower("value").contains("licensed")).select("id").distinct()


@query(
    "j02_short_token_candidates",
    f"WITH {_FIELD_ROWS} SELECT DISTINCT id FROM f WHERE field IN ('lang') AND list_contains(regexp_split_to_array(lower(value), "
    f"'[^a-z0-9]+'), 'en')",
)
def short_token_candidates(spark, d):
    """Short forms match whole tokens only."""
    return _field_rows(spark, d).filter((F.col("field") == "lang") & F.array_contains(F.split(F.lower("value"), "[^a-z0-9]+"), "en")).select("id").distinct()


@query(
    "u03_field_names",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE array_to_string(list_sort(list_distinct([o_orderstatus, "
    "o_orderpriority, 'F'])), ',') END AS names FROM orders",
)
def field_names(spark, d):
    """The union of two lists of field names; where either asks for all, all."""
    a = F.when(F.col("o_orderkey") % 5 != 0, F.array("o_orderstatus", "o_orderpriority"))
    both = F.array_union(a, F.array(F.lit("F")))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.array_sort(both), ",").alias("names"))


_MD = "(SELECT doc_id, 'intro' || chr(10) || '# One' || chr(10) || source || chr(10) || '## Two' || chr(10) || lang || chr(10) || '# Three' || chr(10) || 'end' AS text FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)"


@query(
    "p26_without_sections",
    f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'intro' || chr(10) || '# Three' || chr(10) || 'end' WHEN 1 THEN replace(text, "
    f"'intro' || chr(10), '') ELSE text END AS text FROM {_MD}",
)
def without_sections(spark, d):
    """Sections go by their number."""
    docs = table(spark, d, "documents").filter("source IS NOT NULL AND lang IS NOT NULL").select("doc_id", F.concat(F.lit("intro\n# One\n"), "source", F.lit("\n## Two\n"), "lang", F.lit("\n# Three\nend")).alias("text"))
    drop = docs.filter("doc_id % 4 < 2").select("doc_id", F.explode(F.when(F.col("doc_id") % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))).alias("section"))
    return curation.without_sections(docs, "doc_id", drop)


@query(
    "p27_privacy_levels",
    "SELECT conv_id, turn, level, CASE level WHEN 'full' THEN text WHEN 'standard' THEN substr(text, 1, 20) || CASE WHEN "
    "length(text) > 20 THEN '…' ELSE '' END ELSE NULL END AS shown, length(text)::INT AS chars FROM conversations, "
    "unnest(['minimal', 'standard', 'full']) AS u(level)",
)
def privacy_levels(spark, d):
    """What each level keeps of a message: nothing but its length, its beginning, all of it."""
    rows = table(spark, d, "conversations").withColumn("level", F.explode(F.array(*map(F.lit, ("minimal", "standard", "full")))))
    cut = F.when(F.length("text") > 20, F.concat(F.substring("text", 1, 20), F.lit("…"))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", "level", F.when(F.col("level") == "full", F.col("text")).when(F.col("level") == "standard", cut).alias("shown"), F.length("text").alias("chars"))


@query(
    "p30_without_reasoning",
    "SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN NULL ELSE 'thought ' || turn END AS reasoning FROM "
    "conversations",
)
def without_reasoning(spark, d):
    """An assistant's reasoning doesn't go into the next turn."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.concat(F.lit("thought "), F.col("turn")).alias("reasoning"))
    return rows.withColumn("reasoning", F.when(F.col("role") != "assistant", F.col("reasoning")))


@query(
    "p33_picked_by_place",
    "SELECT source AS file FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL ORDER BY source LIMIT 3) ORDER BY "
    "source DESC LIMIT 1",
)
def picked_by_place(spark, d):
    files = table(spark, d, "documents").filter("source IS NOT NULL").select(F.col("source").alias("file")).distinct()
    return curation.picked(files, "3")


@query("p33_picked_by_name", "SELECT min(source) AS file FROM documents WHERE contains(source, 'rc1')")
def picked_by_name(spark, d):
    """No file has this very name, so the first that holds it counts."""
    files = table(spark, d, "documents").filter("source IS NOT NULL").select(F.col("source").alias("file")).distinct()
    return curation.picked(files, "rc1")


@query("p34_aliases", "SELECT s_suppkey, 'S' || (s_suppkey % 3) AS model FROM supplier WHERE s_suppkey % 3 < 2")
def aliases(spark, d):
    """Names meet their models by a normal form: letters and digits only, lower case."""
    normal = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    asked = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit(" Model-"), F.col("s_suppkey") % 3, F.lit("_x ")).alias("name"))
    known = spark.createDataFrame([("model 0 X", "S0"), ("MODEL_1-x", "S1")], "alias string, model string")
    return asked.join(F.broadcast(known.select(normal("alias").alias("k"), "model")), normal(F.col("name")) == F.col("k")).select("s_suppkey", "model")


@query(
    "p35_known_fields",
    "SELECT p_partkey, array_to_string(list_filter(['Gene_Name', p_brand, 'Primary_Product'], lambda x: x IN ('Primary_Product', "
    "'Gene_Name', 'Brand#2')), ',') AS fields FROM part",
)
def known_fields(spark, d):
    """Of the fields asked for those that a schema has, in the order asked."""
    asked = F.array(F.lit("Gene_Name"), "p_brand", F.lit("Primary_Product"))
    schema = F.array(*map(F.lit, ("Primary_Product", "Gene_Name", "Brand#2")))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.filter(asked, lambda x: F.array_contains(schema, x)), ",").alias("fields"))


@query("f36_repaired_json", """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE event_id END AS a, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 END::INT AS n FROM events""")
def repaired_json(spark, d):
    """Whole JSON, JSON that was cut off inside its second element, and JSON without any closed part."""
    n = F.col("event_id").cast("string")
    whole = F.concat(F.lit('{"a": '), n, F.lit(', "b": [{"x": 1}, {"x": 2}]}'))
    cut = F.concat(F.lit('{"a": '), n, F.lit(', "b": [{"x": 1}, {"x": '))
    t = F.when(F.col("event_id") % 3 == 0, whole).when(F.col("event_id") % 3 == 1, cut).otherwise('{"a": [1, ')
    rows = table(spark, d, "events").select("event_id", t.alias("t")).select("event_id", curation.repaired_json("t", "a LONG, b ARRAY<STRUCT<x: INT>>").alias("j"))
    return rows.select("event_id", "j.a", F.when(F.col("j").isNotNull(), F.size("j.b")).alias("n"))


@query(
    "f37_gene_names",
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_type WHEN 3 THEN 'last' ELSE '' END AS name "
    "FROM part",
)
def gene_names(spark, d):
    """A record's name by the first of four fields that has one."""
    n = F.col("p_partkey") % 5
    fields = {"Gene_Name": F.when(n == 0, F.col("p_name")).otherwise(""), "gene": F.when(n == 1, F.col("p_brand")), "gene_name": F.when(n <= 2, F.col("p_type")), "name": F.when(n < 4, "last"), "Gene": F.lit("no name")}
    record = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    return table(spark, d, "part").select("p_partkey", record.alias("r")).select("p_partkey", curation.gene_name("r").alias("name"))


@query(
    "f38_folder_names",
    "SELECT doc_id, 'Nat-' || coalesce(source, 'x') || '-2008' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '-a' END AS folder FROM "
    "documents",
)
def folder_names(spark, d):
    stem = F.concat(F.lit("MinerU_markdown_Nat_"), F.coalesce("source", F.lit("x")), F.lit("_2008"), F.when(F.col("doc_id") % 2 == 0, "_(1)").otherwise("_a"))
    return table(spark, d, "documents").select("doc_id", T.folder_name(stem).alias("folder"))


@query(
    "f42_blocks",
    "SELECT doc_id, i::INT AS place, substr(text, i * 1800 + 1, 1800) AS block FROM documents, unnest(range(least(100, "
    "(length(text) + 1799) // 1800))) AS u(i) WHERE text <> ''",
)
def blocks(spark, d):
    """Texts in blocks of 1,800 characters, the first hundred of them, as their sink takes no more."""
    return T.blocks(table(spark, d, "documents").filter("text <> ''"), "doc_id", "text")


@query(
    "f04_values",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_name || '; ' || p_brand WHEN 2 THEN p_type ELSE '' END AS "
    "told FROM part",
)
def values(spark, d):
    """A value as text: placeholders are empty, lists are joined without theirs."""
    n = F.col("p_partkey") % 4
    value = F.when(n == 0, F.array(F.lit("N/A"))).when(n == 1, F.array("p_name", F.lit("unknown"), "p_brand")).when(n == 2, F.array("p_type"))
    return table(spark, d, "part").select("p_partkey", T.value_text(value).alias("told"))


@query(
    "t18_sample",
    f"WITH {EDGES}, g AS (SELECT 'S' || s_suppkey AS id FROM supplier ORDER BY md5('7:S' || s_suppkey), id LIMIT 50), s AS (SELECT id FROM g UNION SELECT dst FROM e JOIN g ON src = id "
    "UNION SELECT src FROM e JOIN g ON dst = id) SELECT src, dst, relation FROM e WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)",
)
def sample(spark, d):
    """Fifty suppliers by the hash of their id, the same ones at every run, with all that is one step away, and the edges among these."""
    genes = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"))
    return graph.sample(genes, edges(spark, d), 50, 7)


@query(
    "p13_duplicate_labels",
    "SELECT p_partkey, '── T ──' || chr(10) || 'Name: ' || CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS lines FROM "
    "part",
)
def duplicate_labels(spark, d):
    """Two fields with one label: the first that is filled counts."""
    gene = F.create_map(F.lit("a"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("NA"), F.lit("b"), F.col("p_brand"))
    rows = table(spark, d, "part").select("p_partkey", gene.alias("g"))
    return rows.select("p_partkey", F.array_join(chunking.section(F.col("g"), ("a", "b"), "T", {"a": "Name", "b": "Name"}), "\n").alias("lines"))


@query(
    "s26_target_rows",
    "SELECT l_orderkey, l_linenumber, l_partkey::VARCHAR AS first, l_quantity::INT::VARCHAR AS last FROM lineitem WHERE "
    "l_linenumber % 2 = 0",
)
def target_rows(spark, d):
    """Table rows of six cells or more; others, such as heads, go."""
    cell = lambda c: F.concat(F.lit("<td class=x> "), c.cast("string"), F.lit(" </td>"))
    n = F.when(F.col("l_linenumber") % 2 == 0, F.concat(*[cell(F.lit(i)) for i in range(4)])).otherwise("<td>few</td>")
    html = F.concat(F.lit("<table><tr><th>a</th></tr>\n<tr>"), cell(F.col("l_partkey")), n, cell(F.concat(F.lit("<b>"), F.col("l_quantity").cast("int"), F.lit("</b>"))), F.lit("</tr></table>"))
    rows = tables.html_rows(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", html.alias("html")), "html", 6)
    return rows.select("l_orderkey", "l_linenumber", F.col("cells")[0].alias("first"), F.element_at("cells", -1).alias("last"))


@query(
    "s13_abstracts",
    "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'AIM: first' || chr(10) || 'rest of ' || doc_id WHEN 1 THEN 'only ' || doc_id "
    "ELSE '(no abstract)' END AS abstract, 'T' || doc_id AS title FROM documents",
)
def abstracts(spark, d):
    """Literature records as XML: labelled parts are joined by line feeds."""
    n, i = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    text = F.when(n == 0, F.concat(F.lit('<AbstractText Label="AIM">first</AbstractText><AbstractText>rest of '), i, F.lit("</AbstractText>"))).when(n == 1, F.concat(F.lit("<AbstractText>only "), i, F.lit("</AbstractText>"))).otherwise("")
    xml = F.concat(F.lit("<Article><ArticleTitle>T"), i, F.lit("</ArticleTitle><Abstract>"), text, F.lit("</Abstract></Article>"))
    return tables.articles(table(spark, d, "documents").select("doc_id", xml.alias("xml")), "xml").select("doc_id", "abstract", "title")
