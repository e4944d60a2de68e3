"""Queries over evaluation, interactions, curation, sets and event folds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evigrain.operators import curation, evaluation, interactions
from evigrain.plans.registry import query, table
from evigrain.streaming import folds

RESULTS = """r AS (SELECT event_id AS question, 'a' || (user_id % 5) AS agent, 'v1' AS version, CASE WHEN event_type = 'view' THEN 0.0::DOUBLE ELSE floor(value) END AS score, 100.0::DOUBLE AS max_score,
CASE WHEN event_type = 'error' THEN 'judge_error' ELSE '' END AS status, CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'timeout' ELSE '' END AS error, '' AS detail, ts FROM events)"""
FAILED = "CASE WHEN status <> '' THEN status WHEN error <> '' THEN 'runner_error' END"
STATS = """count(*)::BIGINT AS total, count(*) FILTER (f IS NULL)::BIGINT AS valid, count(*) FILTER (f IS NOT NULL)::BIGINT AS failed,
printf('%.2f%%', count(*) FILTER (f IS NULL) / count(*) * 100) AS success_rate, round(sum(score) FILTER (f IS NULL), 2) AS score, round(sum(max_score) FILTER (f IS NULL), 2) AS max_score,
round(avg(score) FILTER (f IS NULL), 2) AS mean_score, printf('%.2f%%', sum(score) FILTER (f IS NULL) / sum(max_score) FILTER (f IS NULL) * 100) AS score_rate"""


def results(spark, d):
    """Events as evaluation results: errors are failed judgements, some sign-ups failed runs, views real zeros."""
    e = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("event_id").alias("question"),
        F.concat(F.lit("a"), (F.col("user_id") % 5).cast("string")).alias("agent"),
        F.lit("v1").alias("version"),
        F.when(e == "view", 0.0).otherwise(F.floor("value").cast("double")).alias("score"),
        F.lit(100.0).alias("max_score"),
        F.when(e == "error", "judge_error").otherwise("").alias("status"),
        F.when((e == "signup") & (F.col("event_id") % 3 == 0), "timeout").otherwise("").alias("error"),
        F.lit("").alias("detail"),
        "ts",
    )


@query(
    "p18_selected",
    f"WITH {RESULTS} SELECT question, agent FROM r WHERE agent = 'a2' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP "
    f"'2024-01-20' AND question BETWEEN 100 AND 900000",
)
def selected(spark, d):
    return evaluation.selected(results(spark, d), agent="a2", after="2024-01-05", before="2024-01-20", least=100, most=900000).select("question", "agent")


@query("p19_failures", f"WITH {RESULTS} SELECT question, {FAILED} AS failure FROM r")
def failures(spark, d):
    return results(spark, d).select("question", evaluation.failure_type().alias("failure"))


@query("a14_statistics", f"WITH {RESULTS}, x AS (SELECT *, {FAILED} AS f FROM r) SELECT agent, {STATS} FROM x GROUP BY agent")
def statistics(spark, d):
    return evaluation.statistics(results(spark, d), "agent")


@query("a15_failure_counts", f"WITH {RESULTS} SELECT {FAILED} AS failure, count(*)::BIGINT AS n FROM r WHERE {FAILED} IS NOT NULL GROUP BY 1")
def failure_counts(spark, d):
    return results(spark, d).withColumn("failure", evaluation.failure_type()).filter("failure IS NOT NULL").groupBy("failure").agg(F.count("*").alias("n"))


@query(
    "w07_latest",
    f"WITH {RESULTS} SELECT agent, question % 100 AS question, arg_max(score, {{'t': ts, 'q': question}}) AS score FROM r GROUP BY "
    f"1, 2",
)
def latest(spark, d):
    rows = results(spark, d).withColumn("at", F.col("question")).withColumn("question", F.col("question") % 100)
    return evaluation.latest(rows, ["agent", "question"], F.col("ts"), F.col("at")).select("agent", "question", "score")


@query(
    "x09_filtered_statistics",
    f"WITH {RESULTS}, l AS (SELECT agent, question % 100 AS question, arg_max({{'score': score, 'm': max_score, 'f': {FAILED}}}, "
    f"{{'t': ts, 'q': question}}) AS s FROM r WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2), x AS (SELECT agent, s.score AS "
    f"score, s.m AS max_score, s.f AS f FROM l) SELECT agent, {STATS} FROM x GROUP BY agent",
)
def filtered_statistics(spark, d):
    rows = evaluation.selected(results(spark, d), before="2024-01-15").withColumn("at", F.col("question")).withColumn("question", F.col("question") % 100)
    return evaluation.statistics(evaluation.latest(rows, ["agent", "question"], F.col("ts"), F.col("at")), "agent")


@query(
    "j10_remaining",
    f"WITH {RESULTS} SELECT doc_id AS question FROM documents WHERE doc_id NOT IN (SELECT question FROM r WHERE {FAILED} IS NULL)",
)
def remaining(spark, d):
    questions = table(spark, d, "documents").select(F.col("doc_id").alias("question"))
    return evaluation.remaining(questions, results(spark, d), retry_failed=True)


@query(
    "a18_rollup",
    "SELECT event_type AS stage, user_id, count(*)::BIGINT AS calls, sum(floor(value)::BIGINT)::BIGINT AS tokens FROM events "
    "GROUP BY ROLLUP (event_type, user_id)",
)
def rollup(spark, d):
    return table(spark, d, "events").rollup(F.col("event_type").alias("stage"), "user_id").agg(F.count("*").alias("calls"), F.sum(F.floor("value")).alias("tokens"))


_V = "v AS (SELECT l.doc_id, d.lang AS gene, CASE WHEN quality = 1 THEN 'SUPPORTED' WHEN toxic = 1 THEN 'UNSUPPORTED' ELSE 'UNCERTAIN' END AS verdict FROM labels l JOIN documents d USING (doc_id))"


@query(
    "a19_verdicts",
    f"WITH {_V} SELECT gene, count(*)::BIGINT AS total, count(*) FILTER (verdict = 'SUPPORTED')::BIGINT AS supported, count(*) "
    f"FILTER (verdict = 'UNSUPPORTED')::BIGINT AS unsupported, count(*) FILTER (verdict = 'UNCERTAIN')::BIGINT AS uncertain, "
    f"round(count(*) FILTER (verdict = 'SUPPORTED') / count(*), 6) AS fidelity FROM v GROUP BY gene",
)
def verdicts(spark, d):
    verdict = F.when(F.col("quality") == 1, "SUPPORTED").when(F.col("toxic") == 1, "UNSUPPORTED").otherwise("UNCERTAIN")
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("gene"))
    return curation.verdict_counts(table(spark, d, "labels").join(docs, "doc_id").withColumn("verdict", verdict), "gene")


@query(
    "a25_coalesced_jobs",
    "SELECT user_id AS target, bool_or(event_type = 'error') AS force, array_to_string(list_sort(list(DISTINCT event_type)), ',') "
    "AS reasons, count(*)::BIGINT AS jobs FROM events GROUP BY user_id",
)
def coalesced_jobs(spark, d):
    jobs = table(spark, d, "events").select(F.col("user_id").alias("target"), (F.col("event_type") == "error").alias("force"), F.col("event_type").alias("reason"))
    return folds.coalesced_jobs(jobs).withColumn("reasons", F.array_join("reasons", ","))


@query(
    "st2_event_fold",
    "SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*)::BIGINT AS n, round(sum(value), 4) AS value, "
    "array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY 1, 2",
)
def event_fold(spark, d):
    return folds.folded_events(table(spark, d, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("value", 4).alias("value"), F.array_join("kinds", ",").alias("kinds"))


@query("w14_event_index", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS at FROM events".replace(" AS at ", ' AS "at" '))
def event_index(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", "user_id", (F.row_number().over(w) - 1).cast("long").alias("at"))


@query(
    "w12_batches",
    "SELECT o_custkey, o_orderkey, CASE WHEN t < 12 THEN 0 ELSE floor(p / ceil(t / (t // 12 + 1))) END::BIGINT AS batch FROM "
    "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p, count(*) OVER (PARTITION BY o_custkey) "
    "AS t FROM orders)",
)
def batches(spark, d):
    w = W.partitionBy("o_custkey")
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(w.orderBy("o_orderkey")) - 1).alias("p"), F.count("*").over(w).alias("t"))
    return rows.select("o_custkey", "o_orderkey", curation.batch_of(F.col("p"), F.col("t")).alias("batch"))


@query(
    "w08_recommended",
    "WITH p AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, "
    "l_suppkey, l_quantity) AS n, l_returnflag = 'R' AS x FROM lineitem), f AS (SELECT l_orderkey, min(n) AS first FROM p WHERE x "
    "GROUP BY 1) SELECT l_orderkey, l_linenumber, coalesce(n = first, false) AS recommended FROM p LEFT JOIN f USING (l_orderkey) "
    "WHERE first IS NULL OR n <= first + 1",
)
def recommended(spark, d):
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("place")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", place, F.when(F.col("l_returnflag") == "R", "exon").otherwise("intron").alias("kind"))
    return curation.recommended(rows, "l_orderkey", "place", extra=1).drop("kind", "place")


TALK = """m AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS m FROM conversations GROUP BY conv_id),
i AS (SELECT conv_id AS interaction_id, CASE WHEN m[len(m)].role = 'assistant' THEN 'completed' ELSE 'open' END AS status, list_filter(m, lambda x: x.role = 'user')[1].text AS query,
list_filter(m, lambda x: x.role = 'assistant')[len(list_filter(m, lambda x: x.role = 'assistant'))].text AS answer, list_filter(m, lambda x: x.role <> 'assistant') AS msgs FROM m),
fb AS (SELECT doc_id AS interaction_id, CASE WHEN quality = 1 THEN 'up' ELSE 'down' END AS rating FROM labels)"""


AGAIN_SQL = """again AS (SELECT * FROM i UNION ALL SELECT -1 - interaction_id, status, ' ' || query, answer, msgs FROM i),
fb2 AS (SELECT * FROM fb UNION ALL SELECT -1 - interaction_id, CASE rating WHEN 'up' THEN 'down' ELSE 'up' END FROM fb)"""


def _talk(spark, d):
    """Conversations with the documents' labels of the same number as feedback."""
    feedback = table(spark, d, "labels").select(F.col("doc_id").alias("interaction_id"), F.when(F.col("quality") == 1, "up").otherwise("down").alias("rating"), F.lit(0).alias("at"))
    return interactions.with_feedback(interactions.folded(table(spark, d, "conversations")), feedback)


@query("j07_feedback", f"WITH {TALK} SELECT interaction_id, status, query, answer, rating FROM i LEFT JOIN fb USING (interaction_id)")
def feedback(spark, d):
    return _talk(spark, d).select("interaction_id", "status", "query", "answer", "rating")


@query(
    "x10_training_rows",
    f"WITH {TALK} SELECT interaction_id, coalesce(rating, '') AS feedback, (len(msgs) + 1)::INT AS n_messages, "
    f"array_to_string(list_transform(msgs, lambda x: x.role || ':' || x.text), '|') || '|assistant:' || answer AS flat FROM i LEFT "
    f"JOIN fb USING (interaction_id) WHERE status = 'completed' AND answer <> '' AND len(msgs) > 0",
)
def training_rows(spark, d):
    rows = interactions.training_rows(_talk(spark, d))
    return rows.select("interaction_id", "feedback", F.size("messages").alias("n_messages"), F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "|").alias("flat"))


ASKED = """i AS (SELECT o_orderkey AS interaction_id, 'completed' AS status, ' Orders of ' || o_custkey || ' ' AS query, o_orderpriority AS answer, CASE o_orderstatus WHEN 'F' THEN 'up' WHEN 'O' THEN 'down' END AS rating FROM orders)"""


@query(
    "x11_preferences",
    f"WITH {ASKED} SELECT lower(trim(u.query)) AS query, u.interaction_id AS chosen_id, w.interaction_id AS rejected_id FROM i u "
    f"JOIN i w ON u.query = w.query AND u.rating = 'up' AND w.rating = 'down'",
)
def preferences(spark, d):
    """Orders as answers to what their customer asks again and again: those that are done, rated up, and open ones, rated down."""
    rating = F.when(F.col("o_orderstatus") == "F", "up").when(F.col("o_orderstatus") == "O", "down")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("interaction_id"), F.lit("completed").alias("status"), F.concat(F.lit(" Orders of "), F.col("o_custkey"), F.lit(" ")).alias("query"), F.col("o_orderpriority").alias("answer"), rating.alias("rating"))
    return interactions.preference_pairs(rows).select("query", "chosen_id", "rejected_id")


@query(
    "x11_same_query",
    f"WITH {TALK}, a AS (SELECT *, lower(trim(query)) AS k FROM i JOIN fb USING (interaction_id) WHERE status = 'completed' AND "
    f"answer <> '') SELECT u.k AS query, u.interaction_id AS chosen_id, w.interaction_id AS rejected_id FROM a u JOIN a w ON u.k = "
    f"w.k AND u.rating = 'up' AND w.rating = 'down' WHERE u.k <> ''",
)
def same_query(spark, d):
    """Answers rated up and down for the same whole query; none where no query repeats."""
    return interactions.preference_pairs(_talk(spark, d)).select("query", "chosen_id", "rejected_id")


@query(
    "x11_held_again",
    f"WITH {TALK}, {AGAIN_SQL}, a AS (SELECT *, lower(trim(query)) AS k FROM again JOIN fb2 USING (interaction_id) WHERE status = 'completed' AND "
    f"answer <> '') SELECT u.k AS query, u.interaction_id AS chosen_id, w.interaction_id AS rejected_id FROM a u JOIN a w ON u.k = "
    f"w.k AND u.rating = 'up' AND w.rating = 'down' WHERE u.k <> ''",
)
def held_again(spark, d):
    """Answers rated up and down for the same whole query: each conversation is held again, with the other rating."""
    talk = _talk(spark, d)
    other = F.when(F.col("rating") == "up", "down").when(F.col("rating") == "down", "up")
    again = talk.withColumns({"interaction_id": -1 - F.col("interaction_id"), "query": F.concat(F.lit(" "), "query"), "rating": other})
    return interactions.preference_pairs(talk.unionByName(again)).select("query", "chosen_id", "rejected_id")


@query("u01_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("u02_intersect", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08")
def intersect(spark, d):
    items = table(spark, d, "lineitem")
    return items.filter("l_quantity > 45").select(F.col("l_partkey").alias("k")).intersect(items.filter("l_discount > 0.08").select("l_partkey"))


@query("u07_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query(
    "j19_manifest_diff",
    "SELECT coalesce(f.doc_id, m.doc_id)::VARCHAR AS file, CASE WHEN f.doc_id IS NULL THEN 'drop' WHEN m.doc_id IS NOT NULL AND "
    "m.doc_id % 3 <> 0 THEN 'keep' ELSE 'rebuild' END AS action FROM (SELECT doc_id FROM labels) m FULL OUTER JOIN (SELECT doc_id "
    "FROM documents WHERE lang <> 'fr') f ON m.doc_id = f.doc_id",
)
def manifest_diff(spark, d):
    """The labelled documents were indexed; of those every third has changed, and French ones are gone."""
    name = F.col("doc_id").cast("string").alias("file")
    old = table(spark, d, "labels").select(name, F.lit("x").alias("sha"), F.lit("2").alias("chunker_version"))
    new = table(spark, d, "documents").filter("lang <> 'fr'").select(name, F.when(F.col("doc_id") % 3 == 0, "y").otherwise("x").alias("sha"))
    return curation.manifest_diff(old, new, "2")


@query(
    "w11_cursors",
    "SELECT source AS file, (sum(n) OVER (ORDER BY source))::BIGINT AS \"end\", (sum(n) OVER (ORDER BY source) - n)::BIGINT AS "
    "start FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)",
)
def cursors(spark, d):
    return curation.cursors(table(spark, d, "documents").groupBy(F.col("source").alias("file")).agg(F.count("*").alias("n_chunks"))).select("file", "start", "end")


@query(
    "a21_source_counts",
    "SELECT r_name AS source, count(n_nationkey) FILTER (n_name LIKE '%1%')::BIGINT AS n FROM region LEFT JOIN nation ON "
    "r_regionkey = n_regionkey GROUP BY r_name",
)
def source_counts(spark, d):
    """Every configured source has a row, with 0 if it found nothing."""
    found = table(spark, d, "nation").filter("n_name LIKE '%1%'").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    r = table(spark, d, "region")
    return r.join(found, r.r_regionkey == found.n_regionkey, "left").select(F.col("r_name").alias("source"), F.coalesce("n", F.lit(0)).alias("n"))
