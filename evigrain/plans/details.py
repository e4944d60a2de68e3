"""Queries over smaller functions: counts, clamps, budgets, identifiers, sets in arrays."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evigrain.functions import text as T
from evigrain.operators import evaluation
from evigrain.plans.registry import query, table


@query(
    "f06_token_count",
    r"SELECT doc_id, len(regexp_extract_all(regexp_replace(' ' || text || ' ', '([^\p{L}\p{M}\p{Nd}\p{Pc}.-])', '\1\1', 'g'), "
    r"'[^\p{L}\p{M}\p{Nd}\p{Pc}.-]of[^\p{L}\p{M}\p{Nd}\p{Pc}.-]'))::INT AS n FROM documents",
)
def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_count(F.col("text"), "of").alias("n"))


@query("a08_discount", "SELECT l_orderkey, l_linenumber, l_quantity, round((1 - pow(0.5, least(l_quantity, 8))) / 0.5, 6) AS weight FROM lineitem")
def discount(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.round(T.discounted(F.col("l_quantity"), 0.5), 6).alias("weight"))


@query("a22_clamped_total", "SELECT l_orderkey, round(sum(greatest(0, least(l_quantity, 30))), 4) AS points FROM lineitem GROUP BY l_orderkey")
def clamped_total(spark, d):
    points = F.greatest(F.lit(0.0), F.least("l_quantity", F.lit(30.0)))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(points), 4).alias("points"))


@query("a26_disk_need", "SELECT source, (sum(n_chars) + 2 * max(n_chars) + 1024)::BIGINT AS need FROM documents GROUP BY source")
def disk_need(spark, d):
    """A generation, twice its largest part, and a margin."""
    return table(spark, d, "documents").groupBy("source").agg((F.sum("n_chars") + 2 * F.max("n_chars") + 1024).alias("need"))


@query(
    "a28_tools_used",
    "SELECT user_id, array_to_string(list(event_type ORDER BY first), ',') AS tools FROM (SELECT user_id, event_type, "
    "min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id",
)
def tools_used(spark, d):
    """Distinct kinds in the order of their first event."""
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    ordered = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("x"))
    return ordered.select("user_id", F.array_join(F.transform("x", lambda x: x["event_type"]), ",").alias("tools"))


@query(
    "a30_budget",
    "SELECT user_id, event_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS used FROM events) WHERE "
    "used * 10 <= 400",
)
def budget(spark, d):
    """Events while a user's running sum of ten an event stays within 400."""
    used = F.sum(F.lit(10)).over(W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0))
    return table(spark, d, "events").withColumn("used", used).filter("used <= 400").select("user_id", "event_id")


@query("f39_file_name", r"SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM pages")
def file_name(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"[^A-Za-z0-9._-]+", "_").alias("name"))


@query("f41_points", r"SELECT event_id, regexp_extract(props, '\d+') AS points FROM events")
def points(spark, d):
    return table(spark, d, "events").select("event_id", F.regexp_extract("props", r"\d+", 0).alias("points"))


@query("f47_control_free", r"SELECT page_id, regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS plain FROM pages")
def control_free(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace("html", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "").alias("plain"))


@query("f40_times", "SELECT event_id, ts AS parsed FROM events")
def times(spark, d):
    rows = table(spark, d, "events").withColumn("t", F.col("ts").cast("string"))
    return rows.select("event_id", evaluation.parsed_time("t").cast("timestamp_ntz").alias("parsed"))


@query("m03_digests", "SELECT doc_id, sha256(text) AS digest FROM documents")
def digests(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(
    "u05_same_sets",
    "SELECT a.user_id AS a, b.user_id AS b FROM (SELECT user_id, list_sort(list(DISTINCT event_type)) AS k FROM events GROUP BY "
    "1) a JOIN (SELECT user_id, list_sort(list(DISTINCT event_type)) AS k FROM events GROUP BY 1) b ON a.k = b.k AND b.user_id = "
    "a.user_id + 1",
)
def same_sets(spark, d):
    """Neighbouring users with the same set of event kinds."""
    kinds = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("k"))
    a, b = kinds.select(F.col("user_id").alias("a"), F.col("k").alias("ka")), kinds.select(F.col("user_id").alias("b"), F.col("k").alias("kb"))
    return a.join(b, (F.col("a") + 1 == F.col("b")) & (F.col("ka") == F.col("kb"))).select("a", "b")


@query(
    "u06_except_or_all",
    "SELECT l_orderkey, l_linenumber, array_to_string(CASE WHEN len(rest) = 0 THEN list_sort(list_distinct(e)) ELSE "
    "list_sort(list_distinct(rest)) END, ',') AS left_over FROM (SELECT l_orderkey, l_linenumber, e, list_filter(e, lambda x: x "
    "NOT IN ('A', 'O')) AS rest FROM (SELECT l_orderkey, l_linenumber, [l_returnflag, l_linestatus] AS e FROM lineitem))",
)
def except_or_all(spark, d):
    """The entities without the targets, or all of them if none is left."""
    entities, targets = F.array("l_returnflag", "l_linestatus"), F.array(F.lit("A"), F.lit("O"))
    rest = F.array_except(entities, targets)
    left = F.when(F.size(rest) == 0, F.array_distinct(entities)).otherwise(rest)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.array_sort(left), ",").alias("left_over"))


@query(
    "p22_species",
    "SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(n_name), 'nation_1') OR "
    "contains('nation_1', lower(n_name))",
)
def species(spark, d):
    """A filter either way: the wanted name contains the row's, or the other way round."""
    n = F.lower("n_name")
    near = n.contains("nation_1") | F.lit("nation_1").contains(n)
    s = table(spark, d, "supplier")
    return s.join(table(spark, d, "nation").filter(near), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey")


@query("p27_redacted", "SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN sha256(text) ELSE text END AS shown FROM conversations")
def redacted(spark, d):
    """What users wrote leaves as a digest."""
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.when(F.col("role") == "user", F.sha2("text", 256)).otherwise(F.col("text")).alias("shown"))


@query("t08_seed_order", "SELECT n_nationkey, n_name FROM nation ORDER BY n_regionkey = 0 DESC, n_nationkey LIMIT 12")
def seed_order(spark, d):
    return table(spark, d, "nation").orderBy(F.desc(F.col("n_regionkey") == 0), "n_nationkey").limit(12).select("n_nationkey", "n_name")


@query("t10_fuzzy_order", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'e') ORDER BY length(p_name), p_name, p_partkey LIMIT 20")
def fuzzy_order(spark, d):
    rows = table(spark, d, "part").filter(F.lower("p_name").contains("e"))
    return rows.orderBy(F.length("p_name"), "p_name", "p_partkey").limit(20).select("p_partkey", "p_name")


@query(
    "w10_adjacent",
    "SELECT user_id, count(*)::BIGINT AS runs FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER "
    "BY event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type GROUP BY user_id",
)
def adjacent(spark, d):
    """How many runs of equal events a user has."""
    before = F.lag("event_type").over(W.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, d, "events").select("user_id", "event_type", before.alias("before"))
    return rows.filter("before IS NULL OR before <> event_type").groupBy("user_id").agg(F.count("*").alias("runs"))
