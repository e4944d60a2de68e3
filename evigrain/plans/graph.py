"""Queries over the graph of regions, nations, suppliers, customers and the orders between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrain.operators import graph
from evigrain.plans.registry import query, table

EDGES = """e AS (SELECT 'S' || s_suppkey AS src, 'N' || s_nationkey AS dst, 'BASED_IN' AS relation FROM supplier
UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'LIVES_IN' FROM customer
UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'PART_OF' FROM nation)"""
WAYS = "w AS (SELECT src AS here, dst AS node, relation, src, dst FROM e UNION ALL SELECT dst, src, relation, src, dst FROM e)"


def _id(letter: str, column: str):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def edges(spark, d):
    s, c, n = (table(spark, d, t) for t in ("supplier", "customer", "nation"))
    based = s.select(_id("S", "s_suppkey").alias("src"), _id("N", "s_nationkey").alias("dst"), F.lit("BASED_IN").alias("relation"))
    lives = c.select(_id("C", "c_custkey").alias("src"), _id("N", "c_nationkey").alias("dst"), F.lit("LIVES_IN").alias("relation"))
    part = n.select(_id("N", "n_nationkey").alias("src"), _id("R", "n_regionkey").alias("dst"), F.lit("PART_OF").alias("relation"))
    return based.unionByName(lives).unionByName(part)


@query("g01_edges", f"WITH {EDGES} SELECT * FROM e")
def all_edges(spark, d):
    return edges(spark, d)


@query(
    "a09_merged_edges",
    "SELECT o_custkey AS src, l_suppkey AS dst, 'BOUGHT_FROM' AS relation, count(*)::BIGINT AS evidence_count, "
    "array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS sections FROM orders JOIN lineitem ON o_orderkey = "
    "l_orderkey GROUP BY 1, 2",
)
def merged_edges(spark, d):
    """Each order line is a piece of evidence that a customer bought from a supplier."""
    o, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    rows = o.join(items, o.o_orderkey == items.l_orderkey).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("BOUGHT_FROM").alias("relation"), F.col("l_returnflag").alias("section"), F.lit("").alias("value"), F.col("l_orderkey").alias("ord"))
    return graph.merged_edges(rows).select("src", "dst", "relation", "evidence_count", F.array_join("sections", ",").alias("sections"))


@query("a10_merged_nodes", "SELECT lower(p_brand) AS id, arg_min(p_name, p_partkey) AS name FROM part GROUP BY 1")
def merged_nodes(spark, d):
    rows = table(spark, d, "part").select(F.lower("p_brand").alias("id"), F.lit("Brand").alias("type"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return graph.merged_nodes(rows).select("id", "name")


@query(
    "j12_neighbourhood",
    f"WITH {EDGES}, {WAYS}, h1 AS (SELECT * FROM w WHERE here IN ('N0', 'N7')), f AS (SELECT DISTINCT node FROM h1 WHERE node NOT "
    f"IN ('N0', 'N7')), h2 AS (SELECT w.* FROM w JOIN f ON w.here = f.node) SELECT src, dst, relation, min(hop)::INT AS hop FROM "
    f"(SELECT src, dst, relation, 1 AS hop FROM h1 UNION ALL SELECT src, dst, relation, 2 FROM h2) GROUP BY ALL",
)
def neighbourhood(spark, d):
    seeds = spark.createDataFrame([("N0",), ("N7",)], "id string")
    return graph.neighbourhood(seeds, edges(spark, d), 2)


@query(
    "j15_downstream",
    f"WITH {EDGES} SELECT a.src, a.dst, a.relation, 1 AS hop FROM e a WHERE a.src = 'S1' UNION ALL SELECT DISTINCT b.src, b.dst, "
    f"b.relation, 2 FROM e a JOIN e b ON a.dst = b.src WHERE a.src = 'S1'",
)
def downstream(spark, d):
    return graph.neighbourhood(spark.createDataFrame([("S1",)], "id string"), edges(spark, d), 2, "downstream")


@query(
    "j14_paths",
    f"WITH {EDGES}, {WAYS} SELECT array_to_string([a.here, a.node, b.node, c.node, g.node], '>') AS path, 4 AS length FROM w a "
    f"JOIN w b ON a.node = b.here AND b.node <> a.here JOIN w c ON b.node = c.here AND c.node NOT IN (a.here, a.node) JOIN w g ON "
    f"c.node = g.here AND g.node NOT IN (a.here, a.node, b.node) WHERE a.here = 'S1' AND g.node LIKE 'S%' AND b.node NOT LIKE 'S%' "
    f"AND c.node NOT LIKE 'S%' UNION ALL SELECT array_to_string([a.here, a.node, b.node], '>'), 2 FROM w a JOIN w b ON a.node = "
    f"b.here AND b.node <> a.here WHERE a.here = 'S1' AND b.node LIKE 'S%'",
)
def paths(spark, d):
    """From supplier 1 to every other supplier."""
    e = edges(spark, d)
    targets = table(spark, d, "supplier").filter("s_suppkey <> 1").select(_id("S", "s_suppkey").alias("id"))
    found = graph.paths(spark.createDataFrame([("S1",)], "id string"), targets, e, 4)
    return found.select(F.array_join("nodes", ">").alias("path"), "length")


@query(
    "a13_statistics",
    f"WITH {EDGES} SELECT n AS nodes, m AS edges, round(2 * m / n, 6) AS mean_degree FROM (SELECT count(*)::BIGINT AS m FROM e), "
    f"(SELECT count(DISTINCT x)::BIGINT AS n FROM (SELECT src AS x FROM e UNION ALL SELECT dst FROM e))",
)
def statistics(spark, d):
    e = edges(spark, d)
    return graph.statistics(e.select("src").union(e.select("dst")).distinct(), e)


@query(
    "a27_path_score",
    "SELECT l_orderkey, l_linenumber, round(1 / (1 + l_linenumber) + least(l_quantity, 3 * l_linenumber) / (3 * l_linenumber) + "
    "0.1, 4) AS score FROM lineitem",
)
def path_score(spark, d):
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", graph.path_score(n, F.least("l_quantity", 3 * n)).alias("score"))


@query(
    "j22_edges_with_ends",
    f"WITH {EDGES} SELECT e.* FROM e JOIN (SELECT 'N' || n_nationkey AS id FROM nation WHERE n_regionkey < 3) n ON e.dst = n.id",
)
def edges_with_ends(spark, d):
    """An edge whose end is no node is lost."""
    nodes = table(spark, d, "nation").filter("n_regionkey < 3").select(_id("N", "n_nationkey").alias("id"))
    e = edges(spark, d)
    return e.join(nodes, e.dst == nodes.id, "left_semi")
