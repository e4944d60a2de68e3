"""More queries over the graph: names at edges, caps, resolution of names, rendering, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrain.operators import graph
from evigrain.plans.graph import EDGES, WAYS, edges
from evigrain.plans.registry import query, table
from evigrain.sources import store

NODES = """n AS (SELECT 'S' || s_suppkey AS id, s_name AS name, 'Gene' AS type FROM supplier UNION ALL SELECT 'C' || c_custkey, c_name, 'Metabolite' FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'N' || n_nationkey, n_name, 'Process' FROM nation)"""


def nodes(spark, d):
    """Suppliers, every other customer and nations, with names and types; regions are no nodes."""
    row = lambda t, letter, key, name, type_: t.select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"), F.col(name).alias("name"), F.lit(type_).alias("type"))
    s, c, n = (table(spark, d, t) for t in ("supplier", "customer", "nation"))
    return row(s, "S", "s_suppkey", "s_name", "Gene").unionByName(row(c.filter("c_custkey % 2 = 0"), "C", "c_custkey", "c_name", "Metabolite")).unionByName(row(n, "N", "n_nationkey", "n_name", "Process"))


@query(
    "j17_named_edges",
    f"WITH {EDGES}, {NODES} SELECT e.*, coalesce(a.name, src) AS src_name, coalesce(b.name, dst) AS dst_name FROM e LEFT JOIN n a "
    f"ON a.id = src LEFT JOIN n b ON b.id = dst",
)
def named_edges(spark, d):
    return graph.with_names(edges(spark, d), nodes(spark, d))


@query("j18_edges_inside", f"WITH {EDGES}, {NODES} SELECT * FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def edges_inside(spark, d):
    return graph.inside(edges(spark, d), nodes(spark, d))


@query(
    "j13_seen_nodes",
    f"WITH {EDGES}, {NODES} SELECT * FROM n WHERE id IN (SELECT src FROM e WHERE dst = 'N3' UNION SELECT dst FROM e WHERE dst = "
    f"'N3')",
)
def seen_nodes(spark, d):
    """The nodes of all ids that a walk has met."""
    found = edges(spark, d).filter("dst = 'N3'")
    ids = found.select(F.col("src").alias("id")).union(found.select("dst")).distinct()
    return nodes(spark, d).join(ids, "id", "left_semi")


@query(
    "t11_edge_budget",
    f"WITH {EDGES}, {WAYS}, h1 AS (SELECT DISTINCT src, dst, relation FROM w WHERE here = 'R1'), f AS (SELECT DISTINCT node FROM w "
    f"WHERE here = 'R1'), h2 AS (SELECT DISTINCT w.src, w.dst, w.relation FROM w JOIN f ON w.here = f.node EXCEPT SELECT * FROM "
    f"h1), a AS (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2) SELECT src, dst, relation, hop FROM a ORDER BY hop, "
    f"src, dst, relation LIMIT 30",
)
def edge_budget(spark, d):
    """Thirty edges in all, the near ones first."""
    return graph.neighbourhood(spark.createDataFrame([("R1",)], "id string"), edges(spark, d), 2, limit=30)


@query(
    "t12_shortest_paths",
    f"WITH {EDGES}, {WAYS}, p AS (SELECT [a.here, a.node, b.node] AS nodes, 2 AS length FROM w a JOIN w b ON a.node = b.here AND "
    f"b.node <> a.here WHERE a.here = 'S1' AND b.node LIKE 'C%') SELECT array_to_string(nodes, '>') AS path, length FROM p ORDER "
    f"BY length, nodes LIMIT 10",
)
def shortest_paths(spark, d):
    targets = table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"))
    found = graph.paths(spark.createDataFrame([("S1",)], "id string"), targets, edges(spark, d), 2, limit=10)
    return found.select(F.array_join("nodes", ">").alias("path"), "length")


@query("t13_capped_edges", f"WITH {EDGES} SELECT * FROM e ORDER BY src, dst, relation LIMIT 40")
def capped_edges(spark, d):
    return graph.capped(edges(spark, d), nodes(spark, d))[0]


@query(
    "t13_capped_nodes",
    f"WITH {EDGES}, {NODES}, c AS (SELECT * FROM e ORDER BY src, dst, relation LIMIT 40) SELECT id FROM n ORDER BY CASE WHEN id IN "
    f"(SELECT src FROM c UNION SELECT dst FROM c) THEN 0 ELSE 1 END, id LIMIT 80",
)
def capped_nodes(spark, d):
    return graph.capped(edges(spark, d), nodes(spark, d))[1].select("id")


@query("t17_render_nodes", f"WITH {NODES} SELECT id FROM n ORDER BY id LIMIT 800")
def render_nodes(spark, d):
    return nodes(spark, d).select("id").orderBy("id").limit(800)


@query("p24_known_types", f"WITH {NODES} SELECT id FROM n")
def known_types(spark, d):
    return graph.checked_types(nodes(spark, d), "type", ("Gene", "Metabolite", "Process")).select("id")


@query("p23_species_kept", "SELECT p_partkey FROM part WHERE p_size % 3 = 0 OR contains(lower(p_brand), 'brand#1')")
def species_kept(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("species"))
    return graph.species_kept(rows, "species", "BRAND#1").select("p_partkey")


_Q = "q AS (SELECT unnest(['Supplier#000000001', 'red widget gear', 'NATION_1', 'ustomer#00000000', 'nothing at all']) AS query)"
_PARTS = "n AS (SELECT 'P' || p_partkey AS id, p_name AS name, CASE p_partkey % 3 WHEN 0 THEN 'Gene' WHEN 1 THEN 'Metabolite' ELSE 'Process' END AS type FROM part)"


@query("g08_resolved_nodes", f"""WITH {NODES.replace('n AS', 'm AS')}, {_PARTS.replace('n AS', 'k AS')}, n AS (SELECT * FROM m UNION ALL SELECT * FROM k), {_Q}, x AS (SELECT id, name, type, lower(trim(name)) AS norm, list_distinct(list_filter(regexp_split_to_array(lower(trim(name)), '\\W+'), lambda w: w <> '')) AS words FROM n),
y AS (SELECT query, lower(trim(query)) AS norm, list_distinct(list_filter(regexp_split_to_array(lower(trim(query)), '\\W+'), lambda w: w <> '')) AS words FROM q),
a AS (SELECT query, id, name, type, CASE WHEN x.norm = y.norm THEN 0 WHEN len(list_intersect(x.words, y.words)) > 0 THEN 1 WHEN contains(x.norm, y.norm) THEN 2 END AS tier, len(list_intersect(x.words, y.words)) AS w FROM x, y),
b AS (SELECT *, min(tier) OVER (PARTITION BY query) AS best FROM a WHERE tier IS NOT NULL),
c AS (SELECT query, id, name, type, tier, CASE tier WHEN 0 THEN 1.0 WHEN 1 THEN least(0.95, 0.65 + w / 100) ELSE 0.5 END::DOUBLE AS score FROM b WHERE tier = best),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY CASE type WHEN 'Gene' THEN 0 WHEN 'Metabolite' THEN 1 ELSE 2 END, score DESC, CASE WHEN tier = 2 THEN length(name) ELSE 0 END, name, id) AS place FROM c)
SELECT query, id, tier, round(score, 6) AS score, place::INT AS place FROM r WHERE place <= 12""")
def resolved_nodes(spark, d):
    """Names, words and parts of names, tier by tier."""
    parts = table(spark, d, "part").selectExpr("'P' || CAST(p_partkey AS STRING) AS id", "p_name AS name", "CASE p_partkey % 3 WHEN 0 THEN 'Gene' WHEN 1 THEN 'Metabolite' ELSE 'Process' END AS type")
    asked = spark.createDataFrame([(q,) for q in ("Supplier#000000001", "red widget gear", "NATION_1", "ustomer#00000000", "nothing at all")], "query string")
    return graph.resolved(asked, nodes(spark, d).unionByName(parts)).withColumn("score", F.round("score", 6))


@query(
    "g14_rendered_paths",
    f"WITH {EDGES} SELECT 'S1>' || a.dst || '>' || b.src AS path, '- S1 -[:BASED_IN]-> ' || a.dst || chr(10) || '- ' || b.src || ' "
    f"-[:' || b.relation || ']-> ' || b.dst AS text FROM e a JOIN e b ON a.dst = b.dst WHERE a.src = 'S1' AND b.src LIKE 'C%'",
)
def rendered_paths(spark, d):
    e = edges(spark, d)
    targets = table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"))
    found = graph.paths(spark.createDataFrame([("S1",)], "id string"), targets, e, 2)
    return graph.rendered_paths(found, e).select(F.array_join("nodes", ">").alias("path"), "text")


@query(
    "g13_path_evidence",
    "SELECT count(DISTINCT o_orderkey)::BIGINT AS paths, max(o_totalprice) AS score, (SELECT 'D' || l_partkey FROM lineitem WHERE "
    "l_linenumber > 3 ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 1) AS doi FROM orders",
)
def path_evidence(spark, d):
    """Orders as paths, their lines as what supports them."""
    found = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    told = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey").alias("at"), F.when(F.col("l_linenumber") > 3, F.concat(F.lit("D"), F.col("l_partkey").cast("string"))).otherwise("").alias("doi"), F.lit("").alias("journal"))
    return graph.path_evidence(found, told).select("paths", "score", "doi")


@query(
    "g16_summary",
    f"WITH {EDGES} SELECT (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e))::BIGINT AS nodes, (SELECT count(*) "
    f"FROM e)::BIGINT AS edges, (SELECT string_agg(n_name, ', ' ORDER BY n_name) FROM (SELECT DISTINCT n_name FROM nation ORDER BY "
    f"n_name LIMIT 4)) AS seeds",
)
def graph_summary(spark, d):
    return graph.summary(edges(spark, d), table(spark, d, "nation").select(F.col("n_name").alias("name")))


_GENES = "g AS (SELECT p_partkey AS ord, p_brand AS name, CASE WHEN p_size % 4 = 0 THEN 'NA' ELSE p_type || '; ' || p_name END AS substrate, CASE WHEN p_size % 5 = 0 THEN p_brand ELSE p_name || ';NA; ' END AS product FROM part), t AS (SELECT ord, name, list_filter(list_transform(string_split(substrate, ';'), lambda x: trim(x)), lambda x: x NOT IN ('', 'NA')) AS s, list_filter(list_transform(string_split(product, ';'), lambda x: trim(x)), lambda x: x NOT IN ('', 'NA')) AS p FROM g)"


def _genes(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey AS ord", "p_brand AS name", "CASE WHEN p_size % 4 = 0 THEN 'NA' ELSE p_type || '; ' || p_name END AS substrate", "CASE WHEN p_size % 5 = 0 THEN p_brand ELSE p_name || ';NA; ' END AS product")


@query(
    "g17_static_nodes",
    f"WITH {_GENES}, a AS (SELECT name AS id, 'Gene' AS type, ord, 0 AS place FROM t UNION ALL SELECT unnest(s), 'Substrate', ord, "
    f"1 FROM t UNION ALL SELECT unnest(p), 'Product', ord, 2 FROM t) SELECT id, arg_max(type, {{'o': ord, 'p': place}}) AS type "
    f"FROM a GROUP BY id",
)
def static_nodes(spark, d):
    return graph.static_graph(_genes(spark, d))[0]


@query(
    "g17_static_edges",
    f"WITH {_GENES} SELECT DISTINCT * FROM (SELECT unnest(s) AS src, name AS dst FROM t UNION ALL SELECT name, unnest(p) FROM t)",
)
def static_edges(spark, d):
    return graph.static_graph(_genes(spark, d))[1]


@query(
    "a13_by_type",
    f"WITH {EDGES}, {NODES} SELECT 'node' AS kind, type, count(*)::BIGINT AS n FROM n GROUP BY type UNION ALL SELECT 'edge', "
    f"relation, count(*) FROM e GROUP BY relation",
)
def by_type(spark, d):
    return graph.by_type(nodes(spark, d), edges(spark, d))


@query(
    "a13_weak_components",
    f"WITH {EDGES}, r AS (SELECT 'N' || n_nationkey AS x, 'R' || n_regionkey AS region FROM nation), m AS (SELECT x AS id, region "
    f"FROM r UNION SELECT region, region FROM r UNION SELECT src, region FROM e JOIN r ON dst = x) SELECT id, min(id) OVER "
    f"(PARTITION BY region) AS component FROM m",
)
def weak_components(spark, d):
    """Without edges between regions, each region with all below it is a component."""
    return graph.weak_components(edges(spark, d))


@query("u09_to_prune", "SELECT DISTINCT o_orderpriority AS name FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW')")
def to_prune(spark, d):
    """Generations that neither are protected nor the current one."""
    listing = table(spark, d, "orders").select(F.col("o_orderpriority").alias("name")).distinct()
    return store.to_prune(listing, ["1-URGENT", "2-HIGH"], "5-LOW")


@query(
    "a10_merged_node_rows",
    "SELECT lower(p_brand) AS id, arg_min(p_type, p_partkey) AS type, arg_min(p_name, p_partkey) AS name, "
    "CASE WHEN count(*) = 1 THEN any_value(p_name) ELSE array_to_string(list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))), ' ') END AS aliases "
    "FROM (SELECT p_partkey, p_type, p_name, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name || p_partkey END AS p_brand FROM part) GROUP BY 1",
)
def merged_node_rows(spark, d):
    """Type, name and aliases: the words of all spellings, or the name as it is where there is one. Half of the parts are nodes of their own."""
    own = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.concat("p_name", F.col("p_partkey").cast("string")))
    rows = table(spark, d, "part").select(F.lower(own).alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return graph.merged_nodes(rows).withColumn("aliases", F.array_join("aliases", " "))


@query(
    "j22_edges_with_both_ends",
    f"WITH {EDGES}, {NODES} SELECT e.src, e.dst FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE a.type = 'Gene'",
)
def edges_with_both_ends(spark, d):
    n = nodes(spark, d)
    e = edges(spark, d).join(n.filter("type = 'Gene'").select(F.col("id").alias("src")), "src", "left_semi")
    return e.join(n.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


QUESTION = "What does nation_3 share with Supplier#000000002 and  NATION_7"
_SEEDS = f"{NODES}, s AS (SELECT id FROM n WHERE lower(name) IN ('what', 'does', 'nation_3', 'share', 'with', 'supplier', 'and', 'nation_7'))"


@query(
    "g06_seeds",
    f"WITH {NODES} (SELECT 'words' AS how, id FROM n WHERE lower(name) IN ('nation_3', 'nation_7') ORDER BY type = 'Gene' DESC, lower(name), id LIMIT 12) "
    "UNION ALL (SELECT 'like', id FROM n WHERE lower(name) LIKE '%er#00000000_%' ORDER BY type = 'Gene' DESC, lower(name), id LIMIT 12)",
)
def seeds(spark, d):
    """Nodes that the words of a question name; and, where none does, those whose name is like the question."""
    n = nodes(spark, d)
    return graph.seeds(QUESTION, n).select(F.lit("words").alias("how"), "id").unionByName(graph.seeds("er#00000000_", n).select(F.lit("like").alias("how"), "id"))


@query(
    "g07_question_walk",
    f"WITH {EDGES}, {_SEEDS}, h1 AS (SELECT * FROM e WHERE src IN (SELECT id FROM s) OR dst IN (SELECT id FROM s) ORDER BY src, dst, relation LIMIT 150), f AS (SELECT src AS id FROM h1 UNION SELECT dst FROM h1 "
    "EXCEPT SELECT id FROM s), h2 AS (SELECT *, row_number() OVER (ORDER BY src, dst, relation) AS k FROM e WHERE src IN (SELECT id FROM f) OR dst IN (SELECT id FROM f)) "
    "SELECT src, dst, relation, 1 AS hop FROM h1 UNION ALL SELECT src, dst, relation, 2 FROM h2 WHERE k <= 150 - (SELECT count(*) FROM h1)",
)
def question_walk(spark, d):
    """Two hops from a question's seeds. The first hop's edges are met again from their other ends, and count again."""
    return graph.question_walk(graph.seeds(QUESTION, nodes(spark, d)), edges(spark, d), 2, limit=150)


@query(
    "g15_evidence_graphs",
    f"WITH {EDGES}, {NODES}, p AS (SELECT CASE WHEN relation = 'PART_OF' THEN src ELSE dst END AS packet, * FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY packet ORDER BY relation DESC, src) AS rank FROM p), "
    "ke AS (SELECT * FROM k WHERE rank <= 40), ends AS (SELECT packet, src AS id FROM ke UNION SELECT packet, dst FROM ke), all_ AS (SELECT packet, src AS id FROM p UNION SELECT packet, dst FROM p), "
    "m AS (SELECT a.packet, a.id, row_number() OVER (PARTITION BY a.packet ORDER BY (x.id IS NULL), a.id) AS rank FROM all_ a JOIN n USING (id) LEFT JOIN ends x ON x.packet = a.packet AND x.id = a.id) "
    "SELECT packet, 'edge' AS what, src || '>' || dst AS id, rank::INT AS rank FROM ke WHERE packet IN (SELECT packet FROM m) UNION ALL SELECT packet, 'node', id, rank::INT FROM m WHERE rank <= 80",
)
def evidence_graphs(spark, d):
    """A nation's edges as one packet of evidence: forty of them are shown, and of the nodes those at their ends first."""
    e = edges(spark, d).select(F.when(F.col("relation") == "PART_OF", F.col("src")).otherwise(F.col("dst")).alias("packet"), "src", "dst", "relation")
    ids = e.select("packet", F.explode(F.array("src", "dst")).alias("id")).distinct()
    n = ids.join(nodes(spark, d), "id").withColumn("at", F.col("id"))
    # The order of edges in a packet: relations from z to a, then src.
    order = F.struct(-F.array_position(F.array(*map(F.lit, ("BASED_IN", "LIVES_IN", "PART_OF"))), F.col("relation")), "src")
    shown, kept = graph.evidence_graphs(n, e.withColumn("at", order))
    one = kept.select("packet", F.lit("edge").alias("what"), F.concat("src", F.lit(">"), "dst").alias("id"), "rank")
    return one.unionByName(shown.select("packet", F.lit("node").alias("what"), "id", "rank"))


@query(
    "g10_directed_paths",
    f"WITH {EDGES}, {WAYS}, u1 AS (SELECT dst AS a, src AS b FROM e WHERE dst = 'R1'), u AS (SELECT array_to_string([a, b], '>') AS path, 1 AS length FROM u1 UNION ALL SELECT array_to_string([a, b, src], '>'), 2 FROM u1 JOIN e ON dst = b), "
    "b1 AS (SELECT DISTINCT here AS a, node AS b FROM w WHERE here = 'S1'), b AS (SELECT array_to_string([a, b], '>') AS path, 1 AS length FROM b1 UNION ALL SELECT DISTINCT array_to_string([a, b, node], '>'), 2 FROM b1 JOIN w ON here = b WHERE node <> a) "
    "SELECT 'upstream' AS direction, path, length FROM u UNION ALL (SELECT 'both', path, length FROM b ORDER BY length, path LIMIT 20)",
)
def directed_paths(spark, d):
    """Against the edges from a region, all of them; and either way from a supplier, the first twenty."""
    e, of = edges(spark, d), lambda i: spark.createDataFrame([(i,)], "id string")
    shown = lambda name, found: found.select(F.lit(name).alias("direction"), F.array_join("nodes", ">").alias("path"), "length")
    return shown("upstream", graph.directed_paths(of("R1"), e, 2, "upstream")).unionByName(shown("both", graph.directed_paths(of("S1"), e, 2, "both", 20)))


@query(
    "g16_summaries",
    "WITH s AS (SELECT n_regionkey, n_nationkey, n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS e FROM nation), k AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place FROM s) "
    "SELECT n_regionkey, string_agg('图 RAG 检索主体: ' || CASE WHEN n_nationkey % 2 = 0 THEN n_name || '、a、b、c' ELSE '未明确匹配主体' END || '; 方向: ' || CASE WHEN n_nationkey % 3 = 0 THEN 'upstream' ELSE 'both' END || '; hops: ' || CASE WHEN n_nationkey % 3 = 0 THEN '2' ELSE '?' END || "
    "'; backend: graph_db; 返回 ' || (e + 1) || ' 个节点、' || e || ' 条边', ' | ' ORDER BY place) AS text FROM k WHERE place <= 2 GROUP BY n_regionkey",
)
def graph_summaries(spark, d):
    """Each region's first two nations as graphs of their suppliers, some without seeds, direction or hops."""
    n = table(spark, d, "nation").join(table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("e")), "n_nationkey", "left").withColumn("n_edges", F.coalesce("e", F.lit(0)))
    some, even = F.col("n_nationkey") % 3 == 0, F.col("n_nationkey") % 2 == 0
    seeds = F.when(even, F.array("n_name", F.lit(""), F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"))).otherwise(F.array().cast("array<string>"))
    graphs = n.select("n_regionkey", F.col("n_nationkey").alias("at"), seeds.alias("seeds"), F.when(some, "upstream").alias("direction"), F.when(some, 2).alias("hops"), F.lit("").alias("backend"), (F.col("n_edges") + 1).alias("n_nodes"), "n_edges")
    return graph.summaries(graphs, "n_regionkey")
