"""A typed property graph as two tables: nodes (id, type, name, species) and edges (src, dst, relation).

Walks are bounded: one equi-join a hop, unrolled, so a hop is a shuffle on the frontier's ids. A direction that
goes both ways is a union of two equi-joins, never a join with OR.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evigrain.functions import text as T
from evigrain.operators.skew import spread_join
from evigrain.sources import store

MAX_HOPS = 4
# Fixed value: what may be a name in a question.
SEED = r"[A-Za-z][A-Za-z0-9_.-]{1,32}"


def merged_nodes(rows: DataFrame) -> DataFrame:
    """One node per id: of its spellings the one with the least ord. A node that comes once has its name as it is for an
    alias; of one that comes again the aliases are the distinct words of all spellings, in order."""
    all_ = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("name", r"\s+")))))
    words = F.when(F.count("*") > 1, all_).otherwise(F.array(F.any_value("name")))
    return rows.groupBy("id").agg(F.min_by("type", "ord").alias("type"), F.min_by("name", "ord").alias("name"), words.alias("aliases"))


def merged_edges(rows: DataFrame) -> DataFrame:
    """One edge per (src, dst, relation): how much evidence, its distinct sections, the first value that isn't empty."""
    first = F.min_by("value", F.when(F.col("value") != "", F.col("ord")))
    return rows.groupBy("src", "dst", "relation").agg(F.count("*").alias("evidence_count"), F.array_sort(F.collect_set("section")).alias("sections"), first.alias("value"))


def steps(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(at, to, relation, src, dst): the ways from a node."""
    down = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "relation", "src", "dst")
    up = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), "relation", "src", "dst")
    return {"downstream": down, "upstream": up, "both": down.unionByName(up)}[direction]


def seeds(query: str, nodes: DataFrame, species: str = "", limit: int = 12) -> DataFrame:
    """The nodes that a question is about: those named by the whole question or one of its words; if there are none,
    those whose name is like the whole question. Genes come first, then names in their order; species is looked at last."""
    norm = lambda t: re.sub(r"\s+", " ", t.strip()).lower()
    values = list(dict.fromkeys(v for v in map(norm, [query, *re.findall(SEED, query)]) if v and v not in T.GRAPH_BLANKS))
    named = nodes.withColumn("_norm", T.name("name"))
    first = lambda rows: rows.orderBy((F.col("type") == "Gene").desc(), "_norm", "id").limit(limit)
    if not values:
        return nodes.limit(0)
    found = first(named.filter(F.col("_norm").isin(values)))
    if found.isEmpty():
        like = values[0].replace("\\", "\\\\")
        found = first(named.filter(F.col("_norm").like(f"%{like}%")))
    if norm(species) and "species" in nodes.columns:
        found = found.filter((T.name("species") == "") | T.name("species").contains(norm(species)))
    return found.drop("_norm")


def question_walk(start: DataFrame, edges: DataFrame, hops: int, direction: str = "both", limit: int = 50) -> DataFrame:
    """The edges that a question's answer is read from: hop by hop those that touch the nodes which the hop before met
    first, with the hop. An edge comes again where a later hop touches its other end, and uses up the limit again; within
    a hop edges come in the order of src, dst and relation."""
    key = ["src", "dst", "relation"]
    ways = steps(edges, direction)
    frontier = seen = store.cut(start.select("id").distinct())
    found, left = None, limit
    for hop in range(1, max(1, hops) + 1):
        met = store.cut(frontier.join(ways, F.col("id") == F.col("at")).select(*key).distinct().orderBy(*key).limit(left))
        here = met.select(*key, F.lit(hop).alias("hop"))
        found = here if found is None else found.unionByName(here)
        left -= met.count()
        if hop == hops or left <= 0:
            break
        ends = met.select(F.col("src").alias("id")).union(met.select("dst")).distinct()
        frontier = store.cut(ends.join(seen, "id", "left_anti"))
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return found


def flattened(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (packet, at, id and what else they have) and edges (packet, at, src, dst, ...) of paths (packet, path, nodes,
    edges); a node keeps its first place, and edges without both ends are left out."""
    at = F.struct("path", F.col("pos").alias("pos")).alias("at")
    n = paths.select("packet", "path", F.posexplode("nodes").alias("pos", "x")).filter("x.id <> ''")
    n = n.select("packet", at, "x").groupBy("packet", F.col("x.id").alias("_id")).agg(F.min_by(F.struct("at", "x"), "at").alias("y"))
    e = paths.select("packet", "path", F.posexplode("edges").alias("pos", "x")).filter("x.src <> '' AND x.dst <> ''")
    return n.select("packet", "y.at", "y.x.*"), e.select("packet", at, "x.*")


def evidence_graphs(nodes: DataFrame, edges: DataFrame, most_edges: int = 40, most_nodes: int = 80) -> tuple[DataFrame, DataFrame]:
    """What is shown of each packet's graph: its first edges by `at`, then the nodes at their ends, then others, by `at`.
    A packet without nodes or without edges shows nothing."""
    rank = lambda *by: F.row_number().over(W.partitionBy("packet").orderBy(*by))
    e = edges.join(nodes.select("packet").distinct(), "packet", "left_semi").withColumn("rank", rank("at")).filter(F.col("rank") <= most_edges)
    ends = e.select("packet", F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("_end", F.lit(0))
    n = nodes.join(edges.select("packet").distinct(), "packet", "left_semi").join(ends, ["packet", "id"], "left").withColumn("_end", F.coalesce("_end", F.lit(1)))
    n = n.withColumn("rank", rank("_end", "at")).filter(F.col("rank") <= most_nodes)
    return n.drop("_end", "at"), e.drop("at")


def neighbourhood(seeds: DataFrame, edges: DataFrame, hops: int, direction: str = "both", limit: int | None = None) -> DataFrame:
    """The distinct edges within `hops` of the seeds (id), each with the hop that reaches it first. limit: so many
    edges in all; nearer hops come first, and within one the order is that of src, dst and relation."""
    ways = steps(edges, direction)
    frontier, seen, found, left = seeds.select("id").distinct(), seeds.select("id").distinct(), None, limit
    key = ["src", "dst", "relation"]
    for hop in range(1, max(1, min(hops, MAX_HOPS)) + 1):
        met = frontier.join(ways, F.col("id") == F.col("at")).groupBy(*key).agg(F.collect_set("to").alias("to"))
        if found is not None:
            met = met.join(found.select(*key), key, "left_anti")
        if left is not None:
            met = met.orderBy(*key).limit(left)
        # Each hop is written: the next one, and the result, read it instead of walking again.
        met = store.cut(met)
        here = met.select(*key, F.lit(hop).alias("hop"))
        found = here if found is None else found.unionByName(here)
        if hop == hops:
            break
        if left is not None and (left := left - met.count()) <= 0:
            break
        frontier = store.cut(met.select(F.explode("to").alias("id")).distinct().join(seen, "id", "left_anti"))
        seen = seen.unionByName(frontier)
    return found


def paths(starts: DataFrame, targets: DataFrame, edges: DataFrame, hops: int, limit: int | None = None) -> DataFrame:
    """Simple paths from starts to targets (id) of at most `hops` edges, either way along them: nodes, length. limit: the
    shortest so many, of equals in the order of their nodes."""
    ways = steps(edges).select("at", "to").distinct()
    walk = starts.select(F.array("id").alias("nodes"), F.col("id").alias("end"))
    goal, found = targets.select(F.col("id").alias("goal")).distinct(), None
    for length in range(1, max(1, min(hops, MAX_HOPS)) + 1):
        walk = walk.join(ways, F.col("end") == F.col("at")).filter(~F.array_contains("nodes", F.col("to"))).select(F.concat("nodes", F.array("to")).alias("nodes"), F.col("to").alias("end"))
        walk = store.cut(walk.join(goal, F.col("end") == F.col("goal"), "left").select("nodes", "end", F.col("goal").isNotNull().alias("there")))
        here = walk.filter("there").select("nodes", F.lit(length).alias("length"))
        found = here if found is None else found.unionByName(here)
        walk = walk.filter("NOT there").select("nodes", "end")
    return found if limit is None else found.orderBy("length", "nodes").limit(limit)


def with_names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with src_name and dst_name; a node that isn't there is shown by its id."""
    name = lambda end: nodes.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
    both = edges.join(name("src"), "src", "left").join(name("dst"), "dst", "left")
    return both.select(*edges.columns, *[F.coalesce(f"{e}_name", e).alias(f"{e}_name") for e in ("src", "dst")])


def sample(genes: DataFrame, edges: DataFrame, size: int, seed: int) -> DataFrame:
    """The edges among `size` of the genes (id), drawn by a hash, and all that is one step away from them."""
    drawn = genes.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "id").cast("binary")), "id").limit(size)
    near = drawn.join(steps(edges), F.col("id") == F.col("at")).select(F.col("to").alias("id"))
    return inside(edges, store.cut(drawn.unionByName(near).distinct()))


def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends are among the nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids, edges.src == ids.id, "left_semi").join(ids, edges.dst == ids.id, "left_semi")


def capped(edges: DataFrame, nodes: DataFrame, most_edges: int = 40, most_nodes: int = 80) -> tuple[DataFrame, DataFrame]:
    """A graph to show: so many edges, then so many nodes, the ends of these edges first; in the order of their keys."""
    e = edges.orderBy("src", "dst", "relation").limit(most_edges)
    ends = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("end", F.lit(0))
    ranked = nodes.join(ends, "id", "left").withColumn("end", F.coalesce("end", F.lit(1)))
    return e, ranked.orderBy("end", "id").limit(most_nodes).drop("end")


def checked_types(rows: DataFrame, column: str, known: tuple[str, ...]) -> DataFrame:
    """rows, if all have a known type; else an error that names the first unknown one."""
    fits = F.col(column).isin(*known)
    return rows.filter(F.when(fits, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown type: "), F.coalesce(column, F.lit("null")))).cast("boolean")))


#: Queries that are broadcast, after they were counted; more meet the nodes by shuffles.
ASKED = 10_000
RUN = 3


def _runs(rows: DataFrame, column: str) -> DataFrame:
    """rows with each distinct run of RUN characters of a column."""
    return rows.select("*", F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(rf"(?s)(?=(.{{{RUN}}}))"), F.lit(1)))).alias("_run"))


def _holding(names: DataFrame, asked: DataFrame, few: bool) -> DataFrame:
    """Names (norm) that hold a query (norm2), found by runs that they share: a name with all runs of a query is looked at."""
    small = F.broadcast if few else (lambda t: t)
    told = _runs(asked.filter(F.length("norm2") >= RUN), "norm2")
    n = told.groupBy("query").agg(F.count("*").alias("_all"))
    met = _runs(names.select("id", "norm"), "norm").join(small(told.select("query", "_run")), "_run").groupBy("id", "query").agg(F.count("*").alias("_n"))
    full = met.join(small(n), "query").filter("_n = _all").select("id", "query")
    long = names.join(full, "id").join(small(asked), "query").filter(F.col("norm").contains(F.col("norm2")))
    # A query shorter than a run is looked for in the names themselves.
    short = names.join(small(asked.filter(F.length("norm2") < RUN)), F.col("norm").contains(F.col("norm2")))
    columns = ["query", "id", "type", "name"]
    return long.select(*columns).unionByName(short.select(*columns))


def resolved(queries: DataFrame, nodes: DataFrame, limit: int = 12) -> DataFrame:
    """query, id, tier, score for up to `limit` nodes of each query: those whose name it is (score 1), else those that
    share words with it (at most 0.95), else those whose name holds it (0.5): the first tier that finds any. Genes come
    first, then metabolites, then others, each by score and name.

    Names meet queries by equi-joins: on names, on words, and on runs of three characters for what the others left."""
    q = store.cut(queries.select("query", F.lower(F.trim("query")).alias("norm")).distinct())
    few = q.count() <= ASKED
    small = F.broadcast if few else (lambda t: t)
    n = nodes.select("id", "name", "type", F.lower(F.trim("name")).alias("norm"))
    exact = store.cut(n.join(small(q), "norm").select("query", "id", "type", "name", F.lit(0).alias("tier"), F.lit(1.0).alias("score")))
    rest = q.join(exact.select("query").distinct(), "query", "left_anti")
    words = lambda t: t.select("*", F.explode(F.array_distinct(F.filter(F.split("norm", r"\W+"), lambda w: w != ""))).alias("word"))
    shared = words(n).join(small(words(rest).select("query", "word")), "word").groupBy("query", "id", "type", "name").agg(F.count("*").alias("n"))
    text = store.cut(shared.select("query", "id", "type", "name", F.lit(1).alias("tier"), F.least(F.lit(0.95), 0.65 + F.col("n") / 100).alias("score")))
    last = rest.join(text.select("query").distinct(), "query", "left_anti").withColumnRenamed("norm", "norm2")
    fuzzy = _holding(n, last, few).select("*", F.lit(2).alias("tier"), F.lit(0.5).alias("score"))
    kind = F.when(F.col("type") == "Gene", 0).when(F.col("type") == "Metabolite", 1).otherwise(2)
    # Of the last tier short names come first.
    order = [kind, F.desc("score"), F.when(F.col("tier") == 2, F.length("name")).otherwise(0), "name", "id"]
    place = F.row_number().over(W.partitionBy("query").orderBy(*order))
    return exact.unionByName(text).unionByName(fuzzy).withColumn("place", place).filter(F.col("place") <= limit).select("query", "id", "tier", "score", "place")


def species_kept(rows: DataFrame, column: str, wanted: str) -> DataFrame:
    """Rows without a species, or whose species' name holds the wanted one."""
    s = F.lower(F.trim(F.coalesce(column, F.lit(""))))
    return rows.filter((s == "") | s.contains(wanted.lower()))


def rendered_paths(found: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, text: each path as `- a -[:RELATION]-> b` lines, one for each step, along the edge whichever way it goes."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("nodes") - 2), lambda i: F.struct(i.alias("i"), F.get("nodes", i).alias("a"), F.get("nodes", i + 1).alias("b")))
    step = found.select("nodes", F.explode(pairs).alias("p")).select("nodes", "p.*")
    ways = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "src", "dst", "relation").unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "src", "dst", "relation"))
    line = F.concat(F.lit("- "), "src", F.lit(" -[:"), "relation", F.lit("]-> "), "dst")
    each = step.join(ways, ["a", "b"]).groupBy("nodes", "i").agg(F.min(line).alias("line"))
    return each.groupBy("nodes").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))


def path_evidence(found: DataFrame, evidence: DataFrame) -> DataFrame:
    """One evidence row for all paths (id, score) with what supports them (id, at, doi, journal): the best score, the
    first DOI and the first journal that are there; no row without paths."""
    told = found.join(evidence, "id", "left")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct("id", "at"))).alias(c)
    return told.agg(F.count_distinct("id").alias("paths"), F.max("score").alias("score"), first("doi"), first("journal")).filter("paths > 0")


def summary(edges: DataFrame, seeds: DataFrame, most: int = 4) -> DataFrame:
    """One row: how many nodes and edges a graph has, and its first seeds by name."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    some = seeds.select("name").distinct().orderBy("name").limit(most).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("seeds"))
    return ends.agg(F.count("*").alias("nodes")).join(F.broadcast(edges.agg(F.count("*").alias("edges")))).join(F.broadcast(some))


def static_graph(genes: DataFrame, blanks: tuple[str, ...] = ("", "NA")) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type) and edges (src, dst) of substrate -> gene -> product for genes (ord, name, substrate, product), whose
    substrates and products are lists with semicolons. Of clashing names the type that came last counts."""
    parts = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: ~x.isin(*blanks))
    rows = genes.filter(~F.trim("name").isin(*blanks)).select("ord", F.trim("name").alias("gene"), parts(F.col("substrate")).alias("s"), parts(F.col("product")).alias("p"))
    into = rows.select("ord", F.explode("s").alias("src"), F.col("gene").alias("dst"))
    out = rows.select("ord", F.col("gene").alias("src"), F.explode("p").alias("dst"))
    node = lambda df, id_, type_, place: df.select(F.col(id_).alias("id"), F.lit(type_).alias("type"), F.struct("ord", F.lit(place).alias("place")).alias("when"))
    all_ = node(rows, "gene", "Gene", 0).unionByName(node(into, "src", "Substrate", 1)).unionByName(node(out, "dst", "Product", 2))
    return all_.groupBy("id").agg(F.max_by("type", "when").alias("type")), into.select("src", "dst").union(out.select("src", "dst")).distinct()


def weak_components(edges: DataFrame) -> DataFrame:
    """id, component: the least id that edges reach, whatever their direction.

    A round hangs all greater neighbours of a node on the least node among it and its neighbours, then every node with its
    lesser neighbours on the least of these. Links only ever move to lesser ends, and the rounds are few whatever a
    component's shape is; what a hub is linked with is spread over tasks. Every round is written."""
    ends = edges.select(F.greatest("src", "dst").alias("high"), F.least("src", "dst").alias("low"))
    links, alone = store.cut(ends.filter("high <> low").distinct()), ends.select(F.col("low").alias("id")).distinct()
    while True:
        after = store.cut(_lesser(_greater(links)))
        if after.count() == links.count() and after.join(links, ["high", "low"], "left_anti").isEmpty():
            break
        links = after
    told = links.select(F.col("high").alias("id"), F.col("low").alias("component"))
    roots = alone.join(told.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
    return told.unionByName(roots.unionByName(links.select(F.col("low").alias("id"), F.col("low").alias("component"))).distinct())


def _least(links: DataFrame, node: str, other: str) -> DataFrame:
    """links with `least`: the least of a node and the other ends of its links."""
    lows = links.groupBy(node).agg(F.min(other).alias("_low")).select(node, F.least(node, "_low").alias("least"))
    return spread_join(links, store.cut(lows), node)


def _greater(links: DataFrame) -> DataFrame:
    both = links.select(F.col("high").alias("node"), F.col("low").alias("near")).unionByName(links.select(F.col("low").alias("node"), F.col("high").alias("near")))
    return store.cut(_least(both, "node", "near").filter("near > node AND near <> least").select(F.col("near").alias("high"), F.col("least").alias("low")).distinct())


def _lesser(links: DataFrame) -> DataFrame:
    hung = _least(links, "high", "low")
    down = hung.select(F.col("low").alias("high"), F.col("least").alias("low"))
    return down.unionByName(hung.select("high", F.col("least").alias("low"))).filter("high <> low").distinct()


def summaries(graphs: DataFrame, key: str, most: int = 2, seeds: int = 4) -> DataFrame:
    """key and a text about its first graphs (at, seeds, direction, hops, backend, n_nodes, n_edges): what each started from, and its size."""
    first = graphs.withColumn("_place", F.row_number().over(W.partitionBy(key).orderBy("at"))).filter(F.col("_place") <= most)
    some = F.slice(F.filter("seeds", lambda x: F.coalesce(x, F.lit("")) != ""), 1, seeds)
    # The words of a summary.
    parts = ("图 RAG 检索主体: ", F.when(F.size(some) > 0, F.array_join(some, "、")).otherwise("未明确匹配主体"), "; 方向: ", _or("direction", "both"), "; hops: ", _or("hops", "?"), "; backend: ", _or("backend", "graph_db"))
    size = ("; 返回 ", F.col("n_nodes").cast("string"), " 个节点、", F.col("n_edges").cast("string"), " 条边")
    text = F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in (*parts, *size)])
    return first.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_place", text.alias("text")))), lambda x: x["text"]), " | ").alias("text"))


def _or(column: str, other: str) -> Column:
    told = F.col(column).cast("string")
    return F.when(F.coalesce(told, F.lit("")) == "", other).otherwise(told)


def directed_paths(start: DataFrame, edges: DataFrame, hops: int, direction: str, limit: int | None = None) -> DataFrame:
    """nodes, length: simple paths from start (id) of at most `hops` edges along a direction (downstream, upstream, both); the
    shortest so many, of equals in the order of their nodes."""
    ways = steps(edges, direction).select("at", "to").distinct()
    walk, found = start.select(F.array("id").alias("nodes"), F.col("id").alias("end")), None
    for length in range(1, max(1, min(hops, MAX_HOPS)) + 1):
        walk = walk.join(ways, F.col("end") == F.col("at")).filter(~F.array_contains("nodes", F.col("to")))
        walk = walk.select(F.concat("nodes", F.array("to")).alias("nodes"), F.col("to").alias("end"))
        if limit is not None:
            # Longer paths come after all shorter ones, so a hop never needs more than are asked for; each goes on from here.
            walk = store.cut(walk.distinct())
            here = walk.orderBy("nodes").limit(limit)
        else:
            here = walk = store.cut(walk.distinct())
        here = here.select("nodes", F.lit(length).alias("length"))
        found = here if found is None else found.unionByName(here)
    return found if limit is None else found.orderBy("length", "nodes").limit(limit)


def path_score(length: Column, bits: Column) -> Column:
    """1 / (1 + length) + bits / (3 length) + 0.1, to four digits; 0 without relations."""
    n = F.greatest(length, F.lit(1))
    return F.when(length == 0, 0.0).otherwise(F.round(1 / (1 + length) + bits / (3 * n) + 0.1, 4))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges and the mean degree."""
    n, m = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    return n.join(F.broadcast(m)).select("nodes", "edges", F.round(2 * F.col("edges") / F.greatest("nodes", F.lit(1)), 6).alias("mean_degree"))


def by_type(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (node, edge), type, n; nodes: (id, type)."""
    n = nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "type", "n")
    return n.unionByName(edges.groupBy(F.col("relation").alias("type")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "type", "n"))
