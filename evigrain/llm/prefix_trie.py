"""Operator 11, the trie of conversation prefixes.

A conversation is a sequence of steps; conversations that start with the same d steps meet in one node of depth d. A
node belongs to the least conv_id among them. A prefix is known by 128 bits: the exclusive or, over its steps, of a
digest of depth and step, which `running` gives for a conversation of any length. `minima` holds the owner of
each prefix. If a conversation owns its prefix of one depth, it owns all deeper ones, so its first owned depth is
found by binary search: in each round, all conversations that are not settled ask for the owner of one prefix, in
one join. What it owns is a chain of nodes, and the chain hangs on the owner of the prefix just above it.

Chains are aggregated bottom-up. A chain's subtree is its own value and that of all chains that hang on it,
directly or not; each chain hands its sum on to a chain above and then doubles the distance, so the rounds are
the logarithm of the nesting. Inside a chain, what hangs on its nodes is summed up from its end.

No row carries a group: chains, hanging sums and nodes are rows with their own keys, hot keys are dealt out, and
sums are partial before they are shuffled. One value can't be split: the SHA-256 of a node's ids is one running
hash, so blocks of ids, joined in the tasks before, meet in one task in order, one at a time.

Defined results: rows without conv_id belong to no conversation and are left out; null role or text is empty; rows of
one turn order by a digest of role and text, so ties and repeated rows have one result; a conversation without
steps is a member of the root only; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.llm.running import digest, running
from evigrain.llm.shared import FEW, dealt_join, near_join, settled, table, words, written

#: So many ids have one base, and fewer than HEADS turns come from it.
BASE, HEADS = 20, 4
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), s1, s2 (a digest of role and text) and words, for each turn of each conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    s1, s2 = digest(role, text)
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", s1.alias("s1"), s2.alias("s2"), F.size(words(text)).cast("long").alias("words"), F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("id")
    )
    ranked = running(written(rows, "turns"), ["conv_id"], ["turn", "s1", "s2", "id"], sums=["one"])
    return written(ranked.select("conv_id", F.col("run_one").alias("place"), "s1", "s2", "words"), "places")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations, and their steps: the first h turns of conversation c - c % BASE, then c's own turns after its
    first h, where h is crc32 of c in decimal, modulo HEADS. % is SQL's, so bases of negative ids lie nearer to 0; at most
    2 * BASE conversations share a base."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    own = rows.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % BASE).alias("base"))
    heads = rows.filter(F.col("place") < HEADS).withColumnsRenamed({"conv_id": "base"})
    sizes = heads.groupBy("base").agg(F.max("place").alias("n"))
    convs = written(own.join(sizes, "base", "left").withColumn("n", F.least("h", F.coalesce("n", F.lit(0)))), "convs")
    first = convs.join(heads, "base").filter("place <= h").select("conv_id", F.col("place").alias("depth"), "s1", "s2", "words")
    rest = near_join(rows, convs.select("conv_id", "h", "n"), ["conv_id"]).filter("place > h")
    rest = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("n")).alias("depth"), "s1", "s2", "words")
    return convs.select("conv_id"), first.unionByName(rest)


def _asked(asked: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """The rows of asked, a written table of few numbers a row, with those of known, which has each key once."""
    return known.join(F.broadcast(asked), on) if asked.count() <= FEW else dealt_join(asked, known, on)


def chains(convs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """conv_id, first and last owned depth (first > last: none), and on: the owner of the node above the first.

    prefixes: conv_id, depth, p1, p2. The root's owner has first 0 and on null."""
    spark = convs.sparkSession
    minima = written(prefixes.groupBy("depth", "p1", "p2").agg(F.min("conv_id").alias("owner")), "minima")
    sizes = convs.join(prefixes.groupBy("conv_id").agg(F.max("depth").alias("last")), "conv_id", "left").withColumn("last", F.coalesce("last", F.lit(0)))
    sizes = written(sizes.select("conv_id", "last"), "sizes")
    least, longest = sizes.agg(F.min("conv_id"), F.max("last")).first()
    root = sizes.filter(F.col("conv_id") == F.lit(least)).select("conv_id", F.lit(0).cast("long").alias("first"), "last", F.lit(None).cast("long").alias("on"))
    open_ = sizes.filter(F.col("conv_id") != F.lit(least)).select("conv_id", F.lit(1).cast("long").alias("first"), "last", F.lit(least).cast("long").alias("on"), (F.col("last") + 1).alias("to"))
    for _ in range(int(longest or 0).bit_length()):
        open_ = settled(spark, lambda s=open_: _halved(s, prefixes, minima), "search")
    return written(open_.drop("to").unionByName(root), "chains")


def _halved(state: DataFrame, prefixes: DataFrame, minima: DataFrame) -> DataFrame:
    """One round: conversations whose first owned depth lies between first and to ask who owns the middle one."""
    asks = written(state.filter("first < to").withColumn("depth", F.expr("(first + to) div 2")), "asks")
    keyed = written(_asked(asks, prefixes.select("conv_id", "depth", "p1", "p2"), ["conv_id", "depth"]), "keyed")
    told = _asked(keyed, minima, ["depth", "p1", "p2"])
    mine = F.col("owner") == F.col("conv_id")
    after = told.select("conv_id", F.when(mine, F.col("first")).otherwise(F.col("depth") + 1).alias("first"), "last", F.when(mine, F.col("on")).otherwise(F.col("owner")).alias("on"), F.when(mine, F.col("depth")).otherwise(F.col("to")).alias("to"))
    return state.filter("first >= to").unionByName(after)


def subtrees(values: DataFrame, names: list[str]) -> DataFrame:
    """conv_id and, for each name, the sum over the chain and all chains that hang on it, directly or not.

    values: conv_id, on (the chain it hangs on or null) and the names."""
    spark = values.sparkSession
    state = written(values.select("conv_id", "on", *names), "sums")
    while not state.filter("on IS NOT NULL").isEmpty():
        state = settled(spark, lambda s=state: _doubled(s, names), "sums")
    return state.drop("on")


def _doubled(state: DataFrame, names: list[str]) -> DataFrame:
    handed = state.filter("on IS NOT NULL").groupBy("on").agg(*[F.sum(c).alias(f"more_{c}") for c in names])
    # Only chains on which others hang are asked for what they hang on.
    above = written(handed.withColumnRenamed("on", "conv_id").join(state.select("conv_id", F.col("on").alias("next")), "conv_id"), "above")
    moved = near_join(state, above.select(F.col("conv_id").alias("on"), "next"), ["on"], "left").drop("on").withColumnRenamed("next", "on")
    sums = [(F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).alias(c) for c in names]
    return moved.join(above.drop("next"), "conv_id", "left").select("conv_id", "on", *sums)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, depth, member) rows to blocks of ids: node, depth, part, number, ids."""
    part, number = TaskContext.get().partitionId(), 0
    for b in batches:
        rows = {}
        for node, depth, member in zip(b["node"].to_pylist(), b["depth"].to_pylist(), b["member"].to_pylist()):
            rows.setdefault((node, depth), []).append(member)
        out = [(n, d, part, number + i, ",".join(map(str, ids))) for i, ((n, d), ids) in enumerate(rows.items())]
        number += len(out)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)] if out else [[]] * 5, schema=pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("part", pa.int64()), ("number", pa.int64()), ("ids", pa.string())]))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks to one hash a node."""
    node, told, out = None, None, []
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    for b in batches:
        for n, d, ids in zip(b["node"].to_pylist(), b["depth"].to_pylist(), b["ids"].to_pylist()):
            if (n, d) == node:
                told.update(b",")
            else:
                if node is not None:
                    out.append((*node, told.hexdigest()))
                node, told = (n, d), hashlib.sha256()
            told.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=schema)
            out = []
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, told.hexdigest())], schema=schema)


def ends(chain: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of the nodes at which conversations end."""
    parts = int(chain.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    node = F.when(F.col("first") <= F.col("last"), F.col("conv_id")).otherwise(F.col("on"))
    rows = chain.select(node.alias("node"), F.col("last").alias("depth"), F.col("conv_id").alias("member"))
    order = ["node", "depth", "member"]
    blocks = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_joined, "node long, depth long, part long, number long, ids string")
    return blocks.repartition("node", "depth").sortWithinPartitions("node", "depth", "part", "number").mapInArrow(_hashed, "conv_id long, depth long, ends_sha256 string")


def trie(convs: DataFrame, steps: DataFrame) -> DataFrame:
    """All nodes of the trie of convs (conv_id, once each) with steps (conv_id, depth from 1, s1, s2, words)."""
    g1, g2 = digest(F.col("depth"), F.col("s1"), F.col("s2"))
    told = written(steps.select("conv_id", "depth", "words", g1.alias("g1"), g2.alias("g2")), "steps")
    prefixes = running(told, ["conv_id"], ["depth"], xors=["g1", "g2"])
    prefixes = written(prefixes.select("conv_id", "depth", "words", F.col("run_g1").alias("p1"), F.col("run_g2").alias("p2")), "prefixes")
    chain = chains(convs, prefixes)
    owns = F.col("first") <= F.col("last")

    # What hangs on which node: chains of their own and copies, which own nothing.
    kids = chain.filter(F.col("on").isNotNull() & owns).groupBy(F.col("on").alias("conv_id"), (F.col("first") - 1).alias("last")).agg(F.count("*").alias("kids"))
    valued = chain.join(kids, ["conv_id", "last"], "left")
    valued = valued.select("conv_id", "on", F.lit(1).cast("long").alias("convs"), (owns & F.col("kids").isNull()).cast("long").alias("leaves"))
    sums = subtrees(valued, ["convs", "leaves"])
    hang = chain.filter("on IS NOT NULL").join(sums, "conv_id").groupBy(F.col("on").alias("conv_id"), (F.col("first") - 1).alias("depth"))
    hang = hang.agg(F.sum("convs").alias("convs"), F.sum("leaves").alias("leaves"), F.sum(owns.cast("long")).alias("kids"))

    nodes = near_join(prefixes.select("conv_id", "depth", "words"), chain, ["conv_id"]).filter("depth >= first")
    top = chain.filter("first = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "first", "last", "on")
    nodes = nodes.unionByName(top).join(hang, ["conv_id", "depth"], "left").na.fill(0, ["convs", "leaves", "kids"])
    at_end = F.col("depth") == F.col("last")
    nodes = nodes.select(
        *("conv_id", "depth", "words", (-F.col("depth")).alias("back"), (F.col("kids") + (~at_end).cast("long")).alias("n_children"), (F.col("convs") + at_end.cast("long")).alias("convs")),
        *((F.col("leaves") + (at_end & (F.col("kids") == 0)).cast("long")).alias("leaves"), F.when(F.col("depth") == F.col("first"), F.col("on")).otherwise(F.col("conv_id")).alias("parent_conv_id")),
    )
    counted = running(written(nodes, "nodes"), ["conv_id"], ["back"], sums=["convs", "leaves"])
    counted = counted.select("conv_id", "depth", "back", "parent_conv_id", "n_children", F.col("run_convs").alias("n_convs"), F.col("run_leaves").alias("n_leaves"), ((F.col("run_convs") - 1) * F.col("words")).alias("saved"))
    counted = written(counted, "counted")

    whole = chain.join(counted.groupBy("conv_id").agg(F.sum("saved").alias("saved")), "conv_id", "left").na.fill(0, ["saved"])
    saved = subtrees(whole, ["saved"])
    hang = chain.filter("on IS NOT NULL").join(saved, "conv_id").groupBy(F.col("on").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.sum("saved").alias("more"))
    spared = counted.join(hang, ["conv_id", "depth"], "left").withColumn("saved", F.col("saved") + F.coalesce("more", F.lit(0))).drop("more")
    spared = running(written(spared, "spared"), ["conv_id"], ["back"], sums=["saved"])
    out = spared.join(ends(chain), ["conv_id", "depth"], "left")
    return out.select(
        *("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("run_saved").alias("saved_tokens")), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return settled(spark, lambda: trie(*rebuilt(turns(conversations))), "trie")


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda z: ascii(z)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""
#: Prefixes are strings of digests of 32 characters a step.
ORACLE = rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC} % {HEADS} AS h, conv_id - conv_id % {BASE} AS base FROM (SELECT DISTINCT conv_id FROM t)),
n AS (SELECT c.*, least(h, coalesce(b.n, 0)) AS taken FROM c LEFT JOIN (SELECT conv_id AS base, count(*) AS n FROM t GROUP BY 1) b USING (base)),
s AS (SELECT n.conv_id, place AS depth, role, text FROM n JOIN t ON t.conv_id = base AND place <= h UNION ALL SELECT n.conv_id, place - h + taken, role, text FROM n JOIN t USING (conv_id) WHERE place > h),
p AS (SELECT conv_id, depth, string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix, len(regexp_extract_all(text, '[^ 	-]+')) AS words FROM s
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
k AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY 1, 2),
kids AS (SELECT substr(prefix, 1, 32 * (depth - 1)) AS prefix, count(*) AS n FROM k WHERE depth > 0 GROUP BY 1),
up AS (SELECT substr(k.prefix, 1, 32 * i) AS prefix, sum((n_convs - 1) * words) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves FROM k LEFT JOIN kids USING (prefix), unnest(range(0, k.depth + 1)) AS u(i) GROUP BY 1),
ends AS (SELECT p.prefix, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM p JOIN (SELECT conv_id, max(depth) AS depth FROM p GROUP BY 1) USING (conv_id, depth) GROUP BY 1)
SELECT k.conv_id, k.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, k.n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, up.leaves::BIGINT AS n_leaves, up.saved::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM k JOIN up USING (prefix) LEFT JOIN kids USING (prefix) LEFT JOIN ends USING (prefix) LEFT JOIN k o ON k.depth > 0 AND o.depth = k.depth - 1 AND o.prefix = substr(k.prefix, 1, 32 * (k.depth - 1))
"""
