"""Operator 3, near-dedup of texts by fast similarity sketching, banding and exact verification.

1. A text's set of distinct word shingles is sketched with COORDINATES values. In round i every shingle is
   hashed to one bin and offers the value (i, hash); a bin keeps its least value, and rounds go on until all
   bins are full. After as many rounds as bins, round i serves bin i - COORDINATES with all shingles, so every
   bin fills. Few rounds suffice for a large set, and equal coordinates estimate the Jaccard similarity.
2. Texts with equal sets form a class. Classes meet in buckets: bands of ROWS coordinates. At similarity 0.8 a
   pair misses all bands with a chance of 3e-6.
3. Each class is compared with its bucket's centre, on full sets: a number of pairs in proportion to the
   classes, whatever the group sizes, which joins most of a group of near copies.
4. Only buckets with a class that isn't similar to the centre go on. Classes too few of whose shingles occur in
   any other class there are alone for certain. The others try a second centre, the one that shares most with
   its group. What is outside its component then meets only classes that share one of its rarest shingles
   outside that centre (see _missing). These bounds are exact: no link between bucket mates is lost.
5. Components of all confirmed links give the groups.

Sets are recomputed from the text for the classes that have a candidate; they are never stored for all
documents. Nothing about all documents reaches the driver.

What is exact: set sizes and the verification of a pair compare words as bytes (see shingles). Buckets and
bounds of steps 2 and 4 go by 64-bit hashes of shingles made from 128-bit digests of the words; texts are one
class if set size and a 128-bit digest of the set agree.

Hot keys: bucket joins are plain sort-merge joins of short rows, which Spark splits where a bucket is large; pairs
meet the text of their centre, and documents their class, in `dealt_join`, which deals hot keys over parts.

Defined results: texts without words (null, empty, blank) have an empty set and link with nothing; fewer words
than a shingle count as one shingle; texts with null ids link with nothing; rows that repeat an id are one
node, whatever their texts; an empty table gives no rows; other columns are not read by `grouped`.
`deduplicated` keeps the columns of its input and one row of each group: of the rows with the group's least
id the one with the least text; rows without an id or without words all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evigrain.llm.components import components
from evigrain.llm.shared import WORD, dealt_join, hot_keys, private, settled, table, written
from evigrain.llm.shingles import chunks, mix, shingle_sets, similarity

COORDINATES = 256
ROWS = 6
BANDS = COORDINATES // ROWS
SIMILAR = 80
#: Ids that may be broadcast: 8 bytes each.
FEW = 250_000
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def sketches(items: np.ndarray, bounds: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The sketches, one row of t values for each set of the bounds; an empty set's row stays full."""
    n = len(bounds) - 1
    out = np.full((n, t), _FULL)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    flat = out.ravel()
    live = items
    for i in range(2 * t):
        if not len(live):
            break
        h = mix(live + np.uint64((i + 1) * int(_STEP) & int(_FULL)))
        bins = (h & np.uint64(t - 1)).astype(np.int64) if i < t else np.int64(i - t)
        np.minimum.at(flat, owner * t + bins, (np.uint64(i) << np.uint64(54)) | (h >> np.uint64(10)))
        open_ = (out == _FULL).any(axis=1)[owner]
        live, owner = live[open_], owner[open_]
    return out


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = sketch.shape[1] // rows
    s = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _STEP
    for r in range(rows):
        key = mix(key ^ s[:, :, r]) * np.uint64(0xD1342543DE82EF95)
    return mix(key)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def features(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (k1, k2) and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            s = shingle_sets(b["text"], k)
            keys = band_keys(sketches(s.items, s.bounds)).view(np.int64)
            keys = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), keys.ravel())
            digest = [pa.array(lane.view(np.int64)) for lane in s.digest]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s.counts), *digest, keys], ["doc_id", "n_shingles", "k1", "k2", "bands"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def _wanted(docs: DataFrame, classes: DataFrame, ids: DataFrame, k: int, schema: str) -> DataFrame:
    """id and text, or items (the full set's hashes), of the classes with the given ids; each once.

    Up to FEW wanted rows are broadcast, so that no text is shuffled; more are joined by a shuffle. A text whose id
    another text has, too, is told by its set's digest."""
    items = "items" in schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            s = shingle_sets(b["text"], k)
            fits = (s.digest[0].view(np.int64) == b["k1"].to_numpy()) & (s.digest[1].view(np.int64) == b["k2"].to_numpy())
            value = pa.ListArray.from_arrays(s.bounds.astype(np.int32), s.items.view(np.int64)) if items else b["text"]
            yield pa.RecordBatch.from_arrays([b["id"], value], ["id", "items" if items else "text"]).filter(pa.array(fits))

    wanted = written(classes.select("id", "doc_id", "k1", "k2").join(ids.distinct(), "id", "left_semi"), "wanted")
    few = wanted.count() <= FEW
    texts = _texts(docs).join(F.broadcast(wanted) if few else wanted, "doc_id").select("id", "k1", "k2", "text")
    # A row that stands in the table several times gives its class several times; all but one of them go.
    return written(texts.mapInArrow(run, schema).dropDuplicates(["id"]), "wanted")


def full_sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id and its full shingle set, as hashes, for the given ids of classes."""
    return _wanted(docs, classes, ids, k, "id long, items array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, similar: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, word by word. pairs: a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(iter([batch])):
                meet, union = similarity(b["text"], b["other"], k)
                yield pa.RecordBatch.from_arrays([b["a"], b["b"]], ["a", "b"]).filter(pa.array(100 * meet >= similar * union))

    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    texts = _wanted(docs, classes, ids, k, "id long, text string")
    both = dealt_join(pairs, texts.select(F.col("id").alias("a"), "text"), ["a"])
    both = dealt_join(both, texts.select(F.col("id").alias("b"), F.col("text").alias("other")), ["b"], by=F.col("a"), hot=hot_keys(pairs.select("b")))
    return both.select("a", "b", "text", "other").mapInArrow(run, "a long, b long")


def _fits(similar: int):
    """Set sizes na and nb can belong to similar sets."""
    return (100 * F.col("na") >= similar * F.col("nb")) & (100 * F.col("nb") >= similar * F.col("na"))


def _shared(members: DataFrame, docs: DataFrame, classes: DataFrame, k: int, similar: int) -> DataFrame:
    """id, item, often, from_end, need: the members' shingles that occur in another member, the most frequent first.

    Similar sets x and y share at least need = s / (1 + s) * (|x| + |y|) shingles, and |y| is at least the least
    size in x's buckets and s * |x|. So the |x| - ceil(need) + 1 rarest shingles of x (from_end >= need) meet those
    of y, and a set of which fewer than `need` shingles occur in any other member is alone for certain."""
    ids = members.groupBy("id").agg(F.any_value("n").alias("n"), F.min("least").alias("least"))
    need = F.ceil(F.expr(f"{similar} * (n + greatest(least, ceil({similar} * n / 100))) / {100 + similar}"))
    item = full_sets(docs, classes, ids.select("id"), k).select("id", F.explode("items").alias("item"))
    often = item.groupBy("item").agg(F.count("*").alias("often")).filter("often > 1")
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("often"), F.desc("item")))
    return item.join(often, "item").withColumn("from_end", place).join(ids.select("id", need.alias("need")), "id")


def _missing(outside: DataFrame, members: DataFrame, shared: DataFrame, docs: DataFrame, classes: DataFrame, k: int, similar: int) -> DataFrame:
    """All pairs (a, b) across components that may be similar, of an x of `outside` and a member y of its buckets.

    For any set h, similar x and y share at least need - |x & h| shingles of x - h. With h the hub that is nearest
    to x, those are few and rare: x only meets members with one of its rarest ones, as many as the bound says (one
    at least). Where the bound is 0 or less, y is small, |y| <= |x & h| (1 + s) / s - |x|: x meets all of its
    buckets' members of such a size too."""
    pairs = outside.select(F.col("id").alias("x"), "hub").distinct()
    sets = full_sets(docs, classes, pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("hub").alias("id"))), k)
    both = pairs.join(sets.select(F.col("id").alias("x"), F.col("items").alias("own")), "x").join(sets.select(F.col("id").alias("hub"), F.col("items").alias("theirs")), "hub")
    nearest = both.select("x", F.array_except("own", "theirs").alias("out"), F.size("own").alias("n")).groupBy("x").agg(F.min_by(F.struct("out", "n"), F.size("out")).alias("c")).select("x", "c.*")
    about = outside.groupBy(F.col("id").alias("x")).agg(F.min("least").alias("least"), F.any_value("comp").alias("cx"))
    need = F.ceil(F.expr(f"{similar} * (n + greatest(least, ceil({similar} * n / 100))) / {100 + similar}"))
    x = written(nearest.join(about, "x").withColumn("inter", F.col("n") - F.size("out")).withColumn("beyond", F.greatest(need - F.col("inter"), F.lit(1))), "outside")

    often = shared.groupBy("item").agg(F.any_value("often").alias("often"))
    item = x.select("x", "n", "cx", "beyond", F.explode("out").alias("item")).join(often, "item")
    place = F.row_number().over(W.partitionBy("x").orderBy(F.desc("often"), F.desc("item")))
    rare = item.withColumn("place", place).filter("place >= beyond").select("x", "cx", F.col("n").alias("na"), "item")
    y = members.groupBy("id").agg(F.any_value("n").alias("nb"), F.any_value("comp").alias("cy"))
    met = rare.join(shared.select("id", "item").join(y, "id"), "item")
    small = x.select("x", "cx", F.col("n").alias("na"), F.floor(F.expr(f"inter * {100 + similar} / {similar} - n")).alias("most"))
    near = small.join(outside.select(F.col("id").alias("x"), "key").distinct(), "x").join(members.select("key", "id", F.col("n").alias("nb"), F.col("comp").alias("cy")), "key").filter("nb <= most")
    all_ = met.select("x", "id", "cx", "cy", "na", "nb").unionByName(near.select("x", "id", "cx", "cy", "na", "nb"))
    return all_.filter((F.col("cx") != F.col("cy")) & _fits(similar)).select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()


def _star(entries: DataFrame, centres: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b), a < b, of the given centres and members of their buckets."""
    pairs = entries.select("key", "id", F.col("n").alias("nb")).join(centres.select("key", "centre", F.col("n").alias("na")), "key")
    return pairs.filter((F.col("id") != F.col("centre")) & _fits(similar)).select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def groups(classes: DataFrame, docs: DataFrame, k: int, similar: int) -> DataFrame:
    """a, b: links of classes (id, doc_id, k1, k2, n, bands) whose components are those of all similar classes."""
    entries = classes.select("id", "n", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m > 1")
    entries = written(entries.join(shared, "key"), "entries")
    # Members of many large buckets differ little from the rest of their group: good first centres.
    score = entries.groupBy("id").agg(F.sum("m").alias("score"))
    centres = entries.join(score, "id").groupBy("key").agg(F.max_by(F.struct(F.col("id").alias("centre"), "n"), F.struct("score", "id")).alias("c")).select("key", "c.*")
    star = written(_star(entries, centres, similar), "pairs")
    links = written(confirmed(star, docs, classes, k, similar), "confirmed")

    # Buckets with a member that isn't similar to the first centre: the rest of the work is theirs.
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = entries.filter("m > 2").join(centres.select("key", "centre"), "key").filter("id <> centre")
    left = written(others.join(ends, (F.col("id") == F.col("a")) & (F.col("centre") == F.col("b")), "left_anti").select("key", "id", "n"), "left")
    members = entries.join(left.select("key").distinct(), "key", "left_semi").select("key", "id", "n", "least")
    shared = written(_shared(members, docs, classes, k, similar), "shared")
    close = shared.groupBy("id").agg(F.sum(F.log("often")).alias("close"), F.max(F.col("from_end") >= F.col("need")).alias("some")).filter("some")
    members = written(members.join(close, "id"), "members")
    # Second centres share the most with their group.
    hubs = members.groupBy("key").agg(F.max_by(F.struct(F.col("id").alias("centre"), "n"), F.struct("close", "id")).alias("c")).select("key", "c.*")
    second = written(_star(left.join(close, "id", "left_semi"), hubs, similar).join(star, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(written(confirmed(second, docs, classes, k, similar), "confirmed"))
    comp = settled(docs.sparkSession, lambda: components(links), "components")

    # A link that is still missing has an end x outside its bucket's hub's component.
    of = comp.withColumnRenamed("node", "id")
    members = written(members.join(of, "id", "left").select("key", "id", "n", "least", F.coalesce("component", "id").alias("comp")), "members")
    at = members.join(hubs.select("key", F.col("centre").alias("hub")), "key").join(of.select(F.col("id").alias("hub"), F.col("component").alias("hub_comp")), "hub", "left")
    outside = at.filter(F.col("comp") != F.coalesce("hub_comp", "hub"))
    rest = written(_missing(outside, members, shared, docs, classes, k, similar).join(star.unionByName(second), ["a", "b"], "left_anti"), "pairs")
    more = written(confirmed(rest, docs, classes, k, similar), "confirmed")
    return links.unionByName(more)


def grouped(docs: DataFrame, k: int = 5, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    feats = written(features(docs, k), "features")
    fine = feats.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = fine.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands"))
    classes = written(sets.select(F.monotonically_increasing_id().alias("id"), "*"), "classes")
    spark = docs.sparkSession
    links = settled(spark, lambda: groups(classes.withColumnRenamed("n_shingles", "n"), docs, k, similar), "links")
    keys = ["k1", "k2", "n_shingles"]
    rows = written(dealt_join(feats.drop("bands"), classes.select("id", *keys), keys, "left"), "rows")
    rows = rows.withColumn("id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("id")))
    # Different texts under one id are one node.
    several = rows.filter("id IS NOT NULL").groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("most")).filter("b < most").select("doc_id", "b")
    ties = rows.select("doc_id", F.col("id").alias("a")).join(several, "doc_id").filter("a > b").select("a", "b").distinct()
    comp = settled(spark, lambda: components(links.unionByName(ties)), "components")
    named = classes.select("id", "doc_id").join(comp, F.col("id") == F.col("node"), "left").select("id", "doc_id", F.coalesce("component", "id").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = named.join(least, "component").select("id", "component_id")
    out = dealt_join(rows.select("doc_id", "n_shingles", "id"), of, ["id"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, k: int = 5, similar: int = SIMILAR) -> DataFrame:
    """One row of each group, with all columns of docs: of the rows with the least id the one with the least text."""
    rows = settled(docs.sparkSession, lambda: grouped(docs, k, similar).filter("doc_id IS NOT NULL AND n_shingles > 0"), "grouped")
    dropped = rows.filter("NOT kept").select("doc_id").distinct()
    several = rows.filter("kept").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    word = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    state, = private(["_state"], docs.columns)
    marks = dropped.withColumn(state, F.lit("gone")).unionByName(several.withColumn(state, F.lit("several")))
    marked = dealt_join(docs, marks, ["doc_id"], "left", F.monotonically_increasing_id()).select(*docs.columns, F.when(word, F.col(state)).alias(state))
    one = marked.filter(F.col(state) == "several").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text", F.xxhash64(*docs.columns))).alias(state)).select(f"{state}.*")
    return marked.filter(F.col(state).isNull()).select(*docs.columns).unionByName(one)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, lambda: grouped(table(spark, sf_dir, "documents"), 4), "grouped")
