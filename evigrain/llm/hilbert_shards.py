"""Operator 10, sharding along a Hilbert curve.

Every row gets a point: a bucket of its source, a bucket of its language and its size on a log scale, with
BITS bits each. Rows are sorted by the point's index on the Hilbert curve and the sequence is cut into runs
of equal counts, so that a shard covers a compact part of all dimensions at once and a reader that filters
on any of them can skip shards: `manifest` holds for each shard which buckets of each dimension it has, as bits,
and `shards_with` names the shards that a value may be in. All steps are DataFrame functions.

The sort is Spark's range sort; a row's global place is its place within its partition plus the rows of the
partitions before it. Only the row count of each partition reaches the driver.

What holds: equal texts of one source and language lie side by side (ties on the curve go by size and text_crc32),
so they share a shard or two neighbouring ones; equal texts of different sources lie where their sources do. A
category's bucket is a hash: values that share one are read together, and neighbouring buckets have nothing in
common, unlike neighbouring sizes.

Defined results: a null text counts as empty (size 1); null source, language or id are values like any
other and sort first; equal rows are told apart by their place only; an empty table gives no rows; other
columns are carried along by `sharded`, whatever their names, but for `shard` and `slot`, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.llm.shared import private, settled, table, written

DIMS = 3
BITS = 6
N_SHARDS = 8


def curve_tables(n: int = DIMS) -> tuple[list[int], list[int]]:
    """The curve as an automaton: for state * 2**n + octant, the octant's rank on the curve and the next state.

    A state is a reflection (n bits) and a rotation (below n). Within a state the octants are visited in Gray
    code order; each visited octant tells how the curve is reflected and rotated inside it."""
    full = (1 << n) - 1
    turn = lambda x, k: ((x << (k % n)) | (x >> (n - k % n))) & full
    gray = lambda i: i ^ (i >> 1)
    rank_of = {gray(i): i for i in range(full + 1)}
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  trailing one bits
    ranks, nexts = [], []
    for state in range((full + 1) * n):
        flip, shift = divmod(state, n)
        for octant in range(full + 1):
            w = rank_of[turn(octant ^ flip, n - (shift + 1) % n)]
            start = 0 if w == 0 else gray(2 * ((w - 1) // 2))
            axis = 0 if w == 0 else (ones(w) if w % 2 else ones(w - 1)) % n
            ranks.append(w)
            nexts.append((flip ^ turn(start, shift + 1)) * n + (shift + axis + 1) % n)
    return ranks, nexts


def hilbert_index(*dims: Column, bits: int = BITS) -> Column:
    """The index on the curve of a point with non-negative integer coordinates below 2**bits."""
    n = len(dims)
    ranks, nexts = (F.array(*map(F.lit, t)) for t in curve_tables(n))

    def step(acc: Column, power: Column) -> Column:
        octant = sum((F.floor(d / power) % 2 * (1 << i) for i, d in enumerate(dims)), F.lit(0))
        at = (acc["s"] * (1 << n) + octant).cast("int")
        return F.struct((acc["h"] * (1 << n) + F.get(acc["r"], at)).cast("long").alias("h"), F.get(acc["n"], at).cast("int").alias("s"), acc["r"].alias("r"), acc["n"].alias("n"))

    powers = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s"), ranks.alias("r"), nexts.alias("n"))
    return F.aggregate(powers, start, step, lambda acc: acc["h"])


def bucket(column, bits: int = BITS) -> Column:
    """A category's bucket; null has one of its own kind. A reader finds a value's bucket the same way."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("\0")).cast("binary")), F.lit(1 << bits)).cast("int")


def log_scale(column: Column, bits: int = BITS) -> Column:
    """A positive size on a log scale; with BITS bits two steps for each doubling, up to the 2 GB that a string can have."""
    return F.floor(F.log2(column) * ((1 << bits) // 32)).cast("int")


def sharded(df: DataFrame, order: list[Column], n_shards: int = N_SHARDS) -> DataFrame:
    """df with shard and slot: rows in the given order, cut into n_shards runs whose counts differ by one at most."""
    spark = df.sparkSession
    own = [c for c in df.columns if c not in ("shard", "slot")]
    key, part, at, before, rank, to = private(["_order", "_part", "_at", "_before", "_rank", "_shard"], df.columns)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.select(*own, F.struct(*order).alias(key)).repartitionByRange(parts, key).sortWithinPartitions(key)
    placed = written(placed.select(*own, F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(at)), "sharded")
    total, offsets = 0, []
    for p, n in sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect()):
        offsets.append((p, total))
        total += n
    first = spark.createDataFrame(offsets, f"`{part}` int, `{before}` long")
    place = F.col(at) % F.lit(1 << 33) + F.col(before)
    ranked = placed.join(F.broadcast(first), part).withColumn(rank, place)
    ranked = ranked.withColumn(to, F.expr(f"`{rank}` * {n_shards} div {max(total, 1)}").cast("long"))
    opens = F.expr(f"(`{to}` * {total} + {n_shards - 1}) div {n_shards}")
    return ranked.select(*own, F.col(to).cast("int").alias("shard"), (F.col(rank) - opens).cast("long").alias("slot"))


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the point (x, y, z) of source, language and size, and its curve_index."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), bucket("source").alias("x"), bucket("lang").alias("y"))
    return rows.withColumn("z", log_scale(F.col("size"))).withColumn("curve_index", hilbert_index(F.col("x"), F.col("y"), F.col("z")))


def sharded_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    return sharded(points(docs), [F.col(c) for c in ("curve_index", "size", "text_crc32", "doc_id")], n_shards)


def manifest(shards: DataFrame) -> DataFrame:
    """shard, rows, bytes and, as bits, the buckets of each dimension that its rows have."""
    bits = [F.bit_or(F.expr(f"shiftleft(1L, {c})")).alias(c) for c in ("x", "y", "z")]
    return shards.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *bits)


def shards_with(told: DataFrame, dimension: str, at: Column) -> DataFrame:
    """The shards that may hold rows whose bucket of a dimension is `at`."""
    return told.filter(F.col(dimension).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), at)) != 0).select("shard")


def op10_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the law `rows`, along the curve."""
    out = settled(spark, lambda: sharded_documents(table(spark, sf_dir, "documents")), "shards")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index")
