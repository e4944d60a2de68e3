"""Operator 9, embedding near-dedup by an epsilon grid order join.

Cosine t on unit vectors is Euclidean distance eps = sqrt(2 - 2t), and an orthonormal projection never
lengthens a distance. So vectors of a label are sorted by their grid cells (width eps) on the leading
principal axes; the sequence is cut into blocks with bounding boxes. Linked vectors lie in equal or adjacent cells
of every axis, so blocks are paired by an equi-join on the cells of GRID axes that their vectors occupy, and stay
paired if their boxes on all axes are within eps. A pair of blocks is joined by halving both intervals of the
sequence again and again, skipping halves whose boxes are farther apart than eps, down to intervals whose
cosines are computed in double precision.

Equal vectors of a label are one class with a count before anything is joined. A pair of blocks gives at most
one row per class: how many vectors it links to, and the smallest class it is connected with inside the pair;
pairs of vectors are never written out. Components are then found over those.

The axes are fitted on a sample of at most SAMPLE classes; they decide the speed and never the result. Cells with
very many blocks, and vectors that very many rows have, are hot keys, which `dealt_join` deals over parts.

Defined results: vectors that are null, zero, or hold null or non-finite components, rows with a null label,
and rows with a null vec_id link with nothing and are their own component; vectors of different widths never
link; repeated rows are vectors of their own, but one vec_id is one node; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evigrain.llm.components import components
from evigrain.llm.shared import dealt_join, near_join, settled, table, written

COSINE = 0.93
SAMPLE = 4096
AXES = 8
#: Axes of the cells that blocks are paired by.
GRID = 3
BLOCK = 512
LEAF = 128
PARTNERS = 16
NEAR = 1e-12


def _axes(sample: list, n: int = AXES) -> dict[int, np.ndarray]:
    """By width: the leading principal axes of the sample's unit vectors, as rows."""
    by: dict[int, list] = {}
    for v in sample:
        x = np.asarray(v, float)
        by.setdefault(len(x), []).append(x / np.linalg.norm(x))
    return {d: np.linalg.eigh(np.cov(np.array(v).T).reshape(d, d) if len(v) > 1 else np.eye(d))[1].T[::-1][:n].copy() for d, v in by.items()}


def _projected(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    a = axes.get(x.shape[1], np.eye(x.shape[1])[:AXES])
    out = np.zeros((len(x), AXES))
    out[:, : len(a)] = x @ a.T
    return out


def _unit(rows: list | np.ndarray) -> np.ndarray:
    x = np.array(rows, float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed_cells(cells: np.ndarray) -> np.ndarray:
    """Cells of up to GRID axes as one number each, 21 bits an axis."""
    return ((cells.astype(np.int64) + (1 << 20)) << (21 * np.arange(cells.shape[1])[::-1])).sum(axis=1)


#: One cell and half of its neighbours, so that of two adjacent cells one is among these steps of the other.
_STEPS = np.array([s for s in itertools.product((-1, 0, 1), repeat=GRID) if s >= (0,) * GRID])


def width_of(eps: float) -> float:
    """The cells' width: eps, or wider where so many cells would not fit into 20 bits an axis."""
    return max(eps, 4e-6)


def placed(classes: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """classes with the cells of the leading axes, first axis first."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = b["embedding"].offsets.to_numpy()
            v, width = b["embedding"].values.to_numpy(), np.diff(ends)
            out = np.zeros((b.num_rows, AXES), np.int32)
            for d in np.unique(width).tolist():
                at = np.flatnonzero(width == d)
                out[at] = np.floor(_projected(_unit(v[ends[at][:, None] + np.arange(d)]), axes) / eps)
            cells = pa.ListArray.from_arrays(np.arange(0, out.size + 1, AXES, dtype=np.int32), out.ravel())
            yield pa.RecordBatch.from_arrays([*b.columns, cells], [*b.schema.names, "cells"])

    return classes.mapInArrow(cells, "cid long, label string, width int, embedding array<double>, rep long, n long, cells array<int>")


BLOCKS = "block long, label string, width int, cells array<long>, near array<long>, lo array<double>, hi array<double>, cids array<long>, reps array<long>, ns array<long>, data binary"


def blocks(sorted_classes: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """The sequence cut into blocks of at most BLOCK classes of one label and width."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for (label, width), g in pdf.groupby(["label", "width"], sort=False):
                for i in range(0, len(g), BLOCK):
                    h = g.iloc[i : i + BLOCK]
                    x = _unit(h["embedding"].tolist())
                    p = _projected(x, axes)
                    lo, hi = p.min(axis=0), p.max(axis=0)
                    own = np.unique(np.floor(p[:, :GRID] / eps).astype(np.int64), axis=0)
                    near = np.unique(_packed_cells((own[:, None, :] + _STEPS[None]).reshape(-1, GRID)))
                    out.append((int(h["cid"].iloc[0]), label, width, _packed_cells(own), near, lo, hi, h["cid"].to_numpy(), h["rep"].to_numpy(), h["n"].to_numpy(), x.tobytes()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return sorted_classes.mapInPandas(cut, BLOCKS)


def block_pairs(b: DataFrame, eps: float) -> DataFrame:
    """Pairs (a, b) with a <= b of blocks that may hold linked vectors: an equi-join on occupied cells, then the boxes' distance."""
    own = written(b.select("label", "width", F.explode("cells").alias("cell"), F.col("block").alias("x"), F.col("lo").alias("xlo"), F.col("hi").alias("xhi")), "cells")
    near = b.select("label", "width", F.explode("near").alias("cell"), F.col("block").alias("y"), "lo", "hi")
    gap = F.expr("aggregate(zip_with(zip_with(lo, xhi, (x, y) -> x - y), zip_with(xlo, hi, (x, y) -> x - y), (x, y) -> greatest(x, y, 0D)), 0D, (s, x) -> s + x * x)")
    met = dealt_join(own, near, ["label", "width", "cell"]).filter(gap <= eps * eps + 1e-9)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _join(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, i: slice, j: slice, t: float, eps2: float, found: list) -> None:
    """Find linked pairs between intervals i of x and j of y, halving both while their boxes are near."""
    a, b = p[i], q[j]
    gap = np.maximum(np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)), 0)
    if gap @ gap > eps2:
        return
    n, m = i.stop - i.start, j.stop - j.start
    if n <= LEAF and m <= LEAF:
        s = x[i] @ y[j].T
        for r, c in np.argwhere(np.abs(s - t) < NEAR):
            s[r, c] = math.fsum(x[i.start + r] * y[j.start + c])
        r, c = np.nonzero(s >= t)
        found.append((r + i.start, c + j.start))
        return
    halves = lambda k: [k] if k.stop - k.start <= LEAF else [slice(k.start, (k.start + k.stop) // 2), slice((k.start + k.stop) // 2, k.stop)]
    for u in halves(i):
        for v in halves(j):
            _join(x, y, p, q, u, v, t, eps2, found)


def linked(x: np.ndarray, y: np.ndarray | None, p: np.ndarray, q: np.ndarray | None, t: float, eps2: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows r of x and c of y (of x itself, r < c, if y is None) with cosine >= t."""
    found: list = []
    _join(x, x if y is None else y, p, p if q is None else q, slice(0, len(x)), slice(0, len(x if y is None else y)), t, eps2, found)
    r = np.concatenate([f[0] for f in found]) if found else np.zeros(0, int)
    c = np.concatenate([f[1] for f in found]) if found else np.zeros(0, int)
    return (r[r < c], c[r < c]) if y is None else (r, c)


def _least(n: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links r-c: the least node each is connected with."""
    label = np.arange(n)
    while True:
        before = label.copy()
        m = np.minimum(label[r], label[c])
        np.minimum.at(label, r, m)
        np.minimum.at(label, c, m)
        label = label[label]
        if np.array_equal(before, label):
            return label


def joined(pairs: DataFrame, b: DataFrame, axes: dict[int, np.ndarray], t: float) -> DataFrame:
    """cid, rep, links, least: for each pair of blocks and linked class, how many vectors of the other side it links to and the rep it hangs on."""
    eps2 = 2 - 2 * t + 1e-9
    numbered = pairs.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy("a").orderBy("b")) - 1) / PARTNERS))
    sides = numbered.select("a", "chunk", F.col("b").alias("block")).unionByName(numbered.filter("a <> b").select("a", "chunk", F.col("a").alias("block"))).distinct()
    # A block that is near very many others is dealt, and its vectors are copied to each part.
    rows = dealt_join(written(sides, "sides"), b.select("block", "width", "cids", "reps", "ns", "data"), ["block"])
    wants = numbered.groupBy("a", "chunk").agg(F.max(F.col("a") == F.col("b")).alias("self"))
    rows = rows.join(wants, ["a", "chunk"])

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf["a"].iloc[0]
        get = lambda k: (np.frombuffer(pdf["data"].iloc[k]).reshape(-1, int(pdf["width"].iloc[k])), np.asarray(pdf["cids"].iloc[k]), np.asarray(pdf["reps"].iloc[k]), np.asarray(pdf["ns"].iloc[k]))
        own = int(np.flatnonzero(pdf["block"].to_numpy() == a)[0])
        x, cid, rep, n = get(own)
        p = _projected(x, axes)
        out = []
        for k in range(len(pdf)):
            if k == own and not pdf["self"].iloc[0]:
                continue
            y, cid2, rep2, n2 = (None, cid[:0], rep[:0], n[:0]) if k == own else get(k)
            r, c = linked(x, y, p, None if y is None else _projected(y, axes), t, eps2)
            if not len(r):
                continue
            shift = 0 if y is None else len(x)
            cids, reps, ns = np.concatenate([cid, cid2]), np.concatenate([rep, rep2]), np.concatenate([n, n2])
            count = np.zeros(len(cids), np.int64)
            np.add.at(count, r, ns[c + shift])
            np.add.at(count, c + shift, ns[r])
            least = _least(len(cids), r, c + shift)
            at = np.flatnonzero(count)
            out.append(pd.DataFrame({"cid": cids[at], "rep": reps[at], "links": count[at], "least": reps[least[at]]}))
        return pd.concat(out) if out else pd.DataFrame({"cid": [], "rep": [], "links": [], "least": []}).astype("int64")

    return rows.groupBy("a", "chunk").applyInPandas(kernel, "cid long, rep long, links long, least long")


def deduplicated(vectors: DataFrame, t: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label)."""
    eps = math.sqrt(2 - 2 * t)
    # Adding 0 makes one zero of two.
    v = vectors.select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("embedding"), F.col("label").cast("string").alias("label"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = v.filter(fine).withColumn("h", F.xxhash64("embedding"))
    grouped = good.groupBy("label", "h", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = written(grouped.select(F.monotonically_increasing_id().alias("cid"), "label", F.size("embedding").alias("width"), "embedding", "rep", "n", "h"), "classes")
    axes = _axes([r[0] for r in classes.select("embedding").orderBy(F.xxhash64("cid")).limit(SAMPLE).collect()])
    keys = ["label", "width", "cells", "cid"]
    parts = int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = placed(classes.drop("h"), axes, width_of(eps)).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    b = written(blocks(order, axes, width_of(eps)), "blocks")
    found = written(joined(written(block_pairs(b, eps), "block_pairs"), b, axes, t), "joined")
    # A vec_id is one node, whatever its rows hold.
    linked_reps = found.filter("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    comps = settled(v.sparkSession, lambda: components(linked_reps.unionByName(_ties(good, classes))), "components")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    of = classes.join(links, "cid", "left").join(comps, F.col("rep") == F.col("node"), "left")
    of = of.select("label", "h", F.col("embedding").alias("own"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # Two vectors of one hash are told apart by their components.
    same = dealt_join(good, of, ["label", "h"], by=F.monotonically_increasing_id()).filter("embedding = own").select("vec_id", "n_links", "component_id")
    alone = v.filter(~fine).select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))
    out = same.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _ties(good: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the reps of classes whose rows share a vec_id."""
    again = written(good.groupBy("vec_id").count().filter("count > 1").select("vec_id"), "again")
    rows = near_join(good, again, ["vec_id"], "left_semi")
    rows = dealt_join(rows, classes.select("label", "h", F.col("embedding").alias("own"), "rep"), ["label", "h"]).filter("embedding = own").select("vec_id", "rep").distinct()
    least = rows.groupBy("vec_id").agg(F.min("rep").alias("b"))
    return rows.select("vec_id", F.col("rep").alias("a")).join(least, "vec_id").filter("a > b").select("a", "b")


def op9_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, lambda: deduplicated(table(spark, sf_dir, "embeddings")), "linked")
