"""Operator 6, packing by order-preserving dynamic programming.

The ids of a partition's documents, in their order, are one stream. Windows of at most LENGTH ids are cut out of
it, one after another; a cut may lie behind a document (free) or behind any sentence (SENTENCE). Only where two
such places lie more than a window apart, so that no window could reach from one to the other, every LATTICE-th
id between them is a place for a cut, too (HARD). With x the place of a candidate and f the least cost
up to it,

    f[j] = penalty[j] + min over i with x[j] - x[i] <= LENGTH of f[i] + LENGTH - (x[j] - x[i]),

so the minimum of f[i] + x[i] over a sliding range, which a monotone queue gives in constant time for each
candidate. A partition is worked off in runs of a bounded number of ids: all windows of a run but the last
are final, and its ids open the next run. So a task holds a run and one document, padding is lost once a
partition, and no shuffle is needed: partitions are those of the input (an input of many tiny partitions pads the
last window of each; coalesce it first).

Defined results: null and empty texts are the end id alone; documents of any length are cut over as many windows
as they need; null or repeated ids are carried along row by row; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.llm.bpe import PORTION, Vocabulary, loaded, public_path, tokenizer_file
from evigrain.llm.shared import table
from evigrain.llm.shingles import chunks

LENGTH = 2048
END = 1
SENTENCE, HARD = 4, 64
#: Hard cuts lie so many ids apart.
LATTICE = 64
RUN = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sentence_ends(v: Vocabulary) -> np.ndarray:
    """For each token, whether a sentence or line may end with it."""
    return np.array([t.rstrip(b" \"')").endswith((b".", b"!", b"?")) or b"\n" in t for t in v.tokens])


def candidates(ids: np.ndarray, bounds: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, ascending from 0, and their penalties. bounds: where documents end."""
    inner = np.flatnonzero(ends[ids]) + 1
    x = np.union1d(np.union1d(inner, bounds), [0])
    penalty = np.where(np.isin(x, bounds), 0, SENTENCE)
    wide = np.flatnonzero(np.diff(x) > length)
    if len(wide):
        more = np.concatenate([np.arange(x[i] + min(LATTICE, length), x[i + 1], min(LATTICE, length)) for i in wide.tolist()])
        order = np.argsort(np.concatenate([x, more]), kind="stable")
        x, penalty = np.concatenate([x, more])[order], np.concatenate([penalty, np.full(len(more), HARD)])[order]
    return x, penalty


def cuts(x: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> tuple[list[int], int]:
    """The ends of the windows with the least padding plus penalties, and that cost. Ties go to the longest window."""
    xs, ps = x.tolist(), penalty.tolist()
    back = [0] * len(xs)
    queue = deque([(0, 0)])
    last = 0
    place = 0
    for j in range(1, len(xs)):
        place = xs[j]
        low = place - length
        while xs[queue[0][1]] < low:
            queue.popleft()
        g, i = queue[0]
        back[j] = i
        last = g + length - place + ps[j]
        g = last + place
        while queue and queue[-1][0] > g:
            queue.pop()
        queue.append((g, j))
    out, j = [], len(xs) - 1
    while j > 0:
        out.append(xs[j])
        j = back[j]
    return out[::-1], last


class Packer:
    """The windows of one partition; documents go in, pieces come out."""

    def __init__(self, v: Vocabulary, first: int, with_ids: bool, length: int = LENGTH):
        self.v, self.ends, self.next, self.with_ids, self.length = v, sentence_ends(v), first, with_ids, length
        self.ids = np.zeros(0, np.uint32)
        #: Of the documents in self.ids: id, where it ends there, ids before that place that are gone, all its ids.
        self.doc, self.end, self.total = [], np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, batch: pa.RecordBatch) -> None:
        ids, bounds = self.v.encoded(batch["text"])
        n = np.diff(bounds) + 1
        to = np.cumsum(n)
        new = np.full(int(to[-1]), END, np.uint32)
        new[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
        self.end = np.concatenate([self.end, len(self.ids) + to])
        self.ids = np.concatenate([self.ids, new])
        self.doc += batch["doc_id"].to_pylist()
        self.total = np.concatenate([self.total, n])

    def pieces(self, final: bool) -> Iterator[pa.RecordBatch]:
        if not len(self.ids):
            return
        ends, _ = cuts(*candidates(self.ids, self.end, self.ends, self.length), self.length)
        ends = np.array(ends if final else ends[:-1], np.int64)
        if not len(ends):
            return
        stop = int(ends[-1])
        at = np.union1d(ends, self.end[self.end < stop])
        start = np.concatenate([[0], at[:-1]])
        doc = np.searchsorted(self.end, start, "right")
        window = np.searchsorted(ends, start, "right")
        opened = np.concatenate([[0], ends])[window]
        raw = self.ids[:stop].astype("<u4").tobytes()
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), at.tolist())]
        begun = self.end - self.total
        columns = [pa.array([self.doc[d] for d in doc.tolist()], pa.int64()), pa.array(start - begun[doc]), pa.array(at - start), pa.array(crc, pa.int64()), pa.array(self.total[doc]), pa.array(self.next + window), pa.array(start - opened)]
        names = [c.split()[0] for c in PIECES.split(", ")]
        if self.with_ids:
            columns.append(pa.ListArray.from_arrays(np.concatenate([[0], at]).astype(np.int32), self.ids[:stop].astype(np.int32)))
            names = [*names, "ids"]
        yield pa.RecordBatch.from_arrays(columns, names)
        self.next += len(ends)
        gone = int(np.searchsorted(self.end, stop, "right"))
        self.ids, self.doc, self.total, self.end = self.ids[stop:], self.doc[gone:], self.total[gone:], self.end[gone:] - stop


def packed(docs: DataFrame, path: str, with_ids: bool = False, length: int = LENGTH) -> DataFrame:
    """The pieces of all documents: which ids of which document lie where in which sequence, with the ids if asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(loaded(shared.value, False), TaskContext.get().partitionId() << 40, with_ids, length)
        for b in chunks(batches, size=PORTION):
            packer.add(b)
            if len(packer.ids) >= RUN:
                yield from packer.pieces(False)
        yield from packer.pieces(True)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_path())
