"""Operator 13, best-fit packing: a configuration linear program over the histogram of lengths.

Texts are encoded in the tasks: their words (no token reaches over white space, or from a letter into a mark) are told apart by Arrow's dictionary
encoding, the tokenizers library encodes each word that the task doesn't remember, and a text's ids are gathered
from those. A document's ids and END are cut into pieces of LENGTH; only the last one may be shorter. Pieces are
written once, with their place among the partition's pieces of their length.

Which pieces share a sequence depends on lengths alone, so the driver sees the histogram: LENGTH rows at most,
whatever the input's size. A configuration says how many pieces of each length a sequence holds. `program` covers
every length by fractions of configurations: each length has a weight that falls by a factor with the share of it
that is covered, and a knapsack by dynamic programming finds the configuration with the most weight around a piece of the
greatest length left (multiplicative weights). `rounded` takes the whole parts, and
then fills sequence by sequence, the longest piece left with what fits best around it. Both give configurations and
how often each is used; every length loses its last piece after a bounded number of them, so their number
doesn't grow with the input either.

The n-th piece of a length then has its place by arithmetic: the configurations' slots for that length lie one
after another, and n falls into one. n is the place in the partition plus the number of such pieces in partitions
before, a running sum over (length, partition). No row meets another, and nothing is sampled.

Defined results: null and empty texts are END alone; null or repeated ids are carried along row by row; a text may
hold the file's special tokens, which become their ids as in the library; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import itertools
import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrain.llm.bpe import public_path, tokenizer_file
from evigrain.llm.shared import near_join, table, written
from evigrain.llm.shingles import BLANKS, byte_column, chunks, text_bytes

LENGTH = 2048
END = 0
#: Bytes of words that a task remembers, and bytes of text that it encodes at once.
MEMORY, PORTION = 12 << 20, 8 << 20
#: A length that is covered whole weighs exp(-STEEP) of one that isn't covered at all.
STEEP = 0.3
#: Before that a token of a length l weighs 1 + TILT * l / LENGTH: pieces that fit in few places come first.
TILT = 0.5
#: No configuration covers more of a length at once.
SHARE = 0.5
#: Lengths that a knapsack chooses from.
CHOICE = 96

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Bytes that white space, then letters and marks are; a word is also cut before a mark that follows a letter.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
#: Words that the library gets as one line.
LINE = 512


class Encoder:
    """The tokenizers library's ids of whole columns; each word is encoded once as long as it is remembered.

    Words that normalisation leaves alone, of letters only, go to the library as lines without normalisation; a line
    in which it doesn't find as many word ends as words, and every other word, goes to it as it is."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        file = json.loads(source)
        vocabulary = file["model"]["vocab"]
        self.last = np.zeros(self.tokenizer.get_vocab_size(True) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        split = [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}]
        plain = file | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": split}, "truncation": None, "padding": None}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.ids, self.at, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        simple, other = [], []
        for w in new:
            text = w.decode()
            (simple if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text) else other).append(text)
        lines = [simple[i : i + LINE] for i in range(0, len(simple), LINE)]
        words, ids, n = [], [], []
        for line, e in zip(lines, self.plain.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
            told = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.last[told]) + 1
            if len(ends) != len(line) or ends[-1] != len(told):
                other += line
                continue
            words += line
            ids.append(told)
            n.append(np.diff(ends, prepend=0))
        rest = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        words += other
        n = np.concatenate([*n, np.fromiter(map(len, rest), np.int64, len(rest))])
        ids = np.concatenate([*ids, np.fromiter(itertools.chain.from_iterable(rest), np.uint32)])
        self.known.update(zip((w.encode() for w in words), range(len(self.n), len(self.n) + len(words))))
        self.held += sum(map(len, new))
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])
        self.n, self.ids = np.concatenate([self.n, n]), np.concatenate([self.ids, ids])

    def encoded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and its n + 1 bounds."""
        data, bounds = text_bytes(column)
        inner = ~BLANKS[data]
        # Special tokens, the only strings in which letter case counts, hold a bar.
        low = data if (data == ord("|")).any() else _LOWER[data]
        opens = np.zeros(len(data) + 1, bool)
        opens[bounds] = True
        opens = opens[:-1]
        opens[1:] |= ~inner[:-1] | (_MARK[low[1:]] & _LETTER[low[:-1]])
        starts = np.flatnonzero(opens & inner)
        first = np.searchsorted(starts, bounds)
        at = np.concatenate([[0], np.cumsum(inner)])[starts]
        own = low[inner]
        coded = byte_column(own, np.append(at, len(own))).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if self.held > MEMORY:
            self.forget()
        new = [w for w in distinct if w not in self.known]
        if new:
            self._learn(new)
        index = np.array([self.known[w] for w in distinct], np.int64)[coded.indices.to_numpy()] if distinct else np.zeros(0, np.int64)
        n = self.n[index]
        to = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[index] - (to - n), n) + np.arange(int(n.sum()))]
        return ids, np.concatenate([[0], to])[first]


_encoders: dict[int, Encoder] = {}


def encoder(source: str) -> Encoder:
    """A task's encoder; the worker keeps it for its next tasks."""
    if hash(source) not in _encoders:
        _encoders.clear()
        _encoders[hash(source)] = Encoder(source)
    return _encoders[hash(source)]


def cut(ids: np.ndarray, bounds: np.ndarray, length: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All ids with an end behind each document's; for each piece its document, number, start there and size."""
    n = np.diff(bounds) + 1
    out = np.full(int(n.sum()), end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
    count = -(-n // length)
    doc = np.repeat(np.arange(len(n)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return out, doc, piece, piece * length, np.minimum(length, n[doc] - piece * length)


def _pieces(source: str, batches: Iterator[pa.RecordBatch], with_ids: bool, length: int, end: int) -> Iterator[pa.RecordBatch]:
    coder, seen, part = encoder(source), np.zeros(length + 1, np.int64), TaskContext.get().partitionId()
    for b in chunks(batches, size=PORTION):
        ids, doc, piece, start, size = cut(*coder.encoded(b["text"]), length, end)
        to = np.cumsum(size)
        raw = ids.astype("<u4").tobytes()
        crc = [zlib.crc32(raw[4 * (t - n) : 4 * t]) for t, n in zip(to.tolist(), size.tolist())]
        order = np.argsort(size, kind="stable")
        run = size[order]
        opens = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, int)
        place = np.empty(len(size), np.int64)
        place[order] = np.arange(len(run)) - np.repeat(opens, np.diff(np.append(opens, len(run))))
        place += seen[size]
        seen += np.bincount(size, minlength=length + 1)
        columns = [b["doc_id"].take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(np.full(len(size), part), pa.int32()), pa.array(place)]
        names = [c.split()[0] for c in PIECES.split(", ")] + ["part", "place"]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(np.concatenate([[0], to]).astype(np.int32), ids.astype(np.int32)))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)


def knapsack(sizes: np.ndarray, values: np.ndarray, most: np.ndarray, room: int) -> np.ndarray:
    """How many of each size to take, at most so many, for the greatest value within room."""
    best, items, taken = np.zeros(room + 1), [], []
    for i, (s, v, m) in enumerate(zip(sizes.tolist(), values.tolist(), most.tolist())):
        m, k = min(m, room // s), 1
        while m > 0:
            k = min(k, m)
            w = k * s
            better = best[:-w] + k * v if w else best
            take = better > best[w:]
            best[w:][take] = better[take]
            items.append((i, k, w))
            taken.append((w, take))
            m, k = m - k, 2 * k
    out, at = np.zeros(len(sizes), np.int64), room
    for (i, k, w), (_, take) in zip(reversed(items), reversed(taken)):
        if at >= w and take[at - w]:
            out[i] += k
            at -= w
    return out


def program(count: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Fractions of configurations that cover each length's pieces once: (lengths, how many of each, how often).

    count[s] is the number of pieces of length s. Each configuration holds a piece of the greatest length that isn't
    covered yet, and around it what the knapsack finds among CHOICE lengths spread over all that are left."""
    sizes = np.flatnonzero(count)
    n = count[sizes].astype(float)
    price = sizes * (1 + TILT * sizes / length)
    covered = np.zeros(len(sizes))
    out = []
    while True:
        left = np.flatnonzero(covered < 1 - 1e-9)
        if not len(left):
            return out
        top = left[-1]
        whole = np.zeros(len(sizes), np.int64)
        room = int(length - sizes[top])
        pick = left[: np.searchsorted(sizes[left], room, "right")]
        if len(pick):
            pick = pick[np.unique(np.linspace(0, len(pick) - 1, min(CHOICE, len(pick))).astype(int))][::-1]
            most = np.minimum(length // sizes[pick], count[sizes[pick]]) - (pick == top)
            whole[pick] = knapsack(sizes[pick], price[pick] * np.exp(-STEEP * covered[pick]), most, room)
        whole[top] += 1
        used = np.flatnonzero(whole)
        a = whole[used]
        times = float(np.min(np.minimum(SHARE, 1 - covered[used]) * n[used] / a))
        covered[used] += times * a / n[used]
        out.append((sizes[used], a, times))


def rounded(count: np.ndarray, fractions: list[tuple[np.ndarray, np.ndarray, float]], length: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Configurations, and how often each is used, that hold every piece once."""
    left, out = count.copy(), []
    for sizes, a, x in fractions:
        times = int(min(np.floor(x + 1e-6), np.min(left[sizes] // a)))
        if times > 0:
            left[sizes] -= a * times
            out.append((sizes, a, times))
    while left.any():
        top = int(np.flatnonzero(left)[-1])
        room = length - top
        left[top] -= 1
        pick = np.flatnonzero(left[: room + 1])
        pick = pick[np.argsort(-(left[pick] * pick), kind="stable")[:CHOICE]]
        pick = pick[np.argsort(-pick)]
        a = knapsack(pick, pick.astype(float), left[pick], room) if room and len(pick) else np.zeros(len(pick), np.int64)
        left[top] += 1
        whole = np.zeros(length + 1, np.int64)
        whole[pick] = a
        whole[top] += 1
        sizes = np.flatnonzero(whole)
        times = int(np.min(left[sizes] // whole[sizes]))
        left[sizes] -= whole[sizes] * times
        out.append((sizes, whole[sizes], times))
    return out


def slots(plan: list[tuple[np.ndarray, np.ndarray, int]], length: int) -> dict[str, np.ndarray]:
    """For each length and configuration with it, in order of length: the first piece, the first sequence, how many
    a sequence holds, and where they begin there. first[length + 1] says where a length's rows start."""
    rows, base, seen = [], 0, np.zeros(length + 1, np.int64)
    for sizes, a, times in plan:
        begin = 0
        for s, k in zip(sizes.tolist(), a.tolist()):
            rows.append((s, int(seen[s]), base, k, begin))
            seen[s] += k * times
            begin += k * s
        base += times
    names = ("size", "piece", "sequence", "many", "begin")
    table = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return dict(zip(names, table)) | {"first": np.searchsorted(table[0], np.arange(length + 2))}


def placed(at: dict[str, np.ndarray], size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of the rank-th piece of each size."""
    order = np.lexsort((rank, size))
    row = np.empty(len(size), np.int64)
    # Per size, the last slot that starts at or before the piece.
    s, r = size[order], rank[order]
    for value in np.unique(s).tolist():
        here = slice(*np.searchsorted(s, [value, value + 1]))
        low, high = at["first"][value], at["first"][value + 1]
        row[order[here]] = low + np.searchsorted(at["piece"][low:high], r[here], "right") - 1
    inside = rank - at["piece"][row]
    many = at["many"][row]
    return at["sequence"][row] + inside // many, at["begin"][row] + inside % many * size


def packed(docs: DataFrame, path: str, with_ids: bool = False, length: int = LENGTH, end: int = END) -> DataFrame:
    """The pieces of all documents and their places in sequences, with the ids if asked for."""
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast(tokenizer_file(path))
    extra = ", ids array<int>" * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pieces(source.value, batches, with_ids, length, end)

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pieces = written(texts.mapInArrow(encode, f"{PIECES}, part int, place long{extra}"), "pieces")
    counts = written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    # One row a length: LENGTH at most.
    told = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    histogram = np.zeros(length + 1, np.int64)
    for r in told:
        histogram[r.length] = r.n
    plan = rounded(histogram, program(histogram, length), length)
    places = spark.sparkContext.broadcast(slots(plan, length))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = written(counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("base")), "base")
    ranked = near_join(pieces, base, ["length", "part"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b["length"].to_numpy()
            sequence, offset = placed(places.value, size, b["rank"].to_numpy())
            names = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    own = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
    rows = ranked.select(*own, (F.col("place") + F.col("base")).alias("rank"))
    return rows.mapInArrow(put, f"{PIECES}{extra}, sequence_id long, offset long")


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))
