"""Operator 2, language-model scoring by a weighted backoff automaton.

Tokens are words (A-Z count as a-z) and one end per text. With c the counts in the training documents, N their
tokens, V the distinct ones, h' a history h without its first token, and MU a weight,

    P(w)   = (c(w) + 1) / (N + V + 1),
    P(w|h) = (c(hw) + MU * P(w|h')) / (c(h) + MU).

The automaton has a state for each history h of up to ORDER - 1 tokens that training has seen (the start of a text
counts as a token of histories), and the empty state. State h has an arc for each seen n-gram hw, of weight log10
P(w|h), to the longest suffix of hw that is a state, and one failure arc, of weight log10(MU / (c(h) + MU)), to the
state h'. The empty state has an arc for every word. Reading w in h takes the arc w, or else failure arcs until a
state has it. A text's score is the sum along its path.

The automaton is never whole in one place. The documents are written once as portions of about PORTION bytes. A
portion asks for its distinct words and n-grams, each in the bucket of its hash; a bucket adds up the counts of all
portions and answers each with the totals, in the order asked. With its answers a portion builds the part of the
automaton that its texts can reach, and one traversal from left to right, of all its texts side by side, carries
each text's state and adds up its weights. Long texts are cut into strides, each of which starts ORDER - 1 tokens
early in the empty state; that puts it into the state of a walk from the start. A frequent n-gram is one entry a
portion; the number of buckets grows with the text, so that a bucket's size doesn't.

Words are counted by their bytes, so n_tokens, n_known, train_tokens and base_score are exact; n-grams of two or
more words are counted by a 64-bit hash of their words' 128-bit digests. Counts are 64-bit integers. Everything is
counted over all documents.

Defined results: null and empty texts are the end token alone; a null doc_id counts as empty text and so as
training; rows that repeat an id are scored and counted row by row; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.llm.shared import table, written
from evigrain.llm.shingles import chunks, coded_words, digests, mix

ORDER = 3
MU = 300.0
PORTION = 8 << 20
PIECE = 1 << 20
#: Bytes of text for each bucket.
BUCKET = 4 << 20
#: Tokens of a text that are walked one after another.
STRIDE = 512
#: Stands for the end among the words; no word holds a blank.
END = b" "
_START = np.uint64(0x57A27)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def held_out(ids: list) -> np.ndarray:
    """Whether crc32 of the id as text leaves 2 modulo 7."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in ids], bool)


#: Portions are written, and shuffled once more: what packing them tighter takes is less than what moving them takes.
LEVEL = 7


def portions(docs: DataFrame) -> DataFrame:
    """portion, bytes and data: the rows in portions, each a compressed Arrow stream with a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part, size = TaskContext.get().partitionId() << 32, [], 0

        def closed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as w:
                for b in part:
                    w.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["portion", "bytes", "data"])

        for b in chunks(batches, size=PIECE):
            part.append(b)
            size += b["text"].nbytes
            if size >= PORTION:
                yield closed()
                number, part, size = number + 1, [], 0
        if part:
            yield closed()

    return docs.mapInArrow(run, "portion long, bytes long, data binary")


class Tokens:
    """A portion's tokens: word codes, the words of the codes, text bounds and ids."""

    def __init__(self, data: bytes):
        known: dict[bytes, int] = {END: 0}
        codes, counts, self.ids = [], [], []
        for b in pa.ipc.open_stream(data):
            code, dictionary, bounds = coded_words(b["text"])
            own = np.array([known.setdefault(w, len(known)) for w in dictionary.to_pylist()], np.int64)
            codes.append(np.insert(own[code] if len(code) else code, bounds[1:], 0))
            counts.append(np.diff(bounds) + 1)
            self.ids += b["doc_id"].to_pylist()
        self.words = list(known)
        self.code, self.bounds = np.concatenate(codes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        self.learn = np.repeat(~held_out(self.ids), np.diff(self.bounds))

    def grams(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 2 to `order`: the distinct n-grams, as ascending hashes, and of each token the place of the n-gram that
        ends with it, -1 where the text is too short. The start of a text can be an n-gram's first token."""
        lane = digests(self.words)[:, 0][self.code]
        at = np.arange(len(lane)) - np.repeat(self.bounds[:-1], np.diff(self.bounds))
        before = np.where(at > 0, np.roll(lane, 1), _START)
        whole = lane
        for n in range(2, order + 1):
            # What ends with the token before, and then the token.
            head = np.where(at > 0, np.roll(whole, 1), _START) if n > 2 else before
            whole = mix(mix(head * _ODD[0] + np.uint64(n)) + lane * _ODD[1])
            fits = at >= n - 2
            keys, place = np.unique(whole[fits], return_inverse=True)
            out = np.full(len(lane), -1)
            out[fits] = place
            yield keys, out


def _runs(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """Each bucket that occurs among ascending ones, and where it starts and ends."""
    at = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, int)
    return list(zip(bucket[at[:-1]].tolist(), at[:-1].tolist(), at[1:].tolist()))


def _gram_buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes, so ascending keys are in order of bucket."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _opened(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers, byte planes apart: those of small numbers are zero and compress to nothing."""
    return _squeezed(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T.tobytes())


def _numbers(data: bytes, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_opened(data), np.uint8).reshape(8, -1).T).view(kind).ravel()


def _packed(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data, np.uint64), dtype=np.uint64)


def _word_order(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The words by bucket, and their buckets."""
    bucket = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


ASKED = "kind int, bucket int, portion long, keys binary, counts binary"
ANSWERS = "portion long, kind int, bucket int, counts binary, tokens long, types long"


def _asks(t: Tokens, number: int, buckets: int, order: int) -> Iterator[list[tuple]]:
    """The rows of one portion, a kind after another."""
    to, bucket = _word_order(t.words, buckets)
    n = np.bincount(t.code[t.learn], minlength=len(t.words))[to]
    yield [(1, i, number, _squeezed(b"\n".join(t.words[k] for k in to[a:b].tolist())), _planes(n[a:b])) for i, a, b in _runs(bucket)]
    for kind, (keys, place) in enumerate(t.grams(order), 2):
        n = np.bincount(place[t.learn & (place >= 0)], minlength=len(keys))
        yield [(kind, i, number, _packed(keys[a:b]), _planes(n[a:b])) for i, a, b in _runs(_gram_buckets(keys, buckets))]


def asked(parts: DataFrame, buckets: int, order: int) -> DataFrame:
    """What each portion asks each bucket: distinct words (kind 1) and n-grams (kind n), with their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch["portion"].to_pylist(), batch["data"]):
                for rows in _asks(Tokens(data.as_buffer()), number, buckets, order):
                    for i in range(0, len(rows), 64):
                        columns = zip(*rows[i : i + 64])
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], [c.split()[0] for c in ASKED.split(", ")])

    return parts.select("portion", "data").mapInArrow(run, ASKED)


def answers(asks: DataFrame) -> DataFrame:
    """For each portion, kind and bucket the totals, in the order asked; once a bucket of words, its tokens and types."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("portion")
        kind, counts = int(pdf["kind"].iloc[0]), [_numbers(c) for c in pdf["counts"]]
        if kind == 1:
            column = pa.array([w for k in pdf["keys"] for w in _opened(k).split(b"\n")], pa.large_binary()).dictionary_encode()
            back, size = column.indices.to_numpy(), len(column.dictionary)
        else:
            u, back = np.unique(np.concatenate([_unpacked(k) for k in pdf["keys"]]), return_inverse=True)
            size = len(u)
        n = np.zeros(size, np.int64)
        np.add.at(n, back, np.concatenate(counts))
        once = np.zeros((2, len(pdf)), np.int64)
        if kind == 1:
            once[:, 0] = n.sum(), (n > 0).sum()
        told = [_planes(x) for x in np.split(n[back], np.cumsum([len(c) for c in counts])[:-1])]
        return pd.DataFrame({"portion": pdf["portion"], "kind": pdf["kind"], "bucket": pdf["bucket"], "counts": told, "tokens": once[0], "types": once[1]})

    return asks.groupBy("kind", "bucket").applyInPandas(add, ANSWERS)


class Automaton:
    """The part of the automaton that a portion's texts can reach.

    A state is a number: 0 for the empty one, and one for each distinct history. For each token and each length of
    history the arc that it would take is known by its n-gram's place, so an arc is looked up in constant time."""

    def __init__(self, t: Tokens, words: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray]], texts: int, n: int, v: int, mu: float):
        """words: totals by code; grams: for n-grams of 2, 3, ... tokens, each token's place and the totals by place."""
        first, size = t.bounds[:-1], len(t.code)
        places, totals = [t.code, *[p for p, _ in grams]], [words, *[c for _, c in grams]]
        self.low = np.log10((words + 1) / (n + v + 1))
        prob = [10**self.low]
        #: For each length of history, whether a token has an arc there, and its weight; by token, as arcs of equal n-grams are equal.
        self.seen, self.weight = [np.ones(size, bool)], [self.low[t.code]]
        #: For each length of history, whether what precedes a token is a state, and the weight of its failure arc.
        self.state, self.fail = [np.ones(size, bool)], [np.zeros(size)]
        below = prob[0][t.code]
        for k in range(1, len(places)):
            # How often a history was left: as often as it was read, and the start of a text once a text.
            left = np.zeros(size)
            has = places[k - 1][:-1] >= 0
            left[1:][has] = totals[k - 1][places[k - 1][:-1][has]]
            left[first] = texts if k == 1 else 0
            # Place -1 is the 0 at the end.
            count = np.append(totals[k], 0)[places[k]]
            below = (count + mu * below) / (left + mu)
            self.state.append(left > 0)
            self.seen.append(count > 0)
            self.fail.append(np.log10(mu / (left + mu)))
            self.weight.append(np.log10(below))
        self.bounds = t.bounds

    def walk(self, stride: int = STRIDE) -> np.ndarray:
        """The score of each text: strides of all texts side by side, from left to right, each with its state.

        A state is carried as the length of its history; the tokens before tell which one it is."""
        top = len(self.state) - 1
        n = np.diff(self.bounds)
        pieces = -(-n // stride)
        text = np.repeat(np.arange(len(n)), pieces)
        begin = self.bounds[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * stride
        end = np.minimum(begin + stride, self.bounds[1:][text])
        at = np.maximum(begin - top, self.bounds[:-1][text])
        # A text starts in the state of its start, a later stride in the empty state, some tokens early.
        held = np.where((at == begin) & (top > 0), np.minimum(top, 1) * self.state[min(top, 1)][at], 0)
        score, live = np.zeros(len(text)), np.arange(len(text))
        while len(live):
            token, length = at[live], held[live]
            weight = np.zeros(len(live))
            reads = np.arange(len(live))
            while len(reads):
                k, w = length[reads], token[reads]
                arc = np.zeros(len(reads), bool)
                for j in range(top + 1):
                    own = k == j
                    x, r = w[own], reads[own]
                    hit = self.seen[j][x]
                    arc[own] = hit
                    weight[r] += np.where(hit, self.weight[j][x], self.fail[j][x])
                length[reads[~arc]] -= 1
                reads = reads[~arc]
            counts = token >= begin[live]
            score[live] += np.where(counts, weight, 0)
            at[live] += 1
            more = at[live] < end[live]
            live, length = live[more], length[more]
            # The arc leads to the longest suffix of history and token that is a state.
            to = np.minimum(length + 1, top)
            for j in range(top, 0, -1):
                own = to == j
                to[own] -= ~self.state[j][at[live][own]]
            held[live] = to
        return np.bincount(text, score, len(n))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame, mu: float = MU, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    parts = written(portions(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))), "portions")
    size = parts.agg(F.sum("bytes")).first()[0] or 0
    buckets = 32 + size // BUCKET
    told = written(answers(asked(parts, buckets, order)), "answers")
    sums = told.agg(F.sum("tokens"), F.sum("types")).first()
    n, v = int(sums[0] or 0), int(sums[1] or 0)

    def run(texts: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
        t = Tokens(texts["data"].iloc[0])
        arcs = arcs.sort_values(["kind", "bucket"])
        totals = [np.concatenate([np.zeros(0, np.int64), *map(_numbers, arcs["counts"][arcs["kind"] == k])]) for k in range(1, order + 1)]
        words = np.empty(len(t.words), np.int64)
        words[_word_order(t.words, buckets)[0]] = totals[0]
        grams = [(place, total) for (_, place), total in zip(t.grams(order), totals[1:])]
        machine = Automaton(t, words, grams, int(words[0]), n, v, mu)
        add = lambda x: np.add.reduceat(x, t.bounds[:-1])
        return pd.DataFrame({"doc_id": pd.array(t.ids, "Int64"), "held_out": held_out(t.ids), "n_tokens": np.diff(t.bounds), "n_known": add((words[t.code] > 0).astype(np.int64)), "train_tokens": n, "base_score": add(machine.low[t.code]), "score": machine.walk()})

    return parts.select("portion", "data").groupBy("portion").cogroup(told.select("portion", "kind", "bucket", "counts").groupBy("portion")).applyInPandas(run, SCORES)


def op2_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
