"""Operator 7, byte-level BPE by speculation and verification.

A batch's texts are cut into words in numpy, on arrays of character classes; only distinct words that the task
has not met are encoded. For these, greedy longest match proposes tokens, for all words at once by hash
look-ups of byte spans. The proposal is the BPE result if and only if every token encodes to itself and every
adjacent pair of tokens, joined, encodes to that very pair; both are tested for all proposals at once against
tables of verdicts, which grow as pairs appear. Words with a failing test are merged exactly, with a heap.
Decoding gathers the tokens' bytes.

The tokenizer file is read once on the driver and broadcast; its size is checked (MAX_FILE bytes at most).

Defined results: null and empty texts have no tokens; a text may hold the file's special tokens, which become
their ids; words of any length are merged in n log n; rows are independent, so null or repeated ids and ties
are no matter; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.llm.shared import table
from evigrain.llm.shingles import byte_column, chunks, prefix_sums, span_hashes, text_bytes

MAX_FILE = 32 << 20
#: Bytes of the distinct words whose tokens a task remembers; beyond it, it starts anew.
MEMORY = 8 << 20
#: Bytes of text that are encoded at once.
PORTION = 1 << 19
#: Longer words (in bytes) are merged with the heap straight away: there, speculation gains nothing.
LONG = 48
SPACE, LETTER, NUMBER, OTHER = range(4)
NONE = 1 << 60
# The suffixes that the word pattern splits off after an apostrophe.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of every code point, as the word pattern sees it."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, out = "".join(map(chr, points)), np.full(0x110000, OTHER, np.uint8)
    at = np.array(points)
    for kind, pattern in ((SPACE, r"\p{White_Space}+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, text):
            out[at[m.start() : m.end()]] = kind
    return out


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the file: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, source: str, speculate: bool = True):
        self.speculate = speculate
        spec = json.loads(source)
        letters = byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.specials = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        tokens = [b""] * size
        for s, i in vocab.items():
            tokens[i] = raw(s)
        for s, i in self.specials.items():
            tokens[i] = s
        self.tokens = tokens
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.byte_ids = [vocab.get(c) for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.byte_array = np.array([-1 if x is None else x for x in self.byte_ids], np.int64)
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        self.pair_ranks = np.argsort(keys, kind="stable")
        self.pair_keys, self.rank_ids = keys[self.pair_ranks], np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        plain = np.array(sorted(vocab.values()))
        hashes = span_hashes(self.bytes, self.starts[plain], self.starts[plain] + self.lengths[plain])
        self.by_length = {}
        for n in sorted({*self.lengths[plain].tolist()}, reverse=True):
            own = np.flatnonzero(self.lengths[plain] == n)
            own = own[np.argsort(hashes[own])]
            self.by_length[n] = (hashes[own], plain[own])
        self.verdicts = (np.zeros(0, np.int64), np.zeros(0, bool))
        self.forget()

    def forget(self) -> None:
        #: Words as bytes, and their places below.
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.word_at, self.word_n, self.word_ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the pair of least rank first, the leftmost of equals; a heap over a linked list."""
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        after, before, get = [*range(1, n), -1], [*range(-1, n - 1)], self.merges.get
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[k]))
            if (h := before[i]) >= 0 and (m := get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, m[1], ids[h], new))
        return [x for x in ids if x >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of tokens its place among the sorted mergeable pairs' ranks, NONE if it can't merge."""
        keys = left.astype(np.int64) * len(self.tokens) + right
        k = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[k] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[k], NONE)

    def merged_all(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exact merging of many short words at once: token, word, step. Each word is a row; in each round all
        rows merge their pair of least rank, and rows without one are done."""
        out = []
        order = np.argsort(size, kind="stable")
        for part in np.array_split(order, max(1, len(order) // 20_000)):
            if not len(part):
                continue
            width = int(size[part].max())
            cols = np.arange(width)
            inside = cols < size[part][:, None]
            ids = np.where(inside, self.byte_array[data[np.minimum(starts[part][:, None] + cols, len(data) - 1)]], -1)
            ranks = self._ranks(ids[:, :-1], ids[:, 1:])
            word = part
            while True:
                best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(word), int)
                least = ranks[np.arange(len(word)), best] if ranks.shape[1] else np.full(len(word), NONE)
                done = least == NONE
                if done.any():
                    r, c = np.nonzero(ids[done] >= 0)
                    out.append((ids[done][r, c], word[done][r], c))
                    ids, ranks, word, best, least = (x[~done] for x in (ids, ranks, word, best, least))
                if not len(word):
                    break
                row = np.arange(len(word))
                ids[row, best] = self.rank_ids[least]
                shift = cols[None, :-1] + (cols[None, :-1] > best[:, None])
                ids = np.take_along_axis(ids, shift, 1)
                cols = cols[:-1]
                ranks = np.take_along_axis(ranks, np.minimum(shift[:, :-1], ranks.shape[1] - 1), 1)
                for at in (best - 1, best):
                    some = (at >= 0) & (at < ranks.shape[1])
                    ranks[row[some], at[some]] = self._ranks(ids[row[some], at[some]], ids[row[some], at[some] + 1])
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 3

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens, joined, encodes to itself; right -1: whether the left token does."""
        keys = left * (len(self.tokens) + 1) + right + 1
        new = np.setdiff1d(keys, self.verdicts[0])
        if len(new):
            a, b = np.divmod(new, len(self.tokens) + 1)
            parts = np.stack([a, np.maximum(b - 1, 0)], 1).ravel()
            used = np.stack([np.ones(len(a), int), (b > 0).astype(int)], 1).ravel()
            n = self.lengths[parts] * used
            to = np.cumsum(n)
            data = self.bytes[np.repeat(self.starts[parts] - (to - n), n) + np.arange(int(to[-1]))]
            size = n.reshape(-1, 2).sum(axis=1)
            starts = np.cumsum(size) - size
            short = np.flatnonzero(size <= LONG)
            token, word, step = self.merged_all(data, starts[short], size[short])
            count = np.bincount(short[word], minlength=len(new))
            told = count == 1 + (b > 0)
            wrong = np.where(step == 0, token != a[short[word]], token != b[short[word]] - 1)
            told[short[word[wrong]]] = False
            for i in np.flatnonzero(size > LONG).tolist():
                told[i] = self.merged(data[starts[i] : starts[i] + size[i]].tobytes()) == ([int(a[i])] if b[i] == 0 else [int(a[i]), int(b[i]) - 1])
            all_ = np.concatenate([self.verdicts[0], new])
            order = np.argsort(all_)
            self.verdicts = (all_[order], np.concatenate([self.verdicts[1], told])[order])
        return self.verdicts[1][np.searchsorted(self.verdicts[0], keys)]

    def _greedy(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longest matches from the left for all words: token, word and step, by word and step. Each byte is a token, so there always is one."""
        at, word, out = starts.copy(), np.arange(len(starts)), []
        sums, step = prefix_sums(data), 0
        while len(word):
            token = np.full(len(word), -1)
            left = ends[word] - at
            most = left.max()
            for n, (hashes, ids) in self.by_length.items():
                if n > most:
                    continue
                own = np.flatnonzero((token < 0) & (left >= n))
                if not len(own):
                    continue
                h = span_hashes(data, at[own], at[own] + n, sums)
                k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = hashes[k] == h
                token[own[hit]] = ids[k[hit]]
            out.append((token, word, np.full(len(word), step)))
            at = at + self.lengths[token]
            more = at < ends[word]
            at, word, step = at[more], word[more], step + 1
        token, word, step_ = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 3
        order = np.lexsort((step_, word))
        return token[order], word[order], step_[order]

    def _learn(self, new: list[bytes]) -> None:
        """Encode words that are not known yet."""
        size = np.array([len(w) for w in new], np.int64)
        raw, to = b"".join(new), np.cumsum(size)
        small = np.frombuffer(raw, np.uint8)
        good = (size <= LONG) & self.speculate
        short = np.flatnonzero(good)
        token, word, step = self._greedy(small, (to - size)[short], to[short])
        # A look-up goes by hash: what it proposed must be the word, byte by byte.
        if len(token):
            told = self.decoded(token)
            own = np.concatenate([[0], np.cumsum(size[short])])
            want = small[np.repeat((to - size)[short] - own[:-1], size[short]) + np.arange(int(own[-1]))]
            reach = np.bincount(word, self.lengths[token], len(short)).astype(np.int64)
            if len(told) == len(want) and np.array_equal(reach, size[short]):
                false = np.searchsorted(own, np.flatnonzero(told != want), "right") - 1
            else:
                false = np.arange(len(short))
            good[short[false]] = False
        word = short[word]
        fine = self._compatible(token, np.full(len(token), -1))
        pair = np.flatnonzero(word[1:] == word[:-1])
        good[word[~fine]] = False
        if len(pair):
            good[word[pair[~self._compatible(token[pair], token[pair + 1])]]] = False
        fits = good[word]
        parts = [(token[fits], word[fits], step[fits])]
        short = np.flatnonzero(~good & (size <= LONG))
        token, word, step = self.merged_all(small, (to - size)[short], size[short])
        parts.append((token, short[word], step))
        for i in np.flatnonzero(size > LONG).tolist():
            ids = self.merged(raw[to[i] - size[i] : to[i]])
            parts.append((np.array(ids), np.full(len(ids), i), np.arange(len(ids))))
        token, word, step = (np.concatenate(x) for x in zip(*parts))
        n = np.bincount(word, minlength=len(new))
        self.known.update(zip(new, range(len(self.word_n), len(self.word_n) + len(new))))
        self.held += len(raw)
        self.word_at = np.concatenate([self.word_at, len(self.word_ids) + np.cumsum(n) - n])
        self.word_n = np.concatenate([self.word_n, n])
        self.word_ids = np.concatenate([self.word_ids, token[np.lexsort((step, word))].astype(np.uint32)])

    def encoded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and its n + 1 bounds."""
        data, bounds = text_bytes(column)
        starts, special, first = words(data, bounds, self.specials)
        coded = byte_column(data, np.append(starts, len(data))).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if self.held > MEMORY:
            self.forget()
        new = [w for w in distinct if w not in self.known]
        if new:
            self._learn(new)
        index = np.array([self.known[w] for w in distinct], np.int64)[coded.indices.to_numpy()] if distinct else np.zeros(0, int)
        n = np.where(special >= 0, 1, self.word_n[index])
        to = np.cumsum(n)
        ids = self.word_ids[np.repeat(self.word_at[index] - (to - n), n) + np.arange(int(n.sum()))]
        if (special >= 0).any():
            ids[(to - n)[special >= 0]] = special[special >= 0]
        return ids, np.concatenate([[0], to])[first]

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, in one array."""
        n = self.lengths[ids]
        to = np.cumsum(n)
        return self.bytes[np.repeat(self.starts[ids] - (to - n), n) + np.arange(int(to[-1]) if len(to) else 0)]


def words(data: np.ndarray, bounds: np.ndarray, specials: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word starts (in bytes), its id if it is a special token (else -1), and the first word of each text, with the number of words last.

    The rule: an apostrophe and one of SUFFIXES; or a run of letters, of numbers or of others, each with the
    space before it; or white space up to the last one before a run, which stands alone unless it is a space."""
    raw = data.tobytes()
    marks = []
    for content, id_ in specials.items():
        at = raw.find(content)
        while at >= 0:
            text = int(np.searchsorted(bounds, at, "right"))
            if at + len(content) <= bounds[text]:
                marks.append((at, at + len(content), id_))
                at = raw.find(content, at + len(content))
            else:
                at = raw.find(content, at + 1)
    marks.sort()
    char_at = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    kind = char_classes()[points]
    opens = np.zeros(n + 1, bool)
    opens[np.searchsorted(char_at, bounds)] = True
    for a, b, _ in marks:
        opens[np.searchsorted(char_at, [a, b])] = True
    turns = opens[:-1].copy()
    turns[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(turns)
    end = np.append(run[1:], n)
    what = kind[run]
    last = opens[end]
    blank = what == SPACE
    begins = np.zeros(n, bool)
    begins[run[blank]] = True
    begins[end[blank & ~last] - 1] = True
    solid = ~blank
    held = solid & (run > 0) & ~opens[run] & (points[np.maximum(run - 1, 0)] == 32)
    begins[run[solid & ~held]] = True
    bare = np.flatnonzero((what[:-1] == OTHER) & (end[:-1] - run[:-1] == 1) & ~held[:-1] & ~last[:-1] & (what[1:] == LETTER) & (points[run[:-1]] == 39)) if len(run) > 1 else np.zeros(0, int)
    if len(bare):
        letter, stop = run[bare + 1], end[bare + 1]
        one = points[letter]
        two = np.where(letter + 1 < stop, points[np.minimum(letter + 1, n - 1)], 0)
        taken = np.zeros(len(bare), int)
        for s in SUFFIXES:
            fits = (one == ord(s[0])) if len(s) == 1 else (one == ord(s[0])) & (two == ord(s[1]))
            taken = np.where((taken == 0) & fits, len(s), taken)
        some = taken > 0
        begins[letter[some]] = False
        rest = (letter + taken)[some]
        begins[rest[rest < stop[some]]] = True
    for a, b, _ in marks:
        i, j = np.searchsorted(char_at, [a, b])
        begins[i:j] = False
        begins[i] = True
    starts = char_at[begins]
    special = np.full(len(starts), -1, np.int64)
    for a, _, id_ in marks:
        special[np.searchsorted(starts, a)] = id_
    return starts, special, np.searchsorted(starts, bounds)


_loaded: dict[tuple, Vocabulary] = {}


def loaded(source: str, speculate: bool = True) -> Vocabulary:
    """A task's vocabulary; the worker keeps it for its next tasks. Without speculation all new words are merged exactly."""
    key = (hash(source), speculate)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(source, speculate)
    return _loaded[key]


def tokenizer_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        source = f.read(MAX_FILE + 1)
    if len(source) > MAX_FILE:
        raise ValueError(f"{path} is larger than the {MAX_FILE} bytes that are broadcast")
    return source


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encode(v: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, size=PORTION):
        ids, bounds = v.encoded(b["text"])
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.ListArray.from_arrays(bounds.astype(np.int32), ids.astype(np.int32))], ["doc_id", "ids"])


def _digest(v: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the ids and of what they decode to."""
    for b in batches:
        at = b["ids"].offsets.to_numpy()
        ids = b["ids"].values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype("<u4")
        at = at - at[0]
        text = v.decoded(ids).tobytes()
        ends = np.concatenate([[0], np.cumsum(v.lengths[ids])])[at].tolist()
        raw = ids.tobytes()
        sha = lambda x: hashlib.sha256(x).hexdigest()
        told = [sha(text[i:j].decode(errors="replace").encode()) for i, j in zip(ends[:-1], ends[1:])]
        at = at.tolist()
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([j - i for i, j in zip(at[:-1], at[1:])], pa.int64()), pa.array([sha(raw[4 * i : 4 * j]) for i, j in zip(at[:-1], at[1:])]), pa.array(told)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encoded(df: DataFrame, path: str, column: str = "text") -> DataFrame:
    """doc_id and the ids of the column's texts."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_file(path))
    rows = df.select("doc_id", F.coalesce(column, F.lit("")).alias("text"))
    return rows.mapInArrow(lambda batches: _encode(loaded(shared.value), batches), "doc_id long, ids array<int>")


def decoded(df: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of column ids."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = loaded(shared.value)
        for b in batches:
            texts = [v.decoded(np.asarray(ids or [], np.int64)).tobytes().decode(errors="replace") for ids in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digested(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them, in one pass."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = loaded(shared.value)
        return _digest(v, _encode(v, batches))

    return df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(table(spark, sf_dir, "documents"), public_path())
