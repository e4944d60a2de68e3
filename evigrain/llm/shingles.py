"""Words and word shingles of many texts at once, in numpy and Arrow.

All texts of a batch lie in one byte buffer; Arrow's dictionary encoding, which compares bytes, gives every word a
code, so within a batch equal codes are equal words. Between tasks a word is known by a 128-bit cryptographic
digest (BLAKE2b) in two lanes of 64 bits. A shingle's hash mixes one lane of its words' digests; whether two
shingles of one text are equal, and which shingles two texts share (`similarity`), is decided on codes, never on
hashes.

`span_hashes` hashes byte spans of any place and length quickly (a polynomial modulo 2**64). Long spans of a
certain structure clash under any such polynomial, so it only ever proposes; whoever uses it compares bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 21
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums of the bytes' values times powers of the base."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the byte spans [starts, ends) of data. Equal hashes only propose equal bytes."""
    sums = prefix_sums(data) if sums is None else sums
    return mix((sums[ends] - sums[starts]) * powers(len(data) + 1)[1][starts] + (ends - starts).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the n + 1 bounds of its values."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def byte_column(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The values that bounds cut out of data, as an Arrow column over these very buffers."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def chunks(batches: Iterator[pa.RecordBatch], name: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has `size` bytes of text at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        bounds = text_bytes(batch[name])[1]
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 bounds of each text's words."""
    inner = ~BLANKS[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    opens = inner.copy()
    opens[1:] &= ~inner[:-1] | first[1:-1]
    closes = inner.copy()
    closes[:-1] &= ~inner[1:] | first[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def coded_words(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of all texts (A-Z as a-z) as codes, the word of each code, and the n + 1 bounds of each text's words."""
    data, bounds = text_bytes(column)
    starts, ends, words = word_spans(data, bounds)
    coded = byte_column(_LOWER[data[~BLANKS[data]]], np.concatenate([[0], np.cumsum(ends - starts)])).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, words


def digests(words: list[bytes]) -> np.ndarray:
    """128 bits for each word, in two lanes."""
    return np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in words), np.uint64).reshape(-1, 2)


class Shingles(NamedTuple):
    """The distinct shingles of each text as sorted hashes, where each text's start, how many each text has, and a
    128-bit digest of each text's set."""

    items: np.ndarray
    bounds: np.ndarray
    counts: np.ndarray
    digest: np.ndarray


def _odd(k: int) -> list[np.uint64]:
    return [np.uint64(int(mix(np.array([i + 1], np.uint64))[0]) | 1) for i in range(k)]


def shingle_sets(column: pa.Array, k: int) -> Shingles:
    """The distinct shingles of k words of every text. A text of fewer words has its whole sequence as one shingle;
    a text without words has none. A-Z count as a-z. Counts are exact: neighbours with one hash are compared word by word."""
    codes, dictionary, words = coded_words(column)
    lanes = digests(dictionary.to_pylist())
    n, odd = len(words) - 1, _odd(k)
    size = max(0, len(codes) - k + 1)
    hashes = []
    for lane in (0, 1):
        h = lanes[codes, lane] if len(codes) else np.zeros(0, np.uint64)
        s = np.zeros(size, np.uint64)
        for i in range(k):
            s += h[i : i + size] * odd[i]
        hashes.append((h, mix(s)))
    first, second = hashes[0][1], hashes[1][1]
    places, counts, few = [], np.zeros(n, np.int64), []
    for d in range(n):
        a, b = int(words[d]), int(words[d + 1])
        if b - a >= k:
            places.append(a + np.argsort(first[a : b - k + 1]))
            counts[d] = b - k + 1 - a
        elif b > a:
            few.append(d)
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), counts)
    fresh = np.ones(len(at), bool)
    if len(at):
        twin = np.flatnonzero((first[at[1:]] == first[at[:-1]]) & (owner[1:] == owner[:-1])) + 1
        same = np.ones(len(twin), bool)
        for i in range(k):
            same &= codes[at[twin] + i] == codes[at[twin - 1] + i]
        fresh[twin[same]] = False
    at, owner = at[fresh], owner[fresh]
    one, two = first[at], second[at]
    if few:
        short = [[np.uint64(0)], [np.uint64(0)]]
        for lane in (0, 1):
            h = hashes[lane][0]
            short[lane] = [mix((h[words[d] : words[d + 1]] * np.array(odd[: words[d + 1] - words[d]], np.uint64)).sum(keepdims=True) + np.uint64(words[d + 1] - words[d]))[0] for d in few]
        owner = np.concatenate([owner, few])
        order = np.argsort(owner, kind="stable")
        owner, one, two = owner[order], np.concatenate([one, np.array(short[0], np.uint64)])[order], np.concatenate([two, np.array(short[1], np.uint64)])[order]
    counts = np.bincount(owner, minlength=n).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    sums = np.zeros((2, len(one) + 1), np.uint64)
    np.cumsum(mix(one ^ np.uint64(_BASE)), out=sums[0, 1:])
    np.cumsum(mix(two + np.uint64(_BASE)), out=sums[1, 1:])
    return Shingles(one, bounds, counts, sums[:, bounds[1:]] - sums[:, bounds[:-1]])


def similarity(a: pa.Array, b: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of texts (row i of a, row i of b) the sizes of intersection and union of their shingle sets,
    exactly: words are compared as bytes, and a shingle is numbered by its words' numbers, one word after another."""
    n = len(a)
    column = pa.concat_arrays([a, b])
    codes, _, words = coded_words(column)
    lengths = np.diff(words)
    full = lengths >= k
    size = np.where(full, lengths - k + 1, (lengths > 0).astype(np.int64))
    owner = np.repeat(np.arange(2 * n), size)
    at = np.repeat(words[:-1] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    number = np.repeat(np.where(full, k, lengths), size)
    base, taken = number.copy(), number
    for i in range(k):
        # Shorter sequences have their length as their first part, and -1 for the words that they lack.
        word = np.where(i < taken, codes[np.minimum(at + i, len(codes) - 1)] if len(codes) else 0, -1) + 1
        base = np.unique(base * (len(codes) + 2) + word, return_inverse=True)[1]
    if not len(base):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    many = int(base.max()) + 1
    keys = np.unique(((owner % n) * many + base) * 2 + owner // n) >> 1
    sizes = np.bincount(keys // many, minlength=n)
    meet = np.bincount(keys[1:][keys[1:] == keys[:-1]] // many, minlength=n)
    return meet, sizes - meet
