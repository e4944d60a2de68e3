"""Best-fit packing: the library's ids, whole pieces, gapless sequences, few sequences, edge cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from evigrain.llm import best_fit
from evigrain.llm.bpe import public_path, tokenizer_file

PATH = "word_bpe_49k.json"
HARD = [
    "", " \t\n", "It's WE'LL they're o'clock 'tis ''s", "a.b,c!d?e;f:g ... !!?? a.'s", "É é É ñ Ñ ﬁ İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ ß ẞ",
    "<|startoftext|>x<|endoftext|> <|ENDOFTEXT|> <|endoftext|", "١٢٣ 12ab34 x1y2 ½ ² 中文字符 한국어 ไทย", "a b c​d﻿e", "́a é a.́ ́", "😀😃 a😀b 👩‍👩‍👧", "x" * 5000, "\x00\x01\x1c\x1d\x85z",
]


@pytest.fixture(scope="module")
def coder():
    return best_fit.Encoder(tokenizer_file(public_path(PATH)))


def same(coder, texts):
    ids, bounds = coder.encoded(pa.array(texts, pa.string()))
    want = coder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids for e in want]


def test_hard_texts_have_the_librarys_ids(coder):
    same(coder, HARD)
    for text in HARD:
        coder.forget()
        same(coder, [text])
    draw = random.Random(7)
    marks = list(".,;:!?'|<>") + ["'s", "'T", "É", "é", "é", "́", "Σ", "σ", "İ", "ǅ", "ʼ", " ", "\n", " ", "a", "Bc", "xyz", "1", "中", "<|endoftext|>", "‍", "_"]
    same(coder, ["".join(draw.choices(marks, k=draw.randrange(1, 30))) for _ in range(4000)])


def packed(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, part int, place int, length string, sequence_id int")
    return best_fit.packed(df, public_path(PATH), **more).collect()


def check(pieces, length):
    """Each sequence is gapless from 0 and no longer than allowed."""
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for got in by.values():
        at = 0
        for offset, n in sorted(got):
            assert offset == at
            at += n
        assert at <= length
    return len(by)


def test_pieces_hold_all_ids_and_few_sequences(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    pieces = best_fit.packed(docs, public_path(PATH), with_ids=True).collect()
    used = check(pieces, 2048)
    tokenizer = best_fit.Encoder(tokenizer_file(public_path(PATH))).tokenizer
    total = 0
    by = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
    for r in docs.collect():
        want = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        total += len(want)
        got = sorted(by[r.doc_id], key=lambda p: p.piece)
        assert [p.piece for p in got] == list(range(len(got))) and [p.start for p in got] == list(range(0, len(want), 2048))
        assert [i for p in got for i in p.ids] == want
        assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and p.length == len(p.ids) for p in got)
    assert used <= -(-total // 2048) + 1


def exact(sizes, length):
    """The least number of sequences, by search."""
    best = len(sizes)

    def put(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(sizes):
            best = len(free)
            return
        for k in {f: j for j, f in enumerate(free) if f >= sizes[i]}.values():
            put(i + 1, free[:k] + [free[k] - sizes[i]] + free[k + 1 :])
        put(i + 1, free + [length - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    put(0, [])
    return best


def test_near_the_optimum_of_small_sets():
    draw = np.random.default_rng(3)
    over = 0
    for _ in range(40):
        sizes = draw.integers(1, 21, 10)
        count = np.bincount(sizes, minlength=21)
        plan = best_fit.rounded(count, best_fit.program(count, 20), 20)
        assert sum(t * np.bincount(s, a, 21) for s, a, t in plan).astype(int).tolist() == count.tolist()
        assert all((s * a).sum() <= 20 for s, a, _ in plan)
        over += sum(t for _, _, t in plan) - exact(sizes.tolist(), 20)
    assert 0 <= over <= 4


def test_edges(spark):
    assert packed(spark, []) == []
    long = "word " * 9000
    rows = [(1, None, 1, 1, "a", 1), (1, "", 1, 1, "a", 1), (None, "x", 1, 1, "a", 1), (7, long, 1, 1, "a", 1), (7, long, 1, 1, "a", 1)]
    got = packed(spark, rows)
    assert check(got, 2048) == 9
    assert sorted((str(p.doc_id), p.length) for p in got if p.doc_id != 7) == [("1", 1), ("1", 1), ("None", 2)]
    assert [p.length for p in sorted((p for p in got if p.doc_id == 7), key=lambda p: (p.piece, p.sequence_id))] == [2048] * 8 + [809] * 2


def test_one_length_only(spark):
    got = packed(spark, [(i, "a b c", 1, 1, "a", 1) for i in range(10)], length=10)
    assert check(got, 10) == 5
