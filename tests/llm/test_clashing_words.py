"""Two words that every polynomial hash modulo 2**64 confuses: Thue-Morse words and their complements."""

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from evigrain.llm import backoff_lm, bpe, minhash_dedup, packing
from evigrain.llm.shingles import shingle_sets, similarity, span_hashes
from tests.llm.test_llm_queries import lm_brute, lm_equal, lm_rows

PATH = bpe.public_path()


def pair(n: int) -> tuple[str, str]:
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


SIZES = (1024, 2048, 4096)


@pytest.mark.parametrize("n", SIZES)
def test_they_do_clash(n):
    a, b = pair(n)
    data = np.frombuffer((a + b).encode(), np.uint8)
    h = span_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] == h[1] and a != b


@pytest.mark.parametrize("n", SIZES)
def test_bpe_and_packing(spark, n):
    library, texts = Tokenizer.from_file(PATH), list(pair(n))
    own = bpe.Vocabulary(bpe.tokenizer_file(PATH))
    ids, bounds = own.encoded(pa.array(texts))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    pieces = sorted(packing.packed(df, PATH, with_ids=True).collect(), key=lambda r: (r.doc_id, r.start))
    assert [[x for r in pieces if r.doc_id == d for x in r.ids] for d in (0, 1)] == [w + [1] for w in want]


@pytest.mark.parametrize("n", SIZES)
def test_minhash_links_nothing(spark, n):
    df = spark.createDataFrame(list(enumerate(pair(n))), "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minhash_dedup.grouped(df).collect()} == {(0, 0), (1, 1)}
    assert shingle_sets(pa.array([" ".join(pair(n))]), 1).counts.tolist() == [2]


@pytest.mark.parametrize("n", SIZES)
def test_lm_knows_them_apart(spark, n):
    a, b = pair(n)
    texts = {i: f"{a} common" for i in range(8)} | {9: f"{b} common", 2: f"{b} unheard"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    texts = {i: t if backoff_lm.held_out([i])[0] or i != 9 else f"{a} common" for i, t in texts.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got, want = lm_rows(backoff_lm.scored(df)), lm_brute(texts, backoff_lm.ORDER, backoff_lm.MU)
    assert lm_equal(got, want)
    held = [i for i in texts if backoff_lm.held_out([i])[0] and b in texts[i]]
    assert all(got[i][2] < got[i][1] for i in held)


def test_similarity_counts_words():
    a = ["a b c d e f", "x", "", "a b", "a b c a b c a b c", "q r s t u v w"]
    b = ["a b c d e g", "x", "", "a  B", "a b c a b c", "r s t u v w"]
    for k in (1, 2, 5):
        meet, union = similarity(pa.array(a), pa.array(b), k)

        def sets(t):
            w = t.lower().split()
            return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}

        assert meet.tolist() == [len(sets(x) & sets(y)) for x, y in zip(a, b)]
        assert union.tolist() == [len(sets(x) | sets(y)) for x, y in zip(a, b)]
