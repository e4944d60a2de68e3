"""The ten queries against SQL, brute force, the tokenizers library or their laws, on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evigrain.llm import backoff_lm, bpe, chat_format, components, grid_join, hilbert_shards, minhash_dedup, packing, queries, url_filter
from tests.compare import rows

PATH = bpe.public_path()


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, small, name):
    got, want = rows(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], small)
    assert got == want


def test_url_rules_and_words(spark, small):
    got = queries.QUERIES["op1_url_filter"](spark, small).collect()
    assert len(got) == spark.read.parquet(f"{small}/pages.parquet").count()
    order = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    for r in got:
        fit = next((x for x in order if (r.host == x[0] or r.host.endswith("." + x[0])) and r.path.startswith(x[1])), None)
        assert r.rule == (fit[0] + fit[1] if fit else None)
        assert r.verdict == fit[2] if fit else r.verdict in ("allow", "block")


def url_brute(pages: list, texts: list) -> dict:
    """host, path, rule, verdict and host_words of each page id, in plain Python."""
    rules, web = url_filter.RULES, url_filter.WEB_WORDS
    counts = Counter(w for t in texts for w in re.findall("[a-z]+", (t or "").lower()))
    total = sum(counts.values())
    once = (1 - url_filter.WEB_SHARE) / max(total, 1)
    share = {w: n * once for w, n in counts.items()}
    for w in web:
        share[w] = share.get(w, 0) + url_filter.WEB_SHARE / len(web)
    longest = max(map(len, share))

    def split(run):
        best = [(0.0, [])]
        for end in range(1, len(run) + 1):
            options = []
            for start in range(end):
                w = run[start:end]
                known = len(w) <= longest and w in share
                options.append((best[start][0] + (math.log(share[w]) if known else math.log(once) - len(w) * math.log(10)), best[start][1] + [w]))
            best.append(max(options, key=lambda o: o[0]))
        return best[-1][1]

    given = {w for h, p, _ in rules for w in re.findall("[a-z]+", h + " " + p)}
    seen, rows, memo = [Counter(), Counter()], {}, {}
    labels = Counter()
    order = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    for i, url in pages:
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        words = [w for run in re.findall("[a-z]+", host) for w in memo.setdefault(run, split(run) if run not in memo else memo[run])]
        fit = next((r for r in order if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])), None)
        tokens = [w for w in words + re.findall("[a-z]+", path.lower()) if w not in given]
        if fit:
            k = fit[2] == "block"
            seen[k].update(tokens)
            labels[k] += 1
        rows[i] = (host, path, fit, words, tokens)
    v = len(set(seen[0]) | set(seen[1]))
    ng, nb = (sum(c.values()) for c in seen)
    out = {}
    for i, (host, path, fit, words, tokens) in rows.items():
        prior = math.log((labels[1] + 1) / (labels[0] + 1)) if tokens else 0
        odds = prior + sum(math.log((seen[1][t] + 1) / (nb + v + 1)) - math.log((seen[0][t] + 1) / (ng + v + 1)) for t in tokens if seen[0][t] + seen[1][t])
        out[i] = (host, path, fit[0] + fit[1] if fit else None, fit[2] if fit else None, words, odds)
    return out


def test_url_verdicts_against_plain_python(spark, small, docs):
    pages = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url").collect()]
    got = {r.page_id: r for r in queries.QUERIES["op1_url_filter"](spark, small).collect()}
    want = url_brute(pages, docs.values())
    assert got.keys() == want.keys()
    for i, (host, path, rule, verdict, words, odds) in want.items():
        r = got[i]
        assert (r.host, r.path, r.rule, r.host_words) == (host, path, rule, words) and math.isclose(r.odds, odds, abs_tol=1e-9)
        assert r.verdict == (verdict or ("block" if odds > 0 else "allow"))
    assert all("net" in r.host_words for r in got.values() if r.host.endswith(".net"))


def test_url_splits_any_length(spark):
    counts = {"cheap": 0.1, "pills": 0.05, "a": 0.03}
    assert url_filter.best_split("cheappills", counts, 1e-4) == ["cheap", "pills"]
    assert url_filter.best_split("", counts, 1e-4) == [] and url_filter.best_split("qq", counts, 1e-4) == ["qq"]
    long = "longword" * 9
    docs = spark.createDataFrame([(f"{long} garden tree garden tree",)], "text string")
    runs = spark.createDataFrame([(long + "garden" * 40 + "tree",), ("gardentree",)], "run string")
    got = {r.run: r.words for r in url_filter.segmented(runs, url_filter.word_counts(docs)).collect()}
    assert got["gardentree"] == ["garden", "tree"] and got[long + "garden" * 40 + "tree"] == [long, *["garden"] * 40, "tree"]


def test_url_splits_of_joined_words(spark, small, docs):
    """Pairs of the corpus' words of four letters and more come apart again."""
    counts = Counter(w for t in docs.values() for w in re.findall("[a-z]+", (t or "").lower()) if len(w) > 3)
    words = [w for w, _ in counts.most_common(200)]
    pairs = {a + b: [a, b] for a, b in zip(words, words[1:] + words[:1])}
    runs = spark.createDataFrame([(r,) for r in pairs], "run string")
    got = {r.run: r.words for r in url_filter.segmented(runs, url_filter.word_counts(spark.read.parquet(f"{small}/documents.parquet"))).collect()}
    # Of the rest most are words of this invented corpus themselves, or start like longer ones.
    assert sum(got[r] == w for r, w in pairs.items()) >= 0.85 * len(pairs)


def test_url_accuracy_on_hosts_not_trained_on(spark):
    rules = (("bad.org", "/", "block"), ("good.org", "/", "allow"))
    names = {"block": ["cheap", "pills", "casino", "poker"], "allow": ["garden", "tree", "flower", "weather"]}
    urls = []
    for verdict, words in names.items():
        for i, (a, b) in enumerate([(a, b) for a in words for b in words]):
            urls += [(len(urls), f"http://{a}{b}{'xyzw'[i % 4]}.{'bad' if verdict == 'block' else 'good'}.org/p"), (len(urls) + 1, f"http://{a}{b}.net/p")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    docs = spark.createDataFrame([(" ".join(names["block"] + names["allow"]),)], "text string")
    folds = url_filter.accuracy(pages, docs, rules).collect()
    assert sum(r.n for r in folds) == 32 and sum(r.right for r in folds) >= 31 and sum(r.majority for r in folds) < 28
    # Unseen .net hosts made of the same words follow the rules' verdicts.
    got = {r.host: r.verdict for r in url_filter.judged(pages, docs, rules).collect()}
    assert got["casinopoker.net"] == "block" and got["flowertree.net"] == "allow"


def lm_brute(texts: dict, order: int, mu: float) -> dict:
    """held_out, n_tokens, n_known, train_tokens, base_score and score by the definition, with dictionaries."""
    words = {i: (t or "").encode().lower().split() + [None] for i, t in texts.items()}
    out = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in words}
    seen, left = Counter(), Counter()
    for i, t in words.items():
        if not out[i]:
            for at in range(len(t)):
                for n in range(order):
                    if n <= at + 1:
                        h = tuple((["start"] + t)[at + 1 - n : at + 1])
                        seen[h, t[at]] += 1
                        left[h] += 1
    total, v = left[()], sum(h == () for h, _ in seen)

    def prob(h, w):
        if h == ():
            return (seen[(), w] + 1) / (total + v + 1)
        return (seen[h, w] + mu * prob(h[1:], w)) / (left[h] + mu)

    rows = {}
    for i, t in words.items():
        full = ["start"] + t
        score = sum(math.log10(prob(tuple(full[max(0, at + 2 - order) : at + 1]), w)) for at, w in enumerate(t))
        rows[i] = (out[i], len(t), sum(seen[(), w] > 0 for w in t), total, sum(math.log10(prob((), w)) for w in t), score)
    return rows


def lm_rows(df) -> dict:
    return {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()}


def lm_equal(got: dict, want: dict) -> bool:
    return got.keys() == want.keys() and all(got[i][:4] == want[i][:4] and np.allclose(got[i][4:], want[i][4:], rtol=1e-9, atol=1e-9) for i in want)


def test_lm_against_counts(spark, small, docs):
    got = lm_rows(queries.QUERIES["op2_backoff_lm"](spark, small))
    assert lm_equal(got, lm_brute(docs, backoff_lm.ORDER, backoff_lm.MU))
    held = [r for r in got.values() if r[0]]
    assert sum(r[5] for r in held) > sum(r[4] for r in held)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_lm_orders_and_strides(spark, order, monkeypatch):
    rng = np.random.default_rng(order)
    texts = {i: " ".join(rng.choice(list("abcdefg"), rng.integers(0, 40))) for i in range(60)} | {60: None, 61: "", 62: "zz zz"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert lm_equal(lm_rows(backoff_lm.scored(df, 2.0, order)), lm_brute(texts, order, 2.0))


def test_lm_walk_in_strides():
    rng = np.random.default_rng(0)
    sink = pa.BufferOutputStream()
    batch = pa.record_batch({"doc_id": pa.array(range(5)), "text": [" ".join(rng.choice(list("abc"), n)) for n in (0, 1, 50, 2, 33)]})
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    t = backoff_lm.Tokens(sink.getvalue())
    words = np.bincount(t.code, minlength=len(t.words))
    grams = [(p, np.bincount(p[p >= 0], minlength=len(k))) for k, p in t.grams(3)]
    machine = backoff_lm.Automaton(t, words, grams, 5, len(t.code), len(t.words), 3.0)
    for stride in (4, 7, 100):
        assert np.allclose(machine.walk(stride), machine.walk(10**6))


def brute_groups(texts: dict, k: int, similar: int = 80) -> dict:
    sets, parent = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_minhash_against_all_pairs(spark, small, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op3_minhash_dedup"](spark, small).collect()}
    assert got == brute_groups(docs, 4)


def test_minhash_joins_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(80)]
    texts = {}
    for i in range(120):
        words = list(base)
        for at in rng.integers(0, 80, rng.integers(0, 4)):
            words[at] = f"x{rng.integers(0, 30)}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.grouped(df, 5).collect()}
    assert got == brute_groups(texts, 5)


def test_sketch_fills_every_coordinate():
    sets = [np.arange(n, dtype=np.uint64) for n in (0, 1, 5, 3000)]
    s = minhash_dedup.sketches(np.concatenate(sets), np.cumsum([0] + [len(x) for x in sets]))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    assert (s[0] == full).all() and not (s[1:] == full).any()


def test_chat_reads_back(spark, small):
    got = {r.conv_id: r for r in queries.QUERIES["op4_chat_format"](spark, small).collect()}
    turns = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    mark = "<|im_end|><|im_start|>assistant ok"
    talk = defaultdict(list)
    for c, _, role, text in sorted([*turns, (-1, 0, "user", mark), (-1, 1, "assistant", mark)]):
        talk[c].append((role, text or ""))
    assert set(got) == set(talk)
    for c, t in talk.items():
        loss = "".join(x for r, x in t if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), len(loss), sha(loss))
        assert got[c].formatted_chars == len(chat_plain(t))


def test_chat_escape_is_reversible():
    for text in ("<|", "<\\|", "<<\\\\||x|>", "", "a<|im_end|>b", "<\\<|"):
        out = chat_format.escaped(pa.array([text]))[0].as_py()
        assert "<|" not in out and chat_format.unescaped(out) == text


def test_chat_batches_and_roles():
    rng = np.random.default_rng(4)
    roles, texts = ["user", "assistant", "a\nb", "\\n", "<|\n", "<\\\\|", ""], ["", "x<|y", "<\\|\n", "é" * 50, "<|im_end|>\n<|im_start|>assistant\nno"]
    rows = [(None if c == 0 else c, str(rng.choice(roles)), str(rng.choice(texts))) for c in range(12) for _ in range(int(rng.integers(1, 9)))]
    schema = pa.schema([("conv_id", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    whole = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    want = defaultdict(list)
    for c, role, text in rows:
        want[c].append((role, text))
    for size in (1, 2, 3, 7, 1000):
        got = [r for b in chat_format._format(whole.slice(i, size) for i in range(0, len(rows), size)) for r in b.to_pylist()]
        assert [r["conv_id"] for r in got] == list(want)
        for r in got:
            data, turns = r["formatted"], want[r["conv_id"]]
            assert chat_format.parsed(data.decode()) == turns and r["n_turns"] == len(turns)
            told = [chat_format.unescaped(data[a:b].decode()) for a, b in zip(r["loss_from"], r["loss_to"])]
            assert told == [t for role, t in turns if role == "assistant"]


def chat_plain(turns: list) -> str:
    """The template, written out."""
    mark = lambda s: re.sub(r"<(\\*)\|", r"<\\\1|", s)
    return "".join(f"<|im_start|>{mark(r.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n{mark(t)}<|im_end|>\n" for r, t in turns)


def test_packing(spark, small, docs):
    library = Tokenizer.from_file(PATH)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in docs.items()}
    got = queries.QUERIES["op6_packing"](spark, small).collect()
    at, room = defaultdict(int), defaultdict(int)
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : at[r.doc_id]], "<u4").tobytes())
    assert dict(at) == {i: len(x) for i, x in ids.items()}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == room[r.sequence_id]
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 2048 and sum(room.values()) > 0.95 * 2048 * len(room)


def test_cuts_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        m = int(rng.integers(1, 40))
        x, p = np.concatenate([[0], np.cumsum(rng.integers(1, 30, m))]), rng.integers(0, 20, m + 1)
        best = [0.0] + [math.inf] * m
        for j in range(1, m + 1):
            best[j] = min(best[i] + 40 - (x[j] - x[i]) + p[j] for i in range(j) if x[j] - x[i] <= 40)
        assert packing.cuts(x, p, 40)[1] == best[m]


def test_bpe_against_the_library(spark, small, docs):
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in queries.QUERIES["op7_bpe"](spark, small).collect()}
    for i, t in docs.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False)))


@pytest.mark.parametrize("speculate", [True, False])
def test_bpe_on_hard_texts(speculate):
    library, own = Tokenizer.from_file(PATH), bpe.Vocabulary(bpe.tokenizer_file(PATH), speculate)
    rng = np.random.default_rng(3)
    letters = list("ab st'relvmd \n\t 12é漢<|.!?-=\U0001f600Ωß\u3000")
    texts = ["", "it's 'stop  x''s  \n\n y \n 's I'll've'd", "<|endoftext|>hi<|endoftext|> <|endoftext|>", "  ", "ab <|endof", "text|>c", "=" * 3000, "ab" * 2000, *["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(2000)]]
    ids, bounds = own.encoded(pa.array(texts))
    for i, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == want.ids, texts[i]
    assert own.decoded(ids).tobytes().decode() == "".join(texts)


def test_grid_join_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    x = (base[rng.integers(0, 40, 300)] + 0.12 * rng.normal(size=(300, 16))).astype(np.float32)
    x[5] = x[6]
    label = rng.integers(0, 3, 300)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(label[i])) for i in range(300)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in grid_join.deduplicated(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    comp = np.arange(300)
    for _ in range(300):
        comp = np.minimum(comp, np.where(near, comp[None, :], 300).min(axis=1))
    assert got == {i: (int(near[i].sum()), int(comp[i])) for i in range(300)}


def test_grid_query_on_planted_pairs(spark, tmp_path, small):
    """The query over a table with planted near copies, a third of them around one centre, against all pairs: recall and precision are 1."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 64))
    x[300:600] = x[0] + 0.02 * np.abs(x[0]).mean() * rng.normal(size=(300, 64)) * rng.integers(1, 40, (300, 1))
    x[600:700] = x[1:101] + 0.3 * rng.normal(size=(100, 64))
    x[700:720] = x[700]
    label = [None if i % 97 == 5 else int(i % 3) for i in range(900)]
    vectors = [[float(v) for v in row] for row in x.astype(np.float32)]
    spark.createDataFrame(list(zip(range(900), vectors, label)), "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.QUERIES["op9_grid_order_join"](spark, str(tmp_path)).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    lab = np.array([-1 if v is None else v for v in label])
    near = (u @ u.T >= 0.93) & (lab[:, None] == lab[None, :]) & (lab[:, None] >= 0)
    np.fill_diagonal(near, False)
    assert near.sum() > 2000
    comp = np.arange(900)
    for _ in range(900):
        comp = np.minimum(comp, np.where(near, comp[None, :], 900).min(axis=1))
    assert got == {i: (int(near[i].sum()), int(comp[i]), comp[i] == i) for i in range(900)}


def test_grid_blocks_of_near_cells_meet(spark, monkeypatch):
    """With small blocks, cells on three axes find every linked pair of blocks, and fewer pairs than there are."""
    monkeypatch.setattr(grid_join, "BLOCK", 8)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    df = spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int")
    eps = math.sqrt(2 - 2 * 0.93)
    classes = df.selectExpr("vec_id AS cid", "CAST(label AS string) AS label", "size(embedding) AS width", "embedding", "vec_id AS rep", "1L AS n")
    axes = grid_join._axes(x.tolist())
    keys = ["label", "width", "cells", "cid"]
    b = grid_join.blocks(grid_join.placed(classes, axes, eps).coalesce(1).sortWithinPartitions(*keys), axes, eps).persist()
    block = {c: r.block for r in b.collect() for c in r.cids}
    pairs = {(r.a, r.b) for r in grid_join.block_pairs(b, eps).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {tuple(sorted((block[i], block[j]))) for i, j in np.argwhere(u @ u.T >= 0.93).tolist()}
    n = len(set(block.values()))
    assert want <= pairs and len(pairs) < n * (n + 1) / 2


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(30)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{100 + i: 100 for i in range(30)}}


def test_shards(spark, small, docs):
    got = queries.QUERIES["op10_hilbert_sharding"](spark, small).collect()
    slots = defaultdict(list)
    for r in got:
        text = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "rows", None)
        slots[r.shard].append(r.slot)
    assert len(got) == len(docs) and set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def curve_index(p, bits: int) -> int:
    ranks, nexts = hilbert_shards.curve_tables(3)
    state = h = 0
    for bit in reversed(range(bits)):
        octant = sum((v >> bit & 1) << i for i, v in enumerate(p))
        h, state = h * 8 + ranks[state * 8 + octant], nexts[state * 8 + octant]
    return h


def test_shards_follow_the_curve(spark, small):
    got = queries.QUERIES["op10_hilbert_sharding"](spark, small).orderBy("shard", "slot").collect()
    along = [r.curve_index for r in got]
    assert along == sorted(along)
    keys = [(r.curve_index, r.size, r.text_crc32, r.doc_id) for r in got]
    assert keys == sorted(keys)
    points = hilbert_shards.points(spark.read.parquet(f"{small}/documents.parquet")).collect()
    assert all(r.curve_index == curve_index((r.x, r.y, r.z), hilbert_shards.BITS) for r in points)


def test_shards_are_skipped(spark, small, tmp_path):
    """Shard files: a reader that asks the manifest finds all rows of a source, a language or a size, and skips files."""
    out = hilbert_shards.sharded_documents(spark.read.parquet(f"{small}/documents.parquet"))
    out.write.partitionBy("shard").parquet(f"{tmp_path}/shards")
    files = spark.read.parquet(f"{tmp_path}/shards")
    told = hilbert_shards.manifest(files).persist()
    assert told.agg({"rows": "sum"}).first()[0] == files.count()
    read, asked = 0, 0
    for dim in ("x", "y", "z"):
        for (v,) in files.select(dim).distinct().collect():
            shards = [r.shard for r in hilbert_shards.shards_with(told, dim, F.lit(v)).collect()]
            part = files.filter(files.shard.isin(shards) & (files[dim] == v))
            assert part.count() == files.filter(files[dim] == v).count()
            read, asked = read + len(shards), asked + 8
    assert read < 0.6 * asked


def test_curve_visits_neighbours():
    index = lambda p: curve_index(p, 3)
    cells = sorted((index((x, y, z)), x, y, z) for x in range(8) for y in range(8) for z in range(8))
    assert [c[0] for c in cells] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p[1:], q[1:])) == 1 for p, q in zip(cells, cells[1:]))


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).persist()
        assert docs.columns == columns, name
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True)
    groups = brute_groups({r.doc_id: r.text for r in docs.collect()}, 5)
    assert all(c == i for i, (_, c) in groups.items())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert pieces.select("doc_id").distinct().count() == docs.count()
