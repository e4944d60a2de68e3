"""The trie of prefixes against nodes gathered in plain Python."""

import hashlib
import math
import random
import re
import sys
import zlib

import pytest

from evigrain.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string, depth int, first string, owner long"


def brute(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    head = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    base = {c: c - int(math.fmod(c, 20)) for c in own}  # as SQL's %
    whole = {c: own.get(base[c], [])[: head[c]] + own[c][head[c] :] for c in own}
    members = {}
    for c, steps in whole.items():
        for d in range(len(steps) + 1):
            members.setdefault(tuple(steps[:d]), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    out, below = [], {}
    for k in sorted(members, key=len, reverse=True):
        saved = (len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        below[k] = (sum(below[x][0] for x in kids.get(k, [])) or 1, saved + sum(below[x][1] for x in kids.get(k, [])))
        ends = ",".join(str(c) for c in sorted(members[k]) if len(whole[c]) == len(k))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids.get(k, [])), *below[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS)
    return sorted(map(tuple, prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(df))).collect()), key=str)


def test_query(spark, small):
    got = prefix_trie.op11_prefix_trie(spark, small)
    rows = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute([tuple(r) for r in rows])


@pytest.mark.parametrize("seed", [1, 2])
def test_deep_and_bushy(spark, seed):
    """Few different turns, so that prefixes are shared to any depth; nulls, repeated rows, copies."""
    draw = random.Random(seed)
    rows = []
    for c in list(range(60)) + [-3, 400, 401]:
        for t in range(draw.choice([1, 1, 2, 3, 5, 8, 14])):
            rows.append((c, t if draw.random() < 0.95 else t + 20, draw.choice(["user", "user", None]), draw.choice(["a b", "c", None, ""])))
    rows += [(0, None, "user", "first"), (0, None, "user", "first"), (None, 1, "user", "lost"), (77, None, None, None)]
    # Nested chains: each conversation follows the one before one turn further.
    rows += [(1000 + 20 * k, t, "user", f"step {t}" if t <= k else f"own {k}") for k in range(12) for t in range(k + 2)]
    assert nodes(spark, rows) == brute(rows)


def test_one_conversation_with_most_rows(spark):
    rows = [(40, t, "user", f"w {t % 3}") for t in range(700)] + [(c, t, "user", f"w {t % 3}") for c in (41, 60) for t in range(500)]
    sys.setrecursionlimit(10_000)
    assert nodes(spark, rows) == brute(rows)


def test_edges(spark):
    assert nodes(spark, []) == [] == nodes(spark, [(None, 0, "user", "x")])
    long = "word " * 100_000
    rows = [(20, 0, "user", long), (21, 0, "user", long), (22, None, None, None), (22, None, None, None)]
    assert nodes(spark, rows) == brute(rows)
    # A conversation without steps: its base is absent, and it is shorter than what it would take from it.
    lone = next(c for c in range(101, 120) if zlib.crc32(str(c).encode()) % 4 > 1)
    assert nodes(spark, [(lone, 0, "user", "x")]) == brute([(lone, 0, "user", "x")]) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
