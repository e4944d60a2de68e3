"""Repair of conversations against a search over all edits, in order of cost and audit."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from evigrain.llm import turn_repair

TURNS = "conv_id long, turn long, role string, text string, place int, state string, nil int, conv string"


def damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fate == 0:
            continue
        x = "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x
        out += [(c, t, "user" if fate == 4 else r, x)] * (2 if fate == 3 else 1)
    return out


def cheapest(rows):
    """rows: (role, text, fault). What leaves the heap first has the least cost and then the least audit."""
    heap, seen = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, shape, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", shape):
            return cost, audit, out
        state = (i, shape if len(shape) < 2 else shape[-1] + "+")
        if state in seen:
            continue
        seen.add(state)

        def put(more, edit, to, role=None, text=""):
            after = shape + (role[:1] if role else "")
            if (role is None or role) and re.fullmatch("s?(ua)*u?", after):
                heapq.heappush(heap, (cost + more, audit + edit, to, after, out + ((role, text),) if role else out))

        for role in ("user", "assistant"):
            put(3, "I", i, role)
        if i < len(rows):
            role, text, fault = rows[i]
            put(4, "D", i + 1)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                put(more, "K", i + 1, role, text)
                put(3 + more, "R", i + 1, "user", text)
                put(3 + more, "R", i + 1, "assistant", text)


def brute(rows, whole=False):
    conversations = {r[0]: [] for r in rows}
    for r in rows if whole else damage(rows):
        conversations[r[0]].append(r)
    out = []
    for c, own in conversations.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, marked = set(), []
        for _, _, role, text in own:
            shown = text.strip(" \t\n\x0b\x0c\r")
            marked.append((role, text, "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "fine"))
            seen.add((role, text))
        faults = [f for _, _, f in marked]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        at = {r[1] for r in own if r[1] is not None}
        cost, audit, after = cheapest(marked)
        told = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in after).encode()).hexdigest()
        out.append((c, max(at) - min(at) + 1 - len(at) if at else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, told))
    return sorted(out, key=str)


def answers(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], TURNS).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return sorted(map(tuple, turn_repair.op12_turn_repair(spark, str(tmp_path)).collect()), key=str)


def test_query(spark, small):
    got = turn_repair.op12_turn_repair(spark, small)
    rows = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute([tuple(r) for r in rows])


@pytest.mark.parametrize("block", [256, 3])
def test_random_conversations(spark, tmp_path, monkeypatch, block):
    """Also with blocks so short that most conversations have several."""
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    draw = random.Random(block)
    rows = [(c, t, draw.choice(["user", "assistant", "system", "tool", "user", "assistant", "", "sage"]), draw.choice(["a.", "b!", "c", "", "d? ", "e", f"f{t}."])) for c in range(150) for t in range(draw.randrange(1, 9))]
    assert answers(spark, tmp_path, rows) == brute(rows)


def test_edges(spark, tmp_path):
    assert answers(spark, tmp_path, []) == []
    long = "word " * 100_000
    rows = [(None, None, None, None), (None, 3, "user", "x."), (1, None, "user", None), (1, None, "user", None), (2, 5, "assistant", long), (2, 5, "assistant", long), (2, 9, "system", "y.")]
    rows += [(3, 0, "user", "\n."), (4, 7, None, "z?")]
    dropped = next(c for c in range(100, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone."))
    got = answers(spark, tmp_path, rows)
    assert got == brute(rows)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got


def test_a_conversation_of_many_blocks(spark, tmp_path):
    draw = random.Random(5)
    rows = [(8, t, draw.choice(["user", "assistant"]), draw.choice([f"{t}.", "same.", "cut"])) for t in range(1500)]
    assert answers(spark, tmp_path, rows) == brute(rows)


def test_ways_are_compared_lazily():
    end = turn_repair._Way("", 0, "I", None)
    way = lambda *audits: [w := end, *(w := turn_repair._Way("", 0, a, w) for a in reversed(audits))][-1]
    assert turn_repair.less(way("KD", "K"), way("K", "KK")) and not turn_repair.less(way("K", "KK"), way("KD", "K"))
    assert not turn_repair.less(way("K", "", "D"), way("KD"))
