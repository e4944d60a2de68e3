"""Operator 12, repair of conversation structure by distinct signatures.

A turn becomes one letter, which stands for its role's initial (s, u, a or any other) and its first fault (none, blank,
duplicate, truncated). A conversation's letters are cut into blocks of BLOCK turns, and each distinct block
signature is solved once, by a recursion that remembers what it has solved: for each state before the block and each
state behind it, the cheapest edits and, among those, the least string of their initials. The solutions are joined
back to the blocks. Most conversations are one block; those of several are chained from their last block to their first,
in a stream over blocks that holds the four best ways on. At last the edits are replayed on the turns.

States are what the repaired turns end with: nothing, a system turn, a user turn or an assistant turn. Roles must read
`(s?(ua)+)?`, so a repaired turn's role follows from the state: a kept turn must fit it, a rerole or an insertion gives
the role that it asks for. Of two equally cheap audits of the same turns neither is the other's beginning (one more
insertion would cost more), so the least audit of a block stays least whatever follows.

Turns are numbered by `running`, so a conversation with very many turns lies in many tasks; a turn is a duplicate if the
table of first occurrences, joined by place, doesn't have it. Texts are read twice and shuffled only to be put in
order at the end. What can't be split is a conversation's audit, one string with a letter an edit, and its
hash: these are made of blocks, in one task, one after another.

Defined results: null role or text is one space, and so is null conv_id or turn in the string that chooses the damage; rows
with null conv_id are one conversation; rows of one turn order by a digest of role and text, so ties and repeated
rows have one result; conversations of which nothing is left have zeros, an empty audit and the hash of nothing; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.llm.running import digest, running
from evigrain.llm.shared import dealt_join, settled, table, written

#: Turns of a block.
BLOCK = 256
ROLES = "sua"
FAULTS = ("fine", "blank", "duplicate", "truncated")
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: After a state: the state that an inserted or reroled turn leads to, whose role that turn gets.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = ("", "system", "user", "assistant")
#: From a state to the end: what is missing.
ENDING = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
WHITE = " \t\n\x0b\x0c\r"
GONE = hashlib.sha256(b"").hexdigest()


def letter(role: int, fault: int) -> str:
    """What stands for a turn: role counts in ROLES, 3 is any other."""
    return chr(ord("A") + 4 * role + fault)


def meaning(sign: str) -> tuple[int, int]:
    return divmod(ord(sign) - ord("A"), 4)


def kept(state: int, role: int) -> int | None:
    """The state after a turn whose role stays, or None if it may not follow."""
    if role == 0:
        return SYSTEM if state == NOTHING else None
    return NEXT[state] if role < 3 and NEXT[state] == (USER, ASSISTANT)[role - 1] else None


@lru_cache(1 << 16)
def solved(signs: str, state: int, goal: int) -> tuple[int, str] | None:
    """The least cost and its least audit for turns that lead from a state to another."""
    if not signs:
        return (0, "") if state == goal else None
    role, fault = meaning(signs[0])
    rest, options, before = signs[1:], [], ""
    # More than two insertions in a row lead back to a state that was there before.
    for _ in range(3):
        steps = [("D", DELETE, state)]
        if fault in (FINE, TRUNCATED):
            more = CUT if fault == TRUNCATED else 0
            steps.append(("R", REROLE + more, NEXT[state]))
            if (after := kept(state, role)) is not None:
                steps.append(("K", KEEP + more, after))
        for edit, cost, after in steps:
            if (way := solved(rest, after, goal)) is not None:
                options.append((INSERT * len(before) + cost + way[0], before + edit + way[1]))
        before, state = before + "I", NEXT[state]
    return min(options, default=None)


def initial(sign: str) -> str:
    role = meaning(sign)[0]
    return ROLES[role] if role < 3 else "x"


def illegal(signs: str) -> int:
    """Neighbours whose roles may not follow each other."""
    return sum((initial(a), initial(b)) not in LEGAL for a, b in zip(signs, signs[1:]))


WAYS = "signs string, costs array<long>, audits array<string>, blank long, duplicate long, truncated long, illegal long"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each signature with its 16 ways, from state i to state j at 4 * i + j; cost -1 where there is none."""
    for b in batches:
        rows = []
        for signs in b["signs"].to_pylist():
            ways = [solved(signs, i, j) or (-1, "") for i in range(4) for j in range(4)]
            faults = [meaning(s)[1] for s in signs]
            rows.append((signs, [w[0] for w in ways], [w[1] for w in ways], *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal(signs)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], [c.split()[0] for c in WAYS.split(", ")])


class _Way:
    """A block's signature, the state before it, its audit and what follows; ways share what follows."""

    __slots__ = ("signs", "state", "audit", "then")

    def __init__(self, signs: str, state: int, audit: str, then: _Way | None):
        self.signs, self.state, self.audit, self.then = signs, state, audit, then

    def blocks(self) -> Iterator[_Way]:
        way = self
        while way is not None:
            yield way
            way = way.then


def less(a: _Way, b: _Way) -> bool:
    """Whether a's audit comes before b's, from block to block until they differ."""
    x, y = "", ""
    while a is not b or x != y:
        if not x and a is not None:
            x, a = a.audit, a.then
        if not y and b is not None:
            y, b = b.audit, b.then
        n = min(len(x), len(y))
        if x[:n] != y[:n] or not n and (a is None and not x or b is None and not y):
            return x < y
        x, y = x[n:], y[n:]
    return False


CHAINED = pa.schema(
    [("nil", pa.int32()), ("conv", pa.int64()), ("before", pa.int64()), ("signs", pa.string()), ("state", pa.int64()), ("audit", pa.string()), ("cost", pa.int64()), ("whole", pa.string()), ("joints", pa.int64())]
)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, sorted by conversation and from last to first, to each block's own audit, the turns and the state before
    it, and a row for what is missing at the end. The row of a conversation's first block also has its cost, its whole audit and
    how many neighbours in different blocks may not follow each other."""
    key, best, head, wrong, rows = None, [], "", 0, []

    def close() -> None:
        cost, way = best[NOTHING]
        whole = "".join(w.audit for w in way.blocks())
        before = 0
        for w in way.blocks():
            rows.append((*key, before, w.signs, w.state, w.audit, *((cost, whole, wrong) if w is way else (None, None, None))))
            before += len(w.signs)

    def told() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), CHAINED)], schema=CHAINED)
        rows.clear()
        return out

    for b in batches:
        for nil, conv, signs, costs, audits in zip(*(b[c].to_pylist() for c in ("nil", "conv", "signs", "costs", "audits"))):
            if (nil, conv) != key:
                if key is not None:
                    close()
                key, wrong, head = (nil, conv), 0, ""
                best = [(cost, _Way("", state, audit, None)) for state, (cost, audit) in enumerate(ENDING)]
            wrong += illegal(signs[-1] + head) if head else 0
            head, now = signs[0], []
            for i in range(4):
                top = None
                for j, (cost, then) in enumerate(best):
                    if costs[4 * i + j] < 0:
                        continue
                    way = (costs[4 * i + j] + cost, _Way(signs, i, audits[4 * i + j], then))
                    if top is None or way[0] < top[0] or way[0] == top[0] and less(way[1], top[1]):
                        top = way
                now.append(top)
            best = now
        if rows:
            yield told()
    if key is not None:
        close()
        yield told()


EDITS = pa.schema([("nil", pa.int32()), ("conv", pa.int64()), ("at", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("place", pa.int64()), ("role", pa.string())])


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their audits to edits: their order (at, step), the turn's place, and the role that it gets."""
    for b in batches:
        rows = []
        for nil, conv, before, signs, state, audit in zip(*(b[c].to_pylist() for c in ("nil", "conv", "before", "signs", "state", "audit"))):
            turn = 0
            for step, edit in enumerate(audit):
                place = None if edit == "I" else before + turn + 1
                role = None
                if edit == "K":
                    state = kept(state, meaning(signs[turn])[0])
                elif edit != "D":
                    state = NEXT[state]
                    role = NAMES[state]
                rows.append((nil, conv, before, step, edit, place, role))
                turn += edit != "I"
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), EDITS)], schema=EDITS)


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} { {pa.int32(): 'int', pa.int64(): 'long', pa.string(): 'string'}[f.type]}" for f in schema)


KEY = ["nil", "conv"]


def keyed(conversations: DataFrame) -> DataFrame:
    """nil and conv in the place of conv_id: keys without null."""
    return conversations.select(F.col("conv_id").isNull().cast("int").alias("nil"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))


def damaged(rows: DataFrame) -> DataFrame:
    """Some turns dropped, emptied, without full stops, repeated or given to the user, chosen by crc32 of `conv_id:turn`."""
    name = F.concat(F.when(F.col("nil") == 1, " ").otherwise(F.col("conv").cast("string")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("fate", F.crc32(name.cast("binary")) % 20).filter("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(*KEY, "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For turns (nil, conv, turn, role, text): one row a conversation with its faults, cost and audit; and the edits in
    their order (at, step), with the role and text that the turn has after it, if it stays."""
    s1, s2 = digest(F.col("role"), F.col("text"))
    shown = F.rtrim(F.col("text"), F.lit(WHITE))
    initials = F.substring("role", 1, 1)
    role = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), initials), F.lit(0))
    rows = written(
        rows.select(
            *(*KEY, "turn", "role", "text", s1.alias("s1"), s2.alias("s2"), F.monotonically_increasing_id().alias("id"), F.lit(1).cast("long").alias("one")),
            *(F.when(role == 0, 3).otherwise(role - 1).cast("long").alias("kind"), (shown == "").cast("long").alias("blank"), (~F.right(shown, F.lit(1)).isin(".", "!", "?")).cast("long").alias("cut")),
        ),
        "turns",
    )
    placed = running(rows.drop("role", "text"), KEY, ["turn", "s1", "s2", "id"], sums=["one"])
    placed = written(placed.withColumnRenamed("run_one", "place").drop("one"), "places")
    first = placed.groupBy(*KEY, "s1", "s2").agg(F.min("place").alias("place")).select(*KEY, "place", F.lit(True).alias("new"))
    fault = F.when(F.col("blank") == 1, BLANK).when(F.col("new").isNull(), DUPLICATE).when(F.col("cut") == 1, TRUNCATED).otherwise(FINE)
    signs = placed.join(first, [*KEY, "place"], "left").select(*KEY, "place", F.char(F.lit(ord("A")) + 4 * F.col("kind") + fault).alias("sign"))
    blocks = signs.groupBy(*KEY, F.expr(f"(place - 1) div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "sign"))).alias("list"))
    blocks = written(blocks.select(*KEY, "block", F.array_join(F.col("list.sign"), "").alias("signs")), "blocks")
    ways = written(blocks.select("signs").distinct().mapInArrow(_solve, WAYS), "ways")
    known = dealt_join(blocks, ways, ["signs"])
    counts = known.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    line = known.select(*KEY, "block", "signs", "costs", "audits").repartition(*KEY).sortWithinPartitions(*KEY, F.desc("block"))
    chained = written(line.mapInArrow(_chain, _ddl(CHAINED)), "chained")
    audits = chained.filter("whole IS NOT NULL").select(*KEY, "cost", F.col("whole").alias("audit"), "joints")
    told = counts.join(audits, KEY).select(*KEY, "blank", "duplicate", "truncated", (F.col("illegal") + F.col("joints")).alias("illegal"), "cost", "audit")
    edits = written(chained.mapInArrow(_replay, _ddl(EDITS)), "edits")
    texts = rows.select("id", F.col("role").alias("was"), "text")
    stay = edits.filter("edit IN ('K', 'R')").join(placed.select(*KEY, "place", "id"), [*KEY, "place"]).join(texts, "id")
    order = [*KEY, "at", "step", "edit"]
    stay = stay.select(*order, F.coalesce("role", "was").alias("role"), "text")
    new = edits.filter("edit = 'I'").select(*order, "role", F.lit("").alias("text"))
    gone = edits.filter("edit = 'D'").select(*order, F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    return told, stay.unionByName(new).unionByName(gone)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to one hash a conversation of `role:text`, joined by line feeds."""
    key, told, out = None, None, []
    schema = pa.schema([("nil", pa.int32()), ("conv", pa.int64()), ("repaired_sha256", pa.string())])
    for b in batches:
        for nil, conv, role, text in zip(*(b[c].to_pylist() for c in ("nil", "conv", "role", "text"))):
            if (nil, conv) == key:
                told.update(b"\n")
            else:
                if key is not None:
                    out.append((*key, told.hexdigest()))
                key, told = (nil, conv), hashlib.sha256()
            told.update(f"{role}:{text}".encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, told.hexdigest()), schema)], schema=schema)


def gaps(rows: DataFrame) -> DataFrame:
    """How many turn numbers between a conversation's least and greatest are missing."""
    numbers = rows.filter("turn IS NOT NULL").select(*KEY, F.col("turn").cast("long")).distinct()
    return numbers.groupBy(*KEY).agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""

    def build() -> DataFrame:
        rows = keyed(table(spark, sf_dir, "conversations"))
        broken = damaged(rows)
        told, edits = repaired(broken)
        turns = edits.filter("edit <> 'D'").repartition(*KEY).sortWithinPartitions(*KEY, "at", "step")
        hashes = turns.select(*KEY, "role", "text").mapInArrow(_hash, "nil int, conv long, repaired_sha256 string")
        out = rows.select(*KEY).distinct().join(told, KEY, "left").join(gaps(broken), KEY, "left").join(hashes, KEY, "left")
        out = out.na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"])
        return out.select(
            *(F.when(F.col("nil") == 0, F.col("conv")).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost"),
            *(F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(GONE)).alias("repaired_sha256")),
        )

    return settled(spark, build, "repair")


_NAME = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
_CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({_NAME}, ''), lambda z: ascii(z)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""


def _way_sql(state: int) -> str:
    """The best way on from a state before a turn, without insertions, given the ways b0 to b3 behind it."""
    on = NEXT[state]
    step = lambda when, cost, letter, to: f"CASE WHEN {when} THEN {{'c': b{to}.c + {cost}, 'a': '{letter}' || b{to}.a}} END"
    more, free = f"CASE fault WHEN 3 THEN {CUT} ELSE 0 END", "fault IN (0, 3)"
    ways = [step("TRUE", DELETE, "D", state), step(free, f"{REROLE} + {more}", "R", on), step(f"{free} AND kind = '{'u' if on == USER else 'a'}'", more, "K", on)]
    if state == NOTHING:
        ways.append(step(f"{free} AND kind = 's'", more, "K", SYSTEM))
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"


def _with_insertions_sql(state: int) -> str:
    one, two = NEXT[state], NEXT[NEXT[state]]
    return f"list_min([d{state}, {{'c': d{one}.c + {INSERT}, 'a': 'I' || d{one}.a}}, {{'c': d{two}.c + {2 * INSERT}, 'a': 'II' || d{two}.a}}])"


ORACLE = rf"""
WITH RECURSIVE f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS fate FROM conversations),
x AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM f, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS u(i) WHERE fate <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM x),
q AS (SELECT *, left(role, 1) AS kind, CASE WHEN shown = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 2 WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) || left(role, 1) AS pair FROM o),
w AS (SELECT conv_id, max(place) AS place, {', '.join(f"{{'c': {c}, 'a': '{a}'}} AS b{i}" for i, (c, a) in enumerate(ENDING))} FROM q GROUP BY conv_id
  UNION ALL SELECT conv_id, place - 1, {', '.join(_with_insertions_sql(i) for i in range(4))} FROM (SELECT w.conv_id, w.place, {', '.join(f'{_way_sql(i)} AS d{i}' for i in range(4))} FROM w JOIN q ON q.conv_id IS NOT DISTINCT FROM w.conv_id AND q.place = w.place)),
a AS (SELECT conv_id, b0.c AS cost, b0.a AS audit FROM w WHERE place = 0),
e AS (SELECT conv_id, i, audit[i] AS edit FROM a, unnest(range(1, length(audit) + 1)) AS u(i)),
g AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS place, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY i) - 1 AS nth FROM e),
r AS (SELECT g.*, q.role, q.text, first_value(edit = 'K' AND q.kind = 's') OVER (PARTITION BY g.conv_id ORDER BY edit = 'D', i)::INT AS system FROM g LEFT JOIN q ON edit <> 'I' AND q.conv_id IS NOT DISTINCT FROM g.conv_id AND q.place = g.place),
t AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - system) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY i)) AS told FROM r WHERE edit <> 'D' GROUP BY conv_id),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM q GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(told, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""
