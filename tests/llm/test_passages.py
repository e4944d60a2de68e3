"""Repeated passages inside and across lines."""

import random
import re
from collections import Counter

from evigrain.llm import line_templates


def _words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]


def _longest(a, b):
    """The longest run of words in both."""
    last, best = [0] * (len(b) + 1), 0
    for x in a:
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                now[j + 1] = last[j] + 1
                best = max(best, now[j + 1])
        last = now
    return best


def test_planted_passages(spark):
    rows, passages = [], {}
    for p in range(20):
        passages[p] = _words(1000 + p, 60)
        for side in (0, 1):
            i = 2 * p + side
            own = _words(i, 40 + p + 7 * side)
            at = 15 + p * side
            # The second text holds the passage wrapped over two lines.
            inner = " ".join(passages[p]) if side == 0 else " ".join(passages[p][:25]) + "\n" + " ".join(passages[p][25:])
            rows.append((i, " ".join(own[:at]) + " " + inner + " " + " ".join(own[at:])))
    rows.append((40, rows[0][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_templates.deduplicated(df).collect()}
    for p in range(20):
        a, b = got[2 * p].split(), got[2 * p + 1].split()
        assert got[2 * p] == rows[2 * p][1]
        assert _longest(a, b) < 51
        # Nothing else goes: all of the text's own words stay, in order.
        assert [w for w in b if w not in passages[p]] == [w for w in rows[2 * p + 1][1].split() if w not in passages[p]]
    assert got[40] == rows[40][1]


def test_line_breaks_and_blanks(spark):
    same = " ".join(_words(5, 60))
    df = spark.createDataFrame([(1, f"first one {same} end\n"), (2, f"kept line\n{same}\nlast  line \n"), (3, None), (4, ""), (5, " \n ")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_templates.unrepeated(df).collect()}
    assert got[1] == f"first one {same} end\n"
    assert got[2].startswith("kept line\n") and got[2].endswith("\nlast  line \n") and len(got[2].split()) < 40
    assert (got[3], got[4], got[5]) == (None, "", " \n ")


def test_two_families_in_one_leaf(spark):
    """Lines of one leaf that vary in a word without digits: each family has its own template."""
    one = "this page was {} by the copying machine of the northern office late at night"
    two = "this page was {} under the old stone bridge while rain fell on every roof"
    names = ["printed", "copied", "stamped", "folded", "signed"]
    rows = [(i, f"{''.join(chr(97 + (i * 7 + k) % 26) for k in range(9))} own words\n{(one if i % 2 else two).format(names[i // 2])}") for i in range(10)]
    rows.append((10, "quite other words\nthis page was zzz one line that nobody else has in any text of this test"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_templates.cleaned(df).collect()}
    assert got[0] == (rows[0][1], 0) and got[1] == (rows[1][1], 0) and got[10] == (rows[10][1], 0)
    assert all(got[i] == (rows[i][1].split("\n")[0], 1) for i in range(2, 10))


def test_rules_null_ids_and_column_names(spark):
    line = "a line of more than twelve words that several texts of this small table hold today"
    df = spark.createDataFrame([(None, f"x\n{line}", 1, 2, 3, 4, 5), (7, f"y\n{line}", 1, 2, 3, 4, 5), (9, f"z\n{line}", 1, 2, 3, 4, 5)], "doc_id long, text string, _gone int, _t1 int, _part int, n_dropped int, _N_LINES int")
    got = {r.doc_id: r.text for r in line_templates.cleaned(df).collect()}
    assert got == {None: "x", 7: f"y\n{line}", 9: "z"}
    assert line_templates.deduplicated(df).columns == df.columns and line_templates.deduplicated(df).count() == 3
    strict = line_templates.Rule(long_texts=4)
    assert all(r.n_dropped == 0 for r in line_templates.cleaned(df, strict).collect())


def _shared(texts, n=51):
    """The runs of n words that two different texts hold."""
    seen, twice = {}, set()
    for i, text in enumerate({t for t in texts if t}):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        for run in {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}:
            if seen.setdefault(hash(run), i) != i:
                twice.add(hash(run))
    return twice


def test_shared_runs_of_more_than_fifty_words_go(spark, small):
    """All runs are looked for. Words that no other text has stay, but for a few inside lines of a template."""
    docs = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    after = [r.text for r in line_templates.op5_passages(spark, small).collect()]
    before = _shared(docs)
    assert len(before) > 100 and len(_shared(after)) <= 0.02 * len(before)
    count = Counter(w for t in {t for t in docs if t} for w in set(t.split()))
    kept = Counter(w for t in {t for t in after if t} for w in set(t.split()))
    alone = {w for w, n in count.items() if n == 1 and not any(c.isdigit() for c in w)}
    assert sum(w in kept for w in alone) >= 0.99 * len(alone)
