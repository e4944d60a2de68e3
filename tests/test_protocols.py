"""Protocols as Markdown against a state machine, and templates."""

import random
import re
import time

from pyspark.sql import functions as F

from evigrain.operators import protocols


def plain(text: str) -> str:
    """The same by a walk over the lines."""
    out, chart, titled, opened = [], False, False, False
    for raw in text.split("\n"):
        line = raw.strip()
        if not line or re.match(protocols.RULE, line):
            out += (["```"] if chart else []) + ["---" if line else ""]
            chart = opened = False
        elif not titled:
            out.append(f"# {line}")
            titled = True
        elif chart:
            out.append(line)
        elif hit := next(((m, b, x) for p, b, x in protocols.PAIRS if (m := re.match(p, line))), None):
            out.append(hit[1] + hit[0][1] + hit[2] + hit[0][2])
            opened = False
        elif line in protocols.SECTIONS or line.startswith("附录") and len(line) < 40:
            out += ["", f"## {line}"]
            opened = False
        elif re.match(protocols.LETTERED, line):
            out.append(f"#### {line}")
        elif m := re.match(protocols.LABEL, line):
            out.append(f"**{m[1]}：**" + (f" {m[2]}" if m[2] else ""))
        elif m := re.match(protocols.SUB, line):
            out.append(f"  - {m[1]}")
        elif line.startswith("•"):
            out.append("- " + line.lstrip("•").strip())
        elif m := re.match(protocols.NUMBERED, line):
            out.append(f"{m[1]}. {m[2]}")
        elif re.search(protocols.CHART, line):
            out += ["```", line]
            chart, opened = True, False
        elif "\t" in line and sum(bool(c.strip()) for c in line.split("\t")) > 1:
            cells = [c.strip() or " " for c in line.split("\t")]
            out.append("| " + " | ".join(cells) + " |")
            if not opened:
                out.append("| " + " | ".join("---" for _ in cells) + " |")
            opened = True
        else:
            out.append(line)
            opened = False
    return "\n".join(out + (["```"] if chart else []))


def test_markdown_of_random_protocols(spark):
    lines = ["", " \t", "_____", "____", "Title", "物种：大豆", "Step  2 ：go", "Step 2:", "2.1 x", "2.1.3 y", "Day 2-4 至 Day 9 – z", "Day 3 - w", "注意: hot", "总体流程概览", "附录A", "附录" + "长" * 40]
    lines += ["（B）part", "试剂：", "试剂: 水", "o\tsub", "•• a", "•", "12.\titem", "│", "a ▼ b", "x\ty", "x\t\tz", "\tx", "x\t", "o\tp\tq", "plain", "目的x"]
    draw = random.Random(1)
    texts = ["\n".join(draw.choices(lines, k=draw.randrange(0, 14))) for _ in range(300)] + ["", "\n", "only", "t\n│"]
    df = spark.createDataFrame([*enumerate(texts), (9999, None)], "id long, text string")
    got = {r.id: r.markdown for r in protocols.to_markdown(df, "id", "text").collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_sections(spark):
    cases = {"a\n## X\nb\n## Y\nc": "a\n## Y\nc", "## X\nb": "", "a\n": "a\n", " ## X \n## X\n# Z\n## Y": "## Y", "": "", "a\n### X\n## X": "a\n### X\n"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.u for r in df.select("t", protocols.without_section(F.col("t"), F.lit("## X")).alias("u")).collect()} == cases


def test_blocks(spark):
    genes = [{"g": "A"}, {"g": "B\\1$"}]
    rows = [("x START  _g_\nEnd. y start _g_ end.", genes), ("no block _g_", genes), ("start _g_ end.", [])]
    df = spark.createDataFrame(rows, "t string, genes array<struct<g:string>>")
    got = [r.t for r in protocols.with_blocks(df, "t", "genes", [("start", "END.")], {"_g_": "g"}).collect()]
    assert got == ["x START  A\nEnd.\nSTART  B\\1$\nEnd. y start _g_ end.", "no block _g_", ""]


def test_a_section_of_a_long_text_is_found_in_one_pass(spark):
    """The steps over 800 lines are taken once each, not once a line."""
    text = "top\n" * 400 + "## X\n" + "b\n" * 200 + " ## X\n## Y\n" + "c\n" * 198 + "## X\nend"
    start = time.time()
    [row] = spark.createDataFrame([(text,)], "t string").select(protocols.without_section(F.col("t"), F.lit("## X")).alias("u")).collect()
    assert row.u == "top\n" * 400 + "## Y\n" + "c\n" * 198 + "## X\nend"
    assert time.time() - start < 30
