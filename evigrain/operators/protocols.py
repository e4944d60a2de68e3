"""Protocols: plain text to Markdown, blocks and sections of templates, protocols for many genes.

A text becomes Markdown line by line. What a line is depends on the line alone; what is made of it depends on a little
state: whether the title has been, whether it is inside a flow chart (from its first line to the next blank line
or rule), and whether a table is open. Runs of lines between blank lines and rules are numbered, and the state is a
running maximum or the last event within a run, so a document is one window over its lines and no Python runs.

Templates are filled by expressions: a block is found between two markers whose blanks and case don't matter, filled
once for each gene, and put in the place of the first one. Each step reads the text that the step before made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evigrain.functions import text as T

# The words that make a line of a protocol a heading, a note or a label.
META = "物种|适用物种|系统|转化策略|验证策略|流程覆盖|文件版本"
NOTES = "注意|推荐|关键提示|决策节点|转化效率参考|命名规则|判断标准|原则"
LABELS = "试剂|操作|材料|菌株|大豆品种|种子处理|目的|PCR条件|PCR程序|保存|参考方案|小麦品种|水稻品种|番茄品种|玉米品种|烟草品种|拟南芥品种|植物品种"
SECTIONS = ("总体流程概览", "附录", "参考文献", "参考资源")
APPENDIX, SHORT = "附录", 40
# Lines with two parts, in the order in which they are tried, and what is made of them.
PAIRS = (
    (rf"^({META})\s*[：:]\s*(.+)$", "**", "：** "),
    (r"^(Step\s+\d+)\s*[：:]\s*(.+)$", "\n## ", "："),
    (r"^(\d+\.\d+\.\d+)\s+(.+)$", "#### ", " "),
    (r"^(\d+\.\d+)\s+(.+)$", "### ", " "),
    (r"^(Day\s+[\d\-]+\s*(?:至\s*Day\s*\d+)?)\s*[-–—]\s*(.+)$", "#### ", " — "),
    (rf"^({NOTES})[：:]\s*(.+)$", "> **", "：** "),
)
RULE, LETTERED, LABEL, SUB, NUMBERED, CHART = r"^_{5,}$", r"^（[A-Z]）.+$", rf"^({LABELS})[：:]\s*(.*)$", r"^o\t(.+)$", r"^(\d+)\.\t(.+)$", r"[│▼▲【】]"
_FLAGS = "(?Us)"


def _group(line: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(line, _FLAGS + pattern, n)


def _like(line: Column, pattern: str) -> Column:
    return line.rlike(_FLAGS + pattern)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def line_kind(line: Column) -> Column:
    """What a line is by itself: blank, rule, chart, row (of a table), mark (leaves a table open) or other."""
    pair = F.lit(False)
    for pattern, _, _ in PAIRS:
        pair = pair | _like(line, pattern)
    section = line.isin(*SECTIONS) | (line.startswith(APPENDIX) & (F.length(line) < SHORT))
    mark = _like(line, LETTERED) | _like(line, LABEL) | _like(line, SUB) | line.startswith("•") | _like(line, NUMBERED)
    cells = F.size(F.filter(F.transform(F.split(line, "\t"), _strip), lambda x: x != ""))
    row = line.contains("\t") & (cells >= 2)
    return F.when(line == "", "blank").when(_like(line, RULE), "rule").when(pair | section, "other").when(mark, "mark").when(_like(line, CHART), "chart").when(row, "row").otherwise("other")


def _shown(line: Column, kind: Column, opens: Column) -> Column:
    """What is made of a line outside of flow charts, as lines."""
    cells = F.transform(F.split(line, "\t"), lambda x: F.when(_strip(x) == "", " ").otherwise(_strip(x)))
    row = F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    below = F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda x: F.lit("---")), " | "), F.lit(" |"))
    out = F.when(kind == "blank", F.array(F.lit(""))).when(kind == "rule", F.array(F.lit("---")))
    for pattern, before, between in PAIRS:
        out = out.when(_like(line, pattern), F.array(F.concat(F.lit(before), _group(line, pattern, 1), F.lit(between), _group(line, pattern, 2))))
    out = out.when(line.isin(*SECTIONS) | (line.startswith(APPENDIX) & (F.length(line) < SHORT)), F.array(F.lit(""), F.concat(F.lit("## "), line)))
    out = out.when(_like(line, LETTERED), F.array(F.concat(F.lit("#### "), line)))
    rest = _group(line, LABEL, 2)
    out = out.when(_like(line, LABEL), F.array(F.concat(F.lit("**"), _group(line, LABEL, 1), F.lit("：**"), F.when(rest != "", F.concat(F.lit(" "), rest)).otherwise(""))))
    out = out.when(_like(line, SUB), F.array(F.concat(F.lit("  - "), _group(line, SUB, 1))))
    out = out.when(line.startswith("•"), F.array(F.concat(F.lit("- "), _strip(F.regexp_replace(line, "^•+", "")))))
    out = out.when(_like(line, NUMBERED), F.array(F.concat(_group(line, NUMBERED, 1), F.lit(". "), _group(line, NUMBERED, 2))))
    return out.when((kind == "row") & opens, F.array(row, below)).when(kind == "row", F.array(row)).otherwise(F.array(line))


def to_markdown(texts: DataFrame, key: str, column: str) -> DataFrame:
    """key and markdown of each text; keys are distinct, null texts are left out."""
    lines = texts.filter(F.col(column).isNotNull()).select(key, F.posexplode(F.split(column, "\n", -1)).alias("at", "raw"))
    lines = lines.select(key, "at", _strip(F.col("raw")).alias("line")).withColumn("kind", line_kind(F.col("line")))
    upto = W.partitionBy(key).orderBy("at")
    before = upto.rowsBetween(W.unboundedPreceding, -1)
    ends = F.col("kind").isin("blank", "rule")
    lines = lines.withColumn("run", F.sum(ends.cast("int")).over(upto)).withColumn("told", F.coalesce(F.sum((~ends).cast("int")).over(before), F.lit(0)))
    title = ~ends & (F.col("told") == 0)
    lines = lines.withColumn("kind", F.when(title, "title").otherwise(F.col("kind")))
    run = W.partitionBy(key, "run").orderBy("at")
    # A chart goes on to the end of its run; the row that ends the run opens the next one.
    inside = F.coalesce(F.max((F.col("kind") == "chart").cast("int")).over(run.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 1
    lines = lines.withColumn("inside", inside & ~ends)
    event = F.when(~F.col("kind").isin("mark", "title"), F.col("kind"))
    lines = lines.withColumn("last", F.last(F.when(~F.col("inside"), event), ignorenulls=True).over(run.rowsBetween(W.unboundedPreceding, -1)))
    charted = F.col("inside") | (F.col("kind") == "chart")
    lines = lines.withColumn("charted", charted).withColumn("was", F.coalesce(F.lag("charted").over(upto), F.lit(False)))
    fence, line = F.array(F.lit("```")), F.col("line")
    none = F.array().cast("array<string>")
    plain = F.when(F.col("kind") == "title", F.array(F.concat(F.lit("# "), line))).when(F.col("charted"), F.array(line)).otherwise(_shown(line, F.col("kind"), F.coalesce(F.col("last"), F.lit("")) != "row"))
    out = F.concat(F.when(F.col("was") & ends, fence).otherwise(none), F.when((F.col("kind") == "chart") & ~F.col("inside"), fence).otherwise(none), plain)
    each = lines.select(key, "at", out.alias("out"), "charted")
    whole = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "out", "charted"))).alias("all"))
    parts = F.concat(F.flatten(F.col("all.out")), F.when(F.element_at("all", -1)["charted"], fence).otherwise(none))
    return whole.select(key, F.array_join(parts, "\n").alias("markdown"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column behind a one-row generator, so that what reads it doesn't compute it again."""
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.array(value)).alias(name))


def block_pattern(start: str, end: str) -> str:
    """A pattern for what lies between two markers, both included; blanks and letter case in them don't matter."""
    one = lambda m: r"\s+".join(rf"\Q{w}\E" for w in m.split())
    same = " ".join(start.lower().split()) == " ".join(end.lower().split())
    return "(?isu)" + (one(start) if same else f"{one(start)}.*?{one(end)}")


def filled(block: Column, gene: Column, places: dict[str, str]) -> Column:
    """A block with a gene's fields in their places; longer places first where one holds another."""
    for place, field in places.items():
        block = F.replace(block, F.lit(place), F.coalesce(gene[field], F.lit("")))
    return block


def with_blocks(designs: DataFrame, column: str, genes: str, blocks: list[tuple[str, str]], places: dict[str, str]) -> DataFrame:
    """designs with each block of the template in `column` filled for all genes, one after another. A block that isn't there stays out."""
    for start, end in blocks:
        df = _once(designs, "_block", F.regexp_extract(column, block_pattern(start, end), 0))
        many = F.array_join(F.transform(genes, lambda g: filled(F.col("_block"), g, places)), "\n")
        at = F.position(F.col("_block"), F.col(column))
        new = F.concat(F.substring(F.col(column), F.lit(1), at - 1), many, F.substring(F.col(column), at + F.length("_block"), F.length(column)))
        designs = _once(df, column, F.when(F.col("_block") == "", F.col(column)).otherwise(new)).drop("_block")
    return designs


def without_section(text: Column, heading: Column) -> Column:
    """A Markdown text without the section of a heading: from its line to the next line with another heading of the
    second level, or the end."""
    lines = F.split(text, r"(?<=\n)")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    # Each step is bound once: a lambda that held the step's expression would compute it again for every line.
    with_ = lambda value, body: F.transform(F.array(value), body)[0]

    def cut(a: Column, name: Column, start: Column) -> Column:
        other = F.transform(a, lambda x, i: F.when((i + 1 > start) & x.startswith("## ") & (_strip(x) != name), i))
        rest = lambda end: F.array_join(F.concat(F.slice(a, F.lit(1), start - 1), F.slice(a, end + 1, F.size(a))), "")
        return F.when(start == 0, text).otherwise(with_(F.coalesce(F.array_min(other), F.size(a)), rest))

    found = lambda a, name: with_(F.array_position(F.transform(a, _strip), name).cast("int"), lambda start: cut(a, name, start))
    return with_(lines, lambda a: with_(_strip(heading), lambda name: found(a, name)))


def combined(protocols: DataFrame, key: str, order: str, name: str, column: str) -> DataFrame:
    """key and text: all protocols of a design under headings of the second level, in their order."""
    part = F.struct(order, F.concat(F.lit("## "), F.col(name), F.lit("\n"), F.col(column)).alias("part"))
    return protocols.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["part"]), "\n\n").alias("text"))


def transfer(designs: DataFrame, column: str, genes: str, sequence_block: str, oligo_block: str, single: str, multi: str) -> DataFrame:
    """Protocols for bringing genes into a species. designs: a template and genes (gene, accession, sequence, upstream, downstream).

    The sequence block is filled for all genes. With several genes the section for one goes and the oligo block is filled
    for all; with one the section for several goes and the block is filled for the first."""
    first = {"_gene_sequence_up2k_": "upstream", "_gene_sequence_down2k_": "downstream", "_gene_sequence_": "sequence"}

    def sequence(g: Column) -> Column:
        out = filled(F.lit(sequence_block), g, first)
        for tail in ("_up2k", "_down2k"):
            out = F.replace(out, F.lit(f"_gene_accession{tail}"), F.concat(g["accession"], F.lit(tail)))
        return filled(out, g, {"_gene_accession_": "accession", "_gene_name_": "gene"})

    def oligo(g: Column) -> Column:
        ends = F.struct(g["gene"].alias("gene"), F.right(g["upstream"], F.lit(25)).alias("up"), T.reverse_complement(F.substring(g["downstream"], 1, 25)).alias("down"))
        return filled(F.lit(oligo_block), ends, {"_gene_name_": "gene", "_gene_up25_": "up", "_gene_down25_rc_": "down"})

    df = _once(designs, column, F.replace(F.col(column), F.lit(sequence_block), F.array_join(F.transform(genes, sequence), "\n")))
    several = F.size(genes) > 1
    df = _once(df, column, without_section(F.col(column), F.when(several, single).otherwise(multi)))
    told = F.when(several, F.array_join(F.transform(genes, oligo), "\n")).otherwise(F.coalesce(F.transform(genes, oligo)[0], F.lit(oligo_block)))
    return _once(df, column, F.replace(F.col(column), F.lit(oligo_block), told))

