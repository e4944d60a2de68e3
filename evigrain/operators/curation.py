"""Curation: batches, verdicts, windows with budgets, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evigrain.operators import fusion

BATCH = 12


def batch_of(position, total):
    """The batch of a 0-based position: fewer than 12 are one batch, else total // 12 + 1 batches as even as can be."""
    n = F.floor(total / BATCH) + 1
    return F.when(total < BATCH, 0).otherwise(F.floor(position / F.ceil(total / n))).cast("long")


def verdict_counts(verdicts: DataFrame, *by: str, kinds=("SUPPORTED", "UNSUPPORTED", "UNCERTAIN")) -> DataFrame:
    """Counts of each kind and the share that is supported."""
    counts = verdicts.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col("verdict") == k).alias(k.lower()) for k in kinds])
    return counts.withColumn("fidelity", F.round(F.col(kinds[0].lower()) / F.greatest("total", F.lit(1)), 6))


def corrected(fields: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Field values, with NA where the last verdict on the field is unsupported."""
    last = verdicts.groupBy("gene", "field").agg(F.max_by("verdict", "at").alias("verdict"))
    return fields.join(last, ["gene", "field"], "left").withColumn("value", F.when(F.col("verdict") == "UNSUPPORTED", "NA").otherwise(F.col("value"))).drop("verdict")


def recommended(rows: DataFrame, key: str, order: str, kind: str = "kind", extra: int = 3) -> DataFrame:
    """Each key's rows up to `extra` after its first exon row, with a mark on that row; all rows of a key without one."""
    w = W.partitionBy(key).orderBy(order)
    placed = rows.withColumn("_n", F.row_number().over(w))
    first = placed.filter(F.col(kind) == "exon").groupBy(key).agg(F.min("_n").alias("_first"))
    return placed.join(first, key, "left").filter(F.col("_first").isNull() | (F.col("_n") <= F.col("_first") + extra)).withColumn("recommended", F.coalesce(F.col("_n") == F.col("_first"), F.lit(False))).drop("_n", "_first")


def manifest_diff(manifest: DataFrame, files: DataFrame, version: str) -> DataFrame:
    """file, action: keep (same digest and chunker version), rebuild (changed or new), drop (gone)."""
    old, new = manifest.alias("m"), files.alias("f")
    both = old.join(new, F.col("m.file") == F.col("f.file"), "full_outer")
    same = (F.col("m.sha") == F.col("f.sha")) & (F.col("m.chunker_version") == version)
    action = F.when(F.col("f.file").isNull(), "drop").when(F.coalesce(same, F.lit(False)), "keep").otherwise("rebuild")
    return both.select(F.coalesce("f.file", "m.file").alias("file"), action.alias("action"))


def cursors(counts: DataFrame) -> DataFrame:
    """start and end of each file's chunks in file order."""
    return fusion.running(counts, "file", F.col("n_chunks")).select(*counts.columns, F.col("before").alias("start"), (F.col("before") + F.col("n_chunks")).alias("end"))


def collected(extractions: DataFrame, buckets: tuple[str, ...]) -> DataFrame:
    """file, bucket, place, gene: the genes of all buckets, each with its place in its own."""
    out = None
    for b in buckets:
        rows = extractions.select("file", F.lit(b).alias("bucket"), F.posexplode(b).alias("place", "gene"))
        out = rows if out is None else out.unionByName(rows)
    return out


def categories(genes: DataFrame) -> DataFrame:
    """file, name, bucket: the category of each gene name; of several the last one counts."""
    return genes.groupBy("file", "name").agg(F.max_by("bucket", "ord").alias("bucket"))


def outcomes(results: DataFrame) -> DataFrame:
    """How many results of each kind: failed where there is an error, skipped where there was an output, else processed."""
    kind = F.when(F.coalesce("error", F.lit("")) != "", "failed").when(F.coalesce("had_output", F.lit(False)), "skipped").otherwise("processed")
    return results.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"), F.min("file").alias("first"))


def gene_name(record: str) -> Column:
    """A record's name, by the first of its fields that isn't empty; else empty."""
    fields = ("Gene_Name", "gene", "gene_name", "name")
    return F.coalesce(*[F.when(F.col(record)[f] != "", F.col(record)[f]) for f in fields], F.lit(""))


def repaired_json(c: str, schema: str) -> Column:
    """JSON as a struct; of one that was cut off, what is there up to its last closing brace, with the brackets and braces that
    are still open closed. Null if that doesn't help either."""
    t = F.col(c)
    head = F.regexp_extract(t, r"(?s)^(.*\})", 1)
    count = lambda x, ch: F.length(x) - F.length(F.replace(x, F.lit(ch), F.lit("")))
    more = lambda a, b: F.greatest(F.lit(0), count(head, a) - count(head, b))
    whole = F.concat(head, F.repeat(F.lit("]"), more("[", "]")), F.repeat(F.lit("}"), more("{", "}")))
    # A text is whole if it ends where its outermost value does.
    valid = F.get_json_object(t, "$").isNotNull()
    return F.when(valid, F.from_json(t, schema)).when(F.get_json_object(whole, "$").isNotNull(), F.from_json(whole, schema))


def without_sections(docs: DataFrame, key: str, drop: DataFrame) -> DataFrame:
    """Texts without the sections (numbered from 0; 0 is what stands before the first heading) that drop (key, section) names."""
    parts = docs.select(key, F.posexplode(F.split("text", r"(?m)^(?=#)")).alias("section", "part"))
    kept = parts.join(drop.select(key, "section"), [key, "section"], "left_anti")
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "part"))), lambda x: x["part"]), "").alias("text"))


def new_stems(uploads: DataFrame, *known: DataFrame) -> DataFrame:
    """Uploads (file) whose stem none of the known tables (stem) has."""
    out = uploads.withColumn("stem", F.regexp_replace("file", r"\.[^.]*$", ""))
    for k in known:
        out = out.join(k.select("stem"), "stem", "left_anti")
    return out


def index_status(corpus: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: files, how many are indexed and missing, and the share that is."""
    both = corpus.select("file").distinct().join(indexed.select("file").distinct().withColumn("there", F.lit(1)), "file", "left")
    n = both.agg(F.count("*").alias("files"), F.count("there").alias("indexed"))
    percent = F.format_string("%.1f%%", F.when(F.col("files") > 0, F.col("indexed") / F.col("files") * 100).otherwise(0.0))
    return n.select("files", "indexed", (F.col("files") - F.col("indexed")).alias("missing"), percent.alias("synced"))


def picked(files: DataFrame, wanted: str) -> DataFrame:
    """The file (file) that a text names: by its place from 1 in name order, by its name, or by a part of its name, the first of those."""
    if wanted.isdigit():
        return files.orderBy("file").limit(int(wanted)).orderBy(F.desc("file")).limit(1) if int(wanted) else files.limit(0)
    exact = F.col("file") == wanted
    part = F.col("file").contains(wanted)
    return files.filter(exact | part).orderBy(F.desc(exact), "file").limit(1)
