"""Sequence work: species names, gene prefixes, accessions, headers, intervals, oligo ends, target tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrain.functions import text as T

# Short species names, genus initials, and the species that a gene name's prefix stands for.
SHORT_SPECIES = {"G. max": "Glycine max", "A. thaliana": "Arabidopsis thaliana", "O. sativa": "Oryza sativa", "Z. mays": "Zea mays", "N. tabacum": "Nicotiana tabacum", "T. aestivum": "Triticum aestivum"}
GENERA = {"G.": "Glycine", "A.": "Arabidopsis", "O.": "Oryza", "Z.": "Zea", "N.": "Nicotiana", "T.": "Triticum"}
PREFIXES = ("Gm", "At", "Os", "Zm", "Nt", "Nb", "Ta", "Sl", "St", "Md", "Vv", "Br", "Bn", "Cs", "Gh", "Pv", "Lj", "Mt")
OLIGO = 25


def species_name(c: Column) -> Column:
    """The full Latin name of a short one; a genus initial is written out; anything else stays."""
    s = F.trim(F.coalesce(c, F.lit("")))
    of = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    epithet = F.regexp_extract(s, r"^[A-Z]\.\s+([a-z][a-zA-Z-]*)$", 1)
    genus = of(GENERA)[F.regexp_extract(s, r"^([A-Z]\.)\s+[a-z][a-zA-Z-]*$", 1)]
    return F.coalesce(of(SHORT_SPECIES)[s], F.when(s.rlike(r"^[A-Z][a-z]+ [a-z][a-zA-Z-]*$"), s), F.when(epithet != "", F.concat(genus, F.lit(" "), epithet)), s)


def without_prefix(gene: Column, prefixes=PREFIXES) -> Column:
    """A gene name without the prefix of its species, the longest that fits; null if none does or nothing is left."""
    out = F.lit(None).cast("string")
    for p in sorted(prefixes, key=len):
        out = F.when(gene.startswith(p) & (F.length(gene) > len(p)), F.substring(gene, len(p) + 1, 1 << 30)).otherwise(out)
    return out


def header_parts(header: Column) -> Column:
    """species, gene and accession of a header Genus_species_gene_accession; a shorter one is all species."""
    parts = F.split(header, "_")
    rest = F.array_join(F.slice(parts, 4, 1 << 30), "_")
    whole = F.struct(F.concat(F.get(parts, F.lit(0)), F.lit(" "), F.get(parts, F.lit(1))).alias("species"), F.get(parts, F.lit(2)).alias("gene"), rest.alias("accession"))
    return F.when(F.size(parts) >= 3, whole).otherwise(F.struct(header.alias("species"), F.lit("").alias("gene"), F.lit("").alias("accession")))


def interval(start: Column, stop: Column) -> Column:
    """A 0-based interval as 1-based start and stop in ascending order; a start beyond its stop is the minus strand (2)."""
    return F.struct((F.least(start, stop) + 1).alias("start"), (F.greatest(start, stop) + 1).alias("stop"), F.when(start > stop, 2).otherwise(1).alias("strand"))


def best_accession(records: DataFrame, *more: str) -> DataFrame:
    """Of each gene's records (gene, at, accession, title): one whose title has the gene and says transcript, else one with the gene,
    else one that says transcript, else the first; of equals the one that came first. more: what else tells genes apart."""
    title, gene = F.lower("title"), F.lower("gene")
    word = title.contains("mrna") | title.contains("cdna") | title.contains("transcript")
    tier = F.when(title.contains(gene) & word, 0).when(title.contains(gene), 1).when(word, 2).otherwise(3)
    return records.groupBy(*more, "gene").agg(F.min_by("accession", F.struct(tier.alias("tier"), F.col("at"))).alias("accession"))


def oligos(upstream: Column, downstream: Column, n: int = OLIGO) -> Column:
    """The end of the upstream flank, and the reverse complement of the beginning of the downstream one."""
    return F.struct(F.right(upstream, F.lit(n)).alias("forward"), T.reverse_complement(F.substring(downstream, 1, n)).alias("reverse"))


def first_recommended(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first recommended row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.filter("recommended").groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def by_species(accessions: DataFrame) -> DataFrame:
    """How many accessions each species has, and its genes."""
    return accessions.groupBy("species").agg(F.count("*").alias("n"), F.count_distinct("gene").alias("genes"))


def designs(sequences: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target with its accession's sequence; a species without targets keeps a row."""
    both = sequences.select("species", "accession", "sequence").join(targets, ["species", "accession"], "left")
    return both.withColumn("found", F.col("target").isNotNull())


def within_total(rows: DataFrame, size: str, each: int, total: int, by: Column | None = None) -> DataFrame:
    """rows, if none is larger than `each` and those of each job together are within `total`; else an error that fails the
    query. by: the job that a row belongs to; without it all rows are one."""
    jobs = rows.groupBy(*([] if by is None else [by.alias("_job")])).agg(F.max(size).alias("most"), F.sum(size).alias("all"))
    worst = jobs.agg(F.coalesce(F.max("most"), F.lit(0)).alias("_most"), F.coalesce(F.max("all"), F.lit(0)).alias("_all"))
    fits = (F.col("_most") <= each) & (F.col("_all") <= total)
    checked = rows.join(F.broadcast(worst))
    return checked.filter(F.when(fits, F.lit(True)).otherwise(F.raise_error(F.lit("the sequences are over their budget")).cast("boolean"))).drop("_most", "_all")
