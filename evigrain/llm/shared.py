"""What the operators of this subpackage share: reading tables, tables that cut lineage, and byte tricks."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the contracts call white space: a word is a run of anything else.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session's executors, once a session."""
    context = spark.sparkContext
    if getattr(context, "_evigrain_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    # Spark serves the driver's copy for as long as it runs.
    folder = tempfile.mkdtemp(prefix="evigrain-code-")
    atexit.register(shutil.rmtree, folder, True)
    archive = Path(folder) / "evigrain.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted((root / "evigrain").rglob("*.py")):
            z.write(file, file.relative_to(root))
    context.addPyFile(str(archive))
    context._evigrain_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or else what
    SparkContext.setCheckpointDir was given. Without either, a session on one machine (tests) gets a folder of its
    own, and on a cluster this is an error: a folder of our own choice would be one machine's."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='evigrain-')}"
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Paths that written() made inside the innermost settled() of this thread, or None outside of any.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def _path(spark: SparkSession, name: str):
    """A path as Hadoop knows it, and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def run_folder(spark: SparkSession) -> str:
    """The application's own folder in the shared one; Hadoop deletes it when the driver ends."""
    context = spark.sparkContext
    folder = f"{shared_folder(spark)}/evigrain/{context.applicationId}"
    made = context.__dict__.setdefault("_evigrain_folders", set())
    if folder not in made:
        path, system = _path(spark, folder)
        system.mkdirs(path)
        system.deleteOnExit(path)
        made.add(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder. It cuts the lineage, and a lost executor takes nothing with it.

    It goes when the settled() around it, if any, has its result, and with the application at the latest."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What build() gives, written; the tables that were written on the way to it, by this thread, are deleted, also
    if it fails."""
    mine: list[str] = []
    token, kept = _made.set(mine), []
    try:
        out = written(build(), name)
        kept = mine[-1:]
    finally:
        _made.reset(token)
        for name in mine:
            if name not in kept:
                path, system = _path(spark, name)
                system.delete(path, True)
    outer = _made.get()
    if outer is not None:
        outer += kept
    return out


#: A key is hot if it has more than one in so many of all rows. There are no more hot keys than that.
HOT = 512


def hot_keys(keys: DataFrame, hot: int = HOT) -> DataFrame:
    """The columns of keys and _parts, for keys with more than 1/hot of the rows: fewer than `hot` rows, whatever
    the input's size. _parts says over how many parts to deal a key's rows for parts of 1/hot of all rows."""
    counts = keys.groupBy(*keys.columns).agg(F.count("*").alias("_count"))
    total = keys.count()
    parts = F.ceil(F.col("_count") * hot / max(total, 1)).cast("int")
    return counts.filter(F.col("_count") * hot > total).select(*keys.columns, parts.alias("_parts"))


def dealt_join(rows: DataFrame, side: DataFrame, on: list[str], how: str = "inner", by: Column | None = None, hot: DataFrame | None = None) -> DataFrame:
    """rows joined with side on equal keys that may be hot in rows and occur a bounded number of times in side.

    Rows of a hot key are dealt over parts by `by` (a hash of all columns if not given), and side's rows of that key
    are copied to each of its parts; all other rows meet as in any join. Nothing is broadcast but the hot keys, of
    which there are fewer than HOT by their definition. rows is read twice: a table, or cheap to compute."""
    parts, part = private(["_parts", "_part"], [*rows.columns, *side.columns])
    hot = written((hot if hot is not None else hot_keys(rows.select(*on))).withColumnRenamed("_parts", parts), "hot")
    deal = F.xxhash64(*rows.columns) if by is None else by
    # Rows with a null key meet nothing; they are dealt out freely, too.
    none = F.greatest(*[F.col(c).isNull() for c in on], F.lit(False))
    left = rows.withColumn(part, deal).join(F.broadcast(hot), on, "left")
    left = left.withColumn(part, F.when(none, F.pmod(part, F.lit(HOT))).when(F.col(parts).isNull(), 0).otherwise(F.pmod(part, parts)).cast("int")).drop(parts)
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts) - 1, F.lit(0))))
    right = side.join(F.broadcast(hot), on, "left").withColumn(part, copies).drop(parts)
    return left.join(right.hint("merge"), [*on, part], how).drop(part)


#: Rows of a written table that may be broadcast: numbers only, 64 bytes each at most.
FEW = 250_000


def near_join(rows: DataFrame, side: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with side, a written table of a few numbers a row: broadcast if its rows, which are counted, are
    at most FEW, so that no row is shuffled; else dealt_join."""
    if side.count() <= FEW:
        return rows.join(F.broadcast(side), on, how)
    return dealt_join(rows, side, on, how)


def private(names: list[str], taken: list[str]) -> list[str]:
    """Column names like the given ones that none of the taken ones equals, letter case aside."""
    low, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in low:
            n += "_"
        out.append(n)
    return out


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, A_Z, a_z)


def words(column: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(column, F.lit("")), BLANK), lambda w: w != "")
