"""Derived tables that are built once and kept: each build is a generation, and a pointer names the current one.

A generation is written whole into a folder of its own, with a manifest of its input files, its version, and the
rows and digests of its tables; it is named by what it holds. Only then the pointer moves, in one atomic rename. A build
whose input files and version are those of the current manifest is not repeated. A reader sees the old generation or the
new one, never a part of one, and generations but the current one and the one before it are deleted.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: What manifests look like; a generation of another format is built anew.
FORMAT = 2


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _swap(spark: SparkSession, path: str, text: str) -> None:
    """Replace the file at path by one rename, so that readers never miss it."""
    fresh, fs = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(options, 1)
    overwrite[0] = options.OVERWRITE
    context.rename(fresh, _fs(spark, path)[0], overwrite)


def _read(spark: SparkSession, path: str) -> str | None:
    p, fs = _fs(spark, path)
    return "\n".join(r[0] for r in spark.read.text(path).collect()) if fs.exists(p) else None


def files(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, modified of the files under a path; nothing is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return listed.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def digest(listing: DataFrame, *more: str) -> str:
    """One digest for a listing: a few bytes a file are folded together, so the order doesn't matter."""
    row = F.sha2(F.concat_ws("|", "file", "bytes", F.unix_micros("modified")), 256)
    folded = listing.select(F.conv(F.substring(row, 1, 15), 16, 10).cast("long").alias("a"), F.conv(F.substring(row, 17, 15), 16, 10).cast("long").alias("b"))
    n, a, b = folded.agg(F.count("*"), F.bit_xor("a"), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return hashlib.sha256(json.dumps([n, a, str(b), *more]).encode()).hexdigest()


def published(tables: dict[str, DataFrame], root: str, sources: str = "") -> str:
    """Write the tables as a generation named by its content, then point CURRENT at it; its folder."""
    spark = next(iter(tables.values())).sparkSession
    build = f"{root}/build-{uuid.uuid4().hex}"
    held = {}
    for name, df in tables.items():
        df.write.parquet(f"{build}/{name}")
        held[name] = {"rows": spark.read.parquet(f"{build}/{name}").count(), "content": _content(spark, f"{build}/{name}")}
    before = manifest(spark, root)
    folder = f"{root}/{hashlib.sha256(json.dumps([sources, held], sort_keys=True).encode()).hexdigest()[:40]}"
    source, fs = _fs(spark, build)
    target = _fs(spark, folder)[0]
    # What has the same name holds the same.
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
    for name in held:
        held[name]["listing"] = _listing(spark, f"{folder}/{name}")
    note = json.dumps({"format": FORMAT, "folder": folder, "sources": sources, "tables": held, "before": before and before["folder"]}, sort_keys=True)
    _swap(spark, f"{root}/CURRENT", json.dumps({"manifest": note, "sha256": hashlib.sha256(note.encode()).hexdigest()}))
    _prune(spark, root, [folder.rsplit("/", 1)[1], *([before["folder"].rsplit("/", 1)[1]] if before else [])])
    return folder


def _content(spark: SparkSession, path: str) -> str:
    """One digest for the contents of a table's files, whatever their names and order."""
    whole = F.sha2("content", 256)
    parts = [F.conv(F.substring(whole, at, 15), 16, 10).cast("long") for at in (1, 17)]
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(parts[0].alias("a"), parts[1].cast("decimal(38,0)").alias("b"))
    n, a, b = found.agg(F.count("*"), F.bit_xor("a"), F.sum("b")).first()
    return hashlib.sha256(json.dumps([n, a, str(b)]).encode()).hexdigest()


def _listing(spark: SparkSession, path: str) -> str:
    """One digest for the names and sizes of a table's files; nothing is read."""
    path_, fs = _fs(spark, path)
    found = sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(path_)) if fs.exists(path_) else []
    return hashlib.sha256(json.dumps([x for x in found if x[0].endswith(".parquet")]).encode()).hexdigest()


def _prune(spark: SparkSession, root: str, keep: list[str]) -> None:
    """Delete generations that aren't to be kept. Builds under way keep their folders."""
    path, fs = _fs(spark, root)
    for s in fs.listStatus(path):
        name = s.getPath().getName()
        if s.isDirectory() and re.fullmatch("[0-9a-f]{40}", name) and name not in keep:
            fs.delete(s.getPath(), True)


def manifest(spark: SparkSession, root: str) -> dict | None:
    """What CURRENT says; None before the first generation. A pointer that doesn't check out is an error, never a
    silent fall back to an older generation."""
    text = _read(spark, f"{root}/CURRENT")
    if text is None:
        return None
    note = json.loads(text)
    if hashlib.sha256(note["manifest"].encode()).hexdigest() != note["sha256"]:
        raise ValueError(f"the pointer under {root} is damaged")
    return json.loads(note["manifest"])


def current(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the current generation; each must have the files that its manifest says."""
    note = manifest(spark, root)
    if note is None:
        raise FileNotFoundError(f"no generation under {root}")
    for name, told in note["tables"].items():
        if _listing(spark, f"{note['folder']}/{name}") != told["listing"]:
            raise ValueError(f"{note['folder']}/{name} does not hold the files that its manifest names")
    return {name: spark.read.parquet(f"{note['folder']}/{name}") for name in note["tables"]}


def to_prune(listing: DataFrame, protected: list[str], now: str) -> DataFrame:
    """The generations (name) that neither are protected nor the current one."""
    return listing.filter(~F.col("name").isin([*protected, now]))


def root_of(spark: SparkSession) -> str:
    """The folder for derived tables: that of spark.checkpoint.dir, which a cluster shares; on one machine, where it
    is unset, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='evigrain-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/") + "/evigrain-store"


def _steps(spark: SparkSession) -> str:
    """The application's own folder for steps; Hadoop deletes it when the driver ends."""
    context = spark.sparkContext
    folder = f"{root_of(spark)}/steps-{context.applicationId}"
    made = context.__dict__.setdefault("_evigrain_steps", set())
    if folder not in made:
        path, fs = _fs(spark, folder)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        made.add(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df as a written table, which ends its lineage: what follows reads it instead of computing it again. It goes with
    the application."""
    path = f"{_steps(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_opened: dict[tuple, dict[str, DataFrame]] = {}


def forget(spark: SparkSession) -> None:
    """Drop the kept tables of this session's folder, so that they are built anew."""
    _opened.clear()
    path, fs = _fs(spark, root_of(spark))
    if fs.exists(path):
        for s in fs.listStatus(path):
            pointer = _fs(spark, f"{s.getPath()}/CURRENT")[0]
            if fs.exists(pointer):
                fs.delete(pointer, False)


def kept(spark: SparkSession, path: str, name: str, build: Callable[[], dict[str, DataFrame]], version: str = "1") -> dict[str, DataFrame]:
    """The tables that build() derives from the files under path: the current generation if its manifest fits, else a new one."""
    sources = digest(files(spark, path), name, version)
    root = f"{root_of(spark)}/{name}-{hashlib.sha256(path.encode()).hexdigest()[:16]}"
    key = (spark.sparkContext.applicationId, root, sources)
    if key not in _opened:
        note = manifest(spark, root)
        if note is None or note.get("format") != FORMAT or note["sources"] != sources:
            published(build(), root, sources)
        _opened[key] = current(spark, root)
    return _opened[key]
