"""Running sums over rows sorted by key and order, however many rows a key has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrain.llm.shared import written


def digest(*columns: Column) -> list[Column]:
    """128 bits that tell tuples of columns without nulls apart, as two longs."""
    strings = [c.cast("string") for c in columns]
    told = F.md5(F.concat(*[x for s in strings for x in (F.length(s).cast("string"), F.lit(":"), s)]).cast("binary"))
    return [F.conv(F.substring(told, at, 16), 16, -10).cast("long") for at in (1, 17)]


def running(rows: DataFrame, key: list[str], order: list[str], sums: list[str] = (), xors: list[str] = ()) -> DataFrame:
    """rows, a written table of longs with keys that aren't null, with run_c for each c of sums and xors: the sum (or exclusive or) of c over
    the rows of that key up to this one in that order, which must be total.

    Rows are dealt by ranges of key and order, so that a key with very many rows lies in many tasks; each task sums
    up its own rows, and its last key's totals are handed on to the tasks behind. These are one row a task."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [*sums, *xors]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", run_{c} long" for c in names) + ", part int, tail boolean"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry, waiting = TaskContext.get().partitionId(), None, {}, None
        for b in batches:
            if not b.num_rows:
                continue
            if waiting is not None:
                yield _tailed(waiting, part, False)
            keys = [b[k].to_numpy() for k in key]
            opens = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
            start = np.flatnonzero(opens)
            size = np.diff(np.append(start, b.num_rows))
            same = last is not None and last == [k[0] for k in keys]
            out = []
            for c in names:
                x = b[c].to_numpy()
                with np.errstate(over="ignore"):
                    run = np.bitwise_xor.accumulate(x) if c in xors else np.cumsum(x)
                    before = np.concatenate([[0], run])[start]
                    if same:
                        before[0] = carry[c] if c in xors else -carry[c]
                    run = run ^ np.repeat(before, size) if c in xors else run - np.repeat(before, size)
                carry[c] = run[-1]
                out.append(pa.array(run))
            last = [k[-1] for k in keys]
            waiting = pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, *(f"run_{c}" for c in names)])
        if waiting is not None:
            yield _tailed(waiting, part, True)

    dealt = rows.repartitionByRange(parts, *key, *order).sortWithinPartitions(*key, *order)
    own = written(dealt.mapInArrow(add, schema), "running")
    tails = sorted(own.filter("tail").select("part", *key, *(f"run_{c}" for c in names)).collect(), key=lambda r: r.part)
    carry, last, held = [], None, None
    for r in tails:
        k = tuple(r[1 : 1 + len(key)])
        if held is not None:
            carry.append((r.part, *last, *held))
        told = list(r[1 + len(key) :])
        if held is not None and k == last:
            told = [a ^ b if c in xors else a + b for a, b, c in zip(told, held, names)]
        last, held = k, told
    types = dict(rows.dtypes)
    hand = spark.createDataFrame(carry, ", ".join(["part int", *(f"{k} {types[k]}" for k in key), *(f"more_{c} long" for c in names)]))
    met = own.join(F.broadcast(hand), ["part", *key], "left")
    more = {c: F.coalesce(F.col(f"more_{c}"), F.lit(0)) for c in names}
    return met.select(*rows.columns, *((F.col(f"run_{c}").bitwiseXOR(more[c]) if c in xors else F.col(f"run_{c}") + more[c]).alias(f"run_{c}") for c in names))


def _tailed(batch: pa.RecordBatch, part: int, ends: bool) -> pa.RecordBatch:
    tail = np.zeros(batch.num_rows, bool)
    tail[-1] = ends
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(tail)], [*batch.schema.names, "part", "tail"])
