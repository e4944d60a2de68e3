"""A stream of captured events gives what the batch gives; a repeated batch replaces itself."""

import json

from evigrain.streaming import folds

SCHEMA = "ts TIMESTAMP, user_id LONG, event_type STRING, value DOUBLE"


def test_stream_equals_batch(spark, tmp_path):
    for n in range(3):
        lines = [json.dumps({"ts": f"2024-01-01T0{n}:{m:02d}:00", "user_id": m % 20 // 10, "event_type": "click" if m % 3 else "view", "value": 1.0}) for m in range(0, 60, 10)]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(lines) + "\n")
    folder = str(tmp_path / "in")
    stream = folds.folded_events(folds.captured(spark, folder, SCHEMA, files_per_trigger=1))
    q = stream.writeStream.format("memory").queryName("folded").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    want = folds.folded_events(spark.read.schema(SCHEMA).json(folder)).collect()
    assert sorted(map(tuple, spark.table("folded").collect())) == sorted(map(tuple, want)) and len(want) == 6


def test_batches_replace_themselves(spark, tmp_path):
    write = folds.once_per_batch(lambda df, path: df.write.mode("overwrite").parquet(path), str(tmp_path))
    for _ in range(2):
        write(spark.range(3), 0)
    assert spark.read.parquet(str(tmp_path)).count() == 3


def test_jobs(spark):
    jobs = spark.createDataFrame([("a", False, "x"), ("a", True, "y"), ("b", False, "x")], "target string, force boolean, reason string")
    assert {r.target: (r.force, r.reasons) for r in folds.coalesced_jobs(jobs).collect()} == {"a": (True, ["x", "y"]), "b": (False, ["x"])}
