"""Tasks with retries, chains of stages, queues of jobs in batch and as a stream."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from evigrain.operators import runs
from evigrain.streaming import queue


def questions(spark, n):
    return spark.createDataFrame([(i, f"q{i}", 5.0) for i in range(n)], "question long, text string, max_score double")


def counting(folder, fails: dict):
    """A task that notes each call, and fails the given number of times for a question."""

    def task(row):
        from pathlib import Path

        log = Path(folder) / f"{row['question']}"
        with log.open("a") as f:
            f.write("x")
        if len(log.read_text()) <= fails.get(row["question"], 0):
            raise OSError("not yet")
        return {"answer": f"a{row['question']}", "score": 2.0}

    return task


def test_retries_results_and_resume(spark, tmp_path):
    calls, folder = tmp_path / "calls", f"file://{tmp_path}/results"
    calls.mkdir()
    task = counting(str(calls), {3: 2, 5: 3, 7: 99})
    told = {r.question: r for r in runs.run(questions(spark, 10), task, folder, 2, 0.01, batch=4).collect()}
    assert len(told) == 10 and (told[3].status, told[3].attempts, told[3].answer) == ("completed", 3, "a3")
    assert {q for q, r in told.items() if r.status == "runner_error"} == {5, 7} and told[7].error == "not yet" and told[7].max_score == 5.0
    before = {p.name: p.read_text() for p in calls.iterdir()}
    # Nothing is left; then more questions come; then the failed ones are tried again.
    assert runs.run(questions(spark, 10), task, folder, 2, 0.01).count() == 10
    assert {p.name: p.read_text() for p in calls.iterdir()} == before
    assert runs.run(questions(spark, 12), task, folder, 2, 0.01).count() == 12 and len((calls / "3").read_text()) == 3
    told = {r.question: r.status for r in runs.run(questions(spark, 12), task, folder, 2, 0.01, retry_failed=True).collect()}
    assert [q for q, s in told.items() if s == "runner_error"] == [7] and len((calls / "1").read_text()) == 1


def test_a_batch_that_is_not_whole_does_not_count(spark, tmp_path):
    folder = f"file://{tmp_path}/results"
    task = counting(str(tmp_path), {})
    runs.run(questions(spark, 6), task, folder, batch=2)
    (next((tmp_path / "results").glob("run=1/batch=*")) / "_SUCCESS").unlink()
    left = 6 - runs.kept(spark, folder).count()
    assert left > 0 and runs.run(questions(spark, 6), task, folder).count() == 6


def test_a_failing_row_stops_alone_and_a_chain_goes_on(spark, tmp_path):
    log = tmp_path / "log"

    def note(name, bad):
        def work(row):
            with log.open("a") as f:
                f.write(f"{name}{row['id']} ")
            if row["id"] in bad:
                raise ValueError(f"bad {row['id']}")
            return {name: f"{name}{row['id']}"}

        return runs.Stage(name, runs.attempted(work, f"{name} string"))

    stages = [note("a", {1}), note("b", {2}), note("c", set())]
    rows = spark.createDataFrame([(i,) for i in range(4)], "id long")
    folder = f"file://{tmp_path}/chain"
    runs.chain(rows, stages[:2], folder)
    told = {r.id: r for r in runs.chain(rows, stages, folder).collect()}
    assert {i: (r.stage, r.error) for i, r in told.items()} == {0: ("done", None), 1: ("a", "ValueError: bad 1"), 2: ("b", "ValueError: bad 2"), 3: ("done", None)}
    assert (told[2].a, told[2].b, told[3].c) == ("a2", None, "c3")
    assert sorted(log.read_text().split()) == ["a0", "a1", "a2", "a3", "b0", "b2", "b3", "c0", "c3"]
    assert {(r.stage, r.n) for r in runs.by_stage(runs.chain(rows, stages, folder)).collect()} == {("done", 2), ("a", 1), ("b", 1)}


START = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENTS = "queue string, at timestamp, id long, kind string, job string, worker string, force boolean, reason string"


def event(minute, i, kind, job=None, worker=None, force=False, reason=None, q="q"):
    return (q, START + timedelta(minutes=minute), i, kind, job, worker, force, reason)


def rows(df):
    return sorted((r.queue, r.at.timestamp(), r.state, r.jobs, r.force, r.reasons, r.worker or "") for r in df.collect())


def test_one_worker_at_a_time(spark):
    events = [
        *(event(0, 0, "lease", worker="w"), event(1, 1, "submit", "a", reason="new"), event(2, 2, "submit", "b", force=True, reason="edit"), event(3, 3, "lease", worker="w")),
        *(event(4, 4, "lease", worker="v"), event(5, 5, "submit", "c"), event(6, 6, "done", worker="v"), event(7, 7, "done", worker="w")),
        *(event(8, 8, "lease", worker="v"), event(9, 9, "submit", "c", force=True, reason="again"), event(30, 10, "done", worker="v"), event(31, 11, "lease", worker="w"), event(32, 12, "failed", worker="w")),
    ]
    told = queue.folded(spark.createDataFrame(events, EVENTS)).orderBy("at").collect()
    assert [(r.state, r.jobs, r.force, r.reasons, r.worker) for r in told if r.state not in ("queued", "stale")] == [
        *(("idle", "", False, "", "w"), ("running", "a,b", True, "edit,new", "w"), ("refused", "", False, "", "v"), ("ready", "a,b", True, "edit,new", "w"), ("running", "c", False, "unknown", "v")),
        *(("expired", "c", False, "unknown", "v"), ("running", "c", True, "again", "w"), ("failed", "c", True, "again", "w")),
    ]
    assert [r.worker for r in told if r.state == "stale"] == ["v", "v"]
    assert queue.folded(spark.createDataFrame([], EVENTS)).count() == 0


@pytest.mark.parametrize("seed", [1])
def test_the_stream_tells_what_the_fold_tells(spark, tmp_path, seed):
    draw = random.Random(seed)
    kinds = ["submit", "submit", "lease", "done", "failed"]
    events = [event(m * 3 + draw.random(), i, draw.choice(kinds), f"j{draw.randrange(3)}", f"w{draw.randrange(2)}", draw.random() < 0.2, draw.choice(["x", "y"]), f"q{draw.randrange(2)}") for i, m in enumerate(range(40))]
    # They come out of order within the delay; one comes far too late; at the end time passes in both queues.
    arrival = sorted(events, key=lambda e: e[1] + timedelta(minutes=draw.random() * 8))
    late = event(1, 900, "submit", "late", q="q0")
    end = [event(600, 1000 + i, "lease", worker="z", q=f"q{i}") for i in range(2)] + [event(900, 1100 + i, "lease", worker="z", q=f"q{i}") for i in range(2)]
    files = [arrival[i : i + 10] for i in range(0, 40, 10)] + [[late], end[:2], end[2:]]
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for i, part in enumerate(files):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.json(str(tmp_path / f"f{i}"))
        next((tmp_path / f"f{i}").glob("part-*")).rename(source / f"{i}.json")
        import os

        os.utime(source / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = queue.streamed(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(source)))
    stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    upto = int((START + timedelta(minutes=890)).timestamp() * 1000)
    want = queue.folded(spark.createDataFrame(events + end, EVENTS))
    got = spark.read.parquet(str(out))
    assert rows(queue.at_most(got, upto)) == rows(queue.at_most(want, upto)) and "late" not in {j for r in got.collect() for j in r.jobs.split(",")}
