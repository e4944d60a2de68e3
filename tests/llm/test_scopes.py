"""Tables that are written on the way to a result."""

import threading
from pathlib import Path

from evigrain.llm import grid_join, hilbert_shards
from evigrain.llm.shared import run_folder, settled, written


def tables(spark) -> set[str]:
    return {p.name for p in Path(run_folder(spark).removeprefix("file://")).iterdir()}


def test_only_the_result_stays(spark):
    before = tables(spark)
    inner = lambda: settled(spark, lambda: written(spark.range(5), "a").unionByName(written(spark.range(2), "b")), "inner")
    out = settled(spark, lambda: inner().filter("id > 0"), "outer")
    assert out.count() == 5 and [n.split("-")[0] for n in tables(spark) - before] == ["outer"]


def test_a_failure_leaves_nothing(spark):
    before = tables(spark)

    def build():
        written(spark.range(5), "a")
        raise ValueError

    try:
        settled(spark, build, "out")
    except ValueError:
        pass
    assert tables(spark) == before


def test_threads_keep_their_own_tables(spark):
    """A table that another thread writes while this one is inside settled() is not deleted."""
    inside, done, other = threading.Event(), threading.Event(), []

    def write():
        inside.wait(60)
        other.append(written(spark.range(7), "other"))
        done.set()

    thread = threading.Thread(target=write)
    thread.start()

    def build():
        inside.set()
        done.wait(60)
        return spark.range(3)

    settled(spark, build, "mine")
    thread.join()
    assert other[0].count() == 7


def test_two_operators_at_once(spark, small):
    got, want = {}, {"join": grid_join.op9_grid_order_join(spark, small).count(), "shards": hilbert_shards.op10_hilbert_sharding(spark, small).count()}
    work = {"join": grid_join.op9_grid_order_join, "shards": hilbert_shards.op10_hilbert_sharding}
    threads = [threading.Thread(target=lambda n=n, f=f: got.__setitem__(n, f(spark, small).count())) for n, f in work.items()]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == want
