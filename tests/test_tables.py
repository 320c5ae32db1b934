"""What settled tables leave on disk."""

import os
import time

from pyspark.sql import functions as F

from graphloom.operators import baselines, coarsen, tables, topology


def shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().endswith(".data") for i in range(files.size()))


def test_a_settled_table_leaves_no_shuffle(spark):
    before = shuffle_files(spark)
    df = spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 10).alias("k")).count()
    out = tables.settled(df)
    end = time.time() + 20
    while shuffle_files(spark) > before and time.time() < end:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    assert out.count() == 10 and df.count() == 10 and spark.conf.get(tables.CLEANUP) == "false"


def test_a_dropped_table_is_deleted(spark):
    one, two = (tables.settled(spark.range(10)) for _ in range(2))
    files = [t._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:") for t in (one, two)]
    assert all(os.path.exists(f) for f in files)
    tables.dropped(one, None)
    assert not os.path.exists(files[0]) and two.count() == 10


def test_a_pass_leaves_what_it_names(spark):
    path = lambda t: t._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    with tables.passing() as keep:
        one = tables.settled(spark.range(10))
        with tables.passing() as inner:
            two, three = tables.settled(spark.range(5)), tables.settled(spark.range(6))
            inner(two, three)
        keep(two)
    assert not os.path.exists(path(one)) and not os.path.exists(path(three)) and two.count() == 5
    tables.settled(spark.range(3))
    assert tables.MADE.get() is None


def test_the_last_pass_builds_no_graph(spark, monkeypatch):
    """A run's last pass needs no graph for the next one; older tables of a run are gone, its map is whole."""
    rows = [(i, 0, [i * 0.01]) for i in range(12)] + [(100 + i, 1, [0.5]) for i in range(6)]
    nodes = spark.createDataFrame(rows, "gid long, type_id int, x array<double>")
    edges = spark.createDataFrame([(i, 100 + j, 1.0) for i in range(12) for j in {i // 2, (i // 2 + 1) % 6}], "u long, v long, w double")
    built = []
    real = coarsen.rebuilt
    monkeypatch.setattr(coarsen, "rebuilt", lambda *a: built.append(1) or real(*a))
    for outers in (1, 2):
        built.clear()
        out, info = coarsen.coarsened(coarsen.Kernel(nodes, edges), 5.0, levels=1, outers=outers, window=3, cap=8)
        assert len(built) == outers - 1 and len(info["history"]) == outers
        got = {r.gid: r.root for r in out.collect()}
        assert set(got) == {r[0] for r in rows} and all(got[r] == r for r in got.values()) and len(set(got.values())) == info["supernodes"]


def test_signatures_list_only_what_starts_reach(spark, monkeypatch):
    """A start, its neighbour and that one's neighbour: a far part of the graph is never listed."""
    links = [(0, 1), (1, 2), (2, 3), *((10 + i, 20 + j) for i in range(5) for j in range(5))]
    adj = topology.adjacency(spark.createDataFrame(links, "u long, v long"))
    rows, real = [], baselines.merged_smallest

    def counted(df, *a):
        rows.append({r.gid for r in df.select("gid").distinct().collect()})
        return real(df, *a)

    monkeypatch.setattr(baselines, "merged_smallest", counted)
    for again in (True, False):
        got = {(r.gid, r.o) for r in baselines.signatures(adj, spark.createDataFrame([(0,)], "gid long"), 2, 9, again).collect()}
        assert got == {(0, 0), (0, 1), (0, 2)}
    assert rows == [{0, 1}, {0}] * 2
