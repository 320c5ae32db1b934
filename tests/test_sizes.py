"""Shuffles that grow with the graph, types told by ranges of ids, counts and energies without whole lists."""

import pytest
from pyspark.sql import functions as F
from test_mediators import made

from graphloom.operators import quotient, search, tables, topology
from graphloom.sources import graphs


@pytest.fixture
def small_rows(monkeypatch, spark):
    had = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(tables, "ROWS", 100)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", had)
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_shuffles_are_sized_by_a_graphs_edges(spark, small_rows):
    nodes = spark.range(40).select(F.col("id").alias("node_id"), F.lit(None).cast("array<double>").alias("x"), F.lit(None).cast("int").alias("y"))
    edges = graphs.relation(spark.range(900).select((F.col("id") % 40).alias("a"), (F.col("id") * 7 % 40).alias("b")), "n", "to", "n", "a", "b")
    g = graphs.assembled([(0, "n", nodes)], edges, "n")
    assert spark.conf.get("spark.sql.shuffle.partitions") == "18"
    tables.sized_shuffles(spark, 10)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "18"  # never lowered
    m = quotient.node_map(g.nodes, g.nodes.select("gid", (F.col("gid") - F.col("gid") % 4).alias("root")))
    q = quotient.quotient_edges(g.edges, g.types, m)
    assert "9), REPARTITION_BY_NUM" in q._jdf.queryExecution().executedPlan().toString()
    assert q.agg(F.sum("cnt")).first()[0] == 900


def test_types_are_told_by_ranges_or_joined(spark):
    for kind, joined in ((F.expr("id div 50"), False), (F.expr("id % 2"), True)):
        nodes = spark.range(100).select(F.col("id").alias("gid"), kind.cast("int").alias("type_id"))
        rows = spark.range(-5, 110).withColumnRenamed("id", "u")
        out = topology.typed(rows, "u", "t", nodes)
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, nodes.collect()))
        assert ("Join" in out._jdf.queryExecution().optimizedPlan().toString()) == joined


def test_counts_and_energies_need_no_whole_lists(spark):
    nodes, adj, deg, x, lists = made(spark)
    got = {(r.med, r.t_src): r.k for r in topology.mediator_counts(adj, nodes, False).collect()}
    assert got == {k: len(v) for k, v in lists.items()}
    bare = topology.mediator_lists(adj, deg, None)
    var = topology.feature_variance(nodes)
    pick = lambda e: sorted((r.med, r.u, r.v, round(r.energy, 9)) for r in e.collect())
    e = search.mediator_energies(bare, nodes, var)
    assert pick(e) == pick(search.mediator_energies(topology.mediator_lists(adj, deg, None, nodes), nodes, var))
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert "<= 6)" in plan  # of each list, the few neighbours that make pairs meet their features
