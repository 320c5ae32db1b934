"""Edges that carry their relation's number."""

from pyspark.sql import functions as F

from graphloom.operators import embed
from graphloom.schema import named_relations, numbered_relations


def test_relations_are_numbered_and_named_again(spark):
    rows = [("a", "to", "b", 1, 2), ("a", "of", "b", 1, 2), (None, "of", "b", 3, 4), ("a", "to", "b", 5, 6)]
    g = spark.createDataFrame(rows, "src_type string, rel string, dst_type string, s long, d long")
    n, relations = numbered_relations(g)
    assert n.columns == ["s", "d", "rel_no"] and relations == [(None, "of", "b"), ("a", "of", "b"), ("a", "to", "b")]
    assert sorted(map(tuple, named_relations(n, relations).collect()), key=str) == sorted(rows, key=str)
    none = numbered_relations(g.limit(0))
    assert none[1] == [] and named_relations(*none).count() == 0


def test_sampled_neighbours_send_no_names(spark):
    g = spark.createDataFrame([("a", "to", "b", s, 0) for s in range(5)], "src_type string, rel string, dst_type string, s long, d long")
    out = embed.sampled_neighbours(g, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(rel_no" in plan and "hashpartitioning(src_type" not in plan
    key = lambda s: F.md5(F.lit(f"0:{s}:0"))
    order = spark.range(1).select(*(key(s).alias(str(s)) for s in range(5))).first().asDict()
    assert {r["s"] for r in out.collect()} == {int(s) for s in sorted(order, key=order.get)[:3]}
