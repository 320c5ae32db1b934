"""Loaders in one call, and several compressions on one context."""

import glob
import os

import pytest
from pyspark.sql import functions as F
from test_graph import EDGE, check_map, small_graph, types_of

from graphloom.operators.tables import shared_folder
from graphloom.plans import api
from graphloom.schema import TypedGraph
from graphloom.sources import loaders


def test_two_methods_read_the_source_once(spark, tmp_path):
    graph = small_graph(spark)
    graph.nodes.write.parquet(str(tmp_path / "nodes"))
    graph.edges.write.parquet(str(tmp_path / "edges"))
    graph = TypedGraph(graph.types, spark.read.parquet(str(tmp_path / "nodes")), spark.read.parquet(str(tmp_path / "edges")), "a")
    tables = lambda: set(glob.glob(shared_folder(spark).removeprefix("file:") + "/context-*"))
    before = tables()
    c = api.prepared(graph, emb_method="fast")
    os.rename(tmp_path / "nodes", tmp_path / "gone")
    os.rename(tmp_path / "edges", tmp_path / "gone too")
    assert len(tables() - before) >= 6
    with c:
        for run, how in ((api.compress, {"levels": 1, "outers": 2}), (api.compress_cgc_homo, {})):
            res = run(c.graph, 0.5, context=c, **how)
            check_map(c.graph, res.node_map.select("gid", "root"))
            assert 0.2 < res.ratio < 0.9
    assert tables() == before and c.paths == []
    with pytest.raises(ValueError, match="emb_method"):
        api.prepared(small_graph(spark), emb_method="none")
    assert tables() == before


def test_parts_and_classes(spark):
    types = types_of(spark, ("a", 4), ("p", 5), ("v", 3))
    nodes = [(0, i, i, [float(i)], [0, -1, 1, -1][i], False, False, False) for i in range(4)] + [(1, i, 4 + i, None, None, False, False, False) for i in range(5)] + [(2, i, 9 + i, None, None, False, False, False) for i in range(3)]
    n = spark.createDataFrame(nodes, "type_id int, node_id long, gid long, x array<double>, y int, is_train boolean, is_val boolean, is_test boolean")
    # Authors 0 and 2 are labelled; papers 1 and 4 are theirs; venue 2 has paper 4. The first relation came the wrong way round.
    e = [("a", "writes", "p", p, a) for p, a in [(1, 0), (0, 1), (4, 2), (4, 3)]] + [("v", "has", "p", 2, 4), ("v", "has", "p", 0, 0)]
    g = TypedGraph(types, n, spark.createDataFrame(e, EDGE), "a")
    got = loaders.labelled_part(g, [("p", "a"), ("v", "p")])
    assert [(r.node_type, r.n, r.offset) for r in got.types.orderBy("type_id").collect()] == [("a", 2, 0), ("p", 2, 2), ("v", 1, 4)]
    assert sorted((r.gid, r.y, r.x) for r in got.nodes.where("type_id = 0").collect()) == [(0, 0, [0.0]), (1, 1, [2.0])]
    assert sorted((r.rel, r.src, r.dst) for r in got.edges.collect()) == [("has", 0, 1), ("writes", 0, 0), ("writes", 1, 1)]
    assert got.nodes.where("is_train").count() == 1 and got.nodes.where("is_val").count() == 1
    assert loaders.labelled_part(g, [("p", "a")], most=1).nodes.where("type_id = 0").count() == 1
    some = loaders.classes_by_link(g, "p", {4: 1, 0: 0}, [("p", "a")])
    assert sorted((r.node_id, r.y) for r in some.nodes.where("type_id = 0").collect()) == [(0, 0), (1, 1), (2, 1)]
    none = loaders.classes_by_link(g, "p", {3: 0}, [("p", "a")])
    assert none.nodes.count() == none.edges.count() == none.types.count() == 0


def test_means_and_sparse_matrices(spark):
    entries = lambda *rows: spark.createDataFrame(list(rows), "row long, col long, value double")
    f = entries((1, 1, 2.0), (1, 1, 1.0), (1, 2, 4.0), (3, 2, 1.0))
    y = entries((1, 2, 1.0), (2, 1, 0.5), (2, 3, 0.5))
    g = loaders.from_coo({"p": 3, "a": 3}, "p", f, y, [("a", "writes", "p", entries((1, 1, 1.0), (1, 3, 1.0), (1, 3, 1.0), (2, 2, 1.0), (3, 3, 0.0)))], dim=2, base=1)
    assert sorted((r.node_id, r.x, r.y) for r in g.nodes.where("type_id = 0").collect()) == [(0, [3.0, 4.0], 1), (1, [0.0, 0.0], 0), (2, [0.0, 1.0], -1)]
    assert sorted((r.src, r.dst) for r in g.edges.collect()) == [(0, 0), (0, 2), (0, 2), (1, 1)]
    m = loaders.with_reverse(loaders.mean_features(loaders.unit_features(g, "p"), [("a", "writes", "p")]), [("a", "writes", "p")])
    got = {r.node_id: r.x for r in m.nodes.where("type_id = 1").collect()}
    assert got == {0: pytest.approx([0.2, 2.8 / 3]), 1: [0.0, 0.0], 2: [0.0, 0.0]}
    assert m.edges.where("rel = 'rev_writes' and src_type = 'p' and dst_type = 'a'").count() == 4
    flags = g.nodes.where("type_id = 0").agg(*(F.count_if(c).alias(c) for c in loaders.FLAGS)).first()
    assert tuple(flags) == (2, 0, 0) or sum(flags) == 2
