"""The edge cases that define the semantics, invariants of maps, and the driver contract."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import baselines, coarsen, embed, quotient, search, topology
from graphloom.plans import api, catalog, experiments
from graphloom.sources import graphs
from graphloom.schema import TypedGraph, global_edges, infer_target, typed_catalogue, validated

EDGE = "src_type string, rel string, dst_type string, src long, dst long"


def types_of(spark, *counts):
    return typed_catalogue(spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(counts)], "type_id int, node_type string, n long"))


def deduped(spark, types, edges):
    g = global_edges(spark.createDataFrame(edges, EDGE), types)
    return sorted(tuple(r) for r in topology.dedup(g).collect()), topology.dedup_stats(g).first().asDict()


def test_reciprocal_and_parallel_edges(spark):
    types = types_of(spark, ("paper", 2), ("author", 2))
    pairs = [(0, 0), (0, 0), (1, 1)]
    edges, stats = deduped(spark, types, [("paper", "a", "author", s, d) for s, d in pairs] + [("author", "b", "paper", s, d) for s, d in pairs])
    assert edges == [(0, 2), (1, 3)]
    assert stats == {"input_edge_entries": 6, "self_loops_removed": 0, "duplicate_entries_removed": 4, "unique_undirected_edges": 2}


def test_self_loops_and_order(spark):
    edges, stats = deduped(spark, types_of(spark, ("node", 4)), [("node", "r", "node", s, d) for s, d in [(2, 2), (3, 1), (1, 3), (0, 1)]])
    assert edges == [(0, 1), (1, 3)] and stats["self_loops_removed"] == 1 and stats["duplicate_entries_removed"] == 1


def test_empty_and_out_of_range(spark):
    types = types_of(spark, ("node", 3))
    assert deduped(spark, types, []) == ([], {"input_edge_entries": 0, "self_loops_removed": 0, "duplicate_entries_removed": 0, "unique_undirected_edges": 0})
    with pytest.raises(ValueError, match="outside"):
        validated(spark.createDataFrame([("node", "r", "node", 0, 3)], EDGE), types)


def test_seeds_of_a_sweep():
    assert experiments.seeds(42, 2, 1) == [1000042, 1000042, 42, 43]


def small_graph(spark) -> TypedGraph:
    types = types_of(spark, ("a", 40), ("b", 8))
    rng = np.random.default_rng(0)
    nodes = [(0, i, i, [float(i % 5), float(rng.normal() / 9)], i % 3, i % 10 < 6, i % 10 in (6, 7), i % 10 > 7) for i in range(40)] + [(1, i, 40 + i, None, None, False, False, False) for i in range(8)]
    n = spark.createDataFrame(nodes, "type_id int, node_id long, gid long, x array<double>, y int, is_train boolean, is_val boolean, is_test boolean")
    return TypedGraph(types, n, spark.createDataFrame([("a", "in", "b", i, i % 8) for i in range(40)] + [("a", "in", "b", i, (i * 3) % 8) for i in range(40)], EDGE), "a")


def check_map(graph, cmap):
    rows = {r.gid: r.root for r in cmap.collect()}
    kind = {r.gid: r.type_id for r in graph.nodes.collect()}
    assert set(rows) == set(kind)
    assert all(rows[r] == r and kind[g] == kind[r] for g, r in rows.items())
    return rows


def greedy(pairs):
    used, out = set(), set()
    for c, u, v in sorted(pairs):
        if u not in used and v not in used:
            used |= {u, v}
            out.add((u, v))
    return out


def test_matching_is_greedy_by_cost(spark):
    rng = np.random.default_rng(2)
    pairs = {(int(min(a, b)), int(max(a, b))): float(rng.integers(20)) for a, b in rng.integers(0, 60, (150, 2)) if a != b}
    df = spark.createDataFrame([(u, v, c) for (u, v), c in pairs.items()], "u long, v long, cost double")
    got = {(r.u, r.v) for r in coarsen.matching(df, 30).collect()}
    assert got == greedy([(c, u, v) for (u, v), c in pairs.items()])


def test_coarsening_keeps_types_and_is_stable(spark):
    g = small_graph(spark)
    one, info = coarsen.coarsened(coarsen.kernel_of(g), 0.5, 2.0, levels=1, outers=2, window=5, cap=16)
    rows = check_map(g, one)
    assert info["supernodes"] == len(set(rows.values())) < 48


def test_compressors_give_whole_maps(spark):
    g = small_graph(spark)
    for r in (api.compress_random_type(g, 0.25), api.compress_lsh(g, 0.25), api.compress_cgc_homo(g, 0.5), api.compress_freehgc(g, 0.25, 1)):
        check_map(g, r.node_map.select("gid", "root"))
        assert r.node_map.count() == 48 and 0 < r.ratio < 1
        assert r.data.edges.agg(F.sum("cnt")).first()[0] == 80


def test_frozen_types_and_errors(spark):
    g = small_graph(spark)
    m = g.nodes.select("gid", F.when(F.col("gid") < 40, 0).otherwise(40).cast("long").alias("root"))
    frozen = {r.gid: r.root for r in quotient.freeze(m, g.nodes, g.types, ["b"]).collect()}
    assert frozen[47] == 47 and frozen[39] == 0
    with pytest.raises(ValueError):
        quotient.freeze(m, g.nodes, g.types, ["c"])
    with pytest.raises(ValueError):
        api.compress(g, 0.5, edge_weight_mode="odd")
    assert infer_target(g.nodes, g.types) == "a"


def test_buckets_like_an_even_split(spark):
    nodes = spark.createDataFrame([(0, i) for i in range(11)], "type_id int, gid long")
    got = sorted(r.bucket for r in baselines.bucketed(baselines.ranked(nodes, "gid"), 0.25).collect())
    assert got == [0] * 4 + [1] * 4 + [2] * 3


def test_searches_on_a_known_curve():
    def run(s):
        return s, 1 + 9 * min(1.0, s) ** 0.7

    for how in (search.fast_search, search.precise_search):
        _, info = how(run, 0.05, 0.25)
        assert abs(info["compression"] - 4) / 4 < 0.26
    _, info = search.precise_search(lambda s: (s, 2.0), 0.1, 0.1)
    assert info["saturated"]


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog.QUERIES) <= set(e.queries())


def test_compress_reaches_its_ratio(spark):
    g = small_graph(spark)
    r = api.compress(g, 0.5)
    check_map(g, r.node_map.select("gid", "root"))
    assert r.node_map.count() == 48 and 0.4 <= r.ratio <= 0.75


def test_nearest_anchor_loses_no_node(spark):
    n = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0]), (2, 0, [0.9, 0.1]), (3, 1, [1.0]), (4, 0, None)], "gid long, type_id int, x array<double>")
    got = {r.gid: r.root for r in baselines.nearest_anchor(n, n.where("gid < 2").select("gid", "type_id")).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3, 4: 0}


def test_sweep_hands_out_its_seeds():
    seen, done = [], []

    def run(graph, ratio, compressor, seed, **how):
        seen.append((ratio, seed, how["max_candidates"]))
        return {"ratio": ratio}

    out = experiments.run_sweep(None, [0.5, 0.1], None, runs=2, warmup=1, run=run, after=done.append, max_candidates=128)
    assert seen == [(0.5, s, 128) for s in (1000042, 1000042, 42, 43)] + [(0.1, 42, 128), (0.1, 43, 128)]
    assert [r["seed"] for r in out] == [42, 43, 42, 43] and [len(x) for x in done] == [2, 2]
    got = []
    experiments.accepted(lambda graph, seed: None, seed=1) and got.append(1)
    assert got == [1] and experiments.accepted(lambda graph: None, seed=1) == {}


def test_reports_and_orientation(spark, tmp_path):
    rows = [{"method": "a", "ratio": r, "accuracy": a} for r, a in ((0.5, 0.8), (0.5, 0.6), (0.1, None))]
    experiments.report(spark, str(tmp_path / "out"), rows, ["method", "ratio"], ["accuracy"], seeds=[1])
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out" / "summary.md")).collect())
    assert "| a | 0.5000 | 2 | 0.7000 | 0.1000 |" in text
    assert '"records": 3' in "\n".join(r.value for r in spark.read.text(str(tmp_path / "out" / "manifest.json")).collect())
    assert spark.read.parquet(str(tmp_path / "out" / "rows")).count() == 3
    assert experiments.console(rows, ["method", "accuracy"]).split("\n")[1].split() == ["a", "0.8000"]
    assert experiments.label("cgc_homo:fast") == "greedy, untyped on fast"
    types = spark.createDataFrame([(0, "a", 2, 0), (1, "b", 9, 2)], "type_id int, node_type string, n long, offset long")
    e = spark.createDataFrame([("a", "r", "b", 8, 1), ("b", "s", "a", 8, 1)], "src_type string, rel string, dst_type string, src long, dst long")
    assert sorted((r.rel, r.src, r.dst) for r in graphs.oriented(e, types).collect()) == [("r", 1, 8), ("s", 8, 1)]
    with pytest.raises(ValueError):
        graphs.oriented(e.withColumn("dst", F.lit(99).cast("long")), types)


def test_attention_equals_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    x = {i: rng.normal(size=3) for i in range(6)}
    edges = [("a", "r", "b", s, d) for s, d in ((0, 4), (1, 4), (1, 4), (2, 5), (3, 5))] + [("b", "q", "a", 4, 0), ("b", "q", "a", 5, 0)]
    h = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "gid long, h array<double>")
    g = spark.createDataFrame(edges, "src_type string, rel string, dst_type string, s long, d long")

    def mixed(score, value):
        out = {}
        for node in {e[4] for e in edges}:
            mine = [e for e in edges if e[4] == node]
            w = np.exp([score(e) for e in mine])
            out[node] = sum(p * value(e) for p, e in zip(w / w.sum(), mine, strict=True))
        return out

    want = []
    for head in range(2):
        w, a = np.array(embed.weights(3, 4, seed=2 * head)), np.array(embed.weights(8, seed=2 * head + 1))
        raw = lambda e: np.concatenate([x[e[3]] @ w, x[e[4]] @ w]) @ a  # noqa: B023, E731
        want.append(mixed(lambda e: max(raw(e), 0.2 * raw(e)), lambda e: x[e[3]] @ w))  # noqa: B023
    got = {r.gid: r.h for r in embed.gat_forward(h, g, 3, 4, 2).collect()}
    assert set(got) == {0, 4, 5} and all(np.allclose(got[i], (want[0][i] + want[1][i]) / 2) for i in got)
    kind, rel = {"a": 0, "b": 1}, {"r": 0, "q": 1}
    m = lambda seed: np.array(embed.weights(3, 3, seed=seed))
    want = mixed(lambda e: (x[e[3]] @ m(kind[e[0]]) @ m(1000 + rel[e[1]])) @ (x[e[4]] @ m(100 + kind[e[2]])) / 3**0.5, lambda e: x[e[3]] @ m(200 + kind[e[0]]) @ m(2000 + rel[e[1]]))
    got = {r.gid: r.h for r in embed.hgt_forward(h, g, 3).collect()}
    assert all(np.allclose(got[i], want[i]) for i in (0, 4, 5))
