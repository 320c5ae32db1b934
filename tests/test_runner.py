"""Runs, baselines, stored maps, resuming sweeps, trained networks on quotients, components by type, finalised roots."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_graph import check_map, small_graph

from graphloom.operators import coarsen, reduce, search
from graphloom.plans import api, experiments
from graphloom.schema import global_edges


def test_a_sweep_goes_on_where_it_was_stopped(spark, tmp_path):
    graph, calls = small_graph(spark), []

    def run(g, ratio, compressor, seed, **how):
        if len(calls) == 3:
            raise RuntimeError("stopped")
        calls.append((ratio, seed))
        return {"accuracy": ratio + seed, "only": None if ratio > 0.2 else "x"}

    args = (graph, [0.5, 0.1], None, str(tmp_path / "log"), "a")
    with pytest.raises(RuntimeError):
        experiments.resumed_sweep(*args, runs=2, run=run)
    assert calls == [(0.5, 42), (0.5, 43), (0.1, 42)]
    rest = []
    out = experiments.resumed_sweep(*args, runs=2, run=lambda g, ratio, c, seed: rest.append((ratio, seed)) or {"accuracy": 0.0})
    assert rest == [(0.1, 43)] and [(r["ratio"], r["seed"], r["accuracy"]) for r in out] == [(0.5, 42, 42.5), (0.5, 43, 43.5), (0.1, 42, 42.1), (0.1, 43, 0.0)]
    assert experiments.logged(spark, args[3], "b") == []


def test_run_baseline_and_stored_map(spark):
    graph = small_graph(spark)
    one = experiments.run_once(graph, 0.5, api.compress_random_type, seed=3)
    assert 0 <= one["accuracy"] <= one["upper_bound"] <= 1 and one["ratio"] == 0.5 and one["seconds_evaluate"] > 0
    base = experiments.run_baseline(graph)
    assert base["upper_bound"] == 1 and 0 <= base["accuracy"] <= 1
    stored = experiments.eval_pipeline(graph, "mine", graph.nodes.select("gid", F.col("gid").alias("root")))
    assert stored["retention"] == 1 and stored["by_type"] == {"a": 1, "b": 1} and stored["accuracy"] == pytest.approx(base["accuracy"])


def test_network_on_a_quotient(spark):
    graph = small_graph(spark)
    res = api.compress_random_type(graph, 0.5, use_soft_labels=True)
    pred, history = experiments.network(graph, res.data, epochs=2, hidden=4, layers=1, rate=0.05)
    assert len(history) == 3 and history[-1]["loss"] < history[0]["loss"]
    assert pred.count() == 20 and {r.type_id for r in pred.collect()} == {0}
    record = experiments.run_once(graph, 0.5, api.compress_random_type, model="gnn", training={"epochs": 1, "hidden": 4, "layers": 1})
    assert record["epochs"] == 2 and 0 <= record["accuracy"] <= 1


def test_split_anew_below_five(spark):
    graph = small_graph(spark)
    few = spark.range(30).select(F.col("id").alias("super_id"), F.when(F.col("id") < 25, F.lit(1)).otherwise(-1).alias("y"), F.lit(True).alias("is_train"), F.lit(False).alias("is_val"), F.lit(False).alias("is_test"))
    out = experiments.enough_validation(graph, few).collect()
    assert len(out) == 30 and sum(r.is_train for r in out) == 15 and sum(r.is_val for r in out) == 5 and sum(r.is_test for r in out) == 5
    assert not any(r.is_train or r.is_val or r.is_test for r in out if r.y < 0)
    many = few.withColumn("is_val", F.col("super_id") < 6)
    assert sum(r.is_val for r in experiments.enough_validation(graph, many).collect()) == 6


def test_trained_embedding_compresses(spark):
    graph = small_graph(spark)
    res = api.compress(graph, 0.5, emb_method="gnn", pretrain_epochs=1, pca_dim=2, levels=1, outers=2)
    check_map(graph, res.node_map.select("gid", "root"))
    assert 0.2 < res.ratio <= 0.9 and set(res.info["explained_variance"]) == {0, 1}


def test_components_by_type(spark):
    rng = np.random.default_rng(0)
    x = {0: rng.normal(size=(60, 5)) * [9, 5, 1, 0.1, 0.1] + 7, 1: rng.normal(size=(2, 4)), 2: rng.normal(size=(30, 2))}
    rows = [(100 * t + i, t, v.tolist()) for t, m in x.items() for i, v in enumerate(m)] + [(999, 0, None)]
    out, share = reduce.pca_by_type(spark.createDataFrame(rows, "gid long, type_id int, x array<double>").repartition(3), 2)
    got = {r.gid: r.x for r in out.collect()}
    centred = x[0] - x[0].mean(0)
    u, s, v = np.linalg.svd(centred, full_matrices=False)
    want = np.abs(centred @ v[:2].T)
    assert np.allclose(np.abs([got[i] for i in range(60)]), want) and got[999] is None
    assert share == {0: pytest.approx((s[:2] ** 2).sum() / (s**2).sum())}
    assert np.allclose([got[100], got[101]], x[1]) and np.allclose([got[200 + i] for i in range(30)], x[2])


def test_types_without_inner_edges_have_distances(spark):
    graph = small_graph(spark)
    g, k = global_edges(graph.edges, graph.types), coarsen.kernel_of(graph)
    dist = search.sampled_distances(g, k.nodes, graph)
    assert g.where("st = dt").count() == 0 and dist.count() > 20 and search.cdf_scale(dist, 4.0) != 0.4
    inner = spark.createDataFrame([(i, i + 1, 0, 0) for i in range(12)], "s long, d long, st int, dt int")
    assert search.sampled_distances(inner, k.nodes, graph).count() <= 12


def test_finished_groups_do_not_move(spark):
    graph = small_graph(spark)
    k = coarsen.kernel_of(graph)
    pairs = [(i, i - i % 2) for i in range(20)] + [(i, i) for i in range(20, 48)]
    cmap = spark.createDataFrame(pairs, "gid long, root long")
    free = {r.gid for r in coarsen.reassign_candidates(k, cmap).collect()}
    done = spark.createDataFrame([(g,) for g in sorted(free)[::2]], "gid long")
    assert free and {r.gid for r in coarsen.reassign_candidates(k, cmap, done=done).collect()} == free - set(sorted(free)[::2])
    out, info = coarsen.coarsened(k, 5.0, 3.0, levels=1, outers=3)
    check_map(graph, out)
    assert info["history"] == sorted(info["history"], reverse=True)
