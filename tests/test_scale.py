"""Ranks, vector sums and smallest entries, against plain Python, with one hot group over many partitions."""

import statistics
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import baselines, coarsen, ranks, smallest, sums, topology


def test_ranks_of_a_hot_group(spark):
    rows = [(0, i * 7919 % 5003, f"x{i % 3}") for i in range(3000)] + [(1, i, None) for i in range(5)] + [(None, 3, "n"), (None, 1, "n"), (2, -1, "one")]
    df = spark.createDataFrame(rows, "t int, v long, i string").repartition(7)
    out = ranks.ranked(df, ["t"], [F.desc("v")], "place", "n", parts=9)
    assert out.columns == ["t", "v", "i", "place", "n"]
    by = defaultdict(list)
    for t, v, _ in rows:
        by[t].append(v)
    got = sorted(((r.t, r.v, r.place, r.n) for r in out.collect()), key=repr)
    assert got == sorted(((t, v, p, len(vs)) for t, vs in by.items() for p, v in enumerate(sorted(vs, reverse=True))), key=repr)
    flat = ranks.ranked(df, [], ["v", "t", "i"], "place", parts=9)
    assert sorted(r.place for r in flat.collect()) == list(range(len(rows)))
    assert ranks.ranked(df.limit(0), ["t"], ["v"], "place", "n").count() == 0


def test_no_task_ranks_a_whole_group(spark):
    df = spark.range(4000).select(F.lit(1).alias("t"), "id")
    sizes = ranks.ranked(df, ["t"], ["id"], "place", parts=8).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 2000


@pytest.mark.parametrize("wide", [128, 2])
def test_vector_sums(spark, monkeypatch, wide):
    monkeypatch.setattr(sums, "WIDE", wide)
    rng = np.random.default_rng(2)
    rows = [(i % 4, rng.normal(size=3 + (i % 4 == 3)).tolist(), float(rng.random() + 0.1)) for i in range(200)] + [(1, None, 2.0), (9, None, 1.0)]
    df = spark.createDataFrame(rows, "k int, x array<double>, w double").repartition(5)
    by = defaultdict(list)
    for k, x, w in rows:
        if x is not None:
            by[k].append((np.array(x), w))
    for how, weight, want in (
        ("mean", None, lambda g: np.mean([x for x, _ in g], 0)),
        ("sum", None, lambda g: np.sum([x for x, _ in g], 0)),
        ("sum", "w", lambda g: np.sum([x * w for x, w in g], 0)),
        ("mean", "w", lambda g: np.sum([x * w for x, w in g], 0) / max(1, sum(w for _, w in g))),
        ("var", None, lambda g: np.var([x for x, _ in g], 0)),
    ):
        got = {r.k: r for r in sums.vectors_by(df, ["k"], "x", how, weight, also=[F.count("*").alias("n")]).collect()}
        assert set(got) == set(by)
        for k, g in by.items():
            assert got[k].n == len(g) and np.allclose(got[k].x, want(g))
    assert sums.vectors_by(df.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("pairs", [False, True])
def test_smallest_entries(spark, pairs):
    rng = np.random.default_rng(4)
    rows = [(int(a), int(b), rng.integers(0, 60, rng.integers(0, 9)).tolist()) for a, b in rng.integers(0, 4, (900, 2))] + [(7, 7, None), (8, 8, []), (None, 1, [1])]
    kind = "array<struct<o:long,v:long>>" if pairs else "array<long>"
    entry = (lambda x: (-x % 5, x)) if pairs else (lambda x: x)
    df = spark.createDataFrame([(a, b, None if x is None else [entry(y) for y in x]) for a, b, x in rows], f"a int, b long, e {kind}").repartition(6)
    want = defaultdict(set)
    for a, b, x in rows:
        if a is not None and x:
            want[a, b] |= {entry(y) for y in x}
    for k in (1, 5, 1000):
        got = {(r.a, r.b): [tuple(x) if pairs else x for x in r.e] for r in smallest.merged_smallest(df, ["a", "b"], "e", k).collect()}
        assert got == {key: sorted(v)[:k] for key, v in want.items()}


def graph(spark, n=120, m=420, seed=0):
    rng = np.random.default_rng(seed)
    ends = {(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (m, 2)).tolist() if a != b} | {(0, i) for i in range(1, 60)}
    nodes = spark.createDataFrame([(i, i % 3, [float(x) for x in rng.normal(size=2)]) for i in range(n)], "gid long, type_id int, x array<double>")
    return nodes, spark.createDataFrame([(a, b, 1.0) for a, b in sorted(ends)], "u long, v long, w double"), ends


def test_signatures_are_the_smallest_of_whole_neighbourhoods(spark):
    nodes, edges, ends = graph(spark)
    near = defaultdict(set)
    for a, b in ends:
        near[a].add(b)
        near[b].add(a)
    for hops, most in ((0, 5), (1, 4), (2, 9), (3, 512)):
        got = defaultdict(list)
        for r in baselines.signatures(topology.adjacency(edges), nodes.where("type_id = 0"), hops, most).collect():
            got[r.gid].append(r.o)
        for g in range(0, 120, 3):
            seen = {g}
            for _ in range(hops):
                seen |= {o for s in seen for o in near[s]}
            assert sorted(got[g]) == sorted(seen)[:most]


def test_two_hop_candidates_are_the_best_of_all(spark):
    nodes, edges, ends = graph(spark, seed=3)
    adj = topology.adjacency(edges)
    near = defaultdict(set)
    for a, b in ends:
        near[a].add(b)
        near[b].add(a)
    deg = topology.degrees(adj, nodes)
    for hub, k in ((12, 3), (1000, 5)):
        got = defaultdict(list)
        for r in topology.two_hop_candidates(adj, deg, hub, k).collect():
            got[r.u].append((r["rank"], r.v))
        for g in range(120):
            seen = {o for m in near[g] if len(near[m]) <= hub for o in near[m]} | near[g]
            best = sorted((o for o in seen if o != g and o % 3 == g % 3), key=lambda o: (-len(near[o]), o))[:k]
            assert [v for _, v in sorted(got[g])] == best


def test_reassignment_sees_the_smallest_groups(spark):
    nodes, edges, ends = graph(spark, seed=5)
    near = defaultdict(set)
    for a, b in ends:
        near[a].add(b)
        near[b].add(a)
    root = {g: g if g % 5 == 0 else (g // 30) * 30 + g % 3 + (3 if g % 3 + (g // 30) * 30 in range(0, 120, 5) else 0) for g in range(120)}
    size = defaultdict(int)
    for r in root.values():
        size[r] += 1
    cmap = spark.createDataFrame(list(root.items()), "gid long, root long")
    k = coarsen.Kernel(nodes, edges)
    caps = {r.type_id: r.cap for r in topology.hub_caps(topology.degrees(topology.adjacency(edges), nodes)).collect()}
    small = {g for g in range(120) if len(near[g]) <= caps[g % 3]}
    want = set()
    for g in small:
        if size[root[g]] == 1:
            seen = {root[o] for m in near[g] & small if m % 3 != g % 3 for o in near[m] if o % 3 == g % 3 and o != g and size[root[o]] > 1}
            want |= {(g, r, g % 3) for r in sorted(seen)[:2]}
    assert {(r.gid, r.root, r.type_id) for r in coarsen.reassign_candidates(k, cmap, 2).collect()} == want and want
