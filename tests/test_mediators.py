"""Mediator lists, their pairs and energies against plain Python, and how often their rows are shuffled."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import search, topology


def made(spark, seed=1, n=150, m=700):
    rng = np.random.default_rng(seed)
    ends = {(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (m, 2)).tolist() if a != b}
    x = {i: [float(v) for v in rng.normal(size=2)] for i in range(n)}
    nodes = spark.createDataFrame([(i, i % 3, x[i]) for i in range(n)], "gid long, type_id int, x array<double>")
    edges = spark.createDataFrame([(a, b, 1.0 + (a + b) % 3) for a, b in sorted(ends)], "u long, v long, w double")
    lists = defaultdict(list)
    for a, b in ends:
        lists[a, b % 3].append(b)
        lists[b, a % 3].append(a)
    adj = topology.adjacency(edges)
    return nodes, adj, topology.degrees(adj, nodes), x, {k: v for k, v in lists.items() if len(v) > 1}


def test_pairs_are_made_without_a_shuffle(spark):
    nodes, adj, deg, x, lists = made(spark)
    near = topology.mediator_lists(adj, deg, None, nodes)
    ordered = topology.stride_sampled(topology.projected_order(near, nodes), 100)
    pairs = topology.merge_cost(topology.band_pairs(ordered, 3))
    got = {(r.med, r.u, r.v, r.gap): r.cost for r in pairs.collect()}
    want = {}
    for (med, _), us in lists.items():
        row = sorted(us, key=lambda u: (round(x[u][0] - x[u][1], 6), u))
        w = {u: 1.0 + (u + med) % 3 for u in us}
        for i, j in combinations(range(len(row)), 2):
            if j - i <= 3:
                u, v = row[i], row[j]
                want[med, u, v, j - i] = 0.5 * w[u] * w[v] * sum((a - b) ** 2 for a, b in zip(x[u], x[v], strict=True))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(c) for k, c in want.items())
    plan = lambda df: df.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan(pairs).count("Exchange") == plan(near).count("Exchange")


def test_moments_beside_pairs_equal_joined_ones(spark):
    nodes, adj, deg, _, _ = made(spark, 2)
    ordered = topology.projected_order(topology.mediator_lists(adj, deg, None, nodes), nodes)
    a = topology.dirichlet_delta(topology.band_pairs(ordered.drop("x"), 2), ordered, nodes)
    b = topology.dirichlet_delta(topology.band_pairs(topology.moments(ordered, 2), 2, ("weights", "sums", "squares")), ordered, nodes)
    one, two = ({(r.med, r.u, r.v): r.delta for r in d.collect()} for d in (a, b))
    assert one and one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-9) for k in one)


def test_energies_of_the_first_pairs(spark):
    nodes, adj, deg, x, lists = made(spark, 3, 60, 500)
    near = topology.mediator_lists(adj, deg, None, nodes)
    var = spark.createDataFrame([(t, 1.0) for t in range(3)], "type_id int, var double")
    for first, most in ((4, 5), (20, 5), (3, 1)):
        got = {(r.med, r.u, r.v) for r in search.mediator_energies(near, nodes, var, first, most).collect()}
        assert got == {(med, *p) for (med, _), us in lists.items() for p in list(combinations(sorted(us)[:first], 2))[:most]}


def test_percentiles_hold_no_group_in_one_task(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(0, float(v)) for v in rng.lognormal(size=3000)] + [(1, 0.25)] * 40 + [(1, 4.0)] * 3 + [(2, float(v)) for v in rng.normal(size=31)] + [(None, 1.0), (None, 3.0), (3, None)]
    df = spark.createDataFrame(rows, "t int, energy double").repartition(5)
    monkeypatch.setattr(F, "percentile", None)  # it keeps each value of a group in one task
    for share in (0.0, 0.3, 0.987, 1.0):
        got = {r.t: (r.p, r.n) for r in search.percentiles(df, ["t"], "energy", share).collect()}
        of = lambda t: [v for k, v in rows if k == t and v is not None]
        assert got == {t: (pytest.approx(np.quantile(of(t), share)), len(of(t))) for t in (0, 1, 2, None)}
    every = [v for _, v in rows if v is not None]
    assert search.percentiles(df, [], "energy", 0.3).first()["p"] == pytest.approx(np.quantile(every, 0.3))
    assert search.one_shot_scale(df.limit(0), 4.0, 3.0) == 0.4 and search.bases(df.limit(0), 0.3, ["t"]).count() == 0
