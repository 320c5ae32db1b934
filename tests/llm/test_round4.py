"""Tests of the changes made for the findings of round 3, last part."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("xxhash")

from graphloom.llm import ngram_join  # noqa: E402


def fragments_of(spark, sets):
    rows = []
    fine = ngram_join.fine_of(sets).to_pylist()
    for i, s in enumerate(sets):
        f = (s.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(61)
        rows += [(i, len(s), k, s[f == k].tolist(), fine[i * ngram_join.ROWS + k]) for k in range(ngram_join.ROWS)]
    return spark.createDataFrame(rows, "node long, n long, f int, part array<long>, fine array<int>")


def test_pairs_that_counts_rule_out_meet_no_sets(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 600)
    other = rng.integers(-(2**63), 2**63 - 1, 600)
    short = base[:100]
    sets = [np.unique(x) for x in (base, np.r_[base[:570], other[:30]], np.r_[base[:60], other[:540]], other, base[:400], short, np.r_[short[:95], other[:5]])]
    every = list(itertools.combinations(range(len(sets)), 2))
    want = {p for p in every if 100 * len(np.intersect1d(sets[p[0]], sets[p[1]])) >= 80 * len(np.union1d(sets[p[0]], sets[p[1]]))}
    pairs, fragments = spark.createDataFrame(every, "a long, b long"), fragments_of(spark, sets)
    left = {tuple(r) for r in ngram_join.within_sizes(pairs, fragments, 80).collect()}
    assert want <= left and (0, 3) not in left and (0, 4) not in left
    assert {tuple(r) for r in ngram_join.linked(pairs, fragments, 80).collect()} == want and want


def test_keys_of_one_node_send_it_once():
    batch = ngram_join.ends_batch(np.array([7, 7, 8]), np.array([3, 5, 4]), "x")
    assert batch.to_pydict() == {"x": [7, 8], "lo": [3, 4], "hi": [5, None]}
    assert ngram_join.ends_batch(np.zeros(0, np.int64), np.zeros(0, np.int64), "x").num_rows == 0
    assert isinstance(ngram_join.fine_of([]), pa.ListArray)
