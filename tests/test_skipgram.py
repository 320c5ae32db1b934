"""Skip-gram vectors trained in shards."""

import random

import numpy as np

from graphloom.operators import embed, skipgram


def cliques(spark, n=400, length=9):
    rng = random.Random(1)
    return spark.createDataFrame([(i, [rng.randrange(10) + 10 * (i % 2) for _ in range(length)]) for i in range(n)], "gid long, walk array<long>")


def test_no_walks_give_no_vectors(spark):
    assert embed.word_vectors(spark, spark.createDataFrame([], "gid long, walk array<long>"), 4).count() == 0


def test_shards_learn_who_walks_together(spark, monkeypatch):
    monkeypatch.setattr(skipgram, "TOKENS", 900)
    w = cliques(spark)
    got = {r.gid: np.array(r.vector) for r in skipgram.skip_gram(w, 8, 3, epochs=40).collect()}
    assert set(got) == set(range(20)) and {len(v) for v in got.values()} == {8}
    cos = lambda a, b: got[a] @ got[b] / np.linalg.norm(got[a]) / np.linalg.norm(got[b])
    same = [cos(a, b) for a in range(20) for b in range(a) if a // 10 == b // 10]
    apart = [cos(a, b) for a in range(20) for b in range(a) if a // 10 != b // 10]
    assert np.mean(same) > np.mean(apart) + 0.5
    again = {r.gid: np.array(r.vector) for r in skipgram.skip_gram(w.repartition(3), 8, 3, epochs=2).collect()}
    once = {r.gid: np.array(r.vector) for r in skipgram.skip_gram(w, 8, 3, epochs=2).collect()}
    assert all(np.allclose(again[g], once[g]) for g in once)
