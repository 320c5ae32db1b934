"""Single nodes move to the nearest of all visible groups, however many there are, and pairs are never listed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import coarsen, nearest


def test_the_nearest_group_may_lie_behind_many_others(spark):
    """40 groups of two around two mediators, of which the one with the largest id is the nearest (a limit of 32 lost it)."""
    near = [(g, 0, [float(100 - g // 2), 0.0]) for g in range(2, 82)] + [(500, 0, [59.0, 0.0])]
    nodes = spark.createDataFrame([(m, 1, [1.0, 0.0]) for m in (0, 1)] + near, "gid long, type_id int, x array<double>")
    edges = spark.createDataFrame([(m, g, 1.0) for m in (0, 1) for g, _, _ in near], "u long, v long, w double")
    cmap = spark.createDataFrame([(g, g // 2 * 2 if 2 <= g < 82 else g) for g in (0, 1, *(r[0] for r in near))], "gid long, root long")
    moved = coarsen.reassigned(coarsen.Kernel(nodes, edges), cmap, 0.1).collect()
    assert [(r.gid, r.root) for r in moved] == [(500, 80)]


@pytest.mark.parametrize("many", [4, 512])
def test_nearest_in_groups(spark, monkeypatch, many):
    monkeypatch.setattr(nearest, "MANY", many)
    monkeypatch.setattr(nearest, "SOME", 2)
    monkeypatch.setattr(nearest, "PAIRS", 50)
    rng = np.random.default_rng(3)
    point = lambda: [float(v) for v in rng.integers(0, 6, 2)]  # many ties
    rows, where = [], {g: point() for g in range(60)}
    for med in range(9):
        if med != 4:
            rows.append((med, 0, 7 if med == 5 else 9, None, None))
        rows += [(med, 1, 7 + g % 2, g, where[g]) for g in rng.integers(0, 60, 40).tolist()]
        rows += [(med, 2, 7 + a % 2, a, [float(a % 6), float(a % 5) + 0.25]) for a in range(100, 130) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "med long, kind int, type_id int, id long, x array<double>").repartition(5)
    kept = {(m, t) for m, k, t, _, _ in rows if k == 0}
    own = dict(kept)
    want = {}
    for m, k, t, a, x in rows:
        if k == 2 and m in own and own[m] != t:
            found = [(round(sum((p - q) ** 2 for p, q in zip(x, y, strict=True)), 9), g) for m2, k2, t2, g, y in rows if (m2, k2, t2) == (m, 1, t)]
            if found:
                want[a] = min(want.get(a, (np.inf, 0)), min(found))
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(batch)
    spark.conf.set(batch, "7")
    try:
        out = nearest.nearest_in_groups(df).groupBy("gid", "type_id").agg(F.min(F.struct("d", "root")).alias("b")).collect()
    finally:
        spark.conf.set(batch, usual)
    assert {r.gid: (r.b.d, r.b.root) for r in out} == want and len(want) > 20
    assert all(r.type_id == 7 + r.gid % 2 for r in out)
