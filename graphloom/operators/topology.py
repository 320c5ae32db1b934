"""Edges, degrees, hub caps, mediators and the candidate pairs that share one.

The two-hop join through mediators is never made whole: hubs go first, each mediator's neighbours of a type are ranked
along a projection and thinned to a cap, and only pairs within a window of ranks are made. Lists carry their neighbours'
features, so edges are shuffled twice (to their neighbour's row, to their mediator) and pairs not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import distance2, dot
from .ranks import ranked
from .smallest import merged_smallest
from .sums import vectors_by, width
from .tables import parts_for, settled


def dedup(global_edges: DataFrame) -> DataFrame:
    """Distinct undirected edges (u < v) over all relations; self-loops go. Copies of an edge mostly lie in different relations, so
    edges are dealt before they are compared."""
    n = parts_for(global_edges.sparkSession, global_edges.count())
    return global_edges.where("s <> d").select(F.least("s", "d").alias("u"), F.greatest("s", "d").alias("v")).repartition(n, "u", "v").distinct()


def dedup_stats(global_edges: DataFrame) -> DataFrame:
    """Entries read, self-loops and duplicates removed, edges left."""
    entry = global_edges.select(F.least("s", "d").alias("u"), F.greatest("s", "d").alias("v")).groupBy("u", "v").count()
    loops = F.sum(F.when(F.col("u") == F.col("v"), F.col("count")).otherwise(0))
    edges = F.sum((F.col("u") < F.col("v")).cast("long"))
    total = F.sum("count")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return entry.agg(zero(total).alias("input_edge_entries"), zero(loops).alias("self_loops_removed"), zero(total - loops - edges).alias("duplicate_entries_removed"), zero(edges).alias("unique_undirected_edges"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of undirected edges, with weight w (1 if absent)."""
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    return edges.select("u", "v", w.alias("w")).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), w.alias("w")))


def degrees(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    """(gid, type_id, degree), 0 for nodes without edges."""
    deg = adj.groupBy(F.col("u").alias("gid")).agg(F.count("*").alias("degree"))
    return nodes.select("gid", "type_id").join(deg, "gid", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def hub_caps(deg: DataFrame, given: bool | int | dict[int, int] = True) -> DataFrame:
    """(type_id, cap): mean + 3 population deviations of a type's degrees, rounded, at least 1; or the ``given`` cap: one
    for all types, or one for each type id, where types without one get the automatic cap."""
    if given is not True:
        own = F.lit(given) if isinstance(given, int) else F.coalesce(*[F.when(F.col("type_id") == t, F.lit(n)) for t, n in given.items()], F.col("cap"))
        return hub_caps(deg).withColumn("cap", own.cast("long"))
    return deg.groupBy("type_id").agg(F.greatest(F.lit(1), F.round(F.avg("degree") + 3 * F.stddev_pop("degree"))).cast("long").alias("cap"))


def type_mean_degree(deg: DataFrame) -> DataFrame:
    return deg.groupBy("type_id").agg(F.greatest(F.lit(1.0), F.avg("degree")).alias("mean_degree"))


def hub_anchors(deg: DataFrame, share: float) -> DataFrame:
    """Nodes among the ceil(n * share) of largest degree of their type, for types with a degree above 1."""
    top = deg.groupBy("type_id").agg(F.max("degree").alias("top")).where("top > 1")
    r = ranked(deg.join(F.broadcast(top.select("type_id")), "type_id", "left_semi"), ["type_id"], [F.desc("degree"), "gid"], "r", "n")
    return r.where(F.col("r") < F.ceil(F.col("n") * share)).select("gid", "type_id", "degree")


def typed(rows: DataFrame, col: str, name: str, nodes: DataFrame) -> DataFrame:
    """``rows`` whose ``col`` is among ``nodes`` (gid, type_id), with its type as ``name``. Where each type's ids are a range without
    gaps or other types' ids, the ranges (one row for each type on the driver) tell the type, and nothing is joined."""
    found = nodes.groupBy("type_id").agg(F.min("gid").alias("lo"), F.max("gid").alias("hi"), F.count("*").alias("n")).orderBy("lo").collect()
    kind = next((f.dataType for f in nodes.schema if f.name == "type_id"))
    apart = all(a["hi"] < b["lo"] for a, b in zip(found, found[1:]))  # noqa: B905
    if not found or not apart or any(r["type_id"] is None or r["lo"] is None or r["hi"] - r["lo"] + 1 != r["n"] for r in found):
        return rows.join(nodes.select(F.col("gid").alias(col), F.col("type_id").alias(name)), col)
    of = F.lit(None)
    for r in found:
        of = F.when(F.col(col).between(r["lo"], r["hi"]), F.lit(r["type_id"])).otherwise(of)
    return rows.withColumn(name, of.cast(kind)).where(F.col(name).isNotNull())


def mediators(deg: DataFrame, caps: DataFrame | None) -> DataFrame:
    """(med, t_med): nodes within their hub cap."""
    kind = deg.select(F.col("gid").alias("med"), F.col("type_id").alias("t_med"), "degree")
    return (kind.join(F.broadcast(caps.withColumnRenamed("type_id", "t_med")), "t_med").where("degree <= cap") if caps is not None else kind).select("med", "t_med")


def mediator_lists(adj: DataFrame, deg: DataFrame, caps: DataFrame | None, features: DataFrame | None = None, order: bool = False) -> DataFrame:
    """(med, t_med, u, t_src, w, k): neighbours u of mediators within their hub cap that have at least two neighbours of
    u's type; k is how many. ``features`` (gid, type_id, x): rows carry x, or, with ``order``, its projection alone."""
    ends = adj.select(F.col("u").alias("med"), F.col("v").alias("u"), "w")
    if features is None:
        near = typed(ends, "u", "t_src", deg)
    else:
        own = projected().alias("proj") if order else F.col("x")
        near = ends.join(features.select(F.col("gid").alias("u"), F.col("type_id").alias("t_src"), own), "u")
    near = near.join(mediators(deg, caps), "med")
    # Lists with an order are sorted once, for their sizes and their ranks.
    whole = in_order(near).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) if "proj" in near.columns else Window.partitionBy("med", "t_src")
    return near.withColumn("k", F.count("*").over(whole)).where("k >= 2")


def mediator_counts(adj: DataFrame, nodes: DataFrame, hubs: bool | int | dict[int, int] = True) -> DataFrame:
    """(t_src, t_med, med, k): the sizes of :func:`mediator_lists`, counted without making them. A node's degree is the sum of its
    counts, so edges are sent once."""
    near = typed(adj.select(F.col("u").alias("med"), F.col("v").alias("u")), "u", "t_src", nodes)
    counts = settled(near.groupBy("med", "t_src").agg(F.count("*").alias("k")))
    sums = counts.groupBy(F.col("med").alias("gid")).agg(F.sum("k").alias("degree"))
    deg = settled(nodes.select("gid", "type_id").join(sums, "gid", "left").withColumn("degree", F.coalesce("degree", F.lit(0))))
    caps = hub_caps(deg, hubs) if hubs is not False else None
    return counts.where("k >= 2").join(mediators(deg, caps), "med").select("t_src", "t_med", "med", "k")


def leaders(lists: DataFrame) -> DataFrame:
    """(t_src, t_med, med, k, leader_rank): mediators by falling neighbour count, then id."""
    one = lists.select("t_src", "t_med", "med", "k").distinct()
    return ranked(one, ["t_src", "t_med"], [F.desc("k"), "med"], "r").withColumn("leader_rank", F.col("r").cast("int") + 1).drop("r")


def projection(x):
    """A sum of x with signs by place: the order in which a mediator's neighbours are compared."""
    from ..functions.vectors import total

    return total(F.transform(x, lambda a, i: a * F.when(i % 2 == 0, 1.0).otherwise(-1.0)))


def projected():
    return F.round(F.coalesce(projection(F.col("x")), F.lit(0.0)), 6)


def projected_order(lists: DataFrame, features: DataFrame) -> DataFrame:
    """Adds proj and r (rank from 0 inside mediator and source type); features (gid, x), of lists that don't carry them."""
    if "x" in lists.columns:
        lists = lists.withColumn("proj", projected())
    elif "proj" not in lists.columns:
        lists = lists.join(features.select(F.col("gid").alias("u"), projected().alias("proj")), "u")
    return lists.withColumn("r", F.row_number().over(in_order(lists)) - 1)


def in_order(lists: DataFrame):
    """The window of a mediator's list. Ranks rise with (proj, u), by which the rows lie sorted already where they were ranked."""
    return Window.partitionBy("med", "t_src").orderBy(*(("proj", "u") if "proj" in lists.columns else ("r",)))


def stride_sampled(ordered: DataFrame, cap: int) -> DataFrame:
    """Keeps the ranks floor(i * k / cap), i < cap, of lists longer than the cap, ranked anew. A rank r is kept iff
    ceil(r * cap / k) * k div cap is r."""
    i = F.ceil(F.col("r") * cap / F.col("k"))
    kept = ordered.where((F.col("k") <= cap) | ((i < cap) & (F.floor(i * F.col("k") / cap) == F.col("r"))))
    return kept.withColumn("r", F.row_number().over(in_order(kept)) - 1)


def band_pairs(ordered: DataFrame, window: int, also: tuple[str, ...] = ()) -> DataFrame:
    """(med, t_src, t_med, u, v, w_u, w_v, gap): pairs whose ranks differ by at most ``window``, with x_u and x_v where lists
    carry x, and ``also``, columns of the list. Each row sees the next ``window`` rows of its list: nothing is joined."""
    x = ["x"] if "x" in ordered.columns else []
    own = F.struct("u", "w", "r", *x)
    after = F.array(*(F.lead(own, i).over(in_order(ordered)) for i in range(1, window + 1)))
    one = ordered.withColumn("after_", after).withColumn("to_", F.explode(F.filter("after_", lambda o: o.isNotNull())))
    gap = F.col("to_.r") - F.col("r")
    carried = [c for n in x for c in (F.col(n).alias("x_u"), F.col(f"to_.{n}").alias("x_v"))]
    return one.select("med", "t_src", "t_med", "u", F.col("to_.u").alias("v"), F.col("w").alias("w_u"), F.col("to_.w").alias("w_v"), gap.alias("gap"), *carried, *also).where(F.col("gap").between(1, window))


def with_features(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Adds x_u and x_v, unless the pairs carry them."""
    if "x_u" in pairs.columns:
        return pairs
    a = features.select(F.col("gid").alias("u"), F.col("x").alias("x_u"))
    b = features.select(F.col("gid").alias("v"), F.col("x").alias("x_v"))
    return pairs.join(a, "u").join(b, "v")


def merge_cost(pairs: DataFrame) -> DataFrame:
    """Adds cost: half of w_u * w_v * squared distance (single nodes have the size factor 1 * 1 / (1 + 1))."""
    return pairs.withColumn("cost", 0.5 * F.col("w_u") * F.col("w_v") * distance2(F.col("x_u"), F.col("x_v")))


def feature_variance(features: DataFrame) -> DataFrame:
    """(type_id, var): population variances summed over dimensions; 1 for a type with fewer than 2 nodes, without features
    or without spread. One pass: sum of squares and sums by dimension."""
    per = vectors_by(features, ["type_id"], "x", "var", also=[F.count("*").alias("n")])
    per = per.select("type_id", "n", F.aggregate("x", F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0))).alias("v"))
    types = features.select("type_id").distinct()
    return types.join(per, "type_id", "left").select("type_id", F.when((F.col("n") >= 2) & (F.col("v") > 0) & (F.col("v") < float("inf")), F.col("v")).otherwise(1.0).alias("var"))


def threshold_scale(pairs_types: DataFrame, by_pair: DataFrame, by_type: DataFrame, overall: float) -> DataFrame:
    """The scale of (t_src, t_med): the pair's, else the source type's, else the overall one. Small tables, broadcast."""
    return pairs_types.join(F.broadcast(by_pair.withColumnRenamed("scale", "s_pair")), ["t_src", "t_med"], "left").join(F.broadcast(by_type.withColumnRenamed("scale", "s_type")), "t_src", "left").withColumn("scale", F.coalesce("s_pair", "s_type", F.lit(overall))).drop("s_pair", "s_type")


def window_density(pairs: DataFrame, limit) -> DataFrame:
    """(med, t_src, t_med, u, density): admissible partners in the window, both sides, 0 included."""
    ok = (F.col("cost") <= limit).cast("long")
    both = pairs.select("med", "t_src", "t_med", "u", ok.alias("ok")).unionByName(pairs.select("med", "t_src", "t_med", F.col("v").alias("u"), ok.alias("ok")))
    return both.groupBy("med", "t_src", "t_med", "u").agg(F.sum("ok").alias("density"))


def two_hop_candidates(adj: DataFrame, deg: DataFrame, max_hub: int, k: int) -> DataFrame:
    """(u, v, rank): the k same-type nodes of largest degree within two hops (or one), through mediators of degree at
    most ``max_hub``. Each mediator passes on its k + 1 best of a type (one may be the asking node itself), so no mediator's
    neighbours are paired."""
    kind = deg.select(F.col("gid").alias("u"), F.col("type_id").alias("t"), (-F.col("degree")).cast("long").alias("o"))
    small = deg.where(F.col("degree") <= max_hub).select(F.col("gid").alias("med"))
    entry = F.array(F.struct(F.col("o"), F.col("u").cast("long").alias("v"))).alias("best")
    half = adj.select(F.col("u").alias("med"), F.col("v").alias("u")).join(small, "med").join(kind, "u")
    best = merged_smallest(half.select("med", "t", entry), ["med", "t"], "best", k + 1)
    two = half.select("u", "med", "t").join(best, ["med", "t"]).select("u", "best")
    one = adj.select(F.col("u").alias("w"), F.col("v").alias("u")).join(kind, "u").join(deg.select(F.col("gid").alias("w"), F.col("type_id").alias("t2")), "w").where("t = t2").select(F.col("w").alias("u"), entry)
    near = merged_smallest(two.unionByName(one), ["u"], "best", k + 1)
    others = F.slice(F.filter("best", lambda b: b["v"] != F.col("u")), 1, k)
    return near.select("u", F.posexplode(others).alias("at", "b")).select("u", F.col("b.v").alias("v"), (-F.col("b.o")).alias("degree"), (F.col("at") + 1).alias("rank"))


def moments(lists: DataFrame, dim: int) -> DataFrame:
    """Adds the weighted moments of each list's rows with features: weights (their sum), sums (of w x), squares (sum of w |x|^2)."""
    whole = in_order(lists).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.when(F.col("x").isNotNull(), F.col("w"))
    sums = [F.sum(F.get(F.col("x"), F.lit(i)) * F.col("w")).over(whole) for i in range(dim)]
    size = F.max(F.when(F.col("x").isNotNull(), F.size("x"))).over(whole)
    out = lists.withColumns({"weights": F.sum(w).over(whole), "squares": F.sum(w * dot(F.col("x"), F.col("x"))).over(whole), "size_": size, **{f"s{i}_": s for i, s in enumerate(sums)}})
    made = F.slice(F.array(*(f"s{i}_" for i in range(dim))), F.lit(1), F.col("size_")) if dim else F.array().cast("array<double>")
    return out.withColumn("sums", made).drop("size_", *(f"s{i}_" for i in range(dim)))


def dirichlet_delta(pairs: DataFrame, lists: DataFrame, features: DataFrame) -> DataFrame:
    """(med, u, v, delta): change of the energy sum of w_c * w_k * |x_c - x_k|^2 over a mediator's candidates if u and v
    become their mean with weight w_u + w_v. The sums over candidates come from the mediator's weighted moments, so no
    third join meets the pairs: sum w_k |x - x_k|^2 = W |x|^2 - 2 x . S + Q. Pairs that carry :func:`moments` are joined with none."""
    if "sums" not in pairs.columns:
        e = lists if "x" in lists.columns else lists.join(features.select(F.col("gid").alias("u"), "x"), "u")
        sums = vectors_by(e, ["med", "t_src"], "x", "sum", weight="w", also=[F.sum("w").alias("weights"), F.sum(F.col("w") * dot(F.col("x"), F.col("x"))).alias("squares")], dim=width(features))
        pairs = pairs.join(sums.withColumnRenamed("x", "sums"), ["med", "t_src"])
    p = with_features(pairs, features)

    def spread(x, w):  # energy of a point of weight w with all candidates, itself included at distance 0
        return w * (F.col("weights") * dot(x, x) - 2 * dot(x, F.col("sums")) + F.col("squares"))

    d2 = distance2(F.col("x_u"), F.col("x_v"))
    both = F.col("w_u") + F.col("w_v")
    mean = F.zip_with("x_u", "x_v", lambda a, b: (a + b) / 2)
    before = spread(F.col("x_u"), F.col("w_u")) + spread(F.col("x_v"), F.col("w_v")) - F.col("w_u") * F.col("w_v") * d2
    after = spread(mean, both) - both * (F.col("w_u") * distance2(mean, F.col("x_u")) + F.col("w_v") * distance2(mean, F.col("x_v")))
    return p.select("med", "u", "v", (after - before).alias("delta"))
