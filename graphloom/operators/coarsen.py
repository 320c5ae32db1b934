"""Coarsening by rounds of matchings: candidates through mediators, mutual best picks, reassignment, rebuild.

A round merges pairs that are each other's cheapest admissible partner by the total order (cost, smaller id, larger id).
It depends on no order of visits, so results are the same for any partitioning. Between rounds the kernel graph (nodes
with features, undirected weighted edges) is rebuilt and checkpointed; the driver sees counts only.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import distance2
from .nearest import nearest_in_groups
from .smallest import merged_smallest
from .sums import width
from .tables import dropped, parts_for, passing, settled
from .topology import adjacency, band_pairs, degrees, feature_variance, hub_caps, mediator_lists, merge_cost, moments, projected_order, stride_sampled, type_mean_degree


@dataclass(frozen=True)
class Kernel:
    """nodes (gid, type_id, x) and undirected edges (u < v, w)."""

    nodes: DataFrame
    edges: DataFrame


def candidate_pairs(k: Kernel, window: int = 20, cap: int = 128, hubs: bool | int | dict[int, int] = True, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """The thinned, ranked mediator lists, and the pairs in their bands, the cheapest of each pair and mediator type, or
    ``every`` one. ``hubs``: whether mediators above a degree are left out; one cap for all types, or caps by type id,
    instead of the automatic ones."""
    adj = adjacency(k.edges)
    deg = degrees(adj, k.nodes)
    lists = mediator_lists(adj, deg, hub_caps(deg, hubs) if hubs is not False else None, k.nodes)
    ordered = stride_sampled(projected_order(lists, k.nodes), cap)
    pairs = merge_cost(band_pairs(ordered, window)).select("t_src", "t_med", "u", "v", "cost")
    return ordered, pairs if every else cheapest(pairs)


def cheapest(pairs: DataFrame) -> DataFrame:
    """(t_src, t_med, u, v, cost), u < v: the cheapest cost of each pair over its mediators of a type."""
    return pairs.groupBy("t_src", "t_med", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("cost").alias("cost"))


def admissible(pairs: DataFrame, variance: DataFrame, scale: float = 1.0, scales: DataFrame | None = None) -> DataFrame:
    """Pairs with cost <= scale * variance of the type; (u, v, t, cost), cheapest over mediators. ``scales``: (t_src,
    t_med, scale) instead of one scale. Small tables, one row for each type or pair of types, are broadcast."""
    p = pairs.join(F.broadcast(variance.withColumnRenamed("type_id", "t_src")), "t_src")
    limit = F.lit(scale)
    if scales is not None:
        p = p.join(F.broadcast(scales.withColumnRenamed("scale", "__s")), ["t_src", "t_med"], "left")
        limit = F.coalesce("__s", F.lit(scale))
    ok = p.where(F.col("cost") <= limit * F.col("var"))
    return ok.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("t_src").alias("t"), "cost").groupBy("u", "v", "t").agg(F.min("cost").alias("cost"))


def mutual_best(pairs: DataFrame) -> DataFrame:
    """One step: the pairs that are the first choice of both sides."""
    sides = pairs.select(F.col("u").alias("me"), "u", "v", "cost").unionByName(pairs.select(F.col("v").alias("me"), "u", "v", "cost"))
    best = sides.groupBy("me").agg(F.min(F.struct("cost", "u", "v")).alias("b")).select("b.*")
    return best.groupBy("u", "v", "cost").count().where("count = 2").select("u", "v", "cost")


def matching(pairs: DataFrame, rounds: int = 4) -> DataFrame:
    """Greedy matching by rising cost: repeated mutual best picks. Pairs left after ``rounds`` wait for the next pass."""
    left, out = pairs.select("u", "v", "cost"), None
    for turn in range(rounds):
        got = settled(mutual_best(left))
        out = got if out is None else out.unionByName(got)
        if turn + 1 == rounds or got.isEmpty():  # without a mutual pick no pair is left
            break
        used = got.select(F.explode(F.array("u", "v")).alias("g"))
        left = settled(left.join(used.withColumnRenamed("g", "u"), "u", "left_anti").join(used.withColumnRenamed("g", "v"), "v", "left_anti"))
    return out


def cheapest_merges(pairs: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """About the ``most`` cheapest of disjoint pairs, and whether any was left out. Costs are counted in classes of about one
    per cent (few rows, whatever the pairs), and whole classes are kept, so nothing is sorted and reruns agree."""
    step = F.floor(F.log2(F.col("cost") + 1e-30) * 64).cast("int")
    sizes = sorted((r["step"], r["count"]) for r in pairs.groupBy(step.alias("step")).count().collect())
    if sum(n for _, n in sizes) <= most:
        return pairs, False
    got, last = 0, None
    for at, n in sizes:
        if last is not None and got + n > most:
            break
        got, last = got + n, at
    return pairs.where(step <= last), True


def merged_map(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(gid, root): the larger id of a pair goes to the smaller one."""
    return nodes.select("gid").join(pairs.select(F.col("v").alias("gid"), F.col("u").alias("root")), "gid", "left").withColumn("root", F.coalesce("root", "gid"))


def ball_merge(pairs: DataFrame, density: DataFrame) -> DataFrame:
    """(gid, root) of one round in which each leader absorbs all its admissible partners: nodes are leaders if their
    density is the largest among their partners (ties: smaller id); every other node joins its cheapest leader. Centres
    stay fixed during the round."""
    d = density.groupBy(F.col("u").alias("g")).agg(F.max("density").alias("density"))
    sides = pairs.select(F.col("u").alias("me"), F.col("v").alias("other"), "cost").unionByName(pairs.select(F.col("v").alias("me"), F.col("u").alias("other"), "cost"))
    both = sides.join(d.select(F.col("g").alias("me"), F.col("density").alias("mine")), "me").join(d.select(F.col("g").alias("other"), F.col("density").alias("theirs")), "other")
    beaten = both.groupBy("me").agg(F.bool_or((F.col("theirs") > F.col("mine")) | ((F.col("theirs") == F.col("mine")) & (F.col("other") < F.col("me")))).alias("beaten"))
    leaders = beaten.where("not beaten").select(F.col("me").alias("other"))
    follow = both.join(leaders, "other").join(leaders.withColumnRenamed("other", "me"), "me", "left_anti")
    return follow.groupBy(F.col("me").alias("gid")).agg(F.min(F.struct("cost", "other")).alias("b")).select("gid", F.col("b.other").alias("root"))


def rebuilt(k: Kernel, cmap: DataFrame, rows: int | None = None) -> Kernel:
    """The kernel graph of the roots: unweighted mean features, summed weights, inner edges dropped. ``rows``: about how many
    edges there are, where that is known."""
    from .embed import vector_mean

    m = k.nodes.join(cmap, "gid")
    x = vector_mean(m.where("x is not null").select(F.col("root").alias("gid"), "x"), ["gid"])
    nodes = m.select(F.col("root").alias("gid"), "type_id").distinct().join(x, "gid", "left")
    e, n = k.edges, parts_for(cmap.sparkSession, k.edges.count() if rows is None else rows)
    for end, root in (("u", "ru"), ("v", "rv")):
        e = e.repartition(n, end).join(cmap.select(F.col("gid").alias(end), F.col("root").alias(root)).repartition(n, end), end).drop(end)
    e = e.where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"), "w").repartition(n, "u", "v")
    return Kernel(nodes, e.groupBy("u", "v").agg(F.sum("w").alias("w")))


def reassign_candidates(k: Kernel, cmap: DataFrame, most: int = 32, done: DataFrame | None = None) -> DataFrame:
    """(gid, root, type_id): for nodes that merged with none, the merged groups of their type seen in two hops through a
    mediator of another type (hubs left out), at most ``most`` by id. Nodes of ``done`` (gid), groups of earlier passes, don't move."""
    adj = adjacency(k.edges)
    deg = degrees(adj, k.nodes)
    small = deg.join(F.broadcast(hub_caps(deg)), "type_id").where("degree <= cap").select("gid", "type_id")
    groups = cmap.groupBy("root").count().where("count > 1").select("root")
    single = cmap.groupBy("root").count().where("count = 1").select(F.col("root").alias("gid")).join(small, "gid")
    if done is not None:
        single = single.join(done, "gid", "left_anti")
    med = small.select(F.col("gid").alias("med"), F.col("type_id").alias("t_med"))
    kind = k.nodes.select(F.col("gid").alias("o"), F.col("type_id").alias("t_o"))
    hop = adj.select(F.col("u").alias("gid"), F.col("v").alias("med")).join(single, "gid").join(med, "med").where("type_id <> t_med")
    # A mediator's smallest groups of each type, then each node's smallest over its mediators: no two-hop path is listed.
    side = adj.select(F.col("u").alias("med"), F.col("v").alias("o")).join(kind, "o").join(cmap.select(F.col("gid").alias("o"), "root"), "o").join(groups, "root")
    few = merged_smallest(side.select("med", F.col("t_o").alias("type_id"), F.array("root").alias("roots")), ["med", "type_id"], "roots", most)
    near = hop.select("gid", "type_id", "med").join(few, ["med", "type_id"])
    return merged_smallest(near.select("gid", "type_id", "roots"), ["gid", "type_id"], "roots", most).select("gid", F.explode("roots").alias("root"), "type_id")


def reassigned(k: Kernel, cmap: DataFrame, scale: float = 1.0, done: DataFrame | None = None) -> DataFrame:
    """(gid, root): accepted moves of single nodes to the nearest of all visible groups (those of :func:`reassign_candidates`, without
    a limit): distance to its mean times 1 + ln(1 + degree / mean degree) at most scale * variance. A node never moves into
    another single node, so no move can undo another."""
    from .embed import vector_mean

    adj = adjacency(k.edges)
    deg = settled(degrees(adj, k.nodes))
    small = deg.join(F.broadcast(hub_caps(deg)), "type_id").where("degree <= cap").select("gid", "type_id")
    sizes = cmap.groupBy("root").agg(F.count("*").alias("size"))
    x = k.nodes.where(F.size("x") > 0).select("gid", "type_id", "x")
    centre = vector_mean(x.join(cmap, "gid").select("root", "x"), ["root"]).join(sizes.where("size > 1").select("root"), "root").withColumnRenamed("x", "c")
    kind = lambda n: F.lit(n).cast("int").alias("kind")
    member = k.nodes.select("gid", "type_id").join(cmap, "gid").join(centre, "root").select("gid", kind(1), "type_id", F.col("root").alias("id"), F.col("c").alias("x"))
    single = x.join(small.select("gid"), "gid", "left_semi").join(sizes.where("size = 1").select(F.col("root").alias("gid")), "gid", "left_semi")
    if done is not None:
        single = single.join(done, "gid", "left_anti")
    ends = member.unionByName(single.select("gid", kind(2), "type_id", F.col("gid").alias("id"), "x"))
    near = adj.select(F.col("u").alias("med"), F.col("v").alias("gid")).join(ends, "gid").drop("gid")
    marks = small.select(F.col("gid").alias("med"), kind(0), "type_id", F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("x"))
    d = nearest_in_groups(near.unionByName(marks))
    best = d.groupBy("gid", "type_id").agg(F.min(F.struct("d", "root")).alias("b")).join(deg.select("gid", "degree"), "gid")
    lim = best.join(F.broadcast(type_mean_degree(deg)), "type_id").join(F.broadcast(feature_variance(k.nodes)), "type_id")
    return lim.where(F.round(F.col("b.d") * (1 + F.log1p(F.col("degree") / F.col("mean_degree"))), 9) <= F.round(scale * F.col("var"), 9)).select("gid", F.col("b.root").alias("root"))


def composed(first: DataFrame, then: DataFrame) -> DataFrame:
    """The map ``first`` followed by ``then``."""
    return first.join(then.select(F.col("gid").alias("root"), F.col("root").alias("to")), "root", "left").select("gid", F.coalesce("to", "root").alias("root"))


def finalized(flags: DataFrame, cmap: DataFrame) -> DataFrame:
    """(gid, done) of the roots: groups of more than one, or with a finalised member, are done."""
    return cmap.join(flags, "gid", "left").groupBy("root").agg((F.bool_or(F.coalesce("done", F.lit(False))) | (F.count("*") > 1)).alias("done")).withColumnRenamed("root", "gid")


def coarsened(k: Kernel, scale: float = 1.0, target: float = 0.0, levels: int = 5, outers: int = 10, window: int = 20, cap: int = 128, reassign: bool = True, pairwise: bool = True, objective: str = "ward", scales: DataFrame | None = None, hubs: bool | int | dict[int, int] = True, first: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, dict]:
    """(gid, root) over the first nodes, and what happened. Stops at ``target`` (original / current nodes; a pass of pairs
    that would go beyond it keeps the cheapest and moves no single nodes), without merges, or after ``levels`` * ``outers`` passes. ``first``: :func:`candidate_pairs` of ``k``, where they are known."""
    start = k.nodes.count()
    total = None
    now, history = start, []
    flags = None  # (gid, done) of the present roots: groups stay groups through rebuilds, and never move as single nodes
    for turn in range(levels * outers):
        with passing() as keep:  # a pass leaves its map and flags, and all other tables that it made are deleted
            ordered, pairs = first if first and not turn else candidate_pairs(k, window, cap, hubs, every=True)  # costs above the limit aren't shuffled
            ok = settled(admissible(pairs, feature_variance(k.nodes), scale, scales))
            if objective == "dirichlet":
                ok = dirichlet_pairs(k, ok, ordered, window)
            full = False
            if pairwise:
                found = matching(ok)
                if target:  # the last pass doesn't go far beyond the target
                    found, full = cheapest_merges(found, max(0, now - ceil(start / target)))
                m = merged_map(k.nodes, found)
            else:
                dens = ok.select("u", "v").unionByName(ok.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.count("*").alias("density"))
                joined = ball_merge(ok, dens)
                m = k.nodes.select("gid").join(joined, "gid", "left").withColumn("root", F.coalesce("root", "gid"))
            if reassign and not full:
                m = settled(m)
                moves = reassigned(k, m, scale, flags.where("done").select("gid") if flags is not None else None).withColumnRenamed("root", "to")
                m = m.join(moves, "gid", "left").select("gid", F.coalesce("to", "root").alias("root"))
            m = settled(m)
            after = m.select("root").distinct().count()
            assert after <= now
            history.append(after)
            last = full or after == now or (target and start / max(1, after) >= target) or turn + 1 == levels * outers
            older = [total, flags] + ([k.nodes, k.edges] if turn else [])
            if reassign and not last:
                flags = settled(finalized(flags if flags is not None else m.select("gid", F.lit(False).alias("done")), m))
            total = m if total is None else settled(composed(total, m))
            if not last:  # the graph of the next pass
                k = rebuilt(k, m)
                k = Kernel(settled(k.nodes), settled(k.edges))
            keep(total, *([] if last else [flags, k.nodes, k.edges]))
        dropped(*(t for t in older if t is not None and not any(t is x for x in (total, flags, k.nodes, k.edges))))
        if last:
            break
        now = after
    if total is None:
        total = k.nodes.select("gid", F.col("gid").alias("root"))
    return total, {"nodes": start, "supernodes": history[-1] if history else start, "history": history}


def dirichlet_pairs(k: Kernel, ok: DataFrame, ordered: DataFrame, window: int) -> DataFrame:
    """Admissible pairs whose merge lowers the projected energy, ranked by that change."""
    from .topology import dirichlet_delta

    d = dirichlet_delta(band_pairs(moments(ordered, width(k.nodes)), window, ("weights", "sums", "squares")), ordered, k.nodes)
    best = d.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.round("delta", 9).alias("delta")).groupBy("u", "v").agg(F.min("delta").alias("delta")).where("delta < 0")
    return settled(ok.drop("cost").join(best, ["u", "v"]).withColumnRenamed("delta", "cost"))


def kernel_of(graph) -> Kernel:
    """The kernel graph of a typed graph: normalised features (log degree where a type has none), distinct edges."""
    from ..functions.vectors import normalized
    from ..schema import global_edges
    from .topology import dedup

    g = global_edges(graph.edges, graph.types)
    edges = dedup(g).withColumn("w", F.lit(1.0))
    into = g.groupBy(F.col("d").alias("gid")).count()
    filled = F.coalesce("x", F.array(F.log1p(F.coalesce("count", F.lit(0)).cast("double"))))
    nodes = graph.nodes.join(into, "gid", "left").select("gid", "type_id", normalized(filled).alias("x"))
    return Kernel(nodes, edges)

