"""The quotient graph of a map from nodes to representatives (cmap: gid, root)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import distance2, dot
from ..schema import TypedGraph
from .ranks import ranked
from .sums import vectors_by, width
from .tables import parts_for

MODES = ("binary", "count", "log_count", "density")


@dataclass(frozen=True)
class Compressed:
    """The smaller graph's parts and the map (type_id, node_id, gid, root, super_id) behind them."""

    node_map: DataFrame
    nodes: DataFrame
    edges: DataFrame
    info: dict


def node_map(nodes: DataFrame, cmap: DataFrame) -> DataFrame:
    """(type_id, node_id, gid, root, super_id): roots of a type numbered in order of their ids. Only distinct roots are
    ranked, over many partitions."""
    m = nodes.select("type_id", "node_id", "gid").join(cmap, "gid")
    roots = ranked(m.select("type_id", "root").distinct(), ["type_id"], ["root"], "super_id")
    return m.join(roots, ["type_id", "root"])


def freeze(cmap: DataFrame, nodes: DataFrame, types: DataFrame, frozen: list[str]) -> DataFrame:
    """Nodes of frozen types become their own representatives; an unknown type is an error."""
    known = {r.node_type: r.type_id for r in types.collect()}
    if bad := sorted(set(frozen) - set(known)):
        raise ValueError(f"unknown node types: {bad}")
    ids = [known[t] for t in frozen]
    return cmap.join(nodes.select("gid", "type_id"), "gid").select("gid", F.when(F.col("type_id").isin(ids), F.col("gid")).otherwise(F.col("root")).alias("root"))


def centroids(nodes: DataFrame, m: DataFrame) -> DataFrame:
    """(type_id, super_id, c): mean vector of the members."""
    n = nodes.where("x is not null").select("gid", F.col("x").alias("c")).join(m.select("gid", "type_id", "super_id"), "gid")
    return vectors_by(n, ["type_id", "super_id"], "c", dim=width(nodes))


def super_features(nodes: DataFrame, m: DataFrame, temp: float = 1.0) -> DataFrame:
    """(type_id, super_id, x): means weighted by exp(-d / (mean d * temp)), d being the squared distance of a member's
    embedding h (x if there is none) to the group's centre; weights come from h, the averaged values from x.

    The mean distance comes from the same pass as the centre: the mean of |h|^2, less |c|^2."""
    keys = ["type_id", "super_id"]
    h = F.coalesce("h", "x") if "h" in nodes.columns else F.col("x")
    n = nodes.select("gid", "x", h.alias("h")).where("x is not null")
    dim_h, dim_x = n.agg(F.max(F.size("h")), F.max(F.size("x"))).first()
    n = n.join(m.select("gid", *keys), "gid")
    centre = vectors_by(n.select(*keys, F.col("h").alias("c")), keys, "c", also=[F.avg(dot(F.col("c"), F.col("c"))).alias("norm")], dim=dim_h or 0)
    centre = centre.select(*keys, "c", F.greatest(F.lit(0.0), F.col("norm") - dot(F.col("c"), F.col("c"))).alias("m"))
    w = n.join(centre, keys).withColumn("w", F.exp(-distance2(F.col("h"), F.col("c")) / F.greatest(F.col("m") * temp, F.lit(1e-8))))
    return vectors_by(w.select(*keys, "x", "w"), keys, "x", weight="w", dim=dim_x or 0, least=1e-8)


def label_counts(nodes: DataFrame, m: DataFrame, who: str = "is_train") -> DataFrame:
    """(type_id, super_id, y, n) of labelled members (y >= 0) with the flag."""
    return nodes.where((F.col("y") >= 0) & F.col(who)).select("gid", "y").join(m.select("gid", "type_id", "super_id"), "gid").groupBy("type_id", "super_id", "y").agg(F.count("*").alias("n"))


def voted(counts: DataFrame) -> DataFrame:
    """(type_id, super_id, y): most training votes, ties to the smallest class."""
    return counts.groupBy("type_id", "super_id").agg(F.max_by("y", F.struct("n", -F.col("y"))).alias("y"))


def soft_labels(counts: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("type_id", "super_id"))
    return counts.withColumn("share", F.col("n") / total)


def purity(counts: DataFrame) -> DataFrame:
    """Mean, least and lower-median share of the largest class over labelled supernodes."""
    p = counts.groupBy("type_id", "super_id").agg((F.max("n") / F.sum("n")).alias("p"))
    return p.agg(F.avg("p").alias("mean_purity"), F.min("p").alias("min_purity"), F.expr("percentile_disc(0.5) within group (order by p)").alias("median_purity"))


def masks(nodes: DataFrame, m: DataFrame) -> DataFrame:
    """Supernode flags: any training member; else any validation and any test member (both may hold)."""
    any_ = nodes.join(m.select("gid", "super_id"), "gid").groupBy("type_id", "super_id").agg(*(F.bool_or(c).alias(c) for c in ("is_train", "is_val", "is_test")))
    return any_.select("type_id", "super_id", "is_train", (F.col("is_val") & ~F.col("is_train")).alias("is_val"), (F.col("is_test") & ~F.col("is_train")).alias("is_test"))


def quotient_edges(edges: DataFrame, types: DataFrame, m: DataFrame) -> DataFrame:
    """(src_type, rel, dst_type, ssn, dsn, cnt) per relation, directed, self-loops kept."""
    from ..schema import global_edges, named_relations, numbered_relations

    g, relations = numbered_relations(global_edges(edges, types).select("src_type", "rel", "dst_type", "s", "d"))
    to = m.select("gid", "super_id")
    n = parts_for(edges.sparkSession, g.count())
    for end, name in (("s", "ssn"), ("d", "dsn")):
        g = g.repartition(n, end).join(to.toDF(end, name).repartition(n, end), end).drop(end)
    # Few edges of a task are parallel, so they are dealt before they are counted.
    q = g.repartition(n, "rel_no", "ssn", "dsn").groupBy("rel_no", "ssn", "dsn").agg(F.count("*").alias("cnt"))
    return named_relations(q, relations)


def edge_weights(q: DataFrame, types: DataFrame, m: DataFrame, mode: str) -> DataFrame:
    """Adds weight: 1 (binary), count, ln(1 + count), or count over the root of the product of the two sizes."""
    if mode not in MODES:
        raise ValueError(f"edge weight mode must be one of {MODES}")
    if mode != "density":
        return q.withColumn("weight", {"binary": F.lit(1.0), "count": F.col("cnt").cast("double"), "log_count": F.log1p(F.col("cnt").cast("double"))}[mode])
    size = m.groupBy("type_id", "super_id").agg(F.count("*").alias("size")).join(F.broadcast(types.select("type_id", "node_type")), "type_id")
    a = size.select(F.col("node_type").alias("src_type"), F.col("super_id").alias("ssn"), F.col("size").alias("a"))
    b = size.select(F.col("node_type").alias("dst_type"), F.col("super_id").alias("dsn"), F.col("size").alias("b"))
    return q.join(a, ["src_type", "ssn"]).join(b, ["dst_type", "dsn"]).withColumn("weight", F.col("cnt") / F.greatest(F.lit(1.0), F.sqrt((F.col("a") * F.col("b")).cast("double")))).drop("a", "b")


def build(graph: TypedGraph, cmap: DataFrame, edge_weight_mode: str = "binary", use_soft_labels: bool = False, temp: float = 1.0) -> Compressed:
    """The quotient graph: features, labels (-1 without votes), flags and weighted edges of the supernodes."""
    m = node_map(graph.nodes, cmap)
    base = m.groupBy("type_id", "super_id").agg(F.count("*").alias("size"))
    counts = label_counts(graph.nodes, m)
    out = base.join(super_features(graph.nodes, m, temp), ["type_id", "super_id"], "left").join(voted(counts), ["type_id", "super_id"], "left").withColumn("y", F.coalesce("y", F.lit(-1))).join(masks(graph.nodes, m), ["type_id", "super_id"], "left")
    if use_soft_labels:
        soft = soft_labels(counts).groupBy("type_id", "super_id").agg(F.sort_array(F.collect_list(F.struct("y", "share"))).alias("y_soft"))
        out = out.join(soft, ["type_id", "super_id"], "left")
    edges = edge_weights(quotient_edges(graph.edges, graph.types, m), graph.types, m, edge_weight_mode)
    return Compressed(m, out, edges, {"edge_weight_mode": edge_weight_mode})
