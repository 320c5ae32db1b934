"""Whole loaders: from rows to a typed graph with features, reverse relations, parts, classes and splits in one call.

Each step takes a graph and gives one; nothing but a row for each type or relation reaches the driver. Ids of a part are
numbered anew from 0 in the order of the old ones, over many partitions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import normalized
from ..operators.ranks import ranked
from ..operators.sums import vectors_by, width
from ..operators.tables import settled
from ..schema import TypedGraph, typed_catalogue
from . import graphs

FLAGS = ("is_train", "is_val", "is_test")


def type_ids(graph: TypedGraph) -> dict[str, int]:
    return {r["node_type"]: r["type_id"] for r in graph.types.collect()}


def linked(edges: DataFrame, one: str, other: str, rel: str | None = None) -> DataFrame:
    """(one, other): ends of all rows that link the two types, in either direction, of the relation if one is named."""
    rows = edges.where(F.col("rel") == rel) if rel else edges
    there = rows.where((F.col("src_type") == one) & (F.col("dst_type") == other)).select(F.col("src").alias("one"), F.col("dst").alias("other"))
    back = rows.where((F.col("src_type") == other) & (F.col("dst_type") == one) & (F.col("src_type") != F.col("dst_type"))).select(F.col("dst").alias("one"), F.col("src").alias("other"))
    return there.unionByName(back)


def unit_features(graph: TypedGraph, kind: str) -> TypedGraph:
    """The type's feature vectors over their lengths."""
    ours = F.col("type_id") == type_ids(graph)[kind]
    return graph.with_nodes(graph.nodes.withColumn("x", F.when(ours, normalized(F.col("x"), 1e-12)).otherwise(F.col("x"))))


def mean_features(graph: TypedGraph, steps: list[tuple[str, str, str]]) -> TypedGraph:
    """For each (type, relation, read type), in this order: the type's features become the means of those that it is linked with
    in the relation, counted by row; zeros without any. Each step's means are written, as the next may read them."""
    ids, nodes = type_ids(graph), graph.nodes
    for kind, rel, read in steps:
        x = nodes.where((F.col("type_id") == ids[read]) & F.col("x").isNotNull()).select(F.col("node_id").alias("other"), "x")
        dim = width(x)
        mean = settled(vectors_by(linked(graph.edges, kind, read, rel).join(x, "other"), ["one"], dim=dim))
        ours = nodes.where(F.col("type_id") == ids[kind]).drop("x").join(mean, F.col("node_id") == F.col("one"), "left")
        filled = ours.withColumn("x", F.coalesce("x", F.array_repeat(F.lit(0.0), dim))).select(*nodes.columns)
        nodes = nodes.where(F.col("type_id") != ids[kind]).unionByName(filled)
    return graph.with_nodes(nodes)


def with_reverse(graph: TypedGraph, relations: list[tuple[str, str, str]]) -> TypedGraph:
    """Adds the reverse of each named relation (source type, relation, target type), as rev_<relation>."""
    named = None
    for a, rel, b in relations:
        this = (F.col("src_type") == a) & (F.col("rel") == rel) & (F.col("dst_type") == b)
        named = this if named is None else named | this
    back = graph.edges.where(named).select(F.col("dst_type").alias("src_type"), F.concat(F.lit("rev_"), "rel").alias("rel"), F.col("src_type").alias("dst_type"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    return replace(graph, edges=graph.edges.unionByName(back))


def split_anew(graph: TypedGraph, how: str = "random", seed: int = 42) -> TypedGraph:
    """New flags for the target's labelled nodes: 'random' (60, 20 and 20 of 100) or 'stratified' by class."""
    ours = F.col("type_id") == type_ids(graph).get(graph.target, -1)  # an empty part has no types
    rows = graph.nodes.where(ours & (F.col("y") >= 0)).drop(*FLAGS)
    split = {"random": graphs.split_by_rank, "stratified": graphs.split_stratified}[how](rows, graphs.md5_key(seed))
    none = {c: F.lit(False) for c in FLAGS}
    rest = graph.nodes.where(~(ours & F.coalesce(F.col("y") >= 0, F.lit(False)))).withColumns(none)
    return graph.with_nodes(rest.unionByName(split.select(*rest.columns)))


def carved(graph: TypedGraph, share: float = 0.2, seed: int = 0) -> TypedGraph:
    """A share of the training nodes, one at least, moves to validation."""
    train = graph.nodes.where("is_train")
    moved = graphs.carve_validation(train, graphs.md5_key(seed), share).select(*graph.nodes.columns)
    return graph.with_nodes(graph.nodes.where("not is_train or is_train is null").unionByName(moved))


def part_of(graph: TypedGraph, kept: DataFrame, chain: list[tuple[str, str]]) -> TypedGraph:
    """The part of the target's ``kept`` nodes (node_id, y) and, for each (type, of type) of ``chain`` in this order, of the type's nodes
    that are linked with kept ones of the other. Other types go, as do relations' rows without both ends; ids are new.
    Rows that were handed over the wrong way round are turned first."""
    ids, edges = type_ids(graph), graphs.oriented(graph.edges, graph.types)
    have = {graph.target: settled(kept.select("node_id").distinct())}
    for kind, of in chain:
        near = linked(edges, kind, of).join(have[of].withColumnRenamed("node_id", "other"), "other", "left_semi")
        have[kind] = settled(near.select(F.col("one").alias("node_id")).distinct())
    every = None
    for kind, rows in have.items():
        named = rows.select(F.lit(ids[kind]).alias("type_id"), F.lit(kind).alias("node_type"), "node_id")
        every = named if every is None else every.unionByName(named)
    new = settled(ranked(every, ["type_id", "node_type"], ["node_id"], "new"))
    types = typed_catalogue(new.groupBy("type_id", "node_type").agg(F.count("*").alias("n")))
    y = kept.groupBy("node_id").agg(F.min("y").alias("new_y")).withColumn("type_id", F.lit(ids[graph.target]))
    found = graph.nodes.join(new.drop("node_type"), ["type_id", "node_id"]).join(y, ["type_id", "node_id"], "left")
    found = found.join(F.broadcast(types.select("type_id", "offset")), "type_id")  # one row for each type
    nodes = found.select("type_id", F.col("new").alias("node_id"), (F.col("offset") + F.col("new")).alias("gid"), "x", F.coalesce("new_y", "y").alias("y"), *FLAGS)
    end = lambda side: new.select(F.col("node_type").alias(f"{side}_type"), F.col("node_id").alias(side), F.col("new").alias(f"new_{side}"))
    links = edges.join(end("src"), ["src_type", "src"]).join(end("dst"), ["dst_type", "dst"])
    links = links.select("src_type", "rel", "dst_type", F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))
    return TypedGraph(types, nodes, links, graph.target)


def labelled_part(graph: TypedGraph, chain: list[tuple[str, str]], most: int | None = None, seed: int = 42) -> TypedGraph:
    """The part of the target's labelled nodes (y >= 0; at most ``most`` of them, in a seeded order), split anew."""
    rows = graph.nodes.where((F.col("type_id") == type_ids(graph)[graph.target]) & (F.col("y") >= 0)).select("node_id", "y")
    return split_anew(part_of(graph, rows.orderBy(graphs.md5_key(seed), "node_id").limit(most) if most else rows, chain), "random", seed)


def classes_by_link(graph: TypedGraph, by: str, classes: dict[int, int], chain: list[tuple[str, str]], seed: int = 42) -> TypedGraph:
    """The part of the target's nodes that are linked with a node of type ``by`` which ``classes`` maps, with that class (the
    smallest of several) as label, split by class."""
    pairs = graph.edges.sparkSession.createDataFrame(sorted(classes.items()), "other long, y int")
    kept = linked(graphs.oriented(graph.edges, graph.types), graph.target, by).join(F.broadcast(pairs), "other").groupBy(F.col("one").alias("node_id")).agg(F.min("y").alias("y"))
    return split_anew(part_of(graph, kept, chain), "stratified", seed)


def coo_vectors(entries: DataFrame, row: str, col: str, value: str, dim: int, base: int = 0) -> DataFrame:
    """(node_id, x): rows of a sparse matrix of (row, col, value) with ids from ``base``; entries of one place are added."""
    at = [F.coalesce(F.sum(F.when(F.col(col) == j + base, F.col(value).cast("double"))), F.lit(0.0)) for j in range(dim)]
    return entries.groupBy((F.col(row) - base).cast("long").alias("node_id")).agg(F.array(*at).alias("x"))


def coo_classes(entries: DataFrame, row: str, col: str, value: str, base: int = 0) -> DataFrame:
    """(node_id, y): the column of each row's largest value, the first of several."""
    first = F.min_by(F.col(col) - base, F.struct(-F.col(value).cast("double"), F.col(col)))
    return entries.groupBy((F.col(row) - base).cast("long").alias("node_id")).agg(first.cast("int").alias("y"))


def from_coo(n: dict[str, int], target: str, features: DataFrame, classes: DataFrame, relations: list[tuple[str, str, str, DataFrame]], dim: int, base: int = 0, seed: int = 42) -> TypedGraph:
    """A graph from sparse matrices: ``features`` and ``classes`` of the target (row, col, value), and (source type, relation, target type,
    (row, col, value)) for each relation, where a value other than 0 is an edge; ids from ``base``. ``n``: nodes by type.
    Nodes without entries have zeros, or no label (-1). Split by class."""
    spark, parts, edges = features.sparkSession, [], None
    bare = {"x": F.lit(None).cast("array<double>"), "y": F.lit(None).cast("int")}
    for i, (kind, size) in enumerate(n.items()):
        ids = spark.range(size).withColumnRenamed("id", "node_id")
        if kind == target:
            rows = ids.join(coo_vectors(features, "row", "col", "value", dim, base), "node_id", "left").join(coo_classes(classes, "row", "col", "value", base), "node_id", "left")
            ids = rows.select("node_id", F.coalesce("x", F.array_repeat(F.lit(0.0), dim)).alias("x"), F.coalesce("y", F.lit(-1)).alias("y"))
        parts.append((i, kind, ids if kind == target else ids.withColumns(bare)))
    for a, rel, b, entries in relations:
        e = graphs.relation(entries.where("value <> 0").select((F.col("row") - base).alias("row"), (F.col("col") - base).alias("col")), a, rel, b, "row", "col")
        edges = e if edges is None else edges.unionByName(e)
    return split_anew(graphs.assembled(parts, edges, target), "stratified", seed)


# Over the given tables


def trade_means(spark: SparkSession, sf_dir: str) -> TypedGraph:
    """The trade graph with the parts' features alone, handed on as means to orders, customers and nations, and reverse relations."""
    g = unit_features(graphs.trade(spark, sf_dir), "part")
    g = mean_features(g, [("order", "contains", "part"), ("customer", "places", "order"), ("nation", "in", "customer")])
    return with_reverse(g, [("order", "contains", "part"), ("customer", "in", "nation"), ("supplier", "in", "nation")])


def docs_labelled(spark: SparkSession, sf_dir: str) -> TypedGraph:
    """Documents with a label, and their sources and languages."""
    return labelled_part(graphs.documents(spark, sf_dir), [("source", "doc"), ("lang", "doc")])


def trade_classes(spark: SparkSession, sf_dir: str) -> TypedGraph:
    """Customers of fifteen nations in three classes, and what they are linked with."""
    return classes_by_link(graphs.trade(spark, sf_dir), "nation", {i: i // 5 for i in range(15)}, [("order", "customer"), ("part", "order"), ("supplier", "part"), ("nation", "customer")])


def order_matrix(spark: SparkSession, sf_dir: str) -> TypedGraph:
    """Orders (target: priority) from sparse matrices with ids from 1: quantities by line, priorities, parts."""
    o, p, li = (graphs.read(spark, sf_dir, t) for t in ("orders", "part", "lineitem"))
    entry = lambda df, row, col, value: df.select((F.col(row) + 1).alias("row"), col.alias("col"), value.alias("value"))
    sizes = {"order": o.count(), "part": p.count()}
    priority = F.substring("o_orderpriority", 1, 1).cast("long")
    return from_coo(sizes, "order", entry(li, "l_orderkey", F.col("l_linenumber"), F.col("l_quantity")), entry(o, "o_orderkey", priority, F.lit(1)), [("order", "contains", "part", entry(li, "l_orderkey", F.col("l_partkey") + 1, F.lit(1)))], dim=7, base=1)


def trade_carved(spark: SparkSession, sf_dir: str) -> TypedGraph:
    """The trade graph with a fifth of the training nodes moved to validation."""
    return carved(graphs.trade(spark, sf_dir))


#: Graph builders by name.
LOADERS = graphs.LOADERS | {"trade_means": trade_means, "docs_labelled": docs_labelled, "trade_classes": trade_classes, "order_matrix": order_matrix, "trade_carved": trade_carved}
