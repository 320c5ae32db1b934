"""Typed graphs over tables: the builders, and the helpers that loaders share (splits, induced parts, features)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import ranked, unused
from ..operators.tables import sized_shuffles
from ..schema import TypedGraph, typed_catalogue


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oriented(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Edges of each relation in the direction in which their ids lie in their types' ranges: as they are if they fit, swapped
    if only that fits; an error where neither does. One row for each relation reaches the driver."""
    top = edges.groupBy("src_type", "rel", "dst_type").agg(F.max("src").alias("a"), F.max("dst").alias("b"))
    size = {r["node_type"]: r["n"] for r in types.collect()}
    swap = []
    for r in top.collect():
        n, m = size[r["src_type"]], size[r["dst_type"]]
        if r["a"] < n and r["b"] < m:
            continue
        if not (r["b"] < n and r["a"] < m):
            raise ValueError(f"ids of {r['src_type']}/{r['rel']}/{r['dst_type']} fit its types in neither direction")
        swap.append("/".join((r["src_type"], r["rel"], r["dst_type"])))
    turned = F.concat_ws("/", "src_type", "rel", "dst_type").isin(swap)
    return edges.select("src_type", "rel", "dst_type", F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst"))


def relation(df: DataFrame, src_type: str, rel: str, dst_type: str, src: str, dst: str) -> DataFrame:
    return df.select(F.lit(src_type).alias("src_type"), F.lit(rel).alias("rel"), F.lit(dst_type).alias("dst_type"), F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))


def flipped(edges: DataFrame, rel: str) -> DataFrame:
    """The reverse relation."""
    return edges.select(F.col("dst_type").alias("src_type"), F.lit(rel).alias("rel"), F.col("src_type").alias("dst_type"), F.col("dst").alias("src"), F.col("src").alias("dst"))


def split_by_rank(df: DataFrame, key, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """Seeded random split of the labelled rows (y >= 0) in the order of ``key``: at least one training row, then at
    least one validation row if two are left. Ranks are global, and taken over many partitions."""
    labelled, r, n = unused(df.columns, "labelled", "r", "n")
    rows = ranked(df.withColumn(labelled, F.coalesce(F.col("y") >= 0, F.lit(False))), [labelled], [key, "node_id"], r, n)
    n_tr, n_va = (F.greatest(F.lit(1), F.floor(F.col(n) * share)) for share in (train, val))
    return flagged(rows, F.col(labelled), F.col(r), n_tr, n_va).drop(labelled, r, n)


def split_stratified(df: DataFrame, key, most_train: int = 200, most_val: int = 100) -> DataFrame:
    """Per class: min(200, max(1, n div 3)) training rows, then min(100, max(1, rest div 4)) validation rows."""
    r, n = unused(df.columns, "r", "n")
    rows = ranked(df, ["y"], [key, "node_id"], r, n)
    n_tr = F.least(F.lit(most_train), F.greatest(F.lit(1), F.floor(F.col(n) / 3)))
    n_va = F.least(F.lit(most_val), F.greatest(F.lit(1), F.floor((F.col(n) - n_tr) / 4)))
    return flagged(rows, F.lit(True), F.col(r), n_tr, n_va).drop(r, n)


def flagged(rows: DataFrame, ok, r, n_tr, n_va) -> DataFrame:
    """Flags by rank from 0: the first n_tr rows train, the next n_va validate, the others test."""
    return rows.withColumns({"is_train": ok & (r < n_tr), "is_val": ok & (r >= n_tr) & (r < n_tr + n_va), "is_test": ok & (r >= n_tr + n_va)})


def carve_validation(df: DataFrame, key, share: float = 0.2) -> DataFrame:
    """Moves a share of the training rows, at least one, to validation."""
    r, n, moved = unused(df.columns, "r", "n", "moved")
    rows = ranked(df, ["is_train"], [key, "node_id"], r, n)
    rows = rows.withColumn(moved, F.col("is_train") & (F.col(r) < F.greatest(F.lit(1), F.floor(F.col(n) * share))))
    return rows.withColumns({"is_val": F.col(moved), "is_train": F.col("is_train") & ~F.col(moved)}).drop(r, n, moved)


def numbered(ids: DataFrame, col: str, name: str) -> DataFrame:
    """Adds ``name``: the place from 0 of each row in the order of ``col``, over many partitions."""
    return ranked(ids, [], [col], name)


def induced(edges: DataFrame, kept: DataFrame, left: str, right: str, order: str) -> DataFrame:
    """(src, dst): edges whose ``left`` end is among ``kept`` (its column of that name), both ends numbered anew: kept ones by
    id, the others in the order of ``order``, one for each edge's row."""
    a = numbered(kept.select(left).distinct(), left, "src")
    b = numbered(edges.join(kept.select(left).distinct(), left, "left_semi").select(left, right, *([order] if order not in (left, right) else [])), order, "dst")
    return b.join(a, left).select("src", "dst")


def md5_key(seed: int = 0):
    """A stateless random order, the same in any engine and partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("node_id").cast("string")))


def one_hot_class(x):
    """The first place of the largest value."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def neighbour_mean(edges: DataFrame, features: DataFrame) -> DataFrame:
    """(dst, dim, value): the mean of the sources' features at each destination; features (src, dim, value)."""
    return edges.join(features, "src").groupBy("dst", "dim").agg(F.avg("value").alias("value"))


def log_degree(nodes: DataFrame, edges_in: DataFrame) -> DataFrame:
    """(node_id, value): log(1 + in-degree) for nodes without features; edges_in has their ids as dst."""
    deg = edges_in.groupBy(F.col("dst").alias("node_id")).count()
    return nodes.join(deg, "node_id", "left").select("node_id", F.log1p(F.coalesce("count", F.lit(0)).cast("double")).alias("value"))


def standardized(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """(v - mean) / std (population; 1 where it is 0), the statistics being one broadcast row for each group."""
    stats = df.groupBy(by).agg(*(F.avg(c).alias(f"m_{c}") for c in cols), *(F.stddev_pop(c).alias(f"s_{c}") for c in cols))
    one = df.join(F.broadcast(stats), by)
    return one.withColumns({c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0) for c in cols}).drop(*(f"{p}_{c}" for p in "ms" for c in cols))


def assembled(parts: list[tuple[int, str, DataFrame]], edges: DataFrame, target: str) -> TypedGraph:
    """A graph from (type id, name, nodes (node_id, x, y)); splits by node_id % 10: 0-5, 6-7, 8-9. Later shuffles are sized by
    its edges, which are sent in both directions."""
    sized_shuffles(edges.sparkSession, 2 * edges.count())
    counts = None
    for i, name, df in parts:
        c = df.agg(F.count("*").alias("n")).select(F.lit(i).alias("type_id"), F.lit(name).alias("node_type"), "n")
        counts = c if counts is None else counts.unionByName(c)
    types = typed_catalogue(counts)
    rows = None
    for i, _, df in parts:
        d = df.select(F.lit(i).alias("type_id"), F.col("node_id").cast("long").alias("node_id"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("int").alias("y"))
        rows = d if rows is None else rows.unionByName(d)
    m = F.col("node_id") % 10
    has = F.col("y").isNotNull()
    nodes = rows.join(F.broadcast(types.select("type_id", "offset")), "type_id").select("type_id", "node_id", (F.col("offset") + F.col("node_id")).alias("gid"), "x", "y", (has & (m < 6)).alias("is_train"), (has & (m >= 6) & (m < 8)).alias("is_val"), (has & (m >= 8)).alias("is_test"))
    return TypedGraph(types, nodes, edges, target)


def trade(spark: SparkSession, sf_dir: str) -> TypedGraph:
    """Customers (target: market segment), orders, parts, suppliers and nations (without features)."""
    c, o, p, s, n, li = (read(spark, sf_dir, t) for t in ("customer", "orders", "part", "supplier", "nation", "lineitem"))
    edges = (
        relation(o, "customer", "places", "order", "o_custkey", "o_orderkey")
        .unionByName(relation(o, "order", "placed_by", "customer", "o_orderkey", "o_custkey"))
        .unionByName(relation(li, "order", "contains", "part", "l_orderkey", "l_partkey"))
        .unionByName(relation(li, "part", "supplied_by", "supplier", "l_partkey", "l_suppkey"))
        .unionByName(relation(c, "customer", "in", "nation", "c_custkey", "c_nationkey"))
        .unionByName(relation(s, "supplier", "in", "nation", "s_suppkey", "s_nationkey"))
    )
    # A label's index is its rank among the distinct labels: few rows, broadcast.
    segment = F.broadcast(c.select("c_mktsegment").distinct().withColumn("y", F.dense_rank().over(Window.orderBy("c_mktsegment")) - 1))
    placed = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    one = F.lit(0)
    cust = standardized(c.join(segment, "c_mktsegment").join(placed, "c_custkey", "left").select(one.alias("g"), F.col("c_custkey").alias("node_id"), F.col("c_acctbal").alias("a"), F.log1p(F.coalesce("k", F.lit(0)).cast("double")).alias("b"), "y"), "g", ["a", "b"])
    order = standardized(o.select(one.alias("g"), F.col("o_orderkey").alias("node_id"), F.col("o_totalprice").alias("a"), F.substring("o_orderpriority", 1, 1).cast("double").alias("b"), F.lit(None).cast("int").alias("y")), "g", ["a", "b"])
    part = standardized(p.select(one.alias("g"), F.col("p_partkey").alias("node_id"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), F.lit(None).cast("int").alias("y")), "g", ["a", "b"])
    supp = standardized(s.select(one.alias("g"), F.col("s_suppkey").alias("node_id"), F.col("s_acctbal").alias("a"), F.lit(None).cast("int").alias("y")), "g", ["a"])
    nat = n.select(F.col("n_nationkey").cast("long").alias("node_id"), F.lit(None).cast("array<double>").alias("x"), F.lit(None).cast("int").alias("y"))
    two = lambda d: d.withColumn("x", F.array("a", "b"))
    return assembled([(0, "customer", two(cust)), (1, "order", two(order)), (2, "part", two(part)), (3, "supplier", supp.withColumn("x", F.array("a"))), (4, "nation", nat)], edges, "customer")


def vectors(spark: SparkSession, sf_dir: str) -> TypedGraph:
    """Vectors with ten classes, in the buckets of the signs of their first six coordinates."""
    e = read(spark, sf_dir, "embeddings")
    bits = F.aggregate(F.transform(F.slice("embedding", 1, 6), lambda a, i: F.when(a > 0, F.lit(1)).otherwise(0) * F.pow(F.lit(2), i).cast("int")), F.lit(0), lambda a, b: a + b)
    rows = e.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("x"), F.col("label").alias("y"), bits.cast("long").alias("bucket"))
    buckets = spark.range(64).select(F.col("id").alias("node_id"), F.lit(None).cast("array<double>").alias("x"), F.lit(None).cast("int").alias("y"))
    return assembled([(0, "vec", rows), (1, "bucket", buckets)], relation(rows, "vec", "in", "bucket", "node_id", "bucket"), "vec")


def activity(spark: SparkSession, sf_dir: str) -> TypedGraph:
    """Users (target: their most frequent event type, ties to the first by name), event types and days."""
    ev = read(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    index = lambda c: numbered(ev.select(c).distinct(), c, f"{c}_id")
    e = ev.join(index("event_type"), "event_type").join(index("day"), "day")
    most = e.groupBy("user_id", "event_type_id").count().groupBy("user_id").agg(F.max_by("event_type_id", F.struct("count", -F.col("event_type_id"))).alias("y"))
    users = spark.range(0, ev.agg(F.max("user_id")).first()[0] + 1).withColumnRenamed("id", "node_id").join(most.withColumnRenamed("user_id", "node_id"), "node_id", "left").withColumn("x", F.lit(None).cast("array<double>"))
    bare = lambda c: e.select(F.col(f"{c}_id").alias("node_id")).distinct().withColumns({"x": F.lit(None).cast("array<double>"), "y": F.lit(None).cast("int")})
    edges = relation(e, "user", "did", "event_type", "user_id", "event_type_id").unionByName(relation(e, "user", "on", "day", "user_id", "day_id"))
    return assembled([(0, "user", users), (1, "event_type", bare("event_type")), (2, "day", bare("day"))], edges, "user")


def documents(spark: SparkSession, sf_dir: str) -> TypedGraph:
    """Documents (target: quality; -1 without a label), their sources and languages."""
    d = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("y"))
    index = lambda c: numbered(d.select(c).where(F.col(c).isNotNull()).distinct(), c, f"{c}_id")
    rows = d.join(labels, "doc_id", "left").select(F.col("doc_id").alias("node_id"), "source", "lang", F.array(F.log1p(F.col("n_chars").cast("double"))).alias("x"), F.coalesce("y", F.lit(-1)).alias("y"))
    e = rows.join(index("source"), "source").join(index("lang"), "lang")
    bare = lambda c: index(c).select(F.col(f"{c}_id").alias("node_id"), F.lit(None).cast("array<double>").alias("x"), F.lit(None).cast("int").alias("y"))
    edges = relation(e, "doc", "from", "source", "node_id", "source_id").unionByName(relation(e, "doc", "in", "lang", "node_id", "lang_id"))
    return assembled([(0, "doc", rows), (1, "source", bare("source")), (2, "lang", bare("lang"))], edges, "doc")


#: Graph builders by name.
LOADERS = {"trade": trade, "vec": vectors, "activity": activity, "docs": documents}
