"""The typed graph: three DataFrames, and the checks on its edges."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = "type_id int, node_type string, n long, offset long"
NODES = "type_id int, node_id long, gid long, x array<double>, y int, is_train boolean, is_val boolean, is_test boolean"
EDGES = "src_type string, rel string, dst_type string, src long, dst long"


@dataclass(frozen=True)
class TypedGraph:
    """types, nodes and edges (see TYPES, NODES, EDGES). Relations are data, so one plan serves any number of types.
    A node's global id is its type's offset plus its local id. ``target`` is the type that carries labels."""

    types: DataFrame
    nodes: DataFrame
    edges: DataFrame
    target: str

    def with_nodes(self, nodes: DataFrame) -> TypedGraph:
        return replace(self, nodes=nodes)


def typed_catalogue(counts: DataFrame) -> DataFrame:
    """(type_id, node_type, n, offset) from (type_id, node_type, n). There are as many rows as types."""
    from pyspark.sql import Window

    before = Window.orderBy("type_id").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("type_id", "node_type", F.col("n").cast("long").alias("n"), F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("offset"))


def infer_target(nodes: DataFrame, types: DataFrame, wanted: str | None = None) -> str:
    """The wanted type; else the only type with labels and training nodes; else the one with the most training nodes;
    else any type with labels; else an error."""
    if wanted:
        return wanted
    seen = nodes.where("y is not null").groupBy("type_id").agg(F.sum(F.coalesce("is_train", F.lit(False)).cast("long")).alias("train")).join(types, "type_id").orderBy(F.desc("train"), "type_id").limit(1).collect()
    if not seen:
        raise ValueError("no node type carries labels")
    return seen[0]["node_type"]


def global_edges(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Edges with global ids s, d and type ids st, dt. Relations of unknown types are skipped. The catalogue has one row
    for each type, which bounds the broadcast."""
    a = F.broadcast(types.select(F.col("node_type").alias("src_type"), F.col("type_id").alias("st"), F.col("offset").alias("so"), F.col("n").alias("sn")))
    b = F.broadcast(types.select(F.col("node_type").alias("dst_type"), F.col("type_id").alias("dt"), F.col("offset").alias("do"), F.col("n").alias("dn")))
    return edges.join(a, "src_type").join(b, "dst_type").select("src_type", "rel", "dst_type", "src", "dst", "st", "dt", (F.col("so") + F.col("src")).alias("s"), (F.col("do") + F.col("dst")).alias("d"), "sn", "dn")


def numbered_relations(g: DataFrame) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """``g`` with rel_no, the place of a row's relation among the sorted relations, instead of its three names, and those
    relations: a row is then a few numbers, wherever it is sent, sorted or grouped. One row for each relation reaches the driver."""
    names = ("src_type", "rel", "dst_type")
    if not set(names) <= set(g.columns):
        raise ValueError("relations are numbered once")
    found = sorted((tuple(r) for r in g.select(*names).distinct().collect()), key=lambda r: [(x is not None, x) for x in r])
    number = F.lit(None).cast("int")
    for i, r in enumerate(found):
        same = F.lit(True)
        for c, x in zip(names, r, strict=True):
            same = same & F.col(c).eqNullSafe(F.lit(x))
        number = F.when(same, F.lit(i)) if not i else number.when(same, F.lit(i))
    return g.withColumn("rel_no", number).drop(*names), found


def named_relations(df: DataFrame, relations: list[tuple[str, str, str]]) -> DataFrame:
    """``df`` with the three names of its relation instead of rel_no, in front."""
    at = lambda j: F.get(F.array(*(F.lit(r[j]) for r in relations)).cast("array<string>"), F.col("rel_no"))
    return df.select(*(at(j).alias(c) for j, c in enumerate(("src_type", "rel", "dst_type"))), *(c for c in df.columns if c != "rel_no"))


def outside(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Edges with an id outside of its type's range."""
    return global_edges(edges, types).where("src < 0 or src >= sn or dst < 0 or dst >= dn")


def validated(edges: DataFrame, types: DataFrame) -> DataFrame:
    """``edges``, or an error if an id is outside of its type's range."""
    if not outside(edges, types).isEmpty():
        raise ValueError("edges hold ids outside of their types' ranges")
    return edges
