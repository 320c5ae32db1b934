"""The catalogue: a query for each operator on graphs derived from the tables, and its SQL form where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..operators import baselines, coarsen, embed, metrics, quotient, reduce, sage, search, topology
from ..schema import TypedGraph, global_edges, outside
from ..sources import graphs, loaders
from . import api, experiments
from .sql import D, E, K, LISTS, M, MAP, ORDERED, PAIRS, REL, T, Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def r6(c, name: str):
    return (F.round(c, 6) + 0.0).alias(name)


def trade(spark, d) -> TypedGraph:
    return graphs.trade(spark, d)


def glob(g: TypedGraph) -> DataFrame:
    return global_edges(g.edges, g.types)


def mod4(g: TypedGraph) -> DataFrame:
    """A fixed map for tests: four neighbours in id are one group."""
    return g.nodes.join(F.broadcast(g.types.select("type_id", "offset")), "type_id").select("gid", (F.col("gid") - (F.col("gid") - F.col("offset")) % 4).alias("root"))


def with_map(spark, d):
    g = trade(spark, d)
    return g, quotient.node_map(g.nodes, mod4(g))


def kernel(spark, d):
    """The kernel graph, written once, as every later step reads it more than once."""
    k = coarsen.kernel_of(trade(spark, d))
    k = coarsen.Kernel(coarsen.settled(k.nodes), coarsen.settled(k.edges))
    adj = topology.adjacency(k.edges)
    return k, adj, coarsen.settled(topology.degrees(adj, k.nodes))


def topo(spark, d):
    """Adjacency and degrees alone: no features are read."""
    g = trade(spark, d)
    adj = topology.adjacency(topology.dedup(glob(g)))
    return g, adj, topology.degrees(adj, g.nodes)


def lists_of(spark, d, features: bool = False, order: bool = False):
    k, adj, deg = kernel(spark, d)
    return k, topology.mediator_lists(adj, deg, topology.hub_caps(deg), k.nodes if features or order else None, order)


def pairs_of(spark, d):
    k, lists = lists_of(spark, d, features=True)
    ordered = topology.stride_sampled(topology.projected_order(lists, k.nodes), 16)
    return k, ordered, topology.merge_cost(topology.band_pairs(ordered, 4))


def long(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    e = df.select(*keys, F.posexplode(col).alias("i", "a"))
    return e.select(*keys, F.col("i").cast("long").alias("i"), r6(F.col("a"), "a"))


# Sources and edges


@query(T + "SELECT type_id, node_type, n, off AS \"offset\" FROM types")
def src_nodes(spark, d):
    return trade(spark, d).types


@query(T + REL + "SELECT rel, src_type, dst_type, min(s)::BIGINT AS lo, max(d)::BIGINT AS hi, sum((s * 31 + d * 17) % 1009)::BIGINT AS mixed FROM g GROUP BY ALL")
def gid_map(spark, d):
    return glob(trade(spark, d)).groupBy("rel", "src_type", "dst_type").agg(F.min("s").alias("lo"), F.max("d").alias("hi"), F.sum((F.col("s") * 31 + F.col("d") * 17) % 1009).alias("mixed"))


@query(T + REL + "SELECT src_type, rel, dst_type, count(*)::BIGINT AS n FROM rel GROUP BY ALL")
def edge_union(spark, d):
    return trade(spark, d).edges.groupBy("src_type", "rel", "dst_type").agg(F.count("*").alias("n"))


@query(T + REL + E + "SELECT u, v FROM e")
def edge_dedup(spark, d):
    return topology.dedup(glob(trade(spark, d)))


@query(T + REL + """SELECT (SELECT count(*) FROM g)::BIGINT AS input_edge_entries, (SELECT count(*) FROM g WHERE s = d)::BIGINT AS self_loops_removed,
((SELECT count(*) FROM g WHERE s <> d) - (SELECT count(*) FROM (SELECT DISTINCT least(s, d), greatest(s, d) FROM g WHERE s <> d)))::BIGINT AS duplicate_entries_removed,
(SELECT count(*) FROM (SELECT DISTINCT least(s, d), greatest(s, d) FROM g WHERE s <> d))::BIGINT AS unique_undirected_edges""")
def edge_dedup_stats(spark, d):
    return topology.dedup_stats(glob(trade(spark, d)))


@query("SELECT 2::BIGINT AS bad")
def edge_validate(spark, d):
    g = trade(spark, d)
    bad = spark.createDataFrame([("customer", "in", "nation", 0, 25), ("customer", "in", "nation", -1, 0)], g.edges.schema)
    return outside(g.edges.unionByName(bad), g.types).agg(F.count("*").alias("bad"))


@query(T + REL + "SELECT src_type, rel, dst_type, src, dst FROM rel WHERE rel = 'contains'")
def edge_orientation(spark, d):
    """Rows handed over the wrong way round are turned back."""
    g = trade(spark, d)
    e = g.edges.where("rel = 'contains'")
    return graphs.oriented(e.select("src_type", "rel", "dst_type", F.col("dst").alias("src"), F.col("src").alias("dst")), g.types)


@query(T + REL + "SELECT rel, count(*)::BIGINT AS n FROM g GROUP BY rel")
def edge_unknown_type_skip(spark, d):
    g = trade(spark, d)
    odd = g.edges.limit(5).withColumn("dst_type", F.lit("planet"))
    return global_edges(g.edges.unionByName(odd), g.types).groupBy("rel").agg(F.count("*").alias("n"))


@query(T + REL + E + "SELECT u, count(*)::BIGINT AS n, min(v)::BIGINT AS lo, max(v)::BIGINT AS hi FROM adj GROUP BY u")
def edges_bidirectional(spark, d):
    return topology.adjacency(topology.dedup(glob(trade(spark, d)))).groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


@query(T + REL + D + "SELECT node_type AS name, count(*)::BIGINT AS n, sum(is_train::INT)::BIGINT AS train, sum(is_val::INT)::BIGINT AS val, sum(is_test::INT)::BIGINT AS test, count(DISTINCT y)::BIGINT AS classes FROM nodes JOIN types USING (type_id) GROUP BY 1 UNION ALL SELECT src_type || '/' || rel || '/' || dst_type, count(*), 0, 0, 0, 0 FROM rel GROUP BY 1")
def graph_stats(spark, d):
    g = trade(spark, d)
    one = lambda c: F.sum(F.col(c).cast("long")).alias(c[3:])
    n = g.nodes.join(F.broadcast(g.types), "type_id").groupBy(F.col("node_type").alias("name")).agg(F.count("*").alias("n"), one("is_train"), one("is_val"), one("is_test"), F.count_distinct("y").alias("classes"))
    z = F.lit(0).cast("long")
    e = g.edges.groupBy(F.concat_ws("/", "src_type", "rel", "dst_type").alias("name")).agg(F.count("*").alias("n")).select("name", "n", z.alias("train"), z.alias("val"), z.alias("test"), z.alias("classes"))
    return n.unionByName(e)


@query(T + REL + E + D + "SELECT type_id, count(*)::BIGINT AS n, sum(degree)::BIGINT AS total, max(degree)::BIGINT AS top FROM degs GROUP BY type_id")
def degree_stats(spark, d):
    _, _, deg = topo(spark, d)
    return deg.groupBy("type_id").agg(F.count("*").alias("n"), F.sum("degree").alias("total"), F.max("degree").alias("top"))


@query(T + REL + E + D + "SELECT type_id, cap FROM caps")
def hub_caps(spark, d):
    return topology.hub_caps(topo(spark, d)[2])


@query(T + REL + E + D + "SELECT gid, degs.type_id, degree::BIGINT AS degree FROM degs JOIN caps ON degs.type_id = caps.type_id AND degree > cap")
def hub_filter(spark, d):
    _, _, deg = topo(spark, d)
    return deg.join(F.broadcast(topology.hub_caps(deg)), "type_id").where("degree > cap").select("gid", "type_id", "degree")


@query(T + REL + E + D + "SELECT type_id, round(greatest(1, avg(degree)), 6) AS mean_degree FROM degs GROUP BY type_id")
def type_mean_degree(spark, d):
    return topology.type_mean_degree(topo(spark, d)[2]).select("type_id", r6(F.col("mean_degree"), "mean_degree"))


@query(T + REL + E + D + "SELECT gid, type_id, degree::BIGINT AS degree FROM (SELECT *, row_number() OVER (PARTITION BY type_id ORDER BY degree DESC, gid) AS r, count(*) OVER (PARTITION BY type_id) AS n, max(degree) OVER (PARTITION BY type_id) AS top FROM degs) WHERE top > 1 AND r <= ceil(n * 0.02)")
def hub_anchor(spark, d):
    return topology.hub_anchors(topo(spark, d)[2], 0.02)


@query(T + REL + "SELECT off + n_nationkey AS gid, round(ln(1 + (SELECT count(*) FROM g WHERE d = off + n_nationkey)), 6) AS value FROM nation, types WHERE type_id = 4")
def feat_log_degree(spark, d):
    g = trade(spark, d)
    into = glob(g).where("dst_type = 'nation'").select(F.col("d").alias("dst"))
    nodes = g.nodes.where("x is null").select(F.col("gid").alias("node_id"))
    return graphs.log_degree(nodes, into).select(F.col("node_id").alias("gid"), r6(F.col("value"), "value"))


@query("SELECT l_suppkey AS dst, round(avg(p_retailprice), 4) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def src_feature_init_mean(spark, d):
    e = graphs.read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    f = graphs.read(spark, d, "part").select(F.col("p_partkey").alias("src"), F.lit(0).alias("dim"), F.col("p_retailprice").alias("value"))
    return graphs.neighbour_mean(e, f).select("dst", F.round("value", 4).alias("value"))


@query("""WITH kept AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS id FROM customer WHERE c_mktsegment = 'BUILDING'),
o AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM kept))
SELECT kept.id::BIGINT AS src, o.id::BIGINT AS dst FROM o JOIN kept ON o_custkey = c_custkey""")
def src_induced_subgraph(spark, d):
    c = graphs.read(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    o = graphs.read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return graphs.induced(o, c, "c_custkey", "o_orderkey", "o_orderkey")


@query("""WITH m AS (SELECT * FROM (VALUES ('BUILDING', 0), ('MACHINERY', 0), ('HOUSEHOLD', 1)) t(seg, y)), c AS (SELECT c_custkey, y FROM customer JOIN m ON c_mktsegment = seg)
SELECT y, count(*)::BIGINT AS n, count(DISTINCT c_nationkey)::BIGINT AS nations FROM c JOIN customer USING (c_custkey) GROUP BY y""")
def src_label_map_prune(spark, d):
    m = F.broadcast(spark.createDataFrame([("BUILDING", 0), ("MACHINERY", 0), ("HOUSEHOLD", 1)], "c_mktsegment string, y int"))
    return graphs.read(spark, d, "customer").join(m, "c_mktsegment").groupBy("y").agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("nations"))


SPLIT = "SELECT node_id, {0} AS is_train, {1} AS is_val, {2} AS is_test FROM (SELECT *, row_number() OVER ({3} ORDER BY md5('7:' || node_id::VARCHAR), node_id) AS r, count(*) OVER ({3}) AS n FROM nodes WHERE type_id = 0)"


@query(T + REL + D + SPLIT.format("r <= greatest(1, floor(n * 0.6))", "r > greatest(1, floor(n * 0.6)) AND r <= greatest(1, floor(n * 0.6)) + greatest(1, floor(n * 0.2))", "r > greatest(1, floor(n * 0.6)) + greatest(1, floor(n * 0.2))", ""))
def split_random(spark, d):
    n = trade(spark, d).nodes.where("type_id = 0").select("node_id", "y")
    return graphs.split_by_rank(n, graphs.md5_key(7)).select("node_id", "is_train", "is_val", "is_test")


_A, _B = "least(200, greatest(1, n // 3))", "least(100, greatest(1, (n - least(200, greatest(1, n // 3))) // 4))"


@query(T + REL + D + SPLIT.format(f"r <= {_A}", f"r > {_A} AND r <= {_A} + {_B}", f"r > {_A} + {_B}", "PARTITION BY y"))
def split_stratified(spark, d):
    n = trade(spark, d).nodes.where("type_id = 0").select("node_id", "y")
    return graphs.split_stratified(n, graphs.md5_key(7)).select("node_id", "is_train", "is_val", "is_test")


@query(T + REL + D + "SELECT node_id, r > greatest(1, floor(n * 0.2)) AS is_train, r <= greatest(1, floor(n * 0.2)) AS is_val FROM (SELECT *, row_number() OVER (ORDER BY md5('0:' || node_id::VARCHAR), node_id) AS r, count(*) OVER () AS n FROM nodes WHERE is_train)")
def split_validation(spark, d):
    n = trade(spark, d).nodes.where("is_train").select("node_id", "is_train", "is_val")
    return graphs.carve_validation(n, graphs.md5_key(0)).select("node_id", "is_train", "is_val")


@query("SELECT label::BIGINT AS k, count(*)::BIGINT AS n FROM embeddings GROUP BY label")
def argmax_onehot(spark, d):
    e = graphs.read(spark, d, "embeddings")
    hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label")).cast("int"))
    return e.select(graphs.one_hot_class(hot).cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


# The quotient of a fixed map


@query(T + REL + D + MAP + "SELECT type_id, node_id, gid, root, super_id FROM m")
def node_map(spark, d):
    return with_map(spark, d)[1]


@query(T + REL + D + MAP + Q + "SELECT * FROM q")
def quotient_edges(spark, d):
    g, m = with_map(spark, d)
    return quotient.quotient_edges(g.edges, g.types, m)


def _weights(mode):
    def run(spark, d):
        g, m = with_map(spark, d)
        q = quotient.edge_weights(quotient.quotient_edges(g.edges, g.types, m), g.types, m, mode)
        return q.select("src_type", "rel", "dst_type", "ssn", "dsn", r6(F.col("weight"), "weight"))

    return run


for _mode, _sql in (("binary", "1.0::DOUBLE"), ("count", "cnt::DOUBLE"), ("log_count", "ln(1 + cnt)"), ("density", "cnt / greatest(1, sqrt(a.size * b.size))")):
    QUERIES[f"quotient_edge_weight_{_mode}"] = _weights(_mode)
    SQL[f"quotient_edge_weight_{_mode}"] = T + REL + D + MAP + Q + f", sized AS (SELECT node_type, super_id, count(*) AS size FROM m JOIN types USING (type_id) GROUP BY ALL) SELECT src_type, rel, dst_type, ssn, dsn, round({_sql}, 6) AS weight FROM q JOIN sized a ON a.node_type = src_type AND a.super_id = ssn JOIN sized b ON b.node_type = dst_type AND b.super_id = dsn"

CENTRE = ", centre AS (SELECT m.type_id, super_id, i, avg(a) AS c FROM x JOIN m USING (gid) GROUP BY ALL) "


@query(T + REL + D + MAP + M + CENTRE + "SELECT type_id, super_id, i, round(c, 6) + 0.0 AS a FROM centre")
def supernode_centroid(spark, d):
    g, m = with_map(spark, d)
    return long(quotient.centroids(g.nodes, m), ["type_id", "super_id"], "c")


@query(T + REL + D + MAP + M + CENTRE + """, dist AS (SELECT m.type_id, m.super_id, m.gid, sum((a - c) * (a - c)) AS d FROM x JOIN m USING (gid) JOIN centre ON centre.type_id = m.type_id AND centre.super_id = m.super_id AND centre.i = x.i GROUP BY ALL),
w AS (SELECT *, exp(-d / greatest(avg(d) OVER (PARTITION BY type_id, super_id), 1e-8)) AS w FROM dist)
SELECT w.type_id, super_id, x.i, round(sum(w * a) / greatest(sum(w), 1e-8), 6) + 0.0 AS a FROM w JOIN x USING (gid) GROUP BY ALL""")
def supernode_features(spark, d):
    g, m = with_map(spark, d)
    return long(quotient.super_features(g.nodes, m), ["type_id", "super_id"], "x")


VOTES = ", votes AS (SELECT m.type_id, super_id, y, count(*) AS n FROM m JOIN nodes USING (gid) WHERE y >= 0 AND is_train GROUP BY ALL) "


def _votes(spark, d):
    g, m = with_map(spark, d)
    return quotient.label_counts(g.nodes, m)


@query(T + REL + D + MAP + VOTES + "SELECT type_id, super_id, y FROM (SELECT *, row_number() OVER (PARTITION BY type_id, super_id ORDER BY n DESC, y) AS r FROM votes) WHERE r = 1")
def label_vote(spark, d):
    return quotient.voted(_votes(spark, d))


@query(T + REL + D + MAP + VOTES + "SELECT type_id, super_id, y, round(n / sum(n) OVER (PARTITION BY type_id, super_id), 6) AS share FROM votes")
def soft_labels(spark, d):
    return quotient.soft_labels(_votes(spark, d)).select("type_id", "super_id", "y", r6(F.col("share"), "share"))


@query(T + REL + D + MAP + VOTES + "SELECT round(avg(p), 6) AS mean_purity, round(min(p), 6) AS min_purity, round(quantile_disc(p, 0.5), 6) AS median_purity FROM (SELECT max(n) / sum(n) AS p FROM votes GROUP BY type_id, super_id)")
def purity(spark, d):
    p = quotient.purity(_votes(spark, d))
    return p.select(*(r6(F.col(c), c) for c in p.columns))


@query(T + REL + D + MAP + "SELECT m.type_id, super_id, bool_or(is_train) AS is_train, bool_or(is_val) AND NOT bool_or(is_train) AS is_val, bool_or(is_test) AND NOT bool_or(is_train) AS is_test FROM m JOIN nodes USING (gid) GROUP BY ALL")
def mask_rollup(spark, d):
    g, m = with_map(spark, d)
    return quotient.masks(g.nodes, m)


@query(T + REL + D + "SELECT gid, CASE WHEN type_id IN (1, 4) THEN gid ELSE gid - node_id % 4 END AS root FROM nodes")
def freeze_types(spark, d):
    g = trade(spark, d)
    return quotient.freeze(mod4(g), g.nodes, g.types, ["order", "nation"])


@query(T + REL + D + "SELECT y, count(*)::BIGINT AS n FROM nodes WHERE y >= 0 GROUP BY y")
def label_hist(spark, d):
    return trade(spark, d).nodes.where("y >= 0").groupBy("y").agg(F.count("*").alias("n"))


# Metrics


@query(T + REL + D + MAP + Q + "SELECT *, round(supernodes / nodes, 6) AS node_retention, round(nodes / supernodes, 6) AS node_compression, round(superedges / edges, 6) AS edge_retention, round(edges / superedges, 6) AS edge_compression FROM (SELECT (SELECT count(*) FROM m)::BIGINT AS nodes, (SELECT count(DISTINCT root) FROM m)::BIGINT AS supernodes, (SELECT count(*) FROM rel)::BIGINT AS edges, (SELECT count(*) FROM q)::BIGINT AS superedges)")
def compression_stats(spark, d):
    g, m = with_map(spark, d)
    c = metrics.compression(g.nodes, m, g.edges, quotient.quotient_edges(g.edges, g.types, m))
    return c.select(*(r6(F.col(x), x) if x.endswith(("retention", "compression")) else x for x in c.columns))


@query(T + REL + D + MAP + "SELECT round(sum(top) / sum(n), 6) AS upper_bound, round(avg((classes > 1)::INT), 6) AS mixed_frac, round(avg(top / n), 6) AS mean_purity, sum(n)::BIGINT AS n_nodes FROM (SELECT super_id, max(c) AS top, sum(c) AS n, count(*) AS classes FROM (SELECT super_id, y, count(*) AS c FROM m JOIN nodes USING (gid) WHERE is_test AND y >= 0 GROUP BY ALL) GROUP BY 1)")
def oracle_upper_bound(spark, d):
    g, m = with_map(spark, d)
    o = metrics.oracle_upper_bound(g.nodes, m)
    return o.select(*(c if c == "n_nodes" else r6(F.col(c), c) for c in o.columns))


@query(T + REL + D + MAP + M + CENTRE + """, j AS (SELECT x.gid, sum((a - c) * (a - c)) AS d2, sum(a * c) / (greatest(sqrt(sum(a * a)), 1e-12) * greatest(sqrt(sum(c * c)), 1e-12)) AS cos FROM x JOIN m USING (gid) JOIN centre ON centre.type_id = m.type_id AND centre.super_id = m.super_id AND centre.i = x.i WHERE m.type_id = 0 GROUP BY 1)
SELECT round(avg(d2) / greatest((SELECT sum(v) FROM (SELECT var_pop(a) AS v FROM x WHERE type_id = 0 GROUP BY i)), 1e-12), 6) AS distortion, round(avg(cos), 6) AS cosine FROM j""")
def embedding_diagnostics(spark, d):
    g, m = with_map(spark, d)
    e = metrics.embedding_diagnostics(g.nodes, m, 0)
    return e.select(*(r6(F.col(c), c) for c in e.columns))


_PRED = ", pr AS (SELECT y, (node_id % 5)::INT AS p FROM nodes WHERE type_id = 0), per AS (SELECT k, sum((y = k AND p = k)::INT) AS tp, sum((y = k AND p <> k)::INT) AS fn, sum((y <> k AND p = k)::INT) AS fp FROM pr, (SELECT DISTINCT y AS k FROM pr UNION SELECT p FROM pr) GROUP BY k) "


@query(T + REL + D + _PRED + "SELECT round(sum(tp) / sum(tp + fn), 6) AS accuracy, round(sum(tp) / sum(tp + fn), 6) AS micro_f1, round(avg(CASE WHEN tp + fn > 0 THEN 2 * tp / (2 * tp + fn + fp) END), 6) AS macro_f1, sum(tp + fn)::BIGINT AS n FROM per")
def classification_metrics(spark, d):
    c = metrics.classification(trade(spark, d).nodes.where("type_id = 0").select("y", (F.col("node_id") % 5).cast("int").alias("p")))
    return c.select(*(x if x == "n" else r6(F.col(x), x) for x in c.columns))


@query(T + REL + D + "SELECT ((SELECT sum(CASE type_id WHEN 3 THEN 4 WHEN 4 THEN 0 ELSE 8 END) + sum(CASE WHEN y IS NOT NULL THEN 11 ELSE 0 END) FROM nodes) + (SELECT 16 * count(*) FROM rel))::BIGINT AS bytes")
def storage_bytes(spark, d):
    g = trade(spark, d)
    return metrics.storage(g.nodes, g.edges)


@query(T + REL + D + MAP + VOTES + ", best AS (SELECT super_id, y AS p FROM (SELECT *, row_number() OVER (PARTITION BY super_id ORDER BY n DESC, y) AS r FROM votes) WHERE r = 1) SELECT round(avg((y = p)::INT), 6) AS accuracy, count(*)::BIGINT AS n FROM nodes JOIN m USING (gid) JOIN best USING (super_id) WHERE nodes.type_id = 0 AND is_test AND y >= 0")
def eval_original(spark, d):
    g, m = with_map(spark, d)
    pred = quotient.voted(quotient.label_counts(g.nodes, m)).withColumnRenamed("y", "p")
    c = metrics.classification(metrics.on_originals(pred, g.nodes, m))
    return c.select(r6(F.col("accuracy"), "accuracy"), "n")


# Features and embeddings


@query(T + REL + D + M + "SELECT gid, i, round(a / greatest(sqrt(sum(a * a) OVER (PARTITION BY gid)), 1e-8), 6) + 0.0 AS a FROM x")
def vec_l2_normalize(spark, d):
    return long(trade(spark, d).nodes.where("x is not null").select("gid", vec.normalized(F.col("x")).alias("x")), ["gid"], "x")


@query(T + REL + D + M + """, dg AS (SELECT gid, count(*) AS n FROM (SELECT s AS gid FROM g UNION ALL SELECT d FROM g) GROUP BY 1)
SELECT gid, i, round(a / greatest(sqrt(sum(a * a) OVER (PARTITION BY gid)), 1e-8), 6) + 0.0 AS a FROM x UNION ALL
SELECT nodes.gid, CASE type_id WHEN 3 THEN 1 WHEN 4 THEN 0 ELSE 2 END, CASE WHEN coalesce(n, 0) > 0 THEN 1.0 ELSE 0.0 END FROM nodes LEFT JOIN dg USING (gid)""")
def node_representation(spark, d):
    g = trade(spark, d)
    e = glob(g)
    deg = e.select(F.col("s").alias("gid")).unionByName(e.select(F.col("d").alias("gid"))).groupBy("gid").count()
    lone = F.array(F.log1p(F.coalesce("count", F.lit(0)).cast("double")))
    rep = F.concat(F.coalesce(vec.normalized(F.col("x")), F.array().cast("array<double>")), vec.normalized(lone))
    return long(g.nodes.join(deg, "gid", "left").select("gid", rep.alias("x")), ["gid"], "x")


@query("SELECT vec_id, j, round(v, 5) + 0.0 AS a FROM (SELECT vec_id, j, sum(embedding[i + 1]::DOUBLE * (1 - 2 * (((i * 7919 + j * 104729 + 31) % 101) % 2))) / 2.0 AS v FROM embeddings, range(0, 64) t(i), range(0, 4) s(j) GROUP BY ALL)")
def vec_project_pad(spark, d):
    e = graphs.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return e.select("vec_id", F.posexplode(vec.sign_projection(F.col("x"), 4)).alias("j", "v")).select("vec_id", F.col("j").cast("long").alias("j"), (F.round("v", 5) + 0.0).alias("a"))


HOP = ", per AS (SELECT d, src_type, rel, dst_type, i, avg(a) AS a FROM g JOIN h ON s = h.gid GROUP BY ALL), prop AS (SELECT d AS gid, i, avg(a) AS a FROM per GROUP BY ALL) "
START = ", p0 AS (SELECT gid, i, a FROM x UNION ALL SELECT gid, 1, 0.0 FROM nodes WHERE type_id = 3), h AS (SELECT gid, i, a / greatest(sqrt(sum(a * a) OVER (PARTITION BY gid)), 1e-8) AS a FROM p0) "


@query(T + REL + D + M + START + HOP + "SELECT gid, i, round(a, 6) + 0.0 AS a FROM prop")
def propagate_mean(spark, d):
    g = trade(spark, d)
    return long(embed.propagated(embed.start(g.nodes, 2), glob(g)), ["gid"], "p")


@query(T + REL + D + M + START + HOP + ", s AS (SELECT gid, i, coalesce(h.a, 0) + coalesce(prop.a, 0) AS a FROM h FULL JOIN prop USING (gid, i)) SELECT gid, i, round(a / greatest(sqrt(sum(a * a) OVER (PARTITION BY gid)), 1e-8), 6) + 0.0 AS a FROM s")
def fast_embed(spark, d):
    g = trade(spark, d)
    return long(embed.fast_embed(g.nodes, glob(g), 1, 2), ["gid"], "h")


@query(T + REL + "SELECT gid, rel_key, side, count(*)::BIGINT AS n FROM (SELECT s AS gid, src_type || '/' || rel || '/' || dst_type AS rel_key, 0 AS side FROM g UNION ALL SELECT d, src_type || '/' || rel || '/' || dst_type, 1 FROM g) GROUP BY ALL")
def relprop_signature(spark, d):
    g = trade(spark, d)
    return embed.relation_signature(g.nodes, glob(g))


@query()
def relprop_embed(spark, d):
    g = trade(spark, d)
    return long(embed.relation_embed(g.nodes, glob(g), 1, 8), ["gid"], "h")


@query(T + REL + D + M + START + HOP + "SELECT h.gid, h.i, round(CASE WHEN prop.a IS NULL THEN h.a ELSE 0.9 * prop.a + 0.1 * h.a END, 6) + 0.0 AS a FROM h LEFT JOIN prop USING (gid, i)")
def appnp_propagate(spark, d):
    g = trade(spark, d)
    h0 = embed.start(g.nodes, 2).where("h is not null")
    return long(embed.appnp(h0, glob(g), 1, 0.1), ["gid"], "h")


@query("SELECT l_partkey AS d, round(sum(l_quantity * (l_suppkey % 7)) / greatest(1, sum(l_quantity)), 6) AS a FROM lineitem GROUP BY 1")
def weighted_mean_propagate(spark, d):
    e = graphs.read(spark, d, "lineitem").select(F.col("l_partkey").alias("d"), F.array((F.col("l_suppkey") % 7).cast("double")).alias("x"), F.col("l_quantity").alias("w"))
    return embed.vector_mean(e, ["d"], weight="w").select("d", r6(F.element_at("x", 1), "a"))


@query("SELECT l_partkey AS d, sum(l_suppkey % 7)::BIGINT AS a FROM lineitem GROUP BY 1")
def sum_propagate(spark, d):
    e = graphs.read(spark, d, "lineitem").select(F.col("l_partkey").alias("d"), F.array((F.col("l_suppkey") % 7).cast("double")).alias("x"))
    return embed.vector_mean(e, ["d"], total=True).select("d", F.element_at("x", 1).cast("long").alias("a"))


@query(T + REL + D + M + START + HOP + "SELECT gid, i, round(a, 6) + 0.0 AS a FROM h UNION ALL SELECT gid, i + CASE WHEN gid IN (SELECT gid FROM h) THEN 2 ELSE 0 END, round(a, 6) + 0.0 FROM prop")
def freehgc_repr(spark, d):
    g = trade(spark, d)
    return long(embed.hop_concat(embed.start(g.nodes, 2), glob(g), 1), ["gid"], "h")


@query()
def sage_forward(spark, d):
    g = trade(spark, d)
    return embed.sage_forward(embed.fast_embed(g.nodes, glob(g), 1, 4), glob(g), 4)


@query(T + REL + "SELECT rel, d, count(*)::BIGINT AS n, min(s)::BIGINT AS lo, max(s)::BIGINT AS hi FROM (SELECT *, row_number() OVER (PARTITION BY src_type, rel, dst_type, d ORDER BY md5('0:' || s::VARCHAR || ':' || d::VARCHAR), s) AS r FROM (SELECT DISTINCT src_type, rel, dst_type, s, d FROM g)) WHERE r <= 3 GROUP BY ALL")
def neighbor_sample(spark, d):
    s = embed.sampled_neighbours(glob(trade(spark, d)), 3)
    return s.groupBy("rel", "d").agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"))


@query()
def metapath_walks(spark, d):
    g = trade(spark, d)
    adj = topology.adjacency(topology.dedup(glob(g).where("src_type in ('customer', 'order') and dst_type in ('customer', 'order')")))
    return embed.walks(adj, g.nodes.where("type_id = 0"), 9)


@query()
def metapath_vectors(spark, d):
    w = metapath_walks(spark, d)
    return embed.word_vectors(spark, w, 8).select("gid")


@query()
def pca_reduce(spark, d):
    e = graphs.read(spark, d, "embeddings").select(F.col("vec_id").alias("gid"), F.col("embedding").cast("array<double>").alias("h"))
    return embed.pca(e, 8)


@query(T + REL + D + M + "SELECT t.type_id, round(CASE WHEN k >= 2 AND v > 0 THEN v ELSE 1 END, 6) AS var FROM types t LEFT JOIN (SELECT type_id, sum(v) AS v, max(n) AS k FROM (SELECT type_id, i, var_pop(a) AS v, count(*) AS n FROM x GROUP BY ALL) GROUP BY 1) USING (type_id)")
def feat_var(spark, d):
    return topology.feature_variance(trade(spark, d).nodes).select("type_id", r6(F.col("var"), "var"))


# Mediators and candidates


@query(T + REL + E + D + LISTS + "SELECT t_src, t_med, med, k, row_number() OVER (PARTITION BY t_src, t_med ORDER BY k DESC, med)::INT AS leader_rank FROM (SELECT DISTINCT t_src, t_med, med, k FROM lists)")
def mediator_leaders(spark, d):
    g = trade(spark, d)
    return topology.leaders(topology.mediator_counts(topology.adjacency(topology.dedup(glob(g))), g.nodes))


@query(T + REL + E + D + M + K + LISTS + ORDERED + "SELECT med, t_src, u, r::INT AS r FROM ordered")
def lsh_order(spark, d):
    k, lists = lists_of(spark, d, order=True)
    return topology.projected_order(lists, k.nodes).select("med", "t_src", "u", "r")


@query(T + REL + E + D + M + K + LISTS + ORDERED + "SELECT med, t_src, u, r::INT AS r FROM strided")
def stride_sample(spark, d):
    k, lists = lists_of(spark, d, order=True)
    return topology.stride_sampled(topology.projected_order(lists, k.nodes), 16).select("med", "t_src", "u", "r")


@query(T + REL + E + D + M + K + LISTS + ORDERED + PAIRS + "SELECT med, t_src, u, v, gap::INT AS gap FROM pairs")
def mediator_pairs_band(spark, d):
    k, lists = lists_of(spark, d, order=True)
    return topology.band_pairs(topology.stride_sampled(topology.projected_order(lists, k.nodes), 16), 4).select("med", "t_src", "u", "v", "gap")


@query(T + REL + E + D + M + K + LISTS + ORDERED + PAIRS + "SELECT med, u, v, round(cost, 6) AS cost FROM pairs")
def merge_cost(spark, d):
    _, _, p = pairs_of(spark, d)
    return p.select("med", "u", "v", r6(F.col("cost"), "cost"))


DENSE = ", dense AS (SELECT med, t_src, u, sum(ok)::BIGINT AS density FROM (SELECT med, t_src, u, (round(cost, 4) <= 0.05)::INT AS ok FROM pairs UNION ALL SELECT med, t_src, v, (round(cost, 4) <= 0.05)::INT FROM pairs) GROUP BY ALL) "


@query(T + REL + E + D + M + K + LISTS + ORDERED + PAIRS + DENSE + "SELECT * FROM dense")
def window_density(spark, d):
    _, _, p = pairs_of(spark, d)
    return topology.window_density(p.withColumn("cost", F.round("cost", 4)), 0.05).drop("t_med")


@query(T + REL + E + D + M + K + LISTS + ORDERED + PAIRS + DENSE + "SELECT med, t_src, u, row_number() OVER (PARTITION BY med, t_src ORDER BY density DESC, u)::INT AS r FROM dense")
def density_leaders(spark, d):
    _, _, p = pairs_of(spark, d)
    dens = topology.window_density(p.withColumn("cost", F.round("cost", 4)), 0.05)
    return dens.select("med", "t_src", "u", F.row_number().over(Window.partitionBy("med", "t_src").orderBy(F.desc("density"), "u")).alias("r"))


# A small shift keeps sums off the ties of rounding. With weights of 1 the change is a closed form: each of a list's n members, the pair included, loses half of |x_u - x_v|^2.
@query(T + REL + E + D + M + K + LISTS + ORDERED + PAIRS + """, sizes AS (SELECT med, t_src, count(*) AS n FROM strided GROUP BY ALL)
SELECT p.med, p.u, p.v, round(3.3e-6::DOUBLE - n * cost, 5) + 0.0 AS delta FROM pairs p JOIN sizes USING (med, t_src)""")
def dirichlet_delta(spark, d):
    k, ordered, _ = pairs_of(spark, d)
    p = topology.band_pairs(topology.moments(ordered, 2), 4, ("weights", "sums", "squares"))
    return topology.dirichlet_delta(p, ordered, k.nodes).select("med", "u", "v", (F.round(F.col("delta") + 3.3e-6, 5) + 0.0).alias("delta"))


@query(T + REL + E + D + """, half AS (SELECT a.u AS med, a.v AS u, b.type_id AS t FROM adj a JOIN degs m ON m.gid = a.u AND m.degree <= 30 JOIN degs b ON b.gid = a.v),
two AS (SELECT DISTINCT p.u, q.u AS v FROM half p JOIN half q ON p.med = q.med AND p.t = q.t AND p.u <> q.u)
SELECT u, v, rank::INT AS rank FROM (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY degree DESC, v) AS rank FROM two JOIN degs ON gid = v) WHERE rank <= 5""")
def two_hop_candidates(spark, d):
    _, adj, deg = topo(spark, d)
    return topology.two_hop_candidates(adj, deg, 30, 5).select("u", "v", "rank")


# Coarsening

SIMPLE = ", cand AS (SELECT least(u, v) AS u, greatest(u, v) AS v, min(round(cost, 6)) AS cost FROM pairs WHERE round(cost, 6) <= 0.05 GROUP BY ALL), sides AS (SELECT u AS me, u, v, cost FROM cand UNION ALL SELECT v, u, v, cost FROM cand), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY me ORDER BY cost, u, v) AS r FROM sides) WHERE r = 1), merges AS (SELECT u, v FROM best GROUP BY u, v HAVING count(*) = 2) "


def _simple_pairs(spark, d):
    k, _, p = pairs_of(spark, d)
    ok = p.withColumn("cost", F.round("cost", 6)).where("cost <= 0.05")
    return k, ok.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "cost").groupBy("u", "v").agg(F.min("cost").alias("cost"))


@query(T + REL + E + D + M + K + LISTS + ORDERED + PAIRS + SIMPLE + "SELECT u, v FROM merges")
def merge_round(spark, d):
    return coarsen.mutual_best(_simple_pairs(spark, d)[1]).select("u", "v")


@query(T + REL + E + D + ", cm AS (SELECT gid, gid - node_id % 4 AS root FROM nodes) SELECT least(a.root, b.root) AS u, greatest(a.root, b.root) AS v, count(*)::BIGINT AS w FROM e JOIN cm a ON e.u = a.gid JOIN cm b ON e.v = b.gid WHERE a.root <> b.root GROUP BY ALL")
def kernel_rebuild(spark, d):
    g = trade(spark, d)
    k = coarsen.rebuilt(coarsen.kernel_of(g), mod4(g), g.edges.count())
    return k.edges.select("u", "v", F.col("w").cast("long").alias("w"))


@query(T + REL + D + M + K + "SELECT gid - node_id % 4 AS gid, i, round(avg(a), 6) + 0.0 AS value FROM kx JOIN nodes USING (gid) GROUP BY ALL")
def kernel_rebuild_features(spark, d):
    g = trade(spark, d)
    k = coarsen.rebuilt(coarsen.kernel_of(g), mod4(g), g.edges.count())
    one = k.nodes.select("gid", F.posexplode("x").alias("i", "a"))
    return one.select("gid", F.col("i").cast("long").alias("i"), r6(F.col("a"), "value"))


@query(T + REL + D + "SELECT gid - node_id % 4 AS gid, bool_or(gid % 7 = 0) OR count(*) > 1 AS done FROM nodes GROUP BY 1")
def finalized_flags(spark, d):
    g = trade(spark, d)
    return coarsen.finalized(g.nodes.select("gid", (F.col("gid") % 7 == 0).alias("done")), mod4(g))


@query(T + REL + D + "SELECT gid, gid - node_id % 8 AS root FROM nodes")
def map_compose(spark, d):
    g = trade(spark, d)
    eight = g.nodes.select("gid", (F.col("gid") - F.col("node_id") % 8).alias("root"))
    return coarsen.composed(mod4(g), eight)


SINGLES = ", cm AS (SELECT gid, CASE WHEN node_id % 5 = 0 THEN gid ELSE gid - node_id % 5 + 1 END AS root FROM nodes WHERE TRUE), sz AS (SELECT root, count(*) AS n FROM cm GROUP BY 1), small AS (SELECT degs.gid, degs.type_id FROM degs JOIN caps USING (type_id) WHERE degree <= cap) "


def _fives(g: TypedGraph) -> DataFrame:
    return g.nodes.select("gid", F.when(F.col("node_id") % 5 == 0, F.col("gid")).otherwise(F.col("gid") - F.col("node_id") % 5 + 1).alias("root"))


@query(T + REL + E + D + SINGLES + """, single AS (SELECT small.* FROM small JOIN sz ON sz.root = small.gid AND n = 1 JOIN cm ON cm.gid = small.gid AND cm.root = small.gid)
SELECT gid, type_id, root FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY root) AS r FROM (
SELECT DISTINCT s.gid, s.type_id, c.root FROM single s JOIN adj a ON a.u = s.gid JOIN small m ON m.gid = a.v AND m.type_id <> s.type_id JOIN adj b ON b.u = m.gid AND b.v <> s.gid JOIN nodes o ON o.gid = b.v AND o.type_id = s.type_id JOIN cm c ON c.gid = b.v JOIN sz ON sz.root = c.root AND sz.n > 1)) WHERE r <= 32""")
def reassign_candidates(spark, d):
    g = trade(spark, d)
    return coarsen.reassign_candidates(coarsen.kernel_of(g), _fives(g))


@query(T + REL + E + D + M + K + SINGLES + """, single AS (SELECT small.* FROM small JOIN sz ON sz.root = small.gid AND n = 1 JOIN cm ON cm.gid = small.gid AND cm.root = small.gid),
cand AS (SELECT DISTINCT s.gid, s.type_id, c.root FROM single s JOIN adj a ON a.u = s.gid JOIN small m ON m.gid = a.v AND m.type_id <> s.type_id JOIN adj b ON b.u = m.gid AND b.v <> s.gid JOIN nodes o ON o.gid = b.v AND o.type_id = s.type_id JOIN cm c ON c.gid = b.v JOIN sz ON sz.root = c.root AND sz.n > 1),
centre AS (SELECT root, i, avg(a) AS c FROM kx JOIN cm USING (gid) GROUP BY ALL),
dist AS (SELECT cand.gid, cand.type_id, cand.root, round(sum((a - c) * (a - c)), 9) AS d FROM cand JOIN kx ON kx.gid = cand.gid JOIN centre ON centre.root = cand.root AND centre.i = kx.i GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY d, root) AS r FROM dist) WHERE r = 1),
md AS (SELECT type_id, greatest(1, avg(degree)) AS md FROM degs GROUP BY 1),
kvar AS (SELECT type_id, CASE WHEN max(n) >= 2 AND sum(v) > 0 THEN sum(v) ELSE 1 END AS var FROM (SELECT type_id, i, var_pop(a) AS v, count(*) AS n FROM kx GROUP BY ALL) GROUP BY 1)
SELECT best.gid, best.root FROM best JOIN degs ON degs.gid = best.gid JOIN md ON md.type_id = best.type_id JOIN kvar ON kvar.type_id = best.type_id
WHERE round(d * (1 + ln(1 + degree / md)), 9) <= round(0.5 * var, 9)""")
def reassign_round(spark, d):
    g = trade(spark, d)
    k = coarsen.kernel_of(g)
    return coarsen.reassigned(coarsen.Kernel(coarsen.settled(k.nodes), coarsen.settled(k.edges)), _fives(g), 0.5)


@query()
def ball_merge_round(spark, d):
    _, p = _simple_pairs(spark, d)
    dens = p.select("u").unionByName(p.select(F.col("v").alias("u"))).groupBy("u").agg(F.count("*").alias("density"))
    return coarsen.ball_merge(p, dens)


@query()
def coarsen_global(spark, d):
    k = coarsen.kernel_of(trade(spark, d))
    return coarsen.coarsened(k, 0.2, 2.0, levels=1, outers=2, window=5, cap=16)[0]


# Calibration and search


@query("WITH s AS (SELECT c_custkey AS id, c_acctbal AS a, c_nationkey AS n FROM customer) SELECT s.id AS u, t.id AS v, round((s.a - t.a) * (s.a - t.a), 2) AS dist FROM s JOIN s t ON t.id = s.id + 1")
def edge_distance(spark, d):
    c = graphs.read(spark, d, "customer").select(F.col("c_custkey").alias("gid"), F.array("c_acctbal").alias("x"))
    n = c.select(F.col("gid").alias("s"), (F.col("gid") + 1).alias("d"), F.lit(0).alias("st"), F.lit(0).alias("dt"))
    return search.edge_distances(n, c).select("u", "v", F.round("dist", 2).alias("dist"))


@query("SELECT round(quantile_cont(p_retailprice, least(0.95, greatest(0.05, 0.2 + ln(4) / 5 * 0.65))), 6) AS scale FROM part")
def cdf_scale(spark, d):
    p = graphs.read(spark, d, "part").select(F.col("p_retailprice").alias("dist"))
    return p.agg(r6(F.percentile("dist", search.cdf_share(4.0)), "scale"))


@query("SELECT round(quantile_cont(l_extendedprice, 0.35), 6) AS p FROM lineitem")
def energy_percentile(spark, d):
    return graphs.read(spark, d, "lineitem").agg(r6(F.percentile("l_extendedprice", 0.35), "p"))


EN = ", kvar AS (SELECT type_id, CASE WHEN max(n) >= 2 AND sum(v) > 0 THEN sum(v) ELSE 1 END AS var FROM (SELECT type_id, i, var_pop(a) AS v, count(*) AS n FROM kx GROUP BY ALL) GROUP BY 1), few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY med, t_src ORDER BY u) AS i FROM lists) WHERE i <= 20), pe AS (SELECT * FROM (SELECT a.med, a.t_src, a.t_med, a.u, b.u AS v, row_number() OVER (PARTITION BY a.med, a.t_src ORDER BY a.i, b.i) AS r FROM few a JOIN few b ON a.med = b.med AND a.t_src = b.t_src AND a.i < b.i) WHERE r <= 5), en AS (SELECT * FROM (SELECT pe.t_src, pe.t_med, pe.med, pe.u, pe.v, 0.5 * round(sum((a.a - b.a) * (a.a - b.a)), 12) / any_value(var) AS energy FROM pe JOIN kx a ON a.gid = pe.u JOIN kx b ON b.gid = pe.v AND b.i = a.i JOIN kvar ON kvar.type_id = pe.t_src GROUP BY ALL) WHERE energy > 0) "


def _energies(spark, d):
    k, lists = lists_of(spark, d)
    return search.mediator_energies(lists, k.nodes, topology.feature_variance(k.nodes))


@query(T + REL + E + D + M + K + LISTS + EN + "SELECT t_src, t_med, count(*)::BIGINT AS n, round(avg(energy), 5) AS mean FROM en GROUP BY ALL")
def mediator_pair_energy(spark, d):
    return _energies(spark, d).groupBy("t_src", "t_med").agg(F.count("*").alias("n"), F.round(F.avg("energy"), 5).alias("mean"))


@query(T + REL + E + D + M + K + LISTS + EN + """, sh AS (SELECT least(0.9, greatest(0.005, 0.75 / least(6, greatest(1, avg(degree) / 2)))) AS p FROM degs),
o AS (SELECT energy, row_number() OVER (ORDER BY energy) - 1 AS i, count(*) OVER () AS n FROM en), placed AS (SELECT i, energy, p * (n - 1) AS place FROM o, sh)
SELECT round(max(CASE WHEN i = floor(place) THEN energy END) + (max(place) - floor(max(place))) * (max(CASE WHEN i = ceil(place) THEN energy END) - max(CASE WHEN i = floor(place) THEN energy END)), 5) AS scale FROM placed""")
def one_shot_scale(spark, d):
    _, _, deg = topo(spark, d)
    scale = search.one_shot_scale(coarsen.settled(_energies(spark, d).select("energy")), 4.0, float(deg.agg(F.avg("degree")).first()[0]))
    return spark.createDataFrame([(scale,)], "scale double").select(F.round("scale", 5).alias("scale"))


@query(T + REL + E + D + M + K + LISTS + EN + "SELECT t_src, round(CASE WHEN count(*) >= 20 THEN quantile_cont(energy, 0.3) ELSE (SELECT quantile_cont(energy, 0.3) FROM en) END, 5) AS scale, count(*)::BIGINT AS n FROM en GROUP BY 1")
def type_threshold_bases(spark, d):
    return search.bases(_energies(spark, d), 0.3, ["t_src"]).withColumn("scale", F.round("scale", 5))


@query(T + REL + E + D + M + K + LISTS + EN + ", up AS (SELECT t_src, quantile_cont(energy, 0.3) AS p FROM en GROUP BY 1 HAVING count(*) >= 20) SELECT own.t_src, t_med, round(CASE WHEN n >= 20 THEN own.p ELSE coalesce(up.p, (SELECT quantile_cont(energy, 0.3) FROM en)) END, 5) AS scale, n FROM (SELECT t_src, t_med, quantile_cont(energy, 0.3) AS p, count(*)::BIGINT AS n FROM en GROUP BY ALL) own LEFT JOIN up ON up.t_src = own.t_src")
def metapath_threshold_bases(spark, d):
    return search.bases(_energies(spark, d), 0.3, ["t_src", "t_med"]).withColumn("scale", F.round("scale", 5))


@query(T + REL + E + D + M + K + LISTS + EN + """, own AS (SELECT t_src, t_med, avg(energy) AS s FROM en GROUP BY ALL HAVING count(*) >= 400),
up AS (SELECT t_src, avg(energy) AS s FROM en GROUP BY 1 HAVING count(*) >= 1500)
SELECT t_src, t_med, round(coalesce(own.s, up.s, (SELECT avg(energy) FROM en)), 5) AS scale
FROM (SELECT DISTINCT t_src, t_med FROM lists) LEFT JOIN own USING (t_src, t_med) LEFT JOIN up USING (t_src)""")
def threshold_scale(spark, d):
    """Mean energies: of a pair of types with 400 or more, else of a source type with 1,500 or more, else of all."""
    k, lists = lists_of(spark, d)
    every = coarsen.settled(search.mediator_energies(lists, k.nodes, topology.feature_variance(k.nodes), zeros=True).select("t_src", "t_med", "energy"))
    en = every.where("energy > 0")
    mean = lambda keys, least: en.groupBy(*keys).agg(F.avg("energy").alias("scale"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    wanted = every.select("t_src", "t_med").distinct()  # each list has a pair
    out = topology.threshold_scale(wanted, mean(["t_src", "t_med"], 400), mean(["t_src"], 1500), en.agg(F.avg("energy")).first()[0])
    return out.select("t_src", "t_med", F.round("scale", 5).alias("scale"))


def _searched(spark, d, how):
    """A search over the coarsening itself: one pass a run over candidates that are made once."""
    k, _, _ = kernel(spark, d)
    near = coarsen.candidate_pairs(k, 5, 16)
    near = near[0], coarsen.settled(near[1])

    def run(scale: float):
        m, info = coarsen.coarsened(k, scale, levels=1, outers=1, window=5, cap=16, reassign=False, first=near)
        return m, info["nodes"] / max(1, info["supernodes"])

    cmap, info = how(run)
    kept = cmap.agg((F.count_distinct("root") / F.count("*")).alias("kept")).first()["kept"]
    return spark.createDataFrame([(round(info["scale"], 6), round(info["compression"], 6), round(kept * info["compression"], 6), info["saturated"])], "scale double, compression double, one double, saturated boolean")


@query()
def ratio_search_fast(spark, d):
    return _searched(spark, d, lambda run: search.fast_search(run, 0.05, 0.8))


@query()
def ratio_search_precise(spark, d):
    return _searched(spark, d, lambda run: search.precise_search(run, 0.05, 0.8))


def _checked(spark, d, node_map, ratio: float, slack: float):
    """What a map from nodes to supernodes must be: every node once, roots that are members of their own group, types kept,
    supernode ids without gaps; and what it must do: keep the wanted share of nodes up to ``slack`` of it, have groups of more
    than one, and leave every type."""
    g = trade(spark, d)
    node_map = coarsen.settled(node_map)
    m = node_map.join(g.nodes.select("gid", F.col("type_id").alias("t")), "gid", "full")
    roots = node_map.select(F.col("gid").alias("root"), F.col("root").alias("again"), F.col("type_id").alias("t_root"))
    per = node_map.groupBy("type_id").agg((F.count_distinct("super_id") == F.max("super_id") + 1).alias("dense"), F.count_distinct("root").alias("kept"), F.count("*").alias("all"))
    share = F.sum("kept") / F.sum("all")
    whole = per.agg(F.bool_and("dense").alias("dense"), F.count("*").alias("types"), F.coalesce(F.abs(share - ratio) <= slack * ratio, F.lit(False)).alias("near"), (F.sum("kept") < F.sum("all")).alias("merged"))
    bad = m.join(roots, "root", "left").agg(F.count_if(F.col("t").isNull() | F.col("type_id").isNull() | (F.col("t") != F.col("type_id"))).alias("odd"), F.count_if(~F.coalesce((F.col("again") == F.col("root")) & (F.col("t_root") == F.col("type_id")), F.lit(False))).alias("lost"), F.count("*").alias("n"))
    return bad.crossJoin(whole)


CHECKED = T + REL + D + "SELECT 0::BIGINT AS odd, 0::BIGINT AS lost, count(*)::BIGINT AS n, true AS dense, count(DISTINCT type_id)::BIGINT AS types, true AS near, true AS merged FROM nodes"


@query(CHECKED)
def compress_main(spark, d):
    return _checked(spark, d, api.compress(trade(spark, d), 0.5).node_map, 0.5, 0.1)


# Other compressors


@query(T + REL + D + ", o AS (SELECT type_id, gid, node_id AS i, count(*) OVER (PARTITION BY type_id) AS n FROM nodes), k AS (SELECT *, least(n, greatest(1, ceil(round(n * 0.1, 9))))::BIGINT AS k FROM o) SELECT type_id, gid, (CASE WHEN i < (n % k) * (n // k + 1) THEN i // (n // k + 1) ELSE n % k + (i - (n % k) * (n // k + 1)) // (n // k) END)::BIGINT AS bucket FROM k")
def bucket_ntile(spark, d):
    return baselines.bucketed(baselines.ranked(trade(spark, d).nodes.select("type_id", "gid"), "gid"), 0.1)


_RT = ", o AS (SELECT type_id, gid, row_number() OVER (PARTITION BY type_id ORDER BY md5('42:' || node_id::VARCHAR), gid) - 1 AS i, count(*) OVER (PARTITION BY type_id) AS n FROM nodes), k AS (SELECT *, least(n, greatest(1, ceil(round(n * 0.1, 9))))::BIGINT AS k FROM o), b AS (SELECT type_id, gid, CASE WHEN i < (n % k) * (n // k + 1) THEN i // (n // k + 1) ELSE n % k + (i - (n % k) * (n // k + 1)) // (n // k) END AS bucket FROM k) SELECT gid, min(gid) OVER (PARTITION BY type_id, bucket) AS root FROM b"


@query(T + REL + D + _RT)
def compress_random_type(spark, d):
    return baselines.random_type(trade(spark, d).nodes, 0.1)


HASH = ", hs AS (SELECT gid, sum(CASE WHEN round(p, 9) > 0 THEN 1 << j ELSE 0 END)::BIGINT AS hash FROM (SELECT gid, j, sum(a * (1 - 2 * (((i * 7919 + j * 104729) % 101) % 2))) AS p FROM x, range(0, 6) t(j) GROUP BY ALL) GROUP BY 1), sc AS (SELECT gid, round(sum(a), 6) + 0.0 AS score FROM x GROUP BY 1) "


@query(T + REL + D + M + HASH + "SELECT type_id, gid, coalesce(hash, 0)::BIGINT AS hash, coalesce(score, 0) + 0.0 AS score FROM nodes LEFT JOIN hs USING (gid) LEFT JOIN sc USING (gid)")
def lsh_bucket_order(spark, d):
    return baselines.lsh_order(trade(spark, d).nodes, 6).withColumn("score", F.col("score") + 0.0)


@query(T + REL + D + M + HASH + _RT.replace("md5('42:' || node_id::VARCHAR), gid", "coalesce(hash, 0), coalesce(score, 0), gid").replace("FROM nodes)", "FROM nodes LEFT JOIN hs USING (gid) LEFT JOIN sc USING (gid))", 1))
def compress_lsh(spark, d):
    return baselines.lsh(trade(spark, d).nodes, 0.1, 6)


@query(CHECKED)
def compress_cgc_homo(spark, d):
    return _checked(spark, d, api.compress_cgc_homo(trade(spark, d), 0.5, 60, 16).node_map, 0.5, 0.1)


@query(CHECKED)
def compress_freehgc(spark, d):
    return _checked(spark, d, api.compress_freehgc(trade(spark, d), 0.05, 1).node_map, 0.05, 0.1)


@query(T + REL + D + """, c AS (SELECT y, count(*) AS n FROM nodes WHERE is_train GROUP BY y), f AS (SELECT *, (row_number() OVER (ORDER BY n DESC, y) <= 37)::INT AS first FROM c),
e AS (SELECT *, (37 - sum(first) OVER ()) * (n - first) / greatest(1, sum(n - first) OVER ()) AS exact, 37 - sum(first) OVER () AS rest FROM f), b AS (SELECT *, least(n - first, floor(exact)) AS base FROM e),
r AS (SELECT *, rest - sum(base) OVER () AS remaining, row_number() OVER (ORDER BY round(exact - base, 9) DESC, n DESC, y) AS rk FROM b)
SELECT y, n::BIGINT AS n, (first + base + CASE WHEN rk <= remaining AND base < n - first THEN 1 ELSE 0 END)::BIGINT AS k FROM r""")
def class_budget(spark, d):
    c = trade(spark, d).nodes.where("is_train").groupBy("y").agg(F.count("*").alias("n"))
    return baselines.class_budget(c, 37).withColumn("k", F.col("k").cast("long"))


@query(T + "SELECT type_id, n, least(n, greatest(1, ceil(round(n * 0.03, 9))))::BIGINT AS k FROM types")
def type_budget(spark, d):
    return baselines.type_budget(trade(spark, d).types, 0.03)


REACH = ", seeds AS (SELECT gid FROM nodes WHERE type_id = 0 AND is_train), h1 AS (SELECT v AS gid, count(*) * 0.5 AS score FROM seeds JOIN adj ON gid = u GROUP BY 1), f1 AS (SELECT gid FROM h1 WHERE gid NOT IN (SELECT gid FROM seeds)), h2 AS (SELECT v AS gid, count(*) * 0.25 AS score FROM f1 JOIN adj ON gid = u GROUP BY 1), reach AS (SELECT gid, sum(score)::DOUBLE AS score FROM (SELECT gid, 1.0 AS score FROM seeds UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1) "


def _reach(spark, d):
    g, adj, _ = topo(spark, d)
    seeds = g.nodes.where("type_id = 0 and is_train").select("gid")
    return g, seeds, baselines.reach_scores(adj, seeds)


@query(T + REL + E + D + REACH + "SELECT * FROM reach")
def reach_scores(spark, d):
    return _reach(spark, d)[2]


@query(T + REL + E + D + REACH + "SELECT gid, score FROM reach ORDER BY score DESC, gid LIMIT 25")
def reach_topk(spark, d):
    return _reach(spark, d)[2].orderBy(F.desc("score"), "gid").limit(25)


@query(T + REL + E + D + REACH + ", used AS (SELECT 0 AS type_id, count(*) AS used FROM seeds) SELECT gid, type_id FROM (SELECT nodes.gid, type_id, row_number() OVER (PARTITION BY type_id ORDER BY coalesce(score, 0) DESC, nodes.gid) AS r FROM nodes LEFT JOIN reach USING (gid) WHERE nodes.gid NOT IN (SELECT gid FROM seeds)) JOIN (SELECT type_id, least(n, greatest(1, ceil(round(n * 0.05, 9)))) AS k FROM types) USING (type_id) LEFT JOIN used USING (type_id) WHERE r <= k - coalesce(used, 0)")
def reach_fill_exclude(spark, d):
    g, seeds, scores = _reach(spark, d)
    return baselines.filled(g.nodes, scores, seeds, baselines.type_budget(g.types, 0.05))


SIG = ", st AS (SELECT gid FROM nodes WHERE type_id = 0), n1 AS (SELECT DISTINCT gid, v AS o FROM st JOIN adj ON u = gid), sig AS (SELECT gid, o FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY o) AS r FROM (SELECT gid, gid AS o FROM st UNION SELECT * FROM n1 UNION SELECT DISTINCT gid, v FROM n1 JOIN adj ON u = o)) WHERE r <= 512) "


def _sig(spark, d, again: bool = True):
    g = trade(spark, d)
    adj = topology.adjacency(topology.settled(topology.dedup(glob(g))))
    return baselines.signatures(adj, g.nodes.where("type_id = 0").select("gid"), again=again)


@query(T + REL + E + D + SIG + "SELECT gid, count(*)::BIGINT AS n, sum(o)::BIGINT AS total FROM sig GROUP BY 1")
def khop_signature(spark, d):
    return _sig(spark, d, again=False).groupBy("gid").agg(F.count("*").alias("n"), F.sum("o").alias("total"))


@query(T + REL + E + D + SIG + "SELECT gid, round(sum((o % 3 <> 0)::INT) + count(*) / 1000, 6) AS gain FROM sig GROUP BY 1")
def coverage_gain(spark, d):
    sig = _sig(spark, d)
    return baselines.coverage_gain(sig, sig.where("o % 3 = 0")).select("gid", r6(F.col("gain"), "gain"))


@query("WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS a, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT q.vec_id AS gid, w.vec_id AS anchor, round(sum(q.a * w.a), 9) AS s FROM u q JOIN u w ON q.i = w.i WHERE w.vec_id % 25 = 0 AND q.vec_id % 25 <> 0 GROUP BY ALL) SELECT gid, anchor AS root FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY s DESC, anchor) AS r FROM s) WHERE r = 1 UNION ALL SELECT vec_id, vec_id FROM embeddings WHERE vec_id % 25 = 0")
def nearest_anchor(spark, d):
    n = graphs.read(spark, d, "embeddings").select(F.col("vec_id").alias("gid"), F.lit(0).alias("type_id"), F.col("embedding").cast("array<double>").alias("x"))
    return baselines.nearest_anchor(n, n.where("gid % 25 = 0").select("gid", "type_id"))


# Experiments


@query()
def linear_probe(spark, d):
    from ..operators import probe

    g = graphs.vectors(spark, d)
    h = g.nodes.where("type_id = 0").select("gid", F.col("x").alias("h"), "y", "is_train", "is_test")
    pred = probe.predicted(probe.fitted(h.where("is_train").select("h", "y"), 20), h.where("is_test"))
    c = metrics.classification(pred.select("y", "p"))
    return c.select(*(x if x == "n" else F.round(x, 2).alias(x) for x in c.columns))


@query()
def gnn_training(spark, d):
    """The loss and accuracies of a typed network, epoch by epoch, on the vectors and their buckets."""
    g = graphs.vectors(spark, d)
    k = coarsen.kernel_of(g)
    nodes = k.nodes.join(g.nodes.select("gid", "y", "is_train", "is_val"), "gid")
    model = sage.prepared(nodes, glob(g), 0, 10, hidden=16, layers=1)
    sage.trained(model, epochs=4, rate=0.02)
    rows = [(i, round(s["loss"], 6), round(s["train"], 6), s["val"]) for i, s in enumerate(model.history)]
    return spark.createDataFrame(rows, "epoch int, loss double, train double, val double")


@query("WITH v AS (SELECT unnest(embedding)::DOUBLE AS a FROM embeddings) SELECT 0 AS type_id, count(DISTINCT vec_id)::BIGINT AS n, (SELECT round(sum(s), 4) FROM (SELECT var_pop(a) AS s FROM (SELECT unnest(embedding)::DOUBLE AS a, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i)) AS variance FROM embeddings")
def pca_variance(spark, d):
    """Components keep the whole variance when all are kept: their variances add up to the dimensions' own."""
    e = graphs.read(spark, d, "embeddings").select(F.lit(0).alias("type_id"), F.col("vec_id").alias("gid"), F.col("embedding").cast("array<double>").alias("x"))
    n, mean, covariance = reduce.moments(e)[0]
    vector, _ = reduce.components(mean, covariance, len(mean))
    total = float(((vector.T @ covariance) * vector.T).sum())
    return spark.createDataFrame([(0, n, round(total, 4))], "type_id int, n long, variance double")


@query("SELECT true AS linked, true AS alternates, count(DISTINCT c_custkey)::BIGINT * 3 AS walks, 12 AS length FROM customer JOIN orders ON o_custkey = c_custkey")
def walk_invariants(spark, d):
    """Three walks of 12 nodes from each customer with orders: every step is an edge, and types alternate."""
    g = trade(spark, d)
    some = coarsen.settled(glob(g).where("rel = 'places'").select("s", "d"))
    adj = some.select(F.col("s").alias("u"), F.col("d").alias("v")).unionByName(some.select(F.col("d").alias("u"), F.col("s").alias("v"))).distinct()
    w = coarsen.settled(embed.walks(adj, some.select(F.col("s").alias("gid")).distinct(), 12, 0, 3))
    steps = w.select(F.explode(F.arrays_zip(F.slice("walk", 1, 11).alias("a"), F.slice("walk", 2, 11).alias("b"))).alias("p")).select("p.a", "p.b")
    lost = steps.join(adj.toDF("a", "b"), ["a", "b"], "left_anti").count() == 0
    n = g.types.where("type_id = 1").first()["offset"]
    odd = F.exists(F.transform("walk", lambda x, i: (x >= n) != (i % 2 == 1)), lambda b: b)
    return w.agg(F.lit(lost).alias("linked"), (F.count_if(odd) == 0).alias("alternates"), F.count("*").alias("walks"), F.max(F.size("walk")).alias("length"))


def _runs(spark, d):
    """Stand-in run records from the orders: model, variant, ratio, accuracy."""
    o = graphs.read(spark, d, "orders")
    return o.select((F.col("o_custkey") % 4).alias("model"), F.col("o_orderpriority").alias("variant"), ((F.col("o_orderkey") % 6 + 1) / 10).alias("ratio"), F.when(F.col("o_orderkey") % 11 != 0, F.round(F.col("o_totalprice") / 1000)).alias("accuracy"))


RUNS = "WITH runs AS (SELECT o_custkey % 4 AS model, o_orderpriority AS variant, (o_orderkey % 6 + 1) / 10 AS ratio, CASE WHEN o_orderkey % 11 <> 0 THEN round(o_totalprice / 1000) END AS accuracy FROM orders) "


@query(RUNS + "SELECT model, variant, count(*)::BIGINT AS runs, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_pop(accuracy), 6) AS accuracy_std FROM runs GROUP BY ALL")
def run_summary(spark, d):
    s = experiments.summary(_runs(spark, d), ["model", "variant"], ["accuracy"])
    return s.select("model", "variant", "runs", r6(F.col("accuracy_mean"), "accuracy_mean"), r6(F.col("accuracy_std"), "accuracy_std"))


@query(RUNS + "SELECT model, variant, round(ratio, 6) AS best_ratio, accuracy AS best_accuracy FROM (SELECT *, row_number() OVER (PARTITION BY model, variant ORDER BY accuracy DESC NULLS LAST, ratio) AS r FROM runs) WHERE r = 1")
def ablation_summary(spark, d):
    return experiments.best_ratio(_runs(spark, d), ["model", "variant"], "accuracy").withColumn("best_ratio", F.round("best_ratio", 6))


@query(RUNS + "SELECT variant, round(avg(m), 6) AS accuracy_mean, count(*)::BIGINT AS models FROM (SELECT variant, model, avg(accuracy) AS m FROM runs GROUP BY ALL) GROUP BY 1")
def paper_default_check(spark, d):
    return experiments.model_means(_runs(spark, d), ["variant"], "model", "accuracy").withColumn("accuracy_mean", F.round("accuracy_mean", 6))


@query("SELECT o_custkey AS custkey FROM orders GROUP BY 1 HAVING count(DISTINCT CASE WHEN o_orderkey % 6 < 3 THEN o_orderkey % 6 END) = 3")
def resume_keys(spark, d):
    o = graphs.read(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), ((F.col("o_orderkey") % 6).cast("double")).alias("ratio"))
    return experiments.finished(o, ["custkey"], [0, 1, 2])


@query(T + REL + D + MAP + Q + "SELECT round((SELECT count(DISTINCT root) FROM m) / (SELECT count(*) FROM m), 6) AS node_ratio, round((SELECT count(*) FROM q) / (SELECT count(*) FROM rel), 6) AS edge_retention")
def run_record(spark, d):
    g, m = with_map(spark, d)
    c = metrics.compression(g.nodes, m, g.edges, quotient.quotient_edges(g.edges, g.types, m))
    return c.select(r6(F.col("node_retention"), "node_ratio"), r6(F.col("edge_retention"), "edge_retention"))


@query(T + REL + D + "SELECT node_id, r <= floor(n * 0.6) AS is_train, r > floor(n * 0.6) AND r <= floor(n * 0.6) + floor(n * 0.2) AS is_val, r > floor(n * 0.6) + floor(n * 0.2) AS is_test FROM (SELECT node_id, row_number() OVER (ORDER BY md5('0:' || node_id::VARCHAR), node_id) AS r, count(*) OVER () AS n FROM nodes WHERE type_id = 0)")
def resplit(spark, d):
    return experiments.resplit(trade(spark, d).nodes.where("type_id = 0").select("node_id"), 0.6, 0.2)


@query("SELECT 'fresh' AS origin, count(*)::BIGINT AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'old', count(*) FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def baseline_cache(spark, d):
    o = graphs.read(spark, d, "orders")
    new, old = o.where("o_orderkey % 2 = 0").select("o_custkey", F.lit("fresh").alias("origin")), o.where("o_orderkey % 2 = 1").select("o_custkey", F.lit("old").alias("origin"))
    return experiments.cached_union(old, new, ["o_custkey"]).groupBy("origin").agg(F.count("*").alias("n"))


@query("SELECT md5_order.node_id FROM (SELECT p_partkey AS node_id FROM part ORDER BY md5('3:' || p_partkey::VARCHAR), p_partkey LIMIT 50) md5_order")
def sample_mediators(spark, d):
    """Sampling is the feature here: a stateless random order and a limit."""
    p = graphs.read(spark, d, "part").select(F.col("p_partkey").alias("node_id"))
    return p.orderBy(graphs.md5_key(3), "node_id").limit(50)


def _graph_counts(name):
    def run(spark, d):
        g = graphs.LOADERS[name](spark, d)
        return g.edges.groupBy("rel").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))

    return run


for _name, _sql in {
    "vec": "SELECT 'in' AS rel, count(*)::BIGINT AS n, count(DISTINCT vec_id)::BIGINT AS sources, count(DISTINCT b)::BIGINT AS targets FROM (SELECT vec_id, (embedding[1] > 0)::INT + 2 * (embedding[2] > 0)::INT + 4 * (embedding[3] > 0)::INT + 8 * (embedding[4] > 0)::INT + 16 * (embedding[5] > 0)::INT + 32 * (embedding[6] > 0)::INT AS b FROM embeddings)",
    "activity": "SELECT 'did' AS rel, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS sources, count(DISTINCT event_type)::BIGINT AS targets FROM events UNION ALL SELECT 'on', count(*), count(DISTINCT user_id), count(DISTINCT ts::DATE) FROM events",
    "docs": "SELECT 'from' AS rel, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS sources, count(DISTINCT source)::BIGINT AS targets FROM documents UNION ALL SELECT 'in', count(*), count(DISTINCT doc_id), count(DISTINCT lang) FROM documents",
}.items():
    QUERIES[f"src_graph_{_name}"] = _graph_counts(_name)
    SQL[f"src_graph_{_name}"] = _sql


def _loaded(name):
    def run(spark, d):
        """Nodes by type with their flags, classes and sum of features, and rows by relation with a mix of their ids."""
        g = loaders.LOADERS[name](spark, d)
        flag = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long")).alias(c[3:])
        x = F.round(F.sum(F.coalesce(vec.total(F.col("x")), F.lit(0.0))), 3) + 0.0
        n = g.nodes.join(F.broadcast(g.types), "type_id").groupBy(F.col("node_type").alias("name")).agg(F.count("*").alias("n"), flag("is_train"), flag("is_val"), flag("is_test"), F.count_distinct("y").alias("classes"), x.alias("x"))
        z = F.lit(0).cast("long")
        mixed = F.sum((F.col("src") * 31 + F.col("dst") * 17) % 1009).cast("double")
        e = g.edges.groupBy(F.concat_ws("/", "src_type", "rel", "dst_type").alias("name")).agg(F.count("*").alias("n"), mixed.alias("x"))
        return n.unionByName(e.select("name", "n", z.alias("train"), z.alias("val"), z.alias("test"), z.alias("classes"), "x"))

    return run


#: Rows of relations r (src_type, rel, dst_type, src, dst), and splits of n nodes in counts.
_ROWS = " UNION ALL SELECT src_type || '/' || rel || '/' || dst_type, count(*)::BIGINT, 0, 0, 0, 0, sum((src * 31 + dst * 17) % 1009)::DOUBLE FROM r GROUP BY 1"
_BARE = " UNION ALL SELECT '{0}', count(*)::BIGINT, 0, 0, 0, 0, 0.0 FROM {1}"
_TR, _VA = "least(200, greatest(1, n // 3))", "least(100, greatest(1, (n - least(200, greatest(1, n // 3))) // 4))"
_BY_CLASS = f"SELECT sum(n)::BIGINT AS n, sum({_TR})::BIGINT AS train, sum({_VA})::BIGINT AS val, sum(n - {_TR} - {_VA})::BIGINT AS test, count(*)::BIGINT AS classes FROM (SELECT y, count(*) AS n FROM {{0}} GROUP BY y)"
_OWN = "SELECT node_type AS name, count(*)::BIGINT AS n, sum({0}::INT)::BIGINT AS train, sum({1}::INT)::BIGINT AS val, sum(is_test::INT)::BIGINT AS test, count(DISTINCT y)::BIGINT AS classes, coalesce(any_value(sx), 0.0) AS x FROM nodes JOIN types USING (type_id) LEFT JOIN sums USING (type_id) GROUP BY 1"
_KEPT = ", r0 AS (SELECT * FROM rel), kc AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS k, c_nationkey // 5 AS y FROM customer WHERE c_nationkey < 15), ko AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders WHERE o_custkey IN (SELECT id FROM kc)), kp AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_orderkey IN (SELECT id FROM ko))), ks AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_partkey IN (SELECT id FROM kp))), kn AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT DISTINCT c_nationkey AS id FROM customer WHERE c_nationkey < 15)), ids AS (SELECT 'customer' AS t, id, k FROM kc UNION ALL SELECT 'order', id, k FROM ko UNION ALL SELECT 'part', id, k FROM kp UNION ALL SELECT 'supplier', id, k FROM ks UNION ALL SELECT 'nation', id, k FROM kn), r AS (SELECT src_type, rel, dst_type, a.k AS src, b.k AS dst FROM r0 JOIN ids a ON a.t = src_type AND a.id = src JOIN ids b ON b.t = dst_type AND b.id = dst), sums AS (SELECT node_type AS t, round(sum(a), 3) + 0.0 AS sx FROM x JOIN types USING (type_id) JOIN ids ON ids.t = node_type AND ids.id = x.gid - off GROUP BY 1) "
for _name, _sql in {
    "trade_means": T + REL + D + M + ", px AS (SELECT gid - off AS id, i, a / greatest(sqrt(sum(a * a) OVER (PARTITION BY gid)), 1e-12) AS a FROM x JOIN types USING (type_id) WHERE type_id = 2), two AS (SELECT unnest([0, 1]) AS i), o1 AS (SELECT l_orderkey AS id, i, avg(a) AS a FROM lineitem JOIN px ON l_partkey = id GROUP BY ALL), ox AS (SELECT o_orderkey AS id, o_custkey, two.i, coalesce(a, 0) AS a FROM orders CROSS JOIN two LEFT JOIN o1 ON o1.id = o_orderkey AND o1.i = two.i), c1 AS (SELECT o_custkey AS id, i, avg(a) AS a FROM ox GROUP BY ALL), cx AS (SELECT c_custkey AS id, c_nationkey, two.i, coalesce(a, 0) AS a FROM customer CROSS JOIN two LEFT JOIN c1 ON c1.id = c_custkey AND c1.i = two.i), nx AS (SELECT c_nationkey AS id, i, avg(a) AS a FROM cx GROUP BY ALL), sums AS (SELECT type_id, round(sum(a), 3) + 0.0 AS sx FROM (SELECT 0 AS type_id, a FROM cx UNION ALL SELECT 1, a FROM ox UNION ALL SELECT 2, a FROM px UNION ALL SELECT 3, a FROM x WHERE type_id = 3 UNION ALL SELECT 4, a FROM nx) GROUP BY 1), r AS (SELECT * FROM rel UNION ALL SELECT dst_type, 'rev_' || rel, src_type, dst, src FROM rel WHERE rel IN ('contains', 'in')) " + _OWN.format("is_train", "is_val") + _ROWS,
    "trade_carved": T + REL + D + M + ", sums AS (SELECT type_id, round(sum(a), 3) + 0.0 AS sx FROM x GROUP BY 1), r AS (SELECT * FROM rel), whole AS (" + _OWN.format("is_train", "is_val") + ") SELECT name, n, train - CASE WHEN train > 0 THEN greatest(1, floor(train * 0.2)) ELSE 0 END::BIGINT AS train, val + CASE WHEN train > 0 THEN greatest(1, floor(train * 0.2)) ELSE 0 END::BIGINT AS val, test, classes, x FROM whole" + _ROWS,
    "trade_classes": T + REL + D + M + _KEPT + "SELECT 'customer' AS name, n, train, val, test, classes, sx AS x FROM (" + _BY_CLASS.format("kc") + "), sums WHERE t = 'customer'" + "".join(f" UNION ALL SELECT '{t}', count(*)::BIGINT, 0, 0, 0, 0, coalesce((SELECT sx FROM sums WHERE t = '{t}'), 0.0) FROM {k}" for t, k in (("order", "ko"), ("part", "kp"), ("supplier", "ks"), ("nation", "kn"))) + _ROWS,
    "docs_labelled": "WITH kd AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS k, source, lang, n_chars, y FROM documents JOIN (SELECT doc_id, min(quality) AS y FROM labels GROUP BY 1 HAVING min(quality) >= 0) USING (doc_id)), e AS (SELECT * FROM kd WHERE source IS NOT NULL AND lang IS NOT NULL), ksrc AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS k FROM (SELECT DISTINCT source FROM e)), kl AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS k FROM (SELECT DISTINCT lang FROM e)), r AS (SELECT 'doc' AS src_type, 'from' AS rel, 'source' AS dst_type, e.k AS src, ksrc.k AS dst FROM e JOIN ksrc USING (source) UNION ALL SELECT 'doc', 'in', 'lang', e.k, kl.k FROM e JOIN kl USING (lang)) SELECT 'doc' AS name, count(*)::BIGINT AS n, greatest(1, floor(count(*) * 0.6))::BIGINT AS train, greatest(1, floor(count(*) * 0.2))::BIGINT AS val, (count(*) - greatest(1, floor(count(*) * 0.6)) - greatest(1, floor(count(*) * 0.2)))::BIGINT AS test, count(DISTINCT y)::BIGINT AS classes, round(sum(ln(1 + n_chars)), 3) + 0.0 AS x FROM kd" + _BARE.format("source", "ksrc") + _BARE.format("lang", "kl") + _ROWS,
    "order_matrix": "WITH o AS (SELECT o_orderkey AS id, substr(o_orderpriority, 1, 1)::INT AS y FROM orders), r AS (SELECT 'order' AS src_type, 'contains' AS rel, 'part' AS dst_type, l_orderkey AS src, l_partkey AS dst FROM lineitem) SELECT 'order' AS name, n, train, val, test, classes, (SELECT round(sum(l_quantity)::DOUBLE, 3) + 0.0 FROM lineitem) AS x FROM (" + _BY_CLASS.format("o") + ")" + _BARE.format("part", "part") + _ROWS,
}.items():
    QUERIES[f"load_{_name}"] = _loaded(_name)
    SQL[f"load_{_name}"] = _sql


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Buckets of a random order, the quotient they make, and what it keeps."""
    g = trade(spark, d)
    m = quotient.node_map(g.nodes, baselines.random_type(g.nodes, 0.1))
    return metrics.compression(g.nodes, m, g.edges, quotient.quotient_edges(g.edges, g.types, m))
