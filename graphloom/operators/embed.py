"""Training-free node embeddings by propagation over relations, and the forward passes of simple graph networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import added, normalized, padded, scaled, sign_projection
from ..schema import named_relations, numbered_relations
from .ranks import ranked
from .skipgram import skip_gram
from .sums import vectors_by, width
from .tables import settled


def vector_mean(df: DataFrame, keys: list[str], col: str = "x", weight: str | None = None, total: bool = False, dim: int | None = None) -> DataFrame:
    """(keys, col): element-wise mean (weighted: sum w x / max(1, sum w); or the sum) of array columns."""
    return vectors_by(df, keys, col, "sum" if total else "mean", weight, dim=dim)


def start(nodes: DataFrame, dim: int) -> DataFrame:
    """(gid, h): features padded with zeros or projected to ``dim``, normalised; null where a type has none."""
    x = F.col("x")
    return nodes.select("gid", F.when(x.isNotNull(), normalized(F.when(F.size(x) <= dim, padded(x, dim)).otherwise(sign_projection(x, dim)))).alias("h"))


def by_number(g: DataFrame) -> DataFrame:
    """(s, d, rel_no): edges with their relation's number, which one pass over the relations gives; made once for several hops."""
    return (g if "rel_no" in g.columns else numbered_relations(g)[0]).select("s", "d", "rel_no")


def propagated(h: DataFrame, g: DataFrame, dim: int | None = None) -> DataFrame:
    """(gid, p): mean over relations of the in-neighbour means; parallel edges count. Nodes without h send nothing."""
    dim = width(h, "h") if dim is None else dim
    sent = by_number(g).join(h.where("h is not null").withColumnRenamed("gid", "s"), "s").select("d", "rel_no", F.col("h").alias("x"))
    per = vector_mean(sent, ["d", "rel_no"], dim=dim)
    return vector_mean(per, ["d"], dim=dim).select(F.col("d").alias("gid"), F.col("x").alias("p"))


def fast_embed(nodes: DataFrame, g: DataFrame, hops: int = 2, dim: int = 4) -> DataFrame:
    """Per hop: h <- normalize(h + propagated), or normalize(propagated) for nodes that have no h yet."""
    h, g = start(nodes, dim), by_number(g) if hops else g
    for turn in range(hops):
        h = settled(h) if turn else h  # read twice in a hop
        h = h.join(propagated(h, g, dim), "gid", "left").select("gid", F.when(F.col("p").isNull(), F.col("h")).when(F.col("h").isNull(), normalized(F.col("p"))).otherwise(normalized(added(F.col("h"), F.col("p")))).alias("h"))
    return h


def relation_signature(nodes: DataFrame, g: DataFrame) -> DataFrame:
    """(gid, rel_key, side, n): how often a node is source (side 0) or destination (side 1) of each relation."""
    g, relations = numbered_relations(g)
    counts = slot_counts(g).withColumns({"rel_no": F.expr("slot div 2").cast("int"), "side": (F.col("slot") % 2).cast("int")})
    return named_relations(counts, relations).select("gid", F.concat_ws("/", "src_type", "rel", "dst_type").alias("rel_key"), "side", "n")


def slot_counts(g: DataFrame) -> DataFrame:
    """(gid, slot, n): how often a node is source (slot 2 * rel_no) or destination (2 * rel_no + 1) of each relation."""
    slot = F.col("rel_no") * 2
    both = g.select(F.col("s").alias("gid"), slot.alias("slot")).unionByName(g.select(F.col("d").alias("gid"), (slot + 1).alias("slot")))
    return both.groupBy("gid", "slot").agg(F.count("*").alias("n"))


def relation_embed(nodes: DataFrame, g: DataFrame, hops: int = 2, dim: int = 4) -> DataFrame:
    """Features and log(1 + signature), propagated both ways along each relation, each channel with its own signs, added
    over the root of the number of channels and restarted from the first vector."""
    g, relations = numbered_relations(g)
    # Channels and slots come in the order of the relations' names joined by slashes.
    order = sorted(range(len(relations)), key=lambda i: "/".join(x for x in relations[i] if x is not None))
    slots = [2 * i + side for i in order for side in (0, 1)]
    g = settled(g.select("s", "d", "rel_no"))  # read again in every hop
    sums = [F.sum(F.when(F.col("slot") == k, F.col("n"))) for k in slots]
    sig = slot_counts(g).groupBy("gid").agg(F.array(*[F.log1p(F.coalesce(c, F.lit(0)).cast("double")) for c in sums]).alias("m")) if slots else g.select(F.col("s").alias("gid"), F.array().cast("array<double>").alias("m")).limit(0)
    none = F.array(*[F.lit(0.0)] * len(slots)).cast("array<double>")
    sig = nodes.select("gid", "x").join(sig, "gid", "left")
    full = F.concat(F.coalesce("x", F.array().cast("array<double>")), F.coalesce("m", none))
    h0 = sig.select("gid", normalized(F.when(F.size(full) <= dim, padded(full, dim)).otherwise(sign_projection(full, dim))).alias("h0"))
    h0 = settled(h0)  # read again in every hop
    h = h0.withColumnRenamed("h0", "h")
    slot = F.col("rel_no") * 2
    ways = g.select(F.col("s").alias("a"), F.col("d").alias("b"), slot.alias("c")).unionByName(g.select(F.col("d").alias("a"), F.col("s").alias("b"), (slot + 1).alias("c")))
    number = F.array(*[F.lit(n) for _, n in sorted((k, n) for n, k in enumerate(slots))]) if slots else F.array(F.lit(0))
    for _ in range(hops):
        per = vector_mean(ways.join(h.withColumnRenamed("gid", "a"), "a").select("b", "c", F.col("h").alias("x")), ["b", "c"], dim=dim)
        signed = per.withColumn("n", F.get(number, F.col("c"))).withColumn("x", F.transform("x", lambda v, i: v * (1 - 2 * (((i * 7919 + F.col("n") * 104729) % 101) % 2))))
        p = vector_mean(signed, ["b"], total=True, dim=dim).select(F.col("b").alias("gid"), scaled(F.col("x"), F.lit(1 / max(1, len(slots)) ** 0.5)).alias("p"))
        h = settled(h0.join(p, "gid", "left").select("gid", normalized(F.when(F.col("p").isNull(), F.col("h0")).otherwise(added(F.col("h0"), F.col("p")))).alias("h")))
    return h


def appnp(h0: DataFrame, g: DataFrame, steps: int = 10, alpha: float = 0.1) -> DataFrame:
    """h <- (1 - alpha) * propagated(h) + alpha * h0."""
    dim, h0 = width(h0, "h"), settled(h0.select("gid", "h"))
    h, g = h0, by_number(g) if steps else g
    for _ in range(steps):
        p = propagated(h, g, dim)
        h = h0.select("gid", F.col("h").alias("h0")).join(p, "gid", "left").select("gid", F.when(F.col("p").isNull(), F.col("h0")).otherwise(F.zip_with("p", "h0", lambda a, b: (1 - alpha) * a + alpha * b)).alias("h"))
        h = settled(h)
    return h


def hop_concat(h: DataFrame, g: DataFrame, hops: int = 2) -> DataFrame:
    """h joined with its propagations of 1 to ``hops`` steps (zeros where nothing arrives)."""
    out, cur = h.withColumn("all", F.coalesce("h", F.array().cast("array<double>"))), h
    g = by_number(g) if hops else g
    for _ in range(hops):
        cur = settled(h.select("gid").join(propagated(cur, g), "gid", "left").select("gid", F.col("p").alias("h")))
        out = out.drop("h").join(cur, "gid").withColumn("all", F.concat("all", F.coalesce("h", F.array().cast("array<double>"))))
    return out.select("gid", F.col("all").alias("h"))


def sage_forward(h: DataFrame, g: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """One untrained layer: relu(mean over relations of (own * A + neighbour mean * B)), A and B being seeded and shipped to
    an Arrow function."""
    import numpy as np
    import pyarrow as pa

    p = h.join(propagated(h, g), "gid", "left").select("gid", "h", F.coalesce("p", scaled(F.col("h"), F.lit(0.0))).alias("p")).where("h is not null and p is not null")

    def layer(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
            y = np.array(b.column(2).to_pylist(), float).reshape(b.num_rows, -1)
            rng = np.random.default_rng(seed)
            w = rng.normal(size=(2, dim, dim)) / dim**0.5
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(np.maximum(x @ w[0] + y @ w[1], 0)), pa.list_(pa.float64()))], names=["gid", "h"])

    return p.mapInArrow(layer, "gid long, h array<double>")


def sampled_neighbours(g: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """At most k in-neighbours for each node and relation, in a stateless random order."""
    g, relations = numbered_relations(g.select("src_type", "rel", "dst_type", "s", "d"))
    pair = g.select("rel_no", "s", "d").distinct()
    key = F.unhex(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("s").cast("string"), F.col("d").cast("string"))))  # bytes sort as their hex digits
    kept = pair.withColumn("r", F.row_number().over(Window.partitionBy("rel_no", "d").orderBy(key, "s"))).where(F.col("r") <= k).drop("r")
    return named_relations(kept, relations)


def walks(adj: DataFrame, starts: DataFrame, length: int, seed: int = 0, per_node: int = 1, every: int = 8) -> DataFrame:
    """(gid, walk): ``per_node`` walks from each start, with steps to a neighbour chosen by a hash of (start, walk, step). The
    neighbours' numbers are written once, and the walks every few steps. Walks from one node spread over its neighbours'
    numbers, so a hub's row isn't one task's work: a step joins by node and number."""
    numbered = ranked(adj.select("u", "v").distinct(), ["u"], ["v"], "i", "n")
    numbered = settled(numbered.select(F.col("u").alias("at"), "i", "v", "n"))
    deg = numbered.where("i = 0").select("at", "n")
    w = starts.select("gid", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("walk_no"), F.col("gid").alias("at"), F.array("gid").alias("walk"))
    for step in range(length - 1):
        key = F.xxhash64("gid", F.lit(seed), F.lit(step)) if per_node == 1 else F.xxhash64("gid", "walk_no", F.lit(seed), F.lit(step))
        pick = w.join(deg, "at").withColumn("i", F.pmod(key, F.col("n"))).drop("n")
        w = pick.join(numbered.select("at", "i", "v"), ["at", "i"]).select("gid", "walk_no", F.col("v").alias("at"), F.concat("walk", F.array("v")).alias("walk"))
        if step % every == every - 1:
            w = settled(w)
    return w.select("gid", "walk")


def word_vectors(spark: SparkSession, walk: DataFrame, dim: int = 16, seed: int = 0) -> DataFrame:
    """Skip-gram vectors of walks (gid as a word)."""
    return skip_gram(walk, dim, seed)


def pca(h: DataFrame, k: int) -> DataFrame:
    """(gid, h) reduced to k dimensions."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = h.select("gid", array_to_vector("h").alias("v"))
    return PCA(k=k, inputCol="v", outputCol="o").fit(v).transform(v).select("gid", vector_to_array("o").alias("h"))


def metapath_embed(graph, g: DataFrame, dim: int = 16, length: int = 50, per_node: int = 5, epochs: int = 5, seed: int = 0) -> DataFrame:
    """(gid, h): skip-gram vectors of walks that go from type A to type B and back, for each pair of linked types that has
    the target's type in it; a node's vectors are concatenated over the pairs, zeros where it isn't in one, and
    normalised. ``per_node`` walks of ``length`` nodes start at each node of A."""
    t = graph.types.where(F.col("node_type") == graph.target).first()["type_id"]
    kinds = sorted({tuple(sorted(r)) for r in g.select("st", "dt").distinct().collect() if t in tuple(r)})  # one for each relation
    out = graph.nodes.select("gid", F.array().cast("array<double>").alias("h"))
    for n, (a, b) in enumerate(kinds):
        some = g.where(((F.col("st") == a) & (F.col("dt") == b)) | ((F.col("st") == b) & (F.col("dt") == a)))
        adj = some.select(F.col("s").alias("u"), F.col("d").alias("v")).unionByName(some.select(F.col("d").alias("u"), F.col("s").alias("v"))).distinct()
        starts = adj.select(F.col("u").alias("gid")).distinct().join(graph.nodes.where(F.col("type_id") == t).select("gid"), "gid")
        own = skip_gram(walks(adj, starts, length, seed + 1000 * n, per_node), dim, seed, epochs).withColumnRenamed("vector", "own")
        out = out.join(own, "gid", "left").select("gid", F.concat("h", F.coalesce("own", F.array_repeat(F.lit(0.0), dim))).alias("h"))
    return out.select("gid", normalized(F.col("h")).alias("h"))


def attention(h: DataFrame, edges: DataFrame, score: Column, value: Column) -> DataFrame:
    """(d, x): the sum of ``value`` over in-edges, weighted by the softmax of ``score`` over each destination's edges.
    ``edges``: (s, d, ...); columns h_s and h_d hold the vectors of both ends."""
    e = edges.join(h.select(F.col("gid").alias("s"), F.col("h").alias("h_s")), "s").join(h.select(F.col("gid").alias("d"), F.col("h").alias("h_d")), "d")
    e = e.withColumns({"score": score, "x": value}).select("d", "score", "x")
    top = e.groupBy("d").agg(F.max("score").alias("top"))  # a hub's edges are never gathered
    e = e.join(top, "d").withColumn("w", F.exp(F.col("score") - F.col("top")))
    part = e.select("d", "w", F.posexplode("x").alias("i", "a")).groupBy("d", "i").agg((F.sum(F.col("w") * F.col("a")) / F.sum("w")).alias("a"))
    return part.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("i", "a")))["a"].alias("x"))


def times(x: Column, m: list[list[float]]) -> Column:
    """x times a small matrix (rows by the places of x)."""
    return F.array(*[sum((x[i] * float(row[j]) for i, row in enumerate(m)), F.lit(0.0)) for j in range(len(m[0]))])


def weights(*shape: int, seed: int) -> list:
    """Seeded normal weights over the root of the first dimension."""
    import numpy as np

    return (np.random.default_rng(seed).normal(size=shape) / shape[0] ** 0.5).tolist()


def gat_forward(h: DataFrame, g: DataFrame, dim: int, out: int = 4, heads: int = 4, seed: int = 0) -> DataFrame:
    """(gid, h): one layer of graph attention: for each head, softmax over in-edges of leaky_relu(a . [W h_s, W h_d]) of
    W h_s; heads are averaged. Weights are seeded; nodes without in-edges are left out."""
    from ..functions.vectors import dot

    total = None
    for head in range(heads):
        w, a = weights(dim, out, seed=seed + 2 * head), weights(2 * out, seed=seed + 2 * head + 1)
        arr = lambda v: F.array(*[F.lit(float(z)) for z in v])
        raw = dot(times(F.col("h_s"), w), arr(a[:out])) + dot(times(F.col("h_d"), w), arr(a[out:]))
        x = attention(h, g.select("s", "d"), F.when(raw > 0, raw).otherwise(0.2 * raw), times(F.col("h_s"), w)).select(F.col("d").alias("gid"), F.transform("x", lambda v: v / heads).alias("x"))
        total = x if total is None else total.join(x.withColumnRenamed("x", "y"), "gid").select("gid", F.zip_with("x", "y", lambda p, q: p + q).alias("x"))
    return total.withColumnRenamed("x", "h")


def hgt_forward(h: DataFrame, g: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """(gid, h): one layer of typed attention: keys, queries and values by the ends' types, a matrix and a weight by
    relation, softmax over all in-edges of a node. Weights are seeded by type and relation."""
    from ..functions.vectors import dot

    rels = [tuple(r) for r in g.select("src_type", "rel", "dst_type").distinct().orderBy("src_type", "rel", "dst_type").collect()]  # one row for each relation
    kinds = {t: i for i, t in enumerate(sorted({x for r in rels for x in (r[0], r[2])}))}
    score = value = F.lit(None)
    for n, (a, rel, b) in enumerate(rels):
        here = (F.col("src_type") == a) & (F.col("rel") == rel) & (F.col("dst_type") == b)
        key, query, val = (times(F.col(x), weights(dim, dim, seed=seed + 100 * j + kinds[t])) for j, (x, t) in enumerate((("h_s", a), ("h_d", b), ("h_s", a))))
        score = F.when(here, dot(times(key, weights(dim, dim, seed=seed + 1000 + n)), query) / dim**0.5).otherwise(score)
        value = F.when(here, times(val, weights(dim, dim, seed=seed + 2000 + n))).otherwise(value)
    return attention(h, g.select("s", "d", "src_type", "rel", "dst_type"), score, value).select(F.col("d").alias("gid"), F.col("x").alias("h"))
