"""Near-duplicate vectors by NN-descent.

Equal directions are one node (whatever the number of rows). Every node starts with neighbours from a few orders along
random projections, and the graph is refined: around each node its neighbours and reverse neighbours (both bounded) are
compared with each other, and every node keeps its nearest. Nodes whose lists are saturated, all at or above the
threshold, get longer lists; those whose list still holds links only are compared, as a query set in blocks, with all
nodes, which finds all their links; these are summed and tied tile by tile, so a large group is never listed by pairs. Recall over the other nodes' links
is audited on a bounded set of nodes, compared with all, and on planted pairs: near copies of as many nodes, of cosines
from the threshold to 1, which take part in the search and leave the result. So tables without links are audited too. Where
the target is missed, links are sought along more and more orders; if the last ones miss it as well, all nodes whose links
aren't all known are compared with each other. Kept edges are those with cosine >= threshold in double precision.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do
vectors of different lengths; repeated rows link with each other; equal ids are rows of their own; a component's id is its
smallest id; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, dropped, written

BLOCK = 2048
ASKED = 8192  # nodes of a block or tile


def nodes_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, node, v): a hash of the direction (null where a vector links with nothing) and the unit vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, unit = [], []
            for x in b.column(1).to_pylist():
                v = np.array([np.nan if c is None else c for c in x], float) if x else np.zeros(0)
                norm = 0.0
                if len(v) and np.isfinite(v).all():
                    big = np.abs(v).max()
                    v = v / big if big > 0 else v
                    norm = float(np.sqrt(v @ v))
                if norm > 0:
                    v = v / norm
                    # Directions equal to 12 digits are one node.
                    node.append(xxhash.xxh3_64_intdigest(np.round(v, 12).tobytes()) - 2**63)
                    unit.append(v)
                else:
                    node.append(None)
                    unit.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.int64()), pa.array(unit, pa.list_(pa.float64()))], names=["id", "node", "v"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("node", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
    return df.select(id_col, vector_col).mapInArrow(run, schema)


def by_length(lists) -> dict[int, tuple[list[int], np.ndarray]]:
    """Rows of vectors by their length."""
    out: dict[int, list[int]] = {}
    for i, v in enumerate(lists):
        out.setdefault(len(v), []).append(i)
    return {n: (rows, np.array([lists[i] for i in rows])) for n, rows in out.items()}


def started(nodes: DataFrame, orders: int, width: int, seed: int, bits: int = 12, floor: float = -2.0) -> DataFrame:
    """(u, v, sim): each node with the ``width`` next ones along each of ``orders`` orders, where sim >= ``floor``: sign
    patterns of ``bits`` random projections, then a projection's value. Ranges of an order are read one after the other;
    none is gathered."""
    out = None
    for o in range(orders):

        def keyed(batches, o=o):
            for b in batches:
                lists = b.column(1).to_pylist()
                key, value = np.zeros(len(lists), np.int64), np.zeros(len(lists))
                for n, (rows, x) in by_length(lists).items():
                    r = x @ np.random.default_rng([seed, o, n]).normal(size=(n, bits + 1))
                    key[rows] = ((r[:, :bits] > 0) << np.arange(bits)).sum(1)
                    value[rows] = r[:, bits]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key), pa.array(value)], names=["node", "v", "key", "value"])

        def along(batches, width=width):
            tail_n, tail_v = [], []
            for b in batches:
                names, lists = tail_n + b.column(0).to_pylist(), tail_v + b.column(1).to_pylist()
                fresh = len(tail_n)
                u, w, s = [], [], []
                for rows, x in by_length(lists).values():
                    rows = np.array(rows)
                    for d in range(1, width + 1):
                        if len(rows) > d:
                            sim = np.einsum("ij,ij->i", x[:-d], x[d:])
                            keep = (rows[d:] >= fresh) & (sim >= floor)
                            u.append(rows[:-d][keep])
                            w.append(rows[d:][keep])
                            s.append(sim[keep])
                u, w, s = (np.concatenate(z) if z else np.zeros(0) for z in (u, w, s))
                arr = np.array(names, np.int64)
                u, w = arr[u.astype(int)], arr[w.astype(int)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, w])), pa.array(np.concatenate([w, u])), pa.array(np.concatenate([s, s]))], names=["u", "v", "sim"])
                tail_n, tail_v = names[-width:], lists[-width:]

        ordered = nodes.mapInArrow(keyed, "node long, v array<double>, key long, value double").repartitionByRange("key", "value", "node").sortWithinPartitions("key", "value", "node")
        part = ordered.select("node", "v").mapInArrow(along, "u long, v long, sim double")
        out = part if out is None else out.unionByName(part)
    return out


def nearest(edges: DataFrame, sizes: DataFrame | None, k: int) -> DataFrame:
    """Each node's k nearest (``sizes``: (u, k) where another length holds)."""
    e = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    if sizes is not None:
        e = e.join(sizes, "u", "left")
    limit = F.coalesce(F.col("k"), F.lit(k)) if sizes is not None else F.lit(k)
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return e.withColumn("r", rank).where(F.col("r") <= limit).select("u", "v", "sim")


def refined(graph: DataFrame, nodes: DataFrame, reverse: int) -> DataFrame:
    """Pairs found around each node: its neighbours and at most ``reverse`` reverse neighbours are compared with each
    other; only pairs that beat the end of either list come out."""
    floor = graph.groupBy("u").agg(F.min("sim").alias("floor"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))
    back = graph.withColumn("r", rank).where(F.col("r") <= reverse).select(F.col("v").alias("p"), F.col("u").alias("m"))
    near = graph.select(F.col("u").alias("p"), F.col("v").alias("m")).unionByName(back).distinct()
    members = near.join(nodes.withColumnRenamed("node", "m"), "m").join(floor.withColumnRenamed("u", "m"), "m")
    around = members.groupBy("p").agg(F.collect_list(F.struct("m", "floor", "v")).alias("near"))  # list and reverse list are bounded

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(0)
            flat, off = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
            name, floors = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            lists = flat.field(2)
            voff = lists.offsets.to_numpy()
            values = lists.values.to_numpy()
            size = np.diff(voff)
            us, vs, ss = [], [], []
            for lo, hi in zip(off[:-1], off[1:], strict=True):
                if hi - lo < 2:
                    continue
                for n in np.unique(size[lo:hi]):
                    rows = lo + np.flatnonzero(size[lo:hi] == n)
                    x = values[(voff[rows][:, None] + np.arange(n)).ravel()].reshape(len(rows), n)
                    sim = x @ x.T
                    i, j = np.nonzero((sim > np.minimum(floors[rows][:, None], floors[rows][None, :])) & (np.arange(len(rows))[:, None] < np.arange(len(rows))))
                    us.append(name[rows[i]])
                    vs.append(name[rows[j]])
                    ss.append(sim[i, j])
            u, v, s = (np.concatenate(z) if z else np.zeros(0) for z in (us, vs, ss))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, v]).astype(np.int64)), pa.array(np.concatenate([v, u]).astype(np.int64)), pa.array(np.concatenate([s, s]))], names=["u", "v", "sim"])

    return around.select("near").mapInArrow(compare, "u long, v long, sim double")


def matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of a column of vectors, by their length."""
    lists = column.combine_chunks()
    off, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    size = np.diff(off)
    rows_of = {int(n): np.flatnonzero(size == n) for n in np.unique(size)}
    return {n: (rows, values[off[rows][:, None] + np.arange(n)]) for n, rows in rows_of.items()}


def met(queries: DataFrame, nodes: DataFrame, meet, schema: str) -> DataFrame:
    """What ``meet(queries, nodes)`` makes of each block of query nodes and each tile of nodes. Both hold about ASKED rows
    at most, whatever the number of rows, and each block meets each tile in a task of its own."""
    blocks = max(1, -(-queries.count() // ASKED))
    tiles = max(8, -(-nodes.count() // ASKED))
    cell = lambda block, tile: (F.col(block) * tiles + F.col(tile)).alias("cell")
    named = lambda df: [F.col(c).alias(c) for c in df.columns]  # noqa: E731  (both sides may come from one table)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumns({"b": F.pmod(F.xxhash64("node"), F.lit(blocks)), "t": all_of(tiles)}).select(cell("b", "t"), *named(queries))
    right = nodes.withColumns({"t": F.pmod(F.xxhash64("node"), F.lit(tiles)), "b": all_of(blocks)}).select(cell("b", "t"), *named(nodes))
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(lambda key, q, y: meet(q, y), schema)


def hits(queries: pa.Table, nodes: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of ``queries``, row of ``nodes``, sim) at or above the threshold, in pieces; a node doesn't meet itself."""
    qn, yn, mine = queries.column("node").to_numpy(), nodes.column("node").to_numpy(), matrices(nodes.column("v"))
    for n, (rows, x) in matrices(queries.column("v")).items():
        at, y = mine.get(n, (None, np.zeros((0, n))))
        for a in range(0, len(rows), BLOCK // 2):
            for b in range(0, len(y), BLOCK):
                sim = x[a : a + BLOCK // 2] @ y[b : b + BLOCK].T
                i, j = np.nonzero(sim >= threshold)
                sim, i, j = sim[i, j], rows[a + i], at[b + j]
                other = qn[i] != yn[j]
                yield i[other], j[other], sim[other]


def against_all(queries: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(u, v, sim) for query nodes u and all nodes v at or above the threshold."""

    def meet(queries: pa.Table, nodes: pa.Table) -> pa.Table:
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0)), *hits(queries, nodes, threshold)]
        i, j, sim = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"u": queries.column("node").to_numpy()[i], "v": nodes.column("node").to_numpy()[j], "sim": sim})

    return met(queries.select("node", "v"), nodes.select("node", "v"), meet, "u long, v long, sim double")


class Forest:
    """Components of numbered nodes; of the links given, those that join components come back."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def joined(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept_i, kept_j = [i[:0]], [j[:0]]
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return np.concatenate(kept_i), np.concatenate(kept_j)
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            # Each component that has a smaller neighbour is tied to its smallest one, by one link.
            best = np.full(len(self.label), np.iinfo(np.int64).max)
            np.minimum.at(best, np.maximum(a, b), (np.minimum(a, b) << 32) + np.arange(len(a)))
            tied = np.flatnonzero(best < np.iinfo(np.int64).max)
            parent = np.arange(len(self.label))
            parent[tied] = best[tied] >> 32
            while (parent[parent] != parent).any():
                parent = parent[parent]
            self.label = parent[self.label]
            chosen = best[tied] & 0xFFFFFFFF
            kept_i.append(i[chosen])
            kept_j.append(j[chosen])


def summed(queries: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The links of query nodes with all nodes (node, v, size, asked: whether it is a query too), without a list of them.
    Rows (kind, u, v, w): "sum", rows linked with query u in one tile as w; "tie", links that hold together all that are
    linked in one tile; "link", each link of a node u that is no query."""

    def meet(queries: pa.Table, nodes: pa.Table) -> pa.Table:
        qn, yn = queries.column("node").to_numpy(), nodes.column("node").to_numpy()
        size, asked = nodes.column("size").to_numpy(), nodes.column("asked").to_numpy()
        names, place = np.unique(np.concatenate([qn, yn]), return_inverse=True)
        total, forest, ties, links = np.zeros(len(qn)), Forest(len(names)), [], []
        for i, j, _ in hits(queries, nodes, threshold):
            total += np.bincount(i, size[j], len(qn))
            ties.append(forest.joined(place[i], place[len(qn) + j]))
            links.append((yn[j[~asked[j]]], qn[i[~asked[j]]]))
        some = np.flatnonzero(total)
        tie = [names[np.concatenate([x[k] for x in ties])] if ties else yn[:0] for k in (0, 1)]
        link = [np.concatenate([x[k] for x in links]) if links else yn[:0] for k in (0, 1)]
        kind = ["sum"] * len(some) + ["tie"] * len(tie[0]) + ["link"] * len(link[0])
        w = np.concatenate([total[some], np.zeros(len(tie[0]) + len(link[0]))]).astype(np.int64)
        return pa.table({"kind": pa.array(kind, pa.string()), "u": np.concatenate([qn[some], tie[0], link[0]]).astype(np.int64), "v": np.concatenate([qn[some], tie[1], link[1]]).astype(np.int64), "w": w})

    return met(queries.select("node", "v"), nodes.select("node", "v", "size", "asked"), meet, "kind string, u long, v long, w long")


def among(nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(u, v, sim), u < v or the reverse, for all pairs of ``n`` nodes at or above the threshold: nodes are dealt into
    groups, and each two groups meet once."""
    groups = max(1, -(-n // (4 * BLOCK)))
    dealt = nodes.select("node", "v", F.pmod(F.xxhash64("node"), F.lit(groups)).alias("g"))
    # Each group goes to the cells of its row and column; a cell (i, j) has i <= j.
    cells = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("cell", F.least("g", "o") * groups + F.greatest("g", "o"))

    def meet(frame):
        name, group, cell = frame.column("node").to_numpy(), frame.column("g").to_numpy(), frame.column("cell")[0].as_py()
        first = group == cell // groups
        second = group == cell % groups
        us, vs, ss = [], [], []
        for rows, x in by_length(frame.column("v").to_pylist()).values():
            rows = np.array(rows)
            a, b = first[rows], second[rows]
            left, right, y = name[rows[a]], name[rows[b]], x[b]
            for lo in range(0, len(left), BLOCK):
                sim = x[a][lo : lo + BLOCK] @ y.T
                i, j = np.nonzero(sim >= threshold)
                us.append(left[lo + i])
                vs.append(right[j])
                ss.append(sim[i, j])
        u, v, s = (np.concatenate(z) if z else np.zeros(0) for z in (us, vs, ss))
        other = u != v
        return pa.table({"u": u[other].astype(np.int64), "v": v[other].astype(np.int64), "sim": s[other].astype(float)})

    return cells.groupBy("cell").applyInArrow(meet, "u long, v long, sim double")


def planted(nodes: DataFrame, n: int, threshold: float, seed: int) -> DataFrame:
    """(of, node, v): near copies of ``n`` nodes, of cosines spread over the range from the threshold to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, node, made = [], [], []
            for name, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.array(v)
                draw = np.random.default_rng([seed, name % 2**63])
                away = draw.normal(size=len(v))
                away -= away @ v * v
                if len(v) > 1 and np.sqrt(away @ away) > 1e-6:
                    cos = threshold + (1 - threshold) * draw.uniform(0.01, 0.99)
                    x = cos * v + np.sqrt(1 - cos * cos) * away / np.sqrt(away @ away)
                    of.append(name)
                    node.append(xxhash.xxh3_64_intdigest(f"planted {name}") - 2**63)
                    made.append(x / np.sqrt(x @ x))
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(node, pa.int64()), pa.array(made, pa.list_(pa.float64()))], names=["of", "node", "v"])

    some = nodes.orderBy(F.xxhash64("node", F.lit(seed + 1)), "node").limit(n).select("node", "v")
    return some.mapInArrow(run, "of long, node long, v array<double>")


def completed(known: DataFrame, rest: DataFrame, truth: DataFrame, threshold: float, target: float, seed: int) -> DataFrame:
    """``known`` edges and those of ``rest``, the nodes whose links aren't all known, that the audited target takes.
    ``truth`` has links to be found."""
    rest = written(rest, "rest")
    n = rest.count()
    ends = rest.select("node")
    inside = lambda e: e.join(ends.withColumnRenamed("node", "u"), "u", "left_semi").join(ends.withColumnRenamed("node", "v"), "v", "left_semi")
    want = written(inside(truth), "want")
    seen = want.count()
    for turn in range(5):
        # Both ends may have found it.
        either = known.unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        if want.join(either, ["u", "v"], "left_semi").count() >= target * seen:
            return known
        if turn < 4:
            more = started(rest, 16 << turn, 16, seed + 1000 + turn, bits_for(n), threshold)
            known = written(known.unionByName(more.where(F.col("sim") >= threshold).select("u", "v")).distinct(), "known")
    return known.unionByName(among(rest, n, threshold).select("u", "v"))


def bits_for(n: int) -> int:
    """Sign bits of an order's key: about 8 nodes for each pattern."""
    return max(12, n.bit_length() - 3)


def descend(nodes: DataFrame, threshold: float, k: int, longest: int, rounds: int, target: float, audit: int, orders: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Links at or above the threshold of ``nodes`` (node, v, size): (u, v) for each link of a node u that isn't saturated,
    and for the saturated ones what :func:`summed` makes of theirs."""
    n, sized, real = nodes.count(), nodes, nodes.select("node", "v")
    copies = written(planted(real, audit, threshold, seed), "planted")
    nodes = written(real.unionByName(copies.select("node", "v")), "searched")
    # The start grows with the rows.
    grown = max(0, n.bit_length() - 16)
    graph = written(nearest(started(nodes, orders + 2 * grown, 3 + grown, seed, bits_for(n)), None, k), "graph")
    sizes = None
    # A bounded audit set, compared with all nodes, and the planted pairs.
    asked = written(real.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(audit), "asked")
    pairs = copies.select(F.col("of").alias("u"), F.col("node").alias("v"))
    truth = written(against_all(asked, real, threshold).where(F.col("sim") >= threshold).select("u", "v").unionByName(pairs), "truth")
    for turn in range(rounds):
        before, graph = graph, written(nearest(graph.unionByName(refined(graph, nodes, k)), sizes, k), "graph")
        dropped(before)
        full = graph.groupBy("u").agg(F.count("*").alias("n"), F.min("sim").alias("low"))
        # Saturated: the list is full and all of it at or above the threshold.
        have = full if sizes is None else full.join(sizes, "u", "left")
        limit = F.lit(k) if sizes is None else F.coalesce("k", F.lit(k))
        sizes = written(have.select("u", F.when((F.col("n") >= limit) & (F.col("low") >= threshold), F.least(2 * limit, F.lit(longest))).otherwise(limit).alias("k")).where(F.col("k") > k), "sizes")
        stuck = full.join(sizes.where(F.col("k") >= longest), "u").where((F.col("n") >= longest) & (F.col("low") >= threshold)).select("u")
        if turn >= 2:
            want = truth.join(stuck, "u", "left_anti")
            if want.join(graph, ["u", "v"], "left_semi").count() >= target * want.count():
                break
    # Nodes with nothing below the threshold in their lists may have more links: all nodes are searched for theirs.
    may = written(graph.groupBy("u").agg(F.min("sim").alias("low")).where(F.col("low") >= threshold).select(F.col("u").alias("node")).join(real, "node"), "saturated")
    asks = may.select("node", F.lit(True).alias("asked"))
    every = sized.join(asks, "node", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    sums = written(summed(may, every, threshold), "sums")
    open_ = lambda e: e.join(may.select(F.col("node").alias("u")), "u", "left_anti")
    known = open_(graph.where(F.col("sim") >= threshold).select("u", "v")).unionByName(sums.where("kind = 'link'").select("u", "v"))
    known = written(known.distinct(), "found")
    rest = nodes.join(may.select("node"), "node", "left_anti")
    found = completed(known, rest, truth, threshold, target, seed)
    both = open_(found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    # What was planted goes.
    for end in ("u", "v"):
        both = both.join(copies.select(F.col("node").alias(end)), end, "left_anti")
    links = written(both.select("u", "v"), "near")
    dropped(graph, known, truth, copies, nodes, asked)
    return links, sums


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, k: int = 12, longest: int = 48, rounds: int = 8, target: float = 0.995, audit: int = 512, orders: int = 6, seed: int = 5) -> DataFrame:
    """One row for each row of ``df``: its id, n_links, component_id, kept."""
    rows = written(nodes_of(df, id_col, vector_col), "vectors")
    nodes = written(rows.where("node is not null").groupBy("node").agg(F.min("v").alias("v"), F.count("*").alias("size")), "nodes")
    edges, sums = descend(nodes, threshold, k, longest, rounds, target, audit, orders, seed)
    roots = components(edges.unionByName(sums.where("kind = 'tie'").select("u", "v")), "u", "v")
    size = nodes.select(F.col("node").alias("v"), "size")
    each = edges.join(size, "v").select(F.col("u").alias("node"), "size").unionByName(sums.where("kind = 'sum'").select(F.col("u").alias("node"), F.col("w").alias("size")))
    links = each.groupBy("node").agg(F.sum("size").alias("others"))
    info = nodes.select("node", "size").join(links, "node", "left").join(roots, "node", "left").select("node", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("c"))
    out = rows.select("id", "node").join(info, "node", "left")
    low = out.where("c is not null").groupBy("c").agg(F.min("id").alias("low"))
    return out.join(low, "c", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("low", "id").alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
