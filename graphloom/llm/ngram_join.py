"""N-gram Jaccard join by vertical partitioning, and the components of its links.

A document is the set of hashes of its word shingles. The global order of shingles (that of their hashes) is cut into
fragments. Documents whose sets have d shingles not in common differ in at most d fragments, so a pair within the
threshold, whose sizes bound d, has equal segments in all but d of them: fragments are cut so fine that some non-small
segment must be equal, and equal segments are found by their hash. That finds every pair and hardly any other, and a
passage that many documents share rarely fills a whole segment.

Pairs found are verified by partial overlaps: sets are cut into fragments of the order again, each fragment's overlaps
are counted apart, and the counts are summed for each pair.

Components need no list of all pairs. In each round, each group of equal segments that still spans two components tests
its members against one of them (a star), which is linear in the group; links join components. The centre is the member
that shares most with other components, mostly the text that the others are copies of. After ``stars`` rounds the groups
that still span components are settled exactly: every pair across components that no round has tested and whose sizes
and shared shingles, bounded cell by cell of the order, allow a link; a pair comes out at the smallest signature that it
shares, and large groups are dealt in blocks to many tasks. (A shingle that no other open node has is in no intersection,
so nodes with too many of them link with nothing; they leave the groups at the start, and again before this step.) So no
link between different components is lost, and what comes out of a group of near copies is far below its pairs.

Defined results: null texts and texts without words have no shingles and link with nothing; texts with fewer words than
a shingle are one shingle; texts are read whole, whatever their length; equal sets are one node, whatever the number of
rows; repeated ids are rows of their own; a component's id is its smallest id (null ids count as largest); an empty table
gives an empty result. :func:`clusters` reads no other columns; :func:`representatives` passes them through under any name.
"""

from __future__ import annotations

import gc
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bits_of, components, dropped, fresh, mix, partitions, slices, small_batches, within_bits, written

MASK = 2**64 - 1
ROWS = 8  # fragments in which overlaps are counted
CELLS = 64  # finer fragments in which overlaps are bounded
FINE = 256  # the same, for whole sets of at least as many shingles
HEAD = 8  # a node's smallest signatures, by which a pair is told to be at its smallest shared one
SLICE = 300_000  # characters whose words a Python worker holds at once
KEYS = 500_000  # keys that a task groups at once, up to MOST_PARTS tasks
MOST_PARTS = 2000
BLOCK = 512  # members of a large group that meet those of another block in one task


def shingles(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles (A-Z in lower case, words between ASCII white space)."""
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    flat = [w for ws in words for w in ws]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat))
    total = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for j in range(width):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - width + 1 + j]) if len(total) else total
    total = total.view(np.int64)
    out, at = [], 0
    for ws in words:
        n = len(ws)
        if n >= width:
            s = np.sort(total[at : at + n - width + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=1) - 2**63], np.int64))
        else:
            out.append(np.zeros(0, np.int64))
        at += n
    return out


class Scheme:
    """Size bands and the fragments of each, for one threshold."""

    def __init__(self, percent: int):
        self.percent, self.ends, self.known = percent, [1], {}

    def band(self, n: int) -> int:
        """The band of a size. Each band begins at least 1.4 times above the one before, so linked sizes are in the same
        or in neighbouring bands."""
        while self.ends[-1] <= n or len(self.ends) < 3:
            self.more()
        return bisect_right(self.ends, n) - 1

    def more(self) -> None:
        last = self.ends[-1]
        self.ends.append(max(last + 1, int(last * max(1.4, 100 / self.percent + 0.01)) + 1))

    def fragments(self, g: int) -> tuple[int, int]:
        """(fragments, small segments that a set may leave out) for pairs whose larger set is in band g.

        Such sets a, b have at most d = (|a| + |b|)(100 - p) / (100 + p) shingles not in common. With d + 1 + e fragments
        at least e + 1 segments are equal; a set with at most e small segments (none or one shingle) leaves those out.
        A set with more keeps all of them, and so does a partner that shares them."""
        if g not in self.known:
            while len(self.ends) < g + 2:
                self.more()
            top, low = self.ends[g + 1] - 1, max(1, self.ends[g] * self.percent // 100)
            d = 2 * top * (100 - self.percent) // (100 + self.percent)
            mean = low / (d + 1)
            m = d + 1 + (int(1.6 * (d + 1) * np.exp(-mean) * (1 + mean)) + 1 if d else 0)
            self.known[g] = m, m - d - 1
        return self.known[g]


def segments(s: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Signatures of one set: hashes of (band, fragment, segment)."""
    k, out = scheme.band(len(s)), []
    mixed = mix(s.view(np.uint64))
    value_of = mix(mixed ^ np.uint64(0xA0761D6478BD642F))
    for g in (k, k + 1):
        m, spare = scheme.fragments(g)
        if g > k and len(s) * 100 < scheme.ends[g] * scheme.percent:
            continue  # too small for a link with the next band
        if m - spare <= 1:
            continue  # only equal sets link
        fragment = ((mixed >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        value = np.zeros(m, np.uint64)
        np.add.at(value, fragment, value_of)
        count = np.bincount(fragment, minlength=m)
        keep = np.flatnonzero(count > 1)
        if m - len(keep) > spare:
            keep = np.arange(m)
        out.append(mix(mix(value[keep] + np.uint64(g * 0xE7037ED1A0B428DB & MASK)) + keep.astype(np.uint64)))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


def narrow_of(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, t, n, node), t a hash of the text, without the sets: they are made anew from the texts where needed, which is cheaper than keeping them."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("t", T.LongType()), T.StructField("n", T.LongType()), T.StructField("node", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices(texts, SLICE):
                found = shingles(texts[lo:hi], width)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array([len(x) for x in found], pa.int64()), pa.array([node_of(x) for x in found], pa.int64())], names=["id", "t", "n", "node"])

    return df.select(id_col, text_col, F.xxhash64(text_col).alias("t")).mapInArrow(run, schema)


def node_of(s: np.ndarray) -> int | None:
    """A hash that equal sets share; null for an empty set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None


def ends_of(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct key with its smallest and largest node."""
    order = np.argsort(key)
    key, node = key[order], node[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], *(f.reduceat(node, first) if len(key) else node for f in (np.minimum, np.maximum))


def ends_batch(key: np.ndarray, node: np.ndarray, name: str) -> pa.RecordBatch:
    """(``name``, lo, hi) of :func:`ends_of`; hi is null where it is lo, as for nearly all keys, so that it isn't sent twice."""
    key, lo, hi = ends_of(key, node)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(lo), pa.array(hi, mask=hi == lo)], names=[name, "lo", "hi"])


def ends_by(df: DataFrame, key: str, rows: int) -> DataFrame:
    """(key, lo, hi) over all rows of (key, lo, hi or null), about ``rows`` of them. They were merged where they were made (a key
    that all texts have is one row a slice) and are dealt as they are: most keys are of one text, so that grouping them before they
    are sent would fill a task's memory for nothing."""
    n = max(partitions(df.sparkSession), min(MOST_PARTS, -(-rows // KEYS)))
    return df.repartition(n, key).groupBy(key).agg(F.min("lo").alias("lo"), F.max(F.coalesce("hi", "lo")).alias("hi"))


def signature_ends(df: DataFrame, text_col: str, width: int, percent: int) -> DataFrame:
    """(sig, lo, hi): the upper 48 bits of all signatures with their smallest and largest node, merged by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sig, node in signatures_in(batches, width, percent):
            yield ends_batch(sig >> 16, node, "sig")

    return df.select(text_col).mapInArrow(run, "sig long, lo long, hi long")


def signatures_in(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The signatures of the texts of each slice, and their nodes."""
    scheme = Scheme(percent)
    for b in batches:
        texts = b.column(0).to_pylist()
        for lo, hi in slices(texts, SLICE):
            found = [s for s in shingles(texts[lo:hi], width) if len(s)]
            sig = [segments(s, scheme) for s in found]
            node = np.repeat(np.array([node_of(s) for s in found], np.int64), [len(x) for x in sig])
            yield np.concatenate(sig) if sig else np.zeros(0, np.int64), node


def signatures(df: DataFrame, text_col: str, width: int, percent: int, b_b) -> DataFrame:
    """(sig, node) of the signatures that a broadcast bit filter of their upper 48 bits lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sig, node in signatures_in(batches, width, percent):
            ok = within_bits(b_b.value, sig >> 16)
            yield pa.RecordBatch.from_arrays([pa.array(sig[ok]), pa.array(node[ok])], names=["sig", "node"])

    return df.select(text_col).mapInArrow(run, "sig long, node long")


def sets_of(df: DataFrame, id_col: str, text_col: str, width: int, b_b, whole: bool = False) -> DataFrame:
    """The sets of the rows whose hashed id a broadcast bit filter lets through: (node, n, f, part, fine) by fragments of the
    hashes' own order, fine being :func:`fine_of`, or where ``whole`` (x, lo, hi): shingles with their smallest and largest node, merged by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(within_bits(b_b.value, b.column(0).to_numpy())))
            texts = b.column(1).to_pylist()
            for lo, hi in slices(texts, SLICE):
                sets = [s for s in shingles(texts[lo:hi], width) if len(s)]
                if not sets:
                    continue
                flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
                node = np.array([node_of(s) for s in sets], np.int64)
                if whole:
                    yield ends_batch(flat, np.repeat(node, sizes), "x")
                    continue
                # Sets are sorted, so a fragment is a run.
                f = ((flat.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(61)).astype(np.int64) + ROWS * np.repeat(np.arange(len(sets)), sizes)
                ends = np.cumsum(np.bincount(f, minlength=ROWS * len(sets)))
                part = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, ROWS)), pa.array(np.repeat(sizes, ROWS)), pa.array(np.tile(np.arange(ROWS, dtype=np.int32), len(sets))), part, fine_of(sets)], names=["node", "n", "f", "part", "fine"])

    return df.select(F.xxhash64(id_col).alias("k"), text_col).mapInArrow(run, "x long, lo long, hi long" if whole else "node long, n long, f int, part array<long>, fine array<int>")


def fine_of(sets: list[np.ndarray]) -> pa.ListArray:
    """How many shingles of a set are in each of ``FINE`` cells, on the set's first row; null on its other rows, and for sets of
    fewer shingles, which are not longer than that."""
    big = np.zeros(ROWS * len(sets), bool)
    big[::ROWS] = [len(s) >= FINE for s in sets]
    counts = [np.bincount(s & (FINE - 1), minlength=FINE).astype(np.int32) for s in sets if len(s) >= FINE]
    ends = np.append(0, np.cumsum(big * FINE)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int32)), mask=pa.array(~big))


def freed(spark) -> None:
    """Lets Spark delete the shuffle files of finished steps now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def linked(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b) those within the threshold. ``fragments``: (node, n, f, part), a set's shingles by
    fragment of the order; overlaps are counted for each fragment and summed for each pair. Pairs that sizes rule out, or counts
    by cell where ``fragments`` carry them, meet no sets."""
    pairs = within_sizes(pairs, fragments, percent)
    left = fragments.select(F.col("node").alias("a"), F.col("n").alias("n_a"), "f", F.col("part").alias("p_a"))
    right = fragments.select(F.col("node").alias("b"), F.col("n").alias("n_b"), "f", F.col("part").alias("p_b"))
    partial = pairs.join(left, "a").join(right, ["b", "f"])
    both = partial.groupBy("a", "b").agg(F.sum(F.size(F.array_intersect("p_a", "p_b"))).alias("i"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    return both.where(100 * F.col("i") >= percent * (F.col("n_a") + F.col("n_b") - F.col("i"))).select("a", "b")


def within_sizes(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and, for two large sets, counts by cell allow a link: an intersection has at most the smaller count
    of each cell, whose sum must reach the intersection that the threshold asks for."""
    cells = ["fine"] if "fine" in fragments.columns else []
    whole = fragments.where("f = 0").select("node", "n", *cells)
    of = lambda x: whole.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", *cells)))
    near = pairs.join(of("a"), "a").join(of("b"), "b").where(F.greatest("n_a", "n_b") * percent <= F.least("n_a", "n_b") * 100)
    if cells:
        most = F.aggregate(F.zip_with("fine_a", "fine_b", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
        near = near.where(F.coalesce(most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent, F.lit(True)))
    return near.select("a", "b")


def labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "node", "left").withColumn("c", F.coalesce("root", "node")).drop("root")


def centres(now: DataFrame) -> DataFrame:
    """(sig, hub, hub_c) for each group of ``now`` (sig, node, c) that spans components: the member that meets most nodes
    of other components, over all its groups."""
    part = now.groupBy("sig", "c").count()
    whole = part.groupBy("sig").agg(F.sum("count").alias("all"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("sig", "all")
    others = part.join(whole, "sig").select("sig", "c", (F.col("all") - F.col("count")).alias("others"))
    spanning = now.join(others, ["sig", "c"])
    weight = spanning.groupBy("node").agg(F.sum("others").alias("weight"))
    first = F.min(F.struct(-F.col("weight"), F.xxhash64("node"), "node", "c")).alias("hub")
    return spanning.join(weight, "node").groupBy("sig").agg(first).select("sig", F.col("hub.node").alias("hub"), F.col("hub.c").alias("hub_c"))


def in_cells() -> Column:
    """How many of a group's shingles x are in each cell of the order (by the hashes' lowest bits)."""
    return F.array(*[F.count_if(F.col("x").bitwiseAND(CELLS - 1) == i) for i in range(CELLS)])


def common_of(ends: DataFrame, sizes: DataFrame, percent: int, each: DataFrame | None = None) -> DataFrame:
    """(node, n, common, and with ``each`` (node, x) also that count for each cell) from (x, lo, hi), the smallest and largest
    node of each shingle, and (node, n): how many of a node's shingles another node has too, where that allows a link."""
    cells = each is not None
    more = [in_cells().alias("own_cells")] if cells else []
    own = ends.where("lo = hi").groupBy(F.col("lo").alias("node")).agg(F.count("*").alias("own"), *more)
    got = sizes.join(own, "node", "left").withColumn("common", F.col("n") - F.coalesce("own", F.lit(0))).where(f"100 * common >= {percent} * n")
    if cells:
        got = got.join(each.groupBy("node").agg(in_cells().alias("cells")), "node")
        got = got.withColumn("cells", F.when(F.col("own") > 0, F.zip_with("cells", "own_cells", lambda x, y: x - y)).otherwise(F.col("cells")))
    return written(got.select("node", "n", "common", *["cells"] * cells), "common")


def open_members(now: DataFrame, fragments: DataFrame, percent: int, passes: int = 2) -> tuple[DataFrame, DataFrame]:
    """(sig, node, c, n, common) of the groups that span components, without nodes that can't link with another open node,
    and the last pass's :func:`common_of`. ``common`` counts a node's shingles that another open node has too; an
    intersection can't be larger. Each pass counts anew over the nodes that the one before left."""
    made = []
    for turn in range(passes):
        spans = now.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("sig")
        now = written(now.select("sig", "node", "c").join(spans, "sig", "left_semi"), "open")
        mine = fragments.join(now.select("node").distinct(), "node", "left_semi")
        each = mine.select("node", F.explode("part").alias("x"))
        # Sums are taken before anything is sent, so a shingle that all have is one row of a task.
        ends = each.groupBy("x").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
        common = common_of(ends, mine.where("f = 0").select("node", "n"), percent, each if turn + 1 == passes else None)
        made += [now, common]
        now = now.join(common.drop("cells"), "node")
    now = written(now, "still")
    dropped(*made[:-1])
    return now, common


def pairs_left(still: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of one signature across components whose sizes and common shingles allow a link. A pair comes out at
    the smallest signature that it shares, if that is among the first HEAD of both nodes, else at each shared one. Groups
    are dealt in blocks of about BLOCK members, and each two blocks meet in a task of their own."""
    heads = still.groupBy("node").agg(F.collect_set("sig").alias("sigs")).select("node", F.slice(F.sort_array("sigs"), 1, HEAD).alias("head"))  # a node's signatures are at most its shingles
    blocks = still.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = still.join(heads, "node").join(blocks, "sig").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"p": F.least("block", "o"), "q": F.greatest("block", "o")})
    dealt = written(dealt.select("sig", "p", "q", "block", "node", "c", "n", "common", "head"), "dealt")
    side = lambda x: dealt.select("sig", "p", "q", F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("block", "c", "n", "common", "head")))
    first = F.array_min(F.array_intersect("head_a", "head_b"))
    here = "a < b and c_a <> c_b and least(block_a, block_b) = p and greatest(block_a, block_b) = q"
    sizes = f"least(n_a, n_b) * 100 >= greatest(n_a, n_b) * {percent} and least(common_a, common_b) * {100 + percent} >= (n_a + n_b) * {percent}"
    met = side("a").join(side("b"), ["sig", "p", "q"]).where(f"{here} and {sizes}")
    out = written(met.where(F.coalesce(first == F.col("sig"), F.lit(True))).select("a", "b"), "met")
    dropped(dealt)
    return out


def may_link(pairs: DataFrame, common: DataFrame, percent: int) -> DataFrame:
    """The pairs whose common shingles, bounded cell by cell, are enough for a link. Cells are fragments of the order, so
    the sum of the smaller counts is at least the intersection."""
    of = lambda x: common.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("cells").alias(f"k_{x}"))
    most = F.aggregate(F.zip_with("k_a", "k_b", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    return pairs.join(of("a"), "a").join(of("b"), "b").where(most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent).select("a", "b")


def rooted(df: DataFrame, id_col: str, text_col: str, width: int, percent: int, stars: int) -> DataFrame:
    """(id, t, n, c) for each row of ``df``: its key, its number of shingles and its component. Only the two tables that
    the result reads stay in the shared folder."""
    spark = df.sparkSession
    small_batches(spark)
    send = spark.sparkContext.broadcast
    rows = written(narrow_of(df, id_col, text_col, width), "rows")
    # Signatures that two different sets share, by 48 of their bits; the smallest and largest node tell that without a list
    # of a group's members.
    n = rows.agg(F.sum("n")).first()[0] or 0  # a set has about as many signatures as shingles, or fewer
    shared = written(ends_by(signature_ends(df, text_col, width, percent), "sig", n).where("lo <> hi").select("sig"), "shared")
    freed(spark)
    bits = send(bits_of(shared, "sig"))
    found = signatures(df, text_col, width, percent, bits).distinct()
    members = written(found.join(shared.withColumnRenamed("sig", "__s"), F.shiftright("sig", 16) == F.col("__s"), "left_semi"), "members")
    dropped(shared)
    bits.destroy()
    freed(spark)
    # One row stands for each node's copies: the one of the smallest hashed id.
    stand_in = rows.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.xxhash64("id")).alias("k"), F.min("n").alias("n"))
    stand_in = written(stand_in, "stand_in")
    # Nodes with too many shingles that no other member has are left out before any set is kept.
    bits = send(bits_of(stand_in, "k"))
    n = stand_in.agg(F.sum("n")).first()[0] or 0
    common = common_of(ends_by(sets_of(df, id_col, text_col, width, bits, whole=True), "x", n), stand_in.select("node", "n"), percent)
    freed(spark)
    some = members.join(common, "node", "left_semi")
    spans = some.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("sig")
    some = written(some.join(spans, "sig", "left_semi"), "members")
    dropped(members, common)
    bits.destroy()
    members = some
    freed(spark)
    bits = send(bits_of(stand_in.join(members.select("node").distinct(), "node", "left_semi"), "k"))
    some = sets_of(df, id_col, text_col, width, bits)
    fragments = written(some.dropDuplicates(["node", "f"]), "fragments")
    dropped(stand_in)
    bits.destroy()
    freed(spark)
    roots = df.sparkSession.createDataFrame([], "node long, root long")
    links, tested, made = None, None, []
    for turn in range(stars + 1):
        now = labelled(members, roots)
        if turn < stars:
            pairs = now.join(centres(now), "sig").where("c <> hub_c").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        else:
            still, common = open_members(now, fragments, percent)
            pairs = pairs_left(still, percent)
            made += [still, common, pairs]
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(may_link(pairs, common, percent) if turn == stars else pairs, "pairs")
        made.append(pairs)
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        freed(spark)
        found = written(linked(pairs, fragments, percent), "links")
        made.append(found)
        links = found if links is None else links.unionByName(found)
        if getattr(roots, "written_at", None):
            made.append(roots)
        roots = written(components(links), "roots")
        freed(spark)
    dropped(fragments, members, *made)
    rows = rows.join(roots, "node", "left").withColumn("c", F.coalesce("root", "node"))
    return rows


def clusters(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85, stars: int = 2) -> DataFrame:
    """One row for each row of ``df``: its id, n_shingles and component_id. Two texts link when
    100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles."""
    rows = rooted(df, id_col, text_col, width, percent, stars)
    low = rows.where("n > 0").groupBy("c").agg(F.min("id").alias("low"))
    # A hot component is one row on the right; AQE splits the left side.
    return rows.join(low, "c", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("low", "id").alias("component_id"))


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85, stars: int = 2) -> DataFrame:
    """``df`` without near copies: of each component one row stays, of the smallest id (null ids count as largest), then
    text hash. Rows are told apart by id and text, so other texts under the same id, or under null, stay; texts without
    shingles all stay."""
    rows = written(rooted(df, id_col, text_col, width, percent, stars).where("n > 0").select("id", "t", "c"), "rooted")
    key = F.struct(F.col("id").isNull().alias("none"), "id", "t")
    stay = rows.groupBy("c").agg(F.min(key).alias("stay"))
    i, u, t = fresh(df.columns, "id", "u", "t")
    # A hot component is one row on the right; AQE splits the left side.
    gone = rows.join(stay, "c").where(~key.eqNullSafe(F.col("stay"))).select(F.col("id").alias(i), F.col("t").alias(u)).distinct()
    twice = written(rows.groupBy(F.col("id").alias(i), F.col("t").alias(u)).count().where("count > 1").select(i, u), "twice")
    keyed = df.withColumn(t, F.xxhash64(text_col))
    same = lambda left, right: left[id_col].eqNullSafe(right[i]) & (left[t] == right[u])
    left = keyed.join(gone, same(keyed, gone), "left_anti")
    if twice.isEmpty():
        return left.drop(t)
    again = left.join(twice, same(left, twice), "left_semi")
    # Rows of equal id and equal text: one stays.
    first = again.groupBy(F.col(id_col).alias(i), t).agg(F.min(F.struct(*df.columns)).alias("row")).select("row.*")
    return left.join(twice, same(left, twice), "left_anti").drop(t).unionByName(first)
