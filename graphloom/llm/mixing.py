"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Each source gets a target of words (weights shared out over the whole, capped at a multiple of the source and reshared).
A source's documents get the whole part of target / size as certain copies; the rest of the target is a sample without
replacement: documents are ranked by random odds divided by inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken from
the smallest rank until the words reach what is left of the target. u comes from the id's hash, so reruns agree.

A hot source never meets in one task: words are first summed by source and 4,096 classes of rank, the class in which
the target is reached is found on those sums and cut into 4,096 parts in the same way, and only the part in which the
target is reached is ranked row by row.

Defined results: null texts have the size 0; texts are counted whole; null sources form one source, last in order; rows of
equal id (or without one) are ordered by a hash of their text, and of rows of equal id and text as many are taken as the
target needs (which ones is open, as they are alike); an empty table gives an empty result. A source without words has the target 0 and is not taken. Other columns pass through unread
under any name; :func:`mixed` replaces those named like its own new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, fresh, written

CLASSES = 4096
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def uniform(id_col: str, seed: int) -> Column:
    """A double in (0, 1) from the md5 of seed:id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long").cast("double") + 0.5) / float(16**12)


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, target, whole, left) from (source, source_size); one row for each source is sorted."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sources.withColumn("w", w).withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (
        s.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("filled", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("i", F.row_number().over(by_fill))
        .withColumn("level", (F.col("total") - F.col("filled")) / F.col("w_left"))
    )
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("i", "level"))).over(every)
    s = s.withColumn("first", first).withColumn("target", F.when(F.col("i") < F.col("first.i"), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("first.level"))))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return s.withColumn("whole", whole).select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"))


def tie(text: Column) -> Column:
    """A number below 2**60 from the md5 of a text, by which rows of one rank are ordered."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def rank_of(id_col: str, seed: int, size_col: str, left_col: str, odds_col: str | None) -> tuple[Column, Column]:
    """A row's rank, and its place among CLASSES ** 2 classes of rank that are of even size where inclusion odds are
    equal. ``odds_col`` multiplies the inclusion probability of a row (1 if null or absent)."""
    share = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.when(F.col(size_col) > 0, F.col(left_col) / F.col(size_col)).otherwise(F.lit(0.0))))
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), share * F.coalesce(F.col(odds_col).cast("double"), F.lit(1.0)))) if odds_col else share
    u = uniform(id_col, seed)
    rank = (u / (1 - u)) / (p / (1 - p))
    even = rank * (share / (1 - share))
    return rank, F.floor(even / (1 + even) * CLASSES * CLASSES).cast("long")


def edge(rows: DataFrame, part: Column) -> DataFrame:
    """The rows of the part of each source in which the target is reached, ``before`` being the words of the parts below.
    Only sums by part are sorted."""
    rows = rows.withColumn("part", part)
    sums = rows.groupBy("source", "left", "before", "part").agg(F.sum("size").alias("n"))
    through = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.col("before") + F.sum("n").over(through)).withColumn("below", F.col("upto") - F.col("n"))
    reached = sums.where((F.col("below") < F.col("left")) & (F.col("n") > 0)).groupBy("source").agg(F.max(F.struct("part", "below")).alias("e")).select(F.col("source").alias("s"), F.col("e.part").alias("p"), F.col("e.below").alias("below"))
    return rows.join(reached, rows["source"].eqNullSafe(reached["s"]) & (rows["part"] == reached["p"])).withColumn("before", F.col("below")).drop("s", "p", "below", "part")


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 17, odds_col: str | None = None) -> DataFrame:
    """The mix's plan: (source, source_size, target, whole, left, cut, some), one row for each source. A document is taken
    ``whole`` times, and once more if its (rank, tie) is at most ``cut`` (null: none); of repeated rows at ``cut`` itself
    only ``some`` are (null: all)."""
    odds = [F.col(odds_col).alias("odds")] if odds_col else []
    sized = written(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), tie(F.col(text_col)).alias("tie"), *odds), "mix_sizes")
    per = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "mix_targets")
    rank, place = rank_of("id", seed, "source_size", "left", "odds" if odds_col else None)
    rows = sized.join(per, sized["source"].eqNullSafe(per["source"])).drop(sized["source"]).withColumns({"rank": rank, "place": place, "before": F.lit(0).cast("long")})
    near = edge(edge(rows, F.expr(f"place div {CLASSES}")), F.col("place")).select("source", "left", "before", F.struct("rank", "tie").alias("key"), "size")
    by_key = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    tied = near.groupBy("source", "left", "before", "key").agg(F.sum("size").alias("n"), F.count("*").alias("k")).withColumn("below", F.col("before") + F.sum("n").over(by_key) - F.col("n"))
    # Rows of one key are of one size. A row is in if that brings the words nearer to the target than stopping before it.
    # If none is, the cut is the lower end, below all of these rows.
    need = F.when(F.col("n") > 0, F.ceil((F.col("left") - F.col("below")) * F.col("k") / F.col("n") - 0.5)).otherwise(F.when(F.col("below") < F.col("left"), F.col("k")).otherwise(0))
    tied = tied.withColumn("need", need.cast("long"))
    last = F.max(F.when(F.col("need") > 0, F.struct("key", F.when(F.col("need") < F.col("k"), F.col("need")).alias("some"))))
    cuts = tied.groupBy("source").agg(last.alias("last"), F.min("key").alias("low"))
    below = F.struct((F.col("low.rank") * (1 - 2.0**-52)).alias("rank"), F.col("low.tie").alias("tie"))
    cuts = cuts.select(F.col("source").alias("s"), F.coalesce("last.key", below).alias("cut"), F.col("last.some").alias("some"))
    out = written(per.join(cuts, per["source"].eqNullSafe(cuts["s"]), "left").drop("s"), "mix_plan")
    dropped(sized, per)
    return out


def taken(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], cap: int, seed: int, odds_col: str | None) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the plan's columns and ``copies`` under names that ``df`` doesn't have, and those names. The plan is
    joined by Spark's choice, by size (one row for each source). Texts are hashed at the cut's rank only."""
    p = plan(df, id_col, text_col, source_col, weights, cap, seed, odds_col)
    split = not p.where("some is not null").isEmpty()
    new = [*p.columns, "copies", "at", "part", "i"]
    name = dict(zip(new, fresh(df.columns, *new), strict=True))
    p = p.toDF(*(name[c] for c in p.columns))
    rank, _ = rank_of(id_col, seed, name["source_size"], name["left"], odds_col)
    cut, some, whole = F.col(name["cut"]), F.col(name["some"]), F.col(name["whole"])
    inside = F.when(rank < cut["rank"], True).when(rank == cut["rank"], tie(F.col(text_col)) <= cut["tie"])
    rows = df.join(p, df[source_col].eqNullSafe(p[name["source"]]))
    every = rows.withColumn(name["copies"], whole + F.coalesce(inside.cast("long"), F.lit(0)))
    if not split:
        return every, name
    shared = F.coalesce(some.isNotNull() & F.when(rank == cut["rank"], tie(F.col(text_col)) == cut["tie"]), F.lit(False))
    return every.where(~shared).unionByName(handed_out(rows.where(shared), name)), name


def handed_out(rows: DataFrame, name: dict[str, str]) -> DataFrame:
    """Repeated rows of a source with ``copies``: the first ``some`` of them get one more. They are written with their
    places, and counted by partition, so no task ranks a source's rows."""
    source, at, part, i = (name[c] for c in ("source", "at", "part", "i"))
    flat = written(rows.withColumn(at, F.monotonically_increasing_id()), "mix_tied").withColumn(part, F.shiftrightunsigned(F.col(at), 33))
    earlier = Window.partitionBy(source).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    per = flat.groupBy(source, part).agg(F.count("*").alias("n")).select(F.col(source).alias("s"), F.col(part).alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    placed = flat.withColumn(i, F.row_number().over(Window.partitionBy(source, part).orderBy(at)))
    met = placed.join(per, placed[source].eqNullSafe(per["s"]) & (placed[part] == per["p"]))
    more = (per["earlier"] + F.col(i) <= F.col(name["some"])).cast("long")
    return met.select(*rows.columns, (F.col(name["whole"]) + more).alias(name["copies"]))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 17, odds_col: str | None = None) -> DataFrame:
    """``df`` with __size, __copies and the plan's source_size and target."""
    rows, name = taken(df, id_col, text_col, source_col, weights, cap, seed, odds_col)
    new = {"source_size": F.col(name["source_size"]), "target": F.col(name["target"]), "__copies": F.col(name["copies"]), "__size": n_words(F.col(text_col))}
    return rows.select(*(c for c in df.columns if c.lower() not in new), *(x.alias(n) for n, x in new.items()))


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 17, odds_col: str | None = None) -> DataFrame:
    """The mix itself: rows of ``df`` with its own columns, each as often as it is taken."""
    rows, name = taken(df, id_col, text_col, source_col, weights, cap, seed, odds_col)
    return rows.select(*df.columns, F.explode(F.array_repeat(F.lit(1), F.col(name["copies"]).cast("int"))).alias(name["copies"])).drop(name["copies"])
