"""Ranks of large groups without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import settled


def unused(columns: list[str], *names: str) -> list[str]:
    """Names made from ``names`` that none of ``columns`` has in any case."""
    had, tail = {c.lower() for c in columns}, "_"
    while any((n + tail).lower() in had for n in names):
        tail += "_"
    return [n + tail for n in names]


def ranked(df: DataFrame, by: list[str], order: list[Column | str], place: str = "i", count: str | None = None, parts: int | None = None) -> DataFrame:
    """Adds ``place``, each row's rank from 0 in its group of ``by`` in ``order`` (which should leave no ties: rows that tie
    are ranked as they come), and, if named, the group's ``count``.

    Rows are sorted by range, so a large group lies over many partitions; a row's place in its partition, less that of the
    group's first row there, plus the group's rows in earlier partitions, is its rank. Only a count for each partition and
    group is ranked further. The sorted rows are written before their places are read, as ranges are drawn from samples."""
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at, part, first, rows, before = unused([*df.columns, place, count or ""], "at", "part", "first", "rows", "before")
    keys = [*by, *order]
    spread = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys) if keys else df
    flat = settled(spread.withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftrightunsigned(at, 33))
    per = flat.groupBy(*by, part).agg(F.min(at).alias(first), F.count("*").alias(rows))
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = {before: F.coalesce(F.sum(rows).over(earlier), F.lit(0)).cast("long")}
    if count:
        sums[count] = F.sum(rows).over(Window.partitionBy(*by)).cast("long")
    offsets = per.withColumns(sums)
    new = [*by, part]
    names = unused([*flat.columns, *offsets.columns], *(f"k{i}" for i in range(len(new))))
    offsets = offsets.select(*(F.col(c).alias(k) for c, k in zip(new, names, strict=True)), first, before, *([count] if count else []))
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(new, names, strict=True)]
    met = flat.drop(*([place] if place in df.columns else [])).join(offsets, same)
    out = met.withColumn(place, (F.col(at) - F.col(first) + F.col(before)).cast("long"))
    return out.select(*(c for c in df.columns if c not in (place, count)), place, *([count] if count else []))
