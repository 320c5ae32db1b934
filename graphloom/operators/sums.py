"""Sums and means of array columns by group, in one shuffle.

Each place of the arrays is a sum of its own, so groups are summed before the shuffle as numbers are. Arrays wider than
``WIDE`` go through the summarizer of Spark's ML package, whose buffer is a whole vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = 128


def width(df: DataFrame, col: str = "x") -> int:
    """The largest size of the arrays; one number reaches the driver."""
    return int(df.agg(F.max(F.size(col))).first()[0] or 0)


def vectors_by(df: DataFrame, keys: list[str], col: str = "x", how: str = "mean", weight: str | None = None, also: list[Column] = (), dim: int | None = None, least: float = 1.0) -> DataFrame:
    """(keys, col, also...): ``how`` is "mean", "sum" or "var" (population), place by place; with ``weight``, the sum of
    w x ("sum") or that over max(``least``, sum of w) ("mean"). Null arrays don't count. Groups keep their own arrays' size.
    ``also``: aggregates of other columns in the same pass. ``dim``: the largest size, where it is known."""
    rows = df.where(F.col(col).isNotNull())
    dim = width(rows, col) if dim is None else dim
    if dim > WIDE and how != "var":
        return wide(rows, keys, col, how, weight, list(also), least)
    plain = {"mean": F.avg, "sum": F.sum, "var": F.var_pop}
    at = [F.get(F.col(col), F.lit(i)) for i in range(dim)]
    if weight:
        per = [F.sum(a * F.col(weight)) for a in at]
        per = [p / F.greatest(F.lit(least), F.sum(weight)) for p in per] if how == "mean" else per
    else:
        per = [plain[how](a) for a in at]
    names = [f"place_{i}_" for i in range(dim)]
    sums = rows.groupBy(*keys).agg(F.max(F.size(col)).alias("size_"), *(p.alias(n) for p, n in zip(per, names, strict=True)), *also)
    rest = [c for c in sums.columns if c not in (*keys, "size_", *names)]
    made = F.slice(F.array(*names), F.lit(1), F.col("size_")) if names else F.array().cast("array<double>")
    return sums.select(*keys, made.alias(col), *rest)


def wide(rows: DataFrame, keys: list[str], col: str, how: str, weight: str | None, also: list[Column], least: float) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = rows.withColumn("vector_", array_to_vector(col))
    w = [F.col(weight)] if weight else []
    total = Summarizer.sum(F.col("vector_"), *w)
    sums = v.groupBy(*keys).agg(vector_to_array(total).alias("total_"), (F.sum(weight) if weight else F.count("*")).alias("weight_"), *also)
    by = F.greatest(F.lit(least), F.col("weight_")) if weight else F.col("weight_")
    out = F.transform("total_", lambda a: a / by) if how == "mean" else F.col("total_")
    rest = [c for c in sums.columns if c not in (*keys, "total_", "weight_")]
    return sums.select(*keys, out.alias(col), *rest)
