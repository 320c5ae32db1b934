"""Downstream quality without training graph networks: propagate, then fit a multinomial logistic regression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fitted(rows: DataFrame, iterations: int = 50):
    """A classifier of (h, y[, weight])."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    w = {"weightCol": "weight"} if "weight" in rows.columns else {}
    return LogisticRegression(featuresCol="v", labelCol="y", maxIter=iterations, regParam=1e-3, family="multinomial", **w).fit(rows.withColumn("v", array_to_vector("h")).withColumn("y", F.col("y").cast("double")))


def predicted(model, rows: DataFrame) -> DataFrame:
    """Adds p."""
    from pyspark.ml.functions import array_to_vector

    out = model.transform(rows.withColumn("v", array_to_vector("h")))
    return out.withColumn("p", F.col("prediction").cast("int")).drop("v", "rawPrediction", "probability", "prediction")


def soft_rows(h: DataFrame, soft: DataFrame) -> DataFrame:
    """A row for each supernode and class, weighted by its share."""
    return h.join(soft, ["type_id", "super_id"]).select("type_id", "super_id", "h", "y", F.col("share").alias("weight"))
