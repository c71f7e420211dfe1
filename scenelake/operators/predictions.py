"""Predicted modes: ranking, suppression, ensembles and errors.

``modes``: object_id, mode, model_id, score, x, y; ``truths``: object_id, object_type, tx, ty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenelake.functions.geometry import dist

OBJ = "object_id"


def top_modes(modes: DataFrame, k: int) -> DataFrame:
    """The ``k`` best modes of each object, scores divided by the sum over all of its modes."""
    total = modes.groupBy(OBJ).agg(F.sum("score").alias("total"))
    w = Window.partitionBy(OBJ).orderBy(F.desc("score"), "mode")
    best = modes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(total, OBJ).withColumn("score", F.col("score") / F.col("total")).drop("total")


def softmax(modes: DataFrame, scale: float) -> DataFrame:
    """``p``: softmax of score / scale within each object."""
    w = Window.partitionBy(OBJ)
    e = F.exp((F.col("score") - F.max("score").over(w)) / scale)
    return modes.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e")


def nms(modes: DataFrame, radius: float, n: int) -> DataFrame:
    """Greedy endpoint suppression: ``n`` picks, each the greatest value left; endpoints within
    ``radius`` of a pick become 0 and the pick -1.  Ties go to the smaller mode.

    An object's modes are one small array, so the fold stays in expressions.
    """
    arr = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "mode", "x", "y")))
    grouped = modes.groupBy(OBJ).agg(arr.alias("m"))
    start = F.struct(
        F.transform("m", lambda m: -m["s"]).alias("v"), F.array().cast("array<int>").alias("picks")
    )

    def pick(state, _):
        at = F.array_position(state["v"], F.array_max(state["v"])).cast("int")
        chosen = F.element_at("m", at)

        def left(v, i):
            m = F.get("m", i)
            near = dist(m["x"], m["y"], chosen["x"], chosen["y"]) < radius
            return F.when(i + 1 == at, -1.0).when(near & (v > 0), 0.0).otherwise(v)

        return F.struct(F.transform(state["v"], left).alias("v"), F.concat(state["picks"], F.array(chosen["mode"])).alias("picks"))

    steps = F.sequence(F.lit(1), F.least(F.lit(n), F.size("m")))
    found = grouped.select(OBJ, F.aggregate(steps, start, pick)["picks"].alias("picks"))
    return found.select(OBJ, F.posexplode("picks").alias("rank", "mode"))


def errors(modes: DataFrame, truths: DataFrame) -> DataFrame:
    """Endpoint error of every mode."""
    both = modes.join(truths, OBJ)
    return both.withColumn("fde", dist(F.col("x"), F.col("y"), F.col("tx"), F.col("ty")))


def best_by(df: DataFrame, value: str, *ties: str) -> DataFrame:
    """The row of each object with the least ``value``, ties by the other columns."""
    key = F.struct(value, *ties)
    return df.groupBy(OBJ).agg(F.min(key).alias("b")).select(OBJ, "b.*")
