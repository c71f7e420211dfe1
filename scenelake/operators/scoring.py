"""Agent and scene scores, and the splits that follow from them."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.functions.geometry import norm
from scenelake.operators.kinematics import AGENT
from scenelake.operators.pairs import PAIR, both_sides


def individual_features(kin: DataFrame) -> DataFrame:
    """Per agent: greatest speed and absolute acceleration and jerk per axis."""
    most = {c: F.max(F.abs(c)).alias(c) for c in ("acc_x", "acc_y", "jerk_x", "jerk_y")}
    return kin.groupBy(*AGENT).agg(F.max("speed").alias("speed"), *most.values())


def individual_score(f: dict[str, Column]) -> Column:
    """Capped linear sum of an agent's features."""

    def capped(limit: float, x: Column) -> Column:
        return F.least(F.lit(limit), x)

    return (
        capped(10, F.greatest(F.lit(0.0), f["over_limit"]))
        + capped(10, 0.1 * norm(f["acc_x"], f["acc_y"]))
        + capped(10, 0.01 * norm(f["jerk_x"], f["jerk_y"]))
        + capped(10, 0.1 * f["speed"])
        + capped(5, f["anomaly"])
        + capped(7.75, F.sqrt(f["wait"]))
        + 1
        - f["in_lane"]
    )


def interaction_score(f: dict[str, Column]) -> Column:
    """Capped linear sum of a pair's features."""
    caps = {"thw": 2, "scene_mttcp": 4, "mttcp": 4, "ttc": 2}
    out = F.least(F.lit(2.0), f["drac"] / 5) + f["collisions"] + F.least(F.lit(5.0), 0.1 * f["anomaly"])
    for name, cap in caps.items():
        out = out + F.least(F.lit(float(cap)), f[name])
    return out


VARIANTS = ("gt", "fe", "asym", "combined", "asym_combined", "fe_lim")


def own_variants(gt: Column, fe: Column) -> dict[str, Column]:
    """An agent's own score in each variant, from its reported (gt) and completed (fe) track."""
    both = F.greatest(gt, fe)
    return {"gt": gt, "fe": fe, "asym": fe, "combined": both, "asym_combined": both, "fe_lim": gt}


def rekeyed(ordered: DataFrame, value: str) -> DataFrame:
    """Values of ordered pairs put on unordered ones: side0 of (i, j), side1 of (j, i); 0 where a
    pair came in one order only."""
    side = (F.col("i") > F.col("j")).cast("int")
    put = ordered.select("scenario_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), side.alias("side"), value)
    sides = (F.coalesce(F.max(F.when(F.col("side") == s, F.col(value))), F.lit(0.0)).alias(f"side{s}") for s in (0, 1))
    return put.groupBy(*PAIR).agg(*sides)


def pair_variants(pairs: DataFrame) -> DataFrame:
    """(scenario_id, agent_id, other, d_gt, d_fe, variants): both sides of pairs with columns gt, fe,
    lim, side0, side1, d_gt and d_fe.  The agent's own side counts where scores are one-sided."""
    sides = F.explode(
        F.array(
            *(
                F.struct(F.col(me).alias("agent_id"), F.col(it).alias("other"), F.col(side).alias("own"))
                for me, it, side in (("i", "j", "side0"), ("j", "i", "side1"))
            )
        )
    )
    rows = pairs.select("*", sides.alias("s"))
    values = {
        "gt": F.col("gt"), "fe": F.col("fe"), "asym": F.col("s.own"), "combined": F.greatest("gt", "fe"),
        "asym_combined": F.greatest(F.col("gt"), F.col("s.own")), "fe_lim": F.col("lim"),
    }
    return rows.select("scenario_id", "s.agent_id", "s.other", "d_gt", "d_fe", *(v.alias(n) for n, v in values.items()))


def exact_sum(score: str, digits: int = 6) -> Column:
    """Sum of scores of so many decimals, over integers: the same in every order."""
    return F.sum(F.round(F.col(score) * 10**digits).cast("long")) / F.lit(float(10**digits))


def spread(pairs: DataFrame, score: str) -> DataFrame:
    """Each agent's sum of its pairs' scores, both sides."""
    return both_sides(pairs, score).groupBy(*AGENT).agg(F.sum(score).alias(score))


def scene_score(agents: DataFrame) -> DataFrame:
    """Weighted sum over agents by n_target + sqrt(n - n_target); weight 1/(1+d), 1 for targets.

    ``agents``: scenario_id, score, d (null: weight 0), is_target.
    """
    w = F.when(F.col("is_target"), 1.0).otherwise(F.coalesce(1 / (1 + F.col("d")), F.lit(0.0)))
    n, targets = F.count("*"), F.count_if("is_target")
    return agents.groupBy("scenario_id").agg(
        (F.sum(w * F.col("score")) / (targets + F.sqrt(F.greatest(F.lit(0), n - targets).cast("double")))).alias("score")
    )


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """A bucket that depends on the key alone: integer arithmetic, the same everywhere."""
    return F.pmod(F.pmod(key, F.lit(1 << 31)) * 2654435761 + 40503, F.lit(1 << 31)) % buckets


def ranked_values(df: DataFrame, value: str, blocks: int = 1000) -> DataFrame:
    """(value, lo, hi): each different value with the places [lo, hi) of its rows in ascending order.

    Values are counted first; blocks between approximate quantiles, whose number is fixed, are summed
    and then run through block by block, so no task has all values.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    cuts = sorted(set(n.approxQuantile(value, [i / blocks for i in range(1, blocks)], 1 / (4 * blocks))))
    edges = [-math.inf, *cuts, math.inf]
    split = Bucketizer(splits=edges, inputCol=value, outputCol="_b") if len(edges) > 2 else None
    parts = split.transform(n) if split else n.withColumn("_b", F.lit(0.0))
    sums = parts.groupBy("_b").agg(F.sum("_n").alias("_s"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as blocks
    base = sums.select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    hi = F.col("_base") + F.sum("_n").over(inside)
    return parts.join(F.broadcast(base), "_b").withColumn("hi", hi).select(value, (F.col("hi") - F.col("_n")).alias("lo"), "hi")


def percentiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row with the exact percentile of each share, linear between neighbours in order."""
    places = ranked_values(df, value)
    total = F.max("hi").alias("_n")
    n = places.agg(total)

    def at(name: str, share: float, up: int) -> Column:
        place = F.floor((F.col("_n") - 1) * F.lit(share)) + up
        return F.max(F.when((F.col("lo") <= place) & (F.col("hi") > place), F.col(value))).alias(f"{name}_{up}")

    found = places.crossJoin(F.broadcast(n)).groupBy("_n").agg(*(at(m, x, up) for m, x in shares.items() for up in (0, 1)))  # one row

    def between(name: str, share: float) -> Column:
        exact = (F.col("_n") - 1) * F.lit(share)
        low, high = F.col(f"{name}_0"), F.coalesce(f"{name}_1", f"{name}_0")
        return (low + (high - low) * (exact - F.floor(exact))).alias(name)

    return found.select(*(between(m, x) for m, x in shares.items()))


def score_split(scores: DataFrame, percent: float = 0.8) -> DataFrame:
    """Scores above the percentile of all go to test, others to train and val four to one."""
    limit = percentiles(scores, "score", {"limit": percent})
    bucket = hash_bucket(F.col("scenario_id"))
    split = F.when(F.col("score") > F.col("limit"), "test").when(bucket < 80, "train").otherwise("val")
    return scores.crossJoin(F.broadcast(limit)).withColumn("split", split)  # limit: one row
