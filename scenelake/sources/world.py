"""Canonical scenario tables derived from the driver's tables.

``tracks`` are integer-centimetre random walks of the users of ``events``: running sums are exact,
so results don't depend on the order of summation.  ``lanes`` come from ``embeddings``, predicted
modes from ``lineitem`` and true endpoints from ``orders``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STEPS = 91
NOW = 10
HZ = 10.0
LANE_POINTS = 32
MAPS = 15
#: Distance of the ids of an agent's scenarios.
LATER = 1 << 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario_id, agent_id, t, x, y, valid): ten agents a scenario, one row per step.

    A scenario has ``STEPS`` steps, so an agent with more events goes on, from its first place, in
    another scenario for every ``STEPS`` of them; ``LATER`` apart, so that ids never meet.
    """
    user = F.col("user_id")
    still = user % 7 == 0
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    place = F.row_number().over(by_user) - 1
    steps = table(spark, sf_dir, "events").select(
        "user_id",
        F.when(still, 0).otherwise(F.pmod(F.round(F.col("value") * 100).cast("long"), F.lit(200)) - 100).alias("dx"),
        F.when(still, 0).otherwise(F.regexp_extract("props", "([0-9]+)", 1).cast("long") - 50).alias("dy"),
        (F.col("event_type") != "error").alias("valid"),
        F.floor(place / STEPS).alias("part"),
        F.pmod(place, F.lit(STEPS)).alias("t"),
    )
    so_far = Window.partitionBy("user_id", "part").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(
        (F.floor(user / 10) + F.col("part") * LATER).alias("scenario_id"),
        user.alias("agent_id"),
        F.col("t").cast("int").alias("t"),
        (((user % 10) * 200 + F.sum("dx").over(so_far)) / F.lit(100.0)).alias("x"),
        (((user % 10) * 100 + F.sum("dy").over(so_far)) / F.lit(100.0)).alias("y"),
        "valid",
    )


def scene_maps(tracks: DataFrame) -> DataFrame:
    """(scenario_id, map_id): the map that each scenario lies on."""
    return tracks.select("scenario_id").distinct().withColumn("map_id", F.col("scenario_id") % MAPS)


def targets(tracks: DataFrame) -> DataFrame:
    """(scenario_id, agent_id) of the agents to predict."""
    return tracks.select("scenario_id", "agent_id").distinct().where(F.col("agent_id") % 10 <= 2)


def with_type(df: DataFrame, agent: str = "agent_id") -> DataFrame:
    """``df`` with object type, length, width and whether the agent is a target."""
    slot = F.col(agent) % 10
    kind = F.when(slot <= 5, "TYPE_VEHICLE").when(slot <= 7, "TYPE_PEDESTRIAN").otherwise("TYPE_CYCLIST")
    return df.select(
        "*",
        kind.alias("object_type"),
        F.when(slot <= 5, 4.5).when(slot <= 7, 0.6).otherwise(1.8).alias("length"),
        F.when(slot <= 5, 2.0).when(slot <= 7, 0.6).otherwise(0.7).alias("width"),
        (slot <= 2).alias("is_target"),
    )


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lane_id, lane_type, limit_mph, exit_lane, map_id)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("lane_id"),
        (F.col("label") % 4).alias("lane_type"),
        (25 + 5 * (F.col("label") % 5)).cast("double").alias("limit_mph"),
        (F.col("vec_id") + 1).alias("exit_lane"),
        (F.col("vec_id") % MAPS).alias("map_id"),
    )


def lane_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lane_id, pt, x, y): 32 points per lane in metres."""
    step = F.round(F.col("e").cast("double") * 1000).cast("long")
    flat = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("lane_id"), F.posexplode("embedding").alias("i", "e")
    )
    steps = flat.groupBy("lane_id", F.floor(F.col("i") / 2).cast("int").alias("pt")).agg(
        F.sum(F.when(F.col("i") % 2 == 0, step)).alias("dx"), F.sum(F.when(F.col("i") % 2 == 1, step)).alias("dy")
    )
    so_far = Window.partitionBy("lane_id").orderBy("pt").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(
        "lane_id",
        "pt",
        (F.sum("dx").over(so_far) / F.lit(100.0)).alias("x"),
        (F.sum("dy").over(so_far) / F.lit(100.0)).alias("y"),
    )


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(object_id, mode, model_id, score, x, y): predicted endpoints, best score first."""
    # named before they are ordered, so that the order's exchange also serves joins by object
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("object_id"), F.col("l_extendedprice").alias("score"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount"
    )
    order = Window.partitionBy("object_id").orderBy(F.desc("score"), "l_partkey", "l_suppkey", "l_linenumber")
    return rows.select(
        "object_id",
        (F.row_number().over(order) - 1).alias("mode"),
        (F.col("l_suppkey") % 5).alias("model_id"),
        "score",
        F.col("l_quantity").alias("x"),
        F.round(F.col("l_discount") * 100).alias("y"),
    )


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(object_id, object_type, tx, ty): true endpoints."""
    slot = F.col("o_custkey") % 3
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("object_id"),
        F.when(slot == 0, "TYPE_VEHICLE").when(slot == 1, "TYPE_PEDESTRIAN").otherwise("TYPE_CYCLIST").alias("object_type"),
        F.pmod(F.floor("o_totalprice"), F.lit(51)).cast("double").alias("tx"),
        F.pmod(F.col("o_custkey"), F.lit(11)).cast("double").alias("ty"),
    )


# The same tables in DuckDB's SQL, as common table expressions.
SQL_TRACKS = """
_e AS (SELECT user_id,
         CASE WHEN user_id % 7 = 0 THEN 0 ELSE CAST(round(value*100) AS BIGINT) % 200 - 100 END AS dx,
         CASE WHEN user_id % 7 = 0 THEN 0 ELSE CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT) - 50 END AS dy,
         event_type <> 'error' AS valid,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
tracks AS (SELECT user_id // 10 + n // 91 * 1099511627776 AS scenario_id, user_id AS agent_id, CAST(n % 91 AS INT) AS t,
         ((user_id % 10)*200 + sum(dx) OVER w)/100.0::double AS x,
         ((user_id % 10)*100 + sum(dy) OVER w)/100.0::double AS y, valid
       FROM _e WINDOW w AS (PARTITION BY user_id, n // 91 ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
SQL_TYPES = """
typed AS (SELECT *, CASE WHEN agent_id % 10 <= 5 THEN 'TYPE_VEHICLE' WHEN agent_id % 10 <= 7 THEN 'TYPE_PEDESTRIAN'
                    ELSE 'TYPE_CYCLIST' END AS object_type,
         CASE WHEN agent_id % 10 <= 5 THEN 4.5::double WHEN agent_id % 10 <= 7 THEN 0.6::double ELSE 1.8::double END AS length,
         CASE WHEN agent_id % 10 <= 5 THEN 2.0::double WHEN agent_id % 10 <= 7 THEN 0.6::double ELSE 0.7::double END AS width,
         agent_id % 10 <= 2 AS is_target FROM tracks)"""
SQL_LANES = """
lanes AS (SELECT vec_id AS lane_id, label % 4 AS lane_type, (25 + 5*(label % 5))::double AS limit_mph,
         vec_id + 1 AS exit_lane, vec_id % 15 AS map_id FROM embeddings)"""
SQL_POINTS = """
_f AS (SELECT vec_id AS lane_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
_s AS (SELECT lane_id, CAST(i // 2 AS INT) AS pt,
         sum(CASE WHEN i % 2 = 0 THEN CAST(round(e::double*1000) AS BIGINT) END) AS dx,
         sum(CASE WHEN i % 2 = 1 THEN CAST(round(e::double*1000) AS BIGINT) END) AS dy FROM _f GROUP BY ALL),
points AS (SELECT lane_id, pt, sum(dx) OVER w/100.0::double AS x, sum(dy) OVER w/100.0::double AS y FROM _s
       WINDOW w AS (PARTITION BY lane_id ORDER BY pt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
SQL_MODES = """
modes AS (SELECT l_orderkey AS object_id, CAST(row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) - 1 AS INT) AS mode,
         l_suppkey % 5 AS model_id, l_extendedprice AS score, l_quantity AS x, round(l_discount*100) AS y FROM lineitem)"""
SQL_TRUTHS = """
truths AS (SELECT o_orderkey AS object_id, CASE o_custkey % 3 WHEN 0 THEN 'TYPE_VEHICLE' WHEN 1 THEN 'TYPE_PEDESTRIAN'
           ELSE 'TYPE_CYCLIST' END AS object_type, (CAST(floor(o_totalprice) AS BIGINT) % 51)::double AS tx,
         (o_custkey % 11)::double AS ty FROM orders)"""


SAMPLES = 16


def mode_paths(modes: DataFrame) -> DataFrame:
    """(object_id, mode, score, path): 2 Hz samples from the origin to each endpoint, bowed by the mode."""
    def at(i):
        u = (i + 1) / F.lit(float(SAMPLES))
        bow = (F.col("mode") % 3 - 1) * 2.0
        return F.struct((F.col("x") * u).alias("x"), (F.col("y") * u + bow * u * (1 - u)).alias("y"))

    return modes.select("object_id", "mode", "score", F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), at).alias("path"))


def true_paths(truths: DataFrame) -> DataFrame:
    """(object_id, object_type, path): 2 Hz samples to the true endpoints, some of them not valid."""
    def at(i):
        u = (i + 1) / F.lit(float(SAMPLES))
        return F.struct((F.col("tx") * u).alias("x"), (F.col("ty") * u * u).alias("y"), ((F.col("object_id") + i) % 11 != 0).alias("valid"))

    return truths.select("object_id", "object_type", F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), at).alias("path"))


def mode_samples(modes: pa.Table) -> tuple[np.ndarray, ...]:
    """The samples (x, y) of :func:`mode_paths` as matrices, from a batch of endpoints."""
    u = (np.arange(SAMPLES) + 1) / float(SAMPLES)
    x, y, mode = (modes.column(c).to_numpy()[:, None] for c in ("x", "y", "mode"))
    return x * u, y * u + (np.fmod(mode, 3) - 1) * 2.0 * u * (1 - u)


def true_samples(truths: pa.Table) -> tuple[np.ndarray, ...]:
    """The samples (x, y, valid) of :func:`true_paths` as matrices, from a batch of endpoints."""
    u = (np.arange(SAMPLES) + 1) / float(SAMPLES)
    x, y, ids = (truths.column(c).to_numpy()[:, None] for c in ("tx", "ty", "object_id"))
    return x * u, y * u * u, (ids + np.arange(SAMPLES)) % 11 != 0


SQL_PATHS = """
_k AS (SELECT k, (k+1)/16.0::double AS u FROM range(16) r(k)),
mpaths AS (SELECT object_id, mode, score, k, x*u AS x, y*u + (mode % 3 - 1)*2.0::double*u*(1-u) AS y FROM modes, _k),
tpaths AS (SELECT object_id, object_type, k, tx*u AS x, ty*u*u AS y, (object_id + k) % 11 <> 0 AS valid FROM truths, _k)"""
