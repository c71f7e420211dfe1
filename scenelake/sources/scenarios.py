"""Scenario records and side files: nested rows to the canonical long tables and back.

A scenario is one row with nested tracks, map features and signals; ``read`` takes Parquet or JSON
folders in the explicit schema.  Positional alignment of parallel lists is replaced by keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenelake.functions.geometry import rotate
from scenelake.operators.scoring import hash_bucket

STATE = "x double, y double, z double, length double, width double, height double, heading double, vx double, vy double, valid boolean"
SCHEMA = f"""scenario_id string, current_time_index int, sdc_track_index int, timestamps_seconds array<double>,
objects_of_interest array<int>,
tracks array<struct<id: int, object_type: string, states: array<struct<{STATE}>>>>,
tracks_to_predict array<struct<track_index: int, difficulty: int, object_type: string>>,
map_features array<struct<id: bigint, kind: string, type: string, speed_limit_mph: double, interpolating: boolean,
  entry_lanes: array<bigint>, exit_lanes: array<bigint>, polyline: array<struct<x: double, y: double, z: double>>>>,
dynamic_map_states array<struct<lane_states: array<struct<lane: bigint, state: string, x: double, y: double, z: double>>>>"""


def read(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Scenario rows from a folder of Parquet or JSON files."""
    return spark.read.schema(SCHEMA.replace("\n", " ")).format(fmt).load(path)


def tracks(scenarios: DataFrame) -> DataFrame:
    """One row per scenario, agent and step."""
    agent = scenarios.select("scenario_id", F.explode("tracks").alias("a"))
    step = agent.select("scenario_id", F.col("a.id").alias("agent_id"), F.col("a.object_type").alias("object_type"), F.posexplode("a.states").alias("t", "s"))
    return step.select("scenario_id", "agent_id", "object_type", "t", "s.*")


def targets(scenarios: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Targets of the allowed types; scenes left without any have no row."""
    rows = scenarios.select("scenario_id", F.explode("tracks_to_predict").alias("p")).select("scenario_id", "p.*")
    return rows if types is None else rows.where(F.col("object_type").isin(types))


def map_points(scenarios: DataFrame) -> DataFrame:
    """One row per scenario, map feature and point, with the point's place among all of the scene."""
    feature = scenarios.select("scenario_id", F.posexplode("map_features").alias("f", "m"))
    point = feature.select("scenario_id", "f", F.col("m.id").alias("feature_id"), F.col("m.kind").alias("kind"), F.col("m.type").alias("type"), F.posexplode("m.polyline").alias("pt_idx", "p"))
    place = F.row_number().over(Window.partitionBy("scenario_id").orderBy("f", "pt_idx")) - 1
    return point.select("scenario_id", "feature_id", "kind", "type", "pt_idx", place.alias("place"), "p.x", "p.y", "p.z")


def signals(scenarios: DataFrame) -> DataFrame:
    """One row per scenario, step and signalled lane; steps without signals keep their number."""
    step = scenarios.select("scenario_id", F.posexplode("dynamic_map_states").alias("t", "d"))
    lane = step.select("scenario_id", "t", F.explode("d.lane_states").alias("l"))
    return lane.select("scenario_id", "t", F.col("l.lane").alias("lane_id"), "l.state", "l.x", "l.y", "l.z")


def lane_edges(scenarios: DataFrame) -> DataFrame:
    """The lane graph: each lane with its entry and exit lanes that exist in the scene."""
    f = scenarios.select("scenario_id", F.explode("map_features").alias("m")).where("m.kind = 'lane'")
    own = f.select("scenario_id", F.col("m.id").alias("dst"))
    near = F.explode(F.array_union(F.coalesce("m.entry_lanes", F.array().cast("array<bigint>")), F.coalesce("m.exit_lanes", F.array().cast("array<bigint>")))).alias("dst")
    return f.select("scenario_id", F.col("m.id").alias("src"), near).join(own, ["scenario_id", "dst"], "left_semi").select("scenario_id", "src", "dst")


def index(scenarios: DataFrame) -> DataFrame:
    """The light index: ids, target list and split by hash."""
    split = hash_bucket(F.crc32("scenario_id"), 1000)
    return scenarios.select(
        "scenario_id", "current_time_index", "sdc_track_index", "tracks_to_predict", F.size("tracks").alias("n_agents"),
        F.when(split < 850, "training").when(split < 925, "validation").otherwise("testing").alias("split"),
    )


def write_splits(scenarios: DataFrame, path: str) -> None:
    """Scenarios by split, so that readers of one split list its folder only."""
    own = index(scenarios).select("scenario_id", "split")
    scenarios.join(own, "scenario_id").write.partitionBy("split").mode("overwrite").parquet(path)


ASSIGNMENT = "scenario_id string, agent_n int, object_id int, obj_type string, stationary boolean, valid boolean, full boolean, avg_speed double, n_valid int, n_tot int"
ENCOUNTER = "ID bigint, Time bigint, LO_1 double, LA_1 double, LO_2 double, LA_2 double"


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """Lane assignments as CSV with a header."""
    return spark.read.schema(ASSIGNMENT).option("header", True).csv(path)


def read_encounters(spark: SparkSession, path: str) -> DataFrame:
    """Encounters of two vehicles as CSV with a header: id, microseconds, two places in degrees."""
    return spark.read.schema(ENCOUNTER).option("header", True).csv(path)


def relative_motion(encounters: DataFrame, within: float = 100.0) -> DataFrame:
    """Encounters in metres: relative to vehicle 1's first place, rotated to the first bearing of
    vehicle 2, rows within ``within`` metres, one row per time, time normalised to [0, 1]."""
    radius = 6371000.0
    w = Window.partitionBy("ID").orderBy("Time")
    one = encounters.dropDuplicates(["ID", "Time"])
    lo, la = F.first("LO_1").over(w), F.first("LA_1").over(w)

    def metres(lon, lat):
        return F.radians(lon - lo) * F.cos(F.radians(la)) * radius, F.radians(lat - la) * radius

    x1, y1 = metres(F.col("LO_1"), F.col("LA_1"))
    x2, y2 = metres(F.col("LO_2"), F.col("LA_2"))
    m = one.select("ID", "Time", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    near = m.where((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2 < within**2)
    bearing = F.first(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))).over(w)
    turned = near.withColumn("b", -bearing)
    out = {n: v for i in "12" for n, v in zip((f"x{i}", f"y{i}"), rotate(F.col(f"x{i}"), F.col(f"y{i}"), F.col("b")))}
    everyone = Window.partitionBy("ID")
    lo_t, hi_t = F.min("Time").over(everyone), F.max("Time").over(everyone)
    return turned.select("ID", F.coalesce(F.try_divide((F.col("Time") - lo_t).cast("double"), (hi_t - lo_t).cast("double")), F.lit(0.0)).alias("norm_t"), *(v.alias(n) for n, v in out.items()))
