"""Values that lie between two results must fall as they do in SQL."""

import duckdb
from pyspark.sql import functions as F

from scenelake.functions import geometry as g
from scenelake.operators import kinematics as k
from scenelake.plans.scoring import type_counts


def test_ties_round_as_in_sql(spark):
    values = [4.65985, -0.74235, 1.00005, 2.5, 0.28499999999999998, -3.14159265, float("inf")]
    mine = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(g.round_("v", 4)).collect()]
    assert mine == [duckdb.execute("SELECT round(?::double, 4)", [v]).fetchone()[0] for v in values]


def test_an_unknown_value_has_no_score(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, None)], "a long, v double")
    assert [tuple(r) for r in k.zscore(df, ["v"]).orderBy("a").collect()] == [(1, -1.0), (2, 1.0), (3, None)]


def test_an_agent_in_two_scenarios_counts_once(spark, tmp_path):
    events = spark.range(100).selectExpr("id AS event_id", "timestamp_seconds(id)::timestamp_ntz AS ts", "1L AS user_id", "'view' AS event_type", "1.0D AS value", """'{"k": 50}' AS props""")
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert {r.object_type: r.n for r in type_counts(spark, str(tmp_path)).where(F.col("n") > 0).collect()} == {"TYPE_VEHICLE": 1}


def test_headings_are_those_of_sql(spark):
    # steps of whole centimetres; the last bit of a heading decides a yaw rate between -pi and pi
    steps = spark.range(20000).selectExpr("id div 50 AS scenario_id", "id div 50 AS agent_id", "CAST(id % 50 AS INT) AS t", "(id * 7919 % 1000) / 100D AS x", "(id * 104729 % 997) / 100D AS y", "true AS valid")
    rows = k.kinematics(steps).select("vy", "vx", "heading").toPandas()
    assert len(rows) == 20000
    db = duckdb.connect()
    db.register("found", rows)
    assert db.execute("SELECT count(*) FROM found WHERE heading <> atan2(vy, vx)").fetchall() == [(0,)]
    lone = steps.where("t = 0").limit(1)
    assert k.kinematics(lone).select("heading", "yaw_rate").first() == (None, None)
