"""What goes through an exchange or a join must not grow with the product of two tables."""

from pyspark.sql import functions as F

from scenelake.operators import kinematics as k
from scenelake.operators import lanes as ln
from scenelake.operators import pairs as p


def _scenes(spark, n=30):
    steps = spark.range(n).select(F.col("id").alias("scenario_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("t"))
    tracks = steps.select("scenario_id", F.col("scenario_id").alias("agent_id"), F.col("t").cast("int").alias("t"), (F.col("t") * 1.0 + F.col("scenario_id") / 10).alias("x"), F.lit(0.5).alias("y"), F.lit(True).alias("valid"))
    maps = spark.range(n).select(F.col("id").alias("scenario_id"), F.lit(0).cast("long").alias("map_id"))
    lanes = spark.createDataFrame([(0, 0), (1, 0)], "lane_id long, map_id long")
    points = spark.createDataFrame([(l, p, float(p), 3.0 * l) for l in (0, 1) for p in range(6)], "lane_id long, pt int, x double, y double")
    return tracks, maps, lanes, points


def test_a_map_goes_once_to_a_block_of_scenarios(spark):
    tracks, maps, lanes, points = _scenes(spark)
    sides = ln.with_maps(tracks, maps, ln._around(points, lanes))
    assert sides._gd2._df.count() == 12
    found = ln.near(tracks, maps, lanes, points).select("scenario_id", "t", "rank", "lane_id", "d")
    every = ln.nearest(tracks, maps, lanes, points).where("d <= 5").select("scenario_id", "t", "rank", "lane_id", "d")
    assert sorted(found.collect()) == sorted(every.collect())


def test_pairs_and_points_by_scene(spark):
    tracks, maps, lanes, points = _scenes(spark, 3)
    two = tracks.unionByName(tracks.withColumns({"agent_id": F.col("agent_id") + 10, "y": F.lit(1.5)}))
    moving = k.with_motion(two).withColumn("length", F.lit(4.0))
    ends = spark.createDataFrame([(0, 7, 2.0, 1.0), (1, 8, 0.0, 0.0)], "map_id long, cp_id long, cx double, cy double")
    found = p.interaction_features(moving, maps, ends).orderBy("scenario_id").collect()
    assert [(r.i, r.j, r.min_d) for r in found] == [(0, 10, 1.0), (1, 11, 1.0), (2, 12, 1.0)]
    # both come as near to the point, at the same speed
    assert {r.scene_mttcp for r in found} == {float("inf")}
    near = p.nearest_to_points(moving, maps, ends, 5.0)
    assert [(r.agent_id, r.cp_id, r.d, r.t) for r in near.where("scenario_id = 0").orderBy("agent_id").collect()] == [(0, 7, 0.5, 2), (10, 7, 0.5, 2)]
    assert "Join" not in p.pair_measures(moving)._jdf.queryExecution().optimizedPlan().toString()  # no row for each pair and step


def test_a_map_without_a_valid_step(spark):
    tracks, maps, lanes, points = _scenes(spark, 3)
    ends = spark.createDataFrame([(0, 7, 2.0, 1.0)], "map_id long, cp_id long, cx double, cy double")
    assert p.nearest_to_points(tracks.withColumn("valid", F.lit(False)), maps, ends, 5.0).collect() == []


def test_trajectories_are_not_broadcast_nor_sent_as_arrays(spark):
    import __spark_entry__

    for name in ("ade_at_steps", "ade_by_type", "benchmark_metrics", "benchmark_rollup"):
        query = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
        assert "path" not in query.optimizedPlan().toString()  # sixteen samples would go through each exchange
        # only the small tables of metrics and types may be broadcast, not objects
        broadcast = [x for x in query.executedPlan().toString().split("\n") if "BroadcastHashJoin" in x]
        assert not any("object_id" in x for x in broadcast)


def test_metrics_and_overlaps_by_hand(spark):
    from scenelake.operators import trajectories as tr

    def line(x, y, *valid):
        return [(x + i, y, *valid) for i in range(16)]

    # a truth at 2 m/s; the second mode is on it, the first misses, and the second object's only mode misses
    paths = [(1, 0, 3.0, line(0.0, 9.0)), (1, 1, 1.0, line(0.0, 0.0)), (2, 0, 1.0, line(0.0, 5.0))]
    paths = spark.createDataFrame(paths, "object_id long, mode int, score double, path array<struct<x: double, y: double>>")
    truths = [(1, "TYPE_VEHICLE", line(0.0, 0.0, True)), (2, "TYPE_VEHICLE", line(0.0, 9.0, True)), (3, "TYPE_VEHICLE", line(0.0, 9.0, False))]
    truths = spark.createDataFrame(truths, "object_id long, object_type string, path array<struct<x: double, y: double, valid: boolean>>")
    found = tr.metrics(tr.misses(tr.errors(paths, truths)), ["object_type", "seconds"]).orderBy("seconds").collect()
    # the hit has a quarter of the confidence and is the last of three modes, of two objects
    assert [(r.seconds, r.n, r.min_ade, r.min_fde, r.miss_rate, round(r.map, 6)) for r in found] == [(s, 2, 2.0, 2.0, 0.5, round(1 / 2 / 3, 6)) for s in (3, 5, 8)]
    # the first mode of 1 lies on 2; 3 lies there too, but is never valid
    over = tr.overlaps(paths, truths, F.lit(0)).orderBy("object_id").collect()
    assert [(r.object_id, r.overlap) for r in over] == [(1, 1), (2, 0)]
    assert [r.overlap for r in tr.overlaps(paths, truths, F.col("object_id")).collect()] == [0, 0]


def test_the_most_similar_lane_without_a_row_for_each_step_and_lane(spark):
    tracks, maps, lanes, points = _scenes(spark)
    # agents of several steps, one that comes back, and a step that isn't valid
    more = tracks.withColumns({"agent_id": F.col("agent_id") + 100, "y": F.abs(3.0 - F.col("t")), "valid": F.col("t") != F.col("scenario_id") % 5})
    tracks = tracks.unionByName(more)
    found = ln.most_similar(tracks, maps, lanes, points)
    every = ln.similarity(ln.distances(tracks, maps, lanes, points))
    best = every.groupBy("scenario_id", "agent_id").agg(F.max(F.struct("sim", (-F.col("lane_id")).alias("l"))).alias("b"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, best.selectExpr("scenario_id", "agent_id", "-b.l", "b.sim").collect()))
    from scenelake.plans.lanes import best_lane

    assert "collect_list" not in best_lane(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
