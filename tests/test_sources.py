"""Scenario records, side files, streams and grouped operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.operators import grouped, primitives
from scenelake.sources import scenarios as sc
from scenelake.streaming import files


def scenario(spark, i="a"):
    state = (1.0, 2.0, 0.0, 4.0, 2.0, 1.5, 0.1, 3.0, 0.0, True)
    lane = lambda n, into, out: (n, "lane", "TYPE_SURFACE_STREET", 25.0, False, into, out, [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0)])
    row = (
        i, 10, 0, [0.0, 0.1], [], [(5, "TYPE_VEHICLE", [state, state]), (6, "TYPE_PEDESTRIAN", [state])],
        [(0, 1, "TYPE_VEHICLE"), (1, 0, "TYPE_PEDESTRIAN")], [lane(1, [], [2]), lane(2, [1, 99], None)],
        [([],), ([(1, "LANE_STATE_STOP", 0.0, 0.0, 0.0)],)],
    )
    return spark.createDataFrame([row], sc.SCHEMA.replace("\n", " "))


def test_decoding(spark, tmp_path):
    scenario(spark).write.parquet(f"{tmp_path}/in")
    s = sc.read(spark, f"{tmp_path}/in")
    assert sorted((r.agent_id, r.t) for r in sc.tracks(s).collect()) == [(5, 0), (5, 1), (6, 0)]
    assert [r.track_index for r in sc.targets(s, ["TYPE_VEHICLE"]).collect()] == [0]
    assert [r.place for r in sc.map_points(s).orderBy("place").collect()] == [0, 1, 2, 3]
    assert [(r.t, r.lane_id) for r in sc.signals(s).collect()] == [(1, 1)]
    assert sorted((r.src, r.dst) for r in sc.lane_edges(s).collect()) == [(1, 2), (2, 1)]
    sc.write_splits(s, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").first().split in ("training", "validation", "testing")


def test_encounters(spark, tmp_path):
    (tmp_path / "e.csv").write_text("ID,Time,LO_1,LA_1,LO_2,LA_2\n1,0,0,0,0,0.0001\n1,0,0,0,0,0.0001\n1,10,0,0,0,0.0002\n1,20,0,0,0,1\n")
    rows = sc.relative_motion(sc.read_encounters(spark, str(tmp_path / "e.csv"))).orderBy("norm_t").collect()
    assert [r.norm_t for r in rows] == [0, 1] and rows[0].x2 == pytest.approx(11.119, abs=0.01) and abs(rows[0].y2) < 1e-9


def test_stream_sees_each_file_once(spark, tmp_path):
    data = spark.range(3)
    data.write.parquet(f"{tmp_path}/in")
    args = (spark, f"{tmp_path}/in", data.schema, f"{tmp_path}/sink", f"{tmp_path}/log", lambda s: s.where("id > 0"))
    files.process_new(*args)
    files.process_new(*args)
    spark.range(10, 12).write.mode("append").parquet(f"{tmp_path}/in")
    files.process_new(*args)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/sink").collect()) == [1, 2, 10, 11]


def test_lane_search():
    assert grouped.search_lanes([(1, 0, 5, 0.1), (2, 5, 9, 0.2), (3, 0, 9, 2.0)], 0, 9) == [1, 2]
    assert grouped.search_lanes([(1, 0, 3, 0.1), (1, 6, 9, 0.1)], 0, 9) == [1]


def test_ward_finds_planted_clusters():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c, 0.1, (n, 2)) for c, n in (((0, 0), 6), ((9, 9), 4))])
    assert grouped.ward(points, 5.0).tolist() == [0] * 6 + [1] * 4


def test_change_points_keep_a_corner():
    t = np.arange(40.0)
    line = np.stack([t, 2 * t], 1)
    assert primitives.change_points(t, line, 0.1) == [0, 39]
    corner = np.stack([np.minimum(t, 20), np.maximum(t - 20, 0)], 1)
    assert any(abs(b - 20) <= 4 for b in primitives.change_points(t, corner, 0.1)[1:-1])


def test_alignment_ignores_rotation(spark):
    shape = np.random.default_rng(1).normal(size=(10, 2))
    shape -= shape.mean(0)
    turn = np.array([[np.cos(1), -np.sin(1)], [np.sin(1), np.cos(1)]])
    rows = [(1, i, *map(float, p)) for i, p in enumerate(shape @ turn + 5)]
    got = primitives.align_2d(spark.createDataFrame(rows, "k int, i int, x double, y double"), spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(shape)], "i int, rx double, ry double"), ["k"]).first()
    assert got.rmsd == pytest.approx(0, abs=1e-6)


def test_ensemble_shares_sum_to_one(spark):
    rows = [(1, i, 0, float(10 - i), float(i % 3) * 50, 0.0) for i in range(9)]
    got = grouped.ensemble_modes(spark.createDataFrame(rows, "object_id long, mode int, model_id long, score double, x double, y double"), 3)
    assert got.count() == 3 and got.agg(F.sum("share")).first()[0] == pytest.approx(1)
