"""Scenario records: wire format, framing, whole files; configurations and named operators."""

import io
import json
import struct

import pytest

from scenelake.operators import registry
from scenelake.sources import config, records, scenarios, world


def varint(n):
    out = b""
    n &= (1 << 64) - 1
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(n, value):
    if isinstance(value, bytes):
        return varint(n << 3 | 2) + varint(len(value)) + value
    return varint(n << 3) + varint(value)


def double(n, x):
    return varint(n << 3 | 1) + struct.pack("<d", x)


def single(n, x):
    return varint(n << 3 | 5) + struct.pack("<f", x)


def point(x, y, z):
    return double(1, x) + double(2, y) + double(3, z)


def message(name="s1"):
    state = lambda x, ok: double(2, x) + double(3, 2.5) + single(5, 4.5) + single(8, 0.5) + single(10, -1.5) + field(11, ok)
    track = field(1, 7) + field(2, 1) + field(3, state(1.0, 1)) + field(3, state(2.0, 0))
    lane = double(1, 25.0) + field(2, 2) + field(8, point(1, 2, 3)) + field(8, point(4, 5, 6)) + field(9, varint(11) + varint(300)) + field(10, 12)
    sign = field(1, 5) + field(2, point(9, 9, 0))
    signal = field(1, field(1, 5) + field(2, 4) + field(3, point(7, 8, 0)))
    return (
        varint(1 << 3 | 2) + varint(16) + struct.pack("<2d", 0.0, 0.1) + field(2, track) + field(4, 3) + field(5, name.encode()) + field(6, -1)
        + field(7, signal) + field(7, b"") + field(8, field(1, 5) + field(3, lane)) + field(8, field(1, 6) + field(7, sign)) + field(10, 10) + field(11, field(1, 0) + field(2, 1))
    )


def test_scenario_message():
    s = records.scenario(message())
    assert (s["scenario_id"], s["current_time_index"], s["sdc_track_index"]) == ("s1", 10, -1)
    assert s["timestamps_seconds"] == [0.0, 0.1] and s["objects_of_interest"] == [3]
    assert s["tracks"][0]["object_type"] == "TYPE_VEHICLE" and [x["valid"] for x in s["tracks"][0]["states"]] == [True, False]
    assert s["tracks"][0]["states"][0]["vy"] == -1.5 and s["tracks"][0]["states"][0]["z"] == 0.0
    assert s["tracks_to_predict"] == [{"track_index": 0, "difficulty": 1, "object_type": "TYPE_VEHICLE"}]
    lane, sign = s["map_features"]
    assert (lane["type"], lane["speed_limit_mph"], lane["entry_lanes"], lane["exit_lanes"]) == ("TYPE_SURFACE_STREET", 25.0, [11, 300], [12])
    assert sign["kind"] == "stop_sign" and sign["polyline"] == [{"x": 9.0, "y": 9.0, "z": 0.0}]
    assert [len(d["lane_states"]) for d in s["dynamic_map_states"]] == [1, 0]
    assert records.scenario(b"")["tracks"] == []


def tfrecord(*data):
    return b"".join(struct.pack("<Q", len(d)) + b"\0" * 4 + d + b"\0" * 4 for d in data)


def test_framing():
    assert list(records.framed(io.BytesIO(tfrecord(b"a", b"", b"bc")))) == [b"a", b"", b"bc"]
    with pytest.raises(ValueError):
        list(records.framed(io.BytesIO(tfrecord(b"abc")[:-5])))


def test_read_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part-{i}.tfrecord").write_bytes(tfrecord(*(message(f"s{i}{k}") for k in range(2))))
    rows = records.read_records(spark, f"file://{tmp_path}/*.tfrecord")
    assert sorted(r.scenario_id for r in rows.select("scenario_id").collect()) == ["s00", "s01", "s10", "s11", "s20", "s21"]
    tracks = scenarios.tracks(rows)
    assert tracks.count() == 12 and tracks.where("valid").count() == 6
    assert scenarios.map_points(rows).count() == 18 and scenarios.signals(rows).count() == 6


def test_configurations(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"a": {"b": 1, "c": 2.0}, "d": "x"}))
    (tmp_path / "own.json").write_text(json.dumps({"_BASE_": "base.json", "a": {"b": 3}}))
    own = config.load(tmp_path / "own.json")
    assert own == {"a": {"b": 3, "c": 2.0}, "d": "x"}
    assert config.overridden(own, ["a.c=5", "d=y"]) == {"a": {"b": 3, "c": 5}, "d": "y"}
    with pytest.raises(KeyError):
        config.overridden(own, ["a.z=1"])
    with pytest.raises(TypeError):
        config.overridden(own, ["a.b=text"])


def test_named_operators(spark):
    t = world.with_type(world.tracks(spark, "/root/testdata/sf0.001"))
    steps = [{"name": "object_types", "types": ["TYPE_VEHICLE"]}, {"name": "valid_at", "t": 10}]
    got = registry.filtered(t, steps)
    assert {r.object_type for r in got.select("object_type").distinct().collect()} == {"TYPE_VEHICLE"}
    assert got.where("t = 10 and not valid").count() == 0 < got.count() < t.count()
    with pytest.raises(KeyError):
        registry.filtered(t, [{"name": "nothing"}])
    assert {"scenarios", "records"} <= registry.READERS.known.keys()
