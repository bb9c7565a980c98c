import json

import struct

import pytest
from pyspark.sql import functions as F

from trajlake.sources import files as fs
from trajlake.sources import scenario as sn
from trajlake.sources.simplify import simplify_roads, thin


def document(name, **change):
    xyz = lambda *v: dict(zip("xyz", v))
    doc = {
        "name": name, "scenario_id": name, "tl_states": {},
        "objects": [
            {"id": 7, "type": "vehicle", "position": [xyz(1, 2, 0), xyz(2, 2, 0)], "velocity": [xyz(1, 0, 0)], "heading": [0.5, 0.6], "valid": [True, True], "width": 2, "length": 4, "height": 1.5},
            {"id": 8, "type": "cyclist", "position": [xyz(5, 5, 0)], "valid": [True]},
        ],
        "roads": [{"id": 1, "type": "lane", "map_element_id": 99, "geometry": [xyz(0, 0, 0), xyz(5, 0, 0)]}, {"id": 2, "type": "x", "map_element_id": 17, "geometry": [xyz(0, 0, 0)]}],
        "metadata": {"sdc_track_index": 0, "tracks_to_predict": [{"track_index": 1}]},
    }
    doc.update(change)
    return {k: v for k, v in doc.items() if v is not None}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    (root / "group_1").mkdir()
    (root / "a.json").write_text(json.dumps(document("a"), indent=1))
    (root / "group_1" / "b.json").write_text(json.dumps(document("b")))
    (root / "group_1" / "c.json").write_text(json.dumps(document("c", tl_states=None)))
    (root / "d.json").write_text('{"name": "d", "objects": [')
    (root / "e.json").write_text(json.dumps(document("e", roads=[{"geometry": [{"x": 1}]}])))
    (root / "f.json").write_text(json.dumps(document("f", objects=[{"type": "vehicle"}])))
    return str(root)


def test_read_and_quarantine(spark, folder):
    docs = sn.read_scenarios(spark, folder, recursive=True)
    ok, bad = sn.validate_scenarios(docs)
    assert sorted(r["name"] for r in ok.collect()) == ["a", "b"]
    assert sorted(r["source_file"].rsplit("/", 1)[1] for r in bad.collect()) == ["c.json", "d.json", "e.json", "f.json"]
    assert sn.read_scenarios(spark, folder).count() == 4


def test_tables(spark, folder):
    ok, _ = sn.validate_scenarios(sn.read_scenarios(spark, folder))
    states = sn.agent_states(ok)
    assert states.count() == 2 * 91
    s = {(r["agent_idx"], r["step"]): r for r in states.collect()}
    assert s[(0, 1)]["x"] == 2 and s[(0, 1)]["vx"] == 0 and s[(0, 1)]["valid"] and not s[(0, 2)]["valid"] and s[(1, 90)]["x"] == 0
    a = sorted(sn.agents(ok).collect(), key=lambda r: r["agent_idx"])
    assert [r["object_type"] for r in a] == [1, 3] and [r["is_track_to_predict"] for r in a] == [False, True] and a[1]["length"] == 0
    r = sorted(sn.roads(ok).collect(), key=lambda r: r["road_idx"])
    assert [x["road_type"] for x in r] == [4, 7]
    assert sn.road_points(sn.roads(ok)).count() == 3


def test_center_and_back(spark):
    st = spark.createDataFrame([("s", 0, 2.0, 4.0, True), ("s", 1, 99.0, 99.0, False)], "scenario_id string, step long, x double, y double, valid boolean")
    rp = spark.createDataFrame([("s", 4.0, 8.0)], "scenario_id string, x double, y double")
    c = sn.scenario_center(st, rp)
    moved = sn.center_scenario(st, c)
    got = {r["step"]: (r["x"], r["y"]) for r in moved.collect()}
    assert got == {0: (-1.0, -2.0), 1: (99.0, 99.0)}
    back = sn.center_scenario(moved, c, 1).select(st.columns)
    assert back.exceptAll(st).isEmpty()


def binary(objects=1, roads=1, tracks=(0,), size=2):
    out = b"scene42".ljust(16, b"\0") + struct.pack("<ii", 0, len(tracks)) + struct.pack(f"<{len(tracks)}i", *tracks) + struct.pack("<ii", objects, roads)
    for i in range(objects):
        out += struct.pack("<iiii", 0, 1, i, size) + b"".join(struct.pack(f"<{size}f", *[k + j for j in range(size)]) for k in range(7)) + struct.pack(f"<{size}i", *[1] * size)
        out += struct.pack("<6fi", 2.0, 4.5, 1.5, 10.0, 11.0, 0.0, 1)
    for i in range(roads):
        out += struct.pack("<iiii", 0, 6, 50 + i, size) + b"".join(struct.pack(f"<{size}f", *[k + j for j in range(size)]) for k in range(3)) + struct.pack("<6fi", *[0.0] * 6, 0)
    return out


def test_binary_maps(spark, tmp_path):
    good = binary()
    (tmp_path / "good.bin").write_bytes(good)
    (tmp_path / "short.bin").write_bytes(good[:-3])
    (tmp_path / "long.bin").write_bytes(good + b"\0")
    (tmp_path / "negative.bin").write_bytes(good[:28] + struct.pack("<i", -1) + good[32:])
    rows, bad = fs.read_map_binaries(spark, str(tmp_path))
    got = sorted(rows.collect(), key=lambda r: r["entity_idx"])
    assert [(r["scenario_id"], r["is_object"], r["type"], r["id"]) for r in got] == [("scene42", True, 1, 0), ("scene42", False, 6, 50)]
    assert got[0]["heading"] == [6.0, 7.0] and got[0]["valid"] == [1, 1] and got[0]["length"] == 4.5 and got[1]["vx"] is None and got[1]["x"] == [0.0, 1.0]
    errors = {r["source_file"].rsplit("/", 1)[1]: r["error"] for r in bad.collect()}
    assert errors == {"short.bin": "truncated file", "long.bin": "trailing bytes", "negative.bin": "negative count"}


def test_manifest_and_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("s__1.npz", "s__1.npz", "s", 1, 2), ("s__2.npz", "s__2.npz", "s", 2, 2)], fs.MANIFEST)
    fs.write_manifest(rows, str(tmp_path / "m"))
    back = fs.read_manifest(spark, str(tmp_path / "m"))
    assert back.exceptAll(rows).isEmpty() and back.count() == 2
    s = fs.manifest_summary(back).first()
    assert (s["num_samples"], s["num_segments"]) == (2, 1)
    ident = fs.split_identity(back.select("file")).collect()
    assert {(r["segment_id"], r["timestamp_micros"]) for r in ident} == {("s", 1), ("s", 2)}
    fs.write_trace_csv(rows.select("file", "timestamp_micros"), str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 2


def test_thin_keeps_ends_and_corners(spark):
    line = [{"x": float(i), "y": 0.0, "z": 0.0} for i in range(12)] + [{"x": 11.0, "y": float(i), "z": 0.0} for i in range(1, 6)]
    out = thin(line)
    assert out[0] == line[0] and out[-1] == line[-1] and {"x": 11.0, "y": 0.0, "z": 0.0} in out and len(out) < 7
    assert thin(line[:2]) == line[:2]
    # The span is a squared distance: ends more than 15.8 m apart are not merged.
    far = [{"x": 10.0 * i, "y": 0.0} for i in range(5)]
    assert thin(far) == far
    df = spark.createDataFrame([(1, 2, line), (2, 17, line), (3, 2, line[:5])], "id long, raw_type long, pts array<struct<x:double,y:double,z:double>>")
    size = {r["id"]: len(r["pts"]) for r in simplify_roads(df).collect()}
    assert size == {1: len(out), 2: len(line), 3: 5}


def test_flatten_drops_text(spark):
    df = spark.range(1).select(F.struct(F.lit(1).alias("a"), F.struct(F.lit("t").alias("s"), F.lit(2.5).alias("b")).alias("in")).alias("train"))
    assert fs.flatten_metrics(df).columns == ["train/a", "train/in/b"]


def test_roles_and_experts(spark):
    agent = spark.createDataFrame([("s", i, 1, 50.0, 0.0, i == 3) for i in range(6)], "scenario_id string, agent_idx long, object_type int, goal_x double, goal_y double, mark_as_expert boolean")
    state = spark.createDataFrame([("s", i, 0, float(i), 0.0, i != 5) for i in range(6)], "scenario_id string, agent_idx long, step long, x double, y double, valid boolean")
    scenario = spark.createDataFrame([("s", 2)], "scenario_id string, sdc_track_index long")
    got = {r["agent_idx"]: r["role"] for r in sn.select_agents(agent, state, scenario, control_limit=3).collect()}
    assert got == {2: "active", 0: "active", 1: "active", 3: "expert_static", 4: "expert_static"}
    only = sn.select_agents(agent, state, scenario, init_mode="only_controllable").collect()
    assert sorted(r["agent_idx"] for r in only) == [0, 1, 2, 4]
    marked = {r["agent_idx"]: r["mark_as_expert"] for r in sn.mark_experts(agent).collect()}
    assert marked[0] is False and all(marked[i] for i in range(1, 6))


def test_roads_by_town(spark):
    s = spark.createDataFrame([("Town01_3", 1), ("town10hd_1", 2)], "name string, k long")
    t = spark.createDataFrame([("town01", "A"), ("Town10HD", "B"), ("town1", "C")], "town string, roads string")
    assert {(r["k"], r["roads"]) for r in sn.replace_roads(s, t).collect()} == {(1, "A"), (2, "B")}
