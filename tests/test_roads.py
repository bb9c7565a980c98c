import math
import random


import pytest
from pyspark.sql import functions as F

from trajlake.operators import lanes as ln
from trajlake.operators import roads as rd
from trajlake.operators.interaction import pad_slots


def lane_rows(spark, lines, kind=4):
    rows = [("m", p, i, kind, float(x), float(y)) for p, pts in enumerate(lines) for i, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, "map_id string, lane_id long, pt_idx long, road_type int, x double, y double")


def test_drivable_cells_match_brute_force(spark):
    pts = [(0, 0), (6, 1), (9, 6)]
    segs = rd.to_segments(lane_rows(spark, [pts]), ["map_id", "lane_id", "road_type"])
    got = {(r["cx"], r["cy"]) for r in rd.drivable_cells(segs, ["map_id"], resolution=1.0, closing=0.0).collect()}

    def near(px, py):
        best = 1e9
        for (ax, ay), (bx, by) in zip(pts, pts[1:]):
            t = max(0, min(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            best = min(best, math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay)))
        return best

    assert got == {(i, j) for i in range(-6, 16) for j in range(-6, 14) if near(i + 0.5, j + 0.5) <= 2.25}
    closed = {(r["cx"], r["cy"]) for r in rd.drivable_cells(segs, ["map_id"], resolution=1.0, closing=1.0).collect()}
    ring = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    grown = {(a + i, b + j) for a, b in got for i, j in ring}
    assert closed == {c for c in {(a + i, b + j) for a, b in grown for i, j in ring} if all((c[0] + i, c[1] + j) in grown for i, j in ring)}


def test_polygon_cells(spark):
    tri = spark.createDataFrame([("m", [(0.0, 0.0), (8.0, 0.0), (0.0, 8.0)])], "map_id string, pts array<struct<x:double,y:double>>")
    cells = lambda df: sorted((x, r["cy"]) for r in df.collect() for x in range(r["lo"], r["hi"] + 1))
    assert cells(rd.polygon_spans(tri, ["map_id"], 1.0)) == [(i, j) for i in range(8) for j in range(8) if i + 0.5 + j + 0.5 < 8]
    # A comb: the scan line cuts several spans a row, which only the closing joins.
    comb = [(0.0, 0.0), (9.0, 0.0), (9.0, 6.0), (7.0, 6.0), (7.0, 2.0), (5.0, 2.0), (5.0, 6.0), (3.0, 6.0), (3.0, 2.0), (2.0, 2.0), (2.0, 6.0), (0.0, 6.0)]
    spans = rd.polygon_spans(spark.createDataFrame([("m", comb)], tri.schema), ["map_id"], 1.0)
    inside = set(cells(spans))
    assert inside == {(i, j) for i in range(9) for j in range(6) if j < 2 or i not in (2, 5, 6)}
    ring = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    grown = {(a + i, b + j) for a, b in inside for i, j in ring}
    assert set(cells(rd.closed_spans(spans, ["map_id"], 1))) == {c for c in grown if all((c[0] + i, c[1] + j) in grown for i, j in ring)}


def test_rings(spark):
    P = lambda *v: [(float(a), float(b)) for a, b in v]
    flat = P((0, 0), (1, 0), (1, 1), (0, 0), (5, 5), (6, 5), (6, 6), (5, 5), (9, 9))
    df = spark.createDataFrame([(flat,)], "pts array<struct<x:double,y:double>>")
    rings = df.select(rd.split_rings(F.col("pts")).alias("r")).first()["r"]
    assert [len(r) for r in rings] == [4, 4]
    open_ = spark.createDataFrame([(P((0, 0), (1, 0), (1, 1)),), (P((0, 0), (1, 1), (0, 0)),)], "pts array<struct<x:double,y:double>>")
    assert sorted(len(r["pts"]) for r in rd.close_rings(open_).collect()) == [3, 4]


def test_prepare_roads(spark):
    segs = spark.createDataFrame([(0.0, 0.0, 10.0, 0.0, 4), (0.0, 0.0, 1.0, 0.0, 6), (0.0, 0.0, 1.0, 0.0, 7)], "x0 double, y0 double, x1 double, y1 double, road_type int")
    got = sorted((r["draw_pass"], r["draw_type"], r["x0"], r["x1"], r["width"]) for r in rd.prepare_roads(segs).collect())
    assert got == [(0, 12, 0.0, 1.0, 0.25), (1, 11, -2.25, 12.25, 4.5)]
    with pytest.raises(Exception, match="only this step may give"):
        rd.prepare_roads(segs.withColumn("road_type", F.lit(11))).collect()


def test_lane_graph_walk_and_pose(spark):
    # 0 -> 1 -> 2 in a row, 3 starts at the end of 0 but comes back, 4 is a stub below one metre.
    pts = lane_rows(spark, [[(0, 0), (5, 0), (10, 0)], [(10.2, 0), (20, 0)], [(20, 0.1), (20, 10)], [(10, 0), (0, 0.2)], [(50, 50), (50.5, 50)]])
    lane = ln.lane_table(pts, ["map_id", "lane_id"])
    assert {r["lane_id"] for r in lane.collect()} == {0, 1, 2, 3}
    edges = ln.lane_successors(lane, ["map_id"])
    assert {(r["lane_id"], r["successor"]) for r in edges.collect()} == {(0, 1)}
    lane2 = ln.lane_table(lane_rows(spark, [[(0, 0), (10, 0)], [(10, 0), (20, 0)], [(20, 0), (28, 4)]]), ["map_id", "lane_id"])
    edges2 = ln.lane_successors(lane2, ["map_id"])
    start = spark.createDataFrame([("m", 0, 4.0, 1), ("m", 1, 0.0, 2), ("m", 2, 1.0, 3)], "map_id string, lane_id long, s double, walker long")
    out = {r["walker"]: r for r in ln.lane_walk(start, lane2, edges2, 12.0, ["map_id"], ["walker"]).collect()}
    assert (out[1]["lane_id"], out[1]["s"], out[1]["travelled"]) == (1, 6.0, 12.0)
    assert (out[2]["lane_id"], out[2]["s"]) == (2, 2.0)
    assert out[3]["s"] == pytest.approx(math.hypot(8, 4)) and out[3]["travelled"] == pytest.approx(math.hypot(8, 4) - 1)
    arc = ln.lane_points(lane_rows(spark, [[(0, 0), (10, 0)], [(10, 0), (20, 0)], [(20, 0), (28, 4)]]), ["map_id", "lane_id"])
    q = spark.createDataFrame([("m", 1, 6.0), ("m", 2, math.hypot(8, 4)), ("m", 0, 0.0)], "map_id string, lane_id long, s double")
    pose = {r["lane_id"]: (r["x"], r["y"]) for r in ln.pose_at(q, arc, ["map_id", "lane_id"]).collect()}
    assert pose[1] == pytest.approx((16, 0)) and pose[2] == pytest.approx((28, 4)) and pose[0] == (0, 0)


def test_goal_fallback_is_next_agent(spark):
    found = spark.createDataFrame([("s", 0, None, None), ("s", 1, 3.0, 3.0), ("s", 2, None, None)], "scenario_id string, agent_idx long, goal_x double, goal_y double")
    init = spark.createDataFrame([("s", i, 10.0 * i, 0.0) for i in range(3)], "scenario_id string, agent_idx long, goal_x double, goal_y double")
    got = {r["agent_idx"]: r["goal_x"] for r in ln.fallback_goal(found, init, ["scenario_id"], "agent_idx").collect()}
    assert got == {0: 10.0, 1: 3.0, 2: 0.0}


def test_lane_point_sampling_follows_length(spark):
    lane = spark.createDataFrame([(i, float(l)) for i, l in enumerate((100, 300, 600))], "lane_id long, length double")
    out = ln.sample_lane_points(lane, 5000, ["lane_id"]).collect()
    share = [sum(r["lane_id"] == i for r in out) / len(out) for i in range(3)]
    assert len(out) == 5000 and share == pytest.approx([0.1, 0.3, 0.6], abs=0.03)


def test_padded_slots(spark):
    df = spark.createDataFrame([(1, 2, 5.0, 6.0), (1, 1, 3.0, 4.0)], "k long, slot long, a double, b double")
    assert pad_slots(df, ["k"], ["a", "b"], 4).first()["obs"] == [3.0, 4.0, 5.0, 6.0, 0.0, 0.0, 0.0, 0.0]


def test_sample_goal_equals_the_full_comparison(spark):
    rnd = random.Random(21)
    pts = [("m", p, i, rnd.uniform(0, 250), rnd.uniform(0, 250)) for p in range(12) for i in range(6)] + [("far", 0, 0, 5000.0, 0.0), ("far", 0, 1, 5030.0, 0.0)]
    state = [("m", a, rnd.uniform(-300, 500), rnd.uniform(-300, 500), rnd.uniform(-3, 3)) for a in range(60)] + [("far", 100, 0.0, 0.0, 0.0), ("far", 101, 0.0, 0.0, 3.1), ("none", 102, 0.0, 0.0, 0.0)]
    got = {r["agent"]: (r["goal_x"], r["goal_y"]) for r in ln.sample_goal(
        spark.createDataFrame(state, "map_id string, agent long, x double, y double, heading double"),
        spark.createDataFrame(pts, "map_id string, polyline_id long, pt_idx long, x double, y double"), ["map_id"], ["agent"]).collect()}
    assert len(got) == len(state)
    for m, a, x, y, h in state:
        ahead = [(abs(math.hypot(px - x, py - y) - 30.0), p, i, px, py) for k, p, i, px, py in pts if k == m and (px - x) * math.cos(h) + (py - y) * math.sin(h) > 0]
        assert got[a] == (min(ahead)[3:] if ahead else (None, None))
