import math
import random

import pytest
from pyspark.sql import functions as F

from trajlake.functions import geometry as g
from trajlake.operators import grid
from trajlake.operators import interaction as ia
from trajlake.operators import roads as rd


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def corner_list(b):
    x, y, l, w, h = b
    out = []
    for sl, sw in ((1, 1), (-1, 1), (-1, -1), (1, -1)):
        u, v = sl * l / 2, sw * w / 2
        out.append((x + u * math.cos(h) - v * math.sin(h), y + u * math.sin(h) + v * math.cos(h)))
    return out


def brute_distance(a, b, rounding=0.7):
    """Distance of the origin to the difference polygon, by sampling-free edge tests."""
    ra, rb = min(a[2], a[3]) * rounding / 2, min(b[2], b[3]) * rounding / 2
    a2, b2 = (a[0], a[1], a[2] - 2 * ra, a[3] - 2 * ra, a[4]), (b[0], b[1], b[2] - 2 * rb, b[3] - 2 * rb, b[4])
    pa, pb = corner_list(a2), corner_list(b2)

    def seg(p, q0, q1):
        sx, sy = q1[0] - q0[0], q1[1] - q0[1]
        t = max(0, min(1, ((p[0] - q0[0]) * sx + (p[1] - q0[1]) * sy) / (sx * sx + sy * sy)))
        return math.hypot(p[0] - q0[0] - t * sx, p[1] - q0[1] - t * sy)

    gaps = []
    for h in (a[4], a[4] + math.pi / 2, b[4], b[4] + math.pi / 2):
        c, s = math.cos(h), math.sin(h)
        ia_, ib_ = [x * c + y * s for x, y in pa], [x * c + y * s for x, y in pb]
        gaps.append(max(min(ib_) - max(ia_), min(ia_) - max(ib_)))
    if max(gaps) <= 0:
        d = max(gaps)
    else:
        d = min([seg(p, pb[i], pb[(i + 1) % 4]) for p in pa for i in range(4)] + [seg(p, pa[i], pa[(i + 1) % 4]) for p in pb for i in range(4)])
    return d - ra - rb


def test_box_distance_matches_brute_force(spark):
    rnd = random.Random(5)
    rows = [tuple(rnd.uniform(-4, 4) if i in (0, 1, 5, 6) else rnd.uniform(1, 5) if i in (2, 3, 7, 8) else rnd.uniform(-3, 3) for i in range(10)) for _ in range(300)]
    df = spark.createDataFrame(rows, "ax double, ay double, al double, aw double, ah double, bx double, by double, bl double, bw double, bh double")
    a = g.Box(F.col("ax"), F.col("ay"), F.col("al"), F.col("aw"), F.cos("ah"), F.sin("ah"))
    b = g.Box(F.col("bx"), F.col("by"), F.col("bl"), F.col("bw"), F.cos("bh"), F.sin("bh"))
    out = g.with_box_distance(df.withColumn("direct", g.box_signed_distance(a, b)), a, b, "staged").collect()
    for r in out:
        want = brute_distance(tuple(r[:5]), tuple(r[5:10]))
        assert r["direct"] == pytest.approx(want, abs=1e-9)
        assert r["staged"] == pytest.approx(want, abs=1e-9)


def test_wrap_and_speed(spark):
    r = one(spark, a=g.wrap_angle(F.lit(-4.0)), b=g.wrap_angle(F.lit(math.pi)), s=g.signed_speed(F.lit(3.0), F.lit(4.0), F.lit(-1.0), F.lit(0.0)), z=g.signed_speed(F.lit(0.0), F.lit(2.0), F.lit(1.0), F.lit(0.0)))
    assert r["a"] == pytest.approx(2 * math.pi - 4) and r["b"] == pytest.approx(-math.pi) and r["s"] == -5 and r["z"] == 2


def test_segment_rules(spark):
    P = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    r = one(
        spark, hit=g.segments_intersect(P(0, 0), P(2, 2), P(0, 2), P(2, 0)), parallel=g.segments_intersect(P(0, 0), P(2, 0), P(1, 0), P(3, 0)),
        touch=g.segments_intersect(P(0, 0), P(2, 0), P(2, 0), P(2, 5)), d=g.point_segment_distance(*P(3, -1), *P(0, 0), *P(2, 0)), point=g.point_segment_distance(*P(3, 4), *P(0, 0), *P(0, 0)),
    )
    assert r["hit"] and not r["parallel"] and r["touch"]
    assert r["d"] == pytest.approx(math.sqrt(2)) and r["point"] == 5


STATE = "scenario_id long, agent_id long, rollout long, step long, x double, y double, heading double, length double, width double, object_type long, speed double, valid boolean"


def state(spark, rows):
    return spark.createDataFrame(rows, STATE)


def test_time_to_collision_golden(spark):
    rows = [(1, i, 0, 0, float(x), 0.0, 0.0, 4.0, 2.0, 1, float(v), True) for i, (x, v) in enumerate(zip((0, 5, 10, 15), (6, 10, 3, 1)))]
    got = {r["agent_id"]: r["ttc"] for r in ia.time_to_collision(state(spark, rows)).collect()}
    assert [got[i] for i in range(4)] == pytest.approx([5, 1 / 7, 1 / 2, 5])


def test_nearest_object_is_exact_and_rollouts_do_not_mix(spark):
    rnd = random.Random(3)
    rows = [(1, a, r, 0, rnd.uniform(0, 400), rnd.uniform(0, 400), rnd.uniform(-3, 3), 4.0, 2.0, 1, 1.0, a % 5 != 0) for a in range(25) for r in range(2)]
    rows.append((2, 0, 0, 0, 0.0, 0.0, 0.0, 4.0, 2.0, 1, 1.0, True))
    got = {(r["scenario_id"], r["agent_id"], r["rollout"]): r["nearest_distance"] for r in ia.nearest_object(state(spark, rows), cell=4.0).collect()}
    assert len(got) == len(rows) and got[(2, 0, 0)] is None
    for s, a, r, _, x, y, h, l, w, *_ in rows[:-1]:
        want = min(brute_distance((x, y, l, w, h), (o[4], o[5], o[7], o[8], o[6])) for o in rows[:-1] if o[2] == r and o[1] != a and o[11])
        assert got[(s, a, r)] == pytest.approx(want, abs=1e-9)


def corridor(spark, lines):
    rows = [(1, p, i, 6, float(x), float(y)) for p, pts in enumerate(lines) for i, (x, y) in enumerate(pts)]
    return rd.to_segments(spark.createDataFrame(rows, "scenario_id long, polyline_id long, pt_idx long, road_type int, x double, y double"), ["scenario_id", "polyline_id", "road_type"])


def test_nearest_object_in_a_crowd_with_loners(spark):
    # More agents than a small scene holds: a dense knot, a far group, and one agent far from everything.
    rnd = random.Random(5)
    spots = [(rnd.uniform(0, 60), rnd.uniform(0, 60)) for _ in range(150)] + [(rnd.uniform(900, 950), rnd.uniform(-40, 0)) for _ in range(20)] + [(-5000.0, 7000.0), (3.0, 3.0), (3.0, 3.0)]
    rows = [(1, a, 0, 0, float(x), float(y), rnd.uniform(-3, 3), 25.0 if a % 40 == 0 else 4.0, 2.0, 1, 1.0, a % 7 != 0) for a, (x, y) in enumerate(spots)]
    got = {r["agent_id"]: r["nearest_distance"] for r in ia.nearest_object(state(spark, rows)).collect()}
    assert len(got) == len(rows)
    for s, a, r, _, x, y, h, l, w, *_ in rows:
        want = min(brute_distance((x, y, l, w, h), (o[4], o[5], o[7], o[8], o[6])) for o in rows if o[1] != a and o[11])
        assert got[a] == pytest.approx(want, abs=1e-9)


def test_box_join_meets_each_pair_once(spark):
    rnd = random.Random(6)
    boxes = [(k % 2, k, x, x + rnd.uniform(0, 30), y, y + rnd.uniform(0, 5)) for k in range(120) for x, y in [(rnd.uniform(-50, 50), rnd.uniform(-50, 50))]]
    a = spark.createDataFrame(boxes, "g long, a long, ax0 double, ax1 double, ay0 double, ay1 double")
    b = spark.createDataFrame(boxes, "g long, b long, bx0 double, bx1 double, by0 double, by1 double")
    for size in (3.0, 40.0):
        met = grid.box_join(a, b, ["g"], tuple(F.col(f"a{e}") for e in ("x0", "x1", "y0", "y1")), tuple(F.col(f"b{e}") for e in ("x0", "x1", "y0", "y1")), size)
        got = sorted((r["a"], r["b"]) for r in met.collect())
        want = sorted((p[1], q[1]) for p in boxes for q in boxes if p[0] == q[0] and p[2] <= q[3] and q[2] <= p[3] and p[4] <= q[5] and q[4] <= p[5])
        assert got == want


def test_time_to_collision_for_any_heading_and_speed(spark):
    rnd = random.Random(7)
    rows = [(1, a, 0, 0, rnd.uniform(0, 200), rnd.uniform(0, 200), rnd.choice([0.0, 0.8, 2.4, -2.0]) + rnd.uniform(-0.1, 0.1), rnd.choice([4.0, 18.0]), 2.0, 1, rnd.choice([0.0, 3.0, 30.0, 60.0]), a % 9 != 0) for a in range(120)]
    got = {r["agent_id"]: r["ttc"] for r in ia.time_to_collision(state(spark, rows)).collect()}
    for _, a, _, _, x, y, h, l, w, _, v, _ in rows:
        best = None
        for _, b, _, _, ox, oy, oh, ol, ow, _, ov, valid in rows:
            yaw, dx, dy = abs(oh - h), ox - x, oy - y
            c, s = abs(math.cos(yaw)), abs(math.sin(yaw))
            ahead = dx * math.cos(h) + dy * math.sin(h) - l / 2 - (ol / 2 * c + ow / 2 * s)
            aside = abs(dy * math.cos(h) - dx * math.sin(h)) - w / 2 - (ol / 2 * s + ow / 2 * c)
            follows = ahead > 0 and yaw <= g.FOLLOW_YAW and aside < 0 and (aside < g.FOLLOW_SMALL_OVERLAP or yaw <= g.FOLLOW_SMALL_YAW)
            if b != a and valid and follows and (best is None or (ahead, b) < best[:2]):
                best = (ahead, b, ov)
        want = min(best[0] / (v - best[2]), 5.0) if best and v > best[2] else 5.0
        assert got[a] == pytest.approx(want)


def signed(spark, lines, points, tolerance=1e-3, cell=2.0):
    rows = [(1, i, 0, 0, float(x), float(y), 0.0, 0.0, 0.0, 1, 0.0, True) for i, (x, y) in enumerate(points)]
    out = rd.road_edge_distance(state(spark, rows), corridor(spark, lines), cell=cell, tolerance=tolerance).collect()
    return [r["road_edge_distance"] for r in sorted(out, key=lambda r: r["agent_id"])]


def test_road_edge_goldens(spark):
    assert signed(spark, [[(0, 0), (0, 2)]], [(-1, 1), (2, 1)]) == pytest.approx([-1, 2])
    assert [abs(v) for v in signed(spark, [[(0, 0), (2, 0)]], [(0, 1), (3, -1)])] == pytest.approx([1, math.sqrt(2)])
    points = [(x / 4 - 1, y) for x in range(17) for y in (-30, 0.5, 3)]
    up, down = [(2, -50), (2, 50)], [(0, 50), (0, -50)]
    assert signed(spark, [up, down], points) == pytest.approx([abs(x - 1) - 1 for x, _ in points])


def test_road_edge_far_points_and_seam(spark):
    # A counter-clockwise square: inside is left of every edge, outside is right, corners included.
    square = [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]]
    inside, outside, far = (5, 4), (-3, -4), (-300, -400)
    for cell in (0.5, 2.0, 64.0):
        assert signed(spark, square, [inside, outside, far], cell=cell) == pytest.approx([-4, 5, 500])


def test_road_edge_of_many_segments_equals_the_full_comparison(spark):
    rnd = random.Random(8)
    lines = [[(x0 + 3 * i, y0 + rnd.uniform(-1, 1)) for i in range(rnd.randrange(2, 12))] for x0, y0 in ((rnd.uniform(0, 300), rnd.uniform(0, 300)) for _ in range(40))]
    points = [(rnd.uniform(-50, 350), rnd.uniform(-50, 350)) for _ in range(80)] + [(-9000.0, 4000.0), (lines[0][0])]
    got = signed(spark, lines, points)
    for (px, py), d in zip(points, got, strict=True):
        near = []
        for line in lines:
            for (ax, ay), (bx, by) in zip(line, line[1:]):
                t = min(1.0, max(0.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
                near.append(math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay)))
        assert abs(d) == pytest.approx(min(near), abs=1e-9)
