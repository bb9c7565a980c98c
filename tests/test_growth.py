"""Faults that only larger or odd tables show."""

import io
import math
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from trajlake.functions import scaling as sl
from trajlake.functions.geometry import Box, circle_slack
from trajlake.operators import curation as cu
from trajlake.operators import grid
from trajlake.operators import interaction as ia
from trajlake.operators import roads as rd
from trajlake.operators.sequential import random_baseline
from trajlake.plans import realism as rl
from trajlake.plans.catalog import QUERIES


def test_event_values_beyond_the_range_return(spark, tmp_path):
    rows = spark.sql("select 1L as event_id, timestamp'2024-01-01' as ts, 1L as user_id, 'view' as event_type, 720.0D as value, '{\"k\": 7}' as props")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    r = QUERIES["b22_conditioning_norm"](spark, str(tmp_path)).first()
    assert (r["c0"], r["back"]) == (1.2, 720.0)
    with pytest.raises(Exception, match="outside"):
        spark.range(1).select(sl.conditioning_denorm(F.array(F.lit(1.2)), [(0.0, 600.0)])).collect()


def test_circle_slack_has_the_digits_of_its_formula(spark):
    box = lambda p: Box(*[F.col(p + c) for c in ("x", "y", "length", "width")], F.lit(1.0), F.lit(0.0))
    i = F.col("id")
    cols = {"ax": i * 0.02, "ay": i * 0.04, "alength": F.lit(4.75), "awidth": F.lit(2.0), "bx": i * 0.13, "by": i * 0.31, "blength": F.lit(5.0), "bwidth": F.lit(2.0)}
    df = spark.range(2000).select(*[c.cast("double").alias(k) for k, c in cols.items()])
    root = lambda x, y: math.sqrt(x * x + y * y)
    for r in df.withColumn("s", circle_slack(box("a"), box("b"), 0.0)).collect():
        assert r["s"] == root(r["bx"] - r["ax"], r["by"] - r["ay"]) - (root(4.75, 2.0) / 2 + root(5.0, 2.0) / 2)


def test_a_null_key_on_both_sides_is_the_same_key(spark):
    a, b = (spark.createDataFrame([(k,) for k in keys], "k long") for keys in ([None, 1, 2, 2], [None, 2, 3]))
    assert sorted(cu.same_keys(a, b, ["k"]).collect()) == [(1, "left"), (3, "right")]


def test_pairs_within_range_without_a_filter_on_the_whole_distance(spark):
    i = F.col("id")
    state = spark.range(60).select(
        (i % 3).alias("scenario_id"), F.lit(0).alias("rollout"), F.lit(0).alias("step"), i.alias("agent_id"), (i * 7 % 90).cast("double").alias("x"), (i * 11 % 40).cast("double").alias("y"),
        (i / 9.0).alias("heading"), F.lit(4.0).alias("length"), F.lit(2.0).alias("width"), (i % 4 != 0).alias("valid")).cache()
    listed, searched = (sorted((r["agent_id"], r["other_id"], round(r["distance"], 9)) for r in ia.pairwise_distances(state, 20.0, few=few).collect()) for few in (100, 5))
    assert listed == searched and listed and max(r[2] for r in listed) <= 20.0
    text = io.StringIO()
    with redirect_stdout(text):
        ia.pairwise_distances(state, 20.0).explain()
    assert not [line for line in text.getvalue().splitlines() if "Filter" in line and "sqrt" in line.lower()]


def test_random_baseline_deals_tracks_before_they_are_multiplied(spark):
    log = spark.range(8).select((F.col("id") % 2).alias("scenario_id"), F.col("id").alias("agent_id"), (F.col("id") % 3).alias("step"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("heading"))
    text = io.StringIO()
    with redirect_stdout(text):
        random_baseline(log, 32).explain()
    dealt = [line for line in text.getvalue().splitlines() if "Exchange" in line]
    assert dealt and not [line for line in dealt if "rollout" in line], text.getvalue()


def test_lanes_equally_far_but_for_the_last_bit_are_ranked_by_powers(spark):
    # Points whose nearest spot is the vertex (4, 0) of a bent lane: the product gives a tie, the power of the SQL does not always.
    def roots(x, y):
        ends = [(x - 0.0 - 1.0 * 4.0, y - b - 1.0 * (0.0 - b)) for b in (1 / 7,)] + [(x - 4.0, y - 0.0)]
        return [math.sqrt(a * a + b * b) for a, b in ends], [math.sqrt(math.pow(a, 2.0) + math.pow(b, 2.0)) for a, b in ends]

    points, want = [], {}
    for i in range(60_000):
        x, y = 4.0 + (i % 100) / 1e4, -0.5 - i / 25e3
        product, power = roots(x, y)
        if (product[0] <= product[1]) != (power[0] <= power[1]):
            want[len(points)] = 0 if power[0] <= power[1] else 1
            points.append(("m", len(points), x, y, 0.0))
    assert points, "the platform's pow is exact on all of them"
    lane = [("m", 7, 0, 0.0, 1 / 7, 4.0, 0.0), ("m", 7, 1, 4.0, 0.0, 8.0, 1 / 7)]
    lanes = spark.createDataFrame(lane, "map_id string, polyline_id long, seg_idx long, x0 double, y0 double, x1 double, y1 double")
    lanes = lanes.withColumns({"xp": F.lit(None).cast("double"), "yp": F.lit(None).cast("double")})
    state = spark.createDataFrame(points, "map_id string, agent_id long, x double, y double, heading double")
    got = {r["agent_id"]: int(r["heading_error"] < 0) for r in rd.nearest_lane(state, lanes, ["map_id"], ["agent_id"]).collect()}
    assert got == want


def test_road_features_list_segments_per_cell_before_they_are_multiplied(spark):
    rnd = random.Random(5)
    segs = [(m, p, i, 4 + p % 3, *(rnd.choice([-7.5, 0.0, 2.0, 2.5, 9.9, 31.0]) + rnd.random() for _ in range(4))) for m in ("m", "n") for p in range(9) for i in range(4)]
    egos = [(m, a, rnd.uniform(-12, 40), rnd.uniform(-12, 40), rnd.uniform(-3, 3)) for m in ("m", "none") for a in range(40)] + [("m", 99, None, 1.0, 0.0)]
    segments = spark.createDataFrame(segs, "map_id string, polyline_id long, seg_idx long, road_type int, x0 double, y0 double, x1 double, y1 double")
    state = spark.createDataFrame(egos, "map_id string, agent_id long, x double, y double, heading double")
    cell = lambda v: math.floor(v / 5.0)
    for k in (3, 128):
        got = {}
        for r in rd.road_features(state, segments, ["map_id"], ["map_id", "agent_id"], k=k).collect():
            got[r["map_id"], r["agent_id"], r["slot"]] = (r["polyline_id"], r["seg_idx"], round(r["rel_x"], 9), r["type"])
        want = {}
        for m, a, x, y, h in egos:
            around = []
            for sm, p, i, kind, x0, y0, x1, y1 in segs:
                mx, my = (x0 + x1) / 2, (y0 + y1) / 2
                off = (cell(mx) - cell(x), cell(my) - cell(y)) if x is not None else None
                if sm == m and off in grid.spiral(2):
                    around.append((grid.spiral(2).index(off), p, i, round(((mx - x) * math.cos(h) + (my - y) * math.sin(h)) * 0.02, 9), kind - 4.0))
            want |= {(m, a, n + 1): s[1:] for n, s in enumerate(sorted(around)[:k])}
        assert got == want and max(n for *_, n in got) == min(k, max(n for *_, n in want))
    text = io.StringIO()
    with redirect_stdout(text):
        rd.road_features(state, segments, ["map_id"], ["map_id", "agent_id"]).explain()
    assert not [line for line in text.getvalue().splitlines() if "posexplode" in line and "polyline_id" in line], text.getvalue()


def test_lane_spans_compute_each_cut_once(spark):
    ends = [(0.0, 0.0, 6.0, 1.0), (6.0, 1.0, 5.0, 7.5), (-3.0, 2.0, -3.0, -4.0), (9.0, 9.0, 9.0, 9.0)]
    lanes = spark.createDataFrame([("m", *e) for e in ends], "map_id string, x0 double, y0 double, x1 double, y1 double")

    def near(px, py, ax, ay, bx, by):
        square = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0, min(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / square)) if square else 0
        return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay)) <= 2.25

    spans = rd.lane_spans(lanes, ["map_id"], 0.5, 2.25)
    got = sorted((r["cy"], x) for r in spans.collect() for x in range(r["lo"], r["hi"] + 1))
    assert got == sorted((j, i) for e in ends for i in range(-15, 30) for j in range(-15, 30) if near((i + 0.5) / 2, (j + 0.5) / 2, *e))
    text = io.StringIO()
    with redirect_stdout(text):
        spans.explain()
    assert not [line for line in text.getvalue().splitlines() if "Filter" in line and "sqrt" in line.lower()], text.getvalue()


def test_features_of_dealt_states_are_not_joined_back(spark):
    # F2 to F5: each feature is counted where it is made; the only joins are those with segments and the cells they lie in.
    i = F.col("id")
    log = spark.range(60).select(
        (i % 3).alias("scenario_id"), (i % 3).alias("map_id"), (i % 6).alias("agent_id"), F.expr("id div 6").alias("step"), (i * 7 % 90).cast("double").alias("x"),
        (i * 11 % 40).cast("double").alias("y"), (i / 9.0).alias("heading"), (i % 4 != 0).alias("valid"), F.lit(4.0).alias("length"), F.lit(2.0).alias("width"), F.lit(1).alias("object_type"))
    sim = log.withColumn("rollout", F.lit(0).cast("long")).drop("valid")
    edges = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 90.0, 0.0)], "map_id long, polyline_id long, seg_idx int, x0 double, y0 double, x1 double, y1 double")
    for c in ("xp", "yp", "x2", "y2"):
        edges = edges.withColumn(c, F.lit(None).cast("double"))
    feats = rl.features(rl.stack(sim, log, ["map_id"]), edges, ["map_id"])
    text = io.StringIO()
    with redirect_stdout(text):
        rl.agent_scores(feats).explain()
    joins = [line for line in text.getvalue().splitlines() if "Join" in line]
    assert joins and not [line for line in joins if "agent_id" in line], text.getvalue()


def test_both_neighbour_features_at_once(spark):
    i = F.col("id")
    state = spark.range(240).select(
        F.when(i < 120, 0).when(i < 123, 1).when(i == 123, 2).cast("long").alias("scenario_id"), F.lit(0).alias("rollout"), F.lit(3).alias("step"), i.alias("agent_id"),
        (i * 37 % 101).cast("double").alias("x"), (i * 53 % 29).cast("double").alias("y"), (i % 7 / 10.0).alias("heading"), F.when(i % 50 != 49, 4.0).alias("length"), F.lit(2.0).alias("width"),
        (i % 11 / 1.0).alias("speed"), (i % 5 != 0).alias("valid")).cache()
    cut = lambda v: v if v is None else round(v, 9)
    key = ["scenario_id", "rollout", "step", "agent_id"]
    near = {r["agent_id"]: cut(r["nearest_distance"]) for r in ia.nearest_object(state, few=500).collect()}
    ttc = {r["agent_id"]: cut(r["ttc"]) for r in ia.time_to_collision(state, few=500).collect()}
    assert min(ttc.values()) < ia.MAX_TTC
    got = ia.nearest_and_collision(state, ["valid"], few=500)
    assert got.columns == [*key, "valid", "ttc", "nearest_distance"]
    assert {r["agent_id"]: (cut(r["nearest_distance"]), cut(r["ttc"])) for r in got.collect()} == {a: (near[a], ttc[a]) for a in near}


def test_corners_far_from_the_cell_of_the_middle_find_their_edge(spark):
    # F2 to F5: a row is dealt by the cell of its middle; small cells and one cell for all give the same, for long and for odd rows.
    rng = random.Random(4)
    rows = [("m", 0, k, 0, 0, rng.uniform(-40, 40), rng.uniform(-40, 40), rng.uniform(-3, 3), rng.choice([0.5, 4.5, 25.0]), rng.choice([0.5, 2.0, 9.0])) for k in range(150)]
    rows += [("m", 0, 150, 0, 0, None, 1.0, 0.0, 4.0, 2.0), ("m", 0, 151, 0, 0, 1.0, 1.0, None, 4.0, 2.0), ("m", 0, 152, 0, 0, 1.0, 1.0, 0.0, None, 2.0), (None, 0, 153, 0, 0, 1.0, 1.0, 0.0, 4.0, 2.0), ("none", 0, 154, 0, 0, 1.0, 1.0, 0.0, 4.0, 2.0)]
    state = spark.createDataFrame(rows, "map_id string, scenario_id int, agent_id int, rollout int, step int, x double, y double, heading double, length double, width double")
    lines = [[(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(4)] for _ in range(6)]
    segs = []
    for p, line in enumerate(lines):
        for k in range(3):
            segs.append(("m", p, k, *line[k], *line[k + 1], *(line[k - 1] if k else (None, None)), *(line[k + 2] if k < 2 else (None, None))))
    edges = spark.createDataFrame(segs, "map_id string, polyline_id int, seg_idx int, x0 double, y0 double, x1 double, y1 double, xp double, yp double, x2 double, y2 double")
    got = [sorted((r["agent_id"], r["road_edge_distance"]) for r in rd.road_edge_distance(state, edges, ["map_id"], cell=c).collect()) for c in (4.0, 4000.0)]
    assert got[0] == got[1] and len(got[0]) == 155 and [d for a, d in got[0] if a >= 150] == [None] * 5
