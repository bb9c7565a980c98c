"""Scenes of a few agents are compared where they lie; larger ones go to the spatial search; both give the same."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from trajlake.operators import interaction as ia
from trajlake.operators import roads as rd


def states(spark, n=240):
    """Scene 0 holds half of the agents, scene 1 three, scene 2 one, and a scene without a name the rest."""
    i = F.col("id")
    scene = F.when(i < n // 2, 0).when(i < n // 2 + 3, 1).when(i == n // 2 + 3, 2)
    return spark.range(n).select(
        scene.cast("long").alias("scenario_id"), F.lit(0).alias("rollout"), F.lit(3).alias("step"), i.alias("agent_id"), (i * 37 % 101).cast("double").alias("x"),
        (i * 53 % 29).cast("double").alias("y"), (i % 7 / 10.0).alias("heading"), F.lit(4.0).alias("length"), F.lit(2.0).alias("width"),
        (i % 11 / 1.0).alias("speed"), (i % 5 != 0).alias("valid"))


def rows(df, value):
    return sorted((r["agent_id"], r[value] if r[value] is None else round(r[value], 9)) for r in df.select("agent_id", value).collect())


def test_small_and_large_scenes_agree_with_the_search(spark):
    state = states(spark).cache()
    for fn, value in ((ia.nearest_object, "nearest_distance"), (ia.time_to_collision, "ttc")):
        want = rows(fn(state, few=0), value)
        assert len(want) == 240
        assert rows(fn(state, few=2), value) == want  # scene 0 and 1 searched
        assert rows(fn(state, few=8), value) == want  # scene 0 searched
        assert rows(fn(state, few=500), value) == want  # all listed


def shuffles(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain()
    return text.getvalue().count("Exchange hashpartitioning")


def test_neighbours_of_dealt_states_need_no_further_shuffle(spark):
    # The two sides of the join back and no search (c05, c06 and the realism evaluation).
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = states(spark).filter("agent_id >= 120").repartition("scenario_id")
        assert shuffles(ia.nearest_object(dealt)) <= 4
        assert shuffles(ia.time_to_collision(dealt)) <= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_edge_candidates_are_reduced_where_they_meet(spark):
    # After the look-up by cell, rows are dealt once more, by state, for the largest corner (c07).
    edges = spark.createDataFrame([("m", 0, 0, 0.0, 0.0, 9.0, 0.0), ("m", 1, 0, 0.0, 9.0, 9.0, 9.0)], "map_id string, polyline_id int, seg_idx int, x0 double, y0 double, x1 double, y1 double")
    for c in ("xp", "yp", "x2", "y2"):
        edges = edges.withColumn(c, F.lit(None).cast("double"))
    state = states(spark).withColumn("map_id", F.lit("m"))
    text = io.StringIO()
    with redirect_stdout(text):
        rd.road_edge_distance(state, edges, ["map_id"]).explain()
    assert "hashpartitioning(scenario_id" in text.getvalue()
    assert not [line for line in text.getvalue().splitlines() if "Exchange" in line and "corner" in line]


def test_only_lonely_agents_of_a_crowd_need_the_nearest_search(spark, monkeypatch):
    i = F.col("id")
    # Three hundred agents in company (some invalid, some without a length), two far from all others, and one place taken twice.
    place = lambda a, b: F.when(i >= 300, (i - 299) * 700.0).when(i == 7, F.lit(a)).when(i == 8, F.lit(a)).otherwise(b)
    state = spark.range(302).select(
        F.lit(1).alias("scenario_id"), F.lit(0).alias("rollout"), F.lit(0).alias("step"), i.alias("agent_id"), place(3.0, (i * 37 % 101).cast("double")).alias("x"),
        place(5.0, (i * 53 % 61).cast("double")).alias("y"), (i % 9 / 4.0).alias("heading"), F.when(i % 50 != 49, 1.0 + i % 4).alias("length"), F.lit(1.5).alias("width"), (i % 3 != 0).alias("valid")).cache()
    seen, search = [], ia.nearest_candidates

    def counted(points, *args, **more):
        seen.append(points.count())
        return search(points, *args, **more)

    monkeypatch.setattr(ia, "nearest_candidates", counted)
    want = rows(ia.nearest_object(state, few=500), "nearest_distance")
    assert rows(ia.nearest_object(state, few=0), "nearest_distance") == want and seen[0] < 30
    assert {a for a, d in want if d is None} == {a for a in range(302) if a % 50 == 49}
    assert [d > 500 for a, d in want if a >= 300] == [True, True]
