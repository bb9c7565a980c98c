import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.operators import curation as cu
from trajlake.operators import egostate as eg
from trajlake.operators import rollouts as ro
from trajlake.operators import sequential as sq
from trajlake.operators import vectors as ve


def test_stride_restarts_per_segment(spark):
    df = spark.createDataFrame([("a", i) for i in range(4)] + [("b", i) for i in range(3)], "s string, t long")
    assert sorted(map(tuple, cu.stride(df, ["s"], ["t"], 2).collect())) == [("a", 0), ("a", 2), ("b", 0), ("b", 2)]
    assert cu.stride(df, ["s"], ["t"], 2, cap=3).count() == 3


def test_split_is_disjoint_and_deterministic(spark):
    df = spark.createDataFrame([(f"t{t}", f"s{t}_{i}") for t in range(3) for i in range(10)], "town string, segment_id string")
    a = cu.stratified_split(df, 7, 3, 1)
    counts = {(r["town"], r["split"]): r["count"] for r in a.groupBy("town", "split").count().collect()}
    assert counts == {(f"t{t}", s): n for t in range(3) for s, n in (("training", 7), ("validation", 3))}
    assert cu.overlap(a.filter("split = 'training'"), a.filter("split = 'validation'"), ["segment_id"]).isEmpty()
    again = cu.stratified_split(df.repartition(5), 7, 3, 1)
    assert a.exceptAll(again.select(a.columns)).isEmpty()
    with pytest.raises(ValueError):
        cu.stratified_split(df, 9, 3, 1)


def test_seed_is_crc32(spark):
    r = spark.range(1).select(cu.episode_seed(42, "train", F.lit("Town01"), F.lit(7)).alias("s")).first()
    assert r["s"] == zlib.crc32(b"42:train:Town01:7")


def test_conditioning_is_uniform_and_stable(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("segment_id"))
    out = cu.segment_conditioning(df)
    m = np.array([r["conditioning"] for r in out.collect()])
    assert m.shape == (3000, 13) and m.min() >= 0 and m.max() <= 1
    assert np.abs(m[:, :10].mean(0) - 0.5).max() < 0.03
    assert sorted(map(str, out.collect())) == sorted(map(str, cu.segment_conditioning(df.repartition(7)).collect()))


def test_pairing_violations(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    b = spark.createDataFrame([(1,), (3,), (3,), (4,)], "k long")
    got = {r["k"]: r["reason"] for r in cu.pair_strict(a, b, ["k"]).collect()}
    assert got == {2: "unpaired", 3: "paired more than once", 4: "unknown reference"}


def test_join_ego_miss_raises(spark):
    s = spark.createDataFrame([("a", 1), ("a", 2)], "segment_id string, timestamp_micros long")
    e = spark.createDataFrame([("a", 1, [1.0])], "segment_id string, timestamp_micros long, obs array<double>")
    with pytest.raises(Exception, match="no ego row"):
        cu.join_ego(s, e).collect()
    assert cu.join_ego(s, e, strict=False).count() == 1


def test_pending_guards_version(spark):
    src = spark.createDataFrame([(1,), (2,)], "k long")
    done = spark.createDataFrame([(1, 2)], "k long, schema_version int")
    assert [r["k"] for r in cu.pending(src, done, ["k"], 2).collect()] == [2]
    with pytest.raises(ValueError):
        cu.pending(src, done, ["k"], 3)


def test_sample_agents_joint_rows(spark):
    from trajlake.operators.lanes import sample_agents

    rows = spark.createDataFrame([(t, i, float(10 * t + i), float(i)) for t in (1, 2) for i in range(5)], "object_type int, row_idx long, length double, width double")
    types = spark.createDataFrame([(1, 0.75, 5), (2, 0.25, 5)], "object_type int, prob double, count long")
    out = sample_agents(4000, types, rows).collect()
    assert len(out) == 4000 and all(r["length"] == 10 * r["object_type"] + r["width"] for r in out)
    assert abs(sum(r["object_type"] == 1 for r in out) / 4000 - 0.75) < 0.03


def test_dedupe_displacement_goldens(spark):
    def kept(xs, thr):
        df = spark.createDataFrame([("t", i, float(x), 0.0) for i, x in enumerate(xs)], "town string, i long, x double, y double")
        return sorted(r["i"] for r in sq.dedupe_displacement(df, ["town"], ["i"], thr).collect())

    assert kept([0, 70, 70, 110], 25) == [0, 1, 3]
    assert kept([0, 5, 9, 12], 25) == [0]
    assert kept([0, 5, 9, 12], 0) == [0, 1, 2, 3]


def test_dedupe_displacement_equals_the_walk(spark):
    # A drive, a long stay with jitter around a ring that reaches no farther than the threshold, NULL towns and a lone row.
    rnd = random.Random(4)
    tracks, at = {"a": [], None: [], "lone": [(1.0, 1.0)], "ring": []}, [0.0, 0.0]
    for k in range(700):
        stay = 200 < k < 600
        at = [at[0] + rnd.uniform(-0.1, 0.1), at[1]] if stay else [at[0] + rnd.uniform(-3, 9), at[1] + rnd.uniform(-2, 2)]
        tracks["a"].append(tuple(at))
    for k in range(300):
        tracks["ring"].append((11.0 * math.cos(k), 11.0 * math.sin(k)) if k else (0.0, 0.0))
        tracks[None].append((rnd.uniform(0, 40), rnd.uniform(0, 40)))
    rows = [(t, i, x, y) for t, pts in tracks.items() for i, (x, y) in enumerate(pts)]
    got = {(r["town"], r["i"]) for r in sq.dedupe_displacement(spark.createDataFrame(rows, "town string, i long, x double, y double"), ["town"], ["i"], 12.0).collect()}
    want = set()
    for t, pts in tracks.items():
        last = None
        for i, p in enumerate(pts):
            if last is None or math.dist(p, last) >= 12.0:
                last = p
                want.add((t, i))
    assert got == want


def test_track_route_monotone(spark):
    route = spark.createDataFrame([("e", i, 2.0 * i, 0.0, i in (3, 9)) for i in range(10)], "ep string, pt_idx long, x double, y double, is_goal boolean")
    pose = spark.createDataFrame([("e", t, x, 1.0) for t, x in enumerate([0.0, 5.9, 4.0, 18.0])], "ep string, t long, x double, y double")
    out = sorted(sq.track_route(pose, route, ["ep"], "t", radius=1.0).collect(), key=lambda r: r["t"])
    assert [r["route_index"] for r in out] == [0, 3, 3, 9]
    assert [r["goal_cursor"] for r in out] == [0, 1, 1, 1]
    assert out[-1]["completion"] == 1.0 and out[2]["deviation"] == pytest.approx(1.0)


def test_track_route_streams_long_drives_and_keeps_poses_without_a_route(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        route = spark.createDataFrame([(e, i, 2.0 * i, 0.0, i % 40 == 39) for e in ("e", "f") for i in range(300)] + [("g", 0, 0.0, 0.0, False)], "ep string, pt_idx long, x double, y double, is_goal boolean")
        pose = spark.createDataFrame([(e, t, 1.1 * t + (0.3 if e == "f" else 0.0), 1.0) for e in ("e", "f", "g", None) for t in range(400)], "ep string, t long, x double, y double")
        out = sq.track_route(pose, route, ["ep"], "t", radius=1.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == 1600 and all(r["route_index"] is None and r["completion"] is None for r in out if r["ep"] in ("g", None))
    for e, shift in (("e", 0.0), ("f", 0.3)):
        mine = sorted((r for r in out if r["ep"] == e), key=lambda r: r["t"])
        want = [min(299, math.floor((1.1 * t + shift) / 2 + 0.5 - 1e-9)) for t in range(400)]
        assert all(abs(r["route_index"] - w) <= 1 for r, w in zip(mine, want, strict=True))
        assert [r["goal_cursor"] for r in mine] == [sum(2.0 * g - 1.0 <= 2.0 * r["route_index"] for g in range(39, 299, 40)) for r in mine]


def ego(spark, poses, **kw):
    rows = [("s", int(1e5 * i), [math.cos(h), -math.sin(h), 0.0, x, math.sin(h), math.cos(h), 0.0, y, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]) for i, (x, y, h) in enumerate(poses)]
    df = spark.createDataFrame(rows, "segment_id string, timestamp_micros long, pose array<double>")
    out = eg.ego_observations(df, ["segment_id"], 4.5, 2.0, **kw).orderBy("timestamp_micros").collect()
    return np.array([r["obs"] for r in out])


def test_ego_vector_goldens(spark):
    straight = ego(spark, [(1.2 * i, 0.0, 0.0) for i in range(60)])
    assert straight[0, 0] / 0.005 == pytest.approx(30.0) and straight[0, 1] == pytest.approx(0) and straight[5, 2] * 100 == pytest.approx(12.0)
    assert abs(straight[:, 6]).max() < 1e-12
    still = ego(spark, [(5.0, 3.0, 0.5)] * 8)
    assert still[:, 0] / 0.005 == pytest.approx([30.0] * 8) and abs(still[:, 1]).max() < 1e-12
    assert ego(spark, [(0.0, 0.0, 0.0)])[0, 2] == 0
    end = ego(spark, [(1.0 * i, 0.0, 0.0) for i in range(10)], axle=0.0, goal_mode="endpoint")
    assert end[:, 0] / 0.005 == pytest.approx([9.0 - i for i in range(10)])


def test_gradient_and_unwrap_match_numpy(spark):
    from pyspark.sql import Window

    rnd = np.random.default_rng(0)
    t = np.cumsum(rnd.uniform(0.05, 0.2, 40))
    a = (np.cumsum(rnd.uniform(-1.5, 2.5, 40)) + np.pi) % (2 * np.pi) - np.pi
    df = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(zip(t, a))], "k long, i long, t double, a double")
    df = eg.unwrap(df, "a", ["k"], "i", "u").withColumn("g", eg.gradient(F.col("a"), F.col("t"), Window.partitionBy("k").orderBy("i")))
    out = sorted(df.collect(), key=lambda r: r["i"])
    assert [r["u"] for r in out] == pytest.approx(np.unwrap(a).tolist())
    assert [r["g"] for r in out] == pytest.approx(np.gradient(a, t).tolist())


def test_within_segment_r2(spark):
    rnd = np.random.default_rng(1)
    target = rnd.normal(size=(40, 8))
    seg = np.repeat(np.arange(4), 10)
    offset = target + rnd.normal(size=(4, 8))[seg]
    means = np.stack([target[seg == s].mean(0) for s in seg])

    def r2(pred):
        rows = [(int(s), p.tolist(), t.tolist()) for s, p, t in zip(seg, pred, target)]
        return ve.within_segment_r2(spark.createDataFrame(rows, "segment long, pred array<double>, target array<double>"), "segment").first()["r2"]

    assert r2(offset) == pytest.approx(1.0) and r2(means) == pytest.approx(0.0, abs=1e-9)


def test_advantage_recursion(spark):
    rnd = random.Random(9)
    rows = [(s, t, rnd.random(), rnd.uniform(-1, 1), float(rnd.random() < 0.2), rnd.uniform(0.5, 1.5)) for s in range(5) for t in range(16)]
    df = spark.createDataFrame(rows, "segment long, t long, value double, reward double, terminal double, ratio double")
    got = {(r["segment"], r["t"]): r["advantage"] for r in ro.clipped_advantage(df).collect()}
    for s in range(5):
        seg = [r for r in rows if r[0] == s]
        adv = 0.0
        for t in range(15, -1, -1):
            if t == 15:
                adv = 0.0
            else:
                live = 1 - seg[t + 1][4]
                delta = min(seg[t][5], 1) * (seg[t + 1][3] + 0.98 * seg[t + 1][2] * live - seg[t][2])
                adv = delta + 0.98 * 0.95 * min(seg[t][5], 1) * live * adv
            assert got[(s, t)] == pytest.approx(adv)


def test_prioritized_sample_prefers_heavy_segments(spark):
    df = spark.createDataFrame([(s, 100.0 if s < 10 else 0.1) for s in range(200)], "segment long, advantage double")
    out = ro.prioritized_sample(df, 12).collect()
    assert len({r["segment"] for r in out}) == 12 and sum(r["segment"] < 10 for r in out) >= 7


def test_random_baseline_is_partition_independent(spark):
    log = spark.createDataFrame([(1, a, t, 5.0 * a, 0.0, 0.3) for a in range(3) for t in range(12)], "scenario_id long, agent_id long, step long, x double, y double, heading double")
    a, b = sq.random_baseline(log, 2), sq.random_baseline(log.repartition(5), 2)
    assert a.exceptAll(b).isEmpty()
    start = a.filter("step = 0").collect()
    assert all(r["x"] == 5.0 * r["agent_id"] and r["heading"] == 0.3 for r in start) and a.count() == 72


def test_gated_batches_equal_the_fold(spark):
    rnd = random.Random(31)
    rows = [(k, b, rnd.uniform(-5, 5)) for k in ("a", "b", None) for b in range(60) for _ in range(rnd.choice([0, 1, 1, 2, 9]))] + [("short", 1, 1.0)]
    out = sq.gated_batches(spark.createDataFrame(rows, "k string, b long, v double"), ["k"], "b", ["v"], 12).collect()
    want = {}
    for k in ("a", "b", None):
        held = []
        for b in range(60):
            held += [v for key, at, v in rows if key == k and at == b]
            if len(held) >= 12 and any(key == k and at == b for key, at, _ in rows):
                want[(k, b)] = (len(held), sum(held) / len(held))
                held = []
    assert {(r["k"], r["b"]): r["n"] for r in out} == {key: n for key, (n, _) in want.items()} and len(out) == len(want)
    assert all(r["v"] == pytest.approx(want[(r["k"], r["b"])][1]) for r in out)
