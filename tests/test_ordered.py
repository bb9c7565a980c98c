import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from trajlake.operators import experiments as ex
from trajlake.operators.episodes import episodes_from_steps, nonfinite_runs
from trajlake.operators.ordered import exact_quantiles, null_safe_join, prefix_scan, with_index, with_neighbours, with_previous


def hot(spark, n=900):
    """One group holds more than half of the rows, another one is NULL."""
    rnd = random.Random(1)
    group = lambda: "hot" if rnd.random() < 0.6 else None if rnd.random() < 0.3 else f"k{rnd.randrange(20)}"
    rows = [(group(), i, rnd.randrange(1000), rnd.uniform(0, 1) if rnd.random() < 0.9 else None) for i in range(n)]
    return spark.createDataFrame(rows, "k string, id long, o long, v double")


def buckets():
    return [None, F.expr("o div 100"), F.lit(0)]


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    a = a.select(*b.columns)
    assert a.count() == b.count() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def window(by):
    return Window.partitionBy(*by).orderBy("o", "id")


def test_index_equals_window_also_for_hot_and_null_groups(spark):
    df = hot(spark)
    for by in (["k"], []):
        want = df.withColumns({"idx": (F.row_number().over(window(by)) - 1).cast("long"), "n": F.count("*").over(Window.partitionBy(*by))})
        for bucket in buckets():
            same(with_index(df, by, ["o", "id"], bucket=bucket, total="n"), want)


def test_scans_equal_windows_also_for_hot_and_null_groups(spark):
    df = hot(spark)
    scans = {"s": ("sum", F.col("id")), "m": ("max", F.col("o")), "a": ("min", F.col("v")), "l": ("last", F.col("v"))}
    for exclusive in (False, True):
        w = window(["k"]).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        want = df.withColumns({"s": F.sum("id").over(w), "m": F.max("o").over(w), "a": F.min("v").over(w), "l": F.last("v", ignorenulls=True).over(w)})
        for bucket in buckets():
            same(prefix_scan(df, ["k"], ["o", "id"], scans, exclusive, bucket=bucket), want)


def test_neighbours_equal_windows_also_for_hot_and_null_groups(spark):
    df = hot(spark)
    w = window(["k"])
    want = df.withColumns({"p": F.lag("id").over(w), "q": F.lag("v").over(w), "z": F.lead("v").over(w)})
    for bucket in buckets():
        same(with_neighbours(df, ["k"], ["o", "id"], {"p": "id", "q": "v"}, {"z": "v"}, bucket=bucket), want)
        same(with_previous(df, ["k"], ["o", "id"], {"p": "id"}, bucket=bucket), want.select(*df.columns, "p"))


def test_null_safe_join(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2), ("y", 3)], "k string, v long")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, w long")
    assert sorted((str(r["k"]), r["v"], r["w"]) for r in null_safe_join(a, b, ["k"]).collect()) == [("None", 1, 10), ("x", 2, 20)]
    assert null_safe_join(a, b, ["k"], "left").count() == 3


def test_single_rows_and_empty_tables(spark):
    df = hot(spark).limit(0)
    assert with_index(df, ["k"], ["o", "id"]).count() == 0
    assert with_previous(df, [], ["o", "id"], {"p": "id"}).count() == 0


def test_tails_count_rows_not_epochs(spark):
    log = spark.createDataFrame([("a", 10 * i, float(i)) for i in range(50)] + [(None, 7 * i, 1.0) for i in range(8)], "run string, epoch long, metric double")
    got = {r["run"]: (r["mean"], r["n"]) for r in ex.last_n_summary(log, ["run"], "metric", n=5).collect()}
    assert got == {"a": (47.0, 5), None: (1.0, 5)}
    blocks = {(r["run"], r["block"]): (r["mean"], r["n"]) for r in ex.block_means(log, ["run"], "metric", n=5, k=2).collect()}
    assert blocks[("a", 0)] == (47.0, 5) and blocks[("a", 1)] == (42.0, 5) and blocks[(None, 1)] == (1.0, 3)
    assert ex.downsample(log, ["run"], "metric", 5).filter("run = 'a'").count() == 6


def test_upsert_by_distance(spark):
    rows = [(1, 1e-6 - 1e-8, 0.0), (2, 1e-6 + 1e-8, 0.0), (3, 5.0, 5.0), (4, 5.0, 5.0), (5, 1.0, 0.0), (6, 1.0 + 7e-7, 0.0), (7, 1.0 + 1.4e-6, 0.0), (8, 5.0, 5.0 + 2e-6)]
    got = {r["s"] for r in ex.upsert_runs(spark.createDataFrame(rows, "s long, a double, b double"), ["a", "b"], "s").collect()}
    kept = {s for s, a, b in rows if not any(t > s and ((a - c) ** 2 + (b - d) ** 2) ** 0.5 < 1e-6 for t, c, d in rows)}
    assert got == kept == {2, 4, 7, 8}


def test_upsert_with_a_dozen_parameters(spark):
    rnd = random.Random(12)
    names, rows = [f"p{i}" for i in range(12)], []
    for base in range(40):
        centre = [rnd.choice([0.0, 1.0, rnd.random()]) for _ in names]
        for _ in range(4):
            step = [rnd.gauss(0, 1) for _ in names]
            scale = rnd.choice([0.5e-6, 0.99e-6, 1.01e-6, 3e-6]) / sum(v * v for v in step) ** 0.5
            rows.append((len(rows), *[c + v * scale for c, v in zip(centre, step, strict=True)]))
    got = {r["s"] for r in ex.upsert_runs(spark.createDataFrame(rows, "s long, " + ", ".join(f"{n} double" for n in names)), names, "s").collect()}
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a[1:], b[1:], strict=True)) ** 0.5
    assert got == {a[0] for a in rows if not any(b[0] > a[0] and gap(a, b) < 1e-6 for b in rows)} and len(got) < len(rows)


def test_pareto_matches_pairwise_definition(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([1.0, 2.0, 2.0 + 5e-7, 3.0, rnd.random() * 4]), rnd.choice([1.0, 1.0 + 5e-7, 2.0, rnd.random() * 3])) for i in range(120)] + [(500, 9.0, 0.5)]
    eps = 1e-6
    want = {a[0] for a in rows if not any(b[0] != a[0] and b[1] + eps > a[1] and b[2] - eps < a[2] for b in rows)}
    front = ex.pareto_front(spark.createDataFrame(rows, "run long, score double, cost double"))
    assert {r["run"] for r in front.collect()} == want


def test_downsample_short_and_long(spark):
    log = spark.createDataFrame([("a", i + 1, float(i)) for i in range(12)] + [("b", i + 1, float(i)) for i in range(3)], "run string, epoch long, metric double")
    out = {(r["run"], r["bucket"]): r["value"] for r in ex.downsample(log, ["run"], "metric", 5).collect()}
    # 11 values before the last: the first is dropped, five buckets of two, then the last value.
    assert [out[("a", i)] for i in range(6)] == [1.5, 3.5, 5.5, 7.5, 9.5, 11.0]
    assert [out[("b", i)] for i in range(3)] == [0.0, 1.0, 2.0]


def test_episode_and_nonfinite_runs(spark):
    steps = spark.createDataFrame([("a", i, 1.0, int(i in (2, 3)), 0) for i in range(6)], "k string, t long, reward double, terminal int, truncation int")
    got = sorted((r["episode"], r["episode_return"], r["episode_length"]) for r in episodes_from_steps(steps, ["k"], ["t"]).collect())
    assert got == [(0, 3.0, 3), (1, 1.0, 1)]
    bad = float("nan")
    ups = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, bad, bad, 2.0, bad, float("inf"), bad])], "k string, t long, loss double")
    r = nonfinite_runs(ups, ["k"], ["t"], "loss").first()
    assert (r["nonfinite_updates"], r["longest_run"], r["current_run"]) == (5, 3, 3)


def test_exact_quantiles_on_hot_groups(spark):
    df = hot(spark)
    qs = {"p1": 0.01, "p50": 0.5, "p99": 0.99}
    rows = [r for r in df.collect() if r["v"] is not None]
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", ["id"], qs).collect()}
    assert set(got) == {r["k"] for r in rows}
    for k in got:
        v = [r["v"] for r in rows if r["k"] == k]
        for name, q in qs.items():
            assert abs(got[k][name] - np.quantile(v, q)) < 1e-12
