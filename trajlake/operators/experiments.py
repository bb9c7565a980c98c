"""Experiment logs: reprints, last-N and block summaries, comparisons, downsampling, Pareto front, upsert."""

from __future__ import annotations

from math import cos, hypot, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.operators.ordered import null_safe_join, prefix_scan, with_index, with_neighbours, with_previous


def dedupe_reprints(metric_log: DataFrame, by: list[str], order: list[str], metrics: list[str], bucket: Column | None = None) -> DataFrame:
    """Rows whose metric vector differs from the row before (reprinted lines carry no information)."""
    prev = {f"_p_{m}": m for m in metrics} | {"_has": "_one"}
    lagged = with_previous(metric_log.withColumn("_one", F.lit(1)), by, order, prev, bucket=bucket)
    same = F.col("_has").isNotNull()
    for m in metrics:
        same = same & F.col(m).eqNullSafe(F.col(f"_p_{m}"))
    return lagged.filter(~same).select(*metric_log.columns)


def repeat_factor(metric_log: DataFrame, kept: DataFrame, by: list[str]) -> DataFrame:
    a = metric_log.groupBy(*by).agg(F.count("*").alias("rows"))
    return null_safe_join(a, kept.groupBy(*by).agg(F.count("*").alias("kept")), by).withColumn("repeat_factor", F.col("rows") / F.col("kept"))


def _from_end(metric_log: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds ``_back``, the position from the end (0 for the newest row of a run); epochs may have gaps."""
    placed = with_index(metric_log, by, [order], "_i", total="_n")
    return placed.withColumn("_back", F.col("_n") - 1 - F.col("_i")).drop("_i")


def last_n_summary(metric_log: DataFrame, by: list[str], value: str, n: int = 300, order: str = "epoch") -> DataFrame:
    return _from_end(metric_log, by, order).filter(F.col("_back") < n).groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n")
    )


def block_means(metric_log: DataFrame, by: list[str], value: str, n: int = 100, k: int = 6, order: str = "epoch") -> DataFrame:
    """Means of the last k blocks of n rows, block 0 the newest."""
    back = _from_end(metric_log, by, order).withColumn("block", F.floor(F.col("_back") / n))
    return back.filter(F.col("block") < k).groupBy(*by, "block").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def ranges_overlap(blocks: DataFrame, by: str, base: str) -> DataFrame:
    """Whether the block ranges of each run and of the base run overlap."""
    span = blocks.groupBy(by).agg(F.min("mean").alias("low"), F.max("mean").alias("high"))
    ref = span.filter(F.col(by) == base).select(F.col("low").alias("_l"), F.col("high").alias("_h"))  # one row
    return span.join(F.broadcast(ref), F.lit(True)).select(by, "low", "high", ((F.col("low") <= F.col("_h")) & (F.col("_l") <= F.col("high"))).alias("overlaps"))


def compare_runs(metric_log: DataFrame, base: str, value: str, run: str = "run", on: list[str] = ["epoch"], steps: str | None = None) -> DataFrame:
    """Every run against the base run at matched epochs: difference and ratio.

    Counts grow with the length of what they were counted over: with ``steps`` they are compared per 100 steps
    (NULL where a run has none).
    """
    if steps is not None:
        metric_log = metric_log.withColumn(value, F.when(F.col(steps) > 0, F.col(value) * 100.0 / F.col(steps)))
    ref = metric_log.filter(F.col(run) == base).select(*on, F.col(value).alias("base_value"))
    j = metric_log.filter(F.col(run) != base).join(ref, on)
    return j.withColumns(
        {"delta": F.col(value) - F.col("base_value"), "ratio": F.when(F.col("base_value") != 0, F.col(value) / F.col("base_value"))}
    )


def downsample(metric_log: DataFrame, by: list[str], value: str, m: int, order: str = "epoch") -> DataFrame:
    """m bucket means plus the last value; rows that do not fill the buckets are dropped at the start.

    Buckets follow the position in the series, so epochs may have gaps; series of at most m rows stay as they are.
    """
    j = _from_end(metric_log, by, order)
    size = F.floor((F.col("_n") - 1) / m)
    back = F.col("_back")
    # From the end: 0 is the last value, then m buckets of equal size.
    bucket = F.when(back == 0, m).otherwise(m - 1 - F.floor((back - 1) / size))
    short = F.col("_n") <= m
    pos = F.when(short, F.col("_n") - 1 - back).otherwise(bucket)
    return j.withColumn("bucket", pos.cast("long")).filter(F.col("bucket") >= 0).groupBy(*by, "bucket").agg(F.avg(value).alias("value"))


def pareto_front(run_obs: DataFrame, eps: float = 1e-6, keep_ties: bool = False) -> DataFrame:
    """Rows no other row beats: score_j + eps > score_i and cost_j - eps < cost_i.

    Sort-based instead of pairwise: in cost order, a row is dominated when the second best score among all
    rows cheaper than its cost + eps (it is one of them itself) still exceeds its score - eps.  Rows and
    their look-ups at cost + eps are two kinds of events of one scan, look-ups first at equal position.
    With ``keep_ties`` a row only loses to a strictly better one.
    """
    if keep_ties:
        return _strict_front(run_obs)
    key = [c for c in run_obs.columns]
    rows = run_obs.withColumns({"_pos": F.col("cost"), "_kind": F.lit(1)})
    asks = run_obs.withColumns({"_pos": F.col("cost") + eps, "_kind": F.lit(0)})
    events = rows.unionByName(asks)
    score = F.when(F.col("_kind") == 1, F.col("score"))
    order = ["_pos", "_kind", *key]
    best = prefix_scan(events, [], order, {"_best": ("max", score)}, exclusive=True)
    # The runner-up so far is the largest of the losers of each meeting with the best before it.
    loser = F.when(F.col("_kind") == 1, F.when(F.col("_best").isNotNull(), F.least(F.col("score"), F.col("_best"))))
    second = prefix_scan(best, [], order, {"_second": ("max", loser)})
    beaten = F.coalesce(F.col("_second") + eps > F.col("score"), F.lit(False))
    return second.filter((F.col("_kind") == 0) & ~beaten).select(*key)


def _strict_front(run_obs: DataFrame) -> DataFrame:
    top = run_obs.groupBy("cost").agg(F.max("score").alias("_top"))
    front = prefix_scan(top, [], ["cost"], {"_before": ("max", F.col("_top"))}, exclusive=True)
    front = front.filter(F.col("_before").isNull() | (F.col("_top") > F.col("_before")))
    return run_obs.join(front.select("cost", F.col("_top").alias("score")), ["cost", "score"], "left_semi")


def pareto_gap(front: DataFrame, log: bool = False) -> DataFrame:
    """The front point whose nearest neighbour in (log) cost is farthest away; ties go to the lower cost."""
    pos = F.ln("cost") if log else F.col("cost")
    keyed = front.withColumn("_c", pos)
    near = with_neighbours(keyed, [], ["_c", *front.columns], {"_p": "_c"}, {"_q": "_c"})
    near = near.withColumns({"_a": F.col("_c") - F.col("_p"), "_b": F.col("_q") - F.col("_c")})
    gap = F.least(F.coalesce("_a", F.lit(float("inf"))), F.coalesce("_b", F.lit(float("inf"))))
    return near.withColumn("gap", gap).agg(F.max_by(F.struct(*front.columns, "gap"), F.struct(F.col("gap"), -F.col("_c"))).alias("_r")).select("_r.*")


def _extended(lists: Column, options: Column) -> Column:
    """Each list with each option appended."""
    return F.flatten(F.transform(lists, lambda head: F.transform(options, lambda x: F.concat(head, F.array(x)))))


def upsert_runs(run_obs: DataFrame, params: list[str], seq: str, within: float = 1e-6) -> DataFrame:
    """Observations in the order of ``seq`` (unique), each replacing all earlier ones less than ``within`` away.

    Distance is Euclidean over ``params``.  A projection to a line brings no two points farther apart, so near points lie
    in the same or in touching cells along any line: rows meet on the cells of at most two lines (the coordinates
    themselves, or two slanted lines through all of them), nine cells a point for any number of parameters, and the full
    distance decides.  Of equal points only the last is left by then.
    """
    run_obs = run_obs.groupBy(*params).agg(F.max_by(F.struct(*run_obs.columns), seq).alias("_r")).select("_r.*")
    if len(params) > 2:
        slants = [[cos(i + 1.0) for i in range(len(params))], [sin(2.0 * i + 1.0) for i in range(len(params))]]
        lines = [sum(F.col(p) * (w / hypot(*slant)) for p, w in zip(params, slant, strict=True)) for slant in slants]
    else:
        lines = [F.col(p) for p in params]
    cells = [F.floor(x / (2 * within)) for x in lines]  # twice as wide as needed, which covers rounding
    beside = [F.array(*[c + d for d in (-1, 0, 1)]) for c in cells]
    around = F.transform(beside[0], lambda x: F.array(x))
    for options in beside[1:]:
        around = _extended(around, options)
    later = run_obs.select(F.col(seq).alias("_s"), *[F.col(p).alias(f"_p{i}") for i, p in enumerate(params)], F.array(*cells).alias("_cell"))
    early = run_obs.withColumn("_around", F.explode(around))
    apart = F.sqrt(sum((F.col(p) - F.col(f"_p{i}")) ** 2 for i, p in enumerate(params)))
    beaten = early.join(later, (F.col("_around") == F.col("_cell")) & (F.col("_s") > F.col(seq)) & (apart < within), "left_semi").select(F.col(seq).alias("_gone"))
    return run_obs.join(beaten.distinct(), F.col(seq) == F.col("_gone"), "left_anti")
