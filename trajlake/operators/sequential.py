"""Operators whose next step depends on the last one: pointers that double, and folds in one pass over sorted rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlake.operators.ordered import prefix_scan, with_index, with_previous
from trajlake.session import cut_lineage

FAN = 16


def first_far(rows: DataFrame, threshold: float, x: str, y: str) -> DataFrame:
    """(_group, _i, _next): for each row the first later row of its group at least ``threshold`` away, if any.

    ``rows`` has ``_group`` and a dense position ``_i``.  Blocks of ``FAN`` rows, of ``FAN`` blocks and so on have bounding
    boxes.  Each row looks along the siblings after it, climbs where they all lie within the threshold, and descends into
    the first one that reaches beyond it; single rows are the lowest blocks, so the answer is exact.  All rows move
    at once, and the rounds follow the logarithm of how far ahead the answers lie.
    """
    depth, last = 0, rows.agg(F.max("_i")).first()[0] or 0
    while last >= FAN ** (depth + 1):
        depth += 1
    point = rows.select("_group", F.col("_i").alias("_block"), F.lit(0).alias("_level"), *[F.col(c).cast("double").alias(n) for n, c in (("_x0", x), ("_x1", x), ("_y0", y), ("_y1", y))])
    levels, low = [point], point
    for level in range(1, depth + 1):
        low = cut_lineage(low.groupBy("_group", F.expr(f"_block div {FAN}").alias("_block")).agg(*[f(c).alias(c) for f, c in ((F.min, "_x0"), (F.max, "_x1"), (F.min, "_y0"), (F.max, "_y1"))]))
        levels.append(low.select("_group", "_block", F.lit(level).alias("_level"), "_x0", "_x1", "_y0", "_y1"))
    blocks = levels[0]
    for more in levels[1:]:
        blocks = blocks.union(more)
    names = {"_group": "_g", "_block": "_b", "_level": "_l"}
    blocks = cut_lineage(blocks).withColumnsRenamed(names)
    state = rows.select("_group", "_i", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), (F.col("_i") + 1).alias("_at"), F.lit(0).alias("_level"))
    done = []
    wide = lambda lo, hi, at: F.greatest(F.abs(F.col(lo) - F.col(at)), F.abs(F.col(hi) - F.col(at)))
    while True:
        look = state.withColumn("_block", F.explode(F.sequence("_at", F.expr(f"(_at div {FAN}) * {FAN} + {FAN - 1}"))))
        met = look.join(blocks, (F.col("_group") == F.col("_g")) & (F.col("_level") == F.col("_l")) & (F.col("_block") == F.col("_b")))
        reach = F.pow(wide("_x0", "_x1", "_x"), F.lit(2)) + F.pow(wide("_y0", "_y1", "_y"), F.lit(2)) >= threshold * threshold
        seen = met.groupBy(*state.columns).agg(F.min(F.when(reach, F.col("_block"))).alias("_hit"))
        down, up = F.col("_hit").isNotNull(), F.expr(f"_at div {FAN} + 1")
        moved = cut_lineage(seen.select(
            "_group", "_i", "_x", "_y", F.when(down & (F.col("_level") == 0), F.col("_hit")).alias("_next"),
            F.when(down, F.col("_hit") * FAN).otherwise(up).alias("_at"), F.when(down, F.col("_level") - 1).otherwise(F.col("_level") + 1).alias("_level"),
        ))
        done.append(moved.filter("_next is not null").select("_group", "_i", "_next"))
        # Whoever saw no block at all is past the end of the group; above the last level nothing is left either.
        state = moved.filter((F.col("_next").isNull()) & (F.col("_level") <= depth)).drop("_next")
        if state.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def orbit(pointers: DataFrame) -> DataFrame:
    """(_group, _i) of all rows that position 0 of each group leads to, by pointers that double in length each round."""
    jump = cut_lineage(pointers)
    reached = cut_lineage(pointers.filter("_i = 0").select("_group", "_i"))
    while True:
        landed = reached.join(jump, ["_group", "_i"]).select("_group", F.col("_next").alias("_i"))
        reached = cut_lineage(reached.union(landed))
        onward = jump.select(F.col("_group").alias("_g"), F.col("_i").alias("_b"), F.col("_next").alias("_further"))
        jump = cut_lineage(jump.join(onward, (F.col("_group") == F.col("_g")) & (F.col("_next") == F.col("_b"))).select("_group", "_i", F.col("_further").alias("_next")))
        if jump.filter("_i = 0").isEmpty():
            return reached


def dedupe_displacement(df: DataFrame, by: list[str], order: list[str], threshold: float, x: str = "x", y: str = "y") -> DataFrame:
    """Rows that moved at least ``threshold`` since the last *kept* row of their group; <= 0 keeps all.

    Kept are the first row and then always the first later row at least ``threshold`` away from the last kept one: the
    orbit of a pointer that every row has.  Pointers come from ``first_far``, their orbit from doubling; rounds grow
    with logarithms, groups may have any size, and NULL is a group like any other.  A row without a position
    is never far from another, so it is kept only where it comes first, and then alone.
    """
    if threshold <= 0:
        return df
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    rows = cut_lineage(with_index(df, by, order, "_i").withColumn("_group", group))
    kept = orbit(first_far(rows.select("_group", "_i", x, y), threshold, x, y)).withColumnsRenamed({"_group": "_g", "_i": "_b"})
    # A group whose first row has no far row after it has no pointer: that row is kept all the same.
    met = rows.join(kept, (F.col("_group") == F.col("_g")) & (F.col("_i") == F.col("_b")), "left")
    return met.filter((F.col("_i") == 0) | F.col("_b").isNotNull()).select(*df.columns)


def gated_batches(df: DataFrame, key: list[str], batch: str, metrics: list[str], n: int) -> DataFrame:
    """What the count gate of a stream gives out, over a whole table: ``batch`` orders its micro-batches.

    Counts and sums of a key grow until a batch ends with at least ``n`` rows since the last output; then their means go
    out and they start again.  Each batch points to the batch where a count begun after it would go out, found by
    merging running counts with running counts plus ``n``, and the outputs are the orbit of the start.  What is left
    over at the end goes out nowhere, as in the stream.
    """
    group = F.struct(*[F.col(c) for c in key])
    per = df.groupBy(*key, batch).agg(F.count("*").alias("_n"), *[F.sum(m).cast("double").alias(f"_s_{m}") for m in metrics])
    totals = {"_count": ("sum", F.col("_n"))} | {f"_sum_{m}": ("sum", F.col(f"_s_{m}")) for m in metrics}
    ran = prefix_scan(per, key, [batch], totals)
    ran = cut_lineage(with_index(ran, key, [batch], "_b").withColumns({"_group": group, "_i": F.col("_b") + 1}))
    start = ran.select(*key, "_group", F.lit(0).cast("long").alias("_i"), F.lit(0).cast("long").alias("_count")).distinct()
    spots = ran.select(*key, "_group", "_i", "_count").unionByName(start)
    marks = spots.select(*key, "_group", "_i", (F.col("_count") + n).alias("_at"), F.lit(0).alias("_kind"))
    merged = marks.unionByName(spots.filter("_i > 0").select(*key, "_group", "_i", F.col("_count").alias("_at"), F.lit(1).alias("_kind")))
    # Downwards, the last running count met before a mark is the first one that reaches it.
    ahead = prefix_scan(merged.drop("_group"), key, [F.desc("_at"), F.desc("_kind"), F.desc("_i")], {"_next": ("last", F.when(F.col("_kind") == 1, F.col("_i")))})
    pointers = ahead.filter("_kind = 0 and _next is not null").select(group.alias("_group"), "_i", "_next")
    out = orbit(pointers).filter("_i > 0").withColumnsRenamed({"_group": "_g", "_i": "_b2"})
    went = ran.join(out, (F.col("_group") == F.col("_g")) & (F.col("_i") == F.col("_b2"))).drop("_g", "_b2")
    was = with_previous(went, key, [batch], {"_was": "_count"} | {f"_was_{m}": f"_sum_{m}" for m in metrics})
    rows = F.col("_count") - F.coalesce("_was", F.lit(0))
    return was.select(*key, batch, rows.alias("n"), *[((F.col(f"_sum_{m}") - F.coalesce(f"_was_{m}", F.lit(0.0))) / rows).alias(m) for m in metrics])


# How far behind and ahead of the last index a pose is looked for, in route points.
BEHIND, AHEAD = 5, 250


class Follower:
    """Progress of one drive along its route, pose by pose: the state that a drive carries from one batch to the next.

    The index is the nearest point of a window around the index before, never going back.  The cursor counts the goals
    passed: along the route to within the radius, or by being near, each at or after the one before it.
    """

    def __init__(self, route: np.ndarray, goals: np.ndarray, radius: float):
        self.route, self.goals, self.radius = route, np.union1d(goals, len(route) - 1), radius
        self.arc = np.append(0.0, np.hypot(*np.diff(route, axis=0).T).cumsum())
        self.index = self.cursor = 0

    def follow(self, pose: np.ndarray) -> list[tuple[int, float, float, int, float]]:
        out = []
        for here in pose:
            start = max(0, self.index - BEHIND)
            gaps = np.hypot(*(self.route[start : self.index + AHEAD] - here).T)
            self.index = max(self.index, start + int(gaps.argmin()))
            progress = float(self.arc[self.index])
            while self.cursor < len(self.goals) - 1:
                goal = self.goals[self.cursor]
                if progress < self.arc[goal] - self.radius and np.hypot(*(here - self.route[goal])) > self.radius:
                    break
                self.cursor += 1
            whole = float(self.arc[-1])
            out.append((self.index, progress, float(gaps.min()), self.cursor, min(max(progress / whole, 0.0), 1.0) if whole > 0 else 0.0))
        return out


PROGRESS = ["route_index", "progress", "deviation", "goal_cursor", "completion"]


def track_route(pose: DataFrame, route: DataFrame, by: list[str], order: str, goal: str = "is_goal", radius: float = 5.0) -> DataFrame:
    """Route progress per pose; poses without a route of at least two points have none.

    Route points and poses of a drive stream through one task in order, the route first: a task holds one route and
    one batch of poses, so drives of any length go through.
    """
    kinds = {f.name: f.dataType for f in pose.schema.fields}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in (*by, order)] + [T.StructField(c, T.LongType() if c in ("route_index", "goal_cursor") else T.DoubleType()) for c in PROGRESS])
    group = F.struct(*[F.col(c) for c in by])
    points = route.select(group.alias("_group"), F.lit(0).alias("_kind"), F.col("pt_idx").cast("long").alias("_at"), "x", "y", F.coalesce(F.col(goal), F.lit(False)).alias("_goal"), F.lit(None).cast(kinds[order]).alias("_order"))
    poses = pose.select(group.alias("_group"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_at"), "x", "y", F.lit(False).alias("_goal"), F.col(order).alias("_order"))
    rows = points.unionByName(poses).withColumn("_key", F.to_json("_group", {"ignoreNullFields": "false"}))
    rows = rows.repartition("_key").sortWithinPartitions("_key", "_kind", "_at", "_order").select("_key", "_kind", "x", "y", "_goal", *[F.col(f"_group.{c}").alias(c) for c in by], F.col("_order").alias(order))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, gathered, follower = None, [], None
        for batch in batches:
            for k, part in batch.groupby("_key", sort=False):
                if k != key:
                    key, gathered, follower = k, [], None
                gathered.append(part.loc[part["_kind"] == 0, ["x", "y", "_goal"]])
                here = part[part["_kind"] == 1]
                if here.empty:
                    continue
                if follower is None:
                    whole = pd.concat(gathered)
                    gathered = []
                    follower = Follower(whole[["x", "y"]].to_numpy(float), np.flatnonzero(whole["_goal"].to_numpy(bool)), radius) if len(whole) > 1 else False
                told = follower.follow(here[["x", "y"]].to_numpy(float)) if follower else [(None,) * len(PROGRESS)] * len(here)
                told = pd.DataFrame(told, columns=PROGRESS, index=here.index).astype({"route_index": "Int64", "goal_cursor": "Int64"})
                yield pd.concat([here[[*by, order]], told], axis=1)

    return rows.mapInPandas(run, schema)


def random_baseline(log: DataFrame, rollouts: int, seed: int = 0, mean: float = 1.0, sigma: float = 0.1) -> DataFrame:
    """Random-walk rollouts: Gaussian steps in the body frame from the logged start pose.

    Heading is a running sum of turn increments, and x, y are running sums of the rotated steps, so the
    walk is two window sums over a track instead of a recursion.  Draws come from hashes of the row key.
    Tracks are dealt out before they are multiplied, so the shuffle carries the log once, not each rollout.
    """
    from pyspark.sql import Window

    from trajlake.operators.curation import hash_uniform

    key = ["scenario_id", "agent_id", "rollout"]
    dealt = log.repartition("scenario_id", "agent_id")
    base = dealt.withColumn("rollout", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rollouts - 1).cast("long"))))
    # The common beginning of a row's six keys is written once.
    base = base.withColumn("_draw", F.concat_ws(":", *key, "step", F.lit(seed)))

    def normal(tag: int):
        u, v = (hash_uniform("_draw", F.lit(tag + i)) for i in (0, 1))
        return F.sqrt(-2 * F.ln(F.lit(1.0) - u)) * F.cos(v * (2 * np.pi))

    w = Window.partitionBy(*key).orderBy("step")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    moving = F.col("step") > 0
    steps = base.withColumns(
        {"_dx": F.when(moving, normal(0) * sigma + mean).otherwise(0.0), "_dy": F.when(moving, normal(10) * sigma).otherwise(0.0), "_dh": F.when(moving, normal(20) * sigma).otherwise(0.0)}
    )
    turned = steps.withColumn("heading", F.first("heading").over(run) + F.sum("_dh").over(run))
    before = F.coalesce(F.lag("heading").over(w), F.col("heading"))
    moved = turned.withColumns({"_mx": F.col("_dx") * F.cos(before) - F.col("_dy") * F.sin(before), "_my": F.col("_dx") * F.sin(before) + F.col("_dy") * F.cos(before)})
    return moved.withColumns({"x": F.first("x").over(run) + F.sum("_mx").over(run), "y": F.first("y").over(run) + F.sum("_my").over(run)}).drop(
        "_dx", "_dy", "_dh", "_mx", "_my", "_draw"
    )
