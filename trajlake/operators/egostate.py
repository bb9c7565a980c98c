"""Ego observation vectors from pose sequences.  One window over a drive (a bounded number of frames)."""

from __future__ import annotations



from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trajlake.functions.geometry import AXLE_TO_CENTER, box_center, pose_yaw, signed_speed, world_to_ego, wrap_angle
from trajlake.functions.scaling import normalize_ego

# Clipping ranges of the reconstructed vehicle state.
SPEED_RANGE, LONG_RANGE, LAT_RANGE, STEER_LIMIT, SPEED_FLOOR = (-2.0, 20.0), (-5.0, 2.5), (-4.0, 4.0), 0.55, 0.5


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def gradient(value: Column, t: Column, w: WindowSpec) -> Column:
    """Second-order derivative on uneven spacing, one-sided at the ends, 0 for a single row."""
    prev, nxt = F.lag(value).over(w), F.lead(value).over(w)
    hs, hd = t - F.lag(t).over(w), F.lead(t).over(w) - t
    inner = (hs * hs * nxt + (hd * hd - hs * hs) * value - hd * hd * prev) / (hs * hd * (hs + hd))
    return (
        F.when(prev.isNotNull() & nxt.isNotNull(), inner)
        .when(nxt.isNotNull(), (nxt - value) / hd)
        .when(prev.isNotNull(), (value - prev) / hs)
        .otherwise(0.0)
    )


def phase_jump(angle: Column, w: WindowSpec) -> Column:
    """Wrapped change since the previous row; a jump of exactly +pi stays +pi.  Its running sum unwraps."""
    d = angle - F.lag(angle).over(w)
    wrapped = wrap_angle(d)
    return F.coalesce(F.when((wrapped <= -3.141592653589793) & (d > 0), -wrapped).otherwise(wrapped), F.lit(0.0))


def unwrap(df: DataFrame, angle: str, by: list[str], order: str, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_jump", phase_jump(F.col(angle), w)).withColumn(name, F.first(angle).over(run) + F.sum("_jump").over(run)).drop("_jump")


def arclength(df: DataFrame, by: list[str], order: str, name: str = "arc") -> DataFrame:
    """Travelled distance up to each row."""
    w = Window.partitionBy(*by).orderBy(order)
    hop = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return df.withColumn("_hop", hop).withColumn(name, F.sum("_hop").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_hop")


def lookahead_goal(df: DataFrame, by: list[str], order: str, distance: float = 30.0) -> DataFrame:
    """Adds goal_x, goal_y: the first pose at least ``distance`` farther along the path, or the last pose
    extended along its yaw.  The range frame needs SQL text because its offset is fractional."""
    keys = ", ".join(f"`{k}`" for k in by)
    frame = f"over (partition by {keys} order by arc range between {float(distance)!r}D following and unbounded following)"
    whole = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = arclength(df, by, order).withColumns(
        {"_gx": F.expr(f"first(x) {frame}"), "_gy": F.expr(f"first(y) {frame}"),
         "_last": F.last(F.struct("x", "y", "yaw", "arc")).over(whole)}
    )
    rest = F.col("arc") + distance - F.col("_last.arc")
    return out.withColumns(
        {
            "goal_x": F.coalesce("_gx", F.col("_last.x") + rest * F.cos("_last.yaw")),
            "goal_y": F.coalesce("_gy", F.col("_last.y") + rest * F.sin("_last.yaw")),
        }
    ).drop("_gx", "_gy", "_last")


def ego_observations(
    frame: DataFrame, by: list[str], length: float, width: float, goal_distance: float = 30.0, axle: float = AXLE_TO_CENTER,
    goal_mode: str = "lookahead", kind: float = 1.0,
) -> DataFrame:
    """11-value ego vector per frame from ``pose`` (row-major 4x4) and ``timestamp_micros``.

    Timestamps must increase strictly inside a drive, otherwise the row raises.  ``goal_mode`` is
    'lookahead' or 'endpoint' (the last pose of the drive, fixed).
    """
    cx, cy = box_center(F.col("pose"), axle)
    w = Window.partitionBy(*by).orderBy("timestamp_micros")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = frame.select(*by, "timestamp_micros", cx.alias("x"), cy.alias("y"), pose_yaw(F.col("pose")).alias("yaw"))
    stuck = F.col("timestamp_micros") <= F.lag("timestamp_micros").over(w)
    base = base.withColumn(
        "t", F.when(stuck, F.raise_error(F.lit("a frame is not later than the one before it")).cast("double"))
        .otherwise(F.col("timestamp_micros") / F.lit(1e6)),
    )
    base = unwrap(base, "yaw", by, "timestamp_micros", "_yaw")
    t = F.col("t")
    base = base.withColumns({"_vx": gradient(F.col("x"), t, w), "_vy": gradient(F.col("y"), t, w), "_rate": gradient(F.col("_yaw"), t, w)})
    base = base.withColumn("_v", clip(signed_speed(F.col("_vx"), F.col("_vy"), F.cos("yaw"), F.sin("yaw")), *SPEED_RANGE))
    base = base.withColumns({"_al": clip(gradient(F.col("_v"), t, w), *LONG_RANGE), "_at": clip(F.col("_v") * F.col("_rate"), *LAT_RANGE)})
    curvature = F.when(F.abs("_v") >= SPEED_FLOOR, F.col("_rate") / F.col("_v")).otherwise(0.0)
    base = base.withColumn("_steer", clip(F.atan(curvature * (0.6 * length)), -STEER_LIMIT, STEER_LIMIT))
    if goal_mode == "endpoint":
        base = base.withColumns({"goal_x": F.last("x").over(whole), "goal_y": F.last("y").over(whole)})
    else:
        base = lookahead_goal(base, by, "timestamp_micros", goal_distance)
    gx, gy = world_to_ego(F.col("goal_x"), F.col("goal_y"), F.col("x"), F.col("y"), F.col("yaw"))
    n = normalize_ego(gx, gy, F.col("_v"), F.lit(width), F.lit(length), F.col("_steer"), F.col("_al"), F.col("_at"), F.lit(kind))
    zero = F.lit(0.0)
    obs = F.array(n["goal_x"], n["goal_y"], n["speed"], n["width"], n["length"], zero, n["steering"], n["a_long"], n["a_lat"], zero, n["type"])
    return base.select(*by, "timestamp_micros", obs.alias("obs"))


def route_goals(route: DataFrame, by: list[str], order: str, max_goals: int, spacing: float = 50.0) -> DataFrame:
    """Evenly spaced goals of each route: at most ``max_goals``, one per ``spacing`` metres, the last pinned
    to the final point, collapsed duplicates kept once.  Targets meet points by (route, first arc >= target)."""
    arc = arclength(route, by, order)
    total = arc.groupBy(*by).agg(F.max("arc").alias("_total"), F.max(order).alias("_end"))
    n = F.least(F.lit(max_goals), F.greatest(F.lit(1), F.ceil(F.col("_total") / spacing).cast("int")))
    targets = total.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    targets = targets.withColumn("_target", F.col("_total") / F.col("_n") * F.col("_k"))
    # One pass over the points: a target falls between a point and its predecessor, so the join is on the
    # bucket of arclength both share and never pairs a whole route with all its targets.
    w = Window.partitionBy(*by).orderBy(order)
    pts = arc.withColumn("_from", F.coalesce(F.lag("arc").over(w), F.lit(-1.0)))
    lo, hi = F.floor(F.col("_from") / spacing), F.floor(F.col("arc") / spacing)
    pts = pts.withColumn("_b", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    inner = targets.filter("_k < _n").withColumn("_b", F.floor(F.col("_target") / spacing).cast("long"))
    hit = inner.join(pts.select(*by, "_b", "_from", "arc", order), [*by, "_b"]).filter("_target > _from and _target <= arc")
    hit = hit.select(*by, order)
    return hit.unionByName(total.select(*by, F.col("_end").alias(order))).distinct()


