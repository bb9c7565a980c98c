"""Finite-difference features of trajectories.

Windows here run over one track (scenario, agent, rollout), which the data model bounds to a fixed
number of steps, so they never concentrate a hot key; steps must be dense (see ``normalize_tracks``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trajlake.functions.geometry import wrap_angle

LOG_KEYS = ["scenario_id", "agent_id"]
SIM_KEYS = ["scenario_id", "agent_id", "rollout"]


def track_window(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("step")


def central_diff(value: Column, w: WindowSpec) -> Column:
    """(next - previous) / 2, NULL at both ends."""
    return (F.lead(value).over(w) - F.lag(value).over(w)) / 2


def kinematics(state: DataFrame, keys: list[str] = SIM_KEYS, dt: float = 0.1) -> DataFrame:
    """Adds speed, acceleration, angular_speed and angular_acceleration.  One sort serves all windows."""
    w = track_window(keys)
    first = state.withColumns(
        {
            "_dx": central_diff(F.col("x"), w),
            "_dy": central_diff(F.col("y"), w),
            "_dh": central_diff(F.col("heading"), w),
        }
    ).withColumns(
        {
            "speed": F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")) / dt,
            "_turn": wrap_angle(F.col("_dh") * 2) / 2,
        }
    )
    return first.withColumns(
        {
            "acceleration": central_diff(F.col("speed"), w) / dt,
            "angular_speed": F.col("_turn") / dt,
            "angular_acceleration": wrap_angle(central_diff(F.col("_turn"), w) * 2) / 2 / (dt * dt),
        }
    ).drop("_dx", "_dy", "_dh", "_turn")


def kinematic_validity(log: DataFrame, keys: list[str] = LOG_KEYS) -> DataFrame:
    """speed_valid: both neighbours valid; acceleration_valid: both neighbours speed-valid; false at the ends."""
    w = track_window(keys)

    def both(col: str) -> Column:
        return F.coalesce(F.lag(col).over(w) & F.lead(col).over(w), F.lit(False))

    return log.withColumn("speed_valid", both("valid")).withColumn("acceleration_valid", both("speed_valid"))


def track_stats(state: DataFrame, keys: list[str] = LOG_KEYS) -> DataFrame:
    """Distance travelled and maximum speed of each track; invalid steps are passed over."""
    w = track_window(keys)
    hop = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return (
        state.filter("valid")
        .withColumn("_hop", hop)
        .groupBy(*keys)
        .agg(
            F.coalesce(F.sum("_hop"), F.lit(0.0)).alias("distance"),
            F.max(F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))).alias("max_speed"),
        )
    )
