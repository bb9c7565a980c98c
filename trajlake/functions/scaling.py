"""Normalisation of observations, conditioning vectors and run parameters, and reward terms."""

from __future__ import annotations

from math import log, log2, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

# Observation scales.
GOAL_SCALE, MAX_SPEED, MAX_WIDTH, MAX_LENGTH = 0.005, 100.0, 15.0, 30.0
BRAKE_MAX, ACCEL_MAX, LATERAL_MAX, TYPES = 15.0, 4.0, 4.0, 3.0


def normalize_ego(goal_x, goal_y, speed, width, length, steer, a_long, a_lat, kind) -> dict[str, Column]:
    """Ego observation fields; braking and acceleration have different scales."""
    return {
        "goal_x": goal_x * GOAL_SCALE, "goal_y": goal_y * GOAL_SCALE, "speed": speed / MAX_SPEED, "width": width / MAX_WIDTH,
        "length": length / MAX_LENGTH, "steering": steer / pi,
        "a_long": F.when(a_long < 0, a_long / BRAKE_MAX).otherwise(a_long / ACCEL_MAX),
        "a_lat": a_lat / LATERAL_MAX, "type": kind / TYPES,
    }


def conditioning_norm(values: Column, bounds: list[tuple[float, float]]) -> Column:
    """Per-dimension (v - lo) / (hi - lo), 0 for an empty range."""
    lo, span = F.array(*[F.lit(a) for a, _ in bounds]), F.array(*[F.lit(b - a) for a, b in bounds])
    return F.transform(values, lambda v, i: F.when(F.get(span, i) == 0, 0.0).otherwise((v - F.get(lo, i)) / F.get(span, i)))


def conditioning_denorm(values: Column, bounds: list[tuple[float, float]], strict: bool = True) -> Column:
    """Inverse; values outside [0, 1] are an error, or extrapolated where ``strict`` is off."""
    lo, span = F.array(*[F.lit(a) for a, _ in bounds]), F.array(*[F.lit(b - a) for a, b in bounds])
    bad = F.raise_error(F.lit("normalised conditioning outside [0, 1]")).cast("double")
    outside = lambda v: (v < 0) | (v > 1) if strict else F.lit(False)
    return F.transform(values, lambda v, i: F.when(outside(v), bad).otherwise(F.get(lo, i) + v * F.get(span, i)))


def _forward(kind: str, v: Column) -> Column:
    return {"linear": lambda: v, "pow2": lambda: F.log2(v), "log10": lambda: F.log10(v), "logit": lambda: F.log10(1 - v)}[kind]()


def _ends(kind: str, low: float, high: float) -> tuple[float, float]:
    f = {"linear": lambda v: v, "pow2": log2, "log10": lambda v: log(v, 10), "logit": lambda v: log(1 - v, 10)}[kind]
    return f(low), f(high)


def scale_param(kind: str, value: Column, low: float, high: float) -> Column:
    """Parameter to [-1, 1] on a linear, pow2, log10 or logit axis."""
    a, b = _ends(kind, low, high)
    return (_forward(kind, value) - a) / (b - a) * 2 - 1


def unscale_param(kind: str, scaled: Column, low: float, high: float, integer: bool = False) -> Column:
    a, b = _ends(kind, low, high)
    v = (scaled + 1) / 2 * (b - a) + a
    if kind == "pow2":
        return F.pow(F.lit(2.0), F.rint(v))
    out = {"linear": lambda: v, "log10": lambda: F.pow(F.lit(10.0), v), "logit": lambda: 1 - F.pow(F.lit(10.0), v)}[kind]()
    return F.rint(out) if integer else out


# Reward weights and thresholds.
VELOCITY_WEIGHT, TIMESTEP_WEIGHT, GOAL_SPEED, OFFSET_CAP = 0.0025, 0.000025, 3.0, 6.0
REWARD_TERMS = ["r_collision", "r_offroad", "r_comfort", "r_align", "r_center", "r_velocity", "r_reverse", "r_timestep", "r_goal"]


def reward_terms(s: dict[str, Column], c: dict[str, Column], dt: float = 0.1, goal_reward: float = 1.0) -> dict[str, Column]:
    """The additive reward terms of a logged step, for recomputing and auditing logged rewards.

    ``s`` is the state (collision_state 1 vehicle / 2 off-road, speed, signed_speed, a_long, a_lat,
    jerk_long, jerk_lat, lane_ref_valid, lane_valid, heading_error, lateral_offset, goal_distance,
    goal_pending, is_final), ``c`` the conditioning weights.
    """
    zero, cos_t, v = F.lit(0.0), F.cos(s["heading_error"]), s["signed_speed"]

    def hit(cond: Column) -> Column:
        return F.when(cond, 1.0).otherwise(0.0)

    discomfort = hit(F.abs(s["a_long"]) > 3) + hit(F.abs(s["a_lat"]) > 3) + hit((F.abs(s["jerk_long"]) > 5) | (F.abs(s["jerk_lat"]) > 5))
    straight = (F.lit(1.0) - F.abs(s["heading_error"]) / (pi / 2)) * 0.0025
    against = F.least(cos_t, zero) + c["vel_align"] * F.least(cos_t * v, zero) + straight
    offset = F.least(F.abs(s["lateral_offset"] - c["center_bias"]), F.lit(OFFSET_CAP))
    charged = F.when(s["lane_valid"] & (cos_t <= 0.5), 0.0).otherwise(offset)
    bonus = F.lit(0.05)
    centred = F.when(s["lane_ref_valid"], charged - bonus / F.exp(offset - 0.5)).otherwise(
        F.lit(OFFSET_CAP) - bonus / F.exp(F.lit(OFFSET_CAP - 0.5))
    )
    reached = (s["goal_distance"] < c["goal_radius"]) & s["goal_pending"] & (~s["is_final"] | (s["speed"] <= GOAL_SPEED))
    return {
        "r_collision": F.when(s["collision_state"] == 1, -(c["collision"] + s["speed"] * 0.1)).otherwise(0.0),
        "r_offroad": F.when(s["collision_state"] == 2, -c["boundary"]).otherwise(0.0),
        "r_comfort": F.when(c["comfort"] > 0, -c["comfort"] * discomfort).otherwise(0.0),
        "r_align": F.when(s["lane_ref_valid"], c["l_align"] * against * dt).otherwise(0.0),
        "r_center": -c["l_center"] * centred * dt,
        "r_velocity": F.when(s["lane_valid"] & (F.abs(v) > 2.5), F.greatest(cos_t, zero) * (VELOCITY_WEIGHT * dt)).otherwise(0.0),
        "r_reverse": F.when(v < 0, -c["reverse"] * dt).otherwise(0.0),
        "r_timestep": F.when((F.abs(v) > 0) | (F.abs(s["a_long"]) > 0), -TIMESTEP_WEIGHT * dt).otherwise(0.0),
        "r_goal": F.when(reached, goal_reward).otherwise(0.0),
    }
