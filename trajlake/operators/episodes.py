"""Episode and fleet metrics, reward attribution, trace and closed-loop summaries, run-length monitors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.operators.ordered import null_safe_join, prefix_scan


def _flag(c: Column) -> Column:
    return c.cast("double")


def episode_agents(agent: DataFrame, respawn: bool = False) -> DataFrame:
    """Per-agent episode outcome: score (all goals, or all but one of several, and no collision) and dnf."""
    share = F.col("goals_reached") / F.col("goals_sampled")
    needed = F.when(F.col("goals_sampled") > 1, (F.col("goals_sampled") - 1) / F.col("goals_sampled")).otherwise(1.0)
    hit = F.col("collided_before_goal") if respawn else F.col("collided")
    return agent.withColumns(
        {"score": _flag((share >= needed) & ~hit), "dnf": _flag(~F.col("offroad") & ~F.col("collided") & (share < 1))}
    )


def _totals(by: list[str], agents: DataFrame) -> DataFrame:
    return agents.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("score").alias("score"), F.avg("dnf").alias("dnf_rate"),
        F.avg(_flag(F.col("offroad"))).alias("offroad_rate"), F.avg(_flag(F.col("collided"))).alias("collision_rate"),
        F.avg("goals_reached").alias("goals_reached"), F.avg("goals_sampled").alias("goals_sampled"),
        (F.sum("goals_reached") / F.sum("goals_sampled")).alias("completion_rate"),
    )


def env_metrics(agents: DataFrame, by: list[str] = ["env_id"]) -> DataFrame:
    """Means per environment; completion is the ratio of sums."""
    return _totals(by, agents)


def fleet_metrics(agents: DataFrame) -> DataFrame:
    return _totals([], agents)


def select_unit(env: DataFrame, mode: str = "first", unit: str = "env_id", seed: int = 0) -> DataFrame:
    """One unit by rule; the lowest id wins ties and units without data are passed over for the worst rules."""
    if mode == "first":
        pick = F.min(unit)
    elif mode == "random":
        pick = F.min_by(unit, F.xxhash64(unit, F.lit(seed)))
    elif mode == "worst_score":
        pick = F.min_by(unit, F.struct(F.coalesce("score", F.lit(1.0)), F.col(unit)))
    elif mode == "worst_collision":
        pick = F.min_by(unit, F.struct(-F.coalesce("collision_rate", F.lit(0.0)), F.col(unit)))
    else:
        raise ValueError(f"unknown mode {mode}")
    populated = env.filter("n > 0") if mode.startswith("worst") else env
    return populated.agg(pick.alias(unit))


def step_outcomes(trace: DataFrame, by: list[str], radius: float, max_speed: float, order: str = "step") -> DataFrame:
    """Collision / off-road flags and step counts, whether the goal was reached, and the speed when it was first."""
    hit, off = F.col("collision_state") == 1, F.col("collision_state") == 2
    goal = (F.col("goal_distance") < radius) & (F.col("speed") <= max_speed)
    return trace.groupBy(*by).agg(
        F.bool_or(hit).alias("collided"), F.count_if(hit).alias("collision_steps"), F.bool_or(off).alias("offroad"), F.count_if(off).alias("offroad_steps"),
        F.bool_or(goal).alias("reached_goal"), F.min_by("speed", F.when(goal, F.col(order))).alias("speed_at_goal"),
    )


def lane_alignment(trace: DataFrame, by: list[str], order: str = "step", live: Column | None = None) -> DataFrame:
    """Lane-alignment rates: ``last_rate`` of the last step, ``mean_rate`` of all steps, ``live_rate`` of live steps."""
    aligned = _flag(F.col("lane_valid"))
    on = live if live is not None else F.lit(True)
    return trace.groupBy(*by).agg(
        F.max_by(aligned, F.col(order)).alias("last_rate"), F.avg(aligned).alias("mean_rate"), F.avg(F.when(on, aligned)).alias("live_rate")
    )


def reward_attribution(trace: DataFrame, by: list[str], terms: list[str]) -> DataFrame:
    """Per term: sum, per step, share of the gross absolute sum, steps hit.  Sums first, then the unpivot,
    so only one row per group is widened into terms."""
    sums = trace.groupBy(*by).agg(
        F.count("*").alias("_n"), *[F.sum(t).alias(f"s_{t}") for t in terms], *[F.count_if(F.col(t) != 0).alias(f"h_{t}") for t in terms]
    )
    gross = sum((F.abs(f"s_{t}") for t in terms[1:]), F.abs(f"s_{terms[0]}"))
    rows = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"s_{t}").alias("total"), F.col(f"h_{t}").alias("steps_hit")) for t in terms])
    out = sums.withColumn("_g", F.when(gross == 0, 1.0).otherwise(gross)).select(*by, "_n", "_g", F.inline(rows))
    return out.select(*by, "term", "total", (F.col("total") / F.col("_n")).alias("per_step"), (F.abs("total") / F.col("_g")).alias("share"), "steps_hit")


def attribution_residual(trace: DataFrame, by: list[str], terms: list[str], reward: str = "reward") -> DataFrame:
    """Largest |reward - sum of terms| per group; zero means the split is complete."""
    total = sum((F.col(t) for t in terms[1:]), F.col(terms[0]))
    return trace.groupBy(*by).agg(F.max(F.abs(F.col(reward) - total)).alias("residual"))


def trace_summary(trace: DataFrame, by: list[str], order: str = "step") -> DataFrame:
    return trace.groupBy(*by).agg(
        F.avg(_flag(F.col("collision_state") == 2)).alias("offroad_share"), F.avg(_flag(F.col("collision_state") == 1)).alias("collision_share"),
        F.avg(_flag(F.col("lane_valid"))).alias("on_lane_share"), F.avg("speed").alias("mean_speed"), F.max("speed").alias("max_speed"),
        F.min_by("goal_distance", order).alias("first_goal_distance"), F.max_by("goal_distance", order).alias("last_goal_distance"),
    )


def eval_summary(step: DataFrame, episode: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """One row: per-episode means averaged over the episodes that have them, success rate, and termination counts."""
    per = step.groupBy(key).agg(*[F.avg(m).alias(f"mean_{m}") for m in metrics])
    joined = episode.join(per, key, "left")
    main = joined.agg(F.count("*").alias("episodes"), F.avg(_flag(F.col("success"))).alias("success_rate"), *[F.avg(f"mean_{m}").alias(f"mean_{m}") for m in metrics])
    # Termination reasons are counted first; only the distinct reasons are gathered into the map.
    reasons = episode.groupBy("termination").count().agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("termination", "count")))).alias("terminations")
    )
    return main.join(F.broadcast(reasons), F.lit(True))


def info_means(long: DataFrame, per: list[str] = []) -> DataFrame:
    """Mean per key; with ``per`` the mean of per-group means."""
    if not per:
        return long.groupBy("key").agg(F.avg("value").alias("mean"))
    return long.groupBy("key", *per).agg(F.avg("value").alias("value")).groupBy("key").agg(F.avg("value").alias("mean"))


def episodes_from_steps(steps: DataFrame, by: list[str], order: list[str], bucket: Column | None = None) -> DataFrame:
    """Sums per episode: an episode ends with a terminal or truncated step; the open tail is not emitted.

    The episode number is the count of finished episodes before a step, taken with a scan that spreads hot
    keys, and the sums are ordinary aggregations.
    """
    done = (F.col("terminal") > 0) | (F.col("truncation") > 0)
    numbered = prefix_scan(steps.withColumn("_done", done.cast("long")), by, order, {"_ep": ("sum", F.col("_done"))}, exclusive=True, bucket=bucket)
    numbered = numbered.withColumn("episode", F.coalesce("_ep", F.lit(0)))
    return numbered.groupBy(*by, "episode").agg(
        F.sum("reward").alias("episode_return"), F.count("*").alias("episode_length"), F.max("_done").alias("_closed")
    ).filter("_closed = 1").drop("_closed")


def nonfinite_runs(updates: DataFrame, by: list[str], order: list[str], value: str, bucket: Column | None = None) -> DataFrame:
    """Total and longest consecutive stretch of non-finite values per run (gaps and islands over scans)."""
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    marked = updates.withColumn("_bad", bad.cast("long"))
    island = prefix_scan(marked, by, order, {"_good": ("sum", F.lit(1).cast("long") - F.col("_bad"))}, bucket=bucket)
    runs = island.filter("_bad = 1").groupBy(*by, "_good").agg(F.count("*").alias("_len"))
    best = runs.groupBy(*by).agg(F.sum("_len").alias("nonfinite_updates"), F.max("_len").alias("longest_run"))
    last = island.groupBy(*by).agg(F.max("_good").alias("_end"))
    tail = null_safe_join(runs, last, by).filter("_good = _end").select(*by, F.col("_len").alias("current_run"))
    counted = null_safe_join(null_safe_join(last.select(*by), best, by, "left"), tail, by, "left")
    return counted.na.fill(0, ["nonfinite_updates", "longest_run", "current_run"])


