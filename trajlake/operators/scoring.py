"""From features to scores: displacement, indications, scenario likelihoods, group and dataset summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.operators.likelihood import BERNOULLI_WEIGHTS, REALISM

WEIGHTS = {s.name: s.weight for s in REALISM} | BERNOULLI_WEIGHTS
KINEMATIC = ["linear_speed", "linear_acceleration", "angular_speed", "angular_acceleration"]
INTERACTIVE = ["collision_indication", "distance_to_nearest_object", "time_to_collision"]
MAP_BASED = ["distance_to_road_edge", "offroad_indication"]


def displacement_error(sim: DataFrame, log: DataFrame, use_z: bool = False) -> DataFrame:
    """ADE and minADE per agent: mean over log-valid steps, then mean / min over rollouts."""
    keys = ["scenario_id", "agent_id", "step"]
    cols = ["x", "y", "z"] if use_z else ["x", "y"]
    ref = log.select(*keys, "valid", *[F.col(c).alias(f"ref_{c}") for c in cols])
    square = sum((F.col(c) - F.col(f"ref_{c}")) ** 2 for c in cols)
    joined = sim.join(ref, keys).withColumn("_d", F.when(F.col("valid"), F.sqrt(square)).otherwise(0.0))
    per_rollout = joined.groupBy("scenario_id", "agent_id", "rollout").agg(
        (F.sum("_d") / F.greatest(F.count_if("valid"), F.lit(1))).alias("_ade")
    )
    return per_rollout.groupBy("scenario_id", "agent_id").agg(F.avg("_ade").alias("ade"), F.min("_ade").alias("min_ade"))


def indication(state: DataFrame, flag: Column, by: list[str] = ["scenario_id", "agent_id"]) -> DataFrame:
    """Per agent share of rollouts in which ``flag`` holds at any step valid in the log (``valid``)."""
    per = state.groupBy(*by, "rollout").agg(F.coalesce(F.bool_or(flag & F.col("valid")), F.lit(False)).alias("_any"))
    return per.groupBy(*by).agg(F.avg(F.col("_any").cast("double")).alias("indication"))


def scenario_scores(agent: DataFrame, weights: dict[str, float] = WEIGHTS, carry: list[str] = []) -> DataFrame:
    """Agent log-likelihoods (``ll_<metric>``) to one row per scenario.

    Means skip NULLs, a scenario with any metric missing is dropped, then the exponential of the mean,
    the weighted meta-score and half-even rounding to three places.
    """
    mean = agent.groupBy("scenario_id", *carry).agg(
        *[F.avg(f"ll_{m}").alias(m) for m in weights], *[F.avg(c).alias(c) for c in ("ade", "min_ade") if c in agent.columns],
        F.count("*").alias("num_agents"),
    )
    complete = mean.dropna(subset=list(weights))
    like = complete.withColumns({m: F.exp(m) for m in weights})
    score = sum((F.col(m) * w for m, w in list(weights.items())[1:]), F.col(next(iter(weights))) * next(iter(weights.values())))
    like = like.withColumn("realism_meta_score", score)
    doubles = [*weights, "realism_meta_score", *[c for c in ("ade", "min_ade") if c in like.columns]]
    return like.withColumns({c: F.bround(c, 3) for c in doubles})


def group_metrics(scores: DataFrame, batch_col: str | None = None, drop_scenarios: DataFrame | None = None) -> DataFrame:
    """Adds the kinematic, interactive and map means of the rounded likelihoods, one value per batch.

    Computed before ``drop_scenarios`` (possibly incomplete ones) are removed.  The batch side of the
    join is one row per batch; without a batch column it is a single row.
    """
    def group_mean(metrics: list[str]) -> Column:
        return F.avg(sum(F.col(m) for m in metrics) / len(metrics))

    by = [batch_col] if batch_col else []
    agg = scores.groupBy(*by).agg(
        group_mean(KINEMATIC).alias("kinematic_metrics"),
        group_mean(INTERACTIVE).alias("interactive_metrics"),
        group_mean(MAP_BASED).alias("map_based_metrics"),
    )
    if by:
        out = scores.join(agg, by)
    else:
        out = scores.join(F.broadcast(agg), F.lit(True))
    return out if drop_scenarios is None else out.join(drop_scenarios, "scenario_id", "left_anti")


def dataset_summary(scores: DataFrame, batch_col: str | None = None) -> DataFrame:
    """Column means, total agents, unique scenarios and the sample deviation of the meta-score.

    With ``batch_col`` the first occurrence of a scenario across batches is the one that counts.
    """
    kept = scores
    if batch_col:
        cols = [c for c in scores.columns if c != "scenario_id"]
        first = scores.groupBy("scenario_id").agg(F.min_by(F.struct(*cols), batch_col).alias("_r"))
        kept = first.select("scenario_id", "_r.*")
    means = [c for c, t in kept.dtypes if t == "double"]
    return kept.agg(
        *[F.avg(c).alias(c) for c in means],
        F.stddev_samp("realism_meta_score").alias("realism_meta_score_std"),
        F.coalesce(F.sum("num_agents"), F.lit(0)).alias("total_num_agents"),
        F.count("*").alias("unique_scenarios"),
    )
