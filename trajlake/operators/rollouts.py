"""Rollout buffers: advantages, truncation bootstrap, prioritised sampling, update diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.operators.curation import hash_uniform


def clipped_advantage(transition: DataFrame, gamma: float = 0.98, lam: float = 0.95, rho: float = 1.0, c: float = 1.0) -> DataFrame:
    """Adds ``advantage`` to (segment, t, value, reward, terminal, ratio).

    A backward affine recursion over one segment, whose length is the fixed horizon of the buffer, so the
    array it folds is short; the next step's value, reward and terminal are shifted in with a window.
    """
    w = Window.partitionBy("segment").orderBy("t")
    nxt = {k: F.lead(k).over(w) for k in ("value", "reward", "terminal")}
    alive = F.lit(1.0) - nxt["terminal"]
    delta = F.least("ratio", F.lit(rho)) * (nxt["reward"] + alive * nxt["value"] * gamma - F.col("value"))
    decay = F.least("ratio", F.lit(c)) * alive * (gamma * lam)
    steps = transition.select("segment", "t", F.coalesce(delta, F.lit(0.0)).alias("d"), F.coalesce(decay, F.lit(0.0)).alias("k"))
    # Backwards, A = d + k * A_next; the running list is what the fold returns.
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("t", "d", "k"))))
    start = F.struct(F.lit(0.0).alias("a"), F.array().cast("array<struct<t:bigint,advantage:double>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        a = s["d"] + s["k"] * acc["a"]
        return F.struct(a.alias("a"), F.concat(acc["out"], F.array(F.struct(s["t"].alias("t"), a.alias("advantage")))).alias("out"))

    folded = steps.groupBy("segment").agg(F.aggregate(ordered, start, step, lambda acc: acc["out"]).alias("_o"))
    adv = folded.select("segment", F.inline("_o"))
    return transition.join(adv, ["segment", "t"])


def bootstrap_truncation(transition: DataFrame, gamma: float = 0.98) -> DataFrame:
    """Reward plus the discounted previous value where an episode was cut but not ended."""
    w = Window.partitionBy("segment").orderBy("t")
    cut = (F.col("truncation") > 0) & (F.col("terminal") == 0)
    return transition.withColumn("reward", F.col("reward") + F.when(cut, F.coalesce(F.lag("value").over(w), F.lit(0.0)) * gamma).otherwise(0.0))


def clip_reward(transition: DataFrame, low: float = -1.0, high: float = 1.0) -> DataFrame:
    return transition.withColumns(
        {"reward": F.least(F.greatest("reward", F.lit(low)), F.lit(high)), "done": F.least(F.col("terminal") + F.col("truncation"), F.lit(1.0))}
    )


def prioritized_sample(advantage: DataFrame, k: int, alpha: float = 0.8, beta: float = 0.2, seed: int = 0) -> DataFrame:
    """k segments without replacement with p proportional to (sum |advantage|)^alpha + 1e-6, and their weight.

    Exponential keys -ln(u)/p turn weighted sampling into a top-k, which Spark does per partition first.
    """
    per = advantage.groupBy("segment").agg(F.pow(F.sum(F.abs("advantage")), F.lit(alpha)).alias("_p"))
    per = per.withColumn("_p", F.col("_p") + 1e-6)
    total = per.agg(F.sum("_p").alias("_t"), F.count("*").alias("_n"))  # one row
    p = per.join(F.broadcast(total), F.lit(True)).withColumn("probability", F.col("_p") / F.col("_t"))
    key = -F.ln(hash_uniform(F.col("segment"), F.lit(seed)) + 1e-18) / F.col("probability")
    out = p.withColumn("_key", key).orderBy("_key").limit(k)
    return out.select("segment", "probability", F.pow(F.col("_n") * F.col("probability"), F.lit(-beta)).alias("importance"))


def ppo_diagnostics(transition: DataFrame, clip: float = 0.2) -> DataFrame:
    """One row: old and new KL estimates, clip fraction, mean ratio, non-finite count, explained variance."""
    logratio = F.col("new_logprob") - F.col("logprob")
    ratio = F.exp(logratio)
    bad = F.isnan(ratio) | (F.abs(ratio) == float("inf"))
    residual = F.col("returns") - F.col("value")
    return transition.agg(
        F.avg(-logratio).alias("old_approx_kl"), F.avg(ratio - 1 - logratio).alias("approx_kl"),
        F.avg(F.when(F.abs(ratio - 1) > clip, 1.0).otherwise(0.0)).alias("clipfrac"), F.avg(ratio).alias("importance"),
        F.count_if(bad).alias("nonfinite"),
        F.when(F.var_samp("returns") > 0, 1 - F.var_samp(residual) / F.var_samp("returns")).alias("explained_variance"),
    )


def ppo_losses(transition: DataFrame, clip: float = 0.2, vf_clip: float = 0.2, weight: Column | None = None) -> DataFrame:
    """One row: clipped policy and value loss of a logged batch; the moments come from a one-row aggregate."""
    stats = transition.agg(F.avg("advantage").alias("_m"), F.stddev_samp("advantage").alias("_s"))
    adv = (F.col("advantage") - F.col("_m")) / (F.col("_s") + 1e-8) * (weight if weight is not None else F.lit(1.0))
    ratio = F.exp(F.col("new_logprob") - F.col("logprob"))
    held = F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip))
    near = F.col("value") + F.least(F.greatest(F.col("new_value") - F.col("value"), F.lit(-vf_clip)), F.lit(vf_clip))
    e1, e2 = F.col("new_value") - F.col("returns"), near - F.col("returns")
    rows = transition.join(F.broadcast(stats), F.lit(True)).select(
        F.greatest(-adv * ratio, -adv * held).alias("pg"), F.greatest(e1 * e1, e2 * e2).alias("vf")
    )
    return rows.agg(F.avg("pg").alias("policy_loss"), (F.avg("vf") * 0.5).alias("value_loss"))
