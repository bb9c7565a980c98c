"""How the likelihood rises as rollouts are replaced by the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.operators.likelihood import Histogram, histogram_loglik


def sensitivity(sim: DataFrame, log: DataFrame, specs: list[Histogram], ns: list[int]) -> DataFrame:
    """Mean agent log-likelihood per n, with the first n rollouts replaced by the log, all n in one pass.

    The few values of n are exploded next to the rows, so every n shares the same joins and aggregations.
    """
    key = ["scenario_id", "agent_id", "step"]
    values = F.explode(F.array(*[F.lit(n).cast("long") for n in ns])).alias("n")
    logged = log.select(*key, *[F.col(s.name).alias(f"_l_{s.name}") for s in specs])
    mixed = sim.select(*key, "rollout", *[s.name for s in specs], values).join(logged, key)
    swap = {s.name: F.when(F.col("rollout") < F.col("n"), F.col(f"_l_{s.name}")).otherwise(F.col(s.name)) for s in specs}
    mixed = mixed.withColumns(swap)
    masks = [s.valid for s in specs if s.valid]
    scored = log.select(*key, *dict.fromkeys(masks), *[s.name for s in specs], values)
    ll = histogram_loglik(scored, mixed, specs, ["n", "scenario_id", "agent_id"])
    agent = ll.groupBy("n", "scenario_id", "agent_id").agg(
        *[F.avg(F.when(F.col(s.valid) if s.valid else F.lit(True), F.col(f"ll_{s.name}"))).alias(f"ll_{s.name}") for s in specs]
    )
    return agent.groupBy("n").agg(*[F.avg(f"ll_{s.name}").alias(f"ll_{s.name}") for s in specs])
