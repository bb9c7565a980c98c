"""Histogram and Bernoulli likelihood of logged values under simulated samples."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Histogram:
    """``value`` on the simulated side, ``value`` on the log side where ``valid`` (a column name or None) holds."""

    name: str
    low: float
    high: float
    bins: int
    weight: float
    valid: str | None = "valid"
    smoothing: float = 0.1

    def inner_edges(self) -> list[float]:
        step = (self.high - self.low) / self.bins
        return [self.low + step * i for i in range(1, self.bins)]


# Metric ranges, bins, weights and validity masks.
REALISM = [
    Histogram("linear_speed", 0.0, 25.0, 10, 0.05, "speed_valid"),
    Histogram("linear_acceleration", -12.0, 12.0, 11, 0.05, "acceleration_valid"),
    Histogram("angular_speed", -0.628, 0.628, 11, 0.05, "speed_valid"),
    Histogram("angular_acceleration", -3.14, 3.14, 11, 0.05, "acceleration_valid"),
    Histogram("distance_to_nearest_object", -5.0, 40.0, 10, 0.10, "valid"),
    Histogram("time_to_collision", 0.0, 5.0, 10, 0.10, "vehicle_valid"),
    Histogram("distance_to_road_edge", -20.0, 40.0, 10, 0.10, "valid"),
]
BERNOULLI_WEIGHTS = {"collision_indication": 0.25, "offroad_indication": 0.25}
BERNOULLI_SMOOTHING = 0.001


def bin_index(value: Column, spec: Histogram) -> Column:
    """Bin by comparison with the literal edges, which is exact on edges where dividing by the width is not.

    Out-of-range values land in the outer bins, which is what clipping first would do; NULL stays NULL.
    """
    hits = [F.when(value >= e, 1).otherwise(0) for e in spec.inner_edges()]
    return F.when(value.isNotNull() & ~F.isnan(value), reduce(lambda a, b: a + b, hits))


def histograms(sim: DataFrame, specs: list[Histogram], by: list[str]) -> DataFrame:
    """One row per group with an array of bin counts per metric.

    All metrics are counted in a single aggregation: partial counts are combined map-side, so the
    shuffle carries one short row per group and task, however many samples the group has.
    """
    binned = sim.select(*by, *[bin_index(F.col(s.name), s).alias(f"_b_{s.name}") for s in specs])
    counts = [F.count_if(F.col(f"_b_{s.name}") == b).alias(f"_c_{s.name}_{b}") for s in specs for b in range(s.bins)]
    wide = binned.groupBy(*by).agg(*counts)
    return wide.select(*by, *[F.array(*[F.col(f"_c_{s.name}_{b}") for b in range(s.bins)]).alias(f"hist_{s.name}") for s in specs])


def _smoothed(hist: Column, b: Column, spec: Histogram) -> Column:
    total = F.aggregate(hist, F.lit(0).cast("long"), lambda acc, v: acc + v)
    # element_at counts as non-null whenever its array is, so a NULL index must be guarded.
    hits = F.element_at(hist, F.coalesce(b.cast("int") + 1, F.lit(1)))
    return F.when(b.isNotNull(), F.ln((hits + spec.smoothing) / (total + spec.smoothing * spec.bins)))


def histogram_loglik(log: DataFrame, sim: DataFrame, specs: list[Histogram], by: list[str], per_step: bool = False) -> DataFrame:
    """``log`` with one ``ll_<metric>`` column per spec: log-probability of the logged value.

    With ``per_step`` the histogram is taken over rollouts at each step instead of pooled over time.
    An unseen group gives the smoothed uniform probability.
    """
    keys = [*by, "step"] if per_step else by
    joined = log.join(histograms(sim, specs, keys), keys, "left")
    for s in specs:
        empty = F.array(*[F.lit(0).cast("long")] * s.bins)
        hist = F.coalesce(F.col(f"hist_{s.name}"), empty)
        joined = joined.withColumn(f"ll_{s.name}", _smoothed(hist, bin_index(F.col(s.name), s), s)).drop(f"hist_{s.name}")
    return joined


def bernoulli_loglik(logged: Column, positives: Column, total: Column, smoothing: float = BERNOULLI_SMOOTHING) -> Column:
    """Log-probability of a logged flag given ``positives`` of ``total`` simulated flags."""
    hits = F.when(logged, positives).otherwise(total - positives)
    return F.when(logged.isNotNull(), F.ln((hits + smoothing) / (total + 2 * smoothing)))


def masked_mean(value: Column, valid: Column) -> Column:
    """Mean over valid entries, NULL when there is none."""
    return F.avg(F.when(valid, value))
