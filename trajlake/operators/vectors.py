"""Statistics over fixed-width vectors: target moments, alignment, within-segment R2, policy agreement.

Vectors are unnested with ``posexplode`` where a per-dimension aggregate is needed (partial aggregation
keeps one row per dimension and task) and stay arrays where a per-row fold is enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def target_statistics(feature: DataFrame, vec: str = "vec") -> DataFrame:
    """Mean and population deviation and variance per dimension."""
    long = feature.select(F.posexplode(vec).alias("dim", "v"))
    return long.groupBy(F.col("dim").cast("long").alias("dim")).agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.var_pop("v").alias("variance")
    )


def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda acc, v: acc + v)


def feature_alignment(pairs: DataFrame, pred: str = "pred", target: str = "target", scale: list[float] | None = None) -> DataFrame:
    """Adds per row: squared_sum (optionally of scaled residuals), mse, cosine."""
    p, t = F.col(pred), F.col(target)
    residual = F.zip_with(p, t, lambda a, b: a - b)
    if scale is not None:
        residual_scaled = F.zip_with(residual, F.array(*[F.lit(s) for s in scale]), lambda a, s: a / s)
    else:
        residual_scaled = residual
    sq = _fold(residual, residual, lambda a, b: a * b)
    dot, pp, tt = _fold(p, t, lambda a, b: a * b), _fold(p, p, lambda a, b: a * b), _fold(t, t, lambda a, b: a * b)
    norm = F.greatest(F.sqrt(pp), F.lit(1e-8)) * F.greatest(F.sqrt(tt), F.lit(1e-8))
    return pairs.withColumns(
        {
            "squared_sum": _fold(residual_scaled, residual_scaled, lambda a, b: a * b) if scale is not None else sq,
            "mse": sq / F.size(t),
            "cosine": dot / norm,
        }
    )


def epoch_alignment(aligned: DataFrame, variance: float | None = None) -> DataFrame:
    """Pooled means; RMSE is the root of the pooled MSE, r2 = 1 - mse / variance."""
    out = aligned.agg(F.avg("squared_sum").alias("feature_loss"), F.avg("mse").alias("mse"), F.avg("cosine").alias("cosine"))
    out = out.withColumn("rmse", F.sqrt(F.greatest("mse", F.lit(0.0))))
    return out.withColumn("r2", F.lit(1.0) - F.col("mse") / variance) if variance else out


def within_segment_r2(pairs: DataFrame, segment: str, pred: str = "pred", target: str = "target") -> DataFrame:
    """One row: variance explained after removing each segment's own mean, and the residual variance.

    Sums of squares come from per (segment, dimension) moments, so no window over a segment is needed:
    centred sum = population variance times count.  Segments with a single row are left out.
    """
    long = pairs.select(segment, F.posexplode(F.arrays_zip(F.col(pred).alias("p"), F.col(target).alias("t"))).alias("dim", "v"))
    per = long.groupBy(segment, "dim").agg(
        F.count("*").alias("n"), F.var_pop(F.col("v.p") - F.col("v.t")).alias("err"), F.var_pop("v.t").alias("tot")
    ).filter("n >= 2")
    sums = per.agg(F.sum(F.col("err") * F.col("n")).alias("e"), F.sum(F.col("tot") * F.col("n")).alias("t"), F.sum("n").alias("cells"))
    return sums.select(F.when(F.col("t") > 0, 1 - F.col("e") / F.col("t")).alias("r2"), (F.col("t") / F.col("cells")).alias("residual_variance"))


def _softmax_kl(student: Column, teacher: Column, temperature: float) -> Column:
    """KL(teacher || student) of tempered softmaxes in a single fold with running maxima.

    One pass keeps both partition sums and the teacher-weighted logit difference, rescaled whenever a
    larger logit arrives; referring to a per-row maximum inside the lambda would recompute it per element.
    """
    pairs = F.zip_with(teacher, student, lambda t, s: F.struct((t / temperature).alias("t"), (s / temperature).alias("s")))
    low = F.lit(-1e300)
    zero = F.struct(low.alias("mt"), F.lit(0.0).alias("zt"), F.lit(0.0).alias("w"), low.alias("ms"), F.lit(0.0).alias("zs"))

    def step(acc: Column, p: Column) -> Column:
        mt, ms = F.greatest(acc["mt"], p["t"]), F.greatest(acc["ms"], p["s"])
        shrink, e = F.exp(acc["mt"] - mt), F.exp(p["t"] - mt)
        return F.struct(
            mt.alias("mt"), (acc["zt"] * shrink + e).alias("zt"), (acc["w"] * shrink + e * (p["t"] - p["s"])).alias("w"),
            ms.alias("ms"), (acc["zs"] * F.exp(acc["ms"] - ms) + F.exp(p["s"] - ms)).alias("zs"),
        )

    def finish(acc: Column) -> Column:
        return acc["w"] / acc["zt"] - (acc["mt"] + F.ln(acc["zt"])) + (acc["ms"] + F.ln(acc["zs"]))

    return F.aggregate(pairs, zero, step, finish)


def policy_agreement(logits: DataFrame, temperature: float = 1.0, student: str = "student", teacher: str = "teacher") -> DataFrame:
    """Adds per row kl = KL(teacher || student) * T^2 and matches (same arg max, first index wins)."""
    kl = _softmax_kl(F.col(student), F.col(teacher), temperature) * temperature**2

    def argmax(c: Column) -> Column:
        return F.array_position(c, F.array_max(c))

    return logits.withColumns({"kl": kl, "matches": argmax(F.col(student)) == argmax(F.col(teacher))})
