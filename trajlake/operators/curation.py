"""Dataset curation: pairing, splits, strides, sampling, integrity checks, distribution audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions.geometry import finite, nondegenerate
from trajlake.operators.ordered import exact_quantiles, null_safe_join, with_index

# ------------------------------------------------------------------ keys and sets


def missing_keys(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    return expected.select(*key).distinct().join(actual, key, "left_anti")


def same_keys(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys present on one side only, with the side; empty means the key sets are equal.  NULL is a key like any other.

    One aggregation over both sides, so repeated keys shrink to one row each before anything is shuffled or held.
    """
    both = a.select(*key, F.lit(0).alias("_side")).union(b.select(*key, F.lit(1).alias("_side")))
    seen = both.groupBy(*key).agg(F.min("_side").alias("_first"), F.max("_side").alias("_last")).filter("_first = _last")
    return seen.select(*key, F.when(F.col("_first") == 0, "left").otherwise("right").alias("only_in"))


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1")


def overlap(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys in both sets; empty means disjoint."""
    return a.select(*key).intersect(b.select(*key))


def coverage(df: DataFrame, key: str, target: int) -> DataFrame:
    return df.agg(F.countDistinct(key).alias("covered")).withColumn("complete", F.col("covered") >= target)


def union_batches(*batches: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def require(condition: DataFrame, message: str) -> None:
    """Raise unless ``condition`` (a relation of violations) is empty."""
    if not condition.isEmpty():
        raise ValueError(message)


def pending(source: DataFrame, target: DataFrame, key: list[str], version: int | None = None) -> DataFrame:
    """Source rows not yet in the target.  A target of another schema version must not be mixed in."""
    if version is not None:
        require(target.filter(F.col("schema_version") != version).limit(1), f"target holds a schema version other than {version}")
    return source.join(target.select(*key), key, "left_anti")


# ------------------------------------------------------------------ pairing


def align_rollouts(sim: DataFrame, log: DataFrame, tol: float = 1e-4) -> DataFrame:
    """One row per logged agent: whether it was simulated, and the largest start offset over rollouts."""
    keys = ["scenario_id", "agent_id"]
    start = log.filter("step = 0").select(*keys, F.col("x").alias("lx"), F.col("y").alias("ly"))
    first = sim.filter("step = 0").join(start, keys)
    off = first.groupBy(*keys).agg(F.max(F.greatest(F.abs(F.col("x") - F.col("lx")), F.abs(F.col("y") - F.col("ly")))).alias("start_offset"))
    return start.select(*keys).join(off, keys, "left").withColumn(
        "status", F.when(F.col("start_offset").isNull(), "missing").when(F.col("start_offset") > tol, "moved").otherwise("aligned")
    )


def pair_strict(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Violations of a one-to-one pairing, one row per key: unknown, unpaired or paired more than once.

    Both sides are reduced to counts before they meet, so a repeated key never multiplies rows.
    """
    a = left.groupBy(*key).agg(F.count("*").alias("left_rows"))
    b = right.groupBy(*key).agg(F.count("*").alias("right_rows"))
    both = a.join(b, key, "full_outer").na.fill(0, ["left_rows", "right_rows"])
    reason = (
        F.when(F.col("left_rows") == 0, "unknown reference").when(F.col("right_rows") == 0, "unpaired")
        .when((F.col("left_rows") > 1) | (F.col("right_rows") > 1), "paired more than once")
    )
    return both.withColumn("reason", reason).filter("reason is not null")


def join_ego(samples: DataFrame, ego: DataFrame, key: list[str] = ["segment_id", "timestamp_micros"], strict: bool = True) -> DataFrame:
    """Exact lookup of the ego vector; with ``strict`` a miss raises when the row is read."""
    found = samples.join(ego, key, "left" if strict else "inner")
    if not strict:
        return found
    miss = F.raise_error(F.concat(F.lit("no ego row for "), *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key]))
    return found.withColumn("obs", F.when(F.col("obs").isNull(), miss.cast(ego.schema["obs"].dataType)).otherwise(F.col("obs")))


def apply_split(samples: DataFrame, split: DataFrame, key: str = "segment_id") -> DataFrame:
    """Frames per split and segment next to the recorded frame total."""
    frames = samples.groupBy(key).agg(F.count("*").alias("frames"))
    return split.join(frames, key, "left").na.fill(0, ["frames"])


# ------------------------------------------------------------------ order, stride, sample


def stride(df: DataFrame, segment: list[str], order: list[str], n: int, cap: int | None = None) -> DataFrame:
    """Every n-th row of each segment, restarting per segment; ``cap`` keeps the first rows in overall order."""
    kept = with_index(df, segment, order, "_i").filter(F.col("_i") % n == 0).drop("_i")
    return kept if cap is None else kept.orderBy(*segment, *order).limit(cap)


def linspace_sample(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """Rows at int(linspace(0, N-1, k)); all rows when k >= N."""
    idx, n = with_index(df, [], order, "_i", total="_n"), F.col("_n")
    if k == 1:
        return idx.filter("_i = 0").drop("_i", "_n")
    step = (n - 1) / F.lit(k - 1)
    j = F.floor(F.col("_i") / step)
    # The last sample is pinned to the last row, as linspace does with its end point.
    hit = ((F.floor(j * step) == F.col("_i")) & (j < k - 1)) | ((F.floor((j + 1) * step) == F.col("_i")) & (j + 1 < k - 1)) | (F.col("_i") == n - 1)
    return idx.filter((n <= k) | hit).drop("_i", "_n")


def assign_map_ids(files: DataFrame, path: str = "path", max_maps: int | None = None) -> DataFrame:
    """Dense ids by sorted distinct path; paths beyond ``max_maps`` get none."""
    ids = with_index(files.select(path).distinct(), [], [path], "map_id")
    return ids if max_maps is None else ids.filter(F.col("map_id") < max_maps)


def sample_per_group(df: DataFrame, group: list[str], key: list[str], k: int, seed: int = 0) -> DataFrame:
    """Uniform sample of at most k whole rows per group; the top-k filter is applied before the shuffle."""
    w = Window.partitionBy(*group).orderBy(digest(*[F.col(c) for c in key], F.lit(seed)), *key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def stratified_split(episodes: DataFrame, train: int, validation: int, seed: int, stratum: str = "town", key: str = "segment_id") -> DataFrame:
    """Whole segments to training / validation per stratum, by a seeded hash order; a small stratum raises."""
    token = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(stratum).cast("string"), F.col(key).cast("string")), 256)
    small = episodes.groupBy(stratum).count().filter(F.col("count") < train + validation).limit(1)
    require(small, "a stratum has too few segments for the requested split")
    # Only the first rows of a stratum are wanted, so every task keeps no more than those before the shuffle.
    first = Window.partitionBy(stratum).orderBy("_h", key)
    ranked = episodes.withColumn("_h", token).withColumn("_i", F.row_number().over(first)).filter(F.col("_i") <= train + validation)
    return ranked.withColumn("split", F.when(F.col("_i") <= train, "training").otherwise("validation")).drop("_h", "_i")


def episode_seed(seed: int, tag: str, town: Column, episode: Column) -> Column:
    """Stable per-episode seed, identical on every run and machine."""
    return F.crc32(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), town.cast("string"), episode.cast("string")).cast("binary"))


def digest(*parts: Column | str) -> Column:
    """Hexadecimal digest of the parts, joined by colons; the same in any engine."""
    return F.md5(F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]).cast("binary"))


def hash_uniform(*parts: Column | str) -> Column:
    """Uniform in [0, 1) from the first 52 bits of a digest: reproducible, independent of partitioning."""
    return F.conv(F.substring(digest(*parts), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def segment_conditioning(df: DataFrame, seed: int = 42, key: str = "segment_id") -> DataFrame:
    """13 conditioning values per segment: ten uniforms and three two-sided scale mixtures around 1.

    The draws come from a hash, so the distribution is reproduced, not another generator's numbers.
    """
    tag = F.lit(f"conditioning:{seed}")
    u = [hash_uniform(tag, F.col(key), F.lit(i)) for i in range(10)]

    def mixture(i: int, scale: float) -> Column:
        """Either side of the knee with equal chance; the knee is where a scale of one lies between 1/scale and scale."""
        knee, draw = 1.0 / (1.0 + scale), hash_uniform(tag, F.col(key), F.lit(i))
        return F.when(hash_uniform(tag, F.col(key), F.lit(100 + i)) < 0.5, draw * knee).otherwise(F.lit(knee) + draw * (1.0 - knee))

    return df.withColumn("conditioning", F.array(*u, mixture(10, 1.25), mixture(11, 1.25), mixture(12, 1.5)))


def first_per_group(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """First row of each group by aggregation (map-side combined), so a hot group costs nothing extra."""
    rest = [c for c in df.columns if c not in group]
    return df.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*group, "_r.*")


def latest(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.max_by(F.struct(*df.columns), F.struct(ts, *[c for c in df.columns if c != ts])).alias("_r")).select("_r.*")


# ------------------------------------------------------------------ distributions and audits


def agent_distribution(agent: DataFrame) -> DataFrame:
    """Per type: probability, count, population moments of the sizes, and their correlations."""
    good = agent.filter(nondegenerate(F.col("length"), F.col("width"), F.col("height")))
    dims = ["length", "width", "height"]
    per = good.groupBy("object_type").agg(
        F.count("*").alias("n"), *[F.avg(d).alias(f"mean_{d}") for d in dims], *[F.stddev_pop(d).alias(f"std_{d}") for d in dims],
        F.corr("length", "width").alias("corr_lw"), F.corr("length", "height").alias("corr_lh"),
    )
    total = per.agg(F.sum("n").alias("_total"))  # one row
    return per.join(F.broadcast(total), F.lit(True)).withColumn("prob", F.col("n") / F.col("_total")).drop("_total")


def drift_audit(observed: DataFrame, reference: DataFrame, least: int = 30, sigma: float = 4.0) -> DataFrame:
    """Observed against reference distribution rows (``agent_distribution``): one row per type with pass flags."""
    ref = reference.select("object_type", *[F.col(c).alias(f"r_{c}") for c in reference.columns if c != "object_type"])
    total = observed.agg(F.sum("n").alias("_all"))
    j = ref.join(observed, "object_type", "left").join(F.broadcast(total), F.lit(True)).na.fill(0, ["n", "prob"])
    freq = F.abs(F.col("prob") - F.col("r_prob")) <= F.sqrt(F.col("r_prob") * (1 - F.col("r_prob")) / F.col("_all")) * sigma
    enough = F.col("n") >= least

    def mean_ok(d: str) -> Column:
        return F.when(enough, F.abs(F.col(f"mean_{d}") - F.col(f"r_mean_{d}")) <= F.col(f"r_std_{d}") / F.sqrt("n") * sigma)

    def corr_z(c: str) -> Column:
        se = F.sqrt(F.lit(1.0) / (F.col("n") - 3) + F.lit(1.0) / (F.col("r_n") - 3))
        return F.when(enough, F.abs(F.atanh(c) - F.atanh(f"r_{c}")) / se)

    return j.select(
        "object_type", "n", freq.alias("frequency_ok"), *[mean_ok(d).alias(f"{d}_ok") for d in ("length", "width", "height")],
        (corr_z("corr_lw") < sigma).alias("corr_lw_ok"), (corr_z("corr_lh") < sigma).alias("corr_lh_ok"),
    )


def conditioning_audit(df: DataFrame, uniform: list[str], others: list[str] = [], flag: str | None = None, distinct: str | None = None) -> DataFrame:
    """One row: are values in [0,1], uniform means near one half, the flag 0/1, and the values per-agent."""
    cols = [*uniform, *others]
    outside = reduce(lambda a, b: a | b, [(F.col(c) < -1e-3) | (F.col(c) > 1 + 1e-3) for c in cols])
    aggs = [F.count_if(outside).alias("out_of_range"), *[F.avg(c).alias(f"mean_{c}") for c in uniform], F.count("*").alias("n")]
    if flag:
        aggs.append(F.count_if(~F.col(flag).isin(0.0, 1.0)).alias("bad_flag"))
    if distinct:
        aggs.append(F.countDistinct(F.round(distinct, 6)).alias("distinct_values"))
    out = df.agg(*aggs)
    near = reduce(lambda a, b: a & b, [F.abs(F.col(f"mean_{c}") - 0.5) <= 0.05 for c in uniform])
    out = out.withColumn("uniform_ok", near)
    return out.withColumn("distinct_ok", F.col("distinct_values") >= F.col("n") * 0.9) if distinct else out


def episode_record(frame: DataFrame, by: list[str], order: str) -> DataFrame:
    """Frames, mean speed, mean agents, worst lane distance and start position per segment."""
    return frame.groupBy(*by).agg(
        F.count("*").alias("frames"), F.avg("speed").alias("mean_speed"), F.avg("num_agents").alias("mean_agents"),
        F.max("lane_start_distance").alias("max_offroad"), F.min_by(F.struct("x", "y"), order).alias("_s"),
    ).select(*by, "frames", "mean_speed", "mean_agents", "max_offroad", F.col("_s.x").alias("start_x"), F.col("_s.y").alias("start_y"))


def traffic_health(df: DataFrame, by: list[str], max_offroad: float, key: list[str]) -> DataFrame:
    """Share of vehicles off a lane and exact median speed; ``key`` makes the speed order total."""
    share = df.groupBy(*by).agg(F.avg((F.col("lane_distance") > max_offroad).cast("double")).alias("offroad_share"))
    return null_safe_join(share, exact_quantiles(df, by, "speed", key, {"median_speed": 0.5}), by, "left")


def route_audit(hops: DataFrame, by: list[str], key: list[str], short: float = 1.0, long: float = 80.0) -> DataFrame:
    """Percentiles of route segment ``length`` and the shares below ``short`` and above ``long``."""
    share = hops.groupBy(*by).agg(
        F.avg((F.col("length") < short).cast("double")).alias("short_share"), F.avg((F.col("length") > long).cast("double")).alias("long_share")
    )
    return null_safe_join(share, exact_quantiles(hops, by, "length", key, {"p1": 0.01, "p50": 0.5, "p99": 0.99}), by, "left")


def verify_dataset(processed: DataFrame, feature: DataFrame, key: list[str], dim: int, version: int) -> DataFrame:
    """One row per violated rule and key, instead of stopping at the first.

    ``processed`` has key + file + schema_version; ``feature`` has key + file, processed_file, vec, source_sha.
    """
    name = F.concat_ws("__", *[F.col(k).cast("string") for k in key])

    def rule(df: DataFrame, bad: Column, label: str) -> DataFrame:
        return df.filter(bad).select(F.lit(label).alias("rule"), *[F.col(k).cast("string").alias(k) for k in key])

    def pairing() -> DataFrame:
        return pair_strict(processed, feature, key).select(F.concat(F.lit("pairing: "), "reason").alias("rule"), *[F.col(k).cast("string").alias(k) for k in key])

    # The majority hash is the population's; one row after aggregation.
    common = feature.groupBy("source_sha").count().agg(F.max_by("source_sha", F.struct("count", "source_sha")).alias("_sha"))
    hashed = feature.join(F.broadcast(common), F.lit(True))
    return union_batches(
        pairing(),
        rule(processed, F.col("file") != name, "file name differs from identity"),
        rule(processed, F.col("schema_version") != version, "schema version"),
        rule(feature, F.col("file") != name, "feature file name differs from identity"),
        rule(feature, F.col("processed_file") != F.col("file"), "feature source differs"),
        rule(feature, F.size("vec") != dim, "vector length"),
        rule(feature, F.exists("vec", lambda v: ~finite(v)), "non-finite value"),
        rule(hashed, F.col("source_sha") != F.col("_sha"), "mixed source hash"),
    )
