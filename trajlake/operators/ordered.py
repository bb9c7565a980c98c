"""Order-dependent primitives that survive hot groups, in one plan for every size.

Rows of a group are dealt to buckets that follow the order, each bucket is handled by a window of its own, and one
row per bucket carries totals from the earlier buckets of its group.  So a group that holds a third of all rows is
spread over as many tasks as it has buckets.  A caller that knows a coarse monotone function of the order (the hour of
a timestamp, a key divided by a constant) passes it as ``bucket`` and the plan stays lazy, with one shuffle of the rows;
otherwise the rows are range-partitioned once, materialised, and the partition number is the bucket.

NULL is a group like any other: groups and buckets are compared as structs, whose NULL fields are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.session import cut_lineage


def null_safe_join(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on equal names where NULL meets NULL; the names come from the left side."""
    names = {c: f"_r_{c}" for c in by}
    right = right.withColumnsRenamed(names)
    same = F.struct(*[left[c].alias(c) for c in by]) == F.struct(*[right[n].alias(c) for c, n in names.items()])
    return left.join(right, same, how).drop(*names.values())


def _bucketed(df: DataFrame, by: list[str], order: list, bucket: Column | None) -> DataFrame:
    """Adds ``_group``, ``_bucket`` and their pair ``_key``; never NULL as a whole."""
    if bucket is None:
        keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
        # Partition bounds come from sampling, so they are fixed before two branches read them.
        df = cut_lineage(df.repartitionByRange(*keys).withColumn("_bucket", F.spark_partition_id()))
    else:
        df = df.withColumn("_bucket", bucket)
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    return df.withColumn("_group", group).withColumn("_key", F.struct("_group", "_bucket"))


def _across() -> Window:
    """Earlier buckets of a group; a window over one row per bucket."""
    return Window.partitionBy("_group").orderBy("_bucket")


def _carried(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """``rows`` with the carried columns of their bucket."""
    carry = carry.drop("_group", "_bucket").withColumnRenamed("_key", "_k2")
    return rows.join(carry, F.col("_key") == F.col("_k2")).drop("_k2")


HELPERS = ["_group", "_bucket", "_key"]


def with_index(df: DataFrame, by: list[str], order: list, name: str = "idx", bucket: Column | None = None, total: str | None = None) -> DataFrame:
    """Dense 0-based position of each row inside its group, ordered by ``order``, and the group's size as ``total``.

    ``order`` must be total (end with a unique key).
    """
    rows = _bucketed(df, by, order, bucket)
    sizes = rows.groupBy("_key", "_group", "_bucket").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(_across().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    whole = [F.sum("_rows").over(Window.partitionBy("_group")).alias(total)] if total else []
    inside = Window.partitionBy("_key").orderBy(*order)
    ranked = rows.withColumn("_pos", F.row_number().over(inside) - 1)
    out = _carried(ranked, sizes.select("*", before, *whole).drop("_rows"))
    return out.withColumn(name, (F.col("_pos") + F.col("_before")).cast("long")).drop("_pos", "_before", *HELPERS)


_SCANS = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
_MERGE = {
    "sum": lambda a, b: F.when(b.isNull(), a).otherwise(F.coalesce(a, F.lit(0)) + b), "max": F.greatest, "min": F.least,
    "last": lambda a, b: F.coalesce(b, a),
}


def prefix_scan(
    df: DataFrame, by: list[str], order: list, scans: dict[str, tuple[str, Column]], exclusive: bool = False, bucket: Column | None = None
) -> DataFrame:
    """Running sum / max / min / last non-null per group, over arbitrarily large groups."""
    rows = _bucketed(df.withColumns({f"_in_{out}": c for out, (_, c) in scans.items()}), by, order, bucket)
    inside = Window.partitionBy("_key").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    placed = rows.withColumn("_pos", F.row_number().over(inside)) if any(fn == "last" for fn, _ in scans.values()) else rows
    ran = placed.withColumns({f"_run_{out}": _SCANS[fn](F.col(f"_in_{out}")).over(upto) for out, (fn, _) in scans.items()})

    def total(fn: str, out: str) -> Column:
        value = F.col(f"_in_{out}")
        return F.max_by(value, F.when(value.isNotNull(), F.col("_pos"))) if fn == "last" else _SCANS[fn](value)

    sums = placed.groupBy("_key", "_group", "_bucket").agg(*[total(fn, out).alias(f"_tot_{out}") for out, (fn, _) in scans.items()])
    earlier = _across().rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("_key", "_group", "_bucket", *[_SCANS[fn](F.col(f"_tot_{out}")).over(earlier).alias(f"_carry_{out}") for out, (fn, _) in scans.items()])
    out = _carried(ran, carry)
    merged = {o: _MERGE[fn](F.col(f"_carry_{o}"), F.col(f"_run_{o}")) for o, (fn, _) in scans.items()}
    return out.withColumns(merged).select(*df.columns, *scans)


def with_neighbours(
    df: DataFrame, by: list[str], order: list, before: dict[str, str] | None = None, after: dict[str, str] | None = None, bucket: Column | None = None
) -> DataFrame:
    """Values of the preceding and the following row of the group (``{new name: column}``)."""
    before, after = before or {}, after or {}
    rows = _bucketed(df, by, order, bucket)
    w = Window.partitionBy("_key").orderBy(*order)
    rows = rows.withColumns({"_pos": F.row_number().over(w), "_size": F.count("*").over(Window.partitionBy("_key"))})
    rows = rows.withColumns({f"_lag_{n}": F.lag(c).over(w) for n, c in before.items()} | {f"_lead_{n}": F.lead(c).over(w) for n, c in after.items()})
    # The ends of a bucket meet the last row of the bucket before and the first row of the bucket after.
    last = F.max_by(F.struct(F.lit(1).alias("one"), *[F.col(c).alias(n) for n, c in before.items()]), "_pos")
    first = F.min_by(F.struct(F.lit(1).alias("one"), *[F.col(c).alias(n) for n, c in after.items()]), "_pos")
    ends = rows.groupBy("_key", "_group", "_bucket").agg(last.alias("_last"), first.alias("_first"))
    carry = ends.select("_key", "_group", "_bucket", F.lag("_last").over(_across()).alias("_tail"), F.lead("_first").over(_across()).alias("_head"))
    out = _carried(rows, carry)
    values = {n: F.when(F.col("_pos") == 1, F.col("_tail")[n]).otherwise(F.col(f"_lag_{n}")) for n in before}
    values |= {n: F.when(F.col("_pos") == F.col("_size"), F.col("_head")[n]).otherwise(F.col(f"_lead_{n}")) for n in after}
    return out.withColumns(values).select(*df.columns, *before, *after)


def with_previous(df: DataFrame, by: list[str], order: list, cols: dict[str, str], bucket: Column | None = None) -> DataFrame:
    """Value of ``cols`` in the preceding row of the group (``{new name: column}``)."""
    return with_neighbours(df, by, order, before=cols, bucket=bucket)


def exact_quantiles(df: DataFrame, by: list[str], value: str, key: list[str], qs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group, from row positions instead of a per-group value map.

    The built-in exact percentile keeps every distinct value of a group in one task; positions come from
    ``with_index``, which spreads hot groups, and the aggregation keeps two numbers per quantile.
    """
    known = df.select(*by, value, *[k for k in key if k not in (*by, value)]).filter(F.col(value).isNotNull())
    ranked = with_index(known, by, [value, *key], "_i", total="_n")
    aggs = []
    for name, q in qs.items():
        at = (F.col("_n") - 1) * q
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when(F.col("_i") == pos, F.col(value))).alias(f"_{side}_{name}"))
    out = ranked.groupBy(*by, "_n").agg(*aggs)

    def mixed(name: str, q: float) -> Column:
        at = (F.col("_n") - 1) * q
        low = F.col(f"_lo_{name}")
        return low + (F.col(f"_hi_{name}") - low) * (at - F.floor(at))

    return out.select(*by, *[mixed(name, q).alias(name) for name, q in qs.items()])
