"""Domain-shaped relations derived from the given tables, whole tables each time.

Every event belongs to exactly one track: a user's events in time order are cut into tracks of
``TRACK`` steps, so no row is left out and no track grows with the data.  ``SQL`` holds the same
relations as text for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.operators.ordered import with_index

TRACK, HORIZON, LINE = 40, 32, 16
ROLLOUTS = 4
_SHIFT = 100_000_000
KEYS_PER_BUCKET = 1 << 16


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _indexed_events(spark: SparkSession, sf: str, by: str, *extra: str) -> DataFrame:
    scan = table(spark, sf, "events")
    cols = list(dict.fromkeys([by, "ts", "event_id", *extra]))
    return with_index(scan.select(*cols), [by], ["ts", "event_id"], bucket=F.date_trunc("DAY", "ts"))


def _k():
    return F.regexp_extract("props", "[0-9]+", 0).cast("double")


def log(spark: SparkSession, sf: str) -> DataFrame:
    """Logged agents: agent_state joined with its agent dimension columns."""
    e = _indexed_events(spark, sf, "user_id", "event_type", "value", "props").withColumn("k", _k())
    u, chunk = F.col("user_id"), F.expr(f"idx div {TRACK}")
    step = F.col("idx") % TRACK
    return e.select(
        (chunk * _SHIFT + F.expr("user_id div 10")).alias("scenario_id"),
        F.expr("user_id div 10").alias("map_id"),
        u.alias("agent_id"),
        step.alias("step"),
        (step * F.lit(1.0) + F.col("value") / 50.0).alias("x"),
        ((u % 7) * F.lit(4.0) + F.col("k") / 25.0).alias("y"),
        (F.col("value") / 10.0).alias("vx"),
        ((F.col("k") - 50.0) / 25.0).alias("vy"),
        ((F.col("k") - 50.0) / 50.0).alias("heading"),
        (F.col("event_type") != "error").alias("valid"),
        (F.lit(4.5) + (u % 3) * F.lit(0.25)).alias("length"),
        F.lit(2.0).alias("width"),
        (F.lit(1) + (u % 7) % 3).alias("object_type"),
        (step * 100000 + F.col("k") * 1000).cast("long").alias("timestamp_micros"),
    )


def crowd(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    """The log with all users of a track and step in one frame: blocks of agents, some of them apart."""
    base = log(spark, sf) if base is None else base
    u = F.col("agent_id")
    return base.withColumns({
        "scenario_id": F.expr(f"scenario_id div {_SHIFT}"), "x": F.col("x") + (u % 13) * F.lit(6.0) + F.when(u % 29 == 0, 400.0).otherwise(0.0),
        "y": F.col("y") + F.expr("agent_id div 13") * F.lit(1.5), "rollout": F.lit(-1).cast("long"),
    })


def sim(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    """Simulated agents: four deterministic perturbations of the log."""
    base = log(spark, sf) if base is None else base
    r = F.col("rollout")
    return (
        base.withColumn("rollout", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ROLLOUTS - 1).cast("long"))))
        .withColumn("x", F.col("x") + F.lit(0.25) * r * (F.col("agent_id") % 7 - 3))
        .withColumn("y", F.col("y") + F.lit(0.125) * (r - 1))
        .withColumn("heading", F.col("heading") + F.lit(0.0625) * r)
        .drop("valid", "vx", "vy", "timestamp_micros")
    )


def road_point(spark: SparkSession, sf: str) -> DataFrame:
    """Road polylines from the orders of five customers each, cut every ``LINE`` points."""
    scan = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    o = scan.select(F.expr("o_custkey div 5").alias("grp"), "o_orderkey")
    o = with_index(o, ["grp"], ["o_orderkey"], bucket=F.expr(f"o_orderkey div {KEYS_PER_BUCKET}"))
    pid = F.expr(f"(idx div {LINE}) * {_SHIFT} + grp")
    return (
        o.withColumn("polyline_id", pid)
        .withColumn("pt_idx", F.col("idx") % LINE)
        .select(
            F.expr("grp div 20").alias("map_id"),
            "polyline_id",
            "pt_idx",
            (F.col("pt_idx") * F.lit(4.0) + F.col("polyline_id") % 4 * F.lit(60.0)).alias("x"),
            (F.expr("(polyline_id div 4) % 15") * F.lit(2.0) + (F.col("o_orderkey") % 7) / F.lit(7.0)).alias("y"),
            (F.lit(4) + F.expr("(polyline_id div 8) % 3")).alias("road_type"),
        )
    )


def transition(spark: SparkSession, sf: str) -> DataFrame:
    """Rollout segments of ``HORIZON`` steps."""
    e = _indexed_events(spark, sf, "user_id", "event_type", "value", "props").withColumn("k", _k())
    return e.select(
        F.expr(f"(idx div {HORIZON}) * {_SHIFT} + user_id").alias("segment"),
        (F.col("idx") % HORIZON).alias("t"),
        (F.col("value") / 100.0).alias("reward"),
        (F.col("k") / 100.0).alias("value"),
        F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("terminal"),
        F.when(F.col("event_type") == "signup", 1.0).otherwise(0.0).alias("truncation"),
        (F.lit(0.5) + F.col("k") / 100.0).alias("ratio"),
        (F.col("k") / 50.0 - 1.0).alias("logprob"),
        (F.col("k") / 40.0 - F.col("value") / 200.0 - 1.0).alias("new_logprob"),
        (F.col("value") / 50.0).alias("new_value"),
    )


def metric_log(spark: SparkSession, sf: str) -> DataFrame:
    """One metric per run and epoch; five runs, so every run is a hot key."""
    e = _indexed_events(spark, sf, "event_type", "value")
    return e.select(F.col("event_type").alias("run"), (F.col("idx") + 1).alias("epoch"), F.col("value").alias("metric"))


def run_obs(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("run"))
        .agg(F.count("*").cast("double").alias("score"), F.round(F.sum("o_totalprice"), 2).alias("cost"))
    )


def segment(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("segment_id"), F.col("c_nationkey").cast("long").alias("town"), F.col("c_acctbal").alias("start_x")
    )


def feature(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with a paired prediction (the vector reversed), label as segment."""
    return table(spark, sf, "embeddings").select(
        F.col("label").cast("long").alias("segment_id"),
        "vec_id",
        F.transform("embedding", lambda v: v.cast("double")).alias("target"),
        F.reverse(F.transform("embedding", lambda v: v.cast("double"))).alias("pred"),
    )


_K = "cast(regexp_extract(props, '[0-9]+', 0) as double)"

SQL = {
    "log": f"""log as (
  select (idx // {TRACK}) * {_SHIFT} + user_id // 10 as scenario_id, user_id // 10 as map_id, user_id as agent_id,
         idx % {TRACK} as step, 1.0e0 * (idx % {TRACK}) + value / 50.0e0 as x, 4.0e0 * (user_id % 7) + k / 25.0e0 as y,
         value / 10.0e0 as vx, (k - 50.0e0) / 25.0e0 as vy, (k - 50.0e0) / 50.0e0 as heading,
         event_type <> 'error' as valid, 4.5e0 + 0.25e0 * (user_id % 3) as length, 2.0e0 as width,
         1 + (user_id % 7) % 3 as object_type, cast((idx % {TRACK}) * 100000 + k * 1000 as bigint) as timestamp_micros
  from (select user_id, event_type, value, {_K} as k,
               row_number() over (partition by user_id order by ts, event_id) - 1 as idx from events))""",
    "crowd": f"""crowd as (
  select * replace (scenario_id // {_SHIFT} as scenario_id, x + 6.0e0 * (agent_id % 13) + case when agent_id % 29 = 0 then 400.0e0 else 0.0e0 end as x,
         y + 1.5e0 * (agent_id // 13) as y), cast(-1 as bigint) as rollout from log)""",
    "sim": f"""sim as (
  select scenario_id, map_id, agent_id, rollout, step, x + 0.25e0 * rollout * (agent_id % 7 - 3) as x,
         y + 0.125e0 * (rollout - 1) as y, heading + 0.0625e0 * rollout as heading, length, width, object_type
  from log cross join (select unnest(range({ROLLOUTS})) as rollout))""",
    "road_point": f"""road_point as (
  select grp // 20 as map_id, polyline_id, pt_idx, 4.0e0 * pt_idx + 60.0e0 * (polyline_id % 4) as x,
         2.0e0 * ((polyline_id // 4) % 15) + (o_orderkey % 7) / 7.0e0 as y, 4 + (polyline_id // 8) % 3 as road_type
  from (select grp, o_orderkey, (idx // {LINE}) * {_SHIFT} + grp as polyline_id, idx % {LINE} as pt_idx
        from (select o_custkey // 5 as grp, o_orderkey,
                     row_number() over (partition by o_custkey // 5 order by o_orderkey) - 1 as idx from orders)))""",
    "road_segment": """road_segment as (
  select * from (select map_id, polyline_id, pt_idx as seg_idx, road_type, x as x0, y as y0,
     lead(x) over w as x1, lead(y) over w as y1, lag(x) over w as xp, lag(y) over w as yp,
     lead(x, 2) over w as x2, lead(y, 2) over w as y2
   from road_point window w as (partition by polyline_id order by pt_idx)) where x1 is not null)""",
    "transition": f"""transition as (
  select (idx // {HORIZON}) * {_SHIFT} + user_id as segment, idx % {HORIZON} as t, value / 100.0e0 as reward, k / 100.0e0 as value,
         case when event_type = 'error' then 1.0e0 else 0.0e0 end as terminal,
         case when event_type = 'signup' then 1.0e0 else 0.0e0 end as truncation,
         0.5e0 + k / 100.0e0 as ratio, k / 50.0e0 - 1.0e0 as logprob, k / 40.0e0 - value / 200.0e0 - 1.0e0 as new_logprob,
         value / 50.0e0 as new_value
  from (select user_id, event_type, value, {_K} as k,
               row_number() over (partition by user_id order by ts, event_id) - 1 as idx from events))""",
    "metric_log": """metric_log as (
  select event_type as run, row_number() over (partition by event_type order by ts, event_id) as epoch, value as metric
  from events)""",
    "run_obs": """run_obs as (
  select o_custkey as run, cast(count(*) as double) as score, round(sum(o_totalprice), 2) as cost
  from orders group by o_custkey)""",
    "segment": """segment as (
  select c_custkey as segment_id, cast(c_nationkey as bigint) as town, c_acctbal as start_x from customer)""",
    "feature": """feature as (
  select cast(label as bigint) as segment_id, vec_id, cast(embedding as double[]) as target,
         list_reverse(cast(embedding as double[])) as pred from embeddings)""",
}
_NEEDS = {"sim": ["log"], "crowd": ["log"], "road_segment": ["road_point"]}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` (which may start with further CTEs after a comma) with the named relations."""
    order: list[str] = []
    for name in names:
        for n in [*_NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    body = body.strip()
    head = "with " + ",\n".join(SQL[n] for n in order)
    return f"{head}{body}" if body.startswith(",") else f"{head}\n{body}"
