"""Queries: observation scaling, ego vectors, curation, audits, vector statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trajlake.functions import scaling as sl
from trajlake.operators import curation as cu
from trajlake.operators import egostate as eg
from trajlake.operators import vectors as ve
from trajlake.plans import proxies as px
from trajlake.plans.q_core import ID, IDS, pose_column, segments
from trajlake.plans.registry import query, r, r6, rounded

DRIVE = ["scenario_id", "agent_id"]

# ---------------------------------------------------------------- B21-B23, B26, B27

CENTER = """
, pts as (select scenario_id, x, y from log where valid)
, roads as (select scenario_id, p.x, p.y from (select distinct scenario_id, map_id from log) join road_point p using (map_id))
, mean as (select scenario_id, (coalesce(a.sx, 0) + coalesce(b.sx, 0)) / (coalesce(a.n, 0) + coalesce(b.n, 0)) as mx, (coalesce(a.sy, 0) + coalesce(b.sy, 0)) / (coalesce(a.n, 0) + coalesce(b.n, 0)) as my
   from (select scenario_id, sum(x) as sx, sum(y) as sy, count(*) as n from pts group by scenario_id) a
   full join (select scenario_id, sum(x) as sx, sum(y) as sy, count(*) as n from roads group by scenario_id) b using (scenario_id))"""


@query("b21_center_scenario", px.with_views(
    f"{CENTER} select {IDS}, {r('case when valid then x - mx else x end', 'x')}, {r('case when valid then y - my else y end', 'y')} from log join mean using (scenario_id)",
    "log", "road_point"))
def _(spark, sf):
    from trajlake.sources.scenario import center_scenario, scenario_center

    log = px.log(spark, sf)
    # Road sums are taken once per map and attached to its scenarios as one row each.
    roads = px.road_point(spark, sf)
    center = scenario_center(log, roads, "map_id")
    return rounded(center_scenario(log, center).select(*ID, "x", "y"), "x", "y")


BOUNDS = [(0.0, 600.0), (0.0, 99.0), (5.0, 5.0), (-1.0, 1.0)]


@query("b22_conditioning_norm", f"""with e as (select event_id, value, cast(regexp_extract(props, '[0-9]+', 0) as double) as k from events)
    select event_id, {r('value / 600.0e0', 'c0')}, {r('k / 99.0e0', 'c1')}, 0.0e0 as c2, {r('(k / 50.0e0 - 1.0e0 + 1.0e0) / 2.0e0', 'c3')}, {r('value', 'back')} from e""")
def _(spark, sf):
    e = px.table(spark, sf, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("double"))
    # Event values have no upper bound, so the round trip also holds outside the range.
    v = sl.conditioning_norm(F.array("value", "k", F.lit(7.0), F.col("k") / 50.0 - 1.0), BOUNDS)
    e = e.withColumn("n", v).withColumn("back", sl.conditioning_denorm(F.col("n"), BOUNDS, strict=False))
    return e.select("event_id", *[r6(F.get("n", F.lit(i))).alias(f"c{i}") for i in range(4)], r6(F.get("back", F.lit(0))).alias("back"))


@query("b23_scale_param", f"""select o_orderkey, {r('(o_totalprice - 100.0e0) / 599900.0e0 * 2 - 1', 'linear')},
    {r('(ln(o_totalprice) / ln(2.0e0) - ln(512.0e0) / ln(2.0e0)) / (ln(1048576.0e0) / ln(2.0e0) - ln(512.0e0) / ln(2.0e0)) * 2 - 1', 'pow2')},
    {r('(log10(o_totalprice) - 2.0e0) / 4.0e0 * 2 - 1', 'log10')},
    {r('(log10(1 - o_totalprice / 1000000.0e0) - log10(0.9e0)) / (log10(0.001e0) - log10(0.9e0)) * 2 - 1', 'logit')}, {r('o_totalprice', 'back')} from orders""")
def _(spark, sf):
    p = F.col("o_totalprice")
    log10 = sl.scale_param("log10", p, 100.0, 1e6)
    return px.table(spark, sf, "orders").select(
        "o_orderkey", r6(sl.scale_param("linear", p, 100.0, 6e5)).alias("linear"), r6(sl.scale_param("pow2", p, 512.0, 1048576.0)).alias("pow2"),
        r6(log10).alias("log10"), r6(sl.scale_param("logit", p / 1e6, 0.1, 0.999)).alias("logit"), r6(sl.unscale_param("log10", log10, 100.0, 1e6)).alias("back"))


@query("b26_normalize_ego", px.with_views(
    f"""select {IDS}, {r('x * 0.005e0', 'goal_x')}, {r('y * 0.005e0', 'goal_y')}, {r('vx / 100.0e0', 'speed')}, {r('width / 15.0e0', 'width')}, {r('length / 30.0e0', 'length')},
    {r('heading / pi()', 'steering')}, {r('case when vy < 0 then vy / 15.0e0 else vy / 4.0e0 end', 'a_long')}, {r('vy / 4.0e0', 'a_lat')}, {r('object_type / 3.0e0', 'type')} from log""", "log"))
def _(spark, sf):
    c = {n: F.col(n) for n in ("x", "y", "vx", "width", "length", "heading", "vy", "object_type")}
    n = sl.normalize_ego(c["x"], c["y"], c["vx"], c["width"], c["length"], c["heading"], c["vy"], c["vy"], c["object_type"])
    return px.log(spark, sf).select(*ID, *[r6(v).alias(k) for k, v in n.items()])


def trace(log):
    """A per-step trace: state columns and reward terms derived from the log."""
    s = {
        "collision_state": F.col("agent_id") % 3 * F.when(F.col("valid"), 0).otherwise(1), "speed": F.abs("vx"), "signed_speed": F.col("vx") - 2.0,
        "a_long": F.col("vy") * 2, "a_lat": F.col("vy"), "jerk_long": F.col("vx"), "jerk_lat": F.col("vy"), "lane_ref_valid": F.col("step") % 4 != 3,
        "lane_valid": F.col("step") % 4 == 0, "heading_error": F.col("heading"), "lateral_offset": F.col("y") / 8.0, "goal_distance": F.lit(40.0) - F.col("x"),
        "goal_pending": F.col("valid"), "is_final": F.col("step") > 20,
    }
    c = {k: F.lit(v) for k, v in {"collision": 1.0, "boundary": 0.5, "comfort": 0.25, "vel_align": 0.5, "l_align": 0.1, "l_center": 0.2, "center_bias": 0.5,
                                  "reverse": 0.3, "goal_radius": 8.0}.items()}
    terms = sl.reward_terms(s, c)
    state = {"collision_state": s["collision_state"], "lane_valid": s["lane_valid"], "speed": s["speed"], "goal_distance": s["goal_distance"]}
    return log.select(*ID, *[v.alias(k) for k, v in state.items()], *[v.alias(k) for k, v in terms.items()])


TRACE = """
, st as (select scenario_id, agent_id, step, agent_id % 3 * (case when valid then 0 else 1 end) as collision_state, abs(vx) as speed, vx - 2.0e0 as v, vy * 2 as a_long, vy as a_lat, vx as j1, vy as j2,
    step % 4 <> 3 as lane_ref_valid, step % 4 = 0 as lane_valid, heading as th, abs(y / 8.0e0 - 0.5e0) as d_raw, 40.0e0 - x as goal_distance, valid, step from log)
, trace as (select scenario_id, agent_id, step, collision_state, lane_valid, speed, goal_distance,
    case when collision_state = 1 then -(1.0e0 + 0.1e0 * speed) else 0.0e0 end as r_collision, case when collision_state = 2 then -0.5e0 else 0.0e0 end as r_offroad,
    -0.25e0 * ((case when abs(a_long) > 3 then 1 else 0 end) + (case when abs(a_lat) > 3 then 1 else 0 end) + (case when abs(j1) > 5 or abs(j2) > 5 then 1 else 0 end)) as r_comfort,
    case when lane_ref_valid then 0.1e0 * 0.1e0 * (least(cos(th), 0) + 0.5e0 * least(cos(th) * v, 0) + 0.0025e0 * (1 - abs(th) / (pi() / 2))) else 0.0e0 end as r_align,
    -0.2e0 * 0.1e0 * case when lane_ref_valid then (case when lane_valid and cos(th) <= 0.5e0 then 0.0e0 else least(d_raw, 6.0e0) end) - 0.05e0 / exp(least(d_raw, 6.0e0) - 0.5e0)
       else 6.0e0 - 0.05e0 / exp(5.5e0) end as r_center,
    case when lane_valid and abs(v) > 2.5e0 then 0.0025e0 * 0.1e0 * greatest(cos(th), 0) else 0.0e0 end as r_velocity, case when v < 0 then -0.3e0 * 0.1e0 else 0.0e0 end as r_reverse,
    case when abs(v) > 0 or abs(a_long) > 0 then -0.000025e0 * 0.1e0 else 0.0e0 end as r_timestep,
    case when goal_distance < 8.0e0 and valid and (step <= 20 or speed <= 3.0e0) then 1.0e0 else 0.0e0 end as r_goal from st)"""


@query("b27_reward_terms", px.with_views(f"{TRACE.replace(', valid, step from log', ', valid from log')} select {IDS}, {', '.join(r(t, t, 9) for t in sl.REWARD_TERMS)} from trace", "log"))
def _(spark, sf):
    t = trace(px.log(spark, sf))
    return t.select(*ID, *[r6(c, 9).alias(c) for c in sl.REWARD_TERMS])


TRACE_SQL = TRACE.replace(", valid, step from log", ", valid from log")

# ---------------------------------------------------------------- E4-E7, C16

GRAD = """case when lag({v}) over w is not null and lead({v}) over w is not null then
   ((t - lag(t) over w) * (t - lag(t) over w) * lead({v}) over w + ((lead(t) over w - t) * (lead(t) over w - t) - (t - lag(t) over w) * (t - lag(t) over w)) * {v} - (lead(t) over w - t) * (lead(t) over w - t) * lag({v}) over w)
   / ((t - lag(t) over w) * (lead(t) over w - t) * (lead(t) over w - lag(t) over w))
  when lead({v}) over w is not null then (lead({v}) over w - {v}) / (lead(t) over w - t) when lag({v}) over w is not null then ({v} - lag({v}) over w) / (t - lag(t) over w) else 0.0e0 end"""
WIN = "window w as (partition by scenario_id, agent_id order by step)"


@query("e04_gradient", px.with_views(
    f", b as (select *, timestamp_micros / 1000000.0e0 as t from log) select {IDS}, {r(GRAD.format(v='x'), 'dx')} from b {WIN}", "log"))
def _(spark, sf):
    w = Window.partitionBy(*DRIVE).orderBy("step")
    log = px.log(spark, sf).withColumn("t", F.col("timestamp_micros") / F.lit(1e6))
    return log.select(*ID, r6(eg.gradient(F.col("x"), F.col("t"), w)).alias("dx"))


WRAPPED = "(({0}) + pi()) - 2 * pi() * floor((({0}) + pi()) / (2 * pi())) - pi()"


@query("e05_unwrap", px.with_views(
    f""", b as (select *, {WRAPPED.format('heading * 5')} as a from log), d as (select *, coalesce(a - lag(a) over w, 0) as d from b {WIN})
    select {IDS}, {r(f'first_value(a) over w + sum({WRAPPED.format("d")}) over w', 'unwrapped')} from d {WIN}""", "log"))
def _(spark, sf):
    from trajlake.functions.geometry import wrap_angle

    log = px.log(spark, sf).withColumn("a", wrap_angle(F.col("heading") * 5))
    return eg.unwrap(log, "a", DRIVE, "step", "u").select(*ID, r6("u").alias("unwrapped"))


ARC = f""", hop as (select *, coalesce(sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)), 0) as hop from drive {WIN})
, arc as (select *, sum(hop) over w as arc from hop {WIN})"""


@query("e07_arclength", px.with_views(f", drive as (select * from log){ARC} select {IDS}, {r('arc', 'arc')} from arc", "log"))
def _(spark, sf):
    return eg.arclength(px.log(spark, sf), DRIVE, "step").select(*ID, r6("arc").alias("arc"))


@query("e07_route_goals", px.with_views(
    f""", drive as (select * from log){ARC}
    , tot as (select scenario_id, agent_id, max(arc) as total, max(step) as last, least(6, greatest(1, ceil(max(arc) / 50.0e0))) as n from arc group by scenario_id, agent_id)
    , tgt as (select *, total / n * k as target from tot cross join (select unnest(range(1, 7)) as k) where k < n)
    select distinct scenario_id, agent_id, step from (
      select a.scenario_id, a.agent_id, min(a.step) as step from tgt t join arc a on a.scenario_id = t.scenario_id and a.agent_id = t.agent_id and a.arc >= t.target group by a.scenario_id, a.agent_id, k
      union all select scenario_id, agent_id, last from tot)""", "log"))
def _(spark, sf):
    return eg.route_goals(px.log(spark, sf), DRIVE, "step", 6)


LOOK = f""", drive as (select scenario_id, agent_id, step, timestamp_micros, heading as yaw, x + {{axle}} * cos(heading) as x, y + {{axle}} * sin(heading) as y from log){ARC}
, fin as (select *, last_value(x) over v as lx, last_value(y) over v as ly, last_value(yaw) over v as lyaw, last_value(arc) over v as larc from arc
    window v as (partition by scenario_id, agent_id order by step rows between unbounded preceding and unbounded following))
, goal as (select f.*, coalesce(g.x, lx + (arc + 30.0e0 - larc) * cos(lyaw)) as gx, coalesce(g.y, ly + (arc + 30.0e0 - larc) * sin(lyaw)) as gy
   from fin f left join (select a.scenario_id, a.agent_id, a.step, b.x, b.y, row_number() over (partition by a.scenario_id, a.agent_id, a.step order by b.step) as rn
      from arc a join arc b on a.scenario_id = b.scenario_id and a.agent_id = b.agent_id and b.arc >= a.arc + 30.0e0) g
   on g.rn = 1 and f.scenario_id = g.scenario_id and f.agent_id = g.agent_id and f.step = g.step)"""


@query("c16_lookahead_goal", px.with_views(f"{LOOK.format(axle='0.0e0')} select {IDS}, {r('gx', 'goal_x')}, {r('gy', 'goal_y')} from goal", "log"))
def _(spark, sf):
    g = eg.lookahead_goal(px.log(spark, sf).withColumn("yaw", F.col("heading")), DRIVE, "step")
    return g.select(*ID, r6("goal_x").alias("goal_x"), r6("goal_y").alias("goal_y"))


@query("e06_ego_observations", px.with_views(
    f"""{LOOK.format(axle='1.44e0')}
    , un as (select *, timestamp_micros / 1000000.0e0 as t, first_value(yaw) over w + sum(dy) over w as uyaw from
        (select *, coalesce({WRAPPED.format('yaw - lag(yaw) over w')}, 0) as dy from goal {WIN}) {WIN})
    , d1 as (select *, {GRAD.format(v='x')} as vx, {GRAD.format(v='y')} as vy, {GRAD.format(v='uyaw')} as rate from un {WIN})
    , d2 as (select *, least(greatest(case when vx * cos(yaw) + vy * sin(yaw) < 0 then -sqrt(vx * vx + vy * vy) else sqrt(vx * vx + vy * vy) end, -2.0e0), 20.0e0) as v from d1)
    , d3 as (select *, least(greatest({GRAD.format(v='v')}, -5.0e0), 2.5e0) as al, least(greatest(v * rate, -4.0e0), 4.0e0) as at_,
        least(greatest(atan(case when abs(v) >= 0.5e0 then rate / v else 0.0e0 end * 0.6e0 * 4.5e0), -0.55e0), 0.55e0) as steer from d2 {WIN})
    select scenario_id, agent_id, timestamp_micros, {r('((gx - x) * cos(yaw) + (gy - y) * sin(yaw)) * 0.005e0', 'o0')}, {r('((gy - y) * cos(yaw) - (gx - x) * sin(yaw)) * 0.005e0', 'o1')},
      {r('v / 100.0e0', 'o2')}, {r('2.0e0 / 15.0e0', 'o3')}, {r('4.5e0 / 30.0e0', 'o4')}, {r('steer / pi()', 'o6')}, {r('case when al < 0 then al / 15.0e0 else al / 4.0e0 end', 'o7')}, {r('at_ / 4.0e0', 'o8')}, 0.0e0 as o5, 0.0e0 as o9, {r('1.0e0 / 3.0e0', 'o10')}
    from d3""", "log"))
def _(spark, sf):
    frame = px.log(spark, sf).select(*DRIVE, "timestamp_micros", pose_column().alias("pose"))
    o = eg.ego_observations(frame, DRIVE, 4.5, 2.0)
    return o.select(*DRIVE, "timestamp_micros", *[r6(F.get("obs", F.lit(i))).alias(f"o{i}") for i in range(11)])


# ---------------------------------------------------------------- pairing, splits, strides


@query("c01_align_rollouts", px.with_views(
    f""", s as (select scenario_id, agent_id, max(greatest(abs(s.x - l.x), abs(s.y - l.y))) as off from (select * replace (case when agent_id % 11 = 0 then -1 - agent_id else agent_id end as agent_id) from sim) s join log l using (scenario_id, agent_id, step) where step = 0 group by scenario_id, agent_id)
    select scenario_id, agent_id, {r('off', 'start_offset')}, case when off is null then 'missing' when off > 0.13e0 then 'moved' else 'aligned' end as status
    from (select * from log where step = 0) l left join s using (scenario_id, agent_id)""", "sim"))
def _(spark, sf):
    # Agents with an id divisible by 11 come back from the simulator under an id that nobody knows.
    log = px.log(spark, sf)
    sim = px.sim(spark, sf, log).withColumn("agent_id", F.when(F.col("agent_id") % 11 == 0, -1 - F.col("agent_id")).otherwise(F.col("agent_id")))
    return rounded(cu.align_rollouts(sim, log, 0.13), "start_offset")


@query("c02_pair_strict", """with a as (select case when l_returnflag = 'R' then -l_orderkey else l_orderkey end as k, count(*) as n from lineitem group by 1), b as (select case when o_orderstatus = 'P' then -o_orderkey else o_orderkey end as k, count(*) as n from orders group by 1)
    , j as (select k, coalesce(a.n, 0) as left_rows, coalesce(b.n, 0) as right_rows from a full join b using (k))
    select * from (select k, left_rows, right_rows, case when left_rows = 0 then 'unknown reference' when right_rows = 0 then 'unpaired' when left_rows > 1 or right_rows > 1 then 'paired more than once' end as reason from j) where reason is not null""")
def _(spark, sf):
    a = px.table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "R", -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("k"))
    b = px.table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "P", -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("k"))
    return cu.pair_strict(a, b, ["k"])


@query("c03_join_ego", px.with_views(f"select {IDS}, {r('heading', 'obs0')} from log", "log"))
def _(spark, sf):
    log = px.log(spark, sf)
    ego = log.select("scenario_id", "agent_id", "timestamp_micros", F.array("heading").alias("obs"))
    out = cu.join_ego(log.drop("heading"), ego, ["scenario_id", "agent_id", "timestamp_micros"])
    return out.select(*ID, r6(F.get("obs", F.lit(0))).alias("obs0"))


SPLIT_TOKEN = "sha256('7' || ':' || cast(town as varchar) || ':' || cast(segment_id as varchar))"


@query("f02_stratified_split", px.with_views(
    f""", h as (select segment_id, town, row_number() over (partition by town order by {SPLIT_TOKEN}, segment_id) - 1 as i from segment)
    select segment_id, town, case when i < 2 then 'training' else 'validation' end as split from h where i < 3""", "segment"))
def _(spark, sf):
    return cu.stratified_split(px.segment(spark, sf), 2, 1, 7).select("segment_id", "town", "split")


@query("c25_apply_split", px.with_views(
    f""", h as (select segment_id, town, row_number() over (partition by town order by {SPLIT_TOKEN}, segment_id) - 1 as i from segment)
    , s as (select segment_id, case when i < 2 then 'training' else 'validation' end as split from h where i < 3)
    select segment_id, split, count(o_orderkey) as frames from s left join orders on o_custkey = segment_id group by segment_id, split""", "segment"))
def _(spark, sf):
    split = cu.stratified_split(px.segment(spark, sf), 2, 1, 7).select("segment_id", "split")
    samples = px.table(spark, sf, "orders").select(F.col("o_custkey").alias("segment_id"))
    return cu.apply_split(samples, split)


@query("e08_stride", "select event_id, user_id from (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events) where i % 3 = 0")
def _(spark, sf):
    e = px.table(spark, sf, "events").select("event_id", "user_id", "ts")
    return cu.stride(e, ["user_id"], ["ts", "event_id"], 3).select("event_id", "user_id")


@query("e09_linspace_sample", """with i as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i, count(*) over () as n from orders)
    select o_orderkey from i where i in (select cast(floor(j * ((select count(*) from orders) - 1) / 99.0e0) as bigint) from (select unnest(range(100)) as j))""")
def _(spark, sf):
    return cu.linspace_sample(px.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 100)


@query("a07_assign_map_ids", "select path, row_number() over (order by path) - 1 as map_id from (select distinct c_mktsegment || '/' || c_name as path from customer)")
def _(spark, sf):
    c = px.table(spark, sf, "customer").select(F.concat_ws("/", "c_mktsegment", "c_name").alias("path"))
    return cu.assign_map_ids(c)


@query("a10_pending", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem group by l_orderkey having bool_and(l_linestatus = 'F'))")
def _(spark, sf):
    lines = px.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_and(F.col("l_linestatus") == "F").alias("whole"))
    done = lines.filter("whole").select("o_orderkey")
    return cu.pending(px.table(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("f01_sample_per_group", "select p_brand, p_partkey, p_size from (select *, row_number() over (partition by p_brand order by md5(concat_ws(':', p_partkey, 3)), p_partkey) as r from part) where r <= 8")
def _(spark, sf):
    p = px.table(spark, sf, "part").select("p_brand", "p_partkey", "p_size")
    return cu.sample_per_group(p, ["p_brand"], ["p_partkey"], 8, seed=3)


def crc32_sql(rows: str, text: str) -> str:
    """CTEs up to ``coded``: the columns of ``rows`` and ``crc``, CRC-32 of the UTF-8 bytes of ``text``, from its polynomial."""
    return f"""with recursive bits(i, k, v) as (select i, 0, i::bigint from range(256) t(i) union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8)
    , tab as (select list(v order by i) as t from bits where k = 8)
    , hexed as (select *, hex(encode({text})) as x from {rows})
    , bytes as (select *, list_transform(range(0, length(x) // 2), lambda k: 16 * (strpos('0123456789ABCDEF', substr(x, 2 * k + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(x, 2 * k + 2, 1)) - 1) as b from hexed)
    , coded as (select * exclude (x, b, t), xor(list_reduce(b, lambda a, y: xor(a >> 8, t[1 + (xor(a, y) & 255)]), 4294967295::bigint), 4294967295) as crc from bytes, tab)"""


@query("f03_episode_seed", f"{crc32_sql('customer', chr(39) + '42:train:' + chr(39) + ' || c_nationkey || ' + chr(39) + ':' + chr(39) + ' || c_custkey')} select c_custkey as segment_id, crc as seed from coded")
def _(spark, sf):
    s = px.segment(spark, sf)
    return s.select("segment_id", cu.episode_seed(42, "train", F.col("town"), F.col("segment_id")).alias("seed"))


def uniform_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13))::bigint / {float(1 << 52)!r}"


def _mixture_sql(i: int, scale: float) -> str:
    draw, knee = uniform_sql("'conditioning:42'", "c_custkey", str(i)), f"(1.0e0 / (1.0e0 + {scale}e0))"
    return f"case when {uniform_sql(chr(39) + 'conditioning:42' + chr(39), 'c_custkey', str(100 + i))} < 0.5e0 then {draw} * {knee} else {knee} + {draw} * (1.0e0 - {knee}) end"


@query("f04_segment_conditioning", f"""with d as (select c_custkey as segment_id, unnest([{', '.join([uniform_sql("'conditioning:42'", 'c_custkey', str(i)) for i in range(10)] + [_mixture_sql(i, s) for i, s in ((10, 1.25), (11, 1.25), (12, 1.5))])}]) as v, unnest(range(13)) as dim from customer)
    select segment_id, cast(dim as bigint) as dim, {r('v', 'value')} from d""")
def _(spark, sf):
    wide = cu.segment_conditioning(px.segment(spark, sf).select("segment_id"))
    return rounded(wide.select("segment_id", F.posexplode("conditioning").alias("dim", "value")).withColumn("dim", F.col("dim").cast("long")), "value")


@query("f10_first_per_group", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events) where rn = 1")
def _(spark, sf):
    e = px.table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return cu.first_per_group(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("f13_latest", "select event_id, user_id from events order by ts desc, event_id desc limit 1")
def _(spark, sf):
    return cu.latest(px.table(spark, sf, "events").select("ts", "event_id", "user_id"), "ts").select("event_id", "user_id")


# ---------------------------------------------------------------- set and integrity checks

OPEN = "select l_orderkey as k from lineitem where l_linestatus = 'O'"
FILLED = "select l_orderkey as k from lineitem where l_linestatus = 'F'"


def open_filled(spark, sf):
    li = px.table(spark, sf, "lineitem")
    return tuple(li.filter(F.col("l_linestatus") == s).select(F.col("l_orderkey").alias("k")) for s in "OF")


@query("g01_union_batches", f"select k, count(*) as n from ({OPEN} union all {FILLED}) group by k")
def _(spark, sf):
    return cu.union_batches(*open_filled(spark, sf)).groupBy("k").agg(F.count("*").alias("n"))


@query("g02_same_keys", f"select k, 'left' as only_in from ({OPEN} except {FILLED}) union all select k, 'right' from ({FILLED} except {OPEN})")
def _(spark, sf):
    return cu.same_keys(*open_filled(spark, sf), ["k"])


@query("g03_missing_keys", "select c_custkey from customer where c_custkey not in (select user_id from events)")
def _(spark, sf):
    return cu.missing_keys(px.table(spark, sf, "customer"), px.table(spark, sf, "events").withColumnRenamed("user_id", "c_custkey"), ["c_custkey"])


@query("g04_duplicates", "select l_orderkey, l_partkey, count(*) as copies from lineitem group by 1, 2 having count(*) > 1")
def _(spark, sf):
    return cu.duplicates(px.table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


@query("g05_overlap", f"{OPEN} intersect {FILLED}")
def _(spark, sf):
    return cu.overlap(*open_filled(spark, sf), ["k"])


@query("g06_coverage", "select count(distinct o_custkey) as covered, count(distinct o_custkey) >= 1000 as complete from orders")
def _(spark, sf):
    return cu.coverage(px.table(spark, sf, "orders"), "o_custkey", 1000)


@query("g08_require_ids", "select distinct l_partkey from lineitem where l_partkey not in (select case when p_size <= 45 then p_partkey else -p_partkey end from part)")
def _(spark, sf):
    have = px.table(spark, sf, "part").select(F.when(F.col("p_size") <= 45, F.col("p_partkey")).otherwise(-F.col("p_partkey")).alias("l_partkey"))
    return cu.missing_keys(px.table(spark, sf, "lineitem"), have, ["l_partkey"])


@query("g07_verify_dataset", """with p as (select case when vec_id % 101 = 7 then label + 1000 else label end as label, vec_id, case when vec_id % 97 = 3 then 'x' else label || '__' || vec_id end as file, case when vec_id % 89 = 5 then 1 else 2 end as schema_version from embeddings)
    , f as (select label, vec_id, label || '__' || vec_id as file, case when vec_id % 83 = 11 then 'other' else label || '__' || vec_id end as processed_file, len(embedding) as dim, case when vec_id % 79 = 2 then 'bbb' else 'aaa' end as source_sha from embeddings)
    select rule, cast(label as varchar) as label, cast(vec_id as varchar) as vec_id from (
      select 'pairing: unknown reference' as rule, label, vec_id from f where not exists (select 1 from p where p.label = f.label and p.vec_id = f.vec_id)
      union all select 'pairing: unpaired', label, vec_id from p where not exists (select 1 from f where p.label = f.label and p.vec_id = f.vec_id)
      union all select 'file name differs from identity', label, vec_id from p where file <> label || '__' || vec_id
      union all select 'schema version', label, vec_id from p where schema_version <> 2
      union all select 'feature source differs', label, vec_id from f where processed_file <> file
      union all select 'vector length', label, vec_id from f where dim <> 64
      union all select 'mixed source hash', label, vec_id from f where source_sha <> 'aaa')""")
def _(spark, sf):
    e = px.table(spark, sf, "embeddings")
    name = F.concat_ws("__", F.col("label").cast("string"), F.col("vec_id").cast("string"))
    i = F.col("vec_id")
    # Injected violations, so that every rule has something to find.
    p = e.select(F.when(i % 101 == 7, F.col("label") + 1000).otherwise(F.col("label")).alias("label"), "vec_id", F.when(i % 97 == 3, "x").otherwise(name).alias("file"), F.when(i % 89 == 5, 1).otherwise(2).alias("schema_version"))
    f = e.select("label", "vec_id", name.alias("file"), F.when(i % 83 == 11, "other").otherwise(name).alias("processed_file"), F.col("embedding").alias("vec"), F.when(i % 79 == 2, "bbb").otherwise("aaa").alias("source_sha"))
    return cu.verify_dataset(p, f, ["label", "vec_id"], 64, 2)


# ---------------------------------------------------------------- distributions

AGENT_DIM = "select 1 + p_size % 3 as object_type, 3.5e0 + p_size / 20.0e0 as length, 1.5e0 + (p_retailprice - 900.0e0) / 2500.0e0 + p_size / 100.0e0 as width, p_size / 10.0e0 + (p_partkey % 7) / 10.0e0 as height from part"


def agent_dim(spark, sf):
    p = px.table(spark, sf, "part")
    return p.select("p_partkey", (F.lit(1) + F.col("p_size") % 3).alias("object_type"), (F.lit(3.5) + F.col("p_size") / 20.0).alias("length"),
                    (F.lit(1.5) + (F.col("p_retailprice") - 900.0) / 2500.0 + F.col("p_size") / 100.0).alias("width"), (F.col("p_size") / 10.0 + (F.col("p_partkey") % 7) / 10.0).alias("height"))


DIST = f"""with a as ({AGENT_DIM}), g as (select * from a where length > 0.1e0 and width > 0.1e0 and height > 0.1e0)
, d as (select object_type, count(*) as n, count(*) / (select count(*) from g) as prob, avg(length) as mean_length, avg(width) as mean_width, avg(height) as mean_height, stddev_pop(length) as std_length,
   stddev_pop(width) as std_width, stddev_pop(height) as std_height, corr(length, width) as corr_lw, corr(length, height) as corr_lh from g group by object_type)"""
DIST_COLS = ["prob", "mean_length", "mean_width", "mean_height", "std_length", "std_width", "std_height", "corr_lw", "corr_lh"]


@query("d16_agent_distribution", f"{DIST} select object_type, n, {', '.join(r(c, c) for c in DIST_COLS)} from d")
def _(spark, sf):
    return rounded(cu.agent_distribution(agent_dim(spark, sf)), *DIST_COLS)


@query("d17_drift_audit", f"""{DIST.replace("with a as", "with a as").replace(", g as", ", h as (select * replace (case when height > 1.0e0 then object_type else 1 + object_type % 3 end as object_type, case when height > 1.0e0 then length else length + 0.5e0 end as length) from a where length > 0.1e0 and width > 0.1e0 and height > 0.1e0), g as")}
    , o as (select object_type, count(*) as n, count(*) / (select count(*) from h) as prob, avg(length) as ml, avg(width) as mw, avg(height) as mh, corr(length, width) as lw, corr(length, height) as lh from h group by object_type)
    select object_type, o.n, abs(o.prob - d.prob) <= 4 * sqrt(d.prob * (1 - d.prob) / (select count(*) from h)) as frequency_ok, abs(ml - mean_length) <= 4 * std_length / sqrt(o.n) as length_ok,
      abs(mw - mean_width) <= 4 * std_width / sqrt(o.n) as width_ok, abs(mh - mean_height) <= 4 * std_height / sqrt(o.n) as height_ok,
      abs(atanh(lw) - atanh(corr_lw)) / sqrt(1.0e0 / (o.n - 3) + 1.0e0 / (d.n - 3)) < 4 as corr_lw_ok, abs(atanh(lh) - atanh(corr_lh)) / sqrt(1.0e0 / (o.n - 3) + 1.0e0 / (d.n - 3)) < 4 as corr_lh_ok
    from d join o using (object_type)""")
def _(spark, sf):
    a = agent_dim(spark, sf)
    # The observed side has its low vehicles under another type and half a metre longer.
    low = F.col("height") <= 1.0
    seen = a.withColumns({"object_type": F.when(low, 1 + F.col("object_type") % 3).otherwise(F.col("object_type")), "length": F.when(low, F.col("length") + 0.5).otherwise(F.col("length"))})
    ref, obs = cu.agent_distribution(a), cu.agent_distribution(seen)
    return cu.drift_audit(obs, ref)


@query("d19_conditioning_audit", f"""with c as (select value / 600.0e0 as c0, cast(regexp_extract(props, '[0-9]+', 0) as double) / 99.0e0 as c1, case when event_type = 'click' then 1.0e0 else 0.0e0 end as flag from events)
    select count(*) filter (c0 < -1e-3 or c0 > 1 + 1e-3 or c1 < -1e-3 or c1 > 1 + 1e-3) as out_of_range, {r('avg(c1)', 'mean_c1')}, count(*) as n, count(*) filter (flag not in (0.0e0, 1.0e0)) as bad_flag,
     count(distinct round(c0, 6)) as distinct_values, abs(avg(c1) - 0.5e0) <= 0.05e0 as uniform_ok, count(distinct round(c0, 6)) >= count(*) * 0.9e0 as distinct_ok from c""")
def _(spark, sf):
    e = px.table(spark, sf, "events")
    c = e.select((F.col("value") / 600.0).alias("c0"), (F.regexp_extract("props", "[0-9]+", 0).cast("double") / 99.0).alias("c1"), F.when(F.col("event_type") == "click", 1.0).otherwise(0.0).alias("flag"))
    return rounded(cu.conditioning_audit(c, ["c1"], ["c0"], "flag", "c0"), "mean_c1")


@query("d28_episode_record", px.with_views(
    f"""select scenario_id, agent_id, count(*) as frames, {r('avg(abs(vx))', 'mean_speed')}, {r('avg(step % 5)', 'mean_agents')}, {r('max(abs(vy))', 'max_offroad')}, {r('arg_min(x, step)', 'start_x')}, {r('arg_min(y, step)', 'start_y')}
    from log group by scenario_id, agent_id""", "log"))
def _(spark, sf):
    f = px.log(spark, sf).withColumns({"speed": F.abs("vx"), "num_agents": F.col("step") % 5, "lane_start_distance": F.abs("vy")})
    return rounded(cu.episode_record(f, DRIVE, "step"), "mean_speed", "mean_agents", "max_offroad", "start_x", "start_y")


@query("d29_traffic_health", px.with_views(
    f"select map_id, {r('avg(case when abs(vy) > 1.5e0 then 1.0e0 else 0.0e0 end)', 'offroad_share')}, {r('quantile_cont(vx, 0.5)', 'median_speed')} from log group by map_id", "log"))
def _(spark, sf):
    f = px.log(spark, sf).withColumns({"lane_distance": F.abs("vy"), "speed": F.col("vx")})
    return rounded(cu.traffic_health(f, ["map_id"], 1.5, ID), "offroad_share", "median_speed")


@query("d18_route_audit", px.with_views(
    f""", h as (select map_id, sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) * (1 + 19 * (seg_idx % 2)) as length from road_segment)
    select map_id, {r('avg(case when length < 4.1e0 then 1.0e0 else 0.0e0 end)', 'short_share')}, {r('avg(case when length > 80.0e0 then 1.0e0 else 0.0e0 end)', 'long_share')},
      {r('quantile_cont(length, 0.01)', 'p1')}, {r('quantile_cont(length, 0.5)', 'p50')}, {r('quantile_cont(length, 0.99)', 'p99')} from h group by map_id""", "road_segment"))
def _(spark, sf):
    s = segments(spark, sf)
    hop = F.sqrt(F.pow(F.col("x1") - F.col("x0"), F.lit(2)) + F.pow(F.col("y1") - F.col("y0"), F.lit(2))) * (F.lit(1) + F.col("seg_idx") % 2 * 19)
    a = cu.route_audit(s.select("map_id", "polyline_id", "seg_idx", hop.alias("length")), ["map_id"], ["polyline_id", "seg_idx"], short=4.1)
    return rounded(a, "short_share", "long_share", "p1", "p50", "p99")


# ---------------------------------------------------------------- vectors

LONG = ", fl as (select segment_id, vec_id, unnest(target) as t, unnest(pred) as p, generate_subscripts(target, 1) - 1 as dim from feature)"


@query("d21_target_statistics", px.with_views(f"{LONG} select dim, {r('avg(t)', 'mean')}, {r('stddev_pop(t)', 'std')}, {r('var_pop(t)', 'variance')} from fl group by dim", "feature"))
def _(spark, sf):
    return rounded(ve.target_statistics(px.feature(spark, sf), "target"), "mean", "std", "variance")


ALIGN = LONG + ", al as (select vec_id, sum((p - t) * (p - t)) as squared_sum, sum((p - t) * (p - t)) / count(*) as mse, sum(p * t) / (sqrt(sum(p * p)) * sqrt(sum(t * t))) as cosine from fl group by vec_id)"


@query("d22_feature_alignment", px.with_views(f"{ALIGN} select vec_id, {r('squared_sum', 'squared_sum')}, {r('mse', 'mse')}, {r('cosine', 'cosine')} from al", "feature"))
def _(spark, sf):
    return rounded(ve.feature_alignment(px.feature(spark, sf)).select("vec_id", "squared_sum", "mse", "cosine"), "squared_sum", "mse", "cosine")


@query("d22_epoch_alignment", px.with_views(f"{ALIGN} select {r('avg(squared_sum)', 'feature_loss')}, {r('avg(mse)', 'mse')}, {r('avg(cosine)', 'cosine')}, {r('sqrt(avg(mse))', 'rmse')}, {r('1 - avg(mse) / 0.02e0', 'r2')} from al", "feature"))
def _(spark, sf):
    return rounded(ve.epoch_alignment(ve.feature_alignment(px.feature(spark, sf)), 0.02), "feature_loss", "mse", "cosine", "rmse", "r2")


@query("d23_within_segment_r2", px.with_views(
    f"""{LONG}, c as (select segment_id, dim, t - avg(t) over (partition by segment_id, dim) as ct, p - avg(p) over (partition by segment_id, dim) as cp, count(*) over (partition by segment_id, dim) as n from fl)
    select {r('1 - sum((cp - ct) * (cp - ct)) / sum(ct * ct)', 'r2')}, {r('sum(ct * ct) / count(*)', 'residual_variance')} from c where n >= 2""", "feature"))
def _(spark, sf):
    return rounded(ve.within_segment_r2(px.feature(spark, sf), "segment_id"), "r2", "residual_variance")


@query("d24_policy_agreement", px.with_views(
    f"""{LONG}, z as (select vec_id, dim, p / 0.5e0 as s, t / 0.5e0 as t, ln(sum(exp(p / 0.5e0)) over (partition by vec_id)) as ls, ln(sum(exp(t / 0.5e0)) over (partition by vec_id)) as lt from fl)
    select vec_id, {r('sum(exp(t - lt) * ((t - lt) - (s - ls))) * 0.25e0', 'kl')}, arg_max(dim, (s, -dim)) = arg_max(dim, (t, -dim)) as matches from z group by vec_id""", "feature"))
def _(spark, sf):
    a = ve.policy_agreement(px.feature(spark, sf), 0.5, "pred", "target")
    return rounded(a.select("vec_id", "kl", "matches"), "kl")


