"""Queries: ingest operators, rollouts, episodes, experiments, lane graph, sequential operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlake.functions.scaling import REWARD_TERMS
from trajlake.operators import curation as cu
from trajlake.operators import episodes as ep
from trajlake.operators import experiments as ex
from trajlake.operators import lanes as ln
from trajlake.operators import likelihood as lk
from trajlake.operators import roads as rd
from trajlake.operators import rollouts as ro
from trajlake.operators import sequential as sq
from trajlake.operators import kinematics as kin
from trajlake.operators.ordered import with_index
from trajlake.plans import proxies as px
from trajlake.plans.q_core import ID, IDS, KIN, SPEED, VALID, edge_bin_sql, segments, speed_sides
from trajlake.plans.q_data import AGENT_DIM, DRIVE, TRACE_SQL, trace, uniform_sql
from trajlake.plans.q_spatial import lanes
from trajlake.plans.registry import query, r, r6, rounded
from trajlake.sources import files as fs
from trajlake.sources import scenario as sn
from trajlake.streaming import stateful as st

# ---------------------------------------------------------------- A: ingest


@query("a03_normalize_tracks", px.with_views(
    f""", g as (select * from (select distinct scenario_id, agent_id from log) cross join (select unnest(range(40)) as step))
    select g.scenario_id, g.agent_id, g.step, {r('coalesce(x, 0)', 'x')}, {r('coalesce(y, 0)', 'y')}, coalesce(valid, false) as valid from g left join log using (scenario_id, agent_id, step)""", "log"))
def _(spark, sf):
    n = sn.normalize_tracks(px.log(spark, sf).select(*ID, "x", "y", "valid"), DRIVE, px.TRACK)
    return rounded(n, "x", "y")


@query("a04_type_codes", """select p_partkey, case p_type when 'ECONOMY' then 1 when 'STANDARD' then 2 when 'PROMO' then 3 else 0 end as object_type,
    case when p_brand = 'Brand#1' then 4 when p_brand = 'Brand#2' then 6 when p_size % 22 between 0 and 3 then 4 when p_size % 22 between 5 and 13 then 5 when p_size % 22 between 14 and 16 then 6
      when p_size % 22 = 17 then 7 when p_size % 22 = 18 then 8 when p_size % 22 = 19 then 9 when p_size % 22 = 20 then 10 else p_size % 22 end as road_type from part""")
def _(spark, sf):
    p = px.table(spark, sf, "part")
    kind = F.when(F.col("p_type") == "ECONOMY", "vehicle").when(F.col("p_type") == "STANDARD", "pedestrian").when(F.col("p_type") == "PROMO", "cyclist").otherwise("other")
    word = F.when(F.col("p_brand") == "Brand#1", "lane").when(F.col("p_brand") == "Brand#2", "road_edge").otherwise("x")
    return p.select("p_partkey", sn.map_object_type(kind).alias("object_type"), sn.map_road_type(F.col("p_size") % 22, word).alias("road_type"))


@query("a05_validate_scenarios", """with i as (select *, (row_number() over (partition by o_custkey order by o_orderkey) - 1) // 16 as part from orders)
    , d as (select o_custkey, part, count(*) as n, count(*) filter (o_orderstatus = 'P') as no_pos, count(*) filter (o_orderpriority like '5%') as no_y, count(*) filter (o_orderstatus = 'F') as f from i group by o_custkey, part)
    select case when f > 0 and no_pos = 0 and no_y < 3 then 'valid' else 'invalid' end as status, count(*) as documents, cast(sum(n) as bigint) as objects from d group by 1""")
def _(spark, sf):
    # A document holds up to 16 orders of a customer as objects (status P lacks a position); 5-priority ones break road points.
    scan = px.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    o = with_index(scan, ["o_custkey"], ["o_orderkey"], "i", bucket=F.expr(f"o_orderkey div {px.KEYS_PER_BUCKET}")).withColumn("part", F.expr("i div 16"))
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    doc = o.groupBy("o_custkey", "part").agg(
        F.collect_list(F.struct(F.lit("vehicle").alias("type"), F.when(F.col("o_orderstatus") != "P", F.array(zero)).alias("position"))).alias("objects"),
        F.count_if(F.col("o_orderpriority").startswith("5")).alias("_no_y"), F.count_if(F.col("o_orderstatus") == "F").alias("_f"),
    )
    point = F.struct(F.lit(0.0).alias("x"), F.when(F.col("_no_y") < 3, 0.0).alias("y"))
    doc = doc.select("o_custkey", F.when(F.col("_f") > 0, F.lit("n")).alias("name"), "objects", F.array(F.struct(F.array(point).alias("geometry"))).alias("roads"), F.lit("{}").alias("tl_states"))
    ok, bad = sn.validate_scenarios(doc)
    both = ok.withColumn("status", F.lit("valid")).unionByName(bad.withColumn("status", F.lit("invalid")))
    return both.groupBy("status").agg(F.count("*").alias("documents"), F.sum(F.size("objects")).alias("objects"))


@query("a08_strip_objects", px.with_views(
    f""", a as (select scenario_id, count(*) as objects_removed, cast(sum(n * 36 + 44) as bigint) as ob from (select scenario_id, agent_id, count(*) as n from log group by 1, 2) group by 1)
    , b as (select map_id, count(*) as rk, cast(sum(n * 12 + 44) as bigint) as rb from (select map_id, polyline_id, count(*) as n from road_point group by 1, 2) group by 1)
    , m as (select distinct scenario_id, map_id from log)
    select scenario_id, objects_removed, coalesce(rk, 0) as roads_kept, coalesce(rb, 0) + ob as bytes_before, coalesce(rb, 0) as bytes_after, {r('coalesce(rb, 0) / (coalesce(rb, 0) + ob)', 'ratio')}
    from a join m using (scenario_id) left join b using (map_id)""", "log", "road_point"))
def _(spark, sf):
    log = px.log(spark, sf)
    agent = log.groupBy("scenario_id", "agent_id").agg((F.count("*") * 36 + 44).alias("bytes"))
    per_road = px.road_point(spark, sf).groupBy("map_id", "polyline_id").agg((F.count("*") * 12 + 44).alias("bytes"))
    road = log.select("scenario_id", "map_id").distinct().join(per_road, "map_id")
    scenario = log.select("scenario_id").distinct()
    _, _, audit = sn.strip_objects(scenario, agent, road)
    return rounded(audit.select("scenario_id", "objects_removed", "roads_kept", "bytes_before", "bytes_after", "ratio"), "ratio")


@query("a11_explode_rollouts", px.with_views(f"select scenario_id, agent_id, rollout, row_number() over (partition by scenario_id, agent_id, rollout order by step) - 1 as step, {r('x', 'x')}, {r('y', 'y')} from sim", "sim"))
def _(spark, sf):
    # Nested arrays as an import delivers them: agents, then rollouts, then steps (both bounded).
    sim = px.sim(spark, sf)
    per = sim.groupBy("scenario_id", "agent_id", "rollout").agg(F.array_sort(F.collect_list(F.struct("step", "x", "y"))).alias("s"))
    nested = per.groupBy("scenario_id", "agent_id").agg(F.array_sort(F.collect_list(F.struct("rollout", F.col("s.x").alias("x"), F.col("s.y").alias("y")))).alias("n"))
    return rounded(fs.explode_rollouts(nested.select("scenario_id", "agent_id", F.col("n.x").alias("x"), F.col("n.y").alias("y")), ["x", "y"]), "x", "y")


@query("a14_replace_roads", "with t as (select n_name as town, count(*) as roads from supplier join nation on s_nationkey = n_nationkey group by n_name) select c_custkey, roads from customer join nation on c_nationkey = n_nationkey join t on lower(n_name) = lower(town)")
def _(spark, sf):
    c, n, s = (px.table(spark, sf, t) for t in ("customer", "nation", "supplier"))
    named = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws("_", F.regexp_replace("n_name", "_", "-"), F.col("c_custkey").cast("string")).alias("name"))
    masters = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.regexp_replace("n_name", "_", "-").alias("town")).agg(F.count("*").alias("roads"))
    return sn.replace_roads(named, masters).select("c_custkey", "roads")


@query("a15_experts_and_initial_velocity", px.with_views(
    f"""select {IDS}, agent_id <> min(agent_id) over (partition by scenario_id) as mark_as_expert, {r('case when step = 0 and agent_id = min(agent_id) over (partition by scenario_id) then 0 else vx end', 'vx')},
     {r('case when step = 0 and agent_id = min(agent_id) over (partition by scenario_id) then 0 else vy end', 'vy')} from log""", "log"))
def _(spark, sf):
    log = px.log(spark, sf)
    marked = sn.mark_experts(log.select("scenario_id", F.col("agent_id").alias("agent_idx")).distinct())
    state = log.join(marked.withColumnRenamed("agent_idx", "agent_id"), ["scenario_id", "agent_id"])
    return rounded(sn.zero_initial_velocity(state).select(*ID, "mark_as_expert", "vx", "vy"), "vx", "vy")


@query("a16_flatten_metrics", f"""with f as (select event_id, value, cast(regexp_extract(props, '[0-9]+', 0) as double) as k from events)
    select event_id, 'train/loss' as key, {r('value', 'value')} from f union all select event_id, 'train/detail/k', k from f union all select event_id, 'validation/k2', {r('k * 2')} from f""")
def _(spark, sf):
    k = F.regexp_extract("props", "[0-9]+", 0).cast("double")
    nested = px.table(spark, sf, "events").select(
        "event_id", F.struct(F.col("value").alias("loss"), F.struct(k.alias("k"), F.col("event_type").alias("note")).alias("detail")).alias("train"), F.struct((k * 2).alias("k2")).alias("validation"))
    flat = fs.flatten_metrics(nested).withColumn("event_id", F.col("event_id").cast("long"))
    return rounded(fs.long_metrics(flat, ["event_id"]), "value")


@query("c23_mark_eval_agents", px.with_views("""select distinct scenario_id, agent_id, agent_id % 10 in (scenario_id % 10, (scenario_id + 3) % 10) as is_track_to_predict from log""", "log"))
def _(spark, sf):
    log = px.log(spark, sf)
    agent = log.select("scenario_id", "agent_id", (F.col("agent_id") % 10).alias("agent_idx")).distinct()
    sid = F.col("scenario_id")
    scenario = log.select("scenario_id").distinct().select("scenario_id", F.array(sid % 10, (sid + 3) % 10).alias("tracks_to_predict"))
    return sn.mark_eval_agents(agent, scenario).select("scenario_id", "agent_id", "is_track_to_predict")


@query("e15_select_agents", px.with_views(
    """, a as (select scenario_id, agent_id, agent_id % 10 as idx, object_type, valid, x, agent_id % 4 = 1 as expert from log where step = 0)
    , b as (select *, idx = 2 as sdc, object_type in (1, 2, 3) and not expert and sqrt(power(12.0e0 - x, 2) + power(20.0e0 - y, 2)) >= 2.0e0 as elig from a join (select scenario_id, agent_id, y from log where step = 0) using (scenario_id, agent_id))
    , c as (select *, sum(case when sdc or elig then 1 else 0 end) over w as rk, row_number() over w as n from b where sdc or valid window w as (partition by scenario_id order by case when sdc then 0 else 1 end, idx))
    , d as (select *, (sdc or elig) and (sdc or rk <= 4) as act from c where n <= 8)
    , e as (select *, sum(case when act then 1 else 0 end) over (partition by scenario_id order by case when sdc then 0 else 1 end, idx) >= 4 as full_ from d)
    select scenario_id, agent_id, case when act then 'active' when expert or full_ then 'expert_static' else 'static' end as role from e""", "log"))
def _(spark, sf):
    log = px.log(spark, sf).withColumn("agent_idx", F.col("agent_id") % 10)
    agent = log.filter("step = 0").select("scenario_id", "agent_id", "agent_idx", "object_type", F.lit(12.0).alias("goal_x"), F.lit(20.0).alias("goal_y"), (F.col("agent_id") % 4 == 1).alias("mark_as_expert"))
    scenario = log.select("scenario_id").distinct().withColumn("sdc_track_index", F.lit(2))
    roles = sn.select_agents(agent, log, scenario, max_agents=8, control_limit=4)
    return agent.join(roles, ["scenario_id", "agent_idx"]).select("scenario_id", "agent_id", "role")


# ---------------------------------------------------------------- E13, E14, F8, D33, D34

TR = ["segment", "t"]


@query("e13_clipped_advantage", px.with_views(
    f""", n as (select *, coalesce(least(ratio, 1.0e0) * (lead(reward) over w + 0.98e0 * lead(value) over w * (1 - lead(terminal) over w) - value), 0) as d,
        coalesce(0.98e0 * 0.95e0 * least(ratio, 1.0e0) * (1 - lead(terminal) over w), 0) as k from transition window w as (partition by segment order by t))
    , recursive_adv as (select segment, t, list_reduce([0.0e0] || list_reverse(tail), lambda a, b: 0.0e0) as z, tail from (select segment, t, list(d) over (partition by segment order by t rows between current row and unbounded following) as tail from n))
    , pr as (select a.segment, a.t, b.t as u, b.d, exp(sum(ln(nullif(c.k, 0)))) as f, count(*) filter (c.k = 0) as zeros from n a join n b on a.segment = b.segment and b.t >= a.t
        left join n c on c.segment = a.segment and c.t >= a.t and c.t < b.t group by a.segment, a.t, b.t, b.d)
    select segment, t, {r('sum(case when zeros > 0 then 0.0e0 else coalesce(f, 1.0e0) * d end)', 'advantage')} from pr group by segment, t""", "transition").replace(
        """    , recursive_adv as (select segment, t, list_reduce([0.0e0] || list_reverse(tail), lambda a, b: 0.0e0) as z, tail from (select segment, t, list(d) over (partition by segment order by t rows between current row and unbounded following) as tail from n))
""", ""))
def _(spark, sf):
    return ro.clipped_advantage(px.transition(spark, sf)).select(*TR, r6("advantage").alias("advantage"))


@query("e14_bootstrap_and_clip", px.with_views(
    f""", b as (select segment, t, terminal, truncation, reward + case when truncation > 0 and terminal = 0 then coalesce(lag(value) over (partition by segment order by t), 0) * 0.98e0 else 0.0e0 end as reward from transition)
    select segment, t, {r('least(greatest(reward, -1.0e0), 1.0e0)', 'reward')}, least(terminal + truncation, 1.0e0) as done from b""", "transition"))
def _(spark, sf):
    return rounded(ro.clip_reward(ro.bootstrap_truncation(px.transition(spark, sf))).select(*TR, "reward", "done"), "reward")


ADVANTAGES = """
, n as (select *, coalesce(least(ratio, 1.0e0) * (lead(reward) over w + 0.98e0 * lead(value) over w * (1 - lead(terminal) over w) - value), 0) as d,
    coalesce(0.98e0 * 0.95e0 * least(ratio, 1.0e0) * (1 - lead(terminal) over w), 0) as k from transition window w as (partition by segment order by t))
, pr as (select a.segment, a.t, b.t as u, b.d, exp(sum(ln(nullif(c.k, 0)))) as f, count(*) filter (c.k = 0) as zeros from n a join n b on a.segment = b.segment and b.t >= a.t
    left join n c on c.segment = a.segment and c.t >= a.t and c.t < b.t group by a.segment, a.t, b.t, b.d)
, adv as (select segment, t, sum(case when zeros > 0 then 0.0e0 else coalesce(f, 1.0e0) * d end) as advantage from pr group by segment, t)"""


@query("f08_prioritized_sample", px.with_views(
    f"""{ADVANTAGES}, per as (select segment, power(sum(abs(advantage)), 0.8e0) + 1e-6 as p from adv group by segment)
    , q as (select segment, p / (select sum(p) from per) as probability, (select count(*) from per) as n from per)
    select segment, {r('probability', 'probability')}, {r('power(n * probability, -0.2e0)', 'importance')} from q order by -ln({uniform_sql('segment', '0')} + 1e-18) / probability limit 64""", "transition"))
def _(spark, sf):
    return rounded(ro.prioritized_sample(ro.clipped_advantage(px.transition(spark, sf)), 64), "probability", "importance")


def returned(spark, sf):
    return px.transition(spark, sf).withColumns({"returns": F.col("reward") + F.col("value"), "advantage": F.col("reward") - F.col("value")})


@query("d33_ppo_diagnostics", px.with_views(
    f"""select {r('avg(logprob - new_logprob)', 'old_approx_kl')}, {r('avg(exp(new_logprob - logprob) - 1 - (new_logprob - logprob))', 'approx_kl')},
      {r('avg(case when abs(exp(new_logprob - logprob) - 1) > 0.2e0 then 1.0e0 else 0.0e0 end)', 'clipfrac')}, {r('avg(exp(new_logprob - logprob))', 'importance')}, cast(0 as bigint) as nonfinite,
      {r('1 - var_samp(reward) / var_samp(reward + value)', 'explained_variance')} from transition""", "transition"))
def _(spark, sf):
    d = ro.ppo_diagnostics(returned(spark, sf))
    return rounded(d, "old_approx_kl", "approx_kl", "clipfrac", "importance", "explained_variance")


@query("d34_ppo_losses", px.with_views(
    f""", s as (select avg(reward - value) as m, stddev_samp(reward - value) as sd from transition)
    , x as (select (reward - value - m) / (sd + 1e-8) as a, exp(new_logprob - logprob) as q, reward + value as ret, value, new_value from transition, s)
    select {r('avg(greatest(-a * q, -a * least(greatest(q, 0.8e0), 1.2e0)))', 'policy_loss')},
      {r('0.5e0 * avg(greatest(power(new_value - ret, 2), power(value + least(greatest(new_value - value, -0.2e0), 0.2e0) - ret, 2)))', 'value_loss')} from x""", "transition"))
def _(spark, sf):
    return rounded(ro.ppo_losses(returned(spark, sf)), "policy_loss", "value_loss")


# ---------------------------------------------------------------- D11-D15, D25-D27, D32, F9, I2, I6

EPISODE = """with e as (select user_id // 10 as env_id, user_id as agent, 1 + event_id % 3 as sampled, case when event_type in ('click', 'purchase') then 1 + event_id % 3 when event_type = 'view' then event_id % 3 else 0 end as reached,
    event_type = 'error' as collided, event_type = 'error' and event_id % 2 = 0 as cbg, event_type = 'signup' and event_id % 5 = 0 as offroad from events)
, s as (select *, reached / sampled as share, case when sampled > 1 then (sampled - 1) / sampled else 1.0e0 end as need from e)
, o as (select *, case when share >= need and not collided then 1.0e0 else 0.0e0 end as score, case when not offroad and not collided and share < 1 then 1.0e0 else 0.0e0 end as dnf from s)"""
METRIC_SQL = f"""count(*) as n, {r('avg(score)', 'score')}, {r('avg(dnf)', 'dnf_rate')}, {r('avg(case when offroad then 1.0e0 else 0.0e0 end)', 'offroad_rate')}, {r('avg(case when collided then 1.0e0 else 0.0e0 end)', 'collision_rate')},
   {r('avg(reached)', 'goals_reached')}, {r('avg(sampled)', 'goals_sampled')}, {r('sum(reached) / sum(sampled)', 'completion_rate')}"""
METRIC_COLS = ["score", "dnf_rate", "offroad_rate", "collision_rate", "goals_reached", "goals_sampled", "completion_rate"]


def episode_agents(spark, sf):
    e = px.table(spark, sf, "events")
    kind, i = F.col("event_type"), F.col("event_id")
    rows = e.select(
        "event_id", F.expr("user_id div 10").alias("env_id"), F.col("user_id").alias("agent"), (F.lit(1) + i % 3).alias("goals_sampled"),
        F.when(kind.isin("click", "purchase"), F.lit(1) + i % 3).when(kind == "view", i % 3).otherwise(0).alias("goals_reached"),
        (kind == "error").alias("collided"), ((kind == "error") & (i % 2 == 0)).alias("collided_before_goal"), ((kind == "signup") & (i % 5 == 0)).alias("offroad"))
    return ep.episode_agents(rows)


@query("d11_episode_agents", f"{EPISODE} select env_id, agent, cast(sum(score) as double) as score, cast(sum(dnf) as double) as dnf from o group by env_id, agent")
def _(spark, sf):
    return episode_agents(spark, sf).groupBy("env_id", "agent").agg(F.sum("score").alias("score"), F.sum("dnf").alias("dnf"))


@query("d12_fleet_metrics", f"{EPISODE} select {METRIC_SQL} from o")
def _(spark, sf):
    return rounded(ep.fleet_metrics(episode_agents(spark, sf)), *METRIC_COLS)


@query("d13_env_metrics", f"{EPISODE} select env_id, {METRIC_SQL} from o group by env_id")
def _(spark, sf):
    return rounded(ep.env_metrics(episode_agents(spark, sf)), *METRIC_COLS)


@query("f09_select_unit", f"{EPISODE}, g as (select env_id, avg(score) as score, avg(case when collided then 1.0e0 else 0.0e0 end) as c from o group by env_id) select 'first' as mode, min(env_id) as env_id from g union all select 'worst_score', arg_min(env_id, (score, env_id)) from g union all select 'worst_collision', arg_min(env_id, (-c, env_id)) from g")
def _(spark, sf):
    env = ep.env_metrics(episode_agents(spark, sf))
    picks = [ep.select_unit(env, m).select(F.lit(m).alias("mode"), "env_id") for m in ("first", "worst_score", "worst_collision")]
    return cu.union_batches(*picks)


@query("d14_step_outcomes", px.with_views(
    f"""{TRACE_SQL} select scenario_id, agent_id, bool_or(collision_state = 1) as collided, count(*) filter (collision_state = 1) as collision_steps, bool_or(collision_state = 2) as offroad,
      count(*) filter (collision_state = 2) as offroad_steps, bool_or(goal_distance < 25 and speed <= 12) as reached_goal, {r('arg_min(speed, step) filter (goal_distance < 25 and speed <= 12)', 'speed_at_goal')} from trace group by scenario_id, agent_id""", "log"))
def _(spark, sf):
    return rounded(ep.step_outcomes(trace(px.log(spark, sf)), DRIVE, 25.0, 12.0), "speed_at_goal")


@query("d15_lane_alignment", px.with_views(
    f"""{TRACE_SQL}, a as (select *, case when lane_valid then 1.0e0 else 0.0e0 end as l from trace)
    select scenario_id, agent_id, arg_max(l, step) as last_rate, {r('avg(l)', 'mean_rate')}, {r('avg(case when collision_state = 0 then l end)', 'live_rate')} from a group by scenario_id, agent_id""", "log"))
def _(spark, sf):
    t = trace(px.log(spark, sf))
    return rounded(ep.lane_alignment(t, DRIVE, live=F.col("collision_state") == 0), "mean_rate", "live_rate")


@query("d25_reward_attribution", px.with_views(
    f"""{TRACE_SQL}, s as (select scenario_id, agent_id, count(*) as n, {', '.join(f'sum({t}) as {t}, count(*) filter ({t} <> 0) as h_{t}' for t in REWARD_TERMS)}, {' + '.join(f'abs(sum({t}))' for t in REWARD_TERMS)} as gross from trace group by 1, 2)
    {' union all '.join(f"select scenario_id, agent_id, '{t}' as term, {r(t, 'total')}, {r(f'{t} / n', 'per_step')}, {r(f'abs({t}) / case when gross = 0 then 1 else gross end', 'share')}, h_{t} as steps_hit from s" for t in REWARD_TERMS)}""", "log"))
def _(spark, sf):
    a = ep.reward_attribution(trace(px.log(spark, sf)), DRIVE, REWARD_TERMS)
    return rounded(a, "total", "per_step", "share")


@query("d25_attribution_residual", px.with_views(
    f"""{TRACE_SQL} select scenario_id, agent_id, {r(f"max(abs({' + '.join(REWARD_TERMS)} + 0.001e0 * step - ({' + '.join(REWARD_TERMS)})))", 'residual')} from trace group by scenario_id, agent_id""", "log"))
def _(spark, sf):
    t = trace(px.log(spark, sf))
    total = sum((F.col(c) for c in REWARD_TERMS[1:]), F.col(REWARD_TERMS[0]))
    return rounded(ep.attribution_residual(t.withColumn("reward", total + F.col("step") * 0.001), DRIVE, REWARD_TERMS), "residual")


@query("d26_trace_summary", px.with_views(
    f"""{TRACE_SQL} select scenario_id, agent_id, {r('avg(case when collision_state = 2 then 1.0e0 else 0.0e0 end)', 'offroad_share')}, {r('avg(case when collision_state = 1 then 1.0e0 else 0.0e0 end)', 'collision_share')},
      {r('avg(case when lane_valid then 1.0e0 else 0.0e0 end)', 'on_lane_share')}, {r('avg(speed)', 'mean_speed')}, {r('max(speed)', 'max_speed')}, {r('arg_min(goal_distance, step)', 'first_goal_distance')}, {r('arg_max(goal_distance, step)', 'last_goal_distance')} from trace group by scenario_id, agent_id""", "log"))
def _(spark, sf):
    cols = ["offroad_share", "collision_share", "on_lane_share", "mean_speed", "max_speed", "first_goal_distance", "last_goal_distance"]
    return rounded(ep.trace_summary(trace(px.log(spark, sf)), DRIVE), *cols)


@query("d27_eval_summary", f"""with p as (select l_orderkey, avg(l_quantity) as q, avg(case when l_returnflag <> 'N' then l_discount end) as d from lineitem group by 1)
    select count(*) as episodes, {r("avg(case when o_orderstatus = 'F' then 1.0e0 else 0.0e0 end)", 'success_rate')}, {r('avg(q)', 'mean_quantity')}, {r('avg(d)', 'mean_discount')},
      any_value(k.reason) as reason, any_value(k.n) as n from orders left join p on o_orderkey = l_orderkey cross join (select o_orderpriority as reason, count(*) as n from orders group by 1) k group by k.reason""")
def _(spark, sf):
    step = px.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("episode"), F.col("l_quantity").alias("quantity"), F.when(F.col("l_returnflag") != "N", F.col("l_discount")).alias("discount"))
    episode = px.table(spark, sf, "orders").select(F.col("o_orderkey").alias("episode"), (F.col("o_orderstatus") == "F").alias("success"), F.col("o_orderpriority").alias("termination"))
    s = ep.eval_summary(step, episode, "episode", ["quantity", "discount"])
    s = s.select("episodes", "success_rate", "mean_quantity", "mean_discount", F.explode("terminations").alias("reason", "n"))
    return rounded(s, "success_rate", "mean_quantity", "mean_discount")


@query("d32_info_means", f"""select event_type as key, 'flat' as kind, {r('avg(value)', 'mean')} from events group by 1 union all
    select key, 'nested', {r('avg(v)')} from (select event_type as key, user_id, avg(value) as v from events group by 1, 2) group by 1""")
def _(spark, sf):
    e = px.table(spark, sf, "events").select(F.col("event_type").alias("key"), "user_id", "value")
    both = ep.info_means(e).withColumn("kind", F.lit("flat")).unionByName(ep.info_means(e, ["user_id"]).withColumn("kind", F.lit("nested")))
    return rounded(both, "mean")


@query("i02_episodes", f"""with e as (select user_id, ts, event_id, value, event_type in ('error', 'signup') as done from events)
    , n as (select *, coalesce(sum(case when done then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as episode from e)
    select user_id, cast(episode as bigint) as episode, {r('sum(value)', 'episode_return')}, count(*) as episode_length from n group by user_id, episode having bool_or(done)""")
def _(spark, sf):
    scan = px.table(spark, sf, "events")
    steps = scan.select("user_id", "ts", "event_id", F.col("value").alias("reward"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("terminal"), F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("truncation"))
    return rounded(ep.episodes_from_steps(steps, ["user_id"], ["ts", "event_id"], bucket=F.date_trunc("DAY", "ts")), "episode_return")


@query("i06_nonfinite_runs", """with m as (select event_type as run, ts, event_id, value > 40.0e0 as bad from events), g as (select *, sum(case when bad then 0 else 1 end) over (partition by run order by ts, event_id) as good from m)
    , r as (select run, good, count(*) as len from g where bad group by run, good), e as (select run, max(good) as e from g group by run)
    select run, coalesce(cast(sum(len) as bigint), 0) as nonfinite_updates, coalesce(max(len), 0) as longest_run, coalesce(max(case when good = e then len end), 0) as current_run from e left join r using (run) group by run""")
def _(spark, sf):
    scan = px.table(spark, sf, "events")
    u = scan.select(F.col("event_type").alias("run"), "ts", "event_id", F.when(F.col("value") > 40.0, float("nan")).otherwise(F.col("value")).alias("loss"))
    return ep.nonfinite_runs(u, ["run"], ["ts", "event_id"], "loss", bucket=F.date_trunc("DAY", "ts"))


# ---------------------------------------------------------------- D35-D37, E16, E17, F5-F7


@query("d35_last_n_summary", px.with_views(f"select run, {r('avg(metric)', 'mean')}, {r('stddev_samp(metric)', 'std')}, count(*) as n from (select *, row_number() over (partition by run order by epoch desc) as rn from metric_log) where rn <= 300 group by run", "metric_log"))
def _(spark, sf):
    return rounded(ex.last_n_summary(px.metric_log(spark, sf), ["run"], "metric"), "mean", "std")


@query("d36_block_means", px.with_views(
    f""", b as (select run, (rn - 1) // 100 as block, avg(metric) as mean, count(*) as n from (select *, row_number() over (partition by run order by epoch desc) as rn from metric_log) where rn <= 600 group by 1, 2)
    , s as (select run, min(mean) as low, max(mean) as high from b group by run)
    select s.run, {r('s.low', 'low')}, {r('s.high', 'high')}, s.low <= q.high and q.low <= s.high as overlaps from s, (select * from s where run = 'click') q""", "metric_log"))
def _(spark, sf):
    b = ex.block_means(px.metric_log(spark, sf), ["run"], "metric")
    return rounded(ex.ranges_overlap(b, "run", "click"), "low", "high")


@query("d37_compare_runs", px.with_views(
    f"select a.run, epoch, {r('a.metric - b.metric', 'delta')}, {r('a.metric / nullif(b.metric, 0)', 'ratio')} from metric_log a join metric_log b using (epoch) where a.run <> 'click' and b.run = 'click'", "metric_log"))
def _(spark, sf):
    return rounded(ex.compare_runs(px.metric_log(spark, sf), "click", "metric").select("run", "epoch", "delta", "ratio"), "delta", "ratio")


@query("d37_compare_runs_per_100_steps", px.with_views(
    f""", c as (select run, epoch, floor(metric) as hits, 50 + epoch % 100 as steps from metric_log)
    select a.run, epoch, {r('100.0e0 * a.hits / a.steps - 100.0e0 * b.hits / b.steps', 'delta')}, {r('(100.0e0 * a.hits / a.steps) / nullif(100.0e0 * b.hits / b.steps, 0)', 'ratio')}
    from c a join c b using (epoch) where a.run <> 'click' and b.run = 'click'""", "metric_log"))
def _(spark, sf):
    m = px.metric_log(spark, sf).select("run", "epoch", F.floor("metric").alias("hits"), (F.lit(50) + F.col("epoch") % 100).alias("steps"))
    return rounded(ex.compare_runs(m, "click", "hits", steps="steps").select("run", "epoch", "delta", "ratio"), "delta", "ratio")


@query("e16_downsample", px.with_views(
    f""", n as (select *, count(*) over (partition by run) as n, row_number() over (partition by run order by epoch desc) - 1 as back from metric_log)
    , b as (select run, case when back = 0 then 50 else 49 - (back - 1) // ((n - 1) // 50) end as bucket, metric from n)
    select run, bucket, {r('avg(metric)', 'value')} from b where bucket >= 0 group by run, bucket""", "metric_log"))
def _(spark, sf):
    return rounded(ex.downsample(px.metric_log(spark, sf), ["run"], "metric", 50), "value")


@query("e17_dedupe_reprints", """with m as (select user_id, ts, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as p from events)
    , k as (select user_id, count(*) as rows, count(*) filter (p is null or p <> event_type) as kept from m group by user_id) select user_id, rows, kept, round(rows / kept, 6) + 0.0e0 as repeat_factor from k""")
def _(spark, sf):
    scan = px.table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    kept = ex.dedupe_reprints(scan, ["user_id"], ["ts", "event_id"], ["event_type"])
    return rounded(ex.repeat_factor(scan, kept, ["user_id"]), "repeat_factor")


@query("f05_pareto_front", px.with_views(
    "select run, score, cost from run_obs i where not exists (select 1 from run_obs j where j.run <> i.run and j.score + 1e-6 > i.score and j.cost - 1e-6 < i.cost)", "run_obs"))
def _(spark, sf):
    return ex.pareto_front(px.run_obs(spark, sf))


@query("f06_pareto_gap", px.with_views(
    f""", f as (select run, score, cost from run_obs i where not exists (select 1 from run_obs j where j.run <> i.run and j.score + 1e-6 > i.score and j.cost - 1e-6 < i.cost))
    , g as (select *, least(coalesce(cost - lag(cost) over (order by cost), 1e300), coalesce(lead(cost) over (order by cost) - cost, 1e300)) as gap from f)
    select run, cost, gap from g order by gap desc, cost limit 1""", "run_obs"))
def _(spark, sf):
    return ex.pareto_gap(ex.pareto_front(px.run_obs(spark, sf))).select("run", "cost", "gap")


@query("f07_upsert_runs", """with p as (select o_orderkey, o_custkey % 50 as k, (o_custkey % 50) + (o_orderkey % 4) * 6.0e-7 as a, round(o_totalprice / 100000.0e0, 0) as b from orders)
    select o_orderkey, k, b from p where not exists (select 1 from p q where q.k = p.k and q.b = p.b and q.o_orderkey > p.o_orderkey and sqrt((q.a - p.a) ** 2 + (q.b - p.b) ** 2) < 1e-6)""")
def _(spark, sf):
    # Steps of 0.6e-6 put points on both sides of cell borders, some of them near a neighbour but not near its neighbour.
    k = F.col("o_custkey") % 50
    o = px.table(spark, sf, "orders").select("o_orderkey", k.alias("k"), (k + (F.col("o_orderkey") % 4) * F.lit(6.0e-7)).alias("a"), F.round(F.col("o_totalprice") / 100000.0, 0).alias("b"))
    return ex.upsert_runs(o, ["a", "b"], "o_orderkey").select("o_orderkey", "k", "b")


@query("d35_deduped_tail", px.with_views(
    f""", g as (select run, epoch, floor(metric / 4.0e0) as metric, row_number() over (partition by run order by epoch) as i from metric_log)
    , d as (select a.run, a.epoch, a.metric from g a left join g p on p.run = a.run and p.i = a.i - 1 where p.metric is null or p.metric <> a.metric)
    , q as (select *, row_number() over (partition by run order by epoch desc) - 1 as back from d), b as (select run, back // 20 as block, avg(metric) as mean, count(*) as n from q where back < 120 group by 1, 2)
    select run, cast(block as bigint) as block, {r('mean', 'mean')}, n from b""", "metric_log"))
def _(spark, sf):
    # Reprints taken out leave gaps in the epochs; the last blocks are counted in rows that are left.
    log = px.metric_log(spark, sf).withColumn("metric", F.floor(F.col("metric") / 4.0).cast("double"))
    return rounded(ex.block_means(ex.dedupe_reprints(log, ["run"], ["epoch"], ["metric"]), ["run"], "metric", n=20, k=6), "mean")


# ---------------------------------------------------------------- D10, E18

SENS = f"""{KIN.format(src='(select *, -1 as rollout from log)').replace('kin', 'lkin')}{KIN.format(src='sim')}{VALID}
, ns as (select unnest([0, 1, 2, 4]) as n)
, lb as (select scenario_id, agent_id, step, {edge_bin_sql('speed', SPEED)} as b from lkin)
, sb as (select n, scenario_id, agent_id, step, rollout, {edge_bin_sql('speed', SPEED)} as sbin from kin cross join ns)
, mix as (select sb.n, scenario_id, agent_id, case when rollout < sb.n then lb.b else sbin end as b from sb join lb using (scenario_id, agent_id, step))
, c as (select n, scenario_id, agent_id, b, count(*) as c from mix where b is not null group by 1, 2, 3, 4), t as (select n, scenario_id, agent_id, sum(c) as total from c group by 1, 2, 3)
, am as (select n, scenario_id, agent_id, avg(case when speed_valid and lb.b is not null then ln((coalesce(c, 0) + 0.1e0) / (coalesce(total, 0) + 1.0e0)) end) as ll
   from ns cross join lb join mask using (scenario_id, agent_id, step) left join c using (n, scenario_id, agent_id, b) left join t using (n, scenario_id, agent_id) group by 1, 2, 3)"""


@query("d10_sensitivity", px.with_views(f"{SENS} select cast(n as bigint) as n, {r('avg(ll)', 'mean_loglik')} from am group by n", "sim"))
def _(spark, sf):
    from trajlake.plans.sensitivity import sensitivity

    log_k, sim_k, _ = speed_sides(spark, sf)
    return rounded(sensitivity(sim_k, kin.kinematic_validity(log_k), [SPEED], [0, 1, 2, 4]).withColumnRenamed(f"ll_{SPEED.name}", "mean_loglik"), "mean_loglik")


def normal_sql(tag: int) -> str:
    u, v = (uniform_sql("scenario_id", "agent_id", "rollout", "step", "0", str(tag + i)) for i in (0, 1))
    return f"sqrt(-2 * ln(1.0e0 - {u})) * cos({v} * (2 * pi()))"


@query("e18_random_baseline", px.with_views(
    f""", b as (select *, unnest(range(32)) as rollout from log)
    , d as (select *, case when step > 0 then {normal_sql(0)} * 0.1e0 + 1.0e0 else 0.0e0 end as dx, case when step > 0 then {normal_sql(10)} * 0.1e0 else 0.0e0 end as dy,
        case when step > 0 then {normal_sql(20)} * 0.1e0 else 0.0e0 end as dh from b)
    , h as (select *, first_value(heading) over w + sum(dh) over w as turned from d window w as (partition by scenario_id, agent_id, rollout order by step rows between unbounded preceding and current row))
    , m as (select *, coalesce(lag(turned) over (partition by scenario_id, agent_id, rollout order by step), turned) as was from h)
    , s as (select *, first_value(x) over w + sum(dx * cos(was) - dy * sin(was)) over w as sx, first_value(y) over w + sum(dx * sin(was) + dy * cos(was)) over w as sy
        from m window w as (partition by scenario_id, agent_id, rollout order by step rows between unbounded preceding and current row))
    select {IDS}, rollout, {r('sx', 'x')}, {r('sy', 'y')}, {r('turned', 'heading')} from s""", "log"))
def _(spark, sf):
    return rounded(sq.random_baseline(px.log(spark, sf), 32).select(*ID, "rollout", "x", "y", "heading"), "x", "y", "heading")


# ---------------------------------------------------------------- C15, C17, C22, C24, C26, F11, I3, I4


def lane_points(spark, sf):
    return px.road_point(spark, sf).filter(F.col("road_type") == rd.LANE)


def lane_relation(spark, sf):
    return ln.lane_table(lane_points(spark, sf).withColumnRenamed("polyline_id", "lane_id"), ["map_id", "lane_id"])


@query("c15_lane_successors", px.with_views(
    """, p as (select *, lead(x) over w as nx, lead(y) over w as ny, lag(x) over w as px, lag(y) over w as py from road_point where road_type = 4 window w as (partition by polyline_id order by pt_idx))
    , l as (select map_id, polyline_id as lane_id, arg_min((x, y, nx, ny), pt_idx) as s, arg_max((x, y, px, py), pt_idx) as e, count(*) as n from p group by 1, 2)
    , q as (select map_id, lane_id, s[1] as sx, s[2] as sy, s[3] - s[1] as stx, s[4] - s[2] as sty, e[1] as ex, e[2] as ey, e[1] - e[3] as etx, e[2] - e[4] as ety from l where n >= 2)
    , j as (select a.map_id, a.lane_id, b.lane_id as successor, row_number() over (partition by a.map_id, a.lane_id order by b.lane_id) as rn from q a join q b on a.map_id = b.map_id and a.lane_id <> b.lane_id
        and power(b.sx - a.ex, 2) + power(b.sy - a.ey, 2) <= 0.25e0 and (a.etx * b.stx + a.ety * b.sty) / (sqrt(a.etx * a.etx + a.ety * a.ety) * sqrt(b.stx * b.stx + b.sty * b.sty)) >= 0.2588e0)
    select map_id, lane_id, successor from j where rn <= 8""", "road_point"))
def _(spark, sf):
    return ln.lane_successors(lane_relation(spark, sf), ["map_id"])


@query("c17_sample_goal", px.with_views(
    f""", c as (select {IDS}, polyline_id, pt_idx, p.x as gx, p.y as gy, abs(sqrt(power(p.x - l.x, 2) + power(p.y - l.y, 2)) - 30.0e0) as err from log l join (select * from road_point where road_type = 4) p using (map_id)
        where (p.x - l.x) * cos(heading) + (p.y - l.y) * sin(heading) > 0)
    , b as (select *, row_number() over (partition by {IDS} order by err, polyline_id, pt_idx) as rn from c)
    select {IDS}, {r('gx', 'goal_x')}, {r('gy', 'goal_y')} from log left join (select * from b where rn = 1) using ({IDS})""", "log", "road_point"))
def _(spark, sf):
    g = ln.sample_goal(px.log(spark, sf), lane_points(spark, sf), ["map_id"], ID)
    return rounded(g.select(*ID, "goal_x", "goal_y"), "goal_x", "goal_y")


@query("c22_link_audit", """with k as (select o_custkey as road_id, o_orderkey % 1500 as linked_id, case when o_orderstatus = 'F' then 'predecessor' else 'successor' end as kind from orders)
    select road_id, linked_id from k where kind = 'predecessor' and not exists (select 1 from k b where b.road_id = k.linked_id and b.linked_id = k.road_id)""")
def _(spark, sf):
    link = px.table(spark, sf, "orders").select(F.col("o_custkey").alias("road_id"), (F.col("o_orderkey") % 1500).alias("linked_id"), F.when(F.col("o_orderstatus") == "F", "predecessor").otherwise("successor").alias("kind"))
    return ln.link_audit(link)


@query("c24_sample_agents", f"""with a as (select * from ({AGENT_DIM.replace("from part", ", p_partkey from part")}) where length > 0.1e0 and width > 0.1e0 and height > 0.1e0)
    , rows as (select *, row_number() over (partition by object_type order by p_partkey) - 1 as row_idx from a)
    , k as (select object_type, count(*) as n, count(*) / (select count(*) from a) as prob from a group by object_type)
    , c as (select object_type, n, prob, sum(prob) over (order by object_type) as hi from k)
    , d as (select i as draw, {uniform_sql('i', '0')} * (select max(hi) from c) as u, {uniform_sql('i', '1')} as v from range((select count(*) from a)) t(i))
    , p as (select d.draw, c.object_type, cast(floor(d.v * c.n) as bigint) as row_idx from d join c on d.u >= c.hi - c.prob and d.u < c.hi)
    select object_type, row_idx, draw, p_partkey, {r('length', 'length')}, {r('width', 'width')}, {r('height', 'height')} from p join rows using (object_type, row_idx)""")
def _(spark, sf):
    from trajlake.plans.q_data import agent_dim

    dim = agent_dim(spark, sf).filter("length > 0.1 and width > 0.1 and height > 0.1")
    rows = with_index(dim, ["object_type"], ["p_partkey"], "row_idx", bucket=F.expr(f"p_partkey div {px.KEYS_PER_BUCKET}"))
    types = cu.agent_distribution(dim).select("object_type", "prob", F.col("n").alias("count"))
    return rounded(ln.sample_agents(dim.count(), types, rows), "length", "width", "height")


LANES = """
, p as (select *, lead(x) over w as nx, lead(y) over w as ny, lag(x) over w as px, lag(y) over w as py from road_point where road_type = 4 window w as (partition by polyline_id order by pt_idx))
, leg as (select map_id, polyline_id as lane_id, pt_idx, x, y, coalesce(sqrt(power(x - px, 2) + power(y - py, 2)), 0) as d, px, py from p)
, arcs as (select *, sum(d) over (partition by map_id, lane_id order by pt_idx) as arc from leg)
, lens as (select map_id, lane_id, max(arc) as length, count(*) as n from arcs group by map_id, lane_id having max(arc) >= 1 and count(*) >= 2)
, l as (select map_id, polyline_id as lane_id, arg_min((x, y, nx, ny), pt_idx) as s, arg_max((x, y, px, py), pt_idx) as e, count(*) as n from p group by 1, 2)
, q as (select l.map_id, l.lane_id, s[1] as sx, s[2] as sy, s[3] - s[1] as stx, s[4] - s[2] as sty, e[1] as ex, e[2] as ey, e[1] - e[3] as etx, e[2] - e[4] as ety from l join lens using (map_id, lane_id))
, j as (select a.map_id, a.lane_id, b.lane_id as successor, row_number() over (partition by a.map_id, a.lane_id order by b.lane_id) as rn from q a join q b on a.map_id = b.map_id and a.lane_id <> b.lane_id
    and power(b.sx - a.ex, 2) + power(b.sy - a.ey, 2) <= 0.25e0 and (a.etx * b.stx + a.ety * b.sty) / (sqrt(a.etx * a.etx + a.ety * a.ety) * sqrt(b.stx * b.stx + b.sty * b.sty)) >= 0.2588e0)
, ways as (select *, rn - 1 as k, count(*) over (partition by map_id, lane_id) as ways from j where rn <= 8)"""


@query("c26_lane_walk", px.with_views(
    f"""{LANES}
    , walk(map_id, walker, lane_id, s, travelled, rest, hop) as (
      select map_id, lane_id, lane_id, 0.0e0, 0.0e0, 150.0e0, 0 from lens
      union all
      select w.map_id, w.walker, coalesce(y.successor, w.lane_id), case when y.successor is null then w.s + least(w.rest, n.length - w.s) else 0.0e0 end,
        w.travelled + least(w.rest, n.length - w.s), case when y.successor is not null then w.rest - (n.length - w.s) end, w.hop + 1
      from walk w join lens n on n.map_id = w.map_id and n.lane_id = w.lane_id
      left join ways y on y.map_id = w.map_id and y.lane_id = w.lane_id and w.rest > n.length - w.s and w.hop < 64 and y.k = cast(floor({uniform_sql('w.walker', '0', 'w.hop')} * y.ways) as bigint)
      where w.rest is not null)
    , stand as (select * from walk where rest is null)
    , piece as (select map_id, lane_id, lag(arc) over v as a, arc as b, px as x0, py as y0, x as x1, y as y1, arc = max(arc) over (partition by map_id, lane_id) as at_end from arcs window v as (partition by map_id, lane_id order by pt_idx))
    select t.map_id, t.walker, t.lane_id, {r('t.s', 's')}, {r('t.travelled', 'travelled')}, {r('x0 + (s - a) / (b - a) * (x1 - x0)', 'x')}, {r('y0 + (s - a) / (b - a) * (y1 - y0)', 'y')}, {r('atan2(y1 - y0, x1 - x0)', 'heading')}
    from stand t left join piece p on p.map_id = t.map_id and p.lane_id = t.lane_id and b > a and s >= a and (s < b or (at_end and s <= b))""".replace("walk(map_id", "walk(map_id"), "road_point").replace("with road_point", "with recursive road_point"))
def _(spark, sf):
    pts = lane_points(spark, sf).withColumnRenamed("polyline_id", "lane_id")
    lane = ln.lane_table(pts, ["map_id", "lane_id"])
    edges = ln.lane_successors(lane, ["map_id"])
    start = lane.select("map_id", "lane_id", F.col("lane_id").alias("walker"), F.lit(0.0).alias("s"))
    ended = ln.lane_walk(start, lane, edges, 150.0, ["map_id"], ["walker"])
    return rounded(ln.pose_at(ended, ln.lane_points(pts, ["map_id", "lane_id"]), ["map_id", "lane_id"]), "s", "travelled", "x", "y", "heading")


@query("f11_sample_lane_points", px.with_views(
    f"""{LANES}, axis as (select *, sum(length) over (order by map_id, lane_id) as hi from lens)
    , d as (select i as draw, {uniform_sql('i', '0')} * (select max(hi) from axis) as p from range((select count(*) from lens)) t(i))
    select draw, map_id, lane_id, {r('p - (hi - length)', 's')} from d join axis on p >= hi - length and p < hi""", "road_point"))
def _(spark, sf):
    lane = lane_relation(spark, sf).select("map_id", "lane_id", "length")
    return rounded(ln.sample_lane_points(lane, lane.count(), ["map_id", "lane_id"]), "s")


@query("i03_dedupe_displacement", """with recursive s as (select cast(c_nationkey as bigint) as town, c_custkey as segment_id, c_acctbal as start_x, c_acctbal / 50.0e0 as x from customer)
    , nxt as (select a.town, a.segment_id, min(b.segment_id) as nid from s a join s b on a.town = b.town and b.segment_id > a.segment_id and abs(b.x - a.x) >= 25.0e0 group by a.town, a.segment_id)
    , chain as (select town, min(segment_id) as segment_id from s group by town union all select c.town, n.nid from chain c join nxt n on n.town = c.town and n.segment_id = c.segment_id)
    select s.town, s.segment_id, s.start_x from s join chain using (town, segment_id)""")
def _(spark, sf):
    s = px.segment(spark, sf).withColumns({"x": F.col("start_x") / 50.0, "y": F.lit(0.0)})
    return sq.dedupe_displacement(s, ["town"], ["segment_id"], 25.0).select("town", "segment_id", "start_x")


ROUTE = """
, pose as (select scenario_id, agent_id, step as t, x + 0.5e0 as x, y from log)
, pt as (select scenario_id, agent_id, row_number() over w - 1 as i, x, y, step % 10 = 9 or step = max(step) over (partition by scenario_id, agent_id) as goal,
    sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) as leg from log window w as (partition by scenario_id, agent_id order by step))
, arcs as (select *, coalesce(sum(leg) over (partition by scenario_id, agent_id order by i), 0) as arc, count(*) over (partition by scenario_id, agent_id) as m from pt)
, d as (select p.scenario_id, p.agent_id, p.t, a.i, sqrt(power(p.x - a.x, 2) + power(p.y - a.y, 2)) as d from pose p join arcs a using (scenario_id, agent_id) where m > 1)
, f(scenario_id, agent_id, t, idx, deviation) as (
    select scenario_id, agent_id, -1::bigint, 0::bigint, 0.0e0 from (select distinct scenario_id, agent_id from d)
    union all
    select d.scenario_id, d.agent_id, d.t, greatest(any_value(f.idx), (min(struct_pack(d := d.d, i := d.i))).i), min(d.d)
    from f join d on d.scenario_id = f.scenario_id and d.agent_id = f.agent_id and d.t = f.t + 1 and d.i >= f.idx - 5 and d.i < f.idx + 250
    group by d.scenario_id, d.agent_id, d.t)
, place as (select f.scenario_id, f.agent_id, f.t, f.idx, f.deviation, a.arc as progress, p.x, p.y from f
    join arcs a on a.scenario_id = f.scenario_id and a.agent_id = f.agent_id and a.i = f.idx join pose p on p.scenario_id = f.scenario_id and p.agent_id = f.agent_id and p.t = f.t)
, goals as (select scenario_id, agent_id, arc, x, y, row_number() over (partition by scenario_id, agent_id order by i) - 1 as g, count(*) over (partition by scenario_id, agent_id) as n from arcs where goal)
, open as (select place.scenario_id, place.agent_id, place.t, g.g from place join goals g using (scenario_id, agent_id)
    where g.g = n - 1 or (place.progress < g.arc - 5.0e0 and sqrt(power(place.x - g.x, 2) + power(place.y - g.y, 2)) > 5.0e0))
, cur(scenario_id, agent_id, t, c) as (
    select distinct scenario_id, agent_id, -1::bigint, 0::bigint from open
    union all
    select o.scenario_id, o.agent_id, o.t, min(o.g) from cur join open o on o.scenario_id = cur.scenario_id and o.agent_id = cur.agent_id and o.t = cur.t + 1 and o.g >= cur.c
    group by o.scenario_id, o.agent_id, o.t)
, whole as (select scenario_id, agent_id, max(arc) as total from arcs group by scenario_id, agent_id)"""


@query("i04_track_route", px.with_views(
    f"""{ROUTE} select log.scenario_id, log.agent_id, log.step, place.idx as route_index, {r('place.progress', 'progress')}, {r('place.deviation', 'deviation')}, cur.c as goal_cursor,
    {r('case when total > 0 then least(greatest(place.progress / total, 0), 1) when place.t is not null then 0.0e0 end', 'completion')}
    from log left join place on place.scenario_id = log.scenario_id and place.agent_id = log.agent_id and place.t = log.step
    left join cur on cur.scenario_id = log.scenario_id and cur.agent_id = log.agent_id and cur.t = log.step
    left join whole on whole.scenario_id = place.scenario_id and whole.agent_id = place.agent_id""", "log").replace("with log", "with recursive log"))
def _(spark, sf):
    log = px.log(spark, sf)
    route = log.select(*DRIVE, F.col("step").alias("pt_idx"), "x", "y", (F.col("step") % 10 == 9).alias("is_goal"))
    out = sq.track_route(log.select(*ID, (F.col("x") + 0.5).alias("x"), "y"), route, DRIVE, "step")
    return rounded(out, "progress", "deviation", "completion")


@query("i01_gated_batches", f"""with recursive e as (select event_type, strftime(ts, '%Y-%m-%d') as day, value from events)
    , per as (select event_type, day, count(*) as n, sum(value) as s from e group by 1, 2)
    , c as (select event_type, day, sum(n) over w as cn, sum(s) over w as cs, row_number() over w as i from per window w as (partition by event_type order by day))
    , g as (select distinct event_type, 0::bigint as i, 0::hugeint as cn, 0.0e0 as cs, cast(null as varchar) as day, 0::hugeint as n, 0.0e0 as mean from c
      union all
      select c.event_type, min(c.i), arg_min(c.cn, c.i), arg_min(c.cs, c.i), arg_min(c.day, c.i), arg_min(c.cn - g.cn, c.i), arg_min((c.cs - g.cs) / (c.cn - g.cn), c.i)
      from g join c on c.event_type = g.event_type and c.i > g.i and c.cn - g.cn >= 40 group by c.event_type)
    select event_type, day, cast(n as bigint) as n, {r('mean', 'value')} from g where i > 0""")
def _(spark, sf):
    e = px.table(spark, sf, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    return rounded(sq.gated_batches(e, ["event_type"], "day", ["value"], 40), "value")


@query("i05_latest_values", f"select event_type, user_id, {r('arg_max(value, event_id)', 'value')}, max(event_id) as event_id from events group by event_type, user_id")
def _(spark, sf):
    e = px.table(spark, sf, "events").select("event_type", "user_id", "event_id", "value")
    return rounded(st.latest_values(e, ["event_type", "user_id"], "event_id", "value"), "value")
