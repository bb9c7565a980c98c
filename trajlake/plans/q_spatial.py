"""Queries: agent-to-agent and road operators, and the whole realism evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.functions import geometry as g
from trajlake.operators import grid
from trajlake.operators import interaction as ia
from trajlake.operators import kinematics as kin
from trajlake.operators import likelihood as lk
from trajlake.operators import roads as rd
from trajlake.operators import scoring as sc
from trajlake.plans import proxies as px
from trajlake.plans import realism as rl
from trajlake.plans.q_core import CORNERS_SQL, ID, IDS, KIN, VALID, box_distance_sql, edge_bin_sql, segments
from trajlake.plans.registry import query, r, r6, rounded
from trajlake.session import cut_lineage
from trajlake.sources.simplify import simplify_roads

RID = ["scenario_id", "agent_id", "rollout", "step"]
RIDS = "scenario_id, agent_id, rollout, step"

# Log and simulation in one relation, rollout -1 being the log.
STATES = f"""{VALID}
, states as (
  select scenario_id, map_id, agent_id, -1 as rollout, step, x, y, heading, length, width, object_type, valid, valid as log_valid, speed_valid, acceleration_valid from mask
  union all
  select s.scenario_id, s.map_id, s.agent_id, s.rollout, s.step, s.x, s.y, s.heading, s.length, s.width, s.object_type, true, m.valid, m.speed_valid, m.acceleration_valid
  from sim s join mask m using (scenario_id, agent_id, step))"""

PAIRS = """
, bp as (select a.scenario_id, a.rollout, a.step, a.agent_id, b.agent_id as other_id, a.length, a.width, b.length as n_length, b.width as n_width,
   cos(a.heading) as ac, sin(a.heading) as asn, cos(b.heading) as bc, sin(b.heading) as bs, b.x - a.x as dx, b.y - a.y as dy
   from {src} a join {src} b on a.scenario_id = b.scenario_id and a.rollout = b.rollout and a.step = b.step and a.agent_id <> b.agent_id
   where {valid})"""
PAIR_IDS = "scenario_id, rollout, step, agent_id, other_id"
NEAREST = box_distance_sql(PAIRS.format(src="states", valid="b.valid"), PAIR_IDS) + f"""
, nearest as (select scenario_id, rollout, step, agent_id, min(distance) as nearest_distance from dist group by scenario_id, rollout, step, agent_id)"""


def log_states(spark: SparkSession, sf: str) -> DataFrame:
    return px.log(spark, sf).withColumn("rollout", F.lit(-1).cast("long"))


def all_states(spark: SparkSession, sf: str) -> DataFrame:
    log = px.log(spark, sf)
    return rl.stack(px.sim(spark, sf, log), log, ["map_id"])


# ---------------------------------------------------------------- C4-C6, C10-C12, C19, D18

LOGPAIR = PAIRS.format(src="(select *, -1 as rollout from log)", valid="a.valid and b.valid")


@query("c04_pairwise_distances", px.with_views(
    f"""{box_distance_sql(LOGPAIR, PAIR_IDS)} select scenario_id, step, agent_id, other_id, {r('distance', 'distance')} from dist where distance <= 40.0e0""", "log"))
def _(spark, sf):
    d = ia.pairwise_distances(log_states(spark, sf))
    return d.select("scenario_id", "step", "agent_id", "other_id", r6("distance").alias("distance"))


@query("c05_nearest_object", px.with_views(
    f"{STATES}{NEAREST} select {RIDS}, {r('nearest_distance', 'nearest_distance')}, nearest_distance < 0 as collision from states left join nearest using ({RIDS})", "log", "sim"))
def _(spark, sf):
    # The search reads its input several times, so it starts from a materialised table.
    n = ia.nearest_object(cut_lineage(all_states(spark, sf)).repartition("scenario_id"))
    return n.select(*RID, r6("nearest_distance").alias("nearest_distance"), (F.col("nearest_distance") < 0).alias("collision"))


CROWD = box_distance_sql(PAIRS.format(src="crowd", valid="b.valid"), PAIR_IDS)


@query("c05_nearest_object_crowd", px.with_views(
    f"""{CROWD}, nearest as (select scenario_id, step, agent_id, min(distance) as nearest_distance from dist group by scenario_id, step, agent_id)
    select scenario_id, step, agent_id, {r('nearest_distance', 'nearest_distance')} from crowd left join nearest using (scenario_id, step, agent_id)""", "crowd"))
def _(spark, sf):
    n = ia.nearest_object(cut_lineage(px.crowd(spark, sf)), few=0)
    return n.select("scenario_id", "step", "agent_id", r6("nearest_distance").alias("nearest_distance"))


TTC = """
, tp as (select a.scenario_id, a.rollout, a.step, a.agent_id, b.agent_id as other_id, b.speed as other_speed, abs(b.heading - a.heading) as yaw,
    (b.x - a.x) * cos(a.heading) + (b.y - a.y) * sin(a.heading) as rx, (b.y - a.y) * cos(a.heading) - (b.x - a.x) * sin(a.heading) as ry,
    a.length, a.width, b.length / 2 as ol, b.width / 2 as ow
   from kin a join kin b on a.scenario_id = b.scenario_id and a.rollout = b.rollout and a.step = b.step and a.agent_id <> b.agent_id where b.valid)
, tq as (select *, rx - length / 2 - (ol * abs(cos(yaw)) + ow * abs(sin(yaw))) as long, abs(ry) - width / 2 - (ol * abs(sin(yaw)) + ow * abs(cos(yaw))) as lat from tp)
, tf as (select *, row_number() over (partition by scenario_id, rollout, step, agent_id order by long, other_id) as rn from tq
   where long > 0 and yaw <= 75.0e0 * pi() / 180.0e0 and lat < 0 and (lat < -0.5e0 or yaw <= 10.0e0 * pi() / 180.0e0))
, ttc as (select k.scenario_id, k.rollout, k.step, k.agent_id, coalesce(case when speed - other_speed > 0 then least(long / (speed - other_speed), 5.0e0) end, 5.0e0) as ttc
   from kin k left join tf on tf.rn = 1 and k.scenario_id = tf.scenario_id and k.rollout = tf.rollout and k.step = tf.step and k.agent_id = tf.agent_id)"""


@query("c06_time_to_collision", px.with_views(
    f"{STATES}{KIN.format(src='states')}{TTC} select {RIDS}, {r('ttc', 'ttc')} from ttc", "log", "sim"))
def _(spark, sf):
    # Dealt by scenario once, for the windows over tracks and over scenes.
    t = ia.time_to_collision(kin.kinematics(all_states(spark, sf).repartition("scenario_id")))
    return t.select(*RID, r6("ttc").alias("ttc"))


PARTNER = """
, hit as (select scenario_id, rollout, step, agent_id, min(other_id) as partner_id from bp
   where dx * dx + dy * dy <= 225.0e0 and greatest({gaps}) <= 0 group by scenario_id, rollout, step, agent_id)"""


def partner_sql() -> str:
    from trajlake.plans.q_core import gaps_sql

    pairs = PAIRS.format(src="(select *, -1 as rollout from log)", valid="a.valid and b.valid and a.object_type <> 2 and b.object_type <> 2")
    return pairs + PARTNER.format(gaps=gaps_sql("length / 2", "width / 2", "n_length / 2", "n_width / 2"))


@query("c10_collision_partner", px.with_views(f"{partner_sql()} select scenario_id, step, agent_id, partner_id from hit", "log"))
def _(spark, sf):
    c = ia.collision_partner(log_states(spark, sf)).filter("partner_id is not null")
    return c.select("scenario_id", "step", "agent_id", "partner_id")


@query("c10_collision_partner_by_turn", px.with_views(partner_sql().replace("min(other_id) as partner_id", "arg_min(other_id, (other_id * 7 % 10, other_id)) as partner_id") + " select scenario_id, step, agent_id, partner_id from hit", "log"))
def _(spark, sf):
    turn = log_states(spark, sf).withColumn("turn", F.col("agent_id") * 7 % 10)
    return ia.collision_partner(turn, order="turn").filter("partner_id is not null").select("scenario_id", "step", "agent_id", "partner_id")


@query("c11_remove_bad_tracks", px.with_views(
    f"""{partner_sql()}, role as (select distinct scenario_id, agent_id, case when agent_id % 4 = 0 then 'static' else 'active' end as role from log)
    , firsts as (select h.scenario_id, h.agent_id, arg_min(partner_id, step) as partner_id from hit h join role using (scenario_id, agent_id) where role = 'active' group by h.scenario_id, h.agent_id)
    select scenario_id, agent_id, role from role where not (role <> 'active' and exists (select 1 from firsts f where f.scenario_id = role.scenario_id and f.partner_id = role.agent_id))""", "log"))
def _(spark, sf):
    log = px.log(spark, sf)
    role = F.when(F.col("agent_id") % 4 == 0, "static").otherwise("active")
    agent = log.select("scenario_id", "agent_id", role.alias("role")).distinct()
    return ia.remove_bad_tracks(agent, log)


@query("c12_partner_features", px.with_views(
    f""", b as (select *, -1 as rollout, cos(heading) as hx, sin(heading) as hy,
        case when vx * cos(heading) + vy * sin(heading) < 0 then -sqrt(vx * vx + vy * vy) else sqrt(vx * vx + vy * vy) end as speed from log where valid)
    , p as (select a.scenario_id, a.step, a.agent_id, o.agent_id as partner_id, row_number() over (partition by a.scenario_id, a.step, a.agent_id order by (o.x - a.x) * (o.x - a.x) + (o.y - a.y) * (o.y - a.y), o.agent_id) as slot,
        ((o.x - a.x) * a.hx + (o.y - a.y) * a.hy) * 0.02e0 as rel_x, ((o.y - a.y) * a.hx - (o.x - a.x) * a.hy) * 0.02e0 as rel_y,
        o.width / 15.0e0 as width, o.length / 30.0e0 as length, o.hx * a.hx + o.hy * a.hy as cos_heading, o.hy * a.hx - o.hx * a.hy as sin_heading, o.speed / 100.0e0 as speed
        from b a join b o on a.scenario_id = o.scenario_id and a.step = o.step and a.agent_id <> o.agent_id
        where (o.x - a.x) * (o.x - a.x) + (o.y - a.y) * (o.y - a.y) <= 2500.0e0)
    select scenario_id, step, agent_id, slot, partner_id, {r('rel_x', 'rel_x')}, {r('rel_y', 'rel_y')}, {r('width', 'width')}, {r('length', 'length')},
      {r('cos_heading', 'cos_heading')}, {r('sin_heading', 'sin_heading')}, {r('speed', 'speed')} from p where slot <= 31""", "log"))
def _(spark, sf):
    p = ia.partner_features(log_states(spark, sf)).drop("rollout")
    return rounded(p, "rel_x", "rel_y", "width", "length", "cos_heading", "sin_heading", "speed")


@query("c19_crop_agents", px.with_views(
    f""", p as (select a.scenario_id, a.step, a.agent_id as ego_id, o.agent_id, o.x - a.x as dx, o.y - a.y as dy, a.heading as yaw, o.heading as h
       from log a join log o on a.scenario_id = o.scenario_id and a.step = o.step and a.agent_id <> o.agent_id)
    select scenario_id, step, ego_id, agent_id, {r('dx * cos(yaw) + dy * sin(yaw)', 'ego_x')}, {r('dy * cos(yaw) - dx * sin(yaw)', 'ego_y')},
      {r('cos(h - yaw)', 'cos_heading')}, {r('sin(h - yaw)', 'sin_heading')} from p where dx * dx + dy * dy <= 48400.0e0""", "log"))
def _(spark, sf):
    log = px.log(spark, sf)
    frame = log.select("scenario_id", "step", F.col("agent_id").alias("ego_id"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("heading").alias("yaw"))
    c = ia.crop_agents(frame, log, ["scenario_id", "step"])
    cols = ["ego_x", "ego_y", "cos_heading", "sin_heading"]
    return rounded(c.select("scenario_id", "step", "ego_id", "agent_id", *cols), *cols)


def placement_sql() -> str:
    from trajlake.plans.q_core import gaps_sql

    pairs = PAIRS.format(src="(select *, -1 as rollout from log)", valid="a.agent_id < b.agent_id")
    slack = "sqrt(dx * dx + dy * dy) - (sqrt(length * length + width * width) / 2 + sqrt(n_length * n_length + n_width * n_width) / 2)"
    return f"""{pairs}, s as (select *, {slack} as slack, greatest({gaps_sql('length / 2', 'width / 2', 'n_length / 2', 'n_width / 2')}) <= 0 as overlap from bp)
    select scenario_id, count(*) as circle_hits, count(*) filter (overlap) as overlaps, {r('min(slack)', 'worst_slack')} from s where slack < 0 group by scenario_id"""


@query("d18_placement_audit", px.with_views(placement_sql(), "log"))
def _(spark, sf):
    pairs = ia.placement_pairs(px.log(spark, sf), ["scenario_id", "step"])
    return pairs.groupBy("scenario_id").agg(
        F.count("*").alias("circle_hits"), F.count_if("overlap").alias("overlaps"), r6(F.min("slack")).alias("worst_slack"))


# ---------------------------------------------------------------- C7-C9, C13, C14, C18, C20, C21

def edge_sql(src: str, ids: str) -> str:
    """Nearest signed edge distance of every corner, then the maximum; follows the rule for segment ends."""
    cross = "(({0}) * ({3}) - ({1}) * ({2}))"
    own = cross.format("px - x0", "py - y0", "x1 - x0", "y1 - y0")
    prior = cross.format("px - xp", "py - yp", "x0 - xp", "y0 - yp")
    nxt = cross.format("px - x1", "py - y1", "x2 - x1", "y2 - y1")
    cvp = cross.format("x0 - xp", "y0 - yp", "x1 - x0", "y1 - y0")
    cvn = cross.format("x1 - x0", "y1 - y0", "x2 - x1", "y2 - y1")
    return f"""{CORNERS_SQL.format(src=src)}
, cs as (select {ids}, i, polyline_id, seg_idx, sign({own}) as n, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) as t,
    case when xp is null then sign({own}) when {cvp} > 0 then greatest(sign({own}), sign({prior})) else least(sign({own}), sign({prior})) end as np,
    case when x2 is null then sign({own}) when {cvn} > 0 then greatest(sign({own}), sign({nxt})) else least(sign({own}), sign({nxt})) end as nn,
    px - x0 as ax, py - y0 as ay, x1 - x0 as sx, y1 - y0 as sy
   from corner join edge using (map_id))
, cd as (select {ids}, i, polyline_id, seg_idx, sqrt(power(ax - least(greatest(t, 0), 1) * sx, 2) + power(ay - least(greatest(t, 0), 1) * sy, 2)) as d,
    case when t < 0 then np when t > 1 then nn else n end as n from cs)
, cn as (select {ids}, i, arg_min(n * d, (d, polyline_id, seg_idx)) as s from cd group by {ids}, i)
, edged as (select {ids}, max(s) as road_edge_distance from cn group by {ids})"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return segments(spark, sf, rd.EDGE)


def lanes(spark: SparkSession, sf: str) -> DataFrame:
    return segments(spark, sf, rd.LANE)


EDGE_VIEW = ", edge as (select * from road_segment where road_type = 6)"
LANE_VIEW = ", lane as (select * from road_segment where road_type = 4)"


@query("c07_road_edge_distance", px.with_views(
    f"{EDGE_VIEW}{edge_sql('log', IDS)} select {IDS}, {r('road_edge_distance', 'road_edge_distance')}, road_edge_distance > 0 as offroad from log left join edged using ({IDS})",
    "log", "road_segment"))
def _(spark, sf):
    d = rd.road_edge_distance(cut_lineage(px.log(spark, sf)), cut_lineage(edges(spark, sf)), ["map_id"], ID)
    return d.select(*ID, r6("road_edge_distance").alias("road_edge_distance"), (F.col("road_edge_distance") > 0).alias("offroad"))


@query("c08_nearest_lane", px.with_views(
    f"""{LANE_VIEW}, c as (select {IDS}, heading, polyline_id, seg_idx, atan2(y1 - y0, x1 - x0) as h, case when xp is not null then atan2(y0 - yp, x0 - xp) end as ph,
       x - x0 as ax, y - y0 as ay, x1 - x0 as sx, y1 - y0 as sy from log join lane using (map_id))
    , d as (select *, least(greatest((ax * sx + ay * sy) / (sx * sx + sy * sy), 0), 1) as t, abs(h - heading) as hd from c)
    , e as (select *, sqrt(power(ax - t * sx, 2) + power(ay - t * sy, 2)) as dist from d)
    , f as (select *, dist + case when (case when hd > pi() then 2 * pi() - hd else hd end) > pi() / 6 then 3.0e0 else 0.0e0 end as pen from e where dist <= 12.5e0)
    , g as (select *, row_number() over (partition by {IDS} order by pen, polyline_id, seg_idx) as rn, min(dist) over (partition by {IDS}) as lane_distance from f)
    , k as (select *, abs(heading - (h + coalesce(ph, h)) / 2) as ag from g where rn = 1)
    select {IDS}, {r('lane_distance', 'lane_distance')}, case when pen <= 4 then polyline_id end as lane_id, coalesce(pen <= 4, false) as lane_valid,
      coalesce(pen <= 4 and (case when ag > pi() then 2 * pi() - ag else ag end) < pi() / 12, false) as lane_aligned,
      {r('(sx * ay - sy * ax) / sqrt(sx * sx + sy * sy)', 'lateral_offset')}, {r('k.heading - h', 'heading_error')}
    from log left join k using ({IDS})""", "log", "road_segment"))
def _(spark, sf):
    n = rd.nearest_lane(px.log(spark, sf), lanes(spark, sf), ["map_id"], ID)
    cols = ["lane_distance", "lateral_offset", "heading_error"]
    return rounded(n.select(*ID, "lane_distance", "lane_id", "lane_valid", "lane_aligned", "lateral_offset", "heading_error"), *cols)


def crossing_sql(ids: str) -> str:
    den = "((bx - ax) * (y1 - y0) - (\"by\" - ay) * (x1 - x0))"
    tn = "((x0 - ax) * (y1 - y0) - (y0 - ay) * (x1 - x0))"
    un = "((x0 - ax) * (\"by\" - ay) - (y0 - ay) * (bx - ax))"
    return f"""{CORNERS_SQL.format(src='log')}
, side as (select a.*, a.px as ax, a.py as ay, b.px as bx, b.py as "by" from corner a join corner b using ({ids}) where b.i = (a.i + 1) % 4 and a.object_type <> 2)
, crossed as (select distinct {ids} from side join edge using (map_id) where {den} <> 0 and {tn} / nullif({den}, 0) between 0 and 1 and {un} / nullif({den}, 0) between 0 and 1)"""


@query("c09_offroad_flags", px.with_views(
    f"{EDGE_VIEW}{crossing_sql(IDS)} select {IDS}, c.step is not null as offroad from log l left join crossed c using ({IDS})".replace("c.step is not null", "c.scenario_id is not null"),
    "log", "road_segment"))
def _(spark, sf):
    return rd.offroad_flags(px.log(spark, sf), edges(spark, sf), ["map_id"], ID).select(*ID, "offroad")


@query("c09_offroad_flags_with_lanes", px.with_views(
    f"""{EDGE_VIEW}{LANE_VIEW}{crossing_sql(IDS)}
    , near as (select distinct {IDS} from (select {IDS}, x - x0 as ax, y - y0 as ay, x1 - x0 as sx, y1 - y0 as sy from log join lane using (map_id))
       where sqrt(power(ax - least(greatest((ax * sx + ay * sy) / (sx * sx + sy * sy), 0), 1) * sx, 2) + power(ay - least(greatest((ax * sx + ay * sy) / (sx * sx + sy * sy), 0), 1) * sy, 2)) <= 2.25e0)
    select {IDS}, c.scenario_id is not null or n.scenario_id is null as offroad from log l left join crossed c using ({IDS}) left join near n using ({IDS})""", "log", "road_segment"))
def _(spark, sf):
    return rd.offroad_flags(px.log(spark, sf), edges(spark, sf), ["map_id"], ID, lanes=lanes(spark, sf)).select(*ID, "offroad")


def spiral_sql() -> str:
    return ", ".join(f"({i}, {dx}, {dy})" for i, (dx, dy) in enumerate(grid.spiral(2)))


@query("c13_road_features", px.with_views(
    f""", m as (select *, (x0 + x1) / 2 as mx, (y0 + y1) / 2 as my, cast(floor((x0 + x1) / 2 / 5.0e0) as bigint) as gx, cast(floor((y0 + y1) / 2 / 5.0e0) as bigint) as gy from road_segment)
    , e as (select *, cos(heading) as hx, sin(heading) as hy, cast(floor(x / 5.0e0) as bigint) as ex, cast(floor(y / 5.0e0) as bigint) as ey from log)
    , j as (select e.*, m.polyline_id, m.seg_idx, m.road_type, mx - x as rx, my - y as ry, x1 - mx as ux, y1 - my as uy, sqrt((x1 - mx) * (x1 - mx) + (y1 - my) * (y1 - my)) as half,
        row_number() over (partition by scenario_id, agent_id, step order by ring, polyline_id, seg_idx) as slot
        from e cross join (values {spiral_sql()}) s(ring, ox, oy) join m on m.map_id = e.map_id and m.gx = e.ex + ox and m.gy = e.ey + oy)
    select {IDS}, slot, polyline_id, seg_idx, {r('(rx * hx + ry * hy) * 0.02e0', 'rel_x')}, {r('(ry * hx - rx * hy) * 0.02e0', 'rel_y')}, {r('half / 100.0e0', 'length')},
      {r('ux / half * hx + uy / half * hy', 'cos_angle')}, {r('uy / half * hx - ux / half * hy', 'sin_angle')}, {r('road_type - 4.0e0', 'type')} from j where slot <= 128""", "log", "road_segment"))
def _(spark, sf):
    f = rd.road_features(cut_lineage(px.log(spark, sf)), segments(spark, sf), ["map_id"], ID, k=128).drop("width")
    return rounded(f, "rel_x", "rel_y", "length", "cos_angle", "sin_angle", "type")


@query("c14_grid_cells", px.with_views(
    """, m as (select map_id, cast(floor((x0 + x1) / 2 / 5.0e0) as bigint) as gx, cast(floor((y0 + y1) / 2 / 5.0e0) as bigint) as gy from road_segment)
    select map_id, gx + ox as cx, gy + oy as cy, count(*) as segments from m cross join (select unnest(range(-2, 3)) as ox) cross join (select unnest(range(-2, 3)) as oy)
    group by map_id, gx + ox, gy + oy""", "road_segment"))
def _(spark, sf):
    s = segments(spark, sf)
    mid = s.select("map_id", ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my"))
    return grid.neighbor_cells(mid, F.col("mx"), F.col("my")).groupBy("map_id", "cx", "cy").agg(F.count("*").alias("segments"))


def frame_roads(spark, sf, radius: float, *types: int) -> DataFrame:
    log = px.log(spark, sf).withColumn("yaw", F.col("heading"))
    return rd.crop_roads(log, segments(spark, sf, *types), ["map_id"], ID, radius)


def frame_roads_sql(radius: float, view: str) -> str:
    return f"""
, fr0 as (select {IDS}, polyline_id, seg_idx, road_type, x0 - x as ax, y0 - y as ay, x1 - x as bx, y1 - y as b_y, cos(heading) as c, sin(heading) as s from log join {view} using (map_id))
, fr1 as (select {IDS}, polyline_id, seg_idx, road_type, ax * c + ay * s as ex0, ay * c - ax * s as ey0, bx * c + b_y * s as ex1, b_y * c - bx * s as ey1 from fr0)
, fr as (select * from fr1 where least(ex0, ex1) <= {radius!r}::double and greatest(ex0, ex1) >= -{radius!r}::double and least(ey0, ey1) <= {radius!r}::double and greatest(ey0, ey1) >= -{radius!r}::double)"""


@query("c18_crop_roads", px.with_views(
    f"""{frame_roads_sql(6.0, 'road_segment')} select {IDS}, polyline_id, seg_idx, {r('ex0', 'ex0')}, {r('ey0', 'ey0')}, {r('ex1', 'ex1')}, {r('ey1', 'ey1')},
      case when road_type = 4 then 1 else 0 end as draw_pass from fr""", "log", "road_segment"))
def _(spark, sf):
    return rounded(frame_roads(spark, sf, 6.0).drop("road_type"), "ex0", "ey0", "ex1", "ey1")


@query("c20_stray_vehicles", px.with_views(
    f"""{LANE_VIEW}{frame_roads_sql(12.0, 'lane')}
    , ag as (select a.scenario_id, a.step, a.agent_id as ego_id, o.agent_id, (o.x - a.x) * cos(a.heading) + (o.y - a.y) * sin(a.heading) as px, (o.y - a.y) * cos(a.heading) - (o.x - a.x) * sin(a.heading) as py
        from log a join log o on a.scenario_id = o.scenario_id and a.step = o.step and a.agent_id <> o.agent_id
        where (o.x - a.x) * (o.x - a.x) + (o.y - a.y) * (o.y - a.y) <= 144.0e0 and o.object_type = 1 and a.step % 10 = 0)
    , d as (select ag.scenario_id, ag.ego_id, ag.step, ag.agent_id, min(sqrt(power(px - ex0 - t * (ex1 - ex0), 2) + power(py - ey0 - t * (ey1 - ey0), 2))) as dist
        from (select ag.*, ex0, ey0, ex1, ey1, least(greatest(((px - ex0) * (ex1 - ex0) + (py - ey0) * (ey1 - ey0)) / (power(ex1 - ex0, 2) + power(ey1 - ey0, 2)), 0), 1) as t
              from ag join fr on fr.scenario_id = ag.scenario_id and fr.agent_id = ag.ego_id and fr.step = ag.step) ag
        group by ag.scenario_id, ag.ego_id, ag.step, ag.agent_id)
    select scenario_id, ego_id, count(*) as sightings, {r('avg(case when dist > 3.0e0 then 1.0e0 else 0.0e0 end)', 'stray_fraction')} from d group by scenario_id, ego_id""", "log", "road_segment"))
def _(spark, sf):
    log = px.log(spark, sf)
    # Every tenth frame of a segment is the operator's own stride.
    strided = log.filter(F.col("step") % 10 == 0)
    ids = ["scenario_id", "ego_id", "step"]
    frame = strided.select("scenario_id", "step", F.col("agent_id").alias("ego_id"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("heading").alias("yaw"))
    agents = ia.crop_agents(frame, strided, ["scenario_id", "step"], 12.0)
    ego = strided.withColumn("yaw", F.col("heading")).withColumnRenamed("agent_id", "ego_id")
    roads = rd.crop_roads(ego, lanes(spark, sf), ["map_id"], ids, 12.0)
    seen = rd.stray_vehicles(agents, roads, ids, 3.0)
    return seen.groupBy("scenario_id", "ego_id").agg(F.count("*").alias("sightings"), r6(F.avg(F.col("stray").cast("double"))).alias("stray_fraction"))


@query("c21_nearest_lane_start", px.with_views(
    f"{LANE_VIEW}{frame_roads_sql(12.0, 'lane')} select {IDS}, {r('min(sqrt(ex0 * ex0 + ey0 * ey0))', 'lane_start_distance')} from fr group by {IDS}", "log", "road_segment"))
def _(spark, sf):
    return rounded(rd.nearest_lane_start(frame_roads(spark, sf, 12.0, rd.LANE), ID), "lane_start_distance")


# ---------------------------------------------------------------- B24, B25, E10, E11, D30, D31

@query("b24_prepare_roads", px.with_views(
    f""", p as (select *, sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) as len from road_segment)
    , g as (select *, case when road_type = 4 and len > 1e-6 then 2.25e0 / len else 0 end as grow from p)
    select polyline_id, seg_idx, {r('x0 - (x1 - x0) * grow', 'x0')}, {r('y0 - (y1 - y0) * grow', 'y0')}, {r('x1 + (x1 - x0) * grow', 'x1')}, {r('y1 + (y1 - y0) * grow', 'y1')},
      case road_type when 4 then 4.5e0 when 5 then 0.15e0 else 0.25e0 end as width, case when road_type = 4 then 1 else 0 end as draw_pass,
      case road_type when 4 then 11 when 6 then 12 else 5 end as draw_type from g""", "road_segment"))
def _(spark, sf):
    p = rd.prepare_roads(segments(spark, sf)).select("polyline_id", "seg_idx", "x0", "y0", "x1", "y1", "width", "draw_pass", "draw_type")
    return rounded(p, "x0", "y0", "x1", "y1")


@query("b25_boundary_type",
       """with c as (select o_orderkey, case o_orderstatus when 'F' then 'Driving' when 'O' then 'Shoulder' end as neighbour,
          case cast(substr(o_orderpriority, 1, 1) as int) when 1 then 'Curb' when 2 then 'NONE' when 3 then 'Solid' when 4 then 'Other' end as marking from orders)
          select o_orderkey, case when marking = 'Curb' then 6 when neighbour is null or neighbour <> 'Driving' then 6
            when coalesce(marking, 'NONE') in ('NONE', 'Other') then null else 5 end as boundary from c""")
def _(spark, sf):
    o = px.table(spark, sf, "orders")
    neighbour = F.when(F.col("o_orderstatus") == "F", "Driving").when(F.col("o_orderstatus") == "O", "Shoulder")
    p = F.substring("o_orderpriority", 1, 1)
    marking = F.when(p == "1", "Curb").when(p == "2", "NONE").when(p == "3", "Solid").when(p == "4", "Other")
    return o.select("o_orderkey", rd.boundary_type(neighbour, marking).alias("boundary"))


@query("e10_to_segments", px.with_views(
    f"""select polyline_id, seg_idx, {r('sqrt(power(x1 - x0, 2) + power(y1 - y0, 2))', 'length')} from road_segment
    where sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) between 1e-6 and 4.02e0""", "road_segment"))
def _(spark, sf):
    s = rd.to_segments(px.road_point(spark, sf), ["polyline_id"], max_gap=4.02)
    return s.select("polyline_id", "seg_idx", r6(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("length"))


@query("e11_lane_boundaries", px.with_views(
    f""", w as (select map_id, polyline_id, pt_idx, x, y, case when pt_idx % 5 = 4 then 'Shoulder' else 'Driving' end as nb,
         case when polyline_id % 3 = 0 then 'Solid' when polyline_id % 3 = 1 then 'Broken' else 'NONE' end as mk, pt_idx = 7 as junction from road_point)
    , k as (select *, case when junction then null when nb <> 'Driving' then 6 when mk = 'NONE' then null else 5 end as kind from w)
    , b as (select map_id, polyline_id, pt_idx, side, kind, x, y + sg * 1.75e0 as y from k cross join (values (0, 1.0e0), (1, -1.0e0)) s(side, sg))
    , n as (select *, lead(x) over w as x1, lead(y) over w as y1, lead(kind) over w as nk from b window w as (partition by map_id, polyline_id, side order by pt_idx))
    , q as (select *, round_even(x / 0.05e0, 0) as qa, round_even(y / 0.05e0, 0) as qb, round_even(x1 / 0.05e0, 0) as qc, round_even(y1 / 0.05e0, 0) as qd from n
            where kind = nk and sqrt(power(x1 - x, 2) + power(y1 - y, 2)) between 1e-6 and 12.0e0)
    , o as (select *, row_number() over (partition by kind, least((qa, qb), (qc, qd)), greatest((qa, qb), (qc, qd)) order by map_id, polyline_id, side, pt_idx) as rn from q)
    select kind, map_id, polyline_id, cast(side as bigint) as side, pt_idx as s, {r('x', 'x0')}, {r('y', 'y0')}, {r('x1', 'x1')}, {r('y1', 'y1')} from o where rn = 1""", "road_point"))
def _(spark, sf):
    nb = F.when(F.col("pt_idx") % 5 == 4, "Shoulder").otherwise("Driving")
    mk = F.when(F.col("polyline_id") % 3 == 0, "Solid").when(F.col("polyline_id") % 3 == 1, "Broken").otherwise("NONE")
    w = px.road_point(spark, sf).select(
        "map_id", "polyline_id", F.col("pt_idx").alias("s"), "x", "y", F.lit(0.0).alias("rx"), F.lit(-1.0).alias("ry"), F.lit(3.5).alias("lane_width"),
        (F.col("pt_idx") == 7).alias("is_junction"), nb.alias("left_neighbour"), nb.alias("right_neighbour"), mk.alias("left_marking"), mk.alias("right_marking"))
    b = rd.lane_boundaries(w, ["map_id", "polyline_id"], max_gap=12.0).withColumn("side", F.col("side").cast("long"))
    return rounded(b, "x0", "y0", "x1", "y1")


@query("d30_map_stats", px.with_views(
    f""", n as (select map_id, polyline_id, count(*) as n from road_point group by map_id, polyline_id)
    select map_id, count(*) as roads, max(n) as max_points, min(n) as min_points, cast(sum(n) as bigint) as total_points, {r('avg(n)', 'mean_points')} from n group by map_id""", "road_point"))
def _(spark, sf):
    return rounded(rd.map_stats(px.road_point(spark, sf), ["map_id"]), "mean_points")


def polylines(spark: SparkSession, sf: str) -> DataFrame:
    """One row per polyline with its few points in order."""
    p = px.road_point(spark, sf).groupBy("map_id", "polyline_id", "road_type")
    return p.agg(F.array_sort(F.collect_list(F.struct("pt_idx", "x", "y"))).alias("pts"))


@query("e12_split_rings", px.with_views(
    "select polyline_id, pt_idx // 5 as ring, count(*) as points, count(*) = 5 as closed from road_point group by polyline_id, pt_idx // 5 having count(*) > 2", "road_point"))
def _(spark, sf):
    # Every fifth point returns to the start of its ring.
    plain = F.transform("pts", lambda p, i: F.get("pts", F.when(i % 5 == 4, i - 4).otherwise(i)))
    flat = polylines(spark, sf).withColumn("pts", F.transform(plain, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    rings = flat.select("polyline_id", F.posexplode(rd.split_rings(F.col("pts"))).alias("ring", "pts"))
    first, last = F.get("pts", F.lit(0)), F.element_at("pts", -1)
    return rings.select("polyline_id", F.col("ring").cast("long").alias("ring"), F.size("pts").cast("long").alias("points"), (first == last).alias("closed"))


@query("a17_simplify_roads")
def _(spark, sf):
    road = polylines(spark, sf).select("polyline_id", F.col("road_type").alias("raw_type"), F.transform("pts", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(0.0).alias("z"))).alias("pts"))
    return simplify_roads(road).select("polyline_id", "raw_type", F.size("pts").cast("long").alias("points"))


@query("d31_drivable_coverage", px.with_views(
    f""", l as (select map_id, x0, y0, x1 - x0 as sx, y1 - y0 as sy, cast(floor((least(x0, x1) - 2.25e0) / 0.5e0) as bigint) as ax, cast(floor((greatest(x0, x1) + 2.25e0) / 0.5e0) as bigint) as bx,
        cast(floor((least(y0, y1) - 2.25e0) / 0.5e0) as bigint) as ay, cast(floor((greatest(y0, y1) + 2.25e0) / 0.5e0) as bigint) as by_ from road_segment where road_type = 4)
    , c as (select *, unnest(range(ay, by_ + 1)) as cy from (select *, unnest(range(ax, bx + 1)) as cx from l))
    , d as (select *, (cx + 0.5e0) * 0.5e0 - x0 as px, (cy + 0.5e0) * 0.5e0 - y0 as py from c)
    , t as (select *, least(greatest((px * sx + py * sy) / (sx * sx + sy * sy), 0), 1) as t from d)
    , inside as (select distinct map_id, cx, cy from t where sqrt(power(px - t * sx, 2) + power(py - t * sy, 2)) <= 2.25e0)
    , box as (select a.i as i, b.i as j from range(-2, 3) a(i) cross join range(-2, 3) b(i))
    , grown as (select distinct map_id, cx + i as cx, cy + j as cy from inside cross join box)
    , closed as (select map_id, cx + i as cx, cy + j as cy from grown cross join box group by 1, 2, 3 having count(*) = 25)
    , n as (select map_id, count(*) as n from closed group by map_id)
    , area as (select map_id, (ceil((max(x) - min(x) + 20) / 0.5e0) + 1) * (ceil((max(y) - min(y) + 20) / 0.5e0) + 1) as a from road_point group by map_id)
    select map_id, coalesce(n, 0) as cells, {r('coalesce(n, 0) / a', 'share')} from area left join n using (map_id)""", "road_segment"))
def _(spark, sf):
    return rounded(rd.coverage_share(rd.drivable_spans(segments(spark, sf), ["map_id"]), px.road_point(spark, sf), ["map_id"]), "share")


# ---------------------------------------------------------------- D7-D9: whole realism evaluation

NAMES = [s.name for s in lk.REALISM]
VALUE_SQL = {
    "linear_speed": "speed", "linear_acceleration": "acceleration", "angular_speed": "angular_speed", "angular_acceleration": "angular_acceleration",
    "distance_to_nearest_object": "coalesce(nearest_distance, 1e10)", "time_to_collision": "ttc", "distance_to_road_edge": "coalesce(road_edge_distance, -1e10)",
}
MASK_SQL = {s.name: {"valid": "log_valid", "vehicle_valid": "log_valid and object_type = 1"}.get(s.valid, s.valid) for s in lk.REALISM}
FEATURE_SQL = f"""{EDGE_VIEW}{STATES}{KIN.format(src='states')}{TTC}{NEAREST}{edge_sql('states', RIDS)}
, feat as (select {RIDS}, object_type, log_valid, speed_valid, acceleration_valid, {', '.join(f'{v} as f_{k}' for k, v in VALUE_SQL.items())}
   from kin join ttc using ({RIDS}) left join nearest using ({RIDS}) left join edged using ({RIDS}))"""


def agent_sql() -> str:
    parts, joins = [], []
    for s in lk.REALISM:
        n = s.name
        parts.append(f"""
, b_{n} as (select {RIDS}, {MASK_SQL[n]} as ok, {edge_bin_sql(f'f_{n}', s)} as b from feat)
, c_{n} as (select scenario_id, agent_id, b, count(*) as c from b_{n} where rollout >= 0 and b is not null group by scenario_id, agent_id, b)
, t_{n} as (select scenario_id, agent_id, sum(c) as n from c_{n} group by scenario_id, agent_id)
, l_{n} as (select scenario_id, agent_id, avg(case when ok then ln((coalesce(c, 0) + 0.1e0) / (coalesce(n, 0) + {0.1 * s.bins!r}::double)) end) as ll_{n}
   from (select * from b_{n} where rollout = -1 and b is not null) left join c_{n} using (scenario_id, agent_id, b) left join t_{n} using (scenario_id, agent_id) group by scenario_id, agent_id)""")
        joins.append(f"left join l_{n} using (scenario_id, agent_id)")
    flags = "".join(f"""
, r_{n} as (select scenario_id, agent_id, rollout, coalesce(bool_or({cond} and log_valid), false) as hit from feat group by scenario_id, agent_id, rollout)
, l_{n} as (select scenario_id, agent_id, ln((case when bool_or(hit and rollout = -1) then count(*) filter (hit and rollout >= 0) else count(*) filter (not hit and rollout >= 0) end + 0.001e0)
   / (count(*) filter (rollout >= 0) + 0.002e0)) as ll_{n} from r_{n} group by scenario_id, agent_id)"""
                    for n, cond in (("collision_indication", "f_distance_to_nearest_object < 0"), ("offroad_indication", "f_distance_to_road_edge > 0")))
    joins += [f"left join l_{n} using (scenario_id, agent_id)" for n in ("collision_indication", "offroad_indication")]
    flags += """
, strayed as (select s.scenario_id, s.agent_id, s.rollout, sum(case when l.valid then sqrt(power(s.x - l.x, 2) + power(s.y - l.y, 2)) else 0 end) / greatest(count(*) filter (l.valid), 1) as a
   from sim s join log l on l.scenario_id = s.scenario_id and l.agent_id = s.agent_id and l.step = s.step group by s.scenario_id, s.agent_id, s.rollout)
, ades as (select scenario_id, agent_id, avg(a) as ade, min(a) as min_ade from strayed group by scenario_id, agent_id)"""
    joins.append("left join ades using (scenario_id, agent_id)")
    return f"{FEATURE_SQL}{''.join(parts)}{flags}, agents as (select distinct scenario_id, agent_id from feat)\n, agent as (select * from agents {' '.join(joins)})"


METRICS = [*NAMES, "collision_indication", "offroad_indication"]


def agent_table(spark: SparkSession, sf: str) -> DataFrame:
    return rl.agent_scores(rl.features(all_states(spark, sf), cut_lineage(edges(spark, sf)), ["map_id"]))


@query("agent_log_likelihoods", px.with_views(
    f"{agent_sql()} select scenario_id, agent_id, {', '.join(r(f'll_{m}', f'll_{m}') for m in METRICS)}, {r('ade', 'ade')}, {r('min_ade', 'min_ade')} from agent", "log", "sim", "road_segment"))
def agent_log_likelihoods(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agent_table(spark, sf), *[f"ll_{m}" for m in METRICS], "ade", "min_ade")


def scenario_sql() -> str:
    meta = " + ".join(f"exp(avg(ll_{m})) * {sc.WEIGHTS[m]!r}::double" for m in sc.WEIGHTS)
    return f"""{agent_sql()}
, scene as (select scenario_id, {', '.join(f'round_even(exp(avg(ll_{m})), 3) as {m}' for m in METRICS)}, round_even({meta}, 3) as realism_meta_score, round_even(avg(ade), 3) as ade, round_even(avg(min_ade), 3) as min_ade, count(*) as num_agents
   from agent group by scenario_id having {' and '.join(f'avg(ll_{m}) is not null' for m in METRICS)})"""


def scenario_table(spark: SparkSession, sf: str) -> DataFrame:
    return sc.scenario_scores(agent_table(spark, sf))


@query("d07_scenario_scores", px.with_views(
    f"{scenario_sql()} select scenario_id, {', '.join(f'{m} + 0.0e0 as {m}' for m in [*METRICS, 'realism_meta_score', 'ade', 'min_ade'])}, num_agents from scene", "log", "sim", "road_segment"))
def _(spark, sf):
    return scenario_table(spark, sf)


def group_sql() -> str:
    def mean(ms):
        return f"avg(({' + '.join(ms)}) / {len(ms)})"

    return f"""{scenario_sql()}
, batched as (select *, scenario_id % 3 as batch from scene)
, grp as (select batch, {mean(sc.KINEMATIC)} as kinematic_metrics, {mean(sc.INTERACTIVE)} as interactive_metrics, {mean(sc.MAP_BASED)} as map_based_metrics from batched group by batch)"""


@query("d08_group_metrics", px.with_views(
    f"""{group_sql()} select scenario_id, batch, {r('kinematic_metrics', 'kinematic_metrics')}, {r('interactive_metrics', 'interactive_metrics')}, {r('map_based_metrics', 'map_based_metrics')}
    from batched join grp using (batch)""", "log", "sim", "road_segment"))
def _(spark, sf):
    batched = cut_lineage(scenario_table(spark, sf).withColumn("batch", F.col("scenario_id") % 3))
    out = sc.group_metrics(batched, "batch")
    cols = ["kinematic_metrics", "interactive_metrics", "map_based_metrics"]
    return rounded(out.select("scenario_id", "batch", *cols), *cols)


@query("d09_dataset_summary", px.with_views(
    f"""{scenario_sql()} select {', '.join(r(f'avg({m})', m) for m in [*METRICS, 'realism_meta_score', 'ade', 'min_ade'])}, {r('stddev_samp(realism_meta_score)', 'realism_meta_score_std')},
    cast(coalesce(sum(num_agents), 0) as bigint) as total_num_agents, count(*) as unique_scenarios from scene""", "log", "sim", "road_segment"))
def _(spark, sf):
    out = sc.dataset_summary(scenario_table(spark, sf))
    return rounded(out, *METRICS, "realism_meta_score", "ade", "min_ade", "realism_meta_score_std")
