"""Queries: geometry functions, kinematics, likelihoods, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajlake.functions import geometry as g
from trajlake.operators import kinematics as kin
from trajlake.operators import likelihood as lk
from trajlake.operators import scoring as sc
from trajlake.plans import proxies as px
from trajlake.plans.registry import query, r, r6, rounded

SPEED = lk.REALISM[0]

# ---------------------------------------------------------------- shared SQL fragments

WRAP = "((({0}) + pi()) - 2 * pi() * floor((({0}) + pi()) / (2 * pi())) - pi())"
KIN = f"""
, kin1 as (select *, (lead(x) over w - lag(x) over w) / 2 as dx, (lead(y) over w - lag(y) over w) / 2 as dy,
            (lead(heading) over w - lag(heading) over w) / 2 as dh
          from {{src}} window w as (partition by scenario_id, agent_id, rollout order by step))
, kin2 as (select *, sqrt(dx * dx + dy * dy) / 0.1e0 as speed, {WRAP.format('dh * 2')} / 2 as turn from kin1)
, kin3 as (select *, (lead(speed) over w - lag(speed) over w) / 2 / 0.1e0 as acceleration, turn / 0.1e0 as angular_speed,
            (lead(turn) over w - lag(turn) over w) / 2 as d2 from kin2
          window w as (partition by scenario_id, agent_id, rollout order by step))
, kin as (select *, {WRAP.format('d2 * 2')} / 2 / (0.1e0 * 0.1e0) as angular_acceleration from kin3)"""
VALID = """
, mask1 as (select *, coalesce(lag(valid) over w and lead(valid) over w, false) as speed_valid
           from log window w as (partition by scenario_id, agent_id order by step))
, mask as (select *, coalesce(lag(speed_valid) over w and lead(speed_valid) over w, false) as acceleration_valid
           from mask1 window w as (partition by scenario_id, agent_id order by step))"""


def log_as_rollout(spark: SparkSession, sf: str) -> DataFrame:
    return px.log(spark, sf).withColumn("rollout", F.lit(-1).cast("long"))


def next_step(df: DataFrame, cols: list[str], keys=("scenario_id", "agent_id")) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("step")
    return df.withColumns({f"n_{c}": F.lead(c).over(w) for c in cols}).filter(F.col(f"n_{cols[0]}").isNotNull())


NEXT = """
, pair as (select * from (select *, {cols} from log window w as (partition by scenario_id, agent_id order by step)) where {first} is not null)"""


def next_sql(*cols: str) -> str:
    return NEXT.format(cols=", ".join(f"lead({c}) over w as n_{c}" for c in cols), first=f"n_{cols[0]}")


# ---------------------------------------------------------------- B: scalar geometry

ID = ["scenario_id", "agent_id", "step"]
IDS = "scenario_id, agent_id, step"


@query("b01_wrap_angle", px.with_views(f"select {IDS}, {r(WRAP.format('heading * 7'), 'wrapped')} from log", "log"))
def _(spark, sf):
    return px.log(spark, sf).select(*ID, r6(g.wrap_angle(F.col("heading") * 7)).alias("wrapped"))


@query("b02_rotate2d", px.with_views(
    f"select {IDS}, {r('x * cos(heading) - y * sin(heading)', 'rx')}, {r('x * sin(heading) + y * cos(heading)', 'ry')} from log", "log"))
def _(spark, sf):
    rx, ry = g.rotate2d(F.col("x"), F.col("y"), F.col("heading"))
    return px.log(spark, sf).select(*ID, r6(rx).alias("rx"), r6(ry).alias("ry"))


@query("b03_world_to_ego", px.with_views(
    f"""{next_sql('x', 'y')} select {IDS}, {r('(n_x - x) * cos(heading) + (n_y - y) * sin(heading)', 'ex')},
    {r('(n_y - y) * cos(heading) - (n_x - x) * sin(heading)', 'ey')} from pair""", "log"))
def _(spark, sf):
    p = next_step(px.log(spark, sf), ["x", "y"])
    ex, ey = g.world_to_ego(F.col("n_x"), F.col("n_y"), F.col("x"), F.col("y"), F.col("heading"))
    return p.select(*ID, r6(ex).alias("ex"), r6(ey).alias("ey"))


def pose_column():
    c, s, zero, one = F.cos("heading"), F.sin("heading"), F.lit(0.0), F.lit(1.0)
    return F.array(c, -s, zero, F.col("x"), s, c, zero, F.col("y"), zero, zero, one, zero, zero, zero, zero, one)


@query("b04_pose_yaw_box_center", px.with_views(
    f"select {IDS}, {r('atan2(sin(heading), cos(heading))', 'yaw')}, {r('x + 1.44e0 * cos(heading)', 'cx')}, {r('y + 1.44e0 * sin(heading)', 'cy')} from log", "log"))
def _(spark, sf):
    p = px.log(spark, sf).withColumn("pose", pose_column())
    cx, cy = g.box_center(F.col("pose"))
    return p.select(*ID, r6(g.pose_yaw(F.col("pose"))).alias("yaw"), r6(cx).alias("cx"), r6(cy).alias("cy"))


@query("b05_global_to_vehicle", px.with_views(
    f"""{next_sql('x', 'y')} select {IDS}, {r('(n_x - 1.0e0 - x) * cos(heading) + (n_y - 2.0e0 - y) * sin(heading) - 1.44e0', 'vx')},
    {r('(n_y - 2.0e0 - y) * cos(heading) - (n_x - 1.0e0 - x) * sin(heading)', 'vy')}, {r('length - 0.5e0', 'vz')} from pair""", "log"))
def _(spark, sf):
    p = next_step(px.log(spark, sf), ["x", "y"]).withColumn("pose", pose_column())
    v = g.global_to_vehicle((F.col("n_x"), F.col("n_y"), F.col("length")), F.col("pose"), (1.0, 2.0, 0.5))
    return p.select(*ID, *[r6(c).alias(n) for c, n in zip(v, ("vx", "vy", "vz"))])


CORNERS_SQL = """
, corner as (select l.*, i, x + sl * length / 2 * cos(heading) - sw * width / 2 * sin(heading) as px,
   y + sl * length / 2 * sin(heading) + sw * width / 2 * cos(heading) as py
   from {src} l cross join (values (0, 1.0e0, 1.0e0), (1, -1.0e0, 1.0e0), (2, -1.0e0, -1.0e0), (3, 1.0e0, -1.0e0)) c(i, sl, sw))"""


@query("b06_box_corners", px.with_views(
    f"{CORNERS_SQL.format(src='log')} select {IDS}, cast(i as bigint) as corner, {r('px', 'px')}, {r('py', 'py')} from corner", "log"))
def _(spark, sf):
    p = px.log(spark, sf).select(*ID, F.posexplode(g.box_corners(g.Box.of())).alias("corner", "c"))
    return p.select(*ID, F.col("corner").cast("long").alias("corner"), r6("c.x").alias("px"), r6("c.y").alias("py"))


@query("b07_dot_cross", px.with_views(
    f"{next_sql('x', 'y')} select {IDS}, {r('x * n_x + y * n_y', 'dot')}, {r('x * n_y - y * n_x', 'crossed')} from pair", "log"))
def _(spark, sf):
    p = next_step(px.log(spark, sf), ["x", "y"])
    v = [F.col(c) for c in ("x", "y", "n_x", "n_y")]
    return p.select(*ID, r6(g.dot2(*v)).alias("dot"), r6(g.cross2(*v)).alias("crossed"))


@query("b08_segments_intersect", px.with_views(
    f"""{next_sql('x', 'y')}, c as (select *, (n_x - x) as rx, (n_y - y) as ry, 3.0e0 as sx, 1.0e0 as sy, x - 0.5e0 as qx, y - 0.25e0 as qy from pair)
    , d as (select *, rx * sy - ry * sx as den, ((qx - x) * sy - (qy - y) * sx) as tn, ((qx - x) * ry - (qy - y) * rx) as un from c)
    select {IDS}, coalesce(den <> 0 and tn / nullif(den, 0) between 0 and 1 and un / nullif(den, 0) between 0 and 1, false) as hit from d""", "log"))
def _(spark, sf):
    p = next_step(px.log(spark, sf), ["x", "y"])
    q1 = (F.col("x") - 0.5, F.col("y") - 0.25)
    hit = g.segments_intersect((F.col("x"), F.col("y")), (F.col("n_x"), F.col("n_y")), q1, (q1[0] + 3.0, q1[1] + 1.0))
    return p.select(*ID, hit.alias("hit"))


BOXPAIR = next_sql("x", "y", "length", "width", "heading") + """
, bp as (select *, cos(heading) as ac, sin(heading) as asn, cos(n_heading) as bc, sin(n_heading) as bs, n_x + 2.0e0 - x as dx, n_y + 1.0e0 - y as dy from pair)
"""


def box_pair(spark, sf):
    p = next_step(px.log(spark, sf), ["x", "y", "length", "width", "heading"])
    b = g.Box(F.col("n_x") + 2.0, F.col("n_y") + 1.0, F.col("n_length"), F.col("n_width"), F.cos("n_heading"), F.sin("n_heading"))
    return p, g.Box.of(), b


def gaps_sql(al: str, aw: str, bl: str, bw: str) -> str:
    c, s = "abs(ac * bc + asn * bs)", "abs(ac * bs - asn * bc)"
    return f"""abs(dx * ac + dy * asn) - {al} - ({bl} * {c} + {bw} * {s}), abs(dy * ac - dx * asn) - {aw} - ({bl} * {s} + {bw} * {c}),
      abs(dx * bc + dy * bs) - {bl} - ({al} * {c} + {aw} * {s}), abs(dy * bc - dx * bs) - {bw} - ({al} * {s} + {aw} * {c})"""


@query("b09_boxes_overlap", px.with_views(
    f"{BOXPAIR} select {IDS}, greatest({gaps_sql('length / 2', 'width / 2', 'n_length / 2', 'n_width / 2')}) <= 0 as overlap from bp", "log"))
def _(spark, sf):
    p, a, b = box_pair(spark, sf)
    return p.select(*ID, g.boxes_overlap(a, b).alias("overlap"))


@query("b10_point_segment_distance", px.with_views(
    f"""{next_sql('x', 'y')}, c as (select *, n_x - x as sx, n_y - y as sy, 0.5e0 * (agent_id % 3) as ox from pair)
    , d as (select *, case when sx * sx + sy * sy = 0 then 0 else (ox * sx + 1.0e0 * sy) / (sx * sx + sy * sy) end as t from c)
    select {IDS}, {r('sqrt(power(ox - least(greatest(t, 0), 1) * sx, 2) + power(1.0e0 - least(greatest(t, 0), 1) * sy, 2))', 'distance')} from d""", "log"))
def _(spark, sf):
    p = next_step(px.log(spark, sf), ["x", "y"])
    px_, py_ = F.col("x") + (F.col("agent_id") % 3) * 0.5, F.col("y") + 1.0
    return p.select(*ID, r6(g.point_segment_distance(px_, py_, F.col("x"), F.col("y"), F.col("n_x"), F.col("n_y"))).alias("distance"))


def box_distance_sql(prefix_cte: str, ids: str, extra: str = "") -> str:
    """Signed rounded-box distance, spelled with an explicit corner list: (a: x.. ac asn, b: n_x.. bc bs, dx dy)."""
    return f"""{prefix_cte}
, sh as (select *, least(length, width) * 0.35e0 as ra, least(n_length, n_width) * 0.35e0 as rb from bp)
, hs as (select *, length / 2 - ra as al, width / 2 - ra as aw, n_length / 2 - rb as bl, n_width / 2 - rb as bw from sh)
, sg as (values (1.0e0, 1.0e0), (-1.0e0, 1.0e0), (-1.0e0, -1.0e0), (1.0e0, -1.0e0))
, far as (select {ids}, min(least(
     sqrt(power(greatest(abs((sl * al * ac - sw * aw * asn - dx) * bc + (sl * al * asn + sw * aw * ac - dy) * bs) - bl, 0), 2)
        + power(greatest(abs((sl * al * asn + sw * aw * ac - dy) * bc - (sl * al * ac - sw * aw * asn - dx) * bs) - bw, 0), 2)),
     sqrt(power(greatest(abs((dx + sl * bl * bc - sw * bw * bs) * ac + (dy + sl * bl * bs + sw * bw * bc) * asn) - al, 0), 2)
        + power(greatest(abs((dy + sl * bl * bs + sw * bw * bc) * ac - (dx + sl * bl * bc - sw * bw * bs) * asn) - aw, 0), 2)))) as apart,
     max(greatest({gaps_sql('al', 'aw', 'bl', 'bw')})) as gap, max(ra + rb) as rr
   from hs cross join sg c(sl, sw) group by {ids})
, dist as (select {ids}, case when gap <= 0 then gap else apart end - rr as distance from far)"""


@query("b11_box_signed_distance", px.with_views(
    f"{box_distance_sql(BOXPAIR, IDS)} select {IDS}, {r('distance', 'distance')} from dist", "log"))
def _(spark, sf):
    p, a, b = box_pair(spark, sf)
    return p.select(*ID, r6(g.box_signed_distance(a, b)).alias("distance"))


@query("b12_aabb_overlap", px.with_views(
    f"""{next_sql('x', 'y', 'length', 'width')} select {IDS},
    abs(n_x + 9.0e0 - x) <= greatest(length, width) + greatest(n_length, n_width) and abs(n_y - y) <= greatest(length, width) + greatest(n_length, n_width)
    and abs(vx - vy) <= 3.0e0 as overlap from pair""", "log"))
def _(spark, sf):
    p = next_step(px.log(spark, sf), ["x", "y", "length", "width"])
    a = [F.col("x"), F.col("y"), F.col("vx"), F.col("length"), F.col("width"), F.lit(1.5)]
    b = [F.col("n_x") + 9.0, F.col("n_y"), F.col("vy"), F.col("n_length"), F.col("n_width"), F.lit(1.5)]
    return p.select(*ID, g.aabb_overlap(a, b).alias("overlap"))


@query("b13_circle_slack", px.with_views(
    f"""{BOXPAIR} select {IDS}, {r('sqrt(dx * dx + dy * dy) - (sqrt(length * length + width * width) / 2 + sqrt(n_length * n_length + n_width * n_width) / 2 + 1.5e0)', 'slack')} from bp""", "log"))
def _(spark, sf):
    p, a, b = box_pair(spark, sf)
    return p.select(*ID, r6(g.circle_slack(a, b)).alias("slack"))


@query("b14_lane_aligned", px.with_views(
    """, c as (select polyline_id, seg_idx, atan2(y1 - y0, x1 - x0) as h2, coalesce(atan2(y0 - yp, x0 - xp), atan2(y1 - y0, x1 - x0)) as h1,
         0.01e0 * (polyline_id % 60) - 0.3e0 as car from road_segment)
    , d as (select *, abs(car - (h1 + h2) / 2) as gap from c)
    select polyline_id, seg_idx, (case when gap > pi() then 2 * pi() - gap else gap end) < pi() / 12 as aligned from d""", "road_segment"))
def _(spark, sf):
    s = segments(spark, sf)
    h2 = F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    h1 = F.when(F.col("xp").isNotNull(), F.atan2(F.col("y0") - F.col("yp"), F.col("x0") - F.col("xp")))
    car = (F.col("polyline_id") % 60) * 0.01 - 0.3
    return s.select("polyline_id", "seg_idx", g.lane_aligned(car, h2, h1).alias("aligned"))


def segments(spark, sf, *types: int):
    from trajlake.operators.roads import to_segments

    s = to_segments(px.road_point(spark, sf), ["map_id", "polyline_id", "road_type"])
    return s.filter(F.col("road_type").isin(*types)) if types else s


@query("b15_signed_speed", px.with_views(
    f"select {IDS}, {r('case when vx * cos(heading * 3) + vy * sin(heading * 3) < 0 then -sqrt(vx * vx + vy * vy) else sqrt(vx * vx + vy * vy) end', 'speed')} from log", "log"))
def _(spark, sf):
    h = F.col("heading") * 3
    return px.log(spark, sf).select(*ID, r6(g.signed_speed(F.col("vx"), F.col("vy"), F.cos(h), F.sin(h))).alias("speed"))


@query("b16_is_following", px.with_views(
    f"""{next_sql('heading')} select {IDS}, vx - 0.5e0 > 0 and abs(n_heading - heading) <= 75.0e0 * pi() / 180.0e0 and vy - 0.2e0 < 0
     and (vy - 0.2e0 < -0.5e0 or abs(n_heading - heading) <= 10.0e0 * pi() / 180.0e0) as following from pair""", "log"))
def _(spark, sf):
    p = next_step(px.log(spark, sf), ["heading"])
    return p.select(*ID, g.is_following(F.col("vx") - 0.5, F.col("vy") - 0.2, F.abs(F.col("n_heading") - F.col("heading"))).alias("following"))


@query("b17_within_radius", px.with_views(f"select {IDS} from log where x * x + y * y <= 625.0e0", "log"))
def _(spark, sf):
    return px.log(spark, sf).filter(g.within_radius(F.col("x"), F.col("y"), 25.0)).select(*ID)


@query("b18_segment_in_square", px.with_views(
    """select polyline_id, seg_idx from road_segment where not (least(x0, x1) > 40 or greatest(x0, x1) < -40 or least(y0, y1) > 40 or greatest(y0, y1) < -40)""", "road_segment"))
def _(spark, sf):
    s = segments(spark, sf)
    return s.filter(g.segment_in_square(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], 40.0)).select("polyline_id", "seg_idx")


@query("b19_nondegenerate", px.with_views(f"select {IDS} from log where length > 0.1e0 and width > 0.1e0 and vx > 0.1e0", "log"))
def _(spark, sf):
    return px.log(spark, sf).filter(g.nondegenerate(F.col("length"), F.col("width"), F.col("vx"))).select(*ID)


@query("b20_all_finite",
       "select vec_id, list_bool_and([isfinite(v) for v in list_transform(embedding, lambda e: cast(e as double) / (cast(vec_id % 7 as double)))]) as finite from embeddings")
def _(spark, sf):
    e = px.table(spark, sf, "embeddings")
    scaled = F.transform("embedding", lambda v: F.try_divide(v.cast("double"), (F.col("vec_id") % 7).cast("double")))
    return e.select("vec_id", g.all_finite(scaled).alias("finite"))


# ---------------------------------------------------------------- E1-E3, D20

@query("e01_central_diff", px.with_views(
    f"select {IDS}, {r('(lead(x) over w - lag(x) over w) / 2', 'dx')} from log window w as (partition by scenario_id, agent_id order by step)", "log"))
def _(spark, sf):
    return px.log(spark, sf).select(*ID, r6(kin.central_diff(F.col("x"), kin.track_window(kin.LOG_KEYS))).alias("dx"))


@query("e02_kinematics", px.with_views(
    f"""{KIN.format(src='sim')} select scenario_id, agent_id, rollout, step, {r('speed', 'speed')}, {r('acceleration', 'acceleration')},
    {r('angular_speed', 'angular_speed')}, {r('angular_acceleration', 'angular_acceleration')} from kin""", "sim"))
def _(spark, sf):
    k = kin.kinematics(px.sim(spark, sf))
    cols = ["speed", "acceleration", "angular_speed", "angular_acceleration"]
    return rounded(k.select(*kin.SIM_KEYS, "step", *cols), *cols)


@query("e03_kinematic_validity", px.with_views(f"{VALID} select {IDS}, speed_valid, acceleration_valid from mask", "log"))
def _(spark, sf):
    return kin.kinematic_validity(px.log(spark, sf)).select(*ID, "speed_valid", "acceleration_valid")


@query("d20_track_stats", px.with_views(
    f""", hop as (select *, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) as hop from log where valid
       window w as (partition by scenario_id, agent_id order by step))
    select scenario_id, agent_id, {r('coalesce(sum(hop), 0)', 'distance')}, {r('max(sqrt(vx * vx + vy * vy))', 'max_speed')} from hop group by all""".replace("group by all", "group by scenario_id, agent_id"), "log"))
def _(spark, sf):
    return rounded(kin.track_stats(px.log(spark, sf)), "distance", "max_speed")


# ---------------------------------------------------------------- D1-D7 on speed and displacement

def edge_bin_sql(v: str, spec: lk.Histogram) -> str:
    hits = " + ".join(f"(case when {v} >= {e!r}::double then 1 else 0 end)" for e in spec.inner_edges())
    return f"case when {v} is not null then {hits} end"


@query("d01_displacement_error", px.with_views(
    f""", d as (select s.scenario_id, s.agent_id, s.rollout, l.valid, case when l.valid then sqrt(power(s.x - l.x, 2) + power(s.y - l.y, 2)) else 0 end as d
        from sim s join log l using (scenario_id, agent_id, step))
    , a as (select scenario_id, agent_id, rollout, sum(d) / greatest(count(*) filter (valid), 1) as ade from d group by scenario_id, agent_id, rollout)
    select scenario_id, agent_id, {r('avg(ade)', 'ade')}, {r('min(ade)', 'min_ade')} from a group by scenario_id, agent_id""", "sim"))
def _(spark, sf):
    log = px.log(spark, sf)
    return rounded(sc.displacement_error(px.sim(spark, sf, log), log), "ade", "min_ade")


def speed_sides(spark, sf):
    log = px.log(spark, sf)
    sim_k = kin.kinematics(px.sim(spark, sf, log)).withColumnRenamed("speed", SPEED.name)
    log_k = kin.kinematics(log.withColumn("rollout", F.lit(-1).cast("long"))).withColumnRenamed("speed", SPEED.name)
    return log_k, sim_k, log


def speed_ll_sql(per_step: bool) -> str:
    by = "scenario_id, agent_id" + (", step" if per_step else "")
    return f"""{KIN.format(src='(select *, -1 as rollout from log)').replace('kin', 'lkin')}{KIN.format(src='sim')}
, sb as (select {by}, {edge_bin_sql('speed', SPEED)} as b from kin)
, sc as (select {by}, b, count(*) as c from sb where b is not null group by {by}, b)
, st as (select {by}, count(b) as n from sb group by {by})
, lb as (select scenario_id, agent_id, step, {edge_bin_sql('speed', SPEED)} as b from lkin)
, ll as (select scenario_id, agent_id, step, case when lb.b is not null then ln((coalesce(c, 0) + 0.1e0) / (coalesce(n, 0) + 1.0e0)) end as ll
   from lb left join sc using ({by}, b) left join st using ({by}))"""


@query("d02_histogram_loglik", px.with_views(f"{speed_ll_sql(False)} select {IDS}, {r('ll', 'll')} from ll", "sim"))
def _(spark, sf):
    log_k, sim_k, _ = speed_sides(spark, sf)
    out = lk.histogram_loglik(log_k, sim_k, [SPEED], kin.LOG_KEYS)
    return out.select(*ID, r6("ll_linear_speed").alias("ll"))


@query("d03_histogram_loglik_per_step", px.with_views(f"{speed_ll_sql(True)} select {IDS}, {r('ll', 'll')} from ll", "sim"))
def _(spark, sf):
    log_k, sim_k, _ = speed_sides(spark, sf)
    out = lk.histogram_loglik(log_k, sim_k, [SPEED], kin.LOG_KEYS, per_step=True)
    return out.select(*ID, r6("ll_linear_speed").alias("ll"))


@query("d04_bernoulli_loglik", px.with_views(
    f""", f as (select scenario_id, agent_id, rollout, bool_or(y > 26.0e0) as far from sim group by scenario_id, agent_id, rollout)
    , n as (select scenario_id, agent_id, count(*) filter (far) as k, count(*) as n from f group by scenario_id, agent_id)
    , l as (select scenario_id, agent_id, bool_or(y > 26.0e0) as far from log group by scenario_id, agent_id)
    select scenario_id, agent_id, {r('ln((case when far then k else n - k end + 0.001e0) / (n + 0.002e0))', 'll')} from l join n using (scenario_id, agent_id)""", "sim"))
def _(spark, sf):
    log = px.log(spark, sf)
    far = F.bool_or(F.col("y") > 26.0)
    keys = kin.LOG_KEYS
    sims = px.sim(spark, sf, log).groupBy(*keys, "rollout").agg(far.alias("far")).groupBy(*keys).agg(
        F.count_if("far").alias("k"), F.count("*").alias("n"))
    out = log.groupBy(*keys).agg(far.alias("far")).join(sims, keys)
    return out.select(*keys, r6(lk.bernoulli_loglik(F.col("far"), F.col("k"), F.col("n"))).alias("ll"))


@query("d05_masked_mean", px.with_views(
    f"select scenario_id, agent_id, {r('avg(case when valid then y end)', 'mean_y')} from log group by scenario_id, agent_id", "log"))
def _(spark, sf):
    return px.log(spark, sf).groupBy(*kin.LOG_KEYS).agg(r6(lk.masked_mean(F.col("y"), F.col("valid"))).alias("mean_y"))


@query("d06_indication", px.with_views(
    f""", f as (select s.scenario_id, s.agent_id, s.rollout, bool_or(s.y > 24.0e0 and l.valid) as hit from sim s join log l using (scenario_id, agent_id, step)
         group by s.scenario_id, s.agent_id, s.rollout)
    select scenario_id, agent_id, {r('avg(case when hit then 1.0e0 else 0.0e0 end)', 'indication')} from f group by scenario_id, agent_id""", "sim"))
def _(spark, sf):
    log = px.log(spark, sf)
    joined = px.sim(spark, sf, log).join(log.select(*ID, "valid"), ID)
    return rounded(sc.indication(joined, F.col("y") > 24.0), "indication")


SPEED_SCORE_SQL = px.with_views(
    f"""{speed_ll_sql(False)}{VALID}
, am as (select scenario_id, agent_id, avg(case when speed_valid then ll end) as ll from ll join mask using (scenario_id, agent_id, step) group by scenario_id, agent_id)
select scenario_id, {r('exp(avg(ll))', 'likelihood_linear_speed')}, count(*) as num_agents from am group by scenario_id having avg(ll) is not null""", "sim")


@query("speed_realism", SPEED_SCORE_SQL)
def speed_realism(spark: SparkSession, sf: str) -> DataFrame:
    """The minimum end-to-end slice: speed, validity, pooled histogram likelihood, mean per scenario, exp."""
    log_k, sim_k, _ = speed_sides(spark, sf)
    masks = kin.kinematic_validity(log_k)
    ll = lk.histogram_loglik(masks, sim_k, [SPEED], kin.LOG_KEYS)
    agent = ll.groupBy(*kin.LOG_KEYS).agg(lk.masked_mean(F.col("ll_linear_speed"), F.col("speed_valid")).alias("ll"))
    return (
        agent.groupBy("scenario_id")
        .agg(r6(F.exp(F.avg("ll"))).alias("likelihood_linear_speed"), F.count("*").alias("num_agents"))
        .filter("likelihood_linear_speed is not null")
    )
