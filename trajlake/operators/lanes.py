"""Lane graph: successors, walks, poses at an arclength, goals, sampled points, link audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.operators.curation import hash_uniform
from trajlake.operators.egostate import arclength
from trajlake.operators.grid import box_join, cell_of, cover_cells, with_cell
from trajlake.operators.ordered import prefix_scan
from trajlake.session import cut_lineage

# Joining tolerance, tangent agreement, successors per lane, shortest lane.
JOIN_EPS, MIN_COS, MAX_SUCCESSORS, MIN_LENGTH = 0.5, 0.2588, 8, 1.0


def lane_points(points: DataFrame, by: list[str], order: str = "pt_idx") -> DataFrame:
    """Points with their cumulative arclength ``arc``."""
    return arclength(points, by, order)


def lane_table(points: DataFrame, by: list[str], order: str = "pt_idx") -> DataFrame:
    """One row per lane of at least 1 m: length, end points and unit tangents at both ends."""
    w = Window.partitionBy(*by).orderBy(order)
    arc = lane_points(points, by, order).withColumns({"_x2": F.lead("x").over(w), "_y2": F.lead("y").over(w), "_x0": F.lag("x").over(w), "_y0": F.lag("y").over(w)})
    ends = arc.groupBy(*by).agg(
        F.max("arc").alias("length"), F.count("*").alias("n"), F.min_by(F.struct("x", "y", "_x2", "_y2"), order).alias("_s"),
        F.max_by(F.struct("x", "y", "_x0", "_y0"), order).alias("_e"),
    ).filter((F.col("n") >= 2) & (F.col("length") >= MIN_LENGTH))

    def unit(ax, ay, bx, by_) -> tuple[Column, Column]:
        dx, dy = bx - ax, by_ - ay
        n = F.hypot(dx, dy)
        return F.when(n >= 1e-6, dx / n), F.when(n >= 1e-6, dy / n)

    sx, sy = unit(F.col("_s.x"), F.col("_s.y"), F.col("_s._x2"), F.col("_s._y2"))
    ex, ey = unit(F.col("_e._x0"), F.col("_e._y0"), F.col("_e.x"), F.col("_e.y"))
    return ends.select(
        *by, "length", F.col("_s.x").alias("sx"), F.col("_s.y").alias("sy"), sx.alias("stx"), sy.alias("sty"),
        F.col("_e.x").alias("ex"), F.col("_e.y").alias("ey"), ex.alias("etx"), ey.alias("ety"),
    )


def lane_successors(lane: DataFrame, on: list[str], lane_id: str = "lane_id") -> DataFrame:
    """Edges lane -> successor: the end of one meets the start of the other and the tangents agree.

    The end is registered in the few 0.5 m cells around it, so only touching lanes are ever paired.
    """
    ends = cover_cells(
        lane.filter("etx is not null"), F.col("ex") - JOIN_EPS, F.col("ex") + JOIN_EPS, F.col("ey") - JOIN_EPS, F.col("ey") + JOIN_EPS, JOIN_EPS
    ).select(*on, "cx", "cy", lane_id, "ex", "ey", "etx", "ety")
    starts = with_cell(lane.filter("stx is not null"), F.col("sx"), F.col("sy"), JOIN_EPS).select(
        *on, "cx", "cy", F.col(lane_id).alias("successor"), "sx", "sy", "stx", "sty"
    )
    dx, dy = F.col("sx") - F.col("ex"), F.col("sy") - F.col("ey")
    hits = ends.join(starts, [*on, "cx", "cy"]).filter(
        (F.col(lane_id) != F.col("successor")) & (dx * dx + dy * dy <= JOIN_EPS**2)
        & (F.col("etx") * F.col("stx") + F.col("ety") * F.col("sty") >= MIN_COS)
    )
    w = Window.partitionBy(*on, lane_id).orderBy("successor")
    return hits.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= MAX_SUCCESSORS).select(*on, lane_id, "successor")


def lane_walk(start: DataFrame, lane: DataFrame, edges: DataFrame, distance: float, on: list[str], key: list[str], seed: int = 0, max_hops: int = 64, every: int = 8) -> DataFrame:
    """Walks ``distance`` metres forward from (lane_id, s) over successors, choosing among them by a seeded hash.

    One relation of walkers, each with what it still has to go (``_left``, NULL once it stands), and one left join per
    hop with one row per lane, which lists the few successors of known length.  A walker whose lane has no known
    length stays where it is; at a dead end it stops at the end of its lane.  Every few hops the lineage is cut and
    those who stand leave the working set; the loop ends as soon as nobody moves.
    """
    lengths = lane.select(*on, "lane_id", "length")
    named = lengths.select(*on, F.col("lane_id").alias("successor"), F.col("length").alias("slen"))
    ways = edges.join(named, [*on, "successor"]).groupBy(*on, "lane_id").agg(F.sort_array(F.collect_list(F.struct("successor", "slen"))).alias("_ways"))
    ways = cut_lineage(lengths.join(ways, [*on, "lane_id"], "left"))
    cols = [*on, *key, "lane_id", "s", "travelled"]
    walkers, standing = start.withColumns({"travelled": F.lit(0.0), "_left": F.lit(float(distance))}), []
    for hop in range(max_hops + 1):
        at = walkers.join(ways, [*on, "lane_id"], "left")
        room = F.col("length") - F.col("s")
        step = F.when(F.col("_left").isNotNull() & room.isNotNull(), F.least("_left", room))  # NULL for walkers that stand and for unknown lanes
        count = F.lit(0) if hop == max_hops else F.coalesce(F.size("_ways"), F.lit(0))
        way = F.when((F.col("_left") > room) & (count > 0), F.get("_ways", F.floor(hash_uniform(*key, F.lit(seed), F.lit(hop)) * count).cast("int")))
        at = at.withColumns({"_step": step, "_way": way})
        walkers = at.select(
            *on, *key, F.coalesce("_way.successor", "lane_id").alias("lane_id"),
            F.when(F.col("_way").isNotNull(), F.lit(0.0)).otherwise(F.col("s") + F.coalesce("_step", F.lit(0.0))).alias("s"),
            (F.col("travelled") + F.coalesce("_step", F.lit(0.0))).alias("travelled"),
            F.when(F.col("_way").isNotNull(), F.col("_left") - F.col("_step")).alias("_left"),
        )
        if hop % every == every - 1 or hop in (0, max_hops):
            walkers = cut_lineage(walkers)
            standing.append(walkers.filter("_left is null").select(*cols))
            walkers = walkers.filter("_left is not null")
            if walkers.isEmpty():
                break
    out = standing[0]
    for part in [*standing[1:], walkers.select(*cols)]:
        out = out.unionByName(part)
    return out


def pose_at(query: DataFrame, points: DataFrame, by: list[str], bucket: float = 10.0) -> DataFrame:
    """x, y, heading at arclength ``s`` of a lane, by interpolation between the two points around it.

    Range join through arclength buckets: every piece is registered in the buckets it spans.
    """
    w = Window.partitionBy(*by).orderBy("arc")
    piece = points.select(
        *by, F.col("arc").alias("_a"), F.lead("arc").over(w).alias("_b"), F.col("x").alias("_x"), F.col("y").alias("_y"),
        F.lead("x").over(w).alias("_x1"), F.lead("y").over(w).alias("_y1"), F.row_number().over(w).alias("_i"),
    ).filter("_b > _a")
    top = F.max("_b").over(Window.partitionBy(*by))
    piece = piece.withColumn("_end", F.col("_b") == top)
    piece = piece.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_a") / bucket), F.floor(F.col("_b") / bucket))))
    q = query.withColumn("_k", F.floor(F.col("s") / bucket))
    p = piece.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate([*by, "_k"])], *[c for c in piece.columns if c not in (*by, "_k")])
    at = (F.col("s") >= F.col("_a")) & ((F.col("s") < F.col("_b")) | (F.col("_end") & (F.col("s") <= F.col("_b"))))
    for i, c in enumerate([*by, "_k"]):
        at = at & (F.col(c) == F.col(f"_p{i}"))
    j = q.join(p, at, "left")  # a row without a piece stays, without a pose
    f = (F.col("s") - F.col("_a")) / (F.col("_b") - F.col("_a"))
    return j.select(
        *query.columns, (F.col("_x") + f * (F.col("_x1") - F.col("_x"))).alias("x"), (F.col("_y") + f * (F.col("_y1") - F.col("_y"))).alias("y"),
        F.atan2(F.col("_y1") - F.col("_y"), F.col("_x1") - F.col("_x")).alias("heading"),
    )


def sample_goal(state: DataFrame, points: DataFrame, on: list[str], ids: list[str], target: float = 30.0, ring: float = 8.0, block: float = 32.0) -> DataFrame:
    """The lane point ahead whose distance is closest to ``target``; NULL when no lane point lies ahead.

    First the points whose distance is within ``ring`` of the target: a hit there cannot be beaten from outside.  Rows
    without one are held against their map's occupied blocks: bounds on a block's distances say which blocks can
    hold the answer, and only the points of those are looked at.
    """
    keep = list(dict.fromkeys([*ids, *on]))
    base = state.select(*keep, "x", "y", F.cos("heading").alias("hx"), F.sin("heading").alias("hy"))
    pts = points.select(*on, "polyline_id", "pt_idx", F.col("x").alias("px"), F.col("y").alias("py"))
    dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    ahead, error = dx * F.col("hx") + dy * F.col("hy") > 0, F.abs(F.hypot(dx, dy) - target)
    item = F.struct(error.alias("err"), "polyline_id", "pt_idx", "px", "py")
    reach = target + ring
    around = (F.col("x") - reach, F.col("x") + reach, F.col("y") - reach, F.col("y") + reach)
    met = box_join(base, pts, on, around, (F.col("px"), F.col("px"), F.col("py"), F.col("py")), 2 * reach).filter(ahead & (error <= ring))
    first = met.groupBy(*keep).agg(F.min(item).alias("_b"))
    first = cut_lineage(base.join(first, keep, "left"))

    blocks = pts.withColumns({"_bx": cell_of(F.col("px"), block), "_by": cell_of(F.col("py"), block)})
    bounds = blocks.groupBy(*on, "_bx", "_by").agg(F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"))
    open_ = first.filter("_b is null").drop("_b")
    seen = open_.join(bounds, on)
    corner = lambda a, b: (F.col(a) - F.col("x")) * F.col("hx") + (F.col(b) - F.col("y")) * F.col("hy")
    dots = [corner(a, b) for a in ("x0", "x1") for b in ("y0", "y1")]
    gap = lambda lo, hi, at: F.greatest(F.col(lo) - F.col(at), F.col(at) - F.col(hi), F.lit(0.0))
    wide = lambda lo, hi, at: F.greatest(F.abs(F.col(lo) - F.col(at)), F.abs(F.col(hi) - F.col(at)))
    seen = seen.withColumns({"_near": F.hypot(gap("x0", "x1", "x"), gap("y0", "y1", "y")), "_far": F.hypot(wide("x0", "x1", "x"), wide("y0", "y1", "y"))})
    seen = seen.filter(F.greatest(*dots) > 0).withColumns({
        "_least": F.greatest(F.col("_near") - target, target - F.col("_far"), F.lit(0.0)),
        "_most": F.when(F.least(*dots) > 0, F.greatest(F.abs(F.col("_near") - target), F.abs(F.col("_far") - target))),
    })
    best = F.min("_most").over(Window.partitionBy(*keep))
    slack = 1e-9  # bounds and distances round differently
    chosen = seen.withColumn("_best", best).filter(F.coalesce(F.col("_least") <= F.col("_best") + slack, F.lit(True)))
    rest = chosen.select(*open_.columns, "_bx", "_by").join(blocks, [*on, "_bx", "_by"]).filter(ahead)
    rest = rest.groupBy(*keep).agg(F.min(item).alias("_b"))
    out = first.filter("_b is not null").select(*keep, "_b").union(open_.join(rest, keep, "left").select(*keep, "_b"))
    return out.select(*keep, F.col("_b.px").alias("goal_x"), F.col("_b.py").alias("goal_y"))


def fallback_goal(found: DataFrame, initial: DataFrame, scene: list[str], order: str) -> DataFrame:
    """Rows without a goal take the initial goal of the next agent (cyclic) of their scene."""
    w = Window.partitionBy(*scene).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = initial.select(
        *scene, order, F.coalesce(F.lead("goal_x").over(w), F.first("goal_x").over(whole)).alias("_gx"),
        F.coalesce(F.lead("goal_y").over(w), F.first("goal_y").over(whole)).alias("_gy"),
    )
    return found.join(turn, [*scene, order], "left").withColumns(
        {"goal_x": F.coalesce("goal_x", "_gx"), "goal_y": F.coalesce("goal_y", "_gy")}
    ).drop("_gx", "_gy")


def link_audit(link: DataFrame) -> DataFrame:
    """Predecessor links (road_id, linked_id, kind) whose road does not list the origin in either direction."""
    back = link.select(F.col("linked_id").alias("road_id"), F.col("road_id").alias("linked_id"))
    return link.filter("kind = 'predecessor'").join(back, ["road_id", "linked_id"], "left_anti").select("road_id", "linked_id")


def sample_agents(n: int, types: DataFrame, rows: DataFrame, seed: int = 0) -> DataFrame:
    """n draws of a whole (length, width, height) row: type by cumulative probability, then a uniform row.

    ``types`` has object_type, prob, count; ``rows`` has object_type, row_idx and the sizes.  There is one
    probability row per object type (three in all), which is what is broadcast for the range condition.
    """
    cum = prefix_scan(types, [], ["object_type"], {"_hi": ("sum", F.col("prob"))}).withColumn("_lo", F.col("_hi") - F.col("prob"))
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), hash_uniform(F.col("id"), F.lit(seed)).alias("_u"), hash_uniform(F.col("id"), F.lit(seed + 1)).alias("_v"))
    top = cum.agg(F.max("_hi").alias("_top"))
    typed = draws.join(F.broadcast(top), F.lit(True)).withColumn("_u", F.col("_u") * F.col("_top"))
    typed = typed.join(F.broadcast(cum), (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    picked = typed.select("draw", "object_type", F.floor(F.col("_v") * F.col("count")).alias("row_idx"))
    return picked.join(rows, ["object_type", "row_idx"])


def sample_lane_points(lane: DataFrame, n: int, key: list[str], seed: int = 0, cell: float = 50.0) -> DataFrame:
    """n points uniform in arclength over all lanes: (draw, lane key, s).

    Lanes are laid end to end with a scan over the lane table; draws and lanes meet through buckets of
    that axis, so neither side is paired with the whole other side.
    """
    axis = prefix_scan(lane, [], key, {"_hi": ("sum", F.col("length"))}).withColumn("_lo", F.col("_hi") - F.col("length"))
    total = axis.agg(F.max("_hi").alias("_t"))
    draws = lane.sparkSession.range(n).select(F.col("id").alias("draw"), hash_uniform(F.col("id"), F.lit(seed)).alias("_u"))
    draws = draws.join(F.broadcast(total), F.lit(True)).withColumn("_p", F.col("_u") * F.col("_t")).withColumn("_c", cell_of(F.col("_p"), cell))
    spans = axis.withColumn("_c", F.explode(F.sequence(cell_of(F.col("_lo"), cell), cell_of(F.col("_hi"), cell))))
    hit = draws.join(spans, "_c").filter((F.col("_p") >= F.col("_lo")) & (F.col("_p") < F.col("_hi")))
    return hit.select("draw", *key, (F.col("_p") - F.col("_lo")).alias("s"))
