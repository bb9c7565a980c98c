"""Road geometry: segments, nearest edge and lane, off-road flags, crops, boundaries, drivable cells."""

from __future__ import annotations

import math
from functools import reduce
from math import pi

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from trajlake.functions.geometry import (
    Box,
    angle_gap,
    cross2,
    lane_aligned,
    point_segment,
    point_segment_distance,
    segment_in_square,
    segments_intersect,
    world_to_ego,
    wrap_angle,
)
from trajlake.operators.grid import CELL, box_join, cell_candidates, cell_of, cover_cells, spiral, with_cell

# Road type codes.
LANE, LINE, EDGE, STOP_SIGN, CROSSWALK, SPEED_BUMP, DRIVEWAY = 4, 5, 6, 7, 8, 9, 10
LANE_AREA, YELLOW_EDGE = 11, 12
INVALID_DISTANCE = -1e10
_SEG = ["polyline_id", "seg_idx", "x0", "y0", "x1", "y1"]


def to_segments(points: DataFrame, by: list[str], order: str = "pt_idx", max_gap: float | None = None) -> DataFrame:
    """Ordered points of a polyline to segments; the segment's neighbours ride along so that later
    joins need no window.  Steps shorter than 1e-6 or longer than ``max_gap`` break the chain."""
    w = Window.partitionBy(*by).orderBy(order)
    ext = points.withColumns(
        {
            "x1": F.lead("x").over(w), "y1": F.lead("y").over(w),
            "xp": F.lag("x").over(w), "yp": F.lag("y").over(w),
            "x2": F.lead("x", 2).over(w), "y2": F.lead("y", 2).over(w),
        }
    ).withColumnsRenamed({"x": "x0", "y": "y0", order: "seg_idx"})
    out = ext.filter(F.col("x1").isNotNull())
    if max_gap is not None:
        length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
        out = out.filter((length >= 1e-6) & (length <= max_gap))
    return out


def close_seams(segments: DataFrame, by: list[str], tolerance: float = 1e-3) -> DataFrame:
    """On cyclic polylines the first and last segment become each other's neighbours.

    Aggregates one row per polyline and joins it back; polylines are short by nature and the first
    and last segment are found without collecting any of them.
    """
    ends = segments.groupBy(*by).agg(
        F.min_by(F.struct("x0", "y0", "x1", "y1"), "seg_idx").alias("_f"),
        F.max_by(F.struct("x0", "y0", "x1", "y1"), "seg_idx").alias("_l"),
        F.min("seg_idx").alias("_i0"),
        F.max("seg_idx").alias("_i1"),
    )
    cyclic = (F.abs(F.col("_f.x0") - F.col("_l.x1")) < tolerance) & (F.abs(F.col("_f.y0") - F.col("_l.y1")) < tolerance)
    first, last = cyclic & (F.col("seg_idx") == F.col("_i0")), cyclic & (F.col("seg_idx") == F.col("_i1"))
    return (
        segments.join(ends, by)
        .withColumn("xp", F.when(first, F.col("_l.x0")).otherwise(F.col("xp")))
        .withColumn("yp", F.when(first, F.col("_l.y0")).otherwise(F.col("yp")))
        .withColumn("x2", F.when(last, F.col("_f.x1")).otherwise(F.col("x2")))
        .withColumn("y2", F.when(last, F.col("_f.y1")).otherwise(F.col("y2")))
        .drop("_f", "_l", "_i0", "_i1")
    )


def _with_distance(pairs: DataFrame, px: str, py: str, name: str) -> DataFrame:
    """Adds the distance of a point to a segment row, in the steps of ``_with_signed_distance``."""
    zero = F.lit(0.0)
    raw = {"_sx": F.col("x1") - F.col("x0"), "_sy": F.col("y1") - F.col("y0"), "_ax": F.col(px) - F.col("x0"), "_ay": F.col(py) - F.col("y0")}
    out = pairs.withColumns({k: F.coalesce(c, zero) for k, c in raw.items()})
    sx, sy, ax, ay = (F.col(k) for k in raw)
    out = out.withColumns({"_square": sx * sx + sy * sy, "_along": ax * sx + ay * sy})
    out = out.withColumn("_t", F.when(F.col("_square") == 0, zero).otherwise(F.col("_along") / F.col("_square")))
    out = out.withColumn("_clamp", F.least(F.greatest("_t", zero), F.lit(1.0)))
    out = out.withColumns({"_ex": ax - F.col("_clamp") * sx, "_ey": ay - F.col("_clamp") * sy})
    return out.withColumn(name, F.sqrt(F.col("_ex") * F.col("_ex") + F.col("_ey") * F.col("_ey"))).drop(*raw, "_square", "_along", "_t", "_clamp", "_ex", "_ey")


def _with_signed_distance(pairs: DataFrame) -> DataFrame:
    """Adds ``_d`` and ``_s``, plain and signed distance (left of travel negative) of point px, py to a segment row.

    Past an end of the segment the side of the neighbouring segment decides together with whether the
    corner is convex; an open end keeps its own side.  Built in steps so each term is computed once.
    """
    zero = F.lit(0.0)
    raw = {
        "_sx": F.col("x1") - F.col("x0"), "_sy": F.col("y1") - F.col("y0"), "_ax": F.col("px") - F.col("x0"), "_ay": F.col("py") - F.col("y0"),
        "_bx": F.col("x0") - F.col("xp"), "_by": F.col("y0") - F.col("yp"), "_nx": F.col("x2") - F.col("x1"), "_ny": F.col("y2") - F.col("y1"),
    }
    # Non-null from here on keeps the generated code small enough to be compiled.
    out = pairs.withColumns({k: F.coalesce(c, zero) for k, c in raw.items()} | {"_open0": F.col("xp").isNull(), "_open1": F.col("x2").isNull()})
    sx, sy, ax, ay, bx, by, nx, ny = (F.col(k) for k in raw)
    out = out.withColumns({"_square": sx * sx + sy * sy, "_along": ax * sx + ay * sy, "_own": F.signum(cross2(ax, ay, sx, sy))})
    out = out.withColumn("_t", F.when(F.col("_square") == 0, zero).otherwise(F.col("_along") / F.col("_square")))
    t, own = F.col("_t"), F.col("_own")
    out = out.withColumns({"_clamp": F.least(F.greatest(t, zero), F.lit(1.0)), "_before": t < 0, "_after": t > 1})
    out = out.withColumns({"_ex": ax - F.col("_clamp") * sx, "_ey": ay - F.col("_clamp") * sy})
    # The neighbour that matters, if any: its side of the point and the way the corner turns.
    out = out.withColumns(
        {
            "_d": F.sqrt(F.col("_ex") * F.col("_ex") + F.col("_ey") * F.col("_ey")),
            "_far": F.when(F.col("_before"), cross2(ax + bx, ay + by, bx, by)).otherwise(cross2(ax - sx, ay - sy, nx, ny)),
            "_turn": F.when(F.col("_before"), cross2(bx, by, sx, sy)).otherwise(cross2(sx, sy, nx, ny)),
            "_alone": F.when(F.col("_before"), F.col("_open0")).when(F.col("_after"), F.col("_open1")).otherwise(F.lit(True)),
        }
    )
    side = F.signum("_far")
    out = out.withColumn(
        "_side", F.when(F.col("_alone"), own).when(F.col("_turn") > 0, F.greatest(own, side)).otherwise(F.least(own, side))
    )
    return out.withColumn("_s", F.col("_side") * F.col("_d"))


def _with_candidates(
    points: DataFrame, segments: DataFrame, on: list[str], radius: float, how: str = "left", pad: Column | None = None, dealt: bool = False
) -> DataFrame:
    """Each point with the segments whose bounding box comes within ``radius`` (plus ``pad``) of it.

    The static side is replicated to the cells around it, so the big side is looked up once per row.
    Cells of twice the radius keep that replication near four; the exact box test in the join condition
    drops the rest of the cell before anything is computed for a pair.  All pairs of a point meet in its own cell;
    with ``dealt`` that cell stays as ``cx``, ``cy``, so that they can be reduced there without a shuffle.
    """
    size = 2 * radius
    reach = F.lit(radius) if pad is None else pad + radius
    left = with_cell(points, F.col("x"), F.col("y"), size)
    lo_x, hi_x = F.least("x0", "x1") - reach, F.greatest("x0", "x1") + reach
    lo_y, hi_y = F.least("y0", "y1") - reach, F.greatest("y0", "y1") + reach
    right = segments.withColumns({"_lx": lo_x, "_hx": hi_x, "_ly": lo_y, "_hy": hi_y})
    right = cover_cells(right, F.col("_lx"), F.col("_hx"), F.col("_ly"), F.col("_hy"), size).withColumnsRenamed(
        {k: f"r_{k}" for k in on} | {"cx": "r_cx", "cy": "r_cy"}
    )
    cond = (F.col("cx") == F.col("r_cx")) & (F.col("cy") == F.col("r_cy"))
    for k in on:
        cond = cond & (F.col(k) == F.col(f"r_{k}"))
    cond = cond & F.col("x").between(F.col("_lx"), F.col("_hx")) & F.col("y").between(F.col("_ly"), F.col("_hy"))
    out = left.join(right, cond, how).drop("r_cx", "r_cy", "_lx", "_hx", "_ly", "_hy", *[f"r_{k}" for k in on])
    return out if dealt else out.drop("cx", "cy")


def road_edge_distance(
    state: DataFrame, edges: DataFrame, on: list[str] = ["scenario_id"], ids: list[str] = ["scenario_id", "agent_id", "rollout", "step"],
    cell: float = 4.0, tolerance: float | None = 1e-3,
) -> DataFrame:
    """Adds ``road_edge_distance``: the largest signed corner distance to its nearest edge segment.

    NULL where the map has no edge; positive means off-road.  Polylines whose ends meet within ``tolerance`` are closed,
    so that the segments at their seam know each other; ``None`` leaves them open.
    """
    best = edge_distances(state, edges, on, list(dict.fromkeys([*ids, *on])), cell, tolerance).filter("road_edge_distance is not null")
    return state.join(best.groupBy(*ids).agg(F.max("road_edge_distance").alias("road_edge_distance")), ids, "left")


def edge_distances(
    state: DataFrame, edges: DataFrame, on: list[str], keep: list[str], cell: float = 4.0, tolerance: float | None = 1e-3
) -> DataFrame:
    """(``keep``, road_edge_distance) for each row of ``state``; ``keep`` holds ``on`` and tells the rows apart.

    A row is dealt once, by the cell of its middle, where it meets the segments that may be nearest to any of its corners.
    The least distances come first, as plain numbers that are reduced without a sort; only the segments that reach them,
    one or two for each corner, are ranked by their names and get a side.
    """
    if tolerance is not None:
        edges = close_seams(edges, [*on, "polyline_id"], tolerance)
    pose = state.select(*keep, "x", "y", "length", "width", F.cos("heading").alias("hx"), F.sin("heading").alias("hy"))
    placed = with_cell(pose, F.col("x"), F.col("y"), cell)
    place = [*on, "cx", "cy"]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in place])
    nowhere = placed.filter(~known).select(*keep, F.lit(None).cast("double").alias("road_edge_distance"))
    placed = placed.filter(known)

    segs = edges.select(*on, *_SEG, "xp", "yp", "x2", "y2")
    bounds = (F.least("x0", "x1"), F.greatest("x0", "x1"), F.least("y0", "y1"), F.greatest("y0", "y1"))
    across = F.coalesce(F.hypot("length", "width"), F.lit(0.0))
    near = cell_candidates(placed, segs, on, ("x0", "y0"), bounds, cell, across)
    corners = range(4)

    def measured(rows: DataFrame) -> DataFrame:
        """``rows`` with their segments: corners ``_p`` and distances ``_d``, NULL without a segment or a corner."""
        at = {f"_p{i}{a}": c for i, corner in enumerate(Box.of(heading=False).corners()) for a, c in zip("xy", corner, strict=True)}
        out = rows.join(near, place, "left").withColumns(at)
        for i in corners:
            out = _with_distance(out, f"_p{i}x", f"_p{i}y", f"_d{i}")
        there = lambda i: F.col("polyline_id").isNotNull() & F.col(f"_p{i}x").isNotNull() & F.col(f"_p{i}y").isNotNull()
        return out.withColumns({f"_d{i}": F.when(there(i), F.col(f"_d{i}")) for i in corners})

    least = measured(placed).groupBy(*placed.columns).agg(*[F.min(f"_d{i}").alias(f"_m{i}") for i in corners])
    spot = lambda i: F.struct(F.lit(i).alias("corner"), F.col(f"_p{i}x").alias("px"), F.col(f"_p{i}y").alias("py"))
    hits = F.filter(F.array(*[F.when(F.col(f"_d{i}") == F.col(f"_m{i}"), spot(i)) for i in corners]), lambda h: h.isNotNull())
    none = reduce(lambda a, b: a & b, [F.col(f"_m{i}").isNull() for i in corners])
    # A row without any distance keeps an empty entry.
    reached = measured(least).withColumn("_hit", F.explode(F.when(none, F.array(F.lit(None).cast("struct<corner:int,px:double,py:double>"))).otherwise(hits)))
    row = list(dict.fromkeys([*keep, *place]))
    reached = reached.select(*row, *[c for c in segs.columns if c not in on], "_hit.*")
    item = F.when(F.col("corner").isNotNull(), F.struct("_d", "polyline_id", "seg_idx", "_s"))
    closest = _with_signed_distance(reached).groupBy(*row, "corner").agg(F.min(item).alias("_n"))
    best = closest.groupBy(*row).agg(F.max("_n._s").alias("road_edge_distance")).select(*keep, "road_edge_distance")
    return best.unionByName(nowhere)


# Distances that differ by less than this many metres may be in another order after another rounding.
NEAR_TIE = 1e-9


@F.pandas_udf(DoubleType())
def _root_of_powers(x: pd.Series, y: pd.Series) -> pd.Series:
    """sqrt(power(x, 2) + power(y, 2)) as SQL says it: the platform's ``pow`` is not always the rounded product."""
    return pd.Series([math.sqrt(math.pow(a, 2.0) + math.pow(b, 2.0)) for a, b in zip(x, y, strict=True)], dtype="float64")


def nearest_lane(
    state: DataFrame, lanes: DataFrame, on: list[str] = ["scenario_id"], ids: list[str] = ["scenario_id", "agent_id", "rollout", "step"],
    radius: float = 12.5,
) -> DataFrame:
    """Adds the closest lane segment by distance plus a 3 m penalty beyond 30 degrees of heading error.

    lane_distance is the plain distance to any lane; lane_id, lane_valid (within 4 m) and lane_aligned
    follow the penalised choice; lateral_offset (left positive) and heading_error are its Frenet pair.
    ``radius`` is the horizon of the operator: lanes beyond it do not count, by definition.

    Segments that meet at a vertex are equally far but for the last bit, which decides their order: pairs within
    ``NEAR_TIE`` of a point's best, about one for each point, are ranked by the distance with powers.
    """
    keep = list(dict.fromkeys([*ids, *on]))
    points = state.select(*keep, "x", "y", "heading")
    segs = lanes.select(*on, *_SEG, "xp", "yp")
    pairs = _with_candidates(points, segs, on, radius, dealt=True)
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    t, dist = point_segment(F.col("x"), F.col("y"), x0, y0, x1, y1)
    seg_heading = F.atan2(y1 - y0, x1 - x0)
    extra = F.when(angle_gap(F.col("_h"), F.col("heading")) > pi / 6, 3.0).otherwise(0.0)
    ranked = pairs.withColumns({"_d": dist, "_h": seg_heading}).withColumn("_extra", extra)
    own = Window.partitionBy(*points.columns, "cx", "cy")
    sure = F.col("_d") <= radius - NEAR_TIE
    ranked = ranked.withColumns({"_low": F.min(F.when(sure, F.col("_d") + F.col("_extra"))).over(own), "_near": F.min(F.when(sure, F.col("_d"))).over(own)})
    close = (F.col("_d") <= radius + NEAR_TIE) & (F.col("_d") + F.col("_extra") <= F.col("_low") + NEAR_TIE)
    ranked = ranked.filter(F.col("_low").isNull() | close)
    along = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    ranked = ranked.withColumn("_root", _root_of_powers(F.col("x") - x0 - along * (x1 - x0), F.col("y") - y0 - along * (y1 - y0)))
    length = F.hypot(x1 - x0, y1 - y0)
    item = F.struct(
        (F.col("_root") + F.col("_extra")).alias("_pen"), F.col("polyline_id"), F.col("seg_idx"), F.col("_h"),
        F.when(F.col("xp").isNotNull(), F.atan2(y0 - F.col("yp"), x0 - F.col("xp"))).alias("_ph"), length.alias("len"),
        (((x1 - x0) * (F.col("y") - y0) - (y1 - y0) * (F.col("x") - x0)) / length).alias("lat"),
    )
    inside = F.col("_root") <= radius
    best = ranked.groupBy(*points.columns, "cx", "cy").agg(
        F.min(F.when(inside, item)).alias("_b"), F.least(F.min("_near"), F.min(F.when(inside, F.col("_root")))).alias("lane_distance")
    )
    near = F.coalesce(F.col("_b._pen") <= 4.0, F.lit(False))
    solid = F.coalesce(F.col("_b.len") > 1e-6, F.lit(False))
    out = best.select(
        *ids,
        "lane_distance",
        F.when(near, F.col("_b.polyline_id")).alias("lane_id"),
        (near & solid).alias("lane_valid"),
        F.coalesce(near & lane_aligned(F.col("heading"), F.col("_b._h"), F.col("_b._ph")), F.lit(False)).alias("lane_aligned"),
        F.when(solid, F.col("_b.lat")).alias("lateral_offset"),
        F.when(solid, wrap_angle(F.col("heading") - F.col("_b._h"))).alias("heading_error"),
    )
    return state.join(out, ids)


def offroad_flags(
    state: DataFrame, edges: DataFrame, on: list[str] = ["scenario_id"], ids: list[str] = ["scenario_id", "agent_id", "rollout", "step"],
    pedestrian: int | None = 2, lanes: DataFrame | None = None, lane_width: float = 4.5,
) -> DataFrame:
    """Adds ``offroad``: a box edge crosses a road-edge segment (pedestrians exempt).

    With ``lanes`` the second definition is added: farther than half a lane width from every lane.
    """
    keep = list(dict.fromkeys([*ids, *on]))
    boxes = state.select(*keep, "x", "y", "length", "width", F.cos("heading").alias("hx"), F.sin("heading").alias("hy"), "object_type")
    movers = boxes if pedestrian is None else boxes.filter(F.col("object_type") != pedestrian)
    corners = Box.of(heading=False).corners()
    crossing = F.lit(False)
    for i in range(4):
        crossing = crossing | segments_intersect(corners[i], corners[(i + 1) % 4], (F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1")))
    xs, ys = F.array(*[c[0] for c in corners]), F.array(*[c[1] for c in corners])
    own = (F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys))
    theirs = (F.least("x0", "x1"), F.greatest("x0", "x1"), F.least("y0", "y1"), F.greatest("y0", "y1"))
    hits = box_join(movers, edges.select(*on, *_SEG), on, own, theirs, 8.0).filter(crossing).select(*ids).distinct()
    out = state.join(hits.withColumn("_hit", F.lit(True)), ids, "left").withColumn("offroad", F.coalesce("_hit", F.lit(False))).drop("_hit")
    if lanes is not None:
        near = _with_candidates(boxes, lanes.select(*on, *_SEG), on, lane_width / 2, "inner").filter(
            point_segment_distance(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")) <= lane_width / 2
        )
        covered = near.select(*ids).distinct().withColumn("_on", F.lit(True))
        out = out.join(covered, ids, "left").withColumn("offroad", F.col("offroad") | F.col("_on").isNull()).drop("_on")
    return out


def road_features(state: DataFrame, segments: DataFrame, on: list[str], ids: list[str], k: int = 128, reach: int = 2) -> DataFrame:
    """Up to ``k`` road segments from the 5 m cells around the ego in spiral order, in the ego frame.

    All egos of a cell see the same segments in the same order, so the first ``k`` are listed once per cell that holds an
    ego: the lists of the cells around it (no more than ``k`` of a cell can be among them), one after the other.  Segments
    are shuffled once, before they are multiplied; after that only lists travel.  ``state`` is read twice.
    """
    home, own = [*on, "gx", "gy"], [*on, "cx", "cy"]
    mid = segments.withColumns({"gx": cell_of((F.col("x0") + F.col("x1")) / 2, CELL), "gy": cell_of((F.col("y0") + F.col("y1")) / 2, CELL)})
    first = Window.partitionBy(*home).orderBy("polyline_id", "seg_idx")
    ranked = mid.select(*on, *_SEG, "road_type", "gx", "gy").withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= k)
    held = ranked.groupBy(*home).agg(F.array_sort(F.collect_list(F.struct(*_SEG, "road_type"))).alias("_held"))

    keep = list(dict.fromkeys([*ids, *on]))
    ego = with_cell(state.select(*keep, "x", "y", F.cos("heading").alias("hx"), F.sin("heading").alias("hy")), F.col("x"), F.col("y"))
    offsets = F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx, dy in spiral(reach)])
    asked = ego.select(*own).distinct().select("*", F.posexplode(offsets).alias("ring", "off"))
    asked = asked.select(*own, "ring", (F.col("cx") + F.col("off.dx")).alias("gx"), (F.col("cy") + F.col("off.dy")).alias("gy"))
    rings = F.array_sort(F.collect_list(F.struct("ring", "_held")))
    listed = asked.join(held, home).groupBy(*own).agg(F.slice(F.flatten(rings["_held"]), 1, k).alias("_list"))
    seen = ego.join(listed, own).select(*keep, "x", "y", "hx", "hy", F.posexplode("_list").alias("_at", "_s"))
    seen = seen.select(*keep, "x", "y", "hx", "hy", (F.col("_at") + 1).cast("long").alias("slot"), "_s.*")
    seen = seen.withColumns({"mx": (F.col("x0") + F.col("x1")) / 2, "my": (F.col("y0") + F.col("y1")) / 2})
    hx, hy = F.col("hx"), F.col("hy")
    rx, ry = F.col("mx") - F.col("x"), F.col("my") - F.col("y")
    ex, ey = F.col("x1") - F.col("mx"), F.col("y1") - F.col("my")
    half = F.sqrt(ex * ex + ey * ey)
    ux, uy = F.when(half > 0, ex / half).otherwise(ex), F.when(half > 0, ey / half).otherwise(ey)
    # Observation scales.
    return seen.select(
        *ids, "slot", "polyline_id", "seg_idx",
        ((rx * hx + ry * hy) * 0.02).alias("rel_x"),
        ((ry * hx - rx * hy) * 0.02).alias("rel_y"),
        (half / 100.0).alias("length"),
        F.lit(0.1 / 100.0).alias("width"),
        (ux * hx + uy * hy).alias("cos_angle"),
        (uy * hx - ux * hy).alias("sin_angle"),
        (F.col("road_type") - 4.0).alias("type"),
    )


def prepare_roads(segments: DataFrame, lane_width: float = 4.5) -> DataFrame:
    """Consumer view of road segments: painted features with fixed widths, edges retagged, lanes widened
    and extended at both ends, with ``draw_pass`` 0 before 1.  Rows already tagged are an error."""
    # Painted types and their widths.
    widths = {LINE: 0.15, EDGE: 0.25, CROSSWALK: 0.50, SPEED_BUMP: 0.40}
    kind = F.col("road_type")
    tagged = F.when(
        kind.isin(LANE_AREA, YELLOW_EDGE), F.raise_error(F.lit("a road has a type that only this step may give")).cast("int")
    ).otherwise(kind)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    length = F.hypot(dx, dy)
    grow = F.when((kind == LANE) & (length > 1e-6), F.lit(lane_width * 0.5) / length).otherwise(0.0)
    width = F.when(kind == LANE, lane_width)
    for code, value in widths.items():
        width = width.when(kind == code, value)
    return (
        segments.withColumn("road_type", tagged)
        .filter(F.col("road_type").isin(LANE, *widths))
        .withColumns(
            {
                "x0": F.col("x0") - dx * grow, "y0": F.col("y0") - dy * grow,
                "x1": F.col("x1") + dx * grow, "y1": F.col("y1") + dy * grow,
                "width": width,
                "draw_pass": F.when(kind == LANE, 1).otherwise(0),
                "draw_type": F.when(kind == LANE, LANE_AREA).when(kind == EDGE, YELLOW_EDGE).otherwise(kind).cast("int"),
            }
        )
    )


def boundary_type(neighbour: Column, marking: Column) -> Column:
    """Edge (6), painted line (5) or nothing on one side of a lane."""
    # Markings that are an edge, and those without paint.
    marking = F.coalesce(marking, F.lit("NONE"))
    return (
        F.when(marking.isin("Curb", "Grass"), EDGE)
        .when(neighbour.isNull() | (neighbour != "Driving"), EDGE)
        .when(marking.isin("NONE", "Other"), None)
        .otherwise(LINE)
    )


def lane_boundaries(waypoint: DataFrame, by: list[str], max_gap: float = 3.0, quantum: float = 0.05) -> DataFrame:
    """Boundary segments of both lane sides; a boundary two lanes share is kept once (first wins).

    ``waypoint`` needs ``by`` (the lane), s, x, y, rx, ry (right vector), lane_width, is_junction and
    left_/right_ neighbour and marking.  The shared-edge key is a sorted pair of quantised endpoints.
    """
    half = F.col("lane_width") / 2
    sides = F.array(
        *[
            F.struct(
                F.lit(i).alias("side"),
                (F.col("x") + F.col("rx") * half * sign).alias("bx"),
                (F.col("y") + F.col("ry") * half * sign).alias("by"),
                F.when(~F.col("is_junction"), boundary_type(F.col(f"{name}_neighbour"), F.col(f"{name}_marking"))).alias("kind"),
            )
            for i, (name, sign) in enumerate((("left", -1.0), ("right", 1.0)))
        ]
    )
    pts = waypoint.select(*by, "s", F.explode(sides).alias("b")).select(*by, "s", "b.*")
    w = Window.partitionBy(*by, "side").orderBy("s")
    segs = pts.withColumns({"x1": F.lead("bx").over(w), "y1": F.lead("by").over(w), "_next": F.lead("kind").over(w)}).withColumnsRenamed(
        {"bx": "x0", "by": "y0"}
    )
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    segs = segs.filter((F.col("kind") == F.col("_next")) & (length >= 1e-6) & (length <= max_gap))
    ends = F.array_sort(
        F.array(
            F.struct(F.rint(F.col("x0") / quantum).alias("a"), F.rint(F.col("y0") / quantum).alias("b")),
            F.struct(F.rint(F.col("x1") / quantum).alias("a"), F.rint(F.col("y1") / quantum).alias("b")),
        )
    )
    # First wins by aggregation, not by a window, so a boundary repeated many times is reduced map-side.
    row = F.struct(*by, "side", "s", "x0", "y0", "x1", "y1")
    return segs.groupBy("kind", ends.alias("_key")).agg(F.min(row).alias("_r")).select("kind", "_r.*")


def close_rings(rings: DataFrame, pts: str = "pts") -> DataFrame:
    """Repeats the first point at the end of polygons that are not closed."""
    p = F.col(pts)
    return rings.withColumn(pts, F.when(F.element_at(p, 1) != F.element_at(p, -1), F.concat(p, F.slice(p, 1, 1))).otherwise(p))


def split_rings(pts: Column) -> Column:
    """One polygon list written flat, each polygon ending where its first point repeats, into rings.

    A fold over the list of a single map feature; what is left open at the end counts if it has over two points.
    """
    zero = F.struct(F.slice(F.array(pts), 1, 0).alias("rings"), F.slice(pts, 1, 0).alias("open"))

    def add(acc: Column, p: Column) -> Column:
        grown = F.concat(acc["open"], F.array(p))
        closes = (F.size(grown) > 2) & (p == F.element_at(grown, 1))
        return F.when(
            closes, F.struct(F.concat(acc["rings"], F.array(grown)).alias("rings"), F.slice(grown, 1, 0).alias("open"))
        ).otherwise(F.struct(acc["rings"].alias("rings"), grown.alias("open")))

    def finish(acc: Column) -> Column:
        return F.when(F.size(acc["open"]) > 2, F.concat(acc["rings"], F.array(acc["open"]))).otherwise(acc["rings"])

    return F.aggregate(pts, zero, add, finish)


def crop_roads(frame: DataFrame, roads: DataFrame, on: list[str], ids: list[str], radius: float) -> DataFrame:
    """Road segments around every frame in its ego frame, painted features before lanes.

    The square fits a circle of radius*sqrt(2), which sets the join cell.  The test is on a segment's
    bounding box in the ego frame, whose corners lie up to half a segment length off the segment.
    """
    reach = radius * 2**0.5
    keep = list(dict.fromkeys([*ids, *on]))
    slack = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 2
    pairs = _with_candidates(frame.select(*keep, "x", "y", "yaw"), roads.select(*on, *_SEG, "road_type"), on, reach, "inner", slack)
    ax, ay = world_to_ego(F.col("x0"), F.col("y0"), F.col("x"), F.col("y"), F.col("yaw"))
    bx, by = world_to_ego(F.col("x1"), F.col("y1"), F.col("x"), F.col("y"), F.col("yaw"))
    local = pairs.select(*ids, "polyline_id", "seg_idx", "road_type", ax.alias("ex0"), ay.alias("ey0"), bx.alias("ex1"), by.alias("ey1"))
    return local.filter(segment_in_square(F.col("ex0"), F.col("ey0"), F.col("ex1"), F.col("ey1"), radius)).withColumn(
        "draw_pass", F.when(F.col("road_type") == LANE, 1).otherwise(0)
    )


def nearest_lane_start(frame_road: DataFrame, ids: list[str]) -> DataFrame:
    """Distance from the ego to the nearest lane segment start, per frame."""
    return (
        frame_road.filter(F.col("road_type") == LANE)
        .groupBy(*ids)
        .agg(F.min(F.sqrt(F.col("ex0") * F.col("ex0") + F.col("ey0") * F.col("ey0"))).alias("lane_start_distance"))
    )


def stray_vehicles(frame_agent: DataFrame, frame_road: DataFrame, ids: list[str], threshold: float, vehicle: int = 1) -> DataFrame:
    """Per vehicle sighting whether it is farther than ``threshold`` from every lane of its own frame.

    A sighting only needs to know whether *some* lane lies within the threshold, so candidates come from
    cells of that size and no nearest search is needed.  Frames without a lane are skipped.
    """
    lanes = frame_road.filter(F.col("road_type") == LANE)
    seen = frame_agent.filter(F.col("object_type") == vehicle).join(lanes.select(*ids).distinct(), ids, "left_semi")
    near = (
        _with_candidates(
            seen.select(*ids, "agent_id", F.col("ego_x").alias("x"), F.col("ego_y").alias("y")),
            lanes.select(*ids, "polyline_id", "seg_idx", F.col("ex0").alias("x0"), F.col("ey0").alias("y0"), F.col("ex1").alias("x1"), F.col("ey1").alias("y1")),
            ids, max(threshold, 1.0), "inner",
        )
        .filter(point_segment_distance(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")) <= threshold)
        .select(*ids, "agent_id")
        .distinct()
        .withColumn("_near", F.lit(True))
    )
    return seen.join(near, [*ids, "agent_id"], "left").withColumn("stray", F.col("_near").isNull()).drop("_near")


def map_stats(points: DataFrame, by: list[str], road: str = "polyline_id") -> DataFrame:
    """Roads and points per map: count, maximum, minimum, total and mean points per road."""
    per_road = points.groupBy(*by, road).agg(F.count("*").alias("n"))
    return per_road.groupBy(*by).agg(
        F.count("*").alias("roads"), F.max("n").alias("max_points"), F.min("n").alias("min_points"),
        F.sum("n").alias("total_points"), F.avg("n").alias("mean_points"),
    )


def _row_of(value: Column, resolution: float) -> Column:
    """First raster row or column whose centre is at or beyond ``value``."""
    return F.ceil(value / resolution - 0.5).cast("long")


def _rows_between(df: DataFrame, low: Column, high: Column, resolution: float) -> DataFrame:
    """One row per raster row ``cy`` whose centre lies in [low, high]."""
    first, last = _row_of(low, resolution), F.floor(high / resolution - 0.5).cast("long")
    return df.filter(first <= last).withColumn("cy", F.explode(F.sequence(first, last)))


def lane_spans(lanes: DataFrame, by: list[str], resolution: float, half_width: float) -> DataFrame:
    """Spans (cy, lo, hi) of raster columns whose centres are within ``half_width`` of a segment, one per segment and row.

    What is near a segment is convex, so a raster row meets it in one interval: between the outermost points where
    the row's centre line cuts the two end discs and the sides of the strip between them.
    """
    rows = _rows_between(lanes, F.least("y0", "y1") - half_width, F.greatest("y0", "y1") + half_width, resolution)
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    rows = rows.withColumns({"_y": (F.col("cy") + 0.5) * resolution, "_len": F.hypot(x1 - x0, y1 - y0)})
    y, solid = F.col("_y"), F.col("_len") > 0
    rows = rows.withColumns({
        "_nx": F.when(solid, (y0 - y1) / F.col("_len") * half_width).otherwise(0.0), "_ny": F.when(solid, (x1 - x0) / F.col("_len") * half_width).otherwise(0.0),
        "_rest0": F.lit(half_width**2) - (y - y0) * (y - y0), "_rest1": F.lit(half_width**2) - (y - y1) * (y - y1),
    })
    nx, ny = F.col("_nx"), F.col("_ny")
    corners = [(x0 + nx, y0 + ny), (x1 + nx, y1 + ny), (x1 - nx, y1 - ny), (x0 - nx, y0 - ny)]
    rows = rows.withColumns({f"_{c}{i}": v for i, corner in enumerate(corners) for c, v in zip("pq", corner, strict=True)})
    steps = {f"_h{i}": F.when(F.col(f"_rest{i}") >= 0, F.sqrt(f"_rest{i}")) for i in (0, 1)}
    for i in range(4):
        ax, ay, bx, by_ = (F.col(f"_{c}{k}") for k in (i, (i + 1) % 4) for c in "pq")
        crosses = solid & (ay != by_) & (y >= F.least(ay, by_)) & (y <= F.greatest(ay, by_))
        steps[f"_e{i}"] = F.when(crosses, ax + (y - ay) / (by_ - ay) * (bx - ax))
    rows = rows.withColumns(steps)
    cuts = [F.col(f"_e{i}") for i in range(4)]
    lo = _row_of(F.least(x0 - F.col("_h0"), x1 - F.col("_h1"), *cuts), resolution)
    hi = F.floor(F.greatest(x0 + F.col("_h0"), x1 + F.col("_h1"), *cuts) / resolution - 0.5).cast("long")
    # Tested inside a generator: a filter would be moved below the steps and repeat them as one expression.
    some = F.filter(F.array(F.struct(lo.alias("lo"), hi.alias("hi"))), lambda s: s["lo"] <= s["hi"])
    return rows.select(*by, "cy", F.explode(some).alias("_s")).select(*by, "cy", "_s.lo", "_s.hi")


def polygon_spans(polygons: DataFrame, by: list[str], resolution: float) -> DataFrame:
    """Spans of cells whose centres lie in a polygon (``pts`` array of x, y) by the even-odd rule: a scan line per raster row."""
    p = polygons.filter(F.size("pts") >= 3)
    ys = F.transform("pts", lambda q: q["y"])
    rows = _rows_between(p.select(*by, "pts"), F.array_min(ys), F.array_max(ys), resolution).withColumn("_y", (F.col("cy") + 0.5) * resolution)
    turned = F.concat(F.slice("pts", 2, F.size("pts") - 1), F.slice("pts", 1, 1))
    y = F.col("_y")
    cut = F.zip_with("pts", turned, lambda a, b: F.when((a["y"] > y) != (b["y"] > y), (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]))
    rows = rows.withColumn("_x", F.array_sort(F.filter(cut, lambda x: x.isNotNull())))
    pairs = F.filter(F.transform("_x", lambda x, i: F.when(i % 2 == 0, F.struct(x.alias("a"), F.get("_x", i + 1).alias("b")))), lambda q: q.isNotNull())
    rows = rows.select(*by, "cy", F.explode(pairs).alias("q"))
    return rows.select(*by, "cy", _row_of(F.col("q.a"), resolution).alias("lo"), (_row_of(F.col("q.b"), resolution) - 1).alias("hi")).filter("lo <= hi")


def merged_spans(spans: DataFrame, by: list[str]) -> DataFrame:
    """The union of the spans of each raster row: touching and overlapping spans become one."""
    w = Window.partitionBy(*by, "cy").orderBy("lo", "hi")
    fresh = F.col("lo") > F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1
    marked = spans.withColumn("_fresh", F.coalesce(fresh, F.lit(True)).cast("int"))
    marked = marked.withColumn("_part", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "cy", "_part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_part")


def closed_spans(spans: DataFrame, by: list[str], reach: int) -> DataFrame:
    """Morphological closing of disjoint spans with a square of ``reach`` cells: union after growing, intersection after shrinking."""
    near = lambda df: df.withColumn("cy", F.explode(F.sequence(F.col("cy") - reach, F.col("cy") + reach)))
    grown = merged_spans(near(spans).withColumns({"lo": F.col("lo") - reach, "hi": F.col("hi") + reach}), by)
    # A cell stays where all rows around it hold it, shrunk: a sweep over starts and ends counts them.
    shrunk = near(grown.withColumns({"lo": F.col("lo") + reach, "hi": F.col("hi") - reach}).filter("lo <= hi"))
    ends = shrunk.select(*by, "cy", F.explode(F.array(F.struct(F.col("lo").alias("x"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("x"), F.lit(-1).alias("d")))).alias("e"))
    ends = ends.groupBy(*by, "cy", F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*by, "cy").orderBy("x")
    swept = ends.withColumns({"_held": F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.lead("x").over(w)})
    full = swept.filter(F.col("_held") == 2 * reach + 1).select(*by, "cy", F.col("x").alias("lo"), (F.col("_next") - 1).alias("hi"))
    return merged_spans(full, by)


def drivable_spans(
    segments: DataFrame, by: list[str], resolution: float = 0.5, half_width: float = 2.25, closing: float = 1.0,
    polygons: DataFrame | None = None,
) -> DataFrame:
    """Raster cells whose centre is within ``half_width`` of a lane (or inside a driveway polygon), closed by ``closing``,
    as disjoint spans (cy, lo, hi) of columns: rows grow with the outline, not with the area.
    """
    spans = lane_spans(segments.filter(F.col("road_type") == LANE).select(*by, "x0", "y0", "x1", "y1"), by, resolution, half_width)
    if polygons is not None:
        spans = spans.unionByName(polygon_spans(polygons, by, resolution))
    spans = merged_spans(spans, by)
    reach = int(round(closing / resolution))
    return closed_spans(spans, by, reach) if reach else spans


def drivable_cells(segments: DataFrame, by: list[str], **how) -> DataFrame:
    """The cells of ``drivable_spans``, one row each."""
    return drivable_spans(segments, by, **how).select(*by, F.explode(F.sequence("lo", "hi")).alias("cx"), "cy")


def coverage_share(spans: DataFrame, points: DataFrame, by: list[str], resolution: float = 0.5, margin: float = 10.0) -> DataFrame:
    """Drivable share of each map's padded bounding box, from ``drivable_spans``."""
    area = points.groupBy(*by).agg(
        (F.ceil((F.max("x") - F.min("x") + 2 * margin) / resolution) + 1).alias("w"),
        (F.ceil((F.max("y") - F.min("y") + 2 * margin) / resolution) + 1).alias("h"),
    )
    n = spans.groupBy(*by).agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n"))
    return area.join(n, by, "left").select(*by, F.coalesce("n", F.lit(0)).alias("cells"), (F.coalesce("n", F.lit(0)) / (F.col("w") * F.col("h"))).alias("share"))
