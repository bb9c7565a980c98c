"""Agent-to-agent operators: distances, time to collision, collisions, neighbour features.

All of them join agents that share (scenario, rollout, step) *and* a grid cell, so the number of
candidate pairs follows local density, not the size of a scenario.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions.geometry import (
    Box,
    boxes_overlap,
    circle_slack,
    is_following,
    signed_speed,
    with_box_distance,
    world_to_ego,
)
from trajlake.operators.grid import FEW, box_join, cover_cells, nearest_candidates, with_cell
from trajlake.session import cut_lineage

FRAME = ["scenario_id", "rollout", "step"]
FAR = 1e10
MAX_TTC = 5.0
_CELL_KEYS = ["cx", "cy"]


def _valid(state: DataFrame) -> DataFrame:
    return state.filter("valid") if "valid" in state.columns else state


def _boxes(state: DataFrame, frame: list[str], *extra: str) -> DataFrame:
    return state.select(
        *frame, "agent_id", "x", "y", "length", "width", F.cos("heading").alias("hx"), F.sin("heading").alias("hy"), *extra
    )


def _half_diagonal(alias: str | None = None) -> Column:
    p = f"{alias}." if alias else ""
    return F.hypot(F.col(f"{p}length"), F.col(f"{p}width")) / 2


def _renamed(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(f"o_{c}") for c in df.columns if c not in keep])


def _other() -> Box:
    return Box(*[F.col(f"o_{c}") for c in ("x", "y", "length", "width", "hx", "hy")])


def _bounds(prefix: str = "", more: Column | float = 0.0) -> tuple[Column, Column, Column, Column]:
    """Axis-aligned bounds (x0, x1, y0, y1) of a turned box, ``more`` metres wider on every side."""
    x, y, length, width, hx, hy = (F.col(prefix + c) for c in ("x", "y", "length", "width", "hx", "hy"))
    more = F.lit(more) if isinstance(more, float) else more
    ex, ey = (F.abs(hx) * length + F.abs(hy) * width) / 2 + more, (F.abs(hy) * length + F.abs(hx) * width) / 2 + more
    return x - ex, x + ex, y - ey, y + ey


def _scene_pairs(state: DataFrame, frame: list[str], few: int, *extra: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of scenes with at most ``few`` valid agents, each with all others of its scene; and the boxes of larger scenes, if any.

    A small scene is listed once in a window, which a state dealt by (part of) the frame runs without any shuffle.
    Larger scenes are few by their size; they are materialised for the spatial searches, which spread them.
    """
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in frame])
    target = whole & F.col("valid") if "valid" in state.columns else whole
    boxes = _boxes(state, frame, *extra, target.alias("_target"))
    large = boxes.filter("_target").groupBy(*frame).count().filter(F.col("count") > few).select(*frame)
    rest = None if large.isEmpty() else cut_lineage(boxes.join(large, frame, "left_semi"))
    scene = Window.partitionBy(*frame)
    counted = boxes.withColumn("_n", F.count_if("_target").over(scene)).filter(F.col("_n") <= few)
    item = F.struct(*[F.col(c).alias(f"o_{c}") for c in boxes.columns if c not in (*frame, "_target")])
    listed = counted.withColumn("_others", F.collect_list(F.when(F.col("_target"), item)).over(scene)).drop("_n", "_target")
    pairs = listed.select(*frame, *[c for c in listed.columns if c not in (*frame, "_others")], F.explode("_others").alias("_o"))
    return pairs.select(*[c for c in pairs.columns if c != "_o"], "_o.*").filter("agent_id <> o_agent_id"), rest


def _of_rest(rest: DataFrame, frame: list[str]) -> tuple[DataFrame, DataFrame]:
    """The boxes of large scenes and, renamed, those that count as others."""
    return rest.drop("_target"), _renamed(rest.filter("_target").drop("_target"), frame)


def pairwise_distances(state: DataFrame, max_range: float = 40.0, frame: list[str] = FRAME, few: int = FEW) -> DataFrame:
    """Signed box distance of every ordered pair of valid agents whose boxes are within ``max_range``.

    Scenes of at most ``few`` agents are compared in full.  The range is tested inside a generator: a filter would be
    moved below the steps of the distance as one expression that is too large to be compiled.
    """
    def search(boxes: DataFrame) -> DataFrame:
        return box_join(boxes, _renamed(boxes, frame), frame, _bounds(more=max_range), _bounds("o_"), 2 * max_range).filter("agent_id <> o_agent_id")

    if few:
        pairs, rest = _scene_pairs(_valid(state), frame, few)
        if rest is not None:
            pairs = pairs.unionByName(search(rest.drop("_target")))
    else:
        pairs = search(_boxes(_valid(state), frame))
    out = with_box_distance(pairs, Box.of(heading=False), _other(), "_d")
    within = F.explode(F.filter(F.array("_d"), lambda d: d <= max_range)).alias("distance")
    return out.select(*frame, "agent_id", F.col("o_agent_id").alias("other_id"), within)


def _with_reach(boxes: DataFrame, frame: list[str], cell: float) -> DataFrame:
    """Adds ``_reach``: a distance within which another valid box is known to be, or NULL if none is met.

    Agents of a cell of 4 * ``cell`` are lined up in strips; the three before and the three after each of them are met.
    A box holds the circle of its shorter side around its middle, and so does its shape with rounded corners.
    """
    across = lambda a, b: (a + b - F.abs(a - b)) / 2
    boxes = boxes.withColumn("_across", across(F.col("length"), F.col("width")))
    spot = F.when(F.col("_target") & F.col("hx").isNotNull() & F.col("hy").isNotNull(), F.struct("agent_id", "x", "y", "_across"))
    line = Window.partitionBy(*frame, *_CELL_KEYS).orderBy(F.floor(F.col("y") / (cell / 2)), "x", "agent_id")
    placed = with_cell(boxes, F.col("x"), F.col("y"), 4 * cell).withColumn("_spot", spot)
    met = {f"_met{i}": (F.lag if i < 0 else F.lead)("_spot", abs(i)).over(line) for i in (-3, -2, -1, 1, 2, 3)}

    def gap(o: Column) -> Column:
        dx, dy = o["x"] - F.col("x"), o["y"] - F.col("y")
        free = F.sqrt(dx * dx + dy * dy) - (F.col("_across") + o["_across"]) / 2
        # A little more than the bound itself, against rounding.
        return F.when((o["agent_id"] != F.col("agent_id")) & free.isNotNull(), F.greatest(free, F.lit(0.0)) + 1e-6)

    return placed.withColumns(met).select(*[c for c in boxes.columns if c != "_across"], F.least(*[gap(F.col(m)) for m in met]).alias("_reach"))


def nearest_object(state: DataFrame, frame: list[str] = FRAME, max_range: float | None = None, cell: float = 8.0, few: int = FEW) -> DataFrame:
    """Adds ``nearest_distance`` (signed, negative = overlap; NULL without another valid agent) to every row.

    With ``max_range`` farther neighbours read as NULL.  Scenes of at most ``few`` agents are listed and compared in
    full; 0 leaves all to the spatial search, where scenes are known to be large.  There, agents with others in their own
    cell are compared with what is not farther than those; only lonely agents need the search for the nearest.
    """
    def least(pairs: DataFrame, dealt: list[str] = []) -> DataFrame:
        pairs = with_box_distance(pairs.filter("agent_id <> o_agent_id"), Box.of(heading=False), _other(), "_d")
        return pairs.groupBy(*frame, *dealt, "agent_id").agg(F.min("_d").alias("nearest_distance")).drop(*dealt)

    def search(boxes: DataFrame, lone: int) -> DataFrame:
        points, targets = _of_rest(boxes, frame)
        if max_range is not None:
            return least(box_join(points, targets, frame, _bounds(more=max_range), _bounds("o_"), 2 * max_range))
        # Most agents have company: what can be nearer than a neighbour in the own cell touches the box grown by that distance.
        reached = _with_reach(boxes, frame, cell).drop("_target")
        close = reached.filter("_reach is not null")
        found = least(box_join(close, targets, frame, _bounds(more=F.col("_reach")), _bounds("o_"), 2 * cell).drop("_reach"))
        lonely = reached.filter("_reach is null").drop("_reach")
        return found.unionByName(nearest_candidates(lonely, targets, frame, ("o_x", "o_y"), _bounds("o_"), cell, _half_diagonal(), need=2, few=lone, finish=least))

    if few:
        pairs, rest = _scene_pairs(state, frame, few)
        found = least(pairs)
        if rest is not None:
            found = found.unionByName(search(rest, 0))
    else:
        target = F.col("valid") if "valid" in state.columns else F.lit(True)
        found = search(_boxes(state, frame, target.alias("_target")), FEW)
    if max_range is not None:
        found = found.filter(F.col("nearest_distance") <= max_range)
    return state.join(found, [*frame, "agent_id"], "left")


def _corridor_pairs(ego: DataFrame, other: DataFrame, frame: list[str], cell: float) -> DataFrame:
    """Each ego with the boxes that stand in the cells along its next five seconds of travel."""
    # The corridor in pieces of a cell's length, each with the bounds of its own turned rectangle.
    count = F.ceil(F.col("speed") * MAX_TTC / cell).cast("int")
    pieces = ego.filter(F.col("speed") > 0).withColumn("_piece", F.explode(F.sequence(F.lit(0), count - 1)))
    middle = F.col("length") / 2 + (F.col("_piece") + 0.5) * cell
    long, wide = F.lit(cell / 2), F.col("width") / 2
    ex, ey = F.abs(F.col("hx")) * long + F.abs(F.col("hy")) * wide, F.abs(F.col("hy")) * long + F.abs(F.col("hx")) * wide
    mx, my = F.col("x") + middle * F.col("hx"), F.col("y") + middle * F.col("hy")
    # A box whose projections overlap the corridor reaches it within half its length plus half its width.
    r = (F.col("o_length") + F.col("o_width")) / 2
    theirs = (F.col("o_x") - r, F.col("o_x") + r, F.col("o_y") - r, F.col("o_y") + r)
    return box_join(pieces, other, frame, (mx - ex, mx + ex, my - ey, my + ey), theirs, cell).filter(F.col("agent_id") != F.col("o_agent_id")).drop("_piece")


def time_to_collision(state: DataFrame, frame: list[str] = FRAME, cell: float = 32.0, wrap_yaw: bool = False, few: int = FEW) -> DataFrame:
    """Adds ``ttc``: seconds to the followed box, capped at five; needs ``speed`` and valid others.

    Scenes of at most ``few`` agents are compared in full.  Elsewhere, only boxes closer than five seconds of own travel
    can change the result, so each ego walks along its corridor in pieces of one cell and meets the boxes that stand in
    the cells of a piece.  Rows grow with speed, for any heading.
    """
    if few:
        pairs, rest = _scene_pairs(state, frame, few, "heading", "speed")
        if rest is not None:
            pairs = pairs.unionByName(_corridor_pairs(*_of_rest(rest, frame), frame, cell))
    else:
        other = _renamed(_boxes(_valid(state), frame, "heading", "speed"), frame)
        pairs = _corridor_pairs(_boxes(state, frame, "heading", "speed"), other, frame, cell)
    longitudinal, lateral, yaw = _ahead(lambda c: F.col(f"o_{c}"), wrap_yaw)
    followed = (
        pairs.withColumns({"_long": longitudinal, "_lat": lateral, "_yaw": yaw})
        .filter(is_following(F.col("_long"), F.col("_lat"), F.col("_yaw")))
        .groupBy(*frame, "agent_id")
        .agg(F.min(F.struct("_long", "o_agent_id", "o_speed")).alias("_ahead"))
    )
    return state.join(followed, [*frame, "agent_id"], "left").withColumn("ttc", _capped()).drop("_ahead")


def _ahead(other: Callable[[str], Column], wrap_yaw: bool = False) -> tuple[Column, Column, Column]:
    """Longitudinal and lateral gap to the other box in the own frame, and the gap between the headings."""
    yaw = F.abs(other("heading") - F.col("heading"))
    if wrap_yaw:
        from trajlake.functions.geometry import wrap_angle

        yaw = F.abs(wrap_angle(other("heading") - F.col("heading")))
    c, s = F.abs(F.cos(yaw)), F.abs(F.sin(yaw))
    dx, dy = other("x") - F.col("x"), other("y") - F.col("y")
    ol, ow = other("length") / 2, other("width") / 2
    longitudinal = dx * F.col("hx") + dy * F.col("hy") - F.col("length") / 2 - (ol * c + ow * s)
    lateral = F.abs(dy * F.col("hx") - dx * F.col("hy")) - F.col("width") / 2 - (ol * s + ow * c)
    return longitudinal, lateral, yaw


def _capped() -> Column:
    """Seconds to the box ``_ahead``."""
    closing = F.col("speed") - F.col("_ahead.o_speed")
    return F.coalesce(F.when(closing > 0, F.least(F.col("_ahead._long") / closing, F.lit(MAX_TTC))), F.lit(MAX_TTC))


def nearest_and_collision(state: DataFrame, carry: list[str], frame: list[str] = FRAME, few: int = FEW) -> DataFrame:
    """(``frame``, agent_id, ``carry``, ttc, nearest_distance): both features of every row, without joining them back.

    Scenes of at most ``few`` agents are listed once; a state dealt by (part of) the frame needs no shuffle, as its other
    columns stand beside the list.  The box ahead is looked up inside the list; the distances are reduced by row.
    """
    key = [*frame, "agent_id"]
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in frame])
    target = whole & F.col("valid") if "valid" in state.columns else whole
    large = state.filter(target).groupBy(*frame).count().filter(F.col("count") > few).select(*frame)
    rest = None if large.isEmpty() else cut_lineage(state.join(large, frame, "left_semi"))

    boxes = state.select(*key, "x", "y", "length", "width", F.cos("heading").alias("hx"), F.sin("heading").alias("hy"), "heading", "speed", *carry, target.alias("_target"))
    scene = Window.partitionBy(*frame)
    item = F.struct(*[F.col(c).alias(f"o_{c}") for c in ("agent_id", "x", "y", "length", "width", "hx", "hy", "heading", "speed")])
    counted = boxes.withColumn("_n", F.count_if("_target").over(scene)).filter(F.col("_n") <= few)
    listed = counted.withColumn("_others", F.collect_list(F.when(F.col("_target"), item)).over(scene))
    listed = listed.withColumn("_others", F.filter("_others", lambda o: o["o_agent_id"] != F.col("agent_id")))

    def gaps(o: Column) -> Column:
        longitudinal, lateral, yaw = _ahead(lambda c: o[f"o_{c}"])
        return F.struct(longitudinal.alias("_long"), o["o_agent_id"].alias("o_agent_id"), o["o_speed"].alias("o_speed"), lateral.alias("_lat"), yaw.alias("_yaw"))

    def perhaps(o: Column) -> Column:
        """What every followed box meets, whichever way it is turned; spares the others the full look."""
        dx, dy, reach = o["o_x"] - F.col("x"), o["o_y"] - F.col("y"), F.abs(o["o_length"] / 2) + F.abs(o["o_width"] / 2)
        beside = F.abs(dy * F.col("hx") - dx * F.col("hy")) - F.col("width") / 2
        return (beside < reach) & (dx * F.col("hx") + dy * F.col("hy") - F.col("length") / 2 > -reach)

    ahead = F.array_min(F.filter(F.transform(F.filter("_others", perhaps), gaps), lambda g: is_following(g["_long"], g["_lat"], g["_yaw"])))
    listed = listed.withColumn("_ahead", ahead).withColumn("ttc", _capped())
    pairs = listed.select(*key, *carry, "ttc", "x", "y", "length", "width", "hx", "hy", F.explode_outer("_others").alias("_o"))
    pairs = with_box_distance(pairs.select(*[c for c in pairs.columns if c != "_o"], "_o.*"), Box.of(heading=False), _other(), "_d")
    out = pairs.groupBy(*key, *carry, "ttc").agg(F.min("_d").alias("nearest_distance"))
    if rest is not None:
        searched = time_to_collision(nearest_object(rest, frame, few=0), frame, few=0)
        out = out.unionByName(searched.select(*key, *carry, "ttc", "nearest_distance"))
    return out


def collision_partner(state: DataFrame, frame: list[str] = FRAME, reach: float = 15.0, pedestrian: int = 2, order: str = "agent_id") -> DataFrame:
    """Adds ``partner_id``: the first other agent within 15 m whose box overlaps.  Pedestrians are skipped.

    ``order`` names the column that tells who comes first (ids break ties), as the order in which agents are active.
    """
    active = _boxes(_valid(state).filter(F.col("object_type") != pedestrian), frame, F.col(order).alias("turn"))
    left = with_cell(active, F.col("x"), F.col("y"), reach)
    right = _renamed(
        cover_cells(active, F.col("x") - reach, F.col("x") + reach, F.col("y") - reach, F.col("y") + reach, reach),
        [*frame, *_CELL_KEYS],
    )
    dx, dy = F.col("o_x") - F.col("x"), F.col("o_y") - F.col("y")
    hits = (
        left.join(right, [*frame, *_CELL_KEYS])
        .filter((F.col("agent_id") != F.col("o_agent_id")) & (dx * dx + dy * dy <= reach * reach))
        .filter(boxes_overlap(Box.of(heading=False), _other()))
        .groupBy(*frame, "agent_id")
        .agg(F.min_by("o_agent_id", F.struct("o_turn", "o_agent_id")).alias("partner_id"))
    )
    return state.join(hits, [*frame, "agent_id"], "left")


def remove_bad_tracks(agent: DataFrame, state: DataFrame, scenario: str = "scenario_id") -> DataFrame:
    """Static agents that are the first collision partner of a controlled agent are removed from ``agent``.

    ``agent`` carries ``role`` in ('active', 'static', 'expert_static'); collisions are looked for over the log.
    """
    frame = [scenario, "step"]
    roles = agent.select(scenario, "agent_id", "role")
    hit = (
        collision_partner(state, frame)
        .filter("partner_id is not null")
        .join(roles.filter("role = 'active'"), [scenario, "agent_id"], "left_semi")
        .groupBy(scenario, "agent_id")
        .agg(F.min_by("partner_id", "step").alias("partner_id"))
        .select(scenario, F.col("partner_id").alias("agent_id"))
        .distinct()
    )
    bad = roles.filter("role <> 'active'").join(hit, [scenario, "agent_id"], "left_semi").select(scenario, "agent_id")
    return agent.join(bad, [scenario, "agent_id"], "left_anti")


def partner_features(state: DataFrame, k: int = 31, radius: float = 50.0, frame: list[str] = FRAME) -> DataFrame:
    """The ``k`` nearest agents within ``radius`` as ego-frame features, one row per (ego, slot).

    Slots beyond the last partner are simply absent; ``pad_slots`` makes the fixed-size array.
    """
    base = _boxes(_valid(state), frame, signed_speed(F.col("vx"), F.col("vy"), F.cos("heading"), F.sin("heading")).alias("speed"))
    left = with_cell(base, F.col("x"), F.col("y"), radius)
    right = _renamed(
        cover_cells(base, F.col("x") - radius, F.col("x") + radius, F.col("y") - radius, F.col("y") + radius, radius),
        [*frame, *_CELL_KEYS],
    )
    dx, dy = F.col("o_x") - F.col("x"), F.col("o_y") - F.col("y")
    d2 = dx * dx + dy * dy
    near = (
        left.join(right, [*frame, *_CELL_KEYS])
        .filter((F.col("agent_id") != F.col("o_agent_id")) & (d2 <= radius * radius))
        .withColumn("_d2", d2)
    )
    w = Window.partitionBy(*frame, "agent_id").orderBy("_d2", "o_agent_id")
    hx, hy = F.col("hx"), F.col("hy")
    # Observation scales (metres to network input, vehicle maxima, speed maximum).
    return (
        near.withColumn("slot", F.row_number().over(w))
        .filter(F.col("slot") <= k)
        .select(
            *frame, "agent_id", F.col("slot").cast("long").alias("slot"), F.col("o_agent_id").alias("partner_id"),
            ((dx * hx + dy * hy) * 0.02).alias("rel_x"),
            ((dy * hx - dx * hy) * 0.02).alias("rel_y"),
            (F.col("o_width") / 15.0).alias("width"),
            (F.col("o_length") / 30.0).alias("length"),
            (F.col("o_hx") * hx + F.col("o_hy") * hy).alias("cos_heading"),
            (F.col("o_hy") * hx - F.col("o_hx") * hy).alias("sin_heading"),
            (F.col("o_speed") / 100.0).alias("speed"),
        )
    )


def pad_slots(features: DataFrame, by: list[str], cols: list[str], k: int) -> DataFrame:
    """Slot rows to one zero-padded flat array per group; at most ``k`` rows per group reach the array."""
    item = F.struct(F.col("slot"), F.array(*cols).alias("v"))
    zeros = F.array(*[F.lit(0.0)] * len(cols))
    return (
        features.groupBy(*by)
        .agg(F.array_sort(F.collect_list(item)).alias("_s"))
        .select(*by, F.flatten(F.concat(F.transform("_s", lambda s: s["v"]), F.array_repeat(zeros, F.lit(k) - F.size("_s")))).alias("obs"))
    )


def crop_agents(frame: DataFrame, actors: DataFrame, on: list[str], radius: float = 220.0) -> DataFrame:
    """Actors within ``radius`` of the frame's ego at the same instant, in the ego frame.

    ``frame`` has ``on`` + ego_id, cx, cy, yaw; the join key includes a cell of the radius' size.
    """
    centre = frame.select(*on, "ego_id", F.col("cx").alias("ecx"), F.col("cy").alias("ecy"), "yaw")
    left = centre.withColumns({"_gx": F.floor(F.col("ecx") / radius).cast("long"), "_gy": F.floor(F.col("ecy") / radius).cast("long")})
    right = cover_cells(
        actors, F.col("x") - radius, F.col("x") + radius, F.col("y") - radius, F.col("y") + radius, radius
    ).withColumnsRenamed({"cx": "_gx", "cy": "_gy"})
    ex, ey = world_to_ego(F.col("x"), F.col("y"), F.col("ecx"), F.col("ecy"), F.col("yaw"))
    dx, dy = F.col("x") - F.col("ecx"), F.col("y") - F.col("ecy")
    return (
        left.join(right, [*on, "_gx", "_gy"])
        .filter((F.col("agent_id") != F.col("ego_id")) & (dx * dx + dy * dy <= radius * radius))
        .select(
            *on, "ego_id", "agent_id", ex.alias("ego_x"), ey.alias("ego_y"),
            F.cos(F.col("heading") - F.col("yaw")).alias("cos_heading"),
            F.sin(F.col("heading") - F.col("yaw")).alias("sin_heading"),
            "length", "width", "object_type",
        )
    )


def placement_pairs(agents: DataFrame, by: list[str], gap: float = 0.0) -> DataFrame:
    """Unordered pairs whose circumscribed circles intersect, with their slack and whether the boxes overlap.

    Each circle stands in the cells of its own square.
    """
    boxes = _boxes(agents, by)
    circle = lambda p, more: [F.col(f"{p}{c}") + s * (F.hypot(F.col(f"{p}length"), F.col(f"{p}width")) / 2 + more) for c in "xy" for s in (-1, 1)]
    pairs = box_join(boxes, _renamed(boxes, by), by, tuple(circle("", gap)), tuple(circle("o_", 0.0)), 8.0).filter(F.col("agent_id") < F.col("o_agent_id"))
    slack = circle_slack(Box.of(heading=False), _other(), gap)
    return pairs.select(
        *by, "agent_id", F.col("o_agent_id").alias("other_id"), slack.alias("slack"),
        boxes_overlap(Box.of(heading=False), _other()).alias("overlap"),
    ).filter(F.col("slack") < 0)
