"""Grid keys for spatial joins, joins of boxes, and exact nearest search with radii from a pyramid of occupied cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 5.0
FEW = 32


def cell_of(value: Column, size: float | Column) -> Column:
    return F.floor(value / size).cast("long")


def with_cell(df: DataFrame, x: Column, y: Column, size: float = CELL) -> DataFrame:
    return df.withColumns({"cx": cell_of(x, size), "cy": cell_of(y, size)})


def cover_cells(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column, size: float | Column) -> DataFrame:
    """One row per grid cell touched by the box [x0,x1] x [y0,y1]."""
    return df.withColumn("cx", F.explode(F.sequence(cell_of(x0, size), cell_of(x1, size)))).withColumn(
        "cy", F.explode(F.sequence(cell_of(y0, size), cell_of(y1, size)))
    )


def neighbor_cells(df: DataFrame, x: Column, y: Column, size: float = CELL, reach: int = 2) -> DataFrame:
    """One row per cell within ``reach`` cells of the own cell."""
    return cover_cells(df, x - reach * size, x + reach * size, y - reach * size, y + reach * size, size)


def spiral(reach: int = 2) -> list[tuple[int, int]]:
    """Cell offsets in the visiting order of a square spiral: right, up, left, down, growing outwards."""
    side = 2 * reach + 1
    out, x, y, heading, leg = [(0, 0)], 0, 0, 0, 1
    while len(out) < side * side:
        for _ in range(2):
            for _ in range(leg):
                x, y = x + (1, 0, -1, 0)[heading], y + (0, 1, 0, -1)[heading]
                if abs(x) <= reach and abs(y) <= reach:
                    out.append((x, y))
            heading = (heading + 1) % 4
        leg += 1
    return out[: side * side]


def box_join(
    left: DataFrame, right: DataFrame, on: list[str], lbox: tuple[Column, Column, Column, Column], rbox: tuple[Column, Column, Column, Column], size: float | Column
) -> DataFrame:
    """Pairs of rows with equal ``on`` whose boxes (x0, x1, y0, y1) touch, each pair once; other column names must differ.

    Every box stands in the cells that it covers itself, so one long vehicle costs its own few rows and sets nothing
    for the others.  A pair that shares several cells is taken where its common area begins.  ``size`` may be a column
    that both sides derive from ``on``.
    """
    edges = ("x0", "x1", "y0", "y1")
    l = left.withColumns({f"_l{e}": c for e, c in zip(edges, lbox, strict=True)})
    r = right.withColumns({f"_r{e}": c for e, c in zip(edges, rbox, strict=True)})
    l = cover_cells(l, *[F.col(f"_l{e}") for e in edges], size)
    r = cover_cells(r, *[F.col(f"_r{e}") for e in edges], size).withColumnsRenamed({k: f"_r_{k}" for k in (*on, "cx", "cy")})
    cond = (F.col("_lx0") <= F.col("_rx1")) & (F.col("_rx0") <= F.col("_lx1")) & (F.col("_ly0") <= F.col("_ry1")) & (F.col("_ry0") <= F.col("_ly1"))
    cond = cond & (F.col("cx") == cell_of(F.greatest("_lx0", "_rx0"), size)) & (F.col("cy") == cell_of(F.greatest("_ly0", "_ry0"), size))
    for k in (*on, "cx", "cy"):
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    return l.join(r, cond).drop("cx", "cy", *[f"_{side}{e}" for side in "lr" for e in edges], *[f"_r_{k}" for k in (*on, "cx", "cy")])


def _occupancy(anchors: DataFrame, scenes: DataFrame, on: list[str]) -> DataFrame:
    """(on, level, cx, cy, n): anchors in the three by three cells around each cell, at sizes that double from level to level."""
    counts = anchors.groupBy(*on, "cx", "cy").agg(F.count("*").alias("n"))
    levels = counts.join(scenes.select(*on, "top"), on).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top"))))
    own = levels.groupBy(*on, "level", F.expr("shiftright(cx, level)").alias("cx"), F.expr("shiftright(cy, level)").alias("cy")).agg(F.sum("n").alias("n"))
    steps = F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)])
    near = own.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    return near.groupBy(*on, "level", (F.col("cx") + F.col("_i")).alias("cx"), (F.col("cy") + F.col("_j")).alias("cy")).agg(F.sum("n").alias("n"))


def nearest_candidates(
    points: DataFrame, targets: DataFrame, on: list[str], anchor: tuple[str, str], box: tuple[Column, Column, Column, Column],
    cell: float, pad: Column | None = None, need: int = 1, few: int = FEW, finish: Callable[[DataFrame, list[str]], DataFrame] | None = None,
) -> DataFrame:
    """Every point (``on``, x, y) with all targets that could be its nearest, or with NULLs where its scene has none.

    In a scene of at most ``few`` targets those are all of them (0 where scenes are known to be large).  Elsewhere points are handled by the cell they lie in:
    a pyramid of occupied cells tells the smallest block around the cell that holds ``need`` targets, hence a ring that
    must hold them; the targets in that one ring give the cell a radius, and what touches it are the candidates.
    ``need`` is 2 where a point may be a target itself.  ``anchor`` names a coordinate of each target inside its ``box``,
    and ``pad`` is how far a point's own shape reaches.  The column names of both sides must differ but for ``on``.

    ``finish`` reduces the candidates of each point.  It is told columns (``cx``, ``cy`` or none) that a point's rows share and
    are dealt by, to group by them too: so the candidates are reduced where they meet, before any shuffle.
    """
    finish = finish or (lambda pairs, dealt: pairs.drop(*dealt))
    x, y = F.col("x"), F.col("y")
    scenes = _scenes(points, targets, on, anchor, cell)
    many = scenes.filter(F.col("_n") > few)
    if few:
        small = scenes.filter(F.col("_n") <= few).select(*on)
        all_of_them = points.join(small, on, "left_semi").join(targets, on, "left")
        points = points.join(many.select(*on), on, "left_semi")
    placed = with_cell(points, x, y, cell)
    near = _cell_candidates(placed, targets, many, on, anchor, box, cell, pad, need)
    by_cell = finish(placed.join(near, [*on, "cx", "cy"], "left"), ["cx", "cy"])
    return finish(all_of_them, []).unionByName(by_cell) if few else by_cell


def cell_candidates(
    placed: DataFrame, targets: DataFrame, on: list[str], anchor: tuple[str, str], box: tuple[Column, Column, Column, Column], cell: float, pad: Column
) -> DataFrame:
    """(``on``, cx, cy, the columns of a target): what could be nearest to any spot within ``pad`` / 2 of a point of the cell."""
    many = _scenes(placed, targets, on, anchor, cell).filter(F.col("_n") > 0)
    return _cell_candidates(placed, targets, many, on, anchor, box, cell, pad, 1)


def _scenes(points: DataFrame, targets: DataFrame, on: list[str], anchor: tuple[str, str], cell: float) -> DataFrame:
    """(``on``, _n, top): the targets of each scene, and the levels that its pyramid needs."""
    spots = targets.select(*on, F.col(anchor[0]).alias("x"), F.col(anchor[1]).alias("y"), F.lit(1).alias("_t"))
    scenes = points.select(*on, "x", "y", F.lit(0).alias("_t")).union(spots).groupBy(*on).agg(
        F.sum("_t").alias("_n"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("_span"))
    deep = F.greatest(F.ceil(F.log2(F.greatest(F.col("_span"), F.lit(cell)) / cell)), F.lit(0)).cast("int")
    return scenes.select(*on, "_n", deep.alias("top"))


def _cell_candidates(
    placed: DataFrame, targets: DataFrame, many: DataFrame, on: list[str], anchor: tuple[str, str], box: tuple[Column, Column, Column, Column],
    cell: float, pad: Column | None, need: int,
) -> DataFrame:
    """(``on``, cx, cy, the columns of a target) for the cells that hold points of the scenes in ``many``."""
    many = many.select(*on, "top")
    asked = placed.groupBy(*on, "cx", "cy").agg(F.max(F.lit(0.0) if pad is None else pad).alias("_pad"))
    around = _occupancy(with_cell(targets, F.col(anchor[0]), F.col(anchor[1]), cell), many, on)
    look = asked.join(many, on).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top"))))
    look = look.select(*on, F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), "_pad", "level", F.expr("shiftright(cx, level)").alias("cx"), F.expr("shiftright(cy, level)").alias("cy"))
    found = look.join(around.filter(F.col("n") >= need), [*on, "level", "cx", "cy"]).groupBy(*on, "_cx", "_cy", "_pad").agg(F.min("level").alias("level"))

    ring = F.lit(8.0**0.5 * cell) * F.pow(F.lit(2.0), F.col("level"))
    x0, y0 = F.col("_cx") * cell, F.col("_cy") * cell
    reach = F.col("_pad") + ring
    levels = targets.join(found.select(*on, "level").distinct(), on)
    near = box_join(found, levels, [*on, "level"], (x0 - reach, x0 + cell + reach, y0 - reach, y0 + cell + reach), box, 2 * ring)
    ax, ay = F.col(anchor[0]), F.col(anchor[1])
    far = F.hypot(F.greatest(ax - x0, x0 + cell - ax), F.greatest(ay - y0, y0 + cell - ay))
    apart = lambda lo, hi, at: F.greatest(lo - at - cell, at - hi, F.lit(0.0))
    near = near.withColumns({"_far": far, "_close": F.hypot(apart(box[0], box[1], x0), apart(box[2], box[3], y0))})
    own = Window.partitionBy(*on, "_cx", "_cy")
    near = near.withColumn("_rank", F.row_number().over(own.orderBy("_far"))).withColumn("_radius", F.max(F.when(F.col("_rank") <= need, F.col("_far"))).over(own))
    return near.filter(F.col("_close") <= F.col("_radius") + F.col("_pad")).select(*on, F.col("_cx").alias("cx"), F.col("_cy").alias("cy"), *[c for c in targets.columns if c not in on])
