"""Planar geometry as Column expressions: no UDF, so everything folds into codegen."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wrap_angle(angle: Column) -> Column:
    """Angle in [-pi, pi); ``pmod`` because ``%`` keeps the dividend's sign."""
    return F.pmod(angle + pi, F.lit(2 * pi)) - pi


def rotate2d(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    c, s = F.cos(angle), F.sin(angle)
    return x * c - y * s, x * s + y * c


def world_to_ego(x: Column, y: Column, cx: Column, cy: Column, yaw: Column) -> tuple[Column, Column]:
    """x forward, y left of a vehicle at (cx, cy) heading along ``yaw``."""
    dx, dy, c, s = x - cx, y - cy, F.cos(yaw), F.sin(yaw)
    return dx * c + dy * s, dy * c - dx * s


def _at(pose: Column, row: int, col: int) -> Column:
    return F.element_at(pose, row * 4 + col + 1)


# Fixed value: rear axle to box centre of the recording platform, in metres.
AXLE_TO_CENTER = 1.44


def pose_yaw(pose: Column) -> Column:
    """Yaw of a row-major 4x4 pose."""
    return F.atan2(_at(pose, 1, 0), _at(pose, 0, 0))


def box_center(pose: Column, axle: float = AXLE_TO_CENTER) -> tuple[Column, Column]:
    yaw = pose_yaw(pose)
    return _at(pose, 0, 3) + F.cos(yaw) * axle, _at(pose, 1, 3) + F.sin(yaw) * axle


def global_to_vehicle(point, pose: Column, offset=(0.0, 0.0, 0.0), axle: float = AXLE_TO_CENTER):
    """Map-frame point into the vehicle frame (transpose of the rotation), then centred on the box."""
    d = [point[i] - offset[i] - _at(pose, i, 3) for i in range(3)]
    local = [sum((_at(pose, i, axis) * d[i] for i in range(1, 3)), _at(pose, 0, axis) * d[0]) for axis in range(3)]
    return local[0] - axle, local[1], local[2]


@dataclass(frozen=True)
class Box:
    """An oriented box; ``cos``/``sin`` may be precomputed columns so joins do not recompute them."""

    x: Column
    y: Column
    length: Column
    width: Column
    cos: Column
    sin: Column

    @classmethod
    def of(cls, alias: str | None = None, heading: bool = True) -> "Box":
        def col(name: str) -> Column:
            return F.col(f"{alias}.{name}" if alias else name)

        if heading:
            return cls(col("x"), col("y"), col("length"), col("width"), F.cos(col("heading")), F.sin(col("heading")))
        return cls(col("x"), col("y"), col("length"), col("width"), col("hx"), col("hy"))

    def corners(self) -> list[tuple[Column, Column]]:
        """Counter-clockwise from front-left... rear-left, rear-right, front-right."""
        out = []
        for sl, sw in ((1, 1), (-1, 1), (-1, -1), (1, -1)):
            u, v = self.length * (0.5 * sl), self.width * (0.5 * sw)
            out.append((self.x + u * self.cos - v * self.sin, self.y + u * self.sin + v * self.cos))
        return out

    def shrunk(self, by: Column) -> "Box":
        return Box(self.x, self.y, self.length - by * 2, self.width - by * 2, self.cos, self.sin)

    def distance_to(self, px: Column, py: Column) -> Column:
        """Distance from a point to the filled box, 0 inside."""
        dx, dy = px - self.x, py - self.y
        u = F.greatest(F.abs(dx * self.cos + dy * self.sin) - self.length / 2, F.lit(0.0))
        v = F.greatest(F.abs(dy * self.cos - dx * self.sin) - self.width / 2, F.lit(0.0))
        return F.sqrt(u * u + v * v)


def box_corners(box: Box) -> Column:
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in box.corners()])


def dot2(ax, ay, bx, by) -> Column:
    return ax * bx + ay * by


def cross2(ax, ay, bx, by) -> Column:
    return ax * by - ay * bx


def segments_intersect(p1, p2, q1, q2) -> Column:
    """Closed segment crossing; parallel segments never cross."""
    rx, ry = p2[0] - p1[0], p2[1] - p1[1]
    sx, sy = q2[0] - q1[0], q2[1] - q1[1]
    den = cross2(rx, ry, sx, sy)
    qx, qy = q1[0] - p1[0], q1[1] - p1[1]
    t, u = cross2(qx, qy, sx, sy) / den, cross2(qx, qy, rx, ry) / den
    near = (
        (F.greatest(p1[0], p2[0]) >= F.least(q1[0], q2[0]))
        & (F.greatest(q1[0], q2[0]) >= F.least(p1[0], p2[0]))
        & (F.greatest(p1[1], p2[1]) >= F.least(q1[1], q2[1]))
        & (F.greatest(q1[1], q2[1]) >= F.least(p1[1], p2[1]))
    )
    return F.when(near & (den != 0), (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)).otherwise(F.lit(False))


def axis_gaps(a: Box, b: Box) -> list[Column]:
    """Separation along each of the four box axes; all non-positive means overlap."""
    dx, dy = b.x - a.x, b.y - a.y
    c, s = F.abs(dot2(a.cos, a.sin, b.cos, b.sin)), F.abs(cross2(a.cos, a.sin, b.cos, b.sin))
    al, aw, bl, bw = a.length / 2, a.width / 2, b.length / 2, b.width / 2
    return [
        F.abs(dot2(dx, dy, a.cos, a.sin)) - al - (bl * c + bw * s),
        F.abs(cross2(dx, dy, a.cos, a.sin)) - aw - (bl * s + bw * c),
        F.abs(dot2(dx, dy, b.cos, b.sin)) - bl - (al * c + aw * s),
        F.abs(cross2(dx, dy, b.cos, b.sin)) - bw - (al * s + aw * c),
    ]


def boxes_overlap(a: Box, b: Box) -> Column:
    """Separating-axis test; touching counts."""
    return reduce(lambda p, q: p & q, [gap <= 0 for gap in axis_gaps(a, b)])


def point_segment(px, py, x0, y0, x1, y1) -> tuple[Column, Column]:
    """(unclamped position along the segment, distance); a zero-length segment is a point."""
    sx, sy = x1 - x0, y1 - y0
    den = sx * sx + sy * sy
    t = F.when(den == 0, 0.0).otherwise(((px - x0) * sx + (py - y0) * sy) / den)
    c = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    ex, ey = px - x0 - c * sx, py - y0 - c * sy
    return t, F.sqrt(ex * ex + ey * ey)


def point_segment_distance(px, py, x0, y0, x1, y1) -> Column:
    return point_segment(px, py, x0, y0, x1, y1)[1]


def box_signed_distance(a: Box, b: Box, rounding: float = 0.7) -> Column:
    """Signed distance of two boxes with rounded corners; negative means overlap.

    Inside it is the largest axis gap.  Outside the closest feature pair of two convex boxes always
    involves a corner, so the eight corner-to-box distances are enough.
    """
    ra, rb = F.least(a.length, a.width) * (rounding / 2), F.least(b.length, b.width) * (rounding / 2)
    sa, sb = a.shrunk(ra), b.shrunk(rb)
    gap = F.greatest(*axis_gaps(sa, sb))
    apart = F.least(*[sb.distance_to(x, y) for x, y in sa.corners()], *[sa.distance_to(x, y) for x, y in sb.corners()])
    return F.when(gap <= 0, gap).otherwise(apart) - ra - rb


def with_box_distance(df: DataFrame, a: Box, b: Box, name: str, rounding: float = 0.7) -> DataFrame:
    """``box_signed_distance`` of every row (NULL where a box is missing), in small generated methods.

    Both boxes are expressed in each other's frame first; the corners of a centred box are then signed
    sums of two numbers.  Each step is its own projection over non-null inputs, because one large
    null-checking expression exceeds what the JVM compiles and then runs interpreted.
    """
    dx, dy = b.x - a.x, b.y - a.y
    raw = {
        "_c": dot2(a.cos, a.sin, b.cos, b.sin), "_s": cross2(a.cos, a.sin, b.cos, b.sin),
        "_ua": dot2(dx, dy, a.cos, a.sin), "_va": cross2(a.cos, a.sin, dx, dy),
        "_ub": dot2(dx, dy, b.cos, b.sin), "_vb": cross2(b.cos, b.sin, dx, dy),
        "_ra": F.least(a.length, a.width) * (rounding / 2), "_rb": F.least(b.length, b.width) * (rounding / 2),
        "_al": a.length / 2, "_aw": a.width / 2, "_bl": b.length / 2, "_bw": b.width / 2,
    }
    present = reduce(lambda p, q: p & q, [c.isNotNull() for c in (a.x, a.y, a.length, a.width, a.cos, b.x, b.y, b.length, b.width, b.cos)])
    out = df.withColumns({k: F.coalesce(c, F.lit(0.0)) for k, c in raw.items()} | {"_there": present})
    out = out.withColumns({k: F.col(k) - F.col(q) for k, q in (("_al", "_ra"), ("_aw", "_ra"), ("_bl", "_rb"), ("_bw", "_rb"))})
    c, s, al, aw, bl, bw = (F.col(k) for k in ("_c", "_s", "_al", "_aw", "_bl", "_bw"))
    out = out.withColumns(
        {"_blc": bl * c, "_bls": bl * s, "_bwc": bw * c, "_bws": bw * s, "_alc": al * c, "_als": al * s, "_awc": aw * c, "_aws": aw * s}
    )
    n = {k: F.col(f"_{k}") for k in ("blc", "bls", "bwc", "bws", "alc", "als", "awc", "aws", "ua", "va", "ub", "vb")}
    out = out.withColumn(
        "_gap",
        F.greatest(
            F.abs(n["ua"]) - al - F.abs(n["blc"]) - F.abs(n["bws"]), F.abs(n["va"]) - aw - F.abs(n["bls"]) - F.abs(n["bwc"]),
            F.abs(n["ub"]) - bl - F.abs(n["alc"]) - F.abs(n["aws"]), F.abs(n["vb"]) - bw - F.abs(n["als"]) - F.abs(n["awc"]),
        ),
    )
    # How far each corner lies beyond the other box along its two axes (negative inside).
    over: dict[str, Column] = {}
    for k, (i, j) in enumerate(((1, 1), (1, -1), (-1, 1), (-1, -1))):
        over[f"_p{k}"] = F.abs(n["ua"] + n["blc"] * i - n["bws"] * j) - al
        over[f"_q{k}"] = F.abs(n["va"] + n["bls"] * i + n["bwc"] * j) - aw
        # Seen from b, a is at minus the offset and turned the other way.
        over[f"_p{k + 4}"] = F.abs(n["alc"] * i + n["aws"] * j - n["ub"]) - bl
        over[f"_q{k + 4}"] = F.abs(n["awc"] * j - n["als"] * i - n["vb"]) - bw
    out = out.withColumns(over)
    # (t + |t|) is twice the positive part of t.
    doubled = {k: F.col(k) + F.abs(F.col(k)) for k in over}
    out = out.withColumns(doubled)
    square = {f"_d{k}": F.col(f"_p{k}") * F.col(f"_p{k}") + F.col(f"_q{k}") * F.col(f"_q{k}") for k in range(8)}
    out = out.withColumns(square)
    apart = F.sqrt(F.least(*[F.col(f"_d{k}") for k in range(8)])) / 2
    distance = F.when(F.col("_gap") <= 0, F.col("_gap")).otherwise(apart) - F.col("_ra") - F.col("_rb")
    return out.withColumn(name, F.when(F.col("_there"), distance)).drop(*[k for k in out.columns if k not in df.columns])


def aabb_overlap(a, b) -> Column:
    """Axis-aligned footprint overlap of (x, y, z, length, width, height); square footprint of the longer side."""
    def extents(box):
        half = F.greatest(box[3], box[4])
        return half, half, box[5]

    ea, eb = extents(a), extents(b)
    return reduce(lambda p, q: p & q, [F.abs(a[i] - b[i]) <= ea[i] + eb[i] for i in range(3)])


def circle_slack(a: Box, b: Box, gap: float = 1.5) -> Column:
    # Roots of sums of squares: correctly rounded steps are the same everywhere, hypot is not.
    def far(x: Column, y: Column) -> Column:
        return F.sqrt(x * x + y * y)

    return far(b.x - a.x, b.y - a.y) - (far(a.length, a.width) / 2 + far(b.length, b.width) / 2 + gap)


def angle_gap(a: Column, b: Column) -> Column:
    """|a - b| folded once into [0, pi], the way lane headings are compared."""
    d = F.abs(a - b)
    return F.when(d > pi, 2 * pi - d).otherwise(d)


def lane_aligned(heading: Column, seg_heading: Column, prev_heading: Column) -> Column:
    """Within 15 degrees of the plain (non-circular) mean of this and the previous segment heading."""
    mean = (seg_heading + F.coalesce(prev_heading, seg_heading)) / 2
    return angle_gap(heading, mean) < pi / 12


def signed_speed(vx, vy, hx, hy) -> Column:
    speed = F.sqrt(vx * vx + vy * vy)
    return F.when(dot2(vx, vy, hx, hy) < 0, -speed).otherwise(speed)


# What counts as following another vehicle.
FOLLOW_YAW = 75.0 * pi / 180.0
FOLLOW_SMALL_YAW = 10.0 * pi / 180.0
FOLLOW_SMALL_OVERLAP = -0.5


def is_following(longitudinal: Column, lateral: Column, yaw_gap: Column) -> Column:
    return (
        (longitudinal > 0)
        & (yaw_gap <= FOLLOW_YAW)
        & (lateral < 0)
        & ((lateral < FOLLOW_SMALL_OVERLAP) | (yaw_gap <= FOLLOW_SMALL_YAW))
    )


def within_radius(x: Column, y: Column, radius: float = 220.0) -> Column:
    return x * x + y * y <= radius * radius


def segment_in_square(x0, y0, x1, y1, radius: float) -> Column:
    """False only when the segment's bounding box lies entirely outside +-radius on some axis."""
    return (
        (F.least(x0, x1) <= radius)
        & (F.greatest(x0, x1) >= -radius)
        & (F.least(y0, y1) <= radius)
        & (F.greatest(y0, y1) >= -radius)
    )


def nondegenerate(length, width, height, floor: float = 0.1) -> Column:
    return (length > floor) & (width > floor) & (height > floor)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def all_finite(array: Column) -> Column:
    return F.forall(array, finite)
