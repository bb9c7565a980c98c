"""Polyline simplification over road tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Triangle area, squared end distance, fewest points and largest raw type that are simplified.
AREA, SPAN, MIN_POINTS, MAX_RAW_TYPE = 0.1, 250.0, 10, 16


def thin(points: list, area: float = AREA, span: float = SPAN) -> list:
    """Drops middle points of nearly flat triples, in passes, until a pass drops nothing.

    A pass walks the points still alive; after a drop it continues from the far end of the triple.
    ``span`` limits the squared distance between the ends.
    """
    alive = list(points)
    while len(alive) >= 3:
        kept, i, changed = [], 0, False
        while i < len(alive):
            kept.append(alive[i])
            if i + 2 < len(alive):
                start, middle, end = (np.array([p["x"], p["y"]]) for p in alive[i : i + 3])
                chord, bend = end - start, middle - start
                # Half the cross product of two edge vectors is the triangle's area.
                if abs(chord[0] * bend[1] - chord[1] * bend[0]) < 2 * area and chord @ chord <= span:
                    i, changed = i + 2, True
                    continue
            i += 1
        alive = kept
        if not changed:
            break
    return alive


def simplify_roads(road: DataFrame, area: float = AREA, span: float = SPAN) -> DataFrame:
    """Roads with simplified ``pts``; short roads and other raw types pass through untouched.

    Each pass depends on the one before, so the point list of one road is handled by an Arrow UDF;
    roads are spread over all tasks.
    """

    @F.pandas_udf("array<struct<x:double,y:double,z:double>>")
    def simplified(pts: pd.Series) -> pd.Series:
        return pts.map(lambda p: thin(list(p), area, span))

    gate = (F.size("pts") > MIN_POINTS) & (F.col("raw_type") <= MAX_RAW_TYPE)
    # Only gated roads travel to Python.
    return road.filter(gate).withColumn("pts", simplified("pts")).unionByName(road.filter(~F.coalesce(gate, F.lit(False))))
