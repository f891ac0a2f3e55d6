"""Stitching of unordered survey lines into runs.

The order is found greedily from the line next to a given terminus, so each step depends on
all before it: one group per trail, a few thousand lines, with vectorised distances.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import EARTH_MILES
from waymark.operators.blocks import BLOCK_ROWS, block_of, ranked

#: A jump of more miles than this starts a new run.
BREAK_MILES = 2.0


def _miles(ends: np.ndarray, lon: float, lat: float) -> np.ndarray:
    y, x = np.radians(ends[:, 1]), np.radians(ends[:, 0])
    p, q = np.radians(lat), np.radians(lon)
    a = np.sin((y - p) / 2) ** 2 + np.cos(p) * np.cos(y) * np.sin((x - q) / 2) ** 2
    return 2 * EARTH_MILES * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


def order_lines(lines: list[list[tuple[float, float]]], terminus: tuple[float, float], break_miles: float = BREAK_MILES) -> list[list[tuple[float, float]]]:
    """Runs of [lon, lat] pairs; lines with fewer than two points are left out.

    The nearest free end goes next, a line's first end before its last and the lowest position
    before others on ties. The first point is dropped where a line continues a run.
    """
    lines = [x for x in lines if len(x) >= 2]
    if not lines:
        return []
    ends = np.array([p for x in lines for p in (x[0], x[-1])], dtype=float)
    free = np.ones(len(ends), dtype=bool)
    at, runs = terminus, []
    for _ in lines:
        d = np.where(free, _miles(ends, *at), np.inf)
        k = int(d.argmin())
        line = lines[k // 2] if k % 2 == 0 else lines[k // 2][::-1]
        free[k - k % 2 : k - k % 2 + 2] = False
        if runs and d[k] <= break_miles:
            runs[-1].extend(line[1:])
        else:
            runs.append(list(line))
        at = line[-1]
    return runs


def stitch(lines: DataFrame, terminus: tuple[float, float], break_miles: float = BREAK_MILES) -> DataFrame:
    """Vertices (trail_id, run_idx, vertex_idx, lon, lat) from (trail_id, ord, coords)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        runs = order_lines([[tuple(p) for p in c] for c in pdf["coords"] if c is not None], terminus, break_miles)
        rows = [(pdf["trail_id"].iloc[0], r, v, p[0], p[1]) for r, pts in enumerate(runs) for v, p in enumerate(pts)]
        return pd.DataFrame(rows, columns=["trail_id", "run_idx", "vertex_idx", "lon", "lat"])

    return lines.select("trail_id", "ord", "coords").groupBy("trail_id").applyInPandas(run, "trail_id string, run_idx int, vertex_idx int, lon double, lat double")


def concatenate(vertices: DataFrame, picks: list[int]) -> DataFrame:
    """One run from chosen segments (seg_idx) of each trail, in the order of picks; the first
    vertex of all but the first of them doubles the last of the one before and is left out."""
    place = F.array_position(F.array(*[F.lit(p) for p in picks]), F.col("seg_idx")).cast("long")
    kept = vertices.withColumn("place", place).where((F.col("place") > 0) & ((F.col("vertex_idx") > 0) | (F.col("place") == 1)))
    block = F.struct("place", block_of(F.col("vertex_idx"), BLOCK_ROWS).alias("b"))
    return ranked(kept, ["trail_id"], ["place", "vertex_idx"], block, "idx").select("trail_id", "idx", "lon", "lat")
