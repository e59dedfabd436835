"""Convex hulls of groups of points, merged from hulls of their parts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import convex_hull

#: Corners that a task holds before it hands them on.
HELD = 200_000
POLYGON = "array<struct<x: double, y: double>>"


def _parts(key: str):
    """Each task's hull of every key, merged batch by batch: a group's points
    never meet in one place, only the corners of their hulls do."""

    def run(batches):
        held: dict = {}

        def corners():
            rows = [(k, x, y) for k, hull in held.items() for x, y in hull]
            return pd.DataFrame(rows, columns=[key, "x", "y"])

        for batch in batches:
            for name, rows in batch.groupby(key, sort=False):
                points = list(zip(rows.x.tolist(), rows.y.tolist()))
                held[name] = convex_hull(held.get(name, []) + points)
            if sum(map(len, held.values())) > HELD:
                yield corners()
                held.clear()
        yield corners()

    return run


def hulls(points: DataFrame, key: str) -> DataFrame:
    """key and polygon (counter-clockwise corners from the least x, none on a
    straight edge) of each key's points (x, y).  A single place is a polygon of
    one corner and points on a line one of two.  Rows with a null key or a
    coordinate that is null or not finite are left out."""
    known = points.where(f"{key} IS NOT NULL AND abs(x) < double('inf') AND abs(y) < double('inf')").select(
        F.col(key), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")
    )
    kind = known.schema[key].dataType.simpleString()
    parts = known.mapInPandas(_parts(key), f"{key} {kind}, x double, y double")

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        hull = convex_hull(list(zip(rows.x.tolist(), rows.y.tolist())))
        return pd.DataFrame({key: rows[key].iloc[:1].tolist(), "polygon": [[{"x": x, "y": y} for x, y in hull]]})

    return parts.groupBy(key).applyInPandas(whole, f"{key} {kind}, polygon {POLYGON}")


def regions(cameras: DataFrame, pairs: DataFrame) -> DataFrame:
    """cam_id and polygon in which each camera's pixels count: its ROI, or
    else the hull of its calibration points, beyond which a projection would
    extrapolate.  ``cameras``: cam_id, roi (array of (x, y); null or empty:
    none).  ``pairs``: cam_id, x, y.  Cameras with neither are left out."""
    own = F.when(F.size("roi") > 0, F.col("roi"))
    asked = cameras.where(own.isNull()).select("cam_id").distinct()
    hull = hulls(pairs.join(asked, "cam_id", "left_semi"), "cam_id").withColumnRenamed("polygon", "hull")
    return cameras.join(hull, "cam_id", "left").select("cam_id", F.coalesce(own, "hull").alias("polygon")).where("polygon IS NOT NULL")
