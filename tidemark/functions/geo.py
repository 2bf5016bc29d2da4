"""Distances as column expressions and grid cells for distance joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0
LAT_M = 110_570.0
LNG_M = 111_320.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def cosines_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Spherical law of cosines, clamped against rounding."""
    c = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lng2) - F.radians(lng1)) + F.sin(F.radians(lat1)) * F.sin(F.radians(lat2))
    return F.lit(EARTH_KM) * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def planar_m2(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Squared metres on a plane at the latitude of the first point."""
    return F.pow((lat2 - lat1) * LAT_M, 2) + F.pow((lng2 - lng1) * LNG_M * F.cos(F.radians(lat1)), 2)


def in_box(lat: Column, lng: Column, center: tuple[float, float], d_lat: float, d_lng: float) -> Column:
    """A bounding box as BETWEEN ranges, which parquet statistics can prune."""
    return lat.between(center[0] - d_lat, center[0] + d_lat) & lng.between(center[1] - d_lng, center[1] + d_lng)


def near_join(left: DataFrame, right: DataFrame, radius_m: float, left_at: tuple[str, str], right_at: tuple[str, str], distance: str = "m") -> DataFrame:
    """Pairs at most ``radius_m`` metres apart: an equi-join on grid cells of that size.

    The left side is copied to the nine cells around it, so only neighbours meet; no pair occurs twice. Put the smaller
    side left. Works below 75 degrees of latitude.
    """
    d_lat, d_lng = radius_m / LAT_M, radius_m / (LNG_M * 0.25)
    cell = lambda c, d: F.floor(c / F.lit(d)).cast("long")
    around = F.sequence(F.lit(-1), F.lit(1))
    l = left.withColumn("__y", F.explode(F.transform(around, lambda i: cell(F.col(left_at[0]), d_lat) + i)))  # noqa: E741
    l = l.withColumn("__x", F.explode(F.transform(around, lambda i: cell(F.col(left_at[1]), d_lng) + i)))  # noqa: E741
    r = right.withColumn("__y", cell(F.col(right_at[0]), d_lat)).withColumn("__x", cell(F.col(right_at[1]), d_lng))
    m2 = planar_m2(F.col(left_at[0]), F.col(left_at[1]), F.col(right_at[0]), F.col(right_at[1]))
    return l.join(r, ["__y", "__x"]).withColumn(distance, F.sqrt(m2)).where(F.col(distance) <= radius_m).drop("__y", "__x")


def shapes(edges: DataFrame, *columns: str, polygon: str = "polygon") -> DataFrame:
    """(polygon, columns..., sides, low_y, high_y, low_x, high_x): one row for each polygon of an edge table (polygon, y1, x1, y2, x2)."""
    sides = F.collect_list(F.struct("y1", "x1", "y2", "x2")).alias("sides")
    return edges.groupBy(polygon, *columns).agg(
        sides, F.min(F.least("y1", "y2")).alias("low_y"), F.max(F.greatest("y1", "y2")).alias("high_y"), F.min(F.least("x1", "x2")).alias("low_x"), F.max(F.greatest("x1", "x2")).alias("high_x")
    )


def inside(points: DataFrame, edges: DataFrame, at: tuple[str, str] = ("lat", "lng"), key: str = "id", polygon: str = "polygon", cell: float = 0.05) -> DataFrame:
    """(key, polygon): the polygons that hold each point, by the parity of sides crossed to the east.

    A column ``part`` of the edges tells the parts of a polygon apart, each with a box of its own. Points and boxes meet on grid cells of ``cell`` degrees, about the size of a polygon; only polygons whose
    box holds a point are tested against their sides, which travel as one array for each polygon.
    """
    y, x = F.col(at[0]), F.col(at[1])
    number = lambda c: F.floor(c / F.lit(cell)).cast("long")
    by = [polygon, *(c for c in ("part",) if c in edges.columns)]
    whole = shapes(edges, *by[1:], polygon=polygon)
    boxes = whole.drop("sides").withColumn("__y", F.explode(F.sequence(number(F.col("low_y")), number(F.col("high_y")))))
    boxes = boxes.withColumn("__x", F.explode(F.sequence(number(F.col("low_x")), number(F.col("high_x")))))
    placed = points.select(F.col(key), y.alias(at[0]), x.alias(at[1])).withColumn("__y", number(y)).withColumn("__x", number(x))
    near = placed.join(boxes, ["__y", "__x"]).where(y.between(F.col("low_y"), F.col("high_y")) & x.between(F.col("low_x"), F.col("high_x"))).select(key, *at, *by)

    def crossed(s: Column) -> Column:
        return ((s["y1"] > y) != (s["y2"] > y)) & (x < (s["x2"] - s["x1"]) * (y - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"])

    held = near.join(whole.select(*by, "sides"), by).where(F.size(F.filter("sides", crossed)) % 2 == 1).select(key, polygon)
    return held.distinct() if len(by) > 1 else held


def inside_or_nearest(points: DataFrame, edges: DataFrame, district: str, at: tuple[str, str] = ("lat", "lng"), key: str = "id", polygon: str = "polygon", cell: float = 0.05) -> DataFrame:
    """(key, polygon, found): the smallest polygon name that holds a point, else the one of its ``district`` with a box
    (of a part, where edges have parts) whose centre is nearest. ``edges`` has the district of each polygon as well; points of a district without polygons have no row."""
    held = inside(points, edges, at, key, polygon, cell).groupBy(key).agg(F.min(polygon).alias(polygon)).withColumn("found", F.lit("inside"))
    parts = [c for c in ("part",) if c in edges.columns]
    centres = shapes(edges, district, *parts, polygon=polygon).select(district, polygon, ((F.col("low_y") + F.col("high_y")) / 2).alias("cy"), ((F.col("low_x") + F.col("high_x")) / 2).alias("cx"))
    # the centres of a district travel as one array, so a point stays one row however many polygons its district has
    centres = centres.groupBy(F.col(district).alias("__of")).agg(F.collect_list(F.struct("cx", "cy", polygon)).alias("centres"))
    lost = points.join(held.select(key), key, "left_anti").join(centres, F.col(district) == F.col("__of"))
    far = lambda c: F.pow(c["cx"] - F.col(at[1]), 2) + F.pow(c["cy"] - F.col(at[0]), 2)
    best = F.array_min(F.transform("centres", lambda c: F.struct(far(c).alias("far"), c[polygon].alias("polygon"))))
    nearest = lost.select(key, best["polygon"].alias(polygon), F.lit("nearest").alias("found"))
    return held.unionByName(nearest)
