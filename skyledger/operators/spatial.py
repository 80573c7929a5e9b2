"""Searches of the nearest point by cells of latitude and longitude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import geo
from skyledger.session import stage_table

c = F.col
#: Widths of cells in degrees, each a whole part of 360; at the last, all points are in reach.
WIDTHS = (1 / 256, 1 / 64, 1 / 16, 0.25, 1.0, 4.0, 15.0, 60.0, 360.0)
#: Points about a state at which narrower cells are not worth their step.
FEW_POINTS = 32


def squared_degrees(wrapped: bool = True) -> Column:
    """The squared distance of a point ``(wlat, wlon)`` from a state ``(lat, lon)`` in degrees on the state's plane, over the date line too
    if ``wrapped``."""
    east = geo.wrap180(c("wlon") - c("lon")) if wrapped else c("wlon") - c("lon")
    east = east * F.cos(F.radians("lat"))
    return F.round(east * east + F.pow(c("wlat") - c("lat"), 2), 12)


def _cell(lat: Column, lon: Column, width: float, wrapped: bool) -> tuple[Column, Column]:
    row = F.floor((lat + 90.0) / width).cast("long")
    return row, (F.floor((geo.wrap180(lon) + 180.0) / width).cast("long") % int(360 / width) if wrapped else F.floor(lon / width).cast("long"))


def first_width(points: DataFrame, by: list[str], wrapped: bool) -> int:
    """The place in ``WIDTHS`` of the widest cells in which a point has few others about it, as a mean over points; all counted in one pass."""
    at = [F.struct(F.lit(k).alias("k"), *[x.alias(n) for n, x in zip(("cy", "cx"), _cell(c("wlat"), c("wlon"), w, wrapped))]) for k, w in enumerate(WIDTHS)]
    cells = points.select(*by, F.inline(F.array(*at))).groupBy("k", *by, "cy", "cx").count()
    mean = cells.groupBy("k").agg((9 * F.sum(c("count") * c("count")) / F.sum("count")).alias("mean"))
    return mean.where(c("mean") <= FEW_POINTS).agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]


def nearest_points(states: DataFrame, points: DataFrame, by: list[str] | None = None, wrapped: bool = True) -> DataFrame:
    """``event_id, wpt`` of every state of ``states(event_id, lat, lon)``: the nearest of ``points(wpt, wlat, wlon)``, ties to the smaller;
    with columns ``by`` of both, of those that are equal in them.

    A state meets the points of its cell and the eight about it. What lies outside them is a cell's width away at least, less what
    meridians draw together, so a nearer point is the nearest. States without one go on to wider cells, those
    of the last width to all points, so that all get theirs if there is any point. States without a position have none.
    Of points in one place only the smallest can be found, so the others are left out first; the first cells are as wide as the
    points are dense. Longitudes of points that are not ``wrapped`` are compared as they are, and lie in [-360, 360].
    """
    by = by or []
    points = stage_table(points.groupBy(*by, "wlat", "wlon").agg(F.min("wpt").alias("wpt")), "points")
    found, left = None, states.where("lat is not null and lon is not null").select("event_id", "lat", "lon", *by)
    for width in WIDTHS[first_width(points, by, wrapped):]:
        columns, last = int(360 / width), width == WIDTHS[-1]
        reach = (-1, 0, 1) if wrapped or not last else (-2, -1, 0, 1, 2)
        sides = sorted({d % columns for d in reach}) if wrapped else reach
        around = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in sides]))
        row, column = _cell(c("wlat"), c("wlon"), width, wrapped)
        column = (column + c("d.x")) % columns if wrapped else column + c("d.x")
        celled = points.withColumn("d", around).select("wpt", "wlat", "wlon", *by, (row + c("d.y")).alias("cy"), column.alias("cx"))
        joined = left.withColumns(dict(zip(("cy", "cx"), _cell(c("lat"), c("lon"), width, wrapped)))).join(celled, ["cy", "cx", *by])
        best = joined.groupBy("event_id", "lat").agg(F.min(F.struct(squared_degrees(wrapped).alias("d2"), c("wpt"))).alias("b"))
        sure = best if last else best.where(F.sqrt("b.d2") < width * F.cos(F.radians("lat")))
        sure = stage_table(sure.select("event_id", c("b.wpt").alias("wpt")), "nearest-points")
        found = sure if found is None else found.unionByName(sure)
        if last:
            break
        left = stage_table(left.join(sure, "event_id", "left_anti"), "points-left")
        if left.isEmpty():
            break
    return found
