"""Places laid out along a space-filling curve, so that a search near a point reads ranges of it and no more.

A cell number interleaves the bits of longitude and latitude on a grid of equal angles (2 ** BITS each way), so a square
of the grid, at any level, is one range of numbers. A circle or box is covered by at most ``RANGES`` such ranges, which
reach the scan as filters; the exact test runs on what lies in them. Coordinates that are null, not numbers or off the map have
no cell: their rows stay in the table and no search finds them.
"""

from __future__ import annotations

from functools import reduce
from math import asin, cos, degrees, floor, radians, sin
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from creaseline.functions.scalars import EARTH_KM, haversine_km
from creaseline.session import materialize

CELL = "__cell"
BITS = 16
RANGES = 64
#: Degrees by which a cover exceeds its circle, for rounding.
MARGIN = 1e-6
#: The steps that leave a gap beside each bit of a number of 16 bits.
GAPS = [(8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)]

Box = tuple[float, float, float, float]  # south, north, west, east


def _step(value: Column, low: float, span: float) -> Column:
    return F.least(F.floor((value - low) / span * (1 << BITS)), F.lit((1 << BITS) - 1)).cast("long")


def _gapped(value: Column) -> Column:
    for shift, mask in GAPS:
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask))
    return value


def cell(lat: Column, lon: Column) -> Column:
    """Number of the finest cell of a place."""
    code = _gapped(_step(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(_gapped(_step(lat, -90.0, 180.0)), 1))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), code)


def lay_out(df: DataFrame, lat: str, lon: str, folder: str | None = None) -> DataFrame:
    """Write places in the order of their cells; a place with many rows spreads over files."""
    placed = df.withColumn(CELL, cell(F.col(lat).cast("double"), F.col(lon).cast("double")))
    spread = F.xxhash64(*df.columns)
    return materialize(placed.repartitionByRange(F.col(CELL), spread).sortWithinPartitions(CELL), folder)


def circle_boxes(lat: float, lon: float, km: float) -> list[Box]:
    """One or two boxes around a circle; two where it crosses the date line, all longitudes where it holds a pole."""
    reach = km / EARTH_KM
    south, north = lat - degrees(reach) - MARGIN, lat + degrees(reach) + MARGIN
    if south <= -90 or north >= 90:
        return [(max(south, -90.0), min(north, 90.0), -180.0, 180.0)]
    wide = degrees(asin(min(1.0, sin(reach) / cos(radians(lat))))) + MARGIN
    return box_parts(south, north, lon - wide, lon + wide)


def box_parts(south: float, north: float, west: float, east: float) -> list[Box]:
    """A box cut at the date line; ``west`` may be above ``east``, or either beyond 180 degrees."""
    if west > east:
        east += 360
    if east - west >= 360:
        return [(south, north, -180.0, 180.0)]
    if west < -180:
        return [(south, north, west + 360, 180.0), (south, north, -180.0, east)]
    if east > 180:
        return [(south, north, west, 180.0), (south, north, -180.0, east - 360)]
    # a place on the date line has two longitudes
    more = [(south, north, -180.0, -180.0)] if east == 180 else [(south, north, 180.0, 180.0)] if west == -180 else []
    return [(south, north, west, east), *more]


def cover(boxes: list[Box], ranges: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of cells that hold every place in some boxes, first and last included, at most ``ranges`` of them.

    The grid is refined level by level along the boxes' edges for as long as the number allows.
    """
    most = (1 << BITS) - 1

    def at(value: float, low: float, span: float) -> int:
        return min(max(floor((value - low) / span * (1 << BITS)), 0), most)

    areas = [(at(w, -180.0, 360.0), at(e, -180.0, 360.0), at(s, -90.0, 180.0), at(n, -90.0, 180.0)) for s, n, w, e in boxes]
    inside: list[tuple[int, int]] = []
    edge = [(0, 0, 0)]  # x, y and curve number of squares that a box's edge crosses
    best = [(0, (1 << 2 * BITS) - 1)]
    for shift in range(BITS - 1, -1, -1):
        full, open_ = [], []
        side = 1 << shift
        for x, y, code in edge:
            for quarter in range(4):
                cx, cy, number = x * 2 + (quarter & 1), y * 2 + (quarter >> 1), code * 4 + quarter
                x0, y0 = cx * side, cy * side
                x1, y1 = x0 + side - 1, y0 + side - 1
                if any(w <= x0 and x1 <= e and s <= y0 and y1 <= n for w, e, s, n in areas):
                    full.append((number << 2 * shift, (number + 1 << 2 * shift) - 1))
                elif any(w <= x1 and x0 <= e and s <= y1 and y0 <= n for w, e, s, n in areas):
                    open_.append((cx, cy, number))
        rest = [(number << 2 * shift, (number + 1 << 2 * shift) - 1) for _, _, number in open_]
        found = _joined([*inside, *full, *rest])
        if len(found) > ranges:
            break
        inside, edge, best = [*inside, *full], open_, found
    return best


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first == out[-1][1] + 1:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


def _in_cover(boxes: list[Box], ranges: int) -> Column:
    return reduce(or_, [F.col(CELL).between(a, b) for a, b in cover(boxes, ranges)])


def within(places: DataFrame, lat: str, lon: str, centre: tuple[float, float], km: float, ranges: int = RANGES) -> DataFrame:
    """Rows of a laid-out table up to ``km`` from a centre, with their distance ``km``."""
    near = places.where(_in_cover(circle_boxes(*centre, km), ranges)).drop(CELL)
    distance = haversine_km(F.lit(float(centre[0])), F.lit(float(centre[1])), F.col(lat), F.col(lon))
    return near.withColumn("km", distance).where(F.col("km") <= km)


def in_box(places: DataFrame, lat: str, lon: str, south: float, north: float, west: float, east: float, ranges: int = RANGES) -> DataFrame:
    """Rows of a laid-out table in a box, edges included; it crosses the date line if ``west`` is above ``east``."""
    parts = box_parts(south, north, west, east)
    exact = reduce(or_, [F.col(lat).between(s, n) & F.col(lon).between(w, e) for s, n, w, e in parts])
    return places.where(_in_cover(parts, ranges)).drop(CELL).where(exact)


def density(places: DataFrame, level: int) -> DataFrame:
    """``lat_cell, lon_cell, n`` on a grid of ``2 ** level`` cells each way; reads the cell column alone."""
    coarse = F.shiftright(CELL, 2 * (BITS - level)).alias("at")
    counted = places.where(F.col(CELL).isNotNull()).groupBy(coarse).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(_packed(F.shiftright("at", 1)).alias("lat_cell"), _packed(F.col("at")).alias("lon_cell"), "n")


def _packed(value: Column) -> Column:
    """Every second bit of a number, the lowest included."""
    value = value.bitwiseAND(F.lit(GAPS[-1][1]))
    for (shift, _), mask in zip(reversed(GAPS), [m for _, m in reversed(GAPS[:-1])] + [0xFFFF], strict=True):
        value = value.bitwiseOR(F.shiftright(value, shift)).bitwiseAND(F.lit(mask))
    return value.cast("int")
