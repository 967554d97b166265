"""Cells and covers: searches against every row, near the date line and the poles too, and what they read."""

from math import asin, cos, radians, sin, sqrt

import pytest
from pyspark.sql import functions as F

from creaseline.operators import geo


def km(a, b):
    h = sin(radians(b[0] - a[0]) / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * asin(min(1.0, sqrt(h)))


@pytest.fixture(scope="module")
def rows(spark):
    lat = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(180_001)) / 1000 - 90
    lon = F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(360_001)) / 1000 - 180
    some = spark.range(6000).select("id", lat.alias("lat"), lon.alias("lon"))
    odd = [(-1, None, 3.0), (-2, 91.0, 0.0), (-3, 0.0, 200.0), (-4, float("nan"), 0.0), (-5, 0.0, 180.0), (-6, 0.0, -180.0), (-7, 90.0, 12.0), (-8, -90.0, 180.0)]
    return some.unionByName(spark.createDataFrame(odd, "id long, lat double, lon double"))


@pytest.fixture(scope="module")
def laid(rows):
    return geo.lay_out(rows, "lat", "lon")


@pytest.fixture(scope="module")
def listed(rows):
    return [(r.id, r.lat, r.lon) for r in rows.collect() if r.lat is not None and -90 <= r.lat <= 90 and -180 <= r.lon <= 180]


@pytest.mark.parametrize("centre", [(20.0, 70.0), (0.0, 179.9), (-15.0, -179.0), (89.0, 10.0), (-90.0, 0.0), (0.0, 0.0), (60.0, -180.0)])
@pytest.mark.parametrize("reach", [0.0, 150.0, 3000.0])
def test_circles_find_what_lies_in_them(laid, listed, centre, reach):
    got = sorted(r.id for r in geo.within(laid, "lat", "lon", centre, reach).collect())
    assert got == sorted(i for i, *at in listed if km(centre, at) <= reach)


@pytest.mark.parametrize("ranges", [1, 4, 64, 500])
def test_boxes_and_the_number_of_ranges(laid, listed, ranges):
    for south, north, west, east in [(10, 40, 60, 100), (-5, 5, 170, -170), (-90, 90, -180, 180), (0, 0, 180, 180), (0, 0, 100, 180)]:
        parts = geo.box_parts(south, north, west, east)
        assert 1 <= len(geo.cover(parts, ranges)) <= ranges
        got = sorted(r.id for r in geo.in_box(laid, "lat", "lon", south, north, west, east, ranges).collect())
        inside = lambda x: west <= x <= east if west <= east else x >= west or x <= east
        line = 180 in (east, west)
        assert got == sorted(i for i, y, x in listed if south <= y <= north and (inside(x) or line and inside(-x) and abs(x) == 180))


def test_ranges_reach_the_scan_and_leave_files_out(spark, rows, many_slots):
    laid = geo.lay_out(rows, "lat", "lon")
    near = geo.within(laid, "lat", "lon", (20.0, 70.0), 200.0)
    scan = next(x for x in near._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
    assert "Or(Or(" in scan.partition("PushedFilters:")[2]
    covered = sum(b - a + 1 for a, b in geo.cover(geo.circle_boxes(20.0, 70.0, 200.0)))
    assert covered < (1 << 2 * geo.BITS) / 500
    wanted = geo._in_cover(geo.circle_boxes(20.0, 70.0, 200.0), geo.RANGES)
    files = laid.where(wanted).groupBy(F.input_file_name()).count().count()
    assert files <= 4 < laid.groupBy(F.input_file_name()).count().count()


def test_density_counts_every_place(laid, listed):
    got = {(r.lat_cell, r.lon_cell): r.n for r in geo.density(laid, 3).collect()}
    want: dict = {}
    for _, lat, lon in listed:
        at = min(int((lat + 90) / 180 * 8), 7), min(int((lon + 180) / 360 * 8), 7)
        want[at] = want.get(at, 0) + 1
    assert got == want


def test_no_places(spark):
    laid = geo.lay_out(spark.createDataFrame([], "lat double, lon double"), "lat", "lon")
    assert geo.within(laid, "lat", "lon", (0.0, 0.0), 1e5).count() == 0 and geo.density(laid, 2).count() == 0
