"""Unit values and invariants of the geometry."""

import math

import pytest
from pyspark.sql import functions as F

from isohypsa.functions import geo as G
from isohypsa.operators import rays as R
from isohypsa.operators.extrema import bearing_set
from isohypsa.params import GridSpec
from isohypsa.sources.grid import PACKING


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize("bearing,lat,lon", [(90.0, 49.92, 6.19), (-90.0, 49.92, -2.19)])
def test_destination(spark, bearing, lat, lon):
    df = spark.createDataFrame([(50.0, 2.0)], "lat double, lon double")
    r = one(G.with_destination(df, "lat", "lon", F.lit(300.0), F.lit(bearing)))
    assert (round(r.dest_lat, 2), round(r.dest_lon, 2)) == (lat, lon)


def test_haversine_values_and_symmetry(spark):
    pts = {"A": (64.5, 177.25), "B": (64.75, 176.5), "C": (64.5, 174.75), "D": (64.5, 173.75)}
    want = {"AB": 45.28, "AC": 119.67, "AD": 167.53, "BC": 87.90, "BD": 133.95, "CD": 47.87}
    rows = [(k, *pts[k[0]], *pts[k[1]]) for k in want]
    df = spark.createDataFrame(rows, "k string, a double, b double, c double, d double")
    df = G.with_haversine(G.with_haversine(df, "a", "b", "c", "d"), "c", "d", "a", "b", "back")
    for r in df.collect():
        assert round(r.km, 2) == want[r.k]
        assert r.km == pytest.approx(r.back, abs=1e-9)


def test_bilinear_value_and_exchanged_weights(spark):
    # p is the first destination above; nodes in the order lower-left, lower-right, upper-left, upper-right
    spec = GridSpec(res=0.25)
    df = spark.createDataFrame([(50.0, 2.0)], "lat double, lon double")
    p = G.with_destination(df, "lat", "lon", F.lit(300.0), F.lit(90.0))
    z = [57425.5, 57426.8, 57426.6, 57427.6]
    for compat in (True, False):
        w = one(G.with_bilinear_weights(p, GridSpec(res=0.25, compat=compat)))
        value = sum(a * b for a, b in zip((w.w11, w.w12, w.w21, w.w22), z))
        assert round(value, 1) == 57427.1
        assert w.w11 + w.w12 + w.w21 + w.w22 == pytest.approx(1, abs=1e-5)
    assert w.i_lo == spec.north - math.floor(49.92 / 0.25)


def test_off_grid_node_has_no_weight(spark):
    df = spark.createDataFrame([(90.0, 0.0), (10.0, 179.9), (-90.0, 5.0), (10.0, -180.5)], "lat double, lon double")
    df = df.select(F.col("lat").cast("float").alias("dest_lat"), F.col("lon").cast("float").alias("dest_lon"))
    got = [r.w11 is None for r in G.with_bilinear_weights(df, GridSpec(res=2.5)).collect()]
    assert got == [True, True, False, True]


def test_pack_unpack_within_one_unit(spark):
    scale, offset, _ = PACKING["z"]
    df = spark.range(5000, 6000, 7).select((F.col("id") * 9.80665).alias("v"))
    df = df.withColumn("p", G.pack_int16(F.col("v"), scale, offset))
    df = df.withColumn("err", F.abs(F.col("p") * F.lit(scale) + F.lit(offset) - F.col("v")))
    assert df.where(F.col("p").isNotNull()).agg(F.max("err")).collect()[0][0] <= scale
    out = spark.createDataFrame([(1e9,), (-1e9,)], "v double").select(G.pack_int16(F.col("v"), scale, offset).alias("p"))
    assert [r.p for r in out.collect()] == [None, None]


def test_contour_level_and_snap(spark):
    df = spark.createDataFrame([(5919.7, -1.25), (5920.0, 1.25), (-35.5, 3.7)], "h double, x double")
    rows = df.select(G.contour_level(F.col("h")).alias("c"), G.snap(F.col("x"), 2.5).alias("s")).collect()
    assert [(r.c, r.s) for r in rows] == [(5900, -2.5), (5920, 2.5), (-20, 2.5)]


def test_line(spark):
    df = spark.createDataFrame([(-1.0, 3.0, 3.0, 11.0)], "x1 double, y1 double, x2 double, y2 double")
    r = one(G.with_line_fit(df, "x1", "y1", "x2", "y2"))
    assert (r.slope, r.intercept) == (2.0, 5.0)
    ys = [(r.px, r.py) for r in G.line_raster(df, "x1", "y1", "x2", "y2").orderBy("py").collect()]
    assert ys[0] == (-1, 3) and ys[-1] == (3, 11) and len(ys) == 9


def test_rays_and_bearings(spark):
    rays = R.rays()
    assert len(set(rays)) == R.N_RAYS
    df = R.direction_set(spark.range(1))
    for sector in R.SECTORS:
        assert df.where(R.in_sector(sector)).count() == R.SECTOR_SIZE
    b = [r.bearing for r in bearing_set(spark, GridSpec()).orderBy("k").collect()]
    assert b[0] == -180 and b[1] == -175 and b[-1] == 135


def test_unwrap_pair(spark):
    df = spark.createDataFrame([(170.0, -175.0), (-175.0, 170.0), (10.0, 10.9), (0.0, -5.5)], "a double, b double")
    got = [(r.lon_a_int, r.lon_b_int, r.side) for r in G.with_unwrapped_pair(df, "a", "b").collect()]
    assert got == [(-190, -175, "EAST"), (-175, -190, "WEST"), (10, 10, None), (0, -5, "WEST")]
