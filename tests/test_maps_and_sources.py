"""Map data, sources and sinks."""

import random

import pytest
from pyspark.sql import functions as F

from isohypsa.operators import maps as M
from isohypsa.params import GridSpec
from isohypsa.sources import grid as S
from isohypsa.sources import results as R
from isohypsa.staging import scratch_path

SMALL = GridSpec(res=30.0, step=1, lat_min=0)


def small_field(spark, fn):
    rows = [(0, i, j, fn(i, j)) for i in range(SMALL.nlat) for j in range(SMALL.nlon)]
    return spark.createDataFrame(rows, "time int, i int, j int, h int")


def test_level_list(spark):
    df = spark.createDataFrame([(5903, 5960), (5900, 5900), (5900, 5940), (5901, 5905)], "a int, b int")
    got = [r.l for r in df.select(M.level_list(F.col("a"), F.col("b"), 20).alias("l")).collect()]
    assert got == [[5910.0, 5930.0, 5950.0], [5900.0] * 5, [5900.0, 5920.0], [5901.0, 5902.0, 5903.0, 5904.0, 5905.0]]


def test_isolines_against_loop(spark):
    rnd = random.Random(5)
    vals = {(i, j): rnd.randrange(5800, 5900) for i in range(SMALL.nlat) for j in range(SMALL.nlon)}
    f = small_field(spark, lambda i, j: vals[i, j])
    lo, hi = min(vals.values()), max(vals.values())
    levels = range(-(-lo // 10) * 10, hi, 20)
    want = set()
    for (i, j), a in vals.items():
        for edge, q in (("E", (i, j + 1)), ("S", (i + 1, j))):
            if q in vals:
                want |= {(i, j, edge, float(c)) for c in levels if (a < c) != (vals[q] < c)}
    got = M.isoline_crossings(S.to_slices(f, SMALL), SMALL, 20).collect()
    assert {(r.i, r.j, r.edge, r.level) for r in got} == want and len(got) == len(want)


def test_isolines_of_an_area_and_of_a_flat_slice(spark):
    f = small_field(spark, lambda i, j: 5000 if i == 0 else 5800 + (i + j) % 3)
    area = (90 - SMALL.res, -180, -90, 180)  # all but the first row
    got = M.isoline_crossings(S.to_slices(f, SMALL), SMALL, 20, area).collect()
    assert {r.level for r in got} == {5800.5, 5801.0, 5801.5, 5802.0} and min(r.i for r in got) == 1
    assert M.isoline_crossings(S.to_slices(f, SMALL), SMALL, 20, (10.1, 0, 10.05, 5)).count() == 0


def test_hull_holds_all_points(spark):
    rnd = random.Random(9)
    rows = [(0, m, float(rnd.randrange(30, 60)), float(rnd.choice([rnd.randrange(150, 180), rnd.randrange(-179, -160)]) if m else rnd.randrange(-20, 20)))
            for m in range(2) for _ in range(25)]
    pts = spark.createDataFrame(rows, "time int, max_id int, lat double, lon double")
    hull = M.formation_hull(pts).orderBy("max_id", "vertex").collect()
    for m in range(2):
        ring = [(r.lon, r.lat) for r in hull if r.max_id == m]
        inside = [(lo + 360 if m and lo < 0 else lo, la) for _, k, la, lo in rows if k == m]
        assert len(ring) >= 3
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            assert all((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) >= 0 for x, y in inside)


def test_labels(spark):
    m = spark.createDataFrame([(0, 0, "OMEGA", 50.0, 178.0), (0, 0, "OMEGA", 60.0, -178.0)], "time int, max_id int, form_type string, lat double, lon double")
    r = M.formation_label(m).collect()[0]
    assert (r.label_lat, r.label_lon) == (47.0, 170.0)


def test_bands_keep_empty_levels(spark):
    f = small_field(spark, lambda i, j: 5800 if i else 5870)
    got = {r.contour: r.n_points for r in M.contour_bands(f, SMALL).collect()}
    assert got == {5780: 0, 5800: SMALL.nlon * (SMALL.nlat - 1), 5820: 0, 5840: 0, 5860: SMALL.nlon}


def test_empty_area_is_an_error_row(spark):
    cells = spark.createDataFrame([(0, 10.0, 5.0), (1, 50.0, 5.0)], "time int, lat double, lon double")
    left = M.area_filter(cells, 60, 0, 40, 10)
    assert [r.time for r in M.area_is_empty(left, ["time"], cells.select("time").distinct()).collect()] == [0]


def test_normalize(spark):
    assert [r.name for r in S.unknown_variables(spark.createDataFrame([("z",), ("foo",)], "name string")).collect()] == ["foo"]
    df = spark.createDataFrame([(0, 1.0)], "time int, z double")
    assert S.normalize_dataset(df, "z") is df
    ax = spark.createDataFrame([(0, 0.0), (1, 90.0), (2, 180.0), (3, 270.0)], "j int, lon double")
    f = spark.createDataFrame([(0, 0, j, j * 10) for j in range(4)], "time int, i int, j int, h int")
    got = {(r.j, r.lon, r.h) for r in S.normalize_lon(f, ax).collect()}
    assert got == {(2, 0.0, 0), (3, 90.0, 10), (0, -180.0, 20), (1, -90.0, 30)}
    west = ax.withColumn("lon", F.col("lon") - 180)
    assert {(r.j, r.lon) for r in S.normalize_lon(f, west).collect()} == {(0, -180.0), (1, -90.0), (2, 0.0), (3, 90.0)}


def test_first_level_must_be_known(spark):
    df = spark.createDataFrame([(0, 850, 60000.0), (0, 500, 50000.0)], "valid_time int, pressure_level int, z double")
    with pytest.raises(ValueError):
        S.normalize_dataset(df, "z")
    assert S.normalize_dataset(df, "z", levels=[850, 500]).count() == 1
    assert S.normalize_dataset(df.where("pressure_level = 500"), "z").count() == 1


def test_publishing_keeps_other_runs_and_replaces_its_own(spark):
    base = scratch_path(spark, "pub")
    rows = lambda h, n: spark.range(n).withColumn("request_hash", F.lit(h))
    assert R.publish_results(rows("a", 10), base, rows_per_file=3).count() >= 1
    assert {r.path.split("request_hash=")[1][0] for r in R.publish_results(rows("b", 5), base).collect()} == {"b"}
    R.publish_results(rows("a", 4), base)
    got = spark.read.option("header", True).csv(base).groupBy("request_hash").count().collect()
    assert {(r[0], r[1]) for r in got} == {("a", 4), ("b", 5)}


def test_listing_by_any_prefix(spark):
    keys = spark.createDataFrame([("h/maps/x.svg", 1), ("h/y.csv", 2), ("h/maps/", 0), ("g/maps2/z", 3), ("top", 4)], "name string, size int")
    want = spark.createDataFrame([("h",), ("h/maps/",), ("g/maps",), ("none",)], "prefix string")
    assert {(r.prefix, r.file) for r in R.list_objects(keys, want).collect()} == {("h", "maps/x.svg"), ("h", "y.csv"), ("h/maps", "x.svg")}
    assert {r.prefix: r.exists for r in R.prefix_exists(keys, want).collect()} == {"h": True, "h/maps/": True, "g/maps": False, "none": False}


def test_results_round_trip_and_errors(spark):
    base = scratch_path(spark, "t")
    rows = spark.createDataFrame([(0, 1, 2, -1, "REX")], "time int, max_id int, min1_id int, min2_id int, type string")
    R.write_results(R.formation_rows(rows), base, "formations", "h1")
    assert R.read_results(spark, base, "formations", "h1").collect()[0].min2_id == -1
    for kind, h in (("formations", "h2"), ("selected", "h1")):
        with pytest.raises(FileNotFoundError):
            R.read_results(spark, base, kind, h)
    with pytest.raises(ValueError):
        R.read_results(spark, base, "other", "h1")


def test_bucketed_slices_need_no_shuffle(spark):
    f = small_field(spark, lambda i, j: 5800 + i * j)
    S.save_slices(S.to_slices(f, SMALL), "slices_bucketed_test", 4)
    try:
        plan = spark.table("slices_bucketed_test").groupBy("time").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        spark.sql("DROP TABLE slices_bucketed_test")
