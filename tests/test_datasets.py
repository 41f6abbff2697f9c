"""Data sets with axes and packing, maps by date and maps of stored results."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from isohypsa.operators import maps as M
from isohypsa.plans import requested as Q
from isohypsa.sources import dataset as DS
from isohypsa.sources import grid as S
from isohypsa.sources import results as R
from isohypsa.staging import scratch_path

FIRST = dt.datetime(2024, 1, 31, 12)
META = [("z", 2.0, 1000.0, "Geopotential"), ("t", 0.5, 273.15, "Temperature")]
REQUEST = "request_id long, variableName string, year int, month int, day int, hour int, north double, west double, south double, east double, step double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def small_set(spark, cells, lons=((0, 0.0), (1, 90.0), (2, 180.0), (3, 270.0))):
    field = spark.createDataFrame(cells, "var string, time int, i int, j int, raw int")
    return DS.Dataset(field, spark.createDataFrame([(i, 60.0 - 30 * i) for i in range(4)], "i int, lat float"), spark.createDataFrame(lons, "j int, lon float"),
                      spark.createDataFrame([(n, FIRST + dt.timedelta(hours=6 * n)) for n in range(4)], "time int, ts timestamp"),
                      spark.createDataFrame(META, "var string, scale_factor double, add_offset double, long_name string"))


def all_cells(value, var="z"):
    return [(var, n, i, j, value(n, i, j)) for n in range(4) for i in range(4) for j in range(4)]


def test_round_trip_units_and_turned_axis(spark):
    path = scratch_path(spark, "ds")
    DS.save_dataset(small_set(spark, all_cells(lambda n, i, j: n + 4 * j) + all_cells(lambda n, i, j: i, "t")), path)
    data = DS.load_dataset(spark, path, ["z", "t"])
    rows = DS.located(DS.unpacked(data.field, data.meta), data).collect()
    z = {(r.time, r.i, r.lon): r.value for r in rows if r["var"] == "z"}
    assert z[1, 0, -180.0] == (2.0 * 9 + 1000) / 9.80665 and z[3, 2, 90.0] == (2.0 * 7 + 1000) / 9.80665
    assert {(r.i, r.value) for r in rows if r["var"] == "t"} == {(i, i * 0.5 + 273.15 - 273.15) for i in range(4)}
    assert {(r.lon, r.j) for r in rows} == {(-180.0, 0), (-90.0, 1), (0.0, 2), (90.0, 3)} and {r.month for r in rows} == {"2024-01", "2024-02"}
    for wanted in (["u"], ["z", "u"]):
        with pytest.raises(ValueError):
            DS.load_dataset(spark, path, wanted)
    with pytest.raises(FileNotFoundError):
        DS.load_dataset(spark, path + "-none")
    twice = scratch_path(spark, "ds")
    data = small_set(spark, all_cells(lambda n, i, j: 0))
    DS.save_dataset(DS.Dataset(data.field, data.lats, data.lons, data.times, data.meta.unionAll(data.meta)), twice)
    with pytest.raises(ValueError):
        DS.load_dataset(spark, twice, ["z"])


def test_only_the_wanted_folders_are_read(spark):
    path = scratch_path(spark, "ds")
    DS.save_dataset(small_set(spark, all_cells(lambda n, i, j: 0) + all_cells(lambda n, i, j: 0, "t")), path, partitions=3)
    one = DS.load_dataset(spark, path, ["z"]).field.where("month = '2024-02'")
    assert len(one.inputFiles()) == len(DS.load_dataset(spark, path).field.inputFiles()) >= 2
    assert "month" in plan(one).split("PartitionFilters")[1].split("]")[0]
    opened = {r.f for r in one.select(F.input_file_name().alias("f")).collect()}
    assert opened and all("var=z" in f and "month=2024-02" in f for f in opened)


def test_a_grid_in_folders_of_instants(spark, monkeypatch):
    monkeypatch.setattr(S, "FOLDER_INSTANTS", 4)
    field = spark.range(40).select((F.col("id") % 10).cast("int").alias("time"), F.lit(0).alias("i"), F.floor(F.col("id") / 10).cast("int").alias("j"), F.lit(5).alias("h"))
    path = scratch_path(spark, "grid")
    S.save_grid(field, path)
    assert {tuple(r) for r in S.read_grid(spark, path).collect()} == {tuple(r) for r in field.collect()}
    some = S.read_grid(spark, path, [5, 6])
    assert some.count() == 8 and all("folder=1" in r.f for r in some.select(F.input_file_name().alias("f")).collect())


@pytest.mark.parametrize("gaps", [False, True])
def test_maps_by_date_against_loops(spark, gaps):
    rnd = random.Random(4)
    raw = {(n, i, j): rnd.randrange(24000, 28000) for n in range(4) for i in range(4) for j in range(4) if not gaps or rnd.random() < 0.8}
    path = scratch_path(spark, "ds")
    DS.save_dataset(small_set(spark, [("z", *k, v) for k, v in raw.items()]), path)
    data = DS.load_dataset(spark, path)
    day = lambda n: (FIRST + dt.timedelta(hours=6 * n)).timetuple()[:4]
    asks = [(k, "Geopotential", *day(k % 4), 60.0, -180.0 if k < 4 else -90.0, -30.0, 180.0, 40.0 + k) for k in range(6)]
    asks += [(10, "Geopotential", 1999, 1, 1, 0, 60.0, -180.0, -30.0, 180.0, 20.0), (11, "wind", *day(0), 60.0, -180.0, -30.0, 180.0, 20.0), (12, "geopotential", *day(1), 59.0, -180.0, 55.0, 180.0, 20.0),
             (13, "temperature", *day(1), 60.0, -180.0, -30.0, 180.0, 20.0), (14, None, 2024, 2, 30, 0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    drawn = Q.contour_maps(data, spark.createDataFrame(asks, REQUEST))
    want = set()
    for k, _, *_rest, west, _south, _east, step in asks[:6]:
        value = {(i, (j + 2) % 4): (v * 2.0 + 1000) / 9.80665 for (n, i, j), v in raw.items() if n == k % 4 and -180 + 90 * ((j + 2) % 4) >= west}
        lo, hi = min(value.values()), max(value.values())
        first = -(-lo // 10) * 10
        levels = [first + m * step for m in range(1000) if first + m * step < hi]
        for (i, j), a in value.items():
            for edge, q in (("E", (i, j + 1)), ("S", (i + 1, j))):
                if q in value:
                    want |= {(k, i, j, edge, c) for c in levels if (a < c) != (value[q] < c)}
    got = drawn.crossings.collect()
    assert {(r.request_id, r.i, r.j, r.edge, r.level) for r in got} == want and len(got) == len(want) > 100
    for r in got:
        assert -180 <= r.lon <= 90 and -30 <= r.lat <= 60
    assert {(r.request_id, r.reason) for r in drawn.rejects.collect()} == {(10, Q.NO_INSTANT), (11, Q.UNKNOWN_VARIABLE), (12, Q.NO_CELLS), (13, Q.NO_CELLS), (14, Q.UNKNOWN_VARIABLE)}
    assert {r.request_id: r.label for r in drawn.levels.collect()} == {k: f"2024-{m:02d}-{x:02d}_{h:02d}UTC" for k, _, _, m, x, h, *_ in asks[:6]}


def test_masked_values_have_no_range(spark):
    data = small_set(spark, all_cells(lambda n, i, j: None))
    path = scratch_path(spark, "ds")
    DS.save_dataset(data, path)
    asks = spark.createDataFrame([(1, "geopotential", 2024, 1, 31, 12, 60.0, -180.0, -30.0, 180.0, 20.0)], REQUEST)
    drawn = Q.contour_maps(DS.load_dataset(spark, path), asks)
    assert [tuple(r) for r in drawn.rejects.collect()] == [(1, Q.NO_RANGE)] and drawn.levels.isEmpty() and drawn.crossings.isEmpty()
    nothing = Q.contour_maps(DS.load_dataset(spark, path), asks.limit(0))
    assert nothing.rejects.isEmpty() and nothing.crossings.isEmpty()


def stored(spark):
    base = scratch_path(spark, "runs")
    points = [(t, 50.0 + c, 10.0 * c + k, 5500.0, "MAX", c, 0.0, 0.0, f"r{t % 2}") for t in range(4) for c in range(3) for k in range(2)]
    R.write_results(spark.createDataFrame(points, R.SCHEMAS["selected"]).drop("request_hash"), base, "selected", F.concat(F.lit("r"), F.col("time") % 2))
    forms = [(t, 0, 1, 2 if t == 2 else -1, "OMEGA" if t == 2 else "REX") for t in range(4)]
    R.write_results(spark.createDataFrame(forms, "time int, max_id int, min1_id int, min2_id int, type string"), base, "formations", F.concat(F.lit("r"), F.col("time") % 2))
    axis = spark.createDataFrame([(n, FIRST + dt.timedelta(hours=6 * n)) for n in range(4)], "time int, ts timestamp")
    asks = spark.createDataFrame([(1, "r0", 2024, 2, 1, 0), (2, "r0", 2024, 1, 31, 18), (3, "r9", 2024, 2, 1, 0), (4, "r0", 2024, 2, 1, 0), (5, "r0", 2030, 1, 1, 0)],
                                 "request_id long, request_hash string, year int, month int, day int, hour int")
    return base, axis, asks


def test_stored_maps_read_the_run_and_instant_that_are_asked_for(spark):
    base, axis, asks = stored(spark)
    points = Q.stored_points(R.results_table(spark, base, "selected"), asks, axis)
    assert {r.request_id: r["count"] for r in points.groupBy("request_id").count().collect()} == {1: 6, 4: 6}
    labels = Q.stored_formations(R.results_table(spark, base, "formations"), R.results_table(spark, base, "selected"), asks, axis).collect()
    assert sorted((r.request_id, r.time, r.form_type, r.n_points, r.label_lat, r.label_lon) for r in labels) == [(1, 2, "OMEGA", 6, 43.0, 10.5), (4, 2, "OMEGA", 6, 43.0, 10.5)]
    lines = spark.createDataFrame([(1, 1.0, 2.0, 20.0)], "request_id long, lat double, lon double, level double")
    assert Q.stored_combined(lines, points).groupBy("layer").count().count() == 2
    with pytest.raises(FileNotFoundError):
        R.results_table(spark, base + "-none", "selected")
    with pytest.raises(ValueError):
        R.results_table(spark, base, "other")


def test_stored_maps_prune_runs_and_detect_nothing(spark):
    base, axis, asks = stored(spark)
    labels = Q.stored_formations(R.results_table(spark, base, "formations"), R.results_table(spark, base, "selected"), asks, axis)
    told = plan(labels)
    assert "dynamicpruning" in told and not any(x in told for x in ("Pandas", "nanoTime", "transform(", "dest_lat"))


def test_level_list_with_a_step_of_its_own(spark):
    df = spark.createDataFrame([(5903, 5960, 20.0), (5903, 5960, 30.0)], "a int, b int, s double")
    assert [r.l for r in df.select(M.level_list(F.col("a"), F.col("b"), F.col("s")).alias("l")).collect()] == [[5910.0, 5930.0, 5950.0], [5910.0, 5940.0]]
