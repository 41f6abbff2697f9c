"""What a field may not do when it grows: travel through the driver, be laid out cell by cell, or be sorted or written in one task."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from isohypsa.operators import clusters as C
from isohypsa.operators import components as K
from isohypsa.operators import extrema as E
from isohypsa.operators import maps as M
from isohypsa.operators import rays as R
from isohypsa.params import GridSpec
from isohypsa.registry.detection import PACKED_SPEC
from isohypsa.sources import dataset as DS
from isohypsa.sources import grid as S
from isohypsa.sources import results

SMALL = GridSpec(res=10, step=1, lat_min=0)


def noisy(spark, spec, times=3):
    cells = spark.range(times * spec.n_cells).select(
        (F.col("id") / spec.n_cells).cast("int").alias("time"), (F.col("id") % spec.n_cells).cast("int").alias("c"))
    rows = cells.select("time", (F.col("c") / spec.nlon).cast("int").alias("i"), (F.col("c") % spec.nlon).cast("int").alias("j"),
                        F.pmod(F.xxhash64("time", "c"), F.lit(200)).cast("int").alias("n"))
    return rows.where("n % 17 <> 0").select("time", "i", "j", F.when(F.col("n") % 13 != 0, F.col("n") + 5000).alias("h"))


def broadcasts(df):
    return len(re.findall(r"BroadcastHashJoin|BroadcastNestedLoopJoin", df._jdf.queryExecution().executedPlan().toString()))


def test_f4_f6_corners_do_not_send_the_field_to_all_tasks(spark):
    samples = spark.createDataFrame([(0, 1, 1), (0, 1, 1), (2, 3, 4), (None, 1, 1)], "time int, i_lo int, j_lo int")
    assert broadcasts(E.gather4(samples, noisy(spark, SMALL))) == 0


def test_f2_f7_ray_cells_send_the_cutoffs_only(spark):
    clusters = spark.createDataFrame([(0, 0, "MAX", 50.0, 0.0)], "time int, id int, type string, center_lat double, center_lon double")
    assert broadcasts(R.ray_cells(clusters, noisy(spark, SMALL), SMALL)) == 1


def test_f3_surface_does_not_send_the_field(spark):
    f = noisy(spark, SMALL)
    assert broadcasts(M.surface_grid(f, SMALL)) == 0
    got = M.surface_grid(f, SMALL).agg(F.count("*"), F.count("value"), F.sum("value")).first()
    told = f.agg(F.count("h"), F.sum("h")).first()
    assert tuple(got) == (3 * SMALL.n_cells, *told)


def test_f1_f5_samples_send_the_stencil_only(spark):
    assert broadcasts(E.samples_by_join(noisy(spark, SMALL), SMALL)) == 1


def test_slices_with_gaps_read_back(spark):
    f = noisy(spark, SMALL)
    back = S.from_slices(S.to_slices(f, SMALL), SMALL).where("h IS NOT NULL")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in f.where("h IS NOT NULL").collect()}


def test_votes_of_arrays_equal_votes_of_rows_and_of_joins(spark):
    for spec, shift in ((SMALL, 0), (GridSpec(res=10, step=2, lat_min=10, compat=False), 0), (GridSpec(res=10, step=1, lat_min=0, scale=PACKED_SPEC.scale, offset=PACKED_SPEC.offset), -5100)):
        f = noisy(spark, spec).withColumn("h", F.col("h") + shift)
        slices = S.to_slices(f, spec)
        cols = ["time", "x", "y", "raw", "n_ge", "n_le"]
        a, b, c = E.votes_from_slices(slices, spec).select(cols), E.votes_by_row(slices, spec).select(cols), E.votes_by_join(f, spec).select(cols)
        got = sorted(map(tuple, a.collect()))
        assert got and got == sorted(map(tuple, b.collect())) == sorted(map(tuple, c.collect()))


def test_f16_to_f20_ranges_of_a_data_set_follow_its_cells(spark, monkeypatch):
    rows = lambda n: spark.range(n)
    data = DS.Dataset(rows(1), rows(10), rows(20), rows(30), rows(2))
    assert DS.ranges_of(data) is None
    monkeypatch.setattr(DS, "ROWS_PER_RANGE", 1000)
    assert DS.ranges_of(data) == 12


def test_f9_small_publications_are_written_by_several_tasks(spark, tmp_path):
    df = spark.range(400).select((F.col("id") % 40).cast("string").alias("request_hash"), "id")
    listing = results.publish_results(df, str(tmp_path / "out")).collect()
    assert len(listing) == 40
    assert len({re.search(r"part-(\d+)", r["path"]).group(1) for r in listing}) > 1


def typed(spark, times=3):
    kind = F.when(F.col("n") % 3 == 0, "MIN").otherwise("MAX")
    return noisy(spark, SMALL, times).withColumn("n", F.pmod(F.xxhash64("time", "i", "j"), F.lit(10))).where("n < 4").select(
        "time", F.col("i").alias("x"), F.col("j").alias("y"), kind.alias("type"), F.col("h").alias("raw"))


def test_f1_relational_labels_do_not_send_the_points(spark, monkeypatch):
    points, seen, sent, stage = typed(spark), spark.sparkContext.accumulator(0), [], K.stage
    n, want = points.count(), {tuple(r) for r in K.label_components(points, SMALL.size_x, SMALL.size_y).collect()}
    monkeypatch.setattr(K, "stage", lambda df, name: sent.append(broadcasts(df)) or stage(df, name))

    def told(kind):
        seen.add(1)
        return kind

    got = K.label_components(points.withColumn("type", F.udf(told, "string")("type")), SMALL.size_x, SMALL.size_y, "relational")
    assert broadcasts(got) == 0 and not any(sent) and len(sent) >= 5
    assert seen.value == n  # the points are derived once
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 100  # does not double with every round
    assert {tuple(r) for r in got.select("time", "x", "y", "type", "raw", "root").collect()} == want and got.count() == n


def test_f1_relational_labels_of_a_long_component(spark):
    snake = [(0, x, y, "MAX") for x in range(21) for y in (range(5) if x % 2 == 0 else [4 if x % 4 == 1 else 0])]
    points = spark.createDataFrame([*snake, (0, 1, 1, "MIN"), (1, 3, 2, "MAX"), (None, 0, 0, "MAX")], "time int, x int, y int, type string")
    got = {tuple(r) for r in K.label_components(points, 21, 5, "relational").select("time", "x", "y", "type", "root").collect()}
    assert got == {(*p, 0) for p in snake} | {(0, 1, 1, "MIN", 6), (1, 3, 2, "MAX", 17)}


def test_f2_points_of_clusters_are_not_sent(spark):
    labelled = K.label_components(typed(spark), SMALL.size_x, SMALL.size_y)
    roots = labelled.groupBy("time", "root").agg(F.count("*").alias("n")).where("n > 1")
    clusters = C.reindex(roots).withColumns({"center_lat": F.col("root") + 0.5, "center_lon": F.col("n") + 0.25})
    got = C.cluster_points(labelled, clusters)
    assert broadcasts(got) == 0
    kept = {(r["time"], r["root"]): (r["id"], r["center_lat"], r["center_lon"]) for r in clusters.collect()}
    want = {(*r, *kept[r["time"], r["root"]]) for r in labelled.collect() if (r["time"], r["root"]) in kept}
    cols = [*labelled.columns, "cluster", "center_lat", "center_lon"]
    assert {tuple(r) for r in got.select(cols).collect()} == want and got.count() == len(want) > 0
