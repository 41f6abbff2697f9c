"""Stage times: one slow instant shows in its own row."""

from pyspark.sql import functions as F

from isohypsa.operators import extrema as E
from isohypsa.operators import rays as R
from isohypsa.params import GridSpec
from isohypsa.plans.detect import detect_blocking
from isohypsa.plans.timings import timed_detection
from isohypsa.registry.inputs import SPEC, synth_field
from isohypsa.sources.grid import to_slices


COARSE = GridSpec(res=10, step=1, lat_min=0)


def three_instants(spark, spec=SPEC):
    params = spark.range(3).select(F.col("id").cast("int").alias("time"), F.lit(5).cast("bigint").alias("s"))
    return synth_field(params, spec)


def sleep(ms):
    return F.reflect(F.lit("java.lang.Thread"), F.lit("sleep"), F.lit(ms).cast("bigint")) == "never"


def test_a_slow_instant_shows_in_its_rows_only(spark, monkeypatch):
    field = three_instants(spark, COARSE)
    plain, flat = E.interpolate, R._walk_north
    slow_cell = (F.col("time") == 1) & (F.col("x") == 4) & (F.col("y") == 7)
    monkeypatch.setattr(E, "interpolate", lambda w, z: F.when(slow_cell & sleep(20), F.lit(0)).otherwise(plain(w, z)))  # 64 samples of one cell
    monkeypatch.setattr(R, "_walk_north", lambda cs, spec: F.when((F.col("time") == 2) & sleep(1500), None).otherwise(flat(cs, spec)))
    got = timed_detection(field, COARSE)
    rows = {(r.part, r.instant): r.time_elapsed for r in got.timings.collect()}
    assert set(rows) == {("init", -1), ("total", -1)} | {(p, t) for p in "12" for t in range(3)} and got.instants == 3
    assert rows["1", 1] > max(rows["1", 0], rows["1", 2]) + 0.7
    assert rows["2", 2] > 1.4 and rows["2", 0] < 1.4 and rows["2", 1] < 1.4
    assert abs(rows["total", -1] - sum(v for k, v in rows.items() if k[0] != "total")) < 1e-6


def test_measuring_changes_no_result(spark):
    field = three_instants(spark)
    slices = to_slices(field, SPEC)
    plain = E.votes_from_slices(slices, SPEC)
    measured = E.votes_from_slices(slices, SPEC, measured=True)
    inner = measured.where(F.col("x") < SPEC.size_x).drop("clock")
    assert plain.exceptAll(inner).isEmpty() and inner.exceptAll(plain).isEmpty()
    assert measured.where(F.col("x") == SPEC.size_x).count() == 3
    assert sorted(map(tuple, timed_detection(field, SPEC).formations.collect())) == sorted(map(tuple, detect_blocking(field, SPEC).collect()))


def test_instants_without_clusters_and_an_empty_field(spark):
    flat = three_instants(spark).withColumn("h", F.lit(5000))
    assert timed_detection(flat, SPEC).timings.where("part = '2'").count() == 3
    none = timed_detection(flat.limit(0), SPEC)
    assert {r.part for r in none.timings.collect()} == {"init", "total"} and none.formations.isEmpty()
