"""The whole life cycle, the message stream, folders of the detection stream, walks to a target."""

import datetime as dt
import math
import os

import numpy as np
from pyspark.sql import functions as F

from isohypsa.functions.geo import with_walk_to
from isohypsa.operators import extrema as E
from isohypsa.params import GridSpec
from isohypsa.plans.lifecycle import lifecycle, read_lifecycle, save_lifecycle
from isohypsa.registry.inputs import SPEC, synth_field
from isohypsa.registry.requests import requests
from isohypsa.sources import grid as S
from isohypsa.sources.grid import to_slices
from isohypsa.staging import scratch_path
from isohypsa.streaming import messages as Z

SF = "/root/testdata/sf0.001"
NOW = dt.datetime(2024, 5, 1)


def four_requests(spark):
    """Two equal ones (a, b), one without maps (c), one invalid (x)."""
    one = requests(spark, SF).where("size(areaCovered) = 4 AND areaCovered[0] = '90' AND areaCovered[1] = '-180' AND variableName = 'geopotential' AND size(mapTypes) = 2").limit(1)
    rows = [one.withColumns({"requestHash": F.lit(n), "noMaps": F.lit(maps), "variableName": F.lit(v), "userId": F.lit(u)})
            for n, maps, v, u in (("a", False, "geopotential", 1), ("b", False, "geopotential", 2), ("c", True, "geopotential", 3), ("x", False, "", 4))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def notice(spark, *rows):
    return spark.createDataFrame(rows, "requestHash string, request_type string, exec_status string, at int")


def cycle(spark, notices=None, files=None, catalogue=None):
    listing = spark.createDataFrame([("a", "one.svg"), ("b", "one.svg"), ("b", "two.svg")], "requestHash string, file string")
    return lifecycle(four_requests(spark), listing, F.lit(NOW), catalogue, notices, ["at"], files)


def by_requests(states):
    return {r.n_requests: r for r in states.collect()}


def test_a_run_settles_when_its_latest_notice_says_so(spark):
    run = cycle(spark, notice(spark, ("a", "EXECUTION", "OK", 1)))
    got = by_requests(run.states)
    assert (got[2].next_step, got[2].settled, got[2].n_files, got[2].admitted, got[2].n_tasks > 0) == ("MAP_GENERATION", "GENERATING", 0, "GENERATING", True)
    assert (got[1].next_step, got[1].settled) == ("EXECUTION", "GENERATING") and run.files.isEmpty()  # c has sent nothing yet
    got = by_requests(cycle(spark, notice(spark, ("a", "EXECUTION", "OK", 1), ("b", "VISUALIZATION", "OK", 2), ("c", "EXECUTION", "OK", 1), ("x", "EXECUTION", "OK", 1))).states)
    assert (got[2].next_step, got[2].settled, got[2].n_files) == ("DONE", "CACHED", 2) and (got[1].next_step, got[1].settled) == ("DONE", "EMPTY")
    got = by_requests(cycle(spark, notice(spark, ("b", "VISUALIZATION", "ERROR", 5), ("a", "VISUALIZATION", "OK", 2))).states)
    assert (got[2].next_step, got[2].settled) == ("FAILED", "GENERATING")


def test_tasks_and_files_and_expiry(spark):
    known = spark.createDataFrame([("a", "old.svg", dt.datetime(2024, 4, 1)), ("c", "late.svg", dt.datetime(2024, 4, 30)), ("c", "good.svg", dt.datetime(2024, 5, 2)), ("zz", "other.svg", dt.datetime(2020, 1, 1))],
                                  "requestHash string, file string, expiresAt timestamp")
    run = cycle(spark, notice(spark, ("a", "VISUALIZATION", "OK", 2)), known)
    assert {(r.file, r.state) for r in run.files.collect()} == {("one.svg", "settled"), ("two.svg", "settled"), ("late.svg", "deleted"), ("good.svg", "kept")}
    states = by_requests(run.states)
    counts = {r.requestHash: r["count"] for r in run.tasks.groupBy("requestHash").count().collect()}
    assert counts == {r.requestHash: r.n_tasks for r in states.values()}
    cached = run.states.where("n_requests = 2").select("requestHash", F.lit("CACHED").alias("requestStatus"), F.lit(4).cast("bigint").alias("timesRequested"))
    again = cycle(spark, notice(spark), None, cached)
    got = by_requests(again.states)
    assert (got[2].reply, got[2].timesRequested, got[2].n_tasks, got[2].settled) == ("CACHED", 6, 0, "CACHED")
    assert {r.requestHash for r in again.tasks.select("requestHash").distinct().collect()} == {got[1].requestHash}


def test_versions_of_the_catalogue(spark):
    root = scratch_path(spark, "cycle")
    first = cycle(spark)
    for version in (1, 2, 2):
        save_lifecycle(first, root, version)
    first.tasks.limit(0).write.parquet(f"{root}/tasks/version=3")  # an update that broke off
    assert read_lifecycle(spark, root, "tasks").count() == first.tasks.count() > 0
    assert read_lifecycle(spark, root, "states").count() == 2


MESSAGE = "id long, body string, routing_key string, sent_at timestamp, seen timestamp"


def test_message_stream_routes_counts_and_repeats(spark):
    base = scratch_path(spark, "m")
    t = dt.datetime(2024, 1, 1)
    good, late = t + dt.timedelta(milliseconds=5000), t + dt.timedelta(milliseconds=5001)
    body = lambda n: '{"status": "OK", "message": "m", "content": {"n": %d}}' % n
    rows = [(1, body(1), "results.done", t, good), (2, body(2), "nowhere", t, good), (3, "{bad", "results.done", t, good), (4, body(4), "progress.update", t, late), (5, body(5), "progress.update", t, t),
            (6, None, "results.done", t, late), (7, body(7), None, t, good)]
    for part in (rows[:4], rows[4:], []):
        spark.createDataFrame(part, MESSAGE).coalesce(1).write.mode("append").parquet(f"{base}/in")
    for run in range(2):  # a second run from the start replaces the folders of the first
        source = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        Z.message_stream(source, "n long", f"{base}/out", f"{base}/cp{run}", consumed=F.col("seen"))
        routed = spark.read.parquet(f"{base}/out/queues")
        assert {(r.id, r.queue, r.exchange, r.content.n) for r in routed.collect()} == {(1, "results_queue", "results_exchange", 1), (5, "progress_queue", "progress_exchange", 5)}
        assert {r.id for r in spark.read.parquet(f"{base}/out/malformed").collect()} == {3, 6}
        counts = spark.read.parquet(f"{base}/out/counts").agg(*[F.sum(c).alias(c) for c in ("received", "malformed", "expired", "unbound", "routed")]).first()
        assert counts.asDict() == {"received": 7, "malformed": 2, "expired": 1, "unbound": 2, "routed": 2}


def test_detection_stream_merges_into_folders(spark, monkeypatch):
    monkeypatch.setattr(S, "FOLDER_INSTANTS", 4)
    base = scratch_path(spark, "f")
    field = synth_field(spark.range(6).select(F.col("id").cast("int").alias("time"), F.lit(5).cast("bigint").alias("s")), SPEC)

    def send(times, flat=False):
        part = field.where(F.col("time").isin(times))
        to_slices(part.withColumn("h", F.lit(5000)) if flat else part, SPEC).coalesce(1).write.mode("append").parquet(f"{base}/in")
        Z.detect_stream(spark.readStream.schema("time int, vals array<int>").parquet(f"{base}/in"), SPEC, f"{base}/out", f"{base}/cp")
        return {r.time for r in Z.read_formations(spark, f"{base}/out").collect()}

    assert send([0, 1, 4]) == {0, 1, 4}
    assert send([2, 5]) == {0, 1, 2, 4, 5}  # the others of their folders stay
    before = Z.read_formations(spark, f"{base}/out").count()
    assert send([1, 2]) == {0, 1, 2, 4, 5} and Z.read_formations(spark, f"{base}/out").count() == before
    assert send([0], flat=True) == {1, 2, 4, 5}
    root = f"{base}/out".removeprefix("file:")
    assert sorted(n for n in os.listdir(root) if n.startswith("folder=")) == ["folder=0", "folder=1"]


def test_walks_to_a_target_against_a_loop(spark):
    single = np.float32

    def walk(lat, lon, bearing, to_lat, to_lon, res, most):
        lat, lon, n = single(lat), single(lon), 0
        while n < most and (n < 2 or lat < to_lat or lon < to_lon):
            ad = math.cos(float(lat) * math.pi / 180) * res * math.pi / 180
            la, lo, be = single(float(lat) * math.pi / 180), single(float(lon) * math.pi / 180), bearing * math.pi / 180
            fa = single(math.asin(math.sin(la) * math.cos(ad) + math.cos(la) * math.sin(ad) * math.cos(be)))
            fo = single(float(lo) + math.atan2(math.sin(be) * math.sin(ad) * math.cos(la), math.cos(ad) - math.sin(la) * math.sin(fa)))
            lat, lon, n = single(float(fa) * 180 / math.pi), single(float(fo) * 180 / math.pi), n + 1
        return n, float(lat), float(lon), not (lat < to_lat or lon < to_lon)

    rows = [(k, 10.0 + k, -20.0 + k, float(5 * k), 12.7 + k * 0.9, -18.4 + k * 1.3) for k in range(30)] + [(90, 50.0, 0.0, 180.0, 60.0, 0.0), (91, 50.0, 0.0, 0.0, 40.0, -5.0)]
    df = spark.createDataFrame(rows + [(99, None, 0.0, 0.0, 1.0, 1.0), (98, 0.0, 0.0, 0.0, None, 1.0)], "k int, lat double, lon double, b double, tlat double, tlon double")
    got = {r.k: r for r in with_walk_to(df, "lat", "lon", "b", "tlat", "tlon", 0.5, 40).collect()}
    for k, *args in rows:
        n, lat, lon, reached = walk(*args, 0.5, 40)
        assert got[k].n_steps == n and got[k].reached == reached and abs(got[k].walk_lat - lat) < 1e-4 and abs(got[k].walk_lon - lon) < 1e-4
    assert got[91].n_steps == 2 and got[90].n_steps == 40 and not got[90].reached and got[99].n_steps is None and got[98].reached is None
    assert len({got[k].n_steps for k in range(30)}) > 5


def test_a_stored_stencil_gives_the_same_votes(spark):
    spec = GridSpec(res=10, step=2, lat_min=0)
    path = scratch_path(spark, "stencil")
    E.save_stencil(spark, spec, path)
    stored = spark.read.parquet(path)
    assert stored.count() == spec.n_coarse * spec.n_bearings
    field = synth_field(spark.range(2).select(F.col("id").cast("int").alias("time"), F.lit(5).cast("bigint").alias("s")), spec)
    a, b = E.samples_by_join(field, spec), E.samples_by_join(field, spec, stored=stored)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count() == 2 * spec.n_coarse * 64
