"""What may not grow faster than the tables: rows of a task, readings of a batch, micro-batches, and rows copied beside an array."""

from __future__ import annotations

import re
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isohypsa.operators import maps as M
from isohypsa.params import GridSpec
from isohypsa.plans.requested import lattice_crossings
from isohypsa.registry import requests as Q
from isohypsa.sources import grid as S
from isohypsa.streaming import messages as Z
from isohypsa.streaming.state import StateTable

SMALL = GridSpec(res=10, step=1, lat_min=0)


def test_f8_files_of_the_stream_follow_the_instants(spark, tmp_path, monkeypatch):
    rows = spark.range(3000).select(F.col("id").alias("event_id"), (F.col("id") % 7).cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(Q, "scratch_path", lambda s, name: str(tmp_path / name))
    monkeypatch.setattr(Z, "detect_stream", lambda *a: None)
    monkeypatch.setattr(Z, "read_formations", lambda *a: None)
    Q._detect_stream(spark, str(tmp_path))
    assert len(list((tmp_path / "slices-in").glob("*.parquet"))) == 1
    assert spark.read.parquet(str(tmp_path / "slices-in")).select("time").distinct().count() == 3


def test_f18_surface_partitions_follow_the_cells(spark, monkeypatch):
    cells = spark.range(3 * 40).select((F.col("id") / 40).cast("int").alias("time"), (F.col("id") % 5).cast("int").alias("i"), (F.col("id") % 40 / 5).cast("int").alias("j"), F.col("id").cast("int").alias("h"))
    monkeypatch.setattr(S, "ROWS_PER_TASK", 100)
    got = M.surface_grid(cells, SMALL)
    assert got.rdd.getNumPartitions() == -(-3 * SMALL.n_cells // 100)
    assert tuple(got.agg(F.count("*"), F.count("value"), F.sum("value")).first()) == (3 * SMALL.n_cells, 120, sum(range(120)))


def test_f22_files_meet_their_dates_in_partitions_that_follow_the_lines(spark, tmp_path, monkeypatch):
    rows = [(k if k % 50 else None, n, float(q), datetime(2000, 1, 1 + (k + n) % 28)) for k in range(200) for n in range(1, 4) for q in range(1 + k % 2)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_shipdate timestamp")
    df.write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(Q, "LINES_PER_TASK", 30)
    found = Q.cat_files(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == len(rows) // 30
    keys = {r[0] for r in rows} - {None}
    assert {(r["requestHash"], r["size"], r["expiresAt"].day) for r in found.collect()} == {
        (f"h{k}", k % 2, (max(r[3] for r in rows if r[0] == k).day + 7 - 1) % 31 + 1) for k in keys}
    assert found.count() == 3 * len(keys)


def test_f14_f21_f24_a_batch_is_read_four_times(spark, tmp_path):
    arrivals = [(f"h{k % 60}", k, k) for k in range(240)]
    spark.createDataFrame(arrivals, Q.ARRIVAL).write.parquet(str(tmp_path / "in"))
    seen = spark.sparkContext.accumulator(0)

    def told(h):
        seen.add(1)
        return h

    stream = spark.readStream.schema(Q.ARRIVAL).parquet(str(tmp_path / "in")).withColumn("requestHash", F.udf(told, "string")("requestHash"))
    known = spark.createDataFrame([(f"h{k}", "CACHED" if k % 2 else "GENERATING", 5) for k in range(30, 90)], "requestHash string, requestStatus string, timesRequested long")
    table = Z.catalogue_stream(stream, Q._admit, str(tmp_path / "out"), known, str(tmp_path / "cp"))
    assert seen.value <= 4 * len(arrivals)  # keys, counts, links of cached requests, first users of new ones
    assert {r["requestHash"]: (r["requestStatus"], r["timesRequested"]) for r in table.current().collect()} == {
        f"h{k}": ("GENERATING", 1) if k < 30 else ("CACHED", 9 if k < 60 else 5) if k % 2 else ("GENERATING", 5) for k in range(90)}
    assert spark.read.parquet(str(tmp_path / "out/messages")).count() == 60


def test_state_rows_meet_their_new_values_once(spark, tmp_path):
    schema = T.StructType.fromDDL("k string, v long")
    table = StateTable(spark, str(tmp_path / "state"), "k", schema, 2)
    table.create(spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4), ("c", 5)], schema))
    now = lambda: Counter(map(tuple, table.current().collect()))
    batch = spark.createDataFrame([("a",), ("b",), ("d",), (None,)], "k string")
    after = spark.createDataFrame([("a", 10), ("d", 40), ("x", 99)], schema)
    for _ in range(2):  # repeated, it starts from the same values
        assert Counter(map(tuple, table.before(0, batch).collect())) == Counter([("a", 1), ("b", 2), ("b", 3)])
        table.write(0, batch, after)
        assert now() == Counter([("a", 10), ("d", 40), (None, 4), ("c", 5)])
    assert Counter(map(tuple, table.before(1, batch).collect())) == Counter([("a", 10), ("d", 40)])
    table.write(1, batch, spark.createDataFrame([("b", 7)], schema), table.keys(batch))
    assert now() == Counter([("b", 7), (None, 4), ("c", 5)])


CELLS = {(0, 0): 3.0, (0, 1): 47.0, (0, 3): 21.0, (1, 0): 30.0, (1, 1): None, (1, 2): 12.0, (1, 3): 60.0, (3, 0): 11.0, (3, 1): 11.0, (3, 2): 58.5}


@pytest.mark.parametrize("step", [7.0, 200.0, None])
def test_f11_crossings_of_a_lattice_with_gaps(spark, step):
    rows = []
    for i in (0, 1, 3):
        row = lambda n: [(j, 2.0 * j, v) for (k, j), v in sorted(CELLS.items()) if k == n]
        below = {0: 1, 1: 3}.get(i)
        rows.append((1, step, i, 90.0 - i, row(i), 3.0, 60.0, None if below is None else (below, 90.0 - below, row(below))))
    cell = "array<struct<j:int,lon:double,value:double>>"
    lattice = spark.createDataFrame(rows, f"request_id long, step double, i int, lat double, cells {cell}, vmin double, vmax double, below struct<i:int,lat:double,cells:{cell}>")
    drawn = lattice_crossings(lattice)
    levels = [10 + 7.0 * n for n in range(8)] if step == 7.0 else [3 + 57.0 * n / 4 for n in range(5)]
    want = set()
    for (i, j), a in CELLS.items():
        for edge, b in (("E", CELLS.get((i, j + 1))), ("S", CELLS.get((i + 1, j)))):
            want |= {(edge, v, i, j) for v in levels if None not in (a, b) and (a < v) != (b < v)}
    assert {(r["edge"], r["level"], r["i"], r["j"]) for r in drawn.collect()} == want and want
    # an unfolded cell takes no array of its row along
    kept = re.findall(r"Generate (?:pos)?explode\(.*?\), \[([^\]]*)\]", drawn._jdf.queryExecution().executedPlan().toString())
    assert kept and not any(re.match(r"(cells|same|other|levels|below)#", c.strip()) for k in kept for c in k.split(","))
