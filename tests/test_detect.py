"""Detection on hand-made grids with known formations, and twins that must agree."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from isohypsa.operators import formations as B
from isohypsa.operators import rays as R
from isohypsa.operators.components import label_components
from isohypsa.operators.extrema import votes_by_join, votes_from_slices
from isohypsa.params import GridSpec
from isohypsa.plans.detect import cluster_extrema, detect_blocking, heat_clusters
from isohypsa.registry.inputs import SCENARIOS, SPEC, synth_field
from isohypsa.sources.grid import PACKING, from_slices, rejected_cells, to_slices

FLAT = (0, 60.0, 0.0, 9.0, 9.0)
CASES = [
    *SCENARIOS,
    [(300, 60.0, 0.0, 9.0, 16.0), FLAT, FLAT],
    [(330, 60.0, 170.0, 9.0, 16.0), (-170, 47.5, 145.0, 7.0, 10.0), (-170, 47.5, -165.0, 7.0, 10.0)],
]
MAX_CELLS = [1590, 1585, 1462, 1590, 1603]
KEPT = {
    (0, 0, "MAX", 6, 60.0, 0.0, 5920), (0, 1, "MIN", 6, 50.0, -25.0, 5560), (0, 2, "MIN", 6, 50.0, 25.0, 5560),
    (1, 0, "MAX", 8, 60.0, -2.5, 5880), (1, 1, "MAX", 8, 52.5, -30.0, 5800), (1, 2, "MIN", 6, 45.0, -2.5, 5600),
    (2, 0, "MAX", 7, 60.0, 0.0, 5900), (2, 1, "MAX", 6, 52.5, -50.0, 5960), (2, 2, "MIN", 6, 45.0, 0.0, 5560),
    (3, 0, "MAX", 6, 60.0, 0.0, 5900),
    (4, 0, "MAX", 6, 60.0, 170.0, 5920), (4, 1, "MAX", 13, 50.0, -180.0, 5620),
    (4, 2, "MIN", 6, 50.0, -165.0, 5560), (4, 3, "MIN", 6, 50.0, 145.0, 5560),
}
FORMATIONS = {(0, 0, 1, 2, "OMEGA"), (1, 0, 2, -1, "REX"), (2, 0, 2, -1, "REX")}


@pytest.fixture(scope="module")
def field(spark):
    params = spark.range(len(CASES)).select(F.col("id").cast("int").alias("time"), F.lit(5).cast("bigint").alias("s"))
    return synth_field(params, SPEC, CASES).cache()


@pytest.fixture(scope="module")
def found(field):
    return cluster_extrema(field, SPEC, staged=True)


def test_scenarios(field, found):
    ex = found.extrema.where("type = 'MAX'").groupBy("time").count().orderBy("time").collect()
    assert [r["count"] for r in ex] == MAX_CELLS
    kept = found.clusters.select("time", "id", "type", "n_points", "center_lat", "center_lon", "contour").collect()
    assert {tuple(r) for r in kept} == KEPT
    forms = found.formations().select("time", "max_id", "min1_id", "min2_id", "type").collect()
    assert {tuple(r) for r in forms} == FORMATIONS


def test_slices_round_trip_with_holes_and_duplicates(spark, field):
    holey = field.where("(i * 7 + j) % 5 <> 0 AND i <> 11")
    again = from_slices(to_slices(holey.unionByName(holey), SPEC), SPEC).where("h IS NOT NULL")
    assert again.exceptAll(holey).isEmpty() and holey.exceptAll(again).isEmpty()


@pytest.mark.parametrize("spec", [
    replace(SPEC, step=3), replace(SPEC, compat=False), replace(SPEC, lat_min=25, step=2),
])
def test_sampling_twins(field, spec):
    f = field.where("time < 2 AND (i * 5 + j) % 41 <> 0")
    a = votes_from_slices(to_slices(f, spec), spec).select("time", "x", "y", "n_ge", "n_le")
    b = votes_by_join(f, spec).select("time", "x", "y", "n_ge", "n_le")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_packed_minus_one_counts_as_missing(spark, field):
    scale, offset, _ = PACKING["z"]
    spec = replace(SPEC, scale=scale, offset=offset)
    f = field.where("time = 0").select("time", "i", "j", F.lit(-1).alias("h"))
    v = votes_from_slices(to_slices(f, spec), spec).agg(F.min("n_ge"), F.max("n_le")).collect()[0]
    assert tuple(v) == (64, 0)
    loose = replace(spec, compat=False)
    v = votes_from_slices(to_slices(f, loose), loose).agg(F.max("n_le")).collect()[0]
    assert v[0] == 64


def test_ray_forms_agree(field, found):
    a = found.reach.select("time", "id", "ray", "reach")
    b = R.ray_reach_from_cells(R.ray_cells(found.clusters, field, SPEC)).select("time", "id", "ray", "reach")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_mirrored_field_swaps_west_and_east(field, found):
    mirrored = field.withColumn("j", (F.lit(2 * SPEC.west) - F.col("j")) % SPEC.nlon).where("time = 0")
    here = found.clusters.where("time = 0").select("center_lat", "center_lon", "w_lon", "e_lon", "type")
    there = cluster_extrema(mirrored, SPEC).clusters.select(
        "center_lat", (-F.col("center_lon")).alias("center_lon"), (-F.col("e_lon")).alias("w_lon"),
        (-F.col("w_lon")).alias("e_lon"), "type")
    norm = [F.col(c) + F.lit(0.0) if c != "type" else F.col(c) for c in here.columns]
    assert sorted(map(tuple, here.select(*norm).collect())) == sorted(map(tuple, there.select(*norm).collect()))


def flood(cells, nx, ny):
    seen, out = {}, {}
    for p in sorted(cells):
        if p in seen:
            continue
        todo, root = [p], p[0] * ny + p[1]
        seen[p] = root
        while todo:
            x, y = todo.pop()
            for q in ((x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if q in cells and q not in seen and cells[q] == cells[(x, y)]:
                    seen[q] = root
                    todo.append(q)
    out.update(seen)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_flood_fill(spark, seed):
    rnd = random.Random(seed)
    nx, ny = 14, 17
    want, rows = {}, []
    for t in range(4):
        cells = {(x, y): rnd.choice(["MAX", "MIN"]) for x in range(nx) for y in range(ny) if rnd.random() < 0.3 + 0.15 * t}
        rows += [(t, x, y, k) for (x, y), k in cells.items()]
        want.update({(t, *p): r for p, r in flood(cells, nx, ny).items()})
    pts = spark.createDataFrame(rows, "time int, x int, y int, type string")
    for method in ("slice", "relational"):
        got = {(r.time, r.x, r.y): r.root for r in label_components(pts, nx, ny, method).collect()}
        assert got == want, method


def km(a, b):
    import math
    la1, lo1, la2, lo2 = (v * math.pi / 180 for v in (*a, *b))
    s = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return round(6371 * 2 * math.atan2(math.sqrt(s), math.sqrt(1 - s)), 6)


def plain_fold(top, cands):
    import numpy as np
    far = (-1, (float(np.float32(1e30)),) * 2)
    score, west, east = 1e30, far, far
    for _, mid, side, lat, lon in sorted(cands):
        p = (lat, lon)
        other = east if side == "WEST" else west
        if side == "EAST" and not lat < east[1][0]:
            continue
        mean = (km(p, top) + km(p, other[1]) + km(other[1], top)) / 3
        s = mean * (1 - 0.05) if lat < other[1][0] else mean
        if s < score:
            score = mean
            if side == "WEST":
                west = (mid, p)
            else:
                east = (mid, p)
    return west[0], east[0]


def test_omega_fold_against_loop(spark):
    rnd = random.Random(7)
    rows, want = [], {}
    for g in range(60):
        top = (rnd.randrange(50, 75, 5) * 1.0, rnd.randrange(-30, 30, 5) * 1.0)
        cands = []
        for k in range(rnd.randint(1, 4)):
            for mid in range(1, rnd.randint(2, 5)):
                lat, lon = top[0] - rnd.randrange(0, 25, 5), top[1] + rnd.choice([-25.0, -15.0, 15.0, 25.0])
                cands.append((k, mid, "WEST" if lon < top[1] else "EAST", lat, lon))
        # one row per (level, id), as the joins produce
        cands = list({(c[0], c[1]): c for c in cands}.values())
        rows += [(0, g, c[0], c[1], c[2], *top, c[3], c[4]) for c in cands]
        want[g] = plain_fold(top, cands)
    df = spark.createDataFrame(rows, "time int, max_id int, first_k int, min_id int, side string, max_center_lat double, max_center_lon double, min_center_lat double, min_center_lon double")
    got = {r.max_id: (r.west_id, r.east_id) for r in B.omega_fold(df).collect()}
    assert got == want
    assert any(w >= 0 and e >= 0 for w, e in want.values()) and any(w < 0 <= e for w, e in want.values())


def test_rex_wins_and_both_sides_needed(spark):
    omega = spark.createDataFrame([(0, 1, 2, 3), (0, 4, 5, -1), (0, 6, 7, 8)], "time int, max_id int, west_id int, east_id int")
    rex = spark.createDataFrame([(0, 1, 9), (0, 10, 11)], "time int, max_id int, rex_id int")
    got = {tuple(r) for r in B.resolve(omega, rex).collect()}
    assert got == {(0, 1, 9, -1, "REX"), (0, 6, 7, 8, "OMEGA"), (0, 10, 11, -1, "REX")}


def test_rex_tie_takes_the_earlier(spark):
    c = spark.createDataFrame([(0, 0, 2, 5900, 3, 10.0), (0, 0, 1, 5880, 4, 10.0), (0, 0, 1, 5880, 2, 11.0)],
                              "time int, max_id int, first_k int, level int, min_id int, km double")
    assert B.rex_nearest(c).collect()[0].rex_id == 4


def test_centre_at_plus_180(spark):
    """The cut-off of a centre at +180 starts one column west of column 0."""
    one = spark.createDataFrame([(0, 0, "MIN", 50.0, 180.0)], "time int, id int, type string, center_lat double, center_lon double")
    plan = {(r.dx, r.dy): r.k_max for r in R.ray_plan(one, SPEC).collect()}
    assert all(k == 0 for (dx, dy), k in plan.items() if dy <= 0)
    assert plan[(0, 1)] >= 10
    top = one.withColumn("type", F.lit("MAX"))
    sl = spark.range(1).select(F.lit(0).alias("time"), F.array_repeat(F.lit(5800), SPEC.n_cells).alias("vals"))
    assert R.north_walk(top, sl, SPEC).isEmpty()


def test_heat_clusters(spark):
    spec = GridSpec(res=2.5, step=3, lat_min=0)
    hot = {(3, 3), (6, 6), (3, 60)}
    f = spark.range(spec.n_cells).select(
        F.lit(0).alias("time"), F.floor(F.col("id") / spec.nlon).cast("int").alias("i"), (F.col("id") % spec.nlon).cast("int").alias("j"))
    cond = F.lit(False)
    for i, j in hot:
        cond = cond | ((F.col("i") == i) & (F.col("j") == j))
    f = f.withColumn("raw", F.when(cond, 1000).otherwise(0))
    got = heat_clusters(f, spec, 0.03, 273.15).collect()
    by = {(r.latitude, r.longitude): r.cluster for r in got}
    assert len(by) == 3 and by[(82.5, -172.5)] == by[(75.0, -165.0)] == 0 and by[(82.5, -30.0)] == 1


def test_finer_lattices_run_and_agree_with_the_join(spark):
    """The lattice of every cell, and a grid of another resolution: one plan for all."""
    for spec in (GridSpec(res=2.5, step=1, lat_min=-40), GridSpec(res=1.25, step=2, lat_min=0), GridSpec(res=0.5, step=12, lat_min=30, n_bearings=8)):
        f = synth_field(spark.range(2).select(F.col("id").cast("int").alias("time"), (F.col("id") + 4).alias("s")), spec)
        a = votes_from_slices(to_slices(f, spec), spec).select("time", "x", "y", "n_ge", "n_le")
        b = votes_by_join(f, spec).select("time", "x", "y", "n_ge", "n_le")
        assert a.count() == 2 * spec.n_coarse and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert GridSpec(step=1).n_coarse * 64 == 24_053_760
    assert {r["type"] for r in detect_blocking(f, spec).collect()} <= {"OMEGA", "REX"}


def test_slices_shuffle_the_field_once(spark, field):
    text = to_slices(field, SPEC)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(time") == 1 and "hashpartitioning(time#" in text


def test_rejected_cells(spark):
    f = spark.createDataFrame([(0, 0, 0, 5), (0, 0, 0, 4), (0, 99, 0, 1), (0, None, 0, 1)], "time int, i int, j int, h int")
    got = {(r.i, r.value, r.reason) for r in rejected_cells(f, SPEC).collect()}
    assert got == {(0, 4, "1 more values"), (99, 1, "off grid"), (None, 1, "off grid")}


def test_plans_do_not_cross_join(spark, field):
    text = detect_blocking(field, SPEC)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    votes = votes_from_slices(to_slices(field, SPEC), SPEC)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in votes and "CartesianProduct" not in votes and "NestedLoop" not in votes
