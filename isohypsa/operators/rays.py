"""Lattice rays around cluster centres and the contour tests built on them.

A ray crosses contour c exactly when the lowest (around a MAX) or highest (around a MIN) height of
its in-range part passes c. So one extreme per (cluster, ray) - its *reach* - answers every
contour, and the closed / all / majority tests reduce to one threshold each per cluster.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohypsa.functions.clock import clock
from isohypsa.functions.geo import col_of, contour_level, haversine_km, height, lat_of, lon_of, row_of
from isohypsa.params import EARTH_RADIUS_KM, GridSpec
from isohypsa.sources.grid import shuffled

N_RAYS = 64
SECTOR_SIZE = 17
MAJORITY = SECTOR_SIZE // 2 + 1
# sector -> condition on (dx = rows southward, dy = columns eastward)
SECTORS = {
    "bottom": "dx > 0 AND dy BETWEEN -1 AND 1",
    "top": "dx < 0 AND dy BETWEEN -1 AND 1",
    "left": "dy < 0 AND dx BETWEEN -1 AND 1",
    "right": "dy > 0 AND dx BETWEEN -1 AND 1",
}


def rays() -> list[tuple[int, int]]:
    """(dx, dy) of the 64 rays in order: the four axes, and all steps of which one coordinate has size 1 and the other
    size 1 to 8."""
    steps = product(range(-8, 9), repeat=2)
    return [(dx, dy) for dx, dy in steps if 1 in (min(abs(dx), abs(dy)), abs(dx) + abs(dy))]


def ray_column() -> Column:
    """The rays as one array literal, to be exploded beside any row."""
    items = ", ".join(
        f"named_struct('ray', {n}, 'dx', {dx}, 'dy', {dy})" for n, (dx, dy) in enumerate(rays())
    )
    return F.expr(f"array({items})")


def direction_set(df: DataFrame) -> DataFrame:
    """Every row with each of the 64 rays (``ray``, ``dx``, ``dy``)."""
    return df.withColumn("_r", F.explode(ray_column())).select("*", "_r.*").drop("_r")


def in_sector(sector: str) -> Column:
    return F.expr(SECTORS[sector])


def ray_cutoff(spark: SparkSession, spec: GridSpec) -> DataFrame:
    """(row, edge, ray) -> number of steps before the first out-of-bounds row or step beyond the
    search radius. ``edge = 1`` is the centre at +180, which starts one column west of column 0.
    Bounded by the grid: 2 x rows x 64."""
    step_km = EARTH_RADIUS_KM * spec.res * math.pi / 180
    # a step changes |dx| rows: beyond this many rows the meridian distance alone is too far
    far_rows = int(spec.search_km / step_km) + 2
    walked = (
        direction_set(spark.range(spec.nlat * 2).select(
            F.floor(F.col("id") / 2).cast("int").alias("ci"), (F.col("id") % 2).cast("int").alias("edge"),
        ))
        .withColumn("k", F.explode(F.sequence(
            F.lit(1),
            F.when(F.col("dx") == 0, F.lit(spec.nlon)).otherwise(
                F.ceil(F.lit(far_rows) / F.abs("dx")).cast("int") + 1,
            ).cast("int"),
        )))
    )
    row = F.col("ci") + F.col("k") * F.col("dx")
    dlon = (F.col("k") * F.col("dy") - F.col("edge")) * F.lit(float(spec.res))
    km = haversine_km(lat_of(F.col("ci"), spec), F.lit(0.0), lat_of(row, spec), dlon)
    stop = (row < 0) | (row >= F.lit(spec.row_limit - 1)) | (km > spec.search_km)
    return walked.groupBy("ci", "edge", "ray", "dx", "dy").agg(
        (F.coalesce(F.min(F.when(stop, F.col("k"))), F.max("k") + 1) - 1).cast("int").alias("k_far"),
    )


def steps_in_range(cj: Column) -> Column:
    """Steps allowed by both the cut-off row and the column bounds of the grid; needs columns
    ``k_far``, ``dy`` and ``nlon``."""
    east = F.floor((F.col("nlon") - 1 - cj) / F.col("dy")).cast("int")
    west = F.floor(cj / -F.col("dy")).cast("int")
    bound = F.when(F.col("dy") > 0, east).when(F.col("dy") < 0, F.greatest(west, F.lit(0)))
    return F.when(F.col("dy") < 0, F.when(cj < 0, 0).otherwise(F.least("k_far", bound))).when(
        F.col("dy") > 0, F.least("k_far", bound),
    ).otherwise(F.when(cj < 0, 0).otherwise(F.col("k_far")))


def with_center_cell(clusters: DataFrame, spec: GridSpec) -> DataFrame:
    return clusters.withColumns({
        "ci": row_of(F.col("center_lat"), spec),
        "cj": col_of(F.col("center_lon"), spec),
    }).withColumn("edge", F.when(F.col("cj") < 0, 1).otherwise(0))


def ray_plan(clusters: DataFrame, spec: GridSpec) -> DataFrame:
    """Each cluster with its 64 rays and their in-range lengths."""
    cut = ray_cutoff(clusters.sparkSession, spec)
    rays = with_center_cell(clusters, spec).join(F.broadcast(cut), ["ci", "edge"])
    return rays.withColumn("nlon", F.lit(spec.nlon)).withColumn("k_max", steps_in_range(F.col("cj"))).drop("nlon")


def ray_cells(clusters: DataFrame, field: DataFrame, spec: GridSpec, value: str = "h") -> DataFrame:
    """Every in-range cell of every ray with its height, by equi-join on (time, i, j)."""
    cells = (
        ray_plan(clusters, spec).where("k_max >= 1")
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("k_max"))))
        .withColumns({
            "i": F.col("ci") + F.col("k") * F.col("dx"),
            "j": F.col("cj") + F.col("k") * F.col("dy"),
        })
    )
    return cells.join(
        shuffled(field.select("time", "i", "j", height(F.col(value), spec).alias("cell_h"))), ["time", "i", "j"],
    )


def ray_reach_from_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy("time", "id", "type", "ray", "dx", "dy").agg(
        F.when(F.col("type") == "MAX", F.min("cell_h")).otherwise(F.max("cell_h")).alias("reach"),
    )


def _by_instant(clusters: DataFrame, *cols: str) -> DataFrame:
    """Cluster rows of an instant (few, bounded by the lattice) in one array, to travel to their
    slice; the large side of that join is never expanded."""
    return clusters.groupBy("time").agg(F.collect_list(F.struct(*cols)).alias("cs"))


def _rays_by_instant(clusters: DataFrame, spec: GridSpec) -> DataFrame:
    rays = ray_plan(clusters, spec).where("k_max >= 1").groupBy("time", "id", "type", "ci", "cj").agg(
        F.collect_list(F.struct("ray", "dx", "dy", "k_max")).alias("rays"),
    )
    return _by_instant(rays, "id", "type", "ci", "cj", "rays")


def _walk_rays(cs: str, spec: GridSpec) -> Column:
    """Every ray of every cluster in ``cs`` with the extreme packed value it meets."""
    def one_ray(c: Column, r: Column) -> Column:
        seen = F.transform(
            F.sequence(F.lit(1), r["k_max"]),
            lambda k: F.get("vals", (c["ci"] + k * r["dx"]) * spec.nlon + c["cj"] + k * r["dy"]),
        )
        far = F.when(c["type"] == "MAX", F.array_min(seen)).otherwise(F.array_max(seen))
        return F.struct(
            c["id"].alias("id"), c["type"].alias("type"), r["ray"].alias("ray"), r["dx"].alias("dx"),
            r["dy"].alias("dy"), far.alias("far"),
        )

    return F.flatten(F.transform(cs, lambda c: F.transform(c["rays"], lambda r: one_ray(c, r))))


def reach_rows(walked: DataFrame, spec: GridSpec) -> DataFrame:
    """Reach rows from (time, rs)."""
    reach = walked.select("time", F.explode("rs").alias("r")).select("time", "r.*").where("far IS NOT NULL")
    # height grows with the packed value, so the extreme of the heights is the height of the extreme
    return reach.select("time", "id", "type", "ray", "dx", "dy", height(F.col("far"), spec).alias("reach"))


def ray_reach(clusters: DataFrame, slices: DataFrame, spec: GridSpec) -> DataFrame:
    """Reach of each (cluster, ray), reading the slice by index.

    The walk is a nested transform over the arrays of one slice row: exploding rays or steps next
    to the slice would copy it for every step."""
    walked = slices.join(_rays_by_instant(clusters, spec), "time").select("time", _walk_rays("cs", spec).alias("rs"))
    return reach_rows(walked, spec)


def hit(reach: Column, kind: Column, level: Column) -> Column:
    return F.coalesce(F.when(kind == "MAX", reach < level).otherwise(reach > level), F.lit(False))


def thresholds(reach: DataFrame) -> DataFrame:
    """Per cluster, in units of sign * height (sign = +1 for MAX, -1 for MIN), the value that
    sign * level must exceed for each test; infinity when the test can never pass."""
    key = F.when(F.col("type") == "MAX", F.col("reach")).otherwise(-F.col("reach")).cast("double")
    inf = F.lit(float("inf"))
    aggs = [F.when(F.count(F.lit(1)) == N_RAYS, F.max(key)).otherwise(inf).alias("closed_at")]
    for s in SECTORS:
        inside = F.when(in_sector(s), key)
        aggs += [
            F.when(F.count(inside) == SECTOR_SIZE, F.max(inside)).otherwise(inf).alias(f"{s}_all"),
            # at most 17 values per cluster and sector
            F.coalesce(F.get(F.sort_array(F.collect_list(inside)), F.lit(MAJORITY - 1)), inf).alias(f"{s}_most"),
        ]
    return reach.groupBy("time", "id", "type").agg(*aggs)


def passes(test: str, level: Column, kind: Column, table: str | None = None) -> Column:
    t = F.col(f"{table}.{test}" if table else test)
    return t < F.when(kind == "MAX", level).otherwise(-level)


def contour_tests(reach: DataFrame, levels: DataFrame) -> DataFrame:
    """Direct form of the closed / all / majority tests for (time, id, level) rows."""
    j = levels.join(reach, ["time", "id"])
    h = hit(F.col("reach"), F.col("type"), F.col("level"))
    aggs = [(F.sum(h.cast("int")) == N_RAYS).alias("closed")]
    for s in SECTORS:
        n = F.sum((h & in_sector(s)).cast("int"))
        aggs += [(n == SECTOR_SIZE).alias(f"{s}_all"), (n > SECTOR_SIZE - n).alias(f"{s}_most")]
    return j.groupBy("time", "id", "type", "level").agg(*aggs)


def _maxima_by_instant(clusters: DataFrame, spec: GridSpec) -> DataFrame:
    maxima = with_center_cell(clusters.where(F.col("type") == "MAX"), spec).where(
        (F.col("cj") >= 0) & (F.col("ci") <= F.lit(spec.row_limit - 1))
    )
    return _by_instant(maxima, "id", "ci", "cj")


def _walk_north(cs: str, spec: GridSpec) -> Column:
    """The packed values met north of every centre in ``cs`` within the search radius."""
    step_km = EARTH_RADIUS_KM * spec.res * math.pi / 180
    most = int(spec.search_km / step_km) + 1

    # the distance grows with k along a meridian, so a count of rows equals "stop at the first
    # violation"; it depends on k only through the latitude difference
    def in_reach(c: Column, k: Column) -> Column:
        lat = lat_of(c["ci"], spec)
        return haversine_km(lat, F.lit(0.0), lat_of(c["ci"] - k, spec), F.lit(0.0)) <= spec.search_km

    def walk(c: Column) -> Column:
        ks = F.filter(F.sequence(F.lit(0), F.least(c["ci"], F.lit(most))), lambda k: in_reach(c, k))
        return F.transform(ks, lambda k: F.struct(
            c["id"].alias("id"), k.alias("k"),
            F.get("vals", (c["ci"] - k) * spec.nlon + c["cj"]).alias("raw"),
        ))

    return F.flatten(F.transform(cs, walk))


def level_rows(walked: DataFrame, spec: GridSpec) -> DataFrame:
    """Levels in first-visit order from (time, ws)."""
    seen = walked.select("time", F.explode("ws").alias("w")).where("w.raw IS NOT NULL").select(
        "time", "w.id", "w.k", contour_level(height(F.col("w.raw"), spec), spec.contour_step).alias("level"),
    )
    return seen.groupBy("time", "id", "level").agg(F.min("k").alias("first_k"))


def north_walk(clusters: DataFrame, slices: DataFrame, spec: GridSpec) -> DataFrame:
    """Distinct contour levels met walking north from each MAX centre, in first-visit order."""
    walked = slices.join(_maxima_by_instant(clusters, spec), "time").select("time", _walk_north("cs", spec).alias("ws"))
    return level_rows(walked, spec)


def walks(clusters: DataFrame, slices: DataFrame, spec: GridSpec, measured: bool = False) -> DataFrame:
    """Both walks of an instant from one meeting of its slice with its clusters: ``rs`` for ``reach_rows``, ``ws`` for ``level_rows``.

    The slices, the largest table of the search, move (or are read) once. ``measured`` keeps the instants without clusters and adds
    ``took``, the nanoseconds that the walks of the instant took in its task."""
    met = _rays_by_instant(clusters, spec).withColumnRenamed("cs", "r_cs").join(
        _maxima_by_instant(clusters, spec).withColumnRenamed("cs", "m_cs"), "time", "full_outer")
    joined = slices.join(met, "time", "left" if measured else "inner")
    both = [_walk_rays("r_cs", spec).alias("rs"), _walk_north("m_cs", spec).alias("ws")]
    if not measured:
        return joined.select("time", *both)
    # the fields of a struct are evaluated in order
    each = joined.select("time", F.struct(clock().alias("began"), *both, clock().alias("ended")).alias("w"))
    return each.select("time", "w.rs", "w.ws", (F.col("w.ended") - F.col("w.began")).alias("took"))
