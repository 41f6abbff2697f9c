"""Data behind the contour, scatter, combined, formation and surface maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isohypsa.functions.geo import height, lat_of, lon_of
from isohypsa.params import GridSpec
from isohypsa.sources.grid import row_partitions, shuffled
from isohypsa.staging import stage

# Fixed map constants.
HULL_PADDING = 0.3
LABEL_MARGIN = 0.5
MAX_LABEL_LON = 170.0
OMEGA_LABEL_SOUTH = 8.0


def area_filter(df: DataFrame, north: float, west: float, south: float, east: float,
                lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.where(F.col(lat).between(south, north) & F.col(lon).between(west, east))


def area_is_empty(df: DataFrame, keys: list[str], area: DataFrame) -> DataFrame:
    """Keys of ``area`` for which no cell is left: the error rows of the area filter."""
    return area.join(df.select(*keys), keys, "left_anti").withColumn(
        "error", F.lit("no data points within the specified area"),
    )


def time_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd_HH'UTC'")


def date_label(y: Column, m: Column, d: Column, h: Column) -> Column:
    return F.format_string("%04d-%02d-%02d_%02dUTC", y.cast("int"), m.cast("int"), d.cast("int"), h.cast("int"))


def time_select(requests: DataFrame, axis: DataFrame) -> DataFrame:
    """Index of the axis instant whose label equals the requested date; -1 when there is none."""
    wanted = requests.withColumn("label", date_label(F.col("year"), F.col("month"), F.col("day"), F.col("hour")))
    labels = axis.select(F.col("time").alias("time_index"), time_label(F.col("ts")).alias("label"))
    first = labels.groupBy("label").agg(F.min("time_index").alias("time_index"))
    return wanted.join(first, "label", "left").withColumn("time_index", F.coalesce("time_index", F.lit(-1)))


def instant_to_date(results: DataFrame, axis: DataFrame) -> DataFrame:
    return results.join(axis.select("time", time_label(F.col("ts")).alias("label")), "time")


def mask_invalid(df: DataFrame, col: str) -> DataFrame:
    v = F.col(col)
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    return df.withColumn(col, F.when(~bad, v))


def valid_range(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Range of the unmasked values; groups without a finite value are rejected."""
    return df.groupBy(*keys).agg(F.min(col).alias("vmin"), F.max(col).alias("vmax")).where(
        F.col("vmin").isNotNull() & F.col("vmax").isNotNull()
    )


def field_range(field: DataFrame, spec: GridSpec, value: str = "h") -> DataFrame:
    h = height(F.col(value), spec)
    step = spec.contour_step
    r = field.groupBy("time").agg(F.min(h).alias("vmin"), F.max(h).alias("vmax"))
    return r.withColumns({
        "min_contour": (F.col("vmin") - F.col("vmin").cast("int") % step).cast("int") - step,
        "max_contour": (F.col("vmax") - F.col("vmax").cast("int") % step).cast("int") + step,
    })


def contour_bands(field: DataFrame, spec: GridSpec, value: str = "h") -> DataFrame:
    """Cells per band [c, c + step) from the lowest to below the highest bound, empty bands kept."""
    step = spec.contour_step
    h = height(F.col(value), spec)
    per_band = field.withColumn("contour", (F.floor(h / step) * step).cast("int")).groupBy("time", "contour").agg(
        F.count(F.lit(1)).alias("n_points"), F.min(h).alias("lo"), F.max(h).alias("hi"),
    )
    # bands are few: an instant's range and its empty bands follow from them, in one pass over the cells
    bands = per_band.groupBy("time").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.map_from_entries(F.collect_list(F.struct("contour", "n_points"))).alias("known"))
    edge = lambda c, by: (F.col(c) - F.col(c).cast("int") % step).cast("int") + by
    return bands.select("time", "known", F.explode(F.sequence(edge("lo", -step), edge("hi", step) - step, F.lit(step))).alias("contour")).select(
        "time", "contour", F.coalesce(F.try_element_at("known", F.col("contour")), F.lit(0)).alias("n_points"))


def contour_band_points(field: DataFrame, spec: GridSpec, value: str = "h") -> DataFrame:
    """Members of each band as rows, so that no band is gathered in one place."""
    h = height(F.col(value), spec)
    return field.select(
        "time", (F.floor(h / spec.contour_step) * spec.contour_step).cast("int").alias("contour"),
        lat_of(F.col("i"), spec).alias("lat"), lon_of(F.col("j"), spec).alias("lon"), h.alias("height"),
    )


def level_list(vmin: Column, vmax: Column, step: float | Column) -> Column:
    """arange(ceil(vmin / 10) * 10, vmax, step); fewer than two levels -> 5 equally spaced ones."""
    gap = step.cast("double") if isinstance(step, Column) else F.lit(float(step))
    first = F.ceil(vmin.cast("double") / 10) * 10
    n = F.ceil((vmax.cast("double") - first) / gap)
    spaced = F.when(n >= 1, F.transform(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int")),
        lambda k: (first + k * gap).cast("double"),
    )).otherwise(F.array().cast("array<double>"))
    even = F.transform(
        F.sequence(F.lit(0), F.lit(4)), lambda k: vmin.cast("double") + (vmax - vmin).cast("double") * k / 4,
    )
    return F.when(F.size(spaced) < 2, even).otherwise(spaced)


def levels_between(edges: DataFrame, a: Column, b: Column, gap: Column) -> DataFrame:
    """Every edge with each ``level`` of ``level_list(vmin, vmax, gap)`` that parts its ends ``a`` and ``b``, which differ and lie between vmin and vmax.

    Level number n is first + n * gap; arithmetic finds the few numbers near an edge, the comparison decides."""
    start = F.ceil(F.col("vmin").cast("double") / 10) * 10
    count = F.ceil((F.col("vmax").cast("double") - start) / gap)
    even = F.coalesce(count < 2, F.lit(True))
    placed = edges.withColumns({
        "_even": even, "_first": F.when(even, F.col("vmin").cast("double")).otherwise(start), "_count": F.when(even, 5).otherwise(count).cast("int"),
        "_gap": F.when(even, (F.col("vmax") - F.col("vmin")) / F.lit(4.0)).otherwise(gap),
    })
    lo = F.greatest(F.floor((F.least(a, b) - F.col("_first")) / F.col("_gap")), F.lit(0)).cast("int")
    hi = F.least(F.ceil((F.greatest(a, b) - F.col("_first")) / F.col("_gap")), F.col("_count") - 1).cast("int")
    level = F.when(F.col("_even"), F.col("vmin").cast("double") + (F.col("vmax") - F.col("vmin")).cast("double") * F.col("_n") / 4).otherwise(F.col("_first") + F.col("_n") * F.col("_gap"))
    crossed = placed.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi").withColumn("_n", F.explode(F.sequence("_lo", "_hi"))).withColumn("level", level)
    return crossed.where((a < F.col("level")) != (b < F.col("level")))


def crop_window(spec: GridSpec, area: tuple[float, float, float, float] | None) -> tuple[int, int, int, int]:
    """First and last row and column of the cells inside (north, west, south, east)."""
    if area is None:
        return 0, spec.nlat - 1, 0, spec.nlon - 1
    north, west, south, east = area
    near = 1e-9
    return (max(0, math.ceil((90 - north) / spec.res - near)), min(spec.nlat - 1, math.floor((90 - south) / spec.res + near)),
            max(0, math.ceil((west + 180) / spec.res - near)), min(spec.nlon - 1, math.floor((east + 180) / spec.res + near)))


def isoline_crossings(slices: DataFrame, spec: GridSpec, step: float, area: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Linear crossing points of every contour level with the grid edges inside the area.

    Slices are cropped to the area first; range, levels (``level_list``, five equally spaced ones on a flat
    slice) and edges, with both ends inside, follow from the crop. Neighbours are read from the slice itself and
    an instant's range is that of its array: nothing is shuffled. Edge E joins (i, j)-(i, j+1), edge S (i, j)-(i+1, j).
    """
    i0, i1, j0, j1 = crop_window(spec, area)
    width, n = max(j1 - j0 + 1, 0), max(i1 - i0 + 1, 0) * max(j1 - j0 + 1, 0)
    if not n:
        i0 = i1 = j0 = j1 = 0
        width = n = 1
        slices = slices.limit(0)
    cropped = slices.select("time", F.flatten(F.transform(
        F.sequence(F.lit(i0), F.lit(i1)), lambda i: F.slice(F.col("vals"), i * spec.nlon + j0 + 1, F.lit(width)))).alias("vals"))
    nothing = F.lit(None).cast("int")
    around = F.arrays_zip(
        F.col("vals").alias("a"),
        F.concat(F.slice("vals", 2, n), F.array(nothing)).alias("east"),
        F.concat(F.slice("vals", width + 1, n), F.array_repeat(nothing, width)).alias("south"),
    )
    cells = cropped.select(
        "time", F.array_min("vals").alias("vmin"), F.array_max("vals").alias("vmax"), around.alias("cells"),
    ).select("time", "vmin", "vmax", F.posexplode("cells").alias("at", "c"))
    j = F.col("at") % width
    edges = cells.select(
        "time", "vmin", "vmax", F.col("c.a").alias("a"),
        (F.floor(F.col("at") / width) + i0).cast("int").alias("i"), (j + j0).cast("int").alias("j"),
        F.explode(F.array(
            F.struct(F.lit("E").alias("edge"), F.when(j < width - 1, F.col("c.east")).alias("b")),
            F.struct(F.lit("S").alias("edge"), F.col("c.south").alias("b")),
        )).alias("e"),
    ).select("time", "vmin", "vmax", "i", "j", "a", "e.edge", "e.b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    crossed = levels_between(edges, F.col("a"), F.col("b"), F.lit(float(step)))
    t = (F.col("level") - F.col("a")) / (F.col("b") - F.col("a"))
    return crossed.select(
        "time", "i", "j", "edge", F.col("level").cast("double").alias("level"),
        (lat_of(F.col("i"), spec) - F.when(F.col("edge") == "S", t * spec.res).otherwise(0.0)).alias("lat"),
        (lon_of(F.col("j"), spec) + F.when(F.col("edge") == "E", t * spec.res).otherwise(0.0)).alias("lon"),
    )


def surface_grid(field: DataFrame, spec: GridSpec, value: str = "h") -> DataFrame:
    """Dense lattice per instant, NULL where the field has no cell. The lattice is generated from
    the instants present (one row each), not by crossing tables.

    Both sides are dealt by cell into partitions whose number follows the instants, so a task sorts no more cells of a longer field."""
    keys = ["time", "i", "j"]
    times = stage(field.select("time").distinct(), "instants")
    # stated numbers: an instant is a few bytes and becomes a whole lattice, and cells shrink so well that partitions merged by bytes hold very many
    n = row_partitions(field.sparkSession, times.count() * spec.n_cells)
    lattice = times.repartition(n).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.lit(spec.nlat - 1))),
    ).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(spec.nlon - 1)))).repartition(n, *keys)
    cells = field.select(*keys, F.col(value).alias("value")).repartition(n, *keys)
    return lattice.join(shuffled(cells), keys, "left").select(
        "time", lat_of(F.col("i"), spec).alias("lat"), lon_of(F.col("j"), spec).alias("lon"), "value",
    )


def formation_members(formations: DataFrame, points: DataFrame, keys: list[str] | tuple[str, ...] = ("time",)) -> DataFrame:
    """Points of the partners of each formation; the second minimum counts only for OMEGA. Clusters are numbered within ``keys``."""
    ids = formations.select(
        *keys, "max_id", F.col("type").alias("form_type"),
        F.explode(F.array_compact(F.array(
            F.struct(F.lit("max").alias("role"), F.col("max_id").alias("cluster")),
            F.struct(F.lit("min1").alias("role"), F.col("min1_id").alias("cluster")),
            F.when(F.col("type") == "OMEGA", F.struct(F.lit("min2").alias("role"), F.col("min2_id").alias("cluster"))),
        ))).alias("m"),
    ).select(*keys, "max_id", "form_type", "m.role", "m.cluster")
    return ids.join(points, [*keys, "cluster"])


def unwrap_set(df: DataFrame, keys: list[str], lon: str = "lon", out: str = "lon_unwrapped") -> DataFrame:
    """Within a group spanning 180 degrees or more, negative longitudes gain 360."""
    span = df.groupBy(*keys).agg((F.max(lon) - F.min(lon)).alias("_span"))
    return df.join(span, keys).withColumn(
        out, F.when((F.col("_span") >= 180) & (F.col(lon) < 0), F.col(lon) + 360).otherwise(F.col(lon)),
    ).drop("_span")


def _hull(pdf: pd.DataFrame) -> pd.DataFrame:
    """Monotone-chain convex hull of one formation's points, pushed out from the vertex mean."""
    lon, lat = pdf["lon"].to_numpy(), pdf["lat"].to_numpy()
    if lon.max() - lon.min() >= 180:
        lon = np.where(lon < 0, lon + 360, lon)
    pts = np.unique(np.column_stack([lon, lat]), axis=0)

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1:
                (ax, ay), (bx, by) = out[-2], out[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                out.pop()
            out.append(p)
        return out[:-1]

    ring = np.array(half(pts) + half(pts[::-1])) if len(pts) > 2 else pts
    ring = ring + HULL_PADDING * (ring - ring.mean(axis=0))
    return pd.DataFrame({
        "time": pdf["time"].iloc[0], "max_id": pdf["max_id"].iloc[0],
        "vertex": np.arange(len(ring)), "lat": ring[:, 1], "lon": ring[:, 0],
    })


def formation_hull(members: DataFrame) -> DataFrame:
    """Hull vertices per formation; a group is one formation's clusters (bounded by the lattice)."""
    return members.select("time", "max_id", "lat", "lon").groupBy("time", "max_id").applyInPandas(
        _hull, "time int, max_id int, vertex int, lat double, lon double",
    )


def formation_label(members: DataFrame, keys: list[str] | tuple[str, ...] = ("time",)) -> DataFrame:
    """Position of the type label of each formation and its number of points. Both readings of the
    longitudes (plain and unwrapped) are kept in one aggregation, the span picks one afterwards."""
    lon = F.col("lon")
    east = F.when(lon < 0, lon + 360).otherwise(lon)
    ranges = members.groupBy(*keys, "max_id", "form_type").agg(
        F.min(lon).alias("_lo"), F.max(lon).alias("_hi"), F.min(east).alias("_elo"), F.max(east).alias("_ehi"),
        ((F.min("lat") + F.max("lat")) / 2).alias("_mid"), F.count(F.lit(1)).alias("n_points"),
    )
    wide = F.col("_hi") - F.col("_lo") >= 180
    mid_lon = F.when(wide, F.col("_elo") + F.col("_ehi")).otherwise(F.col("_lo") + F.col("_hi")) / 2
    south = F.when(F.col("form_type") == "OMEGA", OMEGA_LABEL_SOUTH).otherwise(0.0)
    return ranges.select(
        *keys, "max_id", "form_type", (F.col("_mid") - south).alias("label_lat"),
        F.least(mid_lon, F.lit(MAX_LABEL_LON)).alias("label_lon"), "n_points",
    )


def group_label(members: DataFrame) -> DataFrame:
    """Position of each partner's id: its first northernmost point in scan order plus a margin."""
    first = F.min(F.struct((-F.col("lat")).alias("south"), F.col("scan").alias("scan"), F.col("lon").alias("lon")))
    return members.groupBy("time", "max_id", "role", "cluster").agg(first.alias("p")).select(
        "time", "max_id", "role", "cluster",
        (-F.col("p.south") + LABEL_MARGIN).alias("label_lat"), (F.col("p.lon") + LABEL_MARGIN).alias("label_lon"),
    )


def overlay(contours: DataFrame, points: DataFrame) -> DataFrame:
    return contours.withColumn("layer", F.lit("contour")).unionByName(
        points.withColumn("layer", F.lit("points")), allowMissingColumns=True,
    )


def order_points(points: DataFrame) -> DataFrame:
    """Maxima before minima; among minima ascending latitude."""
    return points.orderBy(*order_key())


def order_key() -> list[Column]:
    return [F.col("type"), F.when(F.col("type") == "MIN", F.col("lat"))]


def rank_within(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def find_index(df: DataFrame, value: str, axis: DataFrame, axis_value: str, axis_index: str, out: str = "idx") -> DataFrame:
    """Exact position of a value on an axis, -1 when absent. Axes are bounded by the grid."""
    a = axis.select(F.col(axis_value).alias("_v"), F.col(axis_index).alias(out))
    return df.join(F.broadcast(a), F.col(value).cast("float") == F.col("_v"), "left").drop("_v").withColumn(
        out, F.coalesce(out, F.lit(-1)),
    )
