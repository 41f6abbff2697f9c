"""Cluster rows from labelled points: summary, extremes, centre, filtering and numbering."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isohypsa.functions.geo import contour_level, height, lat_of, lon_of, rad, snap
from isohypsa.params import GridSpec
from isohypsa.sources.grid import shuffled

# Unit-vector components are summed as integers of this scale: exact, order-independent sums.
UNIT = 10 ** 12


def typed_points(extrema: DataFrame) -> DataFrame:
    return extrema.where(F.col("type") != "NO_TYPE")


def _unit_sum(component: Column) -> Column:
    return F.sum(F.floor(component * F.lit(float(UNIT)) + 0.5)).cast("double") / F.lit(float(UNIT)) / F.count(F.lit(1))


def centroid_columns(lat: Column, lon: Column, res: float) -> tuple[list[Column], dict[str, Column]]:
    """Aggregates (mean unit vector) and the expressions turning them into a snapped centre."""
    aggs = [
        _unit_sum(F.cos(rad(lat)) * F.cos(rad(lon))).alias("_ux"),
        _unit_sum(F.cos(rad(lat)) * F.sin(rad(lon))).alias("_uy"),
        _unit_sum(F.sin(rad(lat))).alias("_uz"),
    ]
    to_deg = 180.0 / math.pi
    flat = F.sqrt(F.col("_ux") * F.col("_ux") + F.col("_uy") * F.col("_uy"))
    centre = {
        "center_lat": snap(F.atan2(F.col("_uz"), flat) * F.lit(to_deg), res),
        "center_lon": snap(F.atan2(F.col("_uy"), F.col("_ux")) * F.lit(to_deg), res),
    }
    return aggs, centre


def spherical_centroid(points: DataFrame, keys: list[str], lat: str, lon: str, res: float) -> DataFrame:
    aggs, centre = centroid_columns(F.col(lat), F.col(lon), res)
    return points.groupBy(*keys).agg(*aggs).withColumns(centre).drop("_ux", "_uy", "_uz")


def cluster_summary(labelled: DataFrame, spec: GridSpec) -> DataFrame:
    """One row per component: size, contour, snapped centre and its four extreme points.

    The extreme points are minima of one integer (edge distance, then scan position), so the whole
    summary is a single hash aggregation with map-side combine.
    """
    big = F.lit(spec.n_coarse).cast("bigint")
    pos = F.col("x").cast("bigint") * spec.size_y + F.col("y")
    lat, lon = lat_of(F.col("x") * spec.step, spec), lon_of(F.col("y") * spec.step, spec)
    level = contour_level(height(F.col("raw"), spec), spec.contour_step)
    aggs, centre = centroid_columns(lat, lon, spec.res)
    grouped = labelled.groupBy("time", "root", "type").agg(
        F.count(F.lit(1)).cast("int").alias("n_points"),
        F.min(level).alias("_lo"), F.max(level).alias("_hi"),
        F.min(F.col("y") * big + pos).alias("_w"),
        F.min((F.lit(spec.size_y - 1) - F.col("y")) * big + pos).alias("_e"),
        F.min(pos).alias("_n"),
        F.min((F.lit(spec.size_x - 1) - F.col("x")) * big + pos).alias("_s"),
        *aggs,
    ).withColumns(centre)
    out = grouped.withColumn("contour", F.when(F.col("type") == "MAX", F.col("_lo")).otherwise(F.col("_hi")))
    for side in ("w", "e", "n", "s"):
        p = F.col(f"_{side}") % big
        out = out.withColumns({
            f"{side}_lat": lat_of(F.floor(p / spec.size_y) * spec.step, spec),
            f"{side}_lon": lon_of((p % spec.size_y) * spec.step, spec),
        })
    return out.drop("_lo", "_hi", "_w", "_e", "_n", "_s", "_ux", "_uy", "_uz")


def scan_order_ids(clusters: DataFrame) -> DataFrame:
    """Ids in the order in which a row-major scan meets the components. Runs on cluster rows (at
    most one per component), never on points."""
    return clusters.withColumn(
        "id", (F.dense_rank().over(W.partitionBy("time").orderBy("root")) - 1).cast("int"),
    )


def band_filter(clusters: DataFrame, spec: GridSpec) -> DataFrame:
    low, high = spec.band
    return clusters.where(
        (F.col("n_lat") > low) & (F.col("n_lat") < high) & (F.col("n_points") != 1)
    )


def reindex(clusters: DataFrame) -> DataFrame:
    return clusters.withColumn(
        "id", (F.row_number().over(W.partitionBy("time").orderBy("root")) - 1).cast("int"),
    )


def cluster_points(labelled: DataFrame, clusters: DataFrame) -> DataFrame:
    """Points of the kept clusters with the final id and centre. Neither side is broadcast: the points grow with the field, and
    the planner takes them for the smaller side."""
    return labelled.join(
        shuffled(clusters.select("time", "root", F.col("id").alias("cluster"), "center_lat", "center_lon")),
        ["time", "root"],
    )
