"""User-level map data: contour, scatter, combined, formation and surface."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohypsa.functions.geo import lat_of, lon_of
from isohypsa.operators import maps as M
from isohypsa.params import GridSpec


def located(field: DataFrame, spec: GridSpec, value: str = "h") -> DataFrame:
    return field.select(
        "time", "i", "j", lat_of(F.col("i"), spec).alias("lat"), lon_of(F.col("j"), spec).alias("lon"),
        F.col(value).alias("value"),
    )


def contour_map_data(field: DataFrame, axis: DataFrame, spec: GridSpec, area: tuple[float, float, float, float],
                     step: float, value: str = "h") -> DataFrame:
    """Cells inside the area with their date, the range over the area and its contour levels."""
    cells = M.mask_invalid(
        M.area_filter(located(field, spec, value), *area).withColumn("value", F.col("value").cast("double")), "value",
    )
    levels = M.valid_range(cells, ["time"], "value").withColumn(
        "levels", M.level_list(F.col("vmin"), F.col("vmax"), step),
    )
    return M.instant_to_date(levels, axis)


def isolines_in_area(slices: DataFrame, axis: DataFrame, spec: GridSpec, area: tuple[float, float, float, float],
                     step: float) -> DataFrame:
    """Isolines of the cells inside the area; range and levels are those of the area."""
    return M.instant_to_date(M.isoline_crossings(slices, spec, step, area), axis)


def scatter_map_data(selected: DataFrame, axis: DataFrame) -> DataFrame:
    return M.instant_to_date(selected, axis)


def combined_map_data(crossings: DataFrame, selected: DataFrame) -> DataFrame:
    return M.overlay(
        crossings.select("time", "lat", "lon", F.col("level").alias("value")),
        selected.select("time", "lat", "lon", F.col("value").cast("double").alias("value"), "cluster"),
    )


def formation_map_data(formations: DataFrame, points: DataFrame) -> DataFrame:
    """One row per formation: label position and number of member points."""
    return M.formation_label(M.formation_members(formations, points))


def surface_map_data(field: DataFrame, spec: GridSpec, area: tuple[float, float, float, float], value: str = "h") -> DataFrame:
    return M.area_filter(M.surface_grid(field, spec, value), *area)
