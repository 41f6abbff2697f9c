"""Maps as they are asked for: by date, from packed data sets and from the stored results of a run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isohypsa.operators import maps as M
from isohypsa.operators.catalogue import variable_lookup
from isohypsa.sources.dataset import Dataset, located, unpacked
from isohypsa.staging import stage

UNKNOWN_VARIABLE, NO_INSTANT, NO_CELLS, NO_RANGE = "unknown variable", "no such instant", "no data points within the specified area", "no valid data range"


@dataclass(frozen=True)
class ContourMaps:
    """``levels``: request_id, label, vmin, vmax, levels; ``crossings``: request_id, edge, level, i, j, lat, lon;
    ``rejects``: request_id, reason."""

    levels: DataFrame
    crossings: DataFrame
    rejects: DataFrame


def dated_requests(requests: DataFrame, times: DataFrame) -> DataFrame:
    """Requests with their variable, the label and index of their instant (-1 without one) and its month."""
    asked = M.time_select(variable_lookup(requests), times)
    return asked.withColumn("month", F.substring("label", 1, 7))


def contour_maps(data: Dataset, requests: DataFrame) -> ContourMaps:
    """Levels and isolines of requests (request_id, variableName, year, month, day, hour, north, west, south, east, step) over a data set.

    Values are unpacked by the metadata and the axis is turned, once for each cell. A request meets the cells of its variable, month and instant inside its area:
    other months are not read, other cells make no row. What is left of a request, bounded by the grid, is laid out as rows of its lattice in one shuffle.
    A row's southern neighbours are those of the next row. Requests that cannot be drawn are rejects with the first reason that holds."""
    asked = stage(dated_requests(requests, data.times), "asked-maps")
    good = asked.where(~F.col("rejected") & (F.col("time_index") >= 0))
    wanted = good.select("request_id", F.col("variable").alias("var"), "month", F.col("time_index").alias("time"), "north", "west", "south", "east", "step")
    cells = located(unpacked(data.field, data.meta), data).select("var", "month", "time", "i", "j", "lat", "lon", "value")
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    cells = cells.join(wanted, ["var", "month", "time"]).where(inside)
    cells = M.mask_invalid(cells.select("request_id", "step", "i", "j", "lat", "lon", "value"), "value")
    rows = cells.groupBy("request_id", "step", "i", "lat").agg(
        F.sort_array(F.collect_list(F.struct("j", "lon", "value"))).alias("cells"), F.min("value").alias("low"), F.max("value").alias("high"))
    whole = W.partitionBy("request_id")
    below = F.lead(F.struct("i", "lat", "cells")).over(whole.orderBy("i"))
    rows = stage(rows.withColumns({"vmin": F.min("low").over(whole), "vmax": F.max("high").over(whole), "below": below}).drop("low", "high"), "map-rows")
    levels = rows.groupBy("request_id", "step", "vmin", "vmax").agg(F.count("*").alias("n_rows")).drop("n_rows")
    levels = levels.where("vmin IS NOT NULL").withColumn("levels", M.level_list(F.col("vmin"), F.col("vmax"), F.col("step")))
    drawn = rows.select("request_id", "vmin").distinct()
    state = asked.join(drawn.withColumn("met", F.lit(True)), "request_id", "left")
    reason = F.when(F.col("rejected"), UNKNOWN_VARIABLE).when(F.col("time_index") < 0, NO_INSTANT).when(F.col("met").isNull(), NO_CELLS).when(F.col("vmin").isNull(), NO_RANGE)
    labels = good.select("request_id", "label")
    return ContourMaps(
        levels.join(labels, "request_id").select("request_id", "label", "vmin", "vmax", "levels"),
        lattice_crossings(rows),
        state.select("request_id", reason.alias("reason")).where("reason IS NOT NULL"))


def lattice_crossings(rows: DataFrame) -> DataFrame:
    """Crossings of the levels with the edges between neighbours, from the rows of each lattice: cells in column order, the row below beside them.

    Neighbours are put beside each cell while a row is an array; what unfolds is a cell with its two neighbours, not the row."""
    near = F.when(F.col("below.i") == F.col("i") + 1, F.col("below.cells"))
    alike = near["j"] == F.col("cells.j")  # the usual case: no gaps, so that neighbours have the same position
    found = F.map_from_arrays(near["j"], near["value"])
    south = F.when(alike, near["value"]).otherwise(F.transform("cells.j", lambda j: F.try_element_at(found, j)))
    beside = F.slice("cells", 2, F.size("cells"))
    around = F.arrays_zip(F.col("cells.j").alias("j"), F.col("cells.lon").alias("lon"), F.col("cells.value").alias("a"), beside["j"].alias("east_j"), beside["lon"].alias("east_lon"),
                          beside["value"].alias("east"), F.coalesce(south, F.array().cast("array<double>")).alias("south"))
    each = rows.where("vmin IS NOT NULL").select(
        "request_id", "i", "lat", "vmin", "vmax", "step", (F.col("below.lat") - F.col("lat")).alias("south_dlat"), F.explode(around).alias("c"))
    edges = each.select("request_id", "i", "lat", "vmin", "vmax", "step", "c.j", "c.lon", "c.a", F.explode(F.array(
        F.struct(F.lit("E").alias("edge"), F.when(F.col("c.east_j") == F.col("c.j") + 1, F.col("c.east")).alias("b"), F.lit(0.0).alias("dlat"), (F.col("c.east_lon") - F.col("c.lon")).alias("dlon")),
        F.struct(F.lit("S").alias("edge"), F.col("c.south").alias("b"), F.col("south_dlat").alias("dlat"), F.lit(0.0).alias("dlon")))).alias("e"))
    placed = M.levels_between(edges.where("a <> e.b"), F.col("a"), F.col("e.b"), F.col("step"))
    t = (F.col("level") - F.col("a")) / (F.col("e.b") - F.col("a"))
    return placed.select("request_id", "e.edge", "level", "i", "j", (F.col("lat") + t * F.col("e.dlat")).alias("lat"), (F.col("lon") + t * F.col("e.dlon")).alias("lon"))


def stored_rows(results: DataFrame, requests: DataFrame, times: DataFrame) -> DataFrame:
    """Rows of stored results that requests (request_id, request_hash, year, month, day, hour) ask for, with request_id and label.
    The run is a folder of the results: only those of the requests at hand are read."""
    dated = M.time_select(requests, times).where("time_index >= 0").select("request_id", "request_hash", F.col("time_index").alias("time"), "label")
    return results.join(dated, ["request_hash", "time"])


def stored_points(selected: DataFrame, requests: DataFrame, times: DataFrame) -> DataFrame:
    """request_id, time, label, lat, lon, value, cluster, type of the selected points of the requested instants: the scatter map."""
    rows = stored_rows(selected, requests, times)
    return rows.select("request_id", "time", "label", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("z").alias("value"), "cluster", "type")


def stored_combined(crossings: DataFrame, points: DataFrame) -> DataFrame:
    """Isolines (request_id, level, lat, lon) and stored points of the same requests, tagged by layer."""
    return M.overlay(
        crossings.select("request_id", "lat", "lon", F.col("level").alias("value")),
        points.select("request_id", "lat", "lon", F.col("value").cast("double").alias("value"), "cluster"))


def stored_formations(formations: DataFrame, selected: DataFrame, requests: DataFrame, times: DataFrame) -> DataFrame:
    """One row per stored formation of the requested instants: label position and number of member points."""
    forms = stored_rows(formations, requests, times).withColumn("min2_id", F.when(F.col("min2_id") >= 0, F.col("min2_id")))
    keys = ["request_id", "time"]
    return M.formation_label(M.formation_members(forms, stored_points(selected, requests, times).drop("type"), keys), keys)
