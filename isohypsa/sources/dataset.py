"""Data sets: packed fields of several variables with their axes and packing, as tables of one folder.

* ``field(var, month, time, i, j, raw)`` - packed values; folders by variable and month, sorted by instant inside, so that a
  variable, a month or an instant of it is read without the rest;
* ``axis_lat(i, lat)``, ``axis_lon(j, lon)``, ``axis_time(time, ts)`` - what rows, columns and instants stand for;
* ``field_meta(var, scale_factor, add_offset, long_name)`` - one row per variable.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from isohypsa.params import GRAVITY, KELVIN_OFFSET
from isohypsa.sources.grid import normalize_lon, shuffle_width

SCHEMAS = {
    "field": "time int, i int, j int, raw smallint, var string, month string",
    "axis_lat": "i int, lat float",
    "axis_lon": "j int, lon float",
    "axis_time": "time int, ts timestamp",
    "field_meta": "var string, scale_factor double, add_offset double, long_name string",
}


#: Cells that a task sorts when a data set is written.
ROWS_PER_RANGE = 2_000_000


@dataclass(frozen=True)
class Dataset:
    field: DataFrame
    lats: DataFrame
    lons: DataFrame
    times: DataFrame
    meta: DataFrame


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def ranges_of(data: Dataset) -> int | None:
    """Number of ranges to sort a data set in, from its axes; none where the session's number will do."""
    cells = math.prod(table.count() for table in (data.times, data.lats, data.lons, data.meta))
    ranges = math.ceil(cells / ROWS_PER_RANGE)
    return ranges if ranges > shuffle_width(data.field.sparkSession) else None


def save_dataset(data: Dataset, path: str, partitions: int | None = None) -> None:
    """Write all tables under ``path``. ``data.field(var, time, i, j, raw)`` gets its months from the time axis; an instant that is not on it has none.

    Ranges of (variable, month, instant) are written side by side, so files follow the data: a task holds whole stretches of
    instants and a month is one folder, however many instants it has. Unless stated, there is a range for every ``ROWS_PER_RANGE`` cells that the axes
    span, so that a task sorts no more of a longer data set."""
    dated = data.field.select("var", "time", "i", "j", F.col("raw").cast("smallint").alias("raw")).join(
        data.times.select("time", month_of(F.col("ts")).alias("month")), "time", "left")
    order = ["var", "month", "time"]
    partitions = partitions or ranges_of(data)
    dealt = dated.repartitionByRange(partitions, *order) if partitions else dated.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order, "i", "j").write.mode("overwrite").partitionBy("var", "month").parquet(f"{path}/field")
    for name, table in (("axis_lat", data.lats), ("axis_lon", data.lons), ("axis_time", data.times), ("field_meta", data.meta)):
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        table.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in SCHEMAS[name].split(", "))]).sort(columns[0]).write.mode("overwrite").parquet(f"{path}/{name}")


def load_dataset(spark: SparkSession, path: str, variables: list[str] | None = None) -> Dataset:
    """The tables of a data set, of some of its variables. A variable that is not in it, or one with two rows of metadata, is an error."""
    try:
        read = {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()}
    except AnalysisException as e:
        raise FileNotFoundError(f"no data set under {path}") from e
    meta = read["field_meta"]
    if variables is not None:
        meta = meta.where(F.col("var").isin(*variables))
    known = [r["var"] for r in meta.select("var").limit(1000).collect()]  # variables of one file are few
    if len(known) != len(set(known)) or variables is not None and set(known) != set(variables):
        raise ValueError(f"wanted {variables}, metadata for {sorted(known)}")
    field = read["field"] if variables is None else read["field"].where(F.col("var").isin(*variables))
    return Dataset(field, read["axis_lat"], read["axis_lon"], read["axis_time"], meta)


def physical(raw: Column, var: Column, scale: Column, offset: Column) -> Column:
    """Geopotential in metres of height, temperature in degrees Celsius, other variables in their own unit."""
    value = raw * scale + offset
    return F.when(var == "z", value / F.lit(GRAVITY)).when(var == "t", value - F.lit(KELVIN_OFFSET)).otherwise(value)


def unpacked(field: DataFrame, meta: DataFrame) -> DataFrame:
    """field with ``value``, by the packing of its variable. The metadata, a row per variable of a file, goes to all tasks."""
    told = F.broadcast(meta.select("var", "scale_factor", "add_offset"))
    return field.join(told, "var").withColumn("value", physical(F.col("raw"), F.col("var"), F.col("scale_factor"), F.col("add_offset"))).drop("scale_factor", "add_offset")


def located(field: DataFrame, data: Dataset) -> DataFrame:
    """field with lat and lon from the axes; an axis from 0 to 360 is turned to begin at -180, which renumbers the columns."""
    turned = normalize_lon(field, data.lons)
    return turned.join(F.broadcast(data.lats), "i").withColumns({"lat": F.col("lat").cast("double"), "lon": F.col("lon").cast("double")})
