"""Gridded fields as tables: long form, row blocks and one-row-per-instant slices.

* long form   ``field(time, i, j, h)`` - what other tables join with;
* slices      ``slices(time, vals ARRAY<INT>)`` - dense, row-major, NULL where a cell is
  absent. One slice is bounded by the grid (checked), so sampling and ray walks become array
  reads inside one code-generated stage instead of shuffles of 256 rows per cell.

Stored once with ``save_slices`` (bucketed by ``time``), later detections read the slices
without moving them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from isohypsa.functions.geo import pack_int16
from isohypsa.params import GridSpec

KNOWN_VARIABLES = ("latitude", "longitude", "time", "z", "t")

# Fixed packing constants: variable -> (scale_factor, add_offset, long_name).
PACKING = {
    "z": (0.2143160459234279, 51692.04909197704, "Geopotential"),
    "t": (0.0013736749709324643, 268.35169200772935, "Temperature"),
}

FIELD_SCHEMA = T.StructType([
    T.StructField("time", T.IntegerType()),
    T.StructField("i", T.IntegerType()),
    T.StructField("j", T.IntegerType()),
    T.StructField("h", T.IntegerType()),
])


#: Instants that share a folder of a stored field.
FOLDER_INSTANTS = 256


def load_grid(spark: SparkSession, path: str, schema: T.StructType = FIELD_SCHEMA, fmt: str = "parquet",
              times: list[int] | None = None) -> DataFrame:
    """Read a long field; ``times`` are read from the folders that hold them, others are not opened."""
    reader = spark.read.schema(schema)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return df if times is None else df.where(F.col("time").isin(times))


def folder_of(time: Column) -> Column:
    return F.floor(time / FOLDER_INSTANTS).cast("int")


def save_grid(field: DataFrame, path: str) -> None:
    """Write a long field in folders of neighbouring instants, sorted by instant; files follow the data, not the instants."""
    dealt = field.withColumn("folder", folder_of(F.col("time"))).repartitionByRange("folder", "time").sortWithinPartitions("folder", "time", "i", "j")
    dealt.write.mode("overwrite").partitionBy("folder").parquet(path)


def read_grid(spark: SparkSession, path: str, times: list[int] | None = None) -> DataFrame:
    """A field written by ``save_grid``; of stated instants only their folders are read."""
    df = load_grid(spark, path, T.StructType([*FIELD_SCHEMA.fields, T.StructField("folder", T.IntegerType())]), times=times)
    return (df if times is None else df.where(F.col("folder").isin(sorted({t // FOLDER_INSTANTS for t in times})))).drop("folder")


def axis_lat(spark: SparkSession, spec: GridSpec) -> DataFrame:
    return spark.range(spec.nlat).select(
        F.col("id").cast("int").alias("i"),
        (F.lit(90.0) - F.col("id") * F.lit(float(spec.res))).cast("float").alias("lat"),
    )


def axis_lon(spark: SparkSession, spec: GridSpec) -> DataFrame:
    return spark.range(spec.nlon).select(
        F.col("id").cast("int").alias("j"),
        (F.lit(-180.0) + F.col("id") * F.lit(float(spec.res))).cast("float").alias("lon"),
    )


def grid_profile(field: DataFrame) -> DataFrame:
    """Number of rows, columns and instants of a field, in one scan: each cell gives its three values, which
    are made distinct map-side."""
    values = F.array(*[F.struct(F.lit(dim).alias("dim"), F.col(c).cast("bigint").alias("v")) for dim, c in (("nlat", "i"), ("nlon", "j"), ("ntime", "time"))])
    return field.select(F.inline(values)).distinct().where("v IS NOT NULL").groupBy("dim").agg(F.count("*").alias("size"))


def unknown_variables(names: DataFrame, col: str = "name") -> DataFrame:
    """Variables that are not part of the grid and are reported and ignored."""
    return names.where(~F.col(col).isin(*KNOWN_VARIABLES))


def normalize_dataset(df: DataFrame, var: str, level_col: str = "pressure_level", levels: list[float] | None = None) -> DataFrame:
    """Bring a raw download to the packed form. Without ``valid_time`` the input is already
    in the right form and passes through.

    Of several pressure levels the first in file order is taken. Rows have no order, so it comes from ``levels`` (the file's
    level axis) or from a column ``level_index``; with neither, a file of more than one level is an error."""
    if "valid_time" not in df.columns:
        return df
    scale, offset, long_name = PACKING[var]
    df = df.withColumnRenamed("valid_time", "time")
    if level_col in df.columns:
        if levels:
            df = df.where(F.col(level_col) == levels[0]).drop("level_index")
        elif "level_index" in df.columns:
            # one-row aggregate, so the broadcast is bounded
            first = df.agg(F.min("level_index").alias("_first"))
            df = df.join(F.broadcast(first), df["level_index"] == F.col("_first")).drop("_first", "level_index")
        elif df.select(level_col).distinct().limit(2).count() > 1:
            raise ValueError(f"which {level_col} comes first in the file is not known: give levels")
    df = df.drop("expver", "number", level_col)
    packed = pack_int16(F.col(var), scale, offset)
    return df.withColumns({
        "out_of_range": packed.isNull() & F.col(var).isNotNull(),
        var: packed,
        "scale_factor": F.lit(scale),
        "add_offset": F.lit(offset),
        "long_name": F.lit(long_name),
    })


def shifted_lon(lon: Column, last_lon: Column) -> Column:
    return F.when((last_lon > 180) & (lon >= 180), lon - 360).otherwise(lon)


def normalize_lon(field: DataFrame, axis: DataFrame) -> DataFrame:
    """0..360 axes become -180..180: only the column numbers change, no value moves.
    ``axis(j, lon)`` is bounded by the grid's columns."""
    whole = W.partitionBy(F.lit(0))
    new_axis = axis.withColumn("_last", F.max_by("lon", "j").over(whole))
    new_axis = new_axis.withColumn("lon_new", shifted_lon(F.col("lon"), F.col("_last")))
    new_axis = new_axis.withColumn(
        "j_new", (F.row_number().over(whole.orderBy("lon_new")) - 1).cast("int"),
    ).select("j", "j_new", "lon_new")
    return (
        field.join(F.broadcast(new_axis), "j")
        .drop("j").withColumnRenamed("j_new", "j").withColumnRenamed("lon_new", "lon")
    )


def shuffle_width(spark: SparkSession) -> int:
    """Partition count for work whose cost is far above its bytes (a 2 MB slice stands for a
    million samples): a stated count is kept as it is, a default one would be merged by bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Small rows that a task sorts or hashes.
ROWS_PER_TASK = 2_000_000


def row_partitions(spark: SparkSession, rows: int, per_task: int | None = None) -> int:
    """Partition count for work whose memory follows small rows: one for every ``per_task`` (``ROWS_PER_TASK``) of them, and no fewer than the session's number."""
    return max(shuffle_width(spark), math.ceil(rows / (per_task or ROWS_PER_TASK)))


def shuffled(cells: DataFrame) -> DataFrame:
    """A side of a join that must not be broadcast. Cells are unfolded from few small rows (instants, slices), so the planner, also the
    adaptive one, takes a whole field for a few kB and would gather it on the driver."""
    return cells.hint("merge")


def rejected_cells(field: DataFrame, spec: GridSpec, value: str = "h") -> DataFrame:
    """What ``to_slices`` leaves out, as rows with a reason: cells beyond the grid, and values beside the
    smallest one of their cell."""
    inside = F.col("i").between(0, spec.nlat - 1) & F.col("j").between(0, spec.nlon - 1)
    off = field.where(~F.coalesce(inside, F.lit(False))).select("time", "i", "j", F.col(value).alias("value"), F.lit("off grid").alias("reason"))
    again = field.where(inside).groupBy("time", "i", "j").agg(F.min(value).alias("value"), F.count("*").alias("n")).where("n > 1")
    return off.unionByName(again.select("time", "i", "j", "value", F.concat(F.col("n") - 1, F.lit(" more values")).alias("reason")))


def to_slices(field: DataFrame, spec: GridSpec, value: str = "h", partitions: int | None = None) -> DataFrame:
    """Long field -> one dense array per instant.

    The field is shuffled once, by ``time``, into ``partitions`` (the session's number unless stated; take
    a few dozen instants per partition): cells are made unique, gathered per instant and laid out where they
    are, so a group never exceeds the grid. ``rejected_cells`` lists what is left out.
    """
    uniq = (
        field.where(F.col("i").between(0, spec.nlat - 1) & F.col("j").between(0, spec.nlon - 1))
        .repartition(partitions or shuffle_width(field.sparkSession), "time")
        .groupBy("time", "i", "j").agg(F.min(F.col(value)).alias("v"))
    )
    cell = (F.col("i") * spec.nlon + F.col("j")).cast("int").alias("cell")
    gathered = uniq.groupBy("time").agg(F.collect_list(F.struct(cell, "v")).alias("cells"))
    out = T.StructType([uniq.schema["time"], T.StructField("vals", T.ArrayType(uniq.schema["v"].dataType))])
    return gathered.mapInArrow(_dense(spec.n_cells, to_arrow_schema(out)), out)


def _dense(n_cells: int, schema: pa.Schema):
    """Cells (position, value) of an instant, in any order and with gaps, as one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for time, cells in zip(batch.column(0), batch.column(1)):
                at = np.full(n_cells, -1, "int64")
                at[cells.values.field("cell").to_numpy()] = np.arange(len(cells.values))
                vals = cells.values.field("v").take(pa.array(at, mask=at < 0)).cast(schema.field(1).type.value_type)
                row = pa.ListArray.from_arrays(pa.array([0, n_cells], "int32"), vals).cast(schema.field(1).type)
                yield pa.RecordBatch.from_arrays([pa.array([time.as_py()], schema.field(0).type), row], schema=schema)

    return run


def save_slices(slices: DataFrame, table: str, buckets: int) -> None:
    """Write slices bucketed by time: later joins and groupings on time leave them in place."""
    slices.write.mode("overwrite").format("parquet").bucketBy(buckets, "time").sortBy("time").saveAsTable(table)


def from_slices(slices: DataFrame, spec: GridSpec) -> DataFrame:
    return slices.select("time", F.posexplode("vals").alias("cell", "h")).select(
        "time",
        F.floor(F.col("cell") / spec.nlon).cast("int").alias("i"),
        (F.col("cell") % spec.nlon).cast("int").alias("j"),
        "h",
    )
