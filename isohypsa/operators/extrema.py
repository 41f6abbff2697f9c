"""Local maxima and minima by great-circle sampling.

The sampling geometry depends on the latitude of a cell only: a coarse row has one destination
latitude and one change of longitude per bearing, whatever the instant and the column. So the
positions and weights of all samples are worked out once for a grid, and ``votes_from_slices``
reads each slice by them; samples never become rows.
``votes_by_join`` is the same vote by equi-joins, kept as its independent twin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from isohypsa.functions.clock import clock
from isohypsa.functions.geo import (
    height, interpolate, lat_of, lon_of, turned_lon, with_bilinear_weights, with_destination, with_turn,
)
from isohypsa.params import GRAVITY, GridSpec
from isohypsa.sources.grid import shuffled, to_slices


def bearing_set(spark: SparkSession, spec: GridSpec) -> DataFrame:
    return spark.range(spec.n_bearings).select(
        F.col("id").cast("int").alias("k"),
        (F.lit(float(spec.bearing_start)) + F.col("id") * F.lit(float(spec.bearing_step))).alias("bearing"),
    )


def clip_and_coarsen(field: DataFrame, spec: GridSpec) -> DataFrame:
    """Every ``step``-th row down to lat_min and every ``step``-th column, renumbered."""
    return (
        field.where(
            (F.col("i") % spec.step == 0) & (F.col("j") % spec.step == 0)
            & (F.col("i") <= (spec.size_x - 1) * spec.step)
            & (F.col("j") <= (spec.size_y - 1) * spec.step)
        )
        .withColumns({
            "x": F.floor(F.col("i") / spec.step).cast("int"),
            "y": F.floor(F.col("j") / spec.step).cast("int"),
        })
    )


def lattice(spark: SparkSession, spec: GridSpec) -> DataFrame:
    n = spark.range(spec.n_coarse)
    xy = n.select(
        F.col("id").cast("int").alias("cell"),
        F.floor(F.col("id") / spec.size_y).cast("int").alias("x"),
        (F.col("id") % spec.size_y).cast("int").alias("y"),
    )
    return xy.withColumns({
        "lat": lat_of(F.col("x") * spec.step, spec).cast("float"),
        "lon": lon_of(F.col("y") * spec.step, spec).cast("float"),
    })


def stencil(spark: SparkSession, spec: GridSpec) -> DataFrame:
    """One row per (coarse cell, bearing): destination, lower-left node and node weights."""
    samples = lattice(spark, spec).withColumn(
        "k", F.explode(F.sequence(F.lit(0), F.lit(spec.n_bearings - 1))),
    ).withColumn(
        "bearing", F.lit(float(spec.bearing_start)) + F.col("k") * F.lit(float(spec.bearing_step)),
    )
    dest = with_destination(samples, "lat", "lon", F.lit(float(spec.dist_km)), F.col("bearing"))
    return with_bilinear_weights(dest, spec)


def save_stencil(spark: SparkSession, spec: GridSpec, path: str) -> None:
    """Write the stencil of a grid: it depends on the grid alone, so one table serves every field and run."""
    stencil(spark, spec).select("x", "y", "k", "bearing", "dest_lat", "dest_lon", "i_lo", "j_lo", "w11", "w12", "w21", "w22").write.mode("overwrite").parquet(path)


def missing_sample(sample: Column, spec: GridSpec) -> Column:
    """A packed sample of -1 cannot be told from a missing one, which compat keeps."""
    if spec.compat and spec.scale is not None:
        return sample.isNull() | (sample == -1)
    return sample.isNull()


def _vote_aggregates(own: Column, sample: Column, spec: GridSpec) -> list[Column]:
    gone = missing_sample(sample, spec)
    hs, ho = height(sample, spec), height(own, spec)
    return [
        F.sum(F.when(gone | (ho >= hs), 1).otherwise(0)).cast("int").alias("n_ge"),
        F.sum(F.when(~gone & (ho <= hs), 1).otherwise(0)).cast("int").alias("n_le"),
    ]


def row_stencil(spark: SparkSession, spec: GridSpec) -> DataFrame:
    """One row per (coarse row, bearing): destination latitude and turn. Bounded by the grid's rows times the bearings."""
    rows = spark.range(spec.size_x).select(F.col("id").cast("int").alias("x"), lat_of(F.col("id") * spec.step, spec).cast("float").alias("lat"))
    bearing = F.lit(float(spec.bearing_start)) + F.col("k") * F.lit(float(spec.bearing_step))
    each = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(spec.n_bearings - 1)))).withColumn("bearing", bearing)
    return with_turn(each, "lat", F.lit(float(spec.dist_km)), F.col("bearing")).select("x", "dest_lat", "turn")


def lattice_stencil(spark: SparkSession, spec: GridSpec) -> tuple[np.ndarray, np.ndarray]:
    """Position of the lower-left node in a slice (n_cells where a node is off the grid) and the four weights of every sample, by coarse cell and bearing.
    Bounded by the grid: the same numbers for every instant, so they are worked out once."""
    at = F.when(F.col("i_lo").isNotNull(), F.col("i_lo") * spec.nlon + F.col("j_lo")).otherwise(F.lit(-1)).cast("int").alias("at")
    told = stencil(spark, spec).select("cell", "k", at, *[F.coalesce(w, F.lit(0.0)).cast("float").alias(w) for w in ("w11", "w12", "w21", "w22")]).toArrow()
    order = np.lexsort((told["k"].to_numpy(), told["cell"].to_numpy()))
    at = told["at"].to_numpy()[order].reshape(spec.n_coarse, spec.n_bearings)
    return at, np.stack([told[w].to_numpy()[order].reshape(spec.n_coarse, spec.n_bearings) for w in ("w11", "w12", "w21", "w22")])


def _vote_kernel(at: np.ndarray, weights: np.ndarray, spec: GridSpec, schema: pa.Schema):
    """Votes of batches of slices. The samples of one instant are one gather of the four nodes and stay in its arrays."""
    own_at = (np.arange(spec.size_x)[:, None] * (spec.step * spec.nlon) + np.arange(spec.size_y) * spec.step).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = at >= 0
        nodes = [np.where(found, at + by, spec.n_cells) for by in (0, 1, -spec.nlon, 1 - spec.nlon)]  # beyond the last cell lies a blank
        w = weights.astype("float64")
        x, y = np.divmod(np.arange(spec.n_coarse, dtype="int32"), np.int32(spec.size_y))
        metres = (lambda v: v) if spec.scale is None else (lambda v: (v * spec.scale + spec.offset) / GRAVITY)
        for batch in batches:
            for time, vals in zip(batch.column(0), batch.column(1)):
                read = np.full(spec.n_cells + 1, np.nan)
                if vals.is_valid:
                    cells = vals.values.to_numpy(zero_copy_only=False).astype("float64")[:spec.n_cells]
                    read[:len(cells)] = cells
                total = w[0] * read[nodes[0]]
                for wi, at_i in zip(w[1:], nodes[1:]):
                    total += wi * read[at_i]
                sample = np.where(total >= 0, np.floor(total + 0.5), np.ceil(total - 0.5))
                own = read[own_at]
                gone = np.isnan(sample) | (sample == -1) if spec.compat and spec.scale is not None else np.isnan(sample)
                hs, ho = metres(sample), metres(own)[:, None]
                n_ge, n_le = (gone | (ho >= hs)).sum(1), (~gone & (ho <= hs)).sum(1)
                here = np.flatnonzero(~np.isnan(own))
                yield pa.RecordBatch.from_arrays([
                    pa.array([time.as_py()] * len(here), schema.field(0).type), pa.array(x[here]), pa.array(y[here]), pa.array(own[here]).cast(schema.field(3).type),
                    pa.array(n_ge[here].astype("int32")), pa.array(n_le[here].astype("int32"))], schema=schema)

    return run


def votes_from_slices(slices: DataFrame, spec: GridSpec, measured: bool = False, geometry: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Per coarse cell the number of samples not above (n_ge) and not below (n_le) it, from slices with one row per instant.

    Every slice of integers is read by the same positions and weighed by the same weights, in array arithmetic; only votes leave the task."""
    kind = slices.schema["vals"].dataType.elementType
    if measured or not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return votes_by_row(slices, spec, measured)
    out = T.StructType([slices.schema["time"], T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("raw", kind),
                        T.StructField("n_ge", T.IntegerType()), T.StructField("n_le", T.IntegerType())])
    run = _vote_kernel(*(geometry or lattice_stencil(slices.sparkSession, spec)), spec, to_arrow_schema(out))
    return slices.select("time", "vals").mapInArrow(run, out)


def votes_by_row(slices: DataFrame, spec: GridSpec, measured: bool = False) -> DataFrame:
    """The same votes as columns, for values that are no integers and for measured runs.

    A slice meets the stencil of each coarse row once, and the columns of the row are an explode of a
    sequence; join, explode, array reads and partial aggregation are one code-generated stage, so
    samples are never materialized.

    ``measured`` adds ``clock``, the reading of the task's clock when a coarse row began, and one row more for each instant,
    x = size_x without a vote, whose clock was read when the instant's last sample was done."""
    samples = row_stencil(slices.sparkSession, spec)
    rows = slices.select("time", "vals", F.explode(F.sequence(F.lit(0), F.lit(spec.size_x - (0 if measured else 1)))).alias("x"))
    if measured:
        rows = rows.withColumn("clock", clock())
    columns = F.sequence(F.lit(0), F.lit(spec.size_y - 1))
    if measured:
        columns = F.when(F.col("x") < spec.size_x, columns).otherwise(F.array(F.lit(-1)))
    each = rows.join(F.broadcast(samples), "x", "left" if measured else "inner").select("*", F.explode(columns).alias("y"))
    each = each.withColumn("lon", lon_of(F.col("y") * spec.step, spec).cast("float")).withColumn("dest_lon", turned_lon("lon", "turn"))
    own_at = F.col("x") * (spec.step * spec.nlon) + F.col("y") * spec.step
    probe = with_bilinear_weights(each, spec).select(
        "time", "x", "y", *(["clock"] if measured else []), (F.when(F.col("y") >= 0, F.get("vals", own_at)) if measured else F.get("vals", own_at)).alias("raw"),
        interpolate(
            [F.col("w11"), F.col("w12"), F.col("w21"), F.col("w22")],
            corners("vals", spec),
        ).alias("sample"),
    )
    votes = probe.groupBy("time", "x", "y").agg(
        F.min("raw").alias("raw"), *_vote_aggregates(F.col("raw"), F.col("sample"), spec), *([F.min("clock").alias("clock")] if measured else []),
    )
    return votes.where(F.col("raw").isNotNull() | (F.col("x") == spec.size_x) if measured else F.col("raw").isNotNull())


def gather4(samples: DataFrame, field: DataFrame, value: str = "h") -> DataFrame:
    """The four corner values of each sample by equi-joins on (i, j); NULL when absent.

    ``samples`` carries ``i_lo, j_lo`` and, when it is per instant, ``time``. The field is never sent to all tasks, whatever its estimate."""
    keys = ["time"] if "time" in samples.columns else []
    out = samples
    for name, di, dj in (("z11", 0, 0), ("z12", 0, 1), ("z21", -1, 0), ("z22", -1, 1)):
        node = field.select(
            *keys, (F.col("i") - di).alias("i_lo"), (F.col("j") - dj).alias("j_lo"), F.col(value).alias(name),
        )
        # the samples are hashed and the field streams by: it is neither gathered nor sorted
        out = out.hint("shuffle_hash").join(node, [*keys, "i_lo", "j_lo"], "left")
    return out


def corners(vals: str, spec: GridSpec) -> list[Column]:
    """The four corner values of a sample (``i_lo``, ``j_lo``) from the slice beside it; NULL when absent."""
    at = F.col("i_lo") * spec.nlon + F.col("j_lo")
    return [F.get(vals, c) for c in (at, at + 1, at - spec.nlon, at - spec.nlon + 1)]


def samples_by_join(field: DataFrame, spec: GridSpec, value: str = "h", stored: DataFrame | None = None) -> DataFrame:
    """time, x, y, raw (the cell's own value), k and sample for every coarse cell and bearing of a field: the cells meet the slice of their instant,
    then the stencil, a stored one or one made for the occasion, which is bounded by the grid. What moves is a row per cell; the 64 samples of a cell
    read their corners where they are made and are never shuffled."""
    own = clip_and_coarsen(field, spec).select("time", "x", "y", F.col(value).alias("raw"))
    points = stencil(field.sparkSession, spec) if stored is None else stored
    met = own.join(shuffled(to_slices(field, spec, value)), "time", "left")
    samples = met.join(F.broadcast(points.select("x", "y", "k", "i_lo", "j_lo", "w11", "w12", "w21", "w22")), ["x", "y"])
    return samples.select("time", "x", "y", "raw", "k", interpolate([F.col(f"w{n}") for n in (11, 12, 21, 22)], corners("vals", spec)).alias("sample"))


def votes_by_join(field: DataFrame, spec: GridSpec, value: str = "h") -> DataFrame:
    """Relational form of the vote, a cross-check."""
    return samples_by_join(field, spec, value).groupBy("time", "x", "y").agg(
        F.min("raw").alias("raw"), *_vote_aggregates(F.col("raw"), F.col("sample"), spec),
    ).where(F.col("raw").isNotNull())


def classify(votes: DataFrame, spec: GridSpec) -> DataFrame:
    return votes.withColumn(
        "type",
        F.when(F.col("n_ge") >= spec.threshold, "MAX")
        .when(F.col("n_le") >= spec.threshold, "MIN")
        .otherwise("NO_TYPE"),
    )


def detect_extrema(field: DataFrame, spec: GridSpec, value: str = "h", slices: DataFrame | None = None, geometry: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(time, x, y, raw, n_ge, n_le, type) for every coarse cell."""
    return classify(votes_from_slices(to_slices(field, spec, value) if slices is None else slices, spec, geometry=geometry), spec)
