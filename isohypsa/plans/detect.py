"""User-level detection queries."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohypsa.functions.geo import celsius, lat_of, lon_of
from isohypsa.operators import clusters as C
from isohypsa.operators import formations as B
from isohypsa.operators import rays as R
from isohypsa.operators.components import label_components
from isohypsa.operators.extrema import clip_and_coarsen, detect_extrema
from isohypsa.params import GridSpec
from isohypsa.sources.grid import to_slices
from isohypsa.staging import stage

__all__ = ["detect_extrema", "cluster_extrema", "detect_blocking", "heat_clusters", "Detection"]


@dataclass
class Detection:
    """Every stage of one detection, lazily planned over the same slices."""

    slices: DataFrame
    extrema: DataFrame
    labelled: DataFrame
    clusters: DataFrame
    spec: GridSpec

    @property
    def points(self) -> DataFrame:
        return C.cluster_points(self.labelled, self.clusters)

    @property
    def reach(self) -> DataFrame:
        return R.ray_reach(self.clusters, self.slices, self.spec)

    @property
    def limits(self) -> DataFrame:
        return R.thresholds(self.reach)

    @property
    def levels(self) -> DataFrame:
        return R.north_walk(self.clusters, self.slices, self.spec)

    @property
    def pairs(self) -> DataFrame:
        return B.near_pairs(self.clusters, self.spec)

    def walks(self, measured: bool = False) -> DataFrame:
        """Ray and north walks of every instant, written once: the slices meet the clusters in one join."""
        return stage(R.walks(self.clusters, self.slices, self.spec, measured), "walks")

    def candidates(self, walked: DataFrame | None = None) -> DataFrame:
        walked = self.walks() if walked is None else walked
        # the thresholds serve the maxima's levels and the minima: written once
        limits = stage(R.thresholds(R.reach_rows(walked, self.spec)), "limits")
        return B.formation_candidates(self.pairs, B.open_levels(R.level_rows(walked, self.spec), limits), limits, self.spec)

    def formations(self) -> DataFrame:
        return B.formations(self.candidates())


def cluster_extrema(field: DataFrame | None, spec: GridSpec, slices: DataFrame | None = None,
                    value: str = "h", method: str = "slice", staged: bool = False,
                    geometry: tuple[np.ndarray, np.ndarray] | None = None) -> Detection:
    """Sampling and clustering of a long ``field`` or of stored ``slices``. ``geometry`` is the grid's ``lattice_stencil``, if it is at hand.

    ``staged`` writes what the formation stage reads again - slices (unless they are stored
    already), labelled points and cluster rows - instead of deriving it anew for every reader."""
    if slices is None:
        slices = to_slices(field, spec, value)
        slices = stage(slices, "slices") if staged else slices
    extrema = detect_extrema(field, spec, value, slices, geometry)
    labelled = label_components(
        C.typed_points(extrema).select("time", "x", "y", "type", "raw"), spec.size_x, spec.size_y, method,
    )
    labelled = stage(labelled, "labelled") if staged else labelled
    kept = C.reindex(C.band_filter(C.cluster_summary(labelled, spec), spec))
    kept = stage(kept, "clusters") if staged else kept
    return Detection(slices, extrema, labelled, kept, spec)


def detect_blocking(field: DataFrame | None, spec: GridSpec, slices: DataFrame | None = None) -> DataFrame:
    """Formations (time, max_id, min1_id, min2_id, type); the flagship query."""
    return cluster_extrema(field, spec, slices, staged=True).formations()


def heat_points(field: DataFrame, spec: GridSpec, scale: float, offset: float, threshold: float = 28.0,
                value: str = "raw") -> DataFrame:
    """Coarse cells warmer than the threshold."""
    t = celsius(F.col(value), scale, offset)
    return clip_and_coarsen(field, spec).withColumn("t_c", t).where(F.col("t_c") > threshold).select(
        "time", "x", "y", F.lit("HOT").alias("type"), "t_c",
        lat_of(F.col("i"), spec).alias("latitude"), lon_of(F.col("j"), spec).alias("longitude"),
    )


def heat_clusters(field: DataFrame, spec: GridSpec, scale: float, offset: float, threshold: float = 28.0,
                  value: str = "raw") -> DataFrame:
    """Hot points with the id of their component and its snapped centre."""
    hot = label_components(
        heat_points(field, spec, scale, offset, threshold, value), spec.size_x, spec.size_y,
    )
    centres = C.scan_order_ids(
        C.spherical_centroid(hot, ["time", "root"], "latitude", "longitude", spec.res)
    )
    return hot.join(centres, ["time", "root"]).select(
        "time", "latitude", "longitude", F.col("t_c").alias("t"), F.col("id").alias("cluster"),
        F.col("center_lat").alias("centroid_lat"), F.col("center_lon").alias("centroid_lon"),
    )
