"""Detection with the times of its stages, as measured where the work is done."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from isohypsa.operators import clusters as C
from isohypsa.operators import formations as B
from isohypsa.operators.components import label_components
from isohypsa.operators.extrema import classify, votes_from_slices
from isohypsa.params import GridSpec
from isohypsa.plans.detect import Detection
from isohypsa.sources.grid import to_slices
from isohypsa.staging import stage


@dataclass
class Timed:
    """Formations and the rows (part, instant, time_elapsed in seconds) of the run that found them; ``instants`` is what the run observed."""

    formations: DataFrame
    timings: DataFrame
    instants: int


def timed_detection(field: DataFrame, spec: GridSpec, value: str = "h") -> Timed:
    """Runs a detection whose plan reads the clock.

    ``init`` is the time from the start of reading until the slices stand ready. Part 1 of an instant is the time from its first sample to its last in the task that
    samples it, part 2 that of its ray and north walks; what only concerns a few cluster rows (components, folds) is in neither. ``total`` is their sum, the work of the run, not its
    duration: instants run side by side. Rows that belong to no instant have instant -1."""
    seen, began = Observation("slices"), time.perf_counter()
    slices = stage(to_slices(field, spec, value).observe(seen, F.count("*").alias("instants")), "slices")
    init = time.perf_counter() - began
    votes = stage(votes_from_slices(slices, spec, measured=True), "votes")
    extrema = classify(votes.where(F.col("x") < spec.size_x).drop("clock"), spec)
    labelled = stage(label_components(C.typed_points(extrema).select("time", "x", "y", "type", "raw"), spec.size_x, spec.size_y), "labelled")
    kept = stage(C.reindex(C.band_filter(C.cluster_summary(labelled, spec), spec)), "clusters")
    found = Detection(slices, extrema, labelled, kept, spec)
    walked = found.walks(measured=True)
    formations = stage(B.formations(found.candidates(walked)), "formations")
    # one reading a coarse row is enough: the first column's
    first = votes.where("y <= 0").groupBy("time").agg(((F.max("clock") - F.min("clock")) / 1e9).alias("s"))
    parts = first.select(F.lit("1").alias("part"), F.col("time").alias("instant"), "s").unionByName(
        walked.select(F.lit("2").alias("part"), F.col("time").alias("instant"), (F.col("took") / 1e9).alias("s")))
    parts = stage(parts, "parts")
    whole = parts.agg((F.coalesce(F.sum("s"), F.lit(0.0)) + init).alias("s"))
    ends = whole.select(F.explode(F.array(F.struct(F.lit("init").alias("part"), F.lit(init).alias("s")), F.struct(F.lit("total").alias("part"), F.col("s").alias("s")))).alias("e"))
    rows = parts.unionByName(ends.select("e.part", F.lit(-1).alias("instant"), "e.s"))
    return Timed(formations, rows.select("part", "instant", F.col("s").alias("time_elapsed")), seen.get["instants"])
