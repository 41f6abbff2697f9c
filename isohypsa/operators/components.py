"""Connected components of typed lattice cells (8 neighbours, no date-line wrap).

``label_components`` names each component by its smallest row-major scan position. The points of one
instant are bounded by the lattice and are labelled by a small numpy kernel after a single shuffle by
time, on any grid; the relational fixpoint over row runs is its twin in the tests.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from isohypsa.sources.grid import shuffled
from isohypsa.staging import stage


def _kernel(size_y: int):
    """Min-label propagation with pointer jumping on the points of one instant; memory follows the points."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        width = size_y + 2  # a border column keeps rows apart
        at = (pdf["x"].to_numpy(np.int64) + 1) * width + pdf["y"].to_numpy(np.int64) + 1
        cells, first = np.unique(at, return_index=True)
        kind = pd.factorize(pdf["type"])[0][first]
        label = np.arange(len(cells))
        edges = []
        for step in (1, width - 1, width, width + 1):
            to = np.minimum(np.searchsorted(cells, cells + step), max(len(cells) - 1, 0))
            same = (cells[to] == cells + step) & (kind[to] == kind)
            edges.append((np.flatnonzero(same), to[same]))
        a = np.concatenate([e[0] for e in edges])
        b = np.concatenate([e[1] for e in edges])
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, before[a], low)
            np.minimum.at(label, before[b], low)
            label = label[label]
            if np.array_equal(before, label):
                break
        root = cells[label[np.searchsorted(cells, at)]]
        return pdf.assign(root=((root // width - 1) * size_y + (root % width - 1)).astype("int32"))

    return run


def label_components(points: DataFrame, size_x: int, size_y: int, method: str = "slice") -> DataFrame:
    """Add ``root`` (smallest scan position of the component) to ``points(time, x, y, type, ...)``.

    ``relational`` is the independent twin of the kernel, as a fixpoint over row runs."""
    if method == "relational":
        return label_components_relational(points, size_y)
    slim = points.select("time", "x", "y", "type", *[c for c in points.columns if c not in ("time", "x", "y", "type")])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields) + ", root int"
    return slim.groupBy("time").applyInPandas(_kernel(size_y), schema)


def row_runs(points: DataFrame) -> DataFrame:
    """Points with their run: maximal stretches of same-type neighbours within one lattice row."""
    w = W.partitionBy("time", "type", "x").orderBy("y")
    return points.withColumn("_isl", F.col("y") - F.row_number().over(w)).withColumn(
        "y0", F.min("y").over(W.partitionBy("time", "type", "x", "_isl")),
    ).drop("_isl")


def label_components_relational(points: DataFrame, size_y: int) -> DataFrame:
    """Fixpoint over runs: neighbours' minimum, then pointer jumping. Points, runs, edges and the labels of each round are
    written to shared storage, so lost executors do not restart the loop and the points are derived once. Points and runs are
    unfolded from few small rows, so no join may broadcast them; a table read back has the size of its files, where
    checkpoints would keep the planner's product of sizes, whose digits double with every round."""
    tagged = stage(row_runs(points), "tagged")
    runs = stage(tagged.groupBy("time", "type", "x", "y0").agg(F.max("y").alias("y1")).withColumn(
        "run", F.col("x") * size_y + F.col("y0"),
    ), "runs")
    below = runs.select(
        "time", "type", (F.col("x") - 1).alias("x"),
        F.col("y0").alias("b0"), F.col("y1").alias("b1"), F.col("run").alias("other"),
    )
    touching = runs.join(shuffled(below), ["time", "type", "x"]).where(
        (F.col("b0") <= F.col("y1") + 1) & (F.col("b1") >= F.col("y0") - 1)
    ).select("time", "run", "other")
    edges = stage(touching.select("time", F.inline(F.array(
        F.struct("run", "other"), F.struct(F.col("other").alias("run"), F.col("run").alias("other")),
    ))), "edges")
    labels = runs.select("time", "run", F.col("run").alias("root"))
    while True:
        neighbour = (
            edges.join(shuffled(labels.withColumnRenamed("run", "other")), ["time", "other"])
            .groupBy("time", "run").agg(F.min("root").alias("near"))
        )
        lowered = labels.join(shuffled(neighbour), ["time", "run"], "left").select(
            "time", "run", "root", F.least("root", F.coalesce("near", "root")).alias("low"),
        )
        parents = lowered.select("time", F.col("run").alias("low"), F.col("low").alias("jump"))
        step = stage(lowered.join(shuffled(parents), ["time", "low"], "left").select(
            "time", "run", F.col("root").alias("old"), F.least("low", F.coalesce("jump", "low")).alias("root"),
        ), "labels")
        labels = step.select("time", "run", "root")
        if step.where(F.col("old") != F.col("root")).isEmpty():
            break
    return (
        tagged.withColumn("run", F.col("x") * size_y + F.col("y0"))
        .join(shuffled(labels), ["time", "run"]).drop("run", "y0")
    )
