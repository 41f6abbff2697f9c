"""Operator inputs derived from the given tables.

The field has one instant per 1000 consecutive events, so its size follows the table.
Scenario bumps: (amplitude, lat, lon, lat width, lon width).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohypsa.params import GridSpec
from isohypsa.sources.grid import shuffle_width

SPEC = GridSpec(res=2.5, step=1, lat_min=0)
# Temperature lattice: every third row and column.
HEAT_SPEC = GridSpec(res=2.5, step=3, lat_min=0)
EVENTS_PER_INSTANT = 1000

SCENARIOS = [
    [(330, 60.0, 0.0, 9.0, 16.0), (-170, 47.5, -25.0, 7.0, 10.0), (-170, 47.5, 25.0, 7.0, 10.0)],
    [(260, 60.0, 0.0, 6.0, 14.0), (-160, 42.5, -2.5, 8.0, 18.0), (150, 55.0, -30.0, 8.0, 30.0)],
    [(320, 60.0, 0.0, 6.0, 18.0), (-220, 42.5, 0.0, 6.0, 10.0), (300, 55.0, -50.0, 16.0, 25.0)],
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(
        F.floor(F.col("event_id") / EVENTS_PER_INSTANT).cast("int").alias("time"),
    ).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("s"))


def synth_field(params: DataFrame, spec: GridSpec = SPEC, scenarios: list | None = None) -> DataFrame:
    """field(time, i, j, h) from rows (time, s): base slope plus the three bumps of the scenario."""
    scenarios = scenarios or SCENARIOS

    # the scenario of an instant is looked up once for its whole grid: a cell is three bumps, not three of each scenario
    def of_scenario(n: int, at: int) -> str:
        return f"CASE time % {len(scenarios)} {' '.join(f'WHEN {k} THEN {float(sc[n][at])}D' for k, sc in enumerate(scenarios))} END"

    told = [F.expr(f"{of_scenario(n, at)}{(' + (s % 11 - 5)' if n == 0 else ' + 0') if at == 0 else ''}").alias(f"{c}{n}") for n in range(3) for at, c in enumerate(("amp", "blat", "blon", "slat", "slon"))]
    names = [f"{c}{n}" for n in range(3) for c in ("amp", "blat", "blon", "slat", "slon")]
    grid = params.select("time", *told).select(
        "time", *names, F.explode(F.sequence(F.lit(0), F.lit(spec.nlat - 1))).alias("i"),
    ).select(
        "time", *names, "i", F.explode(F.sequence(F.lit(0), F.lit(spec.nlon - 1))).alias("j"),
        (F.lit(90.0) - F.col("i") * F.lit(float(spec.res))).alias("lat"),
    ).withColumn("lon", F.lit(-180.0) + F.col("j") * F.lit(float(spec.res)))

    def bump(n: int) -> str:
        u, v = f"((lat - blat{n}) / slat{n})", f"((lon - blon{n}) / slon{n})"
        return f"amp{n} * exp(-({u} * {u} + {v} * {v}))"

    h = f"floor(5900D - 8D * greatest(lat - 25D, 0D) + ({bump(0)}) + ({bump(1)}) + ({bump(2)}) + 0.5D)"
    return grid.select("time", "i", "j", F.expr(f"CAST({h} AS INT) AS h"))


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    # (time, s) rows are tiny but each becomes a whole grid: fix the number of partitions, or
    # adaptive execution would merge them into one by their bytes
    spread = instants(spark, sf_dir).repartition(shuffle_width(spark), "time", "s")
    return synth_field(spread)
