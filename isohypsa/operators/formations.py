"""Blocking formations from cluster rows, their thresholds and the north-walk levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohypsa.functions.geo import haversine_km, stable_km, with_unwrapped_pair
from isohypsa.operators.rays import passes
from isohypsa.params import EARTH_RADIUS_KM, UNSET, GridSpec

LAT_BIN_DEG = 27.0


def near_pairs(clusters: DataFrame, spec: GridSpec) -> DataFrame:
    """Same-instant MAX x MIN pairs within the search radius. Latitude bins at least as tall as
    the radius make it an equi-join on (time, bin): a MAX visits its own bin and both neighbours."""
    bin_deg = max(LAT_BIN_DEG, spec.search_km / (EARTH_RADIUS_KM * 3.14159 / 180) + 0.1)
    lat_bin = F.floor(F.col("center_lat") / F.lit(bin_deg)).cast("int")
    cols = ("id", "center_lat", "center_lon", "contour")
    top = clusters.where("type = 'MAX'").select(
        "time", *[F.col(c).alias(f"max_{c}") for c in cols],
        F.explode(F.array(lat_bin - 1, lat_bin, lat_bin + 1)).alias("bin"),
    )
    low = clusters.where("type = 'MIN'").select(
        "time", *[F.col(c).alias(f"min_{c}") for c in cols], lat_bin.alias("bin"),
    )
    km = haversine_km(
        F.col("min_center_lat"), F.col("min_center_lon"), F.col("max_center_lat"), F.col("max_center_lon"),
    )
    return top.join(low, ["time", "bin"]).drop("bin").withColumn("km", km).where(F.col("km") <= spec.search_km)


def open_levels(levels: DataFrame, limits: DataFrame) -> DataFrame:
    """North-walk levels not closed around the MAX, marked as an OMEGA or a REX opportunity."""
    kind = F.lit("MAX")
    lev = F.col("level")
    j = levels.join(limits.where("type = 'MAX'"), ["time", "id"])
    most_both = passes("right_most", lev, kind) & passes("left_most", lev, kind)
    bottom = passes("bottom_all", lev, kind)
    search = F.when(most_both & ~bottom, "OMEGA").when(
        bottom & passes("right_all", lev, kind) & ~passes("left_all", lev, kind), "REX",
    )
    return j.where(~passes("closed_at", lev, kind)).select(
        "time", F.col("id").alias("max_id"), "level", "first_k", search.alias("search"),
    ).where(F.col("search").isNotNull())


def formation_candidates(pairs: DataFrame, levels: DataFrame, limits: DataFrame, spec: GridSpec) -> DataFrame:
    """Minima that may complete a formation, per (MAX, level); ``search`` tells which kind."""
    kind, lev = F.lit("MIN"), F.col("level")
    minima = limits.where("type = 'MIN'").withColumnRenamed("id", "min_id").drop("type")
    c = (
        pairs.where(F.col("min_center_lat") <= F.col("max_center_lat"))
        .join(minima, ["time", "min_id"])
        .join(levels, ["time", "max_id"])
        .where(~passes("closed_at", lev, kind))
    )
    c = with_unwrapped_pair(c, "max_center_lon", "min_center_lon")
    inner = F.when(F.col("side") == "WEST", passes("right_most", lev, kind)).otherwise(
        passes("left_most", lev, kind)
    )
    omega = (
        (F.col("max_contour") != F.col("min_contour")) & F.col("side").isNotNull()
        & passes("bottom_most", lev, kind) & inner
    )
    rex = (
        (F.abs(F.col("max_center_lon") - F.col("min_center_lon")) <= spec.rex_dlon)
        & passes("bottom_all", lev, kind) & passes("left_all", lev, kind) & passes("top_most", lev, kind)
    )
    return c.where(F.when(F.col("search") == "OMEGA", omega).otherwise(rex)).select(
        "time", "max_id", "search", "first_k", "level", "min_id", "side",
        "max_center_lat", "max_center_lon", "min_center_lat", "min_center_lon", stable_km(F.col("km")).alias("km"),
    )


def omega_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.col("search") == "OMEGA").drop("search", "km")


def rex_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.col("search") == "REX").select("time", "max_id", "first_k", "level", "min_id", "km")


def _km(a: Column, b: Column) -> Column:
    return stable_km(haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]))


def _queue() -> Column:
    """One candidate of the fold, ordered by (level in first-visit order, cluster id)."""
    def point(role: str) -> Column:
        return F.struct(
            F.col(f"{role}_id").cast("int").alias("id"), F.col(f"{role}_center_lat").cast("double").alias("lat"),
            F.col(f"{role}_center_lon").cast("double").alias("lon"),
        )

    return F.struct("first_k", "min_id", "side", point("min").alias("low"), point("max").alias("top"))


def _fold(queue: Column) -> Column:
    """Order-dependent choice of the western and eastern minimum.

    Both sides share one score. An unset partner is a point at 1e30 degrees and takes part in the
    distances."""
    point = "struct<id:int,lat:double,lon:double>"
    unset = F.struct(
        F.lit(-1).alias("id"), F.lit(UNSET).cast("float").cast("double").alias("lat"),
        F.lit(UNSET).cast("float").cast("double").alias("lon"),
    ).cast(point)
    start = F.struct(
        F.lit(UNSET).alias("score"), unset.alias("west"), unset.alias("east"),
    ).cast(f"struct<score:double,west:{point},east:{point}>")

    def visit(state: Column, c: Column) -> Column:
        west = c["side"] == "WEST"
        other = F.when(west, state["east"]).otherwise(state["west"])
        plain = (_km(c["low"], c["top"]) + _km(c["low"], other) + _km(other, c["top"])) / 3
        score = F.when(c["low"]["lat"] < other["lat"], plain * F.lit(1 - 0.05)).otherwise(plain)
        allowed = west | (c["low"]["lat"] < state["east"]["lat"])
        better = allowed & (score < state["score"])
        return F.struct(
            F.when(better, plain).otherwise(state["score"]).alias("score"),
            F.when(better & west, c["low"]).otherwise(state["west"]).alias("west"),
            F.when(better & ~west, c["low"]).otherwise(state["east"]).alias("east"),
        )

    return F.aggregate(queue, start, visit)


def omega_fold(candidates: DataFrame) -> DataFrame:
    """West and east minimum of each MAX. A group is one MAX of one instant: at most levels x
    minima of that instant."""
    folded = candidates.groupBy("time", "max_id").agg(F.sort_array(F.collect_list(_queue())).alias("q")).select(
        "time", "max_id", _fold(F.col("q")).alias("s"),
    )
    return folded.select(
        "time", "max_id", F.col("s.west.id").alias("west_id"), F.col("s.east.id").alias("east_id"),
        F.when((F.col("s.west.id") >= 0) | (F.col("s.east.id") >= 0), F.col("s.score")).alias("score"),
    )


def rex_nearest(candidates: DataFrame) -> DataFrame:
    """Nearest candidate; on equal distance the earlier level, then the lower id."""
    return candidates.groupBy("time", "max_id").agg(
        F.min(F.struct("km", "first_k", "min_id")).alias("best"),
    ).select("time", "max_id", F.col("best.min_id").alias("rex_id"), F.col("best.km").alias("rex_km"))


def resolve(omega: DataFrame, rex: DataFrame) -> DataFrame:
    """REX when found, else OMEGA when both sides are found."""
    both = omega.where((F.col("west_id") >= 0) & (F.col("east_id") >= 0)).select(
        "time", "max_id", "west_id", "east_id",
    )
    j = both.join(rex.select("time", "max_id", "rex_id"), ["time", "max_id"], "full_outer")
    is_rex = F.col("rex_id").isNotNull()
    return j.select(
        "time", "max_id",
        F.when(is_rex, F.col("rex_id")).otherwise(F.col("west_id")).alias("min1_id"),
        F.when(is_rex, F.lit(-1)).otherwise(F.col("east_id")).alias("min2_id"),
        F.when(is_rex, "REX").otherwise("OMEGA").alias("type"),
    )


def formations(candidates: DataFrame) -> DataFrame:
    """``resolve`` of the fold and the nearest REX minimum in one aggregation per (time, MAX)."""
    is_rex = F.col("search") == "REX"
    found = candidates.groupBy("time", "max_id").agg(
        F.sort_array(F.collect_list(F.when(~is_rex, _queue()))).alias("q"),
        F.min(F.when(is_rex, F.struct("km", "first_k", "min_id"))).alias("rex"),
    ).select("time", "max_id", F.col("rex.min_id").alias("rex_id"), _fold(F.col("q")).alias("s"))
    rex = F.col("rex_id").isNotNull()
    return found.where(rex | ((F.col("s.west.id") >= 0) & (F.col("s.east.id") >= 0))).select(
        "time", "max_id",
        F.when(rex, F.col("rex_id")).otherwise(F.col("s.west.id")).alias("min1_id"),
        F.when(rex, F.lit(-1)).otherwise(F.col("s.east.id")).alias("min2_id"),
        F.when(rex, "REX").otherwise("OMEGA").alias("type"),
    )


def formation_clusters(formations: DataFrame, clusters: DataFrame) -> DataFrame:
    """Resolve the ids of a formation to centre and contour of each partner."""
    out = formations
    for role in ("max", "min1", "min2"):
        side = clusters.select(
            "time", F.col("id").alias(f"{role}_id"), F.col("center_lat").alias(f"{role}_lat"),
            F.col("center_lon").alias(f"{role}_lon"), F.col("type").alias(f"{role}_type"),
            F.col("contour").alias(f"{role}_contour"),
        )
        out = out.join(side, ["time", f"{role}_id"], "left")
    return out
