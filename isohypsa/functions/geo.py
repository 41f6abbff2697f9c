"""Geometry as Column expressions and DataFrame transforms (no UDFs)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohypsa.params import EARTH_RADIUS_KM, GRAVITY, KELVIN_OFFSET, GridSpec


def rad(deg: Column) -> Column:
    return deg.cast("double") * F.lit(math.pi) / F.lit(180.0)


def deg(r: Column) -> Column:
    return r.cast("double") * F.lit(180.0) / F.lit(math.pi)


def round_half_away(x: Column) -> Column:
    """Round a double half away from zero to bigint; cheaper in codegen than round()."""
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a1, a2 = rad(lat1), rad(lat2)
    s1 = F.sin((a2 - a1) / 2)
    s2 = F.sin((rad(lon2) - rad(lon1)) / 2)
    a = s1 * s1 + F.cos(a1) * F.cos(a2) * s2 * s2
    return F.lit(float(EARTH_RADIUS_KM)) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def stable_km(d: Column) -> Column:
    """Distance rounded to a millimetre so that mirrored geometries tie exactly."""
    return F.round(d, 6)


def with_haversine(df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, out: str = "km") -> DataFrame:
    return df.withColumn(out, haversine_km(F.col(lat1), F.col(lon1), F.col(lat2), F.col(lon2)))


def with_turn(df: DataFrame, lat: str, dist_km: Column, bearing: Column, out_lat: str = "dest_lat", out_turn: str = "turn") -> DataFrame:
    """Latitude of the great-circle destination and the change of longitude on the way, in radians: both
    depend on the latitude of the start alone. Points are single precision, also while in radians."""
    pi = f"{math.pi!r}D"
    staged = df.withColumns({
        "_be": rad(bearing), "_ad": dist_km.cast("double") / F.lit(float(EARTH_RADIUS_KM)), "_la": F.expr(_single(f"{_single(lat)} * {pi} / 180D")),
    }).withColumn("_fa", F.expr(_single("asin(sin(_la) * cos(_ad) + cos(_la) * sin(_ad) * cos(_be))")))
    return staged.withColumns({
        out_lat: F.expr(f"CAST(_fa * 180D / {pi} AS FLOAT)"),
        out_turn: F.expr("atan2(sin(_be) * sin(_ad) * cos(_la), cos(_ad) - sin(_la) * sin(_fa))"),
    }).drop("_la", "_be", "_ad", "_fa")


def turned_lon(lon: str, turn: str) -> Column:
    """Longitude after a turn, in single precision and not wrapped."""
    pi = f"{math.pi!r}D"
    start = _single(f"{_single(lon)} * {pi} / 180D")
    return F.expr(f"CAST({_single(f'{start} + {turn}')} * 180D / {pi} AS FLOAT)")


def _single(x: str) -> str:
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"


def with_destination(
    df: DataFrame, lat: str, lon: str, dist_km: Column, bearing: Column,
    out_lat: str = "dest_lat", out_lon: str = "dest_lon",
) -> DataFrame:
    """Great-circle destination. Points are single precision, also while in radians;
    the longitude is not wrapped."""
    turned = with_turn(df, lat, dist_km, bearing, out_lat, "_turn")
    return turned.withColumn(out_lon, turned_lon(lon, "_turn")).drop("_turn")


def with_bilinear_weights(df: DataFrame, spec: GridSpec, lat: str = "dest_lat", lon: str = "dest_lon") -> DataFrame:
    """Row/column of the lower-left enclosing node (``i_lo``, ``j_lo``) and the four node
    weights in single precision; all NULL when one of the nodes is off the grid.

    Node order: (lat_lo, lon_lo), (lat_lo, lon_hi), (lat_hi, lon_lo), (lat_hi, lon_hi).
    With ``spec.compat`` the weights of the two mixed nodes are exchanged.
    """
    r = f"{float(spec.res)!r}D"
    area = f"CAST(CAST({float(spec.res) ** 2!r}D AS FLOAT) AS DOUBLE)"
    df = df.withColumns({
        "_fl": F.expr(f"floor(CAST({lat} AS DOUBLE) / {r})"), "_fo": F.expr(f"floor(CAST({lon} AS DOUBLE) / {r})"),
    }).withColumns({
        "_i": F.expr(f"CAST({spec.north} - _fl AS INT)"), "_j": F.expr(f"CAST(_fo + {spec.west} AS INT)"),
        # distances to the enclosing nodes, single precision
        "_dn": F.expr(f"CAST((_fl + 1) * {r} AS FLOAT) - {lat}"), "_ds": F.expr(f"{lat} - CAST(_fl * {r} AS FLOAT)"),
        "_de": F.expr(f"CAST((_fo + 1) * {r} AS FLOAT) - {lon}"), "_dw": F.expr(f"{lon} - CAST(_fo * {r} AS FLOAT)"),
    })
    ok = f"_i BETWEEN 1 AND {spec.nlat - 1} AND _j BETWEEN 0 AND {spec.nlon - 2}"

    def weight(a: str, b: str) -> Column:
        return F.expr(f"CASE WHEN {ok} THEN CAST(CAST({a} * {b} AS DOUBLE) / {area} AS FLOAT) END")

    mixed_hi, mixed_lo = weight("_ds", "_de"), weight("_dn", "_dw")
    if not spec.compat:
        mixed_hi, mixed_lo = mixed_lo, mixed_hi
    return df.withColumns({
        "i_lo": F.expr(f"CASE WHEN {ok} THEN _i END"), "j_lo": F.expr(f"CASE WHEN {ok} THEN _j END"),
        "w11": weight("_dn", "_de"), "w12": mixed_hi, "w21": mixed_lo, "w22": weight("_ds", "_dw"),
    }).drop("_fl", "_fo", "_i", "_j", "_dn", "_ds", "_de", "_dw")


def interpolate(w: list[Column], z: list[Column]) -> Column:
    """Weighted sum of the four nodes, rounded to the packed integer."""
    total = w[0].cast("double") * z[0]
    for wi, zi in zip(w[1:], z[1:]):
        total = total + wi.cast("double") * zi
    return round_half_away(total)


def height(raw: Column, spec: GridSpec) -> Column:
    """Packed geopotential to metres; identity when the field already holds metres."""
    if spec.scale is None:
        return raw
    return (raw * F.lit(spec.scale) + F.lit(spec.offset)) / F.lit(GRAVITY)


def celsius(raw: Column, scale: float, offset: float) -> Column:
    return raw * F.lit(scale) + F.lit(offset) - F.lit(KELVIN_OFFSET)


def pack_int16(value: Column, scale: float, offset: float) -> Column:
    """(value - offset) / scale truncated toward zero; NULL outside int16."""
    x = (value.cast("double") - F.lit(offset)) / F.lit(scale)
    t = F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))
    return F.when(t.between(-32768, 32767), t).cast("smallint")


def contour_level(h: Column, step: int = 20) -> Column:
    """h minus int(h) modulo step, truncated to int."""
    return (h - (h.cast("int") % F.lit(step))).cast("int")


def snap(x: Column, res: float) -> Column:
    """Nearest multiple of res, half away from zero. The inner rounding makes exact halves
    (symmetric clusters) independent of the last bit of the trigonometry."""
    return round_half_away(F.round(x / F.lit(float(res)), 9)) * F.lit(float(res))


def row_of(lat: Column, spec: GridSpec) -> Column:
    return (F.lit(spec.north) - lat / F.lit(spec.res)).cast("int")


def col_of(lon: Column, spec: GridSpec) -> Column:
    """Column of a longitude on the axis, -1 when it is not a column (e.g. +180)."""
    j = (lon / F.lit(spec.res) + F.lit(spec.west)).cast("int")
    return F.when(j.between(0, spec.nlon - 1), j).otherwise(F.lit(-1))


def lat_of(i: Column, spec: GridSpec) -> Column:
    return F.lit(90.0) - i * F.lit(float(spec.res))


def lon_of(j: Column, spec: GridSpec) -> Column:
    return F.lit(-180.0) + j * F.lit(float(spec.res))


def with_unwrapped_pair(df: DataFrame, lon_a: str, lon_b: str, out_a: str = "lon_a_int", out_b: str = "lon_b_int",
                        side: str = "side") -> DataFrame:
    """Across the date line the larger longitude loses 360; both become integers, and b lies
    WEST or EAST of a (NULL when the integers agree)."""
    a, b = F.col(lon_a), F.col(lon_b)
    far = F.abs(a - b) >= 180
    df = df.withColumns({
        out_a: F.when(far & (a > b), a - 360).otherwise(a).cast("int"),
        out_b: F.when(far & (a <= b), b - 360).otherwise(b).cast("int"),
    })
    return df.withColumn(
        side,
        F.when(F.col(out_b) < F.col(out_a), "WEST").when(F.col(out_b) > F.col(out_a), "EAST"),
    )


def with_cell_step(df: DataFrame, lat: str, res: float, out: str = "step_km") -> DataFrame:
    """East-west size in km of one grid cell at a latitude."""
    return df.withColumn(out, cell_step_km(F.col(lat), res))


def with_bearing_walk(df: DataFrame, lat: str, lon: str, bearing: str, res: float, n_steps: int) -> DataFrame:
    """``n_steps`` successive great-circle steps of one cell width along a bearing column."""
    cur = df.withColumns({"walk_lat": F.col(lat).cast("float"), "walk_lon": F.col(lon).cast("float")})
    for _ in range(n_steps):
        cur = with_cell_step(cur, "walk_lat", res, "_step")
        cur = with_destination(cur, "walk_lat", "walk_lon", F.col("_step"), F.col(bearing), "_wl", "_wo")
        cur = cur.withColumns({"walk_lat": F.col("_wl"), "walk_lon": F.col("_wo")}).drop("_step", "_wl", "_wo")
    return cur


def destination(lat: Column, lon: Column, dist_km: Column, bearing: Column) -> Column:
    """Great-circle destination as a struct (lat, lon), for use inside folds; points are single precision, also while in radians."""
    single = lambda c: c.cast("float").cast("double")
    start = F.struct(single(rad(single(lat))).alias("la"), single(rad(single(lon))).alias("lo"), rad(bearing).alias("be"), (dist_km / F.lit(float(EARTH_RADIUS_KM))).alias("ad"))
    # an array of one element names a value that is used more than once
    reached = F.transform(F.array(start), lambda s: F.struct(
        s["la"].alias("la"), s["lo"].alias("lo"), s["be"].alias("be"), s["ad"].alias("ad"),
        single(F.asin(F.sin(s["la"]) * F.cos(s["ad"]) + F.cos(s["la"]) * F.sin(s["ad"]) * F.cos(s["be"]))).alias("fa")))
    point = F.transform(reached, lambda s: F.struct(
        deg(s["fa"]).cast("float").alias("lat"),
        deg(single(s["lo"] + F.atan2(F.sin(s["be"]) * F.sin(s["ad"]) * F.cos(s["la"]), F.cos(s["ad"]) - F.sin(s["la"]) * F.sin(s["fa"])))).cast("float").alias("lon")))
    return F.get(point, F.lit(0))


def cell_step_km(lat: Column, res: float) -> Column:
    return F.lit(float(EARTH_RADIUS_KM)) * F.cos(rad(lat)) * (F.lit(float(res)) * math.pi / 180.0)


def with_walk_to(df: DataFrame, lat: str, lon: str, bearing: str, to_lat: str, to_lon: str, res: float, most: int = 1000, least: int = 2) -> DataFrame:
    """Great-circle steps of one cell width along a bearing until the point is neither south nor west of the target: ``walk_lat``, ``walk_lon``,
    ``n_steps`` and ``reached``.

    The first ``least`` steps are always taken. A walk that never gets there ends after ``most`` steps, not reached. It is a fold over the row's own steps: once it has stopped, the point is
    handed on without arithmetic. A null start, bearing or target has no walk."""
    ahead = lambda a: (a["lat"] < F.col(to_lat)) | (a["lon"] < F.col(to_lon))

    def step(a: Column, k: Column) -> Column:
        p = destination(a["lat"], a["lon"], cell_step_km(a["lat"], res), F.col(bearing))
        moved = F.get(F.transform(F.array(p), lambda q: F.struct(q["lat"].alias("lat"), q["lon"].alias("lon"), (a["n"] + 1).alias("n"))), F.lit(0))
        return F.when((k <= least) | ahead(a), moved).otherwise(a)

    start = F.struct(F.col(lat).cast("float").alias("lat"), F.col(lon).cast("float").alias("lon"), F.lit(0).alias("n"))
    known = F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(bearing).isNotNull() & F.col(to_lat).isNotNull() & F.col(to_lon).isNotNull()
    walked = df.withColumn("_w", F.when(known, F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)))
    return walked.withColumns({
        "walk_lat": F.col("_w.lat"), "walk_lon": F.col("_w.lon"), "n_steps": F.col("_w.n"), "reached": ~ahead(F.col("_w")),
    }).drop("_w")


def with_line_fit(df: DataFrame, x1: str, y1: str, x2: str, y2: str) -> DataFrame:
    """Slope and intercept of the line through two points; NULL for a vertical line."""
    m = F.try_divide(F.col(y2) - F.col(y1), F.col(x2) - F.col(x1))
    return df.withColumn("slope", m).withColumn("intercept", F.col(y1) - F.col("slope") * F.col(x1))


def line_raster(df: DataFrame, x1: str, y1: str, x2: str, y2: str) -> DataFrame:
    """Integer points of each line, walked along the longer axis."""
    fit = with_line_fit(df, x1, y1, x2, y2)
    dx = (F.col(x2) - F.col(x1)).cast("int")
    dy = (F.col(y2) - F.col(y1)).cast("int")
    along_x = dx >= dy
    lo = F.when(along_x, F.col(x1).cast("int")).otherwise(F.col(y1).cast("int"))
    hi = F.when(along_x, F.floor(F.col(x2))).otherwise(F.floor(F.col(y2))).cast("int")
    walked = (
        fit.withColumns({"_ax": along_x, "_lo": lo, "_hi": hi})
        .where(F.col("_lo") <= F.col("_hi"))
        .withColumn("_s", F.explode(F.sequence("_lo", "_hi")))
    )
    across = F.when(
        F.col("_ax"), F.col("slope") * F.col("_s") + F.col("intercept"),
    ).otherwise(F.try_divide(F.col("_s") - F.col("intercept"), F.col("slope")))
    walked = walked.withColumn("_t", round_half_away(across).cast("int"))
    return walked.withColumns({
        "px": F.when(F.col("_ax"), F.col("_s")).otherwise(F.col("_t")),
        "py": F.when(F.col("_ax"), F.col("_t")).otherwise(F.col("_s")),
    }).drop("_ax", "_lo", "_hi", "_s", "_t")
