"""Queries of data sets with axes and metadata, and of maps as they are asked for by date."""

from __future__ import annotations

from pyspark.sql import functions as F

from isohypsa.functions import geo as G
from isohypsa.operators import maps as M
from isohypsa.plans import requested as Q
from isohypsa.registry.base import query
from isohypsa.registry.detection import HEAT, OFFSET, RAW_SQL, SCALE, packed, staged
from isohypsa.registry.inputs import SPEC, field, instants, table
from isohypsa.registry.mapdata import AREA, AREA_SQL, AXIS_SQL, LABEL_SQL, MEMBER_CHAIN, UNWRAP, axis, crossings_sql, joined, with_ctes
from isohypsa.registry.sql import chain
from isohypsa.sources import dataset as DS
from isohypsa.sources import grid as S
from isohypsa.sources import results as R
from isohypsa.sources.grid import PACKING
from isohypsa.staging import scratch_path

T_SCALE, T_OFFSET, _ = PACKING["t"]
T_RAW = f"trunc((h*0.05::DOUBLE + 13.15::DOUBLE - {T_OFFSET}::DOUBLE)/{T_SCALE}::DOUBLE)"
#: Physical values of both variables on the turned axis.
VALUES = f"""vals AS MATERIALIZED (SELECT 'z' AS var, time, i, j, ({RAW_SQL}*{SCALE}::DOUBLE + {OFFSET}::DOUBLE)/9.80665::DOUBLE AS v FROM field
  UNION ALL SELECT 't', time, i, j, CASE WHEN {T_RAW} BETWEEN -32768 AND 32767 THEN CAST({T_RAW} AS SMALLINT) END*{T_SCALE}::DOUBLE + {T_OFFSET}::DOUBLE - 273.15::DOUBLE FROM field)"""


def two_variables(s, d):
    """The field as geopotential and as temperature, packed, on an axis from 0 to 360, as a stored data set read back."""
    turned = ((F.col("j") + SPEC.nlon // 2) % SPEC.nlon).cast("int").alias("j")
    z = packed(s, d).select(F.lit("z").alias("var"), "time", "i", turned, "raw")
    t = field(s, d).select(F.lit("t").alias("var"), "time", "i", turned, G.pack_int16(F.col("h") * F.lit(HEAT[0]) + F.lit(HEAT[1]), T_SCALE, T_OFFSET).alias("raw"))
    lons = s.range(SPEC.nlon).select(F.col("id").cast("int").alias("j"), (F.col("id") * F.lit(SPEC.res)).alias("lon"))
    meta = s.createDataFrame([(v, *PACKING[v]) for v in ("z", "t")], "var string, scale_factor double, add_offset double, long_name string")
    path = scratch_path(s, "dataset")
    DS.save_dataset(DS.Dataset(z.unionByName(t), S.axis_lat(s, SPEC), lons, axis(s, d), meta), path)
    return DS.load_dataset(s, path, ["t", "z"])


@query("S01_load_dataset", with_ctes(chain("field"), VALUES) + "SELECT var, time, i, j, 90 - 2.5::DOUBLE*i AS lat, -180 + 2.5::DOUBLE*j AS lon, round(v, 6) AS value FROM vals")
def _load_dataset(s, d):
    data = two_variables(s, d)
    return DS.located(DS.unpacked(data.field, data.meta), data).select("var", "time", "i", "j", "lat", "lon", F.round("value", 6).alias("value"))


@query("S01_axes_and_metadata", with_ctes(chain("field"), AXIS_SQL) + f"""SELECT 'lat' AS axis, CAST(i AS INTEGER) AS at, 90 - 2.5::DOUBLE*i AS value, CAST(NULL AS VARCHAR) AS told FROM range(73) r(i)
  UNION ALL SELECT 'lon', CAST(j AS INTEGER), 2.5::DOUBLE*j, NULL FROM range(144) r(j) UNION ALL SELECT 'time', time, NULL, label FROM axis
  UNION ALL SELECT 'scale', n, v, w FROM (VALUES (0, {T_SCALE}::DOUBLE, 'Temperature'), (1, {SCALE}::DOUBLE, 'Geopotential')) x(n, v, w)""")
def _axes(s, d):
    data = two_variables(s, d)
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    one = lambda name, at, value, told: [F.lit(name).alias("axis"), at.cast("int").alias("at"), value.cast("double").alias("value"), told.alias("told")]
    return (data.lats.select(one("lat", F.col("i"), F.col("lat"), text)).unionByName(data.lons.select(one("lon", F.col("j"), F.col("lon"), text)))
            .unionByName(data.times.select(one("time", F.col("time"), none, M.time_label(F.col("ts")))))
            .unionByName(data.meta.select(one("scale", F.when(F.col("var") == "t", 0).otherwise(1), F.col("scale_factor"), F.col("long_name")))))


# --- contour maps by date -----------------------------------------------------------------------

AREAS = ((80.0, -60.0, 20.0, 60.0), (60.0, 100.0, 10.0, 180.0), (10.2, 0.0, 10.1, 5.0), (90.0, -180.0, -90.0, -150.0))
SIDES = ("north", "west", "south", "east")


def map_requests(s, d):
    """A request of each supplier: two of all instants are not on the axis, one variable of five is unknown, one area of four holds no cell."""
    k = F.col("s_suppkey")
    n = instants(s, d).agg(F.max("time") + 2).scalar()
    ts = F.expr("timestamp'2024-01-01 00:00:00'") + F.make_dt_interval(hours=((k % (n + 1)) * 6).cast("int"))
    pick = lambda m, values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % m + 1).cast("int"))
    rows = table(s, d, "supplier").select(k.alias("request_id"), pick(5, ("geopotential", "Temperature", "GEOPOTENTIAL", "temperature", "wind")).alias("variableName"), ts.alias("ts"),
                                          *[pick(4, [a[side] for a in AREAS]).alias(name) for side, name in enumerate(SIDES)],
                                          F.when(k % 5 % 2 == 1, (2 + k % 3).cast("double")).otherwise((20 + 10 * (k % 3)).cast("double")).alias("step"))
    return rows.select("*", F.year("ts").alias("year"), F.month("ts").alias("month"), F.dayofmonth("ts").alias("day"), F.hour("ts").alias("hour")).drop("ts")


def picked(m, values):
    return "CASE s_suppkey % " + str(m) + "".join(f" WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


MAP_SQL = with_ctes(chain("field"), VALUES, f"""asked AS (SELECT s_suppkey AS request_id, s_suppkey % (m + 1) AS t, m - 2 AS last, {picked(5, ["'z'", "'t'", "'z'", "'t'", 'NULL'])} AS var,
  {', '.join(picked(4, [f'{a[side]}::DOUBLE' for a in AREAS]) + f' AS {name}' for side, name in enumerate(SIDES))},
  CAST(CASE WHEN s_suppkey % 5 % 2 = 1 THEN 2 + s_suppkey % 3 ELSE 20 + 10*(s_suppkey % 3) END AS DOUBLE) AS step FROM supplier, (SELECT MAX(time) + 2 AS m FROM synth))""",
    "crop AS MATERIALIZED (SELECT request_id, step, i, j, 90 - 2.5::DOUBLE*i AS lat, -180 + 2.5::DOUBLE*j AS lon, v FROM asked a JOIN vals x ON x.var = a.var AND x.time = a.t AND 90 - 2.5::DOUBLE*i BETWEEN south AND north AND -180 + 2.5::DOUBLE*j BETWEEN west AND east)",
    "rng AS (SELECT request_id, step, MIN(v) AS vmin, MAX(v) AS vmax, ceil(MIN(v)/10)*10 AS f FROM crop GROUP BY ALL HAVING MIN(v) IS NOT NULL)",
    "lists AS (SELECT *, list_transform(range(greatest(CAST(ceil((vmax - f)/step) AS BIGINT), 0)), lambda k: f + k*step) AS a FROM rng)",
    "lev AS MATERIALIZED (SELECT request_id, CASE WHEN len(a) < 2 THEN list_transform(range(5), lambda k: vmin + (vmax - vmin)*k/4) ELSE a END AS levels FROM lists)")


@query("Q05_maps_by_date", with_ctes(MAP_SQL, """edges AS (SELECT a.*, 'E' AS edge, b.v AS b FROM crop a JOIN crop b ON a.request_id = b.request_id AND a.i = b.i AND b.j = a.j + 1
  UNION ALL SELECT a.*, 'S', b.v FROM crop a JOIN crop b ON a.request_id = b.request_id AND b.i = a.i + 1 AND b.j = a.j)""")
    + """SELECT request_id, edge, round(level, 6) AS level, i, j, round(lat - CASE WHEN edge = 'S' THEN (level - v)/(b - v)*2.5 ELSE 0 END, 6) AS lat, round(lon + CASE WHEN edge = 'E' THEN (level - v)/(b - v)*2.5 ELSE 0 END, 6) AS lon
  FROM edges JOIN (SELECT request_id, unnest(levels) AS level FROM lev) l USING (request_id) WHERE (v < level) <> (b < level)""")
def _maps_by_date(s, d):
    drawn = Q.contour_maps(two_variables(s, d), map_requests(s, d)).crossings
    return drawn.select("request_id", "edge", "i", "j", *[F.round(c, 6).alias(c) for c in ("level", "lat", "lon")])


@query("Q05_levels_by_date", with_ctes(MAP_SQL, AXIS_SQL) + "SELECT request_id, label, array_to_string(list_transform(levels, lambda v: printf('%.3f', v)), ',') AS levels FROM lev JOIN asked USING (request_id) JOIN axis ON axis.time = t")
def _levels_by_date(s, d):
    return Q.contour_maps(two_variables(s, d), map_requests(s, d)).levels.select("request_id", "label", joined(F.col("levels")).alias("levels"))


@query("Q05_maps_not_drawn", MAP_SQL + f"""SELECT request_id, CASE WHEN var IS NULL THEN '{Q.UNKNOWN_VARIABLE}' WHEN t > last THEN '{Q.NO_INSTANT}' WHEN n IS NULL THEN '{Q.NO_CELLS}' ELSE '{Q.NO_RANGE}' END AS reason
  FROM asked LEFT JOIN (SELECT request_id, COUNT(*) AS n, MIN(v) AS vmin FROM crop GROUP BY 1) USING (request_id) WHERE var IS NULL OR t > last OR n IS NULL OR vmin IS NULL""")
def _not_drawn(s, d):
    return Q.contour_maps(two_variables(s, d), map_requests(s, d)).rejects


# --- maps of stored results -----------------------------------------------------------------------


def run_of(time):
    return F.concat(F.lit("run-"), F.col(time) % 3)


def stored_run(s, d, *kinds):
    """The tables of stored results of three runs, detected and written before."""
    base, x = scratch_path(s, "stored"), staged(s, d)
    made = {"selected": lambda: R.selected_rows(x.points, SPEC), "formations": lambda: R.formation_rows(x.formations())}
    for kind in kinds:
        R.write_results(made[kind](), base, kind, run_of("time"))
    return [R.results_table(s, base, kind) for kind in kinds]


def result_requests(s, d):
    """A request of every instant's run by its date."""
    return axis(s, d).select(F.col("time").alias("request_id"), run_of("time").alias("request_hash"), F.year("ts").alias("year"), F.month("ts").alias("month"), F.dayofmonth("ts").alias("day"), F.hour("ts").alias("hour"))


@query("Q06_scatter_map_data", with_ctes(chain("points"), AXIS_SQL) + "SELECT p.time, a.label, 90 - 2.5::DOUBLE*x AS lat, -180 + 2.5::DOUBLE*y AS lon, raw AS value, cluster FROM points p JOIN axis a USING (time)")
def _scatter(s, d):
    points = Q.stored_points(*stored_run(s, d, "selected"), result_requests(s, d), axis(s, d))
    return points.select("time", "label", "lat", "lon", F.col("value").cast("int").alias("value"), "cluster")


@query("Q06_combined_map_data", with_ctes(chain("points", "field"), crossings_sql(AREA_SQL)) + """SELECT time, layer, COUNT(*) AS n, round(SUM(value), 3) AS total FROM (
  SELECT time, level AS value, 'contour' AS layer FROM crossings UNION ALL SELECT time, CAST(raw AS DOUBLE), 'points' FROM points) GROUP BY time, layer""")
def _combined(s, d):
    points = Q.stored_points(*stored_run(s, d, "selected"), result_requests(s, d), axis(s, d))
    lines = M.isoline_crossings(S.to_slices(field(s, d), SPEC), SPEC, 20, AREA).withColumnRenamed("time", "request_id")
    return Q.stored_combined(lines, points).groupBy(F.col("request_id").alias("time"), "layer").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("Q06_formation_map_data", with_ctes(MEMBER_CHAIN, UNWRAP) + LABEL_SQL + ", COUNT(*) AS n_points FROM unwrapped GROUP BY time, max_id, form_type")
def _formation_map(s, d):
    selected, formations = stored_run(s, d, "selected", "formations")
    return Q.stored_formations(formations, selected, result_requests(s, d), axis(s, d)).drop("request_id")
