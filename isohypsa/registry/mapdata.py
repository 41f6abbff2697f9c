"""Queries of sources, sinks, geometry over tables, and map data."""

from __future__ import annotations

from pyspark.sql import functions as F

from isohypsa.functions import geo as G
from isohypsa.operators import maps as M
from isohypsa.operators.catalogue import position_by_range
from isohypsa.operators.extrema import clip_and_coarsen
from isohypsa.plans import detect as D
from isohypsa.plans import maps as P
from isohypsa.plans.timings import timed_detection
from isohypsa.registry.base import query
from isohypsa.registry.detection import CUST, HEAT, HOT_OUT, OFFSET, RAW_SQL, SCALE, customer_points, det, packed, staged
from isohypsa.registry.inputs import HEAT_SPEC, SPEC, field, instants, table
from isohypsa.registry.sql import centroid, chain, destination_steps, hav, snap
from isohypsa.sources import grid as S
from isohypsa.sources import results as R
from isohypsa.staging import scratch_path, stage

AREA = (80.0, -60.0, 20.0, 60.0)  # north, west, south, east
AREA_SQL = "lat BETWEEN 20 AND 80 AND lon BETWEEN -60 AND 60"
LOC = "located AS (SELECT time, i, j, 90 - 2.5::DOUBLE*i AS lat, -180 + 2.5::DOUBLE*j AS lon, h FROM field)"
AXIS_SQL = "axis AS (SELECT time, TIMESTAMP '2024-01-01 00:00:00' + time * INTERVAL 6 HOUR AS ts, strftime(TIMESTAMP '2024-01-01 00:00:00' + time * INTERVAL 6 HOUR, '%Y-%m-%d_%HUTC') AS label FROM synth)"


def axis(s, d):
    return instants(s, d).select(
        "time", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, time * 6, 0, 0)").alias("ts"))


def with_ctes(base: str, *extra: str) -> str:
    return base.rstrip("\n") + "".join(",\n" + e for e in extra) + "\n"


def crossings_sql(where: str = "TRUE", source: str = "field") -> str:
    """Every edge against every level of its instant's list, over the cells that the condition leaves."""
    return f"""crop AS MATERIALIZED (SELECT time, i, j, h FROM (SELECT *, 90 - 2.5::DOUBLE*i AS lat, -180 + 2.5::DOUBLE*j AS lon FROM {source}) WHERE {where}),
 rng AS (SELECT time, CAST(MIN(h) AS DOUBLE) AS vmin, CAST(MAX(h) AS DOUBLE) AS vmax, ceil(MIN(h)/10.0::DOUBLE)*10 AS f FROM crop GROUP BY time),
 lists AS (SELECT *, list_transform(range(greatest(CAST(ceil((vmax - f)/20.0::DOUBLE) AS BIGINT), 0)), lambda k: f + k*20.0::DOUBLE) AS a FROM rng),
 lev AS MATERIALIZED (SELECT time, unnest(CASE WHEN len(a) < 2 THEN list_transform(range(5), lambda k: vmin + (vmax - vmin)*k/4.0::DOUBLE) ELSE a END) AS level FROM lists),
 edges AS (SELECT a.time, a.i, a.j, 'E' AS edge, a.h AS a, b.h AS b FROM crop a JOIN crop b ON a.time = b.time AND a.i = b.i AND b.j = a.j + 1
   UNION ALL SELECT a.time, a.i, a.j, 'S', a.h, b.h FROM crop a JOIN crop b ON a.time = b.time AND b.i = a.i + 1 AND b.j = a.j),
 crossings AS (SELECT e.time, i, j, edge, level,
    90 - 2.5::DOUBLE*i - CASE WHEN edge = 'S' THEN (level - a)::DOUBLE/(b - a)*2.5::DOUBLE ELSE 0 END AS lat,
    -180 + 2.5::DOUBLE*j + CASE WHEN edge = 'E' THEN (level - a)::DOUBLE/(b - a)*2.5::DOUBLE ELSE 0 END AS lon
   FROM edges e JOIN lev l ON e.time = l.time AND (a < level) <> (b < level))"""


# --- sources and sinks ------------------------------------------------------------------------


@query("S01_load_grid", chain("field") + "SELECT time, i, j, h FROM field")
def _load_grid(s, d):
    path = scratch_path(s, "grid")
    S.save_grid(field(s, d), path)
    return S.read_grid(s, path).select("time", "i", "j", "h")


query("S02_grid_profile", chain("field") + "SELECT dim, COUNT(*) AS size FROM (SELECT DISTINCT 'nlat' AS dim, i AS v FROM field UNION ALL SELECT DISTINCT 'nlon', j FROM field UNION ALL SELECT DISTINCT 'ntime', time FROM field) GROUP BY dim")(
    lambda s, d: S.grid_profile(field(s, d)))


NAMED = "CASE n_nationkey % 7 WHEN 0 THEN 'z' WHEN 1 THEN 't' WHEN 2 THEN 'latitude' WHEN 3 THEN 'longitude' WHEN 4 THEN 'time' WHEN 5 THEN 'wind' ELSE n_name END"
query("S02_unknown_variables", f"SELECT n_nationkey, {NAMED} AS name FROM nation WHERE {NAMED} NOT IN ('latitude', 'longitude', 'time', 'z', 't')")(
    lambda s, d: S.unknown_variables(table(s, d, "nation").select("n_nationkey", F.expr(NAMED).alias("name"))))


@query("S03_normalize_dataset", chain("field") + f"""SELECT time, i, j, CAST(trunc((h*9.80665::DOUBLE - {OFFSET}::DOUBLE)/{SCALE}::DOUBLE) AS SMALLINT) AS z, false AS out_of_range,
  {SCALE}::DOUBLE AS scale_factor, {OFFSET}::DOUBLE AS add_offset, 'Geopotential' AS long_name FROM field""")
def _normalize(s, d):
    raw = field(s, d).select(
        F.col("time").alias("valid_time"), "i", "j", F.lit("v").alias("expver"), F.lit(0).alias("number"),
        F.explode(F.array(F.struct(F.lit(0).alias("n"), F.lit(500).alias("p")), F.struct(F.lit(1).alias("n"), F.lit(850).alias("p")))).alias("lv"), "h",
    ).select("valid_time", "i", "j", "expver", "number", F.col("lv.p").alias("pressure_level"), (F.col("h") * F.lit(9.80665) + F.col("lv.n")).alias("z"))
    return S.normalize_dataset(raw, "z", levels=[500, 850])


SEL_SQL = """SELECT time, printf('%.2f', 90 - 2.5::DOUBLE*x) AS latitude, printf('%.2f', -180 + 2.5::DOUBLE*y) AS longitude, printf('%.1f', CAST(raw AS DOUBLE)) AS z, type, cluster,
  printf('%.2f', center_lat) AS centroid_lat, printf('%.2f', center_lon) AS centroid_lon FROM points"""
query("S04_sink_selected", chain("points") + SEL_SQL)(lambda s, d: R.selected_rows(det(s, d).points, SPEC))
query("S05_sink_formations", chain("formations") + "SELECT time, max_id, min1_id, min2_id, type FROM formations")(
    lambda s, d: R.formation_rows(staged(s, d).formations()))
query("S06_sink_unfiltered_points", chain("typed") + "SELECT time, printf('%.2f', 90 - 2.5::DOUBLE*x) AS latitude, printf('%.2f', -180 + 2.5::DOUBLE*y) AS longitude, printf('%.1f', CAST(raw AS DOUBLE)) AS z, type, -1 AS cluster FROM typed")(
    lambda s, d: R.unfiltered_rows(D.detect_extrema(field(s, d), SPEC), SPEC))
query("S07_sink_temperature", chain("hotlab", "hotcent") + f"""SELECT time, printf('%.2f', latitude) AS latitude, printf('%.2f', longitude) AS longitude, printf('%.2f', t) AS t, cluster,
  printf('%.2f', centroid_lat) AS centroid_lat, printf('%.2f', centroid_lon) AS centroid_lon FROM ({HOT_OUT})""")(
    lambda s, d: R.temperature_rows(D.heat_clusters(field(s, d), HEAT_SPEC, *HEAT, value="h")))


@query("S08_sink_stage_timings")
def _timings(s, d):
    """Measured times of a detection over the whole field, stored as results of a run and read back."""
    base = scratch_path(s, "speed")
    R.write_results(R.timing_rows(timed_detection(field(s, d), SPEC).timings), base, "speed", "run-0")
    return R.read_results(s, base, "speed", "run-0").select("part", "instant", "time_elapsed")


@query("S08_measured_parts", chain("synth") + "SELECT part, instant, true AS measured FROM (SELECT '1' AS part, time AS instant FROM synth UNION ALL SELECT '2', time FROM synth UNION ALL SELECT 'init', -1 UNION ALL SELECT 'total', -1)")
def _measured(s, d):
    """Which parts of which instants were measured, and whether the times add up: every part is above zero and the total is the sum of the others."""
    found = timed_detection(field(s, d), SPEC)
    told = stage(found.timings, "timings")
    adds_up = told.agg(F.abs(F.sum(F.when(F.col("part") == "total", F.col("time_elapsed")).otherwise(-F.col("time_elapsed")))) < 1e-6).scalar()
    return told.select("part", F.col("instant").cast("int").alias("instant"), ((F.col("time_elapsed") > 0) & adds_up).alias("measured"))


@query("S09_read_results", chain("points") + "SELECT p.time, p.latitude::DOUBLE AS latitude, p.longitude::DOUBLE AS longitude, p.z::DOUBLE AS z, p.type, p.cluster, p.centroid_lat::DOUBLE AS centroid_lat, p.centroid_lon::DOUBLE AS centroid_lon, 'run-0' AS request_hash FROM (" + SEL_SQL + ") p")
def _read_results(s, d):
    base = scratch_path(s, "results")
    R.write_results(R.selected_rows(det(s, d).points, SPEC), base, "selected", "run-0")
    return R.read_results(s, base, "selected", "run-0")


query("S10_run_output_name", """SELECT o_orderkey, 'Geopotential_selected_geopotential_500hPa_' || strftime(o_orderdate, '%Y-%m-%d') || '_' || strftime(o_orderdate + INTERVAL 61 MINUTE, '%d-%m-%Y_%H-%M') || 'UTC.csv' AS name FROM orders""")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", R.run_output_name(
        F.lit("Geopotential"), F.lit("selected"),
        F.concat(F.lit("config/data/geopotential_500hPa_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".nc")),
        F.expr("timestamp(o_orderdate) + interval 61 minutes")).alias("name")))


@query("S11_publish_results", chain("points") + "SELECT 'run-' || time AS request_hash, COUNT(*) AS n_rows FROM points GROUP BY time")
def _publish(s, d):
    """Two publications one after the other, and the rows that are there in the end."""
    base = scratch_path(s, "published")
    rows = R.selected_rows(det(s, d).points, SPEC).withColumn("request_hash", F.concat(F.lit("run-"), F.col("time")))
    rows = stage(rows, "selected")  # both publications read them, and a publication counts before it writes
    for n in range(2):
        R.publish_results(rows.where(F.col("time") % 2 == n), base)
    return s.read.option("header", True).csv(base).groupBy("request_hash").agg(F.count("*").alias("n_rows"))


def listing(s, d, lines=None):
    return (table(s, d, "lineitem") if lines is None else lines).groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("bigint").alias("size")).select(
        F.concat(F.col("l_orderkey"), F.lit("/ln_"), F.col("l_linenumber"), F.lit("."),
                 F.element_at(F.array(*[F.lit(x) for x in ("csv", "svg", "png", "pdf")]), (F.col("l_linenumber") % 4 + 1).cast("int"))).alias("name"), "size")


LISTING = """listing AS (SELECT l_orderkey || '/ln_' || l_linenumber || '.' || (['csv', 'svg', 'png', 'pdf'])[l_linenumber % 4 + 1] AS name, CAST(MAX(l_quantity) AS BIGINT) AS size
 FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
# Two kinds of prefixes over the same keys: an order's folder, and one folder deeper.
PREFIXES = "prefixes AS (SELECT CASE WHEN o_orderstatus = 'F' THEN o_orderkey || '/' ELSE o_orderkey || '/deep' END AS prefix FROM orders)"
DEEP = "deep AS (SELECT CASE WHEN size % 2 = 0 THEN split_part(name, '/', 1) || '/deep/' || split_part(name, '/', 2) ELSE name END AS name, size FROM listing)"


def prefixes(s, d):
    key = F.col("o_orderkey").cast("string")
    return table(s, d, "orders").select(F.when(F.col("o_orderstatus") == "F", F.concat(key, F.lit("/"))).otherwise(F.concat(key, F.lit("/deep"))).alias("prefix"))


def deep_listing(s, d):
    return listing(s, d).withColumn("name", F.when(F.col("size") % 2 == 0, F.regexp_replace("name", "/", "/deep/")).otherwise(F.col("name")))


query("S12_list_objects", f"WITH {LISTING}, {DEEP}, {PREFIXES} SELECT rtrim(prefix, '/') AS prefix, name, size, substr(name, len(rtrim(prefix, '/')) + 2) AS file FROM deep JOIN prefixes ON split_part(prefix, '/', 1) = split_part(name, '/', 1) AND starts_with(name, rtrim(prefix, '/') || '/')")(
    lambda s, d: R.list_objects(deep_listing(s, d), prefixes(s, d)))
query("S12_prefix_exists", f"WITH {LISTING}, {DEEP}, {PREFIXES}, k AS (SELECT DISTINCT split_part(name, '/', 1) AS f FROM deep UNION SELECT DISTINCT split_part(name, '/', 1) || '/deep' FROM deep WHERE name LIKE '%/deep/%') SELECT prefix, rtrim(prefix, '/') IN (SELECT f FROM k) AS exists FROM prefixes")(
    lambda s, d: R.prefix_exists(deep_listing(s, d), prefixes(s, d)))

# --- projections and filters -------------------------------------------------------------------


@query("P04_normalize_lon", chain("field") + "SELECT time, i, CAST((j + 72) % 144 AS INTEGER) AS j, CASE WHEN j >= 72 THEN 2.5::DOUBLE*j - 360 ELSE 2.5::DOUBLE*j END AS lon, h FROM field")
def _normalize_lon(s, d):
    ax = s.range(SPEC.nlon).select(F.col("id").cast("int").alias("j"), (F.col("id") * F.lit(2.5)).alias("lon"))
    return S.normalize_lon(field(s, d), ax).select("time", "i", "j", "lon", "h")


query("P05_clip_and_coarsen", chain("field") + "SELECT time, CAST(i//3 AS INTEGER) AS x, CAST(j//3 AS INTEGER) AS y, h FROM field WHERE i % 3 = 0 AND j % 3 = 0 AND i <= 36 AND j <= 141")(
    lambda s, d: clip_and_coarsen(field(s, d), HEAT_SPEC).select("time", "x", "y", "h"))
query("P06_area_filter", with_ctes(chain("field"), LOC) + f"SELECT time, lat, lon, h AS value FROM located WHERE {AREA_SQL}")(
    lambda s, d: M.area_filter(P.located(field(s, d), SPEC), *AREA).select("time", "lat", "lon", "value"))
query("P07_time_select", with_ctes(chain("synth"), AXIS_SQL) + """SELECT e.event_id, e.label, coalesce(a.time, -1) AS time_index
  FROM (SELECT event_id, strftime(ts, '%Y-%m-%d_%HUTC') AS label FROM events) e LEFT JOIN axis a ON a.label = e.label""")(
    lambda s, d: M.time_select(
        table(s, d, "events").select("event_id", F.year("ts").alias("year"), F.month("ts").alias("month"), F.dayofmonth("ts").alias("day"), F.hour("ts").alias("hour")),
        axis(s, d)).select("event_id", "label", "time_index"))


def dirty(s, d):
    k = F.col("i") + F.col("j")
    return field(s, d).withColumn("v", F.when(k % 7 == 0, float("nan")).when(k % 11 == 0, float("-inf")).otherwise(F.col("h").cast("double")))


query("P09_mask_invalid", chain("field") + "SELECT time, i, j, CASE WHEN (i + j) % 7 <> 0 AND (i + j) % 11 <> 0 THEN CAST(h AS DOUBLE) END AS v FROM field")(
    lambda s, d: M.mask_invalid(dirty(s, d), "v").select("time", "i", "j", "v"))
query("P09_valid_range", chain("field") + "SELECT time, i, MIN(v) AS vmin, MAX(v) AS vmax FROM (SELECT time, i, CASE WHEN (i + j) % 7 <> 0 AND (i + j) % 11 <> 0 THEN CAST(h AS DOUBLE) END AS v FROM field) GROUP BY time, i HAVING MIN(v) IS NOT NULL")(
    lambda s, d: M.valid_range(M.mask_invalid(dirty(s, d), "v"), ["time", "i"], "v"))
query("P17_find_index", f"WITH {CUST} SELECT key, CAST(CASE WHEN lat % 2.5 = 0 THEN (90 - lat)/2.5 ELSE -1 END AS INTEGER) AS i, CAST(CASE WHEN lon % 2.5 = 0 THEN (lon + 180)/2.5 ELSE -1 END AS INTEGER) AS j FROM cust")(
    lambda s, d: M.find_index(M.find_index(customer_points(s, d), "lat", S.axis_lat(s, SPEC), "lat", "i", "i"), "lon", S.axis_lon(s, SPEC), "lon", "j", "j").select("key", "i", "j"))

# --- geometry over tables ---------------------------------------------------------------------

query("G01_haversine", f"WITH {CUST} SELECT key, round({hav('lat', 'lon', 'lat2', 'lon2')}, 6) AS km FROM cust")(
    lambda s, d: G.with_haversine(customer_points(s, d), "lat", "lon", "lat2", "lon2").select("key", F.round("km", 6).alias("km")))
query("G02_destination", f"WITH {CUST} SELECT key, round(dest_lat::DOUBLE, 3) AS dest_lat, round(dest_lon::DOUBLE, 3) AS dest_lon FROM ({destination_steps('cust', 'lat', 'lon', '300', 'bearing', 'key')})")(
    lambda s, d: G.with_destination(customer_points(s, d), "lat", "lon", F.lit(300.0), F.col("bearing")).select(
        "key", F.round(F.col("dest_lat").cast("double"), 3).alias("dest_lat"), F.round(F.col("dest_lon").cast("double"), 3).alias("dest_lon")))
query("G04_contour_level", chain("field") + f"SELECT time, i, j, CAST(trunc(m - trunc(m) % 20) AS INTEGER) AS level FROM (SELECT *, ({RAW_SQL}*{SCALE}::DOUBLE + {OFFSET}::DOUBLE)/9.80665::DOUBLE AS m FROM field)")(
    lambda s, d: packed(s, d).select("time", "i", "j", G.contour_level((F.col("raw") * F.lit(SCALE) + F.lit(OFFSET)) / F.lit(9.80665)).alias("level")))


def cents(x: str) -> str:
    return f"(round(round(({x})/0.25::DOUBLE, 9)) * 0.25::DOUBLE)"


@query("G05_spherical_centroid", f"WITH {CUST} SELECT nation, {cents('atan2(uz, sqrt(ux*ux+uy*uy))*(180.0::DOUBLE/pi())')} AS center_lat, {cents('atan2(uy, ux)*(180.0::DOUBLE/pi())')} AS center_lon FROM (SELECT nation, {centroid('lat', 'lon')} FROM cust GROUP BY nation)")
def _centroid(s, d):
    from isohypsa.operators.clusters import spherical_centroid
    return spherical_centroid(customer_points(s, d), ["nation"], "lat", "lon", 0.25)


query("G06_snap", f"WITH {CUST} SELECT key, {snap('lat*1.37::DOUBLE')} AS snapped FROM cust")(
    lambda s, d: customer_points(s, d).select("key", G.snap(F.col("lat") * F.lit(1.37), 2.5).alias("snapped")))
query("G08_unwrap_set", f"""WITH {CUST}, g AS (SELECT key, key // 4 AS grp, lon, MAX(lon) OVER (PARTITION BY key // 4) - MIN(lon) OVER (PARTITION BY key // 4) AS span FROM cust)
  SELECT key, CASE WHEN span >= 180 AND lon < 0 THEN lon + 360 ELSE lon END AS lon_unwrapped FROM g""")(
    lambda s, d: M.unwrap_set(customer_points(s, d).withColumn("grp", F.floor(F.col("key") / 4)), ["grp"]).select("key", "lon_unwrapped"))
STEP_KM = "(CAST(6371 AS DOUBLE) * cos({c}::DOUBLE*pi()/180) * (0.25::DOUBLE*pi()/180))"
W1 = destination_steps("cust", "lat", "lon", STEP_KM.format(c="lat"), "bearing", "key, bearing")
W2 = destination_steps("w1", "lat", "lon", STEP_KM.format(c="lat"), "bearing", "key, bearing")
query("G09_bearing_walk", f"WITH {CUST}, w1 AS (SELECT key, bearing, dest_lat AS lat, dest_lon AS lon FROM ({W1})) SELECT key, round(dest_lat::DOUBLE, 3) AS walk_lat, round(dest_lon::DOUBLE, 3) AS walk_lon FROM ({W2})")(
    lambda s, d: G.with_bearing_walk(customer_points(s, d), "lat", "lon", "bearing", 0.25, 2).select(
        "key", F.round(F.col("walk_lat").cast("double"), 3).alias("walk_lat"), F.round(F.col("walk_lon").cast("double"), 3).alias("walk_lon")))
TARGETS = "walk_from AS (SELECT key, bearing/2 AS bearing, CAST(lat*0.7::DOUBLE AS FLOAT) AS lat, CAST(lon AS FLOAT) AS lon, lat*0.7::DOUBLE + key % 7*0.9::DOUBLE + 0.33::DOUBLE AS tlat, lon + key % 5*1.1::DOUBLE + 0.27::DOUBLE AS tlon FROM cust)"
STEP_1 = STEP_KM.replace("0.25", "1.0")
query("G09_walk_to_target", f"""WITH RECURSIVE {CUST}, {TARGETS}, walk AS (SELECT key, bearing, tlat, tlon, 0 AS n, lat, lon FROM walk_from UNION ALL
   SELECT key, bearing, tlat, tlon, n + 1, dest_lat, dest_lon FROM ({destination_steps("(SELECT * FROM walk WHERE n < 25 AND (n < 2 OR lat < tlat OR lon < tlon))", "lat", "lon", STEP_1.format(c="lat"), "bearing", "key, bearing, tlat, tlon, n")}))
  SELECT key, n AS n_steps, round(lat::DOUBLE, 2) AS walk_lat, round(lon::DOUBLE, 2) AS walk_lon, NOT (lat < tlat OR lon < tlon) AS reached FROM walk QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1""")(
    lambda s, d: G.with_walk_to(customer_points(s, d).select("key", (F.col("bearing") / 2).alias("bearing"), (F.col("lat") * F.lit(0.7)).cast("float").alias("lat"), F.col("lon").cast("float").alias("lon"),
                                                            (F.col("lat") * F.lit(0.7) + F.col("key") % 7 * F.lit(0.9) + F.lit(0.33)).alias("tlat"), (F.col("lon") + F.col("key") % 5 * F.lit(1.1) + F.lit(0.27)).alias("tlon")),
                                "lat", "lon", "bearing", "tlat", "tlon", 1.0, 25).select(
        "key", "n_steps", F.round(F.col("walk_lat").cast("double"), 2).alias("walk_lat"), F.round(F.col("walk_lon").cast("double"), 2).alias("walk_lon"), "reached"))
LINE = "line AS (SELECT p_partkey AS key, CAST(p_partkey % 13 AS DOUBLE) AS x1, CAST(p_partkey % 7 AS DOUBLE) AS y1, CAST(p_partkey % 13 + 1 + p_partkey % 5 AS DOUBLE) AS x2, CAST(p_partkey % 7 + 1 + p_partkey % 11 AS DOUBLE) AS y2 FROM part)"
query("G10_line_fit", f"""WITH {LINE}, fit AS (SELECT *, (y2 - y1)/(x2 - x1) AS m, y1 - (y2 - y1)/(x2 - x1)*x1 AS c, (x2 - x1) >= (y2 - y1) AS ax FROM line),
  walk AS (SELECT fit.*, s FROM fit, range(0, (SELECT CAST(MAX(greatest(x2, y2)) AS BIGINT) + 1 FROM line)) r(s) WHERE s >= CASE WHEN ax THEN x1 ELSE y1 END AND s <= CASE WHEN ax THEN x2 ELSE y2 END)
  SELECT key, round(m, 6) AS slope, round(c, 6) AS intercept, CAST(CASE WHEN ax THEN s ELSE round((s - c)/m) END AS INTEGER) AS px, CAST(CASE WHEN ax THEN round(m*s + c) ELSE s END AS INTEGER) AS py FROM walk""")(
    lambda s, d: G.line_raster(table(s, d, "part").select(
        F.col("p_partkey").alias("key"), (F.col("p_partkey") % 13).cast("double").alias("x1"), (F.col("p_partkey") % 7).cast("double").alias("y1"),
        (F.col("p_partkey") % 13 + 1 + F.col("p_partkey") % 5).cast("double").alias("x2"), (F.col("p_partkey") % 7 + 1 + F.col("p_partkey") % 11).cast("double").alias("y2")),
        "x1", "y1", "x2", "y2").select("key", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "px", "py"))

# --- map aggregates ---------------------------------------------------------------------------

query("A11_field_range", chain("field") + "SELECT time, MIN(h) AS vmin, MAX(h) AS vmax, MIN(h) - MIN(h) % 20 - 20 AS min_contour, MAX(h) - MAX(h) % 20 + 20 AS max_contour FROM field GROUP BY time")(
    lambda s, d: M.field_range(field(s, d), SPEC))
query("A12_contour_bands", chain("field") + """SELECT r.time, r.lo + 20*CAST(n AS INTEGER) AS contour, COUNT(f.h) AS n_points FROM (SELECT time, MIN(h) - MIN(h) % 20 - 20 AS lo, MAX(h) - MAX(h) % 20 + 20 AS hi FROM field GROUP BY time) r
  JOIN range((SELECT CAST((MAX(h) - MIN(h))/20 AS BIGINT) + 4 FROM field)) k(n) ON r.lo + 20*n < r.hi LEFT JOIN field f ON f.time = r.time AND f.h >= r.lo + 20*n AND f.h < r.lo + 20*n + 20 GROUP BY r.time, r.lo, n""")(
    lambda s, d: M.contour_bands(field(s, d), SPEC))
query("A12_contour_band_points", chain("field") + "SELECT time, CAST(h - h % 20 AS INTEGER) AS contour, 90 - 2.5::DOUBLE*i AS lat, -180 + 2.5::DOUBLE*j AS lon, h AS height FROM field")(
    lambda s, d: M.contour_band_points(field(s, d), SPEC))
LEVELS_SQL = """SELECT {keys}, array_to_string(list_transform(CASE WHEN len(a) < 2 THEN list_transform(range(5), lambda k: vmin + (vmax - vmin)*k/4.0::DOUBLE) ELSE a END, lambda v: printf('%.3f', v)), ',') AS levels
  FROM (SELECT *, list_transform(range(greatest(CAST(ceil((vmax - f)/20.0::DOUBLE) AS BIGINT), 0)), lambda k: f + k*20.0::DOUBLE) AS a FROM (SELECT {keys}, CAST(MIN(h) AS DOUBLE) AS vmin, CAST(MAX(h) AS DOUBLE) AS vmax, ceil(MIN(h)/10.0::DOUBLE)*10 AS f FROM {src} GROUP BY {keys}))"""


def joined(levels):
    return F.array_join(F.transform(levels, lambda v: F.format_string("%.3f", v)), ",")


query("A13_contour_level_list", chain("field") + LEVELS_SQL.format(keys="time, i", src="field"))(
    lambda s, d: field(s, d).groupBy("time", "i").agg(F.min("h").alias("vmin"), F.max("h").alias("vmax"))
    .select("time", "i", joined(M.level_list(F.col("vmin"), F.col("vmax"), 20)).alias("levels")))


def map_points(x):
    return x.points.select(
        "time", "cluster", "type", G.lat_of(F.col("x"), SPEC).alias("lat"), G.lon_of(F.col("y"), SPEC).alias("lon"),
        F.col("raw").alias("value"), (F.col("x") * SPEC.size_y + F.col("y")).alias("scan"))


def members(s, d):
    x = staged(s, d)
    return M.formation_members(x.formations(), map_points(x).drop("type"))


MEMBERS = """members AS (SELECT f.time, f.max_id, f.form_type, f.role, p.cluster, 90 - 2.5::DOUBLE*p.x AS lat, -180 + 2.5::DOUBLE*p.y AS lon, p.raw AS value, p.x*144 + p.y AS scan FROM (
  SELECT time, max_id, type AS form_type, 'max' AS role, max_id AS cluster FROM formations UNION ALL SELECT time, max_id, type, 'min1', min1_id FROM formations
  UNION ALL SELECT time, max_id, type, 'min2', min2_id FROM formations WHERE type = 'OMEGA') f JOIN points p ON p.time = f.time AND p.cluster = f.cluster)"""
MEMBER_CHAIN = with_ctes(chain("formations", "points"), MEMBERS)
query("J05_formation_members", MEMBER_CHAIN + "SELECT time, max_id, form_type, role, cluster, lat, lon FROM members")(
    lambda s, d: members(s, d).select("time", "max_id", "form_type", "role", "cluster", "lat", "lon"))
UNWRAP = "unwrapped AS (SELECT *, CASE WHEN MAX(lon) OVER (PARTITION BY time, max_id) - MIN(lon) OVER (PARTITION BY time, max_id) >= 180 AND lon < 0 THEN lon + 360 ELSE lon END AS ulon FROM members)"
# An edge p-q belongs to the hull when no member lies to its right, and none on its line but outside of it.
HULL = """u AS MATERIALIZED (SELECT DISTINCT time, max_id, ulon AS x, lat AS y FROM unwrapped),
 v AS (SELECT p.time, p.max_id, p.x, p.y FROM u p JOIN u q ON p.time = q.time AND p.max_id = q.max_id AND (p.x <> q.x OR p.y <> q.y)
   WHERE NOT EXISTS (SELECT 1 FROM u r WHERE r.time = p.time AND r.max_id = p.max_id AND ((q.x - p.x)*(r.y - p.y) - (q.y - p.y)*(r.x - p.x) < 0
     OR ((q.x - p.x)*(r.y - p.y) - (q.y - p.y)*(r.x - p.x) = 0 AND (r.x - p.x)*(r.x - q.x) + (r.y - p.y)*(r.y - q.y) > 0)))),
 c AS (SELECT *, AVG(x) OVER g AS mx, AVG(y) OVER g AS my, MIN((x, y)) OVER g AS s FROM v WINDOW g AS (PARTITION BY time, max_id)),
 t AS (SELECT *, atan2(y - my, x - mx) - atan2(s[2] - my, s[1] - mx) AS turn FROM c)"""
HULL_ROWS = f"""SELECT time, max_id, CAST(row_number() OVER (PARTITION BY time, max_id ORDER BY CASE WHEN turn < 0 THEN turn + 2*pi() ELSE turn END) - 1 AS INTEGER) AS vertex,
  round(y + {M.HULL_PADDING}::DOUBLE*(y - my), 6) AS lat, round(x + {M.HULL_PADDING}::DOUBLE*(x - mx), 6) AS lon FROM t"""
query("A14_formation_hull", with_ctes(MEMBER_CHAIN, UNWRAP, HULL) + HULL_ROWS)(
    lambda s, d: M.formation_hull(members(s, d)).withColumns({c: F.round(c, 6) for c in ("lat", "lon")}))
LABEL_SQL = """SELECT time, max_id, form_type, (MIN(lat) + MAX(lat))/2 - CASE WHEN form_type = 'OMEGA' THEN 8 ELSE 0 END AS label_lat, least((MIN(ulon) + MAX(ulon))/2, 170) AS label_lon"""
query("A15_formation_label", with_ctes(MEMBER_CHAIN, UNWRAP) + LABEL_SQL + " FROM unwrapped GROUP BY time, max_id, form_type")(
    lambda s, d: M.formation_label(members(s, d)).drop("n_points"))
query("A15_group_label", MEMBER_CHAIN + "SELECT time, max_id, role, cluster, MAX(lat) + 0.5::DOUBLE AS label_lat, first(lon ORDER BY lat DESC, scan) + 0.5::DOUBLE AS label_lon FROM members GROUP BY time, max_id, role, cluster")(
    lambda s, d: M.group_label(members(s, d)))


def holey(s, d):
    return field(s, d).where("h % 3 <> 0")


query("A19_surface_grid", chain("field") + "SELECT time, 90 - 2.5::DOUBLE*i AS lat, -180 + 2.5::DOUBLE*j AS lon, CASE WHEN h % 3 <> 0 THEN h END AS value FROM field")(
    lambda s, d: M.surface_grid(holey(s, d), SPEC))
query("A20_isoline_cells", with_ctes(chain("field"), crossings_sql()) + "SELECT time, i, j, edge, level, round(lat, 6) AS lat, round(lon, 6) AS lon FROM crossings")(
    lambda s, d: M.isoline_crossings(S.to_slices(field(s, d), SPEC), SPEC, 20).withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)}))


def tilted(s, d):
    """The poles are raised, so that the globe's levels are not the area's; every third instant is nearly flat."""
    return field(s, d).withColumn("h", F.when(F.col("time") % 3 == 2, F.lit(5000) + F.col("h") % 7).otherwise(F.col("h") + F.when((F.col("i") < 5) | (F.col("i") > 60), 2).otherwise(7)).cast("int"))


TILTED = "tilted AS (SELECT time, i, j, CASE WHEN time % 3 = 2 THEN 5000 + h % 7 WHEN i < 5 OR i > 60 THEN h + 2 ELSE h + 7 END AS h FROM field)"
query("A20_isoline_levels_of_area", with_ctes(chain("field"), TILTED, crossings_sql(AREA_SQL, "tilted")) + "SELECT time, i, j, edge, round(level, 6) AS level, round(lat, 6) AS lat, round(lon, 6) AS lon FROM crossings")(
    lambda s, d: M.isoline_crossings(S.to_slices(tilted(s, d), SPEC), SPEC, 20, AREA).withColumns({c: F.round(c, 6) for c in ("level", "lat", "lon")}))
query("J07_instant_to_date", with_ctes(chain("clusters"), AXIS_SQL) + "SELECT c.time, c.id, c.type, a.label FROM clusters c JOIN axis a ON a.time = c.time")(
    lambda s, d: M.instant_to_date(det(s, d).clusters.select("time", "id", "type"), axis(s, d)))


def selected(x):
    return map_points(x).select("time", "lat", "lon", "value", "cluster")


OVERLAY = with_ctes(chain("points", "field"), crossings_sql()) + """SELECT time, round(lat, 6) AS lat, round(lon, 6) AS lon, level AS value, CAST(NULL AS INTEGER) AS cluster, 'contour' AS layer FROM crossings
  UNION ALL SELECT time, 90 - 2.5::DOUBLE*x, -180 + 2.5::DOUBLE*y, CAST(raw AS DOUBLE), cluster, 'points' FROM points"""


@query("J13_overlay", OVERLAY)
def _overlay(s, d):
    x = det(s, d)
    return P.combined_map_data(M.isoline_crossings(x.slices, SPEC, 20), selected(x)).withColumns(
        {"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


query("O01_order_points", chain("points") + "SELECT time, x, y, type, CAST(row_number() OVER (PARTITION BY time ORDER BY type, CASE WHEN type = 'MIN' THEN 90 - 2.5::DOUBLE*x END NULLS FIRST, x*144 + y) AS INTEGER) AS rank FROM points")(
    lambda s, d: M.rank_within(
        det(s, d).points.withColumns({"lat": G.lat_of(F.col("x"), SPEC), "scan": F.col("x") * SPEC.size_y + F.col("y")}),
        ["time"], [*M.order_key(), F.col("scan")]).select("time", "x", "y", "type", "rank"))
query("O02_sort_by_lat", f"WITH {CUST} SELECT nation, key, row_number() OVER (PARTITION BY nation ORDER BY lat, key) - 1 AS by_lat, row_number() OVER (PARTITION BY nation ORDER BY lon, key) - 1 AS by_lon FROM cust")(
    lambda s, d: position_by_range(
        position_by_range(customer_points(s, d), ["nation"], [F.col("lat"), F.col("key")], "by_lat"),
        ["nation"], [F.col("lon"), F.col("key")], "by_lon").select("nation", "key", "by_lat", "by_lon"))

# --- composite maps ---------------------------------------------------------------------------

AREA_CELLS = "cells AS (SELECT * FROM located WHERE " + AREA_SQL + ")"
query("Q05_contour_map_data", with_ctes(chain("field"), AXIS_SQL, LOC, AREA_CELLS) + "SELECT l.time, a.label, l.levels FROM (" + LEVELS_SQL.format(keys="time", src="cells") + ") l JOIN axis a USING (time)")(
    lambda s, d: P.contour_map_data(field(s, d), axis(s, d), SPEC, AREA, 20).select("time", "label", joined(F.col("levels")).alias("levels")))
query("Q05_isolines_in_area", with_ctes(chain("field"), AXIS_SQL, crossings_sql(AREA_SQL)) + "SELECT c.time, a.label, edge, level, i, j, round(lat, 6) AS lat, round(lon, 6) AS lon FROM crossings c JOIN axis a USING (time)")(
    lambda s, d: P.isolines_in_area(S.to_slices(field(s, d), SPEC), axis(s, d), SPEC, AREA, 20).select(
        "time", "label", "edge", "level", "i", "j", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")))
query("Q06_surface_map_data", with_ctes(chain("field"), LOC) + f"SELECT time, lat, lon, CASE WHEN h % 3 <> 0 THEN h END AS value FROM located WHERE {AREA_SQL}")(
    lambda s, d: P.surface_map_data(holey(s, d), SPEC, AREA))
