"""Queries of the detection chain: sampling, clustering, rays, formations, heat."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from isohypsa.functions import geo as G
from isohypsa.operators import clusters as C
from isohypsa.operators import extrema as E
from isohypsa.operators import formations as B
from isohypsa.operators import rays as R
from isohypsa.operators.components import label_components
from isohypsa.plans import detect as D
from isohypsa.registry.base import ORACLES, query
from isohypsa.registry.inputs import HEAT_SPEC, SPEC, field, instants, table
from isohypsa.registry.sql import LIMITS_SIDES, STEPS, WEIGHTS, chain, destination_steps
from isohypsa.sources.grid import PACKING, to_slices
from isohypsa.staging import scratch_path

HEAT = (0.05, 13.15)  # scale and offset turning metres of the test field into kelvin


def det(spark, d):
    return D.cluster_extrema(field(spark, d), SPEC)


def staged(spark, d):
    return D.cluster_extrema(field(spark, d), SPEC, staged=True)


def labelled(spark, d, method="slice"):
    ex = D.detect_extrema(field(spark, d), SPEC)
    return label_components(C.typed_points(ex).select("time", "x", "y", "type", "raw"), SPEC.size_x, SPEC.size_y, method)


# --- sampling -----------------------------------------------------------------------------

query("Q01_detect_extrema", chain("extrema") + "SELECT time, x, y, raw, n_ge, n_le, type FROM extrema")(
    lambda s, d: D.detect_extrema(field(s, d), SPEC))
query("A01_bearing_vote", chain("votes") + "SELECT time, x, y, n_ge, n_le FROM votes")(
    lambda s, d: E.votes_from_slices(to_slices(field(s, d), SPEC), SPEC).drop("raw"))
query("A01_bearing_vote_join", chain("votes") + "SELECT time, x, y, n_ge, n_le FROM votes")(
    lambda s, d: E.votes_by_join(field(s, d), SPEC).drop("raw"))
query("A02_classify_extrema", chain("extrema") + "SELECT time, type, COUNT(*) AS n_cells, SUM(x*144 + y)::BIGINT AS pos_sum FROM extrema GROUP BY time, type")(
    lambda s, d: D.detect_extrema(field(s, d), SPEC).groupBy("time", "type").agg(
        F.count("*").alias("n_cells"), F.sum((F.col("x") * 144 + F.col("y")).cast("bigint")).alias("pos_sum")))


def customer_points(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"),
        ((F.col("c_custkey") * 37 % 359) * 0.5 - 89.5).alias("lat"),
        ((F.col("c_custkey") * 53 % 720) * 0.5 - 180).alias("lon"),
        ((F.col("c_custkey") * 41 % 359) * 0.5 - 89.5).alias("lat2"),
        ((F.col("c_custkey") * 59 % 720) * 0.5 - 180).alias("lon2"),
        (F.col("c_custkey") * 7 % 360 - 180).cast("double").alias("bearing"),
    )


CUST = """cust AS (SELECT c_custkey AS key, c_nationkey AS nation, (c_custkey*37 % 359)*0.5::DOUBLE - 89.5::DOUBLE AS lat, (c_custkey*53 % 720)*0.5::DOUBLE - 180 AS lon,
 (c_custkey*41 % 359)*0.5::DOUBLE - 89.5::DOUBLE AS lat2, (c_custkey*59 % 720)*0.5::DOUBLE - 180 AS lon2, CAST(c_custkey*7 % 360 - 180 AS DOUBLE) AS bearing FROM customer)"""

BEARINGS = f"""WITH {CUST}, b AS (SELECT key, lat, lon, CAST(-180 + 5*k AS DOUBLE) AS bearing FROM cust, range(64) r(k))"""

query("G12_bearing_set", f"WITH {CUST} SELECT key, CAST(k AS INTEGER) AS k, CAST(-180 + 5*k AS DOUBLE) AS bearing FROM cust, range(64) r(k)")(
    lambda s, d: customer_points(s, d).select("key", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    .join(F.broadcast(E.bearing_set(s, SPEC)), "k"))
query("J01_stencil_join", BEARINGS + f" SELECT key, bearing, round(dest_lat::DOUBLE, 3) AS dest_lat, round(dest_lon::DOUBLE, 3) AS dest_lon FROM ({destination_steps('b', 'lat', 'lon', '500', 'bearing', 'key, bearing')})")(
    lambda s, d: G.with_destination(
        customer_points(s, d).select("key", "lat", "lon", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
        .withColumn("bearing", F.lit(-180.0) + F.col("k") * 5),
        "lat", "lon", F.lit(500.0), F.col("bearing"),
    ).select("key", "bearing", F.round(F.col("dest_lat").cast("double"), 3).alias("dest_lat"),
             F.round(F.col("dest_lon").cast("double"), 3).alias("dest_lon")))


STORED_SAMPLES = chain("field", "sten")[:-1] + """ SELECT time, x, y, COUNT(z) AS n_found, CAST(SUM(z) AS BIGINT) AS total, CAST(SUM(z*k) AS BIGINT) AS by_bearing FROM (
  SELECT o.time, s.x, s.y, s.k, CASE WHEN s.ok THEN round(s.w11::DOUBLE*a.h + s.w12::DOUBLE*b.h + s.w21::DOUBLE*c.h + s.w22::DOUBLE*d.h) END AS z FROM sten s JOIN field o ON o.i = s.x AND o.j = s.y
  LEFT JOIN field a ON a.time = o.time AND a.i = s.n_i AND a.j = s.n_j LEFT JOIN field b ON b.time = o.time AND b.i = s.n_i AND b.j = s.n_j + 1
  LEFT JOIN field c ON c.time = o.time AND c.i = s.n_i - 1 AND c.j = s.n_j LEFT JOIN field d ON d.time = o.time AND d.i = s.n_i - 1 AND d.j = s.n_j + 1) GROUP BY time, x, y"""


@query("J01_stencil_over_grid", STORED_SAMPLES)
def _stencil_over_grid(s, d):
    """The stencil of the lattice as a stored table, met by every instant of the field."""
    path = scratch_path(s, "stencil")
    E.save_stencil(s, SPEC, path)
    samples = E.samples_by_join(field(s, d), SPEC, stored=s.read.parquet(path))
    return samples.groupBy("time", "x", "y").agg(F.count("sample").alias("n_found"), F.sum("sample").alias("total"), F.sum(F.col("sample") * F.col("k")).alias("by_bearing"))


def sampled_points(spark, d):
    """Customer points (single precision) with their enclosing nodes, dealt over all instants."""
    spread = instants(spark, d).agg((F.max("time") + 1).alias("n")).scalar()
    pts = customer_points(spark, d).select(
        "key", (F.col("key") % spread).cast("int").alias("time"),
        F.col("lat2").cast("float").alias("dest_lat"), F.col("lon2").cast("float").alias("dest_lon"))
    return G.with_bilinear_weights(pts, SPEC), field(spark, d)


GATHER = chain("field")[:-1] + f""", {CUST}, pts AS MATERIALIZED (SELECT key, CAST(key % (SELECT MAX(time) + 1 FROM synth) AS INTEGER) AS time, CAST(lat2 AS FLOAT) AS dest_lat, CAST(lon2 AS FLOAT) AS dest_lon FROM cust),
 node AS MATERIALIZED (SELECT key, time, ok, n_i, n_j, w11, w12, w21, w22 FROM ({WEIGHTS.replace("{src}", "pts")})),
 g AS MATERIALIZED (SELECT p.time, p.key, w11, w12, w21, w22, ok, CASE WHEN ok THEN a.h END AS z11, CASE WHEN ok THEN b.h END AS z12, CASE WHEN ok THEN c.h END AS z21, CASE WHEN ok THEN d.h END AS z22 FROM node p
  LEFT JOIN field a ON a.time = p.time AND a.i = p.n_i AND a.j = p.n_j LEFT JOIN field b ON b.time = p.time AND b.i = p.n_i AND b.j = p.n_j + 1
  LEFT JOIN field c ON c.time = p.time AND c.i = p.n_i - 1 AND c.j = p.n_j LEFT JOIN field d ON d.time = p.time AND d.i = p.n_i - 1 AND d.j = p.n_j + 1) """


@query("J02_gather4", GATHER + "SELECT time, key, z11, z12, z21, z22 FROM g")
def _gather4(s, d):
    keyed, f = sampled_points(s, d)
    return E.gather4(keyed, f).select("time", "key", "z11", "z12", "z21", "z22")


@query("G03_bilinear", GATHER + "SELECT time, key, CAST(CASE WHEN ok THEN round(w11::DOUBLE*z11 + w12::DOUBLE*z12 + w21::DOUBLE*z21 + w22::DOUBLE*z22) END AS BIGINT) AS sample FROM g")
def _bilinear(s, d):
    keyed, f = sampled_points(s, d)
    return E.gather4(keyed, f).select("time", "key", G.interpolate(
        [F.col(f"w{n}") for n in (11, 12, 21, 22)], [F.col(f"z{n}") for n in (11, 12, 21, 22)]).alias("sample"))


# --- components and clusters ----------------------------------------------------------------

LABELLED = chain("labelled") + "SELECT time, x, y, type, root FROM labelled"
query("A03_connected_components", LABELLED)(lambda s, d: labelled(s, d).select("time", "x", "y", "type", "root"))
query("A03_connected_components_relational", LABELLED)(
    lambda s, d: labelled(s, d, "relational").select("time", "x", "y", "type", "root"))
query("W01_scan_order_ids", chain("labelled") + "SELECT time, root, type, CAST(dense_rank() OVER (PARTITION BY time ORDER BY root) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT time, root, type FROM labelled)")(
    lambda s, d: C.scan_order_ids(labelled(s, d).select("time", "root", "type").distinct()))
query("A05_cluster_summary", chain("summary") + "SELECT time, root, type, n_points, contour FROM summary")(
    lambda s, d: C.cluster_summary(labelled(s, d), SPEC).select("time", "root", "type", "n_points", "contour"))
EXT = [f"{a}_{b}" for a in "wens" for b in ("lat", "lon")]
query("A06_cluster_extremes", chain("summary") + f"SELECT time, root, {', '.join(EXT)} FROM summary")(
    lambda s, d: C.cluster_summary(labelled(s, d), SPEC).select("time", "root", *EXT))
query("P10_cluster_band_filter", chain("summary") + "SELECT time, root, type, n_points, n_lat FROM summary WHERE n_lat > 30 AND n_lat < 85 AND n_points <> 1")(
    lambda s, d: C.band_filter(C.cluster_summary(labelled(s, d), SPEC), SPEC).select("time", "root", "type", "n_points", "n_lat"))


@query("W02_reindex_after_filter", chain("points") + "SELECT time, x, y, cluster, center_lat, center_lon FROM points")
def _reindex(s, d):
    return det(s, d).points.select("time", "x", "y", "cluster", "center_lat", "center_lon")


query("Q02_cluster_extrema", chain("clusters") + "SELECT time, id, type, n_points, contour, center_lat, center_lon FROM clusters")(
    lambda s, d: det(s, d).clusters.select("time", "id", "type", "n_points", "contour", "center_lat", "center_lon"))

# --- rays and contour tests -------------------------------------------------------------------

query("G11_direction_set", chain("rays") + "SELECT s_suppkey AS key, ray, CAST(s_suppkey % 73 + dx AS BIGINT) AS i, CAST(s_suppkey % 144 + dy AS BIGINT) AS j FROM supplier, rays")(
    lambda s, d: R.direction_set(table(s, d, "supplier").select(F.col("s_suppkey").alias("key")))
    .select("key", "ray", (F.col("key") % 73 + F.col("dx")).alias("i"), (F.col("key") % 144 + F.col("dy")).alias("j")))
query("W04_ray_cutoff", chain("raysteps") + "SELECT time, id, ray, CAST(coalesce(MIN(CASE WHEN stop THEN k END), 146) - 1 AS INTEGER) AS k_max FROM raysteps GROUP BY time, id, ray")(
    lambda s, d: R.ray_plan(det(s, d).clusters, SPEC).select("time", "id", "ray", "k_max"))


@query("J03_ray_cells", chain("raycells") + "SELECT time, id, ray, k, i, j, cell_h FROM raycells")
def _ray_cells(s, d):
    x = det(s, d)
    return R.ray_cells(x.clusters, field(s, d), SPEC).select("time", "id", "ray", "k", "i", "j", "cell_h")


REACH = chain("raycells") + "SELECT time, id, type, ray, CASE WHEN type = 'MAX' THEN MIN(cell_h) ELSE MAX(cell_h) END AS reach FROM raycells GROUP BY time, id, type, ray"
query("A07_ray_reach", REACH)(lambda s, d: det(s, d).reach.select("time", "id", "type", "ray", "reach"))


@query("A07_ray_reach_join", REACH)
def _reach_join(s, d):
    return R.ray_reach_from_cells(R.ray_cells(det(s, d).clusters, field(s, d), SPEC)).select("time", "id", "type", "ray", "reach")


def all_tests(s, d):
    x = staged(s, d)
    levels = x.clusters.select("time", "id").join(x.levels.select("time", "level").distinct(), "time")
    return R.contour_tests(x.reach, levels)


query("A08_closed_contour", chain("tests") + "SELECT time, id, type, level, closed FROM tests")(
    lambda s, d: all_tests(s, d).select("time", "id", "type", "level", "closed"))
ALL = [f"{x}_all" for x in LIMITS_SIDES]
MOST = [f"{x}_most" for x in LIMITS_SIDES]
query("A09_dir_all", chain("tests") + f"SELECT time, id, level, {', '.join(ALL)} FROM tests")(
    lambda s, d: all_tests(s, d).select("time", "id", "level", *ALL))
query("A10_dir_majority", chain("tests") + f"SELECT time, id, level, {', '.join(MOST)} FROM tests")(
    lambda s, d: all_tests(s, d).select("time", "id", "level", *MOST))


@query("A10_thresholds", chain("tests") + f"SELECT time, id, level, closed, {', '.join(ALL + MOST)} FROM tests")
def _threshold_form(s, d):
    x = staged(s, d)
    lv = x.levels.select("time", "level").distinct()
    j = x.limits.join(lv, "time")
    tests = [R.passes("closed_at", F.col("level"), F.col("type")).alias("closed")]
    tests += [R.passes(t, F.col("level"), F.col("type")).alias(t) for t in ALL + MOST]
    return j.select("time", "id", "level", *tests)


query("W03_north_walk_levels", chain("walk") + "SELECT time, id, level, first_k FROM walk")(lambda s, d: det(s, d).levels)

# --- formations -------------------------------------------------------------------------------

query("J04_near_pairs", chain("pairs") + "SELECT time, max_id, min_id, round(km, 6) AS km FROM pairs")(
    lambda s, d: det(s, d).pairs.select("time", "max_id", "min_id", F.round("km", 6).alias("km")))
query("G07_unwrap_pair", chain("sides") + "SELECT time, max_id, min_id, ma AS lon_a_int, mb AS lon_b_int, side FROM sides")(
    lambda s, d: G.with_unwrapped_pair(det(s, d).pairs, "max_center_lon", "min_center_lon")
    .select("time", "max_id", "min_id", "lon_a_int", "lon_b_int", "side"))
query("W05_omega_candidates", chain("omegacand") + "SELECT time, max_id, first_k, level, min_id, side FROM omegacand")(
    lambda s, d: B.omega_candidates(staged(s, d).candidates()).select("time", "max_id", "first_k", "level", "min_id", "side"))
query("W05_omega_fold", chain("omega") + "SELECT time, max_id, west_id, east_id, round(score, 6) AS score FROM omega")(
    lambda s, d: B.omega_fold(B.omega_candidates(staged(s, d).candidates())).withColumn("score", F.round("score", 6)))
query("W06_rex_candidates", chain("rexcand") + "SELECT time, max_id, first_k, level, min_id, km FROM rexcand")(
    lambda s, d: B.rex_candidates(staged(s, d).candidates()))
query("W06_rex_nearest", chain("rex") + "SELECT time, max_id, rex_id, rex_km FROM rex")(
    lambda s, d: B.rex_nearest(B.rex_candidates(staged(s, d).candidates())))
FORMS = chain("formations") + "SELECT time, max_id, min1_id, min2_id, type FROM formations"


@query("W07_resolve_formation", FORMS)
def _resolve(s, d):
    c = staged(s, d).candidates()
    return B.resolve(B.omega_fold(B.omega_candidates(c)), B.rex_nearest(B.rex_candidates(c)))


query("Q03_detect_blocking", FORMS)(lambda s, d: D.detect_blocking(field(s, d), SPEC))
ROLES = ("max", "min1", "min2")


@query("J06_formation_clusters", chain("formations", "clusters") + "SELECT f.time, f.max_id, f.min1_id, f.min2_id, " + ", ".join(
    f"{r}.center_lat AS {r}_lat, {r}.center_lon AS {r}_lon, {r}.type AS {r}_type, {r}.contour AS {r}_contour" for r in ROLES)
    + " FROM formations f" + "".join(f" LEFT JOIN clusters {r} ON {r}.time = f.time AND {r}.id = f.{r}_id" for r in ROLES))
def _formation_clusters(s, d):
    x = staged(s, d)
    return B.formation_clusters(x.formations(), x.clusters).drop("type")


# --- temperature ------------------------------------------------------------------------------

HOT_OUT = "SELECT h.time, h.latitude, h.longitude, round(h.t_c, 4) AS t, c.id AS cluster, c.center_lat AS centroid_lat, c.center_lon AS centroid_lon FROM hotlab h JOIN hotcent c ON c.time = h.time AND c.root = h.root"
query("Q04_heat_clusters", chain("hotlab", "hotcent") + HOT_OUT)(
    lambda s, d: D.heat_clusters(field(s, d), HEAT_SPEC, *HEAT, value="h").withColumn("t", F.round("t", 4)))
query("P08_threshold_filter", chain("hot") + "SELECT time, latitude, longitude, round(t_c, 4) AS t_c FROM hot")(
    lambda s, d: D.heat_points(field(s, d), HEAT_SPEC, *HEAT, value="h").select("time", "latitude", "longitude", F.round("t_c", 4).alias("t_c")))
query("A04_connected_components_temp", chain("hotlab") + "SELECT time, x, y, root FROM hotlab")(
    lambda s, d: label_components(D.heat_points(field(s, d), HEAT_SPEC, *HEAT, value="h"), HEAT_SPEC.size_x, HEAT_SPEC.size_y)
    .select("time", "x", "y", "root"))

# --- packing ----------------------------------------------------------------------------------

SCALE, OFFSET, _ = PACKING["z"]
RAW_SQL = f"CAST(floor((h*9.80665::DOUBLE - {OFFSET}::DOUBLE)/{SCALE}::DOUBLE + 0.5) AS SMALLINT)"


def packed(s, d):
    return field(s, d).withColumn(
        "raw", F.floor((F.col("h") * F.lit(9.80665) - F.lit(OFFSET)) / F.lit(SCALE) + 0.5).cast("smallint"))


PACKED_SPEC = replace(SPEC, scale=SCALE, offset=OFFSET)
query("P01_unpack", chain("field") + f"SELECT time, i, j, round(({RAW_SQL}*{SCALE}::DOUBLE + {OFFSET}::DOUBLE)/9.80665::DOUBLE, 6) AS metres FROM field")(
    lambda s, d: packed(s, d).select("time", "i", "j", F.round(G.height(F.col("raw"), PACKED_SPEC), 6).alias("metres")))
query("P02_to_celsius", chain("field") + "SELECT time, i, j, round(h*0.05::DOUBLE + 13.15::DOUBLE - 273.15::DOUBLE, 6) AS t_c FROM field")(
    lambda s, d: field(s, d).select("time", "i", "j", F.round(G.celsius(F.col("h"), *HEAT), 6).alias("t_c")))
PACK_SQL = f"trunc((h*9.80665::DOUBLE + i*9 - {OFFSET}::DOUBLE)/{SCALE}::DOUBLE)"
query("P03_pack", chain("field") + f"SELECT time, i, j, CASE WHEN {PACK_SQL} BETWEEN -32768 AND 32767 THEN CAST({PACK_SQL} AS SMALLINT) END AS packed FROM field")(
    lambda s, d: field(s, d).select("time", "i", "j", G.pack_int16(F.col("h") * F.lit(9.80665) + F.col("i") * 9, SCALE, OFFSET).alias("packed")))
query("Q01_detect_extrema_packed", chain("field", "sten")[:-1] + f""", pk AS MATERIALIZED (SELECT time, i, j, {RAW_SQL} AS raw FROM field)
 SELECT time, x, y, CAST(SUM(CASE WHEN sample IS NULL OR sample = -1 OR own >= sample THEN 1 ELSE 0 END) AS INTEGER) AS n_ge,
   CAST(SUM(CASE WHEN sample IS NOT NULL AND sample <> -1 AND own <= sample THEN 1 ELSE 0 END) AS INTEGER) AS n_le FROM (
  SELECT o.time, s.x, s.y, o.raw AS own, CASE WHEN s.ok THEN round(s.w11::DOUBLE*a.raw + s.w12::DOUBLE*b.raw + s.w21::DOUBLE*c.raw + s.w22::DOUBLE*d.raw) END AS sample
  FROM sten s JOIN pk o ON o.i = s.x AND o.j = s.y
  LEFT JOIN pk a ON a.time = o.time AND a.i = s.n_i AND a.j = s.n_j LEFT JOIN pk b ON b.time = o.time AND b.i = s.n_i AND b.j = s.n_j + 1
  LEFT JOIN pk c ON c.time = o.time AND c.i = s.n_i - 1 AND c.j = s.n_j LEFT JOIN pk d ON d.time = o.time AND d.i = s.n_i - 1 AND d.j = s.n_j + 1) GROUP BY time, x, y""")(
    lambda s, d: D.detect_extrema(packed(s, d), PACKED_SPEC, "raw").select("time", "x", "y", "n_ge", "n_le"))


# --- the chain on a rough field -------------------------------------------------------------------


def rough_field(spark, d):
    """The field with noise in every cell, gaps, and its bumps moved: onto the date line at every second instant."""
    i, j, t = F.col("i"), F.col("j"), F.col("time")
    return field(spark, d).where((i * 13 + j * 7 + t) % 97 != 0).select(
        "time", "i", ((j + F.when(t % 2 == 0, 72).otherwise(9)) % 144).cast("int").alias("j"), (F.col("h") + (i * 31 + j * 17 + t * 7) % 5 - 2).cast("int").alias("h"))


def rough(sql: str) -> str:
    """The SQL of a chain over the rough field."""
    plain = f"field AS MATERIALIZED ({STEPS['field'][1]})"
    assert plain in sql
    return sql.replace(plain, f"smooth AS MATERIALIZED ({STEPS['field'][1]}),\nfield AS MATERIALIZED (SELECT time, i, CAST((j + CASE WHEN time % 2 = 0 THEN 72 ELSE 9 END) % 144 AS INTEGER) AS j, CAST(h + (i*31 + j*17 + time*7) % 5 - 2 AS INTEGER) AS h FROM smooth WHERE (i*13 + j*7 + time) % 97 <> 0)")


query("Q01_detect_extrema_rough", rough(ORACLES["Q01_detect_extrema"]))(lambda s, d: D.detect_extrema(rough_field(s, d), SPEC))
query("Q02_cluster_extrema_rough", rough(ORACLES["Q02_cluster_extrema"]))(
    lambda s, d: D.cluster_extrema(rough_field(s, d), SPEC).clusters.select("time", "id", "type", "n_points", "contour", "center_lat", "center_lon"))
query("Q03_detect_blocking_rough", rough(ORACLES["Q03_detect_blocking"]))(lambda s, d: D.detect_blocking(rough_field(s, d), SPEC))
