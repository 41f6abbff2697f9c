"""Queries of the request catalogue, its users and files, and the message handling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from isohypsa.functions import text as X
from isohypsa.functions.text import CONFIG_KEYS
from isohypsa.operators import catalogue as K
from isohypsa.plans.lifecycle import hashed_requests, lifecycle, read_lifecycle, request_lifecycle, save_lifecycle
from isohypsa.registry.base import ORACLES, query
from isohypsa.registry.inputs import table
from isohypsa.registry.mapdata import LISTING, listing
from isohypsa.sources.grid import row_partitions
from isohypsa.staging import scratch_path, stage
from isohypsa.streaming import messages as Z

NOW = "2000-06-01 00:00:00"


def now_col():
    return F.lit(NOW).cast("timestamp")


NOW_SQL = f"TIMESTAMP '{NOW}'"


def pick(index, *values):
    return F.element_at(F.array(*values), (index + 1).cast("int"))


def strs(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def requests(s, d):
    k = F.col("o_orderkey")
    o = table(s, d, "orders")
    day = F.dayofmonth("o_orderdate")
    north = F.when(k % 13 == 0, "95").otherwise("90")
    west = F.when(k % 13 == 2, "10").otherwise("-180")
    return o.select(
        F.concat(F.lit("h"), k).alias("requestHash"), k.alias("key"),
        F.when(k % 23 == 0, "").when(k % 23 == 1, "u-component_of_wind").when(k % 2 == 0, "geopotential").otherwise("Temperature").alias("variableName"),
        pick(k % 3, strs("500"), strs("850", "500"), strs("1000", "850", "333")).alias("pressureLevels"),
        F.array(F.year("o_orderdate").cast("string")).alias("years"),
        F.array(F.month("o_orderdate").cast("string")).alias("months"),
        F.array(day.cast("string"), (day % 28 + 1).cast("string"), F.lit("31")).alias("days"),
        F.slice(strs("0", "6", "12", "18"), 1, (k % 4 + 1).cast("int")).alias("hours"),
        F.when(k % 13 == 1, F.array(north, west, F.lit("0"))).otherwise(F.array(north, west, F.lit("0"), F.lit("180"))).alias("areaCovered"),
        pick(k % 4, strs("cont"), strs("disp"), strs("forms", "comb"), strs()).alias("mapTypes"),
        pick(k % 3, strs(), strs("20"), strs("30", "10")).alias("mapLevels"),
        pick(k % 4, F.lit("svg"), F.lit("png"), F.lit("pdf"), F.lit(None).cast("string")).alias("fileFormat"),
        F.lit(False).alias("noData"), (k % 5 == 0).alias("noMaps"), (k % 2 == 0).alias("omp"),
        F.when(k % 7 > 0, F.lit(False)).alias("mpi"),
        F.when(k % 2 == 0, (k % 8 + 1).cast("int")).alias("nThreads"), F.lit(None).cast("int").alias("nProces"),
        F.col("o_custkey").alias("userId"),
        pick(F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2),
             F.lit("CACHED"), F.lit("GENERATING"), F.lit("EMPTY")).alias("requestStatus"),
        F.when(k % 9 > 0, k % 4 + 1).alias("timesRequested"),
        F.when(k % 11 > 0, F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + k)).alias("updatedAt"),
    )


REQ = """req AS (SELECT 'h' || o_orderkey AS requestHash, o_orderkey AS key,
 CASE WHEN o_orderkey % 23 = 0 THEN '' WHEN o_orderkey % 23 = 1 THEN 'u-component_of_wind' WHEN o_orderkey % 2 = 0 THEN 'geopotential' ELSE 'Temperature' END AS variableName,
 CASE o_orderkey % 3 WHEN 0 THEN ['500'] WHEN 1 THEN ['850', '500'] ELSE ['1000', '850', '333'] END AS pressureLevels,
 [CAST(year(o_orderdate) AS VARCHAR)] AS years, [CAST(month(o_orderdate) AS VARCHAR)] AS months,
 [CAST(day(o_orderdate) AS VARCHAR), CAST(day(o_orderdate) % 28 + 1 AS VARCHAR), '31'] AS days,
 (['0', '6', '12', '18'])[1:o_orderkey % 4 + 1] AS hours,
 CASE WHEN o_orderkey % 13 = 1 THEN ['90', '-180', '0'] WHEN o_orderkey % 13 = 0 THEN ['95', '-180', '0', '180'] WHEN o_orderkey % 13 = 2 THEN ['90', '10', '0', '180'] ELSE ['90', '-180', '0', '180'] END AS areaCovered,
 CASE o_orderkey % 4 WHEN 0 THEN ['cont'] WHEN 1 THEN ['disp'] WHEN 2 THEN ['forms', 'comb'] ELSE CAST([] AS VARCHAR[]) END AS mapTypes,
 CASE o_orderkey % 3 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['20'] ELSE ['30', '10'] END AS mapLevels,
 CASE o_orderkey % 4 WHEN 0 THEN 'svg' WHEN 1 THEN 'png' WHEN 2 THEN 'pdf' END AS fileFormat,
 false AS noData, o_orderkey % 5 = 0 AS noMaps, o_orderkey % 2 = 0 AS omp, CASE WHEN o_orderkey % 7 > 0 THEN false END AS mpi,
 CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 8 + 1 AS INTEGER) END AS nThreads, CAST(NULL AS INTEGER) AS nProces, o_custkey AS userId,
 CASE o_orderstatus WHEN 'F' THEN 'CACHED' WHEN 'O' THEN 'GENERATING' ELSE 'EMPTY' END AS requestStatus,
 CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 4 + 1 END AS timesRequested,
 CASE WHEN o_orderkey % 11 > 0 THEN o_orderdate + o_orderkey * INTERVAL 1 SECOND END AS updatedAt FROM orders)"""


def req_sql(body: str, *extra: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([REQ, *extra]) + "\n" + body


def fmt(ts):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def sfmt(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def join_text(col):
    return F.array_join(col, "|")


# --- validation and shaping --------------------------------------------------------------------

query("P11_variable_lookup", req_sql("SELECT key, variableName, CASE lower(variableName) WHEN 'geopotential' THEN 'z' WHEN 'temperature' THEN 't' WHEN 'u-component_of_wind' THEN 'u' END AS variable, lower(variableName) NOT IN ('geopotential', 'temperature', 'u-component_of_wind') AS rejected FROM req"))(
    lambda s, d: K.variable_lookup(requests(s, d)).select("key", "variableName", "variable", "rejected"))
RUN = """run AS (SELECT c_custkey AS key, repeat('x', CAST(c_custkey % 300 AS INTEGER)) AS path, c_custkey % 200 - 100 AS lat_min, c_custkey % 190 - 60 AS lat_max, c_custkey % 410 - 200 AS lon_min, c_custkey % 400 - 100 AS lon_max, c_custkey % 6 AS threads FROM customer)"""
query("P12_validate_run_params", f"""WITH {RUN} SELECT key, concat_ws('|', CASE WHEN length(path) > 255 THEN 'path' END,
  CASE WHEN lat_min NOT BETWEEN -90 AND 90 OR lat_max NOT BETWEEN -90 AND 90 OR lat_min > lat_max THEN 'latitude' END,
  CASE WHEN lon_min NOT BETWEEN -180 AND 180 OR lon_max NOT BETWEEN -180 AND 180 OR lon_min > lon_max THEN 'longitude' END,
  CASE WHEN threads < 1 THEN 'threads' END) AS violations FROM run""")(
    lambda s, d: K.validate_run_params(table(s, d, "customer").select(
        F.col("c_custkey").alias("key"), F.expr("repeat('x', cast(c_custkey % 300 as int))").alias("path"),
        (F.col("c_custkey") % 200 - 100).alias("lat_min"), (F.col("c_custkey") % 190 - 60).alias("lat_max"),
        (F.col("c_custkey") % 410 - 200).alias("lon_min"), (F.col("c_custkey") % 400 - 100).alias("lon_max"),
        (F.col("c_custkey") % 6).alias("threads"))).select("key", join_text("violations").alias("violations")))
VIOLATIONS = """concat_ws('|', CASE WHEN variableName = '' THEN 'variableName required' END, CASE WHEN len(mapTypes) = 0 THEN 'mapTypes required' END,
  CASE WHEN len(areaCovered) <> 4 THEN 'invalid coordinates' END,
  CASE WHEN len(areaCovered) = 4 THEN CASE WHEN CAST(areaCovered[1] AS DOUBLE) NOT BETWEEN 0 AND 90 THEN 'invalid North coordinate' WHEN CAST(areaCovered[2] AS DOUBLE) NOT BETWEEN -180 AND 0 THEN 'invalid West coordinate' END END)"""
query("P13_validate_requests", req_sql(f"SELECT key, {VIOLATIONS} AS violations FROM req"))(
    lambda s, d: K.validate_requests(requests(s, d)).select("key", join_text("violations").alias("violations")))
query("P14_option_domain_check", req_sql("""SELECT key, concat_ws('|', CASE WHEN variableName NOT IN ('geopotential', 'temperature') THEN 'variableName' END, CASE WHEN list_contains(pressureLevels, '333') THEN 'pressureLevels' END) AS out_of_domain FROM req"""))(
    lambda s, d: K.option_domain_check(requests(s, d)).select("key", join_text("out_of_domain").alias("out_of_domain")))
query("P15_calendar_filter", req_sql("""SELECT key, CAST(day(last_day(make_date(CAST(years[1] AS INTEGER), CAST(months[1] AS INTEGER), 1))) AS INTEGER) AS max_day,
  array_to_string(list_filter(days, lambda x: CAST(x AS INTEGER) <= day(last_day(make_date(CAST(years[1] AS INTEGER), CAST(months[1] AS INTEGER), 1)))), '|') AS valid_days FROM req"""))(
    lambda s, d: K.calendar_filter(requests(s, d)).select("key", "max_day", join_text("valid_days").alias("valid_days")))
query("P16_request_defaults", req_sql("""SELECT key, array_to_string(CASE WHEN len(mapLevels) > 0 THEN mapLevels WHEN lower(variableName) = 'temperature' THEN ['10'] ELSE ['20'] END, '|') AS mapLevels,
  array_to_string(CASE WHEN lower(variableName) = 'temperature' THEN ['cont'] ELSE mapTypes END, '|') AS mapTypes FROM req"""))(
    lambda s, d: K.request_defaults(requests(s, d)).select("key", join_text("mapLevels").alias("mapLevels"), join_text("mapTypes").alias("mapTypes")))
SORTED = {c: f"list_sort({c})" if c in ("mapTypes",) else f"list_transform(list_sort(list_transform({c}, lambda v: CAST(v AS INTEGER))), lambda v: CAST(v AS VARCHAR))" for c in X.ARRAY_KEYS}
CANON = "'{' || concat_ws(',', " + ", ".join(
    f"""'"{k}":' || CAST(to_json({SORTED[k]}) AS VARCHAR)""" if k in X.ARRAY_KEYS else
    f"""'"{k}":' || '"' || {k} || '"'""" if k in X.TEXT_KEYS else f"""'"{k}":' || CAST({k} AS VARCHAR)"""
    for k in X.HASH_KEYS) + ") || '}'"
query("F01_request_hash", req_sql(f"SELECT key, sha256({CANON}) AS requestHash FROM req"))(
    lambda s, d: X.with_request_hash(requests(s, d)).select("key", "requestHash"))
query("O04_numeric_or_text_sort", req_sql(f"SELECT key, array_to_string({SORTED['pressureLevels']}, '|') AS levels, array_to_string(list_sort(mapTypes), '|') AS types FROM req"))(
    lambda s, d: requests(s, d).select("key", join_text(X.sort_numeric_or_text(F.col("pressureLevels"))).alias("levels"),
                                       join_text(X.sort_numeric_or_text(F.col("mapTypes"))).alias("types")))
RANGES = """(SELECT string_agg(CASE WHEN a = b THEN printf('%02d', a) ELSE printf('%02d-%02d', a, b) END, '-' ORDER BY a, b) FROM (
   SELECT MIN(v) AS a, MAX(v) AS b FROM (SELECT v, v - row_number() OVER (ORDER BY v) AS g FROM (SELECT CAST(unnest({days}) AS INTEGER) AS v)) GROUP BY g))"""
PAD = "array_to_string(list_transform({c}, lambda v: printf('%02d', CAST(v AS INTEGER))), '-')"


def prefix_days():
    """Day lists with runs: from each order's line numbers."""
    return F.sort_array(F.collect_set(F.col("l_linenumber") * 2 - F.col("l_linenumber") % 3))


DAYSET = "dayset AS (SELECT l_orderkey AS key, list_sort(list(DISTINCT CAST(l_linenumber*2 - l_linenumber % 3 AS INTEGER))) AS days FROM lineitem GROUP BY 1)"
query("W08_compact_ranges", f"""WITH {DAYSET}, flat AS (SELECT key, unnest(days) AS v FROM dayset), isl AS (SELECT key, v, v - row_number() OVER (PARTITION BY key ORDER BY v) AS g FROM flat),
  runs AS (SELECT key, MIN(v) AS a, MAX(v) AS b FROM isl GROUP BY key, g) SELECT key, string_agg(CASE WHEN a = b THEN printf('%02d', a) ELSE printf('%02d-%02d', a, b) END, '-' ORDER BY a) AS ranges FROM runs GROUP BY key""")(
    lambda s, d: table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(prefix_days().alias("days"))
    .select("key", X.compact_ranges(F.col("days")).alias("ranges")))
D0, D1 = "CAST(days[1] AS INTEGER)", "CAST(days[2] AS INTEGER)"
query("F02_source_file_name", req_sql(f"""SELECT key, '/fields/' || variableName || '_' || array_to_string(pressureLevels, '-') || 'hPa_' || {PAD.format(c='years')} || '-' || {PAD.format(c='months')} || '-(' || r.ranges || ')_' || {PAD.format(c='hours')} || 'UTC.nc' AS file
  FROM req JOIN ranges r USING (key)""", """flat AS (SELECT key, CAST(unnest(days) AS INTEGER) AS v FROM req), ord AS (SELECT key, v, row_number() OVER (PARTITION BY key ORDER BY v) AS n, lag(v) OVER (PARTITION BY key ORDER BY v) AS p FROM flat),
  seg AS (SELECT key, v, SUM(CASE WHEN p IS NULL OR v <> p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY n) AS g FROM ord), runs AS (SELECT key, g, MIN(v) AS a, MAX(v) AS b FROM seg GROUP BY key, g),
  ranges AS (SELECT key, string_agg(CASE WHEN a = b THEN printf('%02d', a) ELSE printf('%02d-%02d', a, b) END, '-' ORDER BY g) AS ranges FROM runs GROUP BY key)"""))(
    lambda s, d: requests(s, d).select("key", X.source_file_name().alias("file")))
query("F03_extract_instant_date", """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-') || lpad(CAST(day(o_orderdate) + (o_orderkey % 9)//4 AS VARCHAR), 2, '0') || '_' || (['00', '06', '12', '18'])[o_orderkey % 9 % 4 + 1] || 'UTC'
  ELSE strftime(o_orderdate, '%Y-%m-%d_') || lpad(CAST(o_orderkey % 9 AS VARCHAR), 2, '0') || 'UTC' END AS date FROM orders""")(
    lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("key"), X.instant_date_from_name(
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_31_00-06-12-18UTC")))
        .otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_00UTC"))), F.col("o_orderkey") % 9).alias("date")))
query("F04_instant_validity", """WITH ax AS (SELECT CAST(event_id // 1000 AS INTEGER) AS time FROM events GROUP BY 1), n AS (SELECT COUNT(*) AS n FROM ax), q AS (SELECT c_custkey AS key, c_custkey % 60 - 30 AS t FROM customer)
  SELECT key, t, t >= -n AND t < n AS valid, CASE WHEN t >= -n AND t < n THEN CASE WHEN t < 0 THEN t + n ELSE t END END AS instant FROM q, n""")(
    lambda s, d: _validity(s, d))
query("F05_month_end", "SELECT o_orderkey AS key, CAST(day(o_orderdate) AS INTEGER) AS day_start, CAST(day(last_day(o_orderdate)) AS INTEGER) AS day_end FROM orders")(
    lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.dayofmonth("o_orderdate").alias("day_start"), F.dayofmonth(F.last_day("o_orderdate")).alias("day_end")))


def _validity(s, d):
    axis_length = table(s, d, "events").agg(F.count_distinct(F.floor(F.col("event_id") / 1000)).alias("n")).scalar()
    q = table(s, d, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 60 - 30).alias("t")).withColumn("n", axis_length)
    ok = (F.col("t") >= -F.col("n")) & (F.col("t") < F.col("n"))
    return q.select("key", "t", ok.alias("valid"), F.when(ok, F.when(F.col("t") < 0, F.col("t") + F.col("n")).otherwise(F.col("t"))).alias("instant"))


query("F11_request_config_projection", req_sql("SELECT requestHash, variableName, array_to_string(pressureLevels, '|') AS pressureLevels, noMaps, mpi, nThreads, CAST(NULL AS VARCHAR) AS nProces FROM req"))(
    lambda s, d: K.config_projection(requests(s, d).drop("nProces")).select("requestHash", "variableName", join_text("pressureLevels").alias("pressureLevels"), "noMaps", "mpi", "nThreads", "nProces"))
query("F12_return_view", req_sql(f"SELECT requestHash, array_to_string(mapLevels, '|') AS mapLevels, noMaps, coalesce(mpi, false) AS mpi, coalesce(timesRequested, 0) AS timesRequested, {sfmt(f'coalesce(updatedAt, {NOW_SQL})')} AS updatedAt, requestStatus FROM req"))(
    lambda s, d: K.return_view(requests(s, d), now_col()).select("requestHash", join_text("mapLevels").alias("mapLevels"), "noMaps", "mpi", "timesRequested", fmt("updatedAt").alias("updatedAt"), "requestStatus"))

# --- files -------------------------------------------------------------------------------------


#: Lines that a task gathers, for files that meet their dates by request.
LINES_PER_TASK = 1_000_000


def stored(s, d, lines=None):
    return listing(s, d, lines).select(
        F.concat(F.lit("h"), F.substring_index("name", "/", 1)).alias("requestHash"), X.base_name(F.col("name")).alias("file"), "size")


def cat_files(s, d):
    lines = table(s, d, "lineitem")
    # dealt into partitions that follow the rows: merged by their well packed bytes, one would hold very many
    n = row_partitions(s, lines.count(), LINES_PER_TASK)
    lines = lines.where(F.col("l_orderkey").isNotNull()).select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate").repartition(n, "l_orderkey")
    ship = lines.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    ends = ship.select(F.concat(F.lit("h"), F.col("l_orderkey")).alias("requestHash"), (F.col("last").cast("timestamp") + F.expr("interval 7 days")).alias("expiresAt"))
    return stored(s, d, lines).repartition(n, "requestHash").join(ends.repartition(n, "requestHash"), "requestHash")


STORED = LISTING + ", stored AS (SELECT 'h' || split_part(name, '/', 1) AS requestHash, split_part(name, '/', 2) AS file, size FROM listing)"
FILES = STORED + ", files AS (SELECT s.*, e.last + INTERVAL 7 DAY AS expiresAt FROM stored s JOIN (SELECT 'h' || l_orderkey AS requestHash, MAX(l_shipdate) AS last FROM lineitem GROUP BY 1) e USING (requestHash))"
query("F06_classify_file", f"WITH {STORED} SELECT requestHash, file, CASE WHEN file LIKE '%.csv' THEN 'data' ELSE 'image' END AS kind, CASE WHEN file NOT LIKE '%.csv' THEN '/api/files/proxy/' || requestHash || '/' || file END AS previewUrl FROM stored")(
    lambda s, d: stored(s, d).select("requestHash", "file", X.file_kind(F.col("file")).alias("kind"),
                                     F.when(X.file_kind(F.col("file")) == "image", X.proxy_url(F.col("requestHash"), F.col("file"))).alias("previewUrl")))
PARTFILE = "pf AS (SELECT p_partkey AS key, p_name || '.' || (['PDF', 'png', 'jpg', 'jpeg', 'gif', 'svg', 'txt', 'csv', 'nc', 'json', 'xyz'])[p_partkey % 11 + 1] AS file FROM part)"
query("F07_content_type", f"""WITH {PARTFILE}, m AS (SELECT key, file, CASE lower(split_part(file, '.', 2)) WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'gif' THEN 'image/gif'
  WHEN 'svg' THEN 'image/svg+xml' WHEN 'txt' THEN 'text/plain' WHEN 'csv' THEN 'text/csv' WHEN 'nc' THEN 'application/x-netcdf' WHEN 'json' THEN 'application/json' ELSE 'application/octet-stream' END AS mime FROM pf)
  SELECT key, mime, mime LIKE 'image/%' OR mime IN ('application/pdf', 'text/plain') AS inline FROM m""")(
    lambda s, d: part_files(s, d).select("key", X.content_type(F.col("file")).alias("mime"), X.inline(X.content_type(F.col("file"))).alias("inline")))
query("F08_proxy_url", """SELECT p_partkey AS key, '/api/files/proxy/' || replace(replace(p_type, '%', '%25'), ' ', '%20') || '/' || replace(replace(p_name, ' ', '%20'), '#', '%23') || '%23' || p_size || '(1)%2Bx.png' AS url FROM part""")(
    lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("key"), X.proxy_url(
        F.col("p_type"), F.concat("p_name", F.lit("#"), F.col("p_size"), F.lit("(1)+x.png"))).alias("url")))


def part_files(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("key"), F.concat("p_name", F.lit("."), pick(F.col("p_partkey") % 11, *[F.lit(x) for x in (
        "PDF", "png", "jpg", "jpeg", "gif", "svg", "txt", "csv", "nc", "json", "xyz")])).alias("file"))


query("O06_first_preview", f"WITH {STORED} SELECT requestHash, MIN(file) AS file FROM stored WHERE file NOT LIKE '%.csv' GROUP BY requestHash")(
    lambda s, d: K.first_preview(stored(s, d).withColumns({"kind": X.file_kind(F.col("file")), "position": F.col("file")})))
query("W10_unique_names", f"""WITH pf AS (SELECT p_partkey AS key, p_brand || '.png' AS name FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY key) - 1 AS n FROM pf)
  SELECT key, CASE WHEN n > 0 THEN replace(name, '.png', '(' || n || ').png') ELSE name END AS unique_name FROM n""")(
    lambda s, d: K.unique_names(table(s, d, "part").select(F.col("p_partkey").alias("key"), F.concat("p_brand", F.lit(".png")).alias("name")), "name", "key", 500)
    .select("key", "unique_name"))
query("W09_latest_runs", f"""WITH r AS (SELECT o_orderkey AS key, strftime(o_orderdate, '%Y-%m') AS month, date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-06-01') AS age FROM orders), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY month ORDER BY abs(age), key) AS INTEGER) AS rank FROM r)
  SELECT key, month, rank FROM k WHERE rank <= 3""")(
    lambda s, d: K.nearest_runs(table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.date_format("o_orderdate", "yyyy-MM").alias("month"),
                                F.datediff(F.lit("2000-06-01").cast("date"), F.col("o_orderdate").cast("date")).alias("age")), "month", "age", "key").select("key", "month", "rank"))

# --- joins and aggregates ------------------------------------------------------------------------


def users(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                                          F.concat(F.lit("u"), F.col("c_custkey"), F.lit("@x.org")).alias("email"), F.lit("user").alias("role"))


def bridge(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("user_id"), F.concat(F.lit("h"), F.col("o_orderkey")).alias("requestHash"))


USERS = "users AS (SELECT c_custkey AS id, c_name AS name, 'u' || c_custkey || '@x.org' AS email, 'user' AS role FROM customer)"
BRIDGE = "bridge AS (SELECT o_custkey AS user_id, 'h' || o_orderkey AS requestHash FROM orders)"
query("J08_requests_of_user", req_sql("SELECT b.user_id, b.requestHash, r.requestStatus FROM users u JOIN bridge b ON b.user_id = u.id JOIN req r USING (requestHash)", USERS, BRIDGE))(
    lambda s, d: K.requests_of_user(users(s, d), bridge(s, d), requests(s, d)).select("user_id", "requestHash", "requestStatus"))
query("J09_request_with_relations", req_sql(f"""SELECT r.requestHash, coalesce(b.n, 0) AS n_users, coalesce(f.n, 0) AS n_files, {sfmt('f.e')} AS expiresAt FROM req r LEFT JOIN (SELECT requestHash, COUNT(*) AS n FROM bridge GROUP BY 1) b USING (requestHash)
  LEFT JOIN (SELECT requestHash, COUNT(*) AS n, MAX(expiresAt) AS e FROM files GROUP BY 1) f USING (requestHash)""", BRIDGE, FILES))(
    lambda s, d: K.request_with_relations(requests(s, d), bridge(s, d), cat_files(s, d)).select("requestHash", "n_users", "n_files", fmt("expiresAt").alias("expiresAt")))
query("J09_related_rows", req_sql(f"""SELECT r.requestHash, r.requestStatus, coalesce(x.relation, 'none') AS relation, x.user_id, x.file, {sfmt('x.expiresAt')} AS expiresAt FROM req r LEFT JOIN (
  SELECT requestHash, 'user' AS relation, user_id, NULL AS file, NULL::TIMESTAMP AS expiresAt FROM bridge UNION ALL SELECT requestHash, 'file', NULL, file, expiresAt FROM files) x USING (requestHash)""", BRIDGE, FILES))(
    lambda s, d: K.request_relations(requests(s, d), bridge(s, d), cat_files(s, d)).select("requestHash", "requestStatus", "relation", "user_id", "file", fmt("expiresAt").alias("expiresAt")))
BODIES = """bodies AS (SELECT o_orderkey AS key, '{"variableName": "geopotential"' || CASE WHEN o_orderkey % 3 = 0 THEN ', "' || o_orderstatus || 'x": 1' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN ', "colour": "red"' ELSE '' END || ', "years": ["2024"]}' AS body FROM orders)"""
query("P13_unexpected_fields", f"WITH {BODIES} SELECT key, array_to_string(list_sort(list_filter(json_keys(body), lambda k: k NOT IN ('variableName', 'years'))), ',') AS unexpected FROM bodies WHERE key % 3 = 0 OR key % 5 = 0")(
    lambda s, d: K.unexpected_fields(table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.concat(
        F.lit('{"variableName": "geopotential"'), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(', "'), "o_orderstatus", F.lit('x": 1'))).otherwise(""),
        F.when(F.col("o_orderkey") % 5 == 0, ', "colour": "red"').otherwise(""), F.lit(', "years": ["2024"]}')).alias("body")), "body", CONFIG_KEYS).select("key", F.array_join("unexpected", ",").alias("unexpected")))
query("J10_requests_by_hashes", req_sql("SELECT requestHash, requestStatus FROM req WHERE requestHash IN (SELECT 'h' || (l_orderkey + CASE WHEN l_returnflag = 'R' THEN 0 ELSE 300000000 END) FROM lineitem)"))(
    lambda s, d: K.requests_by_hashes(requests(s, d), table(s, d, "lineitem").select(F.concat(F.lit("h"), F.col("l_orderkey") + F.when(F.col("l_returnflag") == "R", 0).otherwise(300_000_000)).alias("requestHash"))).select("requestHash", "requestStatus"))
query("J11_files_without_catalogue", f"WITH {FILES} SELECT requestHash, file FROM stored WHERE requestHash NOT IN (SELECT requestHash FROM files WHERE expiresAt >= {NOW_SQL})")(
    lambda s, d: K.files_without_catalogue(stored(s, d), cat_files(s, d).where(F.col("expiresAt") >= now_col())).select("requestHash", "file"))


def user_changes(s, d):
    k = F.col("s_suppkey")
    return table(s, d, "supplier").select(
        F.when(k % 4 == 0, k + 10_000_000).otherwise(k).alias("id"),
        F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, F.lit("")).otherwise(F.col("s_name")).alias("name"),
        F.when(k % 5 == 0, F.concat(F.lit("u"), k + 1, F.lit("@x.org"))).when(k % 5 == 1, F.concat(F.lit("n"), F.floor(k / 10), F.lit("@y.org")))
        .when(k % 4 == 0, F.concat(F.lit("m"), k, F.lit("@z.org"))).alias("email"),
        F.when(k % 7 == 0, "admin").alias("role"))


CHANGES = """chg AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey + 10000000 ELSE s_suppkey END AS id, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE s_name END AS name,
  CASE WHEN s_suppkey % 5 = 0 THEN 'u' || (s_suppkey + 1) || '@x.org' WHEN s_suppkey % 5 = 1 THEN 'n' || (s_suppkey//10) || '@y.org' WHEN s_suppkey % 4 = 0 THEN 'm' || s_suppkey || '@z.org' END AS email, CASE WHEN s_suppkey % 7 = 0 THEN 'admin' END AS role FROM supplier)"""
query("J12_email_conflicts", f"WITH {USERS}, {CHANGES} SELECT c.id, c.email FROM chg c WHERE EXISTS (SELECT 1 FROM users u WHERE u.email = c.email AND u.id <> c.id)")(
    lambda s, d: K.email_conflicts(user_changes(s, d), users(s, d)).select("id", "email"))
query("J14_map_tasks", req_sql("SELECT requestHash, unnest(pressureLevels) AS pressureLevel, year, month, day, hour, mapType, mapLevel FROM (SELECT requestHash, pressureLevels, unnest(years) AS year, months, days, hours, mapTypes, mapLevels, month, day, hour, mapType, mapLevel FROM (SELECT *, unnest(months) AS month FROM (SELECT *, unnest(days) AS day FROM (SELECT *, unnest(hours) AS hour FROM (SELECT *, unnest(mapTypes) AS mapType FROM (SELECT *, unnest(mapLevels) AS mapLevel FROM req))))))"))(
    lambda s, d: K.map_tasks(requests(s, d)).select("requestHash", "pressureLevel", "year", "month", "day", "hour", "mapType", "mapLevel"))
query("A16_group_requests", req_sql("""SELECT first(requestHash ORDER BY updatedAt DESC NULLS LAST, requestHash DESC) AS requestHash, strftime(MAX(updatedAt), '%Y-%m-%d %H:%M:%S') AS updatedAt, COUNT(*) AS count FROM req
  GROUP BY variableName, pressureLevels, years[1], months[1], days[1], areaCovered, mapTypes, mapLevels, coalesce(fileFormat, '')"""))(
    lambda s, d: K.group_requests(requests(s, d)).select("requestHash", fmt("updatedAt").alias("updatedAt"), "count"))
query("O03_newest_first", req_sql("SELECT requestHash, row_number() OVER (PARTITION BY userId ORDER BY updatedAt DESC NULLS LAST, requestHash) - 1 AS position FROM req"))(
    lambda s, d: _newest(s, d))


def _newest(s, d):
    age = -F.coalesce(F.unix_timestamp("updatedAt"), F.lit(0))
    return K.position_by_range(requests(s, d), ["userId"], [age, F.col("requestHash")], "position").select("requestHash", "position")


query("O05_union_distinct_days", """WITH sel AS (SELECT o_custkey AS user_id, MAX(day(last_day(o_orderdate))) AS last FROM orders GROUP BY 1) SELECT user_id, CAST(n AS INTEGER) AS day FROM sel, range(1, 32) r(n) WHERE n <= last""")(
    lambda s, d: K.available_days(table(s, d, "orders").select(F.col("o_custkey").alias("user_id"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")), ["user_id"]))
query("A17_task_outcome", """SELECT c_custkey AS user_id, COUNT(e.event_id) AS n_tasks, COUNT(*) FILTER (e.event_type = 'error') AS n_failed, COUNT(e.event_id) > 0 AND COUNT(*) FILTER (e.event_type = 'error') = 0 AS success
  FROM customer LEFT JOIN events e ON e.user_id = c_custkey GROUP BY 1""")(
    lambda s, d: K.task_outcome(table(s, d, "events").select("user_id", (F.col("event_type") != "error").alias("success")),
                                table(s, d, "customer").select(F.col("c_custkey").alias("user_id")), "user_id"))
query("A18_stage_time_rollup", """SELECT event_type AS part, COUNT(*) AS n, SUM(CAST(round(value*100) AS BIGINT))/100.0::DOUBLE AS total, round(COUNT(*)/(SUM(CAST(round(value*100) AS BIGINT))/100.0::DOUBLE), 9) AS per_second FROM events GROUP BY 1""")(
    lambda s, d: K.stage_time_rollup(table(s, d, "events").select(F.col("event_type").alias("part"), F.round(F.col("value") * 100).cast("bigint").alias("elapsed_cs")))
    .withColumn("per_second", F.round("per_second", 9)))

# --- messages ----------------------------------------------------------------------------------


def events(s, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(s, d, "events").withColumn("k", k).withColumn(
        "increment", F.when(F.col("event_type") == "purchase", 100).when(F.col("event_type") == "error", F.col("k") + 60).otherwise(F.col("k")))


EV = "ev AS (SELECT *, CASE event_type WHEN 'purchase' THEN 100 WHEN 'error' THEN k + 60 ELSE k END AS increment FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events))"
CONTENT = "increment bigint, message string"


def bodies(s, d):
    inner = F.concat(F.lit('{"increment": '), F.col("increment"), F.lit(', "message": "'), F.col("event_type"), F.lit('"}'))
    body = F.concat(F.lit('{"status": "OK", "message": "", "content": '), F.when(F.col("event_id") % 2 == 0, inner).otherwise(
        F.concat(F.lit('"'), F.replace(inner, F.lit('"'), F.lit('\\"')), F.lit('"'))), F.lit("}"))
    return events(s, d).select("event_id", "user_id", "ts", F.when(F.col("event_id") % 17 == 0, F.substring(body, 1, 12)).otherwise(body).alias("body"))


query("F09_parse_envelope", f"WITH {EV} SELECT event_id, event_id % 17 = 0 AS malformed, CASE WHEN event_id % 17 <> 0 THEN 'OK' END AS status, CASE WHEN event_id % 17 <> 0 THEN increment END AS increment, CASE WHEN event_id % 17 <> 0 THEN event_type END AS message FROM ev")(
    lambda s, d: X.parse_envelope(bodies(s, d), "body", CONTENT).select(
        "event_id", "malformed", F.when(~F.col("malformed"), F.col("status")).alias("status"),
        F.when(~F.col("malformed"), F.col("content.increment")).alias("increment"), F.when(~F.col("malformed"), F.col("content.message")).alias("message")))
query("F10_build_envelope", f"""WITH {EV} SELECT event_id, '{{"status":"OK","message":"' || event_type || '","content":{{"increment":' || increment || ',"message":"' || event_type || '"}}}}' AS body FROM ev""")(
    lambda s, d: events(s, d).select("event_id", X.build_envelope(F.lit("OK"), F.col("event_type"), F.struct("increment", F.col("event_type").alias("message"))).alias("body")))
query("T01_envelope_split", f"WITH {EV} SELECT event_id, increment FROM ev WHERE event_id % 17 <> 0")(
    lambda s, d: Z.envelope_split(bodies(s, d), "body", CONTENT)[0].select("event_id", F.col("content.increment").alias("increment")))
KEYS = {"click": "config.create", "view": "progress.update", "purchase": "results.done", "signup": "notify.handler"}
query("T02_route", "SELECT event_id, CASE event_type WHEN 'click' THEN 'config_queue' WHEN 'view' THEN 'progress_queue' WHEN 'purchase' THEN 'results_queue' ELSE 'notifications_queue' END AS queue, CASE event_type WHEN 'click' THEN 'requests_exchange' WHEN 'view' THEN 'progress_exchange' WHEN 'purchase' THEN 'results_exchange' ELSE 'notifications_exchange' END AS exchange FROM events WHERE event_type <> 'error'")(
    lambda s, d: Z.route(table(s, d, "events").withColumn("routing_key", F.coalesce(F.try_element_at(X.literal_map(KEYS), F.col("event_type")), F.lit("unknown")))).select("event_id", "queue", "exchange"))
query("T03_ttl_drop", f"WITH {EV} SELECT event_id FROM ev WHERE k * 100 <= 5000")(
    lambda s, d: Z.ttl_drop(events(s, d).withColumn("consumed", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("k") * 100_000)), "ts", F.col("consumed")).select("event_id"))
BOUND = "CASE event_type WHEN 'click' THEN 'config_queue' WHEN 'view' THEN 'progress_queue' WHEN 'purchase' THEN 'results_queue' WHEN 'signup' THEN 'notifications_queue' END"


def message_source(s, d):
    """The events as messages of one stream, read by a few files at a time; the folder that the stream fills."""
    base = scratch_path(s, "messages")
    rows = bodies(s, d).join(events(s, d).select("event_id", "k", "event_type"), "event_id").select(
        "event_id", "body", F.col("ts").cast("timestamp").alias("sent_at"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("k") * 100_000).alias("consumed_at"),
        F.coalesce(F.try_element_at(X.literal_map(KEYS), F.col("event_type")), F.lit("unknown")).alias("routing_key"))
    rows.write.parquet(f"{base}/in")
    source = s.readStream.schema("event_id bigint, body string, sent_at timestamp, consumed_at timestamp, routing_key string").option("maxFilesPerTrigger", 3).parquet(f"{base}/in")
    Z.message_stream(source, CONTENT, f"{base}/out", f"{base}/cp", consumed=F.col("consumed_at"))
    return f"{base}/out"


query("T01_message_stream", f"WITH {EV} SELECT event_id, increment, {BOUND} AS queue FROM ev WHERE event_id % 17 <> 0 AND k * 100 <= 5000 AND event_type <> 'error'")(
    lambda s, d: s.read.parquet(message_source(s, d) + "/queues").select("event_id", F.col("content.increment").alias("increment"), "queue"))
query("T01_message_counts", f"""WITH {EV} SELECT COUNT(*) AS received, COUNT(*) FILTER (event_id % 17 = 0) AS malformed, COUNT(*) FILTER (event_id % 17 <> 0 AND k * 100 > 5000) AS expired,
  COUNT(*) FILTER (event_id % 17 <> 0 AND k * 100 <= 5000 AND event_type = 'error') AS unbound, COUNT(*) FILTER (event_id % 17 <> 0 AND k * 100 <= 5000 AND event_type <> 'error') AS routed FROM ev""")(
    lambda s, d: s.read.parquet(message_source(s, d) + "/counts").agg(*[F.sum(c).alias(c) for c in ("received", "malformed", "expired", "unbound", "routed")]))
query("T01_malformed_messages", f"WITH {EV} SELECT event_id FROM ev WHERE event_id % 17 = 0")(lambda s, d: s.read.parquet(message_source(s, d) + "/malformed").select("event_id"))
RUNNING = f"""WITH {EV}, ok AS (SELECT * FROM ev WHERE increment BETWEEN 0 AND 100), seg AS (SELECT *, coalesce(SUM(CASE WHEN increment = 100 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM ok),
  run AS (SELECT *, CASE WHEN increment = 100 THEN 100 ELSE least(100, 4*SUM(increment) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) END AS progress FROM seg)"""


def running(s, d):
    return K.progress_running(events(s, d), "user_id", "ts", "event_id")


query("W11_progress_running", RUNNING + " SELECT user_id, event_id, CAST(progress AS BIGINT) AS progress FROM run")(
    lambda s, d: running(s, d).select("user_id", "event_id", "progress"))
query("T05_progress_view", RUNNING + " SELECT user_id, event_id, CAST(progress AS BIGINT) AS progress, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, progress >= 100 AS completed FROM run")(
    lambda s, d: K.progress_view(running(s, d), fmt("ts")).select("user_id", "event_id", "progress", "timestamp", "completed"))
query("T06_next_step", """SELECT user_id, CASE WHEN t = 'error' THEN 'FAILED' WHEN t IN ('click', 'view') AND user_id % 5 <> 0 THEN 'MAP_GENERATION' ELSE 'DONE' END AS next_step FROM (SELECT user_id, first(event_type ORDER BY ts DESC, event_id DESC) AS t FROM events GROUP BY user_id)""")(
    lambda s, d: Z.next_step(table(s, d, "events").select(
        "user_id", "ts", "event_id", F.when(F.col("event_type").isin("click", "view", "error"), "EXECUTION").otherwise("VISUALIZATION").alias("request_type"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("OK").alias("exec_status"), (F.col("user_id") % 5 == 0).alias("noMaps")), "user_id", ["ts", "event_id"]))

# --- upserts -----------------------------------------------------------------------------------


def arrivals(s, d):
    """Requests arriving, one per line: orders of the catalogue, and orders not seen before."""
    return table(s, d, "lineitem").select(
        F.concat(F.lit("h"), F.when(F.col("l_linenumber") == 7, F.col("l_orderkey") + 100_000_000).otherwise(F.col("l_orderkey"))).alias("requestHash"),
        F.col("l_suppkey").alias("userId"),
        (F.unix_timestamp("l_shipdate") * 1000 + F.col("l_partkey") % 1000).alias("arrival"))


ARR = "arr AS (SELECT 'h' || (CASE WHEN l_linenumber = 7 THEN l_orderkey + 100000000 ELSE l_orderkey END) AS requestHash, l_suppkey AS userId, CAST(epoch(l_shipdate) AS BIGINT)*1000 + l_partkey % 1000 AS arrival FROM lineitem)"
CATALOGUE = ["requestHash", "requestStatus", "timesRequested"]


def catalogue(s, d):
    return requests(s, d).select("requestHash", "requestStatus", F.coalesce("timesRequested", F.lit(1)).alias("timesRequested"))


CAT = "cat AS (SELECT requestHash, requestStatus, coalesce(timesRequested, 1) AS timesRequested FROM req)"
query("U01_admit_requests", req_sql("""SELECT coalesce(c.requestHash, b.requestHash) AS requestHash, coalesce(requestStatus, 'GENERATING') AS requestStatus,
  CAST(CASE WHEN requestStatus IS NULL THEN 1 WHEN requestStatus = 'CACHED' THEN timesRequested + coalesce(n, 0) ELSE timesRequested END AS BIGINT) AS timesRequested,
  CAST(CASE WHEN n IS NULL OR requestStatus = 'CACHED' THEN 0 ELSE n END AS BIGINT) AS to_process, coalesce(n IS NOT NULL AND requestStatus = 'CACHED', false) AS to_settle,
  CASE WHEN n IS NOT NULL THEN CASE WHEN requestStatus = 'CACHED' THEN 'CACHED' ELSE 'PROCESSING' END END AS reply FROM cat c FULL JOIN (SELECT requestHash, COUNT(*) AS n FROM arr GROUP BY 1) b ON b.requestHash = c.requestHash""", CAT, ARR))(
    lambda s, d: K.admit_requests(arrivals(s, d), catalogue(s, d)))
query("U01_admission_links", req_sql("""SELECT DISTINCT userId AS user_id, requestHash FROM arr JOIN cat USING (requestHash) WHERE requestStatus = 'CACHED'
  UNION SELECT first(userId ORDER BY arrival, userId), requestHash FROM arr WHERE requestHash NOT IN (SELECT requestHash FROM cat) GROUP BY requestHash""", CAT, ARR))(
    lambda s, d: K.admission_links(arrivals(s, d), catalogue(s, d)))


def done(s, d):
    return table(s, d, "orders").select(
        F.concat(F.lit("h"), F.col("o_orderkey") + F.when(F.col("o_orderstatus") == "F", 200_000_000).otherwise(0)).alias("requestHash"), F.when(F.col("o_orderpriority") == "1-URGENT", "ERROR").otherwise("OK").alias("status"))


DONE = "done AS (SELECT 'h' || (o_orderkey + CASE WHEN o_orderstatus = 'F' THEN 200000000 ELSE 0 END) AS requestHash FROM orders WHERE o_orderpriority <> '1-URGENT')"
query("U02_settle_results", req_sql(f"""SELECT c.requestHash, CASE WHEN d.requestHash IS NULL THEN c.requestStatus WHEN n.n > 0 THEN 'CACHED' ELSE 'EMPTY' END AS requestStatus,
  CASE WHEN d.requestHash IS NOT NULL THEN coalesce(n.n, 0) END AS n_files, CASE WHEN d.requestHash IS NOT NULL AND n.n > 0 THEN {sfmt(NOW_SQL + ' + INTERVAL 7 DAY')} END AS expiresAt
  FROM cat c LEFT JOIN done d USING (requestHash) LEFT JOIN (SELECT requestHash, COUNT(*) AS n FROM stored GROUP BY 1) n USING (requestHash)""", CAT, DONE, STORED))(
    lambda s, d: K.settle_results(done(s, d), catalogue(s, d), stored(s, d), now_col())[0].select("requestHash", "requestStatus", "n_files", fmt("expiresAt").alias("expiresAt")))
query("U02_settled_files", req_sql(f"SELECT requestHash, file, '/api/files/proxy/' || requestHash || '/' || file AS url, {sfmt(NOW_SQL + ' + INTERVAL 7 DAY')} AS expiresAt FROM stored WHERE requestHash IN (SELECT requestHash FROM done)", DONE, STORED))(
    lambda s, d: K.settle_results(done(s, d), catalogue(s, d), stored(s, d), now_col())[1].select("requestHash", "file", "url", fmt("expiresAt").alias("expiresAt")))
query("U03_expire_files", f"WITH {FILES} SELECT requestHash, file, expiresAt < {NOW_SQL} AS deleted FROM files")(
    lambda s, d: (lambda gone, kept: gone.withColumn("deleted", F.lit(True)).unionByName(kept.withColumn("deleted", F.lit(False))))(
        *K.expire_files(cat_files(s, d), now_col())).select("requestHash", "file", "deleted"))
REFUSED = "refused AS (SELECT c.id, c.email FROM chg c WHERE EXISTS (SELECT 1 FROM users u WHERE u.email = c.email AND u.id <> c.id) OR (c.email IS NOT NULL AND c.id > (SELECT MIN(id) FROM chg x WHERE x.email = c.email)))"
query("U04_user_upsert", f"""WITH {USERS}, {CHANGES}, {REFUSED}, good AS (SELECT * FROM chg WHERE id NOT IN (SELECT id FROM refused))
  SELECT coalesce(u.id, g.id) AS id, coalesce(nullif(g.name, ''), u.name) AS name, coalesce(g.email, u.email) AS email, coalesce(g.role, u.role, 'user') AS role FROM users u FULL JOIN good g ON g.id = u.id""")(
    lambda s, d: K.user_upsert(user_changes(s, d), users(s, d))[0])
query("U04_rejected_users", f"WITH {USERS}, {CHANGES}, {REFUSED} SELECT id, email FROM refused")(
    lambda s, d: K.user_upsert(user_changes(s, d), users(s, d))[1].select("id", "email"))
query("U05_link_user_requests", f"WITH {BRIDGE}, {ARR} SELECT user_id, requestHash FROM bridge UNION SELECT userId, requestHash FROM arr")(
    lambda s, d: K.link_user_requests(bridge(s, d), arrivals(s, d).select(F.col("userId").alias("user_id"), "requestHash")))
query("U06_remove_by_id", req_sql("SELECT requestHash, 'kept' AS outcome FROM cat WHERE requestHash NOT IN (SELECT requestHash FROM arr) UNION ALL SELECT DISTINCT requestHash, 'not found' FROM arr WHERE requestHash NOT IN (SELECT requestHash FROM cat)", CAT, ARR))(
    lambda s, d: (lambda kept, missing: kept.select("requestHash", F.lit("kept").alias("outcome")).unionByName(missing.select("requestHash", F.col("error").alias("outcome"))))(
        *K.remove_by_id(catalogue(s, d), arrivals(s, d), "requestHash")))

# --- life cycle and streams ----------------------------------------------------------------------

query("Q07_request_lifecycle", req_sql(f"""SELECT a.hash AS requestHash, 'GENERATING' AS admitted, COUNT(*) AS n_requests, MIN(a.n_tasks) AS n_tasks,
   CASE WHEN coalesce(MAX(n.n), 0) > 0 THEN 'CACHED' ELSE 'EMPTY' END AS settled, coalesce(MAX(n.n), 0) AS n_files
 FROM (SELECT sha256({CANON}) AS hash, key, len(pressureLevels)*len(years)*len(months)*len(days)*len(hours)*len(mapTypes)*len(mapLevels) AS n_tasks FROM (SELECT * REPLACE (CASE WHEN len(mapLevels) > 0 THEN mapLevels WHEN lower(variableName) = 'temperature' THEN ['10'] ELSE ['20'] END AS mapLevels, CASE WHEN lower(variableName) = 'temperature' THEN ['cont'] ELSE mapTypes END AS mapTypes) FROM req WHERE {VIOLATIONS} = '')) a
 LEFT JOIN (SELECT sha AS hash, COUNT(DISTINCT file) AS n FROM (SELECT sha256({CANON}) AS sha, s.file FROM (SELECT * REPLACE (CASE WHEN len(mapLevels) > 0 THEN mapLevels WHEN lower(variableName) = 'temperature' THEN ['10'] ELSE ['20'] END AS mapLevels, CASE WHEN lower(variableName) = 'temperature' THEN ['cont'] ELSE mapTypes END AS mapTypes) FROM req WHERE {VIOLATIONS} = '') JOIN stored s USING (requestHash)) GROUP BY 1) n ON n.hash = a.hash
 GROUP BY a.hash""", STORED))(
    lambda s, d: request_lifecycle(requests(s, d), stored(s, d), now_col()).select("requestHash", "admitted", "n_requests", "n_tasks", "settled", "n_files"))


def half_cached(s, d):
    """A catalogue that holds the requests whose hash begins with 0 to 7."""
    return hashed_requests(requests(s, d)).where(F.col("requestHash") < "8").select("requestHash").distinct().select(
        "requestHash", F.lit("CACHED").alias("requestStatus"), F.lit(2).cast("bigint").alias("timesRequested"))


WITH_MAPS = ORACLES["Q07_request_lifecycle"].replace("AS n_tasks FROM (SELECT * REPLACE", "AS n_tasks, coalesce(noMaps, false) AS nm FROM (SELECT * REPLACE", 1).replace("MIN(a.n_tasks) AS n_tasks,", "MIN(a.n_tasks) AS n_tasks, bool_or(a.nm) AS nm,", 1)
query("Q07_lifecycle_on_catalogue", f"""SELECT requestHash, CASE WHEN c THEN 'CACHED' ELSE 'GENERATING' END AS admitted, CASE WHEN c THEN 'CACHED' ELSE 'PROCESSING' END AS reply,
  CASE WHEN c THEN 2 + n_requests ELSE 1 END AS timesRequested, n_requests, CASE WHEN c THEN 0 ELSE n_tasks END AS n_tasks, CASE WHEN c OR nm THEN 'DONE' ELSE 'MAP_GENERATION' END AS next_step, settled, n_files
FROM (SELECT *, requestHash < '8' AS c FROM ({WITH_MAPS}))""")(
    lambda s, d: request_lifecycle(requests(s, d), stored(s, d), now_col(), half_cached(s, d)))


def notices(s, d):
    """What the runs reported: a notice for every line of an order."""
    return table(s, d, "lineitem").select(
        F.concat(F.lit("h"), F.col("l_orderkey")).alias("requestHash"), F.when(F.col("l_linenumber") % 2 == 1, "EXECUTION").otherwise("VISUALIZATION").alias("request_type"),
        F.when(F.col("l_returnflag") == "A", "ERROR").otherwise("OK").alias("exec_status"), F.col("l_shipdate").alias("at"), F.col("l_linenumber").alias("no"))


def whole_cycle(s, d, part):
    """A life cycle with catalogue, notices and known files, written as a version and read back."""
    root = scratch_path(s, "lifecycle")
    save_lifecycle(lifecycle(requests(s, d), stored(s, d), now_col(), half_cached(s, d), notices(s, d), ["at", "no", "given"], cat_files(s, d)), root, 1)
    return read_lifecycle(s, root, part)


CYCLE = [f"""hashed AS MATERIALIZED (SELECT sha256({CANON}) AS hash, requestHash AS given, coalesce(noMaps, false) AS nm, pressureLevels, years, months, days, hours, mapTypes, mapLevels
   FROM (SELECT * REPLACE (CASE WHEN len(mapLevels) > 0 THEN mapLevels WHEN lower(variableName) = 'temperature' THEN ['10'] ELSE ['20'] END AS mapLevels, CASE WHEN lower(variableName) = 'temperature' THEN ['cont'] ELSE mapTypes END AS mapTypes) FROM req WHERE {VIOLATIONS} = ''))""",
         FILES,
         """one AS (SELECT hash, hash < '8' AS c, COUNT(*) AS n, bool_or(nm) AS nm, first(given ORDER BY given) AS given FROM hashed GROUP BY 1)""",
         """last AS (SELECT hash, first(l_returnflag ORDER BY l_shipdate DESC, l_linenumber DESC, given DESC) AS f, first(l_linenumber ORDER BY l_shipdate DESC, l_linenumber DESC, given DESC) AS no FROM hashed JOIN lineitem ON given = 'h' || l_orderkey GROUP BY 1)""",
         """step AS (SELECT o.*, CASE WHEN c THEN 'DONE' WHEN no IS NULL THEN 'EXECUTION' WHEN f = 'A' THEN 'FAILED' WHEN no % 2 = 1 AND NOT nm THEN 'MAP_GENERATION' ELSE 'DONE' END AS next_step FROM one o LEFT JOIN last USING (hash))""",
         """found AS (SELECT DISTINCT hash, file FROM hashed JOIN stored ON given = requestHash)"""]
query("Q07_whole_lifecycle", req_sql("""SELECT s.hash AS requestHash, CASE WHEN c THEN 'CACHED' ELSE 'GENERATING' END AS admitted, CASE WHEN c THEN 'CACHED' ELSE 'PROCESSING' END AS reply, CAST(CASE WHEN c THEN 2 + s.n ELSE 1 END AS BIGINT) AS timesRequested, s.n AS n_requests,
   CASE WHEN c THEN 0 ELSE len(pressureLevels)*len(years)*len(months)*len(days)*len(hours)*len(mapTypes)*len(mapLevels) END AS n_tasks, next_step,
   CASE WHEN next_step <> 'DONE' THEN 'GENERATING' WHEN k.n > 0 THEN 'CACHED' ELSE 'EMPTY' END AS settled, CASE WHEN next_step = 'DONE' THEN coalesce(k.n, 0) ELSE 0 END AS n_files
 FROM step s JOIN hashed h ON h.given = s.given LEFT JOIN (SELECT hash, COUNT(*) AS n FROM found GROUP BY 1) k ON k.hash = s.hash""", *CYCLE))(lambda s, d: whole_cycle(s, d, "states"))
query("Q07_lifecycle_tasks", req_sql("""SELECT hash AS requestHash, unnest(pressureLevels) AS pressureLevel, year, month, day, hour, mapType, mapLevel FROM (SELECT *, unnest(years) AS year FROM (SELECT *, unnest(months) AS month FROM (SELECT *, unnest(days) AS day
 FROM (SELECT *, unnest(hours) AS hour FROM (SELECT *, unnest(mapTypes) AS mapType FROM (SELECT h.*, unnest(mapLevels) AS mapLevel FROM hashed h JOIN one o ON o.given = h.given WHERE NOT c))))))""", *CYCLE))(
    lambda s, d: whole_cycle(s, d, "tasks").select("requestHash", "pressureLevel", "year", "month", "day", "hour", "mapType", "mapLevel"))
query("Q07_lifecycle_files", req_sql(f"""SELECT hash AS requestHash, file, {sfmt(NOW_SQL + ' + INTERVAL 7 DAY')} AS expiresAt, 'settled' AS state FROM found JOIN step USING (hash) WHERE next_step = 'DONE'
 UNION ALL SELECT hash, file, {sfmt('MAX(expiresAt)')}, CASE WHEN MAX(expiresAt) < {NOW_SQL} THEN 'deleted' ELSE 'kept' END FROM files JOIN hashed ON given = requestHash JOIN step USING (hash) WHERE next_step <> 'DONE' GROUP BY hash, file""", *CYCLE))(
    lambda s, d: whole_cycle(s, d, "files").select("requestHash", "file", fmt("expiresAt").alias("expiresAt"), "state"))


@query("T04_progress_stream", RUNNING + " SELECT user_id, event_id, CAST(progress AS BIGINT) AS progress FROM run")
def _progress_stream(s, d):
    """The whole events table as a file stream of several micro-batches, in event order."""
    base = scratch_path(s, "progress")
    e = events(s, d).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "increment", F.col("event_type").alias("message"))
    part = F.floor(F.dayofmonth("ts") / 11)
    for n in range(3):  # written one after the other: a file source reads in order of age
        e.where(part == n).write.mode("append").parquet(f"{base}/in")
    stream = s.readStream.schema("user_id bigint, event_id bigint, ts timestamp, increment bigint, message string").parquet(f"{base}/in")
    Z.progress_stream(stream, "user_id", "ts", "event_id", f"{base}/out", f"{base}/state", f"{base}/cp")
    return s.read.parquet(f"{base}/out").select("user_id", "event_id", "progress")


#: Instants in a file of the stream of slices.
INSTANTS_PER_FILE = 16


@query("T07_detect_stream", ORACLES["Q03_detect_blocking"])
def _detect_stream(s, d):
    from isohypsa.registry.inputs import SPEC, field, instants
    from isohypsa.sources.grid import shuffle_width, to_slices
    src, out = scratch_path(s, "slices-in"), scratch_path(s, "formations-out")
    # files follow the instants, up to the session's number: a micro-batch takes some seconds, however few of them it holds
    files = min(shuffle_width(s), math.ceil(instants(s, d).count() / INSTANTS_PER_FILE)) or 1
    to_slices(field(s, d), SPEC, partitions=files).write.parquet(src)
    Z.detect_stream(s.readStream.schema("time int, vals array<int>").option("maxFilesPerTrigger", 4).parquet(src), SPEC, out, scratch_path(s, "detect-cp"))
    return Z.read_formations(s, out)


def _versions(s, d, merge, rows, schema, part=None):
    src, root = scratch_path(s, "messages-in"), scratch_path(s, "catalogue")
    rows.write.parquet(src)
    table = Z.catalogue_stream(s.readStream.schema(schema).parquet(src), merge, root, catalogue(s, d), scratch_path(s, "catalogue-cp"))
    return table.current() if part is None else s.read.parquet(f"{root}/{part}").drop("batch")


ARRIVAL = "requestHash string, userId bigint, arrival bigint"


def _admit(batch, before):
    admitted = stage(K.admit_requests(batch, before), "admitted")  # the catalogue and the messages read it
    return {"catalogue": admitted.select(*CATALOGUE), "links": K.admission_links(batch, before),
            "messages": admitted.where("to_process > 0 OR to_settle").select("requestHash", "to_process", "to_settle")}


query("T08_admission_stream", "SELECT requestHash, requestStatus, timesRequested FROM (" + ORACLES["U01_admit_requests"] + ")")(lambda s, d: _versions(
    s, d, _admit, arrivals(s, d), ARRIVAL))
query("T08_admission_links_stream", ORACLES["U01_admission_links"])(lambda s, d: _versions(s, d, _admit, arrivals(s, d), ARRIVAL, "links"))
query("T08_admission_messages_stream", "SELECT requestHash, to_process, to_settle FROM (" + ORACLES["U01_admit_requests"] + ") WHERE to_process > 0 OR to_settle")(
    lambda s, d: _versions(s, d, _admit, arrivals(s, d), ARRIVAL, "messages"))
query("T08_settlement_stream", "SELECT u.requestHash, u.requestStatus, c.timesRequested FROM (" + ORACLES["U02_settle_results"] + ") u JOIN (" + req_sql("SELECT * FROM cat", CAT) + ") c USING (requestHash)")(lambda s, d: _versions(
    s, d, lambda b, c: K.settle_results(b, c, stored(s, d), now_col())[0].select(*CATALOGUE), done(s, d), "requestHash string, status string"))
