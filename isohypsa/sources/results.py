"""Result tables: formatting, writing under a request hash, reading back, listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from isohypsa.functions.geo import height, lat_of, lon_of
from isohypsa.params import GridSpec
from isohypsa.sources.grid import shuffle_width
from isohypsa.staging import stage

SCHEMAS = {
    "selected": "time int, latitude double, longitude double, z double, type string, cluster int, "
                "centroid_lat double, centroid_lon double, request_hash string",
    "formations": "time int, max_id int, min1_id int, min2_id int, type string, request_hash string",
    "temperature": "time int, latitude double, longitude double, t double, cluster int, "
                   "centroid_lat double, centroid_lon double, request_hash string",
    "speed": "part string, instant int, time_elapsed double, request_hash string",
}


def _fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c.cast("double"))


def selected_rows(points: DataFrame, spec: GridSpec) -> DataFrame:
    return points.select(
        "time",
        _fixed(lat_of(F.col("x") * spec.step, spec), 2).alias("latitude"),
        _fixed(lon_of(F.col("y") * spec.step, spec), 2).alias("longitude"),
        _fixed(height(F.col("raw"), spec), 1).alias("z"),
        "type", "cluster",
        _fixed(F.col("center_lat"), 2).alias("centroid_lat"), _fixed(F.col("center_lon"), 2).alias("centroid_lon"),
    )


def unfiltered_rows(extrema: DataFrame, spec: GridSpec) -> DataFrame:
    """Typed points before any cluster is dropped; not yet clustered, hence -1."""
    return extrema.where(F.col("type") != "NO_TYPE").select(
        "time",
        _fixed(lat_of(F.col("x") * spec.step, spec), 2).alias("latitude"),
        _fixed(lon_of(F.col("y") * spec.step, spec), 2).alias("longitude"),
        _fixed(height(F.col("raw"), spec), 1).alias("z"),
        "type", F.lit(-1).alias("cluster"),
    )


def formation_rows(formations: DataFrame) -> DataFrame:
    return formations.select("time", "max_id", "min1_id", F.coalesce("min2_id", F.lit(-1)).alias("min2_id"), "type")


def temperature_rows(hot: DataFrame) -> DataFrame:
    return hot.select(
        "time", _fixed(F.col("latitude"), 2).alias("latitude"), _fixed(F.col("longitude"), 2).alias("longitude"),
        _fixed(F.col("t"), 2).alias("t"), "cluster",
        _fixed(F.col("centroid_lat"), 2).alias("centroid_lat"), _fixed(F.col("centroid_lon"), 2).alias("centroid_lon"),
    )


def timing_rows(timings: DataFrame) -> DataFrame:
    """Measured stage times with milliseconds."""
    return timings.select("part", F.col("instant").cast("int").alias("instant"), _fixed(F.col("time_elapsed"), 3).alias("time_elapsed"))


def write_results(df: DataFrame, base: str, kind: str, request_hash: str | Column) -> str:
    """Append rows of one kind as CSV under base/kind/request_hash=.../"""
    tag = F.lit(request_hash) if isinstance(request_hash, str) else request_hash
    path = f"{base}/{kind}"
    df.withColumn("request_hash", tag).write.mode("append").partitionBy("request_hash").option("header", True).csv(path)
    return path


def results_table(spark: SparkSession, base: str, kind: str) -> DataFrame:
    """Results of all runs of one kind; ``request_hash`` is a folder, so a filter or join on it reads only what it needs."""
    if kind not in SCHEMAS:
        raise ValueError(f"unknown result kind {kind!r}")
    try:
        return spark.read.schema(SCHEMAS[kind]).option("header", True).csv(f"{base}/{kind}")
    except AnalysisException as e:
        raise FileNotFoundError(f"no {kind!r} results under {base}") from e


def read_results(spark: SparkSession, base: str, kind: str, request_hash: str) -> DataFrame:
    """Rows of one result table; an unknown kind or hash is an error, not an empty result."""
    found = results_table(spark, base, kind).where(F.col("request_hash") == request_hash)
    missing = found.limit(1).isEmpty()
    if missing:
        raise FileNotFoundError(f"no {kind!r} results for {request_hash}")
    return found


def publish_results(df: DataFrame, base: str, hash_col: str = "request_hash", rows_per_file: int = 1_000_000) -> DataFrame:
    """Place every row's data under base/<hash>/ and return the listing of the hashes written. What other runs have
    published under other hashes stays; a hash that is published again is replaced.

    A hash gets a file for every ``rows_per_file`` of its rows, so one that holds a large share of them is written by many tasks. The
    place of a row depends on the row only, so retries repeat it."""
    spark = df.sparkSession
    files = df.groupBy(hash_col).agg(F.ceil(F.count("*") / rows_per_file).alias("_files"))
    files = stage(files, "published")
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != hash_col]), F.col("_files"))
    # a stated number of tasks: a hash costs a folder and a file, however few its bytes, and by bytes all would be merged into one task
    dealt = df.join(files, hash_col).repartition(shuffle_width(spark), F.col(hash_col), salt).drop("_files")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(hash_col).option("header", True).csv(base)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(base)
    listing = listing.select("path", F.col("length").alias("size"), F.regexp_extract("path", f"/{hash_col}=([^/]*)/", 1).alias(hash_col))
    return listing.join(files.select(F.col(hash_col).cast("string").alias(hash_col)), hash_col, "left_semi").select("path", "size")


def run_output_name(long_name: Column, kind: Column, source: Column, ts: Column) -> Column:
    """<long_name>_<kind>_<base name without extension>_<dd-MM-yyyy_HH-mm>UTC.csv"""
    base = F.regexp_replace(F.regexp_extract(source, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.concat(long_name, F.lit("_"), kind, F.lit("_"), base, F.lit("_"), F.date_format(ts, "dd-MM-yyyy_HH-mm"), F.lit("UTC.csv"))


def folders_of(name: Column) -> Column:
    """Every folder that holds a key: for a/b/c.csv these are a and a/b."""
    parts = F.split(name, "/")
    return F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def list_objects(listing: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Objects under each ``prefix``, a folder of any depth (folder keys excluded). A key meets its few folders, so this
    is an equi-join, not a scan per prefix."""
    keyed = listing.where(~F.col("name").endswith("/")).withColumn("prefix", F.explode(folders_of(F.col("name"))))
    wanted = prefixes.select(F.regexp_replace("prefix", "/+$", "").alias("prefix")).distinct()
    return keyed.join(wanted, "prefix", "left_semi").withColumn("file", F.expr("substring(name, length(prefix) + 2)"))


def prefix_exists(listing: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Prefixes that have at least one key (a folder key is enough)."""
    have = listing.select(F.explode(folders_of(F.col("name"))).alias("_folder")).distinct().withColumn("exists", F.lit(True))
    found = prefixes.withColumn("_folder", F.regexp_replace("prefix", "/+$", "")).join(have, "_folder", "left").drop("_folder")
    return found.withColumn("exists", F.coalesce("exists", F.lit(False)))
