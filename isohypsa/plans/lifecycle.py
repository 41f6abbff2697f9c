"""The request life cycle: validate, complete, hash, admit, plan maps, follow the run, settle, expire."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohypsa.functions.text import with_request_hash
from isohypsa.operators import catalogue as K
from isohypsa.staging import stage
from isohypsa.streaming.messages import next_step

TASK_COLUMNS = ("pressureLevels", "years", "months", "days", "hours", "mapTypes", "mapLevels")
#: A run that has sent no notice yet.
WAITING = "EXECUTION"


@dataclass(frozen=True)
class Lifecycle:
    """One update of the catalogue. ``states``: a row per distinct request (requestHash, admitted, reply, timesRequested, n_requests, n_tasks, next_step, settled, n_files);
    ``tasks``: the maps to draw of requests that go to processing; ``files``: requestHash, file, expiresAt and state (settled, kept or deleted)."""

    states: DataFrame
    tasks: DataFrame
    files: DataFrame


def hashed_requests(requests: DataFrame) -> DataFrame:
    """Valid requests, completed and hashed; ``given`` is the name each came in with."""
    valid = K.validate_requests(requests).where(F.size("violations") == 0).drop("violations")
    return with_request_hash(K.request_defaults(valid).withColumnRenamed("requestHash", "given"))


def lifecycle(requests: DataFrame, listing: DataFrame, now: Column, catalogue: DataFrame | None = None,
              notices: DataFrame | None = None, notice_order: list[str] | None = None, files: DataFrame | None = None) -> Lifecycle:
    """From raw requests to settled ones.

    ``listing(requestHash, file)`` holds the stored files under the name each request came in with;
    equal requests get one hash and share their files. ``catalogue(requestHash, requestStatus, timesRequested)`` is what is
    known already: a request that it holds as cached is answered at once, has no tasks, and is settled
    again. The others go to processing. ``notices(requestHash, request_type, exec_status, *notice_order)``, by given name, is what their runs reported: the latest notice
    of a request tells its next step, and only those that are done are settled; without notices every run counts as finished.
    ``files(requestHash, file, expiresAt)`` are known files, by given name: those of settled requests are replaced, others stay until they expire."""
    # read several times below: written once, so that the hashes are computed once
    hashed = stage(hashed_requests(requests), "hashed")
    sizes = [F.size(c).cast("bigint") for c in TASK_COLUMNS]
    # one grouping carries all that later steps need of a request
    distinct = hashed.groupBy("requestHash").agg(
        F.min(reduce(mul, sizes)).alias("n_tasks"), F.count(F.lit(1)).alias("n_requests"), F.max("noMaps").alias("noMaps"),
        F.min(F.struct(*TASK_COLUMNS)).alias("lists"))
    if catalogue is None:
        known = distinct.withColumns({"requestStatus": F.lit(None).cast("string"), "timesRequested": F.lit(None).cast("bigint")})
    else:
        known = distinct.join(catalogue.select("requestHash", "requestStatus", "timesRequested"), "requestHash", "left")
    state = K.admitted_state(known.withColumn("_n", F.col("n_requests")))
    carried = distinct.select("requestHash", "n_tasks", "n_requests", F.coalesce("noMaps", F.lit(False)).alias("noMaps"), "lists")
    admitted = state.join(carried, "requestHash")
    names = hashed.select("requestHash", "given")
    run = F.col("to_process") > 0
    if notices is None:
        admitted = admitted.withColumn("next_step", F.when(run & ~F.col("noMaps"), "MAP_GENERATION").otherwise("DONE"))
        finished = F.lit(True)
    else:
        sent = notices.withColumnRenamed("requestHash", "given").join(names, "given").join(carried.select("requestHash", "noMaps"), "requestHash")
        latest = next_step(sent, "requestHash", notice_order or []).withColumnRenamed("next_step", "_told")
        admitted = admitted.join(latest, "requestHash", "left").withColumn("next_step", F.when(run, F.coalesce("_told", F.lit(WAITING))).otherwise("DONE"))
        finished = F.col("next_step") == "DONE"
    admitted = stage(admitted, "admitted")
    found = listing.withColumnRenamed("requestHash", "given").join(names, "given").select("requestHash", "file").distinct()
    done = admitted.where(finished & (run | F.col("to_settle"))).select("requestHash", F.lit("OK").alias("status"))
    settled = K.settled_state(done, admitted.select("requestHash", "requestStatus"), found, now)
    states = admitted.join(settled.select("requestHash", F.col("requestStatus").alias("settled"), "n_files"), "requestHash").select(
        "requestHash", F.col("requestStatus").alias("admitted"), "reply", "timesRequested", "n_requests",
        F.when(run, F.col("n_tasks")).otherwise(0).alias("n_tasks"), "next_step", "settled", F.coalesce("n_files", F.lit(0)).alias("n_files"))
    tasks = K.map_tasks(admitted.where(run).select("requestHash", "lists.*"))
    fresh = K.settled_files(done, admitted, found, now).select("requestHash", "file", "expiresAt", F.lit("settled").alias("state"))
    if files is None:
        return Lifecycle(states, tasks, fresh)
    old = files.withColumnRenamed("requestHash", "given").join(names, "given").groupBy("requestHash", "file").agg(F.max("expiresAt").alias("expiresAt"))
    old = old.join(done.select("requestHash"), "requestHash", "left_anti")
    gone, kept = K.expire_files(old, now)
    told = [part.select("requestHash", "file", "expiresAt", F.lit(name).alias("state")) for part, name in ((gone, "deleted"), (kept, "kept"))]
    return Lifecycle(states, tasks, fresh.unionByName(told[0]).unionByName(told[1]))


def request_lifecycle(requests: DataFrame, listing: DataFrame, now: Column, catalogue: DataFrame | None = None) -> DataFrame:
    """The states of a life cycle whose runs have all finished."""
    return lifecycle(requests, listing, now, catalogue).states


def save_lifecycle(update: Lifecycle, root: str, version: int) -> None:
    """Write an update as a version of the catalogue under ``root``. The states come last: a version without them is not complete. Writing a version again replaces it."""
    for name in ("tasks", "files", "states"):
        getattr(update, name).write.mode("overwrite").parquet(f"{root}/{name}/version={version}")


def read_lifecycle(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the newest complete version; tables are states, tasks and files."""
    newest = spark.read.parquet(f"{root}/states").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/{name}/version={newest}")
