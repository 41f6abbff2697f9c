"""Requests, generated files and users: validation, joins, grouping and upserts.

Tables: requests(requestHash, ..., requestStatus, timesRequested, updatedAt),
files(requestHash, file, expiresAt) with one row per file, users(id, name, email, role) and
the bridge user_requests(user_id, requestHash).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isohypsa.functions.text import CONFIG_KEYS, proxy_url, variable_code
from isohypsa.staging import stage

# Allowed values of each option, fixed.
DOMAINS = {
    "variableName": ("geopotential", "temperature"),
    "pressureLevels": ("1000", "900", "850", "700", "550", "500", "300", "200", "100", "50", "10"),
    "mapTypes": ("cont", "disp", "comb", "forms"),
    "mapLevels": ("10", "15", "20", "25", "30"),
    "fileFormat": ("svg", "png", "jpg", "jpeg", "pdf"),
}
REQUIRED_ARRAYS = ("pressureLevels", "years", "months", "days", "hours", "areaCovered", "mapTypes")
# Inclusive limits of the four area coordinates, in N, W, S, E order.
AREA_LIMITS = (("North", 0, 90), ("West", -180, 0), ("South", -90, 0), ("East", 0, 180))
FILE_DAYS = 7
GENERATING, CACHED, EMPTY = "GENERATING", "CACHED", "EMPTY"


def reasons(rules: list[tuple[Column, str]]) -> Column:
    """Names of the broken rules, in rule order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for bad, name in rules]))


def validate_run_params(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumn("violations", reasons([
        (F.length("path") > 255, "path"),
        (~c("lat_min").between(-90, 90) | ~c("lat_max").between(-90, 90) | (c("lat_min") > c("lat_max")), "latitude"),
        (~c("lon_min").between(-180, 180) | ~c("lon_max").between(-180, 180) | (c("lon_min") > c("lon_max")), "longitude"),
        (c("threads") < 1, "threads"),
    ]))


def validate_requests(df: DataFrame) -> DataFrame:
    rules: list[tuple[Column, str]] = [(F.coalesce(F.length("variableName"), F.lit(0)) == 0, "variableName required")]
    rules += [(F.coalesce(F.size(k), F.lit(0)) <= 0, f"{k} required") for k in REQUIRED_ARRAYS]
    four = F.size("areaCovered") == 4
    rules.append((F.coalesce(F.size("areaCovered") > 0, F.lit(False)) & ~four, "invalid coordinates"))
    wrong = F.lit(None).cast("string")
    for n, (name, lo, hi) in reversed(list(enumerate(AREA_LIMITS))):
        v = F.get("areaCovered", F.lit(n)).try_cast("double")
        wrong = F.when(v.isNull() | ~v.between(lo, hi), f"invalid {name} coordinate").otherwise(wrong)
    area = F.when(four, wrong)
    return df.withColumn("violations", F.array_compact(F.concat(reasons(rules), F.array(area))))


def unexpected_columns(df: DataFrame, allowed: tuple[str, ...]) -> list[str]:
    return [c for c in df.columns if c not in allowed]


def option_domain_check(df: DataFrame) -> DataFrame:
    """Options with a value outside their list."""
    rules = []
    for key, values in DOMAINS.items():
        if dict(df.dtypes)[key].startswith("array"):
            bad = F.coalesce(F.exists(key, lambda v: ~v.isin(*values)), F.lit(False))
        else:
            bad = F.coalesce(~F.col(key).isin(*values), F.lit(False))
        rules.append((bad, key))
    return df.withColumn("out_of_domain", reasons(rules))


def calendar_filter(df: DataFrame) -> DataFrame:
    """Selected days that exist in at least one selected (year, month)."""
    def length(y: Column, m: Column) -> Column:
        return F.dayofmonth(F.last_day(F.make_date(y.cast("int"), m.cast("int"), F.lit(1))))

    longest = F.array_max(F.flatten(F.transform("months", lambda m: F.transform("years", lambda y: length(y, m)))))
    return df.withColumn("max_day", longest).withColumn(
        "valid_days",
        F.coalesce(F.filter("days", lambda d: d.cast("int").between(1, F.col("max_day"))), F.array().cast("array<string>")),
    )


def available_days(selection: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct selectable days over rows (key, year, month)."""
    last = F.dayofmonth(F.last_day(F.make_date("year", "month", F.lit(1))))
    return selection.groupBy(*keys).agg(F.max(last).alias("last")).select(
        *keys, F.explode(F.sequence(F.lit(1), F.col("last"))).alias("day"),
    )


def request_defaults(df: DataFrame) -> DataFrame:
    hot = F.lower("variableName") == "temperature"
    empty = F.coalesce(F.size("mapLevels"), F.lit(0)) <= 0
    return df.withColumns({
        "mapLevels": F.when(empty, F.when(hot, F.array(F.lit("10"))).otherwise(F.array(F.lit("20")))).otherwise(F.col("mapLevels")),
        "mapTypes": F.when(hot, F.array(F.lit("cont"))).otherwise(F.col("mapTypes")),
    })


def variable_lookup(df: DataFrame, name: str = "variableName") -> DataFrame:
    code = variable_code(F.col(name))
    return df.withColumns({"variable": code, "rejected": code.isNull()})


def config_projection(df: DataFrame) -> DataFrame:
    """The whitelisted keys; absent ones become NULL."""
    have = set(df.columns)
    return df.select(*[F.col(k) if k in have else F.lit(None).cast("string").alias(k) for k in CONFIG_KEYS])


def return_view(df: DataFrame, now: Column) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.withColumns({
        "mapLevels": F.coalesce("mapLevels", none),
        "noData": F.coalesce("noData", F.lit(False)),
        "noMaps": F.coalesce("noMaps", F.lit(False)),
        "omp": F.coalesce("omp", F.lit(False)),
        "mpi": F.coalesce("mpi", F.lit(False)),
        "timesRequested": F.coalesce("timesRequested", F.lit(0)),
        "updatedAt": F.coalesce("updatedAt", now),
    }).drop("nThreads", "nProces", "userId")


# --- joins --------------------------------------------------------------------------------------


def requests_of_user(users: DataFrame, bridge: DataFrame, requests: DataFrame) -> DataFrame:
    return users.select(F.col("id").alias("user_id")).join(bridge, "user_id").join(requests, "requestHash")


def request_with_relations(requests: DataFrame, bridge: DataFrame, files: DataFrame) -> DataFrame:
    """Requests with the number of their users and files; both sides are aggregated before the
    join, so a popular request does not multiply into users x files rows."""
    u = bridge.groupBy("requestHash").agg(F.count(F.lit(1)).alias("n_users"))
    f = files.groupBy("requestHash").agg(F.count(F.lit(1)).alias("n_files"), F.max("expiresAt").alias("expiresAt"))
    return requests.join(u, "requestHash", "left").join(f, "requestHash", "left").fillna(0, ["n_users", "n_files"])


def request_relations(requests: DataFrame, bridge: DataFrame, files: DataFrame) -> DataFrame:
    """The related rows themselves, one per user and one per file of a request, so that no request gathers them in one value:
    requestHash, requestStatus, relation (user, file or none), user_id, file, expiresAt."""
    own = requests.select("requestHash", "requestStatus")
    related = bridge.select("requestHash", F.lit("user").alias("relation"), "user_id").unionByName(
        files.select("requestHash", F.lit("file").alias("relation"), "file", "expiresAt"), allowMissingColumns=True)
    return own.join(related, "requestHash", "left").withColumn("relation", F.coalesce("relation", F.lit("none")))


def unexpected_fields(df: DataFrame, body: str, allowed: tuple[str, ...]) -> DataFrame:
    """Messages whose JSON body names fields that a request does not have, with those names in order."""
    names = F.array_sort(F.array_except(F.coalesce(F.json_object_keys(body), F.array().cast("array<string>")), F.array(*map(F.lit, allowed))))
    return df.withColumn("unexpected", names).where(F.size("unexpected") > 0)


def requests_by_hashes(requests: DataFrame, hashes: DataFrame) -> DataFrame:
    return requests.join(hashes.select("requestHash"), "requestHash", "left_semi")


def files_without_catalogue(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Stored objects (requestHash, file) whose request has no catalogue row."""
    return listing.join(files.select("requestHash"), "requestHash", "left_anti")


def email_conflicts(incoming: DataFrame, users: DataFrame) -> DataFrame:
    owner = users.select(F.col("email"), F.col("id").alias("owner_id"))
    return incoming.join(owner, (incoming["email"] == owner["email"]) & (incoming["id"] != owner["owner_id"]), "left_semi")


def map_tasks(requests: DataFrame) -> DataFrame:
    """One row per map to draw."""
    out = requests
    for col, name in (
        ("pressureLevels", "pressureLevel"), ("years", "year"), ("months", "month"), ("days", "day"),
        ("hours", "hour"), ("mapTypes", "mapType"), ("mapLevels", "mapLevel"),
    ):
        out = out.withColumn(name, F.explode(col)).drop(col)
    return out


# --- aggregates ---------------------------------------------------------------------------------


def content_key(df: DataFrame) -> DataFrame:
    """Fields that make two requests the same for display: first year, month and day only, hours
    ignored, arrays compared in their order, the area read as integers."""
    return df.withColumn("content", F.struct(
        "variableName", F.transform("pressureLevels", lambda v: v.try_cast("int")).alias("levels"),
        F.get("years", F.lit(0)).try_cast("int").alias("year"), F.get("months", F.lit(0)).try_cast("int").alias("month"),
        F.get("days", F.lit(0)).try_cast("int").alias("day"),
        F.transform("areaCovered", lambda v: v.try_cast("int")).alias("area"),
        "mapTypes", "mapLevels", F.nullif(F.col("fileFormat"), F.lit("")).alias("format"),
    ))


def group_requests(df: DataFrame) -> DataFrame:
    """Newest request of each content and how many there are. An aggregate, not a ranking: a
    content shared by very many requests is combined before the shuffle."""
    return content_key(df).groupBy("content").agg(
        F.max(F.struct("updatedAt", "requestHash")).alias("newest"), F.count(F.lit(1)).alias("count"),
    ).select(F.col("newest.requestHash").alias("requestHash"), F.col("newest.updatedAt").alias("updatedAt"), "count")


def task_outcome(tasks: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    per = tasks.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_tasks"), F.count_if(~F.col("success")).alias("n_failed"),
        F.bool_and("success").alias("_all"),
    )
    return requests.select(key).join(per, key, "left").select(
        key, F.coalesce("n_tasks", F.lit(0)).alias("n_tasks"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"),
        F.coalesce("_all", F.lit(False)).alias("success"),
    )


def stage_time_rollup(timings: DataFrame) -> DataFrame:
    """Total per part and items per second. Elapsed comes as integer hundredths: exact sums."""
    return timings.groupBy("part").agg(F.sum("elapsed_cs").alias("_cs"), F.count(F.lit(1)).alias("n")).select(
        "part", "n", (F.col("_cs") / 100).alias("total"),
        F.when(F.col("_cs") > 0, F.col("n") / (F.col("_cs") / 100)).otherwise(0.0).alias("per_second"),
    )


def newest_first(requests: DataFrame) -> DataFrame:
    return requests.orderBy(F.col("updatedAt").desc(), "requestHash")


def first_preview(listing: DataFrame) -> DataFrame:
    """First image of each request in listing order."""
    return listing.where(F.col("kind") == "image").groupBy("requestHash").agg(
        F.min(F.struct("position", "file")).alias("p"),
    ).select("requestHash", F.col("p.file").alias("file"))


def nearest_runs(runs: DataFrame, key: str, age: str, tie: str, k: int = 3) -> DataFrame:
    """The k runs nearest to now per date, nearest first. The rank filter also limits each task
    before the shuffle, so a date holding most runs sends k rows per task."""
    w = W.partitionBy(key).orderBy(F.abs(F.col(age)), tie)
    return runs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --- numbering and running sums that tolerate hot keys -------------------------------------------


def position_within(df: DataFrame, keys: list[str], block: Column, order: list[Column], out: str) -> DataFrame:
    """0-based position of each row within ``keys`` by ``order``. ``block`` must not decrease along
    the order: rows are numbered within (keys, block) and block sizes give the offsets, so a key
    holding very many rows is spread over its blocks. Null keys are one key, null blocks the first block."""
    d = df.withColumn("_block", block)
    sizes = d.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    at = [*keys, "_block"]
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).select(
        *(F.col(c).alias(f"_of_{i}") for i, c in enumerate(at)), "_before")
    inside = F.row_number().over(W.partitionBy(*at).orderBy(*order)) - 1
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(at)))
    return d.withColumn("_in", inside).join(offsets, same).withColumn(
        out, (F.col("_in") + F.col("_before")).cast("bigint"),
    ).drop("_block", "_in", "_before", *(f"_of_{i}" for i in range(len(at))))


def position_by_range(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """As ``position_within``, for orders whose spread is not known: the blocks are the ranges of a global
    range partitioning by keys and order, so their size follows the rows and a key with very many rows is
    spread over as many ranges as it fills. The ranges are written once, because a second sampling could cut elsewhere."""
    dealt = stage(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    return position_within(dealt, keys, F.col("_range"), order, out).drop("_range")


def unique_names(files: DataFrame, name: str, order: str, block_width: int = 100_000) -> DataFrame:
    """``base.ext`` stays for the first, ``base(n).ext`` for the n-th duplicate."""
    stem = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    ext = F.regexp_extract(F.col(name), r"(\.[^.]*)$", 1)
    numbered = position_within(files, [name], F.floor(F.col(order) / block_width), [F.col(order)], "_n")
    return numbered.withColumn(
        "unique_name",
        F.when(F.col("_n") > 0, F.concat(stem, F.lit("("), F.col("_n"), F.lit(")"), ext)).otherwise(F.col(name)),
    ).drop("_n")


def time_blocks(events: DataFrame, ts: str, blocks: int) -> Column:
    """Number of the equal stretch of the events' own time range that a row falls into; the range is two values."""
    u = F.unix_micros(F.col(ts).cast("timestamp"))
    lo, hi = events.agg(F.min(u), F.max(u)).first()
    if lo is None or lo == hi:
        return F.lit(0).cast("bigint")
    return F.width_bucket(u.cast("double"), F.lit(float(lo)), F.lit(float(hi)), F.lit(blocks).cast("bigint"))


def progress_running(events: DataFrame, key: str, ts: str, tie: str, blocks: int | None = None,
                     carry: DataFrame | None = None) -> DataFrame:
    """Progress after each event of a run: increments outside 0..100 are ignored, 100 ends the run,
    otherwise min(100, 4 x the increments since the last end).

    Running sums are taken within (key, time block); each block's carry-in comes from the block
    totals, so a run with very many events is spread over its blocks. The blocks divide the time range of these events,
    a year or a minute, into ``blocks`` parts (four per shuffle partition unless stated). ``carry(key, carry)`` holds
    the sums of runs begun in earlier batches."""
    ok = events.where(F.col("increment").between(0, 100))
    blocks = blocks or 4 * int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = ok.withColumns({
        "_block": time_blocks(ok, ts, blocks), "_end": (F.col("increment") == 100).cast("int"),
        "_inc": F.when(F.col("increment") == 100, 0).otherwise(F.col("increment")),
    })
    inner = W.partitionBy(key, "_block").orderBy(ts, tie).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_seg", F.coalesce(F.sum("_end").over(inner), F.lit(0)))
    upto = W.partitionBy(key, "_block", "_seg").orderBy(ts, tie).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_sum", F.sum("_inc").over(upto))
    # what a block hands on: the sum after its last end, and whether it has one
    blocks = d.groupBy(key, "_block").agg(
        F.sum("_end").alias("_ends"), F.sum("_inc").alias("_total"),
        F.max(F.struct(F.col("_seg").alias("s"), F.col("_sum").alias("v"), F.col("_end").alias("e"))).alias("_l"),
    ).withColumn("_tail", F.when(F.col("_l.e") == 1, 0).otherwise(F.col("_l.v")))
    prior = W.partitionBy(key).orderBy("_block")
    blocks = blocks.withColumn("_grp", F.sum(F.when(F.col("_ends") > 0, 1).otherwise(0)).over(prior))
    # blocks without an end extend the tail of the last block that has one
    blocks = blocks.withColumn("_give", F.when(F.col("_ends") > 0, F.col("_tail")).otherwise(F.col("_total")))
    blocks = blocks.withColumn("_held", F.sum("_give").over(
        W.partitionBy(key, "_grp").orderBy("_block").rowsBetween(W.unboundedPreceding, 0),
    )).withColumn("_carry", F.coalesce(F.lag("_held").over(prior), F.lit(0)))
    if carry is not None:
        earlier = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
        begun = F.coalesce(F.sum("_ends").over(earlier), F.lit(0)) == 0
        blocks = blocks.withColumn("_begun", begun).join(carry.withColumnRenamed("carry", "_kept"), key, "left").withColumn(
            "_carry", F.col("_carry") + F.when(F.col("_begun"), F.coalesce("_kept", F.lit(0))).otherwise(0),
        )
    out = d.join(blocks.select(key, "_block", "_carry"), [key, "_block"])
    run = F.col("_sum") + F.when(F.col("_seg") == 0, F.col("_carry")).otherwise(0)
    return out.withColumn(
        "progress", F.when(F.col("_end") == 1, 100).otherwise(F.least(F.lit(100), run * 4)).cast("bigint"),
    ).drop("_block", "_end", "_inc", "_seg", "_sum", "_carry")


def progress_carry(events: DataFrame, key: str, ts: str, tie: str, carry: DataFrame | None = None) -> DataFrame:
    """(key, carry) after a batch: increments since the last end, on top of the earlier carry where
    the batch has no end."""
    ok = events.where(F.col("increment").between(0, 100))
    ends = ok.where(F.col("increment") == 100).groupBy(key).agg(F.max(F.struct(ts, tie)).alias("_last"))
    since = ok.join(ends, key, "left").where(F.col("_last").isNull() | (F.struct(ts, tie) > F.col("_last")))
    sums = since.groupBy(key).agg(F.sum("increment").alias("_new"))
    kept = carry if carry is not None else sums.select(key, F.lit(0).cast("bigint").alias("carry")).where(F.lit(False))
    j = kept.join(sums, key, "full_outer").join(ends, key, "left")
    return j.select(key, (
        F.coalesce("_new", F.lit(0)) + F.when(F.col("_last").isNull(), F.coalesce("carry", F.lit(0))).otherwise(0)
    ).cast("bigint").alias("carry"))


def progress_view(df: DataFrame, ts: Column) -> DataFrame:
    return df.withColumn("timestamp", ts).withColumn("completed", F.col("progress") >= 100)


# --- upserts ------------------------------------------------------------------------------------


def admit_requests(incoming: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Merge a batch of (requestHash, userId, arrival) into catalogue(requestHash, requestStatus,
    timesRequested). One row per hash of either side with its new state, how many messages go to
    processing, whether the cached result must be settled again, and the reply."""
    batch = incoming.groupBy("requestHash").agg(F.count(F.lit(1)).alias("_n"))
    return admitted_state(catalogue.join(batch, "requestHash", "full_outer"))


def admitted_state(known: DataFrame) -> DataFrame:
    """The new state of rows (requestHash, requestStatus, timesRequested: as catalogued, or null; _n: how often asked for now, or null)."""
    new = F.col("requestStatus").isNull()
    hit = F.col("_n").isNotNull() & (F.col("requestStatus") == CACHED)
    sent = F.when(hit | F.col("_n").isNull(), F.lit(0)).otherwise(F.col("_n"))
    return known.select(
        "requestHash",
        F.coalesce("requestStatus", F.lit(GENERATING)).alias("requestStatus"),
        F.when(new, F.lit(1)).when(hit, F.col("timesRequested") + F.col("_n")).otherwise(F.col("timesRequested"))
        .cast("bigint").alias("timesRequested"),
        sent.cast("bigint").alias("to_process"),
        F.coalesce(hit, F.lit(False)).alias("to_settle"),
        F.when(hit, "CACHED").when(F.col("_n").isNotNull(), "PROCESSING").alias("reply"),
    )


def admission_links(incoming: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Users to associate: everyone asking for a cached request, and the first one asking for a
    new request; a request still being generated is not linked again."""
    j = incoming.where(F.col("userId").isNotNull()).join(
        catalogue.select("requestHash", "requestStatus"), "requestHash", "left",
    )
    cached = j.where(F.col("requestStatus") == CACHED).select("userId", "requestHash")
    # only the messages of new requests are ranked: known ones, the usual case, leave before
    new = incoming.join(catalogue.select("requestHash"), "requestHash", "left_anti")
    first_of_new = new.groupBy("requestHash").agg(F.min(F.struct("arrival", "userId")).alias("f")).select(F.col("f.userId").alias("userId"), "requestHash").where(F.col("userId").isNotNull())
    return cached.unionByName(first_of_new).select(F.col("userId").alias("user_id"), "requestHash").distinct()


def done_hashes(done: DataFrame) -> DataFrame:
    return done.where(F.col("status") == "OK").select("requestHash").distinct()


def settled_state(done: DataFrame, catalogue: DataFrame, listing: DataFrame, now: Column) -> DataFrame:
    """The catalogue after done messages: a request without stored files becomes EMPTY; messages with an error
    status change nothing."""
    hashes = done_hashes(done).withColumn("_done", F.lit(True))
    # only the listing of settled requests is counted, not the whole store
    stored = listing.join(hashes.select("requestHash"), "requestHash", "left_semi").groupBy("requestHash").agg(F.count(F.lit(1)).alias("n_files"))
    state = catalogue.join(hashes, "requestHash", "left").join(stored, "requestHash", "left")
    full = F.col("n_files") > 0
    return state.withColumns({
        "requestStatus": F.when(F.col("_done"), F.when(full, CACHED).otherwise(EMPTY)).otherwise(F.col("requestStatus")),
        "expiresAt": F.when(F.col("_done") & full, now + F.expr(f"INTERVAL {FILE_DAYS} DAYS")),
        "n_files": F.when(F.col("_done"), F.coalesce("n_files", F.lit(0))),
    }).drop("_done")


def settled_files(done: DataFrame, catalogue: DataFrame, listing: DataFrame, now: Column) -> DataFrame:
    """The stored files of settled requests that the catalogue holds, with their place and new date."""
    return listing.join(done_hashes(done), "requestHash", "left_semi").join(
        catalogue.select("requestHash"), "requestHash", "left_semi",
    ).withColumns({
        "url": proxy_url(F.col("requestHash"), F.col("file")), "expiresAt": now + F.expr(f"INTERVAL {FILE_DAYS} DAYS"),
    })


def settle_results(done: DataFrame, catalogue: DataFrame, listing: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Apply done messages: (new catalogue, file rows of the settled requests)."""
    return settled_state(done, catalogue, listing, now), settled_files(done, catalogue, listing, now)


def file_rows(files: DataFrame, array_col: str = "files") -> DataFrame:
    """Catalogue rows holding an array of files -> one row per file."""
    return files.withColumn("file", F.explode(array_col)).drop(array_col)


def expire_files(files: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(keys to delete, rows to keep)."""
    gone = F.col("expiresAt") < now
    return files.where(gone), files.where(~gone | F.col("expiresAt").isNull())


def user_upsert(incoming: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new users table, rejected rows). Absent or empty attributes keep their value, new users get
    role ``user``; an email owned by another id is refused, within a batch the lowest id wins."""
    clash = email_conflicts(incoming, users).select("id").withColumn("_clash", F.lit(True))
    # rows without an e-mail, the usual partial update, take no part in the contest and meet no common key
    named = incoming.where(F.col("email").isNotNull())
    winner = named.groupBy("email").agg(F.min("id").alias("_winner"))
    checked = named.join(winner, "email").select(*incoming.columns, "_winner").unionByName(
        incoming.where(F.col("email").isNull()), allowMissingColumns=True).join(clash, "id", "left")
    refused = F.col("_clash").isNotNull() | (F.col("email").isNotNull() & (F.col("id") != F.col("_winner")))
    good = checked.where(~refused)
    n = good.select("id", *[F.col(c).alias(f"new_{c}") for c in ("name", "email", "role")])
    merged = users.join(n, "id", "full_outer").select(
        "id", *[
            F.coalesce(F.nullif(F.col(f"new_{c}"), F.lit("")), F.col(c), *([F.lit("user")] if c == "role" else [])).alias(c)
            for c in ("name", "email", "role")
        ],
    )
    return merged, checked.where(refused).select("id", "email").withColumn("error", F.lit("e-mail belongs to another user"))


def link_user_requests(bridge: DataFrame, new_links: DataFrame) -> DataFrame:
    return bridge.unionByName(new_links).distinct()


def remove_by_id(table: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, ids that did not exist)."""
    return table.join(ids.select(key), key, "left_anti"), ids.select(key).distinct().join(
        table.select(key), key, "left_anti",
    ).withColumn("error", F.lit("not found"))
