"""Message streams: parsing, routing, expiry, running progress, detection and catalogue updates.

Every step is a plain DataFrame transform usable on a batch or a stream. Streams that carry state
(progress, catalogue, users' requests) keep it in a table (state.py) that a batch joins and updates, so a key with very many events is spread like in
the batch form instead of sitting in one state task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from isohypsa.functions.text import parse_envelope
from isohypsa.operators.catalogue import progress_carry, progress_running
from isohypsa.params import GridSpec
from isohypsa.sources.grid import folder_of
from isohypsa.staging import exists, scoped, stage
from isohypsa.streaming.state import StateTable

# Fixed bindings: routing key -> (queue, exchange).
ROUTES = {
    "config.create": ("config_queue", "requests_exchange"),
    "handler.start": ("handler_queue", "requests_exchange"),
    "execution.algorithm": ("execution_algorithm_queue", "execution_exchange"),
    "execution.visualization": ("execution_visualization_queue", "execution_exchange"),
    "notify.handler": ("notifications_queue", "notifications_exchange"),
    "results.done": ("results_queue", "results_exchange"),
    "progress.update": ("progress_queue", "progress_exchange"),
}
MESSAGE_TTL_MS = 5000


def envelope_split(df: DataFrame, body: str, content_schema: str) -> tuple[DataFrame, DataFrame]:
    """(well-formed, malformed) messages."""
    parsed = parse_envelope(df, body, content_schema)
    return parsed.where(~F.col("malformed")).drop("malformed"), parsed.where("malformed").select(*df.columns)


def route(df: DataFrame, key: str = "routing_key") -> DataFrame:
    """Queue and exchange of each message; keys without a binding are dropped."""
    queue = F.create_map(*[F.lit(x) for k, (q, _) in ROUTES.items() for x in (k, q)])
    exchange = F.create_map(*[F.lit(x) for k, (_, e) in ROUTES.items() for x in (k, e)])
    return df.withColumns({
        "queue": F.try_element_at(queue, F.col(key)), "exchange": F.try_element_at(exchange, F.col(key)),
    }).where(F.col("queue").isNotNull())


def ttl_drop(df: DataFrame, sent: str, consumed: Column | None = None, ttl_ms: int = MESSAGE_TTL_MS) -> DataFrame:
    """Messages at most ``ttl_ms`` old when consumed (now, unless a column says when)."""
    at = F.current_timestamp() if consumed is None else consumed
    sent_ms = F.unix_millis(F.col(sent).cast("timestamp"))
    return df.where(F.unix_millis(at.cast("timestamp")) - sent_ms <= ttl_ms)


def next_step(notices: DataFrame, key: str, order: list[str]) -> DataFrame:
    """What follows the latest notice of each request."""
    latest = notices.groupBy(key).agg(
        F.max(F.struct(*order, "request_type", "exec_status", "noMaps")).alias("n"),
    )
    failed, run = F.col("n.exec_status") == "ERROR", F.col("n.request_type") == "EXECUTION"
    return latest.select(
        key,
        F.when(failed, "FAILED").when(run & ~F.col("n.noMaps"), "MAP_GENERATION").otherwise("DONE").alias("next_step"),
    )


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process everything available, then stop."""
    q = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def progress_state(spark: SparkSession, state: str, key: str, key_type: str, buckets: int = 64) -> StateTable:
    return StateTable(spark, state, key, T.StructType.fromDDL(f"{key} {key_type}, carry bigint"), buckets)


def progress_stream(events: DataFrame, key: str, ts: str, tie: str, out: str, state: str,
                    checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Running progress per request. ``out/batch=n`` holds the progress rows of a micro-batch, the table ``state`` the
    sum of each run that has not ended (runs without a sum have no row). Events without a numeric
    increment or a text message are dropped; 100 emits and resets the run."""
    spark = events.sparkSession
    valid = events.where(F.col("increment").isNotNull() & F.col("message").isNotNull())
    sums = progress_state(spark, state, key, events.schema[key].dataType.simpleString(), buckets)

    def sink(batch: DataFrame, n: int) -> None:
        with scoped(spark):
            keys = sums.keys(batch)
            kept = stage(sums.before(n, batch, keys), "carry")
            progress_running(batch, key, ts, tie, carry=kept).write.mode("overwrite").parquet(f"{out}/batch={n}")
            sums.write(n, batch, progress_carry(batch, key, ts, tie, kept).where("carry <> 0"), keys)

    return run_available(valid, sink, checkpoint)


def message_stream(messages: DataFrame, content_schema: str, out: str, checkpoint: str, body: str = "body", key: str = "routing_key",
                   sent: str = "sent_at", consumed: Column | None = None, ttl_ms: int = MESSAGE_TTL_MS) -> StreamingQuery:
    """One source of messages into the queues they are bound for.

    A micro-batch is parsed once. Malformed messages go to ``out/malformed``, those that are neither too old nor without a binding to
    ``out/queues`` (a folder per queue), and ``out/counts`` gets a row: received, malformed, expired, unbound and routed, as observed while the batch was written.
    All are folders by batch, which a repeated batch replaces."""
    spark = messages.sparkSession

    def sink(batch: DataFrame, n: int) -> None:
        seen, young, bound = Observation("seen"), Observation("young"), Observation("bound")
        with scoped(spark):
            parsed = parse_envelope(batch, body, content_schema).observe(seen, F.count("*").alias("received"), F.count_if("malformed").alias("malformed"))
            parsed = stage(parsed, "messages")
            fresh = ttl_drop(parsed.where(~F.col("malformed")).drop("malformed"), sent, consumed, ttl_ms).observe(young, F.count("*").alias("n"))
            route(fresh, key).observe(bound, F.count("*").alias("n")).write.mode("overwrite").partitionBy("queue").parquet(f"{out}/queues/batch={n}")
            parsed.where("malformed").select(*batch.columns).write.mode("overwrite").parquet(f"{out}/malformed/batch={n}")
            told = {"received": seen.get["received"], "malformed": seen.get["malformed"], "expired": seen.get["received"] - seen.get["malformed"] - young.get["n"],
                    "unbound": young.get["n"] - bound.get["n"], "routed": bound.get["n"]}
            spark.range(1).select(*[F.lit(v).cast("bigint").alias(c) for c, v in told.items()]).write.mode("overwrite").parquet(f"{out}/counts/batch={n}")

    return run_available(messages, sink, checkpoint)


FORMATION_ROWS = "time int, max_id int, min1_id int, min2_id int, type string, folder int"


def detect_stream(slices: DataFrame, spec: GridSpec, out: str, checkpoint: str) -> StreamingQuery:
    """Formations of every arriving instant, in folders of neighbouring instants.

    A batch merges its instants into their folders: rows of other instants there are kept, those of its own replaced, and only these folders are
    rewritten, so a repeated batch or instant gives the same table and files follow the data. An instant has one more row, without ids, so that one sent again without formations loses
    its old ones; ``read_formations`` leaves these rows out."""
    from isohypsa.operators.extrema import lattice_stencil
    from isohypsa.plans.detect import cluster_extrema

    geometry = lattice_stencil(slices.sparkSession, spec)  # the same for every batch

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        with scoped(spark):
            found = cluster_extrema(None, spec, slices=batch, staged=True, geometry=geometry).formations()
            seen = stage(batch.select("time").distinct().withColumn("folder", folder_of(F.col("time"))), "arrived")
            rows = found.withColumn("folder", folder_of(F.col("time"))).unionByName(seen, allowMissingColumns=True)
            if exists(spark, out):
                old = spark.read.schema(FORMATION_ROWS).parquet(out)
                rows = rows.unionByName(old.join(seen.select("folder").distinct(), "folder", "left_semi").join(seen.select("time"), "time", "left_anti"))
            # written aside first: its folders are read until then
            merged = stage(rows, "merged").repartitionByRange("folder", "time").sortWithinPartitions("folder", "time", "max_id")
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(out)

    return run_available(slices, sink, checkpoint)


def read_formations(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(FORMATION_ROWS).parquet(out).where(F.col("max_id").isNotNull()).drop("folder")


def catalogue_stream(messages: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame | dict[str, DataFrame]], root: str,
                     initial: DataFrame, checkpoint: str, key: str = "requestHash", buckets: int = 64) -> StateTable:
    """Fold batches of messages into a catalogue, the table ``root/catalogue``, which is returned. ``initial`` is written by the first start
    only. ``merge`` sees a batch and the rows of its keys and gives their new form, or a dict with it as
    ``catalogue`` beside other tables of the batch (links, messages to send on), which are written to ``root/<name>/batch=<n>``."""
    spark = messages.sparkSession
    table = StateTable(spark, f"{root}/catalogue", key, initial.schema, buckets)
    table.create(initial)

    def sink(batch: DataFrame, n: int) -> None:
        with scoped(spark):
            keys = table.keys(batch)
            made = merge(batch, stage(table.before(n, batch, keys), "known"))
            made = made if isinstance(made, dict) else {"catalogue": made}
            for name, rows in made.items():
                if name != "catalogue":
                    rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={n}")
            table.write(n, batch, made["catalogue"], keys)

    run_available(messages, sink, checkpoint)
    return table
