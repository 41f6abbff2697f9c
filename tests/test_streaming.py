"""Streams run to exhaustion over files and compared with their batch forms."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from isohypsa.operators import catalogue as K
from isohypsa.plans.detect import detect_blocking
from isohypsa.registry.inputs import SPEC, synth_field
from isohypsa.sources.grid import to_slices
from isohypsa.staging import exists, scoped, scratch_path, stage
from isohypsa.streaming import messages as Z
from isohypsa.streaming.state import StateTable


def test_envelope_stream_splits(spark):
    base = scratch_path(spark, "s")
    rows = [(n, '{"status": "OK", "content": {"increment": %d}}' % n if n % 3 else "{bad") for n in range(30)]
    spark.createDataFrame(rows, "id long, body string").write.parquet(f"{base}/in")

    def sink(batch, n):
        good, bad = Z.envelope_split(batch, "body", "increment bigint")
        good.select("id", "content.increment").write.mode("overwrite").parquet(f"{base}/good/b={n}")
        bad.write.mode("overwrite").parquet(f"{base}/bad/b={n}")

    Z.run_available(spark.readStream.schema("id long, body string").parquet(f"{base}/in"), sink, f"{base}/cp")
    assert {r.id for r in spark.read.parquet(f"{base}/good").collect()} == {n for n in range(30) if n % 3}
    assert spark.read.parquet(f"{base}/bad").count() == 10


def test_routes_and_ttl(spark):
    df = spark.createDataFrame([("config.create",), ("nowhere",)], "routing_key string")
    assert [(r.queue, r.exchange) for r in Z.route(df).collect()] == [("config_queue", "requests_exchange")]
    t = spark.createDataFrame([(1, 0), (2, 5000), (3, 5001)], "id int, age int").select(
        "id", F.timestamp_millis(F.lit(1_000_000)).alias("sent"), F.timestamp_millis(F.lit(1_000_000) + F.col("age")).alias("seen"))
    assert {r.id for r in Z.ttl_drop(t, "sent", F.col("seen")).collect()} == {1, 2}
    old = t.select("id", "sent")
    assert Z.ttl_drop(old, "sent").isEmpty()


def test_next_step(spark):
    rows = [(1, 1, "EXECUTION", "OK", False), (2, 1, "EXECUTION", "OK", True), (3, 1, "EXECUTION", "ERROR", False),
            (4, 1, "EXECUTION", "OK", False), (4, 2, "VISUALIZATION", "OK", False), (5, 1, "VISUALIZATION", "ERROR", False)]
    df = spark.createDataFrame(rows, "k int, t int, request_type string, exec_status string, noMaps boolean")
    got = {r.k: r.next_step for r in Z.next_step(df, "k", ["t"]).collect()}
    assert got == {1: "MAP_GENERATION", 2: "DONE", 3: "FAILED", 4: "DONE", 5: "FAILED"}


def test_detect_stream_equals_batch_and_repeats(spark):
    base = scratch_path(spark, "d")
    params = spark.range(3).select(F.col("id").cast("int").alias("time"), F.lit(5).cast("bigint").alias("s"))
    field = synth_field(params, SPEC)
    to_slices(field, SPEC).repartition(3).write.parquet(f"{base}/in")
    want = sorted(map(tuple, detect_blocking(field, SPEC).collect()))
    for run in range(2):
        src = spark.readStream.schema("time int, vals array<int>").option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
        Z.detect_stream(src, SPEC, f"{base}/out", f"{base}/cp{run}")
        got = Z.read_formations(spark, f"{base}/out").select("time", "max_id", "min1_id", "min2_id", "type").collect()
        assert sorted(map(tuple, got)) == want and len(want) == 3


def test_admission_stream_over_batches(spark):
    base = scratch_path(spark, "a")
    cat = spark.createDataFrame([("a", "CACHED", 1), ("b", "GENERATING", 1)], "requestHash string, requestStatus string, timesRequested long")
    schema = "requestHash string, userId long, arrival long"
    for n, h in enumerate(["a", "n", "a", "n"]):
        spark.createDataFrame([(h, n, n)], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    cols = ["requestHash", "requestStatus", "timesRequested"]
    def admit(b, c):
        return {"catalogue": K.admit_requests(b, c).select(*cols), "links": K.admission_links(b, c)}

    def start():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        return {tuple(r) for r in Z.catalogue_stream(source, admit, f"{base}/cat", cat, f"{base}/cp").current().collect()}

    want = {("a", "CACHED", 3), ("b", "GENERATING", 1), ("n", "GENERATING", 1)}
    assert start() == want
    assert start() == want  # a second start without new files
    spark.createDataFrame([("b", 9, 9), ("a", 9, 9)], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    assert start() == {("a", "CACHED", 4), ("b", "GENERATING", 1), ("n", "GENERATING", 1)}
    links = {(r.user_id, r.requestHash) for r in spark.read.parquet(f"{base}/cat/links").collect()}
    assert links == {(0, "a"), (2, "a"), (9, "a"), (1, "n")}


def test_progress_state_is_pruned_and_survives_a_restart(spark):
    base = scratch_path(spark, "p")
    schema = "k long, t timestamp, n long, increment long, message string"
    source = lambda: spark.readStream.schema(schema).parquet(f"{base}/in")
    send = lambda rows: spark.createDataFrame(rows, "k long, n long, increment long").select(
        "k", F.timestamp_seconds("n").alias("t"), "n", "increment", F.lit("m").alias("message")).coalesce(1).write.mode("append").parquet(f"{base}/in")
    send([(1, 1, 5), (2, 2, 7), (1, 3, 100)])
    for rows in ([], [(2, 4, 3), (1, 5, 2)]):
        if rows:
            send(rows)
        Z.progress_stream(source(), "k", "t", "n", f"{base}/out", f"{base}/state", f"{base}/cp")
    got = {r.n: r.progress for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {1: 20, 2: 28, 3: 100, 4: 40, 5: 8}
    sums = Z.progress_state(spark, f"{base}/state", "k", "bigint")
    assert {(r.k, r.carry) for r in sums.current().collect()} == {(2, 10), (1, 2)}
    assert {(r.k, r.carry) for r in sums.before(1, spark.range(9).withColumnRenamed("id", "k")).collect()} == {(2, 7)}


def state_of(spark, buckets=64):
    return StateTable(spark, scratch_path(spark, "b"), "id", T.StructType.fromDDL("id bigint, v int"), buckets)


def test_a_batch_rewrites_the_folders_of_its_keys_only(spark):
    table = state_of(spark)
    full = spark.range(500).withColumn("v", F.lit(0))
    table.create(full)
    table.create(full.where("id < 3"))  # it is there already
    files = lambda: {r.f for r in spark.read.parquet(table.root).select(F.input_file_name().alias("f")).distinct().collect()}
    first, batch = files(), full.where("id < 2")
    assert {r.id for r in table.before(0, batch).collect()} == {0, 1}
    table.write(0, batch, table.before(0, batch).withColumn("v", F.lit(1)))
    assert table.current().agg(F.count("*"), F.sum("v")).first()[:] == (500, 2)
    assert 0 < len(first - files()) <= 2
    table.write(1, batch, batch.limit(0))  # both lose their values
    assert table.current().count() == 498


def test_a_repeated_batch_starts_from_the_same_values(spark):
    table = state_of(spark, 4)
    add = lambda n, ids, by: table.write(n, b := spark.createDataFrame([(i,) for i in ids], "id bigint"), b.distinct().join(table.before(n, b), "id", "left").select("id", (F.coalesce("v", F.lit(0)) + by).alias("v")))
    now = lambda: {r.id: r.v for r in table.current().collect()}
    assert now() == {}
    add(0, [1, 2], 5)
    add(1, [2, 3, 3], 7)
    assert now() == {1: 5, 2: 12, 3: 7}
    for _ in range(2):
        add(1, [2, 3, 3], 7)
        assert now() == {1: 5, 2: 12, 3: 7}
    add(1, [2], 7)  # as if it had broken off before the folder of 3
    assert now() == {1: 5, 2: 12, 3: 7}
    add(2, [1, 2], 1)
    assert now() == {1: 6, 2: 13, 3: 7}


def test_an_instant_sent_again_without_formations_loses_its_old_ones(spark):
    base = scratch_path(spark, "r")
    params = spark.range(2).select(F.col("id").cast("int").alias("time"), F.lit(5).cast("bigint").alias("s"))
    field = synth_field(params, SPEC)
    to_slices(field, SPEC).coalesce(1).write.parquet(f"{base}/in")
    source = lambda: spark.readStream.schema("time int, vals array<int>").parquet(f"{base}/in")
    Z.detect_stream(source(), SPEC, f"{base}/out", f"{base}/cp")
    assert {r.time for r in Z.read_formations(spark, f"{base}/out").collect()} == {0, 1}
    to_slices(field.where("time = 1").withColumn("h", F.lit(5000)), SPEC).coalesce(1).write.mode("append").parquet(f"{base}/in")
    Z.detect_stream(source(), SPEC, f"{base}/out", f"{base}/cp")
    assert {r.time for r in Z.read_formations(spark, f"{base}/out").collect()} == {0}


def test_scopes_delete_their_own_tables_only(spark):
    outer = stage(spark.range(3), "outer")
    with scoped(spark) as staged:
        inner = stage(spark.range(4), "inner")
        assert inner.count() == 4 and len(staged) == 1
    assert not exists(spark, staged[0]) and outer.count() == 3
