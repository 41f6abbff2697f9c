"""Catalogue functions against plain Python, and their edge cases."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from isohypsa.functions import text as X
from isohypsa.operators import catalogue as K
from isohypsa.staging import scoped

REQUEST = ("requestHash string, variableName string, pressureLevels array<string>, years array<string>, months array<string>, "
           "days array<string>, hours array<string>, areaCovered array<string>, mapTypes array<string>, mapLevels array<string>, "
           "fileFormat string, noData boolean, noMaps boolean, omp boolean, mpi boolean, nThreads int, nProces int")


def request(**over):
    base = dict(
        requestHash="h", variableName="geopotential", pressureLevels=["500"], years=["2019"], months=["6"], days=["26"],
        hours=["0", "12"], areaCovered=["90", "-180", "0", "180"], mapTypes=["cont"], mapLevels=["20"], fileFormat="svg",
        noData=False, noMaps=False, omp=True, mpi=None, nThreads=4, nProces=None)
    base.update(over)
    return base


def frame(spark, *rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], REQUEST)


def expected_hash(r):
    out = {}
    for k in X.HASH_KEYS:
        v = r[k]
        if v is None:
            continue
        if isinstance(v, list):
            try:
                v = sorted(v, key=lambda e: float(e) if e.strip() else 0.0)
            except ValueError:
                v = sorted(v, key=lambda e: (e.lower(), e.swapcase()))
        out[k] = v
    return hashlib.sha256(json.dumps(out, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_request_hash(spark):
    rows = [
        request(), request(hours=["12", "0"]), request(pressureLevels=["1000", "500", "850"]),
        request(mapTypes=["forms", "Cont", "cont", "3d"]), request(fileFormat=None, mapLevels=None), request(days=[]),
        request(variableName='quo"te\\é'), request(days=["05", "5", "", "10"]),
    ]
    got = [r.requestHash for r in X.with_request_hash(frame(spark, *rows)).collect()]
    assert got == [expected_hash(r) for r in rows]
    assert got[0] == got[1] != got[2]


@pytest.mark.parametrize("values,text", [
    (["1", "2", "3", "5", "7", "8"], "01-03-05-07-08"), (["4"], "04"), ([], ""), (["3", "3"], "03-03"), (["10", "9"], "09-10"),
])
def test_compact_ranges(spark, values, text):
    df = spark.createDataFrame([(values,)], "v array<string>")
    assert df.select(X.compact_ranges(F.col("v")).alias("t")).collect()[0].t == text


def test_source_file_name(spark):
    df = frame(spark, request(pressureLevels=["500", "850"], days=["1", "2", "3"], hours=["0", "6"]))
    assert df.select(X.source_file_name().alias("f")).collect()[0].f == (
        "/fields/geopotential_500-850hPa_2019-06-(01-03)_00-06UTC.nc")


def test_instant_dates(spark):
    rows = [("z_2003-08-01_15_00-06-12-18UTC", 5), ("z_2003-08-28_31_00-12UTC", 7), ("z_2019-06-26_00UTC", 7)]
    df = spark.createDataFrame(rows, "n string, t int").select(X.instant_date_from_name(F.col("n"), F.col("t")).alias("d"))
    assert [r.d for r in df.collect()] == ["2003-08-02_06UTC", "2003-08-31_12UTC", "2019-06-26_07UTC"]


def test_envelopes(spark):
    inner = {"increment": 3, "message": "m"}
    bodies = [
        json.dumps({"status": "OK", "message": "", "content": inner}),
        json.dumps({"status": "OK", "message": "", "content": json.dumps(inner)}),
        json.dumps({"status": "OK", "message": ""}), '{"status": "OK", "con', "nonsense",
        json.dumps({"status": "OK", "content": "not json"}),
    ]
    df = X.parse_envelope(spark.createDataFrame([(b,) for b in bodies], "body string"), "body", "increment bigint, message string")
    got = [(r.malformed, r.content.increment if not r.malformed else None) for r in df.collect()]
    assert got == [(False, 3), (False, 3), (False, None), (True, None), (True, None), (True, None)]
    built = spark.range(1).select(X.build_envelope(F.lit("OK"), F.lit("m"), F.struct(F.lit(1).alias("a"))).alias("b")).collect()[0].b
    assert json.loads(built) == {"status": "OK", "message": "m", "content": {"a": 1}}


def test_urls_and_types(spark):
    from urllib.parse import quote
    names = ["a b.PNG", "x(1)!'*~+&.csv", "é#?.nc", "plain", "c.tar.pdf"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(
        "n", X.encode_component(F.col("n")).alias("e"), X.content_type(F.col("n")).alias("m"), X.file_kind(F.col("n")).alias("k"))
    for r in df.collect():
        assert r.e == quote(r.n, safe="!'()*~-_.")
    assert [r.m for r in df.collect()] == ["image/png", "text/csv", "application/x-netcdf", "application/octet-stream", "application/pdf"]
    assert [r.k for r in df.collect()] == ["image", "data", "data", "data", "image"]


def test_validation(spark):
    rows = [
        request(), request(variableName="", days=[], hours=None), request(areaCovered=["90", "0", "0"]),
        request(areaCovered=["91", "10", "0", "180"]), request(areaCovered=["90", "x", "0", "180"]),
        request(areaCovered=["90", "-180", "1", "200"]), request(areaCovered=["90", "-180", "0", "200"]),
    ]
    got = [r.violations for r in K.validate_requests(frame(spark, *rows)).collect()]
    assert got == [
        [], ["variableName required", "days required", "hours required"], ["invalid coordinates"],
        ["invalid North coordinate"], ["invalid West coordinate"], ["invalid South coordinate"], ["invalid East coordinate"],
    ]
    assert K.unexpected_columns(frame(spark, request()).withColumn("x", F.lit(1)), (*X.CONFIG_KEYS,)) == ["x"]


def test_calendar_and_defaults(spark):
    days = [str(d) for d in range(1, 32)]
    rows = [request(years=["2019"], months=["2"], days=days), request(years=["2019", "2020"], months=["2"], days=days),
            request(years=["2019"], months=["2", "4"], days=days), request(years=[], days=days)]
    got = [len(r.valid_days) for r in K.calendar_filter(frame(spark, *rows)).collect()]
    assert got == [28, 29, 30, 0]
    rows = [request(variableName="Temperature", mapLevels=[], mapTypes=["disp"]), request(mapLevels=None), request(mapLevels=["30"])]
    got = [(r.mapLevels, r.mapTypes) for r in K.request_defaults(frame(spark, *rows)).collect()]
    assert got == [(["10"], ["cont"]), (["20"], ["cont"]), (["30"], ["cont"])]


def test_grouping_ignores_hours_and_later_days(spark):
    rows = [request(requestHash=f"h{n}", **o) for n, o in enumerate([
        {}, {"hours": ["6"]}, {"days": ["26", "27"]}, {"days": ["27"]}, {"pressureLevels": ["500", "850"]}, {"pressureLevels": ["850", "500"]},
    ])]
    df = frame(spark, *rows).withColumn("updatedAt", F.timestamp_seconds(F.substring("requestHash", 2, 1).cast("int")))
    got = {(r.requestHash, r["count"]) for r in K.group_requests(df).collect()}
    assert got == {("h2", 3), ("h3", 1), ("h4", 1), ("h5", 1)}


def test_admission(spark):
    cat = spark.createDataFrame([("a", "CACHED", 2), ("b", "GENERATING", 1), ("c", "EMPTY", 1)], "requestHash string, requestStatus string, timesRequested long")
    inc = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 3, 2), ("d", 5, 4), ("d", 4, 3)], "requestHash string, userId long, arrival long")
    got = {r.requestHash: tuple(r)[1:] for r in K.admit_requests(inc, cat).collect()}
    assert got == {
        "a": ("CACHED", 4, 0, True, "CACHED"), "b": ("GENERATING", 1, 1, False, "PROCESSING"),
        "c": ("EMPTY", 1, 0, False, None), "d": ("GENERATING", 1, 2, False, "PROCESSING"),
    }
    assert {tuple(r) for r in K.admission_links(inc, cat).collect()} == {(1, "a"), (2, "a"), (4, "d")}


def test_user_upsert(spark):
    users = spark.createDataFrame([(1, "A", "a@x", "user"), (2, "B", "b@x", "admin")], "id long, name string, email string, role string")
    inc = spark.createDataFrame([(1, "", "b@x", None), (2, "BB", None, None), (3, "C", "c@x", None), (4, "D", "c@x", None), (5, "E", "a@x", None)],
                                "id long, name string, email string, role string")
    merged, rejected = K.user_upsert(inc, users)
    assert {tuple(r) for r in merged.collect()} == {(1, "A", "a@x", "user"), (2, "BB", "b@x", "admin"), (3, "C", "c@x", "user")}
    assert {r.id for r in rejected.collect()} == {1, 4, 5}


def test_expiry_keeps_the_rest(spark):
    f = spark.createDataFrame([("a", ["x", "y"], 1), ("b", ["z"], 5), ("c", ["w"], None)], "requestHash string, files array<string>, e int")
    rows = K.file_rows(f).withColumn("expiresAt", F.timestamp_seconds("e"))
    gone, kept = K.expire_files(rows, F.timestamp_seconds(F.lit(3)))
    assert {r.file for r in gone.collect()} == {"x", "y"} and {r.file for r in kept.collect()} == {"z", "w"}


def test_hot_key_positions(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(9)}", n, rnd.randrange(50)) for n in range(2000)]
    rows += [(None, 3000 + n, n % 4) for n in range(20)] + [("hot", 4000 + n, None) for n in range(5)]
    df = spark.createDataFrame(rows, "k string, id long, v long")
    order = [F.col("v"), F.col("id")]
    want = {}
    for k in {r[0] for r in rows}:
        for n, (_, i) in enumerate(sorted((-1 if v is None else v, i) for kk, i, v in rows if kk == k)):
            want[i] = n
    assert {r.id: r.n for r in K.position_within(df, ["k"], F.floor(F.col("v") / 7), order, "n").collect()} == want
    assert {r.id: r.n for r in K.position_by_range(df.repartition(3), ["k"], order, "n").collect()} == want
    assert K.position_by_range(df.limit(0), ["k"], order, "n").columns == ["k", "id", "v", "n"]


def test_hot_key_fills_several_ranges(spark):
    with scoped(spark) as staged:
        one = spark.range(4000).select(F.lit("k").alias("k"), F.pmod(F.col("id") * 7919, F.lit(4000)).alias("v"))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = K.position_by_range(one, ["k"], [F.col("v")], "n")
            assert spark.read.parquet(staged[0]).select("_range").distinct().count() > 2
            assert got.where("n <> v").count() == 0
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def running(events, state):
    out = []
    for k, _, tie, inc in events:
        if not 0 <= inc <= 100:
            continue
        state[k] = 0 if inc == 100 else state.get(k, 0) + inc
        out.append((k, tie, 100 if inc == 100 else min(100, 4 * state[k])))
    return out


def test_progress_against_loop_with_carry(spark):
    rnd = random.Random(11)
    schema = "k long, sec long, tie long, increment long"
    state, carry = {}, None
    for batch in range(3):
        ev = sorted(
            ((rnd.choice([0, 0, 0, rnd.randrange(5)]), batch * 10_000 + rnd.randrange(9_000), batch * 1000 + n,
              rnd.choice([1, 2, 3, 100, -1, 101, 0, 4])) for n in range(400)),
            key=lambda e: (e[1], e[2]))
        want = sorted(running(ev, state))
        df = spark.createDataFrame(ev, schema).withColumn("ts", F.timestamp_seconds("sec"))
        got = K.progress_running(df, "k", "ts", "tie", blocks=7, carry=carry)
        assert sorted((r.k, r.tie, r.progress) for r in got.collect()) == want
        carry = spark.createDataFrame([tuple(r) for r in K.progress_carry(df, "k", "ts", "tie", carry).collect()], "k long, carry long")
        # a run that has just ended may be absent: its carry is zero
        assert {r.k: r.carry for r in carry.collect() if r.carry} == {k: v for k, v in state.items() if v}


def test_nearest_runs(spark):
    rows = [("d", n, a) for n, a in enumerate([5, -1, 3, 1, 9])] + [("e", 9, 4)]
    df = spark.createDataFrame(rows, "d string, id int, age int")
    got = [(r.d, r.id, r.rank) for r in K.nearest_runs(df, "d", "age", "id").orderBy("d", "rank").collect()]
    assert got == [("d", 1, 1), ("d", 3, 2), ("d", 2, 3), ("e", 9, 1)]


def test_sorted_json_takes_both_roads_alike(spark):
    from isohypsa.functions.text import sort_numeric_or_text, sorted_json
    rows = [(x,) for x in (["10", "2"], ["02", "01"], ["b", "a"], ["b", "A"], ["a", None], ["01", None], [], [""], ["x"], None, ["a\x1fb", "a"], ["1e3", "20"])]
    df = spark.createDataFrame(rows, "a array<string>")
    got = df.select(sorted_json(F.col("a")).alias("x"), F.to_json(sort_numeric_or_text(F.col("a"))).alias("y")).collect()
    assert [r.x for r in got] == [r.y for r in got]
