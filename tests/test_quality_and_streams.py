import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldweave import config
from fieldweave.errors import DataAccessError, FieldweaveError, ProcessingError, ValidationError
from fieldweave.operators import quality_checks as checks
from fieldweave.operators.positions import with_positions
from fieldweave.streaming import streams


def test_error_text():
    e = DataAccessError("CODE", "went wrong", {"path": "p"}, ValueError("why"))
    assert str(e) == "[CODE] went wrong | context={'path': 'p'} | cause=why"
    assert str(ProcessingError("C", "m")) == "[C] m" and isinstance(e, FieldweaveError)


def test_settings(monkeypatch):
    monkeypatch.setenv("FIELDWEAVE_STORE_DIR", "/x")
    assert str(config.store_dir()) == "/x" and config.default_model() == "rules"
    monkeypatch.delenv("FIELDWEAVE_API_KEY", raising=False)
    with pytest.raises(ValidationError, match="MISSING_API_KEY"):
        config.api_key()


def test_rates_and_spikes(spark):
    df = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", None), ("d2", 3), ("d3", None), ("d3", None)], "day string, x int")
    rates = checks.null_rates(df, [F.col("day")], ["x"])
    assert {(r["_g0"], r["n"], r["nulls"], r["rate"]) for r in rates.collect()} == {("d1", 2, 0, 0.0), ("d2", 2, 1, 0.5), ("d3", 2, 2, 1.0)}
    assert {r["_g0"] for r in checks.rate_spikes(rates, "_g0", 0.4).collect()} == {"d2", "d3"}


def test_unknown_fields_with_bad_json(spark):
    df = spark.createDataFrame([("a", '{"k": 1, "new": 2}'), ("a", "broken"), ("b", None)], "kind string, props string")
    known = spark.createDataFrame([("a", "k")], "kind string, field_name string")
    assert [tuple(r) for r in checks.unknown_fields(df, "props", known, "kind").collect()] == [("a", "new", 1)]


def test_time_sizes(spark):
    df = spark.createDataFrame([(1_700_000_000,), (1_700_000_000_123,), (1_700_000_000_123_456,), (1_700_000_000_123_456_789,), (None,)], "t bigint")
    assert [tuple(r) for r in df.select(checks.time_precision(F.col("t")), checks.epoch_millis(F.col("t"))).collect()][:4] == [("s", 1_700_000_000_000), ("ms", 1_700_000_000_123), ("us", 1_700_000_000_123), ("ns", 1_700_000_000_123)]


def test_whole_milliseconds_stay(spark):
    """As doubles, nanoseconds of these times are a little less than they are."""
    millis = [1_706_209_621_954, 1_706_303_126_426, *range(1_704_067_200_000, 1_704_067_204_000)]
    rows = [(sign * (m * 10**digits + rest), sign * m) for m in millis for digits, rest in ((0, 0), (3, 0), (6, 0), (3, 999), (6, 999_999)) for sign in (1, -1)]
    df = spark.createDataFrame(rows, "t bigint, ms bigint").withColumn("got", checks.epoch_millis(F.col("t")))
    assert df.schema["got"].dataType.simpleString() == "bigint"
    assert df.where("not got <=> ms").collect() == []
    doubles = spark.createDataFrame([(1.7e9,), (1_700_000_000_123_999.0,)], "t double").select(checks.epoch_millis(F.col("t")))
    assert [r[0] for r in doubles.collect()] == [1_700_000_000_000, 1_700_000_000_123]


def test_times_equal_their_sql(spark, tmp_path):
    """Whole milliseconds, seconds and the microseconds beside them, before and after 1970, in all four precisions."""
    import duckdb

    from fieldweave.plans import queries as core

    at = "TIMESTAMP '1970-01-01' + to_microseconds((CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * (200000000000 + k * 1234567) * 1000 + d)"
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE TABLE events AS SELECT row_number() OVER () - 1 AS event_id, {at} AS ts FROM range(500) a(k), (VALUES (0), (-1), (1), (500)) b(d), range(4) c(residue) ORDER BY residue, k, d")
    con.execute("UPDATE events SET event_id = event_id * 4 + event_id // 2000")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    want = con.execute(core.oracle_sql()["time_normalization"]).fetchall()
    got = core.queries()["time_normalization"](spark, str(tmp_path)).collect()
    assert len({r[0] % 4 for r in want}) == 4 and len(want) == 8000
    assert sorted(map(tuple, got)) == sorted(want)


def test_stability_of_shifted_values(spark):
    rows = [(1, float(v)) for v in range(100)] + [(2, float(v)) for v in range(100)] + [(3, 95.0)] * 100
    shares = checks.distribution(spark.createDataFrame(rows, "p int, v double"), F.col("p"), "v", [25.0, 50.0, 75.0])
    psi = {r["period"]: r["psi"] for r in checks.stability_index(shares).collect()}
    assert abs(psi[2]) < 1e-9 and psi[3] > 1


def test_names_types_and_validation(spark):
    df = spark.createDataFrame([(1, None, "u1", "7"), (2, "n2", "u2", "x"), (3, None, None, None)], "id int, user_name string, username string, n string")
    named = checks.reconcile_names(df, {"user": ["user_name", "username", "uid"]})
    assert named.columns == ["id", "n", "user"] and [r["user"] for r in named.orderBy("id").collect()] == ["u1", "n2", None]
    good, bad = checks.validate(named, ["user"], {"n": "bigint"})
    assert [r["id"] for r in good.collect()] == [1]
    assert {(r["id"], tuple(r["reasons"])) for r in bad.collect()} == {(2, ("type of n",)), (3, ("missing user",))}


def test_repairs_in_rounds(spark):
    df = spark.createDataFrame([(1, "a", "7"), (2, "b", "x8"), (3, None, "x9"), (4, None, "?"), (5, "c", None)], "id int, user string, n string")
    strip = lambda d: d.withColumn("n", F.regexp_replace("n", "^x", ""))
    fill = lambda d: d.withColumn("user", F.coalesce("user", F.lit("nobody")))
    good, bad = checks.repair(df, ["user"], {"n": "bigint"}, [strip, fill])
    assert {tuple(r) for r in good.collect()} == {(1, "a", 7, 0), (2, "b", 8, 1), (3, "nobody", 9, 2), (5, "c", None, 0)}
    assert [tuple(r) for r in bad.collect()] == [(4, None, "?", ["type of n"])]
    assert checks.repair(df, ["user"], {"n": "bigint"}, [])[1].count() == 3


def test_range_join(spark):
    rows = spark.createDataFrame([(1, 5), (2, 1500), (3, 99999), (4, None)], "id int, ip bigint")
    ranges = spark.createDataFrame([(0, 10, "a"), (1000, 3500, "b")], "lo bigint, hi bigint, owner string")
    assert {(r["id"], r["owner"]) for r in checks.enrich_by_range(rows, "ip", ranges, "lo", "hi", 1000).collect()} == {(1, "a"), (2, "b"), (3, None), (4, None)}


def test_positions(spark):
    df = spark.createDataFrame([(k * 37 % 1000, k) for k in range(1000)] + [(None, -1)], "x int, k int").repartition(6)
    placed = with_positions(df, "x", ("k",)).collect()
    assert sorted(r["position"] for r in placed) == list(range(1001))
    assert all(r["position"] == (0 if r["x"] is None else r["x"] + 1) for r in placed)


@pytest.fixture
def events(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(minutes=7 * k), k % 3, "ab"[k % 2], float(k % 10) if k % 11 else None) for k in range(500)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")
    df.repartition(3).write.parquet(str(tmp_path / "in" / "events.parquet"))
    return df, str(tmp_path / "in" / "events.parquet")


def test_streams_equal_batches(spark, events, tmp_path):
    df, folder = events
    stream = lambda: streams.timed(streams.read_events(spark, folder, df.schema))
    counted = streams.run_to_end(streams.counts(stream(), ["event_type"], "value"), f"{tmp_path}/counts", "complete")
    assert counted.agg(F.sum("n")).first()[0] == 500
    rates = streams.run_to_end(streams.null_rates(stream(), ["value"]), f"{tmp_path}/rates", "complete")
    assert rates.count() == 3
    runs = streams.run_to_end(streams.sessions(stream(), "user_id", gap="10 minutes"), f"{tmp_path}/sessions", "complete")
    assert runs.count() == 500
    assert streams.run_to_end(streams.without_duplicates(stream(), ["event_type"]), f"{tmp_path}/dup").count() == 2


def test_drift_is_the_same_in_any_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=20 * k), "ab"[k % 2], (float(k % 10) if k // 72 != 6 else 30.0) if k % 11 else None) for k in range(900)]
    schema = "ts timestamp_ntz, event_type string, value double"
    for k in range(5):  # files in the order of time
        spark.createDataFrame(rows[180 * k : 180 * k + 180], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / "events.parquet"))
    seen = []
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, (per_trigger, arrow) in enumerate(((None, 10_000), (None, 3), (1, 500), (2, 1))):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow)
        try:
            stream = streams.timed(streams.read_events(spark, str(tmp_path / "in" / "events.parquet"), spark.createDataFrame([], schema).schema, per_trigger=per_trigger))
            seen.append(sorted((tuple(r) for r in streams.run_to_end(streams.drift(stream, "event_type", "value"), f"{tmp_path}/out{k}").collect()), key=str))
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert seen[0] == seen[1] == seen[2] == seen[3]
    first, strays = [r for r in seen[0] if r[5] is None], [r for r in seen[0] if r[6]]
    assert len(first) == 2 and {r[0] for r in strays} >= {start + dt.timedelta(days=6)} and all(r[0] >= start + dt.timedelta(days=6) for r in strays)
    assert {r[0] for r in seen[0]} == {start + dt.timedelta(days=k) for k in range(12)}  # the last day is still open


def test_routing(spark, events, tmp_path):
    df, folder = events
    alerts = []
    q = streams.route(streams.read_events(spark, folder, df.schema), tmp_path / "out", str(tmp_path / "check"), ["value"], {"user_id": "bigint"}, "event_type", lambda n, share: alerts.append(share))
    q.awaitTermination()
    clean, dead = spark.read.parquet(str(tmp_path / "out" / "clean")), spark.read.parquet(str(tmp_path / "out" / "dead_letters"))
    missing = df.where("value is null").count()
    assert clean.count() == 500 - missing and dead.count() == missing
    scores = spark.read.parquet(str(tmp_path / "out" / "scores"))
    assert scores.agg(F.sum("n"), F.sum("rejected")).first() == (500, missing) and scores.count() == 2
    assert len(alerts) == 1 and abs(alerts[0] - missing / 500) < 1e-9
