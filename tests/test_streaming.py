"""Streams over files, run to their end."""

import datetime as dt
import time

from tessera.streaming import state

T0 = dt.datetime(2024, 1, 1)


def run(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    for _ in range(200):  # processing-time timeouts ask for empty batches for ever, so nothing ends by itself
        if q.exception() or spark.table(name).count():
            break
        time.sleep(0.2)
    q.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def test_rate_limit_and_memory(spark, tmp_path):
    calls = spark.createDataFrame([("k", T0 + dt.timedelta(seconds=s)) for s in (0, 1, 2, 61)] + [(None, T0)], "key string, ts timestamp")
    calls.coalesce(1).write.parquet(str(tmp_path / "c"))
    got = run(spark, state.stream_rate_limited(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "c")), "key", "ts", 2, 60), "calls", "append")
    assert sorted((r[1].second + 60 * r[1].minute, r[2]) for r in got) == [(0, True), (1, True), (2, False), (61, True)]
    turns = spark.createDataFrame([(i, " S") for i in range(5)] + [(9, None)], "id long, session_id string")
    turns.coalesce(1).write.parquet(str(tmp_path / "t"))
    got = run(spark, state.stream_session_memory(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "t")), 3), "turns", "update")
    assert got == [("s", [2, 3, 4])]


def test_counts_and_upsert(spark, tmp_path):
    e = spark.createDataFrame([(T0, "a", 1.0), (T0 + dt.timedelta(minutes=1), "a", 2.0), (T0 + dt.timedelta(hours=2), "b", 1.0)], "ts timestamp, event_type string, value double")
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    got = run(spark, state.stream_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))), "counts", "append")
    assert [(r[1], r[2], r[3]) for r in got] == [("a", 2, 3.0)]
    sink = state.upsert_newest(str(tmp_path / "u"), "k", "at")
    rows = lambda *x: spark.createDataFrame(list(x), "k string, at int, v string")
    sink(rows(("a", 1, "x"), ("b", 1, "y")), 0)
    sink(rows(("a", 2, "z"), ("b", 0, "old")), 1)
    assert sorted(tuple(r) for r in state.read_upserted(spark, str(tmp_path / "u")).select("k", "at", "v").collect()) == [("a", 2, "z"), ("b", 1, "y")]
    sink(rows(("a", 2, "z"), ("b", 0, "old")), 1)  # a batch that is done again changes nothing
    sink(rows(("c", 1, "n"), (None, 1, "n")), 2)
    assert sorted(r["k"] for r in state.read_upserted(spark, str(tmp_path / "u")).collect()) == ["a", "b", "c"]
    assert state.read_upserted(spark, str(tmp_path / "none")) is None
