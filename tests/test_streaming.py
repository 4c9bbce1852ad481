import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from maskweave.functions.ruleset import builtin_ruleset
from maskweave.operators import rewrite as rw
from maskweave.operators import vault as va
from maskweave.streaming import streams

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rules(spark):
    return builtin_ruleset(spark, ["ipv4"])


def put(spark, path, rows, schema="k long, text string"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def folder():
    return tempfile.mkdtemp(prefix="maskweave-stream-")


def test_vault_holds_over_restarts_and_replays(spark, rules):
    path, ckpt = folder() + "/in", folder()
    put(spark, path, [(1, "at 10.0.0.1"), (2, "at 10.0.0.2")])
    streams.stream_anonymize(spark, path, ["k"], "text", rules, ckpt)
    put(spark, path, [(3, "at 10.0.0.2 and 10.0.0.3")])  # a second run on the same checkpoint
    out = streams.stream_anonymize(spark, path, ["k"], "text", rules, ckpt)
    want = {1: "at IP_1", 2: "at IP_2", 3: "at IP_2 and IP_3"}
    assert {r["k"]: r["text"] for r in out.collect()} == want
    log = va.VaultLog(spark, ckpt + "/vault")
    assert log.versions() == [0, 1]
    before = sorted(map(tuple, log.load()[0].select("value", "token").collect()))
    # the last batch is run again, as after a lost driver: same tokens, no row twice
    vault, counters = log.load(before=1)
    res = rw.anonymize(spark.createDataFrame([(3, "at 10.0.0.2 and 10.0.0.3")], "k long, text string"), ["k"], ["text"], rules, vault, counters, batch_id=1)
    log.append(1, res.new_vault, res.counters)
    res.df.write.mode("overwrite").parquet(ckpt + "/out/batch=1")
    assert sorted(map(tuple, log.load()[0].select("value", "token").collect())) == before
    assert {r["k"]: r["text"] for r in spark.read.parquet(ckpt + "/out").collect()} == want and spark.read.parquet(ckpt + "/out").count() == 3
    log.compact()
    assert sorted(map(tuple, log.load()[0].select("value", "token").collect())) == before


def test_vault_log_drops_and_clears(spark):
    log = va.VaultLog(spark, folder() + "/v", buckets=4)
    row = lambda scope, value, token: (scope, value, token, "IP_{index}", "N:IP_{index}", 1, 0, [1])
    count = lambda *c: spark.createDataFrame(list(c), va.COUNTER_SCHEMA)
    log.append(0, spark.createDataFrame([row("a", "x", "IP_1"), row("a", "y", "IP_2"), row("b", "x", "IP_1")], va.VAULT_SCHEMA), count(("a", "IP_{index}", 2), ("b", "IP_{index}", 1)))
    log.append(1, spark.createDataFrame([row("a", "x", "GATEWAY")], va.VAULT_SCHEMA), count(), dropped=spark.createDataFrame([("a", "y")], "scope string, value string"))
    log.append(2, spark.createDataFrame([row("b", "z", "IP_1")], va.VAULT_SCHEMA), count(("b", "IP_{index}", 1)), cleared=None)
    log.append(3, va.empty_vault(spark), count(), cleared=spark.createDataFrame([("b",)], "scope string"))
    pairs, counters = log.load()
    assert sorted(map(tuple, pairs.select("scope", "value", "token").collect())) == [("a", "x", "GATEWAY")]
    assert sorted(map(tuple, counters.collect())) == [("a", "IP_{index}", 2)]
    assert sorted(r["token"] for r in log.load(before=3)[0].collect()) == ["GATEWAY", "IP_1", "IP_1"]
    log.compact(2)
    assert sorted(map(tuple, log.load()[0].select("scope", "value").collect())) == [("a", "x")]
    spark.createDataFrame([row("a", "q", "IP_9")], va.VAULT_SCHEMA).write.parquet(log.path + "/pairs/kind=delta/version=4")  # half written: no counters
    assert log.load()[0].count() == 1


def test_sessions_on_a_stream(spark, rules):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = folder() + "/in"
    schema = "user string, id long, ts timestamp, text string"
    at = lambda m: T0 + dt.timedelta(minutes=m)
    first = [("u", 1, at(0), "10.0.0.1"), ("u", 2, at(10), "10.0.0.2 10.0.0.1"), ("v", 3, at(11), "10.0.0.9")]
    second = [("u", 4, at(25), "10.0.0.2"), ("u", 5, at(90), "10.0.0.2"), ("v", 6, at(91), None)]
    late = [("u", 7, at(3), "10.0.0.7"), ("u", 8, at(100), "10.0.0.8")]  # the first is behind the watermark
    put(spark, path, first, schema)
    put(spark, path, second, schema)
    put(spark, path, [("w", 9, at(92), "10.0.0.1")], schema)  # rows are late against the watermark of the batch before the last
    put(spark, path, late, schema)
    out = streams.drain(streams.stream_session_tokens(streams.read_stream(spark, path), "user", "ts", "id", "text", rules, 30 * 60), folder())
    got = {r["ord"]: r["text"] for r in out.collect()}
    assert got == {1: "IP_1", 2: "IP_2 IP_1", 3: "IP_1", 4: "IP_2", 5: "IP_1", 6: "", 8: "IP_2", 9: "IP_1"}


def test_detections_once_within_the_delay(spark):
    path = folder() + "/in"
    schema = "k long, ts timestamp, text string"
    text = 'password = "Zx9!kQ27vb4LmPq"'
    for k, m, t in ((1, 0, text), (1, 10, text), (2, 290, "none"), (2, 295, "none"), (1, 300, text)):
        put(spark, path, [(k, T0 + dt.timedelta(minutes=m), t)], schema)
    sdf = streams.stream_detections(streams.read_stream(spark, path), "k", "text", "ts", "1 hour")
    ckpt = folder()
    q = (sdf.writeStream.format("parquet").option("path", ckpt + "/out").option("checkpointLocation", ckpt + "/chk").trigger(availableNow=True).start())
    q.awaitTermination()
    once = spark.read.parquet(ckpt + "/out")
    n = once.select("value").distinct().count()
    assert n >= 1 and once.count() == 2 * n  # once in the first hour, once long after
    # what the watermark has passed is no longer held: only the last file's values are
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= n


def test_windows_close_behind_the_watermark(spark, rules):
    path = folder() + "/in"
    schema = "k long, ts timestamp, text string"
    at = lambda m: T0 + dt.timedelta(minutes=m)
    put(spark, path, [(1, at(5), "10.0.0.1 10.0.0.2"), (2, at(40), "10.0.0.1")], schema)
    put(spark, path, [(3, at(200), "10.0.0.1")], schema)
    put(spark, path, [(5, at(201), "none")], schema)
    put(spark, path, [(4, at(6), "10.0.0.4")], schema)  # late
    out = streams.drain(streams.windowed_match_stats_stream(streams.read_stream(spark, path), "ts", "text", rules, "1 hour", "30 minutes", "10 minutes"), folder())
    got = sorted(map(tuple, out.collect()))
    assert got == [("2023-12-31 23:30:00", "ipv4", 2), ("2024-01-01 00:00:00", "ipv4", 3), ("2024-01-01 00:30:00", "ipv4", 1)]
    batch = streams.windowed_match_stats(spark.read.parquet(path).filter("k < 3"), "k", "ts", "text", rules, "1 hour", "30 minutes")
    assert sorted(map(tuple, batch.collect())) == got


def test_table_folder_named_like_a_file(spark, rules):
    path = folder() + "/documents.parquet"
    spark.createDataFrame([(i, f"at 10.0.0.{i % 5}") for i in range(20)], "k long, text string").repartition(3).write.parquet(path)
    out = streams.stream_anonymize(spark, path, ["k"], "text", rules, folder(), files_per_batch=None)
    assert {r["k"]: r["text"] for r in out.collect()} == {i: f"at IP_{i % 5 + 1}" for i in range(20)}
    assert len(streams.drain(streams.read_stream(spark, path), folder()).collect()) == 20


def test_sessions_within_and_across_batches(spark, rules):
    """Sessions that begin and end within a batch leave nothing to the next one; one that goes on keeps its tokens."""
    path = folder() + "/in"
    schema = "user string, ts timestamp, ord long, text string"
    at = lambda m, i, ip: ("u", T0 + dt.timedelta(minutes=m), i, f"from {ip}")
    put(spark, path, [at(0, 0, "10.0.0.1"), at(60, 1, "10.0.0.2"), at(120, 2, "10.0.0.3"), at(121, 3, "10.0.0.4")], schema)
    put(spark, path, [at(130, 4, "10.0.0.4"), at(131, 5, "10.0.0.1"), at(200, 6, "10.0.0.4")], schema)
    put(spark, path, [at(201, 7, "10.0.0.3"), at(202, 8, "10.0.0.4")], schema)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = streams.stream_session_tokens(streams.read_stream(spark, path), "user", "ts", "ord", "text", rules, 30 * 60)
    got = {r["ord"]: r["text"] for r in streams.drain(out, folder()).collect()}
    assert got == {i: f"from IP_{n}" for i, n in enumerate([1, 1, 1, 2, 2, 3, 1, 2, 1])}
