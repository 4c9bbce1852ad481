"""Structured Streaming jobs and their batch twins.

Streams read parquet folders (``readStream`` with the batch schema) and run
with ``trigger(availableNow=True)`` so a run drains what is there and stops;
checkpoints go to the session's shared checkpoint folder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from maskweave.functions.ruleset import RuleSet
from maskweave.functions.tokens import print_token
from maskweave.operators import rewrite as rw
from maskweave.operators import scan_text as st
from maskweave.operators import vault as va
from maskweave.operators.spans import detect, rule_lookup


def sessions(df: DataFrame, user_col: str, ts_col: str, gap_seconds: int, order_cols: list[str] | None = None) -> DataFrame:
    """G2 batch twin: ``session_scope`` = user + session number (a new session when
    the gap to the previous event exceeds ``gap_seconds``); ``order_cols`` break ties of time."""
    w = Window.partitionBy(user_col).orderBy(ts_col, *(order_cols or []))
    prev = F.lag(ts_col).over(w)
    cur_us, prev_us = F.unix_micros(F.col(ts_col).cast("timestamp")), F.unix_micros(prev.cast("timestamp"))
    new = F.when(prev.isNull() | ((cur_us - prev_us) > gap_seconds * 1_000_000), 1).otherwise(0)
    out = df.withColumn("_new", new).withColumn("_sess", F.sum("_new").over(w))
    return out.withColumn("session_scope", F.concat(F.col(user_col).cast("string"), F.lit(":"), F.col("_sess").cast("string"))) \
        .drop("_new", "_sess")


class SessionTokens(StatefulProcessor):
    """One user's running session.

    State: value → token and the tokens in use (maps), the counter of every template and the time of the last
    event.  An event later than ``gap`` after the last one starts a new session with empty state; a timer
    clears the state once the watermark has passed the session's end.  Within a call the session is kept in
    memory, and only what its last session adds is written.
    """

    def __init__(self, templates: list[str], families: list[str], gap_ms: int) -> None:
        self.templates, self.families, self.gap_ms = templates, families, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tokens = handle.getMapState("tokens", "value string", "token string")
        self.used = handle.getMapState("used", "token string", "n int")
        self.counters = handle.getMapState("counters", "template string", "n long")
        self.last = handle.getValueState("last", "ms long")

    def _begin(self, stored: bool) -> None:
        """A session of this call; ``stored``: the maps in state are its own."""
        self.stored = stored
        self.near: dict[tuple[str, str], str | int | None] = {}
        self.new: set[tuple[str, str]] = set()

    def _get(self, kind: str, name: str):
        """An entry of a map, asked for once a call."""
        if (kind, name) not in self.near:
            state = getattr(self, kind)
            self.near[kind, name] = state.getValue((name,))[0] if self.stored and state.containsKey((name,)) else None
        return self.near[kind, name]

    def _put(self, kind: str, name: str, value) -> None:
        self.near[kind, name] = value
        self.new.add((kind, name))

    def _token(self, value: str, rule: int) -> str:
        token = self._get("tokens", value)
        if token is None:
            template, family = self.templates[rule], self.families[rule]
            n = (self._get("counters", template) or 0) + 1
            while self._get("used", token := print_token(family, n)):
                n += 1
            self._put("counters", template, n)
            self._put("tokens", value, token)
            self._put("used", token, 1)
        return token

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a user's events of one micro-batch, in order of time
        events = pd.concat(list(rows)).sort_values(["ms", "ord"], kind="stable")
        out = []
        last = known = self.last.get()[0] if self.last.exists() else None
        self._begin(stored=known is not None)
        for ms, ord_, text, spans in zip(events["ms"].tolist(), events["ord"].tolist(), events["text"].tolist(), events["spans"].tolist()):
            if last is not None and ms - last > self.gap_ms:
                self._begin(stored=False)
                last = None
            for s in sorted(json.loads(spans), key=lambda s: -s["start"]):  # tokens are given from right to left
                text = text[: s["start"]] + self._token(s["value"], s["rule"]) + text[s["end"] :]
            last = ms if last is None else max(ms, last)
            out.append((key[0], ord_, text))
        if out:
            if known is not None and not self.stored:
                for state in (self.tokens, self.used, self.counters):
                    state.clear()
            for kind, name in sorted(self.new):
                getattr(self, kind).updateValue((name,), (self.near[kind, name],))
            self.last.update((last,))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(last) + self.gap_ms)
        yield pd.DataFrame(out, columns=["user", "ord", "text"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and expiredTimerInfo.getExpiryTimeInMs() >= self.last.get()[0] + self.gap_ms:
            for state in (self.tokens, self.used, self.counters, self.last):
                state.clear()
        yield pd.DataFrame([], columns=["user", "ord", "text"])

    def close(self) -> None:
        pass


def stream_session_tokens(sdf: DataFrame, user_col: str, ts_col: str, ord_col: str, text_col: str, rules: RuleSet, gap_seconds: int,
                          watermark: str = "10 minutes") -> DataFrame:
    """G2 on a stream: (user, ord, text) with tokens that start anew in every session of a user.

    Matching stays in the JVM and row-local; only (time, text, spans) of a user meet in the state.
    Rows behind the watermark are dropped.  Needs the RocksDB state store."""
    spans = F.coalesce(F.to_json("_s"), F.lit("[]"))
    d = detect(sdf, text_col, rules, "_s").withWatermark(ts_col, watermark)
    rows = d.select(F.col(user_col).cast("string").alias("user"), F.col(ts_col), F.unix_millis(F.col(ts_col).cast("timestamp")).alias("ms"),
                    F.col(ord_col).cast("long").alias("ord"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), spans.alias("spans"))
    processor = SessionTokens([r.replacement for r in rules.rules], [r.family for r in rules.rules], gap_seconds * 1000)
    return rows.groupBy("user").transformWithStateInPandas(processor, "user string, ord long, text string", "Append", "EventTime")


def _window_counts(ex: DataFrame, ts_col: str, ids, width: str, slide: str | None) -> DataFrame:
    w = F.window(ts_col, width, slide) if slide else F.window(ts_col, width)
    g = ex.groupBy(w.alias("w"), F.col("s.rule").alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    F.get(ids, F.col("rule")).alias("rule_id"), F.col("n").cast("long").alias("n_matches"))


def windowed_match_stats(df: DataFrame, key: str, ts_col: str, text_col: str, rules: RuleSet, width: str, slide: str | None = None) -> DataFrame:
    """G4 batch twin: accepted spans per (tumbling or sliding window, rule)."""
    d = detect(df.select(key, ts_col, text_col), text_col, rules, "_s")
    ex = d.select(ts_col, F.explode_outer("_s").alias("s")).filter(F.col("s").isNotNull())
    return _window_counts(ex, ts_col, rule_lookup(rules, "rule_id"), width, slide)


def windowed_match_stats_stream(sdf: DataFrame, ts_col: str, text_col: str, rules: RuleSet, width: str,
                                slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """G4 on a stream: row-local detection, watermark, window counts (late rows dropped); a window's
    counts come once, when the watermark has passed its end."""
    d = detect(sdf, text_col, rules, "_s")
    ex = d.withWatermark(ts_col, watermark).select(ts_col, F.explode_outer("_s").alias("s")).filter(F.col("s").isNotNull())
    return _window_counts(ex, ts_col, rule_lookup(rules, "rule_id"), width, slide)


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = 1) -> DataFrame:
    """A file path streams its folder filtered to that file name; a folder (also one named like a file) streams all
    parquet files, ``files_per_batch`` a batch, the oldest first, or all that are there (None)."""
    import os

    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        reader = reader.option("pathGlobFilter", os.path.basename(path))
        path = os.path.dirname(path)
    return reader.parquet(path)


def drain(sdf: DataFrame, ckpt: str) -> DataFrame:
    """Run the stream over all that is there, append its rows to files below ``ckpt``, and read them."""
    spark = sdf.sparkSession
    q = (sdf.writeStream.format("parquet").option("path", ckpt + "/out").option("checkpointLocation", ckpt + "/chk")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(ckpt + "/out")


def stream_detections(sdf: DataFrame, key: str, text_col: str, ts_col: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Detections as rows arrive, each (key, value) once within ``delay`` of its first time, so that
    the state holds no more than that; time is ``ts_col``, or else when the row is read."""
    sdf = sdf.select(key, text_col, (F.col(ts_col) if ts_col else F.current_timestamp()).alias("seen_at")).withWatermark("seen_at", delay)
    scanned = st.with_secret_scan(sdf, text_col, out="_d")
    return st.explode_detections(scanned, [key, "seen_at"], "_d").dropDuplicatesWithinWatermark([key, "value"])


def stream_scan(spark: SparkSession, path: str, key: str, text_col: str, ckpt: str, ts_col: str | None = None, delay: str = "1 hour",
                files_per_batch: int | None = 1) -> DataFrame:
    return drain(stream_detections(read_stream(spark, path, files_per_batch), key, text_col, ts_col, delay), ckpt)


def stream_anonymize(spark: SparkSession, path: str, key_cols: list[str], text_col: str, rules: RuleSet,
                     ckpt: str, files_per_batch: int | None = 1) -> DataFrame:
    """G1: each micro-batch is anonymized against the vault log of all batches before it.  The batch's
    new pairs are a version of the log and its rows a folder of the output, both named by the batch id and
    replaced when the batch is run again; so tokens hold over restarts and no row comes twice."""
    log, out_path = va.VaultLog(spark, ckpt + "/vault"), ckpt + "/out"

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        vault, counters = log.load(before=batch_id)
        res = rw.anonymize(batch.select(*key_cols, text_col), key_cols, [text_col], rules, vault, counters,
                           batch_id=batch_id)
        log.append(batch_id, res.new_vault, res.counters)
        res.df.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    q = (read_stream(spark, path, files_per_batch).writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt + "/chk")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_path).drop("batch")
