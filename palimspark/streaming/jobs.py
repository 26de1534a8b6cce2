"""Streams over append-only logs. Each takes a streaming or a batch DataFrame, so that both forms can be compared."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from palimspark.storage import is_folder, shared_path


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table, one file or a folder of files, as a stream of its files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if is_folder(spark, path):
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")  # a file source watches a folder
    return reader.option("pathGlobFilter", name).parquet(folder)


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table of events as a stream; times are cast, since watermarks need a time zone."""
    return table_stream(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))


def trace_monitor(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events, slow ones and their share, median (of the lower of two) and total time per stage and tumbling window."""
    slow = F.col("value") > 50
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.count_if(slow).alias("slow"), F.round(F.avg(slow.cast("int")), 6).alias("slow_share"), F.percentile_approx("value", 0.5, 1000).alias("p50"), F.round(F.sum("value"), 4).alias("elapsed")).select(F.col("w.start").alias("window_start"), "stage", "n", "slow", "slow_share", "p50", "elapsed")


def rate_monitor(events: DataFrame, limit: int, window: str = "60 seconds", slide: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """Sliding windows in which a key has more calls than allowed."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    counted = timed.groupBy("user_id", F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") > limit).select("user_id", F.col("w.start").alias("window_start"), "n")


def idempotent_intake(events: DataFrame, key: list[str], within: str) -> DataFrame:
    """The first event of each key inside the time that a key is remembered."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def success_intake(calls: DataFrame, key: list[str], ttl_ms: int, late: str = "1 hour", buckets: int = 4096) -> DataFrame:
    """The calls (key, event_id, ts, success) that run: all of a key but those while a success of it is remembered.

    Only a success is remembered, for ``ttl_ms`` of event time, so a failure doesn't block its repeat. Calls count in the
    order of ts and event_id inside a micro-batch, and micro-batches in theirs. A call of Python and a row of state cost far
    more than an event, so keys share them: by their hash they fall into ``buckets``, a number that a checkpoint fixes. A
    bucket forgets what the watermark has passed with its next calls, and all of it with the last of its successes.
    """
    kinds = {f.name: f.dataType.simpleString() for f in calls.schema.fields}
    parts = [f"key{n}" for n in range(len(key))]  # as strings, for a null among longs makes doubles of them in pandas

    def admit(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = {}  # of each key, up to where a success is remembered
        if state.exists:
            *own, ends = state.get
            until = dict(zip(zip(*own, strict=True), ends, strict=True))
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["at_us", "event_id"])
        ran = []
        for who, at, success in zip(zip(*(rows[p] for p in parts), strict=True), rows["at_us"], rows["success"], strict=True):
            runs = at >= until.get(who, float("-inf"))
            if runs and success:
                until[who] = int(at) + 1000 * ttl_ms
            ran.append(runs)
        passed = state.getCurrentWatermarkMs()
        until = {who: end for who, end in until.items() if end > 1000 * passed}
        if until:
            state.update((*map(list, zip(*until, strict=True)), list(until.values())))
            state.setTimeoutTimestamp(max(max(until.values()) // 1000, passed) + 1)
        elif state.exists:
            state.remove()
        yield rows.loc[ran, [*parts, "event_id"]]

    named = [F.col(k).cast("string").alias(p) for k, p in zip(key, parts, strict=True)]
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("bucket")
    timed = calls.withWatermark("ts", late).select(bucket, *named, "ts", F.unix_micros("ts").alias("at_us"), "event_id", "success")
    schema = ", ".join([*(f"{p} string" for p in parts), f"event_id {kinds['event_id']}"])
    held = ", ".join([*(f"{p} array<string>" for p in parts), "until array<long>"])
    ran = timed.groupBy("bucket").applyInPandasWithState(admit, schema, held, "append", GroupStateTimeout.EventTimeTimeout)
    return ran.select(*(F.col(p).cast(kinds[k]).alias(k) for k, p in zip(key, parts, strict=True)), "event_id")


def activity_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of activity per user that no longer pause cuts."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def loop_alarm(events: DataFrame, most: int = 2, late: str = "1 hour", ttl_ms: int = 86_400_000) -> DataFrame:
    """The event with which a signature comes up more than ``most`` times in a run; counts live in state.

    Events count in the order of ts and event_id inside a micro-batch, and micro-batches in theirs. A run without an event
    for ``ttl_ms`` of event time is forgotten.
    """

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        names, numbers = state.get if state.exists else ([], [])
        seen = dict(zip(names, numbers, strict=True))
        found, newest = [], 0
        for row in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            newest = max(newest, row.at_ms)
            seen[row.signature] = seen.get(row.signature, 0) + 1
            if seen[row.signature] == most + 1:
                found.append((key[0], row.signature, row.event_id))
        state.update((list(seen), list(seen.values())))
        state.setTimeoutTimestamp(int(max(newest + ttl_ms, state.getCurrentWatermarkMs() + 1)))
        yield pd.DataFrame(found, columns=["run_id", "signature", "event_id"])

    timed = events.withWatermark("ts", late).withColumn("at_ms", F.unix_millis("ts")).withColumnRenamed("user_id", "run_id")
    return timed.groupBy("run_id").applyInPandasWithState(count, "run_id long, signature string, event_id long", "names array<string>, numbers array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def session_memory(turns: DataFrame, most: int = 60, late: str = "1 hour", ttl_ms: int = 86_400_000) -> DataFrame:
    """Per session of (conv_id, turn, role, text, ts): its newest ``most`` messages, kept in state, as count, user turns and last question.

    A session gives a row whenever messages come; one without any for ``ttl_ms`` of event time is forgotten. A turn that comes again
    replaces the one before; messages may come in any order.
    """

    def remember(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, newest = {}, 0
        if state.exists:
            numbers, roles, texts = state.get
            held = dict(zip(numbers, zip(roles, texts, strict=True), strict=True))
        for frame in frames:
            newest = max(newest, int(frame["at_ms"].max()))
            held.update(zip(frame["turn"].tolist(), zip(frame["role"], frame["text"], strict=True), strict=True))
            held = dict(sorted(held.items())[-most:])
        state.update((list(held), [r for r, _ in held.values()], [t for _, t in held.values()]))
        state.setTimeoutTimestamp(max(newest + ttl_ms, state.getCurrentWatermarkMs() + 1))
        asked = [t for r, t in held.values() if r == "user"]
        yield pd.DataFrame({"conv_id": [key[0]], "n_messages": [len(held)], "user_turns": [len(asked)], "last_user": [asked[-1] if asked else None]})

    timed = turns.withWatermark("ts", late).withColumn("at_ms", F.unix_millis("ts"))
    return timed.groupBy("conv_id").applyInPandasWithState(remember, "conv_id long, n_messages long, user_turns long, last_user string", "turns array<long>, roles array<string>, texts array<string>", "update", GroupStateTimeout.EventTimeTimeout)


def on_time(events: DataFrame, window: str, late: str) -> tuple[DataFrame, int]:
    """Windows (window_start, event_type, n) that the watermark has closed, each given once, and how many rows came too late for theirs.

    A row is too late if its window was given before its micro-batch began, which is a micro-batch after the watermark passed it. Windows still open at the end aren't given.
    """
    spark = events.sparkSession
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))
    out = shared_path(spark, "closed")
    stream = counted.select(F.col("w.start").alias("window_start"), "event_type", "n").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "offsets")).trigger(availableNow=True).start()
    stream.awaitTermination()
    dropped = sum(op.numRowsDroppedByWatermark for progress in stream.recentProgress for op in progress.stateOperators)
    return spark.read.schema("window_start timestamp, event_type string, n long").parquet(out), dropped


def progress_rows(spark: SparkSession, query) -> DataFrame:
    """(name, batch, n_rows, at, seconds) of the micro-batches of a query, running or ended, that it still knows (some hundred)."""
    rows = [(query.name or str(query.id), p.batchId, p.numInputRows, p.timestamp, p.durationMs.get("triggerExecution", 0) / 1000) for p in query.recentProgress if p.numInputRows]
    schema = "name string, batch long, n_rows long, at string, seconds double"
    return spark.createDataFrame(rows, schema).withColumn("at", F.to_timestamp("at"))


def with_eta(progress: DataFrame, totals: DataFrame, weight: float = 0.5) -> DataFrame:
    """Per name of (name, batch, n_rows, seconds): rows done of the total (name, total), percent, rate and seconds to go.

    The rate is a running mean in which each batch counts ``weight`` and all before it the rest; without a rate there is no estimate.
    A name without a batch has done nothing.
    """
    speeds = F.transform(F.array_sort(F.collect_list(F.struct("batch", (F.col("n_rows") / F.greatest("seconds", F.lit(1e-3))).alias("speed")))), lambda b: b["speed"])
    rate = F.aggregate("_speeds", F.lit(-1.0), lambda acc, x: F.when(acc < 0, x).otherwise(weight * x + (1 - weight) * acc))
    done = progress.groupBy("name").agg(F.sum("n_rows").alias("done"), speeds.alias("_speeds")).withColumn("rate", rate)
    met = totals.join(done, "name", "left").withColumn("done", F.coalesce("done", F.lit(0)).cast("long"))
    left = F.greatest(F.col("total") - F.col("done"), F.lit(0))
    return met.select("name", "total", "done", F.round(100.0 * F.col("done") / F.greatest("total", F.lit(1)), 2).alias("percent"), F.round("rate", 3).alias("rate"), F.when(F.col("rate") > 0, F.round(left / F.col("rate"), 1)).alias("eta_seconds"))


def finished(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Run a stream over what is there now; the last state of every row, from files in the shared folder.

    Each micro-batch is appended under its number; of a key that several batches updated the last one counts.
    """
    spark = stream.sparkSession
    out = shared_path(spark, "stream")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch)).write.mode("append").parquet(out)

    stream.writeStream.outputMode(mode).option("checkpointLocation", shared_path(spark, "offsets")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    kept = StructType([*stream.schema.fields, StructField("_batch", IntegerType())])
    spark.createDataFrame([], kept).write.mode("append").parquet(out)  # a stream without a row leaves no files
    rows = spark.read.schema(kept).parquet(out)
    if mode == "append":
        return rows.drop("_batch")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_v")).select(*keys, *(F.col(f"_v.{c}").alias(c) for c in rest))


def materialise(batch: DataFrame, store: str, encode) -> None:
    """Encode the texts of a micro-batch (key, text) that the store lacks, each once, and append them."""
    spark = batch.sparkSession
    new = batch.dropDuplicates(["key"])
    try:
        new = new.join(spark.read.parquet(store).select("key"), "key", "left_anti")
    except Exception as missing:  # the first batch finds no store
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    encode(new).write.mode("append").parquet(store)
