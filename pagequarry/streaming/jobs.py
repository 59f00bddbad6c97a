"""Stateful operators as Structured Streaming: dedup queue, states, learning, pacing, statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagequarry.functions.urls import canonicalize_url


def dedup_queue(seeds: DataFrame) -> DataFrame:
    """URLs at first sight; the state never forgets one."""
    return seeds.withColumn("canonical_url", canonicalize_url("url")).where("canonical_url IS NOT NULL").dropDuplicates(["canonical_url"])


STATE_OUT = "url string, state string, attempts int, last_tier string, last_error string, version bigint"


def state_machine(ops: DataFrame) -> DataFrame:
    """State of each URL after each micro-batch in which it had operations (url, op, tier, err, ts, n)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, attempts, tier, err, version = state.get if state.exists else ("queued", 0, "", "", 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "n"])
        for op, t, e in zip(rows["op"], rows["tier"], rows["err"]):
            if op in ("enqueue", "recover"):
                now = "queued"
            elif op == "next":
                now, attempts = "in_flight", attempts + 1
            else:
                now, tier = op, t
                err = e or "" if op == "failed" else err
        version += 1
        state.update((now, attempts, tier, err, version))
        yield pd.DataFrame([(key[0], now, attempts, tier, err, version)], columns=["url", "state", "attempts", "last_tier", "last_error", "version"])

    return ops.groupBy("url").applyInPandasWithState(step, STATE_OUT, "state string, attempts int, tier string, err string, version bigint", "update", GroupStateTimeout.NoTimeout)


def pacer(queue: DataFrame, rate: float = 1.0, burst: int = 1) -> DataFrame:
    """host, seq, start_s: the token bucket's earliest start of each URL, across micro-batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("seq")
        k = range(n + 1, n + 1 + len(rows))
        state.update((n + len(rows),))
        yield pd.DataFrame({"host": key[0], "seq": rows["seq"].to_numpy(), "start_s": [max(i - burst, 0) / rate if rate > 0 else 0.0 for i in k]})

    return queue.groupBy("host").applyInPandasWithState(step, "host string, seq bigint, start_s double", "n bigint", "append", GroupStateTimeout.NoTimeout)


def learn_tiers(log: DataFrame) -> DataFrame:
    """Latest successful tier of each host (ts, event_id, host, tier, category); update or complete mode."""
    return log.where("category = 'success'").groupBy("host").agg(F.max_by("tier", F.struct("ts", "event_id")).alias("tier"), F.max("ts").alias("updated_at"))


CACHE_OUT = "url string, tier string, body string, stored_ms bigint, live boolean"


def cache_entries(fetches: DataFrame, ttl_ms: int = 86_400_000, late: str = "10 minutes") -> DataFrame:
    """The latest answer of each (url, tier) (ts, url, tier, body) as it comes, live for ttl_ms from its own time on;
    once the watermark is past that, the entry leaves the state with a last row that says so. Update mode."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        body, at = state.get if state.exists else (None, -1)
        live = not state.hasTimedOut
        for rows in batches if live else ():
            i = int(rows["ms"].to_numpy().argmax())
            if rows["ms"].iloc[i] >= at:
                body, at = rows["body"].iloc[i], int(rows["ms"].iloc[i])
        live = live and at + ttl_ms > state.getCurrentWatermarkMs()
        if live:
            state.update((body, at))
            state.setTimeoutTimestamp(at + ttl_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(*key, body, at, live)], columns=["url", "tier", "body", "stored_ms", "live"])

    rows = fetches.withWatermark("ts", late).select("ts", "url", "tier", "body", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("url", "tier").applyInPandasWithState(step, CACHE_OUT, "body string, ms bigint", "update", GroupStateTimeout.EventTimeTimeout)


def live_stats(log: DataFrame) -> DataFrame:
    """Counts and total time by tier and category; complete mode."""
    return log.groupBy("tier", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("total_ms"))


def hourly(log: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by window, tier and category behind a watermark; append mode emits closed windows."""
    g = log.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "tier", "category")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("total_ms")).select(F.col("w.start").alias("hour"), "tier", "category", "n", "total_ms")


def run_to_end(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """All that is available now, as Parquet in folder, a part for each micro-batch: the last part in complete mode
    (it has everything), all parts in the others. A part that is written again after a failure replaces itself."""
    parts: list[int] = []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/part={batch}")
        parts.append(batch)

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}-progress").trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    if not parts:
        return spark.createDataFrame([], stream.schema)
    chosen = [max(parts)] if mode == "complete" else sorted(set(parts))
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/part={b}" for b in chosen])
