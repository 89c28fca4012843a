"""Rate limits, leases and windows over unbounded input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Event times without a zone are UTC; watermarks need a zoned timestamp."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def rate_limit_stream(requests: DataFrame, limit: int, window_seconds: int, key: str = "key", delay: str = "1 minute") -> DataFrame:
    """Allow ``limit`` requests per key in windows that open with a first request.

    Requests carry ``ts`` (timestamp) and ``request_id``. State per key is two
    numbers; it is dropped once the watermark passes the end of the window.
    """
    limit, window = max(1, int(limit)), max(1, int(window_seconds)) * 1_000_000

    def decide(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, ends = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(["us", "request_id"])
        out = []
        for row in rows.itertuples():
            if row.us >= ends:
                count, ends = 0, row.us + window
            count += 1
            out.append((group[0], row.request_id, row.us, count <= limit, max(0, limit - count), max(1, int((ends - row.us) / 1e6 + 0.999))))
        state.update((count, ends))
        watermark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(ends // 1000, watermark + 1))
        yield pd.DataFrame(out, columns=["key", "request_id", "us", "allowed", "remaining", "retry_after"])

    timed = event_time(requests).withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    key_type = dict(requests.dtypes)[key]
    return timed.select(F.col(key).alias("key"), "request_id", "us", "ts").groupBy("key").applyInPandasWithState(
        decide,
        f"key {key_type}, request_id long, us long, allowed boolean, remaining long, retry_after long",
        "count long, ends long",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def lease_stream(commands: DataFrame, limit: int, lease_seconds: int, delay: str = "1 minute") -> DataFrame:
    """At most ``limit`` live leases per resource.

    ``commands(resource, lease_id, action acquire|release|renew, ts)``; leases
    past their end are purged before counting.
    """
    lease = max(1, int(lease_seconds)) * 1_000_000

    def decide(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ids, ends = state.get if state.exists else ([], [])
        live = dict(zip(ids, ends))
        out = []
        for row in pd.concat(list(frames)).sort_values(["us", "lease_id"]).itertuples():
            live = {name: end for name, end in live.items() if end > row.us}
            held = row.lease_id in live
            if row.action == "release":
                live.pop(row.lease_id, None)
                granted = held
            elif row.action == "renew":
                granted = held
            else:
                granted = held or len(live) < limit
            if granted and row.action != "release":
                live[row.lease_id] = row.us + lease
            out.append((group[0], row.lease_id, row.action, row.us, granted, len(live)))
        state.update((list(live), list(live.values())))
        state.setTimeoutTimestamp(max(max(live.values(), default=0) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["resource", "lease_id", "action", "us", "granted", "live"])

    timed = event_time(commands).withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("resource").applyInPandasWithState(
        decide,
        "resource string, lease_id string, action string, us long, granted boolean, live long",
        "ids array<string>, ends array<long>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def aligned_limits(requests: DataFrame, limit: int, window: str, key: str = "key", delay: str = "1 minute") -> DataFrame:
    """Approximation with clock-aligned windows: counts and rejections per key and window."""
    timed = event_time(requests).withWatermark("ts", delay)
    return timed.groupBy(key, F.window("ts", window)).agg(F.count("*").alias("n")).withColumn(
        "rejected", F.greatest(F.lit(0), F.col("n") - limit)
    )


def stage_timings(events: DataFrame, window: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """Count, mean and maximum duration per pipeline stage and window."""
    timed = event_time(events).withWatermark("ts", delay)
    return timed.groupBy("stage", F.window("ts", window)).agg(
        F.count("*").alias("n"), F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").alias("max_ms")
    )


def sessions(events: DataFrame, gap: str, key: str = "user_id", delay: str = "1 minute") -> DataFrame:
    timed = event_time(events).withWatermark("ts", delay)
    return timed.groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("n_events"))


def first_uploads(uploads: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each content once while its copies arrive within the delay."""
    return event_time(uploads).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["source_id"])
