"""Fixed-window rate limiting over an event table.

A window opens with the first event at or after the previous window's end, so
window starts form a chain per key. The chain is followed in time segments:
each segment is summarized as a map from the end of the window running when it
starts to the end of the window running when it ends; the small maps are
composed per key; then every segment assigns its events on its own. A key with
a third of all events is thereby spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SEGMENT_EVENTS = 200_000


def _segments(events: DataFrame, window_us: int, target: int) -> DataFrame:
    span = events.groupBy("key").agg(F.count("*").alias("_n"), F.min("us").alias("_lo"), F.max("us").alias("_hi"))
    width = F.greatest(F.lit(window_us), F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.ceil(F.col("_n") / target)))
    span = span.select("key", "_lo", width.cast("long").alias("_width"))
    placed = events.join(span, "key").withColumn("segment", F.floor((F.col("us") - F.col("_lo")) / F.col("_width")).cast("long"))
    return placed.withColumn("seg_start", F.col("_lo") + F.col("segment") * F.col("_width")).drop("_lo", "_width")


def fixed_windows(events: DataFrame, window_seconds: int, target: int = SEGMENT_EVENTS) -> DataFrame:
    """Add ``window_us``, the opening time of the window each event falls in.

    ``events(key, us, ...)`` with the event time in microseconds.
    """
    window = int(window_seconds) * 1_000_000
    placed = _segments(events, window, target)
    columns = events.columns
    types = dict(events.dtypes)
    # Many small (key, segment) groups share one Python call; a bucket holds about
    # one segment's worth of events.
    partitions = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, -(-events.count() // target))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("key", "segment"), F.lit(buckets)))

    def groups(frame: pd.DataFrame):
        """Sorted frame and the row ranges of its (key, segment) groups."""
        frame = frame.sort_values(["key", "segment", "us"], kind="stable").reset_index(drop=True)
        changed = (frame["key"] != frame["key"].shift()) | (frame["segment"] != frame["segment"].shift())
        starts = np.flatnonzero(changed.to_numpy())
        return frame, list(zip(starts, np.append(starts[1:], len(frame))))

    def summarize(frame: pd.DataFrame) -> pd.DataFrame:
        frame, ranges = groups(frame)
        us, seg_start = frame["us"].to_numpy(), frame["seg_start"].to_numpy()
        rows, opens_out, ends_out = [], [], []
        for a, b in ranges:
            times = np.unique(us[a:b])
            following = np.searchsorted(times, times + window)
            leaving = times + window
            for i in range(len(times) - 1, -1, -1):
                if following[i] < len(times):
                    leaving[i] = leaving[following[i]]
            # A running window ends within one window length of the segment start.
            last = min(int(np.searchsorted(times, seg_start[a] + window)) + 1, len(times))
            opens, ends = times[:last], leaving[:last]
            keep = np.append(ends[1:] != ends[:-1], True)
            opens_out.append(opens[keep])
            ends_out.append(ends[keep])
            rows.extend([a] * int(keep.sum()))
        return pd.DataFrame(
            {
                "key": frame["key"].to_numpy()[rows],
                "segment": frame["segment"].to_numpy()[rows],
                "opens": np.concatenate(opens_out),
                "ends": np.concatenate(ends_out),
            }
        )

    maps = placed.select("bucket", "key", "segment", "seg_start", "us").groupBy("bucket").applyInPandas(
        summarize, f"key {types['key']}, segment long, opens long, ends long"
    )
    maps = maps.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "segment", "opens"]).reset_index(drop=True)
        keys, segments = frame["key"].to_numpy(), frame["segment"].to_numpy()
        opens, ends = frame["opens"].to_numpy(), frame["ends"].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (segments[1:] != segments[:-1])) + 1
        out, running = [], None
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(frame))):
            if a == 0 or keys[a] != keys[a - 1]:
                running = None
            out.append((keys[a], segments[a], running))
            at = a if running is None else a + int(np.searchsorted(opens[a:b], running))
            if at < b:
                running = int(ends[at])
        return pd.DataFrame(out, columns=["key", "segment", "running"]).astype({"running": "Int64"})

    entries = maps.groupBy("bucket").applyInPandas(compose, f"key {types['key']}, segment long, running long")

    def assign(frame: pd.DataFrame) -> pd.DataFrame:
        frame, ranges = groups(frame)
        us = frame["us"].to_numpy()
        running = frame["running"].astype("Int64").to_numpy(dtype="float64", na_value=np.nan)
        exact = frame["running"].astype("Int64")
        opened = np.empty(len(frame), dtype=np.int64)
        for a, b in ranges:
            at = a
            if not np.isnan(running[a]):
                ends = int(exact.iloc[a])
                at = a + int(np.searchsorted(us[a:b], ends))
                opened[a:at] = ends - window
            while at < b:
                after = a + int(np.searchsorted(us[a:b], us[at] + window))
                opened[at:after] = us[at]
                at = after
        return frame.assign(window_us=opened)[[*columns, "window_us"]]

    joined = placed.join(entries, ["key", "segment"]).select("bucket", *columns, "segment", "running")
    schema = ", ".join(f"{n} {t}" for n, t in events.dtypes) + ", window_us long"
    return joined.groupBy("bucket").applyInPandas(assign, schema)


def rate_limit(events: DataFrame, limit: int, window_seconds: int, order: str = "event_id", target: int = SEGMENT_EVENTS) -> DataFrame:
    """``allowed, remaining, retry_after`` for every event of every key."""
    limit, window_seconds = max(1, int(limit)), max(1, int(window_seconds))
    opened = fixed_windows(events, window_seconds, target)
    nth = F.row_number().over(W.partitionBy("key", "window_us").orderBy("us", order))
    counted = opened.withColumn("nth", nth)
    left = (F.col("window_us") + window_seconds * 1_000_000 - F.col("us")) / 1_000_000.0
    return counted.select(
        *events.columns,
        "window_us",
        F.col("nth").cast("long").alias("nth"),
        (F.col("nth") <= limit).alias("allowed"),
        F.greatest(F.lit(0), F.lit(limit) - F.col("nth")).cast("long").alias("remaining"),
        F.greatest(F.lit(1), F.floor(left + 0.999)).cast("long").alias("retry_after"),
    )
