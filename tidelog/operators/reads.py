"""Reads of a log: replay, batches, iteration, seeks, index feed, lookups, state by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import LsnRangeError
from .ordering import running


def replay(log: DataFrame, first: int, ordered: bool = False) -> DataFrame:
    """Events from first on; in log order if asked for (a range-partitioned sort)."""
    out = log.where(F.col("lsn") >= first)
    return out.orderBy("lsn") if ordered else out


def replay_range(log: DataFrame, first: int, last: int, ordered: bool = False) -> DataFrame:
    """Events from first to last, both inclusive."""
    if last < first:
        raise LsnRangeError(f"range ends at {last}, before its start {first}")
    out = log.where(F.col("lsn").between(first, last))
    return out.orderBy("lsn") if ordered else out


def replay_batches(log: DataFrame, first: int, key: str = "batch_no") -> DataFrame:
    """A row for each batch with its events from first on, in order; a batch that straddles first is trimmed."""
    event = F.struct("lsn", "ts_ns", "key", "meta", "payload")
    return replay(log, first).groupBy(key).agg(F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.count(F.lit(1)).alias("cnt"), F.sort_array(F.collect_list(event)).alias("events"))


def batch_summaries(log: DataFrame, first: int, key: str = "batch_no") -> DataFrame:
    """replay_batches without the events: counts and payload bytes, combined before the shuffle."""
    return replay(log, first).groupBy(key).agg(
        F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.count(F.lit(1)).alias("cnt"), F.sum(F.octet_length("payload")).cast("long").alias("payload_bytes")
    )


def iterate(log: DataFrame, first: int = 0) -> Iterator[Row]:
    """Events from first on, in order, a partition at a time."""
    return replay(log, first, ordered=True).toLocalIterator(prefetchPartitions=True)


def for_each(log: DataFrame, first: int, callback: Callable[[Row], bool | None]) -> int:
    """Calls back for each event in order until the callback returns False; the number of calls. Errors of the callback pass."""
    n = 0
    for row in iterate(log, first):
        n += 1
        if callback(row) is False:
            break
    return n


def seek_lsn(frames: DataFrame, probes: DataFrame) -> DataFrame:
    """probe, first_lsn: for each probe the last frame that starts at or before it, else the first frame.

    Frames and probes are merged in order of their numbers, by ranges: a running maximum in each range, and the maxima of
    the ranges before it, so no probe meets all frames.
    """
    rows = frames.select(F.col("first_lsn").alias("at"), F.col("first_lsn").alias("value"), F.lit(None).cast("long").alias("probe"))
    rows = rows.unionByName(probes.select(F.col("probe").cast("long").alias("at"), F.lit(None).cast("long").alias("value"), F.col("probe").cast("long").alias("probe")))
    found = running(rows, ["at", F.col("probe").isNotNull()], "value").where("probe is not null")
    least = frames.agg(F.min("first_lsn").alias("least"))
    return found.crossJoin(F.broadcast(least)).select("probe", F.coalesce("run", "least").alias("first_lsn"))


def seek_ts(frames: DataFrame, probes: DataFrame) -> DataFrame:
    """probe_ts, first_lsn: for each probe the first frame whose timestamp is at or after it, null past the end.

    Frames and probes are merged by descending timestamp, by ranges: the least number so far is the answer.
    """
    rows = frames.select(F.col("frame_ts").alias("at"), F.col("first_lsn").alias("value"), F.lit(None).cast("long").alias("probe_ts"))
    probes = probes.select(F.col("probe_ts").cast("long").alias("probe_ts")).distinct()
    rows = rows.unionByName(probes.select(F.col("probe_ts").alias("at"), F.lit(None).cast("long").alias("value"), "probe_ts"))
    # ~at falls as at grows and, unlike -at, never overflows
    found = running(rows, [F.bitwise_not("at"), F.col("probe_ts").isNotNull()], "value", F.min).where("probe_ts is not null")
    return found.select("probe_ts", F.col("run").alias("first_lsn"))


def index_feed(log: DataFrame, placed: DataFrame, key: str = "batch_no") -> DataFrame:
    """A row for each event: lsn, ts_ns, key, meta, offset of its frame, first number of its segment."""
    return log.select("lsn", "ts_ns", "key", "meta", key).join(placed.select(key, F.col("offset"), "segment_lsn"), key).drop(key)


def index_lookup(index: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Events of one key, by its index rows."""
    return index.where(F.col("key") == key).select("lsn").join(log, "lsn")


def latest_per_key(log: DataFrame) -> DataFrame:
    """key, lsn, payload of each key's last event, as a replay that keeps state would have it; null keys are one key."""
    last = F.max_by(F.struct("lsn", "payload"), F.col("lsn"))
    return log.groupBy("key").agg(last.alias("s")).select("key", "s.lsn", "s.payload")


def gaps(log: DataFrame) -> DataFrame:
    """after_lsn, next_lsn: stretches of missing sequence numbers between events."""
    rows = running(log.select(F.col("lsn").alias("at"), F.col("lsn").alias("value")), ["at"], "value", before=True)
    return rows.where(F.col("at") > F.col("run") + 1).select(F.col("run").alias("after_lsn"), F.col("at").alias("next_lsn"))
