"""Frames (batches as stored), their place in segments, and segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import FRAME_BYTES, data_bytes, record_bytes
from .ordering import ranged

DEFAULT_SEGMENT_BYTES = 256 << 20
DEFAULT_BATCH_BYTES = 4 << 20


def frames(log: DataFrame, key: str = "batch_no") -> DataFrame:
    """A row for each batch: first_lsn, last_lsn, cnt, frame_ts (of its first record), per_record_ts, size in bytes."""
    each = log.groupBy(key).agg(
        F.min("lsn").alias("first_lsn"),
        F.max("lsn").alias("last_lsn"),
        F.count(F.lit(1)).alias("cnt"),
        F.min_by("ts_ns", "lsn").alias("frame_ts"),
        (F.min("ts_ns") < F.max("ts_ns")).alias("per_record_ts"),
        F.sum(data_bytes(F.col("key"), F.col("meta"), F.col("payload"))).alias("_data"),
    )
    size = FRAME_BYTES + F.col("cnt") * record_bytes(F.col("per_record_ts")) + F.col("_data")
    return each.withColumn("size", size.cast("long")).drop("_data")


def too_large(batches: DataFrame, limit: int | Column = DEFAULT_BATCH_BYTES) -> DataFrame:
    """Batches that an append would refuse."""
    return batches.where(F.col("size") > limit)


def next_cuts(begins: np.ndarray, max_bytes: int) -> np.ndarray:
    """For each frame of a sorted stretch, were it the first of a segment, the position of the frame that opens the next one."""
    return np.searchsorted(begins, begins + max_bytes, "left")


def ways(begins: np.ndarray, lsns: np.ndarray, max_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin of a first cut, begin and number of the last cut that it leads to), for each frame that may be a stretch's first cut.

    Cuts that lead to the same last one and are adjacent are told of by the last of them.
    """
    follow, n = next_cuts(begins, max_bytes), len(begins)
    last = np.arange(n)
    for i in range(n - 1, -1, -1):
        if follow[i] < n:
            last[i] = last[follow[i]]
    some = np.arange(min(n, int(np.searchsorted(begins, begins[0] + max_bytes, "left")) + 1))
    some = some[np.r_[last[some][1:] != last[some][:-1], True]]
    return begins[some], begins[last[some]], lsns[last[some]]


def place(batches: DataFrame, max_bytes: int = DEFAULT_SEGMENT_BYTES, opened: tuple[int, int] | None = None) -> DataFrame:
    """batches with segment_lsn (first number of the segment) and offset (byte in it).

    A segment is closed by the first frame that brings it to max_bytes or over. opened: (first number, bytes) of an open segment
    that takes the first frames.

    Frames are dealt into sorted ranges. Where a range is cut depends on the frames before it, through the last cut alone; so each
    range tells, for each frame that may be its first cut, the last cut that follows. One task reads what the ranges tell, in
    order, and keeps a cut for each; then all ranges are cut side by side.
    """
    dealt = ranged(batches, ["first_lsn"])
    sums = dealt.groupBy("_range").agg(F.sum("size").alias("_n"))
    bases = sums.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("_base"))
    based = dealt.join(F.broadcast(bases), "_range")

    def begins_of(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        table = table.sort_by("first_lsn")
        sizes = table.column("size").to_numpy()
        return table, np.cumsum(sizes) - sizes + table.column("_base")[0].as_py()

    def tell(table: pa.Table) -> pa.Table:
        table, begins = begins_of(table)
        at, cut, lsn = ways(begins, table.column("first_lsn").to_numpy(), max_bytes)
        return pa.table({"_range": pa.array([table.column("_range")[0].as_py()] * len(at), pa.int32()), "at": at, "cut": cut, "lsn": lsn})

    def carry(rows):
        cut, lsn = (-opened[1], opened[0]) if opened else (-max_bytes, 0)
        at, entered = None, [[], [], []]
        for batch in rows:
            for r, begin, to, number in zip(*(batch.column(c).to_pylist() for c in ("_range", "at", "cut", "lsn")), strict=True):
                if r != at:
                    at, since = r, cut + max_bytes
                    for c, v in zip(entered, (r, cut, lsn), strict=True):
                        c.append(v)
                if since is not None and begin >= since:
                    cut, lsn, since = to, number, None
        yield pa.RecordBatch.from_arrays([pa.array(entered[0], pa.int32()), pa.array(entered[1], pa.int64()), pa.array(entered[2], pa.int64())], names=["_range", "_cut", "_lsn"])

    told = based.select("_range", "_base", "first_lsn", "size").groupBy("_range").applyInArrow(tell, "_range int, at long, cut long, lsn long")
    entries = told.coalesce(1).sortWithinPartitions("_range", "at").mapInArrow(carry, "_range int, _cut long, _lsn long")
    names = batches.columns

    def cut_range(table: pa.Table) -> pa.Table:
        table, begins = begins_of(table)
        lsns = table.column("first_lsn").to_numpy()
        cut, lsn = table.column("_cut")[0].as_py(), table.column("_lsn")[0].as_py()
        follow, starts = next_cuts(begins, max_bytes), []
        i = int(np.searchsorted(begins, cut + max_bytes, "left"))
        while i < len(begins):
            starts.append(i)
            i = int(follow[i])
        which = np.searchsorted(np.array(starts, np.int64), np.arange(len(begins)), "right")
        segment = np.r_[lsn, lsns[starts]][which]
        offset = begins - np.r_[cut, begins[starts]][which]
        return table.select(names).append_column("segment_lsn", pa.array(segment, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    whole = batches.select("*", F.lit(0).cast("long").alias("segment_lsn"), F.lit(0).cast("long").alias("offset")).schema
    return based.join(F.broadcast(entries), "_range").groupBy("_range").applyInArrow(cut_range, whole)


def segments(placed: DataFrame, max_bytes: int = DEFAULT_SEGMENT_BYTES) -> DataFrame:
    """A row for each segment. last_ts is its last frame's (not the largest, which max_ts has); a first timestamp of 0 counts as unset."""
    return placed.groupBy(F.col("segment_lsn").alias("first_lsn")).agg(
        F.max("last_lsn").alias("last_lsn"),
        F.sum("size").cast("long").alias("size"),
        F.count(F.lit(1)).alias("frames"),
        F.coalesce(F.min_by("frame_ts", F.when(F.col("frame_ts") != 0, F.col("offset"))), F.lit(0)).alias("first_ts"),
        F.max_by("frame_ts", "offset").alias("last_ts"),
        F.max("frame_ts").alias("max_ts"),
        (F.sum("size") >= max_bytes).alias("sealed"),
    )


def recovered(frames_seen: DataFrame, bad: Column) -> DataFrame:
    """Frames before the first bad one of their segment: what a recovery of its tail keeps, and what a replay that skips the rest reads.

    frames_seen: segment_lsn, offset, ...; segments without a bad frame keep all.
    """
    first_bad = frames_seen.where(bad).groupBy("segment_lsn").agg(F.min("offset").alias("_bad"))
    kept = frames_seen.join(first_bad, "segment_lsn", "left")
    return kept.where(F.col("_bad").isNull() | (F.col("offset") < F.col("_bad"))).drop("_bad")


def log_stats(log: DataFrame, batches: DataFrame, segs: DataFrame) -> DataFrame:
    """One row of counts and sums over a log."""
    a = batches.agg(F.count(F.lit(1)).alias("batches"), F.sum("cnt").cast("long").alias("events"), F.sum("size").cast("long").alias("bytes"), F.min("first_lsn").alias("first_lsn"), F.max("last_lsn").alias("last_lsn"))
    b = segs.agg(F.count(F.lit(1)).alias("segments"), F.sum("size").cast("long").alias("total_size"), F.sum(F.col("sealed").cast("long")).alias("rotations"))
    return a.crossJoin(b)
