"""Deletion of whole segments: by number, by time, by limits. The last segment always stays."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _marked(segments: DataFrame) -> DataFrame:
    last = segments.agg(F.max("first_lsn").alias("_last"))
    return segments.crossJoin(F.broadcast(last)).withColumn("_free", F.col("first_lsn") < F.col("_last")).drop("_last")


def _kept(segments: DataFrame, gone: Column) -> DataFrame:
    return _marked(segments).where(~(F.col("_free") & gone)).drop("_free")


def delete_before(segments: DataFrame, lsn: int | Column) -> DataFrame:
    """What stays when segments that end before lsn go."""
    return _kept(segments, F.col("sealed") & (F.col("last_lsn") < lsn))


def delete_older_than(segments: DataFrame, ts_ns: int | Column) -> DataFrame:
    """What stays when segments whose last frame is older go."""
    return _kept(segments, F.col("sealed") & (F.col("last_ts") < ts_ns))


def compact(segments: DataFrame, checkpoint_lsn: int | Column | None = None, checkpoint_ts: int | Column | None = None) -> DataFrame:
    """The rule by number, then the one by time; without a checkpoint nothing goes."""
    if checkpoint_lsn is not None:
        segments = delete_before(segments, checkpoint_lsn)
    if checkpoint_ts is not None:
        segments = delete_older_than(segments, checkpoint_ts)
    return segments


def retain_count(segments: DataFrame, most: int) -> DataFrame:
    """The newest segments, most of them. segments is metadata: a row for each file."""
    newer = F.count(F.lit(1)).over(Window.orderBy(F.desc("first_lsn")))
    return segments.withColumn("_n", newer).where(F.col("_n") <= max(1, most)).drop("_n")


def retain_size(segments: DataFrame, most_bytes: int) -> DataFrame:
    """What stays when the oldest go as long as all that is left is larger than most_bytes."""
    left = F.sum("size").over(Window.orderBy(F.desc("first_lsn")))
    first = F.row_number().over(Window.orderBy(F.desc("first_lsn")))
    return segments.withColumns({"_left": left, "_n": first}).where((F.col("_left") <= most_bytes) | (F.col("_n") == 1)).drop("_left", "_n")


def retire(entries: list[dict], now_ns: int, max_segments: int | None = None, max_age_ns: int | None = None, max_bytes: int | None = None, in_use: Iterable[int] = ()) -> list[dict]:
    """The manifest entries that a rotation deletes: oldest first, under any of the limits, never the last or one in use."""
    count, total, held, out = len(entries), sum(e["size"] for e in entries), set(in_use), []
    for e in sorted(entries, key=lambda e: e["first_lsn"])[:-1]:
        if e["first_lsn"] in held:
            continue
        over = (max_segments is not None and count > max_segments, max_age_ns is not None and now_ns - e["created_at"] > max_age_ns, max_bytes is not None and total > max_bytes)
        if any(over):
            out.append(e)
            count, total = count - 1, total - e["size"]
    return out
