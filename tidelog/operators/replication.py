"""Replication between logs, as set operations on rows and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame


def missing_segments(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Sealed segments of the primary that the replica lacks."""
    return primary.where("sealed").join(replica.select("first_lsn"), "first_lsn", "left_anti")


def imported(log: DataFrame, more: DataFrame) -> DataFrame:
    """Events of a log and of an import; numbers stay as they are, so overlaps show twice."""
    return log.unionByName(more)


def without_repeats(log: DataFrame) -> DataFrame:
    """One event for each sequence number."""
    return log.dropDuplicates(["lsn"])


def live_index(index: DataFrame, segments: DataFrame) -> DataFrame:
    """Index rows whose segment still exists."""
    return index.join(segments.select(segments["first_lsn"].alias("segment_lsn")), "segment_lsn", "left_semi")
