"""Column functions of the log: sizes, names, null rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the frame format: bytes around a batch, and of a record without and with its own timestamp.
FRAME_BYTES, RECORD_BYTES, STAMPED_RECORD_BYTES = 32, 8, 16
#: Widths of the format's length fields.
MOST_RECORDS, MOST_KEY_BYTES, MOST_META_BYTES = 65_535, 65_535, 65_535


def empty_to_null(c: Column) -> Column:
    """Keys and metas: empty is null."""
    return F.when(F.octet_length(c) > 0, c)


def null_to_empty(c: Column) -> Column:
    """Payloads: null is empty."""
    return F.coalesce(c, F.lit(b""))


def data_bytes(key: Column, meta: Column, payload: Column) -> Column:
    """Bytes of a record's three fields."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    return (size(key) + size(meta) + size(payload)).cast("long")


def record_bytes(stamped: Column) -> Column:
    """Bytes of a record's header."""
    return F.when(stamped, F.lit(STAMPED_RECORD_BYTES)).otherwise(F.lit(RECORD_BYTES)).cast("long")


def segment_name(lsn: Column) -> Column:
    """Name of a segment's file: the first sequence number, 20 digits."""
    return F.concat(F.lpad(lsn.cast("string"), 20, "0"), F.lit(".wal"))


def parse_segment_name(name: Column) -> Column:
    """First sequence number of a file name; null for other names and for 0."""
    n = F.regexp_extract(name, r"^(?:.*/)?([0-9]{1,20})\.wal$", 1).try_cast("bigint")
    return F.when(n > 0, n)


def event_time(ts_ns: Column) -> Column:
    """Timestamp of nanoseconds, cut to microseconds."""
    return F.timestamp_micros(F.call_function("div", ts_ns - F.pmod(ts_ns, F.lit(1000)), F.lit(1000)))
