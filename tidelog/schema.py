"""Row types of the engine."""

from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("lsn", T.LongType(), False),
        T.StructField("ts_ns", T.LongType(), False),
        T.StructField("key", T.BinaryType()),
        T.StructField("meta", T.BinaryType()),
        T.StructField("payload", T.BinaryType(), False),
        T.StructField("batch_first_lsn", T.LongType(), False),
        T.StructField("segment_lsn", T.LongType(), False),
    ]
)
FRAME = "first_lsn long, last_lsn long, cnt long, frame_ts long, per_record_ts boolean, compressed boolean, size long"
SEGMENT = "first_lsn long, last_lsn long, size long, created_at long, first_ts long, last_ts long, sealed boolean"
SEGMENT_FIELDS = ("first_lsn", "last_lsn", "size", "created_at", "first_ts", "last_ts", "sealed")
