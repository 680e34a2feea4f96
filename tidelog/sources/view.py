"""Any table with a dense integer id as a log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LsnRangeError


@dataclass(frozen=True)
class LogView:
    """table: its rows; lsn = table[id_column] + shift; batches of batch_size ids.

    Bounds on the sequence number are said on the stored id, so that they reach the files' statistics.
    """

    table: DataFrame
    id_column: str
    ts_ns: Column
    key: Column
    meta: Column
    payload: Column
    shift: int = 1
    batch_size: int = 100

    def events(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """lsn, ts_ns, key, meta, payload, batch_no of the events from first to last, both inclusive."""
        if first is not None and last is not None and last < first:
            raise LsnRangeError(f"range ends at {last}, before its start {first}")
        at, rows = F.col(self.id_column), self.table
        if first is not None:
            rows = rows.where(at >= first - self.shift)
        if last is not None:
            rows = rows.where(at <= last - self.shift)
        return rows.select(
            (at + self.shift).alias("lsn"),
            self.ts_ns.alias("ts_ns"),
            F.when(F.octet_length(self.key) > 0, self.key).alias("key"),
            F.when(F.octet_length(self.meta) > 0, self.meta).alias("meta"),
            F.coalesce(self.payload, F.lit("")).alias("payload"),
            F.call_function("div", at, F.lit(self.batch_size)).alias("batch_no"),
        )


def event_log(spark: SparkSession, sf_dir: str, batch_size: int = 100) -> LogView:
    """The events table as a log."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return LogView(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", micros * 1000, F.col("user_id").cast("string"), F.col("event_type"), F.col("props"), batch_size=batch_size)
