"""Tail reads of a log as Structured Streaming."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..errors import LsnRangeError
from ..plans.manifest import Manifest
from ..session import shared_folder

EVENT_DDL = "lsn long, ts_ns long, key binary, meta binary, payload binary, batch_first_lsn long, segment_lsn long"


def drain(stream: DataFrame) -> DataFrame:
    """What a stream has now, through a checkpointed query that ends when it has caught up."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/follow-{uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


class Folder(InputPartition):
    def __init__(self, uri: str, first: int, last: int):
        self.uri, self.first, self.last = uri, first, last


class LogStream(DataSource):
    """format("tidelog"): a stream of a log's committed events.

    Options: path; startLsn (inclusive; afterwards the checkpoint counts); failOnDataLoss (true): whether events that were
    deleted after the stream began and before it read them are an error.
    """

    @classmethod
    def name(cls) -> str:
        return "tidelog"

    def schema(self):
        return EVENT_DDL

    def streamReader(self, schema):
        return LogStreamReader(dict(self.options))


class LogStreamReader(DataSourceStreamReader):
    """Offsets are sequence numbers: the last one of a committed manifest. Each micro-batch reads the folders that can hold its range."""

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.start = int(options.get("startlsn", options.get("startLsn", 0)))
        self.strict = str(options.get("failondataloss", options.get("failOnDataLoss", "true"))).lower() != "false"

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root if ":" in self.root else f"file://{self.root}")

    def _newest(self) -> Manifest | None:
        from pyarrow import fs

        system, base = self._system()
        found = system.get_file_info(fs.FileSelector(f"{base}/manifests", allow_not_found=True))
        for f in sorted((f.path for f in found if f.base_name.startswith("v") and f.base_name.endswith(".json")), reverse=True):
            try:
                with system.open_input_stream(f) as stream:
                    return Manifest.of(stream.read())
            except Exception:  # noqa: BLE001, S112  a version that isn't whole doesn't count
                continue
        return None

    def initialOffset(self):
        return {"lsn": max(0, self.start - 1)}

    def latestOffset(self):
        m = self._newest()
        return {"lsn": max(m.last_lsn if m else 0, self.start - 1, 0)}

    def partitions(self, start, end):
        m = self._newest()
        _, base = self._system()
        begun = start["lsn"] > max(0, self.start - 1)
        if self.strict and begun and m and m.segments and start["lsn"] < end["lsn"] and m.segments[0]["first_lsn"] > start["lsn"] + 1:
            raise LsnRangeError(f"events {start['lsn'] + 1} to {m.segments[0]['first_lsn'] - 1} were deleted before they were read")
        wanted = [s for s in (m.segments if m else []) if s["last_lsn"] > start["lsn"] and s["first_lsn"] <= end["lsn"]]
        return [Folder(f"{base}/data/{f}", start["lsn"] + 1, end["lsn"]) for s in wanted for f in s["folders"]] if end["lsn"] > start["lsn"] else []

    def read(self, part):
        import pyarrow.dataset as ds

        system, _ = self._system()
        names = [c.split()[0] for c in EVENT_DDL.split(", ")]
        at = ds.field("lsn")
        yield from ds.dataset(part.uri, filesystem=system, format="parquet").scanner(columns=names, filter=(at >= part.first) & (at <= part.last)).to_batches()

    def commit(self, end):
        pass


def follow(spark: SparkSession, root: str, first: int = 0) -> DataFrame:
    """A stream of a log's events from first on; order within a micro-batch is the consumer's to ask for."""
    spark.dataSource.register(LogStream)
    return spark.readStream.format("tidelog").option("path", root).option("startLsn", str(first)).load()
