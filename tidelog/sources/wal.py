"""Files of binary frames: reading them as events, frames or segments, and writing them. Also as format("wal")."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..errors import ImportInvalid
from ..functions.columns import parse_segment_name
from ..schema import EVENT
from ..session import configure
from . import codec

EVENTS = "lsn long, ts_ns long, key binary, meta binary, payload binary, batch_first_lsn long, segment_lsn long"
FRAMES = f"segment_lsn long, offset long, {codec.HEADERS}, valid boolean"
SEGMENTS = "segment_lsn long, path string, first_lsn long, last_lsn long, size long, file_size long, first_ts long, last_ts long, frames long, corrupted boolean, truncated long"
POLICIES = ("skip", "fail", "recover")


def _frames(data: bytes, on_corrupt: str):
    """Good frames of a file. fail: a bad one raises; else the rest of the file is left out."""
    if on_corrupt not in POLICIES:
        raise ValueError(f"on_corrupt is one of {POLICIES}")
    return list(codec.walk(data)) if on_corrupt == "fail" else codec.good_prefix(data)[0]


def events_of(segment: int, data: bytes, on_corrupt: str, compression: str | None, first: int = 0, last: int = (1 << 63) - 1) -> Iterator[tuple]:
    c = codec.codec_of(compression)
    for at, h in _frames(data, on_corrupt):
        if h.first_lsn + h.count - 1 < first or h.first_lsn > last:
            continue
        for i, r in enumerate(codec.records_of(data, at, h, c)):
            if first <= h.first_lsn + i <= last:
                yield (h.first_lsn + i, *r, h.first_lsn, segment)


def frames_of(segment: int, data: bytes) -> Iterator[tuple]:
    for at, h in codec.good_prefix(data)[0]:
        yield (segment, at, h.first_lsn, h.first_lsn + h.count - 1, h.count, h.ts_ns, bool(h.flags & codec.PER_RECORD_TS), bool(h.flags & codec.COMPRESSED), h.size, True)


def segment_of(segment: int, path: str, data: bytes) -> tuple:
    """A scan of one file: what a recovery of it keeps, and how much it cuts off."""
    found, end, bad = codec.good_prefix(data)
    full = [h for _, h in found if h.count]
    stamps = [h.ts_ns for h in full]
    return (
        segment, path, full[0].first_lsn if full else None, max((h.first_lsn + h.count - 1 for h in full), default=None), end, len(data), next((t for t in stamps if t), 0), stamps[-1] if stamps else 0, len(found), bad, len(data) - end,
    )


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, segment_lsn, content of segment files; other names are left out."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").load(path)
    named = rows.select("path", parse_segment_name(F.element_at(F.split("path", "/"), -1)).alias("segment_lsn"), "content")
    return named.where("segment_lsn is not null")


def _each(files: DataFrame, make, schema: str) -> DataFrame:
    from pyspark.sql.types import StructType

    kinds = StructType.fromDDL(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        for batch in batches:
            for path, segment, content in zip(*(batch.column(c).to_pylist() for c in ("path", "segment_lsn", "content")), strict=True):
                rows = list(make(path, segment, content))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], names=arrow.names)

    return files.mapInArrow(run, schema)


def read_events(spark: SparkSession, path: str, on_corrupt: str = "skip", compression: str | None = None) -> DataFrame:
    """Events of segment files, by any file system that Spark reads; a file is one task.

    on_corrupt: skip (the rest of that file only, as replay does), fail (as following does), recover (as skip).
    """
    return _each(_files(spark, path), lambda p, s, data: events_of(s, data, on_corrupt, compression), EVENTS)


def read_files(spark: SparkSession, paths: list[str], compression: str | None = None) -> DataFrame:
    """Events of many segment files, all of whose frames must be good. segment_lsn: the first number in the file, whatever its name; file: which one it is."""
    found = _files(spark, paths)
    named = sorted(r["path"] for r in found.select("path").collect())
    if len(named) != len(paths):
        raise ImportInvalid(f"{len(named)} segment files at {len(paths)} paths")
    number = {p: i for i, p in enumerate(named)}

    def make(path: str, _: int, data: bytes) -> Iterator[tuple]:
        rows = list(events_of(0, data, "fail", compression))
        if not rows:
            raise ImportInvalid(f"no frames in {path}")
        first = min(r[0] for r in rows)
        return ((*r[:-1], first, number[path]) for r in rows)

    return _each(found, make, f"{EVENTS}, file int")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return _each(_files(spark, path), lambda p, s, data: frames_of(s, data), FRAMES)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """A recovery report: a row for each file."""
    return _each(_files(spark, path), lambda p, s, data: [segment_of(s, p, data)], SEGMENTS)


def write_segments(events: DataFrame, folder: str, compression: str | None = None) -> list[str]:
    """Writes a file of frames for each segment_lsn, in the folder (any URI that pyarrow opens); their paths."""

    def run(table):
        from pyarrow import fs

        rows = sorted(table.select(["frame", "first_lsn", "segment_lsn"]).to_pylist(), key=lambda r: r["first_lsn"])
        name = f"{rows[0]['segment_lsn']:020d}.wal"
        system, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/.{name}.tmp") as out:
            for r in rows:
                out.write(r["frame"])
        system.move(f"{base}/.{name}.tmp", f"{base}/{name}")
        return pa.table({"path": pa.array([f"{folder}/{name}"])})

    frames = codec.encode_frames(events.withColumn("_batch", F.struct("segment_lsn", "batch_first_lsn")), "_batch", compression)
    named = frames.select("first_lsn", "frame", F.col("_batch.segment_lsn").alias("segment_lsn"))
    return sorted(r["path"] for r in named.groupBy("segment_lsn").applyInArrow(lambda t: run(t), "path string").collect())


def register(spark: SparkSession) -> None:
    """Makes format("wal") known, with the settings that its pushed bounds need."""
    configure(spark)
    spark.dataSource.register(WalSource)


class WalSource(DataSource):
    """format("wal"): options path, view (events, frames, segments), onCorrupt, compression. Reads and writes paths that pyarrow opens."""

    @classmethod
    def name(cls) -> str:
        return "wal"

    def schema(self):
        return {"events": EVENTS, "frames": FRAMES, "segments": SEGMENTS}[self.options.get("view", "events")]

    def reader(self, schema):
        return WalReader(self.options)

    def writer(self, schema, overwrite):
        return WalWriter(self.options, [f.name for f in schema.fields])


class FilePart(InputPartition):
    def __init__(self, uri: str, segment: int):
        self.uri, self.segment = uri, segment


class WalReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)
        self.first, self.last = 0, (1 << 63) - 1

    def pushFilters(self, filters):
        """Bounds on lsn choose files and frames; all filters are still applied after."""
        for f in filters:
            if getattr(f, "attribute", None) == ("lsn",) and isinstance(f.value if hasattr(f, "value") else None, int):
                if isinstance(f, GreaterThanOrEqual | GreaterThan):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, LessThanOrEqual | LessThan):
                    self.last = min(self.last, f.value - isinstance(f, LessThan))
            yield f

    def partitions(self):
        from pyarrow import fs

        path = self.options["path"]
        system, base = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        found = system.get_file_info(fs.FileSelector(base)) if system.get_file_info(base).type == fs.FileType.Directory else [system.get_file_info(base)]
        names = sorted((int(f.base_name[:-4]), f.path) for f in found if f.base_name.endswith(".wal") and f.base_name[:-4].isdigit() and len(f.base_name) <= 24 and int(f.base_name[:-4]) > 0)
        if self.options.get("view", "events") == "events":  # the last file that starts at or before the bound, and those after it
            start = max([s for s, _ in names if s <= self.first], default=0)
            names = [(s, p) for s, p in names if start <= s <= self.last]
        prefix = path.partition("://")[0] + "://" if "://" in path else "file://"
        return [FilePart(prefix + p if not p.startswith(prefix) else p, s) for s, p in names]

    def read(self, part):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(part.uri)
        with system.open_input_stream(base) as f:
            data = f.read()
        view, on_corrupt = self.options.get("view", "events"), self.options.get("oncorrupt", self.options.get("onCorrupt", "skip"))
        if view == "events":
            yield from events_of(part.segment, data, on_corrupt, self.options.get("compression"), self.first, self.last)
        elif view == "frames":
            yield from frames_of(part.segment, data)
        else:
            yield segment_of(part.segment, part.uri, data)


class Written(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WalWriter(DataSourceWriter):
    """Each task writes a segment of its own rows, named after their first number; rows come sorted by lsn, batches whole in a task."""

    def __init__(self, options, columns):
        self.options, self.columns = dict(options), columns
        missing = {f.name for f in EVENT.fields[:6]} - set(columns)
        if missing:
            raise ImportInvalid(f"columns missing: {sorted(missing)}")

    def write(self, rows):
        from pyarrow import fs

        path, c = self.options["path"], codec.codec_of(self.options.get("compression"))
        system, base = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        system.create_dir(base, recursive=True)
        first, batch, records, out, name = None, None, [], None, ""

        def put():
            if records:
                out.write(codec.encode(records, first, c))

        for r in rows:
            if out is None:
                name = f"{base}/{r['lsn']:020d}.wal"
                out = system.open_output_stream(f"{name}.tmp")
            if r["batch_first_lsn"] != batch:
                put()
                batch, first, records = r["batch_first_lsn"], r["lsn"], []
            records.append(codec.Record(r["ts_ns"], r["key"] and bytes(r["key"]), r["meta"] and bytes(r["meta"]), bytes(r["payload"] or b"")))
        put()
        if out is not None:
            out.close()
        return Written([name] if name else [])

    def commit(self, messages):
        from pyarrow import fs

        path = self.options["path"]
        system, _ = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        for m in messages:
            for p in m.paths if m else ():
                system.move(f"{p}.tmp", p)

    def abort(self, messages):
        from pyarrow import fs

        path = self.options["path"]
        system, _ = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        for m in messages:
            for p in m.paths if m else ():
                system.delete_file(f"{p}.tmp")
