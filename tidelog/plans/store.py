"""The native log: Parquet segments and versioned manifests.

An append numbers its rows, places its batches in segments after the open one, writes Parquet files and commits a manifest that
lists them. Readers see what a manifest lists and nothing else, so appends are atomic, recovery is reading the newest whole
manifest, and a reader that holds one has a snapshot. Deletion removes segments from the manifest; files go at vacuum().
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import BatchTooLarge, CommitConflict, CommitError, EmptyBatch, ImportInvalid, LogError, LsnRangeError, ManifestError, SegmentNotFound, WriterFailed
from ..functions.columns import FRAME_BYTES, MOST_KEY_BYTES, MOST_META_BYTES, empty_to_null, null_to_empty
from ..operators import frames as fr
from ..operators import retention
from ..operators.ordering import assign_lsn
from ..schema import EVENT, SEGMENT, SEGMENT_FIELDS
from ..session import Lifecycle, State, durable
from ..sources import codec, wal
from ..sources.files import Files
from .buffer import Buffer
from .manifest import Manifest, Manifests

#: Never; at each commit; after a time, a number of batches or a number of bytes since the last sync.
SYNC_MODES = ("never", "batch", "interval", "count", "size")
#: Counters that manifests carry.
COUNTERS = (
    *("events_written", "batches_written", "bytes_written", "bytes_synced", "sync_count", "last_sync_ns", "drops", "compressed_bytes", "corruptions"),
    *("rotation_count", "retention_deleted", "retention_bytes", "import_batches", "import_bytes"),
)


@dataclass
class Options:
    """Settings of a log; numbers that aren't positive count as unset."""

    batch_size: int = 100
    max_batch_bytes: int = fr.DEFAULT_BATCH_BYTES
    max_segment_bytes: int = fr.DEFAULT_SEGMENT_BYTES
    max_segment_age_ns: int | None = None
    max_segments: int | None = None
    retention_bytes: int | None = None
    retention_age_ns: int | None = None
    start_lsn: int = 1
    #: How long a snapshot that is never ended keeps its segments from deletion.
    pin_ttl_ns: int = 24 * 3600 * 10**9
    clock: Callable[[], int] = time.time_ns
    #: When a commit counts as synced: SYNC_MODES; the numbers say how often, for the last three.
    sync_mode: str = "batch"
    sync_interval_ns: int = 100_000_000
    sync_count: int = 1
    sync_bytes: int = 1
    #: Takes the rows of reads.index_feed for each commit; its errors are swallowed.
    indexer: Callable[[DataFrame], None] | None = None
    #: Makes the file operations; sources.files.Files by default.
    storage: Callable[[SparkSession], Files] = Files
    #: Codec by whose name exported frames are compressed, and their compressed bytes counted.
    compression: str | None = None

    def __post_init__(self):
        if self.sync_mode not in SYNC_MODES:
            raise ValueError(f"sync_mode is one of {SYNC_MODES}")
        self.sync_count, self.sync_bytes = max(1, self.sync_count), max(1, self.sync_bytes)
        for name in ("max_segments", "retention_bytes"):
            if (v := getattr(self, name)) is not None and v <= 0:
                setattr(self, name, None)
        self.max_batch_bytes = self.max_batch_bytes if self.max_batch_bytes > 0 else fr.DEFAULT_BATCH_BYTES
        self.max_segment_bytes = self.max_segment_bytes if self.max_segment_bytes > 0 else fr.DEFAULT_SEGMENT_BYTES


class Hooks:
    """Observers of a log. A hook is any method named below of any object given; its errors are swallowed."""

    NAMES = (
        *("on_start", "on_shutdown_start", "on_shutdown_done", "after_append", "before_write", "after_write", "before_sync", "after_sync"),
        *("on_corruption", "on_drop", "on_error", "on_recovery", "on_import", "on_rotation", "on_delete"),
    )

    def __init__(self, *observers):
        self.observers = observers

    def fire(self, name: str, *args) -> None:
        assert name in self.NAMES
        for o in self.observers:
            try:
                if (f := getattr(o, name, None)) is not None:
                    f(*args)
            except Exception:  # noqa: BLE001, S110  an observer must not stop the log
                pass


class Log:
    def __init__(self, spark: SparkSession, root: str, options: Options | None = None, *observers):
        self.spark, self.root, self.options, self.hooks = spark, root.rstrip("/"), options or Options(), Hooks(*observers)
        self.files, self.life = self.options.storage(spark), Lifecycle()
        self.unsynced = {"batches": 0, "bytes": 0}
        self.manifests = Manifests(self.files, self.root)
        self.manifest = self._recover()
        self.life.advance(State.RUNNING)
        self.hooks.fire("on_start")

    # --- opening and closing

    def _recover(self) -> Manifest:
        m = self.manifests.newest()
        bad = sum(1 for v in self.manifests.versions() if m is None or v > m.version)
        if m is None and not bad:
            m = Manifest(last_lsn=self.options.start_lsn - 1, first_lsn=self.options.start_lsn, counters=dict.fromkeys(COUNTERS, 0))
        elif m is None:
            m = self._rebuilt()
        if bad:
            m.version = max(self.manifests.versions())
            m.counters["corruptions"] = m.counters.get("corruptions", 0) + 1
            self.hooks.fire("on_corruption", self.manifests.folder, m.version)
        self.hooks.fire("on_recovery", {"segments": len(m.segments), "corrupted": bool(bad), "last_lsn": m.last_lsn})
        return m

    def _rebuilt(self) -> Manifest:
        """A manifest from what is stored, where none is whole."""
        data = [f"{self.root}/data/{n}" for n in self.files.names(f"{self.root}/data")]
        if not data:
            raise ManifestError("no whole manifest and no data")
        rows = self.spark.read.option("recursiveFileLookup", "true").schema(EVENT).parquet(*data)
        found = self._segment_rows(fr.frames(rows.withColumn("batch_no", F.struct("segment_lsn", "batch_first_lsn"))).withColumn("segment_lsn", F.col("batch_no.segment_lsn")))
        m = Manifest(segments=[], counters=dict.fromkeys(COUNTERS, 0))
        folders: dict[str, list[str]] = {}
        for d in data:
            for n in self.files.names(d):
                folders.setdefault(n, []).append(f"{d.rpartition('/')[2]}/{n}")
        for s in found:
            m.segments.append(s | {"sealed": True, "created_at": s["first_ts"], "folders": folders[f"segment={s['first_lsn']}"]})
        m.segments.sort(key=lambda s: s["first_lsn"])
        m.last_lsn = max(s["last_lsn"] for s in m.segments)
        return m

    def shutdown(self) -> None:
        """No more writes; what is written is committed already."""
        began = self.options.clock()
        self.life.advance(State.DRAINING)
        self.hooks.fire("on_shutdown_start")
        self.life.advance(State.CLOSED)
        self.hooks.fire("on_shutdown_done", self.options.clock() - began)

    def close(self) -> None:
        if self.life.state is not State.CLOSED:
            self.life.advance(State.CLOSED)

    # --- writing

    def append(self, rows: DataFrame, order: list[str] | None = None) -> int:
        """Appends rows (key, meta, payload, optionally ts_ns) in order; the last number given.

        Rows are numbered in sorted ranges; batches are batch_size of them. A batch over max_batch_bytes refuses the append.
        """
        self.life.must_write()
        if order is None and "lsn" not in rows.columns:
            rows, order = rows.withColumn("_place", F.monotonically_increasing_id()), ["_place"]
        m = self._fresh()
        base, now = m.last_lsn, self.options.clock()
        ts = F.coalesce(F.col("ts_ns"), F.lit(now)) if "ts_ns" in rows.columns else F.lit(now)
        numbered = durable(assign_lsn(rows, order, base) if order else rows)
        binary = lambda c: F.col(c).cast("binary") if c in rows.columns else F.lit(None).cast("binary")
        events = numbered.select(
            "lsn", ts.cast("long").alias("ts_ns"), empty_to_null(binary("key")).alias("key"), empty_to_null(binary("meta")).alias("meta"), null_to_empty(binary("payload")).alias("payload"),
            (F.lit(base + 1) + F.call_function("div", F.col("lsn") - (base + 1), F.lit(self.options.batch_size)) * self.options.batch_size).cast("long").alias("batch_first_lsn"),
        )
        return self._write(m, events)

    def buffer(self, **settings) -> Buffer:
        """A buffer whose batches are numbered as they come and committed together when it is flushed; drops are counted."""
        self.life.must_write()

        def write(rows: list[tuple]) -> None:
            events = self.spark.createDataFrame(rows, "lsn long, ts_ns long, key binary, meta binary, payload binary, batch_first_lsn long")
            m = self._fresh()
            self._count(m, {"drops": held.drops - told[0]})
            told[0] = held.drops
            self._write(m, events, plain=held.plain)

        told = [0]
        held = Buffer(write, self._fresh().last_lsn + 1, max_batch_bytes=self.options.max_batch_bytes, on_drop=lambda n: self.hooks.fire("on_drop", n), **settings)
        return held

    def _write(self, m: Manifest, events: DataFrame, write: Callable[..., int] | None = None, **how) -> int:
        """Places, writes and commits numbered events; observers are told of what goes wrong."""
        try:
            return (write or self._placed)(m, events, **how)
        except (CommitConflict, CommitError):
            raise  # told of by the commit
        except Exception as e:
            self.hooks.fire("on_error", e)
            if isinstance(e, LogError):
                raise
            raise WriterFailed(str(e)[:500]) from e

    def _head(self, batches: DataFrame) -> Row:
        """Counts and bounds of the batches to write."""
        head = batches.agg(F.count(F.lit(1)).alias("batches"), F.sum("cnt").alias("events"), F.max("size").alias("largest"), F.sum("size").alias("bytes"), F.max("last_lsn").alias("last"), F.min("first_lsn").alias("first")).first()
        if not head["batches"]:
            raise EmptyBatch("no rows")
        if head["largest"] > self.options.max_batch_bytes:
            raise BatchTooLarge(f"{head['largest']} bytes in a batch")
        return head

    def _store(self, events: DataFrame, size: int, by: list[str]) -> str:
        """Writes events, sorted, to files of each segment; the folder's name."""
        folder = uuid4().hex
        self.hooks.fire("before_write", size)
        began = self.options.clock()
        events.repartitionByRange(*by).sortWithinPartitions(*by).select(*[f.name for f in EVENT.fields], "segment").write.partitionBy("segment").parquet(f"{self.root}/data/{folder}")
        self.hooks.fire("after_write", size, self.options.clock() - began)
        return folder

    @staticmethod
    def _sorted(m: Manifest, last: int) -> None:
        """Puts the entries in order: only the last one stays open, and none is empty."""
        m.segments.sort(key=lambda s: s["first_lsn"])
        for s in m.segments[:-1]:
            s["sealed"] = True
        m.segments = [s for s in m.segments if s["folders"]]
        m.last_lsn = max(m.last_lsn, last)
        m.first_lsn = min(s["first_lsn"] for s in m.segments)

    def _placed(self, m: Manifest, events: DataFrame, imported: bool = False, plain: Iterable[int] = ()) -> int:
        batches = durable(fr.frames(events, "batch_first_lsn"))
        head = self._head(batches)
        if events.where((F.octet_length("key") > MOST_KEY_BYTES) | (F.octet_length("meta") > MOST_META_BYTES)).limit(1).count():
            raise BatchTooLarge("a key or meta is too long")
        opened = None if not m.segments or m.segments[-1]["sealed"] else m.segments[-1]
        if opened and self.options.max_segment_age_ns and self.options.clock() - opened["created_at"] >= self.options.max_segment_age_ns:
            opened["sealed"] = True
            opened = None
        limit = self.options.max_segment_bytes
        batches = durable(fr.place(batches, limit, (opened["first_lsn"], opened["size"]) if opened else None))
        segment_of = batches.select("batch_first_lsn", "segment_lsn", F.col("segment_lsn").alias("segment"))
        events = events.drop("segment_lsn").join(segment_of, "batch_first_lsn")
        folder = self._store(events, head["bytes"], ["lsn"])
        now = self.options.clock()
        rotations = []
        for s in self._segment_rows(batches):
            if opened and s["first_lsn"] == opened["first_lsn"]:
                opened.update(last_lsn=max(opened["last_lsn"], s["last_lsn"]), size=opened["size"] + s["size"], last_ts=s["last_ts"], first_ts=opened["first_ts"] or s["first_ts"])
                opened["folders"].append(f"{folder}/segment={s['first_lsn']}")
                entry = opened
            else:
                entry = s | {"created_at": now, "folders": [f"{folder}/segment={s['first_lsn']}"], "sealed": False}
                m.segments.append(entry)
            if entry["size"] >= limit:
                entry["sealed"] = True
                rotations.append(entry)
        self._sorted(m, head["last"])
        count = {"bytes_written": head["bytes"], "rotation_count": len(rotations), "events_written": head["events"], "batches_written": head["batches"]}
        if imported:
            count |= {"import_batches": head["batches"], "import_bytes": head["bytes"]}
        elif self.options.compression:
            count["compressed_bytes"] = self._compressed(events.where(~F.col("batch_first_lsn").isin(*plain)) if plain else events)
        self._count(m, count)
        if rotations:
            self._retire(m)
        self._commit(m, head["bytes"], head["batches"])
        for s in rotations:
            self.hooks.fire("on_rotation", dict(s))
        self.hooks.fire("after_append", head["first"], head["last"], head["events"])
        if imported:
            self.hooks.fire("on_import", head["first"], head["last"], head["bytes"])
        if self.options.indexer is not None:
            rows = events.select("lsn", "ts_ns", "key", "meta", "batch_first_lsn").join(batches.select("batch_first_lsn", "offset", "segment_lsn"), "batch_first_lsn").drop("batch_first_lsn")
            try:
                self.options.indexer(rows)
            except Exception:  # noqa: BLE001, S110  as with hooks
                pass
        return head["last"]

    def _taken_in(self, m: Manifest, events: DataFrame) -> int:
        """Writes and commits the events of whole files, each file a sealed segment; files that begin at one number are written one after the other."""
        batches = durable(fr.frames(events.withColumn("_batch", F.struct("file", "segment_lsn", "batch_first_lsn")), "_batch").select("*", "_batch.file", "_batch.segment_lsn"))
        head = self._head(batches)
        turns: list[dict[int, int]] = []
        for r in batches.select("segment_lsn", "file").distinct().orderBy("segment_lsn", "file").collect():
            turn = next((t for t in turns if r["segment_lsn"] not in t), None)
            if turn is None:
                turns.append(turn := {})
            turn[r["segment_lsn"]] = r["file"]
        entries = []
        for turn in turns:
            mine = lambda rows: rows
            if len(turns) > 1:
                files = F.broadcast(self.spark.createDataFrame([(f,) for f in turn.values()], "file int"))
                mine = lambda rows, files=files: rows.join(files, "file", "left_semi")
            found = self._segment_rows(mine(batches))
            folder = self._store(mine(events).withColumn("segment", F.col("segment_lsn")), sum(s["size"] for s in found), ["segment_lsn", "lsn"])
            entries += [s | {"created_at": s["first_ts"], "folders": [f"{folder}/segment={s['first_lsn']}"], "sealed": True} for s in found]
        m.segments += entries
        self._sorted(m, head["last"])
        self._count(m, {"bytes_written": head["bytes"], "import_batches": head["batches"], "import_bytes": head["bytes"]})
        self._commit(m, head["bytes"], head["batches"])
        for s in entries:
            self.hooks.fire("on_import", s["first_lsn"], s["last_lsn"], s["size"])
        return head["last"]

    def _compressed(self, events: DataFrame) -> int:
        """Bytes that the records of compressed frames take: those that the codec makes smaller."""
        heads = codec.scan_frames(codec.encode_frames(events, "batch_first_lsn", self.options.compression).select("frame"))
        return heads.where("compressed").agg(F.coalesce(F.sum(F.col("size") - FRAME_BYTES), F.lit(0)).alias("n")).first()["n"]

    @staticmethod
    def _segment_rows(batches: DataFrame) -> list[dict]:
        """Entries of the segments of some frames; a row for each segment reaches the driver."""
        each = batches.groupBy("segment_lsn").agg(
            F.max("last_lsn").alias("last_lsn"), F.sum("size").alias("size"), F.coalesce(F.min_by("frame_ts", F.when(F.col("frame_ts") != 0, F.col("first_lsn"))), F.lit(0)).alias("first_ts"), F.max_by("frame_ts", "first_lsn").alias("last_ts"),
        )
        return [{"first_lsn": r["segment_lsn"], "last_lsn": r["last_lsn"], "size": r["size"], "first_ts": r["first_ts"], "last_ts": r["last_ts"]} for r in each.orderBy("segment_lsn").collect()]

    def rotate(self) -> None:
        """Seals the open segment and opens the next at the following number. One that is empty is told of, and replaced."""
        self.life.must_write()
        m, now = self._fresh(), self.options.clock()
        if m.segments and not m.segments[-1]["sealed"]:
            told = m.segments[-1] if m.segments[-1]["folders"] else m.segments.pop()
        else:
            told = self._empty(m.last_lsn + 1, now)
        told["sealed"] = True
        m.segments.append(self._empty(m.last_lsn + 1, now))
        self._count(m, {"rotation_count": 1})
        self._retire(m)
        self._commit(m, 0)
        self.hooks.fire("on_rotation", dict(told))

    @staticmethod
    def _empty(first_lsn: int, now: int) -> dict:
        """The entry of an open segment without frames."""
        return {"first_lsn": first_lsn, "last_lsn": first_lsn - 1, "size": 0, "created_at": now, "first_ts": 0, "last_ts": 0, "sealed": False, "folders": []}

    def flush(self) -> None:
        """Appends are committed when they return; what the sync mode left counts as synced now."""
        self.life.must_write()
        if self.unsynced["bytes"]:
            m = self._fresh()
            self._sync(m, self.options.clock())
            self.manifest = self.manifests.commit(m)

    sync = flush

    def wait_durable(self, lsn: int, timeout_s: float = 60, poll_s: float = 0.2) -> None:
        """Returns when a committed manifest has the number."""
        self.life.must_read()
        end = time.monotonic() + timeout_s
        while (m := self.manifests.newest()) is None or m.last_lsn < lsn:
            if time.monotonic() > end:
                raise TimeoutError(f"number {lsn} isn't committed")
            time.sleep(poll_s)

    def _fresh(self) -> Manifest:
        """The newest manifest, to change and commit."""
        newest = self.manifests.newest()
        if newest is not None and newest.version >= self.manifest.version:
            self.manifest = newest
        return Manifest.of(self.manifest.to_bytes())

    def _count(self, m: Manifest, more: dict[str, int]) -> None:
        for k, v in more.items():
            m.counters[k] = m.counters.get(k, 0) + int(v)

    def _due(self, m: Manifest, now: int) -> bool:
        """Whether the sync mode asks for a sync now."""
        o, left = self.options, self.unsynced
        return {
            "never": False,
            "batch": True,
            "interval": now - m.counters.get("last_sync_ns", 0) >= o.sync_interval_ns,
            "count": left["batches"] >= o.sync_count,
            "size": left["bytes"] >= o.sync_bytes,
        }[o.sync_mode]

    def _sync(self, m: Manifest, now: int) -> None:
        self.hooks.fire("before_sync")
        self._count(m, {"bytes_synced": self.unsynced["bytes"], "sync_count": 1})
        m.counters["last_sync_ns"] = now
        self.hooks.fire("after_sync", self.unsynced["bytes"], self.options.clock() - now)
        self.unsynced = {"batches": 0, "bytes": 0}

    def _commit(self, m: Manifest, written: int, batches: int = 0) -> None:
        """Commits the manifest. Files are whole by then in every sync mode; the mode says which commits count as syncs."""
        now = self.options.clock()
        before = dict(self.unsynced)
        self.unsynced = {"batches": before["batches"] + batches, "bytes": before["bytes"] + written}
        if self._due(m, now):
            self._sync(m, now)
        try:
            self.manifest = self.manifests.commit(m)
        except Exception as e:
            self.unsynced = before
            self.hooks.fire("on_error", e)
            if isinstance(e, LogError):
                raise
            raise CommitError(str(e)[:500]) from e

    # --- reading

    def segments(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(s[f] for f in SEGMENT_FIELDS) for s in self.manifest.segments], SEGMENT)

    def read(self, first: int = 0, last: int | None = None, manifest: Manifest | None = None) -> DataFrame:
        """Events from first to last (inclusive) of a manifest; only segments that can hold them are listed."""
        self.life.must_read()
        if last is not None and last < first:
            raise LsnRangeError(f"range ends at {last}, before its start {first}")
        m = manifest or self.manifest
        paths = [f"{self.root}/data/{f}" for s in m.segments if s["last_lsn"] >= first and (last is None or s["first_lsn"] <= last) for f in s["folders"]]
        rows = self.spark.read.schema(EVENT).parquet(*paths) if paths else self.spark.createDataFrame([], EVENT)
        rows = rows.where(F.col("lsn") >= first)
        return rows if last is None else rows.where(F.col("lsn") <= last)

    def refresh(self) -> None:
        """Takes up what other writers have committed."""
        self._fresh()

    @contextmanager
    def snapshot(self) -> Iterator[Snapshot]:
        """A version to read and to compact up to a checkpoint; no driver deletes its segments meanwhile."""
        self.life.must_read()
        key = uuid4().hex
        snap = Snapshot(self, Manifest.of(self.manifest.to_bytes()), key)
        held = {"at": self.options.clock(), "segments": [s["first_lsn"] for s in snap.manifest.segments]}
        self.files.write(f"{self.root}/pins/{key}.json", json.dumps(held).encode())
        try:
            yield snap
        finally:
            self.files.delete(f"{self.root}/pins/{key}.json")

    def open_segment(self, first_lsn: int) -> tuple[DataFrame, dict]:
        """Events and entry of one sealed segment."""
        self.life.must_read()
        for s in self.manifest.segments:
            if s["first_lsn"] == first_lsn and s["sealed"]:
                return self.spark.read.schema(EVENT).parquet(*[f"{self.root}/data/{f}" for f in s["folders"]]), dict(s)
        raise SegmentNotFound(str(first_lsn))

    def export_segment(self, first_lsn: int, folder: str, compression: str | None = None) -> str:
        """Writes a sealed segment as a file of binary frames; its path."""
        return self.export_segments([first_lsn], folder, compression)[0]

    def export_segments(self, first_lsns: list[int], folder: str, compression: str | None = None) -> list[str]:
        """Writes sealed segments as files of binary frames, side by side; their paths in order of number."""
        self.life.must_read()
        sealed = {s["first_lsn"]: s for s in reversed(self.manifest.segments) if s["sealed"]}
        if missing := [n for n in first_lsns if n not in sealed]:
            raise SegmentNotFound(", ".join(map(str, missing[:10])))
        paths = [f"{self.root}/data/{f}" for n in dict.fromkeys(first_lsns) for f in sealed[n]["folders"]]
        return wal.write_segments(self.spark.read.schema(EVENT).parquet(*paths), folder, compression) if paths else []

    # --- imports

    def import_segment(self, path: str, compression: str | None = None) -> int:
        """Takes in a file of frames as a sealed segment with its own numbers; refused whole if a frame is bad."""
        return self.import_segments([path], compression)

    def import_segments(self, paths: list[str], compression: str | None = None) -> int:
        """Takes in files of frames, each as a sealed segment with its own numbers, in one commit; all are refused if a frame is bad."""
        self.life.must_write()
        if len(set(paths)) < max(1, len(paths)):
            raise ImportInvalid("no file, or one named twice")
        try:
            events = durable(wal.read_files(self.spark, paths, compression))
        except Exception as e:
            raise ImportInvalid(str(e)[:500]) from e
        return self._write(self._fresh(), events, self._taken_in)

    def import_batch(self, frame: bytes, compression: str | None = None) -> int:
        """Takes in one frame with its own numbers."""
        self.life.must_write()
        try:
            h, records = codec.decode(frame, 0, codec.codec_of(compression))
        except Exception as e:
            raise ImportInvalid(str(e)) from e
        if h.size != len(frame) or not h.count:
            raise ImportInvalid("not one frame of records")
        rows = [(h.first_lsn + i, *r, h.first_lsn) for i, r in enumerate(records)]
        events = self.spark.createDataFrame(rows, "lsn long, ts_ns long, key binary, meta binary, payload binary, batch_first_lsn long")
        return self._write(self._fresh(), events, imported=True)

    # --- deletion

    def _pins(self, but: str | None = None) -> list[set[int]]:
        """First numbers of the segments that snapshots of any driver hold."""
        out = []
        for name in self.files.names(f"{self.root}/pins"):
            try:
                pin = json.loads(self.files.read(f"{self.root}/pins/{name}"))
            except Exception:  # noqa: BLE001, S112  ended meanwhile
                continue
            if self.options.clock() - pin["at"] > self.options.pin_ttl_ns:
                self.files.delete(f"{self.root}/pins/{name}")
            elif name != f"{but}.json":
                out.append(set(pin["segments"]))
        return out

    def _held(self, but: str | None = None) -> set[int]:
        return set().union(*self._pins(but))

    def _drop(self, m: Manifest, gone: list[dict]) -> int:
        keys = {s["first_lsn"] for s in gone}
        m.segments = [s for s in m.segments if s["first_lsn"] not in keys]
        self._count(m, {"retention_deleted": len(gone), "retention_bytes": sum(s["size"] for s in gone)})
        for s in gone:
            self.hooks.fire("on_delete", dict(s))
        return len(gone)

    def _retire(self, m: Manifest) -> None:
        o = self.options
        self._drop(m, retention.retire(m.segments, o.clock(), o.max_segments, o.retention_age_ns, o.retention_bytes, self._held()))

    def _delete(self, rule: Callable[[dict], bool], but: str | None = None) -> int:
        self.life.must_write()
        m, held = self._fresh(), self._held(but)
        gone = [s for s in m.segments[:-1] if s["sealed"] and s["first_lsn"] not in held and rule(s)]
        if gone:
            self._drop(m, gone)
            self._commit(m, 0)
        return len(gone)

    def delete_before(self, lsn: int, but: str | None = None) -> int:
        """Deletes sealed segments that end before a number; how many. but: a snapshot whose hold doesn't count."""
        return self._delete(lambda s: s["last_lsn"] < lsn, but)

    def delete_older_than(self, ts_ns: int, but: str | None = None) -> int:
        return self._delete(lambda s: s["last_ts"] < ts_ns, but)

    def vacuum(self) -> int:
        """Deletes data folders that the newest manifest doesn't list and no snapshot holds. Not while another writer appends."""
        m = self._fresh()
        if self._pins():
            return 0
        listed = {f for s in m.segments for f in s["folders"]}
        n = 0
        for d in self.files.names(f"{self.root}/data"):
            parts = [p for p in self.files.names(f"{self.root}/data/{d}") if p.startswith("segment=")]
            for p in parts:
                if f"{d}/{p}" not in listed:
                    self.files.delete(f"{self.root}/data/{d}/{p}")
                    n += 1
            if all(f"{d}/{p}" not in listed for p in parts):
                self.files.delete(f"{self.root}/data/{d}")
        return n

    # --- counters

    def stats(self, queue_size: int = 0) -> DataFrame:
        """One row: counters of the manifest, and gauges, which are zero when the log is closed."""
        m, live = self.manifest, self.life.state is not State.CLOSED
        active = m.segments[-1]["size"] if m.segments and not m.segments[-1]["sealed"] else 0
        row = {c: m.counters.get(c, 0) for c in COUNTERS}
        row |= {"queue_size": queue_size, "total_size": sum(s["size"] for s in m.segments) * live, "active_segment_size": active * live, "segment_count": len(m.segments) * live}
        row |= {"first_lsn": m.first_lsn, "last_lsn": m.last_lsn}
        return self.spark.createDataFrame([(*row.values(), self.life.state.name)], ", ".join(f"{k} long" for k in row) + ", state string")


class Snapshot:
    """A version of a log inside Log.snapshot()."""

    def __init__(self, log: Log, manifest: Manifest, key: str):
        self.log, self.manifest, self.key, self.lsn, self.ts = log, manifest, key, None, None

    def read(self, first: int = 0, last: int | None = None) -> DataFrame:
        return self.log.read(first, last, self.manifest)

    def segments(self) -> list[dict]:
        return [dict(s) for s in self.manifest.segments]

    def checkpoint(self, lsn: int) -> None:
        self.lsn = lsn

    def checkpoint_older_than(self, ts_ns: int) -> None:
        self.ts = ts_ns

    def compact(self) -> int:
        """Deletes whole segments before the checkpoints; what this snapshot alone holds may go. Without a checkpoint nothing does."""
        n = self.log.delete_before(self.lsn, self.key) if self.lsn is not None else 0
        return n + (self.log.delete_older_than(self.ts, self.key) if self.ts is not None else 0)
