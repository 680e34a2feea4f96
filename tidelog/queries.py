"""The engine's operators as queries over the test tables, with equal DuckDB statements."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.columns import event_time, parse_segment_name, segment_name
from .operators import frames as fr
from .operators import ordering, reads, replication, retention
from .plans.store import Log, Options
from .schema import SEGMENT as SEGMENT_DDL
from .schema import SEGMENT_FIELDS
from .session import durable, shared_folder
from .sources import codec, wal
from .sources.files import Files
from .sources.view import LogView, event_log

SEGMENT = 65_536


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).events()


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.place(fr.frames(_log(spark, sf_dir)), SEGMENT)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.segments(_placed(spark, sf_dir), SEGMENT)


def replay_from(spark, sf_dir):
    return event_log(spark, sf_dir).events(first=5001).drop("batch_no")


def replay_range(spark, sf_dir):
    return event_log(spark, sf_dir).events(first=301, last=500).drop("batch_no")


def replay_batches(spark, sf_dir):
    return reads.batch_summaries(event_log(spark, sf_dir).events(first=450), 450).drop("batch_no")


def replay_batch_events(spark, sf_dir):
    rows = reads.replay_batches(_log(spark, sf_dir), 450)
    return rows.select("first_lsn", "cnt", F.array_join(F.transform("events", lambda e: F.concat_ws("|", e["lsn"], e["key"], e["meta"])), ",").alias("events"))


def iterate_events(spark, sf_dir):
    """What an ordered iteration yields: each event with its position."""
    rows = ordering.assign_lsn(reads.replay(_log(spark, sf_dir), 101).select("lsn", "key").withColumnRenamed("lsn", "at"), ["at"], 0)
    return rows.select(F.col("lsn").alias("position"), F.col("at").alias("lsn"), "key")


def event_times(spark, sf_dir):
    return _log(spark, sf_dir).select("lsn", F.unix_micros(event_time(F.col("ts_ns"))).alias("us"))


def frames(spark, sf_dir):
    return fr.frames(_log(spark, sf_dir)).drop("batch_no")


def frames_of_orders(spark, sf_dir):
    """Frames of a log whose timestamps go back and forth, one frame a batch of one timestamp or several."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select(
        F.col("o_orderkey").alias("lsn"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("ts_ns"), F.col("o_orderpriority").alias("key"), F.lit(None).cast("string").alias("meta"), F.col("o_orderstatus").alias("payload"), F.call_function("div", F.col("o_orderkey"), F.lit(3)).alias("batch_no")
    )
    return fr.frames(rows).drop("batch_no")


def sparse_index(spark, sf_dir):
    return _placed(spark, sf_dir).select("segment_lsn", "first_lsn", "offset", "frame_ts")


def segments(spark, sf_dir):
    return _segments(spark, sf_dir)


def seek_lsn(spark, sf_dir):
    probes = spark.createDataFrame([(p,) for p in (0, 1, 5, 100, 101, 555, 999, 10**12)], "probe long")
    return reads.seek_lsn(fr.frames(_log(spark, sf_dir)), probes)


def seek_ts(spark, sf_dir):
    f = fr.frames(_log(spark, sf_dir))
    probes = f.where("first_lsn in (1, 301, 501)").select((F.col("frame_ts") + 1).alias("probe_ts")).unionByName(spark.createDataFrame([(0,), (2**62,)], "probe_ts long"))
    return reads.seek_ts(f, probes)


def _bounded(spark, sf_dir) -> DataFrame:
    """Segments, with _third and _middle: the numbers a third and half through the log; _ts: the time half through the segments."""
    s = _segments(spark, sf_dir)
    a, b = F.min("first_lsn"), F.max("last_lsn")
    div = lambda x, n: F.call_function("div", x, F.lit(n))
    bounds = s.agg((a + div(b - a, 3)).alias("_third"), (a + div(b - a, 2)).alias("_middle"), div(F.min("last_ts") + F.max("last_ts"), 2).alias("_ts"))
    return s.crossJoin(F.broadcast(bounds))


def _plain(bounded: DataFrame) -> DataFrame:
    return bounded.drop("_third", "_middle", "_ts")


def delete_before(spark, sf_dir):
    return _plain(retention.delete_before(_bounded(spark, sf_dir), F.col("_middle")))


def delete_older_than(spark, sf_dir):
    return _plain(retention.delete_older_than(_bounded(spark, sf_dir), F.col("_ts")))


def retention_count(spark, sf_dir):
    return retention.retain_count(_segments(spark, sf_dir), 3)


def retention_size(spark, sf_dir):
    return retention.retain_size(_segments(spark, sf_dir), 200_000)


def compact_checkpoint(spark, sf_dir):
    """Checkpoints by number and by time; the later one decides."""
    return _plain(retention.compact(_bounded(spark, sf_dir), F.col("_third"), F.col("_ts")))


def _bounds(log: LogView) -> tuple[int, int]:
    """First and last number of a log."""
    at = log.table.agg(F.min(log.id_column).alias("a"), F.max(log.id_column).alias("b")).first()
    return (at["a"] + log.shift, at["b"] + log.shift) if at["a"] is not None else (log.shift, log.shift)


def _thirds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The whole log in two parts: up to two thirds, and from one third on."""
    v = event_log(spark, sf_dir)
    a, b = _bounds(v)
    return v.events(last=a + (b - a) * 2 // 3), v.events(first=a + (b - a) // 3)


def snapshot_read(spark, sf_dir):
    """A snapshot pinned at two thirds of the log."""
    return _thirds(spark, sf_dir)[0].select("lsn", "key", "payload")


def import_overlap(spark, sf_dir):
    both = replication.imported(*_thirds(spark, sf_dir))
    return both.groupBy("lsn").agg(F.count(F.lit(1)).alias("copies"), F.min("payload").alias("payload"))


def import_distinct(spark, sf_dir):
    return replication.without_repeats(replication.imported(*_thirds(spark, sf_dir))).select("lsn", "payload")


def replica_missing_segments(spark, sf_dir):
    s = _segments(spark, sf_dir)
    return replication.missing_segments(s, s.where("first_lsn div 100 % 3 = 0")).select("first_lsn", "last_lsn", "size")


def index_feed(spark, sf_dir):
    return reads.index_feed(_log(spark, sf_dir), _placed(spark, sf_dir))


def index_lookup(spark, sf_dir):
    log = _log(spark, sf_dir)
    return reads.index_lookup(log.select("lsn", "key"), log, "7").select("lsn", "key", "meta", "payload")


def live_index(spark, sf_dir):
    """Index rows that a deletion before the middle leaves valid, counted by segment."""
    s = retention.delete_before(_bounded(spark, sf_dir), F.col("_middle"))
    return replication.live_index(reads.index_feed(_log(spark, sf_dir), _placed(spark, sf_dir)), s).groupBy("segment_lsn").agg(F.count(F.lit(1)).alias("rows"))


def latest_per_key(spark, sf_dir):
    return reads.latest_per_key(_log(spark, sf_dir))


def assign_lsn(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return ordering.assign_lsn(o, ["o_orderkey"], 1000)


def drop_gaps(spark, sf_dir):
    return reads.gaps(_log(spark, sf_dir).where("batch_no % 7 <> 3"))


def batch_too_large(spark, sf_dir):
    """Batches over the mean size."""
    f = fr.frames(_log(spark, sf_dir))
    mean = f.agg(F.call_function("div", F.sum("size"), F.count(F.lit(1))).alias("_mean"))
    return fr.too_large(f.crossJoin(F.broadcast(mean)), F.col("_mean")).select("first_lsn", "size")


def recover_prefix(spark, sf_dir):
    """The open segment with a bad frame half through it."""
    p = _placed(spark, sf_dir)
    last = p.agg(F.max("segment_lsn").alias("m"))
    active = p.join(F.broadcast(last), p["segment_lsn"] == last["m"]).drop("m")
    middle = active.agg(F.call_function("div", F.min("batch_no") + F.max("batch_no"), F.lit(2)).alias("_middle"))
    return fr.recovered(active.crossJoin(F.broadcast(middle)), F.col("batch_no") == F.col("_middle")).select("segment_lsn", "offset", "first_lsn", "last_lsn")


def replay_skip_rest(spark, sf_dir):
    kept = fr.recovered(_placed(spark, sf_dir), F.col("batch_no") % 11 == 4)
    return _log(spark, sf_dir).join(kept.select("batch_no"), "batch_no", "left_semi").select("lsn", "key")


def stats(spark, sf_dir):
    log = _log(spark, sf_dir)
    f = fr.frames(log)
    return fr.log_stats(log, f, fr.segments(fr.place(f, SEGMENT), SEGMENT))


def segment_names(spark, sf_dir):
    named = _segments(spark, sf_dir).select("first_lsn", segment_name(F.col("first_lsn")).alias("name"))
    return named.withColumn("parsed", parse_segment_name(F.col("name")))


def wal_roundtrip(spark, sf_dir):
    """Encoded into binary frames and decoded again."""
    log = _log(spark, sf_dir)
    binary = log.select("lsn", "ts_ns", *[F.col(c).cast("binary").alias(c) for c in ("key", "meta", "payload")], "batch_no")
    back = codec.decode_frames(codec.encode_frames(binary, "batch_no").select("frame"))
    return back.select("lsn", "ts_ns", *[F.col(c).cast("string").alias(c) for c in ("key", "meta", "payload")])


def wal_roundtrip_compressed(spark, sf_dir):
    log = _log(spark, sf_dir)
    binary = log.select("lsn", "ts_ns", *[F.col(c).cast("binary").alias(c) for c in ("key", "meta", "payload")], "batch_no")
    back = codec.decode_frames(codec.encode_frames(binary, "batch_no", "zstd").select("frame"), "zstd")
    return back.select("lsn", "ts_ns", *[F.col(c).cast("string").alias(c) for c in ("key", "meta", "payload")])


def frame_headers(spark, sf_dir):
    """A scan of frames' headers, checksums verified, records left alone."""
    log = _log(spark, sf_dir)
    binary = log.select("lsn", "ts_ns", *[F.col(c).cast("binary").alias(c) for c in ("key", "meta", "payload")], "batch_no")
    return codec.scan_frames(codec.encode_frames(binary, "batch_no").select("frame")).select("first_lsn", "last_lsn", "cnt", "frame_ts", "per_record_ts", "size")


def follow_available_now(spark, sf_dir):
    """All events through a stream that ends when it has caught up."""
    from .streaming.follow import drain

    v = event_log(spark, sf_dir)
    stream = spark.readStream.schema(v.table.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet" if _is_folder(spark, f"{sf_dir}/events.parquet") else f"{sf_dir}/events.parque[t]")
    rows = type(v)(stream, v.id_column, v.ts_ns, v.key, v.meta, v.payload, v.shift, v.batch_size).events().drop("batch_no")
    return drain(rows)


def _store(spark: SparkSession, sf_dir: str, observe=None, **options) -> Log:
    """A native log of the events, from two appends; observe(log) runs between them."""
    v = event_log(spark, sf_dir)
    a, b = _bounds(v)
    middle = a + (b - a) // 2 // v.batch_size * v.batch_size - 1
    log = Log(spark, f"{shared_folder(spark)}/log-{uuid4().hex}", Options(batch_size=v.batch_size, max_segment_bytes=SEGMENT, **options))
    for rows in (v.events(last=middle), v.events(first=middle + 1)):
        if not rows.isEmpty():
            log.append(rows.select("lsn", "ts_ns", "key", "meta", "payload").withColumnRenamed("lsn", "at"), ["at"])
            if observe is not None:
                observe, _ = None, observe(log)
    return log


def _strings(events: DataFrame) -> DataFrame:
    return events.select("lsn", "ts_ns", *[F.col(c).cast("string").alias(c) for c in ("key", "meta", "payload")])


def store_append_read(spark, sf_dir):
    """Two appends, read back."""
    return _strings(_store(spark, sf_dir).read())


def store_segments(spark, sf_dir):
    """The segments that two appends make: the second goes on in the open one."""
    return _store(spark, sf_dir).segments().drop("created_at")


def store_delete_before(spark, sf_dir):
    """What a deletion before the middle leaves to read."""
    log = _store(spark, sf_dir)
    first, last = log.manifest.first_lsn, log.manifest.last_lsn
    log.delete_before(first + (last - first) // 2)
    return _strings(log.read())


def store_snapshot(spark, sf_dir):
    """A snapshot taken between the appends, read after the second and a deletion."""
    held = []
    log = _store(spark, sf_dir, lambda log: held.append(log.snapshot().__enter__()))
    log.delete_before(log.manifest.last_lsn)
    return _strings(held[0].read())


def store_import(spark, sf_dir):
    """Sealed segments, exported as files of compressed frames and imported by a replica."""
    log = _store(spark, sf_dir)
    replica = Log(spark, f"{log.root}-replica")
    sealed = [s["first_lsn"] for s in log.manifest.segments if s["sealed"]]
    if sealed:
        replica.import_segments(log.export_segments(sealed, f"{log.root}-files", "zstd"), "zstd")
    return _strings(replica.read())


def store_rotate(spark, sf_dir):
    """A rotation between the appends: the first number of each segment, and how many events it has."""
    log = _store(spark, sf_dir, lambda log: log.rotate())
    return log.read().groupBy(F.col("segment_lsn").alias("first_lsn")).agg(F.count(F.lit(1)).alias("events"))


def store_open_segment(spark, sf_dir):
    """The oldest sealed segment by itself; nothing where none is sealed."""
    log = _store(spark, sf_dir)
    sealed = [s["first_lsn"] for s in log.manifest.segments if s["sealed"]]
    return _strings(log.open_segment(sealed[0])[0] if sealed else log.read().limit(0))


def store_retention(spark, sf_dir):
    """What a limit of three segments leaves to read."""
    return _strings(_store(spark, sf_dir, max_segments=3).read())


def store_retention_bytes(spark, sf_dir):
    """What a limit of 200,000 bytes leaves to read."""
    return _strings(_store(spark, sf_dir, retention_bytes=200_000).read())


def store_delete_older_than(spark, sf_dir):
    """What a deletion by time, half through the segments, leaves to read."""
    log = _store(spark, sf_dir)
    stamps = [s["last_ts"] for s in log.manifest.segments]
    log.delete_older_than((min(stamps) + max(stamps)) // 2)
    return _strings(log.read())


def store_compact(spark, sf_dir):
    """What a snapshot's compaction, with a checkpoint in the middle, leaves to read."""
    log = _store(spark, sf_dir)
    first, last = log.manifest.first_lsn, log.manifest.last_lsn
    with log.snapshot() as snap:
        snap.checkpoint(first + (last - first) // 2)
        snap.compact()
    return _strings(log.read())


def store_stats(spark, sf_dir):
    """The counters and gauges that two appends leave."""
    return _store(spark, sf_dir).stats().select("events_written", "batches_written", "bytes_written", "rotation_count", "segment_count", "total_size", "first_lsn", "last_lsn")


def store_rebuild(spark, sf_dir):
    """A log whose manifests are all torn, opened again."""
    log = _store(spark, sf_dir)
    for v in log.manifests.versions():
        log.files.write(f"{log.manifests.folder}/v{v:010d}.json", b"torn")
    return _strings(Log(spark, log.root, log.options).read())


def store_index_feed(spark, sf_dir):
    """What an indexer gets at the commits of two appends."""
    fed: list[DataFrame] = []
    _store(spark, sf_dir, indexer=fed.append)
    rows = fed[0].unionByName(fed[1]) if len(fed) > 1 else fed[0]
    return rows.select("lsn", "ts_ns", *[F.col(c).cast("string").alias(c) for c in ("key", "meta")], "offset", "segment_lsn")


def _wal_folder(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A folder with a file of frames for each segment, and the placed frames."""
    folder = f"{shared_folder(spark)}/wal-{uuid4().hex}"
    placed = durable(_placed(spark, sf_dir))
    rows = _log(spark, sf_dir).join(placed.select("batch_no", F.col("first_lsn").alias("batch_first_lsn"), "segment_lsn"), "batch_no")
    wal.write_segments(rows.select("lsn", "ts_ns", *[F.col(c).cast("binary").alias(c) for c in ("key", "meta", "payload")], "batch_first_lsn", "segment_lsn"), folder)
    return folder, placed


def wal_segments(spark, sf_dir):
    """A recovery scan of a file of frames for each segment, the last of which ends in ten torn bytes."""
    folder, _ = _wal_folder(spark, sf_dir)
    files = Files(spark)
    last = f"{folder}/{files.names(folder)[-1]}"
    files.write(last, files.read(last) + b"torn bytes")
    return wal.read_segments(spark, folder).select("segment_lsn", "first_lsn", "last_lsn", "size", "file_size", "first_ts", "last_ts", "frames", "corrupted", "truncated")


def wal_skip_rest(spark, sf_dir):
    """Files of frames, a byte of the first one's middle frame flipped: a replay leaves out the rest of that file only."""
    folder, placed = _wal_folder(spark, sf_dir)
    first = placed.where(F.col("segment_lsn") == placed.agg(F.min("segment_lsn")).first()[0])
    low, high = first.agg(F.min("batch_no"), F.max("batch_no")).first()
    at = first.where(F.col("batch_no") == (low + high) // 2).first()["offset"]
    files = Files(spark)
    path = f"{folder}/{files.names(folder)[0]}"
    data = bytearray(files.read(path))
    data[at + 40] ^= 1
    files.write(path, bytes(data))
    return _strings(wal.read_events(spark, folder))


def index_bytes(spark, sf_dir):
    """The segments' sparse indexes as files have them, read again."""
    return codec.decode_index(codec.encode_index(_placed(spark, sf_dir)))


def manifest_bytes(spark, sf_dir):
    """A manifest of the segments as files have it, read again; a row for each segment reaches the driver."""
    rows = [r.asDict() | {"created_at": r["first_ts"]} for r in _segments(spark, sf_dir).orderBy("first_lsn").collect()]
    entries, last = codec.read_manifest(codec.manifest_bytes(rows, rows[-1]["last_lsn"] if rows else 0))
    return spark.createDataFrame([(*(e[f] for f in SEGMENT_FIELDS), last) for e in entries], f"{SEGMENT_DDL}, log_last_lsn long")


def wal_files(spark, sf_dir):
    """The log written as files of frames and read again, both by format("wal")."""
    wal.register(spark)
    folder = f"{shared_folder(spark)}/wal-{uuid4().hex}"
    rows = _log(spark, sf_dir)
    first = F.min("lsn").over(Window.partitionBy("batch_no")).alias("batch_first_lsn")
    binary = rows.select("lsn", "ts_ns", *[F.col(c).cast("binary").alias(c) for c in ("key", "meta", "payload")], first).withColumn("segment_lsn", F.col("batch_first_lsn"))
    binary.repartitionByRange("lsn").sortWithinPartitions("lsn").write.format("wal").option("path", folder).mode("append").save()
    return _strings(spark.read.format("wal").option("path", folder).load())


def follow_tidelog(spark, sf_dir):
    """The native log through format("tidelog"), from a third on."""
    from .streaming.follow import drain, follow

    log = _store(spark, sf_dir)
    first, last = log.manifest.first_lsn, log.manifest.last_lsn
    return _strings(drain(follow(spark, log.root, first + (last - first) // 3)))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


QUERIES = {
    f.__name__: f
    for f in (
        *(replay_from, replay_range, replay_batches, replay_batch_events, iterate_events, event_times, frames, frames_of_orders, sparse_index, segments, seek_lsn, seek_ts),
        *(delete_before, delete_older_than, retention_count, retention_size, compact_checkpoint, snapshot_read, import_overlap, import_distinct),
        *(replica_missing_segments, index_feed, index_lookup, live_index, latest_per_key, assign_lsn, drop_gaps, batch_too_large, recover_prefix),
        *(replay_skip_rest, stats, segment_names, wal_roundtrip, wal_roundtrip_compressed, frame_headers, follow_available_now),
        *(store_append_read, store_segments, store_delete_before, store_snapshot, store_import, store_rotate, store_open_segment, store_retention, store_rebuild, store_index_feed),
        *(store_retention_bytes, store_delete_older_than, store_compact, store_stats, wal_skip_rest),
        *(wal_files, wal_segments, follow_tidelog, index_bytes, manifest_bytes),
    )
}

_L = "L AS (SELECT event_id + 1 AS lsn, epoch_us(ts) * 1000 AS ts_ns, nullif(CAST(user_id AS VARCHAR), '') AS key, nullif(event_type, '') AS meta, coalesce(props, '') AS payload, event_id // 100 AS batch_no FROM events)"
_F = """F AS (SELECT batch_no, min(lsn) AS first_lsn, max(lsn) AS last_lsn, count(*) AS cnt, arg_min(ts_ns, lsn) AS frame_ts, min(ts_ns) < max(ts_ns) AS per_record_ts,
  CAST(32 + count(*) * CASE WHEN min(ts_ns) < max(ts_ns) THEN 16 ELSE 8 END + sum(coalesce(strlen(key), 0) + coalesce(strlen(meta), 0) + strlen(payload)) AS BIGINT) AS size FROM L GROUP BY batch_no)"""
_P = f"""N AS (SELECT *, row_number() OVER (ORDER BY first_lsn) AS i FROM F),
C(i, seg, off, full_at) AS (
  SELECT i, first_lsn, 0::BIGINT, size FROM N WHERE i = 1
  UNION ALL SELECT N.i, CASE WHEN full_at >= {SEGMENT} THEN N.first_lsn ELSE seg END, CASE WHEN full_at >= {SEGMENT} THEN 0 ELSE full_at END, CASE WHEN full_at >= {SEGMENT} THEN 0 ELSE full_at END + N.size
  FROM C JOIN N ON N.i = C.i + 1),
P AS (SELECT N.* EXCLUDE (i), C.seg AS segment_lsn, C.off AS "offset" FROM N JOIN C USING (i))"""
_S = f"""S AS (SELECT segment_lsn AS first_lsn, max(last_lsn) AS last_lsn, sum(size)::BIGINT AS size, count(*) AS frames, coalesce(arg_min(frame_ts, "offset") FILTER (frame_ts <> 0), 0) AS first_ts,
  arg_max(frame_ts, "offset") AS last_ts, max(frame_ts) AS max_ts, sum(size) >= {SEGMENT} AS sealed FROM P GROUP BY segment_lsn)"""
_TO_S = f"WITH RECURSIVE {_L}, {_F}, {_P}, {_S}"
_TO_P = f"WITH RECURSIVE {_L}, {_F}, {_P}"
_B = "B AS (SELECT min(lsn) AS a, max(lsn) AS b FROM L)"
_MIDDLE = "(SELECT min(first_lsn) + (max(last_lsn) - min(first_lsn)) // {} FROM S)"
_FREE = "first_lsn < (SELECT max(first_lsn) FROM S)"
_EVENTS = "lsn, ts_ns, key, meta, payload"

SQL = {
    "replay_from": f"WITH {_L} SELECT {_EVENTS} FROM L WHERE lsn >= 5001",
    "replay_range": f"WITH {_L} SELECT {_EVENTS} FROM L WHERE lsn BETWEEN 301 AND 500",
    "replay_batches": f"WITH {_L} SELECT min(lsn) AS first_lsn, max(lsn) AS last_lsn, count(*) AS cnt, sum(strlen(payload))::BIGINT AS payload_bytes FROM L WHERE lsn >= 450 GROUP BY batch_no",
    "replay_batch_events": f"WITH {_L} SELECT min(lsn) AS first_lsn, count(*) AS cnt, string_agg(concat_ws('|', lsn, key, meta), ',' ORDER BY lsn) AS events FROM L WHERE lsn >= 450 GROUP BY batch_no",
    "iterate_events": f"WITH {_L} SELECT row_number() OVER (ORDER BY lsn) AS position, lsn, key FROM L WHERE lsn >= 101",
    "event_times": f"WITH {_L} SELECT lsn, ts_ns // 1000 AS us FROM L",
    "frames": f"WITH {_L}, {_F} SELECT * EXCLUDE (batch_no) FROM F",
    "frames_of_orders": f"""WITH L AS (SELECT o_orderkey AS lsn, epoch_us(o_orderdate) * 1000 AS ts_ns, o_orderpriority AS key, NULL::VARCHAR AS meta, o_orderstatus AS payload, o_orderkey // 3 AS batch_no FROM orders), {_F} SELECT * EXCLUDE (batch_no) FROM F""",
    "sparse_index": f'{_TO_P} SELECT segment_lsn, first_lsn, "offset", frame_ts FROM P',
    "segments": f"{_TO_S} SELECT * FROM S",
    "seek_lsn": f"WITH {_L}, {_F}, Q AS (SELECT unnest([0, 1, 5, 100, 101, 555, 999, 1000000000000]::BIGINT[]) AS probe) SELECT probe, coalesce((SELECT max(first_lsn) FROM F WHERE first_lsn <= probe), (SELECT min(first_lsn) FROM F)) AS first_lsn FROM Q",
    "seek_ts": f"WITH {_L}, {_F}, Q AS (SELECT frame_ts + 1 AS probe_ts FROM F WHERE first_lsn IN (1, 301, 501) UNION ALL SELECT unnest([0, 4611686018427387904]::BIGINT[])) SELECT probe_ts, (SELECT min(first_lsn) FROM F WHERE frame_ts >= probe_ts) AS first_lsn FROM Q",
    "delete_before": f"{_TO_S} SELECT * FROM S WHERE NOT ({_FREE} AND sealed AND last_lsn < {_MIDDLE.format(2)})",
    "delete_older_than": f"{_TO_S} SELECT * FROM S WHERE NOT ({_FREE} AND sealed AND last_ts < (SELECT (min(last_ts)::HUGEINT + max(last_ts)) // 2 FROM S))",
    "retention_count": f"{_TO_S} SELECT * FROM S ORDER BY first_lsn DESC LIMIT 3",
    "retention_size": f"{_TO_S} SELECT * EXCLUDE (rest, n) FROM (SELECT *, sum(size) OVER (ORDER BY first_lsn DESC) AS rest, row_number() OVER (ORDER BY first_lsn DESC) AS n FROM S) WHERE rest <= 200000 OR n = 1",
    "compact_checkpoint": f"{_TO_S} SELECT * FROM S WHERE NOT ({_FREE} AND sealed AND (last_lsn < {_MIDDLE.format(3)} OR last_ts < (SELECT (min(last_ts)::HUGEINT + max(last_ts)) // 2 FROM S)))",
    "snapshot_read": f"WITH {_L}, {_B} SELECT lsn, key, payload FROM L, B WHERE lsn <= a + (b - a) * 2 // 3",
    "import_overlap": f"WITH {_L}, {_B} SELECT lsn, count(*) AS copies, min(payload) AS payload FROM (SELECT L.* FROM L, B WHERE lsn <= a + (b - a) * 2 // 3 UNION ALL SELECT L.* FROM L, B WHERE lsn >= a + (b - a) // 3) GROUP BY lsn",
    "import_distinct": f"WITH {_L} SELECT lsn, payload FROM L",
    "replica_missing_segments": f"{_TO_S} SELECT first_lsn, last_lsn, size FROM S WHERE sealed AND first_lsn // 100 % 3 <> 0",
    "index_feed": f'{_TO_P} SELECT lsn, ts_ns, key, meta, "offset", segment_lsn FROM L JOIN P USING (batch_no)',
    "index_lookup": f"WITH {_L} SELECT lsn, key, meta, payload FROM L WHERE key = '7'",
    "live_index": f"{_TO_S} SELECT segment_lsn, sum(cnt)::BIGINT AS rows FROM P WHERE segment_lsn IN (SELECT first_lsn FROM S WHERE NOT ({_FREE} AND sealed AND last_lsn < {_MIDDLE.format(2)})) GROUP BY segment_lsn",
    "latest_per_key": f"WITH {_L} SELECT key, max(lsn) AS lsn, arg_max(payload, lsn) AS payload FROM L GROUP BY key",
    "assign_lsn": "SELECT o_orderkey, o_custkey, 1000 + row_number() OVER (ORDER BY o_orderkey) AS lsn FROM orders",
    "drop_gaps": f"WITH {_L} SELECT after_lsn, lsn AS next_lsn FROM (SELECT lsn, lag(lsn) OVER (ORDER BY lsn) AS after_lsn FROM L WHERE batch_no % 7 <> 3) WHERE lsn > after_lsn + 1",
    "batch_too_large": f"WITH {_L}, {_F} SELECT first_lsn, size FROM F WHERE size > (SELECT sum(size) // count(*) FROM F)",
    "recover_prefix": f'{_TO_P}, A AS (SELECT * FROM P WHERE segment_lsn = (SELECT max(segment_lsn) FROM P)) SELECT segment_lsn, "offset", first_lsn, last_lsn FROM A WHERE batch_no < (SELECT (min(batch_no) + max(batch_no)) // 2 FROM A)',
    "replay_skip_rest": f'{_TO_P}, B AS (SELECT segment_lsn, min("offset") AS bad FROM P WHERE batch_no % 11 = 4 GROUP BY 1) SELECT lsn, key FROM L JOIN (SELECT batch_no FROM P LEFT JOIN B USING (segment_lsn) WHERE bad IS NULL OR "offset" < bad) USING (batch_no)',
    "stats": f"{_TO_S} SELECT * FROM (SELECT count(*) AS batches, sum(cnt)::BIGINT AS events, sum(size)::BIGINT AS bytes, min(first_lsn) AS first_lsn, max(last_lsn) AS last_lsn FROM F), (SELECT count(*) AS segments, sum(size)::BIGINT AS total_size, sum(sealed::INT)::BIGINT AS rotations FROM S)",
    "segment_names": f"{_TO_S} SELECT first_lsn, lpad(first_lsn::VARCHAR, 20, '0') || '.wal' AS name, first_lsn AS parsed FROM S",
    "wal_roundtrip": f"WITH {_L} SELECT {_EVENTS} FROM L",
    "wal_roundtrip_compressed": f"WITH {_L} SELECT {_EVENTS} FROM L",
    "frame_headers": f"WITH {_L}, {_F} SELECT first_lsn, last_lsn, cnt, frame_ts, per_record_ts, size FROM F",
    "follow_available_now": f"WITH {_L} SELECT {_EVENTS} FROM L",
    "store_append_read": f"WITH {_L} SELECT {_EVENTS} FROM L",
    "store_segments": f"{_TO_S} SELECT first_lsn, last_lsn, size, first_ts, last_ts, sealed FROM S",
    "store_delete_before": f"{_TO_S} SELECT {_EVENTS} FROM L WHERE lsn >= (SELECT min(first_lsn) FROM S WHERE NOT ({_FREE} AND sealed AND last_lsn < {_MIDDLE.format(2)}))",
    "store_snapshot": f"WITH {_L}, {_B} SELECT {_EVENTS} FROM L, B WHERE lsn < a + (b - a) // 2 // 100 * 100",
    "store_import": f"{_TO_S} SELECT {_EVENTS} FROM L WHERE lsn <= (SELECT max(last_lsn) FROM S WHERE sealed)",
    "store_rotate": f"""WITH RECURSIVE {_L}, {_F}, {_B}, N AS (SELECT *, row_number() OVER (ORDER BY first_lsn) AS i FROM F),
C(i, seg, full_at) AS (
  SELECT i, first_lsn, size FROM N WHERE i = 1
  UNION ALL SELECT N.i, CASE WHEN full_at >= {SEGMENT} OR first_lsn = a + (b - a) // 2 // 100 * 100 THEN first_lsn ELSE seg END, CASE WHEN full_at >= {SEGMENT} OR first_lsn = a + (b - a) // 2 // 100 * 100 THEN 0 ELSE full_at END + size
  FROM C JOIN N ON N.i = C.i + 1, B)
SELECT seg AS first_lsn, sum(cnt)::BIGINT AS events FROM C JOIN N USING (i) GROUP BY seg""",
    "store_open_segment": f"{_TO_S} SELECT {_EVENTS} FROM L WHERE lsn <= (SELECT min(last_lsn) FROM S WHERE sealed)",
    "store_retention": f"{_TO_S} SELECT {_EVENTS} FROM L WHERE lsn >= (SELECT min(first_lsn) FROM (SELECT first_lsn FROM S ORDER BY first_lsn DESC LIMIT 3))",
    "store_rebuild": f"WITH {_L} SELECT {_EVENTS} FROM L",
    "store_index_feed": f'{_TO_P} SELECT lsn, ts_ns, key, meta, "offset", segment_lsn FROM L JOIN P USING (batch_no)',
    "wal_segments": f"{_TO_S}, M AS (SELECT max(first_lsn) AS m FROM S) SELECT first_lsn AS segment_lsn, first_lsn, last_lsn, size, size + CASE WHEN first_lsn = m THEN 10 ELSE 0 END AS file_size, first_ts, last_ts, frames, first_lsn = m AS corrupted, CASE WHEN first_lsn = m THEN 10 ELSE 0 END::BIGINT AS truncated FROM S, M",
    "index_bytes": f'{_TO_P} SELECT segment_lsn, first_lsn, "offset", frame_ts FROM P',
    "manifest_bytes": f"{_TO_S} SELECT first_lsn, last_lsn, size, first_ts AS created_at, first_ts, last_ts, sealed, (SELECT max(last_lsn) FROM S) AS log_last_lsn FROM S",
    "store_retention_bytes": f"{_TO_S} SELECT {_EVENTS} FROM L WHERE lsn >= (SELECT min(first_lsn) FROM (SELECT first_lsn, sum(size) OVER (ORDER BY first_lsn DESC) AS rest, row_number() OVER (ORDER BY first_lsn DESC) AS n FROM S) WHERE rest <= 200000 OR n = 1)",
    "store_delete_older_than": f"{_TO_S} SELECT {_EVENTS} FROM L WHERE lsn >= (SELECT min(first_lsn) FROM S WHERE NOT ({_FREE} AND sealed AND last_ts < (SELECT (min(last_ts)::HUGEINT + max(last_ts)) // 2 FROM S)))",
    "store_compact": f"{_TO_S} SELECT {_EVENTS} FROM L WHERE lsn >= (SELECT min(first_lsn) FROM S WHERE NOT ({_FREE} AND sealed AND last_lsn < {_MIDDLE.format(2)}))",
    "store_stats": f"{_TO_S} SELECT * FROM (SELECT sum(cnt)::BIGINT AS events_written, count(*) AS batches_written, sum(size)::BIGINT AS bytes_written, min(first_lsn) AS first_lsn, max(last_lsn) AS last_lsn FROM F), (SELECT sum(sealed::INT)::BIGINT AS rotation_count, count(*) AS segment_count, sum(size)::BIGINT AS total_size FROM S)",
    "wal_skip_rest": f"{_TO_P}, A AS (SELECT (min(batch_no) + max(batch_no)) // 2 AS bad, max(last_lsn) AS upto FROM P WHERE segment_lsn = (SELECT min(segment_lsn) FROM P)) SELECT {_EVENTS} FROM L, A WHERE batch_no < bad OR lsn > upto",
    "wal_files": f"WITH {_L} SELECT {_EVENTS} FROM L",
    "follow_tidelog": f"WITH {_L}, {_B} SELECT {_EVENTS} FROM L, B WHERE lsn >= a + (b - a) // 3",
}
