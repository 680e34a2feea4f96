"""The native log: appends, reads, rotation, retention, recovery, snapshots, replication, following."""

import pytest
from pyspark.sql import functions as F

from tidelog import errors
from tidelog.operators import reads
from tidelog.plans.buffer import Backpressure, Batch, Buffer
from tidelog.plans.store import Log, Options
from tidelog.sources import codec, wal
from tidelog.sources.files import Files
from tidelog.streaming.follow import follow


class Clock:
    def __init__(self):
        self.now = 1_000

    def __call__(self):
        self.now += 1
        return self.now


class Seen:
    def __init__(self):
        self.calls = []

    def __getattr__(self, name):
        if name.startswith(("on_", "after_", "before_")):
            return lambda *a: self.calls.append((name, a))
        raise AttributeError(name)


def rows(spark, n, start=0, size=10):
    return spark.range(start, start + n, 1, 3).select(F.concat(F.lit("event-"), "id").cast("binary").alias("payload"), (F.col("id") % 3).cast("string").alias("key"), F.lit(b"x" * size).alias("meta"), (F.col("id") * 10 + 10).alias("ts_ns"))


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, f"file://{tmp_path}/log", Options(batch_size=5, max_segment_bytes=600, clock=Clock()))


def lsns(df):
    return [r["lsn"] for r in df.orderBy("lsn").collect()]


def test_append_read_reopen(spark, log):
    assert log.append(rows(spark, 30), ["ts_ns"]) == 30
    assert log.append(rows(spark, 7, 30), ["ts_ns"]) == 37
    assert lsns(log.read()) == list(range(1, 38))
    assert lsns(log.read(15, 17)) == [15, 16, 17]
    assert [bytes(r["payload"]) for r in log.read(3, 5).orderBy("lsn").collect()] == [b"event-2", b"event-3", b"event-4"]
    assert log.read(100, 200).count() == 0
    with pytest.raises(errors.LsnRangeError):
        log.read(5, 4)
    s = [r.asDict() for r in log.segments().orderBy("first_lsn").collect()]
    assert len(s) >= 2
    assert [x["sealed"] for x in s[:-1]] == [True] * (len(s) - 1)
    assert [a["last_lsn"] + 1 for a in s[:-1]] == [b["first_lsn"] for b in s[1:]]
    again = Log(spark, log.root, log.options)
    assert lsns(again.read(20)) == list(range(20, 38))
    assert again.append(rows(spark, 1)) == 38
    assert [r["lsn"] for r in reads.iterate(again.read(), 36)] == [36, 37, 38]
    stop = []
    assert reads.for_each(again.read(), 0, lambda r: stop.append(r["lsn"]) or len(stop) < 4) == 4


def test_only_needed_segments_are_listed(spark, log):
    log.append(rows(spark, 60), ["ts_ns"])
    s = [r.asDict() for r in log.segments().orderBy("first_lsn").collect()]
    assert len(log.read(s[-1]["first_lsn"]).inputFiles()) < len(log.read().inputFiles())


def test_append_errors(spark, log):
    with pytest.raises(errors.EmptyBatch):
        log.append(rows(spark, 0))
    small = Log(spark, log.root + "2", Options(max_batch_bytes=100))
    with pytest.raises(errors.BatchTooLarge):
        small.append(rows(spark, 5))
    other = Log(spark, log.root, log.options)
    log.append(rows(spark, 5))
    stale = other._fresh()
    other.append(rows(spark, 5))
    with pytest.raises(errors.CommitConflict):
        stale.version = 1
        other.manifests.commit(stale)
    log.shutdown()
    for call in (lambda: log.append(rows(spark, 1)), lambda: log.read(), log.rotate, lambda: log.delete_before(3)):
        with pytest.raises(errors.LogClosed):
            call()
    with pytest.raises(errors.LogStateError):
        log.shutdown()


def test_null_rules(spark, log):
    log.append(spark.createDataFrame([(b"", b"", None, None)], "key binary, meta binary, payload binary, ts_ns long"))
    r = log.read().first()
    assert (r["key"], r["meta"], bytes(r["payload"])) == (None, None, b"")
    assert r["ts_ns"] > 0


def test_rotation_retention_deletion(spark, tmp_path):
    seen = Seen()
    log = Log(spark, f"file://{tmp_path}/log", Options(batch_size=5, max_segment_bytes=600, max_segments=3, clock=Clock()), seen)
    log.append(rows(spark, 100), ["ts_ns"])
    assert len(log.manifest.segments) <= 3
    assert {"on_rotation", "on_delete", "after_append", "before_write", "after_sync"} <= {c for c, _ in seen.calls}
    last = log.manifest.segments[-1]["first_lsn"]
    log.rotate()
    log.append(rows(spark, 5, 100))
    assert log.manifest.segments[-1]["first_lsn"] == 101 > last
    with log.snapshot() as s:
        assert log.delete_before(101) == 0
        assert lsns(s.read(101)) == list(range(101, 106))
        log.append(rows(spark, 5, 200))
        assert lsns(s.read(101)) == list(range(101, 106))
        assert s.compact() == 0
        s.checkpoint(101)
        assert s.compact() >= 1
    assert log.delete_older_than(10**12) == len(log.manifest.segments) * 0 + log.delete_before(0)
    assert log.vacuum() >= 1
    assert lsns(log.read(101)) == list(range(101, 111))


def test_recovery(spark, log):
    log.append(rows(spark, 15), ["ts_ns"])
    log.append(rows(spark, 5, 15), ["ts_ns"])
    folder = log.manifests.folder
    log.files.write(f"{folder}/v{3:010d}.json", b"torn")
    seen = Seen()
    again = Log(spark, log.root, log.options, seen)
    assert lsns(again.read()) == list(range(1, 21))
    assert "on_corruption" in {c for c, _ in seen.calls}
    assert again.append(rows(spark, 5)) == 25
    for v in again.manifests.versions():
        log.files.write(f"{folder}/v{v:010d}.json", b"torn")
    rebuilt = Log(spark, log.root, log.options)
    assert lsns(rebuilt.read()) == list(range(1, 26))
    assert rebuilt.append(rows(spark, 1)) == 26


def test_replication(spark, log, tmp_path):
    log.append(rows(spark, 40), ["ts_ns"])
    sealed = [s["first_lsn"] for s in log.manifest.segments if s["sealed"]]
    paths = [log.export_segment(f, f"{tmp_path}/wal", "zstd") for f in sealed]
    with pytest.raises(errors.SegmentNotFound):
        log.open_segment(10**6)
    replica = Log(spark, log.root + "-replica", Options(clock=Clock()))
    for p in reversed(paths):
        replica.import_segment(p, "zstd")
    assert [s["first_lsn"] for s in replica.manifest.segments] == sealed
    last = max(s["last_lsn"] for s in log.manifest.segments if s["sealed"])
    assert lsns(replica.read()) == list(range(1, last + 1))
    assert replica.append(rows(spark, 1)) == last + 1
    frame = codec.encode([codec.Record(5, None, None, b"a"), codec.Record(6, b"k", None, b"b")], 500)
    assert replica.import_batch(frame) == 501
    with pytest.raises(errors.ImportInvalid):
        replica.import_batch(frame[:-1] + b"\0")
    (tmp_path / "wal" / f"{7777:020d}.wal").write_bytes(frame + b"rest")
    with pytest.raises(errors.ImportInvalid):
        replica.import_segment(f"{tmp_path}/wal/{7777:020d}.wal")
    s = replica.stats().first()
    assert len(s) == 21
    assert (s["last_lsn"], s["state"], s["import_batches"] > 0) == (501, "RUNNING", True)


def test_wal_files(spark, tmp_path):
    frames = [codec.encode([codec.Record(10 * i, None, None, b"event-%d" % i)], i) for i in range(1, 11)]
    (tmp_path / f"{1:020d}.wal").write_bytes(b"".join(frames[:5]))
    bad = bytearray(frames[6])
    bad[-1] ^= 1
    (tmp_path / f"{6:020d}.wal").write_bytes(frames[5] + bytes(bad) + frames[7])
    (tmp_path / f"{9:020d}.wal").write_bytes(b"".join(frames[8:]))
    (tmp_path / "other.wal").write_bytes(b"x")
    (tmp_path / f"{0:020d}.wal").write_bytes(b"x")
    path = str(tmp_path)
    assert lsns(wal.read_events(spark, path)) == [1, 2, 3, 4, 5, 6, 9, 10]
    with pytest.raises(Exception, match="frame at"):
        wal.read_events(spark, path, on_corrupt="fail").collect()
    report = {r["segment_lsn"]: r for r in wal.read_segments(spark, path).collect()}
    assert (report[6]["corrupted"], report[6]["size"], report[6]["truncated"]) == (True, len(frames[5]), len(bad) + len(frames[7]))
    assert not report[1]["corrupted"]
    assert sorted(r["first_lsn"] for r in wal.read_frames(spark, path).collect()) == [1, 2, 3, 4, 5, 6, 9, 10]
    wal.register(spark)
    source = spark.read.format("wal").option("path", path)
    assert lsns(source.load()) == [1, 2, 3, 4, 5, 6, 9, 10]
    assert lsns(source.load().where("lsn >= 4 and lsn <= 9")) == [4, 5, 6, 9]
    assert source.option("view", "frames").load().count() == 8
    out = f"{tmp_path}/out"
    wal.read_events(spark, path).repartitionByRange(2, "lsn").sortWithinPartitions("lsn").write.format("wal").option("path", out).mode("append").save()
    assert lsns(wal.read_events(spark, out)) == [1, 2, 3, 4, 5, 6, 9, 10]


def test_follow(spark, log, tmp_path):
    log.append(rows(spark, 12), ["ts_ns"])

    def caught(first, state):
        q = follow(spark, log.root, first).writeStream.format("parquet").option("path", f"{tmp_path}/{state}/rows").option("checkpointLocation", f"{tmp_path}/{state}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return lsns(spark.read.parquet(f"{tmp_path}/{state}/rows"))

    assert caught(5, "a") == list(range(5, 13))
    log.append(rows(spark, 20, 12), ["ts_ns"])  # over a rotation
    assert caught(5, "a") == list(range(5, 33))
    assert caught(0, "b") == list(range(1, 33))
    log.wait_durable(32)
    with pytest.raises(TimeoutError):
        log.wait_durable(33, timeout_s=0.1, poll_s=0.05)


def test_buffer():
    got, dropped = [], []
    for mode in Backpressure:
        b = Buffer(got.extend, queue_size=2, mode=mode, on_drop=dropped.append)
        last = [b.put(Batch().add(b"a").add(b"b", b"", b"m", 0)) for _ in range(2)]
        assert last == [2, 4]
        if mode is Backpressure.DROP:
            assert (b.put(Batch().add(b"c")), b.drops, dropped) == (0, 1, [1])
        elif mode is Backpressure.ERROR:
            with pytest.raises(errors.BufferFull):
                b.put(Batch().add(b"c"))
        else:
            assert b.put(Batch().add(b"c")) == 5
        assert b.put(Batch().add(b"d")) if mode is Backpressure.BLOCK else True
        b.close()
        with pytest.raises(errors.LogClosed):
            b.put(Batch().add(b"d"))
    with pytest.raises(errors.EmptyBatch):
        Buffer(got.extend).put(Batch())
    with pytest.raises(errors.BatchTooLarge):
        Buffer(got.extend, max_batch_bytes=40).put(Batch().add(b"x" * 40))
    assert got[1][:1] + got[1][2:5] == (2, None, b"m", b"b")
    assert got[1][1] == 0


def test_sync_modes(spark, tmp_path):
    def synced(n, **options):
        seen = Seen()
        log = Log(spark, f"file://{tmp_path}/{'-'.join(map(str, options.values()))}", Options(batch_size=5, clock=Clock(), **options), seen)
        for i in range(n):
            log.append(rows(spark, 10, 10 * i))
        s = log.stats().first()
        assert s["sync_count"] == sum(c == "after_sync" for c, _ in seen.calls)
        log.flush()
        assert log.stats().first()["bytes_synced"] == s["bytes_written"]
        return s["sync_count"]

    assert synced(3, sync_mode="batch") == 3
    assert synced(3, sync_mode="never") == 0
    assert synced(4, sync_mode="count", sync_count=4) == 2
    assert synced(2, sync_mode="size", sync_bytes=10**6) == 0
    assert synced(2, sync_mode="interval", sync_interval_ns=10**9) == 0
    with pytest.raises(ValueError, match="sync_mode"):
        Options(sync_mode="sometimes")


def test_indexer_buffer_compression_storage(spark, tmp_path):
    made, fed = [], []

    def storage(session):
        made.append(1)
        return Files(session)

    seen = Seen()
    log = Log(spark, f"file://{tmp_path}/log", Options(batch_size=5, clock=Clock(), indexer=fed.append, storage=storage, compression="zstd"), seen)
    log.append(rows(spark, 10, size=500), ["ts_ns"])
    assert made and sorted((r["lsn"], bytes(r["key"])) for r in fed[0].collect()) == [(i + 1, b"%d" % (i % 3)) for i in range(10)]
    assert {r["offset"] > 0 for r in fed[0].where("lsn > 5").collect()} == {True}
    assert 0 < log.stats().first()["compressed_bytes"] < log.stats().first()["bytes_written"]
    b = log.buffer(queue_size=1, mode=Backpressure.DROP)
    assert b.put(Batch().add(b"a").add(b"b", b"k")) == 12
    assert b.put(Batch().add(b"lost")) == 0
    b.close()
    assert lsns(log.read(11)) == [11, 12]
    assert log.stats().first()["drops"] == 1
    assert "on_drop" in {c for c, _ in seen.calls}
    failing = Log(spark, f"file://{tmp_path}/other", Options(indexer=lambda rows: 1 / 0))
    assert failing.append(rows(spark, 3)) == 3


def test_rotation_of_an_empty_segment(spark, log):
    log.rotate()
    assert [(s["first_lsn"], s["size"]) for s in log.manifest.segments] == [(1, 0)]
    log.append(rows(spark, 5))
    log.rotate()
    log.rotate()
    assert [s["first_lsn"] for s in log.manifest.segments] == [1, 6]
    assert log.stats().first()["rotation_count"] == 3
    assert log.append(rows(spark, 5)) == 10
    assert [(s["first_lsn"], s["last_lsn"]) for s in log.manifest.segments] == [(1, 5), (6, 10)]
    assert lsns(Log(spark, log.root, log.options).read()) == list(range(1, 11))


def test_imports_count_events(spark, log):
    seen = Seen()
    replica = Log(spark, log.root + "-replica", Options(clock=Clock()), seen)
    replica.import_batch(codec.encode([codec.Record(5, None, None, b"a"), codec.Record(6, b"k", None, b"b")], 500))
    s = replica.stats().first()
    assert (s["events_written"], s["batches_written"], s["import_batches"]) == (2, 1, 1)
    assert {"after_append", "on_import"} <= {c for c, _ in seen.calls}


def test_followers_tell_of_deleted_events(spark, log, tmp_path):
    def caught(**options):
        source = follow(spark, log.root).writeStream if not options else spark.readStream.format("tidelog").option("path", log.root).options(**options).load().writeStream
        source.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    log.append(rows(spark, 10))
    caught()
    log.append(rows(spark, 60, 10))
    log.rotate()
    log.append(rows(spark, 5, 70))
    log.delete_before(70)
    with pytest.raises(Exception, match="deleted before they were read"):
        caught()
    caught(failOnDataLoss="false")
    assert lsns(spark.read.parquet(f"{tmp_path}/rows"))[-5:] == [71, 72, 73, 74, 75]


def test_pins_hold_for_other_drivers(spark, log):
    log.append(rows(spark, 60), ["ts_ns"])
    log.rotate()
    log.append(rows(spark, 5, 60))
    other = Log(spark, log.root, log.options)
    with log.snapshot() as s:
        assert other.delete_before(61) == 0
        assert other.vacuum() == 0
        assert lsns(s.read()) == list(range(1, 66))
    assert other.delete_before(61) >= 2
    held = other.snapshot()
    held.__enter__()
    other.options.pin_ttl_ns = 0  # as if its driver had gone long ago
    assert other.delete_before(10**6) == 0 and other._held() == set()


def test_old_manifests_go(spark, log, monkeypatch):
    from tidelog.plans import manifest

    monkeypatch.setattr(manifest, "KEPT", 3)
    for i in range(7):
        log.append(rows(spark, 2, 2 * i))
    assert log.manifests.versions() == [4, 5, 6, 7]
    assert lsns(Log(spark, log.root, log.options).read()) == list(range(1, 15))


def test_batch_options():
    b = Batch(Clock()).append(b"a").append(b"b", ts_ns=0).append(b"c", ts_ns=7).mark_no_compress()
    assert [r.ts_ns for r in b.records] == [1001, 1002, 7]
    got = []
    buffer = Buffer(got.extend)
    buffer.put(b)
    buffer.put(Batch().add(b"d"))
    buffer.flush()
    assert (len(got), buffer.plain) == (4, {1})


def test_errors_of_writes_reach_observers(spark, tmp_path):
    seen = Seen()
    with pytest.raises(errors.BatchTooLarge):
        Log(spark, f"file://{tmp_path}/log", Options(max_batch_bytes=50), seen).append(rows(spark, 5))
    assert "on_error" in {c for c, _ in seen.calls}


def test_failed_writes_commit_nothing(spark, tmp_path):
    class Broken(Files):
        def create(self, uri, data):
            raise OSError("no space")

    log = Log(spark, f"file://{tmp_path}/log", Options(storage=Broken))
    with pytest.raises(errors.CommitError, match="no space"):
        log.append(rows(spark, 5))
    whole = Log(spark, log.root)
    assert whole.append(rows(spark, 3)) == 3
    with pytest.raises(errors.WriterFailed):
        whole._write(whole._fresh(), spark.range(3).selectExpr("id AS lsn"))
    assert lsns(Log(spark, log.root).read()) == [1, 2, 3]


def test_files_are_imported_together(spark, sf, log, tmp_path, monkeypatch):
    """Many segments are exported by one job and imported by one commit; files that begin at one number stay two segments."""
    from tidelog import queries
    from tidelog.plans.manifest import Manifests

    log.append(rows(spark, 40), ["ts_ns"])
    sealed = [s["first_lsn"] for s in log.manifest.segments if s["sealed"]]
    paths = log.export_segments(sealed[::-1], f"{tmp_path}/wal", "zstd")
    assert [int(p[-24:-4]) for p in paths] == sealed
    assert log.export_segments([], f"{tmp_path}/wal") == []
    with pytest.raises(errors.SegmentNotFound):
        log.export_segments([sealed[0], 10**6], f"{tmp_path}/wal")
    (tmp_path / f"{5:020d}.wal").write_bytes(codec.encode([codec.Record(0, None, None, b"again"), codec.Record(7, b"k", None, b"")], 1))
    (tmp_path / f"{6:020d}.wal").write_bytes(codec.encode([codec.Record(0, None, None, b"bad")], 900)[:-1] + b"\0")
    (tmp_path / f"{7:020d}.wal").write_bytes(b"")
    seen = Seen()
    replica = Log(spark, log.root + "-replica", Options(clock=Clock()), seen)
    for wrong in ([], paths[:1] * 2, [*paths, f"{tmp_path}/{6:020d}.wal"], [*paths, f"{tmp_path}/{7:020d}.wal"], [*paths, f"{tmp_path}/{8:020d}.wal"]):
        with pytest.raises(errors.ImportInvalid):
            replica.import_segments(wrong, "zstd")
    assert not replica.manifests.versions()
    last = max(s["last_lsn"] for s in log.manifest.segments if s["sealed"])
    assert replica.import_segments([f"{tmp_path}/{5:020d}.wal", *paths], "zstd") == last
    assert [s["first_lsn"] for s in replica.manifest.segments] == [1, *sealed]
    assert sorted(s["last_lsn"] for s in replica.manifest.segments)[0] == 2
    assert lsns(replica.read()) == sorted([1, 2, *range(1, last + 1)])
    assert sorted(a[:2] for c, a in seen.calls if c == "on_import") == sorted((s["first_lsn"], s["last_lsn"]) for s in replica.manifest.segments)
    assert replica.stats().first()["import_bytes"] == sum(s["size"] for s in replica.manifest.segments)
    commits, commit = [], Manifests.commit
    monkeypatch.setattr(queries, "SEGMENT", 5_000)
    monkeypatch.setattr(Manifests, "commit", lambda self, m: commits.append(len(m.segments)) or commit(self, m))
    got = lsns(queries.store_import(spark, sf))
    assert len(commits) == 3 and commits[2] > 3
    assert got == list(range(1, len(got) + 1)) and len(got) > 500


def test_rebuilt_with_one_listing_of_each_folder(spark, log, monkeypatch):
    for i in range(3):
        log.append(rows(spark, 40, 40 * i), ["ts_ns"])
    segments = [(s["first_lsn"], s["last_lsn"], sorted(s["folders"])) for s in log.manifest.segments]
    assert len(segments) > 7 and max(len(f) for *_, f in segments) > 1
    for v in log.manifests.versions():
        log.files.write(f"{log.manifests.folder}/v{v:010d}.json", b"torn")
    listed, names = [], Files.names
    monkeypatch.setattr(Files, "names", lambda self, uri: listed.append(uri) or names(self, uri))
    rebuilt = Log(spark, log.root, log.options)
    assert [(s["first_lsn"], s["last_lsn"], sorted(s["folders"])) for s in rebuilt.manifest.segments] == segments
    assert lsns(rebuilt.read()) == list(range(1, 121))
    inside = [u for u in listed if "/data/" in u]
    assert len(inside) == len(set(inside)) == 3
