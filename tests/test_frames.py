"""Placement of frames, merged seeks and checksums against plain readings of their definitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.functions import checksums
from tidelog.operators import frames, reads


def placed_by_hand(rows, limit, opened=None):
    segment, at = opened or (0, limit)
    out = {}
    for lsn, size in rows:
        if at >= limit:
            segment, at = lsn, 0
        out[lsn] = (segment, at)
        at += size
    return out


@pytest.mark.parametrize("opened", [None, (-7, 30), (-7, 0)])
@pytest.mark.parametrize(("limit", "largest"), [(100, 40), (100, 1000), (10**9, 50), (1, 5)])
def test_placement_over_ranges(spark, limit, largest, opened):
    r = random.Random(limit + largest)
    lsn, rows = 1, []
    for _ in range(300):
        rows.append((lsn, r.randint(1, largest)))
        lsn += r.randint(1, 9)
    df = spark.createDataFrame(rows, "first_lsn long, size long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x["first_lsn"]: (x["segment_lsn"], x["offset"]) for x in frames.place(df, limit, opened=opened).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == placed_by_hand(rows, limit, opened)
    assert frames.place(df.limit(0), limit).count() == 0


def test_placement_of_a_million_frames(spark):
    df = spark.range(1, 1_000_001).select(F.col("id").alias("first_lsn"), F.lit(4096).cast("long").alias("size"))
    segments = frames.place(df, 256 << 10).groupBy("segment_lsn").agg(F.sum("size").alias("n"), F.max("offset").alias("o")).agg(F.count(F.lit(1)).alias("segments"), F.max("n").alias("n"), F.max("o").alias("o")).first()
    assert tuple(segments) == (15_625, 256 << 10, 63 * 4096)


def test_seek_by_time(spark):
    r = random.Random(4)
    rows = [(i, r.choice([-(2**63), 5, 7, 7, 9, 100, 2**63 - 1, r.randint(0, 50)])) for i in range(1, 60)]
    probes = [0, 5, 6, 7, 8, 51, 100, 101, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame(rows, "first_lsn long, frame_ts long").repartition(3)
    got = {x["probe_ts"]: x["first_lsn"] for x in reads.seek_ts(df, spark.createDataFrame([(p,) for p in probes], "probe_ts long")).collect()}
    assert got == {p: min((i for i, t in rows if t >= p), default=None) for p in probes}


def test_checksums_in_lanes():
    r = random.Random(1)
    assert checksums.crc32c(b"123456789") == 0xE3069283
    items = [r.randbytes(r.choice([0, 1, 3, 4, 47, 48, 49, 64, 100, 1023, 1024, 1025, 5000, 70_000])) for _ in range(120)] + [b"\0" * 5000]
    want = [checksums._plain(x) for x in items]
    assert checksums.crc32c_many(items).tolist() == want
    assert [checksums.crc32c(x) for x in items] == want
    assert checksums.crc32c_many([]).tolist() == []


def test_ways_agree_with_the_fold():
    r = np.random.default_rng(2)
    for _ in range(50):
        sizes = r.integers(1, 30, 40)
        begins = np.cumsum(sizes) - sizes + 1000
        at, cut, lsn = frames.ways(begins, np.arange(40), 60)
        for since in range(1000, 1060):
            i = int(np.searchsorted(begins, since))
            if i < 40:
                while (k := int(np.searchsorted(begins, begins[i] + 60))) < 40:
                    i = k
                j = int(np.searchsorted(at, since))
                assert (cut[j], lsn[j]) == (begins[i], i)
