"""Frames, index and manifest files: golden cases and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.errors import ChecksumMismatch, CodecRequired, InvalidFrame, ManifestError
from tidelog.functions.checksums import crc32c, crc32c_many
from tidelog.sources import codec
from tidelog.sources.codec import Record


def rec(payload, ts=1000, key=None, meta=None):
    return Record(ts, key, meta, payload)


def test_crc():
    assert crc32c(b"123456789") == 0xE3069283
    items = [b"", b"a", b"123456789", bytes(range(256)) * 3]
    assert crc32c_many(items).tolist() == [crc32c(x) for x in items]
    assert crc32c_many([]).tolist() == []


def test_uniform_and_own_timestamps():
    h, records = codec.decode(codec.encode([rec(b"hello"), rec(b"world")], 1))
    assert (h.flags, h.count, h.first_lsn, h.ts_ns, h.size) == (0, 2, 1, 1000, 32 + 2 * 13)
    assert [r.ts_ns for r in records] == [1000, 1000]
    h, records = codec.decode(codec.encode([rec(b"a", 100), rec(b"b", 200)], 10))
    assert (h.flags, h.size) == (codec.PER_RECORD_TS, 32 + 2 * 17)
    assert [r.ts_ns for r in records] == [100, 200]


def test_key_meta_and_empty_fields():
    assert codec.decode(codec.encode([rec(b"data", 5, b"user-1", b"created")], 1))[1] == [rec(b"data", 5, b"user-1", b"created")]
    assert codec.decode(codec.encode([rec(b"", 5, b"", b"")], 1))[1] == [rec(b"", 5)]


def test_bad_frames():
    good = codec.encode([rec(b"x" * 20)], 1)
    with pytest.raises(ChecksumMismatch):
        codec.decode(good[:-5] + bytes([good[-5] ^ 1]) + good[-4:])
    with pytest.raises(InvalidFrame):
        codec.decode(good[:10])
    for at, value in ((4, 0), (4, 2), (24, 31)):
        with pytest.raises(InvalidFrame):
            codec.scan(good[:at] + bytes([value]) + good[at + 1 :])
    for records, first in (([], 1), ([rec(b"")] * 65_536, 1), ([rec(b"")], 0), ([rec(b"")], 1 << 63), ([rec(b"", 1, b"k" * 65_536)], 1)):
        with pytest.raises(InvalidFrame):
            codec.encode(records, first)


def test_two_frames_and_good_prefix():
    a, b = codec.encode([rec(b"a")], 1), codec.encode([rec(b"b")], 2)
    assert [h.first_lsn for _, h in codec.walk(a + b)] == [1, 2]
    found, end, bad = codec.good_prefix(a + b[:-1])
    assert ([h.first_lsn for _, h in found], end, bad) == ([1], len(a), True)
    assert codec.good_prefix(b"") == ([], 0, False)


def test_compression():
    records = [rec(b"same " * 100)]
    packed = codec.encode(records, 1, codec.codec_of("zstd"))
    assert len(packed) < len(codec.encode(records, 1))
    assert codec.decode(packed, 0, codec.codec_of("zstd"))[1] == records
    with pytest.raises(CodecRequired):
        codec.decode(packed)
    small = codec.encode([rec(b"a")], 1, codec.codec_of("zlib"))  # would grow, so it stays plain
    assert codec.decode(small)[1] == [rec(b"a")]


def test_index():
    entries = [(1, 0, 1000), (10, 500, 2000), (20, 1200, 3000), (30, 2000, 4000)]
    assert [codec.find_lsn(entries, x) for x in (0, 1, 5, 10, 15, 25, 30, 99)] == [0, 0, 0, 500, 500, 1200, 2000, 2000]
    assert [codec.find_ts(entries[:3], x) for x in (500, 1000, 1500, 2000, 3000, 5000)] == [0, 0, 500, 500, 1200, -1]
    data = codec.index_bytes(entries)
    assert codec.read_index(data) == entries
    with pytest.raises(ChecksumMismatch):
        codec.read_index(bytes([data[0] ^ 1]) + data[1:])
    assert codec.read_index(b"") == []


def test_manifest():
    entry = {"first_lsn": 1, "last_lsn": 9, "size": 100, "created_at": 5, "first_ts": 1, "last_ts": 2, "sealed": True}
    data = codec.manifest_bytes([entry, entry | {"sealed": False}], 9)
    assert len(data) == 13 + 2 * 49 + 4
    assert codec.read_manifest(data) == ([entry, entry | {"sealed": False}], 9)
    with pytest.raises(ManifestError):
        codec.read_manifest(data[:20])
    with pytest.raises(ManifestError):
        codec.read_manifest(b"\x02" + data[1:])
    with pytest.raises(ChecksumMismatch):
        codec.read_manifest(data[:-1] + bytes([data[-1] ^ 1]))


fields = st.binary(max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), fields, fields, fields), min_size=1, max_size=8), st.integers(1, 2**63 - 1))
def test_round_trip(rows, first):
    records = [Record(t, k or None, m or None, p) for t, k, m, p in rows]
    for name in (None, "zstd"):
        c = codec.codec_of(name)
        assert codec.decode(codec.encode(records, first, c), 0, c)[1] == records


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=100))
def test_random_bytes_are_no_frame(data):
    with pytest.raises((InvalidFrame, ChecksumMismatch)):
        codec.decode(data)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 255))
def test_one_changed_byte_keeps_a_prefix(at, change):
    frames = [codec.encode([rec(b"event-%d" % i)], i + 1) for i in range(10)]
    data = b"".join(frames)
    at %= len(data)
    found, _, bad = codec.good_prefix(data[:at] + bytes([data[at] ^ change]) + data[at + 1 :])
    assert bad
    assert [h.first_lsn for _, h in found] == list(range(1, at // len(frames[0]) + 1))
