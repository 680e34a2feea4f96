"""Binary frames: encoding, decoding, header scans, index and manifest files of the interchange format."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ChecksumMismatch, CodecRequired, DecompressError, InvalidFrame, ManifestError
from ..functions.checksums import crc32c, crc32c_many
from ..functions.columns import FRAME_BYTES, MOST_KEY_BYTES, MOST_META_BYTES, MOST_RECORDS, RECORD_BYTES, STAMPED_RECORD_BYTES

#: Fixed values of the format, all little-endian: magic, version, flags, count, first number, timestamp, size of all.
MAGIC, VERSION, COMPRESSED, PER_RECORD_TS = b"EWAL", 1, 1, 2
HEADER = struct.Struct("<4sBBHQqI")
#: An index entry is first number, offset, timestamp; a manifest's head is version, entries, last number.
INDEX_ENTRY, MANIFEST_HEAD, MANIFEST_ENTRY = struct.Struct("<Qqq"), struct.Struct("<BIQ"), struct.Struct("<QQqqqqB")
LENGTHS, STAMP, CHECKSUM = struct.Struct("<HHI"), struct.Struct("<q"), struct.Struct("<I")


class Record(NamedTuple):
    ts_ns: int
    key: bytes | None
    meta: bytes | None
    payload: bytes


class Header(NamedTuple):
    flags: int
    count: int
    first_lsn: int
    ts_ns: int
    size: int


class Codec:
    """Compression of a frame's records."""

    def __init__(self, name: str):
        import zlib

        if name == "zstd":
            import zstandard

            self.compress, self.decompress = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress
        elif name == "zlib":
            self.compress, self.decompress = zlib.compress, zlib.decompress
        else:
            raise ValueError(f"no codec {name}")


#: Bytes of frames whose checksums are computed together.
VERIFIED_BYTES = 32 << 20
CODECS = {"zstd": Codec, "zlib": Codec}


def codec_of(name: str | None):
    return CODECS[name](name) if name else None


def frame_body(records: list[Record], first_lsn: int, codec=None) -> bytes:
    """A frame without its checksum."""
    if not 0 < len(records) <= MOST_RECORDS:
        raise InvalidFrame(f"{len(records)} records")
    if not 0 < first_lsn < 1 << 63:
        raise InvalidFrame(f"first number {first_lsn}")
    stamped = any(r.ts_ns != records[0].ts_ns for r in records)
    parts = []
    for r in records:
        key, meta = r.key or b"", r.meta or b""
        if len(key) > MOST_KEY_BYTES or len(meta) > MOST_META_BYTES:
            raise InvalidFrame("key or meta too long")
        parts += [STAMP.pack(r.ts_ns)] * stamped + [LENGTHS.pack(len(key), len(meta), len(r.payload)), key, meta, r.payload]
    region, flags = b"".join(parts), PER_RECORD_TS * stamped
    if codec is not None and len(small := codec.compress(region)) < len(region):
        region, flags = small, flags | COMPRESSED
    return HEADER.pack(MAGIC, VERSION, flags, len(records), first_lsn, records[0].ts_ns, FRAME_BYTES + len(region)) + region


def sealed(bodies: list[bytes]) -> list[bytes]:
    """Whole frames of many bodies, checksums computed together."""
    return [b + CHECKSUM.pack(s) for b, s in zip(bodies, crc32c_many(bodies).tolist(), strict=True)]


def encode(records: list[Record], first_lsn: int, codec=None) -> bytes:
    body = frame_body(records, first_lsn, codec)
    return body + CHECKSUM.pack(crc32c(body))


def header_at(data: bytes, at: int) -> Header:
    """The header of the frame at a place, its bounds checked but not its checksum."""
    if at + HEADER.size > len(data):
        raise InvalidFrame(f"no whole header at {at}")
    magic, version, flags, count, first, ts, size = HEADER.unpack_from(data, at)
    if magic != MAGIC or not 0 < version <= VERSION or size < FRAME_BYTES or at + size > len(data):
        raise InvalidFrame(f"no frame at {at}")
    return Header(flags, count, first, ts, size)


def scan(data: bytes, at: int = 0) -> Header:
    """The header of the frame at a place, all checked."""
    h = header_at(data, at)
    end = at + h.size - CHECKSUM.size
    if CHECKSUM.unpack_from(data, end)[0] != crc32c(data[at:end]):
        raise ChecksumMismatch(f"frame at {at}")
    return h


def records_of(data: bytes, at: int, h: Header, codec=None) -> list[Record]:
    region = data[at + HEADER.size : at + h.size - CHECKSUM.size]
    if h.flags & COMPRESSED:
        if codec is None:
            raise CodecRequired("the frame is compressed")
        try:
            region = codec.decompress(region)
        except Exception as e:
            raise DecompressError(str(e)) from e
    out, place, fixed = [], 0, STAMPED_RECORD_BYTES if h.flags & PER_RECORD_TS else RECORD_BYTES
    for _ in range(h.count):
        if place + fixed > len(region):
            raise InvalidFrame("records end early")
        ts = h.ts_ns
        if h.flags & PER_RECORD_TS:
            ts = STAMP.unpack_from(region, place)[0]
            place += STAMP.size
        k, m, p = LENGTHS.unpack_from(region, place)
        place += LENGTHS.size
        if place + k + m + p > len(region):
            raise InvalidFrame("a record ends after its region")
        out.append(Record(ts, region[place : place + k] or None, region[place + k : place + k + m] or None, region[place + k + m : place + k + m + p]))
        place += k + m + p
    return out


def decode(data: bytes, at: int = 0, codec=None) -> tuple[Header, list[Record]]:
    h = scan(data, at)
    return h, records_of(data, at, h, codec)


def walk(data: bytes) -> Iterator[tuple[int, Header]]:
    """(place, header) of the frames of a segment's file; raises at the first bad one. Checksums of many are computed together."""
    at = 0
    while at < len(data):
        found, end, bad = [], at, None
        while bad is None and end < len(data) and end - at < VERIFIED_BYTES:
            try:
                h = header_at(data, end)
                found.append((end, h))
                end += h.size
            except InvalidFrame as e:
                bad = e
        sums = crc32c_many([data[p : p + h.size - CHECKSUM.size] for p, h in found])
        for (p, h), s in zip(found, sums.tolist(), strict=True):
            if CHECKSUM.unpack_from(data, p + h.size - CHECKSUM.size)[0] != s:
                raise ChecksumMismatch(f"frame at {p}")
            yield p, h
        if bad:
            raise bad
        at = end


def good_prefix(data: bytes) -> tuple[list[tuple[int, Header]], int, bool]:
    """(frames before the first bad one, bytes of them, whether one is bad)."""
    found, end = [], 0
    try:
        for at, h in walk(data):
            found.append((at, h))
            end = at + h.size
    except (InvalidFrame, ChecksumMismatch):
        return found, end, True
    return found, end, False


def index_bytes(entries: list[tuple[int, int, int]]) -> bytes:
    data = b"".join(INDEX_ENTRY.pack(*e) for e in entries)
    return data + CHECKSUM.pack(crc32c(data))


def read_index(data: bytes) -> list[tuple[int, int, int]]:
    """(first number, offset, timestamp) of each frame."""
    if len(data) < CHECKSUM.size:
        return []
    body = data[: -CHECKSUM.size]
    if len(body) % INDEX_ENTRY.size:
        raise InvalidFrame("index of odd length")
    if CHECKSUM.unpack(data[-CHECKSUM.size :])[0] != crc32c(body):
        raise ChecksumMismatch("index")
    return list(INDEX_ENTRY.iter_unpack(body))


def find_lsn(entries: list[tuple[int, int, int]], lsn: int) -> int:
    """Offset of the last frame that starts at or before lsn, else of the first."""
    from bisect import bisect_right

    return entries[max(0, bisect_right(entries, lsn, key=lambda e: e[0]) - 1)][1] if entries else 0


def find_ts(entries: list[tuple[int, int, int]], ts: int) -> int:
    """Offset of the first frame at or after ts, else -1."""
    from bisect import bisect_left

    at = bisect_left(entries, ts, key=lambda e: e[2])
    return entries[at][1] if at < len(entries) else -1


def manifest_bytes(entries: list[dict], last_lsn: int) -> bytes:
    data = MANIFEST_HEAD.pack(VERSION, len(entries), last_lsn) + b"".join(
        MANIFEST_ENTRY.pack(*(e[k] for k in ("first_lsn", "last_lsn", "size", "created_at", "first_ts", "last_ts", "sealed"))) for e in entries
    )
    return data + CHECKSUM.pack(crc32c(data))


def read_manifest(data: bytes) -> tuple[list[dict], int]:
    """(entries, last number)."""
    if len(data) < MANIFEST_HEAD.size + CHECKSUM.size:
        raise ManifestError("truncated")
    version, n, last = MANIFEST_HEAD.unpack_from(data)
    if version != VERSION:
        raise ManifestError(f"version {version}")
    end = MANIFEST_HEAD.size + n * MANIFEST_ENTRY.size
    if len(data) < end + CHECKSUM.size:
        raise ManifestError("truncated")
    if CHECKSUM.unpack_from(data, end)[0] != crc32c(data[:end]):
        raise ChecksumMismatch("manifest")
    names = ("first_lsn", "last_lsn", "size", "created_at", "first_ts", "last_ts", "sealed")
    rows = [dict(zip(names, e, strict=True)) for e in MANIFEST_ENTRY.iter_unpack(data[MANIFEST_HEAD.size : end])]
    return [r | {"sealed": bool(r["sealed"])} for r in rows], last


EVENTS = "lsn long, ts_ns long, key binary, meta binary, payload binary"
HEADERS = "first_lsn long, last_lsn long, cnt long, frame_ts long, per_record_ts boolean, compressed boolean, size long"


def encode_frames(log: DataFrame, key: str = "batch_first_lsn", codec: str | None = None) -> DataFrame:
    """key, first_lsn, frame (binary): one for each batch. A batch is bounded by the format's limits."""
    event = F.struct("lsn", "ts_ns", "key", "meta", F.coalesce("payload", F.lit(b"")).alias("payload"))
    batches = log.groupBy(key).agg(F.min("lsn").alias("first_lsn"), F.sort_array(F.collect_list(event)).alias("events"))
    kind = log.schema[key].dataType.simpleString()

    def run(rows):
        c = codec_of(codec)
        for batch in rows:
            bodies = []
            for events in batch.column("events"):
                e = events.as_py()
                bodies.append(frame_body([Record(x["ts_ns"], x["key"], x["meta"], x["payload"]) for x in e], e[0]["lsn"], c))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("first_lsn"), pa.array(sealed(bodies), pa.binary())], names=[key, "first_lsn", "frame"])

    return batches.mapInArrow(run, f"`{key}` {kind}, first_lsn long, frame binary")


INDEX = "segment_lsn long, first_lsn long, offset long, frame_ts long"


def encode_index(placed: DataFrame) -> DataFrame:
    """segment_lsn, index (binary): the sparse index of each segment's frames. A segment's size bounds their number."""
    entry = F.struct("first_lsn", "offset", "frame_ts")
    each = placed.groupBy("segment_lsn").agg(F.sort_array(F.collect_list(entry)).alias("entries"))

    def run(rows):
        for batch in rows:
            data = [index_bytes([(e["first_lsn"], e["offset"], e["frame_ts"]) for e in entries.as_py()]) for entries in batch.column("entries")]
            yield pa.RecordBatch.from_arrays([batch.column("segment_lsn"), pa.array(data, pa.binary())], names=["segment_lsn", "index"])

    return each.mapInArrow(run, "segment_lsn long, index binary")


def decode_index(indexes: DataFrame) -> DataFrame:
    """A row for each entry of sparse indexes (segment_lsn, index); a bad one raises."""

    def run(rows):
        for batch in rows:
            out = [(s, *e) for s, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for e in read_index(data)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["segment_lsn", "first_lsn", "offset", "frame_ts"])

    return indexes.select("segment_lsn", "index").mapInArrow(run, INDEX)


def verified(frames: list[bytes]) -> list[Header]:
    """Headers of whole frames, checksums computed together."""
    heads = [header_at(f, 0) for f in frames]
    sums = crc32c_many([f[: h.size - CHECKSUM.size] for f, h in zip(frames, heads, strict=True)])
    for f, h, s in zip(frames, heads, sums.tolist(), strict=True):
        if CHECKSUM.unpack_from(f, h.size - CHECKSUM.size)[0] != s:
            raise ChecksumMismatch(f"frame of {h.first_lsn}")
    return heads


def decode_frames(frames: DataFrame, codec: str | None = None) -> DataFrame:
    """Events of frames (column frame); bad frames raise."""

    def run(rows):
        c = codec_of(codec)
        for batch in rows:
            data = batch.column(0).to_pylist()
            out: list[list] = [[], [], [], [], []]
            for f, h in zip(data, verified(data), strict=True):
                for i, r in enumerate(records_of(f, 0, h, c)):
                    for column, v in zip(out, (h.first_lsn + i, *r), strict=True):
                        column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["lsn", "ts_ns", "key", "meta", "payload"])

    return frames.select("frame").mapInArrow(run, EVENTS)


def scan_frames(frames: DataFrame) -> DataFrame:
    """Headers of frames (column frame), records left alone."""

    def run(rows):
        for batch in rows:
            yield header_batch(verified(batch.column(0).to_pylist()))

    return frames.select("frame").mapInArrow(run, HEADERS)


def header_batch(heads: list[Header]) -> pa.RecordBatch:
    rows = [(h.first_lsn, h.first_lsn + h.count - 1, h.count, h.ts_ns, bool(h.flags & PER_RECORD_TS), bool(h.flags & COMPRESSED), h.size) for h in heads]
    kinds = (pa.int64(),) * 4 + (pa.bool_(),) * 2 + (pa.int64(),)
    names = ["first_lsn", "last_lsn", "cnt", "frame_ts", "per_record_ts", "compressed", "size"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
