"""CRC-32C (Castagnoli) of one or many byte strings, in lanes.

A checksum's state is linear in the data, and leading zero bytes leave a state of zero alone. So strings are padded in front to
whole lanes, all lanes are run through side by side, two bytes a step, and the lanes' states are put together in pairs: the left
one moved on by the right one's length, which is a linear map of 32 bits, kept as four tables.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Fixed value: the reflected polynomial.
POLYNOMIAL = 0x82F63B78
#: Bytes of a lane at most, and lanes run through side by side.
LANE, SIDE = 1024, 16_384
#: Strings under this many bytes are cheaper one byte after the other.
SHORT = 48


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1)).astype(np.uint32)
    return t


TABLE = _table()
PLAIN = TABLE.tolist()


@cache
def _pairs() -> np.ndarray:
    """What two zero bytes make of a state's lower 16 bits."""
    low = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(2):
        low = TABLE[low & np.uint32(255)] ^ (low >> np.uint32(8))
    return low


@cache
def _moved(n: int) -> np.ndarray:
    """What n zero bytes (a power of two) make of each byte of a state."""
    if n == 1:
        states = np.arange(256, dtype=np.uint32)[None] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
        return TABLE[states & np.uint32(255)] ^ (states >> np.uint32(8))
    half = _moved(n // 2)
    return _apply(half, half)


def _apply(tables: np.ndarray, states: np.ndarray) -> np.ndarray:
    out = tables[0][states & np.uint32(255)]
    for i in range(1, 4):
        out = out ^ tables[i][(states >> np.uint32(8 * i)) & np.uint32(255)]
    return out


def _lanes(rows: np.ndarray) -> np.ndarray:
    """States after the bytes of each row, from zero."""
    step, out = _pairs(), np.empty(len(rows), np.uint32)
    for a in range(0, len(rows), SIDE):
        words = np.ascontiguousarray(rows[a : a + SIDE].view("<u2").T)
        state = np.zeros(words.shape[1], np.uint32)
        for w in words:
            state = step[(state ^ w) & np.uint32(0xFFFF)] ^ (state >> np.uint32(16))
        out[a : a + SIDE] = state
    return out


def crc32c_many(items: list[bytes]) -> np.ndarray:
    """The checksums of many byte strings."""
    sizes = np.array([len(x) for x in items], np.int64)
    out = np.zeros(len(items), np.uint32)
    for i in np.flatnonzero(sizes < SHORT).tolist():
        out[i] = _plain(items[i])
    long = np.flatnonzero(sizes >= SHORT)
    if not len(long):
        return out
    lane = min(LANE, *(1 << int(n).bit_length() - 1 for n in (np.median(sizes[long]), max(SHORT, sizes[long].sum() ** 0.5))))
    counts = -(-sizes[long] // lane)
    rows = np.zeros(int(counts.sum()) * lane, np.uint8)
    ends = np.cumsum(counts) * lane
    for i, end in zip(long.tolist(), ends.tolist(), strict=True):
        rows[end - len(items[i]) : end] = np.frombuffer(items[i], np.uint8)
    first = ends - sizes[long]
    for k in range(4):  # the state begins with all bits set
        rows[first + k] ^= 0xFF
    states = _lanes(rows.reshape(-1, lane))
    while counts.max() > 1:
        begin, half = np.cumsum(counts) - counts, -(-counts // 2)
        which = np.repeat(np.arange(len(counts)), half)
        pair = np.arange(int(half.sum())) - np.repeat(np.cumsum(half) - half, half)
        right = begin[which] + 2 * pair + 1 - counts[which] % 2
        left = np.where((pair == 0) & (counts[which] % 2 == 1), np.uint32(0), states[right - 1])
        states, counts, lane = _apply(_moved(lane), left) ^ states[right], half, 2 * lane
    out[long] = states ^ np.uint32(0xFFFFFFFF)
    return out


def _plain(data: bytes) -> int:
    value = 0xFFFFFFFF
    for b in data:
        value = PLAIN[(value ^ b) & 0xFF] ^ (value >> 8)
    return value ^ 0xFFFFFFFF


def crc32c(data: bytes) -> int:
    return _plain(data) if len(data) < SHORT else int(crc32c_many([data])[0])
