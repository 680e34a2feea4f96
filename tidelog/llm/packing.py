"""Best-fit packing of token sequences into bins of fixed capacity, certified by lower bounds.

Documents become token sequences (a final id 0 each); only longer ones than the capacity are cut, the first piece taking the
remainder. Pieces are dealt at random into packing partitions of bounded size, each packed best-fit decreasing. Dual-feasible
functions give a lower bound of each partition's bin count: a partition that meets its bound, or in which no bin has a gap
that matters, is certified and final. Partitions with gaps keep their well-filled bins; the pieces of the others are dealt
anew, among fewer partitions, and packed again, until one partition is left or a round gains nothing.

Nulls count as empty texts, which have one token (the final id 0). Texts are encoded whole; a long one becomes many pieces. Ids
have any type, and null ones are packed as others are. Repeated rows are packed each; pieces of equal length go by id, so ties
are settled alike each time. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, lean
from .tokens import default_tokenizer, loaded

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one packing partition, at least: many enough that best fit leaves almost no waste.
PARTITION_PIECES = 20_000
#: Sequence numbers: round, partition, bin.
BIN_BITS, PART_BITS = 24, 32


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole capacities, the first piece shorter where it must be."""
    first = n - capacity * ((n - 1) // capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """A row for each piece of each document, with the checksum of its ids."""
    lean(docs.sparkSession)
    path, kind = tokenizer or default_tokenizer(), docs.schema["doc_id"].dataType

    def run(batches):
        t = loaded(path)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows: list[list] = [[], [], [], [], []]
            for i, tokens in t.each(texts, True):
                tokens = np.concatenate([tokens, end]).astype("<u4")
                data = memoryview(tokens.tobytes())
                for k, (s, n) in enumerate(cut(len(tokens), capacity)):
                    for column, value in zip(rows, (i, k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)])), strict=True):
                        column.append(value)
            ids = batch.column(0).take(pa.array(rows[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(rows[1], pa.int32()), *(pa.array(v, pa.int64()) for v in rows[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, PIECE.replace("doc_id long", f"doc_id {kind.simpleString()}"))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin, offset) of each item, and the fill of each bin. Bins wait by their free room; the least room that fits is taken."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # sorted rooms that have a waiting bin
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = waiting[room].pop()
            if not waiting[room]:
                del rooms[at]
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += n
        if room > n:
            if not waiting[room - n]:
                insort(rooms, room - n)
            waiting[room - n].append(b)
    return where, offset, fill


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the largest bound of two families of dual-feasible functions (Fekete and Schepers)."""
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    # sizes over capacity - e count whole, those under e nothing
    for e in sizes[sizes <= capacity // 2].tolist():
        whole, middle = sizes > capacity - e, (sizes >= e) & (sizes <= capacity - e)
        best = max(best, int(counts[whole].sum()) + -(-int((sizes * counts)[middle].sum()) // capacity))
    # steps of 1/k
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        even = scaled % capacity == 0
        value = np.where(even, sizes * k, scaled // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def pack_partition(lengths: np.ndarray, capacity: int, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, gap) of each item; gap: the partition isn't certified and the item's bin has room that an exchange could fill."""
    where, offset, fill = best_fit_decreasing(lengths, capacity)
    if len(fill) <= lower_bound(lengths, capacity):
        return where, offset, np.zeros(len(lengths), bool)
    return where, offset, (np.array(fill) < capacity * (1 - slack))[where]


def pack(pieces: DataFrame, capacity: int = 2048, partition_pieces: int = PARTITION_PIECES, slack: float = 0.01) -> DataFrame:
    """pieces with sequence_id and offset: sequences hold capacity tokens at most and have no holes before their end."""
    schema = pieces.select("*", *[F.lit(0).cast("long").alias(c) for c in ("sequence_id", "offset")], F.lit(False).alias("gap")).schema

    def packer(turn: int):
        def run(key, table):
            table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
            where, offset, gap = pack_partition(table.column("length").to_numpy(), capacity, slack)
            number = (turn << (BIN_BITS + PART_BITS)) + (key[0].as_py() << BIN_BITS) + where
            return pa.Table.from_arrays([*(table.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(number), pa.array(offset), pa.array(gap)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap"])

        return run

    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "gap": F.lit(False)})
    done, rest, before = [full], pieces.where(F.col("length") < capacity), None
    turn = 0
    while (n := rest.count()) and (before is None or n < before):
        parts = max(1, n // partition_pieces)
        dealt = rest.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), "doc_id", "piece", "start"), F.lit(parts)))
        placed = durable(dealt.groupBy("part").applyInArrow(packer(turn), schema))
        if parts == 1:
            done.append(placed)
            rest = None
            break
        done.append(placed.where(~F.col("gap")))
        before, rest, turn = n, placed.where("gap").select(pieces.columns), turn + 1
    if rest is not None and before is not None:
        done.append(placed.where("gap"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("gap")


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    return pack(durable(token_pieces(docs, capacity, tokenizer)), capacity)
