"""Exact n-gram Jaccard join by PartEnum signatures (Arasu, Ganti, Kaushik), and the components of its links.

A document's set holds 64-bit hashes of its distinct word n-grams; words are hashed by tabulation, so that no structure of words
makes different ones meet. Equal sets are one node, named by 128 bits of a second, independent hash of the same n-grams.

Sizes are cut into bands; a pair belongs to the band of its larger set. The hash domain is cut into ranges and each into three.
A set whose distance to any partner of a band is d at most tells, of the first ranges, so many that d // 2 + 1 + SPARE of them
have no two empty thirds: in all but d // 2 ranges linked sets differ by one element at most, so they agree on two of the three
thirds there. Each (range, two thirds) gives a signature, and only sets with a common signature are compared. Sets that run out
of ranges tell their empty thirds too, which they share with each other only.

Linked sets thus share over SPARE signatures, so each may leave its SPARE largest groups without losing a partner (a prefix
filter). In a group, all are compared first with the member that shares most with others, as near copies of one text lie nearest
to that text; then follow the pairs between those that still lie in several
components, in blocks. Sizes and counts over the hash domain prove most pairs too different before their elements are read.
Nothing is capped: a signature that much of a task's texts share leaves that task in parts and doesn't meet the rest of its rows in
one place, large groups are compared in blocks that several tasks share, and cost a row for each member, not for each pair,
where their members are near copies.

Signatures name nodes by 48 bits; where two nodes have those in common, both stand for them and are compared with each other.

Null and empty texts have no set and are alone. Null ids are never a component's id, but their rows link as others do. Repeated
rows are equal sets. Texts are handled whole, however long. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache, reduce
from hashlib import blake2b
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, binary_array, chunks, fresh, lean, shuffle_width, splitmix, word_hashes
from .graph import components

#: Growth of the size bands.
GROWTH = 1.6
#: Signatures that linked sets share beyond one, so that each may leave as many groups.
SPARE = 2
#: Ranges of a band beyond those that its largest sets need, as a share: some have empty thirds.
SLACK = 0.02
#: Counts in the summary that bounds an overlap from above.
SUMMARY = 128
#: Sizes whose bands a worker remembers.
KNOWN = 4_096
#: Bytes of signatures that a task holds before it passes them on.
FLUSH = 12 << 20
#: Rows of one bucket that a task holds at most, and rows of one signature that then leave in parts.
HELD, HOT = 2_000_000, 16_384
#: Rows of one signature among those that are passed on together that leave in parts at once; the spare that marks such a signature.
LOCAL_HOT, MARK = 128, 3
#: Members in a row that tells of a group or a part of one.
PART = 4_096
#: Comparisons of one set that a task makes, and members in a block of a group: more are dealt out.
DEALT, BLOCK = 64, 256
#: Groups that a node names, so that a pair of several groups is told of by one.
FIRST = 16
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
DOUBLE = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str], size: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(index, sorted distinct hashes, name) of each text's word n-grams; a text of fewer words is one n-gram."""
    factors = splitmix(np.arange(1, 2 * size + 1, dtype=np.uint64) * DOUBLE) | np.uint64(1)
    for a, b in chunks(texts):
        data = [t.encode().lower() for t in texts[a:b]]
        starts = np.cumsum([0] + [len(d) + 1 for d in data])
        begin, *both = word_hashes(b" ".join(data) + b" ", SPACES)
        bounds = np.searchsorted(begin, starts).tolist()
        with np.errstate(over="ignore"):
            whole = max(0, len(begin) - size + 1)
            first, second = (splitmix(sum((h[j : j + whole] * factors[k * size + j] for j in range(size)), np.zeros(whole, np.uint64))) for k, h in enumerate(both))
            for i in range(b - a):
                lo, hi = bounds[i], bounds[i + 1]
                if hi - lo >= size:
                    s, at = np.unique(first[lo : hi - size + 1], return_index=True)
                    t = second[lo : hi - size + 1][at]
                elif hi > lo:
                    s, t = (splitmix(np.array([(h[lo:hi] * factors[k * size : k * size + hi - lo]).sum() + np.uint64(hi - lo)], np.uint64)) for k, h in enumerate(both))
                else:
                    s = t = np.zeros(0, np.uint64)
                yield a + i, s, name_of(s, t)


def name_of(s: np.ndarray, t: np.ndarray) -> bytes:
    """128 bits that name a set, from both hashes of its elements."""
    with np.errstate(over="ignore"):
        sums = np.array([splitmix(t + DOUBLE).sum(), splitmix(t ^ splitmix(s)).sum()], np.uint64)
        return splitmix(sums ^ splitmix(sums[::-1] + np.uint64(len(s)))).tobytes()


class Windows(NamedTuple):
    """Size bands and their signature schemes for similarity num / den.

    A value, as each task gets a copy of its own: a worker that runs many tasks holds the schemes once.
    """

    num: int
    den: int

    @cache
    def begin(self, w: int) -> int:
        return 1 if w == 0 else max(self.begin(w - 1) + 1, int(self.begin(w - 1) * GROWTH))

    def distance(self, n: int, w: int) -> int:
        """The largest Hamming distance of a set of size n to a linked one, the larger of the two in band w; -1 if none is in reach."""
        largest = min(self.begin(w + 1) - 1, n * self.den // self.num)
        return (n + largest) * (self.den - self.num) // (self.den + self.num) if largest >= self.begin(w) else -1

    @lru_cache(KNOWN)
    def of(self, n: int) -> list[tuple[int, int]]:
        """(band, distance) of bands in which a set of size n may have a partner that differs from it."""
        w = 0
        while self.begin(w + 1) <= n:
            w += 1
        out = []
        while (d := self.distance(n, w)) >= 0:
            out.append((w, d))
            w += 1
        return [x for x in out if x[1]]

    @cache
    def scheme(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """(bounds of the thirds, tag of each signature)."""
        most = self.distance(self.begin(w + 1) - 1, w)
        thirds = 3 * (int((most // 2 + 1 + SPARE) * (1 + SLACK)) + 1)
        bounds = np.array([(i << 64) // thirds for i in range(1, thirds)], np.uint64)
        tags = splitmix((np.uint64(w) << np.uint64(40)) + np.arange(thirds, dtype=np.uint64) + DOUBLE)
        return bounds, tags.reshape(-1, 3)

    def signatures(self, s: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(band, spare, signatures) of a sorted set; it shares more than spare of them with any linked set of that band."""
        out = []
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(splitmix(s ^ DOUBLE), dtype=np.uint64)])
            for w, most in self.of(len(s)):
                bounds, tags = self.scheme(w)
                at = np.concatenate([[0], np.searchsorted(s, bounds), [len(s)]])
                part, size = np.diff(sums[at]).reshape(-1, 3), np.diff(at).reshape(-1, 3)
                told = size.sum(1, keepdims=True) > size
                good = np.cumsum(told.all(1))
                upto = min(len(good), int(np.searchsorted(good, most // 2 + 1 + SPARE)) + 1)
                spare = int(good[upto - 1]) - most // 2 - 1
                values = splitmix((part.sum(1, keepdims=True, dtype=np.uint64) - part) ^ tags)[:upto][told[:upto]]
                if spare < 0:
                    values = np.concatenate([values, splitmix(~tags[~told])])
                out.append((w, max(spare, 0), values))
        return out


def summary_of(s: np.ndarray) -> bytes:
    """How many elements of a set there are by their first bits: a byte each, or four where one isn't enough."""
    counts = np.bincount(s >> np.uint64(64 - SUMMARY.bit_length() + 1), minlength=SUMMARY) if len(s) else np.zeros(SUMMARY, np.int64)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def counts_of(summary: bytes) -> np.ndarray:
    return np.frombuffer(summary, np.uint8 if len(summary) == SUMMARY else np.uint32).astype(np.int64)


def short_of(name: bytes) -> int:
    """The 48 bits by which signatures name a node."""
    return int.from_bytes(name[:6], "big")


#: A signature's row: its lower 40 bits (the bucket tells of the upper ones), the node's short name, band and spare.
FIELDS = (("sig", 5), ("node", 6), ("kind", 1))
WIDTH = sum(n for _, n in FIELDS)


def lower(values: np.ndarray, n: int) -> np.ndarray:
    """The lower n bytes of each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n])


def raised(data: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = data.reshape(-1, n)
    return out.view("<u8").ravel()


def packed(columns: tuple[np.ndarray, ...]) -> bytes:
    """Rows, field by field."""
    return b"".join(lower(c, n).tobytes() for c, (_, n) in zip(columns, FIELDS, strict=True))


def unpacked(blob: bytes) -> list[np.ndarray]:
    data, m, out, at = np.frombuffer(blob, np.uint8), len(blob) // WIDTH, [], 0
    for _, n in FIELDS:
        out.append(raised(data[at : at + n * m], n))
        at += n * m
    return out


def gid_of(bucket: int, sig: int) -> int:
    """Names the group of a signature that leaves in parts; sig: its lower 40 bits."""
    return int.from_bytes(blake2b(f"{bucket}:{sig}".encode(), digest_size=8).digest(), "little", signed=True)


def much_shared(sigs: np.ndarray, bucket: np.ndarray, node: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(which rows stay, (id of a group, members) of the much shared signatures); of each of those one row stays, as a mark in kind."""
    stays, parts = np.ones(len(sigs), bool), []
    values, counts = np.unique(sigs, return_counts=True)
    for hot in values[counts >= LOCAL_HOT]:
        at = np.flatnonzero(sigs == hot)
        parts.append((gid_of(int(bucket[at[0]]), int(hot) & ((1 << 40) - 1)), np.unique(node[at] << np.uint64(8) | kind[at])))
        stays[at[1:]] = False
        kind[at[0]] = kind[at[0]] & np.uint64(63) | np.uint64(MARK << 6)
    return stays, parts


class Bucket:
    """The signatures of one bucket: groups of the nodes that share one. Rows of a much shared one leave in parts."""

    def __init__(self, number: int):
        self.number, self.rows, self.held, self.hot = number, [], 0, set()

    def add(self, blob: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
        sig, node, kind = unpacked(blob)
        marks = kind >> np.uint64(6) == MARK
        self.hot.update(sig[marks].tolist())
        self.rows.append([c[~marks] for c in (sig, node, kind)])
        self.held += len(blob) // WIDTH
        if self.held > HELD:
            yield from self.relieve()

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(signature, member) of distinct rows, and where signatures begin; a member is node and kind."""
        sig, node, kind = (np.concatenate([r[i] for r in self.rows]) for i in range(3))
        member = node << np.uint64(8) | kind
        order = np.lexsort((member, sig))
        sig, member = sig[order], member[order]
        new = np.r_[True, (sig[1:] != sig[:-1]) | (member[1:] != member[:-1])]
        sig, member = sig[new], member[new]
        return sig, member, np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])

    def relieve(self) -> Iterator[tuple[int | None, np.ndarray]]:
        sig, member, cut = self.distinct()
        stays = np.ones(len(sig), bool)
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(sig)], strict=True):
            if b - a >= HOT or int(sig[a]) in self.hot:
                self.hot.add(int(sig[a]))
                stays[a:b] = False
                yield self.gid(int(sig[a])), member[a:b]
        sig, member = sig[stays], member[stays]
        self.rows = [[sig, member >> np.uint64(8), member & np.uint64(255)]]
        self.held = max(0, len(sig) - HELD // 2)

    def gid(self, sig: int) -> int:
        return gid_of(self.number, sig)

    def groups(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(id of a group that leaves in parts, members)."""
        sig, member, cut = self.distinct()
        ends = np.r_[cut[1:], len(sig)]
        some = (ends - cut > 1) | (np.isin(sig[cut], np.array(list(self.hot), np.uint64)) if self.hot else False)
        for a, b in zip(cut[some].tolist(), ends[some].tolist(), strict=True):
            yield self.gid(int(sig[a])) if int(sig[a]) in self.hot else None, member[a:b]


def nodes_of(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, key (of the text), n_shingles, name (null without words) for each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, name = [0] * batch.num_rows, [None] * batch.num_rows
            for i, s, x in shingle_sets(batch.column(2).to_pylist(), size):
                n[i], name[i] = len(s), x if len(s) else None
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(name, pa.binary())], names=["doc_id", "key", "n_shingles", "name"])

    return keyed(docs).mapInArrow(run, f"doc_id {kind}, key long, n_shingles long, name binary")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, text (null as empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text, F.length(text)).alias("key"), text.alias("text"))


def numbered(named: DataFrame) -> DataFrame:
    """node, name, short, n, doc_id, key for each distinct set: its least id, and a row that has it."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    least = named.where("name is not null").groupBy("name").agg(F.min(row).alias("row"), F.max("n_shingles").alias("n"))
    short = F.conv(F.substring(F.hex("name"), 1, 12), 16, 10).cast("long")
    return least.select(F.monotonically_increasing_id().alias("node"), "name", short.alias("short"), "n", "row.doc_id", "row.key")


def signature_groups(docs: DataFrame, size: int, windows: Windows) -> DataFrame:
    """gid, members (short names, bands and spares, packed), size, times: groups that share signatures, and how many they share."""
    width = shuffle_width(docs.sparkSession)
    buckets = 8 * max(256, width)

    def emit(held: list[tuple[np.ndarray, int, int]]):
        if held:
            sigs = np.concatenate([h[0] for h in held])
            sizes = [len(h[0]) for h in held]
            node, kind = (np.repeat(np.array([h[i] for h in held], np.uint64), sizes) for i in (1, 2))
            bucket = ((sigs >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            stays, parts = much_shared(sigs, bucket, node, kind)
            order = np.flatnonzero(stays)
            order = order[np.argsort(bucket[order], kind="stable")]
            rows, bucket = [c[order] for c in (sigs, node, kind)], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets)))
            blobs = [packed(tuple(c[a:b] for c in rows)) for a, b in zip(cuts, np.r_[cuts[1:], len(order)], strict=True)]
            numbers = bucket[cuts].astype(np.int32).tolist()
            for gid, member in parts:  # by negative numbers, that deal them anywhere
                blobs.append(gid.to_bytes(8, "little", signed=True) + lower(member, 7).tobytes())
                numbers.append(-1 - crc32(blobs[-1]) % buckets)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), binary_array(blobs)], names=["bucket", "rows"])

    def sign(batches):
        held, total, done = [], 0, set()
        for batch in batches:
            for _, s, name in shingle_sets(batch.column(0).to_pylist(), size):
                if len(s) and name not in done:
                    done.add(name)
                    for w, spare, sigs in windows.signatures(s):
                        held.append((sigs, short_of(name), w | spare << 6))
                        total += 24 * len(sigs)
                    if total > FLUSH:
                        yield from emit(held)
                        held, total = [], 0
        yield from emit(held)

    def told(out: Counter) -> pa.RecordBatch:
        keys = list(out)
        columns = [pa.array([k[0] for k in keys], pa.int64()), binary_array([k[1] for k in keys]), pa.array([len(k[1]) // 7 for k in keys], pa.int64()), pa.array(list(out.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["gid", "members", "size", "times"])

    def group(batches):
        bucket, out = None, Counter()

        def take(groups):
            for gid, member in groups:
                data = lower(member, 7).tobytes()
                gid = int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True) if gid is None else gid
                out.update((gid, data[a : a + 7 * PART]) for a in range(0, len(data), 7 * PART))

        def flush(least: int):
            if sum(map(len, (k[1] for k in out))) > least:
                yield told(out)
                out.clear()

        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b < 0:
                    take([(int.from_bytes(blob[:8], "little", signed=True), raised(np.frombuffer(blob, np.uint8, offset=8), 7))])
                    yield from flush(4 << 20)
                    continue
                if bucket is None or b != bucket.number:
                    if bucket:
                        take(bucket.groups())
                        yield from flush(4 << 20)
                    bucket = Bucket(b)
                take(bucket.add(blob))
                if bucket.hot:
                    yield from flush(4 << 20)
        if bucket:
            take(bucket.groups())
        yield told(out)

    signed = keyed(docs).select("text").mapInArrow(sign, "bucket int, rows binary")
    found = signed.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(group, "gid long, members binary, size long, times long")
    return found.groupBy("gid", "members", "size").agg(F.sum("times").alias("times"))


def memberships(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """gid, node, n, weight: what is left of the groups when each node leaves the largest ones that it can spare (a prefix filter).

    Linked nodes share more signatures than either can spare, so they still meet in the least group that has both. Nodes of one
    short name are a group too. weight: how much a node shares with others, for its size.
    """

    def spread(batches):
        for batch in batches:
            data = [raised(np.frombuffer(m, np.uint8), 7) for m in batch.column("members").to_pylist()]
            sizes = np.array([len(m) for m in data], np.int64)
            every = np.concatenate(data) if data else np.zeros(0, np.uint64)
            kind = (every & np.uint64(255)).astype(np.int32)
            repeated = [pa.array(np.repeat(batch.column(c).to_numpy(), sizes)) for c in ("gid", "times", "total")]
            yield pa.RecordBatch.from_arrays([*repeated, pa.array((every >> np.uint64(8)).astype(np.int64)), pa.array(kind & 63), pa.array(kind >> 6)], names=["gid", "times", "total", "short", "band", "spare"])

    total = groups.groupBy("gid").agg(F.sum("size").alias("total"))
    rows = groups.join(total, "gid").select("gid", "times", "total", "members").mapInArrow(spread, "gid long, times long, total long, short long, band int, spare int")
    down = Window.partitionBy("short", "band").orderBy(F.desc("total"), "gid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = rows.withColumn("_left", F.sum("times").over(down)).where(F.col("_left") > F.col("spare")).select("gid", "short")
    twins = nodes.groupBy("short").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.xxhash64("short").alias("gid"), "short")
    weight = rows.groupBy("short").agg(F.sum(F.col("times") * (F.col("total") - 1)).alias("shared"))
    weighed = nodes.join(weight, "short", "left").select("short", "node", "n", F.coalesce(F.col("shared") / F.col("n"), F.lit(0.0)).alias("weight"))
    return left.unionByName(twins).distinct().join(weighed, "short").select("gid", "node", "n", "weight")


def pivot_of(*more: str):
    """Aggregate: the heaviest node of a group, the least of equal ones."""
    return F.max_by(F.struct("node", *more), F.struct(F.col("weight"), -F.col("node")))


def near_in_size(a: str, b: str, num: int, den: int):
    return F.least(a, b) * den >= F.greatest(a, b) * num


def first_pairs(members: DataFrame, num: int, den: int) -> DataFrame:
    """p, m: each group's pivot with all others of a fitting size."""
    pivots = members.groupBy("gid").agg(pivot_of("n").alias("_p"), F.min("node").alias("_a"), F.max("node").alias("_b")).where("_a <> _b").select("gid", F.col("_p.node").alias("p"), F.col("_p.n").alias("_n"))
    pairs = members.join(pivots, "gid").where((F.col("node") != F.col("p")) & near_in_size("n", "_n", num, den))
    return pairs.select("p", F.col("node").alias("m")).distinct()


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node, n, elements, summary of wanted (node, doc_id, key); repeated rows of one give it again."""
    rows = keyed(docs)
    held = rows.join(wanted.withColumnsRenamed({"doc_id": "_id", "key": "_key"}), rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["key"] == F.col("_key"))).select("node", "text")

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for _, s, _ in shingle_sets(batch.column(1).to_pylist(), size):
                for c, v in zip(out, (len(s), s.tobytes(), summary_of(s)), strict=True):
                    c.append(v)
            columns = [batch.column(0), pa.array(out[0], pa.int64()), binary_array(out[1]), binary_array(out[2])]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "elements", "summary"])

    return held.mapInArrow(run, "node long, n long, elements binary, summary binary")


def possible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (p, m) that sizes and summaries don't rule out."""
    few = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("summary").alias(f"s_{c}"))

    def run(batches):
        for batch in batches:
            n_p, n_m = (batch.column(c).to_numpy() for c in ("n_p", "n_m"))
            both = zip(batch.column("s_p").to_pylist(), batch.column("s_m").to_pylist(), strict=True)
            common = np.array([np.minimum(counts_of(a), counts_of(b)).sum() for a, b in both], np.int64)
            yield batch.select(["p", "m"]).filter(pa.array(den * common >= num * (n_p + n_m - common)))

    return pairs.join(few("m"), "m").join(few("p"), "p").select("p", "m", "n_p", "n_m", "s_p", "s_m").mapInArrow(run, "p long, m long")


def linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """u, v: the pairs (p, m) whose sets are similar enough. The comparisons of a p are dealt out where there are many."""
    degree = pairs.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / DEALT).alias("_d"))
    salted = pairs.join(degree, "p").select("p", F.pmod(F.xxhash64("m"), F.col("_d")).cast("int").alias("salt"), "m")
    elements = sets.select("node", "elements")
    members = salted.join(elements.withColumnRenamed("node", "m"), "m").select("p", "salt", "m", "elements")
    pivots = salted.select("p", "salt").distinct().join(elements.withColumnRenamed("node", "p"), "p").select("p", "salt", F.lit(None).cast("long").alias("m"), "elements")

    def compare(batches):
        at, pivot = None, None
        for batch in batches:
            u, v = [], []
            for p, m, e in zip(*(batch.column(c).to_pylist() for c in ("p", "m", "elements")), strict=True):
                s = np.frombuffer(e, np.uint64)
                if m is None:
                    at, pivot = p, s
                    continue
                assert p == at
                common = len(np.intersect1d(pivot, s, assume_unique=True))
                if den * common >= num * (len(pivot) + len(s) - common):
                    u.append(p)
                    v.append(m)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    width = shuffle_width(pairs.sparkSession)
    rows = members.unionByName(pivots).repartition(width, "p", "salt").sortWithinPartitions("p", "salt", F.asc_nulls_first("m"))
    return rows.select("p", "m", "elements").mapInArrow(compare, "u long, v long")


def other_pairs(members: DataFrame, stars: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """p, m: pairs of a group in different components, but those with its pivot, unless sizes or summaries rule them out.

    A group's members are dealt into blocks by hash, and each two blocks are compared somewhere. Each node brings the least few
    of its groups: a pair is left to an earlier group that both name, so near copies, which share most groups, are told of once.
    """
    rows = members.join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rows.groupBy("gid").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), pivot_of().alias("_p"), F.count(F.lit(1)).alias("_n")).where("_a <> _b and _n > 2")
    split = split.select("gid", F.col("_p.node").alias("_pivot"), F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"))
    left = rows.join(split, "gid").where("node <> _pivot").select("gid", "node", "root", "_blocks", F.pmod(F.xxhash64("node", "gid"), F.col("_blocks")).cast("int").alias("own"))
    first = left.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("gid")), 1, FIRST).alias("first"))
    few = sets.select("node", "n", "summary").dropDuplicates(["node"]).join(first, "node")
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    left = left.select("gid", "node", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(few, "node")

    def pairs_of(gid: int, i: int, j: int, held: list[tuple]):
        held.sort(key=lambda r: r[3])
        earlier = [{g for g in r[5] if g < gid} for r in held]
        node, root, own, n = (np.array([r[c] for r in held]) for c in range(4))
        counts = np.array([counts_of(r[4]) for r in held])
        ends = np.searchsorted(n, n * den // num, "right")
        for x in range(len(n) - 1):
            ys = np.arange(x + 1, int(ends[x]))
            ys = ys[(root[ys] != root[x]) & ((own[ys] != own[x]) | (i == j))]
            if len(ys):
                common = np.minimum(counts[x], counts[ys]).sum(1)
                for y in ys[den * common >= num * (n[x] + n[ys] - common)].tolist():
                    if earlier[x].isdisjoint(earlier[y]):
                        yield min(node[x], node[y]), max(node[x], node[y])

    def cross(batches):
        at, held = None, []
        for batch in batches:
            out = []
            for gid, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("gid", "i", "j", "node", "root", "own", "n", "summary", "first")), strict=True):
                if (gid, i, j) != at and held:
                    out += pairs_of(*at, held)
                    held = []
                at = (gid, i, j)
                held.append(tuple(row))
            yield told(out)
        if held:
            yield told(list(pairs_of(*at, held)))

    def told(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], names=["p", "m"])

    width = shuffle_width(members.sparkSession)
    return left.repartition(width, "gid", "i", "j").sortWithinPartitions("gid", "i", "j").mapInArrow(cross, "p long, m long").distinct()


def classes(docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(named: doc_id, key, n_shingles, name for each row; ids: name, component_id, head_id, head_key for each set).

    The head is a row of the component: of its least id, if any row has one.
    """
    lean(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "jaccard")
    named = scratch.keep(nodes_of(docs, size), "named")
    nodes = scratch.keep(numbered(named), "nodes")
    groups = scratch.keep(signature_groups(docs, size, Windows(num, den)), "groups")
    members = scratch.keep(memberships(groups, nodes), "members")
    scratch.drop("groups")
    pairs = scratch.keep(first_pairs(members, num, den), "pairs")
    met = members.select("node").distinct()
    sets = scratch.keep(sets_of(docs, nodes.join(met, "node").select("node", "doc_id", "key"), size), "sets")
    likely = scratch.keep(possible(pairs, sets, num, den).distinct(), "likely")
    stars = components(linked(likely, sets, num, den))
    more = scratch.keep(other_pairs(members, stars, sets, num, den), "more")
    if not more.isEmpty():
        stars = components(stars.unionByName(linked(more, sets, num, den)))
    rooted = nodes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("head")
    least = rooted.groupBy("root").agg(head)
    ids = scratch.keep(rooted.select("name", "root").join(least, "root").select("name", F.col("head.doc_id").alias("component_id"), F.col("head.key").alias("head_key")), "ids")
    scratch.drop("sets", "members", "pairs", "likely", "more", "nodes")
    return named, ids


def similar_documents(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row; links hold where den * |intersection| >= num * |union|.

    A row with a null id links as others do; its component_id is its component's least id, null where no row of that has one.
    """
    named, ids = classes(docs, size, num, den)
    found = named.where("name is not null").join(ids, "name").select("doc_id", "n_shingles", "component_id")
    return found.unionByName(named.where("name is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of docs for each component: of its least id (any row where no id is known). Rows without words stay.

    Of repeated rows (id and text) one stays, but those without both id and words, which nothing tells apart, all stay.
    """
    named, ids = classes(docs, size, num, den)
    heads = ids.select(F.col("component_id").alias("doc_id"), F.col("head_key").alias("key")).distinct()
    rows = named.where("name is not null").join(heads.withColumnsRenamed({"doc_id": "_id", "key": "_key"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).select("doc_id", "key")
    rows = rows.unionByName(named.where("name is null and doc_id is not null").select("doc_id", "key")).groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("times"))
    kept = Scratch(docs.sparkSession, "kept").keep(rows, "rows")
    key, its_id, its_key = fresh(docs.columns, "key", "its_id", "its_key")
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.withColumn(key, F.xxhash64(text, F.length(text)))

    def chosen(which: DataFrame) -> DataFrame:
        which = which.select(F.col("doc_id").alias(its_id), F.col("key").alias(its_key))
        return held.join(which, held["doc_id"].eqNullSafe(F.col(its_id)) & (held[key] == F.col(its_key)), "left_semi")

    out = [chosen(kept.where("times = 1")).select(docs.columns)]
    if not (more := kept.where("times > 1")).isEmpty():
        out.append(chosen(more).dropDuplicates(["doc_id", key]).select(docs.columns))
    bare = named.where("name is null and doc_id is null")
    if not bare.isEmpty():
        wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        out.append(docs.where(F.col("doc_id").isNull() & wordless))
    return reduce(DataFrame.unionByName, out)


SIMILAR_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s WHERE len(s) > 0),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) + any_value(b.n) AS t FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (t - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
  SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM s LEFT JOIN r ON doc_id = a
"""
