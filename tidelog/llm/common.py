"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from hashlib import blake2b
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters handled together by the vectorised text code: bounds its temporaries to some tens of MB.
CHUNK_CHARS = 1 << 19
#: Rows of text that go to a Python worker at once.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of its own where a local session names none (tests). A cluster must name one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "/tmp/tidelog-checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def releasing(spark: SparkSession):
    """Within it, Spark deletes the shuffle files of a write when that write has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """Tables of one run, written as Parquet in a folder of its own in the shared folder.

    A written table cuts lineage: a lost executor costs the tasks of one step. Nothing of a step stays on the executors' disks.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read again."""
        with releasing(self.spark):
            df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads; all of the run without names."""
        for name in names or ("",):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def lean(spark: SparkSession) -> None:
    """Lets few rows at once go to Python workers, as texts may be long; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def fresh(taken: list[str], *names: str) -> list[str]:
    """names, each with as many underscores in front as it takes to differ from those taken."""
    held, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of texts whose lengths add up to limit at most; a longer text is a range of its own."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        if i > begin and total + len(t) > limit:
            yield begin, i
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def binary_array(values: list[bytes]) -> pa.Array:
    """values in buffers of their own size: what an Arrow builder outgrows stays with the worker, in Arrow's pool."""
    ends = np.cumsum([0, *map(len, values)])
    if ends[-1] > np.iinfo(np.int32).max:
        return pa.array(values, pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(b"".join(values))])


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (Steele et al.), elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@cache
def symbol_codes(n: int) -> np.ndarray:
    """A random 64-bit value for each of n symbols."""
    with np.errstate(over="ignore"):
        return splitmix((np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i up to n."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(CHUNK_CHARS + 1, n + 1)
        base = 0x5851F42D4C957F2D
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _POWERS.update(up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _POWERS["up"], _POWERS["down"]


class Rolling:
    """Hashes of any slices of a symbol array, by a polynomial over random symbol codes modulo 2**64."""

    def __init__(self, symbols: np.ndarray, codes: np.ndarray):
        up, self.down = powers(len(symbols))
        with np.errstate(over="ignore"):
            self.sums = np.empty(len(symbols) + 1, np.uint64)
            self.sums[0] = 0
            np.cumsum(codes[symbols] * up[: len(symbols)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return splitmix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


#: Bytes of a word that the tables cover; longer words get a cryptographic digest.
TABLED = 64


@cache
def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Two independent tables of a random 64-bit value for each place in a word and byte there."""
    codes = symbol_codes(2 * TABLED * 256)
    return codes[: TABLED * 256], codes[TABLED * 256 :]


def word_hashes(data: bytes, separators: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, hash, second hash) of the words of data; separators: which byte values part words; cuts: where, sorted, words also begin.

    Tabulation hashing: the sum over a word's bytes of random values by place and byte, so no structure of a word makes two
    words meet. Data is handled in slabs that end after a separator, so memory is bounded but for single longer words.
    """
    every, parts, at = np.frombuffer(data, np.uint8), [], 0
    cuts = np.zeros(0, np.int64) if cuts is None else cuts
    while at < len(every) or not parts:
        end, cut = min(len(every), at + CHUNK_CHARS), ()
        while end < len(every) and not len(cut := np.flatnonzero(separators[every[at:end]])):
            end = min(len(every), 2 * end - at)
        if len(cut):
            end = at + int(cut[-1]) + 1
        mine = cuts[np.searchsorted(cuts, at) : np.searchsorted(cuts, end)] - at
        parts.append(hash_slab(data, every[at:end], at, separators, mine))
        at = end
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def hash_slab(data: bytes, slab: np.ndarray, at: int, separators: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = ~separators[slab]
    begins = inside & np.r_[True, ~inside[:-1]][: len(slab)]
    begins[cuts] = inside[cuts]
    begin = np.flatnonzero(begins)
    end = np.flatnonzero(inside & np.r_[begins[1:] | ~inside[1:], True][: len(slab)]) + 1
    last = np.zeros(len(slab), np.int64)
    last[begin] = begin
    place = np.arange(len(slab)) - np.maximum.accumulate(last)
    index = (np.minimum(place, TABLED - 1) << 8) + slab
    out = []
    with np.errstate(over="ignore"):
        for t in byte_tables():
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(t[index], dtype=np.uint64)])
            out.append(splitmix(sums[end] - sums[begin]))
    for i in np.flatnonzero(end - begin > TABLED).tolist():
        digest = np.frombuffer(blake2b(data[at + int(begin[i]) : at + int(end[i])], digest_size=16).digest(), np.uint64)
        out[0][i], out[1][i] = digest
    return begin + at, *out


def text_column(df: DataFrame, column: str = "text"):
    """The column as string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
