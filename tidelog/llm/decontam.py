"""Benchmark decontamination by Wu-Manber search over words.

Test items become patterns: windows of consecutive words, or the whole item where it is shorter. Patterns of one length share
tables over blocks of two words: the shift table says how far the search may skip after a block, the bucket of a block whose
shift is zero selects the patterns that end with it, a check of their first block and a direct comparison confirm them.

Items are searched for in blocks of a stated number of words, so the tables of a worker have a bound whatever the benchmark's size
(about 1.1 KB a word); each block is one pass over the documents, and a worker builds its tables once. After a few passes the
documents are written, so a task never holds the tables of more. Null texts have no words, and texts are searched whole. Items
without words are never found. Repeated rows of documents give a row each; repeated items count once; null ids and other columns stay
as they are. An empty benchmark finds nothing, an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, lean

WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Words of items that are searched for at once (or one longer item), and passes before the documents are written.
BLOCK_PATTERNS, PASSES = 100_000, 4


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return WORDS.findall(text.encode().lower()) if text else []


class PatternTables:
    """Wu-Manber tables for patterns of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.skip = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, list[tuple[tuple, tuple, list]]] = {}
        self.items: dict[tuple, list] = {}

    def add(self, pattern: tuple, item) -> None:
        if (of := self.items.get(pattern)) is not None:
            of.append(item)
            return
        self.items[pattern] = of = [item]
        b, m = self.block, self.length
        for end in range(b, m + 1):
            key = pattern[end - b : end]
            self.shift[key] = min(self.shift.get(key, self.skip), m - end)
        self.buckets.setdefault(pattern[m - b :], []).append((pattern[:b], pattern, of))

    def search(self, found: list[bytes]):
        """(first word, items) of each occurrence in a list of words."""
        m, b, n, skip, shift = self.length, self.block, len(found), self.skip, self.shift
        at = m
        while at <= n:
            key = tuple(found[at - b : at])
            step = shift.get(key, skip)
            if step:
                at += step
                continue
            begin = at - m
            prefix = tuple(found[begin : begin + b])
            for first, pattern, items in self.buckets[key]:
                if first == prefix and tuple(found[begin:at]) == pattern:
                    yield begin, items
            at += 1


class Matcher:
    """All tables of a block of items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.tables: dict[int, PatternTables] = {}
        for item, text in items:
            w = words(text)
            m = min(window, len(w))
            for i in range(len(w) - m + 1 if m else 0):
                self.tables.setdefault(m, PatternTables(m)).add(tuple(w[i : i + m]), item)

    def find(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged word ranges that occurrences cover, and the items that occur."""
        spans, items = [], set()
        for m, t in self.tables.items():
            for begin, of in t.search(found):
                spans.append((begin, begin + m))
                items.update(of)
        return union(spans), items


class Block:
    """Items under a name, by which a worker knows them again."""

    def __init__(self, name: str, items: list):
        self.name, self.items = name, items

    def __hash__(self) -> int:
        return hash(self.name)

    def __eq__(self, other) -> bool:
        return self.name == other.name


@lru_cache(maxsize=1)
def matcher_of(block: Block, window: int) -> Matcher:
    """The tables of a block, built once in a worker."""
    return Matcher(block.items, window)


def item_blocks(items: DataFrame, window: int, block_patterns: int):
    """Lists of (id as string, text), of block_patterns words together at most (or one item)."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("string"), "text").where("item_id is not null and text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        n = len(words(row[1]))
        if block and size + n > block_patterns:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    yield block


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, block_patterns: int = BLOCK_PATTERNS, names: tuple[str, str, str] = ("n_words", "spans", "items")) -> DataFrame:
    """All columns of docs, and the number of words, the word ranges that occurrences cover, the items (ids as sorted strings).

    names: of these three; columns of docs that have such a name are replaced.
    """
    spark, out = docs.sparkSession, docs.drop(*names)
    lean(spark)
    kept = out.columns
    text_at = [n.lower() for n in kept].index("text")
    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*out.schema.fields, *(T.StructField(n, k) for n, k in zip(names, (T.LongType(), T.ArrayType(span), T.ArrayType(T.StringType())), strict=True))])
    kinds = (pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string()))
    for k, block in enumerate(item_blocks(items, window, block_patterns)):
        if k and k % PASSES == 0:
            out = Scratch(spark, "decontamination").keep(out, "rows")
        given = spark.sparkContext.broadcast(Block(uuid4().hex, block))

        def run(batches, given=given, first=k == 0):
            matcher = matcher_of(given.value, window)
            for batch in batches:
                n, spans, ids = [], [], []
                for i, text in enumerate(batch.column(text_at)):
                    w = words(text.as_py())
                    s, found = matcher.find(w)
                    if not first:
                        s = union([(x["begin"], x["end"]) for x in batch.column(names[1])[i].as_py()] + s)
                        found = found | set(batch.column(names[2])[i].as_py())
                    n.append(len(w))
                    spans.append([{"begin": a, "end": b} for a, b in s])
                    ids.append(sorted(found))
                arrays = [batch.column(c) for c in range(len(kept))] + [pa.array(v, t) for v, t in zip((n, spans, ids), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *names])

        out = out.mapInArrow(run, schema)
    return out


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def contamination_report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The counts and digests of contamination() for each row."""
    found = contamination(docs.select("doc_id", "text"), items, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


CONTAMINATION_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i : i + least(10, len(w)) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
g AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS g FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m),
o AS (SELECT doc_id, item_id, i, m FROM g JOIN p USING (m, g)),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM o) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
