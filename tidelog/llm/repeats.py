"""Substring dedup by hashing lines and passages of all texts.

A text is cut into sentences that end after sentence marks or a line feed, with the white space that follows; they cover the text.
Hashed units are its lines, whole, and in addition, as shared passages also sit inside lines, its passages: from each sentence on,
the fewest that have LEAST_WORDS words together. Units of fewer words always stay: formulas repeat without being copies.

Units are normalised (lower case, single spaces; white space alone is none) and grouped by a digest of 128 bits over all texts.
Of each digest the occurrence that ranks first (least doc_id, then place) counts as the original; what the others cover is
removed, and its places in the original text kept. Each removed unit ranks behind an equal one, so each removed sentence has an
equal one that stays.

Cutting and hashing run over arrays of bytes in Arrow batches, the rest in Spark expressions.

A null text counts as empty; a null id ranks before all others. Texts have any length. Rows with equal id and text are one
document, so a repeated row loses nothing to its twin. Other columns, also those named as the operator's own, are not read. An
empty table gives no rows. Where a letter's lower case takes another number of bytes, that letter stays as it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, chunks, lean, splitmix, word_hashes
from .spans import without

LEAST_WORDS = 15
SPACES = np.isin(np.arange(256), [0x20, 0x09, 0x0D, 0x0A])
MARKS = np.isin(np.arange(256), list(b".!?"))
FEED = 0x0A
STEP = np.uint64(0x9E3779B97F4A7C15)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, twin (a hash of the text), text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text, F.length(text)).alias("twin"), "text")


def sentence_starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a sentence starts at each byte; first: whether a text does.

    A sentence is a run without marks and line feeds, the marks and then the white space behind it; one that begins with marks or
    line feeds is all of these that follow and then the white space.
    """
    follows = lambda x: np.r_[False, x[:-1]] & ~first
    feed, mark, space = data == FEED, MARKS[data], SPACES[data]
    behind_mark, behind_space = follows(mark), follows(space)
    # white space ends a sentence if it has a line feed or begins behind a mark
    begins = space & ~behind_space
    run = np.cumsum(begins) - 1
    ends = behind_mark[begins]
    ends[run[feed]] = True
    ended = follows(space & np.r_[ends, False][run])
    start = first | (~space & ((behind_mark & ~mark) | ended))
    # marks behind a line feed go on with a sentence of marks and line feeds
    stops = mark | feed
    begins = stops & ~follows(stops)
    run = np.cumsum(begins) - 1
    inner = np.flatnonzero(start & mark & follows(feed))
    runs = run[inner]
    stays = ~start[begins][runs] & np.r_[True, runs[1:] != runs[:-1]][: len(runs)]
    start[inner[~stays]] = False
    return start


def lowered(text: str) -> bytes:
    """The lower case of a text's letters, byte for byte beside the text."""
    data, low = text.encode(), text.lower().encode()
    if len(data) == len(low) and np.array_equal(SPACES[np.frombuffer(data, np.uint8)], SPACES[np.frombuffer(low, np.uint8)]):
        return low
    return "".join(x if len((x := c.lower()).encode()) == len(c.encode()) else c for c in text).encode()


def sequence_hashes(values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of values[first : first + n] for each of first and n (1 or more)."""
    if not len(first):
        return np.zeros(0, np.uint64)
    ends = np.cumsum(n)
    place = np.arange(ends[-1]) - np.repeat(ends - n, n)
    with np.errstate(over="ignore"):
        salts = splitmix(np.arange(1, int(n.max()) + 1, dtype=np.uint64) * STEP)
        each = splitmix(values[np.repeat(first, n) + place] ^ salts[place])
        return splitmix(np.add.reduceat(each, ends - n) + n.astype(np.uint64) * STEP)


def cut(texts: list[str], least_words: int) -> tuple[np.ndarray, ...]:
    """(index of the text, start, end, a, b) of the lines and passages of texts."""
    if not (held := [(i, t) for i, t in enumerate(texts) if t]):
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    data = [t.encode() for _, t in held]
    whole = np.frombuffer(b"".join(data), np.uint8)
    text_at = np.cumsum([0] + [len(d) for d in data])
    first = np.zeros(len(whole), bool)
    first[text_at[:-1]] = True
    start = np.flatnonzero(sentence_starts(whole, first))
    points = np.r_[0, np.cumsum((whole & 0xC0) != 0x80)]
    begin, *hashes = word_hashes(b"".join(lowered(t) for _, t in held), SPACES, start)
    # sentences with words
    of = np.searchsorted(start, begin, "right") - 1
    heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    words = np.diff(np.r_[heads, len(of)])
    sums = [sequence_hashes(h, heads, words) for h in hashes]
    own = of[heads]
    s, e = start[own], np.r_[start[1:], len(whole)][own]
    text = np.searchsorted(text_at, s, "right") - 1
    feeds = np.r_[0, np.cumsum(whole == FEED)]
    last = np.r_[text[1:] != text[:-1], True][: len(s)]
    line_ends = np.flatnonzero((feeds[e] > feeds[s]) | last)
    upto = np.cumsum(words)
    before = upto - words
    # lines, and from each sentence on the fewest that have enough words
    line_begins = np.r_[0, line_ends[:-1] + 1][: len(line_ends)]
    enough = upto[line_ends] - before[line_begins] >= least_words
    reach = np.searchsorted(upto, before + least_words, "left")
    of_text = np.flatnonzero(reach < len(s))
    of_text = of_text[text[reach[of_text]] == text[of_text]]
    a, b = np.r_[line_begins[enough], of_text], np.r_[line_ends[enough], reach[of_text]]
    base = points[text_at[text[a]]]
    indexes = np.array([i for i, _ in held], np.int64)
    return indexes[text[a]], points[s[a]] - base, points[e[b]] - base, *(sequence_hashes(x, a, b - a + 1) for x in sums)


def units_of(docs: DataFrame, least_words: int) -> DataFrame:
    """doc_id, twin, start, end, a, b (digest) of each line and each passage; some twice."""
    lean(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for x, y in chunks(texts):
                at, *columns = cut(texts[x:y], least_words)
                at = pa.array(at + x)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c.astype(np.int64)) for c in columns)], names=["doc_id", "twin", "start", "end", "a", "b"])

    return keyed(docs).mapInArrow(run, f"doc_id {kind}, twin long, start long, end long, a long, b long")


def stretches(spans: DataFrame) -> DataFrame:
    """doc_id, twin, spans: sorted array of the disjoint stretches struct(start, end) that start, end cover together."""
    order = Window.partitionBy("doc_id", "twin").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("new", (F.col("start") > F.coalesce(before, F.lit(-1))).cast("int"))
    rows = rows.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    each = rows.groupBy("doc_id", "twin", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return each.groupBy("doc_id", "twin").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def removed_spans(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, twin, spans: the stretches to remove of each document that has any.

    The units are written once. Of digests only those that occur again are kept to join with; Spark splits much repeated ones.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    units = scratch.keep(units_of(docs, least_words), "units")
    rank = F.struct("doc_id", "start", "twin")
    first = units.groupBy("a", "b").agg(F.min(rank).alias("first"), F.max(rank).alias("_last")).where("first <> _last").drop("_last")
    first = scratch.keep(first, "first")
    later = units.join(first.hint("merge"), ["a", "b"]).where(rank != F.col("first")).select("doc_id", "twin", "start", "end").distinct()
    later = scratch.keep(later, "later")
    scratch.drop("units", "first")
    return scratch.keep(stretches(later), "spans")


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_removed (stretches), removed (start:end in the original text, comma-joined), text (what stays) of each row."""
    gone = removed_spans(docs, least_words).withColumnsRenamed({"doc_id": "_id", "twin": "_twin"})
    rows = keyed(docs)
    held = rows.join(gone.hint("merge"), rows["doc_id"].eqNullSafe(gone["_id"]) & (rows["twin"] == gone["_twin"]), "left")
    return held.select(
        "doc_id",
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit("")).alias("removed"),
        F.when(F.col("spans").isNull(), F.col("text")).otherwise(without(F.col("text"), F.col("spans"), lambda s: F.lit(""))).alias("text"),
    )


REPEATS_SQL = """
WITH c AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\\n.!?]+[.!?]*[ \\t\\r\\n]*|[\\n.!?]+[ \\t\\r\\n]*') AS u FROM documents),
x AS (SELECT doc_id, unnest(u) AS u, unnest(range(1, len(u) + 1)) AS i FROM c),
y AS (SELECT doc_id, i, u, coalesce(sum(length(u)) OVER w, 0)::BIGINT AS start, coalesce(sum(CASE WHEN contains(u, chr(10)) THEN 1 ELSE 0 END) OVER w, 0) AS line,
  trim(regexp_replace(lower(u), '[ \\t\\r\\n]+', ' ', 'g')) AS p FROM x
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT doc_id, line, start, start + length(u) AS stop, p, len(string_split(p, ' ')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM y WHERE p <> ''),
s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM z),
l AS (SELECT doc_id, min(start) AS start, max(stop) AS stop, string_agg(p, chr(10) ORDER BY k) AS g FROM s GROUP BY doc_id, line HAVING sum(n) >= 15),
b AS (SELECT f.doc_id, f.k AS first, e.k AS last FROM s f JOIN s e ON f.doc_id = e.doc_id AND e.k >= f.k AND e.k < f.k + 15 AND e.upto - f.upto + f.n >= 15 AND e.upto - f.upto + f.n - e.n < 15),
q AS (SELECT b.doc_id, first, min(start) AS start, max(stop) AS stop, string_agg(p, chr(10) ORDER BY k) AS g FROM b JOIN s ON s.doc_id = b.doc_id AND k BETWEEN first AND last GROUP BY b.doc_id, first),
o AS (SELECT doc_id, start, stop, g FROM l UNION SELECT doc_id, start, stop, g FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, start) AS r FROM o),
v AS (SELECT DISTINCT doc_id, start, stop FROM r WHERE r > 1),
m AS (SELECT *, CASE WHEN start > coalesce(max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS fresh FROM v),
t AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS part FROM m),
d AS (SELECT doc_id, min(start) AS start, max(stop) AS stop FROM t GROUP BY doc_id, part),
a AS (SELECT doc_id, count(*) AS n, string_agg(start || ':' || stop, ',' ORDER BY start) AS removed FROM d GROUP BY doc_id),
h AS (SELECT y.doc_id, string_agg(u, '' ORDER BY y.start) AS text FROM y WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = y.doc_id AND y.start >= d.start AND y.start + length(u) <= d.stop) GROUP BY y.doc_id)
SELECT c.doc_id, coalesce(n, 0) AS n_removed, coalesce(removed, '') AS removed, CASE WHEN n IS NULL THEN c.text ELSE coalesce(h.text, '') END AS text
FROM c LEFT JOIN a USING (doc_id) LEFT JOIN h USING (doc_id)
"""
