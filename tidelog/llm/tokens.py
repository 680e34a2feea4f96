"""Token counts and ids of a byte-level BPE tokenizer, whole texts, in bulk.

Whole-token shortcut: offline, each vocabulary string is encoded alone; those that give one token are proved, and a
pre-token equal to one of them counts as one token without any merging. All other pre-tokens are merged by the library,
once for each distinct string while it stays in a bounded table. The split into pre-tokens runs over arrays of code points.
Texts with characters outside the tables, or with a special token's string, go to the library whole, so results equal the
library's in every case.

Nulls count as empty texts. Empty texts have no tokens. Texts are counted whole, however long. Null ids and repeated rows give a
row each. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, chunks, lean, symbol_codes

#: Code points below this are split by table.
PLANE = 0x3000
#: Slots in each of the two halves of the table of merged pre-tokens; ids that it holds at most.
SLOT_BITS, POOL = 21, 1 << 23
#: Longer pre-tokens are merged each time and never kept: their hashes would be weaker.
LONGEST = 64
LETTER, DIGIT, SPACE, OTHER, UNKNOWN = range(5)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def character_classes() -> np.ndarray:
    """Class of each code point below PLANE; UNKNOWN where Unicode versions could differ."""
    old, kinds = unicodedata.ucd_3_2_0, np.full(PLANE + 1, UNKNOWN, np.uint8)
    for i in range(PLANE):
        kind = unicodedata.category(chr(i))
        if i < 0x250 or kind == old.category(chr(i)) != "Cn":
            kinds[i] = LETTER if kind[0] == "L" else DIGIT if kind[0] == "N" else SPACE if kind[0] == "Z" or chr(i) in "\t\n\v\f\r\x85" else OTHER
    kinds[[0x180E, 0x200B]] = UNKNOWN
    return kinds


class BulkTokenizer:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kinds, self.codes = character_classes(), symbol_codes(PLANE)
        self.keys = np.zeros(2 << SLOT_BITS, np.uint64)
        self.places = np.zeros(2 << SLOT_BITS, np.int32)
        self.counts = np.zeros(2 << SLOT_BITS, np.int32)
        self.pool, self.used = np.zeros(POOL, np.uint32), 0
        self.prove()

    def encode(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(strings, add_special_tokens=False)]

    def prove(self) -> None:
        """Keeps the vocabulary strings that encode alone as one token."""
        strings = [self.library.decode([i], skip_special_tokens=False) for i in range(self.library.get_vocab_size())]
        strings = [s for s in dict.fromkeys(strings) if s and s not in self.special and "�" not in s and max(map(ord, s)) < PLANE and len(s) <= LONGEST]
        proved = [(s, ids[0]) for s, ids in zip(strings, self.encode(strings), strict=True) if len(ids) == 1]
        text = "".join(s for s, _ in proved)
        ends = np.cumsum([len(s) for s, _ in proved])
        hashes = Rolling(code_points(text), self.codes).of(np.r_[0, ends[:-1]], ends)
        self.pool[: len(proved)] = [i for _, i in proved]
        self.keep(hashes, np.arange(len(proved), dtype=np.int32), np.ones(len(proved), np.int32))
        self.used = self.proved = len(proved)
        self.pinned = (hashes, np.arange(len(proved), dtype=np.int32))

    @staticmethod
    def slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A slot in the first half and one in the second."""
        mask = np.uint64((1 << SLOT_BITS) - 1)
        return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64), (hashes & mask).astype(np.int64) + (1 << SLOT_BITS)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot that holds each hash, or any other."""
        slot, other = self.slots(hashes)
        miss = np.flatnonzero(self.keys[slot] != hashes)
        slot[miss] = other[miss]
        return slot

    def keep(self, hashes: np.ndarray, places: np.ndarray, counts: np.ndarray) -> None:
        slot, other = self.slots(hashes)
        full = self.keys[slot] != 0
        slot[full] = other[full]
        self.keys[slot], self.places[slot], self.counts[slot] = hashes, places, counts

    def forget(self) -> None:
        self.keys[:] = 0
        self.used = self.proved
        self.keep(*self.pinned, np.ones(self.proved, np.int32))

    def starts(self, points: np.ndarray, kinds: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether a pre-token starts at each character; first and last: of each text."""
        n = len(points)
        run = np.empty(n + 1, bool)
        run[0] = run[n] = True
        np.not_equal(kinds[1:], kinds[:-1], out=run[1:n])
        run[first] = True
        out = run[:n].copy()
        ends = np.zeros(n, bool)
        ends[last] = True
        # the last character of a run of spaces that a text's end doesn't follow stands alone, or opens what follows
        tail = np.flatnonzero((kinds == SPACE) & run[1:] & ~ends)
        out[tail] = True
        out[tail[points[tail] == 0x20] + 1] = False
        # 's 't 'm 'd 're 've 'll where a pre-token starts with the apostrophe
        p = np.flatnonzero((points == 0x27) & out & run[1:] & ~ends)
        p = p[kinds[p + 1] == LETTER]
        if len(p):
            a = points[p + 1]
            b = np.where(ends[p + 1], 0, points[np.minimum(p + 2, n - 1)])
            one = np.isin(a, [ord(x) for x in "stmd"])
            two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            for hit, size in ((p[one], 1), (p[two & ~one], 2)):
                out[hit + 1] = False
                after = hit[~ends[hit + size]] + size + 1
                out[after] = True
        return out

    def split(self, texts: list[str]):
        """(joined text, token counts of pre-tokens, places of their ids, pre-tokens of each text) for texts of known characters."""
        text = "".join(texts)
        points = code_points(text)
        last = np.cumsum([len(t) for t in texts]) - 1
        first = np.r_[0, last[:-1] + 1]
        begin = np.flatnonzero(self.starts(points, self.kinds[points], first, last))
        end = np.r_[begin[1:], len(points)]
        hashes = Rolling(points, self.codes).of(begin, end)
        slot = self.find(hashes)
        counts, places = self.counts[slot], self.places[slot]
        missing = np.flatnonzero((self.keys[slot] != hashes) | (end - begin > LONGEST))
        if len(missing):
            distinct, where, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            where = missing[where]
            ids = self.encode([text[a:b] for a, b in zip(begin[where].tolist(), end[where].tolist(), strict=True)])
            sizes = np.array([len(x) for x in ids], np.int32)
            flat = np.array([i for x in ids for i in x], np.uint32)
            if self.used + len(flat) > len(self.pool):
                hit = np.setdiff1d(np.arange(len(begin)), missing, assume_unique=True)
                kept = ids_at(self.pool, places[hit], counts[hit])
                self.forget()
                # what this chunk still needs moves behind what is proved
                need = len(kept) + len(flat) + self.used
                if need > len(self.pool):
                    self.pool = np.concatenate([self.pool[: self.used], np.zeros(need - self.used, np.uint32)])
                self.pool[self.used : self.used + len(kept)] = kept
                places[hit] = self.used + np.cumsum(counts[hit]) - counts[hit]
                self.used += len(kept)
            self.pool[self.used : self.used + len(flat)] = flat
            at = (self.used + np.cumsum(sizes) - sizes).astype(np.int32)
            self.used += len(flat)
            counts[missing], places[missing] = sizes[back], at[back]
            short = end[where] - begin[where] <= LONGEST
            self.keep(distinct[short], at[short], sizes[short])
        return counts, places, np.searchsorted(begin, np.r_[first, len(points)])

    def known(self, text: str) -> bool:
        if any(s in text for s in self.special):
            return False
        return text.isascii() or not (self.kinds[np.minimum(code_points(text), PLANE)] == UNKNOWN).any()

    def each(self, texts: list[str], with_ids: bool) -> Iterator[tuple[int, np.ndarray | int]]:
        """(index, ids or count) of each text, in any order."""
        for a, b in chunks(texts):
            known = [i for i in range(a, b) if texts[i] and self.known(texts[i])]
            rest = sorted({*range(a, b)}.difference(known))
            for i, ids in zip(rest, self.encode([texts[i] for i in rest]), strict=True):
                yield i, np.array(ids, np.uint32) if with_ids else len(ids)
            if not known:
                continue
            counts, places, bounds = self.split([texts[i] for i in known])
            totals = np.r_[0, np.cumsum(counts, dtype=np.int64)][bounds]
            flat = ids_at(self.pool, places, counts) if with_ids else None
            for k, i in enumerate(known):
                yield i, flat[totals[k] : totals[k + 1]] if with_ids else int(totals[k + 1] - totals[k])

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for i, n in self.each(texts, False):
            out[i] = n
        return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def ids_at(pool: np.ndarray, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts, dtype=np.int64)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(places - (ends - counts), counts)]


_LOADED: dict[str, BulkTokenizer] = {}


def loaded(path: str) -> BulkTokenizer:
    """One for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = BulkTokenizer(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for each row of docs. Rows map one to one; no shuffle."""
    lean(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches):
        t = loaded(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = t.count(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n), pa.array(n > limit)], names=[id_column, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("text")).mapInArrow(run, f"`{id_column}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
