"""Matches of patterns with their places in code points, in Spark expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Running sums go in blocks, so that appending to arrays costs no square of their length.
BLOCK = 256
#: Code points of a block of a text that pieces are taken from.
PIECE_BLOCK = 1024
SUMS = "struct<total:bigint,before:array<bigint>>"


def sums_before(lengths: Column) -> Column:
    """For each of an array of longs, the sum of those before it."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))

    def add(done: Column, n: Column) -> Column:
        return F.struct((done["total"] + n).alias("total"), F.array_append(done["before"], done["total"]).alias("before")).cast(SUMS)

    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<bigint>").alias("before")).cast(SUMS)
    inner = F.transform(blocks, lambda b: F.aggregate(b, start, add))
    outer = lambda x: F.aggregate(F.transform(x, lambda s: s["total"]), start, add)["before"]
    return F.flatten(F.transform(F.array(inner), lambda x: F.flatten(F.zip_with(x, outer(x), lambda s, n: F.transform(s["before"], lambda v: v + n)))))


def matches(text: Column, pattern: str, keep: Callable[[Column], Column], extra: dict[str, Callable[[Column, Column, Column], Column]] | None = None, group: int = 0) -> Column:
    """Array of struct(start, end, line, extras...) of the non-overlapping matches, leftmost first, for which keep(group's text) holds.

    pattern never matches an empty string. line: the line feeds before the match. extra: of (text before since the last match,
    match, group's text).
    """
    extra = extra or {}
    feeds = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    got = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda p, m: F.struct(p.alias("p"), m.alias("m")),
    )
    got = F.filter(got, lambda x: x["m"].isNotNull())
    if group:
        got = F.zip_with(got, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x, g: F.struct(x["p"].alias("p"), x["m"].alias("m"), g.alias("g")))
    else:
        got = F.transform(got, lambda x: F.struct(x["p"].alias("p"), x["m"].alias("m"), x["m"].alias("g")))

    def placed(x: Column) -> Column:
        before = sums_before(F.transform(x, lambda y: (F.length(y["p"]) + F.length(y["m"])).cast("bigint")))
        lines = sums_before(F.transform(x, lambda y: (feeds(y["p"]) + feeds(y["m"])).cast("bigint")))

        def row(y: Column, n: Column) -> Column:
            start = n["n"] + F.length(y["p"])
            more = [f(y["p"], y["m"], y["g"]).alias(k) for k, f in extra.items()]
            return F.struct(start.alias("start"), (start + F.length(y["m"])).alias("end"), (n["l"] + feeds(y["p"])).alias("line"), *more, y["g"].alias("_g"))

        kept = F.filter(F.zip_with(x, F.zip_with(before, lines, lambda n, at: F.struct(n.alias("n"), at.alias("l"))), row), lambda y: keep(y["_g"]))
        return F.transform(kept, lambda y: F.struct(*[y[c].alias(c) for c in ("start", "end", "line", *extra)]))

    # one-element transforms bind their argument, so that it is computed once
    some = F.flatten(F.transform(F.array(got), placed))
    return F.when(text.rlike(pattern), some)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array of struct(start, rank, kind, end) sorted by them."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint,line:bigint>"


def of_kind(spans: Column, kind: str, rank: int) -> Column:
    """struct(start, rank, kind, end, line) of an array of matches, null as empty."""
    made = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["line"].alias("line")))
    return F.coalesce(made, F.array().cast(f"array<{SPAN}>"))


def attach(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """rows left-joined with few, which has unique keys. By shuffle at every size; much repeated keys of rows are split as it runs."""
    return rows.join(few.hint("merge"), key, "left")


def blocks_of(text: Column) -> Column:
    """Adjacent blocks of a text, from which pieces are taken without a walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE_BLOCK}}}"), F.lit(0))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from start to end, at a cost that goes with their number."""
    first = F.floor(start / PIECE_BLOCK).cast("int")
    last = F.floor((end - 1) / PIECE_BLOCK).cast("int")
    some = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(some, (start - first * PIECE_BLOCK + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def without(text: Column, cuts: Column, mark: Callable[[Column], Column]) -> Column:
    """text with each of an array of disjoint, sorted struct(start, end, ...) replaced by its mark."""

    def joined(blocks: Column) -> Column:
        upto = lambda i: F.when(i > 0, F.try_element_at(cuts, i)["end"]).otherwise(F.lit(0).cast("bigint"))
        parts = F.transform(cuts, lambda c, i: F.concat(piece(blocks, upto(i), c["start"]), mark(c)))
        return F.concat(F.array_join(parts, ""), piece(blocks, F.try_element_at(cuts, F.lit(-1))["end"], F.length(text).cast("bigint")))

    # a one-element transform binds its argument, so that it is computed once
    return F.transform(F.array(blocks_of(text)), joined)[0]
