"""Personal data with bootstrapped contextual extraction, in Spark expressions only.

Base spans are e-mail and IP addresses, payment cards and phone numbers of full form. They are the seeds: the two words before
a seed (since the identifier before it) are a lexical pattern of its kind. Identifier-like strings that no base span covers are
candidates; those behind the same two words are instances of the pattern. Patterns and values form a graph that is scored in
turns. A pattern's score for a kind is the sum of the scores of its known values of that kind, against that sum, the known values
of other kinds, and a small weight for each value of which nothing is known. A value that patterns of high score and support
have is known from then on, with the score of these together (noisy or); known values induce and support further patterns. Turns
end when none finds a value. The patterns that stand then add their candidates as spans.

Null texts count as empty. Texts are read whole; words, the space between them and identifiers have any length. Copies of a text
give its patterns no more support than one. Repeated rows give a row each. Without seeds nothing is added. Other columns, also
those named as the operator's own, change nothing. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh
from .spans import attach, matches, of_kind, spans_text, without

#: Contract patterns. Possessive and bounded forms that match the same strings in linear time, without deep recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Identifier-like strings: letters or none, then a digit, then three or more characters of identifiers, all that follow.
CANDIDATE = r"(?<![A-Za-z0-9@._+-])[A-Za-z]*+[-(]?[0-9][A-Za-z0-9@._()/-]{3,}+"
#: Distinct known values that a pattern needs; the score that it needs; the weight of a value of which nothing is known.
SUPPORT, CONFIDENCE, UNKNOWN = 3, 0.8, 0.02
#: Parts into which the occurrences of a context are dealt.
SALTS = 16
KINDS = ("email", "ip", "card", "phone")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether digits pass the Luhn check."""
    each = F.transform(F.filter(F.split(F.reverse(number), ""), lambda d: d != ""), lambda d, i: (d.cast("int") * (i % 2 + 1)))
    return F.aggregate(each, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def keeps(kind: str):
    if kind == "ip":
        return lambda m: F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.try_to_number(F.substring(p, -3, 3), F.lit("999")), F.lit(0)) <= 255))
    if kind == "card":
        return lambda m: F.length(digits(m)).between(12, 19) & luhn(digits(m))
    if kind == "phone":
        return lambda m: F.length(digits(m)).between(9, 15)
    return lambda m: F.lit(True)


def context(before: Column) -> Column:
    """The last two words before a place and what stands between and behind them, lower-cased, white space as one space; null without."""
    words = F.regexp_extract(before, r"(?<!\p{L})\p{L}++[^\p{L}\p{N}]++\p{L}++[^\p{L}\p{N}]*+\z", 0)
    return F.when(words != "", F.trim(F.regexp_replace(F.lower(words), r"\s+", " ")))


def value_of(match: Column) -> Column:
    """Names an identifier, however it is punctuated."""
    return F.xxhash64(F.regexp_replace(F.lower(match), "[^a-z0-9.@]", ""))


def base_matches(text: Column) -> dict[str, Column]:
    extra = {"ctx": lambda p, m, g: context(p), "value": lambda p, m, g: value_of(m)}
    return {k: matches(text, p, keeps(k), extra) for k, p in zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True)}


def scanned(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, key, _<kind> for each kind and candidates (arrays of struct(start, end, line, ctx, value))."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:bigint,end:bigint,line:bigint,ctx:string,value:bigint>>")
    cols = {f"_{k}": F.coalesce(c, none) for k, c in base_matches(text).items()}
    extra = {"ctx": lambda p, m, g: context(p), "value": lambda p, m, g: value_of(m)}
    many = F.coalesce(matches(text, CANDIDATE, lambda m: F.length(digits(m)) >= 4, extra), none)
    rows = docs.select("doc_id", F.md5(text.cast("binary")).alias("key"), *[c.alias(k) for k, c in cols.items()], many.alias("candidates"))
    return scratch.keep(rows, "scanned")


def occurrences(rows: DataFrame) -> DataFrame:
    """A row for each seed and each candidate that no base span covers: key, kind (null for candidates), ctx, value, start, end, line."""
    shape = lambda c, k: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["line"].alias("line"), F.lit(k).cast("string").alias("kind"), s["ctx"].alias("ctx"), s["value"].alias("value")))
    alike = rows.where((F.size("candidates") > 0) | F.greatest(*[F.size(f"_{k}") for k in KINDS]).__gt__(0)).dropDuplicates(["key"])
    each = alike.select("key", F.explode(F.concat(*[shape(F.col(f"_{k}"), k) for k in KINDS], shape(F.col("candidates"), None))).alias("s")).select("key", "s.*")
    seed = F.col("kind").isNotNull()
    up = Window.partitionBy("key").orderBy("start", "end", F.col("kind").desc_nulls_last())
    down = Window.partitionBy("key").orderBy(F.desc("start"), F.desc("end"), F.col("kind").asc_nulls_first())
    to_here = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("_before", F.max(F.when(seed, F.col("end"))).over(to_here(up))).withColumn("_after", F.min(F.when(seed, F.col("start"))).over(to_here(down)))
    clear = (F.coalesce(F.col("_before"), F.lit(-1)) <= F.col("start")) & (F.coalesce(F.col("_after"), F.col("end")) >= F.col("end"))
    return each.where(seed | clear).drop("_before", "_after")


def confident_patterns(seen: DataFrame, scratch: Scratch) -> DataFrame:
    """ctx, kind, score of the patterns to use."""
    held = seen.where("ctx is not null").groupBy("ctx", "value").agg(F.count(F.lit(1)).alias("_n")).select("ctx", "value")
    total = scratch.keep(held.groupBy("ctx").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= SUPPORT), "total")
    edges = scratch.keep(held.join(total.select("ctx"), "ctx", "left_semi"), "edges")
    known = scratch.keep(seen.where("kind is not null").select("value", "kind", F.lit(1.0).alias("score")).distinct(), "known0")
    turn = 0
    while True:
        turn += 1
        met = edges.join(known, "value")
        kinds = met.groupBy("ctx", "kind").agg(F.sum("score").alias("for"), F.count(F.lit(1)).alias("support"))
        every = met.groupBy("ctx", "value").agg(F.sum("score").alias("score")).groupBy("ctx").agg(F.sum("score").alias("all"), F.count(F.lit(1)).alias("met"))
        score = F.col("for") / (F.col("all") + UNKNOWN * (F.col("total") - F.col("met")) + 0.5)
        patterns = kinds.where(F.col("support") >= SUPPORT).join(every, "ctx").join(total, "ctx").select("ctx", "kind", score.alias("score")).where(F.col("score") >= CONFIDENCE)
        patterns = scratch.keep(patterns, f"patterns{turn}")
        graded = edges.join(patterns, "ctx").join(known.select("value").distinct(), "value", "left_anti")
        graded = graded.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("score"))
        found = graded.groupBy("value").agg(F.max_by(F.struct("kind", "score"), F.struct("score", "kind")).alias("best")).select("value", "best.kind", "best.score")
        found = scratch.keep(found, f"found{turn}")
        if found.isEmpty():
            return patterns
        known = scratch.keep(known.unionByName(found), f"known{turn}")
        scratch.drop(f"known{turn - 1}", f"found{turn}", f"patterns{turn}")


def discovered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """key, added: the candidates that confident patterns find."""
    seen = scratch.keep(occurrences(rows), "seen")
    patterns = confident_patterns(seen, scratch)
    ranks = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    dealt = seen.where("kind is null").drop("kind").withColumn("_salt", F.pmod(F.xxhash64("key", "start"), F.lit(SALTS)))
    hits = dealt.join(patterns.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["ctx", "_salt"])
    best = hits.groupBy("key", "start", "end", "line").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    span = F.struct(F.col("start"), ranks[F.col("kind")].alias("rank"), F.col("kind"), F.col("end"), F.col("line"))
    return scratch.keep(best.groupBy("key").agg(F.sort_array(F.collect_list(span)).alias("added")), "added")


def pii_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with base spans by kind, added spans by key)."""
    scratch = Scratch(docs.sparkSession, "pii")
    rows = scanned(docs, scratch)
    return rows, discovered(rows, scratch)


def pii_report(docs: DataFrame) -> DataFrame:
    rows, added = pii_spans(docs)
    base = F.concat(*[of_kind(F.col(f"_{k}"), k, i) for i, k in enumerate(KINDS)])
    found = attach(rows.select("doc_id", "key", base.alias("base")), added, "key")
    found = found.withColumn("every", F.concat("base", F.coalesce("added", F.slice("base", 1, 0))))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[n(k) for k in KINDS],
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.col("every")).alias("spans"),
        F.size("every").cast("long").alias("n_found"),
    )


def stretches(spans: DataFrame) -> DataFrame:
    """key, marks: sorted array of the disjoint stretches struct(start, end, kind) that spans (key, s) cover, each with its first kind."""
    order = Window.partitionBy("key").orderBy("s")
    before = F.max("s.end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("new", (F.col("s.start") >= F.coalesce(before, F.lit(0))).cast("int")).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    each = rows.groupBy("key", "part").agg(F.min("s").alias("first"), F.max("s.end").alias("end"))
    return each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.col("first.start").alias("start"), F.col("end"), F.col("first.kind").alias("kind")))).alias("marks"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text, and n_chars of the new text where there is such a column."""
    rows, added = pii_spans(docs.select("doc_id", "text"))
    base = F.concat(*[of_kind(F.col(f"_{k}"), k, i) for i, k in enumerate(KINDS)])
    key, mark = fresh(docs.columns, "key", "marks")
    per_text = rows.select("key", base.alias("base")).where(F.size("base") > 0).dropDuplicates(["key"])
    spans = per_text.select("key", F.explode("base").alias("s")).unionByName(added.select("key", F.explode("added").alias("s")))
    marks = Scratch(docs.sparkSession, "marks").keep(stretches(spans), "rows").withColumnsRenamed({"key": key, "marks": mark})
    held = attach(docs.withColumn(key, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))), marks, key)
    found = F.col(mark).isNotNull()
    masked = without(F.col("text"), F.col(mark), lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    held = held.withColumn("text", F.when(found, masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        held = held.withColumn("n_chars", F.when(found, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return held.select(docs.columns)
