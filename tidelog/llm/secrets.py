"""Secret scan with multipart credential linking, in Spark expressions only.

Base spans are assignments of secrets, access keys and long hexadecimal strings. The method adds weak parts: identifiers,
secret-like strings and endpoints that prove nothing alone. A part's scope is its line and the REACH lines on either side, however
long they are; parts of a text are joined as intervals of lines. A weak secret is reported if an identifier or endpoint is in its
scope, a weak identifier or endpoint if a secret is; base spans take part as secrets (assign, hex) and identifiers (access).

Null texts count as empty. Texts are searched whole, and parts have any length. Texts that are equal have equal spans, so copies
are linked once. Repeated rows give a row each; other columns, also those named as the operator's own, are not read. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .spans import attach, matches, of_kind, spans_text

#: Contract patterns. Where a run is wanted that has a least length, its quantifier says so: the matches are the same.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: Weak parts.
WEAK_ID = r"""(?i)(?<![a-z0-9])(?:access_?key_?id|client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}+"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
ENDPOINT = r"""(?i)(?<![a-z0-9])(?:(?:https?|jdbc:[a-z]{1,20}|mongodb|postgres|postgresql|mysql|redis|amqp|s3)://[^\s"'<>]{3,}+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}+)"""
#: Lines before and behind its own that a part's scope has.
REACH = 1
BASE = ("assign", "access", "hex")


def base_spans(text: Column) -> dict[str, Column]:
    yes = lambda _: F.lit(True)
    return {
        "assign": of_kind(matches(text, ASSIGN, lambda g: F.length(g) >= 6, group=2), "assign", 0),
        "access": of_kind(matches(text, ACCESS, yes), "access", 1),
        "hex": of_kind(matches(text, HEX, yes), "hex", 2),
    }


def weak_spans(text: Column) -> Column:
    yes = lambda _: F.lit(True)
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
    kinds = (("weak_id", WEAK_ID, yes), ("weak_secret", WEAK_SECRET, mixed), ("weak_endpoint", ENDPOINT, yes))
    return F.concat(*[of_kind(matches(text, p, keep), k, 3 + i) for i, (k, p, keep) in enumerate(kinds)])


def linked(parts: DataFrame) -> DataFrame:
    """key, added: the weak parts with a complement in their scope; parts: key, base, weak."""
    one = parts.where((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)).dropDuplicates(["key"])
    rows = one.select("key", F.explode(F.concat("base", "weak")).alias("s")).select("key", "s", F.col("s.line").alias("line"), F.col("s.kind").alias("kind"))
    scope = Window.partitionBy("key").orderBy("line").rangeBetween(-REACH, REACH)
    has = lambda *kinds: F.max(F.col("kind").isin(*kinds)).over(scope)
    rows = rows.select("key", "s", "kind", has("assign", "hex", "weak_secret").alias("secret"), has("access", "weak_id", "weak_endpoint").alias("other"))
    told = ((F.col("kind") == "weak_secret") & F.col("other")) | (F.col("kind").isin("weak_id", "weak_endpoint") & F.col("secret"))
    return rows.where(told).groupBy("key").agg(F.sort_array(F.collect_set("s")).alias("added"))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (arrays by kind), spans (all, sorted) for each row."""
    scratch = Scratch(docs.sparkSession, "secrets")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = base_spans(text)
    parts = docs.select("doc_id", F.md5(text.cast("binary")).alias("key"), *[c.alias(f"_{k}") for k, c in found.items()], weak_spans(text).alias("weak"))
    parts = scratch.keep(parts.withColumn("base", F.concat(*[f"_{k}" for k in BASE])), "parts")
    added = scratch.keep(linked(parts.select("key", "base", "weak")), "added")
    return attach(parts, added, "key").withColumn("spans", F.concat("base", F.coalesce("added", F.slice("weak", 1, 0))))


def secret_report(docs: DataFrame) -> DataFrame:
    found = secret_spans(docs)
    return found.select(
        "doc_id",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_found"),
    )
