"""Spans of pattern matches as native column expressions.

A match's place is the summed length of the pieces between matches and of the matches before it, so one pass of ``split`` and
one of ``regexp_extract_all`` give all spans; nothing leaves the JVM. Patterns are possessive where they repeat a
group, so that Java's matcher loops instead of recursing however long a match is, and begin with a guard, so that a long
run is not tried again from each of its characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256
SPAN = "array<struct<start: bigint, rank: int, end: bigint, kind: string, score: double>>"


def matches(text: Column, pattern: str, hint: Column | None = None) -> Column:
    """Array of (start, end, match) of the leftmost non-overlapping matches, in code points; ``hint`` false says that there are none."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, found: F.struct(F.length(gap).cast("long").alias("gap"), found.alias("found")))
    empty = F.expr("cast(array() as array<struct<start: bigint, end: bigint, found: string>>)")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))

    def add(seen, x):
        first = seen["at"] + x["gap"]
        last = first + F.length(x["found"])
        one = F.struct(first.alias("start"), last.alias("end"), x["found"].alias("found"))
        return F.when(x["found"].isNull(), seen).otherwise(F.struct(last.alias("at"), F.concat(seen["out"], F.array(one)).alias("out")))

    def add_block(seen, block):
        return F.aggregate(block, F.struct(seen["at"].alias("at"), empty.alias("out")), add, lambda one: F.struct(one["at"].alias("at"), F.concat(seen["out"], one["out"]).alias("out")))

    def places(all_pairs):  # in blocks, so that building the list doesn't cost the square of its length
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_pairs) - 1) / BLOCK).cast("int")), lambda b: F.slice(all_pairs, b * BLOCK + 1, F.lit(BLOCK)))
        return F.aggregate(cut, start, add_block, lambda seen: seen["out"])

    found = F.transform(F.array(pairs), places)[0]
    return found if hint is None else F.when(hint, found).otherwise(empty)


def spans(found: Column, kind: str, rank: int, keep=None, score=None) -> Column:
    """The matches that ``keep`` accepts, as spans of a kind; ``rank`` orders kinds that begin together."""
    if keep is not None:
        found = F.filter(found, lambda x: keep(x["found"]))
    score = score or (lambda x: F.lit(1.0))
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), score(x).alias("score")))


def merged(*parts: Column) -> Column:
    """All spans by start, then kind as listed."""
    return F.array_sort(F.concat(*parts))


def listed(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def of_kind(found: Column, *kinds: str) -> Column:
    return F.filter(found, lambda x: x["kind"].isin(*kinds))


def counted(found: Column, kind: str) -> Column:
    return F.size(of_kind(found, kind)).cast("long")


def masked(text: Column, found: Column, mark: str) -> Column:
    """``text`` with every span, or chain of overlapping spans, replaced by ``mark``."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(seen, x):
        gap = F.substring(text, (seen["at"] + 1).cast("int"), (x["start"] - seen["at"]).cast("int"))
        longer = F.struct(F.greatest(seen["at"], x["end"]).alias("at"), seen["out"].alias("out"))
        return F.when(x["start"] < seen["at"], longer).otherwise(F.struct(x["end"].alias("at"), F.concat(seen["out"], gap, F.lit(mark)).alias("out")))

    rest = lambda seen: F.concat(seen["out"], F.substring(text, (seen["at"] + 1).cast("int"), F.lit(2147483647)))
    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, start, add, rest))
