"""How filters interact: what each removes, alone and in every order, from a histogram of failure masks.

A row's failures are the bits of a mask: four conditions are native expressions on its text, the fifth, a copy of a text with a smaller key, comes from the smallest key of each text's
digest. Rows shrink to 32 cells for each part; every order of the filters is then read from the cells.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import drop_stored, small, stored

FILTERS = "ABCDE"
#: Least words; percent of different words among words at least, of capitals among characters at most; symbols that no text may hold.
WORDS, DIFFERENT, CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"
_SPACE = r"[\x20\x09-\x0D]+"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: fewer words than WORDS, too few different ones, too many capitals, a symbol."""
    words = F.array_remove(F.split(text, _SPACE), "")
    n, different = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (n < WORDS, 100 * different < DIFFERENT * n, 100 * capitals.cast("long") > CAPITALS * F.length(text), text.rlike(SYMBOLS))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by what they fail; cells without rows are absent.

    A null text counts as empty and a null part as the empty string. A row fails E if its key is larger than the smallest of its text; so rows that repeat text and key don't fail
    by each other, and a null key neither fails nor counts. A key is labelled good or toxic if any of its labels says 1. Texts may have any length; they are compared by
    their SHA-256. Only digests and masks are stored and joined, and only texts that occur twice or more are joined at all.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), whole.alias("text"))
    rows = stored(rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_mask(F.col("text")).cast("int").alias("own")), "masks")
    again = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    again = stored(again, "copies")
    is_one = lambda c: F.max(F.coalesce(F.col(f"`{c}`") == 1, F.lit(False)))
    marks = labels.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").cast("long").alias("doc_id")).agg(is_one(quality).alias("good"), is_one(toxic).alias("toxic"))
    marks = stored(marks, "marks")
    joined = rows.join(small(again), "digest", "left").join(small(marks), "doc_id", "left")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)
    count = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c)
    out = stored(joined.groupBy("part", (F.col("own") + copy).cast("int").alias("mask")).agg(F.count(F.lit(1)).alias("n"), count("good"), count("toxic")), "cells")
    for table in (rows, again, marks):
        drop_stored(table)
    return out


def interactions(cells: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows for each part of ``masks``, zeros included.

    What a step does depends on its filter and on the set before it alone: 80 cases, which each of the 120 orders takes its five from.
    """
    bits = range(len(FILTERS))
    cases = F.array(*(F.struct(F.lit(before).alias("before"), F.lit(1 << bit).alias("bit")) for bit in bits for before in range(1 << len(FILTERS)) if not before >> bit & 1))
    whole = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    each = whole.select("part", "cells", F.explode(cases).alias("case")).select("part", "cells", "case.before", "case.bit")
    before, bit = F.col("before"), F.col("bit")
    total = lambda value: F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(value(c)[0], value(c)[1]).otherwise(F.lit(0).cast("long")))
    fails, gone = lambda c: c["mask"].bitwiseAND(bit) != 0, lambda c: c["mask"].bitwiseAND(before) != 0
    orders = math.factorial(len(FILTERS))
    first = lambda c: c["n"] * (F.lit(orders) / F.bit_count(c["mask"])).cast("long")  # orders in which the filter is the first that a mask fails; noqa: E731
    values = {
        "kept": lambda c: (~fails(c) & ~gone(c), c["n"]), "removed": lambda c: (fails(c) & ~gone(c), c["n"]), "redundant": lambda c: (fails(c) & gone(c), c["n"]), "unique_fails": lambda c: (c["mask"] == bit, c["n"]),
        "good_lost": lambda c: (fails(c) & ~gone(c), c["good"]), "toxic_lost": lambda c: (fails(c) & ~gone(c), c["toxic"]), "shapley": lambda c: (fails(c), first(c)),
    }
    counted = each.select("part", "before", "bit", *(total(v).alias(name) for name, v in values.items()))
    steps = [("".join(FILTERS[i] for i in order), k + 1, sum(1 << i for i in order[:k]), 1 << order[k]) for order in itertools.permutations(bits) for k in bits]
    table = cells.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, bit int")  # 600 rows, whatever the input
    return counted.join(F.broadcast(table), ["before", "bit"]).select("part", "filter_order", "step", *values)


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``interactions`` of the rows of ``docs``; see ``masks`` for nulls, ties and repeated rows. An empty table has no parts and gives no rows; other columns don't matter."""
    return interactions(masks(docs, labels, key, text, part))
