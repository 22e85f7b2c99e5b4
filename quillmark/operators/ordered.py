"""Running sums and ranks over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.sources.scratch import kept

#: Most ranges of a running sum, values of a text column from which ranges are cut, and rows that one task may order by itself.
PARTS, SAMPLE, FEW = 256, 4096, 50_000


def _cuts(df: DataFrame, order: str, parts: int) -> list:
    """Values that cut ``order`` into about ``parts`` ranges of equal size: quantiles of numbers; of texts those of the SAMPLE values of the smallest hashes."""
    if dict(df.dtypes)[order] != "string":
        return df.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 10_000)).first()[0] or []
    some = sorted(r[0] for r in df.where(F.col(order).isNotNull()).select(order).orderBy(F.xxhash64(order), order).limit(SAMPLE).collect())
    return [some[len(some) * k // parts] for k in range(1, parts)] if some else []


def running(df: DataFrame, by: list[str], order: str, sums: list[str], rows: int | None = None) -> DataFrame:
    """``df`` with before_<c>: the sum of column ``c`` over the rows before, in the order of the number or text ``order`` within ``by``.

    Quantiles of ``order``, at most PARTS of them, cut the rows into ranges; each range sums up its own rows, and a table of one row for each range and
    group says what came before. The cuts are constants of the plan, so that a range is the same wherever it is computed again. ``order`` should be
    unique within ``by``. ``rows``, if the caller knows how many there are, spares the cuts where FEW or less are to be ordered.
    """
    if rows is not None and rows <= FEW:
        before = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return df.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in sums))
    parts = min(PARTS, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = []
    if parts > 1:
        cuts = sorted(set(_cuts(df, order, parts)))
    below = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)
    dealt = df.withColumn("__part", F.when(F.col(order).isNull(), -1).otherwise(below))
    totals = dealt.groupBy("__part", *by).agg(*(F.sum(c).alias(f"__t_{c}") for c in sums))
    earlier = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("__part", *by, *(F.coalesce(F.sum(f"__t_{c}").over(earlier), F.lit(0)).alias(f"__o_{c}") for c in sums))
    inside = W.partitionBy("__part", *by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    own = dealt.withColumns({f"__w_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    joined = own.join(offsets, ["__part", *by])
    return joined.select(*(F.col(c) for c in df.columns), *((F.col(f"__w_{c}") + F.col(f"__o_{c}")).alias(f"before_{c}") for c in sums))


def average_rank(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """(by, column, rank): the mean rank of each distinct value."""
    by = by or []
    counted = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("__k"))
    placed = running(counted, by, column, ["__k"])
    return placed.select(*by, column, (F.col("before___k") + (F.col("__k") + 1) / 2).alias("rank"))


def suffix_least(df: DataFrame, order: str, value: str, rows: int | None = None) -> DataFrame:
    """``df`` with least_<value>: the least ``value`` of the rows from this one on, in the order of the number ``order``, which should be unique; by ranges, as ``running``."""
    cuts = [] if rows is not None and rows <= FEW else sorted(set(_cuts(df, order, min(PARTS, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))))
    below = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)
    dealt = df.withColumn("__part", below)
    own = F.min(value).over(W.partitionBy("__part").orderBy(order).rowsBetween(0, W.unboundedFollowing))
    after = dealt.groupBy("__part").agg(F.min(value).alias("__v")).select("__part", F.min("__v").over(W.orderBy("__part").rowsBetween(1, W.unboundedFollowing)).alias("__after"))  # a row for each range
    return dealt.withColumn("__own", own).join(F.broadcast(after), "__part").select(*df.columns, F.least("__own", "__after").alias(f"least_{value}"))


def quantiles(df: DataFrame, columns: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with the exact, linearly interpolated quantiles ``{name: (column, share)}`` of numbers; nulls and NaN are left out, and a column without numbers gives null.

    Two passes: counts, ends and approximate quantiles on either side of each share, which bracket it; then the rows below a bracket and the different values inside. Only these are ranked, so that no task
    holds all values of a column. A bracket that misses its share is replaced by the column's whole range.
    """
    margin = 4e-4  # twice the error of the approximation; above FEW rows it holds the values on either side too
    number = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c, _ in columns.values()}
    asked = [(name, c, q) for name, (c, q) in columns.items()]
    found = df.agg(
        *(F.struct(F.count(number[c]).alias("n"), F.min(number[c]).alias("low"), F.max(number[c]).alias("high"), F.percentile_approx(number[c], [max(0.0, q - margin), min(1.0, q + margin)], 10_000).alias("ends")).alias(name) for name, c, q in asked)
    ).first()
    size = {name: found[name].n for name, _, _ in asked}
    ends = {name: ((found[name].low, found[name].high) if size[name] <= FEW else tuple(found[name].ends)) for name, _, _ in asked if size[name]}
    if not ends:
        return df.sparkSession.range(1).select(*(F.lit(None).cast("double").alias(name) for name in columns))
    place = {name: (size[name] - 1) * q for name, _, q in asked}

    def ranked(ends: dict) -> tuple[DataFrame, dict]:
        """The values inside brackets, and by name the rows below and inside."""
        each = F.array(*(F.struct(F.lit(name).alias("name"), number[c].alias("v"), F.lit(low).alias("low"), F.lit(high).alias("high")) for name, c, _ in asked if name in ends for low, high in [ends[name]]))
        rows = df.select(F.explode(each).alias("x")).where("x.v is not null and x.v <= x.high")
        counts = kept(rows.select("x.name", F.when(F.col("x.v") >= F.col("x.low"), F.col("x.v")).alias("value")).groupBy("name", "value").agg(F.count(F.lit(1)).alias("k")), "brackets")
        held = {(r.name, r.below): r.k for r in counts.groupBy("name", F.col("value").isNull().alias("below")).agg(F.sum("k").alias("k")).collect()}
        return counts.where("value is not null"), {name: (held.get((name, True), 0), held.get((name, False), 0)) for name in ends}

    counts, held = ranked(ends)
    missed = [name for name, (below, inside) in held.items() if not (below <= int(place[name]) and place[name] <= below + inside - 1)]
    if missed:
        ends |= {name: (found[name].low, found[name].high) for name in missed}
        counts, held = ranked(ends)
    placed = running(counts, ["name"], "value", ["k"], counts.count())
    out = []
    for name in columns:
        if name not in ends:
            out.append(F.lit(None).cast("double").alias(name))
            continue
        first = held[name][0] + F.col("before_k")
        holds = lambda k, first=first, name=name: F.max(F.when((F.col("name") == name) & (first <= k) & (k < first + F.col("k")), F.col("value")))
        low, part = int(place[name]), place[name] - int(place[name])
        out.append((holds(low) if part == 0 else holds(low) * (1 - part) + holds(low + 1) * part).alias(name))
    return placed.agg(*out)
