"""Audit of an evaluation's design: eligibility, duplicates, leakage between partitions, conflicts and order in time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.sources.scratch import kept


def roles(column: str, rules: Mapping[str, Sequence[str]]) -> Column:
    """Role of a partition name by lists of aliases; null where no list has it."""
    pairs = [F.lit(x) for role, aliases in rules.items() for alias in aliases for x in (alias, role)]
    return F.try_element_at(F.create_map(*pairs), F.col(column).cast("string"))


def mapped_roles(df: DataFrame, column: str, rules: Mapping[str, Sequence[str]], name: str = "role", allow_missing: bool = False) -> DataFrame:
    """``df`` with the role of each row; raises for partition names that no list has, and for missing ones unless these are allowed."""
    out = df.withColumn(name, roles(column, rules))
    bad = F.col(name).isNull() & (F.col(column).isNotNull() if allow_missing else F.lit(True))
    found = [r[0] for r in out.where(bad).select(F.col(column).cast("string")).distinct().limit(3).collect()]
    if found:
        raise ValueError(f"partitions aren't mapped to a role: {found}")
    return out


def excluded(rules: Sequence[Mapping]) -> Column:
    """Whether any rule excludes a row: is_missing, equals, less_than or greater_than; a missing value meets only is_missing."""
    out = F.lit(False)
    for rule in rules:
        c, op = F.col(rule["column"]), rule["op"]
        if op == "is_missing":
            hit = c.isNull()
        elif op == "equals":
            hit = c.cast("string") == F.lit(str(rule["value"]))
        elif op == "less_than":
            hit = c < F.lit(rule["value"])
        elif op == "greater_than":
            hit = c > F.lit(rule["value"])
        else:
            raise ValueError(f"unknown exclusion: {op}")
        out = out | F.coalesce(hit, F.lit(False))
    return out


def eligibility(df: DataFrame, role: str, rules: Sequence[Mapping], evaluation: str = "test") -> DataFrame:
    """(role, kept, excluded): exclusions hold for the evaluation partition only."""
    out_of = (F.col(role) == evaluation) & excluded(rules)
    return df.groupBy(role).agg(F.count_if(~out_of).alias("kept"), F.count_if(out_of).alias("excluded"))


def finding(check: str, affected: DataFrame, policy: str = "forbid", complete: bool = True) -> DataFrame:
    """(check, affected_records, status) from a one-row frame of affected_records: fail or warn if any, else pass, or not_testable without full evidence."""
    bad = "fail" if policy == "forbid" else "warn"
    clean = "pass" if complete else "not_testable"
    return affected.select(F.lit(check).alias("check"), F.col("affected_records").cast("long").alias("affected_records"), F.when(F.col("affected_records") > 0, bad).otherwise(clean).alias("status"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: affected_records, all members of repeated keys and rows with a missing key. Counts by key, so no row is moved."""
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "")
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.max(blank).alias("blank"))
    return counted.agg(F.coalesce(F.sum(F.when((F.col("k") > 1) | F.col("blank"), F.col("k"))), F.lit(0)).alias("affected_records"))


def overlap(df: DataFrame, keys: list[str], role: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One row: affected_records, rows whose key also occurs in a forbidden other role. Rows with a blank part of the key are left out."""
    counted = df.where(_whole(keys)).groupBy(*keys, role).agg(F.count(F.lit(1)).alias("k"))
    grouped = counted.groupBy(*keys).agg(F.collect_list(F.struct(F.col(role).alias("role"), "k")).alias("found"))  # one entry for each role
    has = lambda r: F.exists("found", lambda x: x["role"] == r)
    touched = lambda x: _any((x["role"] == a) & has(b) | (x["role"] == b) & has(a) for a, b in pairs)
    affected = F.aggregate(F.filter("found", touched), F.lit(0).cast("long"), lambda s, x: s + x["k"])
    return grouped.agg(F.coalesce(F.sum(affected), F.lit(0)).alias("affected_records"))


def overlapping_rows(df: DataFrame, columns: list[str], role: str, pairs: Sequence[tuple[str, str]], key: str) -> DataFrame:
    """Distinct keys of rows that share a value of any of ``columns`` with a forbidden other role."""
    each = df.select(key, role, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select(key, role, "x.*").where("value is not null")
    found = each.groupBy("column", "value").agg(F.collect_set(role).alias("found"))
    bad = found.where(_any(F.array_contains("found", a) & F.array_contains("found", b) for a, b in pairs))
    other = bad.select("column", "value", "found")
    hit = each.join(other, ["column", "value"]).where(_any((F.col(role) == a) & F.array_contains("found", b) | (F.col(role) == b) & F.array_contains("found", a) for a, b in pairs))
    return hit.select(key).distinct()


def repeated(df: DataFrame, entity: str, key: str, role: str) -> DataFrame:
    """One row: affected_records, rows of entities that one role holds under several keys."""
    counted = df.where(F.col(entity).isNotNull()).groupBy(role, entity).agg(F.count(F.lit(1)).alias("k"), F.countDistinct(key).alias("ids"))
    return counted.agg(F.coalesce(F.sum(F.when((F.col("k") > 1) & (F.col("ids") > 1), F.col("k"))), F.lit(0)).alias("affected_records"))


def conflicts(df: DataFrame, entity: str, target: str, tolerance: float = 0.0) -> DataFrame:
    """One row: affected_records, rows of entities whose targets differ: by more than the tolerance if all are numbers, else at all."""
    value = F.col(target).try_cast("double")
    counted = df.where(F.col(entity).isNotNull() & F.col(target).isNotNull()).groupBy(entity).agg(
        F.count(F.lit(1)).alias("k"), F.count(value).alias("numbers"), (F.max(value) - F.min(value)).alias("range"), F.countDistinct(F.col(target).cast("string")).alias("labels")
    )
    differ = F.when(F.col("numbers") == F.col("k"), F.col("range") > tolerance).otherwise(F.col("labels") > 1)
    return counted.agg(F.coalesce(F.sum(F.when(differ, F.col("k"))), F.lit(0)).alias("affected_records"))


def chronology(df: DataFrame, role: str, time: str, evaluation: str = "test", cutoff=None, strictly: bool = True) -> DataFrame:
    """One row: affected_records, rows of other roles not before (``strictly``, or at the latest at) the first evaluation row or the ``cutoff``, and evaluation rows before the cutoff."""
    first = df.where(F.col(role) == evaluation).agg(F.min(time).alias("__first")).withColumn("__cut", F.lit(None).cast(df.schema[time].dataType) if cutoff is None else F.lit(cutoff).cast(df.schema[time].dataType))
    limit = F.coalesce("__cut", "__first")
    late = F.col(time) >= limit if strictly else F.col(time) > limit
    early = F.coalesce(F.col(time) < F.col("__cut"), F.lit(False))
    return df.crossJoin(first).agg(F.count_if(F.when(F.col(role) != evaluation, late).otherwise(early)).alias("affected_records"))


class OverBudget(ValueError):
    """A check would need more pairs than its design allows."""


def near_duplicate_finding(df: DataFrame, key: str, vector: str, role: str, pairs: Sequence[tuple[str, str]], threshold: float, budget: int = 100_000_000, policy: str = "forbid") -> DataFrame:
    """(check, affected_records, status) of ``near_duplicates``; beyond the budget the status is pair_budget_exceeded, as nothing was looked at."""
    try:
        found = near_duplicates(df, key, vector, role, pairs, threshold, budget)
    except OverBudget:
        return df.sparkSession.range(1).select(F.lit("near_duplicates").alias("check"), F.lit(None).cast("long").alias("affected_records"), F.lit("pair_budget_exceeded").alias("status"))
    touched = found.select(F.explode(F.array(F.col("key_a"), F.col("key_b"))).alias("k")).distinct().agg(F.count(F.lit(1)).alias("affected_records"))
    return finding("near_duplicates", touched, policy)


#: Most vectors of a block, rows of it that are multiplied at once, and similarities so near to the threshold that they are computed again term by term.
_VECTORS, _AT_ONCE, _NEAR = 8_192, 512, 1e-9


def near_duplicates(df: DataFrame, key: str, vector: str, role: str, pairs: Sequence[tuple[str, str]], threshold: float, budget: int | None = 100_000_000) -> DataFrame:
    """(key_a, key_b, similarity): vectors of forbidden role pairs with a cosine of at least the threshold, exactly.

    The number of pairs is checked before; beyond ``budget`` the check isn't run and raises OverBudget, which ``near_duplicate_finding`` turns into a finding; None is no budget. Each side is cut into blocks
    of bounded size, and each pair of blocks is one task's product of matrices, so no table is broadcast or held whole. Vectors that are null, empty or hold nulls are similar to none; a vector of zeros has
    the similarity NaN, which counts as at least any threshold, as it does in SQL.
    """
    pairs = list(dict.fromkeys(map(tuple, pairs)))
    sizes = {r[role]: r["k"] for r in df.groupBy(role).agg(F.count(F.lit(1)).alias("k")).collect()}
    if budget is not None and sum(sizes.get(a, 0) * sizes.get(b, 0) for a, b in pairs) > budget:
        raise OverBudget("more pairs than the declared budget")
    blocks = max(4, *(-(-k // _VECTORS) for k in sizes.values())) if sizes else 4

    def side(name: str, at: int, own: str, other: str) -> DataFrame:
        which = F.array_compact(F.array(*(F.when(F.col(role) == pair[at], F.lit(i)) for i, pair in enumerate(pairs))))
        rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), F.explode(which).alias("pair"))
        blocked = rows.withColumn(own, F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
        return blocked.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("pair", "i", "j")

    kind = dict(df.dtypes)[key]
    return side("a", 0, "i", "j").cogroup(side("b", 1, "j", "i")).applyInArrow(_similar(threshold), f"key_a {kind}, key_b {kind}, similarity double")


def _vectors(table) -> list[tuple]:
    """(places, vectors, norms) of the vectors of each number of components."""
    import numpy as np
    import pyarrow.compute as pc

    column = table.column("v").combine_chunks()
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    out = []
    for d in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == d)
        flat = column.take(at).flatten()
        whole = ~np.asarray(flat.is_null()).reshape(len(at), d).any(axis=1)
        values = np.asarray(flat.fill_null(0.0), np.float64).reshape(len(at), d)
        norms = np.sqrt((values * values).sum(axis=1))
        if whole.any():
            out.append((at[whole], values[whole], norms[whole]))
    return out


def _similar(threshold: float):
    """Pairs of two blocks of vectors."""
    import math

    import numpy as np
    import pyarrow as pa

    def cosine(x, y) -> float:
        dot = xx = yy = 0.0
        for u, v in zip(x.tolist(), y.tolist()):
            dot, xx, yy = dot + u * v, xx + u * u, yy + v * v
        return dot / (math.sqrt(xx) * math.sqrt(yy))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        mine, others = (_vectors(t) if t.num_rows else [] for t in (left, right))
        for at, x, p in mine:
            for to, y, q in others:
                if x.shape[1] != y.shape[1]:
                    continue
                for k in range(0, len(x), _AT_ONCE):
                    with np.errstate(invalid="ignore"):
                        values = (x[k : k + _AT_ONCE] @ y.T) / (p[k : k + _AT_ONCE, None] * q)
                    i, j = np.nonzero(~(values < threshold - _NEAR))
                    v = values[i, j]
                    for n in np.flatnonzero(np.abs(v - threshold) <= _NEAR).tolist():
                        v[n] = cosine(x[k + i[n]], y[j[n]])
                    hit = ~(v < threshold)
                    found.append((at[k + i[hit]], to[j[hit]], v[hit]))
        a, b, v = (np.concatenate(z) for z in zip(*found))
        return pa.table({"key_a": left.column("key").take(pa.array(a)), "key_b": right.column("key").take(pa.array(b)), "similarity": pa.array(v)})

    return run


def set_classes(df: DataFrame, key: str, features: str, role: str) -> tuple[DataFrame, DataFrame]:
    """(id, set, n, roles) of each different feature set that isn't empty, and (id, key, role) of its rows, both kept: equal sets are compared once, however many rows have them."""
    own = F.array_sort(F.array_distinct(features))
    rows = df.select(F.col(key).alias("key"), F.col(role).cast("string").alias("role"), own.alias("set")).where(F.size("set") > 0)
    named = rows.withColumn("id", F.sha2(F.to_json(F.struct("set")), 256))
    classes = named.groupBy("id").agg(F.first("set").alias("set"), F.array_sort(F.collect_set("role")).alias("roles"))  # roles are few
    return kept(classes.withColumn("n", F.size("set")), "sets"), kept(named.select("id", "key", "role"), "members")


def _heads(classes: DataFrame, threshold: float) -> DataFrame:
    """(id, n, roles, feature): the rarest features of each set, of which two sets that are similar enough share at least one."""
    often = classes.select(F.explode("set").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("often"))
    counted = classes.select("id", "n", F.explode("set").alias("feature")).join(often, "feature")
    ordered = counted.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("often", "feature"))).alias("ordered"))  # the features of one set
    first = F.slice("ordered", 1, (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).cast("int"))
    return kept(ordered.select("id", "n", F.explode(F.transform(first, lambda x: x["feature"])).alias("feature")).join(classes.select("id", "roles"), "id"), "heads")


def candidate_bound(heads: DataFrame, pairs: Sequence[tuple[str, str]]) -> int:
    """The most pairs of sets that a join of ``heads`` on their features can give, from counts of each feature alone."""
    has = lambda r: F.array_contains("roles", r)
    names = sorted({r for pair in pairs for r in pair})
    counts = heads.groupBy("feature").agg(*(F.count_if(has(r)).alias(f"c{i}") for i, r in enumerate(names)))
    made = sum((F.col(f"c{names.index(a)}").cast("decimal(38,0)") * F.col(f"c{names.index(b)}") for a, b in pairs), F.lit(0).cast("decimal(38,0)"))
    return int(counts.agg(F.sum(made)).first()[0] or 0)


def similar_sets(classes: DataFrame, heads: DataFrame, pairs: Sequence[tuple[str, str]], threshold: float) -> DataFrame:
    """(id_a, role_a, id_b, role_b, similarity) of sets of forbidden role pairs that are similar enough; a set that both roles have is similar to itself."""
    a, b = (heads.select(*(F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "roles")), "feature") for side in "ab")
    fits = F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b") - 1e-9
    wanted = F.array(*(F.struct(F.lit(x).alias("role_a"), F.lit(y).alias("role_b")) for x, y in pairs))
    held = lambda left, right: F.filter(wanted, lambda p: F.array_contains(left, p["role_a"]) & F.array_contains(right, p["role_b"]))
    met = a.join(b, "feature").where(fits & (F.col("id_a") != F.col("id_b"))).withColumn("as", held(F.col("roles_a"), F.col("roles_b"))).where(F.size("as") > 0).select("id_a", "id_b", "as").distinct()
    sets = classes.select("id", "set")
    both = met.join(sets.toDF("id_a", "set_a"), "id_a").join(sets.toDF("id_b", "set_b"), "id_b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    found = both.select("id_a", "id_b", "as", (common / (F.size("set_a") + F.size("set_b") - common)).alias("similarity")).where(F.col("similarity") >= F.lit(threshold) - 1e-12)
    equal = classes.withColumn("as", held(F.col("roles"), F.col("roles"))).where(F.size("as") > 0).select(F.col("id").alias("id_a"), F.col("id").alias("id_b"), "as", F.lit(1.0).alias("similarity"))
    return found.unionByName(equal).select("id_a", "id_b", "similarity", F.explode("as").alias("p")).select("id_a", "p.role_a", "id_b", "p.role_b", "similarity")


def _within(df: DataFrame, key: str, features: str, role: str, pairs: Sequence[tuple[str, str]], threshold: float, budget: int | None) -> tuple[DataFrame, DataFrame]:
    classes, members = set_classes(df, key, features, role)
    heads = _heads(classes, threshold)
    if budget is not None and (most := candidate_bound(heads, pairs)) > budget:
        raise OverBudget(f"up to {most} candidate pairs, more than the declared budget")
    return similar_sets(classes, heads, pairs, threshold), members


def tanimoto(df: DataFrame, key: str, features: str, role: str, pairs: Sequence[tuple[str, str]], threshold: float, budget: int | None = None) -> DataFrame:
    """(key_a, key_b, similarity): rows of forbidden role pairs whose feature sets (arrays of distinct values) have a Tanimoto similarity of at least the threshold.

    Exact by a prefix filter: sets that are similar enough share one of the rarest features of either, so sets only meet where they do. Equal sets are one; only the result has their rows. With a ``budget`` of
    candidate pairs, a bound of these is computed from counts before any pair is made, and OverBudget is raised beyond it. Rows without features, or with a null role, are similar to none.
    """
    found, members = _within(df, key, features, role, pairs, threshold, budget)
    rows = members.select("id", "key", "role")
    return found.join(rows.toDF("id_a", "key_a", "role_a"), ["id_a", "role_a"]).join(rows.toDF("id_b", "key_b", "role_b"), ["id_b", "role_b"]).select("key_a", "key_b", "similarity")


def tanimoto_finding(df: DataFrame, key: str, features: str, role: str, pairs: Sequence[tuple[str, str]], threshold: float, budget: int = 100_000, policy: str = "forbid") -> DataFrame:
    """(check, affected_records, status) of similar rows, counted by sets without making pairs of rows; beyond the budget the status is pair_budget_exceeded and no pair was made."""
    try:
        found, members = _within(df, key, features, role, pairs, threshold, budget)
    except OverBudget:
        return df.sparkSession.range(1).select(F.lit("near_duplicates").alias("check"), F.lit(None).cast("long").alias("affected_records"), F.lit("pair_budget_exceeded").alias("status"))
    sides = F.array(F.struct(F.col("id_a").alias("id"), F.col("role_a").alias("role")), F.struct(F.col("id_b").alias("id"), F.col("role_b").alias("role")))
    touched = found.select(F.explode(sides).alias("x")).select("x.id", "x.role").distinct()
    return finding("near_duplicates", members.join(touched, ["id", "role"], "left_semi").select("key").distinct().agg(F.count(F.lit(1)).alias("affected_records")), policy)


def examples(df: DataFrame, key: str, most: int = 10) -> DataFrame:
    """One row (examples): the ``most`` smallest keys of a finding's rows."""
    return df.select(F.col(key).cast("string").alias("k")).distinct().orderBy("k").limit(most).agg(F.array_sort(F.collect_list("k")).alias("examples"))


def audited(df: DataFrame, design: Mapping) -> DataFrame:
    """All findings (check, affected_records, status) that a ``design`` asks for, of rows with a role.

    ``design`` has key, role, evaluation, exclusions, and by name of a check its settings, each with a ``policy``: duplicates {columns}, overlap {columns, pairs},
    repeated {entity}, conflicts {entity, target, tolerance}, chronology {time, cutoff, strictly_before}. Exclusions are applied before anything looks at values. A check whose columns the table
    lacks is not_testable.
    """
    key, role, evaluation = design["key"], design["role"], design.get("evaluation", "test")
    kept = df.where(~((F.col(role) == evaluation) & excluded(design.get("exclusions", ()))))
    runs = {
        "duplicates": lambda c: duplicates(kept, c["columns"]),
        "overlap": lambda c: overlap(kept, c["columns"], role, c["pairs"]),
        "repeated": lambda c: repeated(kept, c["entity"], key, role),
        "conflicts": lambda c: conflicts(kept, c["entity"], c["target"], c.get("tolerance", 0.0)),
        "chronology": lambda c: chronology(kept, role, c["time"], evaluation, c.get("cutoff"), c.get("strictly_before", True)),
    }
    out = None
    for name, run in runs.items():
        settings = design.get(name)
        if settings is None:
            continue
        needed = [*settings.get("columns", ()), *(settings[k] for k in ("entity", "target", "time") if k in settings)]
        there = all(c in df.columns for c in needed)
        counted = run(settings) if there else df.sparkSession.range(1).select(F.lit(0).alias("affected_records"))
        row = finding(name, counted, settings.get("policy", "forbid"), there)
        out = row if out is None else out.union(row)
    if out is None:
        raise ValueError("the design asks for no check")
    return out


def consistent(findings: DataFrame, summary: DataFrame) -> DataFrame:
    """One row (consistent): whether a summary (status, failed, warned, not_testable) is the one that its findings give."""
    names = ["status", "failed", "warned", "not_testable"]
    own = rolled_up(findings).select(*(F.col(c).alias(f"__{c}") for c in names))
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return summary.crossJoin(own).agg((F.bool_and(same) & (F.count(F.lit(1)) == 1)).alias("consistent"))


def rolled_up(findings: DataFrame) -> DataFrame:
    """One row (status, failed, warned, not_testable): the worst status of all findings."""
    counts = findings.agg(*(F.count_if(F.col("status") == s).alias(name) for s, name in (("fail", "failed"), ("warn", "warned"), ("not_testable", "not_testable"))))
    status = F.when(F.col("failed") > 0, "fail").when(F.col("warned") > 0, "warn").when(F.col("not_testable") > 0, "not_testable").otherwise("pass")
    return counts.select(status.alias("status"), "failed", "warned", "not_testable")


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _whole(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != "")
    return out
