"""Readers for pairs, cohorts, eligible rows, molecules, owner tables and features, and helpers for paths and digests."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import audit
from quillmark.operators.molecules import is_smiles
from quillmark.sources.binding import Binding, read_csv, validate


def resolve(path: str, config: str | None = None) -> str:
    """An input path beside its configuration if there is such a file, else from the working folder; absolute paths and URLs stay."""
    if os.path.isabs(path) or "://" in path:
        return path
    beside = os.path.join(os.path.dirname(os.path.abspath(config)), path) if config else ""
    return beside if beside and os.path.exists(beside) else os.path.abspath(path)


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """The header of a CSV file; names must be unique."""
    names = spark.read.option("header", False).option("maxColumns", 100_000).csv(path).limit(1).collect()
    found = [str(x) for x in names[0]] if names else []
    if len(set(found)) != len(found):
        raise ValueError("column names must be unique")
    return found


def read_pair(spark: SparkSession, path_a: str, path_b: str, binding: Binding, metadata: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Two prediction tables under one schema, each validated."""
    return tuple(validate(read_csv(spark, path, binding, tuple(metadata)), binding) for path in (path_a, path_b))


def read_cohorts(spark: SparkSession, reference: str, current: str, binding: Binding, strings: Sequence[str] = ()) -> DataFrame:
    """Two files as one table with a cohort column; the ids of a cohort are unique."""
    parts = [validate(read_csv(spark, path, binding, tuple(strings)), binding).withColumn("cohort", F.lit(name)) for name, path in (("reference", reference), ("current", current))]
    return parts[0].unionByName(parts[1])


def eligible(df: DataFrame, role: str, rules: Sequence[Mapping], wanted: str | None = None, evaluation: str | None = None) -> DataFrame:
    """The rows that are kept by ``rules``, of one role if it is named; excluded rows are left out before anything looks at their values.

    With an ``evaluation`` role, rules exclude rows of this role alone and training rows stay; without one they exclude rows of every role.
    """
    gone = F.coalesce(audit.excluded(rules), F.lit(False))
    if evaluation is not None:
        gone = gone & F.coalesce(F.col(role) == evaluation, F.lit(False))
    out = df.where(~gone)
    return out.where(F.col(role) == wanted) if wanted else out


def with_reference(evaluation: DataFrame, training: DataFrame) -> DataFrame:
    """Evaluation rows and a training reference of other columns, one below the other; columns that one lacks are null there."""
    return evaluation.unionByName(training, allowMissingColumns=True)


def concatenated(parts: Mapping[str, DataFrame], name: str) -> DataFrame:
    """Tables of the same columns one below the other, with their names in the column ``name``: folds, assays, clients."""
    out = None
    for key in sorted(parts):
        one = parts[key].withColumn(name, F.lit(key))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("there is nothing to concatenate")
    return out


def read_molecules(spark: SparkSession, path: str, target: str, smiles: str = "smiles", task: str = "regression") -> DataFrame:
    """(smiles, target) of a CSV file without incomplete rows; raises where a structure has characters that none can have."""
    table = spark.read.option("header", True).option("mode", "FAILFAST").csv(path).select(smiles, target).dropna()
    wrong = table.where(~is_smiles(F.col(smiles))).limit(3).collect()
    if wrong:
        raise ValueError(f"these aren't structures: {[r[0] for r in wrong]}")
    return table.withColumn(target, F.col(target).cast("double" if task == "regression" else "string"))


def owner_table(df: DataFrame, key: str, label: str, inputs: Sequence[str] = ()) -> DataFrame:
    """A hidden benchmark's table, if ids are unique and complete and nothing that is scored is missing."""
    needed = [key, label, *inputs]
    gone = F.lit(False)
    for c in needed:
        gone = gone | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    found = df.groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.count_if(gone).alias("gone")).agg(F.count(F.lit(1)).alias("ids"), F.sum("k").alias("rows"), F.sum("gone").alias("gone")).first()
    if not found["ids"]:
        raise ValueError("the owner's table is empty")
    if found["rows"] != found["ids"] or found["gone"]:
        raise ValueError(f"{found['rows'] - found['ids']} repeated ids and {found['gone']} incomplete rows in the owner's table")
    return df


def one_group(df: DataFrame, column: str) -> str:
    """The only evaluation group of a table; raises if there are several or any is missing."""
    found = df.agg(F.countDistinct(column).alias("k"), F.count_if(F.col(column).isNull()).alias("gone"), F.min(column).alias("v")).first()
    if found["k"] != 1 or found["gone"]:
        raise ValueError(f"{column} must name exactly one group: {found['k']} found, {found['gone']} rows without")
    return str(found["v"])


def features(df: DataFrame, names: Sequence[str], most_cells: int = 20_000_000, most: int = 10_000) -> DataFrame:
    """Feature columns as finite doubles; raises beyond the limits of cells and features, and for values that aren't finite."""
    if len(names) > most:
        raise ValueError(f"more than {most} features")
    cast = df.withColumns({c: F.col(c).cast("double") for c in names})
    wrong = F.lit(False)
    for c in names:
        wrong = wrong | F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    found = cast.agg(F.count(F.lit(1)).alias("rows"), F.count_if(wrong).alias("wrong")).first()
    if found["rows"] * len(names) > most_cells:
        raise ValueError(f"more than {most_cells} cells")
    if found["wrong"]:
        raise ValueError(f"{found['wrong']} rows hold features that aren't finite")
    return cast


def checked_output(df: DataFrame, prediction: str, probability: bool = False) -> DataFrame:
    """A scorer's output, if it has one finite number for each row, from 0 to 1 where it is a probability."""
    p = F.col(prediction)
    wrong = p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")) | ((p < 0) | (p > 1) if probability else F.lit(False))
    if df.where(wrong).limit(1).count():
        raise ValueError("the scorer gave values that aren't finite or are no probabilities")
    return df


def table_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (n, digest) that depends on the rows' content but not on their order, by sums of row hashes; no list of all rows is made."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.sum(F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("|", *(F.coalesce(part(k), F.lit(0)).cast("string") for k in range(5)), F.count(F.lit(1)).cast("string")), 256).alias("digest"))


def iso_timestamp(c: Column) -> Column:
    """UTC time of ISO 8601 text: a date alone, or a time with its zone; null for anything else, times without a zone included."""
    text = F.trim(c.cast("string"))
    day = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    zoned = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})$")
    return F.when(day, F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).when(zoned, F.try_to_timestamp(text))


def slug(c: Column) -> Column:
    """Lower-case letters, digits and single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-|-$", "")


def scanned_files(spark: SparkSession, path: str, names: list[str], header: bool = True, wanted: list[str] | None = None, rows_at_once: int = 8192) -> DataFrame:
    """(file, sha256, row, wanted columns as text) of CSV files, by one read: the digest is that of exactly the bytes that the rows were taken from.

    A file is one task's work, and at most 2 GB; its rows leave in batches of ``rows_at_once``. Quoted fields may hold separators and line ends. Empty fields are null. Rows of another length than
    ``names``, and a header that isn't ``names``, are errors. An empty file has no rows, and none either with a header alone.
    """
    import csv
    import io

    wanted = wanted or names
    at = [names.index(c) for c in wanted]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"), "content")
    kinds = "file string, sha256 string, row long, " + ", ".join(f"`{c}` string" for c in wanted)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, digest, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lines = csv.reader(io.StringIO(content.decode(), newline=""))
                if header and (first := next(lines, names)) != names:
                    raise ValueError(f"{name} has the columns {first}")
                part, done = [], 0
                for line in lines:
                    if line:
                        if len(line) != len(names):
                            raise ValueError(f"row {done + len(part)} of {name} has {len(line)} fields")
                        part.append([line[i] or None for i in at])
                    if len(part) == rows_at_once:
                        yield _batch(pa, name, digest, done, part, wanted)
                        done, part = done + len(part), []
                if part:
                    yield _batch(pa, name, digest, done, part, wanted)

    return files.mapInArrow(run, kinds)


def _batch(pa, name, digest, done, part, wanted):
    n = len(part)
    columns = [pa.array([name] * n), pa.array([digest] * n), pa.array(range(done, done + n), pa.int64()), *(pa.array([r[i] for r in part], pa.string()) for i in range(len(wanted)))]
    return pa.RecordBatch.from_arrays(columns, ["file", "sha256", "row", *wanted])


def verified_rows(scan: DataFrame, pins: Mapping[str, str]) -> DataFrame:
    """The rows of ``scanned_files``, kept, if every file's digest is the one that is pinned for its name; else an error before any row counts. The files are read once; what is checked is what is returned.

    ``pins`` has the last part of a file's path, or as many of its last parts as tell files apart; a pin of more parts comes first. A pinned file without rows isn't seen here.
    """
    from quillmark.sources.scratch import kept

    held = kept(scan, "scan")
    seen = {(r.file, r.sha256) for r in held.select("file", "sha256").distinct().collect()}  # one row for each file

    def pinned(path: str) -> str | None:
        parts = path.split("/")
        return next((pins[name] for name in ("/".join(parts[k:]) for k in range(len(parts))) if name in pins), None)

    wrong = sorted(path for path, digest in seen if pinned(path) != digest)
    if wrong:
        raise ValueError(f"files differ from their pinned digests: {wrong[:3]}")
    return held
