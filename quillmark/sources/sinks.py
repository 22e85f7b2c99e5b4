"""Writers of result tables: whole or not at all, never over an input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def _paths(df: DataFrame, path: str):
    target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())


def write(df: DataFrame, path: str, form: str = "parquet", overwrite: bool = False, by: list[str] | None = None) -> None:
    """Writes a folder of ``form`` (parquet, csv, json), partitioned by ``by``: Spark writes it beside the target and one rename puts it there, so readers see the old table or the whole new one.

    A target that exists is refused without ``overwrite``, and one that the plan reads is refused always.
    """
    target, files = _paths(df, path)
    plain = lambda x: files.makeQualified(x).toUri().getPath().rstrip("/")
    whole, make = plain(target), df.sparkSession._jvm.org.apache.hadoop.fs.Path
    if any(f"{make(x).toUri().getPath()}/".startswith(f"{whole}/") for x in df.inputFiles()):
        raise ValueError("an output is one of the inputs")
    if files.exists(target) and not overwrite:
        raise ValueError(f"{path} exists")
    beside, _ = _paths(df, f"{path.rstrip('/')}.{uuid.uuid4().hex}.part")
    out = df.write.partitionBy(*by) if by else df.write
    try:
        (out.option("header", True) if form == "csv" else out).format(form).save(beside.toString())
        if files.exists(target):
            files.delete(target, True)
        if not files.rename(beside, target):
            raise OSError(f"{path} couldn't be put in place")
    finally:
        files.delete(beside, True)


def write_csv_file(df: DataFrame, path: str, most: int = 10_000_000) -> None:
    """One CSV file with a header for people to open, of at most ``most`` rows: a larger result is refused, not cut."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows; write a folder instead")
    target, files = _paths(df, path)
    beside, _ = _paths(df, f"{path}.{uuid.uuid4().hex}.part")
    try:
        df.coalesce(1).write.option("header", True).csv(beside.toString())
        part = next(f.getPath() for f in files.listStatus(beside) if f.getPath().getName().startswith("part-"))
        files.delete(target, False)
        if not files.rename(part, target):
            raise OSError(f"{path} couldn't be put in place")
    finally:
        files.delete(beside, True)
