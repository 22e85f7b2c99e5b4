"""Shared helpers of the training-data operators: scratch tables and input normalisation."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that are broadcast at most, and what a field of varying length counts as besides its own bytes.
BROADCAST_BYTES, FIELD = 16 << 20, 16


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or a local default when a test leaves it unset."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = f"file:///tmp/quillmark-shared-{os.getuid()}"
    return set_dir.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/quillmark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written below the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillmark_path = path
    return out


def small(keys: DataFrame) -> DataFrame:
    """``keys``, marked for broadcast if its measured size is within BROADCAST_BYTES; a larger table is joined by shuffling."""
    wide = [f.name for f in keys.schema.fields if f.dataType.typeName() in ("string", "binary")]
    own = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in wide), F.lit(FIELD * (1 + len(keys.columns))))
    nested = sum(len(f.dataType.fields) for f in keys.schema.fields if f.dataType.typeName() == "struct")
    lists = sum((FIELD * 6 * F.greatest(F.size(F.col(f"`{f.name}`")), F.lit(0)) for f in keys.schema.fields if f.dataType.typeName() == "array"), F.lit(FIELD * nested))
    size = keys.agg(F.sum((own + lists).cast("long"))).first()[0] or 0
    return F.broadcast(keys) if size <= BROADCAST_BYTES else keys


def drop_stored(df: DataFrame) -> None:
    """Deletes a table that ``stored`` wrote and that no later plan reads."""
    path = getattr(df, "_quillmark_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def unused(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """``names``, each with as many underscores before it as it takes to differ from every column of ``docs`` in any case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return tuple(out)


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key (long) and text (null becomes empty) under fixed names, whatever else the table holds."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


_held: dict = {"owner": None, "store": {}}


def worker_store(owner: str) -> dict:
    """What an operator keeps in a Python worker between tasks; workers outlive stages, so the store of another operator is dropped first."""
    if _held["owner"] != owner:
        _held["owner"], _held["store"] = owner, {}
    return _held["store"]


def large_text(column: pa.ChunkedArray | pa.Array) -> tuple["np.ndarray", "np.ndarray"]:
    """UTF-8 bytes of a string column without nulls and the offset of each row in them."""
    import numpy as np

    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if len(array) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(offsets: "np.ndarray", most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or one row where that row alone is longer."""
    import numpy as np

    n, low = len(offsets) - 1, 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1
        high = min(n, max(low + 1, high))
        yield low, high
        low = high


def per_batch(make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """A ``mapInArrow`` function that turns each batch by ``make``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield make(batch)

    return run
