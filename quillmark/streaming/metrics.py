"""An extension: decomposable metrics over event-time windows. Rank metrics don't stream exactly and are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.stats import mae, rmse


def windowed(stream: DataFrame, time: str, y: str, p: str, width: str = "1 week", late: str = "1 day") -> DataFrame:
    """(window_start, n, mae, rmse) by tumbling windows; rows later than ``late`` behind the newest are dropped by the watermark, as streaming state requires."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n"), mae(F.col(y), F.col(p)).alias("mae"), rmse(F.col(y), F.col(p)).alias("rmse")).select(F.col("window.start").alias("window_start"), "n", "mae", "rmse")
