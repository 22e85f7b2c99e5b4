"""Molecule strings: checks, hashed fingerprints, linear scores and a forest baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.stats import number

#: Characters of a molecule string.
SMILES = r"^[A-Za-z0-9@+\-\[\]()=#$\\/%.]+$"


def is_smiles(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(SMILES), F.lit(False))


def fingerprint(df: DataFrame, key: str, smiles: str, bits: int = 256, shortest: int = 1, longest: int = 4) -> DataFrame:
    """(key, idx, value): counts of hashed character n-grams, scaled to unit length, sparse."""
    s = F.col(smiles)
    grams = F.flatten(F.transform(F.sequence(F.lit(shortest), F.lit(longest)), lambda n: F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substring(s, i, n))).otherwise(F.expr("cast(array() as array<string>)"))))
    at = F.pmod(F.conv(F.substring(F.sha2(F.col("__gram"), 256), 1, 8), 16, 10).cast("long"), F.lit(bits))
    counts = df.select(F.col(key), F.explode(grams).alias("__gram")).groupBy(key, at.alias("idx")).agg(F.count(F.lit(1)).cast("double").alias("__k"))
    norm = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("__k") * F.col("__k"))).alias("__norm"))
    return counts.join(norm, key).select(key, "idx", (F.col("__k") / F.col("__norm")).alias("value"))


def dense_fingerprint(df: DataFrame, key: str, smiles: str, bits: int = 256) -> DataFrame:
    """``df`` with features, the fingerprint as a vector."""
    from pyspark.ml.functions import array_to_vector

    sparse = fingerprint(df, key, smiles, bits).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("int"), "value"))).alias("m"))
    array = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.coalesce(F.try_element_at("m", i), number(0)))
    return df.join(sparse.select(key, array_to_vector(array).alias("features")), key)


def linear_score(features: dict[str, float], intercept: float = 0.0, centre: dict[str, float] | None = None, scale: dict[str, float] | None = None, sigmoid: bool = False) -> Column:
    """A weighted sum of columns, standardised if centres and scales are given, through a logistic curve that doesn't overflow if asked for."""
    z = number(intercept)
    for name, weight in features.items():
        x = F.col(name).cast("double")
        if scale is not None:
            if scale[name] <= 0:
                raise ValueError("scales must be positive")
            x = (x - (centre or {}).get(name, 0.0)) / scale[name]
        z = z + weight * x
    return z if not sigmoid else F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
