"""Lookups against tables with one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPREAD = 4096


def lookup(df: DataFrame, key: Column, dim: DataFrame, dim_key: str, outputs: dict[str, str],
           spread: Column | None = None) -> DataFrame:
    """Left-join `dim` (unique on `dim_key`) and add `outputs` (new name -> dim column).

    Rows without a key would all hash to one task; they are given a key that matches
    nothing, varied by `spread`. No broadcast is forced: Spark picks one when it knows
    the table is small, and splits a hot key at run time otherwise.
    """
    if spread is not None:
        key = F.coalesce(key, F.concat(F.lit("\x00"), F.pmod(F.xxhash64(spread), F.lit(_SPREAD)).cast("string")))
    side = dim.select(F.col(dim_key).alias("__dim_key"), *[F.col(c).alias(n) for n, c in outputs.items()])
    return (df.withColumn("__key", key).join(side, F.col("__key") == F.col("__dim_key"), "left")
            .drop("__key", "__dim_key"))
