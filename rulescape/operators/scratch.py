"""Cut a plan at a table written to the shared checkpoint folder.

Loops (components, reachability) write each round as Parquet where every executor can
read it, so losing an executor never loses a round and the plan stays short.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CONF = "spark.checkpoint.dir"

_WRITTEN: list[str | None] = []


def folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A single-process local session that names none gets a temporary one."""
    context = spark.sparkContext
    base = spark.conf.get(CONF, None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^,\]]*\])?", context.master):
            raise ValueError(f"set {CONF} to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


def write_table(df: DataFrame, *aggs) -> tuple[DataFrame, dict]:
    """Write `df`, and return it re-read with the observed row count and aggregates."""
    spark = df.sparkSession
    path = f"{folder(spark)}/rulescape-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *aggs).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get


def cut(df: DataFrame) -> DataFrame:
    return write_table(df)[0]


def mark() -> int:
    """A place in the list of tables written so far, for `clear`."""
    return len(_WRITTEN)


def clear(spark: SparkSession, since: int = 0, keep: int | None = None) -> None:
    """Delete the tables this process wrote from `since` on (up to the mark `keep`); call it once no result that
    reads them is needed. Places in the list stay, so marks taken before hold."""
    for at in range(since, len(_WRITTEN) if keep is None else keep):
        if _WRITTEN[at]:
            path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN[at])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            _WRITTEN[at] = None
