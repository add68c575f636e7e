"""Where intermediate tables live and how lineage is cut.

Intermediate results are written as Parquet below the folder the session names in
``spark.checkpoint.dir`` (shared storage on a cluster), so a lost executor costs a
re-read and not a re-computation. Nothing is kept in executor-local blocks.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Shared scratch root of this application.

    Read from the session. Only a ``local`` master without a configured folder gets a
    private one; a cluster without ``spark.checkpoint.dir`` is a configuration error.
    """
    sc = spark.sparkContext
    configured = (
        spark.conf.get("spark.checkpoint.dir", None)
        or sc.getConf().get("spark.checkpoint.dir", None)
        or sc.getCheckpointDir()
    )
    if configured:
        return f"{configured.rstrip('/')}/corpusgraph/{sc.applicationId}"
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="corpusgraph-")
    return _local_dirs[sc.applicationId]


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once and read it back: cuts the lineage and yields real size statistics."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_tables: dict[tuple[str, str, str], DataFrame] = {}


def shared(spark: SparkSession, scope: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Written table of (application, scope), built at first use and handed out afterwards."""
    key = (spark.sparkContext.applicationId, scope, name)
    if key not in _tables:
        _tables[key] = build()
    return _tables[key]


def materialised_once(
    spark: SparkSession, scope: str, name: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """Derived table of (application, scope), written at first use and shared afterwards."""
    return shared(spark, scope, name, lambda: materialise(build(), name))


def is_empty(df: DataFrame) -> bool:
    """Cheap on a materialised table: reads at most one row."""
    return df.isEmpty()


def spread(df: DataFrame) -> DataFrame:
    """Round-robin only when the input has fewer splits than the cluster has cores (one big file
    in one row group); a table with enough splits is passed through without a shuffle. For plain
    scans: asking a plan with shuffles for its partitions would run it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
