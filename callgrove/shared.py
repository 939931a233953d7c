"""The folder that driver and executors share, and tables that cut lineage by being written there."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: By application: a local session's own folder, and the folders made.
_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local session that has none gets a folder of its own, a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if spark.sparkContext.applicationId not in _own:
            _own[spark.sparkContext.applicationId] = Path(tempfile.mkdtemp(prefix="callgrove-")).as_uri()
            spark.sparkContext.setCheckpointDir(_own[spark.sparkContext.applicationId])
        found = _own[spark.sparkContext.applicationId]
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_intermediates(spark: SparkSession) -> int:
    """Deletes the folders that this session's queries have made so far, once their results are no longer read; returns how many."""
    removed = 0
    for path in _made.pop(spark.sparkContext.applicationId, []):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        removed += place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return removed


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task of a dealt table takes at most, about, and those that are worth a task of their own.
TASK_ROWS, LEAST_ROWS = 200_000, 20_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows, which are counted first, dealt by keys to a number of tasks that grows with them, whatever the session's number of partitions."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(-(-n // LEAST_ROWS), max(2 * cores, -(-n // TASK_ROWS)))), *keys)


def sized(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df marked for broadcast if it has no more than so many rows, else as it is (a shuffled join)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
