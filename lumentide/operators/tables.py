"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode an own folder where that is unset."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


#: Rows of a table that a task gets when it is dealt out.
ROWS_A_TASK = 1_000_000


def parts(df: DataFrame, copies: int = 1) -> int:
    """How many tasks df is dealt to: a task for each ROWS_A_TASK rows, each standing for some copies, and as many as there are cores at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() * copies // ROWS_A_TASK))


def dealt(df: DataFrame, *keys: str, copies: int = 1) -> DataFrame:
    """df dealt out by keys to its number of parts, so that what a task sorts or hashes doesn't grow with the table.

    Without a number Spark makes as few parts as fit its cores. A task that makes several rows of one counts them as copies.
    """
    return df.repartition(parts(df, copies), *keys)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
