"""The shared folder of the cluster, and tables written to it to cut a plan in two."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that the driver and all executors see, which the cluster names in spark.checkpoint.dir.

    Where that is unset, a session on one machine gets a folder below its warehouse; on a cluster it is an error, since a
    local folder would be another one on each machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get()
    return f"{root.rstrip('/')}/quarryline-{uuid.uuid4().hex}"


def tasks_for(df: DataFrame, rows: int = 500_000) -> int:
    """Partitions for a shuffle of `df`, so that a task has about `rows` rows however many there are; not fewer than the session's."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // rows + 1)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """`df` as a Parquet table in the shared folder, computed once."""
    path = f"{shared_dir(df.sparkSession)}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
