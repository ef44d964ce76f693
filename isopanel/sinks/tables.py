"""Intermediate and result tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid
from posixpath import join

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names, or below the warehouse where that is unset.

    Driver and executors must share it, so on a cluster a warehouse on a local disk is refused. The folder of a session
    goes when its JVM ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        one_machine = spark.sparkContext.master.split("[")[0] == "local"
        if not one_machine and (root.startswith("file:") or "://" not in root):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    session = join(root, f"isopanel-{spark.sparkContext.applicationId}")
    path = spark._jvm.org.apache.hadoop.fs.Path(session)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return join(session, uuid.uuid4().hex)


def store(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write the rows as Parquet into the shared folder and go on from there.

    For a result that several others are made of. It is computed once, survives the loss of executors, and its
    size is known to the planner, which then broadcasts it only if it is small. With ``by`` each value of that column
    has a folder of its own.
    """
    path = join(work_dir(df.sparkSession), name)
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])
