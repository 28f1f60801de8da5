"""The folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only in local sessions, as in tests, that name no shared folder.
LOCAL = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, as the cluster names it. Only a local session may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = LOCAL
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def staged(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet in this application's part of the shared folder and read back: for what several branches of a plan read. Filters and
    columns are pushed into each branch's scan, and a lost executor costs no work from before."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/tallyspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
