"""Intermediate tables that outlive the executors that made them."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Unset, a local master gets a temporary folder; a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "pathloom-shared")


#: Row groups of tables of long rows. Parquet writes a row group once it is full, but by default it looks after a hundred rows only; what reads a row group holds it.
WIDE = {"parquet.block.size": 32 << 20, "parquet.block.size.row.check.min": 2, "parquet.page.size.row.check.min": 2, "compression": "zstd"}


def durable(df: DataFrame, label: str, wide: bool = False) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage. wide: its rows are long, up to some MB."""
    path = f"{shared_dir(df.sparkSession)}/pathloom-{uuid.uuid4().hex}/{label}"
    df.write.options(**WIDE if wide else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, *by: str, wide: bool = False) -> DataFrame:
    """df as a table in the shared folder, dealt by `by` into as many buckets as shuffles have partitions and sorted within; the planner knows, so a join on `by` doesn't shuffle it."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"pathloom_{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/pathloom-{uuid.uuid4().hex}/{label}"
    df.repartition(n, *by).write.format("parquet").options(**WIDE if wide else {}).bucketBy(n, *by).sortBy(*by).option("path", path).saveAsTable(name)
    return spark.table(name)
