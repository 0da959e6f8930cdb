"""Accuracy by hop over results as they arrive: an extension, as the engine's batch evaluator on a stream of result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import judged
from ..sources import schemas


def stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Result records of the JSON-lines files of a folder; lines that don't parse are left out."""
    return spark.readStream.schema(f"{schemas.RESULT}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").option("maxFilesPerTrigger", files_per_trigger).json(folder).where("_corrupt_record is null").drop("_corrupt_record")


def accuracy(results: DataFrame, gold: DataFrame) -> DataFrame:
    """num_hops, correct and total so far. The state is a row for each hop; gold is joined as a static side."""
    return judged(results.select("data_id", "results"), gold).groupBy("num_hops").agg(F.sum(F.col("correct").cast("bigint")).alias("correct"), F.count("*").alias("total"))
