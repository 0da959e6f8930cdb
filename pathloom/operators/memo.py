"""Responses of a model that are kept and asked for once.

A response is filed under the digest of the model's name and the whole prompt. Prompts of a table are made distinct and those that
are on file left out before anything is asked, so equal prompts cost one call and a rerun costs none. What a
model failed at goes to a table of its own, with the error, and is asked again the next time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.durable import durable
from ..sources.result_log import ResultLog


class Memo:
    """responses(key, prompt, response) and failures(key, prompt, error) of one model under a folder."""

    def __init__(self, spark: SparkSession, folder: str, model: str):
        self.model = model
        self.responses = ResultLog(spark, f"{folder}/responses", "key string, prompt string, response string", "parquet")
        self.failures = ResultLog(spark, f"{folder}/failures", "key string, prompt string, error string", "parquet")

    def key(self, prompt: Column | str) -> Column:
        prompt = F.col(prompt) if isinstance(prompt, str) else prompt
        return F.sha2(F.concat(F.lit(f"{self.model}\x00"), prompt), 256)

    def on_file(self) -> DataFrame:
        """key and response, one for each key (two runs at a time may both have asked)."""
        return self.responses.read().groupBy("key").agg(F.min("response").alias("response"))

    def answer(self, df: DataFrame, ask: Callable[[DataFrame], DataFrame], prompt: str = "prompt", response: str = "response") -> DataFrame:
        """df with the response to each prompt, '' where it failed or the prompt is null. ask: adds response and error to rows of prompts."""
        wanted = df.where(F.col(prompt).isNotNull()).select(self.key(prompt).alias("key"), F.col(prompt).alias("prompt")).dropDuplicates(["key"])
        new = wanted.join(self.responses.read().select("key").distinct(), "key", "left_anti")
        asked = durable(ask(new), "asked")  # so that each is asked once, whatever reads it
        batch = uuid.uuid4().hex
        self.responses.append(asked.where("error is null").select("key", "prompt", "response"), batch)
        if not (failed := asked.where("error is not null")).isEmpty():
            self.failures.append(failed.select("key", "prompt", "error"), batch)
        filed = self.on_file().select(F.col("key").alias("_key"), F.col("response").alias("_response"))
        rows = df.drop(response).withColumn("_of", self.key(prompt))
        return rows.join(filed, F.col("_of") == F.col("_key"), "left").withColumn(response, F.coalesce("_response", F.lit(""))).drop("_of", "_key", "_response")


@dataclass(frozen=True)
class Remembered:
    """A factory of generators whose responses are kept in a memo; generate() takes it like any other."""

    factory: Callable
    memo: Memo
