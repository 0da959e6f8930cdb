"""A log of results to which batches are added exactly once.

A batch is written to a folder of its own and counts once its manifest is there: a small file, named after the batch, that names
that folder. The file is created only where there is none, so of several tries of one batch one counts. What a killed
run left without a manifest is never read; the batch is simply run again. Reading takes the folders that manifests name.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ResultLog:
    def __init__(self, spark: SparkSession, folder: str, schema: str, kind: str = "json"):
        """kind: "json" (lines) or "parquet"."""
        self.spark, self.folder, self.schema, self.kind = spark, folder, schema, kind
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *filter(None, parts))))

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [x.getPath().getName() for x in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _named_in(self, manifest: str) -> str:
        """The folder that a manifest names; '' if its writer was killed before the end."""
        stream = self._fs.open(self._path("manifests", manifest))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return text[:-1] if text.endswith("\n") else ""

    @staticmethod
    def _file(batch: str) -> str:
        return re.sub(r"[^A-Za-z0-9_-]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), batch)

    def batches(self) -> dict[str, str]:
        """The batches that count, as their files are called, and their folders."""
        return {m: own for m in self._names("manifests") if not m.startswith((".", "_")) and (own := self._named_in(m))}

    def has(self, batch: str) -> bool:
        path = self._path("manifests", self._file(batch))
        return self._fs.exists(path) and bool(self._named_in(self._file(batch)))

    def write(self, df: DataFrame, batch: str) -> str:
        """A try of a batch; it does not count yet."""
        own = f"{self._file(batch)}-{uuid.uuid4().hex}"
        df.write.format(self.kind).save(f"{self.folder}/data/{own}")
        return own

    def commit(self, batch: str, own: str) -> bool:
        """Whether this try is the one that counts."""
        path = self._path("manifests", self._file(batch))
        if self._fs.exists(path) and not self._named_in(self._file(batch)):
            self._fs.delete(path, False)
        try:
            stream = self._fs.create(path, False)
        except Exception as e:  # noqa: BLE001  py4j's, of which only an existing file is expected
            if not self._fs.exists(path):
                raise
            if "exists" not in str(e).lower():
                raise
            return False
        try:
            stream.write(bytearray(f"{own}\n".encode()))
        finally:
            stream.close()
        return True

    def append(self, df: DataFrame, batch: str) -> bool:
        """Add a batch unless it is there; whether this call added it."""
        return not self.has(batch) and self.commit(batch, self.write(df, batch))

    def read(self) -> DataFrame:
        folders = [f"{self.folder}/data/{own}" for own in sorted(self.batches().values())]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.format(self.kind).schema(self.schema).load(folders)

    def sweep(self) -> int:
        """Remove what no manifest names; only while no run is under way. How many folders went."""
        held = set(self.batches().values())
        lost = [x for x in self._names("data") if x not in held]
        for x in lost:
            self._fs.delete(self._path("data", x), True)
        return len(lost)

    def sink(self, query: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: a micro-batch that is run again after a failure is not added again."""
        return lambda df, n: (self.append(df, f"{query}-{n}"), None)[1]

    def run(self, todo: DataFrame, step: Callable[[DataFrame], DataFrame], key: str, parts: int) -> int:
        """Results of step() for all of todo, in `parts` batches dealt by a hash of the key; batches that are there are not run again. How many were run."""
        run = 0
        for i in range(parts):
            batch = f"{i}-of-{parts}"
            if not self.has(batch):
                run += self.append(step(todo.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i)), batch)
        return run
