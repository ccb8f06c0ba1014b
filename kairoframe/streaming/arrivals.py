"""A finite table as arrivals: parts that come one after another, for running a stream over data that are at hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame


class Arrivals:
    """rows, written once by their part (0 to parts - 1) and put in front of a stream part by part. ``stream`` reads what has arrived; whoever runs it goes on from its checkpoint."""

    def __init__(self, rows: DataFrame, part: Column, parts: int, path: str) -> None:
        self.spark, self.schema, self.parts, self.path = rows.sparkSession, rows.schema, parts, path
        rows.withColumn("__part", part.cast("int")).write.partitionBy("__part").parquet(f"{path}/staged")
        self._files = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("source"))

    def _path(self, name: str):
        return self._files.Path(f"{self.path}/{name}")

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/source")

    def run(self, drain: Callable[[], object]) -> None:
        """Let each part arrive, and drain after it. A part is moved as a whole folder, so no row passes through one task."""
        for i in range(self.parts):
            if self._fs.exists(self._path(f"staged/__part={i}")):
                self._fs.rename(self._path(f"staged/__part={i}"), self._path(f"source/part-{i}"))
            drain()
