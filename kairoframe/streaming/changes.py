"""A change log as a streaming source with a cursor: ``spark.readStream.format("kairoframe_changes").option("path", ...)``.

The log is a folder of folders, number=0, number=1, ..., one for each micro-batch that published (live.publish writes such). An offset is how many of them have been read; a query's checkpoint is
the cursor, so that whoever drains with it again gets what was published since, each row once. With the option ``until`` a drain stops before that number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class Files(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.until, self.names = options["path"], int(options.get("until", 1 << 62)), schema.fieldNames()

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path.removeprefix('file:')}")

    def initialOffset(self) -> dict:
        return {"number": 0}

    def latestOffset(self) -> dict:
        fs, root = self._open()
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        numbers = [int(f.base_name.removeprefix("number=")) for f in found if f.base_name.startswith("number=")]
        return {"number": min(self.until, max(numbers, default=-1) + 1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        fs, root = self._open()
        wanted = range(start["number"], end["number"])
        return [Files(f.path) for n in wanted for f in fs.get_file_info(pafs.FileSelector(f"{root}/number={n}", allow_not_found=True)) if f.base_name.endswith(".parquet")]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = self._open()
        with fs.open_input_file(partition.path) as file:
            yield from pq.ParquetFile(file).iter_batches(columns=self.names)

    def commit(self, end: dict) -> None:
        """Nothing to let go of: the log stays."""


class ChangeLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kairoframe_changes"

    def schema(self) -> str:
        raise ValueError("give the log's schema with .schema(...)")

    def streamReader(self, schema: StructType) -> ChangeReader:
        return ChangeReader(self.options, schema)


def drain(spark: SparkSession, log: str, schema: StructType | str, cursor: str, out: str, until: int | None = None) -> None:
    """Append what was published since the cursor (a checkpoint folder) to the table ``out``, and move the cursor on."""
    spark.dataSource.register(ChangeLog)
    reader = spark.readStream.format("kairoframe_changes").schema(schema).option("path", log)
    rows = (reader if until is None else reader.option("until", until)).load()
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", cursor).trigger(availableNow=True).start().awaitTermination()
